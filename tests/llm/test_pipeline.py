"""The pipeline's stages on small tables against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
from cairn.llm import bpe, quality, simhash
from tests.llm.test_quality import make

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_exact_stage(spark):
    rows = [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b", "s"), (None, "q", "s"), (None, "r", "s"), (5, "z", "s"), (5, "z", "s"), (5, "y", "s"), (6, None, "s"), (7, "", None)]
    got = corpus_pipeline.drop_exact_copies(spark, table_of(spark, rows), "")
    assert got.columns == table_of(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, "a  b"), (None, "q"), (None, "r"), (5, "z"), (5, "y"), (6, None)], key=repr)
    assert corpus_pipeline.drop_exact_copies(spark, table_of(spark, []), "").count() == 0


def test_near_stage(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, near = [], set()
    for i in range(50):
        text = [rng.choice(words) for _ in range(250)]
        rows.append((3 * i, " ".join(text), "s"))
        if i % 2:
            for at in rng.sample(range(250), 2):
                text[at] = "edited"
            rows.append((3 * i + 1, " ".join(text), "s"))
            near.add(3 * i + 1)
    assert all(jaccard(rows[k][1], rows[k - 1][1]) >= 0.8 for k in range(len(rows)) if rows[k][0] in near)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table_of(spark, [*rows, (None, None, "s")]), "").collect()}
    assert got - {None} >= {r[0] for r in rows} - near and None in got
    assert len(got & near) <= 2
    assert simhash.similar_bits(0.8, 256) < 80


def test_mix_stage(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", None])) for i in range(400)] + [(900, "", "a")]
    got = corpus_pipeline.mix(spark, table_of(spark, rows), "").collect()
    counts = Counter(r.doc_id for r in got)
    assert set(counts.values()) <= {1, 2} and counts[900] == 1
    words = sum(len(re.findall(r"\S+", r.text)) for r in got)
    total = sum(len(re.findall(r"\S+", t)) for _, t, _ in rows)
    assert abs(words - 1.5 * total) < 0.05 * total


def test_whole_pipeline(spark, tmp_path):
    rows = make(5, 400)
    docs = table_of(spark, [(i, t, "s" + str(i % 3)) for i, t, _ in rows] + [(1000 + i, t + " ", "s1") for i, t, y in rows[:50]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad = {i for i, _, y in rows if not y}
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & bad) < 0.08 * len(bad) and len({i for i, _, y in rows if y} - ids) < 25
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r.doc_id: r.n_tokens for r in got}
    own = bpe.load(bpe.default_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got and all(n == len(own.encode(texts[i])) for i, n in tokens.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "bpe"]


def exact_groups(rows):
    """Least id of each row's component, over all pairs of a five-word Jaccard similarity of 0.8."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


def near_groups(spark, rows):
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.component_id for r in got}


def text_of(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_near_copies_with_passages_added_or_cut(spark):
    rng = random.Random(7)
    rows = []
    for i in range(20):
        base, block = text_of(rng, 300), text_of(rng, 70)
        other = [base + block, base[:245], base[:100] + block[:60] + base[100:], block + base][i % 4]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = exact_groups(rows)
    assert sum(want[2 * i + 1] == 2 * i for i in range(20)) == 20
    assert near_groups(spark, rows) == want


def test_near_copies_with_lines_repeated(spark):
    rng = random.Random(8)
    rows = []
    for i in range(12):
        base, line = text_of(rng, 300), text_of(rng, 12)
        rows += [(2 * i, " ".join(base + line)), (2 * i + 1, " ".join(base + line * [5, 10, 20][i % 3]))]
    want = exact_groups(rows)
    assert all(want[2 * i + 1] == 2 * i for i in range(12))
    assert near_groups(spark, rows) == want


def test_near_copies_stay_apart_under_the_similarity(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        base = text_of(rng, 300)
        other = list(base)
        for at in rng.sample(range(2, 298), 6 + i % 5):
            other[at] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = exact_groups(rows)
    assert 5 < sum(want[2 * i + 1] != 2 * i for i in range(30)) < 30
    assert near_groups(spark, rows) == want


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["score", "sha", "n", "times", "turn", "kept_id", "gone", "mixed", "size", "group", "node", "text_sha256", "count"]
    schema = COLUMNS + "".join(f", {n} string" for n in names)
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (2, None), (None, ""), (None, "x y z"), (3, "long " * 30_000), (4, "a b c d e f "), (5, "a b c d e f"), (6, " ")]
    docs = spark.createDataFrame([(i, t, None, None if i == 3 else "s", 1, *names) for i, t in texts], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage, left in ((corpus_pipeline.keep_quality, 10), (corpus_pipeline.drop_exact_copies, 5), (corpus_pipeline.drop_near_copies, 7), (corpus_pipeline.mix, None)):
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert got.columns == docs.columns and all(tuple(r)[5:] == tuple(names) for r in rows)
        assert left is None or len(rows) == left, (stage.__name__, rows and [(r.doc_id, (r.text or "")[:9]) for r in rows])
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    exact = {(r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path)).collect()}
    assert exact == {(4, "a b c d e f "), (1, "other words here"), (6, " "), (None, "x y z"), (3, "long " * 30_000)}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()} == {1, 2, 3, None}
    assert corpus_pipeline.tokenise(spark, docs, str(tmp_path)).count() == 10


def test_many_ids_leave_by_a_shuffle_as_by_a_broadcast(spark):
    from cairn.llm.shared import without

    docs = spark.createDataFrame([(i, "t") for i in [1, 2, 2, 3, None]], "doc_id long, text string")
    for ids, left in (([2, None], [1, 3]), ([], [None, 1, 2, 2, 3]), ([7], [None, 1, 2, 2, 3])):
        gone = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for most in (0, 100):
            assert sorted((r.doc_id for r in without(docs, gone, most=most).collect()), key=lambda x: (x is not None, x)) == left


def test_large_family_of_near_copies(spark):
    """A text and many edits of it, some too far from all others: the same groups as over all pairs."""
    rng = random.Random(11)
    base, rows = text_of(rng, 150), []
    for i in range(160):
        other = list(base)
        for at in rng.sample(range(150), min(9, int(rng.expovariate(0.4)))):
            other[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    rows += [(200 + i, " ".join(text_of(rng, rng.randint(1, 12)))) for i in range(30)] + [(300, "one two"), (301, "one two three"), (302, "ONE two")]
    want = exact_groups(rows)
    assert 3 < len({want[i] for i in range(160)}) < 160
    assert near_groups(spark, rows) == want


def test_near_stage_probes_fingerprints_by_the_pigeonhole(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(12):
        text = [f"w{rng.randrange(4000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(text), "s"), (2 * i + 1, " ".join([*text, "more"]), "s")]
    bits = [int(simhash._majorities([simhash._shingles(t, 5)], 1)[0]) for _, t, _ in rows]
    near = {rows[k][0] for k in range(1, len(rows), 2) if (bits[k] ^ bits[k - 1]).bit_count() <= 3}
    assert len(near) > 8
    monkeypatch.setattr(simhash, "_buckets", lambda batches: iter(()))  # nothing comes from the shingles' prefixes
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table_of(spark, rows), "").collect()}
    assert got == {r[0] for r in rows} - near


class Plan:
    """Stands for a table; mapInArrow gives the function itself."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_tokenizer_keeps_no_words_behind_a_task(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    batch = docs.toArrow().to_batches()
    rows = list(bpe.bpe_digests(Plan(docs.schema), bpe.default_path())(batch))
    assert sum(r.num_rows for r in rows) == 2 and rows[0].column(1)[0].as_py() >= 3
    own = bpe.load(bpe.default_path())
    assert not (own._cache or own._old or own._known or own._known_old)


def test_scores_leave_in_small_batches(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(1300)], "doc_id long, text string")
    model = quality.Model()
    batches = docs.toArrow().combine_chunks().to_batches()
    got = list(quality.with_score(Plan(docs.schema), model)(batches))
    assert max(b.num_rows for b in got) <= 512
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(1300))
    want = model.scores([quality.passages(t) for b in batches for t in b.column(1).to_pylist()])
    assert max(abs(x - y) for x, y in zip(want, [p for b in got for p in b.column(2).to_pylist()], strict=True)) < 1e-12
