"""From raw documents to token digests: quality, exact copies, near copies, mix, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.llm import bpe, exact_dedup, mixing, quality, simhash
from cairn.llm.shared import cut, ensure_folder, table, without


def _own(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score below 0.3 go.

    Without any usable label nothing goes. Null and empty texts are scored as one empty passage, a very long text over all its passages. Rows that repeat a
    text score alike; an empty table stays empty; columns of any further name are kept as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = _own(docs, "score")
    return quality.with_score(docs, model, score=name).where(F.col(name) >= 0.3).drop(name)


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` with one of the distinct `ids` (column kept_id); a null id matches a null."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts one stays: the longest, then that of the smallest id.

    Null texts count as empty and as copies of each other. Rows that repeat an id and a text are copies, too; an id that names several texts
    stays once for each that stands. A null id counts as one id. An empty table stays empty; further columns are kept as they are.
    """
    judged = cut(exact_dedup.exact_dedup(docs).select("doc_id", "kept", "text_sha256"))
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    rest = without(docs, gone)
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"))
    if twice.isEmpty():
        return rest
    # An id that names several rows stays once for each text that it stands for.
    keep = judged.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    sha, n = _own(docs, "sha"), _own(docs, "n")
    own = _kept(docs, twice).withColumn(sha, F.sha2(exact_dedup.normalised(F.col("text")), 256))
    own = own.join(keep, own["doc_id"].eqNullSafe(keep["kept_id"]) & (own[sha] == keep["kept_sha"]), "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id", sha).orderBy(F.length("text").desc(), "text"))
    own = own.withColumn(n, first).where(F.col(n) == 1).select(docs.columns)
    return rest.join(twice, rest["doc_id"].eqNullSafe(twice["kept_id"]), "left_anti").unionByName(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies (a Jaccard similarity of 0.8 of the five-word shingles, closed over chains) the smallest id stays.

    Null and wordless texts are one group; a text of fewer than five words is one shingle; very long texts count whole. A null id is larger than any
    other. Rows that share an id stay or go together: they stay if one of them is the smallest of its group. An empty table stays empty;
    further columns are kept as they are.
    """
    groups = simhash.near_copies(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    return without(docs, groups.where("not stays").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as the mix takes its words, rounded: not at all, once or twice.

    Wordless and null texts stay once. Null sources are a source, the last one. Rows that share an id all take the greatest of their counts. An empty
    table stays empty; further columns are kept as they are.
    """
    taken = mixing.mix_sources(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    name, turn = _own(docs, "times"), _own(docs, "turn")
    taken = taken.groupBy(F.col("doc_id").alias("mixed")).agg(F.max(times).alias(name)).where(F.col(name) > 0)
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["mixed"])).withColumn(turn, F.explode(F.sequence(F.lit(1), taken[name])))
    return rows.select([docs[c] for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token counts and digests of each row, repeated rows, null texts (no tokens) and very long texts included; an empty table gives an empty result."""
    return bpe.bpe_digests(docs, bpe.default_path())


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mix", mix), ("bpe", tokenise)]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again. What a stage has read is removed behind it; the
    last stage's input stays, as the result is still to be read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{ensure_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _forget(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
