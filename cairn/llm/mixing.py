"""Operator 3, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A mix of a given number of blocks is dealt to the sources by highest quotients target / (2k - 1), then
each source's integer quota is dealt to its shards the same way. A shard lays its documents out in a
seeded order, cuts the row of tokens into blocks and takes its quota of consecutive blocks from a
seeded start, going round as often as the quota asks for. Only DataFrame functions are used.

Nothing is sequential over the corpus: quotients are ranked only for the seats that are not settled
by a bound (about two per source or shard), a source of n documents has about sqrt(n) shards of
about sqrt(n) documents, and what a document gives is a closed form of its place in its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.llm.shared import WORD, cut, seeded, table


def water_fill(sources: DataFrame, share: float, cap: float, weights: list[float], key: str = "source", size: str = "source_size") -> DataFrame:
    """`sources` with `weight` and `target`: `share` times all sizes dealt by weight, no source above
    `cap` times its size, what is cut off dealt to the others by weight.

    Weights repeat over the sources in code-point order, null last. In order of cap / weight, the first source that its level does not overflow sets
    the level of all.
    """
    at = F.row_number().over(W.orderBy(F.col(key).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col(size) * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col(key).asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum(size).over(every) * F.lit(float(share)) - full) / rest
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("level", F.min_by("level", F.when(fits, F.col("at"))).over(every))
    return rows.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).drop("level", "at", "most")


def sainte_lague(rows: DataFrame, group: list[str], name: str, votes: str, seats: str, quota: str) -> DataFrame:
    """`rows` with the column `quota`: in each group, `seats` seats dealt by highest quotients votes / (2k - 1).

    Equal quotients go by `name`. All seats of a group go to its names with positive votes. With V votes and n names, a
    name surely has the seats it gets at the divisor V / (seats - n/2), one fewer for rounding, and never more than at
    V / (seats + n/2), one more for rounding; quotients are ranked only between the two.
    """
    of = W.partitionBy(*group)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    total, names = F.sum(v).over(of), F.count(F.when(v > 0, 1)).over(of)
    base = F.greatest(F.lit(0.0), F.ceil(v * (s - names / 2) / total - 0.5).cast("double") - 1)
    most = F.floor(v * (s + names / 2) / total + 0.5) + 1
    rows = rows.withColumn("_base", F.when(v > 0, base).otherwise(0.0).cast("long")).withColumn("_most", F.when(v > 0, most).otherwise(F.lit(0)).cast("long"))
    open_seats = rows.withColumn("_left", F.col(seats) - F.sum("_base").over(of)).where("_most > _base")
    claims = open_seats.select(*group, name, "_left", v.alias("_v"), F.explode(F.sequence(F.col("_base") + 1, F.col("_most"))).alias("_k"))
    claims = claims.withColumn("_rank", F.row_number().over(of.orderBy((F.col("_v") / (2 * F.col("_k") - 1)).desc(), name, "_k")))
    won = claims.where("_rank <= _left").groupBy(*group, name).agg(F.count("*").alias("_won"))
    out = rows.join(won, [*group, name], "left")
    return out.withColumn(quota, F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_base", "_most", "_won")


_SALTS = 64


def _overlap(a: Column, b: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, end) - F.greatest(a, start))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, most_repeats: int = 2, block: int = 64, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken.

    size counts the words of the text (null: none). The mix holds `share` times all words; targets come
    from water_fill. `block` is the number of words in a block, made smaller where the smallest positive target is below 100
    blocks. taken sums to within a block of a source's target, but for a source at its cap, whose shards may miss up to half a
    block each. No document gives more than `most_repeats` times its size. A null source is a source;
    documents without words give nothing; repeated rows take places of their own. Same input and seed, same result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = cut(rows.withColumn("key", key).withColumn("h", seeded(seed, F.col("doc_id"))))
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = water_fill(sources, share, most_repeats, list(weights))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    sources = sources.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 100))), F.lit(1)).cast("long"))
    sources = sources.withColumn("all_blocks", F.floor(F.sum("target").over(every) / F.col("block") + 0.4999999).cast("long")).withColumn("mix", F.lit(0))
    sources = sainte_lague(sources, ["mix"], "key", "target", "all_blocks", "blocks")
    sources = sources.withColumn("n_shards", F.ceil(F.sqrt("n_docs")).cast("long")).select("key", "source_size", "target", "block", "blocks", "n_shards")
    # Sources are blown up by a salt, so that the rows of a large one meet it in many tasks; then its shards are dealt out.
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(_SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    dealt = dealt.withColumn("shard", F.pmod(F.col("h"), F.col("n_shards"))).repartition("key", "shard")
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["key"], "shard", "shard_size", "blocks", "quota")
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * most_repeats)
    z = F.greatest(F.col("shard_size"), F.lit(1))
    first = F.pmod(seeded(seed, F.col("key"), F.col("shard")), F.ceil(z / F.col("block"))) * F.col("block")
    shards = shards.select("key", "shard", "shard_size", F.floor(words / z).cast("long").alias("rounds"), F.pmod(words, z).cast("long").alias("part"), first.cast("long").alias("first"))
    order = W.partitionBy("key", "shard").orderBy(seeded(seed + 1, F.col("doc_id")), "doc_id", "size")
    dealt = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    out = dealt.join(shards, ["key", "shard"])
    a, b, s, e, size = F.col("first"), F.col("first") + F.col("part"), F.col("start"), F.col("end"), F.col("shard_size")
    taken = F.col("rounds") * F.col("size") + _overlap(a, b, s, e) + _overlap(a - size, b - size, s, e)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _lague_sql(rows: str, group: str, name: str, votes: str, seats: str, quota: str) -> str:
    """sainte_lague as a query: highest quotients, ranked over all seats that a name may get."""
    return f"""
  SELECT r.*, coalesce(q.won, 0) AS {quota} FROM {rows} r LEFT JOIN (
    SELECT {group} AS g, {name} AS n, count(*) AS won FROM (
      SELECT {group}, {name}, {seats}, row_number() OVER (PARTITION BY {group} ORDER BY {votes}::DOUBLE / (2 * k - 1) DESC, {name}, k) AS rank
      FROM (SELECT *, unnest(range(1, 3 + ceil({votes}::DOUBLE * ({seats} + count(*) OVER (PARTITION BY {group})) / sum({votes}::DOUBLE) OVER (PARTITION BY {group}))::BIGINT)) AS k FROM {rows} WHERE {votes} > 0)
    ) WHERE rank <= {seats} GROUP BY 1, 2
  ) q ON q.g = r.{group} AND q.n = r.{name}"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h, ('0x' || substr(md5('43|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h2 FROM documents
), s0 AS (SELECT key, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY 1, 2
), s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s0
), s2 AS (
  SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1 WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), s3 AS (SELECT *, least(most, coalesce((SELECT arg_min(level, place) FROM s2 WHERE level * weight <= most) * weight, most)) AS target FROM s2
), s4 AS (SELECT key, source_size, n_docs, target, 0 AS mix, coalesce(greatest(1, least(64, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 100))), 1)::BIGINT AS block FROM s3
), s5 AS (SELECT *, floor(sum(target) OVER () / block + 0.4999999::DOUBLE)::BIGINT AS all_blocks FROM s4
), s6 AS ({_lague_sql("s5", "mix", "key", "target", "all_blocks", "blocks")}
), e AS (SELECT d.*, source_size, target, block, blocks, d.h % ceil(sqrt(n_docs))::BIGINT AS shard FROM d JOIN s6 USING (key)
), h0 AS (SELECT key, shard, sum(size)::BIGINT AS shard_size, any_value(block) AS block, any_value(blocks) AS blocks FROM e GROUP BY 1, 2
), h1 AS ({_lague_sql("h0", "key", "shard", "shard_size", "blocks", "quota")}
), h2 AS (
  SELECT key, shard, shard_size AS z0, greatest(shard_size, 1) AS z, least(quota * block, shard_size * 2) AS words, block,
         ('0x' || substr(md5('42|' || key || '|' || shard), 1, 15))::BIGINT % ceil(greatest(shard_size, 1)::DOUBLE / block)::BIGINT * block AS a FROM h1
), p AS (
  SELECT e.*, h2.z0, words // z AS rounds, words % z AS part, a, sum(size) OVER (PARTITION BY e.key, e.shard ORDER BY e.h2, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS en FROM e JOIN h2 ON e.key = h2.key AND e.shard = h2.shard
)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(a + part, en) - greatest(a, en - size)) + greatest(0, least(a + part - z0, en) - greatest(a - z0, en - size)))::BIGINT AS taken FROM p
"""
