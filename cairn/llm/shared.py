"""Helpers shared by the operators of this subpackage: tables, checkpoints, components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, as the contracts of the operators name it.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session, else the context's checkpoint folder. Only a local master gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Inside, texts go to Python in batches of few rows, so that a task holds little of them at once. For steps that run inside, such as `cut`."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed and written to the shared folder; its lineage ends there."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_of(rows: int, each: int = 1 << 16) -> int:
    """Partitions in proportion to `rows`, so that small steps of an iteration do not write a file for each of many empty partitions."""
    return max(1, -(-rows // each))


def cut_small(df: DataFrame) -> DataFrame:
    """cut, and then read in partitions in proportion to the rows."""
    df = cut(df)
    return df.coalesce(parts_of(df.count()))


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", most: int = 1 << 20) -> DataFrame:
    """The rows of `docs` whose id is not among the distinct `ids` (one column of longs, null matches null). Up to `most` ids are broadcast, so that
    no text moves; more of them meet the documents by a shuffle."""
    ids = cut(ids.toDF("gone"))
    rows = ids.count()
    if not rows:
        return docs
    return docs.join(F.broadcast(ids) if rows <= most else ids, docs[doc_id].eqNullSafe(ids["gone"]), "left_anti")


def seeded(seed: int, *cols: Column) -> Column:
    """A pseudo-random long of 60 bits made of `cols`, the same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as (src, dst) longs: (node, component).

    component is the smallest node that can be reached. Nodes without an edge do not appear; loops
    and repeated edges do no harm. Large-star and small-star steps alternate until nothing changes:
    each step hangs neighbours on their least neighbour, so a component of any shape shrinks to a star
    in about log(n) rounds, with no node's neighbour list ever in one place (aggregates combine before
    the shuffle, hot nodes are split by the skew join).
    """
    now = cut_small(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before, parts = mark, parts_of(mark[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").coalesce(parts).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
