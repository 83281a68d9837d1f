"""Operator 2, exact dedup: skew-safe combining of equal texts.

Three stages, each comparing whole contents and never digests alone:

1. within a map task, equal texts are folded into one row (partial aggregation);
2. the folded rows meet by digest and salt, so a text that a third of all rows share is still
   dealt over `salts` tasks;
3. the at most `salts` winners of each content meet by digest.

All of it is DataFrame aggregation with a fixed-width buffer, so Spark hashes instead of sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.llm.shared import SPACE, cut, table

_SHIFT = "100000000000000000000"  # over 2^64: a length stands above any document id


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16, digest=lambda c: F.unhex(F.sha2(c, 256))) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the one with
    the smallest id. Null texts count as empty; empty texts are equal to one another. A null id loses
    against any other. Rows that repeat both id and text count in group_size and share their flag.
    Other columns of `docs` play no part. `digest` only speeds the meeting up: texts whose digests
    clash are told apart by content.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    rows = rows.select("doc_id", F.coalesce(F.length("t"), F.lit(0)).alias("len"), normalised(F.col("t")).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    # One fixed-width number orders candidates: length first, then 2^63 - id; 0 stands for a null id.
    rank = F.col("len").cast("decimal(38,0)") * F.lit(_SHIFT).cast("decimal(21,0)")
    late = F.coalesce(F.lit("9223372036854775808").cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    rank = (rank + late).cast("decimal(38,0)")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = rows.groupBy("digest", salt.alias("salt"), "norm").agg(F.max(rank).alias("best"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    # What members look up is small: no content, one row per digest; clashing digests are counted.
    found = cut(whole.groupBy("digest").agg(F.max("best").alias("best"), F.max("n").alias("n"), F.count("*").alias("contents")))
    low = (F.col("best") % F.lit(_SHIFT).cast("decimal(21,0)"))
    keep = F.when(low > 0, (F.lit("9223372036854775808").cast("decimal(20,0)") - low).cast("long"))
    out = rows.select("doc_id", "digest", F.sha2("norm", 256).alias("sha"))
    out = out.join(found.where("contents = 1").select("digest", "best", "n"), "digest")
    if not found.where("contents > 1").isEmpty():
        clash = found.where("contents > 1").select("digest")
        content = whole.join(clash, "digest", "left_semi").select("digest", "norm", "best", "n")
        again = rows.join(clash, "digest", "left_semi").join(content, ["digest", "norm"])
        out = out.unionByName(again.select("doc_id", "digest", F.sha2("norm", 256).alias("sha"), "best", "n"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
