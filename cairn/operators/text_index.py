"""A stored inverted index with positions: top rows by BM25 with bounds by cell, phrases, prefixes.

The folder holds postings (term, cell, id, tf, length, positions), sorted by ranges of terms so that a filter on terms reaches few row groups, `cells` (term, cell, n, impact) with the
greatest weight of a term in a cell of 1,024 documents, and one row of totals. A search reads its own terms: first the cells, whose summed bounds say which
documents can be among the best; then the postings of the most promising cells, whose last result is the least that any other must reach; then those of the cells that can.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.operators.tables import page

CELL = 1024
#: Words whose postings leave a task at once.
PIECE = 131_072
K1, B = 1.2, 0.75


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def _weight(tf: Column, length: Column, mean: Column | float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the documents (id, cell, lower-case text) of a task, about PIECE words at a time."""
    names = ["term", "cell", "id", "tf", "length", "positions"]
    for batch in batches:
        ids, cells = batch.column(0), batch.column(1)
        terms, doc, length, places, ends = [], [], [], [], [0]

        def piece():
            at = pa.array(doc, pa.int32())
            tf = pa.array([y - x for x, y in itertools.pairwise(ends)], pa.int32())
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), cells.take(at), ids.take(at), tf, pa.array(length, pa.int32()), positions], names=names)

        for k, text in enumerate(batch.column(2)):
            words, own = re.findall("[a-z0-9]+", text.as_py() or ""), {}
            for n, word in enumerate(words):
                own.setdefault(word, []).append(n)
            for word, at in own.items():
                terms.append(word)
                places += at
                ends.append(len(places))
            doc += [k] * len(own)
            length += [len(words)] * len(own)
            if len(places) >= PIECE:
                yield piece()
                terms, doc, length, places, ends = [], [], [], [], [0]
        if terms:
            yield piece()


def build(docs: DataFrame, folder: str) -> None:
    """Writes the index of docs (id, text), words being lower-case ASCII letters and digits; ids are unique. Documents without a word count in the totals only.

    A document's postings are made where its text is read, so the sort by terms is the only time that they move. A cell holds CELL neighbours of one input split.
    """
    spark = docs.sparkSession
    docs.select(F.size(_words(F.col("text"))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{folder}/totals")
    mean = _totals(spark, folder)[1] or 1.0
    rows = docs.select("id", F.floor(F.monotonically_increasing_id() / CELL).alias("cell"), F.lower("text").alias("text"))
    found = rows.mapInArrow(_found, f"term string, cell long, id {docs.schema['id'].dataType.simpleString()}, tf int, length int, positions array<int>")
    found.repartitionByRange("term", "cell").sortWithinPartitions("term", "cell", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    own = spark.read.parquet(f"{folder}/postings").select("term", "cell", _weight(F.col("tf"), F.col("length"), mean).alias("weight"))
    own = own.groupBy("term", "cell").agg(F.count("*").alias("n"), F.max("weight").alias("impact"))
    own.repartitionByRange("term", "cell").sortWithinPartitions("term", "cell").write.mode("overwrite").parquet(f"{folder}/cells")


def _totals(spark: SparkSession, folder: str) -> tuple[int, float | None]:
    row = spark.read.parquet(f"{folder}/totals").first()
    return row.n, row.mean


def postings(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of these terms; the filter goes down to the files' row groups."""
    return spark.read.parquet(f"{folder}/postings").where(F.col("term").isin(terms))


def top(spark: SparkSession, folder: str, terms: list[str], limit: int, digits: int = 9) -> DataFrame:
    """(id, score), the `limit` best documents that hold any of the terms, by the score rounded to `digits`, then id. Repeated terms count once; no term gives no rows."""
    terms = list(dict.fromkeys(terms))
    n, mean = _totals(spark, folder)
    cells = spark.read.parquet(f"{folder}/cells").where(F.col("term").isin(terms))
    known = {r.term: r.df for r in cells.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # at most as many rows as terms
    empty = spark.createDataFrame([], "id long, score double")
    if not known:
        return empty
    idf = F.create_map(*[F.lit(x) for t, df in known.items() for x in (t, math.log(1 + (n - df + 0.5) / (df + 0.5)))])
    bounds = cells.groupBy("cell").agg(F.sum(idf[F.col("term")] * F.col("impact")).alias("bound"))

    def scored(rows: DataFrame) -> DataFrame:
        weight = idf[F.col("term")] * _weight(F.col("tf"), F.col("length"), mean)
        return rows.groupBy("id").agg(F.round(F.sum(weight), digits).alias("score"))

    best = [r.cell for r in bounds.orderBy(F.desc("bound"), "cell").limit(limit).collect()]  # each holds a document or more
    own = postings(spark, folder, terms)
    first = scored(own.where(F.col("cell").isin(best)))
    reached = page(first, [F.desc("score"), "id"], limit).collect()
    least = reached[-1].score - 10.0**-digits if len(reached) == limit else -math.inf
    others = bounds.where((F.col("bound") >= least) & ~F.col("cell").isin(best)).select("cell")
    rest = scored(own.join(others, "cell", "left_semi"))
    return page(spark.createDataFrame(reached, empty.schema).unionByName(rest), [F.desc("score"), "id"], limit)


def phrase(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """(id, n): documents that hold the words next to one another, and how often. Lists of positions meet by document, each moved back by its word's place."""
    out = None
    for k, word in enumerate(words):
        back = F.expr(f"transform(positions, x -> x - {k})")
        own = postings(spark, folder, [word]).select("id", back.alias("_starts"))
        out = own.withColumnRenamed("_starts", "starts") if out is None else out.join(own, "id").select("id", F.array_intersect("starts", "_starts").alias("starts")).where(F.size("starts") > 0)
    if out is None:
        return spark.createDataFrame([], "id long, n int")
    return out.select("id", F.size("starts").alias("n"))


def terms_with(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(term, df) of the terms that begin so."""
    return spark.read.parquet(f"{folder}/cells").where(F.col("term").startswith(prefix)).groupBy("term").agg(F.sum("n").alias("df"))
