"""Text and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import settle
from cairn.operators.tables import page


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf) of lower-case words of ASCII letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return docs.select("id", F.explode(words).alias("term")).where("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], limit: int, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score), best first. Only the query's terms (ASCII letters and digits) are counted; corpus size and mean length are one row."""
    # Each word with a blank of its own on either side, so that plain replacing counts words; texts are read once.
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "  "), F.lit(" "))
    rows = docs.select("id", F.explode(F.array(words)).alias("w"))
    gaps = F.length("w") - F.length(F.replace("w", F.lit("  "), F.lit(" "))) + 1 - F.col("w").startswith("   ").cast("int") - F.col("w").endswith("   ").cast("int")
    length = F.when(F.trim("w") == "", 0).otherwise(gaps)
    count = [((F.length("w") - F.length(F.replace("w", F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("int").alias(f"t{k}") for k, term in enumerate(terms)]
    rows = settle(rows.select("id", length.alias("length"), *count))
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"t{k}") > 0).cast("int")).alias(f"d{k}") for k in range(len(terms))])
    rows = rows.where(" or ".join(f"t{k} > 0" for k in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        score = score + idf * F.col(f"t{k}") * (k1 + 1) / (F.col(f"t{k}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return page(rows.select("id", score.alias("score")), [F.desc(F.round("score", 9)), "id"], limit)


def phrase_search(docs: DataFrame, phrase: list[str], text: str = "text") -> DataFrame:
    """Ids of texts with the words next to one another."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return docs.where(F.concat(F.lit(" "), words, F.lit(" ")).contains(" " + " ".join(phrase) + " ")).select("id")


def prefix_search(symbols: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    return page(symbols.where(F.lower("name").startswith(prefix.lower())), [F.desc("pagerank"), "id"], min(limit, 50))


def did_you_mean(symbols: DataFrame, name: str, limit: int = 3, most: int = 3) -> DataFrame:
    names = symbols.select("name").where("name <> ''").distinct()
    return page(names.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(name.lower()))).where(F.col("distance") <= most), ["distance", "name"], limit)


def vector_top(vectors: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """(id, cosine) nearest to the one row of `query` (embedding)."""
    rows = vectors.join(F.broadcast(query.select(F.col("embedding").alias("q"))))  # one row
    return page(rows.select("id", X.cosine(F.col("embedding"), F.col("q")).alias("cosine")), [F.desc(F.round("cosine", 9)), "id"], limit)


def rrf(lists: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over ranked lists (id, rank)."""
    rows = lists[0].select("id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("id", "rank"))
    return page(rows.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score")), [F.desc(F.round("score", 9)), "id"], limit)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Ranks of an already limited list."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))
