"""Stemmed search over the names, kinds and paths of symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.stemming import stem, stems
from cairn.operators.tables import page

COLUMNS = ("name", "kind", "path")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def parse_query(query: str) -> tuple[list[str], bool, tuple[str, ...]]:
    """(stems of a phrase, whether the last is a prefix, columns): one bare word, `*` behind it or not, looks at names; anything else at all columns;
    `column:word` at that column."""
    column, _, rest = query.partition(":")
    columns = (column,) if rest and column in COLUMNS else COLUMNS
    text = rest if len(columns) == 1 else query
    if re.fullmatch(r"\w+\*?", text):
        columns = columns if len(columns) == 1 else ("name",)
    words = re.findall(r"[^\W_]+", text.lower())
    return [stem(w) for w in words], text.rstrip().endswith("*"), columns


def name_search(symbols: DataFrame, query: str, limit: int = 200, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score), best first: symbols (id, name, kind, path) that hold the query's stemmed words side by side in one column, by BM25 of the phrase.

    The length of a symbol is that of all three columns. Rare phrases weigh more; those in over half of all symbols hardly count. Equal scores go by id; no
    limit at 0; a query without a word finds nothing. A word shares all but two letters at most of its stem, so that only distinct words with that beginning
    go through Python.
    """
    phrase, prefix, columns = parse_query(query)
    if not phrase:
        return symbols.select("id", F.lit(0.0).alias("score")).limit(0)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), _tokens(F.col(c)).alias("words")) for c in COLUMNS])
    rows = symbols.select("id", fields.alias("fields"))
    length = F.aggregate("fields", F.lit(0), lambda acc, f: acc + F.size(f.words))
    stats = rows.agg(F.count("*").alias("n"), F.avg(length).alias("mean"))
    places = rows.select("id", length.alias("length"), F.explode("fields").alias("f")).where(F.col("f.field").isin(*columns))
    places = places.select("id", "length", "f.field", F.posexplode("f.words").alias("at", "word"))
    begins = [F.col("word").startswith(s[: max(1, len(s) - 2)]) for s in phrase]
    near = begins[0]
    for other in begins[1:]:
        near = near | other
    places = places.where(near)
    known = places.select("word").distinct().withColumn("stem", stems("word"))
    last = len(phrase) - 1
    fits = [F.when(F.col("stem").startswith(s) if prefix and k == last else F.col("stem") == s, F.lit(k)) for k, s in enumerate(phrase)]
    known = known.select("word", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("k"))
    hits = places.join(known, "word").groupBy("id", "field", "length", (F.col("at") - F.col("k")).alias("start")).agg(F.count("*").alias("found")).where(F.col("found") == len(phrase))
    hits = hits.groupBy("id", "length").agg(F.count("*").alias("tf"))
    stats = stats.join(hits.agg(F.count("*").alias("df")))  # one row each
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(1e-6)
    score = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return page(hits.join(F.broadcast(stats)).select("id", score.alias("score")), [F.desc(F.round("score", 9)), "id"], limit)
