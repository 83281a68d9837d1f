"""Code-graph tables read out of the given synthetic tables, and the same as SQL.

documents stand for files, their lines for symbols, labels for exports; order lines for commits and
blame; parts, suppliers, nations and regions for a layered import graph; events for histories.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import shared_folder
from cairn.operators import history, text_index


_indexes: dict[tuple[str, str], str] = {}


class Tables:
    """The tables of one folder; each is built where it is first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _docs(self) -> DataFrame:
        labels = self.raw("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        return self.raw("documents").join(labels, "doc_id", "left").withColumn("is_exported", F.coalesce(F.col("quality") == 1, F.lit(False)))

    @cached_property
    def files(self) -> DataFrame:
        path = F.concat(F.when(F.col("lang") == "fr", "tests/").otherwise("src/"), "source", F.lit("/f"), "doc_id", F.lit("."), "lang")
        lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        return self._docs.select(
            F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("language"), "source", F.octet_length("text").cast("long").alias("size_bytes"), lines.cast("long").alias("line_count"),
            (F.lit(1.0) / (F.col("doc_id") + 1)).alias("pagerank"), (F.col("n_chars") % 50).alias("change_count"), "is_exported",
        )

    @cached_property
    def symbols(self) -> DataFrame:
        rows = self._docs.select("doc_id", "source", "is_exported", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        kind = F.element_at(F.array(*map(F.lit, ["function", "method", "class", "variable"])), F.col("pos") % 4 + 1)
        rows = rows.withColumn("kind", kind).withColumn("name", F.regexp_extract("line", "^([A-Za-z]+)", 1))
        commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
        start = F.col("pos") * 3 + 1
        return rows.select(
            (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.col("doc_id").alias("file_id"), "name", "kind", start.alias("line_start"), (start + F.floor(F.octet_length("line") / 40)).alias("line_end"),
            F.concat("name", F.lit("("), F.when(F.col("kind") == "method", "self, ").otherwise(""), "line", F.lit(")")).alias("signature"), "is_exported", (F.col("pos") % 10 == 9).alias("unused_excluded"),
            (F.lit(1.0) / (F.col("doc_id") + F.col("pos") + 1)).alias("pagerank"), F.when(F.col("kind").isin("function", "method"), commas + 1).cast("long").alias("complexity"),
            F.when(F.col("kind") == "method", F.col("source")).alias("owner_type"), "pos", F.lit(None).cast("string").alias("shape_hash"),
        )

    @cached_property
    def refs(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ["call", "use", "type"])), F.col("pos") % 3 + 1)
        known = self.symbols.select(F.col("id").alias("to_symbol_id"))
        target = (F.col("file_id") + F.col("pos") + 1) * 100000 + F.floor(F.col("pos") / 4) % 4
        rows = self.symbols.select(F.col("id").alias("from_symbol_id"), target.alias("to_symbol_id"), kind.alias("kind"))
        return rows.join(known, "to_symbol_id", "left_semi")

    @cached_property
    def edges(self) -> DataFrame:
        return self.refs.select(F.floor(F.col("from_symbol_id") / 100000).alias("from_file"), F.floor(F.col("to_symbol_id") / 100000).alias("to_file")).distinct()

    @cached_property
    def bodies(self) -> DataFrame:
        lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
        return self.raw("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), F.lit(1).cast("long").alias("line_start"), lines.alias("line_end"), F.explode(F.array(X.shape(F.col("text")))).alias("shape_hash"))

    @property
    def text_index(self) -> str:
        """The folder of the stored index of all documents, built once for a running application."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _indexes:
            folder = f"{shared_folder(self.spark)}/text-index-{uuid.uuid4().hex}"
            text_index.build(self.raw("documents").select(F.col("doc_id").alias("id"), "text"), folder)
            _indexes[key] = folder
        return _indexes[key]

    @cached_property
    def commits(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))

    @cached_property
    def file_pairs(self) -> DataFrame:
        rows = self.raw("documents").select(F.floor(F.col("n_chars") / 10).alias("commit_id"), F.col("doc_id").alias("file"))
        return history.co_change_pairs(rows)

    @cached_property
    def hunks(self) -> DataFrame:
        line = self.raw("lineitem")
        return line.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), F.col("l_quantity").cast("long").alias("lines"), F.col("l_shipdate").alias("time"), F.col("l_orderkey").alias("commit"))

    @cached_property
    def layers(self) -> DataFrame:
        """(src, dst): part to supplier to nation to region; ids end in 1 to 4."""
        line, supplier, nation = self.raw("lineitem"), self.raw("supplier"), self.raw("nation")
        a = line.select((F.col("l_partkey") * 10 + 1).alias("src"), (F.col("l_suppkey") * 10 + 2).alias("dst")).distinct()
        b = supplier.select((F.col("s_suppkey") * 10 + 2).alias("src"), (F.col("s_nationkey").cast("long") * 10 + 3).alias("dst"))
        c = nation.select((F.col("n_nationkey").cast("long") * 10 + 3).alias("src"), (F.col("n_regionkey").cast("long") * 10 + 4).alias("dst"))
        return a.union(b).union(c)

    @cached_property
    def steps(self) -> DataFrame:
        """(src, dst): a part and the next one in its order, as often as orders have it."""
        after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        return self.raw("lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null and src <> dst")

    @cached_property
    def chain(self) -> DataFrame:
        """(src, dst): a part and the next one in its order; cyclic."""
        return self.steps.distinct()

    @cached_property
    def points(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("series"), F.struct("ts", "event_id").alias("seq"), "event_id", "value")


SHAPE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '"[^"\n]*"', '_', 'g'), '[\p{N}][\p{N}_.]*[a-zA-Z]*|[\p{L}_][\p{L}\p{N}_]*', '_', 'g'), '[ \t\n\r]+', ' ', 'g'))"""

#: The same tables as common table expressions.
SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT d.*, coalesce(q.quality = 1, false) AS is_exported FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id)
), files AS (
  SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN 'tests/' ELSE 'src/' END || source || '/f' || doc_id || '.' || lang AS path, lang AS language, source, strlen(text) AS size_bytes,
         length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, 1.0::DOUBLE / (doc_id + 1) AS pagerank, n_chars % 50 AS change_count, is_exported FROM docs
), lines AS (
  SELECT doc_id, source, is_exported, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs
), symbols AS (
  SELECT doc_id * 100000 + pos AS id, doc_id AS file_id, regexp_extract(line, '^([A-Za-z]+)', 1) AS name, ['function', 'method', 'class', 'variable'][pos % 4 + 1] AS kind,
         pos * 3 + 1 AS line_start, pos * 3 + 1 + strlen(line) // 40 AS line_end, is_exported, pos % 10 = 9 AS unused_excluded, 1.0::DOUBLE / (doc_id + pos + 1) AS pagerank,
         CASE WHEN pos % 4 < 2 THEN length(line) - length(replace(line, ',', '')) + 1 END AS complexity, CASE WHEN pos % 4 = 1 THEN source END AS owner_type, pos FROM lines
), refs AS (
  SELECT id AS from_symbol_id, (file_id + pos + 1) * 100000 + pos // 4 % 4 AS to_symbol_id, ['call', 'use', 'type'][pos % 3 + 1] AS kind FROM symbols
  WHERE (file_id + pos + 1) * 100000 + pos // 4 % 4 IN (SELECT id FROM symbols)
), edges AS (SELECT DISTINCT from_symbol_id // 100000 AS from_file, to_symbol_id // 100000 AS to_file FROM refs
), bodies AS (
  SELECT doc_id AS id, doc_id AS file_id, 1 AS line_start, length(text) - length(replace(text, chr(10), '')) + 1 AS line_end,
         CASE WHEN length(text) - length(replace(text, chr(10), '')) + 1 >= 3 AND strlen({SHAPE_SQL}) >= 10 THEN md5({SHAPE_SQL}) END AS shape_hash FROM documents
), cc AS (SELECT max(complexity) AS max_cc, avg(complexity) AS avg_cc, file_id FROM symbols WHERE complexity IS NOT NULL GROUP BY file_id
), doc_commits AS (SELECT n_chars // 10 AS commit_id, doc_id AS file, count(*) OVER (PARTITION BY n_chars // 10) AS n FROM documents
), file_pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM doc_commits a JOIN doc_commits b ON a.commit_id = b.commit_id AND a.file < b.file WHERE a.n BETWEEN 2 AND 20 GROUP BY 1, 2
), pairs2 AS (SELECT file_a AS id, file_b AS partner, count FROM file_pairs UNION ALL SELECT file_b, file_a, count FROM file_pairs
), commits AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem
), layers AS (
  SELECT DISTINCT l_partkey * 10 + 1 AS src, l_suppkey * 10 + 2 AS dst FROM lineitem UNION ALL SELECT s_suppkey * 10 + 2, s_nationkey * 10 + 3 FROM supplier
  UNION ALL SELECT n_nationkey * 10 + 3, n_regionkey * 10 + 4 FROM nation
), chain AS (
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst
)
"""
