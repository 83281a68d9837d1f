"""Directories that groups of files share: longest common ones, modal ones, labels, boundary rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.operators.scores import suggest_boundaries


def common_directories(files: DataFrame) -> DataFrame:
    """(group, directory): the longest directory that all files (group, path) of a group lie in; null if none.

    What all lists of names begin with is what the least and the greatest of them begin with, so a group folds to two lists, in any order of merging.
    """
    names = F.split("path", "/")
    rows = files.select("group", F.slice(names, 1, F.size(names) - 1).alias("names"))
    ends = rows.groupBy("group").agg(F.min("names").alias("lo"), F.max("names").alias("hi"))
    differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int")
    return ends.select("group", F.when(shared > 0, F.array_join(F.slice("lo", 1, shared), "/")).alias("directory"))


def modal_directories(files: DataFrame, least: float = 0.3) -> DataFrame:
    """(group, directory, share): the first two names that most files of a group begin with, ties to the least, if this share of all its files has them."""
    names = F.split("path", "/")
    rows = files.withColumn("directory", F.when(F.size(names) >= 3, F.concat_ws("/", names[0], names[1])))
    counts = rows.groupBy("group", "directory").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("directory").isNotNull(), F.struct((-F.col("n")).alias("less"), "directory", "n")))
    best = counts.groupBy("group").agg(best.alias("best"), F.sum("n").alias("all"))
    return best.where(F.col("best.n") * 10 >= F.col("all") * least * 10).select("group", "best.directory", (F.col("best.n") / F.col("all")).alias("share"))


def path_stem(path: Column) -> Column:
    """The file name without its ending; `mod` files are named by their directory."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(path, r"\.[^.]*$", ""), "(/mod)+$", ""), "/", -1)


def group_labels(files: DataFrame) -> DataFrame:
    """(group, rank, label), over files (group, path, pagerank): a common directory of two names or more, else a modal one, else the stem of the most important file.

    Of groups with one label, the one with the greatest sum of ranks keeps it. Another adds the stem of its most important file that says more than the label, or, where
    an earlier group has that, too, or no stem does, its own name.
    """
    top = files.groupBy("group").agg(F.sum("pagerank").alias("rank"), F.min_by("path", F.struct(-F.col("pagerank"), "path")).alias("top"))
    rows = top.join(common_directories(files), "group", "left").join(modal_directories(files).select("group", F.col("directory").alias("modal")), "group", "left")
    rows = rows.withColumn("base", F.coalesce(F.when(F.size(F.split("directory", "/")) >= 2, F.col("directory")), "modal", path_stem(F.col("top")))).select("group", "rank", "base")
    place = F.struct(-F.col("rank"), "group")
    rows = rows.withColumn("first", F.row_number().over(W.partitionBy("base").orderBy(-F.col("rank"), "group")) == 1).withColumn("place", place)
    stems = files.join(rows.where("not first").select("group", "base"), "group").withColumn("stem", path_stem(F.col("path")))
    stems = stems.where((F.col("stem") != "") & (F.col("stem") != F.col("base")) & (F.col("stem") != F.substring_index("base", "/", -1)))
    stems = stems.groupBy("group").agg(F.min_by("stem", F.struct(-F.col("pagerank"), "path")).alias("stem"))
    rows = rows.join(stems, "group", "left").withColumn("longer", F.concat("base", F.lit("-"), "stem"))
    claims = rows.where("first").select(F.col("base").alias("label"), "place").unionByName(rows.where("longer is not null").select(F.col("longer").alias("label"), "place"))
    claims = claims.groupBy("label").agg(F.min("place").alias("holder"))
    rows = rows.join(claims.select(F.col("label").alias("longer"), "holder"), "longer", "left")
    own = F.concat("base", F.lit("-"), F.col("group").cast("string"))
    return rows.select("group", "rank", F.when(F.col("first"), F.col("base")).when(F.col("holder") == F.col("place"), F.col("longer")).otherwise(own).alias("label"))


def suggested_rules(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, deny): one rule for each directory of two names or more that is common to a group of files (id, group, path), denying the directories of groups to which none of its edges lead."""
    found = common_directories(files).where(F.size(F.split("directory", "/")) >= 2)
    groups = files.join(found.select("group"), "group", "left_semi").select("id", "group")
    a, b = found.select(F.col("group").alias("from_group"), F.col("directory").alias("a")), found.select(F.col("group").alias("to_group"), F.col("directory").alias("b"))
    pairs = suggest_boundaries(edges, groups).join(a, "from_group").join(b, "to_group").where("a <> b").select("a", "b").distinct()
    glob = lambda c: F.concat(c, F.lit("/**"))
    return pairs.groupBy(glob("a").alias("from")).agg(F.sort_array(F.collect_list(glob("b"))).alias("deny"))
