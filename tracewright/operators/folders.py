"""Digests of output folders: every folder has one that follows from its entries alone, so a changed byte changes the
folders above it and no others.

Files are rows (root, path, kind, digest, size, executable, target): ``root`` names the tree, ``path`` is relative to it,
``kind`` is "file", "link" (then ``target`` counts instead of a digest) or "dir" (needed only for folders without
entries). The canonical form of a folder is one text per entry, kind, digest, size and executable bit of a file, and
name, separated by blanks; texts are dealt by the first two hex digits of their SHA-256, sorted and hashed within each of
these 256 parts, and the folder's digest is that of its parts in order. So a row holds a 256th of a folder's entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import clean_path
from tracewright.storage import new_folder

_LEVEL = "root string, folder string, digest string, files long, bytes long"


def files_of(contents: DataFrame, root: Column, executable: Column | None = None) -> DataFrame:
    """File rows out of ``sources.files.contents`` (file, content): digests of whole files, each hashed once."""
    run = F.lit(False) if executable is None else executable
    return contents.select(
        root.alias("root"), F.col("file").alias("path"), F.lit("file").alias("kind"), F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size"),
        run.alias("executable"), F.lit(None).cast("string").alias("target"),
    )


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/"))).cast("int")


def folder_digests(files: DataFrame) -> DataFrame:
    """(root, folder, digest, files, bytes) of every folder, the root's own path being empty; files and bytes count all
    below it.

    A folder's digest needs those of the folders in it, so levels are folded from the deepest one up; each level reads
    only its own entries (the table is staged by depth) and the digests of the level below. Repeated rows count once;
    paths are cleaned; null sizes are 0, a null path is the root. One path with two unlike rows is an error. An empty
    table has no folders.
    """
    path = clean_path(F.coalesce("path", F.lit("")))
    rows = files.select("root", F.when(path.isin(".", "/"), "").otherwise(path).alias("path"), "kind", "digest", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.coalesce("executable", F.lit(False)).alias("executable"), "target")
    is_dir = F.col("kind") == "dir"
    entry = F.when(F.col("kind") == "link", F.concat_ws(" ", F.lit("link"), F.sha2(F.coalesce("target", F.lit("")), 256), _name(F.col("path"))))
    entry = entry.when(~is_dir, F.concat_ws(" ", F.lit("file"), F.coalesce("digest", F.raise_error(F.concat(F.lit("no digest for "), "path"))), "size", F.when(F.col("executable"), "x").otherwise("-"), _name(F.col("path"))))
    spare = rows.select(
        "root", F.when(is_dir, F.col("path")).otherwise(_parent(F.col("path"))).alias("folder"), F.when(~is_dir, _name(F.col("path"))).alias("name"), entry.alias("entry"),
        (F.col("kind") == "file").cast("long").alias("files"), F.when(F.col("kind") == "file", F.col("size")).otherwise(0).cast("long").alias("bytes"),
    ).distinct().withColumn("depth", _depth(F.col("folder")))
    spark = files.sparkSession
    at = new_folder(spark, "folder-entries")
    spare.write.partitionBy("depth").parquet(at)
    entries = spark.read.schema(spare.schema).parquet(at)
    deepest = entries.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], _LEVEL)
    folded, below = new_folder(spark, "folder-digests"), None
    for depth in range(deepest, -1, -1):
        here = entries.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            here = here.unionByName(below.select("root", _parent(F.col("folder")).alias("folder"), _name(F.col("folder")).alias("name"), F.concat_ws(" ", F.lit("dir"), "digest", _name(F.col("folder"))).alias("entry"), "files", "bytes"))
        _fold(here).write.parquet(f"{folded}/depth={depth}")
        below = spark.read.schema(_LEVEL).parquet(f"{folded}/depth={depth}")
    return spark.read.schema(_LEVEL + ", depth int").parquet(folded).drop("depth")


def _fold(entries: DataFrame) -> DataFrame:
    """Folders out of their entries; a folder that has none has the digest of an empty text."""
    twice = F.raise_error(F.concat(F.lit("two unlike entries for "), "folder", F.lit("/"), "name"))
    part = F.substring(F.sha2("name", 256), 1, 2)
    parts = entries.groupBy("root", "folder", F.coalesce(part, F.lit("")).alias("part")).agg(
        F.array_sort(F.collect_list("entry")).alias("texts"), F.countDistinct("name").alias("names"), F.count("name").alias("n"), F.first("name").alias("name"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
    )
    digest = F.when(F.col("names") != F.col("n"), twice).when(F.col("n") > 0, F.sha2(F.array_join("texts", "\n"), 256))
    parts = parts.select("root", "folder", F.struct("part", digest.alias("digest")).alias("p"), "files", "bytes")
    listed = F.array_compact(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["digest"]))
    return parts.groupBy("root", "folder").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(root, folder, change): folders that were added, removed or whose digest changed, of two results of
    ``folder_digests``."""
    was, now = before.select("root", "folder", F.col("digest").alias("was")), after.select("root", "folder", F.col("digest").alias("now"))
    both = was.join(now, ["root", "folder"], "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("root", "folder", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def output_digests(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """(label, type, identifier, digest) of the file and folder outputs (label, type "file" or "dir", path, identifier) of
    targets, from what lies in the workspace; ``files``: file rows, whose root is ignored. An output that isn't there is
    an error.

    Files meet the folders that hold them by their exploded parents, in an equi-join; each output folder is then a tree
    of its own, whose digest doesn't depend on where it lies.
    """
    asked = outputs.select("label", "type", "identifier", clean_path(F.col("path")).alias("at")).distinct()
    found = files.withColumn("path", clean_path(F.col("path"))).distinct()
    plain = asked.where("type = 'file'").join(found.where("kind = 'file'").select(F.col("path").alias("at"), "digest"), "at", "left").select("label", "type", "identifier", "at", "digest")
    folders = asked.where("type = 'dir'")
    cuts = F.split("path", "/")
    ends = F.when(F.col("kind") == "dir", F.size(cuts)).otherwise(F.size(cuts) - 1)
    above = F.transform(F.sequence(F.lit(0), ends), lambda k: F.when(k == 0, ".").otherwise(F.array_join(F.slice(cuts, F.lit(1), k), "/")))
    under = found.select("*", F.explode(above).alias("at")).join(folders.select("at").distinct(), "at")
    rest = F.when(F.col("at") == ".", F.col("path")).otherwise(F.expr("substring(path, length(at) + 2)"))
    trees = folder_digests(under.select(F.col("at").alias("root"), rest.alias("path"), "kind", "digest", "size", "executable", "target")).where("folder = ''")
    whole = folders.join(trees.select(F.col("root").alias("at"), "digest"), "at", "left").select("label", "type", "identifier", "at", "digest")
    missing = F.raise_error(F.concat(F.lit("output "), "at", F.lit(" of "), "label", F.lit(" is not there")))
    return plain.unionByName(whole).select("label", "type", "identifier", F.coalesce("digest", missing).alias("digest"))


def no_cache_hashes(nodes: DataFrame, files: DataFrame, types: Sequence[str] = ("file", "dir")) -> DataFrame:
    """(label, output_hash) of the targets that are never cached: over the digests of what lies in the workspace. Targets
    without outputs have no row, since they take their change hash; other types of output are left to the caller."""
    from tracewright.operators.incremental import NO_CACHE, output_hash

    mine = nodes.where("node_type = 'target'").where(F.array_contains("tags", NO_CACHE))
    listed = F.coalesce("outputs", F.array().cast("array<struct<type: string, identifier: string>>"))
    own = F.col("bin_output")
    listed = F.when(own.isNotNull() & (F.coalesce(own["identifier"], F.lit("")) != ""), F.array_append(listed, F.struct(own["type"].alias("type"), own["identifier"].alias("identifier")))).otherwise(listed)
    rows = mine.select("label", "package", F.explode(listed).alias("o")).where(F.col("o")["type"].isin(*types))
    at = F.concat_ws("/", F.when(F.col("package") != "", F.col("package")), F.col("o")["identifier"])
    digests = output_digests(rows.select("label", F.col("o")["type"].alias("type"), F.col("o")["identifier"].alias("identifier"), at.alias("path")), files)
    return digests.groupBy("label").agg(output_hash(F.collect_list("digest"), F.lit(None).cast("string")).alias("output_hash"))
