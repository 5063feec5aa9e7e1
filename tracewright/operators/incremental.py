"""Incremental computation: definition, change and output hashes, early cutoff, cache hits, failures.

Hashes are SHA-256 in hex, or XXH3 of 128 bits where ``algorithm`` says "xxh3". An output's digest is what the caller stores for it; the canonical form of a target's
outputs is the sorted list of "type::identifier=digest".
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalars as X
from tracewright.operators.graph import levels, reachable
from tracewright.storage import new_folder, stage, unstage

_STRINGS = "array<string>"
_PLAN = "label string, level int, change_hash string, hit boolean, output_hash string"
_PLAN_COLUMNS = ("label", "level", "change_hash", "hit", "output_hash")
#: Rows of a level, at most, that are broadcast.
FEW = 5_000
NO_CACHE, ANY_PLATFORM = "no-cache", "multiplatform-cache"


def _listed(name: str) -> Column:
    return F.coalesce(name, F.array().cast(_STRINGS)) if isinstance(name, str) else name


def definition_hash(dependency_hashes: Column, platform: str, platform_tags: Sequence[str] = (), extra: Sequence[str] = (), oci_backend: str = "fs", algorithm: str = "sha256") -> Column:
    """Over a node's label, command, sorted inputs, outputs, dependency hashes and fingerprint, then extra arguments,
    the platform unless the target is cached for all, and the image backend if it makes images. No separators."""
    outputs = F.transform(F.coalesce("outputs", F.array().cast("array<struct<type: string, identifier: string>>")), X.output_text)
    has_bin = F.col("bin_output").isNotNull() & (F.coalesce(F.col("bin_output")["identifier"], F.lit("")) != "")
    outputs = F.when(has_bin, F.array_append(outputs, X.output_text(F.col("bin_output")))).otherwise(outputs)
    here = F.lit(platform + ",".join(sorted(platform_tags)))
    images = F.exists(outputs, lambda o: o.startswith("oci::"))
    parts = [
        F.col("label"), F.coalesce("command", F.lit("")), X.list_text(F.col("inputs")), X.list_text(outputs), X.list_text(dependency_hashes), X.map_text(F.col("fingerprint")), F.lit("\0".join(extra)),
        F.when(F.array_contains(_listed("tags"), ANY_PLATFORM), "").otherwise(here), F.when(images, oci_backend).otherwise(""),
    ]
    return X.text_hash(F.concat(*parts), algorithm)


def content_hashes(nodes: DataFrame, files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(label, content_hash) of the targets that have inputs: over the contents of their files in path order. Files
    that are missing don't count. ``files``: (file, content binary).

    The files of a target stand together, sorted, and one digest runs over them, so a task holds one file at a time.
    """
    from tracewright.operators.changes import input_files

    def start():
        if algorithm == "sha256":
            return hashlib.sha256()
        import xxhash

        return xxhash.xxh3_128()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, digest = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for who, content in zip(b.column(0), b.column(1), strict=True):
                if digest is None or who.as_py() != label:
                    if digest is not None:
                        done.append((label, digest.hexdigest()))
                    label, digest = who.as_py(), start()
                digest.update(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], names=["label", "content_hash"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["label", "content_hash"])

    rows = input_files(nodes).distinct().join(files.select("file", "content"), "file", "left")
    return rows.repartition("label").sortWithinPartitions("label", "file").select("label", "content").mapInArrow(run, "label string, content_hash string")


def change_hash(definition: Column, content: Column, inputs: Column) -> Column:
    """The definition's hash, with that of the contents if there are inputs."""
    return F.when(F.coalesce(F.size(inputs), F.lit(0)) > 0, F.concat_ws("_", definition, content)).otherwise(definition)


def output_hash(digests: Column, change: Column, algorithm: str = "sha256") -> Column:
    """Over the sorted digests of a target's outputs; a target without outputs has its change hash."""
    return F.when(F.coalesce(F.size(digests), F.lit(0)) <= 0, change).otherwise(X.list_hash(digests, algorithm))


def _needed(column: str) -> Column:
    """The output hash of a dependency; one that is there without a hash is an error."""
    return F.coalesce(column, F.raise_error(F.concat(F.lit("dependency "), "src", F.lit(" of "), "dst", F.lit(" has no output hash"))))


def dependency_hashes(edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """(label, hashes): the output hashes of a node's dependencies, of ``hashes`` (label, output_hash)."""
    met = edges.join(hashes.select(F.col("label").alias("src"), "output_hash"), "src")
    return met.select(F.col("dst").alias("label"), _needed("output_hash").alias("hash")).groupBy("label").agg(F.collect_list("hash").alias("hashes"))


def is_hit(cached: Column, tainted: Column, tags: Column, enabled: bool = True) -> Column:
    """A stored result counts unless the target is tainted or never cached, or caching is off."""
    return cached.isNotNull() & ~F.coalesce(tainted, F.lit(False)) & ~F.array_contains(F.coalesce(tags, F.array().cast(_STRINGS)), NO_CACHE) & F.lit(enabled)


class _Mail:
    """Rows filed by the level that reads them, in one staged folder: a level reads its own rows and no others."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema, self.path = spark, schema + ", at int", new_folder(spark, "plan-mail")
        spark.createDataFrame([], self.schema).write.partitionBy("at").parquet(self.path)

    def send(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("at").parquet(self.path)

    def of(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("at") == level).drop("at")


def _cached(results: DataFrame) -> DataFrame:
    return stage(results.groupBy("change_hash").agg(F.max("output_hash").alias("cached")), "plan-results")


def _marks(targets: DataFrame, tainted: DataFrame | None) -> DataFrame:
    return tainted.select("label").distinct().withColumn("tainted", F.lit(True)) if tainted is not None else targets.select("label", F.lit(False).alias("tainted")).limit(0)


def _prepared(targets: DataFrame, contents: DataFrame, marks: DataFrame, produced: DataFrame) -> DataFrame:
    """Targets with all that doesn't depend on other targets: content_hash, tainted and made. Joined once, not per level."""
    out = targets.join(contents.select("label", "content_hash").hint("merge"), "label", "left").join(marks.hint("merge"), "label", "left")
    return out.join(produced.select("label", F.col("output_hash").alias("made")).hint("merge"), "label", "left")


def _planned(here: DataFrame, few: bool, cached: DataFrame, platform: str, enabled: bool, options: dict) -> DataFrame:
    """The plan of prepared targets whose dependencies are known: level and ``hashes``. ``few`` of them are broadcast to the
    cached results, more are shuffled; the results never go through the driver."""
    here = here.withColumn("definition", definition_hash(F.col("hashes"), platform, **options))
    here = here.withColumn("change_hash", change_hash(F.col("definition"), F.col("content_hash"), F.col("inputs"))).select("label", "level", "change_hash", "tainted", "tags", "made")
    here = stage(here, "plan-here")
    keys = here.select("change_hash").distinct()
    known = cached.join(F.broadcast(keys) if few else keys.hint("merge"), "change_hash", "left_semi")
    here = here.join(known if few else known.hint("merge"), "change_hash", "left")
    here = here.withColumn("hit", is_hit(F.col("cached"), F.col("tainted"), F.col("tags"), enabled))
    return here.select("label", "level", "change_hash", "hit", F.when(F.col("hit"), F.col("cached")).otherwise(F.coalesce("made", "change_hash")).alias("output_hash"))


def plan_builds(nodes: DataFrame, edges: DataFrame, contents: DataFrame, results: DataFrame, produced: DataFrame, tainted: DataFrame | None = None, platform: str = "linux/amd64", enabled: bool = True, **options) -> DataFrame:
    """(label, level, change_hash, hit, output_hash) of every target, level by level.

    Dependants hash the *output* hashes of their dependencies, so an unchanged output stops a change from spreading
    (early cutoff). ``results`` (change_hash, output_hash) is the cache; ``produced`` (label, output_hash) is what an
    execution would make, null or missing for targets without outputs. Resources have no part in the hashes.

    A level sends its output hashes along its edges to the levels that need them, so each hash is read once per edge,
    however deep the graph is. What belongs to a target alone is joined to it before the levels begin; a level looks up its
    own change hashes in the cache.
    """
    targets = nodes.where("node_type = 'target'")
    ranked = stage(levels(nodes, edges), "plan-levels")
    sizes = {r[0]: r[1] for r in ranked.groupBy("level").count().collect()}  # levels only
    if not sizes:
        return nodes.sparkSession.createDataFrame([], _PLAN)
    top = max(sizes)
    prepared = _prepared(targets, contents, _marks(targets, tainted), produced)
    own = stage(prepared.join(ranked.select("label", F.col("level").cast("int").alias("level")).hint("merge"), "label"), "plan-nodes", by="level")
    ways = stage(edges.join(ranked.select(F.col("label").alias("src"), F.col("level").cast("int").alias("level")).hint("merge"), "src").join(ranked.select(F.col("label").alias("dst"), F.col("level").cast("int").alias("at")).hint("merge"), "dst"), "plan-edges", by="level")
    cached, mail = _cached(results), _Mail(nodes.sparkSession, "label string, hash string")
    done = new_folder(nodes.sparkSession, "plan")
    for level in range(top + 1):
        here = own.where(F.col("level") == level)
        if level == 0:
            here = here.withColumn("hashes", F.array().cast(_STRINGS))
        else:
            here = here.join(mail.of(level).groupBy("label").agg(F.collect_list("hash").alias("hashes")).hint("merge"), "label", "left").withColumn("hashes", _listed("hashes"))
        _planned(here, sizes.get(level, 0) <= FEW, cached, platform, enabled, options).select(*_PLAN_COLUMNS).write.parquet(f"{done}/turn={level}")
        if level < top:
            made = nodes.sparkSession.read.schema(_PLAN).parquet(f"{done}/turn={level}")
            met = ways.where(F.col("level") == level).drop("level").join(made.select(F.col("label").alias("src"), "output_hash").hint("merge"), "src")
            mail.send(met.select(F.col("dst").alias("label"), _needed("output_hash").alias("hash"), "at"))
    return nodes.sparkSession.read.schema(_PLAN + ", turn int").parquet(done).drop("turn")


def plan_delta(nodes: DataFrame, edges: DataFrame, previous: DataFrame, changed: DataFrame, contents: DataFrame, results: DataFrame, produced: DataFrame, tainted: DataFrame | None = None, ranks: DataFrame | None = None, platform: str = "linux/amd64", enabled: bool = True, **options) -> DataFrame:
    """The part of a plan that has to be made anew: (label, level, change_hash, hit, output_hash, was) of the targets
    visited, ``was`` being the output hash of the previous plan.

    ``changed`` (label) names the targets that may differ from the previous plan by themselves: by definition, contents,
    dependencies, taint or by what they would produce. From there only targets with a dependency whose output hash has
    really changed are visited, once each, in order of level; ``results`` must hold what the previous plan made. The
    levels are those of ``previous``; if edges or targets changed, give ``ranks`` (label, level) of the new graph.
    ``merged_plan`` gives the whole plan. No changed label gives no rows.

    A round joins the labels of one level with the other tables: up to FEW labels are broadcast to them, more are shuffled
    with them; no other table is broadcast. Rounds number the levels visited, not those of the graph.
    """
    spark = nodes.sparkSession
    targets = nodes.where("node_type = 'target'")
    order = (ranks if ranks is not None else previous).select("label", F.col("level").cast("int").alias("level"))
    before = previous.select("label", F.col("output_hash").alias("was"))
    cached, prepared = _cached(results), stage(_prepared(targets, contents, _marks(targets, tainted), produced).join(before.hint("merge"), "label", "left"), "plan-nodes")
    mail, done = _Mail(spark, "label string, src string, hash string"), new_folder(spark, "plan-delta")
    start = stage(changed.select("label").distinct().join(order, "label").select("label", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("hash"), F.col("level").alias("at")), "plan-changed")
    mail.send(start)
    waiting = {r[0] for r in start.select("at").distinct().collect()}  # levels only
    schema = _PLAN + ", was string"
    if not waiting:
        return spark.createDataFrame([], schema)
    while waiting:
        level = min(waiting)
        waiting.remove(level)
        sent = mail.of(level)
        at = stage(sent.select("label").distinct(), "plan-at")
        few = at.count() <= FEW
        own = (lambda rows: F.broadcast(rows)) if few else (lambda rows: rows.hint("merge"))
        needs = stage(edges.join(own(at.withColumnRenamed("label", "dst")), "dst").select("src", "dst"), "plan-needs")
        few_needs = needs.count() <= FEW
        of = needs.select("src").distinct()
        was = before.select(F.col("label").alias("src"), "was").join(F.broadcast(of) if few_needs else of.hint("merge"), "src", "left_semi").withColumn("known", F.lit(True))
        needs = needs.join(was if few_needs else was.hint("merge"), "src", "left")
        needs = needs.join(sent.where("src IS NOT NULL").select(F.col("label").alias("dst"), "src", "hash").hint("merge"), ["src", "dst"], "left").where("known OR hash IS NOT NULL")
        hashes = needs.select(F.col("dst").alias("label"), F.coalesce("hash", _needed("was")).alias("hash")).groupBy("label").agg(F.collect_list("hash").alias("hashes"))
        here = stage(prepared.join(own(at), "label"), "plan-own")
        plan = _planned(here.join(hashes.hint("merge"), "label", "left").withColumn("hashes", _listed("hashes")).withColumn("level", F.lit(level)), few, cached, platform, enabled, options)
        plan.join(here.select("label", "was").hint("merge"), "label", "left").select(*_PLAN_COLUMNS, "was").write.parquet(f"{done}/turn={level}")
        moved = stage(spark.read.schema(schema).parquet(f"{done}/turn={level}").where(~F.col("output_hash").eqNullSafe(F.col("was"))).select(F.col("label").alias("src"), F.col("output_hash").alias("hash")), "plan-moved")
        onward = stage(edges.join(F.broadcast(moved) if few else moved.hint("merge"), "src"), "plan-moved")
        users = onward.select("dst").distinct()
        place = order.withColumnRenamed("label", "dst").join(F.broadcast(users) if onward.count() <= FEW else users.hint("merge"), "dst", "left_semi")
        onward = onward.join(place.hint("merge"), "dst")
        onward = stage(onward.select(F.col("dst").alias("label"), "src", "hash", F.col("level").alias("at")), "plan-onward")
        mail.send(onward)
        waiting |= {r[0] for r in onward.select("at").distinct().collect()}
        unstage(onward)
    return spark.read.schema(schema + ", turn int").parquet(done).drop("turn")


def merged_plan(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """(label, level, change_hash, output_hash): the previous plan with the targets that ``plan_delta`` visited put in
    place of theirs."""
    kept = previous.join(delta.select("label"), "label", "left_anti")
    return kept.select("label", "level", "change_hash", "output_hash").unionByName(delta.select("label", "level", "change_hash", "output_hash"))


def taint(store: DataFrame, labels: DataFrame) -> DataFrame:
    """The taint set with further labels."""
    return store.select("label").union(labels.select("label")).distinct()


def untaint(store: DataFrame, labels: DataFrame) -> DataFrame:
    return store.select("label").join(labels.select("label"), "label", "left_anti")


def completed(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(label, is_success) of the nodes that a walk completes: what depends on a failed node is cancelled and has no
    completion; a failed node has one only if nothing it needs failed."""
    cancelled = reachable(edges, failed, "rdeps")
    ran = nodes.select("label").join(cancelled, "label", "left_anti")
    marks = failed.select("label").distinct().withColumn("failed", F.lit(True))
    return ran.join(marks, "label", "left").select("label", F.col("failed").isNull().alias("is_success"))


def completion_counts(completions: DataFrame) -> DataFrame:
    """One row: successes, cache hits among them, and errors."""
    ok = F.col("is_success")
    return completions.agg(F.count_if(ok).alias("success_count"), F.count_if(ok & (F.col("cache_result") == "CACHE_HIT")).alias("cache_hit_count"), F.count_if(~ok).alias("error_count"))


def errors(completions: DataFrame) -> DataFrame:
    """(label, err) of what failed, sorted."""
    return completions.where(~F.col("is_success") & F.col("err").isNotNull()).select("label", "err").orderBy("label")


def new_content(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """Blobs (digest, ...) whose digest is not known yet, once each: what a content-addressed write appends."""
    return blobs.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")


def latest_results(results: DataFrame, version: str) -> DataFrame:
    """The last stored result per change hash: an overwrite is an append with a higher version."""
    columns = [c for c in results.columns if c != "change_hash"]
    last = results.groupBy("change_hash").agg(F.max_by(F.struct(*columns), version).alias("last"))
    return last.select("change_hash", *[F.col(f"last.{c}").alias(c) for c in columns])


def missing_keys(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Keys of the remote store that the local one lacks: what a pull copies."""
    return remote.select("key").distinct().join(local.select("key"), "key", "left_anti")


def outputs_by_tag(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(tag, outputs): distinct outputs of all that a target depends on, by the tags of their targets."""
    starts = nodes.where(F.col("label") == label).select("label")
    near = nodes.join(reachable(edges, starts, "deps"), "label", "left_semi")
    rows = near.select(F.explode("tags").alias("tag"), "outputs").select("tag", F.explode("outputs").alias("o"))
    return rows.select("tag", X.output_text(F.col("o")).alias("output")).groupBy("tag").agg(F.array_sort(F.collect_set("output")).alias("outputs"))


def tool_paths(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(name, binary, outputs) of a target's direct dependencies, under each spelling a script may use: the full
    label, the short one, and :name within one package."""
    from tracewright.functions.labels import name_of, package_of, shortened

    deps = nodes.join(edges.where(F.col("dst") == label).select(F.col("src").alias("label")), "label", "left_semi")
    own = F.regexp_extract(F.lit(label), r"^//([^:]*)", 1)
    spelled = F.array_distinct(F.array_compact(F.array(F.col("label"), shortened(F.col("label")), F.when(package_of(F.col("label")) == own, F.concat(F.lit(":"), name_of(F.col("label")))))))
    return deps.select(F.explode(spelled).alias("name"), F.col("bin_output")["identifier"].alias("binary"), F.transform("outputs", X.output_text).alias("outputs"))
