"""Traces in files: a store of Parquet files with versions, JSON lines, OTLP documents, pruning."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.scalars import date_of
from tracewright.operators import traces as ops
from tracewright.schemas import BUILDS, NESTED, SPANS
from tracewright.sources.snapshots import _SINCE, REMOVED, File, Store
from tracewright.storage import stage, unstage

#: Files of a day, at most, for each write; files of a write's spans up to which its days may each have more.
BUILD_PARTS, SPAN_PARTS, MOST_FILES = 8, 32, 10_000
#: Bits of the filter by which a pull leaves out other traces' spans before it shuffles them (16 MB at most). A fuller one
#: lets more through to the join, which decides.
FILTER_BITS = 1 << 27


def _read(spark: SparkSession, files: list[str], schema: T.StructType, version_column: str, *more: Column) -> DataFrame:
    """These Parquet files by column name, with ``more`` columns; columns that a file lacks are null.

    ``version_column`` is what the recording tool calls the column ``tool_version``.
    """
    stored = T.StructType([T.StructField(version_column if f.name == "tool_version" else f.name, f.dataType) for f in schema])
    if not files:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*files)
    df = df.select(*df.columns, *more) if more else df
    return df.withColumnRenamed(version_column, "tool_version") if version_column in df.columns else df


def _since() -> Column:
    """The version that a row's file came with."""
    found = F.regexp_extract("_metadata.file_path", _SINCE, 1)
    return F.coalesce(F.when(found != "", found).cast("long"), F.lit(0).cast("long"))


def _table(store: Store, files: list[File], table: str, version_column: str = "tool_version", *more: Column) -> DataFrame:
    """Rows of a table but for those of traces that a later version has removed."""
    schema, path = {"builds": BUILDS, "spans": SPANS}[table], lambda f: f"{store.root}/{f.path}"
    here, lists = [f for f in files if f.table == table], [f for f in files if f.table == REMOVED]
    last = max((f.since for f in lists), default=0)
    new, old = [path(f) for f in here if f.since >= last], [path(f) for f in here if f.since < last]
    if not old:
        return _read(store.spark, new, schema, version_column, *more)
    gone = store.spark.read.schema("trace_id string").option("recursiveFileLookup", "true").parquet(*map(path, lists)).select(F.col("trace_id").alias("_gone"), _since().alias("_until"))
    gone = gone.groupBy("_gone").agg(F.max("_until").alias("_until"))
    rows = _read(store.spark, old, schema, version_column, *more, _since().alias("_since"))
    rows = rows.join(gone, (F.col("trace_id") == F.col("_gone")) & (F.col("_since") < F.col("_until")), "left_anti").drop("_since")
    return rows.unionByName(_read(store.spark, new, schema, version_column, *more)) if new else rows


def _within(files: list[File], since: str | None, until: str | None) -> list[File]:
    return [f for f in files if f.date is None or (since is None or f.date >= since) and (until is None or f.date <= until)]


def read_builds(spark: SparkSession, root: str, version_column: str = "tool_version", *, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Builds of the newest version, or of ``version``. A missing path is empty.

    ``since`` and ``until`` (dates, both included) leave out files of other days before anything is read; files without
    a day are read.
    """
    store = Store(spark, root)
    return _table(store, _within(store.files(version)[1], since, until), "builds", version_column)


def read_spans(spark: SparkSession, root: str, version_column: str = "tool_version", *, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Spans, as ``read_builds``; their day is that of their build."""
    store = Store(spark, root)
    return _table(store, _within(store.files(version)[1], since, until), "spans", version_column)


def write_traces(builds: DataFrame, spans: DataFrame, root: str) -> int:
    """Store traces under the UTC date of their start; the number of the new version.

    A trace that is there already is replaced, so writing again changes nothing. Its old rows are listed as removed; no
    file is changed, and readers see all of the write or nothing. Spans without a build in ``builds`` are left out. A
    day's rows make few files however many traces it has: spans are shuffled once, to their builds, and again by day only
    where a write has so many days that its files would be small.
    """
    store = Store(builds.sparkSession, root)
    base, files = store.files()
    day = date_of(F.col("start_time_unix_millis"))
    made = store.write(builds.withColumn("date", day), "builds", base + 1, BUILD_PARTS)
    ids = _table(store, made, "builds").groupBy("trace_id").agg(F.min(day).alias("date"))
    kept = _without(store, files, ids, base + 1)
    tasks = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = SPAN_PARTS if len({f.date for f in made}) * tasks > MOST_FILES else None
    made += store.write(spans.join(ids.hint("merge"), "trace_id"), "spans", base + 1, parts)
    return store.commit(base, kept + made)


def _without(store: Store, files: list[File], ids: DataFrame, version: int) -> list[File]:
    """Files of the same rows but for those of the traces of ``ids``: files without another trace go, and what others hold
    of ``ids`` is listed as removed. Only trace ids are read, all days at once."""
    data, kept, mixed = [f for f in files if f.table in ("builds", "spans")], [], []
    mark = lambda f: zlib.crc32(f.path.rsplit("/", 1)[-1].encode())
    for table in ("builds", "spans"):
        here = [f for f in data if f.table == table]
        if not here:
            continue
        # A file is known by the checksum of its name; files that share one go together or stay.
        rows = _table(store, files, table, "tool_version", F.crc32(F.col("_metadata.file_name").cast("binary")).alias("_file")).select("trace_id", "_file").distinct()
        each = rows.join(ids.select("trace_id", F.lit(True).alias("_hit")), "trace_id", "left").groupBy("_file").agg(F.count("_hit").alias("hits"), F.count("*").alias("traces"))
        found = {r["_file"]: (r["hits"], r["traces"]) for r in each.collect()}
        stay = [f for f in here if not f.since or (n := found.get(mark(f), (0, 0)))[0] < n[1]]
        kept += stay
        mixed += [f for f in stay if found.get(mark(f), (1, 1))[0]]
    lists = [f for f in files if f.table == REMOVED]
    if mixed:
        there = [_table(store, mixed + lists, table).select("trace_id") for table in ("builds", "spans")]
        lists = lists + store.write(ids.select("trace_id").join(there[0].union(there[1]), "trace_id", "left_semi"), REMOVED, version)
    oldest = min((f.since for f in kept), default=version)
    return [*kept, *(f for f in lists if f.since > oldest), *(f for f in files if f.table not in ("builds", "spans", REMOVED))]


def compact(spark: SparkSession, root: str) -> int:
    """Write the rows that are left of a store with removed traces anew, as one version; the number of the newest version.
    ``Store.expire`` then frees the space of the removed ones."""
    store = Store(spark, root)
    base, files = store.files()
    if not any(f.table == REMOVED for f in files):
        return base
    made, found = [], F.regexp_extract("_metadata.file_path", "/date=([^/]*)/[^/]*$", 1)
    for table, parts in (("builds", BUILD_PARTS), ("spans", SPAN_PARTS)):
        made += store.write(_table(store, files, table, "tool_version", F.when(found.rlike(r"^\d"), found).alias("date")), table, base + 1, parts)
    return store.commit(base, made + [f for f in files if f.table not in ("builds", "spans", REMOVED)])


def write_json_lines(builds: DataFrame, spans: DataFrame, path: str, compression: str = "gzip") -> None:
    """A line per build with its spans; lines are written span by span, so that a trace may have any size. The files are
    compressed, since every span repeats all names; Spark's readers know it by the files' endings. "none" leaves it out."""
    ops.json_line_pieces(builds, spans).write.option("lineSep", ops.PIECE_END).text(path, compression=compression)


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(builds, spans) out of exported JSON lines."""
    full = spark.read.schema(NESTED).json(path)
    return full.drop("spans"), full.select(F.inline("spans"))


def write_otlp(builds: DataFrame, spans: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """One resource-spans object per line, written span by span and compressed, as ``write_json_lines``."""
    ops.otlp_pieces(builds, spans, **options).write.option("lineSep", ops.PIECE_END).text(path, compression=compression)


def write_otlp_document(builds: DataFrame, spans: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """One document over all traces; its files, joined in the order of their names, are its text."""
    ops.as_otlp_document(builds, spans, **options).select("value").write.text(path, compression=compression)


def prune(spark: SparkSession, root: str, cutoff_millis: int) -> int:
    """Drop traces that started before the cutoff; the number of builds dropped.

    Files of days before the cutoff's day leave the version unread; of the rest, old traces are listed as removed.
    Readers see the store before or after it. ``compact`` and ``Store.expire`` free the space.
    """
    store = Store(spark, root)
    base, files = store.files()
    edge = spark.range(1).select(date_of(F.lit(cutoff_millis)).cast("string")).first()[0]
    ids = stage(_table(store, files, "builds").where(F.col("start_time_unix_millis") < cutoff_millis).groupBy("trace_id").agg(F.count("*").alias("n")), "pruned")
    dropped = ids.agg(F.sum("n")).first()[0] or 0
    if dropped:
        rest = [f for f in files if f.date is None or f.date >= edge]
        store.commit(base, _without(store, rest, ids, base + 1))
    unstage(ids)
    return dropped


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the traces of ``ids``, and a few others: a broadcast bitmap of hashes tells without a shuffle of the rows."""
    at = F.pmod(F.xxhash64("trace_id"), F.lit(FILTER_BITS))
    bits = ids.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).repartition("_bucket")
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, (F.bitmap_bit_position(at) % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(at) == F.col("_bucket")) & there, "left_semi")


def pull(spark: SparkSession, remote: str, local: str) -> int:
    """Copy the traces that the local store lacks, as one version; the number of builds copied. Spans of other traces are
    left out where they are read, but for a few, and not shuffled."""
    theirs, ours = read_builds(spark, remote), read_builds(spark, local)
    fresh = stage(theirs.join(ours.select("trace_id"), "trace_id", "left_anti"), "pulled")
    n = fresh.count()
    if n:
        write_traces(fresh, _likely(read_spans(spark, remote), fresh), local)
    unstage(fresh)
    return n
