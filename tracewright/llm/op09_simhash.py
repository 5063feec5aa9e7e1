"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, so that of two fingerprints which differ in at most two (or three) bits
one segment differs in at most one. Each segment is indexed 32 times, each time with another bit wiped out: segments
with at most one differing bit agree in one of these variants. Equal variants meet in a shuffle, pairs are verified on
the whole fingerprint.

Only distinct fingerprints are indexed; copies follow by membership. A variant that many fingerprints share is not
expanded into pairs: there, each fingerprint is filed under itself and its 64 one-bit neighbours. Two fingerprints
have a neighbour in common exactly if they differ in at most two bits, so a star per neighbour links them all.

Edited copies (0.8 of their five-word shingles in common) differ in more bits than two segments can bear;
``similarity.similar_links`` finds them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import attach_groups, stage, unstage
from tracewright.llm.components import connected_components
from tracewright.llm.op03_exact_dedup import one_each
from tracewright.llm.similarity import SIMILARITY, bounded, similar_links, text_key

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of one variant that are paired directly; larger variants go by common neighbours.
PAIRED = 32
_CHUNK = 1 << 16


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle, repeats included, in chunks; nothing without words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    for at in range(0, max(1, len(words) - shingle + 1) if words else 0, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        yield np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)


def _ones(digests: np.ndarray) -> np.ndarray:
    return np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of word shingles, repeats included; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for digests in _hashes(text, shingle):
        n += len(digests)
        ones += _ones(digests)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): 2 segments x 32 wiped bits. The key holds segment, bit and what is left."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))

    def keys(segment: Column, which: int) -> list[Column]:
        tag = [(which * 32 + bit) << 32 for bit in range(32)]
        return [segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit(tag[bit])) for bit in range(32)]

    return fps.select(F.explode(F.array(*keys(high, 0), *keys(low, 1))).alias("key"), "fp")


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Distinct (fp) -> edges (a, b) whose components are those of all pairs within ``max_bits`` (at most 2)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments and common one-bit neighbours cover up to 2 differing bits")
    # Keys are counted first, so that no task holds all fingerprints of one.
    filed = variants(fps)
    counts = stage(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    met = stage(filed.join(bounded(counts), "key"), "simhash-met")
    close = differing("a", "b") <= max_bits
    some = met.where(F.col("n") <= paired)
    pairs = some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where("a < b").where(close).select("a", "b")
    return pairs.unionByName(_stars(met.where(F.col("n") > paired).select("fp").distinct(), max_bits)).distinct()


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links among these fingerprints without pairs: all that share a neighbour link to the least of them."""
    if max_bits < 2:  # a pair one bit apart shares the variant of that bit
        flips = [F.col("fp").bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1)) for k in range(64)] if max_bits else [F.col("fp")]
        near = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("z")) for k, x in enumerate(flips)])
    else:
        flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]
        near = F.array(*[F.struct(F.lit(0).alias("k"), x.alias("z")) for x in flips])
    filed = fps.select(F.explode(near).alias("s"), "fp").select("s.k", "s.z", "fp")
    least = filed.groupBy("k", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return filed.join(least.select("k", "z", "a"), ["k", "z"]).where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, paired: int = PAIRED, similarity: float | None = None, **options) -> DataFrame:
    """One row per input row: doc_id, text_key, fingerprint (16 hex digits), component_id, component_size, root.

    Documents link if their fingerprints differ in at most ``max_bits``, and with ``similarity`` also if they have
    that part of their five-word shingles in common; component_id is the smallest doc_id that can be reached. Texts
    that are null or have no word get fingerprint 0 and link like any other; shorter ones than a shingle count as one.
    Repeated rows each give a row; null ids stay null and count for component_id only if no other is there. An empty
    table gives no rows; other columns are ignored.
    """
    rows = stage(fingerprints(docs, shingle), "simhash-rows")
    total = rows.count()
    owners = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-owners")
    edges = links(owners.select("fp"), max_bits, paired)
    if similarity is not None:
        edges = stage(edges, "simhash-links")
        alike = similar_links(docs, similarity, **options)
        prints = stage(rows.groupBy(F.col("text_key").alias("node")).agg(F.first("fp").alias("fp")), "simhash-prints")
        own = lambda end: prints.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}"))
        alike = alike.join(own("a"), "a").join(own("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
        edges = edges.unionByName(alike.where("a <> b").distinct())
    labels = connected_components(edges)
    joined = owners.join(labels, owners["fp"] == labels["node"], "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    joined = stage(joined, "simhash-classes")
    roots = joined.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("component_size"))
    classes = joined.select("fp", F.col("root").alias("_root"), "copies").join(roots, F.col("_root") == F.col("root"))
    classes = stage(classes.select("fp", "copies", "component_id", "component_size", "root"), "simhash-roots")
    out = attach_groups(rows, classes, "fp", "copies", total)
    return out.select("doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size", "root")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id, null last. By default
    edited copies of ``SIMILARITY`` count too."""
    rows = near_duplicates(docs, **{"similarity": SIMILARITY} | options)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("m"))
    kept = stage(first.select("m.doc_id", "m.text_key").distinct(), "simhash-kept")
    return one_each(docs, kept, text_key(F.col("text")))
