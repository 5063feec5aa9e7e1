"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names and units turn into typed placeholders, other words lose case and
punctuation. Windows of five tokens of the documents are hash-joined with those of the benchmark. Windows that match at
one alignment must fill the item's slots consistently (an equal value in the item always meets an equal one in the
document): each value of the item takes its most frequent filling, and windows that contradict it don't count. So a
question with other numbers or names is found and a chance resemblance is not. An item has leaked into a document if
consistent alignments cover enough of its windows.

Items without such a window, because they are short or hardly have literal words, are looked for whole: as the same
words in a row, or, with one or two words only, as the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import free, stage

WINDOW = 5
#: Literal words that a window needs: placeholders alone say nothing.
LITERALS = 2
#: Part of an item's windows that a document must cover.
COVERAGE = 0.5
#: Words from which an item that is looked for whole may stand within a document.
WITHIN = 3
#: Bits for each benchmark window in the bitmap by which documents drop other windows before the join, and bits at most (16 MB).
#: A full bitmap lets more windows through to the join, which decides.
BITS, MOST_BITS = 64, 1 << 27
#: Rows of windows that a task holds at a time.
ROWS = 50_000

NUMBER, UNIT, NAME = 1, 2, 3
#: Words that are units.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph km/h m/s hz khz mhz ghz w kw mw v kv j kj cal kcal bit bits byte bytes kb mb gb tb "
    "usd eur gbp dollar dollars cent cents euro euros percent degree degrees % $ €".split()
)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—¿¡"
_NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:[a-zA-Zµ°]{1,3}|%|€)?$")
_STOPS = (".", "!", "?", ":")
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 3) | 1) & (1 << 64) - 1 for k in range(64)], np.uint64)
_MEMO = 1 << 20


class Tokens(dict):
    """Word -> code: token id shifted by two bits, bit 0 for a capital that may be a name, bit 1 for a sentence end. Id 0
    (nothing but punctuation) fits no window."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        bare = word.strip(_EDGE)
        low = bare.lower()
        ends = 2 * word.rstrip("\"')”’»").endswith(_STOPS)
        capital = 0
        if _NUMBER.match(bare):
            ident = NUMBER
        elif low in UNITS:
            ident = UNIT
        else:
            ident = (xxhash.xxh64_intdigest(low) >> 4) | 8 if low else 0
            capital = int(bare[:1].isupper())
        code = self[word] = ident << 2 | ends | capital
        return code


def windows(words: list[str], tokens: Tokens, size: int = WINDOW, literals: int = LITERALS, among: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, hashes, token ids) of the windows (those in the bitmap ``among``, if given), in two readings:
    capitals within a sentence as names, then as plain words wherever that makes a difference. So a passage that has
    lost its case or its punctuation is found too."""
    codes = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    starts = np.ones(len(words), bool)
    starts[1:] = codes[:-1] & 2 > 0
    low = codes >> 2
    names = (codes & 1 > 0) & ~starts
    ids = np.where(names, NAME, low)
    n = len(words) - size + 1
    if n <= 0:
        return []
    out = [_hashed(ids, np.ones(n, bool), size, literals, among)]
    if names.any():
        some = np.cumsum(np.r_[0, names])
        out.append(_hashed(low, some[size:] - some[:-size] > 0, size, literals, among))
    return out


def _hashed(ids: np.ndarray, wanted: np.ndarray, size: int, literals: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain, fits = np.cumsum(np.r_[0, ids > NAME]), np.cumsum(np.r_[0, ids != 0])
    at = np.flatnonzero(wanted & (fits[size:] - fits[:-size] == size) & (plain[size:] - plain[:-size] >= literals))
    h = np.zeros(len(at), np.uint64)
    unsigned = ids.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = unsigned[at + k] * _ODD[k]
            h += x ^ (x >> np.uint64(31))
    if among is not None and len(at):
        hit = _in(among, h)
        at, h = at[hit], h[hit]
    return at, h, ids


def _in(among: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    bit = (h >> np.uint64(5)) & np.uint64(8 * len(among) - 1)
    return among[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap with the bits of these hashes; ``bits`` is a power of two."""
    out = np.zeros(bits >> 3, np.uint8)
    bit = (hashes >> np.uint64(5)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    return out


def whole_hash(bare: list[str]) -> int:
    """Hash of a sequence of words without case and outer punctuation; it shares no value's meaning with a window's."""
    return xxhash.xxh64_intdigest("\0".join(bare), len(bare) + 1)


def whole_matches(words: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all sequences of these numbers of words; of fewer than ``WITHIN`` only the whole text."""
    bare = [b for w in words if (b := w.strip(_EDGE).lower())]
    at = [(k, whole_hash(bare[k : k + size])) for size in sizes for k in range(len(bare) - size + 1) if size >= WITHIN or size == len(bare)]
    return np.array([k for k, _ in at], np.int64), np.array([h for _, h in at], np.uint64)


def _slots(words: list[str], ids: np.ndarray, at: int, size: int) -> list[str]:
    return [words[k].strip(_EDGE).lower() for k in range(at, at + size) if ids[k] <= NAME]


_WINDOWS = {"id": pa.int64(), "text_key": pa.int64(), "at": pa.int64(), "window": pa.int64(), "slots": pa.list_(pa.string()), "n": pa.int64()}


def window_rows(df: DataFrame, ident: str, size: int, literals: int, index: tuple[np.ndarray, list[int]] | None = None) -> DataFrame:
    """(ident, text) -> one row per window and reading: ident, text_key, at, window, slots, n (positions with one).

    Without ``index`` the texts are items, and one without a window gives a row for its whole sequence of words.
    ``index``: bitmap of the windows that are wanted, and numbers of words of the items that are looked for whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, sizes = shared.value or (None, [])
        tokens = Tokens()
        for b in batches:
            rows: list[tuple] = []
            batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_WINDOWS), _WINDOWS.values(), strict=True)], names=list(_WINDOWS))
            for who, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py() or ""
                words = text.split()
                read = [r for r in windows(words, tokens, size, literals, among) if len(r[0])]
                n = len(set().union(*(at.tolist() for at, _, _ in read)))
                if among is None and not n:
                    bare = [x for w in words if (x := w.strip(_EDGE).lower())]
                    read = [(np.zeros(1, np.int64), np.array([whole_hash(bare)], np.uint64), None)] if bare else []
                    n = len(bare)  # its rows have no n windows, but n words
                elif sizes:
                    at, h = whole_matches(words, sizes)
                    hit = _in(among, h) if len(h) else np.zeros(0, bool)
                    read.append((at[hit], h[hit], None))
                key = int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True) if read else 0
                for at, h, ids in read:
                    for p, window in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        rows.append((who.as_py(), key, p, window, None if ids is None else _slots(words, ids, p, size), n))
                        if len(rows) >= ROWS:
                            yield batch()
                            rows = []
            yield batch()

    picked = df.select(F.col(ident).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, text_key long, at long, window long, slots array<string>, n long")


def text_key(text):
    """The key that ``window_rows`` gives a text, as a Column."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _index(bench: DataFrame, most_bits: int) -> tuple[np.ndarray, list[int]] | None:
    """Bitmap of the benchmark's windows, of a bounded size, and the numbers of words of the items that are looked for
    whole; None without windows. Tasks make bitmaps of their own, which the driver joins."""
    n = bench.count()
    if not n:
        return None
    bits = min(most_bits, max(1 << 10, 1 << (BITS * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            out |= bitmap(b.column(0).to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    among = np.zeros(bits >> 3, np.uint8)
    for row in bench.select("window").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        among |= np.frombuffer(row[0], np.uint8)
    return among, sorted(r[0] for r in bench.where("slots IS NULL").select("n").distinct().collect())


def _consistent(runs: DataFrame) -> DataFrame:
    """Runs with met: array of (item_at, pairs of item's and document's values) -> with ``places`` of the windows that
    agree with the most frequent filling of each value (of equal ones the smallest), and ``other``: a value differs."""
    flat = F.flatten(F.transform("met", lambda w: w["pairs"]))
    runs = runs.withColumn("flat", flat).withColumn("given", F.array_distinct(F.transform("flat", lambda p: p["item"])))

    def filling(value: Column) -> Column:
        held = F.transform(F.filter("flat", lambda p: p["item"] == value), lambda p: p["doc"])
        ranked = F.transform(F.array_distinct(held), lambda d: F.struct((-F.size(F.filter(held, lambda x: x == d))).alias("minus"), d.alias("doc")))
        return F.array_min(ranked)["doc"]

    runs = runs.withColumn("chosen", F.map_from_arrays("given", F.transform("given", filling)))
    good = F.filter("met", lambda w: F.forall(w["pairs"], lambda p: F.element_at(F.col("chosen"), p["item"]) == p["doc"]))
    runs = runs.withColumn("good", good).where(F.size("good") > 0)
    return runs.withColumns({"places": F.array_distinct(F.transform("good", lambda w: w["item_at"])), "other": F.exists("good", lambda w: F.exists(w["pairs"], lambda p: p["item"] != p["doc"]))})


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document and benchmark item that leaked into it: doc_id, text_key, item_id, matched, n_windows, coverage, reworded.

    ``reworded`` tells that slots were filled with other values. Equal benchmark texts count once, under their
    smallest item_id. An item without a window of enough literal words is found by all its words in a row, if it has
    ``WITHIN`` or more, or as the whole document; it has one window then. Items of punctuation alone are no items. Null
    texts have no windows; texts of any length are read whole, a bounded number of windows at a time. Equal rows (same
    id and text) give one result row; empty tables give none; other columns are ignored.
    """
    items = benchmark.groupBy("text").agg(F.min("item_id").alias("item_id"))
    bench = stage(window_rows(items, "item_id", size, literals).drop("text_key"), "leak-benchmark")
    index = _index(bench, most_bits)
    if index is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, matched long, n_windows long, coverage double, reworded boolean")
    found = window_rows(docs, "doc_id", size, literals, index)
    n = F.when(F.col("slots").isNull(), F.lit(1).cast("long")).otherwise(F.col("n"))
    right = bench.select(F.col("id").alias("item_id"), F.col("window").alias("_window"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), n.alias("n_windows"))
    met = found.drop("n").join(right, (F.col("window") == F.col("_window")) & (F.col("slots").isNull() == F.col("item_slots").isNull()))
    none = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.coalesce("item_slots", none).alias("item"), F.coalesce("slots", none).alias("doc"))
    runs = met.groupBy("id", "text_key", "item_id", "n_windows", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.collect_set(F.struct("item_at", pairs.alias("pairs"))).alias("met"))
    whole = _consistent(runs).groupBy("id", "text_key", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"), F.max("other").alias("reworded"))
    whole = whole.withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    return whole.select(F.col("id").alias("doc_id"), "text_key", "item_id", "matched", "n_windows", "coverage", "reworded")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaked, with all their columns."""
    ident, key = free(docs, "_id"), free(docs, "_key")
    found = stage(leaks(docs, benchmark, **options).select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct(), "leak-documents")
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(found.hint("shuffle_hash"), same, "left_anti")
