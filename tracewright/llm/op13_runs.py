"""Periodic runs of words by Crochemore's partition refinement.

Positions of a document fall into classes of equal factors of length 1, 2, 3, ... A class of length p + 1 arises where the
successors of a class of length p fall into different classes; only the smaller children of a split class are looked
at (the largest one is what is left over), so a position is touched O(log n) times. Two neighbouring members of a class
of length p at distance p are a square of a primitive word; squares of one period at consecutive positions are one run.

Words come from Arrow, classes live in numpy arrays. Several documents are refined side by side: their letters differ,
so that no class spans two of them, and each ends in a letter of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import SPACE

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words that are refined side by side; a longer document is refined alone.
SIDE_BY_SIDE = 1 << 20


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Partition:
    """Classes of positions: members stand together in ``order``, class c at start[c] and size[c] long; ``after`` and
    ``before`` are a position's neighbours within its class, -1 if none."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.order = np.argsort(letters, kind="stable").astype(np.int64)
        heads = _heads(letters[self.order])
        self.size = np.zeros(2 * n + 1, np.int64)
        self.start = np.zeros(2 * n + 1, np.int64)
        self.used = len(heads)
        self.start[: self.used], self.size[: self.used] = heads, np.diff(np.append(heads, n))
        self.place, self.of = np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.of[self.order] = np.repeat(np.arange(self.used), self.size[: self.used])
        self.after, self.before, self.moved = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        same = self.of[self.order[1:]] == self.of[self.order[:-1]]
        self.after[self.order[:-1][same]], self.before[self.order[1:][same]] = self.order[1:][same], self.order[:-1][same]

    def members(self, classes: np.ndarray) -> np.ndarray:
        return self.order[_ragged(self.start[classes], self.size[classes])]

    def split(self, at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split the classes of the positions ``at`` by the keys ``by``; positions that aren't named stay together.

        Returns the positions whose right neighbour changed, and the classes to look at next: all children of a split
        class but its largest.
        """
        sort = np.lexsort((at, by, self.of[at]))
        at, by = at[sort], by[sort]
        whole = self.of[at]
        heads = _heads(whole, by)
        counts, parents = np.diff(np.append(heads, len(at))), whole[heads]
        first = _heads(parents)
        taken = np.add.reduceat(counts, first)
        # A class that moves as one isn't split.
        intact = (np.diff(np.append(first, len(parents))) == 1) & (taken == self.size[parents[first]])
        if intact.any():
            drop = np.repeat(np.repeat(intact, np.diff(np.append(first, len(parents)))), counts)
            at, by, whole = at[~drop], by[~drop], whole[~drop]
            if not len(at):
                return at, at
            heads = _heads(whole, by)
            counts, parents = np.diff(np.append(heads, len(at))), whole[heads]
            first = _heads(parents)
            taken = np.add.reduceat(counts, first)
        split = parents[first]
        # Neighbours: what is left closes the gaps, in order of position; each moved group is linked anew.
        line = np.lexsort((at, whole))
        m = at[line]
        self.moved[m] = True
        left, right = self.before[m], self.after[m]
        opens, closes = (left < 0) | ~self.moved[left], (right < 0) | ~self.moved[right]
        a, b = left[opens], right[closes]
        self.after[a[a >= 0]], self.before[b[b >= 0]] = b[a >= 0], a[b >= 0]
        ends = np.append(heads[1:], len(at)) - 1
        self.after[at[:-1]], self.before[at[1:]] = at[1:], at[:-1]
        self.after[at[ends]], self.before[at[heads]] = -1, -1
        # Places: the moved positions go to the front of their old class, group by group.
        base = self.start[split]
        front = _ragged(base, taken)
        there = self.order[front]
        stay = there[~self.moved[there]]
        limit = np.repeat(base + taken, taken)
        old = self.place[m]
        free = old[old >= limit]
        self.order[free], self.place[stay] = stay, free
        self.order[front], self.place[at] = at, front
        self.moved[m] = False
        # Classes: what is left keeps its number.
        new = self.used + np.arange(len(heads))
        self.used += len(heads)
        if self.used > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.size, self.start))
        self.of[at] = np.repeat(new, counts)
        self.size[new], self.start[new] = counts, front[heads]
        self.start[split] += taken
        self.size[split] -= taken
        rest = self.size[split]
        child, parent, count = np.concatenate([new, split]), np.concatenate([np.repeat(np.arange(len(split)), np.diff(np.append(first, len(parents)))), np.arange(len(split))]), np.concatenate([counts, rest])
        by_size = np.lexsort((-count, parent))
        largest = by_size[_heads(parent[by_size])]
        keep = count > 0
        keep[largest] = False
        return np.concatenate([a[a >= 0], at]), child[keep]


def squares(letters: np.ndarray, longest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, sorted starts of squares of primitive words of length p) for each p; ``longest`` bounds p at each position.

    Each document's last letter must stand nowhere else.
    """
    part = Partition(letters)
    due: dict[int, list[np.ndarray]] = defaultdict(list)

    def remember(at: np.ndarray, p: int) -> None:
        gap = part.after[at] - at
        keep = (part.after[at] >= 0) & (gap >= p) & (gap <= longest[at])
        at, gap = at[keep], gap[keep]
        if len(at):
            sort = np.argsort(gap, kind="stable")
            at, heads = at[sort], _heads(gap[sort])
            for g, some in zip(gap[sort][heads].tolist(), np.split(at, heads[1:]), strict=True):
                due[g].append(some)

    remember(np.arange(len(letters)), 1)
    small, p = np.arange(part.used), 1
    while len(small) or due:
        if found := due.pop(p, None):
            at = np.unique(np.concatenate(found))
            at = at[part.after[at] - at == p]
            if len(at):
                yield p, at
        if len(small):
            at = part.members(small)
            by = np.repeat(small, part.size[small])
            keep = (at > 0) & (longest[at] > p)
            at, by = at[keep] - 1, by[keep]
            keep = part.size[part.of[at]] > 1
            changed, small = part.split(at[keep], by[keep]) if keep.any() else (at[:0], at[:0])
            p += 1
            remember(changed, p)
        elif due:
            p = min(due)


def runs(letters: np.ndarray, starts: np.ndarray, longest: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of documents that begin at ``starts`` and end in a letter of their own."""
    found = [np.zeros((0, 3), np.int64)]
    for p, at in squares(letters, longest):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        last = np.append(first[1:], len(at)) - 1
        length = at[last] - at[first] + 2 * p
        keep = length >= max(least_length, least_exponent * p)
        found.append(np.stack([at[first][keep], length[keep], np.full(keep.sum(), p)], axis=1))
    rows = np.concatenate(found)
    doc = np.searchsorted(starts, rows[:, 0], side="right") - 1
    rows[:, 0] -= starts[doc]
    rows = np.concatenate([doc[:, None], rows], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _work(text: pa.Array, least_length: int, least_exponent: int) -> list[pa.Array]:
    """n_words, runs and collapsed texts of some texts (large strings without nulls)."""
    split = pc.ascii_split_whitespace(text)
    owner, words = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    there = pc.not_equal(pc.binary_length(words), 0)
    owner, words = owner[there.to_numpy(zero_copy_only=False)], words.filter(there)
    sizes = np.bincount(owner, minlength=len(text))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    codes = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)
    width = int(codes.max(initial=-1)) + 2
    letters = np.repeat(np.arange(1, len(text) + 1) * width - 1, sizes + 1)  # each document's last letter
    at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters[at] = owner * width + codes
    found = runs(letters, starts, np.repeat(np.where(sizes >= least_length, sizes // least_exponent, 0), sizes + 1), least_length, least_exponent)
    doc, start, length, period = found.T
    gone = np.zeros(len(letters) + 1, np.int64)
    np.add.at(gone, starts[doc] + start + period, 1)
    np.add.at(gone, starts[doc] + start + length, -1)
    keep = np.cumsum(gone)[at] == 0
    kept = np.bincount(owner[keep], minlength=len(text))
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int64()), words.filter(pa.array(keep)))
    ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(text))))
    each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_string())]


def find_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs is an array of (start, length, period) by start and period.

    A run is a stretch of consecutive words with smallest period q and a length of at least ``least_length`` and of
    ``least_exponent`` (2 at least) times q that no neighbouring word extends. ``collapsed`` has the words that no run
    holds after its first q words, joined by one space.

    Null, empty and blank texts have no words and no runs; texts of any length are read whole; repeated rows each give
    a row; an empty table gives none; other columns are ignored. Every text is worked on by itself: no shuffle.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats its period at least once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            bytes_so_far = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                # A word and its space have two bytes at least; on average about six here.
                before = bytes_so_far[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(bytes_so_far, before + 6 * SIDE_BY_SIDE, side="right")))
                done = _work(texts.slice(at, to - at), least_length, least_exponent)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *done], schema=pa.schema([("doc_id", b.schema[0].type), ("n_words", pa.int64()), ("runs", done[1].type), ("collapsed", pa.large_string())]))
                at = to

    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")])
    return docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, fields)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents, those with a crc32 of their id that ends in 0 with repeated words, as the query's contract asks."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE), "").alias("w"))
    placed = words.select("doc_id", "text", "h", "w", F.size("w").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    # The remainder is worked out for texts without words too.
    placed = placed.withColumn("a", F.expr("CAST(g % greatest(n, 1) AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    return placed.select("doc_id", F.expr("CASE WHEN h % 10 = 0 AND n > 0 THEN concat_ws(' ', transform(sequence(0, n - 1), i -> w[IF(i < a, i, a + (i - a) % p)])) ELSE text END").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (ties: smallest start, then period) and both digests."""
    best = F.expr("element_at(array_sort(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p))), 1)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    seen = found.select("*", F.when(F.size("runs") > 0, best).alias("b"), lines.alias("lines"))
    return seen.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), F.expr("(-b.l * 1000) DIV b.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
