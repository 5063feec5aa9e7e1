"""All pairs of texts that have a given part of their word shingles in common, exactly.

Prefix filter: the distinct shingles of every text are put in one order. Two texts of n shingles can only be similar if
they share one of their first n - ceil(similarity * n) + 1, so a text is filed under those alone. Any order will do; here
shingles that many texts share come last, the rarer ones of them first, and all others go by their hashes. So a passage
that thousands of unlike texts quote files none of them, unless a text is made of such passages.

What meets under a shingle is sifted by exact bounds before any text is read: by size, by the places of the shingle in
both orders, and by parity bitmaps (texts whose bitmaps differ in d bits differ in at least d shingles). What is left
is verified on whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stage, unstage

#: Similarity of five-word shingles from which texts are near-duplicates.
SIMILARITY, WORDS, SEED = 0.8, 5, 42
#: Texts of one shingle that are paired directly; larger groups go by leaders.
GROUP = 16
#: Shingles that come last in the order, at most: the most frequent ones (16 MB).
MOST_COMMON = 1_000_000
#: Times that common shingles are looked for, as others take their places.
TURNS = 2
#: Rounds in which large groups are held against leaders before all their pairs that are not known to be linked are.
LEADER_ROUNDS = 2
#: Rows of a few numbers that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: 64-bit parts of a parity bitmap.
PARTS = 16
_MEMO = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if its count allows."""
    return F.broadcast(df) if df.count() <= most else df


# ------------------------------------------------------------------------------------------------ one text


def shingles(text: bytes, size: int = WORDS, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """Hashes of the distinct word shingles, ascending; of the whole sequence, if there are fewer words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    memo = {} if memo is None else memo
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    grams = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):  # the order of the words counts
        grams = (grams ^ h[k : k + len(grams)]) * _ODD[0]
        grams ^= grams >> np.uint64(29)
    return np.unique(grams * _ODD[1])


def prefix(found: np.ndarray, similarity: float = SIMILARITY, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, bool]:
    """The shingles under which a text is filed, in order, and whether ``common`` (shingles, ascending, and how many texts
    have each) changed them. Common shingles come last, the rarer ones of them first."""
    size = len(found) - max(1, math.ceil(similarity * len(found) - 1e-9)) + 1
    if common is None or not len(common[0]):
        return found[:size], False
    at = np.minimum(np.searchsorted(common[0], found), len(common[0]) - 1)
    late = common[0][at] == found
    last = np.argsort(common[1][at[late]], kind="stable")
    return np.concatenate([found[~late], found[late][last]])[:size], bool(late[:size].any())


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap of 64 * PARTS bits; each shingle turns one over."""
    ones = np.bincount((found & np.uint64(64 * PARTS - 1)).astype(np.int64), minlength=64 * PARTS) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.int64)


# ------------------------------------------------------------------------------------------------ tables


def filed(texts: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, text) -> (node, n, keys, changed, bits); texts without words are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        late = shared.value
        for b in batches:
            rows: list[tuple] = []
            for node, text in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
                found = shingles(text.as_py() or b"", memo=memo)
                if len(found):
                    keys, changed = prefix(found, similarity, late)
                    rows.append((node.as_py(), len(found), keys.view(np.int64), changed, parity(found)))
                if len(memo) > _MEMO:
                    memo.clear()
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "keys", "changed", "bits"])

    return texts.mapInArrow(run, "node long, n int, keys array<long>, changed boolean, bits array<long>")


def filings(files: DataFrame) -> DataFrame:
    """One row per text and shingle: key, node, n, rank."""
    return files.select("node", "n", F.posexplode("keys").alias("rank", "key"))


def counted(files: DataFrame, least: int) -> DataFrame:
    """(key, df) of the shingles that at least so many texts are filed under."""
    return stage(files.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") >= least), "similar-counts")


def _with_frequent(common: tuple[np.ndarray, np.ndarray], counts: DataFrame, group: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``common`` and the most frequent further keys above ``group``, ``most`` in all."""
    top = counts.where(F.col("df") > group).orderBy(F.desc("df"), "key").limit(most).toArrow()
    keys, df = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["df"].to_numpy().astype(np.int64)
    fresh = ~np.isin(keys, common[0])
    room = most - len(common[0])
    keys, df = np.r_[common[0], keys[fresh][:room]], np.r_[common[1], df[fresh][:room]]
    order = np.argsort(keys)
    return keys[order], df[order]


def prefix_files(texts: DataFrame, distinct: bool, similarity: float, group: int, most_common: int = MOST_COMMON) -> tuple[DataFrame, DataFrame]:
    """(node, text) -> the files of the texts, and (key, df) of the shingles that two texts or more are filed under.

    Which shingles count as common changes the order, and so the time, but no result: common ones are those that more
    than ``group`` texts are filed under in one of the turns.
    """
    common = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    once = lambda files: files if distinct else files.dropDuplicates(["node"])
    files = stage(once(filed(texts, similarity, common)), "similar-files")
    found = counts = counted(files, 2)
    for _ in range(TURNS):
        more = _with_frequent(common, found, group, most_common)
        if len(more[0]) == len(common[0]):
            break
        common = more
        before, files = files, stage(once(filed(texts, similarity, common)), "similar-files")
        unstage(before, found)
        found, counts = counted(files.where("changed"), group + 1), None
    return files, counted(files, 2) if counts is None else counts


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """Shingles that texts of these sizes must have in common."""
    return similarity / (1 + similarity) * (a + b) - 1e-6


def _reachable(a: str, b: str, similarity: float) -> Column:
    """Whether texts that first meet at this shingle can have enough in common with what follows it in both orders."""
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.rank"), F.col(f"{b}.n") - F.col(f"{b}.rank")) >= _needed(F.col(f"{a}.n"), F.col(f"{b}.n"), similarity)


def _pairs(met: DataFrame, similarity: float) -> DataFrame:
    x, y = met.alias("x"), met.alias("y")
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _reachable("x", "y", similarity))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _alike(a: Column, b: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    """Whether parity bitmaps leave room for enough common shingles."""
    differing = [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(PARTS)]
    return sum(differing[1:], differing[0]) <= n_a + n_b - 2 * _needed(n_a, n_b, similarity)


def _across(left: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, rank, bits, root, main) -> every pair of a key whose ends are in two components; pairs that the
    bounds rule out don't leave the join."""
    x, y = left.where("root <> main").alias("x"), left.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _reachable("x", "y", similarity) & _alike(F.col("x.bits"), F.col("y.bits"), F.col("x.n"), F.col("y.n"), similarity))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def plausible(pairs: DataFrame, files: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) whose parity bitmaps leave room for enough common shingles."""
    own = lambda end: files.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    met = pairs.distinct().join(own("a"), "a").join(own("b"), "b")
    return met.where(_alike(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")


def verified(texts: DataFrame, pairs: DataFrame, distinct: bool, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts that are similar, from whole texts."""
    pairs = stage(pairs, "similar-pairs")
    n = pairs.count()
    if not n:
        return pairs
    ends = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    ends = F.broadcast(ends) if 2 * n <= BROADCAST_ROWS else ends
    wanted = texts.join(ends, F.col("node") == F.col("_node"), "left_semi")
    wanted = stage(wanted if distinct else wanted.dropDuplicates(["node"]), "similar-texts")
    both = pairs.join(wanted.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(wanted.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0), batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary()), strict=True):
                if a != last:
                    last, mine = a, shingles(x.as_py(), memo=memo)
                other = shingles(y.as_py(), memo=memo)
                same = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(same >= similarity * (len(mine) + len(other) - same) - 1e-9)
                if len(memo) > _MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "similar-verified")
    unstage(wanted, pairs)
    return out


def labelled(edges: DataFrame) -> DataFrame:
    """(node, root): a label that two nodes share only if they are linked, after two rounds of least neighbours. All nodes
    of a star share one; far ends of a chain may not, which only leaves more pairs to look at."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("_next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("_next")))
    first = both.groupBy("node").agg(F.min("_next").alias("least")).select("node", F.least("node", "least").alias("root"))
    again = both.join(first.withColumnRenamed("node", "_node"), F.col("_next") == F.col("_node"))
    return again.groupBy("node").agg(F.min("root").alias("root"))


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, most_common: int = MOST_COMMON) -> DataFrame:
    """Rows with a text -> edges (a, b) between the keys of texts that are similar, up to what is linked anyway.

    Under a shingle of up to ``group`` texts all pairs are looked at. In a larger group every text is held against one
    leader a round: first the most central text, then that of those outside the group's largest set of linked ones; after
    the last round every pair that is not known to be linked is looked at. Members stay comparable to the end, so only pairs that are linked anyway are left out. Texts without
    words have no shingle and link to nothing; equal texts count once.
    """
    column = F.col("text").cast("string")
    texts = docs.where(column.isNotNull()).select(text_key(column).alias("node"), column.alias("text"))
    distinct = texts.select("node").groupBy("node").count().where("count > 1").isEmpty()
    files, counts = prefix_files(texts, distinct, similarity, group, most_common)
    met = stage(filings(files).join(bounded(counts), "key").select("key", "node", "n", "rank", "df"), "similar-met")
    check = lambda found: verified(texts, plausible(found, files, similarity), distinct, similarity)
    edges = check(_pairs(met.where(F.col("df") <= group), similarity))
    big = met.where(F.col("df") > group).select("key", "node", "n", "rank")
    for turn in range(LEADER_ROUNDS + 1):
        if big.isEmpty():
            break
        labels = stage(labelled(edges).withColumnRenamed("node", "_node"), "similar-labels")
        rooted = big.join(bounded(labels), F.col("node") == F.col("_node"), "left").select("key", "node", "n", "rank", F.coalesce("root", "node").alias("root"))
        rooted = stage(rooted, "similar-big")
        # A shingle that is left in one component has nothing more to tell.
        parts = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
        heads = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most")).where("most < size")
        left = rooted.join(bounded(stage(heads, "similar-heads")), "key")
        small = F.lit(turn == LEADER_ROUNDS) | (F.col("size") * (F.col("size") - F.col("most")) <= group * group)
        some, large = left.where(small), left.where(~small)
        # The text with the fewest rarer shingles is the one that all others are edits of, if there is one.
        leaders = (large.where("root <> main") if turn else large).groupBy("key").agg(F.min_by(F.struct("node", "n", "rank", "root"), F.struct("rank", F.xxhash64("node"))).alias("y"))
        x = large.drop("main").alias("x")
        stars = x.join(leaders.alias("l"), (F.col("x.key") == F.col("l.key")) & (F.col("x.root") != F.col("l.y.root")) & _reachable("x", "l.y", similarity))
        stars = stars.select(F.least("x.node", "l.y.node").alias("a"), F.greatest("x.node", "l.y.node").alias("b"))
        some = some.join(files.select(F.col("node").alias("_node"), "bits"), F.col("node") == F.col("_node")).drop("_node")
        more = check(_across(some, similarity).unionByName(stars))
        edges = edges.unionByName(more)
        big = large.select("key", "node", "n", "rank")
    return edges
