"""Exact deduplication against a minimal perfect hash over historical digests.

The distinct digests of the history are dealt to shards by a hash. Each shard gets a minimal perfect hash: level by
level every digest is hashed into a bit array, digests that sit alone in their bit stay, the others go on to the next
level; the rank of its bit is a digest's slot. A slot holds the full 32-byte digest and its winner's locator. Incoming
digests are looked up in their shard and compared byte by byte: members join the group of their slot, all others form
groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import SPACE, attach_groups, crc_mod, free, stage

#: Digests in one shard, on average.
SHARD_DIGESTS = 10_000
#: Bits of a level for each digest that is left, and levels before the rest is listed plainly.
GAMMA, LEVELS = 2.0, 24
_MIX = np.uint64(0x9E3779B97F4A7C15)

GROUPS = "digest binary, keep_id long, group_size long, member boolean"
INDEX = "shard long, sizes array<int>, bits array<binary>, digests binary, winners binary, known binary, counts binary"


def normalised(text: Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest (four 64-bit words) at a level."""
    seed = np.uint64(2 * level + 1)
    with np.errstate(over="ignore"):
        h = (words[:, level % 4] ^ (seed * _MIX)) * _MIX
        h ^= h >> np.uint64(29)
        h = (h + words[:, (level + 1) % 4]) * _MIX
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def build_index(digests: np.ndarray) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Distinct digests (n x 4 words) -> level sizes, level bits, and the slot of each digest."""
    slots = np.full(len(digests), -1, np.int64)
    left, sizes, bits, used = np.arange(len(digests)), [], [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(8, int(GAMMA * len(left)))
        place = _places(digests[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        won = alone[place]
        rank = np.cumsum(alone) - 1 + used
        slots[left[won]] = rank[place[won]]
        used += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        left = left[~won]
    slots[left] = used + np.arange(len(left))  # listed after the last level
    return sizes, bits, slots


def find_slots(words: np.ndarray, sizes: list[int], bits: list[bytes], stored: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 for nonmembers: the stored digest has the last word."""
    out = np.full(len(words), -1, np.int64)
    left, used = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        alone = np.unpackbits(np.frombuffer(bits[level], np.uint8), count=size).astype(bool)
        place = _places(words[left], level, size)
        hit = alone[place]
        out[left[hit]] = (np.cumsum(alone) - 1 + used)[place[hit]]
        used += int(alone.sum())
        left = left[~hit]
    if len(left) and used < len(stored):  # the plain list
        tail = {bytes(x): used + k for k, x in enumerate(stored[used:])}
        for i in left:
            out[i] = tail.get(words[i].tobytes(), -1)
    found = np.flatnonzero(out >= 0)
    wrong = (stored[out[found]] != words[found]).any(axis=1)
    out[found[wrong]] = -1
    return out


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint64).reshape(-1, 4)


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    sizes, bits, slots = build_index(words)
    order = np.argsort(slots)
    winners = pdf["keep_id"].fillna(0).to_numpy(np.int64)[order]
    known = pdf["keep_id"].notna().to_numpy()[order]
    row = {"shard": pdf["shard"].iloc[0], "sizes": sizes, "bits": [b.tobytes() for b in bits], "digests": words[order].tobytes()}
    return pd.DataFrame([row | {"winners": winners.tobytes(), "known": known.tobytes(), "counts": pdf["group_size"].to_numpy(np.int64)[order].tobytes()}])


def _look_up(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: slots with the members that joined them, then the nonmembers."""
    if index.empty:
        return new.assign(member=False)[["digest", "keep_id", "group_size", "member"]]
    row = index.iloc[0]
    stored = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
    winners, known = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["known"], bool).copy()
    counts = np.frombuffer(row["counts"], np.int64).copy()
    slots = find_slots(_words(new["digest"]), list(row["sizes"]), list(row["bits"]), stored) if len(new) else np.empty(0, np.int64)
    inside = slots >= 0
    ids, has = new["keep_id"].fillna(0).to_numpy(np.int64), new["keep_id"].notna().to_numpy()
    at = slots[inside]
    counts[at] += new["group_size"].to_numpy(np.int64)[inside]  # incoming digests are distinct, so no slot comes twice
    better = has[inside] & (~known[at] | (ids[inside] < winners[at]))
    winners[at[better]], known[at[better]] = ids[inside][better], True
    members = pd.DataFrame({"digest": [x.tobytes() for x in stored], "keep_id": pd.array(winners, dtype="Int64"), "group_size": counts, "member": True})
    members.loc[~known, "keep_id"] = pd.NA
    rest = new[~inside].assign(member=False)
    rest["keep_id"] = rest["keep_id"].astype("Int64")
    return pd.concat([members, rest[["digest", "keep_id", "group_size", "member"]]], ignore_index=True)


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with their smallest doc_id and number of rows; copies meet map-side first."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).select(shard, "*")


def historical_index(history: DataFrame, shards: int) -> DataFrame:
    """(digest, doc_id, copies) rows -> one row per shard with its minimal perfect hash and slots."""
    return _distinct(history, shards).groupBy("shard").applyInPandas(_index_shard, INDEX)


def groups(history: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of both: (digest, keep_id, group_size, member of the history)."""
    index = stage(historical_index(history, shards), "dedup-index")
    return index.groupBy("shard").cogroup(_distinct(incoming, shards).groupBy("shard")).applyInPandas(_look_up, GROUPS)


def classify(docs: DataFrame, is_history: Column | None = None, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, member.

    Texts are equal if they are after white-space normalisation; null counts as empty. The smallest doc_id of equal
    texts stays, whether its row is historical or incoming (``is_history``: by default every second document by its
    crc32). Null ids come after all others: keep_id is null only if a whole group has none. Of repeated rows (same id,
    same text) exactly one is kept. An empty table gives no rows; other columns are ignored.
    """
    is_history = crc_mod(F.col("doc_id"), 2) == 0 if is_history is None else is_history
    hashed = docs.select("doc_id", F.unhex(text_sha256(F.col("text"))).alias("digest"), F.coalesce(is_history, F.lit(False)).alias("history"))
    rows = stage(hashed.groupBy("doc_id", "digest", "history").agg(F.count("*").alias("copies")), "dedup-rows")
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_digests))
    found = stage(groups(rows.where("history"), rows.where("not history"), shards), "dedup-groups")
    out = attach_groups(rows, found, "digest", "group_size", total)
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The input rows that stay, with all their columns. Of repeated rows one stays."""
    kept = stage(classify(docs, **options).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")), "dedup-kept")
    return one_each(docs, kept.select("doc_id", "text_sha256"), text_sha256(F.col("text")))


def one_each(docs: DataFrame, kept: DataFrame, fingerprint: Column) -> DataFrame:
    """Rows of docs whose (doc_id, fingerprint) is in ``kept``, once each. kept: two columns, distinct."""
    ident, print_, key = free(docs, "_id"), free(docs, "_print"), free(docs, "_key")
    right = kept.toDF(ident, print_)
    rows = docs.withColumn(key, fingerprint)
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col(key).eqNullSafe(F.col(print_))
    rows = rows.join(right.hint("shuffle_hash"), same, "left_semi")
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.isEmpty():  # no repeated ids: nothing to sort for
        return rows.drop(key)
    return rows.dropDuplicates(["doc_id", key]).drop(key)
