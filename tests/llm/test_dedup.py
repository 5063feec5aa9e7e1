"""Exact dedup, SimHash, components: brute force and odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import op03_exact_dedup as exact
from tracewright.llm import op09_simhash as near
from tracewright.llm import similarity
from tracewright.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    return [(1, None), (2, ""), (3, " \n"), (4, "a  b"), (5, "a\tb"), (5, "a\tb"), (None, "a b"), (None, "only"), (None, "only"), (6, "x" * 50_000), (7, "A b")]


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = 0
        for i in sorted(ids, key=lambda x: (x != keep, x is None, x or 0)):
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept += i == keep
    return sorted(out, key=repr)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + k, words(rng, rng.randrange(1, 3), 6)) for k in range(300)]
    got = exact.classify(docs_of(spark, rows), shard_digests=20).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == expected_exact(rows)


def test_exact_dedup_of_nothing_and_of_one_group(spark):
    assert exact.classify(docs_of(spark, [])).count() == 0
    got = exact.classify(docs_of(spark, [(k, "same") for k in range(3_000)])).where("kept").collect()
    assert [(r.doc_id, r.group_size) for r in got] == [(0, 3_000)]


def test_survivors_keep_columns_and_one_of_repeated_rows(spark):
    df = docs_of(spark, odd_rows()).selectExpr("*", "1 AS _key", "2 AS keep_id", "3 AS digest")
    got = exact.survivors(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id IS NOT NULL").collect())[:3] == [(1, None), (3, " \n"), (4, "a  b")]
    assert sorted(r.text for r in got.where("doc_id IS NULL").collect()) == ["only"]


@pytest.mark.parametrize("n", [0, 1, 7, 5_000])
def test_perfect_hash_is_minimal_and_rejects_others(n):
    rng = np.random.default_rng(n)
    digests = np.unique(rng.integers(0, 2**63, (n, 4), dtype=np.uint64), axis=0)
    sizes, bits, slots = exact.build_index(digests)
    assert sorted(slots.tolist()) == list(range(len(digests)))
    stored = np.empty_like(digests)
    stored[slots] = digests
    packed = [b.tobytes() for b in bits]
    assert (exact.find_slots(digests, sizes, packed, stored) == slots).all()
    others = rng.integers(2**63, 2**64, (200, 4), dtype=np.uint64)
    assert (exact.find_slots(others, sizes, packed, stored) == -1).all()


def reference_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("paired", [2])
def test_simhash_against_brute_force(spark, paired):
    rng = random.Random(2)
    base = [words(rng, 300) for _ in range(12)]
    rows = list(enumerate(base))
    for k in range(140):  # near copies: one word changed
        w = rng.choice(base[:4]).split()
        w[rng.randrange(len(w))] = "ÄZ" + str(rng.randrange(9))
        rows.append((100 + k, " ".join(w)))
    rows += [(1_000, None), (1_001, ""), (1_002, "\n"), (1_003, "ONE two"), (1_004, "one TWO"), (1_005, base[0]), (1_005, base[0])]
    fp = {(i, t): reference_fingerprint(t) for i, t in rows}
    ids = sorted({i for i, _ in rows})
    by = {i: fp[i, t] for i, t in rows}
    want = components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if (by[a] ^ by[b]).bit_count() <= 2])
    got = near.near_duplicates(docs_of(spark, rows), paired=paired).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{by[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]
    kept = near.representatives(docs_of(spark, rows), paired=paired, similarity=None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def edited(rng, text, changes):
    w = text.split()
    for at in rng.sample(range(len(w)), changes):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("group", "most_common"), [(4, 1_000), (4, 5)])
def test_similar_texts_against_brute_force(spark, group, most_common):
    """Edited copies, a large group of them (beyond ``group``), a chain of edits, texts that share only half, and a
    passage that unlike texts quote, of which some hold little else."""
    rng = random.Random(5)
    base = [words(rng, 300) for _ in range(10)]
    rows = list(enumerate(base))
    rows += [(100 + k, edited(rng, base[0], rng.randrange(1, 6))) for k in range(60)]
    rows += [(200 + k, edited(rng, base[1 + k % 4], 4)) for k in range(8)]
    rows += [(300 + k, " ".join(base[5 + k % 4].split()[:150] + words(rng, 150).split())) for k in range(6)]
    chain = [base[9]]
    for k in range(6):
        chain.append(edited(rng, chain[-1], 5))
        rows.append((400 + k, chain[-1]))
    passage = words(rng, 60)
    rows += [(600 + k, words(rng, rng.choice([2, 30, 200])) + " " + passage) for k in range(60)]
    rows += [(500, None), (501, "ONE two"), (502, "one TWO"), (503, base[0].upper())]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    fp, sets, ids = {i: reference_fingerprint(t) for i, t in rows}, {i: shingles(t) for i, t in rows}, [i for i, _ in rows]
    alike = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if alike(a, b)])
    got = near.near_duplicates(docs_of(spark, rows), similarity=0.8, group=group, most_common=most_common).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len({want[i] for i in want if i < 600}) == 18  # ten bases, six halves, the null text, and two words in either case
    quoting = {want[i] for i in want if i >= 600}
    assert 30 < len(quoting) < 50  # those with two words besides are one group


def test_large_variants_keep_all_members(spark, monkeypatch):
    """A chain in which only neighbours are similar, all in one large variant: no text may stand for its component."""
    rng = random.Random(8)
    chain = [words(rng, 300)]
    for k in range(19):
        w = chain[-1].split()
        for at in range(6):
            w[(7 * (6 * k + at)) % 300] = f"step{k}x{at}"
        chain.append(" ".join(w))
    docs = docs_of(spark, list(enumerate(chain)))
    monkeypatch.setattr(similarity, "filed", lambda texts, *_, filed=similarity.filed: filed(texts, *_).withColumn("keys", F.array(F.lit(1).cast("long"))))
    sets = [set(similarity.shingles(t.encode()).tolist()) for t in chain]
    pairs = [(a, b) for a, b in itertools.combinations(range(20), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {b - a for a, b in pairs} == {1}
    got = near.near_duplicates(docs, group=4, similarity=0.8).collect()
    assert {r.component_id for r in got} == set(components(range(20), pairs).values()) == {0}


def test_repeated_passages_and_edge_similarity(spark):
    """A passage repeated many times turns a fingerprint, not the set of shingles; and pairs just at 0.8 are all found."""
    rng = random.Random(9)
    rows, want = [], {}
    far = 0
    for k in range(10):
        w = words(rng, 412).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[-12:] * 39))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
        far = max(far, (reference_fingerprint(rows[-1][1]) ^ reference_fingerprint(rows[-2][1])).bit_count())
    assert far > 18
    for k in range(40):  # 6 single edits of 300 words: 266 of 326 shingles or so
        base = words(rng, 300).split()
        other = list(base)
        for at in range(6):
            other[10 + 45 * at] = f"edit{k}x{at}"
        a, b = (set(similarity.shingles(" ".join(w).encode()).tolist()) for w in (base, other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.82
        rows += [(100 + k, " ".join(base)), (200 + k, " ".join(other))]
        want |= {100 + k: 100 + k, 200 + k: 100 + k}
    got = near.near_duplicates(docs_of(spark, rows), similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_parity_bitmaps_bound_the_difference():
    rng = random.Random(12)
    for _ in range(50):
        w = words(rng, rng.randrange(5, 400)).split()
        other = edited(rng, " ".join(w), min(len(w), rng.randrange(12))).encode()
        a, b = similarity.shingles(" ".join(w).encode()), similarity.shingles(other)
        differing = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(similarity.parity(a).tolist(), similarity.parity(b).tolist(), strict=True))
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))


def test_recall_on_the_tables(spark):
    """Every link of the smallest tables, by brute force and by band of similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: set(similarity.shingles(t.encode()).tolist()) for i, t in rows}
    bands = {0.8: [0, 0], 0.85: [0, 0], 0.9: [0, 0], 0.95: [0, 0]}
    root = {r.doc_id: r.component_id for r in near.near_duplicates(docs, similarity=0.8).collect()}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        common = len(x & y)
        if x and y and common >= 0.8 * (len(x) + len(y) - common):
            found = bands[max(k for k in bands if k <= common / (len(x) + len(y) - common))]
            found[0] += 1
            found[1] += root[a] == root[b]
    assert sum(n for n, _ in bands.values()) > 5
    assert all(n == hit for n, hit in bands.values()), bands


def test_simhash_odd_tables(spark):
    assert near.near_duplicates(docs_of(spark, [])).count() == 0
    got = near.near_duplicates(docs_of(spark, [(None, "a b c d"), (None, "a b c d"), (3, "a b c d")])).collect()
    assert {r.component_id for r in got} == {3}
    kept = near.representatives(docs_of(spark, [(None, "a b c d"), (None, "a b c d"), (None, "q")]).selectExpr("*", "1 AS fp", "2 AS _id"))
    assert sorted(r.text for r in kept.collect()) == ["a b c d", "q"]


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_stars_link_what_pairs_link(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(near._stars(table, bits)).collect()}
    want = components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= bits])
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 500} and got[200] == 0 and got[501] == 500
    assert connected_components(edges.limit(0)).count() == 0
