"""Toxicity of documents whose words may be disguised: noisy-channel deobfuscation, then evidence of restored words.

The channel writes look-alike characters for letters, repeats letters and puts separators between them. A token is a
lattice of what each of its characters may stand for; a Viterbi search finds the cheapest restoration under the channel
and a character language model of the whole corpus. A token of letters alone (none three times in a row) has one path.

Character sequences of restored words are counted over labelled documents, once for those that hold a sequence and once
for those that hold it in two different words. A word is as telling as its most telling sequence, so words of one stem
support each other. A small logistic model turns a document's most telling words into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import crc_mod

#: Labelled documents that the model is fitted on, at most about; more labels are thinned by a hash of doc_id.
FIT_ROWS = 20_000
#: Slots of the language model's and of the evidence's hash tables: what is sent to all tasks is no larger.
MODEL_SLOTS, EVIDENCE_SLOTS = 1 << 20, 1 << 21
#: Characters of the language model's sequences; of the evidence's sequences, borders included; of those at a word's start.
ORDER, SHORTEST, LONGEST, AT_START = 4, 3, 6, 10
#: Score from which a document counts as toxic.
TOXIC = 0.5
#: Hypotheses that the search keeps for a character.
BEAM = 24
#: Characters of a token's rest that is searched once for all tokens with the same last characters before it.
SHORT = 16
#: Bytes of text that a task works on at once (a longer text is worked on alone).
PIECE = 4 << 20
#: Words of a document that the score looks at; the evidence from which a word counts as telling, and counts at all.
TOP, TELLING, LEAST = 3, 2.0, 0.5
#: Standard errors between a log ratio and its lower bound.
DEVIATIONS = 2.0

#: Letters that a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "¡": "i", "€": "e", "£": "l"}
#: Costs in nats: a look-alike, a wildcard, a repeated letter kept or dropped, a separator dropped or taken as a border,
#: any other character that stands for itself.
LIKE, WILD, KEPT, DROPPED, INSIDE, BORDER, ITSELF = 1.0, 3.0, 1.0, 0.5, 0.7, 0.4, 7.0
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_END, _MARKS = "\n", ".,;:?'\""
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_SPACED_RE2 = r"(?:^|\s)\S(?:[ \t]\S){2,}(?:\s|$)"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _grams(words: list[str], least: int, most: int, slots: int, at_start: int = 0, tell: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, slot) of every sequence of ``least`` to ``most`` characters, borders included, one array per length;
    then of the words' first characters up to ``at_start``. With ``tell``, of the slots alone that it marks."""
    codes = np.frombuffer((_END + _END.join(words) + _END).encode("utf-32-le"), np.uint32).astype(np.uint64)
    borders = np.flatnonzero(codes == ord(_END))
    word = np.repeat(np.arange(len(borders)), np.diff(borders, append=len(codes)))
    # Characters up to the next border: a border may stand first or last in a sequence, not inside.
    left = np.append(borders[1:], len(codes))[word] - np.arange(len(codes))
    codes += np.uint64(1)
    hashed, starts = np.zeros(len(codes), np.uint64), np.zeros(0, np.int64)
    for k in range(1, max(most, at_start) + 1):
        if k <= most:
            n = max(0, len(codes) - k + 1)
            hashed = (hashed[:n] * _MIX) ^ codes[k - 1 :]
            if k < least:
                continue
            at = np.flatnonzero(left[:n] >= k - 1)
            some = hashed[at]
        else:
            if k == most + 1:
                starts, some = borders[borders < len(hashed)], hashed[borders[borders < len(hashed)]]
            longer = (left[starts] >= k - 1) & (starts <= len(codes) - k)
            starts = at = starts[longer]
            some = (some[longer] * _MIX) ^ codes[at + (k - 1)]
        mixed = (some ^ np.uint64(k)) * _MIX
        slot = ((mixed ^ (mixed >> np.uint64(29))) & np.uint64(slots - 1)).astype(np.int64)
        if tell is not None:
            kept = np.flatnonzero(tell[slot])
            at, slot = at[kept], slot[kept]
        yield np.minimum(word[at], len(words) - 1), slot


def _slot(gram: str, slots: int) -> int:
    """The slot of one sequence, as ``_grams`` has it."""
    mask, h = (1 << 64) - 1, 0
    for c in gram:
        h = (h * int(_MIX) & mask) ^ (ord(c) + 1)
    h = (h ^ len(gram)) * int(_MIX) & mask
    return (h ^ h >> 29) & slots - 1


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, token number) of all tokens and the distinct tokens in lower case; spaced-out runs are one token."""
    lower = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(lower)
    owner, flat = pc.list_parent_indices(split).to_numpy(), pc.dictionary_encode(pc.list_flatten(split))
    codes, kinds = flat.indices.to_numpy(), flat.dictionary
    spaced: dict[str, int] = {}
    more = [(k, spaced.setdefault(m, len(kinds) + len(spaced))) for k in np.flatnonzero(pc.match_substring_regex(lower, _SPACED_RE2).to_numpy(zero_copy_only=False)).tolist() for m in set(_SPACED.findall(lower[k].as_py()))]
    if more:
        owner, codes = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((owner, codes), zip(*more, strict=True), strict=True))
    return owner, codes, pa.concat_arrays([kinds, pa.array(list(spaced), kinds.type)])


def _strings(words: pa.Array) -> list[str]:
    """The words as Python strings, without a scalar object for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order: sorting is several times faster here than the hash table of numpy's unique."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _plain(tokens: list[str]) -> np.ndarray:
    """Which tokens consist of letters alone, none three times in a row: they stand for themselves."""
    codes = np.frombuffer((_END.join(tokens) + _END).encode("utf-32-le"), np.uint32)
    border = codes == ord(_END)
    odd = ~(_LETTER[np.minimum(codes, len(_LETTER) - 1)] | border)
    odd[2:] |= (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2])
    odd[1:] |= border[1:] & border[:-1]  # an empty token
    odd[:1] |= border[:1]
    plain = np.ones(len(tokens), bool)
    plain[np.searchsorted(np.flatnonzero(border), np.flatnonzero(odd))] = False
    # Characters beyond the table are left to Python's own rule.
    for k in np.unique(np.searchsorted(np.flatnonzero(border), np.flatnonzero(codes >= len(_LETTER) - 1))).tolist():
        plain[k] = tokens[k].isalpha() and not _THRICE.search(tokens[k])
    return plain


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of about PIECE bytes of text, with the texts."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    sums = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def character_counts(docs: DataFrame) -> np.ndarray:
    """Hashed counts of the character sequences of up to ORDER characters in all words of letters of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MODEL_SLOTS, np.int64)
        for b in batches:
            for _, texts in _pieces(b, 0):
                seen = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(pc.utf8_lower(texts))))
                trimmed = pc.utf8_trim(seen.field("values"), ".,;:!?\"'()[]-")
                alpha = pc.utf8_is_alpha(trimmed)
                kinds = pc.dictionary_encode(trimmed.filter(alpha))
                words = _strings(kinds.dictionary)
                n = np.bincount(kinds.indices.to_numpy(), weights=seen.field("counts").filter(alpha).to_numpy(), minlength=len(words)).astype(np.int64)
                if words:
                    for word, slot in _grams(words, 1, ORDER, MODEL_SLOTS):
                        np.add.at(total, slot, n[word])
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(total[at[k : k + (1 << 16)]])], names=["slot", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(MODEL_SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


class Restorer:
    """Restores tokens by a Viterbi search under the channel and the language model that the counts make.

    What it remembers is bounded and changes no result, so a broadcast one serves all tasks of a worker."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.letters = counts, int(counts[[_slot(c, len(counts)) for c in _LETTERS]].sum())
        self._costs: dict[str, float] = {}  # by context and character, which is the last one
        self._done: dict[str, str] = {}

    def cost(self, context: str, c: str) -> float:
        """-log P(c | context): sequences of each length, interpolated with the next shorter one."""
        if context + c not in self._costs:
            n = lambda gram: int(self.counts[_slot(gram, len(self.counts))])
            p = (n(c) + 0.1) / (self.letters + 10)
            for k in range(1, len(context) + 1):
                tail = context[-k:]
                p = (n(tail + c) + 5 * p) / (n(tail) + 5)
            if len(self._costs) > 1 << 18:
                self._costs.clear()
            self._costs[context + c] = -math.log(min(max(p, 1e-12), 1.0))
        return self._costs[context + c]

    def arcs(self, token: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for: letters, nothing ("") or a border, with the channel's cost."""
        c = token[i]
        if c.isalpha():
            return [(c, KEPT), ("", DROPPED)] if i and token[i - 1] == c else [(c, 0.0)]
        out = [(x, LIKE) for x in LOOKS_LIKE.get(c, "")]
        if c == "*" and token[max(0, i - 1) : i + 2].count("*") == 1:
            out += [(x, WILD) for x in _LETTERS]
        if c.isdigit():
            return [*out, (c, ITSELF)]
        return [*out, ("", INSIDE), (_END, BORDER)]

    def restore(self, token: str) -> str:
        """The most likely original of a lower-case token, words separated by one space. Sentence marks at its ends stand
        for nothing on every path."""
        token = token.strip(_MARKS)
        if token.isalpha() and not _THRICE.search(token):
            return token
        return self._search(token)

    def _search(self, token: str) -> str:
        """Up to the first character that may stand for more than itself there is one path, and of it the rest depends
        on the last characters alone: so a short rest is remembered by them, whatever the token. What a long one stands
        for is rarely met again; it is searched with the cost of all before it, which rounding may need between equals."""
        i = 0
        while i < len(token) and (c := token[i]).isalpha() and not (i and token[i - 1] == c):
            i += 1
        before = _END + token[:i]
        if len(token) - i <= SHORT:
            before = before[1 - ORDER :]
        key = before + _END + token[i:]
        rest = self._done.get(key)
        if rest is None:
            rest = self._cheapest(before, token[i:])
            if len(self._done) > 1 << 17:
                self._done.clear()
            if len(key) < 64:
                self._done[key] = rest
        return " ".join((token[:i] + rest).split())

    def _cheapest(self, before: str, rest: str) -> str:
        """What the rest of a token stands for after the characters before it, borders as spaces."""
        known, cost_of, context, start = self._costs, self.cost, before[1 - ORDER :], 0.0
        if before[0] == _END:  # else what comes before isn't known; it adds the same to all paths
            for k in range(1, len(before)):
                start += cost_of(before[max(0, k + 1 - ORDER) : k], before[k])
        token = context + rest
        # A hypothesis: the last characters, its cost and a chain of what was written.
        best: dict[str, tuple[float, tuple]] = {context: (start, ())}
        for i in range(len(context), len(token)):
            arcs, new = self.arcs(token, i), {}
            for context, (cost, written) in best.items():
                for c, price in arcs:
                    if c == "":
                        then, total, chain = context, cost + price, written
                    elif price == ITSELF:
                        then, total, chain = _END, cost + price, (written, c)
                    else:
                        key = context + c
                        if c == _END:
                            then, total, chain = _END, cost + (price + (known[key] if key in known else cost_of(context, c)) if context != _END else 0), (written, " ")
                        else:
                            then, total, chain = key[1 - ORDER :], cost + price + (known[key] if key in known else cost_of(context, c)), (written, c)
                    if then not in new or total < new[then][0]:
                        new[then] = (total, chain)
            best = new if len(new) <= BEAM else dict(sorted(new.items(), key=lambda x: (x[1][0], x[0]))[:BEAM])
        _, _, chain = min((cost + (self.cost(context, _END) if context != _END else 0.0), context, chain) for context, (cost, chain) in best.items())
        out = []
        while chain:
            chain, c = chain
            out.append(c)
        return "".join(reversed(out))


def restore_texts(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, restored): each text in lower case with its tokens restored, joined by one space; spaced-out runs are
    one token."""
    shared = docs.sparkSession.sparkContext.broadcast(Restorer(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared.value
        for b in batches:
            for rows, texts in _pieces(b, 1):
                out = []
                for text in texts.to_pylist():
                    held = _SPACED.sub(lambda m: m[0].replace(" ", "\0").replace("\t", "\0"), text.lower())
                    out.append(" ".join(restorer.restore(t.replace("\0", " ")) for t in re.split(r"[\x20\x09-\x0D]+", held) if t))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.large_string())], names=["doc_id", "restored"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("restored", T.StringType())]))


def _restored(texts: pa.Array, restorer: Restorer, tell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, word number) of restored words, the words, how many distinct tokens each text has, and the
    words' slots as ``_by_word`` has them. With ``tell``, words without a slot that it marks are left out of the pairs.

    Only tokens that are not plain are restored one by one; all else is done for all tokens at once."""
    owner, codes, kinds = _words(texts)
    pairs = _distinct(owner.astype(np.int64) * (len(kinds) + 1) + codes)
    owner, codes = np.divmod(pairs, len(kinds) + 1)
    sizes = np.bincount(owner, minlength=len(texts))
    stripped = pc.dictionary_encode(pc.utf8_trim(kinds, _MARKS))
    tokens = _strings(stripped.dictionary)
    plain = _plain(tokens)
    parts = [[w for w in restorer.restore(tokens[k]).split(" ") if w] for k in np.flatnonzero(~plain).tolist()]
    n = np.ones(len(tokens), np.int64)
    n[~plain] = np.fromiter(map(len, parts), np.int64, len(parts))
    # The words of all tokens, token by token: first the plain ones, then the restored ones, put in order.
    at = np.empty(len(tokens), np.int64)
    at[plain], at[~plain] = np.arange(plain.sum()), plain.sum() + np.cumsum(n[~plain]) - n[~plain]
    first = np.cumsum(n) - n
    each = pa.concat_arrays([stripped.dictionary.filter(pa.array(plain)), pa.array([w for p in parts for w in p], kinds.type)])
    flat = pc.dictionary_encode(each.take(pa.array(np.arange(n.sum()) + np.repeat(at - first, n))))
    words, flat = _strings(flat.dictionary), flat.indices.to_numpy().astype(np.int64)
    by_word, slots = _by_word(words, tell)
    told = np.diff(by_word) > 0
    telling = np.bincount(np.repeat(np.arange(len(tokens)), n), weights=told[flat], minlength=len(tokens)) > 0
    token = stripped.indices.to_numpy()[codes]
    kept = telling[token]
    owner, token = owner[kept], token[kept]
    m = n[token]
    word = flat[np.arange(m.sum()) + np.repeat(first[token] - (np.cumsum(m) - m), m)]
    owner = np.repeat(owner, m)
    pairs = _distinct(owner[told[word]] * (len(words) + 1) + word[told[word]])
    return pairs // (len(words) + 1), pairs % (len(words) + 1), words, sizes, by_word, slots


def _by_word(words: list[str], tell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, slots): the distinct slots of word k are slots[first[k] : first[k + 1]], those alone that ``tell`` marks."""
    keys = [np.zeros(0, np.int64)]
    for at in range(0, len(words), 1 << 12):  # so many that their arrays stay in a core's cache
        keys += [(word + at) * EVIDENCE_SLOTS + slot for word, slot in _grams(words[at : at + (1 << 12)], SHORTEST, LONGEST, EVIDENCE_SLOTS, AT_START, tell)]
    found = _distinct(np.concatenate(keys))
    return np.searchsorted(found, np.arange(len(words) + 1) * EVIDENCE_SLOTS), found % EVIDENCE_SLOTS


def _spread(word: np.ndarray, first: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of some words one after the other, and how many each has."""
    n = first[word + 1] - first[word]
    return slots[np.arange(n.sum()) + np.repeat(first[word] - (np.cumsum(n) - n), n)], n


class Reader:
    """Looks up the evidence of restored words in pairs of tables (sequences held once, held by two words of a text)."""

    def __init__(self, restorer: Restorer, *tables: list[np.ndarray]):
        self.restorer, self.tables = restorer, tables
        self.tell = np.any([t >= LEAST for pair in tables for t in pair], axis=0)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Distinct (text, word) of restored words, the words, the evidence of each pair by each pair of tables, and the
        texts' distinct tokens. A word's evidence is that of its most telling sequence."""
        owner, word, words, sizes, first, slots = _restored(texts, self.restorer, self.tell)
        slot, n = _spread(word, first, slots)
        keys, back, count = np.unique(np.repeat(owner, n) * EVIDENCE_SLOTS + slot, return_inverse=True, return_counts=True)
        keys, z = keys % EVIDENCE_SLOTS, []
        for once, twice in self.tables:
            most = np.maximum(once[keys], np.where(count > 1, twice[keys], 0)).astype(np.float64)
            z.append(np.maximum.reduceat(most[back], np.cumsum(n) - n) if len(n) else np.zeros(0))
        return owner, word, words, np.stack(z), sizes


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely a sequence speaks for toxicity: the lower bound of its log ratio of shares, 0 where it is below."""
    t, c = np.maximum(toxic.astype(float), 0) + 0.5, np.maximum(clean.astype(float), 0) + 0.5
    return np.maximum(0, np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1)) - DEVIATIONS * np.sqrt(1 / t + 1 / c)).astype(np.float16)


@dataclass(frozen=True)
class Model:
    """A fitted model: language model counts, evidence by slot and the weights of a document's statistics."""

    counts: np.ndarray
    once: np.ndarray
    twice: np.ndarray
    weights: np.ndarray


def _statistics(owner: np.ndarray, z: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of texts from the evidence of their telling words and their tokens, and the places of the top words."""
    n = len(tokens)
    sort = np.lexsort((-z, owner))
    first = np.searchsorted(owner[sort], np.arange(n))
    sizes = np.bincount(owner, minlength=n)
    rank = first[:, None] + np.arange(TOP)
    there = np.arange(TOP) < sizes[:, None]
    top = sort[np.minimum(rank, max(0, len(sort) - 1))] if len(sort) else np.zeros((n, TOP), np.int64)
    highest = np.where(there, z[top] if len(z) else 0, 0)
    telling = np.bincount(owner, weights=z >= TELLING, minlength=n)
    return np.column_stack([highest, np.log1p(telling), np.sqrt(telling / np.maximum(1, tokens)), np.log1p(tokens)]), np.where(there, top, -1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model: constant, then one for each statistic. Without both classes, the smoothed share."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.append(math.log(share / (1 - share)), np.zeros(x.shape[1]))
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w, keep = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return np.append(w[0], w[1:] / scale)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents (doc_id, toxic) for which ``learn`` holds: by default crc32(doc_id) mod 5 is not 0.

    The language model counts all documents. Labelled rows without id or with another label than 0 and 1 are left out,
    equal texts with one label count once. A labelled document's statistics leave out its own count.
    """
    learn = crc_mod(F.col("doc_id"), 5) != 0 if learn is None else learn
    counts = character_counts(docs)
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, fit_rows / max(1, marked.count())) * (1 << 20))
    # About fit_rows rows of two numbers, whatever the labels' size: small enough to broadcast and to collect.
    chosen = F.broadcast(marked.where(share).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    ids = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n"), "toxic").agg(F.min("doc_id").alias("_id")).select("_id").distinct().collect()
    one_each = F.broadcast(docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType)])))
    rows = rows.join(one_each, F.col("doc_id") == F.col("_id")).select("toxic", "text")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    shared = docs.sparkSession.sparkContext.broadcast(Restorer(counts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2 * EVIDENCE_SLOTS), np.int32)  # held once, held by two words: clean, then toxic documents
        for b in batches:
            for part, texts in _pieces(b, 1):
                kind = part.column(0).to_numpy().astype(np.int64)
                owner, word, _, _, first, slots = _restored(texts, shared.value)
                at = 0
                while at < len(owner):  # some documents at a time
                    to = int(np.searchsorted(owner, owner[min(at + (1 << 14), len(owner) - 1)], side="right"))
                    slot, n = _spread(word[at:to], first, slots)
                    keys = np.sort(np.repeat(owner[at:to], n) * EVIDENCE_SLOTS + slot)
                    same = keys[1:] == keys[:-1]
                    new = np.append(True, ~same)
                    for k, some in enumerate((keys[new], keys[new & np.append(same, False)])):
                        np.add.at(seen[k], kind[some // EVIDENCE_SLOTS] * EVIDENCE_SLOTS + some % EVIDENCE_SLOTS, np.int32(1))
                    at = to
        seen = seen.reshape(2, 2, EVIDENCE_SLOTS)
        at = np.flatnonzero(seen.any(axis=(0, 1))).astype(np.int32)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(seen[i, j, some]) for i in (0, 1) for j in (1, 0)]], names=["slot", *columns])

    columns = ["toxic", "clean", "toxic2", "clean2"]
    sums = rows.mapInArrow(count, "slot int, " + ", ".join(f"{c} int" for c in columns)).groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns])
    found = sums.where("toxic > 0").toArrow()
    slot, toxic, clean, toxic2, clean2 = (found[c].to_numpy() for c in ["slot", *columns])

    def table(values: np.ndarray) -> np.ndarray:
        out = np.zeros(EVIDENCE_SLOTS, np.float16)
        out[slot] = values
        return out

    by_kind = [
        [table(evidence(t, c - 1, n_toxic, max(0, n_clean - 1))) for t, c in ((toxic, clean), (toxic2, clean2))],
        [table(evidence(t - 1, c, max(0, n_toxic - 1), n_clean)) for t, c in ((toxic, clean), (toxic2, clean2))],
    ]
    without = docs.sparkSession.sparkContext.broadcast(by_kind)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, *without.value)
        for b in batches:
            for part, texts in _pieces(b, 1):
                kind = part.column(0).to_numpy()
                owner, _, _, z, tokens = reader.read(texts)
                x, _ = _statistics(owner, z[kind[owner], np.arange(len(owner))], tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    known = rows.mapInArrow(describe, "toxic int, x array<double>").toArrow()
    x = np.array(known["x"].to_pylist()).reshape(-1, TOP + 3)
    return Model(counts, table(evidence(toxic, clean, n_toxic, n_clean)), table(evidence(toxic2, clean2, n_toxic, n_clean)), _fit_logistic(x, known["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, words) for every row: words are the restored words that speak most for toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(Reader(Restorer(model.counts), [model.once, model.twice]))
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value
        for b in batches:
            for part, texts in _pieces(b, 1):
                owner, word, words, (z,), tokens = reader.read(texts)
                x, top = _statistics(owner, z, tokens)
                p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))
                told = [[words[word[k]] for k in row if k >= 0 and z[k] >= TELLING] for row in top.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array(told, pa.list_(pa.string()))], names=["doc_id", "score", "words"])

    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("words", T.ArrayType(T.StringType()))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, words. The score uses the text alone.

    Null texts count as empty and get the score of a text without words; texts of any length are read whole; a score at
    the threshold counts as toxic; repeated rows each give a row; without usable labels every score is the prior; an
    empty table gives no rows; other columns are ignored.
    """
    done = score(docs, train(docs, labels))
    return done.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "words")
