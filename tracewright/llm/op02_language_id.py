"""Language identification by cross-parsing entropy.

For each language, labelled text is turned into a suffix automaton. A text is cut, from left to right, into the longest
phrases that occur in the language's reference; phrases * log2(reference length) / text length estimates the cross
entropy, and the language with the least wins. Whole texts are parsed.

Thousands of windows of a fixed number of bytes advance side by side in one array operation, each from the automaton's
root. Two parses that start a phrase at the same place are the same from there on, so the parse of each window is then
carried on into the next one until they meet, and the counts are mended by the phrases up to there. The few texts with
phrases so long that two windows never meet are parsed byte by byte. The result is that of one parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import crc_mod

#: Labelled documents per language that make its reference, the first by a hash of doc_id and text, whole, as long as they
#: have so many bytes together at most. Those of up to so many characters come first: within the bound, many short texts
#: show more of a language than one long one. An automaton takes about 400 bytes for each byte of its reference, so the
#: bound is about 100 MB for each language.
SAMPLED, SHORT, MOST_BYTES = 24, 2_000, 1 << 18
#: Bytes of a window, and of the windows that advance together.
WINDOW, TOGETHER = 256, 3_000_000
UNKNOWN = "und"

_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def simplified(text: str) -> bytes:
    """Lower-cased UTF-8; everything in ASCII but letters becomes one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def has_letter(text: str, simple: bytes) -> bool:
    return any(c < 128 and c != 32 for c in simple[:64]) or any(map(str.isalpha, text))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states; exactly the substrings of text can be read from state 0."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new, at = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return moves


class Parser:
    """Counts phrases for several references at once.

    Symbols are the bytes that references have, 0 for padding and 1 for any other byte. A table entry holds twice the
    next state's row offset, plus 1 if the symbol starts a phrase.
    """

    def __init__(self, references: dict[str, bytes]):
        self.names = sorted(references)
        used = sorted({c for text in references.values() for c in text})
        self.symbols = np.ones(256, np.uint8 if len(used) < 250 else np.uint16)
        self.symbols[used] = np.arange(2, len(used) + 2)
        self.bits = np.array([np.log2(max(2, len(references[n]))) for n in self.names])
        self.tables = [self._table(references[n], len(used) + 2) for n in self.names]

    def _table(self, text: bytes, width: int) -> np.ndarray:
        moves = suffix_automaton(text)
        if 2 * len(moves) * width > np.iinfo(np.int32).max:
            raise ValueError(f"a reference of {len(text)} bytes is too long for a table of 32-bit offsets")
        first = np.ones(width, np.int32)  # an unknown symbol is a phrase and leads back to the root
        for c, to in moves[0].items():
            first[self.symbols[c]] = 2 * to * width + 1
        first[0] = 0
        table = np.tile(first, (len(moves), 1))
        for state, own in enumerate(moves):
            if state:
                for c, to in own.items():
                    table[state, self.symbols[c]] = 2 * to * width
        return table.ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrase counts, texts x languages."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        if not len(owner):
            return out
        # Every text is padded to whole windows; rows are windows, the parse walks along the columns.
        offsets = np.cumsum(counts) - counts
        grid = np.zeros(int(counts.sum()) * WINDOW, self.symbols.dtype)
        for text, at in zip(texts, (offsets * WINDOW).tolist(), strict=True):
            grid[at : at + len(text)] = self.symbols[np.frombuffer(text, np.uint8)]
        columns = np.ascontiguousarray(grid.reshape(-1, WINDOW).T)
        for k, table in enumerate(self.tables):
            at = np.zeros(len(owner), np.int32)
            starts = np.empty(columns.shape, bool)
            for column, start in zip(columns, starts, strict=True):
                step = table[at + column]
                np.bitwise_and(step, 1, out=start, casting="unsafe")
                at = step >> 1
            n = starts.sum(axis=0, dtype=np.int64)
            apart = self._carry(table, columns, starts, owner, at, n)
            out[:, k] = np.bincount(owner, n, len(texts))
            for text in np.unique(owner[apart]):
                out[text, k] = self._one_by_one(table, texts[text])
        return out

    @staticmethod
    def _carry(table: np.ndarray, columns: np.ndarray, starts: np.ndarray, owner: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Carry the parse of each window on into the next one of its text until both start a phrase at one place, and
        mend the next one's count. Returns the windows that never meet the parse from before."""
        into = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        at = at[into - 1]
        for column, start in zip(columns, starts, strict=True):
            if not len(into):
                break
            step = table[at + column[into]]
            ours, theirs = step & 1 > 0, start[into]
            n[into] += ours.astype(np.int64) - theirs
            apart = ~(ours & theirs)
            into, at = into[apart], step[apart] >> 1
        return into

    def _one_by_one(self, table: np.ndarray, text: bytes) -> int:
        entries, n, at = memoryview(table), 0, 0
        for symbol in self.symbols[np.frombuffer(text, np.uint8)].tolist():
            step = entries[at + symbol]
            n += step & 1
            at = step >> 1
        return n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        simple = [simplified(t or "") for t in texts]
        known = np.array([bool(self.names) and has_letter(t or "", s) for t, s in zip(texts, simple, strict=True)], bool)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lengths = np.maximum(1, [len(s) for s in simple])
        entropy = self.phrases(simple) * self.bits / lengths[:, None]
        best = entropy.argmin(axis=1)
        ranked = np.sort(entropy, axis=1)
        score = ranked[:, 1] / np.maximum(1e-9, ranked[:, 0] + ranked[:, 1]) if len(self.names) > 1 else np.ones(len(texts))
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def references(docs: DataFrame, sampled: int = SAMPLED, short: int = SHORT, most_bytes: int = MOST_BYTES) -> dict[str, bytes]:
    """Labelled rows (doc_id, text, lang) -> reference text per language: whole texts of so many rows, up to the text that
    would pass the bound in bytes. Texts beyond it are left out, as is a language that has no others."""
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.length("text") > short, "key")
    first = named.where(F.octet_length("text") <= most_bytes).withColumn("place", F.row_number().over(order)).where(F.col("place") <= sampled).select("lang", "key", "place", F.octet_length("text").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("place"))
    keys = first.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select(F.col("lang").alias("_lang"), F.col("key").alias("_key"))
    # A few numbers for each language.
    chosen = named.join(F.broadcast(keys.distinct()), (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key")))
    pieces: dict[str, list[bytes]] = {}
    for r in chosen.select("lang", "key", "text").distinct().orderBy("lang", "key", "text").collect():
        pieces.setdefault(r["lang"], []).append(simplified(r["text"]))
    return {lang: text for lang, parts in pieces.items() if (text := b" ".join(parts).strip())}


_parsers: dict[int, Parser] = {}


def _parser(refs: dict[str, bytes]) -> Parser:
    """One parser per Python worker and set of references."""
    key = hash(tuple(sorted(refs.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(refs)
    return _parsers[key]


def predict(docs: DataFrame, refs: dict[str, bytes]) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score); texts that are null or have no letter are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for b in batches:
            langs, scores, held, size = [], [], [], 0
            for text in [*b.column(1), None]:
                if text is not None:
                    held.append(text.as_py())
                    size += len(held[-1] or "")
                if held and (text is None or size > TOGETHER):
                    names, values = parser.predict(held)
                    langs += names
                    scores += values.tolist()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from documents with a language whose crc32(doc_id) mod 4 is not 2: from ``SAMPLED`` whole texts of each, of
    ``MOST_BYTES`` bytes together at most. A text that ties goes to the language that sorts first. Null texts and texts without a letter are ``und``; texts of
    any length are parsed whole. Repeated rows each give a row; with no labelled row everything is ``und``; an empty
    table gives no rows; other columns are ignored.
    """
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    done = predict(docs, references(docs.where(~held_out)))
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
