"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk twice: towards the pooled one (``to_pooled``) and towards a
multiple of the identity (``to_sphere``). Their Cholesky factors are computed once and broadcast; a document's score is
the logistic of the difference of both Gaussian log densities (Mahalanobis distance and log determinant) plus the log
prior ratio.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import crc_mod, free

#: Labelled documents that the model is fitted on, at most about; more labels are thinned by a hash of doc_id.
FIT_ROWS = 16_000
TO_POOLED, TO_SPHERE = 0.25, 0.02
#: Words that count as much as the corpus mean in a short text's statistics, and standard deviations that count. Chosen by
#: four-fold cross-validation among rows to learn from only: with 0, 3, 10 and 30 words and 3 deviations, 16, 7, 0 and 0 of
#: 14,303 good documents are rejected, and no bad one of 2,234 is accepted.
RELIABLE, FURTHEST = 10, 3.0
#: Score from which a document passes.
PASS = 0.3

FEATURES = ("words", "word_len", "word_len_sd", "upper", "digits", "stops", "symbols", "shouts", "beyond_ascii", "distinct", "repeated", "lines_distinct", "words_per_line", "entropy", "sentences", "top_word")
_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()", b"!?", b" \t\n\v\f\r"), 1):
    _KINDS[list(_chars)] = _kind
_KINDS[128:] = 7  # kind 0: any other ASCII character


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text (UTF-8); fractions by square root, sizes and ratios by logarithm."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=seen, minlength=8)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[7])
    share = seen[seen > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())), root(kinds[2] / letters), root(kinds[3] / size), root(kinds[4] / size), root(kinds[0] / size), root(kinds[5] / size),
        root(kinds[7] / size), float(np.log(len(counts) / n)), root(repeated), float(np.log(len(set(lines)) / len(lines))), float(np.log1p(n / len(lines))), float(-(share * np.log2(share)).sum()), root(ends / n), root(max(counts.values()) / n),
    ]


def standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Statistics in standard deviations. Few words say little: all but the number of words shrink towards the mean, and
    no statistic counts beyond a bound, so that no document is rejected for its length or for one odd value."""
    z = (x - centre) / scale
    n = np.expm1(np.maximum(x[:, :1], 0))
    z[:, 1:] *= n / (n + RELIABLE)
    return np.clip(z, -FURTHEST, FURTHEST)


@dataclass(frozen=True)
class Discriminant:
    """A fitted model. ``factors``: per class mean, inverse Cholesky factor and half log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    factors: tuple | None
    prior: float  # log prior ratio, or the constant score's logit if one class is missing

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = standardised(x, self.centre, self.scale)
        logs = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - half for mean, inverse, half in self.factors]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """Classes 0 and 1; with fewer than two rows of a class the score is the smoothed share of class 1."""
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    if min(n0, n1) < 2:
        return Discriminant(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), None, float(np.log((n1 + 1) / (n0 + 1))))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = standardised(x, centre, scale)
    groups = [z[y == k] for k in (0, 1)]
    own = [np.cov(g, rowvar=False, bias=True) for g in groups]
    pooled = (n0 * own[0] + n1 * own[1]) / (n0 + n1)
    factors = []
    for g, s in zip(groups, own, strict=True):
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_sphere) * s + to_sphere * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append((g.mean(axis=0), np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
    return Discriminant(centre, scale, tuple(factors), float(np.log(n1 / n0)))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """(text, *keep) -> (*keep, x: array of the statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py() or b"") for t in b.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(F.col("text").cast("string").alias("text"), *keep).mapInArrow(run, ", ".join([*fields, "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on labelled documents (doc_id, quality) for which ``learn`` holds: by default crc32(doc_id) mod 5 is not 0.

    Rows without id or with another label than 0 and 1 are left out; contradicting labels of a document both count.
    """
    learn = crc_mod(F.col("doc_id"), 5) != 0 if learn is None else learn
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    n = marked.count()
    if not n:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, fit_rows / n) * (1 << 20))
    # About fit_rows rows of two numbers, whatever the labels' size: small enough to broadcast.
    chosen = F.broadcast(marked.where(share).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "quality", "text")
    found = features(rows, "doc_id", "quality").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()
    if not found:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    return fit(np.array([r["x"] for r in found]), np.array([r["quality"] for r in found]))


def score(docs: DataFrame, model: Discriminant, keep: list[str], name: str = "score") -> DataFrame:
    """(*keep, score) for every row; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py() or b"") for t in b.column(0).cast(pa.large_binary())]
            s = shared.value.scores(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], names=[*out, "score"])

    out = [f"c{k}" for k in range(len(keep))]
    fields = T.StructType([*[T.StructField(c, docs.schema[k].dataType) for c, k in zip(out, keep, strict=True)], T.StructField("score", T.DoubleType())])
    picked = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{k}`").alias(c) for c, k in zip(out, keep, strict=True)])
    done = picked.mapInArrow(run, fields)
    return done.select(*[F.col(c).alias(k) for c, k in zip(out, keep, strict=True)], F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = PASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. The score uses the text alone.

    Null texts count as empty; texts of any length are read whole; a score at the threshold passes; repeated rows each
    give a row; without usable labels every score is the prior; an empty table gives no rows; other columns are ignored.
    """
    done = score(docs, train(docs, labels), ["doc_id"])
    return done.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = PASS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, in one pass over the texts."""
    name = free(docs, "score")
    done = score(docs, train(docs, labels), docs.columns, name)
    return done.where(F.col(name) >= threshold).drop(name)
