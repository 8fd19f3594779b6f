"""Document quality by a regularised quadratic discriminant.

Each whole text becomes a vector of document statistics (:data:`STATS`), shares by a smoothed logit and counts by a
logarithm, standardised on the labelled rows. Class means and covariances come from grouped sums over the labelled
documents; each covariance is shrunk towards the pooled one (``SHARE``) and that towards its mean variance
(``RIDGE``). The Cholesky factors of the two covariances are computed once and cached in the model; a document's
score is the difference of the two log densities (squared Mahalanobis lengths by triangular solves, log
determinants from the diagonals), turned into a probability by a logistic curve fitted on the same labelled rows.

Defined cases: a null text is empty; an empty text has the statistics of no words and gets a score like any other;
null ids are scored and never learned from; labels other than 0 and 1 are ignored, several labels of an id count as
their largest; without labelled rows of both classes every score is the smoothed rate of label 1; other columns pass
by unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import ascii_words, gram_hashes, hash_words, keep, logistic_on_bins, squash

#: Bound on the labelled documents that moments are taken from, drawn by hash of the id.
MAX_LABELLED = 2_000_000
SHARE = 0.2
RIDGE = 0.02
CLIP = 8.0
CUT = 0.3

STATS = ("log_words", "word_length", "distinct_words", "top_word", "same_neighbour", "repeated_grams", "upper",
         "symbols", "digits", "stops", "words_per_line", "repeated_lines", "symbol_lines", "upper_lines",
         "wordless_tokens", "short_words")

_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_STOP = b".?!"
_PLAIN = bytes(set(range(0x21)) | set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B))
               | set(range(0x7F, 0x100)) | set(b".,'\"-?:;()"))


def _logit(part: float, whole: float, a: float = 0.5) -> float:
    return math.log((part + a) / (max(whole - part, 0.0) + a))


def _share(part: float, whole: float, size: float = 200.0) -> float:
    """Logit of a share, smoothed as if every text had ``size`` units, so short texts stay comparable."""
    p = part / whole if whole else 0.0
    return _logit(p * size, size)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of :data:`STATS`."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = ascii_words(text)
    m = len(words)
    tokens = raw.split()
    upper, digits = n - len(raw.translate(None, _UPPER)), n - len(raw.translate(None, _DIGIT))
    odd = len(raw.translate(None, _PLAIN))
    h = hash_words(words)
    _, counts = np.unique(h, return_counts=True)
    grams = gram_hashes(h, 5) if m >= 5 else h[:0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    again = odd_lines = upper_lines = 0
    for x in lines:
        k = len(x)
        if x in seen:
            again += k
        seen.add(x)
        if len(x.translate(None, _PLAIN)) * 20 > k:
            odd_lines += k
        if (k - len(x.translate(None, _UPPER))) * 3 > k:
            upper_lines += k
    body = sum(map(len, lines))
    return [
        math.log1p(m),
        math.log1p(sum(map(len, words)) / m) if m else 0.0,
        _share(len(counts), m) / math.log(m + 3.0),
        _share(int(counts.max()) if m else 0, m),
        _share(int((h[1:] == h[:-1]).sum()) if m > 1 else 0, m),
        _share(len(grams) - len(np.unique(grams)), len(grams)),
        _share(upper, n), _share(odd, n), _share(digits, n),
        _share(sum(raw.count(bytes([c])) for c in _STOP), len(tokens)),
        math.log1p(m / len(lines)) if lines else 0.0,
        _share(again, body), _share(odd_lines, body), _share(upper_lines, body),
        _share(max(len(tokens) - m, 0), len(tokens)),
        _share(sum(len(w) <= 2 for w in words), m),
    ]


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    means: dict[int, np.ndarray]
    factors: dict[int, np.ndarray]
    log_dets: dict[int, float]
    slope: float = 0.0
    offset: float = 0.0

    def density_gap(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, a row for each row of statistics."""
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        out = {}
        for c in (0, 1):
            y = np.linalg.solve(self.factors[c], (z - self.means[c]).T)
            out[c] = -0.5 * (y * y).sum(axis=0) - 0.5 * self.log_dets[c]
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.slope == 0.0:
            return np.full(len(x), float(squash(np.array([self.offset]))[0]))
        return squash(self.slope * np.tanh(self.density_gap(x) / 40.0) * 40.0 + self.offset)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its statistics ``x`` (array of double) for every document."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInPandas(run, "doc_id long, x array<double>")


def _moments(pdfs, centre=None, scale=None):
    """Count, sum and sum of products by class of one task's rows, as rows of arrays."""
    d = len(STATS)
    acc = {c: [0, np.zeros(d), np.zeros((d, d))] for c in (0, 1)}
    for pdf in pdfs:
        if not len(pdf):
            continue
        x = np.stack(pdf["x"].to_numpy())
        if centre is not None:
            x = np.clip((x - centre) / scale, -CLIP, CLIP)
        y = pdf["quality"].to_numpy()
        for c in (0, 1):
            v = x[y == c]
            acc[c][0] += len(v)
            acc[c][1] += v.sum(axis=0)
            acc[c][2] += v.T @ v
    yield pd.DataFrame({"c": [0, 1], "n": [acc[c][0] for c in (0, 1)], "s": [acc[c][1] for c in (0, 1)],
                        "q": [acc[c][2].ravel() for c in (0, 1)]})


def _gather(rows: DataFrame, centre=None, scale=None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Class moments: a bounded row from each task, added up position by position on Spark."""
    d = len(STATS)
    part = rows.mapInPandas(lambda it: _moments(it, centre, scale), "c int, n long, s array<double>, q array<double>")
    flat = (part.select("c", "n", F.posexplode(F.concat("s", "q")).alias("i", "v"))
            .groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    out = {}
    for c in (0, 1):
        v = np.zeros(d + d * d)
        n = 0
        for r in flat:
            if r["c"] == c:
                v[r["i"]] = r["v"]
                n = r["n"]
        out[c] = (n, v[:d], v[d:].reshape(d, d))
    return out


def learn(described: DataFrame, labels: DataFrame, train: Column, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """A model from the statistics of the labelled documents that ``train`` (over ``doc_id``) selects."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(train)
           .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rows = keep(described.join(lab, "doc_id").select("doc_id", "x", "quality"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    rows = rows.select("x", "quality")
    d = len(STATS)
    raw = _gather(rows)
    total = raw[0][0] + raw[1][0]
    model = QualityModel(np.zeros(d), np.ones(d), {0: np.zeros(d), 1: np.zeros(d)}, {0: np.eye(d), 1: np.eye(d)},
                         {0: 0.0, 1: 0.0}, 0.0, math.log((raw[1][0] + 1) / (raw[0][0] + 1)))
    if not raw[0][0] or not raw[1][0]:
        return model
    model.centre = (raw[0][1] + raw[1][1]) / total
    var = (np.diag(raw[0][2]) + np.diag(raw[1][2])) / total - model.centre**2
    model.scale = np.sqrt(np.maximum(var, 1e-6))
    got = _gather(rows, model.centre, model.scale)
    cov = {}
    for c in (0, 1):
        n, s, q = got[c]
        model.means[c] = s / n
        cov[c] = q / n - np.outer(model.means[c], model.means[c])
    pooled = (got[0][0] * cov[0] + got[1][0] * cov[1]) / total
    pooled = (1 - RIDGE) * pooled + RIDGE * np.trace(pooled) / d * np.eye(d)
    for c in (0, 1):
        # fewer rows of a class shrink it further
        a = min(1.0, SHARE + d / (got[c][0] + d))
        sig = (1 - a) * cov[c] + a * pooled
        sig = (1 - RIDGE) * sig + RIDGE * np.trace(sig) / d * np.eye(d) + 1e-9 * np.eye(d)
        model.factors[c] = np.linalg.cholesky(sig)
        model.log_dets[c] = 2 * float(np.log(np.diag(model.factors[c])).sum())
    model.slope, model.offset = logistic_on_bins(_calibration(rows, model))
    return model


def _calibration(rows: DataFrame, model: QualityModel) -> list[tuple[float, int, int]]:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                gap = np.tanh(model.density_gap(np.stack(pdf["x"].to_numpy())) / 40.0) * 40.0
                yield pd.DataFrame({"bin": np.round(gap, 1), "quality": pdf["quality"]})

    got = (rows.mapInPandas(run, "bin double, quality int").groupBy("bin")
           .agg(F.sum(1 - F.col("quality")).alias("n0"), F.sum("quality").alias("n1")).collect())
    return [(r["bin"], r["n0"], r["n1"]) for r in got]


def score(described: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every document, from :func:`describe`."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(np.stack(pdf["x"].to_numpy()))})

    return described.mapInPandas(run, "doc_id long, score double")


def drop_poor(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose own text scores at least ``cut``."""
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATS))
            yield pd.Series(model.score(x) if len(x) else np.zeros(0))

    return docs.filter(scored(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= cut)
