"""Toxic passages by maximum-scoring segments.

Features are words and word prefixes. A feature's weight is the log ratio of its rates among the words of toxic and of
clean labelled documents, smoothed by a Dirichlet prior of ``PRIOR`` pseudo words that are split as its next shorter
prefix is (the shortest as the classes are), so rare forms lean on their stem, and by half a word for each class.
A word that directly follows itself is a stutter, which tells nothing new, and counts as no occurrence. A feature enters the model if its
weight is at least ``MIN_WEIGHT`` and its rate among documents, where a repeated word counts once, is ``MIN_Z``
standard errors above that of clean ones, or if it corrects a prefix that did. Every occurrence of a word has the
weight of its longest feature in the model; the words without one have together the log ratio of their rates
(``rest``), which is negative since the model's features take more room in toxic texts, so a clean text drifts down.
All maximal scoring segments of a document are found in one linear scan over its scored words.

The best segment of a clean text of n words is taken to follow the extreme-value law: scores of at least S are
expected ``K n exp(-lambda S)`` times. ``lambda`` and ``K`` are fitted by maximum likelihood to the best segments of
the clean labelled documents, those without a segment as censored at 0. Segments below an expectation of ``MAX_E``
are the significant passages. A document's statistic is minus the log of that expectation, for its strongest passage
and a tenth of it for the others, and a logistic curve fitted on the labelled documents turns it into a score from 0
to 1.

Defined cases: null and empty texts have no passage and get the score of the lowest statistic; null ids are scored
and never learned from; labels other than 0 and 1 are ignored, several labels of an id count as their largest;
repeated rows are scored alike, and each counts in learning; with no labelled rows of both classes every score is the
smoothed rate; other columns pass by unread, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import (
    CACHE_BYTES,
    WordCache,
    keep,
    labelled,
    likely_word,
    logistic_on_bins,
    lower_words,
    squash,
    whole_text,
)

#: Bound on the labelled documents that the weights are learned from, drawn by hash of the id.
MAX_LABELLED = 200_000
#: Bound on the features of a model that is broadcast; the most significant stay.
MAX_FEATURES = 200_000
PRIOR = 4.0
MIN_Z = 3.0
MIN_WEIGHT = 1.0
MIN_TOXIC_DOCS = 3
PREFIXES = (4, 5, 6, 7, 8)
#: Characters that a feature shares with all its prefixes.
STEM = PREFIXES[0]
MAX_REST = -1e-3
RATES = (0.05, 5.0)
MAX_E = 0.05
#: Statistic of a text without a segment: one as good is expected by chance.
LOWEST = 0.0
SPAN = 15.0
CUT = 0.7


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    rest: float = MAX_REST
    rate: float = 1.0
    chance: float = 0.1
    slope: float = 0.0
    offset: float = 0.0


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes, marked by a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class WordWeights(WordCache):
    """Cache from a word's bytes to its weight; 0 stands for the rest."""

    def __init__(self, weights: dict[str, float]):
        def weigh_word(word: bytes) -> float:
            text = word.decode("utf-8", "replace")
            return next((weights[f] for f in (text, *(text[:k] + "*" for k in reversed(PREFIXES) if len(text) > k))
                         if f in weights), 0.0)

        super().__init__(weigh_word)


def segments(at: np.ndarray, scores: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a text, words from 0, in order.

    ``at`` are the positions of the scored words, ``scores`` their weights (not 0); every word between has the
    negative weight ``rest``. Linear time: the words between two scored ones are one step down.
    """
    out: list[list[float]] = []  # first, last, cumulative score before, cumulative score after
    total, prev = 0.0, -1
    for p, s in zip(at.tolist(), scores.tolist()):
        total += rest * (p - prev - 1)
        prev = p
        if s <= 0:
            total += s
            continue
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in out]


def chance_log(score: float, n_words: int, model: ToxicModel) -> float:
    """Log of the number of segments of that score expected by chance in a clean text of n words."""
    return math.log(model.chance * max(1, n_words)) - model.rate * score


def scored_segments(text: str, cache: WordWeights, rest: float) -> tuple[list[tuple[int, int, float]], int]:
    """All maximal scoring segments of a text, every occurrence of a word scored, and its number of words."""
    words = lower_words(text)
    w = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    at = np.array([p for p in np.flatnonzero(w).tolist() if not p or words[p] != words[p - 1]], int)
    return segments(at, w[at], rest), len(words)


def statistic(found: list[tuple[int, int, float]], n_words: int, model: ToxicModel) -> float:
    """Minus the log chance expectation of the strongest passage and a tenth of the other significant ones', bent
    to stay within ``SPAN``."""
    logs = sorted(-chance_log(s, n_words, model) for _, _, s in found)
    if not logs:
        return LOWEST
    total = logs[-1] + 0.1 * sum(x for x in logs[:-1] if x >= -math.log(MAX_E))
    return max(LOWEST, SPAN * math.tanh(total / SPAN))


def extreme_value_fit(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """``(lambda, K)`` of the most likely extreme-value law, from ``(best score, texts, their words)`` of clean texts.

    A best score of 0 stands for a text without a segment, which is censored there. For a given lambda the best K is
    the number of segments by the sum of ``n exp(-lambda S)``, so only lambda is searched, within ``RATES``.
    """
    s, m, n = (np.array(c, float) for c in zip(*bins)) if bins else (np.zeros(0),) * 3
    hit = s > 0
    if not m[hit].sum():
        # no chance segment was seen: half of one is supposed
        return 1.0, 0.5 / max(1.0, n.sum())

    def mass(rate: float) -> float:
        return float(n[~hit].sum() + (n[hit] * np.exp(-rate * s[hit])).sum())

    rates = np.exp(np.linspace(*np.log(RATES), 400))
    count, total = m[hit].sum(), (m[hit] * s[hit]).sum()
    like = [count * math.log(r * count / mass(r)) - r * total for r in rates]
    rate = float(rates[int(np.argmax(like))])
    return rate, float(count / mass(rate))


#: Documents that hold a feature and its occurrences, in one class.
Counts = tuple[int, int]


def next_prefix(feature: str, known) -> str | None:
    """The longest proper prefix feature of a feature that is among the known ones."""
    stem = feature.removesuffix("*")
    return next((p for k in reversed(PREFIXES) if k < len(stem) and (p := stem[:k] + "*") in known), None)


def evidence(y1: dict[str, Counts], y0: dict[str, Counts], all1: Counts, all0: Counts) -> dict[str, tuple[float, float]]:
    """``(weight, z)`` of the features that may enter a model, from counts in toxic (``y1``) and clean (``y0``) texts.

    ``all1`` and ``all0`` are the documents and words of the classes. A feature leans on its prefixes only, so the
    features of one ``STEM`` can be weighed apart from all others.
    """
    (n1, t1), (n0, t0) = all1, all0
    share, words, weight, z, enter = {}, {}, {}, {}, {}
    for f in sorted(y1, key=lambda f: (f.endswith("*") is False, len(f))):
        above = next_prefix(f, share)
        (d1, c1), (d0, c0) = y1[f], y0.get(f, (0, 0))
        q = share[above] if above else n1 / (n1 + n0)
        a, b = d1 + PRIOR * q, d0 + PRIOR * (1 - q)
        share[f] = a / (a + b)
        z[f] = (math.log(a / n1) - math.log(b / n0)) / math.sqrt(1 / a + 1 / b)
        q = words[above] if above else t1 / (t1 + t0)
        a, b = c1 + PRIOR * q + 0.5, c0 + PRIOR * (1 - q) + 0.5
        words[f] = a / (a + b)
        weight[f] = math.log(a / t1) - math.log(b / t0)
        strong = weight[f] >= MIN_WEIGHT and z[f] >= MIN_Z
        corrects = above in weight and z[above] > 0 and abs(weight[f] - weight[above]) > 0.5
        if not strong and not corrects:
            z[f] = 0.0
        if z[f] != 0.0:
            enter[f] = (weight[f], z[f])
    return enter


def rest_of(model, y1: dict[str, Counts], y0: dict[str, Counts], t1: int, t0: int) -> float:
    """Weight of the words without a feature of the model, from its features' counts and the classes' words."""
    # a feature below no other of the model holds all occurrences of those below it
    top = [f for f in model if next_prefix(f, model) is None]
    rest1 = t1 - sum(y1[f][1] for f in top) + PRIOR
    rest0 = t0 - sum(y0.get(f, (0, 0))[1] for f in top) + PRIOR
    return min(MAX_REST, math.log(rest1 / (t1 + PRIOR)) - math.log(rest0 / (t0 + PRIOR)))


def weigh(y1: dict[str, Counts], y0: dict[str, Counts], all1: Counts, all0: Counts,
          max_features: int) -> tuple[dict[str, float], float]:
    """Weights of the features of a model, and of any other word, from counts that one process holds."""
    enter = evidence(y1, y0, all1, all0)
    best = sorted(enter, key=lambda f: (-abs(enter[f][1]), f))[:max_features]
    model = {f: enter[f][0] for f in best if enter[f][0] != 0.0}
    return model, rest_of(model, y1, y0, all1[1], all0[1])


def _weigh_stems(all1: Counts, all0: Counts):
    """The features that may enter a model, from rows of counts that are dealt out and sorted by ``stem``."""
    def weighed(rows: pd.DataFrame) -> pd.DataFrame:
        y1 = {f: (n, c) for f, n, c in zip(rows["feature"], rows["n1"], rows["c1"])}
        y0 = {f: (n, c) for f, n, c in zip(rows["feature"], rows["n0"], rows["c0"])}
        out = [(f, w, z, y1[f][1], y0[f][1]) for f, (w, z) in evidence(y1, y0, all1, all0).items()]
        return pd.DataFrame(out, columns=["feature", "weight", "z", "c1", "c0"])

    def run(batches):
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (rows["stem"] == rows["stem"].iloc[-1]).to_numpy()
            yield weighed(rows[~last])
            rest = rows[last]
        if rest is not None:
            yield weighed(rest)
    return run


def learn_weights(rows: DataFrame, all1: Counts, all0: Counts, max_features: int) -> tuple[dict[str, float], float]:
    """What ``weigh`` gives for the features of ``rows (text, toxic)`` in at least ``MIN_TOXIC_DOCS`` toxic texts.

    Counts stay on the executors: the driver gets a bitmap of the features and those of the model alone.
    """
    schema = "feature string, toxic int, n long, c long"

    def counts(toxic: int, only):
        part = rows.filter(F.col("toxic") == toxic).select("text", "toxic").mapInPandas(_count_features(only), schema)
        return part.groupBy("feature").agg(F.sum("n").alias(f"n{toxic}"), F.sum("c").alias(f"c{toxic}"))

    def first(df: DataFrame, most: int, *order: Column) -> DataFrame:
        return keep(df.orderBy(*order).limit(most)) if df.count() > most else df

    seen = first(keep(counts(1, None).filter(F.col("n1") >= MIN_TOXIC_DOCS)), 5 * max_features,
                 F.col("n1").desc(), F.col("feature"))
    both = (seen.join(counts(0, likely_word(seen.select(F.col("feature").alias("word")))), "feature", "left")
            .select("feature", F.substring("feature", 1, STEM).alias("stem"), "n1", "c1",
                    *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n0", "c0"))))
    enter = keep(both.repartition("stem").sortWithinPartitions("stem").mapInPandas(
        _weigh_stems(all1, all0), "feature string, weight double, z double, c1 long, c0 long"))
    best = first(enter, max_features, F.abs("z").desc(), F.col("feature")).filter("weight <> 0").toArrow()
    names = best["feature"].to_pylist()
    y1, y0 = ({f: (0, c) for f, c in zip(names, best[k].to_pylist())} for k in ("c1", "c0"))
    model = dict(zip(names, best["weight"].to_pylist()))
    return model, rest_of(model, y1, y0, all1[1], all0[1])


def _count_features(only: Callable[[str], bool] | None):
    """Documents and occurrences of a feature in each class: ``(feature, toxic, n, c)`` counted within a task."""
    def wanted(word: bytes) -> list[str]:
        found = features(word.decode("utf-8", "replace"))
        return found if only is None else [f for f in found if only(f)]

    def run(batches):
        docs, found = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        # the lists of features take several times what a cache counts for a word
        known = WordCache(wanted, CACHE_BYTES // 4)

        def rows():
            out = [(f, t, n, found[t][f]) for t, c in docs.items() for f, n in c.items()]
            for c in (*docs.values(), *found.values()):
                c.clear()
            return pd.DataFrame(out, columns=["feature", "toxic", "n", "c"])

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                here: Counter = Counter()
                for w, c in Counter(w for w, _ in groupby(lower_words(text))).items():
                    for f in known[w]:
                        here[f] += c
                docs[int(toxic)].update(here.keys())
                found[int(toxic)].update(here)
                if sum(map(len, docs.values())) > 500_000:
                    yield rows()
        yield rows()
    return run


def _count_words(batches):
    for pdf in batches:
        yield pd.DataFrame({"toxic": pdf["toxic"], "words": [sum(1 for _ in groupby(lower_words(t)))
                                                            for t in pdf["text"]]})


def learn(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int = MAX_LABELLED,
          max_features: int = MAX_FEATURES) -> ToxicModel:
    """Weights and calibration from the labelled documents that ``train`` (over ``doc_id``) selects."""
    rows = keep(labelled(docs, labels, "toxic", train, max_labelled))
    sizes = {r["toxic"]: (r["n"], r["w"]) for r in
             rows.select("text", "toxic").mapInPandas(_count_words, "toxic int, words long")
             .groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w")).collect()}
    (n1, w1), (n0, w0) = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    model = ToxicModel()
    if not n1 or not n0:
        model.offset = math.log((n1 + 1) / (n0 + 1))
        return model
    model.weights, model.rest = learn_weights(rows, (n1, max(1, w1)), (n0, max(1, w0)), max_features)
    best = keep(passages(rows.select("doc_id", "text", "toxic"), model, ["toxic"]).select("toxic", "best", "n_words"))
    clean = (best.filter("toxic = 0").groupBy(F.round("best", 1).alias("s"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("n_words", F.lit(1))).alias("w")).collect())
    model.rate, model.chance = extreme_value_fit([(r["s"], r["n"], r["w"]) for r in clean])
    model.slope, model.offset = logistic_on_bins(_calibration(rows, model))
    return model


def _calibration(rows: DataFrame, model: ToxicModel) -> list[tuple[float, int, int]]:
    stat = passages(rows.select("doc_id", "text", "toxic"), model, ["toxic"])
    got = (stat.withColumn("bin", F.round("stat", 1)).groupBy("bin")
           .agg(F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("n0"),
                F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n1")).collect())
    return [(r["bin"], r["n0"], r["n1"]) for r in got]


def passages(docs: DataFrame, model: ToxicModel, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, stat, best, n_words, spans`` (and the columns ``carry``) of every row.

    ``best`` is the score of the best segment (0: none).
    ``spans`` are the significant passages: first and last word, log-odds, log of the chance expectation.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(model)
    carry = carry or []

    def run(batches):
        fitted = sent.value
        cache, limit = WordWeights(fitted.weights), math.log(MAX_E)
        for pdf in batches:
            stats, best, counts, spans = [], [], [], []
            for text in pdf["text"]:
                found, n = scored_segments(text, cache, fitted.rest)
                stats.append(statistic(found, n, fitted))
                best.append(max((s for _, _, s in found), default=0.0))
                counts.append(n)
                spans.append([(a, b, s, c) for a, b, s in found if (c := chance_log(s, n, fitted)) <= limit])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: pdf[c] for c in carry}, "stat": stats, "best": best,
                                "n_words": counts, "spans": spans})

    kinds = dict(docs.dtypes)
    extra = "".join(f"{c} {kinds[c]}, " for c in carry)
    return docs.select("doc_id", whole_text(), *carry).mapInPandas(
        run, f"doc_id {kinds['doc_id']}, {extra}stat double, best double, n_words long, "
             "spans array<struct<first:long, last:long, score:double, log_chance:double>>")


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score, n_words, spans`` of every document."""
    a, b = model.slope, model.offset
    calibrated = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("stat") * a + b)))
    return passages(docs, model).select("doc_id", calibrated.alias("score"), "n_words", "spans")


def drop_toxic(docs: DataFrame, model: ToxicModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose own text scores below ``cut``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        cache = WordWeights(fitted.weights)
        for texts in parts:
            stat = np.array([statistic(*scored_segments(t, cache, fitted.rest), fitted) for t in texts], float)
            yield pd.Series(squash(fitted.slope * stat + fitted.offset))

    return docs.filter(scored(whole_text()) < cut)
