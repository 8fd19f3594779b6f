"""Quality and toxicity: held-out accuracy, the named methods against plain versions, odd rows."""

import zlib

import numpy as np
import pytest
from llm_fixtures import ODD, SF_MID, make_docs, sf_docs  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as E
from taxolens.llm import quality as Q
from taxolens.llm import toxicity as T


def auc(score, label):
    one, zero = score[label == 1], score[label == 0]
    return float(np.mean((one[:, None] > zero[None, :]) + 0.5 * (one[:, None] == zero[None, :])))


@pytest.mark.parametrize("name,label,cut,k,rest,least", [("op1_quality", "quality", 0.3, 5, 0, 0.95),
                                                        ("op7_toxicity", "toxic", 0.7, 3, 1, 0.8)])
def test_held_out_accuracy(spark, name, label, cut, k, rest, least):
    out = E.queries()[name](spark, SF_MID).toPandas()
    assert len(out) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert out["score"].between(0, 1).all() and ((out["score"] >= cut) == (out["predicted"] == 1)).all()
    held = out["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % k == rest)
    assert (held == out["held_out"]).all()
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet").toPandas()
    m = out[out["held_out"]].merge(lab, on="doc_id")
    assert auc(m["score"].to_numpy(), m[label].to_numpy()) > least


def test_density_gap_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    d = len(Q.STATS)
    a, b = rng.normal(size=(d, d)), rng.normal(size=(d, d))
    cov = {0: a @ a.T + np.eye(d), 1: b @ b.T + np.eye(d)}
    model = Q.QualityModel(np.zeros(d), np.ones(d), {0: rng.normal(size=d), 1: rng.normal(size=d)},
                           {c: np.linalg.cholesky(cov[c]) for c in cov},
                           {c: np.linalg.slogdet(cov[c])[1] for c in cov})
    x = rng.normal(size=(7, d))
    want = []
    for row in x:
        logs = [-0.5 * (row - model.means[c]) @ np.linalg.inv(cov[c]) @ (row - model.means[c])
                - 0.5 * np.linalg.slogdet(cov[c])[1] for c in (0, 1)]
        want.append(logs[1] - logs[0])
    assert np.allclose(model.density_gap(x), want)


def test_moments_do_not_depend_on_partitions(spark, sf_docs):
    rng = np.random.default_rng(2)
    rows = [([float(v) for v in rng.normal(size=len(Q.STATS))], int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, quality int")
    one, many = Q._gather(df.repartition(1)), Q._gather(df.repartition(7))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for c in (0, 1):
        assert one[c][0] == many[c][0] == (y == c).sum()
        assert np.allclose(one[c][2], x[y == c].T @ x[y == c]) and np.allclose(one[c][2], many[c][2])


def brute_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((total[j + 1] - total[i], -(j - i), -i, i, j) for i in range(len(scores))
                for j in range(i, len(scores))))
    _, _, _, i, j = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j + 1:])
    return left + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in right]


def test_segments_equal_the_recursive_definition():
    rng = np.random.default_rng(4)
    for _ in range(200):
        w = rng.normal(-0.3, 1.0, rng.integers(1, 25))
        got = [(a, b) for a, b, _ in T.segments(np.arange(len(w)), w, -0.1)]
        assert got == brute_segments(w.tolist())
    sparse = T.segments(np.array([3, 5, 40]), np.array([2.0, 2.0, 3.0]), -0.5)
    assert [(a, b) for a, b, _ in sparse] == [(3, 5), (40, 40)] and abs(sparse[0][2] - 3.5) < 1e-9


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (4, 0, 0), (5, 0, 1), (7, None, None), (8, 1, 0),
                                  (None, 1, 1), (6, 9, 9)], "doc_id long, quality int, toxic int")


def test_odd_rows_and_few_labels(spark, make_docs):
    docs = make_docs(ODD, ("x", "stat", "toxic", "quality", "score"))
    for labels in (odd_labels(spark), odd_labels(spark).limit(0), odd_labels(spark).filter("doc_id = 8")):
        seen = Q.describe(docs)
        q = Q.score(seen, Q.learn(seen, labels, F.lit(True))).collect()
        model = T.learn(docs, labels, F.lit(True))
        t = T.score(docs, model).collect()
        for out in (q, t):
            assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
            by = {r["doc_id"]: r["score"] for r in out}
            assert by[7] == by[8] and by[1] == by[2]
        assert T.drop_toxic(docs, model).columns == docs.columns
    empty = make_docs([])
    assert Q.score(Q.describe(empty), Q.learn(Q.describe(empty), odd_labels(spark), F.lit(True))).collect() == []
    assert T.score(empty, T.learn(empty, odd_labels(spark), F.lit(True))).collect() == []


def test_passages_name_the_toxic_words(spark, make_docs):
    rows = [(i, f"plain words number n{i} stand here" + (" you utter zork" if i % 4 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = T.learn(make_docs(rows), labels, F.lit(True))
    out = {r["doc_id"]: r for r in T.score(make_docs(rows + [(900, "a zork b")]), model).collect()}
    assert out[0]["score"] > 0.7 > 0.3 > out[1]["score"]
    assert [(s["first"], s["last"]) for s in out[0]["spans"]] == [(6, 8)]
    assert out[900]["score"] > out[1]["score"]


def test_every_occurrence_of_a_text_is_scored():
    """Segments of texts against the recursive definition over the weights of all words, stutters as the rest."""
    weights = {"zork": 2.0, "grub": 1.25, "vil*": 0.75, "vilest": 3.0, "mild": -1.5}
    cache, rest = T.WordWeights(weights), -0.2
    word = {**weights, "vilest": 3.0, "vile": 0.0, "plain": 0.0, "so": 0.0}
    rng = np.random.default_rng(8)
    names = ["zork", "grub", "vilest", "mild", "plain", "so"]
    for _ in range(200):
        words = [names[k] for k in rng.integers(0, len(names), rng.integers(0, 30))]
        flat = [rest if not word[w] or (i and words[i - 1] == w) else word[w] for i, w in enumerate(words)]
        found, n = T.scored_segments(" ".join(words), cache, rest)
        assert n == len(words) and [(a, b) for a, b, _ in found] == brute_segments(flat)
        assert all(abs(s - sum(flat[a:b + 1])) < 1e-9 for a, b, s in found)
    assert T.scored_segments("", cache, rest) == ([], 0)


def test_a_dense_passage_after_the_same_words_scattered_is_found():
    model = T.ToxicModel({"zork": 4.0, "grub": 4.0, "mump": 4.0}, -0.05, 1.0, 0.1)
    plain = "a plain word stands here and goes on so".split() * 9
    text = " ".join(["zork", *plain, "grub", *plain, "mump", *plain, "zork grub mump"])
    found, n = T.scored_segments(text, T.WordWeights(model.weights), model.rest)
    best = max(found, key=lambda f: f[2])
    assert best[:2] == (n - 3, n - 1) and abs(best[2] - 12.0) < 1e-9
    assert T.chance_log(best[2], n, model) < np.log(T.MAX_E)


def test_extreme_values_are_fitted():
    rng = np.random.default_rng(5)
    words = rng.integers(50, 400, 20000)
    rate, chance = 0.7, 0.004
    best = np.maximum(0.0, (np.log(chance * words) - np.log(rng.exponential(size=len(words)))) / rate)
    got = T.extreme_value_fit([(float(s), 1, int(n)) for s, n in zip(best, words)])
    assert abs(got[0] - rate) < 0.03 and abs(got[1] - chance) < 0.0004
    assert T.extreme_value_fit([]) == (1.0, 0.5) and T.extreme_value_fit([(0.0, 3, 10)]) == (1.0, 0.05)


def test_rest_and_weights_follow_token_counts():
    y1 = {"vile": (30, 90), "vilest": (20, 40), "vile*": (20, 40), "the": (100, 900)}
    y0 = {"vile": (1, 1), "the": (1000, 9000)}
    weights, rest = T.weigh(y1, y0, (100, 2000), (1000, 20000), 10)
    assert {"vile", "vile*"} <= weights.keys() and "the" not in weights
    assert weights["vile"] > np.log(90 / 2000) - np.log(10 / 20000)
    # "vilest" lies below "vile*", so its occurrences are not taken off twice
    assert abs(rest - (np.log((2000 - 130 + T.PRIOR) / (2000 + T.PRIOR)) -
                       np.log((20000 - 1 + T.PRIOR) / (20000 + T.PRIOR)))) < 1e-9


@pytest.mark.parametrize("most", [100_000, 7])
def test_weights_made_on_executors_are_those_of_all_counts(spark, most):
    """Weighing by stems, with the clean counts thinned by a bitmap, against one process that holds all counts."""
    rng = np.random.default_rng(3)
    words = ["vile", "vilest", "vilely", "villain", "zork", "zorkish", "zorkings", "été", "étérien", "ab", "plain", "plainly"]
    odds = rng.dirichlet(np.ones(len(words)), 2)
    rows = [(" ".join(rng.choice(words, 12, p=odds[y])), int(y)) for y in rng.integers(0, 2, 400)]
    y, sizes = ({}, {}), [[0, 0], [0, 0]]
    for text, toxic in rows:
        flat = [w for k, w in enumerate(text.split()) if not k or w != text.split()[k - 1]]
        sizes[toxic][0] += 1
        sizes[toxic][1] += len(flat)
        here = {}
        for w in flat:
            for f in T.features(w):
                here[f] = here.get(f, 0) + 1
        for f, c in here.items():
            d, n = y[toxic].get(f, (0, 0))
            y[toxic][f] = (d + 1, n + c)
    toxic = {f: c for f, c in y[1].items() if c[0] >= T.MIN_TOXIC_DOCS}
    some = dict(sorted(toxic.items(), key=lambda x: (-x[1][0], x[0]))[:5 * most])
    want, rest = T.weigh(some, y[0], tuple(sizes[1]), tuple(sizes[0]), most)
    df = T.keep(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    got, got_rest = T.learn_weights(df, tuple(sizes[1]), tuple(sizes[0]), most)
    assert want and got == want and got_rest == rest


def test_likely_word_holds_for_all_words(spark):
    from taxolens.llm.common import likely_word
    words = [f"w{k}" for k in range(3000)] + ["é*", "漢字"]
    holds = likely_word(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(map(holds, words)) and sum(holds(f"x{k}") for k in range(3000)) < 300
