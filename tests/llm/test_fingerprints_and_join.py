"""Fingerprints and the Jaccard join against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import ODD, SF_SMALL, make_docs, sf_docs  # noqa: F401
from pyspark.sql import functions as F

from taxolens.llm import fingerprints as P
from taxolens.llm import jaccard_join as J
from taxolens.llm.common import components, shingle_set, sorted_groups


def test_fingerprints_equal_brute_force(spark, sf_docs):
    got = {r["doc_id"]: r for r in P.fingerprint(sf_docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in sf_docs.collect())
    assert len(got) == len(rows)

    def grams(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    errors = []
    for k, (d, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[:len(text) - q] + nxt[:q]
        r = got[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = grams(text), grams(edited), grams(nxt)
        errors.append((r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)))
        if len(a | b) < P.K:
            assert abs(errors[-1][0]) < 1e-9
        assert abs(r["distinct"] / max(1, len(a)) - 1) < 0.5
        assert abs(r["contained"] - len(a & b) / len(a)) < 0.3
    assert np.abs(errors).max() < 0.25 and np.abs(errors).mean() < 0.04


def test_equal_texts_have_equal_fingerprints_and_odd_rows_pass(make_docs):
    out = P.fingerprint(make_docs(ODD, ("_b", "_copy", "sk", "next_text"))).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[7]["fingerprint"] == by[8]["fingerprint"] and by[1]["fingerprint"] == by[2]["fingerprint"] == ""
    assert by[1]["near_next"] == 1.0 and by[2]["near_next"] == 1.0 and by[4]["near_next"] in (0.0, 1.0)
    assert by[None]["edited_sha256"] == hashlib.sha256("no id here at all today"[:-5].encode()).hexdigest()


def test_fingerprints_of_an_empty_table_and_of_one_row(make_docs):
    assert P.fingerprint(make_docs([])).collect() == []
    r = P.fingerprint(make_docs([(9, "a b c d e f g h")])).collect()[0]
    assert r["near_next"] == 1.0


def test_part_sketches_merge_to_the_sketch_of_the_whole(spark):
    whole = " ".join(f"w{i}" for i in range(900))
    words = whole.split()
    parts = [(1, " ".join(words[i:i + 104])) for i in range(0, 900, 100)] + [(2, "")]
    df = spark.createDataFrame(parts, "g int, t string").select("g", P.sketch(F.col("t")).alias("sketch"))
    got = {r["g"]: r["sketch"] for r in P.merge_groups(df, "g").collect()}
    want = spark.createDataFrame([(whole,)], "t string").select(P.sketch(F.col("t")).alias("s")).first()["s"]
    assert got[1] == want and got[2] == []


def test_next_rows_cross_range_buckets(spark, make_docs, monkeypatch):
    ids = random.Random(3).sample(range(10**12), 300)
    out = P.fingerprint(make_docs([(i, f"{i}") for i in ids])).collect()
    order = sorted(ids)
    nxt = {a: b for a, b in zip(order, order[1:] + order[:1])}
    for r in out:
        t, n = str(r["doc_id"]), str(nxt[r["doc_id"]])
        q = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()


def brute(rows, threshold=0.8):
    """Classes and link counts by comparing all pairs."""
    sets = [set(shingle_set(t or "").tolist()) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            near = a == b or len(a & b) >= threshold * len(a | b) - 1e-9
            if near:
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {rows[i][0]: (least[root(i)], links[i]) for i in range(n)}


def test_join_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in
           J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_recall_of_pairs_in_buckets_that_go_deep(spark, monkeypatch):
    """Pairs at the threshold among sets that share a quarter of their values, so buckets of strangers go deep."""
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "CORE", 0.999)  # strangers are no candidates of a pivot
    rng = np.random.default_rng(6)
    pairs = 750
    pool = rng.integers(0, 1 << 63, (4, J.N_HASH), dtype=np.uint64)
    low = np.repeat(pool[rng.integers(0, 4, (pairs, J.N_HASH)), np.arange(J.N_HASH)], 2, axis=0)
    for row in low[1::2]:
        row[rng.permutation(J.N_HASH)[:25]] = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    roots = [np.array([J.hash_int(17, r)], np.uint64) for r in range(J.runs_for(J.RECALL))]
    rows = [(i, 100, J.short_values(v).tobytes(),
             np.concatenate([J.children(v[None, :], p, J.THRESHOLD)[0] for p in roots]).tolist())
            for i, v in enumerate(low)]
    reps = J.keep(spark.createDataFrame(rows, "node long, n long, mh binary, paths array<long>"))
    near = {i: {i} for i in range(2 * pairs)}
    for r in J.candidate_links(reps).collect():
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    # linked, or both linked to the same set
    found = sum(not near[2 * k].isdisjoint(near[2 * k + 1]) for k in range(pairs))
    assert found >= pairs * J.RECALL


@pytest.mark.parametrize("leaf,tile", [(128, 128), (8, 8)])
def test_large_groups_split_and_lose_no_link(spark, monkeypatch, leaf, tile):
    """Groups far beyond a bucket and a tile: near copies, copies, and a passage that all texts share."""
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "MAX_DEPTH", 3)
    rnd = random.Random(5)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]
    rows += [(200 + i, passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(60))) for i in range(60)]
    rows += [(300 + i, t) for i, t in enumerate(["", "", "short text", "short text", "other"])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in
           J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


@pytest.mark.parametrize("send", [J.SEND_BYTES, 0] if hasattr(J, "SEND_BYTES") else [0])
def test_wide_rows_of_large_buckets_stay_in_place(spark, monkeypatch, send):
    """A level finds its pivots without a join with all sets, and deals no embeddings out if little is joined to them."""
    plans = []

    def keep(df):
        if "mh" in df.columns or "pivot_mh" in df.columns:
            plans.append((tuple(df.columns), df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df)

    real = J.keep
    monkeypatch.setattr(J, "keep", keep)
    monkeypatch.setattr(J, "SEND_BYTES", send, raising=False)
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "MAX_DEPTH", 3)
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(base[:60] + [f"q{rnd.randrange(10**6)}" for _ in range(15)])) for i in range(60)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in
           J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    pivots = [p for c, p in plans if "pivot_mh" in c]
    assert pivots and not any("Join" in p for p in pivots)
    deeper = [p for c, p in plans if c[0] == "kind"]
    assert deeper and all(("strategy=broadcast" in p) == (send > 0) for p in deeper)


def test_join_takes_odd_rows(make_docs):
    out = J.near_duplicates(make_docs(ODD, ("digest", "node", "path", "mh", "n", "comp")))
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["class_id"] == 7 and by[2]["class_id"] == 1 and by[3]["class_id"] == 1
    assert by[None]["class_id"] is None and by[None]["n_links"] == 0 and by[4]["n_copies"] == 1
    left = J.drop_near_duplicates(make_docs(ODD, ("digest", "node")))
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7]
    assert "node" in left.columns and left.filter("doc_id is null").count() == 1
    assert J.near_duplicates(make_docs([])).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (7, *range(200, 260))} == {7}
    assert 5 not in got


@pytest.mark.parametrize("n_edges", [60, 130])
def test_components_of_random_graphs(spark, n_edges):
    rng = random.Random(n_edges)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(n_edges)]
    least = list(range(150))
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == {x: least[x] for e in edges if e[0] != e[1] for x in e}
    assert len(got) == len({r["node"] for r in got})


def test_sorted_groups_join_batches():
    import pandas as pd
    k = [1, 1, 2, 2, 2, 3, 4, 4]
    for cut in range(9):
        df = pd.DataFrame({"k": k, "v": range(8)})
        got = [g["v"].tolist() for g in sorted_groups([df[:cut], df[cut:]], ["k"])]
        assert got == [[0, 1], [2, 3, 4], [5], [6, 7]]
