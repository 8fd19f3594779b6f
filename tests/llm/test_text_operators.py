"""Decontamination, HTML extraction, license scans, token files, URL filters, SentencePiece."""

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import ODD, SF_MID, SF_SMALL, make_docs, sf_docs  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as E
from taxolens.llm import decontaminate as D
from taxolens.llm import html_extract as H
from taxolens.llm import license_scan as L
from taxolens.llm import sentencepiece_fst as S
from taxolens.llm import token_store as K
from taxolens.llm import url_filter as U
from taxolens.llm.common import hash_words, lower_words


@pytest.mark.parametrize("name", ["op5_license_scan", "op9_url_filter"])
def test_queries_equal_sql(spark, duck, name):
    def rows(pdf):
        cols = sorted(pdf.columns)
        pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in pdf.itertuples(index=False)), key=repr)

    got = E.queries()[name](spark, SF_SMALL).toPandas()
    assert rows(got) == rows(duck(SF_SMALL).execute(E.oracle_sql()[name]).df())


# decontamination --------------------------------------------------------------------------------

def brute_align(item, window):
    h = np.zeros((len(item) + 1, len(window) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if item[i - 1] == window[j - 1] else D.MISS),
                          h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return h.max()


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        score, matched, first, last = D.align(a, b)
        assert abs(score - brute_align(a, b)) < 1e-9
        assert 0 <= matched <= min(len(a), len(b)) and (score == 0 or 0 <= first <= last < len(b))


def test_edited_copies_are_found_and_clean_texts_left(spark, make_docs):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choices(words, k=30))) for k in range(12)] + [(50, None), (51, ""), (52, "w1 w2")]
    rows, want = [], set()
    for d in range(60):
        body = rnd.choices(words, k=80)
        if d % 3 == 0:
            k = rnd.randrange(12)
            copy = items[k][1].split()
            for _ in range(d % 5):
                copy[rnd.randrange(len(copy))] = "edit"
            if d % 2:
                del copy[rnd.randrange(len(copy))]
            body[40:40] = copy
            want.add((d, k))
        rows.append((d, " ".join(body).upper() if d % 4 == 0 else " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows + [(100, None), (101, ""), (None, items[3][1])], ("item_id", "score"))
    found = D.find_items(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] != 52}
    assert got == want | {(None, 3)}
    by = {(r["doc_id"], r["item_id"]): r for r in found}
    assert by[None, 3]["score"] == 1.0 and (by[None, 3]["first_word"], by[None, 3]["last_word"]) == (0, 29)
    left = D.drop_contaminated(docs, bench.filter("item_id <> 52"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want} | {100, 101}
    assert left.columns == docs.columns
    assert D.find_items(make_docs([]), bench).collect() == []
    assert D.find_items(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("step", [-1, 2, 3, 4, 5, 6, 7])
def test_copies_with_edits_at_every_step_are_found(spark, make_docs, step, exact):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    items = [(k, rnd.choices(words, k=rnd.randint(12, 40))) for k in range(15)]
    rows, want = [], set()
    for k, item in items:
        if step < 0:  # a word put in after each
            copy = [x for j, w in enumerate(item) for x in (w, f"x{j}")]
        else:
            copy = [f"x{j}" if j % step == step - 1 else w for j, w in enumerate(item)]
        text = rnd.choices(words, k=20) + copy + rnd.choices(words, k=20)
        if brute_align(item, text) >= D.CUT * len(item):
            want.add((k, k))
        rows.append((k, " ".join(text)))
        if exact:
            rows.append((100 + k, " ".join(item)))
            want.add((100 + k, k))
    assert step == 2 or len(want) == len(rows)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_items(make_docs(rows), bench).collect()} == want


def test_blocks_of_a_large_benchmark_give_the_same_rows(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, D.find_items(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, D.find_items(docs, bench).collect())) == want and want


# HTML -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="post ad-free"><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div>
<div id="cookie-notice">cookies</div><article><h1>Head &amp; more</h1><p><b>First  line<br>goes &eacute; on<p>a &lt; b
<ul><li>one<li>two</ul><form><input name=q>find</form><div class="share social">share</div>
<div title="a>b">in  div</div><!-- no --><section class="comments"><p>a reader</p></section></article>
<aside>side</aside><footer>&copy; x &middot; y</footer></body></html>"""


def test_main_text_of_a_page():
    assert H.main_text(PAGE) == "Head & more\nFirst line goes é on\na < b\none\ntwo\nin div"
    for end in range(len(PAGE)):
        assert "menu" not in H.main_text(PAGE[:end]) and "buy" not in H.main_text(PAGE[:end])
    assert H.main_text("") == "" and H.main_text(None) == ""
    assert H.main_text("plain &am") == "plain &am"
    assert H.main_text("<p>a</p><p>b") == "a\nb"


def test_classes_name_the_article_of_a_host_without_article_elements(spark):
    def page(k):
        return (f"<html><body><div class='top'>Site name</div><div class='body'><div class='x'>Always here</div>"
                f"<p>text {k} of page</p><p>more {k * 7} text</p></div><div class='low'>w{k}</div></body></html>")

    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://one/",
            "<div>only <p>page")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    classes = H.templates(pages).filter("host = 'h.org'").first()["classes"]
    places = {m["place"].rpartition(">")[2]: c["pages"] for c in classes for m in c["members"]}
    assert places["div.body"] == 12 and places["p"] == 12
    out = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert len(out) == len(rows) and out[3] == "text 3 of page\nmore 21 text"
    assert out[50] == out[51] == "" and out[52] == "only\npage"
    assert H.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, text", [
    ('<main class="content has-sidebar"><p>a b</p></main>', "a b"),
    ('<article class="post share-enabled"><p>x</p></article>', "x"),
    ('<div id="page" class="with-header"><article>y</article></div>', "y"),
    ('<div class="sidebar"><article>in</article></div>', "in"),
    ('<article>k<div class="search-results">r</div><div class="legal">l</div></article>', "k\nr\nl"),
    ('<article>k<div class="site-footer">f</div><div class="ad-slot">g</div></article>', "k"),
    ('<main>m<article class="comment">no</article></main><div class="comments"><article>c</article></div>', "m"),
    ('<div class="nav-menu">n</div><nav><article>no</article></nav>t', "t"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article><p>" + "long text " * 50000 + "</article>", ("long text " * 50000).strip())])
def test_names_drop_neither_an_article_nor_what_is_around_it(page, text):
    assert H.main_text(page) == text


def test_deep_places_and_long_names_stay_apart_and_short():
    deep = [e[1] for e in H.walk("<div>" * 500) if e[0] == "open"]
    assert len(set(deep)) == 500 and max(map(len, deep)) < 64 * 4 + 32
    long = [[e[1] for e in H.walk(f"<div class='{'x' * 5000}{c}'>") if e[0] == "open"][0] for c in "ab"]
    assert long[0] != long[1] and max(map(len, long)) < 50


def mixed_pages():
    """Three templates on one host: articles, stories and notes."""
    rows = []
    for k in range(30):
        body = (f"<article><p>item {k}</p></article>",
                f"<div class='story'><p>story {k} is told</p><b>Always so</b></div><div class='low'>by {k}</div>",
                f"<section class='note'><i>note {k} of a hand</i></section><div class='low'>by {k}</div>")[k % 3]
        rows.append((k, "https://Mix.org/x", f"<html><body><div class='top'>Name of site</div>{body}</body></html>"))
    return rows


def test_equivalence_classes_equal_occurrence_vectors(spark):
    rows = mixed_pages()
    vectors: dict[str, list] = {}
    for k, (_, _, page) in enumerate(rows):
        for e in H.walk(page):
            if e[0] == "open":
                vectors.setdefault(e[1], [0] * len(rows))[k] += 1
    want: dict[tuple, set] = {}
    for place, v in vectors.items():
        want.setdefault(tuple(v), set()).add(place)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got: dict[int, set] = {}
    for r in H.equivalence_classes(pages).collect():
        got.setdefault(r["sig"], set()).add(r["place"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("limit", [H.BROADCAST_BYTES, -1])
def test_pages_of_several_templates_are_read_by_their_own(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame(mixed_pages(), "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert out == {k: (f"item {k}", f"story {k} is told", f"note {k} of a hand")[k % 3] for k in range(30)}


def test_joined_templates_give_the_same_rows(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    want = sorted(map(tuple, H.extract(pages).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, H.extract(pages.withColumn("text", F.lit(1)))
                      .select("page_id", "url", "text", "n_chars").collect())) == want
    assert all(r[3] == len(r[2]) for r in want) and len(want) == pages.count()


# licenses ---------------------------------------------------------------------------------------

def test_places_and_blocks(make_docs):
    rows = [(1, "The MIT License, mit license."), (2, "x\nReleased under MIT the License\ny"),
            (3, "apache\nlicense"), (4, "GNU  General-Public license é"), (5, "all rights"),
            (6, "mit permission is hereby granted free of charge to any person obtaining a copy of this software and"
                " documentation files")]
    out = {r["doc_id"]: r for r in L.scan(make_docs(rows, ("labels",))).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (2, 1, 3, "mit")
    assert out[2]["base_labels"] == "" and out[2]["labels"] == "MIT" and out[2]["score"] == 1.0
    assert out[3]["base_labels"] == "apache" and out[4]["base_labels"] == "gpl"
    assert out[5]["labels"] == "" and out[5]["score"] == 0.0
    assert out[6]["labels"] == "MIT" and 0.8 <= out[6]["score"] < 1


def test_filters_lose_no_block_at_any_order():
    rnd = random.Random(2)
    sets = L.template_words()
    words = sorted({w for t, _ in sets for w in t})
    index = L.TemplateIndex(sets, {w: rnd.randrange(50) for w in words})
    for _ in range(400):
        t, _ = rnd.choice(sets)
        block = rnd.sample(sorted(t), rnd.randint(1, len(t))) + rnd.sample(words, rnd.randint(0, 6)) + [b"zz"]
        want = sorted((label, len(t & set(block)) / len(t)) for t, label in sets
                      if len(t & set(block)) >= L.least(len(t)))
        assert sorted(index.join(block)) == want


def test_license_scan_takes_odd_rows(spark, duck, make_docs):
    out = L.scan(make_docs(ODD, ("n", "w", "labels"))).collect()
    assert len(out) == len(ODD) and {r["doc_id"]: r["n_words"] for r in out}[5] == 90_000
    assert L.scan(make_docs([])).collect() == []


# token files ------------------------------------------------------------------------------------

def test_token_files_round_trip(spark, sf_docs, make_docs, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(K.default_vocabulary())
    odd = make_docs([(i + 10**6 if i else i, t) for i, t in ODD], ())
    docs = sf_docs.unionByName(odd)
    folder = f"file://{tmp_path}/ids"
    K.write(docs.withColumn("shard", F.lit(1)), folder)
    got = K.read_digest(spark, folder).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [
        (s, d, n, c) for d, s, n, c in want]
    one = K.read_documents(spark, folder, [rows[20][0], 10**9]).collect()
    assert [r["ids"] for r in one] == [tok.encode(rows[20][1], add_special_tokens=False).ids + [1]]


def test_blocks_split_and_an_empty_table(spark, make_docs, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "BLOCK_DOCS", 3)
    docs = make_docs([(i, f"text number {i}") for i in range(20)])
    out = K.round_trip(docs).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == list(range(20))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(out, out[1:])) and out[0]["start"] == 0
    assert K.round_trip(make_docs([])).collect() == []


# urls -------------------------------------------------------------------------------------------

URLS = [(1, "http://A.Example.com/en/1?x"), (2, "https://www.example.com/en/"), (3, "x://spam-farm.example.org/q#t"),
        (4, "http://h.example.net/es/"), (5, None), (6, "no scheme"), (7, "http://net/fr/a?b#c"), (8, "http://a.com"),
        (9, "ftp://xcom/"), (10, ""), (11, "http://adults.org/"), (3, "x://spam-farm.example.org/q#t")]


def test_rules_and_listed_hosts(spark, duck):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("spam-farm.example.org", "/q", None, "block")
    assert got[4][2:] == ("net/es/", "block") and got[7] == ("net", "/fr/a", "net/fr/", "block")
    assert got[5] == got[6] == got[10] == ("", "", None, "allow")
    assert got[8] == ("a.com", "", None, "allow") and got[9][2] is None and got[11][3] == "allow"
    assert U.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [32_000_000, 600])
def test_cascade_is_exact_on_its_universe(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionAll(
        spark.createDataFrame([(None, -1), ("k7", 7)], "key string, id long"))
    listed = keys.filter("id % 9 = 0").select("key").unionByName(spark.createDataFrame([("far",)], "key string"))
    out = U.member(keys, "key", listed, keys).collect()
    assert len(out) == 4002 and all(r["listed"] == (r["id"] >= 0 and r["id"] % 9 == 0) for r in out)
    none = U.member(keys, "key", listed.limit(0), keys)
    assert none.filter("listed").count() == 0


# SentencePiece ----------------------------------------------------------------------------------

def test_ids_equal_the_public_library(spark, sf_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    for r in S.encode(sf_docs).join(sf_docs.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == sp.encode(r["text"]) and r["round_trip"] and r["n_pieces"] == len(r["ids"])


def test_odd_texts_equal_the_public_library(spark, make_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    rnd = random.Random(6)
    alphabet = "abtheio  ,.!&%$#*|\n\t-²é漢🙂'\"0123456789()"
    rows = [(k, "".join(rnd.choices(alphabet, k=rnd.randint(1, 60)))) for k in range(300)]
    rows += [(i + 1000, t) for i, t in ODD if i and i != 5] + [(None, "x  y"), (5000, "the same words " * 3000)]
    out = S.encode(make_docs(rows, ("ids",))).collect()
    text = {i: t or "" for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == sp.encode(text[r["doc_id"]]), text[r["doc_id"]]
        assert r["round_trip"] == ("▁" not in text[r["doc_id"]])
    back = S.decode(S.encode(make_docs(rows))).collect()
    assert all(r["text"] == text[r["doc_id"]].replace("▁", " ") for r in back)
    assert S.encode(make_docs([])).collect() == []


def test_least_path_equals_enumeration():
    fst = S.Transducer(S.default_model(), "unigram")

    def every(part):
        if not part:
            yield []
        for n in range(1, min(len(part), fst.longest) + 1):
            if part[:n] in fst.score:
                for rest in every(part[n:]):
                    yield [part[:n], *rest]

    for word in ("▁the", "▁thing", "ation", "▁reer", "abcabc"):
        cost = min(sum(-fst.score[p] for p in path) for path in every(word))
        assert sum(-fst.score[p] for p in fst.path(word)) == cost


def test_words_hash_alike():
    assert lower_words("The  MIT-license É") == [b"the", b"mit", b"license", "é".encode()]
    assert (hash_words([b"a", b"b"]) == hash_words([b"a", b"b"])).all()
