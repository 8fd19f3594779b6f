"""HTML cleaning vs Python's html.parser; ensemble properties; sampling."""

import html
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import SF_MID
from taxolens.functions.text import clean_html
from taxolens.operators.ensemble import align_labels, majority_vote
from taxolens.operators.tuning import param_grid
from taxolens.sources.tables import read_table


class _Text(HTMLParser):
    SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _ref_clean(s):
    p = _Text()
    p.feed(s)
    p.close()
    return re.sub(r"\s+", " ", " ".join(p.parts)).strip()


def test_clean_html_matches_html_parser(spark):
    pages = read_table(spark, SF_MID, "pages").select("html", clean_html("html").alias("t")).toPandas()
    bad = [i for i, (h, t) in enumerate(zip(pages["html"], pages["t"])) if _ref_clean(h) != t]
    assert not bad, bad[:5]


def test_clean_html_null_and_entities(spark):
    df = spark.createDataFrame([(None,), ("",), ("a &amp;lt; b&nbsp;c",)], "h string")
    assert [r[0] for r in df.select(clean_html("h")).collect()] == ["", "", "a &lt; b c"]
    assert html.unescape("&amp;lt;") == "&lt;"


def test_majority_vote_identity_and_ties(spark):
    rows = [("a", 0, i, i % 3) for i in range(12)] + [("b", 1, i, i % 3) for i in range(12)]
    lab = spark.createDataFrame(rows, "algo string, algo_ord int, row_id long, cluster int")
    got = {r["row_id"]: r["cluster"] for r in majority_vote(lab).collect()}
    assert got == {i: i % 3 for i in range(12)}
    tie = spark.createDataFrame([("a", 0, 0, 5), ("b", 1, 0, 2), ("c", 2, 1, -1)],
                                "algo string, algo_ord int, row_id long, cluster int")
    assert {r["row_id"]: r["cluster"] for r in majority_vote(tie).collect()} == {0: 5, 1: -1}


def test_alignment_recovers_permutation(spark):
    rows = [("ref", 0, i, i % 4) for i in range(40)] + [("perm", 1, i, [2, 3, 0, 1][i % 4]) for i in range(40)]
    lab = spark.createDataFrame(rows, "algo string, algo_ord int, row_id long, cluster int")
    al = align_labels(lab).filter(F.col("algo") == "perm").collect()
    assert all(r["cluster"] == r["row_id"] % 4 for r in al)


def test_param_grid_order():
    assert param_grid({"k": [1, 2], "b": [3, 4]}) == [
        {"k": 1, "b": 3}, {"k": 1, "b": 4}, {"k": 2, "b": 3}, {"k": 2, "b": 4}]


def test_references_decode_as_in_the_standard_library(spark):
    import html
    import random

    from taxolens.functions.text import decode_entities
    rnd = random.Random(1)
    parts = ["&", "amp;", "amp", "copy", "copy;", "check;", "CounterClockwiseContourIntegral;", "#128;", "#x80", "#0;",
             "#65", "#x41;", "notit;", "not", "lt", ";", " ", "x", "é", "#xD800;", "#1114112;", "#99999999999", "#13;",
             "#129;", "#11;", "#xFFFE;", "#", "#x", "NotEqualTilde;", "\n", "&#", "nbsp;", "#00065;", "#x000041;", "fjlig;"]
    rows = [("&".join(rnd.choices(parts, k=rnd.randrange(1, 7))) if rnd.random() < 0.5
             else "".join(rnd.choices(parts, k=rnd.randrange(1, 9))),) for _ in range(2000)] + [("&" + p,) for p in parts]
    for r in spark.createDataFrame(rows, "t string").select("t", decode_entities("t").alias("d")).collect():
        assert r["d"] == html.unescape(r["t"]), r["t"]
