"""One JSON document in byte ranges: the same rows however it is cut."""

import json
import random

import numpy as np
import pytest

from taxolens.schema import LABEL_COL, TEXT_COLS
from taxolens.sources import json_document as J
from taxolens.sources.json_source import load_products

TRICKY = ["", " ", ",", '"', "\\", '\\"', "a,b", "},{", '"},{"x":"', "[,]", "é,漢\n字\t", "\\,", ',"0":"', "x" * 300 + ",",
          ", ".join("word" for _ in range(200)), None, "true", " ,\U0001f600"]


def rows_of(n, seed):
    rnd = random.Random(seed)
    return [{c: rnd.choice(TRICKY) for c in [*TEXT_COLS, LABEL_COL]} for _ in range(n)]


def documents(rows):
    cols = {c: {str(i): r[c] for i, r in enumerate(rows)} for c in rows[0]}
    return {"records": [json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=2),
                        "\n " + json.dumps(rows, separators=(",", ":")) + "\n"],
            "columns": [json.dumps(cols), json.dumps(cols, ensure_ascii=False, indent=1),
                        json.dumps({"Unread": {}, **cols, "More": {"0": [1, {"a": ","}], "1": 2}})]}


@pytest.fixture
def split_at(spark):
    def put(size, cost):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)

    yield lambda size: put(str(size), "1")
    put("128m", "4m")


@pytest.mark.parametrize("layout", ["records", "columns"])
def test_rows_do_not_depend_on_the_ranges(spark, tmp_path, split_at, layout):
    rows = rows_of(40, 5)
    want = [(i, *(r[c] for c in TEXT_COLS), r[LABEL_COL]) for i, r in enumerate(rows)]
    for k, text in enumerate(documents(rows)[layout]):
        path = tmp_path / f"{layout}{k}.json"
        path.write_text(text, encoding="utf-8", newline="")
        size = len(path.read_bytes())
        for ranges in ((1, 4, 16), (16,), (60,))[k]:
            split_at(-(-size // ranges))
            frags = J.fragments(spark, str(path))
            assert frags.rdd.getNumPartitions() >= min(ranges, 8) * (ranges > 1)
            got = sorted(map(tuple, load_products(spark, str(path)).collect()), key=lambda t: t[0])
            assert got == want, (k, ranges)


def test_small_chunks_and_several_files(spark, tmp_path):
    rows = rows_of(30, 8)
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(rows[10 * k:10 * k + 10]), encoding="utf-8")
    got = load_products(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(30))
    assert [r["Title"] for r in got] == [r["Title"] for r in rows]


def test_empty_documents(spark, tmp_path):
    for k, text in enumerate(["[]", "[ ]\n", '{"Title": {}}', '[{}]']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        got = load_products(spark, str(path), "columns" if text.startswith("{") else "records").collect()
        assert [tuple(r)[1:] for r in got] == ([(None,) * 6] if k == 3 else [])


def test_structure_equals_a_slow_scan():
    rnd = random.Random(1)
    for _ in range(300):
        text = json.dumps([rnd.choice(TRICKY[:-3]) for _ in range(rnd.randrange(6))]) + ","
        inside, depth, k, slow = False, 0, 0, []
        while k < len(text):
            c = text[k]
            if inside and c == "\\":
                k += 2
                continue
            inside ^= c == '"'
            if not inside and c in "[]{},":
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(c, 0)
                if c == "," and depth <= 1:
                    slow.append((len(text[:k].encode()), depth))
            k += 1
        at, deep, quoted, end = J._cuts(text, False, 0, 1)
        assert list(zip(at.tolist(), deep.tolist())) == slow and (quoted, end) == (False, 0)
        assert np.array_equal(J._cuts('x"' + text, True, 0, 1)[0], at + 2)


def test_cells():
    assert J.cell('{"a": {"0": "x,y"', 0) == ("a", "0", "x,y")
    assert J.cell(' "b" :{ "7":null}', 1) == ("b", "7", None)
    assert J.cell('"7" : 1.50 ', 2) == (None, "7", "1.50")
    assert J.cell('"c": {}', 1) == ("c", None, None)
    assert J.cell('"9": [1, {"a": ","}]}', 2) == (None, "9", '[1, {"a": ","}]')
    assert J.cell("", 1) == (None, None, None)
