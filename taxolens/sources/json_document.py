"""One JSON document of any size, read in as many tasks as the store has splits for it.

A document is an array of records or an object of columns ``{col: {index: value}}`` and may stand on a single line, so
lines don't split it. Spark's text reader splits it at commas instead: a task gets the fragments of its byte range,
wherever the file lies, and the fragments give back the text. Whether a comma is inside a string or how deep it is nested
depends on everything before it, so there are three narrow passes over the ranges:

1. each range is scanned for both cases, that it begins inside a string and that it does not: parity of its quotes and
   change of depth. The driver adds these up, a few numbers a range.
2. with its start known, each range counts its cuts: commas outside of strings at the depth of elements. Summed up, they
   number all elements of the document, whatever the ranges.
3. each range emits its elements. What stands before its first cut and after its last one are parts of elements that
   reach over the border; parts of one number are joined in order. An element may reach over any number of ranges.

No task holds more than a range's open element and ``CHUNK`` characters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that are scanned at once.
CHUNK = 4 << 20
#: Depth of the commas between elements: records of an array, cells of the columns of an object.
DEPTH = {"records": 1, "columns": 2}
_BLANKS = " \t\r\n"
_decode = json.JSONDecoder(strict=False).raw_decode


class Start(NamedTuple):
    """What is known where a byte range begins."""

    quoted: bool
    depth: int
    element: int = 0
    column: int = 0


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas, ``(value, file, start)``; fragments of a range come in order."""
    return spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """``((file, start), text)`` in order; a range may come in several texts, each ending with a comma."""
    held: list[str] = []
    key, size = None, 0
    for pdf in batches:
        for value, file, start in zip(pdf["value"], pdf["file"], pdf["start"]):
            if held and ((file, start) != key or size >= CHUNK):
                yield key, ",".join([*held, ""])
                held, size = [], 0
            key = (file, start)
            held.append(value)
            size += len(value) + 1
    if held:
        yield key, ",".join([*held, ""])


def structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets and commas of some bytes, the number of quotes before each, and the number of quotes.

    Escaped quotes don't count. A comma never follows an open escape, so a chunk begins without one.
    """
    quotes = np.flatnonzero(data == 34)
    slashes = np.flatnonzero(data == 92)
    if len(slashes) and len(quotes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        place = np.arange(len(slashes))
        in_run = place - np.maximum.accumulate(np.where(first, place, 0))
        quotes = quotes[~np.isin(quotes - 1, slashes[in_run % 2 == 0])]
    # with this bit set, [ reads as { and ] as }
    low = data | 0x20
    at = np.flatnonzero((low == 0x7B) | (low == 0x7D) | (data == 44))
    return at, np.searchsorted(quotes, at), len(quotes)


def _steps(symbols: np.ndarray) -> np.ndarray:
    """Change of depth by each bracket or comma."""
    low = symbols | 0x20
    return np.where(low == 0x7B, 1, np.where(low == 0x7D, -1, 0)) * (symbols != 44)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _range_starts(frags: DataFrame) -> dict[tuple[str, int], Start]:
    """Pass 1: for each range whether it begins in a string, and its depth."""
    def run(batches):
        total: dict = {}
        for key, text in _chunks(batches):
            data = _bytes(text)
            at, before, quotes = structure(data)
            step, now = _steps(data[at]), total.setdefault(key, [0, 0, 0])
            # depth if the range begins outside of a string, and if inside
            for case in (0, 1):
                now[1 + case] += int(step[(before + now[0] + case) % 2 == 0].sum())
            now[0] += quotes
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["file", "start", "quotes", "plain", "quoted"])

    rows = frags.mapInPandas(run, "file string, start long, quotes long, plain long, quoted long").collect()
    starts, file, now = {}, None, Start(False, 0)
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, now = r["file"], Start(False, 0)
        starts[r["file"], r["start"]] = now
        now = Start(now.quoted ^ bool(r["quotes"] % 2), now.depth + (r["quoted"] if now.quoted else r["plain"]))
    return starts


def _cuts(text: str, quoted: bool, depth: int, level: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Byte places and depths of the cuts of a text, then its end: in a string, depth."""
    data = _bytes(text)
    at, before, quotes = structure(data)
    plain = (before + quoted) % 2 == 0
    at, symbol = at[plain], data[at[plain]]
    deep = depth + np.cumsum(_steps(symbol))
    cut = (symbol == 44) & (deep <= level)
    return at[cut], deep[cut], bool((quotes + quoted) % 2), int(deep[-1]) if len(deep) else depth


def _numbered(frags: DataFrame, starts: dict, level: int) -> dict[tuple[str, int], Start]:
    """Pass 2: for each range the elements and columns that begin before it, over all files in order."""
    def run(batches):
        total, state = {}, {}
        for key, text in _chunks(batches):
            quoted, depth = state.get(key) or starts[key][:2]
            _, deep, *state[key] = _cuts(text, quoted, depth, level)
            n = total.setdefault(key, [0, 0])
            n[0] += len(deep)
            n[1] += int((deep < 2).sum())
        yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["file", "start", "elements", "columns"])

    rows = frags.mapInPandas(run, "file string, start long, elements long, columns long").collect()
    out, element, column = {}, 0, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        key = (r["file"], r["start"])
        out[key] = Start(*starts[key][:2], element, column)
        element, column = element + r["elements"], column + r["columns"]
    return out


def elements(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``element, column, depth, text`` of every element of the documents at a path, numbered in their order.

    ``depth`` is that of the comma (or document) that the element follows, ``column`` counts the columns before.
    """
    level, frags = DEPTH[layout], fragments(spark, path)
    known = spark.sparkContext.broadcast(_numbered(frags, _range_starts(frags), level))

    def run(batches):
        key, now, rows, held, part = None, None, [], [], True
        columns = ["element", "column", "depth", "start", "part", "text"]

        def done(last: bool):
            text = "".join(held)
            if text:
                rows.append((now.element, now.column, now.depth, key[1], part or last, text))

        for new, text in _chunks(batches):
            if new != key:
                if key:
                    done(True)
                key, now, held, part = new, known.value[new], [], True
                quoted, depth = now.quoted, now.depth
            raw = text.encode("utf-8", "surrogatepass")
            at, deep, quoted, depth = _cuts(text, quoted, depth, level)
            lo = 0
            for hi, d in zip(at.tolist(), deep.tolist()):
                held.append(raw[lo:hi].decode("utf-8", "surrogatepass"))
                done(False)
                now, held, part, lo = Start(False, d, now.element + 1, now.column + (d < 2)), [], False, hi + 1
            held.append(raw[lo:].decode("utf-8", "surrogatepass"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if key:
            done(True)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    found = frags.mapInPandas(run, "element long, column long, depth int, start long, part boolean, text string")
    whole = found.filter("not part").select("element", "column", "depth", "text")
    joined = (found.filter("part").groupBy("element")
              .agg(F.min(F.struct("start", "column", "depth")).alias("h"),
                   F.sort_array(F.collect_list(F.struct("start", "text"))).alias("t"))
              .select("element", "h.column", "h.depth", F.concat_ws("", "t.text").alias("text")))
    return whole.unionByName(joined)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``element, text``: the JSON text of every object in an array of records."""
    bare = F.expr("trim(BOTH ' \t\r\n[]' FROM text)")
    return elements(spark, path, "records").select("element", bare.alias("text")).filter(F.col("text").startswith("{"))


def _after(text: str, at: int, symbol: str) -> int:
    """The place after a symbol and the blanks around it; the same place if it isn't there."""
    k = at
    while text[k:k + 1] and text[k] in _BLANKS:
        k += 1
    if symbol and text[k:k + 1] != symbol:
        return at
    k += len(symbol)
    while text[k:k + 1] and text[k] in _BLANKS:
        k += 1
    return k


def cell(text: str, depth: int) -> tuple[str | None, str | None, str | None]:
    """``(name of the column that begins, index, value)`` of an element; values that are no string stay JSON text."""
    at, name = _after(text, 0, ""), None
    if depth < 2:
        at = _after(text, at, "{") if depth == 0 else at
        if text[at:at + 1] != '"':
            return None, None, None
        name, at = _decode(text, at)
        at = _after(text, _after(text, at, ":"), "{")
    if text[at:at + 1] != '"':
        return name, None, None
    index, at = _decode(text, at)
    begin = _after(text, at, ":")
    value, end = _decode(text, begin)
    return name, index, value if value is None or isinstance(value, str) else text[begin:end]


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row an index with a string column for each of ``names``, from an object of columns; ``_idx`` orders them."""
    def run(batches):
        for pdf in batches:
            got = [cell(t, d) for t, d in zip(pdf["text"], pdf["depth"])]
            yield pd.DataFrame({"column": pdf["column"], "name": [g[0] for g in got], "idx": [g[1] for g in got],
                                "val": [g[2] for g in got]})

    cells = elements(spark, path, "columns").mapInPandas(run, "column long, name string, idx string, val string")
    # a row for each name and file
    heads = cells.filter(F.col("name").isin(names)).select("column", F.col("name").alias("col"))
    wide = (cells.filter("idx is not null").select("column", "idx", "val").join(F.broadcast(heads), "column")
            .groupBy(F.col("idx").cast("long").alias("_idx")).pivot("col", names).agg(F.first("val")))
    return wide
