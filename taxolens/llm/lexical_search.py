"""Ranked lexical search: the items' terms are an automaton, every document is scanned with it, no index is built.

Terms are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. All terms of a block of items form one
Aho-Corasick automaton over patterns ``" term "``: the blanks guard the borders, so a pattern meets whole terms only.
A document's text, with every other character turned into a blank, is scanned once; the automaton's outputs count the
occurrences (tf) of each term, and a table from terms to items turns them into scores.

The first scan counts documents with a term (N), all terms (L) and the documents that hold each item term (df). The
second scores, with the weights in the same broadcast: tasks keep the best ``k`` documents of every item, so at most
``k`` rows per task and item are shuffled. Both scans are narrow; neither texts nor term counts are shuffled.

Items come in blocks of at most ``BLOCK_BYTES`` of text, which bounds the broadcast; more items are more scans.
Scores are whole numbers in every step (sums stay below 2^53, where the partial sums are exact).

Defined cases: a null or empty text has no terms, counts in neither N nor L and is never found; an item without terms
finds nothing; rows of one item id (null too) are one item with the terms of all; equal scores rank by ascending
document id, null first; rows that repeat a document id are ranked each; other columns are unread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.llm.common import ascii_words, spaced_words, whole_text

TOP = 10
#: Text of the items of one block. An automaton has at most a node a byte.
BLOCK_BYTES = 1 << 20
#: Scores held at once while documents are scored: documents of a chunk times items of the block.
CHUNK_SCORES = 200_000


@dataclass
class ItemBlock:
    """Items and their distinct terms; ``owner[begin[t]:begin[t + 1]]`` are the items that hold term ``t``."""

    ids: list
    terms: list[bytes]
    begin: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> ItemBlock:
        held: dict = {}
        for item, text in rows:
            held.setdefault(item, set()).update(ascii_words(text))
        ids = sorted(held, key=lambda i: (i is not None, i or 0))
        terms = sorted({w for ws in held.values() for w in ws})
        at = {w: t for t, w in enumerate(terms)}
        pairs = sorted((at[w], n) for n, i in enumerate(ids) for w in held[i])
        term = np.array([t for t, _ in pairs], np.int64)
        return cls(ids, terms, np.searchsorted(term, np.arange(len(terms) + 1)),
                   np.array([n for _, n in pairs], np.int64))

    def automaton(self):
        out = ahocorasick.Automaton()
        for t, w in enumerate(self.terms):
            out.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", t)
        out.make_automaton()
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemBlock]:
    """The items in blocks of about ``BLOCK_BYTES / 2`` of text; rows of one id are in one block."""
    src = items.select(F.col(id_col).cast("long").alias("i"), whole_text(text_col).alias("t"))
    total = src.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // (BLOCK_BYTES // 2)))
    for k in range(parts):
        rows = src.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) if parts > 1 else src
        block = ItemBlock.of([(r["i"], r["t"]) for r in rows.collect()])
        if block.terms:
            yield block


def term_counts(automaton, text: str) -> tuple[int, Counter]:
    """Number of terms of a text, and the occurrences of each item term."""
    n, line = spaced_words(text)
    return n, Counter(t for _, t in automaton.iter(line)) if n else Counter()


def corpus_counts(src: DataFrame, automaton, n_terms: int) -> tuple[int, int, np.ndarray]:
    """``N, L`` and the documents that hold each item term, over the whole table (a bounded row set a task)."""
    def run(batches):
        docs = terms = 0
        df = np.zeros(n_terms, np.int64)
        for pdf in batches:
            for text in pdf["t"]:
                n, tf = term_counts(automaton.value, text)
                docs += n > 0
                terms += n
                if tf:
                    df[np.fromiter(tf, np.int64, len(tf))] += 1
        held = np.flatnonzero(df)
        yield pd.DataFrame({"k": np.append(held, [n_terms, n_terms + 1]), "n": np.append(df[held], [docs, terms])})

    out = np.zeros(n_terms + 2, np.int64)
    for r in src.select("t").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The best ``k`` documents of every item so far: score descending, null ids first, ids ascending."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, scores: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        """Scores of a chunk of documents: a row a document, a column an item."""
        d, i = np.nonzero(scores >= self.floor)
        if not len(d):
            return
        item, score, known, doc = (np.concatenate(p) for p in zip(self.rows, (i, scores[d, i], known[d], doc[d])))
        order = np.lexsort((doc, known, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        item = item[place < self.k]
        self.rows = [item, score[kept], known[kept], doc[kept]]
        full = place[place < self.k] == self.k - 1
        self.floor[item[full]] = self.rows[1][full]


def chunk_scores(block: ItemBlock, weight: np.ndarray, counts: list[Counter], m: np.ndarray) -> np.ndarray:
    """Score of every document of a chunk for every item."""
    size = np.array([len(c) for c in counts])
    doc = np.repeat(np.arange(len(counts)), size)
    term = np.fromiter((t for c in counts for t in c), np.int64, len(doc))
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(doc))
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    many = block.begin[term + 1] - block.begin[term]
    at = np.repeat(block.begin[term] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    cell = np.repeat(doc, many) * len(block.ids) + block.owner[at]
    out = np.bincount(cell, np.repeat(part, many).astype(float), len(counts) * len(block.ids))
    return out.astype(np.int64).reshape(len(counts), len(block.ids))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"),
                      F.col(id_col).isNotNull().cast("long").alias("known"), whole_text(text_col).alias("t"))
    found = spark.createDataFrame([], "item_id long, score long, known long, d long")
    for block in item_blocks(items, item_col, item_text):
        automaton = spark.sparkContext.broadcast(block.automaton())
        n_docs, n_terms, df = corpus_counts(src, automaton, len(block.terms))
        if not n_docs:
            break
        table = spark.sparkContext.broadcast((block, term_weights(n_docs, df)))

        def run(batches, automaton=automaton, table=table, n_docs=n_docs, n_terms=n_terms):
            block, weight = table.value
            best = Best(len(block.ids), k)
            step = max(1, CHUNK_SCORES // len(block.ids))
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo:lo + step]
                    seen = [term_counts(automaton.value, t) for t in part["t"]]
                    m = np.array([10 + 90 * n * n_docs // n_terms for n, _ in seen], np.int64)
                    best.add(chunk_scores(block, weight, [c for _, c in seen], m), part["d"].to_numpy(np.int64),
                             part["known"].to_numpy(np.int64))
            item, score, known, doc = best.rows
            yield pd.DataFrame({"item_id": pd.array([block.ids[i] for i in item], "Int64"), "score": score,
                                "known": known, "d": doc})

        found = found.unionByName(src.mapInPandas(run, found.schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "known", "d")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", F.when(F.col("known") == 1, F.col("d")).alias("doc_id"), "score"))


def search_sql(k: int = TOP) -> str:
    """DuckDB SQL for the rows of :func:`search` over ``documents`` and ``benchmark``."""
    terms = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS term FROM rows),
tf AS (SELECT r, term, count(*) AS tf FROM words GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS terms FROM rows WHERE len(ws) > 0),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, corpus WHERE term IN (SELECT term FROM items) GROUP BY term),
scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
                  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * docs) // terms))))::BIGINT AS score
           FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN rows USING (r), corpus GROUP BY item_id, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank
           FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
