"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every test item is a word sequence; its seeds are pairs of neighbouring words, found in a text next to each other or
with one word between. A copy at the cut keeps at least :func:`least_shared` of an item's pairs, however its edits
are placed (each edit costs the score, so there are too few to break more). The pairs are counted over the whole
corpus; the rarest of each item are its seeds (ranked within the item, so an item copied into very many documents
keeps its seeds), all but half as many as a copy must share, so a copy holds at least the other half of those among
the seeds. Documents that hold so many of them within the words of one copy get the item as a candidate at the
diagonals the seeds suggest; the words around them are aligned to the item with local alignment (match ``MATCH``,
substitution ``MISS``, gap ``GAP``), and the score over that of a perfect copy says how much of the item is there.
Edited or paraphrased copies keep most of it, so ``CUT`` is half of an item, with at least ``MIN_WORDS`` aligned words
(all of a shorter item). No copy at that cut or above is lost to the seeds; the bound does not hold for lower cuts.

The seeds of a benchmark are broadcast in blocks of at most ``BLOCK_BYTES`` of item text; a larger benchmark takes
more passes over the corpus and gives the same rows.

Defined cases: null and empty texts hold nothing; an item without words is never found; a row with a null id is
reported with that id; repeated rows are reported each; items of one text are all reported; other columns are unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import gram_hashes, hash_words, lower_words, mix, whole_text

SEED = 2
MATCH, MISS, GAP = 1.0, -0.5, -0.5
CUT = 0.5
MIN_WORDS = 8
BLOCK_BYTES = 8_000_000


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    grams: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        words = [hash_words(lower_words(t)) for _, t in rows]
        keep_ = [k for k, w in enumerate(words) if len(w)]
        return cls([rows[k][0] for k in keep_], [words[k] for k in keep_],
                   [gram_hashes(words[k], SEED) for k in keep_])


def pair_hashes(h: np.ndarray, distance: int) -> np.ndarray:
    """Hashes of all pairs of words that stand ``distance`` apart: those of a run of two words if they met."""
    return mix(mix(h[:-distance]) + h[distance:])


def least_shared(length: int, cut: float = CUT) -> int:
    """Fewest neighbouring pairs of an item of ``length`` words that a copy of score share ``cut`` has, next to each
    other or with one word between.

    With m matched words, x item words replaced or left out inside and y words put in, a share of ``cut`` leaves
    x + y <= 2 (m - cut length) and x <= length - m. A pair of matched neighbours is lost only to one of the x or to
    two of the y, so at least m - 1 - x - (y - x) / 2 of the m - 1 are left; that is least at the largest x.
    """
    return max(1, math.ceil((4 * cut - 1) * length / 3 - 1 - 1e-9))


def grams_of(h: np.ndarray, short: list[int]) -> np.ndarray:
    """Seed candidates of a text: its runs of ``SEED`` words, and runs of the lengths of shorter items."""
    out = [gram_hashes(h, SEED)] if len(h) >= SEED else []
    out += [gram_hashes(h, n) for n in short if len(h) >= n]
    return np.concatenate(out) if out else h[:0]


def count_grams(docs: DataFrame, grams: np.ndarray, short: list[int], text_col: str = "text") -> dict[int, int]:
    """Occurrences of the given run hashes over all texts (one bounded table a task, added up on Spark)."""
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(np.sort(grams))

    def run(batches):
        w = wanted.value
        n = np.zeros(len(w), np.int64)
        for pdf in batches:
            for text in pdf[text_col]:
                g = grams_of(hash_words(lower_words(text)), short)
                at = np.searchsorted(w, g)
                at[at == len(w)] = 0
                hit = at[w[at] == g]
                if len(hit):
                    n += np.bincount(hit, minlength=len(w))
        some = np.flatnonzero(n)
        yield pd.DataFrame({"at": some, "n": n[some]})

    got = (docs.select(whole_text(text_col).alias(text_col)).mapInPandas(run, "at long, n long")
           .groupBy("at").agg(F.sum("n").alias("n")).collect())
    order = np.sort(grams)
    return {int(order[r["at"]]): r["n"] for r in got}


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment of two word sequences: ``score, matched words, first and last word of the window``."""
    m = len(window)
    h = np.zeros((len(item) + 1, m + 1))
    steps = np.arange(m + 1) * -GAP
    for i, w in enumerate(item, 1):
        row = np.zeros(m + 1)
        np.maximum(h[i - 1, :-1] + np.where(window == w, MATCH, MISS), 0, out=row[1:])
        np.maximum(row, h[i - 1] + GAP, out=row)
        # a gap along the row: the best earlier cell less its distance
        h[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, last, matched = float(h[i, j]), j - 1, 0
    while i and j and h[i, j] > 1e-9:
        same = item[i - 1] == window[j - 1]
        if abs(h[i, j] - h[i - 1, j - 1] - (MATCH if same else MISS)) < 1e-9:
            matched += int(same)
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j] - GAP) < 1e-9:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), int(last)


def windows(starts: np.ndarray, length: int, slack: int, n_words: int) -> list[tuple[int, int]]:
    """Word ranges of a document to align: around the starts that the seeds suggest, overlapping ones joined."""
    out: list[list[int]] = []
    for s in np.unique(starts).tolist():
        lo, hi = max(0, s - slack), min(n_words, s + length + slack)
        # at most twice an item long, so a text full of seeds is still cut into pieces
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 2 * (length + 2 * slack):
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _search(seeds: np.ndarray, begin: np.ndarray, owner: np.ndarray, offset: np.ndarray, need: np.ndarray,
            items: Items, short: list[int], cut: float):
    """Find the items in one text: rows ``(item, score, matched, first, last)``.

    ``seeds`` are distinct hashes in order; those of seed k are in the items ``owner[begin[k]:begin[k + 1]]``.
    ``need`` is the number of its seeds that a copy of an item holds.
    """
    length = np.array([len(w) for w in items.words])
    # a copy of two words may have two others between them and still be half an item
    reach = 3 if (length == SEED).any() else 2

    def find(text: str) -> list[tuple]:
        h = hash_words(lower_words(text))
        best: dict[int, tuple] = {}
        place, item_of, item_at = [], [], []
        for distance in [0] * bool(short) + list(range(1, reach + 1)):
            if len(h) <= distance:
                continue
            g = pair_hashes(h, distance) if distance else gram_hashes(h, 1)
            lo = np.searchsorted(seeds, g)
            lo[lo == len(seeds)] = 0
            at = np.flatnonzero(seeds[lo] == g)
            n = begin[lo[at] + 1] - begin[lo[at]]
            k = np.repeat(begin[lo[at]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            p, k = np.repeat(at, n), k.astype(np.int64)
            if distance > 2:
                p, k = p[length[owner[k]] == SEED], k[length[owner[k]] == SEED]
            place.append(p)
            item_of.append(owner[k])
            item_at.append(offset[k])
        if not place:
            return []
        p, who, off = np.concatenate(place), np.concatenate(item_of), np.concatenate(item_at)
        # items with enough different seeds in the whole text
        own, n = np.unique(np.unique(who << 32 | off) >> 32, return_counts=True)
        starts: dict[int, np.ndarray] = {}
        for item in own[n >= need[own]].tolist():
            mine = who == item
            order = np.argsort(p[mine], kind="stable")
            q, s = p[mine][order], (p[mine] - off[mine])[order]
            # and within the words of one copy, at most twice the item's: hits i to i + need - 1
            c = int(need[item])
            near = np.flatnonzero(q[c - 1:] - q[:len(q) - c + 1] < 2 * length[item])
            if len(near):
                inside = np.zeros(len(q) + 1, np.int64)
                np.add.at(inside, near, 1)
                np.add.at(inside, near + c, -1)
                starts[item] = s[np.cumsum(inside[:-1]) > 0]
        for item, at in starts.items():
            w = items.words[item]
            # as many words may be put in as the item has
            for lo, hi in windows(at, len(w), max(4, len(w)), len(h)):
                score, matched, first, last = align(w, h[lo:hi])
                share = score / (MATCH * len(w))
                if share >= cut and matched >= min(MIN_WORDS, len(w)) and (
                        item not in best or share > best[item][1]):
                    best[item] = (items.ids[item], share, matched, lo + first, lo + last)
        return [best[k] for k in sorted(best)]
    return find


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in blocks of rows whose texts are at most ``BLOCK_BYTES`` together (a longer item alone)."""
    src = benchmark.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("t"))
    total = src.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // (BLOCK_BYTES // 2)))
    for k in range(parts):
        rows = (src if parts == 1 else src.filter(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == k)).collect()
        yield Items.of(sorted(((r["id"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def seed_tables(src: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text",
                cut: float = CUT):
    """A broadcast table for each block of the benchmark: seed hashes in order, their item and place, the items."""
    sc = src.sparkSession.sparkContext
    for items in _blocks(benchmark, item_col, item_text):
        if not items.ids:
            continue
        short = sorted({len(w) for w in items.words if len(w) < SEED})
        counts = count_grams(src, np.unique(np.concatenate(items.grams)), short)
        seeds, owner, offset, need = [], [], [], []
        for k, g in enumerate(items.grams):
            rank = sorted(range(len(g)), key=lambda p: (counts.get(int(g[p]), 0), p))
            shared = least_shared(len(items.words[k]), cut)
            # without the commonest half of those that a copy shares, it still has the other half
            need.append((shared + 1) // 2)
            for p in rank[:len(g) - shared + need[-1]]:
                seeds.append(g[p])
                owner.append(k)
                offset.append(p)
        order = np.argsort(np.array(seeds, np.uint64), kind="stable")
        distinct, first = np.unique(np.array(seeds, np.uint64)[order], return_index=True)
        yield sc.broadcast((distinct, np.append(first, len(seeds)), np.array(owner, np.int64)[order],
                            np.array(offset, np.int64)[order], np.array(need), items, short))


def find_items(docs: DataFrame, benchmark: DataFrame, cut: float = CUT, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Test items found in documents: ``doc_id, item_id, score, matched, first_word, last_word``, best place of each."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, matched int, first_word long, last_word long"
    out = None
    for table in seed_tables(src, benchmark, item_col, item_text, cut):
        def run(batches, table=table):
            find = _search(*table.value, cut)
            for pdf in batches:
                rows = [(d, *r) for d, t in zip(pdf["doc_id"], pdf["text"]) for r in find(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "matched", "first_word",
                                                      "last_word"])

        found = src.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _is_clean(table, cut: float):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _search(*table.value, cut)
        for texts in parts:
            yield pd.Series([not find(t) for t in texts], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item."""
    out = docs
    for table in seed_tables(docs.select(whole_text(text_col).alias("text")), benchmark, cut=cut):
        out = out.filter(_is_clean(table, cut)(whole_text(text_col)))
    return out
