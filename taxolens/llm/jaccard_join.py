"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles (lower-cased words; a shorter text is one shingle, an empty text the
empty set). Texts with the same set are collapsed first, so a group of copies of any size is one set with a count.
Each set is embedded as ``N_HASH`` minhash values. A run starts with all sets in one bucket and splits buckets
recursively: a set goes down the path of every one of its values that the path's own hash function samples, 1 /
threshold paths in expectation, so two sets that are similar enough are expected to share at least one path on each
level. A bucket of at most ``LEAF`` sets is compared by brute force on the embedding. A larger one is first compared
with one of its sets, the pivot: sets like it leave the recursion as candidates of the pivot, with all that the
triangle inequality lets them be linked to, so a group of near copies is not split in vain; the rest goes further
down. A bucket that is still too large after ``MAX_DEPTH`` levels becomes a candidate group whole. Runs are repeated
until the probability to miss a pair at the threshold is below ``1 - recall``: for all sets as often as buckets need
that end within ``SHALLOW`` levels, and for the sets of buckets that go deeper as often as ``MAX_DEPTH`` levels need.

Candidate groups are then compared exactly on whole shingle sets, in tiles of at most ``TILE`` sets a side: a tile
counts the links of its rows and gives the links that join its components, never a list of pairs.

Defined cases: a null text is empty; empty texts are copies of each other; a row with a null id takes no part (class
null, no links); repeated rows are copies of each other, and the texts of one id share a class; an empty table gives
an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.llm.common import (
    components,
    hash_int,
    keep,
    likely_member,
    mix,
    shingle_set,
    sorted_groups,
    whole_text,
)

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
N_HASH = 128
LEAF = 768
#: Estimated likeness to a bucket's pivot from which a set needs no further path.
CORE = 0.75
MAX_DEPTH = 6
#: Levels that the runs of all sets are enough for.
SHALLOW = 3
TILE = 512
#: Bound on the rows of a level that are broadcast, measured before.
SEND_BYTES = 2 << 20

_RNG = np.random.default_rng(20240607)
_SLOT = mix(np.arange(N_HASH, dtype=np.uint64) + np.uint64(1))
_MULT = _RNG.integers(1, 1 << 63, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """``N_HASH`` 64-bit minhash values of a set of 64-bit hashes (all ones if empty)."""
    low = np.full(N_HASH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i:i + 512, None] * _MULT[None, :]).min(axis=0), out=low)
    return low


def short_values(low: np.ndarray) -> np.ndarray:
    """The leading 16 bits of minhash values after mixing: what is compared inside a bucket."""
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def survival(similarity: float, threshold: float, depth: int) -> float:
    """Probability that a pair of this similarity shares a path of a run down to ``depth`` (Poisson branching)."""
    mean, q = similarity / threshold, 1.0
    for _ in range(depth):
        q = 1 - math.exp(-mean * q)
    return q


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = SHALLOW) -> int:
    """Repetitions that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold, depth)))


def embed(docs: DataFrame, runs: int, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, n, mh, paths)``: hash of the shingle set, its size, its short minhash values as bytes, and
    the paths it takes from the root of each run."""
    roots = [np.array([hash_int(17, r)], np.uint64) for r in range(runs)]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(text, SHINGLE)
                low = minhashes(s)[None, :]
                paths = np.concatenate([children(low, p, threshold)[0] for p in roots])
                rows.append((i, xxhash.xxh3_128_digest(s.tobytes()), len(s), short_values(low).tobytes(), paths))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "mh", "paths"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return src.filter("doc_id is not null").mapInPandas(
        run, "doc_id long, digest binary, n long, mh binary, paths array<long>")


def children(values: np.ndarray, path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths that rows of minhash values take from their bucket ``path``: ``(child paths, row numbers)``."""
    own = mix(values.astype(np.uint64) + _SLOT)
    h = mix(own ^ mix(path)[:, None])
    at, k = np.nonzero(h < np.uint64(int(min(1.0, 1 / (threshold * N_HASH)) * 2**64 - 1)))
    return mix(h[at, k] + np.broadcast_to(path, len(values))[at]).view(np.int64), at


def _leaf_links(threshold: float, floor: float):
    """Candidate links inside buckets of at most ``LEAF`` sets, as links to the least member of a component."""
    def run(batches):
        for g in sorted_groups(batches, ["path"]):
            node = g["node"].to_numpy()
            if len(node) < 2:
                continue
            m = _values(g["mh"])
            n = g["n"].to_numpy()
            same = np.empty((len(node), len(node)), np.float32)
            for i in range(len(node)):
                same[i] = (m == m[i]).mean(axis=1)
            small, large = np.minimum.outer(n, n), np.maximum.outer(n, n)
            adj = (same >= floor) & (small >= threshold * large)
            lab = dense_components(adj)
            a, b = node, node[lab]
            ok = a != b
            if ok.any():
                yield pd.DataFrame({"a": a[ok], "b": b[ok]})
    return run


def dense_components(adj: np.ndarray) -> np.ndarray:
    """Index of the first member of each row's component in a small dense graph."""
    lab = np.arange(len(adj))
    while True:
        new = np.minimum(lab, np.where(adj, lab[None, :], len(adj)).min(axis=1, initial=len(adj)))
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def _values(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), N_HASH)


def _carve(threshold: float):
    """Rows of buckets that are too large, each with its bucket's pivot: links to the pivot, and paths further down.

    A set within distance r of the pivot can only be linked to sets within r + 1 - threshold of it (Jaccard distance
    is a metric). Those are all joined to the pivot as candidates, so the sets near the pivot need no further path;
    the margins are four standard deviations of the estimates. Kind 0: link ``(a, b)``; kind 1: path of a set.
    """
    core, ring = CORE, CORE - (1 - threshold) - 4 * math.sqrt(0.25 / N_HASH) - 0.02

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, p = _values(pdf["mh"]), _values(pdf["pivot_mh"])
            node, pivot = pdf["node"].to_numpy(), pdf["pivot"].to_numpy()
            path = pdf["path"].to_numpy().astype(np.int64).view(np.uint64)
            alike = (m == p).mean(axis=1)
            joined = (alike >= ring) & (node != pivot)
            stay = np.flatnonzero((alike < core) | (node == pivot))
            child, at = children(m[stay], path[stay], threshold)
            at = stay[at]
            k = int(joined.sum())
            yield pd.DataFrame({
                "kind": np.repeat([0, 1], [k, len(at)]), "a": np.concatenate([node[joined], child]),
                "b": np.concatenate([pivot[joined], node[at]]),
                "n": np.concatenate([np.zeros(k, np.int64), pdf["n"].to_numpy()[at]]),
                "mh": [b""] * k + pdf["mh"].iloc[at].tolist()})
    return run


def _more_paths(runs: range, threshold: float):
    """The sets with the paths they take from the roots of further runs, by their short minhash values."""
    roots = [np.array([hash_int(17, r)], np.uint64) for r in runs]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                m = _values(pdf["mh"])
                yield pdf.assign(paths=[np.concatenate([children(m[i:i + 1], p, threshold)[0] for p in roots])
                                        for i in range(len(m))])
    return run


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links ``(a, b)`` whose components hold every pair that the chosen paths bring together.

    ``reps`` are distinct sets ``(node, n, mh, paths)``, kept. A pair whose common buckets go below ``SHALLOW`` has
    both its sets in a bucket that does, so further runs of those sets alone bring it to ``recall``.
    """
    found, deep = _descend(reps, threshold)
    runs = range(runs_for(recall, threshold), runs_for(recall, threshold, MAX_DEPTH))
    if deep is None or not len(runs):
        return found.distinct()
    near = likely_member(deep.select(F.col("node").alias("id")))
    again = keep(reps.select("node", "n", "mh").filter(near(F.col("node"))).join(deep, "node", "left_semi")
                 .mapInPandas(_more_paths(runs, threshold), "node long, n long, mh binary, paths array<long>"))
    return found.unionByName(_descend(again, threshold)[0]).distinct()


def _descend(reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Links from all levels of the paths of ``reps``, and the sets of buckets that go below ``SHALLOW``, if any.

    Buckets are counted before anything but the id travels, so the embedding of a set that meets no other is never
    joined; below the first level the few rows of buckets that are still too large carry it along. Rows that carry it
    stay where they are as long as what they are joined with is small (``_sent``); a pivot brings its own along.
    """
    floor = threshold - 4 * math.sqrt(threshold * (1 - threshold) / N_HASH)
    found = deep = None
    rows = reps.select(F.explode("paths").alias("path"), "node")
    for depth in range(1, MAX_DEPTH + 1):
        # kept, so that the join deals out both sides and adaptive execution can split a hot path
        counts = keep(rows.groupBy("path").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
        met = keep(rows.join(_sent(counts, 16), "path"))
        full = met if depth > 1 else met.join(reps.select("node", "n", "mh"), "node")
        leaf = full.filter(F.col("k") <= LEAF).select("path", "node", "n", "mh")
        links = (leaf.repartition("path").sortWithinPartitions("path", "node")
                 .mapInPandas(_leaf_links(threshold, floor), "a long, b long"))
        big = met.filter(F.col("k") > LEAF)
        if depth == MAX_DEPTH:
            heads = big.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "node"), "node")).alias("h")).select(
                "path", F.col("h.node").alias("pivot"))
            links = links.unionByName(big.join(_sent(keep(heads), 16), "path").select(F.col("node").alias("a"),
                                                                                      F.col("pivot").alias("b")))
        links = keep(links.filter("a <> b").distinct())
        found = links if found is None else found.unionByName(links)
        if depth == MAX_DEPTH or big.isEmpty():
            break
        if depth == SHALLOW:
            deep = keep(big.select("node").distinct())
        big = full.filter(F.col("k") > LEAF)
        if depth == 1:
            big = keep(big)
        pivots = keep(big.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "node"), "node", "mh")).alias("h"))
                      .select("path", F.col("h.node").alias("pivot"), F.col("h.mh").alias("pivot_mh")))
        deeper = keep(big.join(_sent(pivots, 16 + 2 * N_HASH), "path")
                      .select("path", "node", "n", "mh", "pivot", "pivot_mh")
                      .mapInPandas(_carve(threshold), "kind int, a long, b long, n long, mh binary"))
        found = found.unionByName(deeper.filter("kind = 0").select("a", "b"))
        rows = deeper.filter("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("node"), "n", "mh")
    return found, deep


def _sent(small: DataFrame, row_bytes: int) -> DataFrame:
    """A kept table, sent to all tasks of its join if its rows take at most ``SEND_BYTES``, dealt out otherwise."""
    return F.broadcast(small) if small.count() * row_bytes <= SEND_BYTES else small


def _tile_links(threshold: float):
    """Exact links between the sets of one tile: partial counts and component links, a row for each set."""
    def run(batches):
        for g in sorted_groups(batches, ["comp", "ti", "tj"]):
            sets = [shingle_set(t, SHINGLE) for t in g["text"]]
            node, own, copies = (g[c].to_numpy() for c in ("node", "tile", "copies"))
            inner = g["ti"].iloc[0] == g["tj"].iloc[0]
            size = np.array([len(s) for s in sets], np.float64)
            inter = _intersections(sets)
            union = size[:, None] + size[None, :] - inter
            # equal comparison in integers: 5 inter >= 4 union at 0.8
            adj = inter >= threshold * union - 1e-9
            adj &= union > 0
            np.fill_diagonal(adj, False)
            if not inner:
                adj &= own[:, None] != own[None, :]
            links = adj.astype(np.float64) @ copies.astype(np.float64)
            first = dense_components(adj)
            yield pd.DataFrame({"node": node, "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                                "links": links.astype(np.int64), "low": node[first]})
    return run


def _intersections(sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections; values that only one set holds are left out first."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[:1] = True
    new[1:] = flat[1:] != flat[:-1]
    ident = np.cumsum(new) - 1
    often = np.bincount(ident)[ident] > 1 if len(flat) else new
    owner, ident = owner[often], ident[often]
    inter = np.zeros((n, n))
    if len(ident):
        ident = np.unique(ident, return_inverse=True)[1]
        width = int(ident.max()) + 1
        cuts = np.searchsorted(ident, np.arange(0, width + chunk, chunk))
        for c in range(len(cuts) - 1):
            lo, hi = cuts[c], cuts[c + 1]
            m = np.zeros((n, chunk), np.float32)
            m[owner[lo:hi], ident[lo:hi] - c * chunk] = 1
            inter += m @ m.T
    np.fill_diagonal(inter, [len(s) for s in sets])
    return inter


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the least id of the documents that chains of links (Jaccard >= threshold, equal sets included)
    connect; ``n_links`` counts the documents linked to this one, ``n_copies`` those of them with the same set.
    """
    rows = keep(embed(docs, runs_for(recall, threshold), threshold, id_col, text_col))
    # all but the id are the same for one digest
    reps = keep(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"),
                                           F.first("mh").alias("mh"), F.first("paths").alias("paths"),
                                           F.count(F.lit(1)).alias("copies")))
    cand = keep(components(candidate_links(reps, threshold, recall)))
    sizes = keep(cand.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))
    members = (cand.join(sizes, "comp")
               .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
               .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    members = keep(members.join(reps.select("node", "copies"), "node"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), whole_text(text_col).alias("text"))
    near = likely_member(members.select(F.col("node").alias("id")))
    met = texts.filter(F.col("node").isNotNull()).filter(near(F.col("node"))).join(members, "node").dropDuplicates(["node", "text"])
    fan = F.sequence(F.lit(0), F.col("tiles") - 1)
    tiled = (met.withColumn("other", F.explode(fan))
             .withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")))
    part = keep(tiled.select("comp", "ti", "tj", "tile", "node", "copies", "text")
                .repartition("comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj", "node")
                .mapInPandas(_tile_links(threshold), "node long, digest binary, links long, low long"))
    classes = components(part.select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = part.groupBy("digest").agg(F.sum("links").alias("links"))
    info = (reps.select("digest", "node", "copies").join(links, "digest", "left")
            .join(classes, "node", "left")
            .select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                    F.coalesce("comp", "node").alias("class_id")))
    named = (rows.select("doc_id", "digest").join(info, "digest")
             .select("doc_id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"),
                     (F.col("copies") - 1).alias("n_copies")))
    unnamed = (docs.filter(F.col(id_col).isNull())
               .select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"),
                       F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies")))
    return named.unionByName(unnamed)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class, the least id; rows with a null id all stay.

    Of several rows with one id the one with the least text stays (null first).
    """
    place = f"place_{uuid.uuid4().hex}"
    best = (near_duplicates(docs, id_col, text_col).filter("doc_id = class_id")
            .select(F.col("doc_id").alias(place)).distinct())
    one = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    named = (docs.join(best, F.col(id_col).cast("long") == F.col(place), "left_semi")
             .withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).drop(place))
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
