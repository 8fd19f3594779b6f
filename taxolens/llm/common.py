"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.session import cut_lineage, ensure_checkpoint_dir

MASK = (1 << 64) - 1
#: Bytes that all word caches of a worker hold together, keys and table slots counted.
CACHE_BYTES = 128 << 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the cluster names."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet below the shared folder and read again.

    For rounds: a checkpoint keeps the constraints of the plan that made it, which pile up from round to round and
    slow down planning; a table that is read starts afresh.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole_text(name: str = "text") -> Column:
    """The text column; null reads as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def ascii_words(text: str) -> list[bytes]:
    """Words of a text as UTF-8: runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def spaced_words(text: str) -> tuple[int, str]:
    """Number of the words of :func:`ascii_words`, and the text with a blank for every other character, also around it."""
    line = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    return len(line.split()), f" {line.decode('utf-8', 'surrogatepass')} "


def lower_words(text: str) -> list[bytes]:
    """Like :func:`ascii_words` after lower-casing every letter."""
    return ascii_words(text.lower())


class _Worker:
    """What a worker keeps from task to task of one stage: its word caches' room and its compiled models.

    A task of another stage finds both empty, so that what operators keep does not add up in a worker that is reused.
    """

    def __init__(self):
        self.left, self.stage = CACHE_BYTES, None
        self.caches: weakref.WeakValueDictionary[int, WordCache] = weakref.WeakValueDictionary()
        self.models: dict = {}

    def turn(self) -> None:
        task = TaskContext.get()
        stage = task.stageId() if task else None
        if stage != self.stage:
            self.stage = stage
            self.models.clear()
            for cache in list(self.caches.values()):
                cache.clear()

    def model(self, key: tuple, make: Callable):
        """A model by its key, made once a stage."""
        self.turn()
        if key not in self.models:
            self.models[key] = make()
        return self.models[key]


_WORKER = _Worker()


class WordCache(dict):
    """Results by word, made when missing, kept while the worker's caches have room for them and this one holds less
    than ``most`` bytes.

    A cache belongs to a model of the stage: taking the model at the start of a task empties those of other stages.
    """

    def __init__(self, make: Callable | None = None, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.used, self.most = make, 0, most
        _WORKER.caches[id(self)] = self

    def __missing__(self, key):
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        """Keep a result if there is room."""
        # a table slot and the two objects: their heads, their bytes (four for a character at most)
        size = 200 + 4 * len(key) + (len(value) if isinstance(value, bytes) else 0)
        if size <= _WORKER.left and size <= self.most - self.used:
            _WORKER.left -= size
            self.used += size
            self[key] = value

    def add(self, results: dict[str, bytes]) -> None:
        """Keep results while there is room, which is counted once for all."""
        room = most = min(_WORKER.left, self.most - self.used)
        for key, value in results.items():
            size = 200 + (1 if key.isascii() else 4) * len(key) + len(value)
            if size <= room:
                room -= size
                self[key] = value
        _WORKER.left -= most - room
        self.used += most - room

    def clear(self) -> None:
        super().clear()
        _WORKER.left += self.used
        self.used = 0

    def __del__(self):
        _WORKER.left += self.used


model_of_stage = _WORKER.model


def hash_words(words: list[bytes]) -> np.ndarray:
    # hashing a word costs hardly more than finding it in a table would
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array (wraps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; a shorter text is one run; none if empty."""
    if len(hashes) == 0:
        return hashes
    m = max(1, len(hashes) - n + 1)
    out = hashes[:m].copy()
    for k in range(1, min(n, len(hashes))):
        out = mix(out) + hashes[k:m + k]
    return mix(out)


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text."""
    return np.unique(gram_hashes(hash_words(lower_words(text)), n))


def hash_int(*parts: int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join((p & MASK).to_bytes(8, "little") for p in parts))


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of one group each from batches that are sorted by ``keys``.

    For use in ``mapInPandas`` after ``repartition`` and ``sortWithinPartitions`` by the keys; holds one group
    at a time, so callers bound the group size first.
    """
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if rest and any(rest[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = []
        lo = 0
        for hi in starts:
            piece = pdf.iloc[lo:hi]
            if rest:
                piece = pd.concat([*rest, piece], ignore_index=True)
                rest = []
            yield piece
            lo = hi
        rest.append(pdf.iloc[lo:])
    if rest:
        yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: ``(node, comp)``, comp the least node.

    Large-star and small-star steps in turn: each node is linked to the least node among its neighbours, so the
    edge list stays linear and a component of diameter d closes in about log d rounds. Each round is a grouped
    minimum (partial aggregation) and a join on the node, whose hot keys adaptive execution splits. It has closed
    once every node with a smaller neighbour has no other one, which the grouped minima show without a further
    round. Raises if it has not closed after ``max_rounds``. Self links and nulls are dropped.
    """
    e = rewritten(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        # the minima are kept, so that the joins deal out both sides and a hub can be split
        low = keep(e.unionByName(turned).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")))
        if low.filter("m < u and x <> m").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = keep(turned.join(low.select("u", F.least("u", "m").alias("m")), "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")))
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        # small star: the smaller neighbours and the node itself are linked to the least
        small = (large.join(low2, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = rewritten(small, "edges")
    raise RuntimeError(f"components did not close in {max_rounds} rounds")


def _bitmap(rows: DataFrame, probes: Callable[[int], list[Column]], most_bits: int) -> tuple[np.ndarray, int]:
    """A bitmap of 16 bits a row, at most ``most_bits``, with the bits that ``probes`` names set, and its size."""
    n = rows.count()
    bits = 64
    while bits < min(most_bits, 16 * max(1, n)):
        bits *= 2
    got = (rows.select(F.explode(F.array(*probes(bits))).alias("p"))
           .groupBy(F.shiftright("p", 5).alias("w"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b"))).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return table, bits


def likely_member(ids: DataFrame, most_bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A predicate over long ids that holds for all ``ids (id)`` and for few others, to thin rows before a join.

    A two-probe bitmap of 16 bits an id, never more than ``most_bits`` (8 MB), is broadcast; with more ids it
    lets more others pass, and the join behind it stays exact.
    """
    table, bits = _bitmap(ids, lambda bits: [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in (1, 2)], most_bits)
    sent = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def probe(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = np.ones(len(a), bool)
        for p in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            ok &= (sent.value[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
        return pd.Series(ok)

    return lambda c: probe(*(F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in (1, 2)))


def likely_word(words: DataFrame, most_bits: int = 1 << 26) -> Callable[[str], bool]:
    """A test for use inside tasks that holds for all ``words (word)`` and for few others, by a broadcast bitmap.

    Its probes are the halves of the 64-bit xxhash of the word's UTF-8 bytes, seed 42, as ``F.xxhash64`` has it.
    """
    high, low = F.shiftrightunsigned(F.xxhash64("word"), 32), F.xxhash64("word")
    table, bits = _bitmap(words, lambda bits: [F.pmod(h, F.lit(bits)) for h in (high, low)], most_bits)
    sent = words.sparkSession.sparkContext.broadcast(table)

    def holds(word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8"), 42)
        t, a, b = sent.value, (h >> 32) & (bits - 1), h & (bits - 1)
        return bool((t[a >> 5] >> (a & 31)) & (t[b >> 5] >> (b & 31)) & 1)

    return holds


def labelled(docs: DataFrame, labels: DataFrame, target: str, train: Column, max_labelled: int) -> DataFrame:
    """``(doc_id, text, <target>)`` of the rows to learn from: at most about ``max_labelled``, drawn by hash of the id.

    ``train`` selects by ``doc_id``. Labels outside 0 and 1 are left out; several labels of one id count as their
    largest. The drawn labels are broadcast, so that no text is shuffled: 12 bytes for each of ``max_labelled`` ids.
    """
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias(target))
           .filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).filter(train)
           .groupBy("doc_id").agg(F.max(target).alias(target)))
    lab = keep(lab)
    n = lab.count()
    if n > max_labelled:
        lab = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).join(F.broadcast(lab), "doc_id")


def logistic_on_bins(counts: Iterable[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over binned scores ``(value, n_zero, n_one)`` (damped Newton steps).

    One pseudo count in each class at the ends keeps the curve finite; the slope is never below 0. Without both
    classes the curve is flat at the smoothed rate.
    """
    rows = sorted(counts)
    zero, one = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = float(np.log((one + 1) / (zero + 1)))
    if not rows or not zero or not one:
        return 0.0, base
    x = np.array([r[0] for r in rows] + [rows[0][0], rows[-1][0]])
    n0 = np.array([r[1] for r in rows] + [0, 1], float)
    n1 = np.array([r[2] for r in rows] + [1, 0], float)
    n = n0 + n1
    mid = float((n * x).sum() / n.sum())
    wide = float(np.sqrt((n * (x - mid) ** 2).sum() / n.sum())) or 1.0
    z = (x - mid) / wide

    def loss(v: np.ndarray) -> float:
        t = v[0] * z + v[1]
        return float((n * np.logaddexp(0, t) - n1 * t).sum()) + 0.5e-3 * float(v[0] ** 2)

    v = np.array([0.0, base])
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v[0] * z + v[1], -35, 35)))
        g = np.array([((n * p - n1) * z).sum() + 1e-3 * v[0], (n * p - n1).sum()])
        w = n * p * (1 - p)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        # a full step may overshoot: halve it until the loss falls
        size = 1.0
        while size > 1e-6 and (after := loss(v - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - after < 1e-9:
            break
        v, now = v - size * step, after
    a = max(float(v[0]) / wide, 0.0)
    return a, float(v[1]) - a * mid


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def each_batch(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """A ``mapInPandas`` function from one that maps a frame to a frame."""
    def run(batches):
        for pdf in batches:
            out = fn(pdf)
            if len(out):
                yield out
    return run


LINE = re.compile(r"[^\n]+")
