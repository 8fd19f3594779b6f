"""URL filters: rules over hosts and paths, and a Bloom filter cascade for listed keys.

The cascade knows the corpus's complete key universe. Level 0 is a Bloom filter of the listed keys; level 1 holds the
other keys that level 0 passes by mistake, level 2 the listed keys that level 1 passes, and so on until a level makes
no mistake on the universe. A key is judged by the first level that rejects it, so membership is exact for every key
of the universe, with no join: a lookup reads a few bits. Levels are built in parallel (each task sets bits in a
bitmap of bounded size, tasks are or-ed by words on Spark). Keys are dealt into shards by hash; the levels of as many
shards as fit into ``BROADCAST_BYTES`` are sent at a time, so a larger list takes more passes and stays exact.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null key is not listed; listed keys
outside the universe are added to it; repeated keys count once; an empty list has no level and lists nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep

FIRST_RATE = 0.02
LATER_RATE = 0.3
BROADCAST_BYTES = 32_000_000
MAX_LEVELS = 64

#: The rules (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words whose presence as a part of a host name lists it.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


@dataclass
class Level:
    """A Bloom filter: ``bits`` as 64-bit words, ``hashes`` probes, its own ``seed``."""
    bits: np.ndarray
    hashes: int
    seed: int

    def passes(self, keys: list[str]) -> np.ndarray:
        at = probes(keys, self.hashes, len(self.bits) * 64, self.seed)
        return (((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1).all(axis=1)


@dataclass
class Cascade:
    """Levels of one shard of the keys."""
    levels: list[Level]

    def contains(self, keys: list[str]) -> np.ndarray:
        """Whether each key is listed: the first level that rejects it decides, an odd one for, an even one against."""
        listed = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            ok = level.passes([keys[i] for i in open_])
            listed[open_[~ok]] = k % 2 == 1
            open_ = open_[ok]
        return listed

    def nbytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def probes(keys: list[str], hashes: int, n_bits: int, seed: int) -> np.ndarray:
    """Bit positions of every key, a row each (double hashing)."""
    raw = [xxhash.xxh3_128_intdigest(k.encode("utf-8", "surrogatepass"), seed) for k in keys]
    a = np.array([r & ((1 << 64) - 1) for r in raw], np.uint64)
    b = np.array([r >> 64 for r in raw], np.uint64) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(n_bits)).astype(np.int64)


def shape(n: int, rate: float) -> tuple[int, int]:
    """Words and probes of a filter for n keys at a false-positive rate."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64), max(1, round(bits / max(n, 1) * math.log(2)))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the keys of a frame ``(key)``: bitmaps of tasks, or-ed word by word."""
    words, hashes = shape(n, rate)

    def run(batches):
        bits = np.zeros(words, np.uint64)
        for pdf in batches:
            at = probes(pdf["key"].tolist(), hashes, words * 64, seed).ravel()
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(bits)
        yield pd.DataFrame({"at": some, "w": bits[some].view(np.int64)})

    got = keys.mapInPandas(run, "at long, w long").groupBy("at").agg(F.bit_or("w").alias("w")).collect()
    out = np.zeros(words, np.uint64)
    for r in got:
        out[r["at"]] = np.int64(r["w"]).view(np.uint64)
    return Level(out, hashes, seed)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[sent.value.passes(pdf["key"].tolist())]

    return keys.mapInPandas(run, "key string")


def build(listed: DataFrame, universe: DataFrame, seed: int = 1) -> Cascade:
    """The cascade of one shard: ``listed`` and ``universe`` are frames ``(key)`` without repeated keys."""
    inside, outside = keep(listed), keep(universe.join(listed, "key", "left_anti"))
    n_in = inside.count()
    levels: list[Level] = []
    if not n_in:
        return Cascade(levels)
    held, other, n = inside, outside, n_in
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not close")
        levels.append(_level(held, n, LATER_RATE if levels else FIRST_RATE, seed + len(levels)))
        wrong = keep(_passing(other, levels[-1]))
        held, other, n = wrong, held, wrong.count()
    return Cascade(levels)


def _lookup(sent):
    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        # a column repeats few keys; each is looked up once a batch
        codes, some = pd.factorize(keys)
        return pd.Series(np.append(sent.value.contains(list(some)), False)[codes], index=keys.index)

    return hit


def member(rows: DataFrame, key: str, listed: DataFrame, universe: DataFrame, out: str = "listed") -> DataFrame:
    """``rows`` with a boolean column ``out``: whether the key is listed. ``universe`` holds all keys of the rows."""
    wanted = keep(listed.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct())
    n = wanted.count()
    everything = keep(universe.select(F.col("key").cast("string").alias("key")).filter("key is not null")
                      .unionByName(wanted).distinct())
    # later levels together take less than the first again
    shards = max(1, math.ceil(2 * 8 * shape(n, FIRST_RATE)[0] / BROADCAST_BYTES))
    result = rows.withColumn(out, F.lit(False))
    for s in range(shards):
        mine = F.pmod(F.xxhash64("key"), F.lit(shards)) == s
        cascade = build(wanted.filter(mine), everything.filter(mine), seed=1 + 1000 * s)
        hit = _lookup(rows.sparkSession.sparkContext.broadcast(cascade))
        here = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)) == s
        looked = hit(F.col(key).cast("string"))
        result = result.withColumn(out, looked if shards == 1 else F.col(out) | (here & looked))
    return result


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for a null url or one without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path of a url: after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or its parent domain) and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def names_listed_word(host: Column, words=LISTED_WORDS) -> Column:
    """Whether a listed word stands as a part of a host name (between dots and hyphens)."""
    return host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")


def judge(pages: DataFrame, rules=RULES, words=LISTED_WORDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page: the longest rule's verdict, else block if listed.

    The listed keys are the corpus's hosts that name a listed word; the universe is all its hosts.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = keep(seen.select(F.col("host").alias("key")).distinct())
    listed = universe.filter(names_listed_word(F.col("key"), words))
    known = member(seen, "host", listed, universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return known.select("page_id", "host", "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
                        .alias("verdict"))


def judge_sql(rules=RULES, words=LISTED_WORDS) -> str:
    """DuckDB SQL for the rows of :func:`judge` over ``pages``."""
    values = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in rules)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, host, path, rule) AS (VALUES {values}),
fit AS (SELECT u.*, (SELECT max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) FROM rules r
               WHERE (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)) AS hit FROM u)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(words)})([.-]|$)')
                                  THEN 'block' ELSE 'allow' END) AS verdict
FROM fit"""
