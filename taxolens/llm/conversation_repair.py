"""Conversation structure repair: cheapest edits by an auction for shortest paths over an integer-cost lattice.

A repaired conversation has role initials ``(s?(ua)+)?``: nothing, or an optional system row and whole pairs of user and
assistant. Rows are blank, duplicate or truncated (their first fault counts). Edits: Keep (0), Rerole to user or assistant
(1), Delete (2; the only one for blank and duplicate rows), Insert an empty user or assistant row (5); a truncated row that
is not deleted adds 5.

The lattice has a node for every (rows read, state), states being: nothing yet, after s, after u, after a. The auction
keeps node prices p with p(i) <= cost(i, j) + p(j) and a path from the source on which equality holds. The path is
extended by its best arc, or, when the price of its end is below its best arc, that price is raised and the path
contracted. Once the path reaches the sink, the source's price is its distance, and every cheapest path consists of
tight arcs (equality), so the first edits in ASCII order are traced over the tight arcs that lead on to the sink.

Long conversations are cut into ``BLOCK`` rows, solved from the last block to the first: the four prices at a block's
start are the costs of leaving the block before it. So the work is linear in the rows, and a task holds one byte a row
of a conversation plus the edits that it returns, never its texts. Blocks that look alike are solved once.

Stages: the rows' marks (no texts) are shuffled by conversation, marked and solved in one sorted stream; then the texts
and the edits are shuffled by conversation and streamed in order into the repaired rows or their hash. A hash over a
whole conversation has to read its rows in order; it is fed row by row.

Defined cases: null roles and texts read as one space, as do null ids and turns in the key of :func:`damage`; null ids
are one conversation; null turns come first; rows with equal turns follow by role, then by the SHA-256 of their text; a
conversation without rows has zeros, no edits and the hash of the empty string; other columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolens.llm.common import rewritten

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 32
#: State reached and initial written when a conversation in a state goes on with a user or an assistant row.
NEXT = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
ROLES = {"u": "user", "a": "assistant"}
#: Mark of a row that has to go. Others are marked by their role's initial, upper case if truncated ("x": any other).
GONE = "-"
LEGAL = {"su", "ua", "au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SPACES = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def arcs(marks: str, ahead: tuple, last: bool) -> list[list[tuple[str, int, int]]]:
    """Outgoing arcs ``(letter, node, cost)`` of every node of a block; node 4 i + q is state q after i rows.

    The sink is the last node; ``ahead[q]`` is the cost from the block's end in state q to the conversation's end (None:
    it can't end there). Rows are inserted before the block's rows, and after them only in the last block.
    """
    n = len(marks)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(4 * n + 5)]
    for i in range(n + 1):
        for q, (to, want) in NEXT.items():
            here = out[4 * i + q]
            if i < n:
                here.append(("D", 4 * i + 4 + q, DELETE))
                if marks[i] != GONE:
                    extra, initial = (TRUNCATED if marks[i].isupper() else 0), marks[i].lower()
                    if initial == want:
                        here.append(("K", 4 * i + 4 + to, extra))
                    else:
                        here.append(("R", 4 * i + 4 + to, REROLE + extra))
                    if q == 0 and initial == "s":
                        here.append(("K", 4 * i + 5, extra))
            elif ahead[q] is not None:
                here.append(("", 4 * n + 4, ahead[q]))
            if i < n or last:
                here.append(("I", 4 * i + to, INSERT))
    return out


def auction(out: list[list[tuple[str, int, int]]], sources: range) -> list[int]:
    """Node prices after the auction has led a path from each source to the sink (the last node)."""
    price = [0] * len(out)
    sink = len(out) - 1
    for source in sources:
        path = [source]
        while path[-1] != sink:
            i = path[-1]
            value, j = min((cost + price[j], j) for _, j, cost in out[i])
            if price[i] < value:
                price[i] = value
                if len(path) > 1:
                    path.pop()
            else:
                path.append(j)
    return price


def tight_arcs(out: list[list[tuple[str, int, int]]], price: list[int]) -> list[list[tuple[str, int]]]:
    """For every node its tight arcs ``(letter, node)`` that lead on to the sink by tight arcs, in ASCII order."""
    sink = len(out) - 1
    lead: list[list[tuple[str, int]]] = [[] for _ in out]
    live = [False] * sink + [True]
    for first in range(sink - 4, -1, -4):
        # an insertion stays among the four nodes; two in a row are the most that a tight path has
        for _ in range(3):
            for i in range(first, first + 4):
                lead[i] = sorted((a, j) for a, j, cost in out[i] if live[j] and price[i] == cost + price[j])
                live[i] = bool(lead[i])
    return lead


@lru_cache(maxsize=1 << 14)
def solve_block(marks: str, ahead: tuple, last: bool) -> tuple[tuple[int, str, int], ...]:
    """For each state at a block's start: cost to the conversation's end, edits within the block, state at its end."""
    out = arcs(marks, ahead, last)
    price = auction(out, range(4))
    lead = tight_arcs(out, price)
    found = []
    for q in range(4):
        edits, i = [], q
        while lead[i][0][0]:
            letter, i = lead[i][0]
            edits.append(letter)
        found.append((price[q], "".join(edits), i % 4))
    return tuple(found)


def cheapest_edits(marks: str) -> tuple[int, str]:
    """Cost and edits of a conversation given by its rows' marks; equal costs: the first in ASCII order."""
    blocks, ahead, base = [], (0, None, None, 0), 0
    for lo in range((max(len(marks), 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        found = solve_block(marks[lo:lo + BLOCK], ahead, lo + BLOCK >= len(marks))
        least = min(cost for cost, _, _ in found)
        # costs are passed on relative to the least, so that like blocks are solved once
        ahead = tuple(cost - least for cost, _, _ in found)
        base += least
        blocks.append([(edits, to) for _, edits, to in found])
    state, edits = 0, []
    for block in reversed(blocks):
        part, state = block[state]
        edits.append(part)
    return base + ahead[0], "".join(edits)


def damage(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Rows ``(conv, turn, role, text, gone)`` with faults by the crc32 of ``conv:turn`` modulo 20.

    0: gone, 1: the text is emptied, 2: it loses its ``.!?``, 3: the row comes twice, 4: the role is user.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    k = F.col("k")
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"),
                        spaced(text).alias("text"),
                        (F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20).alias("k"))
    return rows.select(
        "conv", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (k == 0).alias("gone"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def untouched(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """Rows in the form of :func:`damage`, as they are."""
    return convs.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n)
                          for c, n in ((role, "role"), (text, "text"))), F.lit(False).alias("gone"))


#: Order of a conversation's rows (null turns first).
_ORDER = ("turn", "role", "hash")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.unhex(F.sha2("text", 256)))


def _conv_type(df: DataFrame) -> T.DataType:
    return df.schema["conv"].dataType


def plan_edits(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation of ``rows``."""
    body = F.expr(f"trim(TRAILING {SPACES} FROM text)")
    light = (_hashed(rows).select("conv", "turn", "role", "hash", "gone", (body == "").alias("blank"),
                                  (~F.expr(f"right(trim(TRAILING {SPACES} FROM text), 1)").isin(".", "!", "?"))
                                  .alias("cut"), F.substring("role", 1, 1).alias("initial"))
             .repartition("conv"))
    # rows are already dealt out by conversation, so the window needs no further shuffle
    seen = Window.partitionBy("conv", "role", "hash", "gone").orderBy(F.col("turn").asc_nulls_first())
    light = (light.withColumn("again", F.row_number().over(seen) > 1)
             .sortWithinPartitions("conv", *_ORDER)
             .select("conv", "turn", "initial", "gone", "blank", "again", "cut"))
    schema = T.StructType([T.StructField("conv", _conv_type(rows))]
                          + [T.StructField(c, T.LongType()) for c in _COUNTS]
                          + [T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, done in _by_conversation(batches):
            yield _batch(done, kind, **dict.fromkeys(_COUNTS, pa.int64()), audit=pa.string())

    return light.mapInArrow(run, schema)


def _batch(rows: list[dict], conv: pa.DataType, **columns: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv", conv), *columns.items()]))


class _Conversation:
    """Counts and marks of the conversation being read, row by row in order."""

    def __init__(self, conv):
        self.conv, self.marks, self.before = conv, bytearray(), None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        mark = initial if initial in ("s", "u", "a") else "x"
        if blank:
            self.blank, mark = self.blank + 1, GONE
        elif again:
            self.duplicate, mark = self.duplicate + 1, GONE
        elif cut:
            self.truncated, mark = self.truncated + 1, mark.upper()
        self.marks += mark.encode()

    def result(self) -> dict:
        cost, audit = cheapest_edits(self.marks.decode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[dict]]]:
    now = kind = None
    for batch in batches:
        done, kind = [], batch.schema.field(0).type
        for conv, turn, initial, gone, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv)
            if not gone:
                now.add(turn, initial, blank, again, cut)
        if done:
            yield kind, done
    if now is not None:
        yield kind, [now.result()]


class _Edited:
    """The repaired rows of one conversation: edits are used up as its rows are read in order."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0

    def _next(self) -> str:
        self.state, initial = NEXT[self.state]
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K" and self.state == 0 and role[:1] == "s":
            self.state = 1
            yield role, text
        elif edit != "D":
            new = self._next()
            yield (role if edit == "K" else new), text


def _edited_stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Edits (``kind`` 0) and rows (``kind`` 1) of each conversation, in order within one partition."""
    texts = _hashed(rows.filter("not gone")).select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "hash")
    heads = plans.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("hash"))
    return (heads.unionByName(texts).repartition("conv")
            .sortWithinPartitions("conv", "kind", *_ORDER).select("conv", "kind", "role", "text"))


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv, place, role, text``, places from 0."""
    schema = T.StructType([T.StructField("conv", _conv_type(rows)), T.StructField("place", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        now, place, kinds = None, 0, {"place": pa.int64(), "role": pa.string(), "text": pa.string()}
        for batch in batches:
            done, key = [], batch.schema.field(0).type

            def put(made, done=done):
                nonlocal place
                for role, text in made:
                    done.append({"conv": now.conv, "place": place, "role": role, "text": text})
                    place += 1

            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    put(now.row(role, text))
                    continue
                if now is not None:
                    put(now.inserted())
                now, place = _Edited(conv, text), 0
            yield _batch(done, key, **kinds)
        if now is not None:
            yield _batch([{"conv": now.conv, "place": place + k, "role": role, "text": text}
                          for k, (role, text) in enumerate(now.inserted())], key, **kinds)

    return _edited_stream(rows, plans).mapInArrow(run, schema)


def repaired_hashes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of every conversation: the hash of its repaired ``role:text`` lines."""
    schema = T.StructType([T.StructField("conv", _conv_type(rows)), T.StructField("repaired_sha256", T.StringType())])

    class Hash:
        def __init__(self, conv, audit):
            self.edited, self.sha, self.first = _Edited(conv, audit), hashlib.sha256(), True

        def put(self, made):
            for role, text in made:
                self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.first = False

        def result(self):
            self.put(self.edited.inserted())
            return {"conv": self.edited.conv, "repaired_sha256": self.sha.hexdigest()}

    def run(batches):
        now = None
        for batch in batches:
            done, key = [], batch.schema.field(0).type
            for conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    now.put(now.edited.row(role, text))
                    continue
                if now is not None:
                    done.append(now.result())
                now = Hash(conv, text)
            if done:
                yield _batch(done, key, repaired_sha256=pa.string())
        if now is not None:
            yield _batch([now.result()], key, repaired_sha256=pa.string())

    return _edited_stream(rows, plans).mapInArrow(run, schema)


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows, for every conversation of :func:`damage`'s rows."""
    plans = rewritten(plan_edits(rows), "conversation-plans")
    hashes = repaired_hashes(rows, plans)
    both = plans.join(hashes, plans["conv"].eqNullSafe(hashes["conv"]))
    return both.select(plans["conv"].alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       "repaired_sha256")


def repair_sql() -> str:
    """DuckDB SQL for the rows of :func:`repair` after :func:`damage` over ``conversations``.

    Costs and edits come from a recursive sweep over the rows that keeps, for each state, the least (cost, edits).
    """
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    after = {q: to for q, (to, _) in NEXT.items()}

    def inserted(source: str) -> str:
        """The rows of a table of states and those that up to two insertions reach from them."""
        step = "CASE q WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END"
        one = f"SELECT conv, i, {step} AS q, cost + {INSERT} AS cost, audit || 'I' AS audit FROM {source}"
        two = f"SELECT conv, i, {step} AS q, cost + {INSERT} AS cost, audit || 'I' AS audit FROM ({one})"
        return f"SELECT conv, i, q, cost, audit FROM {source} UNION ALL {one} UNION ALL {two}"

    expected = "CASE s.q WHEN 2 THEN 'a' ELSE 'u' END"
    onward = "CASE s.q WHEN 2 THEN 3 ELSE 2 END"
    assert after == {0: 2, 1: 2, 2: 3, 3: 2}
    return f"""
WITH RECURSIVE raw AS (
    SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
        lambda crc, byte: list_reduce(range(0, 8), lambda v, k:
            CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)),
        4294967295::BIGINT), 4294967295) % 20 AS k FROM raw),
damaged AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM hashed WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                  rtrim(text, {space}) AS body, left(role, 1) AS initial FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
                lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM placed),
marked AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
                          WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
convs AS (SELECT DISTINCT conv FROM raw),
counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
           FROM marked GROUP BY conv),
start AS (SELECT conv, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM convs),
sweep(conv, i, q, cost, audit) AS (
    SELECT * FROM ({inserted('start')})
    UNION ALL
    SELECT conv, i, q, best.cost, best.audit FROM (
        SELECT conv, i, q, min({{'cost': cost, 'audit': audit}}) AS best FROM (
            WITH moved AS (
                SELECT s.conv, m.i, e.q, s.cost + e.cost AS cost, s.audit || e.letter AS audit
                FROM sweep s JOIN marked m ON m.conv IS NOT DISTINCT FROM s.conv AND m.i = s.i + 1,
                LATERAL (SELECT unnest([
                    {{'q': s.q, 'cost': {DELETE}, 'letter': 'D', 'ok': TRUE}},
                    {{'q': {onward}, 'cost': CASE WHEN m.initial = {expected} THEN 0 ELSE {REROLE} END
                        + CASE WHEN m.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
                      'letter': CASE WHEN m.initial = {expected} THEN 'K' ELSE 'R' END,
                      'ok': m.fault IN ('', 'truncated')}},
                    {{'q': 1, 'cost': CASE WHEN m.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, 'letter': 'K',
                      'ok': s.q = 0 AND m.initial = 's' AND m.fault IN ('', 'truncated')}}]) AS e)
                WHERE e.ok)
            {inserted('moved')})
        GROUP BY conv, i, q)),
solved AS (SELECT c.conv, min({{'cost': s.cost, 'audit': s.audit}}) AS best
           FROM convs c LEFT JOIN counts n ON n.conv IS NOT DISTINCT FROM c.conv
           JOIN sweep s ON s.conv IS NOT DISTINCT FROM c.conv AND s.i = coalesce(n.n, 0) WHERE s.q IN (0, 3)
           GROUP BY c.conv),
letters AS (SELECT conv, unnest(string_split(best.audit, '')) AS letter,
                   unnest(range(1, len(best.audit) + 1)) AS nr FROM solved WHERE best.audit <> ''),
numbered AS (SELECT *, sum((letter <> 'I')::INTEGER) OVER w AS i, sum((letter <> 'D')::INTEGER) OVER w AS made
             FROM letters WINDOW w AS (PARTITION BY conv ORDER BY nr)),
made AS (SELECT n.conv, n.nr, n.made, n.letter, m.role, m.text,
                bool_or(n.made = 1 AND n.letter = 'K' AND m.initial = 's') OVER (PARTITION BY n.conv) AS led
         FROM numbered n LEFT JOIN marked m ON m.conv IS NOT DISTINCT FROM n.conv AND m.i = n.i AND n.letter <> 'I'
         WHERE n.letter <> 'D'),
hashes AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role
                       WHEN (made - led::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
                       chr(10) ORDER BY nr)) AS hash FROM made GROUP BY conv)
SELECT s.conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, s.best.cost::BIGINT AS cost, s.best.audit AS audit,
       coalesce(hash, sha256('')) AS repaired_sha256
FROM solved s LEFT JOIN counts n ON n.conv IS NOT DISTINCT FROM s.conv
LEFT JOIN hashes h ON h.conv IS NOT DISTINCT FROM s.conv"""
