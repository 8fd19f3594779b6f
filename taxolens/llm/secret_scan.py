"""Secret scans: a recursive decoding worklist unwraps nested layers, scans each one and maps its spans to the text.

The base scans the text itself for three kinds: assignments, access keys and runs of hexadecimal digits. The worklist
starts with the text. Every layer is scanned, then everything in it that decodes becomes a new layer: URL escapes and
Unicode escapes (in the lines that hold them), base64 runs (also url-safe or wrapped over lines) whose bytes are text, and
base64 runs whose bytes are compressed (gzip, zlib, zstandard, bzip2, xz), also several times over. It ends when no layer
is new: a layer that gives a known text at the same place of the document is not taken up again, so a
cycle (a layer that decodes to itself) ends as well.

Every character of a layer knows the code points of the document that it came from. A character of an escape or of
base64 comes from the escape or the base64 digits that hold its bits; characters of a compressed layer come from the whole
run. So each finding is a span of the document, whatever the depth.

Bounded memory: decompression goes on in windows of ``WINDOW`` bytes, each a layer that repeats the last ``OVERLAP``
characters of the one before; nothing is cut off, and a finding of up to ``OVERLAP`` characters is whole in one of
them. The worklist is a stack of generators, so one window of each depth is held.

Defined cases: null and empty texts have no spans; findings of the same kind, span and characters count once; equal starts go by
kind as listed in ``KINDS``, then by end; decoded bytes that are neither text nor a known compression are no layer;
damaged or cut compressed data gives what can be read of it, its bytes that are no UTF-8 as U+FFFD; compressed streams
that begin with the same ``WINDOW`` bytes at the same place are one; null ids keep their row; other columns are unread.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import whole_text

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed layer that are held at once, and characters that windows share.
WINDOW, OVERLAP = 1 << 20, 1 << 14

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?:\r?\n[A-Za-z0-9+/_-]+={0,2})*")
_DIGITS = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Control characters that no text layer holds.
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0E-\x1F\x7F]")
_LINE = re.compile(r"[^\n]*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    layers: str = ""
    found: str = ""


class Layer:
    """A text and, for each of its characters, the code points of the document that it came from.

    ``starts`` and ``ends`` are None for the document itself, whole numbers if all characters share one place, else lists.
    """

    __slots__ = ("text", "starts", "ends", "path")

    def __init__(self, text: str, starts=None, ends=None, path: str = ""):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def place(self, lo: int, hi: int) -> tuple[int, int]:
        """Span of the document for the characters ``lo`` to ``hi`` (exclusive, not empty)."""
        if self.starts is None:
            return lo, hi
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[lo], self.ends[hi - 1]

    def key(self) -> tuple:
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
                self.place(0, len(self.text)))


def findings(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base patterns in one text."""
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _utf8_lengths(text: str) -> Iterator[int]:
    return (1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text)


def _unescape_url(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of ``%XX`` with their places in it; bytes that are no UTF-8 stay as they are written."""
    at = 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            raw = run[at:at + 3 * n]
            try:
                char = bytes.fromhex(raw.replace("%", "")).decode() if len(raw) == 3 * n else ""
            except UnicodeDecodeError:
                char = ""
            if char:
                yield char, at, at + 3 * n
                at += 3 * n
                break
        else:
            yield from ((run[k], k, k + 1) for k in range(at, at + 3))
            at += 3


def _unescape_unicode(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of Unicode escapes with their places; pairs of surrogates are joined, numbers out of range stay."""
    if run[1] == "u" and run[2] != "{":
        codes = [int(run[k + 2:k + 6], 16) for k in range(0, len(run), 6)]
        k = 0
        while k < len(codes):
            pair = 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000
            if pair:
                yield chr(0x10000 + ((codes[k] - 0xD800) << 10) + codes[k + 1] - 0xDC00), 6 * k, 6 * k + 12
            elif 0xD800 <= codes[k] < 0xE000:
                yield from ((run[j], j, j + 1) for j in range(6 * k, 6 * k + 6))
            else:
                yield chr(codes[k]), 6 * k, 6 * k + 6
            k += 2 if pair else 1
        return
    code = int(run[2:].strip("{}"), 16)
    if code < 0x110000 and not 0xD800 <= code < 0xE000:
        yield chr(code), 0, len(run)
    else:
        yield from ((c, k, k + 1) for k, c in enumerate(run))


def _unescaped_lines(layer: Layer, escape: re.Pattern, unescape, name: str) -> Iterator[Layer]:
    """The lines with escapes, each with its escapes decoded."""
    at = 0
    while (m := escape.search(layer.text, at)) is not None:
        lo = layer.text.rfind("\n", 0, m.start()) + 1
        hi = _LINE.match(layer.text, m.end()).end()
        text, starts, ends, before = [], [], [], lo
        for m in escape.finditer(layer.text, lo, hi):
            for char, a, b in (*((layer.text[k], k, k + 1) for k in range(before, m.start())),
                               *((c, m.start() + a, m.start() + b) for c, a, b in unescape(m.group()))):
                a, b = layer.place(a, b)
                text.append(char)
                starts.append(a)
                ends.append(b)
            before = m.end()
        for k in range(before, hi):
            a, b = layer.place(k, k + 1)
            text.append(layer.text[k])
            starts.append(a)
            ends.append(b)
        yield Layer("".join(text), starts, ends, f"{layer.path}/{name}")
        at = hi + 1


def _decompressor(raw: bytes):
    """Name and a new decompressor for bytes that start like a compressed stream; None if they don't."""
    if raw[:3] == b"\x1f\x8b\x08":
        return "gzip", zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", None
    if raw[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor()
    return None


class _Source:
    """Bytes that arrive in pieces, read like a file."""

    def __init__(self, pieces):
        self.pieces, self.rest = iter(pieces), b""

    def read(self, n: int = WINDOW) -> bytes:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return b""
            self.rest = piece
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _pieces(source: _Source, name: str, worker) -> Iterator[bytes]:
    """Decompressed bytes in pieces of at most ``WINDOW``; stops quietly where the data is damaged."""
    try:
        if name == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(source) as reader:
                while piece := reader.read(WINDOW):
                    yield piece
            return
        rest = b""
        while not worker.eof:
            if not rest and getattr(worker, "needs_input", True):
                rest = source.read(1 << 16)
            ended = not rest
            piece = worker.decompress(rest, WINDOW)
            rest = getattr(worker, "unconsumed_tail", b"")
            if piece:
                yield piece
            elif ended:
                return
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError):
        return


def _as_text(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def _unpacked(packed: Iterator[bytes], lo: int, hi: int, path: str, known: set) -> Iterator[Layer]:
    """Text layers of compressed bytes, window by window; compressed bytes within them are unpacked again."""
    first = next(packed, b"")
    kind = _decompressor(first)
    key = (hashlib.blake2b(first, digest_size=16).digest(), lo, hi)
    if kind is None or key in known:
        return
    known.add(key)
    path = f"{path}/{kind[0]}"
    pieces = _pieces(_Source(chain([first], packed)), *kind)
    first = next(pieces, b"")
    if _decompressor(first):
        yield from _unpacked(chain([first], pieces), lo, hi, path, known)
        return
    decode, tail = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    for piece in chain([first], pieces):
        tail += decode(piece)
        yield Layer(tail, lo, hi, path)
        tail = tail[-OVERLAP:]


def _base64_layers(layer: Layer, run: str, at: list[int], known: set) -> Iterator[Layer]:
    """Layers of one base64 run whose digits stand at the given places of the layer."""
    digits = run.rstrip("=")
    if len(digits) % 4 == 1 or len(digits) < 16 or "=" in digits:
        return
    raw = base64.b64decode(digits.translate(_STANDARD) + "=" * (-len(digits) % 4))
    text = _as_text(raw)
    if text is None:
        yield from _unpacked(iter([raw]), *layer.place(at[0], at[len(run) - 1] + 1), f"{layer.path}/base64", known)
        return
    starts, ends, byte = [], [], 0
    for n in _utf8_lengths(text):
        starts.append(layer.place(at[byte * 8 // 6], at[byte * 8 // 6] + 1)[0])
        byte += n
        last = -(-byte * 8 // 6) - 1
        ends.append(layer.place(at[last], at[last] + 1)[1])
    yield Layer(text, starts, ends, f"{layer.path}/base64")


_STANDARD = str.maketrans("-_", "+/")


def unwrapped(layer: Layer, known: set) -> Iterator[Layer]:
    """All layers that decode from one."""
    yield from _unescaped_lines(layer, _URL, _unescape_url, "url")
    yield from _unescaped_lines(layer, _UNICODE, _unescape_unicode, "unicode")
    for m in _BASE64.finditer(layer.text):
        if "\n" in m.group():
            at = [k for k in range(m.start(), m.end()) if layer.text[k] not in "\r\n"]
            yield from _base64_layers(layer, "".join(layer.text[k] for k in at), at, known)
        for one in _DIGITS.finditer(layer.text, m.start(), m.end()):
            yield from _base64_layers(layer, one.group(), range(one.start(), one.end()), known)


def secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and those that only its decoded layers have; each ordered by start, kind and end."""
    base = {(kind, lo, hi): Span(kind, lo, hi, "", text[lo:hi]) for kind, lo, hi in findings(text)}
    added: dict[tuple, Span] = {}
    known: set = set()
    work = [unwrapped(Layer(text), known)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text or (key := layer.key()) in known:
            continue
        known.add(key)
        for kind, lo, hi in findings(layer.text):
            place = (kind, *layer.place(lo, hi))
            if place not in base:
                added.setdefault((*place, layer.text[lo:hi]), Span(*place, layer.path[1:], layer.text[lo:hi]))
        work.append(unwrapped(layer, known))

    def order(s: Span):
        return s.start, KINDS.index(s.kind), s.end

    return sorted(base.values(), key=order), sorted(added.values(), key=order)


def joined(spans: list[Span]) -> str:
    """Digest of spans: ``kind:start:end`` of each, by start, kind and end; repeated ones once."""
    return ",".join(dict.fromkeys(f"{s.kind}:{s.start}:{s.end}" for s in
                                  sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a finding: ``doc_id, kind, start, end, layers, found``; ``layers`` is '' for the text itself."""
    def run(batches):
        for pdf in batches:
            rows = [(d, *s) for d, t in zip(pdf["doc_id"], pdf["text"]) for part in secrets(t) for s in part]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", *Span._fields])

    return _long_id(_source(docs, id_col, text_col).mapInPandas(
        run, "doc_id string, kind string, start long, end long, layers string, found string"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids travel as text: a null among long ones would turn a batch of them into doubles."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), whole_text(text_col).alias("text"))


def _long_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added`` of every document."""
    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, added = secrets(text)
                rows.append((*(sum(s.kind == k for s in base) for k in KINDS),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return _long_id(_source(docs, id_col, text_col).mapInPandas(
        run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"))


def base_sql() -> str:
    """DuckDB SQL for the base columns of :func:`scan` over ``documents`` (the decoded layers are beyond SQL).

    A match's place is the length of the pieces and the matches before it.
    """
    key = re.sub("[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", "password|passwd|secret|token|api_?key")
    patterns = {"assign": rf"""(?:{key})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
                "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"assign": "len(regexp_extract(m, '" + patterns["assign"] + "', 1)) >= 6", "access": "len(m) >= 20",
             "hex": "len(m) >= 24"}
    found = " || ".join(f"""
        list_filter(list_transform(regexp_extract_all(t, '{p}'), lambda m, i: {{
            'at': list_sum(list_transform(string_split_regex(t, '{p.replace("([", "(?:[")}')[1:i], lambda x: len(x)))
                  + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: len(x))), 0),
            'rank': {k}, 'kind': '{kind}', 'len': len(m), 'ok': {least[kind]}}}), lambda s: s.ok)"""
                        for k, (kind, p) in enumerate(patterns.items()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(list_transform({found}, lambda s:
          {{'at': s.at::BIGINT, 'rank': s.rank, 'kind': s.kind, 'end': (s.at + s.len)::BIGINT}})) AS spans FROM d)
SELECT doc_id, len(list_filter(spans, lambda s: s.kind = 'assign'))::BIGINT AS n_assign,
       len(list_filter(spans, lambda s: s.kind = 'access'))::BIGINT AS n_access,
       len(list_filter(spans, lambda s: s.kind = 'hex'))::BIGINT AS n_hex,
       sha256(array_to_string(list_transform(spans, lambda s: concat(s.kind, ':', s.at, ':', s.end)), ','))
           AS base_sha256
FROM s"""
