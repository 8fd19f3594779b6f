"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled into three transducers. The normaliser writes a white-space mark before the text and for each
space (identity otherwise, as the model's own does). The piece transducer has an arc for every piece of the
vocabulary; after an arc it remembers the piece, and for a merge-ranked (BPE) model an arc may follow another only if
the merge ranks split the two pieces' joint string just there. The byte fallback has an arc for any other character,
writing its UTF-8 byte pieces. Composition with an input is an acyclic graph over its positions, and the encoding is
its shortest path in the tropical semiring: arc weights are minus the piece scores for a unigram model, and 1 for a
merge-ranked one, where exactly one path is accepted, so its ids equal those of the public library on the same file.

An automaton over the beginnings of pieces (Aho-Corasick) names the arcs that end at a position in one step a character.
No piece crosses certain pairs of characters (derived from the vocabulary: between white space and what follows a
word, and between word characters and others), so the graph falls apart there; a worker composes each distinct part
once and reads it from a bounded cache afterwards. Decoding maps ids to the bytes of their pieces, joins them, turns
marks into spaces and drops the first.

Defined cases: null and empty texts have no ids and decode to the empty text; a text that holds the white-space mark
itself decodes with a space in its place; undecodable bytes become U+FFFD; null ids keep their row; other columns
are unread.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import CACHE_BYTES, WordCache, model_of_stage, whole_text

MARK = "▁"
#: Arcs of the automaton that a worker keeps.
MAX_ARCS = 1 << 18
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """A compiled model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.bytes_of.append(piece.encode())
        self.longest = max(map(len, self.ids), default=1)
        # the automaton's states are the beginnings of pieces; its arcs and what ends in a state are found when needed
        begins = {""}.union(*({p[:n] for n in range(1, len(p) + 1)} for p in self.ids))
        self.begins = sorted(begins, key=len)
        self.state_of = {b: k for k, b in enumerate(self.begins)}
        self.arcs: list[dict[str, int]] = [{} for _ in self.begins]
        self.n_arcs = 0
        self.ending: list[tuple | None] = [None] * len(self.begins)
        self.piece_of = {i: p for p, i in self.ids.items()}
        self.id_bytes = {i: i.to_bytes(4, "little") for i in self.piece_of}
        self._follows = WordCache(self._may_follow)
        # for each last two characters, the lengths of longer pieces that end so, longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {c: sorted(n, reverse=True) for c, n in ends.items()}
        # words leave room for the pairs of pieces, which every new word needs
        self.parts = WordCache(self._part, CACHE_BYTES // 4)
        self.words = WordCache(self._word, CACHE_BYTES // 2)

    # normaliser ---------------------------------------------------------------------------------

    @staticmethod
    def normalise(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    @cached_property
    def symbols(self) -> tuple[re.Pattern, frozenset[str]]:
        """How words fall into parts that no piece crosses, and the characters that forbid it.

        A run of ASCII symbols is a part of its own, and so is a run of other characters, each with the marks before
        it. ASCII symbols that some piece joins to a letter or digit are none; a word with one of the other symbols
        that pieces join to ASCII ones stays whole.
        """
        near = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if MARK not in (a, b)}
        ascii_symbols = {chr(c) for c in range(128) if not chr(c).isalnum()}
        whole = {c for pair in near for c in pair if ord(c) > 127 and unicodedata.category(c)[0] not in "LM"
                 and unicodedata.category(c) != "Nd"}
        for a, b in near:
            for x, y in ((a, b), (b, a)):
                if x in ascii_symbols and y not in whole and (ord(y) > 127 or y.isalnum()):
                    ascii_symbols.discard(x)
        left = {c for pair in near for c in pair if ord(c) < 128 and not c.isalnum() and c not in ascii_symbols}
        whole |= {c for c in left if any(c in pair and pair[0] in ascii_symbols | {c} and pair[1] in ascii_symbols | {c}
                                         for pair in near)}
        cls = "".join(re.escape(c) for c in sorted(ascii_symbols))
        return re.compile(f"{MARK}*[{cls}]+|{MARK}*[^{MARK}{cls}]+|{MARK}+"), frozenset(whole)

    def _part(self, part: str) -> bytes:
        if self.kind == "bpe" and not part.startswith(MARK * 2):
            known = self.id_bytes
            return b"".join([known[i] if i >= 0 else self._fallback(chr(~i)) for i in self._only_path(part)])
        return np.array(self.part_ids(part), "<i4").tobytes()

    def _fallback(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode("utf-8", "replace")], "<i4").tobytes()

    def _word(self, word: str) -> bytes:
        cut, whole = self.symbols
        chunk = MARK + word
        # a word of one part is kept as the word only
        if whole.isdisjoint(chunk) and len(parts := cut.findall(chunk)) > 1:
            return b"".join(map(self.parts.__getitem__, parts))
        return self._part(chunk)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of marks and the word after it."""
        cut, whole = self.symbols
        parts = cut.findall(chunk) if whole.isdisjoint(chunk) else [chunk]
        return b"".join(map(self.parts.__getitem__, parts))

    # pieces -------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The merge ranks applied to a short string: best-scored adjacent pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _name(self, i: int) -> str:
        """The piece of an id; characters without a piece have the complement of their code as id."""
        return self.piece_of[i] if i >= 0 else chr(~i)

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether an arc of the second piece may follow one of the first."""
        a, b = map(self._name, pair)
        return self.merged(a + b) == [a, b]

    def _arc(self, state: int, char: str) -> int:
        """The state after one more character: the longest beginning of a piece that the text ends with."""
        text = self.begins[state] + char
        while text not in self.state_of:
            text = text[1:]
        to = self.state_of[text]
        if self.n_arcs < MAX_ARCS:
            self.arcs[state][char] = to
            self.n_arcs += 1
        return to

    def _ends_in(self, state: int) -> tuple:
        """``(length, id)`` of the pieces of several characters that end in a state, longest first."""
        text = self.begins[state]
        got = self.ending[state] = tuple((len(p), self.ids[p]) for p in (text[k:] for k in range(len(text) - 1))
                                         if p in self.ids)
        return got

    def path(self, part: str) -> list[str]:
        """Shortest path of one part through the composed graph, as its pieces (single characters fall back)."""
        if self.kind == "bpe":
            # marks in a row tie in rank; the ranks alone decide them
            return self.merged(part) if part.startswith(MARK * 2) else [*map(self._name, self._only_path(part))]
        return self._least_path(part)

    def _only_path(self, part: str) -> list[int]:
        """Ids on the one path, characters without a piece as the complement of their code."""
        arcs, ending, follows, ids = self.arcs, self.ending, self._follows, self.ids
        last: list[int] = [0]
        sizes: list[int] = [0]
        state = 0
        for i, char in enumerate(part, 1):
            to = arcs[state].get(char)
            state = self._arc(state, char) if to is None else to
            pieces = ending[state]
            for size, piece in self._ends_in(state) if pieces is None else pieces:
                if i == size or follows[last[i - size], piece]:
                    last.append(piece)
                    sizes.append(size)
                    break
            else:
                last.append(ids.get(char, ~ord(char)))
                sizes.append(1)
        out = []
        n = len(part)
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def _least_path(self, part: str) -> list[str]:
        n = len(part)
        cost, size_at = [0.0] + [float("inf")] * n, [0] * (n + 1)
        worst = -min(self.score.values(), default=0.0) + 10.0
        for i in range(1, n + 1):
            for size in (*self.ends.get(part[max(0, i - 2):i], ()), 1):
                if size > i:
                    continue
                piece = part[i - size:i]
                if piece in self.score:
                    w = -self.score[piece]
                elif size == 1:
                    w = worst * len(piece.encode("utf-8", "replace"))
                else:
                    continue
                if cost[i - size] + w < cost[i]:
                    cost[i], size_at[i] = cost[i - size] + w, size
        out = []
        while n:
            out.append(part[n - size_at[n]:n])
            n -= size_at[n]
        return out[::-1]

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for piece in self.path(part):
            i = self.ids.get(piece)
            if i is None:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
            else:
                out.append(i)
        return out

    # texts --------------------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return np.frombuffer(b"".join(map(self._chunk, _CHUNK.findall(self.normalise(text)))), "<i4")
        # every word has one mark before it, and no piece crosses from a word to the next mark
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:]


def compiled(path: str, kind: str = "bpe") -> Transducer:
    """The worker's transducer of a model file, for as long as it works on one stage."""
    return model_of_stage(("transducer", path, kind), lambda: Transducer(path, kind))


def encode(docs: DataFrame, model: str | None = None, kind: str = "bpe", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, n_bytes, round_trip, ids`` of every document.

    ``n_bytes`` counts the byte pieces, ``round_trip`` says whether decoding the ids gives the text back.
    """
    model = model or default_model()

    def run(batches):
        fst = compiled(model, kind)
        is_byte = np.zeros(len(fst.bytes_of), bool)
        is_byte[fst.byte_ids] = True
        for batch in batches:
            ids, same, fallback = [], [], []
            for text in batch.column("text").to_pylist():
                got = fst.encode(text)
                ids.append(got)
                fallback.append(int(is_byte[got].sum()))
                same.append(fst.decode(got) == text)
            sizes = np.array([len(x) for x in ids], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(fallback, pa.int64()),
                 pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))],
                ["doc_id", "n_pieces", "n_bytes", "round_trip", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, round_trip boolean, ids array<int>")


def decode(rows: DataFrame, model: str | None = None, kind: str = "bpe", id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded rows (null ids decode to the empty text)."""
    model = model or default_model()

    def run(batches):
        fst = compiled(model, kind)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [
                fst.decode(np.asarray([] if x is None else x, np.int64)) for x in pdf["ids"]]})

    src = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return src.mapInPandas(run, "doc_id long, text string")
