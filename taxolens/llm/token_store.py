"""Token-id files: each document compressed on its own with one shared dictionary.

Texts are encoded with the tokenizers library (a public vocabulary file, its path a parameter) and closed with an end
id. Pieces between white space are independent for such a vocabulary, so a worker encodes each distinct piece once and
joins the ids of a text from its cache; texts with the vocabulary's special strings or odd separators go through the
library whole. Ids are serialised as little-endian unsigned integers (16 bits if the vocabulary fits), a zstandard
dictionary is trained on a bounded sample of serialised documents (``SAMPLE_DOCS`` by hash of the id,
``SAMPLE_BYTES`` of each), and every document is one frame compressed with it.

The files lie below one folder: ``dictionary`` (hash, bytes, id width, end id) and ``blocks``, in ascending id order
within ranges of ids (``shard``): a block holds the frames of up to ``BLOCK_DOCS`` documents back to back, with their
ids, token counts and offsets, the tokens before it in its shard, and the dictionary's hash. A reader checks the hash,
finds a document by the blocks' id range and offsets, and decompresses its frame alone. All files are Parquet written
by Spark, so any store that Spark writes to holds them.

Defined cases: a null text is empty and holds the end id alone; rows with a null id come first; repeated rows are
stored each, rows of one id in the order of their frames' hash; an empty table writes no block; other columns are
unread.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm.common import WordCache, model_of_stage, shared_folder, whole_text
from taxolens.llm.fingerprints import range_buckets

END_ID = 1
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK_DOCS = 512
BLOCK_BYTES = 4_000_000

#: Normalisers of a vocabulary file under which a text may be read word by word.
BY_WORD = ["NFC", "Replace", "Lowercase"]
#: Kinds of bytes: 1 a small letter, 2 a stop or comma, 4 white space.
_KIND = bytes(1 if b in b"abcdefghijklmnopqrstuvwxyz" else 2 if b in b".," else 4 if b in b" \t\n\r\x0b\x0c" else 0
              for b in range(256))
#: Below it letters have had the same normal and lower-case forms in all versions of Unicode.
_SETTLED = "\u0250"
#: White space to this program, but not to the vocabulary's library.
_ODD = "\x1c\x1d\x1e\x1f"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def word_split(spec: dict) -> str | None:
    """The pattern of a vocabulary file's parts, if the file drops white space; None if it does not go by words."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != BY_WORD or steps[1]["pattern"] != {"Regex": r"\s+"} or [
            c["type"] for c in cuts] != ["Split", "ByteLevel"] or not cuts[0]["invert"]:
        return None
    return cuts[0]["pattern"]["Regex"]


def spaced(line: bytes) -> bytes:
    """A blank before each stop or comma between a small letter and white space: it is a part of its own."""
    k = np.frombuffer(line.translate(_KIND), np.uint8)
    out, lo = [], 0
    for hi in (np.flatnonzero((k[:-2] == 1) & (k[1:-1] == 2) & (k[2:] == 4)) + 1).tolist():
        out.append(line[lo:hi])
        lo = hi
    out.append(line[lo:])
    return b" ".join(out)


class Encoder:
    """Serialised ids of texts under one vocabulary file, with bounded caches of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern = word_split(spec)
        self.split = regex.compile(pattern) if pattern else None
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.words = WordCache()
        self.plain = self.bare = self.last = None
        if pattern:
            if suffix := spec["model"].get("end_of_word_suffix"):
                self.last = np.zeros(self.tok.get_vocab_size(), bool)
                self.last[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
            # the same vocabulary for parts that are normalised and cut already, with blanks between them
            to_bytes = spec["pre_tokenizer"]["pretokenizers"][1]
            self.plain = Tokenizer(self.tok.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(" ", "removed"),
                pre_tokenizers.ByteLevel(to_bytes["add_prefix_space"], use_regex=to_bytes.get("use_regex", True))])
            # printable ASCII stands for its own bytes
            self.bare = self.plain
            if not to_bytes["add_prefix_space"] and not to_bytes.get("use_regex", True):
                self.bare = Tokenizer(self.tok.model)
                self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _made(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not kept yet: a call for the parts of all, which the blanks between them keep apart."""
        bare, settled, rest = [], [], []
        for w in words:
            if w.isascii() and w.isprintable():
                bare.append(w)
            else:
                (settled if max(w) < _SETTLED else rest).append(w)
        made = self._ids_of(bare, self.bare)
        for some, tok in ((settled, self.plain), (rest, self.tok)):
            if some:
                made |= self._ids_of(some, tok)
        return made

    def _ids_of(self, words: list[str], tok) -> dict[str, bytes]:
        parts, ends = [], [0]
        for w in words:
            if w.isalpha():
                parts.append(w)
            else:
                parts += self.split.findall(w)
            ends.append(len(parts))
        if not parts:
            return dict.fromkeys(words, b"")
        if self.last is None:
            got = tok.encode(" ".join(parts), add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            stop = np.flatnonzero(np.diff(np.array(got.word_ids, np.int64), append=-1)) + 1
        else:
            # faster, but without the numbers of the parts: those are seen by their last ids
            got = tok.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
            ids = np.array(got.ids, self.dtype)
            stop = np.flatnonzero(self.last[ids]) + 1
        if len(stop) != len(parts):
            return {w: b"".join(map(self._ids, parts[a:b])) for w, a, b in zip(words, ends, ends[1:])}
        data = ids.tobytes()
        cuts = (np.concatenate([[0], stop])[ends] * self.dtype.itemsize).tolist()
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:])}

    def encode(self, text: str) -> bytes:
        if self.split is None or "<|" in text or any(c in text for c in _ODD):
            return self._ids(text)
        # the file's normaliser: NFC, then lower case letter by letter
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = spaced(low.encode("utf-8")).decode("utf-8").split()
        ids = list(map(self.words.get, words))
        gaps, at = [], -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            gaps.append(at)
        if gaps:
            made = self._made(list({words[k] for k in gaps}))
            self.words.add(made)
            for k in gaps:
                ids[k] = made[words[k]]
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, for as long as it works on one stage."""
    return model_of_stage(("encoder", path), lambda: Encoder(path))


def train(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Dictionary bytes from a bounded sample of documents; plain sample content where there is too little to train."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), whole_text(text_col).alias("text"))
    n = docs.count()
    if n > SAMPLE_DOCS:
        src = src.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / n))

    def run(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"ids": [enc.encode(t)[:SAMPLE_BYTES] for t in pdf["text"]]})

    rows = src.mapInPandas(run, "ids binary").limit(2 * SAMPLE_DOCS).collect()
    samples = [bytes(r["ids"]) for r in rows if len(r["ids"]) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[:DICTIONARY_BYTES]


def digest(dictionary: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(dictionary)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the files below ``folder`` in ascending id order."""
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    dictionary = train(docs, vocabulary, id_col, text_col)
    mark = digest(dictionary)
    width = encoder(vocabulary).dtype.itemsize
    (spark.createDataFrame([(mark, bytearray(dictionary), width, end_id)],
                           "hash string, bytes binary, id_bytes int, end_id int")
     .write.mode("overwrite").parquet(f"{folder}/dictionary"))
    sent = spark.sparkContext.broadcast(dictionary)

    def frames(batches):
        enc = encoder(vocabulary)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(sent.value),
                                        write_content_size=True)
        end = np.array([end_id], enc.dtype).tobytes()
        for pdf in batches:
            counts, packed = [], []
            for t in pdf["text"]:
                b = enc.encode(t) + end
                counts.append(len(b) // width)
                packed.append(pack.compress(b))
            yield pd.DataFrame({"shard": pdf["shard"], "doc_id": pdf["doc_id"], "n_tokens": counts, "frame": packed})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    coded = (src.select(range_buckets(src, "doc_id").alias("shard"), "doc_id", "text")
             .mapInPandas(frames, "shard int, doc_id long, n_tokens long, frame binary")
             .repartition("shard").sortWithinPartitions(
                 F.col("shard"), F.col("doc_id").asc_nulls_first(), F.xxhash64("frame")))
    schema = ("shard int, block int, start long, first_id long, last_id long, doc_ids array<long>, "
              "n_tokens array<long>, offsets array<long>, blob binary, dictionary string")
    coded.mapInPandas(lambda it: _blocks(it, mark), schema).write.mode("overwrite").parquet(f"{folder}/blocks")


def _blocks(batches, mark: str) -> Iterator[pd.DataFrame]:
    """Blocks of consecutive documents of a shard; input is sorted by shard and id."""
    shard, block, start = None, 0, 0
    ids: list = []
    counts: list[int] = []
    frames: list[bytes] = []
    size = 0

    def flush():
        known = [i for i in ids if i is not None]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
        return pd.DataFrame({"shard": [shard], "block": [block], "start": [start],
                             "first_id": pd.array([min(known) if known else None], "Int64"),
                             "last_id": pd.array([max(known) if known else None], "Int64"), "doc_ids": [ids],
                             "n_tokens": [counts], "offsets": [offsets], "blob": [b"".join(frames)],
                             "dictionary": [mark]})

    for pdf in batches:
        for s, d, n, f in zip(pdf["shard"].tolist(), pdf["doc_id"].astype("object"), pdf["n_tokens"].tolist(),
                              pdf["frame"]):
            if ids and (s != shard or len(ids) >= BLOCK_DOCS or size + len(f) > BLOCK_BYTES):
                yield flush()
                start, block = (start + sum(counts), block + 1) if s == shard else (0, 0)
                ids, counts, frames, size = [], [], [], 0
            elif s != shard:
                start, block = 0, 0
            shard = s
            ids.append(None if pd.isna(d) else int(d))
            counts.append(n)
            frames.append(bytes(f))
            size += len(f)
    if ids:
        yield flush()


def _dictionary(spark: SparkSession, folder: str):
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row["bytes"])
    if digest(data) != row["hash"]:
        raise ValueError("the dictionary does not have its recorded hash")
    return data, row["hash"], np.dtype("<u2" if row["id_bytes"] == 2 else "<u4")


def _unpack(blob: bytes, offsets, k: int, reader, dtype) -> np.ndarray:
    return np.frombuffer(reader.decompress(blob[offsets[k]:offsets[k + 1]]), dtype)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of a few documents: blocks are pruned by their id range, only the wanted frames are unpacked."""
    data, mark, dtype = _dictionary(spark, folder)
    wanted = sorted(set(doc_ids))
    near = F.exists(F.array(*[F.lit(i).cast("long") for i in wanted]),
                    lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))
    blocks = spark.read.parquet(f"{folder}/blocks").filter(near)
    chosen = set(wanted)

    def run(batches):
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for pdf in batches:
            for ids, offsets, blob, used in zip(pdf["doc_ids"], pdf["offsets"], pdf["blob"], pdf["dictionary"]):
                if used != mark:
                    raise ValueError("a block was written with another dictionary")
                rows = [(int(d), _unpack(blob, offsets, k, reader, dtype).tolist())
                        for k, d in enumerate(ids) if d in chosen]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return blocks.mapInPandas(run, "doc_id long, ids array<int>")


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_bytes`` of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as 32-bit little-endian.
    """
    data, mark, dtype = _dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # a number for each shard: at most as many as the range buckets
    totals = {r["shard"]: r["n"] for r in blocks.select(
        "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        .groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, at = {}, 0
    for s in sorted(totals):
        before[s] = at
        at += totals[s]

    def run(batches):
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for pdf in batches:
            for s, start, ids, counts, offsets, blob, used in zip(*(pdf[c] for c in (
                    "shard", "start", "doc_ids", "n_tokens", "offsets", "blob", "dictionary"))):
                if used != mark:
                    raise ValueError("a block was written with another dictionary")
                got = [_unpack(blob, offsets, k, reader, dtype) for k in range(len(counts))]
                n = np.array([len(x) for x in got], np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if d is None or d != d else int(d) for d in ids], "Int64"),
                    "start": before[s] + start + np.cumsum(n) - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in got],
                    "n_bytes": np.diff(np.array(offsets, np.int64))})

    return blocks.select("shard", "start", "doc_ids", "n_tokens", "offsets", "blob", "dictionary").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to a new folder below the shared one and read the digest back."""
    folder = shared_folder(docs.sparkSession, "token-ids")
    write(docs, folder, vocabulary)
    return read_digest(docs.sparkSession, folder)
