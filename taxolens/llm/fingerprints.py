"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

The shingles of a text are its runs of five words (lower-cased runs of letters and digits; a shorter text is one
shingle, a text without words has none). The sketch is the sorted array of the ``K`` least distinct 64-bit shingle
hashes. Two sketches of parts merge into the sketch of the whole, and a pair estimates resemblance, containment and
distinct shingle counts; sketches with fewer than ``K`` values are exact.

Defined cases: a null text is empty; two empty sketches have resemblance 1, an empty and a full one 0; equal texts
have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE = 5
#: Range buckets of :func:`with_next`: rows per bucket aimed at, and the most split points sent with a plan.
BUCKET_ROWS = 4096
MAX_BUCKETS = 4096


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """All runs of ``n`` words of a text, as strings, in order."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    run = rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{n - 1}}}|^[^ ]++(?: [^ ]++){{0,{n - 2}}}$))"
    return F.regexp_extract_all(words, F.lit(run), F.lit(1))


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text: sorted array of at most ``k`` distinct hashes."""
    hashes = F.transform(shingles(F.coalesce(text, F.lit("")), n), lambda s: F.xxhash64(s))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketched sets (0 to 1)."""
    low = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), low))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(shared / F.size(low))


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) / the k-th hash as a fraction."""
    part = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds (0 to 1); 1 for an empty a."""
    j, x, y = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (x + y) / ((1 + j) * x)))


def as_text(s: Column) -> Column:
    """A sketch as a string of comma-joined numbers."""
    return F.array_join(s.cast("array<string>"), ",")


def merge_groups(parts: DataFrame, key: str, col: str = "sketch", k: int = K) -> DataFrame:
    """Merged sketch of each group of part sketches: ``(key, sketch)``.

    Hashes are made distinct and ranked; Spark keeps the ``k`` first of a group in every task before it shuffles, so
    a group of any size sends at most ``k`` values a task. Groups without a hash get an empty sketch.
    """
    one = parts.select(key, F.explode(col).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    low = one.withColumn("r", rank).filter(F.col("r") <= k).groupBy(key).agg(
        F.sort_array(F.collect_list("h")).alias("merged"))
    groups = parts.select(F.col(key).alias("_k")).distinct()
    return (groups.join(low, groups["_k"].eqNullSafe(low[key]), "left")
            .select(F.col("_k").alias(key),
                    F.coalesce("merged", F.array().cast("array<bigint>")).alias(col)))


def _bucket(value: Column, splits: list[int]) -> Column:
    """Number of split points at or below a value, by binary search in an array of literals."""
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(s).cast("long") for s in splits])
    steps = [1 << e for e in reversed(range(len(splits).bit_length()))]

    def step(low: Column, s: Column) -> Column:
        ok = (low + s <= len(splits)) & (F.element_at(points, F.least(low + s, F.lit(len(splits)))) <= value)
        return F.when(ok, low + s).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def id_splits(ids: DataFrame, id_col: str) -> list[int]:
    """At most ``MAX_BUCKETS - 1`` split points of an id column at approximate quantiles."""
    n = ids.count()
    many = min(MAX_BUCKETS, max(64, n // BUCKET_ROWS))
    cuts = ids.agg(F.percentile_approx(id_col, [i / many for i in range(1, many)], 20_000).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def range_buckets(rows: DataFrame, id_col: str) -> Column:
    """Number of the id range of a row, ascending with the id; null ids are in the first."""
    return F.coalesce(_bucket(F.col(id_col), id_splits(rows.select(id_col), id_col)), F.lit(0)).cast("int")


def with_next(docs: DataFrame, text_col: str, id_col: str = "doc_id") -> tuple[DataFrame, Window, DataFrame]:
    """Rows dealt by ranges of ids so that a window sees each row's next one by ascending id, the first after the last.

    Returns the rows ``(doc_id, text, _b, _copy)``, the window to look ahead in (it needs a column ``_tie`` that
    orders rows of one id), and the rows with a null id, which have no next row. Ranges are split at approximate
    quantiles (at most ``MAX_BUCKETS`` numbers go with the plan); a copy of the first row of the next range closes
    each, so no order over all rows is needed. Drop the copies after looking ahead.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = src.filter("doc_id is not null")
    splits = id_splits(named.select("doc_id"), "doc_id")
    bucket = _bucket(F.col("doc_id"), splits).cast("int")
    firsts = {r["b"]: r["m"] for r in named.select(bucket.alias("b"), "doc_id")
              .groupBy("b").agg(F.min("doc_id").alias("m")).collect()}
    used = sorted(firsts)
    closes = {firsts[used[(i + 1) % len(used)]]: b for i, b in enumerate(used)}
    rows = named.withColumn("_b", bucket).withColumn("_copy", F.lit(False))
    if closes:
        owner = F.create_map(*[F.lit(x) for m, b in sorted(closes.items()) for x in (m, b)])
        copies = (named.filter(F.col("doc_id").isin(sorted(closes)))
                  .withColumn("_b", owner[F.col("doc_id")].cast("int")).withColumn("_copy", F.lit(True)))
        rows = rows.unionByName(copies)
    window = Window.partitionBy("_b").orderBy("_copy", "doc_id", "_tie")
    return rows.repartition("_b"), window, src.filter("doc_id is null")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every document, its edited text and its next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct,
    contained``. The edited text has the last floor(n / 4) code points replaced by the first as many (or all) of
    the next document by ascending id, the first after the last; a row with a null id has an empty next document.
    ``distinct`` estimates the distinct shingles and ``contained`` the share of them that the edited text holds.
    """
    rows, window, unnamed = with_next(docs, text_col, id_col)
    sketched = rows.select("doc_id", "_b", "_copy", "text", sketch(F.col("text"), k).alias("sk"),
                           F.xxhash64("text").alias("_tie"))
    ahead = F.lead(F.struct("text", "sk")).over(window)
    paired = (sketched.withColumn("_next", ahead).filter(~F.col("_copy"))
              .select("doc_id", "text", "sk", F.col("_next.text").alias("next_text"), F.col("_next.sk").alias("next_sk")))
    alone = unnamed.select("doc_id", "text", sketch(F.col("text"), k).alias("sk"), F.lit("").alias("next_text"),
                           F.array().cast("array<bigint>").alias("next_sk"))
    both = paired.unionByName(alone)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = (both.withColumn("n_chars", F.length("text").cast("long"))
              .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")),
                                             F.substring("next_text", F.lit(1), cut)))
              .withColumn("edited_sk", sketch(F.col("edited"), k)))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("distinct"),
        containment(F.col("sk"), F.col("edited_sk"), k).alias("contained"))
