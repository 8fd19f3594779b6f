"""Sources, text projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.functions import text as T
from taxolens.operators.features import create_text_features, rejection_rate
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.sources.sampling import sample_exact
from taxolens.sources.tables import read_table
from taxolens.schema import TEXT_COLS


@register("clean_html", f"SELECT page_id, {S.clean_html('html')} AS text FROM pages")
def q_clean_html(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.clean_html("html").alias("text"))


@register("decode_entities", f"SELECT page_id, {S.decode_entities('html')} AS html FROM pages")
def q_decode_entities(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.decode_entities("html").alias("html"))


@register("normalize_ws", f"SELECT doc_id, {S.normalize_ws('text')} AS text FROM documents")
def q_normalize_ws(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.normalize_ws("text").alias("text"))


@register("impute_text", S.with_(S.PRODUCTS, body=f"SELECT row_id, {S.impute(TEXT_COLS)} AS cluster_text FROM products"))
def q_impute_text(spark, sf):
    return FX.products(spark, sf).select("row_id", T.impute_text(TEXT_COLS).alias("cluster_text"))


_CLEANED = "cleaned AS (SELECT row_id, " + ", ".join(
    f"{S.clean_html(c)} AS {c}" for c in TEXT_COLS) + ", true_label FROM products)"


@register("text_features", S.with_(S.PRODUCTS, _CLEANED, body=f"""
SELECT * FROM (SELECT *, {S.normalize_ws(S.impute(TEXT_COLS))} AS cluster_text FROM cleaned)
WHERE length(cluster_text) > 2"""))
def q_text_features(spark, sf):
    return create_text_features(FX.products(spark, sf))


@register("rejection_rate", S.with_(S.PRODUCTS, _CLEANED, body=f"""
SELECT CAST(count(*) FILTER (WHERE length(t) > 2) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE length(t) <= 2) AS BIGINT) AS dropped,
       count(*) FILTER (WHERE length(t) <= 2) / count(*) AS drop_ratio
FROM (SELECT {S.normalize_ws(S.impute(TEXT_COLS))} AS t FROM cleaned)"""))
def q_rejection_rate(spark, sf):
    return rejection_rate(FX.products(spark, sf))


@register("display_name", """
SELECT conv_id, turn, CASE WHEN length(text) > 25 THEN substr(text, 1, 22) || '...' ELSE text END AS name
FROM conversations""")
def q_display_name(spark, sf):
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", T.display_name("text").alias("name"))


@register("sample_exact", """
SELECT doc_id, lang, source FROM documents
ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def q_sample_exact(spark, sf):
    return sample_exact(read_table(spark, sf, "documents").select("doc_id", "lang", "source"),
                        100, key="doc_id", seed=42)


@register("embed_cache_missing", """
SELECT d.doc_id, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_embed_cache_missing(spark, sf):
    from taxolens.sources.cache import rows_missing_from_cache
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    cached = read_table(spark, sf, "labels").select("doc_id")
    return rows_missing_from_cache(docs, cached, key="doc_id")


@register("source_shape", S.with_(S.PRODUCTS, body="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, 7 AS n_cols FROM products"""))
def q_source_shape(spark, sf):
    from taxolens.sources.json_source import source_shape
    return source_shape(FX.products(spark, sf))


@register("preview", S.with_(S.PRODUCTS, _CLEANED, body=f"""
SELECT row_id, true_label, substr(cluster_text, 1, 200) AS text FROM
 (SELECT *, {S.normalize_ws(S.impute(TEXT_COLS))} AS cluster_text FROM cleaned)
WHERE length(cluster_text) > 2 ORDER BY row_id LIMIT 3"""))
def q_preview(spark, sf):
    f = create_text_features(FX.products(spark, sf))
    return (f.orderBy("row_id").limit(3)
            .select("row_id", "true_label", F.substring("cluster_text", 1, 200).alias("text")))
