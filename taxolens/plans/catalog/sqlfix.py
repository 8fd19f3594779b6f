"""DuckDB twins of ``taxolens.plans.fixtures`` as CTE fragments."""

from __future__ import annotations

from html.entities import name2codepoint

# Python/Java-compatible Unicode whitespace for RE2 (whose \s is ASCII only).
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normalize_ws(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'))"


def decode_entities(expr: str) -> str:
    names = ", ".join(f"'{k}': {v}" for k, v in (sorted(name2codepoint.items()) + [("apos", 39)]))
    name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);', 1)"
    code = (f"CASE WHEN {name}[1:2] IN ('#x', '#X') THEN CAST('0x' || {name}[3:] AS INTEGER) "
            f"WHEN {name}[1:1] = '#' THEN CAST({name}[2:] AS INTEGER) ELSE MAP {{{names}}}[{name}] END")
    return (f"(string_split({expr}, '&')[1] || array_to_string(list_transform(string_split({expr}, '&')[2:], "
            f"lambda p: CASE WHEN {code} > 0 THEN chr({code}) || p[length({name}) + 2:] ELSE '&' || p END), ''))")


def strip_markup(expr: str) -> str:
    out = expr
    for pat in [r"(?is)<!--.*?(?:-->|\z)", r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
                r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", r"(?is)<template\b[^>]*>.*?(?:</template\s*>|\z)",
                r"""(?is)<[a-zA-Z/!?][^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>""", r"(?is)<[a-zA-Z/!?][^>]*>"]:
        out = f"regexp_replace({out}, '{pat}', ' ', 'g')"
    return out


def clean_html(expr: str) -> str:
    return f"coalesce({normalize_ws(decode_entities(strip_markup(expr)))}, '')"


def impute(cols: list[str]) -> str:
    def strip(c: str) -> str:
        return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"

    parts = ", ".join(f"CASE WHEN length({strip(c)}) > 2 THEN {strip(c)} END" for c in cols)
    return f"coalesce({parts}, '')"


SRC_NUM = "CASE WHEN source = 'src0' THEN -1 ELSE CAST(substr(source, 4) AS INTEGER) END"

LAB_DOC = f"""lab_doc AS (
  SELECT doc_id AS row_id, {SRC_NUM} AS cluster, lang AS true_label, text, source, n_chars
  FROM documents)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS row_id,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS Title,
    CASE WHEN p_partkey % 5 = 0 THEN ' a ' ELSE concat_ws(' ', p_name, p_type) END AS ProductName,
    CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE p_brand END AS Brand,
    CASE WHEN p_partkey % 385 = 0 THEN NULL ELSE
      '<div class="d"><p>' || p_name || ' &amp; size ' || CAST(p_size AS VARCHAR)
      || '</p><!-- c --><script>x()</script>' || chr(10) || '<b>ok</b></div>' END AS Description,
    CAST(NULL AS VARCHAR) AS LongDesc,
    p_type AS true_label
  FROM part)"""

PROD_LAB = PRODUCTS + """,
prod_lab AS (
  SELECT p.*, CASE WHEN CAST(substr(pt.p_brand, 7) AS INTEGER) = 25 THEN -1
                   ELSE CAST(substr(pt.p_brand, 7) AS INTEGER) END AS cluster
  FROM products p JOIN part pt ON p.row_id = pt.p_partkey)"""

LABELINGS = f"""labelings AS (
  SELECT 'src' AS algo, 0 AS algo_ord, doc_id AS row_id, {SRC_NUM} AS cluster FROM documents
  UNION ALL
  SELECT 'mod', 1, doc_id, CASE WHEN doc_id % 10 = 9 THEN -1 ELSE CAST(doc_id % 10 AS INTEGER) END
  FROM documents
  UNION ALL
  SELECT 'dec', 2, doc_id, CASE WHEN n_chars < 200 THEN -1
                                ELSE CAST(least(n_chars // 1000, 9) AS INTEGER) END
  FROM documents)"""

VECTORS = """vectors AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features,
         CAST(label AS VARCHAR) AS true_label
  FROM embeddings)"""


def with_(*ctes: str, body: str) -> str:
    """Compose ``WITH cte1, cte2 ... body``."""
    return "WITH " + ",\n".join(ctes) + "\n" + body

VEC_DOC = """vec_doc AS (
  SELECT e.vec_id AS row_id, CAST(e.embedding AS DOUBLE[]) AS features, e.label AS cluster,
         d.lang AS true_label, d.text
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""

VEC_LAB = """vec_lab AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, label AS cluster FROM embeddings)"""


def centroid_ctes(src: str, prefix: str = "") -> str:
    """``{prefix}elems``, ``{prefix}cent(cluster, size, centroid)`` over a labeled vector CTE."""
    p = prefix
    return f"""{p}elems AS (
  SELECT row_id, cluster, unnest(features) AS v, unnest(range(len(features))) AS pos FROM {src}),
{p}cent AS (
  SELECT cluster, max(sz) AS size, list(value ORDER BY pos) AS centroid FROM (
    SELECT cluster, pos, avg(v) AS value, count(*) AS sz FROM {p}elems GROUP BY 1, 2) GROUP BY 1)"""


def lloyd_sql(src: str, k: int, iterations: int) -> str:
    """CTEs computing ``lloyd_final(row_id, cluster, dist)`` with the Spark rules."""
    parts = [f"""ll_c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cid, features AS ctr
  FROM (SELECT * FROM {src} ORDER BY row_id LIMIT {k}))""",
             f"""ll_el AS (SELECT row_id, unnest(features) AS v, unnest(range(len(features))) AS pos FROM {src})"""]

    def assign(i):
        return f"""ll_a{i} AS (
  SELECT row_id, cid AS cluster, dist FROM (
    SELECT v.row_id, c.cid, list_distance(v.features, c.ctr) AS dist,
           row_number() OVER (PARTITION BY v.row_id ORDER BY list_distance(v.features, c.ctr), c.cid) AS rk
    FROM {src} v CROSS JOIN ll_c{i} c) WHERE rk = 1)"""

    for i in range(iterations):
        parts.append(assign(i))
        parts.append(f"""ll_c{i + 1} AS (
  SELECT c.cid, coalesce(u.ctr, c.ctr) AS ctr FROM ll_c{i} c LEFT JOIN (
    SELECT cluster AS cid, list(m ORDER BY pos) AS ctr FROM (
      SELECT a.cluster, e.pos, avg(e.v) AS m FROM ll_a{i} a JOIN ll_el e USING (row_id) GROUP BY 1, 2)
    GROUP BY 1) u USING (cid))""")
    parts.append(assign(iterations))
    parts.append(f"lloyd_final AS (SELECT * FROM ll_a{iterations})")
    return ",\n".join(parts)

FLOW_SRC = """flow_src AS (
  SELECT doc_id AS row_id, source AS true_label,
         CASE WHEN doc_id % 10 = 9 THEN -1 ELSE CAST(doc_id % 10 AS INTEGER) END AS cluster
  FROM documents)"""


def sankey_ctes(src: str, top_n: int = 15, part: str | None = None) -> str:
    """``sub``, ``tix``, ``cix``, ``flows(source, target, value, true_label, cluster[, part])``."""
    pk = f"{part}, " if part else ""
    pby = f"PARTITION BY {part} " if part else ""
    on_part = f" AND c.{part} = t.{part}" if part else ""
    return f"""top AS (SELECT true_label FROM {src} WHERE true_label IS NOT NULL GROUP BY 1
              ORDER BY count(*) DESC, true_label LIMIT {top_n}),
sub AS (SELECT * FROM {src} WHERE true_label IN (SELECT true_label FROM top)),
tix AS (SELECT {pk}true_label, CAST(dense_rank() OVER ({pby}ORDER BY true_label) - 1 AS BIGINT) AS idx
        FROM (SELECT DISTINCT {pk}true_label FROM sub)),
ntix AS (SELECT {pk}count(*) AS nt FROM tix {"GROUP BY " + part if part else ""}),
cix AS (SELECT {pk}cluster, CAST(dense_rank() OVER ({pby}ORDER BY cluster) - 1 AS BIGINT) AS ci
        FROM (SELECT DISTINCT {pk}cluster FROM sub)),
flows AS (
  SELECT {("f." + part + ", ") if part else ""}t.idx AS source, c.ci + n.nt AS target, f.value, f.true_label, f.cluster
  FROM (SELECT {pk}true_label, cluster, count(*) AS value FROM sub GROUP BY ALL) f
  JOIN tix t ON t.true_label = f.true_label{(" AND t." + part + " = f." + part) if part else ""}
  JOIN cix c ON c.cluster = f.cluster{(" AND c." + part + " = f." + part) if part else ""}
  {"JOIN ntix n ON n." + part + " = f." + part if part else "CROSS JOIN ntix n"})"""


def composition_ctes(items: str) -> str:
    """``comp(cluster_id, rank, name, count, percentage, total_size, purity, dominant_category)``."""
    return f"""citems AS ({items}),
cr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, name) AS rank,
              sum(count) OVER (PARTITION BY cluster_id) AS total_size FROM citems),
comp AS (
  SELECT c.cluster_id, CAST(c.rank AS BIGINT) AS rank, c.name, c.count,
         CAST(round_even(CAST(c.count * 100.0 / c.total_size AS DECIMAL(18, 9)), 1) AS DOUBLE) AS percentage,
         CAST(c.total_size AS BIGINT) AS total_size, d.count / c.total_size AS purity, d.name AS dominant_category
  FROM cr c JOIN cr d ON d.cluster_id = c.cluster_id AND d.rank = 1)"""

VD_LAB = VEC_DOC + f""",
vd_lab AS (
  SELECT 'label' AS algo, 0 AS algo_ord, v.row_id, v.features, v.true_label, CAST(v.cluster AS INTEGER) AS cluster
  FROM vec_doc v
  UNION ALL
  SELECT 'src', 1, v.row_id, v.features, v.true_label,
         CASE WHEN d.source = 'src0' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END
  FROM vec_doc v JOIN documents d ON d.doc_id = v.row_id
  UNION ALL
  SELECT 'mod', 2, v.row_id, v.features, v.true_label,
         CASE WHEN v.row_id % 10 = 9 THEN -1 ELSE CAST(v.row_id % 10 AS INTEGER) END
  FROM vec_doc v)"""
