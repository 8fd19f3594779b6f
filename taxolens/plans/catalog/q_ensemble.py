"""Ensembles (E1-E6) and sample alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.operators import ensemble as EN
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import rounded
from taxolens.sources.sampling import restrict_to, sample_ids

_VOTE = """votes AS (SELECT row_id, cluster, count(*) AS n, min(algo_ord) AS o FROM labelings
                WHERE cluster <> -1 GROUP BY 1, 2),
best AS (SELECT row_id, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, o) AS rk FROM votes) WHERE rk = 1),
vote AS (SELECT r.row_id, CAST(coalesce(b.cluster, -1) AS INTEGER) AS cluster
         FROM (SELECT DISTINCT row_id FROM labelings) r LEFT JOIN best b USING (row_id))"""


@register("majority_vote", S.with_(S.LABELINGS, _VOTE, body="SELECT row_id, cluster FROM vote"))
def q_majority_vote(spark, sf):
    return EN.majority_vote(FX.labelings(spark, sf))


@register("consensus_mod_assign", S.with_(S.LABELINGS, _VOTE, body="""
SELECT row_id, CAST(CASE WHEN cluster = -1 THEN -1 ELSE cluster % 4 END AS INTEGER) AS cluster FROM vote"""))
def q_consensus_mod_assign(spark, sf):
    return EN.consensus_mod_assign(FX.labelings(spark, sf), 4)


@register("overlap_matrix", S.with_(S.LABELINGS, body="""
SELECT o.algo, r.cluster AS ref_cluster, o.cluster, count(*) AS n
FROM labelings o JOIN labelings r ON r.row_id = o.row_id AND r.algo_ord = 0
WHERE o.algo_ord <> 0 AND o.cluster <> -1 AND r.cluster <> -1 GROUP BY 1, 2, 3"""))
def q_overlap_matrix(spark, sf):
    return EN.overlap_matrix(FX.labelings(spark, sf))


@register("align_labels")
def q_align_labels(spark, sf):
    return EN.align_labels(FX.labelings(spark, sf))


@register("voting_ensemble")
def q_voting_ensemble(spark, sf):
    return EN.voting_ensemble(FX.labelings(spark, sf))


@register("coassociation", S.with_(S.LABELINGS, """sizes AS (
  SELECT algo, cluster, count(*) AS sz FROM labelings WHERE cluster <> -1 GROUP BY 1, 2)""", """per_row AS (
  SELECT l.row_id, sum(coalesce(s.sz - 1, 0)) AS co,
         string_agg(CAST(l.cluster AS VARCHAR), '|' ORDER BY l.algo_ord) AS tuple_key
  FROM labelings l LEFT JOIN sizes s USING (algo, cluster) GROUP BY 1)""", body="""
SELECT tuple_key, count(*) AS weight,
       round(max(co) / ((SELECT count(DISTINCT algo) FROM labelings) * ((SELECT count(DISTINCT row_id) FROM labelings) - 1)), 6)
         AS mean_coassociation
FROM per_row GROUP BY 1"""))
def q_coassociation(spark, sf):
    return rounded(EN.coassociation_summary(FX.labelings(spark, sf)))


@register("consensus", S.with_(S.LABELINGS, body="""
SELECT row_id, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (
  WITH RECURSIVE wide AS (
    SELECT row_id, max(cluster) FILTER (WHERE algo_ord = 0) AS a, max(cluster) FILTER (WHERE algo_ord = 1) AS b,
           max(cluster) FILTER (WHERE algo_ord = 2) AS c FROM labelings GROUP BY 1),
  keys AS (
    SELECT row_id, 'ab' || a || ':' || b AS k FROM wide WHERE a <> -1 AND b <> -1
    UNION ALL SELECT row_id, 'ac' || a || ':' || c FROM wide WHERE a <> -1 AND c <> -1
    UNION ALL SELECT row_id, 'bc' || b || ':' || c FROM wide WHERE b <> -1 AND c <> -1),
  edges AS (SELECT DISTINCT x.row_id AS s, y.row_id AS t FROM keys x JOIN keys y USING (k)),
  reach(s, t) AS (
    SELECT row_id, row_id FROM wide UNION SELECT r.s, e.t FROM reach r JOIN edges e ON e.s = r.t)
  SELECT s AS row_id, min(t) AS comp FROM reach GROUP BY 1)"""))
def q_consensus(spark, sf):
    return EN.consensus(FX.labelings(spark, sf))


@register("sample_labelings", S.with_(S.LABELINGS, """ids AS (
  SELECT DISTINCT row_id FROM labelings ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id LIMIT 100)""", body="""
SELECT algo, algo_ord, row_id, cluster FROM labelings WHERE row_id IN (SELECT row_id FROM ids)"""))
def q_sample_labelings(spark, sf):
    lab = FX.labelings(spark, sf)
    ids = sample_ids(lab.select("row_id").distinct(), 100)
    return restrict_to(lab, ids).select("algo", "algo_ord", "row_id", "cluster")
