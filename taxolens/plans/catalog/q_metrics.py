"""Contingency and external metrics."""

from __future__ import annotations

from taxolens.operators import metrics as M
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import metrics_select, rounded

CONT = "cont AS (SELECT true_label, cluster, count(*) AS n FROM lab_doc WHERE true_label IS NOT NULL GROUP BY 1, 2)"


@register("contingency", S.with_(S.LAB_DOC, body="""
SELECT true_label, cluster, count(*) AS n FROM lab_doc WHERE true_label IS NOT NULL GROUP BY 1, 2"""))
def q_contingency(spark, sf):
    return M.contingency(FX.lab_doc(spark, sf))


@register("crosstab_wide", S.with_(S.LAB_DOC, body="""
SELECT cluster, count(*) FILTER (WHERE true_label = 'de') AS de, count(*) FILTER (WHERE true_label = 'en') AS en,
       count(*) FILTER (WHERE true_label = 'es') AS es, count(*) FILTER (WHERE true_label = 'fr') AS fr
FROM lab_doc WHERE true_label IS NOT NULL GROUP BY cluster"""))
def q_crosstab_wide(spark, sf):
    return M.crosstab_wide(FX.lab_doc(spark, sf))


def _one_metric(name):
    @register(name, S.with_(S.LAB_DOC, CONT, body=metrics_select([name])))
    def q(spark, sf):
        return rounded(M.external_metrics(M.contingency(FX.lab_doc(spark, sf)), [name]))
    return q


for _m in M.EXTERNAL:
    _one_metric(_m)


@register("noise_summary", S.with_(S.LAB_DOC, body="""
SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
       round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio,
       count(*) AS n_rows FROM lab_doc"""))
def q_noise_summary(spark, sf):
    return rounded(M.noise_summary(FX.lab_doc(spark, sf)))


_CONT_NN = ("cont AS (SELECT true_label, cluster, count(*) AS n FROM lab_doc "
            "WHERE true_label IS NOT NULL AND cluster <> -1 GROUP BY 1, 2)")


@register("experiment_row", S.with_(S.LAB_DOC, _CONT_NN, body=f"""
SELECT b.num_L3, b.num_clusters, round(b.noise_ratio, 6) AS noise_ratio,
       round(1.0 - b.noise_ratio, 6) AS coverage, round(e.purity * 100.0, 6) AS accuracy_pct,
       round(e.purity, 6) AS purity,
       round((SELECT avg(k) FROM (SELECT count(*) AS k FROM cont GROUP BY cluster)), 6) AS avg_L3_per_cluster,
       round(e.ari, 6) AS ARI, round(e.nmi, 6) AS NMI
FROM (SELECT count(DISTINCT true_label) AS num_L3,
             count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS num_clusters,
             avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) AS noise_ratio FROM lab_doc) b,
     ({metrics_select(['purity', 'ari', 'nmi'], digits=15)}) e"""))
def q_experiment_row(spark, sf):
    return rounded(M.experiment_row(FX.lab_doc(spark, sf)))
