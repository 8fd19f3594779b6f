"""Clustering algorithms (C1-C8) and neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.operators.clustering.dbscan import dbscan, neighbor_counts
from taxolens.operators.metrics import join_single_rows
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.sources.tables import read_table

EPS, MIN_SAMPLES = 1.14, 3

_NB = f"""nbr AS (
  SELECT a.row_id AS a, b.row_id AS b FROM vectors a JOIN vectors b
    ON list_distance(a.features, b.features) <= {EPS})"""


@register("eps_join", S.with_(S.VECTORS, _NB, body="SELECT a AS row_id, count(*) AS n_neighbors FROM nbr GROUP BY 1"))
def q_eps_join(spark, sf):
    return neighbor_counts(FX.vectors(spark, sf).select("row_id", "features"), EPS)


_CUSTOMERS = """vectors AS (
  SELECT c_custkey AS row_id, [c_acctbal::DOUBLE / 100.0, c_nationkey * 20.0] AS features FROM customer)"""
_CUSTOMER_NB = """nbr AS (
  SELECT a.row_id AS a, b.row_id AS b FROM vectors a JOIN vectors b ON a.features[2] = b.features[2]
    AND list_distance(a.features, b.features) <= 1.5)"""


def _dbscan_sql(vectors: str, nbr: str, min_samples: int) -> str:
    return "WITH RECURSIVE " + ",\n".join([
    vectors, nbr,
    f"core AS (SELECT a AS row_id FROM nbr GROUP BY a HAVING count(*) >= {min_samples})",
    "ce AS (SELECT a, b FROM nbr WHERE a IN (SELECT row_id FROM core) AND b IN (SELECT row_id FROM core))",
    """reach(node, comp) AS (
  SELECT row_id, row_id FROM core
  UNION
  SELECT ce.b, reach.comp FROM reach JOIN ce ON ce.a = reach.node)""",
    "comps AS (SELECT node, min(comp) AS comp FROM reach GROUP BY 1)",
    "num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comps))",
    "corelab AS (SELECT c.node AS row_id, n.cluster FROM comps c JOIN num n USING (comp))",
    """border AS (
  SELECT nbr.a AS row_id, min(cl.cluster) AS bcl FROM nbr JOIN corelab cl ON cl.row_id = nbr.b
  WHERE nbr.a NOT IN (SELECT row_id FROM core) GROUP BY 1)"""]) + """
SELECT v.row_id, CAST(coalesce(cl.cluster, b.bcl, -1) AS INTEGER) AS cluster
FROM vectors v LEFT JOIN corelab cl USING (row_id) LEFT JOIN border b USING (row_id)"""


@register("dbscan_cells", _dbscan_sql(_CUSTOMERS, _CUSTOMER_NB, 4))
def q_dbscan_cells(spark, sf):
    """C4 in the plane, where pivot cells prune: customers by balance and nation."""
    points = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.array(F.col("c_acctbal").cast("double") / 100.0,
                                                    F.col("c_nationkey") * 20.0).alias("features"))
    return dbscan(points, 1.5, 4, block_rows=256)


@register("dbscan", _dbscan_sql(S.VECTORS, _NB, MIN_SAMPLES))
def q_dbscan(spark, sf):
    return dbscan(FX.vectors(spark, sf).select("row_id", "features"), EPS, MIN_SAMPLES)


@register("birch_cf")
def q_birch_cf(spark, sf):
    from taxolens.operators.clustering.birch import cf_build, cf_radius
    return cf_radius(cf_build(FX.vectors(spark, sf), 0.75))


@register("birch_cf_totals", S.with_(S.VECTORS, """flat AS (
  SELECT row_id, pos, features[pos] AS x FROM vectors,
         (SELECT unnest(range(1, 1 + (SELECT max(len(features)) FROM vectors))) AS pos))""", body="""
SELECT (pos - 1)::INTEGER AS pos, count(*)::DOUBLE AS n, round(sum(x), 6) AS ls,
       round((SELECT sum(x * x) FROM flat), 4) AS ss, 0::BIGINT AS n_wide, TRUE AS summarised FROM flat GROUP BY pos"""))
def q_birch_cf_totals(spark, sf):
    """What the CFs together hold: as many rows, the same sums, no radius above the threshold, fewer CFs than rows."""
    from taxolens.operators.clustering.birch import cf_build, cf_radius
    v = FX.vectors(spark, sf)
    cfs = cf_build(v, 0.75)
    wide = cf_radius(cfs).agg(F.sum(F.when(F.col("radius") > 0.75 + 1e-9, 1).otherwise(0)).cast("long").alias("n_wide"))
    total = cfs.agg(F.sum("n").alias("n"), F.round(F.sum("ss"), 4).alias("ss"),
                    (F.count(F.lit(1)) < F.sum("n")).alias("summarised"))
    sums = cfs.select(F.posexplode("ls").alias("pos", "x")).groupBy("pos").agg(F.round(F.sum("x"), 6).alias("ls"))
    return join_single_rows(join_single_rows(sums, total), wide)


@register("birch")
def q_birch(spark, sf):
    from taxolens.operators.clustering.birch import birch
    return birch(FX.vectors(spark, sf), threshold=0.75, n_clusters=None)


@register("birch_global")
def q_birch_global(spark, sf):
    from taxolens.operators.clustering.birch import birch
    return birch(FX.vectors(spark, sf), threshold=0.75, n_clusters=10)


@register("ward_micro")
def q_ward_micro(spark, sf):
    from taxolens.operators.clustering.ward import ward_micro
    return ward_micro(FX.vectors(spark, sf), n_clusters=10, micro_clusters=50)


_WARD_K = 7


_QUARTERS = """cells AS (
  SELECT CAST(true_label AS BIGINT) * 4 + row_id % 4 AS id, pos, count(*)::DOUBLE AS n, avg(features[pos]) AS v
  FROM vectors, (SELECT unnest(range(1, 1 + (SELECT max(len(features)) FROM vectors))) AS pos) GROUP BY 1, 2),
summaries AS (SELECT id, any_value(n) AS n, list(v ORDER BY pos) AS mean FROM cells GROUP BY 1)"""

_WARD_SQL = "WITH RECURSIVE " + ",\n".join([S.VECTORS, _QUARTERS, f"""merging AS (
  SELECT list({{'id': id, 'n': n, 'mean': mean, 'own': [id]}} ORDER BY id) AS cl FROM summaries
  UNION ALL
  SELECT list_filter(cl, lambda c: c.id NOT IN (a.id, b.id))
         || [{{'id': a.id, 'n': a.n + b.n, 'own': a.own || b.own,
               'mean': list_transform(list_zip(a.mean, b.mean), lambda z: (a.n * z[1] + b.n * z[2]) / (a.n + b.n))}}]
  FROM (SELECT cl, list_filter(cl, lambda c: c.id = best.a)[1] AS a, list_filter(cl, lambda c: c.id = best.b)[1] AS b
        FROM (SELECT cl, list_min(flatten(list_transform(cl, lambda x: list_transform(
                list_filter(cl, lambda y: y.id > x.id), lambda y:
                {{'cost': x.n * y.n / (x.n + y.n) * list_distance(x.mean, y.mean) ** 2, 'a': x.id, 'b': y.id}})))) AS best
              FROM merging WHERE len(cl) > {_WARD_K}))),
cut AS (SELECT unnest(cl) AS c FROM merging WHERE len(cl) = {_WARD_K})"""]) + """
SELECT unnest(c.own)::BIGINT AS id, (dense_rank() OVER (ORDER BY c.id) - 1)::INTEGER AS grp FROM cut"""


@register("ward_summaries", _WARD_SQL)
def q_ward_summaries(spark, sf):
    """C6 over the summaries of the vectors by label and quarter of the ids."""
    from taxolens.operators.clustering.ward import ward_groups
    from taxolens.operators.vectors import centroids
    cells = FX.vectors(spark, sf).withColumn("cluster", (F.col("true_label").cast("long") * 4 + F.col("row_id") % 4))
    summaries = centroids(cells).select(
        F.col("cluster").alias("id"), F.col("size").alias("n"), F.col("centroid").alias("mean"))
    return ward_groups(summaries, _WARD_K)


_CORE_K = 5


@register("core_distance", S.with_(S.VECTORS, """pd AS (
  SELECT a.row_id, list_distance(a.features, b.features) AS d,
         row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features)) AS rk
  FROM vectors a CROSS JOIN vectors b)""", body=f"""
SELECT row_id, round(d, 6) AS core_dist FROM pd WHERE rk = {_CORE_K}"""))
def q_core_distance(spark, sf):
    from taxolens.operators.clustering.density import core_distances
    from taxolens.plans.catalog.util import rounded
    return rounded(core_distances(FX.vectors(spark, sf), _CORE_K))


_CORE_SQL = f"""pd AS (
  SELECT a.row_id AS a, b.row_id AS b, list_distance(a.features, b.features) AS d,
         row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features)) AS rk
  FROM vectors a CROSS JOIN vectors b),
core AS (SELECT a AS row_id, d AS cd FROM pd WHERE rk = {_CORE_K})"""


@register("mutual_reachability", S.with_(S.VECTORS, _CORE_SQL, body="""
SELECT p.a AS row_id, round(min(greatest(p.d, ca.cd, cb.cd)), 6) AS w
FROM pd p JOIN core ca ON ca.row_id = p.a JOIN core cb ON cb.row_id = p.b
WHERE p.a <> p.b GROUP BY 1"""))
def q_mutual_reachability(spark, sf):
    from taxolens.operators.clustering.density import core_distances, mr_nearest
    from taxolens.plans.catalog.util import rounded
    v = FX.vectors(spark, sf)
    return rounded(mr_nearest(v, core_distances(v, _CORE_K)).select("row_id", "w"))


_SWEEP = [1.16, 1.2]


def _sweep_sql() -> str:
    parts = ["WITH RECURSIVE " + S.VECTORS, _CORE_SQL]
    sels = []
    for i, eps in enumerate(_SWEEP):
        parts += [f"core{i} AS (SELECT row_id FROM core WHERE cd <= {eps})",
                  f"ce{i} AS (SELECT p.a, p.b FROM pd p WHERE p.d <= {eps} AND p.a IN (SELECT row_id FROM core{i}) "
                  f"AND p.b IN (SELECT row_id FROM core{i}))",
                  f"""reach{i}(node, comp) AS (
  SELECT row_id, row_id FROM core{i}
  UNION
  SELECT ce{i}.b, reach{i}.comp FROM reach{i} JOIN ce{i} ON ce{i}.a = reach{i}.node)""",
                  f"comps{i} AS (SELECT node, min(comp) AS comp FROM reach{i} GROUP BY 1)",
                  f"""lab{i} AS (SELECT node AS row_id, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster
  FROM comps{i})"""]
        sels.append(f"""SELECT CAST({eps} AS DOUBLE) AS eps, v.row_id, CAST(coalesce(l.cluster, -1) AS INTEGER) AS cluster
FROM vectors v LEFT JOIN lab{i} l USING (row_id)""")
    return ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(sels)


@register("density_sweep", _sweep_sql())
def q_density_sweep(spark, sf):
    from taxolens.operators.clustering.density import density_sweep
    return density_sweep(FX.vectors(spark, sf), _SWEEP, _CORE_K)
