"""Vector operators: centroids, covariance, centred PCA, nearest centroid, internal metrics.

Heavy per-row arithmetic runs in Arrow batches (``mapInPandas`` /
``pandas_udf``) with numpy; only bounded summaries reach the driver
(k×d centroids, d×d covariance). Anything broadcast is size-checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.functions.vectors import distance
from taxolens.operators.metrics import join_single_rows
from taxolens.operators.neighbors import (BLOCK_ROWS, BLOCK_VALUES, block_cogroup, block_pairs, distance_tiles, least_cost,
                                          n_blocks, n_blocks_for, pair_distances, stack)
from taxolens.schema import CLUSTER, ROW_ID

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
#: Distances of rows to many centres that are held at once.
ASSIGN_VALUES = 1 << 22
#: Clusters of a labeling up to which a row's distance sums are columns.
SUM_COLUMNS = 64


# ---------------------------------------------------------------- centroids

def cluster_sums(df: DataFrame, features: str = "features", cluster: str = CLUSTER) -> DataFrame:
    """Per-partition numpy partial sums → ``(cluster, pos, s, n)`` summed across partitions.

    Shuffles k×d rows per partition instead of N×d exploded rows.
    """
    def part(it):
        acc: dict[int, list] = {}
        for pdf in it:
            if pdf.empty:
                continue
            X = stack(pdf[features])
            labels = pdf[cluster].to_numpy()
            for u in np.unique(labels):
                m = labels == u
                s = X[m].sum(axis=0)
                if u in acc:
                    acc[u][0] += s
                    acc[u][1] += int(m.sum())
                else:
                    acc[u] = [s, int(m.sum())]
        rows = [(int(u), p, float(v), n) for u, (s, n) in acc.items() for p, v in enumerate(s)]
        yield pd.DataFrame(rows, columns=["cluster", "pos", "s", "n"])

    parts = df.select(F.col(cluster).cast("int").alias("cluster"), features).mapInPandas(
        part, "cluster int, pos int, s double, n long")
    return parts.groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def centroids_long(df: DataFrame, features: str = "features", cluster: str = CLUSTER) -> DataFrame:
    """A14 long form: ``(cluster, pos, value)`` element-wise means."""
    return cluster_sums(df, features, cluster).select(
        "cluster", "pos", (F.col("s") / F.col("n")).alias("value"))


def centroids(df: DataFrame, features: str = "features", cluster: str = CLUSTER) -> DataFrame:
    """``(cluster, size, centroid array<double>)``; arrays have d entries each."""
    sums = cluster_sums(df, features, cluster)
    return (sums.groupBy("cluster")
            .agg(F.first("n").alias("size"),
                 F.sort_array(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("v"))))
                 .alias("_c"))
            .select("cluster", "size", F.col("_c.v").alias("centroid")))


def collect_centroids(cents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bring k centroids to the driver (k×d summary, size-checked by the caller's k)."""
    rows = cents.orderBy("cluster").collect()
    ids = np.array([r["cluster"] for r in rows], dtype=np.int64)
    mat = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return ids, mat


# ------------------------------------------------------------- nearest centroid

def assign_nearest(df: DataFrame, centers: np.ndarray, center_ids: np.ndarray | None = None,
                   features: str = "features", out: str = CLUSTER,
                   dist_col: str | None = "dist") -> DataFrame:
    """Label each row with its nearest centre (ties → lowest centre index).

    Centres travel as a broadcast variable when k·d·8 bytes is under
    ``BROADCAST_LIMIT_BYTES``; larger centre sets are split into chunks that
    each fit, evaluated chunk by chunk and reduced with ``min(struct(dist, id))``.
    """
    centers = np.asarray(centers, dtype=np.float64)
    ids = np.arange(len(centers)) if center_ids is None else np.asarray(center_ids)
    per_chunk = max(1, BROADCAST_LIMIT_BYTES // max(1, centers.shape[1] * 8))
    sc = df.sparkSession.sparkContext
    if len(centers) <= per_chunk:
        res = _assign_chunk(df, sc.broadcast((centers, ids)), features)
    else:
        parts = None
        for lo in range(0, len(centers), per_chunk):
            bc = sc.broadcast((centers[lo:lo + per_chunk], ids[lo:lo + per_chunk]))
            part = _assign_chunk(df.select(ROW_ID, features), bc, features).select(ROW_ID, "_nn")
            parts = part if parts is None else parts.unionByName(part)
        best = parts.groupBy(ROW_ID).agg(F.min(F.struct("_nn.dist", "_nn.cid")).alias("_nn"))
        res = df.join(best, ROW_ID)
    res = res.withColumn(out, F.col("_nn.cid").cast("int"))
    if dist_col:
        res = res.withColumn(dist_col, F.col("_nn.dist"))
    return res.drop("_nn")


def _assign_chunk(df: DataFrame, bc, features: str) -> DataFrame:
    @F.pandas_udf("struct<dist:double, cid:long>")
    def nearest(s: pd.Series) -> pd.DataFrame:
        C, cids = bc.value
        X = stack(s)
        if len(X) == 0:
            return pd.DataFrame({"dist": [], "cid": []})
        if len(C) <= 256:
            j = pair_distances(X, C).argmin(axis=1)
        else:  # GEMM expansion for many centres, exact distance recomputed for the winner
            norms, step = (C * C).sum(1)[None, :], max(1, ASSIGN_VALUES // len(C))
            j = np.concatenate([np.maximum((Y * Y).sum(1)[:, None] - 2 * Y @ C.T + norms, 0.0).argmin(axis=1)
                                for Y in (X[k:k + step] for k in range(0, len(X), step))])
        best = np.sqrt(((X - C[j]) ** 2).sum(axis=1))
        return pd.DataFrame({"dist": best, "cid": cids[j].astype(np.int64)})

    return df.withColumn("_nn", nearest(F.col(features)))


def lloyd_fixed(df: DataFrame, k: int, iterations: int, features: str = "features") -> DataFrame:
    """Deterministic Lloyd: first k rows by row_id as centres, fixed iterations.

    An empty cluster keeps its previous centre. Returns ``(row_id, cluster, dist)``
    for the assignment to the final centres. The loop carries only the k×d
    centre matrix on the driver.
    """
    init = df.orderBy(ROW_ID).limit(k).select(features).collect()
    C = np.array([r[0] for r in init], dtype=np.float64)
    for _ in range(iterations):
        lab = assign_nearest(df, C, features=features, dist_col=None)
        ids, M = collect_centroids(centroids(lab, features))
        C = C.copy()
        C[ids] = M
    return assign_nearest(df, C, features=features).select(ROW_ID, CLUSTER, "dist")


# ---------------------------------------------------------- covariance and PCA (V2)

def covariance_long(df: DataFrame, features: str = "features") -> DataFrame:
    """Sample covariance ``(i, j, cov)`` from per-partition Gram partial sums (d×d each)."""
    def part(it):
        G = s = None
        n = 0
        for pdf in it:
            if pdf.empty:
                continue
            X = stack(pdf[features])
            G = X.T @ X if G is None else G + X.T @ X
            s = X.sum(0) if s is None else s + X.sum(0)
            n += len(X)
        if G is None:
            return
        d = G.shape[0]
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d),
                            "g": G.ravel(), "si": np.repeat(s, d), "sj": np.tile(s, d), "n": n})

    parts = df.select(features).mapInPandas(part, "i int, j int, g double, si double, sj double, n long")
    tot = parts.groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("si").alias("si"),
                                      F.sum("sj").alias("sj"), F.sum("n").alias("n"))
    return tot.select("i", "j", ((F.col("g") - F.col("si") * F.col("sj") / F.col("n"))
                                 / (F.col("n") - 1)).alias("cov"))


def pca(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> DataFrame:
    """V2: centred PCA to k components with sign canonicalised (largest |loading| > 0).

    Spark's ``ml.feature.PCA`` does not centre on transform, so the mean is
    removed first (``StandardScaler(withMean=True, withStd=False)``).
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.withColumn("_v", array_to_vector(features))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vec)
    centred = scaler.transform(vec)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    pc = model.pc.toArray()  # d×k, small
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    sign_arr = F.array(*[F.lit(float(x)) for x in signs])
    proj = model.transform(centred).withColumn("_p", vector_to_array("_p"))
    return (proj.withColumn(out, F.zip_with("_p", sign_arr, lambda a, b: a * b))
            .drop("_v", "_c", "_p"))


# ------------------------------------------------------- internal metrics

def silhouette(df: DataFrame, features: str = "features", cluster: str = CLUSTER,
               block_rows: int | None = None, fast: bool = False) -> DataFrame:
    """M8: mean Euclidean silhouette; singletons score 0; null unless 2 ≤ k ≤ n-1.

    ``fast=True`` uses Spark's ``ClusteringEvaluator`` (squared-Euclidean
    silhouette, O(N·k)) — a different number, offered for very large inputs.

    Distances are those of :func:`silhouettes`, to which this is one labeling.
    """
    if fast:
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.functions import array_to_vector
        vec = df.select(array_to_vector(features).alias("_v"), F.col(cluster).cast("double").alias("_c"))
        score = ClusteringEvaluator(featuresCol="_v", predictionCol="_c").evaluate(vec)
        return df.sparkSession.range(1).select(F.lit(float(score)).alias("silhouette"))
    return silhouettes(df.select(ROW_ID, features, F.col(cluster).alias("silhouette")), ["silhouette"], features,
                       block_rows)


def silhouettes(df: DataFrame, clusters: list[str], features: str = "features",
                block_rows: int | None = None) -> DataFrame:
    """M8 of several labelings, the columns ``clusters``, of the same rows: one row with a column for each.

    Every unordered pair of rows is evaluated once for all labelings (``block_pairs``); a tile's distances times the
    indicators of the clusters are the sums of its rows, and transposed those of its columns. Sums are up to
    ``SUM_COLUMNS`` columns; a labeling of more clusters goes by itself (``_silhouette_of_many``).
    """
    base = df.select(ROW_ID, F.col(features).alias("x"),
                     *(F.col(f"`{c}`").cast("long").alias(f"c{l}") for l, c in enumerate(clusters)))
    stats = base.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(f"c{l}").alias(f"k{l}")
                                                      for l in range(len(clusters)))).first()
    n, k = stats["n"], [stats[f"k{l}"] for l in range(len(clusters))]
    few = [l for l in range(len(clusters)) if 2 <= k[l] <= min(n - 1, SUM_COLUMNS)]
    parts = [_sums_of_few(base, few, n, block_rows)] if few else []
    parts += [_silhouette_of_many(base.select(ROW_ID, F.col(f"c{l}").alias("c"), "x"), n, k[l], block_rows)
              .withColumnRenamed("silhouette", f"c{l}") for l in range(len(clusters)) if SUM_COLUMNS < k[l] <= n - 1]
    found = join_single_rows(*parts) if parts else df.sparkSession.range(1)
    return found.select(*((F.col(f"c{l}") if f"c{l}" in found.columns else F.lit(None).cast("double")).alias(c)
                          for l, c in enumerate(clusters)))


def _sums_of_few(base: DataFrame, few: list[int], n: int, block_rows: int | None) -> DataFrame:
    """Silhouettes of the labelings ``c{l}`` for l in ``few``, from a row's distance sums as columns."""
    pairs = F.explode(F.array(*(F.struct(F.lit(l).alias("l"), F.col(f"c{l}").alias("c")) for l in few))).alias("p")
    sizes: dict[int, dict[int, int]] = {l: {} for l in few}
    # at most SUM_COLUMNS rows a labeling
    for r in base.select(pairs).filter("p.c is not null").groupBy("p.l", "p.c").count().orderBy("l", "c").collect():
        sizes[r["l"]][r["c"]] = r["count"]
    wide = max(map(len, sizes.values()))
    starts = np.concatenate([[0], np.cumsum([len(sizes[l]) for l in few])]).tolist()
    code = {l: F.coalesce(F.array_position(F.array(*map(F.lit, sizes[l])), F.col(f"c{l}")) - 1, F.lit(-1)).cast("int")
            for l in few}
    rows = base.select(ROW_ID, "x", *(code[l].alias(f"c{l}") for l in few))
    columns = [f"s{p}" for p in range(wide)]

    def indicators(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), starts[-1]))
        for at, l in zip(starts, few):
            own = pdf[f"c{l}"].to_numpy()
            out[np.flatnonzero(own >= 0), at + own[own >= 0]] = 1.0
        return out

    def table(pdf: pd.DataFrame, S: np.ndarray) -> list[pd.DataFrame]:
        out = []
        for at, end, l in zip(starts, starts[1:], few):
            own = (pdf[f"c{l}"] >= 0).to_numpy()
            one = pd.DataFrame(S[own, at:end], columns=columns[:end - at]).reindex(columns=columns)
            one.insert(0, "c", pdf[f"c{l}"].to_numpy()[own])
            one.insert(0, "l", np.int32(l))
            one.insert(0, ROW_ID, pdf[ROW_ID].array[own])
            out.append(one)
        return out

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame | None) -> pd.DataFrame:
        X, I = stack(lp["x"]), indicators(lp)
        Y, J = (X, I) if rp is None else (stack(rp["x"]), indicators(rp))
        S = np.zeros(I.shape)
        T = S if rp is None else np.zeros(J.shape)
        for i, j, D in distance_tiles(X, Y, upper=rp is None):
            S[i] += D @ J[j]
            if rp is not None or i.start < j.start:
                T[j] += D.T @ I[i]
        return pd.concat(table(lp, S) + ([] if rp is None else table(rp, T)), ignore_index=True)

    nb = n_blocks(rows, n, "x", block_rows)
    sums = block_pairs(rows, nb, kernel, ", ".join([f"{ROW_ID} long, l int, c int", *(f"{s} double" for s in columns)]))
    per = sums.groupBy(ROW_ID, "l", "c").agg(*(F.sum(s).alias(s) for s in columns))
    z = base.sparkSession.createDataFrame([(l, list(sizes[l].values())) for l in few], "l int, z array<long>")
    s = F.array(*columns)
    mean = F.zip_with(s, "z", lambda x, m: x / m)
    per = per.join(F.broadcast(z), "l").select(
        "l", F.element_at("z", F.col("c") + 1).alias("own"), F.element_at(s, F.col("c") + 1).alias("own_s"),
        F.array_min(F.filter(mean, lambda x, i: i != F.col("c"))).alias("b"))
    # divided for each row, also for those of one-row clusters
    a = F.col("own_s") / F.nullif(F.col("own") - 1, F.lit(0))
    score = F.when(F.col("own") <= 1, F.lit(0.0)).otherwise((F.col("b") - a) / F.greatest(a, F.col("b")))
    return per.agg(*(F.avg(F.when(F.col("l") == l, score)).alias(f"c{l}") for l in few))


def _silhouette_of_many(base: DataFrame, n: int, k: int, block_rows: int | None) -> DataFrame:
    """Silhouette of ``(row_id, c, x)`` with many clusters.

    Every (left block, right block) kernel emits per-left-row distance sums per right cluster, so the output is
    O(n·k), never O(n²). A cluster's rows go to as few right blocks as hold them, so that a block has few clusters
    and a row few sums.
    """
    features = "x"
    sizes = base.groupBy(F.col("c").alias("oc")).agg(F.count(F.lit(1)).alias("osize"))

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        rp = rp.sort_values("c")
        uniq, first = np.unique(rp["c"].to_numpy(), return_index=True)
        S = np.zeros((len(lp), len(uniq)))
        for i, j, D in distance_tiles(stack(lp[features]), stack(rp[features])):
            # clusters that have rows in this tile
            own = slice(int(np.searchsorted(first, j.start, "right")) - 1, int(np.searchsorted(first, j.stop)))
            S[i, own] += np.add.reduceat(D, np.maximum(first[own] - j.start, 0), axis=1)
        return pd.DataFrame({ROW_ID: np.repeat(lp[ROW_ID].to_numpy(), len(uniq)),
                             "c": np.repeat(lp["c"].to_numpy(), len(uniq)),
                             "oc": np.tile(np.asarray(uniq, dtype=np.int64), len(lp)),
                             "s": S.ravel()})

    # sums of a block's rows for the clusters of another are a table as well
    most = block_rows or int(min(BLOCK_ROWS, max(1.0, 2 * BLOCK_VALUES * n / max(1, k)) ** 0.5))
    nb = max(n_blocks(base, n, features, block_rows), n_blocks_for(n, most))
    parts = F.ceil(F.col("osize") * nb / n).cast("int")
    block = F.pmod(F.pmod(F.xxhash64("c"), F.lit(nb)) + F.pmod(F.xxhash64(ROW_ID), parts), F.lit(nb)).cast("int")
    right = base.join(sizes, F.col("c") == F.col("oc")).select(ROW_ID, "c", features, "osize")
    sums = block_cogroup(base, right, nb, kernel, f"{ROW_ID} long, c long, oc long, s double", right_block=block)
    per = (sums.groupBy(ROW_ID, "c", "oc").agg(F.sum("s").alias("s")).join(sizes, "oc")
           .groupBy(ROW_ID, "c")
           .agg(F.max(F.when(F.col("oc") == F.col("c"), F.col("osize"))).alias("own"),
                F.max(F.when(F.col("oc") == F.col("c"), F.col("s"))).alias("own_s"),
                F.min(F.when(F.col("oc") != F.col("c"), F.col("s") / F.col("osize"))).alias("b")))
    a = F.col("own_s") / (F.col("own") - 1)
    score = F.when(F.col("own") <= 1, F.lit(0.0)).otherwise((F.col("b") - a) / F.greatest(a, F.col("b")))
    return per.agg(F.avg(score).alias("silhouette"))


def cluster_moments(df: DataFrame, features: str = "features", cluster: str = CLUSTER) -> DataFrame:
    """Sums that M9 and M10 need, in one pass: ``(cluster, pos, s, n, at)``.

    ``s`` is the sum of the cluster's vectors at position ``pos``, that of their squared norms at -1, all around one row's
    vector (``at`` is its value), which keeps the differences of squares exact for data far from 0. A task sends k×(d+1)
    rows.
    """
    head = df.select(features).first()
    origin = np.asarray(head[0] if head else [], dtype=np.float64)

    def part(it):
        acc: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for pdf in it:
            if pdf.empty:
                continue
            X = stack(pdf[features]) - origin
            X = np.column_stack([(X * X).sum(axis=1), X])
            ids, codes = np.unique(pdf["c"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(ids), X.shape[1]))
            np.add.at(sums, codes, X)
            for u, row, n in zip(ids.tolist(), sums, np.bincount(codes).tolist()):
                acc[u] = acc.get(u, 0) + row
                count[u] = count.get(u, 0) + n
        at = np.append(0.0, origin)
        for u, row in acc.items():
            yield pd.DataFrame({"cluster": u, "pos": np.arange(len(row)) - 1, "s": row, "n": count[u], "at": at})

    parts = df.select(F.col(cluster).cast("int").alias("c"), features).mapInPandas(
        part, "cluster int, pos int, s double, n long, at double")
    return parts.groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.first("at").alias("at"))


def _moment_centroids(moments: DataFrame) -> DataFrame:
    return (moments.filter("pos >= 0").groupBy("cluster")
            .agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("at") + F.col("s") / F.col("n")).alias("v")))).alias("c"))
            .select("cluster", F.col("c.v").alias("centroid")))


def cluster_spreads(df: DataFrame, cents: DataFrame, features: str = "features", cluster: str = CLUSTER) -> DataFrame:
    """``(c, s)``: mean distance of a cluster's rows to its centroid ``(cluster, centroid)``.

    Centroids that fit a broadcast go to the rows, whose distances are summed within the tasks; otherwise both are joined.
    """
    size = cents.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("centroid")).alias("d")).first()
    rows = df.select(F.col(cluster).cast("int").alias("c"), features)
    if size["k"] * (size["d"] or 0) * 8 > BROADCAST_LIMIT_BYTES:
        return (rows.join(cents, F.col("c") == F.col("cluster"))
                .groupBy("c").agg(F.avg(distance(features, "centroid")).alias("s")))
    ids, centers = collect_centroids(cents)
    sent = df.sparkSession.sparkContext.broadcast((ids, centers))

    def part(it):
        ids, centers = sent.value
        total, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for pdf in it:
            if not pdf.empty:
                at = np.searchsorted(ids, pdf["c"].to_numpy())
                X = stack(pdf[features]) - centers[at]
                np.add.at(total, at, np.sqrt((X * X).sum(axis=1)))
                count += np.bincount(at, minlength=len(ids))
        own = count > 0
        yield pd.DataFrame({"c": ids[own].astype(np.int32), "s": total[own], "n": count[own]})

    return (rows.mapInPandas(part, "c int, s double, n long").groupBy("c")
            .agg((F.sum("s") / F.sum("n")).alias("s")))


def davies_bouldin(df: DataFrame, features: str = "features", cluster: str = CLUSTER,
                   block_rows: int = 2048, moments: DataFrame | None = None) -> DataFrame:
    """M9: mean over clusters of max (s_i + s_j)/d_ij; 0 if all spreads or all gaps ≈ 0.

    ``moments`` are the :func:`cluster_moments` of the rows, if they are there already."""
    cents = _moment_centroids(cluster_moments(df, features, cluster) if moments is None else moments)
    spread = cluster_spreads(df, cents, features, cluster)
    cs = cents.join(spread, F.col("cluster") == F.col("c")).select(
        F.col("c").cast("long").alias(ROW_ID), "s", "centroid")
    k = cs.count()

    def kernel(lp, rp):
        D = pair_distances(stack(lp["centroid"]), stack(rp["centroid"]))
        dmax = float(D.max()) if D.size else 0.0
        Dz = np.where(D == 0, np.inf, D)
        R = (lp["s"].to_numpy()[:, None] + rp["s"].to_numpy()[None, :]) / Dz
        return pd.DataFrame({ROW_ID: lp[ROW_ID].to_numpy(), "r": R.max(axis=1),
                             "s": lp["s"].to_numpy(), "dmax": dmax})

    per = block_cogroup(cs, cs, n_blocks_for(k, block_rows), kernel,
                        f"{ROW_ID} long, r double, s double, dmax double")
    per = per.groupBy(ROW_ID).agg(F.max("r").alias("r"), F.max("s").alias("s"),
                                  F.max("dmax").alias("dmax"))
    return per.agg(F.when((F.max(F.abs("s")) <= 1e-8) | (F.max("dmax") <= 1e-8), F.lit(0.0))
                   .otherwise(F.avg("r")).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = CLUSTER,
                      moments: DataFrame | None = None) -> DataFrame:
    """(SSB/(k-1)) / (SSW/(n-k)); 1 when SSW = 0. From :func:`cluster_moments` alone: the rows are read once.

    SSW = Σ‖x‖² − Σ_c ‖S_c‖²/n_c and SSB = Σ_c ‖S_c‖²/n_c − ‖S‖²/n, all around one origin."""
    m = cluster_moments(df, features, cluster) if moments is None else moments
    size = m.filter("pos = -1").agg(F.sum("s").alias("ss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    within = (m.filter("pos >= 0").groupBy("pos").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"),
                                                      F.sum("s").alias("all"))
              .agg(F.sum("own").alias("own"), F.sum(F.col("all") * F.col("all")).alias("all")))
    both = join_single_rows(size, within)
    ssw, ssb = F.col("ss") - F.col("own"), F.col("own") - F.col("all") / F.col("n")
    return both.select(F.when(ssw <= F.col("ss") * 1e-13, F.lit(1.0)).otherwise(
        ssb * (F.col("n") - F.col("k")) / (ssw * (F.col("k") - 1.0))).alias("calinski_harabasz"))


# ------------------------------------------------------------ representatives (L3)

def representatives(df: DataFrame, n: int = 3, features: str = "features",
                    cluster: str = CLUSTER) -> DataFrame:
    """L3: per non-noise cluster the n rows nearest the centroid (ties by row_id);
    clusters smaller than n return all members in row order.

    ``row_number() <= n`` is planned with a WindowGroupLimit before the
    shuffle, so each partition forwards at most n rows per cluster.
    """
    from pyspark.sql import Window

    valid = df.filter(F.col(cluster) != -1)
    cents = centroids(valid, features, cluster).withColumnRenamed("cluster", "_c")
    j = valid.join(cents, valid[cluster] == cents["_c"]).withColumn("dist", distance(features, "centroid"))
    small = F.col("size") < n
    w = Window.partitionBy(cluster).orderBy(F.when(small, F.lit(0.0)).otherwise(F.col("dist")), ROW_ID)
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .drop("_c", "centroid"))


def nearest_join(points: DataFrame, centers: DataFrame, features: str = "features",
                 center_features: str = "centroid", center_id: str = "cid", block_rows: int = 4096) -> DataFrame:
    """J7 without the driver: nearest centre by a blocked cogroup of points × centres.

    For centre sets too large to broadcast. Emits one candidate per (point, centre
    block) and reduces with ``min(struct(dist, id))`` (ties → lowest id).
    """
    n_c = centers.count()
    nb = max(1, -(-n_c // block_rows))
    left = points.select(ROW_ID, features)
    right = centers.select(F.col(center_id).cast("long").alias(ROW_ID), F.col(center_features).alias("_cf"))

    def kernel(lp, rp):
        _, cid, dist = least_cost(stack(lp[features]), stack(rp["_cf"]), rp[ROW_ID].to_numpy())
        return pd.DataFrame({ROW_ID: lp[ROW_ID].to_numpy(), "cid": cid, "dist": dist})

    cand = _points_vs_blocks(left, right, nb, kernel)
    best = cand.groupBy(ROW_ID).agg(F.min(F.struct("dist", "cid")).alias("b"))
    return best.select(ROW_ID, F.col("b.cid").cast("int").alias(CLUSTER), F.col("b.dist").alias("dist"))


def _points_vs_blocks(left: DataFrame, right: DataFrame, nb: int, kernel) -> DataFrame:
    """Each point meets every centre block once: key = (point hash bucket, centre block)."""
    n_pb = max(left.sparkSession.sparkContext.defaultParallelism, n_blocks_for(left.count(), BLOCK_ROWS))
    lb = (left.withColumn("_pb", F.pmod(F.xxhash64(ROW_ID), F.lit(n_pb)))
          .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))))
    rb = (right.select(*[F.col(c).alias(c) for c in right.columns])
          .withColumn("_cb", F.pmod(F.xxhash64(ROW_ID), F.lit(nb)))
          .withColumn("_pb", F.explode(F.sequence(F.lit(0), F.lit(n_pb - 1)))))

    def run(lp, rp):
        if lp.empty or rp.empty:
            return pd.DataFrame({ROW_ID: [], "cid": [], "dist": []})
        return kernel(lp, rp)

    return (lb.groupBy("_pb", "_cb").cogroup(rb.groupBy("_pb", "_cb"))
            .applyInPandas(run, f"{ROW_ID} long, cid long, dist double"))
