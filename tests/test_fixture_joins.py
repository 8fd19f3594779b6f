"""Fixtures that pair embeddings with documents: dealt out by id, every pair kept."""

from collections import Counter

import pytest

from taxolens.plans import fixtures as FX


@pytest.fixture()
def tables(spark, tmp_path):
    spark.createDataFrame([(k, [float(k), 1.0], k % 3) for k in (1, 2, 2, 9, 19, 30)] + [(None, [0.0, 0.0], 1)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "a", "en", "src0", 1), (2, "b", "de", "src7", 1), (2, "c", None, "src8", 1),
                           (9, None, "fr", None, 0), (19, "d", "en", "src3", 1), (None, "e", "en", "src1", 1)],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("fixture", [FX.vec_doc, FX.vd_lab])
def test_pairs_are_not_broadcast(spark, tables, fixture):
    plan = fixture(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_every_pair_of_repeated_ids_under_every_labeling(spark, tables):
    lab = FX.vd_lab(spark, tables)
    assert lab.dtypes == [("algo", "string"), ("algo_ord", "int"), ("row_id", "bigint"), ("features", "array<double>"),
                          ("true_label", "string"), ("cluster", "int")]
    got = Counter((r["algo"], r["algo_ord"], r["row_id"], r["true_label"], r["cluster"]) for r in lab.collect())
    want = Counter()
    for k, lang, source in [(1, "en", -1), (9, "fr", None), (19, "en", 3), *[(2, x, s) for x in ("de", None)
                                                                              for s in (7, 8) for _ in range(2)]]:
        want.update([("label", 0, k, lang, k % 3), ("src", 1, k, lang, source),
                     ("mod", 2, k, lang, -1 if k % 10 == 9 else k % 10)])
    assert got == want
