"""Model queries. Fitted values are not expressible in SQL, so these carry no twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import seeded_key
from ..operators import evaluate as E
from ..operators import models as Mo
from ..session import durable, scratch_path
from .fixtures import Tables
from .q_rain import r6
from .registry import query
from .twins import twin

NUM = ["elev", "slope", "row", "col"]
CAT = ["lith"]


def training(t: Tables):
    """Labelled cells with block folds, materialised once for the many passes of a fit."""
    c = t.labelled().withColumn("fold", F.pmod(F.floor(F.col("row") / 6) + F.floor(F.col("col") / 6), F.lit(5)).cast("int"))
    return durable(c.select("cell_id", "label", "fold", *NUM, *CAT, "lc"))


@query("out_of_fold_scores", "M1 M7", None)
def out_of_fold_scores(spark, sf):
    o = Mo.oof_scores(training(Tables(spark, sf)), ["cell_id"], numeric=NUM, categories=CAT, iters=5, depth=3)
    return o.select("cell_id", "fold", "label", r6("score"))


@query("out_of_fold_coverage", "M1", twin("SELECT CAST((row // 6 + col // 6) % 5 AS INT) AS fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, count(*) AS cells, count(*) AS in_range FROM labelled GROUP BY 1", "labelled"))
def out_of_fold_coverage(spark, sf):
    """What holds for any right model: every cell is scored once, in its own fold, between 0 and 1."""
    o = Mo.oof_scores(training(Tables(spark, sf)), ["cell_id"], numeric=NUM, categories=CAT, iters=2, depth=2)
    return o.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"), F.countDistinct("cell_id").alias("cells"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"))


@query("full_model_scores", "M2", None)
def full_model_scores(spark, sf):
    d = training(Tables(spark, sf))
    m = Mo.fit_full(d, scratch_path(spark, "model"), numeric=NUM, categories=CAT, iters=5, depth=3)
    return Mo.score(m, d).select("cell_id", "label", r6("score"))


@query("feature_importance", "M3", None)
def feature_importance(spark, sf):
    m = Mo.fit(training(Tables(spark, sf)), NUM, CAT, iters=5, depth=3)
    return Mo.importance(spark, m, [*NUM, *CAT]).select("feature", r6("gain_percent"))


@query("size_model_cv", "M21", None)
def size_model_cv(spark, sf):
    p = Tables(spark, sf).raw("orders").select(
        F.log10("o_totalprice").alias("la"), F.month("o_orderdate").alias("month"), F.pmod("o_custkey", F.lit(97)).alias("c"),
        F.pmod("o_custkey", F.lit(5)).cast("int").alias("fold"), F.dayofyear("o_orderdate").alias("doy"))
    return Mo.size_model_cv(durable(p), ["month", "c", "doy"], "la", iters=3).select("fold", "n", r6("rho"), r6("r2"), r6("error_factor"))


@query("feature_ablation", "M24", None)
def feature_ablation(spark, sf):
    d = training(Tables(spark, sf))
    return Mo.ablate(d, {"terrain": ["elev", "slope"]}, NUM, CAT, iters=3, depth=3).select("left_out", r6("auc"))


@query("logistic_baseline", "M25", None)
def logistic_baseline(spark, sf):
    return Mo.logistic_cv(training(Tables(spark, sf)), ["elev", "slope"], "slope").select("model", r6("auc"))


@query("pooled_region_holdout", "M30", None)
def pooled_region_holdout(spark, sf):
    d = training(Tables(spark, sf))
    regions = d.withColumn("region", F.when(F.col("lc") <= 50, "west").otherwise("east")).withColumn(
        "w", F.when(F.col("lc") <= 50, 2.0).otherwise(1.0))
    o = Mo.oof_scores(regions, ["cell_id"], fold="region", folds=["west", "east"], numeric=NUM, categories=CAT, iters=3, depth=3, weight="w")
    return E.auc(o, "score", "label", ["region"]).select("region", "n_pos", r6("auc"))


# What holds for any right model, as SQL can state it: these check the machinery around a fit, not the fit itself.


@query("full_model_invariants", "M2", twin("SELECT count(*) AS n, count(*) AS cells, count(*) AS in_range, count(*) AS same_after_reload, CAST(sum(label) AS BIGINT) AS n_pos FROM labelled", "labelled"))
def full_model_invariants(spark, sf):
    """A saved and reloaded model scores every cell as the fitted one did."""
    d = training(Tables(spark, sf))
    m = Mo.fit(d, NUM, CAT, iters=3, depth=3)
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    a = Mo.score(m, d).select("cell_id", "label", "score")
    b = Mo.score(type(m).load(path), d).select("cell_id", F.col("score").alias("again"))
    return a.join(b, "cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"), F.count_if(F.col("score").between(0, 1)).alias("in_range"),
        F.count_if(F.col("score") == F.col("again")).alias("same_after_reload"), F.sum("label").cast("long").alias("n_pos"))


@query("importance_invariants", "M3", "SELECT 5 AS features, 5 AS different, 100.0e0 AS total, 0 AS negative, 0 AS out_of_order")
def importance_invariants(spark, sf):
    """Every feature once, percent that add up to 100, largest first. The numbers are those of the features, not of the rows."""
    m = Mo.fit(training(Tables(spark, sf)), NUM, CAT, iters=3, depth=3)
    i = Mo.importance(spark, m, [*NUM, *CAT]).select("feature", "gain_percent").collect()
    ranked = [r.gain_percent for r in i]
    out = (len(i), len({r.feature for r in i}), round(sum(ranked), 6), sum(g < 0 for g in ranked), sum(a < b for a, b in zip(ranked, ranked[1:], strict=False)))
    return spark.createDataFrame([out], "features int, different int, total double, negative int, out_of_order int")


@query("size_model_folds", "M21", "SELECT CAST(o_custkey % 5 AS INT) AS fold, count(*) AS n, count(*) >= 50 AS measured FROM orders GROUP BY 1, o_custkey % 5")
def size_model_folds(spark, sf):
    """Every fold is measured on all of its own rows; a fold under 50 rows has no measures."""
    p = Tables(spark, sf).raw("orders").select(
        F.log10("o_totalprice").alias("la"), F.month("o_orderdate").alias("month"), F.pmod("o_custkey", F.lit(97)).alias("c"), F.pmod("o_custkey", F.lit(5)).cast("int").alias("fold"))
    held = p.select("fold").distinct().orderBy("fold").collect()
    c = Mo.size_model_cv(durable(p), ["month", "c"], "la", folds=[r.fold for r in held], iters=1)
    return c.select("fold", "n", (F.col("rho").isNotNull() & F.col("r2").isNotNull() & F.col("error_factor").isNotNull()).alias("measured"))


@query("ablation_invariants", "M24", "SELECT unnest(['none', 'place', 'terrain']) AS left_out, true AS in_range")
def ablation_invariants(spark, sf):
    a = Mo.ablate(training(Tables(spark, sf)), {"terrain": ["elev", "slope"], "place": ["row", "col"]}, NUM, CAT, folds=(0, 1, 2, 3, 4), iters=1, depth=2)
    return a.select("left_out", F.col("auc").between(0, 1).alias("in_range"))


@query("logistic_certificate", "M25", twin("SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(label) AS BIGINT) AS expected_pos, true AS stationary FROM labelled", "labelled"))
def logistic_certificate(spark, sf):
    """An unpenalised logistic fit is optimal where its residuals add up to 0, alone and weighted by each feature."""
    d = training(Tables(spark, sf))
    s = Mo.score(Mo.fit_logistic(d, ["elev", "slope"], most=200, tol=1e-10), d)
    r = F.col("label") - F.col("score")
    flat = [F.abs(F.sum(r * F.col(c))) < 1e-4 * F.sum(F.abs(F.col(c))) for c in ("elev", "slope")]
    return s.agg(F.sum("label").cast("long").alias("n_pos"), F.round(F.sum("score")).cast("long").alias("expected_pos"), (flat[0] & flat[1]).alias("stationary"))


@query("region_holdout_coverage", "M30", twin("SELECT CASE WHEN lc <= 50 THEN 'west' ELSE 'east' END AS region, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, count(*) AS in_range FROM labelled GROUP BY 1", "labelled"))
def region_holdout_coverage(spark, sf):
    """Each region is scored once, whole, by a model fitted on the others with regional weights."""
    d = training(Tables(spark, sf))
    west = F.col("lc") <= 50
    regions = d.withColumn("region", F.when(west, "west").otherwise("east")).withColumn("w", F.when(west, 2.0).otherwise(1.0))
    o = Mo.oof_scores(regions, ["cell_id"], fold="region", folds=["west", "east"], numeric=NUM, categories=CAT, iters=1, depth=2, weight="w")
    return o.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"), F.count_if(F.col("score").between(0, 1)).alias("in_range"))


@query("model_sample_keys", "L7 M1", "SELECT p_partkey, md5(p_partkey || '|42') AS key FROM part")
def model_sample_keys(spark, sf):
    return Tables(spark, sf).raw("part").select("p_partkey", seeded_key(42, "p_partkey").alias("key"))
