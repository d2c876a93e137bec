"""Sparse ridge regression of the log-odds move on draft features."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MIN_INTERACTION_N, MIN_SPLIT_ROWS, MIN_TRAINING_ROWS, RIDGE_LAMBDA
from ..schemas import DRAFT_MODEL
from ..session import discard, materialize, shuffles_dropped
from .features import feature_support, newest_split, random_split, with_features

#: The vocabulary travels to the driver and to every task; it grows with champions
#: and patches, not with games. Fitting stops with an error beyond this size.
MAX_FEATURES = 5_000_000


def vocabulary(support: DataFrame) -> list[tuple[str, int]]:
    """Kept features in name order with their counts."""
    rows = support.select("feature", "n").limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features; raise min_n")
    return sorted((r["feature"], r["n"]) for r in rows)


def vectorize(rows: DataFrame, names: list[str], features: str = "features", out: str = "x") -> DataFrame:
    """Sparse indicator vectors of the kept features."""
    model = CountVectorizerModel.from_vocabulary(names, inputCol=features, outputCol=out)
    return model.setBinary(True).transform(rows)


#: Up to here (the one-pass solver's own limit) one pass collects X'X, at most 67 MB for each of
#: as many tasks as the cluster has cores; beyond it the fit is iterative, a pass for each step.
DENSE_FEATURES = 4096


def ridge(vectors: DataFrame, lam: float = RIDGE_LAMBDA, x: str = "x", y: str = "y",
          dense_limit: int = DENSE_FEATURES) -> LinearRegressionModel | None:
    """Solve (X'X + lam I) b = X'y without intercept or scaling; None without rows or variation.

    Spark scales the penalty by n and the label's standard deviation (population form
    in the one-pass solver, sample form in the iterative one), so ``lam`` is converted.
    One all-zero row with y = 0 leaves the solution unchanged and keeps a feature that
    is present in every row from being treated as an intercept.
    """
    head = vectors.select(x).first()
    if head is None:
        return None
    size = head[0].size
    zero = vectors.sparkSession.createDataFrame(
        [(SparseVector(size, {}), 0.0)],
        T.StructType([T.StructField(x, VectorUDT()), T.StructField(y, T.DoubleType())]))
    data = vectors.select(x, F.col(y).cast("double").alias(y)).unionByName(zero)
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("samp"), F.stddev_pop(y).alias("pop")).first()
    if not stats["samp"]:
        return None
    dense = size <= dense_limit
    if dense:
        data = data.coalesce(max(2, vectors.sparkSession.sparkContext.defaultParallelism))
    fit = LinearRegression(featuresCol=x, labelCol=y, predictionCol="predicted", fitIntercept=False,
                           standardization=False, elasticNetParam=0.0, solver="normal" if dense else "l-bfgs",
                           regParam=lam * stats["pop" if dense else "samp"] / stats["n"], maxIter=500, tol=1e-10)
    return fit.fit(data)


def r2(predicted: DataFrame, y: str = "y") -> float | None:
    """1 - residual over total sum of squares; 0 when the label does not vary."""
    s = predicted.agg(F.sum((F.col(y) - F.col("predicted")) ** 2).alias("res"),
                      (F.var_pop(y) * F.count(y)).alias("tot")).first()
    if s["res"] is None:
        return None
    return 1 - s["res"] / s["tot"] if s["tot"] else 0.0


def _holdout(vectors: DataFrame, lam: float) -> float | None:
    model = ridge(vectors.filter(~F.col("is_test")), lam)
    return None if model is None else r2(model.transform(vectors.filter("is_test")))


def design_matrix(rows: DataFrame, keep: list[str], min_n: int = MIN_INTERACTION_N,
                  min_rows: int = 0) -> tuple[DataFrame | None, list[tuple[str, int]], int]:
    """Training rows with a known y as vectors ``x`` beside ``keep``, the kept features, the number of rows.

    Names and vectors lie in the shared folder, where Parquet codes each distinct name once: no cache
    on the executors holds them, so memory does not follow the rows. No vectors below ``min_rows`` or of no rows.
    """
    with shuffles_dropped(rows.sparkSession):
        states = materialize(with_features(rows, keep).filter(F.col("y").isNotNull()), "states")
    n = states.count()
    if n < max(min_rows, 1):
        return None, [], n
    vocab = vocabulary(feature_support(states.select(F.explode("features").alias("feature")), min_n))
    vectors = materialize(vectorize(states, [f for f, _ in vocab]).drop("features"), "vectors")
    discard(states)
    return vectors, vocab, n


def coefficients(model: LinearRegressionModel | None, size: int) -> list[float]:
    """One coefficient for each feature; zeros where no model could be fitted."""
    return model.coefficients.toArray().tolist() if model else [0.0] * size


def fit_ridge(rows: DataFrame, lam: float = RIDGE_LAMBDA, *, min_n: int = MIN_INTERACTION_N,
              min_rows: int = MIN_TRAINING_ROWS, keys: tuple = ("oe_game_id", "team"),
              evaluate: bool = True) -> DataFrame:
    """Coefficient table (feature, coef, n) of training rows.

    With ``evaluate`` two rows carry held-out R2: ``__meta__`` (hash split; n = rows)
    and ``__meta_time__`` (newest two patches; n = test rows, NULL unless both parts
    exceed 50 rows). Fewer than ``min_rows`` rows give only ``__status__`` with the count.
    """
    spark = rows.sparkSession
    vectors, vocab, n = design_matrix(rows, [*keys, "y", "patch"] if evaluate else ["y"], min_n, min_rows)
    if vectors is None:
        return spark.createDataFrame([("__status__", None, n)], DRAFT_MODEL)
    meta = []
    if evaluate:
        meta.append(("__meta__", _holdout(random_split(vectors, list(keys)), lam), n))
        by_time = newest_split(vectors)
        size = by_time.agg(F.count_if("is_test").alias("te"), F.count_if(~F.col("is_test")).alias("tr")).first()
        score = (_holdout(by_time, lam)
                 if min(size["te"], size["tr"]) > MIN_SPLIT_ROWS else None)
        meta.append(("__meta_time__", score, size["te"]))
    coefs = coefficients(ridge(vectors, lam), len(vocab))
    discard(vectors)
    return spark.createDataFrame([(f, c, k) for (f, k), c in zip(vocab, coefs)] + meta, DRAFT_MODEL)


def residuals(vectors: DataFrame, vocab: list[tuple[str, int]], model: LinearRegressionModel | None,
              lam: float = RIDGE_LAMBDA, x: str = "x", y: str = "y") -> DataFrame:
    """What a fit leaves of the normal equations, X'Xb + lam b - X'y, as (feature, residual, n).

    A row knows its fit by itself and features are summed by number, so only sums are shuffled.
    """
    fitted = model.transform(vectors) if model else vectors.withColumn("predicted", F.lit(0.0))
    left = (fitted.select((F.col("predicted") - F.col(y)).alias("left"), F.explode(F.unwrap_udt(x)["indices"]).alias("i"))
            .groupBy("i").agg(F.sum("left").alias("s")))
    table = [(i, f, c, k) for i, ((f, k), c) in enumerate(zip(vocab, coefficients(model, len(vocab))))]
    return (vectors.sparkSession.createDataFrame(table, "i int, feature string, coef double, n long").join(left, "i")
            .select("feature", (F.col("s") + lam * F.col("coef")).alias("residual"), "n"))


def gram_matrix(exploded: DataFrame, row: list[str]) -> DataFrame:
    """X'X of the indicator matrix as (f1, f2, n), upper triangle.

    Features of one row are distinct and bounded by a draft's size; each row's pairs
    are made inside the row, and only counts are shuffled.
    """
    return gram_of_sets(exploded.groupBy(*row).agg(F.collect_set("feature").alias("f")), "f")


def gram_of_sets(rows: DataFrame, features: str) -> DataFrame:
    """The same of rows that hold their distinct features as an array; nothing is gathered by row."""
    rows = rows.select(F.array_sort(features).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a, i: F.transform(
        F.slice("f", i + 1, F.size("f")), lambda b: F.struct(a.alias("f1"), b.alias("f2")))))
    return rows.select(F.inline(pairs)).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))


def gram_target(exploded: DataFrame, y: str = "y") -> DataFrame:
    """X'y as (feature, xty)."""
    return exploded.groupBy("feature").agg(F.sum(y).alias("xty"))
