"""Scaling, PCA, encoding and KMeans segmentation on ``pyspark.ml``.

Scalers are plain projections with a broadcast one-row table of statistics, so they
reproduce sklearn exactly (population std for the z-score, (x - median) / IQR for the
robust scaler).  PCA uses ``ml.feature.PCA`` (a distributed covariance, a p x p
eigen-decomposition on the driver — bounded by the number of features) on centred
and scaled data, with each component's sign fixed so its largest loading is positive.
KMeans is ``ml.clustering.KMeans`` (k-means||, seed 42); inertia is the training cost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import as_double, col, is_numeric, nan_to_null, r4, tall_agg, with_scalars
from tablescope.operators.histogram import exact_quantiles, wide_quantiles
from tablescope.session import staged


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", suffix: str = "") -> DataFrame:
    """standard: (x - mean) / population std; minmax: (x - min) / (max - min);
    robust: (x - median) / IQR.  Constant columns scale to 0."""
    df = nan_to_null(df)
    cols = list(cols)
    if method == "robust":
        q = wide_quantiles(exact_quantiles(df, cols, [0.25, 0.5, 0.75]), ["column"],
                           {0.25: "a", 0.5: "b", 0.75: "c"})
        stats = q.select("column", F.col("b").alias("center"), (F.col("c") - F.col("a")).alias("spread"))
    else:
        if method == "standard":
            make = lambda c: {"center": F.avg(as_double(df, c)), "spread": F.stddev_pop(as_double(df, c))}
        elif method == "minmax":
            make = lambda c: {"center": F.min(as_double(df, c)),
                              "spread": F.max(as_double(df, c)) - F.min(as_double(df, c))}
        else:
            raise ValueError(f"unknown scaling method {method!r}")
        stats = tall_agg(df, cols, make, ["center", "spread"])
    row = stats.groupBy().pivot("column", cols).agg(F.first(F.struct("center", "spread")))
    row = row.select(*[col(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, row)
    idx = {c: i for i, c in enumerate(cols)}
    out = []
    for c in df.columns:
        if c in idx:
            s = F.col(f"_s{idx[c]}")
            v = F.coalesce(F.try_divide(as_double(df, c) - s["center"], s["spread"]), F.lit(0.0))
            if suffix:
                out.append(col(c))
            out.append(F.when(col(c).isNull(), None).otherwise(v).alias(c + suffix))
        else:
            out.append(col(c))
    return j.select(*out)


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Categories -> codes in sorted order (``StringIndexer`` alphabetAsc), replacing the columns."""
    cols = list(cols)
    if not cols:
        return df
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}__code" for c in cols], stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    out = idx.transform(df)
    return out.select(*[F.col(f"{c}__code").alias(c) if c in cols else col(c) for c in df.columns])


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One 0/1 double column per category (none dropped), named ``<col>_<value>``.

    Categories come from the distinct values (one row per value, bounded by the
    column's cardinality); the columns are plain ``when`` projections.
    """
    return _one_hot(df, cols)[0]


def _one_hot(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The encoded frame and the names of its new columns; a name that is already taken is an error."""
    out, names = df, []
    for c in list(cols):
        values = [r[0] for r in df.where(col(c).isNotNull()).select(col(c).cast("string")).distinct()
                  .orderBy(1).collect()]
        new = [f"{c}_{v}" for v in values]
        if clash := sorted(set(new) & (set(df.columns) | set(names))):
            raise ValueError(f"one-hot columns {clash} of {c!r} exist already; rename them first")
        out = out.select("*", *[F.when(col(c).cast("string") == v, 1.0).otherwise(0.0).alias(n)
                                for v, n in zip(values, new)]).drop(c)
        names += new
    return out, names


def category_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Sorted integer codes (0-based) of a category column, NULL stays NULL (dense rank of values)."""
    name = name or f"{column}_code"
    idx = StringIndexer(inputCol=column, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="keep").fit(
        df.where(col(column).isNotNull()))
    return idx.transform(df).withColumn(name, F.when(col(column).isNull(), None).otherwise(F.col(name).cast("int")))


def _assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def feature_frame(df: DataFrame, cols: Sequence[str] | None = None, target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Robust numeric features (minus target): coerced, sparse rows dropped, median-filled,
    constant columns removed.  Returns the frame and the kept feature names."""
    from tablescope.operators.assoc import feature_matrix
    from tablescope.operators.clean import zero_variance_guard
    df = nan_to_null(df)
    cols = [c for c in (cols or [c for c in df.columns if is_numeric(df.schema[c].dataType)]) if c != target]
    fm = feature_matrix(df, cols)
    keep = [r["column"] for r in zero_variance_guard(fm, cols).where("keep").collect()]
    keep = [c for c in cols if c in keep]
    return fm.select(*[col(c) for c in keep]), keep


def pca(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = None, scaling: str = "standard",
        target: str | None = None) -> dict[str, DataFrame]:
    """PCA on scaled features: ``variance`` (component, ratio, cumulative), ``loadings``
    (component, feature, loading), ``summary`` (components for 80 % / 95 %, top feature of
    the first three components) and ``projection`` (rows with pc1..pck)."""
    fm, feats = feature_frame(df, cols, target)
    k = min(k or len(feats), len(feats))
    vec = _assemble(scale(fm, feats, scaling), feats)
    model = _fit(PCA(k=k, inputCol="features", outputCol="pcs"), vec)
    spark = df.sparkSession
    ev = [float(x) for x in model.explainedVariance.toArray()]
    pc = model.pc.toArray()  # p x k, bounded by the number of features
    signs = []
    for j in range(k):
        colv = pc[:, j]
        signs.append(1.0 if colv[abs(colv).argmax()] >= 0 else -1.0)
    cum, acc = [], 0.0
    for v in ev:
        acc += v
        cum.append(acc)
    variance = spark.createDataFrame([(j + 1, ev[j], cum[j]) for j in range(k)],
                                     "component int, explained_variance_ratio double, cumulative double")
    loadings = spark.createDataFrame([(j + 1, feats[i], float(pc[i, j] * signs[j])) for j in range(k)
                                      for i in range(len(feats))], "component int, feature string, loading double")
    n80 = next((j + 1 for j in range(k) if cum[j] >= 0.8), k)
    n95 = next((j + 1 for j in range(k) if cum[j] >= 0.95), k)
    tops = [feats[int(abs(pc[:, j]).argmax())] for j in range(min(3, k))]
    summary = spark.createDataFrame([(len(feats), k, n80, n95, *(tops + [None] * (3 - len(tops))))],
                                    "features int, components int, components_80 int, components_95 int, "
                                    "top_pc1 string, top_pc2 string, top_pc3 string")
    proj = model.transform(vec).select(vector_to_array("pcs").alias("_a"))
    projection = proj.select(*[(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])
    return {"variance": variance, "loadings": loadings, "summary": summary, "projection": projection}


def _features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scaling: str = "standard",
              encoding: str = "one_hot", missing: str = "impute") -> tuple[DataFrame, DataFrame, list[str]]:
    """The frame with ``features`` (scaled), the encoded frame before scaling, and the feature names.

    missing: "impute" (mean / mode) or "drop" (rows with a gap in any used column go);
    encoding: "one_hot" or "label"; scaling: "standard", "minmax" or "robust".
    """
    from tablescope.operators.clean import drop_missing, impute_mean_mode
    if missing == "impute":
        base = impute_mean_mode(df, numeric, categorical)
    elif missing == "drop":
        base = drop_missing(df, [*numeric, *categorical])
    else:
        raise ValueError(f"unknown treatment of missing values {missing!r}")
    if encoding == "one_hot":
        enc, coded = _one_hot(base, categorical)
    elif encoding == "label":
        enc, coded = label_encode(base, categorical), list(categorical)
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    filled = base.agg(*[F.count(col(c)).alias(c) for c in numeric]).first() if numeric else {}
    # a feature without any value says nothing and cannot be imputed: it is left out, its rows stay
    feats = [c for c in numeric if filled[c] > 0] + coded
    scaled = scale(enc, feats, scaling, suffix="__s")
    return _assemble(scaled, [f"{c}__s" for c in feats]), enc, feats


def _held(vec: DataFrame) -> DataFrame:
    """The features alone, written below the checkpoint folder, read back and cached.

    An estimator runs dozens of jobs on them, and each task of these would report the metrics of every step that
    made the features to the driver; the files also are cut by their size, not by the partitions of a shuffle."""
    return staged(vec.select("features"), "features").cache()


def _fit(estimator, vec: DataFrame):
    """Fit on the features alone, held while the estimator runs and released afterwards."""
    train = _held(vec)
    try:
        return estimator.fit(train)
    finally:
        train.unpersist()


def segmentation_pipeline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                          k: int = 3, seed: int = 42, **options: str):
    """Missing values -> encoding -> scaling -> KMeans, with the ``options`` of ``_features``.

    Returns (model, frame with ``features`` and ``cluster``, feature names, encoded frame)."""
    vec, enc, feats = _features(df, numeric, categorical, **options)
    model = _fit(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"), vec)
    return model, model.transform(vec), feats, enc


def kmeans(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3,
           seed: int = 42, **options: str) -> DataFrame:
    """Input rows (imputed, or without gaps) with their ``cluster`` label; options: scaling, encoding, missing."""
    _, out, _, _ = segmentation_pipeline(df, numeric, categorical, k, seed, **options)
    return out.drop("features", *[c for c in out.columns if c.endswith("__s")])


def elbow(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), ks: Sequence[int] = range(2, 11),
          seed: int = 42, **options: str) -> DataFrame:
    """Inertia (within-cluster sum of squares) for each k on one feature frame, held for the sweep only."""
    vec = _held(_features(df, numeric, categorical, **options)[0])
    rows = [(int(k), float(KMeans(k=k, seed=seed, featuresCol="features").fit(vec).summary.trainingCost)) for k in ks]
    vec.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def silhouette(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3,
               seed: int = 42, **options: str) -> DataFrame:
    """Mean silhouette of the KMeans labels (squared Euclidean, ``ClusteringEvaluator``)."""
    _, out, _, _ = segmentation_pipeline(df, numeric, categorical, k, seed, **options)
    s = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette").evaluate(out)
    return df.sparkSession.createDataFrame([(k, float(s))], "k int, silhouette double")


def cluster_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3,
                    seed: int = 42, **options: str) -> DataFrame:
    """Cluster size and mean of each numeric feature (original units) per cluster."""
    _, out, _, _ = segmentation_pipeline(df, numeric, categorical, k, seed, **options)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                      *[r4(F.avg(col(c))).alias(c) for c in numeric])


def cluster_centers(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3,
                    seed: int = 42, scaling: str = "standard", **options: str) -> DataFrame:
    """KMeans centres mapped back to original units (one row per cluster, k rows)."""
    model, _, feats, enc = segmentation_pipeline(df, numeric, categorical, k, seed, scaling=scaling, **options)
    if scaling == "robust":
        st = wide_quantiles(exact_quantiles(enc, feats, [0.25, 0.5, 0.75]), ["column"], {0.25: "a", 0.5: "m", 0.75: "c"})
        st = st.select("column", "m", (F.col("c") - F.col("a")).alias("s"))
    elif scaling == "minmax":
        st = tall_agg(enc, feats, lambda c: {"m": F.min(col(c)), "s": F.max(col(c)) - F.min(col(c))}, ["m", "s"])
    else:
        st = tall_agg(enc, feats, lambda c: {"m": F.avg(col(c)), "s": F.stddev_pop(col(c))}, ["m", "s"])
    ms = {r["column"]: (r["m"], r["s"] or 0.0) for r in st.collect()}  # one row per feature
    rows = []
    for j, center in enumerate(model.clusterCenters()):
        rows.append((j, *[float(center[i] * ms[f][1] + ms[f][0]) for i, f in enumerate(feats)]))
    schema = "cluster int, " + ", ".join(f"`{f}` double" for f in feats)
    return df.sparkSession.createDataFrame(rows, schema)


def cluster_projection(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 3,
                       seed: int = 42, **options: str) -> DataFrame:
    """PC1, PC2 of the scaled features (largest loading positive) with each row's cluster and the
    variance explained."""
    _, out, _, _ = segmentation_pipeline(df, numeric, categorical, k, seed, **options)
    p = _fit(PCA(k=2, inputCol="features", outputCol="pcs"), out)
    ev = [float(x) for x in p.explainedVariance.toArray()]
    pc = p.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    return p.transform(out).select(*[(vector_to_array("pcs")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(2)],
                                   "cluster", F.lit(ev[0]).alias("pc1_variance"), F.lit(ev[1]).alias("pc2_variance"))
