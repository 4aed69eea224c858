"""Clusterings against labels: contingency, information, silhouette, k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_else, py_strip
from ..plans.staging import ready

METRICS = ["nmi", "homogeneity", "completeness", "v_measure", "purity", "ari", "silhouette"]


def label_of(fields: list[str], sentinel: str = "other") -> Column:
    """The first field that is neither blank nor the sentinel, else the sentinel."""
    return or_else(*[F.nullif(py_strip(f), F.lit(sentinel)) for f in fields], F.lit(sentinel))


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def scores(cells: DataFrame) -> DataFrame:
    """NMI, homogeneity, completeness, V-measure, purity and adjusted Rand index of a contingency table, as one row."""
    pairs = lambda c: c * (c - 1) / 2.0
    rows = cells.groupBy("t").agg(F.sum("n").alias("a"))
    cols = cells.groupBy("p").agg(F.sum("n").alias("b"), F.max("n").alias("top"))
    total = cells.agg(F.sum("n").cast("double").alias("total"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("s_n"))
    entropy = lambda c: F.coalesce(-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))), F.lit(0.0))
    one = F.broadcast(total)  # one row, like what is joined below
    h_t = rows.crossJoin(one).agg(entropy("a").alias("h_t"), F.coalesce(F.sum(pairs(F.col("a"))), F.lit(0.0)).alias("s_a"))
    h_p = cols.crossJoin(one).agg(entropy("b").alias("h_p"), F.coalesce(F.sum(pairs(F.col("b"))), F.lit(0.0)).alias("s_b"), F.sum("top").alias("top"))
    mi = cells.join(rows, "t").join(cols, "p").crossJoin(one).agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))), F.lit(0.0)).alias("mi"))
    x = total.crossJoin(F.broadcast(h_t)).crossJoin(F.broadcast(h_p)).crossJoin(F.broadcast(mi))
    tiny = 1e-12
    no_t, no_p = F.col("h_t") < tiny, F.col("h_p") < tiny
    nmi = F.when(no_t & no_p, 1.0).when(no_t | no_p, 0.0).otherwise(F.col("mi") / F.sqrt(F.col("h_t") * F.col("h_p")))
    hom = F.when(no_t, 1.0).otherwise(F.col("mi") / F.col("h_t"))
    com = F.when(no_p, 1.0).otherwise(F.col("mi") / F.col("h_p"))
    v = F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com))
    expected = F.col("s_a") * F.col("s_b") / pairs(F.col("total"))
    bottom = (F.col("s_a") + F.col("s_b")) / 2 - expected
    ari = F.when(F.col("total") <= 1, 1.0).when(F.abs(bottom) < tiny, F.when(F.abs(F.col("s_n") - expected) < tiny, 1.0).otherwise(0.0)).otherwise((F.col("s_n") - expected) / bottom)
    return x.select(nmi.alias("nmi"), hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"), (F.col("top") / F.col("total")).alias("purity"), ari.alias("ari"))


def silhouette(df: DataFrame, cluster: str, vec: str = "embedding", idx: str = "idx", limit: int = 2000) -> DataFrame:
    """Mean Euclidean silhouette over at most `limit` rows (the operator's sample: the smallest hashes of idx). A row alone in its
    cluster has distance 0 to it; without another cluster the score is 0. What is gathered is bounded by `limit`."""
    sample = df.select(F.col(cluster).cast("string").alias("k"), F.col(vec).cast("array<double>").alias("v"), F.col(idx).alias("i")).orderBy(F.md5(F.col(idx).cast("string")), idx).limit(limit)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.array(pdf.v.tolist())
        k = pdf.k.to_numpy()
        names = np.unique(k)
        if len(names) < 2:
            return pd.DataFrame({"sample_count": [len(x)], "silhouette": [0.0]})
        d = np.sqrt(np.maximum(0, ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))) if len(x) <= 512 else np.array([np.sqrt(((x - r) ** 2).sum(1)) for r in x])
        sums = np.stack([d[:, k == c].sum(1) for c in names], 1)
        size = np.array([(k == c).sum() for c in names])
        own = np.searchsorted(names, k)
        at = np.arange(len(x))
        a = np.where(size[own] > 1, sums[at, own] / np.maximum(1, size[own] - 1), 0.0)
        other = sums / size
        other[at, own] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        return pd.DataFrame({"sample_count": [len(x)], "silhouette": [float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).mean())]})

    ready(df.sparkSession)
    return sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "sample_count long, silhouette double")


def kmeans(df: DataFrame, k: int, vec: str = "embedding", seed: int = 1, max_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """df with `cluster`, by Spark's k-means (parallel k-means++ seeding, Euclidean)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("__x", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="__x", predictionCol="cluster").fit(x)
    return model.transform(x).drop("__x")


def ranks(table: DataFrame, metrics: list[str], name: str = "method", order: str = "idx") -> DataFrame:
    """Of each method: its rank by each metric (highest first, ties by order), the mean of these, and how often it is first."""
    out = table
    for m in metrics:
        out = out.withColumn(f"rank_{m}", F.row_number().over(Window.orderBy(F.desc(m), order)))  # a row for each method
    made = [F.col(f"rank_{m}") for m in metrics]
    total = made[0]
    for c in made[1:]:
        total = total + c
    best = (made[0] == 1).cast("int")
    for c in made[1:]:
        best = best + (c == 1).cast("int")
    return out.select(name, *made, (total / len(metrics)).alias("mean_rank"), best.alias("best_metric_count"))
