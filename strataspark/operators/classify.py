"""Samples of several modalities, classification, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import ready

MODALITIES = ["graph", "audio", "language"]


def pattern(flags: dict[str, Column]) -> Column:
    """Names of the modalities present, as graph+audio+language."""
    return F.concat_ws("+", *[F.when(flags[m], F.lit(m)) for m in MODALITIES if m in flags])


def expand(labels: DataFrame, vectors: dict[str, DataFrame], cap: int | None = None) -> DataFrame:
    """Each entity's combinations of its vectors, one of each modality, as concatenated features: sample_id, qid, label_qid,
    modality_pattern, features. vectors: (qid, idx, embedding) by modality. Entities that lack one are left out. The product
    stays within an entity; sample numbers count through all samples in the order of qid and indices, from sums by entity."""
    used = [m for m in MODALITIES if m in vectors]
    out = labels.select("qid", "label_qid")
    for m in used:
        out = out.join(vectors[m].select("qid", F.col("idx").alias(f"{m}_idx"), F.col("embedding").cast("array<double>").alias(f"{m}_vec")), "qid")
    order = [f"{m}_idx" for m in used]
    at = F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1
    out = out.withColumn("__at", at)
    if cap is not None:
        out = out.where(F.col("__at") < max(1, cap))
    sizes = out.groupBy("qid").agg(F.count("*").alias("n"))
    bins = sizes.withColumn("bin", F.substring("qid", 1, 4))
    w = Window.orderBy("bin")  # one row for each prefix
    before_bin = bins.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", (F.sum("n").over(w) - F.col("n")).alias("b"))
    before = bins.join(before_bin, "bin").select("qid", (F.col("b") + F.sum("n").over(Window.partitionBy("bin").orderBy("qid")) - F.col("n")).alias("before"))
    number = (F.col("before") + F.col("__at")).cast("string")
    flags = {m: F.lit(m in used) for m in MODALITIES}
    named = out.join(before, "qid").select(
        F.concat(F.col("qid"), F.lit("__"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)).alias("sample_id"), "qid", "label_qid", *order,
        pattern(flags).alias("modality_pattern"), F.concat(*[F.col(f"{m}_vec") for m in used]).alias("features"),
    )
    return named


def slices(sizes: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Where each modality's part of the concatenated vector stands."""
    out, at = {}, 0
    for m in MODALITIES:
        if m in sizes:
            out[m] = (at, at + sizes[m])
            at += sizes[m]
    if not at:
        raise ValueError("no modality is present")
    return out


def standardized(df: DataFrame, vec: str = "features") -> DataFrame:
    """Mean and population deviation of each position (0 counts as 1), as (pos, mean, scale)."""
    flat = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    s = flat.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    return s.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def class_report(predictions: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """True and false positives, false negatives, precision, recall, F1 and support by label."""
    t = predictions.groupBy(F.col(true).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(true) == F.col(pred)).alias("tp"))
    p = predictions.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    x = t.join(p, "label", "full").select("label", z("support"), z("tp"), z("predicted"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    prec, rec = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return x.select("label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), prec.alias("precision"), rec.alias("recall"), div(2 * prec * rec, prec + rec).alias("f1"))


def overall(report: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Row count, accuracy and macro-F1; the latter over `classes` (label) if given, such as those of training."""
    acc = report.agg(F.sum("support").alias("row_count"), F.when(F.sum("support") > 0, F.sum("tp") / F.sum("support")).otherwise(0.0).alias("accuracy"))
    f1 = report if classes is None else classes.select("label").distinct().join(report, "label", "left")
    return acc.crossJoin(F.broadcast(f1.agg(F.coalesce(F.avg(F.coalesce("f1", F.lit(0.0))), F.lit(0.0)).alias("macro_f1"))))  # one row each


def softmax_regression(df: DataFrame, features: str = "features", label: str = "label_qid", epochs: int = 200, rate: float = 0.05, l2: float = 1e-4) -> tuple[dict, DataFrame]:
    """Full-batch gradient descent on standardized features. Each step is a sum over all rows: tasks send one gradient each, and
    the driver holds the weights only. Returns the model and the trace (epoch, train_loss, train_accuracy), losses before each step."""
    spark = ready(df.sparkSession)
    stats = sorted(standardized(df, features).collect(), key=lambda r: r.pos)
    mean, scale = np.array([r["mean"] for r in stats]), np.array([r["scale"] for r in stats])
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    at = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(0)
    w, b = rng.normal(0, 0.01, (len(mean), len(classes))), np.zeros(len(classes))
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).alias("y")).persist()
    trace = []
    for epoch in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast((w, b))

        def step(batches, shared=shared):
            w, b = shared.value
            total = None
            for pdf in batches:
                if not len(pdf):
                    continue
                x = (np.array(pdf.x.tolist()) - mean) / scale
                y = pdf.y.map(at).to_numpy()
                z = x @ w + b
                e = np.exp(z - z.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                n = np.arange(len(y))
                g = p.copy()
                g[n, y] -= 1
                got = np.concatenate([(x.T @ g).ravel(), g.sum(0), [-np.log(np.clip(p[n, y], 1e-8, None)).sum(), (p.argmax(1) == y).sum(), len(y)]])
                total = got if total is None else total + got
            if total is not None:
                yield pd.DataFrame({"g": [total.tolist()]})

        got = np.sum([r.g for r in rows.mapInPandas(step, "g array<double>").collect()], axis=0)
        n = got[-1]
        gw, gb = got[: w.size].reshape(w.shape) / n + l2 * w, got[w.size : w.size + b.size] / n
        trace.append((epoch, float(got[-3] / n + 0.5 * l2 * (w * w).sum()), float(got[-2] / n)))
        w, b = w - rate * gw, b - rate * gb
    rows.unpersist()
    return {"classes": classes, "weights": w, "bias": b, "mean": mean, "scale": scale}, spark.createDataFrame(trace, "epoch int, train_loss double, train_accuracy double")


def predict(df: DataFrame, model: dict, features: str = "features") -> DataFrame:
    """df with probabilities and predicted_label (the first of the largest)."""
    m = ready(df.sparkSession).sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("predicted_label", T.StringType())])

    def run(batches):
        v = m.value
        for pdf in batches:
            z = ((np.array(pdf[features].tolist()).reshape(len(pdf), -1) - v["mean"]) / v["scale"]) @ v["weights"] + v["bias"] if len(pdf) else np.zeros((0, len(v["classes"])))
            e = np.exp(z - z.max(1, keepdims=True)) if len(pdf) else z
            p = e / e.sum(1, keepdims=True) if len(pdf) else e
            yield pdf.assign(probabilities=p.tolist(), predicted_label=[str(v["classes"][i]) for i in p.argmax(1)] if len(pdf) else [])

    return df.mapInPandas(run, schema)
