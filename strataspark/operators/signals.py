"""Windows over sampled signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import ready


def window_bounds(n: Column, rate: Column, window_s: float, overlap_s: float) -> Column:
    """Array of (window_index, start, end, pad) in samples: sizes round half to even, the last window is padded, none starts once
    one has reached the end. An empty signal has none."""
    size = F.greatest(F.bround(rate * window_s), F.lit(1)).cast("long")
    hop = F.greatest(F.bround(rate * (window_s - overlap_s)).cast("long"), F.lit(1).cast("long"))
    last = F.greatest(F.ceil((n - size) / hop), F.lit(0)).cast("long")
    at = lambda i: F.struct(i.cast("int").alias("window_index"), (i * hop).alias("start"), F.least(i * hop + size, n.cast("long")).alias("end"), F.greatest(i * hop + size - n, F.lit(0)).cast("long").alias("pad"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), at))


def windows(df: DataFrame, n: str, rate: str, window_s: float, overlap_s: float = 0.0) -> DataFrame:
    """One row for each window, with its seconds."""
    out = df.withColumn("__w", F.explode(window_bounds(F.col(n), F.col(rate), window_s, overlap_s))).select("*", "__w.*").drop("__w")
    return out.withColumn("start_seconds", F.col("start") / F.col(rate)).withColumn("end_seconds", F.col("end") / F.col(rate))


def cut_samples(df: DataFrame, wave: str, rate: str, window_s: float, overlap_s: float = 0.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """The windows with their samples, the last filled up with zeros, or with normal noise of a deviation (0.005 is usual) that
    follows from the seed, the file's size and the window."""
    out = windows(df.withColumn("__size", F.size(wave)), "__size", rate, window_s, overlap_s)
    part = F.slice(F.col(wave), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    fill = F.array_repeat(F.lit(0.0).cast("float"), F.col("pad").cast("int"))
    if noise:
        # two even draws make a normal one
        even = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), "__size", "window_index", i, F.lit(k)), F.lit(1 << 52)) + 1) / float(1 << 52)
        fill = F.transform(fill, lambda _, i: (F.sqrt(-2 * F.log(even(i, 0))) * F.cos(even(i, 1) * 6.283185307179586) * noise).cast("float"))
    return out.withColumn("samples", F.concat(part, fill)).drop(wave, "__size")


def resampled(df: DataFrame, wave: str, rate: str, target: int) -> DataFrame:
    """Linear resampling to another rate: positions are spread evenly, ends excluded."""
    ready(df.sparkSession)
    schema = df.drop("samples").schema.add("samples", T.ArrayType(T.FloatType()))

    def run(batches):
        for b in batches:
            w, r = b.column(b.schema.get_field_index(wave)), b.column(b.schema.get_field_index(rate)).to_pylist()
            out = []
            for x, hz in zip(w.to_pylist(), r, strict=True):
                if not x or not hz or hz == target:
                    out.append(x or [])
                    continue
                n = max(1, round(len(x) * target / hz))
                out.append(np.interp(np.linspace(0, 1, n, endpoint=False), np.linspace(0, 1, len(x), endpoint=False), x).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], schema.names)

    return df.drop("samples").mapInArrow(run, schema)


def encoded(df: DataFrame, encoder, fields: list[str], out: str = "embedding") -> DataFrame:
    """df with an embedding and an error text, by encoder(list of field tuples) -> list of vectors. A batch that fails is tried row
    by row, so that one bad row costs no other."""
    ready(df.sparkSession)
    schema = df.drop(out, "error").schema.add(out, T.ArrayType(T.FloatType())).add("error", "string")

    def run(batches):
        for b in batches:
            rows = list(zip(*[b.column(b.schema.get_field_index(f)).to_pylist() for f in fields], strict=True))
            try:
                got = [(list(map(float, v)), None) for v in encoder(rows)] if rows else []
                if len(got) != len(rows):
                    raise ValueError("an encoder gives a vector for each row")
            except Exception:
                got = []
                for r in rows:
                    try:
                        got.append((list(map(float, encoder([r])[0])), None))
                    except Exception as e:  # its text is the row's result
                        got.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v for v, _ in got], pa.list_(pa.float32())), pa.array([e for _, e in got], pa.string())], schema.names)

    return df.drop(out, "error").mapInArrow(run, schema)


# ---- encoders


@dataclass(frozen=True)
class Backend:
    """What an audio encoder works on: whole files, or windows of a length."""

    name: str
    scope: str
    sample_rate_hz: int
    window_seconds: float | None = None
    overlap_seconds: float | None = None


#: Encoders by name, and how they take signals.
BACKENDS = {
    "wav2vec2": Backend("wav2vec2", "file", 16000),
    "birdnet": Backend("birdnet", "window", 48000, 3.0, 0.0),
    "perch": Backend("perch", "window", 32000, 5.0, 0.0),
}


def backend(name: str, more: dict[str, Backend] | None = None) -> Backend:
    """A backend by its name, of those known and of more; an unknown one is an error."""
    return {**BACKENDS, **(more or {})}[name]


def matrix_of(encoded, rows: int) -> np.ndarray:
    """An encoder's output as a table of vectors, one for each of so many rows."""
    m = np.asarray(encoded, np.float32)
    if m.ndim < 2:
        m = m.reshape(1 if m.ndim == 0 or rows == 1 else rows, -1)
    m = m.reshape(len(m), -1)
    if len(m) != rows:
        raise ValueError(f"{len(m)} vectors for {rows} rows")
    return m


def encoded_files(df: DataFrame, encode: Callable[[str], list[dict]], path_col: str) -> DataFrame:
    """For each file the rows that an encoder gives for it, which may be none: df with window_index (counted from 0), start_seconds,
    end_seconds and embedding; or one row with an error. encode(path) -> dicts with embedding and maybe start and end."""
    ready(df.sparkSession)
    fields = [("window_index", "int"), ("start_seconds", "double"), ("end_seconds", "double"), ("embedding", "array<float>"), ("error", "string")]
    base = df.drop(*[n for n, _ in fields])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"{n} {t}" for n, t in fields])

    def run(batches):
        for b in batches:
            take, out = [], []
            for i, path in enumerate(b.column(b.schema.get_field_index(path_col)).to_pylist()):
                try:
                    got = [(k, r.get("start"), r.get("end"), [float(x) for x in r["embedding"]], None) for k, r in enumerate(encode(path))]
                except Exception as e:  # its text is the file's result
                    got = [(None, None, None, None, f"{type(e).__name__}: {e}")]
                take += [i] * len(got)
                out += got
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.string()]
            kept = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[j] for r in out], k) for j, k in enumerate(kinds))], [*b.schema.names, *[n for n, _ in fields]])

    return base.mapInArrow(run, schema)


def built(files: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], key: str = "audio_id", batches: int = 8, retry_failed: bool = True) -> DataFrame:
    """Encodes the files that the store at path doesn't hold yet, batch by batch (by a hash of the key): each batch is a partition of its
    own once it is done, so that what ended early goes on from there. encode(files) gives df with embedding and error. Files that
    failed before are tried again, unless told otherwise. Returns the store, the last row of each key and window."""
    from ..sources.sinks import write_audio_batch
    from ..sources.stores import exists
    from .resume import latest_wins

    spark = files.sparkSession
    left, first = files, 0
    if exists(spark, path):
        have = spark.read.parquet(path)
        first = (have.agg(F.max("batch")).first()[0] or 0) + 1
        left = files.join((have.where("error is null") if retry_failed else have).select(key).distinct(), key, "left_anti")
    for k in range(batches):
        part = left.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        if not part.isEmpty():
            write_audio_batch(encode(part), path, first + k)
    store = spark.read.parquet(path)
    good = store.where("error is null").select(key).distinct().withColumn("__ok", F.lit(True))
    store = store.join(good, key, "left").where("error is null or __ok is null").drop("__ok")
    return latest_wins(store, [key, "window_index"] if "window_index" in store.columns else [key], ["batch"])
