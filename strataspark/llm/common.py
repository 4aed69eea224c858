"""What the corpus operators share: reading tables, Arrow maps that keep columns, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of an Arrow batch: whole texts are long, and what a Python worker holds is a batch.
BATCH, BATCH_BYTES = 1000, 4_000_000

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver's script was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([*parts, ROOT])
    # workers give freed memory back, rather than each keep its largest batch's
    for k, v in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1000000"), ("MALLOC_MMAP_THRESHOLD_", "262144")):
        env.setdefault(k, v)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a temporary one if all is one process, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="strata_")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def cut(df: DataFrame, label: str, slim: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: the plan behind it is not run twice, and a lost executor
    costs only a reread. slim: rows of a few numbers, made with little work, as eight partitions become one task and file."""
    spark = df.sparkSession
    if slim:
        df = df.coalesce(max(1, parts(spark) // 8))
    path = f"{shared_dir(spark)}/strata/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables of cut() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_strata_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_file(spark: SparkSession, label: str, content: bytes) -> str:
    """Writes a file to the shared folder and has Spark bring it to every executor; what SparkFiles.get() takes there."""
    name = f"{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strata/files/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extend(df: DataFrame, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with more columns, made per Arrow batch by make()(batch). Columns of df with the new names are replaced."""
    ready(df.sparkSession)
    base = df.drop(*[n for n, _ in fields])
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(f(b), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names)

    return base.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(b: pa.RecordBatch, col: str) -> pa.Array:
    return b.column(b.schema.get_field_index(col))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up until they hold so many bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def texts(b: pa.RecordBatch, col: str) -> list[str]:
    return ["" if x is None else x for x in column(b, col).to_pylist()]


def crc_rest(col: str, mod: int):
    """crc32(id as text) mod m; null ids count as not held out."""
    return F.crc32(F.col(col).cast("string")) % F.lit(mod)


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer: in STRATA_TOKENIZERS, or from the installed vocabulary package."""
    if d := os.environ.get("STRATA_TOKENIZERS"):
        return os.path.join(d, name)
    import public_tokenizers

    return public_tokenizers.path(name)
