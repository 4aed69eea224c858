"""A data source for matrices in .npy files: row_idx and embedding of every row."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rows = int(options.get("rows", 65536))

    def partitions(self):
        import numpy as np

        m = np.load(self.path, mmap_mode="r")
        if m.ndim != 2:
            raise ValueError("a matrix has two dimensions")
        return [Rows(a, min(a + self.rows, len(m))) for a in range(0, len(m), self.rows)]

    def read(self, partition):
        import numpy as np

        m = np.load(self.path, mmap_mode="r")
        for i in range(partition.start, partition.stop):
            yield i, m[i].astype(float).tolist()


class NpySource(DataSource):
    """spark.dataSource.register(NpySource); spark.read.format("npy").load(path)"""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row_idx long, embedding array<float>"

    def reader(self, schema):
        return NpyReader(self.options)
