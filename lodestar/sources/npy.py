"""The .npy format as a Spark data source: rows (file, row, values), numeric 1-D and 2-D arrays."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str, dtype: str | None = None) -> DataFrame:
    """(path, row, values): each first-axis entry of each file, row-major whatever its order in the file.

    dtype, where given, must equal the file's, or the read fails. Of a whole-number or
    boolean dtype, values are array<long>; else they are array<double>, and the read fails
    at a whole number that no double or long holds. An empty array has no rows.
    """
    import pandas as pd

    whole = dtype is not None and np.dtype(dtype).kind in "iub"

    def load(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if dtype and a.dtype != np.dtype(dtype):
                    raise ValueError(f"{p} holds {a.dtype}, not {dtype}")
                if a.dtype.kind not in "fiub" or a.ndim not in (1, 2):
                    raise ValueError(f"{p}: {a.dtype} of {a.ndim} dimensions is not supported")
                if not len(a):
                    continue
                rows = a.reshape(len(a), a.size // len(a)).astype(np.int64 if whole else float)
                if a.dtype.kind in "iu" and a.size:
                    least, most = (-(1 << 63), (1 << 63) - 1) if whole else (-(1 << 53), 1 << 53)
                    if int(a.min()) < least or int(a.max()) > most:
                        raise ValueError(f"{p} holds whole numbers that values cannot hold")
                yield pd.DataFrame({"path": p, "row": range(len(a)), "values": list(rows)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(load, f"path string, row long, values array<{'long' if whole else 'double'}>")


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """(k, center): the rows of one 2-D .npy file; several files fail."""
    rows = read_npy(spark, path)
    if rows.select("path").distinct().count() > 1:
        raise ValueError(f"{path} names more than one codebook")
    return rows.select(F.col("row").alias("k"), F.col("values").alias("center"))


def npy_bytes(values: list[list[float]], dtype: str = "<f4") -> bytes:
    """One array as the bytes of a .npy file of format 1.0."""
    out = io.BytesIO()
    np.save(out, np.array(values, np.dtype(dtype)))
    return out.getvalue()


def to_npy(df: DataFrame, group: str, order: str, values: str, dtype: str = "<f4") -> DataFrame:
    """(group, content): the rows of each group, in ``order``, as one .npy file's bytes; for binary sinks. One file is one task's."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    def pack(table: pa.Table) -> pa.Table:
        rows = table.take(pa.compute.sort_indices(table.column("order")))
        return pa.table({"group": rows.column("group").slice(0, 1), "content": pa.array([npy_bytes(rows.column("values").to_pylist(), dtype)], pa.binary())})

    rows = df.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(values).alias("values"))
    return rows.groupBy("group").applyInArrow(pack, f"group {df.schema[group].dataType.simpleString()}, content binary").withColumnRenamed("group", group)
