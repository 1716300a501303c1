"""NumPy archives (npz): members decoded in tasks, cut to blocks, and sparse matrices by rows; written one archive a group."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.contracts import ContractError

#: Numbers of a member in one row, and rows of a sparse matrix in one batch.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 16, 4096
MEMBERS = "path string, member string, shape array<long>, start long, values array<double>"
SPARSE = "path string, row long, columns array<int>, values array<double>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")


def _members(content: bytes):
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        yield from ((name, z[name]) for name in sorted(z.files))


def npz_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, shape, start, values): every numeric member of every archive in row-major blocks; members of text are an error.

    An archive is decoded in one task, a member at a time, and leaves it in blocks of BLOCK_NUMBERS.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for name, x in _members(content.as_py()):
                    if name == "format":  # the kind of a sparse matrix, the one member of text
                        continue
                    if x.dtype.kind not in "bifu":
                        raise ContractError(f"{file}: {name} is not numeric")
                    flat = x.astype(np.float64).ravel()
                    for lo in range(0, max(len(flat), 1), BLOCK_NUMBERS):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([lo], pa.int64()), pa.array([flat[lo : lo + BLOCK_NUMBERS]], pa.list_(pa.float64()))], names=["path", "member", "shape", "start", "values"])

    return _files(spark, path).mapInArrow(run, MEMBERS)


def npz_sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, columns, values) of matrices kept by compressed rows: members indptr, indices, data and shape, row by row."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held = dict(_members(content.as_py()))
                if not {"indptr", "indices", "data", "shape"} <= set(held):
                    raise ContractError(f"{file}: not a matrix by rows")
                at, columns, data = held["indptr"].astype(np.int64), held["indices"].astype(np.int32), held["data"].astype(np.float64)
                if len(at) != held["shape"][0] + 1 or at[0] != 0 or (np.diff(at) < 0).any() or at[-1] != len(columns) or len(columns) != len(data) or (len(columns) and not 0 <= columns.min() <= columns.max() < held["shape"][1]):
                    raise ContractError(f"{file}: its rows do not fit its shape")
                for lo in range(0, len(at) - 1, BLOCK_ROWS):
                    hi = min(lo + BLOCK_ROWS, len(at) - 1)
                    own = slice(at[lo], at[hi])
                    cuts = pa.array((at[lo : hi + 1] - at[lo]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(v[own])) for v in (columns, data)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * (hi - lo)), pa.array(np.arange(lo, hi)), *lists], names=["path", "row", "columns", "values"])

    return _files(spark, path).mapInArrow(run, SPARSE)


def write_npz_sparse(rows: DataFrame, folder: str, by: str, width: int) -> DataFrame:
    """Write the rows (by, row, columns, values) of each group as one matrix archive below folder: (name, rows), by group.

    Rows of a matrix are numbered from 0 without gaps. A task writes under another name and renames, so an archive appears whole.
    """
    root = folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:") else f"file://{folder}"
    pafs.FileSystem.from_uri(root)[0].create_dir(pafs.FileSystem.from_uri(root)[1], recursive=True)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        if list(pdf["row"]) != list(range(len(pdf))):
            raise ContractError(f"rows of {key[0]} are not numbered from 0")
        sizes = [len(c) for c in pdf["columns"]]
        out = io.BytesIO()
        joined = lambda c, kind: np.concatenate([np.asarray(v, kind) for v in pdf[c]]) if sum(sizes) else np.zeros(0, kind)
        np.savez(out, indptr=np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), indices=joined("columns", np.int32), data=joined("values", np.float64), shape=np.array([len(pdf), width]), format=np.array(b"csr"))
        files, path = pafs.FileSystem.from_uri(root)
        name = f"{key[0]}.npz"
        with files.open_output_stream(f"{path}/_{name}", compression=None) as f:
            f.write(out.getvalue())
        files.move(f"{path}/_{name}", f"{path}/{name}")
        return pd.DataFrame({"name": [name], "rows": [len(pdf)]})

    return rows.select(by, "row", "columns", "values").groupBy(by).applyInPandas(write, "name string, rows long")


def sparse_weights(rows: DataFrame) -> DataFrame:
    """(row, weights map<int, double>) of the rows of one matrix, as the sparse operators take them."""
    return rows.select("row", F.map_from_arrays("columns", "values").alias("weights"))
