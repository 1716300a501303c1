"""Shared plumbing of the corpus operators: input tables, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local applications that have no shared one, as in tests.
_OWN: dict[str, str] = {}
#: Applications whose scratch folder is marked to be deleted when they end.
_MARKED: set[str] = set()
#: Python gets whole texts in batches of about this many bytes, so that a worker's memory is bounded.
BATCH_BYTES = 2 << 20
#: Paths of the tables that are materialized inside last_only(), innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in local mode.

    On a cluster it has to be set: a folder of the driver's machine would be another one on each executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that is deleted when it ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/lodestrata/{app}"
    if app not in _MARKED:
        fs, p = _hadoop(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(app)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Actions inside hand Python batches of about BATCH_BYTES; the session's own setting is put back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def last_only(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), materialized; the tables that were materialized on the way are deleted once it is written."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        out = materialize(make(), name)
    finally:
        _SCOPES.pop()
    for path in made[:-1]:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)
    if _SCOPES:
        _SCOPES[-1].append(made[-1])
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([stem], (f"{stem}{k}" for k in itertools.count(1))) if n.lower() not in taken)


#: Keys of rows of files have so many bits for the row; a table of at most so many files is broadcast.
ROW_BITS, MOST_FILES = 40, 1 << 20


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a long that no other row has and that is the same in every scan, and the name of that column.

    Where every row of df stems from another row of a file, which is counted, its key is the number of the file and the row's place
    in it, and nothing is copied. Other tables (a file that is read twice, exploded rows, rows in memory) are written down once
    with a number.
    """
    name, spark = unused(df, "_key"), df.sparkSession
    try:
        places = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return materialize(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name
    shared = places.groupBy("file", "place").agg(F.count("*").alias("n")).where("n > 1 or file is null or place is null")
    files = materialize(places.groupBy("file").agg(F.max("place").alias("last")).coalesce(1).withColumn("number", F.monotonically_increasing_id()), "files")
    if not shared.isEmpty() or not files.where((F.col("number") >= MOST_FILES) | (F.col("last") >= 1 << ROW_BITS)).isEmpty():
        return materialize(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name
    file, number = unused(df, "_file"), unused(df, "_number")
    keyed = df.withColumns({name: F.col("_metadata.row_index"), file: F.col("_metadata.file_path")})
    keyed = keyed.join(F.broadcast(files.select(F.col("file").alias(file), F.col("number").alias(number))), file)
    return keyed.withColumn(name, F.col(number) * F.lit(1 << ROW_BITS) + F.col(name)).select(*(F.col(f"`{c}`") for c in df.columns), name), name


def tidy(run):
    """run over batches, giving what its allocators have kept back to the system at the end: workers are used again by later stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back themselves
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def merge(df: DataFrame) -> DataFrame:
    """df as a side of a sort-merge join: for sides that grow with the input, so that a plan is the same at every size."""
    return df.hint("merge")


SALTS = 16


def joined_back(df: DataFrame, keys: list[str], by: str, partial: dict[str, Column], final: dict[str, Column], where: str = "true") -> DataFrame:
    """df with aggregates of its groups, of the groups that meet `where`; the rows of one group are dealt to SALTS tasks.

    partial: aggregates over rows, final: over the partial ones. A group's row is copied once for each of its salts that
    occur, so the joined side never has more rows than df, and no key brings all its rows to one task.
    """
    salt = unused(df, "_salt")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*keys, salt).agg(*(c.alias(n) for n, c in partial.items()))
    whole = part.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()), F.collect_list(salt).alias("_salts")).where(where)
    spread = whole.select(*keys, *final, F.explode("_salts").alias(salt))
    return salted.join(merge(spread), [*keys, salt]).drop(salt)


class Bloom:
    """A Bloom filter of longs (a null is one of them) with at most MOST_BITS bits: past its capacity it lets more pass, never less."""

    MOST_BITS = 1 << 27

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, ids: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (ids if isinstance(ids, np.ndarray) else np.asarray(ids.fill_null(-(1 << 63)), np.int64)).view(np.uint64)
        from lodestrata.llm.words import mix

        h = mix(x ^ np.uint64(0x2545F4914F6CDD1D))
        m = np.uint64(self.bits - 1)
        return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)

    def add(self, ids: pa.Array) -> None:
        for p in self.places(ids):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def may_hold(self, ids: pa.Array | np.ndarray) -> np.ndarray:
        a, b = self.places(ids)
        return ((self.data[a >> 3] >> (a & 7)) & (self.data[b >> 3] >> (b & 7)) & 1).astype(bool)


def bloom_of(df: DataFrame, column: str):
    """A broadcast Bloom filter of a column of longs: a fixed size at most, gathered from 16 partial ones."""
    bits = min(Bloom.MOST_BITS, max(1 << 16, 1 << int(12 * df.count()).bit_length()))

    def part(batches):
        held = Bloom(bits)
        for batch in batches:
            held.add(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([held.data.tobytes()], pa.binary())], ["bits"])

    whole = Bloom(bits)
    for r in df.select(column).coalesce(16).mapInArrow(part, "bits binary").toLocalIterator():
        whole.data |= np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole)


def crc_mod(column: str, divisor: int):
    """crc32(id as text) mod divisor: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_slices(column: pa.Array, max_bytes: int = 512 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about max_bytes (one longer text makes a run of its own).

    Yields (first row, end row, bytes of the run, len+1 offsets into them). A null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
