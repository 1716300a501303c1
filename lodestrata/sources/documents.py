"""Parameter documents, manifests and digests: what the driver reads besides tables."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.contracts import ContractError

#: The fields that every manifest must have.
MANIFEST_FIELDS = ("schema_version", "artifact_id", "kind", "created_by", "inputs", "parameters", "rows", "columns", "files", "sha256", "identity", "status")


def typed(cls: type, values: dict[str, Any]):
    """A frozen dataclass from a mapping; unknown and missing keys are errors, nested dataclasses and tuples of them are built too."""
    fields = {f.name: f for f in dataclasses.fields(cls)}
    extra = set(values) - set(fields)
    if extra:
        raise ContractError(f"{cls.__name__}: unknown {sorted(extra)}")
    out = {}
    for name, f in fields.items():
        if name not in values:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise ContractError(f"{cls.__name__}: {name} is missing")
            continue
        v = values[name]
        out[name] = typed(f.type, v) if dataclasses.is_dataclass(f.type) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return cls(**out)


@dataclasses.dataclass(frozen=True)
class DistanceSpec:
    """A registered distance between clouds."""

    distance_id: str
    family: str
    ground: str = "euclidean"
    exponent: float = 1.0
    estimator: str = "v_statistic"
    kernel: str = "energy"
    normalization: str = "unhalved"
    bandwidth: float | None = None

    def __post_init__(self):
        for value, known in ((self.family, ("energy", "mmd", "wasserstein")), (self.ground, ("euclidean", "cosine", "angular")), (self.estimator, ("v_statistic", "u_statistic", "balanced_wasserstein_1", "balanced_wasserstein_2")), (self.kernel, ("linear", "energy", "rbf")), (self.normalization, ("unhalved", "halved", "rooted"))):
            if value not in known:
                raise ContractError(f"{value} is not one of {known}")
        if not 0 < self.exponent < 2 and self.family == "energy":
            raise ContractError("an energy exponent lies between 0 and 2")


@dataclasses.dataclass(frozen=True)
class ProjectionSpec:
    """A registered projection of clouds on their peers."""

    arm_id: str
    geometry: str
    feasible_set: str = "simplex_nonnegative"

    def __post_init__(self):
        if self.geometry not in ("energy", "mmd", "wasserstein") or self.feasible_set not in ("simplex_nonnegative", "affine_signed", "free_signed", "prescribed_source_weights"):
            raise ContractError("unknown geometry or feasible set")


def uri_of(path: str) -> str:
    """A path with its file system: local where none is named."""
    if path.startswith("file:"):
        return "file://" + path.removeprefix("file:").removeprefix("//")
    return path if "://" in path else Path(path).absolute().as_uri()


def get_text(path: str) -> str:
    fs, at = pafs.FileSystem.from_uri(uri_of(path))
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def put_text(path: str, text: str) -> None:
    """text at path, written under another name and renamed: there at once or not at all."""
    fs, at = pafs.FileSystem.from_uri(uri_of(path))
    fs.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    held = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(held) as f:
        f.write(text.encode())
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_file(at)
    fs.move(held, at)


def parameters(path: str) -> dict[str, Any]:
    """A YAML or JSON document, of any file system."""
    text = get_text(path)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def write_manifest(path: str, manifest: dict[str, Any]) -> None:
    """Checked, with sorted keys, and in place at once or not at all."""
    check_manifest(manifest)
    put_text(path, json.dumps(manifest, sort_keys=True, indent=1))


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 by name of the files below folder that are not Spark's own marks, hashed where they are read: an artifact's list of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return {r["name"]: r["digest"] for r in files.where("not name rlike '^[_.]'").collect()}


def check_manifest(manifest: dict[str, Any]) -> dict[str, Any]:
    missing = [f for f in MANIFEST_FIELDS if f not in manifest]
    if missing:
        raise ContractError(f"manifest lacks {missing}")
    for name, digest in manifest["files"].items():
        if len(digest) != 64 or name.startswith("/") or ".." in name.split("/"):
            raise ContractError(f"manifest: bad entry {name}")
    return manifest


def check_inputs(spark: SparkSession, folder: str, manifest: dict[str, Any]) -> DataFrame:
    """(name, ok) of the files of a manifest by their SHA-256, hashed where they are read."""
    check_manifest(manifest)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    want = spark.createDataFrame([(os.path.basename(k), v) for k, v in manifest["files"].items()], "name string, want string")
    return want.join(files, "name", "left").select("name", (F.coalesce(F.col("found"), F.lit("")) == F.col("want")).alias("ok"))


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of Parquet files."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).count()


def table_digest(df: DataFrame, columns: list[str]) -> str:
    """A digest of the rows that is free of their order and encoding: sums of two 64-bit row hashes, and the count."""
    h = lambda salt: F.sum(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns), F.lit(salt)).cast("decimal(38,0)"))
    r = df.agg(h("a").alias("a"), h("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{columns}|{r['a']}|{r['b']}|{r['n']}".encode()).hexdigest()
