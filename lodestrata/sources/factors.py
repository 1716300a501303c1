"""Factor files: a ZIP with one CSV member, a header somewhere above daily rows, percent values."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.contracts import ContractError, none, require, unique

#: The columns of each factor model, and the sentinels that files use for missing values.
MODELS = {
    "ff3": ["MKT_RF", "SMB", "HML", "RF"],
    "ff3_mom": ["MKT_RF", "SMB", "HML", "RF", "MOM"],
    "ff5": ["MKT_RF", "SMB", "HML", "RMW", "CMA", "RF"],
    "ff5_mom": ["MKT_RF", "SMB", "HML", "RMW", "CMA", "RF", "MOM"],
}
MISSING = (-99.99, -999.0)


def read_factors(spark: SparkSession, path: str, header: list[str], names: list[str], sha256: str | None = None) -> DataFrame:
    """(Date, names...) in decimals. header: the columns as the file spells them; only rows dated by 8 digits count.

    A few thousand lines: the archive is opened on the driver, from the bytes that Spark read.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    if sha256 is not None and hashlib.sha256(content).hexdigest() != sha256:
        raise ContractError("the file is not the one declared")
    members = zipfile.ZipFile(io.BytesIO(content))
    if len(members.namelist()) != 1:
        raise ContractError("an archive of one member is expected")
    lines = members.read(members.namelist()[0]).decode("latin-1").splitlines()
    cells = [[c.strip() for c in x.split(",")] for x in lines]
    at = next((k for k, c in enumerate(cells) if c[1:] == header), None)
    if at is None:
        raise ContractError("no header row")
    rows = [(c[0], *(float(x) for x in c[1:])) for c in cells[at + 1 :] if re.fullmatch(r"\d{8}", c[0])]
    df = spark.createDataFrame(rows, "d string, " + ", ".join(f"`{n}` double" for n in names))
    require(df, present=none(F.greatest(*(F.when(F.col(n).isin(*MISSING), 1).otherwise(0) for n in names), F.lit(0)) == 1))
    if [r[0] for r in rows] != sorted({r[0] for r in rows}):
        raise ContractError("dates are not unique and increasing")
    return df.select(F.to_date("d", "yyyyMMdd").alias("Date"), *((F.col(n) / 100).alias(n) for n in names))


def factor_model(base: DataFrame, momentum: DataFrame | None, model: str) -> tuple[DataFrame, dict[str, int]]:
    """The columns of a model; momentum joins one to one, and the dates that each side lost are counted."""
    names = MODELS[model]
    if "MOM" not in names:
        return unique(base, "Date").select("Date", *names), {"base": 0, "momentum": 0}
    a, b = unique(base, "Date"), unique(momentum, "Date")
    lost = {"base": a.join(b, "Date", "left_anti").count(), "momentum": b.join(a, "Date", "left_anti").count()}
    return a.join(b, "Date").select("Date", *names), lost
