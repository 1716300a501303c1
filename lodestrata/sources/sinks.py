"""Writers: Parquet tables with a manifest beside them, CSV, JSON lines, and resumable task tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.documents import put_text, table_digest, write_manifest

__all__ = ["append_json", "pending", "cached", "format_value", "values_latex", "write_coverage", "write_csv", "write_checkpoint", "write_stable", "write_tables", "write_manifest"]


def write_tables(folder: str, tables: dict[str, DataFrame], summary: dict[str, Any] | None = None, metadata: dict[str, dict[str, Any]] | None = None) -> dict[str, str]:
    """Every table as Parquet below folder, column metadata kept in its schema, and summary.json; digests by name.

    Spark's committer makes each table appear whole.
    """
    digests = {}
    for name, df in tables.items():
        for column, notes in (metadata or {}).get(name, {}).items():
            df = df.withColumn(column, F.col(column).alias(column, metadata=notes))
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        digests[name] = table_digest(df.sparkSession.read.parquet(f"{folder}/{name}"), df.columns)
    if summary is not None:
        put_text(f"{folder}/summary.json", json.dumps(summary | {"digests": digests}, sort_keys=True, indent=1))
    return digests


def write_stable(df: DataFrame, path: str, key: list[str]) -> None:
    """One file in the order of a complete key, for small published tables."""
    df.coalesce(1).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_coverage(df: DataFrame, folder: str, columns: list[str], summary: dict[str, Any]) -> None:
    """The coverage table as CSV in a fixed order of columns, and its summary as a YAML document of scalars."""
    write_csv(df, f"{folder}/coverage", columns)
    lines = [(f"{k}: {json.dumps(v)}",) for k, v in sorted(summary.items())]
    df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def cached(spark: SparkSession, path: str, identity: str, build) -> DataFrame:
    """The table at path if it was made under this identity; built and written if there is none; a different identity is an error.

    build: a function without arguments that gives the DataFrame. The identity is a column of the written table, so it appears
    with the rows or not at all.
    """
    from pyspark.errors import AnalysisException

    from lodestrata.sources.contracts import ContractError

    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        build().withColumn("_identity", F.lit(identity)).write.parquet(path)
        held = spark.read.parquet(path)
    if not held.where(F.col("_identity") != identity).isEmpty():
        raise ContractError(f"{path} was made under another identity")
    return held.drop("_identity")


def format_value(value: Any, precision: int = 6):
    """A column of numbers as text with a fixed number of decimals and no separators; a null is shown as a dash."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.format_string(f"%.{precision}f", c.cast("double")), F.lit("--"))


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines added to what is there."""
    df.write.mode("append").json(path)


def write_checkpoint(results: DataFrame, path: str, key: list[str]) -> None:
    """Add finished tasks to a table partitioned by the first part of their key."""
    results.write.mode("append").partitionBy(key[0]).parquet(path)


def pending(tasks: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Tasks without a row in the checkpoint table."""
    from pyspark.errors import AnalysisException

    try:
        done = tasks.sparkSession.read.parquet(path).select(*key)
    except AnalysisException:
        return tasks
    return tasks.join(done, key, "left_anti")


def values_latex(values: DataFrame, precision: int = 6) -> str:
    """Macros of (key, value) scalars, one a line, keys unique; a null is shown as a dash."""
    rows = values.orderBy("key").collect()
    keys = [r["key"] for r in rows]
    if len(set(keys)) != len(keys):
        raise ValueError("a key occurs twice")
    return "\n".join(rf"\newcommand{{\{k}}}{{{'--' if r['value'] is None else f'{r["value"]:.{precision}f}'}}}" for k, r in zip(keys, rows, strict=True))
