"""Running totals and exact ranks over whole tables: ranges of the order are tasks, and the totals of ranges are their offsets.

No window holds more than one row for each range, so an order over a hot group, or over the whole table, is never one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.shared import kept

#: Offsets of at most this many (range, group) pairs are broadcast; more are joined by sorting.
BROADCAST_ROWS = 1 << 16


def _free(df: DataFrame, stem: str) -> str:
    taken, k = {c.lower() for c in df.columns}, 0
    while f"{stem}{k}".lower() in taken:
        k += 1
    return f"{stem}{k}"


def sized(df: DataFrame) -> DataFrame:
    """df as the smaller side of a join: to be broadcast behind a count of its rows, beyond that to be sorted."""
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def beside(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """df joined with a table that usually is small."""
    return df.join(sized(other), on)


def running_totals(df: DataFrame, by: list[str], order: list[Column], amounts: dict[str, Column], keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """df with, for each amount (longs, or doubles), its sum over the rows of the same group that come before; groups may hold nulls.

    order has to be total but for rows that are alike. keep writes the sorted table down, since range bounds of two runs may differ.
    """
    group, part = _free(df, "_group"), _free(df, "_part")
    held = df.withColumn(group, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")).withColumns(amounts)
    kinds = {n: "double" if held.schema[n].dataType.simpleString() in ("double", "float") else "long" for n in amounts}
    held = held.withColumns({n: F.col(n).cast(k) for n, k in kinds.items()})
    names = list(amounts)

    def inside(batches):
        """Running sums within the range; one group's last sums are all that is held between batches."""
        number, last, sums = TaskContext.get().partitionId(), None, [0 for _ in names]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, columns = batch.column(group), list(batch.columns)
            first = np.ones(n, bool)
            first[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)), bool)
            first[0] = keys[0].as_py() != last
            starts = np.flatnonzero(first)
            place = np.cumsum(first)  # 0: rows that go on with the group of the batch before
            for k, name in enumerate(names):
                own = np.asarray(batch.column(name).fill_null(0), np.float64 if kinds[name] == "double" else np.int64)
                total = np.cumsum(own)
                base = np.concatenate([np.array([sums[k]], own.dtype), own[starts] - total[starts]])
                before = total - own + base[place]
                columns[batch.schema.get_field_index(name)] = pa.array(before)
                sums[k] = before[-1] + own[-1]
            last = keys[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, number, np.int32))], names=[*batch.schema.names, part])

    sized = {_free(held, f"_own_{k}_"): n for k, n in enumerate(names)}  # the amounts themselves, for the totals of ranges
    before = held.withColumns({s: F.col(n) for s, n in sized.items()})
    schema = before.withColumn(part, F.lit(0)).schema
    table = keep(before.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(inside, schema), "running")
    ahead = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = {n: _free(table, f"_offset_{k}_") for k, n in enumerate(names)}
    totals = table.groupBy(group, part).agg(*(F.sum(s).alias(offset[n]) for s, n in sized.items()))
    totals = totals.withColumns({o: F.coalesce(F.sum(o).over(ahead), F.lit(0)) for o in offset.values()})
    return beside(table, totals, [group, part]).withColumns({n: F.col(n) + F.col(o) for n, o in offset.items()}).drop(group, part, *sized, *offset.values())


def running_maximum(df: DataFrame, order: list[Column], value: Column, name: str, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """df with the largest value so far, this row's included, in a total order of the whole table."""
    part = _free(df, "_part")
    held = df.withColumn(name, value.cast("double"))

    def inside(batches):
        number, top = TaskContext.get().partitionId(), -np.inf
        for batch in batches:
            so_far = np.maximum.accumulate(np.concatenate([[top], np.asarray(batch.column(name).fill_null(-np.inf), np.float64)]))[1:]
            top = so_far[-1] if len(so_far) else top
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(name)] = pa.array(so_far)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, number, np.int32))], names=[*batch.schema.names, part])

    table = keep(held.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(inside, held.withColumn(part, F.lit(0)).schema), "maxima")
    before = _free(table, "_before")
    tops = table.groupBy(part).agg(F.max(name).alias(before)).withColumn(before, F.max(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    return beside(table, tops, [part]).withColumn(name, F.greatest(name, before)).drop(part, before)


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """df with the rank of value, ties averaged, within each group; a null value has no rank and counts for none.

    Equal values are counted before anything is ordered, so a value that a third of the rows hold is one row of the order.
    """
    by, n, before = by or [], _free(df, "_n"), _free(df, "_before")
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(n))
    placed = running_totals(values, by, [F.col(value)], {before: F.col(n)}, keep).select(*by, value, (F.col(before) + (F.col(n) + 1) / 2).alias(name))
    side = {c: _free(df, f"_side_{k}_") for k, c in enumerate([*by, value])}
    match = [F.col(c).eqNullSafe(F.col(s)) for c, s in side.items()]
    return df.join(placed.withColumnsRenamed(side), match, "left").drop(*side.values())
