"""How plan modules register: a query and, where SQL can express it, the SQL it is compared with.

Floating sums depend on the order of addition, so both sides round to six decimals (and add 0.0, which turns -0.0 into 0.0).
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shared import fresh


class Registry:
    def __init__(self, **common: str):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}
        self.common = common

    def query(self, sql: str | None = None, name: str | None = None, text: tuple[str, ...] = ()):
        """Register the decorated function (spark, sf_dir). In sql, [[x]] stands for x rounded; common tables are WITH clauses.

        Columns named in text (dates and times) are returned as text on both sides, since clients differ in what they make of them.
        """

        def add(f):
            key = name or f.__name__
            self.queries[key] = as_text(f, text) if text else f
            if sql is not None:
                used: list[str] = []

                def need(text: str, own: str = "") -> None:
                    for t, body in self.common.items():
                        if t != own and t not in used and re.search(rf"\b{t}\b", text):
                            need(body, t)
                            used.append(t)

                need(sql)
                body = re.sub(r"\[\[(.+?)\]\]", r"(round(\1, 6) + 0.0)", sql)
                heads = ", ".join(f"{t} AS ({self.common[t]})" for t in used)
                if re.match(r"\s*WITH ", body):
                    body = re.sub(r"\s*WITH ", f"WITH {heads}, " if heads else "WITH ", body, count=1)
                elif heads:
                    body = f"WITH {heads} {body}"
                if text:
                    replaced = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in text)
                    body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
                self.sql[key] = body
            return f

        return add


def as_text(query, columns: tuple[str, ...]):
    @functools.wraps(query)
    def run(spark, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns})

    return run


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to six decimals."""
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)


def stored(df: DataFrame, name: str) -> str:
    """The path of df written as Parquet."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return path
