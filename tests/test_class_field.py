"""Weights on the others of a class: every pair, whatever arrays the classes are dealt to, and none of them in a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import fields


def plain(rows):
    """(target, candidate, weight) of rows (key, industry, sector), sorted; keys may be missing or have several rows."""
    pairs = []
    for t, f, c in rows:
        size = lambda at, x: sum(r[at] == x for r in rows) if x is not None else 0
        same = (1, f) if size(1, f) > 1 else (2, c) if size(2, c) > 1 else (0, None)
        pairs += [(t, r[0]) for r in rows if None not in (t, r[0]) and r[0] != t and (same[0] == 0 or r[same[0]] == same[1])]
    n = {t: sum(p[0] == t for p in pairs) for t, _ in pairs}
    return sorted((t, k, 1 / n[t]) for t, k in pairs)


ODD = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "y"), (5, "c", None), (5, "a", "x"), (6, None, None), (None, "b", "y"), (7, "d", "y"), (2, "a", "x"), (8, "e", "z"), (8, "e", "z")]


@pytest.mark.parametrize("most", [1 << 11, 2])
@pytest.mark.parametrize("rows", [ODD, [(1, "a", "x")], [(k, str(k % 5) if k % 7 else None, str(k % 2) if k % 3 else None) for k in range(60)]])
def test_class_field_is_every_pair(spark, monkeypatch, most, rows):
    for name in ("FIELD_TARGETS", "FIELD_CANDIDATES", "FIELD_TILE"):
        monkeypatch.setattr(fields, name, most)
    got = fields.class_field(spark.createDataFrame(rows, "ticker long, industry string, sector string")).collect()
    want = plain(rows)
    assert sorted((r["target"], r["candidate"]) for r in got) == [w[:2] for w in want]
    assert [r["weight"] for r in sorted(got)] == pytest.approx([w[2] for w in want])


def test_class_field_shuffles_no_pair(spark, tmp_path):
    u = spark.range(4000).select(F.col("id").alias("ticker"), (F.col("id") % 2).cast("string").alias("industry"), F.lit("s").alias("sector"))
    field = fields.class_field(u, decimals=6)
    plan = field._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode\(tile", plan).start() < plan.index("Exchange")
    field.write.parquet(str(tmp_path / "w"))
    # 1.4 bytes a row of 60,000 keys where all candidates of a target stand together
    assert sum(p.stat().st_size for p in (tmp_path / "w").glob("*.parquet")) < 4000 * 1999 // 2
