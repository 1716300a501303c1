"""Refusals and small cases of the operators behind the formation, history and manifest queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import arrays
from lodestrata.operators import fields, simulation, spatial
from lodestrata.sources import documents, tables
from lodestrata.sources.contracts import ContractError


def test_histories_run_and_leave_the_domain(spark):
    m = spark.createDataFrame([("a", 2.0)], "market string, size double")
    rows = simulation.histories(m, 3).orderBy("history", "date").collect()
    assert len(rows) == 24 and [r["level"] for r in rows[:3]] == [-2.0, -4.0, -6.0] and [r["news"] for r in rows[-3:]] == [2.0, 2.0, 2.0]
    with pytest.raises(ContractError):
        simulation.histories(m, 3, floor=-5.0)
    assert simulation.histories(m.limit(0)).count() == 0


def test_paths_of_economies_are_seeded_by_name(spark):
    rows = [(e, f, a, 1.0 + 0.1 * f + 0.05 * a) for e in ("x", "y") for f in range(2) for a in range(2)]
    levels = spark.createDataFrame(rows, "economy string, firm int, activity int, level double")
    key = ["economy", "period", "firm", "activity"]
    one, two = ([r["intensity"] for r in simulation.simulate(df, 2).orderBy(*key).collect()] for df in (levels, levels.repartition(3)))
    assert one == two and len(one) == 16 and one[:8] != one[8:]
    still = simulation.simulate(levels, 2, spread=0.0).where("period = 1").groupBy("economy", "firm").agg(F.sum("intensity").alias("q"))
    got = {(r["economy"], r["firm"]): r for r in simulation.responses(levels, 2).collect()}
    for r in still.collect():
        assert got[r["economy"], r["firm"]]["intensity"] == pytest.approx(r["q"]) and got[r["economy"], r["firm"]]["staged"]


def test_free_support_needs_clouds_of_one_size(spark):
    rows = [("g", "a", 0, [0.0]), ("g", "a", 1, [10.0]), ("g", "b", 0, [12.0]), ("g", "b", 1, [2.0])]
    c = spark.createDataFrame(rows, "group string, item string, key int, v array<double>")
    assert sorted(r["point"][0] for r in fields.free_support_barycentres(c).collect()) == [1.0, 11.0]
    with pytest.raises(Exception, match="differ in rows"):
        fields.free_support_barycentres(c.where("not (item = 'b' and key = 1)")).collect()


def test_instruments_of_a_field_without_equal_rows_have_full_rank(spark):
    rows = [("a", "b", 0.5), ("b", "a", 1.0), ("b", "c", 2.0), ("c", "a", 0.25), ("c", "b", 3.0)]
    m = spatial.instrument_moments(spark.createDataFrame(rows, "target string, candidate string, weight double")).first()
    w = np.array([[0, 0.5, 0], [1, 0, 2], [0.25, 3, 0]])
    a = w @ np.ones(3)
    assert (m["aa"], m["ab"], m["bb"]) == pytest.approx((a @ a, a @ (w @ a), (w @ a) @ (w @ a))) and spatial.instrument_rank(m) == 3


def test_numbers_worked_out_once_a_row(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],)], "v array<double>")
    assert [list(r[0]) for r in df.select(arrays.unit("v")).collect()] == [[0.6, 0.8], [0.0, 1.0]]
    assert [list(r[0]) for r in df.select(arrays.scaled("v", F.element_at("v", 2))).collect()] == [[12.0, 16.0], [0.0, 4.0]]
    with pytest.raises(Exception, match="zero or non-finite"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(arrays.unit("v")).collect()


def test_texts_appear_whole_and_are_replaced(tmp_path):
    path = f"file://{tmp_path}/deep/er/x.json"
    for text in ('{"a": 1}', '{"a": 2}'):
        documents.put_text(path, text)
    assert documents.parameters(path) == documents.parameters(str(tmp_path / "deep/er/x.json")) == {"a": 2}
    assert [p.name for p in (tmp_path / "deep/er").iterdir()] == ["x.json"] and documents.uri_of("file:/a/b") == "file:///a/b"


def test_matrices_in_blocks_of_rows(spark, tmp_path):
    rows = [(0, [0, 1], [2], [1.5]), (1, [0, 0, 2], [0, 1], [2.0, 3.0])]
    spark.createDataFrame(rows, "start long, indptr array<int>, indices array<int>, data array<double>").write.parquet(str(tmp_path / "m"))
    assert {r["row"]: r["weights"] for r in tables.sparse_rows(spark, str(tmp_path / "m")).collect()} == {0: {2: 1.5}, 1: {}, 2: {0: 2.0, 1: 3.0}}
