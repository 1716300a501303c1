"""The pipeline's stages, each on what its predecessor kept, against plain decisions."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm.common import materialize
from tests.llm import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    return out


def test_stages(stages, spark):
    before, after = stages["language"]
    assert after.columns == before.columns and after.count() > 0.95 * before.count()
    before, after = stages["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {c for i, (n, c) in plain.jaccard(rows, 80, 5).items()}
    assert {r["doc_id"] for r in after.collect()} == want and after.columns == before.columns
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == {i for (i, _), c in zip(rows, plain.contaminated([t for _, t in rows], items), strict=True) if not c[1]}
    before, after = stages["personal_data"]
    text = {r["doc_id"]: r for r in after.collect()}
    assert len(text) == before.count() and after.columns == before.columns
    for r in before.collect():
        found = plain.pii(r["text"])
        assert (text[r["doc_id"]]["text"] == r["text"]) == (not found) and text[r["doc_id"]]["n_chars"] == (len(text[r["doc_id"]]["text"]) if found else r["n_chars"])
        assert not plain.pii(text[r["doc_id"]]["text"])
    before, after = stages["packing"]
    assert after.where("piece = 0").count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_one_of_equal_rows_stays(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "d"))
    for docs in (d, spark.read.parquet(str(tmp_path / "d"))):
        assert sorted(map(str, [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()])) == ["1", "2", "3"]
    assert corpus_pipeline.near_duplicates(spark, d.limit(0), SF).count() == 0


def test_rows_that_share_a_row_of_a_file(spark, tmp_path):
    """Two texts and a null, each twice, by a file that is read twice and by exploded rows: no document is lost, none is doubled."""
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "mail a@b.org now a b c d e", "en", "s", 26), (2, "other words stand here in this text", "en", "s", 35), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    d = spark.read.parquet(path)
    for docs in (spark.read.parquet(path, path), d.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("n"), d.union(d)):
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 2, 3, 3]
        assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()) == [1, 1, 2, 2, 3, 3]
        assert sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.personal_data(spark, docs, SF).collect()) == [(1, "mail [email] now a b c d e")] * 2 + [(2, "other words stand here in this text")] * 2 + [(3, "")] * 2


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def linked(a, b, shingle=5, percent=80):
    a, b = plain.shingle_set(a, shingle), plain.shingle_set(b, shingle)
    return 100 * len(a & b) >= percent * len(a | b)


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """Against brute force: texts of distinct words with more and more words appended, on either side of the threshold."""
    rows = []
    for group in range(12):
        text = [f"g{group}w{i}" for i in range(100)]
        rows += [(10 * group, " ".join(text)), (10 * group + 1, " ".join(text + [f"g{group}x{i}" for i in range(15 + group)]))]
    gone = {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if linked(a[1], b[1])}
    between = {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if linked(a[1], b[1]) and not linked(a[1], b[1], 4, 85)}
    assert between and len(gone) < 12
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()} == {i for i, _ in rows} - gone


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    from tests.llm.test_operators import INTERNAL

    rows = [(i, f"the quick brown fox number {i} jumps over a lazy dog by the river {i * 7} times", "en", "s", 70) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, "mail a@b.org now please and tell the others about it soon", "en", "s", 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in INTERNAL})
    d.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r["_key"] for r in out.select("_key").collect()} == {"x"}, name
    assert corpus_pipeline.packing(spark, docs, SF).where("piece = 0").count() == len(rows)


def test_language_stage_matches_plain(stages, spark):
    """Documents stay whose largest share reaches a third, by the inference written plainly."""
    from lodestrata.llm import langid
    from lodestrata.llm.common import crc_mod

    before, after = stages["language"]
    model = langid.fit(before.where(crc_mod("doc_id", 4) != 2))
    keep = set()
    for r in before.collect():
        text = r["text"] or ""
        if any(c.isalpha() for c in text) and max(plain.language_shares(text, model.log_p, langid.SEGMENT_BYTES, langid.PENALTY, langid.TEMPER, langid.ROUNDS)) >= 1 / 3:
            keep.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == keep


def test_packing_stage_holds_every_token_once(stages):
    before, after = stages["packing"]
    from lodestrata.llm.packing import Encoder

    e = Encoder()
    want = sorted((r["doc_id"], len(e.encode(r["text"] or "")) + 1) for r in before.collect())
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert sorted(got.items()) == want
