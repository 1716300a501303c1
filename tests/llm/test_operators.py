"""The corpus operators against plain versions, round trips and held-out accuracy, on small tables with awkward rows."""

import base64
import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, embed_dedup, graph, jaccard, langid, packing, pii, quality, repeats, secrets, warc, words
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words_, n):
    return " ".join(rng.choice(words_) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Rows with near and exact copies, shared passages, nulls, empty and long texts, repeated rows and ids."""
    rng, v = random.Random(1), vocabulary(1)
    passage = prose(rng, v, 70)
    rows = [(i, prose(rng, v, rng.randint(1, 120))) for i in range(40)]
    base = prose(rng, v, 200).split()
    for i in range(40, 60):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(v)
        rows.append((i, " ".join(w)))
    rows += [(60 + i, f"{prose(rng, v, 30)} {passage} {prose(rng, v, 30)}") for i in range(8)]
    rows += [(70, rows[3][1]), (71, rows[3][1].upper()), (72, None), (73, ""), (74, " \t\n"), (75, "one two"), (76, "one two"), (77, prose(rng, v, 20_000)), (78, "é" * 50 + " ünï \x00 cöde"), (79, "same " * 3000)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (6, "another text under an id that is taken"), (80, " odd spaces stay in words")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles_agree_with_regexes(texts):
    raw = pa.array([t for _, t in texts])
    for lo, hi, data, offsets in common.text_slices(raw, 2000):
        for table, find, nul in ((words.SPACED, plain.spaced, True), (words.ALNUM, plain.alnum, False)):
            b, starts, lengths, bounds = words.find_words(data, offsets, table, nul)
            for i in range(lo, hi):
                got = [bytes(b[s : s + n]) for s, n in zip(starts[bounds[i - lo] : bounds[i - lo + 1]], lengths[bounds[i - lo] : bounds[i - lo + 1]], strict=True)]
                assert got == [w.encode() for w in find(texts[i][1])]
    long = np.frombuffer(("x" * 1000 + " " + "x" * 999 + "y").encode(), np.uint8)
    b, s, n, _ = words.find_words(long, np.array([0, len(long)]), words.SPACED)
    assert len(set(words.word_hashes(b, s, n))) == 2


def test_jaccard_matches_plain(spark, docs, texts):
    got = jaccard.jaccard_components(docs).toPandas()
    want = sorted((i if i is not None else -1, n, c if c is not None else -1) for (i, _), (n, c) in zip(texts, plain.jaccard(texts).values(), strict=True))
    assert sorted((int(i) if i == i else -1, int(n), int(c) if c == c else -1) for i, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == want
    assert got.kept.sum() == len({c for _, c in plain.jaccard(texts).values() if c is not None}) + 0 or got.kept.sum() > 0


@pytest.mark.parametrize("hot,block", [(2, 512), (32, 4), (2, 3)])
def test_jaccard_with_hot_lists_and_many_blocks(spark, docs, texts, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(common.Bloom, "MOST_BITS", 1 << 12)  # a filter that is nearly full: more tokens go last, results stay
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    got = jaccard.jaccard_components(docs).where("doc_id is not null").toPandas()
    want = sorted((i, *x) for (i, _), x in zip(texts, plain.jaccard(texts).values(), strict=True) if i is not None)
    assert sorted(zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == want


def test_jaccard_copies_meet_every_pair_that_may_link(spark):
    """Routes of a big group: each pair of an open member and one within reach has one block, and no member goes to a block beyond."""
    rng = random.Random(8)
    members = [(1, 0, k, 4.0, k % 7 if k % 3 == 0 else 1000, k % 3 == 0, rng.random()) for k in range(60)]
    df = spark.createDataFrame(members, "leader long, band int, rep long, fits double, root long, open boolean, far double")
    placed, meet = jaccard.routes(df, 0.15)
    cell = {r.rep: r.cell for r in placed.collect()}
    ways = {(r.cell, r.over): (r.rows, r.columns) for r in meet.collect()}
    for a in members:
        for b in members:
            if a[5] and abs(a[6] - b[6]) <= 0.15:
                assert (cell[a[2]], cell[b[2]]) in ways
    for (x, y), (n, m) in ways.items():
        assert abs(x - y) <= 1
        assert n == -(-sum(a[5] and cell[a[2]] == x for a in members) // 4) and m == -(-sum(cell[a[2]] == y for a in members) // 4)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).collect()))
    assert got == {i: 0 for i in range(1, 51)} | {99: 98, 100: 98}
    assert graph.components(edges.limit(0)).count() == 0


def test_decontamination_matches_plain(spark, docs, texts):
    rng, v = random.Random(2), vocabulary(1)
    long = texts[77][1].split()
    items = [(1, " ".join(long[500:530])), (2, prose(rng, v, 40)), (3, "One two"), (4, None), (5, ""), (None, "one two"), (6, " ".join(long[510:520])), (7, "same same same same"), (8, texts[61][1].split(" ", 30)[-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain.contaminated([t for _, t in texts], items)
    for chunk in (1 << 20, 60):
        got = decontaminate.decontaminate(docs, bench, chunk_bytes=chunk).toPandas()
        key = lambda rows: sorted(map(str, rows))
        import hashlib

        assert key(zip(got.n_words, got.n_hit, got.n_items, got.items_sha256, got.contaminated, strict=True)) == key((n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), h > 0) for n, h, k in want)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_block_finds_phrases_by_its_own_terms():
    rng = np.random.default_rng(3)
    for trial in range(60):
        h = rng.integers(0, 12, rng.integers(0, 40)).astype(np.uint64) * np.uint64(7)
        bounds = np.append(np.sort(rng.integers(0, len(h) + 1, 5)), len(h))
        bounds[0] = 0
        first, words, _ = decontaminate.windows(h, bounds, 3)
        doc = rng.integers(0, 14, 30).astype(np.uint64) * np.uint64(7)
        order = np.argsort(doc, kind="stable")
        terms, heads = np.unique(doc[order], return_index=True)
        b = decontaminate.Block({"doc_ids": None, "bounds": np.array([0, 31]), "terms": terms.view(np.int64), "heads": np.append(heads, 30), "postings": order})
        wanted = decontaminate.Phrases(h, first, words)
        held, codes, lists = b.held(wanted)
        assert held.tolist() == [p for p in range(len(first)) if words[p] and set(h[first[p] : first[p] + words[p]]) <= set(doc)]
        assert (b.terms[lists] == wanted.terms[codes]).all()
        want = [(p, k) for p in range(len(first)) for k in range(31 - words[p]) if words[p] and (doc[k : k + words[p]] == h[first[p] : first[p] + words[p]]).all()]
        assert sorted(zip(*(x.tolist() for x in b.phrases(wanted)), strict=True)) == want


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b x c d", None, None, None), (2, "c z z z z b a", None, None, None), (3, "b c a", None, None, None)], DOCS)
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.near_matches(d, items, 4).collect())) == [(1, "9", 0), (3, "9", 0)]


def test_pii_matches_plain(spark, docs, texts):
    rows = [(1, "mail a.b@c.de. and x@y.z_w@q.rs 1.2.3.4 999.1.1.1 1.2.3.4.5"), (2, "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 0000000000000"), (3, "+1 (555) 123-4567 +12 3 +49 30 1234567890123456"), (4, None), (5, "é a@b.co ü 10.0.0.1"), (6, "1" * 5000), (7, "1." * 3000), (8, "a" * 20000 + "@" + "b.c" * 10), (9, "5 " * 4000), (1, "mail a.b@c.de."), (10, "+1" + " " * 3000 + "2")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).unionByName(docs)
    all_rows = rows + texts
    got = pii.find_pii(d).select("doc_id", pii.joined(F.concat("base", "added")).alias("spans")).collect()
    want = sorted(f"{i}|" + ",".join(f"{k}:{s}:{e}" for k, s, e in plain.pii(t)) for i, t in all_rows)
    assert sorted(f"{r['doc_id']}|{r['spans']}" for r in got) == want
    clean = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert clean[5] == "é [email] ü [ip]" and clean[4] is None


def test_pii_discovers_identifiers_in_trusted_contexts(spark):
    rows = [(i, f"please write to: u{i}@x.org thanks", None, None, None) for i in range(5)] + [(9, "please write to: user77-at-x now and AB12345 then", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(d).collect()}
    assert spans[9] == [("id", 17, 28)] and not spans[0]


def discovered(spark, rows):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)
    return {rows[r["doc_id"]][s["start"] : s["end"]] for r in pii.find_pii(d).collect() for s in r["added"]}


def test_pii_bootstrap_goes_on_over_generations(spark):
    """Each generation of identifiers makes the pattern of the next one trusted; the fourth pattern is too often followed by others."""
    seeds = [f"write to: u{i}@x.org now" for i in range(40)]
    chain = [f"{word} {name}{j} then" for word, name, n in (("to:", "first", 1), ("ref:", "first", 9), ("ref:", "second", 1), ("see:", "second", 9), ("see:", "third", 1)) for j in range(10, 14) for _ in range(n)]
    noise = [f"per third{j} then" for j in range(10, 14)] + ["per year"] * 20 + ["per other77"]
    assert discovered(spark, seeds + chain + noise) == {f"{name}{j}" for name in ("first", "second", "third") for j in range(10, 14)}


def test_pii_rare_pattern_beside_many_common_ones(spark):
    common = [" ".join(f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)} u{i}x{j}@x.org" for j in range(4)) for i in range(1100)]
    rare = [f"badge: r{j}@x.org" for j in range(3) for _ in range(4)] + ["badge: AB12345"]
    assert discovered(spark, common + rare) == {"AB12345"}


@pytest.mark.parametrize("label", ["contact:", "contact: ", "contact=", 'data-id="', "Kontakt： ", "(id) ", "see "])
def test_pii_labels_before_their_values(spark, label):
    """Attached or not: seeds make the label trusted, and what else follows it is found."""
    close = '"' if label.endswith('"') else ""
    seeds = [f"{'and so' if i % 2 else 'then'} {label}u{i}@x.org{close} here" for i in range(60)]
    assert discovered(spark, [*seeds, *(f"then {label}AB-12{i}4{close} here" for i in range(10)), "see nothing"]) == {f"AB-12{i}4" for i in range(10)}


def test_pii_words_behind_their_values(spark):
    seeds = [f"{w} u{i}@x.org, holder of it" for i, w in enumerate("abcdefghij")]
    assert discovered(spark, [*seeds, "qq AB-1234 holder of", "rr CD-5678 stands alone"]) == {"AB-1234"}


def test_pii_bootstrap_matches_plain(spark):
    """Scores, rounds and spans on texts whose contexts are trusted, half trusted and not, attached and behind."""
    rng, labels = random.Random(4), ["id:", "id: ", "user=", "ref ", "no. ", "(key) ", "Passport： ", "é", '{"a":"', "to "]
    behind = ["", ".", ", holder", " holder", " (owner)", '"}', " or"]
    texts = []
    for i in range(220):
        parts = []
        for _ in range(rng.randint(1, 6)):
            label = rng.choice(labels)
            kinds = {"id:": [8, 2, 0, 0, 0], "id: ": [8, 2, 0, 0, 0], "user=": [1, 8, 0, 2, 0], "ref ": [0, 0, 0, 3, 1], "no. ": [3, 3, 3, 3, 9]}.get(label, [2, 1, 4, 0, 1])
            value = rng.choices([f"u{rng.randint(0, 30)}@x.org", f"AB-{rng.randint(100, 130)}", f"10.0.0.{rng.randint(1, 9)}", f"z{rng.randint(10000, 10020)}.", "word"], kinds)[0]
            parts.append(rng.choice(["", "so ", "Then, "]) + label + value + rng.choice(behind))
        texts.append(" ".join(parts) + rng.choice(["", "\nid: none", " ref", " holder of"]))
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(d).select("doc_id", pii.joined(F.concat("base", "added")).alias("spans")).collect()}
    want = plain.identifiers(texts)
    assert got == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in w) for i, w in enumerate(want)}
    found = sum(k == "id" for w in want for k, *_ in w)
    assert 20 < found < sum(t.count("AB-") + t.count("z100") for t in texts)


def test_pii_plan_is_native(spark, docs, monkeypatch):
    """The plan of each table that is written down on the way, and of the result."""
    plans, keep = [], common.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), keep(df, name))[1])
    plans.append(pii.find_pii(docs)._jdf.queryExecution().toString())
    assert len(plans) > 6 and not any("Python" in p or "MapInArrow" in p or "Pandas" in p for p in plans)


def test_row_keys_are_unique_and_stable(spark, tmp_path):
    """For files as they are, and where rows of a table share a row of a file."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string").repartition(3).write.parquet(path)
    d = spark.read.parquet(path)
    tables = {"bare": d, "filtered": d.where("doc_id > 4"), "exploded": d.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), "twice": spark.read.parquet(path, path), "union": d.union(d), "joined": d.join(spark.range(3).withColumnRenamed("id", "y"), F.col("doc_id") % 3 <= F.col("y")), "memory": spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")}
    for name, t in tables.items():
        keyed, key = common.with_row_key(t)
        rows = keyed.collect()
        assert len(rows) == t.count() == len({r[key] for r in rows}), name
        assert {(r[key], r["doc_id"]) for r in keyed.collect()} == {(r[key], r["doc_id"]) for r in rows} and [c for c in keyed.columns if c != key] == t.columns, name


def test_secrets_match_plain(spark, docs, texts):
    key = base64.b64encode(bytes([0x30, 0x2E, 2, 1, 1, 4, 0x20]) + bytes(range(32)) + bytes([0xA0, 7, 6, 5, 0x2B, 0x81, 4, 0, 0x0A])).decode()
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + "." + "c2lnbmF0dXJlMTIzNA"
    rows = [(1, 'ſecret=abcdef TOKEN = "abcdef" Api_Key:\'xyz123 passwd=abc'), (2, "AKIA" + "A" * 16 + " AKIA" + "B" * 15), (3, "deadbeef" * 3 + " " + "deadbeef" * 2), (4, None), (1005, f"é {jwt} and {key} ü"), (6, "A" * 100_000), (1007, "eyJ.eyJ.x " + "Zm9v" * 20)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).unionByName(docs)
    got = secrets.find_secrets(d).collect()
    want = sorted((str(i), plain.digest(plain.secrets(t))) for i, t in rows + texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert f"jwt:2:{2 + len(jwt)}" in spans[1005] and "der:" in spans[1005] and "jwt" not in spans[1007]
    digest_info = bytes.fromhex("3031300d060960864801650304020105000420") + bytes(32)
    assert not secrets.is_private_key(digest_info) and secrets.key_kind(digest_info.hex().encode()) is None
    encrypted = lambda oid: bytes([0x30, 0x1F, 0x30, len(oid) + 2, 6, len(oid)]) + oid + bytes([4, 25 - len(oid)]) + bytes(25 - len(oid))
    assert all(secrets.is_private_key(encrypted(bytes.fromhex(x))) for x in ("2a864886f70d01050d", "2a864886f70d010c0103"))
    assert not secrets.is_private_key(encrypted(bytes.fromhex("2a864886f70d010101")))
    assert not secrets.is_private_key(b"\x30\x03\x02\x01") and secrets.der_items(b"\x30\x82\x00\x03\x02\x01\x00") == [(0x30, [(2, b"\x00")])]


def test_repeats_match_plain(spark, docs, texts):
    got = repeats.repeated_passages(docs).toPandas()
    cover = {}
    for r in got.itertuples():
        cover.setdefault(r.doc_id if r.doc_id == r.doc_id else None, set()).update(range(r.start_word, r.end_word))
    want = {}
    for i, places in plain.repeated(texts).items():
        want.setdefault(texts[i][0], set()).update(places)
    assert cover == want


def test_repeats_among_many_partial_sharers(spark):
    """Two documents share 60 words; 180 others share only their last 15 to 42 words and one word more."""
    rng, v = random.Random(31), vocabulary(31)
    passage = prose(rng, v, 60).split()
    rows = [(i, f"{prose(rng, v, 30)} {' '.join(passage)} end{i} {prose(rng, v, 30)}") for i in range(2)]
    rows += [(10 + i, f"{prose(rng, v, 40)} {' '.join(passage[-rng.randint(15, 42) :])} end{i % 2} {prose(rng, v, 40)}") for i in range(180)]
    assert same_repeats(spark, rows)


def test_repeats_of_documents_without_ids(spark):
    """Rows with one id, or none, are told apart, and are not joined with one another."""
    rng, v = random.Random(32), vocabulary(32)
    passage = prose(rng, v, 55)
    rows = [(None if i % 2 else 7, f"{prose(rng, v, 20)} {passage} {prose(rng, v, 20)}") for i in range(60)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    found = [r["n_words"] for r in repeats.repeated_passages(d).collect()]
    assert len(found) == 60 and min(found) >= 55


def test_repeats_within_a_document(spark):
    rng, v = random.Random(33), vocabulary(33)
    passage = prose(rng, v, 52)
    text = f"{prose(rng, v, 10)} {passage} {prose(rng, v, 30)} {passage} tail"
    d = spark.createDataFrame([(1, text, None, None, None), (2, prose(rng, v, 200), None, None, None)], DOCS)
    assert repeats.repeated_passages(d).count() == 0
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_id"], r["other_start"]) for r in repeats.repeated_passages(d, within=True).collect())
    assert got == [(1, 10, 62, 1, 92), (1, 92, 144, 1, 10)]


def test_repeats_over_many_ranges(spark, docs, monkeypatch):
    whole = sorted(map(str, repeats.repeated_passages(docs).select("doc_id", "start_word", "end_word").collect()))
    monkeypatch.setattr(repeats, "RANGE_ROWS", 25)
    assert sorted(map(str, repeats.repeated_passages(docs).select("doc_id", "start_word", "end_word").collect())) == whole


def same_repeats(spark, rows):
    """Whether the repeats of (doc_id, text) rows cover the words that plain ones do."""
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    cover = {}
    for r in repeats.repeated_passages(d).collect():
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    want = plain.repeated(rows)
    return len(want) > 0 and cover == {rows[i][0]: places for i, places in want.items()}


@pytest.mark.parametrize("range_rows", [60_000, 40])
def test_repeats_ending_in_a_line_of_many_documents(spark, monkeypatch, range_rows):
    monkeypatch.setattr(repeats, "RANGE_ROWS", range_rows)
    rng, v = random.Random(21), vocabulary(21)
    line = prose(rng, v, 35)
    rows = [(i, f"{prose(rng, v, 40)} {line} {prose(rng, v, 40)}") for i in range(300)]
    for i in range(20):
        own = prose(rng, v, 15)
        rows += [(1000 + 2 * i + k, f"{prose(rng, v, 40)} {own} {line} {prose(rng, v, 40)}") for k in range(2)]
    assert same_repeats(spark, rows)


def test_repeats_of_long_runs_over_range_ends(spark, monkeypatch):
    """Each document holds a line many times, and then a word of its own, so that its suffixes make runs longer than a range."""
    rng, v = random.Random(22), vocabulary(22)

    def key(text):
        _, _, h, bounds = next(repeats.word_runs(pa.array([text])))
        return int(repeats.shingles(h, bounds, repeats.K)[0][0])

    # a line that every window takes for its minimiser, among words that most often come later
    line = f"{min((prose(rng, v, 12) for _ in range(3000)), key=key)} {prose(rng, v, 18)}"
    own = {(i, k): prose(rng, v, 20) for i in range(6) for k in range(90)}
    for i in range(6):
        own[i, 45] = own[i // 2 * 2, 45]
    rows = [(i, " ".join(f"{own[i, k]} {line} mark{i} {prose(rng, v, 15)}" for k in range(90))) for i in range(6)]
    monkeypatch.setattr(repeats, "RANGE_ROWS", 80)
    assert same_repeats(spark, rows)


def test_packing(spark, docs, texts):
    import zlib

    import public_tokenizers as P
    from tokenizers import Tokenizer

    items = packing.best_fit_packing(docs).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for doc_id, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        for k, (start, end) in enumerate(zip([0, *range(first, len(ids), 2048)], [first, *range(first + 2048, len(ids) + 1, 2048)], strict=True)):
            want.append((-1 if doc_id is None else doc_id, k, start, end - start, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start:end]))))
    assert sorted((-1 if i != i else int(i), *map(int, r)) for i, *r in zip(items.doc_id, items.piece, items.start, items.length, items.ids_crc32, strict=True)) == sorted(want)
    for _, s in items.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 2048
    assert items.sequence_id.nunique() == -(-items.length.sum() // 2048)
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)] and packing.cut(2049, 2048) == [(0, 1), (1, 2048)]


def test_packing_over_levels_and_islands(spark):
    """Many shards whose badly filled bins go on to the next level: every item once, no bin too full, near the bound."""
    rng = random.Random(6)
    rows = [(i, rng.choice([rng.randint(1, 30), rng.randint(330, 520), 1000])) for i in range(1500)]
    d = spark.createDataFrame(rows, "item long, length int")
    got = packing.pack(d, capacity=1000, shard_items=150).toPandas()
    assert sorted(got.item) == list(range(1500)) and got.groupby("sequence_id").length.sum().max() <= 1000
    whole = packing.Packing([n for _, n in rows], 1000)
    whole.best_fit(packing.longest_first(whole.sizes, range(len(rows))))
    assert got.sequence_id.nunique() <= 1.01 * len(whole.bins)


@pytest.mark.parametrize("seed", range(6))
def test_evolved_packings_against_exhaustive_search(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(15, 70) for _ in range(11)]
    assert len(packing.evolve(sizes, capacity=100, seed=seed, most=30).bins) == plain.fewest_bins(sizes, 100)


def test_elites_move_between_islands():
    """An island that gets a neighbour's elite is never worse than that elite."""
    rng = random.Random(8)
    sizes = [rng.randint(2, 700) for _ in range(120)]
    run = packing.epoch(1000, 0, 2)
    rows = pd.DataFrame({"item": range(120), "length": sizes, "shard": 0, "island": 0, "role": 0, "bin": -1})
    first = run(rows)
    assert sorted(first.groupby(["island", "role"]).size().index) == [(0, 0), (1, 1)]
    arrived = first[first.island == 1]
    second = run(pd.concat([rows.assign(island=1), arrived]))
    assert second[second.role == 0].bin.nunique() <= arrived.bin.nunique()


def test_token_ids_are_those_of_the_tokenizers_library(texts):
    e = packing.Encoder()
    odd = ["", " ", "\n\n  x", "don't   stop", "<|endoftext|>", "日本語 текст", "a" * 5000, " x y", "1234567 ½ ²", "\x00\x01", *(t for _, t in texts if t)]
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain_ids = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # with its default settings
    for t in odd:
        assert e.encode(t).tolist() == e.encode_slow(t).tolist() == plain_ids.encode(t, add_special_tokens=False).ids
    assert 50256 in e.encode("a <|endoftext|> b")


def test_genetic_packing_beats_or_meets_best_fit():
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(600, 760)]) for _ in range(300)]
    p = packing.evolve(sizes, capacity=2048, seed=1)
    plain_fit = packing.Packing(sizes, 2048)
    plain_fit.best_fit(packing.longest_first(sizes, range(len(sizes))))
    assert sorted(i for b in p.bins.values() for i in b) == list(range(300)) and len(p.bins) <= len(plain_fit.bins)
    assert len(packing.evolve(sizes, capacity=2048, seed=1, least=12, most=12).bins) <= len(plain_fit.bins) - 1
    child = packing.crossover(p, plain_fit, random.Random(1))
    assert sorted(i for b in child.bins.values() for i in b) == list(range(300))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://a/4", ""), (5, "u v\r\nX: y", "é" * 1000), (None, "http://n", "x"), (7, "http://a/7", "line\r\n\r\nHTTP/1.1\r\n"), (7, "http://a/7", "line\r\n\r\nHTTP/1.1\r\n")] + [(100 + i, f"http://b/{i}", f"<html><body>page {i} of a site with a long frame {'word ' * (i % 50)}</body></html>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(pages, folder, file_bytes=2000)
    got = warc.read_archives(files, folder).toPandas()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if i == best[h or ""] else "revisit", -1 if i == best[h or ""] else best[h or ""]) for i, _, h in rows)
    nan = lambda x: -1 if x != x else int(x)
    assert sorted((nan(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, nan(r.refers_to)) for r in got.itertuples()) == want
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(rows)
    name = files.first()["file"]
    assert (tmp_path / "w" / name).read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0
    small = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/s", min_bytes=100), f"file://{tmp_path}/s")
    assert small.where("payload_bytes < 100 and record_type = 'revisit'").count() == 0


def test_language(spark):
    rng = random.Random(4)
    v = {"aa": vocabulary(10), "bb": vocabulary(11), "cc": vocabulary(12)}
    rows = [(i, prose(rng, v[lang], rng.randint(20, 60)), lang, None, None) for i in range(300) for lang in [rng.choice(list(v))]]
    rows += [(1000, f"{prose(rng, v['aa'], 300)} {prose(rng, v['bb'], 100)}", None, None, None), (1001, None, "aa", None, None), (1002, "123 !!", "aa", None, None), (1003, "", None, None, None), (1004, prose(rng, v["cc"], 30_000), "cc", None, None)]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.fit(d.where(common.crc_mod("doc_id", 4) != 2))
    got = langid.identify(d, model).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n"]), on="doc_id")
    held = got[got.held_out & got.lang.notna() & (got.doc_id < 1000)]
    assert (held.lang_pred == held.lang).mean() > 0.95 and len(held) > 40
    by = got.set_index("doc_id")
    assert by.lang_pred[1000] == "aa" and by.score[1000] == pytest.approx(0.75, abs=0.08) and list(by.languages[1000]) == ["aa", "bb"]
    assert [by.lang_pred[i] for i in (1001, 1002, 1003, 1004)] == ["und", "und", "und", "cc"] and by.score[1001] == 0
    assert (got.score <= 1).all()
    none = langid.identify(d, langid.fit(d.limit(0))).toPandas()
    assert (none.lang_pred == "und").all()
    kept = langid.keep_identified(d, model)
    assert kept.columns == d.columns and kept.where("doc_id in (1001, 1002, 1003)").count() == 0 and kept.where("doc_id = 1000").count() == 1


def test_languages_match_plain(spark):
    """Against the same inference written plainly, on texts of one to five languages, beside neighbours of all kinds."""
    rng = random.Random(14)
    v = {k: vocabulary(40 + i) for i, k in enumerate("abcde")}
    known = [(i, prose(rng, v[k], 60), k, None, None) for i in range(200) for k in [rng.choice("abcde")]]
    model = langid.fit(spark.createDataFrame(known, DOCS))
    odd = ["Ünï ÀÉ x", "1 2 3", "z", "", prose(rng, v["a"], 3000)]
    texts = odd + [" ".join(prose(rng, v[k], rng.randint(5, 60)) for k in rng.sample("abcde", n)) for n in (1, 2, 3, 4, 5) for _ in range(4)]
    _, _, raw, offsets = next(common.text_slices(pa.array(texts), 1 << 40))
    got = langid.infer(model, raw, offsets)
    for text, row in zip(texts, got, strict=True):
        want = plain.language_shares(text, model.log_p, langid.SEGMENT_BYTES, langid.PENALTY, langid.TEMPER, langid.ROUNDS) if any(c.isalpha() for c in text) else [0] * 5
        assert row == pytest.approx(want, abs=1e-3)
    assert (got > 0).sum(axis=1).max() == 5


def test_boosting_matches_plain():
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=150) > 0.5).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])).tolist() for j in range(3)]
    forest = quality.grow(x, y, trees=8, depth=6)
    want = plain.boosted(x.tolist(), y.tolist(), cuts, 8, 6, quality.RATE, quality.RIDGE, quality.MIN_ROWS)
    assert forest.score(x) == pytest.approx(want, abs=1e-9)
    assert len(forest.left) > 8 * 3


def test_quality(spark):
    rng, v = random.Random(5), vocabulary(13)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        text = prose(rng, v, rng.randint(20, 80))
        rows.append((i, text if good else "!! ".join(text.upper().split()), None, None, None))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, prose(rng, v, 30_000), None, None, None), (1, rows[1][1], None, None, None)]
    labels += [(2, None, None), (None, 1, 0), (9999, 1, 0)]
    d, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    forest = quality.fit(d, y.where(common.crc_mod("doc_id", 5) != 0))
    got = quality.score_quality(d, forest).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    truth = {i: q for i, q, _ in labels[:600]}
    held = got[got.held_out & (got.doc_id < 600)]
    assert np.mean([truth[i] == p for i, p in zip(held.doc_id, held.predicted, strict=True)]) > 0.97
    assert quality.score_quality(d, quality.fit(d, y.limit(0))).agg(F.max("score")).first()[0] == pytest.approx(0.5)
    x = np.random.default_rng(0).normal(size=(50, 3))
    f = quality.grow(x, (x[:, 0] > 0).astype(float), trees=5)

    def walk(row):
        total = f.base
        for t in f.root:
            while f.left[t]:
                t = f.left[t] + (row[f.feature[t]] > f.threshold[t])
            total += f.value[t]
        return 1 / (1 + np.exp(-total))

    assert f.score(x) == pytest.approx([walk(r) for r in x])


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 16))
    near = [x[0] + 0.05 * rng.normal(size=16) for _ in range(120)] + [x[1] + 0.12 * rng.normal(size=16) for _ in range(80)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate([*x, *near])]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (702, [2 * v for v in rows[4][1]]), (703, None), (704, [0.0] * 16), (705, [float("nan")] + [1.0] * 15), (706, [None] + [1.0] * 15), (707, [float("inf")] + [1.0] * 15), (708, [1.0, 2.0]), (709, [1.0, 2.0]), (3, rows[5][1]), (710, [])]
    return rows


def truth(rows):
    fine = [r is not None and len(r) > 0 and all(v is not None and np.isfinite(v) for v in r) and any(r) for _, r in rows]
    n, adj = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    adj[i].add(j), adj[j].add(i)
    return adj


@pytest.mark.parametrize("row_block,cells", [(1024, 400), (32, 50)])
def test_embeddings(spark, monkeypatch, row_block, cells):
    monkeypatch.setattr(embed_dedup, "ROW_BLOCK", row_block)
    monkeypatch.setattr(embed_dedup, "COLUMN_BLOCK", 2 * row_block)
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", cells)
    rows = vectors()
    adj = truth(rows)
    d = spark.createDataFrame([(i, r, 0) for i, r in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    # a margin of half the distance at the threshold makes the search exact
    got = embed_dedup.near_duplicates(d.withColumn("embedding", F.col("embedding").cast("array<double>")), margin=0.16).toPandas()
    assert len(got) == len(rows)
    as_float = [(i, None if r is None else [None if v is None else float(np.float32(v)) for v in r]) for i, r in rows]
    adj = truth(as_float)
    assert sorted(got.n_links) == sorted(map(len, adj.values()))
    low = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        low[i] = min(rows[j][0] for j in seen)
    assert sorted(zip(got.vec_id, got.component_id, strict=True)) == sorted((rows[i][0], c) for i, c in low.items())
    assert (got.kept == (got.vec_id == got.component_id)).all()
    found = embed_dedup.near_duplicates(d).toPandas().n_links.sum()
    assert found >= 0.95 * sum(map(len, adj.values()))


def test_embeddings_of_two_dimensions(spark, monkeypatch):
    """Directions on a circle, so that every difference lies across the boundaries of cells: no link may be lost."""
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(np.cos(a))), float(np.float32(np.sin(a)))]) for i, a in enumerate(rng.uniform(0, 2 * np.pi, 400))]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert dict(zip(got.vec_id, got.n_links, strict=True)) == {i: len(x) for i, x in truth(rows).items()}


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (repeats.repeated_passages(empty), langid.identify(empty, langid.fit(empty)), quality.score_quality(empty, quality.fit(empty, labels)), jaccard.jaccard_components(empty), secrets.find_secrets(empty), embed_dedup.near_duplicates(vec), decontaminate.decontaminate(empty, bench), packing.best_fit_packing(empty), pii.find_pii(empty), pii.redact(empty)):
        assert df.count() == 0
    assert warc.repeated(pages).count() == 0


INTERNAL = (
    "row", "rep", "n", "tokens", "block", "bin", "item", "spans", "base", "pattern", "instance", "held_out", "score", "label", "keys", "places", "island", "length", "f1", "f2", "prefix", "t", "_m", "_p", "_e", "_d", "_all", "word", "token", "email", "key",
    "_key", "_row", "_s", "_spans", "_salt", "salt", "gone", "role", "shard", "leader", "band", "pos", "cls", "digest", "size", "mult", "unit", "cell", "home", "core", "visits", "a", "b", "root", "node", "one", "two", "x", "rate", "k", "inner", "a.b",
)


def test_extra_columns_with_clashing_names(spark, docs):
    extra = docs.withColumns({c: F.lit("x") for c in INTERNAL})
    n = docs.count()
    bench = spark.createDataFrame([(1, "one two", "x", "x")], "item_id long, text string, key string, block string")
    labels = spark.createDataFrame([(i, i % 2, 0, "x", "x") for i in range(60)], "doc_id long, quality int, toxic int, label string, k string")
    assert jaccard.jaccard_components(extra).count() == n
    assert decontaminate.decontaminate(extra, bench).count() == n
    assert decontaminate.near_matches(extra, bench, 3).count() > 0
    assert pii.find_pii(extra).count() == n
    assert packing.best_fit_packing(extra).where("piece = 0").count() == n
    assert secrets.find_secrets(extra).count() == n
    assert repeats.repeated_passages(extra).count() > 0
    assert langid.identify(extra, langid.fit(extra)).count() == n
    assert quality.score_quality(extra, quality.fit(extra, labels)).count() == n
    assert pii.redact(extra).columns == extra.columns
    assert langid.keep_identified(extra, langid.fit(extra.withColumn("lang", F.lit("en")))).columns == extra.columns
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in INTERNAL})
    assert embed_dedup.near_duplicates(vec).count() == 20


def test_archives_of_large_payloads_and_clashing_columns(spark, tmp_path):
    big = "<p>" + "word " * 2_000_000
    rows = [(1, "u", big), (2, "v", big), (3, "w", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in INTERNAL})
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").collect()}
    assert got[1]["payload_bytes"] == len(big) and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[3]["refers_to"] is None


def test_secrets_that_decode(spark):
    """Added spans by structure: tokens that end a sentence, armours in one line, with escapes and with headers, and what does not decode."""
    key = base64.b64encode(bytes([0x30, 0x2E, 2, 1, 1, 4, 0x20]) + bytes(range(32)) + bytes([0xA0, 7, 6, 5, 0x2B, 0x81, 4, 0, 0x0A])).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2lnbmF0dXJlMTIzNA"
    armour = lambda body, kind="EC PRIVATE KEY", gap="\n": f"-----BEGIN {kind}-----{gap}{body}{gap}-----END {kind}-----"
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + base64.b64encode(bytes(range(48))).decode()
    cases = {
        f"see {jwt}. Then": [("jwt", 4, 4 + len(jwt))],
        f"é {jwt}": [("jwt", 2, 2 + len(jwt))],
        armour(key): [("pem", 0, len(armour(key)))],
        armour(key[:40] + "\\n" + key[40:], gap="\\n"): [("pem", 0, len(armour(key[:40] + "\\n" + key[40:], gap="\\n")))],
        armour(sealed, "RSA PRIVATE KEY"): [("pem", 0, len(armour(sealed, "RSA PRIVATE KEY")))],
        armour("Zm9v" * 20): [],
        f"{part({'alg': 1})}.{part({'sub': '1'})}.c2ln": [],
        f"ü {key} {key[:-8]}": [("der", 2, 2 + len(key))],
    }
    for text, want in cases.items():
        assert secrets.confirmed_spans(text.encode()) == want, text


