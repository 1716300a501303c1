"""The Merkle manifest against trees written out plainly, and its traversal against whole levels."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(i, text, lang, source, n):
    return h([field(i), field(source), field(lang), field(n), field(text)])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, at):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield at % 8, run
        at //= 8


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    trees = {}
    for lang, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = levels_of([leaf(*r) for r in own])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels_of([trees[x][-1][0] for x in order])
    out = []
    for lang, own in by.items():
        for at, r in enumerate(own):
            path = [*siblings(trees[lang], at), *siblings(top, order.index(lang))]
            text = r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            folded = leaf(r[0], text, *r[2:])
            for k, run in path:
                folded = h([*run[:k], folded, *run[k + 1 :]])
            out.append((r[0], leaf(*r), trees[lang][-1][0], top[-1][0], h(x for k, run in path for j, x in enumerate(run) if j != k), folded))
    return out


def rows_of(n, langs):
    rows = [(i, f"Text {i} É{'A' if i % 4 else 'a'}", langs[i * i % len(langs)], f"s{i % 3}" if i % 5 else None, i if i % 7 else None) for i in range(n)]
    rows += [(None, "no id", langs[0], None, 1), (None, None, langs[0], None, None), (3, "Other Text of a taken id", langs[0], "s", 2), (5, "", None, "", 0), (6, "Long " * 50_000, "zz", "s", 3)]
    return rows + [rows[0]] * 3 + [(9 * n, None, langs[0], None, 4)]


@pytest.mark.parametrize("n,langs,levels", [(700, ["en", "en", "de"], 1), (700, ["en", "fr", "", "é"], 2), (90, [None], 1), (300, [f"l{k:02d}" for k in range(40)], 1), (150, ["en"], 4)])
def test_manifest_matches_plain(spark, n, langs, levels):
    rows = rows_of(n, langs)
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("_group0", F.lit(2)).repartition(5)
    got = [tuple(r) for r in merkle.manifest(docs, levels).collect()]
    want = plain(rows)
    assert sorted(map(str, (r[:6] for r in got))) == sorted(map(str, want))
    assert all(r[6] == (r[5] == r[3]) for r in got)
    changed = {r[0] for r in rows if r[0] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r[1])}
    assert all((r[0] in changed) or r[6] for r in got) and any(not r[6] for r in got)


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    alone = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).collect()
    assert [tuple(r)[:6] for r in alone] == plain([(1, "a", "en", "s", 1)]) and alone[0].leaf == alone[0].root and alone[0].proof_sha256 == h([])


@pytest.mark.parametrize("n,most", [(1, 2), (7, 2), (8, 2), (9, 2), (64, 2), (65, 2), (63, 3), (500, 3), (513, 3)])
def test_traversal_gives_the_runs_of_whole_levels(n, most):
    leaves = [h([str(i)]) for i in range(n)]
    for lo in range(0, n, 8**most):
        own = leaves[lo : lo + 8**most]
        levels = [own]
        for _ in range(merkle.height(len(own), n, most)):
            levels.append([h(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        for i, path in enumerate(merkle.traverse([x.encode() for x in own], n, most)):
            assert [(at, [x.decode() for x in run]) for at, run in path] == [(i // 8**k % 8, levels[k][i // 8 ** (k + 1) * 8 :][:8]) for k in range(len(levels) - 1)]
        assert merkle.root_of([x.encode() for x in own], n, most).decode() == levels[-1][0]
