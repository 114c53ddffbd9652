import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quireworks.llm import manifest
from quireworks.llm.common import held_out

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root over a list of digests, and for each of them the (is right, sibling) steps to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            paths[i].append((p % 2, nodes[p ^ 1] if p ^ 1 < len(nodes) else ""))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = (mine, *climb([leaf(*r) for r in mine]))
    root, tops = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths):
            path = path + top
            changed = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf(*row[:4], row[4] + 1) if changed else leaf(*row)
            for right, sibling in path:
                digest = h(sibling, digest) if right else h(digest, sibling)
            out.append((row[0], leaf(*row), subroot, root, h(*(s for _, s in path)), digest, digest == root))
    return sorted(map(repr, out))


def checked(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3).withColumns({c: F.lit("clash") for c in ("tree", "rank", "digest", "size", "part", "at", "told", "path")})
    found = manifest.verify(docs, held_out(F.col("doc_id"), 7, 0)).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(repr(tuple(r[n] for n in names)) for r in found)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_trees_of_any_shape(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest.build, "__defaults__", (bits,))
    monkeypatch.setattr(manifest.descend, "__defaults__", (bits,))
    sizes = {None: 1, "": 2, "de": 3, "en": 37, "é": 16, "fr": 5, "z": 1}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 1009, f"text {i} ü" * (i % 4), lang, None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i))
    assert checked(spark, rows) == brute(rows)


def test_repeated_and_null_rows(spark):
    same = (5, "same", "en", "s", 4)
    rows = [same, same, same, (5, "other", "en", "s", 4), (None, None, None, None, None), (None, None, None, None, None), (None, "", "en", "", 2**63 - 1), (-3, "x" * 100_000, "en", "s", -1)]
    assert checked(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone", "en", "s", 5)], [(0, "a", None, None, None)], [(i, "t", "en", "s", 1) for i in range(4)]])
def test_few_rows(spark, rows):
    assert checked(spark, rows) == (brute(rows) if rows else [])


def test_only_asked_leaves(spark):
    nodes = spark.range(21).select(F.lit("t").alias("tree"), F.col("id").alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(21).cast("long").alias("size"))
    store, roots = manifest.build(nodes, 2)
    assert len(store) == 3
    start = roots.withColumn("path", F.expr(f"CAST(array() AS {manifest._PATH})"))
    asked = spark.createDataFrame([("t", 20, 1), ("t", 3, 2), ("t", 3, 3), ("t", 99, 4), ("other", 0, 5)], "tree string, rank long, claim int")
    found = manifest.descend(store, start, asked, 2)
    rows = {r["claim"]: r for r in found.withColumn("root", manifest.fold("digest", "path")).collect() if r["digest"] is not None}
    assert set(rows) == {1, 2, 3}
    root, paths = climb([h(str(i)) for i in range(21)])
    assert {r["root"] for r in rows.values()} == {root}
    assert [(s["right"], s["sibling"]) for s in rows[1]["path"]][::-1] == [(bool(a), b) for a, b in paths[20]]
