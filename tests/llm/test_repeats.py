import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quireworks.llm import repeats
from quireworks.llm.common import table


def brute(rows: list[tuple]) -> dict:
    """(n_bytes, n_removed, n_spans, kept) by a table of all strings of 50 bytes."""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - 49 if i is not None else 0):
            s = t[k : k + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49 if i is not None else 0):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)

    def noise(n: int) -> str:
        return "".join(rng.choice("abcdé ") for _ in range(n))

    parts = [noise(rng.choice([40, 49, 50, 51, 70, 130, 400])) for _ in range(12)]
    rows = [(n, "".join(noise(rng.randrange(0, 90)) + rng.choice(parts)[rng.randrange(0, 5) : rng.choice([48, 60, 500])] for _ in range(rng.randrange(0, 6)))) for n in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (150, "x" * 700), (151, "x" * 60 + "y" + "x" * 49), (152, "x" * 49), (153, "ab" * 200), (154, "ba" * 40)]
    rows += [(300, None), (301, ""), (5, rows[7][1]), (None, rows[3][1]), (None, None), (302, "\0" * 60 + "é" * 50), (303, "é" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, group", [(1, 50_000, 1 << 26), (2, 3, 1 << 26), (3, 10, 1500)])
def test_against_all_strings(spark, monkeypatch, seed, hot, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BUCKET", 4000)
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, lo int").repartition(5)
    got = repeats.remove_repeats(docs, hot).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)
    assert found == brute(rows)


def test_negative_ids(spark):
    same = "".join(random.Random(9).choice("abcdefgh ") for _ in range(300))
    rows = [(-9, "x" + same), (-4, same + "y"), (-1, same), (7, same + "z")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")  # a task each
    got = repeats.remove_repeats(docs).collect()
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)
    assert found == brute(rows)


def test_index_statistics_against_sorting():
    rng = np.random.default_rng(0)
    lengths = np.array([80, 70, 80, 20, 80, 55])
    rows = rng.integers(97, 99, (6, 80)).astype(np.uint8)
    rows[2, 5:75] = rows[0, 5:75]
    rows[4] = rows[0]
    index = repeats.RunIndex(rows, lengths)
    strings = [(bytes(rows[t, o : lengths[t]]), t, index.start[t] + o) for t in range(6) for o in range(lengths[t] + 1)]
    strings.sort()
    assert index.lengths.sum() == len(strings) and len(index.heads) < len(strings) / 2
    places = np.array([p for _, _, p in strings[1:]])
    neighbour, shared = index.statistics(places)
    assert neighbour.tolist() == [p for _, _, p in strings[:-1]]
    for (a, _, _), (b, _, _), n in zip(strings, strings[1:], shared):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(97, 103, 5000).astype(np.uint8)
    want = repeats.anchors(data, np.array([0, 5000]))
    monkeypatch.setattr(repeats, "PIECE", 300)
    got = repeats.anchors(data, np.array([0, 5000]))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert all(((want[0] >= k) & (want[0] <= k + 30)).any() for k in range(5000 - 49))


def test_query_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, repeats.op10_long_repeats(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffixes_are_sorted_by_content_and_place():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 81, 60)
    texts = rng.integers(0, 3, (60, 80)).astype(np.uint8)
    texts[20:40], lengths[20:40] = texts[:20], lengths[:20]  # equal to the end
    texts[40:50, 5:] = texts[:10, :75]
    whole = [texts[i, :n].astype(np.uint16) + 1 for i, n in enumerate(lengths)]
    flat = np.concatenate([np.append(t, 0) for t in whole]).astype(np.uint16)
    stop = np.repeat(np.cumsum(lengths + 1), lengths + 1)
    want = sorted(range(len(flat)), key=lambda i: (flat[i : stop[i]].tolist(), i))
    assert repeats.RunIndex._sorted(flat, stop).tolist() == want


def test_what_goes_is_merged_for_many_texts_at_once(monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(450):
        text = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 60, 300])))
        marks = sorted((a, min(len(text), a + rng.randrange(1, 80))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 4) if text else 0)))
        rng.shuffle(marks)
        rows.append((i, text, marks))
    called, merged = [], repeats._merged
    monkeypatch.setattr(repeats, "_merged", lambda *x: called.append(1) or merged(*x))
    lists = ([[m[k] for m in marks] if marks else None for _, _, marks in rows] for k in (0, 1))
    columns = [pa.array([r[0] for r in rows]), pa.array([zstandard.compress(r[1]) for r in rows]), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
    got = [row for b in repeats._remove([pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", "lo", "hi"])]) for row in zip(*(c.to_pylist() for c in b.columns))]
    want = []
    for i, text, marks in rows:
        gone = {k for a, b in marks for k in range(a, b)}
        want.append((i, len(text), len(gone), sum(k - 1 not in gone for k in gone), bytes(c for k, c in enumerate(text) if k not in gone)))
    assert got == want and len(called) <= 3  # not once a text
