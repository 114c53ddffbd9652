import hashlib
import math
from collections import Counter

import numpy as np

from quireworks.llm import fingerprint as fp
from quireworks.llm.common import table


def test_entropy_classes_against_counting():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 105, 500), np.zeros(90), rng.integers(0, 256, 70_000)]).astype(np.uint8)
    got = fp.entropy_classes(data)
    for i in [*range(0, 620), *range(65_400, 65_700)]:
        counts = Counter(data[i : i + 64].tolist()).values()
        total = sum(round(c * math.log2(c) * (1 << 20)) for c in counts)
        assert got[i] == min((fp._MOST - total) * fp.BINS // fp._MOST, fp.BINS - 1)


def features(text: str, rank: np.ndarray) -> list[int]:
    """Windows chosen by plain counting of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    ranks = rank[fp.entropy_classes(data)]
    popular = Counter(min(range(i, i + 64), key=lambda k: (ranks[k], k)) for i in range(len(ranks) - 63))
    return [k for k, n in sorted(popular.items()) if n >= fp.POPULAR]


def test_features_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgé"), 4)) for _ in range(90)]
    texts = ["", "short", " ".join(rng.choice(words, 20)), " ".join(rng.choice(words, 600)), "x" * 300, "é" * 40, " ".join(rng.choice(words, 900))]
    rank = rng.permutation(fp.BINS)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    together = fp.feature_hashes(np.concatenate(data), offsets, rank)
    for text, one, d in zip(texts, together, data):
        alone = fp.feature_hashes(d, np.array([0, len(d)]), rank)[0]
        assert one.tolist() == alone.tolist()
        if len(d) > 200:
            assert len(set(one.tolist())) == len({d[k : k + 64].tobytes() for k in features(text, rank)})


def test_every_text_has_a_feature():
    rng = np.random.default_rng(5)
    rank = rng.permutation(fp.BINS)
    texts = [rng.choice(list(b"abcdefgh "), n).astype(np.uint8) for n in range(1, 260)]
    texts += [np.resize(np.frombuffer(p, np.uint8), n) for p in (b"x", b"ab", b"abc", bytes(range(97, 97 + 26))) for n in (126, 127, 128, 200, 10_000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = fp.feature_hashes(np.concatenate(texts), offsets, rank, fill=True)
    plain = fp.feature_hashes(np.concatenate(texts), offsets, rank)
    assert any(len(h) == 0 for h in plain)
    for t, one, popular in zip(texts, together, plain):
        assert len(one) and (not len(popular) or one.tolist() == popular.tolist())
        assert one.tolist() == fp.feature_hashes(t, np.array([0, len(t)]), rank, fill=True)[0].tolist()


def test_short_and_uniform_texts_are_told_apart(spark):
    rows = [(1, "x" * 300), (2, "ab" * 5000), (3, "The quick brown fox jumps over the lazy dog. " * 3), (4, "q" * 130), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fp.fingerprints(docs).orderBy("doc_id").collect()
    assert [r["fingerprint"] != "" for r in got] == [True] * 4 + [False]
    assert all(r["near_next"] < 0.5 for r in got)


def test_likeness():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    one, other, none = fp.bloom_chain(a), fp.bloom_chain(b), fp.bloom_chain(a[:0])
    assert len(one) == 3 and fp.likeness(one, one) == 1 and fp.likeness(one, other) < 0.2
    assert fp.likeness(none, none) == 1 and fp.likeness(one, none) == 0


def check(spark, rows: list[tuple]) -> list:
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int").repartition(3)
    got = fp.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (-math.inf if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    want = Counter()
    for row, following in zip(order, order[1:] + order[:1]):
        text = row[1] or ""
        want[(row[0], len(text), hashlib.sha256(fp.edited(text, following[1] or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    return got


def test_neighbours_over_ranges_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 300)
    rows = [(i * 3, f"{i} " + "word é " * (i % 40), 1) for i in range(100)] + [(None, "no id", 1), (9, None, 1), (9, "twice", 1), (9, "twice", 1), (500, "", 1)]
    got = check(spark, rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    check(spark, [(4, "alone", 1)])
    check(spark, [])


def test_query_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], 0) for r in table(spark, sf_dir, "documents").collect()]
    check(spark, rows)
    got = fp.op7_fingerprints(spark, sf_dir).toPandas()
    by_text = {}
    for (_, text, _), print_ in zip(sorted(rows), got.sort_values("doc_id")["fingerprint"]):
        assert by_text.setdefault(text, print_) == print_
    assert got["near_edited"].mean() > 0.6 > 0.3 > got["near_next"].mean()
