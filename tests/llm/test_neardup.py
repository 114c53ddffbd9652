import random

import numpy as np
import pandas as pd
import pyarrow as pa

from quireworks.llm import neardup
from quireworks.llm.common import table, text_bytes


def shingles(text) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows: list[tuple]) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(spark, rows: list[tuple]) -> None:
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_chains_groups_and_edge_cases(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n * 7 % 1009, text))
        n += 1

    for text in (None, "", " \t\n", "one", "ONE", "one two", "one two three four five", "One  two\nthree four FIVE", "É ñ é", "é Ñ É"):
        add(text)
    base = rng.sample(words, 120)
    for _ in range(150):  # copies of one text with few and with many changes: linked by way of others
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            copy[rng.randrange(120)] = rng.choice(words)
        add(" ".join(copy))
    chain = rng.sample(words, 200)
    for k in range(0, 60, 6):  # each is close to the next only
        add(" ".join(rng.sample(words, 0) + chain[k : k + 100]))
    for _ in range(100):
        add(" ".join(rng.sample(words, rng.choice([3, 30, 300]))))
    add(" ".join(words * 3))
    add(" ".join(words * 3 + ["x"]))
    check(spark, rows)


def test_tiles_find_what_hubs_miss(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 100)
    # Many texts share 60 %: they meet in buckets but are not linked, except for planted pairs.
    rows = []
    for i in range(300):
        rows.append((i, " ".join(passage + rng.sample(words, 30))))
    for i in range(300, 330):
        rows.append((i, rows[rng.randrange(300)][1] + " tail"))
    monkeypatch.setattr(neardup, "TILE", 32)
    monkeypatch.setattr(neardup, "CHUNK", 1500)
    check(spark, rows)


def test_alike_but_not_linked_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 100)
    rows = [(i, " ".join(passage + rng.sample(words, 30))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " tail") for i in range(20)]
    written, stage = {}, neardup.stage

    def counted(df, name, keep=False):
        out = stage(df, name, keep)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "stage", counted)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows) and spark.conf.get(key) == before
    # a member is in a bucket of each band at most; all pairs of the group would be 51,040
    assert max(written.values()) <= neardup.BANDS * len(rows), written


def test_families_are_settled_as_by_brute_force():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 100)
    texts = [" ".join(passage + rng.sample(words, 30)) for _ in range(120)] + ["one two"]
    texts += [texts[i] + " tail" for i in range(40)] + [texts[0] + " tail", "one two three"]
    data, offsets = text_bytes(pa.array(texts))
    sets = neardup.shingle_sets(data, offsets)
    minima = neardup.signatures(sets).astype(np.uint8)
    frame = pd.DataFrame({"rep": range(len(texts)), "label": range(len(texts)), "signature": [m.tobytes() for m in minima], "shingles": [s.tobytes() for s in sets]})
    frame.loc[7, "label"] = 3  # known to be in one component

    def joined(found: pd.DataFrame) -> list[int]:
        label = frame["label"].tolist()
        for a, b in found.itertuples(index=False):
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    want = {i: c for i, (_, c) in brute(list(enumerate(texts))).items()}
    want = {i: want[3] if c == want[7] else c for i, c in want.items()}
    for parts in (1, 3):  # in one chunk, and in chunks of which every two meet
        frame["chunk"] = frame["rep"] % parts
        frame["part"], frame["bucket"] = frame["chunk"], 5
        near, links = [], []
        for lo in range(parts):
            for hi in range(lo, parts):
                there = frame[frame["chunk"].isin([lo, hi])].sample(frac=1, random_state=1)
                near.append(neardup._near((5, lo, hi), there))
                links.append(neardup._settle((0, lo, hi), there))
                assert len(near[-1]) < len(there) and len(links[-1]) < len(there)
        near, links = pd.concat(near), pd.concat(links)
        assert joined(links) == [want[i] for i in range(len(texts))]
        family = joined(near)
        assert all(family[a] == family[b] for a, b in links.itertuples(index=False)) and len(set(family)) < 10
    several = pd.concat([frame.assign(bucket=1), frame.head(60).assign(bucket=2)])
    assert len(neardup._near((5, 0, 0), several)) <= len(several) - 2


def test_tiles_have_a_row_for_each_part_of_a_bucket(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 100)
    rows = [(i, " ".join(passage + rng.sample(words, 30))) for i in range(300)]
    made, tiles = [], neardup._tiles

    def counted(sized, signed):
        out = tiles(sized, signed)
        assert all(len(r["reps"]) == len(r["labels"]) == len(r["signatures"]) for r in out.collect())
        made.append((out.count(), sized.select("bucket").distinct().count(), sized.count()))
        return out

    monkeypatch.setattr(neardup, "_tiles", counted)
    check(spark, rows)
    for got, buckets, members in made:
        assert got == buckets < members / 5
    assert made


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z"), (3, "q")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert neardup.keep_one(docs).count() == 4
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op9_near_duplicates(spark, sf_dir).collect()}
    assert got == brute(rows)
