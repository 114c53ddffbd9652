"""Near-duplicates by MinHash.

A document is its set of distinct word shingles (``WORDS`` words each; fewer words are one shingle).
Documents with equal sets are one class, found by a digest. For the classes' representatives, ``BANDS *
ROWS`` universal hash minima form the signature; representatives that agree on all rows of a band meet in
a bucket. Of each minimum one byte is kept for comparing signatures. Within a bucket nobody is paired with
everybody:

1. Every member is paired with one hub: the smallest member of any of its buckets. Pairs whose signatures
   agree often enough are confirmed on the full sets, and confirmed links are joined into components by
   alternating large-star and small-star. In further rounds each member of a bucket with several components
   is paired with a member of another one.
2. What is left are buckets whose members are still in more than one component. Large ones are split by a
   second band: two members are compared if they share, besides the bucket, one of the ``NEXT`` bands after
   its own. What is larger than ``TILE`` even then is compared in tiles. A part of a bucket is one packed row, so
   tiles add rows with the square of a bucket's parts, not of its members. Members of different components whose
   signatures agree are near; no list of near pairs is made, only a forest that joins what they connect.
3. What the forests join is a family, which holds every near pair. Its members are sent, with their sets, to
   chunks of bounded size; there the near pairs of different components are confirmed, and of the links
   those that join two components are given out, so rows grow with the members, not with their pairs.

So nearly every pair that shares a bucket has been compared, or is in one component already. A pair with
similarity 0.75 shares a band with probability p = 0.75**4; it shares no bucket with probability (1 - p)**40
= 2.5e-7, and no two bands at most ``NEXT`` apart, as far as its buckets are large, with 7e-5; more similar
pairs with less. Agreement of a signature is required only 5 standard deviations below the threshold.

Hub and membership tables are small rows of longs; a hot bucket is one row on the hub side, so the join
with it can be split. Intermediate tables are written to the shared folder and deleted when the components
are known.

Cases: null or empty text, or one without words, has an empty set, is linked with nothing and stays; rows
without doc_id are left out, as they cannot be named; of repeated rows with one doc_id that with the
smallest set counts (``keep_one`` keeps every row of a kept doc_id); an empty table gives an empty
result; other columns are ignored here and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import arrow_rows, make_room, mix, slices, table, text_bytes
from quireworks.staging import scratch, stage

WORDS, THRESHOLD = 5, 75
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
#: Rounds with hubs; members of a bucket that is compared together with others, and that a tile compares; bands that split a larger bucket.
ROUNDS, FEW, TILE, NEXT = 3, 32, 2048, 8
#: Members of small buckets that are compared by one call; documents that a Python worker is sent at once.
TOGETHER, BATCH = 8192, 2000
#: Shingles of the sets that are confirmed together, from either side.
CHUNK = 500_000
#: Bytes of two minima agree if the minima do, and by chance; a pair at the threshold has fewer that agree with a probability of about 3e-7.
_EQUAL = THRESHOLD / 100 + (1 - THRESHOLD / 100) / 256
AGREE = int(HASHES * _EQUAL - 5 * (HASHES * _EQUAL * (1 - _EQUAL)) ** 0.5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_B = mix(np.arange(10_001, 10_001 + HASHES, dtype=np.uint64) * _ODD)


def _word_hashes(data: np.ndarray, owner_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word; ``owner_starts`` are places where a new text begins."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[owner_starts[owner_starts < len(data)]] |= inside[owner_starts[owner_starts < len(data)]]
    start = np.flatnonzero(first)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    begins = np.zeros(len(data), np.int64)
    begins[start] = start
    place = (np.arange(len(data)) - np.maximum.accumulate(begins)).astype(np.uint64)
    value = mix((place + np.uint64(1)) * _ODD + mix(_LOWER[data] * _ODD + place))
    value[~inside] = 0
    return start, mix(np.add.reduceat(value, start))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    base, out = offsets[0], []
    for i, j in slices(offsets):
        lo, hi = offsets[i] - base, offsets[j] - base
        starts = offsets[i : j + 1] - offsets[i]
        begin, words = _word_hashes(data[base + lo : base + hi], starts[:-1])
        cut = np.searchsorted(begin, starts)
        shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS if len(shingles) else 0):
            shingles = (shingles + words[k : k + len(shingles)]) * _ODD
            shingles ^= shingles >> np.uint64(29)
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= WORDS:
                out.append(np.unique(mix(shingles[a : b - WORDS + 1])))
            elif b > a:
                value = np.uint64(b - a)
                for w in words[a:b]:
                    value = mix(np.array([value]) * _ODD + w)[0]
                out.append(np.array([value], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of the universal hashes (a * x + b) >> 32, one row per (non-empty) set."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 1 << 14):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[start:end])
        edges = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        hashed = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=hashed)
            hashed += _B[k]
            out[start:end, k] = np.minimum.reduceat(hashed, edges) >> np.uint64(32)
        start = end
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """The bucket of each band, one row per signature."""
    x = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)[None, :] + np.zeros((len(x), 1), np.uint64)
    for r in range(ROWS):
        key = mix(key * _ODD + x[:, :, r])
    return key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("neardup")
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in slices(offsets, 1 << 22):
            sets = shingle_sets(data, offsets[i : j + 1])
            minima = signatures([s for s in sets if len(s)])
            rows = zip(_band_keys(minima), minima.astype(np.uint8))
            pairs = [next(rows) if len(s) else (None, None) for s in sets]
            digest = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            columns = [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())]
            columns += [pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([None if p[1] is None else p[1].tobytes() for p in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "signature"])


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, signature) for ``docs`` (doc_id, text); the last three are null for an empty set."""
    return docs.mapInArrow(_sketch, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def _bytes_of(signature_column) -> np.ndarray:
    return np.frombuffer(b"".join(signature_column), np.uint8).reshape(-1, HASHES)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree often enough."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            x, y = (_bytes_of(part.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
            good = pa.array((x == y).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("neardup")
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in slices(offsets, 1 << 22):
            sets = [s.tobytes() for s in shingle_sets(data, offsets[i : j + 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["doc_id", "shingles"])


def _forest(labels: np.ndarray, side: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Pairs of places that join all whose signatures ``x`` agree often enough, of different labels (and sides)."""
    left, found = np.arange(len(labels)), [np.zeros((0, 2), np.int64)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = labels[left] != labels[i]
            if side is not None:
                near &= side[left] != side[i]
            near[near] = (x[left[near]] == x[i]).sum(axis=1) >= AGREE
            if near.any():
                found.append(np.stack([np.full(near.sum(), i), left[near]], axis=1))
                queue.extend(left[near])
                left = left[~near]
    return np.concatenate(found)


def _near(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b) that join the near members of each bucket of a tile, at most one for each member."""
    rows = frame.sort_values(["bucket", "rep"])
    ids, labels, side, bucket = (rows[c].to_numpy() for c in ("rep", "label", "part", "bucket"))
    x = _bytes_of(rows["signature"])
    found = [np.zeros((0, 2), np.int64)]
    for one in np.split(np.arange(len(ids)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
        found.append(ids[one][_forest(labels[one], side[one] if key[1] != key[2] else None, x[one])])
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def _near_packed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The pairs of ``_near``, each once, from packed parts of buckets."""
    sizes = [len(r) for r in parts["reps"]]
    frame = pd.DataFrame({c: np.repeat(parts[c].to_numpy(), sizes) for c in ("bucket", "part")})
    for c in ("rep", "label", "signature"):
        frame[c] = np.concatenate(parts[f"{c}s"].tolist())
    return _near(key, frame).drop_duplicates()


def _settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that the full sets confirm, one for every two components of a chunk that they join."""
    rows = frame.sort_values("rep")
    ids, labels, side = (rows[c].to_numpy() for c in ("rep", "label", "chunk"))
    labels, x = labels.copy(), _bytes_of(rows["signature"])
    sizes = np.array([len(s) // 8 for s in rows["shingles"]], np.int64)
    ends = np.cumsum(sizes)
    _, codes, often = np.unique(np.frombuffer(b"".join(rows["shingles"]), np.uint64), return_inverse=True, return_counts=True)
    several = (often > 1)[codes]  # what is in one set only is in no intersection
    places = np.concatenate([[0], np.cumsum(several)])
    starts, ends, codes = places[ends - sizes], places[ends], codes[several]
    mark, found = np.zeros(len(often), bool), []
    for i in range(len(ids)):
        near = labels != labels[i]
        near[: i + 1] = False
        if key[1] != key[2]:
            near &= side != side[i]
        near &= 100 * np.minimum(sizes, sizes[i]) >= THRESHOLD * np.maximum(sizes, sizes[i])
        near[near] = (x[near] == x[i]).sum(axis=1) >= AGREE
        others = np.flatnonzero(near)
        if not len(others):
            continue
        own = codes[starts[i] : ends[i]]
        mark[own] = True
        shared = np.concatenate([[0], np.cumsum(mark[np.concatenate([codes[starts[j] : ends[j]] for j in others])])])
        mark[own] = False
        edges = np.concatenate([[0], np.cumsum(ends[others] - starts[others])])
        both = shared[edges[1:]] - shared[edges[:-1]]
        linked = others[100 * both >= THRESHOLD * (sizes[i] + sizes[others] - both)]
        joined, first = np.unique(labels[linked], return_index=True)
        found += [(ids[i], ids[j]) for j in linked[first]]
        labels[np.isin(labels, joined)] = labels[i]
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])


def _confirm(_: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """The pairs whose full sets have 100 * intersection >= THRESHOLD * union."""
    nodes = sets["node"].to_numpy(np.int64)
    order = np.argsort(nodes)
    full = [np.frombuffer(s, np.uint64) for s in sets["shingles"].to_numpy()[order]]
    at_a, at_b = (np.searchsorted(nodes[order], pairs[c].to_numpy(np.int64)) for c in "ab")
    sizes = np.array([len(s) for s in full], np.int64)
    size_a, size_b = sizes[at_a], sizes[at_b]
    both = np.zeros(len(pairs), np.int64)
    possible = np.flatnonzero(100 * np.minimum(size_a, size_b) >= THRESHOLD * np.maximum(size_a, size_b))
    for k in possible:
        both[k] = len(np.intersect1d(full[at_a[k]], full[at_b[k]], assume_unique=True))
    good = 100 * both >= THRESHOLD * (size_a + size_b - both)
    return pairs.loc[good, ["a", "b"]]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``links`` (a, b).

    Alternates large-star (a node's larger neighbours are linked to its smallest) and small-star (its
    smaller ones and itself are) until the links stay the same; then every link leads to its smallest.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = stage(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


def _checked(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""
    for x in "ab":
        pairs = pairs.join(signed.select(F.col("rep").alias(x), F.col("signature").alias(f"sig_{x}")), x)
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement, "a bigint, b bigint")


def _by_hub(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of a hub a and its members, in chunks of the members of each hub."""
    sized = pairs.join(sets.select(F.col("doc_id").alias("b"), "n_shingles"), "b")
    parts = sized.groupBy("a").agg(F.ceil(F.sum("n_shingles") / CHUNK).cast("int").alias("parts"))
    return pairs.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("chunk"), "a", "b"), ["hub", "chunk"]


def _families(near: DataFrame, shared: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(component, low, high, rep, label, chunk, signature, shingles): members of each component of ``near``, in chunks on either side."""
    family = components(near)
    sized = family.join(sets.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    parts = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / CHUNK).cast("int").alias("parts"))
    placed = family.join(parts, "component").select("component", F.col("node").alias("rep"), "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("chunk"))
    placed = placed.join(shared.groupBy("rep").agg(F.min("label").alias("label")), "rep")
    placed = stage(placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "places")
    members = placed.join(signed.select("rep", "signature"), "rep").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    return members.select("component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "rep", "label", "chunk", "signature", "shingles")


def _links(grouped: DataFrame, keys: list[str], sets: DataFrame) -> DataFrame:
    """The pairs (keys, a, b) that the full ``sets`` (doc_id, n_shingles, shingles) confirm, written."""
    pairs = stage(grouped, "grouped-pairs")
    needed = pairs.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    members = needed.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    members = members.select(*(F.col(k).alias(k) for k in keys), "node", "shingles")  # columns of its own, for the cogroup
    return stage(pairs.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_confirm, "a bigint, b bigint"), "confirmed")


def _loose(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rep, label): members of buckets with more than one component, written."""
    labelled = shared.select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("bucket", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return stage(labelled.join(mixed, "bucket", "left_semi"), "loose")


def _across(loose: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each member b one member a of another component of one of its buckets; others in each round."""
    chance = F.xxhash64("rep", F.lit(turn))
    of = F.struct("label", chance.alias("chance"), "rep")
    ends = loose.groupBy("bucket").agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
    partner = F.when(F.col("label") == F.col("lo.label"), F.col("hi.rep")).otherwise(F.col("lo.rep"))
    met = loose.join(ends, "bucket").select("rep", partner.alias("other"))
    chosen = met.groupBy("rep").agg(F.min(F.struct(F.xxhash64("other", F.lit(turn)).alias("chance"), "other")).alias("best"))
    return chosen.select(F.col("best.other").alias("a"), F.col("rep").alias("b"))


def _tiles(sized: DataFrame, signed: DataFrame) -> DataFrame:
    """(key, lo, hi, bucket, part, reps, labels, signatures): members of buckets that are to be compared with each other, a row per part.

    Small buckets have a key together; of a larger one, every two parts have a tile. A member meets its
    signature once, however many buckets it is in.
    """
    groups = sized.count() // TOGETHER + 1
    plain = sized.where(F.col("size") <= TILE)
    key = F.when(F.col("size") <= FEW, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))
    plain = plain.select(key.alias("key"), "bucket", "rep", "label", F.lit(1).alias("parts"))
    second = f"transform(sequence(1, {NEXT}), d -> xxhash64(bucket, bands[int((array_position(bands, bucket) - 1 + d) % {BANDS})]))"
    large = sized.where(F.col("size") > TILE).groupBy("rep", "label").agg(F.collect_list("bucket").alias("buckets")).join(signed.select("rep", "bands"), "rep")
    large = large.select(F.explode(F.expr(f"flatten(transform(buckets, bucket -> {second}))")).alias("key"), "rep", "label")
    counts = large.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    split = large.join(counts.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "key")
    split = split.select("key", F.col("key").alias("bucket"), "rep", "label", "parts")
    places = plain.unionByName(split).groupBy("rep", "label").agg(F.collect_list(F.struct("key", "bucket", "parts")).alias("places"))
    members = places.join(signed.select("rep", "signature"), "rep").select(F.explode("places").alias("place"), F.struct("rep", "label", "signature").alias("member"))
    members = members.select("place.*", F.pmod(F.xxhash64("member.rep"), "place.parts").cast("int").alias("part"), "member")
    packed = members.groupBy("key", "bucket", "parts", "part").agg(F.collect_list("member").alias("members"))
    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    lists = (F.col(f"members.{c}").alias(f"{c}s") for c in ("rep", "label", "signature"))
    return tiles.select("key", "lo", "hi", "bucket", "part", *lists)


def _labels(docs: DataFrame, sketched: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """(node, component) of the representatives that are linked with others."""
    signed = stage(sketched.join(classes, sketched["doc_id"] == classes["rep"]).select("rep", "n_shingles", "bands", "signature"), "signatures")
    members = signed.select(F.explode("bands").alias("bucket"), "rep")
    hubs = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("bucket", "lo")
    shared = stage(members.join(hubs, "bucket"), "buckets")
    meeting = shared.groupBy(F.col("rep").alias("doc_id")).agg(F.min("lo").alias("lo"))
    meeting = stage(meeting, "meeting")
    sets = docs.join(meeting, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id bigint, shingles binary")
    if repeated:
        chosen = F.min(F.struct(F.length("shingles"), F.unhex(F.md5("shingles")), "shingles"))
        sets = sets.groupBy("doc_id").agg(chosen["shingles"].alias("shingles"))
    sets = stage(sets.withColumn("n_shingles", F.expr("length(shingles) div 8")), "sets")

    pairs = meeting.where("lo <> doc_id").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))
    stars = pairs.where("false")
    for turn in range(ROUNDS):
        pairs = _across(shared, turn) if turn else pairs
        more = _links(*_by_hub(stage(_checked(pairs, signed), "agreeing"), sets), sets)
        # the components found so far stand in for the links among their members
        labels = stage(components(stars.unionByName(more)), "components")
        stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        shared = _loose(shared, labels)
        if shared.isEmpty():
            return labels
    sized = stage(shared.join(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket"), "sized")
    near = _tiles(sized, signed).groupBy("key", "lo", "hi").applyInPandas(_near_packed, "a bigint, b bigint")
    members = _families(near.distinct(), sized, signed, sets)
    more = stage(members.groupBy("component", "low", "high").applyInPandas(_settle, "a bigint, b bigint"), "confirmed")
    return stage(components(stars.unionByName(more)), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL")
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, BATCH):
        sketched = stage(sketch(docs), "sketches")
        repeated = not sketched.groupBy("doc_id").count().where("count > 1").isEmpty()
        if repeated:  # a doc_id counts once, with its smallest set
            sketched = sketched.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "digest", "bands", "signature")).alias("s")).select("doc_id", "s.*")
        classes = stage(sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        labels = _labels(docs, sketched, classes, repeated)
        by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
        named = sketched.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
        component = F.coalesce("component_id", "doc_id")
        result = named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
        return stage(result, "near-duplicates", keep=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their component; rows without doc_id stay."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM split
), items AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM links)
    UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), least AS (
    SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON node = doc_id
"""
