"""Removal of long repeats with run-length indexes.

A byte goes if it lies in a string of ``LONG`` bytes that also starts in a document with a smaller doc_id.

1. *Anchors.* Of the ``GRAM``-byte strings that start in any ``REACH`` successive places the one with the
   smallest hash is an anchor, so every string of LONG bytes holds one, chosen by its content alone. Tasks
   send the anchors of their documents in packed arrays; an anchor that several documents of a task have is
   sent once. Anchors that more than one document has are answered to these documents.
2. *Contexts.* What surrounds a repeated anchor (up to ``LONG - GRAM`` bytes on either side) holds every
   long string with that anchor. Equal contexts are one class; a context whose class has an earlier
   document is covered whole. Within a task this is settled before anything is sent.
3. *Index.* Classes that share an anchor with others may still share shorter matches. Each bucket of
   anchors builds a run-compressed Burrows-Wheeler transform of its contexts and keeps, per run end, a
   sample of the text position with its lexicographic neighbour and the length they share. Streaming the
   contexts against the samples gives for every place its matching statistics: neighbour and length. Places
   that match for LONG bytes or more are chained, and each chain's smallest document decides.
4. An anchor that more than ``HOT`` documents have never enters a bucket: the long strings around it
   are hashed one by one, reduced before the shuffle to their smallest document, and joined back.

Cases: null and empty texts have nothing to remove; texts shorter than LONG stay whole; a null doc_id is
neither earlier nor later than others, so its row stays whole; rows with equal doc_id do not remove from
each other; an empty table gives an empty result; other columns are ignored. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import mix, slices, table, text_bytes
from quireworks.staging import stage

LONG, GRAM = 50, 20
REACH, SIDE = LONG - GRAM + 1, LONG - GRAM
HOT = 50_000
#: Text bytes that a task takes together, bytes of packed anchors per bucket, bytes of a long text at a time.
GROUP, BUCKET, PIECE = 64 << 20, 2 << 20, 1 << 22
_MAX_BUCKETS = 200_000
#: Different texts with one doc_id are told apart by this bit and those above it in their places.
VARIANT = 36
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = mix(np.arange(1, 2 * SIDE + 3, dtype=np.uint64) * _BASE) | np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place, by doubling."""
    one = mix((data.astype(np.uint64) + np.uint64(1)) * _BASE)
    powers, levels, width = [_BASE], [one], 1
    while width * 2 <= GRAM:
        last = levels[-1]
        levels.append(last[:-width] * powers[-1] + last[width:])
        with np.errstate(over="ignore"):
            powers.append(powers[-1] * powers[-1])
        width *= 2
    total, at = None, 0
    n = len(data) - GRAM + 1
    for level in range(len(levels) - 1, -1, -1):
        if GRAM & (1 << level):
            part = levels[level][at : at + n]
            total = part.copy() if total is None else total * powers[level] + part
            at += 1 << level
    return mix(total)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (from offsets[0]) and hashes of the anchors of a few texts, or of one text of any length."""
    base, size = offsets[0], offsets[-1] - offsets[0]
    if len(offsets) == 2 and size >= PIECE + LONG:
        found = [anchors(data, np.array([lo, min(lo + PIECE + LONG - 1, offsets[-1])])) for lo in range(base, offsets[-1] - LONG + 1, PIECE)]
        places = np.concatenate([p + i * PIECE for i, (p, _) in enumerate(found)])
        places, first = np.unique(places, return_index=True)
        return places, np.concatenate([h for _, h in found])[first]
    if size < LONG:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _gram_hashes(data[base : offsets[-1]])
    key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (REACH - width)], key[REACH - width :])
    ends = np.repeat(offsets[1:] - base, np.diff(offsets))[: len(key)]
    places = (key[np.arange(len(key)) + LONG <= ends] & _PLACE).astype(np.int64)
    places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places  # they never go back
    return places, hashes[places]


def contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For anchors at ``places`` of texts [start, end): side bytes, bytes before, bytes after, hash of all that."""
    before, after = np.minimum(places - start, SIDE), np.minimum(end - places - GRAM, SIDE)
    shift = np.concatenate([np.arange(-SIDE, 0), np.arange(GRAM, GRAM + SIDE)])
    at = places[:, None] + shift
    there = np.concatenate([np.arange(SIDE, 0, -1) <= before[:, None], np.arange(SIDE) < after[:, None]], axis=1)
    sides = np.where(there, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
    wide = np.column_stack([sides, before, after]).astype(np.uint64) + np.uint64(1)
    return sides, before.astype(np.uint8), after.astype(np.uint8), mix((mix(wide * _BASE) * _WEIGHTS).sum(axis=1, dtype=np.uint64))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    rows = len(raw) // sum(np.dtype(k).itemsize * w for k, w in kinds)
    out, at = [], 0
    for kind, width in kinds:
        size = rows * width * np.dtype(kind).itemsize
        part = np.frombuffer(raw, kind, rows * width, at)
        out.append(part.reshape(rows, width) if width > 1 else part)
        at += size
    return out


#: What the rows that go to a bucket hold: anchors, or what a task has settled and only passes on.
_ANCHORS, _SETTLED = 0, 1
_ROW = "bucket int, kind int, packed binary"


def _bucket_rows(bucket, kind: int, packed: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array([kind] * len(packed), pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "packed"])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    numbers, cut = np.unique(bucket[order], return_index=True)
    yield from zip(numbers.tolist(), np.split(order, cut[1:]) if len(order) else [])


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0)).astype("<i8")


def _send_anchors(buckets: int):
    """Rows for buckets: per anchor (gram, doc or -1 if several of the task have it, number of docs, which tells; ids may be negative); and,
    settled, (doc, gram) of anchors that several documents of the task have.

    A gram is the upper 48 bits of the hash: enough to ask whether it is repeated.
    """

    def given_out(hashes: list, docs: list) -> Iterator[pa.RecordBatch]:
        h, d = np.concatenate(hashes) >> np.uint64(16), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[fresh], d[fresh]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(h)))
        several = np.flatnonzero(np.repeat(count > 1, count))
        for part in np.array_split(several, len(several) // 400_000 + 1):
            if len(part):
                spread = int(mix(h[part[:1]])[0] % np.uint64(buckets))
                part = part[np.argsort(d[part], kind="stable")]
                yield _bucket_rows([spread], _SETTLED, [_pack(_steps(d[part]), h[part])])
        one, doc = h[start], np.where(count > 1, -1, d[start])
        order = np.argsort(doc, kind="stable")
        one, doc, count = one[order], doc[order], count[order]
        rows = list(_by_bucket((one % np.uint64(buckets)).astype(np.int64)))
        packed = [_pack(one[i].astype("<u8")[:, None].view(np.uint8)[:, :6], _steps(doc[i]), count[i].astype(np.int32)) for _, i in rows]
        yield _bucket_rows([n for n, _ in rows], _ANCHORS, packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, size = [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in slices(offsets):
                places, found = anchors(data, offsets[i : j + 1])
                row = np.searchsorted(offsets[i : j + 1] - offsets[i], places, side="right") - 1
                hashes.append(found)
                docs.append(ids[i:j][row])
                size += offsets[j] - offsets[i]
                if size > GROUP:
                    yield from given_out(hashes, docs)
                    hashes, docs, size = [], [], 0
        if hashes:
            yield from given_out(hashes, docs)

    return run


def _answer(hot: int):
    def run(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """(doc_id, gram) of repeated anchors; a row without doc_id names one that more than ``hot`` documents have."""
        docs, grams, common = [], [], np.zeros(0, np.int64)
        for packed in frame["packed"][frame["kind"] == _SETTLED]:
            steps, gram = _unpack(packed, ("<i8", 1), ("<i8", 1))
            docs.append(np.cumsum(steps))
            grams.append(gram)
        asked = [_unpack(p, ("u1", 6), ("<i8", 1), ("<i4", 1)) for p in frame["packed"][frame["kind"] == _ANCHORS]]
        if asked:
            six, doc, count = np.concatenate([x[0] for x in asked]), np.concatenate([np.cumsum(x[1]) for x in asked]), np.concatenate([x[2] for x in asked])
            h = np.zeros((len(six), 8), np.uint8)
            h[:, :6] = six
            h = h.view("<i8").ravel()
            order = np.argsort(h, kind="stable")
            h, doc, count = h[order], doc[order], count[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total, size = np.add.reduceat(count.astype(np.int64), start), np.diff(np.append(start, len(h)))
            told = (np.repeat(total > 1, size)) & (count == 1)
            docs.append(doc[told])
            grams.append(h[told])
            common = h[start][total > hot]
        doc, gram = np.concatenate(docs), np.concatenate(grams)
        ids = pd.array(np.concatenate([doc, np.zeros(len(common), np.int64)]), "Int64")
        ids[len(doc) :] = pd.NA
        return pd.DataFrame({"doc_id": ids, "gram": np.concatenate([gram, common])})

    return run


_OCCURRENCE = (("<u8", 1), ("<u8", 1), ("<i8", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("u1", 2 * SIDE))
_CONTEXT_ROW = f"{_ROW}, string bigint, doc_id bigint, lo bigint, hi bigint"
_CHUNK = 50_000


def _padded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for a bucket among rows of strings."""
    nulls = [pa.nulls(batch.num_rows, pa.int64())] * 4
    return pa.RecordBatch.from_arrays([*batch.columns, *nulls], [*batch.schema.names, "string", "doc_id", "lo", "hi"])


def _members(row: np.ndarray, hashes: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether the gram of each hash is in the list of its row."""
    sizes, values = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), sizes).astype(np.uint64)
    return np.isin(mix((hashes >> np.uint64(16)) * _BASE + row.astype(np.uint64)), mix(values.view(np.uint64) * _BASE + of))


def _send_contexts(buckets: int):
    """From (doc_id, variant, packed, grams, hot): occurrences and settled stretches for buckets, strings at hot anchors."""

    def given_out(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, doc, place, before, after, sides = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, doc, c, h))
        h, c, doc, place, before, after = (x[order] for x in (h, c, doc, place, before, after))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = doc > first
        settled = _merged(doc[later], (place - before)[later], (place + GRAM + after)[later])
        for lo in range(0, len(settled), 400_000):
            part = settled.iloc[lo : lo + 400_000]
            spread = int(mix(h[:1] + np.uint64(lo))[0] % np.uint64(buckets))
            yield _padded(_bucket_rows([spread], _SETTLED, [_pack(*(part[x].to_numpy() for x in ("doc_id", "lo", "hi")))]))
        keep = np.flatnonzero(~later)
        rows = [(n, keep[i]) for n, i in _by_bucket((h[keep] % np.uint64(buckets)).astype(np.int64))]
        packed = [_pack(h[i], c[i], doc[i], place[i], before[i], after[i], sides[order[i]]) for _, i in rows]
        yield _padded(_bucket_rows([n for n, _ in rows], _ANCHORS, packed))

    def strings(data: np.ndarray, places: np.ndarray, doc_id: int, lead: int) -> Iterator[pa.RecordBatch]:
        """The long strings around hot anchors of a text."""
        starts = np.unique((places[:, None] + np.arange(-SIDE, 1)).ravel())
        starts = starts[(starts >= 0) & (starts + LONG <= len(data))]
        for lo in range(0, len(starts), _CHUNK):
            part = starts[lo : lo + _CHUNK]
            x = np.lib.stride_tricks.sliding_window_view(data, LONG)[part].astype(np.uint64)
            hashed = mix((mix((x + np.uint64(1)) * _BASE) * _WEIGHTS[:LONG]).sum(axis=1, dtype=np.uint64))
            size = len(part)
            columns = [hashed.view(np.int64), np.full(size, doc_id), lead + part, lead + part + LONG]
            nulls = [pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, *map(pa.array, columns)], ["bucket", "kind", "packed", "string", "doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        squeezed = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                texts = [squeezed.decompress(t) for t in batch.column("packed").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                data = np.frombuffer(b"".join(texts), np.uint8)
                ids = batch.column("doc_id").to_numpy()
                lead = batch.column("variant").to_numpy().astype(np.int64) << VARIANT
                for i, j in slices(offsets):
                    places, hashes = anchors(data, offsets[i : j + 1])
                    places = places + offsets[i]
                    row = np.searchsorted(offsets, places, side="right") - 1
                    common = _members(row, hashes, batch.column("hot"))
                    for r in np.unique(row[common]):
                        yield from strings(data[offsets[r] : offsets[r + 1]], places[common & (row == r)] - offsets[r], ids[r], lead[r])
                    told = np.flatnonzero(_members(row, hashes, batch.column("grams")) & ~common)
                    for lo in range(0, len(told), _CHUNK):
                        k = told[lo : lo + _CHUNK]
                        start = offsets[row[k]]
                        sides, before, after, c = contexts(data, start, offsets[row[k] + 1], places[k])
                        found.append((hashes[k], c, ids[row[k]], places[k] - start + lead[row[k]], before, after, sides))
                    size += offsets[j] - offsets[i] + 100 * len(told)
                    if size > GROUP and found:
                        yield from given_out(found)
                        found, size = [], 0
        if found:
            yield from given_out(found)

    return run


class RunIndex:
    """Run-compressed transform of some short texts, with samples at the run ends.

    Suffixes are ordered by content and then by text. ``heads`` are the symbols of the runs (0: none, before
    a text's first byte), ``lengths`` their lengths. ``sampled`` are the places just before a run's first
    suffix and the ends of the texts, in order, with the preceding suffix (``neighbour``) and the length
    shared with it (``shared``). Between samples both follow by counting down.
    """

    def __init__(self, texts: np.ndarray, lengths: np.ndarray) -> None:
        width = texts.shape[1] + 1
        symbols = np.zeros((len(texts), width), np.uint16)
        symbols[:, :-1] = np.where(np.arange(width - 1) < lengths[:, None], texts.astype(np.uint16) + 1, 0)
        used = np.arange(width) <= lengths[:, None]  # the end mark of a text is a place too
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)])
        flat = symbols[used]
        order = self._sorted(flat, np.repeat(self.start[1:], lengths + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.zeros(len(flat), bool)
        first[self.start[:-1]] = True
        ends = self.start[1:] - 1
        bwt = np.where(first[order], 0, flat[order - 1])
        run = np.ones(len(order), bool)
        run[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        begins = np.flatnonzero(run)
        self.heads, self.lengths = bwt[begins], np.diff(np.append(begins, len(order)))
        before = order[begins]
        sampled = np.zeros(len(flat), bool)
        sampled[before[~first[before]] - 1] = True
        sampled[ends] = True
        self.sampled = np.flatnonzero(sampled)
        row = place[self.sampled]
        self.neighbour = np.where(row > 0, order[row - 1], -1)
        self.shared = self._shared(flat, self.sampled, self.neighbour, width)

    @staticmethod
    def _sorted(flat: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the compared length; ``stop``: where the text of a place ends."""
        n = len(flat)
        padded = np.concatenate([flat, np.zeros(7, np.uint16)]).astype(np.int64)
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(7):
            alive = alive & (np.arange(n) + k < stop)
            key = (key << 9) | np.where(alive, padded[k : k + n], 0)
        # ``rank``: the first slot of those that are equal so far; only they are sorted again, within their slots
        order, rank, slots, length = np.arange(n), np.zeros(n, np.int64), np.arange(n), 7
        while len(slots):
            by = np.argsort(key)
            order[slots] = order[slots][by]
            key = key[by]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            slots = slots[~(fresh & np.append(fresh[1:], True))]
            tied = order[slots]
            if length > 2 * SIDE + GRAM:
                order[slots] = np.sort(rank[tied] * n + tied) % n
                break
            ahead = tied + length
            key = rank[tied] * (n + 2) + np.where(ahead < stop[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
            length *= 2
        return order

    @staticmethod
    def _shared(flat: np.ndarray, one: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
        """Length of what the texts share from each place on; most differ early, so few are compared far."""
        out = np.zeros(len(one), np.int64)
        padded = np.concatenate([flat, np.zeros(width + 1, np.uint16)])
        left, at = np.flatnonzero(other >= 0), 0
        while at < width and len(left):
            further, step = [], min(12 if at == 0 else width, width - at)
            for lo in range(0, len(left), 50_000):
                part = left[lo : lo + 50_000]
                x, y = (padded[c[part, None] + np.arange(at, at + step)] for c in (one, other))
                differ = (x != y) | (x == 0)
                ended = differ.any(axis=1)
                out[part] = at + np.where(ended, differ.argmax(axis=1), step)
                further.append(part[~ended])
            left, at = np.concatenate(further), at + step
        return out

    def statistics(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the place that precedes it lexicographically and how many bytes both share."""
        at = np.searchsorted(self.sampled, places)
        ahead = self.sampled[at] - places
        return self.neighbour[at] - ahead, self.shared[at] + ahead


def covered(texts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each LONG-byte string that some text of a smaller doc holds as well."""
    index = RunIndex(texts, lengths)
    many = np.maximum(lengths - LONG + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    places = index.start[:-1][owner] + offset
    neighbour, shared = index.statistics(places)
    number = np.full(index.start[-1], -1)
    number[places] = np.arange(len(places))
    chained = shared >= LONG
    head = np.where(chained, number[np.where(chained, neighbour, 0)], np.arange(len(places)))
    while True:  # every chain ends at a place that shares less with its neighbour
        further = head[head]
        if (further == head).all():
            break
        head = further
    least = np.full(len(places), np.iinfo(np.int64).max)
    np.minimum.at(least, head, docs[owner])
    hit = least[head] < docs[owner]
    return owner[hit], offset[hit]


def _index_bucket(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Covered stretches (doc_id, lo, hi) from the occurrences of a bucket of anchors."""
    settled = [_unpack(p, ("<i8", 1), ("<i8", 1), ("<i8", 1)) for p in frame["packed"][frame["kind"] == _SETTLED]]
    parts = [_unpack(p, *_OCCURRENCE) for p in frame["packed"][frame["kind"] == _ANCHORS]]
    if not parts:
        return _merged(*(np.concatenate(x) for x in zip(*settled)))
    h, c, doc, place, before, after, sides = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, c, h))
    h, c, doc, place, before, after = (x[order] for x in (h, c, doc, place, before, after))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    owner = np.cumsum(fresh) - 1
    start = np.flatnonzero(fresh)
    first = doc[start]
    later = doc > first[owner]
    out = [*settled, (doc[later], (place - before)[later], (place + GRAM + after)[later])]
    alone = np.ones(len(start), bool)
    same = h[start][1:] == h[start][:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    several = np.flatnonzero(~alone)
    if len(several):
        lead = start[several]
        left, right = before[lead].astype(np.int64), after[lead].astype(np.int64)
        side = sides[order[lead]]
        # The anchor's own bytes are the same within an anchor; eight of its hash stand for them.
        gram = np.zeros((len(lead), GRAM), np.uint8)
        gram[:, :8] = h[lead].astype("<u8")[:, None].view(np.uint8)
        whole = np.concatenate([side[:, :SIDE], gram, side[:, SIDE:]], axis=1)
        shift = np.arange(whole.shape[1]) + (SIDE - left)[:, None]
        texts = np.take_along_axis(whole, np.minimum(shift, whole.shape[1] - 1), axis=1)
        text, offset = covered(texts, left + GRAM + right, first[several])
        # Every occurrence of the class in its first document.
        hits = np.bincount(text, minlength=len(several))
        begin = np.cumsum(hits) - hits
        slot = np.full(len(start), -1)
        slot[several] = np.arange(len(several))
        mine = np.flatnonzero(~later & (slot[owner] >= 0))
        mine = mine[hits[slot[owner[mine]]] > 0]
        count = hits[slot[owner[mine]]]
        at = np.repeat(begin[slot[owner[mine]]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where = np.repeat(mine, count)
        lo = place[where] - before[where] + offset[at]
        out.append((doc[where], lo, lo + LONG))
    d, lo, hi = (np.concatenate(x) for x in zip(*out))
    return _merged(d, lo, hi)


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Stretches with those that touch or overlap put together, by document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    if len(doc):
        row = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        span = int(hi.max()) + 1
        reach = np.maximum.accumulate(hi + row * span)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = lo[1:] + row[1:] * span > reach[:-1]
        start = np.flatnonzero(fresh)
        doc, lo, hi = doc[start], lo[start], np.maximum.reduceat(hi, start)
    return pd.DataFrame({"doc_id": doc, "lo": lo, "hi": hi})


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        packed = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("variant"), pa.array(packed, pa.binary())], ["doc_id", "variant", "packed"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, packed, lo, hi): the text's length, what goes, and what stays."""
    squeezed = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
            row = np.repeat(np.arange(part.num_rows), part.column("lo").value_lengths().fill_null(0).to_numpy())
            marks = _merged(row, *(part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lo", "hi")))
            lo, hi = marks["lo"].to_numpy(), marks["hi"].to_numpy()
            cut = np.searchsorted(marks["doc_id"].to_numpy(), np.arange(part.num_rows + 1))
            gone = np.diff(np.concatenate([[0], np.cumsum(hi - lo)])[cut])
            sizes, kept = [], []
            for i, packed in enumerate(part.column("packed").to_pylist()):
                data = squeezed.decompress(packed)
                a, b = cut[i], cut[i + 1]
                sizes.append(len(data))
                kept.append(b"".join(data[x:y] for x, y in zip([0, *hi[a:b].tolist()], [*lo[a:b].tolist(), len(data)])) if a < b else data)
            columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, np.diff(cut))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _with_variants(docs: DataFrame) -> DataFrame:
    """(doc_id, text, variant): the number of a text among those of its doc_id, 0 where every doc_id has one."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    texts = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"))
    if texts.where("least <> most").isEmpty():
        return docs.withColumn("variant", F.lit(0))
    return docs.withColumn("variant", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")))


def repeated_stretches(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, lo, hi) of bytes to remove from ``docs`` (doc_id, text, variant); stretches may overlap."""
    docs = docs.where("doc_id IS NOT NULL")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(_MAX_BUCKETS, 1 + size * 2 // BUCKET // 3)
    sent = docs.mapInArrow(_send_anchors(buckets), _ROW)
    answers = stage(sent.groupBy("bucket").applyInPandas(_answer(hot), "doc_id bigint, gram bigint"), "answers")
    told, common = answers.where("doc_id IS NOT NULL"), answers.where("doc_id IS NULL").select("gram", F.lit(True).alias("is_hot"))
    some_hot = not common.isEmpty()
    told = told.join(common, "gram", "left") if some_hot else told.withColumn("is_hot", F.lit(False))
    told = told.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.when(F.col("is_hot"), F.col("gram"))).alias("hot"))
    packed = docs.mapInArrow(_compress, "doc_id bigint, variant int, packed binary").join(told, "doc_id")
    seen = packed.mapInArrow(_send_contexts(buckets), _CONTEXT_ROW)
    seen = stage(seen, "contexts") if some_hot else seen
    kept = seen.where("bucket IS NOT NULL").select("bucket", "kind", "packed")
    indexed = kept.groupBy("bucket").applyInPandas(_index_bucket, "doc_id bigint, lo bigint, hi bigint")
    if not some_hot:
        return indexed
    strings = seen.where("string IS NOT NULL")
    least = strings.groupBy("string").agg(F.min("doc_id").alias("first"))
    return indexed.unionByName(strings.join(least, "string").where("first < doc_id").select("doc_id", "lo", "hi"))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for ``docs`` (doc_id, text); ``kept`` is what stays, in bytes."""
    docs = _with_variants(docs)
    marks = repeated_stretches(docs, hot).withColumn("variant", F.shiftright("lo", VARIANT).cast("int"))
    place = (F.col(c).bitwiseAND(F.lit((1 << VARIANT) - 1)) for c in ("lo", "hi"))
    marks = marks.select("doc_id", "variant", *(p.alias(c) for p, c in zip(place, ("lo", "hi"))))
    marks = marks.groupBy("doc_id", "variant").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    packed = docs.mapInArrow(_compress, "doc_id bigint, variant int, packed binary").join(marks, ["doc_id", "variant"], "left")
    return packed.mapInArrow(_remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op10_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
