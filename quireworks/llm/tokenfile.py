"""Token ids in binary files of directly addressable codes.

A file holds the ids of consecutive documents. Each id is cut into chunks of given widths, lowest bits
first; level k keeps the k-th chunks of all ids that have one, packed bit by bit, with a bitmap that says
which of them go on to level k + 1 and a directory of ranks for every 512 bits of it. Where an id goes on
at level k + 1 is the number of set bits before it, so any id, and any run of ids, is read from a few byte
ranges of the file without decoding others. Widths are chosen for each file so that it becomes smallest.

The files are a Spark data source (``token_files``): tasks write files, the commit writes a manifest that
lists in order those of successful tasks only, and one file is one partition when read. So a lost executor
or a repeated task leaves at most a file that no manifest lists. Files lie wherever ``pyarrow.fs`` can go
(file, hdfs, s3, gs, abfs); the operator puts them into the folder that the cluster shares.

Encoding takes texts apart where words of the tokenizer's pattern always end (before white space, between
letters, digits and signs; a text with a special token whole), has the tokenizers library encode the
distinct pieces of some MB of text, and puts the ids of the documents together from theirs.

Cases: a null text counts as empty; an empty text has the end id alone; texts of any length are encoded
whole; null ids of documents come first; repeated rows are written each, in an order that depends on their
content; an empty table gives no files and no rows; other columns of the documents, whatever their names,
are not taken along. Ids are 0 to 2^31 - 1; a null list counts as empty, an id out of that range is an error.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quireworks.llm.bpe import byte_letters
from quireworks.llm.common import slices, table, text_bytes
from quireworks.staging import fresh_path

MAGIC = b"QWTOKEN1"
#: Ids that a file holds; a longer document has a file of its own.
FILE_TOKENS = 4_000_000
#: Ids that a reader decodes together.
READ_TOKENS = 1_000_000
#: Text that an encoder takes together, pieces that the tokenizer gets in one call, and pieces that are kept.
GROUP_BYTES, CALL, PIECES = 4 << 20, 1_000, 200_000
#: Bits of a continuation bitmap for each entry of its rank directory.
RANK_BITS = 512
_MANIFEST = "manifest.parquet"


# ---------------------------------------------------------------- codes


def best_widths(lengths: np.ndarray) -> list[int]:
    """Chunk widths that take the fewest bits; ``lengths[b]`` ids have b significant bits."""
    most = len(lengths) - 1
    longer = [int(lengths[i + 1 :].sum()) for i in range(most + 1)]  # ids with more than i bits
    longer[0] = int(lengths.sum())
    cost, width = [0.0] * (most + 1), [0] * (most + 1)
    for i in range(most - 1, -1, -1):
        if not longer[i]:
            continue
        goes_on = [(1 + 32 / RANK_BITS) if i + w < most and longer[i + w] else 0 for w in range(most - i + 1)]
        cost[i], width[i] = min((longer[i] * (w + goes_on[w]) + cost[i + w], w) for w in range(1, most - i + 1))
    out, i = [], 0
    while i < most and longer[i]:
        out.append(width[i])
        i += width[i]
    return out


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids have 1, 2, ... 31 significant bits; zero counts as one bit."""
    found = np.zeros(32, np.int64)
    for at in range(0, len(ids), 1 << 18):
        found += np.bincount(np.maximum(np.frexp(ids[at : at + (1 << 18)].astype(np.float64))[1], 1), minlength=32)
    return found


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, lowest first."""
    shifts = np.arange(width, dtype=np.uint32)
    parts = []
    for at in range(0, len(values), 1 << 18):  # a multiple of 8, so each part ends on a byte
        bits = (values[at : at + (1 << 18), None] >> shifts) & np.uint32(1)
        parts.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(data: bytes, skip: int, count: int, width: int) -> np.ndarray:
    """``count`` values of ``width`` bits that begin ``skip`` bits into ``data``."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=skip + count * width, bitorder="little")[skip:].reshape(count, width)
    out = np.zeros(count, np.uint32)
    for k in range(width):
        out |= bits[:, k].astype(np.uint32) << np.uint32(k)
    return out


def file_bytes(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The content of a file with ``lengths`` ids of each document."""
    sections: list[tuple[str, bytes]] = [
        ("known", np.asarray(doc_ids.is_valid(), np.uint8).tobytes()),
        ("doc_id", np.asarray(doc_ids.fill_null(0), "<i8").tobytes()),
        ("end", np.cumsum(lengths).astype("<i8").tobytes()),
    ]
    widths = best_widths(_bit_lengths(ids)) if len(ids) else []
    rest = ids.astype(np.uint32)
    for level, width in enumerate(widths):
        sections.append((f"chunks{level}", pack(rest & np.uint32((1 << width) - 1), width)))
        if level + 1 < len(widths):
            goes_on = rest >= np.uint32(1 << width)
            padded = np.zeros(-(-len(goes_on) // RANK_BITS) * RANK_BITS, np.uint8)
            padded[: len(goes_on)] = goes_on
            counts = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.int64)
            sections.append((f"bits{level}", np.packbits(padded, bitorder="little").tobytes()))
            sections.append((f"ranks{level}", (np.cumsum(counts) - counts).astype("<u4").tobytes()))
            rest = rest[goes_on] >> np.uint32(width)
    places, at = {}, 0
    for name, data in sections:
        places[name] = at
        at += len(data)
    head = json.dumps({"docs": len(lengths), "tokens": len(ids), "widths": widths, "places": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(data for _, data in sections)])


class TokenFile:
    """Reads runs of ids from an open file (``pyarrow`` random access file)."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        first = file.read_at(16, 0)
        if first[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(first[8:], "little")
        head = json.loads(file.read_at(size, 16))
        self.body = 16 + size
        self.docs, self.size, self.widths, self.places = head["docs"], head["tokens"], head["widths"], head["places"]

    def _read(self, section: str, start: int, size: int) -> bytes:
        return self.file.read_at(size, self.body + self.places[section] + start)

    def doc_ids(self) -> pa.Array:
        known = np.frombuffer(self._read("known", 0, self.docs), np.uint8)
        return pa.array(np.frombuffer(self._read("doc_id", 0, 8 * self.docs), "<i8"), pa.int64(), mask=known == 0)

    def ends(self) -> np.ndarray:
        return np.frombuffer(self._read("end", 0, 8 * self.docs), "<i8")

    def _rank(self, level: int, position: int) -> int:
        """Set bits before ``position``: a directory entry and the bits from there on."""
        if not position:
            return 0
        block = (position - 1) // RANK_BITS
        entry = int.from_bytes(self._read(f"ranks{level}", 4 * block, 4), "little")
        inside = position - block * RANK_BITS
        data = self._read(f"bits{level}", block * RANK_BITS // 8, -(-inside // 8))
        return entry + int(np.unpackbits(np.frombuffer(data, np.uint8), count=inside, bitorder="little").sum())

    def _run(self, section: str, start: int, count: int, width: int) -> np.ndarray:
        first, last = start * width, (start + count) * width
        return unpack(self._read(section, first // 8, -(-last // 8) - first // 8), first % 8, count, width)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) of the file."""
        start, end = max(start, 0), min(end, self.size)
        out = np.zeros(max(end - start, 0), np.uint32)
        places, below = np.arange(len(out)), 0
        for level, width in enumerate(self.widths):
            if not len(places):
                break
            out[places] |= self._run(f"chunks{level}", start, len(places), width) << np.uint32(below)
            if level + 1 < len(self.widths):
                goes_on = self._run(f"bits{level}", start, len(places), 1) > 0
                start = self._rank(level, start)
                places, below = places[goes_on], below + width
        return out


# ---------------------------------------------------------------- data source


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int, int]]  # name, documents, ids


@dataclass
class Listed(InputPartition):
    file: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_tokens: int, tokenizer: str | None, end: int) -> None:
        self.path, self.file_tokens, self.end = path, file_tokens, end
        self.spec = read_spec(tokenizer) if tokenizer else None

    def _lists(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Ids of documents and lists of token ids; texts are encoded here, some MB at a time."""
        docs, column = batch.column(0).cast(pa.int64()), batch.column(1)
        if self.spec is None:
            yield docs, column
            return
        at = 0
        for ids in encoder_for(self.spec)(column, self.end):
            yield docs.slice(at, len(ids)), ids
            at += len(ids)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        partition, files = TaskContext.get().partitionId(), []
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if not waiting:
                return
            docs, lengths, ids = (list(part) for part in zip(*waiting))
            data = file_bytes(pa.concat_arrays(docs), np.concatenate(lengths), np.concatenate(ids))
            name = f"{partition:06d}-{len(files):04d}-{uuid.uuid4().hex}.tokens"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            files.append((name, sum(map(len, docs)), held))
            waiting.clear()
            held = 0

        for docs, column in (part for batch in iterator for part in self._lists(batch)):
            lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
            ids = np.asarray(column.flatten())
            if len(ids) and ids.min() < 0:
                raise ValueError("token ids must be 0 to 2147483647")
            ends, row = np.concatenate([[0], np.cumsum(lengths)]), 0
            while row < len(docs):
                fits = int(np.searchsorted(ends, ends[row] + self.file_tokens - held, "right")) - 1
                if fits <= row and waiting:
                    flush()
                    continue
                upto = min(max(fits, row + 1), len(docs))
                waiting.append((docs.slice(row, upto - row), lengths[row:upto], ids[ends[row] : ends[upto]].copy()))
                held += int(ends[upto] - ends[row])
                row = upto
        flush()
        return Written(partition, files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        tokens = np.array([f[2] for f in files], np.int64)
        listed = pa.table(
            {
                "file": pa.array([f[0] for f in files], pa.string()),
                "start": pa.array(np.cumsum(tokens) - tokens, pa.int64()),
                "tokens": pa.array(tokens, pa.int64()),
                "docs": pa.array([f[1] for f in files], pa.int64()),
            }
        )
        fs, folder = file_system(self.path)
        fs.create_dir(folder, recursive=True)
        if fs.get_file_info(f"{folder}/{_MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a token table already")
        with fs.open_output_stream(f"{folder}/{_MANIFEST}") as out:
            pq.write_table(listed, out)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        for name, _, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{name}")


def manifest(path: str) -> pa.Table:
    """(file, start, tokens, docs) in order; ``start`` counts the ids of all files before."""
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/{_MANIFEST}") as file:
        return pq.read_table(file)


class _Reader(DataSourceReader):
    def __init__(self, path: str, checksums: bool) -> None:
        self.path, self.checksums = path, checksums

    def partitions(self) -> list[Listed]:
        listed = manifest(self.path).to_pydict()
        return [Listed(f, s) for f, s in zip(listed["file"], listed["start"])] or [Listed("", 0)]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, folder = file_system(self.path)
        with fs.open_input_file(f"{folder}/{partition.file}") as opened:
            file = TokenFile(opened)
            docs, ends = file.doc_ids(), np.concatenate([[0], file.ends()])
            for first, last in slices(ends, READ_TOKENS):
                base = int(ends[first])
                ids, bounds = file.ids(base, int(ends[last])), ends[first : last + 1] - base
                columns = [docs.slice(first, last - first), pa.array(ends[first:last] + partition.start), pa.array(np.diff(bounds))]
                if self.checksums:
                    sums = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """``token_files``: (doc_id, ids) or (doc_id, text) are written in the order of the rows; (doc_id, start, n_tokens, ids) are read.

    Options of the writer: ``file_tokens``; for texts ``tokenizer``, the path of its JSON on the driver, and ``end``.
    Of the reader: ``checksums`` gives ``ids_crc32``, of the ids as unsigned little-endian numbers, instead of the ids.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def _checksums(self) -> bool:
        return self.options.get("checksums", "false").lower() == "true"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if self._checksums() else "ids array<int>")

    def writer(self, schema, overwrite: bool) -> _Writer:
        options = self.options
        tokenizer = options.get("tokenizer")
        if (tokenizer is not None) != (schema[1].dataType.typeName() == "string"):
            raise ValueError("texts need a tokenizer, and lists of ids none")
        return _Writer(options["path"], int(options.get("file_tokens", FILE_TOKENS)), tokenizer, int(options.get("end", 0)))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._checksums())


def write_tokens(encoded: DataFrame, path: str, file_tokens: int = FILE_TOKENS) -> None:
    """Write ``encoded`` (doc_id, ids), which is in the wanted order, to ``path``."""
    encoded.sparkSession.dataSource.register(TokenFiles)
    columns = encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>"))
    columns.write.format("token_files").option("file_tokens", file_tokens).mode("append").save(path)


def write_texts(docs: DataFrame, path: str, tokenizer: str, end: int = 0, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text), which are in the wanted order, and write their ids in the same tasks."""
    docs.sparkSession.dataSource.register(TokenFiles)
    writer = docs.select(F.col("doc_id").cast("bigint"), "text").write.format("token_files").mode("append")
    writer.options(file_tokens=file_tokens, tokenizer=tokenizer, end=end).save(path)


def read_tokens(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids), or with ``ids_crc32`` in place of the ids."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("checksums", checksums).load(path)


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """(position, id) for each ``position`` (counted over all documents); null where there is none.

    Only the bytes that hold the asked ids are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = manifest(path)
        names, starts = listed["file"].to_pylist(), np.asarray(listed["start"])
        total = int(np.asarray(listed["tokens"]).sum())
        fs, folder = file_system(path)
        for batch in batches:
            asked = batch.column(0)
            wanted = np.asarray(asked.fill_null(-1), np.int64)
            ids, there = np.zeros(len(wanted), np.int64), (wanted >= 0) & (wanted < total)
            owner = np.searchsorted(starts, wanted, "right") - 1
            order = np.flatnonzero(there)[np.argsort(owner[there], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
                number = owner[rows[0]]
                with fs.open_input_file(f"{folder}/{names[number]}") as opened:
                    file = TokenFile(opened)
                    for row in rows:
                        at = int(wanted[row] - starts[number])
                        ids[row] = file.ids(at, at + 1)[0]
            yield pa.RecordBatch.from_arrays([asked, pa.array(ids, pa.int64(), mask=~there)], ["position", "id"])

    return positions.select(F.col("position").cast("bigint")).mapInArrow(run, "position bigint, id bigint")


# ---------------------------------------------------------------- encoding


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: After these a piece does not end: white space, and controls that some libraries take for it.
_OPEN = _SPACE | np.isin(np.arange(256), [28, 29, 30, 31])
#: Letters, digits and signs of ASCII, which never share a word of the pattern; no border next to anything else.
_KIND = np.array([0 if not 33 <= b < 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Pieces that are one word of the pattern for certain: letters of Latin alphabets after a blank or none.
_WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ſ]+").fullmatch


def piece_starts(data: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``data``: at each row, and where words of the pattern always end.

    That is at ASCII white space after something that is none, and between letters, digits and signs of ASCII
    but after an apostrophe; not inside the rows ``whole``. White space beyond ASCII ends in two bytes that are
    told apart coarsely; a border left out does no harm.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        border = _SPACE[here] & ~_OPEN[before]
        lead = np.concatenate([[0], data[:-2]])
        border &= ~(np.isin(lead, [0xC2, 0x80, 0x81, 0x9A]) & (before >= 0x80) & (before <= 0xAF))
        left, right = _KIND[before], _KIND[here]
        border |= (left != right) & (left > 0) & (right > 0) & (before != ord("'"))
        cut[1:-1] = border
    for row in np.flatnonzero(whole):
        cut[rows[row] : rows[row + 1]] = False
    cut[rows] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, given as its JSON.

    The ids of up to ``PIECES`` pieces are kept from one group of texts to the next; this saves work only.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        before = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or before.get("type") != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer with its own pattern and nothing before it is needed")
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.letters = dict(enumerate(byte_letters()))
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.place: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them one after the other."""
        found: list = [None] * len(pieces)
        words = [i for i, p in enumerate(pieces) if _WORD(p)]
        bpe, letters = self.tokenizer.model, self.letters
        for i in words:  # straight to the merges, as letters for bytes
            found[i] = [t.id for t in bpe.tokenize(pieces[i].encode().decode("latin-1").translate(letters))]
        others = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(others), CALL):
            some = others[at : at + CALL]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
                found[i] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))

    def _look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each piece, and the rows' lengths and ids."""
        get, known = self.place.get, len(self.place)
        rows = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(rows < 0)
        new = [pieces[i] for i in fresh]
        rows[fresh] = known + np.arange(len(new))
        lengths, flat = self._ids(new)
        all_lengths, all_flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
        room = min(max(PIECES - known, 0), len(new))
        if room:
            self.place.update(zip(new[:room], range(known, known + room)))
            self.lengths = all_lengths[: known + room].copy()
            self.flat = all_flat[: int(self.lengths.sum())].copy()
        return rows, all_lengths, all_flat

    def __call__(self, texts: pa.Array, end: int) -> Iterator[pa.Array]:
        """Lists of ids of consecutive texts, each with ``end`` after it."""
        data, offsets = text_bytes(texts)
        for first, last in slices(offsets, GROUP_BYTES):
            base, rows = offsets[first], offsets[first : last + 1] - offsets[first]
            part = data[base : offsets[last]]
            whole = np.zeros(len(rows) - 1, bool)
            for content in self.special:
                whole |= np.asarray(pc.match_substring(texts.slice(first, last - first), content).fill_null(False))
            starts = piece_starts(part, rows, whole)
            pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(part)).dictionary_encode()
            place, lengths, flat = self._look_up(pieces.dictionary.to_pylist())
            which = place[np.asarray(pieces.indices)]
            counts = lengths[which]
            after = np.concatenate([[0], np.cumsum(counts)])
            ids = flat[np.arange(after[-1]) + np.repeat((np.cumsum(lengths) - lengths)[which] - after[:-1], counts)]
            ends = after[np.searchsorted(starts, rows)]  # ids before each text
            offset = ends + np.arange(len(ends))
            out = np.full(offset[-1], end, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))] = ids
            yield pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(out))


@lru_cache(1)
def encoder_for(spec: str) -> PieceEncoder:
    """One for all tasks of a Python worker, which Spark uses again."""
    return PieceEncoder(spec)


def encode(docs: DataFrame, spec: str, end: int = 0) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text) with ``end`` after each document, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec)
        for batch in batches:
            at = 0
            for ids in encoder(batch.column("text"), end):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), ids], ["doc_id", "ids"])
                at += len(ids)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) sorted by id over all partitions; texts of a repeated id by their hash, so that no id is one task."""
    keyed = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("hash"))
    return keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_spec(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as file:
        return file.read()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_texts(in_order(table(spark, sf_dir, "documents")), path, byte_bpe())
    return read_tokens(spark, path, checksums=True)
