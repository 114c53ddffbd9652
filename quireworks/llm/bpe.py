"""BPE encoding and decoding with a transducer lexicon.

The most frequent words of the corpus (counted over all of it) are merged once and compiled into a
minimal acyclic transducer: equal suffixes share states, and the numbers on the arcs of a word add up
to its place in a table of id sequences. The arrays are written to one file, which every executor fetches
once and maps into memory. A batch's distinct words walk the automaton together, one byte per step;
words that are not in it are merged exactly, many at a time, so the lexicon decides only the speed. No word goes across
white space, so texts are taken apart at white space first and each distinct piece is split into words once.

Text is prepared as the vocabulary file says: NFC, white space to one blank, lower case (letter by
letter), split into words, digits and signs, bytes as printable characters, and an end mark on the last
symbol of each word. The strings of special tokens in a text become their ids. Decoding joins the token
strings with blanks, as a tokenizer without a decoder does.

Cases: a null text counts as empty and has no tokens; repeated rows are encoded each; an empty table
gives an empty result (the lexicon is then empty); texts of any length are encoded whole; symbols that the
vocabulary lacks are left out; other columns are not in the results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import KEPT, table
from quireworks.staging import fresh_path, stage

#: Words in the lexicon, and the longest that gets into it.
WORDS, LONGEST = 65_536, 40
_COUNTED = 200_000
#: Pieces between white space that an encoder keeps with their ids; words that are merged together.
PIECES, TOGETHER = 400_000, 4096
_BITS = 24
_NONE = 1 << 62
_SPACES = regex.compile(r"\p{White_Space}+")
#: What Python's ``split`` takes for white space and Unicode's property does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


@dataclass
class Vocabulary:
    """Merges, ids and word pattern of a tokenizer file."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    pattern: str
    suffix: str
    tokens: list[str] = field(default_factory=list)
    #: Symbols as numbers: of each byte inside and at the end of a word; per pair its rank and what it becomes; the id of each number.
    inner: list[int] = field(default_factory=list)
    final: list[int] = field(default_factory=list)
    pairs: dict[int, int] = field(default_factory=dict)
    id_of: list[int] = field(default_factory=list)
    #: The same as arrays, the pairs in ascending order.
    arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        letters = byte_letters()
        ends = [x + self.suffix for x in letters]
        number = {x: i for i, x in enumerate(dict.fromkeys(chain(letters, ends, *self.ranks, (a + b for a, b in self.ranks))))}
        self.inner, self.final = [number[x] for x in letters], [number[x] for x in ends]
        self.pairs = {number[a] << _BITS | number[b]: rank << _BITS | number[a + b] for (a, b), rank in self.ranks.items()}
        self.id_of = [self.ids.get(x, -1) for x in number]
        self.arrays = {name: np.array(getattr(self, name), np.int64) for name in ("inner", "final", "id_of")}
        self.arrays["pair"], self.arrays["becomes"] = np.array(sorted(self.pairs.items()), np.int64).reshape(-1, 2).T.copy()
        everything = {**self.ids, **self.special}
        self.tokens = [""] * (max(everything.values(), default=-1) + 1)
        for token, i in everything.items():
            self.tokens[i] = token


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(model["vocab"], {m: i for i, m in enumerate(merges)}, special, splits[0], model["end_of_word_suffix"] or "")


def byte_letters() -> list[str]:
    """The printable character for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def merge_word(word: str, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word: the pair of lowest rank is merged, leftmost first, until none is left."""
    raw = word.encode()
    if not raw:
        return []
    symbols = [vocabulary.inner[b] for b in raw]
    symbols[-1] = vocabulary.final[raw[-1]]
    merged = _merge_by_scan(symbols, vocabulary.pairs) if len(symbols) <= LONGEST else _merge_by_heap(symbols, vocabulary.pairs)
    return [i for n in merged if (i := vocabulary.id_of[n]) >= 0]


def _merge_by_scan(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges a short word: the ranks of its pairs stand in a list that is searched for the smallest."""
    get = pairs.get
    waiting = [get(a << _BITS | b, _NONE) for a, b in zip(symbols, symbols[1:])]
    while waiting and (least := min(waiting)) < _NONE:
        i = waiting.index(least)
        symbols[i] = new = least & ((1 << _BITS) - 1)
        del symbols[i + 1], waiting[i]
        if i:
            waiting[i - 1] = get(symbols[i - 1] << _BITS | new, _NONE)
        if i < len(waiting):
            waiting[i] = get(new << _BITS | symbols[i + 1], _NONE)
    return symbols


def _merge_by_heap(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges a word of any length: neighbours are linked and pairs wait in a heap, n log n steps for n symbols."""
    before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := pairs.get(a << _BITS | b)) is not None]
    heapq.heapify(heap)
    while heap:
        least, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = least & ((1 << _BITS) - 1), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := pairs.get(symbols[a] << _BITS | symbols[b])) is not None:
                heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
    return [n for n in symbols if n >= 0]


def merge_words(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word, as :func:`merge_word`; words of up to ``LONGEST`` bytes take their merges together, one per step."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out: list[list[int]] = [[]] * len(words)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        out[i] = merge_word(words[i], vocabulary)
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[(sizes[by_size] > 0) & (sizes[by_size] <= LONGEST)]
    for at in range(0, len(by_size), TOGETHER):
        chosen = by_size[at : at + TOGETHER]
        ids, ends = _merge_together(b"".join([raw[i] for i in chosen]), sizes[chosen], vocabulary.arrays)
        for i, start, end in zip(chosen.tolist(), [0, *ends], ends):
            out[i] = ids[start:end]
    return out


def _merge_together(data: bytes, sizes: np.ndarray, arrays: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
    """The ids of all words of ``data``, which are ``sizes`` long, and where each word's ids end.

    A row holds the symbols of a word, each at the place of its first byte, with the places ``before`` and
    ``after``; ``waiting`` has what the pair that starts there becomes, so its least first place is merged next.
    """
    pair, becomes = arrays["pair"], arrays["becomes"]

    def found(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(pair):
            return np.full(len(a), _NONE)
        key = a << _BITS | b
        at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        return np.where(pair[at] == key, becomes[at], _NONE)

    n, width = len(sizes), int(sizes.max()) + 1
    places = np.arange(width)
    alive = places < sizes[:, None]
    letters = np.frombuffer(data, np.uint8)
    symbols = np.zeros((n, width), np.int64)
    symbols[alive] = arrays["inner"][letters]
    symbols[np.arange(n), sizes - 1] = arrays["final"][letters[np.cumsum(sizes) - 1]]
    waiting = np.full((n, width), _NONE)
    paired = alive[:, 1:]
    waiting[:, :-1][paired] = found(symbols[:, :-1][paired], symbols[:, 1:][paired])
    before, after = np.tile(places - 1, (n, 1)), np.tile(places + 1, (n, 1))
    rows = np.arange(n)
    while len(rows):
        i = waiting[rows].argmin(axis=1)
        least = waiting[rows, i]
        left = least < _NONE
        rows, i, new = rows[left], i[left], least[left] & ((1 << _BITS) - 1)
        j = after[rows, i]
        k = after[rows, j]
        symbols[rows, i], after[rows, i] = new, k
        alive[rows, j], waiting[rows, j], waiting[rows, i] = False, _NONE, _NONE
        more = np.flatnonzero(k < sizes[rows])
        at = rows[more], k[more]
        before[at] = i[more]
        waiting[rows[more], i[more]] = found(new[more], symbols[at])
        p = before[rows, i]
        less = np.flatnonzero(p >= 0)
        at = rows[less], p[less]
        waiting[at] = found(symbols[at], new[less])
    ids = np.where(alive, arrays["id_of"][symbols], -1)
    return ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(axis=1)).tolist()


class WordSplitter:
    """Prepares a text and splits it into words; special tokens come out as they are."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.find = regex.compile(vocabulary.pattern).findall
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = set(names)

    def pieces(self, text: str) -> list[str]:
        """The parts of a text between white space; their words one after the other are those of the text."""
        if _SEPARATORS.search(text):
            return [p for p in _SPACES.split(text) if p]
        return text.split()

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())  # white space parts words, one blank or several

    def __call__(self, text: str) -> list[str | tuple[str]]:
        """Words, with a special token as a tuple."""
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out: list = []
        for piece in self.special.split(text):
            out.extend([(piece,)] if piece in self.names else self._words(piece))
        return out


def compile_lexicon(entries: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """The minimal transducer of ``entries`` as arrays.

    Words come in byte order, so all states but those of the last word are final in shape and can be
    replaced by an equal one met before. ``arc_key`` is state * 256 + byte in ascending order;
    ``arc_out`` is the number of words that sort before those behind the arc, within its state.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) that leads to the next open state
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, byte = path.pop()
            state = arcs[parent][byte]
            shape = (final[state], *sorted(arcs[state].items()))
            arcs[parent][byte] = known.setdefault(shape, state)

    for word, _ in words:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        last = word
    close(0)

    reached, order = {0: 0}, [0]
    for state in order:
        for _, target in sorted(arcs[state].items()):
            if target not in reached:
                reached[target] = len(order)
                order.append(target)
    size: dict[int, int] = {}
    pending = [0]
    while pending:  # number of words below each state
        state = pending[-1]
        missing = [t for t in arcs[state].values() if t not in size]
        if missing:
            pending.extend(missing)
        else:
            size[state] = final[state] + sum(size[t] for t in arcs[state].values())
            pending.pop()
    key, target, out = [], [], []
    for state in order:
        count = int(final[state])
        for byte, to in sorted(arcs[state].items()):
            key.append(reached[state] * 256 + byte)
            target.append(reached[to])
            out.append(count)
            count += size[to]
    lengths = [len(ids) for _, ids in words]
    return {
        "arc_key": np.array(key, np.int64),
        "arc_target": np.array(target, np.int32),
        "arc_out": np.array(out, np.int32),
        "final": np.array([final[s] for s in order], np.int8),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32),
        "ids": np.array(list(chain.from_iterable(ids for _, ids in words)), np.int32),
    }


def lexicon_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A file's content: a header line with names, types and sizes, then the arrays, each on a multiple of 16."""
    out = bytearray(json.dumps([[n, a.dtype.str, len(a)] for n, a in arrays.items()]).encode() + b"\n")
    for a in arrays.values():
        out += b"\0" * (-len(out) % 16) + a.tobytes()
    return bytes(out)


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    """The arrays of a saved lexicon, mapped into memory."""
    with open(path, "rb") as file:
        spec = json.loads(head := file.readline())
    whole, at, arrays = np.memmap(path, np.uint8, "r"), len(head), {}
    for name, kind, size in spec:
        at += -at % 16
        end = at + size * np.dtype(kind).itemsize
        arrays[name] = whole[at:end].view(kind).view(np.ndarray)
        at = end
    return arrays


def look_up(lexicon: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    """The number of each word in the lexicon, or -1; all words take a step at a time."""
    found = np.full(len(words), -1, np.int64)
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    alive = np.arange(len(words))[lengths > 0]
    state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    keys, step = lexicon["arc_key"], 0
    while len(alive) and len(keys):
        key = state[alive] * 256 + data[start[alive] + step]
        arc = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[arc] == key
        alive, arc = alive[there], arc[there]
        state[alive] = lexicon["arc_target"][arc]
        number[alive] += lexicon["arc_out"][arc]
        step += 1
        ended = lengths[alive] == step
        done = alive[ended]
        done = done[lexicon["final"][state[done]] > 0]
        found[done] = number[done]
        alive = alive[~ended]
    return found


class Encoder:
    """Encodes and decodes on an executor; ``file`` is the name under which the lexicon was sent there."""

    def __init__(self, vocabulary: Vocabulary, file: str | None) -> None:
        self.vocabulary = vocabulary
        self.split = WordSplitter(vocabulary)
        self.lexicon = map_lexicon(SparkFiles.get(file)) if file else None
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the distinct pieces of up to a few MB of text are looked up together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.split.pieces(text))
            size += len(text)
            if size > 2_000_000:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[str]]) -> Iterator[list[int]]:
        fresh = [p for p in set(chain.from_iterable(group)) if p not in self.known]
        parts = [self.split(p) for p in fresh]
        distinct = list(set(chain.from_iterable(parts)))
        words = [w for w in distinct if isinstance(w, str)]
        known: dict = {w: [self.vocabulary.special[w[0]]] for w in distinct if not isinstance(w, str)}
        numbers = look_up(self.lexicon, words) if self.lexicon else np.full(len(words), -1)
        missing = [w for w, number in zip(words, numbers.tolist()) if number < 0]
        known.update(zip(missing, merge_words(missing, self.vocabulary)))
        if len(missing) < len(words):
            there, start = np.flatnonzero(numbers >= 0), self.lexicon["start"]
            for i, lo, hi in zip(there.tolist(), start[numbers[there]].tolist(), start[numbers[there] + 1].tolist()):
                known[words[i]] = self.lexicon["ids"][lo:hi].tolist()
        for piece, part in zip(fresh, parts):
            self.known[piece] = tuple(chain.from_iterable(map(known.__getitem__, part)))
        for row in group:
            yield list(chain.from_iterable(map(self.known.__getitem__, row)))
        for piece in reversed(fresh):  # what is frequent comes early and is kept; long pieces hardly come again
            if len(self.known) > PIECES or len(piece) > LONGEST:
                del self.known[piece]

    def decode(self, ids) -> str:
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids if 0 <= i < len(tokens)])


def encoder_for(vocabulary: Vocabulary, lexicon: str | None) -> Encoder:
    """The worker's encoder with the pieces that earlier tasks met; names of lexicons are never used twice."""
    if lexicon is None:
        return Encoder(vocabulary, None)
    kept = KEPT.setdefault("bpe", {})
    if lexicon not in kept:
        kept.clear()
        kept[lexicon] = Encoder(vocabulary, lexicon)
    return kept[lexicon]


def _count(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counted = WordSplitter(vocabulary), Counter()

        def given_out() -> pa.RecordBatch:
            words, numbers = pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())
            counted.clear()
            return pa.RecordBatch.from_arrays([words, numbers], ["word", "n"])

        for batch in batches:
            pieces: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    pieces.update(split.pieces(text))
            for piece, n in pieces.items():
                for word in split(piece):
                    if isinstance(word, str) and len(word) <= LONGEST:
                        counted[word] += n
                if len(counted) > _COUNTED:
                    yield given_out()
        yield given_out()

    return run


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, words: int = WORDS) -> list[str]:
    """About the ``words`` most frequent words of all of ``docs`` (text), most frequent first, ties in alphabetical order.

    A histogram of the counts, of a few thousand rows, tells from which count on there are enough words; only
    these come to the driver. If more than ``words`` words share the last step of the histogram, it is left out.
    """
    counted = docs.select("text").mapInArrow(_count(vocabulary), "word string, n bigint")
    step = F.floor(F.log("n") * 100).cast("int").alias("step")
    total = stage(counted.groupBy("word").agg(F.sum("n").alias("n")).select("word", "n", step), "words")
    steps = total.groupBy("step").count().orderBy(F.desc("step")).collect()
    have, last = 0, None
    for r in steps:
        if have >= words or r["count"] > words:
            break
        have, last = have + r["count"], r["step"]
    if last is None:
        return []
    chosen = total.where(F.col("step") >= last).select("word", "n").collect()
    return [r["word"] for r in sorted(chosen, key=lambda r: (-r["n"], r["word"]))[:words]]


def send_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = WORDS) -> str:
    """Compile the lexicon of ``docs``, write it to the shared folder and have the executors fetch it; returns its file name."""
    frequent = frequent_words(docs, vocabulary, words)
    entries = dict(zip(frequent, merge_words(frequent, vocabulary)))
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "lexicon") + ".bin")
    file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    file.write(lexicon_bytes(compile_lexicon(entries)))
    file.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def encode(docs: DataFrame, vocabulary: Vocabulary, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids) for ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, lexicon)
        for batch in batches:
            ids = pa.array(encoder.encode(_texts(batch)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) for (doc_id, ids); ids outside the vocabulary are left out, null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, None)
        for batch in batches:
            texts = pa.array([encoder.decode(ids or ()) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary, lexicon: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, nothing kept."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, lexicon)
        decimal = [str(i) for i in range(len(vocabulary.tokens))]
        for batch in batches:
            rows = [(len(ids), sha(" ".join([decimal[i] for i in ids])), sha(encoder.decode(ids))) for ids in encoder.encode(_texts(batch))]
            n, ids_sha, text_sha = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, columns)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = load_vocabulary(word_bpe_path())
    return digests(docs, vocabulary, send_lexicon(docs, vocabulary))
