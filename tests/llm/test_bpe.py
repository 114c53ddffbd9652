import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quireworks.llm import bpe

TEXTS = [
    "The the THE running, isn't we'll 12345 co-op!!", "", "  \t\n ", "Straße ÉCOLE é ΣΑΣ Σ ΟΔΟΣ İ ﬁ ½ ²", "a<|endoftext|>B <|startoftext|> <|ENDOFTEXT|>",
    "a\x1cb \x1d\x1e c\x1f\x1fd \x1f", "e \u0301 e\u0301\u2001\u0327", "<|endoftext|>x y<|endoftext|>",
    "x" * 3000, "ab" * 900 + "é" * 700, "日本語 한국어 ​﻿🙂🙂 \x00\x1c\x85　z", "퟿     a\xa0b", "'S 'T it'S don't''ve", "ᾼ ŉ ǰ Ǆ ẞ K Å",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(bpe.word_bpe_path())


def test_equal_to_the_library(spark, vocabulary):
    library = Tokenizer.from_file(bpe.word_bpe_path())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[0]])], "doc_id bigint, text string")
    for lexicon in (None, bpe.send_lexicon(docs, vocabulary, 20)):
        ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, vocabulary, lexicon).collect()}
        back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, vocabulary, lexicon), vocabulary).collect()}
        rows = {r["doc_id"]: r for r in bpe.digests(docs, vocabulary, lexicon).collect()}
        for i, text in enumerate([*TEXTS, "", TEXTS[0]]):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[i] == want, text[:40]
            assert back[i] == library.decode(want, skip_special_tokens=False)
            assert rows[i]["n_tokens"] == len(want)
            assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
            assert rows[i]["decoded_sha256"] == hashlib.sha256(back[i].encode()).hexdigest()


def test_lexicon_is_exact_minimal_and_mapped(tmp_path):
    words = {w: [i, i + 1] for i, w in enumerate(["sings", "rings", "sing", "ring", "é", "kings"])}
    arrays = bpe.compile_lexicon(words)
    (tmp_path / "x.bin").write_bytes(bpe.lexicon_bytes(arrays))
    mapped = bpe.map_lexicon(str(tmp_path / "x.bin"))
    asked = [*words, "s", "ringss", "", "king"]
    numbers = bpe.look_up(mapped, asked)
    for word, n in zip(asked, numbers):
        got = mapped["ids"][mapped["start"][n] : mapped["start"][n + 1]].tolist() if n >= 0 else None
        assert got == words.get(word)
    # no two states accept the same rest: root, after s / r / k, the two bytes of é, -i-n-g(s), end
    assert len(mapped["final"]) < sum(len(w.encode()) for w in words) / 2
    empty = bpe.compile_lexicon({})
    assert bpe.look_up(empty, ["a"]).tolist() == [-1] and len(empty["final"]) == 1 and np.sum(empty["final"]) == 0


def test_both_ways_of_merging_are_equal(vocabulary):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 8, 40, 90):
        for _ in range(200):
            raw = rng.choice(list(b"aaaehinorst"), size)
            symbols = [*(vocabulary.inner[b] for b in raw[:-1]), vocabulary.final[raw[-1]]]
            assert bpe._merge_by_scan(list(symbols), vocabulary.pairs) == bpe._merge_by_heap(list(symbols), vocabulary.pairs)


def test_words_merged_together_are_as_merged_alone(vocabulary):
    rng = np.random.default_rng(4)
    words = ["", "é", "日本語", "a", "x" * 41, "aaaa" * 10, "\x00", "İstanbul", *("".join(rng.choice(list("aaaehinorsté"), rng.integers(1, 45))) for _ in range(6000))]
    assert bpe.merge_words(words, vocabulary) == [bpe.merge_word(w, vocabulary) for w in words]
    assert bpe.merge_words([], vocabulary) == []
    bare = bpe.Vocabulary({"a": 0, "b</w>": 1}, {}, {}, vocabulary.pattern, "</w>")
    assert bpe.merge_words(["ab", "ba", "b"], bare) == [[0, 1], [], [1]] == [bpe.merge_word(w, bare) for w in ("ab", "ba", "b")]


def test_query_on_whole_table(spark, sf_dir):
    from quireworks.llm.common import table

    library = Tokenizer.from_file(bpe.word_bpe_path())
    got = {r["doc_id"]: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for doc, found in zip(docs, library.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)):
        assert got[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, found.ids)).encode()).hexdigest()


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert bpe.digests(docs, vocabulary, bpe.send_lexicon(docs, vocabulary)).count() == 0
