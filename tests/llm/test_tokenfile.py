import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quireworks.llm import tokenfile
from quireworks.llm.common import table
from quireworks.staging import fresh_path

ODD = [
    "", " ", "  ", "a", " a  b ", "a \n b", "a  \n b\t\tc", "it's we'll THEY'RE", "x  y  z　 w", "a\x1c b\x1f c \x85 d", "naïve café à la 日本語 123",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c", "é" * 300, "a" * 20_000, ("word " * 3000 + "\n\n" + "tail  ") * 3, "🙂 🙃👍🏽", "don't\r\nstop\r\n",
]


@pytest.fixture(scope="module")
def spec():
    return tokenfile.read_spec(tokenfile.byte_bpe())


@pytest.fixture(scope="module")
def brute(spec):
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows, brute):
    """What the query gives for (doc_id, text), one number after the other."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = brute(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_as_the_library_does(spark, sf_dir, brute):
    docs = sorted(tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in tokenfile.op11_token_files(spark, sf_dir).collect()) == expected(docs, brute)


def test_odd_texts_through_small_files(spark, spec, brute):
    rows = [(i, t) for i, t in enumerate([None, *ODD])]
    docs = spark.createDataFrame(rows[::-1], "doc_id int, text string").repartition(3).selectExpr("doc_id", "text", "1 AS ids", "2 AS hash", "3 AS start")
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(tokenfile.encode(tokenfile.in_order(docs), spec), path, file_tokens=60)
    assert tokenfile.manifest(path).num_rows > 5
    assert [tuple(r) for r in tokenfile.read_tokens(spark, path, checksums=True).orderBy("start").collect()] == expected(rows, brute)
    again = fresh_path(spark, "tokens")
    tokenfile.write_texts(tokenfile.in_order(docs), again, tokenfile.byte_bpe())
    assert [tuple(r) for r in tokenfile.read_tokens(spark, again, checksums=True).orderBy("start").collect()] == expected(rows, brute)
    whole = [i for _, t in rows for i in brute(t)]
    asked = spark.createDataFrame([(0,), (len(whole) - 1,), (len(whole),), (-1,), (None,), (777,), (777,), *((i,) for i in range(0, len(whole), 37))], "position long")
    for position, found in tokenfile.tokens_at(asked, path).collect():
        assert found == (whole[position] if position is not None and 0 <= position < len(whole) else None)
    with pytest.raises(Exception, match="already"):
        tokenfile.write_tokens(tokenfile.encode(docs, spec), path)


def test_null_and_repeated_ids(spark, spec, brute):
    rows = [(None, "null one"), (3, "same"), (3, "same"), (3, "other"), (-2, None), (None, "null two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(tokenfile.encode(tokenfile.in_order(docs), spec), path)
    found = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, -2, 3, 3, 3]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in found) == sorted((d or 0, brute(t)) for d, t in rows)
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])


def test_empty_table(spark, spec):
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(tokenfile.encode(tokenfile.in_order(spark.createDataFrame([], "doc_id long, text string")), spec), path)
    assert tokenfile.read_tokens(spark, path).count() == 0
    assert [tuple(r) for r in tokenfile.tokens_at(spark.range(2).toDF("position"), path).collect()] == [(0, None), (1, None)]


def test_foreign_ids(spark):
    lists = [(1, [2**31 - 1, 0, 5]), (2, None), (3, []), (4, [7] * 9)]
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(spark.createDataFrame(lists, "doc_id long, ids array<int>").coalesce(1), path)
    assert [(r["doc_id"], r["ids"]) for r in tokenfile.read_tokens(spark, path).orderBy("start", "doc_id").collect()] == [(d, i or []) for d, i in lists]
    with pytest.raises(Exception, match="token ids must be"):
        tokenfile.write_tokens(spark.createDataFrame([(1, [-1])], "doc_id long, ids array<int>"), fresh_path(spark, "tokens"))


@pytest.mark.parametrize("most", [1, 2, 300, 50_257, 2**31 - 1])
def test_any_run_of_ids(most):
    ids = (np.random.default_rng(most).random(5000) ** 3 * most).astype(np.int64)
    data = tokenfile.file_bytes(pa.array([1, None]), np.array([4000, 1000]), ids)
    file = tokenfile.TokenFile(pa.BufferReader(data))
    assert file.doc_ids().to_pylist() == [1, None] and file.ends().tolist() == [4000, 5000]
    for a, b in [(0, 5000), (0, 1), (4999, 5000), (511, 513), (512, 1024), (1023, 3072), (77, 77), (4990, 6000)]:
        assert file.ids(a, b).tolist() == ids[a:b].tolist()


def test_widths_are_the_best_of_all():
    counts = np.array([0, 50, 10, 3, 20, 1, 0, 2])

    def bits(widths):
        total, at = 0.0, 0
        for k, w in enumerate(widths):
            n = counts.sum() if not at else counts[at + 1 :].sum()
            total, at = total + n * (w + (k + 1 < len(widths)) * (1 + 32 / tokenfile.RANK_BITS)), at + w
        return total

    def splits(n):
        return [[n], *([w, *rest] for w in range(1, n) for rest in splits(n - w))]

    assert bits(tokenfile.best_widths(counts)) == min(map(bits, splits(7)))
