import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varlake.llm import eliasfano

VOCABULARY = "byte_bpe_50k.json"


@pytest.mark.parametrize("seed", range(10))
def test_select_and_all(seed):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 2, 300, 2_000])
    numbers = sorted(rng.randrange(rng.choice([1, 50, 10**6, 10**12])) for _ in range(n))
    found = eliasfano.EliasFano.of(np.array(numbers, "u8"))
    data = found.to_bytes()
    again, end = eliasfano.EliasFano.read(memoryview(data), 0)
    assert end == len(data)
    assert again.all().tolist() == numbers
    assert [again.select(i) for i in range(n)] == numbers
    with pytest.raises(IndexError):
        again.select(n)


def test_space_is_near_minimal():
    numbers = np.cumsum(np.random.default_rng(0).integers(1, 2_000, 100_000)).astype("u8")
    bits = 8 * len(eliasfano.EliasFano.of(numbers).to_bytes()) / len(numbers)
    assert bits < 2 + np.log2(numbers[-1] / len(numbers)) + 0.8


def test_descending_numbers_are_an_error():
    with pytest.raises(ValueError):
        eliasfano.EliasFano.of(np.array([2, 1], "u8"))


def test_segments_give_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 7)]
    data = eliasfano.segment([-4, -4, 2**62], ids, 2) + b"\n" + eliasfano.segment([None], ids[:1], 4) + b"\n"
    one, two = eliasfano.segments(data)
    assert one.doc_ids() == [-4, -4, 2**62]
    assert [one.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], list(range(7))]
    assert two.doc_ids() == [None] and two.document(0).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        eliasfano.segment([1], [np.array([70_000], "<u4").tobytes()], 2)


def test_files_round_trip(odd, monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    tokenizer.encode_special_tokens = True
    rows = sorted(
        (((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] is not None, r["text"] or "", r["doc_id"]) for r in odd.collect())
    )
    start, expected = 0, []
    for _, _, text, doc_id in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = eliasfano.token_files(odd, VOCABULARY, end_id=0).orderBy("start").collect()
    assert [tuple(row) for row in got] == expected


def test_added_tokens_are_found(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "after"]
    start, expected = 0, []
    for doc_id, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(row) for row in eliasfano.token_files(docs, VOCABULARY, end_id=0).orderBy("start").collect()] == expected


def test_empty_table(none):
    assert eliasfano.token_files(none, VOCABULARY).count() == 0


def test_select_of_runs():
    rng = np.random.default_rng(4)
    for n, universe in ((1, 0), (1, 9), (700, 100), (5_000, 10**9), (2_000, 2_000)):
        numbers = np.sort(rng.integers(0, universe + 1, n))
        made, _ = eliasfano.EliasFano.read(memoryview(eliasfano.EliasFano.of(numbers).to_bytes()), 0)
        for first, stop in ((0, n), (0, 0), (n, n), (n // 3, n // 2), (min(n, 255), min(n, 257)), (min(n, 256), min(n, 512))):
            assert made.selected(first, stop).tolist() == numbers[first:stop].tolist()
        assert [made.select(at) for at in range(0, n, 97)] == numbers[::97].tolist()


def test_files_are_rolled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(eliasfano, "SEGMENTS", 3)
    monkeypatch.setattr(eliasfano, "SEGMENT", 0)
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    path = str(tmp_path / "rolled")
    eliasfano.write_token_files(docs, path, "byte_bpe_50k.json", files=2)
    assert len(list((tmp_path / "rolled").glob("part-*"))) >= 2
    rows = eliasfano.read_token_files(spark, path).orderBy("doc_id").collect()
    start = 0
    for at, row in enumerate(rows):
        assert (row["doc_id"], row["start"]) == (at, start)
        start += row["n_tokens"]
