import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varlake.llm import packing
from varlake.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    found.encode_special_tokens = True
    return found


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the multiset of bins as sorted lengths."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [one for one in bins if capacity - sum(one) >= length]
        if fitting:
            min(fitting, key=lambda one: capacity - sum(one)).append(length)
        else:
            bins.append([length])
    return sorted(sorted(one) for one in bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 1024])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.randrange(1, 300))]
    histogram = defaultdict(int)
    for length in lengths:
        histogram[length] += 1
    bins = defaultdict(list)
    for length, runs in packing.best_fit_plan(histogram.items(), capacity).items():
        for number in range(histogram[length]):
            first, first_bin, offset, per_bin = max(run for run in runs if run[0] <= number)
            at = number - first
            bins[first_bin + at // per_bin].append((offset + at % per_bin * length, length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    got = [sorted(length for _, length in placed) for placed in bins.values()]
    assert len(got) == len(one_by_one(lengths, capacity))
    assert sorted(map(sum, got)) == sorted(map(sum, one_by_one(lengths, capacity)))


def test_tightest_bin_wins():
    bins = packing.OpenBins(10)
    for remaining, first in ((9, 0), (4, 1), (6, 2)):
        bins.put(remaining, first, 1)
    assert bins.take(5) == (6, 2, 1)
    assert bins.take(5) == (9, 0, 1)
    assert bins.take(5) is None
    assert bins.take(4) == (4, 1, 1)


def test_too_long_a_piece_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit_plan([(11, 1)], 10)


def test_ids_equal_the_library_s(tokenizer):
    texts = ["", " ", "   ", "  a  b ", "\n\n x \n y", "a\xa0 b", "don't  can't\t \t x", "日本語 テキスト  é́ ", "<|endoftext|> a<|endoftext|>", "ö²½ _-_ 12³"]
    for text in texts:
        ids = np.frombuffer(encoder(VOCABULARY).ids(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "é <|endoftext|>\n\n<|endoftext|>日本 ", "<|endoftext", " \n<|endoftext|>"]


@pytest.mark.parametrize("text", ADDED)
def test_encoded_equals_the_library_s_defaults(text):
    plain = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    assert np.frombuffer(encoder(VOCABULARY).encoded(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tokens_that_take_white_space(tmp_path):
    from tokenizers import AddedToken

    other = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    other.add_special_tokens([AddedToken("<mask>", lstrip=True, rstrip=True), "<mask>s"])
    other.save(f"{tmp_path}/other.json")
    for text in [*ADDED, "a <mask>  b", "a <mask>s <|endoftext|> b"]:
        ids = np.frombuffer(encoder(f"{tmp_path}/other.json").encoded(text), "<u4").tolist()
        assert ids == other.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_added_tokens(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.packed_documents(docs, VOCABULARY, end_id=2)[1].collect()}
    for doc_id, text in enumerate(ADDED):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[doc_id] == (len(ids), zlib.crc32(ids.tobytes()))


def test_pieces_and_sequences(odd, tokenizer):
    pieces, placement = packing.packed_documents(odd, VOCABULARY, end_id=2, capacity=64)
    rows = placement.collect()
    expected = []
    for row in odd.collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        bounds = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected.append((row["doc_id"], number, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    order = lambda row: tuple((value is None, value or 0) for value in row)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=order) == sorted(expected, key=order)
    by_sequence = defaultdict(list)
    for row in rows:
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_sequence) == len(one_by_one([r["length"] for r in rows], 64))
    distinct = placement.where("doc_id = 7")
    whole = packing.sequences(pieces.where("doc_id = 7"), distinct).collect()
    assert sum(row["length"] for row in whole) == sum(r["length"] for r in rows if r["doc_id"] == 7)


def test_hot_length_is_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    pieces = spark.range(500).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 7, 5) as long) as length")
    numbers = packing.numbered(pieces, ["doc_id"]).toPandas()
    for _, group in numbers.groupby("length"):
        assert sorted(group["number"]) == list(range(len(group)))


def test_empty_table(none):
    assert packing.packed_documents(none, VOCABULARY)[1].count() == 0
