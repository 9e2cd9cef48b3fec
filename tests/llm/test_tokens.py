from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import packing, queries, token_files, tokens

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def known():
    return tokens.Encoder(PATH, 2)


def decoded(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


CASES = ["", " ", "  ", "\n", " \n ", "a", " a", "a  b", "don't we'LL", "a.b,c", "x'y ' z", "1234 5", "\t\ta", "é à ç", "a　b", "a\n\nb \n c", "…—„“", "<|endoftext|> </s>", " x", "日本語 text", "😀 😀", "a\r\nb", "C++ f(x)={y}", " .", ". .", "'s 's"]


@pytest.mark.parametrize("text", CASES)
def test_chunks_give_the_ids_of_whole_texts(plain, known, text):
    assert decoded(next(iter(known.encode([text]))))[:-1] == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1 .,'\n\té —日🙂sS-_<|>/\r\x1c"), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    one = Tokenizer.from_file(PATH)
    one.encode_special_tokens = True
    found = tokens.encoder(PATH, 2).encode(texts)
    assert [decoded(x) for x in found] == [[*one.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_whole_table(documents, plain, known):
    data = [r["text"] for r in documents.collect()]
    assert [decoded(x)[:-1] for x in known.encode(data)] == [plain(t) for t in data]


def test_forgetting_changes_nothing(documents, known):
    data = [r["text"] for r in documents.collect()]
    small = tokens.Encoder(PATH, 2, cache=50)
    got = [x for i in range(0, len(data), 20) for x in small.encode(data[i : i + 20])]
    assert got == list(known.encode(data))


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_token_files_round_trip(spark, request, table, tmp_path, plain):
    df, path = request.getfixturevalue(table), f"file://{tmp_path}/tokens"
    token_files.write_token_files(df, path)
    index = token_files.index_of(spark, path)
    data = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, want = 0, []
    for r in data:
        ids = [*plain(r["text"]), 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(index.select("doc_id", "start", "n_tokens", "ids_crc32"), "start") == want
    # A shuffled read by the index.
    wanted = index.where("n_tokens > 1").select("file", "offset", "n_bytes", F.col("start").alias("place"))
    for r in token_files.read_records(spark, path, wanted).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == {w[1]: w[3] for w in want}[r["place"]]


def test_damage_is_found():
    content = token_files.frame(7, np.array([1, 2, 3], "<u4").tobytes(), 2) + b"\n"
    assert [(i, len(x) // 4) for _, _, i, x in token_files.frames(content)] == [(7, 3)]
    for at in (0, 9, 20, len(content) - 3):
        broken = bytearray(content)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(token_files.frames(bytes(broken)))


def test_empty_token_files(spark, none, tmp_path):
    token_files.write_token_files(none, f"file://{tmp_path}/none")
    assert token_files.index_of(spark, f"file://{tmp_path}/none").count() == 0


def test_many_small_files(spark, documents, tmp_path):
    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    token_files.write_token_files(documents, one)
    token_files.write_token_files(documents, many, file_bytes=20_000)
    index = [token_files.index_of(spark, p) for p in (one, many)]
    files = [x.select("file").distinct().count() for x in index]
    assert files[1] > 12 > files[0]
    a, b = (x.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect() for x in index)
    assert a == b and [r["doc_id"] for r in a] == sorted(r["doc_id"] for r in a)


def test_file_numbers_sort_as_numbers(spark):
    names = ["x/part-99999-a.txt", "x/part-100000-a.txt", "x/part-00002-a-c000.txt"]
    found = spark.createDataFrame([(n,) for n in names], "file string").orderBy(token_files.file_number(F.col("file")))
    assert [r["file"] for r in found.collect()] == [names[2], names[0], names[1]]


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1024: 3, 1: 1}, {600: 10, 424: 7, 300: 4, 1: 3}, {i: i % 7 + 1 for i in range(1, 1025)}])
def test_patterns_place_every_length_once(histogram):
    placed = dict.fromkeys(histogram, 0)
    for packs, items in packing.shortest_pack_first(histogram, 1024):
        assert sum(n * k for n, k in items) <= 1024 and packs > 0
        for n, k in items:
            placed[n] += packs * k
    assert placed == histogram


@pytest.mark.parametrize("table", ["documents", "hard"])
def test_packing_is_a_partition(request, table, plain):
    df = request.getfixturevalue(table)
    found = packing.pack(df).collect()
    docs = {}
    for r in df.collect():
        docs.setdefault(r["doc_id"], []).append([*plain(r["text"]), 0])
    sequences, pieces = {}, {}
    for r in found:
        assert 0 < r["length"] <= 1024
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(docs)
    for key, texts in docs.items():
        want = sorted((s, len(t[s : s + 1024]), zlib.crc32(np.array(t[s : s + 1024], "<u4").tobytes()), len(t)) for t in texts for s in range(0, len(t), 1024))
        assert sorted(pieces[key]) == want
    assert set(sequences) == set(range(len(sequences)))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in found)
    assert len(sequences) * 1024 - total <= 0.1 * total + 1024


def test_empty_packing(none):
    assert packing.pack(none).count() == 0


def test_queries_have_their_columns(spark, sf):
    assert queries.op2_packing(spark, sf).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert queries.op3_token_files(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
