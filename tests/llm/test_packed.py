"""Packed token ids: exact round trips, the library's ids, random access."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import texts

from communitylens.llm import packed
from communitylens.session import checkpoint_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.data())
@settings(max_examples=80, deadline=None)
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2 ** bits - 1), max_size=200)), np.uint32)
    packed_ids = packed.pack(ids, bits)
    assert len(packed_ids) == -(-len(ids) // 64) * 8 * bits
    back = packed.unpack(packed_ids, bits)
    assert back[:len(ids)].tolist() == ids.tolist() and not back[len(ids):].any()


def test_width():
    assert [packed.width(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_encoding_equals_the_library():
    library = tokenizers.Tokenizer.from_file(WORDS)
    pick = random.Random(6)
    letters = list("aAeEzZéÈßñÿÏµªº×÷ſıİΣσς́̊ﬁ①٣,.!?'\n \t\r\x1c\x85 <>|")
    rows = texts() + ["".join(pick.choice(letters) for _ in range(pick.randint(0, 25))) for _ in range(6000)]
    rows += ["a<|endoftext|>b", "<|startoftext|>", "Été, ÀÉÎ. don't it's", "É" * 3000, "été" + "́ é"]
    coder = packed.Encoder(WORDS)
    for at in range(0, len(rows), 700):
        part = rows[at:at + 700]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        for text, ids, coded in zip(part, want, coder(part), strict=True):
            assert np.frombuffer(coded, "<u4").tolist() == ids, text[:80]


@pytest.mark.parametrize("bits", [3, 16, 17])
def test_files(spark, bits):
    folder, pick = packed.folder_for(spark), np.random.default_rng(bits)
    sizes = [0, 1, 5, 40_000, 0, 63, 64, 65, packed.BLOCK, packed.BLOCK - 1, 0]
    docs = [pick.integers(0, 2 ** bits, n).astype("<u4") for n in sizes]
    writer = packed.Writer(folder, bits)
    for first in range(0, len(docs), 3):
        part = docs[first:first + 3]
        writer.add(pa.array(range(first, first + len(part))), np.array([len(d) for d in part]), np.concatenate(part))
    name, n_docs, n_ids = writer.close()
    reader = packed.Reader(folder, name)
    assert (n_docs, n_ids) == (len(docs), sum(sizes)) == (reader.n_docs, reader.n_ids) and reader.bits == bits
    assert reader.keys.to_pylist() == list(range(len(docs)))
    everything = np.concatenate(docs)
    for k in (3, 0, 10, 8, 2):
        assert reader.document(k).tolist() == docs[k].tolist()
    for first, last in ((0, 1), (16_383, 16_385), (100, 50_000), (n_ids - 1, n_ids), (7, 7)):
        assert reader.ids(first, last).tolist() == everything[first:last].tolist()
    assert np.concatenate([ids for _, _, ids in reader.runs()]).tolist() == everything.tolist()


def brute(rows, end=1):
    """Rows in file order, but for those that share an id."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


ROWS = [(5, "five"), (1, "One two\nthree"), (None, "no id"), (-4, None), (9, ""), (3, "word " * 60_000), (2, "it's <|endoftext|> été"), (7, "same"), (7, "same")]


@pytest.mark.parametrize("end", [1, None])
def test_tables(spark, documents, end):
    rows = ROWS + [(k, f"text {k} " * (k % 9)) for k in range(10, 300)]
    folder = packed.folder_for(spark)
    files = packed.write(documents(rows, 5), folder, WORDS, end=end)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in packed.read(spark, folder, files).collect()]
    assert sorted(((d, len(b) // 4, zlib.crc32(b)) for d, _, b in got), key=str) == sorted(brute(rows, end), key=str)
    got.sort(key=lambda r: (r[1], len(r[2])))
    ids = [r[0] for r in got if r[2]]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [len(r[2]) // 4 for r in got])[:-1].tolist()
    assert files.agg({"n_ids": "sum"}).first()[0] == sum(len(r[2]) // 4 for r in got)


def test_one_id_with_many_texts(spark, documents):
    rows = [(1, f"many {k}") for k in range(400)] + [(None, "same")] * 400 + [(2, "last")]
    folder = packed.folder_for(spark)
    files = packed.write(documents(rows, 6), folder, WORDS)
    assert sorted(((r.doc_id, len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in packed.read(spark, folder, files).collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark, documents):
    folder = packed.folder_for(spark)
    files = packed.write(documents([]), folder, WORDS)
    read = packed.read(spark, folder, files)
    assert read.columns == ["doc_id", "start", "ids"] and read.count() == 0


def test_folders_as_spark_names_them(spark):
    assert packed.folder_for(spark).startswith(checkpoint_dir(spark))
    for folder in ("file:/a/b", "file:///a/b", "/a/b"):
        assert packed._filesystem(folder)[1] == "/a/b"
