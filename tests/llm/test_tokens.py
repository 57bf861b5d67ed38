"""SentencePiece encoding and byte-level counts against their libraries."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from communitylens.llm import pieces, token_counts

MODEL, MERGES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    pick = random.Random(4)
    signs = list(" \n\t▁aAbBeEtThHiInNgG0123.,!?'-_<>/s$#é漢字😀\x00　  íß")
    parts = [" ", "  ", "the", "ing", "tion", "\n", " a", "AKIA", "<|endoftext|>", "</s>", "<s>", "'s", "'ll", "%%%", "&&&", "..."]
    out = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    out += ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(2000)]
    out += ["a" * n for n in range(40)] + [" " * n for n in range(60)] + ["▁" * 33 + "x", "ab" * 20_000, "é" * 5000, "", " ", "\n"]
    return out


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(pieces.Vocabulary(MODEL))


def test_encoding_and_decoding_equal_the_library(coder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in texts():
        ids = library.encode(text)
        assert coder.encode(text) == ids, text[:80]
        assert coder.decode(ids + [2]) == library.decode(ids + [2]), text[:80]


def test_pieces_in_any_order(coder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(8)
    for _ in range(4000):
        text = "".join(pick.choice(coder.v.pieces[259:]) for _ in range(pick.randint(1, 8))).replace("▁", pick.choice(["", " "]))
        assert coder.encode(text) == library.encode(text), text
        ids = [pick.choice([3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 3 + 0x41, 3 + 0xF0, 3 + 0x9F, 300, 28705, 0, 1, 2]) for _ in range(pick.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_forgetting_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    fresh = pieces.Pieces(coder.v)
    for text in texts()[::20]:
        assert fresh.encode(text) == library.encode(text)


def test_what_is_remembered_stays_small(coder):
    """Workers outlive tasks, so what a task remembers stays in the executor's memory."""
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefghiklmnoprstuvw") for _ in range(8)) for _ in range(20_000)]
    fresh = pieces.Pieces(coder.v)
    tracemalloc.start()
    for at in range(0, len(words), 100):
        fresh.encode(" ".join(words[at:at + 100]))
    fresh.side_by_side.clear()  # it depends on the pieces, not on how units are stored
    used, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(fresh.known) >= len(words) and used < 300 * len(words), used / len(words)


def test_encoding_tables(documents):
    rows = [(1, "one  two\nThree"), (1, "one  two\nThree"), (None, "x"), (2, None), (3, ""), (4, "word " * 60_000)]
    got = {(r.doc_id, r.decoded): r.ids for r in pieces.encode(documents(rows), "doc_id", MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == {(d, t or ""): library.encode(t or "", add_eos=True) for d, t in rows}
    assert pieces.encode(documents(rows), "doc_id", MODEL).count() == len(rows)
    assert pieces.encode(documents([]), "doc_id", MODEL).count() == 0


def test_counts_equal_the_library():
    library = tokenizers.Tokenizer.from_file(MERGES)
    counter = token_counts.Counter(token_counts.Merges(MERGES))
    rows = texts()
    for at in range(0, len(rows), 500):
        part = rows[at:at + 500]
        assert counter.counts(part) == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_count_tables(documents):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "word " * 60_000), (5, "a<|endoftext|>b")]
    library = tokenizers.Tokenizer.from_file(MERGES)
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows), key=str)
    assert sorted((tuple(r) for r in token_counts.count(documents(rows), "doc_id", MERGES).collect()), key=str) == want
    assert token_counts.count(documents([]), "doc_id", MERGES).count() == 0
