"""Counts and ids against the libraries that define them."""

import base64
import hashlib
import random
import struct
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import byte_bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello  world!\n\n  it's 1234 naïve", "<|endoftext|> and <|endoftext|>x", "aaaa" * 5000, "🙂🙂 \t 日本語のテキスト", "x " * 20000, "the same", "the same", "   wide", " lead and trail "]
SCHEMA = "doc_id long, text string, n_tokens string, TEXT2 string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", None) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        n = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(P.path(name))
        n = lambda t: len(tokenizer.encode(t, add_special_tokens=False))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, P.path(name)).collect()}
    expected = {k: (len((t or "").encode()), n(t or "")) for k, t in enumerate(TEXTS)} | {None: (7, n("null id"))}
    assert got == expected


def test_batches_and_memo_change_nothing(docs):
    a = token_counts.token_counts(docs, JSON).orderBy("doc_id").collect()
    assert token_counts.token_counts(docs, JSON, batch_bytes=16, memo=3).orderBy("doc_id").collect() == a
    assert token_counts.token_counts(docs.limit(0), JSON).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_cuts_are_safe(text):
    counter = token_counts._Counter(JSON, 1 << 16, 10_000)
    lengths, _ = token_counts._encoder(JSON)
    assert counter.count([text]).tolist() == lengths([text])


def test_ids_and_bytes(docs, library):
    got = {r["doc_id"]: r for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()}
    for k, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = library.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids) and bytes(got[k]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[k]["decoded"]) == (t or "").encode()
    digests = {r["doc_id"]: r for r in byte_bpe.encode(docs, RANKS, P.PATTERN, digests=True, memo=5).collect()}
    assert all(digests[k]["ids_sha256"] == hashlib.sha256(bytes(got[k]["ids"])).hexdigest() for k in got)
    assert byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_any_text_round_trips(text):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ((n, ids, data),) = byte_bpe._Memo(RANKS, P.PATTERN, 1000).encode([text])
    assert list(struct.unpack(f"<{n}I", ids)) == library.encode_ordinary(text) and data == text.encode()


def test_decoding_any_ids():
    assert byte_bpe.decode_ids([[], [72, 10], [50000]], RANKS)[0] == b""
    ranks = byte_bpe.read_ranks(RANKS)
    names = {v: k for k, v in ranks.items()}
    assert byte_bpe.decode_ids([[72, 10], [50000, 1]], RANKS) == [names[72] + names[10], names[50000] + names[1]]


@pytest.mark.parametrize("word", ["".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "ab" * 50_000, "a" * 70_001, "é" * 9_000, "-" * 3_001])
def test_very_long_words(library, word):
    """Words of many windows: the ids of the library, in time that grows with the length."""
    ids, counts = byte_bpe.encode_words([b"x", word.encode(), b"", b"yz"], RANKS)
    expected = library.encode_ordinary(word)
    assert counts[1] == len(expected) and counts[2] == 0 and ids[counts[0] : counts[0] + counts[1]].tolist() == expected


def test_windows_of_any_width(library, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abeht "[: rng.randrange(2, 6)]) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    expected = [library.encode_ordinary(w) for w in words]
    for width in (4, 16, 64, 1024):
        monkeypatch.setattr(byte_bpe, "WINDOW", width)
        ids, counts = byte_bpe.encode_words([w.encode() for w in words], RANKS)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == expected


@pytest.mark.parametrize("unit", ["─", "★", "日", "😀", "é", "ab", "=-", "*", " ", "─━", "abc─", "x" * 37 + "日", "".join(random.Random(2).choice("ab─ é") for _ in range(700))])
def test_words_that_repeat(library, unit):
    """Windows out of step with what repeats: the ids of the library, in well under a second."""
    words = [(unit * 30_000)[:n] for n in (63, 200, 5_000, 12_001)]
    start = time.monotonic()
    ids, counts = byte_bpe.encode_words([w.encode() for w in words], RANKS)
    assert time.monotonic() - start < 5
    for got, word in zip(np.split(ids, np.cumsum(counts)[:-1]), words, strict=True):
        assert got.tolist() == library.encode_ordinary(word)


def test_words_of_repeated_and_other_parts(library):
    rng = random.Random(4)
    parts = ["a", "b", "─", "é", "日", "=", "-", "the", "ing", "😀", " "]
    words = ["".join((rng.choice(parts) * rng.choice([1, 1, 90]) if k % 3 else "".join(rng.choices(parts, k=4)) * rng.randrange(40)) for k in range(rng.randrange(1, 5))) for _ in range(400)]
    ids, counts = byte_bpe.encode_words([w.encode() for w in words], RANKS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(w) for w in words]


def test_ids_beyond_two_bytes(tmp_path):
    """A vocabulary whose ids need more than 16 bits."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 70_000, b"abab": 70_001, b"ba": 2_000_000}
    path = tmp_path / "wide.tiktoken"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    ids, counts = byte_bpe.encode_words([b"ababab", b"bab", b"bba"], str(path))
    assert ids.tolist() == [70_001, 70_000, 98, 70_000, 98, 2_000_000] and counts.tolist() == [2, 2, 2]
