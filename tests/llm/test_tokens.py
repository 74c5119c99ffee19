"""Token files and byte-level BPE: against the libraries, round trips, odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lapwing.llm import byte_bpe, token_blocks
from lapwing.llm.pieces import PieceCache, cut
from lapwing.session import shared_path

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(JSON)
    one.encode_special_tokens = True
    return one


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    alphabet = " \n\t's'reab1é😀漢., \x85\x1c\x0b"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


@pytest.mark.parametrize("high", [1, 2, 300, 50_257, 2**32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
    if n:
        ids[n // 2] = high - 1
    data = token_blocks.pack(ids)
    assert (token_blocks.unpack(data) == ids).all()
    a, b = sorted(rng.integers(0, n + 1, 2))
    assert (token_blocks.unpack(data, a, b) == ids[a:b]).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(512, 7, "<u4")
    ids[::200] = 60_000
    assert len(token_blocks.pack(ids)) < 80


def test_pieces_join_to_the_text():
    for text in odd_texts():
        parts = cut(text)
        assert " ".join(parts) == text


def test_pieces_encode_like_the_whole(tokenizer):
    texts = odd_texts()
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_blocks.encoder(JSON).ids(texts) == want


def test_every_ascii_character_and_latin_letter_encodes_like_the_library(tokenizer):
    rng = random.Random(12)
    every = [*map(chr, range(128)), *" \n\t'streAZ09.,", *map(chr, range(0xA0, 0x250))]
    texts = ["".join(rng.choice(every[: rng.choice([128, 141, len(every)])]) for _ in range(rng.randint(0, 50))) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    work = token_blocks.encoder(JSON)
    assert [one for i in range(0, len(texts), 200) for one in work.ids(texts[i : i + 200])] == want


def test_marks_in_texts_encode_like_the_library():
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(JSON)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|", "one", " ", "  ", "\n", "é", "two", "<|", "."]
    texts = ["one<|endoftext|>two", "<|endoftext|>", "a  <|endoftext|>  b", "plain text", ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in default.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(want[0], "<u4").tolist() == [505, 50256, 11545]
    assert token_blocks.encoder(JSON).ids(texts) == want
    assert token_blocks.encoder(JSON).ids(texts[3:5]) == want[3:5] and token_blocks.encoder(JSON).ids([]) == []


def test_piece_cache_is_bounded():
    cache = PieceCache(lambda pieces: [p.encode() for p in pieces], limit=10)
    for i in range(100):
        text = " ".join(str(i * 10 + k) for k in range(5))
        assert cache.ids([text]) == [text.encode()]
        assert len(cache.young) + len(cache.old) <= 40


def test_token_file(spark, docs, texts, tokenizer):
    path = shared_path(spark, "test")
    token_blocks.write_tokens(docs, path, JSON, 0)
    got = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_blocks.read_tokens(spark, path).collect()}
    want, start = {}, 0
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_token_file_of_odd_rows(spark, docs, nothing):
    path = shared_path(spark, "test")
    token_blocks.write_tokens(nothing, path, JSON, 0)
    assert token_blocks.read_tokens(spark, path).count() == 0
    rows = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b"), (2, "b"), (1, None)], "doc_id long, text string")
    path = shared_path(spark, "test")
    token_blocks.write_tokens(rows, path, JSON, 0)
    got = sorted((r["start"], r["id"], r["n_tokens"]) for r in token_blocks.read_tokens(spark, path).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2), (7, 2, 3)]


def test_bpe_is_exact(reference):
    bpe, cache = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(8)
    tokens = [t for t in bpe.ranks if len(t) > 1]
    texts = odd_texts() + ["a" * n for n in range(70)] + ["aab" * 300, "x" * 5000]
    texts += [b"".join(rng.choice(tokens) for _ in range(4)).decode("utf-8", "ignore") for _ in range(5000)]
    for text in texts:
        ids = reference.encode_ordinary(text)
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == text.encode()
    assert cache.ids(texts) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_bpe_of_documents(docs, texts, nothing, reference):
    def digest(frame):
        encoded = byte_bpe.encode_documents(frame, RANKS, public_tokenizers.PATTERN)
        return byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)

    got = {r["id"]: (r["n_tokens"], r["ids_sha256"], bytes(r["decoded"])) for r in digest(docs).collect()}
    for key, text in texts:
        ids = reference.encode_ordinary(text or "")
        assert got[key] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (text or "").encode())
    once = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True)
    assert {r["id"]: (r["n_tokens"], r["ids_sha256"], bytes(r["decoded"])) for r in once.collect()} == got
    assert {r["id"]: hashlib.sha256(r["ids"]).hexdigest() for r in once.collect()} == {key: one[1] for key, one in got.items()}
    assert byte_bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert digest(nothing).count() == 0
    assert digest(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))).count() == 2
