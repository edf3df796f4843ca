import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickpulse.llm import rolling, transducer, wavelet
from tickpulse.llm.scratch import fresh_path
from tickpulse.llm.token_files import ByteEncoder, read_tokens, write_tokens
from tickpulse.llm.word_bpe import WordEncoder, compile_lexicon, encode_decode

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
BITS = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\t", " ", "a", "B", "é", "É", "ß", "1", "²", "!", "...", "the", "'ll", "　", "日本", "😀", "​", "é", "'S", "\r\n", "\x85", " ", "<|endoftext|>", "İ", "ΑΣ", "\x00", "“x”", "Ⱥ", "\U0001e900"]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_encoders_equal_the_library():
    t = texts(0, 5000)
    ids, count = ByteEncoder.load(BYTE).encode(*rolling.utf8_buffer(pa.array(t)))
    got = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(t, add_special_tokens=False)]
    word, library = WordEncoder.load(WORD), Tokenizer.from_file(WORD)
    for x, e in zip(word.encode(pa.array(t)), library.encode_batch(t, add_special_tokens=False)):
        assert x.tolist() == e.ids
        assert word.decode(x).decode() == library.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 70_000])
def test_wavelet_file(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 300).astype(np.int64)
    content = wavelet.build(ids, np.array([4, 0]), np.array([True, False]), np.array([0, n // 2]), 9)
    w = wavelet.WaveletMatrix(content)
    assert w.tokens().tolist() == ids.tolist() and len(w) == n
    assert w.doc_ids.tolist() == [4, 0] and w.known.tolist() == [True, False]
    for c in {0, 1, 2, 299, 511, *ids[:3].tolist()}:
        at = np.flatnonzero(ids == c)
        assert w.count(c) == len(at) and w.count(c, 5, n // 2) == int(((at >= 5) & (at < n // 2)).sum())
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert w.select(c, k) == at[k] and w.rank(c, int(at[k])) == k
    for i in rng.integers(0, n, 20) if n else ():
        assert w.access(int(i)) == ids[i]
    if n:
        small = wavelet.WaveletMatrix(wavelet.build(ids[:50], np.array([1]), np.array([True]), np.array([0]), 9))
        assert small.document(0) == ids[:50].tolist() and small.positions(int(ids[0])) == np.flatnonzero(ids[:50] == ids[0]).tolist()
        with pytest.raises(IndexError):
            w.select(511, 0)


def test_transducer():
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"abc\xc3") for _ in range(r.randint(1, 8))) for _ in range(2000)})
    ids = [[i, len(w)] for i, w in enumerate(words)]
    t = transducer.Transducer(np.frombuffer(transducer.build(words, ids), np.uint8))
    assert t.numbers(words).tolist() == list(range(len(words))) and [t.output(i) for i in range(len(words))] == ids
    others = [w + b"z" for w in words] + [b"", b"\xff", b"abcabcabcabc"]
    assert (t.numbers(others) == -1).all()
    shared = transducer.Transducer(np.frombuffer(transducer.build([b"nation", b"ration", b"station"], [[1], [2], [3]]), np.uint8))
    assert len(shared.key) == 9  # n, r, s, the t after s, and once a, t, i, o, n
    empty = transducer.Transducer(np.frombuffer(transducer.build([], []), np.uint8))
    assert empty.numbers([b"a"]).tolist() == [-1]


ROWS = [(5, None), (None, "no id"), (3, ""), (1, "Hello world's end"), (2, "x " * 30_000), (2, "x " * 30_000), (9, "<|endoftext|> ß"), (7, "日本 é İ")]


def test_token_files(spark):
    library = Tokenizer.from_file(BYTE)
    rows = ROWS + [(100 + i, t) for i, t in enumerate(texts(3, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(4)
    folder = fresh_path(spark, "files")
    manifest = write_tokens(docs, BYTE, folder, shard_bytes=2000)
    assert manifest.count() > 3
    got = sorted(read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    text, at = {i: t for i, t in rows}, 0
    for r in got:
        want = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.ids == want and r.start == at and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_token_files_of_an_empty_table(spark):
    folder = fresh_path(spark, "files")
    manifest = write_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE, folder)
    assert read_tokens(spark, folder, manifest).count() == 0


@pytest.mark.parametrize("words", [0, 40])
def test_encode_decode(spark, words):
    library = Tokenizer.from_file(WORD)
    rows = ROWS + [(100 + i, t) for i, t in enumerate(texts(4, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).repartition(4)
    got = encode_decode(docs, WORD, compile_lexicon(docs, WORD, words=words)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) == want[r.doc_id] for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(empty, WORD, compile_lexicon(empty, WORD)).count() == 0
