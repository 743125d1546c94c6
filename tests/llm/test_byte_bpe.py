import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from textloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(2)
    parts = [" ", "  ", "a", "'s", "'", "\n", "1", "é", "。", "<|endoftext|>", "\t", "don't", "'re", "'ll", "'l", " ", " ", "\x1c", "ß", "٣", "👍🏽", "'ve"]
    return ["", " ", "\n", "x", "a" * 5000, " " * 4000, "y z " * 2000] + ["".join(r.choices(parts, k=r.randint(1, 200))) for _ in range(300)]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_split_equals_the_pattern(piece, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_PIECE", piece)
    raw = [t.encode() for t in texts()]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = [buf[a:b].tobytes() for a, b in zip(*byte_bpe.pretokens(buf, off), strict=True)]
    pattern = P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")
    assert got == [m.encode() for t in texts() for m in regex.findall(pattern, t)]


def test_encode_and_decode(spark, enc):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "a b", 2), (5, None, 3), (5, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted((str(i), enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    got = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    digests = byte_bpe.encode(df, PATH, P.PATTERN, digests=True).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(raw)) for i, ids, raw in want)
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_other_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        byte_bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, r"\w+|\s+")
