import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm.batches import as_buffer
from textloom.llm.token_counts import ChunkedCounter, WordCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    parts = [" ", "  ", "a", "'s", "'", "\n", "1", "é", "。", "<|endoftext|>", "\t", "don't", " the", "👍🏽"]
    return ["", "a" * 3000, " " * 3000, "\n" * 500 + "x" * 500 + " \n " * 400, "é" * 999 + "<|endoftext|> x<|endoftext|>" * 80] + ["".join(r.choices(parts, k=r.randint(10, 900))) for _ in range(80)]


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 16), (700, 50)])
def test_splices_equal_one_encoding(tokenizer, chunk, overlap):
    counter = ChunkedCounter(tokenizer, chunk, overlap)
    for text in texts():
        assert counter.encode_long(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.widened


def test_frame(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "a b", None), (7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(df, PATH, chunk_chars=64, overlap_chars=8, max_tokens=100).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, _ in rows), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(df.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            ChunkedCounter(Tokenizer.from_str(json.dumps(spec | change)))
    cut = Tokenizer.from_str(json.dumps(spec))
    cut.enable_truncation(5)
    cut.enable_padding(length=9)
    assert ChunkedCounter(cut).count(["a b c d e f g h", ""]) == [8, 0]


def test_counts_by_pretoken_equal_whole_encodings():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter, r = WordCounter(tokenizer), random.Random(3)
    pieces = ["word", " the", "  ", "\n", "\t", "'s", "'ll", "'", "12", "é", "Ж", " ж", "—", "…", "«", "\u00a0", ".", "!!", "ß", "x" * 40, "\r\n", "_", "µ", "²", "½", "Ω", "Ԯ", "\x1c", "\x85", "\u0300"]
    odd = ["<|endoftext|>", "中", "😀", "\u2028", "\u0531", "\ufeff"]
    texts = ["", " ", "a", *("".join(r.choices(pieces, k=r.randint(1, 60))) for _ in range(900)), *("".join(r.choices(pieces + odd, k=20)) for _ in range(200))]
    buf, off = as_buffer(pa.array(texts))
    plain = counter.plain(buf, off)
    assert plain.tolist() == [not any(o in t for o in odd) for t in texts] and 400 < plain.sum() < len(texts)
    some = [t for t, p in zip(texts, plain, strict=True) if p]
    want = [len(e.ids) for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    assert counter.count(*as_buffer(pa.array(some))).tolist() == want == counter.count(*as_buffer(pa.array(some))).tolist()


def test_all_ways_agree_on_whole_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, r = Tokenizer.from_file(path), random.Random(8)
    say = lambda n: " ".join(r.choice(["foo", "Bär", "it's", "12", "中文", "<|endoftext|>", "a  b"]) for _ in range(n))
    rows = [(i, say(r.choice([0, 3, 40, 400]))) for i in range(80)] + [(900, None), (901, "plain " * 900)]
    got = {x.doc_id: (x.n_tokens, x.n_bytes) for x in token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, chunk_chars=300, overlap_chars=20).collect()}
    assert got == {i: (len(tokenizer.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in rows}
