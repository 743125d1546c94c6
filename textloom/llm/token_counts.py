"""Token counts of whole texts by a tokenizer file, with huge texts encoded in overlapping chunks.

A text of at most `chunk_chars` characters is counted at once: split as the tokenizer does, by the counts of its distinct
pre-tokens, each encoded once in a task, or, where it holds a special token or characters that libraries may class
differently, by one encoding of the whole. A longer one is cut into chunks that
overlap by `overlap_chars`; each is encoded with offsets. Two neighbours are spliced at a stable common
boundary inside their overlap: a place p where text[p] is a space between two characters that are not
white space. There the byte-level pre-tokenizer cuts whatever stands further left (no alternative of its
pattern goes on from a non-space to a space), so what is left of p never depends on what follows, and what
begins at p depends on the right side alone; added special tokens hold no white space, so none spans p. Other kinds of tokenizer are refused. Both
encodings must also show a token boundary at p. If an overlap has no such place the right chunk begins earlier: the overlap doubles, until it takes in everything from
the last splice, which is then encoded as one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.batches import as_buffer, blocks, span_hashes
from textloom.llm.block_dictionary import Local, by_frequency
from textloom.llm.byte_bpe import pretokens
from textloom.sources.tables import table

#: Pre-tokens that a task remembers; beyond it, it begins anew.
_KNOWN = 1 << 20
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def check_stable(tokenizer) -> None:
    """Raise ValueError for a tokenizer for which the places above are not proven to be cuts."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers that split by their own pattern, without normaliser or prefix space, can be spliced")
    for token in spec.get("added_tokens", []):
        if token.get("lstrip") or token.get("rstrip") or any(c.isspace() for c in token["content"]):
            raise ValueError(f"added token {token['content']!r} takes in white space")


class ChunkedCounter:
    """Counts tokens as tokenizer.encode(text, add_special_tokens=False) would, without truncation and padding."""

    def __init__(self, tokenizer, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 10):
        check_stable(tokenizer)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk_chars, max(4, overlap_chars)
        self.widened = 0  # times an overlap had to grow

    def count(self, texts: list[str]) -> list[int]:
        short = [i for i, text in enumerate(texts) if len(text) <= self.chunk]
        out = [0] * len(texts)
        for i, encoding in zip(short, self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
            out[i] = len(encoding.ids)
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = len(self.encode_long(text))
        return out

    def _encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return encoding.ids, encoding.offsets

    def encode_long(self, text: str) -> list[int]:
        """The ids of a text of any length."""
        ids: list[int] = []  # final, for text[:done]
        done = begin = 0  # the open chunk starts at begin <= done
        end = min(len(text), self.chunk)
        left = self._encode(text[begin:end])
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(done, end - overlap)
                if start == done:  # all that is open, as one and twice as long
                    stop = min(len(text), end + max(self.chunk, end - done))
                    begin, end, left = done, stop, self._encode(text[done:stop])
                    break
                stop = min(len(text), end + self.chunk)
                right = self._encode(text[start:stop])
                at = self._splice(text, begin, left[1], start, right[1], end)
                if at is not None:
                    p, i = at
                    ids += self._from(left, begin, done)[: i - self._first(left, begin, done)]
                    done, begin, end, left = p, start, stop, right
                    break
                overlap *= 2
                self.widened += 1
        return ids + self._from(left, begin, done)

    @staticmethod
    def _first(encoded, begin: int, done: int) -> int:
        """The open chunk's first token from `done` on."""
        offsets = encoded[1]
        low, high = 0, len(offsets)
        while low < high:
            mid = (low + high) // 2
            if offsets[mid][0] + begin < done:
                low = mid + 1
            else:
                high = mid
        return low

    def _from(self, encoded, begin: int, done: int) -> list[int]:
        return encoded[0][self._first(encoded, begin, done) :]

    @staticmethod
    def _splice(text: str, begin: int, left: list, start: int, right: list, end: int):
        """The last stable place in text[start:end] at which both chunks have a boundary, and the left one's token there."""
        begins_left = {a + begin: i for i, (a, _) in reversed(list(enumerate(left))) if a + begin >= start}
        begins_right = {a + start for a, _ in right if a + start <= end}
        for match in reversed(list(_STABLE.finditer(text, start + 1, end - 1))):
            p = match.start()
            if p in begins_left and p in begins_right:
                return p, begins_left[p]
        return None


class WordCounter:
    """Counts tokens of plain texts by pre-token: each distinct one is encoded once and remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        self.special = [t["content"].encode() for t in json.loads(tokenizer.to_str()).get("added_tokens", []) if t["content"]]
        probe = "I'll say: 'tis 12  we've\t\n it's''s done.  x \n\nÀé ждёт\u00a0«12»…\u2014 ok "
        at = [(a, b) for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        raw = probe.encode()
        start, end = pretokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if [raw[a:b].decode() for a, b in zip(start, end, strict=True)] != [probe[a:b] for a, b in at]:
            raise ValueError("the tokenizer does not split by the GPT-2 pattern")

    def plain(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows of characters below U+0530 and of common punctuation (U+2010 to U+2027) alone, without a special token."""
        odd = buf >= 0xD5
        after = np.r_[buf[1:], np.zeros(2, np.uint8)]
        odd |= (buf == 0xD4) & (after[: len(buf)] >= 0xB0)
        marks = np.flatnonzero((buf == 0xE2) & (after[: len(buf)] == 0x80))
        odd[marks[(after[marks + 1] >= 0x90) & (after[marks + 1] <= 0xA7)]] = False
        total = np.r_[0, np.cumsum(odd)]
        out = total[off[1:]] == total[off[:-1]]
        raw = buf.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(off, at, "right") - 1] = False
                at = raw.find(token, at + 1)
        return out

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        start, end = pretokens(buf, off)
        own = Local(span_hashes(buf, start, end))
        raw = buf.tobytes()
        distinct = [raw[a:b] for a, b in zip(start[own.first].tolist(), end[own.first].tolist(), strict=True)]
        if len(self.known) > _KNOWN:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        for w, encoding in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.known[w] = len(encoding.ids)
        n = np.array([self.known[w] for w in distinct], np.int64)
        total = np.r_[0, np.cumsum(n[by_frequency(own.counts)][own.local])] if len(n) else np.zeros(1, np.int64)
        at = total[np.searchsorted(start, off)]
        return at[1:] - at[:-1]


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", max_tokens: int = 1024, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 10) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each.
    Other columns are not read. No shuffle; memory is bounded by a batch of about 4 MB of text or one text, and by the pre-tokens remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        counter = ChunkedCounter(Tokenizer.from_file(tokenizer_path), chunk_chars, overlap_chars)
        words = WordCounter(counter.tokenizer)
        for batch in blocks(batches, "text", 4 << 20):
            texts = batch.column("text")
            buf, off = as_buffer(texts)
            chars = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
            plain = words.plain(buf, off) & (chars[off[1:]] - chars[off[:-1]] <= chunk_chars)
            n = np.zeros(batch.num_rows, np.int64)
            n[plain] = words.count(*as_buffer(texts.filter(pa.array(plain))))
            n[~plain] = counter.count([x or "" for x in texts.filter(pa.array(~plain)).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document. A null text counts as empty; repeated rows each have a row."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
