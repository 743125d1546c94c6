"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of -1 and 1; for each of its bits a logistic classifier over hashed byte
bi- and trigrams of the lower-cased text is fitted on a bounded sample of labelled rows (`sample_rows`,
by least hash of the id: the one part that is not made from all rows). Decoding sums, over the bits, the
logistic loss of margin x code bit, weighted by how often the bit's classifier was right about that
language in training; the language of the least sum wins. A text whose two best sums lie within
`ambiguity` of each other is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.batches import as_buffer, blocks
from textloom.llm.splits import bounded_sample, fold, one_of_each
from textloom.sources.tables import table

DIM = 4096
#: Rows whose counts are held at once, DIM numbers for each.
_ROWS = 512


def ngram_counts(buf: np.ndarray, off: np.ndarray, dim: int = DIM, piece: int = 1 << 20) -> np.ndarray:
    """Rows x dim counts of hashed byte bi- and trigrams of each row, A-Z lower-cased."""
    rows = len(off) - 1
    out = np.zeros(rows * dim, np.float32)
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    for a in range(0, max(len(buf) - 1, 0), piece):
        b = lower[buf[a : a + piece + 2]]
        n = min(piece, len(b) - 1)
        row = np.searchsorted(off, np.arange(a, a + n), "right") - 1
        left = off[row + 1] - np.arange(a, a + n)  # bytes to the row's end
        two = ((b[:n] * 40503 + b[1 : n + 1] * 2654435761) >> 7) % dim
        ok = left >= 2
        first, last = row[0], row[-1] + 1
        part = np.bincount((row[ok] - first) * dim + two[ok], minlength=(last - first) * dim)
        m = min(n, len(b) - 2)
        if m > 0:
            three = ((b[:m] * 2246822519 + b[1 : m + 1] * 3266489917 + b[2 : m + 2] * 668265263) >> 9) % dim
            ok = left[:m] >= 3
            part = part + np.bincount((row[:m][ok] - first) * dim + three[ok], minlength=(last - first) * dim)
        out[first * dim : last * dim] += part
    return out.reshape(rows, dim)


def unit(counts: np.ndarray) -> np.ndarray:
    """Log counts, scaled to unit length; an empty row stays zero."""
    x = np.log1p(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code for up to 6 languages, else the widest apart of random ones."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        return np.stack([np.ones(len(bits))] + [1 - 2 * ((bits >> i) & 1) for i in range(n - 1)]).astype(np.float32)
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width)).astype(np.float32)
        gap = (code @ code.T + np.eye(n) * -2 * width).max()  # the least distance is (width - gap) / 2
        if np.all(np.abs(code.sum(0)) < n) and (best is None or gap < best[0]):
            best = gap, code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (dim + 1) x bits
    trust: np.ndarray  # languages x bits, each row's sum is 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows x languages: the weighted losses."""
        margin = np.einsum("rd,db->rb", x, self.weights[:-1], optimize=True) + self.weights[-1]
        return np.stack([np.logaddexp(0, -margin * c) @ t for c, t in zip(self.code, self.trust, strict=True)], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score (0 to 1), and by how much the second's loss is more."""
        loss = self.losses(x)
        best = loss.argmin(1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        two = np.sort(loss, 1)[:, :2] if len(self.langs) > 1 else np.c_[loss, loss + 9]
        return best, 1 / p.sum(1), two[:, 1] - two[:, 0]


def fit(x: np.ndarray, y: list[str], rounds: int = 150, rate: float = 8.0, ridge: float = 1e-5) -> Model:
    """One logistic classifier per bit, by gradient steps with momentum."""
    langs = sorted(set(y))
    code = codewords(len(langs))
    at = np.array([langs.index(v) for v in y], np.int64)
    if not langs:
        return Model([], code, np.zeros((x.shape[1] + 1, 1), np.float32), np.ones((0, 1)))
    target = code[at]
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    share = 1 / np.maximum(np.bincount(at, minlength=len(langs)), 1)  # languages count alike
    w_row = (share[at] / share[at].sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    step = np.zeros_like(w)
    for _ in range(rounds):
        margin = x @ w
        grad = x.T @ (-target * w_row / (1 + np.exp(np.clip(target * margin, -30, 30)))) + ridge * w
        step = 0.9 * step - rate * grad
        w += step
    right = (np.sign(x @ w) == target).astype(np.float64)
    trust = np.stack([right[at == i].mean(0) for i in range(len(langs))]) + 1e-3
    return Model(langs, code, w, trust / trust.sum(1, keepdims=True))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 3000) -> Model:
    """Fit on at most sample_rows ids that have a language and some text; rows with a null in any of the three are not used.

    Of the rows of one id, the one whose text and language hash least is learned from.
    """
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = one_of_each(usable.join(F.broadcast(bounded_sample(usable, "id", sample_rows)), "id", "left_semi"), "id", ["text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20, _ROWS):
            x = ngram_counts(*as_buffer(batch.column("text")))
            where = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([w.astype(np.uint16).tobytes() for w in where]), pa.array([r[w].astype(np.float32).tobytes() for r, w in zip(x, where, strict=True)])], ["lang", "at", "n"])

    found = rows.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()  # sample_rows at most
    found.sort(key=lambda r: (r.lang, r.at, r.n))
    x = np.zeros((len(found), DIM), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.float32)
    return fit(unit(x), [r.lang for r in found])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, ambiguity: float = 0.05) -> DataFrame:
    """The columns `keep`, and lang_pred, score, runner_up (null where there is none), ambiguous.

    A null text, one without letters, or any text where no language was learned is `und` with score 0.
    Repeated rows each have a row; columns of keep with the new ones' names are left out. No shuffle; memory is
    bounded by 2 MB of text or one text, and by 512 rows of counts.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score", "runner_up", "ambiguous")]
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20, _ROWS):
            buf, off = as_buffer(batch.column("text"))
            n = batch.num_rows
            lang, score, second, unsure = np.full(n, "und", object), np.zeros(n), np.full(n, None, object), np.zeros(n, bool)
            letter = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122), out=letter[1:])
            some = letter[off[1:]] > letter[off[:-1]]
            for i in np.flatnonzero(~some & (off[1:] > off[:-1])):
                some[i] = any(map(str.isalpha, bytes(buf[off[i] : off[i + 1]]).decode("utf-8", "replace")))
            if model.langs and some.any():
                x = unit(ngram_counts(buf, off))
                best, p, gap = model.predict(x)
                order = model.losses(x).argsort(1)
                langs = np.array(model.langs, object)
                lang[some], score[some], unsure[some] = langs[best[some]], p[some], gap[some] < ambiguity
                if len(langs) > 1:
                    second[some] = langs[order[some, 1]]
            arrays = [batch.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "score", "runner_up", "ambiguous"])

    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    out = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(n) for n, c in zip(names, keep, strict=True))).mapInArrow(run, f"{kinds}lang_pred string, score double, runner_up string, ambiguous boolean")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "lang_pred", "score", "runner_up", "ambiguous")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model of the rows outside fold 0 of 5. A null text or one without a letter is `und`; repeated rows each have a row."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


QUERIES = {"op8_language_id": op8_language_id}
