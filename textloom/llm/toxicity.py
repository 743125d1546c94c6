"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases and maps homoglyphs, digit and symbol substitutions to Latin letters, one character
for one. The lexicon's weights (log odds of a word's document frequency in toxic and other texts), its
exception phrases (a lexicon word with a neighbour, seen only in texts that are not toxic) and the final
logistic curve are learned from a bounded sample of labelled rows (`sample_rows`, by least hash of the
id: the one part that is not made from all rows). A hit must stand between characters that are neither
letters nor digits, and outside every exception phrase found in the text. Scores rest on the hits' sum of
weights, its ratio to the text's length, and the number of different words hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.batches import blocks
from textloom.llm.splits import bounded_sample, fold, one_of_each
from textloom.sources.tables import table
from textloom.storage import stash

_HOMOGLYPHS = {
    "a": "аαɑ@4", "b": "ЬВвß8", "c": "сϲ", "d": "ԁ", "e": "еε3ё", "g": "ɡ9", "h": "һнН", "i": "іιı1ï|", "j": "ј", "k": "κкК", "l": "ӏⅼ", "m": "мМ", "n": "ոη",
    "o": "оοσ0О", "p": "рρР", "q": "ԛ", "r": "г", "s": "ѕ$5", "t": "тτ7Т", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχХ×", "y": "уүγУ", "z": "ᴢ2",
}


def _fold_table() -> dict[int, int]:
    out = {ord(x.upper()): ord(latin) for latin, many in _HOMOGLYPHS.items() for x in many if len(x.upper()) == 1 and not x.isascii()}
    out |= {ord(x): ord(latin) for latin, many in _HOMOGLYPHS.items() for x in many}
    out |= {0xFF21 + i: 97 + i for i in range(26)} | {0xFF41 + i: 97 + i for i in range(26)}  # full width
    out |= {i: ord(chr(i).lower()) for i in [*range(65, 91), *range(0xC0, 0xDF)] if i != 0xD7 and len(chr(i).lower()) == 1}
    return out | {i: 32 for i in (9, 10, 11, 12, 13, 0xA0)}


_FOLD = _fold_table()
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Longer "words" enter no lexicon.
_LONGEST = 40


def fold_text(text: str) -> str:
    """Folded text of the same length."""
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0])  # bias, then a factor for each feature

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.words = ahocorasick.Automaton()
        for word, weight in lexicon.weights.items():
            self.words.add_word(word, (len(word), word, weight))
        for phrase in lexicon.exceptions:
            if phrase not in lexicon.weights:
                self.words.add_word(phrase, (len(phrase), phrase, None))
        if len(self.words):
            self.words.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, word, weight) of the hits that stand alone and outside exception phrases."""
        if not len(self.words) or not text:
            return []
        found, except_at = [], []
        for last, (n, word, weight) in self.words.iter(fold_text(text)):
            a, b = last - n + 1, last + 1
            if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
                continue
            if weight is None:
                except_at.append((a, b))
            else:
                found.append((a, b, word, weight))
        if except_at:
            reach, covers, i = -1, [], 0
            except_at.sort()
            for hit in sorted(found):
                while i < len(except_at) and except_at[i][0] <= hit[0]:
                    reach = max(reach, except_at[i][1])
                    i += 1
                covers.append((hit, reach >= hit[1]))
            found = [hit for hit, inside in covers if not inside]
        return found

    def features(self, text: str, found: list | None = None) -> list[float]:
        found = self.hits(text) if found is None else found
        total = sum(h[3] for h in found)
        return [math.log1p(max(total, 0.0)), 100.0 * total / (len(text) + 200.0), math.log1p(len({h[2] for h in found}))]

    def score(self, text: str, found: list | None = None) -> float:
        z = self.lexicon.curve[0] + sum(a * b for a, b in zip(self.lexicon.curve[1:], self.features(text, found), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Newton steps with a ridge on all but the bias."""
    x = np.c_[np.ones(len(x)), x]
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge * len(x) / 100] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 6000, lexicon_size: int = 500, min_docs: int = 3) -> Lexicon:
    """A lexicon from at most sample_rows labelled ids; labels other than 0 and 1 are not used, and of an id labelled twice the larger counts.

    Of the rows of one id, the one whose text hashes least is learned from. At most lexicon_size words (of 3 to 40
    letters) and as many exception phrases are kept, the most telling first: the lexicon is sent to all tasks.
    Texts that are null count as empty. Without both labels among the rows the lexicon is empty and every score 0.
    """
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = named.join(F.broadcast(bounded_sample(named, "id", sample_rows)), "id", "left_semi")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = stash(one_of_each(texts, "id", ["text", "y"]).select("text", "y"), "toxic-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            seen: dict[tuple[str, int], int] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for w in {w for w in _WORD.findall(fold_text(text or "")) if len(w) <= _LONGEST} | {""}:
                    seen[w, y] = seen.get((w, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([n * (k[1] == 1) for k, n in seen.items()], pa.int64()), pa.array([n * (k[1] == 0) for k, n in seen.items()], pa.int64())], ["word", "bad", "good"])

    counts = rows.mapInArrow(words, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("word").isin("") | (F.col("bad") >= min_docs))
    counts = stash(counts, "toxic-words")
    sure = NormalDist().inv_cdf(1 - 0.5 / max(2, counts.count()))  # half a word by chance
    # the rarest of the words that a toxic text holds are left out above; the most telling are kept
    z = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counts.orderBy((F.col("word") != ""), z.desc(), "word").limit(lexicon_size * 4 + 1).collect()
    every = next((r for r in best if r.word == ""), None)
    if every is None or not every.bad or not every.good:
        return Lexicon()
    weights = {}
    for r in best:
        if r.word == "":
            continue
        odds = math.log((r.bad + 0.5) / (every.bad + 1)) - math.log((r.good + 0.5) / (every.good + 1))
        if odds / math.sqrt(1 / (r.bad + 0.5) + 1 / (r.good + 0.5)) > sure and odds > 2.0 and len(weights) < lexicon_size:
            weights[r.word] = odds
    plain = Lexicon(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = plain.matcher()
        for batch in blocks(batches, "text"):
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                folded = fold_text(text or "")
                near = set()
                for a, b, _, _ in matcher.hits(text or ""):
                    before, after = folded[max(0, a - _LONGEST) : a].split()[-1:], folded[b : b + _LONGEST].split()[:1]
                    near |= {f"{x} {folded[a:b]}" for x in before if folded[a - 1 : a] == " "} | {f"{folded[a:b]} {x}" for x in after if folded[b : b + 1] == " "}
                for p in near:
                    seen.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["phrase", "bad", "good"])

    found = rows.mapInArrow(phrases, "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") == 0) & (F.col("good") >= min_docs))
    mild = Lexicon(weights, [r.phrase for r in found.orderBy(F.col("good").desc(), "phrase").limit(lexicon_size).collect()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = mild.matcher()
        for batch in blocks(batches, "text"):
            x = [matcher.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    x = sorted(rows.mapInArrow(features, "y int, a double, b double, c double").collect())  # sample_rows at most
    return Lexicon(mild.weights, mild.exceptions, _logistic(np.array([[r.a, r.b, r.c] for r in x]), np.array([float(r.y) for r in x])))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with toxicity (0 to 1), toxic_hits (the words hit, repeated as found) and is_toxic (toxicity >= threshold).

    A null text counts as empty: it has no hits and the score of an empty text. Every row is kept, repeated
    ones too, with all its columns; columns of these names are replaced. No shuffle.
    """
    rest = docs.drop("toxicity", "toxic_hits", "is_toxic")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        at = names.index(text_col)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [matcher.hits(t or "") for t in texts]
            p = [matcher.score(t or "", h) for t, h in zip(texts, found, strict=True)]
            hits = [[h[2] for h in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(hits, pa.list_(pa.string()))], [*names, "toxicity", "toxic_hits"])

    schema = T.StructType([*rest.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_hits", T.ArrayType(T.StringType()))])
    return rest.mapInArrow(run, schema).withColumn("is_toxic", F.col("toxicity") >= threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document, by a lexicon of the labelled rows outside fold 0 of 5. Null texts count as empty; repeated rows each have a row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
