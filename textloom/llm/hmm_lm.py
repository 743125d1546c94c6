"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward recursion.

Tokens are lower-cased words and one end for each text. Words fall by hash into `classes` classes (the end is
a class of its own), so the model's size does not grow with the vocabulary, while counts are kept for every
word: p(text) is the hidden Markov model's probability of the class sequence times, for each word, its share
(c + 1) / (N + V + 1) of its class; N and V are the class's training tokens and distinct training words.

Training: initial values come from all training texts, dealt to the states by hash of their words; then each
of `rounds` rounds runs forward-backward over all training texts, sums the expected counts by state in the
partitions, adds the partitions' sums after one shuffle, and re-estimates. Texts of over `SEGMENT` tokens are worked
on in segments side by side; each segment's product of transfer matrices carries the forward and backward values
over the cuts, so the counts are those of the whole text and memory stays that of segments. Words are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.batches import as_buffer, blocks, mix, words
from textloom.llm.block_dictionary import Local, block_number, bucket_bits, by_frequency, pack, unpack
from textloom.llm.splits import fold
from textloom.sources.tables import table
from textloom.storage import stash, stash_bucketed

CLASS_BITS = 14
SEGMENT = 1024
_BLOCK = 8 << 20
_LANES = 3 << 19  # a block of words; tokens for which forward and backward values are held at once
_SCALE = 4  # steps after which forward values are brought back to 1
END = np.uint64(0x5EED0F0E0D0C0B0A)
_SLICE = 1 << 10
_MERGE = 1 << 20  # words of chunks held before they are merged


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # (classes + 1) x states; each column sums to 1


def token_classes(hashes: np.ndarray) -> np.ndarray:
    """A class for each hash: the top bits, or the last class for the end."""
    return np.where(hashes == END, np.uint32(1 << CLASS_BITS), (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.uint32))


def _lanes(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: their order, first places, and how many are still on at each step."""
    order = np.argsort(-length, kind="stable")
    lens = length[order]
    on = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0] if len(lens) else 0), "right")
    return order, begin[order], on


def forward(model: Model, cls: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each of the class sequences that stand one after another in cls."""
    order, at, on = _lanes(np.cumsum(length) - length, length)
    total = np.zeros(len(length))
    alpha = np.empty((0, 0))
    for t, n in enumerate(on.tolist()):
        e = model.emit[cls[at[:n] + t]]
        alpha = (model.start if t == 0 else alpha[:n] @ model.move) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.zeros(len(length))
    out[order] = total
    return out


def _steps(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Sequences side by side: their order by falling length, each step's places, and the place of every token."""
    order, _, on = _lanes(begin, length)
    edge = np.r_[0, np.cumsum(on)]  # tokens stand by step, then by lane
    lane = np.empty(len(length), np.int64)
    lane[order] = np.arange(len(length))
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return order, list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)), edge[step] + np.repeat(lane, length)


def _groups(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of segments of about _LANES tokens."""
    end, i = np.cumsum(length), 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + _LANES, "right")))
        yield i, j
        i = j


def _transfers(move: np.ndarray, emit: np.ndarray, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each segment the product of move x emission over its tokens, up to a factor: n x states (before) x states (after)."""
    states, pull = len(move), np.ascontiguousarray(move.T)
    emit = emit / emit.max(0)
    out = np.empty((len(length), states, states), np.float32)
    for i, j in _groups(length):
        order, cut, place = _steps(begin[i:j], length[i:j])
        c = np.empty(len(place), np.int64)
        c[place] = np.concatenate([cls[b : b + n] for b, n in zip(begin[i:j].tolist(), length[i:j].tolist(), strict=True)])
        now = np.repeat(np.eye(states, dtype=np.float32)[:, None, :], j - i, 1)  # after x lane x before
        for t, (a, b) in enumerate(cut):
            x = (pull @ now[:, : b - a].reshape(states, -1)).reshape(states, b - a, states)
            x *= np.take(emit, c[a:b], axis=1, mode="clip")[:, :, None]
            if t % 4 == 3:
                x /= x[:, :, 0].sum(0)[None, :, None]
            if b - a == now.shape[1]:
                now = x
            else:
                now[:, : b - a] = x
        out[i + order] = now.transpose(1, 2, 0)
    return out


def _carried(model: Model, cls: np.ndarray, begin: np.ndarray, seg: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the segments of all sequences: whether they begin one, the forward values before them, and the backward ones after them."""
    move, emit, start = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T, np.float32), model.start.astype(np.float32)
    last, head = np.cumsum(parts) - 1, np.zeros(len(seg), bool)
    head[last - parts + 1] = True
    before, after = np.tile(start[:, None], len(seg)), np.ones((len(start), len(seg)), np.float32)
    if (parts > 1).any():
        many = np.flatnonzero(np.repeat(parts > 1, parts))
        passed = np.empty((len(seg), len(start), len(start)), np.float32)
        passed[many] = _transfers(move, emit, cls, begin[many] + head[many], seg[many] - head[many])  # no move leads to a text's first token
        for k in range(int(parts.max()) - 1):
            on = (last - parts + 1 + k)[parts > k + 1]
            x = (before[:, on] if k else before[:, on] * emit[:, cls[begin[on]]]).T[:, None, :] @ passed[on]
            before[:, on + 1] = (x[:, 0] / x.sum((1, 2))[:, None]).T
            on = (last - k)[parts > k + 1]
            y = passed[on] @ after[:, on].T[:, :, None]
            after[:, on - 1] = (y[:, :, 0] / y.max((1, 2))[:, None]).T
    return head, before, after


def expected(model: Model, cls: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of the sequences: starts, moves, emissions (classes + 1 x states), and the log likelihood."""
    states = len(model.start)
    starts, moves, emissions, total = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), 0.0
    move, emit = model.move.astype(np.float32), np.ascontiguousarray(model.emit.T, np.float32)
    parts = np.maximum(-(-length // SEGMENT), 1)
    seg = np.full(int(parts.sum()), SEGMENT, np.int64)
    seg[np.cumsum(parts) - 1] = length - (parts - 1) * SEGMENT
    begin = np.cumsum(seg) - seg
    head, before, after = _carried(model, cls, begin, seg, parts)
    most = emit.max(0)
    emit, back = emit / most, np.ascontiguousarray(move.T)  # a place's best emission is 1, so values may go unscaled for some steps
    for i, j in _groups(seg):
        base, end = int(begin[i]), int(begin[j - 1] + seg[j - 1])
        order, cut, place = _steps(begin[i:j] - base, seg[i:j])
        c = np.empty(end - base, np.int64)
        c[place] = cls[base:end]
        every = np.bincount(c, minlength=len(most))
        total += float(np.log(most, dtype=np.float64) @ every)
        seen = np.empty((states, len(c)), np.float32)
        for s in range(states):
            np.take(emit[s], c, mode="clip", out=seen[s])
        first, initial = head[i:j][order], before[:, i:j][:, order]
        alphas = np.empty((states, len(c)), np.float32)
        for t, (a, b) in enumerate(cut):
            alpha = alphas[:, a:b]
            x = cut[t - 1][0] if t else 0
            np.multiply(back @ alphas[:, x : x + b - a] if t else np.where(first, initial, back @ initial), seen[:, a:b], out=alpha)
            if t % _SCALE == 0:
                scale = alpha.sum(0)
                total += float(np.log(scale, dtype=np.float64).sum())
                alpha /= scale
                seen[:, a:b] /= scale  # what the way back is scaled by
        ends = np.array([x for x, _ in cut])[seg[i:j][order] - 1] + np.arange(j - i)
        total += float(np.log(alphas[:, ends].sum(0, dtype=np.float64)).sum())
        beta = after[:, i:j][:, order]
        beta = beta / (alphas[:, ends] * beta).sum(0)
        for t in range(len(cut) - 1, -1, -1):
            a, b = cut[t]
            pull = seen[:, a:b] * beta[:, : b - a]
            if t:
                x = cut[t - 1][0]
                moves += alphas[:, x : x + b - a] @ pull.T
            else:
                moves += initial[:, ~first] @ pull[:, ~first].T
            alphas[:, a:b] *= beta[:, : b - a]  # the state's probability given the whole sequence
            if t:
                np.matmul(move, pull, out=beta[:, : b - a])
        starts += alphas[:, : j - i][:, first].sum(1, dtype=np.float64)
        part = np.stack([np.bincount(c, weights=alphas[s], minlength=len(emissions)) for s in range(1, states)], 1) if states > 1 else np.zeros((len(emissions), 0))
        emissions += np.c_[np.maximum(every - part.sum(1), 0), part]  # the states' shares of a place are 1 together
    return starts, moves * model.move, emissions, total


def estimate(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, share: np.ndarray, pull: float = 50.0) -> Model:
    """Maximum likelihood, drawn to the classes' own shares by as much as `pull` tokens would."""
    start = (starts + 1) / (starts + 1).sum()
    move = (moves + 1) / (moves + 1).sum(1, keepdims=True)
    emit = emissions + pull * share[:, None]
    return Model(start, move, emit / emit.sum(0))


def first_model(emissions: np.ndarray, share: np.ndarray) -> Model:
    """A model to begin with, from the emissions of texts dealt to the states."""
    states, n = emissions.shape[1], emissions.sum()
    return estimate(np.ones(states), np.eye(states) * n / states * 0.9 + n / states**2 * 0.1, emissions, share)


def local_model(cls: np.ndarray, length: np.ndarray, states: int, rounds: int, seed: int = 11) -> Model:
    """Baum-Welch on some sequences alone, from texts dealt to the states at random."""
    rng = np.random.default_rng(seed)
    share = (np.bincount(cls, minlength=(1 << CLASS_BITS) + 1) + 1.0) / (len(cls) + (1 << CLASS_BITS) + 1)
    state = np.repeat(rng.integers(0, states, len(length)), length)
    emissions = np.stack([np.bincount(cls[state == s], minlength=len(share)) for s in range(states)], 1).astype(float)
    model = first_model(emissions, share)
    for _ in range(rounds):
        model = estimate(*expected(model, cls, length)[:3], share)
    return model


def _merge(words_: np.ndarray, counts: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and their counts, with those of more chunks."""
    every = np.concatenate([words_, *(h for h, _ in held)])
    out, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, at, np.concatenate([counts, *(n for _, n in held)]))
    return out, total


def _bucket_row(bucket: int, words_: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    cls, where = np.unique(token_classes(words_)[counts > 0], return_inverse=True)
    n, v = np.zeros(len(cls), np.int64), np.bincount(where, minlength=len(cls))
    np.add.at(n, where, counts[counts > 0])
    stats = [{"cls": int(a), "n": int(b), "v": int(d)} for a, b, d in zip(cls, n, v, strict=True)]
    kind = pa.list_(pa.struct([("cls", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack(words_)]), pa.array([pack(counts)]), pa.array([stats], kind)], ["bucket", "hashes", "counts", "stats"])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row's end included, and tokens by row."""
    buf, off = as_buffer(column)
    w = words(buf, off)
    n = np.bincount(w.row, minlength=len(off) - 1).astype(np.int64)
    out = np.full(len(w.hash) + len(n), END, np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    return out, n + 1


def _sums(df: DataFrame) -> DataFrame:
    """(part, data): packed arrays added by part, wherever they come from; each task holds its parts' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = unpack(data).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()])], ["part", "data"])

    return df.repartition("part").mapInArrow(run, "part int, data binary")


def score(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", states: int = 8, rounds: int = 14) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: true for rows that are scored but not learned from (null counts as false). A null text counts as
    empty: its one token is the end. Repeated rows are learned from and scored each; other columns are not
    read. Without any training row the counts are zero and the base is log10(1 / 1) for each token.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bits = bucket_bits(spark)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(blocks(batches, "text", _BLOCK, 1 << 18)):
            tokens, n = _tokens(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            own = Local(tokens)
            perm = by_frequency(own.counts)
            train = np.zeros(len(own.hashes), np.uint32)
            train[perm] = np.bincount(own.local[~np.repeat(held, n)], minlength=len(perm))
            begin = np.cumsum(n) - n
            classes = token_classes(own.hashes)[perm]
            on = np.repeat(~held, n)
            dealt = (mix(np.add.reduceat(tokens, begin)) % np.uint64(states) if len(n) else np.zeros(0)).astype(np.uint32)
            bound = own.bounds(bits)
            chunks = [{"bucket": int(b), "hashes": pack(own.hashes[bound[b] : bound[b + 1]]), "train": pack(train[bound[b] : bound[b + 1]])} for b in np.flatnonzero(np.diff(bound))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_number(k)], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(batch.schema.field("id").type)), pa.array([pack(held.astype(np.uint8))]), pa.array([pack(n.astype(np.uint32))]), pa.array([pack(dealt)]), pa.array([pack(own.counts.astype(np.uint32))]),
                 pa.array([pack(own.local)]), pa.array([pack(classes)]), pa.array([pack(classes[own.local[on]].astype(np.uint16))]), pa.array([chunks], pa.list_(pa.struct([("bucket", pa.int32()), ("hashes", pa.binary()), ("train", pa.binary())])))],
                ["block", "ids", "held", "lengths", "dealt", "counts", "local", "classes", "sequence", "chunks"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    made = texts.mapInArrow(to_blocks, f"block long, ids array<{kind}>, held binary, lengths binary, dealt binary, counts binary, local binary, classes binary, sequence binary, chunks array<struct<bucket:int,hashes:binary,train:binary>>")
    stored = stash_bucketed(made, "lm-blocks", "block")  # the end joins by block without moving it again

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's words and their counts, merged as the chunks come, bucket after bucket."""
        now, words_, counts, held, size_ = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for bucket, hashes, train in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashes", "train")), strict=True):
                if bucket != now:
                    if now is not None:
                        yield _bucket_row(now, *_merge(words_, counts, held))
                    now, words_, counts, held, size_ = bucket, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
                held.append((unpack(hashes), unpack(train).astype(np.int64)))
                size_ += len(held[-1][0])
                if size_ > max(_MERGE, len(words_)):
                    words_, counts = _merge(words_, counts, held)
                    held, size_ = [], 0
        if now is not None:
            yield _bucket_row(now, *_merge(words_, counts, held))

    chunks = stored.select("block", F.explode("chunks").alias("c")).select("block", "c.bucket", "c.hashes", "c.train")
    every = chunks.drop("block").repartition("bucket").sortWithinPartitions("bucket")
    totals = stash(every.mapInArrow(total, "bucket int, hashes binary, counts binary, stats array<struct<cls:int,n:long,v:long>>"), "lm-counts", "none")
    size = (1 << CLASS_BITS) + 1
    class_n, class_v = np.zeros(size), np.zeros(size)
    for r in totals.select(F.explode("stats").alias("s")).groupBy("s.cls").agg(F.sum("s.n").alias("n"), F.sum("s.v").alias("v")).collect():  # a row for each class at most
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    all_n, all_v = int(class_n.sum()), int(class_v.sum())
    model = _train(stored, (class_n + 1) / (class_n.sum() + size), states, rounds) if all_n else Model(np.ones(1), np.ones((1, 1)), np.full((size, 1), 1 / size))
    shared = spark.sparkContext.broadcast(pickle.dumps((model.start, model.move, model.emit, class_n, class_v)))  # bounded by states and classes

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's counts; a bucket's row of counts comes before its chunks."""
        words_ = counts = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for block, bucket, hashes, c in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "hashes", "counts")), strict=True):
                if c is not None:
                    words_, counts = unpack(hashes), unpack(c)
                else:
                    out.append((block, bucket, pack(counts[np.searchsorted(words_, unpack(hashes))])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "bucket", "known"])

    asked = chunks.select("block", "bucket", "hashes", F.lit(None).cast("binary").alias("counts")).unionByName(totals.select(F.lit(None).cast("long").alias("block"), "bucket", "hashes", "counts"))
    answers = asked.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first()).mapInArrow(answer, "block long, bucket int, known binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        *parts, n_, v_ = pickle.loads(shared.value)
        model_ = Model(*parts)
        get = lambda c: unpack(left.column(c)[0].as_py())
        local, classes, length, held = get("local"), get("classes"), get("lengths").astype(np.int64), get("held").astype(bool)
        known = right.column("known").to_pylist()
        order = np.argsort(right.column("bucket").to_numpy())
        c = np.concatenate([unpack(known[i]) for i in order])[by_frequency(get("counts"))].astype(np.float64)
        share = np.where(classes == size - 1, 0.0, np.log10(c + 1) - np.log10(n_[classes] + v_[classes] + 1))
        base = np.log10((c + 1) / (all_n + all_v + 1))
        begin = np.cumsum(length) - length
        by_row = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
        total = forward(model_, classes[local], length) / np.log(10) + by_row(share[local])
        return pa.table({"id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(held), "n_tokens": pa.array(length), "n_known": pa.array(by_row((c > 0).astype(np.int64)[local]).astype(np.int64)), "train_tokens": pa.array(np.full(len(length), all_n, np.int64)), "base_score": pa.array(by_row(base[local])), "score": pa.array(total)})

    both = stored.drop("chunks", "dealt", "sequence").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class sequences of each block's training rows, their lengths and the states that they are dealt to."""
    for batch in batches:
        for held, length, dealt, sequence in zip(*(batch.column(c).to_pylist() for c in ("held", "lengths", "dealt", "sequence")), strict=True):
            n, on = unpack(length).astype(np.int64), unpack(held) == 0
            yield unpack(sequence), n[on], unpack(dealt)[on].astype(np.int64)


def _train(stored: DataFrame, share: np.ndarray, states: int, rounds: int) -> Model:
    sequences, size = stored.select("held", "lengths", "dealt", "sequence"), len(share)
    model: Model | None = None
    for _ in range(1 + rounds):
        shared = stored.sparkSession.sparkContext.broadcast(pickle.dumps(model and (model.start, model.move, model.emit)))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, total = pickle.loads(shared.value), None
            for cls, n, dealt in _sequences(batches):
                if now:
                    got = expected(Model(*now), cls, n)[:3]
                else:  # the texts as they are dealt
                    place = cls.astype(np.int64) * states + np.repeat(dealt, n)
                    got = np.zeros(states), np.zeros((states, states)), np.bincount(place, minlength=size * states).reshape(size, states).astype(float)
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            if total is None:
                return
            parts = {-1: np.r_[total[0], total[1].ravel()]}
            parts |= {i: total[2][i * _SLICE : (i + 1) * _SLICE].ravel() for i in range(-(-size // _SLICE))}
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([pack(x.astype(np.float32)) for x in parts.values()])], ["part", "data"])

        found = {r.part: unpack(r.data) for r in _sums(sequences.mapInArrow(count, "part int, data binary")).collect()}  # the model's size
        starts, moves = found[-1][:states], found[-1][states:].reshape(states, states)
        emissions = np.concatenate([found[i].reshape(-1, states) for i in sorted(found) if i >= 0])
        model = estimate(starts, moves, emissions, share) if model else first_model(emissions, share)
    return model


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document, learned from those outside fold 2 of 7. A null text is its end alone; repeated rows are learned from and scored each."""
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


QUERIES = {"op1_hmm_lm": op1_hmm_lm}
