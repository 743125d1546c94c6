"""Very many tiny rows through the operators that hold blocks of rows."""

import resource

import numpy as np
import pyarrow as pa

from textloom.llm import batches as B
from textloom.llm import language_id, near_dedup, progressive_jpeg

ROWS = 400_000


def tiny():
    yield pa.RecordBatch.from_arrays([pa.nulls(ROWS, pa.string())], ["text"])
    yield pa.RecordBatch.from_arrays([pa.array(["abc defg"] * ROWS)], ["text"])


def peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_blocks_bound_rows():
    got = [b.num_rows for b in B.blocks(tiny(), "text", 1 << 20, 1000)]
    assert sum(got) == 2 * ROWS and max(got) == 1000
    mixed = pa.RecordBatch.from_arrays([pa.array(["x" * (i % 7) for i in range(100)])], ["t"])
    parts = list(B.blocks(iter([mixed.slice(0, 33), mixed.slice(33)]), "t", 40, 9))
    assert sum((p.column(0).to_pylist() for p in parts), []) == mixed.column(0).to_pylist()
    assert max(p.num_rows for p in parts) <= 9


def test_tiny_rows_stay_under_a_peak(spark):
    before = peak_mb()
    model = language_id.fit(language_id.unit(np.eye(6, language_id.DIM, dtype=np.float32)), ["a", "b", "c"] * 2)
    rows = 0
    for batch in B.blocks(tiny(), "text", 2 << 20, language_id._ROWS):
        best, p, _ = model.predict(language_id.unit(language_id.ngram_counts(*B.as_buffer(batch.column("text")))))
        rows += len(best)
    assert rows == 2 * ROWS and peak_mb() - before < 400
    for batch in B.blocks(tiny(), "text", 2 << 20, 1 << 14):
        values, at = near_dedup.row_sets(batch.column("text"), 5)
        some = np.flatnonzero(np.diff(at) > 0)
        if len(some):
            assert len(near_dedup.band_keys(near_dedup.minima(values, np.r_[at[some], at[-1]]))) == len(some)
    assert peak_mb() - before < 600
    first = next(B.blocks(tiny(), "text", 3 << 20, progressive_jpeg._ROWS))
    files = progressive_jpeg.pictures([progressive_jpeg.payload(b"")] * first.num_rows)
    assert len(progressive_jpeg._read(files, False)) == progressive_jpeg._ROWS and peak_mb() - before < 900
