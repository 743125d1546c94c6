"""Similarity of every row to a stated set of vectors, in blocks: best match, top k, routing tiers.

The set (ideas, queries) is cut into blocks of a bounded number of numbers; each is sent to all tasks, which
multiply their rows with it. Nothing is shuffled but the blocks' answers where there is more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import stash

#: Numbers in a block that is sent to all tasks.
BLOCK_NUMBERS = 8 << 20
#: Blocks after which the answers so far are merged and written down, so that no task chains many steps.
BLOCKS_AT_ONCE = 4


#: Lengths of vectors that end in a block of 128 formula features, by the lengths of the usual text vectors.
COMPOSITE = (768 + 128, 1024 + 128, 1536 + 128, 3072 + 128)
FORMULA_DIMS = 128


def _unit(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > least)


def _blocks(x: np.ndarray, formula: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Unit text blocks and, where vectors end in formula features, unit formula blocks (zero where there is no formula)."""
    d = x.shape[1] - formula
    return _unit(x[:, :d]), _unit(x[:, d:], 1e-6) if formula else None


def _cosines(a: tuple, b: tuple, alpha: float) -> np.ndarray:
    """Cosines of the text blocks; where both sides have a formula, the mix with that of the formula blocks if it is more."""
    sims = a[0] @ b[0].T
    if a[1] is None:
        return sims
    both = a[1].any(1)[:, None] & b[1].any(1)[None, :]
    return np.where(both, np.maximum(sims, (1 - alpha) * sims + alpha * (a[1] @ b[1].T)), sims)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length; zero rows for nulls and other lengths."""
    return _unit(_rows(column, dim))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as they are; zero rows for nulls and other lengths."""
    out = np.zeros((len(column), dim))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    if len(at):
        flat = column.take(pa.array(at)).flatten()
        out[at] = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    return out


def unit_blocks(column: pa.Array | pa.ChunkedArray, dim: int, formula: int = 0) -> tuple:
    """A column's vectors as blocks of unit length for cosines and first_near; zero rows for nulls and other lengths."""
    return _blocks(_rows(column, dim), formula)


def take_blocks(blocks: tuple, at: np.ndarray | slice) -> tuple:
    return blocks[0][at], None if blocks[1] is None else blocks[1][at]


def cosines(a: tuple, b: tuple, alpha: float = 0.35) -> np.ndarray:
    return _cosines(a, b, alpha)


def first_near(a: tuple, b: tuple, least: float, alpha: float = 0.35, tile: int = 2048) -> np.ndarray:
    """For each row of a the place of the first row of b whose cosine is `least` or more, -1 where none is. b in tiles; rows that have found one meet no more."""
    out, left = np.full(len(a[0]), -1), np.arange(len(a[0]))
    for s in range(0, len(b[0]), tile):
        hit = _cosines(take_blocks(a, left), take_blocks(b, slice(s, s + tile)), alpha) >= least
        found = hit.any(1)
        out[left[found]] = s + hit[found].argmax(1)
        left = left[~found]
        if not len(left):
            break
    return out


def nearest(rows: DataFrame, targets: DataFrame, k: int, row_vec: str = "embedding", target_id: str = "idea_id", target_vec: str = "embedding", out: str = "hits", least: float | None = None, formula_dims: int | None = None, alpha: float = 0.35) -> DataFrame:
    """rows with an array of their k best targets (id, sim), best first, ties by id; with `least` only those of that similarity or more.

    Vectors that are null, zero or of another length than the targets' most common one are similar to nothing
    (similarity 0). Without targets the array is empty. formula_dims: so many numbers at the end are formula features
    (by default 128 in vectors of the COMPOSITE lengths, none in others): pairs that both have some are compared by the
    text's cosine or, if it is more, its mix with the formulas' by alpha; others by the text's alone.
    """
    spark = rows.sparkSession
    usable = targets.where(F.col(target_vec).isNotNull() & F.col(target_id).isNotNull()).select(F.col(target_id).alias("t"), F.col(target_vec).alias("v"))
    shape = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    kind = targets.schema[target_id].dataType.simpleString()
    if shape is None:
        return rows.withColumn(out, F.array().cast(f"array<struct<id:{kind},sim:double>>"))
    dim, total = shape["dim"], shape["count"]
    usable = usable.where(F.size("v") == dim)
    formula = (FORMULA_DIMS if dim in COMPOSITE else 0) if formula_dims is None else formula_dims if formula_dims < dim else 0
    blocks = max(1, -(-total * dim // BLOCK_NUMBERS))
    name, made = f"_{out}", []
    for b in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("t").toPandas()  # about BLOCK_NUMBERS numbers
        ids = part["t"].tolist()
        matrix = np.array(part["v"].tolist(), np.float64).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((ids, _blocks(matrix, formula)))
        rows = _multiply(rows, shared, k, dim, formula, alpha, row_vec, kind, f"{name}{b}", least)
        made.append(f"{name}{b}")
        if b == blocks - 1 or len(made) > BLOCKS_AT_ONCE:
            together = F.concat(*map(F.col, made))
            best = F.slice(F.array_sort(together, lambda x, y: F.when(x["sim"] > y["sim"], -1).when(x["sim"] < y["sim"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)), 1, k) if len(made) > 1 else together
            rows = rows.withColumn(name, best).drop(*(c for c in made if c != name))
            made = [name]
            if b < blocks - 1:
                rows = stash(rows, "nearest")
    return rows.withColumnRenamed(name, out) if out not in rows.columns else rows.withColumn(out, F.col(name)).drop(name)


def _multiply(rows: DataFrame, shared, k: int, dim: int, formula: int, alpha: float, row_vec: str, kind: str, name: str, least: float | None) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    names, at = rows.columns, rows.columns.index(row_vec)
    fields = T.ArrayType(T.StructType([T.StructField("id", id_type := T._parse_datatype_string(kind)), T.StructField("sim", T.DoubleType())]))

    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        names_ = pa.array(ids, id_kind)
        m = min(k, len(ids))
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                sims = _cosines(_blocks(_rows(batch.column(at), dim), formula), matrix, alpha)
                if m == 1:
                    top = sims.argmax(1)[:, None]
                elif m < len(ids):
                    edge = np.partition(sims, len(ids) - m, axis=1)[:, len(ids) - m]
                    top = np.stack([c[np.lexsort((c, -s[c]))][:m] for s, c in ((s, np.flatnonzero(s >= e)) for s, e in zip(sims, edge, strict=True))])
                else:
                    top = np.argsort(-sims, 1, kind="stable")
                best = np.take_along_axis(sims, top, 1)
                keep = np.ones(best.shape, bool) if least is None else best >= least
                fields_ = pa.StructArray.from_arrays([names_.take(pa.array(top[keep])), pa.array(best[keep])], ["id", "sim"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32)), fields_)], [*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, fields)]))


def best_match(rows: DataFrame, targets: DataFrame, **names: str | int | float) -> DataFrame:
    """rows with best_id and max_sim (0.0 and null id without targets)."""
    out = nearest(rows, targets, 1, out="_best", **names)
    first = F.try_element_at("_best", F.lit(1))
    return out.withColumn("best_id", first["id"]).withColumn("max_sim", F.coalesce(first["sim"], F.lit(0.0))).drop("_best")


def tier(sim: Column, low: float, high: float) -> Column:
    return F.when(sim < low, "unassigned").when(sim >= high, "high_confidence").otherwise("limbo")


def route(rows: DataFrame, targets: DataFrame, low: float = 0.65, high: float = 0.90, size: Column | None = None, formula: Column | None = None, recover_at: int = 1024, **names: str | int | float) -> DataFrame:
    """rows with best_id, max_sim, tier and recovered: limbo rows with a formula or of that size are to be extracted after all.

    Without targets every row is unassigned.
    """
    out = best_match(rows, targets, **names)
    big = F.coalesce(size >= recover_at, F.lit(False)) if size is not None else F.lit(False)
    shield = F.coalesce(formula, F.lit(False)) if formula is not None else F.lit(False)
    kind = F.when(F.col("best_id").isNull(), "unassigned").otherwise(tier(F.col("max_sim"), low, high))
    out = out.withColumn("_tier", kind).withColumn("recovered", (F.col("_tier") == "limbo") & (big | shield))
    return out.withColumn("tier", F.when(F.col("recovered"), "unassigned").otherwise(F.col("_tier"))).drop("_tier")


def extraction_queue(routed: DataFrame, order: list[str], limbo: bool = True) -> DataFrame:
    """Rows to extract, unassigned first, then (if asked) limbo, each in the given order."""
    kinds = ["unassigned", "limbo"] if limbo else ["unassigned"]
    rank = F.when(F.col("tier") == "unassigned", 0).otherwise(1)
    return routed.where(F.col("tier").isin(kinds)).withColumn("priority", rank).orderBy("priority", *order)


def modal_dimension(rows: DataFrame, vec: str = "embedding", target: int | None = None) -> DataFrame:
    """Rows whose vector has the most common length (ties: the longer), or the target length if any has it."""
    counts = rows.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dim")).count()
    wanted = counts.where(F.col("dim") == target).first() if target else None
    best = wanted or counts.orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.lit(False)) if best is None else rows.where(F.size(vec) == best["dim"])
