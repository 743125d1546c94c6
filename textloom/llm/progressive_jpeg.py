"""Media columns: texts kept without loss in progressive JPEGs, and images read into full-resolution RGB tensors.

A payload byte b is the coefficient b - 128 (the format's unit), with a quantisation of 1, so that nothing is lost: 64
bytes are a block in zigzag order, three blocks an MCU of an image without subsampling, about as high as wide; MCUs
that fill the last row up are zero. The payload's length stands in a comment. Reading takes any progressive
JPEG with 8-bit samples: it accumulates its scans into coefficient arrays, and on demand transforms them and
upsamples the chroma.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import jpeg_codec
from textloom.llm.batches import as_buffer, blocks
from textloom.sources.tables import table

UNIT = 192
_NOTE = b"payload "
_BATCH = 3 << 20
#: Images handled at once: even an empty text has a file with its tables.
_ROWS = 4096


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of 192."""
    return text + b" " * (-len(text) % UNIT or UNIT * (not text))


def pictures(payloads: list[bytes]) -> list[bytes]:
    images, wide, notes = [], [], []
    for data in payloads:
        c = np.frombuffer(data, np.uint8).astype(np.int16).reshape(-1, 3, 64) - 128
        w = int(np.ceil(np.sqrt(len(c))))
        images.append(np.concatenate([c, np.zeros((-len(c) % w, 3, 64), np.int16)]))
        wide.append(w)
        notes.append(_NOTE + len(data).to_bytes(8, "big"))
    return jpeg_codec.Writer().write(images, wide, notes) if images else []


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with the JPEG of each text (null: of an empty one) in place of the text; a column named out_col is replaced."""
    rest = docs.drop(*({out_col} - {text_col}))
    names = [f"_{i}" for i in range(len(rest.columns))]
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, names[at], _BATCH, _ROWS):
            buf, off = as_buffer(batch.column(at))
            raw = buf.tobytes()
            files = pictures([payload(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            columns = list(batch.columns)
            columns[at] = pa.array(files, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = rest.toDF(*names)
    fields = [T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(plain.schema.fields)]
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*(out_col if c == text_col else c for c in rest.columns))


def _describe(image: jpeg_codec.Image, sums: np.ndarray) -> str:
    """Size, and mean and deviation of each colour in hundredths. sums: of the three colours, then of their squares."""
    n = max(1, image.high * image.wide)
    mean = sums[:3] / n
    spread = np.sqrt(np.maximum(sums[3:] / n - mean * mean, 0))
    return f"{image.high}x{image.wide};" + ",".join(f"{round(100 * m)}:{round(100 * s)}" for m, s in zip(mean.tolist(), spread.tolist(), strict=True))


def _read(files: list[bytes], tensors: bool) -> list[tuple]:
    """(payload, high, wide, feature, rgb) of each file."""
    images, coef, first = jpeg_codec.read_coefficients(files)
    alike = [len(im.comps) == 3 and all(c[1:3] == (1, 1) for c in im.comps) and im.high % 8 == 0 == im.wide % 8 for im in images]
    out = []
    plain = np.flatnonzero([a and all((c[3] == 1).all() for c in im.comps) for a, im in zip(alike, images, strict=True)])
    sums: dict[int, np.ndarray] = {}
    if not tensors and len(plain):  # colours block by block, for all images at once
        per = np.array([images[i].blocks // 3 for i in plain])
        order = np.concatenate([np.arange(n) + first[i] for i, n in zip(plain, per, strict=True)])
        gap = np.repeat(per, per)
        pixel = jpeg_codec.samples(coef, np.ones(64)) if len(plain) == len(images) else jpeg_codec.samples(coef[np.r_[order, order + gap, order + 2 * gap]], np.ones(64))
        if len(plain) == len(images):
            rgb = jpeg_codec.to_rgb(pixel[order], pixel[order + gap], pixel[order + 2 * gap])
        else:
            rgb = jpeg_codec.to_rgb(*np.split(pixel, 3))
        one = rgb.astype(np.int64)
        both = np.concatenate([one.sum(1), (one * one).sum(1)], 1)
        total = np.add.reduceat(both, np.cumsum(per) - per)
        sums = dict(zip(plain.tolist(), total, strict=True))
    for i, im in enumerate(images):
        c = coef[first[i] : first[i + 1]]
        note = next((n[len(_NOTE) :] for n in im.comments if n.startswith(_NOTE) and len(n) == len(_NOTE) + 8), None)
        data = None
        if note is not None and alike[i]:
            data = (c.reshape(3, -1, 64).transpose(1, 0, 2) + 128).astype(np.uint8).tobytes()[: int.from_bytes(note, "big")]
        rgb = None
        if i not in sums:
            rgb = jpeg_codec.tensor(im, c)
            x = rgb.reshape(-1, 3).astype(np.int64)
            sums[i] = np.r_[x.sum(0), (x * x).sum(0)]
        out.append((data, im.high, im.wide, _describe(im, sums[i]), rgb.tobytes() if tensors else None))
    return out


def decode(media: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """media with payload (null if no text was stored), height, width, feature, and with tensors rgb: height x width x 3 bytes.

    The media column goes; columns of these names are replaced. A null stays null in all of them; bytes that
    are no progressive JPEG raise an error.
    """
    new = ["payload", "height", "width", "feature", *(["rgb"] if tensors else [])]
    rest = media.drop(*(set(new) - {media_col}))
    names = [f"_{i}" for i in range(len(rest.columns))]
    at = rest.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, names[at], _BATCH, _ROWS):
            files = batch.column(at).to_pylist()
            some = iter(_read([f for f in files if f is not None], tensors))
            rows = [(None,) * 5 if f is None else next(some) for f in files]
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            made = [pa.array([r[j] for r in rows], kinds[j]) for j in range(len(new))]
            yield pa.RecordBatch.from_arrays([c for j, c in enumerate(batch.columns) if j != at] + made, [n for j, n in enumerate(names) if j != at] + new)

    plain = rest.toDF(*names)
    kept = [f for i, f in enumerate(plain.schema.fields) if i != at]
    kinds = [T.BinaryType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.BinaryType()]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=False))])
    return plain.mapInArrow(run, schema).toDF(*(c for c in rest.columns if c != media_col), *new)


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG and read back. A null text counts as empty; repeated rows each have a row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    media = encode(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return decode(media, tensors=False).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


QUERIES = {"op10_progressive_jpeg": op10_progressive_jpeg}
