import hashlib
import zlib

import numpy as np
import pytest

from textloom.llm import jpeg_codec as J
from textloom.llm import progressive_jpeg as pj


def test_coefficients_survive_every_scan():
    rng = np.random.default_rng(1)
    images, wide = [], []
    for n, share in ((1, 1.0), (2, 0.1), (6, 0.02), (20, 0.0), (9, 0.5), (64, 1.0), (12, 0.15)):
        w = int(np.ceil(np.sqrt(n)))
        c = rng.integers(-400, 401, (-(-n // w) * w, 3, 64)) if share == 1 else np.where(rng.random((-(-n // w) * w, 3, 64)) < share, rng.integers(-3, 4, (-(-n // w) * w, 3, 64)), 0)
        images.append(c)
        wide.append(w)
    files = J.Writer().write(images, wide, [b""] * len(images))
    parsed, coef, first = J.read_coefficients(files)
    for i, c in enumerate(images):
        assert (coef[first[i] : first[i + 1]].reshape(3, -1, 64).transpose(1, 0, 2) == c).all()
    one = J.read_coefficients(files[2:3])[1]  # alone, the same
    assert (one == coef[first[2] : first[3]]).all()


def test_transform_and_colour():
    c = np.zeros((1, 64))
    c[0, 0] = 80
    assert (J.samples(c, np.ones(64)) == 138).all()
    rng = np.random.default_rng(2)
    c = rng.integers(-30, 30, (3, 64)).astype(float)
    want = np.zeros((3, 8, 8))
    for b in range(3):
        for k in range(64):
            v, u = divmod(int(J.ZIGZAG[k]), 8)
            cu, cv = (np.sqrt(0.5) if z == 0 else 1 for z in (u, v))
            for y in range(8):
                for x in range(8):
                    want[b, y, x] += c[b, k] * cu * cv / 4 * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    assert np.abs(J.samples(c, np.ones(64)).reshape(3, 8, 8) - np.clip(want + 128, 0, 255)).max() <= 0.51
    assert J.to_rgb(np.array([128, 76]), np.array([128, 85]), np.array([128, 255])).tolist() == [[128, 128, 128], [254, 0, 0]]


def test_chroma_is_upsampled():
    im = J.Image(high=16, wide=16, comps=[(1, 2, 2, np.ones(64)), (2, 1, 1, np.ones(64)), (3, 1, 1, np.ones(64))], base=[0, 4, 5], blocks=6)
    coef = np.zeros((6, 64))
    coef[:4, 0] = [8, 16, 24, 32]
    x = J.tensor(im, coef)
    assert x.shape == (16, 16, 3) and (x[:8, :8] == 129).all() and (x[:8, 8:] == 130).all() and (x[8:, 8:] == 132).all()
    at, owner, unit = im.order((0, 1, 2))
    assert unit == 6 and at.tolist() == [0, 1, 2, 3, 4, 5] and owner.tolist() == [0, 0, 0, 0, 1, 2]


def test_round_trip(spark):
    texts = ["", None, "a", "x" * 192, "é€😀" * 500, "\x80\x7f\x81" * 400, "line\n" * 30000, "same", "same"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    media = pj.encode(df)
    assert media.columns == ["doc_id", "media"]
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    assert files[7] == files[8] and files[0] == files[1] and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files.values())
    plain = {r.doc_id: r for r in pj.decode(media, tensors=False).collect()}
    for r in pj.decode(media).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert bytes(r.payload) == want == bytes(plain[r.doc_id].payload)
        assert len(r.rgb) == r.height * r.width * 3 and r.feature == plain[r.doc_id].feature
    assert pj.decode(spark.createDataFrame([(1, None)], "id long, media binary")).first().payload is None
    assert pj.encode(df.limit(0)).count() == 0
    with pytest.raises(Exception):
        pj.decode(spark.createDataFrame([(1, bytearray(b"no picture"))], "id long, media binary")).collect()


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pj.op10_progressive_jpeg(spark, str(tmp_path)).collect()}
    want = b"abc" + b" " * 189
    assert got[1].payload_sha256 == hashlib.sha256(want).hexdigest() and got[1].tail_crc32 == zlib.crc32(want[-16:])
    assert (got[1].n_bytes, got[2].n_bytes, got[2].payload_bytes) == (3, 0, 192)
