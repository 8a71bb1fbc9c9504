import hashlib
import zlib

import numpy as np
import pytest

from tallgrass.llm import jpeg, media, queries


def payloads():
    rng = np.random.default_rng(0)
    out = [rng.integers(0, 256, 192 * k).astype(np.uint8) for k in (1, 2, 3, 7, 50)]
    # coefficients around zero: new ones in the refinement, long runs of zeros, empty blocks
    out += [np.full(192, 123), rng.integers(121, 127, 192 * 9), rng.choice([123, 200, 124], 192 * 5, p=[0.93, 0.05, 0.02]), np.full(192 * 400, 32)]
    return [x.astype(np.uint8).tobytes() for x in out]


@pytest.mark.parametrize("restart", [1, 3, 60_000])
def test_round_trip_is_lossless(monkeypatch, restart):
    monkeypatch.setattr(jpeg, "RESTART", restart)
    files = jpeg.encode(payloads())
    coefs, parsed = jpeg.coefficients(files)
    assert [jpeg.payload_of(coefs, x) for x in parsed] == payloads()


def test_files_do_not_depend_on_the_batch(monkeypatch):
    together = jpeg.encode(payloads())
    assert together == [jpeg.encode([p])[0] for p in payloads()]
    monkeypatch.setattr(jpeg, "CHUNK", 7)
    assert together == jpeg.encode(payloads())
    coefs, parsed = jpeg.coefficients(together)
    assert [jpeg.payload_of(coefs, x) for x in parsed] == payloads()


def test_mixed_files_are_decoded_in_groups(monkeypatch):
    one = jpeg.encode(payloads()[:3])
    monkeypatch.setattr(jpeg, "RESTART", 4)
    files = [*one, *jpeg.encode(payloads()[3:])]
    coefs, parsed = jpeg.coefficients(files)
    assert [jpeg.payload_of(coefs, x) for x in parsed] == payloads()


def test_inverse_transform_equals_the_formula():
    rng = np.random.default_rng(1)
    block = rng.integers(-40, 40, (1, 64)).astype(np.int16)
    c = np.zeros((8, 8))
    for k, i in enumerate(jpeg.ZIGZAG):
        c[i // 8, i % 8] = block[0, k]
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    s = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    want[y, x] += s * c[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    got = jpeg.pixels(block, np.ones(64, np.int64))[0]
    assert np.abs(got - np.clip(np.rint(want) + 128, 0, 255)).max() <= 1
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_grey_image_and_chroma():
    x = jpeg.Layout(1, 1, 0)
    blocks = np.full((6, 8, 8), 128, np.uint8)
    assert (jpeg.rgb_of(blocks, x) == 128).all()
    blocks[5] = 228  # red difference only
    red = jpeg.rgb_of(blocks, x)
    assert red.shape == (16, 16, 3) and red[0, 0, 0] == 255 and red[0, 0, 1] < 64 and red[0, 0, 2] == 128


def test_query_shape(spark, tmp_path):
    texts = [None, "", "a", "é" * 96, "é" * 97, "漢字 " * 3000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op7_media(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert r.tail_crc32 == zlib.crc32(p[-16:]) and len(r.rgb) == 3 * r.height * r.width
    out = media.load(media.store(docs.withColumnRenamed("doc_id", "media")), "media_").collect()
    assert len(out) == 7 and all(len(r.rgb) == 3 * r.height * r.width for r in out)
    assert out[2].feature == out[6].feature


def test_files_open_in_another_decoder(spark):
    """Java's own reader of progressive JPEG gives the same pixels; chroma is flat here, since readers interpolate it differently."""
    rng = np.random.default_rng(6)
    for units, red in ((1, 0), (3, 30), (70, -25)):
        v = np.full((6 * units, 64), 251, np.int64)
        v[: 4 * units] += rng.integers(-3, 4, (4 * units, 64))
        v[: 4 * units, 0] = 251 + rng.integers(-120, 120, 4 * units)
        v[5 * units :, 0] += red
        file = jpeg.encode([(v % 256).astype(np.uint8).tobytes()])[0]
        jvm = spark.sparkContext._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(file))
        coefs, (x,) = jpeg.coefficients([file])
        rgb = jpeg.rgb_of(jpeg.pixels(coefs, x.steps), x.layout).astype(int)
        h, w, _ = rgb.shape
        assert (image.getHeight(), image.getWidth()) == (h, w)
        flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
        theirs = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], 2)
        assert np.abs(theirs - rgb).max() <= 2 and rgb.std() > 1


def test_null_media_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", b"a"), (2, "hello", "y", None)], "doc_id long, text string, rgb string, payload binary")
    out = {r.doc_id: r for r in media.load(media.store(docs).withColumn("media", media_or_null())).collect()}
    assert out[1].payload_ is None and out[1].rgb_ is None and out[1].rgb == "x" and out[2].payload_[:5] == b"hello" and len(out[2].rgb_) == 3 * out[2].height * out[2].width


def media_or_null():
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") == 2, F.col("media"))
