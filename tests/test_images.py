import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images as IM
from tessera.session import scratch_path
from tessera.sources import assets as SA


def test_composite_rules():
    px = np.array([[[10, 20, 30, 0], [10, 20, 30, 255], [10, 20, 30, 128]]], dtype=np.uint8)
    out = IM.composite_np(px)
    assert out[0, 0].tolist() == [255, 255, 255]
    assert out[0, 1].tolist() == [10, 20, 30]
    for c, fg in enumerate([10, 20, 30]):
        assert abs(int(out[0, 2, c]) - (fg * 128 + 255 * 127) / 255) <= 1


def test_composite_catalyst_equals_numpy(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, size=(4, 4, 4), dtype=np.uint8)
    df = spark.createDataFrame([(img.ravel().tolist(),)], "rgba array<int>")
    got = df.select(IM.composite_white_expr("rgba")).first()[0]
    assert got == IM.composite_np(img).ravel().tolist()


def test_quarter_turns_and_rotation_canvas():
    img = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    r90 = IM.rotate_np(img, 90)
    assert r90.shape == (3, 2, 4)
    assert np.array_equal(IM.rotate_np(r90, 270), img)
    assert np.array_equal(IM.rotate_np(img, 180), img[::-1, ::-1])
    r120 = IM.rotate_np(np.full((4, 4, 4), 200, np.uint8), 120)
    assert r120.shape[0] >= 4 and r120.shape[1] >= 4
    assert (r120[..., 3] == 0).any()  # uncovered corners are transparent


def test_resize_identity_and_constant():
    img = np.random.default_rng(1).integers(0, 256, size=(5, 5, 3), dtype=np.uint8)
    assert np.array_equal(IM.resize_np(img, 5, 5), img)
    const = np.full((4, 7, 3), 77, np.uint8)
    out = IM.resize_np(const, 11, 9)
    assert out.shape == (9, 11, 3) and (out == 77).all()


def test_tensor_shape_and_range():
    t = IM.image_tensor_np(np.zeros((4, 4, 4), np.uint8))
    assert t.shape == (3, 215, 215) and t.dtype == np.float32
    assert t.max() == pytest.approx(1.0)  # transparent -> white -> 1.0


def _write(path, data):
    with open(path, "wb") as f:
        f.write(data)


def test_png_roundtrip_through_spark_sources(spark, tmp_path):
    rgba = np.zeros((2, 3, 4), np.uint8)
    rgba[...] = [10, 20, 30, 128]
    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[...] = [1, 2, 3]
    folder = scratch_path(spark, "png-test")
    local = folder.replace("file:", "")
    import os
    os.makedirs(local, exist_ok=True)
    _write(f"{local}/rgba.png", IM.encode_png(rgba))
    _write(f"{local}/rgb.png", IM.encode_png(rgb))
    _write(f"{local}/corrupt.png", b"\x89PNG\r\n\x1a\nnot really" + zlib.compress(b"x"))
    rows = {r.image.origin.rsplit("/", 1)[-1]: r.image for r in SA.scan_images(spark, folder, invalid="keep").collect()}
    assert set(rows) == {"rgba.png", "rgb.png", "corrupt.png"} and rows["corrupt.png"].height is None
    assert [r.name for r in SA.undecodable_images(spark, folder).collect()] == ["corrupt.png"]
    with pytest.raises(Exception, match="Undecodable image"):
        SA.scan_images(spark, folder).collect()
    a, b = rows["rgba.png"], rows["rgb.png"]
    assert (a.nChannels, a.mode, b.nChannels, b.mode) == (4, 24, 3, 16)
    assert np.array_equal(IM.from_spark_image(a.height, a.width, a.nChannels, a.data), rgba)
    assert np.array_equal(IM.from_spark_image(b.height, b.width, b.nChannels, b.data), rgb)
    man = SA.scan_assets(spark, folder).collect()
    assert {r.name for r in man} == {"rgba.png", "rgb.png", "corrupt.png"}
    t = IM.image_tensors(SA.scan_images(spark, folder, invalid="keep").where("image.height is not null"))
    assert IM.shape_violations(t).count() == 0


def test_quarter_turn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (3, 5, 3))
    df = spark.createDataFrame([(img.ravel().tolist(), 3, 5)], "rgb array<int>, h int, w int")
    got = df.select(IM.quarter_turn_expr("rgb", "h", "w").alias("t"), IM.checksum("rgb").alias("c")).first()
    assert np.array_equal(np.array(got.t).reshape(5, 3, 3), np.rot90(img))
    assert got.c == sum((i + 1) * int(v) for i, v in enumerate(img.ravel()))
