"""Image jobs (IM-1..IM-5, FN-5, FN-6, FN-11).

Decoding is Spark's ``image`` source (SC-5). Pixel work runs in ``mapInPandas`` with numpy, one
Arrow batch of rows at a time: composite, rotate, resize, normalize and transpose are fused into
one Python stage so an image crosses the JVM/Python boundary once. Wide rows (one 3x215x215
tensor is ~555 KB) never enter a shuffle; keep ``spark.sql.execution.arrow.maxRecordsPerBatch``
small for them.

Pixel rules follow the public behaviour of the imaging library the reference relies on:
* blend over white: ``t = fg * a + 255 * (255 - a) + 128; ((t >> 8) + t) >> 8``;
* rotate: nearest neighbour on pixel centres about the image centre, canvas grown to hold the
  turned corners, quarter turns exact, uncovered pixels transparent;
* Lanczos (a = 3) resize, horizontal then vertical pass, 22-bit fixed-point weights, 8-bit
  rounding between passes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

OUTPUT_SIZE = 215
# Rows per Arrow batch handed back by the image jobs; a 3x215x215 tensor is ~555 KB.
OUT_BATCH = 32


# ---------------------------------------------------------------- Catalyst form (small rasters)


def composite_white_expr(rgba, channels: int = 4) -> Column:
    """IM-1 as a higher-order function over a flat RGBA byte array -> flat RGB array."""
    arr = F.col(rgba) if isinstance(rgba, str) else rgba
    n_pix = (F.size(arr) / channels).cast("int")

    def px(i):
        p = (i / 3).cast("int")
        c = i % 3
        fg = F.element_at(arr, p * channels + c + 1)
        a = F.element_at(arr, p * channels + 4) if channels == 4 else F.lit(255)
        t = fg * a + F.lit(255) * (F.lit(255) - a) + F.lit(128)
        return F.shiftright(F.shiftright(t, 8) + t, 8)

    idx = F.when(n_pix > 0, F.sequence(F.lit(0), n_pix * 3 - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, px)


# ---------------------------------------------------------------- numpy kernels


def composite_np(img: np.ndarray) -> np.ndarray:
    """RGBA (or RGB) uint8 HxWxC -> RGB over white."""
    if img.shape[2] == 3:
        return img.astype(np.uint8)
    fg = img[..., :3].astype(np.int64)
    a = img[..., 3:4].astype(np.int64)
    t = fg * a + 255 * (255 - a) + 128
    return (((t >> 8) + t) >> 8).astype(np.uint8)


def to_rgba(img: np.ndarray) -> np.ndarray:
    """Promote RGB to opaque RGBA (the augmenter needs a mask band)."""
    if img.shape[2] == 4:
        return img
    alpha = np.full(img.shape[:2] + (1,), 255, dtype=img.dtype)
    return np.concatenate([img, alpha], axis=2)


def rotate_np(img: np.ndarray, angle: float, expand: bool = True) -> np.ndarray:
    """IM-2: counter-clockwise rotation by ``angle`` degrees, nearest neighbour."""
    angle = angle % 360.0
    h, w = img.shape[:2]
    if angle == 0:
        return img.copy()
    if angle == 180:
        return img[::-1, ::-1].copy()
    if angle in (90, 270) and (expand or w == h):
        return np.rot90(img, 1 if angle == 90 else -1).copy()
    rad = -math.radians(angle)
    m = [round(math.cos(rad), 15), round(math.sin(rad), 15), 0.0,
         round(-math.sin(rad), 15), round(math.cos(rad), 15), 0.0]

    def tr(x, y):
        return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]

    cx, cy = w / 2.0, h / 2.0
    m[2], m[5] = tr(-cx, -cy)
    m[2] += cx
    m[5] += cy
    nw, nh = w, h
    if expand:
        corners = [tr(x, y) for x, y in ((0, 0), (w, 0), (w, h), (0, h))]
        xs = [c[0] for c in corners]
        ys = [c[1] for c in corners]
        nw = math.ceil(max(xs)) - math.floor(min(xs))
        nh = math.ceil(max(ys)) - math.floor(min(ys))
        m[2], m[5] = tr(-(nw - w) / 2.0, -(nh - h) / 2.0)
    yy, xx = np.mgrid[0:nh, 0:nw]
    sx = m[0] * (xx + 0.5) + m[1] * (yy + 0.5) + m[2]
    sy = m[3] * (xx + 0.5) + m[4] * (yy + 0.5) + m[5]
    ix = np.where(sx < 0, -1, sx.astype(np.int64))
    iy = np.where(sy < 0, -1, sy.astype(np.int64))
    ok = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
    out = np.zeros((nh, nw, img.shape[2]), dtype=img.dtype)
    out[ok] = img[iy[ok], ix[ok]]
    return out


def _lanczos(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    out = np.where(x == 0, 1.0, 0.0)
    nz = (x > 0) & (x < 3.0)
    xn = x[nz]
    out[nz] = 3.0 * np.sin(np.pi * xn) * np.sin(np.pi * xn / 3.0) / (np.pi * np.pi * xn * xn)
    return out


_PRECISION_BITS = 32 - 8 - 2


@lru_cache(maxsize=64)
def resample_weights(in_size: int, out_size: int) -> np.ndarray:
    """Fixed-point Lanczos weights ``(out_size, in_size)`` for one axis."""
    scale = in_size / out_size
    fscale = max(scale, 1.0)
    support = 3.0 * fscale
    k = np.zeros((out_size, in_size), dtype=np.int64)
    for i in range(out_size):
        center = (i + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), in_size)
        ws = _lanczos((np.arange(lo, hi) - center + 0.5) / fscale)
        total = ws.sum()
        if total != 0:
            ws = ws / total
        fixed = np.where(ws < 0, np.trunc(ws * (1 << _PRECISION_BITS) - 0.5),
                         np.trunc(ws * (1 << _PRECISION_BITS) + 0.5))
        k[i, lo:hi] = fixed.astype(np.int64)
    return k


def _pass(img: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    x = img.astype(np.int64)
    if axis == 1:
        acc = np.einsum("hwc,ow->hoc", x, k)
    else:
        acc = np.einsum("hwc,oh->owc", x, k)
    acc = (acc + (1 << (_PRECISION_BITS - 1))) >> _PRECISION_BITS
    return np.clip(acc, 0, 255).astype(np.uint8)


def resize_np(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """IM-3: Lanczos resize to ``(width, height)``; unchanged when the size already matches."""
    h, w = img.shape[:2]
    out = img
    if w != width:
        out = _pass(out, resample_weights(w, width), axis=1)
    if h != height:
        out = _pass(out, resample_weights(h, height), axis=0)
    return out


def to_tensor(rgb: np.ndarray) -> np.ndarray:
    """FN-5 + FN-11: bytes -> [-1, 1] float32, HWC -> CHW."""
    x = (rgb.astype(np.float64) / 255.0 - 0.5) / 0.5
    return np.ascontiguousarray(np.transpose(x, (2, 0, 1))).astype(np.float32)


def image_tensor_np(img: np.ndarray, size: int = OUTPUT_SIZE) -> np.ndarray:
    """IM-4: composite -> resize (if needed) -> normalize -> CHW."""
    rgb = composite_np(to_rgba(img))
    if rgb.shape[0] != size or rgb.shape[1] != size:
        rgb = resize_np(rgb, size, size)
    return to_tensor(rgb)


def encode_png(img: np.ndarray) -> bytes:
    """Minimal 8-bit RGB/RGBA PNG writer (filter 0 on every row)."""
    h, w, c = img.shape
    color = {3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + img[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# ---------------------------------------------------------------- Spark jobs


def from_spark_image(height: int, width: int, n_channels: int, data: bytes) -> np.ndarray:
    """Spark's ``image`` struct stores BGR(A); return RGB(A) HxWxC uint8."""
    arr = np.frombuffer(data, dtype=np.uint8).reshape(height, width, n_channels)
    if n_channels >= 3:
        arr = arr[..., [2, 1, 0] + list(range(3, n_channels))]
    return arr


def raster_rows(pdf: pd.DataFrame, arr_col: str = "rgba", channels: int = 4):
    for row in pdf.itertuples(index=False):
        d = getattr(row, "_asdict")()
        img = np.asarray(d[arr_col], dtype=np.uint8).reshape(d["height"], d["width"], channels)
        yield d, img


def image_tensors(images: DataFrame, id_col: str = "origin", size: int = OUTPUT_SIZE) -> DataFrame:
    """IM-4 over an ``image``-source DataFrame: ``(id, c, h, w, data array<float>, checksum)``.

    ``mapInArrow``: each output batch's tensor column is one flat float32 buffer plus offsets,
    so no per-element conversion happens between numpy and Arrow. ``checksum`` is the float64
    sum of the tensor, computed in the same pass.
    """
    import pyarrow as pa

    flat = images.select(F.col(f"image.{id_col}").alias("id"), F.col("image.height").alias("height"),
                         F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"),
                         F.col("image.data").alias("data"))
    schema = pa.schema([("id", pa.string()), ("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()),
                        ("data", pa.list_(pa.float32())), ("checksum", pa.float64())])

    def emit(ids, shapes, tensors, sums):
        values = np.concatenate([t.ravel() for t in tensors]) if tensors else np.zeros(0, np.float32)
        offsets = np.zeros(len(tensors) + 1, dtype=np.int32)
        np.cumsum([t.size for t in tensors], out=offsets[1:])
        data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.float32()))
        cols = [pa.array(ids, pa.string())] + [pa.array([s[i] for s in shapes], pa.int32()) for i in range(3)]
        return pa.RecordBatch.from_arrays(cols + [data, pa.array(sums, pa.float64())], schema=schema)

    def job(batches):
        for rb in batches:
            d = rb.to_pydict()
            ids, shapes, tensors, sums = [], [], [], []
            for i in range(rb.num_rows):
                img = from_spark_image(int(d["height"][i]), int(d["width"][i]), int(d["n_channels"][i]), d["data"][i])
                if img.shape[2] == 1:
                    img = np.repeat(img, 3, axis=2)
                t = image_tensor_np(img, size)
                ids.append(d["id"][i])
                shapes.append(t.shape)
                tensors.append(t)
                sums.append(float(t.sum(dtype=np.float64)))
                if len(ids) == OUT_BATCH:
                    yield emit(ids, shapes, tensors, sums)
                    ids, shapes, tensors, sums = [], [], [], []
            if ids:
                yield emit(ids, shapes, tensors, sums)

    return flat.mapInArrow(job, "id string, c int, h int, w int, data array<float>, checksum double")


def shape_violations(tensors: DataFrame, c: int = 3, size: int = OUTPUT_SIZE) -> DataFrame:
    """FN-11 check: rows whose tensor is not ``c x size x size``."""
    return tensors.where((F.col("c") != c) | (F.col("h") != size) | (F.col("w") != size)
                         | (F.size("data") != c * size * size))


def rotate_rasters(rasters: DataFrame, angles, id_col: str = "vec_id") -> DataFrame:
    """IM-2 + IM-1 over rasters ``(id, height, width, rgba)``: one row per (id, angle)."""
    angles = [float(a) for a in angles]

    def job(it):
        for pdf in it:
            out = []
            for d, img in raster_rows(pdf):
                for a in angles:
                    rgb = composite_np(rotate_np(img, a, expand=True))
                    out.append((d[id_col], a, rgb.shape[0], rgb.shape[1], rgb.ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=[id_col, "angle", "h", "w", "rgb"])

    return rasters.mapInPandas(job, f"{id_col} long, angle double, h int, w int, rgb array<int>")


def resize_rasters(rasters: DataFrame, width: int, height: int, id_col: str = "vec_id") -> DataFrame:
    """IM-3 over composited rasters: ``(id, h, w, rgb)``."""
    def job(it):
        for pdf in it:
            out = []
            for d, img in raster_rows(pdf):
                rgb = resize_np(composite_np(img), width, height)
                out.append((d[id_col], rgb.shape[0], rgb.shape[1], rgb.ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=[id_col, "h", "w", "rgb"])

    return rasters.mapInPandas(job, f"{id_col} long, h int, w int, rgb array<int>")


def augmented_images(rasters: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """IM-5 / SC-8: the k rotated copies (360 i / (k + 1) degrees) of each raster."""
    if k > 0:
        fanned = rasters.select("*", F.explode(F.array(*[F.lit(i) for i in range(1, k + 1)])).alias("aug_no"))
    else:
        fanned = rasters.where(F.lit(False)).withColumn("aug_no", F.lit(0))

    def job(it):
        for pdf in it:
            out = []
            for d, img in raster_rows(pdf):
                angle = 360.0 * d["aug_no"] / (k + 1)
                rgb = composite_np(rotate_np(to_rgba(img), angle, expand=True))
                out.append((d[id_col], int(d["aug_no"]), rgb.shape[0], rgb.shape[1], rgb.ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=[id_col, "aug_no", "h", "w", "rgb"])

    return fanned.mapInPandas(job, f"{id_col} long, aug_no int, h int, w int, rgb array<int>")


def export_pngs(rasters: DataFrame, out_dir: str, id_col: str = "vec_id", name_fmt: str = "{:03d}.png") -> None:
    """Write one PNG per raster into ``out_dir`` (shared storage), from the executors.

    Files go through ``pyarrow.fs``, so the folder's URI must be of a scheme that it knows (``file``,
    ``hdfs``, ``s3``, ``gs``); nothing passes through the driver.
    """
    def write(rows):
        from pyarrow import fs as pafs
        filesystem, base = pafs.FileSystem.from_uri(out_dir if "://" in out_dir else "file://" + out_dir.split(":", 1)[-1])
        filesystem.create_dir(base, recursive=True)
        for r in rows:
            img = np.asarray(r["rgba"], dtype=np.uint8).reshape(r["height"], r["width"], 4)
            with filesystem.open_output_stream(f"{base}/{name_fmt.format(r[id_col])}") as f:
                f.write(encode_png(img))

    (rasters.select(id_col, "height", "width", "rgba")).foreachPartition(write)


def checksum(col="rgb") -> Column:
    """Sum of (place * value) of an array column, places from 1: moved values change it."""
    placed = F.transform(F.col(col) if isinstance(col, str) else col, lambda v, i: v.cast("bigint") * (i + 1))
    return F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def quarter_turn_expr(rgb, height, width, channels: int = 3) -> Column:
    """IM-2 for 90 degrees, counter-clockwise, as a column: row-major pixels, ``width`` x ``height`` afterwards."""
    rgb, h, w = (F.col(x) if isinstance(x, str) else x for x in (rgb, height, width))
    c = F.lit(channels)

    def source(i):
        pixel, channel = F.floor(i / c), i % c
        row, column = F.floor(pixel / h), pixel % h
        # The pixel at (row, column) stood in the column ``width - 1 - row`` of that row number.
        return F.get(rgb, ((column * w + (w - 1 - row)) * c + channel).cast("int"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), (h * w * c - 1).cast("bigint")), source)


def turned_bytes(content, angle, height, width, channels: int = 3) -> Column:
    """IM-2 for quarter turns of raw pixel bytes: row-major, channels last; null for other angles.

    The turned picture is a map of places: each pixel of the result is read from its place in ``content``.
    """
    content, angle, h, w = (F.col(x) if isinstance(x, str) else x for x in (content, angle, height, width))
    turns = F.pmod(F.round(angle / 90.0), F.lit(4)).cast("int")
    wide = F.when(turns % 2 == 1, h).otherwise(w)  # of the result

    def source(text, i):
        row, column = F.floor(i / wide), i % wide
        from_row = F.when(turns == 1, column).when(turns == 2, h - 1 - row).when(turns == 3, h - 1 - column).otherwise(row)
        from_column = F.when(turns == 1, w - 1 - row).when(turns == 2, w - 1 - column).when(turns == 3, row).otherwise(column)
        return F.substr(text, ((from_row * w + from_column) * (2 * channels) + 1).cast("int"), F.lit(2 * channels))

    places = F.sequence(F.lit(0).cast("bigint"), (h * w - 1).cast("bigint"))
    pixels = let(F.hex(content), lambda text: F.transform(places, lambda i: source(text, i)))
    return F.when(angle % 90.0 == 0.0, F.unhex(F.array_join(pixels, "")))


def byte_values(content) -> Column:
    """The bytes of a binary column as an array of numbers 0 to 255."""
    content = F.col(content) if isinstance(content, str) else content
    n = F.octet_length(content)
    each = let(F.hex(content), lambda text: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def channel_planar_expr(pixels, height, width, channels: int = 3) -> Column:
    """FN-11: row-major pixels, channels last (HWC), to one plane after the other (CHW); any element type, no Python.

    A map of places: value ``(c, y, x)`` of the result is read from ``(y, x, c)``.
    """
    pixels, h, w = (F.col(x) if isinstance(x, str) else x for x in (pixels, height, width))
    area = (h * w).cast("int")
    places = F.sequence(F.lit(0), area * channels - 1)
    planes = let(pixels, lambda p: F.transform(places, lambda i: F.get(p, ((i % area) * channels + F.floor(i / area)).cast("int"))))
    return F.when(area > 0, planes).otherwise(F.slice(pixels, 1, 0))


def has_shape(values, c, h, w, want: tuple[int, int, int] = (3, OUTPUT_SIZE, OUTPUT_SIZE)) -> Column:
    """FN-11 check: the picture is ``want`` (channels, height, width), and as many values are there."""
    values, c, h, w = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (values, c, h, w))
    return (c == want[0]) & (h == want[1]) & (w == want[2]) & (F.size(values) == want[0] * want[1] * want[2])


def require_shape(values, c, h, w, want: tuple[int, int, int] = (3, OUTPUT_SIZE, OUTPUT_SIZE)) -> Column:
    """FN-11: ``values``, or a failure of the job where their shape is another one."""
    text = F.concat_ws("x", *[(F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("string") for x in (c, h, w)])
    refuse = F.raise_error(F.concat(F.lit("Image tensor shape mismatch: "), text))
    return let(F.col(values) if isinstance(values, str) else values, lambda v: F.when(has_shape(v, c, h, w, want), v).otherwise(refuse))
