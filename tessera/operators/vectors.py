"""Vector functions and pooling (FN-3..FN-10, AG-1, AG-8..AG-11).

Per-row vector math uses Spark's higher-order functions (``transform``, ``zip_with``,
``aggregate``), which stay on the JVM inside whole-stage codegen. Pooling across rows goes
through ``posexplode`` + grouped aggregation by ``(sequence, dim)``: the explode happens inside
the scan stage and partial aggregation collapses it before the shuffle, so a long sequence (a
hot group) costs one small partial row per task and dimension, never one task for the group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

NAN = float("nan")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def l2_normalize(a) -> Column:
    """FN-3: ``v / |v|``; a zero vector gives NaNs (the reference divides without a guard)."""
    a = _c(a)
    n = l2_norm(a)
    return F.when(n == 0.0, F.transform(a, lambda x: F.lit(NAN))).otherwise(F.transform(a, lambda x: x / n))


def cosine(a, b) -> Column:
    """FN-4: dot product of the two normalized vectors; NaN when either norm is zero."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na == 0.0) | (nb == 0.0), F.lit(NAN)).otherwise(dot(a, b) / (na * nb))


def mean_abs_diff(a, b) -> Column:
    """AG-1: L1 loss of one pair, the mean of ``|a_i - b_i|`` over all elements."""
    s = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(s, F.size(_c(a)).cast("double"))


def apply_mask(v, mask) -> Column:
    """FN-7: zero a vector whose validity flag is 0."""
    return F.transform(_c(v), lambda x: x * _c(mask).cast("double"))


def invert_mask(mask) -> Column:
    """FN-7: the padding flag, true where the validity flag is 0."""
    return _c(mask) == 0


def denormalize(v, clamp: bool = True) -> Column:
    """FN-6: ``(x + 1) / 2``, clamped to [0, 1] unless ``clamp=False``. NaN stays NaN."""
    def f(x):
        y = (x + 1.0) / 2.0
        if not clamp:
            return y
        return F.when(F.isnan(y), y).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))
    return F.transform(_c(v), f)


def normalize_pixels(v) -> Column:
    """FN-5: bytes to [-1, 1]: ``(x / 255 - 0.5) / 0.5``."""
    return F.transform(_c(v), lambda x: (x.cast("double") / 255.0 - 0.5) / 0.5)


def matrix(weights: np.ndarray) -> Column:
    """A fixed matrix as one literal array of its columns (parsed once, not built value by value)."""
    w = np.asarray(weights, dtype=float)
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in w[:, j]) + ")" for j in range(w.shape[1])) + ")")


def _literal(values: np.ndarray) -> Column:
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in np.asarray(values, dtype=float)) + ")")


def project(v, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """FN-8: ``y_j = sum_i v_i * W[i, j] + b_j`` for a fixed ``W`` (d_in x d_out) and ``b`` (none: zeros).

    Matrix and bias are literals of the plan (bounded by the parameter, not by the data). Above
    some tens of thousands of values use :func:`project_arrow`.
    """
    v = _c(v)
    out = F.transform(matrix(weights), lambda column: dot(v, column))
    return out if bias is None else F.zip_with(out, _literal(bias), lambda y, b: y + b)


def project_arrow(df: DataFrame, vec_col: str, weights: np.ndarray, out_col: str = "proj", bias: np.ndarray | None = None) -> DataFrame:
    """FN-8, large-matrix form: numpy matmul per Arrow batch inside a pandas UDF."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("array<double>")
    def _proj(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        m = np.stack(s.to_numpy())
        return pd.Series(list(m @ shared.value[0] + shared.value[1]))

    return df.withColumn(out_col, _proj(F.col(vec_col)))


def hash_uniforms(key: Column):
    """Two uniforms from disjoint 32-bit slices of ``md5(key)``: u1 in (0, 1], u2 in [0, 1)."""
    h = F.md5(key)
    a = F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("double")
    b = F.conv(F.substr(h, F.lit(9), F.lit(8)), 16, 10).cast("double")
    return (a + 1.0) / (2.0 ** 32 + 1.0), b / (2.0 ** 32)


def gaussian(seed: int, *parts) -> Column:
    """Standard normal draw from ``md5("<seed>:<p1>:<p2>...")`` (Box-Muller).

    Depends only on the key, never on partitioning or task order, so a recomputed task draws
    the same noise.
    """
    items = [F.lit(str(seed))]
    for p in parts:
        items += [F.lit(":"), _c(p).cast("string")]
    u1, u2 = hash_uniforms(F.concat(*items))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def jitter(v, row_id, seed: int = 42, sigma: float = 0.05, enabled=True) -> Column:
    """FN-9: add N(0, sigma) noise per element when ``enabled`` (training and switched on)."""
    noisy = F.transform(_c(v), lambda x, i: x + F.lit(sigma) * gaussian(seed, row_id, i))
    if enabled is True:
        return noisy
    if enabled is False:
        return _c(v)
    return F.when(_c(enabled), noisy).otherwise(_c(v))


def concat_noise(v, row_id, n: int, seed: int = 42, sigma: float = 1.0) -> Column:
    """FN-10: append ``n`` N(0, sigma) values (dims ``len(v) .. len(v)+n-1``) to a vector."""
    base = F.size(_c(v))
    noise = F.transform(F.array_repeat(F.lit(0.0), n),
                        lambda _, i: F.lit(sigma) * gaussian(seed, row_id, base + i))
    return F.concat(_c(v), noise)


def explode_dims(df: DataFrame, vec_col: str, keep: Sequence[str], dim_col: str = "dim",
                 val_col: str = "x") -> DataFrame:
    return df.select(*keep, F.posexplode(vec_col).alias(dim_col, val_col))


def token_counts(vecs: DataFrame, seq_col: str = "seq_id", mask_col: str = "mask") -> DataFrame:
    """AG-8: valid positions per sequence."""
    return vecs.groupBy(seq_col).agg(F.sum(F.col(mask_col).cast("bigint")).alias("n_valid"))


def masked_mean_pool(vecs: DataFrame, seq_col: str = "seq_id", mask_col: str = "mask",
                     vec_col: str = "vec", eps: float = 1e-9) -> DataFrame:
    """AG-9: ``sum(mask * v) / (sum(mask) + eps)`` per sequence and dim, long form
    ``(seq, dim, x)``. An all-masked sequence pools to zeros, not nulls."""
    long = vecs.select(seq_col, F.col(mask_col).cast("double").alias("_m"),
                       F.posexplode(vec_col).alias("dim", "_x"))
    return long.groupBy(seq_col, "dim").agg(
        (F.sum(F.col("_m") * F.col("_x")) / (F.sum("_m") + F.lit(eps))).alias("x"))


def collect_vector(long: DataFrame, key_cols: Sequence[str], dim_col: str = "dim", val_col: str = "x",
                   out_col: str = "vec") -> DataFrame:
    """Long ``(key, dim, x)`` back to one array per key; the group size is the vector width."""
    return long.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(dim_col).alias("d"), F.col(val_col).alias("v")))),
                    lambda s: s["v"]).alias(out_col))


#: Width of a block of scores. Within a block ``exp(score - start of the block)`` is at most ``e**256``, far from overflow.
SCORE_BLOCK = 256.0


def _head_queries(q: Column, heads: int, query_proj, key_proj, query_bias, key_bias) -> Column:
    """One query per head in the space of the unprojected keys: ``q W_q + b_q`` cut by heads, times ``W_k^T``.

    Its last coordinate is the query's product with the key bias: keys are read with a coordinate 1 behind them.
    """
    if query_proj is not None:
        q = project(q, query_proj, query_bias)
    elif query_bias is not None:
        q = F.zip_with(q, _literal(query_bias), lambda x, b: x + b)
    size = F.size(q) / heads
    parts = [F.slice(q, (size * h + 1).cast("int"), size.cast("int")) for h in range(heads)]
    if key_proj is None:
        if heads > 1:
            raise ValueError("several heads need a key projection")
        return F.array(F.concat(parts[0], F.array(F.lit(0.0) if key_bias is None else dot(parts[0], _literal(key_bias)))))
    w = np.asarray(key_proj, dtype=float)
    b = np.zeros(w.shape[1]) if key_bias is None else np.asarray(key_bias, dtype=float)
    # One row more: the bias.
    w = np.vstack([w, b])
    width = w.shape[1] // heads
    return F.array(*[project(p, w[:, h * width:(h + 1) * width].T) for h, p in enumerate(parts)])


def attention_pool(vecs: DataFrame, seq_col: str = "seq_id", mask_col: str = "mask", vec_col: str = "vec",
                   id_col: str = "vec_id", query_proj: np.ndarray | None = None, key_proj: np.ndarray | None = None,
                   value_proj: np.ndarray | None = None, out_proj: np.ndarray | None = None, heads: int = 1,
                   eps: float = 1e-9, query_bias: np.ndarray | None = None, key_bias: np.ndarray | None = None,
                   value_bias: np.ndarray | None = None, out_bias: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """AG-10/AG-11: one-query scaled dot-product attention over the valid positions of a sequence.

    query = projected masked mean; per head, score_p = q . k_p / sqrt(head width) for valid p; weights =
    softmax over valid positions (masked positions get weight 0), averaged over the heads; output =
    projection of the heads' sum_p w_p v_p. Returns ``(pooled long (seq, dim, x), weights (seq, id, w))``.

    Projections are affine, so keys and values are never projected row by row: the query takes the key
    matrix (and, as one more coordinate, the key bias), and the pooled vector the value matrix and bias. Pooling reads the rows twice and joins once:
    the first pass gives each sequence its query, the second sums ``e`` and ``e * v``. The softmax has a state that merges, per
    block of scores ``SCORE_BLOCK`` wide: the block, the sum of ``exp(score - start of the block)`` and the weighted sum of the
    vectors. States of a block add up in any order (partial sums on the map side), and those of a sequence are brought to its highest
    block at the end, so scores may be of any size and no pass looks for a maximum.
    """
    valid = F.col(mask_col) != 0
    mean = masked_mean_pool(vecs, seq_col, mask_col, vec_col, eps)
    per = collect_vector(mean, [seq_col], out_col="_q")
    width = np.asarray(query_proj).shape[1] // heads if query_proj is not None else None
    scale = F.sqrt(F.lit(float(width)) if width else F.size("_q").cast("double"))
    per = per.select(F.col(seq_col).alias("_seq"), scale.alias("_scale"),
                     _head_queries(F.col("_q"), heads, query_proj, key_proj, query_bias, key_bias).alias("_heads"))

    joined = vecs.join(per, F.col(seq_col).eqNullSafe(F.col("_seq")))
    v = F.concat(F.col(vec_col), F.array(F.lit(1.0)))
    scored = joined.withColumn("_s", F.transform("_heads", lambda q: F.when(valid, dot(v, q) / F.col("_scale"))))
    block = F.transform("_s", lambda s: F.floor(s / SCORE_BLOCK))
    state = F.transform(F.arrays_zip("_s", "_b"), lambda x: F.struct(
        x["_b"].alias("b"), F.exp(x["_s"] - x["_b"] * SCORE_BLOCK).alias("e")))
    scored = scored.withColumn("_b", block).withColumn("_e", state)
    long = scored.select(seq_col, vec_col, F.posexplode("_e").alias("_h", "_e")).select(seq_col, "_h", F.col("_e.b").alias("_b"), F.col("_e.e").alias("_w"), vec_col)
    long = long.select(seq_col, "_h", "_b", "_w", F.posexplode(vec_col).alias("dim", "_x"))
    states = long.groupBy(seq_col, "_h", "dim", "_b").agg(F.sum("_w").alias("_z"), F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    # Masked positions have no block; a sequence without valid ones has nothing to attend to: NaN, as the reference yields.
    merged = states.groupBy(seq_col, "_h", "dim").agg(F.max("_b").alias("_top"), F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_z", "_s"))).alias("_all"))
    down = lambda x: F.exp((x["_b"] - F.col("_top")) * SCORE_BLOCK)
    merged = merged.select(seq_col, "_h", "dim", "_top", F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["_z"] * down(x)).alias("_z"),
                           F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["_s"] * down(x)).alias("_s"))
    pooled = merged.select(seq_col, "_h", "dim", F.when(F.col("_top").isNotNull(), F.col("_s") / F.col("_z")).otherwise(F.lit(NAN)).alias("x"))
    if any(x is not None for x in (value_proj, out_proj, value_bias, out_bias)) or heads > 1:
        pooled = _project_heads(pooled, seq_col, heads, value_proj, out_proj, value_bias, out_bias)
    else:
        pooled = pooled.drop("_h")

    z = scored.select(seq_col, F.posexplode("_e").alias("_h", "_e")).groupBy(seq_col, "_h", F.col("_e.b").alias("_b")).agg(F.sum("_e.e").alias("_z"))
    z = z.groupBy(seq_col, "_h").agg(F.max("_b").alias("_top"), F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_z"))).alias("_all"))
    z = z.select(seq_col, "_h", "_top", F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["_z"] * down(x)).alias("_z"))
    z = z.groupBy(seq_col).agg(F.sort_array(F.collect_list(F.struct("_h", "_top", "_z"))).alias("_z")).select(F.col(seq_col).alias("_zseq"), "_z")  # a row per head
    shares = F.zip_with("_e", "_z", lambda e, z: F.when(z["_top"].isNull(), F.lit(NAN)).otherwise(
        F.coalesce(e["e"] * F.exp((e["b"] - z["_top"]) * SCORE_BLOCK) / z["_z"], F.lit(0.0))))
    weight = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b) / heads
    weights = scored.join(z, F.col(seq_col).eqNullSafe(F.col("_zseq"))).select(seq_col, id_col, weight.alias("w"))
    return pooled, weights


def _project_heads(pooled: DataFrame, seq_col: str, heads: int, value_proj, out_proj, value_bias, out_bias) -> DataFrame:
    """Per sequence: each head's vector by its columns of ``W_v`` and its part of ``b_v``, side by side, then ``W_o`` and ``b_o``; long form."""
    per = collect_vector(pooled, [seq_col, "_h"], out_col="_v").groupBy(seq_col).agg(F.sort_array(F.collect_list(F.struct("_h", "_v"))).alias("_all"))
    if value_proj is None:
        if heads > 1:
            raise ValueError("several heads need a value projection")
        out = F.col("_all")[0]["_v"]
        if value_bias is not None:
            out = F.zip_with(out, _literal(value_bias), lambda x, b: x + b)
    else:
        w = np.asarray(value_proj, dtype=float)
        b = np.zeros(w.shape[1]) if value_bias is None else np.asarray(value_bias, dtype=float)
        width = w.shape[1] // heads
        cut = [slice(h * width, (h + 1) * width) for h in range(heads)]
        out = F.concat(*[project(F.col("_all")[h]["_v"], w[:, cut[h]], b[cut[h]]) for h in range(heads)])
    per = per.select(seq_col, out.alias("_o"))
    if out_proj is not None:
        per = per.select(seq_col, project("_o", out_proj, out_bias).alias("_o"))
    elif out_bias is not None:
        per = per.select(seq_col, F.zip_with("_o", _literal(out_bias), lambda x, b: x + b).alias("_o"))
    return per.select(seq_col, F.posexplode("_o").alias("dim", "x"))


def attention_pool_rows(tokens, mask, eps: float = 1e-9) -> Column:
    """AG-10 inside a row: ``tokens`` is an array of L vectors, ``mask`` an array of L flags; no shuffle.

    Identity projections; project the result with :func:`project`. Without a valid position: NaNs.
    """
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def weighted(tokens: Column, weights: Column) -> Column:
        scaled = F.zip_with(tokens, weights, lambda t, w: F.transform(t, lambda x: x * w))
        return let(scaled, lambda s: F.aggregate(F.slice(s, F.lit(2), F.size(s)), F.get(s, F.lit(0)), lambda a, t: F.zip_with(a, t, lambda x, y: x + y)))

    def pooled(tokens: Column, mask: Column) -> Column:
        query = F.transform(weighted(tokens, mask), lambda x: x / (total(mask) + F.lit(eps)))
        scores = let(query, lambda q: F.zip_with(tokens, mask, lambda t, m: F.when(m != 0, dot(t, q) / F.sqrt(F.size(t).cast("double")))))
        e = let(scores, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))))
        return let(e, lambda e: let(total(e), lambda z: F.transform(weighted(tokens, e), lambda x: F.when(z > 0, x / z).otherwise(F.lit(NAN)))))

    return let(_c(tokens), lambda t: let(F.transform(_c(mask), lambda m: m.cast("double")), lambda m: pooled(t, m)))
