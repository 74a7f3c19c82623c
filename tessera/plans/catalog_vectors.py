"""Queries over the vector, pair and raster bindings (VEC, PAIR, IMG)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import bindings as B
from ..operators import images as IM
from ..operators import metrics as MT
from ..operators import scoring as SC
from ..operators import vectors as V
from . import sql_fragments as Q
from .catalog import query, with_

R6 = 6


def _r(c, name):
    return F.round(c, R6).alias(name)


def _long(df, vec_col, keep, dim="dim", val="x"):
    return df.select(*keep, F.posexplode(vec_col).alias(dim, "_v")).select(*keep, dim, _r(F.col("_v"), val))


PAIR_STATS = """ps AS (
  SELECT id_pred, id_truth, label, avg(abs(p - t)) AS l1,
         sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) AS cos
  FROM pl GROUP BY id_pred, id_truth, label)"""


@query("pair_losses", with_(Q.PAIR_LONG, PAIR_STATS) + """
SELECT id_pred AS id, round(l1, 6) AS l1 FROM ps""")
def pair_losses(spark, sf_dir):
    """JN-5 + AG-1: L1 of each prediction against its ground truth."""
    m = SC.pair_metrics(B.pairs(spark, sf_dir))
    return m.select(F.col("id_pred").alias("id"), _r(F.col("l1"), "l1"))


@query("pair_similarity", with_(Q.PAIR_LONG, PAIR_STATS) + """
SELECT id_pred AS id, round(cos, 6) AS cosine FROM ps""")
def pair_similarity(spark, sf_dir):
    """JN-6 + FN-3/FN-4: cosine of each pair."""
    m = SC.pair_metrics(B.pairs(spark, sf_dir))
    return m.select(F.col("id_pred").alias("id"), _r(F.col("cosine"), "cosine"))


@query("mean_similarity", with_(Q.PAIR_LONG, PAIR_STATS) + """
SELECT round(avg(cos), 6) AS mean_similarity FROM ps""")
def mean_similarity(spark, sf_dir):
    """AG-3."""
    s = SC.similarity_summary(B.pairs(spark, sf_dir))
    return s.select(_r(F.col("mean_similarity"), "mean_similarity"))


@query("similarity_loss", with_(Q.PAIR_LONG, PAIR_STATS) + """
SELECT round(1.0 - avg(cos), 6) AS similarity_loss FROM ps""")
def similarity_loss(spark, sf_dir):
    """AG-4: ``1 - mean cosine``."""
    s = SC.similarity_summary(B.pairs(spark, sf_dir))
    return s.select(_r(F.col("similarity_loss"), "similarity_loss"))


# Fixed binding: the split of a pair, as LOG splits its items.
_PAIR_SPLIT = "CASE WHEN id_pred % 4 = 0 THEN 'val' ELSE 'train' END"


def _comparison_sql(n: int | None) -> str:
    return f"""
SELECT split, id_pred, id_truth, rank, 'plots/ft/epoch_10/' || split || '/image_comparisons' AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY id_pred) AS rank FROM (
    SELECT a.vec_id AS id_pred, b.vec_id AS id_truth, {_PAIR_SPLIT.replace("id_pred", "a.vec_id")} AS split
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)) {"" if n is None else f"WHERE rank <= {n}"}"""


def _comparison(spark, sf_dir, n: int | None):
    pairs = B.pairs(spark, sf_dir).select(F.expr(_PAIR_SPLIT).alias("split"), "id_pred", "id_truth")
    table = MT.comparison_table(pairs, n, keys=["split"], order_col="id_pred", bucket=F.floor(F.col("id_pred") / 1000))
    path = MT.comparison_path(F.lit("plots"), F.lit("ft"), F.lit(10), F.col("split"))
    return table.select("split", "id_pred", "id_truth", "rank", path.alias("path"))


@query("comparison_pairs", _comparison_sql(10))
def comparison_pairs(spark, sf_dir):
    """SC-11 / TK-2: the first 10 (prediction, truth) pairs of each split's comparison table."""
    return _comparison(spark, sf_dir, 10)


@query("comparison_all", _comparison_sql(None))
def comparison_all(spark, sf_dir):
    """SP-7: the same table with all pairs of each split."""
    return _comparison(spark, sf_dir, None)


@query("evaluation_report", with_("""pr AS (
  SELECT a.vec_id AS id_pred, a.dim, 0.5 * a.x AS p, b.x AS t
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a
  JOIN (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) b
    ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim)""", """it AS (
  SELECT id_pred, id_pred // 10 AS batch_id, avg(abs(p - t)) AS l1,
         sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) AS cos
  FROM pr GROUP BY id_pred)""", """bt AS (SELECT batch_id, avg(l1) AS bm, count(*) AS bn FROM it GROUP BY batch_id)""") + """
SELECT round((SELECT sum(bm * bn) / sum(bn) FROM bt), 6) AS test_loss, round((SELECT avg(cos) FROM it), 6) AS similarity_avg""")
def evaluation_report(spark, sf_dir):
    """ML-1 -> JN-5/6 -> AG-1/2/3: score each vector with a fixed linear generator (x -> 0.5 x),
    pair with the next vector as ground truth, report test loss and mean similarity."""
    pairs = B.pairs(spark, sf_dir)
    scored = SC.batch_score(pairs, SC.scaling_model(0.5), "pred", "gen", T.ArrayType(T.DoubleType()),
                            batch_size=10, width=64)
    scored = scored.withColumn("batch_id", F.expr("id_pred div 10"))
    rep = SC.evaluation_report(scored, pred_col="gen", truth_col="truth")
    return rep.select(_r(F.col("test_loss"), "test_loss"), _r(F.col("similarity_avg"), "similarity_avg"))


@query("batch_score", with_(Q.VEC_LONG) + """
SELECT vec_id, round(sum(x / (dim + 1)), 6) AS score FROM vl GROUP BY vec_id""")
def batch_score(spark, sf_dir):
    """ML-1 / ML-5: a fixed linear model (w_i = 1/(i+1)) applied in Arrow batches of 10."""
    w = 1.0 / np.arange(1, 65)
    vecs = B.vectors(spark, sf_dir)
    s = SC.batch_score(vecs, SC.linear_scorer(w), "vec", "score", T.DoubleType(), batch_size=10, width=64)
    return s.select("vec_id", _r(F.col("score"), "score"))


@query("l2_normalized", with_(Q.VEC_LONG) + """
SELECT vec_id, dim, round((3.0 * x) / sqrt(sum((3.0 * x) * (3.0 * x)) OVER (PARTITION BY vec_id)), 6) AS x FROM vl""")
def l2_normalized(spark, sf_dir):
    """FN-3 on VEC scaled by 3."""
    v = B.vectors(spark, sf_dir).withColumn("n", V.l2_normalize(F.transform("vec", lambda x: x * 3.0)))
    return _long(v, "n", ["vec_id"])


_PROJ_W = np.array([[math.cos(i * (j + 1)) for j in range(4)] for i in range(64)])


@query("project_vectors", with_(Q.VEC_LONG) + """
SELECT vec_id, CAST(j AS INTEGER) AS j, round(sum(x * cos(dim * (j + 1))), 6) AS y
FROM vl, range(4) t(j) GROUP BY vec_id, j""")
def project_vectors(spark, sf_dir):
    """FN-8: 64 -> 4 projection with ``W[i, j] = cos(i * (j + 1))``."""
    v = B.vectors(spark, sf_dir).withColumn("p", V.project("vec", _PROJ_W))
    return _long(v, "p", ["vec_id"], dim="j", val="y")


def _noise_sql(sigma: float, dim_expr: str = "dim") -> str:
    h = f"md5('42:' || CAST(vec_id AS VARCHAR) || ':' || CAST({dim_expr} AS VARCHAR))"
    u1 = f"((CAST(('0x' || substr({h}, 1, 8)) AS BIGINT) + 1) / 4294967297.0)"
    u2 = f"(CAST(('0x' || substr({h}, 9, 8)) AS BIGINT) / 4294967296.0)"
    return f"({sigma} * sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


@query("jitter_vectors", with_(Q.VEC_LONG) + f"""
SELECT vec_id, dim, round(x + {_noise_sql(0.05)}, 6) AS x FROM vl""")
def jitter_vectors(spark, sf_dir):
    """FN-9: Gaussian jitter (sigma 0.05, seed 42) on every element, training mode."""
    v = B.vectors(spark, sf_dir).withColumn("j", V.jitter("vec", F.col("vec_id"), seed=42, sigma=0.05))
    return _long(v, "j", ["vec_id"])


@query("concat_noise", with_(Q.VEC_LONG) + f"""
SELECT vec_id, dim, round(x, 6) AS x FROM vl
UNION ALL
SELECT vec_id, CAST(d AS INTEGER) AS dim, round({_noise_sql(1.0, 'd')}, 6) AS x
FROM (SELECT DISTINCT vec_id FROM vl), range(64, 68) t(d)""")
def concat_noise(spark, sf_dir):
    """FN-10: each vector followed by 4 N(0, 1) noise values."""
    v = B.vectors(spark, sf_dir).withColumn("c", V.concat_noise("vec", F.col("vec_id"), 4, seed=42))
    return _long(v, "c", ["vec_id"])


@query("token_counts", """
SELECT label, CAST(sum(CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM embeddings GROUP BY label""")
def token_counts(spark, sf_dir):
    """AG-8: valid positions per sequence."""
    return V.token_counts(B.vectors(spark, sf_dir)).withColumnRenamed("seq_id", "label")


@query("masked_mean_pool", with_(Q.VEC_LONG) + """
SELECT seq_id AS label, dim, round(sum(mask * x) / (sum(mask) + 1e-9), 6) AS x FROM vl GROUP BY seq_id, dim""")
def masked_mean_pool(spark, sf_dir):
    """AG-9 / FN-7: masked mean over each sequence's vectors."""
    p = V.masked_mean_pool(B.vectors(spark, sf_dir))
    return p.select(F.col("seq_id").alias("label"), "dim", _r(F.col("x"), "x"))


ATTN = [Q.VEC_LONG,
        """q AS (SELECT seq_id, dim, sum(mask * x) / (sum(mask) + 1e-9) AS q FROM vl GROUP BY seq_id, dim)""",
        """sc AS (SELECT vl.seq_id, vl.vec_id, sum(vl.x * q.q) / sqrt(64.0) AS s
                  FROM vl JOIN q ON vl.seq_id = q.seq_id AND vl.dim = q.dim WHERE vl.mask = 1 GROUP BY vl.seq_id, vl.vec_id)""",
        """mx AS (SELECT seq_id, max(s) AS smax FROM sc GROUP BY seq_id)""",
        """e AS (SELECT sc.seq_id, sc.vec_id, exp(s - smax) AS e FROM sc JOIN mx ON sc.seq_id = mx.seq_id)""",
        """z AS (SELECT seq_id, sum(e) AS z FROM e GROUP BY seq_id)""",
        """w AS (SELECT e.seq_id, e.vec_id, e.e / z.z AS w FROM e JOIN z ON e.seq_id = z.seq_id)"""]


@query("attention_pool", with_(*ATTN) + """
SELECT vl.seq_id AS label, vl.dim, round(sum(w.w * vl.x), 6) AS x
FROM vl JOIN w ON vl.seq_id = w.seq_id AND vl.vec_id = w.vec_id GROUP BY vl.seq_id, vl.dim""")
def attention_pool(spark, sf_dir):
    """AG-10: attention-weighted pooling with identity projections."""
    pooled, _ = V.attention_pool(B.vectors(spark, sf_dir))
    return pooled.select(F.col("seq_id").alias("label"), "dim", _r(F.col("x"), "x"))


@query("attention_weights", with_(*ATTN) + """
SELECT v.label, v.vec_id, round(coalesce(w.w, 0.0), 6) AS w
FROM embeddings v LEFT JOIN w ON v.label = w.seq_id AND v.vec_id = w.vec_id""")
def attention_weights(spark, sf_dir):
    """AG-11: the softmax weights (0 on masked positions)."""
    _, weights = V.attention_pool(B.vectors(spark, sf_dir))
    return weights.select(F.col("seq_id").alias("label"), "vec_id", _r(F.col("w"), "w"))


def _fixed_matrix(a: int, b: int, n: int = 64) -> np.ndarray:
    """A fixed non-identity projection: ``((a i + b j) mod 11 - 5) / 20``, 0-based."""
    i, j = np.indices((n, n))
    return ((a * i + b * j) % 11 - 5) / 20.0


def _fixed_sql(a: int, b: int) -> str:
    return f"(CAST(({a} * i.dim + {b} * j.dim) % 11 - 5 AS DOUBLE) / 20.0)"


def _projected(src: str, out: str, a: int, b: int, transposed: bool = False) -> str:
    w = _fixed_sql(b, a) if transposed else _fixed_sql(a, b)
    return f"{out} AS (SELECT i.seq_id, j.dim, sum(i.x * {w}) AS x FROM {src} i, (SELECT DISTINCT dim FROM vl) j GROUP BY i.seq_id, j.dim)"


@query("attention_projected", with_(
    Q.VEC_LONG, "m AS (SELECT seq_id, dim, sum(mask * x) / (sum(mask) + 1e-9) AS x FROM vl GROUP BY seq_id, dim)",
    _projected("m", "q", 7, 3), _projected("q", "k", 5, 2, transposed=True),
    "s AS (SELECT vl.seq_id, vl.vec_id, sum(vl.x * k.x) / sqrt(64.0) AS s FROM vl JOIN k ON k.seq_id = vl.seq_id AND k.dim = vl.dim WHERE vl.mask <> 0 GROUP BY vl.seq_id, vl.vec_id)",
    "e AS (SELECT seq_id, vec_id, exp(s - max(s) OVER (PARTITION BY seq_id)) AS e FROM s)",
    "p AS (SELECT vl.seq_id, vl.dim, sum(e.e * vl.x) / sum(e.e) AS x FROM vl JOIN e ON e.seq_id = vl.seq_id AND e.vec_id = vl.vec_id GROUP BY vl.seq_id, vl.dim)",
    _projected("p", "v", 3, 8), _projected("v", "o", 4, 9)) + """
SELECT seq_id AS label, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM o""")
def attention_projected(spark, sf_dir):
    """AG-10 with fixed query, key, value and output projections."""
    pooled, _ = V.attention_pool(B.vectors(spark, sf_dir), query_proj=_fixed_matrix(7, 3), key_proj=_fixed_matrix(5, 2),
                                 value_proj=_fixed_matrix(3, 8), out_proj=_fixed_matrix(4, 9))
    return pooled.select(F.col("seq_id").alias("label"), "dim", _r(F.col("x"), "x"))


@query("pixel_normalize", with_(Q.IMG_LONG) + """
SELECT vec_id, pos, round((CAST(b AS DOUBLE) / 255.0 - 0.5) / 0.5, 6) AS x FROM il""")
def pixel_normalize(spark, sf_dir):
    """FN-5 on IMG bytes."""
    r = B.rasters(spark, sf_dir).withColumn("n", V.normalize_pixels("rgba"))
    return _long(r, "n", ["vec_id"], dim="pos")


@query("pixel_denormalize", with_(Q.VEC_LONG) + """
SELECT vec_id, dim AS pos, round(greatest(0.0, least(1.0, (x + 1.0) / 2.0)), 6) AS x FROM vl""")
def pixel_denormalize(spark, sf_dir):
    """FN-6 on VEC values."""
    v = B.vectors(spark, sf_dir).withColumn("d", V.denormalize("vec"))
    return _long(v, "d", ["vec_id"], dim="pos")


@query("composite_white", with_(Q.IMG_LONG, """ip AS (SELECT vec_id, pos // 4 AS pixel, pos % 4 AS ch, b FROM il)""",
                                """al AS (SELECT vec_id, pixel, b AS a FROM ip WHERE ch = 3)""",
                                """tt AS (SELECT ip.vec_id, ip.pixel, ip.ch, 255 * (255 - al.a) + ip.b * al.a + 128 AS t
                                          FROM ip JOIN al ON ip.vec_id = al.vec_id AND ip.pixel = al.pixel WHERE ip.ch < 3)""") + """
SELECT vec_id, CAST(pixel AS INTEGER) AS pixel, CAST(ch AS INTEGER) AS channel, CAST(((t >> 8) + t) >> 8 AS INTEGER) AS value FROM tt""")
def composite_white(spark, sf_dir):
    """IM-1: RGBA over a white background with 8-bit integer blending."""
    r = B.rasters(spark, sf_dir).withColumn("rgb", IM.composite_white_expr("rgba", 4))
    long = r.select("vec_id", F.posexplode("rgb").alias("i", "value"))
    return long.select("vec_id", (F.col("i") / 3).cast("int").alias("pixel"),
                       (F.col("i") % 3).cast("int").alias("channel"), F.col("value").cast("int").alias("value"))


@query("masked_vectors", with_(Q.VEC_LONG) + """
SELECT vec_id, dim, round(x * mask, 6) + 0.0 AS x, mask = 0 AS padding FROM vl""")
def masked_vectors(spark, sf_dir):
    """FN-7: the validity mask applied to every vector, and the inverted mask."""
    v = B.vectors(spark, sf_dir).select("vec_id", V.apply_mask("vec", "mask").alias("v"), V.invert_mask("mask").alias("padding"))
    return v.select("vec_id", "padding", F.posexplode("v").alias("dim", "_x")).select("vec_id", "dim", _r(F.col("_x"), "x"), "padding")


_AFFINE_B = [(j * 5 % 7 - 3) / 4.0 for j in range(4)]


@query("affine_vectors", with_(Q.VEC_LONG) + """
SELECT vec_id, CAST(j AS INTEGER) AS j, round(sum(x * cos(dim * (j + 1))) + (j * 5 % 7 - 3) / 4.0, 6) AS y
FROM vl, range(4) t(j) GROUP BY vec_id, j""")
def affine_vectors(spark, sf_dir):
    """FN-8 with a bias: 64 -> 4, ``W[i, j] = cos(i * (j + 1))``, ``b[j] = (5 j mod 7 - 3) / 4``."""
    v = B.vectors(spark, sf_dir).withColumn("p", V.project("vec", _PROJ_W, _AFFINE_B))
    return _long(v, "p", ["vec_id"], dim="j", val="y")


def _fixed_bias(a: int, n: int = 64) -> np.ndarray:
    """A fixed bias: ``(a j mod 7 - 3) / 10``."""
    return (a * np.arange(n) % 7 - 3) / 10.0


def _biased(src: str, out: str, a: int, b: int, bias: int, keys: str) -> str:
    return (f"{out} AS (SELECT {keys}, j.dim, sum(i.x * {_fixed_sql(a, b)}) + CAST({bias} * j.dim % 7 - 3 AS DOUBLE) / 10.0 AS x "
            f"FROM {src} i, (SELECT DISTINCT dim FROM vl) j GROUP BY {keys}, j.dim)")


_HEADS = [Q.VEC_LONG, "m AS (SELECT seq_id, dim, sum(mask * x) / (sum(mask) + 1e-9) AS x FROM vl GROUP BY seq_id, dim)",
          "ok AS (SELECT seq_id, vec_id, dim, x FROM vl WHERE mask <> 0)",
          _biased("m", "q", 7, 3, 2, "i.seq_id"), _biased("ok", "k", 5, 2, 3, "i.seq_id, i.vec_id"), _biased("ok", "v", 3, 8, 4, "i.seq_id, i.vec_id"),
          "s AS (SELECT k.seq_id, k.vec_id, k.dim // 32 AS h, sum(k.x * q.x) / sqrt(32.0) AS s FROM k JOIN q ON q.seq_id = k.seq_id AND q.dim = k.dim GROUP BY ALL)",
          "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq_id, h)) AS e FROM s)",
          "w AS (SELECT seq_id, vec_id, h, e / sum(e) OVER (PARTITION BY seq_id, h) AS w FROM e)",
          "p AS (SELECT v.seq_id, v.dim, sum(w.w * v.x) AS x FROM v JOIN w ON w.seq_id = v.seq_id AND w.vec_id = v.vec_id AND w.h = v.dim // 32 GROUP BY v.seq_id, v.dim)",
          _biased("p", "o", 4, 9, 5, "i.seq_id")]


def _two_heads(spark, sf_dir):
    return V.attention_pool(B.vectors(spark, sf_dir), heads=2, query_proj=_fixed_matrix(7, 3), key_proj=_fixed_matrix(5, 2), value_proj=_fixed_matrix(3, 8),
                            out_proj=_fixed_matrix(4, 9), query_bias=_fixed_bias(2), key_bias=_fixed_bias(3), value_bias=_fixed_bias(4), out_bias=_fixed_bias(5))


@query("attention_heads", with_(*_HEADS) + """
SELECT seq_id AS label, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM o""")
def attention_heads(spark, sf_dir):
    """AG-10 with two heads and the weights and biases of query, key, value and output."""
    return _two_heads(spark, sf_dir)[0].select(F.col("seq_id").alias("label"), "dim", _r(F.col("x"), "x"))


@query("attention_head_weights", with_(*_HEADS) + """
SELECT m.label, m.vec_id, round(coalesce(a.w, 0.0), 6) AS w FROM embeddings m LEFT JOIN (SELECT vec_id, avg(w) AS w FROM w GROUP BY vec_id) a USING (vec_id)""")
def attention_head_weights(spark, sf_dir):
    """AG-11 with two heads: weights averaged over the heads."""
    return _two_heads(spark, sf_dir)[1].select(F.col("seq_id").alias("label"), "vec_id", _r(F.col("w"), "w"))


@query("attention_large_scores", with_(Q.VEC_LONG.replace("CAST(unnest(embedding) AS DOUBLE)", "400.0 * CAST(unnest(embedding) AS DOUBLE)"), *ATTN[1:]) + """
SELECT vl.seq_id AS label, vl.dim, round(sum(w.w * vl.x), 6) AS x
FROM vl JOIN w ON vl.seq_id = w.seq_id AND vl.vec_id = w.vec_id GROUP BY vl.seq_id, vl.dim""")
def attention_large_scores(spark, sf_dir):
    """AG-10 on vectors 400 times as long: scores in the thousands."""
    vecs = B.vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * 400.0))
    pooled, _ = V.attention_pool(vecs)
    return pooled.select(F.col("seq_id").alias("label"), "dim", _r(F.col("x"), "x"))


@query("attention_rows", with_("""tk AS (
  SELECT vec_id, (dim // 8) AS t, dim % 8 AS d, x, CASE WHEN (vec_id + dim // 8) % 3 <> 0 THEN 1 ELSE 0 END AS mask FROM (
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))""",
                               "q AS (SELECT vec_id, d, sum(mask * x) / (sum(mask) + 1e-9) AS q FROM tk GROUP BY vec_id, d)",
                               "sc AS (SELECT vec_id, t, sum(x * q) / sqrt(8.0) AS s FROM tk JOIN q USING (vec_id, d) WHERE mask = 1 GROUP BY vec_id, t)",
                               "e AS (SELECT vec_id, t, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM sc)") + """
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(sum(e * x) / sum(e), 6) AS x FROM tk JOIN e USING (vec_id, t) GROUP BY vec_id, d""")
def attention_rows(spark, sf_dir):
    """AG-10 inside a row: every vector as eight tokens of eight numbers, every third one masked; no shuffle."""
    v = B.vectors(spark, sf_dir)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("vec", t * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.when((F.col("vec_id") + t) % 3 != 0, 1).otherwise(0))
    rows = v.select("vec_id", tokens.alias("tokens"), mask.alias("valid")).select("vec_id", V.attention_pool_rows("tokens", "valid").alias("p"))
    return _long(rows, "p", ["vec_id"])
