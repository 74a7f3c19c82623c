"""Mixing sources to target weights.

Each source gets a token target from its weight. Whole epochs of a source come first; what is
left of the target is filled by Efraimidis-Spirakis sampling: every document draws the key
``-ln(u) / weight`` (``u`` from a hash of seed and id, so reruns agree), documents are sorted by key
within their source, and the prefix sums of their sizes are cut at the budget.

The sort of a source is spread over many tasks: keys fall into buckets by a monotone function, bucket
totals give every bucket its offset, and only rows of one bucket meet in one task. The function is the distribution
of the source's keys itself, a mixture over the weights of its documents, so buckets are even whatever the weights.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
source of size 0 has target 0; equal rows are separate documents with draws of their own; a
null quality counts as ``weight`` 1. Other columns are passed through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Sampling weight of labelled documents (quality 1, quality 0); others weigh 1.
GOOD, POOR = 2.0, 0.5
#: The weights that occur, each with the name of its count in a source.
KINDS = {"n_good": GOOD, "n_poor": POOR, "n_other": 1.0}
#: Rows of a source that share a bucket, on average.
BUCKET_ROWS = 20_000


def n_tokens(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\x09-\\x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``weight, target``.

    Weights repeat over the sources in code point order, null last. The targets share the sum of
    all sizes by weight; none exceeds ``max_epochs`` times its source, the excess goes to the others
    by weight. That is a water level: with sources in order of ``cap / weight``, those before the
    level are capped and the rest get ``weight * (total - caps before) / weights left``. The
    table has a row per source (a mixture's configuration), not per document.
    """
    from pyspark.sql import Window as W

    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                    ((F.row_number().over(order) - 1) % len(weights)) + 1))
    by = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rest = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
                              / F.sum("weight").over(rest)) \
        .withColumn("free", F.col("level") * F.col("weight") <= cap)
    level = level.withColumn("level", F.min(F.when(F.col("free"), F.struct(cap / F.col("weight"), "level"))).over(W.partitionBy())["level"])
    # Several windows without keys: a row per source passes through one task, never a document.
    return level.withColumn("target", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap)).drop("level", "free")


def draw(seed: str, *parts: Column) -> Column:
    """A uniform number in (0, 1) from a hash: the same in every run and every engine."""
    code = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(code, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def share_below() -> Column:
    """Expected share of a source's ``docs`` that draw less than ``key``, from its counts by weight; it grows with the key."""
    return sum((F.col(name) * (1 - F.exp(-w * F.col("key"))) for name, w in KINDS.items()), F.lit(0.0)) / F.col("docs")


def plan(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
         bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, text_key, occurrence, size, source, source_size, target, repeats`` for every document.

    ``quality`` is ``(doc_id, quality)``; the lowest label of an id counts.
    """
    from pyspark.sql import Window as W

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.xxhash64(F.col(text_col)).alias("text_key"), n_tokens(F.col(text_col)).alias("size"))
    if quality is not None:
        marks = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.min("quality").alias("quality"))
        rows = rows.join(marks, F.col("doc_id") == F.col("q_id"), "left").drop("q_id")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    rows = rows.withColumn("weight", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(1.0))
    # Equal rows become one row with a count, then as many rows with numbers of their own.
    counted = written(rows.groupBy("doc_id", "source", "text_key", "size", "weight").agg(F.count("*").alias("n")), "mix-sizes")
    shares = [F.sum(F.when(F.col("weight") == w, F.col("n")).otherwise(0)).alias(name) for name, w in KINDS.items()]
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), *shares)
    aims = written(targets(sizes, weights, max_epochs), "mix-targets")
    each = counted.withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    # A row per source: a mixture has few; Spark broadcasts it below its own threshold, else shuffles.
    each = each.join(aims.select(F.col("source").alias("s"), "source_size", "target", "docs", *KINDS), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumn("key", -F.log(draw(seed, F.col("doc_id"), F.col("occurrence"))) / F.col("weight"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows))
    each = each.withColumn("bucket", F.least(buckets - 1, F.floor(buckets * share_below()))).drop(*KINDS)
    each = each.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    each = written(each, "mix-keys")
    totals = each.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                            F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)).alias("offset"))
    in_bucket = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_key", "occurrence").rowsBetween(W.unboundedPreceding, -1)
    summed = each.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    summed = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    before = F.col("offset") + F.col("inside")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    # The document across the budget is taken if most of it is within, so the miss is half a document at most.
    taken = (before + F.col("size") / 2 <= budget) & (budget > 0) & (F.col("epochs") < max_epochs)
    return summed.select("doc_id", "text_key", "occurrence", "size", "source", "source_size", "target",
                         (F.col("epochs") + taken.cast("int")).cast("int").alias("repeats"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **kw) -> DataFrame:
    """The mixture itself: each document as many times as the plan takes it."""
    takes = plan(docs, quality, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    takes = takes.groupBy("doc_id", "source", "text_key").agg(F.sum("repeats").alias("__n"), F.count("*").alias("__of")).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), "__n", "__of")
    same = (F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source"))
            & (F.xxhash64(F.col(text_col)) == F.col("__key")))
    out = docs.join(written(takes, "mix-takes"), same)
    return _repeat(out, docs.columns)


def _repeat(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Each row ``__n / __of`` times; a remainder (equal rows only) is dealt by a running number per key."""
    from pyspark.sql import Window as W

    single = joined.where(F.col("__of") == 1).withColumn("__t", F.col("__n"))
    number = F.row_number().over(W.partitionBy("__id", "__source", "__key").orderBy(F.lit(1)))
    several = joined.where(F.col("__of") > 1).withColumn("__r", number).withColumn(
        "__t", F.floor(F.col("__n") / F.col("__of")) + (F.col("__r") <= F.col("__n") % F.col("__of")).cast("int")).drop("__r")
    both = single.unionByName(several).where(F.col("__t") > 0)
    return both.withColumn("__t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__t").cast("long")))).select(*columns)

