"""Language identification by Bayesian evidence fusion.

Evidence of the text is the likelihood of its byte trigrams under each language, with a class
``und`` that takes every trigram for equally likely, so that noise has a class to go to. The declared
markup language multiplies it by a reliability. The prior of a row comes from its address: shares
of languages by text alone, summed by groups (all, suffix, domain, host) in Spark, each level
smoothed by the one above it, without the row's own share.

Defined results: a null or empty text has no evidence of its own, so the prior decides, and is not rejected; null host,
domain, suffix or declaration are no evidence; rows are never merged; an empty table has no rows;
with no labelled row every text is ``und``. Other columns of the caller
are kept in ``own``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import pieces
from tessera.llm.common import sized, written

UND = "und"
#: Labelled rows that the trigram counts are fitted on, about (chosen by hash of the id).
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 16
#: Pseudo-count of a trigram in a language.
ALPHA = 0.05
#: Trigrams overlap; each counts as this share of an independent observation.
TEMPER = 1 / 3
#: Probability that a declared language is the text's.
DECLARED = 0.85
PRIOR_UND = 1e-3
#: Strength of the level above, in rows.
STRENGTH = {"suffix": 20.0, "domain": 10.0, "host": 5.0}


def _buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket at each byte but the last two of a text, and offsets of the texts in them."""
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    low[low < 65] = 32  # digits, signs and spaces are all one symbol
    x = low.astype(np.uint32)
    code = np.zeros(len(x), np.uint32)
    if len(x) > 2:
        code[:-2] = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    keep = np.ones(len(x), bool)
    blank = np.zeros(len(x), bool)
    if len(x) > 2:
        blank[:-2] = (x[:-2] == 32) & (x[1:-1] == 32)  # runs of blanks say nothing
    for k in (1, 2):
        at = starts[1:] - k
        keep[at[at >= starts[:-1]]] = False
    keep &= ~blank
    return code[keep].astype(np.int64), np.r_[0, np.cumsum(keep)][starts]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram bucket | language), from about ``sample_rows`` labelled rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("language-sample")), F.lit(1 << 20)) < int(share * (1 << 20))).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, last, data, starts in pieces(batch.column(1)):
                code, at = _buckets(data, starts)
                owner = np.repeat(langs[first:last], np.diff(at))
                for lang in set(langs[first:last]):
                    sums[lang] = sums.get(lang, 0) + np.bincount(code[owner == lang], minlength=BUCKETS)
        for lang, n in sums.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b), pa.array(n[b])], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # BUCKETS rows a language at most
    langs = sorted(set(table.column("lang").to_pylist()))
    n = np.zeros((len(langs), BUCKETS))
    where = {lang: k for k, lang in enumerate(langs)}
    n[[where[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return langs, np.log((n + ALPHA) / (n.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))


def evidence(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str) -> DataFrame:
    """``df`` without the text, with ``ll``: tempered log likelihoods of the languages, then ``und``."""
    langs, logs = model
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(logs.astype(np.float32)))
    keys = [c for c in df.columns if c != text_col]
    frame = df.select(*keys, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    width = len(langs) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(len(keys))):
                code, at = _buckets(data, starts)
                n = np.diff(at)
                out = np.zeros((last - first, width))
                full = np.flatnonzero(n)
                if len(full):
                    for k in range(width - 1):
                        out[full, k] = np.add.reduceat(logs[k][code].astype(np.float64), at[:-1][full])
                out[:, width - 1] = -np.log(BUCKETS) * n
                flat = pa.array((out * TEMPER).ravel())
                arrays = [batch.column(i).slice(first, last - first) for i in range(len(keys))]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (last - first + 1) * width, width, dtype=np.int32)), flat))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "ll"])

    return frame.mapInArrow(work, f"{fields + ', ' if fields else ''}ll array<double>")


def _normal(logs: Column) -> Column:
    """Log values to probabilities that sum to 1."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", host: Column | None = None,
             declared: Column | None = None) -> DataFrame:
    """``own`` (a struct of the other columns) with ``lang, posterior, text_lang, declared, host, rejected``.

    ``text_lang`` is what the text alone says (null without a trigram). ``host``: address of the row (its suffix and domain are taken from it); ``declared``: language
    code declared in the markup.
    """
    langs = [*model[0], UND]
    none = F.lit(None).cast("string")
    # The caller's columns travel in one struct, so no name of theirs can clash.
    keys = [c for c in df.columns if c != text_col]
    own = F.struct(*[F.col(f"`{c}`") for c in keys]) if keys else F.struct(F.lit(0).alias("_"))
    base = df.select(own.alias("own"), (host if host is not None else none).alias("host"),
                     F.lower(F.substring_index(declared if declared is not None else none, "-", 1)).alias("declared"), F.col(f"`{text_col}`").alias("text"))
    dots = F.split(F.col("host"), "\\.")
    base = base.withColumn("suffix", F.when(F.size(dots) > 1, F.element_at(dots, -1))).withColumn(
        "domain", F.when(F.size(dots) > 1, F.array_join(F.slice(dots, -2, 2), ".")))
    k = len(langs)
    # A row without trigrams says nothing about its neighbours.
    silent = F.col("ll")[k - 1] == 0
    share = F.when(silent, F.array(*[F.lit(0.0)] * k)).otherwise(_normal(F.col("ll")))
    rows = written(evidence(base, model, "text").withColumn("share", share), "language-evidence")

    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(k)]
    total = F.array(*[F.col(f"s{i}") for i in range(k)])
    hosts = written(rows.groupBy("suffix", "domain", "host").agg(*sums).select("suffix", "domain", "host", total.alias("sum")), "language-hosts")
    again = [F.sum(F.col("sum")[i]).alias(f"s{i}") for i in range(k)]
    everything = hosts.agg(*again).first()  # one row
    overall = F.array(*[F.lit(float(x or 0.0)) for x in everything])
    out = rows
    for level in ("suffix", "domain", "host"):
        table = hosts.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("g")).agg(*again).select("g", total.alias(f"{level}_sum"))
        out = out.join(sized(written(table, f"language-{level}")), F.col(level) == F.col("g"), "left").drop("g")

    def less(c: Column) -> Column:
        """A group's sums without the row's own share."""
        return F.zip_with(c, "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    start = F.array(*[F.lit((1 - PRIOR_UND) / max(1, k - 1))] * (k - 1), F.lit(PRIOR_UND))
    def smooth(counts: Column, above: Column, m: float) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, above, lambda c, p: (c + m * p) / (n + m))
    out = out.withColumn("prior", smooth(less(overall), start, 1.0))
    for level, m in STRENGTH.items():
        out = out.withColumn("prior", F.when(F.col(f"{level}_sum").isNull(), F.col("prior")).otherwise(smooth(less(F.col(f"{level}_sum")), F.col("prior"), m)))
    said = F.array(*[F.when(F.col("declared") == x, DECLARED).otherwise((1 - DECLARED) / max(1, k - 2)) if x != UND else F.lit(1 / max(1, k - 1)) for x in langs])
    known = F.col("declared").isin(*model[0]) if model[0] else F.lit(False)
    logs = F.zip_with("ll", "prior", lambda a, b: a + F.log(F.greatest(b, F.lit(1e-12))))
    logs = F.when(known, F.zip_with(logs, said, lambda a, b: a + F.log(b))).otherwise(logs)
    out = out.withColumn("p", _normal(logs))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("p")
    out = out.select("own", F.element_at(names, F.array_position("p", best).cast("int")).alias("lang"), best.alias("posterior"),
                     F.when(~silent, F.element_at(names, F.array_position("share", F.array_max("share")).cast("int"))).alias("text_lang"), "declared", "host")
    # Noise by its own text, not by the company it keeps.
    return out.withColumn("rejected", (F.col("lang") == UND) & F.coalesce(F.col("text_lang") == UND, F.lit(False)))


def markup_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")


def markup_language(html: Column) -> Column:
    """The ``lang`` of the ``html`` element; null if none."""
    found = F.regexp_extract(html, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1)
    return F.when(found != "", found)


def address_host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.when(found != "", found)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                    host: Column | None = None) -> DataFrame:
    """``docs`` without the rows whose text is taken for noise (``und``)."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), (host if host is not None else F.lit(None).cast("string")).alias("host"),
                        F.col(text_col).alias("text"))
    found = identify(keyed, model, "text", host=F.col("host"))
    gone = written(found.where("rejected").select(F.col("own.id").alias("__id"), F.col("own.key").alias("__key")).distinct(), "language-rejected")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__key"))
    return docs.join(sized(gone), same, "left_anti")
