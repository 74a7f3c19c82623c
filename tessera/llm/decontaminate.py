"""Benchmark decontamination.

Normalised benchmark n-grams form a hash set; the words of every training text are scanned
window by window, a hash hit is verified word by word, and hit spans or documents are removed.
Only DataFrame functions run. One pass reads the texts: each word position makes the hash of
the window that starts there inside whole-stage codegen and looks it up in the broadcast set, so
nothing but hits (and one marker row per document) is shuffled.

Defined results: a null or empty text has no words and no hit; an item without words makes no
window; an item of fewer than ``n`` words is one window of all its words; equal rows stay as many
rows; rows with one ``doc_id`` and different texts are different documents; a null ``doc_id`` is an
id like any other; an empty benchmark hits nothing. Other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, sized, written

#: What separates words: everything of ASCII but digits and letters. Upper case is a letter here,
#: so that the pattern gives the same words before and after lower-casing.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
#: Distinct windows up to which the set is broadcast (about 200 bytes each: 40 MB at most).
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Words of a text; null for a text without any."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    return words


def benchmark_windows(bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """(win_key, win_words, win_len, items): every distinct window with the items that hold it."""
    words = bench.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(F.col("text"))).alias("w")) \
        .where(F.size("w") > 0)
    last = F.greatest(F.size("w") - n + 1, F.lit(1))
    wins = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, F.lit(n)))).alias("win_words"))
    return (wins.groupBy("win_words").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64(F.concat_ws(" ", "win_words")).alias("win_key"), "win_words",
                    F.size("win_words").alias("win_len"), "items"))


def _window_key(words: str, pos: Column, length: int) -> Column:
    """Hash of the ``length`` words from 0-based ``pos``, as ``benchmark_windows`` makes it."""
    return F.xxhash64(F.concat_ws(" ", *[F.get(F.col(words), pos + i) for i in range(length)]))


def scan(docs: DataFrame, bench: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, hits, items``.

    ``hits`` is the sorted array of (start, length) word windows found; ``items`` the sorted ids
    of the benchmark items they come from. ``text_key`` tells texts under one id apart.
    """
    windows = written(benchmark_windows(bench, n), "bench-windows")
    # At most n lengths, since only an item shorter than the window makes another one.
    lengths = sorted(r[0] for r in windows.select("win_len").distinct().collect())
    small = windows.count() <= broadcast_windows

    text = F.col(text_col)
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                          words_of(ascii_lower(text)).alias("words"))
    base = lowered.select("doc_id", "text_key", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), "words")
    base = base.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    at = base.select("doc_id", "text_key", "n_words", "words", F.posexplode_outer("words").alias("pos", "word"))
    if len(lengths) > 1:
        made = F.array(*[F.struct(F.lit(m).alias("len"), _window_key("words", F.col("pos"), m).alias("key")) for m in lengths])
        at = at.withColumn("made", F.explode(made)).select(
            "doc_id", "text_key", "n_words", "words", "pos", F.col("made.len").alias("len"), F.col("made.key").alias("key"))
    else:
        m = lengths[0] if lengths else n
        at = at.select("doc_id", "text_key", "n_words", "words", "pos", F.lit(m).alias("len"),
                       _window_key("words", F.col("pos"), m).alias("key"))
    first = F.lit(lengths[0] if lengths else n)
    # One row per document and length that marks the document, whether it has a hit or not.
    marker = (F.col("len") == first) & (F.col("pos").isNull() | (F.col("pos") == 0))
    within = F.col("pos") + F.col("len") <= F.col("n_words")
    same = F.slice("words", F.col("pos") + 1, F.col("len")) == F.col("win_words")
    if small:
        found = at.join(F.broadcast(windows), within & (F.col("key") == F.col("win_key")) & (F.col("len") == F.col("win_len")) & same, "left")
        found = found.where(marker | F.col("win_key").isNotNull()).select(
            "doc_id", "text_key", "n_words", marker.alias("is_first"),
            F.when(F.col("win_key").isNotNull(), F.struct("pos", F.col("len"))).alias("hit"), "items")
    else:
        # A set beyond the bound: only windows travel, and AQE splits a frequent one.
        moved = at.where(within).select("doc_id", "text_key", "n_words", "pos", "len", "key",
                                        F.slice("words", F.col("pos") + 1, F.col("len")).alias("here"))
        hits = moved.join(windows, (F.col("key") == F.col("win_key")) & (F.col("here") == F.col("win_words"))).select(
            "doc_id", "text_key", "n_words", F.lit(False).alias("is_first"), F.struct("pos", "len").alias("hit"), "items")
        marks = base.select("doc_id", "text_key", "n_words", F.lit(True).alias("is_first"),
                            F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"),
                            F.lit(None).cast("array<string>").alias("items"))
        found = marks.unionByName(hits)
    return found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if("is_first").alias("copies"), F.sort_array(F.collect_set("hit")).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def hit_words(hits: Column) -> Column:
    """Number of word positions inside any of the sorted (start, length) windows."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    def step(acc, h):
        end = h["pos"] + h["len"]
        fresh = F.greatest(end - F.greatest(h["pos"], acc["upto"]), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + fresh).alias("n"))
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, bench: DataFrame, n: int = WINDOW, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (equal rows stay)."""
    per = scan(docs, bench, n, **kw)
    out = per.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), "copies")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.withColumn("copy", again).drop("copy", "copies")


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = WINDOW, mode: str = "drop", id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with the hit words cut out (``cut``).

    ``cut`` keeps what stands between words, so a clean text comes back byte for byte.
    """
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode: {mode!r}")
    per = scan(docs, bench, n, id_col, text_col).where(F.size("hits") > 0).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("hits").alias("__hits"))
    per = sized(written(per, "contaminated"))
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key"))
    if mode == "drop":
        return docs.join(per, same, "left_anti")
    gone = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))
    words = F.regexp_extract_all(text, F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    gaps = F.split(text, "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    kept = F.transform(words, lambda w, i: F.when(F.array_contains(gone, i), F.lit("")).otherwise(w))
    cut = F.array_join(F.flatten(F.zip_with(gaps, kept, lambda g, w: F.array(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit(""))))), "")
    return docs.join(per, same, "left").withColumn(
        text_col, F.when(F.col("__hits").isNull(), text).otherwise(cut)).select(*docs.columns)
