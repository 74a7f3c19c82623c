"""Substring dedup by sliding sentence spans.

A text is cut into sentences; a long sentence is cut further after words chosen by their hash, so
that the same passage is cut alike wherever it stands. A window of ``LEAST_SENTENCES`` consecutive sentences slides over the
text, one sentence at a time, and every window is hashed. A longer run is repeated exactly when all its windows are, so the windows stand
for every run of several sentences, at one hash a sentence. They are joined globally on the hash: a window that also occurs in
a document with a smaller id, or earlier in its own, is a non-first one, and the sentences it covers are removed.

Only hashes travel: a grouped minimum of ids per hash, then a join of the shared hashes back to the
runs. A hash that very many documents share is one row per task in the first and split by AQE
in the second.

Defined results: a null text stays null and has no sentences; a text of fewer sentences
than a window is left alone; documents are told apart by id, so rows of one id are not repeats of
each other; rows without id come last and are not repeats of each other; equal rows lose the same
sentences and stay as many rows. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import pieces
from tessera.llm.common import settled, written
from tessera.llm.hashing import mix, span_hashes

#: Sentences of a window.
LEAST_SENTENCES = 2
#: A sentence of more words is cut after every word whose hash is divisible by CUT.
LONG = 12
CUT = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Sentences of the texts in one buffer.

    ``row, begin, end``: text and byte range of each (``end`` is where the next one begins, or the text
    ends), ``words``: its number of words, ``key``: hash of its words in lower case.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("row", "begin", "end", "words", "key")}
    if not len(data):
        return empty
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    blank = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    edge = first[:-1]
    word_at = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge))
    if not len(word_at):
        return empty
    word_end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | first[1:])) + 1
    key = span_hashes(low, word_at, word_end)
    row = np.searchsorted(starts, word_at, side="right") - 1
    # Texts without a byte share their start with the next one; the last of those holds the word.
    last_of_text = np.r_[row[1:] != row[:-1], True]
    lines = np.r_[0, np.cumsum(data == 10)]
    newline = np.r_[lines[word_at[1:]] > lines[word_end[:-1]], True]
    stop = _STOP[data[word_end - 1]] | newline | last_of_text
    # Words of the whole sentence, to tell long ones.
    owner = np.r_[0, np.cumsum(stop)[:-1]]
    size = np.bincount(owner)[owner]
    stop |= (size > LONG) & (key % np.uint64(CUT) == 0)
    owner = np.r_[0, np.cumsum(stop)[:-1]]
    n = owner[-1] + 1
    first_word = np.flatnonzero(np.r_[True, stop[:-1]])
    words = np.bincount(owner, minlength=n)
    # The key depends on the order of the words: each is mixed with its place.
    place = np.arange(len(owner)) - first_word[owner]
    mixed = mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    bound = np.r_[first_word, len(owner)]
    unit = mix((total[bound[1:]] - total[bound[:-1]]) + words.astype(np.uint64))
    unit_row = row[first_word]
    begin = word_at[first_word]
    end = np.where(np.r_[unit_row[1:] != unit_row[:-1], True], starts[unit_row + 1], np.r_[begin[1:], 0])
    return {"row": unit_row, "begin": begin, "end": end, "words": words, "key": unit}


def windows(found: dict[str, np.ndarray], size: int = LEAST_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, one past the last, hash) of every window of ``size`` sentences within one text."""
    key, row = found["key"], found["row"]
    n = max(len(key) - size + 1, 0)
    a = np.flatnonzero(row[:n] == row[size - 1:size - 1 + n])
    out = np.zeros(len(a), np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + key[a + j])
    return a, a + size, out.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, gone): the numbers of the sentences of each text that non-first runs cover."""
    rows = _keyed(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(2)):
                found = sentences(data, starts)
                a, b, key = windows(found)
                owner = found["row"][a] if len(a) else a
                offset = np.searchsorted(found["row"], np.arange(last - first))  # first sentence of each text
                # A run that stood earlier in the same text is a repeat whatever other texts hold.
                order = np.lexsort((a, key, owner))
                again = np.zeros(len(a), bool)
                if len(a) > 1:
                    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
                ends = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (
                    pa.array(key), pa.array((a - offset[owner]).astype(np.int32)), pa.array((b - offset[owner]).astype(np.int32)), pa.array(again))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *lists],
                                                 names=["doc_id", "text_key", "key", "a", "b", "again"])

    schema = f"doc_id {id_type}, text_key long, key array<long>, a array<int>, b array<int>, again array<boolean>"
    packed = written(rows.mapInArrow(work, schema), "span-runs")
    each = packed.select("doc_id", "text_key", F.inline(F.arrays_zip("key", "a", "b", "again")))
    firsts = each.where(~F.col("again")).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
                                                             F.max(F.col("doc_id").isNull()).alias("some_null"))
    shared = settled(firsts.where(F.col("first_id").isNotNull() & ((F.col("first_id") < F.col("last_id")) | F.col("some_null")))
                     .select("key", "first_id"), "span-shared")
    later = each.join(shared, "key").where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id"))).select("doc_id", "text_key", "a", "b")
    gone = later.unionByName(each.where("again").select("doc_id", "text_key", "a", "b"))
    return settled(gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "span-gone")  # bounded by one text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with repeated sentences removed from the text.

    ``report``: instead doc_id, n_sentences, n_removed, n_spans, n_bytes, n_removed_bytes, text.
    """
    gone = repeated_sentences(docs, id_col, text_col).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone")
    other = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in other]).alias("own"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    joined = joined.select("own", "text", F.col("gone.a").alias("a"), F.col("gone.b").alias("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for first, last, data, starts in pieces(text):
                found = sentences(data, starts)
                count = np.bincount(found["row"], minlength=last - first) if len(found["row"]) else np.zeros(last - first, np.int64)
                offset = np.r_[0, np.cumsum(count)]
                raw = data.tobytes()
                cols: list[list] = [[] for _ in range(6)]
                for r in range(last - first):
                    cut = np.zeros(count[r] + 1, np.int64)
                    for x, y in zip(batch.column(2)[first + r].as_py() or (), batch.column(3)[first + r].as_py() or ()):
                        cut[x] += 1
                        cut[y] -= 1
                    out = np.cumsum(cut[:-1]) > 0 if count[r] else np.zeros(0, bool)
                    lo, n = int(starts[r]), int(starts[r + 1] - starts[r])
                    if out.any():
                        mask = np.zeros(n + 1, np.int64)
                        which = np.flatnonzero(out) + offset[r]
                        np.add.at(mask, found["begin"][which] - lo, 1)
                        np.add.at(mask, found["end"][which] - lo, -1)
                        keep = np.cumsum(mask[:-1]) == 0
                        kept = data[lo:lo + n][keep].tobytes()
                        spans = int(np.count_nonzero(out & ~np.r_[False, out[:-1]]))
                    else:
                        kept, spans = raw[lo:lo + n], 0
                    for c, v in zip(cols, (int(count[r]), int(out.sum()), spans, n, n - len(kept), kept.decode() if text[first + r].is_valid else None)):
                        c.append(v)
                arrays = [batch.column(0).slice(first, last - first), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["own", "n_sentences", "n_removed", "n_spans", "n_bytes", "n_removed_bytes", "text"])

    own = joined.schema["own"].dataType.simpleString()
    out = joined.mapInArrow(work, f"own {own}, n_sentences long, n_removed long, n_spans long, n_bytes long, n_removed_bytes long, text string")
    if report:
        return out.select(F.col(f"own.`{id_col}`").alias("doc_id"), "n_sentences", "n_removed", "n_spans", "n_bytes", "n_removed_bytes", "text")
    return out.select(*[(F.col("text") if c == text_col else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
