"""Caption tokenization (TX-1..TX-3).

Words are cut in Catalyst by one pattern, as an uncased encoder's basic tokenization does: letters are lower-cased, and every
punctuation mark is a word of its own. Words that are not plain ASCII then lose control characters, accents and combining
marks, word by word, so plain texts pay for one pass. Subwords are the longest vocabulary entries from the
left. The vocabulary is an input table ``(token, id)``; below a checked size it goes to the workers as a trie in one sorted array of
edges, and the distinct words of an Arrow batch walk it side by side, one step a character, without a shuffle. Beyond that size
the distinct words are cut by a join with the vocabulary and joined back to their places.

Character offsets: :func:`segments` cuts a text into words and the blanks between them, so lengths add up to
places in the text, and :func:`encode` turns them into the end of every subword.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrays import let
from ..session import stored

# The ids the reference's encoder reserves for padding, start and end (BERT convention).
CLS_ID, SEP_ID, PAD_ID = 101, 102, 0
# Fixed value: the token of a word that the vocabulary cannot spell.
UNK = "[UNK]"
# Fixed value: longest word that is spelled at all.
MAX_CHARS = 100
#: Subwords of a text that fit beside the start and the end.
BUDGET = 254

# Control and format characters other than tab and line ends are left out of words.
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}"
BLANK = r"\t\n\r\p{Z}"

#: Vocabulary entries up to which the table is sent to the workers.
BROADCAST_TOKENS = 200_000
#: Words that a worker cuts at once (a longer text is cut alone).
WORDS_AT_ONCE = 1 << 17


@cache
def accents() -> tuple[str, str]:
    """Accented characters and their bases, from their Unicode decomposition."""
    pairs = []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def marks() -> str:
    """Punctuation as a character class: ASCII signs, also those that Unicode calls symbols, and what decomposes to one."""
    signs = "".join(a for a, b in zip(*accents()) if b < "\x80" and not b.isalnum())
    return r"!-/:-@\[-`{-~\p{P}" + "".join(f"\\x{{{ord(c):x}}}" for c in signs)


def word_pattern() -> str:
    return rf"[{marks()}]|[^{BLANK}{marks()}]+"


#: The same for plain ASCII texts.
PLAIN_MARKS, PLAIN_BLANK = r"!-/:-@\[-`{-~", r"\t\n\r "


def folded(word: Column) -> Column:
    """A lower-case word without control characters, accents and combining marks; plain ASCII words stay."""
    bare = F.regexp_replace(F.translate(word, *accents()), rf"[{CONTROL}\p{{Mn}}]", "")
    return F.when((F.octet_length(word) == F.char_length(word)) & ~word.rlike(r"[\x00-\x1F\x7F]"), word).otherwise(bare)


def _cut(text: Column, mark: str, blank: str) -> Column:
    """Blanks around every mark, and then the pieces between blanks: two quick passes instead of one match object a word."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), f"([{mark}])", " $1 "), f"[{blank}]+"), "")


def split_words(text) -> Column:
    """Words and punctuation marks of a text, in order (null: none)."""
    t = F.col(text) if isinstance(text, str) else text
    plain = (F.octet_length(t) == F.char_length(t)) & ~t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    other = F.array_remove(F.transform(_cut(t, marks(), BLANK), folded), "")
    return F.coalesce(F.when(plain, _cut(t, PLAIN_MARKS, PLAIN_BLANK)).otherwise(other), F.array().cast("array<string>"))


#: Characters of a text's beginning that are cut for each word wanted.
HEAD_CHARS = 8


def first_words(text, most: int) -> Column:
    """The first ``most`` of :func:`split_words`, for texts of any length at the cost of their beginning.

    The beginning is enough if it holds more words than asked for (the last may be part of one); else the whole text is cut. So it is
    for a beginning with a capital sigma, the one letter whose lower case depends on what follows.
    """
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(t, 1, HEAD_CHARS * most)
    enough = (F.char_length(t) > HEAD_CHARS * most) & ~F.contains(head, F.lit("\u03a3"))
    begun = F.when(enough, split_words(head)).otherwise(F.array().cast("array<string>"))
    return let(begun, lambda w: F.slice(F.when(F.size(w) > most, w).otherwise(split_words(t)), 1, most))


#: A noncharacter that marks the edges of segments; texts that hold it are cut the slow way.
_EDGE = "\uffff"


def segments(text) -> Column:
    """A text cut without loss, as it is: words, punctuation marks and runs of blanks (null: none)."""
    t = F.col(text) if isinstance(text, str) else text
    quick = F.array_remove(F.split(F.regexp_replace(t, f"([{marks()}]|[{BLANK}]+)", f"{_EDGE}$1{_EDGE}"), _EDGE), "")
    slow = F.regexp_extract_all(t, F.lit(f"({word_pattern()}|[{BLANK}]+)"), F.lit(1))
    return F.coalesce(F.when(F.contains(t, F.lit(_EDGE)), slow).otherwise(quick), F.array().cast("array<string>"))


def caption_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, word)`` with 0-based word positions (whole texts)."""
    return exploded_words(df.select(id_col, split_words(text_col).alias("words")), [id_col])


def exploded_words(df: DataFrame, keep: list[str], words_col: str = "words") -> DataFrame:
    """One row per word: ``keep``, ``pos`` and ``word``.

    An outer explode and a filter on its result: for a plain one Spark infers a filter on the array's size, and evaluates the
    cutting of the words once more for it.
    """
    return df.select(*keep, F.posexplode_outer(words_col).alias("pos", "word")).where(F.col("pos").isNotNull())


def pad_truncate(ids, max_len: int = 256, cls: int = CLS_ID, sep: int = SEP_ID, pad: int = PAD_ID):
    """TX-2: ``[cls] + ids[:max_len-2] + [sep]``, padded with ``pad`` to ``max_len``.

    Returns ``(input_ids, attention_mask, n_valid)`` columns.
    """
    c = F.col(ids) if isinstance(ids, str) else ids
    seq = F.concat(F.array(F.lit(cls)), F.slice(c, 1, max_len - 2), F.array(F.lit(sep)))
    n = F.size(seq)
    input_ids = F.concat(seq, F.array_repeat(F.lit(pad), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return input_ids, mask, n


def truncation_report(df: DataFrame, group_col: str, n_col: str, budget: int = 254) -> DataFrame:
    """TX-3: texts per group, how many exceed the token budget, and how many tokens they lose."""
    over = F.greatest(F.col(n_col) - budget, F.lit(0))
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum((over > 0).cast("int")).cast("bigint").alias("n_truncated"),
        F.sum(over).cast("bigint").alias("n_lost_tokens"))


def lost_suffix(df: DataFrame, suffix_chars: str, text_chars: str, budget: int = BUDGET, ids_col: str = "ids") -> DataFrame:
    """TX-3: what is left of each text's suffix within ``budget`` subwords.

    ``df`` was encoded with ends (:func:`encode`); ``text_chars`` and ``suffix_chars`` are the lengths of a text and of the suffix at its end.
    Adds ``n_tokens``, ``kept_chars`` (the end, in the text, of the last subword that fits), ``suffix_start`` and ``suffix``:
    ``whole``, ``part`` or ``none``.
    """
    n, length = F.size(ids_col), F.col(text_chars)
    kept = F.when(n <= budget, length).otherwise(F.element_at("ends", budget))
    start = length - F.col(suffix_chars)
    left = F.when(kept >= length, F.lit("whole")).when(kept > start, F.lit("part")).otherwise(F.lit("none"))
    return df.select("*", n.alias("n_tokens"), kept.alias("kept_chars"), start.alias("suffix_start"), left.alias("suffix"))


def corpus_vocabulary(words: DataFrame, least_share: float = 1e-4, first_id: int = 1000, word_col: str = "word") -> DataFrame:
    """A vocabulary table from a corpus, where none is given: ``(token, id)``.

    Every character, alone and as a continuation (``##``), so that any word can be spelled, and every word
    that makes up ``least_share`` of all (at most ``1 / least_share`` words). Ids follow the tokens' order. The
    counts of distinct words are written once; total, characters and words are read from them.
    """
    counts = stored(words.groupBy(F.col(word_col).alias("token")).agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    chars = counts.select(F.explode(F.array_distinct(F.split("token", ""))).alias("token")).where("token <> ''").distinct()
    tokens = counts.where(F.col("n") >= least_share * total).select("token").unionByName(chars).unionByName(
        chars.select(F.concat(F.lit("##"), F.col("token")).alias("token"))).unionByName(words.sparkSession.createDataFrame([(UNK,)], "token string")).distinct()
    # A row per token, not per word of the corpus.
    numbered = tokens.select("token", (F.row_number().over(Window.orderBy("token")) - 1 + first_id).cast("int").alias("id"))
    return stored(numbered, "vocabulary")


class Trie:
    """Vocabulary entries as one sorted array of edges ``node * 2**21 + character``; word starts at node 0, continuations at node 1."""

    def __init__(self, entries: dict[str, int]):
        self.unk = entries[UNK]
        edges: dict[int, int] = {}
        ids = [-1, -1]
        for token, number in entries.items():
            node, text = (1, token[2:]) if token.startswith("##") and len(token) > 2 else (0, token)
            for ch in text:
                key = (node << 21) | ord(ch)
                node = edges.setdefault(key, len(ids))
                if node == len(ids):
                    ids.append(-1)
            ids[node] = number
        keys = sorted(edges)
        self.keys = np.array(keys + [np.iinfo(np.int64).max], np.int64)
        self.child = np.array([edges[k] for k in keys] + [0], np.int64)
        self.ids = np.array(ids, np.int64)

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of the longest pieces of all words, and where each word's begin (one entry more than words)."""
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        begin = end - size
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unspelled = size > MAX_CHARS
        active = np.flatnonzero((size > 0) & ~unspelled)
        at, start = begin.copy(), begin.copy()
        node, best, best_end = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64), begin.copy()
        found = []
        while len(active):
            here = np.minimum(at[active], len(codes) - 1)
            key = np.where(at[active] < end[active], (node[active] << 21) | codes[here], np.iinfo(np.int64).max - 1)
            edge = np.searchsorted(self.keys, key)
            step = self.keys[edge] == key
            on = active[step]
            node[on] = self.child[edge[step]]
            at[on] += 1
            entry = self.ids[node[on]]
            hit = on[entry >= 0]
            best[hit], best_end[hit] = entry[entry >= 0], at[hit]
            off = active[~step]
            stuck = off[best[off] < 0]
            unspelled[stuck] = True
            piece = off[best[off] >= 0]
            found.append((piece, start[piece], best[piece], best_end[piece] - start[piece]))
            at[piece] = start[piece] = best_end[piece]
            node[piece], best[piece] = 1, -1
            active = np.concatenate([on, piece[at[piece] < end[piece]]])
        found.append((np.flatnonzero(unspelled), begin[unspelled], np.full(unspelled.sum(), self.unk), size[unspelled]))
        word, place, ids, length = (np.concatenate([f[i] for f in found]) for i in range(4))
        good = ~unspelled[word]
        good[len(word) - unspelled.sum():] = True
        word, place, ids, length = word[good], place[good], ids[good], length[good]
        order = np.lexsort((place, word))
        return ids[order], length[order], np.searchsorted(word[order], np.arange(len(words) + 1))


def longest_pieces(word: str, vocab: dict[str, int], unk: int) -> list[int]:
    """Ids of one word's longest entries from the left; the unknown id if some place has none."""
    return Trie({**vocab, UNK: unk}).cut([word])[0].tolist()


def _fold_word(word: str) -> str:
    """:func:`folded` of a lower-cased segment; blanks have no word."""
    if word.isascii() and word.isprintable():
        return "" if word.isspace() else word.lower()
    low = unicodedata.normalize("NFD", word.lower())
    return "".join(c for c in low if unicodedata.category(c) not in ("Mn", "Cc", "Cf") and not c.isspace())


def encode(df: DataFrame, vocab: DataFrame, words_col: str = "words", out_col: str = "ids", broadcast_tokens: int = BROADCAST_TOKENS,
           id_col: str = "doc_id", ends: bool = False) -> DataFrame:
    """TX-1: ``df`` with the subword ids of its array of words, which goes.

    ``vocab`` is ``(token, id)`` with an entry for ``[UNK]``. ``id_col`` (unique) serves the path beyond
    ``broadcast_tokens`` only. With ``ends`` the array holds the :func:`segments` of a text, and a column ``ends`` has the place in the text
    where each subword ends; a subword that ends a word ends with it.
    """
    if vocab.limit(broadcast_tokens + 1).count() > broadcast_tokens:
        if ends:
            raise ValueError(f"ends need a vocabulary of at most {broadcast_tokens} entries")
        return _encode_by_join(df, vocab, words_col, out_col, id_col)
    shared = df.sparkSession.sparkContext.broadcast(Trie({r["token"]: r["id"] for r in vocab.collect()}))

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto = batch.column(words_col).offsets.to_numpy()
        first = 0
        while first < len(batch):
            last = max(int(np.searchsorted(upto, upto[first] + WORDS_AT_ONCE, side="right")) - 1, first + 1)
            yield batch.slice(first, last - first)
            first = last

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = shared.value
        lists = batch.column(words_col)
        distinct = lists.flatten().dictionary_encode()
        words = distinct.dictionary.to_pylist()
        which = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bound = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
        ids, length, starts = trie.cut([_fold_word(w) for w in words] if ends else words)
        n = np.diff(starts)[which]
        upto = np.r_[0, np.cumsum(n)]
        piece = np.repeat(starts[which] - upto[:-1], n) + np.arange(upto[-1])
        cuts = pa.array(upto[bound].astype(np.int32))
        columns = [*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(ids[piece].astype(np.int32)))]
        names = [*batch.schema.names, out_col]
        if ends:
            size = np.array([len(w) for w in words], np.int64)[which]
            stop = np.cumsum(size) - np.repeat(np.r_[0, np.cumsum(size)][bound[:-1]], np.diff(bound))
            inner = np.cumsum(length) - np.repeat(np.r_[0, np.cumsum(length)][starts[:-1]], np.diff(starts))
            place = np.minimum(np.repeat(stop - size, n) + inner[piece], np.repeat(stop, n))
            last = np.zeros(len(piece), bool)
            last[upto[1:][n > 0] - 1] = True
            columns.append(pa.ListArray.from_arrays(cuts, pa.array(np.where(last, np.repeat(stop, n), place).astype(np.int32))))
            names.append("ends")
        keep = [i for i, c in enumerate(names) if c != words_col]
        return pa.RecordBatch.from_arrays([columns[i] for i in keep], names=[names[i] for i in keep])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield coded(part)

    added = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ([out_col, "ends"] if ends else [out_col])]
    return df.mapInArrow(work, T.StructType([*[f for f in df.schema.fields if f.name != words_col], *added]))


def _encode_by_join(df: DataFrame, vocab: DataFrame, words_col: str, out_col: str, id_col: str) -> DataFrame:
    """The same for a vocabulary of any size: pieces of each distinct word by a join on its substrings."""
    places = df.select(id_col, F.posexplode(words_col).alias("_pos", "_word"))
    words = places.select("_word").distinct()
    n = F.length("_word")
    starts = words.where(n <= MAX_CHARS).select("_word", F.explode(F.sequence(F.lit(1), n)).alias("_at"))
    subs = starts.select("_word", "_at", F.explode(F.sequence(F.lit(1), n - F.col("_at") + 1)).alias("_len"))
    subs = subs.withColumn("token", F.concat(F.when(F.col("_at") > 1, F.lit("##")).otherwise(F.lit("")), F.substr("_word", F.col("_at"), F.col("_len"))))
    longest = subs.join(vocab, "token").groupBy("_word", "_at").agg(F.max(F.struct("_len", "id")).alias("best"))
    per_word = longest.groupBy("_word").agg(F.sort_array(F.collect_list(F.struct("_at", "best"))).alias("steps"))  # within one word
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = F.aggregate("steps", start, lambda a, s: F.when(
        s["_at"] == a["at"], F.struct((a["at"] + s["best"]["_len"]).alias("at"), F.concat(a["ids"], F.array(s["best"]["id"])).alias("ids"))).otherwise(a))
    unk = vocab.where(F.col("token") == UNK).agg(F.max("id")).scalar()
    spelled = words.join(per_word.withColumn("end", walked), "_word", "left").select(
        "_word", F.when(F.col("end.at") == n + 1, F.col("end.ids")).otherwise(F.array(unk)).alias("ids"))
    per_text = places.join(spelled, "_word").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_pos", "ids"))).alias("_all"))  # within one text
    out = per_text.select(id_col, F.flatten(F.col("_all.ids")).alias(out_col))
    return df.drop(words_col).join(out, id_col, "left").withColumn(out_col, F.coalesce(out_col, F.array().cast("array<int>")))
