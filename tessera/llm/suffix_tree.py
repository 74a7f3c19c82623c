"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the tokens of a text: its words in lower case, then one end token. The root of the tree is
the smoothed unigram distribution. Level by level Spark counts what follows each context of one
more word, over all training texts. A context becomes a state if it occurs ``LEAST_COUNT`` times or more and its next-symbol
distribution diverges from its parent's, the next shorter state's (count times Kullback-Leibler divergence of ``MIN_GAIN``
nats or more); a next token counts by itself if it follows ``LEAST_PAIR`` times or more. These are counts, not shares: more
text gives more states, and a context once kept is kept when the corpus grows.
Distributions are smoothed along the parents. A text's score is the sum over its tokens of
log10 P(token | state), the state being the longest suffix of what precedes that is in the tree.

States and their next tokens are written tables, a pair per level, made by grouped sums and joins. While all of them together have at
most ``TREE_ROWS`` rows they go to the workers as sorted arrays and texts are scored where they are; beyond that the tokens
of the texts meet the tables in joins, level by level, with the same result. Sets that only spare the counting
rows (frequent words, frequent shorter contexts, frequent pairs) go to the workers up to ``SPARE_ROWS`` rows, and are left out beyond.
A context of d + 1 tokens is a pair of the level before, its d oldest tokens and the one after them, so that level's counts tell
which contexts are frequent before they are counted.

The root needs the training count of every token. The most frequent tokens, at most ``TABLE_ROWS``
of them, go to the workers; all others are resolved by a join on their hash, so the
vocabulary may be of any size. Tokens are told apart by 64-bit hashes.

Defined results: a null text is empty; an empty text is one end token; equal rows are scored (and
counted) each; with no training text all counts are 0; a null id is written as an empty string
for the choice of held-out rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import pieces
from tessera.llm.common import discard, settled, written
from tessera.llm.hashing import GOLDEN, mix, span_hashes

#: Words of the longest context.
DEPTH = 3
#: Least count of a context.
LEAST_COUNT = 500
#: Least count of a (context, next token) pair; rarer ones count as unseen.
LEAST_PAIR = 20
MIN_GAIN = 10.0
#: Weight of the parent's distribution, in counts.
PARENT = 8.0
#: Most rows of the frequent-token table (16 bytes each).
TABLE_ROWS = 1 << 19
#: Most rows of a set that spares the counting rows (8 bytes each).
SPARE_ROWS = 1 << 22
#: Most rows of a tree that goes to the workers (16 bytes each).
TREE_ROWS = 1 << 23
HELD_OUT = (5, 1)
#: Distinct keys that a task counts before it passes its counts on.
FLUSH = 1 << 19

#: The end symbol is a byte that UTF-8 never has.
SPACE, END = 0x20, 0xFF
_END_KEY = np.int64(0x5EED0E4D)
#: In place of a next token: the row of the context itself, with all that follows it.
_TOTAL = np.int64(0x07E40000)


def normalise(raw: bytes) -> bytes:
    """Tokens in lower case, joined by one space, and the end symbol."""
    return b" ".join(raw.lower().split()) + b"\xff"


def token_keys(data: np.ndarray) -> np.ndarray:
    """Key of each token of normalised texts (one after another), the end symbol's among them."""
    edge = (data == SPACE) | (data == END)
    ends = np.flatnonzero(edge)
    begins = np.empty_like(ends)
    begins[:1] = 0
    begins[1:] = ends[:-1] + 1
    keys = span_hashes(data, begins, ends).view(np.int64)
    last = data[ends] == END
    # A text without words is the end token alone.
    word = ends > begins
    slots = word.astype(np.int64) + last
    at = np.cumsum(slots) - slots
    out = np.empty(int(slots.sum()), np.int64)
    out[at[word]] = keys[word]
    out[(at + word)[last]] = _END_KEY
    return out


def contexts(tokens: np.ndarray, depth: int = DEPTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length d from 1 to ``depth``: the key of the d tokens before each token, and the first of them.

    Before a text's first token stand end tokens, so that texts do not run into each other.
    """
    n = len(tokens)
    stops = np.flatnonzero(tokens == _END_KEY)
    begin = np.zeros(n, np.int64)
    begin[stops[:-1] + 1] = stops[:-1] + 1
    since = np.arange(n) - np.maximum.accumulate(begin)
    out, oldest, key = [], [], np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        before = np.full(n, _END_KEY, np.int64)
        before[d:] = tokens[:-d]
        before[since < d] = _END_KEY
        key = mix(key * GOLDEN + before.view(np.uint64))
        out.append(key.view(np.int64))
        oldest.append(before)
    return out, oldest


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context.view(np.uint64) * GOLDEN ^ token.view(np.uint64)).view(np.int64)


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def held_out_mask(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % HELD_OUT[0] == HELD_OUT[1] for i in ids], bool)


class _Counter:
    """Counts of rows of keys, kept sorted and passed on when many."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.n = names, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self._fold([(columns, np.ones(len(columns[0]), np.int64))])

    def _fold(self, more: list) -> None:
        columns = [np.concatenate([c[i] for c, _ in more]) for i in range(len(self.names))]
        counts = np.concatenate([n for _, n in more])
        # The last column is a key of the whole row.
        _, first, back = np.unique(columns[-1], return_index=True, return_inverse=True)
        self.parts.append(([c[first] for c in columns], np.bincount(back, counts, len(first)).astype(np.int64)))
        self.n += len(first)
        if len(self.parts) > 1 and self.n > FLUSH:
            parts, self.parts, self.n = self.parts, [], 0
            self._fold(parts)

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.n > least:
            parts, self.parts, self.n = self.parts, [], 0
            for columns, counts in parts:
                # Rows of one context together: what repeats from row to row takes little room in the shuffle.
                order = np.argsort(columns[0])
                columns, counts = [c[order] for c in columns], counts[order]
                for a in range(0, len(counts), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a:a + (1 << 18)]) for x in (*columns, counts)], names=[*self.names, "n"])


def _normalised(data: np.ndarray, starts: np.ndarray, keep=None) -> np.ndarray:
    raw = data.tobytes()
    rows = range(len(starts) - 1) if keep is None else np.flatnonzero(keep)
    return np.frombuffer(b"".join([normalise(raw[starts[r]:starts[r + 1]]) for r in rows]), np.uint8)


def _training_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, last, data, starts in pieces(batch.column(1)):
            text = _normalised(data, starts, ~held_out_mask(ids[first:last]))
            if len(text):
                yield token_keys(text)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(key, n): every token of the training rows of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Counter(["key"])
        for tokens in _training_tokens(batches):
            words.add(tokens)
            yield from words.batches(2 * FLUSH)
        yield from words.batches()

    return docs.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_level(docs: DataFrame, level: int, heads, states, nexts, met) -> DataFrame:
    """(context, parent, token, n) for contexts of ``level`` words; a context's total stands under ``_TOTAL``.

    Only contexts whose oldest word is frequent (``heads``), whose suffix is a frequent context (``states``) and that are
    a frequent pair of the level before (``met``, which implies the other two) are counted, and only tokens in ``nexts``.
    None spares nothing: all are counted then.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heads, states, nexts, met))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, states, nexts, met = shared.value
        pairs = _Counter(["context", "parent", "token", "pair"])
        for tokens in _training_tokens(batches):
            keys, oldest = contexts(tokens, level)
            own = keys[level - 1]
            parent = keys[level - 2] if level > 1 else np.zeros(len(own), np.int64)
            if met is not None:
                # Before a text's first token there is no pair; its context of end tokens alone is counted in any case.
                use = np.r_[True, found_in(met, pair_keys(parent, tokens)[:-1])[1] | (tokens[:-1] == _END_KEY)]
            else:
                use = np.ones(len(own), bool) if heads is None else found_in(heads, oldest[level - 1])[1]
                if level > 1 and states is not None:
                    use &= found_in(states, parent)[1]
            own, parent, token = own[use], parent[use], tokens[use]
            total = np.full(len(own), _TOTAL)
            pairs.add(own, parent, total, pair_keys(own, total))
            told = slice(None) if nexts is None else found_in(nexts, token)[1]
            own, parent, token = own[told], parent[told], token[told]
            pairs.add(own, parent, token, pair_keys(own, token))
            yield from pairs.batches(2 * FLUSH)
        yield from pairs.batches()

    local = docs.mapInArrow(work, "context long, parent long, token long, pair long, n long").drop("pair")
    return local.groupBy("context", "parent", "token").agg(F.sum("n").alias("n"))


def _keys(df: DataFrame, column: str, limit: int) -> np.ndarray | None:
    """The sorted keys of a written table of at most ``limit`` rows."""
    if df.count() > limit:
        return None
    return np.sort(df.select(column).toArrow().column(0).to_numpy())


def _pairs(df: DataFrame, limit: int) -> np.ndarray | None:
    """The sorted pair keys of a written table (context, token) of at most ``limit`` rows."""
    if df.count() > limit:
        return None
    context, token = (c.to_numpy() for c in df.select("context", "token").toArrow().columns)
    return np.sort(pair_keys(context, token))


class Tree:
    """The states by level, as sorted arrays: contexts with their escape, pairs with their log10 P."""

    def __init__(self, levels: list[tuple[DataFrame, DataFrame]]):
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.probs: list[np.ndarray] = []
        for states, pairs in levels:
            context, escape = (c.to_numpy() for c in states.toArrow().columns)
            order = np.argsort(context)
            self.contexts.append(context[order])
            self.escapes.append(escape[order])
            of, token, prob = (c.to_numpy() for c in pairs.toArrow().columns)
            key = pair_keys(of, token)
            order = np.argsort(key)
            self.pairs.append(key[order])
            self.probs.append(prob[order])

    def log10(self, tokens: np.ndarray, keys: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each token in its longest state, and whether a pair of a state told it.

        ``keys[d]``: the context of d + 1 tokens; ``root``: log10 P at the root.
        """
        out, told, left = np.zeros(len(tokens)), np.zeros(len(tokens), bool), np.arange(len(tokens))
        for d in range(min(len(keys), len(self.contexts)) - 1, -1, -1):
            key = keys[d][left]
            at, state = found_in(self.contexts[d], key)
            place, seen = found_in(self.pairs[d], pair_keys(key, tokens[left]))
            seen &= state
            out[left[seen]] += self.probs[d][place[seen]]
            told[left[seen]] = True
            less = state & ~seen
            out[left[less]] += self.escapes[d][at[less]]
            left = left[~seen]
        out[left] += root[left]
        return out, told


def learn(docs: DataFrame, words: DataFrame, norm: float, least_count: int = LEAST_COUNT, least_pair: int = LEAST_PAIR) -> list[tuple[DataFrame, DataFrame]]:
    """Per level the states (context, escape) and their next tokens (context, token, log10 P), as written tables."""
    heads = _keys(settled(words.where(F.col("n") >= least_count).select("key"), "pst-heads"), "key", SPARE_ROWS)
    often = words.where(F.col("n") >= least_pair)
    nexts = _keys(settled(often.select("key"), "pst-nexts"), "key", SPARE_ROWS)
    # P of each frequent pair in the longest state that is a suffix of its context; at the root, of each token.
    above = often.select(F.lit(0).cast("long").alias("parent"), F.col("key").alias("token"), F.pow(F.lit(10.0), F.log10(F.col("n") + 0.5) - norm).alias("above"))
    least = F.lit(1e-12)
    levels, frequent, met = [], None, None
    for level in range(1, DEPTH + 1):
        known = None if frequent is None else _keys(frequent, "context", SPARE_ROWS)
        counts = settled(count_level(docs, level, heads, known, nexts, met).where(F.col("n") >= min(least_pair, least_count)), "pst-level")
        discard(frequent)
        whole = F.col("token") == int(_TOTAL)
        frequent = settled(counts.where(whole & (F.col("n") >= least_count)).select("context", "parent", F.col("n").alias("total")), "pst-frequent")
        met = _pairs(counts.where(~whole & (F.col("n") >= least_count)), SPARE_ROWS) if level < DEPTH and least_pair <= least_count else None
        pairs = counts.where(~whole & (F.col("n") >= least_pair)).join(frequent, ["context", "parent"])
        pairs = pairs.join(above, ["parent", "token"])
        smooth = (F.col("n") + PARENT * F.col("above")) / (F.col("total") + PARENT)
        pairs = settled(pairs.select("context", "token", "n", "total", "above", smooth.alias("smooth")), "pst-pairs")
        discard(counts)
        # All tokens that are no pair here count as one symbol in the test, and share what is left of the mass as the parent's distribution says.
        p = F.col("n") / F.col("total")
        sums = pairs.groupBy("context").agg(F.max("total").alias("total"), F.sum(F.col("n") * F.ln(p / F.col("above"))).alias("gain"),
                                            F.greatest(1 - F.sum(p), least).alias("rest"), F.greatest(1 - F.sum("above"), least).alias("rest_above"),
                                            F.greatest(1 - F.sum("smooth"), least).alias("left"))
        gain = F.col("gain") + F.col("total") * F.col("rest") * F.ln(F.col("rest") / F.col("rest_above"))
        states = settled(sums.where(gain >= MIN_GAIN).select("context", F.log10(F.col("left") / F.col("rest_above")).alias("escape")), "pst-states")
        judged = settled(pairs.join(states.select("context", F.lit(True).alias("state")), "context", "left").select(
            "context", "token", F.coalesce("state", F.lit(False)).alias("state"), F.when(F.col("state"), F.col("smooth")).otherwise(F.col("above")).alias("p")), "pst-judged")
        discard(pairs)
        levels.append((states, settled(judged.where("state").select("context", "token", F.log10("p").alias("prob")), "pst-next")))
        above = judged.select(F.col("context").alias("parent"), "token", F.col("p").alias("above"))
    discard(frequent)
    return levels


def grow(docs: DataFrame, words: DataFrame, n_all: int, norm: float, least_count: int = LEAST_COUNT, least_pair: int = LEAST_PAIR) -> Tree:
    """The tree in arrays."""
    return Tree(learn(docs, words, norm, least_count, least_pair))


def _told_by_joins(rows: DataFrame, levels: list[tuple[DataFrame, DataFrame]], words: DataFrame, norm: float) -> DataFrame:
    """(row, score) of texts whose tokens meet the states in joins; ``rows``: row, text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(1)):
                tokens = token_keys(_normalised(data, starts))
                row = np.repeat(batch.column(0).slice(first, last - first).to_numpy(), np.diff(np.r_[-1, np.flatnonzero(tokens == _END_KEY)]))
                keys = contexts(tokens)[0]
                _, one, n = np.unique(np.stack([row, tokens, *keys]), axis=1, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x[one]) for x in (row, tokens, *keys)] + [pa.array(n)], names=["row", "token", *[f"c{d}" for d in range(1, DEPTH + 1)], "k"])

    left = rows.mapInArrow(work, "row long, token long, " + ", ".join(f"c{d} long" for d in range(1, DEPTH + 1)) + ", k long")
    left = left.withColumn("value", F.lit(0.0)).withColumn("told", F.lit(False))
    for d in range(len(levels), 0, -1):
        states, pairs = (t.withColumnRenamed("context", f"c{d}") for t in levels[d - 1])
        left = left.join(states, f"c{d}", "left").join(pairs, [f"c{d}", "token"], "left")
        step = F.when(F.col("told") | F.col("escape").isNull(), F.lit(0.0)).otherwise(F.coalesce("prob", "escape"))
        left = left.select("row", "token", *[f"c{i}" for i in range(1, d)], "k", (F.col("value") + step).alias("value"), (F.col("told") | F.col("prob").isNotNull()).alias("told"))
    root = F.when(F.col("told"), F.lit(0.0)).otherwise(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - norm)
    left = left.join(words.withColumnRenamed("key", "token"), "token", "left")
    return left.groupBy("row").agg(F.sum(F.col("k") * (F.col("value") + root)).alias("joined"))


class _Root:
    """A tree without states."""

    def log10(self, tokens: np.ndarray, keys: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return root.copy(), np.zeros(len(tokens), bool)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, least_pair: int = LEAST_PAIR) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = written(count_tokens(rows), "pst-tokens")
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = float(np.log10(n_all + 0.5 * (n_distinct + 1)))
    levels = learn(rows, words, norm, least_count, least_pair)
    by_joins = sum(t.count() for level in levels for t in level) > TREE_ROWS
    tree = _Root() if by_joins else Tree(levels)
    # The least power of two whose table fits; a row per power is collected.
    steps = {r["p"]: r["k"] for r in words.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("k")).collect()}
    power, size = (max(steps) + 1 if steps else 0), 0
    while power > 0 and size + steps.get(power - 1, 0) <= TABLE_ROWS:
        power -= 1
        size += steps.get(power, 0)
    table = words.where(F.col("n") >= (1 << power)).toArrow()
    known, often = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((tree, known[order], np.log10(often[order] + 0.5) - norm))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, told array<boolean>"
    if by_joins:
        schema += ", text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, known, logs = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, starts in pieces(batch.column(1)):
                tokens = token_keys(_normalised(data, starts))
                stops = np.flatnonzero(tokens == _END_KEY)
                begins = np.r_[0, stops[:-1] + 1]
                at, hit = found_in(known, tokens)
                value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(tokens))
                scores, told = tree.log10(tokens, contexts(tokens)[0], value)
                n_rare = np.add.reduceat((~hit).astype(np.int64), begins)
                bound = pa.array(np.r_[0, np.cumsum(n_rare)].astype(np.int32))
                rare, open_ = (pa.ListArray.from_arrays(bound, pa.array(x[~hit])) for x in (tokens, told))
                n = last - first
                text = [batch.column(1).slice(first, n)] if by_joins else []
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), pa.array(held_out_mask(ids[first:last])),
                    pa.array(stops - begins + 1), pa.array(np.add.reduceat(hit.astype(np.int64), begins)),
                    pa.array(np.add.reduceat(value, begins)), pa.array(np.add.reduceat(scores, begins)), rare, open_, *text],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "told", *["text"] * len(text)])
                row += n

    scored = written(rows.mapInArrow(work, schema), "pst-scored")
    # Tokens beyond the table: counted by a join; a token without a row was never seen in training.
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("key"), "told")))
    rare = rare.groupBy("row", "key").agg(F.count("*").alias("k"), F.count_if(~F.col("told")).alias("open"))
    at_root = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - norm
    found = rare.join(words.where(F.col("n") < (1 << power)), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("k"),
        F.sum(F.col("k") * at_root).alias("s"), F.sum(F.col("open") * at_root).alias("s_open"))
    out = scored.drop("rare", "told", "text").join(found, "row", "left")
    zero = F.lit(0.0)
    told = F.col("score") + F.coalesce("s_open", zero)
    if by_joins:
        out = out.join(_told_by_joins(scored.select("row", "text"), levels, words, norm), "row")
        told = F.col("joined")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(n_all).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("s", zero)).alias("base_score"), told.alias("score"))
