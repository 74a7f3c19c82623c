"""Exact-size seeded splits, per-epoch shuffles and mini-batches (SP-1, SP-3..SP-7).

Sizes follow the rule of a shuffled two-step hold-out split, in double arithmetic:
``n_test = ceil(test_ratio * n)``, then ``n_val = ceil(val_ratio / (1 - test_ratio) * (n -
n_test))``, the rest is train; a split that would leave train empty fails. Rows are cut in the order of
``md5("<seed>:<id>")`` and, within an id, of a hash of the whole row: deterministic, independent of
partitioning and input order, and exact whether ids are unique, repeated or null.

A split needs two cuts in that order, not every row's place. Rows are counted per hash prefix, the
two prefixes that hold a cut are counted by hash, and every row is then labelled where it is scanned, by
comparing its hash with the two cuts. Wide rows are never shuffled, and an id that holds a
third of all rows is one row of counts. The cuts are found when the split is built (scans of the id column); they are literals of its plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_rank

SPLITS = ("train", "val", "test")
#: Hex digits of the hash that rows are counted by: 65,536 counts at most, whatever the input.
PREFIX = 4
#: Rows of a prefix from which it is counted by ``PREFIX`` more digits first.
MANY = 100_000
#: Copies of one row that a task labels at once.
COPIES = 1_000_000


def hash_key(seed, *parts) -> Column:
    """``md5("<seed>:<part1>:<part2>...")`` as hex text; uniform, so ranks are balanced."""
    items = [F.lit(str(seed))]
    for p in parts:
        items += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*items))


def id_hash(seed, id_col: str) -> Column:
    """The hash that an id is cut by; null is an id as well, with a hash of its own."""
    return F.coalesce(hash_key(seed, id_col), F.md5(F.lit(str(seed))))


def row_hash(df: DataFrame) -> Column:
    """md5 of all columns as text, joined by the unit separator; a null is the text of one zero character."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]))


def split_sizes(n: int, val_ratio: float = 0.1, test_ratio: float = 0.1) -> tuple[int, int, int]:
    """``(n_train, n_val, n_test)`` for ``n`` rows."""
    n_test = math.ceil(test_ratio * n)
    n_val = math.ceil(val_ratio / (1.0 - test_ratio) * (n - n_test))
    return n - n_test - n_val, n_val, n_test


def _prefix_counts(hashes: DataFrame, digits: int, within: Sequence[str] = ()) -> dict[str, int]:
    """Rows per prefix of ``digits``, of the hashes that begin with one of ``within``."""
    if within:
        hashes = hashes.where(F.substring("h", 1, len(within[0])).isin(list(within)))
    rows = hashes.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    return {r["p"]: r["k"] for r in rows.collect()}  # 65,536 rows a prefix at most; of whole hashes, those of a prefix of MANY rows


def _locate(counts: dict[str, int], place: int) -> tuple[str, int]:
    """The key that holds the ``place``-th row in key order, and the row's place in it."""
    for key in sorted(counts):
        if place <= counts[key]:
            return key, place
        place -= counts[key]
    raise ValueError(f"no row at place {place}")


def _find(hashes: DataFrame, counts: dict[str, int], places: list[int]) -> list[tuple[str, int, int]]:
    """For each place in hash order: the hash there, the row's place among its rows, and their number.

    ``counts``: rows per prefix of ``PREFIX`` digits.
    """
    at = [_locate(counts, p) for p in places]
    if any(counts[p] > MANY for p, _ in at):
        longer = _prefix_counts(hashes, 2 * PREFIX, [p for p, _ in at])
        at = [_locate({k: n for k, n in longer.items() if k.startswith(p)}, place) for p, place in at]
    whole = _prefix_counts(hashes, 32, [p for p, _ in at])
    out = []
    for prefix, place in at:
        key, place = _locate({k: n for k, n in whole.items() if k.startswith(prefix)}, place)
        out.append((key, place, whole[key]))
    return out


@dataclass(frozen=True)
class Cut:
    """A place in the order of (id hash, row hash): all rows up to ``key``, or ``key`` and ``row``, of which only ``copies`` of ``of``."""

    key: str = ""
    row: str | None = None
    copies: int = 0
    of: int = 0

    @property
    def splits_copies(self) -> bool:
        return self.row is not None and self.copies < self.of

    def holds(self, h: Column, r: Column) -> Column:
        """Rows up to the cut, without those of a class of equal rows that it goes through."""
        if self.row is None:
            return h <= self.key
        within = r < self.row if self.splits_copies else r <= self.row
        return (h < self.key) | ((h == self.key) & within)

    def copies_of(self, other: Cut) -> int:
        """How many of the equal rows that ``other`` goes through are up to this cut."""
        if (self.key, self.row) == (other.key, other.row):
            return self.copies
        whole = (other.key < self.key) or (other.key == self.key and (self.row is None or other.row < self.row))
        return other.of if whole else 0


def split_cuts(df: DataFrame, id_col: str = "national_number", val_ratio: float = 0.1, test_ratio: float = 0.1,
               seed: int = 42) -> tuple[Cut, Cut]:
    """The end of the test part and of the validation part.

    Two scans of the id column (three for very many rows); the rows of an id that a cut goes through are counted by row hash in
    the same way. On the driver: counts of prefixes, and of hashes within one prefix.
    """
    hashes = df.select(id_hash(seed, id_col).alias("h"))
    counts = _prefix_counts(hashes, PREFIX)
    n = sum(counts.values())
    n_train, n_val, n_test = split_sizes(n, val_ratio, test_ratio)
    if n and n_train <= 0:
        raise ValueError(f"split leaves the train set empty, n={n}")
    ends = [e for e in (n_test, n_test + n_val) if e]
    found = dict(zip(ends, _find(hashes, counts, ends) if ends else []))

    def cut(end: int) -> Cut:
        if not end:
            return Cut()
        key, place, rows = found[end]
        if place == rows:
            return Cut(key)
        inside = df.where(id_hash(seed, id_col) == key).select(row_hash(df).alias("h"))
        [(row, copies, of)] = _find(inside, _prefix_counts(inside, PREFIX), [place])
        return Cut(key, row, copies, of)

    return cut(n_test), cut(n_test + n_val)


def three_way_split(df: DataFrame, id_col: str = "national_number", val_ratio: float = 0.1,
                    test_ratio: float = 0.1, seed: int = 42, split_col: str = "split") -> DataFrame:
    """SP-1: add ``split`` in {train, val, test} with exact sizes, by row.

    Rows that share an id stand together in the order, so an id is divided only where a cut goes through it; null
    is an id. Equal rows are divided by number.
    """
    test, val = split_cuts(df, id_col, val_ratio, test_ratio, seed)
    h, r = id_hash(seed, id_col), row_hash(df)
    label = F.when(test.holds(h, r), F.lit("test")).when(val.holds(h, r), F.lit("val")).otherwise(F.lit("train"))
    through = {(c.key, c.row): c for c in (test, val) if c.splits_copies}.values()
    out = df.where(~_any([(h == c.key) & (r == c.row) for c in through])) if through else df
    out = out.select("*", label.alias(split_col))
    for c in through:
        # Equal rows that a cut goes through: one of them, as often as they are.
        one = df.where((h == c.key) & (r == c.row)).limit(1)
        blocks = one.select("*", F.explode(F.sequence(F.lit(0), F.lit((c.of - 1) // COPIES))).alias("_block"))
        if c.of > COPIES:
            blocks = blocks.repartition("_block")
        first = F.col("_block") * COPIES
        copies = blocks.select("*", F.explode(F.sequence(first + 1, F.least(first + COPIES, F.lit(c.of)))).alias("_copy"))
        part = F.when(F.col("_copy") <= test.copies_of(c), F.lit("test")).when(F.col("_copy") <= val.copies_of(c), F.lit("val")).otherwise(F.lit("train"))
        out = out.unionByName(copies.select(*df.columns, part.alias(split_col)))
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _numbered(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``_sh_no``: 0 for the only row of an id, else the row's number within the id, by row hash, from 0."""
    repeated = df.groupBy(F.col(id_col).alias("_sh_id")).agg(F.count(F.lit(1)).alias("_sh_k")).where(F.col("_sh_k") > 1).select("_sh_id")
    if not repeated.limit(1).count():
        return df.withColumn("_sh_no", F.lit(0).cast("bigint"))
    same = F.col(id_col).eqNullSafe(F.col("_sh_id"))
    alone = df.join(repeated, same, "left_anti").withColumn("_sh_no", F.lit(0).cast("bigint"))
    several = df.join(repeated, same, "left_semi").withColumn("_sh_r", row_hash(df))
    several = exact_rank(several, ["_sh_r"], F.substring("_sh_r", 1, PREFIX), partition_by=[id_col], rank_col="_sh_no", tiebreak=False)
    return alone.unionByName(several.drop("_sh_r").withColumn("_sh_no", F.col("_sh_no") - 1))


def epoch_shuffle(df: DataFrame, epochs: Sequence[int], id_col: str = "national_number",
                  seed: int = 42, pos_col: str = "pos") -> DataFrame:
    """SP-4: one row per (epoch, row) with ``pos`` = 1-based position in that epoch's order.

    Every loader reshuffles each epoch; the order of epoch ``e`` is ``md5("<seed>:<e>:<id>")``, and further rows of an
    id have their number within it after a ``#``, so they are spread as well. Only (id, number) is
    ranked; other columns are joined back by that key, which no two rows share.
    """
    rows = _numbered(df, id_col)
    ep = F.explode(F.array(*[F.lit(int(e)) for e in epochs])).alias("epoch")
    further = F.when(F.col("_sh_no") > 0, F.concat(F.lit("#"), F.col("_sh_no").cast("string"))).otherwise(F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("string")), F.lit("")), further))
    fanned = rows.select(id_col, "_sh_no").select(ep, id_col, "_sh_no").withColumn("_sh_h", order)
    ranked = exact_rank(fanned, ["_sh_h"], F.substring("_sh_h", 1, PREFIX), partition_by=["epoch"], rank_col=pos_col).drop("_sh_h")
    if df.columns == [id_col]:
        return ranked.drop("_sh_no")
    places = ranked.select("epoch", pos_col, F.col(id_col).alias("_sh_i"), F.col("_sh_no").alias("_sh_n"))
    joined = rows.join(places, F.col(id_col).eqNullSafe(F.col("_sh_i")) & (F.col("_sh_no") == F.col("_sh_n")))
    return joined.select("epoch", *df.columns, pos_col)


def mini_batches(shuffled: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """SP-5: ``batch_id = (pos - 1) div B``; the last batch of an epoch may be short."""
    return shuffled.withColumn("batch_id", F.floor((F.col(pos_col) - 1) / F.lit(batch_size)).cast("bigint"))


def head_batches(batched: DataFrame, n: int | None, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """SP-6: whole batches until at least ``n`` rows are taken; ``shown`` marks the first ``n``.

    A predicate on ``batch_id`` (no global sort, no limit): batches ``0 .. ceil(n/B) - 1``. SP-7:
    ``n=None`` takes and shows all.
    """
    if n is None:
        return batched.withColumn("shown", F.lit(True))
    n_batches = -(-n // batch_size)
    return (batched.where(F.col("batch_id") < n_batches)
            .withColumn("shown", F.col(pos_col) <= F.lit(n)))
