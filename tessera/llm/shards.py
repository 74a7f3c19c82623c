"""Balanced label propagation: documents into shards of even size, linked documents together.

Documents with equal texts are linked. Every linked document starts in a shard drawn by hash;
then, round by round, joins count where the neighbours of a document are, the document asks to
move to the shard with most of them, and a shard admits movers, largest gain first, up to its
quota of free places. What is not linked (it has no edge to cut) fills the shards at last, so that
counts differ by one at most (law ``rows``).

A document moves as part of a block: the documents of a link group that agree in a hash of their
id. A group of any size has at most ``SUB_BLOCKS`` blocks, so no join or window meets more rows
of one group than that, and a group beyond a shard's capacity spreads over several target shards.

Defined results: a null text has no bytes, no links and the checksum of no bytes; empty texts
are equal texts; equal rows are documents of their own, in one link group; a null id is an id like
any other; an empty table has no rows. Other columns are passed through by nothing but the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import byte_size, written

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
ROUNDS = 5
SUB_BLOCKS = 256
#: Classes of movers by hash within one class of gain: the grain of a quota.
GRAIN = 1024
#: Rows that are numbered together in one task, on average.
BUCKET_ROWS = 50_000


def _nth(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index.cast("int"))


def propagate(blocks: DataFrame, n_shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(link, sub, n, group_n) -> the same with ``shard``, after at most ``rounds`` rounds.

    Each round writes its labels, so a lost executor repeats one round at most.
    """
    state = written(blocks.withColumn("shard", F.pmod(F.xxhash64("link", "sub", F.lit("start")), F.lit(n_shards)).cast("int")), "shard-labels")
    for _ in range(rounds):
        # One number per shard: bounded by the number of shards.
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, capacity - load.get(s, 0)) for s in range(n_shards)]
        near = state.groupBy("link", "shard").agg(F.sum("n").alias("c"))
        place = F.struct("c", F.xxhash64("link", "shard").alias("tie"), "shard")
        near = near.groupBy("link").agg(F.sort_array(F.collect_list(place), asc=False).alias("near"))  # n_shards entries at most
        with_near = state.join(near, "link")
        open_ = F.filter("near", lambda x: _nth(free, x["shard"]) > 0)
        wanted = F.greatest(F.lit(1), F.ceil(F.col("group_n") / max(capacity, 1)))
        asked = with_near.withColumn("open", open_).withColumn("own", F.get(F.filter("near", lambda x: x["shard"] == F.col("shard")), F.lit(0)))
        asked = asked.withColumn("to", F.get(F.col("open"), F.pmod(F.col("sub"), F.least(wanted, F.greatest(F.size("open"), F.lit(1)))).cast("int")))
        # Of two equal shards the one with free places is better, else the hash decides, so that not all change places.
        better = (F.col("to.c") > F.col("own.c")) | ((F.col("to.c") == F.col("own.c")) & (F.col("to.shard") != F.col("shard"))
                                                     & ((F.col("to.tie") > F.col("own.tie")) | (_nth(free, F.col("shard")) == 0)))
        asked = asked.select("link", "sub", "n", "group_n", "shard", F.when(better, F.col("to.shard")).alias("target"),
                             F.when(better, -F.floor(F.log2(F.col("to.c") - F.col("own.c") + 1))).alias("gain"),
                             F.pmod(F.xxhash64("link", "sub"), F.lit(GRAIN)).alias("grain"))
        # Admission by classes of (gain, hash): a bounded number per shard, whatever the input.
        classes = asked.where(F.col("target").isNotNull()).groupBy("target", "gain", "grain").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("target").orderBy("gain", "grain").rowsBetween(W.unboundedPreceding, W.currentRow))
        admitted = classes.withColumn("upto", upto).where(F.col("upto") <= _nth(free, F.col("target"))).select(
            "target", "gain", "grain", F.lit(True).alias("admitted"))
        state = written(asked.join(admitted, ["target", "gain", "grain"], "left").select(
            "link", "sub", "n", "group_n", F.when(F.col("admitted"), F.col("target")).otherwise(F.col("shard")).alias("shard")), "shard-labels")
    return state


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
          link: Column | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``link``: an expression over ``docs``; rows with equal values that are not null are linked
    (default: equal texts).
    """
    text = F.col(text_col)
    link = F.when(text.isNotNull(), F.md5(text.cast("binary"))) if link is None else link.cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), (byte_size(text) + ROW_BYTES).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), link.alias("link"))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("sub")), F.lit(SUB_BLOCKS)).cast("int"))
    # Equal rows are one row with a count until the numbering.
    cells = written(rows.groupBy("doc_id", "size", "text_crc32", "link", "sub").agg(F.count("*").alias("n")), "shard-cells")

    blocks = cells.where(F.col("link").isNotNull()).groupBy("link", "sub").agg(F.sum("n").alias("n"))
    groups = blocks.groupBy(F.col("link").alias("g")).agg(F.sum("n").alias("group_n")).where("group_n > 1")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    base, extra = divmod(total, n_shards)
    labels = propagate(blocks.join(groups, F.col("link") == F.col("g")).drop("g"), n_shards, base, rounds)

    placed = cells.join(labels.select(F.col("link").alias("l"), F.col("sub").alias("s"), "shard"),
                        (F.col("link") == F.col("l")) & (F.col("sub") == F.col("s")), "left")
    placed = written(placed.select("doc_id", "size", "text_crc32", "link", "n", F.coalesce("shard", F.lit(-1)).alias("label"),
                                   F.pmod(F.xxhash64(F.coalesce("link", F.lit("")), "doc_id"), F.lit(max(1, total // BUCKET_ROWS))).alias("bucket")), "shard-placed")

    # A gapless number within each label: offsets of the buckets, and the place within a bucket.
    sums = placed.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    offset = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("label").alias("l"), F.col("bucket").alias("b"), offset.alias("offset"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("label", "bucket").orderBy("link", "doc_id", "text_crc32", "size")
                                        .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("inside", inside).join(offsets, (F.col("label") == F.col("l")) & (F.col("bucket") == F.col("b")))
    ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("inside") + F.col("k"))

    # Linked documents keep their shard up to its count; all others fill the free places in order.
    load = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # n_shards + 1 rows
    count = [base + (s < extra) for s in range(n_shards)]
    kept = [min(count[s], load.get(s, 0)) for s in range(n_shards)]
    over_before, need_upto, over, need = [], [], load.get(-1, 0), 0
    for s in range(n_shards):
        over_before.append(over)
        over += load.get(s, 0) - kept[s]
        need += count[s] - kept[s]
        need_upto.append(need)
    label, rank = F.col("label"), F.col("rank")
    stays = (label >= 0) & (rank < _nth(kept, label))
    queue = F.when(label < 0, rank).when(~stays, _nth(over_before, label) + rank - _nth(kept, label))
    ranked = ranked.withColumn("queue", queue)
    filled = F.size(F.filter(F.array(*[F.lit(int(v)).cast("long") for v in need_upto]), lambda x: x <= F.col("queue")))
    ranked = ranked.withColumn("shard", F.when(stays, label).otherwise(filled).cast("int"))
    before = [0, *need_upto[:-1]]
    slot = F.when(stays, rank).otherwise(_nth(kept, F.col("shard")) + F.col("queue") - _nth(before, F.col("shard")))
    return ranked.select("doc_id", F.col("size").cast("long").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard",
                         slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_share(sharded: DataFrame) -> float:
    """Share of linked documents that are outside the largest part of their group (by checksum)."""
    parts = sharded.groupBy("text_crc32", "size", "shard").count().groupBy("text_crc32", "size").agg(
        F.sum("count").alias("n"), F.max("count").alias("top")).where("n > 1")
    n, top = parts.agg(F.sum("n"), F.sum("top")).first()
    return 0.0 if not n else 1 - top / n
