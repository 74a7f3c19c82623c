"""Line dedup: documents probe a sharded minimal perfect hash of the lines that several documents hold.

A line's key is the line without blanks at both ends, A-Z in lower case; keys of at least ``LEAST`` code points count.
Keys are told apart by a 128-bit hash, and no text of a line ever moves.

1. Every document gives the hashes of its distinct keys. A grouped minimum, maximum and count per hash (with partial
   aggregation, so a line of a third of all documents is one row a task) tells which stand in two documents or more, and
   the smallest id that holds them.
2. These hashes are dealt to shards of about ``SHARD_KEYS`` by their value. A shard is one row: a minimal perfect hash (levels of
   bits; a hash alone on its bit has the bit's rank for its slot) and, by slot, a fingerprint, the number of
   documents and the smallest id. A hash outside the set meets some slot or none, and its fingerprint differs.
3. A document's hashes go to their shard and probe its arrays in a stream: the shard's row is sorted before its
   probes, so a worker holds one shard and one batch. Shards that are probed much (a hot line) are copied to
   several salts, and their probes dealt over these.
4. What is found goes back to the document, as 64-bit numbers, and its lines are dropped in one pass over the text.

Nothing is collected on the driver but two counts, and nothing is broadcast beyond ``common.sized``.

Defined results: a null or empty text is one empty line and stays as it is; rows that share an id are one document (a line
that only they hold stays in all of them); a null id is one document after all others; equal lines of one document go or stay together;
other columns pass through. A text of any length is read line by line; lines of a text are never a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settled, sized, written
from tessera.llm.hashing import GOLDEN, mix

#: Code points of the shortest key that counts.
LEAST = 10
#: Hashes of a shard, on average.
SHARD_KEYS = 16_384
#: Probes of a shard for each salt.
SALT_PROBES = 200_000

_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUED = bytes(range(0x80, 0xC0))


def lines(data: bytes, least: int = LEAST) -> Iterator[tuple[int, int, int | None, bytes | None]]:
    """(begin, end, low half of the key's hash, whole hash) of every line; without hashes where the key is too short."""
    at = 0
    while True:
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        key = data[at:end].strip(_BLANKS).lower()
        if len(key) >= 4 * least or len(key.translate(None, _CONTINUED)) >= least:
            digest = xxhash.xxh3_128_digest(key)
            yield at, end, int.from_bytes(digest[:8], "little", signed=True), digest
        else:
            yield at, end, None, None
        if end == len(data):
            return
        at = end + 1


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _keys(rows: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_key, one, two): the hash of every distinct key of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for i, data in enumerate(_texts(batch.column(2))):
                mine = {whole for _, _, _, whole in lines(data, least) if whole}
                found.extend(mine)
                of.append(np.full(len(mine), i))
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(np.concatenate(of)) if of else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                                             names=["doc_id", "text_key", "one", "two"])

    return rows.select("doc_id", "text_key", "text").mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, one long, two long")


def _spots(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * int(GOLDEN) % 2**64)
    return (mix(one ^ mix(two + step)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: ``len(keys)`` slots, one each."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        sizes, bits = [], [np.zeros(0, bool)]
        while len(one):
            size = max(64, 2 * len(one))
            spot = _spots(one, two, len(sizes), size)
            alone = np.bincount(spot, minlength=size) == 1
            left = ~alone[spot]
            sizes.append(size)
            bits.append(alone)
            one, two = one[left], two[left]
        return cls(sizes, np.concatenate(bits))

    @classmethod
    def load(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool))

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each key's slot; for other keys any slot, or -1."""
        out = np.full(len(one), -1, np.int64)
        left, base = np.arange(len(one)), 0
        for level, size in enumerate(self.sizes):
            spot = base + _spots(one[left], two[left], level, size)
            there = self.bits[spot]
            out[left[there]] = self.rank[spot[there]]
            left, base = left[~there], base + size
        return out


def _shards(repeated: DataFrame, id_type: str) -> DataFrame:
    """One row a shard: its perfect hash, and by slot fingerprints, counts of documents and smallest ids."""
    def build(group: pa.Table) -> pa.Table:
        one, two = (group.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
        table = PerfectHash.build(one, two)
        slot = table.slots(one, two)
        order = np.argsort(slot)
        held = group.column("documents").to_numpy()
        return pa.table({
            "shard": group.column("shard").slice(0, 1), "salts": pa.array([1 + int(held.sum()) // SALT_PROBES], pa.int32()),
            "sizes": pa.array([table.sizes], pa.list_(pa.int32())), "bits": pa.array([np.packbits(table.bits).tobytes()], pa.binary()),
            "prints": pa.array([two[order].tobytes()], pa.binary()), "counts": pa.array([np.minimum(held, 2**31 - 1)[order].astype(np.int32).tobytes()], pa.binary()),
            "firsts": pa.array([group.column("first").take(pa.array(order)).to_pylist()], pa.list_(group.schema.field("first").type))})

    return repeated.groupBy("shard").applyInArrow(
        build, f"shard int, salts int, sizes array<int>, bits binary, prints binary, counts binary, firsts array<{id_type}>")


def _probe(routed: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, text_key, one) of probes whose line an earlier document holds; a shard's row comes before its probes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
            first = batch.column("index").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(shard)]):
                if lo == hi:
                    continue
                if first[lo]:
                    row = batch.column("index")[lo].as_py()
                    firsts = pa.array(row["firsts"], batch.schema.field("doc_id").type)
                    current = (shard[lo], salt[lo]), PerfectHash.load(row["sizes"], row["bits"]), np.frombuffer(row["prints"], np.uint64), firsts
                    lo += 1
                if current is None or current[0] != (shard[hi - 1], salt[hi - 1]):
                    continue
                _, table, prints, firsts = current
                part = batch.slice(lo, hi - lo)
                one, two = (part.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
                slot = table.slots(one, two)
                held = (slot >= 0) & (prints[slot] == two)
                part = part.filter(pa.array(held))
                later = pc.fill_null(pc.not_equal(part.column("doc_id"), firsts.take(pa.array(slot[held]))), True)
                yield part.filter(later).select(["doc_id", "text_key", "one"])

    return routed.mapInArrow(work, f"doc_id {id_type}, text_key long, one long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = [F.col(c) for c in docs.columns if c != text_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"),
                       (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("own"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, one): for every row the hashes of the lines that an earlier document holds."""
    rows = _rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    keys = settled(_keys(rows, least), "line-keys")
    held = keys.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"),
                                          F.count("*").alias("documents"))
    repeated = settled(held.where("first < last OR first IS NOT NULL AND unnamed").drop("last", "unnamed"), "line-repeated")
    n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
    of = F.pmod("one", F.lit(n_shards)).cast("int").alias("shard")
    shards = written(_shards(repeated.withColumn("shard", of), id_type), "line-shards")
    hot = written(shards.where("salts > 1").select(F.col("shard").alias("hot"), F.col("salts").alias("of_hot")), "line-hot")
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.coalesce("of_hot", F.lit(1))).cast("int")
    probes = keys.withColumn("shard", of).join(sized(hot), F.col("shard") == F.col("hot"), "left").withColumn("salt", salt)
    copies = shards.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.struct("sizes", "bits", "prints", "counts", "firsts").alias("index"))
    routed = copies.unionByName(probes.drop("hot", "of_hot"), allowMissingColumns=True).select("shard", "salt", "index", "doc_id", "text_key", "one", "two")
    routed = routed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("index").isNull())
    return settled(_probe(routed, id_type), "line-found")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, report: bool = False) -> DataFrame:
    """``docs`` without the lines that a document of smaller id holds.

    ``report``: instead doc_id, n_lines, n_dropped and kept_sha256 of every row.
    """
    found = repeated_lines(docs, id_col, text_col, least).groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_set("one").alias("gone"))  # within one text
    rows = _rows(docs, id_col, text_col)
    rows = rows.drop("own") if report else rows
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for data, gone in zip(_texts(batch.column("text")), batch.column("gone")):
                drop = set(gone.values.to_pylist()) if gone.is_valid else ()
                n, dropped, kept, run = 0, 0, [], None
                for begin, end, half, _ in lines(data, least):
                    n += 1
                    if half in drop:
                        dropped += 1
                        if run is not None:
                            kept.append(data[run:last])
                        run = None
                    else:
                        run, last = (begin if run is None else run), end
                if run is not None:
                    kept.append(data[run:last])
                text = b"\n".join(kept)
                texts.append(hashlib.sha256(text).hexdigest() if report else text)
                counts.append((n, dropped))
            counts = np.array(counts, np.int64).reshape(-1, 2)
            if report:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy()), pa.array(texts, pa.string())],
                                                 names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                left = pc.if_else(batch.column("text").is_valid(), pa.array(texts, pa.binary()).cast(pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("own"), left], names=["own", "text"])

    if report:
        return joined.select("doc_id", "text", "gone").mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")
    out = joined.select("own", "text", "gone").mapInArrow(work, f"own {rows.schema['own'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns])
