"""The query catalog: every operator of SURVEY §2 as a ``(spark, sf_dir) -> DataFrame`` query.

Each query runs over whole driver tables (through the bindings of ``tessera.bindings``) and,
where the operator is SQL-expressible, carries a DuckDB restatement for the oracle check. Column
names, types and 6-digit rounding agree between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.text import padded_id, py_capitalize, py_str, py_strip
from ..operators import assets as AS
from ..operators import augment as AU
from ..operators import split as SP
from ..operators.captions import caption_expr
from ..operators.images import turned_bytes
from ..operators.metrics import empty_splits
from ..sources import metadata as MD
from ..session import scratch_path
from . import sql_fragments as Q

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


NOUN = "item"


def enriched_caption(noun: str = NOUN):
    """PR-4 on M columns."""
    return caption_expr(noun)


# ---------------------------------------------------------------- scans, projections


@query("metadata_scan", with_(Q.M) + """
SELECT national_number, description, primary_type, secondary_type, classification FROM m""")
def metadata_scan(spark, sf_dir):
    """SC-1: M written as ``;`` CSV to the shared scratch folder, then scanned back."""
    m = B.metadata(spark, sf_dir).select(
        "national_number", "description", "primary_type", "secondary_type", "classification")
    path = scratch_path(spark, "metadata-csv")
    m.write.mode("overwrite").options(**MD._CSV_OPTIONS).option("sep", ";").option("maxRecordsPerFile", MD.CSV_FILE_ROWS).csv(path)
    return MD.read_metadata(spark, path, sep=";")


@query("canonical_ids", with_(Q.M, f"""z AS (SELECT doc_id, national_number, {Q.zfill('CAST(doc_id AS VARCHAR)')} AS padded FROM m),
f AS (SELECT bool_and(regexp_full_match(national_number, '-?\\d+')) AS mixed_int,
             bool_and(regexp_full_match(padded, '-?\\d+')) AS padded_int FROM z)""") + """
SELECT doc_id,
       CASE WHEN f.mixed_int THEN CAST(TRY_CAST(national_number AS BIGINT) AS VARCHAR) ELSE national_number END AS id_mixed,
       CASE WHEN f.padded_int THEN CAST(TRY_CAST(padded AS BIGINT) AS VARCHAR) ELSE padded END AS id_all_int
FROM z, f""")
def canonical_ids(spark, sf_dir):
    """SC-2: a suffixed (mixed) id column keeps its text; an all-integer one loses leading zeros."""
    m = B.unlabelled(spark, sf_dir).select("doc_id", "national_number")
    z = m.withColumn("padded", padded_id(F.col("doc_id").cast("string"), strict=False))
    z = MD.canonicalize_ids(z, "national_number", "id_mixed")
    z = MD.canonicalize_ids(z, "padded", "id_all_int")
    return z.select("doc_id", "id_mixed", "id_all_int")


@query("null_tokens", with_(Q.M) + """
SELECT doc_id,
       CASE WHEN primary_type IN ('', 'es', 'src3') THEN NULL ELSE primary_type END AS primary_type,
       CASE WHEN classification IN ('', 'es', 'src3') THEN NULL ELSE classification END AS classification
FROM m""")
def null_tokens_q(spark, sf_dir):
    m = B.unlabelled(spark, sf_dir).select("doc_id", "primary_type", "classification")
    return MD.apply_null_tokens(m, ["primary_type", "classification"], ["", "es", "src3"])


@query("clean_text", with_(Q.M) + f"""
SELECT doc_id,
       {Q.strip("coalesce(description, 'nan')")} AS description,
       {Q.cap("coalesce(primary_type, 'nan')")} AS primary_type,
       CASE WHEN secondary_type IS NOT NULL THEN {Q.cap('secondary_type')} END AS secondary_type,
       {Q.strip("coalesce(classification, 'nan')")} AS classification
FROM m""")
def clean_text(spark, sf_dir):
    """PR-5..7: strip / capitalize / missing-as-``nan`` with Python's exact semantics."""
    m = B.metadata(spark, sf_dir)
    return m.select(
        "doc_id",
        py_strip(py_str("description")).alias("description"),
        py_capitalize(py_str("primary_type")).alias("primary_type"),
        F.when(F.col("secondary_type").isNotNull(), py_capitalize("secondary_type")).alias("secondary_type"),
        py_strip(py_str("classification")).alias("classification"),
    )


@query("id_parts", with_(Q.M, Q.C) + f"""
SELECT national_number, base_id, padded_id, {Q.zfill('base_id')} AS zfill_id FROM c""")
def id_parts(spark, sf_dir):
    """PR-1/PR-2: base id, integer-padded id and text-padded id."""
    m = AS.asset_candidates(B.unlabelled(spark, sf_dir).select("national_number"))
    return m.select("national_number", "base_id", "padded_id",
                    padded_id("base_id", strict=False).alias("zfill_id"))


@query("asset_candidates", with_(Q.M, Q.C) + """
SELECT national_number, candidate1, candidate2 FROM c""")
def asset_candidates_q(spark, sf_dir):
    """PR-3: the two file names tried, in priority order."""
    m = AS.asset_candidates(B.unlabelled(spark, sf_dir).select("national_number"))
    return m.select("national_number", "candidate1", "candidate2")


_NAN = "'nan'"
_DESC = Q.strip(f"coalesce(description, {_NAN})")
_CLASS = Q.strip(f"coalesce(classification, {_NAN})")
_PRIM = Q.cap(f"coalesce(primary_type, {_NAN})")
_SEC = Q.cap("secondary_type")
CAPTION_SQL = (
    f"{_DESC} || ' This {NOUN} is classified as a ' || {_CLASS} || '. It is of ' || {_PRIM} || ' type'"
    f" || CASE WHEN secondary_type IS NOT NULL AND length(secondary_type) > 0"
    f" THEN ' and ' || {_SEC} || ' type' ELSE '' END"
)


@query("enriched_captions", with_(Q.M) + f"""
SELECT doc_id, {CAPTION_SQL} AS caption FROM m""")
def enriched_captions(spark, sf_dir):
    """PR-4/PR-8: the caption template with its optional second-type clause."""
    m = B.metadata(spark, sf_dir)
    return m.select("doc_id", enriched_caption().alias("caption"))


@query("samples", with_(Q.M, Q.A) + f"""
SELECT m.national_number, {CAPTION_SQL} AS caption, {Q.zfill("split_part(m.national_number, '_', 1)")} || '.png' AS asset_name,
       a.name IS NOT NULL AS found
FROM m LEFT JOIN a ON a.name = {Q.zfill("split_part(m.national_number, '_', 1)")} || '.png'""")
def samples(spark, sf_dir):
    """PR-13: what a loader yields per row: id, caption and the (strict) image file.

    Rows that would stop the loader are listed too, with ``found`` false.
    """
    m = B.metadata(spark, sf_dir).withColumn("caption", enriched_caption())
    s = AS.strict_lookup(m, B.manifest(spark, sf_dir), fail=False)
    return s.select("national_number", "caption", F.col("strict_name").alias("asset_name"), F.col("image_path").isNotNull().alias("found"))


# ---------------------------------------------------------------- lookups


def _resolved(spark, sf_dir, cols=("doc_id", "national_number")):
    m = B.unlabelled(spark, sf_dir).select(*cols)
    return AS.resolve_assets(m, B.manifest(spark, sf_dir))


@query("resolve_assets", with_(Q.M, Q.A, Q.C, Q.R) + """
SELECT national_number, asset_name, coalesce(match_rank, 0) AS match_rank FROM r""")
def resolve_assets_q(spark, sf_dir):
    """JN-1: priority lookup join (candidate 1, else candidate 2).

    ``match_rank`` is 1 or 2, and 0 when no file exists (the operator itself returns null there;
    the report uses 0 so the column stays a plain integer in every client).
    """
    r = _resolved(spark, sf_dir)
    return r.select("national_number", "asset_name", F.coalesce("match_rank", F.lit(0)).alias("match_rank"))


@query("resolved_rows", with_(Q.M, Q.A, Q.C, Q.R) + """
SELECT national_number FROM r WHERE match_rank IS NOT NULL""")
def resolved_rows_q(spark, sf_dir):
    return AS.resolved_rows(_resolved(spark, sf_dir)).select("national_number")


@query("missing_assets", with_(Q.M, Q.A, Q.C, Q.R) + """
SELECT national_number FROM r WHERE match_rank IS NULL""")
def missing_assets_q(spark, sf_dir):
    return AS.missing_assets(_resolved(spark, sf_dir)).select("national_number")


@query("strict_missing", with_(Q.M, Q.A, Q.C, Q.R) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_missing FROM r
WHERE match_rank IS NOT NULL
  AND {Q.zfill('base_id')} || '.png' NOT IN (SELECT name FROM a)""")
def strict_missing_q(spark, sf_dir):
    """JN-4: kept rows the strict loader would not find (violators counted, never empty)."""
    kept = AS.resolved_rows(_resolved(spark, sf_dir))
    bad = AS.strict_missing(kept, B.manifest(spark, sf_dir))
    return bad.agg(F.count(F.lit(1)).alias("n_missing"))


# ---------------------------------------------------------------- splits


def _split(spark, sf_dir, cols=("doc_id", "national_number")):
    m = B.metadata(spark, sf_dir) if "secondary_type" in cols else B.unlabelled(spark, sf_dir)
    return SP.three_way_split(m.select(*cols))


@query("three_way_split", with_(Q.M, Q.split_cte()) + """
SELECT national_number, split FROM s""")
def three_way_split_q(spark, sf_dir):
    """SP-1: exact-size seeded split of M (0.8 / 0.1 / 0.1, seed 42)."""
    return _split(spark, sf_dir).select("national_number", "split")


# Rows that repeat: a conversation is the id, none for every fifth one, and equal (id, role) rows are common.
_TURNS = """tr AS (SELECT CASE WHEN conv_id % 5 <> 0 THEN CAST(conv_id AS VARCHAR) END AS id, role FROM conversations)"""
_TURN_ROW = "md5(concat_ws(chr(31), coalesce(id, chr(0)), coalesce(role, chr(0))))"


def _turns(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 5 != 0, F.col("conv_id").cast("string")).alias("id"), "role")


@query("split_by_row", with_(_TURNS, f"""k AS (SELECT *, row_number() OVER (ORDER BY coalesce(md5('42:' || id), md5('42')), {_TURN_ROW}) AS pos, count(*) OVER () AS n FROM tr)""",
                             """z AS (SELECT *, ceil(CAST(0.1 AS DOUBLE) * n) AS nt FROM k)""",
                             """y AS (SELECT *, ceil((CAST(0.1 AS DOUBLE) / (1.0 - CAST(0.1 AS DOUBLE))) * (n - nt)) AS nv FROM z)""") + """
SELECT id, role, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'val' ELSE 'train' END AS split FROM y""")
def split_by_row(spark, sf_dir):
    """SP-1 over repeated and null ids: exact sizes by row; every turn of every conversation."""
    return SP.three_way_split(_turns(spark, sf_dir), id_col="id").select("id", "role", "split")


@query("split_sizes", with_(Q.M, Q.split_cte()) + """
SELECT split, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY split""")
def split_sizes_q(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("split_overlap", with_(Q.M, Q.split_cte(), """k AS (
  SELECT m.national_number, count(DISTINCT s.split) AS k
  FROM m LEFT JOIN s ON m.national_number = s.national_number GROUP BY m.national_number)""") + """
SELECT CAST(coalesce(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_overlap,
       CAST(coalesce(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_uncovered
FROM k""")
def split_overlap_q(spark, sf_dir):
    """ST-2: the three parts are disjoint and cover M (returns 0, 0)."""
    m = B.unlabelled(spark, sf_dir).select("national_number")
    s = _split(spark, sf_dir).select("national_number", "split")
    k = m.join(s, "national_number", "left").groupBy("national_number").agg(
        F.count_distinct("split").alias("k"))
    return k.agg(
        F.coalesce(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_overlap"),
        F.coalesce(F.sum(F.when(F.col("k") == 0, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_uncovered"),
    )


def _prepared(spark, sf_dir, k: int, cols=("doc_id", "national_number")):
    """Split -> resolve -> skip missing -> fan out (the preparation step as one lazy plan)."""
    s = _split(spark, sf_dir, cols)
    kept = AS.resolved_rows(AS.resolve_assets(s, B.manifest(spark, sf_dir)))
    return AU.fan_out(kept, k)


SPLIT_RESOLVED = [Q.M, Q.A, Q.split_cte(), Q.candidates("s"), Q.R]


@query("split_report", with_(*SPLIT_RESOLVED) + """
SELECT split, CAST(count(*) * 3 AS BIGINT) AS n FROM r WHERE match_rank IS NOT NULL GROUP BY split""")
def split_report_q(spark, sf_dir):
    """AG-5: rows per split after skips and a k=2 fan-out."""
    return _prepared(spark, sf_dir, 2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("empty_splits", with_(*SPLIT_RESOLVED, """e AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) t(split))""",
                            """n AS (SELECT split, count(*) AS n FROM r WHERE match_rank IS NOT NULL GROUP BY split)""") + """
SELECT CAST(count(*) AS BIGINT) AS n_empty FROM e LEFT JOIN n USING (split) WHERE coalesce(n.n, 0) = 0""")
def empty_splits_q(spark, sf_dir):
    """AG-7: splits left without any row (the reference raises; we count violators)."""
    return empty_splits(_prepared(spark, sf_dir, 0))


@query("augmented_rows", with_(*SPLIT_RESOLVED) + """
SELECT split,
       CASE WHEN t.aug_no = 0 THEN national_number ELSE padded_id || '_aug' || CAST(t.aug_no AS VARCHAR) END AS national_number,
       t.aug_no,
       CAST(t.aug_no AS DOUBLE) * 360.0 / 3.0 AS angle
FROM r, (VALUES (0), (1), (2)) t(aug_no)
WHERE match_rank IS NOT NULL""")
def augmented_rows_q(spark, sf_dir):
    """AU-1..3 / ST-1: originals plus k=2 rotations per kept row, all splits."""
    return _prepared(spark, sf_dir, 2).select("split", "national_number", "aug_no", "angle")


_ASSET_FILES = """af AS (
  SELECT DISTINCT split, CASE WHEN t.aug_no = 0 THEN asset_name ELSE padded_id || '_aug' || CAST(t.aug_no AS VARCHAR) || '.png' END AS name,
         asset_name AS source, CAST(t.aug_no AS DOUBLE) * 360.0 / 3.0 AS angle
  FROM r, (VALUES (0), (1), (2)) t(aug_no) WHERE match_rank IS NOT NULL)"""


@query("split_assets", with_(*SPLIT_RESOLVED, _ASSET_FILES) + """
SELECT DISTINCT split, name FROM af""")
def split_assets_q(spark, sf_dir):
    """SC-7/SC-8: distinct files per split folder with k=2 turned copies (a repeated copy overwrites)."""
    return MD.split_assets(_prepared(spark, sf_dir, 2)).select("split", "name")


_PIXEL = "substr(md5(f.source), 2 * CAST({} AS INTEGER) + 1, 2)"
_TURNED = """tn AS (
  SELECT split, name, source, angle, (SELECT string_agg(CASE CAST(f.angle AS INTEGER) // 90
           WHEN 0 THEN """ + _PIXEL.format("r * 4 + c") + """ WHEN 1 THEN """ + _PIXEL.format("c * 4 + 3 - r") + """
           WHEN 2 THEN """ + _PIXEL.format("(3 - r) * 4 + 3 - c") + """ ELSE """ + _PIXEL.format("(3 - c) * 4 + r") + """ END, '' ORDER BY r, c)
         FROM range(4) a(r), range(4) b(c)) AS content FROM f)"""


@query("split_assets_roundtrip", with_(*SPLIT_RESOLVED, _ASSET_FILES.replace("(2)", "(2), (3)").replace("360.0 / 3.0", "360.0 / 4.0"),
                                       "f AS (SELECT split, name, min(source) AS source, min(angle) AS angle FROM af GROUP BY split, name)", _TURNED) + """
SELECT split, name, angle, content, md5(content) AS digest, content = md5(source) AS as_original FROM tn""")
def split_assets_roundtrip(spark, sf_dir):
    """SC-7/SC-8 sink: files with their contents, turned copies among them, written per split to shared storage and read back.

    Binding: a sprite file holds a 4 x 4 one-byte raster, the MD5 of its name; k=3 copies are quarter turns.
    """
    names = B.manifest(spark, sf_dir)
    files = names.select("path", F.unhex(F.md5("name")).alias("content"))
    path = scratch_path(spark, "split-assets")
    turn = lambda content, angle: turned_bytes(content, angle, F.lit(4), F.lit(4), 1)
    MD.write_split_assets(MD.split_assets(_prepared(spark, sf_dir, 3)), files, path, turn=turn)
    back = spark.read.parquet(path)
    source = names.select("path", F.md5("name").alias("original"))
    text = F.lower(F.hex("content"))
    return back.join(source, "path").select("split", "name", "angle", text.alias("content"), F.md5(text).alias("digest"), (text == F.col("original")).alias("as_original"))


@query("split_sink_roundtrip", with_(Q.M, Q.split_cte()) + """
SELECT split, national_number FROM s""")
def split_sink_roundtrip(spark, sf_dir):
    """SC-6: per-split ``;`` CSV folders written to shared storage and read back."""
    s = _split(spark, sf_dir, cols=("national_number", "description", "primary_type",
                                    "secondary_type", "classification"))
    path = scratch_path(spark, "splits-csv")
    MD.write_splits(s, path, fmt="csv", sep=";")
    return MD.read_splits(spark, path, fmt="csv", sep=";").select("split", "national_number")


# ---------------------------------------------------------------- shuffles and batches

TRAIN_SHUFFLE = [Q.M, Q.split_cte(), """sh AS (
  SELECT e.epoch, s.national_number,
         row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42:' || CAST(e.epoch AS VARCHAR) || ':' || s.national_number)) AS pos
  FROM s, (VALUES (1), (2)) e(epoch) WHERE s.split = 'train')"""]


def _train_shuffle(spark, sf_dir, epochs=(1, 2)):
    train = _split(spark, sf_dir).where(F.col("split") == "train").select("national_number")
    return SP.epoch_shuffle(train, epochs)


@query("epoch_shuffle", with_(*TRAIN_SHUFFLE) + "SELECT epoch, national_number, pos FROM sh")
def epoch_shuffle_q(spark, sf_dir):
    """SP-4: the train loader's order for epochs 1 and 2."""
    return _train_shuffle(spark, sf_dir).select("epoch", "national_number", "pos")


@query("epoch_shuffle_by_row", with_(_TURNS, f"""o AS (SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY {_TURN_ROW}) - 1 AS no FROM tr)""") + """
SELECT e.epoch, id, role, row_number() OVER (
         PARTITION BY e.epoch ORDER BY md5('42:' || CAST(e.epoch AS VARCHAR) || coalesce(':' || id, '') || CASE WHEN no > 0 THEN '#' || CAST(no AS VARCHAR) ELSE '' END)) AS pos
FROM o, (VALUES (1), (2)) e(epoch)""")
def epoch_shuffle_by_row(spark, sf_dir):
    """SP-4 over repeated and null ids: every row once an epoch."""
    return SP.epoch_shuffle(_turns(spark, sf_dir), (1, 2), id_col="id").select("epoch", "id", "role", "pos")


@query("mini_batches", with_(*TRAIN_SHUFFLE) + """
SELECT epoch, CAST(floor((pos - 1) / 10) AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n,
       min(national_number) AS min_id, max(national_number) AS max_id
FROM sh GROUP BY ALL""")
def mini_batches_q(spark, sf_dir):
    """SP-5: batches of 10, last one short."""
    b = SP.mini_batches(_train_shuffle(spark, sf_dir), 10)
    return b.groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("national_number").alias("min_id"),
        F.max("national_number").alias("max_id"))


@query("head_batches", with_(*TRAIN_SHUFFLE) + """
SELECT national_number, CAST(floor((pos - 1) / 10) AS BIGINT) AS batch_id, pos <= 25 AS shown
FROM sh WHERE epoch = 1 AND floor((pos - 1) / 10) < 3""")
def head_batches_q(spark, sf_dir):
    """SP-6: whole batches until 25 rows are collected; the first 25 are shown."""
    b = SP.mini_batches(_train_shuffle(spark, sf_dir, epochs=(1,)), 10)
    return SP.head_batches(b, 25, 10).select("national_number", "batch_id", "shown")


# Register the other query families (they import ``query`` from this module).
from . import catalog_images, catalog_logs, catalog_text, catalog_vectors  # noqa: E402,F401
