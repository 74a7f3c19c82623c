"""DuckDB restatements of the table bindings, used by the oracle SQL of each query.

Each fragment is a CTE body; queries compose them with ``WITH``. They restate
``tessera.bindings`` in plain SQL so the oracle never shares code with the Spark side.
"""

# The blanks that the text rules strip, written out here a second time on purpose.
SPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def zfill(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '^[+-]') THEN substr({x}, 1, 1) || "
            f"lpad(substr({x}, 2), CAST(greatest(2, length({x}) - 1) AS INTEGER), '0') "
            f"ELSE lpad({x}, CAST(greatest(3, length({x})) AS INTEGER), '0') END)")


M = """m AS (
  SELECT d.doc_id,
         CAST(d.doc_id AS VARCHAR) || CASE WHEN d.doc_id % 7 = 0 THEN '_1' ELSE '' END AS national_number,
         d.text AS description,
         d.lang AS primary_type,
         CASE WHEN l.toxic = 1 THEN 'TOXIC' WHEN l.quality = 0 THEN 'low quality' END AS secondary_type,
         d.source AS classification
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

A = f"""a AS (
  SELECT CASE WHEN doc_id % 14 = 0 THEN CAST(doc_id AS VARCHAR) || '_1.png'
              WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) || '.png'
              ELSE {zfill('CAST(doc_id AS VARCHAR)')} || '.png' END AS name
  FROM labels)"""



def candidates(src: str = "m") -> str:
    """Candidate file names over the rows of ``src``."""
    return f"""c0 AS (
  SELECT {src}.*, split_part(national_number, '_', 1) AS base_id,
         TRY_CAST(split_part(national_number, '_', 1) AS BIGINT) AS base_int
  FROM {src}),
c AS (
  SELECT c0.* EXCLUDE (base_int),
         CASE WHEN base_int IS NOT NULL THEN printf('%03d', base_int) END AS padded_id,
         CASE WHEN base_int IS NOT NULL THEN
              CASE WHEN contains(national_number, '_') THEN national_number || '.png'
                   ELSE printf('%03d', base_int) || '.png' END END AS candidate1,
         CASE WHEN base_int IS NOT NULL THEN base_id || '.png' END AS candidate2
  FROM c0)"""


C = candidates("m")

# resolution over c and a
R = """r AS (
  SELECT c.*, coalesce(a1.name, a2.name) AS asset_name,
         CASE WHEN a1.name IS NOT NULL THEN 1 WHEN a2.name IS NOT NULL THEN 2 END AS match_rank
  FROM c LEFT JOIN a a1 ON c.candidate1 = a1.name LEFT JOIN a a2 ON c.candidate2 = a2.name)"""


def split_cte(src: str = "m", name: str = "s", seed: int = 42, val: float = 0.1, test: float = 0.1) -> str:
    return f"""{name}_0 AS (
  SELECT {src}.*, row_number() OVER (ORDER BY md5('{seed}:' || national_number)) AS _pos,
         count(*) OVER () AS _n FROM {src}),
{name}_1 AS (SELECT *, ceil(CAST({test} AS DOUBLE) * _n) AS _nt FROM {name}_0),
{name}_2 AS (SELECT *, ceil((CAST({val} AS DOUBLE) / (1.0 - CAST({test} AS DOUBLE))) * (_n - _nt)) AS _nv FROM {name}_1),
{name} AS (
  SELECT * EXCLUDE (_pos, _n, _nt, _nv),
         CASE WHEN _pos <= _nt THEN 'test' WHEN _pos <= _nt + _nv THEN 'val' ELSE 'train' END AS split
  FROM {name}_2)"""


# LOG: per-item losses
LOG = """log AS (
  SELECT event_type AS config,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
         CASE WHEN event_id % 4 = 0 THEN 'val' ELSE 'train' END AS split,
         user_id % 8 AS batch_id,
         value AS item_loss
  FROM events)"""

# LOGR: one validation loss per epoch
LOGR = """logr AS (
  SELECT event_type AS config,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS epoch,
         value AS val_loss
  FROM events)"""

# VEC: token-vector rows, exploded to (seq_id, vec_id, mask, dim, x)
VEC_LONG = """vl AS (
  SELECT label AS seq_id, vec_id,
         CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS mask,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""

PAIR_LONG = """pl AS (
  SELECT a.vec_id AS id_pred, b.vec_id AS id_truth, a.label AS label, a.dim, a.x AS p, b.x AS t
  FROM (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a
  JOIN (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
               CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) b
    ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim)"""

# IMG: raster bytes (vec_id, pos, b)
IMG_LONG = """il AS (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
         CAST(floor(greatest(0.0, least(1.0, (CAST(unnest(embedding) AS DOUBLE) + 1.0) / 2.0)) * 255.0) AS INTEGER) AS b
  FROM embeddings)"""



def caption_tokens(src: str) -> str:
    """Words and punctuation marks of the uncased ``caption`` of ``src``."""
    mark = r"!-/:-@\[-`{-~\p{P}"
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}]"
    plain = f"regexp_replace(strip_accents(lower(regexp_replace(caption, '{control}', '', 'g'))), '\\p{{Mn}}', '', 'g')"
    return f"""tok AS (
  SELECT doc_id, lang, regexp_extract_all({plain}, '[{mark}]|[^\\s\\p{{Z}}{mark}]+') AS words FROM {src})"""
