"""Queries over caption tokens (TX-1..3): the enriched caption of every row of M."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import samples as SM
from ..operators import tokens as TK
from ..operators.captions import type_suffix
from ..session import stored
from . import sql_fragments as Q
from .catalog import _PRIM, _SEC, CAPTION_SQL, enriched_caption, query, with_

CAP = [Q.M, f"""cap AS (SELECT doc_id, primary_type AS lang, {CAPTION_SQL} AS caption FROM m)""", Q.caption_tokens("cap")]
VOCAB = [*CAP, """w AS (SELECT doc_id, unnest(words) AS word FROM tok)""",
         """wc AS (SELECT word, count(*) AS n FROM w GROUP BY word)""",
         """ch AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM wc)""",
         """vocab AS (
  SELECT token, CAST(999 + row_number() OVER (ORDER BY encode(token)) AS INTEGER) AS id FROM (
    SELECT word AS token FROM wc WHERE n >= 1e-4 * (SELECT sum(n) FROM wc)
    UNION SELECT c FROM ch WHERE c <> '' UNION SELECT '##' || c FROM ch WHERE c <> '' UNION SELECT '[UNK]'))"""]
# Longest entry from the left, one step of all distinct words at a time.
PIECES = [*VOCAB, """enc AS (
  SELECT word, 1 AS beg, CAST([] AS INTEGER[]) AS ids FROM wc WHERE length(word) <= 100
  UNION ALL
  SELECT word, beg, ids FROM (
    SELECT e.word, e.beg + l.l AS beg, list_append(e.ids, v.id) AS ids,
           row_number() OVER (PARTITION BY e.word ORDER BY l.l DESC) AS r
    FROM (SELECT word, beg, ids, unnest(range(1, CAST(length(word) - beg + 2 AS BIGINT))) AS l FROM enc WHERE beg <= length(word)) e(word, beg, ids, l0),
         LATERAL (SELECT e.l0 AS l) l
    JOIN vocab v ON v.token = CASE WHEN e.beg > 1 THEN '##' ELSE '' END || substr(e.word, e.beg, l.l)) WHERE r = 1)""",
          """sp AS (SELECT wc.word, coalesce(e.ids, [(SELECT id FROM vocab WHERE token = '[UNK]')]) AS ids
  FROM wc LEFT JOIN (SELECT * FROM enc WHERE beg = length(word) + 1) e ON e.word = wc.word)""",
          """pos AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM tok)""",
          """ids AS (SELECT tok.doc_id, tok.lang, coalesce(a.ids, CAST([] AS INTEGER[])) AS ids FROM tok
  LEFT JOIN (SELECT doc_id, flatten(list(sp.ids ORDER BY p)) AS ids FROM pos JOIN sp USING (word) GROUP BY doc_id) a USING (doc_id))"""]


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _captions(spark, sf_dir):
    m = B.metadata(spark, sf_dir)
    m = m.select("doc_id", F.col("primary_type").alias("lang"), enriched_caption().alias("caption"))
    return m.select("doc_id", "lang", TK.split_words("caption").alias("words"))


def _vocabulary(captions):
    """A vocabulary of the captions themselves."""
    return TK.corpus_vocabulary(TK.exploded_words(captions, []).select("word"))


def _encoded(spark, sf_dir):
    """Subword ids of every caption, by a vocabulary of the corpus itself; texts are cut once."""
    caps = stored(_captions(spark, sf_dir), "caption-words")
    return TK.encode(caps, _vocabulary(caps))


@query("caption_words", with_(*CAP) + """
SELECT doc_id, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS word FROM tok""")
def caption_words(spark, sf_dir):
    """Word stage of TX-1: every word and punctuation mark of every caption with its position."""
    return TK.exploded_words(_captions(spark, sf_dir), ["doc_id"])


@query("pad_truncate", with_(*CAP, """ids AS (
  SELECT doc_id, list_concat([101], list_slice(list_transform(words, lambda w: CAST(length(w) AS INTEGER)), 1, 254), [102]) AS seq
  FROM tok)""") + """
SELECT doc_id,
       array_to_string(list_concat(seq, list_transform(range(256 - len(seq)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(seq, lambda x: 1), list_transform(range(256 - len(seq)), lambda x: 0)), ',') AS attention_mask,
       CAST(len(seq) AS INTEGER) AS n_valid
FROM ids""")
def pad_truncate(spark, sf_dir):
    """TX-2: fixed 256-long encoding (start, 254 ids, end, padding) and mask; word id = word length."""
    w = _captions(spark, sf_dir)
    ids, mask, n = TK.pad_truncate(F.transform("words", lambda x: F.length(x)))
    return w.select("doc_id", F.array_join(ids, ",").alias("input_ids"), F.array_join(mask, ",").alias("attention_mask"), n.alias("n_valid"))


@query("truncation_report", with_recursive(*PIECES) + """
SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN len(ids) > 254 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
       CAST(sum(greatest(len(ids) - 254, 0)) AS BIGINT) AS n_lost_tokens
FROM ids GROUP BY lang""")
def truncation_report(spark, sf_dir):
    """TX-3: captions per language whose subword tokens exceed the 254-token budget, and their loss."""
    return TK.truncation_report(_encoded(spark, sf_dir).select("lang", F.size("ids").alias("n_tokens")), "lang", "n_tokens", 254)


@query("wordpiece_ids", with_recursive(*PIECES) + """
SELECT doc_id, array_to_string(list_concat(seq, list_transform(range(256 - len(seq)), lambda x: 0)), ',') AS input_ids,
       CAST(n AS INTEGER) AS n_tokens, CAST(len(seq) AS INTEGER) AS n_valid
FROM (SELECT doc_id, len(ids) AS n, list_concat([101], list_slice(ids, 1, 254), [102]) AS seq FROM ids)""")
def wordpiece_ids(spark, sf_dir):
    """TX-1 + TX-2: longest-match subword ids of every caption in the fixed 256-long encoding."""
    e = _encoded(spark, sf_dir)
    ids, _, n = TK.pad_truncate("ids")
    return e.select("doc_id", F.array_join(ids, ",").alias("input_ids"), F.size("ids").alias("n_tokens"), n.alias("n_valid"))


# Segments are cut from the caption as it is; a word's pieces take their lengths from the vocabulary.
_MARK = r"!-/:-@\[-`{-~\p{P}"
_BLANK = r"\t\n\r\p{Z}"
ENDS = [*PIECES, f"""cp AS (SELECT doc_id, {CAPTION_SQL} AS caption, length('It is of ' || {_PRIM} || ' type' || CASE WHEN secondary_type IS NOT NULL AND length(secondary_type) > 0
    THEN ' and ' || {_SEC} || ' type' ELSE '' END) AS suffix FROM m)""",
        f"""sg AS (SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS p FROM (
  SELECT doc_id, regexp_extract_all(caption, '[{_MARK}]|[^{_BLANK}{_MARK}]+|[{_BLANK}]+') AS segs FROM cp))""",
        rf"""sw AS (SELECT doc_id, p, sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY p) AS stop, length(seg) AS size,
         regexp_replace(strip_accents(lower(regexp_replace(seg, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}]', '', 'g'))), '\p{{Mn}}|[{_BLANK}]', '', 'g') AS word FROM sg)""",
        """tk AS (SELECT doc_id, p, stop, size, unnest(sp.ids) AS id, generate_subscripts(sp.ids, 1) AS j, len(sp.ids) AS k FROM sw JOIN sp USING (word))""",
        """tl AS (SELECT tk.*, CASE WHEN v.token = '[UNK]' THEN size WHEN j > 1 THEN length(v.token) - 2 ELSE length(v.token) END AS l FROM tk JOIN vocab v USING (id))""",
        """te AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, j) AS t,
         CASE WHEN j = k THEN stop ELSE least(stop, stop - size + sum(l) OVER (PARTITION BY doc_id, p ORDER BY j)) END AS e FROM tl)""",
        """tn AS (SELECT doc_id, count(*) AS n, max(CASE WHEN t = 254 THEN e END) AS cut FROM te GROUP BY doc_id)"""]


@query("lost_suffixes", with_recursive(*ENDS) + """
SELECT doc_id, n_tokens, kept_chars, suffix_start, CASE WHEN kept_chars >= len THEN 'whole' WHEN kept_chars > suffix_start THEN 'part' ELSE 'none' END AS suffix
FROM (SELECT cp.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, length(caption) AS len, CAST(length(caption) - cp.suffix AS INTEGER) AS suffix_start,
             CAST(CASE WHEN coalesce(n, 0) <= 254 THEN length(caption) ELSE cut END AS INTEGER) AS kept_chars FROM cp LEFT JOIN tn USING (doc_id))""")
def lost_suffixes(spark, sf_dir):
    """TX-3: where each caption is cut by the 254-token budget, and what is left of its type suffix."""
    m = B.metadata(spark, sf_dir).select("doc_id", enriched_caption().alias("caption"), type_suffix().alias("types"))
    vocab = _vocabulary(m.select(TK.split_words("caption").alias("words")))
    # Only lengths and segments go through the encoder.
    cut = m.select("doc_id", F.char_length("caption").alias("chars"), F.char_length("types").alias("type_chars"), TK.segments("caption").alias("segments"))
    coded = TK.encode(cut, vocab, words_col="segments", ends=True)
    return TK.lost_suffix(coded, "type_chars", "chars").select("doc_id", "n_tokens", "kept_chars", "suffix_start", "suffix")


_STRICT = f"{Q.zfill('split_part(m.national_number, {0}, 1)')}".replace("{0}", "'_'")


@query("sample_rows", with_recursive(*PIECES, Q.A, f"""cp AS (SELECT doc_id, national_number, {CAPTION_SQL} AS caption FROM m)""",
                                     """sq AS (SELECT doc_id, list_concat([101], list_slice(ids, 1, 254), [102]) AS seq FROM ids)""") + f"""
SELECT m.national_number, cp.caption, array_to_string(list_concat(seq, list_transform(range(256 - len(seq)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(list_transform(seq, lambda x: 1), list_transform(range(256 - len(seq)), lambda x: 0)), ',') AS attention_mask,
       CASE WHEN a.name IS NOT NULL THEN 'sprites/' || a.name END AS image_path
FROM m JOIN cp USING (doc_id) JOIN sq USING (doc_id) LEFT JOIN a ON a.name = {_STRICT} || '.png'""")
def sample_rows(spark, sf_dir):
    """PR-13: ids, mask, caption and image file of every row; rows that would stop the loader have no file."""
    m = B.metadata(spark, sf_dir).select("national_number", enriched_caption().alias("caption"))
    vocab = _vocabulary(m.select(TK.split_words("caption").alias("words")))
    s = SM.samples(m, B.manifest(spark, sf_dir), vocab, fail=False)
    return s.select("national_number", "caption", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"), "image_path")
