"""One query per training-data operator, and DuckDB SQL where SQL can express it.

Each query applies its operator with production parameters to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import codes, decontaminate, jaccard, language, lines, mixing, neighbours, ranked, secrets, shards, spans, suffix, suffix_tree
from tessera.llm.common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (address: their source) and pages (address, suffix and markup), by one model."""
    docs, pages = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    model = language.fit(docs)
    of_docs = language.identify(docs.select("doc_id", "source", "text"), model, host=F.col("source"))
    of_pages = language.identify(
        pages.select("page_id", language.address_host(F.col("url")).alias("host"), language.markup_language(F.col("html")).alias("declared"),
                     language.markup_text(F.col("html")).alias("text")), model, host=F.col("host"), declared=F.col("declared"))
    verdict = ["lang", "posterior", "text_lang", "declared", "host", "rejected"]
    none = F.lit(None).cast("long")
    return of_docs.select(F.lit("documents").alias("kind"), F.col("own.doc_id").alias("doc_id"), none.alias("page_id"), *verdict).unionByName(
        of_pages.select(F.lit("pages").alias("kind"), none.alias("doc_id"), F.col("own.page_id").alias("page_id"), *verdict))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(load(spark, sf_dir, "documents")).drop("text_key", "group")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(load(spark, sf_dir, "documents"), report=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(load(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(load(spark, sf_dir, "documents"), report=True)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(load(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(load(spark, sf_dir, "documents"), report=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(load(spark, sf_dir, "embeddings")).drop("label")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "quality"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_neighbours": op3_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_ranked_search": op11_ranked_search,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}

_WORDS = r"list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"list_filter(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lloyd(rounds: int = 6) -> str:
    """Rounds of plain Lloyd, one materialized step each."""
    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d FROM x JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY vec_id, part)"""

    steps = []
    for k in range(rounds):
        steps += [assign(k), f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, CASE WHEN m.n IS NULL THEN b.v ELSE m.v END AS v FROM b{k} b LEFT JOIN (
    SELECT part, entry, place, count(*) AS n, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL) m
  USING (part, entry, place))"""]
    return ",\n".join([*steps, assign(rounds)])


ORACLE = {
    "op11_ranked_search": f"""
WITH dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
l AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY doc_id),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM dt WHERE term IN (SELECT term FROM q) GROUP BY term), c),
s AS (SELECT q.item_id, dt.doc_id, CAST(sum(q.times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * l.n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN dt USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
    "op12_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT doc_id, pos, line, r.key IS NOT NULL AND doc_id <> first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op13_vector_codes": f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT max(len(embedding)) // 8 AS w FROM e),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS place, v FROM (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM e), n),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM e) ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN f USING (vec_id)),
{_lloyd()},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b6),
s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN e USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN e USING (vec_id) JOIN s ON s.label IS NOT DISTINCT FROM e.label, h
""",
    "op1_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
lens AS (SELECT DISTINCT len(win) AS l FROM wins),
starts AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM docs, lens WHERE len(w) >= l),
hits AS (SELECT a.doc_id, a.i, a.l, b.item FROM (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS win FROM starts) a JOIN wins b USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op7_mixing": """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, lv.level * weight) AS target,
             CASE WHEN source_size > 0 THEN CAST(floor(least(cap, lv.level * weight) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM c, lv),
k AS (SELECT d.doc_id, d.size, t.*, -ln((CAST(('0x' || substr(md5('mix-1:' || d.doc_id || ':1'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
             / CASE WHEN q.quality = 1 THEN 2.0 WHEN q.quality = 0 THEN 0.5 ELSE 1.0 END AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON q.doc_id = d.doc_id),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             target - epochs * source_size AS budget FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2 <= budget AND budget > 0 AND epochs < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
""",
}
