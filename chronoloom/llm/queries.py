"""The queries opN_<name> over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_index, line_rules, mixing, partenum, pseudo_likelihood, quotes, repeats, token_files, toxicity, url_rules
from .common import materialize, table


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op2_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


#: Target shares of the mixture; other sources share what is left.
MIX_WEIGHTS = {"src0": 0.25, "src1": 0.10}


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def page_labels(labels: DataFrame) -> DataFrame:
    """Labels of pages: those of the row with their number; unwanted if of low quality or toxic."""
    unwanted = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("page_id"), F.coalesce(unwanted, F.lit(False)).alias("unwanted"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = materialize(token_files.tokenise(table(spark, sf_dir, "documents")), "tokens")
    return token_files.count_tokens(blocks).select(F.col("name").cast("long").alias("doc_id"), "shard", "ordinal", "n_tokens")


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = partenum.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from windows of 400 bytes, and n_passage_words, from windows of 50 words."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=repeats.PASSAGE_WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), page_labels(table(spark, sf_dir, "labels")))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_rules.line_frequency_filter(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


QUERIES = {f.__name__: f for f in (op1_quote_threads, op2_fm_decontamination, op3_kneser_ney_toxicity, op4_poisson_mix, op5_pseudo_likelihood, op6_token_counts, op7_partenum_join, op8_suffix_dedup, op9_url_rules, op10_line_rules)}

_OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, size, array_to_string(ws[k : k + size - 1], ' ') AS gram
  FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS k, ws FROM w, sizes WHERE len(ws) >= size),
found AS (
  SELECT p.doc_id, p.k, p.size, g.item FROM (SELECT doc_id, size, k, array_to_string(ws[k : k + size - 1], ' ') AS gram FROM places) p
  JOIN grams g ON g.size = p.size AND g.gram = p.gram),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP4 = """
WITH n AS (SELECT coalesce(source, '') AS source_key, count(*) AS n FROM documents GROUP BY 1),
r AS (
  SELECT *, greatest(1, CAST(ceil(rate / 64.0) AS BIGINT)) AS parts FROM (
    SELECT source_key, CASE source_key WHEN 'src0' THEN 0.25 WHEN 'src1' THEN 0.1
      ELSE 0.65 / (SELECT count(*) FROM n WHERE source_key NOT IN ('src0', 'src1')) END * (SELECT sum(n) FROM n) / n AS rate FROM n)),
t AS (
  SELECT source_key, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdfs FROM (
    SELECT source_key, parts, k, sum(p) OVER (PARTITION BY source_key ORDER BY k) AS cdf
    FROM (SELECT source_key, parts, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, 201)) AS k) WHERE rate > 0))
  GROUP BY source_key),
u AS (
  SELECT d.*, parts, cdfs, '17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS seed
  FROM documents d JOIN t ON t.source_key = coalesce(d.source, '')),
draws AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM u),
c AS (
  SELECT doc_id, text, lang, source, n_chars, seed, CAST(sum(len(list_filter(cdfs, lambda x: x <= draw))) AS BIGINT) // count(DISTINCT r) AS n_copies, count(DISTINCT r) AS times
  FROM (SELECT *, ('0x' || substr(md5(seed || CASE part WHEN 1 THEN '' ELSE '|' || part END), 1, 12))::BIGINT / 281474976710656.0 AS draw FROM (SELECT *, row_number() OVER (PARTITION BY seed, lang, source, n_chars, part) AS r FROM draws))
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('order' || seed || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM c WHERE n_copies > 0), (SELECT unnest(range(1, 1001)) AS i) WHERE i <= times
"""

_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('h' || source, '') AS host,
    hash(doc_id, coalesce(text, ''), coalesce('h' || source, '')) AS k
  FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, k AS pos, array_to_string(ws[k : k + 7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT w.r, doc_id, host, k, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r),
lines AS (
  SELECT r, k, host, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, k, host, unnest(ls) AS l FROM w)),
hosts AS (SELECT host, count(DISTINCT k) AS docs FROM d GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT k) AS c FROM lines GROUP BY host, line) JOIN hosts USING (host) WHERE c > 20 AND c * 100.0 > docs * 2.0),
gone AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM lines JOIN often USING (host, line) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - coalesce(gone.n, 0)) >= 50 * n_words AS kept,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
FROM base LEFT JOIN gone USING (r)
"""

_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT r, doc_id, array_to_string(ws[k : k + 4], ' ') AS gram
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT r AS a, r AS b FROM w
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT a, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.b GROUP BY a) c ON c.a = w.r
"""

ORACLES = {"op7_partenum_join": _OP7, "op2_fm_decontamination": _OP2, "op4_poisson_mix": _OP4, "op10_line_rules": _OP10}
