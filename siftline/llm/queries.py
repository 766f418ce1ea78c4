"""The registered queries: one per operator, on whole tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, classifier, divergence, exact, lm, lz, minhash, mixing, negatives, quality_rules, sentences, suffix, token_counts


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = minhash.near_copies(_table(spark, folder, "documents"))
    return marked.select("*", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.mark_copies(_table(spark, folder, "documents"))


#: Pieces and scores of the token counts; a file of an installed package.
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents").select("doc_id", "text"), PIECE_FILE).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_tokens"
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("passed")).alias("kept"),
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix.drop_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(~lm.held_out()))
    return lm.score(docs, model).select(
        "doc_id", lm.held_out().alias("held_out"), "lm.n_tokens", "lm.n_known",
        F.lit(model.unigram[5]).cast("long").alias("train_tokens"), "lm.base_score", "lm.score",
    )


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


#: The vocabulary of the BPE query; a file of an installed package.
BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(_table(spark, folder, "documents").select("doc_id", "text"), BPE_FILE, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_lz_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = lz.drop_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = classifier.fit(docs, _table(spark, folder, "labels"), held_out=classifier.held_out())
    scored = classifier.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = sentences.encode(docs, PIECE_FILE, decoded="decoded")
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_source_mix": op7_source_mix,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_lz_substring_dedup": op9_lz_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CUTS = ", ".join(f"('{rule}', {cut})" for rule in quality_rules.RULES for cut in quality_rules.GRID[rule])

ORACLES = {
    "op2_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op1_minhash_near_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT min(doc_id) AS node, ws FROM d GROUP BY ws),
g AS (SELECT node, gram, count(*) AS n FROM (SELECT node, CASE WHEN len(ws) < 5 THEN ws ELSE ws[s:s + 4] END AS gram
  FROM t, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(s) WHERE len(ws) > 0) GROUP BY node, gram),
z AS (SELECT node, sum(n) AS size FROM g GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.node < b.node GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE common >= 0.8 * (x.size + y.size - common)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, label) AS (SELECT node, node FROM t UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.node WHERE r.label < s.b),
c AS (SELECT node, min(label) AS class_id FROM r GROUP BY node),
m AS (SELECT doc_id, class_id, c.node FROM d JOIN t USING (ws) JOIN c USING (node))
SELECT doc_id, class_id, count(*) OVER k AS class_size, (SELECT count(*) FROM c WHERE c.class_id = m.class_id) AS class_texts, doc_id = class_id AS kept
FROM m WINDOW k AS (PARTITION BY class_id)""",
    "op4_quality_rules": rf"""WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS t, {_WORDS} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k8 AS (SELECT doc_id, p AS s, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS k FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
win AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k8 WHERE k IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM win WHERE n > 1) GROUP BY doc_id),
m AS MATERIALIZED (SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines_per_line,
  coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats_per_word, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_per_letter FROM m),
long AS (UNPIVOT f ON symbols_per_word, dup_lines_per_line, repeats_per_word, upper_per_letter INTO NAME rule VALUE share),
k AS MATERIALIZED (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS k FROM long JOIN labels USING (doc_id) JOIN (VALUES {_CUTS}) AS c(rule, cutoff) USING (rule)
  WHERE quality = 1 GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * 0.02 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) END AS p FROM k),
safe AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p <= 0.05 / ({_CUTS.count('(')} * (SELECT count(DISTINCT stratum) FROM k)) GROUP BY stratum, rule),
bad AS (SELECT DISTINCT doc_id FROM long JOIN safe USING (stratum, rule) WHERE share > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m""",
    "op9_lz_substring_dedup": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS k FROM d, unnest(range(1, len(ws) - 48)) AS r(s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
j AS (SELECT w.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = w.p GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)""",
    "op12_source_divergence": rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '{divergence.TERM}') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS MATERIALIZED (SELECT row, lang, source, unnest(ts) AS t FROM d),
k AS MATERIALIZED (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
f AS MATERIALIZED (SELECT lang, source, t, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + 5 * terms) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
a AS (SELECT lang, t, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM f GROUP BY lang, t),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM f x JOIN f y USING (lang, t) WHERE x.lang = g.lang AND x.source = g.source AND y.source = h.source) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM f JOIN a USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op13_hard_negatives": """WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.row, p.k, p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.row, p.k ORDER BY s.score DESC, s.id) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.row = p.row AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
