"""The corpus queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.llm import language, licenses, mixing, neardup, packing, pii, quality, runs, spelling, tiff, token_counts, token_files, warc
from loomgrain.llm.common import WORD, table, written

#: For the registered query; a deployment passes its own to pii.with_surrogates().
PII_KEY = b"loomgrain example key"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(spark, table(spark, sf_dir, "pages"), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_model(docs))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = pii.with_surrogates(table(spark, sf_dir, "documents"), PII_KEY)
    return safe.select("doc_id", "text", F.size("__entities").alias("n_entities"), F.to_json("__entities").alias("entities"))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents")).drop("error")


def with_repeats(docs: DataFrame) -> DataFrame:
    """Of every tenth document, by the CRC-32 of its id, the words from one on become repeats of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n = F.nullif(F.size("w"), F.lit(0))
    w = w.select("*", (F.col("g") % n).cast("int").alias("a")).withColumn("rest", n - F.col("a"))
    w = w.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    often = F.ceil(F.col("rest") / F.col("p")).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), often)), F.lit(1), F.col("rest"))
    return w.select("doc_id", F.when(F.size("w") > 0, F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), rest)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
    length, period = F.col("b.length"), -F.col("b.period")
    return d.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = written(spelling.word_counts(table(spark, sf_dir, "documents"), misspell=97), "vocabulary")
    return spelling.variant_groups(vocabulary)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_license_scan": op8_license_scan,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_tiff_media": op10_tiff_media,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}

_BOILERPLATE = " OR ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for p in quality.BOILERPLATE)
_LINE_END = quality.LINE_END.replace("'", "''")
QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(x, '[|»·]')) AS seps,
                 length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT doc_id, unnest(l) AS x FROM w)),
judged AS (SELECT doc_id, chars,
                  len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 >= length(x) OR len(regexp_extract_all(x, '[!?]{{2,}}')) * 2 >= words
                  OR (seps >= 3 AND seps * 4 >= words) OR (words < 5 AND NOT regexp_matches(x, '{_LINE_END}')) OR len(regexp_extract_all(lower(x), 'https?://|www\.')) * 2 >= words
                  OR (words <= {quality.FURNITURE_WORDS} AND ({_BOILERPLATE})) OR contains(x, '{{') OR contains(x, '}}') AS fails FROM lines),
good AS (SELECT doc_id, count(*) FILTER (WHERE fails) AS removed, coalesce(sum(chars) FILTER (WHERE NOT fails), 0) AS stays FROM judged GROUP BY 1),
base AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                coalesce(cover.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, coalesce(removed, 0) AS n_lines_removed, coalesce(stays, 0) AS stays
         FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN good USING (doc_id)),
told AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                CASE WHEN word_chars > 0 THEN 1 - CAST(stays AS DOUBLE) / word_chars ELSE 0.0 END AS lost FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed, CAST(lost AS DOUBLE) AS lost,
       NOT base_failed AND lost <= 0.5 AS kept FROM told"""

_TEMPLATES = ", ".join(f"('{label}', {words!r})" for label, words in licenses.template_sets())
_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM spots WHERE " + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase)) for phrase, label in licenses.PHRASES.items()
)
LICENSE_SQL = rf"""
WITH w AS (SELECT doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
hits AS ({_PHRASES}),
per AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM hits GROUP BY 1),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS x FROM w)),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) t(label, ws)),
found AS (SELECT doc_id, label, len(list_intersect(b, ws)) / len(ws) AS score FROM blocks, templates WHERE len(list_intersect(b, ws)) >= ceil(0.8 * len(ws) - 1e-9)),
best AS (SELECT doc_id, max(score) AS score FROM found GROUP BY 1),
based AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM hits) GROUP BY 1),
alls AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM found) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN based USING (doc_id) LEFT JOIN alls USING (doc_id)"""

#: CRC-32 by bits: the table holds, for each byte, eight steps of the polynomial.
SPELLING_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
occ AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
cnt AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS n FROM occ WHERE length(w) >= 5 GROUP BY 1, 2),
byt AS (SELECT w, n, flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) AS BIGINT) - 64] END)) AS b FROM cnt),
crc AS (SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM byt, tab),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
voc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, v.word, v.n FROM cut c JOIN voc v ON v.word = c.rest UNION SELECT v.word, c.word, c.n FROM cut c JOIN voc v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY 1),
form AS (SELECT word, min(other) AS form FROM near JOIN best USING (word) WHERE other_n = top GROUP BY 1),
told AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN form END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM voc v LEFT JOIN best USING (word) LEFT JOIN form USING (word)),
way(word, stop) AS (SELECT word, word FROM told UNION ALL SELECT way.word, form FROM way JOIN told ON told.word = way.stop WHERE form IS NOT NULL)
SELECT told.word, form, stop AS root, n, n_near, form_n FROM told JOIN way ON way.word = told.word JOIN (SELECT word AS stop FROM told WHERE form IS NULL) USING (stop)"""

ORACLE_SQL: dict[str, str] = {"op5_quality_rules": QUALITY_SQL, "op8_license_scan": LICENSE_SQL, "op13_spelling_variants": SPELLING_SQL}
