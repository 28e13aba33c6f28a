"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    alignment, audit, causal_lm, chat, forest, identifiers, packing, page_text, phrases, ranking, rules, simhash, units,
)
from packetloom.llm.common import fold, table
from packetloom.llm.text_stats import COUNTS


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = ranking.learn_from(docs, labels.where(~fold("doc_id", 4)))
    return ranking.score(docs, ranker).select(
        "doc_id", fold("doc_id", 4).alias("held_out"), "score",
        (F.col("score") >= ranking.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op5_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.repeats(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(chat.text_parts(rows))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
    )


def op7_causal_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return causal_lm.score(docs, ~fold("doc_id", 7)).select(
        "doc_id", fold("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn_from(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.find(table(spark, sf_dir, "documents"))

    def written(kind: str) -> F.Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["begin"], F.lit(":"), s["end"]))

    base = F.concat(*map(written, identifiers.KINDS))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in identifiers.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("found")), ",").alias("spans"),
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(flags, "ABCDE")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least ON x = doc_id
"""

OP4_SQL = r"""
WITH body AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'),
    '<[^>]*$', '') AS a FROM pages),
parts AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(a, '</?(p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
      regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM body)
SELECT page_id, url, array_to_string(list_transform(blocks, lambda x: regexp_replace(x, '&amp$', '&')), chr(10) || chr(10)) AS text,
  CAST(length(array_to_string(list_transform(blocks, lambda x: regexp_replace(x, '&amp$', '&')), chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM parts
"""

OP6_SQL = r"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
    + len(regexp_extract_all(text, '</?s>|<\||\[/?(INST|SYS|ROLE|SEP)\]'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
  FROM messages)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, m AS size, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS t(m)),
f AS (SELECT lang, phrase, size, count(*) AS n FROM phrases GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r,
    CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, sub AS phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM candidates WHERE size = 3)
  GROUP BY ALL),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
failing AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), words.doc_id > first] AS fails
  FROM words JOIN first USING (text) LEFT JOIN labels ON labels.doc_id = words.doc_id),
kinds AS (SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
told AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] AS fails,
    len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM kinds, steps),
counted AS (
  SELECT part, o, step, o[step] AS f,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

QUERIES = {
    f.__name__: f for f in (
        op1_quality_ranking, op2_near_duplicates, op3_packing, op4_page_text, op5_repeated_lines, op6_chat_format,
        op7_causal_lm, op8_quality_rules, op9_benchmark_leaks, op10_identifiers, op11_simhash, op12_collocations, op13_filter_audit,
    )
}
SQL = {
    "op2_near_duplicates": OP2_SQL, "op4_page_text": OP4_SQL, "op6_chat_format": OP6_SQL,
    "op12_collocations": OP12_SQL, "op13_filter_audit": OP13_SQL,
}
