"""The queries of the training-data operators over the given tables, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm import conversation_repair, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, mtree, packing, quality, substring_dedup, token_output, toxicity, winnowing
from salesflow.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, weight, copies, draw of every document: a whole corpus' budget, two passes at most."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), target_entropy=0.98, max_repeats=2.0, fill=True).drop("text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(rows), rows)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", noisy))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.compare(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_token_output": op9_token_output,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fingerprints": op13_fingerprints,
}

#: The 64 white-space-free ends of a line, and A-Z lower-cased, as DuckDB says them.
_KEY = r"translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0b\x0c\r]+', ''), '[ \t\n\x0b\x0c\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op2_jaccard_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * inter_n >= 75 * (x.n + y.n - inter_n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op3_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (SELECT doc_id, i, line, {_KEY} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT a.doc_id, a.i, a.line, coalesce(f.first_doc <> a.doc_id, false) AS dropped FROM keyed a LEFT JOIN firsts f ON a.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_exact_top_k": """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')),
scores AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1]::HUGEINT * p[2]::HUGEINT))::BIGINT AS score
  FROM vectors q JOIN vectors x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_conversation_repair": r"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS k FROM said, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS i FROM hashed WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), i) AS r, count(*) OVER (PARTITION BY conv_id) AS m FROM damaged),
marked AS (SELECT *, left(role, 1) AS kind, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS next_kind, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM placed),
steps AS (SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND cut AS INT) AS t,
  CASE kind WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL]::INT[] END AS keep FROM marked),
back(conv_id, r, c) AS (SELECT DISTINCT conv_id, m + 1, [0, 4, 2, 0] FROM steps UNION ALL
  SELECT conv_id, r, [least(g[1], 2 + least(g[3], 2 + g[4])), least(g[2], 2 + least(g[3], 2 + g[4])), least(g[3], 2 + g[4]), least(g[4], 2 + g[3])]
  FROM (SELECT b.conv_id, s.r, list_transform([1, 2, 3, 4], lambda x: least(3 + c[x], CASE WHEN gone THEN 1000000000 ELSE t + least(2 + c[CASE WHEN x = 3 THEN 4 ELSE 3 END], coalesce(c[keep[x] + 1], 1000000000)) END)) AS g
        FROM back b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.r = b.r - 1)),
walk(conv_id, r, st, audit, lines) AS (SELECT DISTINCT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM steps UNION ALL
  SELECT conv_id, CASE WHEN op = 'I' THEN r ELSE r + 1 END, CASE op WHEN 'D' THEN st WHEN 'K' THEN kept ELSE go END, audit || op,
    CASE op WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, named || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, named || ':' || text) END
  FROM (SELECT w.*, s.role, s.text, keep[st + 1] AS kept, CASE WHEN st = 2 THEN 3 ELSE 2 END AS go, CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END AS named,
          CASE WHEN s.r IS NOT NULL AND 3 + z.c[st + 1] = b.c[st + 1] THEN 'D' WHEN 2 + b.c[CASE WHEN st = 2 THEN 4 ELSE 3 END] = b.c[st + 1] THEN 'I' WHEN NOT gone AND t + z.c[keep[st + 1] + 1] = b.c[st + 1] THEN 'K' ELSE 'R' END AS op
        FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.r = w.r LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.r = w.r
        LEFT JOIN back z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.r = w.r + 1 WHERE NOT (s.r IS NULL AND st IN (0, 3)))),
ended AS (SELECT conv_id, audit, array_to_string(lines, chr(10)) AS repaired FROM walk w WHERE st IN (0, 3) AND r = (SELECT max(r) FROM back b WHERE b.conv_id IS NOT DISTINCT FROM w.conv_id)),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, sum(t) AS truncated,
  count(*) FILTER (WHERE next_kind IS NOT NULL AND kind || next_kind NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.r = 1 LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op12_hard_negatives": """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')),
scores AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1]::HUGEINT * p[2]::HUGEINT))::BIGINT AS score
  FROM vectors a JOIN vectors x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
