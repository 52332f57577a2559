"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import chat, hd_language, line_rules, mixing, near_duplicates, packing, quality_model, suffix_model, text, token_files, vector_index
from loomwork.session import read_table, scratch_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("turn") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn")).select("conv_id", "turn", role.alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(added)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.draw(read_table(spark, sf_dir, "documents")).documents
    return rows.select("doc_id", "size", "source_size", "target", "taken", "quota_blocks", "block_words", "first_shard", "last_shard")


#: Every quotient of the contest is written out and ranked, for all block counts of the production parameters.
OP2_SQL = r"""
WITH sized AS (
  SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((number - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS lim FROM sources),
shared AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER before, 0))
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0)) AS share,
         sum(source_size) OVER () AS words
  FROM weighed
  WINDOW before AS (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, share * weight >= lim AS capped,
         CASE WHEN share * weight >= lim THEN lim
              ELSE weight * (SELECT arg_min(share, (lim / weight, number)) FROM shared WHERE NOT share * weight >= lim) END AS target,
         greatest(ceil(words / 4194304), 1)::BIGINT AS block_words
  FROM shared),
house AS (
  SELECT coalesce(round(sum(target) FILTER (NOT capped) / any_value(block_words)), 0)::BIGINT AS h,
         coalesce(sum(target) FILTER (NOT capped), 1) AS t
  FROM targets),
quotients AS (
  SELECT number, unnest(range(1, (target * h / t)::BIGINT + 3)) AS seat, target FROM targets, house WHERE NOT capped AND target > 0),
places AS (
  SELECT number, row_number() OVER (PARTITION BY number ORDER BY target / (2 * seat - 1) DESC, seat) AS nth,
         row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, number, seat) AS place
  FROM quotients),
capped_seats AS (
  SELECT number, unnest(range(1, (3 * ceil(source_size / block_words))::BIGINT + 1)) AS nth, 3 * ceil(source_size / block_words) AS n
  FROM targets WHERE capped),
-- the shard of each block: the first whose share of all blocks reaches it
blocks AS (
  SELECT number, nth, (SELECT min(s) FROM range(1, 65) r(s) WHERE h * s // 64 >= place) AS shard FROM places, house WHERE place <= h
  UNION ALL
  SELECT number, nth, (SELECT min(s) FROM range(1, 65) r(s) WHERE floor(n * s / 64) >= nth) FROM capped_seats),
won AS (SELECT number, count(*) AS won FROM blocks GROUP BY number),
quota AS (
  SELECT t.*, ceil(source_size / block_words)::BIGINT AS n_blocks,
         least(coalesce(won, 0), 3 * ceil(source_size / block_words))::BIGINT AS quota_blocks
  FROM targets t LEFT JOIN won USING (number)),
laid AS (
  SELECT q.number, s.doc_id, s.size, q.source_size, q.target, q.quota_blocks, q.block_words, q.n_blocks,
         q.quota_blocks // greatest(q.n_blocks, 1) AS passes,
         least(q.quota_blocks % greatest(q.n_blocks, 1) * q.block_words, q.source_size) AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
drawn AS (
  SELECT *, least(greatest(rest - start, 0), size)::BIGINT AS part FROM laid),
ends AS (
  SELECT *, passes * size + part AS taken, start // block_words + 1 AS first_nth,
         CASE WHEN part > 0 THEN passes * n_blocks + (start + part - 1) // block_words
              ELSE (passes - 1) * n_blocks + (start + size - 1) // block_words END + 1 AS last_nth
  FROM drawn)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, quota_blocks, block_words,
       CASE WHEN taken > 0 THEN a.shard END::INTEGER AS first_shard, CASE WHEN taken > 0 THEN b.shard END::INTEGER AS last_shard
FROM ends e LEFT JOIN blocks a ON a.number = e.number AND a.nth = e.first_nth LEFT JOIN blocks b ON b.number = e.number AND b.nth = e.last_nth
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.search(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op5_suffix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = suffix_model.score(docs, docs.filter(text.remainder(F.col("doc_id"), 7) != 2))
    return rows.withColumn("held_out", F.coalesce(text.remainder(F.col("doc_id"), 7) == 2, F.lit(False)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(read_table(spark, sf_dir, "documents"), path)
    return token_files.digests(spark, path)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.judged(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


OP9_SQL = r"""
WITH body AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS parts FROM body),
windows AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
raw AS (SELECT r, host, i, parts[i] AS line FROM (SELECT r, host, parts, unnest(range(1, len(parts) + 1)) AS i FROM w)),
lines AS (
  SELECT r, host, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(lower(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), '[0-9]+', '0', 'g'), ' +', ' ', 'g')) AS k
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
whole AS (SELECT r, md5(string_agg(k, chr(10) ORDER BY i)) AS id FROM lines GROUP BY r),
common AS (SELECT host, k FROM lines JOIN whole USING (r) GROUP BY host, k HAVING count(DISTINCT id) > 20),
removed AS (
  SELECT r, sum(n) AS n FROM lines l JOIN common c ON l.k = c.k AND l.host IS NOT DISTINCT FROM c.host GROUP BY r),
stats AS (
  SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dups d USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN removed x USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept
FROM base
"""

def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    left = text.remainder(F.col("doc_id"), 4)
    languages, prototypes = hd_language.learn(docs.filter(left != 2))
    held_out = F.coalesce(left == 2, F.lit(False)).alias("held_out")
    return hd_language.predict(docs.select("doc_id", "text"), languages, prototypes).select("doc_id", held_out, "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(text.remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_vector_search": op4_vector_search,
    "op5_suffix_scores": op5_suffix_scores,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_token_files": op8_token_files,
    "op9_line_rules": op9_line_rules,
    "op10_quality": op10_quality,
}

SQL = {"op2_mixing": OP2_SQL, "op9_line_rules": OP9_SQL}
