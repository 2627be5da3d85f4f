"""Queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import ann, bpe, chat, langid, lexical, mixing, near_dup, prefix_trie, quality, sharding, suffix_dedup, token_counts, webp
from .common import table


def _vocabulary() -> str:
    return public_tokenizers.path(bpe.VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), _vocabulary())
    # the histogram has a row per distinct length and is read twice
    return token_counts.suffix_sums(materialize(token_counts.length_histogram(lengths), "lengths"))


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.text_media(table(spark, sf_dir, "documents"))


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.expand(chat.with_probe(table(spark, sf_dir, "conversations"))))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length('<|im_start|>') + length('<|im_end|>') + 2 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS size FROM turns),
upto AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS chars FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR k = n) AS n_examples
FROM upto GROUP BY 1
"""


def op4_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op6_fair_queueing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT source, n, weight, 2 * n AS cap,
         1.5::DOUBLE * sum(n) OVER () AS everything,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight,
         coalesce(sum(2 * n) OVER before, 0) AS caps
  FROM by_source
  WINDOW before AS (ORDER BY 2 * n / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, (everything - caps) / left_weight AS share, cap <= (everything - caps) / left_weight * weight AS is_full FROM filling),
targets AS (
  SELECT source, CAST(n AS BIGINT) AS source_size,
         CASE WHEN is_full OR (SELECT count(*) FROM shares WHERE NOT is_full) = 0 THEN cap
              ELSE (SELECT arg_min(share, caps) FROM shares WHERE NOT is_full) * weight END AS target
  FROM shares),
rows AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, row_number() OVER () AS place,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mark, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT rows.*, epoch, CASE WHEN target > 0 THEN CAST(epoch * source_size + upto AS DOUBLE) / target END AS finish
  FROM rows, (VALUES (0), (1)) e(epoch)),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, doc_id NULLS FIRST, size, epoch ROWS UNBOUNDED PRECEDING) AS running FROM copies)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(any_value(size) * count(*) FILTER (WHERE target > 0 AND running <= (SELECT floor(sum(size) * 1.5::DOUBLE) FROM sized)) AS BIGINT) AS taken
FROM queue GROUP BY place
"""


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, quality.grades(table(spark, sf_dir, "labels"))))


def op8_bottom_k_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * c >= 85 * (an + bn - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least_ids AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept
FROM sets s LEFT JOIN least_ids l ON l.a = s.doc_id
"""


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return shuffled.select(
        "doc_id", size.cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", sharding.grown_shard(F.col("doc_id"), F.col("shard"), sharding.SHARDS).alias("grown_shard"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.with_borrowed_heads(prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations),
sizes AS (SELECT conv_id, max(k) AS n, conv_id - conv_id % 5 AS base, coalesce(CAST(conv_id AS VARCHAR), '') AS decimal_id FROM turns GROUP BY 1),
convs AS (
  SELECT conv_id, n, base, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(decimal_id) + 1), lambda i: CAST(ascii(decimal_id[i]) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h
  FROM sizes),
heads AS (SELECT c.conv_id, c.n, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS head FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT c.conv_id, t.k AS depth, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.base AND t.k <= c.head
  UNION ALL
  SELECT c.conv_id, t.k - c.h + c.head, t.role, t.text FROM heads c JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.k > c.h),
prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS n_bytes FROM heads
  UNION ALL
  SELECT conv_id, depth, string_agg(sha256(strlen(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), strlen(text) FROM rebuilt),
placed AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ending FROM prefixes),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256
  FROM placed GROUP BY 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT DISTINCT a.node AS top, b.node AS node FROM prefixes a JOIN prefixes b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT w.top AS node, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM below w JOIN nodes n ON n.node = w.node LEFT JOIN kids k ON k.node = w.node GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_words FROM words),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT place, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT place, doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY place, term),
weighted AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM held, totals GROUP BY term, n_docs),
parts AS (SELECT place, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))) AS part FROM held JOIN weighted USING (term), totals),
scored AS (SELECT item_id, place, any_value(doc_id) AS doc_id, CAST(sum(part) AS BIGINT) AS score FROM item_terms JOIN parts USING (term) GROUP BY item_id, place),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_lossless_webp, op3_prefix_targets, op4_multiprobe_lsh, op5_interval_expansion, op6_fair_queueing_mix, op7_ordinal_quality, op8_bottom_k_near_dup, op9_two_pass_shuffle, op10_byte_bpe, op11_prefix_trie, op12_language_id, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op3_prefix_targets": OP3_SQL, "op6_fair_queueing_mix": OP6_SQL, "op8_bottom_k_near_dup": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical_search": OP13_SQL}
