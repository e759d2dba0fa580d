"""Queries of the corpus operators over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import alignment_report
from .bpe import bpe_digest
from .common import read
from .exact_dedup import exact_dedup
from .html_text import page_text
from .mixing import mixing_plan
from .near_dup import near_duplicates
from .pieces import piece_digest
from .quotes import reply_ordered
from .repair import damaged, repair_report
from .suffix_dedup import suffix_dedup
from .token_counts import document_token_counts
from .topk import topk
from .toxicity import toxicity


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(read(spark, sf_dir, "documents")).drop("copies")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(read(spark, sf_dir, "conversations"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return document_token_counts(docs, vocabularies.path("piece_bpe_32k.model"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(read(spark, sf_dir, "pages"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read(spark, sf_dir, "conversations")))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return piece_digest(read(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return alignment_report(read(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, vocabularies.path("piece_bpe_32k.model"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
r AS (
  SELECT *, source_size * 2 AS most, source_size * 2 / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         sum(weight) OVER () AS all_weight FROM w),
c AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS cut, coalesce(sum(weight) OVER o, 0) AS cut_weight FROM r
  WINDOW o AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cut::DOUBLE) / (all_weight - cut_weight)::DOUBLE AS level FROM c),
t AS (
  SELECT source, source_size, least(most::DOUBLE,
         coalesce((SELECT max(level) FROM l) * weight, 0)) AS target FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
         ('0x' || md5('mix' || coalesce(source, ''))[1:5])::BIGINT / 1048576.0::DOUBLE AS first FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.step, row_number() OVER o - 1 AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
  WINDOW o AS (PARTITION BY d.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id)),
u AS (SELECT source, k, (first + k / 64.0::DOUBLE) % 1 AS shift FROM g, range(64) AS n(k)),
v AS (
  SELECT p.source, u.k, any_value(u.shift) AS shift, abs(sum(size * (floor((rank + 1) * step + shift) - floor(rank * step + shift))::BIGINT)::BIGINT - any_value(target)) AS off
  FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
c2 AS (SELECT source, shift FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT p.doc_id, p.size, p.source_size, p.target, p.size * (floor((rank + 1) * step + shift) - floor(rank * step + shift))::BIGINT AS taken
FROM p JOIN c2 ON p.source IS NOT DISTINCT FROM c2.source
"""

OP9_SQL = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, role, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM conversations, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
p AS (
  SELECT *, length(replace(replace(regexp_extract(line, '^([ \t]*>)+'), ' ', ''), chr(9), '')) AS level,
    regexp_replace(regexp_replace(translate(regexp_replace(line, '^([ \t]*>)+[ \t]?', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS passage
  FROM l),
q AS (SELECT * FROM p WHERE regexp_matches(passage, '[\p{L}\p{N}]') AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, passage, min(turn) AS origin FROM q WHERE level = 0 GROUP BY ALL),
v AS (
  SELECT q.conv_id, q.turn, q.level, o.origin, count(*) AS linked
  FROM q JOIN o USING (conv_id, passage) WHERE q.level > 0 AND o.origin < q.turn GROUP BY ALL),
b AS (
  SELECT conv_id, turn, origin AS parent_turn, linked FROM v
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, linked DESC, origin DESC) = 1),
up AS (
  SELECT conv_id, turn, parent_turn AS thread_turn FROM b
  UNION ALL
  SELECT up.conv_id, up.turn, b.parent_turn FROM up JOIN b ON b.conv_id = up.conv_id AND b.turn = up.thread_turn),
th AS (SELECT conv_id, turn, min(thread_turn) AS thread_turn FROM up GROUP BY ALL),
m AS (
  SELECT conv_id, turn, role, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^([ \t]*>)+'))) AS n_quoted,
    array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''),
      '(^|\n)(?:On [^\n]*[^ \t\r\n.!?:;][ \t\r]*\n)?[ \t]*(?:[^ \t\n>][^\n]*[ \t])?wrote:[ \t\r]*\n((?:[ \t\r]*\n)?[ \t]*>)', '\1\2', 'g'),
      chr(10)), lambda x: NOT regexp_matches(x, '^([ \t]*>)+')), chr(10)) AS text
  FROM conversations)
SELECT m.conv_id, coalesce(th.thread_turn, m.turn) AS thread_turn, m.turn, m.role, b.parent_turn, m.n_quoted::BIGINT AS n_quoted,
  coalesce(b.linked, 0)::BIGINT AS n_linked, m.text, '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || m.text AS chat
FROM m LEFT JOIN b ON m.conv_id = b.conv_id AND m.turn = b.turn LEFT JOIN th ON m.conv_id = th.conv_id AND m.turn = th.turn
"""

#: A state of the fold is written as ten digits of cost and then its audit, so that
#: the least string is the least pair.
def _sql_then(x: str, cost: str, letter: str) -> str:
    return f"(printf('%010d', {x}[1:10]::BIGINT + {cost}) || {x}[11:] || {letter})"


def _sql_put(x: str, role: str) -> str:
    return _sql_then(x, f"CASE WHEN i = '{role}' THEN cut ELSE cut + 2 END", f"CASE WHEN i = '{role}' THEN 'K' ELSE 'R' END")


_FAR = "'1000000000'"
_GONE = {k: _sql_then(k, "3", "'D'") for k in "esua"}
OP11_SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc FROM conversations),
h AS (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM raw),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k, role[1:1] AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d),
f AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before, bare = '' AS blank,
    bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup FROM o),
g AS (SELECT *, blank OR dup AS gone, CASE WHEN NOT blank AND NOT dup AND bare[-1:] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM f),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(dup)::BIGINT AS duplicate,
    sum(cut)::BIGINT AS truncated, count_if(before || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM g GROUP BY conv_id),
z AS (
  SELECT conv_id, 0::BIGINT AS k, '0000000000' AS e, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a FROM n
  UNION ALL
  SELECT conv_id, k, {_GONE['e']},
    CASE WHEN gone OR i <> 's' THEN {_GONE['s']} ELSE least({_GONE['s']}, {_sql_then('e', 'cut', "'K'")}) END,
    CASE WHEN gone THEN {_GONE['u']} ELSE least({_GONE['u']}, {_sql_put('least(e, s, a)', 'u')}) END,
    CASE WHEN gone THEN {_GONE['a']} ELSE least({_GONE['a']}, {_sql_put('u', 'a')}) END
  FROM (SELECT conv_id, k, i, gone, cut, e, s, u, least(a, {_sql_then('u', '2', "'I'")}) AS a
    FROM (SELECT z.conv_id, g.k, g.i, g.gone, g.cut, e, s, least(u, {_sql_then('e', '2', "'I'")}, {_sql_then('s', '2', "'I'")}, {_sql_then('a', '2', "'I'")}) AS u, a
      FROM z JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id AND g.k = z.k + 1))),
b AS (SELECT z.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal, least(e, a, {_sql_then('u', '2', "'I'")}, {_sql_then('s', '4', "'II'")}) AS best
  FROM z JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND n.n = z.k),
l AS (SELECT b.conv_id, j, best[10 + j] AS op, length(replace(best[11:10 + j], 'I', '')) AS row, length(replace(best[11:10 + j], 'D', '')) AS place
  FROM b, unnest(range(1, length(best) - 9)) AS t(j)),
w AS (SELECT l.*, g.role, g.text, max(CASE WHEN place = 1 AND op = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
  FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.k = l.row WHERE op <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - 1 + sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS said
  FROM w GROUP BY conv_id)
SELECT c.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal,
  coalesce(best[1:10]::BIGINT, 0) AS cost, coalesce(best[11:], '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op4_mixing": op4_mixing,
    "op9_quote_linking": op9_quote_linking,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_counts": op3_token_counts,
    "op8_html_text": op8_html_text,
    "op5_minhash": op5_minhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {
    "op1_exact_topk": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op9_quote_linking": OP9_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_conversation_repair": OP11_SQL,
}
