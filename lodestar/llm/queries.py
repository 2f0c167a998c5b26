"""The numbered operators over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import audit, decontaminate, jaccard, lexical, line_runs, packing, repeats, sharding, suffixes, syncmers, token_counts, token_files, weak_labels
from lodestar.llm.scratch import Scratch

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = {i: 1.0 for i in range(8)}


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(table(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir), SHARDS, SHARDS | {8: 1.0})


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir), k=4, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir), tokenizer_path=WORD_TOKENIZER)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_blocks(table(spark, sf_dir), Scratch(spark, "op10"), WORD_TOKENIZER, end_id=2)
    return token_files.read_documents(blocks).withColumnRenamed("key", "doc_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without 200-byte strings that start in two places."""
    out = suffixes.remove_repeats(table(spark, sf_dir))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each filter in all 120 orders, for each source."""
    return audit.audit(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical.ranked(table(spark, sf_dir), table(spark, sf_dir, "benchmark"), Scratch(spark, "op13"))


def queries() -> dict:
    every = (op1_fingerprints, op2_sharding, op3_jaccard, op4_token_counts, op5_line_dedup, op6_decontaminate, op7_repeats, op8_quality, op9_packing, op10_token_files, op11_suffix_dedup, op12_filter_audit, op13_ranked_search)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard": OP3, "op5_line_dedup": OP5, "op6_decontaminate": OP6, "op7_repeats": OP7, "op12_filter_audit": OP12, "op13_ranked_search": OP13}


OP5 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (k) GROUP BY doc_id
"""

#: All alignments of an item with a document that agree in enough words, their windows of 13, and of these the one that agrees most, then the earliest.
OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
b AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM i),
h AS (SELECT doc_id, item_id, m, p - j AS shift, list(j) AS js FROM a JOIN b USING (word) GROUP BY doc_id, item_id, m, p - j HAVING count(*) >= least(m, 11)),
s AS (SELECT *, least(m, 13) AS width, unnest(generate_series(0, m - least(m, 13))) AS s FROM h),
c AS (SELECT doc_id, item_id, width, shift + s AS start, len(list_filter(js, lambda x: x >= s AND x < s + width)) AS agree FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, start) AS n FROM c WHERE agree >= CASE WHEN width < 13 THEN width ELSE 11 END)
SELECT doc_id, item_id, agree::INT AS agree, width::INT AS "window", start::INT AS start FROM r WHERE n = 1
"""

#: Windows of 35 words that start in two places or more; the words under them go.
OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM s SEMI JOIN r USING (k) CROSS JOIN generate_series(0, 34) t(j)),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(g.pos) AS n_removed, sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY d.doc_id
"""

#: Sets of 4-word shingles, links of 85 in 100, classes by least reachable doc_id; n_links counts the other sets that a set links with.
OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(md5(k), '' ORDER BY k)) AS s FROM h GROUP BY doc_id),
c AS (SELECT s, any_value(n) AS n, min(doc_id) AS rep FROM n GROUP BY s),
hr AS (SELECT c.rep, c.n, h.k FROM c JOIN h ON h.doc_id = c.rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM hr a JOIN hr b ON a.k = b.k AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a),
q AS (SELECT a AS rep, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(q.links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.s = n.s LEFT JOIN m ON m.rep = c.rep LEFT JOIN q ON q.rep = c.rep
"""

#: Failure masks of five filters, then every order of them; 120 over the number of failed filters is each one's share of all orders.
OP12 = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM o JOIN f ON NOT contains(filter_order, letter)),
s AS (SELECT filter_order, i::INT AS step, f.bit, (SELECT coalesce(sum(g.bit), 0)::INT FROM f g WHERE strpos(filter_order, g.letter) < i) AS gone
  FROM o CROSS JOIN generate_series(1, 5) x(i) JOIN f ON f.letter = substr(filter_order, i, 1) WHERE length(filter_order) = 5)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & gone <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c CROSS JOIN s GROUP BY part, filter_order, step
"""

#: Scores in 64-bit integers; // rounds down.
OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
