"""The operators applied, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm import secrets
from corpuseval.llm.conversation_trie import conversation_trie
from corpuseval.llm.decontaminate import find_leaks
from corpuseval.llm.jaccard_join import join_texts
from corpuseval.llm.language import predict_language
from corpuseval.llm.line_dedup import repeated_lines
from corpuseval.llm.lm_score import score_texts
from corpuseval.llm.packing import pack_documents
from corpuseval.llm.personal_data import find_personal_data
from corpuseval.llm.quality_rules import apply_rules
from corpuseval.llm.spelling import LOWER, UPPER, spelling_variants
from corpuseval.llm.token_counts import count_tokens
from corpuseval.llm.toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH cut AS (
    SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM (SELECT doc_id,
        regexp_extract_all(text, '[^\n.!?]*(?:[.!?]+[^\x20\x09-\x0D.!?][^\n.!?]*)*(?:[.!?]+|\n)?') AS pieces FROM documents)
), placed AS (
    SELECT doc_id, k, piece, length(rtrim(piece, chr(10))) AS length,
        coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM cut
), lines AS (
    SELECT doc_id, start, length, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit,
        trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain
    FROM placed WHERE regexp_matches(piece, '[^\x20\x09-\x0D]')
), ranked AS (
    SELECT *, length(plain) - length(replace(plain, ' ', '')) + 1 AS n_words,
        first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start, row_number() OVER w AS nth
    FROM lines WINDOW w AS (PARTITION BY plain ORDER BY doc_id, unit)
), runs AS (
    SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE nth > 1
), summed AS (
    SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM runs
)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length,
    CAST(n_words AS BIGINT) AS n_words, CAST(run_words AS BIGINT) AS run_words, first_doc_id, CAST(first_start AS INTEGER) AS first_start
FROM summed WHERE run_words >= 20
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_texts(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and verdicts; the query names a candidate by its digest only."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train_on(secrets.labelled_findings(docs)))
    return found.select("doc_id", "start", "length", F.sha2("text", 256).alias("digest"), "score", "is_secret")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 in SQL: the table of its 256 steps, and the checksum of the UTF-8 bytes of a text.
CRC_TABLE = """crc AS (
    SELECT list(v ORDER BY i) AS t
    FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i))
)"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({x})),
    lambda k: (instr('0123456789ABCDEF', substr(hex(encode({x})), 2 * k + 1, 1)) - 1) * 16
        + instr('0123456789ABCDEF', substr(hex(encode({x})), 2 * k + 2, 1)) - 1)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"""

OP12_SQL = f"""
WITH {CRC_TABLE}, turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY k) AS ids, list(length(text) ORDER BY k) AS sizes
    FROM turns GROUP BY conv_id
), shared AS (
    SELECT c.*, ({CRC.format(x="c.conv_id::VARCHAR")} % 6)::INT AS h, b.ids AS b_ids, b.sizes AS b_sizes
    FROM crc, convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), rebuilt AS (
    SELECT conv_id, list_concat(coalesce(b_ids[1:h], []), ids[h + 1:]) AS ids,
        list_concat(coalesce(b_sizes[1:h], []), sizes[h + 1:]) AS sizes
    FROM shared
), prefixes AS (
    SELECT conv_id, d, len(ids) = d AS ends, array_to_string(ids[1:d], ',') AS path, array_to_string(ids[1:d - 1], ',') AS above,
        CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
    FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, path, CASE WHEN d > 0 THEN any_value(above) END AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY d, path
), children AS (
    SELECT n.d, n.path, count(c.path) AS n_children
    FROM nodes n LEFT JOIN nodes c ON c.d = n.d + 1 AND c.above = n.path GROUP BY n.d, n.path
), below AS (
    SELECT n.d, n.path, count(*) FILTER (c.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens
    FROM nodes n JOIN nodes m ON m.d >= n.d AND (n.d = 0 OR m.path = n.path OR starts_with(m.path, n.path || ','))
        JOIN children c ON c.d = m.d AND c.path = m.path
    GROUP BY n.d, n.path
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN children c USING (d, path) JOIN below b USING (d, path) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.above
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
    SELECT id, run, count(*) AS times FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS id,
            translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
        FROM documents
    ) WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, times, {CRC.format(x="(id || ':' || run)")} AS h FROM runs, crc
), cut AS (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), holes AS (
    SELECT word, n, left(word, k - 1) AS head, substr(word, k + 1) AS tail
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS k FROM words)
), edits AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.head || h.tail
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.head || h.tail
), best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM edits GROUP BY word
), known AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
        CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root, form AS next FROM known
    UNION ALL SELECT c.word, k.word, k.form FROM chain c JOIN known k ON k.word = c.next
)
SELECT k.word, k.n, k.n_near, k.form, k.form_n, c.root FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_decontamination, op2_quality_rules, op3_lm_score, op4_line_dedup, op5_jaccard_join,
        op6_toxicity, op7_language, op8_token_counts, op9_secret_scan, op10_best_fit_packing,
        op11_personal_data, op12_conversation_trie, op13_spelling_variants,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others learn from labels, use a vocabulary file or are too slow as SQL; tests compare them with brute force."""
    return {"op4_line_dedup": OP4_SQL, "op12_conversation_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL}
