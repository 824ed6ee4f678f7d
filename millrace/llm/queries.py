"""The registered queries opN_<name> of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.ball_kmeans import ball_kmeans
from millrace.llm.chat_format import format_conversations, read_windows
from millrace.llm.decontaminate import find_contamination
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.language_id import held_out, identify_languages, learning_rows
from millrace.llm.lexical_search import search
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.near_dedup import near_groups
from millrace.llm.quality import graded, score_quality
from millrace.llm.repetition import repetition_rules
from millrace.llm.sentencepiece_codec import encoding_digest
from millrace.llm.token_counts import count_tokens
from millrace.llm.token_files import read_token_files, write_token_files
from millrace.storage import cut, new_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), carry=["doc_id"])


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(_documents(spark, sf_dir), path, BYTE_BPE)
    return read_token_files(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), BYTE_BPE)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir), new_folder(spark, "line-state"), text=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = score_quality(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    tails = [F.get("tails", F.lit(k)).alias(name) for k, name in enumerate(("p_not_toxic", "p_good"))]
    return scored.select("doc_id", "expected_grade", *tails, "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify_languages(docs.select("doc_id", "text"), learning_rows(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "fits")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*extra.columns).unionByName(extra)
    return read_windows(cut(format_conversations(turns, BYTE_BPE), "chat-windows"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_documents(spark, sf_dir))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_files": op3_token_files,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def _kmeans_sql(rounds: int = 3, k: int = 16) -> str:
    """Plain k-means: each round's assignment compares all pairs of vector and centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
            SELECT i, vec_id, x, min({{'d': list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS m
            FROM q, c{r} GROUP BY i, vec_id, x)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
            SELECT c, coalesce(means.y, c{r}.y) AS y FROM c{r} LEFT JOIN (
                SELECT c, list(floor(s / n)::BIGINT ORDER BY pos) AS y FROM (
                    SELECT m.c AS c, pos, sum(x[pos]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS p(pos) GROUP BY ALL) GROUP BY c) means USING (c))""")
    return f"""
        WITH q AS (
            SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        c0 AS (
            SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (
                SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM q ORDER BY h, x LIMIT {k})),
        {", ".join(steps)}
        SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia,
               sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON m.c = c"""



ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clustering": _kmeans_sql(),
    "op12_lexical_search": r"""
        WITH found AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        lengths AS (SELECT doc_id, len(words) AS n FROM found WHERE len(words) > 0),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM found) GROUP BY ALL),
        dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, total),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), total GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op11_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        base AS (
            SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM w),
        again AS (
            SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM lines
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup_lines AS (
            SELECT doc_id, count(*) AS n_dup_lines, sum(length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ''))) AS dup_line_chars
            FROM again WHERE dup GROUP BY doc_id),
        grams AS (
            SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS gram
            FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM w, unnest([3, 5, 6, 7, 8, 9, 10]) AS l(n))),
        found AS (
            SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, n, gram) AS times,
                   row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY pos) AS nth FROM grams),
        inside AS (
            SELECT DISTINCT doc_id, n, unnest(range(pos, pos + n)) AS pos FROM found WHERE times > 1 AND (nth > 1 OR n = 3)),
        sums AS (
            SELECT doc_id, n, count(*) AS n_in, sum(length(words[pos])) AS chars FROM inside JOIN w USING (doc_id) GROUP BY doc_id, n),
        cover AS (
            SELECT doc_id, max(n_in) FILTER (WHERE n = 3) AS n3, max(chars) FILTER (WHERE n = 5) AS c5, max(chars) FILTER (WHERE n = 6) AS c6,
                   max(chars) FILTER (WHERE n = 7) AS c7, max(chars) FILTER (WHERE n = 8) AS c8, max(chars) FILTER (WHERE n = 9) AS c9,
                   max(chars) FILTER (WHERE n = 10) AS c10 FROM sums GROUP BY doc_id),
        counts AS (
            SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words,
                   coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(c5, 0)::BIGINT AS dup_chars_5, coalesce(c6, 0)::BIGINT AS dup_chars_6,
                   coalesce(c7, 0)::BIGINT AS dup_chars_7, coalesce(c8, 0)::BIGINT AS dup_chars_8, coalesce(c9, 0)::BIGINT AS dup_chars_9,
                   coalesce(c10, 0)::BIGINT AS dup_chars_10
            FROM base LEFT JOIN dup_lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
        SELECT *, NOT base_failed AND 100 * dup_line_chars <= 20 * word_chars AND 100 * dup_chars_5 <= 15 * word_chars
            AND 100 * dup_chars_6 <= 14 * word_chars AND 100 * dup_chars_7 <= 13 * word_chars AND 100 * dup_chars_8 <= 12 * word_chars
            AND 100 * dup_chars_9 <= 11 * word_chars AND 100 * dup_chars_10 <= 10 * word_chars AS kept FROM judged""",
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS i, doc_id AS j FROM w UNION SELECT reach.i, link.v FROM reach JOIN link ON reach.j = link.u)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(j) AS component_id, min(j) = w.doc_id AS kept
        FROM w JOIN reach ON reach.i = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op6_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
        keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
