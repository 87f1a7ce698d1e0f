"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import byte_bpe, chat, exact_dedup, packing, quality, simhash, substring_dedup, suffix_array, token_shards, toxicity
from tablemill.llm.common import cut, read_table, scratch


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("text", "rejected_by")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir), keep="largest").drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = cut(simhash.with_fingerprints(documents(spark, sf_dir), "fp").select("doc_id", "fp"))
    return simhash.with_components(marked).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True).drop("text")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    written = cut(token_shards.write_shards(documents(spark, sf_dir), path, tokenizer("word_bpe_49k.json")))
    return token_shards.read_index(spark, written, path)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read_table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_substrings(documents(spark, sf_dir), digest=True).drop("text")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(documents(spark, sf_dir), digest=True).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), cache_pieces=600_000)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_shards": op4_token_shards,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_array": op8_suffix_array,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents
        ), five AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n
            FROM d, unnest(range(1, len(w) - 3)) u(i)
        ), twice AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM five, range(5) r(k) WHERE n > 1 GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN twice USING (doc_id)
        ), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT n_symbols > 0.1 * n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
               AND NOT (n_dup_lines >= 5 AND n_dup_lines > 0.3 * (length(t) - length(replace(t, chr(10), '')) + 1))
               AND NOT length(t) - length(replace(t, '!', '')) > 0.3 * n_words
               AND NOT (n_words >= 20 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g')))
               AND NOT (n_words >= 50 AND len(list_distinct(w)) < 0.1 * n_words) AS kept
        FROM b""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        windows AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 49], ' ')) AS first FROM d, unnest(range(1, len(w) - 48)) u(i)),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows, range(50) r(k) WHERE first < doc_id),
        kept AS (SELECT d.doc_id, u.i, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i) ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.i = u.i),
        joined AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN joined USING (doc_id)""",
    "op8_suffix_array": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        windows AS (SELECT doc_id, i, b[i + 1:i + 50] AS s FROM d, unnest(range(0, octet_length(b) - 49)) u(i)),
        shared AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
        starts AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM windows JOIN shared USING (s) WHERE first < doc_id),
        numbered AS (SELECT doc_id, i, count(*) FILTER (WHERE gap IS NULL OR gap > 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY doc_id, run),
        between_spans AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        cut AS (SELECT doc_id, count(*) AS n, sum(z - a)::BIGINT AS gone, max(z) AS z, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS h FROM between_spans JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
               sha256(unhex(coalesce(h, '') || hex(b[coalesce(z, 0) + 1:octet_length(b)]))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
}
