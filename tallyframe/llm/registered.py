"""The registered queries of the operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import decode, encode, ids_digest
from tallyframe.llm.common import text_batches
from tallyframe.llm.host_rules import apply_host_rules
from tallyframe.llm.html_text import extract_text
from tallyframe.llm.lexical_search import search
from tallyframe.llm.licenses import scan_licences, scan_sql
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.pivot_search import top_k
from tallyframe.llm.quality import score_quality
from tallyframe.llm.simhash import near_duplicates
from tallyframe.llm.suffix_dedup import remove_repeats
from tallyframe.llm.token_files import read_token_files, write_token_files
from tallyframe.llm.turn_repair import damaged, repair_conversations
from tallyframe.llm.warc import read_warc, write_warc
from tallyframe.plans.registered.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(text_batches(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op9_host_rules", sql=r"""
WITH words AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
    SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM words d LEFT JOIN repeated r USING (doc_id) LEFT JOIN lines l USING (doc_id)
), f AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), hosts AS (
    SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words) AS k
    FROM f GROUP BY source
), prior AS (
    SELECT mean, least(1e6, greatest(1.0, coalesce(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 END, 1e6))) AS strength FROM (
        SELECT sum(k) / sum(n) AS mean,
            sum(k * k / n) / sum(n) - mean * mean - mean * (1 - mean) * count(*) / sum(n) AS v FROM hosts)
), rates AS (
    SELECT source, n + strength AS weight, (k + mean * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5) AS kept, round(rate, 9) AS host_rate
FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
""")
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op4_simhash_near_duplicates")
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_pivot_top_k", sql="""
WITH ints AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM ints q JOIN ints c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""")
def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_quality_field")
def op2_quality_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_suffix_repeats")
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query("op7_licence_scan", sql=scan_sql())
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


@query("op13_lexical_search", sql=r"""
WITH counted AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), docs AS (
    SELECT r, doc_id, len(t)::BIGINT AS n, t FROM counted WHERE len(t) > 0
), whole AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs
), item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), tfs AS (
    SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs)
    WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term
), scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM item_terms JOIN tfs USING (term) JOIN weights USING (term), whole GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_turn_repair")
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), gone="gone").report()


@query("op11_warc")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_warc(write_warc(table(spark, sf_dir, "pages")), payload=False).where("record_type in ('response', 'revisit')")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
