"""From raw documents to a mixed, tokenised training set, in five stages.

Each stage is (name, function); a function takes the session, the documents that its predecessor kept
and the folder of the tables, and returns a DataFrame that is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import decode, encode, ids_digest
from tallyframe.llm.common import has_repeats, materialize, named, text_batches
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.quality import scored_rows, train
from tallyframe.llm.shingle_join import similar_documents
from tallyframe.llm.suffix_dedup import cut_rows
from tallyframe.plans.registered.base import table

#: Documents of a lower score go.
MIN_SCORE = 0.5


def _rows(docs: DataFrame, **others: Column) -> DataFrame:
    """Each document as one column, row, so that no name of its columns meets another; and the others."""
    return docs.select(F.struct("*").alias("row"), *[value.alias(name) for name, value in others.items()])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field, trained on the labels, scores 0.5 or more.

    Ids that are held out of training by the registered query are held out here, too. Null and empty
    texts are scored like any other.
    """
    labels = table(spark, sf_dir, "labels")
    learned = labels.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(True)))
    model = train(table(spark, sf_dir, "documents"), learned)
    return scored_rows(docs, model).where(F.col("score") >= MIN_SCORE).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates
    are the members of a SimHash class, as op4 forms them, and texts that share a MinHash band; whole sets
    decide. Rows of one id that are equal in text become one; a null id is kept only in a component of nulls, once for each
    text.
    """
    repeated = has_repeats(docs, "doc_id")
    kept = similar_documents(docs).where(F.col("d").eqNullSafe(F.col("component_id"))).select("d", "t").distinct()
    ones = docs.dropDuplicates(["doc_id", "text"]) if repeated else docs
    rows = _rows(ones, id=named("doc_id").cast("long"), hash=F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t"))
    return rows.join(kept, same, "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; n_chars is that of what is left.

    Documents of which nothing is left go, unless they were empty before. Where a cut falls inside a
    character, the broken character goes with it.
    """
    before, whole = F.col("row"), F.col("n_removed") == 0
    columns = {
        "text": F.when(whole, before["text"]).otherwise(F.col("kept_text")),
        "n_chars": F.when(whole, before["n_chars"]).otherwise(F.length("kept_text").cast("long")),
    }
    stays = whole | (F.octet_length("kept") > 0)
    return cut_rows(docs).where(stays).select(*[columns.get(c, before[c]).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it; documents it takes not at all go."""
    taken = mix_sources(docs).groupBy(F.col("doc_id").alias("taken")).agg(F.max("copies").alias("copies"))
    rows = _rows(docs, id=named("doc_id").cast("long")).join(taken, F.col("id").eqNullSafe(F.col("taken"))).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every copy; the last stage. Null and empty texts have no tokens."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix),
    ("tokens", tokenize),
]

#: A trained model, links of fingerprints and merges of bytes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(text_batches(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
