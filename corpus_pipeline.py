"""From raw documents to packed training sequences: five stages, each a table of its own.

Every stage works on all that the one before kept, and its decisions take effect: documents whose language is
rejected go; of near-duplicates one stays; personal data becomes [KIND]; documents are repeated or left out until
sources have their target weights, in training order; pieces are packed into sequences, which come in the order of
their first piece's training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.llm import language_id, mixing, near_duplicates, packing, personal_data
from fitrank.llm.queries import WORD_FILE, tokenizer_file
from fitrank.llm.shared import free_name, row_keys, written


#: Training position of a row; the first stage adds it without a value, the mix fills it in, packing goes by it.
POSITION = "mix_position"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null, has no letter or is too far from every language go."""
    return language_id.keep_identified(docs).withColumn(POSITION, F.lit(None).cast("double"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group on five-word shingles one row of the smallest doc_id stays; of documents without shingles one row
    of each doc_id. Rows of one doc_id are one document; those without doc_id are linked with nothing and all stay."""
    key = free_name(docs, "row_key")
    rows = row_keys(docs, key)
    kept = near_duplicates.near_duplicates(rows, key=key).where("kept")
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias(key)).select(key)
    return rows.join(one.union(kept.where("doc_id is null").select(key)), key, "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced; n_chars follows."""
    columns = docs.columns
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order; their positions fill the column for it, where it is."""
    return mixing.mixed_documents(docs.drop(POSITION)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, their places in sequences of at most 4096 tokens and their training positions; sequences are in training
    order, each where its first piece is. Without positions there is no order."""
    if POSITION not in docs.columns:
        return packing.pack(docs, tokenizer_file(WORD_FILE))
    return packing.in_training_order(packing.pack(docs, tokenizer_file(WORD_FILE), position=POSITION))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot encode texts or learn from them; tests hold each stage against a brute-force version on small tables.
ORACLE_SQL = None
