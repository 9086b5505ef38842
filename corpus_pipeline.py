"""A corpus pipeline: five stages, each one operator over all that the stage before has kept.

Every stage takes any rows of the columns of ``documents``, more columns too, and names an operator uses itself. An empty
table stays empty. Repeated rows are judged alike; of rows that share id and text the near-duplicate stage keeps one.
Rows with a null id take part by their text, but are no duplicates of others. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import common, packing, pii, quality, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; null and empty texts, which score 0, stay.

    Labels of sf_dir's table that are null, of null ids or of ids that ``docs`` lacks teach nothing; without labels of both
    kinds every score is 0.5 or 0 and all rows stay.
    """
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far outside their language and source go.

    Null and empty texts fail it. A null language or source is a group like any other. Rows with null id are told apart by
    their texts. A document at the limit stays.
    """
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more, over shingles of five words, stays: that of the smallest id.

    Null and empty texts are one group. Rows that share an id and have texts of their own are documents of their own.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text, and is null where the text is. All rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, neighbours on the curve together.

    A null text is an empty one: a piece of the end token alone. Ties on the curve go by id, then by tokens.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_outliers),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express none of the stages; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
