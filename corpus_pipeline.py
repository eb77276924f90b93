"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output, one operator a stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
documents (the last: what token output returns). run() applies them to the documents table, writing each
stage's rows and reading them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import decontaminate as benchmark_index
from rillstone.llm import language_id, mixing, near_dedup, token_output
from rillstone.llm.common import read_table, stored, work_dir


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs' rows whose key isn't in the one column of gone."""
    name = "gone" + "_" * max(map(len, docs.columns))  # longer than any of docs' own
    return docs.join(gone.distinct().toDF(name), key == F.col(name), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any text in a language: null and empty texts, and texts without a letter. Others stay.

    Rows are judged one by one by their texts, long ones as a whole; equal and repeated rows, null ids and columns of
    any name change nothing. Where there is no labelled row to learn from, the same rows stay. An empty table stays empty.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    if not model.languages:  # nothing to learn from: all is und, but the texts stay
        return language_id.lettered(docs)
    # columns go by number meanwhile, so that none is called like an answer
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = language_id.predict(plain, model, text_col=f"c{docs.columns.index('text')}")
    # a text in any language has a score above 0, also where und is a label of the table
    return found.filter("score > 0").drop("lang_pred", "score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least id stays.

    Rows that share an id are one document and stay or go together; rows without an id are one document where their
    texts are equal, and count behind all others. Texts without words (null and empty ones) are classes of their own.
    """
    # a number above all ids in use for rows without one
    own = F.coalesce(F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    classes = near_dedup.near_duplicates(docs.select(own.alias("id"), "text"), id_col="id")
    return _without(docs, own, classes.filter("id <> class_id").select("id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any run of ten words of a benchmark item (or a whole shorter item).

    The verdict is the text's and goes back to its rows by the text's md5, so rows without an id, or that share one,
    are each judged by what they hold. Null and empty texts stay; an empty benchmark drops nothing.
    """
    found = benchmark_index.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, benchmark_index.digest_of("text"), found.filter("contaminated").select("digest"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by source, towards the square root of the sources' sizes; a copy is a row as it was.

    A null source is a source of its own; rows without an id, or that share one, are drawn one by one; texts aren't looked
    at; no rows give none.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    mixed = mixing.mix_sources(plain, id_col=f"c{names.index('doc_id')}", source_col=f"c{names.index('source')}")
    return mixed.drop("copy_no", "shuffle_key").toDF(*names)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all rows in range-coded files, read back: doc_id, start, n_tokens, ids_crc32 for each.

    Files are in ascending order of ids (null first), rows of one id in that of a hash of their texts: this undoes the order
    of the mixing stage, which decides how often a document is written, not where. Null and empty texts are the end id
    alone. Other columns, of any name, are not read. No rows give none.
    """
    return token_output.token_output(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: Language models, sampled near-duplicate bands and tokenizers aren't in SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, docs = work_dir(spark), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), at, name)
    return STAGES[-1][1](spark, docs, sf_dir)
