"""A corpus pipeline: the stages a raw document table passes on its way to training sequences.

All stages but the last return the columns of their input, whatever they are called. An empty table
passes every stage and stays empty. Null and empty texts, rows without an id and rows that
repeat are defined at each stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from reelgate.llm.jaccard import one_of_each
from reelgate.llm.line_dedup import dedup_lines
from reelgate.llm.mixing import mixed_documents
from reelgate.llm.packing import pack
from reelgate.llm.quality import keep_good
from reelgate.session import discard, prepare, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps.

    A document labelled good always stays. Null and empty texts weigh 0 and are judged by that; rows that
    repeat stay or go together; without labels of both kinds every document stays.
    """
    return keep_good(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share, which stay in one of them.

    Every row stays, also one that loses all its lines. A null text stays null; rows without an id count as
    one document, whose id is smaller than any other.
    """
    prepare(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8.

    The smallest id stays, one row of it for each of its texts. Documents without a word are no copies of
    each other; of rows without an id one stays for each text.
    """
    prepare(spark)
    return one_of_each(docs, percent=80, size=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    A document may come up to three times, its last copy cut after the words that are still wanted.
    Documents without a word are taken by no mix and go; a null source is a source like others.
    """
    prepare(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; token ids follow from document, start and length.

    A null text is empty and packed as its end mark alone. Copies of a document are packed each.
    """
    prepare(spark)
    return pack(docs).drop("ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: No stage list with a classifier and a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored and read as the next one's input.

    A stage's result is deleted once the next one is written; the last one stays, as it is returned.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            discard(spark, f"{folder}/{number - 1}")
    return docs
