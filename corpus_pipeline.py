"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Models and test items come from the tables in sf_dir; everything else from the stage's own input.

Nulls, empties, ties, repeats, clashing names: a null or empty text is neither toxic nor a copy nor dirty and stays until
the mix, which takes words only, so a document without words has no row in it. A null doc_id is a document like others
and the last of a group of copies. Equal rows are copies of each other unless they are without words. Tables without
rows give no rows. Extra columns pass all stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.decontamination import clean
from augur.llm.jaccard import one_of_each
from augur.llm.mixing import mix_documents
from augur.llm.sharding import shard_documents
from augur.llm.toxicity import reject_toxic, train
from augur.llm.util import save, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the model learns from all labels of sf_dir, on the documents given."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return reject_toxic(docs, train(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: for each pass over a document a row with the words that the pass takes."""
    return mix_documents(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("sharding", sharding)]

#: SQL has no words for the learned lexicon and its automaton, nor for the mix's draws: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"stage{i}")
    return docs
