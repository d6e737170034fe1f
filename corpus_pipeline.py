"""A corpus in five stages: toxic documents go, one document of each group of near copies stays,
documents that hold benchmark items go, sources are mixed to target weights, token ids are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. The labels that teach the first stage and the benchmark of the third lie in sf_dir.

Defined results: a null text is empty; it holds no item and counts no words in mixing, where it is
taken as often as its hash says. Empty texts are near copies of each other. Rows without a doc_id may
be toxic, are never near copies or contaminated, and share a hash in mixing. Of rows with one doc_id
the one with the least text stays. An empty table gives no rows. Other columns go through every stage
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontamination, mixing, simhash, tokens, toxicity
from marlstone.llm.common import materialize
from marlstone.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.round_trip(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Fingerprints, log-odds and token ids have no SQL form. Tests hold run() against plain Python and SQL
#: from the toxicity stage's rows on, and that stage against the scores of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
