"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, ngram_join, toxicity, wavelet
from factloom.llm.common import dropped, stored, table
from factloom.session import ship

#: A source goes out at most so often; the mix is as large as this and whole sources need.
REPETITIONS = 1.5


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; trained on the labelled ones among them."""
    ship(spark)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "_toxicity" + "_" * sum(c.startswith("_toxicity") for c in docs.columns)
    return toxicity.with_scores(docs, net, score_col=name).where(F.col(name) < 0.5).drop(name)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the smallest id."""
    ship(spark)
    return ngram_join.one_of_each_group(docs, n=5, least=80, of=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit distance."""
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; those of smaller sources again, up to the limit."""
    ship(spark)
    return mixing.mixed_documents(docs, target_entropy=None, repetition_limit=REPETITIONS, cover=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token-id files, and a row for each document that they hold."""
    ship(spark)
    return wavelet.token_id_output(docs)


STAGES = [
    ("toxicity", non_toxic),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        # The last stage has written its files by now, and its result is read from them.
        docs = stored(after, f"pipeline-{name}") if k < len(STAGES) - 1 else after
        if before is not None:
            dropped(before)
        before = docs
    return docs
