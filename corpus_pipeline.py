"""A training-data pipeline: toxicity, language, near duplicates, benchmark leaks, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, langid, ngram_join, toxicity
from skein.llm.queries import tokenizer_path
from skein.llm.shared import checkpoint_dir, read

#: Least share of a text's words that must be in one language. Half-and-half mixtures of two stay.
LEAST_LANGUAGE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. Examples come from the labelled rows, term counts from all of docs."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__toxic").filter(F.col("__toxic") < 0.5).drop("__toxic")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: with a letter, and most of them in one language. Their lang stays as given."""
    found = langid.identify(docs, langid.train(docs), pred_col="__lang", score_col="__share")
    return found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__share") >= LEAST_LANGUAGE)).drop("__lang", "__share")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links (five words, 0.8) make: the one of smallest id."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, 0.8)."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, with the digests by which they can be checked."""
    return bpe.encode_decode(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language id", keep_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", tokenize),
]

#: No stage but the third could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between them, tables stand in the folder that all executors share."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
