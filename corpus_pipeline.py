"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``, and others
that it has, whatever their names.

Every stage takes what may stand in a table.  Null and empty texts are kept by all of them: they are not
toxic, are near to nothing, hold no secret, and pack as a piece of length 0.  Null ids, sources and languages
are values.  Texts of any length are treated whole.  Rows that are alike stay alike: a stage that drops or
repeats one does so to all of them.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import settle, table
from tickloom.llm.minhash import keep_one
from tickloom.llm.mixing import mix_in_order
from tickloom.llm.packing import pack_best_fit
from tickloom.llm.secrets import redact_secrets
from tickloom.llm.toxicity import drop_toxic, fit_toxicity

#: Relative target weights; every other source has weight 1.
WEIGHTS = {"src0": 3.0, "src1": 3.0}
#: Output size of the mixing stage, as a multiple of its input.
EPOCHS = 1.0
#: Code points of a bin, and most pieces of one source in it.
CAPACITY, PER_SOURCE = 16_384, 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; labels teach the lexicon, and only those of the training fold.

    Without labels the base lexicon scores.  Equal texts score alike, so they go or stay together.
    """
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), reject=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 on five-word shingles stays: the one with the least id.

    Documents without words and those with a null id are in no group.  Rows with one id are one document.
    """
    return keep_one(docs, words=5, part=80, whole=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text where that changed, and stays null if it was."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to meet the sources' weights, and written in a global random order.

    A null source is a source of weight 1; rows with one id are repeated alike, those with a null id too.
    """
    return mix_in_order(docs, WEIGHTS, epochs=EPOCHS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where each text, or piece of a long one, stands in which bin.

    Equal texts, as repeats of a document are, never share a bin.
    """
    return pack_best_fit(docs, capacity=CAPACITY, per_source=PER_SOURCE)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]

#: Learned scores and best fit are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
