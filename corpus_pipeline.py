"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again for the next one.

All stages but the last return the columns of ``docs``, whatever their names; only doc_id,
text and source are read.  A null text counts as empty: it is scored like an empty one, is
equal to other empty texts, has no near copies and no words to be mixed.  Ties and repeated
rows are settled by the operators (see their docstrings); an empty table passes all stages
and packs into no pieces.  Texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitfactors import ship
from pitfactors.functions.scale import stable
from pitfactors.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from pitfactors.llm.common import table, whole


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from all labels, does not call toxic."""
    ship(spark)
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=False)
    return toxicity.clean_documents(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    ship(spark)
    judged = exact_dedup.exact_dedup(docs)
    kept = judged.where("kept").select("doc_id", "mark")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (F.xxhash64(whole(docs["text"])) == kept["mark"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    ship(spark)
    return near_dedup.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; one row for each pass over a source."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of 1,024 ids."""
    ship(spark)
    return packing.pack(docs, queries.vocabulary(), added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, pseudorandom draws and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
