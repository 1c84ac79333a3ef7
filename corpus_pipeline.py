"""From raw documents to training batches, in stages that each keep a part of what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import langid
from careflow.llm.near_dedup import near_duplicates
from careflow.llm.packing import pack
from careflow.llm.substring import repeated_passages
from careflow.session import cut_lineage

def _free(name: str, docs: DataFrame) -> str:
    """A column name that `docs` does not have."""
    while name in docs.columns:
        name += "_"
    return name


#: A text whose language has at least this score under the model is kept.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, and put it in the place of `lang`; texts without letters or with doubtful language go.

    The model learns from the labelled rows of its own input; without any, no language can be told and nothing is kept.
    """
    lang, score = _free("lang_told", docs), _free("score_told", docs)
    told = langid.annotate(docs, langid.fit(docs), "text", lang, score).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= SURE))
    return told.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies; a document with a null id stays."""
    found = near_duplicates(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts; a text that loses nothing is left as it was, one that loses all goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"other_{i}" for i in range(len(others))]
    plain = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(others, names)])
    found = repeated_passages(plain, keep=names).where("n_removed = 0 or n_removed < n_words")
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), **{c: F.col(n) for c, n in zip(others, names)}}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(back["n_chars"])
    return found.select(*[back[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document that is left."""
    return pack(docs)


STAGES = [("language", language), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each goes on from the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
