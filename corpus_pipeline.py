"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. In every stage a very long text is handled whole, columns may have any names and further ones are kept as they are, and
an empty table gives no rows. What a stage does with nulls, empty texts, repeated rows and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, language, packing, pii, probminhash
from quarryline.llm.common import documents, tokenizer_path, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters or unlike any of them go, so null and empty texts do.

    Rows with a null doc_id are judged by their text like others; repeated rows all stay or all go; a tie between languages keeps the document.
    """
    learned = docs.where(~language.held_out())
    model = language.learn(learned)
    return language.kept(docs, *model, language.least_scores(learned, *model))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest doc_id.

    Null and empty texts are in no class but their own and stay; so do rows with a null doc_id, repeated or not. Of rows that share a doc_id that with the smallest text stays (of equal texts that
    whose other columns have the smallest hash); ties between classes can't occur, as classes are connected components.
    """
    return probminhash.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, also an edited one, go.

    Null and empty texts hold no item and stay; doc_ids aren't looked at, so rows with a null or repeated one are judged by their text; a score of just the least one counts as a copy.
    """
    return decontaminate.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars, if there, follows the new text.

    A null text stays null and an empty one empty, and no other text becomes either; every row stays, repeated ones with equal results, whatever its doc_id; between entities that draw one surrogate the smaller value
    has it.
    """
    out = pii.with_surrogates(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences: a row per piece, with the columns of op6.

    A null or empty text is its end id alone; rows that share a doc_id, also a null one, and repeated rows are documents of their own; between equal choices of a sequence the order of the rows decides.
    """
    return packing.digest(packing.packed(docs, tokenizer_path()))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("PII", surrogates), ("packing", pack)]
#: The stages learn, sketch and align; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out, "stage-" + name.replace(" ", "-"))
    return docs
