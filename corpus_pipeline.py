"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The driver writes each
stage's result and reads it again as the next one's docs; run() does the same in the folder of spark.checkpoint.dir.

Defined results: a null or empty text is scored by the machine's constant alone, has no near-duplicates and no passages, and packs as the end id; a null
id is never held out, joins no group, and counts as the largest id where passages repeat; of rows that share an id all stay or go with their
group (the first stage judges each row by its text); repeated rows stay, as they are one document; ties go to the smaller id; texts are
never cut, whatever their length; an empty table gives an empty result; columns beside doc_id and text pass through all stages but the last untouched,
whatever their names, but for n_chars, which follows the text where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import released, stored, table
from quarrystone.llm.near_dedup import near_dedup
from quarrystone.llm.packing import pack
from quarrystone.llm.substring_dedup import substring_dedup
from quarrystone.llm.toxicity import accepted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones, does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document has in the same 13-word windows; texts without any stay as they are."""
    out = substring_dedup(docs, carried=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("carried.text"))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("carried.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(made.get(c, F.col(f"carried.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, each with its sequence and offset."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The fitted machine of the first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
