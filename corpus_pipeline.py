"""A corpus pipeline of five stages, each on all that its predecessor kept.

1. toxicity: documents that the boosted trees score at 0.5 or more go;
2. language: documents whose language can't be told (no letter, or n-grams of none of the learned languages) go;
3. near_dup: one document of each group of near-duplicates stays;
4. secrets: secrets are replaced by their kind in brackets, and n_chars is counted again; no document goes;
5. packing: the documents' token ids, cut into sequences of power-of-two lengths.

Models are learned from the stage's own input. Each stage's result is written as Parquet to the shared folder and read
again. Stages 1 to 4 return the columns of documents. Null, empty, very long and repeated texts, ties, empty tables and further
columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkferry.llm._frames import Held, release

#: A text in none of the learned languages scores 0; the best of K languages' regressions scores others at 1 / K or more.
LEAST_LANGUAGE = 0.25


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more. Null and empty texts are scored as having no words, which no label calls toxic, and stay;
    repeated rows go or stay together; labels of documents that aren't there teach nothing; without labels all stay."""
    from sparkferry.llm.toxicity import learn, score

    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=tuple(docs.columns), prefix="__toxicity_").where(F.col("__toxicity_predicted") == 0).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in none of the learned languages: null and empty texts, texts without a letter, and those whose n-grams learned
    texts lack. Repeated rows go or stay together; ties go to the first language by name, so the document stays; where no
    row has a language to learn from, all go."""
    from sparkferry.llm.lang_id import UNKNOWN, identify, learn

    out = identify(docs, learn(docs), keep=tuple(docs.columns), prefix="__language_")
    return out.where((F.col("__language_lang_pred") != UNKNOWN) & (F.col("__language_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest key; a null key comes last, and of repeated rows with that key
    one stays. Null and empty texts are like nothing and stay."""
    from sparkferry.llm.near_dup import deduplicated

    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets. n_chars is counted again only where something was replaced; null
    texts stay null."""
    from sparkferry.llm.secrets import scan

    out = scan(docs, keep=tuple(c for c in docs.columns if c != "text"), redacted=True, prefix="__secrets_")
    made = {"text": F.col("__secrets_redacted"), "n_chars": F.when(F.size("__secrets_spans") > 0, F.length("__secrets_redacted").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; a null or empty text is one piece of the end alone, and repeated rows each have their own."""
    from sparkferry.llm.packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_dup", near_dup), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the models nor the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables go when the next one's are written; the result reads those of the last but one (`release` deletes them)."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        now = Held(out)
        release(out)
        if held is not None:
            held.drop()
        held, docs = now, now.df
    return STAGES[-1][1](spark, docs, sf_dir)
