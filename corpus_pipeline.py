"""A corpus pipeline of five stages, each a Spark job over all that the stage before kept.

All stages but the last return the columns of documents, in their order, also where they bear names
that an operator uses itself. Every stage handles null, empty and very long texts, null and repeated
ids, repeated rows and empty tables as the operator that it calls does: rows without letters go in the
first stage; of near-duplicates one row stays whatever their ids are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colocus.llm.common import staged, table
from colocus.llm.langid import UNKNOWN, identify_languages, trained_on
from colocus.llm.mixing import mix_sources
from colocus.llm.ngram_join import one_of_each_group
from colocus.llm.packing import pack_documents, packing_digest
from colocus.llm.pii import find_personal_data, train_from_documents

#: The least posterior with which a language is accepted.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of the names in own renamed, and their names by the new ones."""
    names = {f"__own_{k}": c for k, c in enumerate(docs.columns) if c.lower() in own}
    return docs.withColumnsRenamed({c: new for new, c in names.items()}), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or doubtful; lang becomes the predicted one."""
    model, (rows, names) = trained_on(docs), _apart(docs, "lang_pred", "score")
    keep = tuple(c for c in rows.columns if c not in ("text", "lang"))
    found = identify_languages(rows, model, keep, with_text=True)
    accepted = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumnRenamed("lang_pred", "lang").drop("score")
    return accepted.withColumnsRenamed(names).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id."""
    return one_of_each_group(docs, n=5, share=80)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    model, (rows, names) = train_from_documents(docs), _apart(docs, "spans")
    found = find_personal_data(rows, model, tuple(c for c in rows.columns if c != "text"), with_text=True, clean=True)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.drop("spans").withColumnsRenamed(names).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as the root of their sizes, and shuffles all."""
    rows, names = _apart(docs, "copy", "shuffle_key")
    return mix_sources(rows, power=0.5, seed=17).drop("copy", "shuffle_key").withColumnsRenamed(names).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into windows.

    The caches are small: Spark reuses its Python workers, which the stages before have filled.
    """
    return packing_digest(pack_documents(docs, "word_bpe_49k.json", 1, 2048, cached=25_000))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("PII", privacy_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but mixing can be put in SQL; every stage is tested against a plain version of itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
