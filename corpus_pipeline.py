"""From raw documents to packed training sequences, in five stages.

Language ID drops documents without a letter or with an ambiguous language; toxicity drops those
predicted toxic; SimHash keeps one row of each group of near-duplicates, the one with the
smallest id, and of those the one with the smallest text; decontamination drops documents of which
benchmark passages make up 5 % of the words; packing cuts and packs what is left.  Each stage's result
is written as Parquet and read again.

Results in odd cases: null and empty texts have no language and go in the first stage; rows without
an id stay like any other, but come last where one of a group is chosen; an id may stand on several
unlike texts, each of which is judged by itself, and only rows whose texts are near-duplicates are
reduced to one; repeated rows are near-duplicates of each other; an empty table gives no rows; extra
columns are carried through all stages but the last, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, langid, packing, simhash, toxicity
from siftline.llm.common import scratch, table
from siftline.llm.queries import tokenizer_path


def _screened(docs: DataFrame, find: Callable[[DataFrame, str, str], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs that an operator's columns keep; docs' own columns get other names meanwhile, so that none is replaced."""
    names = {c: f"own{k}" for k, c in enumerate(docs.columns)}
    found = find(docs.toDF(*names.values()), names["doc_id"], names["text"])
    return found.where(keep).select(*[F.col(n).alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    return _screened(docs, lambda d, i, t: langid.identify(d, model, id_col=i, text_col=t, carry=True), (F.col("lang_pred") != "und") & ~F.col("ambiguous"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(known, labels, langid.fit(known))
    return _screened(docs, lambda d, i, t: toxicity.score(d, model, id_col=i, text_col=t, carry=True), F.col("predicted") == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; rows that share an id but not their text are judged each by its own text."""
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _screened(docs, lambda d, i, t: decontaminate.find_contamination(d, benchmark, id_col=i, text_col=t, carry=True), ~decontaminate.contaminated())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the classifiers, the fingerprints' components and the packing are beyond it; tests hold it against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
