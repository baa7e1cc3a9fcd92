"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from juryframe.llm import decontaminate as D, mixing as M, quality as Q, queries, shingle_join as J
from juryframe.llm.common import cut
from juryframe.session import configure
from juryframe.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; references come from all documents of the stage."""
    configure(spark)
    return Q.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, least id stays."""
    configure(spark)
    return J.one_of_each(docs, like=J.Similar(n=5, num=8, den=10))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of note; the rest go."""
    return D.decontaminate(docs, table(configure(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of the mix of sources, repeated as often as the mix takes them."""
    configure(spark)
    return M.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row per document read back from them."""
    return queries.token_rows(configure(spark), docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]
#: The last stage tokenizes, which SQL can't express; the tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before it wrote."""
    docs = table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
