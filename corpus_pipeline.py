"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvalue.llm import jaccard, packing, quality, substrings
from relvalue.llm.queries import WORD_FILE, table, vocabulary
from relvalue.llm.rowkey import ROW, row_key
from relvalue.llm.scratch import Scratch


def _keyed(docs: DataFrame, key: DataFrame) -> Column:
    one, two = row_key()
    return (one == key["_key_0"]) & (two == key["_key_1"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source.

    A null text counts as empty and goes. Repeated rows go or stay together; an empty table stays one.
    """
    gone = quality.judge(docs).where("not kept").select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(ROW))).distinct()
    return docs.join(gone, _keyed(docs, gone), "left_anti")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (null ids last), of several the one of smallest key.

    Of rows that agree in id and text one stays, whatever their other columns. Texts without words are near copies of nothing
    and stay, each row. An empty table stays one.
    """
    found = jaccard.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("first")
    firsts = found.where("component is not null").groupBy("component").agg(first).select(*(F.col(f"first.{c}").alias(f"_key_{i}") for i, c in enumerate(ROW)), F.lit(0).cast("long").alias("_alone"))
    wordless = found.where("component is null").select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(ROW))).distinct().withColumn("_alone", F.lit(1).cast("long"))
    stay = firsts.unionByName(wordless)
    kept = docs.join(stay, _keyed(docs, stay)).withColumn("_alone", F.col("_alone") * (1 + F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_key_0", "_key_1", "_alone"]).select(*(docs[c] for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages of 20 words or more that an earlier one has; n_chars follows the text.

    A null text stays null; null ids come after all others; repeated rows are one document, and each stays. An empty table stays one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_other_{i}" for i, c in enumerate(others)}  # no name can clash with the operator's own
    kept = substrings.remove_repeats(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    changed = F.col("repeats.n_removed") > 0

    def value(c: str):
        if c == "n_chars":
            return F.when(changed, F.char_length("text")).otherwise(F.col(names[c])).cast(docs.schema[c].dataType).alias(c)
        return F.col(names.get(c, c)).alias(c)

    return kept.select(*(value(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    A null text counts as empty and has its end id; repeated rows are packed each. An empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary(WORD_FILE), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The outlier rules and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
