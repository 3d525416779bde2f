"""A training corpus from raw documents, in five stages, each by one operator of quire.llm.

What happens to odd rows, stage by stage; an empty table gives an empty one everywhere, very long texts are worked on whole, further columns pass through, and columns
of the mix's names are replaced by its own:

1. Null and empty texts are scored like any other (all statistics zero). Rows without an id are scored, never learned from. Equal texts have equal scores.
2. Null and empty texts stay. Repeated rows are one document and get the same result; of equal ids the text with the smaller hash comes first; rows without an id come first of all.
3. Null and empty texts link with nothing and stay, each id once. Of rows of equal id and text one stays; of several texts of an id in one component one does. Rows without an id stay.
4. Null and empty texts leak nothing and stay. Equal documents stay or go alike, with or without an id.
5. Every row gets a place. Rows of one id stand side by side in the order of a hash of the row; rows without an id come last in their source; null sources are pooled with the unknown ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from quire.llm.common import bucket_of, saved, table
from quire.llm.registry import WEIGHTS


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (score below 0.3)."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels, held_out=bucket_of("doc_id", 5, 0), calibrates=bucket_of("doc_id", 5, 4), threshold=0.3)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that stand earlier in the corpus are cut out; documents of nothing else go."""
    left = line_dedup.without_emptied(docs, words=50)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 over 5-word shingles join."""
    return ngram_join.representatives(docs, n=5, num=4, den=5)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their places in a mix of the target weights."""
    return mixing.mix(docs, WEIGHTS, other=1, block=mixing.BLOCK)


STAGES = [
    ("quality classifier", good_ones),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("mixing sources to target weights", mixed),
]

#: The first stage fits a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage leaves is saved before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
