"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Every stage takes what the one before it kept, as (spark, docs, sf_dir), and returns a table; all but the last
return the columns of ``documents``. Tables between stages are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.llm import langid, nearcopies, packing, quality, suffixes
from findlake.llm.queries import QUALITY_THRESHOLD, WORD_TOKENIZER, read
from findlake.llm.storage import materialize

#: SQL can express neither the models nor the packing: stages are tested against brute force and planted cases.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the model of some language accepts; texts without a letter go."""
    models = langid.fit(docs, F.lit(True))
    return langid.keep_accepted(docs, models)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line field scores at the threshold or more."""
    field = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, field, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 or more of 5-word shingles: the smallest doc_id."""
    return nearcopies.keep_first(docs, shingle=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that have occurred in a document before."""
    return suffixes.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the documents and place their pieces in sequences of 4096 tokens."""
    caps = packing.Capacities(tokens=4096, documents=4096, attention=4096 * 4096)
    pieces = packing.cut_pieces(docs, WORD_TOKENIZER, end_id=1, longest=caps.tokens)
    return packing.best_fit_pack(pieces, caps).select(*packing.PIECE_COLUMNS, "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("quality_crf", good_quality),
    ("simhash", near_duplicates),
    ("suffix_array", repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
