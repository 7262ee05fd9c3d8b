"""The training-data pipeline: language ID, near and exact duplicates, mixing and packing.

Each stage takes the documents that its predecessor kept. Rows with null texts, keys or sources, repeated
rows and empty tables pass through each stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import language
from casework.llm.mixing import mix
from casework.llm.packing import pack
from casework.llm.passages import repeated_spans, without_spans
from casework.llm.sampling import remainder
from casework.llm.simhash import without_near_duplicates
from casework.session import let_workers_import, written

#: Documents whose best language is less likely than this go; texts in one language score close to 1.
LEAST_SCORE = 0.5
#: Words of a shingle, and bits in which the fingerprints of near-duplicates differ at most.
WORDS, DISTANCE = 3, 3
#: Sources are mixed in proportion to their sizes to this power; slots of 16 documents that are packed together.
TEMPERATURE, STRETCH = 0.9, 256


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: those without a letter (null and empty ones too) and undecided ones go.

    It is learned from the documents themselves, bounded for each language; long texts are read whole.
    """
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    found = language.identify(docs, model)
    kept = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(kept).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (three-word shingles, three bits): the smallest doc_id.

    Texts without a word are one group; of rows that repeat one stays, and another text of the same doc_id stays if
    it is first in a group of its own. Documents without a doc_id are all kept.
    """
    return without_near_duplicates(docs, words=WORDS, distance=DISTANCE)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 200 bytes and more that occur more than once out of the texts, wherever they occur.

    Null, empty and shorter texts stay as they are; rows that repeat are copies of each other.
    """
    return without_spans(repeated_spans(docs)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: any stretch of it holds the sources in their weights.

    Sources that run out leave the schedule and the others go on in proportion, so no document is left out. A null
    source is a source; documents with equal or null keys follow one another in their source's order. The next
    stage reads the order from the documents again (``mix``), as rows in files have none of their own.
    """
    return mix(docs, temperature=TEMPERATURE).orderBy("mix_slot", "mix_place").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token pieces with their place in sequences, which follow the mixture.

    Pieces of a stretch of STRETCH slots are packed together and sequences numbered by stretch, so every run of
    sequences holds the sources in their weights. Slots depend on keys and sources alone, which no stage between
    changes. Null and empty texts are one piece, the end id; longer texts than a sequence are cut.
    """
    slots = mix(docs, temperature=TEMPERATURE).select("doc_id", "text", "mix_slot")
    return pack(slots, place="mix_slot", stretch=STRETCH)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, fingerprints and the learned language model are beyond SQL; tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again by the next."""
    let_workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
