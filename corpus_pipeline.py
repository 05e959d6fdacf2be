"""The corpus pipeline: quality classifier, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents as they are, whatever their names. `run` writes each stage as Parquet to the shared folder and reads it
again as the next one's docs. Where no label or no language can be learned, all scores are equal: without labels no
document goes for its quality (0.5), and without languages none goes that has a letter. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.language_filter import UNKNOWN, detect_languages
from strataloom.llm.order_minhash import numbered, row_classes
from strataloom.llm.packing import pack_documents
from strataloom.llm.subword_quality import score_quality
from strataloom.llm.workspace import Workspace, unused

#: A document below this score of the quality classifier goes.
LEAST_QUALITY = 0.3
#: A document goes if its best language has no more than this share of the two best counts; 0.5 is a tie.
LEAST_LANGUAGE = 0.52
#: A text of fewer 4-grams is too short to go for its language.
LEAST_GRAMS = 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = unused("quality_score", docs.columns)
    return score_quality(docs, labels, column=score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language that stands out, and those too short to tell; texts without a letter go."""
    lang, score, grams = names = tuple(unused(c, docs.columns) for c in ("lang_pred", "lang_score", "lang_grams"))
    found = detect_languages(docs, names=names)
    stands_out = (F.col(lang) != UNKNOWN) & (F.col(score) > LEAST_LANGUAGE)
    return found.filter(F.col("text").rlike(r"\p{L}") & (stands_out | (F.col(grams) < LEAST_GRAMS))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one of the least doc_id, null last. A doc_id may repeat or be null."""
    ws = Workspace(spark, "near-duplicates")
    own = unused("row_uid", docs.columns)  # a column that the operator's number would hide goes by another name meanwhile
    rows = numbered(ws, docs.withColumnRenamed("row_uid", own))
    # the kept rows are as many as the documents: never broadcast, and hashed rather than sorted along with the texts
    kept = row_classes(ws, rows).filter("kept").select("row_uid").hint("shuffle_hash")
    ws.drop("sketched", "groups")
    left = rows.join(kept, "row_uid", "left_semi").drop("row_uid")
    return left.withColumnRenamed(own, "row_uid").select(*docs.columns) if own != "row_uid" else left.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Two stages are learned, one is hashed and one is packed: SQL cannot tell the rows. A brute-force test does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
