"""The corpus pipeline: ``STAGES`` applied to ``documents``, each stage written and read again.

Each stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.
No stage can be put as SQL as a whole (a trained model, a vocabulary of merges), so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, near_dedup, piece_codec, quality, substring_dedup
from spanforge.llm.common import bound_batches, discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of a lower score go.
LEAST_QUALITY = 0.5
#: Near copies: Jaccard similarity of sets of five-word shingles, in hundredths.
NEAR = 80
#: Documents with a larger share of benchmark words go, from others the passages are cut.
MOST_BENCHMARK = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels, does not reject."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, "quality", F.lit(True))
    return quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id."""
    bound_batches(spark)
    return near_dedup.keep_first(docs, NEAR, 100).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere too; characters are cut whole, documents stay."""
    bound_batches(spark)
    done = substring_dedup.remove_repeats(docs, whole_characters=True)
    return _documents(done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are mostly such passages go."""
    bound_batches(spark)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(decontaminate.remove_hits(found, MOST_BENCHMARK))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, their number, and whether they decode to the text."""
    bound_batches(spark)
    # The codec drops the text that it reads, so what the decoded text must equal goes along under another name.
    wanted = F.replace(F.coalesce("text", F.lit("")), F.lit(piece_codec.SPACE), F.lit(" "))
    done = piece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text", F.sha2(wanted.cast("binary"), 256).alias("wanted")), piece_codec.default_model())
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("wanted")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
            if before is not None:
                discard(before)  # what a stage has read is written again, so its input is of no more use
            before = docs
    return docs
