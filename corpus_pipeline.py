"""A corpus pipeline of five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.llm import bpe, langid
from daytrace.llm.common import documents, new_folder
from daytrace.llm.line_dedup import dedup_lines
from daytrace.llm.mixing import mix_sources
from daytrace.llm.simhash import representatives

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Keep documents whose language is known with a posterior probability of ``min_score`` or more.

    Rejected: null and empty texts, texts without a letter, and doubtful ones. Repeated rows and null identifiers are
    treated alike. Where no document has a label, none stays. An empty table gives no rows. Only the columns of documents
    go on, whatever else the table has.
    """
    guess = langid.predictor(spark, langid.train(langid.training_rows(docs)))
    kept = docs.select(*COLUMNS).withColumn("guess", guess("text")).filter((F.col("guess.lang_pred") != langid.UNKNOWN) & (F.col("guess.score") >= min_score))
    return kept.select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated runs of three lines; every document stays, if with an empty text.

    The earlier occurrence has the smaller identifier, null first, or the smaller line number. Rows repeated with the same
    identifier and text lose nothing to one another. A null text stays null, with null ``n_chars``. An empty table gives no
    rows. Only the columns of documents go on.
    """
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest identifier; nulls come last, and of equal identifiers a
    hash of the row decides. Null and empty texts are one group. An empty table gives no rows. Only the columns of
    documents go on."""
    return representatives(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the schedule: files and rows are sorted by it, and the next stage numbers them so.

    Null sources are one source; of equal identifiers a hash of the row decides the order, and wholly repeated rows are
    interchangeable. Null and empty texts are mixed like others. An empty table gives no rows. Only the columns of documents
    go on.
    """
    mixed = mix_sources(docs.select(*COLUMNS))
    return mixed.repartitionByRange("mix_order").sortWithinPartitions("mix_order").select("row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the digests of the ids and of the text decoded from them, and the place in the mix.

    ``mix_file`` and ``mix_row`` sort the rows as they were mixed: the number of the file that the stage before wrote, and
    of the row in it (for a table that isn't read from files, of the partition and the row in that). Null and empty texts
    have no ids; repeated rows repeat; an empty table gives no rows; other columns aren't looked at.
    """
    try:
        placed = docs.withColumns({"mix_file": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), "mix_row": F.col("_metadata.row_index")})
        placed.schema
    except AnalysisException:
        placed = docs.withColumns({"mix_file": F.spark_partition_id().cast("long"), "mix_row": F.monotonically_increasing_id()})
    return bpe.digests(placed, with_ids=True, carry=("mix_file", "mix_row"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("mix_sources", mix), ("bpe_tokens", bpe_tokens)]

#: Hashed features, fingerprints and schedules have no SQL form; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table of documents; each stage's rows are written to a new folder in the shared
    one, and stay there. Nulls, empty and long texts, repeated rows and an empty table are as the stages state."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
