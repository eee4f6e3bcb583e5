"""Declared schemas of the result tables and how they are stored."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.operators.answers import RESULT_DOCUMENT, result_documents
from speechmill.session import ensure_checkpoint_dir
from speechmill.sources import snapshots

# --- fixed values: columns of the result tables; session_name is the partition ---
TABLES = {
    "sessions": "session_id string, session_name string, meeting_date date, source_path string, hash_digest string, "
    "analysis_version string, analyzed_at timestamp, summary_text string, summary_embedding array<float>, "
    "metadata string",
    "agenda_items": "agenda_id string, session_id string, session_name string, agenda_title string, "
    "agenda_category string, summary_text string, summary_embedding array<float>, metadata string",
    "party_positions": "agenda_id string, session_name string, party_name string, stance_label string, "
    "key_points array<string>, concerns array<string>, suggestions array<string>, summary_text string, "
    "stance_embedding array<float>, metadata string",
    "qa_interactions": "qa_id string, agenda_id string, session_name string, questioner string, respondent string, "
    "question_text string, answer_text string, effectiveness_score double, effectiveness_bucket string, "
    "tags array<string>, question_embedding array<float>, answer_embedding array<float>, metadata string",
    "issue_trends": "session_id string, session_name string, issue_keyword string, sentiment_score double, "
    "frequency int, notes string, metadata string",
    "documents_rag": "document_id string, session_name string, source_type string, source_id string, "
    "chunk_index int, content string, metadata string, embedding array<float>",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the declared schema in its order and types; absent ones null."""
    spark = df.sparkSession
    schema = spark.createDataFrame([], TABLES[table]).schema
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def replace_sessions(df: DataFrame, table: str, root: str, worklist: DataFrame | None = None) -> None:
    """Write the sessions present in ``df`` over their stored versions; others are left alone.

    Sessions of ``worklist`` (``session_name``) that have no row in ``df`` end without rows: their stored
    partitions are dropped. A repeated run stores the same rows again.
    """
    spark = df.sparkSession
    (
        conform(df, table)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_name")
        .parquet(f"{root}/{table}")
    )
    if worklist is None:
        return
    stored = read_table(spark, table, root).select("session_name").distinct()
    stale = stored.join(worklist.select("session_name"), "session_name", "left_semi").join(df.select("session_name"), "session_name", "left_anti")
    # One name for each changed session at most.
    gone = [r["session_name"] for r in stale.collect()]
    jvm = spark._jvm
    for name in gone:
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/session_name={escaped}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, table: str, root: str) -> DataFrame:
    """Rows of the newest snapshot of ``root``; without one, of the table's folder."""
    if snapshots.newest(spark, root) is not None:
        return snapshots.read(spark, root, table, TABLES[table], "session_name")
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")


def overwrite_table(df: DataFrame, table: str, root: str) -> None:
    """Replace a table by rows that may be computed from the table itself.

    The rows are checkpointed to the shared folder first, so nothing is read from the files while
    they are replaced.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conform(df, table).checkpoint().write.mode("overwrite").parquet(f"{root}/{table}")


def write_documents(df: DataFrame, path: str) -> None:
    """Nested result documents, one JSON line each, by session."""
    df.withColumn("_session", F.col("session_name")).write.mode("overwrite").partitionBy("_session").json(path)


def write_document_texts(df: DataFrame, path: str) -> None:
    """Assembled documents (``session_name, document``), one JSON file for each session."""
    df.select(F.col("session_name").alias("_session"), "document").write.mode("overwrite").partitionBy("_session").text(path)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Result documents of either shape, one per file, from the first path that exists."""
    reader = spark.read.schema(RESULT_DOCUMENT).option("multiLine", True)
    for path in paths[:-1]:
        try:
            return result_documents(reader.json(path))
        except AnalysisException:
            continue
    return result_documents(reader.json(paths[-1]))
