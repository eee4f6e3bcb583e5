"""Reading and writing speech and header files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import blank_to_null
from speechmill.functions.text import path_safe
from speechmill.operators.rollups import attach_group

# --- fixed values: columns of the files in their order ---
SPEECH_COLUMNS = (
    "session", "session_type", "meeting_no", "date", "speech_order", "speaker_name", "speaker_position",
    "speaker_area", "data_mem_id", "agenda_item_orders", "agenda_item_titles", "agenda_item_times", "speech_text",
)
INTEGERS = ("session", "speech_order", "item_order")
HEADER_COLUMNS = ("session", "session_type", "meeting_no", "date", "section", "item_order", "item_text")

SESSION_KEY, MEETING_KEY = "session_key", "meeting_key"
#: Folders of :func:`write_partitioned`, as the ``session`` to read.
PARTITIONED = f"{SESSION_KEY}=*/{MEETING_KEY}=*"


def schema_of(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} {'int' if c in INTEGERS else 'string'}" for c in columns)


def _csv_options(reader: DataFrameReader) -> DataFrameReader:
    return (
        reader.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .option("ignoreCorruptFiles", True)
    )


def _read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Files with a byte-order mark, quoted line feeds and doubled quotes.

    Columns are taken by position, as all files are written in one fixed order; a file without the
    last column leaves it null.
    """
    return _csv_options(spark.read.schema(schema_of(columns))).csv(list(paths))


def with_provenance(df: DataFrame) -> DataFrame:
    """Session name and file name out of the path of the file a row came from.

    The session's folder is the one above the file, or above the meeting's as :func:`write_partitioned`
    lays them out.
    """
    path = F.url_decode(F.col("_metadata.file_path"))
    return df.select(
        "*",
        F.regexp_extract(path, rf"(?:{SESSION_KEY}=)?([^/]+?)(?:/{MEETING_KEY}=[^/]*)?/[^/]+$", 1).alias("session_name"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
    )


def read_speeches(spark: SparkSession, root: str, with_party: bool = True, session: str = "제*") -> DataFrame:
    """Speech files of all session folders, or of one.

    Files are taken by name and unreadable ones are skipped. Every data row is kept; a session or
    order that is not a number is null, and :func:`unordered_rows` counts those. :func:`read_checked` and
    :func:`file_account` tell what was set aside or gave nothing, by row and by file.
    """
    columns = SPEECH_COLUMNS + (("party",) if with_party else ())
    return with_provenance(_read_csv(spark, [f"{root}/{session}/*speeches*.csv"], columns))


def unordered_rows(df: DataFrame) -> DataFrame:
    """Rows per file whose session or order is not a number."""
    broken = F.col("session").isNull() | F.col("speech_order").isNull()
    return df.filter(broken).groupBy("session_name", "file_name").agg(F.count(F.lit(1)).alias("rows"))


#: Why a row was set aside, in the order in which they are tried.
TOO_FEW, TOO_MANY, NOT_UTF8, NO_NUMBER = "too few values", "too many values", "not UTF-8", "no number"
#: Why a file gave no row.
EMPTY_FILE, NO_ROWS = "empty file", "no rows"
_RAW = "_raw"


def _count_of_values(raw: Column) -> Column:
    """Values in one CSV record: commas outside quotes, and one. Doubled quotes are two quoted parts side by side."""
    bare = F.regexp_replace(raw, '"[^"]*"', "")
    return F.length(F.regexp_replace(bare, "[^,]", "")) + 1


def read_checked(spark: SparkSession, root: str, session: str = "제*") -> DataFrame:
    """All rows of the speech files with ``reason``: null for a sound row, else why it is set aside.

    A record has as many values as there are columns, with or without the party. ``raw`` holds a record with
    another number of values as it stands in the file. A row whose session or order is no number, or whose
    bytes were not UTF-8 (they are read as U+FFFD), is set aside as well. One scan.
    """
    columns = (*SPEECH_COLUMNS, "party")
    schema = ", ".join(f"{c} string" for c in (*columns, _RAW))
    read = _csv_options(spark.read.schema(schema)).option("columnNameOfCorruptRecord", _RAW).csv(f"{root}/{session}/*speeches*.csv")
    # A record without the party is complete; the reader reports it as one value short.
    found = F.when(F.col(_RAW).isNotNull(), _count_of_values(F.col(_RAW)))
    odd = found.isNotNull() & ~found.isin(len(SPEECH_COLUMNS), len(columns))
    number = [F.col(c).try_cast("int").isNull() for c in ("session", "speech_order")]
    foreign = F.contains(F.concat_ws("", *columns), F.lit("\ufffd"))
    reason = (
        F.when(odd & (found < len(SPEECH_COLUMNS)), TOO_FEW)
        .when(odd, TOO_MANY)
        .when(foreign, NOT_UTF8)
        .when(number[0] | number[1], NO_NUMBER)
    )
    typed = [F.col(c).try_cast("int").alias(c) if c in INTEGERS else F.col(c) for c in columns]
    rows = with_provenance(read.select("*", "_metadata"))
    return rows.select(
        *typed, "session_name", "file_name", _plain_path(F.col("_metadata.file_path")).alias("file_path"),
        reason.alias("reason"), F.when(odd, F.col(_RAW)).alias("raw"),
    )


def sound_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason", "raw", "file_path")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def _plain_path(encoded: Column) -> Column:
    """The path as the file system has it; an empty host between slashes is left out, as listings differ in it."""
    return F.regexp_replace(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9.+-]+:)///", "$1/")


def file_inventory(spark: SparkSession, root: str, session: str = "제*") -> DataFrame:
    """``file_path, bytes`` of every speech file, without reading any.

    A scan leaves out files of no bytes, so the names come from the listing that the driver holds to plan it.
    """
    files = spark.read.format("binaryFile").load(f"{root}/{session}/*speeches*.csv")
    names = spark.createDataFrame([(f,) for f in files.inputFiles()], "name string")
    listed = names.select(_plain_path(F.col("name")).alias("file_path"))
    sizes = files.select(_plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_size").alias("bytes"))
    return listed.join(sizes, "file_path", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))


def file_account(spark: SparkSession, root: str, checked: DataFrame, session: str = "제*") -> DataFrame:
    """One row per file: ``file_path, bytes, rows, sound, rejected, reasons, reason``.

    ``rows`` is always ``sound + rejected`` and ``reasons`` counts the rejected ones by reason. A file that gave no
    row is here too, with the ``reason``; so are files that could not be read and that the scan passed over.
    A file that breaks off while it is read keeps the rows before the break and is not told apart.
    """
    per_reason = checked.groupBy("file_path", "reason").agg(F.count(F.lit(1)).alias("n"))
    # A handful of reasons a file.
    entry = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    per_file = per_reason.groupBy("file_path").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("sound"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("reasons"),
    )
    zero = F.lit(0).cast("long")
    joined = file_inventory(spark, root, session).join(per_file, "file_path", "left").select(
        "file_path", "bytes", F.coalesce("rows", zero).alias("rows"), F.coalesce("sound", zero).alias("sound"),
        F.coalesce(F.col("rows") - F.col("sound"), zero).alias("rejected"),
        F.coalesce("reasons", F.create_map().cast("map<string,bigint>")).alias("reasons"),
    )
    return joined.withColumn("reason", F.when(F.col("bytes") == 0, EMPTY_FILE).when(F.col("rows") == 0, NO_ROWS))


def read_session(spark: SparkSession, root: str, session_name: str) -> DataFrame:
    """One session; an absent folder or one without speech files is an error."""
    try:
        return read_speeches(spark, root, session=session_name)
    except AnalysisException as error:
        raise FileNotFoundError(f"no speech files under {root}/{session_name}") from error


def read_headers(spark: SparkSession, root: str, session: str = "제*") -> DataFrame:
    return with_provenance(_read_csv(spark, [f"{root}/{session}/*header*.csv"], HEADER_COLUMNS))


def with_known_party(df: DataFrame) -> DataFrame:
    """Rows whose file carried a party."""
    return df.filter(F.col("party").isNotNull())


def canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"speech_text": "speech_content", "party": "speaker_party"})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def party_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(values.PARTY_OF_SPEAKER.items()), "speaker_name string, party string")


def write_partitioned(df: DataFrame, path: str, kind: str) -> None:
    """CSV files below ``session_key=…/meeting_key=…``; a missing key becomes ``unknown``.

    Rows are brought together by their folder and, inside it, by order range, so a folder that
    holds much of the data is written by several tasks. Files have the fixed columns in their order,
    as readers take them by position: absent ones null, a party only if ``df`` has one. They are
    named after their kind and keep white space around values (an empty text is read as null), so
    ``read_speeches(spark, f"{path}/speeches", session=PARTITIONED)`` gives the same rows back.
    """
    unknown = F.lit(values.UNKNOWN)
    order = "speech_order" if kind == "speeches" else "item_order"
    columns = HEADER_COLUMNS if kind == "headers" else SPEECH_COLUMNS + (("party",) if "party" in df.columns else ())
    fixed = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    keyed = fixed.withColumn(SESSION_KEY, F.coalesce(F.col("session").cast("string"), unknown)).withColumn(
        MEETING_KEY, F.coalesce(blank_to_null(path_safe(F.col("meeting_no"))), unknown)
    )
    (
        keyed.repartitionByRange(SESSION_KEY, MEETING_KEY, order)
        .sortWithinPartitions(SESSION_KEY, MEETING_KEY, order)
        .write.mode("overwrite")
        .partitionBy(SESSION_KEY, MEETING_KEY)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mapreduce.output.basename", kind)
        .csv(f"{path}/{kind}")
    )


def write_enriched(speeches: DataFrame, headers: DataFrame, dimension: DataFrame, path: str) -> None:
    """Copy of the data set whose speeches carry the party; headers are copied as they are."""
    write_partitioned(attach_group(speeches.drop("party"), dimension, "speaker_name", "party"), path, "speeches")
    write_partitioned(headers, path, "headers")
