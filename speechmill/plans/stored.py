"""Rows that are written as files or result tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.fields import natural_key
from speechmill.plans import dataset as ds
from speechmill.session import run_folder
from speechmill.sources import snapshots
from speechmill.sources import speeches as sp
from speechmill.sources import tables

# Every eleventh speech has no meeting and every thirteenth no session.
NO_MEETING, NO_SESSION = 11, 13
KINDS = ("whole", "partyless", "short", "long", "foreign", "bare")


def speech_rows(spark, sf):
    """All texts with the columns of a speech file."""
    rows = ds.texts(spark, sf)
    keyed = rows.withColumn("session", F.when(F.col("speech_key") % NO_SESSION != 0, F.col("session"))).withColumn(
        "meeting_no", F.when(F.col("speech_key") % NO_MEETING != 0, F.col("meeting_no"))
    )
    named = keyed.withColumn("speaker_name", F.concat(F.lit("u"), F.col("speech_key") % 10))
    schema = dict(c.split() for c in sp.schema_of(sp.SPEECH_COLUMNS).split(", "))
    return named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(schema[c]).alias(c) for c in sp.SPEECH_COLUMNS])


def header_rows(spark, sf):
    """One agenda header for each text, with the columns of a header file."""
    rows = speech_rows(spark, sf)
    return rows.select(
        "session", "session_type", "meeting_no", "date", F.lit("의사일정").alias("section"),
        F.col("speech_order").alias("item_order"), F.col("agenda_item_titles").alias("item_text"),
    )


def dimension(spark, sf):
    """A party for each speaker but one."""
    rows = speech_rows(spark, sf).select("speaker_name").distinct()
    return rows.filter("speaker_name != 'u7'").select("speaker_name", F.translate("speaker_name", "u", "p").alias("party"))


def speech_files(spark, sf):
    """Speech files by session and meeting, written and read as a whole."""
    path = run_folder(spark, "speech-files")
    sp.write_partitioned(speech_rows(spark, sf), path, "speeches")
    read = sp.read_speeches(spark, f"{path}/speeches", with_party=False, session=sp.PARTITIONED)
    return read.select("session_name", "session", "meeting_no", "date", "speech_order", F.sha2("speech_text", 256).alias("text_sha256"))


def one_session_files(spark, sf):
    """The same files, one session's alone."""
    path = run_folder(spark, "speech-files")
    sp.write_partitioned(speech_rows(spark, sf), path, "speeches")
    read = sp.read_session(spark, f"{path}/speeches", f"{sp.SESSION_KEY}=418/{sp.MEETING_KEY}=*")
    return read.select("session_name", "speech_order", "party", F.length("speech_text").alias("characters"))


def enriched_files(spark, sf):
    """The copy that carries the party, joined by files without one; names in their canonical form."""
    path, plain = run_folder(spark, "enriched-files"), run_folder(spark, "speech-files")
    rows = speech_rows(spark, sf)
    sp.write_enriched(rows, header_rows(spark, sf), dimension(spark, sf), path)
    sp.write_partitioned(rows, plain, "speeches")
    enriched = sp.read_speeches(spark, f"{path}/speeches", session=sp.PARTITIONED)
    bare = sp.read_speeches(spark, f"{plain}/speeches", with_party=False, session=sp.PARTITIONED)
    known = sp.canonical_names(sp.with_known_party(sp.union_all([enriched, bare])))
    return known.select("session_name", "speech_order", "speaker_party", F.sha2("speech_content", 256).alias("text_sha256"))


def copied_headers(spark, sf):
    """The header files beside the enriched ones."""
    path = run_folder(spark, "enriched-files")
    sp.write_enriched(speech_rows(spark, sf), header_rows(spark, sf), dimension(spark, sf), path)
    read = sp.read_headers(spark, f"{path}/headers", session=sp.PARTITIONED)
    return read.select("session_name", "meeting_no", "section", "item_order", "item_text")


def damaged_files(spark, sf):
    """Speech files of five kinds in one folder each: whole, without a party, cut off, with one value more, in another encoding; and empty ones.

    The kind is told by the speech's key, so that every kind grows with the texts.
    """
    root = run_folder(spark, "damaged-files")
    rows = speech_rows(spark, sf).withColumn("kind", F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("speech_order") % len(KINDS)).cast("int")))
    keys = [F.coalesce(F.col("session").cast("string"), F.lit(values.UNKNOWN)).alias(sp.SESSION_KEY), F.lit("m").alias(sp.MEETING_KEY)]
    # The text in ASCII apart from one letter, so that it is the same in both encodings up to that letter.
    plain = F.concat(F.lit("é"), F.md5("speech_text"))
    shapes = {
        "whole": [*sp.SPEECH_COLUMNS, F.lit("p").alias("party")],
        "partyless": [F.when(F.col("speech_order") % 7 == 0, "x").otherwise(F.col(c).cast("string")).alias(c) if c == "session" else c for c in sp.SPEECH_COLUMNS],
        "short": list(sp.SPEECH_COLUMNS[:8]),
        "long": [*sp.SPEECH_COLUMNS, F.lit("p").alias("party"), F.lit("q").alias("more")],
        "foreign": [*(F.lit(None).cast("string").alias(c) if c in ("meeting_no", "date") else c for c in sp.SPEECH_COLUMNS[:-1]), plain.alias("speech_text")],
        "bare": [F.lit("").alias("value")],
    }
    for kind, columns in shapes.items():
        part = rows.filter(F.col("kind") == kind).select(*columns, *keys).repartition(sp.SESSION_KEY)
        part = part.dropDuplicates() if kind == "bare" else part
        (
            part.write.partitionBy(sp.SESSION_KEY, sp.MEETING_KEY)
            .option("header", kind != "bare")
            .option("escape", '"')
            .option("encoding", "ISO-8859-1" if kind == "foreign" else "UTF-8")
            .option("mapreduce.output.basename", f"{kind}_speeches")
            .csv(f"{root}/{kind}")
        )
    return f"{root}/*"


def rejected_by_reason(spark, sf):
    """Rows of damaged files by kind of file, session and reason; sound ones have none."""
    checked = sp.read_checked(spark, damaged_files(spark, sf), sp.PARTITIONED)
    kind = F.regexp_extract("file_name", "^([a-z]+)_", 1)
    return checked.groupBy(kind.alias("kind"), "session_name", F.coalesce("reason", F.lit("sound")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("raw").alias("raw_records"), F.sum("speech_order").alias("orders")
    )


def files_accounted(spark, sf):
    """What every damaged file gave, summed by kind and session; a file that gave nothing counts too."""
    root = damaged_files(spark, sf)
    account = sp.file_account(spark, root, sp.read_checked(spark, root, sp.PARTITIONED), sp.PARTITIONED)
    return account.groupBy(
        F.regexp_extract("file_path", "/([a-z]+)_speeches[^/]*$", 1).alias("kind"),
        F.regexp_extract("file_path", f"{sp.SESSION_KEY}=([^/]+)/", 1).alias("session_name"),
        F.coalesce("reason", F.lit("read")).alias("reason"),
    ).agg(F.sum("rows").alias("rows"), F.sum("sound").alias("sound"), F.sum("rejected").alias("rejected"))


def replaced_artifacts(spark, sf):
    """Stored rows after some sessions changed: of three, one is left alone, one gets new rows, one has none left."""
    root = run_folder(spark, "result-tables")
    number = F.regexp_extract("session_name", r"(\d+)", 1).cast("int")
    rows = ds.texts(spark, sf).groupBy("session_name", F.col("agenda_item_titles").alias("issue_keyword"))
    first = rows.agg(F.count(F.lit(1)).cast("int").alias("frequency")).withColumn("session_id", natural_key(F.lit("session"), F.col("session_name")))
    tables.replace_sessions(first, "issue_trends", root)
    stored = tables.read_table(spark, "issue_trends", root)
    worklist = first.select("session_name").distinct().filter(number % 3 != 0)
    incoming = first.filter((number % 3 == 1) & (F.col("frequency") % 2 == 0)).withColumn("notes", F.lit("again"))
    tables.replace_sessions(incoming, "issue_trends", root, worklist)
    stored = tables.read_table(spark, "issue_trends", root)
    return stored.select("session_name", "issue_keyword", "frequency", F.coalesce("notes", F.lit("first")).alias("run"))


def swapped_snapshot(spark, sf):
    """Two tables changed by three runs, of which the last stopped before its commit: the second one's state is read."""
    root = run_folder(spark, "snapshot-tables")
    number = F.regexp_extract("session_name", r"(\d+)", 1).cast("int")
    rows = ds.texts(spark, sf).groupBy("session_name", F.col("agenda_item_titles").alias("issue_keyword"))
    first = rows.agg(F.count(F.lit(1)).cast("int").alias("frequency")).withColumn("session_id", natural_key(F.lit("session"), F.col("session_name")))
    for step in range(3):
        run = snapshots.Run(spark, root)
        stored = tables.read_table(spark, "issue_trends", root) if step else first
        changed = stored.filter((number + step) % 3 != 0) if step else stored
        again = changed.filter((F.col("frequency") + number) % 2 == 0) if step else changed
        new = run.write("issue_trends", tables.conform(again.withColumn("notes", F.lit(f"run {step}")), "issue_trends"), "session_name", changed.select("session_name").distinct())
        if step == 2:
            break
        summed = new.groupBy("session_name").agg(F.sum("frequency").cast("string").alias("summary_text"))
        run.write("sessions", tables.conform(summed, "sessions"), "session_name", changed.select("session_name").distinct())
        run.commit()
    issues, sessions = (tables.read_table(spark, t, root) for t in ("issue_trends", "sessions"))
    return issues.join(sessions.select("session_name", "summary_text"), "session_name", "left").select(
        "session_name", "issue_keyword", "frequency", F.col("notes").alias("run"), F.col("summary_text").cast("long").alias("session_total")
    )


QUERIES = {f.__name__: f for f in (speech_files, one_session_files, enriched_files, copied_headers, rejected_by_reason, files_accounted, replaced_artifacts, swapped_snapshot)}

# --- the same in SQL ------------------------------------------------------------------------------

_F = f"""WITH {ds.SPEECH_SQL}, f AS (SELECT CASE WHEN speech_key % {NO_SESSION} <> 0 THEN session END AS session,
  coalesce(CASE WHEN speech_key % {NO_SESSION} <> 0 THEN CAST(session AS VARCHAR) END, '{values.UNKNOWN}') AS session_name,
  CASE WHEN speech_key % {NO_MEETING} <> 0 THEN meeting_no END AS meeting_no,
  year(d) || '년 ' || month(d) || '월 ' || day(d) || '일(목)' AS date,
  CAST(speech_order AS INTEGER) AS speech_order, agenda_item_titles, nullif(speech_text, '') AS speech_text, speech_key % 10 AS speaker FROM speech)"""

_KIND = f"""{_F}, k AS (SELECT *, [{', '.join(f"'{k}'" for k in KINDS)}][CAST(speech_order % {len(KINDS)} AS INTEGER) + 1] AS kind FROM f),
x AS (SELECT *, CASE WHEN kind = 'short' THEN '{sp.TOO_FEW}' WHEN kind = 'long' THEN '{sp.TOO_MANY}' WHEN kind = 'foreign' THEN '{sp.NOT_UTF8}'
  WHEN session IS NULL OR kind = 'partyless' AND speech_order % 7 = 0 THEN '{sp.NO_NUMBER}' ELSE 'sound' END AS reason FROM k)"""

SQL = {
    "rejected_by_reason": f"""{_KIND} SELECT kind, session_name, reason, count(*) AS rows, count(*) FILTER (WHERE kind IN ('short', 'long')) AS raw_records,
  CAST(sum(speech_order) AS BIGINT) AS orders FROM x WHERE kind <> 'bare' GROUP BY ALL""",
    "files_accounted": f"""{_KIND} SELECT kind, session_name, CASE WHEN kind = 'bare' THEN '{sp.NO_ROWS}' ELSE 'read' END AS reason,
  count(*) FILTER (WHERE kind <> 'bare') AS rows, count(*) FILTER (WHERE kind <> 'bare' AND reason = 'sound') AS sound,
  count(*) FILTER (WHERE kind <> 'bare' AND reason <> 'sound') AS rejected FROM x GROUP BY ALL""",
    "speech_files": f"{_F} SELECT session_name, session, meeting_no, date, speech_order, sha256(speech_text) AS text_sha256 FROM f",
    "one_session_files": f"{_F} SELECT session_name, speech_order, CAST(NULL AS VARCHAR) AS party, length(speech_text) AS characters FROM f WHERE session = 418",
    "enriched_files": f"""{_F} SELECT session_name, speech_order, CASE WHEN speaker = 7 THEN '미분류' ELSE 'p' || speaker END AS speaker_party,
  sha256(speech_text) AS text_sha256 FROM f""",
    "copied_headers": f"{_F} SELECT session_name, meeting_no, '의사일정' AS section, speech_order AS item_order, agenda_item_titles AS item_text FROM f",
    "replaced_artifacts": f"""WITH {ds.SPEECH_SQL}, t AS (SELECT session_name, session, agenda_item_titles AS issue_keyword, CAST(count(*) AS INTEGER) AS frequency
  FROM speech GROUP BY ALL)
SELECT session_name, issue_keyword, frequency, CASE session % 3 WHEN 0 THEN 'first' ELSE 'again' END AS run FROM t
WHERE session % 3 = 0 OR session % 3 = 1 AND frequency % 2 = 0""",
    "swapped_snapshot": f"""WITH {ds.SPEECH_SQL}, t AS (SELECT session_name, session, agenda_item_titles AS issue_keyword, CAST(count(*) AS INTEGER) AS frequency
  FROM speech GROUP BY ALL), k AS (SELECT *, CASE WHEN (session + 1) % 3 = 0 THEN 'run 0' ELSE 'run 1' END AS run FROM t
  WHERE (session + 1) % 3 = 0 OR (frequency + session) % 2 = 0)
SELECT session_name, issue_keyword, frequency, run, CAST(sum(frequency) OVER (PARTITION BY session_name) AS BIGINT) AS session_total FROM k""",
}
