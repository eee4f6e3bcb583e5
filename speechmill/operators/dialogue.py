"""Question-answer pairs, stratified samples and the text blocks built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import join_lines, text_array
from speechmill.operators.rollups import top_k
from speechmill.session import kept

LABEL = values.PROMPT


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    return F.exists(text_array(markers), lambda m: F.contains(text, m))


def qa_pairs(
    df: DataFrame,
    session: str = "session_name",
    file: str = "file_name",
    order: str = "speech_order",
    carry: Sequence[str] = ("speaker_name", "party", "agenda_item_titles"),
    text: str = "speech_text",
    question_markers: Sequence[str] = values.QUESTION_MARKERS,
    answer_markers: Sequence[str] = values.ANSWER_MARKERS,
    cut: int = 500,
    across_files: bool = True,
    block: int = 65_536,
) -> DataFrame:
    """Neighbouring speeches where the first asks and the next answers.

    Rows are ordered by file, then by order inside it; pairs may cross from one file to the next
    of the same session. A session can be most of the table, so it is never sorted in one task:
    neighbours are found inside blocks of ``block`` consecutive orders of a file, and the first
    and last row of every block are then matched across block borders.
    """
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    is_question, is_answer = contains_any(folded, question_markers), contains_any(folded, answer_markers)
    rows = df.select(
        session,
        file,
        F.floor(F.col(order) / block).alias("_block"),
        F.col(order),
        F.struct(
            F.col(order).alias("order"),
            F.col(file).alias("file"),
            is_question.alias("asks"),
            is_answer.alias("answers"),
            *[F.col(c) for c in carry],
            F.when(is_question | is_answer, F.substring(text, 1, cut)).alias("text"),
        ).alias("_row"),
    )
    place = [session, file, "_block"]
    inner = rows.select(
        session, F.col("_row").alias("q"), F.lead("_row").over(Window.partitionBy(*place).orderBy(order)).alias("a")
    )
    edges = rows.groupBy(*place).agg(
        F.min_by("_row", order).alias("_head"), F.max_by("_row", order).alias("_tail")
    )
    scope = [session] if across_files else [session, file]
    border = Window.partitionBy(*scope).orderBy(file, "_block")
    outer = edges.select(session, F.col("_tail").alias("q"), F.lead("_head").over(border).alias("a"))
    both = inner.unionByName(outer).filter(F.col("q.asks") & F.col("a.answers"))
    fields = [
        F.col(session),
        F.col("q.file").alias("question_file"),
        F.col("q.order").alias("question_order"),
        F.col("q.text").alias("question"),
        F.col("a.text").alias("answer"),
    ]
    fields += [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("q", "question"), ("a", "answer")) for c in carry]
    return both.select(*fields)


def hash_order(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows, the same on every run."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def stratified_sample(
    df: DataFrame, strata: Sequence[str], key: str, per_stratum: int = 5, seed: int = 42, rank: str = "sample_rank"
) -> DataFrame:
    """Up to ``per_stratum`` rows of every stratum, chosen by hash order."""
    return top_k(df, strata, [hash_order(F.col(key), seed), F.col(key)], per_stratum, rank)


def session_sample(
    df: DataFrame,
    session: str = "session_name",
    party: str = "party",
    appearance: Sequence[str] = ("file_name", "speech_order"),
    key: str = "speech_key",
    parties: int = 5,
    per_party: int = 5,
    limit: int = 20,
    seed: int = 42,
) -> DataFrame:
    """Sample of a session: its first parties in order of appearance, a few speeches each."""
    first = df.filter(F.col(party).isNotNull()).groupBy(session, party).agg(
        F.min(F.struct(*appearance)).alias("_first")
    )
    first = top_k(first, [session], [F.col("_first"), F.col(party)], parties, "party_rank").drop("_first")
    picked = stratified_sample(df, [session, party], key, per_party, seed).join(first, [session, party])
    return top_k(picked, [session], [F.col("party_rank"), F.col("sample_rank")], limit, "sample_no")


def leading_agendas(
    df: DataFrame, session: str = "session_name", agenda: str = "agenda_item_titles", k: int = 3, speeches: Column | None = None
) -> DataFrame:
    """Most discussed agendas per session; blank titles are dropped after the cut.

    ``speeches`` is the aggregate that counts them: rows by default, a sum where rows are counts already.
    """
    size = F.count(F.lit(1)) if speeches is None else speeches
    counted = df.filter(F.col(agenda).isNotNull()).groupBy(session, agenda).agg(size.alias("speeches"))
    return top_k(counted, [session], [F.desc("speeches"), F.asc(agenda)], k, "agenda_rank").filter(
        F.trim(agenda) != ""
    )


def agenda_sample(
    df: DataFrame,
    agendas: DataFrame,
    session: str = "session_name",
    agenda: str = "agenda_item_titles",
    party: str = "party",
    key: str = "speech_key",
    per_party: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Sampled speeches per leading agenda and party.

    Every agenda is sampled, which reduces it inside the tasks, and only the samples are joined.
    """
    picked = stratified_sample(df.filter(F.col(party).isNotNull()), [session, agenda, party], key, per_party, seed)
    return picked.join(
        agendas.select(session, agenda, "agenda_rank", F.col("speeches").alias("agenda_speeches")), [session, agenda]
    )


def agenda_payload(sample: DataFrame, session: str, agenda: str, party: str, text: str, cut: int = 400) -> DataFrame:
    """One row per agenda with its party samples as a map of lists."""
    lists = sample.groupBy(session, agenda, "agenda_rank", "agenda_speeches", party).agg(
        F.sort_array(F.collect_list(F.struct("sample_rank", F.substring(text, 1, cut).alias("text")))).alias("_s")
    )
    return lists.groupBy(session, agenda, "agenda_rank", "agenda_speeches").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col(party), F.transform("_s", lambda s: s["text"]))))
        ).alias("party_speeches")
    )


def ranked_lines(counted: DataFrame, by: Sequence[str], label: str, n: str, k: int | None, out: str, unit: str) -> DataFrame:
    """``- label: n unit`` lines per group, most frequent first, as one text."""
    window = Window.partitionBy(*by).orderBy(F.desc(n), F.asc(label))
    ranked = counted.withColumn("_rank", F.row_number().over(window))
    if k is not None:
        ranked = ranked.filter(F.col("_rank") <= k)
    line = F.concat(F.lit("- "), F.col(label), F.lit(": "), F.col(n).cast("string"), F.lit(unit))
    return (
        ranked.groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", line.alias("line")))).alias("_lines"))
        .select(*by, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias(out))
    )


def _session_cells(df: DataFrame, session: str, agenda: str, party: str) -> DataFrame:
    return kept(df.groupBy(session, agenda, party).agg(F.count(F.lit(1)).alias("n")), "session-cells")


def session_payload(
    df: DataFrame,
    sample: DataFrame,
    session: str = "session_name",
    agenda: str = "agenda_item_titles",
    party: str = "party",
    speaker: str = "speaker_name",
    text: str = "speech_text",
    cut: int = 300,
    most: int = 20,
) -> DataFrame:
    """One row per session: ``total_speeches, agenda_stats, party_stats, speeches_sample``.

    The statistics are maps from agenda or party to its speeches; blank agendas and null parties are left
    out. The sample holds party, speaker and the first ``cut`` characters of at most ``most`` sampled
    speeches by ``sample_no``. Counts are formed before a session's values meet in one row; a session
    without any has empty maps and an empty sample. The speeches are read once, into stored counts by
    session, agenda and party.
    """
    cells = _session_cells(df, session, agenda, party)

    def counts(column: str, out: str) -> DataFrame:
        counted = cells.filter(F.trim(column) != "").groupBy(session, column).agg(F.sum("n").alias("n"))
        return counted.groupBy(session).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(out))

    spoken = F.struct("sample_no", F.col(party).alias("party"), F.col(speaker).alias("speaker"), F.substring(text, 1, cut).alias("text"))
    samples = sample.filter(F.col("sample_no") <= most).groupBy(session).agg(F.sort_array(F.collect_list(spoken)).alias("_s"))
    rows = cells.groupBy(session).agg(F.sum("n").alias("total_speeches"))
    for more in (counts(agenda, "agenda_stats"), counts(party, "party_stats"), samples):
        rows = rows.join(more, session, "left")
    none = F.create_map().cast("map<string,bigint>")
    plain = F.transform("_s", lambda x: F.struct(x["party"].alias("party"), x["speaker"].alias("speaker"), x["text"].alias("text")))
    empty = F.array().cast("array<struct<party:string,speaker:string,text:string>>")
    return rows.select(
        session,
        "total_speeches",
        F.coalesce("agenda_stats", none).alias("agenda_stats"),
        F.coalesce("party_stats", none).alias("party_stats"),
        F.coalesce(plain, empty).alias("speeches_sample"),
    )


def session_prompt(
    df: DataFrame,
    sample: DataFrame,
    session: str = "session_name",
    agenda: str = "agenda_item_titles",
    party: str = "party",
    speaker: str = "speaker_name",
    text: str = "speech_text",
    cut: int = 300,
    instructions: str = "",
) -> DataFrame:
    """Text block per session: totals, agenda and party statistics and the sampled speeches.

    The lists are already reduced when they are gathered: ten agendas, one line per party, and the
    bounded sample. The speeches are read once, into stored counts by session, agenda and party.
    """
    cells = _session_cells(df, session, agenda, party)
    totals = cells.groupBy(session).agg(F.sum("n").alias("total"))
    agendas = cells.filter(F.trim(agenda) != "").groupBy(session, agenda).agg(F.sum("n").alias("n"))
    parties = cells.filter(F.col(party).isNotNull()).groupBy(session, party).agg(F.sum("n").alias("n"))
    entry = F.concat(
        F.lit("["), F.col("sample_no").cast("string"), F.lit(LABEL["sample_party"]), F.col(party),
        F.lit(LABEL["sample_speaker"]), F.col(speaker), F.lit("\n" + LABEL["sample_text"]), F.substring(text, 1, cut),
    )
    samples = (
        sample.groupBy(session)
        .agg(F.sort_array(F.collect_list(F.struct("sample_no", entry.alias("entry")))).alias("_e"))
        .select(
            session,
            F.size("_e").alias("sampled"),
            F.array_join(F.transform("_e", lambda x: x["entry"]), "\n\n").alias("sample_text"),
        )
    )
    blocks = (
        totals.join(ranked_lines(agendas, [session], agenda, "n", 10, "agenda_text", LABEL["speeches"]), session, "left")
        .join(ranked_lines(parties, [session], party, "n", None, "party_text", LABEL["speeches"]), session, "left")
        .join(samples, session, "left")
    )
    prompt = join_lines(
        F.lit(LABEL["session"]),
        F.concat(F.lit(LABEL["session_name"]), F.col(session)),
        F.concat(
            F.lit(LABEL["total"]), F.col("total").cast("string"), F.lit(LABEL["sampled"]),
            F.coalesce("sampled", F.lit(0)).cast("string"), F.lit(LABEL["count_end"] + "\n"),
        ),
        F.lit(LABEL["agendas"]),
        F.concat(F.coalesce("agenda_text", F.lit(LABEL["no_agendas"])), F.lit("\n")),
        F.lit(LABEL["parties"]),
        F.concat(F.coalesce("party_text", F.lit("")), F.lit("\n")),
        F.lit(LABEL["samples"]),
        F.coalesce("sample_text", F.lit("")),
        F.lit(instructions),
    )
    return blocks.select(session, prompt.alias("prompt"))


def agenda_prompt(payload: DataFrame, session: str, agenda: str, instructions: str = "") -> DataFrame:
    """Text block per agenda from its nested party samples."""
    sections = F.transform(
        F.map_entries("party_speeches"),
        lambda e: F.concat(
            F.lit(LABEL["party"]), e["key"], F.lit("]\n"),
            F.array_join(
                F.transform(e["value"], lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n"
            ),
        ),
    )
    prompt = join_lines(
        F.lit(LABEL["agenda"]),
        F.concat(F.lit(LABEL["agenda_name"]), F.col(agenda)),
        F.concat(F.lit(LABEL["total"]), F.col("agenda_speeches").cast("string"), F.lit(LABEL["count"] + "\n")),
        F.lit(LABEL["party_samples"]),
        F.array_join(sections, "\n\n"),
        F.lit(instructions),
    )
    return payload.select(session, agenda, prompt.alias("prompt"))


def qa_prompt(pairs: DataFrame, session: str = "session_name", k: int = 10, instructions: str = "") -> DataFrame:
    """Text block per session from its first question-answer pairs."""
    first = top_k(pairs, [session], [F.col("question_file"), F.col("question_order")], k, "pair_no")
    entry = F.concat(
        F.lit(LABEL["pair"]), F.col("pair_no").cast("string"),
        F.lit("]\n" + LABEL["questioner"]), F.col("question_party"), F.lit("): "), F.col("question_speaker_name"),
        F.lit("\n" + LABEL["question"]), F.col("question"),
        F.lit("\n" + LABEL["respondent"]), F.col("answer_party"), F.lit("): "), F.col("answer_speaker_name"),
        F.lit("\n" + LABEL["answer"]), F.col("answer"),
    )
    return (
        first.groupBy(session)
        .agg(F.sort_array(F.collect_list(F.struct("pair_no", entry.alias("entry")))).alias("_e"))
        .select(
            session,
            join_lines(
                F.lit(LABEL["pairs"]),
                F.array_join(F.transform("_e", lambda x: x["entry"]), "\n\n"),
                F.lit(instructions),
            ).alias("prompt"),
        )
    )
