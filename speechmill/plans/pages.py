"""Header and speech rows out of the given web pages.

The given pages hold no meeting markup, so the layout patterns name what they do have: paragraphs
as speeches, list items and bold openings as agenda bars, the heading as the time mark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import pages as pg
from speechmill.operators import rollups
from speechmill.plans import dataset as ds
from speechmill.session import spread

LAYOUT = pg.Markup(
    turn=r"(?s)<title>(.*?)</title>",
    session=r"(\d+)",
    session_type=r"([A-Z][a-z]+)",
    meeting=r"(?s)<h2>(.*?)</h2>",
    meeting_fallback=r"([A-Z]\S+ing)",
    date=r"(?s)<h1>(.*?)</h1>",
    sections=(("links", r"(?s)<nav><ul>(.*?)</ul></nav>"),),
    date_section="heading",
    speaker=r"<p>",
    bar=r"<(?:li|b)>",
    time=r"<h1>",
    bar_text=r"(?s)^<(?:li|b)>(.*)",
    time_text=r"(?s)^<h1>(.*?)</h1>",
    member_id=r"^<p>(\w*)",
    name=r"^<p>([A-Z]\w*)",
    name_fallback=r"^<p>([^<]{0,5})",
    position=r"(?s)^<p>[^.]*\.([^.<]*)",
    position_fallback=r"^<q>(.*)",
    area=r"(\d+)",
    talk=r"(?s)^<p>(.*?)(?:</p>|\z)",
)


def source(spark, sf):
    return spread(ds.table(spark, sf, "pages"), "page_id")


def page_headers(spark, sf):
    return pg.page_headers(source(spark, sf), LAYOUT).select(
        "page_id", F.coalesce("session", F.lit(-1)).alias("session"), "session_type", "meeting_no", "date"
    )


def page_header_rows(spark, sf):
    return pg.header_rows(pg.page_headers(source(spark, sf), LAYOUT), LAYOUT).select(
        "page_id", "section", F.coalesce("item_order", F.lit(0)).alias("item_order"), "item_text"
    )


def page_agenda_groups(spark, sf):
    return pg.agenda_groups(source(spark, sf), LAYOUT)


def page_speeches(spark, sf):
    return pg.speech_rows(source(spark, sf), LAYOUT).select(
        "page_id",
        "speech_order",
        "speaker_name",
        "speaker_position",
        "speaker_area",
        F.md5("speech_text").alias("speech"),
        "agenda_item_titles",
        "agenda_item_times",
    )


def page_keys(spark, sf):
    """Keys of all pages, from the header rows or else from the speech rows."""
    pages = source(spark, sf)
    headers = pg.page_headers(pages, LAYOUT)
    listed = pg.header_rows(headers, LAYOUT).select("page_id", "session", "meeting_no").distinct()
    spoken = pg.speech_rows(pages, LAYOUT).select("page_id").distinct()
    return pg.page_keys(listed, headers.select("page_id", "session", "meeting_no").join(spoken, "page_id"))


def path_keys(spark, sf):
    return ds.table(spark, sf, "pages").select("page_id", text.path_safe(F.col("url")).alias("path"))


def page_load_totals(spark, sf):
    """Rows written per kind and language."""
    pages = source(spark, sf)
    lang = pages.select("page_id", F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"))
    headers = pg.header_rows(pg.page_headers(pages, LAYOUT), LAYOUT).select("page_id", F.lit("header").alias("kind"))
    speeches = pg.speech_rows(pages, LAYOUT).select("page_id", F.lit("speech").alias("kind"))
    return rollups.load_totals(headers.unionByName(speeches).join(lang, "page_id"), "kind", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        page_headers, page_header_rows, page_agenda_groups, page_speeches, page_keys, path_keys, page_load_totals,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

from speechmill.plans.dialogues import _markup, _markup_lines  # noqa: E402

_HEAD = f"""WITH head AS (SELECT page_id, html, {_markup("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS turn FROM pages),
hd AS (SELECT page_id, html, TRY_CAST(nullif(regexp_extract(turn, '(\\d+)', 1), '') AS INTEGER) AS session,
  regexp_extract(turn, '([A-Z][a-z]+)', 1) AS session_type,
  regexp_extract({_markup('html')}, '([A-Z][^\\s]+ing)', 1) AS meeting_no,
  {_markup("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS date FROM head)"""
_ITEMS = f"""it AS (SELECT page_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '(?s)<li\\b[^>]*>(.*?)</li>', 1) AS l FROM pages)),
hrow AS (SELECT page_id, 'heading' AS section, 0 AS item_order, date AS item_text FROM hd
  UNION ALL SELECT page_id, 'links', i, regexp_replace({_markup('t')}, '^\\d+\\.\\s*', '') FROM it)"""
_BODY = f"""pc AS (SELECT page_id, unnest(p) AS piece, unnest(range(len(p))) AS pos FROM (
  SELECT page_id, string_split(regexp_replace(html, '(<p>|<li>|<b>|<h1>)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM pages)),
k0 AS (SELECT *, CASE WHEN starts_with(piece, '<p>') THEN 'speaker' WHEN starts_with(piece, '<li>') OR starts_with(piece, '<b>') THEN 'bar'
  WHEN starts_with(piece, '<h1>') THEN 'time' ELSE 'none' END AS kind, len(regexp_extract_all(piece, '<[A-Za-z]')) AS opened FROM pc),
k1 AS (SELECT *, coalesce(sum(opened) OVER b, 0) AS element, coalesce(sum(CASE WHEN kind = 'speaker' THEN 1 ELSE 0 END) OVER b, 0) AS sb,
  sum(CASE WHEN kind IN ('speaker', 'bar') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS st
  FROM k0 WINDOW b AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tm AS (SELECT page_id, st, min(pos) AS pos FROM k1 WHERE kind = 'time' GROUP BY ALL),
br AS (SELECT b.page_id, b.sb, b.pos, {_markup("regexp_extract(b.piece, '(?s)^<(?:li|b)>(.*)', 1)")} AS txt,
  CASE WHEN t.element - b.element <= 12 THEN {_markup("regexp_extract(t.piece, '(?s)^<h1>(.*?)</h1>', 1)")} ELSE '' END AS tm
  FROM k1 b LEFT JOIN tm ON tm.page_id = b.page_id AND tm.st = b.st AND tm.pos > b.pos LEFT JOIN k1 t ON t.page_id = tm.page_id AND t.pos = tm.pos
  WHERE b.kind = 'bar'),
bs AS (SELECT *, regexp_extract(txt, '(?s)^(\\d+)\\.\\s*(.+)', 1) AS num FROM br),
gp AS (SELECT page_id, sb + 1 AS start_order, coalesce(string_agg(nullif(num, ''), ',' ORDER BY pos), '') AS agenda_item_orders,
  coalesce(string_agg(nullif(CASE WHEN num = '' THEN txt ELSE trim(regexp_extract(txt, '(?s)^(\\d+)\\.\\s*(.+)', 2)) END, ''), ' / ' ORDER BY pos), '') AS agenda_item_titles,
  coalesce(string_agg(nullif(tm, ''), ' / ' ORDER BY pos), '') AS agenda_item_times FROM bs GROUP BY page_id, sb),
np AS (SELECT page_id, count(*) AS n FROM k1 WHERE kind = 'speaker' GROUP BY page_id),
grp AS (SELECT gp.* FROM gp JOIN np USING (page_id) WHERE start_order <= n),
sp AS (SELECT page_id, sb + 1 AS speech_order, piece FROM k1 WHERE kind = 'speaker')"""

SQL = {
    "page_headers": f"{_HEAD} SELECT page_id, coalesce(session, -1) AS session, session_type, meeting_no, date FROM hd",
    "page_header_rows": f"{_HEAD}, {_ITEMS} SELECT * FROM hrow",
    "page_agenda_groups": f"WITH {_BODY} SELECT page_id, CAST(start_order AS BIGINT) AS start_order, agenda_item_orders, agenda_item_titles, agenda_item_times FROM grp",
    "page_speeches": f"""WITH {_BODY}, a AS (SELECT s.*, max(g.start_order) AS so FROM sp s LEFT JOIN grp g ON g.page_id = s.page_id AND g.start_order <= s.speech_order GROUP BY ALL)
SELECT a.page_id, CAST(a.speech_order AS BIGINT) AS speech_order,
  coalesce(nullif({_markup("regexp_extract(piece, '^<p>([A-Z][0-9A-Za-z_]*)', 1)")}, ''), trim(regexp_replace(regexp_extract(piece, '^<p>([^<]{{0,5}})', 1), '{ds.SPACE_SQL}+', ' ', 'g'))) AS speaker_name,
  {_markup("regexp_extract(piece, '(?s)^<p>[^.]*[.]([^.<]*)', 1)")} AS speaker_position,
  regexp_extract(piece, '([0-9]+)', 1) AS speaker_area,
  md5({_markup_lines("regexp_extract(piece, '(?s)^<p>(.*?)(?:</p>|$)', 1)")}) AS speech,
  coalesce(g.agenda_item_titles, '') AS agenda_item_titles, coalesce(g.agenda_item_times, '') AS agenda_item_times
FROM a LEFT JOIN grp g ON g.page_id = a.page_id AND g.start_order = a.so""",
    "page_keys": f"""{_HEAD}, {_ITEMS}, {_BODY}, k AS (SELECT page_id, session, meeting_no FROM hd
  WHERE page_id IN (SELECT page_id FROM hrow) OR page_id IN (SELECT page_id FROM sp))
SELECT page_id, coalesce(CAST(session AS VARCHAR), 'unknown') AS session, coalesce(nullif(trim(meeting_no), ''), 'unknown') AS meeting_no FROM k""",
    "path_keys": f"SELECT page_id, {ds.strip_sql('''translate(url, '/\\:?*\"<>|', '___')''')} AS path FROM pages",
    "page_load_totals": f"""{_HEAD}, {_ITEMS}, {_BODY}, a AS (SELECT page_id, 'header' AS kind FROM hrow UNION ALL SELECT page_id, 'speech' FROM sp)
SELECT kind, regexp_extract(html, 'lang="([0-9A-Za-z_]+)"', 1) AS lang, count(*) AS rows FROM a JOIN pages USING (page_id) GROUP BY 1, 2""",
}
