"""Secrets in texts, and credentials in several parts.

Strong patterns are reported where they stand. Access identifiers, secrets and endpoints that are
weak by themselves are reported only if a complementary part is near them. Parts that overlap are one
part and never complement each other: a cover without overlaps is chosen first. Intervals of the cover,
widened by the scope, are joined within a text by a sweep over its sorted parts, without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order of spans that start at one place. Base kinds first.
BASE = ("assign", "access", "hex")
#: Characters that an assigned value must have.
LEAST_VALUE = 12
#: A run of the class is matched from its start, so a least length drops just the shorter runs.
STRONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
WEAK = {
    "identifier": r"(?i:client|account|tenant|app|user|login|access_?key)[_-]?(?i:id|name)?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{4,}",
    "key": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}",
    "endpoint": r"https?://[^\s\"'<>]+",
}
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}
#: Which of overlapping parts stands for them: the first of these. Base spans are reported in any case.
COVER = ("access", "assign", "hex", "endpoint", "identifier", "key")
#: What must be near a weak candidate of each kind: one of the first, and one of the second if there is one.
NEEDS = {"identifier": (("secret",),), "key": (("identifier", "endpoint"),), "endpoint": (("identifier",), ("secret",))}


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (rank, at, gap, size, value): what lies between the matches, and the matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    return F.transform(
        F.arrays_zip(between.alias("gap"), found.alias("match"), values.alias("value")),
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), i.alias("at"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), F.length(m["value"]).alias("value")
        ),
    )


def parts(text: Column) -> Column:
    """All base and weak candidates of one whole text."""
    return F.concat(matches(text, "assign", ASSIGN), *[matches(text, k, p) for k, p in (STRONG | WEAK).items()])


def _joined(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_secrets(docs: DataFrame, scope: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base, spans, n_linked``.

    ``base`` and ``spans`` list kind:start:end in code points, by start and then kind. A weak candidate is
    reported if it is in the cover and complementary parts of the cover (base ones included) begin or end
    within ``scope`` code points of it: an identifier needs a secret, a key an identifier or an endpoint, an
    endpoint both others. The cover takes parts in the order of ``COVER``, those that overlap an earlier one not.
    Null and empty texts have no spans; repeated rows give equal rows; empty tables an empty result; long texts
    are read whole; other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body_key"), F.length(body).alias("body_size"), parts(body).alias("parts"))
    # Only spans are shuffled; equal rows are one from here on.
    key = ["doc_id", "body_key", "body_size"]
    texts = rows.groupBy(*key).agg(F.first("parts").alias("parts"), F.count(F.lit(1)).alias("copies"))
    each = texts.select(*key, "copies", F.explode_outer("parts").alias("part")).select(*key, "copies", "part.*")
    # Places follow from the lengths before. A short value leaves no span, but its match is used up.
    passed = Window.partitionBy(*key, "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(passed)
    each = each.select(*key, "copies", "rank", "size", end.alias("end"), ((F.col("rank") > 0) | (F.col("value") >= LEAST_VALUE)).alias("valid"))
    each = each.withColumn("start", F.col("end") - F.col("size"))

    each = each.withColumn("is_base", F.col("valid") & (F.col("rank") < len(BASE)))
    # One order serves every step: the next part of a kind is the one that starts first.
    by = Window.partitionBy(*key).orderBy("start", "rank", "end")
    back = by.rowsBetween(Window.unboundedPreceding, -1)

    def ends_before(which: Column) -> Column:
        return F.max(F.when(which, F.col("end"))).over(back)

    def starts_after(which: str) -> Column:
        return F.expr(f"lead(if({which}, start, null), 1) ignore nulls over (partition by {', '.join(key)} order by start, rank, end)")

    each = each.withColumn("cover", F.lit(False))
    for kind in COVER:
        overlaps = (ends_before(F.col("cover")) > F.col("start")) | (starts_after("cover") < F.col("end"))
        mine = F.col("valid") & (F.col("rank") == KINDS.index(kind))
        each = each.withColumn("cover", F.col("cover") | (mine & ~F.coalesce(overlaps, F.lit(False))))
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    each = each.withColumn("role", F.when(F.col("cover"), F.get(roles, F.col("rank"))))
    near = {}
    for role in ("identifier", "secret", "endpoint"):
        near[role] = F.coalesce(
            (ends_before(F.col("role") == role) >= F.col("start") - scope) | (starts_after(f"role = '{role}'") <= F.col("end") + scope), F.lit(False)
        )
    linked = F.lit(False)
    for kind, needs in NEEDS.items():
        enough = F.lit(True)
        for group in needs:
            any_of = F.lit(False)
            for role in group:
                any_of = any_of | near[role]
            enough = enough & any_of
        linked = linked | ((F.col("rank") == KINDS.index(kind)) & enough)
    told = each.withColumn("told", F.coalesce(F.col("is_base") | (F.col("cover") & linked), F.lit(False)))
    one = F.struct("start", "rank", "end")
    gathered = told.groupBy(*key, "copies").agg(
        F.array_sort(F.collect_list(F.when(F.col("told"), one))).alias("told"),
        *[F.count_if(F.col("valid") & (F.col("rank") == i)).alias(f"n_{k}") for i, k in enumerate(BASE)],
    )
    base = F.filter("told", lambda s: s["rank"] < len(BASE))
    out = gathered.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        _joined(base).alias("base"),
        _joined(F.col("told")).alias("spans"),
        (F.size("told") - F.size(base)).cast("long").alias("n_linked"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
