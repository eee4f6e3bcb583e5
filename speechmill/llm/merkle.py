"""Merkle fixity audit of WARC replicas.

Records are hashed once, ordered offset ranges of a file are hashed into a tree, the roots of two
replicas are compared, and only the branches that differ are followed down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import stored

PRIMARY, REPLICA = "primary", "replica"


def warc_record(url: Column, payload: Column) -> Column:
    """One WARC response record as text; null url or payload counts as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, file: str, record_id: str, record: str) -> DataFrame:
    """``file, record_id, record_offset, length, digest`` of every record.

    Records of a file follow each other by ``record_id``, equal ids by digest. Only lengths and
    digests are shuffled; a file is a bounded unit (WARC files are cut at about a gigabyte).
    A null record counts as an empty one of length 0; null ids come first.
    """
    from pyspark.sql import Window

    data = F.coalesce(F.col(record), F.lit(""))
    narrow = records.select(
        F.col(file).cast("string").alias("file"),
        F.col(record_id).cast("long").alias("record_id"),
        F.octet_length(data).cast("long").alias("length"),
        F.sha2(data, 256).alias("digest"),
    )
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("record_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _node(*order: str) -> Column:
    """Hash of the children in order, each with its place."""
    place = [F.col(c) for c in order]
    children = F.array_sort(F.collect_list(F.struct(*place, F.col("hash"))))
    texts = F.transform(children, lambda c: F.concat_ws(":", *[c[o].cast("string") for o in order], c["hash"]))
    return F.sha2(F.array_join(texts, ","), 256).alias("hash")


def trees(leaf_rows: DataFrame, range_bits: int, fan_bits: int, levels: int) -> list[DataFrame]:
    """Node tables from the lowest ranges to the root of each file, for both replicas at once.

    A node of level ``l`` covers ``2 ** (range_bits + fan_bits * l)`` bytes, so a group has at most
    one range of records or ``2 ** fan_bits`` children; the root has a file's top ranges.
    """
    hashed = leaf_rows.select(
        "side",
        "file",
        F.expr(f"shiftright(record_offset, {range_bits})").alias("node0"),
        "record_offset",
        "length",
        F.col("digest").alias("hash"),
    )
    nodes = [stored(hashed.groupBy("side", "file", "node0").agg(_node("record_offset", "length")), "merkle-nodes")]
    for level in range(1, levels):
        below, here = f"node{level - 1}", f"node{level}"
        parent = nodes[-1].withColumn(here, F.expr(f"shiftright({below}, {fan_bits})"))
        nodes.append(parent.groupBy("side", "file", here).agg(_node(below)))
    nodes.append(nodes[-1].groupBy("side", "file").agg(_node(f"node{levels - 1}")))
    return nodes


def _differing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hash differs between the two replicas or that only one of them has."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("hash")))
    return rows.groupBy(*keys).agg(side(PRIMARY).alias("a"), side(REPLICA).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def fixity_audit(primary: DataFrame, replica: DataFrame, range_bits: int = 18, fan_bits: int = 4, levels: int = 4) -> DataFrame:
    """Records that differ between two replicas, given the ``leaves`` of each.

    One row per file and offset: ``file, record_offset, record_id, status`` (``changed``, ``missing``
    in the replica, ``extra`` in it), and length and digest of either side. Equal replicas and empty
    tables give no rows. A shift of all later offsets shows as missing and extra records. Rows
    with one offset in a file (empty records) are compared as a set.
    """
    columns = ["file", "record_offset", "record_id", "length", "digest"]
    sides = primary.select(F.lit(PRIMARY).alias("side"), *columns).unionByName(replica.select(F.lit(REPLICA).alias("side"), *columns))
    # A null file is a file of its own, which joins must find too.
    coded = F.coalesce(F.concat(F.lit("f"), F.col("file").cast("string")), F.lit("-"))
    rows = stored(sides.withColumn("file", coded), "merkle-leaves")
    nodes = trees(rows, range_bits, fan_bits, levels)
    bad = _differing(nodes[-1], ["file"])
    for level in range(levels - 1, -1, -1):
        here = nodes[level]
        if level == levels - 1:
            branch = here.join(bad, "file", "left_semi")
        else:
            above = f"node{level + 1}"
            branch = here.withColumn(above, F.expr(f"shiftright(node{level}, {fan_bits})")).join(bad, ["file", above], "left_semi")
        bad = _differing(branch, ["file", f"node{level}"])
    suspects = rows.withColumn("node0", F.expr(f"shiftright(record_offset, {range_bits})")).join(bad, ["file", "node0"], "left_semi")
    of = lambda s, c, f=F.max: f(F.when(F.col("side") == s, F.col(c)))
    digests = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("digest")))), ",")
    found = suspects.groupBy("file", "record_offset").agg(
        F.coalesce(of(PRIMARY, "record_id"), of(REPLICA, "record_id")).alias("record_id"),
        of(PRIMARY, "length").alias("primary_length"),
        of(REPLICA, "length").alias("replica_length"),
        F.nullif(digests(PRIMARY), F.lit("")).alias("primary_sha256"),
        F.nullif(digests(REPLICA), F.lit("")).alias("replica_sha256"),
    )
    status = (
        F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("primary_sha256").isNull(), "extra").otherwise("changed")
    )
    name = F.when(F.col("file") != "-", F.substring("file", 2, 1 << 30))
    return found.filter(~F.col("primary_sha256").eqNullSafe(F.col("replica_sha256"))).withColumn("status", status).withColumn("file", name)
