"""Fixity audit of web archives by Merkle trees over ordered offset ranges.

Leaves are the SHA-256 digests of records. A node of the lowest level covers ``span`` bytes of offsets
of one archive and digests, in order of offset, the records that begin there; a node above covers
``fan`` nodes. Two replicas are compared at the roots, and only below nodes that differ does the audit
descend, down to the records. All levels are DataFrame aggregations; a node has at most ``fan`` children
and a range at most as many records as can begin in it.

Defined results: a record with null content digests as empty content; a record without an archive or
offset takes no part. Repeated rows (same archive, offset and content) count once; rows that disagree on
one offset are ordered by digest and all belong to the leaf. Empty tables give no findings. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxon.llm.common import written


@dataclass(frozen=True)
class Tree:
    """Documented parameters: bytes covered by a lowest node, children of the others."""

    span: int = 1 << 16
    fan: int = 16


def warc_record(uri: Column, body: Column, record_id: Column) -> Column:
    """Text of a WARC/1.1 resource record; its length in bytes is that of its UTF-8 form."""
    content = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"),
    )


def warc_archives(pages: DataFrame, key: str, uri: str, body: str, per_archive: int = 1000) -> DataFrame:
    """``archive, offset, length, record_id, content``: pages laid into archives of about so many records.

    Archives take consecutive ids, which bounds the window that sums the offsets.
    """
    rows = pages.filter(F.col(key).isNotNull()).select(
        F.floor(F.col(key) / per_archive).cast("long").alias("archive"), F.col(key).alias("record_id"),
        warc_record(F.col(uri), F.col(body), F.col(key)).alias("content"),
    ).withColumn("length", F.octet_length("content").cast("long"))
    order = Window.partitionBy("archive").orderBy("record_id", "length").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def leaves(records: DataFrame) -> DataFrame:
    """``archive, offset, digest`` of each distinct record."""
    return (
        records.filter(F.col("archive").isNotNull() & F.col("offset").isNotNull())
        .select("archive", "offset", F.sha2(F.coalesce(F.col("content"), F.lit("")).cast("binary"), 256).alias("digest"))
        .distinct()
    )


def _node(children: DataFrame, place: Column) -> DataFrame:
    """Parents of ``archive, place, digest`` rows."""
    inside = F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), F.col("digest").alias("d"))))
    joined = F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["p"].cast("string"), x["d"])), ";")
    return children.groupBy("archive", place.alias("up")).agg(F.sha2(joined, 256).alias("digest")).select("archive", F.col("up").alias("place"), "digest")


def build(records: DataFrame, name: str, tree: Tree = Tree()) -> list[DataFrame]:
    """The stored levels of a replica's trees: records first, then ranges, one root for each archive last."""
    bottom = written(leaves(records), f"{name}-leaves")
    levels = [bottom.select("archive", F.col("offset").alias("place"), "digest")]
    last = bottom.agg(F.max("offset")).first()[0] or 0
    width = last // tree.span
    levels.append(written(_node(levels[0], F.floor(F.col("place") / tree.span).cast("long")), f"{name}-ranges"))
    while width:
        width //= tree.fan
        levels.append(written(_node(levels[-1], F.floor(F.col("place") / tree.fan).cast("long")), f"{name}-nodes"))
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("archive", "place", F.col("digest").alias("left_digest"))
    b = right.select("archive", "place", F.col("digest").alias("right_digest"))
    return a.join(b, ["archive", "place"], "full").filter(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def audit(left: list[DataFrame], right: list[DataFrame], tree: Tree = Tree()) -> DataFrame:
    """``archive, offset, finding, left_digest, right_digest`` of every record that differs.

    ``finding`` is changed, missing (only on the left) or extra (only on the right).
    """
    while len(left) < len(right):  # the smaller replica may need fewer levels
        left = [*left, _node(left[-1], F.floor(F.col("place") / tree.fan).cast("long"))]
    while len(right) < len(left):
        right = [*right, _node(right[-1], F.floor(F.col("place") / tree.fan).cast("long"))]
    open_: DataFrame | None = None
    for level in range(len(left) - 1, 0, -1):
        a, b = left[level], right[level]
        if open_ is not None:
            step = tree.fan
            above = open_.select("archive", F.col("place").alias("up"))
            a, b = (
                t.withColumn("up", F.floor(F.col("place") / step).cast("long")).join(above, ["archive", "up"], "left_semi").select("archive", "place", "digest")
                for t in (a, b)
            )
        open_ = written(_differing(a, b), "differing")
    above = open_.select("archive", F.col("place").alias("up"))
    ends = [
        t.withColumn("up", F.floor(F.col("place") / tree.span).cast("long"))
        .join(above, ["archive", "up"], "left_semi")
        .groupBy("archive", "place")
        .agg(F.array_join(F.array_sort(F.collect_set("digest")), "+").alias("digest"))
        for t in (left[0], right[0])
    ]
    finding = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return _differing(*ends).select("archive", F.col("place").alias("offset"), finding.alias("finding"), "left_digest", "right_digest")
