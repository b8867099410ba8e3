"""Near-duplicate groups by one-permutation hashing.

One hash per shingle fills the bins of a signature; empty bins borrow from a bin that their own
random probing meets first (optimal densification). Bands of bins make buckets. Inside a bucket the
candidate edges form a star: every member is compared with one hub, so pairs grow with the members
and not with their square. The hub is the member that meets most others over all its buckets, which
finds the text that copies stem from. Members outside the hub's component form a new, smaller star in
the next round; rounds end with the first that joins no two components. What buckets then still hold of
several components is joined exactly: two sets that are alike share one of their rarest shingles. Every
edge is confirmed on the full shingle sets.

Copies with equal shingle sets are one node from the start and never become pairs.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing. A text of fewer words than a shingle is one shingle of all its words. Rows with the same id
count as one document with several texts. A row without an id is linked only by equal sets; its group
is named by the smallest id in it, null if there is none, and it is not kept. Lower-casing and
splitting touch ASCII only. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import chunks, code_points, mixed, powers, private, run_hashes, runs, written

PROBES = 64
SALTED = 256  # rows of a shingle for each salt


@dataclass(frozen=True)
class Banding:
    """36 bands of 6 bins: a pair at similarity 0.85 shares no band once in 24 million times."""

    bands: int = 36
    rows: int = 6
    words: int = 5
    percent: int = 85

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    codes, text_starts = code_points(texts)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    mask = (codes != 32) & ((codes < 9) | (codes > 13))
    starts, ends = runs(mask)
    words = run_hashes(codes, mask, starts, ends)
    first = np.searchsorted(starts, text_starts)
    last = np.append(first[1:], len(starts))
    n = max(0, len(words) - size + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        shingles += words[k : k + n] * powers(size + 1)[k]
    shingles = mixed(shingles + np.uint64(size))
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            whole = np.add.reduce(words[a:b] * powers(size + 1)[: b - a])
            out.append(mixed(np.array([whole + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _probing(bins: int) -> np.ndarray:
    """Fixed random order in which each empty bin looks for one to borrow from."""
    return (mixed(np.arange(bins * PROBES, dtype=np.uint64) + np.uint64(77)) % np.uint64(bins)).astype(np.int64).reshape(bins, PROBES)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sets, one row for each."""
    width = (1 << 64) // bins + 1
    bounds = np.array([k * width for k in range(bins)], dtype=np.uint64)
    values = np.empty((len(sets), bins), dtype=np.uint64)
    full = np.empty((len(sets), bins), dtype=bool)
    for r, own in enumerate(sets):
        at = np.searchsorted(own, bounds)
        full[r] = np.diff(at, append=len(own)) > 0
        values[r] = own[np.minimum(at, len(own) - 1)]  # sorted, so the first of a bin is its minimum
    source = np.broadcast_to(np.arange(bins), full.shape).copy()
    empty = ~full
    probing = _probing(bins)
    for k in range(PROBES):
        if not empty.any():
            break
        hit = empty & full[:, probing[:, k]]
        source[hit] = np.broadcast_to(probing[:, k], full.shape)[hit]
        empty &= ~hit
    for r in np.flatnonzero(empty.any(axis=1)):  # very few full bins: the next full one to the right
        filled = np.flatnonzero(full[r])
        lost = np.flatnonzero(empty[r])
        source[r, lost] = filled[np.searchsorted(filled, lost) % len(filled)]
    return np.take_along_axis(values, source, axis=1)


def band_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = signature.reshape(len(signature), banding.bands, banding.rows)
    key = np.broadcast_to(np.arange(1, banding.bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(banding.rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def signed_documents(docs: DataFrame, key: str, text: str, banding: Banding) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` of each row; no key and no bands for an empty set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for run in chunks(batch["text"]):
                sets = shingle_sets(run, banding.words)
                n = np.array([len(s) for s in sets])
                keys: list[bytes | None] = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bands: list[np.ndarray | None] = [None] * len(sets)
                some = np.flatnonzero(n)
                if len(some):
                    for r, own in zip(some, band_keys(signatures([sets[r] for r in some], banding.bins), banding), strict=True):
                        bands[r] = own
                ids = batch["doc_id"].iloc[done : done + len(run)]
                done += len(run)
                yield pd.DataFrame({"doc_id": ids.to_numpy(), "n_shingles": n, "set_key": keys, "bands": bands})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # ids travel as text: a column of integers with a null would become doubles on the way
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    signed = rows.mapInPandas(sign, "doc_id string, n_shingles long, set_key binary, bands array<long>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(kind))


def full_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``node, shingles``: the full set of each row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for run in chunks(batch["text"]):
                sets = shingle_sets(run, size)
                yield pd.DataFrame({"node": batch["node"].iloc[done : done + len(run)].to_numpy(), "shingles": [s.view(np.int64) for s in sets]})
                done += len(run)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    return rows.mapInPandas(cut, f"node {kind}, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets share at least ``percent`` of their union.

    Either side grows with the corpus, so neither is broadcast; a hub with many pairs is split by AQE.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(right.hint("merge"), "b")
        .join(left.hint("merge"), "a")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each linked node reaches.

    Alternates large and small stars until the edges rest; the number of rounds grows with the logarithm
    of the longest chain. Minima are pre-aggregated and joined back, so no neighbourhood is gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while now != before and now[0]:
        before = now
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "edges", rows=2 * now[0])
        now = state(edges)
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n, label, reach`` for buckets of two nodes or more.

    ``reach`` is how many members a node meets over its buckets, ``label`` its component, at first itself.
    """
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(placed.join(shared.hint("merge"), "bucket"), "buckets")
    reach = members.groupBy("node").agg(F.sum("members").alias("reach"))
    return members.join(reach, "node").select("bucket", "node", "n", F.col("node").alias("label"), "reach")


def _hubs(members: DataFrame) -> DataFrame:
    """The member of each bucket with the greatest reach, ties to the smaller node."""
    best = F.max(F.struct("reach", (-F.col("node")).alias("low"), "n", "label")).alias("top")
    return members.groupBy("bucket").agg(best).select(
        "bucket", (-F.col("top.low")).alias("a"), F.col("top.n").alias("a_n"), F.col("top.label").alias("a_label")
    )


def stars(members: DataFrame, percent: int) -> DataFrame:
    """Edge ``a, b`` from the hub of each bucket to every member of another component.

    Sets whose sizes alone rule the similarity out make no edge.
    """
    alike = 100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")
    edges = members.join(_hubs(members), "bucket").filter((F.col("label") != F.col("a_label")) & alike)
    return edges.select("a", F.col("node").alias("b")).distinct()


def unreached(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members outside their hub's component, with their components, of buckets where two or more remain."""
    hubs = _hubs(members).select("bucket", "a")
    now = F.coalesce("component", F.col("node"))
    rows = members.join(labels, "node", "left").select("bucket", "node", "n", now.alias("label"), "reach")
    hubs = hubs.join(labels, hubs["a"] == labels["node"], "left").select("bucket", F.coalesce("component", "a").alias("a_label"))
    left = rows.join(hubs, "bucket").filter("label <> a_label").drop("a_label")
    return left.join(left.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket", "left_semi")


def untested(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` in buckets that stars do not settle: three members or more of several components."""
    rows = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    mixed_up = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = mixed_up.filter("all > 2 and low <> high").select("bucket")
    return rows.join(open_, "bucket", "left_semi").select("node", "label").distinct()


def rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, label, place``: the rarest shingles of each set, one of which every similar set shares.

    ``place`` counts from 0 over the whole set, rarest first. Shingles of one set alone come first and match
    nothing, so they are counted but not listed.
    """
    own = sets.join(nodes.hint("merge"), "node").withColumn("part", F.xxhash64("shingles")).dropDuplicates(["node", "part"])
    cut = own.select("node", "label", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = cut.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = cut.join(often.hint("merge"), "token").groupBy("node", "label", "part", "n")
    ordered = shared.agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("own"))
    placed = ordered.select("node", "label", "n", F.size("own").alias("m"), F.posexplode("own").alias("at", "s"))
    placed = placed.select(F.col("s.token").alias("token"), "node", "n", "label", (F.col("n") - F.col("m") + F.col("at")).alias("place"))
    return placed.filter(F.col("place") <= F.col("n") - F.floor((percent * F.col("n") + 99) / 100))


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of two components that may share ``percent`` of their union; no such pair is left out.

    Members of the most frequent component of a shingle are not paired with each other, and a frequent
    shingle is dealt over many tasks.
    """
    rare = written(rare_shingles(nodes, sets, percent), "rare")
    by_label = rare.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    hot = by_label.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("labels"))
    hot = hot.filter("labels > 1").select("token", "top", F.ceil(F.col("c") / SALTED).cast("int").alias("salts"))
    rows = written(rare.join(hot.hint("merge"), "token"), "rare-shared")
    right = rows.select("token", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "label", "place")], F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"))
    left = rows.filter("label <> top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    common = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2"))  # at most, if this shingle is the first
    alike = 100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")
    may = (F.col("label") != F.col("label_2")) & alike & ((100 + percent) * common >= percent * (F.col("n") + F.col("n_2")))
    pairs = left.join(right.hint("merge"), ["token", "salt"]).filter(may)
    return pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", banding: Banding = Banding()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row."""
    signed = written(signed_documents(docs, key, text, banding), "signed")
    groups = written(
        signed.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "set-groups",
    )
    members = written(bucket_members(groups.filter("node is not null").select("node", "n", "bands")), "members")
    candidates = members.select(F.col("node").alias(key)).distinct().hint("merge")
    sets = written(full_sets(docs.select(key, text).join(candidates, key, "left_semi"), key, text, banding.words), "sets")
    links: DataFrame | None = None
    labels: DataFrame | None = None
    everyone = members
    while not members.isEmpty():
        found = written(confirmed(stars(members, banding.percent), sets, banding.percent), "links")
        if labels is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = written(components(links), "labels", rows=2 * links.count())
        members = written(unreached(members, labels), "members")
    if links is not None and labels is not None:
        left = written(untested(everyone, labels), "untested")
        found = written(confirmed(rare_pairs(left, sets, banding.percent), sets, banding.percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = written(components(links), "labels", rows=2 * links.count())
    if labels is None:
        named = groups.select("set_key", F.col("node").alias("group_id"))
    else:
        named = groups.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("group_id"))
    group = F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.col("doc_id"))
    return (
        signed.join(named.hint("merge"), "set_key", "left")
        .select("doc_id", "n_shingles", group.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", banding: Banding = Banding()) -> DataFrame:
    """One document of each group; columns as they came."""
    name = private("kept")
    kept = near_duplicates(docs, key, text, banding).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("merge"), docs[key] == kept[name], "left_semi")


