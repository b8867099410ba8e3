"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is a number of equal blocks of words. Blocks go to sources, and then within a source to its
shards, one after another to the highest quotient votes / (2 * blocks held + 1). In each shard the
documents stand in a seeded order, their words form a ring, and the shard's blocks are taken from the
ring in turn, whole passes first. Everything runs as DataFrame operations; texts are read once.

Defined results: a null or empty text has no words and none of it is taken. A null source is a source
of its own and stands last. An empty table gives an empty result. Repeated rows count as often as they
occur. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxon.llm.common import SPACES, private, written


@dataclass(frozen=True)
class Mix:
    """Documented parameters. A source has a shard for every ``shard_docs`` documents, at most ``max_shards``."""

    weights: tuple[int, ...] = (1, 2, 3)
    share: float = 1.0
    most: int = 3
    block: int = 32
    shard_docs: int = 512
    max_shards: int = 4096
    seed: str = "17"


def size_of(text: Column) -> Column:
    """Number of words between white space."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def water_fill(sources: DataFrame, mix: Mix) -> DataFrame:
    """``target`` of each source: shares by weight, stopped at ``most`` times its size, the rest reshared.

    The level at which the rest settles is found from running sums over the order of the stops: it is the
    first that the source in turn can take up. ``sources`` has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(mix.share))
    ranked = sources.withColumns(
        {"place": F.row_number().over(by_name), "total": total, "stop": F.col("source_size") * F.lit(float(mix.most))}
    ).withColumn("weight", F.get(weights, (F.col("place") - 1) % len(mix.weights)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "place")
    before = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", (F.col("total") - before) / weight_left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    level = F.coalesce(F.max(fits).over(Window.partitionBy()), F.lit(float("inf")))
    return levelled.withColumn("target", F.least(F.col("stop"), level * F.col("weight"))).select("source", "place", "source_size", "n_docs", "target")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``won`` seats of each party, ``group`` by group; ties go to the smaller party.

    Every party surely holds the seats of its rounded-down share less one half, or none; only the
    quotients from there on compete, and they number about three times the parties. A group holds a
    bounded number of parties (sources, or the shards of one source).
    """
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    total = F.sum(votes).over(whole)
    share = F.when(total > 0, F.col(seats) * F.col(votes) / total).otherwise(0.0)
    rows = parties.withColumns({"n_parties": n, "fair": share}).withColumn(
        "sure", F.greatest(F.lit(0), F.floor(F.col("fair") - F.col("n_parties") * F.col("fair") / (2 * F.greatest(F.col(seats), F.lit(1))) - 2)).cast("long")
    )
    left = F.col(seats) - F.sum("sure").over(whole)
    rows = rows.withColumn("open", left)
    # no party can win more than its fair share of the half seat that each party may round off, and a few
    more = F.ceil(F.col("n_parties") * F.when(F.col(seats) > 0, F.col("fair") / F.col(seats)).otherwise(0.0)).cast("long") + 5
    tried = rows.filter(F.col(votes) > 0).select("*", F.explode(F.sequence(F.col("sure"), F.col("sure") + more)).alias("held"))
    order = whole.orderBy((F.col(votes) / (2 * F.col("held") + 1)).desc(), party, "held")
    won = tried.withColumn("rank", F.row_number().over(order)).filter("rank <= open")
    won = won.groupBy(*group, party).agg(F.count(F.lit(1)).alias("extra"))
    return rows.join(won, [*group, party], "left").select(
        *parties.columns, (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("won")
    )


def _hash(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|" + seed)))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row."""
    sized = written(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes"
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = water_fill(sources, mix).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / mix.block).cast("long"))
    goals = written(
        sainte_lague(goals, [], "place", "target", "blocks")
        .withColumnRenamed("won", "quota")
        .withColumn("n_shards", F.least(F.lit(mix.max_shards), F.ceil(F.col("n_docs") / mix.shard_docs)).cast("long"))
        .select("source", "place", "source_size", "target", "quota", "n_shards"),
        "sources",
    )
    low = F.conv(F.substring(_hash(F.col("doc_id"), mix.seed), 1, 8), 16, 10).cast("long")
    placed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).select(
        "doc_id", "size", "place", "source_size", "target", "quota", (low % F.col("n_shards")).alias("shard")
    )
    shards = placed.groupBy("place", "shard").agg(
        F.sum("size").alias("ring"), F.first("quota").alias("seats")
    )
    dealt = sainte_lague(shards, ["place"], "shard", "ring", "seats").select("place", "shard", "ring", "won")
    order = Window.partitionBy("place", "shard").orderBy(F.substring(_hash(F.col("doc_id"), mix.seed), 9, 24), "doc_id", "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    ring = F.greatest(F.col("ring"), F.lit(1))
    words = F.col("won") * mix.block
    passes = F.floor(words / ring).cast("long")
    rest = words - passes * F.col("ring")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = F.least(passes * F.col("size") + part, mix.most * F.col("size")).cast("long")
    return (
        placed.withColumn("before", before)
        .join(dealt, ["place", "shard"])
        .select("doc_id", "size", "source_size", "target", taken.alias("taken"))
    )


def repeat_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """Each document as often as the mix takes it, rounded half up; columns as they came.

    At most one document of a shard is taken in part, so rounding moves no source by more than half a
    document for each of its shards.
    """
    name, times = private("key"), private("times")
    decided = mix_sources(docs, key, text, source, mix)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1)))).cast("int")
    decided = decided.withColumn(times, copies).groupBy(F.col("doc_id").alias(name)).agg(F.max(times).alias(times)).filter(F.col(times) > 0)
    each = private("each")
    return (
        docs.join(decided, docs[key] == decided[name])
        .withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*[docs[c] for c in docs.columns])
    )
