"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is counted in blocks of equally many words. Sources receive blocks by
highest quotients target / (2k - 1), k = 1, 2, ..., which gives every source an
integer quota in every output shard. Each source lays its documents out in a
seeded order; a shard draws its quota of blocks from that order where the shard
before it has ended, starting over when all are used. A document's taken words
are those of its blocks that were drawn.

All of it is DataFrame code, and texts are never shuffled. Words are counted
once, into a slim table; to write the mix out, a text only needs to know whether
it lies before or after the end of its source's draws.

Defined results: a null text has size 0 and takes 0; null is a source of its
own, last in order; a null id is ordered like an empty one; rows that agree in
source, id and size share their draws equally; a source without words takes 0;
an empty table gives no rows. `draw` takes source, doc_id and text and ignores all
other columns; `emit` returns the columns of its input, and names that begin with
two underscores are its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm import text
from loomwork.session import stored

#: Bits of each level of the search for the end of a source's draws.
_LEVEL = 10
_KEY_BITS = 60


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """One row per source: number, weight, source_size, target words, capped.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    all words. A target stops at ``most_repeats`` times its source's size. Taken
    by rising ratio of that limit to the weight, the sources that stop come
    first, so one running sum gives the final share for all others.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    numbered = by_source.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    limit = (F.col("source_size") * most_repeats).cast("double")
    rising = W.orderBy(F.col("limit") / F.col("weight"), "number")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    shared = (
        numbered.withColumn("limit", limit)
        .withColumn("words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("share", (F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("capped", F.col("share") * F.col("weight") >= F.col("limit"))
    )
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), F.col("number"), F.col("share")))).over(everything)["share"]
    return shared.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(final * F.col("weight"))).select(
        "source", "number", "weight", "source_size", "target", "capped", "words"
    )


def quotas(targets: DataFrame, *, blocks: int = 1 << 22, shards: int = 64) -> DataFrame:
    """One row per source and shard: quota, and drawn, the quotas up to that shard.

    Shard s of S ends when s/S of all blocks are given out. For a number H of
    blocks, n sources and total target T, every seat of the divisor T / (H - n/2)
    is surely won and none beyond T / (H + n/2) can be, so only about 2n
    quotients per shard need ranking. Sources at their limit are outside the
    contest: they give all their blocks, evenly over the shards.
    """
    size = F.greatest(F.ceil(F.col("words") / blocks), F.lit(1)).cast("long")
    free = W.partitionBy()
    told = (
        targets.withColumn("block_words", size)
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .withColumn("wanted", F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("target")))
        .withColumn("total", F.sum("wanted").over(free))
        .withColumn("n", F.sum(F.when(F.col("wanted") > 0, 1).otherwise(0)).over(free))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(F.round(F.col("total") / F.col("block_words")) * F.col("shard") / shards).cast("long"))
    )
    per = F.col("wanted") / F.when(F.col("total") > 0, F.col("total"))
    low = F.floor(per * F.greatest(F.col("house") - F.col("n") / 2, F.lit(0.0)) - 0.5).cast("long")
    high = F.ceil(per * (F.col("house") + F.col("n") / 2) + 1.5).cast("long")
    bounds = told.withColumn("sure", F.coalesce(F.greatest(low, F.lit(0)), F.lit(0))).withColumn("most", F.coalesce(high, F.lit(0)))
    bounds = bounds.withColumn("left", F.col("house") - F.sum("sure").over(W.partitionBy("shard")))
    seats = bounds.filter(F.col("wanted") > 0).withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
    rank = F.row_number().over(W.partitionBy("shard").orderBy((F.col("wanted") / (2 * F.col("seat") - 1)).desc(), "number", "seat"))
    won = seats.withColumn("rank", rank).filter(F.col("rank") <= F.col("left")).groupBy("number", "shard").agg(F.count(F.lit(1)).alias("won"))
    most = F.col("n_blocks") * 3
    drawn = F.when(F.col("capped"), F.floor(F.round(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))) * F.col("n_blocks") * F.col("shard") / shards)).otherwise(
        F.least(F.col("sure") + F.coalesce(F.col("won"), F.lit(0)), most)
    )
    all_shards = bounds.join(won, ["number", "shard"], "left").withColumn("drawn", drawn.cast("long"))
    before = F.lag("drawn", 1, 0).over(W.partitionBy("number").orderBy("shard"))
    return all_shards.withColumn("quota", F.col("drawn") - before).select(
        "source", "number", "weight", "source_size", "target", "block_words", "n_blocks", "shard", "quota", "drawn"
    )


def _level(key, level: int):
    """The ``level``-th group of bits of an order key, from the highest."""
    return F.shiftright(key, _KEY_BITS - _LEVEL * level).bitwiseAND((1 << _LEVEL) - 1)


def laid_out(slim: DataFrame) -> DataFrame:
    """The rows (source, doc_id, size, key) with ``start``, the words before them in their source's seeded order, and ``alike``.

    ``alike`` is the number of rows that agree in all columns; they share one start.
    Words are summed by two levels of 1,024 groups of keys, so running sums see
    at most 1,024 rows a source or group, and only a millionth of a source is
    put in order in one place.
    """
    one, two = _level(F.col("key"), 1).alias("g1"), _level(F.col("key"), 2).alias("g2")
    rows = slim.select("*", one, two)
    fine = rows.groupBy("source", "g1", "g2").agg(F.sum("size").alias("words"))
    before = lambda by, order: F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy("source", "g1").agg(F.sum("words").alias("words"))
    coarse = coarse.select(F.col("source").alias("__s"), F.col("g1").alias("__g1"), before(("source",), "g1").alias("first"))
    fine = fine.withColumn("second", before(("source", "g1"), "g2"))
    groups = fine.join(coarse, F.col("source").eqNullSafe(F.col("__s")) & (F.col("g1") == F.col("__g1")))
    groups = groups.select(F.col("source").alias("__s"), F.col("g1").alias("__g1"), F.col("g2").alias("__g2"), (F.col("first") + F.col("second")).alias("before"))
    here = F.col("source").eqNullSafe(F.col("__s")) & (F.col("g1") == F.col("__g1")) & (F.col("g2") == F.col("__g2"))
    group = ("source", "g1", "g2")
    order = ("key", F.col("doc_id").asc_nulls_first(), "size")
    upto = F.sum("size").over(W.partitionBy(*group).orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow))
    alike = F.count(F.lit(1)).over(W.partitionBy(*group, "key", "doc_id", "size"))
    placed = rows.withColumn("upto", upto).withColumn("alike", alike).join(groups, here)
    return placed.withColumn("start", F.col("before") + F.col("upto") - F.col("alike") * F.col("size")).drop("upto", "before", "g1", "g2", "__s", "__g1", "__g2")


@dataclass
class Mix:
    """The draws of a mix: a row per source, and a slim row per document."""

    sources: DataFrame
    documents: DataFrame
    seed: int


def draw(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, blocks: int = 1 << 22, shards: int = 64, seed: int = 17) -> Mix:
    """Quotas of all sources and what they draw.

    ``sources``: source, source_size, target, block_words, n_blocks, quota_blocks,
    passes (whole draws of the source), left (words of its last pass) and quotas,
    the blocks drawn up to each shard.
    ``documents``: source, doc_id, key, size, source_size, target, quota_blocks,
    block_words, taken, and first_shard and last_shard, those of the document's
    first and last taken word (null if none is).
    """
    if most_repeats > 3:
        raise ValueError("draws are limited to three passes over a source")
    key = text.order_key(F.col("doc_id"), seed).alias("key")
    slim = stored(docs.select("source", "doc_id", text.word_count(F.col("text").cast("string")).alias("size"), key), "mix-sizes")
    targets = stored(source_targets(slim, weights=weights, most_repeats=most_repeats), "mix-targets")
    by_source = quotas(targets, blocks=blocks, shards=shards).groupBy("source", "source_size", "target", "block_words", "n_blocks")
    drawn = F.transform(F.array_sort(F.collect_list(F.struct("shard", "drawn"))), lambda x: x["drawn"])
    plan = by_source.agg(drawn.alias("quotas")).withColumn("quota_blocks", F.element_at("quotas", -1))
    passes = F.floor(F.col("quota_blocks") / F.greatest(F.col("n_blocks"), F.lit(1))).cast("long")
    plan = plan.withColumn("passes", passes)
    rest = F.least((F.col("quota_blocks") - F.col("passes") * F.col("n_blocks")) * F.col("block_words"), F.col("source_size"))
    plan = stored(plan.withColumn("left", rest), "mix-plan")

    both = laid_out(slim).join(plan.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    size, n = F.col("size"), F.col("alike")
    space = F.least(F.greatest(F.col("left") - F.col("start"), F.lit(0)), n * size)
    both = both.withColumn("part", F.floor(space / n).cast("long"))
    both = both.withColumn("taken", (F.col("passes") * size + F.col("part")).cast("long"))
    # the places of the first and last taken word among the blocks drawn from the source
    first = F.floor(F.col("start") / F.col("block_words"))
    end = F.col("start") + F.when(F.col("part") > 0, space).otherwise(n * size) - 1
    last = F.when(F.col("part") > 0, F.col("passes")).otherwise(F.col("passes") - 1) * F.col("n_blocks") + F.floor(end / F.col("block_words"))
    shard = lambda place: F.when(F.col("taken") > 0, F.size(F.filter("quotas", lambda x: x <= place)) + 1).cast("int")
    out = both.withColumn("__first", first).withColumn("__last", last).select(
        "source", "doc_id", "key", "size", "source_size", "target", "quota_blocks", "block_words", "taken",
        shard(F.col("__first")).alias("first_shard"), shard(F.col("__last")).alias("last_shard"), "start", "alike", "part", "passes", "left",
    )
    return Mix(plan, out, seed)


def emit(docs: DataFrame, mix: Mix) -> DataFrame:
    """The texts of a mix, with the columns of ``docs``: whole copies of each document, then its last words' share as a shorter text.

    A shorter text holds the document's text up to its last taken word, and
    ``n_chars``, if there is such a column, its length. Texts stay where they
    lie: of each source only its passes and the document at which its draws end
    are joined, one row a source or a few, if rows agree in all but their text.
    """
    edges = mix.documents.filter((F.col("start") <= F.col("left")) & (F.col("left") < F.col("start") + F.col("alike") * F.col("size")) & (F.col("left") > 0))
    edge = edges.groupBy(F.col("source").alias("__e")).agg(F.min(F.struct("key", "doc_id", "size", "part")).alias("__edge"))
    plan = mix.sources.select(F.col("source").alias("__s"), F.col("passes").alias("__passes"), F.col("left").alias("__left"))
    cuts = stored(plan.join(edge, F.col("__s").eqNullSafe(F.col("__e")), "left").drop("__e"), "mix-cuts")
    body = F.col("text").cast("string")
    key, id_ = text.order_key(F.col("doc_id"), mix.seed), F.col("doc_id")
    rows = docs.filter(body.rlike(text.WORD)).withColumn("__key", key).join(cuts, F.col("source").eqNullSafe(F.col("__s")))
    edge_id = F.col("__edge.doc_id")
    # the rows of one key, which differ in their ids or sizes only where hashes agree, are told apart as in laid_out
    same_key = F.col("__key") == F.col("__edge.key")
    same_id = same_key & id_.eqNullSafe(edge_id)
    before = (F.col("__key") < F.col("__edge.key")) | (same_key & ((id_.isNull() & edge_id.isNotNull()) | (id_ < edge_id)))
    size = F.when(same_id, text.word_count(body))
    whole = F.col("__left") > 0
    whole = whole & (F.col("__edge").isNull() | F.coalesce(before, F.lit(False)) | (same_id & (F.col("__size") < F.col("__edge.size"))))
    rows = rows.withColumn("__size", size).withColumn("__copies", (F.col("__passes") + F.when(F.coalesce(whole, F.lit(False)), 1).otherwise(0)).cast("int"))
    at_edge = F.coalesce(same_id & (F.col("__size") == F.col("__edge.size")) & (F.col("__left") > 0), F.lit(False))
    rows = rows.withColumn("__more", F.when(at_edge, F.col("__edge.part")).otherwise(0).cast("int"))
    n = F.col("__copies") + F.when(F.col("__more") > 0, 1).otherwise(0)
    rows = rows.filter(n > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), n)))
    cut = F.col("__n") > F.col("__copies")
    with_blanks = F.regexp_extract_all(body, F.lit(f"[ \\t-\\r]*{text.WORD}+"), F.lit(0))
    start = F.array_join(F.slice(with_blanks, F.lit(1), F.col("__more")), "")
    rows = rows.withColumn("__piece", F.when(cut, start).otherwise(body))
    out = rows.withColumn("text", F.col("__piece"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut | F.col("n_chars").isNull(), F.length("__piece").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
