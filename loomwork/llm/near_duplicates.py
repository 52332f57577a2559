"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles (of all its words, if fewer).
Each shingle carries Poisson processes over its discretised weight: one for
[0, 1) and one for every [2^(j-1), 2^j), so a weight w needs about log2 w of
them; points of the last, partly covered one are thinned by their position. A
point has a time and a signature component, and a signature holds the least
time of each component. Two signatures agree in a component with probability
equal to the weighted Jaccard similarity. Processes stop at the first point
that is later than all components of their text, so work is near-linear.

Bands of components give buckets. Small buckets yield all their pairs; in large
ones every text is paired with the bucket's hub, the member that shares most
buckets with others (the source of a family of copies agrees with all of them).
Pairs are verified on exact shingle counts, and links of ``least`` similarity or
more are closed into classes. Members of a large bucket that are in different
classes after that are compared exactly, in blocks, before classes are final.

Identical texts share one node from the start, so groups of copies cost one
signature in the buckets. No task ever holds a whole bucket or class.

Defined results: one row per input row. A null text is a class of its own; texts
without words are only alike when identical; class_id is the least doc_id of the
class, null where all are null; repeated rows share a class; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import spans
from loomwork.llm.tokens import slices
from loomwork.session import discard, sized, stored

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Ticks of time that an exponential gap of mean 1 has on average.
_TICKS = 2.0**40


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bags(column, width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text of an Arrow column, hashes of its distinct shingles and their counts."""
    data, offsets = spans.texts(column)
    starts, ends = spans.words(data, offsets)
    words = spans.hashes(data, starts, ends)
    sizes = np.bincount(spans.owners(offsets, starts), minlength=len(offsets) - 1)

    def shingled(hashes: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(hashes) - size + 1)
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = mixed(total * _GOLDEN + hashes[i : i + n])
        return total

    whole, out, at = shingled(words, width), [], 0
    for n in sizes.tolist():
        if n:
            out.append(np.unique(whole[at : at + n - width + 1] if n >= width else shingled(words[at : at + n], n), return_counts=True))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += n
    return out


def shingles(body: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of one whole text and their counts."""
    return bags(pa.array([body], pa.string()), width)[0]


def _processes(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """(seed, lower, width, weight, owner) of each shingle's processes."""
    parts = []
    lower, width, strip = 0, 1, 0
    while len(hashes):
        seed = mixed(hashes + np.uint64(strip * int(_M1) % (1 << 64)))
        parts.append((seed, np.full(len(hashes), float(lower)), np.full(len(hashes), float(width)), weights.astype(float), owner))
        lower, width, strip = lower + width, max(1, lower + width), strip + 1
        more = weights > lower
        hashes, weights, owner = hashes[more], weights[more], owner[more]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """One row of ``size`` least times for each non-empty bag."""
    out = np.full((len(bags), size), np.inf)
    lengths = np.array([len(b[0]) for b in bags])
    # bags of like size go together, as they need like numbers of points
    for magnitude in np.unique(np.frexp(lengths)[1][lengths > 0]) if len(bags) else ():
        chosen = np.flatnonzero((np.frexp(lengths)[1] == magnitude) & (lengths > 0))
        step = max(1, int(400_000 // (1 << int(magnitude))))
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            out[part] = _signed([bags[i] for i in part], size, max(1, round(3 * size / (1 << int(magnitude)))))
    return out


def _signed(bags: list[tuple[np.ndarray, np.ndarray]], size: int, points: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    seed, lower, width, weight, owner = _processes(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), owner)
    least = np.full(len(bags) * size, np.inf)
    time, drawn = np.zeros(len(seed), np.int64), 0
    while len(seed):
        index = np.arange(drawn + 1, drawn + points + 1, dtype=np.uint64)
        bits = mixed(seed[:, None] + index[None, :] * _GOLDEN)
        # gaps are whole numbers of ticks, so a point has the same time however many are drawn at once
        gaps = np.rint(-np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * _TICKS).astype(np.int64)
        ticks = time[:, None] + np.cumsum(gaps, axis=1)
        times = ticks / (size * width)[:, None]
        other = mixed(bits ^ _M2)
        component = ((other >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        position = lower[:, None] + width[:, None] * ((other & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32)
        valid = (position < weight[:, None]) & (times < least.reshape(-1, size).max(1)[owner][:, None])
        at = (owner[:, None] * size + component)[valid]
        np.minimum.at(least, at, times[valid])
        time, drawn = ticks[:, -1], drawn + points
        alive = times[:, -1] < least.reshape(-1, size).max(1)[owner]
        seed, lower, width, weight, owner, time = (x[alive] for x in (seed, lower, width, weight, owner, time))
    return least.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    rows = signature.shape[1] // bands
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for i in range(rows):
        key = mixed(key * _GOLDEN + bits[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, *, bands: int = 32, rows: int = 5, width: int = 5) -> DataFrame:
    """doc_id, node (md5 of the text, null for null) and band keys (null without words) of every row."""

    def run(batches: Iterator) -> Iterator:
        for batch in (x for b in batches for x in slices(b, 512)):
            own = bags(batch.column(2), width)
            keys = band_keys(signatures(own, bands * rows), bands) if own else np.zeros((0, bands), np.int64)
            has = np.array([len(b[0]) > 0 for b in own], bool)
            ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.concatenate([~has, [False]])), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "node", "keys"])

    body = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(body.cast("binary"))).alias("node"), body.alias("text"))
    return stored(source.mapInArrow(run, "doc_id long, node binary, keys array<long>"), "near-signatures")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def texts_of(nodes: DataFrame, docs: DataFrame, *, broadcast_rows: int = 300_000) -> DataFrame:
    """(node, text) of some nodes; only their texts move.

    The set of nodes is broadcast up to ``broadcast_rows`` of 16 bytes, and joined by shuffle beyond.
    """
    needed = stored(nodes.distinct(), "near-needed")
    small = needed.count() <= broadcast_rows
    body = F.col("text").cast("string")
    rows = docs.select(F.unhex(F.md5(body.cast("binary"))).alias("node"), body.alias("text"))
    return stored(rows.join(F.broadcast(needed) if small else needed, "node", "left_semi").dropDuplicates(["node"]), "near-texts")


def verified(pairs: DataFrame, docs: DataFrame, *, least: float, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose exact shingle overlap is at least ``least``."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs)

    def run(batches: Iterator) -> Iterator:
        hub, bag = None, None
        for batch in batches:
            keep = []
            for node, one, two in zip(batch.column(1).to_pylist(), bags(batch.column(2), width), batch.column(3), strict=True):
                if node != hub:
                    hub, bag = node, shingles(two.as_py(), width)
                keep.append(overlap(one, bag) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    out = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"), "near-links")
    discard(texts)
    return out


def bucket_links(members: DataFrame, docs: DataFrame, *, least: float, width: int, small: int = 16) -> DataFrame:
    """Verified links between members (key, node, n) of buckets: all pairs of small ones, hub and members of large ones."""
    # The hub of a bucket is the member with the most company over all its buckets.
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    few = members.filter(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    every = F.flatten(
        F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.lit(small)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    close = few.select(F.explode(every).alias("p")).select("p.a", "p.b")
    many = members.filter(F.col("n") > small)
    hubs = many.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    spokes = many.join(hubs, "key").filter(F.col("node") != F.col("hub"))
    pairs = close.unionByName(spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()
    return verified(stored(pairs, "near-pairs"), docs, least=least, width=width)


def remaining_links(members: DataFrame, roots: DataFrame, table: DataFrame, docs: DataFrame, *, least: float, width: int, small: int = 16, block: int = 400) -> DataFrame | None:
    """Links that hubs have missed in large buckets, or None where there can't be any.

    A bucket whose members are all in one class by now is settled. In others,
    every member outside the bucket's largest class is compared with all
    members of other classes, block by block: exactly, and without making rows
    of pairs. A pair is compared in the first band that it shares, and a member
    that is linked to a class skips the rest of it.
    """
    many = members.filter(F.col("n") > small).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_class = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed_ = by_class.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("minor"))
    mixed_ = stored(mixed_.filter(F.col("roots") > 1).drop("roots"), "near-mixed")
    if mixed_.isEmpty():
        return None
    left = stored(many.join(mixed_, "key").select("key", "node", "root", "n", "minor", (F.col("root") != F.col("main")).alias("asks")), "near-left")
    texts = texts_of(left.select("node"), docs)
    keys = table.filter("keys is not null").join(texts.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "keys")
    whole = left.join(texts, "node").join(keys, "node")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    held = whole.select("key", own("n").alias("i"), each("minor").alias("j"), "node", "root", "asks", "keys", "text")
    new = lambda c: F.col(c).alias(f"q_{c}")
    asking = whole.filter("asks").select(new("key"), each("n").alias("q_i"), own("minor").alias("q_j"), *map(new, ("node", "root", "keys", "text")))

    def run(key, mine, asked):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        if not mine.num_rows or not asked.num_rows:
            return schema.empty_table()
        nodes, roots_, asks = (mine.column(c).to_pylist() for c in ("node", "root", "asks"))
        bands = np.array(mine.column("keys").to_pylist(), np.int64)
        own = bags(mine.column("text").combine_chunks(), width)
        owner = np.repeat(np.arange(len(own)), [len(b[0]) for b in own])
        hashes, counts = np.concatenate([b[0] for b in own]), np.concatenate([b[1] for b in own])
        order = np.argsort(hashes, kind="stable")
        hashes, counts, owner = hashes[order], counts[order], owner[order]
        totals = np.bincount(owner, counts, len(own))
        here, out = key[0].as_py(), []
        for node, root, own_keys, text in zip(*(asked.column(c).to_pylist() for c in ("q_node", "q_root", "q_keys", "q_text")), strict=True):
            h, c = shingles(text, width)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], np.minimum(counts[at], np.repeat(c, n)), len(own))
            like = shared / np.maximum(totals + c.sum() - shared, 1) >= least
            equal = bands == np.array(own_keys, np.int64)
            first = np.array(own_keys)[equal.argmax(1)] == here
            linked = {root}
            for m in np.flatnonzero(like & first):
                if roots_[m] not in linked and not (asks[m] and nodes[m] < node):
                    linked.add(roots_[m])
                    out.append((node, nodes[m]))
        return pa.table([list(x) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    found = held.groupBy("key", "i", "j").cogroup(asking.groupBy("q_key", "q_i", "q_j")).applyInArrow(run, "a binary, b binary")
    found = stored(found.distinct(), "near-links")
    discard(texts)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, by alternating large-star and small-star steps.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.
    """

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "near-edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        done, edges = edges, stored(small, "near-edges")
        after = state(edges)
        if after == before:
            discard(done)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
        discard(done)


def classes(docs: DataFrame, *, least: float = 0.8, bands: int = 32, rows: int = 5, width: int = 5) -> DataFrame:
    """doc_id, node, class_id, class_rows and first_node (of the class's least doc_id and, of that, the least node) of every input row."""
    table = signed(docs, bands=bands, rows=rows, width=width)
    unique = table.filter("keys is not null").groupBy("node").agg(F.first("keys").alias("keys"))
    flat = unique.select(F.explode("keys").alias("key"), "node")
    counts = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = stored(flat.join(counts, "key"), "near-buckets")
    links = bucket_links(members, docs, least=least, width=width)
    roots = components(links)
    more = remaining_links(members, roots, table, docs, least=least, width=width)
    if more is not None:
        roots = components(links.unionByName(more))
    named = table.select("doc_id", "node").join(roots, "node", "left")
    lone = F.col("node").isNull()
    with_class = named.filter(~lone).withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node")))
    sizes = with_class.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("class_rows"))
    own = named.filter(lone).select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), F.col("node").alias("first_node"))
    both = with_class.join(sizes, "root").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), "class_rows", F.col("first.node").alias("first_node"))
    return both.unionByName(own)


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """The input rows without those that aren't the first of their class.

    The first is the row with the class's least id; if other texts of the class
    have that id too, the one whose md5 is least. Of repeated rows one stays.
    Rows with a null id always stay.
    """
    table = stored(classes(docs, **how).select("doc_id", "node", "class_id", "first_node"), "near-classes")
    other = (F.col("doc_id") != F.col("class_id")) | (F.col("node") != F.col("first_node"))
    out = table.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull() & other).select("doc_id", "node").distinct()
    out = stored(out.withColumnsRenamed({"doc_id": "__doc", "node": "__gone"}), "near-gone")
    node = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    rest = docs.join(sized(out), (F.col("doc_id") == F.col("__doc")) & (node == F.col("__gone")), "left_anti")
    repeated = table.filter("doc_id is not null and node is not null").groupBy("doc_id", "node").count().filter("count > 1")
    if repeated.isEmpty():
        return rest
    keyed = rest.withColumn("__node", node)
    whole = keyed.filter(F.col("doc_id").isNotNull() & F.col("__node").isNotNull()).dropDuplicates(["doc_id", "__node"])
    return whole.unionByName(keyed.filter(F.col("doc_id").isNull() | F.col("__node").isNull())).drop("__node")
