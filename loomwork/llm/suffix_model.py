"""Scoring texts with a probabilistic suffix tree over words.

Symbols are words (A-Z in lower case) and one end per text. A word that occurs
twice, or a longer context that occurs four times, is a candidate state whatever
the size of the corpus; it is retained if its next-symbol distribution diverges
from that of its longest retained suffix, by count times Kullback-Leibler
divergence. A state's distribution keeps the symbols seen at least twice after
it, each less a discount, and gives all other mass to its suffix state, down to
add-one counts of single symbols. Each token is scored in the state of the
longest retained suffix of what precedes it.

Counting covers every training text, and the tree grows with the corpus: it is
held in tables of the shared folder, built by joins, and never gathered. A
text's score is a sum over its grams of one to ``depth`` + 1 words, as each
transition is a value to be added to what shorter grams say, and each state's
escape is added once for every token after it. Only grams with at least
``next_share`` of all tokens (at most 1 / share for each length) are broadcast
and scored where the text lies, as they could be hot keys. All others, but for
those that a fixed-size filter shows to be in no table, travel packed by bucket
to the part of the tree that has their values, which go back packed by the rows
they came from. A gram that is seldom in training but very frequent in the texts
to score is taken out of its bucket and joined by itself.

Defined results: a null or empty text is its end token; rows with a null id are
scored, not learnt from, and not held out; repeated rows are scored each and, if
in training, counted each; without training texts all counts are 0; an empty
table gives no rows; further columns are ignored. Words and grams are known by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import spans
from loomwork.llm.tokens import slices
from loomwork.session import discard, stored

#: No word holds a line end, so this stands for the end of a text.
_END = b"\n"
#: Bits of the filter of grams, as a power of 2.
_FILTER = 28
#: The least count of a word and of a longer context, and of a kept next symbol.
_LEAST_WORD, _LEAST_CONTEXT, _LEAST_NEXT = 2, 4, 2
#: Tokens of the corpus for each bucket of grams.
_BUCKET = 1_000_000
#: Parts, a power of 2, in which the grams of all texts are looked up in the tree, to hold less on disk at once.
_PIECES = 8
#: Times of a gram in one flush of some million beyond which it is joined by itself and not by bucket.
_HOT = 1024


@contextmanager
def _hashed_joins(spark):
    """Joins by shuffle hash the smaller side instead of sorting both, where adaptive execution has seen that each of its partitions is below the size."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _words(body: str | None) -> list[bytes]:
    return [*(body or "").encode("utf-8", "surrogatepass").lower().split(), _END]


class Symbols:
    """Places of words in a sorted array of hashes, or -1, with a bounded number of words at hand."""

    def __init__(self, hashes: np.ndarray, kept: int = 300_000):
        self.hashes, self.kept = hashes, kept
        self.held: dict[bytes, int] = {}

    def read(self, bodies: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All words of some texts in one list, their symbols, and where each text begins.

        No context reaches over the end of a text, as the end is no context.
        """
        words, starts = [], []
        for body in bodies:
            starts.append(len(words))
            words += _words(body)
        if len(self.held) > self.kept:
            self.held.clear()
        new = [*set(words).difference(self.held)]
        self.held.update(zip(new, _found(self.hashes, hashes_of(new)).tolist(), strict=True))
        return words, np.fromiter(map(self.held.__getitem__, words), np.int64, len(words)), np.asarray(starts, np.int64)


def hashes_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.append(0, ends[:-1]).astype(np.int64) if words else ends
    return spans.hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends, spans.LOWER).view(np.int64)


def read(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow column of texts, each text's end among them, and where each text begins."""
    data, offsets = spans.texts(column)
    starts, ends = spans.words(data, offsets)
    counts = np.diff(np.searchsorted(starts, offsets)) + 1
    begins = np.cumsum(counts) - counts
    out = np.full(int(counts.sum()), hashes_of([_END])[0], np.int64)
    inside = np.ones(len(out), bool)
    inside[begins + counts - 1] = False
    out[inside] = spans.hashes(data, starts, ends, spans.LOWER).view(np.int64)
    return out, begins


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    # in ascending order, as neighbouring lookups then touch the same memory
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """Places of sorted keys that are spread evenly over all 64-bit numbers, found by their highest bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(max((4 * len(keys)).bit_length(), 1), 22)
        self.shift = np.uint64(64 - bits)
        self.begins = np.append(0, np.cumsum(np.bincount(self._cell(keys), minlength=1 << bits))).astype(np.int32)

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        # signed numbers in ascending order, as unsigned ones
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        cell = self._cell(wanted)
        at, end = self.begins[cell], self.begins[cell + 1]
        out = np.full(len(wanted), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end, wanted = at[live], end[live], wanted[live]
        while len(live):
            hit = self.keys[at] == wanted
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            live, at, end, wanted = live[more], at[more], end[more], wanted[more]
        return out


@dataclass
class Level:
    """The candidate contexts of one length by sorted code, those retained, and their kept next symbols."""

    codes: np.ndarray
    kept: np.ndarray
    escape: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: for contexts of one word: the context of each symbol, and -1 at the end
    direct: np.ndarray | None = None


@dataclass
class Tree:
    """The alphabet (sorted hashes and counts), totals and levels of contexts."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    levels: list[Level] = field(default_factory=list)

    @property
    def size(self) -> int:
        return max(1, len(self.hashes))

    def contexts(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        """For each length, the candidate context before every symbol, or -1."""
        before = np.full(len(symbols), -1, np.int64)
        for n, level in enumerate(self.levels):
            known = np.concatenate([[-1], symbols[:-1]])
            if n == 0:
                before = level.direct[known]
            else:
                # the code of a context is that of its first words, times the alphabet, plus its last word
                shifted = np.concatenate([[-1], before[:-1]])
                at = np.flatnonzero((shifted >= 0) & (known >= 0))
                before = np.full(len(symbols), -1, np.int64)
                before[at] = _found(level.codes, shifted[at] * self.size + known[at])
            yield before

    def score(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability without the root's part, and whether the root's part is missing."""
        total, open_ = np.zeros(len(symbols)), np.ones(len(symbols), bool)
        for level, state in reversed([*zip(self.levels, self.contexts(symbols), strict=True)]):
            here = open_ & (state >= 0)
            here[here] = level.kept[state[here]]
            at = np.flatnonzero(here)
            pair = np.where(symbols[at] >= 0, state[at] * self.size + symbols[at], -1)
            place = _found(level.pairs, pair)
            hit = place >= 0
            total[at[hit]] += level.logs[place[hit]]
            open_[at[hit]] = False
            total[at[~hit]] += level.escape[state[at[~hit]]]
        return total, open_

    def root(self, symbols: np.ndarray) -> np.ndarray:
        return np.log10((self.counts[symbols] + 1) / (self.tokens + self.kinds + 1))

    def probability(self, before: np.ndarray, symbols: np.ndarray, level: int) -> np.ndarray:
        """Probability of each symbol after a context of the alphabet's words, with states up to ``level`` long.

        ``before``: a row per symbol with the words of its context, last first, -1 where there is none.
        """
        total, open_ = np.zeros(len(symbols)), np.ones(len(symbols), bool)
        states, last = [], None
        for n in range(level):
            code = before[:, n - n] if n == 0 else None
            if n:
                first = _found(self.levels[0].codes, before[:, n])
                for k in range(1, n):
                    inner = np.where((first >= 0) & (before[:, n - k] >= 0), first * self.size + before[:, n - k], -1)
                    first = np.where(inner >= 0, _found(self.levels[k].codes, inner), -1)
                code = np.where((first >= 0) & (before[:, 0] >= 0), first * self.size + before[:, 0], -1)
            last = np.where(code >= 0, _found(self.levels[n].codes, code), -1)
            states.append(last)
        for n in reversed(range(level)):
            here = open_ & (states[n] >= 0)
            here[here] = self.levels[n].kept[states[n][here]]
            at = np.flatnonzero(here)
            place = _found(self.levels[n].pairs, states[n][at] * self.size + symbols[at])
            hit = place >= 0
            total[at[hit]] += self.levels[n].logs[place[hit]]
            open_[at[hit]] = False
            total[at[~hit]] += self.levels[n].escape[states[n][at[~hit]]]
        total[open_] += self.root(symbols[open_])
        return 10.0**total


def counted(training: DataFrame) -> DataFrame:
    """(word, n): hash and count of every symbol of the training texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def rows():
            words = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(np.diff(np.append(first, len(words))))], ["word", "n"])

        for batch in (x for b in batches for x in slices(b, 512)):
            words, _ = read(batch.column(0))
            if len(words):
                held.append(words)
                size += len(words)
            if size > 4_000_000:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    parts = training.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long")
    return stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def _pairs(training: DataFrame, tree, level: int) -> DataFrame:
    """(context, symbol, n) after the contexts of the tree's last level."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, held, size = tree.value, [], 0
        table = Symbols(own.hashes)

        def merged():
            codes, n = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return codes, np.bincount(n, np.concatenate([h[1] for h in held]), len(codes)).astype(np.int64) if held else n

        def rows(codes, n):
            return pa.RecordBatch.from_arrays([pa.array(codes // own.size), pa.array(codes % own.size), pa.array(n)], ["context", "symbol", "n"])

        for batch in (x for b in batches for x in slices(b, 512)):
            _, symbols, _ = table.read(batch.column(0).to_pylist())
            *_, state = own.contexts(symbols)
            use = (state >= 0) & (symbols >= 0)
            held.append(np.unique(state[use] * own.size + symbols[use], return_counts=True))
            size += len(held[-1][0])
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 500_000:
                    yield rows(*held[0])
                    held, size = [], 0
        yield rows(*merged())

    parts = training.select(F.col("text").cast("string")).mapInArrow(run, "context long, symbol long, n long")
    return parts.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def grow(
    training: DataFrame,
    words: DataFrame,
    *,
    depth: int = 2,
    evidence: float = 8.0,
    discount: float = 0.5,
) -> Tree:
    """The tree of `tables` gathered on the driver, for looking at small corpora; scoring does not use it."""
    spark = training.sparkSession
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    tokens, kinds = int(totals.tokens), int(totals.kinds)
    end = int(hashes_of([_END])[0])
    frequent = words.filter((F.col("n") >= _LEAST_WORD) | (F.col("word") == end))
    hashes, counts = _arrays(frequent.orderBy("word"))
    tree = Tree(hashes.astype(np.int64), counts.astype(np.int64), tokens, kinds)
    last = int(_found(tree.hashes, np.array([end]))[0])
    codes = np.delete(np.arange(len(hashes)), last) if last >= 0 else np.arange(len(hashes))
    totals_ = tree.counts[codes]
    context_words = codes[:, None]
    for n in range(depth):
        if not len(codes):
            break
        tree.levels.append(Level(codes, np.zeros(len(codes), bool), np.zeros(len(codes))))
        if n == 0:
            tree.levels[0].direct = np.full(tree.size + 1, -1, np.int64)
            tree.levels[0].direct[codes] = np.arange(len(codes))
        shared = spark.sparkContext.broadcast(tree)
        table = stored(_pairs(training, shared, n + 1).filter(F.col("n") >= _LEAST_NEXT), "lm-pairs")
        context, symbol, times = (x.astype(np.int64) for x in _arrays(table))
        shared.unpersist()
        order = np.lexsort((symbol, context))
        context, symbol, times = context[order], symbol[order], times[order]
        level = tree.levels[-1]
        c, s, t = context, symbol, times
        own = (t - discount) / totals_[c]
        escape = np.maximum(1 - np.bincount(c, own, len(codes)), 1e-12)
        parent = tree.probability(context_words[c][:, ::-1], s, n)
        gain = np.bincount(c, t * np.log(t / totals_[c] / parent), len(codes))
        level.kept = gain >= evidence
        level.escape = np.log10(escape)
        level.pairs = c * tree.size + s
        level.logs = np.log10(own + escape[c] * parent)
        # contexts that are one word longer: those frequent enough as a whole
        longer = (times >= _LEAST_CONTEXT) & (symbol != last)
        codes = context[longer] * tree.size + symbol[longer]
        totals_ = times[longer]
        context_words = np.hstack([context_words[context[longer]], symbol[longer][:, None]])
    return tree


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Key of a gram, from those of the grams without its last and without its first word."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _longer(keys: np.ndarray) -> np.ndarray:
    """Keys of the grams one word longer that end at each place but the first."""
    return _mixed(keys[:-1], keys[1:])


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    """How many words of its text precede each word."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for the highest bits of each key; a table of more keys than bits gets a filter that lets all through.

    Each task sends its keys' places as short numbers within pieces of 65,536 bits,
    and each piece comes to the driver once, so that the whole is always 32 MB.
    """
    out = np.zeros(1 << (_FILTER - 6), np.uint64)
    if keys.count() > 1 << _FILTER:
        return ~out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def packed():
            places = np.unique(np.concatenate(held))
            piece = places >> np.uint32(16)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])), len(piece))
            low = places.astype(np.uint16)
            blobs = [low[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(piece[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["piece", "bits"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _FILTER)).astype(np.uint32))
                size += batch.num_rows
            if size > 4_000_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    def joined(table):
        import pyarrow as pa

        bits = np.zeros(1 << 16, bool)
        for blob in table.column("bits").to_pylist():
            bits[np.frombuffer(blob, np.uint16)] = True
        return pa.table([table.column("piece").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    kinds = "piece int, bits binary"
    parts = keys.select("key").mapInArrow(run, kinds).groupBy("piece").applyInArrow(joined, kinds).toArrow()
    words = (1 << 16) // 64
    for piece, bits in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        out[piece * words : (piece + 1) * words] = np.frombuffer(bits, "<u8")
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) >> np.uint64(64 - _FILTER)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _distinct(pre: np.ndarray, suf: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct grams by ascending key: key, pre, suf and the sum of ``n``, which is 1 for each by default."""
    key = _mixed(pre, suf)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first)
    at = order[first]
    return key[first], pre[at], suf[at], sums


def _grams(training: DataFrame, length: int, tokens: int, contexts, suffixes) -> DataFrame:
    """(key, pre, suf, n): counts of the grams of some words whose first and last parts may be in the tables below.

    Grams are dealt by key to as many buckets as there are millions of tokens,
    so that no bucket is large, however often a gram or a word occurs. Those of
    one bucket travel as the bytes of three arrays, ordered by first part.
    """
    buckets = min(1 + tokens // _BUCKET, 1 << 20)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def packed():
            key, pre, suf, n = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort((bucket << np.uint64(44)) | (pre.view(np.uint64) >> np.uint64(20)))
            bucket, pre, suf, n = bucket[order].astype(np.int64), pre[order], suf[order], n[order].astype(np.int32)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
            blobs = [b"".join(x[i:j].tobytes() for x in (pre, suf, n)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "grams"])

        for batch in (x for b in batches for x in slices(b, 512)):
            keys, starts = read(batch.column(0))
            use = _places(starts, len(keys))[length - 1 :] >= length - 1
            for _ in range(length - 2):
                keys = _longer(keys)
            pre, suf = keys[:-1][use], keys[1:][use]
            if contexts is not None:
                use = _passes(contexts.value, pre) & _passes(suffixes.value, suf)
                pre, suf = pre[use], suf[use]
            if len(pre):
                held.append((pre, suf))
                size += len(pre)
            if size > 2_000_000:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    def summed(table):
        import pyarrow as pa

        parts = []
        for blob in table.column("grams").to_pylist():
            m = len(blob) // 20
            parts.append((np.frombuffer(blob, np.int64, m), np.frombuffer(blob, np.int64, m, 8 * m), np.frombuffer(blob, np.int32, m, 16 * m).astype(np.int64)))
        columns = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        kept = columns[3] >= _LEAST_NEXT
        return pa.table([pa.array(x[kept]) for x in columns], ["key", "pre", "suf", "n"])

    parts = training.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, grams binary")
    return stored(parts.groupBy("bucket").applyInArrow(summed, "key long, pre long, suf long, n long"), "lm-counts")


def tables(training: DataFrame, words: DataFrame, tokens: int, kinds: int, *, depth: int = 2, evidence: float = 8.0, discount: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The tree as (word, n, escape) of all words, and (key, n, value) of the longer grams.

    Each length is one pass over the training texts and joins of tables. A
    transition's suffix is always a transition below, as it occurs at least as often.
    """
    spark = training.sparkSession
    least = _LEAST_WORD
    below = words.filter(F.col("n") >= least).select(F.col("word").alias("key"), "n", ((F.col("n") + 1) / (tokens + kinds + 1)).alias("p"), F.lit(0.0).alias("delta"))
    levels, shared = [], []
    for length in range(2, depth + 2):
        if length > 2:
            shared = [spark.sparkContext.broadcast(_filter(below.filter(F.col("n") >= least))), spark.sparkContext.broadcast(_filter(below))]
        counts = _grams(training, length, tokens, *(shared or (None, None)))
        for x in shared:
            x.destroy()
        contexts = below.filter(F.col("n") >= least).select(F.col("key").alias("pre"), F.col("n").alias("total"))
        rows = counts.join(contexts, "pre").join(below.select(F.col("key").alias("suf"), F.col("p").alias("parent")), "suf")
        rows = stored(rows.select("key", "pre", "n", "total", "parent"), "lm-grams")
        discard(counts)
        own = (F.col("n") - discount) / F.col("total")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent")))
        states = rows.groupBy("pre").agg(gain.alias("gain"), F.greatest(1 - F.sum(own), F.lit(1e-12)).alias("escape"))
        states = stored(states.filter(F.col("gain") >= evidence).select("pre", "escape"), "lm-states")
        p = F.coalesce(own + F.col("escape") * F.col("parent"), F.col("parent"))
        delta = F.coalesce(F.log10(own + F.col("escape") * F.col("parent")) - F.log10("escape") - F.log10("parent"), F.lit(0.0))
        levels.append((below, states))
        below = rows.join(states, "pre", "left").select("key", "n", p.alias("p"), delta.alias("delta"))
        if length <= depth:
            # the longest grams are neither contexts nor suffixes of others, and read once, below
            below = stored(below, "lm-level")
            discard(rows)
        least = _LEAST_CONTEXT
    escapes = lambda states, key: states.select(F.col("pre").alias(key), F.log10("escape").alias("escape"))
    levels.append((below, None))
    values = None
    for level, states in levels[1:]:
        if states is not None:
            level = level.join(escapes(states, "key"), "key", "left").withColumn("delta", F.col("delta") + F.coalesce("escape", F.lit(0.0)))
        level = level.select("key", "n", F.col("delta").alias("value")).filter(F.col("value") != 0)
        values = level if values is None else values.unionByName(level)
    known = words.join(escapes(levels[0][1], "word"), "word", "left").withColumn("escape", F.coalesce("escape", F.lit(0.0))) if depth else words.withColumn("escape", F.lit(0.0))
    if values is None:
        values = spark.createDataFrame([], "key long, n long, value double")
    out = stored(known, "lm-known"), stored(values, "lm-values")
    for level, states in levels:
        for table in (level, states):
            if table is not None and table is not levels[0][0]:
                discard(table)
    return out


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of keys by bucket and piece, the buckets, and where in that order each bucket's pieces begin and end."""
    cell = (((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64) * _PIECES + (key & (_PIECES - 1))
    if buckets * _PIECES <= 1 << 16:
        # short numbers are sorted by their digits
        cell = cell.astype(np.uint16)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    present = np.unique(cell // _PIECES).astype(np.int64)
    grid = (present[:, None] * _PIECES + np.arange(_PIECES)).astype(cell.dtype)
    return order, present, np.searchsorted(cell, grid, "left"), np.searchsorted(cell, grid, "right")


def _blobs(arrays: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [b"".join(x[i:j].tobytes() for x in arrays) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def _packed(entries: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob0, blob1, ...): the entries (key, value, root) as bytes of three arrays, dealt like the grams that look them up."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def rows():
            key, value, root = (np.concatenate(x) for x in zip(*held, strict=True))
            order, present, starts, ends = _dealt(key, buckets)
            arrays = [x[order] for x in (key, value, root)]
            return pa.RecordBatch.from_arrays([pa.array(present), *(pa.array(_blobs(arrays, starts[:, k], ends[:, k]), pa.binary()) for k in range(_PIECES))], names)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size > 1_000_000:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    names = ["bucket", *(f"blob{k}" for k in range(_PIECES))]
    return stored(entries.select("key", "value", "root").mapInArrow(run, "bucket long" + "".join(f", blob{k} binary" for k in range(_PIECES))), "lm-packed")


def _looked_up(entries: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, gained, rare, more): for each row, the values and roots of its grams and how many are words.

    ``entries``: (bucket, blob) of the tree; ``grams``: (bucket, flush, blob), whose
    blobs hold keys and how far their rows lie behind the flush's first. A task
    holds one bucket's entries and looks up its grams as they come by; what it finds
    goes back to the flush, which is summed by row. Both are bounded by how they were cut.
    """

    def looked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, parts, table, held, size = None, [], None, [], 0

        def found():
            nonlocal table
            if table is None:
                columns = [(np.frombuffer(x, np.int64, len(x) // 24), np.frombuffer(x, np.float64, len(x) // 12, len(x) // 3)) for x in parts]
                key = np.concatenate([np.zeros(0, np.int64), *(c[0] for c in columns)])
                order = np.argsort(key)
                value = np.concatenate([np.zeros(0), *(c[1][: len(c[0])] for c in columns)])
                root = np.concatenate([np.zeros(0), *(c[1][len(c[0]) :] for c in columns)])
                table = Places(key[order]), value[order], root[order]
            sizes = [len(x) // 10 for _, x in held]
            place = table[0].find(np.concatenate([np.frombuffer(x, np.int64, m) for (_, x), m in zip(held, sizes, strict=True)]))
            at, out = 0, []
            for (_, blob), m in zip(held, sizes, strict=True):
                mine, behind = place[at : at + m], np.frombuffer(blob, np.uint16, m, 8 * m)
                hit = mine >= 0
                mine, behind = mine[hit], behind[hit]
                root = table[2][mine]
                word = root > 0
                out.append(b"".join(x.tobytes() for x in (np.array([len(mine)]), table[1][mine], behind, root[word], behind[word])))
                at += m
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.int64()), pa.array(out, pa.binary())], ["flush", "blob"])

        for batch in batches:
            for bucket, flush, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != own:
                    if held:
                        yield found()
                    own, parts, table, held, size = bucket, [], None, [], 0
                if flush is None:
                    parts.append(blob)
                    continue
                held.append((flush, blob))
                size += len(blob)
                if size > 5_000_000:
                    yield found()
                    held, size = [], 0
        if held:
            yield found()

    def summed(table):
        import pyarrow as pa

        parts = []
        for blob in table.column("blob").to_pylist():
            m = int(np.frombuffer(blob, np.int64, 1)[0])
            k = (len(blob) - 8 - 10 * m) // 10
            parts.append((
                np.frombuffer(blob, np.float64, m, 8), np.frombuffer(blob, np.uint16, m, 8 + 8 * m),
                np.frombuffer(blob, np.float64, k, 8 + 10 * m), np.frombuffer(blob, np.uint16, k, 8 + 10 * m + 8 * k),
            ))
        value, behind, root, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = int(behind.max()) + 1 if len(behind) else 0
        any_ = np.flatnonzero(np.bincount(behind, minlength=n))
        # without input the sums would be whole numbers
        sums = (np.bincount(behind, value, n).astype(float), np.bincount(word, root, n).astype(float), np.bincount(word, minlength=n))
        first = table.column("flush")[0].as_py()
        return pa.table([pa.array(any_ + first), *(pa.array(x[any_]) for x in sums)], ["row", "gained", "rare", "more"])

    both = entries.select("bucket", F.lit(None).cast("long").alias("flush"), "blob").unionByName(grams.select("bucket", "flush", "blob")).filter(F.length("blob") > 0)
    # the tree's entries come first in their bucket, as nulls do
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "flush")
    back = dealt.mapInArrow(looked, "flush long, blob binary")
    return back.groupBy("flush").applyInArrow(summed, "row long, gained double, rare double, more long")




def score(docs: DataFrame, training: DataFrame, **options) -> DataFrame:
    """`scored`, its tables joined by hash where they are small enough."""
    with _hashed_joins(docs.sparkSession):
        return scored(docs, training, **options)


def scored(docs: DataFrame, training: DataFrame, *, depth: int = 2, context_share: float = 2e-6, next_share: float = 5e-7, **growth) -> DataFrame:
    """The row's id and content hash, n_tokens, n_known, train_tokens, base_score and score of every input row.

    The shares bound what is broadcast, of words and of longer grams, and have no effect on scores.
    """
    spark = docs.sparkSession
    counts = counted(training)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    tokens, kinds = int(totals.tokens), int(totals.kinds)
    words, values = tables(training, counts, tokens, kinds, depth=depth, **growth)
    discard(counts)
    floor = float(np.log10(tokens + kinds + 1))
    buckets = min(1 + tokens // _BUCKET, 1 << 20)
    often = F.col("n") >= max(2, tokens * next_share)
    known = (F.col("n") >= max(2, tokens * context_share)) | (F.col("word") == int(hashes_of([_END])[0]))
    alphabet, counts, escapes = _arrays(words.filter(known).orderBy("word"))
    keys, _, gains = _arrays(values.filter(often).orderBy("key"))
    seldom = values.filter(~often).select("key", "value")
    root = F.log10(F.col("n") + 1)
    entries = seldom.withColumn("root", F.lit(0.0)).unionByName(words.filter(~known).select(F.col("word").alias("key"), (root + F.col("escape")).alias("value"), root.alias("root")))
    shared = spark.sparkContext.broadcast((alphabet, np.log10(counts + 1) - floor, escapes, keys, gains, _filter(seldom)))
    packed = _packed(entries, buckets)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        alphabet, roots, escapes, keys, gains, bits = shared.value
        alphabet, keys = Places(alphabet), Places(keys)
        held, size, first = [], 0, None

        def filled(columns, n):
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def flushed():
            key, behind = (np.concatenate(x) for x in zip(*held, strict=True))
            order, present, starts, ends = _dealt(key, buckets)
            key, behind = key[order], behind[order]
            # a cell that is far too large may hold a key that is seldom in training only
            for i, j in zip(starts.ravel().tolist(), ends.ravel().tolist(), strict=True):
                if j - i > _HOT + 4 * len(key) // (buckets * _PIECES):
                    kinds, place, times = np.unique(key[i:j], return_inverse=True, return_counts=True)
                    hot = (times > _HOT)[place]
                    if hot.any():
                        k = int(hot.sum())
                        yield filled({"row": pa.array(behind[i:j][hot].astype(np.int64) + first), "hot": pa.array(key[i:j][hot])}, k)
                        # what is left comes first in the cell, and the cell ends with it
                        rest = np.argsort(hot, kind="stable")
                        key[i:j], behind[i:j] = key[i:j][rest], behind[i:j][rest]
                        ends[(starts == i) & (ends == j)] -= k
            columns = {f"grams{k}": pa.array(_blobs([key, behind], starts[:, k], ends[:, k]), pa.binary()) for k in range(_PIECES)}
            yield filled({"row": pa.array(np.full(len(present), first)), "bucket": pa.array(present), **columns}, len(present))

        for batch in (x for b in batches for x in slices(b, 512)):
            gram, starts = read(batch.column(2))
            if not len(starts):
                continue
            rows = batch.column(0).to_numpy()
            if held and (size > 2_000_000 or int(rows[-1]) - first >= 1 << 16):
                yield from flushed()
                held, size = [], 0
            if not held:
                first = int(rows[0])
            n = len(gram)
            before, text = _places(starts, n), np.repeat((rows - first).astype(np.uint16), np.diff(np.append(starts, n)))
            place = alphabet.find(gram)
            seen = place >= 0
            base, own = np.full(n, -floor), np.full(n, -floor)
            base[seen] = roots[place[seen]]
            own[seen] = base[seen] + escapes[place[seen]]
            held.append((gram[~seen], text[~seen]))
            size += len(held[-1][0])
            for length in range(2, depth + 2):
                gram = _longer(gram)
                at = np.flatnonzero(before >= length - 1)
                key = gram[at - length + 1]
                place = keys.find(key)
                hit = place >= 0
                own[at[hit]] += gains[place[hit]]
                more = ~hit & _passes(bits, key)
                held.append((key[more], text[at[more]]))
                size += len(held[-1][0])
            sums = {c: pa.array(np.add.reduceat(x, starts)) for c, x in (("known", seen.astype(np.int64)), ("base", base), ("own", own))}
            yield filled({"row": batch.column(0), "doc_id": batch.column(1), "n_tokens": pa.array(np.diff(np.append(starts, n))), **sums}, batch.num_rows)
        if held:
            yield from flushed()

    import pyarrow as pa

    numbers = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "own": pa.float64(), "hot": pa.int64(), "bucket": pa.int64()}
    schema = pa.schema([*numbers.items(), *((f"grams{k}", pa.binary()) for k in range(_PIECES))])
    kinds_ = "row long, doc_id long, n_tokens long, known long, base double, own double, hot long, bucket long" + "".join(f", grams{k} binary" for k in range(_PIECES))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = stored(source.mapInArrow(run, kinds_), "lm-rows")
    gained = []
    hot = table.filter(F.col("hot").isNotNull()).select("row", F.col("hot").alias("key"))
    if not hot.isEmpty():
        sums = F.sum("value").alias("gained"), F.sum("root").alias("rare"), F.sum((F.col("root") > 0).cast("long")).alias("more")
        gained.append(stored(hot.join(entries, "key").groupBy("row").agg(*sums), "lm-gained"))
    discard(words)
    discard(values)
    for k in range(_PIECES):
        # a part of the keys at a time, as the shuffle of all texts' grams would be the largest of all
        grams = table.filter(F.col("bucket").isNotNull()).select("bucket", F.col("row").alias("flush"), F.col(f"grams{k}").alias("blob"))
        gained.append(stored(_looked_up(packed.select("bucket", F.col(f"blob{k}").alias("blob")), grams), "lm-gained"))
    slim = stored(table.filter(F.col("n_tokens").isNotNull()).select("row", "doc_id", "n_tokens", "known", "base", "own"), "lm-sums")
    discard(packed)
    discard(table)
    found = reduce(DataFrame.unionByName, gained).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("gained", "rare", "more")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return slim.join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare")).alias("base_score"), (F.col("own") + zero("gained")).alias("score"),
    )
