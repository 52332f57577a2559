"""Quality rules: whole-text statistics and cross-document line frequency.

Lines are normalised and hashed; for each host the operator counts the distinct
documents that hold a line, takes lines above the limit out, and rejects
documents of which too little is left. Copies of one document don't count as
distinct: a document is known, for this count, by a hash of all its normalised
lines in order, so a clean text is not rejected for having been copied, however
often, and documents that differ in any line, or in their order or number, count
each.

DataFrame code throughout. Texts are read once, into a slim table of statistics
and (line hash, words) pairs; everything after works on that table.

Defined results: a null text has no words and fails; a null host is a host of
its own; repeated rows are separate rows with equal verdicts; an empty table
gives no rows; input columns stay, and those named like a result column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import text
from loomwork.session import sized, stored

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULT = (*STATISTICS, "removed_words", "kept")


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur at least twice in the text.

    Windows are hashed with their place and sorted, so equal ones lie side by
    side; only texts with some equal windows get that far.
    """

    def covered(placed: Column) -> Column:
        last = F.size(placed) - 1
        same = F.filter(
            F.transform(
                placed,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(placed, i + 1)["h"] == x["h"])), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1, i + 2)))))

    def counted(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(text.bound(placed, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(text.bound(windows, counted)).cast("long")


def normalised(body: Column) -> Column:
    """A text in lower case, with digits as 0 and the white space of its lines squeezed; lines are still to be trimmed."""
    return text.squeezed_lines(F.regexp_replace(F.lower(body), "[0-9]+", "0"))


def measured(docs: DataFrame, *, host: str, min_words: int, most_repeated: int) -> DataFrame:
    """One slim row per input row: id, content hash, host, statistics, base_failed, and its lines with a word."""
    rows = docs.select("doc_id", F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__body"))
    body = F.col("__body")

    def of_words(plain: Column) -> Column:
        words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))
        n = text.spaced_words(plain)
        chars = F.when(plain == "", 0).otherwise(F.length(plain) - n + 1).cast("long")
        return F.struct(n.alias("n"), chars.alias("chars"), text.bound(words, repeated_words).alias("repeats"))

    with_word = F.filter(F.split(body, "\n"), lambda x: x.rlike(text.WORD))
    dups = text.bound(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    lines = F.filter(F.transform(F.split(normalised(body), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.select(
        "doc_id", F.xxhash64(body).alias("content"), "host", text.bound(text.squeezed(body), of_words).alias("w"), dups.alias("dups"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), text.spaced_words(x).alias("words"))).alias("lines"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.monotonically_increasing_id().alias("__row"),
    )
    # The struct is written before it is taken apart, so it is computed once.
    out = stored(out, "line-stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.select(
        "__row", "doc_id", "content", "host", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols",
        F.col("dups").alias("n_dup_lines"), F.col("w.repeats").alias("n_repeat_words"), "lines",
    ).withColumn("base_failed", failed)


def judged(
    docs: DataFrame, *, host: str = "source", most_docs: int = 20, least_left: int = 30, min_words: int = 50, most_repeated: int = 50
) -> DataFrame:
    """doc_id, content, statistics, base_failed, removed_words and kept for every input row.

    ``most_docs``: distinct documents of a host that may share a line.
    ``least_left``: per cent of a document's words that must be left.
    """
    slim = measured(docs, host=host, min_words=min_words, most_repeated=most_repeated)
    keyed = slim.select("__row", "host", "lines", F.xxhash64("lines.line").alias("whole"))
    distinct = keyed.select("host", "whole", F.explode(F.array_distinct("lines.line")).alias("line"))
    counts = distinct.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    common = stored(counts.filter(F.col("docs") > most_docs).select(F.col("host").alias("__h"), F.col("line").alias("__l")), "line-common")
    flat = keyed.select("__row", "host", F.explode("lines").alias("x")).select("__row", "host", "x.line", "x.words")
    removed = (
        flat.join(common, F.col("host").eqNullSafe(F.col("__h")) & (F.col("line") == F.col("__l")))
        .groupBy("__row").agg(F.sum("words").cast("long").alias("removed_words"))
    )
    rows = slim.drop("lines", "host").join(removed, "__row", "left").withColumn("removed_words", F.coalesce(F.col("removed_words"), F.lit(0)).cast("long"))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= least_left * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & left).drop("__row")


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """The input rows with their statistics and verdict, joined back by id and content."""
    verdicts = judged(docs, **limits).dropDuplicates(["doc_id", "content"])
    verdicts = verdicts.withColumnsRenamed({"doc_id": "__doc", "content": "__content"})
    return docs.drop(*RESULT).join(verdicts, _same(), "left").drop("__doc", "__content")


def kept_rows(docs: DataFrame, **limits) -> DataFrame:
    """The input rows that are kept. The rejected ones' ids and hashes are broadcast up to a million rows, and joined by shuffle beyond."""
    gone = judged(docs, **limits).filter(~F.col("kept")).select(F.col("doc_id").alias("__doc"), F.col("content").alias("__content"))
    return docs.join(sized(stored(gone.distinct(), "line-rejected")), _same(), "left_anti")


def _same() -> Column:
    content = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.col("doc_id").eqNullSafe(F.col("__doc")) & (content == F.col("__content"))
