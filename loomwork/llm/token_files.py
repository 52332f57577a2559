"""Token ids in Parquet list columns, with selective reads of ids or metadata.

One row per document in ascending id order: doc_id, part, start_in_part,
n_tokens and the ids as a list. The list column is dictionary-encoded (or, with
``encoding="delta"``, DELTA_BINARY_PACKED); row groups and pages have set sizes,
and the writer adds column and offset indexes, so a reader can fetch one
document's ids or only the metadata columns.

Defined results: a null text counts as empty (only its end token); rows with a
null id come first; repeated ids keep one row each, in no further order; an
empty table gives an empty file set; further columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import tokens

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def write(
    docs: DataFrame,
    path: str,
    *,
    vocabulary: str | None = None,
    end_id: int | None = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode every whole text and write the files to ``path``, which must be in a shared store.

    One range shuffle puts the texts in id order; encoding follows it, batch by
    batch, and Spark's own Parquet writer stores the result.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokens.encoder(vocabulary, end_id).encode_column
        part, start = TaskContext.get().partitionId(), 0
        for batch in (x for b in batches for x in tokens.slices(b)):
            found = encode(batch.column(1))
            sizes = np.asarray([len(x) // 4 for x in found], np.int64)
            ends = np.cumsum(sizes)
            flat = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists],
                [f.name for f in FILE_SCHEMA],
            )
            start += int(ends[-1]) if len(ends) else 0

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = plain.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (
        rows.mapInArrow(run, FILE_SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The chosen columns of the files, or all; metadata reads never touch the ids."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first): ids in all parts before each part, from metadata columns alone.

    One row per written part, so the running sum sees a few rows per terabyte.
    """
    sums = read(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the page index lets the scan skip all other pages."""
    return read(spark, path, "doc_id", "ids").filter(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path, "doc_id", "part", "start_in_part", "ids").mapInArrow(
        run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts(spark, path), "part").select(
        "doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
