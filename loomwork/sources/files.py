"""Reading and writing documents and vectors: JSON lines, CSV with typed texts, replayed logs, vector files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans import documents


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A schemaless collection of one JSON document per line; a broken line raises."""
    return documents.from_json_lines(spark.read.text(path).filter(F.trim("value") != ""))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A schemaless collection from files that hold one array, or one document, each."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return whole.select(F.explode(many).alias(documents.DOC))


def write_json_lines(df: DataFrame, path: str, where: Column | None = None) -> None:
    rows = df.filter(where) if where is not None else df
    text = F.to_json(F.col(documents.DOC)) if documents.schemaless(df) else F.to_json(F.struct("*"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, where: Column | None = None) -> None:
    """Columns as texts; nested ones as JSON."""
    rows = df.filter(where) if where is not None else df
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map", "variant")}
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def json_texts(df: DataFrame) -> DataFrame:
    """One JSON text per row, for streaming results out."""
    return df.select((F.to_json(F.col(documents.DOC)) if documents.schemaless(df) else F.to_json(F.struct("*"))).alias("value"))


def inferred(text: Column, decimals: bool = False) -> Column:
    """A CSV text as a VARIANT of the first kind that fits: int, long, (decimal,) double, bool, JSON, date, text.

    Numbers with a leading zero or a plus sign stay texts, and so do empty fields become null.
    """
    whole = text.rlike(r"^-?(0|[1-9][0-9]{0,18})$")
    number = text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[-+]\d{2}:?\d{2})?)?$")
    real = F.coalesce(text.try_cast("decimal(38,10)").cast("variant"), text.try_cast("double").cast("variant")) if decimals else text.try_cast("double").cast("variant")
    return (
        F.when((text.isNull()) | (text == ""), F.parse_json(F.lit("null")))
        .when(whole & text.try_cast("long").isNotNull(), text.try_cast("long").cast("variant"))
        .when(number, real)
        .when(F.lower(text).isin("true", "false"), F.lower(text).try_cast("boolean").cast("variant"))
        .when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), F.try_parse_json(text))
        .when(day & F.try_to_timestamp(text).isNotNull(), F.try_to_timestamp(text).cast("variant"))
        .otherwise(text.cast("variant"))
    )


def read_csv(spark: SparkSession, path: str, decimals: bool = False) -> DataFrame:
    """A schemaless collection of CSV rows with a header."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    pairs = [x for c in raw.columns for x in (F.lit(c), inferred(F.col(f"`{c}`"), decimals))]
    return raw.select(F.to_variant_object(F.create_map(*pairs)).alias(documents.DOC))


def replayed(log: DataFrame, key: str = "_id", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The live documents that an append log leaves: the last write of each key, unless it is a deletion."""
    rest = [c for c in log.columns if c not in (key, seq, deleted)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest, deleted), seq).alias("x"))
    return last.filter(~F.coalesce(F.col(f"x.{deleted}"), F.lit(False))).select(key, *[F.col(f"x.{c}") for c in rest])


def compact(spark: SparkSession, path: str, target: str, **names) -> None:
    """Rewrite a log directory with its live documents only."""
    replayed(spark.read.parquet(path), **names).write.mode("overwrite").parquet(target)


def read_vectors(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(id, v) from files of records of a 32-bit length and that many 32-bit numbers; ids count within the sorted files."""
    dtype = {"fvecs": "<f4", "ivecs": "<i4"}[kind]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(content, "<i4")
                size = int(raw[0]) if len(raw) else 0
                rows = raw.reshape(-1, size + 1) if size else np.zeros((0, 1), "<i4")
                if len(rows) and (rows[:, 0] != size).any():
                    raise ValueError(f"{name}: vectors of different lengths")
                values = rows[:, 1:].copy().view(dtype).astype(float)
                ends = pa.array(np.arange(0, values.size + 1, max(1, size), dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), lists], ["file", "pos", "v"])

    rows = files.mapInArrow(run, "file string, pos long, v array<double>")
    from pyspark.sql import Window as W

    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("file", first.alias("first")), "file").select((F.col("first") + F.col("pos")).alias("id"), "v")


def vector_bytes(v: Column, kind: str = "fvecs") -> Column:
    """One record of a vector file."""
    dtype = {"fvecs": "<f4", "ivecs": "<i4"}[kind]

    @F.pandas_udf("binary")
    def record(rows):
        return rows.map(lambda x: np.int32(len(x)).tobytes() + np.asarray(x).astype(dtype).tobytes())

    return record(v)


def synthetic_vectors(spark: SparkSession, n: int, size: int, *, clusters: int = 0, spread: float = 0.08, seed: int = 42) -> DataFrame:
    """(id, v) drawn evenly from [0, 1), or around random centres; a row's vector depends on the seed and its id only."""
    centres = np.random.default_rng(seed).random((clusters, size)) if clusters else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                rows.append(rng.random(size) if centres is None else centres[rng.integers(clusters)] + spread * rng.standard_normal(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["id", "v"])

    return spark.range(n).mapInArrow(run, "id long, v array<double>")
