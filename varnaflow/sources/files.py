"""Readers and writers of the file shapes used here; schemas are given, never inferred."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import strip, tokenize

INDEX = "user_id long, recording_id long, language string, duration double, rec_url_gcp string, transcription_url_gcp string, metadata_url string"
SEGMENTS = "start double, end double, text string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="varnaflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again, for a small table that several branches of a plan use."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A table of few splits over all cores, for costly work on each row. A table that has a split for every second core stays as it is: no shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=INDEX)


def _arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold a JSON array each; files that are broken or gone give none."""
    whole = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return whole.select("file", F.inline(F.from_json("value", ArrayType(StructType.fromDDL(schema)))))


def write_arrays(rows: DataFrame, path: str) -> None:
    """A file in one folder for each ``value``, a JSON array. Who reads them lists them in the driver, so many small arrays belong into one."""
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Landed transcript files (a JSON array each); files that are broken or gone are empty."""
    return _arrays(spark, path, SEGMENTS).withColumn("text", F.coalesce("text", F.lit("")))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def read_predictions(spark: SparkSession, path: str, otherwise: str | None = None) -> DataFrame:
    """JSON lines {prediction, reference}; the other path if the first isn't there."""
    return spark.read.schema("prediction string, reference string").json(path if otherwise is None or exists(spark, path) else otherwise)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).filter("word <> ''")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; empty cells, quoted or not, are null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_lattices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("reference string, model_outputs map<string,string>").json(path, multiLine=True)


def lattice_segments(lattices: DataFrame) -> DataFrame:
    """(segment, text, reference array, models array<struct<model, words, text>>) of (reference, model_outputs) rows, the shape of the lattice operators; models in order of name."""
    told = F.filter(F.map_entries("model_outputs"), lambda e: e.value.isNotNull() & (strip(e.value) != ""))
    models = F.array_sort(F.transform(told, lambda e: F.struct(e.key.alias("model"), tokenize(e.value).alias("words"), e.value.alias("text"))))
    return lattices.select(F.monotonically_increasing_id().cast("string").alias("segment"), F.col("reference").alias("text"), tokenize(F.col("reference")).alias("reference"), models.alias("models"))


def wide_segments(wide: DataFrame, key: str, reference: str, models: list[str]) -> DataFrame:
    """The same of a wide table, one row for each of its rows: rows that share a key or the end of one stay apart. Null cells and the text 'nan' are missing; models in order of their columns."""
    clean = lambda c: strip(F.col(f"`{c}`"))
    given = lambda x: x.isNotNull() & ~x.isin("", "nan")
    told = F.filter(F.array(*[F.struct(F.lit(m).alias("model"), tokenize(clean(m)).alias("words"), clean(m).alias("text")) for m in models]), lambda m: given(m.text))
    kept = wide.filter(given(F.col(f"`{key}`")) & given(clean(reference)))
    rows = kept.select(F.element_at(F.split(F.col(f"`{key}`"), "/"), -1).alias("segment"), clean(reference).alias("text"), tokenize(clean(reference)).alias("reference"), told.alias("models"))
    return rows.filter(F.size("models") > 0)


def write_split(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("split").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of JSON array files; a missing text is empty, broken files give none."""
    return _arrays(spark, path, SEGMENTS).drop("file").withColumn("text", F.coalesce("text", F.lit("")))


def read_saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A split saved as Arrow streams (``*.arrow`` files in one folder), columns of ``schema`` by name; a missing column is null."""
    fields = StructType.fromDDL(schema)
    kind = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                with pa.ipc.open_stream(content.as_buffer()) as stream:
                    for b in stream:
                        yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(len(b), f.type) for f in kind], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")
    return files.mapInArrow(run, fields)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(id, audio, reference) of a landed public test split in Parquet, whose transcription is the reference."""
    rows = spark.read.parquet(path)
    audio = F.col("audio") if "audio" in rows.columns else F.lit(None).cast("binary")
    return rows.select(F.monotonically_increasing_id().alias("id"), audio.alias("audio"), strip(F.coalesce("transcription", F.lit(""))).alias("reference"))


def write_error_samples(rows: DataFrame, path: str) -> None:
    """One file that is a JSON array of (idx, reference, prediction, wer, error_type, reasoning), in order; a sample is bounded by its quotas."""
    fields = ("idx", "reference", "prediction", "wer", "error_type", "reasoning")
    whole = F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("_at"), F.to_json(F.struct(*fields)).alias("j")))), lambda x: x.j)
    rows.agg(F.concat(F.lit("["), F.array_join(whole, ",\n"), F.lit("]")).alias("value")).write.text(path)


def write_rates(rows: DataFrame, path: str) -> None:
    """JSON of (model, wer, num_samples)."""
    write_json(rows.select("model", "wer", "num_samples").coalesce(1), path)  # one row a model
