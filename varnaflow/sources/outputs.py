"""Outputs of many tasks under names that others expect: a file of JSON lines for each model, and a saved dataset with its manifest.

Tasks write parts into a folder of their own beside the target; only the commit puts files under their names, and a job that
fails takes its parts away. Paths are local or URIs that driver and tasks both reach.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .files import stored

#: Bytes that are copied at a time.
STEP = 1 << 22
#: Rows of an Arrow file, at most.
SHARD_ROWS = 100_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def file_label(model: str) -> str:
    """A model's name in a file name: blanks become '_' and slashes '-'."""
    return model.replace(" ", "_").replace("/", "-")


@dataclass
class _Parts(WriterCommitMessage):
    files: dict[str, str]


class _PredictionsWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns
        self.folder = f"{self.path}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Parts:
        from pyspark import TaskContext

        where, task = _opened(self.folder), TaskContext.get()
        where[0].create_dir(where[1], recursive=True)
        files, open_ = {}, {}
        try:
            for row in iterator:
                label = file_label(row["model"] or "")
                if label not in open_:
                    files[label] = f"{where[1]}/{len(files)}-{task.partitionId()}-{task.taskAttemptId()}"
                    open_[label] = where[0].open_output_stream(files[label])
                open_[label].write((json.dumps({c: row[c] for c in self.columns if c != "model"}, ensure_ascii=False) + "\n").encode())
        finally:
            for f in open_.values():
                f.close()
        return _Parts(files)

    def commit(self, messages: list) -> None:
        """Joins the parts of each label in the order of tasks, a step of bytes at a time, under a name of its own that is then renamed."""
        where, there = _opened(self.folder)
        for label in sorted({x for m in messages if m for x in m.files}):
            whole = f"{there}/whole"
            with where.open_output_stream(whole) as out:
                for m in messages:
                    if m and label in m.files:
                        with where.open_input_stream(m.files[label]) as part:
                            while step := part.read(STEP):
                                out.write(step)
            where.move(whole, f"{_opened(self.path)[1]}/predictions_{label}.jsonl")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        where, there = _opened(self.folder)
        if where.get_file_info(there).type == fs.FileType.Directory:
            where.delete_dir(there)


class Predictions(DataSource):
    """``df.write.format("predictions").mode("append").save(path)`` of rows with a model: one file ``predictions_<model>.jsonl`` each."""

    @classmethod
    def name(cls) -> str:
        return "predictions"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "model" not in schema.names:
            raise ValueError("rows need a column 'model'")
        return _PredictionsWriter(self.options["path"], schema.names)


def write_predictions(rows: DataFrame, path: str) -> None:
    """A file ``predictions_<model>.jsonl`` for each model, its other columns as JSON lines; models whose names give one file name share it."""
    rows.sparkSession.dataSource.register(Predictions)
    rows.write.format("predictions").mode("append").save(path)


def write_dataset(rows: DataFrame, path: str, split: str = "split", shard_rows: int = SHARD_ROWS) -> None:
    """A saved dataset of Arrow streams: a folder for each value of ``split`` with its shards, a manifest of shards and types, and one of the splits.

    Tasks write shards of at most ``shard_rows`` rows and return their names and counts; the manifests are written at the end, so
    shards of tasks that failed are in none and are not read.
    """
    columns = [c for c in rows.columns if c != split]
    schema = to_arrow_schema(rows.select(*columns).schema)
    target = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, there = _opened(target)
        open_, done = {}, []
        number = TaskContext.get().taskAttemptId()

        def shut(label: str) -> None:
            name, out, sink, n = open_.pop(label)
            out.close()
            sink.close()
            done.append((label, name, n))

        for batch in batches:
            labels = batch.column(batch.schema.get_field_index(split))
            for label in labels.unique().to_pylist():
                part = batch.filter(pc.equal(labels, label)).select(columns).cast(schema) if label is not None else None
                if part is None:
                    raise ValueError("a row without a split")
                while len(part):
                    if label not in open_:
                        name = f"data-{number:08d}-{sum(x[0] == label for x in done):05d}.arrow"
                        where.create_dir(f"{there}/{label}", recursive=True)
                        sink = where.open_output_stream(f"{there}/{label}/{name}")
                        open_[label] = (name, pa.ipc.new_stream(sink, schema), sink, 0)
                    name, out, sink, n = open_[label]
                    step = part.slice(0, shard_rows - n)
                    out.write_batch(step)
                    part, open_[label] = part.slice(len(step)), (name, out, sink, n + len(step))
                    if n + len(step) >= shard_rows:
                        shut(label)
        for label in list(open_):
            shut(label)
        columns_ = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns_[0], pa.string()), pa.array(columns_[1], pa.string()), pa.array(columns_[2], pa.int64())], names=["split", "name", "n"])

    shards = rows.withColumn(split, F.col(split).cast("string")).mapInArrow(run, "split string, name string, n long").collect()  # a row a file
    where, there = _opened(target)
    splits = sorted({r["split"] for r in shards})

    def put(name: str, value: dict) -> None:
        with where.open_output_stream(f"{there}/{name}") as f:
            f.write(json.dumps(value, indent=2).encode())

    where.create_dir(there, recursive=True)
    for label in splits:
        own = sorted((r["name"], r["n"]) for r in shards if r["split"] == label)
        put(f"{label}/state.json", {"_data_files": [{"filename": n} for n, _ in own], "_format_type": None, "_split": label})
        put(f"{label}/dataset_info.json", {"features": {f.name: {"dtype": str(f.type), "_type": "Value"} for f in schema}, "splits": {label: {"name": label, "num_examples": sum(n for _, n in own)}}})
    put("dataset_dict.json", {"splits": splits})


def _manifest(path: str) -> dict:
    where, there = _opened(path)
    with where.open_input_stream(there) as f:
        return json.loads(f.read())


def read_dataset(spark: SparkSession, path: str, split: str = "split") -> DataFrame:
    """A saved dataset: the rows of the shards that its manifests list, columns and types as the first shard has them, and the split of each."""
    target = path.rstrip("/")
    listed = [(label, f"{target}/{label}/{x['filename']}") for label in _manifest(f"{target}/dataset_dict.json")["splits"] for x in _manifest(f"{target}/{label}/state.json")["_data_files"]]
    if not listed:
        return spark.createDataFrame([], f"{split} string")
    where, there = _opened(listed[0][1])
    with where.open_input_stream(there) as f, pa.ipc.open_stream(f) as stream:
        schema = stream.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for label, name in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                at, inside = _opened(name)
                with at.open_input_stream(inside) as f, pa.ipc.open_stream(f) as stream:
                    for b in stream:
                        yield pa.RecordBatch.from_arrays([*[b.column(x.name).cast(x.type) for x in schema], pa.array([label] * len(b), pa.string())], names=[*schema.names, split])

    fields = from_arrow_schema(schema).add(split, "string")
    shards = spark.createDataFrame(listed, "split string, name string").repartition(max(1, min(len(listed), 10_000)), "name")  # a row a file
    return shards.mapInArrow(run, fields)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): the lines of a text file with their numbers from 0, over all its splits; files of a folder one after the other, by name.

    A line's number is its place in its split, and the lines of the splits before: one row a split, in order of file and offset.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    kept = stored(lines.withColumn("_at", F.monotonically_increasing_id()), "lines")
    splits = kept.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_file", "_block", "_first", before.alias("_before"))
    return kept.join(F.broadcast(starts), ["_file", "_block"]).select((F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "value")


def numbered_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction, reference) of JSON lines, id the line's number from 0. Empty lines are no rows; a line that is no JSON has nulls."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    return rows.select(F.col("idx").alias("id"), F.from_json("value", "prediction string, reference string").alias("p")).select("id", "p.prediction", "p.reference")
