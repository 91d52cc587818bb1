import json

import pytest
from pyspark.sql import functions as F
from varnaflow.sources import outputs


def test_one_file_for_each_model(spark, tmp_path):
    table = spark.range(500).select(F.when(F.col("id") % 3 == 0, "big / one").otherwise("small").alias("model"), F.concat(F.lit('"क\n'), F.col("id").cast("string")).alias("prediction"), F.lit(None).cast("string").alias("reference")).repartition(7)
    path = tmp_path / "p"
    outputs.write_predictions(table, str(path))
    assert sorted(x.name for x in path.iterdir()) == ["predictions_big_-_one.jsonl", "predictions_small.jsonl"]
    lines = [json.loads(x) for x in (path / "predictions_big_-_one.jsonl").read_text(encoding="utf-8").splitlines()]
    assert sorted(int(x["prediction"][3:]) for x in lines) == list(range(0, 500, 3)) and all(x == {"prediction": x["prediction"], "reference": None} for x in lines)
    outputs.write_predictions(table.limit(0), str(tmp_path / "none"))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    table = spark.range(100).repartition(4).select(F.lit("m").alias("model"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").alias("prediction"))
    path = tmp_path / "p"
    with pytest.raises(Exception, match="no"):
        outputs.write_predictions(table, str(path))
    assert not path.exists() or list(path.iterdir()) == []
    with pytest.raises(Exception, match="model"):
        outputs.write_predictions(table.drop("model"), str(path))


def test_saved_dataset_keeps_types_and_lists_its_shards(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"split": F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train"), "tags": F.array("lang"), "share": F.col("n_chars").cast("float")})
    path = str(tmp_path / "d")
    outputs.write_dataset(table.repartition(3), path, shard_rows=20)
    assert json.loads((tmp_path / "d/dataset_dict.json").read_text()) == {"splits": ["train", "validation"]}
    listed = [x["filename"] for x in json.loads((tmp_path / "d/train/state.json").read_text())["_data_files"]]
    assert len(listed) >= 8 and json.loads((tmp_path / "d/train/dataset_info.json").read_text())["splits"]["train"]["num_examples"] == 160
    (tmp_path / "d/train/data-left-over.arrow").write_bytes(b"a task that failed")
    got = outputs.read_dataset(spark, path)
    assert [t for c, t in got.dtypes if c != "split"] == [t for c, t in table.dtypes if c != "split"]
    assert sorted(map(str, got.select(table.columns).collect())) == sorted(map(str, table.collect()))
    outputs.write_dataset(table.limit(0), str(tmp_path / "none"))
    assert outputs.read_dataset(spark, str(tmp_path / "none")).count() == 0


def test_numbers_of_lines_over_many_splits(spark, tmp_path):
    lines = [json.dumps({"prediction": "क" * (k % 50), "reference": str(k)}, ensure_ascii=False) if k % 10 else "" for k in range(5000)]
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        table = outputs.numbered_lines(spark, str(tmp_path / "p.jsonl"))
        assert spark.read.text(str(tmp_path / "p.jsonl")).rdd.getNumPartitions() > 5
        assert sorted((r.idx, r.value) for r in table.collect()) == list(enumerate(lines))
        got = outputs.numbered_predictions(spark, str(tmp_path / "p.jsonl")).collect()
        assert {(r.id, r.reference) for r in got} == {(k, str(k)) for k in range(5000) if k % 10}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "q.jsonl").write_text("no json\n")
    assert outputs.numbered_predictions(spark, str(tmp_path / "q.jsonl")).first().prediction is None


def test_error_samples_name_the_lines(spark, tmp_path):
    from varnaflow.__main__ import parser, run

    rows = [("क ख ग घ", "क ख ग घ")] * 3 + [("क ख ग च", "क ख ग घ")] + [("क ख ग घ", "क ख ग घ")] * 2 + [("x", "क ख ग घ")]
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"prediction": p, "reference": r}) + "\n" for p, r in rows), encoding="utf-8")
    got = run(spark, parser().parse_args(["errors", "--input", str(tmp_path / "p.jsonl")])).collect()
    assert [(r.idx, r.error_type) for r in got] == [(3, "SUBSTITUTION_OOV"), (6, "CODE_MIX")]


def test_transcript_files_do_not_grow_with_the_conversations(spark, tmp_path, monkeypatch):
    """Files and folders follow the characters, half the files are broken, and what is read back are all turns."""
    from varnaflow.plans import catalog
    from varnaflow.sources import files

    turns = spark.range(9000).select((F.col("id") / 3).cast("long").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.when(F.col("id") % 9 > 0, F.concat(F.lit('क "[]\n'), F.col("id").cast("string"))).alias("text"))
    turns = turns.union(spark.createDataFrame([(None, None, "x"), (None, 2, None)], "conv_id long, turn long, text string"))
    for name, table, chars, least, most in (("one", turns, 1 << 20, 2, 2), ("many", turns, 10_000, 60, 160), ("none", turns.limit(0), 1 << 20, 0, 1)):
        table.write.parquet(str(tmp_path / name / "conversations.parquet"))
        monkeypatch.setattr(catalog, "FILE_CHARS", chars)
        monkeypatch.setattr(files, "shared_folder", lambda spark, kind, at=str(tmp_path / name / "files"): at)
        got = catalog.q_transcripts_roundtrip(spark, str(tmp_path / name)).collect()
        made = [x for x in (tmp_path / name / "files").rglob("part-*")]
        assert least <= len(made) <= most and {x.parent for x in made} <= {tmp_path / name / "files"}
        want = table.select(F.col("turn").cast("double").alias("start"), F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise("").alias("text")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
