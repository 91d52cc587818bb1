"""Command line over the same functions: python -m varnaflow {ingest,evaluate,errors,cleanup,spelling,lattice,review} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.wer import scoring_words, utterance_wer, with_word_edits
from .operators import errors, evaluation, ingest, lattice, models, spelling
from .plans import demos
from .sources import files, http, outputs
from .streaming.cleanup import cleaned, example_notes

MODELS = ["Model H", "Model i", "Model k", "Model l", "Model m", "Model n"]


def _ingest(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Index and transcripts to a split table; with --demo the utterances of --input as one recording."""
    if args.demo:
        return ingest.head(ingest.demo_utterances(files.read_utterances(spark, args.input)), "start")
    index = ingest.hindi_only(files.read_index(spark, args.index))
    url = F.col("transcription_url_gcp")
    index = index.withColumn("transcription_url_gcp", ingest.url_rewritten(url, *args.rewrite) if args.rewrite else url)
    rows = ingest.utterances(http.with_segments(index, "transcription_url_gcp"))
    rows = files.stored(rows.select("user_id", "recording_id", F.col("rec_url_gcp").alias("audio_url"), "start", "end", "duration", "raw_text", "text", "language"), "utterances")  # each URL is fetched once
    kept = ingest.filtered(ingest.capped(rows, "recording_id", args.max))
    return ingest.split(kept, F.concat_ws("|", F.col("recording_id").cast("string"), F.col("start").cast("string"), F.col("raw_text")))


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Rates of every NAME=PATH that is there; of two, the comparison too is printed."""
    paths = dict(x.split("=", 1) for x in args.predictions)
    there = models.present(spark, paths)
    rows = None
    for name in there:
        one = files.read_predictions(spark, paths[name]).withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise SystemExit("no predictions found")
    rates = evaluation.corpus_rates(rows)
    if len(there) == 2:
        evaluation.comparison(rates, *there).show(truncate=False)
    return rates


def _errors(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The sample with reasons; the taxonomy of the sample is printed."""
    rows = outputs.numbered_predictions(spark, args.input if args.fallback is None or files.exists(spark, args.input) else args.fallback)
    rows = rows.withColumns({"reference": F.coalesce("reference", F.lit("")), "prediction": F.coalesce("prediction", F.lit(""))})
    rows = with_word_edits(rows.withColumns({"r": scoring_words(F.col("reference")), "h": scoring_words(F.col("prediction"))}), "r", "h")
    rows = rows.withColumns({"wer": utterance_wer(F.col("edits"), F.col("r")), "error_type": errors.classify_error(F.col("reference"), F.col("prediction"))})
    sample = files.stored(errors.systematic_sample(files.stored(rows.drop("r", "h"), "scored"), "id"), "sample")
    errors.with_fix(errors.with_cause(errors.taxonomy(sample, "id"))).show(truncate=False)
    return errors.error_samples(sample).orderBy("idx")


def _cleanup(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = demos.sentences(spark) if args.demo else spark.createDataFrame([(args.text,)], "text string") if args.text is not None else files.read_utterances(spark, args.input)
    return example_notes(cleaned(rows)) if args.notes else cleaned(rows)


def _spelling(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    word = args.word if args.word is not None else args.text
    words = spark.createDataFrame([(word,)], "word string") if word is not None else files.read_words(spark, args.input) if args.input else spelling.sample_words(spark, args.sample)
    rows = files.stored(spelling.classify(words.withColumn("id", F.monotonically_increasing_id()), "id"), "classified")
    spelling.stats(rows).show()
    spelling.first_low(rows, "id").select("word", "label", spelling.signal_score(spelling.signals_json()).alias("lm_score")).show(truncate=False)
    return rows.select("word", F.col("label").alias("spelling_label"), "confidence", spelling.signals_json().alias("signals"))


def _lattice(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.demo:
        segments = demos.lattice_segments(spark)
    elif args.input.endswith(".json"):
        segments = files.lattice_segments(files.read_lattices(spark, args.input))
    else:
        segments = files.wide_segments(files.read_strings(spark, args.input), args.key, args.reference, args.models)
    rows = lattice.report(segments)
    return rows.withColumn("change", lattice.arrow(F.col("standard_wer_pct"), F.col("lattice_wer_pct"))) if args.demo else rows


def _review(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = files.read_strings(spark, args.results or args.input).withColumnRenamed("spelling_label", "label")
    sample = files.stored(spelling.low_confidence_sample(rows, n=args.n), "low")
    signals = F.col("signals") if "signals" in sample.columns else F.lit("{}")
    sample.select("word", "label", spelling.signal_score(signals).alias("lm_score")).show(args.n, truncate=False)
    spelling.failure_categories(spark).show(truncate=False)
    return spelling.review(sample)


COMMANDS = {"ingest": _ingest, "evaluate": _evaluate, "errors": _errors, "cleanup": _cleanup, "spelling": _spelling, "lattice": _lattice, "review": _review}


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return COMMANDS[args.command](spark, args)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varnaflow")
    p.add_argument("command", choices=tuple(COMMANDS))
    p.add_argument("--text", help="one text in place of --input")
    p.add_argument("--word", help="one word in place of --input")
    p.add_argument("--input", help="JSON utterances, JSON lines of predictions, a word list, a wide CSV, a lattice JSON")
    p.add_argument("--fallback", help="predictions to read if --input isn't there")
    p.add_argument("--predictions", nargs="*", default=[], metavar="NAME=PATH", help="predictions of each model")
    p.add_argument("--index", help="CSV of recordings")
    p.add_argument("--rewrite", nargs=2, metavar=("OLD", "NEW"), help="replaced in the index's URLs")
    p.add_argument("--max", type=int, help="utterances, up to the end of a recording")
    p.add_argument("--results", help="CSV of classified words")
    p.add_argument("--demo", action="store_true", help="built-in rows")
    p.add_argument("--notes", action="store_true", help="cleanup with what changed")
    p.add_argument("--sample", type=int, help="so many built-in words")
    p.add_argument("--output", help="a folder: CSV, for ingest a split table, for evaluate and errors JSON; else the rows are shown")
    p.add_argument("--key", default="segment_url_link")
    p.add_argument("--reference", default="Human")
    p.add_argument("--models", nargs="*", default=MODELS)
    p.add_argument("--n", type=int, default=45)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    out = run(SparkSession.builder.appName("varnaflow").getOrCreate(), args)
    if not args.output:
        out.show(50, truncate=False)
    elif args.command == "ingest" and not args.demo:
        files.write_split(out, args.output)
    elif args.command == "evaluate":
        files.write_rates(out, args.output)
    elif args.command == "errors":
        files.write_error_samples(out, args.output)
    else:
        flat = [F.to_json(c).alias(c) if "<" in t else F.col(c) for c, t in out.dtypes]
        files.write_csv(out.select(*flat), args.output)


if __name__ == "__main__":
    main()
