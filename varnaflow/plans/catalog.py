"""All queries on the driver's tables, and SQL that gives the same rows. Every query runs over its whole tables and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codemix, wer
from ..functions.numbers import MULTIPLIER_VALUES, UNIT_VALUES, normalize_numbers, words_to_number
from ..functions.text import normalize_text, once, tokenize, words
from ..operators import audio, errors, evaluation, ingest, labels, lattice, spelling
from ..sources import files, http, outputs
from ..streaming.cleanup import cleaned, example_notes

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LATIN, _DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "ािकगचेजतीटडदनपोबमंयरुलवसहॉ"
#: Number words that may end a span: those whose last character is a letter.
_NUMBERS = [(w, v) for w, v in UNIT_VALUES.items() if v and w[-1].isalpha()]
_MARK_FINAL = [(w, v) for w, v in (UNIT_VALUES | MULTIPLIER_VALUES).items() if v and not w[-1].isalpha()]
_ALL_NUMBERS = [(w, v) for w, v in UNIT_VALUES.items() if v]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, over all cores even if it is one small file."""
    return files.spread(_table(spark, sf_dir, name).select(*columns))


# --- text -------------------------------------------------------------------------------------------------------------


def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", normalize_text(F.col("text")).alias("text"))


def q_tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(F.col("text"))
    return _spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(t).cast("long").alias("n_words"), F.array_join(t, "|").alias("words"))


_PUNCT_SQL = r"""[।!?,;:()\[\]"''-]"""
_NORM_SQL = lambda c: rf"regexp_replace(regexp_replace(regexp_replace({c}, '{_PUNCT_SQL}', ' ', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
NORMALIZE_SQL = f"SELECT doc_id, {_NORM_SQL('text')} AS text FROM documents"
TOKENS_SQL = f"""WITH t AS (SELECT doc_id, list_filter(string_split({_NORM_SQL('text')}, ' '), lambda w: w <> '') AS t FROM documents)
SELECT doc_id, len(t) AS n_words, array_to_string(t, '|') AS words FROM t"""

# --- ingestion --------------------------------------------------------------------------------------------------------


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recordings: a turn is a segment that starts at its number and lasts a hundredth second a character."""
    c = _table(spark, sf_dir, "conversations")
    seg = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + F.length("text") / 100.0).alias("end"), F.col("text").alias("text"))
    return c.groupBy(F.col("conv_id").alias("recording_id")).agg(F.array_sort(F.collect_list(seg)).alias("segments"))


def q_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("language", F.when(F.col("lang") == "en", "Hindi").when(F.col("lang") == "fr", "hi").otherwise(F.col("lang")))
    return ingest.hindi_only(d).select("doc_id", "language")


def q_url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", ingest.url_rewritten(F.col("url"), "http://", "https://").alias("url"))


def q_utterance_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.utterances(_recordings(spark, sf_dir)).select("recording_id", "start", F.round("duration", 6).alias("duration"), "text")


def q_utterance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.filtered(ingest.utterances(_recordings(spark, sf_dir)), 1.0, 10.0).select("recording_id", "start", "text")


def q_utterance_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many utterances the filter keeps and removes, in one pass."""
    u = ingest.utterances(_recordings(spark, sf_dir))
    kept = F.col("duration").between(1.0, 10.0)
    return u.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


def q_max_samples_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.capped(ingest.utterances(_recordings(spark, sf_dir)), "recording_id", 100).select("recording_id", "start")


def q_train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.split(_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


def q_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their places in the shuffled order."""
    return ingest.numbered(ingest.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id")), "place")


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five utterances that the filter keeps, cut short for a report."""
    u = ingest.filtered(ingest.utterances(_recordings(spark, sf_dir)), 1.0, 10.0).withColumn("place", F.col("recording_id") * 1000 + F.col("start"))
    return ingest.head(u, "place").select("recording_id", "start", "raw_text", "text")


def q_demo_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as one recording under a given id."""
    c = _table(spark, sf_dir, "conversations").select(F.col("turn").cast("double").alias("start"), (F.col("turn") + F.length("text") / 100.0).alias("end"), "text")
    return ingest.demo_utterances(c, 7, 11, 1.0, 10.0).select("user_id", "recording_id", "start", "text", "language")


_UTT = f"""utt AS (SELECT conv_id AS recording_id, turn::DOUBLE AS start, length(text) / 100.0::DOUBLE AS duration, {_NORM_SQL('text')} AS text FROM conversations WHERE {_NORM_SQL('text')} <> '')"""
UTT_SQL = f"WITH {_UTT} SELECT recording_id, start, round((start + duration) - start, 6) AS duration, text FROM utt"
UTT_FILTER_SQL = f"WITH {_UTT} SELECT recording_id, start, text FROM utt WHERE (start + duration) - start BETWEEN 1.0 AND 10.0"
REMOVED_SQL = f"WITH {_UTT} SELECT count(*) FILTER ((start + duration) - start BETWEEN 1.0 AND 10.0) AS kept, count(*) FILTER (NOT (start + duration) - start BETWEEN 1.0 AND 10.0) AS removed FROM utt"
SHUFFLED_SQL = "SELECT doc_id, source, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) - 1 AS place FROM documents"
PREVIEW_SQL = f"""WITH {_UTT}, k AS (SELECT recording_id, start, text FROM utt WHERE (start + duration) - start BETWEEN 1.0 AND 10.0 ORDER BY recording_id * 1000 + start LIMIT 5)
SELECT recording_id, start, left(regexp_replace(c.text, '^{_WS}+|{_WS}+$', '', 'g'), 60) AS raw_text, left(k.text, 60) AS text FROM k JOIN conversations c ON recording_id = conv_id AND start = turn"""
DEMO_UTT_SQL = f"WITH {_UTT} SELECT 7::BIGINT AS user_id, 11::BIGINT AS recording_id, start, text, 'hi' AS language FROM utt WHERE (start + duration) - start BETWEEN 1.0 AND 10.0"
CAP_SQL = f"""WITH {_UTT}, n AS (SELECT recording_id, count(*) AS n FROM utt GROUP BY 1), b AS (SELECT recording_id, coalesce(sum(n) OVER (ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
SELECT recording_id, start FROM utt WHERE recording_id IN (SELECT recording_id FROM b WHERE b < 100)"""
SPLIT_SQL = """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) <= floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM documents"""

# --- word error rates -------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn as reference, the next turn as prediction; odd conversations in Devanagari letters."""
    c = _spread(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    text = F.when(F.col("conv_id") % 2 == 1, F.translate(F.lower("text"), _LATIN, _DEVANAGARI)).otherwise(F.col("text"))
    after = Window.partitionBy("conv_id").orderBy("turn")
    c = c.select("conv_id", "turn", text.alias("reference"))
    c = c.withColumns({"prediction": F.lead("reference").over(after), "_next": F.lead("turn").over(after)}).filter(F.col("_next") == F.col("turn") + 1)
    return c.drop("_next").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("id", "conv_id", tokenize(F.col("reference")).alias("r"), tokenize(F.col("prediction")).alias("h"))
    return wer.with_word_edits(rows, "r", "h").select("id", "conv_id", "edits", F.size("r").cast("long").alias("ref_len"))


def q_standard_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edits(spark, sf_dir)
    return e.select("id", "edits", "ref_len", wer.round_even(F.col("edits") / F.greatest("ref_len", F.lit(1)), 6).alias("wer"))


def q_corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edits(spark, sf_dir).agg(F.sum("edits").alias("edits"), F.sum("ref_len").alias("ref_words"), wer.round_even(100 * F.sum("edits") / F.sum("ref_len"), 2).alias("wer"))


def q_wer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd and even conversations as two models: rounded rates, their difference, and the relative gain if there is one."""
    e = _edits(spark, sf_dir)
    rate = lambda k: wer.round_even(100 * F.sum(F.when(F.col("conv_id") % 2 == k, F.col("edits"))) / F.sum(F.when(F.col("conv_id") % 2 == k, F.col("ref_len"))), 2)
    two = e.agg(rate(0).alias("base"), rate(1).alias("tuned")).withColumn("delta", wer.round_even(F.col("base") - F.col("tuned"), 2))
    return two.withColumn("relative", F.when(F.col("delta") > 0, wer.round_even(F.col("delta") / F.col("base") * 100, 1)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("id", "reference", "prediction", wer.scoring_words(F.col("reference")).alias("r"), wer.scoring_words(F.col("prediction")).alias("h"), errors.classify_error(F.col("reference"), F.col("prediction")).alias("error_type"))
    return wer.with_word_edits(rows, "r", "h").select("id", "reference", "prediction", "edits", F.size("r").cast("long").alias("ref_len"), wer.utterance_wer(F.col("edits"), F.col("r")).alias("wer"), "error_type")


def q_utterance_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "edits", "ref_len", wer.round_even("wer", 6).alias("wer"))


def q_classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "error_type")


def q_error_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("wer > 0").groupBy(errors.stratum(F.col("wer")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def q_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.systematic_sample(_scored(spark, sf_dir), "id").select("id", "stratum")


def q_taxonomy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.taxonomy(_scored(spark, sf_dir).filter("wer > 0"), "id")


def q_taxonomy_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.with_cause(errors.taxonomy(_scored(spark, sf_dir).filter("wer > 0"), "id")).select("error_type", "rank", "cause")


def q_taxonomy_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.examples(_scored(spark, sf_dir).filter("wer > 0"), "id").select("error_type", "rank", "id")


def q_error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled rows with class and reason."""
    return errors.error_samples(errors.systematic_sample(_scored(spark, sf_dir), "id"))


def q_error_samples_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written as one JSON array and read back."""
    path = files.shared_folder(spark, "samples")
    files.write_error_samples(q_error_samples(spark, sf_dir), path)
    return spark.read.schema("idx long, reference string, prediction string, wer double, error_type string, reasoning string").json(path, multiLine=True)


def q_error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, sf_dir)
    return r.select("id", errors.error_reason(F.col("error_type"), F.col("reference"), F.col("prediction")).alias("reasoning"))


def q_taxonomy_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.with_fix(errors.taxonomy(_scored(spark, sf_dir).filter("wer > 0"), "id")).select("error_type", "rank", "fix")


def q_model_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rates by model on texts as they are: odd and even conversations as two models."""
    rows = _pairs(spark, sf_dir).withColumn("model", F.when(F.col("conv_id") % 2 == 0, "base").otherwise("tuned"))
    return evaluation.corpus_rates(rows)


_PAIR = f"""txt AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN translate(lower(text), '{_LATIN}', '{_DEVANAGARI}') ELSE text END AS text FROM conversations),
pair AS MATERIALIZED (SELECT a.conv_id, a.conv_id * 1000 + a.turn AS id, a.text AS reference, b.text AS prediction FROM txt a JOIN txt b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _diagonal(now: str, before: str, cost: str) -> str:
    """The next diagonal of a distance table from the last two: cell i lies in row i, column k + 1 - i."""
    least = f"least({now}[i] + 1, {now}[i + 1] + 1, {before}[i] + CASE WHEN {cost} THEN 0 ELSE 1 END)"
    return f"list_transform(generate_series(0, k + 1), lambda i: CASE WHEN i = 0 OR i = k + 1 THEN k + 1 WHEN i > len(r) OR k + 1 - i > len(h) THEN 1000000 ELSE {least} END)"


def _dp(split: str) -> str:
    """Edit distances, a diagonal of the table a step."""
    return f"""{_PAIR}, tok AS MATERIALIZED (SELECT id, conv_id, {split.format('reference')} AS r, {split.format('prediction')} AS h FROM pair),
dp AS (
  SELECT id, 0 AS k, []::BIGINT[] AS b, [0::BIGINT] AS a FROM tok
  UNION ALL
  SELECT id, k + 1, a, {_diagonal('a', 'b', 'r[i] = h[k + 1 - i]')} FROM dp JOIN tok USING (id) WHERE k < len(r) + len(h)
), ed AS (SELECT tok.id, conv_id, a[len(r) + 1] AS edits, len(r) AS ref_len FROM tok JOIN dp ON tok.id = dp.id AND k = len(r) + len(h))"""


_TOK = f"list_filter(string_split({_NORM_SQL('{}')}, ' '), lambda w: w <> '')"
_SCORE = f"list_filter(string_split(regexp_replace(regexp_replace(lower({{}}), '\\p{{{{P}}}}', '', 'g'), '^{_WS.replace('{', '{{').replace('}', '}}')}+|{_WS.replace('{', '{{').replace('}', '}}')}+$', '', 'g'), ' '), lambda w: w <> '')"
_TOK = _TOK.replace("{", "{{").replace("}", "}}").replace("{{}}", "{}")
_STD, _UTT_DP = "WITH RECURSIVE " + _dp(_TOK), "WITH RECURSIVE " + _dp(_SCORE)
_CLASS = rf"""cls AS (
  SELECT id, len(r) AS n0, greatest(len(r), 1) AS n, greatest(len(p), 1) AS m, list_max(list_transform(list_distinct(p), lambda w: len(list_filter(p, lambda x: x = w)))) AS most, latin
  FROM (SELECT id, list_filter(regexp_split_to_array(reference, '{_WS}+'), lambda w: w <> '') AS r, list_filter(regexp_split_to_array(prediction, '{_WS}+'), lambda w: w <> '') AS p, regexp_matches(reference, '[A-Za-z]') OR regexp_matches(prediction, '[A-Za-z]') AS latin FROM pair)
), typ AS (
  SELECT id, n, m, CASE WHEN latin THEN 'CODE_MIX' WHEN n <= 2 THEN 'NOISE_DISFLUENCY' WHEN m / n < 0.5::DOUBLE THEN 'DELETION' WHEN m / n > 2.0::DOUBLE THEN 'INSERTION' WHEN m > 3 AND most > m * 0.4::DOUBLE THEN 'REPETITION' ELSE 'SUBSTITUTION_OOV' END AS error_type FROM cls
)"""
_WER = "utt_wer AS (SELECT *, CASE WHEN ref_len = 0 THEN 1.0::DOUBLE ELSE edits / ref_len END AS wer FROM ed)"
_STRAT = "st AS (SELECT *, CASE WHEN wer <= 0.3::DOUBLE THEN 'low' WHEN wer <= 0.7::DOUBLE THEN 'mid' ELSE 'high' END AS stratum FROM utt_wer WHERE wer > 0)"
_told = lambda k: "CASE error_type " + " ".join(f"WHEN '{c}' THEN '{v[k].replace(chr(39), chr(39) * 2)}'" for c, v in errors.TAXONOMY.items()) + " END"
_REASON = "CASE error_type " + " ".join(f"WHEN '{c}' THEN " + (f"printf('{v.format('%d', '%d', '%.2f')}', m, n, round_even(m / n, 2))" if "{}" in v else f"'{v}'") for c, v in errors.REASONS.items()) + " END"
STANDARD_SQL = _STD + " SELECT id, edits, ref_len, round_even(edits / greatest(ref_len, 1), 6) AS wer FROM ed"
CORPUS_SQL = _STD + " SELECT sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS ref_words, round_even(100 * sum(edits) / sum(ref_len), 2) AS wer FROM ed"
COMPARE_SQL = _STD + """, r AS (SELECT round_even(100 * sum(edits) FILTER (conv_id % 2 = 0) / sum(ref_len) FILTER (conv_id % 2 = 0), 2) AS base, round_even(100 * sum(edits) FILTER (conv_id % 2 = 1) / sum(ref_len) FILTER (conv_id % 2 = 1), 2) AS tuned FROM ed), d AS (SELECT *, round_even(base - tuned, 2) AS delta FROM r)
SELECT *, CASE WHEN delta > 0 THEN round_even(delta / base * 100, 1) END AS relative FROM d"""
UTT_WER_SQL = _UTT_DP + f", {_WER} SELECT id, edits, ref_len, round_even(wer, 6) AS wer FROM utt_wer"
CLASS_SQL = f"WITH {_PAIR}, {_CLASS} SELECT id, error_type FROM typ"
STRATA_SQL = _UTT_DP + f", {_WER}, {_STRAT} SELECT stratum, count(*) AS n FROM st GROUP BY 1"
SAMPLE_SQL = _UTT_DP + f""", {_WER}, {_STRAT}, k AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n, CASE stratum WHEN 'low' THEN 5 ELSE 10 END AS q FROM st)
SELECT id, stratum FROM k WHERE k % greatest(1, n // q) = 0 AND k // greatest(1, n // q) < q"""
TAXONOMY_SQL = _UTT_DP + f""", {_WER}, {_CLASS}, g AS (SELECT error_type, count(*) AS n, min(id) AS f FROM typ JOIN utt_wer USING (id) WHERE wer > 0 GROUP BY 1)
SELECT error_type, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank, round_even(100 * n / sum(n) OVER (), 0) AS pct, {_told(0)} AS description FROM g"""

_ERR = _UTT_DP + f", {_WER}, {_CLASS}"
CAUSES_SQL = _ERR + f""", g AS (SELECT error_type, count(*) AS n, min(id) AS f FROM typ JOIN utt_wer USING (id) WHERE wer > 0 GROUP BY 1)
SELECT error_type, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank, {_told(1)} AS cause FROM g"""
FIXES_SQL = _ERR + f""", g AS (SELECT error_type, count(*) AS n, min(id) AS f FROM typ JOIN utt_wer USING (id) WHERE wer > 0 GROUP BY 1), k AS (SELECT error_type, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank FROM g)
SELECT error_type, rank, CASE WHEN rank <= {errors.FIXES_SHOWN} THEN {_told(2)} END AS fix FROM k"""
REASONS_SQL = f"WITH {_PAIR}, {_CLASS} SELECT id, {_REASON} AS reasoning FROM typ"
SAMPLES_SQL = _UTT_DP + f""", {_WER}, {_CLASS}, {_STRAT}, k AS (SELECT id, wer, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n0, CASE stratum WHEN 'low' THEN 5 ELSE 10 END AS q FROM st)
SELECT id AS idx, reference, prediction, round_even(wer, 4) AS wer, error_type, {_REASON} AS reasoning FROM k JOIN typ USING (id) JOIN pair USING (id) WHERE k % greatest(1, n0 // q) = 0 AND k // greatest(1, n0 // q) < q"""
_RAW_TOK = rf"list_filter(regexp_split_to_array({{}}, '{_WS.replace('{', '{{').replace('}', '}}')}+'), lambda w: w <> '')"
RATES_SQL = "WITH RECURSIVE " + _dp(_RAW_TOK) + " SELECT CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model, round_even(100 * sum(edits) / sum(ref_len), 2) AS wer, count(*) AS num_samples FROM ed GROUP BY 1"
EXAMPLES_SQL = _ERR + ", k AS (SELECT error_type, id, row_number() OVER (PARTITION BY error_type ORDER BY id) AS rank FROM typ JOIN utt_wer USING (id) WHERE wer > 0) SELECT error_type, CAST(rank AS INTEGER) AS rank, id FROM k WHERE rank <= 5"

# --- numbers and code mix ---------------------------------------------------------------------------------------------


def _picked(values: list, at):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at % len(values) + 1).cast("int"))


def _number(spark_index, k: int = 0):
    return _picked([x[k] for x in _NUMBERS], spark_index)


def q_word_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number word, a multiplier and a number word; of all words but zero, marks at their ends or not."""
    p = _table(spark, sf_dir, "part")
    tokens = F.array(_picked([w for w, _ in _ALL_NUMBERS], F.col("p_size")), _picked(list(MULTIPLIER_VALUES), F.col("p_partkey")), _picked([w for w, _ in _ALL_NUMBERS], F.col("p_partkey")))
    return p.select("p_partkey", words_to_number(tokens).cast("long").alias("number"))


def q_number_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All multipliers inside a sentence, behind any number word."""
    p = _table(spark, sf_dir, "part")
    text = F.concat_ws(" ", F.lit("उन्हें"), _picked([w for w, _ in _ALL_NUMBERS], F.col("p_size")), _picked(list(MULTIPLIER_VALUES), F.col("p_partkey")), _number(F.col("p_partkey")), F.lit("रुपये"))
    out = p.select("p_partkey", normalize_numbers(text).alias("n"))
    return out.select("p_partkey", F.col("n.text").alias("text"), F.col("n.changes")[0].reason.alias("reason"))


def q_number_mark_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words that end in a mark stay before a blank, but for a shorter one inside them; with marks as word characters they become digits."""
    p = _table(spark, sf_dir, "part")
    text = F.concat_ws(" ", F.lit("वह"), _picked([w for w, _ in _MARK_FINAL], F.col("p_partkey")), F.lit("किलो"))
    return p.select("p_partkey", normalize_numbers(text).text.alias("text"), normalize_numbers(text, True).text.alias("mended"))


def q_normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.lit("वहाँ "), _number(F.col("p_size")), F.lit(" सौ  "), _number(F.col("p_partkey")), F.lit(" लोग थे"))
    out = p.select("p_partkey", normalize_numbers(text).alias("n"))
    return out.select("p_partkey", F.col("n.text").alias("text"), F.size("n.changes").cast("long").alias("n_changes"))


def q_number_idiom_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 2 == 0, "दस-बीस लोग").otherwise(F.concat(_number(F.col("p_partkey")), F.lit(" लोग")))
    out = p.select("p_partkey", normalize_numbers(text).alias("n"))
    return out.select("p_partkey", F.col("n.text").alias("text"), F.size(F.filter("n.changes", lambda c: c.skipped)).cast("long").alias("n_skipped"))


def q_english_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", codemix.tag_english_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.col("t.tagged").alias("tagged"), F.size("t.english_words").cast("long").alias("n_english"))


def q_english_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _spread(spark, sf_dir, "documents", "text").select(F.explode(words(F.col("text"))).alias("token")).distinct()
    return t.select("token", codemix.is_english_word(F.col("token")).alias("english"))


def q_english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _spread(spark, sf_dir, "documents", "text").select(F.explode(codemix.tag_english_words(F.col("text")).english_words).alias("word"))
    return t.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_cleanup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("मुझे "), _number(F.col("p_partkey")), F.lit(" salary, "), F.col("p_name")).alias("text"))
    return cleaned(p).select("p_partkey", "final", F.size("english_words").cast("long").alias("n_english"))


def q_cleanup_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaned(_spread(spark, sf_dir, "documents", "doc_id", "text"))
    changed = (F.col("after_numbers") != F.col("text")) | (F.size("english_words") > 0)
    return c.agg(F.count_if(changed).alias("changed"), F.count(F.lit(1)).alias("total"))


def q_cleanup_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five texts that the cleanup changes."""
    c = cleaned(_spread(spark, sf_dir, "documents", "doc_id", "text"))
    changed = (F.col("after_numbers") != F.col("text")) | (F.size("english_words") > 0)
    return c.filter(changed).orderBy("doc_id").limit(5).select("doc_id", "final")


def q_cleanup_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleanup changes in each text, as an example report shows it."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("दस-बीस लोग "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("मुझे "), _number(F.col("p_partkey")), F.lit(" लोग मिले"))).otherwise("तुम कहाँ हो").alias("text"))
    n = example_notes(cleaned(p))
    return n.select("p_partkey", "before", "numbers", "after", F.array_join("number_notes", "; ").alias("number_notes"), "english_note")


def q_surely_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _spread(spark, sf_dir, "documents", "text").select(F.explode(words(F.col("text"))).alias("token"))
    return t.filter(codemix.surely_english(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_LIST = lambda k: "[" + ", ".join(f"'{x[k]}'" if k == 0 else str(x[k]) for x in _NUMBERS) + "]"
_AT = lambda c, k: f"{_LIST(k)}[{c} % {len(_NUMBERS)} + 1]"
_OF = lambda values, c: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + f"][{c} % {len(values)} + 1]"
_ANY = lambda c, k: _OF([x[k] for x in _ALL_NUMBERS], c)
_TIMES = _OF(list(MULTIPLIER_VALUES.values()), "p_partkey")
NUMBER_SQL = f"SELECT p_partkey, CAST({_ANY('p_size', 1)} AS BIGINT) * {_TIMES} + {_ANY('p_partkey', 1)} AS number FROM part"
MULTIPLIERS_SQL = f"""WITH n AS (SELECT p_partkey, (CAST({_ANY('p_size', 1)} AS BIGINT) * {_TIMES} + {_AT('p_partkey', 1)})::VARCHAR AS x, {_ANY('p_size', 0)} || ' ' || {_OF(list(MULTIPLIER_VALUES), 'p_partkey')} || ' ' || {_AT('p_partkey', 0)} AS w FROM part)
SELECT p_partkey, 'उन्हें ' || x || ' रुपये' AS text, 'Standard number conversion: ' || w || ' → ' || x AS reason FROM n"""
_WORDS_RE = re.compile(r"\b(?:" + "|".join(sorted(UNIT_VALUES | MULTIPLIER_VALUES, key=len, reverse=True)) + r")\b")  # Python's own boundaries: a shorter number word may end before a mark
_MARKED = [_WORDS_RE.sub(lambda m: str((UNIT_VALUES | MULTIPLIER_VALUES)[m[0]]), f"{w} ") for w, _ in _MARK_FINAL]
MARKS_SQL = f"SELECT p_partkey, 'वह ' || {_OF(_MARKED, 'p_partkey')} || 'किलो' AS text, 'वह ' || {_OF([v for _, v in _MARK_FINAL], 'p_partkey')} || ' किलो' AS mended FROM part"
NUMBERS_SQL = f"SELECT p_partkey, 'वहाँ ' || ({_AT('p_size', 1)} * 100 + {_AT('p_partkey', 1)}) || ' लोग थे' AS text, 1::BIGINT AS n_changes FROM part"
IDIOM_SQL = f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'दस-बीस लोग' ELSE {_AT('p_partkey', 1)} || ' लोग' END AS text, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_skipped FROM part"
_EDGE1, _EDGE2, _EDGE3 = (x.replace("'", "''") for x in (codemix.CLASSIFIER_EDGE, codemix.TAGGER_EDGE, codemix.LISTED_EDGE))
_BARE = lambda c, e: f"regexp_replace({c}, '^{e}+|{e}+$', '', 'g')"
_ENGLISH = f"(regexp_matches({_BARE('t', _EDGE1)}, '^[A-Za-z][A-Za-z0-9''-]*$') AND lower({_BARE('t', _EDGE1)}) NOT IN ({', '.join(repr(w) for w in codemix.FALSE_POSITIVES)}))"
_TOKENS = f"""tk AS (SELECT {{key}}, unnest(regexp_extract_all({{text}}, '{_WS.replace('{', '{{').replace('}', '}}')}+|[^{_WS[1:].replace('{', '{{').replace('}', '}}')}+')) AS t, generate_subscripts(regexp_extract_all({{text}}, '{_WS.replace('{', '{{').replace('}', '}}')}+|[^{_WS[1:].replace('{', '{{').replace('}', '}}')}+'), 1) AS i FROM {{source}})"""
_TAGGED = f"CASE WHEN {_ENGLISH} THEN regexp_replace(t, '^({_EDGE2}*)(.*?)({_EDGE2}*)$', '\\1[EN]\\2[/EN]\\3') ELSE t END"
TAG_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT doc_id, string_agg({_TAGGED}, '' ORDER BY i) AS tagged, count(*) FILTER ({_ENGLISH}) AS n_english FROM tk GROUP BY 1 UNION ALL SELECT doc_id, '', 0 FROM documents WHERE text = ''"
WORDS_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT {_BARE('t', _EDGE3)} AS word, count(*) AS n FROM tk WHERE {_ENGLISH} GROUP BY 1"
TOKEN_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT DISTINCT t AS token, {_ENGLISH} AS english FROM tk WHERE NOT regexp_matches(t, '^{_WS}')"
SHOWN_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT doc_id, string_agg({_TAGGED}, '' ORDER BY i) AS final FROM tk GROUP BY 1 HAVING bool_or({_ENGLISH}) ORDER BY doc_id LIMIT 5"
_SALARY = f"(SELECT p_partkey, 'मुझे ' || {_AT('p_partkey', 1)} || ' salary, ' || p_name AS text FROM part)"
CLEANUP_SQL = f"WITH {_TOKENS.format(key='p_partkey', text='text', source=_SALARY)} SELECT p_partkey, string_agg({_TAGGED}, '' ORDER BY i) AS final, count(*) FILTER ({_ENGLISH}) AS n_english FROM tk GROUP BY 1"
CHANGED_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT count(DISTINCT doc_id) FILTER ({_ENGLISH}) AS changed, (SELECT count(*) FROM documents) AS total FROM tk"

_NAMED = "list_filter(regexp_split_to_array(p_name, ' +'), lambda w: w <> '')"
NOTES_SQL = f"""WITH t AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'दस-बीस लोग ' || p_name WHEN 1 THEN 'मुझे ' || {_AT('p_partkey', 0)} || ' लोग मिले' ELSE 'तुम कहाँ हो' END AS before FROM part)
SELECT p_partkey, before, CASE WHEN p_partkey % 3 = 1 THEN 'मुझे ' || {_AT('p_partkey', 1)} || ' लोग मिले' END AS numbers,
  CASE p_partkey % 3 WHEN 0 THEN 'दस-बीस लोग ' || array_to_string(list_transform({_NAMED}, lambda w: '[EN]' || w || '[/EN]'), ' ') WHEN 1 THEN 'मुझे ' || {_AT('p_partkey', 1)} || ' लोग मिले' ELSE before END AS after,
  CASE p_partkey % 3 WHEN 0 THEN 'दस: idiom, kept; बीस: idiom, kept' WHEN 1 THEN {_AT('p_partkey', 0)} || ' → ' || {_AT('p_partkey', 1)} ELSE '' END AS number_notes, CASE WHEN p_partkey % 3 = 0 THEN array_to_string({_NAMED}, ', ') END AS english_note FROM t"""
SURELY_SQL = f"WITH {_TOKENS.format(key='doc_id', text='text', source='documents')} SELECT t AS token, count(*) AS n FROM tk WHERE lower({_BARE('t', _EDGE1)}) IN ({', '.join(repr(w) for w in codemix.DEFINITE_ENGLISH)}) GROUP BY 1"

# --- spelling ---------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all documents, their letters a to z in Devanagari, and as they are. A word is a run of letters of any script."""
    d = _spread(spark, sf_dir, "documents", "text")
    w = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("latin")).distinct()
    return w.select("latin", F.translate("latin", _LATIN, _DEVANAGARI).alias("word"))


def q_phonotactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    both = w.select("latin", "word").union(w.select("latin", F.col("latin").alias("word")))
    return both.groupBy(spelling.phonotactic_reason(F.col("word")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents in Devanagari letters, and the words of the list themselves."""
    listed = spark.createDataFrame([(w,) for w in spelling.DICTIONARY], "word string")
    c = _words(spark, sf_dir).select("word").union(listed).withColumn("c", spelling.dictionary_check(F.col("word")))
    return c.groupBy(F.col("c.found").alias("found"), F.col("c.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_loanword_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).filter(F.col("word").rlike(spelling.LOANWORDS)).select("word")


def q_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.TrigramModel(_words(spark, sf_dir)).counts


def q_ngram_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.TrigramModel(_words(spark, sf_dir)).contexts


def q_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    return spelling.TrigramModel(w).score(w, "latin").select("latin", wer.round_even("lm_score", 6).alias("lm_score"))


def q_spelling_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.classify(_words(spark, sf_dir), "latin").select("latin", "label", "confidence")


def q_spelling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.stats(spelling.classify(_words(spark, sf_dir), "latin"))


def q_low_conf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.low_confidence_sample(spelling.classify(_words(spark, sf_dir), "latin")).select("latin", "word")


def q_low_conf_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.review(spelling.low_confidence_sample(spelling.classify(_words(spark, sf_dir), "latin")))


def q_low_conf_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of low confidence that Python's seeded generator draws from their list in order."""
    return spelling.seeded_sample(spelling.classify(_words(spark, sf_dir), "latin"), "latin").select("place", "latin")


def q_spelling_signals_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.classify(_words(spark, sf_dir), "latin").select("latin", spelling.signals_json().alias("signals"))


def q_spelling_first_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty words of low confidence, with the score that their signals tell."""
    rows = spelling.first_low(spelling.classify(_words(spark, sf_dir), "latin"), "latin")
    return rows.select("latin", spelling.signal_score(spelling.signals_json()).alias("lm_score"))


_W = f"w AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS latin FROM documents), v AS MATERIALIZED (SELECT latin, translate(latin, '{_LATIN}', '{_DEVANAGARI}') AS word FROM w)"
_PHON = "CASE WHEN word = '' THEN 'empty' WHEN NOT regexp_matches(word, '^[\\x{0900}-\\x{0963}\\x{0966}-\\x{096F}\\x{0970}-\\x{097F}]+$') THEN 'contains invalid characters' " + " ".join(f"WHEN contains(word, '{chr(int(c, 16)) * 2}') THEN 'invalid character combination: [\\u{c}][\\u{c}]'" for c in spelling.DOUBLED) + f" WHEN length(word) - length(replace(word, '{spelling.VIRAMA}', '')) > 3 AND length(word) < 8 THEN 'too many virama in short word' WHEN length(word) = 1 THEN 'single character (likely filler)' ELSE 'phonotactically valid' END"
PHON_SQL = f"WITH {_W}, b AS (SELECT word FROM v UNION ALL SELECT latin FROM v) SELECT {_PHON} AS reason, count(*) AS n FROM b GROUP BY 1"
LOAN_SQL = f"WITH {_W} SELECT word FROM v WHERE regexp_matches(word, '{spelling.LOANWORDS}')"


def _lm(corpus: str) -> str:
    return f"""{_W}, corpus AS MATERIALIZED ({corpus}), tri AS MATERIALIZED (SELECT array_to_string(p[i:i + 2], '') AS tri, count(*) AS c FROM (SELECT p, unnest(generate_series(1, len(p) - 2)) AS i FROM (SELECT regexp_extract_all('^^' || word || '$', '(?s).') AS p FROM corpus)) GROUP BY 1),
ctx AS MATERIALIZED (SELECT array_to_string(regexp_extract_all(tri, '(?s).')[1:2], '') AS ctx, sum(c)::BIGINT AS x FROM tri GROUP BY 1), size AS MATERIALIZED (SELECT count(DISTINCT ch) AS v FROM (SELECT unnest(regexp_extract_all('^' || word || '$', '(?s).')) AS ch FROM corpus)),
sc AS MATERIALIZED (SELECT latin, avg(ln((c + 1) / (x + v)::DOUBLE)) AS lm_score FROM (SELECT latin, array_to_string(p[i:i + 2], '') AS tri, array_to_string(p[i:i + 1], '') AS ctx FROM (SELECT latin, p, unnest(generate_series(1, len(p) - 2)) AS i FROM (SELECT latin, regexp_extract_all('^^' || word || '$', '(?s).') AS p FROM v))) JOIN tri USING (tri) JOIN ctx USING (ctx) CROSS JOIN size GROUP BY 1)"""


_OWN = _lm("SELECT word FROM v")
_ALL = _lm("SELECT word FROM v UNION ALL SELECT unnest([" + ", ".join(f"'{w}'" for w in spelling.DICTIONARY) + "])")
COUNTS_SQL, CONTEXT_SQL, SCORE_SQL = f"WITH {_OWN} SELECT tri, c FROM tri", f"WITH {_OWN} SELECT ctx, x FROM ctx", f"WITH {_OWN} SELECT latin, round_even(lm_score, 6) AS lm_score FROM sc"
_CLS = f"""{_ALL}, ph AS MATERIALIZED (SELECT latin, word, {_PHON} AS reason, CASE WHEN regexp_matches(word, '{spelling.LOANWORDS}') THEN 'loanword' WHEN {_PHON} NOT IN ('phonotactically valid', 'single character (likely filler)') THEN 'phonotactic' WHEN word IN ({', '.join(f"'{w}'" for w in spelling.DICTIONARY)}) THEN 'dictionary' ELSE 'model' END AS exit FROM v),
cl AS MATERIALIZED (SELECT latin, CASE WHEN exit = 'phonotactic' OR exit = 'model' AND lm_score < -3.5::DOUBLE THEN 'incorrect_spelling' ELSE 'correct_spelling' END AS label, CASE WHEN exit <> 'model' OR lm_score >= -1.8::DOUBLE THEN 'high' WHEN lm_score >= -3.5::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM ph JOIN sc USING (latin))"""
CLASSIFY_SQL = f"WITH {_CLS} SELECT latin, label, confidence FROM cl"
STATS_SQL = f"""WITH {_CLS} SELECT count(*) AS total, count(*) FILTER (label = 'correct_spelling') AS correct, count(*) FILTER (label <> 'correct_spelling') AS wrong, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, """ + ", ".join(f"CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER ({c}) / count(*) * 100, 1) END AS {k}_pct" for k, c in {"correct": "label = 'correct_spelling'", "wrong": "label <> 'correct_spelling'"}.items() | {k: f"confidence = '{k}'" for k in ("high", "medium", "low")}.items()) + " FROM cl"
SIGNALS_SQL = f"""WITH {_CLS} SELECT latin, CASE exit WHEN 'loanword' THEN '{{"devanagari_english": true}}' ELSE '{{"phonotactic": {{"ok": ' || (exit <> 'phonotactic')::VARCHAR || ', "reason": "' || replace(reason, '\\', '\\\\') || '"}}' || CASE exit WHEN 'dictionary' THEN ', "dictionary": {{"found": true, "reason": "found in dictionary"}}'
  WHEN 'model' THEN ', "dictionary": {{"found": null, "reason": "not in dictionary"}}, "lm_score": ' || round_even(lm_score, 4)::VARCHAR ELSE '' END || '}}' END AS signals FROM ph JOIN sc USING (latin)"""
FIRST_LOW_SQL = f"WITH {_CLS} SELECT latin, round_even(lm_score, 4)::VARCHAR AS lm_score FROM cl JOIN sc USING (latin) WHERE confidence = 'low' ORDER BY latin LIMIT 20"

_IN_LIST = ", ".join(f"'{w}'" for w in spelling.DICTIONARY)
LOOKUP_SQL = f"WITH {_W}, a AS (SELECT word FROM v UNION ALL SELECT unnest([{_IN_LIST}])) SELECT CASE WHEN word IN ({_IN_LIST}) THEN true END AS found, CASE WHEN word IN ({_IN_LIST}) THEN 'found in dictionary' ELSE 'not in dictionary' END AS reason, count(*) AS n FROM a GROUP BY 1, 2"
_LOW = f"WITH {_CLS}, low AS (SELECT latin, word, label FROM cl JOIN v USING (latin) WHERE confidence = 'low' ORDER BY md5('42|' || word), word LIMIT 45)"
LOW_SQL = _LOW + " SELECT latin, word FROM low"
_VALID = f"(word IN ({', '.join(repr(w) for w in spelling.KNOWN_VALID)}) OR length(word) > 3)"
REVIEW_SQL = _LOW + f""", r AS (SELECT *, (label = 'correct_spelling') = {_VALID} AS ok, {_VALID} AS valid FROM low)
SELECT count(*) AS n, count(*) FILTER (ok) AS "right", count(*) FILTER (NOT ok) AS wrong, count(*) FILTER (ok AND NOT valid) AS misspelled, CASE WHEN count(*) > 0 THEN round_even(100 * count(*) FILTER (ok) / count(*), 0) END AS accuracy FROM r"""

# --- lattices and label batches ---------------------------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is the reference; five models each replace, drop or double words by a rule of position."""
    c = _spread(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("segment"), F.col("conv_id"), F.col("text"), tokenize(F.col("text")).alias("reference"))

    def model(m: int):
        def word(w, i):
            k = (F.col("conv_id") * 7 + i * 13 + m * 5) % 17
            shared = (F.col("conv_id") + i * 3) % 11 == 0  # four models agree against the reference
            return F.when(shared & F.lit(m < 4), F.array(F.concat(w, F.lit("y")))).when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(w, w)).when(k < 4, F.array(F.concat(w, F.lit("x")))).otherwise(F.array(w))

        words = F.flatten(F.transform("reference", word))
        return F.struct(F.lit(f"m{m}").alias("model"), words.alias("words"), F.array_join(words, " ").alias("text"))

    return c.withColumn("models", F.array(*[model(m) for m in range(5)]))


def q_align_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.matches(_segments(spark, sf_dir))


def q_lattice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = lattice.lattices(_segments(spark, sf_dir)).select("segment", F.posexplode("bins").alias("position", "bin"))
    return bins.select("segment", "position", F.array_join("bin", "|").alias("bin"))


def q_trusted_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattices(_segments(spark, sf_dir)).select("segment", F.explode("overrides").alias("override"))


def q_lattice_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(_segments(spark, sf_dir)).select("segment", "model", "standard_edits", "lattice_edits", "ref_len", "hyp_len")


def q_lattice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: a row for each segment and model."""
    return lattice.report(_segments(spark, sf_dir))


def q_lattice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each model over all segments."""
    r = lattice.scored(_segments(spark, sf_dir))
    pct = lambda c: wer.round_even(100 * F.sum(c) / F.sum("ref_len"), 2)
    return r.groupBy("model").agg(pct("standard_edits").alias("standard_wer_pct"), pct("lattice_edits").alias("lattice_wer_pct"), F.count(F.lit(1)).alias("n_segments"))


def _lattice_sql() -> str:
    """The longest matching block of an interval, then left and right of it; bins of what stands at each position."""
    tokens = _TOK.format("text")
    k = lambda m: f"((conv_id * 7 + (i - 1) * 13 + {m} * 5) % 17)"
    made = lambda m: f"list_transform(r, lambda w, i: CASE WHEN {m} < 4 AND (conv_id + (i - 1) * 3) % 11 = 0 THEN [w || 'y'] WHEN {k(m)} = 0 THEN []::VARCHAR[] WHEN {k(m)} = 1 THEN [w, w] WHEN {k(m)} < 4 THEN [w || 'x'] ELSE [w] END)"
    models = " UNION ALL ".join(f"SELECT segment, 'm{m}' AS model, r, flatten({made(m)}) AS h FROM ref" for m in range(5))
    return f"""WITH RECURSIVE ref AS MATERIALIZED (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS segment, conv_id, text, {tokens} AS r FROM conversations),
hyp AS MATERIALIZED ({models}),
rw AS (SELECT segment, model, unnest(r) AS w, generate_subscripts(r, 1) - 1 AS i FROM hyp),
hw AS (SELECT segment, model, unnest(h) AS w, generate_subscripts(h, 1) - 1 AS j FROM hyp),
eq0 AS (SELECT segment, model, i, j, i - row_number() OVER (PARTITION BY segment, model, i - j ORDER BY i) AS island FROM rw JOIN hw USING (segment, model, w)),
eq AS (SELECT segment, model, i, j, max(i) OVER (PARTITION BY segment, model, i - j, island) - i + 1 AS run FROM eq0),
iv AS (
  SELECT segment, model, 0::BIGINT AS alo, len(r)::BIGINT AS ahi, 0::BIGINT AS blo, len(h)::BIGINT AS bhi FROM hyp
  UNION ALL
  SELECT segment, model, CASE side WHEN 0 THEN alo ELSE b.i - b.nk END, CASE side WHEN 0 THEN b.i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE b.j - b.nk END, CASE side WHEN 0 THEN b.j ELSE bhi END
  FROM (
    SELECT iv.segment, iv.model, alo, ahi, blo, bhi, min({{'nk': -least(run, ahi - i, bhi - j), 'i': i, 'j': j}}) AS b
    FROM iv JOIN eq ON iv.segment = eq.segment AND iv.model = eq.model AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL
  ), (VALUES (0), (1)) sides(side)
),
blocks AS (
  SELECT iv.segment, iv.model, alo, ahi, blo, bhi, min({{'nk': -least(run, ahi - i, bhi - j), 'i': i, 'j': j}}) AS b
  FROM iv JOIN eq ON iv.segment = eq.segment AND iv.model = eq.model AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL
),
same AS (SELECT segment, model, b.i + k AS i, b.j + k AS j FROM (SELECT segment, model, b, unnest(generate_series(0, -b.nk - 1)) AS k FROM blocks)),
pos AS (
  SELECT rw.segment, rw.model, rw.i, rw.w, same.j, coalesce(last_value(same.i IGNORE NULLS) OVER p, -1) AS before_i, coalesce(last_value(same.j IGNORE NULLS) OVER p, -1) AS before_j,
    first_value(same.j IGNORE NULLS) OVER (PARTITION BY rw.segment, rw.model ORDER BY rw.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_j
  FROM rw LEFT JOIN same ON rw.segment = same.segment AND rw.model = same.model AND rw.i = same.i
  WINDOW p AS (PARTITION BY rw.segment, rw.model ORDER BY rw.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
alt AS (
  SELECT pos.segment, pos.model, i, pos.w, CASE WHEN j IS NOT NULL THEN pos.w WHEN before_j + 1 >= coalesce(after_j, len(h)) THEN '<DEL>' WHEN before_j + i - before_i < coalesce(after_j, len(h)) THEN h[before_j + i - before_i + 1] END AS a
  FROM pos JOIN hyp USING (segment, model)
),
bins AS (SELECT segment, i AS position, list_sort(list_distinct(list_concat([w], coalesce(list(a) FILTER (a IS NOT NULL AND a <> '<DEL>'), []::VARCHAR[])))) AS bin FROM alt GROUP BY segment, i, w),
over_ AS (SELECT segment, a || ' (' || count(*) || '/5 models agree)' AS override FROM alt WHERE a <> w GROUP BY segment, i, a HAVING count(*) >= 3)"""


_LATTICE = _lattice_sql()
_LATTICE_DP = _LATTICE + """,
held AS MATERIALIZED (SELECT segment, list(bin ORDER BY position) AS bins FROM bins GROUP BY segment),
tok AS MATERIALIZED (SELECT hyp.segment, model, r, h, coalesce(bins, []) AS bins FROM hyp LEFT JOIN held USING (segment)),
dp AS (
  SELECT segment, model, 0 AS k, []::BIGINT[] AS sb, [0::BIGINT] AS sa, []::BIGINT[] AS lb, [0::BIGINT] AS la FROM tok
  UNION ALL
  SELECT segment, model, k + 1, sa, """ + _diagonal("sa", "sb", "r[i] = h[k + 1 - i]") + ", la, " + _diagonal("la", "lb", "list_contains(bins[i], h[k + 1 - i])") + """ FROM dp JOIN tok USING (segment, model) WHERE k < len(r) + len(h)
),
ed AS (
  SELECT segment, model, text, array_to_string(h, ' ') AS prediction, sa[len(tok.r) + 1] AS standard_edits, la[len(tok.r) + 1] AS lattice_edits, len(tok.r) AS ref_len, len(h) AS hyp_len
  FROM tok JOIN dp USING (segment, model) JOIN ref USING (segment) WHERE k = len(tok.r) + len(h)
)"""
LATTICE_SQL = _LATTICE_DP + " SELECT segment, model, CAST(standard_edits AS INTEGER) AS standard_edits, CAST(lattice_edits AS INTEGER) AS lattice_edits, CAST(ref_len AS INTEGER) AS ref_len, CAST(hyp_len AS INTEGER) AS hyp_len FROM ed"
_PCT = lambda c: f"round_even(100 * ({c}) / greatest(ref_len, 1), 2)"
ROWS_SQL = _LATTICE_DP + f" SELECT segment, text AS reference, model, prediction, {_PCT('standard_edits')} AS standard_wer_pct, {_PCT('lattice_edits')} AS lattice_wer_pct, {_PCT('standard_edits - lattice_edits')} AS wer_reduction_pct FROM ed"
REPORT_SQL = _LATTICE_DP + " SELECT model, round_even(100 * sum(standard_edits) / sum(ref_len), 2) AS standard_wer_pct, round_even(100 * sum(lattice_edits) / sum(ref_len), 2) AS lattice_wer_pct, count(*) AS n_segments FROM ed GROUP BY 1"
MATCHES_SQL = _LATTICE + " SELECT segment, model, i, j FROM same"
BINS_SQL = _LATTICE + " SELECT segment, position, array_to_string(bin, '|') AS bin FROM bins"
OVERRIDES_SQL = _LATTICE + " SELECT segment, override FROM over_"


def q_label_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("labels"))
    p = labels.padded(c.withColumn("labels", F.concat(F.array(F.when(F.col("conv_id") % 2 == 0, 1).otherwise(2)), "labels")), "conv_id", "labels", 1)
    return p.select("conv_id", "turn", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.array_join(F.transform(labels.unmasked(F.col("labels"), 0), lambda x: x.cast("string")), ",").alias("decoded"))


PAD_SQL = rf"""WITH t AS (SELECT conv_id, turn, list_concat([CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END], list_transform(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> ''), lambda w: length(w))) AS l FROM conversations),
p AS (SELECT conv_id, turn, list_concat(l, list_transform(generate_series(1, max(len(l)) OVER (PARTITION BY conv_id) - len(l)), lambda i: -100)) AS l FROM t), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN l[2:] ELSE l END AS l FROM p)
SELECT conv_id, turn, array_to_string(l, ',') AS labels, array_to_string(list_transform(l, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ',') AS decoded FROM b"""

def q_compute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's word lengths as label ids, padded with the mask, against the next turn's: ids become words again and are scored."""
    p = _pairs(spark, sf_dir).select("conv_id", "id", F.transform(words(F.col("prediction")), lambda w: F.length(w)).alias("said"), F.transform(words(F.col("reference")), lambda w: F.length(w)).alias("labels"))
    decode = lambda ids: F.array_join(F.transform(F.filter(ids, lambda x: x != 0), lambda x: x.cast("string")), " ")
    return labels.compute_metrics(labels.padded(p, "conv_id", "labels", -1), "said", "labels", decode, 0)


_LENGTHS = f"list_transform({_RAW_TOK}, lambda w: length(w))"
METRICS_SQL = "WITH RECURSIVE " + _dp(_LENGTHS) + " SELECT sum(edits)::BIGINT AS edits, sum(ref_len)::BIGINT AS ref_words, round_even(100 * sum(edits) / sum(ref_len), 2) AS wer FROM ed"

# --- files ------------------------------------------------------------------------------------------------------------


def q_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as JSON lines, read back and counted by value."""
    path = files.shared_folder(spark, "files")
    files.write_json(_table(spark, sf_dir, "conversations").select(F.col("text").alias("prediction"), F.col("role").alias("reference")), path)
    return files.read_predictions(spark, path).groupBy("prediction", "reference").agg(F.count(F.lit(1)).alias("n"))


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line ends written as CSV and read back as strings."""
    path = files.shared_folder(spark, "files")
    files.write_csv(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return files.read_strings(spark, path)


def q_words_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word a line, written with blanks around it and empty lines, read back."""
    path = files.shared_folder(spark, "files")
    w = _table(spark, sf_dir, "nation")
    w.select(F.concat(F.lit("  "), "n_name", F.lit("\t")).alias("value")).union(w.select(F.lit("  ").alias("value"))).write.text(path)
    return files.read_words(spark, path)


def q_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of recordings as CSV, read back with its types and filtered by language."""
    path = files.shared_folder(spark, "files")
    c = _table(spark, sf_dir, "customer")
    url = lambda x: F.concat(F.lit(f"https://host/{x}/"), F.col("c_custkey").cast("string"))
    rows = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 10).alias("recording_id"), F.when(F.col("c_nationkey") % 2 == 0, "hi").otherwise("ta").alias("language"), F.col("c_acctbal").alias("duration"), url("a").alias("rec_url_gcp"), url("t").alias("transcription_url_gcp"), url("m").alias("metadata_url"))
    files.write_csv(rows, path)
    return ingest.hindi_only(files.read_index(spark, path))


#: Characters of the turns that one transcript file holds, about.
FILE_CHARS = 1 << 20


def q_transcripts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of one JSON array each, some hundred whole conversations a file, and as many broken files: utterances of the whole files only."""
    path = files.shared_folder(spark, "files")
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chars = c.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    u = F.to_json(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))))
    one = c.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(chars // FILE_CHARS + 1)).alias("file")).agg(u.alias("value"))
    files.write_arrays(one.select(F.explode(F.array("value", F.expr("left(value, length(value) - 1)"))).alias("value")), path)
    return files.read_transcripts(spark, path).select("start", "text")


def q_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split table written by part and counted after reading."""
    path = files.shared_folder(spark, "files")
    files.write_split(ingest.split(_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def q_wide_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of two models, with missing cells, as CSV; read back as segments, and how many words each model has."""
    path = files.shared_folder(spark, "files")
    c = _table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("https://host/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    wide = c.select(key.alias("url"), F.when(F.col("turn") == 3, "nan").otherwise(F.col("text")).alias("Human"), F.when(F.col("conv_id") % 2 == 0, F.col("text")).alias("m 1"), F.when(F.col("turn") == 1, "nan").otherwise(F.col("role")).alias("m 2"))
    files.write_csv(wide, path)
    s = files.wide_segments(files.read_strings(spark, path), "url", "Human", ["m 1", "m 2"])
    return s.select("segment", F.inline("models"), F.size("reference").alias("n_reference")).groupBy("segment", "model").agg(F.sum(F.size("words")).alias("n_words"), F.sum("n_reference").alias("n_reference"))


def q_lattice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattices as JSON of a reference and a map of outputs, read back as segments and scored."""
    path = files.shared_folder(spark, "files")
    c = _table(spark, sf_dir, "conversations").filter("text <> ''")
    rows = c.select(F.col("text").alias("reference"), F.create_map(F.lit("same"), F.col("text"), F.lit("role"), F.col("role")).alias("model_outputs"))
    rows.write.json(path)
    r = lattice.scored(files.lattice_segments(spark.read.schema("reference string, model_outputs map<string,string>").json(path)))
    return r.groupBy("model").agg(F.sum("hyp_len").alias("words"), F.sum("lattice_edits").alias("edits"))


def q_predictions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role as models: one file of JSON lines each, read back under the names of the files."""
    path = files.shared_folder(spark, "files")
    model = F.concat("role", F.lit(" a/b"))
    outputs.write_predictions(_table(spark, sf_dir, "conversations").select(model.alias("model"), F.col("text").alias("prediction"), F.col("conv_id").cast("string").alias("reference")), path)
    read = spark.read.schema("prediction string, reference string").json(f"{path}/predictions_*.jsonl")
    name = F.regexp_extract(F.col("_metadata.file_name"), "^predictions_(.*)[.]jsonl$", 1)
    return read.select(name.alias("label"), "prediction", "reference").groupBy("label", "prediction", "reference").agg(F.count(F.lit(1)).alias("n"))


def q_dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a saved dataset of two splits, read back by its manifests."""
    path = files.shared_folder(spark, "files")
    d = _table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    outputs.write_dataset(d, path)
    return outputs.read_dataset(spark, path).select("split", "doc_id", "text", "lang", "source", "n_chars")


def q_numbered_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in order as JSON lines, many files and splits; read back with the numbers of the lines."""
    path = files.shared_folder(spark, "files")
    line = F.to_json(F.struct(F.col("text").alias("prediction"), F.col("doc_id").cast("string").alias("reference")))
    _table(spark, sf_dir, "documents").orderBy("doc_id").select(line.alias("value")).write.text(path)
    return outputs.numbered_predictions(spark, path).select(F.col("id").alias("idx"), F.col("reference").cast("long").alias("doc_id"), F.length("prediction").cast("long").alias("n_chars"))


def q_transcripts_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations at URLs that hold their transcripts themselves, some broken, some missing: what became of each, and what was there."""
    path = F.to_json(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), "text")))
    one = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(path.alias("j"), F.sum(F.length("text")).alias("_"))
    held = F.concat(F.lit("data:application/json;base64,"), F.base64(F.when(F.col("conv_id") % 5 == 0, F.expr("left(j, length(j) - 1)")).otherwise(F.col("j")).cast("binary")))
    url = F.when(F.col("conv_id") % 7 == 3, F.lit(None)).otherwise(held)
    got = http.fetch_table(one.select("conv_id", url.alias("url")), "url")
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + F.length(x.text))
    return got.select("conv_id", "status", F.size("segments").cast("long").alias("n_segments"), chars.alias("n_chars"))


# --- audio: the bytes of texts as samples ----------------------------------------------------------------------------


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))


def q_log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the whole bytes of each text, a row for each thirty seconds; frames of silence behind the end are left out."""
    return audio.features(_bytes(spark, sf_dir), "doc_id", "bytes", padded=False)


def q_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes taken as samples at 22,050 a second, at 16,000 afterwards."""
    return _bytes(spark, sf_dir).select("doc_id", F.size(audio.resampled_column(audio.pcm(F.col("bytes")), 22_050)).cast("long").alias("n_samples"))


OVERLAP = (400, 24, 3)


def q_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts cut into windows of words that share their ends, misheard where they were cut; merged again."""
    size, shared, wrong = OVERLAP
    step = size - shared
    d = _spread(spark, sf_dir, "documents", "doc_id", "text")

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - shared) / step).cast("int") - 1)
        heard = lambda k: F.transform(F.slice(w, k * step + 1, F.lit(size)), lambda x, i: F.when((k > 0) & (i < wrong) | (k < last) & (i >= size - wrong), F.concat(x, F.lit("?"))).otherwise(x))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(heard(k), " "))

    heard = once(d, "windows", F.transform(F.array(words(F.coalesce("text", F.lit("")))), cut)[0])
    return heard.select("doc_id", audio.merged_text(F.col("windows"), shared).alias("text"))


RESAMPLED_SQL = "SELECT doc_id, round_even(octet_length(encode(coalesce(text, ''))) * 320 / 441::DOUBLE, 0)::BIGINT AS n_samples FROM documents"
MERGED_SQL = f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> ''), ' ') AS text FROM documents"
PREDICTIONS_SQL = "SELECT role || '_a-b' AS label, text AS prediction, conv_id::VARCHAR AS reference, count(*) AS n FROM conversations GROUP BY ALL"
DATASET_SQL = "SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id, text, lang, source, n_chars FROM documents"
NUMBERED_SQL = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, length(text) AS n_chars FROM documents"
FETCHED_SQL = """SELECT conv_id, CASE WHEN conv_id % 7 = 3 THEN 'no url' WHEN conv_id % 5 = 0 THEN 'no json' ELSE 'ok' END AS status, CASE WHEN conv_id % 7 <> 3 AND conv_id % 5 <> 0 THEN count(*) ELSE 0 END AS n_segments,
CASE WHEN conv_id % 7 <> 3 AND conv_id % 5 <> 0 THEN coalesce(sum(length(text)), 0) ELSE 0 END::BIGINT AS n_chars FROM conversations GROUP BY conv_id"""
_TRANSCRIPT = "SELECT turn::DOUBLE AS start, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS text FROM conversations"
WIDE_SQL = f"""WITH w AS (SELECT turn::VARCHAR AS segment, text, unnest(['m 1', 'm 2']) AS model, unnest([CASE WHEN conv_id % 2 = 0 THEN text END, CASE WHEN turn <> 1 THEN role END]) AS said FROM conversations WHERE turn <> 3 AND regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') <> '')
SELECT segment, model, sum(len({_TOK.format('said')}))::BIGINT AS n_words, sum(len({_TOK.format('text')}))::BIGINT AS n_reference FROM w WHERE regexp_replace(said, '^{_WS}+|{_WS}+$', '', 'g') <> '' GROUP BY 1, 2"""
LATTICE_JSON_SQL = f"""WITH t AS (SELECT {_TOK.format('text')} AS r, {_TOK.format('role')} AS h FROM conversations WHERE text <> '')
SELECT 'same' AS model, sum(len(r))::BIGINT AS words, 0::BIGINT AS edits FROM t WHERE len(r) > 0 UNION ALL SELECT 'role', sum(len(h))::BIGINT, sum(greatest(len(r), 1) - 1)::BIGINT FROM t"""

_SQL = {
    "normalize_text": NORMALIZE_SQL, "tokenize_words": TOKENS_SQL, "url_rewrite": "SELECT page_id, replace(url, 'http://', 'https://') AS url FROM pages",
    "language_filter": "SELECT doc_id, CASE lang WHEN 'en' THEN 'Hindi' ELSE 'hi' END AS language FROM documents WHERE lang IN ('en', 'fr')",
    "utterance_build": UTT_SQL, "utterance_filter": UTT_FILTER_SQL, "max_samples_cap": CAP_SQL, "train_val_split": SPLIT_SQL,
    "standard_wer": STANDARD_SQL, "corpus_wer": CORPUS_SQL, "wer_compare": COMPARE_SQL, "utterance_wer": UTT_WER_SQL, "classify_error": CLASS_SQL,
    "error_strata": STRATA_SQL, "systematic_sample": SAMPLE_SQL, "taxonomy_rank": TAXONOMY_SQL,
    "word_to_number": NUMBER_SQL, "normalize_numbers": NUMBERS_SQL, "number_idiom_skip": IDIOM_SQL,
    "english_tagging": TAG_SQL, "english_words": WORDS_SQL, "cleanup_pipeline": CLEANUP_SQL, "cleanup_changed": CHANGED_SQL,
    "phonotactic": PHON_SQL, "loanword_rule": LOAN_SQL, "ngram_counts": COUNTS_SQL, "ngram_context_counts": CONTEXT_SQL, "lm_score": SCORE_SQL,
    "utterance_removed": REMOVED_SQL, "taxonomy_causes": CAUSES_SQL, "taxonomy_examples": EXAMPLES_SQL, "english_token": TOKEN_SQL, "cleanup_examples": SHOWN_SQL,
    "dictionary_lookup": LOOKUP_SQL, "low_conf_sample": LOW_SQL, "low_conf_review": REVIEW_SQL, 
    "align_matches": MATCHES_SQL, "lattice_bins": BINS_SQL, "trusted_overrides": OVERRIDES_SQL,
    "jsonl_roundtrip": "SELECT text AS prediction, role AS reference, count(*) AS n FROM conversations GROUP BY 1, 2", "csv_roundtrip": "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, nullif(source, '') AS source FROM documents",
    "lattice_wer": LATTICE_SQL, "lattice_rows": ROWS_SQL, "lattice_report": REPORT_SQL, "error_samples": SAMPLES_SQL, "error_samples_json": SAMPLES_SQL, "error_reasons": REASONS_SQL,
    "taxonomy_fixes": FIXES_SQL, "model_rates": RATES_SQL, "spelling_signals_json": SIGNALS_SQL, "spelling_first_low": FIRST_LOW_SQL, "number_multipliers": MULTIPLIERS_SQL, "number_mark_final": MARKS_SQL,
    "cleanup_notes": NOTES_SQL, "surely_english": SURELY_SQL, "shuffled": SHUFFLED_SQL, "preview": PREVIEW_SQL, "demo_utterances": DEMO_UTT_SQL, "compute_metrics": METRICS_SQL,
    "words_roundtrip": "SELECT n_name AS word FROM nation", "transcripts_roundtrip": _TRANSCRIPT, "wide_segments": WIDE_SQL, "lattice_json": LATTICE_JSON_SQL,
    "index_roundtrip": "SELECT c_custkey AS user_id, c_custkey * 10 AS recording_id, 'hi' AS language, c_acctbal AS duration, 'https://host/a/' || c_custkey AS rec_url_gcp, 'https://host/t/' || c_custkey AS transcription_url_gcp, 'https://host/m/' || c_custkey AS metadata_url FROM customer WHERE c_nationkey % 2 = 0",
    "split_roundtrip": f"SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM ({SPLIT_SQL}) GROUP BY 1",
    "resampled": RESAMPLED_SQL, "overlap_merge": MERGED_SQL, "predictions_files": PREDICTIONS_SQL, "dataset_roundtrip": DATASET_SQL, "numbered_predictions": NUMBERED_SQL, "transcripts_fetched": FETCHED_SQL,
    "spelling_classify": CLASSIFY_SQL, "spelling_stats": STATS_SQL, "label_pad_mask": PAD_SQL,
}


def queries() -> dict:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
