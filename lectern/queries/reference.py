"""Queries of the transcript operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.similarity import common, likeness, word_distance
from lectern.operators import metrics, rules, segments, state, windows
from lectern.plans import pipeline
from lectern.session import table
from lectern.sinks import render
from lectern.streaming import ingest

MODELS = ["gale-medium", "gale-small-vi", "brook-turbo"]
BACKENDS = ["mlx", "faster-whisper"]


def _segments(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    x = segments.once(table(spark, sf, "segments_raw"))
    return x.select("video_id", "id", *cols) if cols else x


# --- state ---------------------------------------------------------------------------------------------------------


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.counts(table(spark, sf, "videos"))


def status_shares(spark: SparkSession, sf: str) -> DataFrame:
    return state.shares(table(spark, sf, "videos"))


def work_transcribe(spark: SparkSession, sf: str) -> DataFrame:
    return state.to_transcribe(table(spark, sf, "videos")).select("id", "path", "status")


def work_correct(spark: SparkSession, sf: str) -> DataFrame:
    return state.to_correct(table(spark, sf, "videos")).select("id", "path", "status")


def work_correct_forced(spark: SparkSession, sf: str) -> DataFrame:
    return state.to_correct(table(spark, sf, "videos"), force=True, stuck=False).select("id", "path", "status")


def work_export(spark: SparkSession, sf: str) -> DataFrame:
    return state.to_export(table(spark, sf, "videos")).select("id", "path", "status")


def next_ten_to_export(spark: SparkSession, sf: str) -> DataFrame:
    """A limited selection: the first ten by path."""
    return state.to_export(table(spark, sf, "videos"), limit=10).select("id", "path", "status")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "video_scans").distinct()
    return x.select("video_id", F.col("run_id").alias("seq"), "status", F.lit("export").alias("stage"), F.lit(None).cast("string").alias("error"), F.col("seen_at").alias("at"))


def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.transition(_history(spark, sf)).select("video_id", "status", "failed_stage", "attempts", F.unix_micros("completed_at").alias("completed_us"), F.unix_micros("updated_at").alias("updated_us"))


def attempts_running(spark: SparkSession, sf: str) -> DataFrame:
    return state.running_attempts(_history(spark, sf), ["seq"]).select("video_id", "seq", "status", "attempts")


def stage_finished(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("video_id", "seq", "status", F.unix_micros(state.finished_at(F.col("status"), F.col("at"))).alias("finished_us"))


def listing_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The last run's listing against the videos known."""
    scans = table(spark, sf, "video_scans").select("run_id", "path", "size_bytes", "mtime").distinct()
    last = scans.groupBy("path").agg(F.max_by(F.struct("size_bytes", "mtime"), "run_id").alias("x")).select("path", "x.size_bytes", "x.mtime")
    return state.listing_actions(last, table(spark, sf, "videos")).select("path", "action")


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    return listing_actions(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def final_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").select("id", state.final_status(F.coalesce("needs_review_count", F.lit(0))).alias("final"))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Videos after a scan that saw one directory's files under new names too."""
    videos = table(spark, sf, "videos")
    scans = table(spark, sf, "video_scans").where("size_bytes is not null and mtime is not null").select("run_id", "path", "size_bytes", "mtime")
    last = scans.groupBy("path").agg(F.max_by(F.struct("size_bytes", "mtime"), "run_id").alias("x")).select("path", "x.size_bytes", "x.mtime")
    moved = last.select(F.regexp_replace("path", r"^/kho/", "/kho2/").alias("path"), "size_bytes", "mtime")
    return state.upsert(last.unionByName(moved), videos, F.lit("2031-04-01 00:00:00").cast("timestamp")).select("path", "slug", "size_bytes", "status")


# --- text ----------------------------------------------------------------------------------------------------------


def fold_terms(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "glossary_files").select("glossary_id", F.posexplode("terms").alias("place", "term"))
    return x.select("glossary_id", "place", T.fold("term").alias("folded"))


def slug_of_videos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").select("id", T.slugify("filename").alias("slug"))


def unique_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return state.unique_slugs(table(spark, sf, "videos").select("path")).select("path", "slug")


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").select("id", T.title_of("slug").alias("title"))


def cue_times(spark: SparkSession, sf: str) -> DataFrame:
    x = _segments(spark, sf, "start_s", "end_s").where("start_s is not null and end_s is not null")
    return x.select("video_id", "id", T.srt_time("start_s").alias("srt_start"), T.srt_time("end_s").alias("srt_end"), T.clock("start_s").alias("clock_start"))


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcripts").select("video_id", T.duration("duration_seconds").alias("length"), T.duration("processing_seconds").alias("took"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf, "text").select("video_id", "id", T.one_line("text").alias("line"), F.size(T.tokens("text")).cast("bigint").alias("n_tokens"))


def rule_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "correction_rules").select(F.explode(T.ngrams(T.tokens(F.lower("from_text")))).alias("ngram"))
    return x.groupBy("ngram").agg(F.count("*").alias("n"))


def digit_runs(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "eval_items").select("item_id", T.digit_runs("text").alias("d"))
    return x.select("item_id", F.size("d").cast("bigint").alias("n_runs"), F.array_join("d", ",").alias("runs"))


def vad_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings out of JSON that other text surrounds."""
    x = table(spark, sf, "transcripts").select("video_id", T.salvage_json(F.concat(F.lit("answer: "), F.col("vad_json"), F.lit(" end"))).alias("j"))
    return x.select("video_id", F.get_json_object("j", "$.enabled").cast("boolean").alias("enabled"), F.get_json_object("j", "$.threshold").cast("double").alias("threshold"))


# --- segments ------------------------------------------------------------------------------------------------------


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return segments.with_neighbours(_segments(spark, sf, "text")).select("video_id", "id", F.length("prev").cast("bigint").alias("prev_chars"), F.length("next").cast("bigint").alias("next_chars"))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    """All eight checks of the texts as they came, with the neighbours as they came."""
    made, terms = rules.settings_of(table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))
    x = rules.candidates_of(segments.with_neighbours(_segments(spark, sf, "text", "start_s", "end_s", "avg_logprob", "no_speech_prob", "compression_ratio")), made)
    near = rules.near_misses(table(spark, sf, "segments_raw").select("video_id", "id", "text"), terms).withColumn("__near", F.lit(True))
    return x.join(near, ["video_id", "id"], "left").withColumn("flags", segments.flags_of("text", F.col("__near"), F.size("candidates") > 0))


def segment_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf).select("video_id", "id", F.array_join("flags", ",").alias("flags")).where("flags <> ''")


def flag_repetition(spark: SparkSession, sf: str) -> DataFrame:
    x = _segments(spark, sf, "text", "start_s", "end_s", "avg_logprob", "no_speech_prob", "compression_ratio")
    return x.where(F.array_contains(segments.flags_of(), "REPETITION")).select("video_id", "id")


def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return segments.flag_histogram(_flagged(spark, sf), ["video_id"])


def top_flags(spark: SparkSession, sf: str) -> DataFrame:
    return segments.flag_histogram(_flagged(spark, sf), ["video_id"], 3).select("video_id", "flag", "n", F.col("rank").cast("bigint").alias("rank"))


def llm_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of the segments that fail any check."""
    x = segments.batches(_flagged(spark, sf).where(F.size("flags") > 0))
    return x.groupBy("video_id", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _flagged_by_all(spark: SparkSession, sf: str) -> DataFrame:
    used = ["video_id", "id", "start_s", "end_s", "text", "avg_logprob", "no_speech_prob", "compression_ratio"]
    return pipeline.flagged(table(spark, sf, "segments_raw").select(*used), table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))


def all_segment_flags(spark: SparkSession, sf: str) -> DataFrame:
    """All eight checks on the corrected texts; no SQL says how these come about."""
    return _flagged_by_all(spark, sf).select("video_id", "id", F.array_join("flags", ",").alias("flags")).where("flags <> ''")


def all_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return segments.flag_histogram(_flagged_by_all(spark, sf), ["video_id"])


def all_top_flags(spark: SparkSession, sf: str) -> DataFrame:
    return segments.flag_histogram(_flagged_by_all(spark, sf), ["video_id"], 3).select("video_id", "flag", "n", F.col("rank").cast("bigint").alias("rank"))


def all_llm_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of all segments whose corrected text fails any check: what the pipeline asks about."""
    x = segments.batches(_flagged_by_all(spark, sf).where(F.size("flags") > 0))
    return x.groupBy("video_id", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    x = segments.with_neighbours(_segments(spark, sf, "text")).withColumn("flags", F.array(F.lit("b"), F.lit("a")))
    return x.select("video_id", "id", segments.request_hash(F.lit(None).cast("string")).alias("request_hash"))


def cache_split(spark: SparkSession, sf: str) -> DataFrame:
    """Requests against a cache of the answers for each second video's segments."""
    asked = request_keys(spark, sf)
    cache = asked.where("video_id % 2 = 0").withColumn("answer", F.lit('{"changed": false}'))
    hit, miss = segments.split_cached(asked, cache)
    return hit.select("video_id", F.lit("hit").alias("outcome")).unionByName(miss.select("video_id", F.lit("miss").alias("outcome"))).groupBy("video_id", "outcome").agg(F.count("*").alias("n"))


def gate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Rules as proposals: the target for the source, with a confidence by rule."""
    x = table(spark, sf, "correction_rules")
    raw, new = T.strip("from_text"), T.strip("to_text")
    sure = F.when(F.col("rule_id") % 7 == 0, F.lit(0.5)).otherwise(F.lit(0.9))
    verdict = segments.gate(raw, new, F.col("rule_id") % 11 != 0, sure, common(raw, new))
    return x.select("rule_id", F.coalesce(verdict, F.lit("accepted")).alias("verdict"))


def rule_likeness(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "correction_rules")
    return x.select("rule_id", common(F.col("from_text"), F.col("to_text")).cast("bigint").alias("shared"), F.round(likeness(F.col("from_text"), F.col("to_text")), 6).alias("likeness"))


def rule_word_distance(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "correction_rules").select("rule_id", T.tokens("from_text").alias("a"), T.tokens("to_text").alias("b"))
    return x.select("rule_id", word_distance(F.col("a"), F.col("b")).cast("bigint").alias("distance"))


def corrected_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling and automatic rules over all videos."""
    made, terms = rules.settings_of(table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))
    x = rules.correct(_segments(spark, sf, "text"), made, terms)
    return x.select("video_id", "id", "text", "n_case", F.array_join("rule_hits", "|").alias("rule_hits"), F.array_join("candidates", "|").alias("candidates"))


def near_misses(spark: SparkSession, sf: str) -> DataFrame:
    _, terms = rules.settings_of(table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))
    return rules.near_misses(_segments(spark, sf, "text"), terms)


def correction_counters(spark: SparkSession, sf: str) -> DataFrame:
    x = pipeline.correct(table(spark, sf, "segments_raw"), table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))
    return metrics.counters(x)


def differences(spark: SparkSession, sf: str) -> DataFrame:
    x = pipeline.correct(table(spark, sf, "segments_raw"), table(spark, sf, "correction_rules"), table(spark, sf, "glossary_files"))
    return pipeline.differences(x).drop("flags")


def speech_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as chunks of speech, joined over gaps below a second into windows of at most 30 s."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    x = _segments(spark, sf, "start_s", "end_s").select("video_id", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms")).where("end_ms > start_ms")
    return windows.merge_chunks(x, 1000, 30_000, 300)


def window_progress(spark: SparkSession, sf: str) -> DataFrame:
    return windows.progress(speech_windows(spark, sf)).select("video_id", F.col("window_no").cast("bigint").alias("window_no"), F.round("progress", 6).alias("progress"))


def renumbered(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with text, numbered anew by window and place."""
    x = _segments(spark, sf, "window_index", "text").where(F.length(T.strip("text")) > 0)
    w = Window.partitionBy("video_id").orderBy("window_index", "id")
    return x.select("video_id", "id", (F.row_number().over(w) - 1).cast("bigint").alias("new_id"))


def projected_times(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as items of windows of 30 s each."""
    x = _segments(spark, sf, "window_index", "start_s", "end_s", "text").where("window_index is not null and start_s is not null and end_s is not null")
    x = x.withColumn("place", F.col("id")).withColumn("window_start", F.col("window_index") * 30.0).withColumn("window_end", F.col("window_start") + 30.0)
    x = x.withColumn("start_s", F.pmod("start_s", F.lit(30.0))).withColumn("end_s", F.pmod("end_s", F.lit(30.0)))
    ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    return segments.projected(x).select("video_id", "id", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))


# --- sinks ---------------------------------------------------------------------------------------------------------


def srt_documents(spark: SparkSession, sf: str) -> DataFrame:
    return render.srt(_segments(spark, sf, "start_s", "end_s", "text"))


def txt_documents(spark: SparkSession, sf: str) -> DataFrame:
    return render.txt(_segments(spark, sf, "text"))


def _markdown(spark: SparkSession, sf: str, timed_only: bool) -> DataFrame:
    x = _segments(spark, sf, "start_s", "end_s", "text", "avg_logprob").withColumn("needs_review", F.coalesce(F.col("avg_logprob") < segments.LOW_LOGPROB, F.lit(False)))
    heads = table(spark, sf, "transcripts").select("video_id", "filename", "duration_seconds", "model", "language").distinct()
    slugs = table(spark, sf, "videos").select(F.col("id").alias("video_id"), "slug")
    return render.markdown(x, heads.join(slugs, "video_id"), timed_only)


def md_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with both times, as SQL says; all_md_documents has all."""
    return _markdown(spark, sf, True)


def all_md_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, False)


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "transcripts").distinct()
    return x.select("video_id", render.as_json(F.struct("filename", "size_bytes", "model", "language")).alias("document"))


# --- metrics -------------------------------------------------------------------------------------------------------


def transcript_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = _segments(spark, sf, "end_s", "avg_logprob", "text").groupBy("video_id").agg(
        F.count("*").alias("n_segments"), F.max_by("end_s", "id").alias("last_end"),
        # whole millionths, so that the sum doesn't depend on its order
        F.avg(F.when((F.abs("avg_logprob") < float("inf")) & ~F.isnan("avg_logprob"), F.rint(F.col("avg_logprob") * 1e6).cast("bigint"))).alias("mean_logprob_millionths"),
        F.count_if(F.length(T.strip("text")) > 0).alias("n_with_text"),
    )
    t = table(spark, sf, "transcripts").distinct().select("video_id", "duration_seconds", "processing_seconds")
    length = F.coalesce(F.nullif("duration_seconds", F.lit(0.0)), "last_end", F.lit(0.0))
    x = t.join(x, "video_id", "left").withColumn("length_s", length)
    return x.select("video_id", "n_segments", "n_with_text", F.round("mean_logprob_millionths", 3).alias("mean_logprob_millionths"), "length_s", F.round(metrics.real_time_factor(F.col("processing_seconds"), F.col("length_s")), 6).alias("real_time_factor"))


def nearest_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The segment that starts nearest to the middle of each video."""
    s = table(spark, sf, "transcripts").distinct().where("duration_seconds is not null").select("video_id", (F.col("duration_seconds") / 2).alias("sample_s"))
    return metrics.nearest_segment(s, _segments(spark, sf, "start_s", "text")).select("video_id", "sample_s", "id", "start_s")


def term_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a glossary file in each document: those it should hold, and those of the next file, which it shouldn't."""
    g = table(spark, sf, "glossary_files").select("glossary_id", "terms")
    d = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 40 + 1).alias("glossary_id"), ((F.col("doc_id") + 1) % 40 + 1).alias("other"))
    x = d.join(g, "glossary_id").join(g.select(F.col("glossary_id").alias("other"), F.col("terms").alias("unwanted")), "other")
    return x.select("doc_id", F.round(metrics.recall(F.col("text"), F.col("terms")), 6).alias("recall"), metrics.forbidden(F.col("text"), F.col("unwanted")).cast("bigint").alias("forbidden"))


def word_errors(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "correction_rules")
    return x.select("rule_id", F.round(metrics.word_error_rate(F.col("to_text"), F.col("from_text")), 6).alias("wer"))


def bench_grid(spark: SparkSession, sf: str) -> DataFrame:
    x = metrics.score_grid(table(spark, sf, "videos").select("id", F.col("backend").alias("own_backend")), BACKENDS, MODELS)
    return x.groupBy("backend", "model").agg(F.count("*").alias("n_videos"), F.count_if(F.col("backend") == F.col("own_backend")).alias("n_own"))


def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The table form of a streaming aggregate: events by type and hour."""
    x = table(spark, sf, "events")
    return ingest.rates(x.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        srt_documents, txt_documents, md_documents, all_md_documents, json_documents, status_counts, status_shares, work_transcribe, work_correct, work_correct_forced, work_export, next_ten_to_export, latest_state,
        attempts_running, stage_finished, listing_actions, scan_report, final_statuses, upserted, fold_terms, slug_of_videos, unique_slugs, titles, cue_times, durations, lines, rule_ngrams, digit_runs,
        vad_settings, neighbours, segment_flags, flag_repetition, flag_counts, top_flags, llm_batches, all_segment_flags, all_flag_counts, all_top_flags, all_llm_batches, request_keys, cache_split, gate_decisions, rule_likeness, rule_word_distance, corrected_segments,
        near_misses, correction_counters, differences, speech_windows, window_progress, renumbered, projected_times, transcript_stats, nearest_segments, term_recall, word_errors, bench_grid, event_rates,
    )
}

_W = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"
_SEG = "seg AS (SELECT DISTINCT * FROM segments_raw)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_W}+'), lambda x: x <> '')"


def _line(c: str) -> str:
    brk = r"\r\n|[\n\r\x0b\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    return _strip(f"regexp_replace({c}, '{brk}', ' ', 'g')")


def _srt(c: str) -> str:
    ms = f"greatest(0, CAST(round_even({c} * 1000, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _clock(c: str) -> str:
    s = f"greatest(0, CAST(round_even({c}, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60)"


def _human(c: str) -> str:
    s = f"CAST(round_even({c}, 0) AS BIGINT)"
    return f"""CASE WHEN {c} IS NULL OR {c} <= 0 THEN '0s' WHEN {s} >= 3600 THEN printf('%dh%02dm%02ds', {s} // 3600, {s} // 60 % 60, {s} % 60)
  WHEN {s} >= 60 THEN printf('%dm%02ds', {s} // 60, {s} % 60) ELSE printf('%ds', {s}) END"""


def _folded(c: str) -> str:
    # strip_accents takes the vowels of Devanagari for accents, so there only non-spacing marks go
    each = r"CASE WHEN regexp_matches(x, '[\p{Devanagari}]') THEN regexp_replace(x, '\p{Mn}', '', 'g') ELSE strip_accents(x) END"
    return rf"replace(lower(CASE WHEN regexp_matches({c}, '\p{{Devanagari}}') THEN array_to_string(list_transform(regexp_extract_all({c}, '[\p{{Devanagari}}]+|[^\p{{Devanagari}}]+'), lambda x: {each}), '') ELSE strip_accents({c}) END), 'đ', 'd')"


# what a regular expression of the operator takes for part of a word
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"


def _pure(c: str) -> str:
    return f"regexp_full_match({c}, '{_WORD}+')"


def _starts(c: str, unit: str) -> str:
    """The token is the unit, or the unit with what is no letter behind it."""
    return f"(lower({c}) = {unit} OR (starts_with(lower({c}), {unit}) AND NOT regexp_matches({c}[length({unit}) + 1], '{_WORD}')))"


def _ends(c: str, unit: str) -> str:
    return f"(lower({c}) = {unit} OR (ends_with(lower({c}), {unit}) AND NOT regexp_matches({c}[length({c}) - length({unit})], '{_WORD}')))"


def _again() -> str:
    """One or two words said four times on end, over the list of tokens w."""
    one = " AND ".join([_pure("w[i + 1]"), _ends("w[i]", "lower(w[i + 1])"), "lower(w[i + 2]) = lower(w[i + 1])", _starts("w[i + 3]", "lower(w[i + 1])")])
    two = " AND ".join([_pure("w[i + 1]"), _pure("w[i + 2]"), _ends("w[i]", "lower(w[i + 2])"), *(f"lower(w[i + {k}]) = lower(w[i + {k - 2}])" for k in (3, 4, 5, 6)), _starts("w[i + 7]", "lower(w[i + 1])")])
    return f"(len(list_filter(range(1, len(w) - 2), lambda i: {one})) > 0 OR len(list_filter(range(1, len(w) - 6), lambda i: {two})) > 0)"


_LCS = """list_last(list_reduce(string_split(a, ''), lambda row, c: list_reduce(range(1, length(b) + 1), lambda acc, j:
  list_append(acc, CASE WHEN b[j] = c THEN row[j] + 1 ELSE greatest(row[j + 1], list_last(acc)) END), [0::BIGINT]), list_transform(range(0, length(b) + 1), lambda z: 0::BIGINT)))"""

_NEAR = f"""texts AS MATERIALIZED (SELECT DISTINCT text FROM segments_raw WHERE text IS NOT NULL),
words AS (SELECT text, {_tokens(_folded("text"))} AS w FROM texts),
grams AS MATERIALIZED (SELECT DISTINCT text, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS a FROM words, (VALUES (1), (2), (3)) n(k)),
terms AS MATERIALIZED (SELECT DISTINCT {_folded("t")} AS b FROM (SELECT unnest(terms) AS t FROM glossary_files) q WHERE length({_strip("t")}) > 0),
sized AS MATERIALIZED (SELECT x, g, length(x) AS n, strlen(x) - length(x) AS more, length(regexp_replace(x, '[\\x00-\\x7f]', '', 'g')) AS wide FROM (SELECT DISTINCT a AS x, true AS g FROM grams WHERE a NOT IN (SELECT b FROM terms) UNION ALL SELECT b, false FROM terms) q),
-- the distance counts bytes, so what letters have beyond one is allowed for; wide letters can only be shared with wide ones
close AS MATERIALIZED (SELECT p.x AS a, t.x AS b FROM sized p JOIN sized t ON p.g AND NOT t.g AND 200 * least(p.n, t.n) >= 78 * (p.n + t.n)
  AND 200 * (p.n - greatest(p.wide - t.wide, 0)) >= 78 * (p.n + t.n) AND 100 * levenshtein(p.x, t.x) <= 22 * (p.n + t.n) + 100 * (p.more + t.more)),
nearly AS MATERIALIZED (SELECT DISTINCT a FROM (SELECT a, length(a) + length(b) AS n, {_LCS} AS l FROM close) q WHERE 200 * l >= 78 * n),
near AS MATERIALIZED (SELECT DISTINCT text FROM grams WHERE a IN (SELECT a FROM nearly))"""

_MATCH = rf"""(CASE WHEN match_kind = 'regex' THEN regexp_matches(text, '(?i)' || from_text)
    ELSE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || array_to_string(list_transform({_tokens("from_text")}, lambda x: regexp_escape(x)), '{_W}+') || '($|[^\p{{L}}\p{{N}}_])') END)"""
_CANDIDATES = f"""beside AS MATERIALIZED (SELECT video_id, id, text, lag(coalesce(text, ''), 1, '') OVER w || ' ' || coalesce(text, '') || ' ' || lead(coalesce(text, ''), 1, '') OVER w AS around FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY id)),
rules AS (SELECT DISTINCT from_text, to_text, match_kind, auto, coalesce(requires_context, []) AS ctx FROM correction_rules WHERE from_text IS NOT NULL AND to_text IS NOT NULL AND length({_strip("from_text")}) > 0),
first_words AS MATERIALIZED (SELECT *, lower({_tokens("from_text")}[1]) AS word FROM rules WHERE NOT auto OR len(ctx) > 0),
low AS MATERIALIZED (SELECT text, lower(text) AS l FROM (SELECT DISTINCT text FROM seg WHERE text IS NOT NULL) q),
maybe AS MATERIALIZED (SELECT low.text, r.* FROM low JOIN first_words r ON contains(low.l, r.word)),
hits AS MATERIALIZED (SELECT text, auto, ctx FROM maybe WHERE {_MATCH}),
open_hits AS MATERIALIZED (SELECT b.video_id, b.id, h.auto, h.ctx, b.around FROM beside b JOIN hits h ON h.text = b.text),
cand AS MATERIALIZED (SELECT DISTINCT video_id, id FROM (SELECT video_id, id, auto, ctx, CASE WHEN auto THEN {_folded("around")} END AS f FROM open_hits) q
  WHERE NOT auto OR len(list_filter(list_transform(ctx, lambda c: {_folded("c")}), lambda c: contains(f, c))) = 0)"""

_FLAGS = f"""{_NEAR}, {_CANDIDATES}, flagged AS MATERIALIZED (
  SELECT q.*, list_filter([
    CASE WHEN avg_logprob < -0.7 THEN 'LOW_LOGPROB' END, CASE WHEN no_speech_prob > 0.6 AND NOT isnan(no_speech_prob) THEN 'HIGH_NOSPEECH' END,
    CASE WHEN compression_ratio > 2.4 AND NOT isnan(compression_ratio) THEN 'HIGH_COMPRESSION' END, CASE WHEN {_again()} THEN 'REPETITION' END,
    CASE WHEN length(t) / secs > 25 THEN 'FAST_TEXT' END, CASE WHEN secs < 0.35 AND length(t) > 12 THEN 'SHORT_SEGMENT' END,
    CASE WHEN near.text IS NOT NULL THEN 'GLOSSARY_NEAR_MISS' END, CASE WHEN cand.id IS NOT NULL THEN 'CORRECTION_CANDIDATE' END], lambda x: x IS NOT NULL) AS flags
  FROM (SELECT *, {_strip("coalesce(text, '')")} AS t, {_tokens("coalesce(text, '')")} AS w, greatest(end_s - start_s, 0.001::DOUBLE) AS secs FROM seg) q
  LEFT JOIN near ON near.text = q.text LEFT JOIN cand ON cand.video_id = q.video_id AND cand.id = q.id)"""

_HISTORY = "hist AS (SELECT DISTINCT * FROM video_scans)"
_LISTED = """last AS (SELECT path, arg_max(struct_pack(s := size_bytes, m := mtime), run_id) AS x FROM video_scans GROUP BY path),
acts AS (SELECT l.path, CASE WHEN v.path IS NULL THEN 'added'
    WHEN l.x.s IS DISTINCT FROM v.size_bytes OR coalesce(abs(l.x.m - v.mtime) > 1e-4, l.x.m IS DISTINCT FROM v.mtime) THEN 'updated' ELSE 'unchanged' END AS action
  FROM last l LEFT JOIN videos v ON v.path = l.path)"""


def _parts(cte: str, cue: str, where: str = "true") -> str:
    return f"""WITH {_SEG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id) AS no, {_line("coalesce(text, '')")} AS line FROM seg WHERE {where}),
cues AS (SELECT video_id, (no - 1) // 1000 AS part, no, {cue} AS cue FROM numbered)
{cte}SELECT video_id, part, count(*) AS n_cues, string_agg(cue, chr(10) ORDER BY no) AS content FROM cues GROUP BY video_id, part"""


_TITLE = f"""array_to_string(list_transform(list_filter(string_split(replace(slug, '_', '-'), '-'), lambda w: w <> ''),
  lambda w: CASE WHEN lower(w) IN ({", ".join(f"'{a}'" for a in T.ACRONYMS)}) THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ')"""



def _slug(c: str) -> str:
    s = f"regexp_replace(left(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '')"
    return f"CASE WHEN {s} = '' THEN 'video' ELSE {s} END"


def _walk(files: str, used: str) -> str:
    """Slugs of ``files`` in order of path, each the first that isn't ``used`` or given before."""
    stem = r"regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]*$', '\1')"
    return f"""base AS (SELECT path, row_number() OVER (ORDER BY path) AS n, {_slug(stem)} AS s FROM {files}),
walk AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS path, ''::VARCHAR AS slug, {used} AS used
  UNION ALL SELECT n, path, slug, list_append(used, slug) FROM (SELECT b.n, b.path, w.used, CASE WHEN NOT list_contains(w.used, b.s) THEN b.s
    ELSE b.s || '-' || list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, b.s || '-' || k))[1] END AS slug FROM walk w JOIN base b ON b.n = w.n + 1) q)"""


_SHARED = f"""pairs AS (SELECT rule_id, {_strip("from_text")} AS a, {_strip("to_text")} AS b FROM correction_rules), shared AS (SELECT *, {_LCS} AS shared FROM pairs)"""
_WORDS = f"""words AS (SELECT rule_id, {_tokens("from_text")} AS a, {_tokens("to_text")} AS b FROM correction_rules),
coded AS (SELECT rule_id, a, b, list_concat(a, b) AS w FROM words),
dist AS (SELECT rule_id, len(b) AS n, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(40 + list_position(w, x) AS INTEGER))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(40 + list_position(w, x) AS INTEGER))), '')) AS d FROM coded)"""
_WINDOWS = f"""{_SEG}, chunks AS (SELECT video_id, s, e, row_number() OVER (PARTITION BY video_id ORDER BY s, e) AS n
  FROM (SELECT video_id, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS s, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS e FROM seg) q WHERE e > s),
walk AS (SELECT video_id, n, s AS ws, e AS we, 1::BIGINT AS k FROM chunks WHERE n = 1
  UNION ALL SELECT c.video_id, c.n, CASE WHEN c.s - w.we < 1000 AND c.e - w.ws <= 30000 THEN w.ws ELSE c.s END, c.e,
    CASE WHEN c.s - w.we < 1000 AND c.e - w.ws <= 30000 THEN w.k ELSE w.k + 1 END
  FROM walk w JOIN chunks c ON c.video_id = w.video_id AND c.n = w.n + 1),
wins AS (SELECT video_id, min(ws) AS start_ms, arg_max(we, n) AS end_ms FROM walk GROUP BY video_id, k)"""

ORACLE = {
    "status_counts": "SELECT status, count(*) AS n FROM videos GROUP BY status",
    "status_shares": f"""SELECT s.place, s.status, count(v.id) AS n, count(v.id) * 100.0::DOUBLE / greatest((SELECT count(*) FROM videos), 1) AS percent
FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(state.SHOWN))}) s(place, status) LEFT JOIN videos v ON v.status = s.status GROUP BY s.place, s.status""",
    "work_transcribe": "SELECT id, path, status FROM videos WHERE status IN ('PENDING', 'EXTRACTING', 'TRANSCRIBING') OR (status = 'FAILED' AND failed_stage IN ('extract', 'transcribe'))",
    "work_correct": "SELECT id, path, status FROM videos WHERE status IN ('TRANSCRIBED', 'CORRECTING') OR (status = 'FAILED' AND failed_stage = 'correct')",
    "work_correct_forced": "SELECT id, path, status FROM videos WHERE status IN ('TRANSCRIBED', 'COMPLETED', 'NEEDS_REVIEW', 'FAILED')",
    "work_export": "SELECT id, path, status FROM videos WHERE status IN ('TRANSCRIBED', 'COMPLETED', 'NEEDS_REVIEW')",
    "next_ten_to_export": "SELECT id, path, status FROM videos WHERE status IN ('TRANSCRIBED', 'COMPLETED', 'NEEDS_REVIEW') ORDER BY path LIMIT 10",
    "latest_state": f"""WITH {_HISTORY} SELECT video_id, arg_max(status, (seen_at, run_id)) AS status, CASE WHEN arg_max(status, (seen_at, run_id)) = 'FAILED' THEN 'export' END AS failed_stage,
  count(*) FILTER (status = 'FAILED') AS attempts, epoch_us(max(seen_at) FILTER (status IN ('COMPLETED', 'NEEDS_REVIEW'))) AS completed_us, epoch_us(max(seen_at)) AS updated_us FROM hist GROUP BY video_id""",
    "attempts_running": f"""WITH {_HISTORY}, n AS (SELECT video_id, run_id AS seq, status, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM hist)
SELECT video_id, seq, status, CASE WHEN status = 'FAILED' THEN k ELSE greatest(k, 1) END AS attempts FROM n""",
    "stage_finished": f"WITH {_HISTORY} SELECT video_id, run_id AS seq, status, CASE WHEN status IN ('COMPLETED', 'NEEDS_REVIEW', 'FAILED', 'TRANSCRIBED') THEN epoch_us(seen_at) END AS finished_us FROM hist",
    "listing_actions": f"WITH {_LISTED} SELECT path, action FROM acts",
    "scan_report": f"WITH {_LISTED} SELECT action, count(*) AS n FROM acts GROUP BY action",
    "final_statuses": "SELECT id, CASE WHEN coalesce(needs_review_count, 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS final FROM videos",
    "fold_terms": "SELECT glossary_id, CAST(i - 1 AS INTEGER) AS place, replace(lower(strip_accents(terms[i])), 'đ', 'd') AS folded FROM (SELECT glossary_id, terms, unnest(range(1, len(terms) + 1)) AS i FROM glossary_files) q",
    "slug_of_videos": """SELECT id, CASE WHEN s = '' THEN 'video' ELSE s END AS slug FROM (SELECT id, regexp_replace(left(regexp_replace(regexp_replace(replace(lower(strip_accents(filename)), 'đ', 'd'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS s FROM videos) q""",
    "unique_slugs": f"WITH RECURSIVE {_walk('videos', '[]::VARCHAR[]')} SELECT path, slug FROM walk WHERE n > 0",
    "upserted": f"""WITH RECURSIVE seen AS (SELECT path, arg_max(struct_pack(s := size_bytes, m := mtime), run_id) AS x FROM video_scans WHERE size_bytes IS NOT NULL AND mtime IS NOT NULL GROUP BY path),
listed AS (SELECT path, x FROM seen UNION ALL SELECT regexp_replace(path, '^/kho/', '/kho2/'), x FROM seen WHERE path LIKE '/kho/%'),
fresh AS (SELECT DISTINCT path, x FROM listed WHERE path NOT IN (SELECT path FROM videos)), {_walk("fresh", "(SELECT list(slug) FROM videos)")},
kept AS (SELECT v.path, v.slug, v.size_bytes, v.mtime, v.status, l.x, l.path IS NOT NULL AND (v.size_bytes IS DISTINCT FROM l.x.s OR coalesce(abs(l.x.m - v.mtime) > 1e-4, true)) AS reset FROM videos v LEFT JOIN listed l ON l.path = v.path)
SELECT path, slug, CASE WHEN reset THEN x.s ELSE size_bytes END AS size_bytes, CASE WHEN reset THEN 'PENDING' ELSE status END AS status FROM kept
UNION ALL SELECT w.path, w.slug, f.x.s, 'PENDING' FROM walk w JOIN fresh f ON f.path = w.path WHERE w.n > 0""",
    "titles": f"SELECT id, {_TITLE} AS title FROM videos",
    "cue_times": f"WITH {_SEG} SELECT video_id, id, {_srt('start_s')} AS srt_start, {_srt('end_s')} AS srt_end, {_clock('start_s')} AS clock_start FROM seg WHERE start_s IS NOT NULL AND end_s IS NOT NULL",
    "durations": f"SELECT video_id, {_human('duration_seconds')} AS length, {_human('processing_seconds')} AS took FROM transcripts",
    "lines": f"WITH {_SEG} SELECT video_id, id, {_line('text')} AS line, CASE WHEN text IS NULL THEN NULL ELSE len({_tokens('text')}) END AS n_tokens FROM seg",
    "rule_ngrams": f"""WITH w AS (SELECT {_tokens("lower(from_text)")} AS w FROM correction_rules), g AS (SELECT unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS ngram FROM w, (VALUES (1), (2), (3)) n(k))
SELECT ngram, count(*) AS n FROM g GROUP BY ngram""",
    "digit_runs": r"SELECT item_id, len(regexp_extract_all(text, '(\p{Nd}+)', 1)) AS n_runs, array_to_string(regexp_extract_all(text, '(\p{Nd}+)', 1), ',') AS runs FROM eval_items",
    "vad_settings": "SELECT video_id, CAST(json_extract_string(vad_json, '$.enabled') AS BOOLEAN) AS enabled, CAST(json_extract_string(vad_json, '$.threshold') AS DOUBLE) AS threshold FROM transcripts",
    "neighbours": f"""WITH {_SEG} SELECT video_id, id, length(lag(coalesce(text, ''), 1, '') OVER w) AS prev_chars, length(lead(coalesce(text, ''), 1, '') OVER w) AS next_chars FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY id)""",
    "near_misses": f"WITH {_SEG}, {_NEAR} SELECT s.video_id, s.id FROM seg s JOIN near ON near.text = s.text",
    "segment_flags": f"WITH {_SEG}, {_FLAGS} SELECT video_id, id, array_to_string(flags, ',') AS flags FROM flagged WHERE len(flags) > 0",
    "flag_repetition": f"WITH {_SEG} SELECT video_id, id FROM (SELECT video_id, id, {_tokens("coalesce(text, '')")} AS w FROM seg) q WHERE {_again()}",
    "flag_counts": f"WITH {_SEG}, {_FLAGS} SELECT video_id, flag, count(*) AS n FROM (SELECT video_id, unnest(flags) AS flag FROM flagged) q GROUP BY video_id, flag",
    "top_flags": f"""WITH {_SEG}, {_FLAGS}, each AS (SELECT video_id, id, i, flags[i] AS flag FROM (SELECT video_id, id, flags, unnest(range(1, len(flags) + 1)) AS i FROM flagged) q),
c AS (SELECT video_id, flag, count(*) AS n, min((id, i)) AS f FROM each GROUP BY video_id, flag), r AS (SELECT video_id, flag, n, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f, flag) AS rank FROM c)
SELECT * FROM r WHERE rank <= 3""",
    "llm_batches": f"""WITH {_SEG}, {_FLAGS}, b AS (SELECT video_id, id, (row_number() OVER (PARTITION BY video_id ORDER BY id) - 1) // 10 AS batch FROM flagged WHERE len(flags) > 0)
SELECT video_id, batch, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY video_id, batch""",
    "request_keys": f"""WITH {_SEG} SELECT video_id, id, sha256('None:v1:' || lag(coalesce(text, ''), 1, '') OVER w || ':' || coalesce(text, '') || ':' || lead(coalesce(text, ''), 1, '') OVER w || ':a,b') AS request_hash FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY id)""",
    "cache_split": f"WITH {_SEG} SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM seg GROUP BY video_id",
    "gate_decisions": rf"""WITH {_SHARED} SELECT rule_id, CASE WHEN rule_id % 11 = 0 THEN 'accepted' WHEN b = '' THEN 'empty_correction' WHEN a = b THEN 'identical_to_raw' WHEN rule_id % 7 = 0 THEN 'confidence_below_0.85'
  WHEN shared * 200 < (length(a) + length(b)) * 60 THEN 'fuzz_ratio_below_60' WHEN length(b) * 10 < greatest(length(a), 1) * 7 OR length(b) * 10 > greatest(length(a), 1) * 14 THEN 'length_ratio_outside_0.7_1.4'
  WHEN regexp_extract_all(a, '\p{{Nd}}+') <> regexp_extract_all(b, '\p{{Nd}}+') THEN 'numbers_modified' WHEN abs(len({_tokens("a")}) - len({_tokens("b")})) > 3 THEN 'word_count_diff_exceeds_3' ELSE 'accepted' END AS verdict FROM shared""",
    "rule_likeness": f"WITH {_SHARED.replace(_strip('from_text'), 'from_text').replace(_strip('to_text'), 'to_text')} SELECT rule_id, shared, round(shared * 200.0::DOUBLE / (length(a) + length(b)), 6) AS likeness FROM shared",
    "rule_word_distance": f"WITH {_WORDS} SELECT rule_id, d AS distance FROM dist",
    "word_errors": f"WITH {_WORDS} SELECT rule_id, round(d / n, 6) AS wer FROM dist",
    "speech_windows": f"WITH RECURSIVE {_WINDOWS} SELECT * FROM wins WHERE end_ms - start_ms >= 300",
    "window_progress": f"""WITH RECURSIVE {_WINDOWS}, w AS (SELECT * FROM wins WHERE end_ms - start_ms >= 300)
SELECT video_id, row_number() OVER p - 1 AS window_no, round(least(sum(end_ms - start_ms) OVER (p ROWS UNBOUNDED PRECEDING) / greatest(sum(end_ms - start_ms) OVER (PARTITION BY video_id), 1), 1), 6) AS progress FROM w WINDOW p AS (PARTITION BY video_id ORDER BY start_ms, end_ms)""",
    "renumbered": f"WITH {_SEG} SELECT video_id, id, row_number() OVER (PARTITION BY video_id ORDER BY window_index NULLS FIRST, id) - 1 AS new_id FROM seg WHERE length({_strip('text')}) > 0",
    "srt_documents": _parts("", f"no || chr(10) || {_srt('start_s')} || ' --> ' || {_srt('end_s')} || chr(10) || line || chr(10)", "start_s IS NOT NULL AND end_s IS NOT NULL"),
    "txt_documents": _parts("", "line"),
    "json_documents": "SELECT DISTINCT video_id, CAST(to_json(struct_pack(filename := filename, size_bytes := size_bytes, model := model, language := language)) AS VARCHAR) AS document FROM transcripts",
    "md_documents": f"""WITH {_SEG}, m AS (SELECT *, coalesce(avg_logprob < -0.7, false) AS review FROM seg),
st AS (SELECT video_id, count(*) AS n, count(*) FILTER (review) AS r, arg_max_null(end_s, id) AS e FROM m GROUP BY video_id),
h AS (SELECT DISTINCT t.video_id, {_TITLE} AS title, t.filename, t.duration_seconds, t.model, t.language FROM transcripts t JOIN videos v ON v.id = t.video_id),
hs AS (SELECT h.*, st.n, st.r, coalesce(nullif(duration_seconds, 0), e, 0) AS len FROM h JOIN st ON st.video_id = h.video_id),
heads AS (SELECT video_id, '# ' || title || chr(10) || chr(10) || '- source: `' || filename || '`' || chr(10) || '- duration: ' || {_clock("len")} || chr(10) || '- model: ' || coalesce(model, 'None') || chr(10)
  || '- language: ' || coalesce(language, 'None') || chr(10) || '- segments: ' || n || chr(10) || '- needs_review: ' || r || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) AS head FROM hs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id) AS no, {_line("coalesce(text, '')")} AS line FROM m WHERE start_s IS NOT NULL AND end_s IS NOT NULL),
cues AS (SELECT video_id, (no - 1) // 1000 AS part, no, '[' || {_clock("start_s")} || ' - ' || {_clock("end_s")} || ']' || CASE WHEN review THEN ' <!-- needs_review -->' ELSE '' END || chr(10) || line || chr(10) AS cue FROM numbered),
parts AS (SELECT video_id, part, count(*) AS n_cues, string_agg(cue, chr(10) ORDER BY no) AS content FROM cues GROUP BY video_id, part)
SELECT p.video_id, part, n_cues, CASE WHEN part = 0 THEN head || content ELSE content END AS content FROM parts p JOIN heads ON heads.video_id = p.video_id""",
    "projected_times": f"""WITH {_SEG}, i AS (SELECT video_id, id, window_index, round_even((window_index * 30.0::DOUBLE + start_s % 30.0::DOUBLE) * 1000, 0) AS s,
    round_even(least(window_index * 30.0::DOUBLE + end_s % 30.0::DOUBLE, window_index * 30.0::DOUBLE + 30) * 1000, 0) AS e
  FROM seg WHERE window_index IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND length({_strip("text")}) > 0)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY window_index, id) - 1 AS id, CAST(s AS BIGINT) AS start_ms, CAST(CASE WHEN e <= s THEN s + 100 ELSE e END AS BIGINT) AS end_ms FROM i""",
    "transcript_stats": f"""WITH {_SEG}, s AS (SELECT video_id, count(*) AS n_segments, arg_max_null(end_s, id) AS last_end, count(*) FILTER (length({_strip('text')}) > 0) AS n_with_text, round(avg(CASE WHEN isfinite(avg_logprob) THEN CAST(round_even(avg_logprob * 1e6, 0) AS BIGINT) END), 3) AS mean_logprob_millionths FROM seg GROUP BY video_id),
t AS (SELECT DISTINCT video_id, duration_seconds, processing_seconds FROM transcripts), j AS (SELECT t.*, s.n_segments, s.n_with_text, s.mean_logprob_millionths, coalesce(nullif(duration_seconds, 0), last_end, 0) AS length_s FROM t LEFT JOIN s ON s.video_id = t.video_id)
SELECT video_id, n_segments, n_with_text, mean_logprob_millionths, length_s, round(processing_seconds / greatest(length_s, 1e-4), 6) AS real_time_factor FROM j""",
    "nearest_segments": f"""WITH {_SEG}, t AS (SELECT DISTINCT video_id, duration_seconds / 2 AS sample_s FROM transcripts WHERE duration_seconds IS NOT NULL),
r AS (SELECT t.video_id, sample_s, id, start_s, row_number() OVER (PARTITION BY t.video_id ORDER BY abs(start_s - sample_s), id) AS k FROM t JOIN seg ON seg.video_id = t.video_id WHERE start_s IS NOT NULL)
SELECT video_id, sample_s, id, start_s FROM r WHERE k = 1""",
    "term_recall": """SELECT d.doc_id, round(len(list_filter(g.terms, lambda t: contains(d.text, t))) * 100.0::DOUBLE / len(g.terms), 6) AS recall, len(list_filter(o.terms, lambda t: contains(d.text, t))) AS forbidden
FROM documents d JOIN glossary_files g ON g.glossary_id = d.doc_id % 40 + 1 JOIN glossary_files o ON o.glossary_id = (d.doc_id + 1) % 40 + 1""",
    "bench_grid": f"""SELECT b.backend, m.model, count(*) AS n_videos, count(*) FILTER (v.backend = b.backend) AS n_own FROM videos v, (VALUES {", ".join(f"('{b}')" for b in BACKENDS)}) b(backend), (VALUES {", ".join(f"('{m}')" for m in MODELS)}) m(model) GROUP BY b.backend, m.model""",
    "event_rates": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP)) AS window_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
