"""Transcript operators on small cases, golden documents and brute force."""

import json
import random
import wave

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.similarity import lcs, likeness, word_distance
from lectern.operators import metrics, rules, segments, state, windows
from lectern.plans import pipeline
from lectern.sinks import render
from lectern.sources import media
from lectern.sources.settings import Settings
from lectern.streaming import ingest

SEG = "video_id bigint, id bigint, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double, compression_ratio double"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("Đường Phố", "duong pho"), ("ÀÉÎ", "aei"), ("straße", "straße"), ("", "")])
def test_fold(spark, text, want):
    assert one(spark, T.fold("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("Bài 1: Tổng quan_AWS", "bai-1-tong-quan-aws"), ("???", "video"), ("a" * 79 + " bc", "a" * 79)])
def test_slugify(spark, text, want):
    assert one(spark, T.slugify("t"), t=text) == want


def test_times(spark):
    assert one(spark, T.srt_time("t"), t=3661.0625) == "01:01:01,062"
    assert one(spark, T.srt_time("t"), t=-1.0) == "00:00:00,000"
    assert one(spark, T.srt_time("t"), t=360000.0) == "100:00:00,000"
    assert [one(spark, T.clock("t"), t=x) for x in (4.5, 5.5, 18.5)] == ["00:00:04", "00:00:06", "00:00:18"]
    assert [one(spark, T.duration("t"), t=x) for x in (-1.0, 20.0, 2772.0, 3920.0)] == ["0s", "20s", "46m12s", "1h05m20s"]


def test_titles_lines_and_ngrams(spark):
    assert one(spark, T.title_of("t"), t="ec2-co_ban--iAm-vPc2") == "EC2 Co Ban IAM VPc2"
    assert one(spark, T.one_line("t"), t=" a\r\nb c\xa0") == "a b c"
    assert one(spark, T.ngrams(T.tokens("t")), t="a  b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, T.ngrams(T.tokens("t")), t="") == []
    assert one(spark, T.salvage_json("t"), t='so: {"a": 1} ok') == '{"a": 1}'
    assert one(spark, T.salvage_json("t"), t="none") is None


def test_lcs_and_word_distance(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = step(row, x, b)
        return row[-1]

    def step(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lcs(a, b) == slow(a, b)
    assert one(spark, likeness(F.col("a"), F.col("b")), a="lamda", b="lambda") == pytest.approx(1000 / 11)
    assert one(spark, likeness(F.col("a"), F.col("b")), a="", b="") == 100
    assert one(spark, word_distance(T.tokens("a"), T.tokens("b")), a="a b c d", b="a x c") == 2


def test_flags(spark):
    rows = [
        (1, 0, 0.0, 10.0, "fine", -0.1, 0.1, 1.0), (1, 1, 0.0, 10.0, "xin chào xin chào xin chào xin chào", -0.71, 0.61, 2.5),
        (1, 2, 0.0, 0.3, "abcdefghijklm", None, None, None), (1, 3, 1.0, 1.0, None, float("nan"), float("nan"), float("nan")),
    ]
    got = {r.id: r.flags for r in spark.createDataFrame(rows, SEG).select("id", segments.flags_of().alias("flags")).collect()}
    assert got == {0: [], 1: ["LOW_LOGPROB", "HIGH_NOSPEECH", "HIGH_COMPRESSION", "REPETITION"], 2: ["FAST_TEXT", "SHORT_SEGMENT"], 3: []}


@pytest.mark.parametrize(
    ("raw", "new", "changed", "sure", "want"),
    [
        ("a b", "a c", False, 0.9, None), ("a b", " ", True, 0.9, "empty_correction"), ("a b", "a b", True, 0.9, "identical_to_raw"), ("a b c", "a b d", True, 0.84, "confidence_below_0.85"),
        ("abcdef", "uvwxyz", True, 0.9, "fuzz_ratio_below_60"), ("abcdefghij", "abcdefghijklmno", True, 0.9, "length_ratio_outside_0.7_1.4"), ("cost 12 now", "cost 13 now", True, 0.9, "numbers_modified"),
        ("abcdefghijkl", "a b c d efghijkl", True, 0.9, "word_count_diff_exceeds_3"), ("mo may ao ec2", "mo may ao EC2", True, 0.9, None),
    ],
)
def test_gate(spark, raw, new, changed, sure, want):
    from lectern.functions.similarity import common

    df = spark.createDataFrame([(raw, new, changed, sure)], "a string, b string, c boolean, d double")
    a, b = T.strip("a"), T.strip("b")
    assert df.select(segments.gate(a, b, F.col("c"), F.col("d"), common(a, b)).alias("x")).first().x == want


def test_decisions(spark):
    seg = spark.createDataFrame([(1, 0, "mo ec2", "mo ec2", ["X"]), (1, 1, "a", "a", ["X"]), (1, 2, "b", "b", [])], "video_id bigint, id bigint, raw_text string, text string, flags array<string>")
    ans = spark.createDataFrame([(1, 0, 1, True, "mo EC2", 0.2, False), (1, 0, 2, True, "mo EC2", 0.9, False), (1, 9, 3, True, "x", 1.0, False)], "video_id bigint, id bigint, ord bigint, changed boolean, corrected string, confidence double, needs_review boolean")
    got = {r.id: (r.text, r.accepted, r.needs_review) for r in segments.decide(seg, ans).collect()}
    assert got == {0: ("mo EC2", True, False), 1: ("a", False, True), 2: ("b", False, False)}


RULES = [
    rules.Rule("rao 53", "Route 53", True, True, ["dns"]), rules.Rule("vi pi si", "VPC", True, True, ["route"]), rules.Rule(r"ét ba(\d*)", r"S3\1", False, True, []),
    rules.Rule("lam da", "Lambda", True, False, []), rules.Rule("ý e hai", "EC2", True, True, ["máy chủ"]),
]


def sequential(texts, made, terms):
    """The plain fold: the text before is corrected, the one behind raw, all patterns tried."""
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append((None, []))
            continue
        t, _ = rules.Speller(terms).spell(t)
        prev = (out[i - 1][0] or "") if i else ""
        following = (texts[i + 1] or "") if i + 1 < len(texts) else ""
        window, hits = rules.folded(f"{prev} {t} {following}"), []
        for r in made:
            if r.auto and r.in_context(window) and r.pattern.search(t):
                t = r.pattern.sub(r.target, t)
                hits.append(r.source)
        out.append((t, hits))
    return out


def test_corrections_depend_on_the_corrected_text_before(spark):
    rng = random.Random(2)
    words = ["rao 53", "dns", "vi pi si", "ét ba2", "lam da", "ý e hai", "máy chủ", "xin chào", "cloudfront", "route"]
    videos = {v: [rng.choice([None, *[" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(8)]]) for _ in range(120)] for v in range(6)}
    videos[99] = ["rao 53 dns", "vi pi si", "hết"]
    rows = [(v, i, 0.0, 1.0, t, None, None, None) for v, x in videos.items() for i, t in enumerate(x)]
    got = rules.correct(spark.createDataFrame(rows, SEG), RULES, ["CloudFront", "Route"])
    by = {(r.video_id, r.id): r for r in got.collect()}
    assert by[99, 1].text == "VPC"
    for v, x in videos.items():
        for i, (t, hits) in enumerate(sequential(x, RULES, ["CloudFront", "Route"])):
            assert (by[v, i].text, by[v, i].rule_hits) == (t, hits), (v, i)


def test_candidates_and_near_misses(spark):
    made = rules.Rules(RULES)
    assert made.candidates("", "dùng lam da và ý e hai", "") == ["manual: lam da", "unmet context: ý e hai"]
    assert made.candidates("máy chủ", "ý e hai", "") == []
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "gọi lamda đi", None, None, None), (1, 1, 0.0, 1.0, "gọi lambda ngay bây giờ", None, None, None), (1, 2, 0.0, 1.0, None, None, None, None), (1, 3, 0.0, 1.0, "cloud fronts", None, None, None)], SEG)
    assert sorted(r.id for r in rules.near_misses(df, ["Lambda", "CloudFront"]).collect()) == [0, 3]


def merged(chunks, gap, most, least):
    out, now = [], None
    for s, e in sorted(chunks):
        if now and s - now[1] < gap and e - now[0] <= most:
            now[1] = e
        else:
            if now:
                out.append(tuple(now))
            now = [s, e]
    return [x for x in [*out, *([tuple(now)] if now else [])] if x[1] - x[0] >= least]


def test_speech_windows(spark):
    rng = random.Random(3)
    chunks = {v: [(s := rng.randint(0, 200_000), s + rng.randint(1, 9000)) for _ in range(150)] for v in range(5)}
    df = spark.createDataFrame([(v, s, e) for v, x in chunks.items() for s, e in x], "video_id bigint, start_ms bigint, end_ms bigint")
    got = {}
    for r in windows.merge_chunks(df, 1000, 30_000, 300).collect():
        got.setdefault(r.video_id, []).append((r.start_ms, r.end_ms))
    assert {v: sorted(x) for v, x in got.items()} == {v: sorted(merged(x, 1000, 30_000, 300)) for v, x in chunks.items()}
    total = spark.createDataFrame([(0, 50_000), (77, 9_000)], "video_id bigint, total_ms bigint")
    got = [tuple(r) for r in windows.merge_chunks(df, 1000, 30_000, 300, total).collect()]
    assert (77, 0, 9000) in got and max(e for v, _, e in got if v == 0) <= 50_000


def test_slugs_and_upsert(spark):
    files = spark.createDataFrame([("/v/a.mp4",), ("/v/b/a.mp4",), ("/v/a-2.mp4",), ("/v/z/A.mov",)], "path string")
    got = {r.path: r.slug for r in state.unique_slugs(files).collect()}
    assert got == {"/v/a-2.mp4": "a-2", "/v/a.mp4": "a", "/v/b/a.mp4": "a-3", "/v/z/A.mov": "a-4"}
    videos = spark.createDataFrame([(1, "/v/a.mp4", "a", 10, 1.0, "COMPLETED", None, None, None)], "id bigint, path string, slug string, size_bytes bigint, mtime double, status string, failed_stage string, error string, updated_at timestamp")
    listing = spark.createDataFrame([("/v/a.mp4", 11, 1.0), ("/v/x/a.mp4", 5, 2.0)], "path string, size_bytes bigint, mtime double")
    got = {r.path: (r.id, r.slug, r.status, r.size_bytes) for r in state.upsert(listing, videos, F.current_timestamp()).collect()}
    assert got == {"/v/a.mp4": (1, "a", "PENDING", 11), "/v/x/a.mp4": (None, "a-2", "PENDING", 5)}


def test_history(spark):
    import datetime as dt

    at = [dt.datetime(2031, 1, 1, 0, i) for i in range(5)]
    rows = [(1, 0, "FAILED", "correct", "boom", at[0]), (1, 1, "TRANSCRIBED", "transcribe", None, at[1]), (2, 0, "COMPLETED", "export", None, at[2]), (2, 1, "FAILED", "export", "x", at[3])]
    h = spark.createDataFrame(rows, "video_id bigint, seq bigint, status string, stage string, error string, at timestamp")
    got = {r.video_id: (r.status, r.failed_stage, r.error, r.attempts, r.completed_at) for r in state.transition(h).collect()}
    assert got == {1: ("TRANSCRIBED", None, None, 1, None), 2: ("FAILED", "export", "x", 1, at[2])}
    with pytest.raises(ValueError):
        state.transition(h.withColumn("status", F.lit("LOST")))


GOLDEN = "1\n00:00:00,000 --> 00:00:04,500\nmột\n\n2\n00:00:05,000 --> 00:00:12,000\nhai ba\n"


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.0, 4.5, "một", None, None, None), (1, 1, 5.0, 12.0, " hai\nba ", None, None, None)], SEG)
    assert render.srt(df).first().content == GOLDEN
    assert render.txt(df).first().content == "một\nhai ba"
    head = spark.createDataFrame([(1, "ec2-intro", "v.mp4", 0.0, "m", None)], "video_id bigint, slug string, filename string, duration_seconds double, model string, language string")
    md = render.markdown(df.withColumn("needs_review", F.col("id") == 1), head).first().content
    assert md.startswith("# EC2 Intro\n\n- source: `v.mp4`\n- duration: 00:00:12\n- model: m\n- language: None\n- segments: 2\n- needs_review: 1\n\n## Transcript\n\n[00:00:00 - 00:00:04]\nmột\n\n[00:00:05 - 00:00:12] <!-- needs_review -->\nhai ba")
    many = spark.range(2500).selectExpr("1L AS video_id", "id", "CAST(id AS double) AS start_s", "CAST(id + 1 AS double) AS end_s", "'x' AS text", "'s' AS slug")
    parts = render.srt(many).withColumn("slug", F.lit("s"))
    assert sorted(r.n_cues for r in parts.collect()) == [500, 1000, 1000]
    assert render.write_documents(parts, str(tmp_path)).first().n_parts == 3
    text = (tmp_path / "s" / "transcript.srt").read_text()
    assert text.count("-->") == 2500 and "\n\n1001\n" in text
    assert not list((tmp_path / "s").glob(".*"))


def test_outdated(spark):
    src = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "slug string, modified bigint")
    out = spark.createDataFrame([(s, x, m) for s, m in (("a", 6), ("b", 4)) for x in (".srt", ".txt", ".md")] + [("c", ".srt", 9)], "slug string, suffix string, modified bigint")
    assert sorted(r.slug for r in render.outdated(src, out).collect()) == ["b", "c"]


def transcript(**change):
    seg = {"id": 0, "start": 0.0, "end": 1.0, "text": "a", "avg_logprob": -0.1, "no_speech_prob": 0.1, "compression_ratio": 1.0, "temperature": 0.0, "confidence": None, "window_index": 0}
    t = {"schema_version": "1.0", "video": {"filename": "v.mp4", "relative_path": "v.mp4", "duration_seconds": 1.0, "size_bytes": 1}, "transcription": {"model": "m"}, "segments": [seg]}
    return t | change


def test_strict_transcripts(spark, tmp_path):
    bad_segment = transcript()
    bad_segment["segments"] = [bad_segment["segments"][0] | {"odd": 1}]
    sparse = transcript()
    sparse["segments"] = [sparse["segments"][0] | {"id": 3}]
    docs = {"ok": transcript(), "empty": transcript(segments=[]), "extra": transcript(x=1), "version": transcript(schema_version="2.0"), "odd": bad_segment, "sparse": sparse}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    (tmp_path / "junk.json").write_text("{")
    good, bad = media.transcripts(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in good.collect()) == ["empty.json", "ok.json"]
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in bad.collect()} == {"extra.json": "unknown or missing keys", "version.json": "unknown version", "odd.json": "unknown keys in segments", "sparse.json": "ids aren't dense", "junk.json": "no valid JSON"}
    assert media.segments_of(good).count() == 1


def test_listing_audio_and_settings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.MP4", "sub/a.mov", ".hidden.mp4", "c.txt"):
        (tmp_path / n).write_bytes(b"xy")
    files = media.listing(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["b.MP4", "a.mov"]
    probed = media.probed(files, lambda p: 1.5 if p.endswith("MP4") else 1 / 0)
    assert [r.duration_seconds for r in probed.collect()] == [1.5, None]
    for name, rate in (("good.wav", 16_000), ("bad.wav", 8_000)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((16384).to_bytes(2, "little", signed=True) * 1600)
    got = {r.path.rsplit("/", 1)[1]: r for r in media.audio(spark, str(tmp_path)).collect()}
    assert (got["good.wav"].seconds, got["good.wav"].peak) == (0.1, 0.5) and "rate" in got["bad.wav"].problem
    (tmp_path / "s.yml").write_text("batch_size: 5\nvideo_dir: here\n")
    s = Settings.load(str(tmp_path / "s.yml"), {"LECTERN_BATCH_SIZE": "7", "LECTERN_FORCE": "true"}, video_dir=None, output_dir="o")
    assert (s.batch_size, s.force, s.video_dir, s.output_dir) == (7, True, "here", "o")
    (tmp_path / "bad.yml").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "bad.yml"), {})


def test_pipeline_with_an_answerer(spark):
    rows = [(1, i, float(i), i + 1.0, t, lp, None, None) for i, (t, lp) in enumerate([("mở cloudfront", -0.1), ("dùng lamda 2", -0.9), ("xấu", -0.9)])]
    rule_table = spark.createDataFrame([(1, "ét ba", "S3", "literal", True, None)], "rule_id bigint, from_text string, to_text string, match_kind string, auto boolean, requires_context array<string>")
    glossary = spark.createDataFrame([(1, 1, ["CloudFront", "Lambda"])], "glossary_id bigint, version bigint, terms array<string>")

    def answerer(batch):
        if any(r["text"] == "xấu" for r in batch):
            raise RuntimeError("busy")
        return [{"id": r["id"], "changed": True, "corrected": r["text"].replace("lamda", "Lambda"), "reason": "", "confidence": 0.95, "needs_review": False} for r in batch]

    got = {r.id: r for r in pipeline.correct(spark.createDataFrame(rows, SEG), rule_table, glossary, Settings(batch_size=1), answerer).collect()}
    assert [got[i].text for i in range(3)] == ["mở CloudFront", "dùng Lambda 2", "xấu"]
    assert [got[i].needs_review for i in range(3)] == [False, False, True]
    with pytest.raises(ValueError):
        pipeline.recogniser("none")


def test_metrics(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", None, None, None), (1, 1, 4.0, 5.0, "b", None, None, None)], SEG)
    near = metrics.nearest_segment(spark.createDataFrame([(1, 2.0)], "video_id bigint, sample_s double"), seg).first()
    assert near.id == 0
    df = spark.createDataFrame([("x Lambda y", ["Lambda", "S3"], [])], "t string, a array<string>, b array<string>")
    r = df.select(metrics.recall(F.col("t"), F.col("a")).alias("r"), metrics.forbidden(F.col("t"), F.col("b")).alias("f")).first()
    assert (r.r, r.f) == (50.0, None)


def test_streaming_ingest_is_repeatable(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, i, 0.0, 10.0, "x", -0.9, None, None) for i in range(5)], SEG)
    df.write.parquet(src)
    for _ in range(2):
        ingest.flagged_into(ingest.arriving(spark, src, df.schema), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    df.withColumn("video_id", F.lit(2).cast("bigint")).write.mode("append").parquet(src)
    ingest.flagged_into(ingest.arriving(spark, src, df.schema), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_choice_of_source(spark):
    raw = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "video_id bigint, id bigint, text string")
    done = spark.createDataFrame([(1, 0, "A", True)], "video_id bigint, id bigint, text string, needs_review boolean")
    assert {r.video_id: (r.text, r.needs_review) for r in segments.chosen(raw, done).collect()} == {1: ("A", True), 2: ("b", None)}
    assert {r.video_id: r.text for r in segments.fresh_over(raw, done.drop("needs_review"), ["video_id", "id"]).collect()} == {1: "A", 2: "b"}
