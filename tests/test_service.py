"""Reports, the client and the commands."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.plans import client, report
from lectern.sources import media

BATCH = [{"id": 1, "prev": "", "text": "lamda", "next": "", "flags": ["X"], "more": 1}]


def answer(content):
    return client.Reply(200, json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}))


def test_client_retries_and_gives_in():
    replies = iter([client.Reply(500), client.Reply(422), client.Reply(429, retry_after=30), answer('so: {"results": [{"id": 1}]} done')])
    bodies, waits = [], []
    c = client.Client(lambda b: bodies.append(b) or next(replies), "m", ["a"] * 50, sleep=waits.append)
    assert c(BATCH) == [{"id": 1}]
    assert [b["response_format"]["type"] for b in bodies] == ["json_schema", "json_schema", "json_object", "json_object"]
    assert 1 <= waits[0] <= 1.25 and waits[1] == 30 and (c.tokens_in, c.tokens_out) == (3, 2)
    sent = json.loads(bodies[0]["messages"][0]["content"])
    assert len(sent["glossary"]) == 40 and set(sent["segments"][0]) == {"id", "prev", "text", "next", "flags"}


@pytest.mark.parametrize("status", [401, 403, 503])
def test_client_fails(status):
    n = []
    c = client.Client(lambda b: n.append(1) or client.Reply(status), "m", attempts=3, sleep=lambda s: None)
    with pytest.raises(client.Failed):
        c(BATCH)
    assert len(n) == (3 if status == 503 else 1)
    with pytest.raises(client.Failed):
        client.outermost("nothing")


def test_blocks(spark):
    df = spark.createDataFrame([(3, 50, "a-b", 0.125, 7, 2, "CORRECTING")], "i int, n int, slug string, p double, s int, f int, st string")
    x = df.select(report.in_flight(*map(F.col, df.columns)).alias("x")).first().x
    assert x == "[003/050] a-b\nprogress: 12%\nsegments: 7\nsuspicious: 2\nstatus: CORRECTING"
    x = df.select(report.completed(F.lit("/o"), F.lit(2772.0), F.lit(20.0), F.col("s"), F.col("f")).alias("x")).first().x
    assert x == "completed\noutput: /o\nduration: 46m12s\nprocessing: 20s\nsegments: 7\nneeds_review: 2"
    assert df.select(report.host(F.lit("https://h:8/x")).alias("x")).first().x == "h:8"
    w = spark.sql("select array(named_struct('probability', 0.5D), named_struct('probability', 1.0D)) as w, true as t")
    assert w.select(report.word_confidence(F.col("w"), F.col("t")).alias("x")).first().x == 0.75
    assert report.peak_rss_mb() > 1


def test_benchmark_report(spark):
    df = spark.createDataFrame([("v", "b", "m", 0.152, -0.1, {"A": 1, "B": 3, "C": 1, "D": 1}, None, 12.5)], "video string, backend string, model string, real_time_factor double, mean_logprob double, flags map<string,bigint>, recall double, wer double")
    data, text = report.benchmark(df)
    assert json.loads(data)[0]["flags"]["B"] == 3
    assert "| v | b | m | 0.152 | -0.1 | 6 (B 3, A 1, C 1) | - | 12.5 |" in text


def test_commands(spark, tmp_path):
    videos = spark.createDataFrame([(1, "/v/a.mp4", "a", 1, 1.0, "TRANSCRIBED", None, None, None), (2, "/v/b.mp4", "b", 1, 1.0, "FAILED", "extract", None, None)], "id bigint, path string, slug string, size_bytes bigint, mtime double, status string, failed_stage string, error string, updated_at timestamp")
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "mở cloudfront", None, None, None), (2, 0, 0.0, 1.0, "x", None, None, None)], "video_id bigint, id bigint, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double, compression_ratio double")
    rule = spark.createDataFrame([(1, "a", "b", "literal", False, None)], "rule_id bigint, from_text string, to_text string, match_kind string, auto boolean, requires_context array<string>")
    glossary = spark.createDataFrame([(1, 1, ["CloudFront"])], "glossary_id bigint, version bigint, terms array<string>")
    for name, df in (("videos", videos), ("segments_raw", seg), ("correction_rules", rule), ("glossary_files", glossary), ("transcripts", videos)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    t = ["--tables", str(tmp_path)]
    assert {r.status: r.n for r in cli.main(["status", *t], spark).collect()}["TRANSCRIBED"] == 1
    out = cli.main(["correct", *t, "--out", str(tmp_path / "c")], spark)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["mở CloudFront"] and "flags" in out.columns
    cli.main(["export", *t, "--out", str(tmp_path / "e")], spark)
    assert (tmp_path / "e" / "a" / "transcript.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nmở cloudfront\n"
    assert cli.main(["doctor", *t], spark).count() == 5
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "n.mp4").write_bytes(b"1")
    assert cli.main(["scan", *t, "--videos", str(tmp_path / "m")], spark).count() == 3


def test_yaml_sources(spark, tmp_path):
    (tmp_path / "g.yml").write_text("version: 2\nterms: [CloudFront, S3]\n")
    (tmp_path / "r.yml").write_text("corrections:\n  - {from: a b, to: C}\n  - {from: 'x(.)', to: y, match: regex, auto: false, requires_context: [k]}\n")
    (tmp_path / "v.yaml").write_text("must_contain: [S3]\nsample_segments: [{start: 2, text: hi}]\n")
    assert media.glossary(spark, str(tmp_path / "g.yml")).first().terms == ["CloudFront", "S3"]
    got = media.correction_rules(spark, str(tmp_path / "r.yml")).orderBy("rule_id").collect()
    assert [(r.match_kind, r.auto, r.requires_context) for r in got] == [("literal", True, []), ("regex", False, ["k"])]
    assert [(r.slug, r.must_contain, len(r.samples)) for r in media.ground_truth(spark, str(tmp_path), ["v", "none"]).collect()] == [("v", ["S3"], 1)]
