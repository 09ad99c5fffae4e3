"""Documents written by the commands, read again."""

import json
import os

import pytest

from lectern import cli
from lectern.sinks import render

SEG = "video_id bigint, id bigint, start_s double, end_s double, text string"


def test_json_transcripts_read_again(spark, monkeypatch):
    monkeypatch.setattr(render, "PART", 3)
    rows = [(1, i, float(i), None if i == 2 else i + 0.5, None if i == 4 else f'line "{i}"\nở') for i in range(8)]
    heads = spark.createDataFrame([(1, "a.mp4", None), (2, "b.mp4", "vi")], "video_id bigint, filename string, language string")
    parts = render.json_transcript(spark.createDataFrame(rows, SEG), heads, ["id", "start_s", "end_s", "text"]).orderBy("video_id", "part").collect()
    read = {v: json.loads("\n".join(r.content for r in parts if r.video_id == v) + render.JSON_END) for v in (1, 2)}
    assert read[1]["video"] == {"filename": "a.mp4", "language": None} and read[2]["segments"] == []
    assert [tuple(s.values()) for s in read[1]["segments"]] == [r[1:] for r in rows]


@pytest.fixture
def tables():
    return "/root/testdata/sf0.001"


def test_commands_write_documents(spark, tmp_path, tables):
    out = str(tmp_path / "out")
    first = cli.main(["export", "--tables", tables, "--out", out, "--limit", "2"], spark)
    paths = sorted(r.path for r in first.collect())
    assert len(paths) == 6 and all(os.path.getsize(p) for p in paths)
    for path in paths:
        os.utime(path, (4e9, 4e9))  # later than the tables' dates
    assert cli.main(["export", "--tables", tables, "--out", out, "--limit", "2"], spark).count() == 0
    assert cli.main(["export", "--tables", tables, "--out", out, "--limit", "2", "--force"], spark).count() == 6
    video = spark.read.parquet(f"{tables}/videos.parquet").where("status = 'COMPLETED'").orderBy("path").first()
    made = cli.main(["write_json", "--tables", tables, "--out", out, "--video", video.path], spark).collect()
    assert {os.path.basename(r.path) for r in made} == {"raw.json", "corrected.json", "corrections.json"}
    with open(os.path.join(out, video.slug, "raw.json"), encoding="utf-8") as f:
        raw = json.load(f)
    with open(os.path.join(out, video.slug, "corrected.json"), encoding="utf-8") as f:
        corrected = json.load(f)
    assert [s["id"] for s in raw["segments"]] == [s["id"] for s in corrected["segments"]] == list(range(len(raw["segments"])))
    assert [s["text"] for s in raw["segments"]] == [s["raw_text"] for s in corrected["segments"]]
