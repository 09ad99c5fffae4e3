"""Markdown keeps what is spoken at unknown times."""

from lectern.sinks import render


def test_lines_without_times_stay(spark):
    rows = [(1, 0, 0.0, 4.0, "a", False), (1, 1, None, 6.0, "b", False), (1, 2, 6.0, None, "c", True), (1, 3, None, None, "d", True), (1, 4, None, None, "e", False)]
    seg = spark.createDataFrame(rows, "video_id bigint, id bigint, start_s double, end_s double, text string, needs_review boolean")
    head = spark.createDataFrame([(1, "s", "v.mp4", 9.0, "m", None)], "video_id bigint, slug string, filename string, duration_seconds double, model string, language string")
    body = render.markdown(seg, head).first().content.split("## Transcript\n\n")[1]
    assert body == "[00:00:00 - 00:00:04]\na\n\n[- 00:00:06]\nb\n\n[00:00:06 -] <!-- needs_review -->\nc\n\n<!-- needs_review -->\nd\n\ne\n"
    assert render.markdown(seg, head, timed_only=True).first().n_cues == 1
