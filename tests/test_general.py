"""Intervals, incremental work and control charts against brute force, on awkward tables."""

import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import control_chart, incremental, intervals

SPAN = "video_id bigint, window_index int, start_s double, end_s double, gap_from_ms string"


def brute_union(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_blocks_reassemble_intervals():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        spans = [(s := rng.randint(0, 200), s + rng.randint(1, 40)) for _ in range(n)]
        groups = [rng.randint(0, 2) for _ in range(n)]
        g, s, e = intervals.union_of(np.array(groups), np.array([x[0] for x in spans]), np.array([x[1] for x in spans]))
        want = [[k, *x] for k in sorted(set(groups)) for x in brute_union([y for y, h in zip(spans, groups) if h == k])]
        assert np.stack([g, s, e], 1).tolist() == want


def test_siblings_merge_upward():
    g, s, k = intervals.dyadic_blocks(np.array([0, 0]), np.array([0, 2]), np.array([2, 4]))
    assert sorted(k.tolist()) == [1, 1]
    g, s, k = intervals.merge_siblings(g, s, k)
    assert (s.tolist(), k.tolist()) == ([0], [2])


def test_gaps_and_periods(spark):
    rng = random.Random(2)
    cell = (1 << intervals.CELL_BITS) / 1000
    rows = []
    for v in (1, 2, None):
        for w in (0, None):
            for _ in range(120):
                s = rng.choice([rng.uniform(0, 30), cell - 5 + rng.uniform(0, 10), 3 * cell + rng.uniform(-3, 3)])
                rows.append((v, w, round(s, 3), round(s + rng.choice([-1, 0, 0.001, 0.2, 1.5]), 3), "clash"))
    rows += [(1, 0, 0.0, 2.5 * cell, "long")] * 3
    rows += [(9, 0, None, 1.0, ""), (9, 0, 1.0, float("nan"), ""), (9, 0, float("inf"), 1.0, ""), (9, 0, 2.0, 1.0, ""), (8, 1, -2.0, -1.0, ""), (8, 1, 1.0, 2.0, "")]
    df = spark.createDataFrame(rows, SPAN)
    want_gaps, want_periods = set(), set()
    for key in {r[:2] for r in rows}:
        spans = [(round(r[2] * 1000), round(r[3] * 1000)) for r in rows if r[:2] == key and r[2] is not None and r[3] is not None and np.isfinite([r[2], r[3]]).all() and r[3] > r[2]]
        u = brute_union(spans)
        want_periods |= {(*key, *x) for x in map(tuple, u)}
        want_gaps |= {(*key, a[1], b[0]) for a, b in zip(u, u[1:])}
    got = [tuple(r) for r in intervals.gaps(df, ["video_id", "window_index"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want_gaps
    got = [tuple(r) for r in intervals.periods(df, ["video_id", "window_index"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want_periods
    assert intervals.gaps(df.limit(0), ["video_id", "window_index"]).count() == 0


SCANS = "run_id bigint, video_id bigint, size_bytes bigint, mtime double, status string, seen_at timestamp, extra string"


def brute_work(scans, outcome):
    seen = {}
    for r in scans:
        seen[r[0], r[1]] = r
    out = set()
    for (run, video), r in seen.items():
        if r[2] is None or r[3] is None:
            continue
        done = [x for (n, v), x in seen.items() if v == video and n < run and outcome.get(n) == "succeeded" and x[2] is not None and x[3] is not None and x[4] in incremental.DONE]
        last = max(done, key=lambda x: x[0], default=None)
        if last is None or last[2] != r[2] or abs(last[3] - r[3]) > 1e-4:
            out.add((run, video))
    return out


def test_work_lists_and_what_is_remade(spark, tmp_path):
    import datetime as dt

    rng = random.Random(3)
    at = dt.datetime(2031, 1, 1)
    outcome = {1: "succeeded", 2: "failed", 3: "succeeded", 4: "aborted", 5: "succeeded"}
    scans = []
    for v in range(40):
        size, mtime = 100 + v, 1000.0 + v
        for run in outcome:
            if rng.random() < 0.15:
                continue
            if rng.random() < 0.3:
                size += 1
            if rng.random() < 0.2:
                mtime += 1.0
            bad = rng.random() < 0.1
            scans.append((run, v, None if bad else size, None if rng.random() < 0.05 else mtime + rng.uniform(-4e-5, 4e-5), rng.choice(["COMPLETED", "FAILED", "NEEDS_REVIEW", None]), at, "x"))
    copies = scans + scans[:20]
    runs = spark.createDataFrame([(k, v) for k, v in outcome.items()], "run_id bigint, outcome string")
    path = str(tmp_path / "view")
    got = incremental.work_lists(spark, spark.createDataFrame(copies, SCANS), runs, path)
    assert {tuple(r) for r in got.collect()} == brute_work(scans, outcome) and got.count() == len(brute_work(scans, outcome))

    def refreshed(rows, runs=runs):
        lists = incremental.WorkLists(spark, path + "2", spark.createDataFrame(rows, SCANS), runs)
        return lists.refresh(), {tuple(r) for r in lists.read().collect()}

    everything = len(refreshed(copies)[0])
    assert everything > len(outcome)
    assert refreshed(copies) == ([], brute_work(scans, outcome))
    # a sighting of the last run concerns no other partition
    at_end = next(r for r in scans if r[0] == 5)
    changed = [(r[0], r[1], (r[2] or 0) + 5, *r[3:]) if r[:2] == at_end[:2] else r for r in copies]
    remade, got = refreshed(changed)
    assert len(remade) == 1 and remade[0][0] == 5 and got == brute_work(list(dict.fromkeys(changed)), outcome)
    # rows that are gone leave no results behind
    left = [r for r in changed if r[1] != at_end[1]]
    remade, got = refreshed(left)
    assert len({r[1] for r in remade}) == 1 and got == brute_work(list(dict.fromkeys(left)), outcome)
    # a late sighting that ended nothing concerns its own run alone, one that ended a video's work the later ones too
    late = [(4, 39, 777, 5.0, "COMPLETED", at, "x")]
    remade, got = refreshed([r for r in left if r[:2] != (4, 39)] + late)
    assert {r[0] for r in remade} <= {4}
    left = [r for r in left if r[:2] not in ((4, 39), (3, 38))] + late + [(3, 38, 778, 5.0, "COMPLETED", at, "x")]
    remade, got = refreshed(left)
    assert {r[0] for r in remade} <= {3, 4, 5} and len({r[1] for r in remade}) == 1 and got == brute_work(list(dict.fromkeys(left)), outcome)
    # one more run, with one video changed, adds its partition and remakes none, whatever becomes of it
    new = left + [(6, 7, 999, 1.0, "COMPLETED", at, "x")]
    for end in ("aborted", "succeeded"):
        outcome[6] = end
        remade, got = refreshed(new, spark.createDataFrame(list(outcome.items()), "run_id bigint, outcome string"))
        assert [r[0] for r in remade] == ([6] if end == "aborted" else []) and got == brute_work(list(dict.fromkeys(new)), outcome)


def test_a_lost_partition_is_made_again(spark, tmp_path):
    import glob
    import shutil

    rows = [(1, v, 10, 1.0, "COMPLETED", None, "") for v in range(20)]
    runs = spark.createDataFrame([(1, "succeeded")], "run_id bigint, outcome string")
    lists = incremental.WorkLists(spark, str(tmp_path / "v"), spark.createDataFrame(rows, SCANS), runs)
    lists.refresh()
    shutil.rmtree(glob.glob(str(tmp_path / "v" / "*" / "run_id=*" / "bucket=*"))[0])
    assert len(lists.refresh()) == 1
    assert lists.read().count() == 20


def test_a_refresh_that_dies_before_it_commits_is_made_again(spark, tmp_path):
    rows = [(1, v, 10, 1.0, "COMPLETED", None, "") for v in range(20)]
    runs = spark.createDataFrame([(1, "succeeded")], "run_id bigint, outcome string")
    lists = incremental.WorkLists(spark, str(tmp_path / "v"), spark.createDataFrame(rows, SCANS), runs)
    lists.refresh()
    more = incremental.WorkLists(spark, str(tmp_path / "v"), spark.createDataFrame(rows + [(2, v, 11, 1.0, "COMPLETED", None, "") for v in range(20)], SCANS), runs)
    broken = F.udf(lambda v: 1 // 0, "bigint")
    with pytest.raises(Exception, match="division"):  # the tasks die while they write
        more.view.refresh(more.marks(), lambda wanted: more.compute(wanted).withColumn("video_id", broken("video_id")))
    assert lists.read().count() == 20
    assert {r[0] for r in more.refresh()} == {2} and more.read().count() == 40 and more.refresh() == []


def test_refreshes_of_one_view_wait_for_each_other(spark, tmp_path, monkeypatch):
    import threading

    monkeypatch.setattr(incremental, "STALE_S", 2.0)
    view = incremental.PartitionedView(spark, str(tmp_path / "v"), incremental.WORK_SCHEMA, ["run_id"])
    order = []

    def second():
        with view.locked():
            order.append("second")

    with view.locked():
        t = threading.Thread(target=second)
        t.start()
        t.join(1.5)
        order.append("first")
    t.join()
    assert order == ["first", "second"]
    fs, p = view._at(view.path + ".lock")
    fs.createNewFile(p)  # its holder died
    fs.setTimes(p, 1000, -1)
    with view.locked():
        order.append("third")
    assert not fs.exists(p) and order[-1] == "third"


def test_work_of_nothing(spark, tmp_path):
    runs = spark.createDataFrame([], "run_id bigint, outcome string")
    assert incremental.work_lists(spark, spark.createDataFrame([], SCANS), runs, str(tmp_path / "v")).count() == 0


SCORES = "video_id bigint, id bigint, avg_logprob double, no_speech_prob double, compression_ratio double, chunk string, field string"


def test_unbelievable_readings(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for v, n in ((1, 2600), (2, 60)):
        x = rng.normal(-0.3, 0.03, n)
        for at in (20, 50, 1023, 1024, 2047, 2500):
            if at < n:
                x[at] = -1.5
                want.add((v, at, "avg_logprob", "spike"))
        stuck = range(1018, 1032) if n > 2000 else range(30, 40)
        x[list(stuck)] = -0.3111
        want |= {(v, i, "avg_logprob", "stuck") for i in stuck}
        want -= {(v, i, "avg_logprob", "spike") for i in stuck}
        x[10], x[11] = 0.5, np.inf
        want |= {(v, 10, "avg_logprob", "impossible"), (v, 11, "avg_logprob", "impossible")}
        for i in range(n):
            p = 0.1 + 0.01 * rng.standard_normal()
            rows.append((v, i, float(x[i]), float(p), None, "clash", "clash"))
    # nine equal readings, then a missing id, are no run
    rows += [(3, i, -0.2, 0.1 + i / 1000, 1.0 + i / 100, "", "") for i in range(15) if i != 9]
    rows += [(4, 1, float("nan"), 1.5, 0.0, "", ""), (None, 1, 5.0, 5.0, 5.0, "", "")]
    want |= {(4, 1, "avg_logprob", "impossible"), (4, 1, "no_speech_prob", "impossible"), (4, 1, "compression_ratio", "impossible")}
    df = spark.createDataFrame(rows + rows[:100], SCORES)
    got = {(r.video_id, r.seg_id, r.field, r.reason) for r in control_chart.unbelievable(df).collect()}
    assert got == want
    assert control_chart.unbelievable(df.limit(0)).count() == 0


def test_charts_don_t_learn_spikes():
    x = np.full((400, 1), 1.0) + np.random.default_rng(5).normal(0, 0.01, (400, 1))
    x[100:110] += 1.0
    hit = control_chart.charts(x, np.array([1.0]), np.array([0.01]))
    assert hit[100:110].all() and hit.sum() < 80  # and what follows while the chart comes back


def test_charts_tell_calm_series_from_others():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (3000, 20))
    level, spread = np.zeros(20), np.ones(20)
    assert control_chart.charts(x, level, spread).mean() < 0.02
    drifting = x + np.linspace(0, 30, 3000)[:, None]
    assert control_chart.charts(drifting, level, spread)[-500:].mean() > 0.95  # the chart's own mean has left the level
    wide = x * np.where(np.arange(3000) < 1500, 1, 6)[:, None]
    assert control_chart.charts(wide, level, spread)[2000:].mean() > 0.95
    # one that starts far from its level takes its time to come in
    assert control_chart.charts(x[:500], level + 20, spread)[:20].all()


def test_without_charts_no_spike_is_found(spark):
    rng = np.random.default_rng(7)
    rows = [(1, i, float(rng.normal(-1, 0.05)) if i % 100 else -3.0, None, None, "", "") for i in range(1500)]
    df = spark.createDataFrame(rows, SCORES)
    count = lambda *limits: control_chart.unbelievable(df, limits=limits or control_chart.LIMITS).where("reason = 'spike'").count()
    off = float("inf")
    assert count() == 15
    assert count(4.0, off, off) == 15
    assert 0 <= count(off, 2.0, 1.5) < 15  # these only tell of spikes once the chart has moved
    assert count(off, off, off) == 0


def test_charts_run_only_where_they_tell(monkeypatch):
    """Charts of LIMITS leave out no reading beyond eight spreads, so none run by default; wider ones leave out some."""
    rng = np.random.default_rng(10)
    n = control_chart.CHUNK
    x = np.concatenate([rng.normal(-3, 0.1, 600), rng.normal(-3, 0.1, 200) - np.linspace(0, 2, 200), rng.normal(-3, 0.6, n - 800)])
    x[rng.integers(0, n, 30)] -= 3
    away = np.abs(x - np.median(x))
    spread = control_chart.SIGMA_OF_MAD * np.median(away)
    want = {int(i) for i in np.flatnonzero((away > 8 * spread) & (x <= 0))}
    name, *others = [r.name for r in control_chart.READINGS]
    cells = {"video_id": pa.array([1] * (n + 1)), "chunk": pa.array([0] * (n + 1)), "id": pa.array([None, *range(n)], "int64"), name: pa.array([None, *x], "float64")}
    cells |= {c: pa.array([None] * (n + 1), "float64") for c in others}
    cells |= {f"{c}_{k}": pa.array([v] + [None] * n, "float64") for c in (name, *others) for k, v in (("level", float(np.median(x))), ("spread", float(spread)))}

    def spikes(limits):
        out = pa.Table.from_batches(control_chart._flag(control_chart.READINGS, limits)([pa.RecordBatch.from_pydict(cells)]))
        return {r["seg_id"] for r in out.to_pylist() if r["reason"] == "spike"}

    assert spikes(control_chart.LIMITS) == want and len(want) > 50
    assert set() < spikes((12.0, 16.0, 8.0)) < want

    def never(*_):
        raise AssertionError("a chart ran")

    monkeypatch.setattr(control_chart, "charts", never)
    assert spikes(inspect.signature(control_chart.unbelievable).parameters["limits"].default) == want


def test_medians_are_exact(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        n = rng.choice([1, 2, 3, 10, 301, 1000])
        pool = rng.choice([lambda: rng.gauss(0, 1), lambda: rng.choice([-1.5, 0.0, 0.25]), lambda: 2.0 ** rng.randint(-60, 60), lambda: 0.3 + rng.random() * 1e-9, lambda: -rng.random()])
        rows += [(k, float(pool()), rng.choice([1, 1, 3])) for _ in range(n)]
    got = {r.k: r.median for r in control_chart.weighted_median(spark.createDataFrame(rows, "k int, x double, n bigint"), ["k"], "x").collect()}
    want = {k: float(np.median([x for j, x, n in rows if j == k for _ in range(n)])) for k in range(40)}
    assert got == want


def test_a_hot_source_loses_no_reading(spark):
    rng = np.random.default_rng(9)
    part = np.repeat(rng.normal(-0.5, 0.2, 20), 300)  # a source put together of unlike ones
    x = part + rng.normal(0, 0.02, len(part))
    x[rng.integers(0, len(x), 200)] -= 4
    rows = [(1, i, float(v), None, None, "", "") for i, v in enumerate(x)] + [(2 + i // 50, i % 50, float(v), None, None, "", "") for i, v in enumerate(rng.normal(-0.5, 0.1, 1000))]
    got = {(r.video_id, r.seg_id) for r in control_chart.unbelievable(spark.createDataFrame(rows + rows[::7], SCORES)).where("reason = 'spike'").collect()}
    want = set()
    for v in {r[0] for r in rows}:
        mine = np.array([r[2] for r in rows if r[0] == v])
        away = np.abs(mine - np.median(mine))
        want |= {(v, int(i)) for i in np.flatnonzero((away > 8 * control_chart.SIGMA_OF_MAD * np.median(away)) & (mine <= 0))}
    assert got == want and len(want) > 150


def test_row_hashes_add(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    a = incremental.fingerprints(df.withColumn("part", F.lit(0)), "part").collect()
    b = incremental.fingerprints(df.repartition(3).withColumn("part", F.lit(0)), "part").collect()
    assert a == b and a[0].fp_rows == 10
