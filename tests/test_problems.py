"""The core's data-preparation operators against brute force, and their edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators.bitemporal import Front, known_at
from panelweave.operators.intervals import FAR_END, interval_gaps, merge_intervals, periods_and_gaps
from panelweave.operators.regular_grid import counter_grid, gauge_grid, reading_gaps
from panelweave.operators.rolling import trailing_totals

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_front_rectangles_are_disjoint_and_complete():
    rng = random.Random(5)
    for _ in range(200):
        front, owner, rows = Front(), {}, [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 9))]
        for k, (v, r) in enumerate(rows):
            for v0, v1, r0, r1 in front.uncovered(v, r):
                for a in range(v0, min(v1, 15)):
                    for b in range(r0, min(r1, 15)):
                        assert (a, b) not in owner
                        owner[a, b] = k
            front.add(v, r)
        for a in range(15):
            for b in range(15):
                want = next((k for k, (v, r) in enumerate(rows) if v <= a and r <= b), None)
                assert owner.get((a, b)) == want


def as_known(versions, events):
    out = set()
    for e, t in events:
        known = [(d, a, g) for x, d, a, g in versions if x == e and None not in (e, t, d, a) and a <= t]
        if known:
            best = max(known, key=lambda k: (k[0], k[1], [-ord(c) for c in k[2]]))
            out.add((e, t, best[2], best[0], best[1]))
    return out


def test_known_at_matches_brute_force(spark):
    rng = random.Random(3)
    versions = [(rng.randrange(4), day(rng.randrange(0, 9000, 90)), None, rng.choice("abc")) for _ in range(300)]
    versions = [(e, d, d + dt.timedelta(days=rng.randrange(-40, 900)), g) for e, d, _, g in versions]
    versions += versions[:20] + [(None, day(3), day(5), "a"), (1, None, day(5), "a"), (1, day(3), None, "a")]
    events = [(rng.randrange(5), day(rng.randrange(0, 10000))) for _ in range(400)] + [(None, day(1)), (1, None)]
    v = spark.createDataFrame(versions, "e int, d date, a date, g string")
    ev = spark.createDataFrame(sorted(set(events), key=str), "e int, t date")
    rank = [(F.col("d"), True), (F.col("a"), True), (F.col("g"), False)]
    got = {tuple(r) for r in known_at(ev, v, "e", "t", "d", "a", rank, ["g", "d", "a"]).select("e", "t", "g", "d", "a").collect()}
    assert got == as_known(versions, set(events))


def test_known_at_empty(spark):
    v, ev = spark.createDataFrame([], "e int, d date, a date, g string"), spark.createDataFrame([(1, DAY)], "e int, t date")
    rank = [(F.col("d"), True), (F.col("a"), True), (F.col("g"), False)]
    assert known_at(ev, v, "e", "t", "d", "a", rank, ["g"]).count() == 0
    assert known_at(ev.limit(0), v, "e", "t", "d", "a", rank, ["g"]).count() == 0


def test_trailing_totals_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, float("nan"), rng.random()])) for k in ("a", "b") for i in sorted(rng.sample(range(-700, 2000), 60))] + [("c", 7, 1.0), (None, 3, 1.0), ("d", None, 1.0)]
    got = {(r.k, r.i): r for r in trailing_totals(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v", [7, 30], block=64).collect()}
    for k in ("a", "b", "c"):
        own = {i: 0.0 if v is None or v != v else v for kk, i, v in rows if kk == k}
        span = range(min(own), max(own) + 1)
        assert sum(x == k for x, _ in got) == len(span)
        for i in span:
            for n in (7, 30):
                want = sum(own.get(j, 0.0) for j in range(i - n + 1, i + 1))
                assert got[k, i][f"total_{n}"] == pytest.approx(want, abs=1e-9)
                assert got[k, i][f"average_{n}"] == pytest.approx(want / n, abs=1e-9)
    assert {x for x, _ in got} == {"a", "b", "c"}


def test_trailing_totals_empty(spark):
    assert trailing_totals(spark.createDataFrame([], "k string, i long, v double"), "k", "i", "v", [7]).count() == 0


def test_intervals_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), "x", day(a := rng.randrange(300)), day(a + rng.randrange(-3, 25)), 9) for _ in range(90)]
    rows += rows[:5] + [(7, "x", day(1), None, 9), (7, "x", None, day(4), 9), (None, "x", day(1), day(4), 9), (8, "x", day(5), day(4), 9)]
    df = spark.createDataFrame(rows, "k int, g string, s date, e date, start_date int")
    got = {tuple(r) for r in periods_and_gaps(df, ["k", "g"], "s", "e").select("span_kind", "k", "start_date", "end_date").collect()}
    want = set()
    for k in (0, 1, 2):
        days = sorted({d for kk, _, s, e, _ in rows if kk == k and s <= e for d in range((s - DAY).days, (e - DAY).days + 1)})
        runs = []
        for d in days:
            if runs and runs[-1][1] == d - 1:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        want |= {("period", k, day(a), day(b)) for a, b in runs}
        want |= {("gap", k, day(x[1] + 1), day(y[0] - 1)) for x, y in zip(runs, runs[1:])}
    want.add(("period", 7, day(1), dt.date.fromisoformat(FAR_END)))
    assert got == want
    p = merge_intervals(df, ["k", "g"], "s", "e")
    assert interval_gaps(p, ["k", "g"]).count() == sum(w[0] == "gap" for w in want)
    assert periods_and_gaps(df.limit(0), ["k", "g"], "s", "e").count() == 0


def test_reading_gaps(spark):
    rows = [(1, 12, 1.0), (1, 13, 1.0), (1, 41, 1.0), (2, 390, 1.0), (None, 3, 1.0), (3, None, 1.0), (4, 0, 1.0), (4, 390, 1.0)]
    df = spark.createDataFrame(rows, "s int, t int, v double")
    got = {tuple(r) for r in reading_gaps(df, ["s"], "t", 10, 5, also_occupied=F.col("t") == 390).collect()}
    want = {(1, c, -1) for c in (0, 1)} | {(1, c, 13) for c in range(3, 8)} | {(1, 9, 41)} | {(4, c, 0) for c in range(1, 9)}
    assert got == want
    assert reading_gaps(df.limit(0), ["s"], "t", 10, 5).count() == 0


def test_gauge_grid_fills_marks_and_closes(spark):
    rows = [(1, 7, 9.0, 10.0, 1), (1, 7, 9.0, 11.0, 2), (1, 8, 9.0, 12.0, 1), (1, 25, 9.0, float("nan"), 1), (1, 30, 77.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "s int, t int, o double, c double, k int")
    got = [tuple(r) for r in gauge_grid(df, ["s"], "t", 6, 5, "o", "c", "k", ("o", 30)).orderBy("slot_no").collect()]
    assert got == [(1, 0, 9.0, "leading", -1), (1, 1, 12.0, "observed", -1), (1, 2, 12.0, "filled", 8), (1, 3, 12.0, "filled", 8), (1, 4, 12.0, "filled", 8), (1, 5, 77.0, "auction", 8)]


def test_counter_grid_resets_and_spreads(spark):
    rows = [(1, 0.0, 10.0), (1, 10.0, 30.0), (1, 12.0, 4.0), (1, 12.0, None), (2, 3.0, 5.0)]
    got = {(r.s, r.slot_no): r for r in counter_grid(spark.createDataFrame(rows, "s int, t double, c double"), ["s"], "t", "c", 4, 5).collect()}
    assert [got[1, i].increment for i in range(3)] == pytest.approx([10.0, 10.0, 4.0])
    assert [got[1, i].covered for i in range(4)] == pytest.approx([1.0, 1.0, 0.4, 0.0])
    assert got[1, 3].increment is None and all(got[2, i].covered == 0 for i in range(4))
    assert np.isclose(sum(got[1, i].increment or 0 for i in range(4)), 24.0)


def test_counter_grid_against_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for s in range(12):
        times = sorted(rng.sample(range(1, 60), rng.randrange(1, 12)))
        level = 0.0
        values = []
        for _ in times:
            level = rng.random() * 5 if rng.random() < 0.3 else level + rng.random() * 9
            values.append(level)
        reach, before, at = 4, 0.0, 0
        per = [[0.0, 0.0, 0] for _ in range(12)]
        for t, c in zip(times, values):
            gain = c if c < before else c - before
            lo = max(at, t - reach)
            for u in range(lo, t):
                per[u // 5][0] += gain / (t - lo)
                per[u // 5][1] += 1 / 5
            before, at = c, t
        for k in range(12):
            per[k][2] = max([0] + [t for t in times if t <= k * 5])
            want[s, k] = per[k]
        rows += [(s, float(t), c) for t, c in zip(times, values)]
    df = spark.createDataFrame(rows + rows[:7] + [(None, 1.0, 1.0), (50, None, 1.0), (51, 2.0, None), (52, 2.0, float("nan"))], "s int, t double, increment double")
    got = {(r.s, r.slot_no): r for r in counter_grid(df, ["s"], "t", "increment", 12, 5, start=0, reach=4).collect()}
    assert got.keys() == want.keys()
    for key, (x, c, last) in want.items():
        assert got[key].covered == pytest.approx(c) and (got[key].increment or 0.0) == pytest.approx(x) and got[key].last_time == last
        assert (got[key].increment is None) == (c == 0)
    assert counter_grid(df.limit(0), ["s"], "t", "increment", 12, 5).count() == 0


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from panelweave import session

    assert session.at_most(spark.range(5), 5) and not session.at_most(spark.range(6), 5)
    kept = session.stored(spark.range(9).withColumn("x", F.lit("a")), "id")
    assert kept.where("id < 3").count() == 3 and kept.inputFiles()[0].startswith("file:")
    class Bare:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc
        getConf = lambda self: {}
    class Session:
        sparkContext = Bare()
    defined = type("D", (), {"isDefined": lambda self: False})
    Bare._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: defined()})()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
