"""Access to tracks: by time, offset and place, inside, outside and over the bounds of spans; rates and ranges."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestar.operators import trajectory

T = datetime(2024, 1, 1)


def at(seconds):
    return T + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def track(spark):
    rows = [(1, at(10), 0.0), (1, at(20), 10.0), (1, at(40), 30.0), (2, at(0), 5.0)]
    return spark.createDataFrame(rows, "user long, ts timestamp, easting double").repartition(2)


def frames(spark, *rows):
    return spark.createDataFrame([(u, at(s)) for u, s in rows], "user long, ts timestamp")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_outside_is_dropped_clamped_or_an_error(spark, track):
    inside = [(1, 10), (1, 15), (1, 40), (2, 0)]
    want = [(1, 0.0), (1, 5.0), (1, 30.0), (2, 5.0)]
    for strict in (False, True):
        assert values(trajectory.interpolate(frames(spark, *inside), track, "user", ["easting"], strict=strict), "user", "easting") == want
    outside = frames(spark, *inside, (1, 9), (1, 41), (2, 1), (3, 5))
    assert values(trajectory.interpolate(outside, track, "user", ["easting"]), "user", "easting") == want
    assert values(trajectory.interpolate(outside, track, "user", ["easting"], clamp=True), "user", "easting") == sorted([*want, (1, 0.0), (1, 30.0), (2, 5.0)])
    for row in ((1, 9), (1, 41), (3, 5)):
        with pytest.raises(Exception, match="outside the track"):
            trajectory.interpolate(frames(spark, (1, 15), row), track, "user", ["easting"], strict=True).collect()


def test_offsets(spark, track):
    ask = lambda *rows: spark.createDataFrame(rows, "user long, seconds double")
    good = ask((1, 0.0), (1, 2.5), (1, 20.25), (1, 30.0), (2, 0.0))
    want = [(1, 0.0, 0.0), (1, 2.5, 2.5), (1, 20.25, 20.25), (1, 30.0, 30.0), (2, 0.0, 5.0)]
    assert values(trajectory.at_offset(good, track, "user", ["easting"]), "user", "seconds", "easting") == want
    bad = [((1, -0.1), "outside"), ((1, 30.1), "outside"), ((9, 0.0), "no track")]
    assert values(trajectory.at_offset(good.union(ask(*[r for r, _ in bad])), track, "user", ["easting"], strict=False), "user", "seconds", "easting") == want
    for row, message in bad:
        with pytest.raises(Exception, match=message):
            trajectory.at_offset(ask(row), track, "user", ["easting"]).collect()


def test_places(spark, track):
    ask = lambda *rows: spark.createDataFrame(rows, "user long, place long")
    good = ask((1, 0), (1, 2), (1, -1), (1, -3), (2, 0))
    want = [(1, -3, 0.0), (1, -1, 30.0), (1, 0, 0.0), (1, 2, 30.0), (2, 0, 5.0)]
    assert values(trajectory.at_index(good, track, "user"), "user", "place", "easting") == want
    bad = [(1, 3), (1, -4), (2, 1), (9, 0)]
    assert values(trajectory.at_index(good.union(ask(*bad)), track, "user", strict=False), "user", "place", "easting") == want
    for row in bad:
        with pytest.raises(Exception, match="outside the track"):
            trajectory.at_index(ask(row), track, "user").collect()


@pytest.mark.parametrize("span", [1, 7_000_000, 10**15])
def test_spans_change_nothing(spark, span):
    """Tracks with gaps of many spans, frames in spans without a row of the track."""
    rng = np.random.default_rng(1)
    rows = [(u, int(s), float(s)) for u in (1, 2, 3) for s in sorted(rng.choice(400, 25, replace=False))]
    asked = [(u, int(s)) for u in (1, 2, 3, 4) for s in rng.integers(-20, 420, 40)]
    t = spark.createDataFrame([(u, at(s), e) for u, s, e in rows], "user long, ts timestamp, easting double")
    got = values(trajectory.bracketed(frames(spark, *asked), t, "user", ["easting"], span).na.fill(-1.0), "user", "ts", "p_easting", "n_easting")
    want = []
    for u, s in asked:
        mine = [x for v, x, _ in rows if v == u]
        want.append((u, at(s), float(max([x for x in mine if x <= s], default=-1)), float(min([x for x in mine if x >= s], default=-1))))
    assert got == sorted(want)


def test_rates(spark):
    rows = [(1, at(i / 10)) for i in range(60)] + [(2, at(i / 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "user long, ts timestamp")
    one = df.where("user = 1")
    assert trajectory.selected(df, "user").count() == 72
    picked = sorted(r.ts for r in trajectory.selected(one, "user", 5.0).collect())
    want = []
    for block in range(6):
        for i in range(1, 5):
            target = at(block + i / 5)
            later = [t for _, t in rows[:60] if t > target]
            want += later[:1]
    assert picked == want
    for hz in (11.0, 60 / 5.9 + 0.01):
        with pytest.raises(Exception, match="rate"):
            trajectory.selected(one, "user", hz).collect()
    with pytest.raises(Exception, match="rate"):  # the slower track has 4.4 rows a second
        trajectory.selected(df, "user", 5.0).collect()
    with pytest.raises(ValueError, match="no rate"):
        trajectory.selected(df, "user", 0)


def test_look_back_only_inside_the_track(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(9.8)), (1, at(10)), (1, at(12)), (2, at(9.8)), (2, at(10)), (3, at(9.75)), (3, at(11)), (1, at(13.1))], "user long, ts timestamp")
    got = values(trajectory.time_range(df, "user", str(at(10)), str(at(13))), "user", "ts")
    assert got == [(1, at(9.8)), (1, at(10)), (1, at(12)), (2, at(10)), (3, at(9.75)), (3, at(11))]
    assert values(trajectory.selected(df, "user", -1, None, str(at(9.9))), "user", "ts") == [(1, at(0)), (1, at(9.8)), (2, at(9.8)), (3, at(9.75))]
    assert values(trajectory.selected(df, "user", -1, str(at(12)), None), "user", "ts") == [(1, at(12)), (1, at(13.1))]
