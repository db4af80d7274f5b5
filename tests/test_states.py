import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.functions import boxes
from courtline.operators import folds, lookback, states

SQUARE = np.array([[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.4]])


def test_a_large_drift_is_adopted_within_two_frames():
    s = states.QuadSmoother()
    assert np.allclose(s.step(SQUARE), SQUARE)
    first = s.step(SQUARE + 0.2)  # the average moved by a quarter of it
    assert np.allclose(first, SQUARE + 0.025)
    assert np.allclose(s.step(None), SQUARE + 0.05)


def test_jitter_is_held_and_nothing_shows_before_the_first_quad():
    s = states.QuadSmoother()
    assert s.step(None) is None
    s.step(SQUARE)
    for k in range(6):
        assert np.allclose(s.step(SQUARE + 0.004 * (-1) ** k), SQUARE)


def test_a_lasting_drift_waits_for_three_frames():
    s = states.QuadSmoother(alpha=1.0)
    s.step(SQUARE)
    moved = SQUARE + [0.015, 0]
    assert np.allclose(s.step(moved), SQUARE)
    assert np.allclose(s.step(None), SQUARE)
    assert np.allclose(s.step(moved), SQUARE)
    assert np.allclose(s.step(moved), SQUARE + [0.015 / 8, 0])


def test_hoop_holds_rejects_a_jump_and_follows_the_ball():
    h = states.ActiveHoop([0.25, 0.75])
    assert h.step(0.2, 0.26) == (0, 0.26)
    assert h.step(0.2, 0.45) == (0, 0.26)  # too far on its side
    assert h.step(None, None) == (0, 0.25)  # held for a ball that is seen only
    assert h.step(0.2, None) == (0, 0.26)
    assert h.step(0.8, None) == (1, 0.75)
    assert h.step(0.2, 0.74) == (1, 0.74)  # a hoop on the other side than the ball counts
    assert h.step(None, None) == (1, 0.75)
    limited = states.ActiveHoop([0.25, 0.75], hold=1)
    assert [limited.step(0.2, x)[1] for x in (0.3, None, None, None)] == [0.3, 0.3, 0.25, 0.3]
    sides = states.ActiveHoop([0.25, 0.75], hold=1)
    assert [sides.step(*x)[1] for x in ((0.2, 0.3), (0.8, 0.7), (0.2, None), (0.8, None), (0.2, None))] == [0.3, 0.7, 0.3, 0.7, 0.25]


def test_a_ball_in_flight_is_predicted_longer():
    hoop = (0.5, 0.3, 0.1, 0.1)
    far, near = folds.Kalman(), folds.Kalman()
    for k in (far, near):
        k.step((0.5, 0.35))
    assert [far.step(None)[2] for _ in range(9)] == [True] * 8 + [False]
    assert [near.step(None, hoop)[2] for _ in range(21)] == [True] * 20 + [False]


def test_merging_fragments():
    def row(i, t0, t1, x=0.0, team=None, jersey=None, **more):
        return {"track_id": i, "t0": t0, "x0": x, "y0": 0.0, "t1": t1, "x1": x, "y1": 0.0, "team": team, "jersey": jersey, **more}

    assert folds.merge_fragments([row(1, 0, 1), row(2, 2, 3, team="home"), row(3, 4, 5, team="away")]) == {1: 1, 2: 1, 3: 3}
    assert folds.merge_fragments([row(1, 0, 1), row(2, 2, 3, x=11.0)]) == {1: 1, 2: 2}  # too far
    assert folds.merge_fragments([row(1, 0, 1), row(2, 1.5, 3, x=5.0)]) == {1: 1, 2: 2}  # too fast
    assert folds.merge_fragments([row(1, 0, 1, jersey="7"), row(2, 0, 1.5), row(3, 2, 3, jersey="7")]) == {1: 1, 2: 2, 3: 1}  # numbers first
    assert folds.merge_fragments([row(1, 0, 1, red=0, green=0, blue=0), row(2, 2, 3, red=200, green=0, blue=0)]) == {1: 1, 2: 2}
    assert folds.merge_fragments([row(1, 0, 1), row(2, 10, 11)]) == {1: 1, 2: 2}  # too late


def test_clocks_are_bridged_and_held():
    times = [float(k) for k in range(12)]
    read = [[600], [599], [598], [], [596, 100], [], [594], [593], [592], [], [], []]
    assert folds.countdown(times, read) == [600, 599, 598, 597, 596, 595, 594, 593, 592, 592, 592, None]


def test_gated_ball_relocks_and_gives_up():
    k = states.GatedBall(misses=1)
    assert k.step(None, 0.1) is None
    assert k.step((0.5, 0.5), 0.1) == (0.5, 0.5, False)
    assert k.step((0.9, 0.9), 0.1) == (0.9, 0.9, False)
    assert k.step(None, 0.1)[2]
    assert k.step(None, 0.1) is None


def test_names_of_clusters():
    assert lookback.match_names([(1, 0, "a"), (2, 0, "b"), (1, 1, "a"), (9, 1, "b")]) == {0: "b", 1: "a"}
    assert lookback.match_names([(1, 0, "a"), (2, 1, "a"), (3, 2, "a")]) == {0: "a", 1: "a", 2: "a"}


@pytest.mark.parametrize(("segment", "want"), [((-1, 0.5, 1, 0.5), (0.5, 1)), ((2, 2, 3, 3), (None, None)), ((0.5, -1, 0.5, 2), (1 / 3, 2 / 3)), ((1.5, 0, 1.5, 1), (None, None))])
def test_clip(spark, segment, want):
    got = spark.range(1).select(*boxes.clip_segment(*[F.lit(float(v)) for v in segment])).first()
    assert tuple(got) == pytest.approx(want) if want[0] is not None else tuple(got) == want


def test_torso_box_needs_three_sure_points(spark):
    at = {5: (10, 10), 6: (30, 10), 11: (12, 60), 12: (28, 60)}
    pose = [(float(at.get(i, (0, 0))[0]), float(at.get(i, (0, 0))[1]), 0.9 if i in at else 0.0) for i in range(17)]
    weak = [(x, y, 0.1 if i in (5, 6) else c) for i, (x, y, c) in enumerate(pose)]
    rows = spark.createDataFrame([(pose,), (weak,)], "k array<struct<x:double,y:double,conf:double>>").select(boxes.torso_box(F.col("k")).alias("b")).collect()
    assert tuple(rows[0].b) == pytest.approx((10 - 2.4, 10 - 2.1, 30 + 2.4, 60 + 0.9))
    assert rows[1].b is None


def test_attempt_confidence(spark):
    got = spark.range(1).select(boxes.attempt_confidence(F.lit(0.04), F.lit(True), F.lit(False), F.lit(0.5), F.lit(1.0)).alias("c")).first().c
    assert got == pytest.approx(0.3 * 0.5 + 0.7 * (0.3 + 0.1 + 0.2))
