import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.functions import geometry, text
from courtline.operators import folds, matching


def one(spark, expr, **values):
    row = spark.createDataFrame([values]).select(expr.alias("x")).first()
    return row.x


@pytest.mark.parametrize(("raw", "want"), [("9:58", [598]), ("958", [598]), ("O:5S", [55]), ("20:00", []), ("12345", [34 * 0 + 1 * 60 + 34, 105, 754]), ("", []), ("7", [])])
def test_clock_candidates(spark, raw, want):
    assert one(spark, text.clock_candidates(F.col("r")), r=raw) == want


def test_polygon(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert one(spark, geometry.in_polygon(F.col("x"), F.col("y"), square), x=0.5, y=0.5)
    assert not one(spark, geometry.in_polygon(F.col("x"), F.col("y"), square), x=1.5, y=0.5)
    assert one(spark, geometry.in_polygon(F.col("x"), F.col("y"), []), x=9.0, y=9.0)


def test_homography_of_four_points():
    source, h = [(0, 0), (1, 0), (1, 1), (0, 1)], np.array([[2, 0.1, 3], [0.2, 1.5, -1], [0.01, 0.02, 1]])
    target = [tuple((p := h @ [x, y, 1])[:2] / p[2]) for x, y in source]
    assert np.allclose(geometry.solve_homography(source, target), h.ravel(), atol=1e-9)


def test_rearm_waits_for_the_ball_to_fall():
    state = folds.Rearm(0.25)
    assert state.step(0, 0.26, True, True)
    assert not state.step(5, 0.26, True, True)
    assert not state.step(6, 0.40, True, True)  # re-arms only
    assert state.step(7, 0.26, True, True)
    assert not state.step(7.5, 0.9, False, True)


def test_kalman_predicts_then_gives_up():
    k = folds.Kalman(misses=1)
    assert k.step((0.5, 0.5)) == (0.5, 0.5, True)
    assert k.step(None)[2]
    assert k.step(None) == (0.0, 0.0, False)


def test_countdown_takes_the_longest_chain_and_holds_its_end():
    times = [float(i) for i in range(9)]
    seen = [[600], [599, 40], [598], [], [596], [999], [594], [], []]
    assert folds.countdown(times, seen) == [600, 599, 598, 597, 596, 595, 594, 594, 594]


def test_fragments_of_other_teams_stay_apart():
    row = lambda i, t, team: {"track_id": i, "t0": t, "x0": 1.0, "y0": 1.0, "t1": t + 1, "x1": 1.0, "y1": 1.0, "team": team, "jersey": None}
    assert folds.merge_fragments([row(1, 0, "home"), row(2, 2, None), row(3, 4, "away"), row(4, 5, "home")]) == {1: 1, 2: 1, 3: 3, 4: 1}


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_nearest_prototype_over_all_labels(spark, most):
    rnd = np.random.default_rng(0)
    labels = [f"l{k:02}" for k in range(12)]
    book, vectors = rnd.normal(size=(12, 4)), rnd.normal(size=(60, 4))
    b = spark.createDataFrame([(x, p) for x, p in zip(labels, book.tolist(), strict=True)], "label string, prototype array<double>")
    v = spark.createDataFrame([(i, x) for i, x in enumerate(vectors.tolist())], "vec_id int, embedding array<double>")
    cosine = vectors @ book.T / np.linalg.norm(book, axis=1)
    got = matching.nearest_prototype(v, b, most)
    assert got.columns == ["vec_id", "embedding", "kit"]
    assert {r.vec_id: r.kit for r in got.collect()} == {i: labels[k] for i, k in enumerate(cosine.argmax(1))}
