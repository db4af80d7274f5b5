"""Settings, court fits and attempts without a session."""

import numpy as np
import pytest

from courtline.functions import geometry, overlay
from courtline.operators.attempts import PRESETS, Config
from courtline.sources import settings


def test_flags_win_over_the_file_and_the_file_over_defaults():
    got = settings.configured(Config(), '{"cooldown": 2.0, "rise": 0.1}', rise=0.2, expand=None)
    assert (got.cooldown, got.rise, got.expand) == (2.0, 0.2, Config().expand)
    with pytest.raises(ValueError):
        settings.configured(Config(), '{"unheard": 1}')
    assert PRESETS["wheelchair"].most_jump == 0.12 and PRESETS["wheelchair"].cooldown == PRESETS["running"].cooldown


def test_lines_and_devices():
    assert settings.dataset_lines("/d", ["ball"]).splitlines()[-2:] == ["nc: 1", "names: ['ball']"]
    assert "cooldown: 1.0\n" in settings.tracker_lines(Config())
    assert settings.first_available(None, ["cuda", "cpu"]) == "cuda" and settings.first_available("cpu", ["cuda", "cpu"]) == "cpu"
    with pytest.raises(ValueError):
        settings.first_available("cpu", ["cpu"], allow_cpu=False)


@pytest.mark.parametrize("quad", [0, 1])
def test_score_by_a_solved_homography(quad):
    paint, outline = overlay.paint_quads(overlay.FIBA)[quad], overlay.outline(overlay.FIBA)
    points = np.array([[200.0, 120.0], [190.0, 230.0], [320.0, 240.0], [300.0, 125.0]])
    h = np.array(geometry.solve_homography(paint, points.tolist())).reshape(3, 3)
    corners = [(h @ [x, y, 1])[:2] / (h @ [x, y, 1])[2] for x, y in outline]
    whole, own = abs(overlay.signed_area([tuple(c) for c in corners])), overlay.signed_area([tuple(p) for p in points])
    inside = sum(-160 < x < 800 and -90 < y < 450 for x, y in corners)
    want = inside * 10 + min(whole / (640 * 360), 2) * 5 + whole / abs(own) + (20 if own * overlay.signed_area(paint) > 0 else 0)
    got = overlay.scores(overlay.FIBA, quad, points[None], 640.0, 360.0)[0]
    assert got == (pytest.approx(want) if inside >= 3 else -np.inf)
    assert overlay.scores(overlay.FIBA, quad, np.zeros((1, 4, 2)), 640.0, 360.0)[0] == -np.inf
