"""Colours as column expressions: 8-bit Lab as picture libraries scale it (L to 255, a and b from 128)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linear sRGB to XYZ under D65, divided by the white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)


def _linear(v: Column) -> Column:
    x = v / 255.0
    return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)


def _bend(x: Column) -> Column:
    return F.when(x > 0.008856, F.cbrt(x)).otherwise(7.787 * x + 16.0 / 116.0)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a and b of an 8-bit colour, before rounding to 8 bits."""
    linear = [_linear(v) for v in (r, g, b)]
    x, y, z = (sum((w * v for w, v in zip(row, linear, strict=True)), F.lit(0.0)) / white for row, white in zip(_XYZ, _WHITE, strict=True))
    fx, fy, fz = _bend(x), _bend(y), _bend(z)
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return light * 255.0 / 100.0, 500.0 * (fx - fy) + 128.0, 200.0 * (fy - fz) + 128.0


def crop_quality(height: Column, saturation: Column) -> Column:
    return height * (0.35 + saturation / 255.0)


def jersey_sharpness(height: Column, laplacian: Column) -> Column:
    return height * F.least(laplacian / 100.0, F.lit(3.0))


def looks_like_referee(saturation: Column, brightness_spread: Column, near_kit: Column, least_saturation: float = 28.0) -> Column:
    """Dull clothes, or stripes with little colour, unless the colour is near a kit's."""
    striped = (brightness_spread >= 40.0) & (saturation < 50.0)
    return ((saturation < least_saturation) | striped) & ~near_kit


def lab8(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Lab rounded to whole numbers."""
    return tuple(F.floor(v + 0.5) for v in lab(r, g, b))


def chromatic(h: Column, s: Column, v: Column, dark: bool = False, least_saturation: int = 40, least_value: int = 40) -> Column:
    """Whether a pixel (hue to 180, saturation and value to 255) looks like dyed cloth."""
    # Skin hues and saturations, and blown highlights.
    skin = h.between(3, 18) & s.between(40, 180) & (v >= 80)
    blown = (v > 245) & (s < 40)
    kept = (s >= least_saturation) & (v >= least_value)
    return ~skin & ~blown & (kept | ((s >= 20) & (v >= 15) & (v < least_value)) if dark else kept)


def nearest_kit(point: list[Column], kits: dict[str, tuple[int, int, int]], margin: float) -> Column:
    """Name of the kit (red, green, blue) nearest to a Lab point; null if the second is under `margin` farther."""
    from courtline.operators.lookback import nearest_with_margin

    far = [F.sqrt(sum(((p - q) * (p - q) for p, q in zip(point, lab8(*map(F.lit, kit)), strict=True)), F.lit(0))) for kit in kits.values()]
    return nearest_with_margin(far, [*kits], margin)
