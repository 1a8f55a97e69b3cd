"""Pixel expressions: luminances, recoloring, palettes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Piecewise-linear palettes, (stop, red, green, blue).
THERMAL = ((0.00, 4, 5, 18), (0.22, 42, 30, 92), (0.48, 139, 45, 94), (0.70, 229, 93, 45), (0.88, 250, 190, 65), (1.00, 255, 247, 190))
SUPPORT = ((0.00, 178, 36, 126), (0.45, 45, 105, 180), (0.72, 39, 163, 151), (1.00, 190, 231, 120))

#: Fixed values of the evidence fusion: shares of detail and contrast in the saliency; least, greatest and gains (darkness, saliency) of the
#: thermal weight; fall of the exposure off middle grey and its least; shares of exposure and detail, and start and gain of the saliency, in the reliability; contrast of the tone.
DETAIL, CONTRAST = 0.55, 0.45
FLOOR, CEILING, DARKNESS, SALIENCY = 0.12, 0.82, 0.22, 0.58
EXPOSURE_FALL, EXPOSURE_LEAST = 1.7, 0.08
EXPOSED, DETAILED, SALIENT_START, SALIENT_GAIN = 0.45, 0.55, 0.3, 0.7
TONE = 1.08


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def luma709(r: Column, g: Column, b: Column) -> Column:
    """Luminance for registration and fusion."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luma601(r: Column, g: Column, b: Column) -> Column:
    """Luminance for recoloring and policy."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def recolor(r: Column, g: Column, b: Column, target: Column, preserve: float) -> tuple[Column, Column, Column]:
    """The pixel with another luminance; ``preserve`` is the share of its chroma that stays."""
    y = luma601(r, g, b)
    cb, cr = (b - y) * 0.564 * preserve, (r - y) * 0.713 * preserve
    return clip(target + 1.403 * cr), clip(target - 0.344 * cb - 0.714 * cr), clip(target + 1.773 * cb)


def palette(value: Column, stops, channel: int) -> Column:
    """A channel (1 to 3) of the palette's color, halves rounded to even; unknown is black. At a stop the later interval holds."""
    out = F.when(value < stops[0][0], F.lit(float(stops[0][channel])))
    for a, b in reversed(list(zip(stops, stops[1:]))):
        inside = (value >= a[0]) & (value <= b[0])
        share = (value - a[0]) / (b[0] - a[0])
        out = out.when(inside, a[channel] + share * (b[channel] - a[channel]))
    return F.coalesce(F.rint(out.when(value > stops[-1][0], float(stops[-1][channel]))), F.lit(0.0)).cast("int")


def palette_sql(value: str, stops, channel: int) -> str:
    """The same in SQL."""
    cases = [f"WHEN {value} < {stops[0][0]!r} THEN {stops[0][channel]}e0"]
    for a, b in reversed(list(zip(stops, stops[1:]))):
        cases.append(f"WHEN {value} >= {a[0]!r}::DOUBLE AND {value} <= {b[0]!r}::DOUBLE THEN {a[channel]}e0 + ({value} - {a[0]!r}::DOUBLE) / {(b[0] - a[0])!r}::DOUBLE * {b[channel] - a[channel]}e0")
    cases.append(f"WHEN {value} > {stops[-1][0]!r} THEN {stops[-1][channel]}e0")
    return f"CAST(coalesce(round_even(CASE {' '.join(cases)} END, 0), 0) AS INTEGER)"


#: Colors of the semantic classes 0 to 11.
CLASSES = (
    (255, 36, 0), (0, 0, 0), (242, 216, 196), (89, 70, 54), (166, 166, 166), (82, 89, 90),
    (155, 230, 0), (0, 138, 53), (0, 216, 245), (13, 127, 252), (255, 249, 0), (254, 0, 170),
)


def class_color(cls: Column, channel: int) -> Column:
    """A channel (1 to 3) of a class's color: listed, else 96 and seven bits of the multiplied class."""
    listed = F.get(F.array(*(F.lit(c[channel - 1]) for c in CLASSES)), cls.cast("int"))
    bits = F.shiftright((cls.cast("bigint") * 2654435761).bitwiseAND(F.lit(0xFFFFFF)), 8 * (channel - 1)).bitwiseAND(F.lit(0x7F))
    return F.when((cls >= 0) & (cls < len(CLASSES)), listed).otherwise((bits + 96).cast("int"))


def blend(base: Column, color: Column, alpha: float) -> Column:
    """A color over a pixel, both 0 to 255; without a color the pixel as it is."""
    return F.when(color.isNotNull(), F.rint(base * (1 - alpha) + color * alpha)).otherwise(base).cast("int")


def baseline(name: str, visible: Column, thermal: Column, support: Column) -> Column:
    """A pixel-wise comparison method; where support is lacking each falls back to the visible signal."""
    if name == "rgb_only":
        return visible
    signal, share = {"thermal_only": (thermal, support), "average": (thermal, 0.5 * support), "maximum": (F.greatest(visible, thermal), support)}[name]
    return visible * (1 - share) + signal * share
