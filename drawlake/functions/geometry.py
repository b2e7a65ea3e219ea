"""Column functions on lengths, rounding and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlake.functions import rules as R


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def holders(length_m: Column, step: float = 0.8) -> Column:
    """Holders along a length: one every ``step`` metres, rounded up."""
    return F.ceil(length_m / F.lit(step))


def color_rgb(c: Column) -> Column:
    """(r, g, b) from 0 to 1 of a grey, RGB or CMYK array; null for other sizes."""
    n = F.size(c)

    def at(k):
        return F.try_element_at(c, F.lit(k)).cast("double")

    def rgb(r, g, b):
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))

    black = 1 - at(4)
    return F.when(n == 1, rgb(at(1), at(1), at(1))).when(n == 3, rgb(at(1), at(2), at(3))).when(n == 4, rgb((1 - at(1)) * black, (1 - at(2)) * black, (1 - at(3)) * black))


def color_class(rgb: Column) -> Column:
    """red, blue, grey, black or '' of an (r, g, b)."""
    r, g, b = rgb["r"], rgb["g"], rgb["b"]
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return F.when(rgb.isNull(), "").when((r > 0.6) & (g < 0.4) & (b < 0.4), "red").when((b > 0.6) & (r < 0.4) & (g < 0.5), "blue").when((F.greatest(r, g, b) < 0.15), "black").when((spread < 0.1) & (r > 0.2) & (r < 0.9), "grey").otherwise("")


def color_strict(rgb: Column, tol: float = 0.05) -> Column:
    """red or blue of an (r, g, b) that is pure within the tolerance, else other."""
    def near(*target):
        return (F.abs(rgb["r"] - target[0]) < tol) & (F.abs(rgb["g"] - target[1]) < tol) & (F.abs(rgb["b"] - target[2]) < tol)

    return F.when(near(1, 0, 0), "red").when(near(0, 0, 1), "blue").otherwise("other")


def color_label(rgb: Column) -> Column:
    """The name of a known colour within 0.05, a grey with its level, or ''."""
    out = None
    for target, label in R.COLOURS:
        near = F.lit(True)
        for k, v in zip("rgb", target):
            near = near & (F.abs(F.bround(rgb[k], 2) - v) < 0.05)
        out = F.when(near, label) if out is None else out.when(near, label)
    grey = (F.abs(rgb["r"] - rgb["g"]) < 0.05) & (F.abs(rgb["g"] - rgb["b"]) < 0.05)
    shade = F.when(rgb["r"] < 0.15, "Чёрный / Рамка").when(rgb["r"] > 0.85, "Белый / Фон").otherwise(F.concat(F.lit("Серый ("), F.floor(rgb["r"] * 100).cast("string"), F.lit("%)")))
    return F.when(rgb.isNull(), "").otherwise(out.when(grey, shade).otherwise(""))


def color_hex(rgb: Column) -> Column:
    def two(c):
        return F.lpad(F.hex(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")), 2, "0")

    return F.when(rgb.isNotNull(), F.lower(F.concat(F.lit("#"), two(rgb["r"]), two(rgb["g"]), two(rgb["b"]))))
