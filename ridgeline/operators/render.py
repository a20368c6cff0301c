"""Map output: colours, legends and packed rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Polynomial coefficients of the Turbo colour map, lowest first.
TURBO = {
    "r": (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    "g": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    "b": (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
}
LEAST_ALPHA = 90
#: Red, green, blue of the legend's stops, at evenly spaced shares.
LEGEND = (
    (48, 18, 59), (59, 160, 252), (25, 211, 207), (39, 237, 163), (85, 250, 118), (135, 254, 77),
    (169, 251, 57), (197, 239, 51), (218, 226, 54), (237, 207, 57), (248, 190, 57), (253, 169, 50),
    (253, 149, 43), (250, 125, 32), (245, 104, 23), (237, 85, 15), (227, 68, 10), (215, 54, 6),
    (203, 43, 3), (190, 33, 2), (174, 24, 1), (157, 16, 1), (139, 9, 1), (122, 4, 2),
)


def _polynomial(name: str, t: float) -> float:
    v = 0.0
    for c in reversed(TURBO[name]):
        v = v * t + c
    return v


#: The 256 steps of the ramp and the legend's place on it.
STEPS = 256
_AT = [min(STEPS - 1, int((i / (len(LEGEND) - 1)) ** 0.5 * STEPS)) for i in range(len(LEGEND))]


def ramp() -> list[tuple[int, int, int]]:
    """The colours of all steps: the polynomial, moved by what it lacks at the
    legend's stops, in proportion between them.

    Stops are exact; between them the colour map may differ by a few units.
    """
    out = []
    for i in range(STEPS):
        k = max(j for j in range(len(_AT)) if _AT[j] <= i)
        j = min(k + 1, len(_AT) - 1)
        f = (i - _AT[k]) / (_AT[j] - _AT[k]) if j > k else 0.0
        colour = []
        for ch, name in enumerate("rgb"):
            lacks = [(LEGEND[s][ch] + 0.5) / 255 - _polynomial(name, _AT[s] / (STEPS - 1)) for s in (k, j)]
            v = _polynomial(name, i / (STEPS - 1)) + lacks[0] * (1 - f) + lacks[1] * f
            colour.append(int(max(0.0, min(1.0, v)) * 255))
        out.append(tuple(colour))
    return out


def heat(values: DataFrame, value: str, vmax: Column, colours: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """``values`` with r, g, b and a of a square-root heat ramp; cells at or
    below zero are transparent.

    ``colours`` are the 256 steps of another map, or of this one's own table;
    the ramp above is the default.  Fractions are cut off, not rounded.
    """
    colours = colours or ramp()
    table = [F.array(*(F.lit(c[k]) for c in colours)) for k in range(3)]
    v = F.col(value)
    norm = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / vmax)))
    step = F.least(F.lit(len(colours) - 1), F.floor(norm * len(colours)).cast("int"))
    alpha = F.when(v > 0, F.greatest(F.lit(LEAST_ALPHA), F.floor(F.sqrt(norm) * 255))).otherwise(0).cast("int")
    return values.select("*", *[F.get(t, step).alias(n) for t, n in zip(table, "rgb")], alpha.alias("a"))


def legend(spark: SparkSession) -> DataFrame:
    """(i, frac, r, g, b) of the legend's stops."""
    colours = F.array(*[F.array(*map(F.lit, c)) for c in LEGEND])
    at = F.get(colours, F.col("i"))
    rows = spark.range(len(LEGEND)).select(F.col("id").cast("int").alias("i"), (F.col("id") / float(len(LEGEND) - 1)).alias("frac"))
    return rows.select("i", "frac", *[F.get(at, F.lit(k)).alias(n) for k, n in enumerate("rgb")])


def stop_index(t: Column, n: int = len(LEGEND)) -> Column:
    """The legend stop for a linear ramp at ``t``."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t * t)) * (n - 1) + 0.5).cast("int")


def decimetres(z: Column) -> Column:
    return F.rint(z * 10).cast("int")


def pack_rows(grid: DataFrame) -> DataFrame:
    """(row, data): heights of a row in decimetres as base64 of little-endian
    unsigned 16-bit integers, in column order."""
    low = F.expr("transform(zs, v -> concat(lpad(hex(v & 255), 2, '0'), lpad(hex((v >> 8) & 255), 2, '0')))")
    cells = F.sort_array(F.collect_list(F.struct("col", decimetres(F.col("z")).alias("v"))))
    rows = grid.groupBy("row").agg(F.transform(cells, lambda c: c["v"]).alias("zs"))
    return rows.select("row", F.regexp_replace(F.base64(F.unhex(F.array_join(low, ""))), r"\s", "").alias("data"))


def unpack_rows(packed: DataFrame) -> DataFrame:
    """(row, col, z) from ``pack_rows``."""
    h = F.hex(F.unbase64("data"))
    rows = packed.select("row", h.alias("h"))
    at = rows.select("row", "h", F.explode(F.expr("sequence(0, int(length(h) / 4) - 1)")).alias("col"))
    byte = lambda i: F.conv(F.expr(f"substring(h, col * 4 + {i}, 2)"), 16, 10).cast("int")
    return at.select("row", "col", ((byte(1) + byte(3) * 256) / 10.0).alias("z"))


def heights_at(packed: DataFrame, cells: DataFrame) -> DataFrame:
    """(row, col, z) of some cells (row, col) only: of a packed row two bytes
    are decoded per cell that is asked for, and rows not asked for stay as they
    are."""
    asked = cells.select("row", "col").distinct()
    got = asked.join(packed.select("row", "data"), "row")
    # four characters of base64 hold three bytes; a height lies in at most two such groups
    first = F.floor(F.col("col") * 2 / 3)
    some = F.unbase64(F.expr("substring(data, int(floor(col * 2 / 3) * 4 + 1), 8)"))
    at = (F.col("col") * 2 - first * 3).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("some"), F.col("at") + i, F.lit(1))), 16, 10).cast("int")
    got = got.withColumn("some", some).withColumn("at", at)
    return got.select("row", "col", ((byte(1) + byte(2) * 256) / 10.0).alias("z"))


def inside(points: DataFrame, x0: Column, y0: Column, width: Column, height: Column, res: Column) -> DataFrame:
    """``points`` within an extent that reaches right and down from its corner
    (x0, y0); its borders belong to it."""
    return points.where(F.col("x").between(x0, x0 + width * res) & F.col("y").between(y0 - height * res, y0))


def stop_colour(score: Column, low: Column, high: Column) -> Column:
    """(r, g, b) of a score's place between the lowest and highest one."""
    t = F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))
    colours = F.array(*[F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "rgb"))) for c in LEGEND])
    return F.element_at(colours, stop_index(t) + 1)


def assign(name: str, json: Column) -> Column:
    """A script that sets a global variable to a JSON value."""
    return F.concat(F.lit(f"var {name} = "), json, F.lit(";"))
