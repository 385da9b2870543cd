"""Colours: hex texts, OKLCH, and the ladder that keeps an opponent's colour apart from ours."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: OKLab's matrices.
RGB_TO_LMS = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
LMS_TO_LAB = [[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]]
LAB_TO_LMS = [[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.291485548]]
LMS_TO_RGB = [[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.707614701]]
#: Our hue and the wedge about it, limits of lightness and chroma, what takes their place.
OUR_HUE, WEDGE, WEDGE_CHROMA = 29, 30, 0.05
DARK, PALE, PALE_CHROMA = 0.55, 0.93, 0.045
LIFT, DIMMED, COOL = 0.07, 0.86, 250
ALTERNATES = ["#8FA6C4", "#6FB7D8", "#9B8CE8", "#6E8FE8"]
ON_LIGHT, ON_DARK, LIGHT = "#1A1819", "#EBEBEB", 0.6
STEPS, SHRINK = 40, 0.94


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(matrix: list[list[float]], v: Column) -> Column:
    return F.array(*[reduce(lambda a, b: a + b, [F.lit(m) * v[i] for i, m in enumerate(row)]) for row in matrix])


def hex_channels(c: Column) -> Column:
    """Three channels of 0 to 255 of '#rrggbb' or '#rgb', with or without the sign; else null."""
    s = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "^([^#]*)#", "$1")
    s = let(s, lambda x: F.when(F.length(x) == 3, F.regexp_replace(x, "(.)", "$1$1")).otherwise(x))
    part = lambda x, i: F.conv(F.substring(x, 1 + 2 * i, 2), 16, 10).cast("double")
    return let(s, lambda x: F.when(x.rlike(r"\A[0-9a-fA-F]{6}\z"), F.array(*[part(x, i) for i in range(3)])))


def hex_text(rgb: Column) -> Column:
    """'#RRGGBB' of three channels, rounded and kept within 0 to 255."""
    part = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), rgb[i])) + 0.5).cast("int") for i in range(3)]
    return F.when(rgb.isNotNull(), F.format_string("#%02X%02X%02X", *part))


def to_oklch(rgb: Column) -> Column:
    """struct of l (lightness), c (chroma) and h (hue in degrees) of three channels."""
    linear = F.transform(rgb, lambda x: F.when(x / 255 <= 0.04045, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, 2.4)))
    lms = let(linear, lambda v: F.transform(_times(RGB_TO_LMS, v), F.cbrt))
    polar = lambda v: F.struct(v[0].alias("l"), F.sqrt(v[1] * v[1] + v[2] * v[2]).alias("c"), F.pmod(F.degrees(F.atan2(v[2], v[1])), F.lit(360.0)).alias("h"))
    return let(let(lms, lambda v: _times(LMS_TO_LAB, v)), lambda v: F.when(v[0].isNotNull(), polar(v)))


def from_oklch(light: Column, chroma: Column, hue: Column) -> Column:
    """Three channels, beyond 0 to 255 where the colour is out of gamut."""
    lab = F.array(light, chroma * F.cos(hue * (pi / 180)), chroma * F.sin(hue * (pi / 180)))
    lms = let(lab, lambda v: F.transform(_times(LAB_TO_LMS, v), lambda x: F.pow(x, 3)))
    return F.transform(let(lms, lambda v: _times(LMS_TO_RGB, v)), lambda x: 255 * F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), 1 / 2.4) - 0.055))


def in_gamut(lch: Column) -> Column:
    """Channels of a colour, its chroma lowered step by step until they fit; without any at last.
    Steps after the first that fits are not worked out."""
    at = lambda i: from_oklch(lch["l"], F.when(i < STEPS, lch["c"] * F.pow(F.lit(SHRINK), i)).otherwise(0.0), lch["h"])
    fits = lambda t: F.coalesce(F.forall(t, lambda x: x.between(-0.5, 255.5)), F.lit(False))
    tries = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(None).cast("array<double>"), lambda found, i: F.when(fits(found), found).otherwise(at(i)))
    return F.when(lch.isNotNull(), tries)


def clashes(lch: Column) -> dict[str, Column]:
    """Which zones a colour lies in: our hue's wedge, too dark, too pale."""
    away = F.abs(lch["h"] - OUR_HUE)
    return {"wedge": (F.least(away, 360 - away) <= WEDGE) & (lch["c"] >= WEDGE_CHROMA), "dark": lch["l"] < DARK, "pale": (lch["l"] > PALE) & (lch["c"] < PALE_CHROMA)}


def _clear(lch: Column) -> Column:
    return F.coalesce(~reduce(lambda a, b: a | b, clashes(lch).values()), F.lit(False))


def alternate(abbrev: Column) -> Column:
    """One of ``ALTERNATES`` by a hash of the club's abbreviation."""
    s = F.upper(F.coalesce(F.nullif(F.trim(abbrev), F.lit("")), F.lit("OPP")))
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    n = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda n, c: (n * 31 + c) % 2**32)
    return F.get(F.array(*map(F.lit, ALTERNATES)), (n % len(ALTERNATES)).cast("int"))


def opponent_colors(clubs: DataFrame, abbrev: str, primary: str, secondary: str) -> DataFrame:
    """``clubs`` with ``colors``: base, strong, line and soft (base at less opacity), fg (a text on it)
    and provenance.

    The first that clears all zones of ``clashes``: the primary colour (brand), the secondary, and
    then what the primary's fault asks for: an alternate within the wedge or without a colour,
    adjusted where too pale or too dark, gunmetal for dark grays. Without a primary the
    secondary stands for it. A dark colour of our hue that is too dull to clash is lifted like any
    other, into the wedge."""
    shade = lambda light, c, h: F.struct(F.lit(light).alias("l"), c.alias("c"), h.alias("h"))
    cool = F.lit(float(COOL))

    def rung(v):
        zones = clashes(v["o"])
        named = F.when(_clear(v["o"]), "brand").when(_clear(v["o2"]), "secondary").when(v["o"].isNull() | zones["wedge"], "alternate").when(zones["pale"], "pale").when(v["o"]["c"] < 0.03, "gunmetal").otherwise("lifted")
        return F.struct(v["first"].alias("first"), v["second"].alias("second"), v["o"].alias("o"), named.alias("rung"))

    def moved(v):
        o = v["o"]
        pale = shade(DIMMED, F.greatest(o["c"], F.lit(0.035)), F.when(o["c"] < 0.02, cool).otherwise(o["h"]))
        lifted = shade(DARK + LIFT, F.greatest(F.least(o["c"], F.lit(0.14)), F.lit(0.06)), o["h"])
        return F.when(v["rung"] == "pale", pale).when(v["rung"] == "gunmetal", shade(DARK + LIFT, F.lit(0.012), cool)).when(v["rung"] == "lifted", lifted)

    def base(v):
        r = v["rung"]
        own = F.when(r == "brand", hex_text(v["first"])).when(r == "secondary", hex_text(v["second"])).when(r == "alternate", alternate(F.col(abbrev)))
        return F.struct(own.otherwise(let(let(moved(v), in_gamut), hex_text)).alias("base"), F.when(r.isin("pale", "lifted"), "adjusted").otherwise(r).alias("provenance"))

    def finished(v):
        alpha = lambda a, n: F.concat(F.lit("rgba("), F.array_join(F.transform(v["rgb"], lambda x: x.cast("int").cast("string")), ", "), F.lit(f", {a})")).alias(n)
        fg = F.when(to_oklch(v["rgb"])["l"] >= LIGHT, ON_LIGHT).otherwise(ON_DARK)
        return F.struct(v["base"].alias("base"), alpha("0.74", "strong"), alpha("0.4", "line"), alpha("0.12", "soft"), fg.alias("fg"), v["provenance"].alias("provenance"))

    both = F.struct(hex_channels(F.col(primary)).alias("p"), hex_channels(F.col(secondary)).alias("s"))
    v = let(both, lambda x: F.struct(F.coalesce(x["p"], x["s"]).alias("first"), F.when(x["p"].isNotNull(), x["s"]).alias("second")))
    v = let(v, lambda x: F.struct(x["first"].alias("first"), x["second"].alias("second"), to_oklch(x["first"]).alias("o"), to_oklch(x["second"]).alias("o2")))
    v = let(let(v, rung), base)
    v = let(v, lambda x: F.struct(x["base"].alias("base"), x["provenance"].alias("provenance"), hex_channels(x["base"]).alias("rgb")))
    return clubs.withColumn("colors", let(v, finished))
