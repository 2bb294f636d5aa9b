"""Stable colours and sizes for labels. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parameters of FNV-1a with 32 bits.
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
# Degrees between neighbouring hues, colour of outliers, colours of five subjects, stops of the gradient.
GOLDEN_ANGLE = 137.508
OUTLIER = "#8a8a8a"
SUBJECT_COLORS = {"Bio": "#43c463", "Sozialkunde": "#e05a5a", "Geschichte": "#e0a23a", "Ethik, Philo": "#9a4ad6", "Psychologie": "#4a7fd6"}
GRADIENT = [(8, 94, 101), (83, 209, 255), (39, 45, 99)]


def hash_unit(label: Column, salt: Column | str = "") -> Column:
    """A fixed number from 0 to 1 for a label: the first 32 bits of the MD5 of salt::label."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    digest = F.md5(F.concat(salt, F.lit("::"), label))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of the text, as a long."""
    high = F.lit(0x10000)
    units = F.flatten(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c: F.when(F.ascii(c) < high, F.array(F.ascii(c))).otherwise(
                F.array(F.lit(0xD800) + F.shiftright(F.ascii(c) - high, 10), F.lit(0xDC00) + (F.ascii(c) - high).bitwiseAND(F.lit(0x3FF)))
            ),
        )
    )
    return F.aggregate(
        units,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, u: (h.bitwiseXOR(u.cast("long")) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK).cast("long")),
    )


def _hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda x: F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def _hls(h: Column, light: Column, s: Column, whole) -> Column:
    """Hex colour of hue (0 to 1), lightness and saturation; `whole` makes a channel of 0 to 255 an integer."""
    a = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = (F.lit(n) + h * 12) % 12
        return whole(255 * (light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

    return _hex(channel(0), channel(8), channel(4))


def label_color(label: Column, salt: str) -> Column:
    """Colour by hash: hue fnv1a(salt::label) mod 360, saturation 62 %, lightness 55 %."""
    hue = (fnv1a(F.concat(F.lit(salt + "::"), F.coalesce(label, F.lit("")))) % 360).cast("double") / 360
    return _hls(hue, F.lit(0.55), F.lit(0.62), F.round)


def palette(labels: DataFrame, label: str, salt: str, fixed: dict[str, str] | None = None) -> DataFrame:
    """label, color for the distinct labels: hues a golden angle apart in label order, from a start that depends on salt.

    A list of categories: its order is one window."""
    start = hash_unit(F.lit(salt), "start") * 360
    one = labels.select(label).where(F.col(label).isNotNull()).distinct()
    i = F.row_number().over(W.orderBy(label)) - 1
    hue = ((start + i * GOLDEN_ANGLE) % 360) / 360
    jitter = hash_unit(F.col(label), salt)
    color = _hls(hue, 0.52 + 0.10 * (1 - jitter), 0.55 + 0.15 * jitter, F.floor)
    for k, v in (fixed or {}).items():
        color = F.when(F.col(label) == k, v).otherwise(color)
    return one.select(label, color.alias("color"))


def gradient_color(term: Column) -> Column:
    """Colour on the brand gradient by hash of the term, with a jitter of up to 10 in each channel."""
    h = fnv1a(F.concat(F.lit("home-wordcloud::"), F.coalesce(term, F.lit(""))))
    t = (h % 1000).cast("double") / 1000
    jitter = F.shiftright(h, 10) % 21 - 10
    local = F.when(t < 0.5, t / 0.5).otherwise((t - 0.5) / 0.5)

    def mix(i: int) -> Column:
        a = F.when(t < 0.5, GRADIENT[0][i]).otherwise(GRADIENT[1][i])
        b = F.when(t < 0.5, GRADIENT[1][i]).otherwise(GRADIENT[2][i])
        return F.round(a + (b - a) * local + jitter)

    return _hex(mix(0), mix(1), mix(2))


def font_size(weight: Column, most: Column) -> Column:
    """4 to 40 by the root of the weight's share of the largest."""
    return 4 + 36 * F.when(most > 0, F.sqrt(F.greatest(weight, F.lit(0)) / most)).otherwise(0.0)


def bubble_size(freq: Column) -> Column:
    return F.greatest(F.lit(20.0), 7 * F.sqrt(F.greatest(freq, F.lit(0.1))))
