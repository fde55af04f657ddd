"""Colours that tell levels of detail apart, as column expressions."""

from __future__ import annotations

import colorsys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A colour for each of the levels 0 to 20.
LEVELS = (
    0x030396, 0x8E05F0, 0x73FCFC, 0xB8E28D, 0x960303, 0xB873FC, 0x96037D, 0xFA19FA, 0x039603, 0x3B82F6, 0x22C55E,
    0xFACC15, 0xEF4444, 0xFB923C, 0xEC4899, 0x14B8A6, 0x1919FA, 0x966503, 0x84CC16, 0x2CF005, 0x55FC9A,
)
#: Turn of the hue from level to level beyond these, its saturation and lightness, the step of lightness among neighbours.
TURN, SATURATION, LIGHTNESS, STEP = 137.508, 0.72, 0.52, 0.04
#: The factors of a tile's hash.
HASH_X, HASH_Y = 73856093, 19349663


def tile_hash(x: Column, y: Column) -> Column:
    """An unsigned 32-bit hash of a tile's place."""
    return (x * HASH_X).bitwiseXOR(y * HASH_Y).bitwiseAND(F.lit(0xFFFFFFFF))


def linear(share: float) -> float:
    """A share of a channel of sRGB as a share of light."""
    return share * 0.0773993808 if share < 0.04045 else (share * 0.9478672986 + 0.0521327014) ** 2.4


def to_srgb(c: Column) -> Column:
    """The reverse, for columns."""
    return F.when(c < 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(0.41666)) - 0.055)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rgb_of(hsl: Column) -> Column:
    """Red, green and blue in 0 to 1 of a struct (h, s, l) in 0 to 1, as an array."""
    high = F.when(hsl["l"] <= 0.5, hsl["l"] * (1 + hsl["s"])).otherwise(hsl["l"] + hsl["s"] - hsl["l"] * hsl["s"])

    def channels(q: Column) -> Column:
        low = 2 * hsl["l"] - q
        part = lambda t: F.when(t < 1 / 6, low + (q - low) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, low + (q - low) * 6 * (2 / 3 - t)).otherwise(low)
        return F.transform(F.array(*[F.pmod(hsl["h"] + turn, F.lit(1.0)) for turn in (1 / 3, 0.0, -1 / 3)]), part)

    return let(high, channels)


def level_colour(zoom: Column, x: Column, y: Column) -> Column:
    """The colour of a tile as an array of red, green and blue in 0 to 255: its level's, a little lighter or darker by the tile's hash.

    Lightness is that of linear light.  Levels beyond 20 go round the hues by a fixed turn.  Null gives null.
    """
    known = [colorsys.rgb_to_hls(*[linear((c >> bits & 255) / 255) for bits in (16, 8, 0)]) for c in LEVELS]
    named = lambda h, s, light: F.struct(h.alias("h"), s.alias("s"), light.alias("l"))
    table = F.array(*[named(F.lit(h), F.lit(s), F.lit(light)) for h, light, s in known])
    free = named(F.pmod(zoom * TURN, F.lit(360.0)) / 360, F.lit(SATURATION), F.lit(LIGHTNESS))
    base = F.when(zoom.between(0, len(LEVELS) - 1), F.get(table, zoom.cast("int"))).otherwise(free)
    shift = (tile_hash(x, y) % 3 - 1) * STEP
    moved = let(base, lambda b: named(b["h"], b["s"], F.greatest(F.least(b["l"] + shift, F.lit(1.0)), F.lit(0.0))))
    channel = lambda c: F.floor(F.greatest(F.least(to_srgb(c) * 255, F.lit(255.0)), F.lit(0.0)) + 0.5).cast("int")
    return F.when(zoom.isNotNull() & x.isNotNull() & y.isNotNull(), F.transform(let(moved, rgb_of), channel))
