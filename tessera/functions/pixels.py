"""Pixel-wise column functions: inversion, gray, thresholds, stain separation, opponent colours, background and
foreground tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Gray weights (blue, green, red), the foreground discriminant, the background threshold.
GRAY = (0.114020904255103, 0.587043074451121, 0.298936021293776)
FOREGROUND = ((-0.154, 0.035, 0.549, -45.718), (-0.057, -0.817, 1.170, -49.887))
BACKGROUND = 220


def to_u8(x: Column) -> Column:
    """Round half up and clamp to 0..255."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")


def invert(x: Column) -> Column:
    return F.lit(255) - x


def gray(b: Column, g: Column, r: Column) -> Column:
    return to_u8(b * GRAY[0] + g * GRAY[1] + r * GRAY[2])


def green_fraction(b: Column, g: Column, r: Column) -> Column:
    """Green over the sum, scaled to 255 and cut off."""
    return F.floor(g / (b + g + r + 2.220446049250313e-16) * 255.0).cast("int")


def density(x: Column) -> Column:
    """Optical density scaled so that 0 gives 255 and 254 gives 0."""
    return 255.0 - 255.0 * F.log(x + 1.0) / F.log(F.lit(255.0))


def is_background(b: Column, g: Column, r: Column) -> Column:
    return (b > BACKGROUND) & (g > BACKGROUND) & (r > BACKGROUND)


def is_foreground(b: Column, g: Column, r: Column) -> Column:
    p, q = ((r * w[0] + g * w[1] + b * w[2] + w[3]) for w in FOREGROUND)
    return p < q


def modulo(x: Column, by: int) -> Column:
    return x % by


def replace(x: Column, old: int, new: int) -> Column:
    return F.when(x == old, new).otherwise(x)


def within(x: Column, low: float, high: float, with_low: bool = True, with_high: bool = True) -> Column:
    return ((x >= low) if with_low else (x > low)) & ((x <= high) if with_high else (x < high))


def masked(x: Column, mask: Column, background: int = 0) -> Column:
    return F.when(mask, x).otherwise(background)


def is_red_cell(b: Column, g: Column, r: Column, least: float) -> Column:
    """Red over green above the limit, and red over blue above 1."""
    tiny = 1.1920928955078125e-07
    return (r / (g + tiny) > least) & (r / (b + tiny) > 1.0)


# Stain colours (rows red, green, blue; columns stains) and which stains are wanted.
STAINS = ((0.650, 0.072, 0.0), (0.704, 0.990, 0.0), (0.286, 0.105, 0.0))
WANTED = (True, True, False)


def complete_stains(stains=STAINS) -> np.ndarray:
    """Columns of length 1; a last column of zeros is completed so that each row has length 1 where it can."""
    m = np.array(stains, dtype=float)
    length = np.linalg.norm(m, axis=0)
    m = m / np.where(length > 0, length, 1.0)
    if not m[:, -1].any():
        m[:, -1] = np.sqrt(np.clip(1.0 - (m[:, :-1] ** 2).sum(axis=1), 0.0, None))
        m[:, -1] /= np.linalg.norm(m[:, -1]) or 1.0
    return m


def unmixing(stains=STAINS, wanted=WANTED) -> list[list[float]]:
    """Rows of the inverse of the stain matrix for the wanted stains."""
    inverse = np.linalg.inv(complete_stains(stains))
    return [[float(v) for v in row] for row, w in zip(inverse, wanted) if w]


def unmix(b: Column, g: Column, r: Column, rows: list[list[float]]) -> list[Column]:
    """One 0..255 column per row of the unmixing matrix."""
    scale = math.log(255.0) / 255.0
    amounts = (density(r) * w[0] + density(g) * w[1] + density(b) * w[2] for w in rows)
    return [to_u8(F.exp((a - 255.0) * -scale)) for a in amounts]


def remix(amounts: list[Column], stains=STAINS) -> list[Column]:
    """Blue, green and red of amounts of the stains, given as 0..255 columns."""
    scale = math.log(255.0) / 255.0
    m = complete_stains(stains)
    out = []
    for channel in (2, 1, 0):
        total = F.lit(0.0)
        for k, a in enumerate(amounts):
            total = total + density(a) * float(m[channel][k])
        out.append(to_u8(F.exp((total - 255.0) * -scale)))
    return out


# From red, green and blue to the responses of the three cones, and back.
CONES = ((0.3811, 0.5783, 0.0402), (0.1967, 0.7244, 0.0782), (0.0241, 0.1288, 0.8444))
COLOURS = ((4.4687, -3.5887, 0.1196), (-1.2197, 2.3831, -0.1626), (0.0585, -0.2611, 1.2057))


def to_opponent(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """l, alpha and beta of colours from 0 to 1. Null for black, which has no logarithm."""
    x, y, z = (F.log10(F.when(v > 0, v)) for v in (r * w[0] + g * w[1] + b * w[2] for w in CONES))
    return (x + y + z) / math.sqrt(3.0), (x + y - z * 2.0) / math.sqrt(6.0), (x - y) / math.sqrt(2.0)


def from_opponent(light: Column, alpha: Column, beta: Column) -> tuple[Column, Column, Column]:
    """Blue, green and red, 0..255; null gives black."""
    p, q, s = light / math.sqrt(3.0), alpha / math.sqrt(6.0), beta / math.sqrt(2.0)
    cones = [F.coalesce(F.pow(F.lit(10.0), v), F.lit(0.0)) for v in (p + q + s, p + q - s, p - q * 2.0)]
    red, green, blue = (to_u8((cones[0] * w[0] + cones[1] * w[1] + cones[2] * w[2]) * 255.0) for w in COLOURS)
    return blue, green, red


# Gray levels from which a pixel seeds an object, and from which it may belong to one.
SEED_LEVEL, MASK_LEVEL = 80, 45


def seed_and_mask(x: Column, seed: int = SEED_LEVEL, mask: int = MASK_LEVEL) -> tuple[Column, Column]:
    """Whether a pixel is over the upper and over the lower of two levels."""
    return x > seed, x > mask


def divide(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))
