"""Scalar expressions: saturation, fractions, quantisation, sequences."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The integer storage codes with their bounds.
BOUNDS = {
    "b": (-(1 << 7), (1 << 7) - 1), "B": (0, (1 << 8) - 1), "h": (-(1 << 15), (1 << 15) - 1), "H": (0, (1 << 16) - 1),
    "i": (-(1 << 31), (1 << 31) - 1), "I": (0, (1 << 32) - 1), "q": (-(1 << 63), (1 << 63) - 1), "Q": (0, (1 << 63) - 1),
}
#: The Spark type that holds each code; there are no unsigned types, and positions are the only 64-bit unsigned values.
TYPES = {"b": "tinyint", "B": "smallint", "h": "smallint", "H": "int", "i": "int", "I": "bigint", "q": "bigint", "Q": "bigint", "f": "float", "d": "double", "c": "string"}


def clamp(value: Column, code: str) -> Column:
    """``value`` saturated at the bounds of a storage code; null stays null."""
    low, high = BOUNDS[code]
    return F.when(value < F.lit(low), F.lit(low)).when(value > F.lit(high), F.lit(high)).otherwise(value)


def fraction(mc: Column, cov: Column) -> Column:
    """mc/cov, 0 where nothing covers the site; null counts give null."""
    return F.when(cov > 0, mc / cov).when(cov.isNotNull() & mc.isNotNull(), 0.0)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def quantize(value: Column, bits: int, low: float, high: float) -> Column:
    """The level, 0 to 2^bits - 1, nearest to ``value`` within [low, high], halves to even; null and NaN are the lowest level."""
    inside = F.least(F.greatest(F.nanvl(F.coalesce(value, F.lit(low)), F.lit(low)), F.lit(low)), F.lit(high))
    return F.rint((inside - low) / (high - low) * ((1 << bits) - 1)).cast("int")


def dequantize(level: Column, bits: int, low: float, high: float) -> Column:
    return level / ((1 << bits) - 1) * (high - low) + low


def quantization(message: str | None) -> dict[str, tuple[str, float, float]]:
    """Storage code and bounds of each quantised column, from a table's message; empty where it tells none."""
    try:
        told = json.loads(message or "")["quant"]
        return {c: (str(code), float(low), float(high)) for c, (code, low, high) in told.items()}
    except (ValueError, TypeError, KeyError, AttributeError):
        return {}


def context_is(context: Column, strand: Column, pattern: str) -> Column:
    """Whether a site matches a pattern such as ``CGN``, ``+CGN``, ``-CHN`` or any other of IUPAC letters."""
    sign, letters = (pattern[0], pattern[1:]) if pattern[:1] in "+-" else ("", pattern)
    # IUPAC letters.
    iupac = {"A": "A", "C": "C", "G": "G", "T": "T", "N": ".", "H": "[ACT]", "B": "[CGT]", "D": "[AGT]", "V": "[ACG]", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]"}
    hit = F.upper(context).rlike("^" + "".join(iupac[x] for x in letters.upper()) + "$")
    return hit & (strand == sign) if sign else hit
