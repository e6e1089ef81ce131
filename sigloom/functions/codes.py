"""128-bit codes as two signed 64-bit lanes, ``hi`` and ``lo``.

Bit 0 is the lowest of ``lo``. Nothing here needs a UDF: distances are two xors and
two population counts, which whole-stage code generation turns into machine code.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 128


def lanes_of_hex(text: Column) -> tuple[Column, Column]:
    """Lanes of a hexadecimal string of at most 32 digits; other strings are an error in
    ANSI mode, so validate first."""
    padded = F.lpad(text, 32, "0")
    return tuple(F.conv(F.substring(padded, at, 16), 16, -10).cast("long") for at in (1, 17))


def hex_of_lanes(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def lanes_of_int(code: int) -> tuple[int, int]:
    """Both lanes of a Python number, signed."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    return signed(code >> 64 & (1 << 64) - 1), signed(code & (1 << 64) - 1)


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def field(hi: Column, lo: Column, shift: int, width: int) -> Column:
    """Bits shift .. shift + width - 1 as a number; width at most 64."""
    if shift >= 64:
        out = F.shiftrightunsigned(hi, shift - 64)
    elif shift + width <= 64:
        out = F.shiftrightunsigned(lo, shift)
    else:
        out = F.shiftrightunsigned(lo, shift).bitwiseOR(F.shiftleft(hi, 64 - shift))
    return out if width == 64 else out.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bands(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m bands that cover the code, from the lowest bit; widths differ by
    one at most, wider ones first."""
    if not 1 <= m <= BITS:
        raise ValueError("a code has 1 to 128 bands")
    wide, out, at = BITS % m, [], 0
    for k in range(m):
        width = BITS // m + (k < wide)
        out.append((at, width))
        at += width
    return out


def flips(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set, fewest first."""
    return [sum(1 << b for b in at) for k in range(min(radius, width) + 1) for at in combinations(range(width), k)]


def suggest_m(n: int) -> int:
    """The customary number of bands for n codes: 128 / log2(n), within 6 and 16."""
    return 6 if n < 2 else min(16, max(6, BITS // max(1, math.ceil(math.log2(n)))))


def thresholds(radius: int, m: int) -> list[int]:
    """Of each band the flips to look up, -1 for none at all: codes within the radius keep
    to it in one band at least, since to pass all of them takes radius + 1 bits. Wide bands,
    where a flip more costs most keys, get the smaller ones."""
    t = radius // m
    more = radius - m * t + 1
    return [t - 1] * (m - more) + [t] * more


def len_flips(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(min(radius, width) + 1))


def permutations(n: int, seed: int) -> list[list[int]]:
    """n shuffles of the bit positions, the same for the same seed."""
    if n <= 0:
        raise ValueError("n must be positive")
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        order = list(range(BITS))
        draw.shuffle(order)
        out.append(order)
    return out


def permuted_prefix(hi: Column, lo: Column, order: list[int], bits: int) -> Column:
    """The highest ``bits`` bits of the permuted code, where its bit i is bit order[i]."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(field(hi, lo, order[BITS - bits + k], 1), k))
    return out


def cosine_of_radius(radius: Column, bits: int = BITS) -> Column:
    """The cosine that an expected distance of ``radius`` sign bits stands for."""
    return F.cos(F.lit(math.pi) * radius / bits)
