"""256-bit unsigned numbers as 32 bytes, most significant first, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL_ONES = "FF" * 32
_MASK = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def limbs(column: Column) -> list[Column]:
    """The eight 32-bit limbs of 32 bytes, lowest first, as longs."""
    return [F.conv(F.hex(F.substring(column, 29 - 4 * k, 4)), 16, 10).cast("long") for k in range(8)]


def limbs_to_bytes(parts: Column, over: Column | None = None) -> Column:
    """Eight sums of limbs, carried over, as 32 bytes; what overflows is the largest number."""
    carried = F.aggregate(
        parts,
        F.struct(_long(0).alias("carry"), F.lit("").alias("hex")),
        lambda a, x: F.struct(
            F.shiftright(a["carry"] + x, 32).alias("carry"),
            F.concat(F.lpad(F.hex((a["carry"] + x).bitwiseAND(_long(_MASK))), 8, "0"), a["hex"]).alias("hex"),
        ),
    )
    full = carried["carry"] > 0
    return F.unhex(F.when(full if over is None else full | over, F.lit(_ALL_ONES)).otherwise(carried["hex"]))


def decimal_to_bytes(text: Column) -> Column:
    """A string of at most 81 decimal digits: nine digits at a time are multiplied in."""
    digits = F.lpad(text, 81, "0")
    groups = F.array(*(F.substring(digits, 9 * k + 1, 9).cast("long") for k in range(9)))

    def multiply(acc: Column, group: Column) -> Column:
        step = F.aggregate(
            acc["limbs"],
            F.struct(group.alias("carry"), F.array().cast("array<bigint>").alias("out")),
            lambda a, x: F.struct(
                F.shiftright(x * _long(10**9) + a["carry"], 32).alias("carry"),
                F.concat(a["out"], F.array((x * _long(10**9) + a["carry"]).bitwiseAND(_long(_MASK)))).alias("out"),
            ),
        )
        return F.struct(step["out"].alias("limbs"), (acc["over"] | (step["carry"] > 0)).alias("over"))

    total = F.aggregate(groups, F.struct(F.array(*[_long(0)] * 8).alias("limbs"), F.lit(False).alias("over")), multiply)
    return limbs_to_bytes(total["limbs"], total["over"])


def divide(total: Column, n: Column) -> Column:
    """Integer division of 32 bytes by a long below 2^47, by hand: sixteen digits of 16 bits, highest first. Null by 0."""
    text = F.hex(total)
    digits = F.array(*(F.conv(F.substring(text, 4 * k + 1, 4), 16, 10).cast("long") for k in range(16)))

    def step(a: Column, digit: Column) -> Column:
        now = a["rest"] * _long(1 << 16) + digit
        rest = now % n
        # a whole number below 2^16: rounding takes off what doubles add to it
        return F.struct(rest.alias("rest"), F.concat(a["hex"], F.lpad(F.hex(F.round((now - rest) / n).cast("long")), 4, "0")).alias("hex"))

    out = F.aggregate(digits, F.struct(_long(0).alias("rest"), F.lit("").alias("hex")), step)
    return F.when(n > 0, F.unhex(out["hex"]))
