"""Reads of known origin: replaced bases, gained and lost codons, windows, and reads of no origin at all.

Chance is a digest of a key, a name and a place, so a column of any length gives the same reads again, on any number of
machines, and in any engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def chance(key: Column, name: str, place: Column | None = None) -> Column:
    """Hexadecimal digits, each as likely as any other."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(name), *([] if place is None else [place.cast("string")])).cast("binary"))


def number(digits: Column, below: Column | int) -> Column:
    """A whole number from 0 on, below another one, from the first seven digits."""
    below = F.lit(below) if isinstance(below, int) else below
    return (F.conv(F.substring(digits, 1, 7), 16, 10).cast("long") % F.greatest(below, F.lit(1))).cast("int")


def replaced(sequence: Column, key: Column, share: float) -> Column:
    """Each base is another one with this chance; letters other than ACGT stay."""
    bar = f"{min(65536, round(share * 65536)):05x}"

    def base(c: Column, i: Column) -> Column:
        digits = chance(key, "replace", i)
        others = F.replace(F.lit("ACGT"), c, F.lit(""))
        other = F.substring(others, F.pmod(F.instr(F.lit(HEX), F.substring(digits, 5, 1)), F.lit(3)) + 1, F.lit(1))
        return F.when((F.concat(F.lit("0"), F.substring(digits, 1, 4)) < bar) & c.isin("A", "C", "G", "T"), other).otherwise(c)

    return F.array_join(F.transform(F.split(sequence, ""), base), "")


def codon_shift(sequence: Column, key: Column) -> Column:
    """Three bases more or three fewer at some place; what is shorter than four bases gains them."""
    digits = chance(key, "shift")
    at = number(digits, F.length(sequence) - 2) + 1
    more = F.translate(F.substring(digits, 8, 3), HEX, "ACGT" * 4)
    fewer = (F.substring(digits, 11, 1) < "8") & (F.length(sequence) > 3)
    return F.concat(F.substring(sequence, F.lit(1), at - 1), F.when(fewer, "").otherwise(more), F.substring(sequence, at + F.when(fewer, 3).otherwise(0), F.greatest(F.length(sequence), F.lit(1))))


def window(sequence: Column, key: Column, length: int) -> Column:
    """So many bases from some place on; all of a shorter sequence."""
    return F.substring(sequence, number(chance(key, "window"), F.length(sequence) - length + 1) + 1, F.lit(length))


def random_read(key: Column, length: int) -> Column:
    parts = [F.translate(chance(key, "read", F.lit(i)), HEX, "ACGT" * 4) for i in range(-(-length // 32))]
    return F.substring(F.concat(*parts), 1, length)
