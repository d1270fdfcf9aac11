"""Number columns: parsing, rounding, percent change."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gable import fixed
from gable.functions.text import SPACES, is_ascii, unpadded


def number_text(text: Column, kind: str) -> Column:
    """The trimmed text of a number, to be given to `number_of`.

    ASCII text is only trimmed. Text with other characters, whose white space and digits
    are a matter of their own, is searched for the whole layout.
    """
    layout = fixed.DECIMAL_NUMBER if kind.startswith("decimal") else fixed.WHOLE_NUMBER
    return F.when(is_ascii(text), F.btrim(text, F.lit(SPACES))).otherwise(unpadded(text, layout))


def number_of(plain: Column, kind: str) -> Column:
    """The number in a trimmed text, null when it does not parse or fit; `int` comes as bigint.

    Casts accept the layouts of numbers and little else. One that fails costs far more
    than a test, so the first and the last character must belong to a number: the range
    is from + to 9, or from the point to 9, in ASCII.
    """
    decimal = kind.startswith("decimal")
    fits = F.ascii(plain).between(43, 57) & F.ascii(F.right(plain, F.lit(1))).between(46 if decimal else 48, 57)
    if not decimal:
        fits = fits & ~F.contains(plain, F.lit("."))
    return F.when(fits, plain).try_cast(kind if decimal else "bigint")


def narrowed(whole: Column) -> Column:
    """A bigint as int, null where it does not fit."""
    return F.when(whole.between(-(2**31), 2**31 - 1), whole.cast("int"))


def parsed_number(text: Column, kind: str) -> Column:
    """All steps in one expression. Many columns are better parsed step by step, each a projection."""
    number = number_of(number_text(text, kind), kind)
    return narrowed(number) if kind == "int" else number


def percent_change(now: Column, before: Column) -> Column:
    """Null when either side is missing or the earlier value is zero."""
    return (F.try_divide(now, before) - 1) * 100


def rounded(value: Column) -> Column:
    """Two decimals, ties judged on the exact binary value and sent to even.

    The fraction of a double is an exact multiple of 2**-56 from 1/8 upwards, so
    whole-number arithmetic decides which side of a tie the value lies on. For
    smaller values, Spark's own half-even rounding applies.
    """
    scale, half = 1 << 56, 1 << 55
    whole = F.floor(value)
    fraction = ((value - whole) * F.lit(float(scale))).cast("bigint") * F.lit(100).cast("bigint")
    cents = F.shiftright(fraction, 56)
    rest = fraction.bitwiseAND(F.lit(scale - 1))
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    exact = (whole * 100 + cents + F.when(up, 1).otherwise(0)).cast("double") / 100
    return F.when((value >= 0.125) & (value < 1e13), exact).otherwise(F.bround(value, 2))
