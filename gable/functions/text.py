"""Text columns: postcodes, identifiers, flags and blank handling."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gable import fixed


def postcode_is_valid(postcode: Column) -> Column:
    return F.coalesce(postcode.rlike(fixed.POSTCODE_PATTERN), F.lit(False))


def postcode_parts(postcode: Column) -> Column:
    """Struct of area, outcode and sector of a valid postcode.

    One replacement pulls all groups out in a single pass over the text; groups
    that took no part in the match come back empty.
    """
    split = F.split(
        F.regexp_replace(postcode, fixed.POSTCODE_PATTERN, "$1$4$6$8$10|$2$5$7$9$11|$3$12"), r"\|"
    )
    area, district, digit = (F.get(split, F.lit(i)) for i in range(3))
    return F.struct(
        area.alias("area"),
        F.concat(area, district).alias("outcode"),
        F.concat(area, district, F.lit(" "), digit).alias("sector"),
    )


def house_id(paon: Column, saon: Column, postcode: Column) -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce(paon, blank), F.coalesce(saon, blank), postcode)


def without_ends(text: Column) -> Column:
    """Drop the first and the last character."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


def flag_is(flag: Column, code: str) -> Column:
    return F.coalesce(flag == code, F.lit(False))


def yes_no(flag: Column) -> Column:
    return F.when(flag == "Y", True).when(flag == "N", False)


def unpadded(text: Column, layout: str) -> Column:
    """The text without surrounding white space if it has the layout, else null."""
    return F.nullif(F.regexp_extract(text, fixed.PADDED.format(layout), 1), F.lit(""))


#: ASCII white space.
SPACES = " \t\n\x0b\x0c\r"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def blank_to_null(text: Column) -> Column:
    """Null for blank text; other text is kept untrimmed.

    Text that starts, spaces aside, with a printable ASCII character is settled
    by comparison; only the rest is searched.
    """
    plain = F.ltrim(text).between("!", "~")
    return F.when(plain | text.rlike(fixed.NOT_BLANK), text)


def rating(text: Column) -> Column:
    return F.upper(unpadded(text, fixed.RATING))


def data_id(area_type: Column, area: Column, start: Column, end: Column) -> Column:
    """Key of a statistic's input: capitals, no spaces."""
    text = F.concat(area_type, F.lit("_"), area, F.lit(":"), _moment(start), F.lit("-"), _moment(end))
    return F.upper(F.replace(text, F.lit(" "), F.lit("")))


def _moment(moment: Column) -> Column:
    """ISO text of a timestamp, with microseconds only when there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    part = F.date_format(moment, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))
