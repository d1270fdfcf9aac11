"""Energy certificates: text columns to typed columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable import schemas
from gable.functions import numeric, temporal, text
from gable.operators.normalise import INTENDED, REFERENCE


NUMBERS = ("int", "bigint", "decimal")


def _typed(source: Column, kind: str, mode: str) -> Column:
    if kind == "key":
        return F.coalesce(source, F.lit(""))
    if kind == "text":
        return text.blank_to_null(source)
    if kind == "rating":
        return text.rating(source)
    if kind == "date":
        return temporal.parsed_date(source)
    if kind == "datetime":
        # Existing tables keep only values without a time part.
        if mode == INTENDED:
            return temporal.parsed_datetime(source)
        return temporal.midnight(temporal.parsed_date(source))
    return numeric.number_of(source, kind)


def typed(raw: DataFrame, mode: str = REFERENCE) -> DataFrame:
    """All certificate fields under their stored name and type.

    Numbers are parsed in steps, each a projection of its own, so that no step is
    evaluated again for every use of its result.
    """
    missing = set(schemas.CERTIFICATE_HEADERS) - set(raw.columns)
    if missing:
        raise ValueError(f"certificate headers missing: {sorted(missing)}")
    fields = [(f, k, schemas.CERTIFICATE_RENAMES.get(f, f)) for f, k in schemas.CERTIFICATE_FIELDS]
    trimmed = raw.select(
        *[
            (numeric.number_text(F.col(f.upper()), k) if k.startswith(NUMBERS) else F.col(f.upper())).alias(name)
            for f, k, name in fields
        ]
    )
    parsed = trimmed.select(*[_typed(F.col(name), k, mode).alias(name) for _, k, name in fields])
    return parsed.withColumns({name: numeric.narrowed(F.col(name)) for _, k, name in fields if k == "int"})
