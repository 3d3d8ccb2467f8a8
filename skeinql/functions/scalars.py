"""Math, null handling, conversion and calendar functions by their PL/SQL names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: x if isinstance(x, Column) else F.lit(x)


def trunc(x, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * scale) / scale


def sqrt(x) -> Column:
    """An error for a negative number."""
    return F.when(_c(x) < 0, F.raise_error(F.lit("SQRT of a negative number")).cast("double")).otherwise(F.sqrt(_c(x)))


def mod(a, b) -> Column:
    return F.when(_c(b) == 0, F.raise_error(F.lit("MOD by zero")).cast("long")).otherwise(_c(a) % F.nullif(_c(b), F.lit(0)))


def decode(x, *pairs) -> Column:
    """DECODE(x, search, result, ..., default): null equals null."""
    default = pairs[-1] if len(pairs) % 2 else None
    out = None
    for search, result in zip(pairs[0::2], pairs[1::2]):
        out = (F if out is None else out).when(_c(x).eqNullSafe(_c(search)), _c(result))
    return out.otherwise(_c(default))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


SCALAR_FUNCTIONS = {
    "ABS": lambda x: F.abs(_c(x)),
    "CEIL": lambda x: F.ceil(_c(x)),
    "FLOOR": lambda x: F.floor(_c(x)),
    "ROUND": lambda x, d=0: F.round(_c(x), d),
    "TRUNC": trunc,
    "POWER": lambda x, y: F.pow(_c(x), _c(y)),
    "SQRT": sqrt,
    "MOD": mod,
    "SIGN": lambda x: F.signum(_c(x)),
    "TO_CHAR": lambda x, fmt=None: _c(x).cast("string") if fmt is None else F.date_format(_c(x), fmt) if re.search("[yMdHms]", fmt) else F.to_char(_c(x), F.lit(fmt)),
    "TO_NUMBER": lambda s: _c(s).cast("double"),
    "TO_DATE": lambda s, fmt=None: F.to_date(_c(s), fmt) if fmt else F.to_date(_c(s)),
    "NVL": lambda x, y: F.coalesce(_c(x), _c(y)),
    "NVL2": lambda x, a, b: F.when(_c(x).isNotNull(), _c(a)).otherwise(_c(b)),
    "COALESCE": lambda *xs: F.coalesce(*[_c(x) for x in xs]),
    "NULLIF": lambda x, y: F.nullif(_c(x), _c(y)),
    "DECODE": decode,
    "GREATEST": lambda *xs: F.greatest(*[_c(x) for x in xs]),
    "LEAST": lambda *xs: F.least(*[_c(x) for x in xs]),
    "CURRENT_DATE": F.current_date,
    "SYSDATE": F.current_timestamp,
    "CURRENT_TIMESTAMP": F.current_timestamp,
}
