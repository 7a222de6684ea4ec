"""Numbers from anything, text steps, and the registry of column codecs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.calendars import lenient_date, lenient_instant


def to_double(c: Column, default: float | None = 0.0, *, keep_infinite: bool = False) -> Column:
    """A number or its text as double; what does not parse or is not finite is the default."""
    d = F.trim(c.cast("string")).try_cast("double")
    bad = d.isNull() if keep_infinite else d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(d)


def to_double_low(c: Column) -> Column:
    """As ``to_double``, with a very low default."""
    return to_double(c, -1e300)


def to_float(c: Column, default: float | None = 0.0, *, keep_infinite: bool = False) -> Column:
    """As ``to_double``, as float."""
    return to_double(c, default, keep_infinite=keep_infinite).cast("float")


def to_float_low(c: Column) -> Column:
    """As ``to_float``; the low default is minus infinity as a float."""
    return to_double_low(c).cast("float")


def padded(c: Column, width: int) -> Column:
    """Text in a field of ``width``."""
    return F.rpad(c, width, " ")


def choose(condition: Column, value: Column) -> Column:
    """The value where the condition holds, else null."""
    return F.when(condition, value)


def span(low: Column, high: Column) -> Column:
    """Distance of two ends."""
    return high - low


def fibonacci(n: int, a: int = 0, b: int = 1) -> int:
    """The n-th number of the series that begins with a, b."""
    for _ in range(n):
        a, b = b, a + b
    return a


@dataclass
class Codec:
    """How a type is stored in a record and read from text.

    ``size``: bytes in a binary record (None: set by the column).  ``dtype``: numpy
    type of the stored field.  ``text``: column expression from trimmed text.
    ``load``/``store``: between the stored array and Arrow-ready values.
    """

    spark: str
    size: int | None
    dtype: str | None
    text: Callable[[Column], Column]
    load: Callable[[np.ndarray], np.ndarray] = field(default=lambda a: a)
    store: Callable[[np.ndarray], np.ndarray] = field(default=lambda a: a)


def _byte(c: Column) -> Column:
    n = c.cast("int")
    return F.when(n > 127, n - 256).otherwise(n).cast("byte")


# Type names and sizes of the record format. Further types may be added.
CODECS: dict[str, Codec] = {
    "IoBoolean": Codec("boolean", 1, "u1", lambda c: c.cast("boolean")),
    "IoByte": Codec("tinyint", 1, "i1", _byte),
    "IoInt": Codec("int", 4, ">i4", lambda c: F.coalesce(c.try_cast("int"), F.lit(0))),
    "IoLong": Codec("bigint", 8, ">i8", lambda c: c.cast("bigint")),
    "IoFloat": Codec("float", 4, ">f4", lambda c: c.cast("float")),
    "IoDouble": Codec("double", 8, ">f8", lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))),
    "IoString": Codec("string", None, None, lambda c: c),
    "IoLocalDate": Codec("date", 8, ">i8", lenient_date),
    "IoInstant": Codec("timestamp", 12, None, lenient_instant),
}


def codec_for(spark_type: str) -> str:
    """The type name that stores a Spark type."""
    for name, c in CODECS.items():
        if c.spark == spark_type:
            return name
    raise ValueError(f"no record type stores {spark_type}")
