"""Vector arithmetic on array columns, accumulated in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.functions.text import strip

# Fixed value: weight used when none can be read.
DEFAULT_WEIGHT = 0.2

_DIGITS = "[0-9]+(_[0-9]+)*"
_NUMBER = rf"(?i)^[+-]?({_DIGITS}\.?({_DIGITS})?(e[+-]?{_DIGITS})?|\.{_DIGITS}(e[+-]?{_DIGITS})?|inf(inity)?|nan)$"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; inside a lambda over the elements
    it would be evaluated for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """Scale to unit length; a zero length counts as one."""

    def scaled(n: Column) -> Column:  # the length is worked out once, its tests are cheap
        divisor = F.when(n == 0.0, F.lit(1.0)).otherwise(F.coalesce(n, F.lit(1.0)))
        return F.transform(v, lambda x: x.cast("double") / divisor)

    return F.when(v.isNotNull(), let(norm(v), scaled))


def blend(q: Column, c: Column, weight: Column) -> Column:
    def mixed(w: Column) -> Column:
        return F.zip_with(q, c, lambda x, y: (F.lit(1.0) - w) * x.cast("double") + w * y.cast("double"))

    return let(weight, mixed)


def to_float32(v: Column) -> Column:
    return v.cast("array<float>")


def clamp_weight(text: Column) -> Column:
    """Read a weight: 0.2 when it is no number, then held within 0 and 1 (NaN gives 1)."""
    plain = strip(text)
    number = F.when(plain.rlike(_NUMBER), F.regexp_replace(plain, "_", "").try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(DEFAULT_WEIGHT))))
