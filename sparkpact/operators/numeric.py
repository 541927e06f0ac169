"""Exact rules on number columns, as JVM expressions without text or rounding.

A double (or float) stands for the shortest decimal text that names it. That text grows with the
number, so a bound splits the doubles at the double nearest to it; which side that one is on is
settled on the driver. NaN and the infinities are no JSON numbers: they break `type`, and
no other rule. Integers and decimals are compared with the bound as scaled integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import Num

#: Larger numbers than any decimal column holds.
_HUGE = 10**45
#: Below these, a whole number of units of a double (a float) has the digits that its text keeps.
_SAFE = {T.DoubleType: 10**15, T.FloatType: 10**6}


def _scaled(n: Num, s: int) -> tuple[int, int]:
    """Floor and ceiling of n * 10**s, cut off at numbers that no column reaches."""
    if n.digits == "0":
        return 0, 0
    size = n.mag + s
    if size > 45:
        return (-_HUGE, -_HUGE) if n.sign else (_HUGE, _HUGE)
    if size <= 0:
        return (-1, 0) if n.sign else (0, 1)
    whole, e = int(n.sign + n.digits), n.exp + s
    return (whole * 10**e,) * 2 if e >= 0 else (whole // 10**-e, -(-whole // 10**-e))


class Number:
    """A number column and its rules."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind
        self.binary = isinstance(kind, (T.DoubleType, T.FloatType))
        self.scale = kind.scale if isinstance(kind, T.DecimalType) else 0

    @property
    def finite(self) -> Column:
        """False for what is no JSON number."""
        if not self.binary:
            return F.lit(True)
        # NaN is above every number
        return F.abs(self.column) <= self._literal(float(np.finfo(self._numpy).max))

    @property
    def _numpy(self) -> type:
        return np.float32 if isinstance(self.kind, T.FloatType) else np.float64

    def _literal(self, x: float) -> Column:
        return F.lit(x).cast(self.kind)

    def _nearest(self, n: Num) -> tuple[float, int]:
        """The column's number nearest to n, and -1, 0 or 1 as its text is below, at or above n."""
        with np.errstate(over="ignore"):
            near = self._numpy(float(n.lexeme)) if self._numpy is np.float64 else _to_float(n)
        if np.isinf(near):
            return float(near), 1 if near > 0 else -1
        return float(near), Num.parse(str(near)).compare(n)

    def below(self, n: Num, or_at: bool) -> Column:
        """Whether the number is below n (or at it)."""
        if self.binary:
            near, side = self._nearest(n)
            with_it = side < 0 or side == 0 and or_at
            x = self._literal(near)
            return self.column <= x if with_it else self.column < x
        low, high = _scaled(n, self.scale)
        return self._units_at_most(low if or_at else high - 1)

    def above(self, n: Num, or_at: bool) -> Column:
        if self.binary:
            near, side = self._nearest(n)
            with_it = side > 0 or side == 0 and or_at
            x = self._literal(near)
            return self.column >= x if with_it else self.column > x
        low, high = _scaled(n, self.scale)
        return ~self._units_at_most(high - 1 if or_at else low)

    def _units_at_most(self, units: int) -> Column:
        """Whether the number is at most units * 10**-scale."""
        if isinstance(self.kind, T.DecimalType):
            if abs(units) >= 10**38:
                return F.lit(units > 0)
            return self.column <= F.lit(Num.parse(f"{units}e{-self.scale}").lexeme).cast(f"decimal(38,{self.scale})")
        if not -(2**63) <= units < 2**63:
            return F.lit(units > 0)
        return self.column <= F.lit(units).cast("bigint")

    def is_integer(self) -> Column:
        if self.binary:
            return F.rint(self.column).cast(self.kind) == self.column
        return self.column == F.floor(self.column) if self.scale else F.lit(True)

    def equals(self, n: Num) -> Column:
        if self.binary:
            near, side = self._nearest(n)
            return self.column == self._literal(near) if side == 0 else F.lit(False)
        low, high = _scaled(n, self.scale)
        return self._units_at_most(low) & ~self._units_at_most(low - 1) if low == high else F.lit(False)

    def is_multiple_of(self, n: Num) -> Column:
        """Whether the number, as its text spells it, is a whole multiple of n."""
        digits = int(n.digits)
        if self.binary:
            return self._binary_multiple(n, digits)
        text = F.replace(self.column.cast("string"), F.lit("."), F.lit("")) if self.scale else self.column
        units = text.cast("decimal(38,0)")
        power = -self.scale - n.exp  # units * 10**power has to be a multiple of digits
        if power < 0:
            of = digits * 10**-power if -power < 60 else _HUGE
            return units == 0 if of >= 10**38 else units % F.lit(str(of)).cast("decimal(38,0)") == 0
        return _divides(units, power, digits)

    def _binary_multiple(self, n: Num, digits: int) -> Column:
        x = self.column
        s, unit = max(0, -n.exp), digits * 10 ** min(max(0, n.exp), 60)
        # digits and exponent of the text, for numbers that are not a safe count of 10**-s: the fewest digits that name it
        sizes = (6, 7, 8, 9) if self._numpy is np.float32 else (15, 16, 17)
        spelled = [F.format_string(f"%.{p - 1}e", F.abs(x)) for p in sizes]
        text = F.coalesce(*[F.when(t.try_cast(self.kind) == F.abs(x), t) for t in spelled])
        mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1).try_cast("int")
        part = F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0"))
        whole = F.concat(F.substring_index(mantissa, ".", 1), part)
        stripped = F.rtrim(whole, F.lit("0"))
        exponent = power - F.length(part) + F.length(whole) - F.length(stripped)
        slow = F.when(x == 0, True).when(exponent < n.exp, False).otherwise(_divides(stripped.try_cast("decimal(38,0)"), exponent - F.lit(n.exp), digits))
        safe = _SAFE[type(self.kind)]
        if s > 22 or unit >= 2**63:
            return slow
        ten = F.lit(10.0**s)
        count = F.rint(x.cast("double") * ten)
        quick = ((count / ten).cast(self.kind) == x) & (count.try_cast("bigint") % F.lit(unit).cast("bigint") == 0)
        return F.when(F.abs(count) < float(safe), quick).otherwise(slow)


def _to_float(n: Num) -> np.float32:
    """The float nearest to n; halfway cases of the double nearest to n are settled by n itself."""
    near = np.float32(float(n.lexeme))
    double = float(n.lexeme)
    if np.isinf(near) or math.isinf(double):
        return near
    for other in (np.nextafter(near, np.float32(-np.inf)), np.nextafter(near, np.float32(np.inf))):
        middle = (float(near) + float(other)) / 2
        if math.isfinite(middle) and double == middle:
            side = Num.parse(repr(middle)).compare(n)
            if side and (side < 0) == (other > near):
                return other
    return near


def _divides(units: Column, power: int | Column, digits: int) -> Column:
    """Whether units * 10**power is a multiple of digits: units of what is left of it without its factors in 10**power."""
    left = [digits]
    while (rest := math.gcd(left[-1], 10)) > 1:
        left.append(left[-1] // rest)
    wide = "decimal(38,0)"
    # no column has units as large as these
    listed = [F.lit(str(x) if x < 10**38 else None).cast(wide) for x in left]
    of = listed[min(power, len(left) - 1)] if isinstance(power, int) else F.element_at(F.array(*listed), F.least(power, F.lit(len(left) - 1)).cast("int") + 1)
    return F.coalesce(units % of == 0, units == 0)
