"""Numbers as text: amounts with the digits that matter, and money with separators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(amount: Column, places: int) -> Column:
    """A double as a decimal of so many places, 10 at most, by its product with their power of ten: digits that this product has none for do not decide a half.

    So does SQL's cast in DuckDB, while Spark's takes the shortest text of the double. Amounts of 1e17 and more (1e19 for 8 places) are cast as Spark does.
    """
    size, half = F.abs(amount.cast("double") * 10.0**places), 1 << 52
    below = size - size % 1.0
    units = F.signum(amount.cast("double")) * (below + F.when(size - below >= 0.5, 1.0).otherwise(0.0))  # halves go away from zero
    high = F.floor(units / half)  # both parts are whole and exact in a double
    low = (units - high * float(half)).cast("long").cast("decimal(17,0)")
    whole = (high.cast("decimal(12,0)") * F.lit(half).cast("decimal(16,0)") + low).cast("decimal(27,0)")
    near = F.abs(units) < 1e27
    return F.when(near, (whole * F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places},{places})")).cast(f"decimal(38,{places})")).otherwise(F.when(~near, amount.cast(f"decimal(38,{places})")))


def fixed(amount: Column, decimals: int) -> Column:
    """With so many decimals, 10 at most, and without separators."""
    return exact(amount, 10).cast(f"decimal(38,{decimals})").cast("string")


def smart(amount: Column) -> Column:
    """Two decimals, or for less than a hundredth as many as show two digits, 10 at most; zero is 0.00."""
    size = F.abs(amount)
    places = F.least(F.ceil(-F.log10(size)) + 1, F.lit(10))
    small = F.coalesce(*(F.when(places == k, fixed(amount, k)) for k in range(2, 11)))
    return F.when(amount == 0, "0.00").when(size >= 0.01, fixed(amount, 2)).otherwise(small)


def amount_of(amount: Column, decimals: Column) -> Column:
    """With a commodity's own number of decimals (10 at most), unless that would show nothing of an amount that is not zero."""
    own = F.coalesce(*(F.when(decimals == k, fixed(amount, k)) for k in range(11)))
    return F.when(own.isNull() | ((amount != 0) & (own.cast("double") == 0)), smart(amount)).otherwise(own)


def money(amount: Column, decimals: int = 2) -> Column:
    """With thousands separators and so many decimals; minus zero is zero."""
    return F.format_number(F.when(amount == 0, 0.0).otherwise(amount).cast("decimal(38,10)"), decimals)
