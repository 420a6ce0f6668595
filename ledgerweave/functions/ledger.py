"""Column expressions of the ledger's spelling and units."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
VALUE_CAP = 1e8
MONEY = "decimal(20,6)"


def address(col: Column | str) -> Column:
    """The last 40 hex digits in lower case; null for null and for an empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.right(F.when(c != "", c), F.lit(40)))


def tx_hash(col: Column | str) -> Column:
    """The last 64 hex digits in lower case; null for null and for an empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.right(F.when(c != "", c), F.lit(64)))


def utc_day(ms: Column | str) -> Column:
    """The UTC date of a time in milliseconds since 1970; null for null."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.date_from_unix_date(F.floor(c / DAY_MS).cast("int"))


def usable_amount(value: Column | str, cap: float = VALUE_CAP) -> Column:
    """The amount as an exact decimal where 0 < value <= cap, else null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when((c > 0) & (c <= cap), c.cast(MONEY))
