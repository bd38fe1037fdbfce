"""Column functions on capture times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_from_civil(y: Column, mo: Column, d: Column) -> Column:
    """Days since 0000-03-01 of a date that is not validated."""
    yy = F.when(mo <= 2, y - 1).otherwise(y)
    m = F.when(mo <= 2, mo + 9).otherwise(mo - 3)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((m * 153 + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy


def parse_exif_time(s: Column) -> Column:
    """Seconds since 0000-03-01 from the first six runs of digits; null with fewer."""
    n = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))
    y, mo, d, h, mi, sec = (n[k] for k in range(6))
    t = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + sec
    return F.when(F.size(n) >= 6, t.cast("double"))


def sub_second(digits: Column) -> Column:
    """A fraction of a second from its digits; 0 if they are none."""
    return F.coalesce(F.concat(F.lit("0."), digits).try_cast("double"), F.lit(0.0))
