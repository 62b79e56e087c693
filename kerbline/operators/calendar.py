"""Calendar columns of an hour."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refdata as R


def calendar(rows: DataFrame, hour_column: str = "target_hour") -> DataFrame:
    """Adds hour, day_of_week (Monday 0), month, day_of_year, flags, cycles, hour bucket and the micro-windows."""
    t = F.col(hour_column)
    rows = rows.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "day_of_year": F.dayofyear(t)})
    hour, dow, month = F.col("hour"), F.col("day_of_week"), F.col("month")
    weekend, day = dow >= 5, F.to_date(t).cast("string")
    flag = lambda c: c.cast("int")
    out = {"is_weekend": flag(weekend), "is_peak": flag(hour.isin(*R.PEAK))}
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        out |= {f"{name}_sin": F.sin(2 * math.pi * value / period), f"{name}_cos": F.cos(2 * math.pi * value / period)}
    out |= {
        "day_of_year_norm": F.col("day_of_year") / 365.0,
        "is_weekday_peak": flag(~weekend & hour.isin(*R.PEAK)),
        "is_weekend_peak": flag(weekend & hour.isin(*R.WEEKEND_PEAK)),
        "hour_bucket": R.lookup(hour, R.HOUR_BUCKET, "midday"),
        "is_holiday": flag(day.isin(*R.HOLIDAYS)),
        "is_festival": flag(day.isin(*R.FESTIVALS)),
        "is_first_week_of_month": flag(F.day(t) <= 7),
        "is_month_end": flag(F.day(F.last_day(t)) - F.day(t) <= 3),
    }
    for name, (hours, weekdays) in R.WINDOWS.items():
        inside = hour.isin(*hours)
        out[f"is_{name}"] = flag(inside & ~weekend if weekdays else inside)
    return rows.withColumns(out)
