"""Column expressions (all built-in Spark functions, no Python UDFs)."""

from cadence.functions.columns import (  # noqa: F401
    day_label,
    day_of_week,
    day_of_week_num,
    hour_of_day,
    is_weekend,
    month_label,
    month_name,
    month_num,
    month_start,
    ride_length_minutes,
    ride_length_seconds,
    trip_distance,
)
from cadence.functions.text import percent_label, r_format_digits, report_line  # noqa: F401
