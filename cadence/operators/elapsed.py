"""The unit in which elapsed times are shown.

Lengths are always computed in seconds. A column of differences is *shown* in the
largest unit that its smallest absolute value fills: seconds below a minute, then
minutes, hours and days. The unit is decided once for a whole column, travels with
it as column metadata (also through written tables) and stays when rows are
filtered afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Unit names with their seconds, as they are printed behind a number.
UNITS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400}


def unit_for(smallest: float | None) -> str:
    """Unit of a column whose smallest absolute value is ``smallest`` seconds (None: no value)."""
    fitting = [u for u, s in UNITS.items() if smallest is not None and smallest >= s]
    return fitting[-1] if fitting else "secs"


def with_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    return df.withMetadata(column, df.schema[column].metadata | {"unit": unit})


def unit_of(df: DataFrame, column: str) -> str:
    """The column's unit, seconds if none was given."""
    return df.schema[column].metadata.get("unit", "secs")
