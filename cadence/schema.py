"""Ride schema and calendar labels."""

from pyspark.sql import types as T

RIDES = T.StructType(
    [
        T.StructField("ride_id", T.StringType(), True),
        T.StructField("rideable_type", T.StringType(), True),
        T.StructField("started_at", T.TimestampNTZType(), True),
        T.StructField("ended_at", T.TimestampNTZType(), True),
        T.StructField("start_station_name", T.StringType(), True),
        T.StructField("start_station_id", T.StringType(), True),
        T.StructField("end_station_name", T.StringType(), True),
        T.StructField("end_station_id", T.StringType(), True),
        T.StructField("start_lat", T.DoubleType(), True),
        T.StructField("start_lng", T.DoubleType(), True),
        T.StructField("end_lat", T.DoubleType(), True),
        T.StructField("end_lng", T.DoubleType(), True),
        T.StructField("member_casual", T.StringType(), True),
    ]
)

RIDE_COLUMNS = [f.name for f in RIDES.fields]
STRING_COLUMNS = [f.name for f in RIDES.fields if isinstance(f.dataType, T.StringType)]
TIMESTAMP_COLUMNS = ["started_at", "ended_at"]

# The seven fields a ride must have to be kept; start_station_name is exempt.
REQUIRED_COLUMNS = [
    "end_station_name",
    "end_station_id",
    "end_lat",
    "end_lng",
    "start_station_id",
    "start_lat",
    "start_lng",
]

# Calendar labels in calendar order, weeks starting on Sunday
# (index 1 = Sunday, matching Spark's dayofweek).
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKEND_DAYS = ["Saturday", "Sunday"]
MONTH_ABBREVIATIONS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
