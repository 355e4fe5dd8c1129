"""Flights schema (the data dictionary) and fixed level orders.

The dictionary is expressed as a ``StructType`` whose field metadata carries
the source header name and a description, so it travels with every
DataFrame read through :func:`skylane.sources.readers.read_flights`.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column name, source header, Spark type, short meaning ---
# (names and source headers must equal the published data dictionary; the
#  AIRLINE display-name column is read by the analyses but not documented)
_DICTIONARY = [
    ("FL_DATE", "FlightDate", T.StringType(), "flight date, yyyymmdd or yyyy-mm-dd text"),
    ("AIRLINE", None, T.StringType(), "airline display name"),
    ("AIRLINE_CODE", "Reporting_Airline", T.StringType(), "carrier code"),
    ("DOT_CODE", "DOT_ID_Reporting_Airline", T.LongType(), "DOT carrier id"),
    ("FL_NUMBER", "Flight_Number_Reporting_Airline", T.LongType(), "flight number"),
    ("ORIGIN", "Origin", T.StringType(), "origin airport code"),
    ("ORIGIN_CITY", "OriginCityName", T.StringType(), "origin city"),
    ("DEST", "Dest", T.StringType(), "destination airport code"),
    ("DEST_CITY", "DestCityName", T.StringType(), "destination city"),
    ("CRS_DEP_TIME", "CRSDepTime", T.LongType(), "scheduled departure, local hhmm"),
    ("DEP_TIME", "DepTime", T.DoubleType(), "actual departure, local hhmm"),
    ("DEP_DELAY", "DepDelay", T.DoubleType(), "departure delay in minutes, negative = early"),
    ("TAXI_OUT", "TaxiOut", T.DoubleType(), "taxi-out minutes"),
    ("WHEELS_OFF", "WheelsOff", T.DoubleType(), "wheels-off time, hhmm"),
    ("WHEELS_ON", "WheelsOn", T.DoubleType(), "wheels-on time, hhmm"),
    ("TAXI_IN", "TaxiIn", T.DoubleType(), "taxi-in minutes"),
    ("CRS_ARR_TIME", "CRSArrTime", T.LongType(), "scheduled arrival, local hhmm"),
    ("ARR_TIME", "ArrTime", T.DoubleType(), "actual arrival, local hhmm"),
    ("ARR_DELAY", "ArrDelay", T.DoubleType(), "arrival delay in minutes, negative = early"),
    ("CANCELLED", "Cancelled", T.DoubleType(), "1 when cancelled"),
    ("CANCELLATION_CODE", "CancellationCode", T.StringType(), "cancellation reason"),
    ("DIVERTED", "Diverted", T.DoubleType(), "1 when diverted"),
    ("CRS_ELAPSED_TIME", "CRSElapsedTime", T.DoubleType(), "scheduled elapsed minutes"),
    ("ELAPSED_TIME", "ActualElapsedTime", T.DoubleType(), "actual elapsed minutes"),
    ("AIR_TIME", "AirTime", T.DoubleType(), "minutes in the air"),
    ("DISTANCE", "Distance", T.DoubleType(), "distance in miles"),
    ("DELAY_DUE_CARRIER", "CarrierDelay", T.DoubleType(), "carrier delay minutes"),
    ("DELAY_DUE_WEATHER", "WeatherDelay", T.DoubleType(), "weather delay minutes"),
    ("DELAY_DUE_NAS", "NASDelay", T.DoubleType(), "national air system delay minutes"),
    ("DELAY_DUE_SECURITY", "SecurityDelay", T.DoubleType(), "security delay minutes"),
    ("DELAY_DUE_LATE_AIRCRAFT", "LateAircraftDelay", T.DoubleType(), "late aircraft delay minutes"),
]

# --- fixed values: level orders used by the analyses ---
DOW_LEVELS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DISTANCE_LEVELS = ["Short-haul", "Medium-haul", "Long-haul"]
DISTANCE_BREAKS = (500.0, 1500.0)          # right-closed: (-inf,500], (500,1500], (1500,inf)
SEASON_MONTHS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8)}
SEASON_DEFAULT = "Fall"
SEASON_DISPLAY_ORDER = ["Winter", "Summer", "Spring", "Fall"]
DELAY_CAUSE_PREFIX = "DELAY_DUE_"
ARRIVAL_DELAY_THRESHOLD = 15.0             # delayed = ARR_DELAY > 15, on time = <= 15
CLASS_THRESHOLD = 0.3                      # probability -> class, strict >


def flights_schema(include_undocumented: bool = True) -> T.StructType:
    """The dictionary as a ``StructType``; header/description in metadata."""
    fields = []
    for name, source, dtype, text in _DICTIONARY:
        if source is None and not include_undocumented:
            continue
        md = {"comment": text}
        if source is not None:
            md["source_header"] = source
        fields.append(T.StructField(name, dtype, True, md))
    return T.StructType(fields)


def dictionary_rows() -> list[tuple[str, str | None, str, str]]:
    """(name, source header, Spark type, description) for every column."""
    return [(n, s, d.simpleString(), t) for n, s, d, t in _DICTIONARY]


def delay_cause_columns(columns: list[str]) -> list[str]:
    """Columns named ``DELAY_DUE_*``, in schema order."""
    return [c for c in columns if c.startswith(DELAY_CAUSE_PREFIX)]
