"""Small helpers of jobs: clock, JSON text, report dates, intents, exit codes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def utc_now() -> Column:
    """The time of the query in UTC, to the second, with a Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pretty_json(value) -> bytes:
    """JSON of a driver value: two spaces of indentation, characters as they are, a line end at the end."""
    return (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()


def report_date(checked_at: Column) -> Column:
    """The day of a report from the first ten characters of its time; null if they are no ISO day."""
    day = F.left(checked_at, F.lit(10))
    return F.when(day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(day))


#: What an intent may name.
INTENT = "dominant_direction string, changed_region string, timing_character string, activity_curve array<double>, direction_histogram map<string,double>"


def load_intent(given: Column, query: Column) -> Column:
    """The intent given as a JSON object; without one, what the query's words say. Other JSON is an error."""
    keys = F.json_object_keys(given)
    wrong = F.raise_error(F.concat(F.lit("an intent is a JSON object, not "), F.left(given, F.lit(40)))).cast("string")
    parsed = F.from_json(F.when(keys.isNull(), wrong).otherwise(given), INTENT)
    said = text.motion_intent(query)
    inferred = F.struct(*[said.get(c, F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in INTENT.split(", "))])
    return F.when(given.isNull() | (F.trim(given) == ""), inferred).otherwise(parsed)


def health_exit_code(rollup: DataFrame, state: str = "state", n: str = "n") -> int:
    """1 if a case is broken, else 0. The driver gets one number."""
    return int(bool(rollup.where((F.col(state) == "broken") & (F.col(n) > 0)).limit(1).count()))
