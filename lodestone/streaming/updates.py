"""Update checks and notification: batch predicates, and the same as keyed state over a stream of checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.text import compare_versions

CHECK_HOURS, REMIND_HOURS = 24.0, 168.0


def _hours_since(then: Column, now: Column) -> Column:
    return (now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 3600


def throttled(last_checked: Column, now: Column, interval_hours: float = CHECK_HOURS, force: Column | None = None) -> Column:
    """Whether a check comes too soon; never without an earlier check, an interval, or if forced."""
    soon = F.lit(interval_hours > 0) & F.coalesce(_hours_since(last_checked, now) < interval_hours, F.lit(False))
    return soon if force is None else soon & ~F.coalesce(force, F.lit(False))


def notify(latest: Column, last_notified: Column, notified_at: Column, now: Column, remind_hours: float = REMIND_HOURS) -> Column:
    """Once a version, and again after ``remind_hours``."""
    return F.coalesce(latest != last_notified, F.lit(True)) | notified_at.isNull() | (_hours_since(notified_at, now) >= remind_hours)


#: What update_status reads of a check.
CHECKS = (
    "client string, enabled boolean, now timestamp, last_checked_at timestamp, fetch string, error_count int, latest_version string, current_version string, "
    "own_version string, min_version string, last_notified_version string, last_notified_at timestamp"
)


def update_status(checks: DataFrame) -> DataFrame:
    """Adds ``status`` and ``notify`` to checks.

    Columns: enabled, now, last_checked_at, fetch (ok, not-modified, unreachable, invalid), error_count, latest_version,
    current_version, own_version, min_version, last_notified_version, last_notified_at.
    """
    not_modified = (F.col("fetch") == "not-modified") & F.col("latest_version").isNull()
    older = lambda a, b: compare_versions(F.coalesce(F.col(a), F.lit("0")), F.coalesce(F.col(b), F.lit("0"))) < 0
    status = (
        F.when(~F.coalesce("enabled", F.lit(False)), F.lit("disabled"))
        .when(throttled(F.col("last_checked_at"), F.col("now")), F.lit("interval_skipped"))
        .when(F.col("fetch") == "unreachable", F.lit("offline_or_unreachable"))
        .when((F.col("fetch") == "invalid") | (F.coalesce("error_count", F.lit(0)) > 0), F.lit("invalid_manifest"))
        .when(not_modified, F.lit("not_modified"))
        .when(older("own_version", "min_version"), F.lit("skill_update_required"))
        .when(~older("current_version", "latest_version"), F.when(F.col("fetch") == "not-modified", F.lit("not_modified")).otherwise(F.lit("current")))
        .otherwise(F.lit("update_available"))
    )
    tell = notify(F.col("latest_version"), F.col("last_notified_version"), F.col("last_notified_at"), F.col("now"))
    return checks.withColumn("status", status).withColumn("notify", (F.col("status") == "update_available") & tell)


#: Statuses after which a scheduled check has failed, and the exit code that says so.
FAILED_STATUS, FAILED_CODE = ("error", "invalid_manifest"), 2


def exit_code(status: Column) -> Column:
    """0, or FAILED_CODE for a check that failed."""
    return F.when(status.isin(*FAILED_STATUS), F.lit(FAILED_CODE)).otherwise(F.lit(0))


def conditional_fetch(checks: DataFrame, state: DataFrame) -> DataFrame:
    """Fetches (client, http_status, etag, manifest) with what the client's state (client, etag, manifest) adds.

    ``sent_etag`` is what the request carried; a 304 answer takes the state's manifest and etag, whether or not there
    is one, any other answer its own. ``fetch`` is ok, not-modified, invalid (an answer that is no object) or
    unreachable (null or an error status). The result is the state after the fetch, too.
    """
    old = state.select("client", F.col("etag").alias("sent_etag"), F.col("manifest").alias("_kept"))
    rows = checks.join(old, "client", "left")
    same = F.col("http_status") == 304
    fetch = (
        F.when(same, F.lit("not-modified")).when(F.col("http_status").isNull() | (F.col("http_status") >= 400), F.lit("unreachable"))
        .when(F.json_object_keys("manifest").isNull(), F.lit("invalid")).otherwise(F.lit("ok"))
    )
    manifest = F.when(same, F.col("_kept")).when(fetch == "ok", F.col("manifest"))
    etag = F.when(same, F.col("sent_etag")).when(fetch == "ok", F.col("etag"))
    return rows.withColumns({"fetch": fetch, "_m": manifest, "_e": etag}).drop("_kept", "manifest", "etag").withColumnsRenamed({"_m": "manifest", "_e": "etag"})


def next_state(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """The state (client, etag, manifest) after fetches: the fetched one where a fetch gave a manifest, else as before."""
    new = fetched.where("manifest is not null").select("client", F.struct("etag", "manifest").alias("_new"))
    rows = state.select("client", F.struct("etag", "manifest").alias("_old")).join(new, "client", "full")
    return rows.select("client", F.coalesce("_new", "_old").alias("s")).select("client", "s.etag", "s.manifest")


def checked_config(config: dict) -> dict:
    """The configuration of checks, if it is an object of schema 1."""
    if not isinstance(config, dict) or config.get("schema_version") != 1:
        raise ValueError("the configuration is no object of schema_version 1")
    return config


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a url's host is one of the hosts, whatever its case; port and user do not count."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"\A.*@", ""), r":[0-9]*\z", "")
    return F.coalesce((name != "") & name.isin(*[h.lower() for h in hosts]), F.lit(False))


#: State of a client: version and time of the last notice.
_STATE = "version string, at timestamp"
NOTICES = "client string, version string, at timestamp"


def notices(offers: DataFrame, remind_hours: float = REMIND_HOURS) -> DataFrame:
    """A stream of notices from a stream of offers (client, version, at): one a version and client, again after a while.

    State is two values a client.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, at = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(parts)).sort_values(["at", "version"])
        for v, t in zip(rows["version"], rows["at"]):
            if v != version or at is None or (t - at).total_seconds() >= remind_hours * 3600:
                version, at = v, t
                out.append((key[0], v, t))
        if version is not None:
            state.update((version, at))
        if out:
            yield pd.DataFrame(out, columns=["client", "version", "at"])

    return offers.groupBy("client").applyInPandasWithState(step, NOTICES, _STATE, "append", GroupStateTimeout.NoTimeout)


def first_seen_stream(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key; state older than the watermark is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_activity(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by key and tumbling window; late events count until the watermark passes."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a Parquet table in the checkpoint folder, and returns that table.

    In ``complete`` mode the last batch is the table. Nothing of the result passes through the driver.
    """
    from lodestone.plans.storage import checkpoint_dir

    root = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is written again replaces itself
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark, schema = stream.sparkSession, stream.schema
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
