"""Numeric analysis of recordings: activity curves, signatures, keyframes, frame-change audits.

Decoding and optical flow happen outside; these operators take sampled values (key, idx, value) or flow vectors.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators.joins import ordered_pairs

#: Names of the eight directions of a flow histogram, from the angle 0 on.
DIRECTIONS = ("right", "down-right", "down", "down-left", "left", "up-left", "up", "up-right")
CHANGED = 12
MIN_CHANGED_RATIO, MIN_MEAN_DIFFERENCE = 0.001, 0.25


def consecutive(df: DataFrame, key: str, order: str, value: str, out: str = "delta") -> DataFrame:
    """Adds the absolute difference to the row before; null for the first of a key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.abs(F.col(value) - before))


def curves(df: DataFrame, key: str, order: str, value: str, out: str = "curve") -> DataFrame:
    """One row a key with its values in order. A curve is one recording's samples, bounded by its length."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias(out))


def activity(df: DataFrame, key: str, order: str, value: str, bins: int = 8, digits: int = 4) -> DataFrame:
    """Per key: the compressed curve, mean, peak and timing character of its values."""
    c = curves(df, key, order, value)
    mean = F.aggregate("curve", F.lit(0.0), lambda s, x: s + x) / F.size("curve")
    return c.select(
        key, vectors.curve_bins(F.col("curve"), bins, digits).alias("activity_curve"), F.round(mean, 4).alias("activity_mean"), F.round(F.array_max("curve"), 4).alias("activity_peak"),
        vectors.timing_character(F.col("curve")).alias("timing_character"),
    )


def direction_histogram(flow: DataFrame, key: str, angle: str = "angle", weight: str = "magnitude", digits: int = 4) -> DataFrame:
    """Per key: the share of each direction in the sum of magnitudes, all eight names; zeros if there is no motion."""
    turn = 2 * math.pi
    place = F.pmod(F.floor(F.pmod(F.col(angle), F.lit(turn)) / turn * 8), F.lit(8))
    sums = flow.groupBy(key).agg(*[F.sum(F.when(place == i, F.col(weight)).otherwise(F.lit(0.0))).alias(n) for i, n in enumerate(DIRECTIONS)], F.sum(weight).alias("_all"))
    share = lambda n: F.round(F.coalesce(F.try_divide(F.col(n), F.nullif(F.col("_all"), F.lit(0.0))), F.lit(0.0)), digits)
    return sums.select(key, F.create_map(*[x for n in DIRECTIONS for x in (F.lit(n), share(n))]).alias("direction_histogram"))


def median_flow(flow: DataFrame, key: str) -> DataFrame:
    """Per key: median dx, dy and magnitude, and the direction they make."""
    m = flow.groupBy(key).agg(*[F.median(c).alias(c) for c in ("dx", "dy", "magnitude")])
    return m.withColumn("dominant_direction", vectors.direction(F.col("dx"), F.col("dy"), F.col("magnitude")))


def frame_change(samples: DataFrame, key: str = "key", frame: str = "frame", pixels: str = "pixels") -> DataFrame:
    """Per key: the largest changed-pixel ratio and mean difference over all pairs of sampled frames, and whether it moves.

    ``pixels`` is an array of structs r, g, b; a pixel changed if its differences sum to more than CHANGED. A key has
    a few sampled frames.
    """
    pairs = ordered_pairs(samples, [key], frame, pixels)
    sums = F.zip_with(f"{pixels}_a", f"{pixels}_b", lambda a, b: F.abs(a["r"] - b["r"]) + F.abs(a["g"] - b["g"]) + F.abs(a["b"] - b["b"]))
    n = F.greatest(F.size(sums), F.lit(1))
    ratio = F.size(F.filter(sums, lambda s: s > CHANGED)) / n
    mean = F.aggregate(sums, F.lit(0.0), lambda a, s: a + s) / (n * 3)
    best = pairs.groupBy(key).agg(F.max(ratio).alias("changed_pixel_ratio"), F.max(mean).alias("mean_absolute_difference"))
    return best.withColumn("dynamic", (F.col("changed_pixel_ratio") >= MIN_CHANGED_RATIO) | (F.col("mean_absolute_difference") >= MIN_MEAN_DIFFERENCE))


def page_motion(observations: DataFrame, key: str = "key") -> DataFrame:
    """Per key: distinct frame hashes, running animations, video progress, and whether any shows motion.

    Observations have frame_hash, running_animations and video_time.
    """
    sums = observations.groupBy(key).agg(
        F.count_distinct("frame_hash").alias("unique_frame_hashes"), F.coalesce(F.max("running_animations"), F.lit(0)).alias("running_animations"),
        F.coalesce(F.max("video_time") - F.min("video_time") > 0.05, F.lit(False)).alias("video_advanced"),
    )
    return sums.withColumn("dynamic", (F.col("unique_frame_hashes") >= 2) | (F.col("running_animations") > 0) | F.col("video_advanced"))


def ssim(pairs: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Per key: structural similarity of pixel values x and y (one row a pixel)."""
    return pairs.groupBy(key).agg(vectors.ssim(F.col(x), F.col(y)).alias("ssim"))


def keyframes(frames: DataFrame, key: str = "key", idx: str = "idx", act: str = "activity", vector: str = "vector", most: int = 8, gain: float = 0.015) -> DataFrame:
    """Rows (key, idx) of selected frames: first and last, the four most active, then the farthest until nothing is far.

    A greedy choice within one recording, on the matrix of its vectors. Of equally far frames the first is taken;
    distances are mean absolute differences, and null components count as 0.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(idx).reset_index(drop=True)
        n = len(rows)
        taken = [0] if n == 1 else [0, n - 1]
        for i in rows[act].fillna(0).sort_values(ascending=False, kind="stable").index[:4]:
            if len(taken) < most and i not in taken:
                taken.append(int(i))
        matrix = np.nan_to_num(np.array(rows[vector].tolist(), np.float64).reshape(n, -1))
        away = lambda j: np.abs(matrix - matrix[j]).sum(axis=1) / max(matrix.shape[1], 1)
        far = np.min([away(j) for j in taken], axis=0)
        while len(taken) < min(most, n):
            far[taken] = -1.0
            best = int(far.argmax())
            if far[best] < gain:
                break
            taken.append(best)
            far = np.minimum(far, away(best))
        return pd.DataFrame({key: rows[key].iloc[0], idx: rows[idx].iloc[sorted(taken)]})

    types = dict(frames.dtypes)
    return frames.select(key, idx, act, vector).groupBy(key).applyInPandas(choose, f"{key} {types[key]}, {idx} {types[idx]}")


def encoded(rows: DataFrame, column: str, encoder, out: str = "embedding", batch: int = 16) -> DataFrame:
    """Adds unit vectors of a column by an encoder object with ``encode(list) -> list of vectors``, made once a worker.

    ``encoder`` is a function that makes it; what it needs is imported there.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for part in parts:
            found = []
            for at in range(0, len(part), batch):
                for v in model.encode(list(part.iloc[at : at + batch])):
                    norm = max(math.sqrt(sum(float(x) ** 2 for x in v)), 1e-12)
                    found.append([float(x) / norm for x in v])
            yield pd.Series(found)

    return rows.withColumn(out, run(F.col(column)))


def signature(parts: dict[str, Column]) -> Column:
    """A signature struct; parts that are not given are null."""
    kinds = {"dominant_direction": "string", "changed_region": "string", "timing_character": "string", "activity_curve": "array<double>", "direction_histogram": "map<string,double>"}
    return F.struct(*[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
