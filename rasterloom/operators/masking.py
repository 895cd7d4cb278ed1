"""Projections, filters, masks and scaling of pixels. All but the scaler fits are narrow: one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage

#: Fixed value: slack at both ends of a valid range; the upper end itself is invalid.
SLACK = 5e-11


def delete_channels(bands: Column, drop: Sequence[int]) -> Column:
    """The array without the given places (from 0)."""
    return F.filter(bands, lambda _, i: ~i.isin(*drop)) if drop else bands


def out_of_range(v: Column, low: float, high: float) -> Column:
    return (v < low - SLACK) | (v > high - SLACK)


def replace_out_of_range(v: Column, low: float, high: float, constant: float) -> Column:
    return F.when(out_of_range(v, low, high), F.lit(constant)).otherwise(v)


def valid_range(v: Column, low: float, high: float, fill: float | None = None) -> Column:
    """NULL below the range, from its upper end on, at the fill, and where not finite."""
    ok = ~out_of_range(v, low, high) & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok & (v != fill) if fill is not None else ok, v)


def complete_samples(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose feature array holds no NULL."""
    return df.where(~F.exists(features, lambda x: x.isNull()))


def threshold(v: Column, t: float) -> Column:
    """0 below t, else 1."""
    return (v >= t).cast("int")


def valid_binary(v: Column, t: float, nodata: float | None = None) -> Column:
    """1 above t, else 0; NULL for no-data and where not finite."""
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok & (v != nodata) if nodata is not None else ok, (v > t).cast("int"))


def tri_state(v: Column, t: float, least: float = 0.0) -> Column:
    """-1 below ``least``, 0 below t, else 1. Probabilities are valid from 0, severities from 1."""
    return F.when(v < least, -1).when(v < t, 0).otherwise(1)


def fire_code(v: Column) -> Column:
    """The codes 11 to 15 and 30 to 35 are fire."""
    return ((v > 10) & ((v < 16) | ((v > 29) & (v < 36)))).cast("int")


def fire_class(v: Column) -> Column:
    """Fixed value: fire-mask classes from 9 on are fire."""
    return F.when(v >= 9, 1).otherwise(0)


def masked_where(v: Column, mask: Column, value: float, to: float = 0.0) -> Column:
    return F.when(mask == value, F.lit(to)).otherwise(v)


def inside_contour(label: Column, contour: Column) -> Column:
    return F.when(contour > 0, label).otherwise(F.lit(-1))


def cloud_free(v: Column, cloud: Column, smoke: Column, fire: Column, t: float) -> Column:
    """NULL under cloud, unless smoke or fire shows there."""
    return F.when(~((cloud > t) & (F.coalesce(smoke, F.lit(0)) <= 0) & (F.coalesce(fire, F.lit(0)) <= 0)), v)


def band_pass(v: Column, low: float, high: float, scale: float = 1.0, open_below: float | None = None) -> Column:
    """Scaled value within [low, high]; also below ``open_below``, where given."""
    s = v * scale
    ok = s.between(low, high)
    return F.when(ok | (s < open_below) if open_below is not None else ok, s)


def log_positive(v: Column) -> Column:
    return F.when(v > 0, F.ln(v)).otherwise(v)


def small_fill(v: Column, least: float = 5e-10, fill: float = -9999.0) -> Column:
    return F.when(v < least, F.lit(fill)).otherwise(v)


def binary_annotation(v: Column) -> Column:
    """0 for [-2, 1], 1 from 2 on."""
    return F.when(v >= 2, 1).when(v >= -2, 0)


def lonlat_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def depth_filter(depth: Column, limit: float = 1.0, keep: str = "shallow") -> Column:
    """shallow: depth <= limit; deep: depth >= limit. Inputs differ in which they want."""
    return depth <= limit if keep == "shallow" else depth >= limit


def quality_products(flags: Column, smoke: Column, dust: Column) -> dict[str, Column]:
    """Products of an aerosol granule: detection, its confidence (two bits each) and both at the highest confidence."""
    smoke_conf = F.shiftright(flags, 2).bitwiseAND(F.lit(3))
    dust_conf = F.shiftright(flags, 4).bitwiseAND(F.lit(3))
    return {
        "smoke": (smoke == 1).cast("int"),
        "dust": (dust == 1).cast("int"),
        "smoke_conf": F.when(smoke == 1, smoke_conf).otherwise(0),
        "dust_conf": F.when(dust == 1, dust_conf).otherwise(0),
        "smoke_high": ((smoke == 1) & (smoke_conf == 0)).cast("int"),
        "dust_high": ((dust == 1) & (dust_conf == 0)).cast("int"),
    }


def scaler_fit(df: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """One row a group: mean, population deviation, largest magnitude, least and largest."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(F.abs(v)).alias("maxabs"), F.min(v).alias("low"), F.max(v).alias("high"))


def scaler_apply(df: DataFrame, fit: DataFrame, kind: str = "standard", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``scaled``; NULL stays NULL, and a constant channel scales to 0. fit has one row, or one a group."""
    d = df.join(storage.counted(fit, "scaler"), list(by)) if by else df.crossJoin(F.broadcast(fit))
    v = F.col(value)
    scaled = {
        "standard": (v - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0),
        "maxabs": v / F.when(F.col("maxabs") > 0, F.col("maxabs")).otherwise(1.0),
        "minmax": (v - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0),
    }[kind]
    return d.withColumn("scaled", scaled).drop("mean", "std", "maxabs", "low", "high")


def impute_normalise(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """NULL becomes the channel's mean, then values are centred and scaled by the valid pixels' mean and deviation."""
    fit = scaler_fit(df, value, by).select(*by, "mean", "std")
    d = df.join(storage.counted(fit, "scaler"), list(by))
    return d.withColumn("scaled", (F.coalesce(F.col(value), F.col("mean")) - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).drop("mean", "std")


def tiered(df: DataFrame, tiers: Sequence[tuple[str, Sequence[int]]], value: str = "label") -> Column:
    """The value where the tile class of every tier is among the tier's classes and the value is positive; else -1."""
    ok = F.col(value) > 0
    for name, classes in tiers:
        ok = ok & F.col(name).isin(*classes)
    return F.when(ok, F.col(value)).otherwise(F.lit(-1))
