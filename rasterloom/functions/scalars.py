"""Scalar functions as Column expressions: all of them run inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
EARTH_KM = 6371.0088

#: Lower edges of severity levels 1 to 6 for cell counts (cells/L) and for the toxin.
CELL_EDGES = (0.0, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8)
TOXIN_EDGES = (0.0, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
#: Smoke density names and their order; anything else counts as light.
DENSITY = {"light": 1, "medium": 2, "heavy": 3}


def round_even(x: Column, digits: int = 0) -> Column:
    """Half to even, as numeric libraries round."""
    return F.rint(x) if not digits else F.bround(x, digits)


def round_scaled(x: Column, digits: int) -> Column:
    """Half away from zero of the scaled number, as SQL engines without decimals round; F.round takes halves of the printed digits."""
    return F.round(x * 10.0**digits) / 10.0**digits


def safe_div(a: Column, b: Column) -> Column:
    """NULL on a zero or missing denominator."""
    return F.try_divide(a, b)


def clipped_log(p: Column, eps: float = EPS) -> Column:
    return F.ln(F.greatest(p, F.lit(eps)))


def binary_entropy(p: Column, eps: float = EPS) -> Column:
    """Entropy of (p, 1 - p), with p clipped to [eps, 1 - eps]; NULL for NULL."""
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def entropy(probs: Column, eps: float = EPS) -> Column:
    """Predictive entropy of an array of probabilities."""
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * clipped_log(p, eps))


def margin_uncertainty(probs: Column) -> Column:
    """1 - (largest - second largest)."""
    s = F.array_sort(probs)
    return 1 - (F.element_at(s, -1) - F.element_at(s, -2))


def mean_probs(members: Column) -> Column:
    """Element-wise mean of an array of probability arrays."""
    n = F.size(members)
    return F.transform(F.sequence(F.lit(0), F.size(members[0]) - 1), lambda j: F.aggregate(members, F.lit(0.0), lambda a, m: a + m[j]) / n)


def epistemic_variance(members: Column) -> Column:
    """Mean over classes of the population variance over members."""
    mean, n, k = mean_probs(members), F.size(members), F.size(members[0])
    per = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.aggregate(members, F.lit(0.0), lambda a, m: a + (m[j] - mean[j]) * (m[j] - mean[j])) / n)
    return F.aggregate(per, F.lit(0.0), lambda a, v: a + v) / k


def mutual_information(members: Column) -> Column:
    """Entropy of the mean less the mean entropy of the members."""
    mean_entropy = F.aggregate(members, F.lit(0.0), lambda a, m: a + entropy(m)) / F.size(members)
    return entropy(mean_probs(members)) - mean_entropy


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def argmax(x: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def severity(value: Column, edges: Sequence[float] = CELL_EDGES) -> Column:
    """Level of a count: 0 for none, else the number of edges it reaches; NULL for NULL or negative values."""
    level = F.lit(0)
    for k, e in enumerate(edges):
        level = F.when((value >= e) if k else (value > e), F.lit(k + 1)).otherwise(level)
    return F.when(value >= 0, level)


def first_pattern(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Name of the first group with a pattern in the text, upper or lower case; NULL for none."""
    out = None
    for name, own in patterns.items():
        hit = text.rlike("(?i)(" + "|".join(own) + ")")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def name_time(name: Column, policy: str = "midday") -> Column:
    """Timestamp in a file name: YYYYMMDDTHHMMSS, YYYYMMDD, or YYYYDDD; days without a time go to the policy's hour."""
    full = F.regexp_extract(name, r"(\d{8})[T_](\d{6})", 0)
    hours = {"start": "00:00:00", "midday": "12:00:00", "end": "23:59:59"}[policy]
    exact = F.try_to_timestamp(F.regexp_replace(full, "[T_]", ""), F.lit("yyyyMMddHHmmss"))
    day = F.coalesce(
        F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1), F.lit("")), F.lit("yyyyMMdd")),
        F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{7})(?!\d)", 1), F.lit("")), F.lit("yyyyDDD")),
    )
    at = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" " + hours)))
    return F.coalesce(F.when(full != "", exact), at)


def round_time(ts: Column, to: str) -> Column:
    """none, hour, 10min or day, downwards."""
    if to == "none":
        return ts
    if to == "10min":
        return F.timestamp_micros((F.floor(micros(ts) / 600_000_000) * 600_000_000).cast("bigint"))
    return F.date_trunc(to, ts)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 1e6


def seconds_to_interval(ts: Column, start: Column, end: Column) -> Column:
    """0 inside the closed interval, else the distance to its nearer end."""
    return F.greatest(seconds_between(ts, start), seconds_between(end, ts), F.lit(0.0))


def midpoint_distance(ts: Column, start: Column, end: Column) -> Column:
    return F.abs(micros(ts) - (micros(start) + micros(end)) / 2) / 1e6


def pair_id(mode: str, label: Column, ts: Column) -> Column:
    """Pair name by grouping mode: label, day or scene (label and second)."""
    if mode == "label":
        return label
    if mode == "day":
        return F.date_format(ts, "yyyyMMdd")
    return F.concat_ws("_", label, F.date_format(ts, "yyyyMMdd'T'HHmmss"))


def density_level(text: Column) -> Column:
    level = F.lit(None).cast("int")
    for k, v in DENSITY.items():
        level = F.when(F.lower(F.trim(text)) == k, F.lit(v)).otherwise(level)
    return F.coalesce(level, F.lit(1))


def floor_one(text: Column) -> Column:
    """Number in a text, 1 at least, 1 where there is none."""
    return F.greatest(F.coalesce(F.expr("1.0D") * 0 + text.try_cast("double"), F.lit(1.0)), F.lit(1.0))


def bit_field(flags: Column, first: int, width: int) -> Column:
    """The number in ``width`` bits from bit ``first`` on."""
    return F.shiftright(flags, first).bitwiseAND(F.lit((1 << width) - 1))


def lon_wrap(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def relative_distance(a: Column, b: Column) -> Column:
    """|a - b| / |a + b|."""
    sub = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    add = F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))
    return F.try_divide(norm(sub), norm(add))


def hash_bin(label: Column, n: int) -> Column:
    return F.pmod(F.abs(label), F.lit(n))


def child_id(parent: Column, child: Column, n: int) -> Column:
    return parent * n + child


def split_id(label: Column, n: int) -> tuple[Column, Column]:
    """(parent, child)."""
    return F.floor(label / F.lit(n)).cast("int"), F.pmod(label, F.lit(n))


def grid_size(low: Column, high: Column, res: float) -> Column:
    return F.ceil((high - low) / F.lit(res)).cast("int")


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def canonical_date(text: Column) -> Column:
    """YYYY-MM-DD of a date or timestamp text in a usual form; NULL where none fits."""
    forms = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy/MM/dd")
    return F.date_format(F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in forms)), "yyyy-MM-dd")
