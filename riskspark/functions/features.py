"""Transaction features as built-in column expressions.

Every feature is a ``Column`` built from ``pyspark.sql.functions`` so that a
whole feature set compiles into one projection inside whole-stage codegen.
``build_features`` applies them in a single ``select``; optional features are
decided at plan time from the input schema, like the reference's stage does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text columns the feature stage drops when present.
TEXT_COLUMNS_TO_DROP = ["street", "city", "job", "dob", "trans_num", "gender", "trans_date_trans_time"]

# Ordered model input (20 columns).
MODEL_FEATURES = [
    "amt", "lat", "long", "city_pop", "unix_time", "merch_lat", "merch_long", "merch_zipcode", "zip",
    "amt_log", "hour_of_day", "day_of_week", "is_weekend", "is_night", "distance_km", "category_encoded",
    "state_encoded", "gender_encoded", "city_pop_log", "zip_region",
]

# Degree-to-km factors of the flat distance approximation.
KM_PER_DEG_LAT = 111.0
KM_PER_DEG_LON = 85.0


def amt_log(amt: Column | str = "amt") -> Column:
    """ln(1 + amt)."""
    return F.log1p(F.col(amt).cast("double") if isinstance(amt, str) else amt.cast("double"))


def hour_of_day(t: str = "unix_time") -> Column:
    """hour of the UTC day of an epoch-seconds column."""
    return F.floor(F.pmod(F.col(t), F.lit(86400)) / 3600).cast("int")


def day_of_week(t: str = "unix_time", mode: str = "epoch") -> Column:
    """day number.  ``mode="epoch"`` counts from 1970-01-01 (a Thursday) as
    0, which is the reference's behaviour; ``mode="calendar"`` gives 0 = Monday."""
    days = F.floor(F.col(t) / 86400)
    if mode == "calendar":
        days = days + 3
    elif mode != "epoch":
        raise ValueError(f"unknown weekday mode {mode!r}")
    return F.pmod(days, F.lit(7)).cast("int")


def is_weekend(dow: Column) -> Column:
    """day number 5 or 6."""
    return (dow >= 5).cast("int")


def is_night(hour: Column) -> Column:
    """hour >= 22 or hour <= 6."""
    return ((hour >= 22) | (hour <= 6)).cast("int")


def distance_km(lat="lat", lon="long", mlat="merch_lat", mlon="merch_long") -> Column:
    """sqrt((dlat*111)^2 + (dlon*85)^2)."""
    dlat = (F.col(mlat).cast("double") - F.col(lat).cast("double")) * KM_PER_DEG_LAT
    dlon = (F.col(mlon).cast("double") - F.col(lon).cast("double")) * KM_PER_DEG_LON
    return F.sqrt(dlat * dlat + dlon * dlon)


def stable_hash_mod(c: str | Column, m: int) -> Column:
    """Stable string hash -> [0, m): first 32 bits of md5, mod m.

    Unlike an engine-internal hash it does not change between versions or
    between the training and the scoring job.
    """
    col = F.col(c) if isinstance(c, str) else c
    h = F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % m).cast("int")


def category_encoded(c="category") -> Column:
    return stable_hash_mod(c, 1000)


def state_encoded(c="state") -> Column:
    return stable_hash_mod(c, 100)


def gender_encoded(c="gender") -> Column:
    """1 when gender is 'M'."""
    return F.coalesce((F.col(c) == "M").cast("int"), F.lit(0))


def city_pop_log(c="city_pop") -> Column:
    return F.log1p(F.col(c).cast("double"))


def zip_region(c="zip") -> Column:
    """zip div 10000."""
    return F.floor(F.col(c) / 10000).cast("int")


def build_features(df: DataFrame, weekday_mode: str = "epoch", buckets: tuple[int, int] = (1000, 100),
                   keep: list[str] | None = None) -> DataFrame:
    """all features in one projection, for batch and streaming frames alike.

    Time features need ``unix_time``; distance needs the four coordinates;
    encodings need their source column.  Text columns are dropped last (F12).
    ``keep`` names text columns to keep anyway (e.g. ``merchant`` for alerts).
    """
    cols = set(df.columns)
    lon = "long" if "long" in cols else ("lon" if "lon" in cols else None)
    mlon = "merch_long" if "merch_long" in cols else ("merch_lon" if "merch_lon" in cols else None)
    out: list[Column] = [F.col(c) for c in df.columns]
    if "amt" in cols:
        out.append(amt_log("amt").alias("amt_log"))
    if "unix_time" in cols:
        h = hour_of_day("unix_time")
        d = day_of_week("unix_time", weekday_mode)
        out += [h.alias("hour_of_day"), d.alias("day_of_week"),
                is_weekend(d).alias("is_weekend"), is_night(h).alias("is_night")]
    if {"lat", "merch_lat"} <= cols and lon and mlon:
        out.append(distance_km("lat", lon, "merch_lat", mlon).alias("distance_km"))
    if "category" in cols:
        out.append(stable_hash_mod("category", buckets[0]).alias("category_encoded"))
    if "state" in cols:
        out.append(stable_hash_mod("state", buckets[1]).alias("state_encoded"))
    if "gender" in cols:
        out.append(gender_encoded().alias("gender_encoded"))
    if "city_pop" in cols:
        out.append(city_pop_log().alias("city_pop_log"))
    if "zip" in cols:
        out.append(zip_region().alias("zip_region"))
    drop = [c for c in TEXT_COLUMNS_TO_DROP if c in cols and c not in (keep or [])]
    return df.select(*out).drop(*drop)


def velocity(df: DataFrame, key: str = "cc_num", time: str = "unix_time", seconds: int = 3600,
             amount: str = "amt") -> DataFrame:
    """transactions and amount per card over the trailing ``seconds``
    (rows of the same card with time in [t - seconds, t], peers included).
    Running sums per card and time bucket: one busy card is not one task, and
    the work per row does not grow with the span."""
    from ..operators.windows import trailing_sums
    n, total = f"txn_count_{seconds}s", f"amount_{seconds}s"
    out = trailing_sums(df, [key], time, seconds, {n: F.lit(1).cast("bigint"), total: F.col(amount).cast("decimal(18,2)")})
    return out.withColumn(total, F.col(total).cast("double"))


def drop_text_columns(df: DataFrame) -> DataFrame:
    """drop the fixed text columns that are present."""
    return df.drop(*[c for c in TEXT_COLUMNS_TO_DROP if c in df.columns])


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """nulls of numeric columns -> 0."""
    return df.na.fill(0, subset=cols) if cols else df.na.fill(0)


def model_columns(df: DataFrame, names: list[str] = MODEL_FEATURES) -> list[Column]:
    """F16: the ordered model input as doubles; a missing column becomes 0."""
    alias = {"long": "lon", "merch_long": "merch_lon"}
    out = []
    for n in names:
        src = n if n in df.columns else alias.get(n) if alias.get(n) in df.columns else None
        c = F.coalesce(F.col(src).cast("double"), F.lit(0.0)) if src else F.lit(0.0)
        out.append(c.alias(n))
    return out


# ---------------------------------------------------------------- scoring side
FRAUD_THRESHOLD = 0.52
BAND_CUTS = (0.6, 0.9)


def fraud_prediction(score: str = "fraud_score", threshold: float = FRAUD_THRESHOLD) -> Column:
    """1 when score >= threshold."""
    return (F.col(score) >= F.lit(threshold)).cast("int")


def risk_band(score: str = "fraud_score", cuts=BAND_CUTS) -> Column:
    """low < 0.6 <= medium < 0.9 <= high."""
    s = F.col(score)
    return F.when(s < cuts[0], "low").when(s < cuts[1], "medium").otherwise("high")


def mask_card(cc: str = "cc_num") -> Column:
    """'**** **** **** ' + last four digits."""
    return F.concat(F.lit("**** **** **** "), F.substring(F.col(cc).cast("string"), -4, 4))


def seconds_ago(t: str, as_of: Column) -> Column:
    """whole seconds between an epoch-seconds column and ``as_of``."""
    return (as_of - F.col(t)).cast("bigint")


def elapsed_label(sec: str | Column) -> Column:
    """seconds -> ``MM:SS.S`` (minutes unbounded, tenths rounded)."""
    s = F.col(sec) if isinstance(sec, str) else sec
    tenths = F.round(s.cast("decimal(20,3)") * 10, 0).cast("bigint")
    minutes = F.floor(tenths / 600)
    rest = tenths - minutes * 600
    return F.format_string("%02d:%02d.%d", minutes, F.floor(rest / 10), rest % 10)


def clamp_pct(x: Column, maximum: Column) -> Column:
    """min(100, round(100*x/max, 2)); 0 when max <= 0."""
    return F.when(maximum > 0, F.least(F.lit(100.0), F.round(x.cast("double") * 100 / maximum, 2))).otherwise(F.lit(0.0))
