"""Arrays, maps, JSON, composite values, geography and score arithmetic
(SURVEY 2.8: F15-F22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------- F15
def capped_score(total, scale: float = 50.0, cap: int = 100) -> Column:
    """``min(cap, int(total / scale * 100))``."""
    return F.least(F.lit(cap), F.floor(_c(total) / F.lit(scale) * 100).cast("int"))


# ----------------------------------------------------------------------------- F16-F18
def array_summary(arr) -> Column:
    """F16: map / filter / reduce / some / every / find / findIndex / flatMap in one struct."""
    a = _c(arr)
    return F.struct(
        F.transform(a, lambda x: x * 2).alias("doubled"),
        F.filter(a, lambda x: x > 25).alias("large"),
        F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x).alias("total"),
        F.exists(a, lambda x: x > 45).alias("some_over_45"),
        F.forall(a, lambda x: x > 0).alias("all_positive"),
        F.try_element_at(F.filter(a, lambda x: x > 40), F.lit(1)).alias("first_over_40"),
        F.array_position(F.transform(a, lambda x: x > 40), True).alias("first_over_40_pos"),
        F.flatten(F.transform(a, lambda x: F.array(x, x))).alias("flat_mapped"))


def contains_all(a, b) -> Column:
    """``a @> b`` (every element of b is in a)."""
    return F.size(F.array_except(_c(b), _c(a))) == 0


def contained_by(a, b) -> Column:
    """``a <@ b``."""
    return contains_all(b, a)


def overlaps(a, b) -> Column:
    """``a && b``."""
    return F.arrays_overlap(_c(a), _c(b))


def pg_slice(a, lo: int, hi: int) -> Column:
    """``a[lo:hi]`` with 1-based inclusive bounds."""
    return F.slice(_c(a), lo, hi - lo + 1)


def map_ops(keys, values, min_value: float) -> Column:
    """build a map from parallel arrays, keep entries >= min_value, and combine it
    with itself entry-wise (``map_zip_with``)."""
    m = F.map_from_arrays(_c(keys), _c(values))
    kept = F.map_filter(m, lambda k, v: v >= min_value)
    return F.map_zip_with(kept, kept, lambda k, v1, v2: v1 + v2)


# ----------------------------------------------------------------------------- F19-F21
def json_field(js, path: str, cast: str = "string") -> Column:
    """``js->>'field'`` (JSONPath, NULL when absent)."""
    return F.get_json_object(_c(js), path).cast(cast)


def json_has_key(js, key: str) -> Column:
    """``js ? 'key'`` for a top-level key."""
    return F.array_contains(F.coalesce(F.json_object_keys(_c(js)), F.array().cast("array<string>")), key)


def json_has_all(js, keys) -> Column:
    """``js ?& array[...]``."""
    ks = F.coalesce(F.json_object_keys(_c(js)), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), ks)) == 0


def json_type(js, path: str) -> Column:
    """type of a value (``jsonb_typeof``) via VARIANT."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(js)), path, "variant"))


def safe_parse(js) -> Column:
    """Result type: struct(ok, value, error). Malformed text never fails the job."""
    v = F.try_parse_json(_c(js))
    return F.struct(v.isNotNull().alias("ok"), v.alias("value"),
                    F.when(v.isNull() & _c(js).isNotNull(), F.lit("malformed JSON")).alias("error"))


def with_field(struct_col, name: str, value) -> Column:
    """``(composite).field = value`` without rebuilding the struct."""
    return _c(struct_col).withField(name, value)


# ----------------------------------------------------------------------------- F22
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance in km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def in_bbox(lat, lon, lat_lo, lat_hi, lon_lo, lon_hi) -> Column:
    """cheap pre-filter before the exact distance (pushes into the scan)."""
    return _c(lat).between(lat_lo, lat_hi) & _c(lon).between(lon_lo, lon_hi)
