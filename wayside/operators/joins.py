"""Equi-joins with a checked broadcast, lookups, and search by distance."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, cos, pi, radians, sin

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from wayside import functions as X, model

MEGABYTE = 1024 * 1024
# join types under which the named side may be broadcast without changing the result
_RIGHT_MAY_GO = {"inner", "left", "left_outer", "leftouter", "semi", "left_semi", "anti",
                 "left_anti"}
_LEFT_MAY_GO = {"inner", "right", "right_outer", "rightouter"}
_FIXED = (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType)
#: What a row of a hash table takes beside its values, and the part of the driver's heap for one table.
ROW_BYTES, DRIVER_PART = 40, 16
_FULL = {"full", "outer", "full_outer", "fullouter"}


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a table, without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def unpacked_bytes(df: DataFrame) -> int:
    """What a table's rows take in memory; one scan, which for plain columns of Parquet reads only
    the files' footers.  The planned size of a file scan is that of compressed columns, often a small
    part of this."""
    wide = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, _FIXED)]
    counted = df.agg(F.count(F.lit(1)),
                     *[F.sum(F.octet_length(c.cast("string")).cast("long")) for c in wide]).first()
    return counted[0] * (ROW_BYTES + 8 * len(df.columns)) + sum(n or 0 for n in counted[1:])


def broadcast_small(df: DataFrame, limit_mb: float = 200) -> DataFrame:
    """Hint a broadcast only if the table is within the limit, as planned and unpacked, and the driver,
    which collects and copies the rows while it builds the table to send, has room for it."""
    room = df.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory() / DRIVER_PART
    limit = min(limit_mb * MEGABYTE, room)
    small = planned_bytes(df) <= limit and unpacked_bytes(df) <= limit
    return F.broadcast(df) if small else df


def sized_equi_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    limit_mb: float = 200,
) -> DataFrame:
    """Join on same-named keys; the smaller side is broadcast if it is within the limit and
    the join type allows it.  Otherwise adaptive execution picks a shuffled join and splits
    skewed partitions.  It cannot split a full outer join, so a large one is run as a left
    outer join and the unmatched rest of the right side, which it can.  Columns come as those of
    a plain join do, also if both sides have others of the same name."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    sizes = planned_bytes(left), planned_bytes(right)
    kind = how.lower()
    if kind in _RIGHT_MAY_GO and (sizes[1] <= sizes[0] or kind not in _LEFT_MAY_GO):
        right = broadcast_small(right, limit_mb)
    elif kind in _LEFT_MAY_GO:
        left = broadcast_small(left, limit_mb)
    elif kind in _FULL and max(sizes) > limit_mb * MEGABYTE:
        names = [*keys, *(c for side in (left, right) for c in side.columns if c not in keys)]
        left, right = _numbered(left, keys, "_left"), _numbered(right, keys, "_right")
        matched = left.join(right, keys, "left")
        rest = right.join(left.select(*keys), keys, "left_anti")
        return matched.unionByName(rest, allowMissingColumns=True).toDF(*names)
    return left.join(right, keys, how)


def _numbered(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """The keys, then the other columns by place instead of name."""
    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(others)])


def frequent_keys(df: DataFrame, key: str, share: float) -> dict:
    """The keys that hold more than ``share`` of the rows, at most 1 / share of them, and their
    rows; one scan."""
    watch = Observation()
    counted = (
        df.select(F.col(key).alias("k")).observe(watch, F.count(F.lit(1)).alias("n"))
        .groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k is not null")
        .orderBy(F.col("n").desc()).limit(ceil(1 / share)).collect()
    )
    return {r.k: r.n for r in counted if r.n > watch.get["n"] * share}


def bucketed_join(
    left: DataFrame, right: DataFrame, key: str, buckets: int, frequent: Sequence | None = None,
    salts: int = 32,
) -> DataFrame:
    """Inner join of two tables bucketed alike on ``key``, without a shuffle.

    A bucket is read by one task, whatever its size.  Keys that fill more than a whole
    average bucket are therefore joined beside it; usually there are none.  Their rows are dealt
    to ``salts`` parts of a key on the side that has more of them, and repeated for each part on
    the other.  ``frequent`` names them where they are known; the left side is dealt out then."""
    deal_left = True
    if frequent is None:
        share = 1.0 / buckets
        found = frequent_keys(left, key, share), frequent_keys(right, key, share)
        frequent = sorted(set(found[0]) | set(found[1]))
        deal_left = sum(found[0].values()) >= sum(found[1].values())
    if not frequent:
        return left.hint("merge").join(right, key)
    hot = F.col(key).isin(*frequent)
    rest = left.filter(~hot).hint("merge").join(right.filter(~hot), key)
    # the number of a row in its file part: the same again if a task is repeated
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    repeated = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    parts = max(salts, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = [
        side.filter(hot).withColumn("_salt", dealt if first == deal_left else repeated)
        .repartition(parts, key, "_salt")
        for first, side in ((True, left), (False, right))
    ]
    shuffled = salted[0].hint("merge").join(salted[1], [key, "_salt"]).drop("_salt")
    return rest.unionByName(shuffled)


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    lookup_key: str,
    values: Sequence[str],
    limit_mb: float = 200,
) -> DataFrame:
    """Add the ``values`` of a code table; unknown codes give null.  Of a code that the table has
    several times, the smallest row by the values counts."""
    row = F.min(F.struct(*values)).alias("_values")
    table = lookup.groupBy(F.col(lookup_key).alias("_code")).agg(row).select(
        "_code", *[F.col("_values").getField(c).alias(c) for c in values])
    return df.join(broadcast_small(table, limit_mb), F.col(key) == F.col("_code"), "left").drop(
        "_code"
    )


# ---------------------------------------------------------------- distances

_KM_PER_DEGREE = 111.0  # a little less than the true 111.19, so boxes come out larger


def _box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A predicate every point within ``km`` fulfils; it reaches the scan as a range."""
    d_lat = km / _KM_PER_DEGREE
    inside_lat = lat.between(at_lat - d_lat, at_lat + d_lat)
    widest = min(89.9, abs(at_lat) + d_lat)
    d_lng = km / (_KM_PER_DEGREE * cos(radians(widest)))
    low, high = at_lng - d_lng, at_lng + d_lng
    if d_lng >= 180:
        return inside_lat
    if low < -180:
        return inside_lat & ((lng <= high) | (lng >= low + 360))
    if high > 180:
        return inside_lat & ((lng >= low) | (lng <= high - 360))
    return inside_lat & lng.between(low, high)


def radius_search(
    df: DataFrame,
    at_lat: float,
    at_lng: float,
    km: float,
    lat: str = "latitude",
    lng: str = "longitude",
    order: Sequence[Column] = (),
) -> DataFrame:
    """Rows nearer than ``km`` with their ``distance_km``, nearest first."""
    near = df.filter(_box(F.col(lat), F.col(lng), at_lat, at_lng, km))
    measured = near.withColumn(
        "distance_km", X.great_circle_km(F.lit(at_lat), F.lit(at_lng), F.col(lat), F.col(lng))
    )
    return measured.filter(F.col("distance_km") < km).orderBy("distance_km", *order)


def radius_join(
    centres: DataFrame,
    places: DataFrame,
    km: float,
    centre_lat: str = "centre_lat",
    centre_lng: str = "centre_lng",
    lat: str = "latitude",
    lng: str = "longitude",
) -> DataFrame:
    """Every (centre, place) pair nearer than ``km``, anywhere on the sphere.

    Places get one cell each of a grid around the sphere, whose edge is the chord of the radius;
    centres are repeated for the neighbouring cells, so the join is an equi-join on the cell and
    only candidates are measured.  Neither poles nor the date line are special.  Rows without a
    position, or with a latitude beyond 90, are near nothing."""
    # a little wider than the chord, for rounding
    edge = 2 * sin(min(km / model.EARTH_RADIUS_KM, pi) / 2) * (1 + 1e-9) + 1e-9

    def cell_of(la: Column, lo: Column) -> list[Column]:
        lat_r, lng_r = F.radians(la), F.radians(lo)
        point = (F.cos(lat_r) * F.cos(lng_r), F.cos(lat_r) * F.sin(lng_r), F.sin(lat_r))
        return [F.floor(x / edge).cast("bigint") for x in point]

    cells = ("_x", "_y", "_z")
    valid = F.col(lat).between(-90, 90) & F.col(lng).isNotNull()
    placed = places.filter(valid).withColumns(dict(zip(cells, cell_of(F.col(lat), F.col(lng)))))
    home = cell_of(F.col(centre_lat), F.col(centre_lng))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    touched = F.array(
        *[F.struct(*[(c + s).alias(n) for c, s, n in zip(home, step, cells)]) for step in steps]
    )
    spread_out = centres.filter(
        F.col(centre_lat).between(-90, 90) & F.col(centre_lng).isNotNull()
    ).select("*", F.inline(touched))
    measured = placed.join(spread_out, list(cells)).withColumn(
        "distance_km",
        X.great_circle_km(F.col(centre_lat), F.col(centre_lng), F.col(lat), F.col(lng)),
    )
    return measured.filter(F.col("distance_km") < km).drop(*cells)
