"""Gold tables and the queries served from them.

Where the source material names a column without a formula (risk score, severity factor,
KPI values, trend) the formula used here is our own and is stated at the function.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside import model
from wayside.model import INCIDENT, Roles, present_flags
from wayside.operators.records import one_row
from wayside.sources.scratch import materialise


def month_bucket_key(time: Column) -> Column:
    return F.year(time) * 100 + F.month(time)


def _rows() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- hotspots


def risk_score(mean_severity: Column, incidents: Column) -> Column:
    """Ours: half from severity (1..4 scaled to 0..1, unknown 0), half from volume n / (n + 10)."""
    scaled = F.coalesce((mean_severity - 1) / 3, F.lit(0.0))
    severity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    return F.round(0.5 * severity + 0.5 * incidents / (incidents + 10), 4)


def geo_hotspots(
    df: DataFrame, cell_degrees: float = 0.01, roles: Roles = INCIDENT
) -> DataFrame:
    """Incidents per grid cell and place with the dominant equipment and the risk score.

    The dominant flag comes from one conditional sum per flag in the same aggregate, so the
    flags are not unpivoted.  Equal counts go to the first flag in alphabetical order."""
    flags = present_flags(df.columns)
    places = [c for c in (roles.state, roles.county, roles.city) if c in df.columns]
    size = F.lit(float(cell_degrees))
    cells = df.filter(F.col(roles.lat).isNotNull() & F.col(roles.lng).isNotNull()).withColumns(
        {
            "latitude": F.round((F.floor(F.col(roles.lat) / size) + 0.5) * size, 6),
            "longitude": F.round((F.floor(F.col(roles.lng) / size) + 0.5) * size, 6),
        }
    )
    grouped = cells.groupBy("latitude", "longitude", *places).agg(
        _rows().alias("accident_count"),
        F.avg(roles.severity).alias("severity_avg"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
    )
    ranked = [
        F.struct(F.col(f"n_{f}").alias("n"), F.lit(-i).alias("first"), F.lit(f).alias("flag"))
        for i, f in enumerate(sorted(flags))
    ]
    top = F.array_max(F.array(*ranked)) if ranked else None
    dominant = (
        F.when(top["n"] > 0, top["flag"]) if ranked else F.lit(None).cast("string")
    )
    return grouped.select(
        "latitude", "longitude", *places, "accident_count", "severity_avg",
        dominant.alias("infrastructure_type"),
        risk_score(F.col("severity_avg"), F.col("accident_count")).alias("risk_score"),
        F.lit(1000).alias("radius_meters"),
    )


def _hotspot_order(df: DataFrame, roles: Roles) -> list[Column]:
    ties = [c for c in (roles.state, roles.county, roles.city, "latitude", "longitude")
            if c in df.columns]
    return [
        F.col("risk_score").desc(), F.col("accident_count").desc(),
        *[F.col(c).asc_nulls_last() for c in ties],
    ]


def hotspot_listing(
    hotspots: DataFrame,
    state: str | None = None,
    county: str | None = None,
    min_risk: float = 0.7,
    min_accidents: int = 10,
    infrastructure: str | None = None,
    page: int = 1,
    size: int = 50,
    roles: Roles = INCIDENT,
) -> DataFrame:
    kept = hotspots.filter(
        (F.col("risk_score") >= min_risk) & (F.col("accident_count") >= min_accidents)
    )
    for column, value in (
        (roles.state, state), (roles.county, county), ("infrastructure_type", infrastructure)
    ):
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    return paged_listing(kept, _hotspot_order(kept, roles), page, size)


def hotspots_by_state_topk(
    hotspots: DataFrame, state: str, top: int = 10, roles: Roles = INCIDENT
) -> DataFrame:
    own = hotspots.filter(F.col(roles.state) == state)
    return own.orderBy(*_hotspot_order(own, roles)).limit(top)


def hotspot_map(
    hotspots: DataFrame, north: float, south: float, east: float, west: float, zoom: int = 10
) -> DataFrame:
    """Hotspots of a map window clustered into cells of 360 / 2^zoom degrees, with their
    risk colour."""
    if north <= south or east <= west:
        raise ValueError("the map window is empty")
    if not 1 <= zoom <= 18:
        raise ValueError("zoom is between 1 and 18")
    scale = F.lit(float(2**zoom))
    shown = hotspots.filter(
        F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    )
    cells = shown.groupBy(
        F.floor(F.col("latitude") * scale / 360).alias("cell_lat"),
        F.floor(F.col("longitude") * scale / 360).alias("cell_lng"),
    ).agg(
        _rows().alias("hotspots"),
        F.sum("accident_count").alias("accident_count"),
        F.avg("risk_score").alias("avg_risk"),
        F.max("risk_score").alias("max_risk"),
    )
    return cells.withColumn("colour", _risk_colour())


def _risk_colour() -> Column:
    return reduce(
        lambda done, step: done.when(F.col("max_risk") < step[0], step[1]),
        model.RISK_COLOUR_STEPS, F,
    ).otherwise(model.RISK_COLOUR_STEPS[-1][1])


#: The finest map level; a tile key has two bits for each level and the sign.
MOST_ZOOM = 18
_TILE_BITS = MOST_ZOOM + 1
#: Masks that hold every second bit, pair, four, … of a long: fixed values of bit interleaving.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
           (2, 0x3333333333333333), (1, 0x5555555555555555))


def _interleaved(row: Column, col: Column) -> Column:
    """The bits of two cell numbers of the finest level in turn, so that dropping the last two bits
    gives the tile one level up, and tiles that are near each other have near keys."""
    def apart(x: Column) -> Column:
        x = (x + (1 << MOST_ZOOM - 1)).cast("bigint")
        for by, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(apart(row), 1).bitwiseOR(apart(col))


def hotspot_tiles(hotspots: DataFrame, zooms: Sequence[int] = range(1, MOST_ZOOM + 1)) -> DataFrame:
    """``hotspot_map`` of the whole table for many levels: ``zoom``, ``tile`` (key), and its columns.

    Hotspots are summed once per tile of the finest level; every other level follows by dropping two
    bits of the key for each level in between, so the table is read once for all of them."""
    if not all(1 <= z <= MOST_ZOOM for z in zooms):
        raise ValueError(f"zoom is between 1 and {MOST_ZOOM}")
    scale = F.lit(float(1 << MOST_ZOOM))
    row, col = (F.floor(F.col(c) * scale / 360).cast("bigint") for c in ("latitude", "longitude"))
    located = hotspots.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    finest = located.groupBy(row.alias("row"), col.alias("col")).agg(
        _rows().alias("n"), F.sum("accident_count").alias("accidents"),
        # scores have four digits: their decimal sums do not depend on the order of rows
        F.sum(F.col("risk_score").cast("decimal(18,6)")).alias("risk"),
        F.count("risk_score").alias("risks"),
        F.max("risk_score").alias("top"))
    levels = finest.select(
        "*", _interleaved(F.col("row"), F.col("col")).alias("key"),
        F.explode(F.array(*[F.lit(z) for z in sorted(set(zooms))])).alias("zoom"))
    up = F.lit(MOST_ZOOM) - F.col("zoom")
    shifted = lambda c, by: F.call_function("shiftright", F.col(c), by)
    tiles = levels.groupBy("zoom", shifted("key", 2 * up).alias("tile")).agg(
        F.min(shifted("row", up)).alias("cell_lat"), F.min(shifted("col", up)).alias("cell_lng"),
        F.sum("n").alias("hotspots"), F.sum("accidents").alias("accident_count"),
        F.try_divide(F.sum("risk").cast("double"), F.sum("risks").cast("double")).alias("avg_risk"),
        F.max("top").alias("max_risk"))
    return tiles.withColumn("colour", _risk_colour())


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet by zoom, files and rows sorted by key, so that a window reads few of them."""
    (tiles.repartitionByRange("zoom", "tile").sortWithinPartitions("zoom", "tile")
     .write.mode("overwrite").partitionBy("zoom").parquet(path))


def tiles_in_window(
    tiles: DataFrame, north: float, south: float, east: float, west: float, zoom: int
) -> DataFrame:
    """The tiles of one level that a map window meets, whole.  Their keys lie between those of the
    window's corners, which the scan of a written table prunes by."""
    if north <= south or east <= west:
        raise ValueError("the map window is empty")
    cell = lambda degrees: math.floor(degrees * 2**zoom / 360)

    def key(row: int, col: int) -> int:
        half = 1 << zoom - 1
        return sum((row + half >> b & 1) << 2 * b + 1 | (col + half >> b & 1) << 2 * b
                   for b in range(_TILE_BITS + 1))

    low, high = (cell(south), cell(west)), (cell(north), cell(east))
    return tiles.filter(
        (F.col("zoom") == zoom) & F.col("tile").between(key(*low), key(*high))
        & F.col("cell_lat").between(low[0], high[0]) & F.col("cell_lng").between(low[1], high[1]))


def critical_hotspots(
    hotspots: DataFrame,
    infrastructure: DataFrame,
    weather: DataFrame,
    condition: str = "Most Common",
    min_risk: float = 0.8,
    roles: Roles = INCIDENT,
) -> DataFrame:
    """Hotspots above ``min_risk`` with the severity factor of their equipment and state,
    and the multiplier of one weather condition (a single value, null if not listed)."""
    row = weather.filter(F.col("weather_condition") == condition).select(
        "severity_multiplier"
    ).first()
    factor = infrastructure.select(
        F.col("infrastructure_type"), F.col(roles.state), "severity_impact_factor"
    )
    risky = hotspots.filter(F.col("risk_score") > min_risk)
    joined = risky.join(factor, ["infrastructure_type", roles.state], "left")
    return joined.withColumn(
        "severity_multiplier", F.lit(row[0] if row else None).cast("double")
    ).orderBy(*_hotspot_order(joined, roles))


# ------------------------------------------------------------ time patterns


def temporal_patterns(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Counts and mean conditions per hour, weekday, month, season and weather text."""
    return df.groupBy(
        F.col(roles.hour).alias("hour_of_day"), F.col(roles.dow).alias("day_of_week"),
        F.col(roles.month).alias("month"), F.col(roles.season).alias("season"),
        F.col(roles.weather).alias("weather_condition"),
    ).agg(
        _rows().alias("accident_count"),
        F.avg(roles.severity).alias("severity_avg"),
        F.avg(roles.temperature).alias("temperature_avg"),
        F.avg(roles.visibility).alias("visibility_avg"),
        F.avg(roles.humidity).alias("humidity_avg"),
        F.avg(roles.wind).alias("wind_speed_avg"),
    )


def peak_accident_times(patterns: DataFrame, factor: float = 1.5) -> DataFrame:
    """(hour, weekday) cells whose mean pattern count exceeds ``factor`` times the mean of
    all patterns.  The overall mean is a window over the at most 168 cells."""
    cells = patterns.groupBy("hour_of_day", "day_of_week").agg(
        F.sum("accident_count").alias("_sum"), _rows().alias("data_points"),
        F.avg("severity_avg").alias("avg_severity"),
    )
    everywhere = Window.partitionBy(F.lit(1))
    overall = F.sum("_sum").over(everywhere) / F.sum("data_points").over(everywhere)
    own = F.col("_sum") / F.col("data_points")
    return (
        cells.withColumns({"avg_accidents": own, "_overall": overall})
        .filter(F.col("avg_accidents") > factor * F.col("_overall"))
        .select("hour_of_day", "day_of_week", "avg_accidents", "avg_severity", "data_points")
        .orderBy(
            F.col("avg_accidents").desc(), F.col("avg_severity").desc(), "hour_of_day",
            "day_of_week",
        )
    )


def temporal_hotspots(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    grouped = df.groupBy(
        F.col(roles.hour).alias("hour_of_day"), F.col(roles.dow).alias("day_of_week"),
        roles.state, roles.county,
    ).agg(_rows().alias("accident_count"), F.avg(roles.severity).alias("severity_avg"))
    return grouped.withColumn(
        "risk_score", risk_score(F.col("severity_avg"), F.col("accident_count"))
    )


# ---------------------------------------------------- equipment and weather

_ANY = "*"  # marks the rows that stand for all incidents of a place


def infrastructure_analysis(
    df: DataFrame, by: Sequence[str] | None = None, roles: Roles = INCIDENT
) -> DataFrame:
    """Per equipment and place: incidents, incidents per equipped city, severity factor
    (mean severity at the equipment over mean severity of the place), peak hour (lowest of
    equals) and the correlation of weather score and severity.

    Each row is repeated once per flag it has, not once per flag there is, and sums of
    products are aggregated on the map side; the peak hour comes from 24 conditional sums."""
    by = list(by or (roles.state, roles.county))
    flags = present_flags(df.columns)
    present = F.array_compact(
        F.array(F.lit(_ANY), *[F.when(F.col(f), F.lit(f)) for f in flags])
    )
    s, w = F.col(roles.severity).cast("double"), F.col(roles.weather_score).cast("double")
    both = s.isNotNull() & w.isNotNull()
    paired = {
        "_n": F.lit(1.0), "_s": s, "_w": w, "_ss": s * s, "_ww": w * w, "_sw": s * w,
    }
    long = df.select(
        *by, F.col(roles.city).alias("_city"), F.col(roles.hour).alias("_hour"),
        s.alias("_severity"),
        *[F.when(both, x).alias(name) for name, x in paired.items()],
        F.explode(present).alias("infrastructure_type"),
    )
    grouped = long.groupBy("infrastructure_type", *by).agg(
        _rows().alias("total_accidents"),
        F.count_distinct("_city").alias("_places"),
        F.avg("_severity").alias("avg_severity"),
        *[F.sum(name).alias(name) for name in paired],
        *[F.count_if(F.col("_hour") == h).alias(f"_h{h}") for h in range(24)],
    )
    peak = F.array_max(
        F.array(
            *[F.struct(F.col(f"_h{h}").alias("n"), F.lit(-h).alias("minus")) for h in range(24)]
        )
    )
    n = F.col("_n")
    covariance = n * F.col("_sw") - F.col("_s") * F.col("_w")
    variances = (n * F.col("_ss") - F.col("_s") * F.col("_s")) * (
        n * F.col("_ww") - F.col("_w") * F.col("_w")
    )
    place = Window.partitionBy(*by)
    place_mean = F.max(
        F.when(F.col("infrastructure_type") == _ANY, F.col("avg_severity"))
    ).over(place)
    return (
        grouped.withColumn("_place_mean", place_mean)
        .filter(F.col("infrastructure_type") != _ANY)
        .select(
            "infrastructure_type", *by, "total_accidents",
            F.try_divide(
                F.col("total_accidents").cast("double"), F.col("_places").cast("double")
            ).alias("accidents_per_infrastructure"),
            F.try_divide(F.col("avg_severity"), F.col("_place_mean")).alias(
                "severity_impact_factor"
            ),
            "avg_severity",
            F.when(peak["n"] > 0, -peak["minus"]).alias("peak_hour"),
            F.when(variances > 0, covariance / F.sqrt(variances)).alias("weather_correlation"),
        )
    )


def weather_impact(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Per weather text: ranges of conditions, incidents, severity multiplier (mean severity
    over the mean of all incidents) and the incidents per state as JSON.  The table is
    aggregated per (weather, state); everything else works on those rows."""
    t, v, h, s = roles.temperature, roles.visibility, roles.humidity, roles.severity
    cells = df.groupBy(F.col(roles.weather).alias("weather_condition"), roles.state).agg(
        F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.min(v).alias("v_min"),
        F.max(v).alias("v_max"), F.min(h).alias("h_min"), F.max(h).alias("h_max"),
        _rows().alias("n"), F.sum(s).alias("s_sum"), F.count(s).alias("s_n"),
        F.min(F.to_date(roles.start)).alias("first"), F.max(F.to_date(roles.start)).alias("last"),
    )
    in_state = F.when(
        F.col(roles.state).isNotNull(),
        F.struct(F.col(roles.state).alias("state"), F.col("n").alias("n")),
    )
    grouped = cells.groupBy("weather_condition").agg(
        F.min("t_min").alias("temperature_range_min"),
        F.max("t_max").alias("temperature_range_max"),
        F.min("v_min").alias("visibility_range_min"),
        F.max("v_max").alias("visibility_range_max"),
        F.min("h_min").alias("humidity_range_min"), F.max("h_max").alias("humidity_range_max"),
        F.sum("n").alias("accident_count"),
        F.sum("s_sum").alias("_s"), F.sum("s_n").alias("_sn"),
        F.min("first").alias("analysis_period_start"),
        F.max("last").alias("analysis_period_end"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(in_state)))).alias(
            "state_breakdown"
        ),
    )
    # incidents are read once: the mean of all comes from the sums per weather text
    grouped = materialise(grouped, "weather-impact")
    overall = grouped.agg(F.try_divide(F.sum("_s"), F.sum("_sn")).alias("_overall"))
    return grouped.crossJoin(F.broadcast(overall)).withColumn(  # one row
        "severity_multiplier",
        F.try_divide(F.try_divide(F.col("_s"), F.col("_sn")), F.col("_overall")),
    ).drop("_s", "_sn", "_overall")


# --------------------------------------------------------------------- KPIs

_PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


#: Scope of a KPI: how many places of the hierarchy state, county, city it names.
_SCOPE_LEVELS = ("state", "county", "city")
#: Stands in a scope for a place that is not known.
UNKNOWN_PLACE = "?"


def kpi_long_table(
    df: DataFrame,
    hotspot_min: int = 5,
    cell_degrees: float = 0.01,
    roles: Roles = INCIDENT,
    calculated_at: dt.datetime | None = None,
) -> DataFrame:
    """``(metric_name, metric_value, time_period, period_start, scope_level, geographic_scope,
    calculated_at)`` per state, county and city.

    A scope is ``CA``, ``CA/County 1`` or ``CA/County 1/City 7``, with ``?`` for a place that is not
    known; levels for which the table has no column are left out.  ``calculated_at`` is the time of
    the run unless it is given.

    Formulas, ours: accidents_par_heure = incidents / hours of the period; severite_moyenne =
    mean severity; weather_impact = mean severity at a weather score of 5 or more over the
    mean; infrastructure_risk = mean severity at equipment / 4; temporal_patterns = share of
    rush-hour incidents; hotspots_count = grid cells with at least ``hotspot_min`` incidents.

    One scan: incidents are summed per day, place and cell, and written.  From that base one
    grouping-sets aggregate makes the sums of all levels, another the cells of all levels; sums
    are then repeated for the four period lengths, cells are not, but rolled from days to weeks
    and months, and from months to years."""
    s, day = F.col(roles.severity), F.to_date(roles.start).alias("day")
    rough = F.col(roles.weather_score) >= 5
    equipped = F.col(roles.equipment_count) > 0

    def sums(name: str, condition: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(condition, s)), F.lit(0)).alias(f"s_{name}"),
            F.count_if(condition & s.isNotNull()).alias(f"n_{name}"),
        ]

    levels = [n for n in _SCOPE_LEVELS if getattr(roles, n) in df.columns]
    places = [
        F.coalesce(F.col(getattr(roles, n)), F.lit(UNKNOWN_PLACE)).alias(n) for n in levels
    ]
    size = F.lit(float(cell_degrees))
    known = F.col(roles.lat).isNotNull() & F.col(roles.lng).isNotNull()
    base = materialise(
        df.filter(F.col(roles.start).isNotNull()).groupBy(
            day, *places, F.when(known, F.floor(F.col(roles.lat) / size)).alias("row"),
            F.when(known, F.floor(F.col(roles.lng) / size)).alias("col"),
        ).agg(
            _rows().alias("n"), F.count_if(F.col(roles.rush_hour)).alias("rush"),
            *sums("all", F.lit(True)), *sums("rough", rough), *sums("equipped", equipped),
        ),
        "kpi-base",
    )
    summed_columns = ("n", "rush", "s_all", "n_all", "s_rough", "n_rough", "s_equipped",
                      "n_equipped")
    daily = _by_scope(base, ["day"], levels, summed_columns)
    period = ["time_period", "period_start", "scope_level", "geographic_scope"]
    summed = _over_periods(daily).groupBy(*period).agg(
        *[F.sum(c).alias(c) for c in summed_columns]
    )
    ended = (
        F.when(F.col("time_period") == "daily", F.date_add("period_start", 1))
        .when(F.col("time_period") == "weekly", F.date_add("period_start", 7))
        .when(F.col("time_period") == "monthly", F.add_months("period_start", 1))
        .otherwise(F.add_months("period_start", 12))
    )
    hours = F.date_diff(ended, F.col("period_start")) * 24
    mean = F.try_divide(F.col("s_all").cast("double"), F.col("n_all").cast("double"))

    def ratio(name: str) -> Column:
        return F.try_divide(F.col(f"s_{name}").cast("double"), F.col(f"n_{name}").cast("double"))

    values = {
        "accidents_par_heure": F.col("n") / hours,
        "severite_moyenne": mean,
        "weather_impact": F.try_divide(ratio("rough"), mean),
        "infrastructure_risk": ratio("equipped") / 4,
        "temporal_patterns": F.col("rush") / F.col("n"),
    }
    main = summed.select(
        *period,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric_name"), v.cast("double").alias("metric_value"))
                    for m, v in values.items()
                ]
            )
        ),
    )
    scope = ["scope_level", "geographic_scope"]
    cells = {"daily": _by_scope(base.filter("row is not null"), ["day", "row", "col"], levels,
                                ("n",)).withColumnRenamed("day", "start")}
    for name, finer in (("weekly", "daily"), ("monthly", "daily"), ("yearly", "monthly")):
        start = F.to_date(F.date_trunc(_PERIOD_UNITS[name], F.col("start"))).alias("start")
        cells[name] = cells[finer].groupBy(start, *scope, "row", "col").agg(F.sum("n").alias("n"))
    spots = reduce(DataFrame.unionAll, [
        rows.groupBy("start", *scope)
        .agg(F.count_if(F.col("n") >= hotspot_min).cast("double").alias("metric_value"))
        .select(F.lit(name).alias("time_period"), F.col("start").alias("period_start"), *scope,
                F.lit("hotspots_count").alias("metric_name"), "metric_value")
        for name, rows in cells.items()
    ])
    at = F.current_timestamp() if calculated_at is None else F.lit(str(calculated_at))
    return (
        main.unionByName(spots)
        .filter(F.col("metric_value").isNotNull())
        .withColumn("calculated_at", at.cast("timestamp"))
    )


def _by_scope(
    base: DataFrame, keys: list[str], levels: list[str], summed: Sequence[str]
) -> DataFrame:
    """Sums per key and scope for every level of the hierarchy, by grouping sets: the table is
    summed per finest scope first, so that only those sums are repeated for the levels."""
    finest = base.groupBy(*keys, *levels).agg(*[F.sum(c).alias(c) for c in summed])
    sets = [[F.col(c) for c in (*keys, *levels[: i + 1])] for i in range(len(levels))]
    # a level that a set leaves out is null; places themselves never are
    depth = sum((F.col(n).isNotNull().cast("int") for n in levels[1:]), F.lit(0))
    named = F.element_at(F.array(*[F.lit(n) for n in levels]), depth + 1)
    grouped = finest.groupingSets(sets, *keys, *levels).agg(
        *[F.sum(c).alias(c) for c in summed])
    return grouped.select(
        *keys, named.alias("scope_level"),
        F.concat_ws("/", *levels).alias("geographic_scope"), *summed)


def _over_periods(daily: DataFrame) -> DataFrame:
    """Repeat day rows for each period length, tagged with the start of the period."""
    starts = F.array(
        *[
            F.struct(
                F.lit(p).alias("time_period"),
                F.to_date(F.date_trunc(unit, F.col("day"))).alias("period_start"),
            )
            for p, unit in _PERIOD_UNITS.items()
        ]
    )
    return daily.select("*", F.inline(starts))


def kpi_window(period: str, until: dt.date) -> tuple[dt.date, dt.date]:
    """Default window of a period length: 30 days, 12 weeks, 365 days or 3 years."""
    return until - dt.timedelta(days=model.KPI_WINDOW_DAYS[period]), until


def kpi_in_window(kpis: DataFrame, until: dt.date | None = None) -> DataFrame:
    """Each period length reduced to its default window, ending at ``until`` or at the
    newest period."""
    if until is None:
        until = one_row(kpis, {"d": F.max("period_start")}).d
        if until is None:
            return kpis
    inside = reduce(
        lambda a, b: a | b,
        [
            (F.col("time_period") == p)
            & F.col("period_start").between(*[F.lit(d) for d in kpi_window(p, until)])
            for p in _PERIOD_UNITS
        ],
    )
    return kpis.filter(inside)


def kpi_evolution(
    kpis: DataFrame, metric: str, days: int = 30, as_of: dt.date | None = None
) -> DataFrame:
    """Mean, least and largest value of a metric per day over the last days."""
    until = F.lit(as_of) if as_of is not None else F.current_date()
    kept = kpis.filter(
        (F.col("metric_name") == metric) & (F.col("period_start") >= F.date_sub(until, days))
    )
    return (
        kept.groupBy(F.to_date("period_start").alias("date"))
        .agg(
            F.avg("metric_value").alias("avg_value"), F.min("metric_value").alias("min_value"),
            F.max("metric_value").alias("max_value"),
        )
        .orderBy("date")
    )


def kpi_lookup(
    kpis: DataFrame, metric: str, period: str, scope_like: str = "%", page: int = 1,
    size: int = 100,
) -> DataFrame:
    """A page of one metric's values, the newest calculation first, then the newest period."""
    found = kpis.filter(
        (F.col("metric_name") == metric) & (F.col("time_period") == period)
        & F.col("geographic_scope").like(scope_like)
    )
    return paged_listing(
        found,
        [F.col("calculated_at").desc(), F.col("period_start").desc(), F.col("geographic_scope")],
        page, size)


def kpi_current(kpis: DataFrame) -> DataFrame:
    """Of every period of a series the value that was calculated last; recalculations are appended
    to a KPI table, so that it can hold several."""
    others = [c for c in kpis.columns if c not in (*_SERIES, "period_start")]
    last = F.max_by(F.struct(*others), "calculated_at").alias("_last")
    return kpis.groupBy(*_SERIES, "period_start").agg(last).select(
        *_SERIES, "period_start", "_last.*")


_SERIES = ("metric_name", "time_period", "geographic_scope")


def kpi_trend(kpis: DataFrame) -> DataFrame:
    """Ours: least-squares slope per day of each series, and its direction."""
    days = F.date_diff(F.col("period_start"), F.lit(dt.date(1970, 1, 1))).cast("double")
    fitted = kpis.groupBy(*_SERIES).agg(
        _rows().alias("points"), F.regr_slope(F.col("metric_value"), days).alias("slope_per_day")
    )
    slope = F.round(F.col("slope_per_day"), 9)
    return fitted.withColumn(
        "trend",
        F.when(slope > 0, "rising").when(slope < 0, "falling").when(slope == 0, "flat"),
    )


def kpi_vs_previous(kpis: DataFrame) -> DataFrame:
    """Each value with the one of the calendar period before in its series, and the change in %;
    null where that period is missing.  A series is taken as one calculation made it."""
    order = Window.partitionBy(*_SERIES, *_calculated(kpis)).orderBy("period_start")
    start = F.col("period_start").cast("date")
    expected = (
        F.when(F.col("time_period") == "daily", F.date_sub(start, 1))
        .when(F.col("time_period") == "weekly", F.date_sub(start, 7))
        .when(F.col("time_period") == "monthly", F.add_months(start, -1))
        .otherwise(F.add_months(start, -12))
    )
    follows = F.lag(start).over(order) == expected
    compared = kpis.withColumn(
        "previous_value", F.when(follows, F.lag("metric_value").over(order)))
    return compared.withColumn(
        "change_percentage",
        F.try_divide(F.col("metric_value") - F.col("previous_value"), F.col("previous_value"))
        * 100,
    )


def _calculated(kpis: DataFrame) -> list[str]:
    return ["calculated_at"] if "calculated_at" in kpis.columns else []


def kpi_dashboard(kpis: DataFrame, period: str = "daily") -> DataFrame:
    """The latest value of every KPI and scope for one period length, as last calculated."""
    return (
        kpi_current(kpis.filter(F.col("time_period") == period))
        .groupBy("metric_name", "geographic_scope")
        .agg(
            F.max_by("metric_value", "period_start").alias("current_value"),
            F.max("period_start").alias("period_start"),
            F.avg("metric_value").alias("avg_value"), F.min("metric_value").alias("min_value"),
            F.max("metric_value").alias("max_value"),
        )
    )


# ----------------------------------------------------------------- listings


def paged_listing(
    df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 100
) -> DataFrame:
    """One page of a sorted table; ``order`` should end in a unique column."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def incident_listing(
    df: DataFrame,
    state: str | None = None,
    severity: int | None = None,
    from_date: dt.date | None = None,
    to_date: dt.date | None = None,
    weather: str | None = None,
    infrastructure: str | None = None,
    sort_by: str = INCIDENT.start,
    descending: bool = True,
    page: int = 1,
    size: int = 100,
    roles: Roles = INCIDENT,
) -> DataFrame:
    """Filtered, sorted page of incidents.  The dates are inclusive days."""
    if from_date and to_date and from_date > to_date:
        raise ValueError("from_date is after to_date")
    tests = []
    if state is not None:
        tests.append(F.col(roles.state) == state)
    if severity is not None:
        tests.append(F.col(roles.severity) == severity)
    if from_date is not None:
        tests.append(F.col(roles.start) >= F.lit(from_date))
    if to_date is not None:
        tests.append(F.col(roles.start) < F.lit(to_date + dt.timedelta(days=1)))
    if weather is not None:
        tests.append(F.col(roles.weather) == weather)
    if infrastructure is not None:
        tests.append(F.col(infrastructure))
    kept = reduce(lambda d, t: d.filter(t), tests, df)
    key = F.col(sort_by)
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(roles.id)]
    return paged_listing(kept, order, page, size)


def incident_summary(df: DataFrame, top: int = 10, roles: Roles = INCIDENT) -> DataFrame:
    """``(section, item, incidents, avg_severity)``: in all, per severity, most frequent
    states and weather texts.  One aggregate feeds all sections."""
    base = df.groupBy(roles.severity, roles.state, roles.weather).agg(_rows().alias("n"))
    sections = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("item")),
        F.struct(F.lit("severity").alias("section"),
                 F.col(roles.severity).cast("string").alias("item")),
        F.struct(F.lit("state").alias("section"), F.col(roles.state).alias("item")),
        F.struct(F.lit("weather").alias("section"), F.col(roles.weather).alias("item")),
    )
    grouped = (
        base.select("n", F.col(roles.severity).alias("_s"), F.inline(sections))
        .groupBy("section", "item")
        .agg(
            F.sum("n").alias("incidents"),
            F.try_divide(
                F.sum(F.col("_s") * F.col("n")), F.sum(F.when(F.col("_s").isNotNull(), F.col("n")))
            ).alias("avg_severity"),
        )
    )
    place = F.row_number().over(
        Window.partitionBy("section").orderBy(
            F.col("incidents").desc(), F.col("item").asc_nulls_last()
        )
    )
    listed = F.col("section").isin("total", "severity") | (F.col("_place") <= top)
    return grouped.withColumn("_place", place).filter(listed).drop("_place")


def retention_split(
    df: DataFrame, time: str, older_than: dt.date, only_if: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(kept, archived)``: rows before the date, and fulfilling the condition if there is
    one, are archived.  Every row is in exactly one part."""
    old = F.col(time) < F.lit(older_than)
    if only_if is not None:
        old = old & only_if
    old = F.coalesce(old, F.lit(False))
    return df.filter(~old), df.filter(old)
