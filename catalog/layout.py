"""Joins, sorts and set operations, partitioning and sizing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import incidents, query, r, table, tidy, with_incidents
from wayside import model
from wayside.operators import joins as J, layout as L, quality as Q, serving as G, silver
from wayside.sinks import tables as S
from wayside.sources.scratch import materialise, scratch_path

# ------------------------------------------------------------------- joins

_SHIFT = 40


def _orders_by_customer(how: str):
    def run(spark, sf):
        customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey")
        orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
        # keys moved so that some customers have no orders and some orders no customer
        shifted = (F.col("custkey") + F.lit(_SHIFT)).alias("custkey")
        return J.sized_equi_join(customers.select("custkey", "c_mktsegment"),
                                 orders.select(shifted, "o_orderkey"), "custkey", how)

    return run


_SIDES = ("(select c_custkey as custkey, c_mktsegment from customer) l",
          f"(select o_custkey + {_SHIFT} as custkey, o_orderkey from orders) o")
for _how, _sql_how in (("inner", "join"), ("left", "left join"), ("right", "right join"),
                       ("full", "full join"), ("left_semi", "semi join"),
                       ("left_anti", "anti join")):
    _shown = "custkey, c_mktsegment" + ("" if "left_" in _how else ", o_orderkey")
    query(f"sized_equi_join_{_how}",
          f"select {_shown} from {_SIDES[0]} {_sql_how} {_SIDES[1]} using (custkey)")(
        _orders_by_customer(_how))


@query("sized_equi_join", """
select c_mktsegment, count(*) as lines, round(sum(l_extendedprice), 2) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
group by c_mktsegment""")
def _sized(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"),
                                                "l_extendedprice")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"),
                                               F.col("o_custkey").alias("custkey"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"),
                                                    "c_mktsegment")
    joined = J.sized_equi_join(J.sized_equi_join(lines, orders, ["orderkey"]), customers,
                               ["custkey"])
    return tidy(joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("revenue")), 2)


@query("broadcast_small", """
select n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey
group by n_name""")
def _broadcast(spark, sf):
    nations = J.broadcast_small(table(spark, sf, "nation"))
    suppliers = table(spark, sf, "supplier")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(
        "n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("lookup_join", """
select c_custkey, n_name, r_name from customer
left join nation on c_nationkey + (c_custkey % 7) = n_nationkey
left join region on n_regionkey = r_regionkey""")
def _lookup(spark, sf):
    """Codes moved by up to six, so that some are unknown."""
    coded = table(spark, sf, "customer").withColumn(
        "code", F.col("c_nationkey") + F.col("c_custkey") % 7)
    named = J.lookup_join(coded, table(spark, sf, "nation"), "code", "n_nationkey",
                          ["n_name", "n_regionkey"])
    placed = J.lookup_join(named, table(spark, sf, "region"), "n_regionkey", "r_regionkey",
                           ["r_name"])
    return placed.select("c_custkey", "n_name", "r_name")


@query("bucketed_join", """
select o_orderpriority, count(*) as lines, round(sum(l_quantity), 2) as quantity
from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority""")
def _bucketed(spark, sf):
    mark = uuid.uuid4().hex[:12]
    layout = S.TableLayout(16, ("orderkey",), (), ("orderkey",))
    sides = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        sides[name] = S.write_bucketed_table(
            table(spark, sf, name).withColumnRenamed(key, "orderkey"),
            f"{name}_{mark}", layout, scratch_path(spark, f"bucketed-{name}"))
    return tidy(J.bucketed_join(sides["orders"], sides["lineitem"], "orderkey", 16)
                .groupBy("o_orderpriority")
                .agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")), 2)


_KM = """6371 * acos(greatest(-1.0e0, least(1.0e0, cos(radians({a})) * cos(radians({c}))
 * cos(radians({d}) - radians({b})) + sin(radians({a})) * sin(radians({c})))))"""


@query("radius_search", with_incidents(f"""
select ID, Start_Time, {r('km')} as distance_km from (select ID, Start_Time,
 {_KM.format(a='40.7128e0', b='(-74.006e0)', c='Start_Lat', d='Start_Lng')} as km
 from incidents where Start_Lat between -90 and 90) where km < 300"""))
def _radius(spark, sf):
    near = J.radius_search(
        incidents(spark, sf), 40.7128, -74.0060, 300, "Start_Lat", "Start_Lng",
        order=[F.col("ID"), F.col("Start_Time")])
    return tidy(near.select("ID", "Start_Time", "distance_km"))


_CITIES = ", ".join(f"('{code}', {lat!r}e0, {lng!r}e0)"
                    for code, (lat, lng) in model.CITY_CENTRES.items())


@query("radius_join", with_incidents(f"""
select code, ID, Start_Time, {r('km')} as distance_km from (select code, ID, Start_Time,
 {_KM.format(a='c_lat', b='c_lng', c='Start_Lat', d='Start_Lng')} as km
 from incidents, (values {_CITIES}) as c(code, c_lat, c_lng)
 where Start_Lat between -90 and 90) where km < 150"""))
def _radius_join(spark, sf):
    centres = spark.createDataFrame(
        [(code, *place) for code, place in model.CITY_CENTRES.items()],
        "code string, centre_lat double, centre_lng double")
    places = incidents(spark, sf).select(
        "ID", "Start_Time", F.col("Start_Lat").alias("latitude"),
        F.col("Start_Lng").alias("longitude"))
    pairs = J.radius_join(J.broadcast_small(centres), places, 150)
    return tidy(pairs.select("code", "ID", "Start_Time", "distance_km"))


# ----------------------------------------------- sorts, limits, set operations

@query("order_by", """
select o_orderkey, o_totalprice,
 row_number() over (order by o_totalprice desc, o_orderkey) as place from orders""")
def _order(spark, sf):
    """The whole table sorted; the places follow from the rows before each sorted part."""
    ordered = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), F.col("o_orderkey").asc())
    return L.with_place(ordered)


@query("paged_listing", """
select l_orderkey, l_linenumber, l_shipdate from lineitem
order by l_shipdate desc, l_orderkey, l_linenumber limit 25 offset 50""")
def _paged(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return G.paged_listing(
        lines, [F.col("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")],
        page=3, size=25)


@query("empty_like", "select * from customer limit 0")
def _empty(spark, sf):
    return silver.empty_like(table(spark, sf, "customer"))


@query("union_positional", """
select c_name as name, c_acctbal as balance from customer
union all select s_name, s_acctbal from supplier""")
def _union(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return customers.union(table(spark, sf, "supplier").select("s_name", "s_acctbal"))


@query("distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem")
def _distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("distinct_keys", with_incidents("""
select count(distinct State) as known_states,
 count(distinct State) + max(case when State is null then 1 else 0 end) as distinct_values
from incidents"""))
def _distinct_keys(spark, sf):
    # count_distinct leaves null out; distinct().count() takes it as a value
    values = incidents(spark, sf).select("State").distinct()
    return values.agg(F.count("State").alias("known_states"),
                      F.count(F.lit(1)).alias("distinct_values"))


# ------------------------------------------------------------- partitioning

def _placed(spark, sf):
    return L.partition_columns(incidents(spark, sf))


PLACED = """placed as (select *, cast(Start_Time as date) as partition_date,
 coalesce(State, 'UNKNOWN') as partition_state from incidents)"""


@query("partition_columns", with_incidents("""
select ID, partition_date, cast(year(partition_date) as int) as partition_year,
 cast(month(partition_date) as int) as partition_month,
 cast(day(partition_date) as int) as partition_day, partition_state from placed""", PLACED))
def _columns(spark, sf):
    return _placed(spark, sf).select(
        "ID", "partition_date", "partition_year", "partition_month", "partition_day",
        "partition_state")


@query("rows_per_key", with_incidents(
    "select partition_state, count(*) as rows from placed group by 1", PLACED))
def _rows_per_key(spark, sf):
    return L.rows_per_key(_placed(spark, sf), "partition_state")


@query("distribution_analysis", with_incidents("""
select 'date' as level, cast(partition_date as varchar) as key, count(*) as rows from placed
 group by 2
union all select 'state', partition_state, count(*) from placed group by 2
union all select 'all', 'all', count(*) from placed""", PLACED))
def _analysis(spark, sf):
    return L.distribution_analysis(_placed(spark, sf))


_SUMMARY = """summary as (select count(*) as total_rows,
 count(distinct partition_date) as unique_dates, count(distinct partition_state) as unique_states,
 count(*) * 1.0e0 / count(distinct partition_state) as avg_rows_per_state,
 count(*) * 1.0e0 / count(distinct partition_date) as avg_rows_per_date from placed),
advised as (select *, case when unique_dates > 100 and unique_states > 20 then 'hierarchical'
 when avg_rows_per_date > avg_rows_per_state and unique_dates > 10 then 'date_primary'
 when avg_rows_per_state > avg_rows_per_date and unique_states > 5 then 'state_primary'
 else 'simple' end as recommended_strategy from summary)"""


@query("recommend_partitioning", with_incidents(f"""
select total_rows, unique_dates, unique_states, {r('avg_rows_per_state')} as avg_rows_per_state,
 {r('avg_rows_per_date')} as avg_rows_per_date, recommended_strategy from advised""",
    PLACED, _SUMMARY))
def _recommend(spark, sf):
    return tidy(L.distribution_summary(_placed(spark, sf)))


@query("partitions_for_state", with_incidents("""
select cast(least(greatest(1, floor(count(*) / (128 * 1024 * 1024 / 1000.0e0))),
 50 * count(distinct partition_state)) as int) as optimal_partitions from placed""", PLACED))
def _partitions_for_state(spark, sf):
    return L.partitions_for_state(_placed(spark, sf))


@query("estimate_partitions", with_incidents("""
select 'date_only' as strategy, unique_dates as estimated_partitions, recommended_strategy
 from advised
union all select 'state_only', unique_states, recommended_strategy from advised
union all select 'hierarchical', least(unique_dates * unique_states, 50 * unique_states),
 recommended_strategy from advised""", PLACED, _SUMMARY))
def _estimate(spark, sf):
    placed = _placed(spark, sf)
    by_date, by_state, both = (
        L.estimate_partitions(placed, s) for s in ("date_only", "state_only", "hierarchical"))
    return by_date.unionAll(by_state).unionAll(both)


def _spread_check(strategy: str, keys: tuple[str, ...]):
    """Rows per key, and over how many tasks a key is spread after repartitioning: one."""
    def run(spark, sf):
        placed = L.apply_partitioning(incidents(spark, sf), strategy)
        return placed.withColumn("task", F.spark_partition_id()).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("task").alias("tasks"))

    return run


_PARTS = """parts as (select *, cast(year(partition_date) as int) as partition_year,
 cast(month(partition_date) as int) as partition_month,
 cast(day(partition_date) as int) as partition_day from placed)"""
for _name, _strategy, _keys in (
    ("repartition_by_date", "date_only", ("partition_year", "partition_month", "partition_day")),
    ("repartition_by_state", "state_only", ("partition_state",)),
    ("repartition_hierarchical", "hierarchical",
     ("partition_year", "partition_month", "partition_state")),
    ("repartition_auto", "auto", ("partition_year", "partition_month", "partition_day")),
):
    query(_name, with_incidents(
        f"select {', '.join(_keys)}, count(*) as rows, cast(1 as bigint) as tasks from parts"
        f" group by all", PLACED, _PARTS))(_spread_check(_strategy, _keys))


# ------------------------------------------------------------------- sizing

_LINES = """select l_returnflag, count(*) as lines, round(sum(l_quantity), 2) as quantity
from lineitem group by l_returnflag"""


def _line_totals(df):
    return tidy(df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")), 2)


@query("right_size_partitions", _LINES)
def _right_size(spark, sf):
    return _line_totals(L.right_size_partitions(table(spark, sf, "lineitem")))


@query("repartition_to_size", _LINES)
def _to_size(spark, sf):
    return _line_totals(L.repartition_to_size(table(spark, sf, "lineitem"), ["l_returnflag"]))


@query("coalesce_small_files", _LINES)
def _coalesce(spark, sf):
    return _line_totals(L.coalesce_small_files(table(spark, sf, "lineitem")))


@query("balanced", _LINES)
def _balanced(spark, sf):
    return _line_totals(L.balanced(table(spark, sf, "lineitem"), "l_returnflag"))


@query("estimate_size", """
select 'rows' as basis, count(*) as sampled_rows, count(*) as total_rows,
 round(avg(strlen('{"key":' || c_custkey || ',"name":"' || c_name || '","segment":"'
  || c_mktsegment || '"}')), 6) as mean_row_bytes,
 round(sum(strlen('{"key":' || c_custkey || ',"name":"' || c_name || '","segment":"'
  || c_mktsegment || '"}')) / 1048576.0e0, 6) as estimated_mb
from customer""")
def _size(spark, sf):
    """A derived frame, all of whose rows are measured; sizes by files are in tests/test_layout.py."""
    derived = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment")).distinct()
    return tidy(L.estimate_size(derived, fraction=1.0))


@query("estimate_size_files", """
select 'files' as basis, count(*) as sampled_rows, count(*) as total_rows from lineitem
where l_returnflag = 'R'""")
def _file_size(spark, sf):
    kept = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return L.estimate_size(kept).select("basis", "sampled_rows", "total_rows")


@query("cache_by_size", """
select State, count(*) as rows, max(distance_miles) as farthest from (select
 case when user_id % 2 = 0 then 'even' else 'odd' end as State, value as distance_miles
 from events) group by State""")
def _cache(spark, sf):
    cached = L.cache_by_size(table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("State"),
        F.col("value").alias("distance_miles")), limit_mb=1000)
    found = materialise(cached.groupBy("State").agg(
        F.count(F.lit(1)).alias("rows"), F.max("distance_miles").alias("farthest")))
    cached.unpersist()
    return found


@query("top_regions_customers", """
select c_nationkey, count(*) as count from customer group by c_nationkey
order by count desc, c_nationkey limit 10""")
def _top_customers(spark, sf):
    return Q.top_regions(table(spark, sf, "customer"), "c_nationkey")
