"""Domain views over star-schema tables, as SQL that Spark and DuckDB run unchanged.

The tables have no coordinates; they are derived by integer arithmetic first and doubles last, in
a fixed order. ``{part}`` and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: closed boundary polygon, (lat, lon)
BOUNDS = [(21.62, -102.85), (22.45, -102.91), (22.55, -101.75), (21.71, -101.65), (21.62, -102.85)]
SOUTH_WEST, NORTH_EAST = (21.7, -102.8), (22.4, -101.8)


def _coords(key: str, width: str) -> str:
    return (
        f"21.55e0 + ({key} % 41 * 17 % 41)/41e0*1.05e0 + (({key}*7919 % 1009)/1009e0 - 0.5e0)*{width} as lat, "
        f"-102.95e0 + ({key} % 41 * 29 % 41)/41e0*1.35e0 + (({key}*104729 % 1013)/1013e0 - 0.5e0)*{width} as lon"
    )


def _width(key: str) -> str:
    return f"case when {key} % 7 = 0 then 0.6e0 when {key} % 7 < 3 then 0.06e0 else 0.03e0 end"


VIEWS = {
    "geo_points": f"select p_partkey as point_id, p_partkey % 25 as scenario_id, {_coords('p_partkey', 'w')} from (select p_partkey, {_width('p_partkey')} as w from {{part}}) q",
    "postal_directory": f"""select p_partkey as idx, case when p_partkey % 10 = 0 then cast(1000 + p_partkey % 500 as string) else cast(20000 + p_partkey % 700 as string) end as cp,
        case when p_partkey % 97 <> 5 then lat end as lat, case when p_partkey % 97 <> 5 then lon end as lon,
        case when p_partkey % 89 <> 7 then 'Col. ' || cast(p_partkey % 300 as string) end as address
        from (select p_partkey, {_coords('p_partkey', 'w')} from (select p_partkey, {_width('p_partkey')} as w from {{part}}) q) r""",
    "associates": """select c_nationkey as scenario_id, c_custkey as person_id, c_name as name,
        case c_custkey % 17 when 0 then null when 1 then 'ABCDE' when 2 then '123' when 3 then '99999'
        when 4 then '0' || cast(1000 + c_custkey % 500 as string) else cast(20000 + c_custkey * 31 % 700 as string) end as postal_code from {customer}""",
    "stops": f"""select route_id, pos, route_id * 1000 + pos as stop_id, cast(floor(route_id / 50e0) as bigint) % 5 as scenario_id, l_partkey as part_id, {_coords('l_partkey', 'w')}
        from (select l_orderkey as route_id, l_partkey, {_width('l_partkey')} as w,
              cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as pos
              from {{lineitem}}) q""",
    "people_points": f"select p_partkey as person_id, p_partkey % 5 as scenario_id, {_coords('p_partkey', 'w')} from (select p_partkey, {_width('p_partkey')} as w from {{part}}) q",
    "nodes": f"""select scenario_id, node_id, lat, lon, weight from (
        select p_partkey % 25 as scenario_id, p_partkey + 25 as node_id, cast(1 + p_partkey % 9 as double) as weight, {_coords('p_partkey', 'w')}
        from (select p_partkey, {_width('p_partkey')} as w from {{part}}) q
        union all
        select distinct p_partkey % 25 as scenario_id, cast(0 as bigint) as node_id, 0e0 as weight, 22.05e0 + p_partkey % 25 / 500e0 as lat, -102.3e0 + p_partkey % 25 / 400e0 as lon from {{part}}) u""",
    "timetable": """select event_id as idx, lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(minute(ts) as string), 2, '0') as departure,
        cast(cast(floor((30 + event_id % 60) / 60e0) as bigint) as string) || ':' || lpad(cast((30 + event_id % 60) % 60 as string), 2, '0') as duration from {events}""",
}


def sql(name: str) -> str:
    """DuckDB form: tables by their own names."""
    tables = {t: t for t in ("part", "customer", "lineitem", "events", "orders")}
    return VIEWS[name].format(**tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer", "lineitem", "events", "orders") if "{" + t + "}" in text}
    return spark.sql(text, **tables)
