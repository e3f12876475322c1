"""The SQL that checks ``queries()``, written for DuckDB over the raw tables.

Each statement is a chain of common table expressions: the ride star over the
order tables, the analysis tables, then one final select. Parts that follow a
rule over features or tree levels are generated from that rule.
"""

from __future__ import annotations

FEATURES = [
    "hour", "is_weekend", "month", "viajes_count", "ingreso_promedio", "duracion_promedio",
    "temperatura_promedio", "variabilidad_ingresos", "viajes_con_excedente",
]
MART = [
    "start_station_id", "end_station_id", "hour", "day_name", "is_weekend", "month",
    "temperature_2m", "relative_humidity_2m", "bike_type_id", "duracion_minutos",
    "member_casual", "ingreso_min_excedente", "minutos_incluidos", "tarifa_minuto_excedente",
]
MART_DOUBLES = {"temperature_2m", "relative_humidity_2m", "duracion_minutos", "ingreso_min_excedente", "tarifa_minuto_excedente"}
MART_TYPES = {
    "start_station_id": "string", "end_station_id": "string", "hour": "int", "day_name": "string",
    "is_weekend": "boolean", "month": "int", "temperature_2m": "double", "relative_humidity_2m": "double",
    "bike_type_id": "int", "duracion_minutos": "double", "member_casual": "string",
    "ingreso_min_excedente": "double", "minutos_incluidos": "int", "tarifa_minuto_excedente": "double",
}
TREES, MAX_SAMPLE, LEVELS = 50, 1000, 10
FEATURE_COUNT = 25  # columns of the revenue models

TIME_ID = (
    "cast(year(l_shipdate)*1000000 + month(l_shipdate)*10000 + day(l_shipdate)*100 + l_linenumber*3 as bigint)"
)

# Tables in order of dependence; a statement takes those it names, directly or not.
TABLES: dict[str, str] = {
    "dim_member_type": "select * from (values (1,'casual'),(2,'member')) t(member_type_id,member_casual)",
    "dim_tarifa": """select member_type_id, bike_type_id, minutos_incluidos, cast(rate as double) as tarifa_minuto_excedente
        from (values (1,1,30,0.39),(1,2,30,0.26),(2,1,45,0.25),(2,2,45,0.17))
             t(member_type_id,bike_type_id,minutos_incluidos,rate)""",
    "trips": f"""select ss.n_name as start_station_id, es.n_name as end_station_id, {TIME_ID} as start_time_id,
            case when c_mktsegment <> 'BUILDING' then 1 else 2 end as member_type_id,
            1 + (l_linenumber % 2) as bike_type_id, l_quantity*2 as duracion_minutos
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
             join nation es on c_nationkey=es.n_nationkey join supplier on l_suppkey=s_suppkey
             join nation ss on s_nationkey=ss.n_nationkey""",
    "dim_time": f"""select distinct {TIME_ID} as time_id, l_linenumber*3 as hour, dayname(l_shipdate) as day_name,
            isodow(l_shipdate) >= 6 as is_weekend, cast(month(l_shipdate) as integer) as month,
            2023 + (year(l_shipdate) % 2) as year
        from lineitem""",
    "weather": """select time_id, cast((time_id*37)%400 as double)/cast(10.0 as double) - cast(5.0 as double) as temperature_2m,
            cast((time_id*37)%400 as double)/cast(10.0 as double) - cast(5.0 as double)
              + cast((time_id % 7) - 3 as double)/cast(2.0 as double) as apparent_temperature,
            cast(40.0 as double) + cast((time_id*13)%60 as double) as relative_humidity_2m
        from dim_time""",
    "balance_event": f"""select n_name as station_id, {TIME_ID} as time_id, -l_quantity as balance_net,
            case when l_returnflag='R' then 'DESABASTO' else 'EXCESO' end as tipo_evento_balance,
            l_discount >= cast(0.08 as double) as flag_evento_critico
        from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey""",
    "priced": """select trips.*, dt.hour, dt.day_name, dt.is_weekend, dt.month, dt.year, w.* exclude (time_id),
            m.member_casual, f.minutos_incluidos, f.tarifa_minuto_excedente,
            case when duracion_minutos > minutos_incluidos
                 then (duracion_minutos - minutos_incluidos) * tarifa_minuto_excedente
                 else cast(0 as double) end as ingreso_min_excedente
        from trips join dim_time dt on start_time_id = dt.time_id join weather w on start_time_id = w.time_id
             join dim_member_type m using (member_type_id) join dim_tarifa f using (member_type_id, bike_type_id)
        where dt.year = 2024""",
    "mart": f"select {', '.join(MART)} from priced",
    "training": """select start_station_id as station_id, start_time_id as time_id, hour, day_name, is_weekend, month,
            temperature_2m, apparent_temperature, relative_humidity_2m, bike_type_id, duracion_minutos,
            minutos_incluidos, tarifa_minuto_excedente, ingreso_min_excedente
        from priced p where member_casual = 'casual' and not exists (
            select 1 from balance_event b where tipo_evento_balance = 'DESABASTO' and flag_evento_critico
               and b.station_id = p.start_station_id and b.time_id = p.start_time_id)""",
    "profile_all": """select member_casual, start_station_id as station_id, hour, is_weekend, month,
            count(*) as viajes_count, avg(ingreso_min_excedente) as ingreso_promedio,
            sum(ingreso_min_excedente) as ingreso_total, avg(duracion_minutos) as duracion_promedio,
            avg(temperature_2m) as temperatura_promedio, stddev_samp(ingreso_min_excedente) as variabilidad_ingresos,
            max(ingreso_min_excedente) as ingreso_maximo,
            count(*) filter (where ingreso_min_excedente > 0) as viajes_con_excedente
        from priced group by all having count(*) >= 5""",
    "profile": "select * exclude (member_casual) from profile_all where member_casual = 'casual'",
    "stats": """select start_station_id as station_id, avg(duracion_minutos) as duracion_promedio_estacion,
            count(*) as viajes_totales, avg(case when bike_type_id = 1 then 1.0::double else 0.0::double end) as prop_bike_type_1
        from trips join dim_time dt on start_time_id = time_id join dim_member_type using (member_type_id)
        where member_casual = 'casual' and year = 2024 group by 1""",
    "events": """select e.*, coalesce(duracion_promedio_estacion, 35) as duracion_promedio_estacion,
            coalesce(prop_bike_type_1, 0.7) as prop_bike_type_1, 30 as minutos_incluidos,
            round(abs(balance_net) * cast(0.6 as double)) as viajes_perdidos_estimados
        from (select distinct station_id, b.time_id, balance_net, hour, day_name, is_weekend, month,
                     temperature_2m, apparent_temperature, relative_humidity_2m
              from balance_event b join dim_time dt on b.time_id = dt.time_id join weather w on b.time_id = w.time_id
              where tipo_evento_balance = 'DESABASTO' and flag_evento_critico and year = 2024) e
             left join stats using (station_id)""",
    "balance": """select station_id, cast(sum(o) as bigint) as departures, cast(sum(i) as bigint) as arrivals,
            cast(sum(i) - sum(o) as bigint) as balance, cast(abs(sum(i) - sum(o)) as bigint) as abs_balance
        from (select start_station_id as station_id, 1 as o, 0 as i from mart
              union all select end_station_id, 0, 1 from mart) where station_id is not null group by 1""",
    "bounds": "select min(temperature_2m) as lo, max(temperature_2m) as hi, (max(temperature_2m) - min(temperature_2m)) / 10.0::double as step from mart",
    "binned": "select m.*, "
    + " + ".join(f"cast(temperature_2m > {i}.0::double * step + lo as integer)" for i in range(1, 10))
    + " as temp_bin from mart m, bounds",
    "impact": """select temp_bin, avg(ingreso_min_excedente) as avg_revenue, sum(ingreso_min_excedente) as total_revenue,
            count(ingreso_min_excedente) as trip_count, avg(temperature_2m) as avg_temperature,
            avg(duracion_minutos) as avg_duration from binned group by 1""",
    "found": """select * from mart where regexp_matches(start_station_id, 'nation_[12]\\d$', 'i')
            and regexp_matches(member_casual, 'CAS|mem', 'i')
            and ingreso_min_excedente >= 1 and ingreso_min_excedente <= 25""",
    "keyed": """select *, md5(concat_ws('|', station_id, time_id, bike_type_id,
            cast(round(duracion_minutos*1000) as bigint), 42)) as h from training""",
    "codes": """select station_id, cast(row_number() over (order by station_id) - 1 as integer) as station_id_encoded
        from (select distinct station_id from training)""",
    # Anomaly detection
    "med": "select " + ", ".join(
        f"quantile_cont({f}, 0.5) as {f}" for f in FEATURES if f != "is_weekend") + " from profile",
    "clean": "select p.station_id, p.ingreso_total, p.ingreso_maximo, " + ", ".join(
        "cast(p.is_weekend as double) as is_weekend" if f == "is_weekend"
        else f"coalesce(cast(p.{f} as double), med.{f}) as {f}" for f in FEATURES) + " from profile p, med",
    "moments": "select " + ", ".join(
        f"avg({f}) as m_{f}, case when stddev_pop({f}) = 0 then 1 else stddev_pop({f}) end as s_{f}"
        for f in FEATURES) + " from clean",
    "scaled": "select clean.*, concat_ws('|', station_id, cast(hour as int), cast(is_weekend as int), cast(month as int)) as row_key, "
    + ", ".join(f"round(({f} - m_{f}) / s_{f}, 9) + 0 as z{i}" for i, f in enumerate(FEATURES))
    + " from clean, moments",
    "new_scaled": "select p.station_id, cast(p.hour as double) as hour, cast(p.is_weekend as double) as is_weekend, "
    "cast(p.month as double) as month, "
    "concat_ws('|', station_id, hour, cast(is_weekend as int), month) as row_key, "
    + ", ".join(f"round((cast(p.{f} as double) - m_{f}) / s_{f}, 9) + 0 as z{i}" for i, f in enumerate(FEATURES))
    + " from profile_all p, moments where member_casual = 'member'",
    "size": f"""select count(*) as n, least({MAX_SAMPLE}, count(*)) as psi,
            cast(ceil(log2(greatest(2, least({MAX_SAMPLE}, count(*))))) as integer) as deepest from scaled""",
}


def _draw(text: str) -> str:
    return f"((cast('0x' || substr(md5({text}), 1, 8) as bigint) + 1) / cast(4294967297 as double))"


def _path(n: str) -> str:
    return (
        f"(case when {n} <= 1 then 0::double when {n} = 2 then 1::double "
        f"else 2*(ln({n}-1) + 0.5772156649015329::double) - 2*cast({n}-1 as double)/{n} end)"
    )


Z = [f"z{i}" for i in range(len(FEATURES))]
ZS = ", ".join(Z)


def _forest_tables() -> dict[str, str]:
    """Tree growth level by level, then the walk of the rows through the levels."""
    tables = {
        "level0": f"""select tree, 1 as node, {ZS} from (
                select t.tree, s.*, row_number() over (partition by t.tree order by
                    {_draw("concat_ws('|', s.row_key, t.tree, 42)")}, s.row_key) as place
                from scaled s, (select unnest(range({TREES})) as tree) t) where place <= (select psi from size)"""
    }
    for d in range(LEVELS + 1):
        low = "[" + ", ".join(f"min({z})" for z in Z) + "]"
        high = "[" + ", ".join(f"max({z})" for z in Z) + "]"
        tables[f"group{d}"] = (
            f"select tree, node, count(*) as n, {low} as lo, {high} as hi from level{d} group by 1, 2"
        )
        tables[f"pick{d}"] = f"""select *, list_filter(range({len(Z)}), lambda i: lo[i+1] < hi[i+1]) as varied,
                {_draw("concat_ws('|', 42, tree, node, 'f')")} as uf,
                {_draw("concat_ws('|', 42, tree, node, 't')")} as ut from group{d}"""
        tables[f"split{d}"] = f"""select tree, node, n, feature,
                case when feature < 0 then 0 else lo[feature+1] + ut * (hi[feature+1] - lo[feature+1]) end as threshold
            from (select p.*, case when {d} >= deepest or p.n <= 1 or len(varied) = 0 then -1
                     else varied[1 + cast(floor(uf * len(varied)) as integer)] end as feature
                  from pick{d} p, size)"""
        if d < LEVELS:
            tables[f"level{d + 1}"] = f"""select l.tree, 2*l.node
                    + cast([{ZS}][s.feature+1] > s.threshold as integer) as node, {ZS}
                from level{d} l join split{d} s using (tree, node) where s.feature >= 0"""
    tables["nodes"] = " union all ".join(
        f"select tree, node, feature, threshold, {d} + {_path('n')} as path from split{d}"
        for d in range(LEVELS + 1)
    )
    return tables


def _walk_tables(rows: str, name: str) -> dict[str, str]:
    tables = {
        f"{name}_walk0": f"""select row_key, [{ZS}] as x, tree, 1 as node
            from {rows}, (select unnest(range({TREES})) as tree) t"""
    }
    for d in range(LEVELS):
        tables[f"{name}_walk{d + 1}"] = f"""select row_key, x, w.tree, case when coalesce(feature, -1) < 0 then node
                else 2*node + cast(x[feature+1] > threshold as integer) end as node
            from {name}_walk{d} w left join nodes using (tree, node)"""
    tables[f"{name}_score"] = f"""select row_key,
            round(-pow(2::double, -(sum(coalesce(path, floor(log2(node)))) / {TREES})
                  / (select {_path('psi')} from size)), 9) as score
        from {name}_walk{LEVELS} left join nodes using (tree, node) group by 1"""
    return tables


def _outlier_tables() -> dict[str, str]:
    gap = " + ".join(f"(a.{z}-b.{z})*(a.{z}-b.{z})" for z in Z)
    return {
        "k": "select greatest(1, least(20, n // 10)) as k from size",
        "points": f"select {ZS}, min(row_key) as pid, count(*) as w from scaled group by {ZS}",
        "pairs": f"""select a.pid, b.pid as nbr, sqrt({gap}) as dist,
                case when a.pid = b.pid then b.w - 1 else b.w end as w from points a, points b""",
        "edges": """select pid, nbr, dist, least(w, k - before) as w from (
                select *, coalesce(sum(w) over (partition by pid order by dist, nbr
                    rows between unbounded preceding and 1 preceding), 0) as before
                from pairs where w > 0), k where before < k""",
        "kdist": "select pid, max(dist) as kd from edges group by 1",
        "density": """select e.pid, 1 / (sum(w * greatest(kd, dist)) / sum(w) + 1e-10::double) as lrd
            from edges e join kdist d on e.nbr = d.pid group by 1""",
        "factor": """select e.pid, round((sum(w * d.lrd) / sum(w)) / any_value(o.lrd), 9) as lof
            from edges e join density d on e.nbr = d.pid join density o on e.pid = o.pid group by 1""",
        "lof_rows": f"""select s.row_key, f.lof from scaled s join points p on
            {' and '.join(f's.{z} = p.{z}' for z in Z)} join factor f using (pid)""",
        "cuts": """select (select quantile_cont(score, 0.1) from fit_score) as iso_cut,
            (select quantile_cont(-lof, 0.1) from lof_rows) as lof_cut""",
        "flagged": """select s.*, lof, score - iso_cut as score_iso,
                case when score < iso_cut then -1 else 1 end as anomalia_iso,
                case when -lof < lof_cut then -1 else 1 end as anomalia_lof
            from scaled s join fit_score using (row_key) join lof_rows using (row_key), cuts""",
        "consensus": "select * from flagged where anomalia_iso = -1 and anomalia_lof = -1",
        "anomaly_counts": """select count(*) as total_records,
                count(*) filter (where anomalia_iso = -1) as num_anomalias_iso,
                count(*) filter (where anomalia_lof = -1) as num_anomalias_lof,
                count(*) filter (where anomalia_iso = -1 and anomalia_lof = -1) as num_anomalies
            from flagged""",
    }


TABLES |= _forest_tables() | _walk_tables("scaled", "fit") | _walk_tables("new_scaled", "new") | _outlier_tables()

_RIDE = "concat_ws('|', station_id, time_id, cast(round(balance_net*1000) as bigint), trip_no"
TABLES |= {
    "lost": f"""select station_id, time_id, balance_net, trip_no, hour, is_weekend, month, day_name,
            temperature_2m as temperature, relative_humidity_2m as humidity,
            case when {_draw(_RIDE + ", 42, 'bike')")} < prop_bike_type_1 then 1 else 2 end as bike_type,
            round(greatest(10, least(120, duracion_promedio_estacion + 15
                * sqrt(-2 * ln({_draw(_RIDE + ", 42, 'duration', 'n1')")}))
                * cos(2 * pi() * {_draw(_RIDE + ", 42, 'duration', 'n2')")}))), 6) as duration
        from (select *, unnest(range(1, cast(viajes_perdidos_estimados as bigint) + 1)) as trip_no from events)""",
    "lost_scored": "select *, greatest(0, duration - 30) * cast(0.39 as double) as prediction from lost",
    "loss": """select sum(prediction) as total_loss, cast(count(*) as double) as lost_trips,
            sum(prediction) / count(*) as loss_per_trip,
            (select count(distinct station_id) from events) as affected_stations,
            (select count(*) from events) as events_analyzed, (select count(*) from events) as sample_size,
            cast(1 as double) as scaling_factor from lost_scored""",
    "grid": """select station_id, 7 as month, 1 as bike_type, cast(hour as integer) as hour,
            cast(temperature as double) as temperature, cast(duration as double) as duration,
            false as is_weekend, cast(60 as double) as humidity,
            greatest(0, duration - 30) * cast(0.39 as double) as prediction
        from (select distinct start_station_id as station_id from mart),
             (select unnest(range(24)) as hour), (select unnest(range(5, 36, 5)) as temperature),
             (select unnest(range(20, 81, 10)) as duration)""",
    "values_of": "select greatest(0, duracion_minutos - 30) * cast(0.39 as double) as v from mart",
}


def _names(sql: str) -> set[str]:
    words = "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()
    return set(words) & TABLES.keys()


def _with(final: str) -> str:
    """``final`` preceded by the tables it depends on."""
    needed, todo = set(), _names(final)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= _names(TABLES[name]) - needed
    # Self-mention, as in a column named like its table, is not a dependence.
    parts = [f"{n} as materialized ({TABLES[n]})" for n in TABLES if n in needed]
    return "with " + ",\n".join(parts) + "\n" + final


def _r(name: str, expr: str | None = None, digits: int = 6) -> str:
    return f"round({expr or name}, {digits}) + 0 as {name}"


def _revenue_by(dimension: str) -> str:
    return (
        f"select {dimension}, {_r('total_revenue', 'coalesce(sum(ingreso_min_excedente), 0)')}, "
        f"{_r('avg_revenue', 'avg(ingreso_min_excedente)')}, count(ingreso_min_excedente) as trip_count "
        f"from mart where {dimension} is not null group by 1"
    )


def _mart_columns() -> str:
    return ", ".join(_r(c) if c in MART_DOUBLES else c for c in MART)


def _order(first: str, direction: str) -> str:
    rest = [f"{c} nulls last" for c in MART if c != first]
    return ", ".join([f"{first} {direction} nulls last", *rest])


def _order_by(columns: list[str]) -> str:
    return ", ".join(f"{c} nulls last" for c in [*columns, *[m for m in MART if m not in columns]])


def _column_profile() -> str:
    def one(c: str) -> str:
        sample = f"array_to_string(list_slice(list_sort(list(distinct {c})), 1, 10), ',')"
        return (
            f"select '{c}' as name, '{MART_TYPES[c]}' as type, "
            f"case when count(distinct {c}) < 50 then cast(count(distinct {c}) as integer) end as unique_values, "
            f"case when count(distinct {c}) < 50 then {sample} else '' end as sample_values from mart"
        )

    return " union all ".join(one(c) for c in MART)


def _feature_matrix() -> str:
    days = ", ".join(
        f"cast(day_name = '{d}' as double) as day_{d.lower()}"
        for d in ["Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
    )
    return f"""select station_id, time_id, {_r('ingreso_min_excedente')},
        cast(station_id_encoded as double) as station_id_encoded, cast(hour as double) as hour,
        cast(is_weekend as double) as is_weekend, cast(month as double) as month, {_r('temperature_2m')},
        {_r('apparent_temperature')}, {_r('relative_humidity_2m')}, cast(bike_type_id as double) as bike_type_id,
        {_r('duracion_minutos')}, cast(minutos_incluidos as double) as minutos_incluidos,
        {_r('hour_sin', 'sin(2*pi()*hour/24)')}, {_r('hour_cos', 'cos(2*pi()*hour/24)')},
        cast(hour between 7 and 9 or hour between 17 and 19 as double) as is_rush_hour,
        cast(hour >= 22 or hour <= 5 as double) as is_night,
        cast(temperature_2m between 15 and 25 as double) as temp_comfort,
        cast(relative_humidity_2m > 70 as double) as humidity_high,
        {_r('temp_apparent_diff', 'apparent_temperature - temperature_2m')},
        cast(duracion_minutos > 45 as double) as duracion_larga,
        {_r('duracion_normalizada', 'duracion_minutos / minutos_incluidos')}, {days}
        from training join codes using (station_id)"""


def _split() -> str:
    return f"""select station_id, time_id, bike_type_id, {_r('duracion_minutos')}, {_r('ingreso_min_excedente')},
        place <= floor(ideal) + cast(extra as integer) as is_test
    from (select *, row_number() over (partition by ingreso_min_excedente > 0 order by h) as place from keyed)
    join (select *, row_number() over (order by ideal - floor(ideal) desc, rows desc) <= wanted - spare as extra
          from (select s, rows, wanted, wanted * rows / total as ideal,
                       sum(floor(wanted * rows / total)) over () as spare
                from (select ingreso_min_excedente > 0 as s, cast(count(*) as double) as rows,
                             sum(count(*)) over () as total, ceil(0.2::double * sum(count(*)) over ()) as wanted
                      from keyed group by 1))) q
      on (ingreso_min_excedente > 0) = q.s"""


_JUDGED = (
    f"station_id, hour, is_weekend, month, viajes_count, {_r('ingreso_promedio', digits=8)}, {_r('score_iso', digits=12)}, "
    "anomalia_iso, anomalia_lof"
)
_EVENT = (
    f"station_id, time_id, {_r('balance_net')}, hour, day_name, is_weekend, month, {_r('temperature_2m')}, "
    f"{_r('apparent_temperature')}, {_r('relative_humidity_2m')}, {_r('duracion_promedio_estacion')}, "
    f"{_r('prop_bike_type_1')}, minutos_incluidos, {_r('viajes_perdidos_estimados')}"
)
_PROFILE = ", ".join(
    _r(c, digits=8) for c in ["ingreso_promedio", "ingreso_total", "duracion_promedio", "temperatura_promedio",
                    "variabilidad_ingresos", "ingreso_maximo"]
)
_KPIS = """count(*) as total_viajes, round(coalesce(sum(ingreso_min_excedente), 0), {d}) as ingresos_totales,
        round(avg(ingreso_min_excedente), {d}) as ingreso_promedio,
        count(distinct start_station_id) as estaciones_activas,
        round(100.0::double * count(*) filter (where ingreso_min_excedente > 0) / count(*), {d}) as viajes_con_ingresos"""


def _dimension_check() -> str:
    keys = {
        "dim_time": "time_id", "weather": "time_id", "dim_member_type": "member_type_id",
        "dim_tarifa": "member_type_id, bike_type_id",
    }
    return " union all ".join(
        f"""select '{t}' as table_name, count(*) as distinct_keys, count(*) filter (where n > 1) as duplicate_keys,
            cast(coalesce(sum(n - 1), 0) as bigint) as extra_rows
            from (select count(*) as n from {t} group by {k})"""
        for t, k in keys.items()
    )


def statements() -> dict[str, str]:
    finals = {
        "dimension_check": _dimension_check(),
        "sql_over_star": f"""select t.day_name, t.is_weekend, count(*) as trips,
            {_r('avg_temperature', 'avg(temperature_2m)')},
            cast(sum(case when duracion_minutos > 60 then 1 else 0 end) as bigint) as long_trips
            from trips join dim_time t on start_time_id = t.time_id join weather w on start_time_id = w.time_id
            group by 1, 2""",
        "trip_mart": f"select {_mart_columns()} from mart",
        "excess_revenue": f"""select start_station_id, start_time_id, member_type_id, bike_type_id, {_r('duracion_minutos')},
            minutos_incluidos, {_r('tarifa_minuto_excedente')},
            {_r('ingreso_min_excedente', 'case when duracion_minutos > minutos_incluidos then (duracion_minutos - minutos_incluidos) * tarifa_minuto_excedente else 0 end')}
            from trips join dim_tarifa using (member_type_id, bike_type_id)""",
        "training_set": f"""select station_id, time_id, hour, day_name, is_weekend, month, {_r('temperature_2m')},
            {_r('apparent_temperature')}, {_r('relative_humidity_2m')}, bike_type_id, {_r('duracion_minutos')},
            minutos_incluidos, {_r('tarifa_minuto_excedente')}, {_r('ingreso_min_excedente')} from training""",
        "station_hour_profile": f"""select station_id, hour, is_weekend, month, viajes_count, {_PROFILE},
            viajes_con_excedente from profile""",
        "station_stats": f"""select station_id, {_r('duracion_promedio_estacion')}, viajes_totales,
            {_r('prop_bike_type_1')} from stats""",
        "shortage_events": f"select {_EVENT} from events",
        "kpis": f"select {_KPIS.format(d=6)} from mart",
        "kpis_by_month": f"""select month, {_KPIS.format(d=6)} from mart
            where hour between 7 and 9 or hour between 16 and 18 group by month""",
        "dataset_stats": """select count(*) as total_records, min(month) as first_month, max(month) as last_month,
            count(distinct start_station_id) as unique_stations from mart""",
        "revenue_by_hour": _revenue_by("hour"),
        "revenue_by_member": _revenue_by("member_casual"),
        "revenue_by_month": _revenue_by("month"),
        "revenue_by_day": _revenue_by("day_name"),
        "station_balance": "select * from balance",
        "station_balance_top": "select * from balance order by abs_balance desc, station_id limit 20",
        "station_balance_extremes": """
            select 'deficit' as side, station_id, departures, arrivals, balance
            from (from balance order by balance, station_id limit 10)
            union all select 'surplus', station_id, departures, arrivals, balance
            from (from balance order by balance desc, station_id limit 10)""",
        "weather_impact": f"""select temp_bin, {_r('avg_revenue')}, {_r('total_revenue')}, trip_count,
            {_r('avg_temperature')}, {_r('avg_duration')} from impact""",
        "weather_chart": f"""select {_r('temperature', 'avg_temperature', 1)}, {_r('avg_revenue', digits=2)},
            {_r('total_revenue', digits=2)}, trip_count, {_r('avg_duration', digits=1)} from impact""",
        "user_distribution": """select upper(member_casual[1]) || lower(member_casual[2:]) as name, count(*) as value
            from mart where member_casual is not null group by 1""",
        "explore_filtered": f"select {_mart_columns()} from found",
        "explore_page": f"""select concat_ws('_', start_station_id, place + 50) as id, start_station_id, end_station_id,
            hour, day_name, is_weekend, month, round(temperature_2m, 1) as temperature,
            round(relative_humidity_2m, 1) as humidity, bike_type_id as bike_type,
            round(duracion_minutos, 1) as duration, member_casual as member_type,
            round(ingreso_min_excedente, 2) as revenue, minutos_incluidos as included_minutes,
            round(tarifa_minuto_excedente, 2) as excess_rate
            from (select *, row_number() over (order by {_order('ingreso_min_excedente', 'desc')}) - 51 as place from found)
            where place between 0 and 24""",
        "explore_page_after": f"""select {_mart_columns()}
            from (select *, row_number() over (order by {_order_by(['start_station_id', 'end_station_id', 'hour'])}) as place from found)
            where place between 51 and 75""",
        "explore_page_of_values": f"""select {_mart_columns()}
            from (select *, row_number() over (order by {_order_by(['start_station_id', 'end_station_id', 'hour'])}) as place from found)
            where place between 51 and 75""",
        "explore_walk": f"select {_mart_columns()} from found",
        "explore_walk_pages": f"""select 1 + place // 5000 as page, count(*) as n, min(place) as first_position, min(start_station_id) as first_station,
            max(start_station_id) as last_station, round(sum(ingreso_min_excedente), 4) as total_revenue
            from (select *, row_number() over (order by {_order_by(['start_station_id', 'end_station_id', 'hour'])}) - 1 as place from found)
            group by 1""",
        "mart_refresh": "select month, count(*) as n, false as written_again from mart group by month",
        "explore_month": f"select {_mart_columns()} from found where month = 7",
        "explore_summary": """select count(*) as total_records, cast(ceil(count(*) / 25) as bigint) as total_pages,
            round(coalesce(sum(ingreso_min_excedente), 0), 2) as total_revenue, round(avg(ingreso_min_excedente), 2) as avg_revenue,
            round(avg(duracion_minutos), 1) as avg_duration, count(distinct start_station_id) as unique_stations
            from found""",
        "explore_member_distribution": """select member_casual, count(*) as trips from found
            where member_casual is not null group by 1""",
        "column_profile": _column_profile(),
        "seeded_sample": f"""select station_id, time_id, hour, day_name, is_weekend, month, {_r('temperature_2m')},
            {_r('apparent_temperature')}, {_r('relative_humidity_2m')}, bike_type_id, {_r('duracion_minutos')},
            minutos_incluidos, {_r('tarifa_minuto_excedente')}, {_r('ingreso_min_excedente')}
            from (from keyed order by h limit 20000)""",
        "train_test_split": _split(),
        "station_codes": "select * from codes",
        "feature_matrix": _feature_matrix(),
        "theoretical_revenue": f"""select start_station_id, {_r('duracion_minutos')}, {_r('ingreso_min_excedente')},
            {_r('theoretical_revenue', 'greatest(0, duracion_minutos - 30) * cast(0.39 as double)')},
            {_r('model_difference', 'ingreso_min_excedente - greatest(0, duracion_minutos - 30) * cast(0.39 as double)')}
            from mart""",
        "regression_metrics": f"""select member_casual, {_r('rmse', 'sqrt(avg(e*e))')}, {_r('mae', 'avg(abs(e))')},
            {_r('r2', '1 - sum(e*e) / (var_pop(y) * count(y))')}
            from (select member_casual, ingreso_min_excedente as y, ingreso_min_excedente
                  - greatest(0, duracion_minutos - 30) * cast(0.39 as double) as e from mart) group by 1""",
        "prediction_histogram": f"""select bin, {_r('bin_start', 'lo + bin * (hi - lo) / 50.0::double')},
            count(*) as frequency, {_r('mean_value', 'any_value(mean)')}
            from (select lo, hi, mean, least(49, cast(floor((v - lo) / ((hi - lo) / 50.0::double)) as integer)) as bin
                  from values_of, (select min(v) as lo, max(v) as hi, avg(v) as mean from values_of))
            group by bin, lo, hi""",
        "anomaly_features": "select station_id, "
        + ", ".join(_r(c, digits=8) for c in ["ingreso_total", "ingreso_maximo", *FEATURES]) + " from clean",
        "anomaly_scaled": "select station_id, hour, is_weekend, month, "
        + ", ".join(_r(f"z_{f}", f"z{i}") for i, f in enumerate(FEATURES)) + " from scaled",
        "iforest_scores": f"select row_key, {_r('score_iso', digits=12)}, anomalia_iso from flagged",
        "lof_scores": f"select row_key, {_r('lof', digits=9)}, anomalia_lof from flagged",
        "anomaly_consensus": f"select {_JUDGED} from consensus",
        "anomaly_stats": f"""select *, {_r('anomaly_rate', '100.0::double * num_anomalies / total_records')}
            from anomaly_counts""",
        "anomaly_top": f"""select {_JUDGED.replace("station_id", "c.station_id", 1)} from
            (from consensus order by consensus.ingreso_promedio desc, station_id, hour, is_weekend, month limit 20) c""",
        "anomalies_by_hour": """select h.hour, count(c.hour) as anomalies
            from (select cast(unnest(range(24)) as integer) as hour) h left join consensus c on h.hour = c.hour group by 1""",
        "anomaly_scatter": f"""select row_key, {_r('x', 'ingreso_promedio')}, viajes_count as y, type from (
            (select *, 'normal' as type from flagged where anomalia_iso = 1 and anomalia_lof = 1
             order by md5(row_key || '|42') limit 500)
            union all (select *, 'anomaly' from consensus))""",
        "score_station_hours": f"""select station_id, hour, is_weekend, month,
            {_r('anomaly_score', 'score - iso_cut', 12)}, score < iso_cut as is_anomaly
            from new_scaled join new_score using (row_key),
                 (select quantile_cont(score, 0.1) as iso_cut from fit_score)""",
        "kpis_with_anomalies": f"""select {_KPIS.format(d=4)},
            (select num_anomalies from anomaly_counts) as anomalias_detectadas,
            (select round(100.0::double * num_anomalies / total_records, 4) from anomaly_counts) as porcentaje_anomalias,
            (select round(total_loss, 4) from loss) as perdidas_estimadas from mart""",
        "scenario_grid": f"select * replace (round(prediction, 6) as prediction) from grid",
        "scenario_top": """select * replace (round(prediction, 6) as prediction) from (
            select *, cast(row_number() over (partition by station_id order by prediction desc, hour, temperature, duration)
                as integer) as place from grid) where place <= 10""",
        "scenario_stats": f"""select station_id, month, bike_type, {_r('max_prediction', 'max(prediction)')},
            {_r('avg_prediction', 'avg(prediction)')}, count(*) filter (where prediction > 0) as profitable_scenarios,
            count(*) as total_scenarios from grid group by 1, 2, 3""",
        "revenue_model_metrics": f"""select model, true as fits, true as consistent, true as choice_agrees, held_out_rows, label_mean
            from (values ('RandomForest'), ('GradientBoosting')) t(model),
                 (select count(*) as held_out_rows, {_r('label_mean', 'avg(ingreso_min_excedente)')} from ({_split()}) where is_test)""",
        "feature_importance": f"""select {FEATURE_COUNT}::bigint as features, true as sums_to_one, true as in_range,
            true as duration_leads where (select count(*) from training) > 0""",
        "score_requests": f"""select station_id, hour, is_weekend, month, {_r('temperature', 'temperature_2m')}, {_r('humidity', 'relative_humidity_2m')},
            bike_type_id as bike_type, {_r('duration', 'duracion_minutos')}, day_name,
            {_r('theoretical_revenue', 'greatest(0, duracion_minutos - 30) * cast(0.39 as double)')},
            true as floored, true as gap_agrees from training""",
        "model_roundtrip": """select 'revenue' as kind, station_id, hour, true as same from training
            union all select 'anomaly', station_id, cast(hour as integer), true from profile""",
        "prediction_model_histogram": "select count(*) as rows, true as spans_all_bins, true as mean_agrees from training",
        "scenario_model_top": """select station_id, 7 as month, 1 as bike_type, cast(place as integer) as place, true as descends, true as floored
            from (select distinct start_station_id as station_id from mart), (select unnest(range(1, 11)) as place)""",
        "scenario_model_stats": """select distinct start_station_id as station_id, 7 as month, 1 as bike_type,
            1176::bigint as total_scenarios, true as consistent, true as some_profit from mart""",
        "counterfactual_model_loss": """select lost_trips, affected_stations, events_analyzed, sample_size, scaling_factor,
            cast(lost_trips as bigint) as simulated_trips, true as adds_up from loss""",
        "loss_by_station_model": f"""select station_id, {_r('viajes_perdidos')}, {_r('share', 'viajes_perdidos / total')} from (
            select station_id, sum(viajes_perdidos_estimados) as viajes_perdidos,
                (select sum(viajes_perdidos_estimados) from events) as total
            from events group by 1 order by 2 desc, 1 limit 10)""",
        "kpis_with_model_loss": f"""select {_KPIS.format(d=4)},
            (select num_anomalies from anomaly_counts) as anomalias_detectadas,
            (select round(100.0::double * num_anomalies / total_records, 4) from anomaly_counts) as porcentaje_anomalias,
            true as perdidas_estimadas from mart""",
        "shortage_top": f"""select {_EVENT} from
            (from events e order by e.viajes_perdidos_estimados desc, e.station_id, e.time_id, e.balance_net limit 10)""",
        "counterfactual_trips": f"""select station_id, time_id, {_r('balance_net')}, trip_no, hour, is_weekend, month,
            day_name, {_r('temperature')}, {_r('humidity')}, bike_type, {_r('duration', digits=9)},
            {_r('prediction', digits=9)} from lost_scored""",
        "counterfactual_loss": f"""select {_r('total_loss', digits=4)}, lost_trips, {_r('loss_per_trip', digits=4)},
            affected_stations, events_analyzed, sample_size, scaling_factor from loss""",
        "loss_by_station": f"""select station_id, {_r('viajes_perdidos', digits=4)}, {_r('ingresos_perdidos', digits=4)} from (
            select station_id, sum(viajes_perdidos_estimados) as viajes_perdidos,
                sum(viajes_perdidos_estimados) * ((select total_loss from loss)
                    / (select sum(viajes_perdidos_estimados) from events)) as ingresos_perdidos
            from events group by 1 order by 3 desc, 1 limit 10)""",
    }
    return {name: _with(final) for name, final in finals.items()}
