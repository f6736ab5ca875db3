"""Registered queries and their SQL equivalents. Doubles are rounded to 6 digits and times given in microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import exprs
from .operators import audit, clusters, flow, frames, graph, inequality, kernels, resampling, service, spatial
from .plans.components import shared_path
from .sources import feeds, lake, synthetic

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "double":
            out[f.name] = F.round(f.name, 6) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            out[f.name] = F.unix_micros(F.col(f.name).cast("timestamp"))
        elif kind in ("int", "smallint", "tinyint"):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out) if out else df


def _add(name: str, build: Callable, views: str, sql: str | None = None) -> None:
    """build gets one DataFrame per view named."""
    _QUERIES[name] = lambda spark, sf_dir: _plain(build(*(view(spark, sf_dir, v) for v in views.split())))
    if sql:
        _SQL[name] = with_views(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


K = "system_id, station_id"
W = f"(partition by {K} order by fetched_at)"
NF = f", f as (select *, num_bikes_available - lag(num_bikes_available) over {W} as nf from v_panel)"
US = "epoch_us({})".format
R = "round(cast({} as double), 6) as {}".format
HAV = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _hav(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = f"(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))"
    return HAV.format(a=a)


def _sql(extra: str, body: str) -> str:
    return with_views("\0").replace(" \0", extra + " " + body)


def _addx(name: str, build: Callable, views: str, extra: str, body: str) -> None:
    _add(name, build, views)
    _SQL[name] = _sql(extra, body)


# --- flows -----------------------------------------------------------------------------------------------------------

_addx("net_flow", lambda p: flow.net_flow(p).select("system_id", "station_id", "fetched_at", "net_flow"), "v_panel", NF, f"select {K}, {US('fetched_at')} as fetched_at, nf as net_flow from f")
_addx("turnover", lambda p: flow.turnover(p), "v_panel", NF, f"select {K}, {US(chr(39).join(['date_trunc(', 'day', ', fetched_at)']))} as period, cast(sum(abs(nf)) as bigint) as turnover from f where nf is not null group by 1, 2, 3")
_addx("turnover_by_capacity", lambda p: flow.turnover(p, normalize="capacity"), "v_panel", NF, f"select {K}, {US(chr(39).join(['date_trunc(', 'day', ', fetched_at)']))} as period, {R('sum(abs(nf)) / case when max(capacity) > 0 then max(capacity) end', 'turnover')} from f where nf is not null group by 1, 2, 3")
_addx("flow_balance", flow.flow_balance, "v_panel", NF, f"select {K}, i as inflow, o as outflow, i - o as net, round_even(o / case when i > 0 then i end, 3) as balance from (select {K}, cast(coalesce(sum(nf) filter (nf > 0), 0) as bigint) as i, cast(coalesce(-sum(nf) filter (nf < 0), 0) as bigint) as o from f group by 1, 2)")
_addx("flow_asymmetry", lambda p: flow.flow_asymmetry(p, eps=1.0), "v_panel", NF, f"select {K}, {R('coalesce(sum(nf) filter (nf > 0), 0) / (coalesce(-sum(nf) filter (nf < 0), 0) + 1.0)', 'flow_asymmetry')} from f group by 1, 2")
_addx("cumulative_imbalance", lambda p: flow.cumulative_imbalance(p).select("system_id", "station_id", "fetched_at", "cumulative_imbalance"), "v_panel", NF, f"select {K}, {US('fetched_at')} as fetched_at, cast(sum(coalesce(nf, 0)) over (partition by {K}, date_trunc('day', fetched_at) order by fetched_at) as bigint) as cumulative_imbalance from f")
_addx("aliasing_vulnerability", flow.aliasing_vulnerability, "v_panel", NF + f", s as (select *, lag(sign(nf)) over {W} as p from f where nf <> 0)", f"select n.system_id, n.station_id, n.n_intervals, r.reversal_share from (select {K}, count(*) as n_intervals from f where nf is not null group by 1, 2) n left join (select {K}, {R('avg(case when sign(nf) <> p then 1 else 0 end)', 'reversal_share')} from s where p is not null group by 1, 2) r using (system_id, station_id)")
_addx("fleet_turnover", flow.fleet_turnover, "v_panel", NF, f"select m.system_id, {US('m.period')} as period, {R('m.moved / case when g.fleet > 0 then g.fleet end', 'fleet_turnover')} from (select system_id, date_trunc('day', fetched_at) as period, coalesce(sum(abs(nf)), 0) / 2.0 as moved from f group by 1, 2) m join (select system_id, date_trunc('day', fetched_at) as period, max(b) as fleet from (select system_id, fetched_at, sum(num_bikes_available) as b from v_panel group by 1, 2) group by 1, 2) g using (system_id, period)")
_addx("docking_pressure", lambda p: flow.docking_pressure(p).select("system_id", "station_id", "fetched_at", "docking_pressure"), "v_panel", NF, f"select {K}, {US('fetched_at')} as fetched_at, {R('coalesce(avg(nf) filter (nf > 0) over (partition by system_id, station_id), 0) / case when num_docks_available > 0 then num_docks_available end', 'docking_pressure')} from f")
_EP = f", e as (select {K}, fetched_at, 'empty' as kind, coalesce(num_bikes_available <= 0, false) as flag from v_panel union all select {K}, fetched_at, 'full', coalesce(num_docks_available <= 0, false) from v_panel), r as (select *, row_number() over (partition by {K}, kind order by fetched_at) - row_number() over (partition by {K}, kind, flag order by fetched_at) as run from e), ep as (select {K}, kind, min(fetched_at) as a, max(fetched_at) as b, count(*) as n_obs from r where flag group by {K}, kind, run)"
_addx("stockout_episodes", flow.stockout_episodes, "v_panel", _EP, f"select {K}, kind, {US('a')} as \"start\", {US('b')} as \"end\", n_obs, round_even((epoch_us(b) - epoch_us(a)) / 60e6, 1) as duration_minutes from ep")
_addx("outage_survival", lambda p: flow.outage_survival(flow.stockout_episodes(p).withColumn("duration_minutes", F.floor((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 3.6e9)), by=("kind",)), "v_panel", _EP + ", d as (select kind, cast(floor((epoch_us(b) - epoch_us(a)) / 3.6e9) as bigint) as duration_minutes from ep), c as (select kind, duration_minutes, count(*) as h from d group by 1, 2), t as (select kind, count(*) as n, quantile_cont(duration_minutes, 0.5) as median, quantile_cont(duration_minutes, 0.9) as p90 from d group by 1)", f"select c.kind, c.duration_minutes, cast(sum(h) over (partition by c.kind order by duration_minutes desc) as bigint) as at_risk, n, {R('median', 'median')}, {R('p90', 'p90')}, {R('(sum(h) over (partition by c.kind order by duration_minutes desc) - h) / n', 'survival')} from c join t using (kind)")
_addx("frozen_stations", flow.frozen_stations, "v_panel", f", q as (select {K}, fetched_at, num_bikes_available as v, lag(num_bikes_available) over {W} as p from v_panel where hour(fetched_at) between 6 and 22), s as (select *, sum(case when v = p then 0 else 1 end) over {W} as run from q), u as (select {K}, run, (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 3.6e9 as h, any_value(v) as v from s group by {K}, run)", f"select {K}, {R('max(h)', 'num_bikes_available_run_hours')}, first(v order by h desc, run) as num_bikes_available_run_value, max(h) >= 6 as frozen from u group by 1, 2")
_addx("resample", lambda p: flow.resample(p, "6h"), "v_panel", f", g as (select {K}, unnest(generate_series(lo, hi, 21600000000)) as t from (select {K}, epoch_us(min(fetched_at)) // 21600000000 * 21600000000 as lo, epoch_us(max(fetched_at)) // 21600000000 * 21600000000 as hi from v_panel group by 1, 2)), o as (select {K}, epoch_us(fetched_at) as u, num_bikes_available, num_docks_available from v_panel)", "select g.system_id, g.station_id, g.t as fetched_at, o.num_bikes_available, o.num_docks_available from g asof left join o on g.system_id = o.system_id and g.station_id = o.station_id and g.t >= o.u")
_addx("explicit_gaps", lambda p: flow.explicit_gaps(p.select("system_id", "station_id", "fetched_at", "num_bikes_available"), tolerance="12h"), "v_panel", f", g as (select *, lag(fetched_at) over {W} as p from v_panel)", f"select {K}, {US('fetched_at')} as fetched_at, num_bikes_available from v_panel union all select {K}, (epoch_us(fetched_at) + epoch_us(p)) // 2, null from g where epoch_us(fetched_at) - epoch_us(p) > 43200000000")
_addx("snapshot_asof", lambda p: flow.snapshot_asof(p, "2024-01-15 12:00:00", tolerance="1D").select("system_id", "station_id", "fetched_at", "num_bikes_available"), "v_panel", "", f"select {K}, {US('fetched_at')} as fetched_at, num_bikes_available from v_panel where fetched_at between timestamp '2024-01-14 12:00:00' and timestamp '2024-01-15 12:00:00' qualify row_number() over (partition by {K} order by fetched_at desc) = 1")
_addx("dedup_last", lambda p: flow.dedup_last(p.withColumn("last_reported", F.date_trunc("day", "fetched_at"))).select("system_id", "station_id", "fetched_at"), "v_panel", "", f"select {K}, {US('fetched_at')} as fetched_at from v_panel qualify row_number() over (partition by {K}, date_trunc('day', fetched_at) order by fetched_at desc) = 1")
_addx("coverage_stations", lambda p: flow.coverage_stations(p, expected_freq="1h"), "v_panel", f", g as (select {K}, epoch_us(fetched_at) as t, epoch_us(fetched_at) - lag(epoch_us(fetched_at)) over {W} as gap from (select distinct {K}, fetched_at from v_panel))", f"select {K}, actual, {R('longest', 'longest_gap_min')}, expected, round_even(least(1.0, actual / expected) * 100, 1) as uptime_pct from (select {K}, count(*) as actual, max(gap) / 60e6 as longest from g group by 1, 2) join (select system_id, cast(floor((max(t) - min(t)) / 3600000000) + 1 as bigint) as expected from g group by 1) using (system_id)")
_addx("coverage_systems", lambda p: flow.coverage_systems(p, expected_freq="1h"), "v_panel", ", t as (select distinct system_id, epoch_us(fetched_at) as t from v_panel), d as (select system_id, t, (t - lag(t) over (partition by system_id order by t)) / 60e6 as d from t), m as (select system_id, median(d) as med, count(*) as n, cast(floor((max(t) - min(t)) / 3600000000) + 1 as bigint) as expected from d group by 1)", f"select m.system_id, {R('med', 'cadence_min')}, n as n_snapshots, expected, {R('j', 'jitter_min')}, n_stations, round_even(least(1.0, n_pairs / (expected * n_stations)) * 100, 1) as yield_pct from m join (select d.system_id, median(abs(d - med)) as j from d join m using (system_id) group by 1) x on m.system_id = x.system_id join (select system_id, count(distinct station_id) as n_stations, count(distinct (station_id, fetched_at)) as n_pairs from v_panel group by 1) s on s.system_id = m.system_id")

# --- service ---------------------------------------------------------------------------------------------------------

_add("censored_time_ratio", service.censored_time_ratio, "v_panel", f"select {R('avg(case when num_bikes_available <= 0 then 1 else 0 end)', 'empty')}, {R('avg(case when num_docks_available <= 0 then 1 else 0 end)', 'full')}, {R('avg(case when num_bikes_available <= 0 or num_docks_available <= 0 then 1 else 0 end)', 'censored')} from v_panel")
_add("service_reliability", service.service_reliability, "v_panel", f"select {K}, cast(hour(fetched_at) * 60 as bigint) as tod_minutes, {R('avg(cast(num_bikes_available >= 1 as int))', 'p_bikes')}, {R('avg(cast(num_docks_available >= 1 as int))', 'p_docks')}, {R('avg(cast(num_bikes_available >= 1 and num_docks_available >= 1 as int))', 'p_both')}, count(*) as n from v_panel group by 1, 2, 3")
_add("outage_rates", service.outage_rates, "v_panel", f"select {K}, {R('avg(cast(num_bikes_available = 0 as int))', 'empty_rate')}, {R('avg(cast(num_docks_available = 0 as int))', 'full_rate')}, count(*) as n_obs from v_panel group by 1, 2")
_add("boundary_stress", service.boundary_stress, "v_panel", f"select {K}, {R('avg(cast(num_bikes_available <= 2 as int))', 'near_empty')}, {R('case when not bool_or(is_virtual_station) and coalesce(max(cast(capacity <= 0 as int)), 0) = 0 then avg(cast(num_docks_available <= 2 as int)) end', 'near_full')}, count(*) as n_obs from v_panel group by 1, 2")
_OCC = "case when num_bikes_available + num_docks_available > 0 then num_bikes_available / cast(num_bikes_available + num_docks_available as double) end"
_addx("availability_stats", service.availability_stats, "v_panel", f", h as (select {K}, hour(fetched_at) as h, avg({_OCC}) as o from v_panel group by 1, 2, 3), c as (select {K}, max(o) - min(o) as amp, first(h order by round(o, 9) desc, h) as peak_hour from h where o is not null group by 1, 2)", f"select b.*, {R('amp', 'diurnal_amplitude')}, cast(peak_hour as bigint) as peak_hour from (select {K}, count(*) as n, {R('avg(num_bikes_available)', 'mean_bikes')}, {R('median(num_bikes_available)', 'median_bikes')}, {R(f'avg({_OCC})', 'mean_occupancy')}, {R('avg(cast(num_bikes_available <= 0 as int))', 'empty')}, {R('avg(cast(num_docks_available <= 0 as int))', 'full')}, {R('stddev_samp(num_bikes_available)', 'std_bikes')} from v_panel group by 1, 2) b left join c using (system_id, station_id)")
_add("diurnal_summary", service.diurnal_summary, "v_panel", f"select cast(hour(fetched_at) as bigint) as hour, {R('avg(num_bikes_available)', 'mean')}, {R('quantile_cont(num_bikes_available, 0.05)', 'p05')}, {R('median(num_bikes_available)', 'median')}, {R('quantile_cont(num_bikes_available, 0.95)', 'p95')}, count(*) as n from v_panel group by 1")
_FILL = "case when capacity > 0 then num_bikes_available / cast(capacity as double) when num_bikes_available + num_docks_available > 0 then num_bikes_available / cast(num_bikes_available + num_docks_available as double) else num_bikes_available end"
_HOURS = [f"h{h:02d}" for h in range(24)]
_PROFILE = f", fl as (select {K}, hour(fetched_at) as h, least(greatest({_FILL}, 0.0), 1.0) as fill from v_panel where {_FILL} is not null), pw as (select {K}, {', '.join(f'avg(fill) filter (h = {i}) as {c}' for i, c in enumerate(_HOURS))} from fl group by 1, 2 having count(*) >= 12), pf as (select {K}, {', '.join(f'coalesce({c}, list_avg([{chr(44).join(_HOURS)}])) as {c}' for c in _HOURS)} from pw)"
_mean_of = lambda a, b: "(" + " + ".join(_HOURS[a:b]) + f") / {b - a}"
_addx("diurnal_profiles", service.diurnal_profiles, "v_panel", _PROFILE, f"select {K}, {', '.join(R(c, c) for c in _HOURS)} from pf")
_addx("diurnal_profiles_by_weekday", lambda p: service.diurnal_profiles(p, split_weekday=True, min_obs=24), "v_panel", f", fl as (select {K}, isodow(fetched_at) >= 6 as we, hour(fetched_at) as h, least(greatest({_FILL}, 0.0), 1.0) as fill from v_panel where {_FILL} is not null), pw as (select {K}, {', '.join(f'avg(fill) filter (h = {i} and {s} we) as {c}' for p, s in (('wd_', 'not'), ('we_', '')) for i, c in enumerate(p + x for x in _HOURS))} from fl group by 1, 2 having count(*) >= 24)", f"select {K}, " + ", ".join(R(f"coalesce({p + c}, list_avg([{', '.join(q + x for q in ('wd_', 'we_') for x in _HOURS)}]))", p + c) for p in ("wd_", "we_") for c in _HOURS) + " from pw")
_addx("diurnal_typology", lambda p: service.diurnal_typology(service.diurnal_profiles(p)).select("system_id", "station_id", "typology"), "v_panel", _PROFILE + f", mt as (select {K}, {_mean_of(0, 5)} as night, {_mean_of(7, 11)} as morning, {_mean_of(11, 16)} as midday, {_mean_of(17, 21)} as evening, {_mean_of(0, 24)} as dayly from pf)", f"select {K}, case when dayly < 0.1 then 'mostly_empty' when dayly > 0.9 then 'mostly_full' when morning - night <= -0.15 then 'morning_origin' when morning - night >= 0.15 then 'morning_destination' when evening - midday <= -0.15 then 'evening_origin' when midday - (night + evening) / 2 >= 0.15 then 'recreational' else 'stable' end as typology from mt")
_BIN = f", b as (select {K}, cast(floor(epoch(fetched_at) / 3600) as bigint) as b, avg(num_bikes_available) as x from v_panel group by 1, 2, 3), z as (select {K}, count(*) as bins from b group by 1, 2)"
_CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_addx("autocorrelation", lambda p: service.autocorrelation(p, lags=(1, 24)), "v_panel", _BIN, " union all ".join(f"select z.system_id, z.station_id, cast({lag} as bigint) as lag, {R(f'case when bins > {lag} + 1 then c end', 'acf')}, coalesce(n, 0) as n_pairs from z left join (select a.system_id, a.station_id, count(*) as n, {_CORR.format('a.x', 'c.x')} as c from b a join b c on a.system_id = c.system_id and a.station_id = c.station_id and c.b = a.b + {lag} group by 1, 2) q using (system_id, station_id)" for lag in (1, 24)))
_addx("synchrony", lambda p: service.synchrony(p, min_overlap=3), "v_panel", ", b as (select station_id, cast(floor(epoch(fetched_at) / 3600) as bigint) as b, avg(num_bikes_available) as x from v_panel group by 1, 2)", f"select a.station_id as station_a, c.station_id as station_b, {R(_CORR.format('a.x', 'c.x'), 'corr')}, count(*) as n_overlap from b a join b c on a.b = c.b and a.station_id < c.station_id group by 1, 2 having count(*) >= 3 and stddev_pop(a.x) * stddev_pop(c.x) > 0")
_addx("synchrony_by_rank", lambda p: service.synchrony(p, min_overlap=3, method="spearman", threshold=0.5), "v_panel", ", b as (select station_id, cast(floor(epoch(fetched_at) / 3600) as bigint) as b, avg(num_bikes_available) as x from v_panel group by 1, 2), q as (select a.station_id as station_a, c.station_id as station_b, a.x as x, c.x as y from b a join b c on a.b = c.b and a.station_id < c.station_id), rk as (select station_a, station_b, rank() over (partition by station_a, station_b order by x) + (count(*) over (partition by station_a, station_b, x) - 1) / 2.0 as x, rank() over (partition by station_a, station_b order by y) + (count(*) over (partition by station_a, station_b, y) - 1) / 2.0 as y from q)", f"select station_a, station_b, {R(_CORR.format('x', 'y'), 'corr')}, count(*) as n_overlap from rk group by 1, 2 having count(*) >= 3 and stddev_pop(x) * stddev_pop(y) > 0 and round(abs({_CORR.format('x', 'y')}), 9) >= 0.5")
_addx("temporal_concentration", service.temporal_concentration, "v_panel", NF + f", t as (select {K}, cast(hour(fetched_at) * 60 as bigint) as tod, sum(abs(nf)) as v from f where nf is not null group by 1, 2, 3), r as (select *, row_number() over (partition by {K} order by v, tod) as i from t)", f"select {K}, {R('case when sum(v) > 0 then greatest(2.0 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 0) end', 'temporal_gini')}, {R('max(v) / case when sum(v) > 0 then sum(v) end', 'peak_share')}, case when sum(v) > 0 then first(tod order by v desc, tod) else -1 end as peak_bin from r group by 1, 2")
_addx("bimodality", service.bimodality, "v_panel", ", h as (select station_id, hour(fetched_at) as h, avg(num_bikes_available) as x from v_panel group by 1, 2), g as (select station_id, count(*) as n, first(h order by round(x, 9) desc, h) as peak_hour, case when count(*) >= 4 and var_pop(x) > 0 then (pow(skewness(x), 2) + 1) / (kurtosis(x) + 3.0 * pow(count(*) - 1, 2) / ((count(*) - 2) * (count(*) - 3))) end as bc from h group by 1)", f"select station_id, n, {R('bc', 'bimodality')}, cast(peak_hour as bigint) as peak_hour, bc > 5.0 / 9 as bimodal from g")
_add("context_features", lambda p: service.context_features(p).select("system_id", "station_id", "fetched_at", "is_weekend", "time_block"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, isodow(fetched_at) >= 6 as is_weekend, case when hour(fetched_at) < 7 then 'night' when hour(fetched_at) < 10 then 'am_peak' when hour(fetched_at) < 16 then 'midday' when hour(fetched_at) < 19 then 'pm_peak' else 'evening' end as time_block from v_panel")
_add("reconcile_fleet", service.reconcile_fleet, "v_panel v_vehicles", "select * from (select cast(sum(num_bikes_available) as bigint) as station_bikes, count(*) as n_stations from v_panel), (select count(*) as free_floating, count(*) filter (is_disabled) as disabled, count(*) filter (is_reserved and not is_disabled) as reserved, count(*) filter (not is_reserved and not is_disabled) as available from v_vehicles where station_id is null)")
_d0 = _hav("la", "lo", "lat", "lon")
_addx("ghost_vehicles", lambda v: service.ghost_vehicles(v, idle_days=1, move_threshold_m=130), "v_vehicles", ", f as (select *, first_value(lat) over (partition by system_id, vehicle_id order by fetched_at) as la, first_value(lon) over (partition by system_id, vehicle_id order by fetched_at) as lo from v_vehicles)", f"select *, max_displacement_m <= 130 and observed_days >= 1 as is_ghost from (select system_id, vehicle_id, round_even(max({_d0}), 1) as max_displacement_m, round_even((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 86400e6, 2) as observed_days, count(*) as n_obs from f group by 1, 2)")
_d1 = _hav("la", "lo", "lat", "lon")
_addx("idle_share", lambda v: service.idle_share(v, threshold_hours=12), "v_vehicles", f", l as (select *, lag(lat) over w as la, lag(lon) over w as lo from v_vehicles window w as (partition by system_id, vehicle_id order by fetched_at)), m as (select *, case when coalesce({_d1} > 50, true) then fetched_at end as mv from l), s as (select *, max(mv) over (partition by system_id, vehicle_id order by fetched_at) as since from m)", f"select system_id, {US('fetched_at')} as fetched_at, count(*) as n_vehicles, count(*) filter (epoch_us(fetched_at) - epoch_us(since) >= 43200000000) as n_idle, {R('avg(cast(epoch_us(fetched_at) - epoch_us(since) >= 43200000000 as int))', 'idle_share')} from s group by 1, 2")
_addx("id_persistence", lambda v: service.id_persistence(v.withColumn("fetched_at", F.date_trunc("hour", "fetched_at")), lags=("12h", "24h")), "v_vehicles", ", ids as (select distinct system_id, vehicle_id, epoch_us(date_trunc('hour', fetched_at)) as t from v_vehicles where vehicle_id is not null), tm as (select system_id, t, count(*) as n from ids group by 1, 2)", " union all ".join(f"select system_id, {R('avg(i / (na + nb - i))', 'jaccard')}, count(*) as n_pairs, '{h}h' as lag from (select m.system_id, m.a, na, nb, (select count(*) from ids x join ids y on x.system_id = y.system_id and x.vehicle_id = y.vehicle_id where x.system_id = m.system_id and x.t = m.a and y.t = m.b) as i from (select a.system_id, a.t as a, a.n as na, b.t as b, b.n as nb from tm a join tm b on a.system_id = b.system_id and a.t <> b.t and abs(b.t - a.t - {h * 3600000000}) <= {h * 1800000000} qualify row_number() over (partition by a.system_id, a.t order by abs(b.t - a.t - {h * 3600000000}), b.t desc) = 1) m) group by 1" for h in (12, 24)))

# --- frames ----------------------------------------------------------------------------------------------------------

_add("join_availability", lambda i, p: frames.join_availability(i, flow.snapshot_asof(p, "2024-01-15 12:00:00", tolerance="1D").select("system_id", "station_id", "num_bikes_available")).select("system_id", "station_id", "presence", "num_bikes_available"), "v_info v_panel", f"select {K}, case when s.num_bikes_available is not null then 'both' else 'info_only' end as presence, s.num_bikes_available from v_info i full join (select {K}, num_bikes_available from v_panel where fetched_at between timestamp '2024-01-14 12:00:00' and timestamp '2024-01-15 12:00:00' qualify row_number() over (partition by {K} order by fetched_at desc) = 1) s using (system_id, station_id)")
_add("join_vehicle_types", lambda v, t: frames.join_vehicle_types(v, t).groupBy("form_factor", "propulsion_type").agg(F.count("*").alias("n")), "v_vehicles v_vehicle_types", "select form_factor, propulsion_type, count(*) as n from v_vehicles left join v_vehicle_types using (vehicle_type_id) group by 1, 2")
_add("join_pricing", lambda v, t: frames.join_pricing(v, t).groupBy("plan_id", "plan_name", "plan_price").agg(F.count("*").alias("n")), "v_vehicles v_plans", "select plan_id, p.name as plan_name, price as plan_price, count(*) as n from v_vehicles v left join v_plans p on v.pricing_plan_id = p.plan_id group by 1, 2, 3")
_add("ebikes", lambda v, t: frames.ebikes(v, t).groupBy("system_id").agg(F.count("*").alias("n")), "v_vehicles v_vehicle_types", "select system_id, count(*) as n from v_vehicles join v_vehicle_types using (vehicle_type_id) where propulsion_type like '%electric%' group by 1")
_add("filter_bbox", lambda i: frames.filter_bbox(i, (2.3, 48.85, 2.4, 48.95)).select("station_id", "lat", "lon"), "v_info", f"select station_id, {R('lat', 'lat')}, {R('lon', 'lon')} from v_info where lat between 48.85 and 48.95 and lon between 2.3 and 2.4")
_addx("join_exogenous", lambda p, w: frames.join_exogenous(p, w, tolerance="1h").select("system_id", "station_id", "fetched_at", "observed_at", "n_events"), "v_panel v_weather", f", c as (select p.system_id, p.station_id, p.fetched_at, w.observed_at, w.n_events, row_number() over (partition by p.system_id, p.station_id, p.fetched_at order by abs(epoch_us(w.observed_at) - epoch_us(p.fetched_at)), w.observed_at) as rn from v_panel p left join v_weather w on epoch_us(w.observed_at) between epoch_us(p.fetched_at) - 3600000000 and epoch_us(p.fetched_at) + 3600000000)", f"select {K}, {US('fetched_at')} as fetched_at, {US('observed_at')} as observed_at, n_events from c where rn = 1")
_addx("network_changes", frames.network_changes, "v_info v_info_new", f", j as (select coalesce(a.system_id, b.system_id) as system_id, coalesce(a.station_id, b.station_id) as station_id, a.station_id is not null as o, b.station_id is not null as n, cast(a.capacity as bigint) as old_capacity, cast(b.capacity as bigint) as new_capacity, round_even({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 1) as d from v_info a full join v_info_new b on a.system_id = b.system_id and a.station_id = b.station_id)", " union all ".join(f"select {K}, '{c}' as change, old_capacity, new_capacity, {'d' if c == 'moved' else 'cast(null as double)'} as distance_m from j where {w}" for c, w in (("added", "not o"), ("removed", "not n"), ("recapacitated", "o and n and old_capacity is distinct from new_capacity"), ("moved", "o and n and d > 50"))))
_add("capacity_utilization", lambda p: frames.capacity_utilization(p).select("system_id", "station_id", "fetched_at", "utilization"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, {R('num_bikes_available / cast(case when capacity > 0 then capacity end as double)', 'utilization')} from v_panel")
_STATE = "case when not is_renting and not is_returning then 'disabled' when is_virtual_station or not coalesce(capacity > 0, false) then 'virtual' when num_bikes_available <= 0 then 'empty' when num_docks_available <= 0 then 'full' else 'normal' end"
_add("system_profile", lambda p: frames.system_profile(p.withColumn("last_reported", F.date_trunc("day", "fetched_at"))), "v_panel", f"select system_id, count(*) as n_stations, cast(sum(num_bikes_available) as bigint) as total_bikes, cast(coalesce(sum(capacity), 0) as bigint) as total_capacity, round_even(avg({_OCC}), 4) as mean_occupancy, " + ", ".join(f"round_even(count(*) filter ({_STATE} = '{s}') / count(*) * 100, 2) as pct_{s}" for s in ("disabled", "virtual", "empty", "full", "normal")) + ", round_even(median((epoch_us(fetched_at) - epoch_us(date_trunc('day', fetched_at))) / 60e6), 1) as median_staleness_min from v_panel group by 1")
_add("station_state", lambda p: p.select("system_id", "station_id", "fetched_at", exprs.station_state(F.col("num_bikes_available"), F.col("num_docks_available"), F.col("is_renting"), F.col("is_returning"), F.col("is_virtual_station"), F.col("capacity")).alias("state"), exprs.occupancy(F.col("num_bikes_available"), F.col("num_docks_available")).alias("occupancy")), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, {_STATE} as state, {R(_OCC, 'occupancy')} from v_panel")

# --- audit -----------------------------------------------------------------------------------------------------------

_DOCK = "station_type = 'docked_bike' and not is_virtual_station"
_RAD = "(pi() / 180)"
_A_SYS = f", arcs as (select system_id, 360 - greatest(coalesce(max(gap), 0), 360 - (max(m) - min(m))) as arc from (select system_id, m, lead(m) over (partition by system_id order by m) - m as gap from (select system_id, lon - 360 * floor(lon / 360) as m from v_info_bad where lat is not null and lon is not null)) group by 1), sy as (select system_id, coalesce(min(capacity) filter ({_DOCK}) = max(capacity) filter ({_DOCK}) and min(capacity) filter ({_DOCK}) > 0 and count(capacity) filter ({_DOCK}) >= 20, false) as \"A2\", coalesce(count(lat) >= 2 and (max(lat) - min(lat)) * {_RAD} * 6371000.0 * any_value(arc) * {_RAD} * 6371000.0 * cos(radians(avg(lat))) / 1e6 > 50000, false) as \"A5\", coalesce(count(*) filter ({_DOCK}) >= 20 and count(*) filter ({_DOCK} and capacity = 0) / count(*) filter ({_DOCK}) >= 0.01, false) as \"A6\", coalesce(count(*) filter ({_DOCK}) >= 20 and count(*) filter ({_DOCK} and capacity is null) / count(*) filter ({_DOCK}) >= 0.5, false) as \"A7\" from v_info_bad left join arcs using (system_id) group by 1)"
_addx("audit_systems", audit.audit_systems, "v_info_bad", _A_SYS, "select * from sy")
_d4 = _hav("a.lat", "a.lon", "b.lat", "b.lon")
_A_OUT = f", nn as (select a.system_id, a.station_id, min({_d4}) as d from v_info_bad a join v_info_bad b on a.system_id = b.system_id and a.station_id <> b.station_id group by 1, 2), md as (select system_id, median(d) as med, count(*) as n from nn group by 1), mq as (select nn.system_id, median(abs(d - med)) * 1.4826 as mad from nn join md using (system_id) group by 1)"
_A_FAR = "select nn.system_id, nn.station_id from nn join md using (system_id) join mq using (system_id) where n >= 5 and d > greatest(case when mad > 0 then med + {sigma} * mad else 10 * med end, 1000)"
_addx("audit_spatial_outliers", lambda i: audit.spatial_outliers(i), "v_info_bad", _A_OUT, _A_FAR.format(sigma=3))
_A_ALL = _A_SYS + _A_OUT + f", far as ({_A_FAR.format(sigma=3)}), vd as (select i.*, station_type = 'carsharing' as \"A1\", sy.A2 and {_DOCK} as \"A2\", station_type = 'free_floating' as \"A3\", far.station_id is not null as \"A4\", sy.A5, sy.A6 and {_DOCK} as \"A6\", sy.A7 and {_DOCK} as \"A7\" from v_info_bad i join sy using (system_id) left join far on far.system_id = i.system_id and far.station_id = i.station_id), vr as (select *, A1 or A2 or A3 or A4 or A5 or A6 or A7 as flagged, concat_ws(', ', {', '.join(f"case when {f} then '{n}' end" for f, n in zip(audit.FLAGS, audit.NAMES))}) as reason from vd)"
_addx("audit_static", lambda i: audit.audit_static(i).select("system_id", "station_id", *audit.FLAGS, "flagged", "reason"), "v_info_bad", _A_ALL, f"select {K}, A1, A2, A3, A4, A5, A6, A7, flagged, reason from vr")
_addx("drop_flagged", lambda i: audit.drop_flagged(i).select("system_id", "station_id", "lat", "lon", "capacity", "station_type"), "v_info_bad", _A_ALL, f"select {K}, {R('lat', 'lat')}, {R('lon', 'lon')}, cast(capacity as bigint) as capacity, station_type from vr where not flagged")
_add("overcapacity_ratio", audit.overcapacity_ratio, "v_info_bad", f"select system_id, {R('case when count(*) >= 20 and sum(coalesce(capacity, 0)) > 0 then avg(capacity) filter (capacity > 0) / (sum(coalesce(capacity, 0)) / count(*)) end', 'overcapacity_ratio')} from v_info_bad group by 1")
_RATIO = "case when count(*) >= 20 and sum(coalesce(capacity, 0)) > 0 then avg(capacity) filter (capacity > 0) / (sum(coalesce(capacity, 0)) / count(*)) end"
_add("capacity_convention", audit.capacity_convention, "v_info_bad", f"select system_id, case when avg(cast(capacity is null as int)) >= 0.5 then 'null' when count(capacity) >= 20 and min(capacity) > 0 and min(capacity) = max(capacity) then 'placeholder' when {_RATIO} > 5 then 'conditional_profile' when median(capacity) filter (capacity > 0) <= 2 then 'per_vehicle' else 'physical' end as convention from v_info_bad group by 1")
_add("classify_virtual", lambda i: audit.classify_virtual(i).select("system_id", "station_id", "station_type"), "v_info", f"select {K}, case when is_virtual_station then 'free_floating' else station_type end as station_type from v_info")
_addx("reclassify_overcapacity", lambda i: audit.reclassify_overcapacity(i, a3_ratio=1.05).select("system_id", "station_id", "station_type"), "v_info_bad", f", ra as (select system_id, {_RATIO} as ratio from v_info_bad group by 1)", f"select {K}, case when ratio > 1.05 then 'free_floating' else station_type end as station_type from v_info_bad join ra using (system_id)")
_GRID = {"a4_sigma": (2.0, 3.0, 4.0), "a6_tau": (0.005, 0.01, 0.05), "a7_tau": (0.3, 0.5, 0.7), "a5_area_km2": (1e4, 5e4, 1e7), "n_min": (10.0, 20.0, 500.0)}


def _sensitivity_sql() -> str:
    """Sets of flagged systems under each threshold, against those under the defaults."""
    dock = f"coalesce({_DOCK}, false)"
    stats = f", st as (select system_id, max(cast({dock} as int)) as any_dock, max(cast(station_type = 'carsharing' as int)) as c1, max(cast(station_type = 'free_floating' as int)) as c3, count(*) filter ({_DOCK}) as nd, count(capacity) filter ({_DOCK}) as nk, coalesce(min(capacity) filter ({_DOCK}) = max(capacity) filter ({_DOCK}) and min(capacity) filter ({_DOCK}) > 0, false) as same, count(*) filter ({_DOCK} and capacity = 0) / nullif(count(*) filter ({_DOCK}), 0) as r6, count(*) filter ({_DOCK} and capacity is null) / nullif(count(*) filter ({_DOCK}), 0) as r7, case when count(lat) >= 2 then (max(lat) - min(lat)) * {_RAD} * 6371000.0 * any_value(arc) * {_RAD} * 6371000.0 * cos(radians(avg(lat))) / 1e6 end as area from v_info_bad left join arcs using (system_id) group by 1)"
    base = {"a4_sigma": 3.0, "a6_tau": 0.01, "a7_tau": 0.5, "a5_area_km2": 5e4, "n_min": 20.0}
    cells = [(p, v, base | {p: v}) for p, vs in _GRID.items() for v in vs] + [("base", 0.0, base)]
    sets = []
    for p, v, o in cells:
        rules = {"A1": "c1 = 1", "A2": f"same and nk >= {o['n_min']}", "A3": "c3 = 1", "A5": f"area > {o['a5_area_km2']}", "A6": f"nd >= {o['n_min']} and r6 >= {o['a6_tau']}", "A7": f"nd >= {o['n_min']} and r7 >= {o['a7_tau']}"}
        sets += [f"select '{p}' as param, cast({v} as double) as value, '{c}' as class, system_id from st where {w}" for c, w in rules.items()]
        sets.append(f"select '{p}', cast({v} as double), 'A4', system_id from ({_A_FAR.format(sigma=o['a4_sigma'])})")
    grid = " union all ".join(f"select '{p}' as param, cast({v} as double) as value, '{c}' as class" for p, vs in _GRID.items() for v in vs for c in audit.FLAGS)
    return _sql(_A_SYS + _A_OUT + stats + f", fs as (select distinct * from ({' union all '.join(sets)})), gr as ({grid})", "select gr.param, gr.value, gr.class, (select count(*) from fs where fs.param = gr.param and fs.value = gr.value and fs.class = gr.class) as systems_flagged, coalesce(round_even((select count(*) from fs join fs b on b.param = 'base' and b.class = fs.class and b.system_id = fs.system_id where fs.param = gr.param and fs.value = gr.value and fs.class = gr.class) / nullif((select count(distinct system_id) from fs where fs.class = gr.class and (fs.param = 'base' or (fs.param = gr.param and fs.value = gr.value))), 0), 4), 1.0) as jaccard_vs_baseline from gr")


_add("audit_sensitivity", lambda i: audit.audit_sensitivity(i, _GRID), "v_info_bad")
_SQL["audit_sensitivity"] = _sensitivity_sql()
_addx("flag_rates", lambda i: audit.flag_rate_ci(audit.audit_static(i), n_boot=200).select("class", "systems_flagged", "rate"), "v_info_bad", _A_ALL, " union all ".join(f"select '{f}' as class, cast(count(*) filter (x) as bigint) as systems_flagged, round_even(avg(cast(x as int)), 4) as rate from (select system_id, bool_or({f}) as x from vr group by 1)" for f in audit.FLAGS))
_add("flag_rate_ci", lambda i: audit.flag_rate_ci(audit.audit_static(i)), "v_info_bad")
_add("sentinel_coordinates", lambda i: audit.sentinel_coordinates(i).select("station_id", "sentinel"), "v_info", "select station_id, abs(lat) < 1e-6 and abs(lon) < 1e-6 as sentinel from v_info")
_add("audit_dynamic", lambda p: audit.audit_dynamic(p.withColumn("last_reported", F.date_trunc("day", "fetched_at"))).select("system_id", "station_id", "fetched_at", "D1", "D2", "D3"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, num_bikes_available < 0 or num_docks_available < 0 as \"D1\", coalesce(num_bikes_available + num_docks_available > capacity and capacity > 0, false) as \"D2\", epoch_us(fetched_at) - epoch_us(date_trunc('day', fetched_at)) > 3600000000 as \"D3\" from v_panel")

# --- inequality and agreement ----------------------------------------------------------------------------------------

_addx("gini", lambda i: inequality.gini(i, "capacity", by=("system_id",)), "v_info", ", r as (select system_id, capacity as x, row_number() over (partition by system_id order by capacity) as i from v_info where capacity is not null)", f"select system_id, {R('2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*)', 'gini')} from r group by 1")
_addx("dynamic_gini", lambda p: inequality.dynamic_gini(p), "v_snap", ", r as (select fetched_at, num_bikes_available as x, row_number() over (partition by fetched_at order by num_bikes_available) as i from v_snap)", f"select {US('fetched_at')} as fetched_at, {R('case when sum(x) <> 0 then greatest(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 0) end', 'gini')} from r group by 1")
_addx("theil", lambda i: inequality.theil(i, "capacity", groups="system_id"), "v_info", ", g as (select system_id, count(*) as n, sum(capacity) as s, sum(capacity * ln(capacity)) as xl from v_info where capacity > 0 group by 1), t as (select sum(n) as nn, sum(s) as ss, sum(xl) as xx from g)", f"select {R('any_value(xx / ss - ln(ss / nn))', 'theil')}, {R('sum(s / ss * ln((s / ss) / (n / nn)))', 'between')}, {R('sum(s / ss * (xl / s - ln(s / n)))', 'within')} from g, t")
_RK = ", r as (select system_id, capacity as x, row_number() over (partition by system_id order by capacity, station_id) as i, count(*) over (partition by system_id) as n from v_info where capacity is not null)"
_addx("palma", lambda i: inequality.palma(i, "capacity", by=("system_id",)), "v_info", _RK, f"select system_id, {R('sum(x) filter (i > ceil(n * 0.9)) / case when sum(x) filter (i <= floor(n * 0.4)) > 0 then sum(x) filter (i <= floor(n * 0.4)) end', 'palma')} from r group by 1")
_addx("lorenz", lambda i: inequality.lorenz(i, "capacity", by=("system_id",)), "v_info", _RK, f"select system_id, {R('i / n', 'population')}, {R('sum(x) over (partition by system_id order by i) / sum(x) over (partition by system_id)', 'share')} from r union all select distinct system_id, 0.0, 0.0 from r")
_addx("concentration", inequality.concentration, "v_info", ", r as (select system_id, capacity as x, row_number() over (partition by system_id order by capacity) as i, count(*) over (partition by system_id) as n from v_info where capacity > 0)", f"select system_id, count(*) as n_positive, cast(sum(x) as bigint) as total, round_even(sum(x) filter (i > n - ceil(n / 10.0)) / sum(x), 4) as top_decile_share, round_even(greatest(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 0), 4) as gini, round_even(sum(x * ln(x)) / sum(x) - ln(sum(x) / count(*)), 4) as theil from r group by 1")
_QUERIES["cohen_kappa"] = lambda s, d: _plain(inequality.cohen_kappa(s.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"))
_SQL["cohen_kappa"] = f"with l as (select quality as a, toxic as b from labels where quality is not null and toxic is not null), t as (select count(*) as n, count(*) filter (a = b) as same from l), e as (select sum(x.c * y.c) as pe from (select a, count(*) as c from l group by 1) x join (select b, count(*) as c from l group by 1) y on x.a = y.b) select {R('(same / n - pe / (n * n)) / (1 - pe / (n * n))', 'kappa')} from t, e"
_QUERIES["krippendorff_alpha"] = lambda s, d: _plain(inequality.krippendorff_alpha(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("unit"), F.explode(F.array("quality", "toxic")).alias("label"))))
_SQL["krippendorff_alpha"] = f"with r as (select doc_id as u, unnest([quality, toxic]) as v from labels), c as (select u, v, count(*) as c from r where v is not null group by 1, 2), m as (select u, sum(c) as m from c group by 1 having sum(c) > 1), x as (select c.*, m from c join m using (u)), d as (select sum(c * (c - 1) / (m - 1)) as d from x), g as (select sum(nc) as n, sum(nc * nc) as q from (select v, sum(c) as nc from x group by 1)) select {R('1 - (n - 1) * (n - d) / (n * n - q)', 'alpha')} from d, g"

# --- spatial ---------------------------------------------------------------------------------------------------------

_P = _hav("a.lat", "a.lon", "b.lat", "b.lon")
_add("nearest_stations", lambda i: spatial.nearest_stations(i, 48.9, 2.4, k=10).select("station_id", "distance_m"), "v_info", f"select station_id, {R(_hav('48.9', '2.4', 'lat', 'lon'), 'distance_m')} from v_info order by distance_m, station_id limit 10")
_addx("features_within", lambda i, p: spatial.features_within(i.select("station_id", "lat", "lon"), p, point_id="station_id", feature_id="poi_id", radius_m=900, category="category").drop("lat", "lon"), "v_info v_poi", f", q as (select a.station_id, b.poi_id, b.category, {_P} as d from v_info a, v_poi b)", f"select station_id, count(*) filter (d <= 900) as n_total, {', '.join(f'count(*) filter (d <= 900 and category = {chr(39)}{c}{chr(39)}) as n_{c}' for c in ('cafe', 'school', 'station'))}, first(poi_id order by d, poi_id) as nearest_poi_id, {R('min(d)', 'nearest_m')} from q group by 1")
_addx("link_transit", lambda i, p: spatial.link_transit(i.select("station_id", "lat", "lon"), p, stop_id="poi_id", radius_m=400).drop("lat", "lon"), "v_info v_poi", f", q as (select a.station_id, b.poi_id, {_P} as d from v_info a, v_poi b)", f"select station_id, count(*) filter (d <= 400) as n_total, first(poi_id order by d, poi_id) as nearest_poi_id, {R('min(d)', 'nearest_m')}, min(d) <= 400 as is_feeder from q group by 1")
_addx("stations_near", lambda i, p: spatial.stations_near(p, i, point_id="poi_id", radius_m=900).select("poi_id", "n_stations_within", "nearest_station_id", "nearest_station_dist_m"), "v_info v_poi", f", q as (select b.poi_id, a.station_id, {_P} as d from v_info a, v_poi b)", f"select poi_id, count(*) filter (d <= 900) as n_stations_within, first(station_id order by d, station_id) as nearest_station_id, {R('min(d)', 'nearest_station_dist_m')} from q group by 1")
_addx("station_surroundings", lambda i, p: spatial.station_surroundings(i.select("station_id", "lat", "lon"), transit=p.where("category = 'station'"), features=p, feature_id="poi_id", radius_m=900, transit_radius_m=400, category="category").drop("lat", "lon"), "v_info v_poi", f", q as (select a.station_id, b.category, {_P} as d from v_info a, v_poi b)", f"select station_id, {R('min(d) filter (category = ' + chr(39) + 'station' + chr(39) + ')', 'nearest_stop_dist_m')}, count(*) filter (d <= 400 and category = 'station') as n_transit_within, coalesce(min(d) filter (category = 'station') <= 400, false) as is_transit_feeder, count(*) filter (d <= 900) as osm_within, {', '.join(f'count(*) filter (d <= 900 and category = {chr(39)}{c}{chr(39)}) as osm_{c}' for c in ('cafe', 'school', 'station'))} from q group by 1")
_addx("two_step_fca", lambda i, d: spatial.two_step_fca(i, d).select("demand_id", "accessibility"), "v_info v_demand", f", q as (select b.demand_id, a.station_id, coalesce(a.capacity, 0) as s, b.population as d, exp(-pow({_P} / (800 / 3.0), 2) / 2) as w from v_info a, v_demand b where {_P} <= 800), l as (select station_id, sum(d * w) as load from q group by 1)", f"select d.demand_id, {R('coalesce(x, 0)', 'accessibility')} from v_demand d left join (select demand_id, sum(s / load * w) as x from q join l using (station_id) where load > 0 group by 1) using (demand_id)")
_addx("ripley_k", lambda i: spatial.ripley_k(i, [250, 500, 1000], area_km2=480.0), "v_info", f", q as (select {_P} as d from v_info a, v_info b where a.station_id < b.station_id), nn as (select cast(count(*) as double) as n from v_info)", " union all ".join(f"select cast({r} as double) as radius_m, c as pairs, {R('480e6 * 2 * c / (n * (n - 1))', 'k')}, {R(f'sqrt(480e6 * 2 * c / (n * (n - 1)) / pi()) - {r}', 'l')} from nn, (select count(*) filter (d <= {r}) as c from q)" for r in (250, 500, 1000)))
_addx("neighbour_stats", lambda i: spatial.neighbour_stats(i, area_km2=480.0), "v_info", f", nn as (select a.station_id, min({_P}) as d from v_info a join v_info b on a.station_id <> b.station_id group by 1), m as (select count(*) as n, round_even(avg(d), 1) as mean_nn_m, round_even(median(d), 1) as median_nn_m from nn)", f"select n, mean_nn_m, median_nn_m, {R('n / 480.0', 'density_km2')}, round_even(mean_nn_m * 2 * sqrt(n / 480e6), 3) as clark_evans from m")
_addx("spatial_entropy", lambda v: spatial.spatial_entropy(v.withColumn("fetched_at", F.date_trunc("day", "fetched_at"))), "v_vehicles", f", c as (select date_trunc('day', fetched_at) as t, floor(lat * {_RAD} * 6371000.0 / 200) as y, floor(lon * {_RAD} * 6371000.0 * cos(radians((select avg(lat) from v_vehicles))) / 200) as x, count(*) as c from v_vehicles group by 1, 2, 3), s as (select t, cast(sum(c) as bigint) as n, count(*) as cells, ln(sum(c)) - sum(c * ln(c)) / sum(c) as h from c group by 1)", f"select {US('t')} as fetched_at, n, cells, {R('h', 'entropy')}, {R('case when cells > 1 then h / ln(cells) else 0 end', 'evenness')} from s")
_add("center_of_mass", lambda p: spatial.center_of_mass(p, freq="1D"), "v_panel", f"select {US(chr(39).join(['date_trunc(', 'day', ', fetched_at)']))} as period, {R('sum(num_bikes_available * lat) / case when sum(num_bikes_available) > 0 then sum(num_bikes_available) end', 'lat')}, {R('sum(num_bikes_available * lon) / case when sum(num_bikes_available) > 0 then sum(num_bikes_available) end', 'lon')}, {R('sum(num_bikes_available)', 'weight')} from v_panel group by 1")
_addx("outage_redundancy", lambda p: spatial.outage_redundancy(p, radius_m=2000), "v_snap", f", o as (select station_id, fetched_at, max(num_bikes_available) as v from v_snap group by 1, 2), g as (select station_id, min(lat) as lat, min(lon) as lon from v_snap group by 1), e as (select a.station_id, b.station_id as nbr from g a, g b where a.station_id <> b.station_id and {_P} <= 2000), x as (select o.station_id, o.fetched_at, count(n.v) as seen, coalesce(bool_or(n.v > 0), false) as any_bike from o join e using (station_id) join o n on n.station_id = e.nbr and n.fetched_at = o.fetched_at where o.v = 0 group by 1, 2), s as (select station_id, count(*) as sys from x where seen > 0 and not any_bike group by 1)", f"select b.station_id, b.local_outage, {R('coalesce(sys, 0) / n', 'systemic_outage')}, coalesce(k, 0) as n_neighbors from (select station_id, {R('avg(cast(v = 0 as int))', 'local_outage')}, count(v) as n from o group by 1) b left join s using (station_id) left join (select station_id, count(*) as k from e group by 1) c using (station_id)")
_addx("core_points", lambda i: spatial.core_points(i, eps_m=600), "v_info", "", f"select a.station_id, count(*) as n_within, count(*) >= 3 as is_core from v_info a, v_info b where {_P} <= 600 group by 1")

_NEAR = ", z as (select station_id, lat, lon, cast(capacity as double) as v{z} from v_info{where}), nb as (select * from (select a.station_id as i, b.station_id as j, {p} as d, row_number() over (partition by a.station_id order by {p}, b.station_id) as rk from z a, z b where a.station_id <> b.station_id) q where rk <= 4)"
_KNOWN = _NEAR.format(z=", capacity - avg(capacity) over () as z, var_samp(capacity) over () as m2", where=" where capacity is not null", p=_P)
_ALL = _NEAR.format(z="", where="", p=_P)
_SF = "({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))) * exp(-{z} * {z} / 2) / 2".replace("{t}", "(1 / (1 + 0.3275911 * {z} / sqrt(2)))")
_addx("morans_i", lambda i: spatial.morans_i(i, "capacity", k=4), "v_info", _KNOWN + """, e as (select i, j, 0.25 as w from nb), c as (select sum(e.w * a.z * b.z) as c, cast(sum(e.w) as double) as s0 from e join z a on e.i = a.station_id join z b on e.j = b.station_id),
 s1 as (select sum(pow(coalesce(e.w, 0) + coalesce(f.w, 0), 2)) / 2 as s1 from e full join (select j as i, i as j, w from e) f on e.i = f.i and e.j = f.j), s2 as (select sum(pow(1 + coalesce(w, 0), 2)) as s2 from z left join (select j, sum(w) as w from e group by 1) g on z.station_id = g.j),
 q as (select count(*) as n, sum(z * z) as zz from z), m as (select n, n / s0 * c / zz as i, -1.0 / (n - 1) as ex, (n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1.0)) as v from q, c, s1, s2), sc as (select *, abs((i - ex) / sqrt(v - ex * ex)) as az from m)""", f"select n, {R('i', 'i')}, {R('ex', 'expected')}, {R('(i - ex) / sqrt(v - ex * ex)', 'z')}, {R('2 * ' + _SF.format(z='az'), 'p')} from sc")
_addx("local_moran", lambda i: spatial.local_moran(i, "capacity", k=4), "v_info", _KNOWN + ", l as (select nb.i, avg(b.z) as lag from nb join z b on nb.j = b.station_id group by 1)", f"select station_id, {R('z / m2 * lag', 'local_i')}, concat(case when z > 0 then 'H' else 'L' end, case when round(lag, 9) > 0 then 'H' else 'L' end) as quadrant from z join l on z.station_id = l.i")
_add("local_moran_inference", lambda i: kernels.local_moran_inference(i, "capacity", k=4, fdr=True), "v_info")
_W = ", s as (select median(d) as s from nb), o as (select i as a, j as b, exp(-pow(d, 2) / (2 * pow(s, 2))) as w from nb, s), g as (select a, b, max(w) as w from (select * from o union all select b, a, w from o) u group by 1, 2)"
_addx("knn_adjacency", lambda i: graph.knn_adjacency(i, k=4), "v_info", _ALL + _W, f"select a as a_id, b as b_id, {R('w', 'weight')} from g")
_addx("normalized_laplacian", lambda i: graph.normalized_laplacian(graph.knn_adjacency(i, k=4)), "v_info", _ALL + _W + ", dg as (select a as id, sum(w) as d from g group by 1)", f"select a as a_id, b as b_id, {R('-w / sqrt(x.d * y.d)', 'value')} from g join dg x on a = x.id join dg y on b = y.id union all select id, id, 1.0 from dg")
_addx("fdr_adjust", lambda i: inequality.fdr_adjust(i.select("station_id", (F.pmod(F.col("station_id").cast("long") * 7919, F.lit(1009)) / 1009.0).alias("p")), "p"), "v_info", ", f as (select station_id, cast((cast(station_id as bigint) * 7919) % 1009 as double) / 1009 as p from v_info), r as (select *, p * count(*) over () / row_number() over (order by p) as q from f)", f"select station_id, {R('p', 'p')}, {R('least(1.0, min(q) over (order by p desc range between unbounded preceding and current row))', 'p_adjusted')} from r")

_add("capacity_fill", lambda p: service.capacity_fill(p).select("system_id", "station_id", "fetched_at", "fill"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, {R(f'case when {_FILL} is not null then least(greatest({_FILL}, 0.0), 1.0) end', 'fill')} from v_panel")
_add("cyclical_time", lambda p: p.select("system_id", "station_id", "fetched_at", *(c.alias(n) for n, c in exprs.cyclical(F.col("fetched_at"), ("minute", "hour", "dow", "day", "month", "doy")).items())), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, " + ", ".join(R(f"{g}(2 * pi() * {raw} / {n})", f"{f}_{g}") for f, raw, n in (("minute", "minute(fetched_at)", 60), ("hour", "hour(fetched_at)", 24), ("dow", "(isodow(fetched_at) - 1)", 7), ("day", "day(fetched_at)", 31), ("month", "month(fetched_at)", 12), ("doy", "dayofyear(fetched_at)", 366)) for g in ("sin", "cos")) + " from v_panel")
_add("wilson_interval", lambda p: p.groupBy("system_id", "station_id").agg(F.count_if(F.col("num_bikes_available") == 0).alias("s"), F.count("*").alias("n")).select("system_id", "station_id", *(c.alias(n) for n, c in zip(("lo", "hi"), exprs.wilson_interval(F.col("s"), F.col("n"))))), "v_panel", f"select {K}, " + ", ".join(R(f"{g}((p + 1.9207294103470684 / n {x} 1.959963984540054 * sqrt(p * (1 - p) / n + 0.9603647051735342 / (n * n))) / (1 + 3.8414588206941368 / n), {e})", c) for g, x, e, c in (("greatest", "-", 0, "lo"), ("least", "+", 1, "hi"))) + f" from (select {K}, count(*) as n, count(*) filter (num_bikes_available = 0) / count(*) as p from v_panel group by 1, 2)")
_add("decay_weights", lambda p: p.select("station_id", "fetched_at", *(exprs.decay_weight(F.col("num_bikes_available").cast("double"), 12.0, d).alias(str(d)) for d in ("linear", "gaussian", "exponential", "none"))), "v_panel", f"select station_id, {US('fetched_at')} as fetched_at, " + ", ".join(R(f"case when num_bikes_available <= 12 then {x} else 0 end", f'\"{d}\"' if d == 'none' else d) for d, x in (("linear", "1 - num_bikes_available / 12.0"), ("gaussian", "exp(-pow(num_bikes_available / 4.0, 2) / 2)"), ("exponential", "exp(-3 * num_bikes_available / 12.0)"), ("none", "1.0"))) + " from v_panel")
_add("project_metres", lambda i: spatial.projected(i).select("station_id", "x_m", "y_m"), "v_info", f"select station_id, {R(f'lon * {_RAD} * 6371000.0 * cos(radians((select avg(lat) from v_info)))', 'x_m')}, {R(f'lat * {_RAD} * 6371000.0', 'y_m')} from v_info")
_add("land_use_roles", lambda i: synthetic.with_roles(i.where("capacity is not null")).select("station_id", "role"), "v_info", "select station_id, cast(case when capacity >= (select quantile_cont(capacity, 0.95) from v_info) then 2 when capacity >= (select quantile_cont(capacity, 0.75) from v_info) then 1 else 0 end as bigint) as role from v_info where capacity is not null")
_addx("footprint", synthetic.footprint, "v_panel", ", ft as (select station_id, cast(floor(epoch(fetched_at) / 3600) as bigint) as h, arg_max(cast(num_bikes_available as double), fetched_at) as x from v_panel group by 1, 2), fc as (select station_id, max(num_bikes_available + num_docks_available) as cap from v_panel group by 1), fs as (select *, lag(x) over (partition by station_id order by h) as px, lag(h) over (partition by station_id order by h) as ph from ft), fr as (select corr(px, x) as r from fs group by station_id having count(*) > 2 and stddev_pop(x) > 1e-6)", f"select {R('(select sum(abs(x - px)) from fs where h = ph + 1) / 2 / (select sum(cap) from fc) / ((max(h) - min(h)) / 24.0)', 'turnover')}, {R('(select median(r) from fr where r is not null and not isnan(r))', 'acf1')}, {R('(select count(*) from ft join fc using (station_id) where x <= 1e-9 or x >= cap - 1e-9) / ((max(h) - min(h) + 1) * (select count(*) from fc))', 'stockout')} from ft")
_add("wide_matrix", lambda p: flow.wide_matrix(p.withColumn("fetched_at", F.date_trunc("day", "fetched_at")), station="system_id"), "v_panel", f"select {US(chr(39).join(['date_trunc(', 'day', ', fetched_at)']))} as fetched_at, " + ", ".join(R(f"avg(num_bikes_available) filter (system_id = 'sys{i}')", f"sys{i}") for i in range(5)) + " from v_panel group by 1")
_addx("audit_frames", lambda i, p: audit.audit_frames(i, p.select("system_id", "station_id", "fetched_at", "num_bikes_available", "num_docks_available", F.date_trunc("day", "fetched_at").alias("last_reported")), stale_after_minutes=600), "v_info_bad v_panel", _A_ALL + f", dj as (select coalesce(i.system_id, p.system_id) as system_id, coalesce(i.station_id, p.station_id) as station_id, coalesce(num_bikes_available < 0, false) or coalesce(num_docks_available < 0, false) as d1, coalesce(coalesce(num_bikes_available, 0) + coalesce(num_docks_available, 0) > i.capacity and i.capacity > 0, false) as d2, coalesce(epoch_us(fetched_at) - epoch_us(date_trunc('day', fetched_at)) > 36000000000, false) as d3 from v_info_bad i full join v_panel p on i.system_id = p.system_id and i.station_id = p.station_id)", f"select 'static' as layer, {K}, flagged, reason from vr union all select 'dynamic', {K}, d1 or d2 or d3, concat_ws(', ', case when d1 then 'negative_count' end, case when d2 then 'over_capacity' end, case when d3 then 'stale' end) from dj")
_add("classify_from_vehicle_types", lambda i, t: audit.classify_from_vehicle_types(i, t.withColumn("system_id", F.concat(F.lit("sys"), F.substring("vehicle_type_id", -1, 1)))).select("system_id", "station_id", "station_type"), "v_info v_vehicle_types", "with_types")
_SQL["classify_from_vehicle_types"] = _sql(", ty as (select concat('sys', right(vehicle_type_id, 1)) as system_id, bool_or(form_factor = 'car') and not bool_or(form_factor in ('bicycle', 'cargo_bicycle')) as cars from v_vehicle_types group by 1)", f"select {K}, case when cars then 'carsharing' else station_type end as station_type from v_info left join ty using (system_id)")

# --- kernels ---------------------------------------------------------------------------------------------------------

_add("cluster_density", lambda i: clusters.cluster_density(i, eps_m=600), "v_info")
_add("cluster_profiles", lambda p: clusters.cluster_profiles(service.diurnal_profiles(p), k=4).select("system_id", "station_id", "cluster"), "v_panel")
_add("effective_sample_size", lambda p: resampling.effective_sample_size(p, "num_bikes_available"), "v_panel")
_add("block_bootstrap", lambda p: resampling.block_bootstrap(p, "num_bikes_available", n_boot=200), "v_panel")
_add("rebalancing_tension", lambda p: resampling.rebalancing_tension(p), "v_snap")
_add("coverage_stats", lambda i: spatial.coverage_stats(i), "v_info")
_add("cluster_hierarchy", lambda i: clusters.cluster_hierarchy(i, min_cluster_size=4), "v_info")
_add("cluster_profiles_by_warping", lambda p: clusters.cluster_profiles(service.diurnal_profiles(p), k=4, method="dtw").select("system_id", "station_id", "cluster"), "v_panel")
_add("degree_preserving_rewire", lambda i: kernels.degree_preserving_rewire(graph.knn_adjacency(i, k=4)), "v_info")
_add("low_freq_basis", lambda i: graph.low_freq_basis(graph.normalized_laplacian(graph.knn_adjacency(i, k=4)), 4), "v_info")
_add("synchrony_by_concordance", lambda p: service.synchrony(p, min_overlap=3, method="kendall"), "v_panel")
_QUERIES["simulated_city"] = lambda s, d: _plain(synthetic.city(s, n_stations=60, days=2)[1])
_QUERIES["simulated_flows"] = lambda s, d: _plain(synthetic.flows(s, synthetic.Flows(n_stations=40, days=2))[1])

# --- sources ---------------------------------------------------------------------------------------------------------


def _documents(df: DataFrame, own: list[str], record, kind: str = "stations", id_col: str = "station_id") -> DataFrame:
    """Feed documents that hold the rows, a few hundred at most each."""
    key = [F.col(c) for c in own]
    doc = df.groupBy(*key, F.pmod(F.xxhash64(id_col), F.lit(4096)).alias("__b")).agg(F.collect_list(record).alias(kind)).drop("__b")
    return doc.select(*own, F.to_json(F.struct(F.struct(kind).alias("data"))).alias("body"))


_add("feed_station_info", lambda i: feeds.station_info(_documents(i, ["system_id"], F.struct("station_id", "name", "lat", "lon", "capacity", "is_virtual_station", "region_id"))), "v_info", "select system_id, station_id, name, round(lat, 6) as lat, round(lon, 6) as lon, cast(capacity as bigint) as capacity, case when is_virtual_station or coalesce(capacity, 0) = 0 then 'free_floating' else 'docked_bike' end as station_type, is_virtual_station, region_id from v_info")
_STATUS = lambda: F.struct("station_id", F.col("num_bikes_available").alias("num_vehicles_available"), F.col("num_docks_available").alias("vehicle_docks_available"), "is_renting", "is_returning", F.unix_seconds(F.col("fetched_at").cast("timestamp")).alias("last_reported"))
_add("feed_station_status", lambda p: feeds.station_status(_documents(p, ["system_id", "fetched_at"], _STATUS())).drop("gbfs_version", "is_installed"), "v_panel", f"select {K}, num_bikes_available, num_docks_available, is_renting, is_returning, {US('fetched_at')} // 1000000 * 1000000 as last_reported, {US('fetched_at')} as fetched_at from v_panel")


_add("feed_vehicles", lambda v: feeds.vehicles(_documents(v, ["system_id", "fetched_at"], F.struct(F.col("vehicle_id").alias("bike_id"), "station_id", "vehicle_type_id", "lat", "lon", "is_reserved", "is_disabled", "pricing_plan_id"), "bikes", "vehicle_id")).drop("gbfs_version", "current_range_meters", "current_fuel_percent"), "v_vehicles", f"select system_id, vehicle_id, station_id, vehicle_type_id, {R('lat', 'lat')}, {R('lon', 'lon')}, is_reserved, is_disabled, pricing_plan_id, {US('fetched_at')} as fetched_at from v_vehicles")
_add("feed_vehicle_types", lambda t: feeds.vehicle_types(_documents(t.withColumn("system_id", F.lit("s")), ["system_id"], F.struct("vehicle_type_id", "form_factor", "propulsion_type", "max_range_meters"), "vehicle_types", "vehicle_type_id")), "v_vehicle_types", "select 's' as system_id, * from v_vehicle_types")
_add("feed_pricing_plans", lambda t: feeds.pricing_plans(_documents(t.withColumn("system_id", F.lit("s")), ["system_id"], F.struct("plan_id", F.array(F.struct(F.lit("en").alias("language"), F.col("name").alias("text"))).alias("name"), "currency", "price", (F.col("price") > 5).alias("is_taxable")), "plans", "plan_id")).drop("description"), "v_plans", "select 's' as system_id, plan_id, name, currency, price, price > 5 as is_taxable from v_plans")
_add("feed_regions", lambda i: feeds.system_regions(_documents(i, ["system_id"], F.struct("region_id", F.col("name").alias("name")), "regions")), "v_info", "select system_id, region_id, name from v_info")
_add("feed_alerts", lambda i: feeds.alerts(_documents(i, ["system_id"], F.struct(F.col("station_id").alias("alert_id"), F.lit("closure").alias("type"), F.array(F.struct(F.col("name").alias("text"))).alias("summary"), F.array(F.struct((F.lit(1_700_000_000) + F.col("station_id").cast("long")).alias("start"), F.lit("2024-01-01T00:00:00Z").alias("end"))).alias("times"), F.lit(1_700_000_000).alias("last_updated")), "alerts")).drop("description"), "v_info", "select system_id, station_id as alert_id, 'closure' as type, name as summary, (1700000000 + cast(station_id as bigint)) * 1000000 as \"start\", 1704067200000000 as \"end\", 1700000000000000 as last_updated from v_info")
_add("feed_vehicle_counts", lambda i: feeds.station_vehicle_counts(_documents(i, ["system_id"], F.struct("station_id", F.array(F.struct(F.lit("t0").alias("vehicle_type_id"), F.col("capacity").alias("count")), F.struct(F.lit("t1").alias("vehicle_type_id"), F.lit(1).alias("count"))).alias("vehicle_types_available")))).drop("fetched_at"), "v_info", f"select {K}, 't0' as vehicle_type_id, cast(capacity as bigint) as num_vehicles_available from v_info union all select {K}, 't1', 1 from v_info")
_add("feed_system_information", lambda i: feeds.system_information(i.select(F.to_json(F.struct(F.struct(F.col("station_id").alias("system_id"), F.col("name").alias("name"), F.lit("Lime").alias("operator"), F.lit("Europe/Paris").alias("timezone"), F.lit("fr").alias("language")).alias("data"))).alias("body"))), "v_info", "select station_id as system_id, name, 'Lime' as operator, 'Europe/Paris' as timezone, 'fr' as language from v_info")
_add("feed_discovery", lambda i: feeds.discovery(i.select(F.col("station_id").alias("system_id"), F.when(F.col("capacity").isNull(), F.to_json(F.struct(F.lit("3.0").alias("version"), F.struct(F.array(F.struct(F.col("name").alias("name"), F.lit("u://3").alias("url"))).alias("feeds")).alias("data")))).otherwise(F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("name").alias("name"), F.lit("u://2").alias("url"))).alias("feeds")).alias("fr")).alias("data")))).alias("body"))), "v_info", "select station_id as system_id, case when capacity is null then '3.0' else '2.x' end as version, name, case when capacity is null then 'u://3' else 'u://2' end as url from v_info")
_add("feed_geofencing", lambda i: feeds.geofencing(i.select("system_id", F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*(F.array(F.col("lon") + a, F.col("lat") + b) for a, b in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.0))))).alias("coordinates")).alias("geometry"), F.struct(F.col("name"), F.array(F.struct((F.col("capacity") > 20).alias("ride_allowed"), F.lit(20).alias("maximum_speed_kph"))).alias("rules")).alias("properties"))).alias("features")).alias("geofencing_zones")).alias("data"))).alias("body"))).select("system_id", "zone_id", "ride_allowed", "maximum_speed_kph", F.size("rings").alias("n_rings"), F.size("holes").alias("n_holes"), F.round(F.col("rings")[0][1].lon, 6).alias("lon")), "v_info", f"select system_id, name as zone_id, capacity > 20 as ride_allowed, cast(20 as double) as maximum_speed_kph, 1 as n_rings, 0 as n_holes, {R('lon + 0.01', 'lon')} from v_info")
_add("canonical_brands", lambda i: i.select("station_id", exprs.normalize_operator(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Lime ", "nextbike ", "Citi Bike ", "Velib ", "Local "))), (F.col("station_id").cast("int") % 5 + 1)), F.col("region_id"))).alias("operator")), "v_info", "select station_id, case cast(station_id as int) % 5 when 0 then 'Lime' when 1 then 'Nextbike' when 2 then 'Lyft / Motivate' when 3 then 'Vélib'' Métropole' else concat('Local ', region_id) end as operator from v_info")


def _through_lake(panel: DataFrame) -> DataFrame:
    folder = shared_path(panel.sparkSession)
    lake.append(panel.withColumn("last_reported", F.date_trunc("day", "fetched_at")), folder)
    return lake.panel(panel.sparkSession, folder, columns=["num_bikes_available"], tz="Europe/Paris")


_add("lake_panel", lambda p: _through_lake(p).select("system_id", "station_id", "fetched_at", "num_bikes_available", "local_time"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, num_bikes_available, {US('fetched_at')} + 3600000000 as local_time from (select *, row_number() over (partition by {K}, date_trunc('day', fetched_at) order by fetched_at desc) as rn from v_panel) q where rn = 1")
def _window_of_lake(panel: DataFrame) -> DataFrame:
    folder = shared_path(panel.sparkSession)
    lake.append(panel, folder)
    return lake.panel(panel.sparkSession, folder, start="2024-01-05 06:00:00", end="2024-01-20 18:00:00", columns=["num_bikes_available"], where="num_bikes_available > 3")


_add("lake_window", lambda p: _window_of_lake(p).select("system_id", "station_id", "fetched_at", "num_bikes_available"), "v_panel", f"select {K}, {US('fetched_at')} as fetched_at, num_bikes_available from v_panel where fetched_at between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00' and num_bikes_available > 3")
_add("geojson_features", lambda i: lake.geojson_features(i.select("station_id", "lat", "lon")).select(F.get_json_object("feature", "$.properties.station_id").alias("station_id"), *(F.get_json_object("feature", f"$.geometry.coordinates[{at}]").cast("double").alias(c) for at, c in enumerate(("lon", "lat")))), "v_info", "select station_id, round(lon, 6) as lon, round(lat, 6) as lat from v_info")
