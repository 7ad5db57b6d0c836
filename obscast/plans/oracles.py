"""DuckDB SQL that states the registered queries' results independently of Spark.

Common table expressions are named once and put together as each query needs them.
Doubles are shown to six decimals, instants as epoch seconds, dates as text.
"""

from __future__ import annotations

import re

from obscast.config import CATALOG, HPA_PER_INHG, HYPOTHESES, SKY_WEIGHTS
from obscast.operators.bootstrap import BOUNDS
from obscast.operators.challengers import FROM_TRAINING
from obscast.sources.fixtures import STATIONS

TZ = "Pacific/Auckland"
LOCAL = f"timezone('{TZ}', {{x}} at time zone 'UTC')"
AS_UTC = f"timezone('UTC', timezone('{TZ}', {{x}}))"
CPS, ANCHORS = (20, 21, 22, 23), (6, 9, 12, 15, 18)
START, END = "date '2001-07-03'", "date '2001-09-30'"
SPLITS = (("test_2000-01-01", "2000-01-01"), ("test_2001-01-01", "2001-01-01"))
N_CI, N_P = 1000, 9999
VALUES = [c for c in HYPOTHESES if c not in ("regime_label", "intraday_regime_change", "day_sequence_pattern", "regime_score_argmax")]


def _digits(x: str) -> str:
    return f"case when {x} < 0 then 'M' else '' end || lpad(cast(abs({x}) as varchar), 2, '0')"


def six(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0e0 as {name or x}"


_WEIGHT = "case skyc1 " + " ".join(f"when '{k}' then {v}e0" for k, v in SKY_WEIGHTS.items()) + " end"
_NORTH = "(drct >= 315 or drct <= 45)"
_ENDS = {c: f"list_filter([{', '.join(f'struct_pack(h := {a}, v := a{a}.{c})' for a in ANCHORS)}], lambda x: x.v is not null)" for c in "tda"}


def _trend(c: str, factor: str = "1e0") -> str:
    e = _ENDS[c]
    return f"(({e})[-1].v - ({e})[1].v) * {factor} / nullif((({e})[-1].h - ({e})[1].h)::double, 0)"


def _raw(station: str, more: str, source: str) -> str:
    """Reports with temperature t and dewpoint d of `source`, of one station."""
    return f"""select ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, t{more})), 1, 15))::bigint as obs_id, valid,
        case when l_partkey % 50 = 0 then null when l_partkey % 50 = 1 then '{station} AUTO NIL'
             else '{station} ' || strftime(valid, '%d%H%M') || 'Z AUTO 36005KT 9999 ' || {_digits("t")} || '/' || {_digits("d")} || ' Q1020' end as metar,
        case when l_suppkey % 40 = 0 then null else t * 9e0 / 5e0 + 32e0 + ((l_orderkey % 10) - 5) / 20e0 end as tmpf,
        round(l_discount * 100) * 36 as drct, round(l_tax * 100) * 3 as sknt, 29.50e0 + (l_partkey % 100) / 100e0 as alti,
        case when l_returnflag = 'R' and l_linenumber = 1 then 0.05e0 else 0e0 end as p01i,
        ['FEW', 'SCT', 'BKN', 'OVC', 'CLR', 'VV', null][l_linenumber] as skyc1, cast(l_suppkey * 100 as varchar) as skyl1,
        case when l_returnflag = 'R' and l_linenumber = 2 then '-RA' end as wxcodes
        from ({source})"""


_AT = "l_shipdate + to_minutes(cast((l_orderkey * 37 + l_linenumber * 211 + l_partkey * 13) % 1440 as bigint))"


def _station_raw(station: str) -> str:
    """Reports of one station with an effect: afternoons are warmer by twice a number, which depressions tell at the first."""
    own = station == STATIONS[0]
    warm = "(n * 7 + n // 5) % 10" if own else "(n * 3 + n // 7) % 10"
    days = f"select *, cast({LOCAL.format(x='valid')} as date) - date '1970-01-01' as n from (select *, {_AT} as valid from lineitem)"
    rows = f"""select *, t - 2 - (n * 7 + n // 5) % 10 as d from (select *, 10 + cast(l_quantity as bigint) % 5
        + case when hour({LOCAL.format(x='valid')}) >= 13 then 2 * ({warm}) else 0 end as t from ({days}){'' if own else ' where l_suppkey % 5 <> 0'})"""
    return _raw(station, f", '{station}'", rows)


CTES = {
    "raw": _raw("NZWN", "", f"select *, {_AT} as valid, cast(l_quantity as bigint) as t, cast(l_quantity as bigint) - 2 - l_partkey % 9 as d from lineitem"),
    "grp": r"""select *, nullif(regexp_extract(metar, '\s(M?\d{1,2})/(M?\d{1,2})(?:\s|$)', 1), '') as g1,
        nullif(regexp_extract(metar, '\s(M?\d{1,2})/(M?\d{1,2})(?:\s|$)', 2), '') as g2 from raw""",
    "num": "select *, cast(replace(g1, 'M', '-') as bigint) as t, cast(replace(g2, 'M', '-') as bigint) as d from grp",
    "obs": f"""select obs_id, valid, tmpf, drct, sknt, alti, p01i, skyc1, cast(skyl1 as bigint) as skyl1, wxcodes,
        case when t is null then round_even((tmpf - 32e0) * 5e0 / 9e0, 0)::bigint when t between -10 and 40 then t end as tmp,
        case when t between -10 and 40 and d between -50 and 35 then d end as dwp,
        case when t is null then case when tmpf is null then 'missing' else 'imputed' end
             when t between -10 and 40 then 'ok' else 'missing' end as dq,
        coalesce(t is not null and not (t between -10 and 40 and d between -50 and 35), false) as implausible,
        {LOCAL.format(x="valid")} as ts_local, cast({LOCAL.format(x="valid")} as date) as date_local,
        hour({LOCAL.format(x="valid")}) as hour_local from num""",
    "gaps": """select *, floor((epoch_us(valid) - epoch_us(lag(valid) over w)) / 60000000)::bigint as gap_min from obs where dq = 'ok'
        window w as (partition by date_local order by valid, obs_id)""",
    "cpd": f"""select date_local, cp, case when cast({LOCAL.format(x="c")} as date) = date_local then c else c - interval 1 day end as cp_utc
        from (select date_local, v.h || ':00' as cp, cast(date_local as timestamp) + to_hours(v.h) as c
              from (select distinct date_local from obs), (values {", ".join(f"({h})" for h in CPS)}) v(h))""",
    "cpw": f"select date_local, {', '.join(f"max(cp_utc) filter (cp = '{h}:00') as c{h}" for h in CPS)} from cpd group by 1",
    "days": f"""select date_local, first(struct_pack(t := tmp, h := hour_local, f := tmpf, l := ts_local) order by tmp desc, valid, obs_id) as top,
        min(tmp) as tmin_int, min(tmpf) as tmpf_min, count(*) as n_obs, max(gap_min) as max_gap_min, min(hour_local) as fh,
        max(hour_local) as lh, count(distinct hour_local // 6) as q, {", ".join(f"max(tmp) filter (valid < c{h}) as k_cp__cp_{h}00" for h in CPS)}
        from gaps join cpw using (date_local) group by 1""",
    "imp": "select date_local, count(*) filter (dq = 'imputed') as n_imputed from obs group by 1",
    "labels": f"""select date_local, top.t as tmax_int, tmin_int, (top.f - 32e0) * 5e0 / 9e0 as tmax_dec, (tmpf_min - 32e0) * 5e0 / 9e0 as tmin_dec,
        tmpf_min, n_obs, max_gap_min, n_imputed, 'ok' as tmax_source, top.l as tmax_ts, top.h as tmax_hour,
        {AS_UTC.format(x="(cast(date_local as timestamp) + to_hours(top.h))")} as tmax_hour_utc, top.h < 6 or top.h > 18 as tmax_atypical_hour,
        n_obs >= 8 and coalesce(max_gap_min, 0) <= 360 and fh * 60 <= 360 and (23 - lh) * 60 + 60 <= 360 and q >= 1 as day_complete,
        {", ".join(f"k_cp__cp_{h}00" for h in CPS)} from days join imp using (date_local)""",
    "kcp": " union all ".join(f"select date_local, '{h}:00' as cp, k_cp__cp_{h}00 as k_cp from labels" for h in CPS),
    "chg": """select *, (tmp - lag(tmp) over w)::double / nullif((epoch_us(valid) - epoch_us(lag(valid) over w)) / 3600000000e0, 0) as delta
        from obs where dq <> 'missing' window w as (partition by date_local order by valid, obs_id)""",
    "slices": f"""select o.*, c.cp, c.cp_utc, hour({LOCAL.format(x="c.cp_utc")}) as cp_hour, {_WEIGHT} as w,
        (epoch_us(ts_local) - epoch_us(cast(date_local as timestamp))) / 1000000 as secs
        from chg o join cpd c using (date_local) where o.valid < c.cp_utc""",
    "agg": f"""select date_local, cp, count(*) as n_slice, coalesce(sum(p01i), 0) as p01i_sum, avg(tmp - dwp) as depression, min(tmp) as tmin_so_far,
        max(delta) as max_delta, coalesce(avg(sknt) filter (drct >= 270 or drct <= 45), 0) as nw_strength,
        first(hour_local order by tmp desc, valid, obs_id) as tmax_hour_so_far, avg(drct) filter (hour_local <= 12) as early_dir,
        avg(drct) filter (hour_local >= 15) as late_dir, avg(drct) as mean_dir, sum(sin(radians(drct))) as s, sum(cos(radians(drct))) as c,
        max(w) as cloud_cover, max(w * least(1e0, coalesce(skyl1, 0) / 8000e0)) as cloud_base,
        coalesce(bool_or(contains(wxcodes, 'RA')), false) as has_rain,
        {", ".join(f"first(struct_pack(t := tmp, d := dwp, s := sknt, r := drct, a := alti) order by floor(abs(secs - {a * 3600}) / 60), valid, obs_id) filter (floor(abs(secs - {a * 3600}) / 60) <= 30 and {a} < cp_hour) as a{a}" for a in ANCHORS)}
        from slices group by 1, 2""",
    "dir": "select *, case when abs(s) >= 1e-10 or abs(c) >= 1e-10 then ((degrees(atan2(s, c)) % 360e0) + 360e0) % 360e0 end as circ from agg",
    "reg": """select *, case when n_slice < 3 then 'insufficient' when p01i_sum > 0.01 or coalesce(max_delta, 0) < -2 then 'disrupted'
        when nw_strength * coalesce(depression, 0) > 60 then 'foehn_nw' when tmax_hour_so_far >= 18 then 'late_warming'
        when coalesce(max_delta, 0) > 1 then 'transition' else 'calm' end as regime from dir""",
    "dayagg": """select date_local, count(*) as n_slice, coalesce(sum(p01i), 0) as p01i_sum, avg(tmp - dwp) as depression, max(delta) as max_delta,
        coalesce(avg(sknt) filter (drct >= 270 or drct <= 45), 0) as nw_strength,
        first(hour_local order by tmp desc, valid, obs_id) as th from chg group by 1""",
    "dayreg": """select date_local, n_slice, case when n_slice < 3 then 'calm' when p01i_sum > 0.01 or coalesce(max_delta, 0) < -2 then 'disrupted'
        when nw_strength * coalesce(depression, 0) > 60 then 'foehn_nw' when th >= 18 then 'late_warming'
        when coalesce(max_delta, 0) > 1 then 'transition' else 'calm' end as regime from dayagg""",
    "near": """select l.date_local, a.tmax_int as m1, b.tmax_int as m2, c.tmax_int as m3 from labels l
        left join labels a on a.date_local = l.date_local - 1 left join labels b on b.date_local = l.date_local - 2
        left join labels c on c.date_local = l.date_local - 3""",
    "seq": """select *, case when m1 is null or m2 is null or m3 is null then null when abs(m1 - m2) <= 1 and abs(m2 - m3) <= 1 then 'flat'
        when m3 < m2 and m2 < m1 then 'warming' when m3 > m2 and m2 > m1 then 'cooling' when m3 < m2 and m2 > m1 then 'peaked'
        when m3 > m2 and m2 < m1 then 'troughed' else 'flat' end as pattern from near""",
    "feat": f"""select g.date_local, g.cp, coalesce(r.regime, 'insufficient') as regime_label,
        case when n_slice >= 3 then '{{"intraday_regime_change":' || coalesce(abs(late_dir - early_dir) > 90, false) || '}}' else '{{}}' end as regime_flags,
        {_trend("t")} as slope_3h, null::double as hours_to_expected_peak, depression as dewpoint_depression,
        case when n_slice is not null then m1 end as tmax_dminus1, tmin_so_far - m1 as tmin_delta_tmax,
        case when n_slice is not null then n_slice >= 3 and coalesce(abs(late_dir - early_dir) > 90, false) end as intraday_regime_change,
        case when n_slice is not null then case when early_dir between 135 and 225 and (late_dir >= 315 or late_dir <= 45)
             then least(abs(late_dir - early_dir), 360 - abs(late_dir - early_dir)) else 0e0 end end as wind_dir_change_s_to_n,
        case when n_slice is not null then pattern end as day_sequence_pattern,
        case when n_slice is not null then (p01i_sum > 0.01 or has_rain)::bigint end as precip_disruption,
        null::double as tmax_hour_by_regime_month, cloud_cover as cloud_cover_suppression, {_trend("a", f"{HPA_PER_INHG}e0")} as pressure_trend_3h,
        nw_strength * depression as foehn_score, null::double as late_warming_anomaly, r.regime as regime_score_argmax,
        (a9.t - a6.t) / 3e0 as warming_rate_06_09,
        case when n_slice is not null then coalesce(a6.t = a9.t and a9.t = a12.t and (circ >= 315 or circ <= 45) and cloud_cover >= 0.75, false)::bigint end as nocturnal_plateau_flag,
        null::double as sst_maritime_cap, {_trend("d")} as dewpoint_collapse_rate_3h,
        case when n_slice is not null then coalesce((({_ENDS["a"]})[1].v - ({_ENDS["a"]})[-1].v) * {HPA_PER_INHG}e0 >= 0.5 and p01i_sum = 0
             and (circ >= 315 or circ <= 45), false)::bigint end as prefrontal_warming_window,
        case when n_slice is not null then coalesce(r.regime = 'foehn_nw' and circ between 280 and 310, false)::bigint end as nw_sector_not_foehn,
        cloud_base as cloud_base_transparency
        from (select seq.*, v.h || ':00' as cp from seq, (values {", ".join(f"({h})" for h in CPS)}) v(h)) g left join reg r using (date_local, cp)""",
    "train": f"select * from labels where day_complete and date_local < {START}",
    "recent": f"select * from labels where day_complete and date_local between {START} and {END}",
    "doym": "select dayofyear(date_local) as doy, avg(tmax_int) as mean from train group by 1",
    "slots": "select s.doy, mean from (select unnest(generate_series(1, 366)) as doy) s left join doym using (doy)",
    "filled": """select doy, coalesce(mean, lm + (hm - lm) / nullif((hd - ld)::double, 0) * (doy - ld), lm, hm) as mean from (select *,
        last_value(mean ignore nulls) over b as lm, last_value(case when mean is not null then doy end ignore nulls) over b as ld,
        first_value(mean ignore nulls) over f as hm, first_value(case when mean is not null then doy end ignore nulls) over f as hd from slots
        window b as (order by doy rows between unbounded preceding and current row), f as (order by doy rows between current row and unbounded following))""",
    "ring": "select doy, mean from filled union all select 0, mean from filled where doy = 366",
    "clim": """select (r.doy + o.o + 367) % 367 as doy, avg(mean) as tmax_dec from ring r, (select unnest(generate_series(-15, 15)) as o) o
        group by 1 having (r.doy + o.o + 367) % 367 > 0""",
    "mon": """select m.month, coalesce(avg(tmax_int), 15e0) as mean, coalesce(quantile_cont(tmax_int, 0.1), 10e0) as p10,
        coalesce(quantile_cont(tmax_int, 0.5), 15e0) as p50, coalesce(quantile_cont(tmax_int, 0.9), 20e0) as p90
        from (select unnest(generate_series(1, 12)) as month) m left join train t on month(t.date_local) = m.month group by 1""",
    "tk": "select month(t.date_local) as month, cp, k.k_cp, tmax_int from train t join kcp k using (date_local) where k.k_cp is not null",
    "own": "select month, cp, k_cp, tmax_int as k, count(*) as n from tk group by all",
    "every": "select month, cp, tmax_int as k, count(*) as n from tk group by all",
    "rk": "select r.date_local, month(r.date_local) as month, r.tmax_int as truth, cp, k.k_cp from recent r join kcp k using (date_local) where k.k_cp is not null",
    "keyed": """select q.*, case when coalesce(o.n, 0) >= 30 then 'conditional' when e.n is not null then 'fallback_marginal' else 'uniform' end as source,
        o.n as own_n, e.n as every_n from (select distinct month, cp, k_cp from rk) q
        left join (select month, cp, k_cp, sum(n) as n from own group by all) o using (month, cp, k_cp)
        left join (select month, cp, sum(n) as n from every group by all) e using (month, cp)""",
    "dist": """select month, cp, k_cp, k, p / sum(p) over (partition by month, cp, k_cp) as prob, source from (
        select q.month, q.cp, q.k_cp, s.k, q.source, case q.source when 'conditional' then (coalesce(o.n, 0) + 1e0) / (own_n + size)
          when 'fallback_marginal' then (coalesce(e.n, 0) + 1e0) / (every_n + size) else 1e0 / size end as p
        from keyed q, (select distinct tmax_int as k, (select count(distinct tmax_int) from train)::double as size from train) s
        left join own o on o.month = q.month and o.cp = q.cp and o.k_cp = q.k_cp and o.k = s.k
        left join every e on e.month = q.month and e.cp = q.cp and e.k = s.k)""",
    "modes": "select month, cp, k_cp, source, first(k order by prob desc, k) as mode from dist group by all",
    "prs": """select 'L0' as level, 'persistence' as name, date_local, cp, truth, k_cp::double as pred, null::double as fallback from rk
        union all select 'L1', 'dminus1', r.date_local, cp, truth, l.tmax_int::double, null from rk r join labels l on l.date_local = r.date_local - 1 and l.day_complete
        union all select 'L2', 'climatology_doy', r.date_local, cp, truth, floor(tmax_dec + 0.5)::double, null from rk r join clim c on c.doy = dayofyear(r.date_local)
        union all select 'L4', 'empirical_conditional', r.date_local, cp, truth, mode::double, (source <> 'conditional')::int::double from rk r join modes using (month, cp, k_cp)""",
    "errs": """select level, name, date_local, cp, truth, pred, pred - truth as error, abs(pred - truth) as abs_error, (pred - truth) * (pred - truth) as sq_error,
        (floor(pred + 0.5) = truth)::int::double as bracket_match, fallback from prs""",
    "summ": """select level, name, cp, mae, rmse, bias, bracket_match, fallback_rate, n, p50_mode_share from (select level, name, cp, avg(abs_error) as mae, sqrt(avg(sq_error)) as rmse, avg(error) as bias,
        avg(bracket_match) as bracket_match, avg(fallback) as fallback_rate, count(*) as n from errs group by all)
        join (select level, name, cp, max(c) / sum(c) as p50_mode_share from (select level, name, cp, round_even(pred, 0) as p, count(*) as c from errs group by all) group by all) using (level, name, cp)""",
    "pairs": """select a.cp, a.date_local, a.abs_error - b.abs_error as gain from (select * from errs where name = 'persistence') a
        join (select * from errs where name = 'climatology_doy') b using (cp, date_local)""",
    "tgt": "select date_local, cp, k.k_cp, l.tmax_int as tmax, l.tmax_hour from labels l join kcp k using (date_local) where day_complete and k.k_cp is not null",
    "spl": "select * from (values " + ", ".join(f"('{n}', (select min(date_local) from labels where day_complete), date '{d}' - 1, date '{d}', date '{d}' + 364)" for n, d in SPLITS)
        + ") s(split, train_start, train_end, test_start, test_end)",
    "vals": " union all ".join(f"select date_local, cp, regime_label, '{c}' as feature, {c}::double as value from feat where {c} is not null" for c in VALUES),
    "tsr": f"""select s.split, g.date_local, g.cp, f.regime_label, g.k_cp, g.tmax_hour, hour({LOCAL.format(x="c.cp_utc")}) as cp_hour, g.date_local <= s.train_end as train
        from tgt g join feat f using (date_local, cp) join cpd c using (date_local, cp) join spl s on g.date_local between s.train_start and s.test_end""",
    "tsh": "select split, cp, regime_label, month(date_local) as month, avg(tmax_hour) as peak from tsr where train group by all",
    "tsm": "select split, cp, regime_label, avg(k_cp) as m, stddev_pop(k_cp) as sd from tsr where train group by all",
    "tsf": """select t.*, peak - cp_hour as hours_to_expected_peak, peak as tmax_hour_by_regime_month, (k_cp - m) / greatest(sd, 1e0) as late_warming_anomaly
        from (select *, month(date_local) as month from tsr) t left join tsh using (split, cp, regime_label, month) left join tsm using (split, cp, regime_label)""",
    "tsv": " union all ".join(f"select split, date_local, cp, regime_label, '{c}' as feature, {c}::double as value, train from tsf where {c} is not null" for c in FROM_TRAINING),
    "fits": """select s.split, v.feature, v.cp, v.date_local, v.value from vals v join spl s on v.date_local between s.train_start and s.train_end
        union all select split, feature, cp, date_local, value from tsv where train""",
    "models": """select split, feature, cp, count(y) as n_train,
        case when min(x) = max(x) then avg(x) * avg(y) / (1 + avg(x) * avg(x)) else covar_pop(y, x) / var_pop(x) end as slope,
        case when min(x) = max(x) then avg(y) / (1 + avg(x) * avg(x)) else avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) end as intercept
        from (select v.split, v.feature, v.cp, (t.tmax - t.k_cp)::double as y, case when t.tmax is not null then v.value end as x
              from fits v left join tgt t using (date_local, cp))
        group by all having count(*) >= 30 and count(y) >= 5""",
    "tests": """select s.split, v.date_local, v.cp, v.regime_label, v.feature, v.value from vals v join spl s on v.date_local between s.test_start and s.test_end
        union all select split, date_local, cp, regime_label, feature, value from tsv where not train""",
    "chal": """select m.split, v.date_local, m.feature, m.cp, v.regime_label as regime, t.tmax, t.k_cp::double as base_pred, t.k_cp + intercept + slope * value as pred,
        abs(t.k_cp - t.tmax)::double as base_error, abs(t.k_cp + intercept + slope * value - t.tmax) as error
        from tests v join models m on m.split = v.split and m.feature = v.feature and m.cp = v.cp
        join tgt t on t.date_local = v.date_local and t.cp = v.cp
        where v.split in (select split from spl join (select distinct date_local from tgt) d on d.date_local between test_start and test_end group by 1 having count(*) >= 30)""",
    "gain": "select *, base_error - error as gain, count(*) over (partition by feature, cp) as n from chal",
}


def with_ctes(final: str, raw: str | None = None) -> str:
    """`final` behind the expressions that it and they refer to, in order; raw: other reports than those of line items."""
    need: list[str] = []
    texts = CTES | ({"raw": raw} if raw else {})

    def add(text: str) -> None:
        for name in texts:
            if name not in need and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\b(?=\s*[,)])|from\s*\(select[^()]*from\s+{name}\b", text):
                add(texts[name])
                if name not in need:
                    need.append(name)

    add(final)
    head = ", ".join(f"{n} as materialized ({texts[n]})" for n in need)
    return f"with {head} {final}" if need else final


_CORR = "case when count(*) < 3 then 0 when min({a}) < max({a}) and min(tmax) < max(tmax) then covar_pop({a}, tmax) / sqrt(var_pop({a}) * var_pop(tmax)) end"

def _draws(value: str, keys: str, source: str, unit: str, reps: int) -> str:
    """Weighted means of resamples of each group: a unit occurs as often as its digest says, as in the library."""
    number = "('0x' || substr(d, 1 + 4 * k, 4))::int"
    times = " + ".join(f"({number} >= {b})::int" for b in BOUNDS)
    pairs = " and ".join(f"g.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""select {keys}, rep, list_dot_product(c, v) / list_dot_product(c, w) as stat
        from (select {", ".join("g." + k.strip() for k in keys.split(","))}, list(coalesce(r.s, 0)::double order by u.unit) as v, list(coalesce(r.n, 0)::double order by u.unit) as w
              from (select distinct {keys} from {source}) g cross join (select distinct {unit} as unit from {source}) u
              left join (select {keys}, {unit} as unit, sum({value}) as s, count({value}) as n from {source} group by all) r on r.unit = u.unit and {pairs}
              group by all),
        (select rep, list(t::double order by unit) as c from (select unit, b * 16 + k as rep, {times} as t
           from (select unit, b, sha256('42|' || unit || '|' || b) as d from (select distinct {unit} as unit from {source}), (select unnest(range(0, {-(-reps // 16)})) as b)),
             (select unnest(range(0, 16)) as k)) where rep < {reps} group by rep)"""


def _statistics(source: str, keys: str) -> str:
    """Effect, interval, p-value, errors, correlation gain and mode share by `keys`."""
    return f"""select {keys}, n_days, effect_size, null_mae, model_mae, corr_diff, p50_mode_share,
        quantile_cont(stat, 0.025) filter (rep < {N_CI}) as ci_lo, quantile_cont(stat, 0.975) filter (rep < {N_CI}) as ci_hi,
        (count(*) filter (stat <= 0) + 1) / {N_P + 1}::double as p_value
        from ({_draws("gain", keys, source, "date_local || '|' || split", N_P)})
        join (select {keys}, count(*) as n_days, avg(gain) as effect_size, avg(base_error) as null_mae, avg(error) as model_mae,
              {_CORR.format(a="pred")} - {_CORR.format(a="base_pred")} as corr_diff from {source} group by all) using ({keys})
        join (select {keys}, max(c) / sum(c) as p50_mode_share from (select {keys}, round_even(pred, 0) as p, count(*) as c from {source} group by all) group by all) using ({keys})
        group by {keys}, n_days, effect_size, null_mae, model_mae, corr_diff, p50_mode_share"""


#: Gates of challengers: no fallback, checkpoints by the morning rule of the reference date.
_MORNING = f"hour({LOCAL.format(x="(timestamp '2025-06-15' + to_hours(left(cp, 2)::int))")}) < 12"
_FAILED = f"""concat_ws(' ', case when not coalesce(model_mae < null_mae, false) then 'G1' end, case when coalesce(p50_mode_share, 0) > 0.5 then 'G3' end,
    case when not coalesce(case when {_MORNING} then ci_lo > 0 else corr_diff >= 0.05 end, false) then 'G4' end, case when not coalesce(model_mae < null_mae, false) then 'G5' end)"""
_BLOCKED = "no source for sea surface temperature"
_GRID = "select * from (values " + ", ".join(f"('{h}', '{c}')" for h, c in CATALOG) + ") a(id, feature), (values " + ", ".join(f"('{h}:00')" for h in CPS) + ") b(cp)"
_TEXTS = "('regime_label', 'intraday_regime_change', 'day_sequence_pattern', 'regime_score_argmax')"
CTES |= {
    "gainall": "select * replace ('all' as regime) from gain where n >= 30 and feature <> 'sst_maritime_cap'",
    "statall": f"select *, {_FAILED} as failed_gates from ({_statistics('gainall', 'feature, cp, regime')})",
    "gainreg": """select * from (select *, count(*) over (partition by feature, cp, regime) as m from gain where feature <> 'sst_maritime_cap' and regime not in ('all', 'unknown', '')
        and (feature, cp) in (select (feature, cp) from statall where ci_lo > 0 and failed_gates = '')) where m >= 30""",
    "statreg": f"select *, {_FAILED} as failed_gates from ({_statistics('gainreg', 'feature, cp, regime')})",
    "grid": _GRID,
    "tested": "select * from statall union all by name select * from statreg",
    "judged": f"""select g.id, t.*, null as blocked_reason, null as reason from tested t join grid g using (feature, cp)
        union all by name select id, feature, cp, 'all' as regime, 0 as n_days, case when feature = 'sst_maritime_cap' then '{_BLOCKED}' end as blocked_reason,
          case when feature in {_TEXTS} then 'unsupported_type' end as reason
          from grid g where not exists (select 1 from statall s where s.feature = g.feature and s.cp = g.cp)""",
    "ranked": """select *, p_value <= row_number() over (order by p_value, id, cp, regime) / (count(*) over ())::double * 0.05 as ok, row_number() over (order by p_value, id, cp, regime) as k
        from judged where p_value is not null""",
    "decided": """select j.*, coalesce(r.k <= (select max(k) from ranked where ok), false) as fdr_adjusted, coalesce(j.ci_lo > 0, false) as passes,
        case when j.blocked_reason is not null then 'BLOCKED' when j.ci_lo > 0 and coalesce(r.k <= (select max(k) from ranked where ok), false) and j.failed_gates = '' then 'validated' else 'rejected' end as status
        from judged j left join ranked r on r.id = j.id and r.cp = j.cp and r.regime = j.regime""",
}


_CIRC = "case when abs(s) >= 1e-10 or abs(c) >= 1e-10 then ((degrees(atan2(s, c)) % 360e0) + 360e0) % 360e0 end"
_STATS = ", ".join(six(c) for c in ("effect_size", "null_mae", "model_mae", "corr_diff", "p50_mode_share", "ci_lo", "ci_hi", "p_value"))
_D = "cast(date_local as varchar) as date_local"

FINAL = {
    "obs_parse_quality": f"select obs_id, tmp as tmp_c_int, dwp as dwp_c_int, dq, implausible, tmp - dwp as dw_depression_c_int, dwp > tmp as dwp_gt_tmp_flag, skyl1, {_D}, hour_local from obs",
    "parse_statistics": f"""select count(*) filter (dq = 'ok') as n_ok, count(*) filter (dq = 'imputed') as n_imputed, count(*) filter (dq = 'missing') as n_missing,
        count(*) filter (implausible) as n_implausible, {six("count(*) filter (dq = 'imputed') / count(*) filter (dq <> 'missing')", "fallback_rate")},
        {six("count(*) filter (dq = 'missing') / count(*)", "missing_rate")} from obs""",
    "csv_roundtrip_scan": f"""select obs_id, epoch(valid)::bigint as valid, metar, {six("tmpf")}, skyc1, wxcodes from raw
        where cast(valid as date) between date '1996-01-01' and date '2000-12-31'""",
    "local_calendar": f"""select event_id as obs_id, cast(cast(l as date) as varchar) as date_local, hour(l) as hour_local, dayofyear(l) as doy,
        epoch({AS_UTC.format(x="cast(cast(l as date) as timestamp)")})::bigint as day_start, epoch({AS_UTC.format(x="cast(cast(l as date) + 1 as timestamp)")})::bigint as day_end,
        hour(l) // 6 as quartile from (select *, {LOCAL.format(x="ts")} as l from events)""",
    "cp_instants": f"""select {_D}, cp, epoch(cp_utc)::bigint as cp_utc, hour({LOCAL.format(x="cp_utc")}) as cp_hour,
        hour({LOCAL.format(x="(timestamp '2025-06-15' + to_hours(left(cp, 2)::int))")}) < 12 as morning, 'k_cp__cp_' || replace(cp, ':', '') as key from cpd""",
    "settlement_flip": f"""select o_orderkey, floor(x + 0.5)::bigint as bracket, {six("greatest(0e0, round(0.5 - abs(x - floor(x + 0.5)), 6))", "boundary_distance")},
        {six("floor(x) + 0.5", "nearest_boundary")}, case when abs(x - floor(x) - 0.5) < 1e-9 then 'stable' when abs(x - floor(x)) < 1e-9 then 'either'
        when x < floor(x + 0.5) then 'down' else 'up' end as direction, {six("0.5 - greatest(0e0, round(0.5 - abs(x - floor(x + 0.5)), 6))", "flip_risk")},
        {six("0.5 - abs(x - round_even(x, 0))", "day_distance")} from (select *, o_totalprice / 10000e0 - 10e0 as x from orders)""",
    "daily_label_table": f"""select {_D}, tmax_int, tmin_int, {six("tmax_dec")}, {six("tmin_dec")}, {six("tmpf_min")}, n_obs, max_gap_min, n_imputed, tmax_source,
        epoch(tmax_ts)::bigint as tmax_ts, tmax_hour, tmax_hour as tmax_hour_local,
        cast(date_local as varchar) || ' ' || lpad(cast(tmax_hour as varchar), 2, '0') || ':00:00' as tmax_hour_str, epoch(tmax_hour_utc)::bigint as tmax_hour_utc, tmax_atypical_hour,
        {six("0.5 - abs(tmax_dec - round_even(tmax_dec, 0))", "risco_de_flip")}, day_complete, {", ".join(f"k_cp__cp_{h}00" for h in CPS)} from labels""",
    "obs_gaps": f"select obs_id, {_D}, gap_min from gaps",
    "k_cp_long": f"select {_D}, cp, k_cp from kcp",
    "anchor_nearest": " union all ".join(
        f"select {_D}, cp, {a} as anchor, a{a}.t as tmp_c_int, a{a}.d as dwp_c_int, {six(f'a{a}.s', 'sknt')}, {six(f'a{a}.r', 'drct')}, {six(f'a{a}.a', 'alti')} from agg where a{a} is not null" for a in ANCHORS),
    "slice_aggregates": f"""select {_D}, cp, n_slice, {six("p01i_sum")}, {six("depression")}, tmin_so_far, {six("max_delta")}, {six("nw_strength")}, tmax_hour_so_far,
        {six("early_dir")}, {six("late_dir")}, {six("mean_dir")}, {six("cloud_cover")}, {six("cloud_base")}, has_rain from agg""",
    "circular_wind": f"""select {_D}, cp, round({_CIRC}, 6) % 360e0 + 0e0 as circular_dir, {six("south", "south_mean")}, {six("north", "north_mean")} from (select date_local, cp,
        sum(sin(radians(drct))) as s, sum(cos(radians(drct))) as c, avg(drct) filter (drct between 135 and 225) as south, avg(drct) filter {"(" + _NORTH[1:-1] + ")"} as north from slices group by 1, 2)""",
    "sky_codes": f"select skyc1, {six(f'max({_WEIGHT})', 'weight')}, count(*) as n, count(*) filter {_NORTH} as n_north from obs group by 1",
    "neighbour_days": f"select {_D}, m1 as tmax_dminus1, m2 as tmax_dminus2, m3 as tmax_dminus3, pattern from seq",
    "regime_by_day": f"select {_D}, regime, n_slice from dayreg",
    "regime_by_month": "select month(date_local) as month, regime, count(*) as n from dayreg group by all",
    "feature_table": f"""select {_D}, cp, regime_label, regime_flags, {", ".join(c if c in ("intraday_regime_change", "day_sequence_pattern", "regime_score_argmax", "tmax_dminus1", "tmin_delta_tmax", "precip_disruption", "nocturnal_plateau_flag", "prefrontal_warming_window", "nw_sector_not_foehn") else six(c) for c in HYPOTHESES if c != "regime_label")} from feat""",
    "coverage_manifest": " union all ".join(
        f"select '{h}' as id, '{c}' as feature, '{'BLOCKED' if c == 'sst_maritime_cap' else 'computable'}' as status, {repr('no source for sea surface temperature') if c == 'sst_maritime_cap' else 'null'} as reason, count({c}) as n_non_null, count(*) as n_total, round(count({c}) / count(*), 4) + 0e0 as non_null_rate from feat" for h, c in CATALOG),
    "hour_coverage": f"select hour({LOCAL.format(x='ts')}) as hour_local, count(*) as n from events group by 1",
    "tmax_hour_month": f"select month(date_local) as month, {six('avg(tmax_hour)', 'mean_hour')}, count(*) as n, count(*) filter (tmax_hour >= 18) as n_late from labels group by 1",
    "climatology_doy": f"select doy, {six('tmax_dec')} from clim",
    "climatology_month": f"select month, {six('mean')}, {six('p10')}, {six('p50')}, {six('p90')} from mon",
    "empirical_counts": "select month, cp, k_cp, k as tmax_int, n from own union all select month, cp, null, k, n from every",
    "empirical_dist": f"select month, cp, k_cp, k, {six('prob')}, source from dist",
    "rps_scores": f"""select {_D}, cp, {six("avg(d * d)", "rps")} from (select r.date_local, r.cp, sum(prob) over (partition by r.date_local, r.cp order by k rows unbounded preceding)
        - (k >= truth)::int as d from rk r join dist using (month, cp, k_cp)) group by all""",
    "crps_scores": f"""select {_D}, {six("avg(abs(value - 50e0)) - sum((2 * i - n - 1) * value / (n * n))", "crps")} from (select cast({LOCAL.format(x="ts")} as date) as date_local, value,
        row_number() over (partition by cast({LOCAL.format(x="ts")} as date) order by value) as i, count(*) over (partition by cast({LOCAL.format(x="ts")} as date)) as n
        from events where value is not null) group by 1""",
    "ladder_errors": f"select level, name, {_D}, cp, truth, {six('pred')}, {six('error')}, {six('abs_error')}, {six('sq_error')}, {six('bracket_match')}, {six('fallback')} from errs",
    "ladder_summary": f"select level, name, cp, {six('mae')}, {six('rmse')}, {six('bias')}, {six('bracket_match')}, {six('fallback_rate')}, n, {six('p50_mode_share')}, 0e0 as rps, null::double as corr_diff from summ",
    "tmax_hour_counts": "select month(date_local) as month, tmax_hour, count(*) as n from labels group by all",
    "missing_previous_days": """select cp, count(*) as n, count(*) filter (l.date_local is null) as n_missing from rk r
        left join (select date_local from labels where day_complete) l on l.date_local = r.date_local - 1 group by cp""",
    "bootstrap_paired": f"""select cp, {six("point")}, {six("quantile_cont(stat, 0.025)", "lo")}, {six("quantile_cont(stat, 0.975)", "hi")}
        from ({_draws("gain", "cp", "pairs", "date_local::varchar", N_CI)}) join (select cp, avg(gain) as point from pairs group by all) using (cp) group by cp, point""",
    "best_null": f"select cp, b.level as level, b.name as name, {six('b.mae', 'mae')} from (select cp, first(struct_pack(level := level, name := name, mae := mae) order by mae, level) as b from summ group by 1)",
    "segment_mae": f"""select coalesce(regime_label, 'unknown') as regime, level, name, cp, {six("avg(abs_error)", "mae")}, count(*) as n,
        coalesce(regime_label, 'unknown') || '_' || cp as segment from errs left join feat using (date_local, cp) group by all""",
    "metrics_point": f"""select cp, {six("avg(abs(k_cp - tmax))", "mae")}, {six("sqrt(avg((k_cp - tmax) * (k_cp - tmax)))", "rmse")}, {six("avg(k_cp - tmax)", "bias")},
        {six("corr(k_cp, tmax)", "corr")}, {six("avg((k_cp = tmax)::int)", "bracket_match")}, count(*) as n,
        {six("1 - avg((k_cp - tmax) * (k_cp - tmax)) / avg((m1 - tmax) * (m1 - tmax))", "skill")} from tgt join near using (date_local) where m1 is not null group by 1""",
    "wf_splits": f"""select split, cast(a as varchar) as train_start, cast(b - 1 as varchar) as train_end, cast(b as varchar) as test_start, cast(e as varchar) as test_end from
        (select s.split, (select min(date_local) from labels where day_complete) as a, s.b, s.e from (values ('test_1995-06-01', date '1995-06-01', date '1995-06-01' + 364),
        {", ".join(f"('{n}', date '{d}', date '{d}' + 364)" for n, d in SPLITS)}, ('holdout_90d', {START}, {END})) s(split, b, e)) where b - a >= 365""",
    "train_stat_features": f"""select split, {_D}, cp, {six("hours_to_expected_peak")}, {six("tmax_hour_by_regime_month")}, {six("late_warming_anomaly")} from tsf where not train""",
    "ols_models": f"select split, feature, cp, n_train, {six('slope')}, {six('intercept')} from models",
    "challenger_errors": f"select split, {_D}, feature, cp, tmax, {six('base_pred')}, {six('pred')}, {six('base_error')}, {six('error')} from chal",
    "bootstrap_mean": f"""select name, cp, {six("point")}, {six("quantile_cont(stat, 0.025)", "lo")}, {six("quantile_cont(stat, 0.975)", "hi")}
        from ({_draws("abs_error", "name, cp", "errs", "date_local::varchar", N_CI)}) join (select name, cp, avg(abs_error) as point from errs group by all) using (name, cp) group by name, cp, point""",
    "hypothesis_statistics": f"select feature, cp, n_days, {_STATS} from ({_statistics('(select * from gain where n >= 30)', 'feature, cp')})",
    "hypothesis_results": f"""select id, feature, cp, regime, n_days, {_STATS}, per_cp_passed, all_passed, failed_gates, blocked_reason, reason, fdr_adjusted, passes, status
        from (select *, case when n_days > 0 then model_mae < null_mae end as per_cp_passed, case when n_days > 0 then failed_gates = '' end as all_passed from decided)""",
    "feature_contract": f"""select status as kind, id, feature as feature_column, cp, regime, {six("effect_size")}, {six("ci_lo")}, {six("ci_hi")}, {six("p_value")}, reason, 0.05e0 as alpha,
        (select count(*) from decided where status <> 'BLOCKED') as n_hypotheses_tested, (select count(*) from decided where status = 'validated') as n_validated,
        (select count(*) from decided where status = 'rejected') as n_rejected from (select * replace (lower(status) as status, case when status = 'BLOCKED' then blocked_reason end as reason,
          case when status = 'validated' then regime end as regime, case when status = 'validated' then effect_size end as effect_size, case when status = 'validated' then ci_lo end as ci_lo,
          case when status = 'validated' then ci_hi end as ci_hi, case when status = 'validated' then p_value end as p_value) from decided where status in ('validated', 'BLOCKED'))""",
    "baseline_gates": """select level, name, cp, bool_and(passed) over (partition by level, name, cp) as all_passed, gate, passed, case when passed then 'OK' else bad end as status
        from (select level, name, cp, unnest([struct_pack(gate := 'G1', passed := mae < best, bad := 'KILL'),
          struct_pack(gate := 'G2', passed := coalesce(fallback_rate, 0) <= 0.5, bad := 'NOT_OPERATIONAL'), struct_pack(gate := 'G3', passed := p50_mode_share <= 0.5, bad := 'COLLAPSE_ALERT'),
          struct_pack(gate := 'G4', passed := false, bad := 'NOWCAST_SUSPECT'), struct_pack(gate := 'G5', passed := mae <= best, bad := 'STAY_OUT')], recursive := true)
          from (select *, min(mae) over (partition by cp) as best from summ))""",
    "feature_nulls": f"""select feature, cp, {six("avg(abs(p - tmax))", "mae")}, count(*) as n,
        {six("case when count(*) >= 3 and min(p) < max(p) then corr(p, tmax) end - case when count(*) >= 3 then corr(k_cp, tmax) end", "corr_diff")} from (
        select v.feature, v.cp, t.tmax, t.k_cp, floor(t.k_cp + m.intercept + m.slope * v.value + 0.5)::bigint as p from vals v join tgt t using (date_local, cp)
        join (select feature, cp, case when min(value) = max(value) then avg(value) * avg(y) / (1 + avg(value) * avg(value)) else covar_pop(y, value) / var_pop(value) end as slope,
          case when min(value) = max(value) then avg(y) / (1 + avg(value) * avg(value)) else avg(y) - covar_pop(y, value) / var_pop(value) * avg(value) end as intercept
          from (select v.feature, v.cp, v.value, (t.tmax - t.k_cp)::double as y from vals v join tgt t using (date_local, cp) where v.date_local < {START}) group by all having count(*) >= 5) m
        using (feature, cp) where v.date_local between {START} and {END}) group by all having count(*) >= 5""",
    "leaderboard": f"""select cp, {START}::varchar as window_start, {END}::varchar as window_end, b.level as best_level, b.name as best_name, n_segments, n_feature_nulls, level, name,
        {six("mae")}, {six("rmse")}, {six("bias")}, {six("bracket_match")}, {six("fallback_rate")}, {six("p50_mode_share")}, n,
        concat_ws(' ', case when not mae < best then 'G1' end, case when coalesce(fallback_rate, 0) > 0.5 then 'G2' end, case when p50_mode_share > 0.5 then 'G3' end, 'G4', case when not mae <= best then 'G5' end) as failed_gates
        from (select *, min(mae) over (partition by cp) as best from summ) join (select cp, first(struct_pack(level := level, name := name) order by mae, level) as b from summ group by 1) using (cp)
        left join (select cp, count(*) as n_segments from (select distinct cp, coalesce(regime_label, 'unknown') as r, level, name from errs left join feat using (date_local, cp)) group by 1) using (cp)
        left join (select cp, count(*) as n_feature_nulls from (select v.feature, v.cp from vals v join tgt t using (date_local, cp) where v.date_local between {START} and {END}
          and (v.feature, v.cp) in (select (v.feature, v.cp) from vals v join tgt t using (date_local, cp) where v.date_local < {START} group by v.feature, v.cp having count(*) >= 5)
          group by all having count(*) >= 5) group by 1) using (cp)""",
}

FINAL["job_chain"] = FINAL["coverage_manifest"]
FINAL["ladder_scores"] = f"""select level, name, cp, {six("mae")}, n, {six("coalesce(rps, 0)", "rps")} from summ left join (
    select 'L4' as level, cp, avg(x) filter (x <> 0) as rps from (select r.date_local, r.cp, avg(d * d) as x from (
      select r.date_local, r.cp, sum(prob) over (partition by r.date_local, r.cp order by k rows unbounded preceding) - (k >= truth)::int as d
      from rk r join dist using (month, cp, k_cp)) r group by all) group by cp) using (level, cp)"""

#: Statements about one station, each true of every station by itself.
EACH = {
    "station_range_scan": f"""select obs_id, epoch(valid)::bigint as valid, tmp as tmp_c_int, dwp as dwp_c_int, dq, {_D} from obs
        where cast(valid as date) between date '1999-03-01' and date '2000-02-15'""",
    "station_splits": f"""select split, cast(train_start as varchar) as train_start, cast(train_end as varchar) as train_end,
        cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end from spl""",
    "station_climatology": FINAL["climatology_doy"],
    "station_empirical_dist": FINAL["empirical_dist"],
    "station_ladder": FINAL["ladder_summary"],
    "station_challenger_errors": FINAL["challenger_errors"],
    "station_results": FINAL["hypothesis_results"],
    "station_contract": f"""select id, feature as feature_column, cp, {six("effect_size")}, {six("ci_lo")}, {six("ci_hi")}, {six("p_value")}
        from decided where status = 'validated' and regime = 'all'""",
    "station_leaderboard": FINAL["leaderboard"].replace(
        "and (v.feature, v.cp) in (select (v.feature", "and (v.feature, v.cp) in (select (feature, cp) from decided where status = 'validated' and regime = 'all')\n          and (v.feature, v.cp) in (select (v.feature"
    ),
}
ORACLES = {name: with_ctes(sql) for name, sql in FINAL.items()} | {
    name: " union all ".join(f"select '{s}' as station, * from ({with_ctes(sql, _station_raw(s))})" for s in (STATIONS[1:] if name == "station_range_scan" else STATIONS))
    for name, sql in EACH.items()
}
