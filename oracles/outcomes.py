"""Checks: log measurements, result analysis, history."""

from assayframe.contract import TABLES
from assayframe.functions.metrics import ENTRY_TEXT_SIGNALS, QUALITATIVE_SIGNALS, TARGETS
from assayframe.rules import (
    HISTORY_CONTROL, IN_TARGET, LOG_FIELDS, METRIC_LOG_FIELDS, NO_MEASUREMENTS, NO_TARGETS, QUALITATIVE_COAGULUM,
    STRUCTURED_METHOD, TEXT_FIELDS, TEXT_METHOD,
)

from .base import cte, lit, query
from .core import EMULSION, compact, contains, fmt6, metric_key, n_strict, n_token

QUERIES: dict[str, str] = {}

# -- log measurements ---------------------------------------------------------
_sel = []
for i, (f, (m, u)) in enumerate(LOG_FIELDS.items()):
    _sel.append(f"select row_key, experiment_id, timestamp, process_stage, {i} as field_pos, '{f}' as field, '{m}' as measurement_type, "
                f"'{u}' as units, '{STRUCTURED_METHOD}' as method, {f} as value from v_daily_log where trim({f})<>''")
for i, (f, (m, u, pats)) in enumerate(TEXT_FIELDS.items(), start=len(LOG_FIELDS)):
    v = "coalesce(" + ", ".join(f"nullif(regexp_extract(observation, {lit('(?i)' + p)}, 1),'')" for p in pats) + ", null)"
    own = f" and trim({f})=''" if f in LOG_FIELDS else ""
    _sel.append(f"select row_key, experiment_id, timestamp, process_stage, {i} as field_pos, '{f}' as field, '{m}' as measurement_type, "
                f"'{u}' as units, '{TEXT_METHOD}' as method, {v} as value from v_daily_log where {v} is not null{own}")
cte("log_m", " union all ".join(_sel))
QUERIES["log_unpivot"] = query("select * from log_m")
cte("log_cand", f"""select row_key, field_pos, field, experiment_id, experiment_id||'-DL-'||{compact('timestamp',32,'row')}||'-'||{compact('field',32,'row')} as sample_id,
 measurement_type, method, value, units, concat_ws(' | ', nullif(process_stage,''), nullif(timestamp,'')) as condition, '' as replicate, 'observed' as quality_flag,
 'Normalized from '||method||' ('||field||').' as interpretation from log_m""")
cte("log_fresh", """select c.*, row_number() over (partition by experiment_id, measurement_type order by row_key, field_pos) as step from log_cand c
 where (experiment_id, sample_id, measurement_type) not in (select experiment_id, sample_id, measurement_type from v_results)
 and (experiment_id, lower(measurement_type), trim(value), lower(units)) not in (select experiment_id, lower(measurement_type), trim(value), lower(units) from v_results)""")
# walk the candidates of one (experiment, measurement) in order, carrying what was kept
cte("log_walk", """select experiment_id, measurement_type, step, row_key, field_pos, true as kept, [sample_id] as samples, [value||'~'||lower(units)] as vals from log_fresh where step=1
 union all select f.experiment_id, f.measurement_type, f.step, f.row_key, f.field_pos,
  not list_contains(w.samples, f.sample_id) and not list_contains(w.vals, f.value||'~'||lower(f.units)),
  case when not list_contains(w.samples, f.sample_id) and not list_contains(w.vals, f.value||'~'||lower(f.units)) then list_append(w.samples, f.sample_id) else w.samples end,
  case when not list_contains(w.samples, f.sample_id) and not list_contains(w.vals, f.value||'~'||lower(f.units)) then list_append(w.vals, f.value||'~'||lower(f.units)) else w.vals end
 from log_walk w join log_fresh f on f.experiment_id=w.experiment_id and f.measurement_type=w.measurement_type and f.step=w.step+1""", recursive=True)
cte("log_results", "select f.* exclude(step) from log_fresh f join log_walk w using (experiment_id, measurement_type, step) where w.kept")
QUERIES["daily_log_results"] = query("select * from log_results")
QUERIES["daily_log_summary"] = query("""select l.experiment_id, l.n as log_rows, coalesce(r.ready,0) as ready, l.n-coalesce(r.ready,0) as skipped,
 coalesce(r.n,0) as results_to_append, coalesce(c.n,0)-coalesce(r.n,0) as measurements_skipped
 from (select experiment_id, count(*) as n from v_daily_log group by 1) l
 left join (select experiment_id, count(distinct row_key) as ready, count(*) as n from log_results group by 1) r using (experiment_id)
 left join (select experiment_id, count(*) as n from log_cand group by 1) c using (experiment_id)""")

# -- measurements against targets --------------------------------------------
_ms = [f"select experiment_id, 0 as source_pos, row_key, 0 as field_pos, 'Results' as source, {metric_key(chr(34)+'mt'+chr(34))} as metric_key, measurement_type, sample_id, "
       f"{n_token('value')} as value, units, condition, quality_flag from (select *, lower(measurement_type||' '||units) as mt from v_results)"]
for i, f in enumerate(METRIC_LOG_FIELDS):
    m, u = LOG_FIELDS[f]
    _ms.append(f"select experiment_id, 1, row_key, {i}, 'Daily Log', {metric_key(lit((m + ' ' + u).lower()))}, '{m}', '', {n_token(f)}, '{u}', timestamp, 'observed' from v_daily_log")
cte("meas", "select * from (" + " union all ".join(_ms) + ") where value is not null and metric_key<>''")
cte("meas1", "select * exclude(rn) from (select *, row_number() over (partition by experiment_id, metric_key, value, units order by source_pos, row_key, field_pos) as rn from meas) where rn=1")
QUERIES["measurement_dedupe"] = query("select * from meas1")


def _num(v) -> str:
    return "cast(null as double)" if v is None else f"cast({v} as double)"


cte("targets", " union all ".join(
    f"select '{k}' as metric_key, {_num(v[1])} as tmin, {_num(v[2])} as tmax, {v[4]} as tprio, {lit(v[5])} as glow, {lit(v[6])} as ghigh, "
    f"'{' | '.join(v[7])}' as slow, '{' | '.join(v[8])}' as shigh" for k, v in TARGETS.items()))
cte("eval0", f"""select m.*, t.*, {EMULSION} as emulsion, case when t.tprio is null or not {EMULSION} then 'no_target' when value<tmin then 'below_target' when value>tmax then 'above_target' else 'in_target' end as status
 from (select m.*, e.process_type from meas1 m join v_experiments e using (experiment_id)) m left join (select metric_key as tk, * exclude(metric_key) from targets) t on tk=metric_key""")
cte("eval1", """select experiment_id, metric_key, value, units, source, source_pos, row_key, field_pos, status, case when status in ('below_target','above_target') then tprio else 99 end as priority,
 case status when 'below_target' then glow when 'above_target' then ghigh else '' end as guidance, case status when 'below_target' then slow when 'above_target' then shigh else '' end as signals from eval0""")
QUERIES["target_evaluation"] = query("select experiment_id, metric_key, value, units, source, row_key, status, priority, guidance, signals from eval1")
cte("limiting", "select * from (select *, row_number() over (partition by experiment_id order by priority, metric_key, source_pos, row_key, field_pos) as rank from eval1 where status in ('below_target','above_target'))")
QUERIES["limiting_metrics"] = query("select experiment_id, rank, metric_key, value, units, status from limiting where rank<=3")


def kv(table: str, prefix: str = "") -> str:
    return "||' '||".join(f"'{c} '||{prefix}{c}" for c in TABLES[table].columns)


def signal_rows(source: str, expr: str, rules: dict) -> str:
    return " union all ".join(f"select experiment_id, '{s}' as signal from (select *, lower({expr}) as txt from {source}) where {contains('txt', v)}" for s, v in rules.items())


cte("qual", "select distinct * from (" + signal_rows("v_daily_log", "observation||' '||issue_tags", QUALITATIVE_SIGNALS) + ")")
_rt = "lower(measurement_type)"
_rv = n_strict("value")
cte("sig_entry", "select distinct * from (" + " union all ".join([
    signal_rows("v_experiments", "process_type||' '||objective||' '||hypothesis", ENTRY_TEXT_SIGNALS),
    signal_rows("v_daily_log", kv("daily_log"), ENTRY_TEXT_SIGNALS),
    signal_rows("v_results", kv("results"), ENTRY_TEXT_SIGNALS),
    signal_rows("v_formulations", kv("formulations"), ENTRY_TEXT_SIGNALS),
    signal_rows("(select experiment_id, r.* from v_formulations f join (select * from reagent_last) r using (reagent_id))", kv("reagents"), ENTRY_TEXT_SIGNALS),
    "select experiment_id, trim(x) from (select experiment_id, unnest(string_split(lower(issue_tags),',')) as x from v_daily_log) where trim(x)<>''",
    f"select experiment_id, 'particle_size_high' from v_daily_log where {n_strict('particle_size_nm')}>350",
    f"select experiment_id, 'low_conversion' from v_daily_log where {n_strict('conversion_percent')}<85",
    f"select experiment_id, 'particle_size_high' from v_results where {contains(_rt, ['particle', 'dls'])} and {_rv}>350",
    f"select experiment_id, 'low_conversion' from v_results where contains({_rt},'conversion') and {_rv}<85",
    f"select experiment_id, unnest(['residual_monomer_high','low_conversion']) from v_results where contains({_rt},'residual') and contains({_rt},'monomer') and {_rv}>1",
    f"select experiment_id, 'broad_psd' from v_results where {contains(_rt, ['polydispersity', 'pdi'])} and {_rv}>0.2",
]) + ") where experiment_id in (select experiment_id from v_experiments)")
cte("sig", "select * from sig_entry union select * from qual where experiment_id in (select experiment_id from v_experiments) "
    "union select experiment_id, unnest(string_split(signals,' | ')) from eval1 where signals<>''")
QUERIES["experiment_signals"] = query("select * from sig")

cte("ra0", f"""select e.experiment_id, e.process_type, {EMULSION} as emulsion, coalesce(c.n,0) as n, coalesce(c.k,0) as k, coalesce(c.coag,0) as coag,
 q.quals, s.sigs, g.guides, l.limits from v_experiments e
 left join (select experiment_id, count(*) as n, count(case when status in ('below_target','above_target') then 1 end) as k,
   count(case when metric_key='coagulum_mass' and status='above_target' then 1 end) as coag from eval1 group by 1) c using (experiment_id)
 left join (select experiment_id, list_sort(list(signal)) as quals from qual group by 1) q using (experiment_id)
 left join (select experiment_id, list_sort(list(distinct signal)) as sigs from (select * from qual union all select experiment_id, unnest(string_split(signals,' | ')) from eval1 where signals<>'') group by 1) s using (experiment_id)
 left join (select experiment_id, string_agg(guidance,' | ' order by p) as guides from (select experiment_id, guidance, min(rank) as p from limiting where guidance<>'' group by 1,2) group by 1) g using (experiment_id)
 left join (select experiment_id, string_agg(trim(metric_key||' '||{fmt6('value')}||' '||units)||' is '||status,'; ' order by rank) as limits from limiting where rank<=3 group by 1) l using (experiment_id)""")
cte("ra1", f"""select experiment_id, process_type, case when emulsion then 'emulsion polymerization' else '' end as target_profile, n as measurement_count, k as limiting_count,
 coalesce(array_to_string(sigs,' | '),'') as signals,
 case when n=0 then {lit(NO_MEASUREMENTS)} when not emulsion then {lit(NO_TARGETS)} else coalesce(nullif(concat_ws(' | ', guides,
   case when list_contains(quals,'coagulum') and coag=0 then {lit(QUALITATIVE_COAGULUM)} end),''), {lit(IN_TARGET)}) end as guidance,
 case when n=0 then 'No numeric Results or structured Daily Log measurements were available for target comparison.'
  when k>0 then 'Outcome limits: '||limits||'.'
  when quals is not null then 'Numeric measurements were in target where targets exist, but qualitative signals remain: '||array_to_string(quals,', ')||'.'
  else 'Numeric measurements are within the first-pass target profile where targets exist.' end as summary from ra0""")
QUERIES["result_analysis"] = query("select * from ra1")
cte("cur", f"select experiment_id, metric_key, arg_min(v,row_key) as value from (select *, {n_strict('value')} as v, {metric_key('mt')} as metric_key from (select *, lower(measurement_type||' '||units) as mt from v_results)) where v is not null and metric_key<>'' group by 1,2")
QUERIES["current_metrics"] = query("select * from cur")

# -- history: every run against every other run of its process, the direct way --
cte("h_exp", "select experiment_id, row_key, date, lower(trim(process_type)) as p, lower(trim(status)) as s from v_experiments")
cte("h_top", """select p, experiment_id, date, row_key from (select *, row_number() over (partition by p order by date desc, row_key) as rn from h_exp where s<>'abandoned' and p<>'') where rn<=6
 union all select '', experiment_id, date, row_key from (select *, row_number() over (order by date desc, row_key) as rn from h_exp where s<>'abandoned') where rn<=6""")
cte("h_prior", """select * from (select e.experiment_id, h.experiment_id as prior_id, row_number() over (partition by e.experiment_id order by h.date desc, h.row_key) as rk
 from h_exp e join h_top h on h.p=e.p and h.experiment_id<>e.experiment_id) where rk<=5""")
cte("h_meas", f"select p.experiment_id, p.prior_id, p.rk, m.metric_key, m.v, m.units, m.row_key from h_prior p join (select *, {n_strict('value')} as v, {metric_key('mt')} as metric_key from (select *, lower(measurement_type||' '||units) as mt from v_results)) m on m.experiment_id=p.prior_id where m.v is not null and m.metric_key<>''")
cte("h_bench", f"""select experiment_id, metric_key, count(*) as count, arg_min(units,(v,rk,row_key)) as units, {fmt6('min(v)')} as min, arg_min(prior_id,(v,rk,row_key)) as min_experiment_id,
 {fmt6('max(v)')} as max, arg_min(prior_id,(-v,rk,row_key)) as max_experiment_id, {fmt6('cast(sum(cast(v as decimal(28,12))) as double)/count(*)')} as average from h_meas group by 1,2""")
QUERIES["history_benchmarks"] = query("select * from h_bench")
cte("h_guide", f"""select e.experiment_id, coalesce(p.n,0) as prior_experiment_count, case when p.n is null then '' else coalesce(g.g, {lit(HISTORY_CONTROL)}) end as guidance from v_experiments e
 left join (select experiment_id, count(*) as n from h_prior group by 1) p using (experiment_id)
 left join (select experiment_id, string_agg(line,' | ' order by o) as g from (
  select experiment_id, 1 as o, 'Prior experiment '||min_experiment_id||' reached lower particle size ('||min||' '||units||'); compare surfactant/feed conditions before changing monomers.' as line from h_bench join cur using (experiment_id, metric_key) where metric_key='particle_size' and cast(min as double)<value
  union all select experiment_id, 2, 'Prior experiment '||max_experiment_id||' reached higher conversion ('||max||' '||units||'); check initiator, purge, and hold conditions.' from h_bench join cur using (experiment_id, metric_key) where metric_key='conversion' and cast(max as double)>value
  union all select experiment_id, 3, 'Prior experiment '||min_experiment_id||' had lower coagulum ('||min||' '||units||'); preserve known-good stability variables as controls.' from h_bench join cur using (experiment_id, metric_key) where metric_key='coagulum_mass' and cast(min as double)<value
 ) group by 1) g using (experiment_id)""")
QUERIES["history_guidance"] = query("select * from h_guide")
