"""Checks: follow-ups, plans, recommendation, gates, review."""

from assayframe.contract import TABLES
from assayframe.functions.metrics import PREDICTION_METRICS
from assayframe.plans.agent import CONFIG_TYPES, MESSAGES
from assayframe.rules import LITERATURE_ADVICE, SAFETY_APPROVED, SAFETY_FAILED
from assayframe.texts import (
    ADJUST, ARMS, CHANGES_START, COPIED_ROW, EXPECTED_START, FACTORS, FOCUS, GENERIC_CHANGE, GENERIC_EFFECT,
    NO_ARM_CHANGE, RATIONALE_START, SAFETY_REMINDER, SCAFFOLD_FIRST,
)

from . import writes  # noqa: F401  (defines CTEs used below)
from .base import CTES, cte, lit, query
from .core import EMULSION, RF, contains, fmt6, inlist, n_first, n_strict, prediction_key, quantities
from .outcomes import kv
from .retrieval import WORD, tf, top

QUERIES: dict[str, str] = {}

# -- follow-up ids and adjustments --------------------------------------------
FUP = "'^(.*)-FUP-(\\d+)$'"
cte("fup_used", f"""select regexp_extract(id,{FUP},1) as experiment_id, try_cast(regexp_extract(id,{FUP},2) as bigint) as n from (select experiment_id as id from v_experiments)
 union all select experiment_id, try_cast(regexp_extract(id,{FUP},2) as bigint) from (select experiment_id, case when proposed_experiment_id<>'' then proposed_experiment_id
   when json_valid(proposed_plan_json) then coalesce(json_extract_string(proposed_plan_json,'$.suggested_experiment_id'),'') else '' end as id from v_suggestions) where regexp_extract(id,{FUP},1)=experiment_id""")
cte("fup", "select e.experiment_id, e.experiment_id||'-FUP-'||lpad(cast(coalesce(max(u.n),0)+1 as varchar),3,'0') as suggested_experiment_id from v_experiments e left join fup_used u using (experiment_id) group by 1")
QUERIES["next_followup_id"] = query("select * from fup")
cte("flags0", """select experiment_id, bool_or(signal in ('particle_size_high','broad_psd')) as particle, bool_or(signal in ('coagulum','instability')) as stability,
 bool_or(signal='low_conversion') as conversion, bool_or(signal in ('coagulum','particle_size_high')) as strong, true as any_signal from sig group by 1""")
cte("flags", f"""select e.experiment_id, {EMULSION} as emulsion, coalesce(particle,false) as particle, coalesce(stability,false) as stability, coalesce(conversion,false) as conversion, coalesce(strong,false) as strong, coalesce(any_signal,false) as any_signal
 from v_experiments e left join flags0 using (experiment_id)""")
_roles = {"s": ["surfactant"], "m": ["core_monomer", "shell_monomer", "comonomer", "monomer"], "i": ["initiator"]}
cte("first_rows", "select experiment_id, " + ", ".join(
    f"min(row_key) filter (lower(trim(target_role)) in {inlist(r)} or coalesce(lower(trim(reagent_category)),'') in {inlist(r)}) as {k}" for k, r in _roles.items()) + " from enriched group by 1")
cte("basis", f"""select experiment_id, row_key, case when {n_strict('mass_g')} is not null then 'mass_g' when {n_strict('moles_mmol')} is not null then 'moles_mmol' when {n_strict('volume_mL')} is not null then 'volume_mL'
 when {n_strict('wt_percent')} is not null then 'wt_percent' end as field, coalesce({n_strict('mass_g')},{n_strict('moles_mmol')},{n_strict('volume_mL')},{n_strict('wt_percent')}) as v,
 case when {n_strict('mass_g')} is not null then mass_g when {n_strict('moles_mmol')} is not null then moles_mmol when {n_strict('volume_mL')} is not null then volume_mL else wt_percent end as txt from v_formulations""")
cte("fed", "select distinct experiment_id from (select experiment_id, unnest(tags) as tag from ev_tags) where tag='feed'")


def adjustments(name: str, fed: str) -> None:
    g = lambda al: f"{al}.row_key, {al}.reagent_id, {al}.target_role"
    cte(name, f"""select f.experiment_id, 0 as adjust_pos, {g('r')}, b.field, b.txt as parent_value, printf('%g', b.v*1.15) as proposed_value, 1.15::double as scale_factor, {lit(ADJUST['basis'])} as rationale
 from flags f join first_rows x using (experiment_id) join basis b on b.experiment_id=f.experiment_id and b.row_key=x.s join v_formulations r on r.experiment_id=f.experiment_id and r.row_key=x.s where f.emulsion and f.particle and b.field is not null
 union all select f.experiment_id, 0, {g('r')}, 'feed_duration_min', r.feed_duration_min, printf('%g', {n_strict('r.feed_duration_min')}*1.25), 1.25, {lit(ADJUST['feed'])}||case when {fed} then {lit(ADJUST['feed_evidence'])} else '' end
 from flags f join first_rows x using (experiment_id) join v_formulations r on r.experiment_id=f.experiment_id and r.row_key=x.m left join basis b on b.experiment_id=f.experiment_id and b.row_key=x.s where f.emulsion and f.particle and b.field is null and {n_strict('r.feed_duration_min')} is not null
 union all select f.experiment_id, 0, {g('r')}, 'notes', r.notes, {lit(ADJUST['no_number'])}, null, {lit(ADJUST['no_number'])}
 from flags f join first_rows x using (experiment_id) join v_formulations r on r.experiment_id=f.experiment_id and r.row_key=x.s left join v_formulations m on m.experiment_id=f.experiment_id and m.row_key=x.m join basis b on b.experiment_id=f.experiment_id and b.row_key=x.s
  where f.emulsion and f.particle and b.field is null and {n_strict("coalesce(m.feed_duration_min,'')")} is null
 union all select f.experiment_id, 1, {g('r')}, 'notes', r.notes, {lit(ADJUST['package'])}, null, {lit(ADJUST['package'])} from flags f join first_rows x using (experiment_id) join v_formulations r on r.experiment_id=f.experiment_id and r.row_key=x.s where f.emulsion and f.stability
 union all select f.experiment_id, 2, {g('r')}, 'notes', r.notes, {lit(ADJUST['initiator'])}, null, {lit(ADJUST['initiator'])} from flags f join first_rows x using (experiment_id) join v_formulations r on r.experiment_id=f.experiment_id and r.row_key=x.i where f.emulsion and f.conversion""")


adjustments("adj", "f.experiment_id in (select experiment_id from fed)")
adjustments("adj_plain", "false")
QUERIES["followup_adjustments"] = query("select * from adj")
_Q = ("mass_g", "volume_mL", "moles_mmol", "wt_percent")
cte("pr0", f"""select f.*, u.suggested_experiment_id, concat_ws(', ', '{FACTORS['always']}', case when particle then '{FACTORS['particle']}' end, case when stability then '{FACTORS['stability']}' end, case when conversion then '{FACTORS['conversion']}' end,
 case when not particle and not stability and not conversion then '{FACTORS['none']}' end) as factors,
 (select any_value(a.field) from adj_plain a where a.experiment_id=f.experiment_id and a.row_key=f.row_key and a.field<>'notes') as ch_field,
 (select any_value(a.parent_value) from adj_plain a where a.experiment_id=f.experiment_id and a.row_key=f.row_key and a.field<>'notes') as ch_old,
 (select any_value(a.proposed_value) from adj_plain a where a.experiment_id=f.experiment_id and a.row_key=f.row_key and a.field<>'notes') as ch_new,
 (select string_agg('Review note: '||a.proposed_value,' ' order by a.adjust_pos) from adj_plain a where a.experiment_id=f.experiment_id and a.row_key=f.row_key and a.field='notes') as reviews
 from v_formulations f join flags g using (experiment_id) join fup u using (experiment_id) where g.emulsion and trim(f.reagent_id)<>'' and trim(f.target_role)<>''""")
cte("pr1", f"select *, coalesce(ch_field in {inlist(_Q)}, false) as scaled from pr0")
_clear = "concat_ws(', ', " + ", ".join(f"case when scaled and ch_field<>'{f}' and trim({f})<>'' then '{f}' end" for f in _Q) + ")"
PLAN_ROWS = ("select experiment_id as parent_experiment_id, suggested_experiment_id as experiment_id, row_key, reagent_id, phase, target_role, "
    + ", ".join(f"case when ch_field='{f}' then ch_new when scaled then '' else {f} end as \"{f}\"" for f in _Q)
    + f", feed_order, case when ch_field='feed_duration_min' then ch_new else feed_duration_min end as feed_duration_min, concat_ws(' ', {lit(COPIED_ROW)}, 'Planned variables: '||factors||'.', "
      "case when ch_field is not null then 'Applied planned adjustments: '||ch_field||' '||ch_old||' -> '||ch_new||'.' end, reviews, "
      f"case when {_clear}<>'' then 'Cleared dependent quantity fields after adjusted basis: '||{_clear}||'.' end, case when trim(notes)<>'' then 'Parent notes: '||trim(notes) end) as notes from pr1")
QUERIES["plan_rows"] = query(PLAN_ROWS)

# -- plans --------------------------------------------------------------------
cte("pl", """select row_key, suggestion_id, experiment_id, status, json_valid(proposed_plan_json) as has_plan, case when json_valid(proposed_plan_json) then proposed_plan_json::json end as j,
 coalesce(nullif(proposed_experiment_id,''), nullif(case when json_valid(proposed_plan_json) then json_extract_string(proposed_plan_json,'$.suggested_experiment_id') end,''), experiment_id||'-FUP-001') as pid from v_suggestions""")
QUERIES["plan_roundtrip"] = query("select suggestion_id, has_plan, pid as planned_id, json_extract_string(j,'$.objective') as objective, array_to_string(json_extract_string(j,'$.measurements[*]'),',') as measurements, case when has_plan then true end as same from pl"
                                  .replace("array_to_string(json_extract_string(j,'$.measurements[*]'),',')", "nullif(array_to_string(json_extract_string(j,'$.measurements[*]'),','),'')"))
cte("pa", "select * from pl where status='accepted' and has_plan")
cte("pe", """select suggestion_id, row_key||'|000000' as row_key, pid as experiment_id, '2026-07-01' as date, coalesce(json_extract_string(j,'$.process_type'),'') as process_type,
 coalesce(json_extract_string(j,'$.sheet_rows.experiments[0].objective'), json_extract_string(j,'$.objective'), '') as objective, coalesce(array_to_string(json_extract_string(j,'$.linked_evidence_ids[*]'),','),'') as ids, 'planned' as status,
 'Review accepted suggestion '||suggestion_id||' before running.' as step from pa""")
cte("pf0", "select suggestion_id, pid, row_key as srk, unnest(cast(json_extract(j,'$.sheet_rows.formulations') as json[])) as r, generate_subscripts(cast(json_extract(j,'$.sheet_rows.formulations') as json[]),1)-1 as pos from pa where json_extract(j,'$.sheet_rows.formulations') is not null")
cte("pf1", """select suggestion_id, srk||'|'||lpad(cast(pos as varchar),6,'0') as row_key, pid as experiment_id, coalesce(json_extract_string(r,'$.reagent_id'),'') as reagent_id, coalesce(json_extract_string(r,'$.target_role'),'') as target_role,
 coalesce(json_extract_string(r,'$.mass_g'),'') as mass_g, coalesce(json_extract_string(r,'$.volume_mL'),'') as "volume_mL", '' as moles_mmol, '' as wt_percent from pf0""")
cte("pf2", "select f.*, coalesce(r.concentration,'') as concentration, coalesce(r.concentration_units,'') as concentration_units, " + ", ".join(f"r.{c} as reagent_{c}" for c in RF)
    + ", r.reagent_id is not null as has_reagent from pf1 f left join reagent_last r using (reagent_id)")
quantities("pq", "pf2", "suggestion_id")
_g = lambda f, d: f"(has_reagent and trim({f})='' and {d} is not null)"
cte("pf3", f"""select *, case when {_g('mass_g','dm')} then {fmt6('dm')} else mass_g end as m_new, case when {_g('volume_mL','dv')} then {fmt6('dv')} else "volume_mL" end as v_new, case when {_g('moles_mmol','dn')} then {fmt6('dn')} else moles_mmol end as n_new,
 concat_ws(', ', case when {_g('mass_g','dm')} then 'mass_g' end, case when {_g('volume_mL','dv')} then 'volume_mL' end, case when {_g('moles_mmol','dn')} then 'moles_mmol' end) as got from pq7""")
cte("pf4", f"select *, {n_first('m_new')} as mm from pf3")
cte("pf5", """select *, case when mm>0 and count(case when mm>0 then 1 end) over (partition by suggestion_id, experiment_id)>=2 then mm/cast(sum(case when mm>0 then cast(mm as decimal(28,12)) end) over (partition by suggestion_id, experiment_id) as double)*100 end as wt from pf4""")
cte("pf6", f"""select suggestion_id, row_key, experiment_id, reagent_id, target_role, m_new, v_new, n_new, coalesce({fmt6('wt')},'') as w_new, concentration,
 concat_ws(' ', 'Draft formulation row from accepted suggestion '||suggestion_id||'.', case when got<>'' then 'Derived missing quantity cells during materialization: '||got||'. Verify before running.' end,
  case when wt is not null then 'Derived wt_percent during materialization from planned formulation mass total. Verify before running.' end) as notes from pf5""")
cte("ps0", "select suggestion_id, pid, row_key as srk, unnest(case when json_extract(j,'$.sheet_rows.results_to_capture') is not null then cast(json_extract(j,'$.sheet_rows.results_to_capture') as json[]) else cast(json_extract(j,'$.measurements') as json[]) end) as r, "
    "generate_subscripts(case when json_extract(j,'$.sheet_rows.results_to_capture') is not null then cast(json_extract(j,'$.sheet_rows.results_to_capture') as json[]) else cast(json_extract(j,'$.measurements') as json[]) end,1) as pos from pa")
cte("ps1", "select suggestion_id, srk||'|'||lpad(cast(pos-1 as varchar),6,'0') as row_key, pid as experiment_id, pid||'-PLAN-'||lpad(cast(pos as varchar),2,'0') as sample_id, coalesce(json_extract_string(r,'$.measurement_type'), json_extract_string(r,'$')) as mt, coalesce(json_extract_string(r,'$.units'),'') as units from ps0")


def fresh(src: str, key: str, have: str) -> str:
    return f"select * from (select *, first_value(suggestion_id) over (partition by {key} order by row_key) as owner from {src} where ({key}) not in (select {key} from {have})) where owner=suggestion_id"


cte("pe_new", fresh("pe", "experiment_id", "v_experiments"))
cte("pf_new", fresh("pf6", "experiment_id, reagent_id, target_role", "v_formulations"))
cte("ps_new", fresh("(select *, mt as measurement_type from ps1)", "experiment_id, sample_id, measurement_type", "v_results"))
QUERIES["plan_materialize"] = query("""select 'Experiments' as table_name, suggestion_id, row_key, experiment_id, concat_ws(' | ', date, process_type, objective, ids, status, step) as cells from pe_new
 union all select 'Formulations', suggestion_id, row_key, experiment_id, concat_ws(' | ', reagent_id, target_role, m_new, v_new, n_new, w_new, concentration, notes) from pf_new
 union all select 'Results', suggestion_id, row_key, experiment_id, concat_ws(' | ', sample_id, mt, units, 'planned capture', 'planned', 'Planned capture from suggestion '||suggestion_id||'.') from ps_new""")
cte("pr_runs", """select p.suggestion_id, case when has_plan then pid else '' end as experiment_id, has_plan, coalesce(e.n,0) as experiments_rows, coalesce(f.n,0) as formulations_rows, coalesce(s.n,0) as results_rows from pl p
 left join (select suggestion_id, count(*) as n from pe_new group by 1) e using (suggestion_id) left join (select suggestion_id, count(*) as n from pf_new group by 1) f using (suggestion_id) left join (select suggestion_id, count(*) as n from ps_new group by 1) s using (suggestion_id) where p.status='accepted'""")
_why = "case when not has_plan then 'missing_proposed_plan_json' when experiments_rows+formulations_rows+results_rows=0 then 'planned_rows_already_exist' else '' end"
QUERIES["plan_runs"] = query(f"select *, {_why} as skip_reason, case when {_why}='' then 'ready' else 'skipped' end as status from pr_runs")

# -- configuration ------------------------------------------------------------
_type = "case key " + " ".join(f"when '{k}' then '{v}'" for k, v in CONFIG_TYPES.items()) + " end"
cte("cf0", f"select key, {_type} as type, trim(value) as value from config1 where key in {inlist(CONFIG_TYPES)}")
cte("cf1", """select *, case when value='' then null when type='string' then value when type='nonnegative_int' then case when regexp_matches(value,'^\\+?\\d+$') then cast(try_cast(value as bigint) as varchar) end
 when type='confidence' then case when lower(value) in ('low','medium','high') then lower(value) end when lower(value) in ('true','1','yes','on') then 'true' when lower(value) in ('false','0','no','off') then 'false' end as parsed from cf0""")
QUERIES["config_parse"] = query(f"select key, type, value, parsed, case when value='' then {lit(MESSAGES['blank'])} when parsed is null then case type " + " ".join(f"when '{k}' then {lit(v)}" for k, v in MESSAGES.items() if k != "blank") + " end else '' end as warning from cf1")

# -- recommendation -----------------------------------------------------------
cte("kd", f"select row_key as doc_id, {kv('knowledge')} as text, guidance from v_knowledge")
tf("kd_t", "kd", "doc_id")
cte("kd_idf", "select token, ln(((select count(*) from kd)+1.0)/(count(*)+1.0))+1 as idf from kd_t group by token")
cte("kd_w", "select doc_id, token, n::double/total*idf as w from kd_t join kd_idf using (token)")
cte("ek_t", f"select experiment_id, token, count(*) as n, sum(count(*)) over (partition by experiment_id) as total from (select experiment_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) as token from entry_text) group by 1,2")
cte("ek_w", "select experiment_id, token, n::double/total*coalesce(idf,1.0) as w from ek_t left join kd_idf using (token)")
cte("ek_s", """select experiment_id, doc_id, dot/(dn*qn) as score from (select q.experiment_id, d.doc_id, sum(q.w*d.w) as dot from ek_w q join kd_w d using (token) group by 1,2)
 join (select doc_id, sqrt(sum(w*w)) as dn from kd_w group by 1) using (doc_id) join (select experiment_id, sqrt(sum(w*w)) as qn from ek_w group by 1) using (experiment_id)""")
cte("ek", top("(select s.*, kd.guidance from ek_s s join kd using (doc_id) where score>0)", "experiment_id", "round(score,9) desc, doc_id", 1))
cte("lc_ids", "select experiment_id, list(evidence_id order by rank) as ids from ev_sel group by 1")
cte("lc_n", "select experiment_id, tag, count(*) as n from (select s.experiment_id, unnest(v.tags) as tag from ev_sel s join ev_tags v using (experiment_id, evidence_id)) group by 1,2")
cte("lc_t", "select experiment_id, list(tag order by n desc, tag) as tags, 'Linked literature tags emphasize '||string_agg(tag||' ('||n||')',', ' order by n desc, tag) filter (rk<=5)||'.' as lsum from (select *, row_number() over (partition by experiment_id order by n desc, tag) as rk from lc_n) group by 1")
_w = "(particle or stability)"
cte("rc0", f"""select e.experiment_id, e.objective, f.*  exclude (experiment_id), u.suggested_experiment_id, a.missing_required, a.quantity_gaps, a.recommendations, a.summary as msum, r.summary as rsum, r.guidance as rguide, h.prior_experiment_count, h.guidance as hguide,
 coalesce(l.ids,[]) as ids, coalesce(t.tags,[]) as tags, t.lsum, k.guidance as know, case when not f.emulsion then 'generic' when conversion and not {_w} then 'conversion' when conversion then 'conversion_and_stability' when {_w} then 'stability' else 'baseline' end as focus
 from v_experiments e join flags f using (experiment_id) join fup u using (experiment_id) join audit3 a using (experiment_id) join ra1 r using (experiment_id) join h_guide h using (experiment_id)
 left join lc_ids l using (experiment_id) left join lc_t t using (experiment_id) left join ek k using (experiment_id)""")
_has = lambda x: f"list_contains(tags,'{x}')"
cte("rc1", f"""select *, list_filter([case when {_has('surfactant')} and ({_has('particle_size')} or {_has('stability')}) then {lit(LITERATURE_ADVICE['surfactant'])} end, """
    + ", ".join(f"case when {_has(k)} then {lit(LITERATURE_ADVICE[k])} end" for k in ("feed", "initiator", "monomer")) + "], lambda x: x is not null) as advice from rc0")
_arm = lambda i: ", ".join(f"case when {c} then {lit(ARMS[c][i])} end" for c in ("particle", "stability", "conversion"))
_base = "case focus " + " ".join(f"when '{k}' then {lit(v['base'])}" for k, v in FOCUS.items()) + " end"
cte("rc2", f"""select experiment_id, suggested_experiment_id, focus, case when (know is not null and any_signal) or strong or len(ids)>0 then 'medium' else 'low' end as confidence,
 case when emulsion then concat_ws(' ', {_base}, {', '.join(lit(x) for x in CHANGES_START)}, {_arm(0)}, case when not particle and not stability and not conversion then {lit(NO_ARM_CHANGE)} end,
   case when missing_required<>'' or quantity_gaps>0 then {lit(SCAFFOLD_FIRST)}||replace(recommendations,' | ',' ') end) else {lit(GENERIC_CHANGE)} end as proposed_change,
 case when emulsion then concat_ws(' ', {lit(EXPECTED_START)}, {_arm(2)}) else {lit(GENERIC_EFFECT)} end as expected_effect,
 concat_ws(' ', case when emulsion then concat_ws(' ', {lit(RATIONALE_START)}, {_arm(1)}, nullif(array_to_string(list_transform(advice[1:2], lambda x: 'Literature guidance: '||x),' '),''), 'Top local knowledge match: '||nullif(know,''))
   else trim('Use the current result to isolate one variable related to '||objective||'. '||coalesce(know,'No strong process match was found.')||' '||array_to_string(advice[1:1],' ')) end,
   'Result analysis: '||rsum, array_to_string(list_transform(string_split(rguide,' | ')[1:2], lambda x: 'Result guidance: '||x),' '), 'Material audit: '||msum,
   case when hguide<>'' then 'Notebook history: '||array_to_string(string_split(hguide,' | ')[1:2],' ') end,
   case when len(ids)>0 then 'Literature Evidence rows '||array_to_string(ids[1:5],', ')||' are linked for human review before execution.' end, case when len(ids)>0 then lsum end) as rationale,
 array_to_string(ids,',') as linked_evidence_ids, {lit(SAFETY_REMINDER)} as safety_check, prior_experiment_count from rc1""")
QUERIES["recommendation"] = query("select * from rc2")

# -- gates and predictions ----------------------------------------------------
cte("evn", "select experiment_id, count(*) as n from ev_sel group by 1")


def gates(name: str, require: bool, floor: int) -> None:
    req = "coalesce(v.n,0)=0" if require else "false"
    r = (f"case when p.sug>0 then 'existing_suggestion' when {req} then 'literature_evidence_required' "
         f"when case c.confidence when 'low' then 1 when 'medium' then 2 else 0 end<{floor} then 'suggestion_confidence_below_floor' else '' end")
    cte(name, f"""select p.experiment_id, case when {r}='' then 'ready' else 'skipped' end as status, {r} as skip_reason, coalesce(c.confidence,'') as confidence, coalesce(v.n,0) as evidence_count
 from act_sel s join pre0 p using (experiment_id) join rc2 c using (experiment_id) left join evn v using (experiment_id)""")


gates("gate_m", True, 2)
gates("gate_l", False, 1)
QUERIES["agent_gates"] = query("select * from gate_m")
_low = "lower(trim(safety_check))"
QUERIES["safety_gate"] = query(f"select suggestion_id, case when {_low}='' then 'missing' when {contains(_low, SAFETY_FAILED)} then 'failed' when {contains(_low, SAFETY_APPROVED)} then 'approved' else 'reminder' end as safety from v_suggestions")
_pk = prediction_key("lower(measurement_type||' '||method||' '||units||' '||condition)")
cte("rm0", f"select experiment_id, list(distinct k) as ks from (select experiment_id, {_pk} as k from v_results) group by 1")
_mk = sorted(PREDICTION_METRICS)
cte("rm1", f"""select e.experiment_id, concat_ws(',', {', '.join(f"case when list_contains(ks,'{m}') then '{m}' end" for m in _mk)}) as present_metrics,
 concat_ws(', ', {', '.join(f"case when not list_contains(ks,'{m}') then {lit(v)} end" for m, v in PREDICTION_METRICS.items())}) as missing_metrics
 from (select e.experiment_id, coalesce(r.ks,['']) as ks from v_experiments e left join rm0 r using (experiment_id) where {EMULSION}) e""")
QUERIES["required_metric_gaps"] = query("select * from rm1 where missing_metrics<>''")
_hasg = "skip_reason not in ('existing_suggestion','literature_evidence_required')"
cte("gaps", f"""select distinct * from (select experiment_id, 'suggestion_missing' as code, 'error' as severity, 'prediction' as blocks from gate_l where not ({_hasg})
 union all select experiment_id, 'literature_evidence_missing', 'error', 'prediction' from gate_l where {_hasg} and evidence_count=0
 union all select experiment_id, 'safety_review_required', 'error', 'prediction' from gate_l where {_hasg}
 union all select g.experiment_id, 'historical_benchmarks_missing', 'info', 'review' from gate_l g join rc2 using (experiment_id) where {_hasg} and prior_experiment_count=0
 union all select experiment_id, 'result_metrics_missing', 'warning', 'review' from rm1 where missing_metrics<>'' and experiment_id in (select experiment_id from gate_l where {_hasg})
 union all select p.experiment_id, "check"||'_missing', case when p.status='warn' then 'warning' else 'error' end, case when p.status='fail' then 'execution' else 'review' end from pre_review p join gate_l g using (experiment_id)
  where p.status<>'pass' and not ("check"='literature_evidence' and g.evidence_count>0 and g.skip_reason<>'existing_suggestion'))""")
QUERIES["prediction_gaps"] = query("select * from gaps")
QUERIES["prediction_summary"] = query("""select case when g.status<>'ready' or coalesce(b.b,0)>0 then 'blocked' when coalesce(b.n,0)>0 then 'predicted_with_gaps' else 'predicted' end as prediction_status, count(*) as predictions,
 sum(coalesce(b.n,0))::bigint as gap_count, sum(coalesce(b.b,0))::bigint as blocker_count from gate_l g left join (select experiment_id, count(*) as n, count(case when blocks='prediction' then 1 end) as b from gaps group by 1) b using (experiment_id) group by 1""")

# -- pending writes, experiment updates, review -------------------------------
cte("pend", """select experiment_id, sum(case when k='r' then n else 0 end)::bigint as results, sum(case when k='f' then n else 0 end)::bigint as formulation_cells, sum(case when k='e' then n else 0 end)::bigint as evidence, sum(case when k='s' then n else 0 end)::bigint as suggestions from (
 select experiment_id, 'r' as k, count(*) as n from log_results group by 1 union all select experiment_id, 'f', count(*) from updates group by 1 union all select experiment_id, 'e', least(count(*),3) from ev_rows group by 1 union all select experiment_id, 's', count(*) from sug_open group by 1) group by 1""")
QUERIES["pending_writes"] = query("select * from pend")
cte("eu0", """select e.experiment_id, e.status as s, e.planned_next_step as p, e.summary as y, q.obs, q.res, r.fail_count as fc, r.warn_count as wc, string_split(r.next_actions,' | ')[1] as act, coalesce(w.results,0) as wr, coalesce(w.formulation_cells,0) as wf, coalesce(w.evidence,0) as we, coalesce(w.suggestions,0) as ws
 from act_sel x join v_experiments e using (experiment_id) join pre0 q using (experiment_id) join pre_sum_review r using (experiment_id) left join pend w using (experiment_id)""")
cte("eu1", """select *, case when lower(trim(s))='abandoned' then '' when fc>0 or wr+wf+we+ws>0 or wc>0 then 'needs_review' when obs+res>0 then 'complete' else '' end as s2,
 case when fc>0 then act when ws>0 then 'Review draft Agent Suggestions and set status to accepted or rejected before materialization.' when wr>0 then 'Review normalized Daily Log measurements in Results.'
  when wf>0 then 'Review normalized Formulations quantities before relying on follow-up calculations.' when we>0 then 'Review appended Literature Evidence before relying on it.' else act end as p2,
 'Daily review 2024-01-05: '||obs||' observations; '||res||' existing Results rows; '||wr||' normalized Results pending; '||wf||' normalized Formulations pending; '||we||' evidence rows pending; '||ws||' suggestion rows pending; '||fc||' preflight failures.' as y2 from eu0""")
QUERIES["experiment_updates"] = query("select * from (select experiment_id, 'status' as field, s2 as value from eu1 where s2<>trim(s) union all select experiment_id, 'planned_next_step', p2 from eu1 where p2<>trim(p) union all select experiment_id, 'summary', y2 from eu1 where y2<>trim(y)) where value<>''")
_day = lambda name, more="": CTES[name].replace("from log_m", "from dr_m").replace("log_cand", "dr_cand").replace("log_fresh", "dr_fresh").replace("log_walk", "dr_walk") + more
cte("dr_m", "select * from log_m where starts_with(timestamp,'2024-01-05') and experiment_id in (select experiment_id from ctx_sel)")
for _n in ("cand", "fresh", "walk", "results"):
    cte(f"dr_{_n}", _day(f"log_{_n}"), recursive=_n == "walk")
cte("dr", """select sum(('0x'||left(md5(x.experiment_id),15))::bigint)::varchar as sig, count(*) as n, sum(q.obs)::bigint as obs, sum(q.res)::bigint as res, sum(r.fail_count)::bigint as fc, sum(r.warn_count)::bigint as wc,
 (select count(*) from updates where experiment_id in (select experiment_id from ctx_sel)) as cells, (select count(*) from dr_results) as logs, (select count(*) from ev_rows where experiment_id in (select experiment_id from ctx_sel)) as ev,
 (select count(*) from v_suggestions where status='draft' and experiment_id in (select experiment_id from ctx_sel)) as sug,
 (select count(*) from sug_open where status='run_planned' and proposed_experiment_status='complete') as clo from ctx_sel x join pre0 q using (experiment_id) join pre_sum_review r using (experiment_id)""")
_act = [("logs", "Apply or review normalized Daily Log measurements in Results."), ("cells", "Apply or review normalized Formulations quantities before relying on follow-up calculations."),
        ("ev", "Review appended Literature Evidence rows before relying on them."), ("sug", "Review draft Agent Suggestions and set status to accepted or rejected."),
        ("clo", "Apply Agent Suggestions status updates for completed planned follow-ups.")]
_said = "concat_ws(',', " + ", ".join(f"case when {k}>0 then {lit(chr(34) + v + chr(34))} end" for k, v in _act) + ")"
QUERIES["daily_review"] = query(f"""select 'DRV-20240105-'||n||'x'||sig as review_id, '2026-06-10T08:00:00' as created_at, '2024-01-05' as review_date, n||'x'||sig as selected_experiment_ids,
 n as experiment_count, obs as observation_count, res as result_count, logs as normalized_result_rows_to_append, ev as evidence_rows_to_append, sug as suggestion_rows_to_append, fc as preflight_fail_count, wc as preflight_warn_count,
 case when fc>0 then 'needs_attention' when logs+cells+ev+sug+clo>0 then 'ready_to_apply' when wc>0 then 'ready_with_warnings' else 'no_action' end as status,
 n||' experiments; '||logs||' normalized Results rows; '||cells||' normalized Formulations cells; '||ev||' evidence rows; '||sug||' suggestion rows; '||clo||' suggestion status updates; '||fc||' preflight failures.' as summary,
 '['||case when {_said}='' then '"No notebook write actions were generated for this daily run."' else {_said} end||']' as next_actions_json from dr""")

# -- sources ------------------------------------------------------------------
QUERIES["scan_clean_rows"] = query("select row_key, case when process_stage='wait' then '' else process_stage end as process_stage, trim(issue_tags) as issue_tags, '' as experiment_id from v_daily_log where process_stage<>'wait' or trim(issue_tags)<>''")
QUERIES["snapshot_roundtrip"] = query("select experiment_id, date, process_type, objective, status from v_experiments")
QUERIES["works_scan"] = query("select work_id, title, source, len(authors)::integer as authors, array_to_string(concepts,',') as concepts from w1")
