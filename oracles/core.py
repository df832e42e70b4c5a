"""Checks: cells, formulations, selection, audits."""

from assayframe.contract import TABLES
from assayframe.rules import (
    CHECKS, MATERIAL_ADVICE, MOLES_GAP, PREFLIGHT_READY, QUANTITY_FIELDS, REQUIRED_GROUPS, ROLE_GROUPS, VOLUME_GAP,
)

from .base import cte, lit, query

QUERIES: dict[str, str] = {}
NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def num(x: str) -> str:
    return f"(case when regexp_matches({x}, '{NUM}') then try_cast({x} as double) end)"


def first(x: str) -> str:
    return f"regexp_extract({x}, '(\\S+)', 1)"


def n_first(x: str) -> str:
    return num(first(f"replace({x}, ',', '')"))


def n_strict(x: str) -> str:
    return num(f"trim({x})")


def n_token(x: str) -> str:
    return num(first(x))


def n_fraction(x: str) -> str:
    t = f"trim(replace({x}, ',', ''))"
    pct = num(f"trim(regexp_replace({t}, '%$', ''))")
    v = f"(case when {t} like '%\\%' escape '\\' then {pct}/100 else {n_first(t)} end)"
    return f"(case when {v} > 0 and {v} <= 1 then {v} end)"


def fmt6(x: str) -> str:
    return f"regexp_replace(printf('%.6f', round_even(({x})*1e6, 0)/1e6), '\\.?0+$', '')"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def contains(x: str, values) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(v)})" for v in values) + ")"


# -- cells --------------------------------------------------------------------
_parts = []
for c, name in {"mass_g": "formulations", "value": "results", "purity_fraction": "reagents", "concentration": "reagents"}.items():
    _parts.append(f"select '{c}' as field, case when right(row_key,1)='3' then ' 1,2'||{c}||' g' else {c} end as raw from v_{name}")
cte("c_raw", " union all ".join(_parts))
QUERIES["numeric_coercion"] = query(
    f"select field, raw, {n_first('raw')} as first_token, {n_fraction('raw')} as fraction, {n_strict('raw')} as strict, "
    f"{n_token('raw')} as token, count(*) as n from c_raw group by all")

cte("c_units", "select reagent_id, ['M','mmol / L','µmol per L','mol/mL','mg per mL','g L−1','ug/mL','wt. %','w/w','ppm',''][cast(row_key as bigint)%11+1] as units, "
    f"{n_first('molecular_weight_g_mol')}/100 as conc from v_reagents")


def norm_units(u: str) -> str:
    t = f"replace(translate(lower(trim({u})), 'µμ−', 'uu-'), ' per ', '/')"
    return f"replace(replace({t}, ' ', ''), '.', '')"


def molarity(c: str, u: str) -> str:
    return (f"(case when {c}>0 then case when {u} in ('m','molar','mol/l','moll-1','mol/liter','mol/litre','mmol/ml','mmolml-1') then {c} "
            f"when {u} in ('mm','mmolar','mmol/l','mmoll-1','mmol/liter','mmol/litre') then {c}/1000 "
            f"when {u} in ('um','umolar','umol/l','umoll-1','umol/liter','umol/litre') then {c}/1000000 "
            f"when {u} in ('mol/ml','molml-1') then {c}*1000 end end)")


def mass_conc(c: str, u: str) -> str:
    return (f"(case when {c}>0 then case when {u} in ('g/ml','gml-1') then {c} when {u} in ('mg/ml','mgml-1','g/l','gl-1') then {c}/1000 "
            f"when {u} in ('ug/ml','ugml-1','mg/l','mgl-1') then {c}/1000000 end end)")


def mass_fraction(c: str, u: str) -> str:
    return (f"(case when {c}>0 then case when {u} in ('%','percent','wt%','weight%','weightpercent','w/w%','%w/w') and {c}/100<=1 then {c}/100 "
            f"when {u} in ('fraction','massfraction','weightfraction','w/w') and {c}<=1 then {c} end end)")


QUERIES["unit_conversion"] = query(
    f"select reagent_id, unit, round({molarity('conc','unit')},9) as molarity, round({mass_conc('conc','unit')},9) as \"mass_g_mL\", "
    f"round({mass_fraction('conc','unit')},9) as fraction from (select *, {norm_units('units')} as unit from c_units)")


def metric_key(t: str) -> str:
    return (f"(case when contains({t},'particle') or contains({t},'dls') then 'particle_size' when contains({t},'conversion') then 'conversion' "
            f"when contains({t},'residual') and contains({t},'monomer') then 'residual_monomer' "
            f"when contains({t},'polydispersity') or contains({t},'pdi') then 'polydispersity_index' "
            f"when contains({t},'tg') or contains({t},'glass transition') then 'Tg' when contains({t},'hold time') then 'hold_time' "
            f"when contains({t},'coagulum') or contains({t},'grit') then 'coagulum_mass' when contains({t},'solids') then 'solids' "
            f"when contains({t},'viscosity') then 'viscosity' when contains({t},'ph') then 'pH' else '' end)")


def prediction_key(t: str) -> str:
    return (f"(case when contains({t},'dls') or (contains({t},'particle') and contains({t},'size')) then 'particle_size' "
            f"when contains({t},'polydispersity') or contains({t},'pdi') then 'polydispersity' when contains({t},'conversion') then 'conversion' "
            f"when contains({t},'coagulum') or contains({t},'retained solid') then 'coagulum' when contains({t},'solid') then 'solids' "
            f"when contains({t},'residual') and contains({t},'monomer') then 'residual_monomer' else '' end)")


MK = metric_key("lower(measurement_type||' '||units)")
PK = prediction_key("lower(measurement_type||' '||method||' '||units||' '||condition)")
QUERIES["metric_key_classify"] = query(
    f"select {MK} as metric_key, measurement_type, units, {PK} as prediction_key, method, condition, count(*) as n from v_results group by all")
QUERIES["format_numbers"] = query(
    f"select sample_id, {fmt6('v/7')} as six_decimals, {fmt6('v*1000')} as thousands, printf('%g', v*1000/7) as six_digits "
    f"from (select sample_id, {n_strict('value')} as v from v_results) where v is not null")


def slug(x: str) -> str:
    return f"(case when {_slug(x)}='' then 'experiment' else {_slug(x)} end)"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-zA-Z0-9_.\\-/]+', '-', 'g'), '^-+|-+$', '', 'g')"


def compact(x: str, width: int, default: str) -> str:
    s = f"left(regexp_replace({x}, '[^A-Za-z0-9]+', '', 'g'), {width})"
    return f"(case when {s}='' then '{default}' else {s} end)"


def evidence_prefix(x: str) -> str:
    return f"('LIT-'||replace(upper({slug(x)}), '/', '-')||'-')"


_obs = "' '||observation||'!'"
_exp_ab = "experiment_id||'/A b'"
QUERIES["id_normalize"] = query(
    f"select row_key, {slug(_obs)} as slug, {compact('timestamp',32,'row')} as compact, "
    f"{compact('observation',48,'')} as review_token, {evidence_prefix(_exp_ab)} as prefix from v_daily_log")

# -- formulations -------------------------------------------------------------
cte("reagent_last", "select * from (select *, row_number() over (partition by reagent_id order by row_key desc) as rn "
    "from v_reagents where trim(reagent_id)<>'') where rn=1")
RF = ["name", "common_name", "category", "role", "molecular_weight_g_mol", "density_g_mL", "purity_fraction",
      "concentration", "concentration_units", "hazards", "notes"]
cte("enriched", "select f.*, " + ", ".join(f"r.{c} as reagent_{c}" for c in RF)
    + ", r.reagent_id is not null as has_reagent from v_formulations f left join reagent_last r on f.reagent_id=r.reagent_id")
QUERIES["formulation_enrich"] = query(
    "select experiment_id, row_key, reagent_id, reagent_name, reagent_category, reagent_molecular_weight_g_mol, \"reagent_density_g_mL\", "
    "reagent_purity_fraction, reagent_concentration, reagent_concentration_units from enriched")
def quantities(p: str, source: str, by: str = "experiment_id") -> None:
    """CTE chain ``{p}1`` … ``{p}7`` and ``{p}_tot`` over an enriched relation."""
    cte(p + "1", f"""select *, {n_first('mass_g')} as m0, {n_first('volume_mL')} as v0, {n_first('moles_mmol')} as n0,
 {n_first('reagent_molecular_weight_g_mol')} as mw, {n_first('reagent_density_g_mL')} as d,
 coalesce({n_fraction('reagent_purity_fraction')}, 1.0) as p,
 coalesce({n_first('concentration')}, {n_first('reagent_concentration')}) as c,
 coalesce(nullif(trim(concentration_units),''), nullif(trim(reagent_concentration_units),'')) as u from {source}""")
    cte(p + "2", f"select *, {molarity('c', norm_units('u'))} as mol, {mass_conc('c', norm_units('u'))} as mc, {mass_fraction('c', norm_units('u'))} as f from {p}1")
    # one scenario per way the amounts can be known, instead of running values
    cte(p + "3", """select *,
 case when n0 is null and v0 is not null and mol is not null then v0*mol
      when n0 is null and v0 is not null and mc is not null and mw is not null then v0*mc/mw*1000 end as stock_n,
 case when v0 is not null and mc is not null then v0*mc
      when n0 is null and v0 is not null and mol is not null and mw is not null then v0*mol/1000*mw end as stock_act,
 coalesce(m0, v0*d) as m_dir from """ + p + "2")
    cte(p + "4", """select *, coalesce(n0, stock_n) as n_known,
 case when coalesce(n0, stock_n) is null and m_dir is not null and mw is not null then
   case when stock_act is not null then stock_act when f is not null then m_dir*f
        when c is not null and u is not null then null else m_dir*p end end as act_m from """ + p + "3")
    cte(p + "5", """select *, coalesce(n_known, act_m/mw*1000) as n,
 case when m_dir is null and coalesce(n_known, act_m/mw*1000) is not null and mw is not null and stock_n is null
      then coalesce(n_known, act_m/mw*1000)/1000*mw end as act_n from """ + p + "4")
    cte(p + "6", """select *, coalesce(m_dir, act_n/coalesce(f,p)) as m,
 coalesce(v0, m_dir/d, case when m_dir is null then act_n/coalesce(f,p)/d end) as v,
 case when act_n is not null and (f is not null or p<>1.0) then act_n
      when stock_act is not null then stock_act
      when act_m is not null and (f is not null or p<>1.0) then act_m end as act from """ + p + "5")
    cte(p + "7", """select *, case when m0 is null then round_even(m*1e6,0)/1e6 end as dm, case when v0 is null then round_even(v*1e6,0)/1e6 end as dv,
 case when n0 is null then round_even(n*1e6,0)/1e6 end as dn, round_even(act*1e6,0)/1e6 as da,
 coalesce(nullif(m0,0.0), nullif(case when m0 is null then round_even(m*1e6,0)/1e6 end,0.0)) as row_mass from """ + p + "6")
    cte(p + "_tot", f"select {by}, cast(sum(cast(row_mass as decimal(28,12))) as double) as total from {p}7 where row_mass>0 "
    f"group by {by} having count(*)>=2")


quantities("q", "enriched")
cte("quant", """select q7.*, case when row_mass is not null then round_even(total*1e6,0)/1e6 end as mass_total, round_even(row_mass/total*100*1e6,0)/1e6 as dw
 from q7 left join q_tot using (experiment_id)""")
QUERIES["formulation_quantities"] = query(f"""select experiment_id, row_key, reagent_id, target_role, dm as derived_mass_g, dv as "derived_volume_mL",
 dn as derived_moles_mmol, da as derived_active_mass_g, mass_total as formulation_mass_total_g, dw as derived_wt_percent,
 concat_ws(' | ', case when n is null and (contains(target_role,'monomer') or contains(target_role,'initiator') or contains(target_role,'surfactant') or contains(target_role,'crosslinker')) then {lit(MOLES_GAP)} end,
  case when v is null and contains(target_role,'monomer') then {lit(VOLUME_GAP)} end) as missing from quant""")
cte("cells", " union all ".join(
    f"select row_key, experiment_id, reagent_id, target_role, '{f}' as field, {d} as number from quant where trim({f})=''"
    for f, d in (("mass_g", "dm"), ("volume_mL", "dv"), ("moles_mmol", "dn"), ("wt_percent", "dw"))))
cte("updates", f"""select experiment_id, reagent_id, target_role, field, {fmt6('arg_min(number,row_key)')} as value,
 count(*)-1 as duplicate_cells, min(row_key) as row_key from cells where number is not null group by all""")
QUERIES["formulation_updates"] = query("select * from updates")
QUERIES["formulation_update_summary"] = query("""select experiment_id, count(*) as rows_considered,
 coalesce(any_value(u.n),0) as cells_to_update, coalesce(any_value(b.n),0)-coalesce(any_value(u.n),0) as fields_skipped
 from v_formulations left join (select experiment_id, count(*) as n from updates group by 1) u using (experiment_id)
 left join (select experiment_id, count(*) as n from cells group by 1) b using (experiment_id) group by experiment_id""")

# -- selection ----------------------------------------------------------------
QUERIES["select_experiments"] = query("select distinct experiment_id from v_experiments where lower(trim(status))<>'abandoned'")
QUERIES["select_by_date"] = query(" union all ".join(
    f"select distinct experiment_id, '{d}' as review_date from v_experiments e where lower(trim(status))<>'abandoned' and (starts_with(date,'{d}') "
    f"or experiment_id in (select experiment_id from v_daily_log where starts_with(timestamp,'{d}')))" for d in ("2024-01-05", "1997-03")))
cte("sug_open", """select s.*, coalesce(lower(trim(e.status)),'') as proposed_experiment_status from v_suggestions s
 left join v_experiments e on e.experiment_id=s.proposed_experiment_id where lower(s.status) in ('draft','accepted','run_planned')""")
QUERIES["open_suggestions"] = query("select suggestion_id, experiment_id, status, proposed_experiment_id, proposed_experiment_status from sug_open")
QUERIES["suggestion_closure"] = query("select suggestion_id, proposed_experiment_id, 'status' as field, 'run_complete' as value from sug_open "
                                      "where status='run_planned' and proposed_experiment_status='complete'")

# -- audits -------------------------------------------------------------------
EMULSION = "(contains(lower(process_type),'emulsion') and contains(lower(process_type),'polymer'))"


def in_group(g: str) -> str:
    roles = inlist(ROLE_GROUPS[g]["roles"])
    return f"(lower(target_role) in {roles} or coalesce(lower(reagent_category),'') in {roles})"


QUERIES["role_coverage"] = query(" union all ".join(
    f"select e.experiment_id, '{g}' as role_group, {str(s['required']).lower()} as required, "
    f"count(case when {in_group(g)} then 1 end) as rows, case when count(case when {in_group(g)} then 1 end)>0 then 'present' else 'missing' end as status "
    f"from v_experiments e left join enriched f on f.experiment_id=e.experiment_id where {EMULSION} group by 1"
    for g, s in ROLE_GROUPS.items()))
_fields = sorted({f for s in ROLE_GROUPS.values() for f in s["fields"]})


def lacks(field: str) -> str:
    roles = inlist([r for s in ROLE_GROUPS.values() if field in s["fields"] for r in s["roles"]])
    own = f" and trim({field})=''" if field in TABLES["formulations"].columns else ""
    return f"(lower(target_role) in {roles} and coalesce(trim(reagent_{field}),'')=''{own})"


cte("audit1", f"""select experiment_id, {', '.join(f"count(case when {in_group(g)} then 1 end) as has_{g}" for g in REQUIRED_GROUPS)},
 count(case when {' and '.join(f"trim({f})=''" for f in QUANTITY_FIELDS)} then 1 end) as quantity_gaps,
 count(case when {' or '.join(lacks(f) for f in _fields)} then 1 end) as property_gaps,
 count(case when trim(reagent_id)<>'' and coalesce(trim(reagent_hazards),'')='' then 1 end) as safety_gaps,
 count(case when starts_with(reagent_id,'AUTO-') or contains(lower(concat_ws(' ',reagent_id,reagent_name,reagent_common_name,reagent_notes,notes)),'todo')
   or contains(lower(concat_ws(' ',reagent_id,reagent_name,reagent_common_name,reagent_notes,notes)),'starter placeholder') then 1 end) as placeholders
 from enriched group by experiment_id""")
cte("audit2", f"""select experiment_id, process_type,
 case when {EMULSION} then concat_ws(',', {', '.join(f"case when coalesce(has_{g},0)=0 then '{g}' end" for g in REQUIRED_GROUPS)}) else '' end as missing_required,
 coalesce(quantity_gaps,0) as quantity_gaps, case when {EMULSION} then coalesce(property_gaps,0) else 0 end as property_gaps,
 coalesce(safety_gaps,0) as safety_gaps, coalesce(placeholders,0) as placeholders from v_experiments left join audit1 using (experiment_id)""")
_ready = "(missing_required='' and quantity_gaps=0 and property_gaps=0)"
cte("audit3", f"""select *, {_ready} as ready,
 case when {_ready} then {lit(MATERIAL_ADVICE['ok'])} else concat_ws(' | ',
  case when missing_required<>'' then {lit(MATERIAL_ADVICE['roles'])}||replace(missing_required,',',', ')||'.' end,
  case when quantity_gaps>0 then {lit(MATERIAL_ADVICE['quantities'])} end, case when property_gaps>0 then {lit(MATERIAL_ADVICE['properties'])} end) end as recommendations,
 case when {_ready} then {lit(MATERIAL_ADVICE['summary_ok'])} else {lit(MATERIAL_ADVICE['summary'])}||concat_ws('; ',
  case when missing_required<>'' then 'missing required groups: '||replace(missing_required,',',', ') end,
  case when quantity_gaps>0 then quantity_gaps||' formulation rows lack quantitative basis' end,
  case when property_gaps>0 then property_gaps||' formulation rows have reagent property gaps' end)||'.' end as summary from audit2""")
QUERIES["material_audit"] = query("select * from audit3")
QUERIES["required_violations"] = query(" union all ".join(
    f"select * from (select '{t.title}' as table_name, row_key, {t.required[0]} as record, concat_ws(',', "
    + ", ".join(f"case when trim({c})='' then '{c}' end" for c in t.required) + f") as missing_fields from v_{n}) where missing_fields<>''"
    for n, t in TABLES.items() if t.required))
QUERIES["vocab_violations"] = query(" union all ".join(
    f"select '{t.title}' as table_name, row_key, '{f}' as field, {f} as value from v_{n} where trim({f})<>'' and trim({f}) not in {inlist(v)}"
    for n, t in TABLES.items() for f, v in t.vocab.items()))
cte("config1", "select key, arg_min(value,row_key) as value from v_config where trim(key)<>'' group by key")
QUERIES["config_first_wins"] = query("select * from config1")
cte("links_exp", "select distinct experiment_id, trim(x) as evidence_id from (select experiment_id, unnest(string_split(linked_literature_ids,',')) as x from v_experiments) where trim(x)<>''")
cte("pre0", """select e.experiment_id, e.date, e.process_type, e.objective, e.status, a.missing_required, a.quantity_gaps, a.property_gaps, a.safety_gaps, a.placeholders,
 coalesce(o.n,0) as obs, coalesce(r.n,0) as res, coalesce(v.n,0) as ev, coalesce(s.n,0) as sug,
 coalesce((select lower(trim(value)) not in ('false','0','no','off') from config1 where key='safety_review_required'), true) as safety_required
 from v_experiments e join audit2 a using (experiment_id)
 left join (select experiment_id, count(*) as n from v_daily_log group by 1) o using (experiment_id)
 left join (select experiment_id, count(*) as n from v_results group by 1) r using (experiment_id)
 left join (select l.experiment_id, count(*) as n from links_exp l join v_evidence v using (evidence_id) group by 1) v using (experiment_id)
 left join (select experiment_id, count(*) as n from v_suggestions where lower(status) in ('draft','accepted','run_planned') group by 1) s using (experiment_id)""")


def preflight(stage: str) -> str:
    soft = "fail" if stage == "review" else "warn"
    req = ("experiment_id", "date", "process_type", "objective", "status")
    fill = "concat_ws(' | ', " + ", ".join(f"case when trim({c})='' then 'Fill Experiments.{c}.' end" for c in req) + ")"
    rules = [
        ("experiment_required_fields", "(" + " or ".join(f"trim({c})=''" for c in req) + ")", "'fail'", fill),
        ("material_roles", "missing_required<>''", "'fail'", f"{lit(CHECKS['material_roles'][2])}||replace(missing_required,',',', ')||'.'"),
        ("formulation_quantities", "quantity_gaps>0", "'fail'", None),
        ("reagent_properties", "property_gaps>0", "'fail'", None),
        ("reagent_safety", "safety_gaps>0", "case when safety_required then 'fail' else 'warn' end", None),
        ("placeholder_reagents", "placeholders>0", "'fail'", None),
        ("daily_log_observations", "obs=0", f"'{soft}'", None),
        ("results_measurements", "res=0", f"'{soft}'", None),
        ("literature_evidence", "ev=0", "'warn'", None),
        ("open_suggestions", "sug>0", "'warn'", None),
    ]
    return " union all ".join(
        f"select experiment_id, {i} as check_pos, '{n}' as \"check\", case when {b} then {s} else 'pass' end as status, "
        f"case when {b} then {lit(CHECKS[n][1])} else {lit(CHECKS[n][0])} end as message, "
        f"case when {b} then {a or lit(CHECKS[n][2])} else '' end as actions from pre0" for i, (n, b, s, a) in enumerate(rules))


cte("pre_review", preflight("review"))
cte("pre_planning", preflight("planning"))
QUERIES["preflight_checks"] = query("select * from pre_review")


def preflight_summary(source: str, stage: str) -> str:
    extra = " and bool_and(case when \"check\" in ('daily_log_observations','results_measurements') then status='pass' else true end)" if stage == "review" else ""
    return f"""select experiment_id, count(*) as check_count, count(case when status='pass' then 1 end) as pass_count,
 count(case when status='warn' then 1 end) as warn_count, count(case when status='fail' then 1 end) as fail_count,
 cast(sum(case when actions='' then 0 else len(string_split(actions,' | ')) end) as bigint) as action_count,
 case when count(case when status='fail' then 1 end)>0 then 'needs_attention' when count(case when status='warn' then 1 end)>0 then 'ready_with_warnings' else 'ready' end as status,
 count(case when status='fail' then 1 end)=0 as ready_to_run, count(case when status='fail' then 1 end)=0{extra} as ready_for_agent_suggestion,
 coalesce(string_agg(nullif(actions,''),' | ' order by check_pos), {lit(PREFLIGHT_READY)}) as next_actions from {source} group by 1"""


cte("pre_sum_planning", preflight_summary("pre_planning", "planning"))
cte("pre_sum_review", preflight_summary("pre_review", "review"))
QUERIES["preflight_summary"] = query("select * from pre_sum_planning")
