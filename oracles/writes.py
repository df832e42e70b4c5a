"""Checks: materials, day views, writes, records."""

from assayframe.adapters import DUCK, records_sql
from assayframe.contract import TABLES
from assayframe.operators.materials import role_terms, searched_groups
from assayframe.rules import MATERIAL_ADVICE, ROLE_GROUPS, STARTER_ROWS

from .base import cte, lit, query
from .core import EMULSION, inlist
from .outcomes import kv
from .retrieval import WORD, cosine, top

QUERIES: dict[str, str] = {}
LIST = lambda xs: "[" + ", ".join(lit(x) for x in xs) + "]"


def toks(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: lower(w))"


# -- materials ----------------------------------------------------------------
cte("mtypes", f"select distinct trim(process_type) as process_type from v_experiments where {EMULSION}")


def role_queries(name: str, groups) -> None:
    cte(name, " union all ".join(
        f"select process_type||'|{g}' as query_id, process_type, '{g}' as role_group, process_type||' {' '.join([g, ' '.join(ROLE_GROUPS[g]['roles']), ' '.join(ROLE_GROUPS[g]['examples'])])}' as text from mtypes" for g in groups))


role_queries("mq_all", searched_groups(True))
role_queries("mq", searched_groups(False))
cte("m_doc", "select row_key as doc_id, 'record_id Master Reagents: '||reagent_id||' row_number row '||" + kv("reagents")
    + "||' search_text Master Reagents '||concat_ws(' ',reagent_id,name,common_name,category,role,notes,hazards) as text from v_reagents")
cosine("ma", "m_doc", "mq_all")
cosine("mb", "m_doc", "mq")
_d = []
for g, s in ROLE_GROUPS.items():
    ok = inlist(role_terms(g))
    ex = LIST(sorted({w.lower() for e in s["examples"] for w in e.split()}))
    n = f"len(list_intersect(list_distinct({toks('lower(trim(category))||chr(32)||lower(trim(role))||chr(32)||lower(name||chr(32)||common_name||chr(32)||notes)')}), {ex}))"
    rt = f"len(list_filter({toks('lower(trim(role))')}, lambda w: w in {ok}))>0"
    ms = "concat_ws(',', " + ", ".join([f"case when trim({f})='' then '{f}' end" for f in s["fields"]] or ["null"]) + ")"
    _d.append(f"""select row_key, reagent_id, name, category, role, '{g}' as role_group,
 (case when lower(trim(category)) in {ok} then 1.25 else 0.0 end+case when {rt} then 1.0 else 0.0 end+case when contains(lower(trim(category)),'{g}') then 0.75 else 0.0 end+case when {n}>0 then least(0.75,0.15*{n}) else 0.0 end)::double as direct,
 concat_ws(',', case when lower(trim(category)) in {ok} then 'category_matches_role' end, case when {rt} then 'role_text_matches' end, case when contains(lower(trim(category)),'{g}') then 'category_contains_role_group' end, case when {n}>0 then 'example_token_overlap' end) as reasons,
 coalesce({ms},'') as missing_fields from v_reagents""")
cte("m_direct", " union all ".join(_d))


def candidates(q: str, p: str, extra: str = "") -> str:
    return (f"select q.query_id, q.process_type, d.*, coalesce(s.score,0.0) as semantic, round(d.direct+coalesce(s.score,0.0),4) as score from {q} q join m_direct d using (role_group) "
            f"left join {p}_score s on s.query_id=q.query_id and s.doc_id=d.row_key where (d.direct>0 or coalesce(s.score,0)>=0.2){extra}")


cte("m_cand_all", top("(" + candidates("mq_all", "ma") + ")", "query_id", "score desc, row_key", 5))
cte("m_cand3", top("(" + candidates("mq", "mb") + ")", "query_id", "score desc, row_key", 3))
cte("m_best", top("(" + candidates("mq", "mb", " and d.direct>0") + ")", "query_id", "score desc, row_key", 1))
QUERIES["material_candidates"] = query("select process_type, role_group, rank, score, round(semantic,4) as semantic_score, row_key, reagent_id, name, category, role, coalesce(nullif(reasons,''),'semantic_text_match') as match_reasons, missing_fields from m_cand_all")
_flat = kv("knowledge")
cte("k_doc", f"select row_key as doc_id, 'record_id Process Knowledge: '||process_type||' '||material_role||' row_number row '||{_flat}||' search_text '||{_flat} as text from v_knowledge")
cosine("mk", "k_doc", "mq")
cte("k_direct", " union all ".join(f"select *, '{g}' as role_group, case when lower(material_role) in {inlist(role_terms(g))} or contains(lower(material_role),'{g}') then 0.75 else 0.0 end as direct from v_knowledge" for g in searched_groups(False)))
cte("k_match", top("(select q.query_id, q.process_type, q.role_group, d.row_key, d.process_type as knowledge_process, d.material_role, d.typical_examples, d.guidance, d.search_terms, round(d.direct+coalesce(s.score,0.0),4)::double as score from mq q join k_direct d using (role_group) "
                   "left join mk_score s on s.query_id=q.query_id and s.doc_id=d.row_key where d.direct+coalesce(s.score,0.0)>0)", "query_id", "score desc, row_key", 3))
QUERIES["knowledge_matches"] = query("select process_type, role_group, rank, score, row_key, knowledge_process, material_role, typical_examples, guidance, search_terms from k_match")
cte("m_search", " union all ".join(f"""select e.experiment_id, '{g}' as role_group, {str(ROLE_GROUPS[g]['required']).lower()} as required, count(f.row_key) as present_rows,
 (select count(*) from m_cand3 c where c.role_group='{g}' and c.process_type=trim(any_value(e.process_type))) as candidates from v_experiments e
 left join v_formulations f on f.experiment_id=e.experiment_id and lower(trim(f.target_role)) in {inlist(role_terms(g))} where {EMULSION} group by 1""" for g in searched_groups(False)))
QUERIES["material_search"] = query("select *, case when present_rows>0 then 'present_in_formulation' when candidates>0 then 'candidate_found' when required then 'missing_required_candidate' else 'optional_no_candidate' end as status from m_search")
_sc = []
for g in searched_groups(False):
    role, phase, fo, fs, fd, cat, name, common, suffix = STARTER_ROWS[g]
    fields = ", ".join(ROLE_GROUPS[g]["fields"])
    _sc.append(f"""select e.experiment_id, trim(e.process_type) as process_type, '{g}' as role_group, '{role}' as target_role, '{phase}' as phase, '{fo}' as feed_order, '{fs}' as feed_start_min, '{fd}' as feed_duration_min,
 '{cat}' as cat, '{name}' as nm, '{suffix}' as suffix, '{fields}' as fields, {LIST(ROLE_GROUPS[g]['examples'])} as ex from v_experiments e where {EMULSION}
 and not exists (select 1 from v_formulations f where f.experiment_id=e.experiment_id and lower(trim(f.target_role)) in {inlist(ROLE_GROUPS[g]['roles'])})""")
cte("sc0", " union all ".join(_sc))
cte("k_two", """select process_type, role_group, list_filter(list_transform(flatten(list(string_split(replace(typical_examples,';',','),',') order by rank)), lambda x: trim(x)), lambda x: x<>'') as ex2,
 first(trim(guidance) order by case when trim(guidance)='' then 9 else rank end) as guide from k_match where rank<=2 group by 1,2""")
cte("sc1", """select s.*, b.reagent_id as found, list_concat(s.ex, coalesce(k.ex2,[])) as allex, coalesce(k.guide,'') as guide from sc0 s left join m_best b using (process_type, role_group) left join k_two k using (process_type, role_group)""")
cte("sc2", "select *, list_filter(allex, lambda x, i: list_position(list_transform(allex, lambda y: lower(y)), lower(x))=i) as uniq from sc1")
QUERIES["material_scaffold"] = query("""select experiment_id, role_group, coalesce(found, replace('AUTO-'||experiment_id||'-'||suffix,' ','-')) as reagent_id, found is null as placeholder, target_role, phase, feed_order, feed_start_min, feed_duration_min,
 'Starter row generated by assayframe; enter actual quantity before running.' as notes, case when found is null then nm end as reagent_name, case when found is null then cat end as reagent_category,
 case when found is null then role_group||' for '||process_type end as reagent_role,
 case when found is null then concat_ws(' ', 'Starter placeholder generated by assayframe; replace with verified reagent identity and physical properties.', 'Process examples to review: '||array_to_string(uniq[1:6],', ')||'.',
  case when fields<>'' then 'Fill critical fields: '||fields||'.' end, case when guide<>'' then 'Process guidance: '||guide end) end as reagent_notes from sc2""")

# -- day views ----------------------------------------------------------------
QUERIES["latest_observations"] = query("select experiment_id, rank, timestamp, process_stage, observation, issue_tags from (" + top("v_daily_log", "experiment_id", "timestamp desc, row_key desc", 3) + ")")
QUERIES["issue_tags"] = query("select distinct experiment_id, trim(x) as tag from (select experiment_id, unnest(string_split(issue_tags,',')) as x from v_daily_log) where trim(x)<>''")
QUERIES["daily_windows"] = query("select left(trim(timestamp),10) as day, count(*) as observations, count(distinct experiment_id) as experiments from v_daily_log group by 1")
cte("sa0", """select experiment_id, case status when 'draft' then 0 when 'accepted' then 1 else case when proposed_experiment_status='complete' then 2 else 3 end end as kind, suggestion_id, row_key,
 row_number() over (partition by experiment_id, case status when 'draft' then 0 when 'accepted' then 1 else case when proposed_experiment_status='complete' then 2 else 3 end end order by row_key) as rn from sug_open""")
cte("sa1", "select experiment_id, kind, string_agg(suggestion_id,', ' order by row_key) filter (rn<=3)||case when count(*)>3 then ', +'||(count(*)-3)||' more' else '' end as ids from sa0 group by 1,2")
cte("acts", f"""select experiment_id, i-1 as action_pos, r as action from (select experiment_id, unnest(string_split(recommendations,' | ')) as r, generate_subscripts(string_split(recommendations,' | '),1) as i from audit3 where not ready)
 union all select experiment_id, nrec, 'Capture at least one normalized measurement in Results before interpreting the run.' from act_base where res=0
 union all select experiment_id, nrec+case when res=0 then 1 else 0 end, 'Review result limits before accepting a follow-up: '||string_split(guidance,' | ')[1] from act_base where limiting_count>0
 union all select experiment_id, kind+10, case kind when 0 then 'Review draft Agent Suggestions ('||ids||') and set status to accepted or rejected.' when 1 then 'Materialize accepted Agent Suggestions ('||ids||') into planned Experiments, Formulations, and Results rows.'
  when 2 then 'Set run_planned Agent Suggestions ('||ids||') to run_complete because their planned follow-up experiments are complete.' else 'Run or update planned follow-up experiments from run_planned Agent Suggestions ('||ids||') before requesting a fresh recommendation.' end from sa1""")
cte("act_base", "select a.experiment_id, case when ready then 0 else len(string_split(recommendations,' | ')) end as nrec, p.res, r.limiting_count, r.guidance from audit3 a join pre0 p using (experiment_id) join ra1 r using (experiment_id)")
cte("act_sel", "select distinct experiment_id from v_experiments where lower(trim(status))<>'abandoned'")
QUERIES["next_actions"] = query("""select * from acts where experiment_id in (select experiment_id from act_sel)
 union all select experiment_id, 0, 'Notebook entry is ready for suggestion review or follow-up planning.' from act_sel where experiment_id not in (select experiment_id from acts)""")
QUERIES["daily_summary"] = query(" union all ".join(f"""select count(*) as experiment_count, coalesce(sum(p.obs),0)::bigint as observation_count, coalesce(sum(p.res),0)::bigint as result_count, coalesce(sum(p.sug),0)::bigint as open_suggestion_count,
 coalesce(sum(r.limiting_count),0)::bigint as limiting_metric_count, count(case when r.limiting_count>0 then 1 end) as experiments_with_limits, count(case when r.signals<>'' then 1 end) as experiments_with_signals,
 count(case when not a.ready then 1 end) as experiments_needing_material, '{d}' as review_date from v_experiments e join pre0 p using (experiment_id) join ra1 r using (experiment_id) join audit3 a using (experiment_id)
 where lower(trim(e.status))<>'abandoned' and (starts_with(e.date,'{d}') or e.experiment_id in (select experiment_id from v_daily_log where starts_with(timestamp,'{d}')))""" for d in ("2024-01-05", "1997-03")))

# -- writes -------------------------------------------------------------------
_set = ", ".join(f"coalesce((any_value(u.value) filter (u.field='{f}')), any_value(f.{f})) as \"{f}\"" for f in ("mass_g", "volume_mL", "moles_mmol", "wt_percent"))
QUERIES["apply_cell_updates"] = query(f"select f.experiment_id, f.row_key, f.reagent_id, f.target_role, {_set} from v_formulations f left join updates u on u.experiment_id=f.experiment_id and u.row_key=f.row_key and u.reagent_id=f.reagent_id and u.target_role=f.target_role group by 1,2,3,4")
QUERIES["projected_results"] = query("select experiment_id, measurement_type, method, count(*) as n from (select experiment_id, measurement_type, method from v_results union all select experiment_id, measurement_type, method from log_results) group by all")
QUERIES["rerun_noop"] = query("""select count(*) as second_run_rows from log_cand where (experiment_id, sample_id, measurement_type) not in (select experiment_id, sample_id, measurement_type from v_results union all select experiment_id, sample_id, measurement_type from log_results)
 and (experiment_id, lower(measurement_type), trim(value), lower(units)) not in (select experiment_id, lower(measurement_type), trim(value), lower(units) from v_results union all select experiment_id, lower(measurement_type), trim(value), lower(units) from log_results)""")
QUERIES["batch_signature"] = query("select count(*) as row_count, sum(('0x'||left(md5(experiment_id||chr(31)||field||chr(31)||reagent_id||chr(31)||target_role||chr(31)||value),15))::bigint)::varchar as signature from updates")
cte("ap_f", "select case when feed_order='1' then experiment_id||'-X' else experiment_id end||'|'||reagent_id||'|'||target_role as k from v_formulations where feed_order in ('1','2')")
cte("ap_e", "select proposed_experiment_id as k from v_suggestions where proposed_experiment_id<>''")
cte("ap_r", "select 'DRV-20240105-EP'||substr(row_key,7,6) as k from v_config where cast(row_key as bigint)%30=0")
_ap = []
for n, src, have in (("experiments", "ap_e", "select experiment_id from v_experiments"), ("formulations", "ap_f", "select experiment_id||'|'||reagent_id||'|'||target_role from v_formulations"), ("reviews", "ap_r", "select review_id from v_reviews")):
    head = f"'{TABLES[n].title}' as table_name, '{','.join(TABLES[n].key)}' as key, k as value"
    _ap += [f"select 'duplicate_append' as code, {head} from {src} where k in ({have})", f"select 'duplicate_in_batch', {head} from {src} group by k having count(*)>1"]
_ap += ["select 'missing_update_target', 'Agent Suggestions', 'suggestion_id', suggestion_id||'-Z' from v_suggestions where status='draft'",
        "select 'missing_update_target', 'Master Reagents', 'reagent_id', k from (select 'R-'||lpad(cast(cast(substr(row_key,3,10) as bigint)+1000 as varchar),5,'0') as k from v_reagents) where k not in (select reagent_id from v_reagents)"]
QUERIES["apply_audit"] = query(" union all ".join(_ap))
QUERIES["fold_updates"] = query("""select 'appended' as part, '' as field, count(*) as n, count(case when f.mass_g<>'' or exists (select 1 from updates u where u.field='mass_g' and u.experiment_id=f.experiment_id and u.reagent_id=f.reagent_id and u.target_role=f.target_role) then 1 end) as with_mass from v_formulations f where feed_order='3'
 union all select 'left over', field, count(*), 0 from updates where (experiment_id, reagent_id, target_role) not in (select experiment_id, reagent_id, target_role from v_formulations where feed_order='3') group by field""")
QUERIES["rows_not_present"] = query("select reagent_id, name from v_reagents where reagent_id not in (select reagent_id from v_formulations where feed_order='3' and notes<>'')")
cte("li", top("ev_rows", "experiment_id", "row_key", 3))
cte("li2", "select experiment_id, list(evidence_id order by rank) as ids from li group by 1")
cte("li3", "select experiment_id, list_filter(list_transform(string_split(replace(linked_literature_ids,';',','),','), lambda x: trim(x)), lambda x: x<>'') as old, ids from v_experiments join li2 using (experiment_id)")
QUERIES["linked_ids_update"] = query("""select * from (select experiment_id, 'linked_literature_ids' as field, array_to_string(list_concat(old, list_filter(ids, lambda x: not list_contains(old,x))),',') as value, array_to_string(old,',') as o from li3) where value<>o""".replace("select * from (", "select experiment_id, field, value from ("))

# -- records ------------------------------------------------------------------
cte("rec", records_sql(DUCK))
cte("rec1", "select row_key, 'RX-'||lpad(cast(o_orderkey as varchar),6,'0') as experiment_id, strftime(o_orderdate,'%Y-%m-%d') as d, o_orderkey as k, o_custkey as c from rec")
QUERIES["record_ingest"] = query("""select 'Experiments' as table_name, row_key, experiment_id, d||' | '||case when k%5=0 then '' else 'emulsion polymerization' end||' | complete' as cells from rec1
 union all select 'Formulations', row_key||'|000000', experiment_id, 'R-'||lpad(cast(c+1900 as varchar),5,'0')||' | surfactant | '||(k%9) from rec1
 union all select 'Formulations', row_key||'|000001', experiment_id, 'R-'||lpad(cast(k%3000 as varchar),5,'0')||' | buffer | ' from rec1
 union all select 'Daily Log', row_key||'|000000', experiment_id, case when k%7=0 then d else d||'T10:00:00' end||' | feed | stable feed' from rec1
 union all select 'Daily Log', row_key||'|000001', experiment_id, d||' |  | No visible coagulum '||(k%6) from rec1
 union all select 'Results', row_key||'|000000', experiment_id, experiment_id||'-R-001 | pH | '||(k%14)||' | observed' from rec1
 union all select 'Results', row_key||'|000001', experiment_id, experiment_id||'-R-002 |  | '||c||' | observed' from rec1""")
cte("rec_r", """select row_key||'|000000' as row_key, 'R-'||lpad(cast(c+1900 as varchar),5,'0') as reagent_id, case when k%4=0 then '' else 'soap '||(k%3) end as name, 'surfactant' as category, '' as hazards from rec1
 union all select row_key||'|000001', 'R-'||lpad(cast(k%3000 as varchar),5,'0'), '', '', 'base' from rec1 where k%2=0""")
QUERIES["record_warnings"] = query("""select 'Experiments' as table_name, row_key, concat_ws(',', case when k%5=0 then 'process_type' end, 'objective') as missing_fields from rec1
 union all select 'Master Reagents', row_key, concat_ws(',', case when name='' then 'name' end, case when category='' then 'category' end) from rec_r where name='' or category=''
 union all select 'Results', row_key||'|000001', 'measurement_type' from rec1""")
cte("rec_m", "select reagent_id, coalesce(arg_min(name,row_key) filter (name<>''),'') as name, coalesce(arg_min(category,row_key) filter (category<>''),'') as category, coalesce(arg_min(hazards,row_key) filter (hazards<>''),'') as hazards, min(row_key) as row_key from rec_r group by 1")
QUERIES["reagent_merge"] = query("select * from rec_m")
cte("rec_f", " union all ".join(f"select reagent_id, '{c}' as field, {c} as v from rec_m where {c}<>''" for c in ("name", "category", "hazards")))
cte("rec_o", " union all ".join(f"select reagent_id, '{c}' as field, trim({c}) as o from reagent_last" for c in ("name", "category", "hazards")))
QUERIES["reagent_reconcile"] = query("select reagent_id, field, case when o is null then 'append' when o='' then 'fill' when o<>v then 'conflict' else 'same' end as action, coalesce(o,'') as existing_value, v as proposed_value from rec_f left join rec_o using (reagent_id, field)")
