"""Checks: TF-IDF, notebook search, literature."""

from assayframe.catalog import NOTEBOOK_QUERIES
from assayframe.contract import SEARCH_TABLES, TABLES
from assayframe.rules import (
    EVIDENCE_TAGS, OFF_PROCESS_TERMS, QUERY_PRIORITY, QUERY_STOP_WORDS, RANKING_TERMS, WORK_TAGS,
)

from .base import cte, lit, query
from .core import contains, evidence_prefix, inlist
from .outcomes import kv, signal_rows

QUERIES: dict[str, str] = {}
WORD = r"[a-zA-Z][a-zA-Z0-9_\-]+"
TERM = r"[a-zA-Z][a-zA-Z0-9\-]+"


def tf(name: str, docs: str, keys: str) -> None:
    """(keys, token, n, total) from a relation with ``text``."""
    cte(name, f"select {keys}, token, count(*) as n, any_value(total) as total from (select {keys}, len(w) as total, lower(unnest(w)) as token "
              f"from (select {keys}, regexp_extract_all(text, '{WORD}') as w from {docs})) group by {keys}, token")


def cosine(prefix: str, docs: str, queries: str) -> None:
    tf(f"{prefix}_dtf", docs, "doc_id")
    tf(f"{prefix}_qtf", queries, "query_id")
    cte(f"{prefix}_idf", f"select token, count(*) as df, ln(((select count(*) from {docs})+1.0)/(count(*)+1.0))+1 as idf from {prefix}_dtf group by token")
    cte(f"{prefix}_dw", f"select doc_id, token, n::double/total*idf as w from {prefix}_dtf join {prefix}_idf using (token)")
    cte(f"{prefix}_qw", f"select query_id, token, n::double/total*coalesce(idf,1.0) as w from {prefix}_qtf left join {prefix}_idf using (token)")
    cte(f"{prefix}_score", f"""select query_id, doc_id, dot/(dn*qn) as score from (select q.query_id, d.doc_id, sum(q.w*d.w) as dot from {prefix}_qw q join {prefix}_dw d using (token) group by 1,2)
 join (select doc_id, sqrt(sum(w*w)) as dn from {prefix}_dw group by 1) using (doc_id) join (select query_id, sqrt(sum(w*w)) as qn from {prefix}_qw group by 1) using (query_id)""")


def top(source: str, by: str, order: str, k: int) -> str:
    return f"select * from (select *, row_number() over (partition by {by} order by {order}) as rank from {source}) where rank<={k}"


cte("corpus", "select doc_id, text from documents")
cte("asked", "select item_id as query_id, text from benchmark")
cosine("c", "corpus", "asked")
QUERIES["tfidf_idf"] = query("select token, df, round(idf,9) as idf from c_idf")
QUERIES["tfidf_search"] = query("select query_id, doc_id, rank, round(score,4) as score from (" + top("c_score", "query_id", "round(score,9) desc, doc_id", 5) + ")")

# -- notebook rows ------------------------------------------------------------


def filled(cols, prefix: bool = True) -> str:
    return "concat_ws(' ', " + ", ".join(f"case when trim({c})<>'' then " + (f"'{c} '||{c}" if prefix else c) + " end" for c in cols) + ")"


_rec = []
for _i, _n in enumerate(SEARCH_TABLES):
    _t = TABLES[_n]
    _ids = [f"case when trim({c})<>'' then '{_t.title}:'||{c} end" for c in ("reagent_id", "experiment_id", "evidence_id", "suggestion_id", "sample_id") if c in _t.search_key]
    _id = "coalesce(" + ", ".join(_ids + [f"'{_t.title}:row-'||row_key"]) + ")"
    if _t.label:
        _lab = "trim(" + "||' '||".join(_t.label) + ")"
    else:
        _lab = f"coalesce(nullif(trim({filled(_t.search_key, False)}),''), '{_t.title} row')"
    _own = "experiment_id" if _n in ("experiments", "daily_log", "formulations", "results") else "''"
    _rec.append(f"select '{_i:02d}'||chr(31)||row_key||chr(31)||{_own} as doc_id, '{_t.title}' as table_name, {_id} as record_id, {_lab} as label, {_own} as owner, "
                f"concat_ws(' ', 'record_id', {_id}, 'sheet {_t.title} row_number label', {_lab}, 'key_fields', {filled(_t.search_key)}, 'row', {filled(_t.columns)}, "
                f"'search_text {_t.title}', {filled(_t.search_key, False)}, {filled(_t.columns)}) as text from v_{_n}")
cte("records", " union all ".join(_rec))
cte("nb_q", " union all ".join(f"select '{a}' as query_id, {lit(b)} as text" for a, b in NOTEBOOK_QUERIES))
cosine("nb", "records", "nb_q")
QUERIES["notebook_search"] = query("select query_id, rank, round(score,4) as score, table_name, record_id, label from ("
                                   + top("nb_score", "query_id", "round(score,9) desc, doc_id", 10) + ") join records using (doc_id)")

# -- queries of experiments ---------------------------------------------------
_copied = ["name", "common_name", "category", "molecular_weight_g_mol", "density_g_mL", "purity_fraction", "concentration", "concentration_units"]
cte("r_text", "select reagent_id, 'reagent '||" + kv("reagents") + "||' '||" + "||' '||".join(f"'reagent_{c} '||{c}" for c in _copied) + " as rt from reagent_last")
cte("entry_text", f"""select experiment_id, 0 as section, row_key, process_type||' '||objective||' '||hypothesis as text from v_experiments
 union all select experiment_id, 1, row_key, {kv('daily_log')} from v_daily_log where experiment_id in (select experiment_id from v_experiments)
 union all select experiment_id, 2, row_key, {kv('results')} from v_results where experiment_id in (select experiment_id from v_experiments)
 union all select experiment_id, 3, row_key, concat_ws(' ', {kv('formulations', 'f.')}, rt) from v_formulations f left join r_text using (reagent_id) where experiment_id in (select experiment_id from v_experiments)""")
cte("e_tok", f"select experiment_id, section, row_key, unnest(w) as token, generate_subscripts(w,1) as pos from (select *, regexp_extract_all(lower(text), '{TERM}') as w from entry_text)")
cte("e_first", "select experiment_id, token, min((section,row_key,pos)) as p from e_tok where len(token)>2 group by 1,2")
_prio = "[" + ", ".join(f"'{w}'" for w in QUERY_PRIORITY) + "]"
cte("e_query", f"""select experiment_id, string_agg(token,' ' order by rank) as text from (select *, row_number() over (partition by experiment_id order by coalesce(nullif(list_position({_prio},token),0),99), p) as rank from e_first)
 where rank<=18 group by 1""")
QUERIES["query_build"] = query("select * from e_query")
cte("ctx_sel", "select distinct experiment_id from v_experiments where lower(trim(status))<>'abandoned' and (starts_with(date,'2024-01-05') or experiment_id in (select experiment_id from v_daily_log where starts_with(timestamp,'2024-01-05')))")
cte("ctx_q", "select experiment_id, text from e_query where experiment_id in (select experiment_id from ctx_sel)")
cte("ctx_qd", "select distinct text as query_id, text from ctx_q")
cosine("ctx", "records", "ctx_qd")
QUERIES["context_search"] = query("select experiment_id, rank, round(score,4) as score, table_name, record_id, label from ("
    + top("(select q.experiment_id, s.doc_id, s.score, r.table_name, r.record_id, r.label from ctx_q q join ctx_score s on s.query_id=q.text join records r using (doc_id) where r.owner<>q.experiment_id)",
          "experiment_id", "round(score,9) desc, doc_id", 5) + ")")

# -- works --------------------------------------------------------------------
cte("w0", "select *, list_filter(string_split(concept_list,'|'), lambda x: x<>'') as concepts, list_filter(string_split(author_list,'|'), lambda x: x<>'') as authors from v_works")
cte("w1", "select *, concat_ws(' ', title, source, journal_or_collection, abstract, summary, array_to_string(concepts,' ')) as st, "
    "coalesce(nullif(year,''), nullif(left(publication_date,4),'')) as yr, "
    "case when doi='' then '' else 'https://doi.org/'||trim(regexp_replace(doi,'^https://doi.org/','')) end as doi_link from w0")
_wt = "concat_ws(',', " + ", ".join(f"case when {contains('lower(st)', v)} then '{k}' end" for k, v in WORK_TAGS.items()) + ")"
QUERIES["work_tags"] = query(f"select work_id, {_wt} as tags, doi_link as doi_url, yr as year from w1")
cte("w_doc", "select row_key as doc_id, concat_ws(' ', 'record_id', coalesce(nullif(work_id,''),nullif(primary_id,''),nullif(doi,''),nullif(url,''),title), 'title', title, 'source', source, 'year', yr, "
    "'journal_or_collection', journal_or_collection, 'abstract', abstract, 'summary', summary, 'concepts', array_to_string(concepts,' '), 'search_text', st) as text from w1")
cte("w_q", " union all ".join(f"select '{a}' as query_id, {lit(b)} as text" for a, b in NOTEBOOK_QUERIES + [("EP-000007", "latex nucleation"), ("EP-000008", "oo zz qq")]))
cosine("w", "w_doc", "w_q")


def rel_terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{TERM}')), lambda t: len(t)>2 and t not in {inlist(QUERY_STOP_WORDS)} and not starts_with(t,'ep-'))"


cte("w_terms", f"select row_key as doc_id, lower(st) as low, lower(title) as lt, list_distinct(regexp_extract_all(lower(st), '{TERM}')) as wt, "
    "coalesce(try_cast(cited_by_count as integer),0) as cit, coalesce(try_cast(year as integer),0) as yr from w1")
_special = "+".join(f"(case when list_contains(qt,'{w}') and list_contains(wt,'{w}') then 2.0 else 0.0 end)" for w in RANKING_TERMS)
_pen = "+".join(f"(case when contains(low,'{w}') then 1.0 else 0.0 end)" for w in OFF_PROCESS_TERMS)
_asks_off = "list_contains(qt,'polymerization') and not list_contains(wt,'polymerization')"
cte("w_lex", f"""select query_id, doc_id, cit, yr, (len(list_intersect(qt,wt))::double
 + case when contains(low,'emulsion polymerization') then case when contains(lt,'emulsion polymerization') then 12.0 else 8.0 end
   when list_contains(wt,'emulsion') and list_contains(wt,'polymerization') then 4.0 when {_asks_off} then -4.0 else 0.0 end
 + case when contains(low,'particle size') and list_contains(qt,'particle') and list_contains(qt,'size') then case when contains(lt,'particle size') then 6.0 else 4.0 end else 0.0 end
 + {_special} - case when {_asks_off} then {_pen} else 0.0 end)::double as lexical from w_terms, (select query_id, {rel_terms('text')} as qt from w_q)""")
cte("w_comb", "select l.*, coalesce(s.score,0.0) as semantic, l.lexical+10*coalesce(s.score,0.0) as combined from w_lex l left join w_score s using (query_id, doc_id)")
cte("w_rank", top("w_comb", "query_id", "round(combined,9) desc, round(semantic,9) desc, lexical desc, cit desc, yr desc, doc_id", 12))
QUERIES["work_rerank"] = query("select query_id, doc_id, rank, round(semantic,6) as semantic, lexical from w_rank")
cte("w_ev", f"""select *, len(list_filter(qt, lambda x: contains(lower(st),x))) as hits from (select r.query_id, r.rank, r.semantic, w.*, q.text as qtext, {rel_terms('q.text')} as qt
 from w_rank r join w1 w on w.row_key=r.doc_id join w_q q on q.query_id=r.query_id where r.rank<=5)""")
QUERIES["evidence_rows"] = query(f"""select query_id as experiment_id, {evidence_prefix('query_id')}||lpad(cast(rank as varchar),3,'0') as evidence_id, coalesce(nullif(source,''),'literature') as source,
 trim(title) as title, array_to_string(authors[1:6],', ') as authors, coalesce(yr,'') as year, coalesce(nullif(url,''),nullif(doi_link,''),nullif(primary_id,''),'') as doi_or_url, qtext as query,
 coalesce(nullif(title,''),'Untitled work')||' ('||coalesce(yr,'unknown year')||') is a literature hit '||case when len(concepts)>0 then 'with concepts: '||array_to_string(concepts[1:5],', ') else 'for the experiment query' end
  ||case when cited_by_count<>'' then '; cited by '||cited_by_count else '' end||'.' as finding, {_wt} as relevance_tags,
 case when contains(lower(st),'emulsion polymerization') and hits>=4 then 'high' when hits>=3 then 'medium' else 'low' end as confidence,
 'Imported from literature export; review source text before treating as definitive. Local semantic rerank score: '||printf('%.4f',round(semantic,4))||'.' as notes from w_ev""")

# -- evidence of experiments --------------------------------------------------
cte("ev_links", f"""select distinct experiment_id, evidence_id from (
 select e.experiment_id, v.evidence_id from (select experiment_id, trim(unnest(string_split(replace(linked_literature_ids,';',','),','))) as evidence_id from v_experiments) e join v_evidence v using (evidence_id)
 union all select e.experiment_id, v.evidence_id from (select experiment_id, {evidence_prefix('experiment_id')} as p from v_experiments where experiment_id in (select 'EP-'||lpad(cast(doc_id%150 as varchar),6,'0') from documents)) e
  join v_evidence v on starts_with(v.evidence_id, e.p))""")
QUERIES["evidence_links"] = query("select * from ev_links")
cte("ev_rows", "select l.experiment_id, v.* from ev_links l join v_evidence v using (evidence_id)")
_tags = "list_filter(list_transform(string_split(replace(relevance_tags,';',','),','), lambda x: trim(x)), lambda x: x<>'')"
_inf = "list_sort(list_filter([" + ", ".join(
    f"case when {contains(chr(108) + 'ow', v)} then '{k}' end" for k, v in EVIDENCE_TAGS.items()) + "], lambda x: x is not null))"
cte("ev_tags", f"select *, case when len({_tags})>0 then list_sort(list_distinct({_tags})) else {_inf} end as tags from (select *, lower(concat_ws(' ',title,finding,query,notes)) as low from ev_rows)")
QUERIES["literature_tag_counts"] = query("select experiment_id, tag, n as count, row_number() over (partition by experiment_id order by n desc, tag) as rank from "
                                         "(select experiment_id, tag, count(*) as n from (select experiment_id, unnest(tags) as tag from ev_tags) group by 1,2)")


def short(x: str, n: int) -> str:
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"(case when len({t})<={n} then {t} else rtrim(left({t},{n - 3}))||'...' end)"


QUERIES["literature_findings"] = query(f"select experiment_id, rank, evidence_id, {short('title', 140)} as title, {short('finding', 240)} as finding, array_to_string(tags,',') as tags, confidence from ("
                                       + top("ev_tags", "experiment_id", "row_key", 5) + ")")
_evcols = TABLES["evidence"].columns
cte("evd", "select experiment_id, evidence_id as doc_id, " + "||' '||".join(f"'{c} '||{c}" for c in _evcols)
    + "||' record_id '||evidence_id||' search_text '||concat_ws(' ',title,finding,query,relevance_tags,notes) as text from ev_rows")
cte("ev_has", "select distinct experiment_id from ev_rows")
cte("evq", "select experiment_id, text from e_query where experiment_id in (select experiment_id from ev_has) union all select experiment_id, text from entry_text where experiment_id in (select experiment_id from ev_has)")
tf("evd_t", "evd", "experiment_id, doc_id")
cte("evq_t", f"select experiment_id, token, count(*) as n, sum(count(*)) over (partition by experiment_id) as total from (select experiment_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) as token from evq) group by 1,2")
cte("evd_idf", "select experiment_id, token, ln((any_value(c)+1.0)/(count(*)+1.0))+1 as idf from evd_t join (select experiment_id, count(*) as c from evd group by 1) using (experiment_id) group by 1,2")
cte("evd_w", "select t.experiment_id, doc_id, token, n::double/total*idf as w from evd_t t join evd_idf using (experiment_id, token)")
cte("evq_w", "select t.experiment_id, token, n::double/total*coalesce(idf,1.0) as w from evq_t t left join evd_idf using (experiment_id, token)")
cte("ev_score", """select experiment_id, doc_id, dot/(dn*qn) as score from (select d.experiment_id, d.doc_id, sum(d.w*coalesce(q.w,0.0)) as dot, sqrt(sum(d.w*d.w)) as dn from evd_w d left join evq_w q using (experiment_id, token) group by 1,2)
 join (select experiment_id, sqrt(sum(w*w)) as qn from evq_w group by 1) using (experiment_id)""")
QUERIES["evidence_matches"] = query("select experiment_id, rank, doc_id as evidence_id, round(score,4) as score from ("
    + top("(select s.*, r.row_key from ev_score s join ev_rows r on r.experiment_id=s.experiment_id and r.evidence_id=s.doc_id where score>0)", "experiment_id", "round(score,9) desc, row_key", 3) + ")")
cte("ev_flags", f"""select h.experiment_id, list_filter([
 case when bool_or(s.signal in ('particle_size_high','broad_psd')) then 'particle_size' end, case when bool_or(s.signal in ('coagulum','instability')) then 'stability' end,
 case when bool_or(s.signal in ('low_conversion','residual_monomer_high')) then 'initiator' end], lambda x: x is not null) as a from ev_has h left join sig_entry s using (experiment_id) group by 1""")
cte("ev_flags2", """select experiment_id, list_filter([case when bool_or(contains(lower(text),'surfactant') or contains(lower(text),'sds')) then 'surfactant' end,
 case when bool_or(contains(lower(text),'feed')) then 'feed' end, case when bool_or(contains(lower(text),'monomer') or contains(lower(text),'acrylate')) then 'monomer' end], lambda x: x is not null) as b
 from entry_text where experiment_id in (select experiment_id from ev_has) group by 1""")
cte("evq_terms", f"select distinct experiment_id, term from (select experiment_id, unnest({rel_terms('text')}) as term from evq)")
cte("ev_shared", f"select experiment_id, evidence_id, count(*) as n from (select experiment_id, evidence_id, unnest({rel_terms('||'.join(chr(39) + c + ' ' + chr(39) + '||' + c + '||' + chr(39) + ' ' + chr(39) for c in _evcols))}) as term from ev_rows) join evq_terms using (experiment_id, term) group by 1,2")
cte("ev_total", """select r.experiment_id, r.evidence_id, r.row_key, 8.0*len(list_intersect(tg, list_concat(f.a, f2.b)))+10.0*coalesce(s.score,0)+2.0*coalesce(h.n,0)
 +1.5*case lower(trim(confidence)) when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end+0.25*len(tg) as score
 from (select *, list_distinct(list_transform(list_filter(list_transform(string_split(replace(relevance_tags,';',','),','), lambda x: trim(x)), lambda x: x<>''), lambda x: lower(x))) as tg from ev_rows) r
 join ev_flags f using (experiment_id) join ev_flags2 f2 using (experiment_id)
 left join ev_score s on s.experiment_id=r.experiment_id and s.doc_id=r.evidence_id left join ev_shared h on h.experiment_id=r.experiment_id and h.evidence_id=r.evidence_id""")
cte("ev_sel", top("ev_total", "experiment_id", "round(score,9) desc, row_key", 3))
QUERIES["evidence_select"] = query("select experiment_id, rank, evidence_id, round(score,4) as score from ev_sel")
