"""Material search per role and starter rows for roles a formulation lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import first_rows, lookup
from ..functions.metrics import is_emulsion
from ..functions.text import key_values, nonblank, present, split_list, text, words
from ..rules import ROLE_GROUPS, STARTER_ROWS
from .search import score, top_k
from .select import experiments_once


def role_terms(group: str) -> list[str]:
    s = ROLE_GROUPS[group]
    return list(dict.fromkeys([*s["roles"], group, *s["extra_terms"]]))


def searched_groups(include_optional: bool) -> list[str]:
    return [g for g, s in ROLE_GROUPS.items() if s["required"] or include_optional or g == "aqueous_phase"]


def role_queries(t: dict[str, DataFrame], include_optional: bool = False, query: str = "") -> DataFrame:
    """(query_id, process_type, role_group, text) for each emulsion process type in use."""
    types = t["experiments"].where(is_emulsion(F.col("process_type"))).select(F.trim("process_type").alias("process_type")).distinct()
    roles = F.array(*[
        F.struct(F.lit(g).alias("role_group"), F.lit(" ".join(
            [g, " ".join(ROLE_GROUPS[g]["roles"]), " ".join(ROLE_GROUPS[g]["examples"]), query]).strip()).alias("words"))
        for g in searched_groups(include_optional)])
    return types.select("process_type", F.inline(roles)).select(
        F.concat_ws("|", "process_type", "role_group").alias("query_id"), "process_type", "role_group",
        F.concat_ws(" ", "process_type", "words").alias("text"))


def reagent_documents(reagents: DataFrame) -> DataFrame:
    cols = TABLES["reagents"].columns
    shown = F.concat_ws(" ", F.lit("Master Reagents"), *[
        text(F.col(c)) for c in ("reagent_id", "name", "common_name", "category", "role", "notes", "hazards")])
    body = F.concat_ws(" ", F.lit("record_id Master Reagents:"), "reagent_id", F.lit("row_number row"),
                       key_values([(c, c) for c in cols]), F.lit("search_text"), shown)
    return reagents.select(F.col(ROW_KEY).alias("doc_id"), body.alias("text"))


def direct_matches(reagents: DataFrame, groups: list[str]) -> DataFrame:
    """(row_key, role_group, direct score, reasons) of the rule-based matches."""
    category, role = F.lower(F.trim(text(F.col("category")))), F.lower(F.trim(text(F.col("role"))))
    names = F.lower(F.concat_ws(" ", *[text(F.col(c)) for c in ("name", "common_name", "notes")]))
    df = reagents.select(
        "*", category.alias("__c"), words(role).alias("__rt"),
        F.array_distinct(words(F.concat_ws(" ", category, role, names))).alias("__wt"))
    cells = []
    for g in groups:
        accepted = F.array(*[F.lit(x) for x in role_terms(g)])
        examples = F.array_distinct(words(F.lit(" ".join(ROLE_GROUPS[g]["examples"]))))
        n = F.size(F.array_intersect("__wt", examples))
        rules = [
            (F.array_contains(accepted, F.col("__c")), F.lit(1.25), "category_matches_role"),
            (F.arrays_overlap("__rt", accepted), F.lit(1.0), "role_text_matches"),
            (F.col("__c").contains(g), F.lit(0.75), "category_contains_role_group"),
            (n > 0, F.least(F.lit(0.75), 0.15 * n), "example_token_overlap"),
        ]
        total = F.lit(0.0)
        for cond, points, _ in rules:
            total = total + F.when(cond, points).otherwise(0.0)
        cells.append(F.struct(
            F.lit(g).alias("role_group"), total.alias("direct"),
            present([(cond, F.lit(name)) for cond, _, name in rules]).alias("reasons"),
            present([(~nonblank(F.col(f)), F.lit(f)) for f in ROLE_GROUPS[g]["fields"]]).alias("missing_fields")))
    keep = [ROW_KEY, "reagent_id", "name", "category", "role"]
    return df.select(*keep, F.inline(F.array(*cells)))


def material_candidates(
    t: dict[str, DataFrame], k: int | None = 3, include_optional: bool = False, query: str = "", direct_only: bool = False
) -> DataFrame:
    """Top-``k`` reagents per (process type, role group).

    The rule score is unrolled over the fixed role groups.  A reagent without a
    rule match counts only from a cosine of 0.2, so pairs are made for rule
    matches and for cosine hits, not for every reagent and role.
    """
    groups = searched_groups(include_optional)
    q = role_queries(t, include_optional, query)
    sem = score(reagent_documents(t["reagents"]), q.select("query_id", "text")).withColumnRenamed("score", "semantic")
    facts = direct_matches(t["reagents"], groups)
    asked = q.select("query_id", "process_type", "role_group")
    ruled = asked.join(facts.where("direct > 0"), "role_group")
    df = ruled.join(sem.withColumnRenamed("doc_id", ROW_KEY), ["query_id", ROW_KEY], "left")
    df = df.withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    if not direct_only:
        close = sem.where("semantic >= 0.2").withColumnRenamed("doc_id", ROW_KEY).join(asked, "query_id")
        close = close.join(facts.where("direct = 0"), [ROW_KEY, "role_group"])
        df = df.unionByName(close)
    df = df.withColumn("score", F.round(F.col("direct") + F.col("semantic"), 4))
    if direct_only:
        df = df.where(nonblank(F.col("reagent_id")))
    out = top_k(df, k, ["query_id"], [F.col("score").desc(), F.col(ROW_KEY)])
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("semantic_text_match")))
    return out.select(
        "process_type", "role_group", "rank", "score", F.round("semantic", 4).alias("semantic_score"), ROW_KEY,
        "reagent_id", "name", "category", "role", reasons.alias("match_reasons"), "missing_fields")


def knowledge_matches(t: dict[str, DataFrame], k: int = 3, include_optional: bool = False, query: str = "") -> DataFrame:
    """Top-``k`` process-knowledge rows per (process type, role group)."""
    kn = t["knowledge"]
    q = role_queries(t, include_optional, query)
    flat = F.concat_ws(" ", *[F.concat(F.lit(c + " "), text(F.col(c))) for c in TABLES["knowledge"].columns])
    docs = kn.select(F.col(ROW_KEY).alias("doc_id"), F.concat_ws(
        " ", F.lit("record_id Process Knowledge:"), "process_type", "material_role", F.lit("row_number row"), flat, F.lit("search_text"), flat).alias("text"))
    sem = score(docs, q.select("query_id", "text")).withColumnRenamed("doc_id", ROW_KEY)
    role = F.lower(text(F.col("material_role")))
    cells = F.array(*[
        F.struct(F.lit(g).alias("role_group"),
                 F.when(role.isin(role_terms(g)) | role.contains(g), 0.75).otherwise(0.0).alias("direct"))
        for g in searched_groups(include_optional)])
    facts = kn.select("*", F.inline(cells)).withColumnRenamed("process_type", "knowledge_process")
    asked = q.select("query_id", "process_type", "role_group")
    ruled = asked.join(facts.where("direct > 0"), "role_group").join(sem, ["query_id", ROW_KEY], "left")
    close = sem.join(asked, "query_id").join(facts.where("direct = 0"), [ROW_KEY, "role_group"])
    df = ruled.unionByName(close).withColumn("score", F.round(F.col("direct") + F.coalesce("score", F.lit(0.0)), 4))
    out = top_k(df.where("score > 0"), k, ["query_id"], [F.col("score").desc(), F.col(ROW_KEY)])
    return out.select("process_type", "role_group", "rank", "score", ROW_KEY, "knowledge_process", "material_role",
                      "typical_examples", "guidance", "search_terms")


def material_search(t: dict[str, DataFrame], candidates: DataFrame, include_optional: bool = False) -> DataFrame:
    """(experiment, role group, rows present, candidates, status) of emulsion experiments."""
    groups = searched_groups(include_optional)
    role = F.lower(F.trim(text(F.col("target_role"))))
    have = t["formulations"].groupBy("experiment_id").agg(*[
        F.sum(role.isin(role_terms(g)).cast("int")).alias(g) for g in groups])
    exp = experiments_once(t).where(is_emulsion(F.col("process_type"))).select("experiment_id", F.trim("process_type").alias("process_type"))
    df = lookup(exp, have, ["experiment_id"])
    cells = F.array(*[
        F.struct(F.lit(g).alias("role_group"), F.lit(ROLE_GROUPS[g]["required"]).alias("required"),
                 F.coalesce(F.col(g), F.lit(0)).cast("bigint").alias("present_rows")) for g in groups])
    found = candidates.groupBy("process_type", "role_group").agg(F.count("*").alias("candidates"))
    df = lookup(df.select("experiment_id", "process_type", F.inline(cells)), found, ["process_type", "role_group"])
    n = F.coalesce("candidates", F.lit(0)).cast("bigint")
    status = (
        F.when(F.col("present_rows") > 0, "present_in_formulation").when(n > 0, "candidate_found")
        .when(F.col("required"), "missing_required_candidate").otherwise("optional_no_candidate"))
    return df.select("experiment_id", "role_group", "required", "present_rows", n.alias("candidates"), status.alias("status"))


def material_scaffold(
    t: dict[str, DataFrame], include_optional: bool = False, query: str = "", generator: str = "assayframe"
) -> DataFrame:
    """One starter formulation row per (emulsion experiment, role group without material).

    ``placeholder`` rows name a reagent that has yet to be added; ``reagent_*``
    columns hold that row.
    """
    groups = searched_groups(include_optional)
    role = F.lower(F.trim(text(F.col("target_role"))))
    have = t["formulations"].groupBy(F.trim("experiment_id").alias("experiment_id")).agg(*[
        F.max(role.isin(ROLE_GROUPS[g]["roles"]).cast("int")).alias(g) for g in groups])
    exp = experiments_once(t).where(is_emulsion(F.col("process_type"))).select("experiment_id", F.trim("process_type").alias("process_type"))
    df = lookup(exp, have, ["experiment_id"])
    starter = lambda g: STARTER_ROWS[g]
    cells = F.array(*[
        F.struct(
            F.lit(g).alias("role_group"), F.coalesce(F.col(g), F.lit(0)).alias("present"),
            *[F.lit(v).alias(n) for n, v in zip(
                ("target_role", "phase", "feed_order", "feed_start_min", "feed_duration_min", "category", "name", "common_name", "suffix"), starter(g))],
            F.lit(", ".join(ROLE_GROUPS[g]["fields"])).alias("fields"),
            F.array(*[F.lit(x) for x in ROLE_GROUPS[g]["examples"]]).alias("examples"))
        for g in groups])
    df = df.select("experiment_id", "process_type", F.inline(cells)).where("present = 0").drop("present")
    best = material_candidates(t, 1, include_optional, query, direct_only=True).select(
        "process_type", "role_group", F.col("reagent_id").alias("found_id"))
    df = lookup(df, best, ["process_type", "role_group"])
    # at most two knowledge rows per role feed the notes
    known = knowledge_matches(t, 2, include_optional, query).groupBy("process_type", "role_group").agg(
        F.array_sort(F.collect_list(F.struct("rank", "typical_examples", "guidance"))).alias("known"))
    df = lookup(df, known, ["process_type", "role_group"])
    blank = F.array().cast("array<string>")
    more = F.coalesce(F.flatten(F.transform("known", lambda x: split_list(x["typical_examples"]))), blank)
    examples = distinct_ignoring_case(F.concat("examples", more))
    guidance = F.coalesce(F.get(F.filter(F.transform("known", lambda x: F.trim(x["guidance"])), lambda g: g != ""), F.lit(0)), F.lit(""))
    notes = F.concat_ws(
        " ", F.lit(f"Starter placeholder generated by {generator}; replace with verified reagent identity and physical properties."),
        F.concat(F.lit("Process examples to review: "), F.array_join(F.slice(examples, 1, 6), ", "), F.lit(".")),
        F.when(F.col("fields") != "", F.concat(F.lit("Fill critical fields: "), "fields", F.lit("."))),
        F.when(guidance != "", F.concat(F.lit("Process guidance: "), guidance)))
    auto = F.replace(F.concat(F.lit("AUTO-"), "experiment_id", F.lit("-"), "suffix"), F.lit(" "), F.lit("-"))
    made = F.col("found_id").isNull()
    return df.select(
        "experiment_id", "role_group", F.coalesce("found_id", auto).alias("reagent_id"), made.alias("placeholder"),
        "target_role", "phase", "feed_order", "feed_start_min", "feed_duration_min",
        F.lit(f"Starter row generated by {generator}; enter actual quantity before running.").alias("notes"),
        F.when(made, F.col("name")).alias("reagent_name"), F.when(made, F.col("category")).alias("reagent_category"),
        F.when(made, F.concat("role_group", F.lit(" for "), "process_type")).alias("reagent_role"),
        F.when(made, notes).alias("reagent_notes"))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each item, in order."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def placeholder_reagents(scaffold: DataFrame, reagents: DataFrame) -> DataFrame:
    """Master rows of the placeholders that do not exist yet, in contract columns."""
    rows = scaffold.where("placeholder").select(
        "reagent_id", F.col("reagent_name").alias("name"), F.col("reagent_category").alias("category"),
        F.col("reagent_role").alias("role"), F.lit("TODO verify SDS before use").alias("hazards"),
        F.col("reagent_notes").alias("notes"))
    have = reagents.select(F.trim("reagent_id").alias("reagent_id")).distinct()
    return lookup(rows, have, ["reagent_id"], "left_anti")
