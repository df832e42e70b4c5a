"""Literature: works to evidence rows, evidence linked to experiments, choice of evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import first_rows, lookup
from ..functions.text import (
    TERM, contains_any, evidence_prefix, key_values, nonblank, padded, present, relevance_terms, short_text, split_list, text, terms, words,
)
from ..rules import (
    CONFIDENCE, EVIDENCE_TAGS, LITERATURE_ADVICE, OFF_PROCESS_TERMS, QUERY_LENGTH, QUERY_PRIORITY,
    QUERY_STOP_WORDS, RANKING_TERMS, WORK_TAGS,
)
from ..session import cut
from .results import row_text
from .search import best, score, term_counts, top_k
from .select import experiments_once


# -- the query of an experiment -----------------------------------------------

def reagent_text() -> Column:
    """Text a formulation row gains from its reagent: the row, then the copied fields."""
    copied = ["name", "common_name", "category", "molecular_weight_g_mol", "density_g_mL",
              "purity_fraction", "concentration", "concentration_units"]
    return F.concat_ws(" ", F.lit("reagent"), row_text("reagents"),
                       key_values([(f"reagent_{c}", c) for c in copied]))


def entry_pieces(t: dict[str, DataFrame], keep: DataFrame | None = None, **reads: Callable[[Column], Column]) -> DataFrame:
    """The text of every experiment in pieces: (experiment_id, section, row_key, text, and a column for each of ``reads``).

    Pieces stay separate rows so that no experiment is ever gathered into one value.  What ``reads`` make of the text that
    a formulation row gains from its reagent is made once per reagent; other pieces gain nothing (NULL).  ``keep`` has one
    row for each experiment that is asked for; with ``enough``, pieces behind that place are left out too.  Rows of others
    are left out before any text is put together.
    """

    def rows(df: DataFrame, section: int) -> DataFrame:
        df = df.withColumn("section", F.lit(section))
        if keep is None or "enough" not in keep.columns:
            return df if keep is None else lookup(df, keep, ["experiment_id"], "left_semi")
        df = lookup(df, keep.select("experiment_id", "enough"), ["experiment_id"], "inner")
        return df.where(F.col("enough").isNull() | (F.struct("section", ROW_KEY) <= F.col("enough")))

    at = ["experiment_id", "section", ROW_KEY]
    head = rows(experiments_once(t), 0).select(*at, F.concat_ws(" ", *[
        text(F.col(c)) for c in ("process_type", "objective", "hypothesis")]).alias("text"))
    reagents = first_rows(t["reagents"].where(nonblank(F.col("reagent_id"))), ["reagent_id"], last=True).select(
        "reagent_id", *[f(reagent_text()).alias(c) for c, f in reads.items()])
    frm = lookup(rows(t["formulations"], 3), reagents, ["reagent_id"]).select(*at, row_text("formulations").alias("text"), *reads)
    for n, i in (("daily_log", 1), ("results", 2)):
        head = head.unionByName(rows(t[n], i).select(*at, row_text(n).alias("text")))
    return head.unionByName(frm, allowMissingColumns=True)


def entry_texts(t: dict[str, DataFrame]) -> DataFrame:
    """The text of every experiment in pieces: (experiment_id, section, row_key, text)."""
    return entry_pieces(t, gained=lambda c: c).select("experiment_id", "section", ROW_KEY, F.concat_ws(" ", "text", "gained").alias("text"))


def _long_terms(c: Column) -> Column:
    """Distinct terms of more than two letters, by first use."""
    return F.filter(F.array_distinct(terms(c)), lambda w: F.length(w) > 2)


def with_gained(own: Column, gained: str) -> Column:
    """An array with what a piece gained behind it."""
    return F.concat(own, F.coalesce(gained, F.array().cast("array<string>")))


def build_queries(t: dict[str, DataFrame], selected: DataFrame | None = None, knowledge: DataFrame | None = None) -> DataFrame:
    """Query text per experiment: priority terms first, then terms by first use, 18 at most.

    ``knowledge`` adds (experiment_id, text) pieces of matched process knowledge.
    Terms are reduced to their first position before any ranking.
    """
    def split(keep: DataFrame | None) -> DataFrame:
        pieces = entry_pieces(t, keep, gained=_long_terms)
        if knowledge is not None:
            told = knowledge.select("experiment_id", F.lit(4).alias("section"), F.col("rank_key").alias(ROW_KEY), "text")
            told = told if keep is None else lookup(told, keep, ["experiment_id"], "inner" if "enough" in keep.columns else "left_semi")
            if keep is not None and "enough" in keep.columns:
                told = told.where(F.col("enough").isNull() | (F.struct("section", ROW_KEY) <= F.col("enough"))).drop("enough")
            pieces = pieces.unionByName(told, allowMissingColumns=True)
        found = pieces.select(
            "experiment_id", F.struct("section", ROW_KEY).alias("at"), F.array_distinct(with_gained(_long_terms(F.col("text")), "gained")).alias("found"))
        # of a piece only its first other terms can come into the query: each later one stands behind all of them
        placed = F.transform("found", lambda w, i: F.struct(i.alias("pos"), w.alias("token")))
        others = F.slice(F.filter(placed, lambda x: ~x["token"].isin(QUERY_PRIORITY)), 1, QUERY_LENGTH)
        return found.select("experiment_id", "at", "found", others.alias("others"))

    priority = reduce(Column.bitwiseOR, [F.when(F.array_contains("found", w), 1 << i).otherwise(0) for i, w in enumerate(QUERY_PRIORITY)])
    # behind the first piece that fills a query by itself no other terms are needed
    seen = split(None if selected is None else cut(selected.select("experiment_id").distinct())).select("experiment_id", "at", "others", priority.alias("priority"))
    seen = seen.groupBy("experiment_id").agg(F.min(F.when(F.size("others") == QUERY_LENGTH, F.col("at"))).alias("enough"), F.bit_or("priority").alias("priority"))
    if selected is None:
        seen = lookup(seen, experiments_once(t).select("experiment_id"), ["experiment_id"], "left_semi")
    seen = cut(seen)
    # terms are looked for again in the pieces up to there only
    ahead = split(seen.select("experiment_id", "enough")).select("experiment_id", "at", F.inline("others"))
    firsts = ahead.groupBy("experiment_id", "token").agg(F.min(F.struct("at.*", "pos")).alias("at")).withColumn("place", F.lit(99))
    # a priority term has a place of its own
    words_of = F.array(*[F.when(F.col("priority").bitwiseAND(1 << i) != 0, F.struct(F.lit(w).alias("token"), F.lit(i + 1).alias("place")))
                         for i, w in enumerate(QUERY_PRIORITY)])
    firsts = firsts.unionByName(seen.select("experiment_id", F.inline(F.array_compact(words_of))), allowMissingColumns=True)
    kept = top_k(firsts, QUERY_LENGTH, ["experiment_id"], [F.col("place"), F.col("at")])
    return kept.groupBy("experiment_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("text"))


# -- works --------------------------------------------------------------------

def search_text() -> Column:
    """Text of a work: title, source, collection, abstract, summary, concepts."""
    return F.concat_ws(" ", *[text(F.col(c)) for c in (
        "title", "source", "journal_or_collection", "abstract", "summary")], F.array_join("concepts", " "))


def work_year() -> Column:
    """Year as given, else from the publication date."""
    from_date = F.regexp_extract(text(F.col("publication_date")), r"^(\d{4})", 1)
    return F.coalesce(F.nullif(text(F.col("year")), F.lit("")), F.nullif(from_date, F.lit("")))


def work_tags(lowered: Column) -> Column:
    return present([(contains_any(lowered, v), F.lit(k)) for k, v in WORK_TAGS.items()])


def doi_url(doi: Column) -> Column:
    d = F.trim(F.regexp_replace(text(doi), "^https://doi.org/", ""))
    return F.when(text(doi) == "", "").otherwise(F.concat(F.lit("https://doi.org/"), d))


def _has_all(arr: Column, *names: str) -> Column:
    out = F.array_contains(arr, names[0])
    for n in names[1:]:
        out = out & F.array_contains(arr, n)
    return out


def work_documents(works: DataFrame) -> DataFrame:
    """(doc_id, text) of the works for the index; record keys are part of the text."""
    identity = F.coalesce(*[F.nullif(text(F.col(c)), F.lit("")) for c in ("work_id", "primary_id", "doi", "url", "title")])
    body = F.concat_ws(
        " ", F.lit("record_id"), identity, F.lit("title"), text(F.col("title")), F.lit("source"), text(F.col("source")),
        F.lit("year"), work_year(), F.lit("journal_or_collection"), text(F.col("journal_or_collection")),
        F.lit("abstract"), text(F.col("abstract")), F.lit("summary"), text(F.col("summary")),
        F.lit("concepts"), F.array_join("concepts", " "), F.lit("search_text"), search_text())
    return works.select(F.col(ROW_KEY).alias("doc_id"), body.alias("text"))


def work_facts(works: DataFrame) -> DataFrame:
    """What the rule score needs to know about a work, whatever the query."""
    df = works.withColumns({"lowered": F.lower(search_text()), "lt": F.lower(text(F.col("title")))})
    df = df.withColumn("terms", F.array_distinct(F.regexp_extract_all("lowered", F.lit(TERM), F.lit(0))))
    low, title, words = F.col("lowered"), F.col("lt"), F.col("terms")
    penalty = F.lit(0.0)
    for w in OFF_PROCESS_TERMS:
        penalty = penalty + F.when(low.contains(w), 1.0).otherwise(0.0)
    off = ~F.array_contains(words, "polymerization")
    phrase = low.contains("emulsion polymerization")
    process = (
        F.when(phrase & title.contains("emulsion polymerization"), 12.0).when(phrase, 8.0)
        .when(_has_all(words, "emulsion", "polymerization"), 4.0).otherwise(0.0))
    return df.select(
        F.col(ROW_KEY).alias("doc_id"), "terms",
        process.alias("base"),
        # taken off when the query asks for a polymerization the work is not about
        F.when(off, F.when(process == 0.0, 4.0).otherwise(0.0) + penalty).otherwise(0.0).alias("off_cost"),
        F.when(low.contains("particle size"), F.when(title.contains("particle size"), 6.0).otherwise(4.0)).otherwise(0.0).alias("size_bonus"),
        F.coalesce(text(F.col("cited_by_count")).try_cast("int"), F.lit(0)).alias("citations"),
        F.coalesce(text(F.col("year")).try_cast("int"), F.lit(0)).alias("year_number"),
    )


def _work_order() -> list[Column]:
    return [F.round("combined", 9).desc(), F.round("semantic", 9).desc(), F.col("lexical").desc(),
            F.col("citations").desc(), F.col("year_number").desc(), F.col("doc_id")]


def rank_works(works: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best works per query (query_id, text) by rule score plus ten times the cosine.

    A work that shares no term and no token with a query still has a rule
    score, but that score depends on the work and on one yes/no of the query
    only, and sharing can only raise it.  So the candidates of a query are the
    works that share something with it and the ``k`` best of the matching
    yes/no list; nothing else can reach the first ``k`` places, and works are
    never crossed with queries.
    """
    facts = work_facts(works)
    q = queries.select("query_id", relevance_terms(F.col("text"), QUERY_STOP_WORDS).alias("qt")).select(
        "query_id", "qt", F.array_contains("qt", "polymerization").alias("asks"), _has_all(F.col("qt"), "particle", "size").alias("asks_size"))
    q_terms = q.select("query_id", F.explode("qt").alias("term"))
    shared = facts.select("doc_id", F.explode("terms").alias("term")).join(q_terms, "term").groupBy("query_id", "doc_id").agg(
        F.count("*").alias("overlap"), F.sum(F.col("term").isin(RANKING_TERMS).cast("int")).alias("special"))
    sem = score(work_documents(works), queries).withColumnRenamed("score", "semantic")
    # the k best works of either answer, for works that share nothing
    plain = facts.select(
        "doc_id", "citations", "year_number", F.lit(0.0).alias("semantic"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"), "base", "off_cost",
    ).withColumn("lexical", F.col("base") - F.when(F.col("asks"), F.col("off_cost")).otherwise(0.0)).withColumn("combined", F.col("lexical"))
    plain = top_k(plain, k, ["asks"], _work_order()).select("asks", "doc_id")
    pairs = (
        shared.select("query_id", "doc_id").unionByName(sem.select("query_id", "doc_id"))
        .unionByName(q.select("query_id", "asks").join(plain, "asks").select("query_id", "doc_id")).distinct()
    )
    df = pairs.join(shared, ["query_id", "doc_id"], "left").join(sem, ["query_id", "doc_id"], "left")
    df = lookup(df, facts.drop("terms"), ["doc_id"], "inner").join(q.drop("qt"), "query_id")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    df = df.withColumns({
        "semantic": n("semantic"),
        "lexical": n("overlap") + F.col("base") - F.when(F.col("asks"), F.col("off_cost")).otherwise(0.0)
        + F.when(F.col("asks_size"), F.col("size_bonus")).otherwise(0.0) + 2.0 * n("special"),
    }).withColumn("combined", F.col("lexical") + 10 * F.col("semantic"))
    return top_k(df, k, ["query_id"], _work_order()).select("query_id", "doc_id", "rank", "semantic", "lexical", "combined")


def evidence_rows(works: DataFrame, queries: DataFrame, k: int = 5, provider: str = "literature") -> DataFrame:
    """Evidence rows for the ``k`` best works of each experiment.

    ``queries`` has ``query_id`` (the experiment id) and ``text``; ``provider``
    names the search service in the texts.
    """
    ranked = rank_works(works, queries, k).withColumnRenamed("doc_id", ROW_KEY)
    df = works.join(ranked, ROW_KEY).join(queries, "query_id")
    lowered = F.lower(search_text())
    q = relevance_terms(F.col("text"), QUERY_STOP_WORDS)
    hits = F.size(F.filter(q, lambda w: F.contains(F.lower(search_text()), w)))
    confidence = (
        F.when(lowered.contains("emulsion polymerization") & (hits >= 4), "high")
        .when(hits >= 3, "medium").otherwise("low"))
    title = F.coalesce(F.nullif(text(F.col("title")), F.lit("")), F.lit("Untitled work"))
    year = F.coalesce(work_year(), F.lit("unknown year"))
    cited = F.when(text(F.col("cited_by_count")) != "", F.concat(F.lit("; cited by "), "cited_by_count")).otherwise("")
    concepts = F.array_join(F.slice("concepts", 1, 5), ", ")
    finding = F.concat(title, F.lit(" ("), year, F.lit(f") is a {provider} hit "), F.when(
        concepts != "", F.concat(F.lit("with concepts: "), concepts)).otherwise("for the experiment query"), cited, F.lit("."))
    return df.select(
        F.col("query_id").alias("experiment_id"),
        F.concat(evidence_prefix(F.col("query_id")), padded(F.col("rank"), 3)).alias("evidence_id"),
        F.coalesce(F.nullif(text(F.col("source")), F.lit("")), F.lit(provider)).alias("source"),
        F.trim(text(F.col("title"))).alias("title"), F.array_join(F.slice("authors", 1, 6), ", ").alias("authors"),
        text(work_year()).alias("year"),
        F.coalesce(*[F.nullif(c, F.lit("")) for c in (text(F.col("url")), doi_url(F.col("doi")), text(F.col("primary_id")))],
                   F.lit("")).alias("doi_or_url"),
        F.col("text").alias("query"), finding.alias("finding"),
        F.array_join(work_tags(lowered), ",").alias("relevance_tags"), confidence.alias("confidence"),
        F.concat(F.lit(f"Imported from {provider} export; review source text before treating as definitive. Local semantic rerank score: "),
                 F.format_string("%.4f", F.round("semantic", 4)), F.lit(".")).alias("notes"),
    )


# -- evidence of an experiment ------------------------------------------------

def evidence_links(t: dict[str, DataFrame]) -> DataFrame:
    """(experiment_id, evidence_id): named in the linked list, or carrying the experiment's id prefix.

    The prefix rule is an equi-join: an evidence id is cut at each of its
    dashes and the pieces are looked up, so no id is compared with every other.
    """
    exp = experiments_once(t).select("experiment_id", "linked_literature_ids")
    ids = t["evidence"].where(nonblank(F.col("evidence_id"))).select(F.trim("evidence_id").alias("evidence_id")).distinct()
    named = exp.select("experiment_id", F.explode(F.array_distinct(split_list(F.col("linked_literature_ids")))).alias("evidence_id"))
    named = lookup(named, ids, ["evidence_id"], "left_semi")
    parts = F.split("evidence_id", "-")
    cuts = ids.select("evidence_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "-"), F.lit("-")))).alias("prefix"))
    cuts = cuts.where(F.col("evidence_id").startswith(F.col("prefix")))
    owners = exp.select("experiment_id", evidence_prefix(F.col("experiment_id")).alias("prefix"))
    owned = cuts.join(owners, "prefix").select("experiment_id", "evidence_id")
    return named.unionByName(owned).distinct()


def evidence_tags() -> Column:
    """Lower-case tags of the cell."""
    return F.array_distinct(F.transform(split_list(F.col("relevance_tags")), lambda x: F.lower(x)))


def tags_or_inferred() -> Column:
    """Tags as written, else inferred from title, finding, query and notes; sorted."""
    explicit = F.array_sort(F.array_distinct(split_list(F.col("relevance_tags"))))
    low = F.lower(F.concat_ws(" ", *[text(F.col(c)) for c in ("title", "finding", "query", "notes")]))
    inferred = F.array_sort(present([(contains_any(low, v), F.lit(k)) for k, v in EVIDENCE_TAGS.items()]))
    return F.when(F.size(explicit) > 0, explicit).otherwise(inferred)


def evidence_once(t: dict[str, DataFrame]) -> DataFrame:
    """Evidence rows with an id, the first row of each id."""
    return first_rows(t["evidence"].where(nonblank(F.col("evidence_id"))), ["evidence_id"])


def linked_evidence(t: dict[str, DataFrame]) -> DataFrame:
    """Evidence rows per experiment, first row of an evidence id."""
    return lookup(evidence_links(t), evidence_once(t), ["evidence_id"], "inner")


def literature_tag_counts(linked: DataFrame) -> DataFrame:
    """(experiment_id, tag, count, rank): most frequent tag first, then by name."""
    tags = linked.select("experiment_id", F.explode(tags_or_inferred()).alias("tag"))
    n = tags.groupBy("experiment_id", "tag").agg(F.count("*").alias("count"))
    w = Window.partitionBy("experiment_id").orderBy(F.col("count").desc(), "tag")
    return n.withColumn("rank", F.row_number().over(w))


def literature_findings(linked: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` supporting findings per experiment, shortened for display."""
    df = linked.withColumn("tags", F.array_join(tags_or_inferred(), ","))
    return top_k(df, k, ["experiment_id"], [F.col(ROW_KEY)]).select(
        "experiment_id", "rank", "evidence_id", short_text(F.col("title"), 140).alias("title"),
        short_text(F.col("finding"), 240).alias("finding"), "tags", "confidence")


def literature_advice(tags: Column) -> Column:
    has = lambda x: F.array_contains(tags, x)
    return present([
        (has("surfactant") & (has("particle_size") | has("stability")), F.lit(LITERATURE_ADVICE["surfactant"])),
        *[(has(k), F.lit(LITERATURE_ADVICE[k])) for k in ("feed", "initiator", "monomer")],
    ])


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), F.lower(F.trim(text(c)))).cast("int")


def evidence_documents(evidence: DataFrame) -> DataFrame:
    """(doc_id, text, terms) of evidence rows, one per id."""
    cols = TABLES["evidence"].columns
    row = key_values([(c, c) for c in cols])
    body = F.concat_ws(" ", row, F.lit("record_id"), "evidence_id", F.lit("search_text"),
                       *[text(F.col(c)) for c in ("title", "finding", "query", "relevance_tags", "notes")])
    return evidence.select(F.col("evidence_id").alias("doc_id"), body.alias("text"), relevance_terms(row, QUERY_STOP_WORDS).alias("terms"))


# what the text of an experiment is about, by what it contains
TEXT_FLAGS = {"x_surf": ["surfactant", "sds"], "x_feed": ["feed"], "x_mono": ["monomer", "acrylate"]}


def asked_texts(t: dict[str, DataFrame], queries: DataFrame, keep: DataFrame) -> DataFrame:
    """Query side of each experiment in ``keep``, in pieces: its query and its whole entry text, with the flags of the latter."""
    keep = cut(keep.select("experiment_id").distinct())
    has = lambda v: lambda c: contains_any(F.lower(c), v)
    entry = entry_pieces(t, keep, gained_words=words, gained_terms=lambda c: relevance_terms(c, QUERY_STOP_WORDS), **{c: has(v) for c, v in TEXT_FLAGS.items()})
    entry = entry.select("experiment_id", "text", "gained_words", "gained_terms", *[
        (has(v)(F.col("text")) | F.coalesce(c, F.lit(False))).alias(c) for c, v in TEXT_FLAGS.items()])
    # assembled once, read for token counts, terms and flags
    return cut(entry.unionByName(lookup(queries.select("experiment_id", "text"), keep, ["experiment_id"], "left_semi"), allowMissingColumns=True))


# linked rows of an experiment up to which its tokens stay in one part
GROUP_DOCS = 4096
# before a token that is a term; no word begins with it
AS_TERM = ":"


def same_links(links: DataFrame) -> DataFrame:
    """(experiment_id, docs, group): number of links, and the first experiment that links just the same rows.

    Rows are compared by their number and two sums of 64-bit digests, so no list of links is put together.
    """
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id").cast("decimal(20,0)"))
    per = cut(links.groupBy("experiment_id").agg(F.count("*").alias("docs"), digest(1).alias("d1"), digest(2).alias("d2")))
    first = per.groupBy("docs", "d1", "d2").agg(F.min("experiment_id").alias("group"))
    return cut(lookup(per, first, ["docs", "d1", "d2"], "inner").select("experiment_id", "docs", "group"))


def group_weights(links: DataFrame, docs: DataFrame, n_links: DataFrame, asked: DataFrame, with_terms: bool) -> DataFrame:
    """(group, doc_id, token, idf, weight) of the tokens that an experiment of the group asks, and a row without token and with ``square`` for each link.

    The tokens of a document travel as one list per link of a group, and each pair of group and token is met once, in a
    window of at most as many rows as the group has links, besides one that says it is asked.  A group with many links is
    dealt over parts by token.
    """
    parts = F.ceil(F.col("docs") / GROUP_DOCS).cast("int")
    item = lambda token, n: F.struct(token.alias("token"), n.alias("n"))
    counts = term_counts(docs, ["doc_id"]).groupBy("doc_id").agg(F.collect_list(item(F.col("token"), F.col("n"))).alias("items"))
    held = counts
    if with_terms:
        named = docs.select("doc_id", F.transform("terms", lambda x: item(F.concat(F.lit(AS_TERM), x), F.lit(1).cast("bigint"))).alias("named"))
        held = lookup(named, counts, ["doc_id"]).select("doc_id", F.concat(F.coalesce("items", F.array().cast(counts.schema["items"].dataType)), "named").alias("items"))
    own = n_links.where(F.col("experiment_id") == F.col("group")).select("experiment_id", "docs")
    mine = lookup(lookup(links.select("experiment_id", "doc_id"), own, ["experiment_id"], "inner"), cut(held), ["doc_id"], "inner")
    # few links: the whole list; many: each token by itself
    mine = mine.select(F.col("experiment_id").alias("group"), "doc_id", "docs", F.explode(
        F.when(parts == 1, F.array("items")).otherwise(F.transform("items", lambda x: F.array(x)))).alias("items"))
    some = lookup(asked.select("group", "token").distinct(), own.withColumnRenamed("experiment_id", "group"), ["group"], "inner").select(
        "group", F.lit(None).cast("string").alias("doc_id"), "docs", F.array(item(F.col("token"), F.lit(0).cast("bigint"))).alias("items"))
    part = F.when(parts == 1, 0).otherwise(F.pmod(F.hash(F.get("items", F.lit(0))["token"]), parts))
    met = mine.unionByName(some).withColumn("part", part).repartition("group", "part").select("group", "part", "doc_id", "docs", F.inline("items"))
    w = Window.partitionBy("group", "part", "token")
    met = met.withColumns({"df": F.count("doc_id").over(w), "rows": F.count("*").over(w)}).where("doc_id is not null")
    word = ~F.col("token").startswith(AS_TERM)
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    met = met.select("group", "doc_id", "token", "n", F.when(word, idf).alias("idf"), (F.col("rows") > F.col("df")).alias("asked"))
    none = F.lit(None).cast("double")
    length = F.struct(F.lit(None).cast("string").alias("token"), none.alias("idf"), none.alias("weight"), F.pow(F.col("n") * F.col("idf"), F.lit(2)).alias("square"))
    shared = F.struct("token", "idf", F.coalesce(F.col("n") * F.col("idf") * F.col("idf"), F.lit(1.0)).alias("weight"), none.alias("square"))
    met = met.select("group", "doc_id", F.inline(F.when(F.col("asked"), F.array(length, shared)).otherwise(F.array(length))))
    return cut(met.groupBy("group", "doc_id", "token").agg(F.max("idf").alias("idf"), F.sum("weight").alias("weight"), F.sum("square").alias("square")))


def group_scores(links: DataFrame, docs: DataFrame, pieces: DataFrame, with_terms: bool = False) -> DataFrame:
    """(experiment_id, doc_id, score, shared) of each link: cosine with the text of its experiment and, ``with_terms``, number of shared terms.

    ``docs`` has (doc_id, text, terms), one row per id, and is tokenised once however many experiments link it; idf is
    taken per experiment.  Experiments that link the same rows have the same idf, so weights are made once for all of
    them, and an experiment brings the counts of its own text only.  Text lengths cancel out of the cosine.
    """
    n_links = same_links(links)
    more = lambda own, c: with_gained(own, c) if c in pieces.columns else own
    read = more(words(F.col("text")), "gained_words")
    if with_terms:
        read = F.concat(read, F.transform(more(relevance_terms(F.col("text"), QUERY_STOP_WORDS), "gained_terms"), lambda x: F.concat(F.lit(AS_TERM), x)))
    asked = pieces.select("experiment_id", F.explode(read).alias("token")).groupBy("experiment_id", "token").agg(F.count("*").alias("n"))
    asked = cut(lookup(asked, n_links, ["experiment_id"], "inner").select("experiment_id", "group", "token", "n"))
    weights = group_weights(links, docs, n_links, asked, with_terms)
    used = weights.where("token is not null")
    # a token no linked row holds weighs 1
    idfs = used.where("idf is not null").groupBy("group", "token").agg((F.pow(F.max("idf"), F.lit(2)) - 1).alias("weight"))
    used = used.select("group", "doc_id", "token", "weight").unionByName(idfs.withColumn("doc_id", F.lit(None).cast("string")), allowMissingColumns=True)
    word, n = ~F.col("token").startswith(AS_TERM), F.col("n").cast("double")
    hits = lookup(asked, used, ["group", "token"], "inner").select(
        "experiment_id", "doc_id", F.when(word, F.when(F.col("doc_id").isNull(), n * n).otherwise(n) * F.col("weight")).alias("dot"), (~word).cast("bigint").alias("shared"))
    squares = asked.where(word).select("experiment_id", F.lit(None).cast("string").alias("doc_id"), (n * n).alias("dot"), F.lit(0).cast("bigint").alias("shared"))
    sums = cut(hits.unionByName(squares).groupBy("experiment_id", "doc_id").agg(F.sum("dot").alias("dot"), F.sum("shared").alias("shared")))
    lengths = weights.where("token is null").select("group", "doc_id", F.sqrt("square").alias("norm"))
    out = lookup(links.select("experiment_id", "doc_id"), n_links.select("experiment_id", "group"), ["experiment_id"], "inner")
    out = lookup(out, lengths, ["group", "doc_id"], "inner")
    out = lookup(out, sums.where("doc_id is not null"), ["experiment_id", "doc_id"])
    out = lookup(out, sums.where("doc_id is null").select("experiment_id", F.sqrt("dot").alias("qn")), ["experiment_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("experiment_id", "doc_id", (zero("dot") / (F.col("norm") * F.col("qn"))).alias("score"), zero("shared").alias("shared"))


def evidence_matches(t: dict[str, DataFrame], queries: DataFrame, linked: DataFrame, k: int = 3) -> DataFrame:
    """Top-``k`` linked evidence rows per experiment by cosine with its query and entry text."""
    links = cut(linked.select("experiment_id", F.col("evidence_id").alias("doc_id"), ROW_KEY))
    s = group_scores(links, evidence_documents(evidence_once(t)), asked_texts(t, queries, links)).where(F.col("score") > 0)
    return top_k(lookup(s, links, ["experiment_id", "doc_id"], "inner"), k, ["experiment_id"], best(ROW_KEY)).select(
        "experiment_id", "rank", F.col("doc_id").alias("evidence_id"), F.round("score", 4).alias("score"))


def evidence_select(
    t: dict[str, DataFrame], queries: DataFrame, linked: DataFrame, signals: DataFrame, k: int = 3
) -> DataFrame:
    """The ``k`` linked evidence rows per experiment by tags, cosine, shared terms and confidence."""
    # long texts are looked up once per evidence row for the score, and again for the chosen rows only
    links = cut(linked.select("experiment_id", "evidence_id", ROW_KEY, "relevance_tags", "confidence"))
    pieces = asked_texts(t, queries, links)
    sem = group_scores(links.withColumnRenamed("evidence_id", "doc_id"), evidence_documents(evidence_once(t)), pieces, with_terms=True)
    # signal tags: five flags per experiment from its signals and its text
    s = signals.groupBy("experiment_id").agg(*[
        F.max(F.col("signal").isin(v).cast("int")).alias(k2) for k2, v in (
            ("s_size", ["particle_size_high", "broad_psd"]), ("s_stab", ["coagulum", "instability"]),
            ("s_init", ["low_conversion", "residual_monomer_high"]))])
    x = pieces.groupBy("experiment_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in TEXT_FLAGS])
    tags = evidence_tags()
    df = lookup(lookup(links, s, ["experiment_id"]), x, ["experiment_id"])
    df = lookup(df, sem.withColumnsRenamed({"doc_id": "evidence_id", "score": "semantic"}), ["experiment_id", "evidence_id"])
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    wanted = present([(flag(c), F.lit(tag)) for c, tag in (
        ("s_size", "particle_size"), ("s_stab", "stability"), ("s_init", "initiator"),
        ("x_surf", "surfactant"), ("x_feed", "feed"), ("x_mono", "monomer"))])
    total = (
        8.0 * F.size(F.array_intersect(tags, wanted)) + 10.0 * F.coalesce("semantic", F.lit(0.0))
        + 2.0 * F.coalesce("shared", F.lit(0)) + 1.5 * confidence_rank(F.col("confidence")) + 0.25 * F.size(tags))
    chosen = top_k(df.withColumn("score", total), k, ["experiment_id"], best(ROW_KEY)).select(
        "experiment_id", "rank", "evidence_id", F.round("score", 4).alias("score"), "relevance_tags", "confidence", ROW_KEY)
    return lookup(chosen, evidence_once(t).select("evidence_id", "title", "finding", "query", "notes"), ["evidence_id"], "inner").select(
        "experiment_id", "rank", "evidence_id", "score", "title", "finding", "query", "notes",
        "relevance_tags", "confidence", ROW_KEY)
