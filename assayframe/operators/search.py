"""TF-IDF retrieval: weights, cosine scores and top-k for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..contract import ROW_KEY, SEARCH_TABLES, TABLES
from ..functions.joins import lookup
from ..functions.text import key_values, nonblank, text, words
from ..session import cut


def term_counts(docs: DataFrame, doc: list[str], text_col: str = "text") -> DataFrame:
    """(doc keys, total, token, n): how often each token occurs in each document.

    The documents are placed by key while they are still whole texts.  Their
    exploded tokens, which are several times larger, are then counted where
    they are and never shuffled.
    """
    placed = docs.select(*doc, F.col(text_col).alias("text")).repartition(*doc)
    return (
        placed.select(*doc, words(F.col("text")).alias("w"))
        .select(*doc, F.size("w").alias("total"), F.explode("w").alias("token"))
        .groupBy(*doc, "total", "token").agg(F.count("*").alias("n"))
    )


def inverse_document_frequency(tf: DataFrame, doc_count: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``ln((N + 1) / (df + 1)) + 1`` per token, or per (group, token).

    ``doc_count`` has one row (per group) with ``docs``.
    """
    group = group or []
    df = tf.groupBy(*group, "token").agg(F.count("*").alias("df"))
    df = lookup(df, doc_count, group, "inner") if group else df.crossJoin(F.broadcast(doc_count))  # one row
    return df.select(*group, "token", "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _weighted(tf: DataFrame, idf: DataFrame, group: list[str]) -> DataFrame:
    """Token weights ``n / total * idf``; a token the corpus does not know weighs idf 1."""
    joined = lookup(tf, idf.drop("df"), [*group, "token"])
    return joined.withColumn("w", F.col("n") / F.col("total") * F.coalesce("idf", F.lit(1.0)))


# tokens of all queries up to which every task holds them; pairs of a query and a document that one task adds up
QUERY_TOKENS, TASK_PAIRS = 100_000, 1_000_000
# a token is frequent if it makes up more than one in so many of all (document, token) rows, so there are no more frequent ones than this
FREQUENT = 1 << 15


def score(
    docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", facts: DataFrame | None = None,
) -> DataFrame:
    """Cosine of every (query, document) pair that shares a token.

    ``docs`` and ``queries`` have a key and ``text``; ``facts`` has further columns of some documents, one row per key.
    Only tokens that some query uses leave the index.  Their rows are placed by document first and meet the queries
    there, so pairs are added up where they arise and are not shuffled: a ``top_k`` prunes them inside each task.
    With more query tokens than a task should hold, both sides are joined by token instead.
    """
    tf = cut(term_counts(docs, [doc]))  # read several times below, tokenised once
    idf = cut(inverse_document_frequency(tf, docs.agg(F.count("*").alias("docs"))))
    q = _weighted(term_counts(queries, [query]), idf, [])
    qn = q.groupBy(query).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    # the idf of the document's side of the product is the same for every document
    q = lookup(q.where(F.col("idf").isNotNull()), qn, [query], "inner")
    q = cut(q.select(query, "token", (F.col("w") / F.col("qn") * F.col("idf")).alias("qw")))
    dn = document_norms(tf, idf, doc)
    asked = q.select("token").distinct()
    used = tf.select(doc, "token", (F.col("n") / F.col("total")).alias("share"))
    size = q.agg(F.count("*").alias("tokens"), F.count_distinct(query).alias("queries")).first()
    small = size["tokens"] <= QUERY_TOKENS
    used = used.join(F.broadcast(asked) if small else asked, "token", "left_semi")
    used = lookup(used, dn, [doc], "inner").select(doc, "token", (F.col("share") / F.col("dn")).alias("dw"))
    more = []
    if facts is not None:
        more = [c for c in facts.columns if c != doc]
        used = lookup(used, facts, [doc])
    if small:
        tasks = -(-size["queries"] * dn.count() // TASK_PAIRS)
        hits = used.repartition(max(tasks, 1), doc).join(F.broadcast(q), "token")
    else:
        hits = used.join(q, "token")
    return hits.groupBy(query, doc, *more).agg(F.sum(F.col("qw") * F.col("dw")).alias("score")).where(F.col("score") > 0)


def document_norms(tf: DataFrame, idf: DataFrame, doc: str) -> DataFrame:
    """(doc, dn): length of each document's vector of ``n / total * idf``.

    Most rows of an index belong to few tokens: the idf of those is at hand in every task, only the other rows are
    shuffled to theirs.
    """
    rows = idf.agg(F.sum("df").alias("rows"))  # one row
    split = idf.crossJoin(F.broadcast(rows)).select("token", "idf", (F.col("df") * FREQUENT > F.col("rows")).alias("frequent"))
    frequent = split.where("frequent").select("token", "idf")
    share = F.col("n") / F.col("total")
    squares = lambda df: df.groupBy(doc).agg(F.sum(F.pow(share * F.col("idf"), F.lit(2))).alias("square"))
    rare = tf.join(F.broadcast(frequent), "token", "left_anti")  # at most FREQUENT rows
    parts = squares(tf.join(F.broadcast(frequent), "token")).unionByName(
        squares(lookup(rare, split.where("not frequent").select("token", "idf"), ["token"], "inner")))
    return cut(parts.groupBy(doc).agg(F.sqrt(F.sum("square")).alias("dn")))


def top_k(scored: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """First ``k`` rows per query; Spark prunes to ``k`` inside each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(*ties: str) -> list[Column]:
    """Highest score first, equal to nine digits counts as a tie, then the given columns."""
    return [F.round("score", 9).desc(), *[F.col(c) for c in ties]]


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-``k`` documents per query: (query_id, doc_id, score, rank)."""
    return top_k(score(docs, queries), k, ["query_id"], best("doc_id")).withColumn("score", F.round("score", 4))


# -- notebook rows as documents -----------------------------------------------

# a record id is: table position, row key, owning experiment
SEP = "\x1f"
ID_FIELDS = ("reagent_id", "experiment_id", "evidence_id", "suggestion_id", "sample_id")


def _label(table) -> Column:
    """Label cells of the tables that have a layout for it, else all filled key cells."""
    if table.label:
        return F.trim(F.concat_ws(" ", *[text(F.col(c)) for c in table.label]))
    joined = F.trim(F.concat_ws(" ", *[F.when(nonblank(F.col(c)), F.col(c)) for c in table.search_key]))
    return F.when(joined == "", F.lit(f"{table.title} row")).otherwise(joined)


def filled(columns) -> Column:
    """At least one cell of the row is not blank."""
    return F.expr("trim(concat(" + ", ".join(f"coalesce(`{c}`, '')" for c in columns) + ")) <> ''")


def search_records(t: dict[str, DataFrame], tables: tuple[str, ...] = SEARCH_TABLES) -> DataFrame:
    """One record per notebook row: where it is, a label, and the text the index reads.

    The text holds column names as well as values, and repeats key columns, as
    the ranking of the notebook search is defined on that text.
    """
    out = None
    for pos, name in enumerate(tables):
        table = TABLES[name]
        cols = [(c, c) for c in table.columns]
        keys = [(c, c) for c in table.search_key]
        ids = [F.when(nonblank(F.col(c)), F.concat(F.lit(f"{table.title}:"), c)) for c in ID_FIELDS if c in table.search_key]
        record = F.coalesce(*ids, F.concat(F.lit(f"{table.title}:row-"), ROW_KEY))
        owner = F.col("experiment_id") if name in ("experiments", "daily_log", "formulations", "results") else F.lit("")
        key_text = F.expr("concat_ws(' ', " + ", ".join(f"if(trim({c}) <> '', {c}, null)" for c in table.search_key) + ")")
        row = key_values(cols, skip_blank=True)
        body = F.concat_ws(
            " ", F.lit("record_id"), record, F.lit("sheet"), F.lit(table.title), F.lit("row_number label"), _label(table),
            F.lit("key_fields"), key_values(keys, skip_blank=True), F.lit("row"), row,
            F.lit("search_text"), F.lit(table.title), key_text, row,
        )
        df = t[name].where(filled(table.columns)).select(
            F.concat_ws(SEP, F.lit(f"{pos:02d}"), ROW_KEY, owner).alias("doc_id"), F.lit(table.title).alias("table_name"),
            record.alias("record_id"), _label(table).alias("label"), owner.alias("experiment_id"), body.alias("text"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def notebook_search(t: dict[str, DataFrame], queries: DataFrame, k: int = 10, tables: tuple[str, ...] = SEARCH_TABLES) -> DataFrame:
    """Top-``k`` notebook rows for each (query_id, text)."""
    records = search_records(t, tables)
    return describe(records, tfidf_search(records, queries, k))


def describe(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Add table, record id and label to the few hits; the index itself carries tokens only."""
    return hits.join(records.select("doc_id", "table_name", "record_id", "label"), "doc_id").drop("doc_id")


def context_search(t: dict[str, DataFrame], queries: DataFrame, k: int = 5) -> DataFrame:
    """Top-``k`` notebook rows for each experiment's query, its own rows left out before ranking.

    ``queries`` has ``experiment_id`` and ``text``.  Experiments with the same
    query text are scored once.
    """
    queries = cut(queries.select("experiment_id", "text"))  # read for texts, askers and owners, built once
    distinct = queries.select("text").distinct().withColumn("query_id", F.sha2("text", 256))
    asked = queries.select("experiment_id", F.sha2("text", 256).alias("query_id"))
    records = search_records(t)
    placed = records.select("doc_id", F.get(F.split("doc_id", SEP), F.lit(2)).alias("owner")).distinct()
    # only rows of an experiment that asks a query are ever left out of its answer
    own = asked.groupBy(F.col("experiment_id").alias("owner")).agg(F.collect_set("query_id").alias("own_queries"))
    scored = cut_to_best(score(records.select("doc_id", "text"), distinct, facts=lookup(placed, own, ["owner"])).where("owner is not null"), k)
    mine = asked.join(shortlist(scored, k), "query_id").where(F.col("owner") != F.col("experiment_id"))
    out = top_k(mine, k, ["experiment_id"], best("doc_id")).select("experiment_id", "doc_id", "rank", F.round("score", 4).alias("score"))
    return describe(records, out)


def cut_to_best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of a query among those no asking experiment owns, and the ``k`` best of each owner that asks it."""
    mine = F.array_contains("own_queries", F.col("query_id"))
    owner = F.when(F.coalesce(mine, F.lit(False)), F.col("owner"))
    return cut(top_k(scored.withColumn("asker", owner), k, ["query_id", "asker"], best("doc_id")).drop("rank", "asker", "own_queries"))


def shortlist(per_owner: DataFrame, k: int) -> DataFrame:
    """Rows that can reach the first ``k`` places of any experiment sharing the query.

    An experiment leaves out at most the rows of one owner, and each owner that asks has
    at most ``k`` rows here, so the first ``2k`` rows are enough.
    """
    return top_k(per_owner, 2 * k, ["query_id"], best("doc_id")).drop("rank")
