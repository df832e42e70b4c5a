"""Writes as data: append rows, cell updates, audits, reconciliation, idempotence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..contract import ROW_KEY, TABLES
from ..functions.joins import lookup
from ..functions.text import nonblank, present, split_list, text
from ..session import cut


def align(df: DataFrame, table: str) -> DataFrame:
    """Contract columns of ``table``; missing cells are blank, nested cells become JSON text, others are dropped."""
    types = dict(df.dtypes)
    cols = []
    for c in [ROW_KEY, *TABLES[table].columns]:
        if c not in types:
            cols.append(F.lit("").alias(c))
        elif types[c].startswith(("struct", "array", "map")):
            cols.append(F.coalesce(F.to_json(c), F.lit("")).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return df.select(*cols)


def append_rows(base: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """``base`` with ``rows`` added, aligned by name."""
    return align(base, table).unionByName(align(rows, table))


def keyed_cells(updates: DataFrame, keys: list[str]) -> DataFrame:
    """One map of field → value per key; the last update of a cell (by ``seq``, if given) wins."""
    order = F.col("seq") if "seq" in updates.columns else F.lit(0)
    last = updates.groupBy(*keys, "field").agg(F.max_by("value", order).alias("value"))
    # at most one entry per contract column
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__cells"))


def apply_updates(df: DataFrame, updates: DataFrame, keys: list[str], first_only: bool = True, written: bool = False) -> DataFrame:
    """Set cells by key.  Unknown fields are ignored; with ``first_only`` only the first row of a key changes.

    With ``written`` the cells are a table of their own: what was shuffled to make them is gone before the rows are.
    """
    cells = keyed_cells(updates, keys)
    if first_only and ROW_KEY not in keys:
        # of every key, updated or not: the cells are looked up once and not computed again
        first = df.groupBy(*keys).agg(F.min(ROW_KEY).alias(ROW_KEY))
        cells = lookup(cells, first, keys, "inner")
        keys = [*keys, ROW_KEY]
    cells = cut(cells) if written else cells
    out = lookup(df, cells, keys)
    return out.select(*[
        F.col(c) if c in keys else F.coalesce(F.try_element_at("__cells", F.lit(c)), F.col(c)).alias(c) for c in df.columns])


def fold_updates(appends: DataFrame, updates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Updates whose key is among the rows to append are applied to them; the others are returned."""
    updates = cut(updates)  # made once for both
    folded = apply_updates(appends, updates, keys, first_only=False, written=True)
    rest = lookup(updates, appends.select(*keys).distinct(), keys, "left_anti")
    return folded, rest


def rows_not_present(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return lookup(rows, existing.select(key).distinct(), [key], "left_anti")


def apply_audit(t: dict[str, DataFrame], appends: dict[str, DataFrame], updates: dict[str, DataFrame]) -> DataFrame:
    """Error rows of a change set: appends that exist, updates without a target.

    ``duplicate_in_batch`` (two appends of the same key) is an extra check.
    """
    out = []
    for name, rows in appends.items():
        table = TABLES[name]
        keys = list(table.key)
        k = rows.select(*[F.trim(text(F.col(c))).alias(c) for c in keys])
        have = t[name].select(*[F.trim(text(F.col(c))).alias(c) for c in keys]).distinct()
        k = k if len(keys) > 1 else k.where(F.col(keys[0]) != "")
        dup = lookup(k, have, keys, "left_semi")
        twice = k.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        for code, df in (("duplicate_append", dup), ("duplicate_in_batch", twice)):
            out.append(df.select(F.lit(code).alias("code"), F.lit(table.title).alias("table_name"),
                                 F.lit(",".join(keys)).alias("key"), F.concat_ws("|", *keys).alias("value")))
    for name, rows in updates.items():
        table = TABLES[name]
        keys = list(table.key)
        k = rows.select(*[F.trim(text(F.col(c))).alias(c) for c in keys])
        k = k if len(keys) > 1 else k.where(F.col(keys[0]) != "")
        have = t[name].select(*[F.trim(text(F.col(c))).alias(c) for c in keys]).distinct()
        out.append(lookup(k, have, keys, "left_anti").select(
            F.lit("missing_update_target").alias("code"), F.lit(table.title).alias("table_name"),
            F.lit(",".join(keys)).alias("key"), F.concat_ws("|", *keys).alias("value")))
    return reduce(DataFrame.unionByName, out)


def batch_signature(rows: DataFrame) -> DataFrame:
    """One row that names a change set whatever its row order: row count and sum of row digests."""
    body = F.concat_ws("\x1f", *[text(F.col(c).cast("string")) for c in sorted(rows.columns)])
    digest = F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("row_count"),
                    F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("signature"))


def linked_ids_update(experiments: DataFrame, linked: DataFrame) -> DataFrame:
    """New value of ``linked_literature_ids`` where the linked evidence adds an id.

    ``linked`` has experiment_id, evidence_id and ``rank``; it is the bounded
    choice of a run (a few rows per experiment).
    """
    new = linked.groupBy("experiment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda x: x["evidence_id"]).alias("new_ids"))
    df = lookup(experiments, new, ["experiment_id"], "inner")
    old = split_list(F.col("linked_literature_ids"))
    value = F.array_join(F.array_distinct(F.concat(old, "new_ids")), ",")
    return df.where(value != F.array_join(old, ",")).select(
        "experiment_id", F.lit("linked_literature_ids").alias("field"), value.alias("value"))


# -- reagents of records ------------------------------------------------------

def reagent_merge(rows: DataFrame) -> DataFrame:
    """One row per reagent id: the first nonblank value of each column."""
    cols = [c for c in TABLES["reagents"].columns if c != "reagent_id"]
    df = rows.withColumn("reagent_id", F.trim("reagent_id")).where(nonblank(F.col("reagent_id")))
    return df.groupBy("reagent_id").agg(F.min(ROW_KEY).alias(ROW_KEY), *[
        F.coalesce(F.min_by(F.when(nonblank(F.col(c)), F.col(c)), F.when(nonblank(F.col(c)), F.col(ROW_KEY))), F.lit("")).alias(c)
        for c in cols])


def reagent_reconcile(merged: DataFrame, reagents: DataFrame) -> DataFrame:
    """(reagent_id, field, action, existing, proposed): append a new reagent, fill a blank cell, or report a conflict."""
    from ..functions.joins import first_rows

    cols = [c for c in TABLES["reagents"].columns if c != "reagent_id"]
    pairs = lambda df: df.select("reagent_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.trim(text(F.col(c))).alias("v")) for c in cols])))
    have = first_rows(reagents.where(nonblank(F.col("reagent_id"))), ["reagent_id"], last=True)
    known = have.select("reagent_id", F.lit(True).alias("known"))
    new = lookup(pairs(merged).where("v <> ''"), known, ["reagent_id"])
    old = pairs(lookup(have, merged.select("reagent_id").distinct(), ["reagent_id"], "left_semi")).withColumnRenamed("v", "existing_value")
    df = lookup(new, old, ["reagent_id", "field"])
    action = (
        F.when(F.col("known").isNull(), "append").when(F.col("existing_value") == "", "fill")
        .when(F.col("existing_value") != F.col("v"), "conflict").otherwise("same"))
    return df.select("reagent_id", "field", action.alias("action"), text(F.col("existing_value")).alias("existing_value"),
                     F.col("v").alias("proposed_value"))


# -- records ------------------------------------------------------------------



def record_rows(records: DataFrame) -> dict[str, DataFrame]:
    """Row sets of experiment records given as JSON text in ``record`` (with ``row_key``).

    Lists may hold objects or bare values, and go by alternate names; defaults
    fill experiment id, sample id, quality flag and timestamp.
    """
    strings = "array<string>"
    top = ("experiment map<string,string>, experiment_id string, timestamp string, date string, "
           "formulations array<string>, formulation array<string>, daily_log array<string>, observations array<string>, "
           "observation array<string>, results array<string>, measurements array<string>")
    r = records.select(ROW_KEY, F.from_json("record", top).alias("r")).select(ROW_KEY, "r.*")
    exp_id = F.coalesce(F.nullif(F.trim("experiment_id"), F.lit("")), F.trim(F.try_element_at("experiment", F.lit("experiment_id"))))
    r = r.withColumn("exp_id", exp_id)
    cell = lambda m, c: text(F.try_element_at(m, F.lit(c)))
    exp = r.select(ROW_KEY, F.col("exp_id").alias("experiment_id"), *[
        cell("experiment", c).alias(c) for c in TABLES["experiments"].columns if c != "experiment_id"])
    items = lambda *names: F.coalesce(*[F.col(n) for n in names], F.array().cast(strings))

    def rows(arr: Column, bare: str | None) -> DataFrame:
        df = r.select(ROW_KEY, "exp_id", "timestamp", "date", F.try_element_at("experiment", F.lit("date")).alias("exp_date"),
                      F.posexplode(arr).alias("pos", "item"))
        m = F.from_json("item", "map<string,string>")
        if bare:
            m = F.when(F.ltrim("item").startswith("{"), m).otherwise(F.map_from_arrays(F.array(F.lit(bare)), F.array("item")))
        return df.withColumn("m", m)

    def table(df: DataFrame, name: str, alias: dict[str, str], fill: dict[str, Column]) -> DataFrame:
        cols = []
        for c in TABLES[name].columns:
            v = F.try_element_at("m", F.lit(c))
            if c in alias:
                v = F.coalesce(v, F.try_element_at("m", F.lit(alias[c])))
            v = text(v)
            if c == "experiment_id":
                v = F.when(nonblank(v), v).otherwise(F.col("exp_id"))
            elif c in fill:
                v = F.when(v != "", v).otherwise(fill[c])
            cols.append(v.alias(c))
        return df.select(F.concat_ws("|", ROW_KEY, F.lpad(F.col("pos").cast("string"), 6, "0")).alias(ROW_KEY), *cols)

    number = F.lpad((F.col("pos") + 1).cast("string"), 3, "0")
    stamp = F.coalesce(*[F.nullif(text(F.col(c)), F.lit("")) for c in ("timestamp", "date", "exp_date")],
                       F.concat(F.lit("recorded-"), number))
    return {
        "experiments": exp,
        "formulations": table(rows(items("formulations", "formulation"), None), "formulations", {}, {}),
        "daily_log": table(rows(items("daily_log", "observations", "observation"), "observation"), "daily_log",
                           {"process_stage": "stage"}, {"timestamp": stamp}),
        "results": table(rows(items("results", "measurements"), "value"), "results",
                         {"measurement_type": "type", "units": "unit"},
                         {"sample_id": F.concat("exp_id", F.lit("-R-"), number), "quality_flag": F.lit("observed")}),
        "reagents": record_reagents(rows(items("formulations", "formulation"), None)),
    }


def record_reagents(items: DataFrame) -> DataFrame:
    """Reagent rows embedded in formulation items, as a nested object or as ``reagent_*`` fields."""
    nested = F.from_json(F.try_element_at("m", F.lit("reagent")), "map<string,string>")
    df = items.withColumn("n", nested)
    cols = []
    for c in TABLES["reagents"].columns:
        own = F.try_element_at("n", F.lit(c))
        other = F.try_element_at("m", F.lit("reagent_id" if c == "reagent_id" else f"reagent_{c}"))
        cols.append(text(F.coalesce(own, F.nullif(other, F.lit("")))).alias(c))
    out = df.select(F.concat_ws("|", ROW_KEY, F.lpad(F.col("pos").cast("string"), 6, "0")).alias(ROW_KEY), *cols)
    data = reduce(lambda a, b: a | b, [nonblank(F.col(c)) for c in TABLES["reagents"].columns if c != "reagent_id"])
    return out.where(nonblank(F.col("reagent_id")) & data)


def record_warnings(rows: dict[str, DataFrame]) -> DataFrame:
    """Rows of the record with blank required cells."""
    out = []
    for name in ("experiments", "reagents", "formulations", "daily_log", "results"):
        table = TABLES[name]
        missing = F.array_join(present([(~nonblank(F.col(c)), F.lit(c)) for c in table.required]), ",")
        out.append(rows[name].select(F.lit(table.title).alias("table_name"), ROW_KEY, missing.alias("missing_fields")).where("missing_fields <> ''"))
    return reduce(DataFrame.unionByName, out)
