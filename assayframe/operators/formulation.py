"""Formulation quantities: reagent enrichment, derived amounts, weight percent, cell updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..contract import ROW_KEY
from ..functions.joins import first_rows, lookup
from ..functions.text import round6
from ..functions.text import (
    blank_to_null, exact_sum, fmt6, nonblank, num_first_token, num_fraction, present, text,
)
from ..functions.units import norm_units, to_fraction, to_mass_concentration, to_molarity
from ..rules import MOLES_GAP, VOLUME_GAP, WRITTEN_QUANTITIES

REAGENT_FIELDS = [
    "name", "common_name", "category", "role", "molecular_weight_g_mol", "density_g_mL",
    "purity_fraction", "concentration", "concentration_units", "hazards", "notes",
]


def enrich(formulations: DataFrame, reagents: DataFrame, fields: list[str] = REAGENT_FIELDS, numbers: bool = False) -> DataFrame:
    """Formulation rows with ``reagent_<field>`` columns; the last row of a reagent id wins.

    With ``numbers`` the cells that ``derive_quantities`` reads are parsed once per reagent and come along.
    """
    dim = first_rows(
        reagents.where(nonblank(F.col("reagent_id"))).select(ROW_KEY, "reagent_id", *fields),
        ["reagent_id"], last=True,
    ).select("reagent_id", *[F.col(f).alias(f"reagent_{f}") for f in fields],
             F.lit(True).alias("has_reagent"))
    return lookup(formulations, dim.withColumns(reagent_numbers()) if numbers else dim, ["reagent_id"])


def reagent_numbers() -> dict[str, Column]:
    """Parsed cells of a reagent."""
    c = lambda f: F.col(f"reagent_{f}")
    return {
        "__mw": num_first_token(c("molecular_weight_g_mol")), "__density": num_first_token(c("density_g_mL")),
        "__purity": num_fraction(c("purity_fraction")), "__stock": num_first_token(c("concentration")),
        "__stock_units": blank_to_null(c("concentration_units")),
    }


def derive_quantities(enriched: DataFrame) -> DataFrame:
    """Mass, volume, moles and active mass from whatever was entered.

    Adds ``obs_*`` (entered numbers), ``calc_*`` (working values), ``derived_*``
    (values that were computed, rounded to 6) and ``missing_for_calculations``.
    Steps are separate projections because each step reads the results of the
    one before.
    """
    c = F.col
    parsed = reagent_numbers()
    if "__mw" not in enriched.columns:
        enriched = enriched.withColumns(parsed)
    df = enriched.withColumns({
        "obs_mass_g": num_first_token(c("mass_g")),
        "obs_volume_mL": num_first_token(c("volume_mL")),
        "obs_moles_mmol": num_first_token(c("moles_mmol")),
        "mw": c("__mw"),
        "density": c("__density"),
        "purity": F.coalesce(c("__purity"), F.lit(1.0)),
        "stock": F.coalesce(num_first_token(c("concentration")), c("__stock")),
        "stock_units": F.coalesce(blank_to_null(c("concentration_units")), c("__stock_units")),
    })
    df = df.withColumn("unit", norm_units(c("stock_units")))
    df = df.withColumns({
        "molarity": to_molarity(c("stock"), c("unit")),
        "mass_conc": to_mass_concentration(c("stock"), c("unit")),
        "fraction": to_fraction(c("stock"), c("unit")),
    })
    # amount of substance from a stock of known molarity
    by_molarity = c("obs_moles_mmol").isNull() & c("obs_volume_mL").isNotNull() & c("molarity").isNotNull()
    df = df.withColumns({
        "n1": F.when(by_molarity, c("obs_volume_mL") * c("molarity")).otherwise(c("obs_moles_mmol")),
        "stk1": by_molarity,
    })
    # active mass from a stock of known mass concentration
    by_mass = c("obs_volume_mL").isNotNull() & c("mass_conc").isNotNull()
    df = df.withColumns({
        "act2": F.when(by_mass, c("obs_volume_mL") * c("mass_conc")).when(c("stk1"), c("n1") / 1000 * c("mw")),
    })
    by_active = by_mass & c("n1").isNull() & c("mw").isNotNull()
    df = df.withColumns({
        "n2": F.when(by_active, F.try_divide(c("act2"), c("mw")) * 1000).otherwise(c("n1")),
        "stk2": c("stk1") | by_active,
        # density turns a volume into a mass …
        "m3": F.coalesce(c("obs_mass_g"), c("obs_volume_mL") * c("density")),
    })
    # … and a mass into a volume
    df = df.withColumns({"v4": F.coalesce(c("obs_volume_mL"), F.try_divide(c("m3"), c("density")))})
    # moles from mass: stock, then mass fraction, then purity; unknown stock units block it
    by_weight = c("n2").isNull() & c("m3").isNotNull() & c("mw").isNotNull()
    blocked = c("stock").isNotNull() & c("stock_units").isNotNull()
    df = df.withColumns({
        "act5": F.when(
            by_weight,
            F.when(c("act2").isNotNull(), c("act2"))
            .when(c("fraction").isNotNull(), c("m3") * c("fraction"))
            .when(~blocked, c("m3") * c("purity")),
        ),
        "act5_reported": by_weight & c("act2").isNull()
        & (c("fraction").isNotNull() | (~blocked & (c("purity") != 1.0))),
    })
    df = df.withColumns({"n5": F.coalesce(c("n2"), F.try_divide(c("act5"), c("mw")) * 1000)})
    # mass from moles, unless the moles came from a stock volume
    by_moles = c("m3").isNull() & c("n5").isNotNull() & c("mw").isNotNull() & ~c("stk2")
    df = df.withColumns({
        "act6": F.when(by_moles, c("n5") / 1000 * c("mw")),
        "act6_reported": by_moles & (c("fraction").isNotNull() | (c("purity") != 1.0)),
    })
    df = df.withColumns({
        "calc_mass_g": F.coalesce(c("m3"), F.try_divide(c("act6"), F.coalesce(c("fraction"), c("purity")))),
        "calc_moles_mmol": c("n5"),
        "calc_active_g": F.when(c("act6_reported"), c("act6"))
        .when(c("act5_reported"), c("act5")).otherwise(c("act2")),
    })
    df = df.withColumns({"calc_volume_mL": F.coalesce(c("v4"), F.try_divide(c("calc_mass_g"), c("density")))})
    role = text(c("target_role"))
    needs_moles = F.lit(False)
    for r in ["monomer", "initiator", "surfactant", "crosslinker"]:
        needs_moles = needs_moles | role.contains(r)
    df = df.withColumns({
        "derived_mass_g": F.when(c("obs_mass_g").isNull(), round6(c("calc_mass_g"))),
        "derived_volume_mL": F.when(c("obs_volume_mL").isNull(), round6(c("calc_volume_mL"))),
        "derived_moles_mmol": F.when(c("obs_moles_mmol").isNull(), round6(c("calc_moles_mmol"))),
        "derived_active_mass_g": round6(c("calc_active_g")),
        "__moles_gap": needs_moles & c("calc_moles_mmol").isNull(),
        "__volume_gap": role.contains("monomer") & c("calc_volume_mL").isNull(),
    })
    # handed over through a generator: a later filter on a derived column stays
    # above this point instead of being unfolded into the whole derivation
    out = ["obs_mass_g", "obs_volume_mL", "obs_moles_mmol", "mw", "density", "purity", "stock", "stock_units",
           "derived_mass_g", "derived_volume_mL", "derived_moles_mmol", "derived_active_mass_g"]
    df = df.select(*[x for x in enriched.columns if x not in parsed], F.inline(F.array(F.struct(*out, "__moles_gap", "__volume_gap"))))
    # a list is put together row by row: behind the generator it is left out where nobody reads it
    gaps = present([(c("__moles_gap"), F.lit(MOLES_GAP)), (c("__volume_gap"), F.lit(VOLUME_GAP))])
    return df.withColumn("missing_for_calculations", gaps).drop("__moles_gap", "__volume_gap")


def row_mass() -> Column:
    """Entered mass, or the derived one where nothing (or zero) was entered."""
    return F.coalesce(F.nullif(F.col("obs_mass_g"), F.lit(0.0)), F.nullif(F.col("derived_mass_g"), F.lit(0.0)))


def mass_totals(derived: DataFrame) -> DataFrame:
    """Formulation mass per experiment where at least two rows have a positive mass."""
    m = F.when(row_mass() > 0, row_mass())
    return (
        derived.groupBy("experiment_id")
        .agg(F.count(m).alias("mass_rows"), exact_sum(m).alias("mass_total"))
        .where((F.col("mass_rows") >= 2) & (F.col("mass_total") > 0))
        .select("experiment_id", "mass_total")
    )


def formulation_quantities(t: dict[str, DataFrame]) -> DataFrame:
    """Every formulation row with its derived amounts and weight percent.

    Totals are a pre-aggregated ``groupBy`` joined back, not a window, so one
    experiment that owns a large part of all rows is still spread over tasks.
    """
    derived = derive_quantities(enrich(t["formulations"], t["reagents"], numbers=True))
    df = lookup(derived, mass_totals(derived), ["experiment_id"])
    return df.withColumns({
        "formulation_mass_total_g": F.when(row_mass().isNotNull(), round6(F.col("mass_total"))),
        "derived_wt_percent": round6(row_mass() / F.col("mass_total") * 100),
    }).drop("mass_total")


def update_candidates(quantities: DataFrame) -> DataFrame:
    """(row, field) pairs whose cell is blank, with the derived value (NULL: not enough inputs)."""
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("field_pos"), F.lit(f).alias("field"),
            nonblank(F.col(f)).alias("filled"), F.col(f"derived_{f}").alias("number"),
        )
        for i, f in enumerate(WRITTEN_QUANTITIES)
    ])
    return (
        quantities.select(ROW_KEY, "experiment_id", "reagent_id", "target_role", F.inline(cells))
        .where(~F.col("filled"))
        .drop("filled")
    )


def formulation_updates(t: dict[str, DataFrame], selected: DataFrame | None = None) -> DataFrame:
    """Cell updates, one per (experiment, reagent, role, field): the first blank row wins.

    ``duplicate_cells`` counts later rows with the same key, which are skipped.
    """
    q = formulation_quantities(restrict(t, "formulations", selected))
    return (
        update_candidates(q)
        .where(F.col("number").isNotNull())
        .withColumn("value", fmt6(F.col("number")))
        .groupBy("experiment_id", "reagent_id", "target_role", "field")
        .agg(F.min_by("value", ROW_KEY).alias("value"), (F.count("*") - 1).alias("duplicate_cells"),
             F.min(ROW_KEY).alias(ROW_KEY))
    )


def formulation_update_summary(t: dict[str, DataFrame], selected: DataFrame | None = None) -> DataFrame:
    """Counts of the update report per experiment."""
    t = restrict(t, "formulations", selected)
    q = formulation_quantities(t)
    cand = update_candidates(q)
    per_key = (
        cand.groupBy("experiment_id", "reagent_id", "target_role", "field")
        .agg(F.count("number").alias("eligible"), F.count("*").alias("blank"))
        .groupBy("experiment_id")
        .agg(
            F.sum(F.when(F.col("eligible") > 0, 1).otherwise(0)).alias("cells_to_update"),
            F.sum(F.col("blank") - F.when(F.col("eligible") > 0, 1).otherwise(0)).alias("fields_skipped"),
        )
    )
    rows = t["formulations"].groupBy("experiment_id").agg(F.count("*").alias("rows_considered"))
    return lookup(rows, per_key, ["experiment_id"]).select(
        "experiment_id",
        F.col("rows_considered").cast("bigint").alias("rows_considered"),
        F.coalesce("cells_to_update", F.lit(0)).cast("bigint").alias("cells_to_update"),
        F.coalesce("fields_skipped", F.lit(0)).cast("bigint").alias("fields_skipped"),
    )


def restrict(t: dict[str, DataFrame], name: str, selected: DataFrame | None) -> dict[str, DataFrame]:
    """Tables with one table limited to the selected experiments."""
    if selected is None:
        return t
    keep = selected.select("experiment_id").distinct()
    return {**t, name: lookup(t[name], keep, ["experiment_id"], "left_semi")}
