"""Measurement classification, outcome targets and outcome signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .text import contains_any, num_strict, present, text

# ---------------------------------------------------------------------------
# First-pass targets of emulsion polymerization outcomes.
# metric: (label, min, max, units, priority, guidance if low, guidance if high,
#          signals if low, signals if high)
# ---------------------------------------------------------------------------
TARGETS = {
    "particle_size": (
        "particle size target window", 200.0, 350.0, "nm", 3,
        "Confirm the DLS method and sample dilution before optimizing around a very small particle-size value.",
        "Prioritize surfactant active basis, surfactant package, seed/nucleation, or feed duration before changing monomer identity.",
        ["particle_size_low"], ["particle_size_high"],
    ),
    "conversion": (
        "conversion minimum", 85.0, None, "%", 2,
        "Check initiator freshness, purge quality, thermal hold, and chase strategy before interpreting particle-size changes.",
        "", ["low_conversion"], [],
    ),
    "residual_monomer": (
        "residual monomer maximum", None, 1.0, "%", 2, "",
        "Treat high residual monomer as a process-health limitation; verify initiator, purge, temperature profile, hold time, and chase strategy.",
        [], ["residual_monomer_high", "low_conversion"],
    ),
    "polydispersity_index": (
        "DLS PDI maximum", None, 0.2, "", 4, "",
        "Treat broad particle-size distribution as a nucleation/stabilization signal; review surfactant package, seed/nucleation, feed duration, and sample prep.",
        [], ["broad_psd"],
    ),
    "coagulum_mass": (
        "coagulum mass maximum", None, 0.1, "g", 1, "",
        "Treat colloidal stability as the first variable to isolate; compare surfactant package, ionic strength, pH, and feed conditions.",
        [], ["coagulum"],
    ),
}
# signal: texts that raise it when seen in an observation or its issue tags
QUALITATIVE_SIGNALS = {
    "coagulum": ["coagulum", "coagulated", "grit", "phase separation"],
    "low_conversion": ["low_conversion", "low conversion"],
    "residual_monomer_high": ["residual_monomer", "residual monomer"],
    "particle_size_high": ["particle_size_high", "particle size high"],
    "broad_psd": ["broad_psd", "broad psd", "high pdi"],
}
# signal: texts that raise it anywhere in the text of an experiment
ENTRY_TEXT_SIGNALS = {
    "coagulum": ["coagulum", "coagulated", "phase separation"],
    "instability": ["grit", "precipitate"],
    "low_conversion": ["low conversion"],
}
# outcome metrics a strong prediction needs: key and label
PREDICTION_METRICS = {
    "particle_size": "DLS particle size",
    "polydispersity": "PDI or polydispersity index",
    "conversion": "conversion percent",
    "coagulum": "coagulum mass or retained solids",
    "solids": "solids percent",
    "residual_monomer": "residual monomer percent",
}

TARGET_SCHEMA = T.StructType([
    T.StructField("metric_key", T.StringType()),
    T.StructField("target_label", T.StringType()),
    T.StructField("target_min", T.DoubleType()),
    T.StructField("target_max", T.DoubleType()),
    T.StructField("target_units", T.StringType()),
    T.StructField("target_priority", T.IntegerType()),
    T.StructField("guidance_low", T.StringType()),
    T.StructField("guidance_high", T.StringType()),
    T.StructField("signals_low", T.ArrayType(T.StringType())),
    T.StructField("signals_high", T.ArrayType(T.StringType())),
])


def targets_df(spark: SparkSession) -> DataFrame:
    """The five targets as data, so another profile is another row set."""
    return spark.createDataFrame([(k, *v) for k, v in TARGETS.items()], TARGET_SCHEMA)


def is_emulsion(process_type: Column) -> Column:
    p = F.lower(text(process_type))
    return p.contains("emulsion") & p.contains("polymer")


def metric_key(measurement_type: Column, units: Column) -> Column:
    """Ordered substring rules; the first that fits names the metric, else ``''``."""
    t = F.lower(F.concat_ws(" ", text(measurement_type), text(units)))
    return (
        F.when(contains_any(t, ["particle", "dls"]), "particle_size")
        .when(t.contains("conversion"), "conversion")
        .when(t.contains("residual") & t.contains("monomer"), "residual_monomer")
        .when(contains_any(t, ["polydispersity", "pdi"]), "polydispersity_index")
        .when(contains_any(t, ["tg", "glass transition"]), "Tg")
        .when(t.contains("hold time"), "hold_time")
        .when(contains_any(t, ["coagulum", "grit"]), "coagulum_mass")
        .when(t.contains("solids"), "solids")
        .when(t.contains("viscosity"), "viscosity")
        .when(t.contains("ph"), "pH")
        .otherwise("")
    )


def prediction_metric_key(measurement_type: Column, method: Column, units: Column, condition: Column) -> Column:
    """The second classifier, which also looks at method and condition."""
    t = F.lower(F.concat_ws(" ", text(measurement_type), text(method), text(units), text(condition)))
    return (
        F.when(t.contains("dls") | (t.contains("particle") & t.contains("size")), "particle_size")
        .when(contains_any(t, ["polydispersity", "pdi"]), "polydispersity")
        .when(t.contains("conversion"), "conversion")
        .when(contains_any(t, ["coagulum", "retained solid"]), "coagulum")
        .when(t.contains("solid"), "solids")
        .when(t.contains("residual") & t.contains("monomer"), "residual_monomer")
        .otherwise("")
    )


def qualitative_signals(observation: Column, issue_tags: Column) -> Column:
    t = F.lower(F.concat_ws(" ", text(observation), text(issue_tags)))
    return present([(contains_any(t, v), F.lit(k)) for k, v in QUALITATIVE_SIGNALS.items()])


def text_signals(t: Column) -> Column:
    low = F.lower(text(t))
    return present([(contains_any(low, v), F.lit(k)) for k, v in ENTRY_TEXT_SIGNALS.items()])


# The next three give plain arrays with nulls for what does not hold; ``raised`` takes them apart.  Lists cleaned of
# nulls are put together outside generated code, where each condition would build and lower the text of the row anew.

def text_flags(low: Column) -> Column:
    """Signals of a text that is lower-cased already."""
    return F.array(*[F.when(contains_any(low, v), F.lit(k)) for k, v in ENTRY_TEXT_SIGNALS.items()])


def log_row_flags(issue_tags: Column, particle_size: Column, conversion: Column) -> Column:
    """Tags as written plus limits on the structured cells of a log row."""
    return F.concat(F.split(F.lower(text(issue_tags)), ","), F.array(
        F.when(num_strict(particle_size) > 350, "particle_size_high"), F.when(num_strict(conversion) < 85, "low_conversion")))


def result_row_flags(measurement_type: Column, number: Column) -> Column:
    """``measurement_type`` in lower case and the value as a number."""
    m, v = measurement_type, number
    residual = m.contains("residual") & m.contains("monomer") & (v > 1)
    return F.array(
        F.when(contains_any(m, ["particle", "dls"]) & (v > 350), "particle_size_high"),
        F.when(m.contains("conversion") & (v < 85), "low_conversion"),
        F.when(residual, "residual_monomer_high"), F.when(residual, "low_conversion"),
        F.when(contains_any(m, ["polydispersity", "pdi"]) & (v > 0.2), "broad_psd"))


def raised(df: DataFrame, flags: Column) -> DataFrame:
    """(experiment_id, signal) of the flags that hold, spaces around a signal cut off."""
    signals = df.select("experiment_id", F.explode_outer(flags).alias("signal")).withColumn("signal", F.trim("signal"))
    return signals.where("signal <> ''")
