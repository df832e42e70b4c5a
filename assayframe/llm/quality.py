"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document is the classifier's log odds of good quality.  Hosts and paths get
posterior rates of good documents from grouped sums of these probabilities: a host's rate is shrunk toward
the global one, a path's toward its host's, each by a strength that the method of
moments estimates from the spread between groups, so sparse sites stay near the prior above them.
A document's posterior odds are its own evidence (its odds over those of the fitting sample) times the odds
of its path, from which its own share is taken out.

Nulls: a null text is an empty one; null hosts and paths are groups of their own (named ''); a null doc_id is
kept and judged.  Repeated rows are judged each.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.classifier import fit, predict
from assayframe.session import cut

#: Least posterior probability of good quality of a document that is kept.
THRESHOLD = 0.5
#: Bounds of the strength of a prior, in documents.
LEAST, MOST = 2.0, 10_000.0


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by the method of moments from groups with sums ``n`` and ``k`` around ``mean``."""
    m = mean * (1 - mean)
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(m).alias("noise"), F.sum(F.col("n") * m).alias("within"),
        F.sum(F.col("n") * (F.col("k") / F.col("n") - mean) ** 2).alias("between"),
    ).first()
    if not row["n"]:
        return MOST
    between = (row["between"] - row["noise"]) / row["n"]
    return MOST if between <= 0 else min(MOST, max(LEAST, row["within"] / row["n"] / between - 1))


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, evidence, priors, posterior and verdict of each row of ``docs``.

    ``labels``: doc_id and quality (1 good, 0 bad).  ``host`` and ``path`` are expressions over ``docs``.
    """
    model = fit(docs, labels.select("doc_id", F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).alias("y")), 2)
    sites = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    scored = cut(predict(sites, model, ("host", "path")).withColumn("evidence", F.get("p", F.lit(1))).drop("p"))
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("k")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = paths.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.5)).alias("m")).first()["m"]
    strength = _strength(hosts, F.lit(everything))
    shrunk = hosts.select("host", F.col("n").alias("host_docs"), ((F.lit(strength * everything) + F.col("k")) / (strength + F.col("n"))).alias("host_rate"))
    below = cut(paths.join(shrunk, "host"))
    path_strength = _strength(below, F.col("host_rate"))
    joined = scored.join(below, ["host", "path"])
    rate = (path_strength * F.col("host_rate") + F.col("k") - F.col("evidence")) / (path_strength + F.col("n") - 1)
    base = float(model.shares[1])
    total = _odds(F.col("evidence")) - _odds(F.lit(base)) + _odds(rate)
    posterior = 1 / (1 + F.exp(-total))
    return joined.select(
        "doc_id", "host", "path", "n_words", "evidence", "host_docs", F.col("n").alias("path_docs"), "host_rate", rate.alias("path_rate"),
        posterior.alias("posterior"), (posterior >= THRESHOLD).alias("kept"),
    )
