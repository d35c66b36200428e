"""Operator 5: document quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier, fitted on at most `max_labels` labelled rows, gives each document its evidence. The mean
probability of a path is shrunk toward its host's, the host's toward the global mean; the weight of a parent is the
pseudo-count that the method of moments finds from the spread between sites. The posterior log-odds of a document
add its evidence to the log-odds of its path, computed without the document itself.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle

NAMES = ["log_chars", "symbol", "upper", "digit", "mark", "bar", "word_length", "line_length", "repeat"]


def evidence(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` and an array `x` of features of the whole text (null counts as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(*keep, t.alias("_t"))
    n = F.greatest(F.char_length("_t"), F.lit(1))
    share = lambda p: (F.char_length("_t") - F.char_length(F.regexp_replace("_t", p, ""))) / n
    gap = F.char_length("_t") - F.char_length(F.regexp_replace("_t", SPACE, ""))
    lines = F.split("_t", "\n")
    x = F.array(
        F.log1p(F.char_length("_t")), share(r"[#$%&*]+"), share("[A-Z]+"), share("[0-9]+"), share("[!?.,;:]+"), share(r"[|<>]+"),
        F.log1p(n / (gap + 1)), F.log1p(n / F.size(lines)), 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    )
    return one.select(*[k for k in docs.select(*keep).columns], x.cast("array<double>").alias("x"))


def fit(rows: DataFrame, labels: DataFrame, max_labels: int = 5000, target: str = "quality"):
    """Logistic regression on a bounded sample: the `max_labels` labelled rows that come first by hash of the id."""
    known = labels.where(F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    points = rows.select("doc_id", "x").join(F.broadcast(sample), "doc_id")  # max_labels rows at most
    points = points.select("label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(points)
    return LogisticRegression(maxIter=50, regParam=1e-3).fit(vectors)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _pseudo_count(groups: DataFrame, p: str, n: str, parent: Column | str) -> DataFrame:
    """Beta-binomial pseudo-count by the method of moments: one row, from sums over all groups."""
    m = F.col(parent) if isinstance(parent, str) else parent
    noise = F.sum(m * (1 - m)) / F.sum(F.lit(1))
    spread = F.sum(F.col(n) * (F.col(p) - m) ** 2) / F.sum(F.col(n))
    sampling = F.sum(m * (1 - m)) / F.sum(F.col(n))
    between = F.greatest(spread - sampling, F.lit(1e-4))
    return groups.agg(F.least(F.greatest(F.coalesce(noise / between - 1, F.lit(10.0)), F.lit(2.0)), F.lit(10_000.0)).alias("k"))


def score(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text",
    max_labels: int = 5000, weight: float = 0.5, threshold: float = 0.25,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_site (rows of its path), p_document, p_site, p_quality, kept.

    Null host or path form a site of their own; null text counts as empty; without labels of both classes every
    evidence is neutral (0.5); a null id is scored but never trains; repeated rows count each; an empty table gives
    an empty result. `weight` is the share of the site's log-odds that enters (0: document alone).
    """
    keep = [F.col(doc_id).alias("doc_id"), host.cast("string").alias("_host"), path.cast("string").alias("_path")]
    rows = settle(evidence(docs, keep, text), "evidence")
    if labels.where("quality IS NOT NULL").select("quality").distinct().count() > 1 and not rows.limit(1).isEmpty():
        model = fit(rows, labels, max_labels)
        z = sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(model.coefficients)), F.lit(float(model.intercept)))
    else:
        z = F.lit(0.0)
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    rows = rows.select("doc_id", "_host", "_path", p.alias("_p"))
    # rounded to micro-units so that sums don't depend on the order of rows
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum(F.round(F.col("_p") * 1e6).cast("long")).alias("_s"))
    paths = settle(paths, "paths")
    hosts = settle(paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs")), "hosts")
    whole = hosts.agg(F.sum("_hn").alias("n"), F.sum("_hs").alias("s")).first()
    if not whole["n"]:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_site"), F.col("_p").alias("p_document"), F.col("_p").alias("p_site"), F.col("_p").alias("p_quality"), F.lit(True).alias("kept"))
    m0 = whole["s"] / 1e6 / whole["n"]
    hosts = hosts.withColumn("_hp", F.col("_hs") / 1e6 / F.col("_hn"))
    k0 = _pseudo_count(hosts, "_hp", "_hn", F.lit(m0)).first()["k"]
    hosts = hosts.withColumn("_host_mean", (F.col("_hs") / 1e6 + k0 * m0) / (F.col("_hn") + k0))
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host")))
    sites = sites.select(F.col("p._host").alias("_sh"), F.col("p._path").alias("_sp"), "_n", "_s", "_host_mean", (F.col("_s") / 1e6 / F.col("_n")).alias("_pp"))
    sites = settle(sites, "sites")
    k1 = _pseudo_count(sites, "_pp", "_n", "_host_mean").first()["k"]
    # hot paths hold many rows: the join may be split by Spark, the right side has one row a path
    j = rows.join(sites, F.col("_host").eqNullSafe(F.col("_sh")) & F.col("_path").eqNullSafe(F.col("_sp")))
    without = (F.col("_s") / 1e6 - F.col("_p") + k1 * F.col("_host_mean")) / (F.col("_n") - 1 + k1)
    final = _logit(F.col("_p")) + weight * (_logit(without) - _logit(F.lit(m0)))
    j = j.select("doc_id", F.col("_n").alias("n_site"), F.col("_p").alias("p_document"), without.alias("p_site"), (1 / (1 + F.exp(-final))).alias("p_quality"))
    return j.withColumn("kept", F.col("p_quality") >= threshold)
