"""Match decisions over pairs of a product's title and a listing's title (MAT-01, MAT-02, QUA-04..07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linkage as k


_FACTS = ("codes", "specs", "packaging", "folded")


def with_facts(titles: DataFrame, title: str, prefix: str) -> DataFrame:
    """The facts of a title as columns; those of a product's title are found once for all of its listings where they are bound before the join."""
    return titles.select("*", *k.facts(F.col(title), prefix))


def compare(pairs: DataFrame) -> DataFrame:
    """Everything that the decisions need, for pairs (title, listing, own_price, listing_price, ...).

    Pairs are already blocked by product. Facts of a title are bound as columns before anything is compared, so each is
    found once a title and not once for each comparison; pairs that come `with_facts` of "title" (prefix "own_") keep them.
    """
    p = pairs if f"own_{_FACTS[0]}" in pairs.columns else with_facts(pairs, "title", "own_")
    p = with_facts(p, "listing", "its_")
    a, b = ({n: F.col(prefix + n) for n in _FACTS} for prefix in ("own_", "its_"))
    rest = [c for c in p.columns if c not in {prefix + n for n in _FACTS for prefix in ("own_", "its_")}]
    return p.select(*rest, *k.compared(a, b, F.col("own_price"), F.col("listing_price")))


def decisions(compared: DataFrame) -> DataFrame:
    """MAT-01, MAT-02."""
    v = k.decide(*[F.col(c) for c in ("packaging", "relation", "accessory", "conflicting", "specs", "strong", "brand", "price_ok", "share")])
    return compared.withColumn("verdict", v).select("*", "verdict.is_match", "verdict.score", "verdict.reason").drop("verdict")


def purges(compared: DataFrame) -> DataFrame:
    """QUA-06, QUA-07: why a stored listing goes, and the score that one of those that stay keeps."""
    reason = k.should_purge(F.col("packaging"), F.col("listing_price"), F.col("match_score"), F.col("own_price"))
    healed = k.healed_score(F.col("match_score"), F.col("accessory"), F.col("relation"), F.col("strong"), F.col("conflicting"))
    return compared.select("*", reason.alias("purge"), healed.alias("healed_score"))
