"""Operator 7: mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(2, exp(lambda * size / mean size)) with one multiplier for each source: the
solution of the convex dual that has the least entropy loss against rate 1 while each source's tokens meet its
target. Newton steps run as grouped aggregations over (source, size, count); the multipliers stay in a table of one
row a source. Rates are then rounded into copies by systematic sampling along the sizes of each source, so a
source's tokens differ from its target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, words

_CAP = 2.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat along the sources in code-point order.

    Water filling: sources whose cap (2 x size) lies below the common level get their cap, the others share the rest
    by weight. One thin row a source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w.cast("double"))
    s = s.withColumn("_cap", _CAP * F.col("source_size"))
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_rank")
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", budget * F.sum("source_size").over(every)).withColumn("_weights", F.sum("_w").over(every))
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    share = F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # the level as it stands if all sources before this one are capped and this one is not
    s = s.withColumn("_level", left / share)
    s = s.withColumn("_open", F.col("_cap") > F.col("_w") * F.col("_level") * (1 + 1e-12))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("v")))).over(every)
    s = s.withColumn("_at", level["v"])
    target = F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_at")), F.col("_cap"))
    return s.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, z: Column) -> Column:
    return F.exp(F.least(lam * z, F.lit(0.6931471805599453)))


def multipliers(cells: DataFrame, goals: DataFrame, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """Newton's method on the dual of every source at once: (source, source_size, target, mean, lambda).

    Each round is one grouped aggregation of gradient and curvature. A step that leaves the bracket known so far is
    replaced by bisection (or by doubling while the bracket is open), so the method cannot diverge. Only the largest
    relative error reaches the driver. A source at its cap has rate 2 throughout; one with target 0 has rate 0.
    """
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(means, goals["source"].eqNullSafe(means["source"])).drop(means["source"])
    ratio = F.col("target") / F.col("source_size")
    state = state.where("source_size > 0").select(
        "source", "source_size", "target", "mean",
        F.when(ratio >= _CAP * (1 - 1e-9), F.lit(1e9)).when(ratio <= 0, F.lit(-1e9)).otherwise(F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        ((ratio >= _CAP * (1 - 1e-9)) | (ratio <= 0)).alias("done"),
    )
    state = settle(state, "multipliers")
    for _ in range(rounds):
        s = state.alias("s")
        z = F.col("c.size") / F.col("s.mean")
        r = _rate(F.col("s.lam"), z)
        open_ = cells.alias("c").join(s, F.col("c.source").eqNullSafe(F.col("s.source")) & ~F.col("s.done"))
        slopes = open_.groupBy(F.col("s.source").alias("k")).agg(
            F.sum(F.col("c.n") * F.col("c.size") * r).alias("got"),
            F.sum(F.when(F.col("s.lam") * z < 0.6931471805599453, F.col("c.n") * F.col("c.size") * z * r).otherwise(0.0)).alias("slope"),
        )
        j = s.join(slopes.alias("g"), F.col("s.source").eqNullSafe(F.col("g.k")), "left")
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.greatest(F.col("lam"), F.coalesce(F.col("lo"), F.col("lam")))).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.least(F.col("lam"), F.coalesce(F.col("hi"), F.col("lam")))).otherwise(F.col("hi"))
        j = j.select("source", "source_size", "target", "mean", "lam", "done", "got", "slope", lo.alias("lo"), hi.alias("hi"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        wide = F.greatest(F.abs(F.col("lam")) * 2, F.lit(1.0))
        safe = (
            F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
            .when(F.col("lo").isNull(), F.col("lam") - wide)
            .otherwise(F.col("lam") + wide)
        )
        # an open bracket may be left by twice the distance at most
        step = F.when(inside & (F.abs(newton - F.col("lam")) <= 4 * wide), newton).otherwise(safe)
        done = F.col("done") | F.coalesce(F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("source_size"), F.lit(False))
        state = settle(
            j.select("source", "source_size", "target", "mean", F.when(done, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", done.alias("done")),
            "multipliers",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, salt: int = 64, keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, copies (0, 1 or 2) and taken = copies * size.

    With `keep`, the columns it names follow doc_id and the results are packed in a struct `mix`, so names never clash.

    Null text has size 0 and no copies beyond its rate; null sources form one source, placed last; a null id is
    allowed; repeated rows are interchangeable; an empty table gives an empty result. The order in which rows of one
    source and size are rounded comes from a hash of id and text, so reruns agree. `salt` splits the rows of one
    size (a group of copies may hold a third of all rows) over that many tasks.
    """
    size = F.size(words(F.col(text))).cast("long")
    order = F.xxhash64(F.col(doc_id), F.col(text))
    kept = F.struct(*[F.col(k) for k in keep]) if keep else F.lit(None)
    thin = docs.select(F.col(doc_id).alias("doc_id"), kept.alias("_keep"), F.col(source).alias("_source"), size.alias("size"), order.alias("_order"))
    thin = thin.withColumn("_salt", F.pmod(F.col("_order"), F.lit(salt)))
    thin = settle(thin, "sizes")
    counts = settle(thin.groupBy(F.col("_source").alias("source"), "size", F.col("_salt").alias("salt")).agg(F.count("*").alias("n")), "cells")
    cells = settle(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "sizes")
    goals = settle(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget), "targets")
    lam = multipliers(cells, goals)
    # expected copies up to each cell, along the sizes of its source
    c = cells.alias("c").join(lam.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source"))).where("size > 0")
    c = c.select("c.source", "size", "n", _rate(F.col("lam"), F.col("size") / F.col("mean")).alias("rate"))
    along = Window.partitionBy("source").orderBy("size")
    upto = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_to", F.round(upto, 6)).withColumn("_from", F.coalesce(F.lag("_to").over(along), F.lit(0.0)))
    base = F.floor(F.round("rate", 9))
    # systematic sampling may start anywhere: of 16 starts, the one whose tokens come nearest to the target
    start = F.explode(F.array(*[F.lit((k + 0.5) / 16) for k in range(16)])).alias("start")
    tried = c.select("source", "size", "n", base.alias("base"), "_from", "_to", start)
    extra = F.floor(F.col("_to") + F.col("start")) - F.floor(F.col("_from") + F.col("start")) - F.col("n") * F.col("base")
    tried = tried.select("source", "size", "n", "base", "start", F.least(F.greatest(extra, F.lit(0)), F.col("n")).alias("extra"))
    got = tried.groupBy("source", "start").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).alias("got")).alias("g")
    got = got.join(goals.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")))
    off = F.abs(F.col("got") - F.col("target"))
    best = got.groupBy(F.col("g.source").alias("b_source")).agg(F.min(F.struct(off, F.col("start"))).alias("b"))
    c = tried.join(best, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("start") == F.col("b.start"))).select("source", "size", "base", "extra")
    # each salted part of a cell starts where the parts before it end
    parts = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    p = counts.withColumn("_first", F.coalesce(F.sum("n").over(parts), F.lit(0))).alias("p")
    p = p.join(c.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size")))
    p = p.select(F.col("p.source").alias("p_source"), F.col("p.size").alias("p_size"), "salt", "_first", "base", "extra")
    nth = F.row_number().over(Window.partitionBy("_source", "size", "_salt").orderBy("_order", "doc_id"))
    d = thin.withColumn("_nth", nth)
    d = d.join(p, F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("_salt") == F.col("salt")), "left")
    copies = F.coalesce(F.col("base") + (F.col("_first") + F.col("_nth") <= F.col("extra")).cast("long"), F.lit(0))
    d = d.select("doc_id", "_keep", "_source", "size", F.least(copies, F.lit(2)).cast("long").alias("copies"))
    out = d.join(F.broadcast(goals) if _small(goals) else goals, d["_source"].eqNullSafe(goals["source"]))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", *([F.struct("size", "source_size", "target", "copies", taken).alias("mix"), "_keep.*"] if keep else ["size", "source_size", "target", "copies", taken]))


def _small(goals: DataFrame, rows: int = 100_000) -> bool:
    """Whether the table of one row a source may be broadcast; beyond that it is joined by shuffle."""
    return goals.limit(rows + 1).count() <= rows
