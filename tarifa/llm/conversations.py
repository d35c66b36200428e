"""Operator 13: conversation structure repair by Wagner-Fischer alignment with the alternating grammar.

A repaired conversation's role initials read `(s?(ua)+)?`. All strings of that grammar of one length are one string, so
the turns of a conversation are aligned with each length that can still be cheapest: an incumbent (of a plain walk along
the turns) bounds how many turns a cheapest alignment can delete or insert, hence the lengths to try and, for each, an
Ukkonen band around the diagonal. Alignments of equal cost are compared by their backtraced audits.

Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3 (required for blank and duplicate turns), Insert (an empty
turn of user or assistant) 2; a truncated turn that stays adds 1.

Turns are ordered by Spark (turn, nulls first, then role and text) and numbered. Only initials and faults go through the
alignment, a few bytes a turn and one conversation at a time; texts meet their edits again by conversation and number,
and are hashed in order, batch by batch. A conversation of more than `whole` turns has the columns of its table folded by
the period of the grammar (after s, u or a), which gives the same cost and audit in time linear in its turns.

Defined results: null roles and texts count as one space, null turns come first, a null conv_id is one conversation;
a role without an initial can't be kept; repeated rows are rows of their own; a conversation without rows has zeros, an
empty audit and nothing repaired; empty tables give no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_FAR = 1 << 60

#: A turn for the alignment: its role's initial, whether it must go, what it costs to keep.
Turn = tuple[str, bool, int]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the contract's damage, by CRC-32 of `conv_id:turn` modulo 20; nulls become one space first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    rows = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_copy")


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, n (1, 2, ...), turn, role, text, initial, fault (blank, duplicate, truncated or null), first (of its turn number) and illegal (after the turn before)."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turn = F.asc_nulls_first("turn")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(turn))
    told = clean.withColumn("again", again)
    order = Window.partitionBy("conv_id").orderBy(turn, "role", "text", "again")
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", "blank").when(F.col("again") > 1, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    before = F.lag("turn").over(order)
    pair = F.concat(F.lag(initial).over(order), initial)
    return told.select(
        "conv_id", F.row_number().over(order).cast("long").alias("n"), "turn", "role", "text", initial.alias("initial"), fault.alias("fault"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before)).alias("first"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def target(length: int) -> str:
    """The grammar's string of a length; there is none of length 1."""
    return "s" * (length % 2) + "ua" * (length // 2)


def incumbent(turns: list[Turn]) -> int:
    """The cost of a walk: what must go is deleted, each other turn kept or reroled in turn, one inserted if the last is missing."""
    cost, want, kept = 0, "u", 0
    for initial, gone, flaw in turns:
        if gone:
            cost += DELETE
        elif initial == "s" and not kept:
            cost, kept = cost + flaw, 1
        else:
            cost, kept = cost + flaw + (KEEP if initial == want else REROLE), kept + 1
            want = "a" if want == "u" else "u"
    odd = kept and (want == "a" or kept == 1)
    return cost + INSERT * (2 if odd and want == "u" else 1) * bool(odd)


def align(turns: list[Turn], aim: str, budget: int) -> tuple[int, str] | None:
    """(cost, least audit) of aligning the turns with `aim`, or None beyond `budget`.

    table[i] holds, for the places j in the band, what aligning turns i.. with aim[j:] costs at least.
    """
    n, m = len(turns), len(aim)
    deletes, inserts = (budget - INSERT * (m - n)) // (DELETE + INSERT), (budget + DELETE * (m - n)) // (DELETE + INSERT)
    if deletes < 0 or inserts < 0:
        return None
    table: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
    for i in range(n, -1, -1):
        low, high = max(0, i - deletes), min(m, i + inserts)
        after, below = table[i + 1] if i < n else (0, [])
        initial, gone, flaw = turns[i] if i < n else ("", True, 0)
        row = [_FAR] * max(0, high - low + 1)
        for j in range(high, low - 1, -1):
            best = 0 if i == n and j == m else _FAR
            if i < n and 0 <= j - after < len(below):
                best = below[j - after] + DELETE
            if j < m:
                if aim[j] != "s" and j < high:
                    best = min(best, row[j + 1 - low] + INSERT)
                if not gone and 0 <= j + 1 - after < len(below) and (initial == aim[j] or aim[j] != "s"):
                    best = min(best, below[j + 1 - after] + flaw + (KEEP if initial == aim[j] else REROLE))
            row[j - low] = best
        table[i] = (low, row)
    cost = table[0][1][0] if table[0][1] else _FAR
    if cost > budget:
        return None

    def at(i: int, j: int) -> int:
        low, row = table[i] if i <= n else (0, [])
        return row[j - low] if 0 <= j - low < len(row) else _FAR

    audit, i, j, left = [], 0, 0, cost
    while (i, j) != (n, m):  # the least letter that still leads to a cheapest end
        initial, gone, flaw = turns[i] if i < n else ("", True, 0)
        if at(i + 1, j) + DELETE == left:
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif j < m and aim[j] != "s" and at(i, j + 1) + INSERT == left:
            audit.append("I")
            j, left = j + 1, left - INSERT
        else:
            audit.append("K" if initial == aim[j] else "R")
            left -= flaw + (KEEP if initial == aim[j] else REROLE)
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def repair(turns: list[Turn], whole: int = 500) -> tuple[int, str]:
    """(cost, audit) of the cheapest alignment with any length of the grammar; the least audit of equal ones."""
    if len(turns) > whole:
        return repair_folded(turns)
    gone = sum(g for _, g, _ in turns)
    live = len(turns) - gone

    def least(length: int) -> int:
        return DELETE * gone + (INSERT * (length - live) if length > live else DELETE * (live - length))

    best = (incumbent(turns), "~")  # any audit is less
    longest = live + (best[0] - DELETE * gone) // INSERT
    for length in sorted((x for x in range(longest + 1) if x != 1), key=lambda x: (least(x), x)):
        if least(length) > best[0]:
            break
        if found := align(turns, target(length), best[0]):
            best = min(best, found)
    return best


#: Columns folded by the period: nothing yet, after s, after u, after a; a step leads to the next one and gives u or a.
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def repair_folded(turns: list[Turn]) -> tuple[int, str]:
    """The same as `repair` with one column for each of the grammar's states.

    After each turn a state holds its cheapest, least way there that ends with an edit of that turn. No such audit begins
    another one, so the states' audits compare by rank and, from one state on, by the letters added.
    """
    held = {0: (0, 0)}  # state: (cost, rank of the audit)
    steps: list[dict[int, tuple[int, str]]] = []
    for initial, gone, flaw in turns:
        found: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in held.items():
            at = state
            for inserted in range(3):  # more never pay: two lead back to the same column
                letters, paid = "I" * inserted, cost + INSERT * inserted
                ways = [(at, paid + DELETE, letters + "D")]
                if not gone:
                    step = _NEXT[at]
                    same = initial == "ua"[step - 2]
                    ways.append((step, paid + flaw + (KEEP if same else REROLE), letters + ("K" if same else "R")))
                    if at == 0 and initial == "s":
                        ways.append((1, paid + flaw, letters + "K"))
                for to, total, added in ways:
                    way = (total, rank, added, state)
                    if to not in found or way < found[to]:
                        found[to] = way
                at = _NEXT[at]
        ranks = {s: k for k, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        held = {s: (w[0], ranks[s]) for s, w in found.items()}
        steps.append({s: (w[3], w[2]) for s, w in found.items()})
    missing = {0: 0, 1: 2, 2: 1, 3: 0}  # inserts up to an end
    cost, _, state = min((c + INSERT * missing[s], r, s) for s, (c, r) in held.items())
    audit, at = ["I" * missing[state]], state
    for step in reversed(steps):
        at, letters = step[at]
        audit.append(letters)
    return cost, "".join(reversed(audit))


def edits_of(turns: list[Turn], audit: str) -> list[tuple[str, str]]:
    """For each turn and for the end: the initials inserted before it, and the edit's letter (Keep, Delete, or the new initial of a rerole)."""
    kept = sum(c != "D" for c in audit)
    aim, out, before = iter(target(kept)), [], ""
    for letter in audit:
        if letter == "I":
            before += next(aim)
            continue
        aimed = next(aim) if letter != "D" else ""
        out.append((before, aimed if letter == "R" else letter))
        before = ""
    return [*out, (before, "")]


def alignments(told: DataFrame, whole: int) -> DataFrame:
    """(conv_id, n, before, edit, cost, audit): a row for each turn and one, with cost and audit, for the end of each conversation."""
    kind = told.schema["conv_id"].dataType.simpleString()
    thin = told.select(F.col("conv_id").cast("string"), "n", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("flaw"))

    def rows_of(conv, turns: list[Turn]) -> list[tuple]:
        cost, audit = repair(turns, whole)
        edits = edits_of(turns, audit)
        return [(conv, k, before, edit, None, None) for k, (before, edit) in enumerate(edits[:-1], 1)] + [(conv, len(edits), *edits[-1], cost, audit)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n", "before", "edit", "cost", "audit"]).astype({"n": "int64", "cost": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, turns, out = None, [], []
        for batch in batches:
            for c, n, initial, gone, flaw in zip(batch["conv_id"], batch["n"], batch["initial"], batch["gone"], batch["flaw"]):
                if n == 1 and turns:  # numbers begin anew with each conversation
                    out += rows_of(conv, turns)
                    turns = []
                    if len(out) >= 10_000:
                        yield frame(out)
                        out = []
                conv = c
                turns.append((initial, bool(gone), int(flaw)))
        yield frame(out + rows_of(conv, turns) if turns else out)

    # as many tasks as the session has for shuffles: the rows are few bytes, their alignment is the work
    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = thin.repartition(n, "conv_id").sortWithinPartitions("conv_id", "n")
    found = ordered.mapInPandas(run, "conv_id string, n long, before string, edit string, cost long, audit string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired(told: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, n, place, role, text and edit of every turn that the repaired conversations hold, in order of n and place."""
    e = edits.select(F.col("conv_id").alias("e_id"), F.col("n").alias("e_n"), "before", "edit")
    t = told.select("conv_id", "n", "role", "text")
    j = e.join(t, F.col("e_id").eqNullSafe(F.col("conv_id")) & (F.col("e_n") == F.col("n")), "left")
    name = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    new = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), edit.alias("edit"))
    inserted = F.when(F.col("before") != "", F.transform(F.array_remove(F.split("before", ""), ""), lambda c: new(F.element_at(name, c), F.lit(""), F.lit("insert"))))
    stays = F.when(F.col("edit") == "K", F.array(new(F.col("role"), F.col("text"), F.lit("keep")))).when(F.col("edit").isin(*ROLES), F.array(new(F.element_at(name, F.col("edit")), F.col("text"), F.lit("rerole"))))
    none = F.array().cast("array<struct<role:string,text:string,edit:string>>")
    both = F.concat(F.coalesce(inserted, none), F.coalesce(stays, none))
    return j.select(F.col("e_id").alias("conv_id"), F.col("e_n").alias("n"), F.posexplode(both).alias("place", "x")).select("conv_id", "n", "place", "x.*")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its `role:text`, joined by newlines, batch by batch in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, conv, found = None, None, []
        for batch in batches:
            for c, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if state is None or c != conv:
                    if state is not None:
                        found.append((conv, state.hexdigest()))
                    state, conv = hashlib.sha256(), c
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            ended, found = found, []
            yield pd.DataFrame({"conv_id": pd.Series([c for c, _ in ended], dtype=object), "sha256": pd.Series([d for _, d in ended], dtype=object)})
        if state is not None:
            yield pd.DataFrame({"conv_id": pd.Series([conv], dtype=object), "sha256": [state.hexdigest()]})

    ordered = turns.select(F.col("conv_id").cast("string"), "n", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "n", "place")
    return ordered.mapInPandas(run, "conv_id string, sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))


def repair_all(turns: DataFrame, whole: int = 500) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of conv_id, turn, role and text."""
    told = settle(faulted(turns), "repair-turns")
    edits = settle(alignments(told, whole), "repair-edits")
    count: dict[str, Column] = {k: F.count_if(F.col("fault") == k) for k in ("blank", "duplicate", "truncated")}
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("first"), F.lit(0))
    seen = told.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *(v.alias(k) for k, v in count.items()), F.count_if("illegal").alias("illegal"))
    ends = edits.where("audit IS NOT NULL").select(F.col("conv_id").alias("e_id"), "cost", "audit")
    found = seen.join(ends, F.col("conv_id").eqNullSafe(F.col("e_id"))).drop("e_id")
    return found, repaired(told, edits)


def summary(turns: DataFrame, damaged: DataFrame, whole: int = 500) -> DataFrame:
    """A row for every conv_id of `turns`: the faults of `damaged`, cost and audit of its repair and the digest of the result."""
    found, fixed = repair_all(damaged, whole)
    of = lambda df, name: df.withColumnRenamed("conv_id", name)
    j = turns.select("conv_id").distinct()
    j = j.join(of(found, "f_id"), F.col("conv_id").eqNullSafe(F.col("f_id")), "left").join(of(digests(fixed), "d_id"), F.col("conv_id").eqNullSafe(F.col("d_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
