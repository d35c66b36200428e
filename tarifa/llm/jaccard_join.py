"""Operator 10: n-gram Jaccard join by chosen paths.

Sets are the 5-word shingles of a text; texts with equal sets are one node. Each node is embedded in 64 tokens (a
one-permutation MinHash). In every run a node goes down the paths of the tokens that the path samples, each with
probability c / (0.8 * tokens), so two nodes with similarity 0.8 share c paths a level on average. Buckets of at most
`small` nodes are compared pairwise; larger ones are split again on tokens sampled by the path so far, with a greater c.
A pair must share a path at each level, so its chance to share none, q = exp(-c * (1 - q)), is carried from the deepest
level up, and runs repeat until q ** runs is below 1 - recall. Before a split, nodes like a leader of their bucket are
peeled off, and nodes that share too few of their tokens with any other node for a partner are left behind.

Candidate pairs only decide which nodes are brought together: families (connected candidates) are then compared
exactly on whole shingle sets, large families in tiles. A bucket that stays large after `levels` splits is joined
to one family as a whole, so no partner is capped or dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks, mix, release, shingles
from .common import settle
from .components import components

TOKENS = 64
_EMPTY = 0xFFFFFFFF
_C, _DEEPER = 1.25, 1.25  # paths that a pair at the threshold shares at the first level, and for each split


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, ...) in runs: sorted distinct shingle hashes of 48 bits with their rows."""
    for i, j, data, offsets in chunks(texts):
        h, rows, _ = shingles(data, offsets)
        packed = np.unique((rows.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        yield i, j, packed >> np.uint64(48), packed & np.uint64((1 << 48) - 1)


def _runs(recall: float, levels: int) -> int:
    """Runs after which a pair at the threshold is missed with a chance of 1 - recall at most, `levels` splits down."""
    miss = 0.0
    for c in [_DEEPER] * levels + [_C]:
        miss = math.exp(-c * (1 - miss))
    return math.ceil(math.log(1 - recall) / math.log(miss))


def _chosen(path: np.ndarray, sig: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the tokens that each row's path samples from its signature."""
    live = sig != _EMPTY
    p = np.minimum(1.0, c / (0.8 * np.maximum(live.sum(1), 1)))
    token = sig.astype(np.uint64) | (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32))
    child = mix(mix(path.astype(np.uint64))[:, None] ^ mix(token + np.uint64(1)))
    row, col = np.nonzero(live & ((mix(child) >> np.uint64(11)) * 2.0**-53 < p[:, None]))
    return row, child[row, col]


def _sketch(runs: int):
    starts = np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for i, j, rows, h in _sets(batch.column("text")):
                m = j - i
                n = np.bincount(rows.astype(np.int64), minlength=m)
                node = np.zeros(m, dtype=np.uint64)
                np.add.at(node, rows.astype(np.int64), mix(h + np.uint64(1)))
                node = mix(node ^ n.astype(np.uint64)).view(np.int64)
                # hashes are sorted within a row: the first of each bin is its least
                key = (rows.astype(np.int64) * TOKENS) + (h >> np.uint64(42)).astype(np.int64)
                first = np.flatnonzero(np.diff(key, prepend=-1))
                sig = np.full(m * TOKENS, _EMPTY, dtype=np.uint32)
                sig[key[first]] = ((h[first] & np.uint64((1 << 42) - 1)) >> np.uint64(11)).astype(np.uint32)
                sig = sig.reshape(m, TOKENS)
                at, path = [], []
                for s in starts:
                    r, c = _chosen(np.full(m, s), sig, _C)
                    at.append(r)
                    path.append(c)
                at, path = np.concatenate(at), np.concatenate(path)
                order = np.argsort(at, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(m + 1)), pa.int32()), pa.array(path[order].view(np.int64)))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, m), keys.slice(i, m), pa.array(node, pa.int64(), mask=none), pa.array(n, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary()), lists], schema=schema
                )

    return run


def _matches(level: float):
    """Pairs within runs of rows of one path (rows arrive sorted by path) whose signatures agree to `level`."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pairs(path: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        d, i = 1, np.arange(len(path))
        while True:
            i = i[i + d < len(path)]
            i = i[path[i] == path[i + d]]
            if not len(i):
                break
            a, b = sig[i], sig[i + d]
            both = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
            hit = ((a == b) & (a != _EMPTY)).sum(1) >= level * both
            us.append(node[i[hit]])
            vs.append(node[i[hit] + d])
            d += 1
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column("path").to_numpy(), batch.column("node").to_numpy(), _signatures(batch.column("sig")))
            path, node, sig = new if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
            cut = len(path) - int((path == path[-1]).sum())
            if cut:
                yield pairs(path[:cut], node[:cut], sig[:cut])
            rest = (path[cut:], node[cut:], sig[cut:])
        if rest is not None:
            yield pairs(*rest)

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            row, child = _chosen(batch.column("path").to_numpy().view(np.uint64), _signatures(batch.column("sig")), _DEEPER)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("node").take(pa.array(row))], names=["path", "node"])


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of large buckets with their leaders (the least and the greatest node of a bucket), once for all buckets of the two.

    A row like a leader (0.7 or more) need not be split further: by the triangle inequality of the Jaccard distance
    a partner at 0.8 is at 0.5 or more to that leader, and every row at 0.35 or more becomes a candidate of it.
    """
    for batch in batches:
        if batch.num_rows:
            a = _signatures(batch.column("sig"))
            likes = []
            for leader in ("low_sig", "high_sig"):
                b = _signatures(batch.column(leader))
                both = np.maximum(1, ((a != _EMPTY) | (b != _EMPTY)).sum(1))
                likes.append(((a == b) & (a != _EMPTY)).sum(1) / both)
            columns = [batch.column(c) for c in ("low", "high", "node", "paths", "sig")]
            marks = [*(pa.array(x >= 0.35) for x in likes), pa.array(np.maximum(*likes) >= 0.7)]
            yield pa.RecordBatch.from_arrays([*columns, *marks], names=["low", "high", "node", "paths", "sig", "near", "near_high", "peeled"])


def _least_shared() -> np.ndarray:
    """By number of tokens: how many of them a row shares with a partner at 0.8, but for a chance of 1e-6."""
    least = []
    for n in range(TOKENS + 1):
        k, chance = 0, 0.2**n
        while chance < 1e-6:
            k += 1
            chance += math.comb(n, k) * 0.8**k * 0.2 ** (n - k)
        least.append(k)
    return np.array(least)


_PARTS = {"node": np.int64, "token": np.uint64}


def _parts(bucket: np.ndarray, node: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, nodes, tokens) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    buckets, at = np.unique(bucket[order], return_index=True)
    cuts = list(zip(at, [*at[1:], len(order)]))
    columns = [pa.array([x[order[a:b]].tobytes() for a, b in cuts], pa.binary()) for x in (node, token)]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), *columns], names=["bucket", *_PARTS])


def _deal_tokens(buckets: int):
    """The tokens of nodes, dealt by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _signatures(batch.column("sig"))
                row, col = np.nonzero(sig != _EMPTY)
                token = mix(sig[row, col].astype(np.uint64) | (col.astype(np.uint64) << np.uint64(32)))
                yield _parts(token % np.uint64(buckets), batch.column("node").to_numpy()[row], token)

    return run


def _count_shared(buckets: int):
    """How many tokens of each node another node has as well, dealt by node; of all of a node's tokens in the upper half."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, token = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in _PARTS.items())
        _, at, count = np.unique(token, return_inverse=True, return_counts=True)
        nodes, of = np.unique(node, return_inverse=True)
        shared = np.bincount(of, count[at] > 1).astype(np.uint64) | (np.bincount(of).astype(np.uint64) << np.uint64(32))
        return _parts(mix(nodes.view(np.uint64)) % np.uint64(buckets), nodes, shared).to_pandas()

    return run


def _partnered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes that share as many of their tokens with others as a partner would."""
    node, counts = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in _PARTS.items())
    nodes, of = np.unique(node, return_inverse=True)
    shared, live = (np.bincount(of, x) for x in (counts & np.uint64(0xFFFFFFFF), counts >> np.uint64(32)))
    return pd.DataFrame({"p_node": nodes[shared >= _least_shared()[live.astype(np.int64)]]})


def _with_partner(rows: DataFrame) -> DataFrame:
    """The rows (paths, node, sig) whose node may have a partner among those of all rows.

    Most rows of a bucket that a common passage makes have nothing else in common: a partner at 0.8 would share about
    four fifths of their tokens, so a row with too few tokens that any other row has goes down no further path.
    """
    nodes = settle(rows.groupBy("node").agg(F.first("sig").alias("sig")), "unlike")
    buckets = max(32, nodes.count() // 10_000)
    schema = "bucket long, node binary, token binary"
    shared = nodes.mapInArrow(_deal_tokens(buckets), schema).groupBy("bucket").applyInPandas(_count_shared(buckets), schema)
    partnered = shared.groupBy("bucket").applyInPandas(_partnered, "p_node long")
    return rows.hint("merge").join(partnered, F.col("node") == F.col("p_node"), "left_semi")


def _family_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets (arrays of 48-bit hashes) of texts, their other columns passing through."""
    for batch in batches:
        for i, j, rows, h in _sets(batch.column("text")):
            at = np.searchsorted(rows, np.arange(j - i + 1))
            sets = pa.array([h[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), sets], names=[*names, "set"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, as a product of incidence matrices, some columns at a time."""
    nl, nr = len(left), len(right)
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(nl + nr), [len(x) for x in [*left, *right]])
    token, at, count = np.unique(every, return_inverse=True, return_counts=True)
    out = np.zeros((nl, nr), dtype=np.float32)
    shared = count[at] > 1  # a token of one set adds nothing
    at, owner = at[shared], owner[shared]
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    step = max(256, 8_000_000 // max(1, nl + nr))
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        lo, hi = np.searchsorted(at, [c, c + step])
        m = np.zeros((nl + nr, step), dtype=np.float32)
        m[owner[lo:hi], at[lo:hi] - c] = 1
        out += m[:nl] @ m[nl:].T
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact comparison of the families of one group, or of one tile of a large family."""
    out = []
    for _, f in pdf.groupby("root", sort=False):
        f = f.drop_duplicates("node" if f["i"].iloc[0] == f["j"].iloc[0] else ["node", "block"])
        sets = [np.frombuffer(s, dtype=np.uint64) for s in f["set"]]
        node, copies, block = f["node"].to_numpy(), f["copies"].to_numpy(), f["block"].to_numpy()
        n = np.array([len(s) for s in sets])
        same = f["i"].iloc[0] == f["j"].iloc[0]
        a = np.arange(len(f)) if same else np.flatnonzero(block == f["i"].iloc[0])
        b = a if same else np.flatnonzero(block == f["j"].iloc[0])
        near = 9 * _overlaps([sets[x] for x in a], [sets[x] for x in b]) >= 4 * (n[a][:, None] + n[b][None, :])
        if same:
            np.fill_diagonal(near, False)
        links = np.zeros(len(f), dtype=np.int64)
        links[a] += near @ copies[b]
        if not same:
            links[b] += near.T @ copies[a]
        # least node of each component of this tile
        label = node.copy()
        x, y = np.nonzero(near)
        x, y = a[x], b[y]
        while len(x):
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            if (new == label).all():
                break
            label = new
        release()
        out.append(pd.DataFrame({"node": node, "label": label, "links": links, "tiled": bool(f["tiled"].iloc[0])}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "label": [], "links": [], "tiled": []})


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = 0.9999, small: int = 48, levels: int = 3, tile: int = 1000, stays: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (least id of its class), class_size, n_links.

    Two texts are linked when their sets of five-word shingles (words split at white space, A-Z as a-z; a text of
    fewer words is one shingle) have a Jaccard similarity of 0.8 or more; classes are the connected texts; n_links
    counts the other rows linked to a row, copies included. Null, empty and wordless texts have no links and are
    classes of their own. Ids must be integers; a null id takes part, but names a class only if all its ids are null.
    Repeated rows count as copies. Rows with one id may hold different texts. An empty table gives an empty result.
    With `stays` each row has two more columns: key (xxhash64 of its text, null as empty) and stays, which is true for
    one id and text of each class, the least by id (nulls last) and key; rows that repeat both all stay.
    """
    runs = _runs(recall, levels)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    sketch = settle(base.mapInArrow(_sketch(runs), "doc_id long, key long, node long, n int, sig binary, paths array<long>"), "sketches")
    nodes = sketch.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.first("sig").alias("sig"), F.first("paths").alias("paths")
    )
    nodes = settle(nodes, "nodes")
    sigs = nodes.select(F.col("node").alias("s_node"), "sig")
    level = nodes.select(F.explode("paths").alias("path"), "node")
    edges = []
    for depth in range(levels + 1):
        ends = [F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")]
        sizes = settle(level.groupBy(F.col("path").alias("k")).agg(*ends).where("size > 1"), "buckets")
        # both sides of these joins grow with the input: they are merged by shuffle at every size
        rows = level.hint("merge").join(sizes, F.col("path") == F.col("k")).hint("merge").join(sigs, F.col("node") == F.col("s_node"))
        rows = settle(rows.select("path", "node", "sig", "size", "low", "high"), "rows")
        few = rows.where(F.col("size") <= small).select("path", "node", "sig").repartition("path").sortWithinPartitions("path")
        edges.append(settle(few.mapInArrow(_matches(0.6), "u long, v long").distinct(), "pairs"))
        # a node of many large buckets with the same leaders is one row; its paths are as many as it has in all runs at most
        large = rows.where(F.col("size") > small).groupBy("low", "high", "node").agg(F.collect_list("path").alias("paths"), F.first("sig").alias("sig"))
        leaders = sizes.where(F.col("size") > small).select(F.col("low").alias("l_low"), F.col("high").alias("l_high")).distinct()
        for end in ("low", "high"):
            leaders = leaders.join(sigs.select(F.col("s_node").alias(f"{end}_node"), F.col("sig").alias(f"{end}_sig")), F.col(f"l_{end}") == F.col(f"{end}_node"))
        large = large.join(leaders, (F.col("low") == F.col("l_low")) & (F.col("high") == F.col("l_high"))).select("low", "high", "node", "paths", "sig", "low_sig", "high_sig")
        peeled = settle(large.mapInArrow(_peel, "low long, high long, node long, paths array<long>, sig binary, near boolean, near_high boolean, peeled boolean"), "peeled")
        if peeled.isEmpty():
            break
        # what is as large as before after the last split joins its leader as a whole
        edges.append(peeled.where("near" if depth < levels else "true").select(F.col("low").alias("u"), F.col("node").alias("v")))
        if depth < levels:
            edges.append(peeled.where("near_high").select(F.col("high").alias("u"), F.col("node").alias("v")))
            deeper = _with_partner(peeled.where("NOT peeled").select("paths", "node", "sig"))
            # dealt by node: the rows of a hot leader lie in the few tasks that have peeled them
            deeper = deeper.repartition("node").select(F.explode("paths").alias("path"), "node", "sig")
            level = settle(deeper.mapInArrow(_split, "path long, node long"), "paths")
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    families = components(all_edges)
    sizes = families.groupBy(F.col("root").alias("k")).agg(F.count("*").alias("members"))
    members = families.join(sizes, F.col("root") == F.col("k")).join(nodes.drop("sig", "paths").withColumnRenamed("node", "n_node"), F.col("node") == F.col("n_node"))
    blocks = F.ceil(F.col("members") / tile).cast("int")
    members = members.select(
        "node", "root", "copies", "first", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
    )
    members = settle(members, "members")
    texts = base.hint("merge").join(members, base["doc_id"].eqNullSafe(members["first"]["doc_id"]) & (base["key"] == members["first"]["key"])).select("node", "root", "copies", "blocks", "block", "text")
    schema = "node long, root long, copies long, blocks int, block int, set binary"
    sets = texts.mapInArrow(_family_sets, schema)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sets = sets.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    sets = sets.withColumn("tiled", F.col("blocks") > 1)
    # small families share a group, a tile of a large family is a group of its own
    groups = max(1, members.count() // 1500)
    group = F.when(F.col("tiled"), F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(groups)))
    found = sets.withColumn("group", group).drop("other").groupBy("group").applyInPandas(_compare, "node long, label long, links long, tiled boolean")
    found = settle(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = found.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    tiled = found.where("tiled").select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = found.where("NOT tiled").select("node", F.col("label").alias("root")).unionByName(components(tiled))
    named = nodes.select("node", "copies", "first").join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    named = named.select("node", "copies", "first", F.coalesce("root", "node").alias("class"))
    classes = named.groupBy(F.col("class").alias("c")).agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    named = named.join(classes, F.col("class") == F.col("c")).join(links.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    named = named.select(F.col("node").alias("k"), "least", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = settle(named, "classes")
    out = sketch.select("doc_id", "key", "node").join(named, F.col("node") == F.col("k"), "left")
    least = F.col("least")
    more = [F.col("key"), (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(least["doc_id"]) & (F.col("key") == least["key"]))).alias("stays")]
    return out.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(least["doc_id"]).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *more[: 2 * stays],
    )
