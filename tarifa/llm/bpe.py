"""Operator 9: byte-level BPE encoding and decoding with Spark's higher-order functions.

A word (one match of the tokenizer's pattern) is held as the Latin-1 reading of its UTF-8 bytes, one character a byte.
Encoding folds merges over the array of its bytes: each step takes the adjacent pair of lowest rank (the leftmost of
equal ones) and joins it, until no pair has a rank. A part is one integer, the rank of its pair with the next part above
its id, so the least of the array is the next merge and no step touches a string. The ranks of pairs are a literal map. Decoding concatenates the binary pieces of the ids.

The distinct words of the corpus are counted over all texts; the `frequent` commonest are encoded once and become a
second literal table (its size is bounded by that parameter), the HOT commonest of them apart. Every other word is folded
in place, so the dictionary changes the speed and never the result.

A word of more than a block of bytes is folded in overlapping blocks that are joined at a token both hold in the same
place. That gives the ids of the whole word: a sequence is the encoding of its bytes exactly if each two neighbours are
the encoding of theirs. (No merge crosses the ends of two final neighbours, so between these the fold runs as it would
alone. Conversely the first merge across a boundary would be the least pair of its two neighbours alone as well.)
All neighbours of the joined sequence are neighbours within a block. Where blocks share no token, the word is folded whole.
"""

from __future__ import annotations

import base64
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, settle

BUCKETS = 1 << 18
#: The commonest words lie in small maps, which are looked up fastest; the others in strings, which take a third of the bytes.
HOT = 1 << 16
PAIRS = 262_139  # a prime, as the ids of a pair are no random numbers
#: A part: rank << 44 | id, and for a moment its index << 20. Ids and ranks stay below 2**19, indices below 2**24.
_PLACE, _RANK = 20, 44
_MARK = "!"  # before the ids of a word that its decoding does not give back
_NONE, _ID, _PLACES = (1 << 19) - 1, (1 << 20) - 1, (1 << 24) - 1
#: White space of the tokenizer's pattern (Unicode White_Space), which Java's \s does not cover.
_WHITE = r"\t-\r\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    r"""The tokenizer's pattern for Java: \s and \S, alone or in a class, spelt out as Unicode white space."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out, i = out + (_WHITE if depth else f"[{_WHITE}]"), i + 2
        elif two == r"\S":
            if depth:
                raise ValueError(r"\S within a class is not supported")
            out, i = out + f"[^{_WHITE}]", i + 2
        elif two[0] == "\\":
            out, i = out + two, i + 2
        else:
            depth += (two[0] == "[") - (two[0] == "]")
            out, i = out + two[0], i + 1
    return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file (base64 and rank on each line, a vocabulary of fixed size), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucket(key: Column, size: int) -> Column:
    return F.hash(key).bitwiseAND(F.lit(size - 1))


def _packed(entries: DataFrame, name: str, size: int, bucket, made) -> Column:
    """A table (k, v) as an array of `size` slots: keys are found by hash, not by a walk through all.

    `made` turns the array of a bucket's entries into its slot; an empty one is null. The table, of bounded size, is one
    row in the shared folder; as a scalar subquery Spark reads it once and puts it into the plan as a literal, so neither
    the driver's Python nor the plan's text holds it. The driver's JVM holds it several times over while it sends out a
    stage, so slots are kept small.
    """
    filled = entries.groupBy(bucket(F.col("k"), size).alias("b")).agg(F.collect_list(F.struct("k", "v")).alias("e"))
    slots = entries.sparkSession.range(size).select(F.col("id").cast("int").alias("slot"))
    rows = slots.join(filled, F.col("slot") == F.col("b"), "left")
    one = rows.agg(F.sort_array(F.collect_list(F.struct("slot", "e"))).alias("s"))
    return settle(one.select(F.transform("s", lambda x: made(x["e"]))), name).scalar()


def _pieces(vocabulary: DataFrame) -> Column:
    """The pieces in the order of their ids, gaps empty, as a scalar subquery."""
    most = vocabulary.agg(F.max("v")).first()[0]
    every = vocabulary.sparkSession.range(most + 1).join(vocabulary, F.col("id") == F.col("v"), "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("k", F.lit("")).alias("k")))).alias("s"))
    return settle(one.select(F.transform("s", lambda x: x["k"])), "pieces").scalar()


def _marks() -> tuple[Column, Column]:
    """What stands before a word and before its code in a slot of words: bytes that no UTF-8 text holds."""
    return F.lit(b"\xfe").cast("string"), F.lit(b"\xff").cast("string")


def _joined(entries: Column) -> Column:
    """Words and codes of a slot as one string, a third of the bytes of a map."""
    word, code = _marks()
    return F.array_join(F.transform(entries, lambda x: F.concat(word, x["k"], code, x["v"])), "")


def _code(hot: Column, rest: Column, word: Column, other) -> Column:
    """The code of a word: from the maps of hot words, else from the slots of the rest, else `other`."""
    before, between = _marks()
    cut = lambda text, mark, n: F.call_function("substring_index", text, mark, F.lit(n))
    # from the word's code on, or the whole slot, and nothing stands before its first word
    found = cut(cut(F.get(rest, _bucket(word, BUCKETS)), F.concat(before, word, between), -1), before, 1)
    return F.coalesce(F.element_at(F.get(hot, _bucket(word, HOT)), word), let(found, lambda c: F.when(c != "", c).otherwise(other(word))))


def _pair_bucket(key: Column, size: int) -> Column:
    return (key % F.lit(size)).cast("int")


class Fold:
    """Column expressions that encode and decode words, given the tables of one vocabulary."""

    def __init__(self, bytes_: Column, pairs: Column, pieces: Column, block: int):
        self.bytes, self.pairs, self.pieces, self.block = bytes_, pairs, pieces, block

    def part(self, pair: Column) -> Column:
        """The left part of a pair (left id << 20 | right id), with the rank of the pair."""
        known = F.element_at(F.get(self.pairs, _pair_bucket(pair, PAIRS)), pair)
        return F.coalesce(known, F.shiftright(pair, _PLACE).bitwiseOR(F.lit(_NONE << _RANK)))

    def first(self, codes: Column) -> Column:
        """Ids of the bytes of a word, with the merges that no other can come before already made.

        A pair (a, b) of rank r is merged first of all if every piece that starts with b and the byte after it, and
        every piece that ends with the byte before a and a, has a rank over r: until the pair is merged, a merge that
        takes a or b away would make such a piece. Two such pairs never overlap.
        """
        table = lambda name, x, y: F.get(self.bytes[name], F.shiftleft(x, 8).bitwiseOR(y))

        def safe(i: Column) -> Column:
            z, a, b, c = (F.get(codes, i + k) for k in (-1, 0, 1, 2))
            least = F.least(F.lit(_NONE), table("starts", b, c), table("ends", z, a))
            return let(table("pair", a, b), lambda r: F.when(r < least, r))

        merges = lambda made: F.filter(F.transform(codes, lambda c, i: (
            F.when(F.get(made, i).isNotNull(), F.get(made, i).cast("long"))
            .when((i > 0) & F.get(made, i - 1).isNotNull(), F.lit(None).cast("long")).otherwise(F.get(self.bytes["single"], c).cast("long"))
        )), lambda x: x.isNotNull())
        return let(F.transform(codes, lambda c, i: safe(i)), merges)

    def ids(self, word: Column) -> Column:
        """The ids of a word, by ranked merges."""
        edge = F.lit((_NONE << _RANK) | _ID).cast("long")  # before the first part and after the last: no pair has a rank
        id_of = lambda part: part.bitwiseAND(F.lit(_ID))
        pair = lambda left, right: F.shiftleft(left, _PLACE).bitwiseOR(right)

        def merge(s: Column, low: Column) -> Column:
            new, at = F.shiftright(low, _RANK), F.shiftright(low, _PLACE).bitwiseAND(F.lit(_PLACES)).cast("int")
            pairs = F.array(pair(id_of(F.get(s, at - 1)), new), pair(new, id_of(F.get(s, at + 2))))
            merged = F.concat(F.slice(s, F.lit(1), at - 1), F.transform(pairs, self.part), F.slice(s, at + 3, F.size(s)))
            return F.when(low < F.lit(_NONE << _RANK), merged).otherwise(s)

        def start(ids: Column) -> Column:
            pairs = F.transform(ids, lambda x, i: pair(x, F.coalesce(F.get(ids, i + 1), F.lit(_ID).cast("long"))))
            return F.concat(F.array(edge), F.transform(pairs, self.part), F.array(edge))

        # array_position would do, but it leaves its loop by an exception, which costs more than the rest of a step
        low = lambda s: F.array_min(F.transform(s, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("long"), _PLACE))))
        single = F.transform(F.split(word, ""), F.ascii)
        fold = lambda s: F.aggregate(F.array_repeat(F.lit(0), F.size(s) - 3), s, lambda s, _: let(low(s), lambda x: merge(s, x)))
        return let(let(let(let(single, self.first), start), fold), lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: id_of(x).cast("int")))

    def long_ids(self, word: Column) -> Column:
        """The same for a long word: blocks that overlap by a quarter, joined at a common token."""
        size, block = F.char_length(word), self.block
        place = lambda part: F.shiftright(part, _PLACE)
        empty = F.array().cast("array<bigint>")

        def encoded(start: Column) -> Column:
            """Tokens (place << 20 | id) of the block at byte `start`, counted from 0."""
            def add(state: Column, i: Column) -> Column:
                here = F.shiftleft(state["at"], _PLACE).bitwiseOR(i.cast("long"))
                return F.struct((state["at"] + F.char_length(F.get(self.pieces, i))).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

            ids = self.ids(F.substring(word, (start + 1).cast("int"), F.lit(block)))
            return F.aggregate(ids, F.struct(start.alias("at"), empty.alias("found")), add)["found"]

        def step(state: Column, _: Column) -> Column:
            now, stop = state["now"], state["stop"]
            late = F.filter(now, lambda x: place(x) >= stop - block // 4)
            tail = F.when(F.size(late) > 0, late).otherwise(F.slice(now, F.lit(-1), F.lit(1)))

            def joined(tail: Column) -> Column:
                start = place(F.get(tail, F.lit(0)))

                def with_next(more: Column) -> Column:
                    common = F.get(F.filter(tail, lambda x: F.array_contains(more, x)), F.lit(0))
                    return let(common, lambda c: F.struct(
                        F.concat(state["done"], F.filter(now, lambda x: x < c)).alias("done"),
                        F.filter(more, lambda x: x >= c).alias("now"),
                        F.least(start + block, size.cast("long")).alias("stop"),
                        c.isNull().alias("lost"),
                    ))

                return let(encoded(start), with_next)

            return F.when((stop >= size) | state["lost"], state).otherwise(let(tail, joined))

        zero = F.struct(empty.alias("done"), encoded(F.lit(0).cast("long")).alias("now"), F.lit(block).cast("long").alias("stop"), F.lit(False).alias("lost"))
        rounds = F.array_repeat(F.lit(0), F.ceil(size * 2 / block).cast("int"))
        ids = lambda s: F.transform(F.concat(s["done"], s["now"]), lambda x: x.bitwiseAND(F.lit(_ID)).cast("int"))
        return let(F.aggregate(rounds, zero, step), lambda s: F.when(s["lost"], self.ids(word)).otherwise(ids(s)))

    def code(self, word: Column) -> Column:
        """Ids of a word as comma-joined decimals, marked in front where their decoding is not the word."""
        def coded(latin: Column) -> Column:
            ids = F.when(F.char_length(latin) <= self.block, self.ids(latin)).otherwise(self.long_ids(latin))
            text = lambda ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
            return let(ids, lambda ids: F.when(self.decode(ids) == latin, text(ids)).otherwise(F.concat(F.lit(_MARK), text(ids))))

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), coded)

    def text(self, words: Column, code) -> Column:
        """(ids, decoded) of the words of a text: words that their decoding gives back stand for it, others are decoded by their pieces."""
        def whole(ids: Column) -> Column:
            clean = F.replace(ids, F.lit(_MARK))
            pieces = self.decode(F.transform(F.split(clean, ","), lambda i: i.cast("int")))
            decoded = F.when(F.contains(ids, F.lit(_MARK)), F.encode(pieces, "ISO-8859-1")).otherwise(F.array_join(words, "").cast("binary"))
            return F.struct(clean.alias("ids"), decoded.alias("decoded"))

        return let(F.array_join(F.transform(words, code), ","), whole)

    def decode(self, ids: Column) -> Column:
        """Bytes (as Latin-1) of an array of ids: the concatenation of their binary pieces."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "")


def byte_tables(ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """By two bytes: the rank of both as a piece, and the least rank of pieces that start or end with them; by one: its id."""
    pair, starts, ends = ([_NONE] * 65536 for _ in range(3))
    for piece, rank in ranks.items():
        if len(piece) > 1:
            head, tail = piece[0] << 8 | piece[1], piece[-2] << 8 | piece[-1]
            starts[head], ends[tail] = min(starts[head], rank), min(ends[tail], rank)
            if len(piece) == 2:
                pair[head] = rank
    return {"single": [ranks[bytes([b])] for b in range(256)], "pair": pair, "starts": starts, "ends": ends}


def pair_ranks(ranks: dict[bytes, int]) -> pa.Table:
    """Each two pieces that together are a piece (left id << 20 | right id): the left part, with its rank. Bounded by the vocabulary."""
    k, v = [], []
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                k.append(left << _PLACE | right)
                v.append(rank << _RANK | left)
    return pa.table({"k": pa.array(k, pa.int64()), "v": pa.array(v, pa.int64())})


def tokenise(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str = "text", frequent: int = 400_000, block: int = 256,
) -> DataFrame:
    """One row per row of `docs`: `keep`, n_tokens, ids (comma-joined decimals), decoded (binary).

    Null counts as empty text: no tokens, empty ids, empty bytes. Special tokens are ordinary text. Whole texts are
    encoded; repeated rows get the same ids; an empty table gives an empty result. Ranks must cover every byte and lie
    below 524,287; a block holds two of the longest pieces at least.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold every single byte")
    if max(ranks.values()) >= _NONE:
        raise ValueError(f"ranks must lie below {_NONE}")
    block = max(block, 2 * max(map(len, ranks)))
    spark = docs.sparkSession
    vocabulary = pa.table({"k": [k.decode("latin-1") for k in ranks], "v": pa.array(ranks.values(), pa.int32())})
    pieces = _pieces(settle(spark.createDataFrame(vocabulary), "vocabulary"))
    pairs = _packed(settle(spark.createDataFrame(pair_ranks(ranks)), "pairs"), "ranks", PAIRS, _pair_bucket, F.map_from_entries)
    tables = byte_tables(ranks)
    kind = "struct<" + ",".join(f"{k}:array<int>" for k in tables) + ">"
    bytes_ = settle(spark.createDataFrame(pa.table({"t": [json.dumps(tables)]})).select(F.from_json("t", kind)), "bytes").scalar()
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    # distinct words of each text first, so that the grouping sees a word once a text
    counts = docs.select(F.explode(F.array_distinct(found)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "k").limit(frequent)
    top = top.repartition(spark.sparkContext.defaultParallelism, "k")
    # each table is used once, so Spark puts the subquery in its place and no row ever holds a table
    tables = [bytes_.alias("_bytes"), pairs.alias("_pairs"), pieces.alias("_pieces")]
    bound = lambda body: let(F.col("_bytes"), lambda b: let(F.col("_pairs"), lambda r: let(F.col("_pieces"), lambda p: body(Fold(b, r, p, block)))))
    words = settle(top.select("k", "n", *tables).select("k", "n", bound(lambda fold: fold.code(F.col("k"))).alias("v")), "words")
    hot = settle(words.orderBy(F.desc("n"), "k").limit(HOT), "hot")
    rest = words.join(hot.select("k"), "k", "left_anti")
    packed = [
        _packed(hot, "frequent", HOT, _bucket, F.map_from_entries).alias("_hot"),
        _packed(rest, "rest", BUCKETS, _bucket, _joined).alias("_rest"),
    ]
    code = lambda fold, h, r: lambda w: _code(h, r, w, fold.code)
    tabled = lambda body: let(F.col("_hot"), lambda h: let(F.col("_rest"), lambda r: body(h, r)))
    coded = bound(lambda fold: tabled(lambda h, r: let(F.col("_found"), lambda w: fold.text(w, code(fold, h, r)))))
    one = docs.select(*keep, found.alias("_found"), *tables, *packed)
    out = one.select(*keep, coded.alias("_c")).select(*keep, "_c.ids", "_c.decoded")
    n = F.when(F.col("ids") == "", 0).otherwise(F.octet_length("ids") - F.octet_length(F.replace("ids", F.lit(","))) + 1)
    return out.select(*keep, n.cast("long").alias("n_tokens"), "ids", "decoded")
