"""A Merkle manifest of a dataset: one root for all rows, and a proof for each of them.

1. Each row becomes a leaf, the digest of its columns.
2. A group's keys become compressed bitmaps: words of 64 keys, made by OR in every task
   and merged, and of each 16 words, a chunk, only those that are not zero. A popcount
   directory goes along: the keys before each word of the chunk, and, by a prefix sum
   over all chunks, the keys before the chunk.
3. A leaf's place in its group is a rank query: chunk, word, and the bits below its own.
   No leaf is sorted. Rows that share group and key are ranked by their digest.
4. Leaves go into slot arrays keyed by group and place, of ``ARITY ** LEVELS_AT_ONCE``
   slots. An array reduces its own levels to one node, and the nodes are the leaves of
   the next round, until each group is one node: its subroot.
5. The subroots, ranked by group, are reduced likewise, to the root. From there the
   siblings of every path are handed down, once for each array.

All digests are lower-case hexadecimal SHA-256 over concatenated text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.global_windows import running_total
from tallymart.llm.tables import stored

ARITY = 3
LEVELS_AT_ONCE = 5
SLOTS = ARITY**LEVELS_AT_ONCE

_WORD_BITS, _CHUNK_BITS = 6, 10
#: The chunk of rows without key, before all others.
_NO_KEY = -(1 << (63 - _CHUNK_BITS)) - 1

#: Rows that are equal in everything are numbered in stretches of this length.
_STRETCH = 1 << 16
#: Names of groups within this module, ordered as their bytes and with null first.
_UNNAMED, _NAMED, _LONGEST = "-", "=", 2**31 - 1

SIDES = "array<struct<left:string,right:string>>"


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as UTF-8 byte count, colon, value; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(digest: Column, sides: Column) -> Column:
    """What a digest becomes on its way up, with the given siblings."""
    return F.aggregate(sides, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof(sides: Column) -> Column:
    """The digest of a row's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _address() -> tuple[Column, Column]:
    """Chunk of a key, and its place there."""
    key = F.col("key")
    chunk = F.coalesce(F.shiftright(key, _CHUNK_BITS), F.lit(_NO_KEY))
    return chunk, F.coalesce(key.bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)), F.lit(0)).cast("int")


def _shifted(bits: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(bits).cast("long"), by)


def key_bitmaps(keys: DataFrame) -> DataFrame:
    """``group, chunk, words, extra, size`` of rows ``group, key, n``: bitmaps with popcount directories.

    ``words`` holds ``word, bits, before`` of each word with a key, ``before`` counting the
    keys in earlier words of the chunk; ``extra`` has ``low, more`` of keys that stand for
    more than one row. A chunk's arrays have 16 and 1,024 entries at most, and ``size``
    counts its rows. Rows of equal group and key must have been counted into one.
    """
    chunk, low = _address()
    repeated = F.when(F.col("n") > 1, F.struct("low", (F.col("n") - 1).alias("more")))
    words = (
        keys.select("group", chunk.alias("chunk"), low.alias("low"), "n")
        .groupBy("group", "chunk", F.shiftright("low", _WORD_BITS).alias("word"))
        .agg(
            F.bit_or(_shifted(1, F.col("low") % (1 << _WORD_BITS))).alias("bits"),
            F.sum("n").alias("rows"),
            F.collect_list(repeated).alias("extra"),
        )
    )
    merged = words.groupBy("group", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("found"),
        F.flatten(F.collect_list("extra")).alias("extra"),
        F.sum("rows").alias("size"),
    )

    def with_count(word: Column, at: Column) -> Column:
        earlier = F.slice("found", F.lit(1), at)
        before = F.aggregate(earlier, F.lit(0), lambda total, w: total + F.bit_count(w["bits"]))
        return F.struct(word["word"].alias("word"), word["bits"].alias("bits"), before.alias("before"))

    return merged.select("group", "chunk", F.transform("found", with_count).alias("words"), "extra", "size")


def rank_directory(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps with ``first``, the rows of their group in earlier chunks, and ``total``, all rows of the group."""
    order = [F.asc("group"), F.asc("chunk")]
    summed = stored(running_total(bitmaps, order, "size", "ahead"), "directory")
    groups = summed.groupBy("group").agg(F.min("ahead").alias("base"), F.sum("size").alias("total"))
    return summed.join(groups, "group").select(
        "group", "chunk", "words", "extra", (F.col("ahead") - F.col("base")).alias("first"), "total"
    )


def ranked(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` by ``group, key`` with ``rank, same, total``: smaller keys' rows, the own key's, the group's."""
    chunk, low = _address()
    own = rows.withColumns({"chunk": chunk, "_low": low}).join(directory, ["group", "chunk"])
    word = F.filter("words", lambda w: w["word"] == F.shiftright("_low", _WORD_BITS))[0]
    below = F.bitwise_not(_shifted(-1, F.col("_low") % (1 << _WORD_BITS)))
    smaller = word["before"] + F.bit_count(word["bits"].bitwiseAND(below))

    def more(where: Callable[[Column], Column]) -> Column:
        added = F.transform(F.filter("extra", lambda x: where(x["low"])), lambda x: x["more"])
        return F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n)

    return own.select(
        *rows.columns,
        (F.col("first") + smaller + more(lambda low: low < F.col("_low"))).alias("rank"),
        (more(lambda low: low == F.col("_low")) + F.lit(1)).alias("same"),
        "total",
    )


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` of columns ``group, key, digest, ...`` with ``place`` and ``total``, one row for each leaf."""
    columns = leaves.columns
    counted = stored(leaves.groupBy(*columns).agg(F.count("*").alias("n")), "leaves")
    keys = counted.groupBy("group", "key").agg(F.sum("n").alias("n"))
    # a row that stands for many is cut into stretches before the join, which can deal these out
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STRETCH).cast("long")))
    directory = stored(rank_directory(key_bitmaps(keys)), "rank-directory")
    found = stored(ranked(counted, directory), "ranked")
    alone = found.where("same = n").withColumn("within", F.lit(0).cast("long"))
    order = [F.asc("group"), F.asc_nulls_first("key"), *[F.asc_nulls_first(c) for c in columns[2:]]]
    several = running_total(found.where("same > n"), order, "n", "ahead")
    several = stored(several, "repeated-keys")
    base = several.groupBy("group", "rank").agg(F.min("ahead").alias("base"))
    several = several.join(base, ["group", "rank"]).withColumn("within", F.col("ahead") - F.col("base"))
    cut = alone.unionByName(several.select(*alone.columns)).withColumn("start", start)
    last = F.least(F.col("n"), F.col("start") + _STRETCH) - 1
    return cut.select(
        *columns, "total", (F.col("rank") + F.col("within")).alias("at"), F.explode(F.sequence("start", last)).alias("copy")
    ).select(*columns, "total", (F.col("at") + F.col("copy")).alias("place"))


def _depth(total: str) -> Column:
    """Levels above ``total`` nodes."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**k).cast("long") for k in range(40)]), lambda p: p < F.col(total)))


def _parents(nodes: Column) -> Column:
    last = F.ceil(F.size(nodes) / ARITY).cast("int") - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda at: F.sha2(F.array_join(F.slice(nodes, at * ARITY + 1, F.lit(ARITY)), ""), 256),
    )


def _slot_arrays(nodes: DataFrame) -> DataFrame:
    """``group, place, depth, steps, members, levels`` of nodes ``group, place, depth, digest, ...``.

    ``levels`` begins with the members' digests; each further level is reduced from the one before.
    """
    others = [c for c in nodes.columns if c not in ("group", "depth")]
    arrays = nodes.groupBy("group", F.floor(F.col("place") / SLOTS).alias("array")).agg(
        F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct(*others))).alias("members")
    )
    arrays = arrays.withColumn("steps", F.least(F.col("depth"), F.lit(LEVELS_AT_ONCE)))
    first = F.array(F.transform("members", lambda m: m["digest"]))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.col("steps")),
        first,
        lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
    )
    return arrays.select(
        "group",
        F.col("array").alias("place"),
        "depth",
        "steps",
        "members",
        F.when(F.col("steps") > 0, grown).otherwise(first).alias("levels"),
    )


def _sides_within() -> Callable[[Column], Column]:
    """For the member ``slot`` of a slot array: its siblings on each of the array's levels."""
    widths = F.array(*[F.lit(ARITY**k) for k in range(LEVELS_AT_ONCE)])

    def level(slot: Column) -> Callable[[Column], Column]:
        def siblings(at: Column) -> Column:
            nodes = F.get("levels", at)
            own = F.floor(slot / F.get(widths, at)).cast("int")
            before = own % ARITY
            left = F.slice(nodes, own - before + 1, before)
            right = F.slice(nodes, own + 2, F.lit(ARITY - 1) - before)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        return siblings

    def of(slot: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.col("steps") - 1), level(slot))
        return F.when(F.col("steps") > 0, found).otherwise(F.array().cast(SIDES))

    return of


def _reduced(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The slot arrays of each round, from ``group, place, total, digest, ...``; ``depth`` is the deepest group's."""
    nodes, rounds = nodes.withColumn("depth", _depth("total")).drop("total"), []
    for _ in range(max(1, -(-depth // LEVELS_AT_ONCE))):
        arrays = stored(_slot_arrays(nodes), "slot-arrays")
        rounds.append(arrays)
        nodes = arrays.where("depth > steps").select(
            "group", "place", (F.col("depth") - F.col("steps")).alias("depth"), _top().alias("digest")
        )
    return rounds


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """``group, digest``: the node that each group has been reduced to."""
    ends = [arrays.where("depth = steps").select("group", _top().alias("digest")) for arrays in rounds]
    return reduce(DataFrame.unionByName, ends)


def _handed_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The members of the first round with their whole ``sides``.

    ``above`` has, by group, the siblings over the group's own root and what else its members get.
    """
    handed = [c for c in above.columns if c not in ("group", "sides")]
    within = _sides_within()
    parents = None
    for arrays in reversed(rounds):
        ends = arrays.where("depth = steps").join(above, "group")
        if parents is not None:
            inner = arrays.where("depth > steps").join(parents, ["group", "place"])
            ends = ends.unionByName(inner.select(*ends.columns))
        members = F.transform(
            "members", lambda m, at: F.struct(m.alias("member"), F.concat(within(at), F.col("sides")).alias("sides"))
        )
        opened = ends.select("group", *handed, F.inline(members)).select("group", *handed, "member.*", "sides")
        if arrays is rounds[0]:
            return opened
        parents = stored(opened.select("group", "place", *handed, "sides"), "sides")


def manifest(df: DataFrame, leaf: Column, group: str = "source", key: str = "doc_id", **carried: Column) -> DataFrame:
    """``group, key, place, leaf, subroot, root, sides`` and the columns ``carried`` of each row.

    ``sides`` has, from the leaf up, the digests to the left and right of a row's path in
    its run of ``ARITY`` nodes; :func:`folded` takes a leaf up to the root with them.
    Leaves ascend by key within a group, null keys first; rows of equal key by leaf, then
    by what is carried, so that rows equal in all of these may be told apart by nothing.
    Groups ascend by the bytes of their name; null is a group, the first one. A lone leaf
    is its group's subroot, and a lone subroot the root. An empty table gives no rows.
    Of the input only the columns that are named or used in ``leaf`` and ``carried`` are read.
    """
    name = F.col(group).cast("string")
    rows = df.select(
        F.coalesce(F.concat(F.lit(_NAMED), name), F.lit(_UNNAMED)).alias("group"),
        F.col(key).cast("long").alias("key"),
        leaf.alias("digest"),
        *[column.alias(f"carried_{c}") for c, column in carried.items()],
    )
    leaves = stored(_placed(rows), "placed")
    most, groups = leaves.agg(F.max("total"), F.count_distinct("group")).first()
    rounds = _reduced(leaves, _levels(most or 1))
    subroots = stored(_roots(rounds).withColumn("n", F.lit(1)), "subroots")
    tops = running_total(subroots, [F.asc("group")], "n", "place").select(
        F.lit("").alias("group"), "place", F.lit(groups).cast("long").alias("total"), "digest", F.col("group").alias("of")
    )
    tops = _reduced(tops, _levels(groups or 1))
    roots = _roots(tops).select("group", F.col("digest").alias("root"))
    nothing = roots.withColumn("sides", F.array().cast(SIDES))
    above = _handed_down(tops, nothing).select(
        F.col("of").alias("group"), F.col("digest").alias("subroot"), "root", "sides"
    )
    found = _handed_down(rounds, stored(above, "above"))
    return found.select(
        F.when(F.col("group") != _UNNAMED, F.substring("group", 2, _LONGEST)).alias("group"),
        "key",
        "place",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "sides",
        *[F.col(f"carried_{c}").alias(c) for c in carried],
    )


def _levels(total: int) -> int:
    depth = 0
    while ARITY**depth < total:
        depth += 1
    return depth
