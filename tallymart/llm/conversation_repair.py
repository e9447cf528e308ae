"""Faults of conversations and their cheapest repair; see :mod:`tallymart.llm.repair_search`.

1. Rows without their text are sorted by conversation and turn across all tasks and
   numbered, so a conversation of any length is cut into stretches of ``STRETCH`` rows.
2. A row that repeats an earlier one is found by its hash, in counts per task first.
3. A conversation of one stretch is searched as it is. Stretches of longer ones are
   searched from every state to every state, side by side, and joined by sixty-fours.
4. The texts move once, to be read in order behind their conversation's audit.

The last step passes over a conversation's text in order in one task, as a digest of
it must, and holds no more of it than its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm import repair_search
from tallymart.llm.chunks import in_parts
from tallymart.llm.tables import stored

#: Stretches have 2 ** 10 rows, and so many are joined at once.
STRETCH_BITS = 10
JOINED_AT_ONCE = 64
SPACE = " \t\n\x0b\f\r"
_LEGAL = "('su', 'ua', 'au')"
_ROWS_AT_ONCE = 4096
_MEASURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
AUDITS = "conv long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", audit string"
REPAIRED = "conv long, place long, edit string, role string, text string"


def _turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, tie``; the tie is equal for equal role and text."""
    columns = [F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn")]
    columns += [F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    tie = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return df.select(*columns).withColumn("tie", tie)


def _numbered(turns: DataFrame) -> DataFrame:
    """``conv, turn, tie, initial, code, at``, ``at`` in the order of conversation, turn and tie."""
    words = F.btrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(repair_search.OTHER)
    finished = F.right(words, F.lit(1)).isin(".", "!", "?")
    code = F.when(words == "", "b").when(finished, initial).otherwise(F.upper(initial))
    slim = turns.select("conv", "turn", "tie", initial.alias("initial"), code.alias("code"))
    # the salt deals out rows that are equal in everything
    slim = slim.withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "tie", "salt"]
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    return stored(slim.withColumn("at", F.monotonically_increasing_id()), "turns")


def _coded(rows: DataFrame) -> DataFrame:
    """The rows with code ``d`` where an earlier row of the conversation has the same role and text."""
    seen = rows.groupBy("conv", "tie").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv").alias("conv_"), F.col("tie").alias("tie_"), "first")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("tie") == F.col("tie_"))
    again = (F.col("code") != "b") & (F.col("at") > F.col("first"))
    code = F.when(again, repair_search.MUST_GO).otherwise(F.col("code"))
    return rows.join(seen, same, "left").select("conv", "turn", "at", "initial", code.alias("code"))


def _stretches(rows: DataFrame) -> DataFrame:
    """A row for each ``2 ** STRETCH_BITS`` rows at most of a conversation, with its number and theirs."""
    stretch = F.shiftright("at", STRETCH_BITS).alias("stretch")
    found = rows.groupBy("conv", stretch).agg(
        F.sort_array(F.collect_list(F.struct("at", "code", "initial", "turn"))).alias("rows")
    )
    found = found.select(
        "conv",
        "stretch",
        F.array_join("rows.code", "").alias("codes"),
        F.array_join("rows.initial", "").alias("initials"),
        F.col("rows.turn").alias("turns"),
    )
    order = Window.partitionBy("conv").orderBy("stretch")
    found = found.select(
        "conv",
        "codes",
        (F.row_number().over(order) - 1).cast("long").alias("i"),
        F.count("*").over(Window.partitionBy("conv")).alias("k"),
        F.array_min("turns").alias("low"),
        F.array_max("turns").alias("high"),
        F.size(F.array_distinct(F.filter("turns", lambda t: t.isNotNull()))).alias("distinct"),
        F.col("turns")[0].alias("first"),
        F.lag(F.element_at("turns", -1)).over(order).alias("before"),
        F.concat(F.coalesce(F.lag(F.right("initials", F.lit(1))).over(order), F.lit("")), "initials").alias("initials"),
    )
    return stored(found, "stretches")


def _heads(stretches: DataFrame) -> DataFrame:
    """Each conversation with its measures, and its codes if it has one stretch."""

    def number(characters: str) -> Column:
        return F.sum(F.length("codes") - F.length(F.translate("codes", characters, ""))).cast("long")

    # ``initials`` begins with the last one of the stretch before
    pairs = F.expr(
        "filter(sequence(1, length(initials)), i -> i < length(initials)"
        f" and substring(initials, i, 2) not in {_LEGAL})"
    )
    again = F.coalesce((F.col("before") == F.col("first")).cast("int"), F.lit(0))
    gaps = F.max("high") - F.min("low") + 1 - F.sum(F.col("distinct") - again)
    return stretches.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        number("b").alias("blank"),
        number(repair_search.MUST_GO).alias("duplicate"),
        number("SUAX").alias("truncated"),
        F.sum(F.size(pairs)).cast("long").alias("illegal"),
        F.max(F.when(F.col("k") == 1, F.col("codes"))).alias("codes"),
    )


_TABLE = "conv long, i long, costs array<long>, audits array<string>"


def _codes(codes: str) -> str:
    return codes.replace("b", repair_search.MUST_GO)


def _tables(stretches: DataFrame) -> DataFrame | None:
    """``conv, costs, audits``: the table of each conversation of several stretches."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, i, codes in zip(*(c.to_pylist() for c in batch.columns)):
                yield _table_row(conv, i, repair_search.table(_codes(codes)))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                conv, i, parts = (c[at].as_py() for c in batch.columns)
                tables = [_table(p["costs"], p["audits"]) for p in parts]
                while len(tables) > 1:
                    pairs = zip(tables[::2], tables[1::2])
                    tables = [repair_search.joined(*p) for p in pairs] + tables[len(tables) & ~1 :]
                yield _table_row(conv, i, tables[0])

    level = stretches.where("k > 1").select("conv", "i", "codes").mapInArrow(searched, _TABLE)
    while True:
        level = stored(level, "tables")
        top = level.agg(F.max("i")).first()[0]
        if not top:
            return None if top is None else level.drop("i")
        group = F.floor(F.col("i") / JOINED_AT_ONCE).cast("long").alias("i")
        parts = level.select("conv", group, F.struct("i", "costs", "audits").alias("part"))
        parts = parts.groupBy("conv", "i").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        level = parts.mapInArrow(folded, _TABLE)


def _table(costs: list, audits: list) -> list[repair_search.Best]:
    return [None if cost is None else (cost, audit) for cost, audit in zip(costs, audits)]


def _table_row(conv: int | None, i: int, table: list[repair_search.Best]) -> pa.RecordBatch:
    costs, audits = ([b and b[side] for b in table] for side in (0, 1))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    columns = [pa.array([value], kind) for value, kind in zip((conv, i, costs, audits), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", "i", "costs", "audits"])


def _audits(turns: DataFrame) -> DataFrame:
    stretches = _stretches(_coded(_numbered(turns)))
    heads, kinds = _heads(stretches), [pa.int64(), pa.string()]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, repair_search.Best] = {}
        for batch in batches:
            found = []
            for codes in batch.column("codes").to_pylist():
                if codes is not None and codes not in known:
                    if len(known) >= _ROWS_AT_ONCE:
                        known.clear()
                    known[codes] = repair_search.search(_codes(codes))
                found.append(known[codes] if codes is not None else (None, None))
            columns = [pa.array([f[side] for f in found], kind) for side, kind in enumerate(kinds)]
            rest = [batch.column(c) for c in ["conv", *_MEASURES[:-1]]]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=["conv", *_MEASURES, "audit"])

    heads, tables = heads.mapInArrow(searched, AUDITS), _tables(stretches)
    if tables is None:
        return heads
    ends = [F.struct(F.col("costs")[e].alias("cost"), F.col("audits")[e].alias("audit")) for e in repair_search.ENDS]
    of_long = tables.select(F.col("conv").alias("conv_"), F.array_min(F.array(*ends)).alias("best"))
    joined = heads.join(of_long, F.col("conv").eqNullSafe(F.col("conv_")), "left")
    better = [F.coalesce(F.col(c), F.col("best")[c]).alias(c) for c in ("cost", "audit")]
    return joined.select("conv", *_MEASURES[:-1], *better)


def _in_order(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's audit and measures, then its rows, in one partition."""
    turns = _turns(df, key, turn, role, text)
    heads = stored(_audits(turns), "audits")
    both = heads.unionByName(turns, allowMissingColumns=True)
    order = ["conv", F.col("audit").isNull(), "turn", "tie"]
    columns = ["conv", *_MEASURES, "audit", "role", "text"]
    return both.repartition("conv").sortWithinPartitions(*order).select(*columns)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in in_parts(batch, batch.schema.get_field_index("text")):
            yield from part.to_pylist()


def _as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def audits(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    Rows stand by turn, null turns first, rows of equal turn by a hash of role and text. Null
    roles and texts count as one space. A row's first fault counts: blank; role and
    text seen earlier; truncated. ``gaps`` counts the turns missing between the least and
    the largest, ``illegal`` the neighbours whose roles' initials are not su, ua or au; a role
    with another initial or none is changed or goes. Rows of null key are a conversation.
    An empty table gives no rows; other columns are not read.
    """
    kinds = [pa.field(m, pa.int64()) for m in ["conv", *_MEASURES]]
    schema = pa.schema([*kinds, pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for row in _parts(batches):
            if row["audit"] is not None:
                if now:
                    done.append(now.row())
                    if len(done) >= _ROWS_AT_ONCE:
                        yield _as_batch(done, schema)
                        done = []
                now = _Digest(row)
            else:
                now.add(row["role"], row["text"])
        yield _as_batch(done + ([now.row()] if now else []), schema)

    found = _in_order(df, key, turn, role, text).mapInArrow(digest, AUDITS + ", repaired_sha256 string")
    return found.withColumnRenamed("conv", key)


def repaired(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, place, edit, role, text`` of the rows that remain of each conversation, ``place`` from 0.

    ``edit`` is K, R or I. Conversations of which nothing remains are not among them; for
    the order and odd rows see :func:`audits`.
    """
    kinds = [("conv", pa.int64()), ("place", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))]
    schema = pa.schema(kinds)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bounded(_replayed(_parts(batches))):
            yield _as_batch(rows, schema)

    found = _in_order(df, key, turn, role, text).mapInArrow(replayed, REPAIRED)
    return found.withColumnRenamed("conv", key)


class _Digest:
    """The digest of the conversation that is being read."""

    def __init__(self, head: dict):
        self.head = {c: head[c] for c in ["conv", *_MEASURES, "audit"]}
        self.replay = repair_search.Replay(head["audit"])
        self.digest, self.empty = hashlib.sha256(), True

    def _take(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.empty = False

    def add(self, role: str, text: str) -> None:
        for new in self.replay.inserted():
            self._take(new, "")
        after = self.replay.edit(role)[1]
        if after is not None:
            self._take(after, text)

    def row(self) -> dict:
        for new in self.replay.inserted():
            self._take(new, "")
        return self.head | {"repaired_sha256": self.digest.hexdigest()}


def _replayed(rows: Iterator[dict]) -> Iterator[dict]:
    replay, conv, place = repair_search.Replay(""), None, 0
    for row in rows:
        head = row["audit"] is not None
        found = [(repair_search.INSERT, new, "") for new in replay.inserted()]
        if not head:
            found.append((*replay.edit(row["role"]), row["text"]))
        for edit, role, text in found:
            if role is not None:
                yield {"conv": conv, "place": place, "edit": edit, "role": role, "text": text}
                place += 1
        if head:
            replay, conv, place = repair_search.Replay(row["audit"]), row["conv"], 0
    for new in replay.inserted():
        yield {"conv": conv, "place": place, "edit": repair_search.INSERT, "role": new, "text": ""}
        place += 1


def _bounded(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Lists of rows, of bounded number and about bounded size."""
    found, size = [], 0
    for row in rows:
        found.append(row)
        size += len(row["text"])
        if len(found) >= _ROWS_AT_ONCE or size >= 1 << 21:
            yield found
            found, size = [], 0
    yield found
