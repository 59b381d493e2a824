"""Repair of conversation structure by a fold of Spark SQL's higher-order functions.

Window functions mark each turn as blank, duplicate or truncated. Turns are collected in order and aggregate() carries one
(cost, audit) struct for each state of the wanted order of roles: nothing yet, a system turn, the last turn is the user's,
the last turn is the assistant's. Each step extends them by the edits and keeps the least of each, by cost and then by audit.
Two audits of equal cost in one state never begin each other (what one has beyond the other would be inserts, which cost),
so the order of what is kept never changes by what follows.

A conversation of any length is cut into chunks of CHUNK turns, by a range partitioning and not by a group of all its turns. A
chunk is folded from every state that it may be entered in, the first from the first alone; a second fold over a
conversation's chunks takes the best way through. What has to be held of a whole conversation is its audit, one letter a
turn, which is a cell of the result; the repaired text is hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions, range_chunks, staged

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Turns of one chunk.
CHUNK = 256
#: Equal turns of a conversation are first looked for within so many parts.
SALTS = 16
STATES = ("none", "system", "user", "assistant")
REROLE, DELETE, INSERT = 2, 3, 2
WAY = "struct<cost:bigint,audit:string,entries:array<int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of conv_id and turn decides; nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def flagged(turns: DataFrame) -> DataFrame:
    """turns with their first fault: blank, duplicate or truncated, or none."""
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text", F.pmod(F.xxhash64("row"), F.lit(SALTS))).orderBy(F.col("turn").asc_nulls_first(), "row"))
    # Only the first of each part can be the first of all; the others stay spread.
    rows = turns.withColumn("part", F.when(seen == 1, -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(SALTS))))
    first = F.row_number().over(Window.partitionBy("conv", "role", "text", "part").orderBy(F.col("turn").asc_nulls_first(), "row"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", "blank").when((F.col("part") != -1) | (first > 1), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault).drop("part")


def _more(way: Column, cost: Column | int, letter: str) -> Column:
    return F.when(way.isNotNull(), F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit"), way["entries"].alias("entries"))).cast(WAY)


def _inserted(ways: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(user, assistant): the two ways after inserts."""
    user = F.least(ways["user"], *(_more(ways[s], INSERT, "I") for s in ("none", "system", "assistant")))
    return _let(user, lambda u: _let(F.least(ways["assistant"], _more(u, INSERT, "I")), lambda a: body(u, a)))


def _ways(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _step(ways: Column, turn: Column) -> Column:
    """All ways through one more turn: inserts before it, then it is kept, given the other role or deleted."""
    none, system = ways["none"], ways["system"]
    late = F.when(turn["fault"] == "truncated", 1).otherwise(0)
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    initial = F.substring(turn["role"], 1, 1)
    kept = lambda as_, way: F.when(stays & (initial == as_), _more(way, late, "K"))
    role = lambda way: F.when(stays, _more(way, late + REROLE, "R"))
    gone = lambda way: _more(way, DELETE, "D")

    def step(user: Column, assistant: Column) -> Column:
        before_user = F.least(none, system, assistant)
        return _ways(
            gone(none),
            F.least(gone(system), kept("s", none)),
            F.least(gone(user), kept("u", before_user), role(before_user)),
            F.least(gone(assistant), kept("a", user), role(user)),
        )

    return _inserted(ways, step)


def _start(state: Column) -> Column:
    way = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<int>").alias("entries")).cast(WAY)
    return _ways(*(F.when(state == i, way).cast(WAY) for i in range(len(STATES))))


def _through(ways: Column, chunk: Column) -> Column:
    """The best way into each state over one chunk: chunk.ways[i] holds the ways that enter it in state i."""

    def into(state: str) -> Column:
        options = []
        for i, entered in enumerate(STATES):
            before, inside = ways[entered], F.get(chunk["ways"], F.lit(i))[state]
            joined = F.struct((before["cost"] + inside["cost"]).alias("cost"), F.concat(before["audit"], inside["audit"]).alias("audit"), F.concat(before["entries"], F.array(F.lit(i))).alias("entries"))
            options.append(F.when(before.isNotNull() & inside.isNotNull(), joined).cast(WAY))
        return F.least(*options)

    return _ways(*(into(s) for s in STATES))


def _finished(ways: Column) -> Column:
    """The best way that ends in a wanted order; its entries end with the state in which the last chunk is left."""
    marked = _ways(*(F.when(ways[s].isNotNull(), F.struct(ways[s]["cost"].alias("cost"), ways[s]["audit"].alias("audit"), F.concat(ways[s]["entries"], F.array(F.lit(i))).alias("entries"))).cast(WAY) for i, s in enumerate(STATES)))
    return _inserted(marked, lambda _, assistant: F.least(marked["none"], assistant))


def _following(state: Column) -> Column:
    """The state after the next turn in the wanted order, where that is no system turn."""
    return F.when(state == 2, 3).otherwise(2)


def _named(state: Column) -> Column:
    return F.when(state == 2, "user:").otherwise("assistant:")


def _added(state: Column, inserts: Column) -> Column:
    """The lines of none, one or two inserted turns after state."""
    one = _named(_following(state))
    two = F.array(one, _named(_following(_following(state))))
    return F.when(inserts == 0, F.array().cast("array<string>")).when(inserts == 1, F.array(one)).otherwise(two)


def _piece(entry: Column, letters: Column, turns: Column) -> Column:
    """The repaired lines of a chunk that is entered in the state entry."""
    # Letters of inserts stand before the letter of the turn they precede: as many tokens as turns.
    tokens = F.regexp_extract_all(letters, F.lit("(I*[DKR])"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), entry.alias("state"), F.array().cast("array<string>").alias("lines"))
    none = F.array().cast("array<string>")

    def step(done: Column, token: Column) -> Column:
        turn = F.get(turns, done["at"])
        inserts, letter = F.length(token) - 1, F.right(token, F.lit(1))
        after = F.when(inserts == 0, done["state"]).when(inserts == 1, _following(done["state"])).otherwise(_following(_following(done["state"])))
        kept_system = (letter == "K") & (F.substring(turn["role"], 1, 1) == "s")
        state = F.when(letter == "D", after).when(kept_system, 1).otherwise(_following(after))
        own = F.when(letter == "D", none).when(letter == "K", F.array(F.concat(turn["role"], F.lit(":"), turn["text"])))
        rerole = F.array(F.concat(_named(_following(after)), turn["text"]))
        return F.struct((done["at"] + 1).alias("at"), state.alias("state"), F.concat(done["lines"], _added(done["state"], inserts), own.otherwise(rerole)).alias("lines"))

    return F.aggregate(tokens, start, step, lambda done: done["lines"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and place: the SHA-256 of each conversation's pieces, joined by newlines."""
    conv, digest, any_line = None, None, False

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])

    for batch in batches:
        rows = []
        for name, n, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "lines", "text")), strict=True):
            if name != conv:
                if conv is not None:
                    rows.append((conv, digest.hexdigest()))
                conv, digest, any_line = name, hashlib.sha256(), False
            if n:
                digest.update((("\n" if any_line else "") + text).encode())
                any_line = True
        yield out(rows)
    if conv is not None:
        yield out([(conv, digest.hexdigest())])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of damaged(conversations): see repaired().

    An empty table gives an empty result; extra columns are not read.
    """
    return repaired(damaged(conversations), conversations.select("conv_id").distinct())


def repaired(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of ids.

    turns: conv_id, turn, role, text without nulls in role and text. Turns are taken by turn, nulls first, then by role and
    text; equal rows count as repetitions. A turn with an empty role cannot be kept as it is. A null conv_id is a conversation of its own. A conversation without turns has
    zeros, an empty audit and the hash of nothing. The longest conversation is bounded by its audit only.
    """
    spark = turns.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    rows = staged(turns.select(key, "turn", "role", "text").withColumn("row", F.monotonically_increasing_id()), "turns")
    marked = flagged(rows)
    placed = range_chunks(marked, "conv", (F.col("turn").asc_nulls_first(), "role", "text", "row"), CHUNK)
    turn = F.struct("slice", "at", "turn", "role", "text", "fault")
    count = lambda c, name: F.count(F.when(F.col("fault") == name, 1)).alias(c)
    chunks = placed.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *(count(c, c) for c in ("blank", "duplicate", "truncated")))
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    chunks = staged(chunks.withColumn("initials", initials), "chunks")
    firsts = chunks.groupBy("conv").agg(F.min("chunk").alias("first"))
    pairs = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: F.when(F.concat(x, y).isin("su", "ua", "au"), 0).otherwise(1)), lambda p: p == 1))
    initial = F.col("initials")
    states = F.when(F.col("chunk") == F.col("first"), F.array(F.lit(0))).otherwise(F.array(*(F.lit(i) for i in range(len(STATES)))))
    folded = staged(
        chunks.join(firsts, "conv").select(
            "conv", "chunk", "blank", "duplicate", "truncated",
            pairs(F.slice(initial, F.lit(1), F.size(initial) - 1), F.slice(initial, F.lit(2), F.size(initial))).alias("illegal"),
            F.get(initial, F.lit(0)).alias("head"), F.element_at(initial, -1).alias("tail"),
            F.transform(states, lambda s: F.aggregate("turns", _start(s), _step)).alias("ways"),
        ),
        "folded",
    )
    whole = folded.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "head", "tail", "ways"))).alias("chunks"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
    )
    best = F.aggregate("chunks", _start(F.lit(0)), _through, _finished).alias("best")
    seams = pairs(F.transform(F.slice("chunks", F.lit(1), F.size("chunks") - 1), lambda c: c["tail"]), F.transform(F.slice("chunks", F.lit(2), F.size("chunks")), lambda c: c["head"]))
    places = F.transform("chunks", lambda c: c["chunk"]).alias("places")
    solved = staged(whole.select("conv", "blank", "duplicate", "truncated", (F.col("illegal") + seams).alias("illegal"), best, places), "solved")

    edited = (
        solved.select("conv", F.posexplode("places").alias("place", "chunk"), F.size("places").alias("places"), "best")
        .select("conv", "chunk", "place", "places", F.get("best.entries", F.col("place")).alias("entry"), F.get("best.entries", F.col("place") + 1).alias("leave"), F.length(F.regexp_extract("best.audit", "I*$", 0)).alias("left"))
        .join(folded.select("conv", "chunk", "ways"), ["conv", "chunk"])
        .join(chunks.select("conv", "chunk", "turns"), ["conv", "chunk"])
    )
    way = F.get("ways", F.col("entry"))
    letters = F.coalesce(*(F.when(F.col("leave") == i, way[s]["audit"]) for i, s in enumerate(STATES)))
    left = F.when(F.col("place") + 1 == F.col("places"), _added(F.col("leave"), F.col("left"))).otherwise(F.array().cast("array<string>"))
    lines = edited.select("conv", "place", "places", F.concat(_piece(F.col("entry"), letters, F.col("turns")), left).alias("lines"))
    pieces = lines.select("conv", "place", "places", F.size("lines").alias("lines"), F.array_join("lines", "\n").alias("text"))
    short = pieces.filter("places = 1").select("conv", F.sha2("text", 256).alias("repaired_sha256"))
    long = pieces.filter("places > 1").repartition(partitions(spark), "conv").sortWithinPartitions("conv", "place")
    hashes = short.union(long.mapInArrow(_hashed, "conv string, repaired_sha256 string"))

    span = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    done = solved.join(hashes, "conv").join(span, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "repaired_sha256")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return (
        ids.select("conv_id", key)
        .join(done, "conv", "left")
        .select("conv_id", *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    )
