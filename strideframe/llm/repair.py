"""Repair of a conversation's structure by auction shortest paths.

A conversation's rows, in order of their turns, and the states of the role pattern ``(s?(ua)+)?`` span a lattice with integer
costs: keep a row (0), give it the role that the state asks for (3), delete it (4; blank and repeated rows must go), or insert
an empty turn (3).  A kept truncated row costs 3 more.

Nodes carry prices.  A path extends from a node along its cheapest arc; if all arcs cost more than the node's price, the price
rises and the path contracts.  Layers are auctioned from the end of the conversation, so that every path soon reaches a node
whose price has converged: work per row is bounded.  Converged prices are the exact remaining costs, hence an arc is on a
cheapest path exactly if it is tight, and the first letter among tight arcs, node by node, traces the least string of edits.

Scale: rows are dealt by ranges of (conversation, turn, ...), numbered and cut into parts of at most ``2 ** CHUNK_BITS`` rows.  A
conversation within one part is mended there.  Of a longer one, each part gives its 4 x 4 costs between states at its ends,
prices at the cuts run backwards through these, the states at the cuts forwards, and then all parts are mended side by side.
Only what is one sequence by definition (the prices at cuts, the digest of a conversation) is read in order, as a stream.

Defined results: null roles and texts count as one space (a blank row with a role outside the pattern); null turns sort first
and are left out of gaps; rows alike in turn sort by role and text, repeated rows are rows of their own (the later ones
duplicates); a null conversation is a conversation; a conversation without rows has zeros, an empty audit and no turns; very
long texts are read whole; extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import written

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of each role leads from each state, the role that a state asks for, and the states in which a conversation may end.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
LEGAL = ("su", "ua", "au")
CHUNK_BITS = 12  # 4,096 rows of a conversation are mended at once

PART = "conv_id {conv}, part bigint, absent boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct_turns bigint, first_turn bigint, " \
       "last_turn bigint, first_role string, last_role string, cost bigint, audit string, turns array<struct<role:string,text:string>>"
SUMMARY = "conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


@lru_cache(1 << 16)
def arcs(code: str) -> tuple[tuple[tuple[str, int, bool, int], ...], ...]:
    """For each state, ``(letter, cost, whether the row is used, next state)`` in the order of the letters.

    A code is a role's initial, upper case if the row must go, with ``!`` behind it if it is truncated; empty at the end.
    """
    out = []
    for state in range(4):
        own = [("I", INSERT, False, WANTED[state])]
        if not code:
            own += [("", 0, True, state)] * (state in ENDS)
        else:
            own.insert(0, ("D", DELETE, True, state))
            if code[0] != "#":
                late = TRUNCATED * code.endswith("!")
                if state in NEXT.get(code[0], ()):
                    own.append(("K", KEEP + late, True, NEXT[code[0]][state]))
                own.append(("R", REROLE + late, True, WANTED[state]))
        out.append(tuple(own))
    return tuple(out)


@lru_cache(1 << 16)
def auction(code: str, ahead: tuple[int, int, int, int]) -> tuple[int, ...]:
    """Converged prices of a row's four nodes, given those of the layer behind it.

    All start at the least price ahead, which no arc undercuts.  Each node in turn is the origin of a path.  A price that passes
    all that could be paid (``NEVER`` ahead on every way) belongs to a node without a way to the end.
    """
    layer = arcs(code)
    reachable = [p for p in ahead if p < NEVER]
    if not reachable:
        return (NEVER,) * 4
    price, final, most = [min(reachable)] * 4, [False] * 4, max(reachable) + DELETE + REROLE + 3 * INSERT + TRUNCATED
    for origin in range(4):
        path = [origin]
        while not final[origin]:
            node = path[-1]
            cost, used, to = min(((c + (ahead[t] if used else price[t]), used, t) for _, c, used, t in layer[node]), key=lambda a: a[0])
            if cost > price[node]:  # contract
                price[node] = cost if cost <= most else NEVER
                if price[node] == NEVER:
                    final[node] = True
                if len(path) > 1:
                    path.pop()
            elif used or final[to]:  # the path has reached a converged node: all its arcs are tight
                for x in path:
                    final[x] = True
            else:  # extend
                path.append(to)
    return tuple(price)


END_PRICES = (0, 0, 0, 0)


def prices(codes: list[str], behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Prices of all layers of a part; the last is the layer behind it."""
    out = [behind]
    for code in reversed(codes):
        low = min(out[-1])  # prices matter up to a constant, so that equal steps are found again
        out.append(tuple(p if p >= NEVER else p + low for p in auction(code, tuple(p if p >= NEVER else p - low for p in out[-1]))))
    return out[::-1]


def traced(codes: list[str], layers: list[tuple[int, ...]], state: int) -> tuple[str, int]:
    """The least string of edits along tight arcs from a state, and the state behind the last row."""
    letters, i = [], 0
    while i < len(codes):
        letter, used, to = next((letter, used, to) for letter, cost, used, to in arcs(codes[i])[state]
                                if layers[i][state] == cost + layers[i + used][to])
        letters.append(letter)
        state, i = to, i + used
    return "".join(letters), state


def between(codes: list[str]) -> list[list[int]]:
    """The cheapest costs from each state before a part's first row to each state behind its last one."""
    to_each = [prices(codes, tuple(0 if q == to else NEVER for q in range(4)))[0] for to in range(4)]
    return [[to_each[to][q] for to in range(4)] for q in range(4)]


LAST = prices([""], END_PRICES)[0]  # behind the last row: what is still to insert


def mended(rows: list[dict], audit: str, state: int) -> list[dict]:
    """The turns that a string of edits makes of the rows, beginning in a state."""
    out, at = [], 0
    for letter in audit:
        row = None
        if letter != "I":
            row, at = rows[at], at + 1
        if letter == "K":
            out.append({"role": row["role"], "text": row["text"]})
            state = NEXT[row["role"][0]][state]
        elif letter != "D":
            state = WANTED[state]
            out.append({"role": ROLES[state], "text": row["text"] if row else ""})
    return out


# the Spark job


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, ``conv_id, turn, role, text, absent``: by the checksum of ``conv_id:turn`` in twentieths, 0 takes the
    row away (it stays as ``absent``, so that its conversation is known), 1 empties the text, 2 removes its ends of sentences,
    3 repeats the row, 4 makes it a user's.  Nulls count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn))) % 20
    new = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"), fault.alias("fault"))
    return new.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                      F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                      (F.col("fault") == 0).alias("absent"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def parts(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``conv_id, part, rows``: runs of at most ``2 ** chunk_bits`` rows of a conversation in order, ``part`` ascending.

    Rows sort by ranges of (conversation, turn, role, start of the text); a position is the sorted partition and a count in it.
    The first row of each (role, text) is found by partial aggregation over digests and joins its run as a mark, without a text.
    """
    order = ["conv_id", "turn", "role", "head", "text"]
    ranged = rows.withColumn("head", F.substring("text", 1, 64)).repartitionByRange("conv_id", "turn", "role", "head")
    sorted_ = written(ranged.sortWithinPartitions(*order).drop("head").withColumn("at", F.monotonically_increasing_id()), "turns")
    there = sorted_.filter(~F.col("absent"))
    firsts = there.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at"))
    marks = firsts.select("conv_id", "at", F.lit(True).alias("first"))
    both = sorted_.select("conv_id", "at", "absent", "turn", "role", "text").unionByName(marks, allowMissingColumns=True)
    row = F.struct("at", "first", "absent", "turn", "role", "text")
    runs = both.groupBy("conv_id", F.shiftright("at", chunk_bits).alias("run")).agg(F.collect_list(row).alias("rows"))
    return runs.select("conv_id", F.array_min(F.col("rows")["at"]).alias("part"), "rows")


def coded(rows: list[dict]) -> tuple[list[dict], list[str], list[str]]:
    """A part's rows in order, their codes and their faults."""
    firsts = {r["at"] for r in rows if r["first"]}
    rows = sorted((r for r in rows if r["first"] is None and not r["absent"]), key=lambda r: r["at"])
    codes, faults = [], []
    for r in rows:
        bare = r["text"].rstrip("\x20\x09\x0A\x0B\x0C\x0D")
        fault = "blank" if not bare else "duplicate" if r["at"] not in firsts else "truncated" if bare[-1] not in ".!?" else ""
        initial = r["role"][:1] if r["role"][:1] in NEXT else "?"
        codes.append("#" if fault in ("blank", "duplicate") else initial + "!" * (fault == "truncated"))
        faults.append(fault)
    return rows, codes, faults


def records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
         "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split(" ")[0], ARROW[c.split(" ")[1]]) for c in ddl.split(", ")])


def stream(df: DataFrame, ddl: str, make, size: int = 1024) -> DataFrame:
    """``make(iterator of rows) -> iterator of tuples`` over each partition; batches go in and out as they come."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in make(r for b in batches for i in range(0, b.num_rows, 64) for r in b.slice(i, 64).to_pylist()):
            out.append(row)
            if len(out) == size:
                yield records(out, schema)
                out = []
        if out:
            yield records(out, schema)

    return df.mapInArrow(run, ddl)


def states_at_cuts(long: DataFrame, conv: str) -> DataFrame:
    """``part, behind, ends, state`` of the parts of conversations of several parts: the prices behind it, whether it is the last one,
    and the state before it."""

    def costs(rows):
        for r in rows:
            codes = coded(r["rows"])[1]
            yield r["conv_id"], r["part"], [c for line in between(codes) for c in line]

    def backwards(rows):
        conv, price = object(), LAST
        for r in rows:
            if ends := r["conv_id"] != conv:
                conv, price = r["conv_id"], LAST
            yield r["part"], list(price), ends
            price = tuple(min(r["costs"][4 * q + to] + price[to] for to in range(4)) for q in range(4))

    def ways(rows):
        for r in rows:
            codes = coded(r["rows"])[1]
            layers = prices(codes, tuple(r["behind"]))
            yield r["conv_id"], r["part"], r["behind"], r["ends"], [traced(codes, layers, q)[1] for q in range(4)]

    def forwards(rows):
        conv, state = object(), START
        for r in rows:
            if r["conv_id"] != conv:
                conv, state = r["conv_id"], START
            yield r["part"], r["behind"], r["ends"], state
            state = r["ways"][state]

    def in_order(df, *by):
        return df.repartition("conv_id").sortWithinPartitions("conv_id", *by)

    layers = written(stream(long, f"conv_id {conv}, part bigint, costs array<bigint>", costs), "costs")
    priced = written(stream(in_order(layers, F.desc("part")), "part bigint, behind array<bigint>, ends boolean", backwards), "prices")
    through = written(stream(long.join(priced, "part"), f"conv_id {conv}, part bigint, behind array<bigint>, ends boolean, ways array<bigint>", ways), "ways")
    return stream(in_order(through, "part"), "part bigint, behind array<bigint>, ends boolean, state bigint", forwards)


def of_several_parts(df: DataFrame) -> DataFrame:
    """The conversations of several parts, as ``other``: at most one per 4,096 rows."""
    return written(df.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("other")), "several")


def repair(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Repaired conversations in parts, from ``conv_id, turn, role, text, absent``: one row per part, with its faults, the edits
    (``audit``), their cost and the repaired ``turns``.  The parts of a conversation follow each other by ``part``."""
    conv = dict(rows.dtypes)["conv_id"]
    filled = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), "absent")
    cut = written(parts(filled, chunk_bits), "parts")
    long = written(cut.join(of_several_parts(cut), F.col("conv_id").eqNullSafe(F.col("other")), "left_semi"), "long")
    states = written(states_at_cuts(long, conv), "states")

    def mend(rows):
        for r in rows:
            state = r["state"] if r["state"] is not None else START
            whole, codes, faults = coded(r["rows"])
            codes = codes + [""] * bool(r["last"])
            layers = prices(codes, END_PRICES if r["last"] else tuple(r["behind"]))
            audit, end = traced(codes, layers, state)
            turns = [x["turn"] for x in whole if x["turn"] is not None]
            initials = [x["role"][:1] for x in whole]
            yield (r["conv_id"], r["part"], not whole, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                   sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), len(set(turns)), turns[0] if turns else None,
                   turns[-1] if turns else None, initials[0] if whole else None, initials[-1] if whole else None,
                   layers[0][state] - layers[-1][end], audit, mended(whole, audit, state))

    marked = cut.join(states, "part", "left").withColumn("last", F.coalesce("ends", F.lit(True)))
    return written(stream(marked.select("conv_id", "part", "rows", "behind", "state", "last"), PART.format(conv=conv), mend, 256), "repaired")


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation from its repaired parts: faults, gaps between turns, edits with their cost, and the digest of
    the turns (``role:text``, joined by line feeds)."""
    conv = dict(repaired.dtypes)["conv_id"]

    def finish(rows):
        whole = None
        for r in rows:
            if whole is None or r["conv_id"] != whole["conv_id"]:
                if whole:
                    yield done(whole)
                whole = {"conv_id": r["conv_id"], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [],
                         "hash": hashlib.sha256(), "any": False, "turn": None, "role": None}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                whole[c] += r[c]
            if not r["absent"]:
                whole["illegal"] += whole["role"] is not None and whole["role"] + r["first_role"] not in LEGAL
                whole["role"] = r["last_role"]
            if r["distinct_turns"]:
                span = r["last_turn"] - r["first_turn"] + 1 - r["distinct_turns"]
                whole["gaps"] += span + (max(0, r["first_turn"] - whole["turn"] - 1) if whole["turn"] is not None else 0)
                whole["turn"] = r["last_turn"]
            whole["audit"].append(r["audit"])
            for turn in r["turns"]:
                whole["hash"].update((("\n" if whole["any"] else "") + turn["role"] + ":" + turn["text"]).encode())
                whole["any"] = True
        if whole:
            yield done(whole)

    def done(w):
        return (*(w[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(w["audit"]), w["hash"].hexdigest())

    several = of_several_parts(repaired)
    same = F.col("conv_id").eqNullSafe(F.col("other"))
    ordered = repaired.join(several, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ddl = SUMMARY.format(conv=conv)
    return stream(repaired.join(several, same, "left_anti"), ddl, finish).union(stream(ordered, ddl, finish))
