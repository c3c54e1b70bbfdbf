"""Cheapest repair of conversations: depth-first branch and bound over edits.

A conversation's rows are kept (K), given the role that is due (R, cost 1), deleted (D, 2), and
turns without text are inserted (I, 5), so that the initials of its roles read ``(s?(ua)+)?``.
Blank and repeated rows must go; a truncated row that stays costs 5. Among the cheapest
edits those count whose initials, the audit, come first in ASCII.

The search holds an explicit stack of prefixes (row, state, cost, audit). A prefix is cut when
its cost and a lower bound of the rest exceed the incumbent, when it ties with the incumbent
but its audit comes later, or when the table of its node (row, state) has a prefix that is no
worse. The bound is the cheapest way through the remaining rows whatever the state they end
in. When the stack is empty the incumbent is optimal. Edits between two rows count
with the later one, so no audit is the beginning of another, and optimal parts make optimal wholes.

Conversations of any length: turns are sorted over the cluster and cut into segments of at
most ``SEGMENT_ROWS`` rows. A conversation that lies in one segment is solved there. Of others each
segment is searched from every state to every state; small matrices of costs, with the
ASCII order of their audits, are composed 256 at a time until one group holds a conversation, and the
chosen states go back down. Texts seen in earlier segments meet by hash, a row a segment.
Only the SHA-256 of such a conversation is one task's work: it is sequential by nature.

Defined results: null roles and texts are one space; a null turn comes first; equal turns are
ordered by role, then text; rows with a null conversation id are one conversation; a role that
begins with none of s, u, a, or is empty, cannot be kept; equal rows are told by a 128-bit
hash. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.frames import released, small_batches
from tidewatt.session import staged

SEGMENT_ROWS = 256
SEGMENT_BYTES = 1 << 20
FAN = 8  # bits: so many matrices meet at once
SPACES = " \t\n\v\f\r"
RIGHT_ENDS = ".!?"

START, SYSTEM, USER, ASSISTANT = STATES = range(4)  # the role that came last
ROLES = {USER: "user", ASSISTANT: "assistant"}
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, **{(state, "ua"[due - USER]): due for state, due in DUE.items()}}
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What ends a conversation after each state.
TAILS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
NEVER = 1 << 60

ROW = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def moves(state: int, kind: str) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of each edit of a row; a kind is x (must go) or an initial, in upper case if truncated."""
    out = [(DELETE, "D", state)]
    if kind != "x":
        more, first = (TRUNCATED if kind.isupper() else 0), kind.lower()
        if (state, first) in KEPT:
            out.append((more, "K", KEPT[state, first]))
        if KEPT.get((state, first)) != DUE[state]:
            out.append((RELABEL + more, "R", DUE[state]))
    return out


def bounds(kinds: str) -> list[list[int]]:
    """The least cost of the rows from each on, by state, whatever state they end in."""
    out = [[0] * len(STATES)]
    for kind in reversed(kinds):
        rest = out[-1]
        here = [min(cost + rest[to] for cost, _, to in moves(state, kind)) for state in STATES]
        for _ in range(2):  # inserted turns lead on to other states
            here = [min(here[state], INSERT + here[DUE[state]]) for state in STATES]
        out.append(here)
    return out[::-1]


def search(kinds: str, entry: int, goals: dict[int, tuple[int, str, int]]) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) for each goal. ``goals`` has, by final state, a cost and letters to add and the goal's number."""
    rest, rows = bounds(kinds), len(kinds)
    wanted = {number for _, _, number in goals.values()}
    incumbent: dict[int, tuple[int, str]] = {}
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(rows + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if len(incumbent) == len(wanted):
            least = cost + rest[at][state]
            if all(least > c or (least == c and audit > a[: len(audit)]) for c, a in incumbent.values()):
                continue
        seen = table[at].get(state)
        if seen is not None and seen <= (cost, audit):
            continue
        table[at][state] = (cost, audit)
        if at == rows:
            more, letters, number = goals[state]
            found = (cost + more, audit + letters)
            if number not in incumbent or found < incumbent[number]:
                incumbent[number] = found
            continue
        further = [(cost + more + rest[at + 1][to], letter, at + 1, to, cost + more) for more, letter, to in moves(state, kinds[at])]
        further.append((cost + INSERT + rest[at][DUE[state]], "I", at, DUE[state], cost + INSERT))
        further.sort(reverse=True)  # the most promising is taken from the stack first
        stack.extend((to_row, to, spent, audit + letter) for _, letter, to_row, to, spent in further)
    return incumbent


@lru_cache(maxsize=4096)
def solved(kinds: str) -> tuple[int, str]:
    """The repair of a whole conversation."""
    return search(kinds, START, {state: (*tail, 0) for state, tail in TAILS.items()})[0]


def transfer(kinds: str, entry: int) -> dict[int, tuple[int, str]]:
    """The best way through a segment to each state that can be reached."""
    return search(kinds, entry, {state: (0, "", state) for state in STATES})


def applied(audit: str, rows: list[dict], state: int = START) -> list[tuple[str, str]]:
    """Role and text of each turn after the edits of ``audit``."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = DUE[state]
            out.append((ROLES[state], ""))
            continue
        row, at = rows[at], at + 1
        if letter == "K":
            state = KEPT[state, initial(row["role"])]
            out.append((row["role"], row["text"]))
        elif letter == "R":
            state = DUE[state]
            out.append((ROLES[state], row["text"]))
    return out


def marks(conv_id: object, rows: list[dict]) -> list[bytes]:
    """A hash of the conversation, role and text of each row."""
    head = hashlib.blake2b(repr(conv_id).encode() + b"\0", digest_size=16)
    out = []
    for row in rows:
        mark = head.copy()
        role = row["role"].encode()
        mark.update(len(role).to_bytes(8, "little") + role + row["text"].encode())
        out.append(mark.digest())
    return out


def faults(rows: list[dict], marked: list[bytes], before: set[bytes]) -> tuple[list[str], str]:
    """The first fault of each row (or none), and the rows' kinds; ``before``: what earlier segments hold."""
    seen, names, kinds = set(before), [], []
    for row, mark in zip(rows, marked):
        said = row["text"].rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if mark in seen else "truncated" if said[-1] not in RIGHT_ENDS else ""
        seen.add(mark)
        names.append(fault)
        first = initial(row["role"])
        kinds.append("x" if fault in ("blank", "duplicate") else first.upper() if fault else first)
    return names, "".join(kinds)


def segments(turns: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, at, whole, rows): runs of at most ``most_rows`` turns of a conversation, ``at`` in their order over the
    table. ``whole``: the segment certainly has all of its conversation, which no other partition can share."""
    rows = turns.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "turn", "role", "text")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("rows", T.ArrayType(ROW))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        number, size, waiting = 0, 0, 0
        conv, first, begun = None, True, True  # the held conversation is the partition's first; the held segment begins it
        held: list[dict] = []
        done: list[tuple] = []
        kind = None

        def close(ends: bool) -> None:
            """Ends the held segment; ``ends``: its conversation ends with it inside this partition."""
            nonlocal number, size, waiting, held
            done.append((conv, base + number, ends and begun and not first, held))
            number, size, waiting, held = number + 1, 0, waiting + size, []

        for batch in batches:
            kind = batch.column(0).type
            for key, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held and key != conv:
                    close(True)
                    first, begun = False, True
                elif held and (len(held) >= most_rows or size + len(text) > SEGMENT_BYTES):
                    close(False)
                    begun = False
                conv, size = key, size + len(text)
                held.append({"turn": turn, "role": role, "text": text})
                if len(done) >= 1024 or waiting > SEGMENT_BYTES:
                    yield batch_of(done, kind)
                    done.clear()
                    waiting = 0
        if held:
            close(False)
        if done:
            yield batch_of(done, kind)

    def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        row = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((kind, pa.int64(), pa.bool_(), row))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return small_batches(rows).mapInArrow(lambda batches: released(run(batches)), schema)


def repeats(pieces: DataFrame) -> DataFrame:
    """(at, before): for each segment the hashes of its rows that an earlier segment of the conversation has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, at, rows in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2)]):
                once = list(dict.fromkeys(marks(conv, rows)))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(once), pa.int64()), pa.array(once, pa.binary())], names=["at", "mark"])

    marked = pieces.select("conv_id", "at", "rows").mapInArrow(run, "at long, mark binary")
    first = marked.groupBy("mark").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return marked.join(first, "mark").where("at > first").groupBy("at").agg(F.collect_list("mark").alias("before"))  # at most a segment's rows


def compose(nodes: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[list[int]]]:
    """One matrix from consecutive ones: costs, the order of the ways from a state, and for each way the states before its parts.

    A matrix has, at 4 * entry + exit, a cost (NEVER if there is no way) and the place of its audit among
    those from the same entry.
    """
    costs, ranks, ways = [NEVER] * 16, [0] * 16, [[] for _ in range(16)]
    for entry in STATES:
        # of each state the best way there; ways are compared where they first part
        best: dict[int, tuple[int, list[int], list[int]]] = {entry: (0, [], [])}
        for cost, rank in nodes:
            reached: dict[int, tuple[int, list[int], list[int]]] = {}
            for state, (spent, letters, states) in best.items():
                for to in STATES:
                    if cost[4 * state + to] < NEVER:
                        way = (spent + cost[4 * state + to], [*letters, rank[4 * state + to]], [*states, state])
                        if to not in reached or way[:2] < reached[to][:2]:
                            reached[to] = way
            best = reached
        for place, to in enumerate(sorted(best, key=lambda to: best[to][1])):
            costs[4 * entry + to], ranks[4 * entry + to], ways[4 * entry + to] = best[to][0], place, best[to][2]
    return costs, ranks, ways


NODE = "conv_id {kind}, at long, costs array<long>, ranks array<int>, parts array<long>, ways array<array<int>>"
CHOICE = "at long, entry int, exit int, last boolean"


def matrices(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv_id, at, costs, ranks) of segments with ``before``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, at, rows, before in zip(*[c.to_pylist() for c in batch.columns]):
                kinds = faults(rows, marks(conv, rows), set(before or ()))[1]
                costs, ranks = [NEVER] * 16, [0] * 16
                for entry in STATES:
                    found = transfer(kinds, entry)
                    for place, to in enumerate(sorted(found, key=lambda to: found[to][1])):
                        costs[4 * entry + to], ranks[4 * entry + to] = found[to][0], place
                out.append((conv, at, costs, ranks))
            types = (batch.column(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["conv_id", "at", "costs", "ranks"])

    return pieces.select("conv_id", "at", "rows", "before").mapInArrow(run, f"conv_id {kind}, at long, costs array<long>, ranks array<int>")


def chosen_states(nodes: DataFrame, kind: str, fan: int = FAN) -> DataFrame:
    """(at, entry, exit, last): the states before and after each segment in the best repair of its conversation."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pylist()
        costs, ranks, ways = compose([(r["costs"], r["ranks"]) for r in rows])
        one = {"conv_id": table.column("conv_id")[:1], "at": [rows[0]["at"]], "costs": [costs], "ranks": [ranks], "parts": [[r["at"] for r in rows]], "ways": [ways]}
        return pa.table({k: v if k == "conv_id" else pa.array(v, t) for (k, v), t in zip(one.items(), (None, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))))})

    levels, bits, now = [], fan, nodes
    while now.groupBy("conv_id").count().where(F.col("count") > 1 << fan).limit(1).count():
        now = staged(now.select("conv_id", "at", "costs", "ranks", F.shiftright("at", bits).alias("above")).groupBy("conv_id", "above").applyInArrow(merged, NODE.format(kind=kind)), "levels")
        levels.append(now)
        bits += fan

    def best(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pylist()
        costs, ranks, ways = compose([(r["costs"], r["ranks"]) for r in rows])
        end = min((to for to in STATES if costs[to] < NEVER), key=lambda to: (costs[to] + TAILS[to][0], ranks[to]))
        states = [*ways[end], end]
        return pa.table({"at": pa.array([r["at"] for r in rows], pa.int64()), "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32()), "last": [False] * (len(rows) - 1) + [True]})

    choice = now.select("conv_id", "at", "costs", "ranks").groupBy("conv_id").applyInArrow(best, CHOICE)
    for level in reversed(levels):
        inner = choice.join(level.select("at", "parts", "ways"), "at").select("parts", "exit", "last", F.element_at("ways", F.col("entry") * 4 + F.col("exit") + 1).alias("states"))
        parts = inner.select("last", "exit", "states", F.posexplode("parts").alias("k", "at"), F.size("parts").alias("n"))
        choice = parts.select("at", F.element_at("states", F.col("k") + 1).alias("entry"), F.when(F.col("k") + 1 == F.col("n"), F.col("exit")).otherwise(F.try_element_at("states", F.col("k") + 2)).alias("exit"), (F.col("last") & (F.col("k") + 1 == F.col("n"))).alias("last"))
    return choice


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
REPAIRED = [
    T.StructField("at", T.LongType()),
    T.StructField("whole", T.BooleanType()),
    T.StructField("faults", T.ArrayType(T.StringType())),
    T.StructField("initials", T.StringType()),
    T.StructField("turns", T.ArrayType(T.LongType())),
    T.StructField("cost", T.LongType()),
    T.StructField("audit", T.StringType()),
    T.StructField("repaired", T.ArrayType(TURN)),
]


def repaired_rows(solvable: DataFrame) -> DataFrame:
    """The repair of each segment, from (conv_id, at, whole, rows, before, entry, exit, last)."""
    schema = T.StructType([solvable.schema["conv_id"], *REPAIRED])
    types = (pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, at, whole, rows, before, entry, leave, last in zip(*[c.to_pylist() for c in batch.columns]):
                names, kinds = faults(rows, marks(conv, rows), set(before or ()))
                if whole:
                    entry, (cost, audit) = START, solved(kinds)
                else:
                    cost, audit = transfer(kinds, entry)[leave]
                    if last:
                        cost, audit = cost + TAILS[leave][0], audit + TAILS[leave][1]
                turns = [{"role": r, "text": t} for r, t in applied(audit, rows, entry)]
                out.append((at, whole, names, "".join(initial(r["role"]) for r in rows), [r["turn"] for r in rows], cost, audit, turns))
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return small_batches(solvable).mapInArrow(lambda batches: released(run(batches)), schema)


def repair_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = SEGMENT_ROWS, fan: int = FAN) -> DataFrame:
    """The repaired conversations in segments: conv_id, at (their order), whole, the faults, initials and turns of the
    rows, and the cost, audit and repaired turns (role, text)."""
    space = F.lit(" ")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), F.monotonically_increasing_id().alias("copy"))
    cut = staged(segments(rows, segment_rows), "segments")
    kind = cut.schema["conv_id"].dataType.simpleString()
    pieces = cut.where(~F.col("whole"))
    pieces = staged(pieces.join(repeats(pieces), "at", "left").select("conv_id", "at", "whole", "rows", "before"), "pieces")
    choice = chosen_states(staged(matrices(pieces, kind), "matrices"), kind, fan)
    none = F.lit(None)
    ready = cut.where("whole").select("conv_id", "at", "whole", "rows", none.cast("array<binary>").alias("before"), none.cast("int").alias("entry"), none.cast("int").alias("exit"), none.cast("boolean").alias("last"))
    return repaired_rows(ready.unionByName(pieces.join(choice, "at").select(ready.columns)))


def conversation_report(repaired: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of repaired segments.

    Segments with a whole conversation are summed up where they are; the segments of others meet in order.
    """
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = T.StructType([repaired.schema["conv_id"], *[T.StructField(f, T.StringType() if f in ("audit", "repaired_sha256") else T.LongType()) for f in fields]])
    names = ["conv_id", "whole", "faults", "initials", "turns", "cost", "audit", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        kind, done = None, []

        def flush() -> pa.RecordBatch:
            out = [(s["conv"], s["span"][1] - s["span"][0] + 1 - s["distinct"] if s["span"] else 0, *s["counts"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()) for s in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind if k == 0 else pa.string() if k > 6 else pa.int64()) for k in range(9)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for conv, whole, found, initials, turns, cost, audit, said in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or whole or state["whole"] or state["conv"] != conv:
                    if state is not None:
                        done.append(state)
                    state = {"conv": conv, "whole": whole, "span": None, "distinct": 0, "counts": [0] * 4, "cost": 0, "audit": [], "sha": hashlib.sha256(), "first": True, "last": ""}
                for t in turns:  # in order
                    if t is not None and (state["span"] is None or t != state["span"][1]):
                        state["span"] = (state["span"][0] if state["span"] else t, t)
                        state["distinct"] += 1
                for k, name in enumerate(("blank", "duplicate", "truncated")):
                    state["counts"][k] += found.count(name)
                joined = state["last"] + initials
                state["counts"][3] += sum(joined[i : i + 2] not in ("su", "ua", "au") for i in range(len(joined) - 1))
                state["last"] = initials[-1:]
                state["cost"] += cost
                state["audit"].append(audit)
                for r in said:
                    state["sha"].update(("" if state["first"] else "\n").encode() + f"{r['role']}:{r['text']}".encode())
                    state["first"] = False
            if len(done) >= 1024:
                yield flush()
        if state is not None:
            done.append(state)
            yield flush()

    here = repaired.where("whole").select(names).mapInArrow(run, schema)
    met = repaired.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "at").select(names).mapInArrow(run, schema)
    return here.unionByName(met)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; nulls are one space, turns stay null) with faults that depend on
    crc32 of "conv_id:turn" modulo 20: 0 the row is missing, 1 its text is empty, 2 it lacks its marks of
    sentence ends, 3 it stands twice, 4 its role is user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("times"))
    return rows.drop("times")


def repair_digest(turns: DataFrame) -> DataFrame:
    """The report of the repaired damaged conversations, for every conversation of ``turns``."""
    report = conversation_report(repair_conversations(damaged(turns)))
    all_ids = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    joined = all_ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
