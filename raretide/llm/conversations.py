"""Conversation structure repair: a cost-to-go table backward over turns and grammar states, a greedy walk forward.

Turns are sorted by conversation, so that every task holds whole conversations between the two that its range cuts.
Those in between are repaired in that one pass. The cut ones, and so a conversation of any length, go by blocks of turns:
a block's costs are a (min, +) matrix over the four states; matrices give the costs at the ends of blocks, the walk of
a block is taken for each state that it may begin in, and the states that the walks join pick one of them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from raretide.llm.workspace import Workspace

SPACE = " \t\n\x0b\x0c\r"
#: Prices of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. For each: where a turn of an initial leads, and
#: where the one role leads that may be inserted or put in place.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STEP = (2, 2, 3, 2)
ROLE = ("", "", "user", "assistant")
FAR = 1 << 60
#: Turns of a block: 2 ** BLOCK.
BLOCK = 17
#: A turn's sign: its initial (s, u, a, o for others), in capitals if truncated; one of DOOMED if it must go.
DOOMED = dict(zip("suao", "wxyz", strict=True))
INITIAL = {sign: i for i in "suao" for sign in (i, i.upper(), DOOMED[i])}
FINE = {"su", "ua", "au"}

Costs = tuple[int, int, int, int]


def _inserts(v: Costs) -> Costs:
    """Costs when turns may be inserted first."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


#: Costs at the end of a conversation.
END = _inserts((0, FAR, FAR, 0))


@functools.lru_cache(1 << 16)
def _step(sign: str, after: Costs) -> Costs:
    least = [DELETE + x for x in after]
    if sign not in "wxyz":
        extra = TRUNCATED * sign.isupper()
        for q in range(4):
            to = KEEP[q].get(sign.lower())
            least[q] = min(least[q], REROLE + extra + after[STEP[q]], FAR if to is None else extra + after[to])
    return _inserts(tuple(least))


def _before(sign: str, after: Costs) -> Costs:
    """Costs before a turn, from those after it. Few differences occur, so that most are looked up."""
    base = min(after)
    return tuple(min(FAR, base + x) for x in _step(sign, tuple(min(FAR, x - base) for x in after)))


def _walk(signs: str, after: Costs, state: int, last: bool) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits of a block from a state, the state they lead to, and the cost to the end."""
    table = [after]
    for sign in reversed(signs):
        table.append(_before(sign, table[-1]))
    table.reverse()
    out, i, cost = [], 0, table[0][state]
    while i < len(signs) or last and table[i][state]:
        now, sign = table[i][state], signs[i] if i < len(signs) else ""
        if sign and now == DELETE + table[i + 1][state]:
            out.append("D")
            i += 1
        elif now == INSERT + table[i][STEP[state]]:
            out.append("I")
            state = STEP[state]
        else:
            to = KEEP[state].get(sign.lower()) if sign not in DOOMED.values() else None
            kept = to is not None and now == TRUNCATED * sign.isupper() + table[i + 1][to]
            out.append("K" if kept else "R")
            state = to if kept else STEP[state]
            i += 1
    return "".join(out), state, cost


@functools.lru_cache(1 << 14)
def _known_walk(signs: str) -> tuple[str, int, int]:
    """That of a whole conversation."""
    return _walk(signs, END, 0, True)


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in FINE for i in range(len(initials) - 1))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after the damage that a turn's crc32(conv_id:turn) modulo 20 stands for.

    0 drops the row, 1 empties the text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes the role
    user. A null role or text is one space, and so is a null identifier or turn within the hashed string.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name(conv_col), name(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _signed(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows with sign (as if no duplicate) and again: the role and text stand at an earlier turn of the conversation."""
    identity = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    missing = F.col("conv_id").isNull()
    rows = rows.withColumn("identity", F.concat(identity, F.when(missing, "-").otherwise("")))
    # a null turn comes first
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = rows.groupBy("identity").agg(F.min(order).alias("earliest"), F.max(order).alias("latest")).filter("earliest < latest").select("identity", "earliest")
    # written first: of a known size, so that Spark broadcasts it only if it is small
    rows = rows.join(work.table(earliest, "repeated"), "identity", "left")
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(end == "", F.translate(initial, "suao", "wxyz")).when(end.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    return rows.select("conv_id", "turn", "role", "text", sign.alias("sign"), F.coalesce(F.col("earliest") < order, F.lit(False)).alias("again"))


RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, low long, high long, turns long, audit string, repaired_sha256 string"
PASS = f"conv_id {{conv}}, at long, turn long, role string, text string, sign string, fault string, edit string, place long, {RESULT}"


def _rebuilt(turns: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each repaired turn, from (edits, role, text) of each turn as it stands."""
    state = 0
    for edits, role, text in turns:
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                state = KEEP[state][role[:1]]
                yield role, text, e
            else:
                state = STEP[state]
                yield ROLE[state], text if e == "R" else "", e


class _Hash:
    """SHA-256 of turns as ``role:text``, joined by line feeds."""

    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sum.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True


class _Out:
    """Rows gathered into record batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.size += len(row.get("text") or "") + len(row.get("audit") or "") + 100

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > 1 << 20:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0


def _per_edits(audit: str) -> list[str]:
    """The audit cut after each turn; what is inserted at the end belongs to the last."""
    out, start = [], 0
    for i, e in enumerate(audit, 1):
        if e != "I":
            out.append(audit[start:i])
            start = i
    if out:
        out[-1] += audit[start:]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _first_pass(schema: pa.Schema, texts: bool):
    """Over sorted turns: results (or repaired turns) of conversations that lie inside the task, turns of the two others."""

    def finish(out: _Out, conv, turns: list[tuple]) -> None:
        signs = "".join(t[3] for t in turns)
        audit, _, cost = _known_walk(signs)
        repaired = _rebuilt((e, t[1], t[2]) for e, t in zip(_per_edits(audit), turns, strict=True))
        if texts:
            for i, (role, text, edit) in enumerate(repaired):
                out.add(conv_id=conv, role=role, text=text, edit=edit, place=i)
            return
        whole, faults, known = _Hash(), [t[4] for t in turns], [t[0] for t in turns if t[0] is not None]
        for role, text, _ in repaired:
            whole.add(role, text)
        count = {k: faults.count(k[0]) for k in ("blank", "duplicate", "truncated")}
        out.add(conv_id=conv, **count, illegal=_illegal("".join(INITIAL[s] for s in signs)), cost=cost, low=min(known, default=None), high=max(known, default=None), turns=len(set(known)), audit=audit, repaired_sha256=whole.sum.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = _Out(schema), TaskContext.get().partitionId() << 33
        before, held, first = None, [], True
        for at, (conv, turn, role, text, sign, again) in enumerate(_rows(batches)):
            if before is not None and before[0] != conv:
                if not first:
                    finish(out, before[0], held)
                held, first = [], False
            fault = "b" if sign in "wxyz" else "d" if again or before == (conv, turn, role, text) else "t" if sign.isupper() else ""
            before = (conv, turn, role, text)
            sign = DOOMED[sign.lower()] if fault == "d" else sign
            if first:  # began before this task, as far as it can tell
                out.add(conv_id=conv, at=part | at, turn=turn, role=role, text=text, sign=sign, fault=fault)
            else:
                held.append((turn, role, text, sign, fault, at))
            yield from out.full()
        for turn, role, text, sign, fault, at in held:  # may go on in the next task
            out.add(conv_id=before[0], at=part | at, turn=turn, role=role, text=text, sign=sign, fault=fault)
            yield from out.full()
        yield from out.rest()

    return run


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: least costs from each state before it to each state after it, its pairs of initials."""
    for b in batches:
        rows = []
        for signs in b.column("signs").to_pylist():
            columns = []
            for to in range(4):
                costs = tuple(0 if q == to else FAR for q in range(4))
                for sign in reversed(signs):
                    costs = _before(sign, costs)
                columns.append(costs)
            initials = "".join(INITIAL[s] for s in signs)
            rows.append(([columns[to][q] for q in range(4) for to in range(4)], _illegal(initials), initials[0] + initials[-1]))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("first"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.int64(), pa.string())))], ["conv_id", "first", "costs", "illegal", "ends"])


def _ends(schema: pa.Schema):
    """Costs after each block of a conversation, backward; on its first block the cost and illegal pairs of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, blocks in zip(b.column("conv_id").to_pylist(), b.column("blocks").to_pylist(), strict=True):
                after, mine = END, []
                for k in reversed(range(len(blocks))):
                    mine.append({"conv_id": conv, "first": blocks[k]["first"], "after": list(after), "begins": k == 0, "closes": k == len(blocks) - 1})
                    m = blocks[k]["costs"]
                    after = tuple(min(FAR, *(m[4 * q + to] + after[to] for to in range(4))) for q in range(4))
                seams = sum(x["ends"][1] + y["ends"][0] not in FINE for x, y in zip(blocks, blocks[1:], strict=False))
                mine[-1] |= {"cost": after[0], "illegal": seams + sum(x["illegal"] for x in blocks)}
                rows += mine
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block for every state that it may begin in, and the states they lead to."""
    for b in batches:
        edits, to = [], []
        for signs, after, begins, closes in zip(*(b.column(c).to_pylist() for c in ("signs", "after", "begins", "closes")), strict=True):
            walks = [_walk(signs, tuple(after), q, closes) for q in range(1 if begins else 4)]
            edits.append([w[0] for w in walks])
            to.append([w[1] for w in walks])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("first"), pa.array(edits, pa.list_(pa.string())), pa.array(to, pa.list_(pa.int64()))], ["conv_id", "first", "edits", "leads"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each block of a conversation begins in."""
    for b in batches:
        first, states = [], []
        for blocks in b.column("blocks").to_pylist():
            state = 0
            for x in blocks:
                first.append(x["first"])
                states.append(state)
                state = x["leads"][state]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(states, pa.int64())], ["first", "state"])


def _rebuild(schema: pa.Schema, texts: bool):
    """Over turns with their edits, in order: repaired turns, or the hash of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, whole, before, place = _Out(schema), None, None, 0
        source = _rows(batches)
        ahead = next(source, None)
        while ahead:
            before = ahead[0]

            def turns() -> Iterator[tuple[str, str, str]]:
                nonlocal ahead
                while ahead and ahead[0] == before:
                    yield ahead[2], ahead[3], ahead[4]
                    ahead = next(source, None)

            whole, place = _Hash(), 0
            for role, text, edit in _rebuilt(turns()):
                if texts:
                    out.add(conv_id=before, role=role, text=text, edit=edit, place=place)
                    place += 1
                    yield from out.full()
                else:
                    whole.add(role, text)
            if not texts:
                out.add(conv_id=before, repaired_sha256=whole.sum.hexdigest())
            yield from out.full()
        yield from out.rest()

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _repair(turns: DataFrame, work: Workspace, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Parts of the results (or repaired turns) of whole conversations, and of those that are cut by ranges."""
    spark = turns.sparkSession
    conv = turns.schema["conv_id"].dataType.simpleString()
    ddl = PASS.format(conv=conv)
    turns = turns.withColumn("turn", F.col("turn").cast("long"))
    key = ["conv_id", "turn", "role"]
    # ranges by the beginning of a text agree with the order by all of it, and spare the driver's sample long texts
    ordered = _signed(turns, work).repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    done = work.table(ordered.mapInArrow(_first_pass(_arrow(spark, ddl), texts), ddl), "passed")
    whole, cut = done.filter("at IS NULL"), done.filter("at IS NOT NULL")

    block = F.shiftright("at", BLOCK)
    coded = F.shiftleft("at", 4).bitwiseOR(F.instr(F.lit("suaoSUAOwxyz"), F.col("sign")).cast("long"))
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(coded)), lambda x: F.substring(F.lit("suaoSUAOwxyz"), x.bitwiseAND(15).cast("int"), F.lit(1))), "")
    blocks = work.table(cut.groupBy("conv_id", block).agg(F.min("at").alias("first"), signs.alias("signs")).select("conv_id", "first", "signs"), "blocks")
    in_order = lambda df, *c: df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", *c))).alias("blocks"))
    matrices = blocks.mapInArrow(_matrices, f"conv_id {conv}, first long, costs array<long>, illegal long, ends string")
    kind = f"conv_id {conv}, first long, after array<long>, begins boolean, closes boolean, cost long, illegal long"
    ends = work.table(in_order(matrices, "costs", "illegal", "ends").mapInArrow(_ends(_arrow(spark, kind)), kind), "ends")
    walks = work.table(blocks.join(ends.drop("conv_id"), "first").mapInArrow(_walks, f"conv_id {conv}, first long, edits array<string>, leads array<long>"), "walks")
    states = in_order(walks, "leads").mapInArrow(_states, "first long, state long")
    pieces = work.table(walks.join(states, "first").select("conv_id", "first", F.element_at("edits", F.col("state").cast("int") + 1).alias("piece")), "pieces")
    edits = pieces.select("first", F.posexplode(F.regexp_extract_all("piece", F.lit("(I*[DKR](?:I+$)?)"), F.lit(1))).alias("i", "edits")).select((F.col("first") + F.col("i")).alias("at"), "edits")
    rebuilt = cut.join(edits, "at").select("conv_id", "at", "edits", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = f"conv_id {conv}, role string, text string, edit string, place long" if texts else f"conv_id {conv}, repaired_sha256 string"
    rebuilt = rebuilt.mapInArrow(_rebuild(_arrow(spark, kind), texts), kind)
    if texts:
        return whole, rebuilt
    stats = cut.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f[0]).alias(f) for f in ("blank", "duplicate", "truncated")), F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
    audits = in_order(pieces, "piece").select("conv_id", F.array_join("blocks.piece", "").alias("audit"))
    parts = stats
    for more in (ends.filter("begins").select("conv_id", "cost", "illegal"), audits, rebuilt):
        parts = parts.unionByName(more, allowMissingColumns=True)
    return whole, parts


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): its faults and the cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256. Turns stand by
    turn (nulls first), those of one turn by role and text. A turn's first fault counts: blank (white space only),
    duplicate (role and text seen earlier), truncated (its last visible character is none of ``.!?``). The repair keeps a
    turn (0), puts user or assistant in the place of its role (2), deletes it (3; blank and duplicate turns must go) or
    inserts an empty turn (2), a truncated turn that stays adds 1, until the initials of roles read ``(s?(ua)+)?``; audit
    is the edits' initials, the ASCII-least of equal cost. ``gaps`` counts turn numbers missing between the least and the
    greatest. ``ids``: a table of conv_id; those without turns get zeros, an empty audit and the hash of an empty text.
    A null conv_id is a conversation as any other. A null role or text is one space. No row gives no row. Other columns
    are not read. One value holds a conversation's whole audit, one byte a turn, so that is limited to 2 GB.
    """
    turns = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    with Workspace(turns.sparkSession, "conversations") as work:
        whole, parts = _repair(turns, work, False)
        columns = [c.split()[0] for c in RESULT.split(", ")]
        both = whole.select("conv_id", *columns).unionByName(parts, allowMissingColumns=True)
        if ids is not None:
            both = both.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
        out = work.keep(both.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in columns)))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        count(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *(count(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns after the repair of repair_conversations: conv_id, place (from 0), role, text, edit (I, K or R)."""
    turns = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    with Workspace(turns.sparkSession, "conversations") as work:
        whole, cut = _repair(turns, work, True)
        columns = ["conv_id", "place", "role", "text", "edit"]
        return work.keep(whole.select(columns).unionByName(cut.select(columns)))




def oracle_sql() -> str:
    """repair_conversations of the damaged table as DuckDB SQL: the same edits by costs and audits carried forward."""
    edit = lambda letter, price, role, text, x: f"{{'cost': {x}.cost + {price}, 'audit': {x}.audit || '{letter}', 'out': list_append({x}.out, {role} || ':' || {text})}}"
    gone = lambda x: f"{{'cost': {x}.cost + 3, 'audit': {x}.audit || 'D', 'out': {x}.out}}"
    best = lambda *c: "list_min(list_filter([" + ", ".join(c) + "], lambda z: z.cost IS NOT NULL))"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    insert = lambda role, x: edit("I", 2, f"'{role}'", "''", x)
    relaxed_u = best("v2", *(insert("user", x) for x in ("v0", "v1", "v3")))
    stays = "r.fault IN ('', 't')"
    take = lambda letter, x: edit(letter, "r.extra", "r.role", "r.text", x)
    put = lambda role, x: edit("R", "2 + r.extra", f"'{role}'", "r.text", x)
    states = {
        "v0": best(gone("w0")),
        "v1": best(gone("w1"), when(f"{stays} AND r.initial = 's'", take("K", "w0"))),
        "v2": best(gone("w2"), *(when(f"{stays} AND r.initial = 'u'", take("K", x)) for x in ("w0", "w1", "w3")), *(when(stays, put("user", x)) for x in ("w0", "w1", "w3"))),
        "v3": best(gone("w3"), when(f"{stays} AND r.initial = 'a'", take("K", "w2")), when(stays, put("assistant", "w2"))),
    }
    none = "{'cost': CAST(NULL AS BIGINT), 'audit': CAST(NULL AS VARCHAR), 'out': CAST([] AS VARCHAR[])}"
    return f"""
        WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        crc(k, i, c) AS (
            SELECT DISTINCT k, 0, CAST(4294967295 AS BIGINT) FROM named
            UNION ALL SELECT k, i + 1, list_reduce(list_concat([xor(c, CAST(ascii(k[i + 1]) AS BIGINT))], [CAST(0 AS BIGINT) FOR b IN range(8)]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)
            FROM crc WHERE i < length(k)),
        kinds AS (SELECT k, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM crc WHERE i = length(k)),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                           unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM named JOIN kinds USING (k) WHERE kind <> 0),
        placed AS (SELECT conv_id, turn, role, text, row_number() OVER o AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
                          role[1] AS initial, lag(role[1]) OVER o AS before
                   FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        rows AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last IN ('.', '!', '?') THEN '' ELSE 't' END AS fault, CASE WHEN nth = 1 AND last NOT IN ('', '.', '!', '?') THEN 1 ELSE 0 END AS extra FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed)),
        stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
        walk(conv_id, i, v0, v1, v2, v3) AS (
            SELECT conv_id, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': CAST([] AS VARCHAR[])}}, {none}, {none}, {none} FROM stats
            UNION ALL
            SELECT conv_id, i + 1, {states["v0"]}, {states["v1"]}, {states["v2"]}, {states["v3"]}
            FROM (SELECT p.conv_id, p.i, w0, w1, w2, {best("v3", insert("assistant", "w2"))} AS w3, r
                  FROM (SELECT conv_id, i, v0 AS w0, v1 AS w1, {relaxed_u} AS w2, v3 FROM walk) p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
        ended AS (SELECT w.conv_id, {best("v0", "v3", insert("assistant", "u"))} AS z
                  FROM (SELECT *, {relaxed_u} AS u FROM walk) w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i)
        SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
               CAST(coalesce(e.z.cost, 0) AS BIGINT) AS cost, coalesce(e.z.audit, '') AS audit, sha256(coalesce(array_to_string(e.z.out, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """
