"""Repair of conversations at least cost, by a checkpointed dynamic program.

Wanted is the pattern (s?(ua)+)? of role initials. Edits: keep (K, 0), give another role of user and assistant (R, 2), delete
(D, 3; the only edit of blank and repeated rows), insert an empty user or assistant turn (I, 2); truncated rows that
stay add 1. Four states say where the pattern stands. cost[i][state] is the least cost from row i on; it is kept only at
checkpoints, the ends of blocks of max(64, square root of the conversation's rows) rows, and a block's own vectors are computed
again while the walk goes forward through it and takes, of the edits that lose nothing, the one whose letter comes first.

A conversation of up to 64 distinct rows is one block. A longer one is spread: its rows are sorted by ranges and
cut into blocks; each block is first summed up as a least-cost matrix between states; one small step for each
conversation (a row for each block, so about the square root of its rows) turns matrices into the vectors at checkpoints; each
block then tells for every entering state where its walk leaves; a second small step gives the entering states; and all blocks
are walked side by side. Equal rows (turn, role and text) are counted before anything is shuffled, and texts are represented
by their SHA-256, so only `digests` moves texts, once.

Defined results: rows go by turn (null first), then role, then SHA-256 of the text; role and text that are null are one
space; a null conv_id is a conversation; a row's first fault of blank, repeated, truncated counts; a role counts by its first
character, an empty or other one cannot be kept; repeated rows are repeats; an empty table gives none; other columns are ignored.
A whole conversation has one SHA-256, which is made by streaming it through one task; `edits` has no such step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship

#: White space, ends of a sentence, costs.
SPACE, ENDS = r"\x20\x09-\x0D", ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Rows of the smallest block.
LEAST = 64

_INF = 1 << 60
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where an inserted or new role leads from each state, and its name.
_GO = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
#: Where keeping a role leads, by its class (0 system, 1 user, 2 assistant, 3 other) and state; -1: not allowed.
_KEEP = ((_SYSTEM, -1, -1, -1), (_USER, _USER, -1, _USER), (-1, -1, _ASSISTANT, -1), (-1, -1, -1, -1))
#: Costs after the last row.
_END = [0, 2 * INSERT, INSERT, 0]
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Row = tuple  # (role class, fault: 0 none, 1 truncated, 2 to be deleted, copies)


def _relaxed(f: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    u, a = min(f[2], INSERT + f[3]), min(f[3], INSERT + f[2])
    return [min(f[0], INSERT + u), min(f[1], INSERT + u), u, a]


def _split(row: Row) -> list[Row]:
    """A row and its copies: only the first of a sound row is sound."""
    kind, fault, n = row
    return [row] if fault == 2 or n == 1 else [(kind, fault, 1), (kind, 2, n - 1)]


def _before(row: Row, f: list[int]) -> list[int]:
    """Costs from a row on, given those after it."""
    kind, fault, n = row
    g = [DELETE * n + c for c in f]
    if fault < 2:
        for x in range(4):
            if (y := _KEEP[kind][x]) >= 0:
                g[x] = min(g[x], fault * TRUNCATED + f[y])
            g[x] = min(g[x], fault * TRUNCATED + REROLE + f[_GO[x]])
    return _relaxed(g)


def matrix(rows: list[Row]) -> list[int]:
    """Least costs of a block from each state to each state after its last row, by rows."""
    columns = []
    for b in range(4):
        f = [_INF] * 4
        f[b] = 0
        for row in reversed([s for r in rows for s in _split(r)]):
            f = _before(row, f)
        columns.append(f)
    return [min(columns[b][a], _INF) for a in range(4) for b in range(4)]


def walk(rows: list[Row], start: int, end: list[int], last: bool) -> tuple[list[tuple[str, list[str], str | None]], list[str], int, int]:
    """(letters, inserted roles, "" for the row's own role or a new one, None if deleted) of each row, the roles inserted after
    the last one, the state left in, and the cost. end: costs after the block."""
    parts = [(i, s) for i, r in enumerate(rows) for s in _split(r)]
    costs = [end]
    for _, part in reversed(parts):
        costs.append(_before(part, costs[-1]))
    costs.reverse()
    state, total = start, 0
    out: list[tuple[str, list[str], str | None]] = [("", [], None) for _ in rows]
    for at, (i, (kind, fault, n)) in enumerate(parts):
        letters, inserted, role = out[i]
        while True:
            here, after = costs[at][state], costs[at + 1]
            if DELETE * n + after[state] == here:
                letters, total = letters + "D" * n, total + DELETE * n
                break
            if INSERT + costs[at][_GO[state]] == here:
                letters, total = letters + "I", total + INSERT
                inserted = [*inserted, _ROLE[state]]
                state = _GO[state]
                continue
            y = _KEEP[kind][state]
            if y >= 0 and fault < 2 and fault * TRUNCATED + after[y] == here:
                letters, role, total, state = letters + "K", "", total + fault * TRUNCATED, y
            else:
                letters, role, total, state = letters + "R", _ROLE[state], total + REROLE + fault * TRUNCATED, _GO[state]
            break
        out[i] = (letters, inserted, role)
    tail = []
    while last and _END[state]:
        tail.append(_ROLE[state])
        state, total = _GO[state], total + INSERT
    return out, tail, state, total


def _illegal(rows: list[Row], before: int | None) -> int:
    """Adjacent roles that the pattern does not have; before: class of the row ahead of the block."""
    n = 0
    for kind, _, copies in rows:
        n += copies - 1 + (before is not None and (before, kind) not in _LEGAL)
        before = kind
    return n


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults: by crc32 of conv_id:turn modulo 20, 0 drops a row, 1 empties its text, 2
    removes the ends of its sentences, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), k.alias("k")).filter("k <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("i")).drop("i")


_ORDER = ["turn", "role", "sha"]


def _light(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))


def flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number n, is_blank, and is_first: of a role and text the earliest turn, whose first copy is no repeat;
    is_truncated; kind, the class of the role."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    folded = _light(rows).select("conv_id", *_ORDER, blank.alias("is_blank"), (~blank & ~F.col("text").rlike(rf"[{ENDS}][{SPACE}]*\z")).alias("is_truncated")).groupBy("conv_id", *_ORDER, "is_blank", "is_truncated").agg(F.count(F.lit(1)).alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("t"), "turn")
    firsts = folded.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(turn).alias("first"))
    met = folded.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return met.select("conv_id", *_ORDER, "n", "is_blank", "is_truncated", (~F.col("is_blank") & turn.eqNullSafe(F.col("first"))).alias("is_first"), kind.alias("kind"))


_ROWS = "array<struct<t: boolean, turn: long, role: string, sha: string, kind: int, fault: int, n: long>>"


def _row() -> Column:
    fault = F.when(~F.col("is_first"), 2).otherwise(F.col("is_truncated").cast("int"))
    return F.struct(F.col("turn").isNotNull().alias("t"), *_ORDER, "kind", fault.alias("fault"), "n")


def _each(frame: DataFrame, run: Callable[[dict], Iterator[dict]], out: str) -> DataFrame:
    """run over every row as a dictionary."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for i in range(0, batch.num_rows, 256):
                found = [r for row in batch.slice(i, 256).to_pylist() for r in run(row)]
                yield pa.RecordBatch.from_pylist(found, schema)

    return frame.mapInArrow(batches, out)


def _codes(row: dict) -> list[Row]:
    return [(r["kind"], r["fault"], r["n"]) for r in row["rows"]]


def _matrices(row: dict) -> Iterator[dict]:
    yield {"conv_id": row["conv_id"], "at": row["at"], "m": matrix(_codes(row))}


def _ends(row: dict) -> Iterator[dict]:
    """Vectors at the ends of a conversation's blocks, backward."""
    end = _END
    for block in reversed(row["blocks"]):
        yield {"at": block["at"], "end": end, "last": end is _END}
        m = block["m"]
        end = [min(m[4 * a + b] + end[b] for b in range(4)) for a in range(4)]


def _leaving(row: dict) -> Iterator[dict]:
    rows = _codes(row)
    to = [walk(rows, s, row["end"], False)[2] for s in range(4)]
    yield {"conv_id": row["conv_id"], "at": row["at"], "to": to, "end": row["end"], "last": row["last"], "kind": rows[-1][0]}


def _entering(row: dict) -> Iterator[dict]:
    state, before = _START, None
    for block in row["blocks"]:
        yield {"at": block["at"], "start": state, "end": block["end"], "last": block["last"], "before": before}
        state, before = block["to"][state], block["kind"]


def _walked(row: dict) -> Iterator[dict]:
    rows = _codes(row)
    done, tail, _, cost = walk(rows, row["start"], row["end"], row["last"])
    illegal = _illegal(rows, row["before"])
    for i, (r, (letters, inserted, role)) in enumerate(zip(row["rows"], done)):
        final = i + 1 == len(rows)
        own = None if role is None else role or r["role"]
        yield {"conv_id": row["conv_id"], "turn": r["turn"], "role": r["role"], "sha": r["sha"], "edits": letters + "I" * (len(tail) if final else 0), "inserted": inserted, "new_role": own, "appended": tail if final else [], "cost": 0 if i else cost, "illegal": 0 if i else illegal}


_EDITS = "conv_id long, turn long, role string, sha string, edits string, inserted array<string>, new_role string, appended array<string>, cost long, illegal long"


def edits(rows: DataFrame) -> DataFrame:
    """The edits of `flagged` rows: for each distinct row its letters in order (inserts before it, its own, one for each copy, and
    inserts after a conversation's last row), the roles inserted before it, the role it keeps or gets (null: deleted), the roles
    appended; cost and illegal are a block's, on its first row."""
    ship(rows.sparkSession)
    m = F.col("m")
    large = rows.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("m")).filter(m > LEAST).select("c", F.greatest(F.lit(LEAST), F.ceil(F.sqrt(m))).alias("width"))
    sized = rows.join(large, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    whole = lambda keys: F.sort_array(F.collect_list(_row())).alias("rows")
    small = sized.filter("width IS NULL").groupBy("conv_id").agg(whole(None)).select("conv_id", "rows", F.lit(_START).alias("start"), F.array(*map(F.lit, _END)).cast("array<long>").alias("end"), F.lit(True).alias("last"), F.lit(None).cast("int").alias("before"))
    dealt = sized.filter("width IS NOT NULL").repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    slot = F.struct(F.shiftright("at", 33).alias("part"), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / F.col("width")).alias("slot"))
    blocks = saved(placed.groupBy("conv_id", slot.alias("slot")).agg(F.min("at").alias("at"), whole(None)).drop("slot"))
    matrices = _each(blocks, _matrices, "conv_id long, at long, m array<long>")
    gathered = lambda df, *cols: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", *cols))).alias("blocks"))
    ends = _each(gathered(matrices, "m"), _ends, "at long, end array<long>, last boolean")
    leaving = _each(blocks.join(ends, "at"), _leaving, "conv_id long, at long, to array<int>, end array<long>, last boolean, kind int")
    entering = _each(gathered(leaving, "to", "end", "last", "kind"), _entering, "at long, start int, end array<long>, last boolean, before int")
    spread = blocks.join(entering, "at").select("conv_id", "rows", "start", "end", "last", "before")
    return _each(small.unionByName(spread), _walked, _EDITS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of conversations, whose edits and texts come in order, an edit before its texts."""
    names = ["conv_id", "audit", "repaired_sha256"]
    own, audit, digest, fresh, due, done = None, [], None, True, None, []

    def line(text: str) -> None:
        nonlocal fresh
        digest.update((text if fresh else "\n" + text).encode("utf-8"))
        fresh = False

    def close() -> None:
        nonlocal due
        if due is not None:
            for role in due["appended"] or []:
                line(f"{role}:")
        due = None

    def end() -> None:
        close()
        done.append((own[0], "".join(audit), digest.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())], names)
        done.clear()
        return out

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for row in batch.slice(i, 256).to_pylist():
                if own != (row["conv_id"],):
                    if own is not None:
                        end()
                    own, audit, digest, fresh = (row["conv_id"],), [], hashlib.sha256(), True
                if row["edits"] is not None:
                    close()
                    due = row
                    audit.append(row["edits"])
                    for role in row["inserted"] or []:
                        line(f"{role}:")
                elif due is not None and due["new_role"] is not None:
                    line(f"{due['new_role']}:{row['text']}")
                    due = due | {"new_role": None}  # further copies are deleted
            if done:
                yield batch_of()
    if own is not None:
        end()
        yield batch_of()


def digests(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """conv_id, audit (all letters), repaired_sha256 of each conversation: `role:text` lines of what is left."""
    steps = edited.select("conv_id", *_ORDER, "edits", "inserted", "new_role", "appended", F.lit(None).cast("string").alias("text"))
    both = steps.unionByName(_light(rows), allowMissingColumns=True)
    order = ["conv_id", *_ORDER, F.col("edits").isNull()]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_stream, "conv_id long, audit string, repaired_sha256 string")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id of ids, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows
    (conv_id, turn, role, text)."""
    marks = saved(flagged(rows))
    edited = saved(edits(marks))
    count = lambda c: F.sum(c).alias
    n, first = F.col("n"), F.col("is_first")
    turns = marks.groupBy("conv_id", "turn").agg(count(F.when(F.col("is_blank"), n).otherwise(0))("blank"), count(F.when(F.col("is_blank"), 0).otherwise(n - first.cast("int")))("duplicate"), count((first & F.col("is_truncated")).cast("int"))("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    faults = turns.groupBy("conv_id").agg(gaps, *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = edited.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    parts = [faults, costs, digests(rows, edited)]
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for at, part in enumerate(parts):
        out = out.join(part.withColumnRenamed("conv_id", f"c{at}"), F.col("conv_id").eqNullSafe(F.col(f"c{at}")), "left").drop(f"c{at}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
