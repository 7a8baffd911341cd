"""Repair of conversation structure: cheapest edits by a square-root checkpointed dynamic programme.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Four states say what
stands before a row: nothing, the system turn, a user turn, an assistant turn. The cost
of the best way to the end from each state is a vector, passed from row to row backward.

Rows are sorted over the whole table and cut into blocks of at most ``BLOCK`` rows of one
conversation. A block is known by its codes, one byte a row, and by how it maps the cost
vector behind it to the one before it (a 4 x 4 table of costs). From block to block only
vectors are passed, and kept: these are the checkpoints. Walking forward, the rows' vectors
of one block at a time are computed again from the checkpoint behind it, and the edits that
stay on a cheapest way are emitted, the ASCII-least first. So a task holds one block of a
conversation of any length, and texts are sorted once, by conversation.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkveil.llm.common import saved

BLOCK = 2048
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60

# A row's code: its initial, whether it must go, whether keeping it costs extra.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
MUST_GO, CUT_SHORT, REPEATED = 4, 8, 16
STEP = {  # state -> {initial: next state}
    0: {SYSTEM: 1, USER: 2},
    1: {USER: 2},
    2: {ASSISTANT: 3},
    3: {USER: 2},
}
ENDS = (0, FAR, FAR, 0)
NEXT_ROLE = (USER, USER, ASSISTANT, USER)  # what an inserted or renamed turn is in each state
NEXT_STATE = (2, 2, 3, 2)
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}


def before_inserts(v: tuple) -> tuple:
    """The vector before any inserted turns, from the one behind them. Two turns are the most that pays."""
    for _ in range(2):
        v = tuple(min(v[s], INSERT + v[NEXT_STATE[s]]) for s in range(4))
    return v


@functools.lru_cache(maxsize=65_536)
def _before_row(code: int, v: tuple) -> tuple:
    out = []
    extra = TRUNCATED if code & CUT_SHORT else 0
    for s in range(4):
        best = DELETE + v[s]
        if not code & MUST_GO:
            best = min(best, REROLE + extra + v[NEXT_STATE[s]])
            kept = STEP[s].get(code & 3)
            if kept is not None:
                best = min(best, KEEP + extra + v[kept])
        out.append(best)
    return before_inserts(tuple(out))


def before_row(code: int, v: tuple) -> tuple:
    """The vector before a row and what is inserted in front of it, from the one behind the row.

    Vectors that differ by a constant go the same way, so few of them are worked out.
    """
    low = min(v)
    made = _before_row(code, tuple(FAR if x >= FAR else x - low for x in v))
    return tuple(min(FAR, low + x) for x in made)


def vectors(codes: bytes, behind: tuple) -> list[tuple]:
    """Vectors before each row of a block, and ``behind`` at the end."""
    out = [behind]
    for code in reversed(codes):
        out.append(before_row(code, out[-1]))
    out.reverse()
    return out


def block_table(codes: bytes) -> list[int]:
    """``t[4 * s + e]``: the least cost from state ``s`` before the block to ``e`` behind it."""
    units = [tuple(0 if s == e else FAR for s in range(4)) for e in range(4)]
    ways = [functools.reduce(lambda v, code: before_row(code, v), reversed(codes), unit) for unit in units]
    return [ways[e][s] for s in range(4) for e in range(4)]


def through(table: list[int], behind: tuple) -> tuple:
    """The vector before a block, given the one behind it."""
    return tuple(min(FAR, *(table[4 * s + e] + behind[e] for e in range(4))) for s in range(4))


def edits(codes: bytes, behind: tuple, state: int) -> Iterator[tuple[str, int, int]]:
    """``(edit, row, role)`` along the ASCII-least cheapest way from ``state`` through a block.

    The edits are D, I, K and R, tried in this order; each leads to one state only. ``role`` is
    that of an inserted or renamed turn. The last item is ``("", number of rows, state behind)``.
    """
    cost = vectors(codes, behind)
    row = 0
    while row < len(codes):
        code, now, nxt = codes[row], cost[row][state], cost[row + 1]
        extra = TRUNCATED if code & CUT_SHORT else 0
        kept = None if code & MUST_GO else STEP[state].get(code & 3)
        if now == DELETE + nxt[state]:
            yield "D", row, OTHER
            row += 1
        elif now == INSERT + cost[row][NEXT_STATE[state]]:
            yield "I", row, NEXT_ROLE[state]
            state = NEXT_STATE[state]
        elif kept is not None and now == KEEP + extra + nxt[kept]:
            yield "K", row, OTHER
            state = kept
            row += 1
        else:
            yield "R", row, NEXT_ROLE[state]
            state = NEXT_STATE[state]
            row += 1
    yield "", row, state


def closing(state: int) -> Iterator[tuple[str, int, int]]:
    """Turns that are inserted behind the last row."""
    while ENDS[state]:
        yield "I", 0, NEXT_ROLE[state]
        state = NEXT_STATE[state]


def _codes(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """A row's initial as a code, and whether its text is blank or ends without ``.``, ``!`` or ``?``."""
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    shown = F.rtrim(text, F.lit(SPACES))
    return code, shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: rows dropped, emptied, robbed of their sentence ends, repeated or renamed.

    What happens to a row is ``crc32(conv_id:turn) % 20``: 0 drops it, 1 empties the text, 2 removes
    ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes its role ``user``. Null ids, turns,
    roles and texts count as one space (ids and turns stay null in their columns).
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn")).cast("binary")) % 20
    text = cell("text")
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(cell("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
END = before_inserts(ENDS)
ORDER = ["conv_id", "turn", "message", "row"]
PLACE = "turn long, message string, row long"
BLOCK_COLUMNS = f"{PLACE}, codes binary, table array<long>, last_turn long, low_turn long, turns long, illegal long"
TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
AUDIT = ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string"


def _schema(ids: DataFrame, rest: str) -> StructType:
    """``conv_id`` as it is in ``ids``, then the columns of ``rest``."""
    return StructType([ids.schema["conv_id"], *StructType.fromDDL(rest).fields])


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(records: Iterable[tuple], fields: list[str], types: list, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Records in batches of up to 4,096 rows or about ``most`` characters."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=fields
        )

    for r in records:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) == 4096 or size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _kinds(rest: str, conv: pa.DataType) -> list:
    of = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [conv, *(of[c.split()[1]] for c in rest.split(", "))]


def _mapped(df: DataFrame, fn, rest: str) -> DataFrame:
    """``fn`` from records to records over sorted partitions; ``conv_id`` stays first, of any type."""
    fields = ["conv_id", *(c.split()[0] for c in rest.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = _kinds(rest, first.schema.field(0).type)
        rows = (r for some in ([first], batches) for r in _records(some))
        yield from _batches(fn(rows), fields, kinds)

    return df.mapInArrow(run, _schema(df, rest))


def _cut_blocks(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Blocks of at most ``most`` of the sorted ``(conv_id, turn, message, row, code)``."""
    held: list[tuple] = []

    def block() -> tuple:
        codes = bytes(r[4] for r in held)
        turns = {r[1] for r in held if r[1] is not None}
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
        return (*held[0][:4], codes, block_table(codes), held[-1][1], min(turns, default=None), len(turns), illegal)

    for r in rows:
        if held and (r[0] != held[0][0] or len(held) == most):
            yield block()
            held = []
        held.append(r)
    if held:
        yield block()


def _checkpoints(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks from the last to the first: each with the vector behind it, and the totals from it to the end."""
    now, started = None, False
    for conv, turn, message, row, codes, table, last_turn, low, turns, illegal in blocks:
        if not started or conv != now:
            now, started, behind, total, follows = conv, True, END, [0] * 4, None
            high, lowest, n_turns = last_turn, None, 0
        for code in codes:
            total[0] += code & (MUST_GO | REPEATED) == MUST_GO
            total[1] += code & REPEATED != 0
            total[2] += code & CUT_SHORT != 0
        total[3] += illegal
        n_turns += turns
        if follows is not None:
            total[3] += (codes[-1] & 3, follows[1] & 3) not in LEGAL
            n_turns -= last_turn is not None and last_turn == follows[0]
        lowest = low if low is not None else lowest
        gaps = 0 if lowest is None else high - lowest + 1 - n_turns
        before = through(table, behind)
        yield conv, turn, message, row, codes, list(behind), [gaps, *total, before[0]]
        behind, follows = before, (turn, codes[0])


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From blocks, each before its rows, ``(conv_id, totals, edit, role, text)`` in order.

    A conversation's first item has the edit ``""`` and alone holds its totals (null if it has no rows).
    """
    now, begun, told, way = None, False, False, None

    def ended() -> Iterator[tuple]:
        if not told:
            yield now, None, "", None, None
        for _, _, role in closing(next(way)[2] if way else 0):
            yield now, None, "I", ROLE_NAMES[role], ""

    for conv, _, _, _, kind, codes, behind, totals, role, text in rows:
        if not begun or conv != now:
            if begun:
                yield from ended()
            now, begun, told, way = conv, True, False, None
        if kind == 0:
            if not told:
                yield conv, totals, "", None, None
                told = True
            # A walk that has passed its last row gives the state behind it.
            way = edits(codes, tuple(behind), next(way)[2] if way else 0)
        elif kind == 1:
            for edit, _, new in way:
                if edit != "I":
                    yield conv, None, edit, ROLE_NAMES[new] if edit == "R" else role, text
                    break
                yield conv, None, "I", ROLE_NAMES[new], ""
    if begun:
        yield from ended()


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    place = 0
    for conv, _, edit, role, text in _walk(rows):
        if edit:
            yield conv, place, edit, role, text
            place += 1
        else:
            place = 0


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, totals, audit, digest, between = None, None, [], None, b""
    for now, told, edit, role, text in _walk(rows):
        if not edit:
            if digest:
                yield conv, *totals, "".join(audit), digest.hexdigest()
            conv, totals, audit, digest, between = now, told or [0] * len(TOTALS), [], hashlib.sha256(), b""
            continue
        audit.append(edit)
        if edit != "D":
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
    if digest:
        yield conv, *totals, "".join(audit), digest.hexdigest()


def _arranged(conversations: DataFrame, ids: DataFrame | None, block: int) -> DataFrame:
    """Rows behind the block they are in, blocks with their checkpoints, sorted by conversation."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), cell("role").alias("role"), cell("text").alias("text"))
    message = F.md5(F.concat(F.md5("role"), F.md5("text")))
    rows = saved(rows.withColumn("message", message).withColumn("row", F.monotonically_increasing_id()), "turns")
    initial, blank, cut_short = _codes(F.col("role"), F.col("text"))
    narrow = rows.select("conv_id", "turn", "message", "row", initial.alias("initial"), blank.alias("blank"), cut_short.alias("cut_short"))
    # The first row of each message; turns without a number come first of all.
    first = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"), F.col("row"))
    firsts = narrow.where(~F.col("blank")).groupBy("conv_id", "message").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    firsts = firsts.where("n > 1").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "first")
    later = (first != F.col("first")) & F.col("first").isNotNull()
    fault = (
        F.when(F.col("blank"), MUST_GO)
        .when(F.coalesce(later, F.lit(False)), MUST_GO | REPEATED)
        .when(F.col("cut_short"), CUT_SHORT)
        .otherwise(0)
    )
    coded = narrow.join(firsts, narrow["conv_id"].eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left")
    coded = coded.select(*ORDER, F.col("initial").bitwiseOR(fault).alias("code"))
    blocks = _mapped(
        coded.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER),
        functools.partial(_cut_blocks, most=block),
        BLOCK_COLUMNS,
    )
    backward = blocks.repartition("conv_id").sortWithinPartitions(*[F.desc(c) for c in ORDER])
    points = _mapped(backward, _checkpoints, f"{PLACE}, codes binary, behind array<long>, totals array<long>")
    both = (
        points.withColumn("kind", F.lit(0))
        .unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    )
    if ids is not None:
        both = both.unionByName(ids.select("conv_id").distinct().withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    both = both.select(*ORDER, "kind", "codes", "behind", "totals", "role", "text")
    return both.repartition("conv_id").sortWithinPartitions(*ORDER, "kind")


def repaired_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: each conversation's edits in order.

    ``edit`` is K (kept), R (role changed, ``role`` is the new one), D (deleted, as it was) or I
    (inserted, with an empty text); without the rows of D what is left is the repaired conversation.
    Rows go by ``turn`` (nulls first), those of one turn by the MD5 of role and text. Null roles
    and texts count as one space; a null ``conv_id`` is a conversation of its own; repeated rows
    are rows of their own. Other columns are ignored.
    """
    return _mapped(_arranged(conversations, None, block), _turns, "place long, edit string, role string, text string")


def conversation_audit(conversations: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation.

    Rows and their order as in :func:`repaired_turns`. ``audit`` joins the edits, ``repaired_sha256``
    hashes ``role:text`` of what is left, joined by line ends. A ``conv_id`` of ``ids`` without rows
    has zeros, no edits and the hash of the empty string. An empty table gives no rows.
    """
    return _mapped(_arranged(conversations, ids, block), _digests, AUDIT)
