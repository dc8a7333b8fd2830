"""Repair of the turn structure of conversations by cheapest edits.

Roles, by their initials, must read ``(s?(ua)+)?``.  Backward costs of all states (the last initial put out) are computed from
the end; then a walk from the start takes at each place the ASCII-least edit that lies on a cheapest way.  Only
every square root of the rows is a cost vector kept; the walk computes the vectors of one such stretch again at a time.

Rows are dealt by ranges of (conversation, turn), so a hot conversation spans many tasks.  Its pieces are joined by their 4 x 4
matrices of costs from state to state: a stream of pieces from the last to the first gives each piece the cost vector at its
end, one from the first to the last the state at its start.  Pieces are then walked independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .storage import small, written

#: Costs of edits, and of keeping or renaming the role of a truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, or the last initial put out; the state that an inserted or renamed row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
#: State after a row of that state's initial, by the state before it.
KEPT = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}
#: Cost vector after the last row.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 30
#: A row's code: the state of its initial (0: another one), and flags.
GONE, CUT = 4, 8
#: Rows and bytes of text of a piece; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


class Repair:
    """Cost vectors, remembered by their differences: few ever occur."""

    def __init__(self):
        self.steps: dict[tuple[Vector, int], tuple[int, Vector]] = {}
        self.chosen: dict[tuple[Vector, int, int], tuple[str, int]] = {}

    @staticmethod
    def level(vector) -> tuple[int, Vector]:
        """The least cost, and the costs above it."""
        low = min(vector)
        return low, tuple([min(v - low, FAR) for v in vector])

    @staticmethod
    def _before(after: Vector, code: int) -> Vector:
        cost = []
        for state in range(4):
            ways = [DELETE + after[state]]
            if not code & GONE:
                extra = TRUNCATED if code & CUT else 0
                ways.append(extra + REROLE + after[NEXT[state]])
                if (state, code & 3) in KEPT:
                    ways.append(extra + after[code & 3])
            cost.append(min(ways))
        user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
        return min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant

    def before(self, after: Vector, code: int) -> tuple[int, Vector]:
        """Costs before a row from the costs after it."""
        key = (after, code)
        if key not in self.steps:
            self.steps[key] = self.level(self._before(after, code))
        return self.steps[key]

    def choice(self, after: Vector, code: int, state: int) -> tuple[str, int]:
        """The ASCII-least edits on a cheapest way up to and including a row, and the state after it."""
        key = (after, code, state)
        if key in self.chosen:
            return self.chosen[key]
        now, edits, extra = self._before(after, code), "", TRUNCATED if code & CUT else 0
        while now[state] != DELETE + after[state] and now[state] == INSERT + now[NEXT[state]]:
            edits, state = edits + "I", NEXT[state]
        if now[state] == DELETE + after[state]:
            found = edits + "D", state
        elif (state, code & 3) in KEPT and now[state] == extra + after[code & 3]:
            found = edits + "K", code & 3
        else:
            found = edits + "R", NEXT[state]
        self.chosen[key] = found
        return found

    def backward(self, codes: bytes, end) -> Vector:
        """Costs before the first row."""
        cost, vector = self.level(end)
        for code in reversed(codes):
            low, vector = self.before(vector, code)
            cost += low
        return tuple([min(cost + v, FAR) for v in vector])

    def matrix(self, codes: bytes) -> list[Vector]:
        """Costs before the first row for each state that the rows may have to end in."""
        return [self.backward(codes, [0 if s == t else FAR for s in range(4)]) for t in range(4)]

    def walk(self, codes: bytes, state: int, end, last: bool) -> tuple[list[str], int, int]:
        """Edits for each row (and, of the ``last`` piece, at the end), the state reached and their cost."""
        size = isqrt(len(codes)) + 1
        stretches = [codes[k : k + size] for k in range(0, len(codes), size)]
        kept: list[Vector] = []  # the vector after each stretch, from the last
        cost, vector = self.level(end)
        for stretch in reversed(stretches):
            kept.append(vector)
            for code in reversed(stretch):
                low, vector = self.before(vector, code)
                cost += low
        cost += vector[state]
        edits = []
        for stretch in stretches:
            vectors = [kept.pop()]
            for code in reversed(stretch[1:]):
                vectors.append(self.before(vectors[-1], code)[1])
            for code in stretch:
                found, state = self.choice(vectors.pop(), code, state)
                edits.append(found)
        if not last:
            return edits, state, cost - end[state]
        closing = ""
        while END[state]:
            closing, state = closing + "I", NEXT[state]
        return [*edits, closing], state, cost


def repaired(edits: list[str], state: int, roles: list[str], texts: list[str], codes: bytes) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of every row that the edits leave or insert."""
    for k, ways in enumerate(edits):
        for edit in ways:
            if edit == "D":
                continue
            if edit == "K":
                state = codes[k] & 3
                yield edit, roles[k], texts[k]
                continue
            state = NEXT[state]
            yield edit, ROLES[state], "" if edit == "I" else texts[k]


# ------------------------------------------------------------------ pieces of conversations

_STATS = ["blank", "duplicate", "truncated", "illegal", "n_turns"]


def _columns(rows: DataFrame, conv: str, turn: str, role: str, text: str, live: Column | None) -> DataFrame:
    """Rows with their code; ``live`` tells rows from mere marks of a conversation."""
    live = F.lit(True) if live is None else live
    rows = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), live.alias("live"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    return rows.withColumns({
        "digest": F.unhex(F.sha2(F.col("text"), 256)),
        "blank": seen == "",
        "cut": ~F.substring(seen, -1, 1).isin(".", "!", "?"),
        "state": state.cast("int"),
    })


def _repeats(rows: DataFrame) -> DataFrame:
    """Texts that a conversation has several times from one role, with the first turn; one row for all copies."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    many = rows.filter("live").groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    return durable(many.filter("n > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows of conversations in order, as one row for each piece."""
    repeats = small(_repeats(rows))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.join(repeats, same, "left").withColumn("again", F.coalesce(at > F.col("first"), F.lit(False)))
    rows = rows.select("conv", "turn", "role", "text", "live", "blank", "again", "cut", "state")
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a prefix as the last key of the ranges agrees with the order of the texts; rows of one key stay together
    ranged = rows.repartitionByRange(count, *by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")

    schema = T.StructType([
        rows.schema["conv"], *T.StructType.fromDDL(
            "at long, codes binary, roles array<string>, texts array<string>, first_turn long, last_turn long, "
            "first_initial string, last_initial string, " + ", ".join(f"{c} long" for c in _STATS)
        ).fields
    ])

    def work(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        names = [f.name for f in schema.fields]
        arrow = None
        piece, previous, key, size = None, None, (), 0

        def fresh():
            return {"codes": bytearray(), "roles": [], "texts": [], "turns": [], "initials": [], "blank": 0, "duplicate": 0, "truncated": 0}

        def closed():
            turns, initials = piece["turns"], piece["initials"]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            row = (
                key[0], base + number, bytes(piece["codes"]), piece["roles"], piece["texts"], turns[0] if turns else None,
                turns[-1] if turns else None, initials[0] if initials else None, initials[-1] if initials else None,
                piece["blank"], piece["duplicate"], piece["truncated"], illegal, len(set(turns)),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow, strict=True)], names)

        for batch in batches:
            if arrow is None:
                strings = pa.list_(pa.string())
                arrow = [batch.schema.field("conv").type, pa.int64(), pa.binary(), strings, strings, pa.int64(), pa.int64(),
                         pa.string(), pa.string(), *[pa.int64()] * len(_STATS)]
            out = []
            for conv, turn, role, text, live, blank, again, cut, state in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if piece is None or key != (conv,) or len(piece["codes"]) >= PIECE_ROWS or size >= PIECE_BYTES:
                    if piece is not None:
                        out.append(closed())
                        number += 1
                    piece, key, size = fresh(), (conv,), 0
                if not live:
                    continue
                code = state
                if blank:
                    piece["blank"] += 1
                    code |= GONE
                elif again or previous == (conv, turn, role, text):
                    piece["duplicate"] += 1
                    code |= GONE
                elif cut:
                    piece["truncated"] += 1
                    code |= CUT
                previous = (conv, turn, role, text)
                piece["codes"].append(code)
                piece["roles"].append(role)
                piece["texts"].append(text)
                piece["initials"].append(role[:1])
                size += len(text)
                if turn is not None:
                    piece["turns"].append(turn)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if piece is not None:
            yield closed()

    return written(ranged.mapInArrow(work, schema), "pieces")


def _stream(batches, names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def _spans(pieces: DataFrame) -> DataFrame:
    """For pieces of conversations with several: ``conv``, ``at``, the state at the start and the costs at the end."""
    kind = pieces.schema["conv"].dataType.simpleString()
    several = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"))
    several = small(durable(several))
    links = pieces.select("conv", "at", "codes").join(several, F.col("conv").eqNullSafe(F.col("c")), "left_semi")

    def packed(rows: list[tuple], like: pa.RecordBatch, names: list[str], types: list) -> pa.RecordBatch:
        types = [like.schema.field("conv").type, pa.int64(), *types]
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv", "at", *names])

    longs = pa.list_(pa.int64())

    def matrices(batches):
        repair = Repair()
        for batch in batches:
            rows = [(c, at, [v for column in repair.matrix(codes) for v in column]) for c, at, codes in _stream([batch], ["conv", "at", "codes"])]
            yield packed(rows, batch, ["m"], [longs])

    def ends(batches):  # from the last piece of a conversation to the first
        key, after = None, END
        for batch in batches:
            rows = []
            for conv, at, m in _stream([batch], ["conv", "at", "m"]):
                last = key != (conv,)
                if last:
                    key, after = (conv,), END
                rows.append((conv, at, list(after), last))
                after = tuple(min(FAR, *[m[4 * t + s] + after[t] for t in range(4)]) for s in range(4))
            yield packed(rows, batch, ["end", "last"], [longs, pa.bool_()])

    def leads(batches):
        repair = Repair()
        for batch in batches:
            rows = []
            for conv, at, end, last, codes in _stream([batch], ["conv", "at", "end", "last", "codes"]):
                rows.append((conv, at, end, last, [repair.walk(codes, s, end, False)[1] for s in range(4)]))
            yield packed(rows, batch, ["end", "last", "leads"], [longs, pa.bool_(), longs])

    def starts(batches):
        key, state = None, START
        for batch in batches:
            rows = []
            for conv, at, end, last, to in _stream([batch], ["conv", "at", "end", "last", "leads"]):
                if key != (conv,):
                    key, state = (conv,), START
                rows.append((conv, at, end, last, state))
                state = to[state]
            yield packed(rows, batch, ["end", "last", "start"], [longs, pa.bool_(), pa.int64()])

    base = f"conv {kind}, at long"
    found = links.mapInArrow(matrices, f"{base}, m array<long>")
    found = found.repartition("conv").sortWithinPartitions("conv", F.col("at").desc()).mapInArrow(ends, f"{base}, end array<long>, last boolean")
    found = small(durable(found)).withColumnsRenamed({"conv": "c", "at": "a"})
    found = links.join(found, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))).drop("c", "a")
    found = found.mapInArrow(leads, f"{base}, end array<long>, last boolean, leads array<long>")
    found = found.repartition("conv").sortWithinPartitions("conv", "at")
    return durable(found.mapInArrow(starts, f"{base}, end array<long>, last boolean, start long"))


def _walkable(pieces: DataFrame) -> DataFrame:
    """Pieces with ``start``, ``end`` and ``last`` (null: the piece is the whole conversation)."""
    spans = small(_spans(pieces)).withColumnsRenamed({"conv": "c", "at": "a"})
    return pieces.join(spans, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left").drop("c", "a")


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None
) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that give its roles the form ``(s?(ua)+)?``.

    Rows go by turn (nulls first), role and text; a null role or text is one blank.  A row's first fault counts: ``blank`` (only
    ASCII white space), ``duplicate`` (role and text of an earlier row), ``truncated`` (does not end in ``.``, ``!`` or ``?``).
    ``gaps`` are turns missing between the first and the last known one, ``illegal`` neighbours other than su, ua and au.  ``audit``
    has a letter for each edit in order: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate
    rows), Insert an empty user or assistant row (5); a truncated row that stays costs 5 more.  Of audits of the least
    ``cost`` it is the ASCII-least.  ``repaired_sha256`` is that of the repaired rows as ``role:text`` lines.

    Rows where ``live`` is false only mark that their conversation exists; one without other rows has zeros, an empty audit and
    the digest of nothing.  A null conversation id is a conversation.  An empty table gives an empty result; extra columns are not read.
    """
    pieces = _pieces(_columns(rows, conv, turn, role, text, live))
    kind = pieces.schema["conv"].dataType.simpleString()
    extra = ["first_turn", "last_turn", "first_initial", "last_initial"]
    body = _walkable(pieces).select("conv", "at", "codes", "roles", "texts", "start", "end", "last", *extra, *_STATS)

    def walk(batches):
        repair = Repair()
        for batch in batches:
            costs, audits, digests, bodies = [], [], [], []
            for codes, roles, texts, start, end, last in _stream([batch], ["codes", "roles", "texts", "start", "end", "last"]):
                edits, _, cost = repair.walk(codes, start or START, end or END, last is not False)
                lines = "\n".join([f"{r}:{t}" for _, r, t in repaired(edits, start or START, roles, texts, codes)]).encode()
                empty = all(x.strip("D") == "" for x in edits)
                costs.append(cost)
                audits.append("".join(edits))
                digests.append(sha256(lines).hexdigest() if last is None else None)
                bodies.append(None if last is None or empty else lines)
            head = batch.select(["conv", "at", *extra, *_STATS])
            new = [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*head.columns, *new], [*head.schema.names, "cost", "audit", "repaired_sha256", "body"])

    turns = "first_turn long, last_turn long, first_initial string, last_initial string"
    stats = ", ".join(f"{c} long" for c in _STATS)
    walked = body.mapInArrow(walk, f"conv {kind}, at long, {turns}, {stats}, cost long, audit string, repaired_sha256 string, body binary")
    # pieces of a conversation meet as a stream in their order: sums, an audit and a running hash
    walked = durable(walked)
    whole = walked.filter("repaired_sha256 is not null").drop("at", "body")
    parts = walked.filter("repaired_sha256 is null").repartition("conv").sortWithinPartitions("conv", "at")

    def merge(batches):
        key, now, like = None, None, None

        def closed():
            now["repaired_sha256"] = now.pop("hash").hexdigest()
            now["audit"] = "".join(now["audit"])
            names = [n for n in like.names if n not in ("at", "body")]
            return pa.RecordBatch.from_arrays([pa.array([now[n]], like.field(n).type) for n in names], names)

        for batch in batches:
            like = batch.schema
            for row in batch.to_pylist():
                if key != (row["conv"],):
                    if now is not None:
                        yield closed()
                    key, now = (row["conv"],), {**row, "audit": [], "hash": sha256(), "any": False}
                else:
                    a, b = now["last_initial"], row["first_initial"]
                    now["illegal"] += a is not None and b is not None and a + b not in ("su", "ua", "au")
                    now["n_turns"] -= now["last_turn"] is not None and now["last_turn"] == row["first_turn"]
                    for c in (*_STATS, "cost"):
                        now[c] += row[c]
                    for c in ("last_turn", "last_initial"):
                        now[c] = now[c] if row[c] is None else row[c]
                    for c in ("first_turn", "first_initial"):
                        now[c] = row[c] if now[c] is None else now[c]
                now["audit"].append(row["audit"])
                if row["body"] is not None:
                    now["hash"].update((b"\n" if now["any"] else b"") + row["body"])
                    now["any"] = True
        if now is not None:
            yield closed()

    merged = parts.mapInArrow(merge, f"conv {kind}, {turns}, {stats}, cost long, audit string, repaired_sha256 string")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    return whole.unionByName(merged).select(
        F.col("conv").alias(conv), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def repaired_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None
) -> DataFrame:
    """The rows that the edits of :func:`repair_conversations` leave and insert: ``conv``, ``place``, ``edit``, ``role``, ``text``.

    ``place`` orders the rows of a conversation, with gaps.  Conversations without rows after the repair are absent.
    """
    pieces = _pieces(_columns(rows, conv, turn, role, text, live))

    def work(batches):
        repair = Repair()
        for batch in batches:
            kind = batch.schema.field("conv").type
            for c, at, codes, roles, texts, start, end, last in _stream([batch], ["conv", "at", "codes", "roles", "texts", "start", "end", "last"]):
                edits = repair.walk(codes, start or START, end or END, last is not False)[0]
                found = list(repaired(edits, start or START, roles, texts, codes))
                if found:
                    names, kept, lines = zip(*found, strict=True)
                    place = pa.array([(at << 16) + k for k in range(len(found))], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c] * len(found), kind), place, pa.array(names), pa.array(kept), pa.array(lines)], ["conv", "place", "edit", "role", "text"]
                    )

    kind = pieces.schema["conv"].dataType.simpleString()
    body = _walkable(pieces).select("conv", "at", "codes", "roles", "texts", "start", "end", "last")
    return body.mapInArrow(work, f"conv {kind}, place long, edit string, role string, text string").withColumnRenamed("conv", conv)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: ``conv``, ``turn``, ``role``, ``text``, ``live``.

    Of 20 hash values 0 drops a row (it stays as a mark that is not live), 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it and
    4 makes its role user.  A null is one blank, in the hash too; a null conversation or turn stays null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = rows.select(
        conv, turn, F.coalesce(F.col(role), blank).alias(role), F.coalesce(F.col(text), blank).alias(text), (F.crc32(key) % 20).alias("_fault")
    )
    fault = F.col("_fault")
    words = F.when(fault == 1, "").when(fault == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        conv, turn, F.when(fault == 4, "user").otherwise(F.col(role)).alias(role), F.when(fault == 0, "").otherwise(words).alias(text),
        (fault != 0).alias("live"), F.explode(copies).alias("_copy"),
    ).drop("_copy")
