"""Conversation structure repair: the cheapest edits that make roles ``(system? (user assistant)+)?``, by Viterbi in pieces.

Blank rows and rows seen before in their conversation must go. Over the others runs a dynamic programme of four states
(nothing yet, after system, after user, after assistant) whose cost vectors are computed from the end: keeping is free, a new
role or an inserted turn costs 2, deleting 3, a truncated row that stays 1. Rows are dealt by ranges of (conversation, turn),
so a long conversation lies in several pieces. Each piece starts from a speculative cost vector. Fix-up passes run a piece
again from the vector its successor has found, until its vectors differ from the recorded ones by a constant only, in which case
everything before them stands; a piece whose first vector changes sends its predecessor into the next pass. After ``PASSES``
passes a piece that still changes (rows without a known role can go on so for ever) hands on its vectors from each
state alone, which determine it for any successor, so the number of jobs is bounded. Adding up the constants gives the costs; the edits are then traced forwards, piece by piece, always taking the least letter that is on a cheapest way.

Cost vectors less their least entry take few values, so they are numbered as they appear and a step is a lookup. The driver
sees two short records for each partition (its first and its last piece); all rows stay in the shared folder.

Defined cases: a null role or text is one space; rows of one turn are ordered by role and text, null turns come first; equal
rows are counted, not moved one by one; rows without ``conv_id`` form one conversation; an empty table gives none; other
columns are ignored. The digest of a repaired conversation reads it in order, so one task streams it, chunk by chunk;
its audit, one letter a row, must fit into one string. Texts are ordered by their first ``PREFIX`` characters and then by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from watchspan.llm.common import SPACE, keep, table
from watchspan.session import local_table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: What follows each state when a system, user, assistant or other row is kept; None: not allowed.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: What follows each state when a user or assistant turn is made up.
MADE = (USER, USER, ASSISTANT, USER)
#: Codes of rows: role (system, user, assistant, other), plus 4 if truncated; or a row that must go.
FORCED = 8
#: Rows and bytes of text in a chunk; passes before vectors from each state are taken; characters of a text that order it.
CHUNK, CHUNK_BYTES, PASSES, PREFIX = 4096, 1 << 20, 3, 64


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): ``n`` equal rows; a conversation whose rows are all gone keeps one with n = 0."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    gone = kind == 0
    text = F.when(gone | (kind == 1), "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(gone, "").when(kind == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"),
                       F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, and whether role and text come here for the first time in the conversation."""
    marks = rows.filter("n > 0").groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    firsts = marks.select("conv_id", F.col("at.turn").alias("turn"), "role", "text", F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    return (rows.withColumn("first", F.lit(False)).unionByName(firsts).groupBy("conv_id", "turn", "role", "text")
            .agg(F.sum("n").alias("n"), F.max("first").alias("first")))


class Steps:
    """Cost vectors by number, and steps between them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.backward: dict[tuple[int, int], tuple[int, int]] = {}
        self.choices: dict[tuple[int, int, int], tuple[str, int]] = {}

    def number(self, vector) -> tuple[int, int]:
        """The vector's number and its least entry."""
        least = min(vector)
        vector = tuple(NEVER if x >= NEVER // 2 else x - least for x in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    @staticmethod
    def inserted(vector) -> list[int]:
        """With turns made up before, as many as help."""
        out = list(vector)
        for _ in range(3):
            for state, after in enumerate(MADE):
                out[state] = min(out[state], out[after] + 2)
        return out

    @staticmethod
    def edits(code: int, state: int, after) -> Iterator[tuple[int, str, int]]:
        """Cost, letter and next state of each way to use up a row."""
        yield 3 + after[state], DELETE, state
        if code != FORCED:
            extra = code >> 2
            if KEPT[state][code & 3] is not None:
                yield extra + after[KEPT[state][code & 3]], KEEP, KEPT[state][code & 3]
            yield 2 + extra + after[MADE[state]], REROLE, MADE[state]

    def before(self, after: int, code: int) -> tuple[int, int]:
        """The vector in front of a row, and what it is more."""
        found = self.backward.get((after, code))
        if found is None:
            vector = self.vectors[after]
            found = self.number(self.inserted([min(cost for cost, _, _ in self.edits(code, state, vector)) for state in range(4)]))
            self.backward[after, code] = found
        return found

    def choice(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The least letters on a cheapest way up to and over a row, and the state behind it."""
        found = self.choices.get((after, code, state))
        if found is None:
            vector, least = self.vectors[after], self.before(after, code)
            front = [x + least[1] for x in self.vectors[least[0]]]
            letters, at = "", state
            while True:
                ways = [(letter, to) for cost, letter, to in self.edits(code, at, vector) if cost == front[at]]
                if front[MADE[at]] + 2 == front[at]:
                    ways.append((INSERT, MADE[at]))
                letter, to = min(ways)
                letters, at = letters + letter, to
                if letter != INSERT:
                    break
            found = self.choices[after, code, state] = letters, at
        return found

    def run(self, codes: bytes, after: int) -> tuple[int, int]:
        """Backwards over ``codes``: the first vector and the cost added."""
        cost = 0
        for code in reversed(codes):
            after, more = self.before(after, code)
            cost += more
        return after, cost

    def rerun(self, codes: bytes, old: int, new: int) -> tuple[int, int] | None:
        """Until the vectors from both ends agree but for a constant: the rows this took and what the new costs are more; None if they never do."""
        more = 0
        for k, code in enumerate(reversed(codes)):
            if old == new:
                return k, more
            old, a = self.before(old, code)
            new, b = self.before(new, code)
            more += b - a
        return (len(codes), more) if old == new else None

    def trace(self, codes: bytes, after: int, state: int) -> tuple[str, str, int]:
        """Letters of all edits, of those on rows that need not go, and the last state."""
        behind = [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            behind[k] = after
            after, _ = self.before(after, codes[k])
        audit, moves = [], []
        for code, after in zip(codes, behind):
            if code == FORCED:
                audit.append(DELETE)
                continue
            letters, state = self.choice(after, code, state)
            audit.append(letters)
            moves.append(letters)
        return "".join(audit), "".join(moves), state


#: The vector behind the last row: conversations end after an assistant, or empty; turns may still be made up.
END = Steps.inserted([0, NEVER, NEVER, 0])
#: The speculative one, and those from each state alone.
GUESS = Steps.inserted([0, 0, 0, 0])
ALONE = [Steps.inserted([0 if s == state else NEVER for s in range(4)]) for state in range(4)]
TAIL = {START: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class Piece:
    """What a partition holds of a conversation."""

    def __init__(self, conv_id, part: int):
        self.conv_id, self.part, self.codes, self.chunks = conv_id, part, bytearray(), 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.roles, self.texts, self.held = [], [], 0

    def add(self, turn, role: str, text: str, n: int, blank: bool, first: bool, code: int) -> Iterator[dict]:
        if not n:
            return
        count, initial = self.counts, role[:1]
        if self.last_role is None:
            self.first_role = initial
        else:
            count["illegal"] += self.last_role + initial not in LEGAL
        count["illegal"] += n - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            count["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            count["blank"] += n
        else:
            count["duplicate"] += n - first
        if blank or not first:
            self.codes += bytes([FORCED]) * n
            return
        count["truncated"] += code >> 2
        self.codes += bytes([code]) + bytes([FORCED]) * (n - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.held += len(text)
        if len(self.roles) == CHUNK or self.held > CHUNK_BYTES:
            yield self.chunk()

    def chunk(self) -> dict:
        out = {"conv_id": self.conv_id, "part": self.part, "no": self.chunks, "roles": self.roles, "texts": self.texts}
        self.roles, self.texts, self.held, self.chunks = [], [], 0, self.chunks + 1
        return out

    def close(self, edge: bool) -> Iterator[dict]:
        if self.roles:
            yield self.chunk()
        yield {"conv_id": self.conv_id, "part": self.part, "no": -1, "edge": edge, "codes": bytes(self.codes), "first_role": self.first_role,
               "last_role": self.last_role, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.counts}


PIECE = ("conv_id {}, part int, no int, edge boolean, codes binary, roles array<string>, texts array<string>, first_role string, last_role string, "
         "first_turn long, last_turn long, " + ", ".join(f"{c} long" for c in COUNTS))
AT_ONCE = 512


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += sum(map(len, row.get("texts") or ())) + len(row.get("codes") or "") + len(row.get("text") or "")
        if len(waiting) == AT_ONCE or held > CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _mapped(df: DataFrame, make, ddl: str) -> DataFrame:
    """``make`` gets an iterator of rows, as tuples in the order of columns, and gives dictionaries."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        rows = (row for batch in batches for k in range(0, batch.num_rows, 1024) for row in zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns)))
        yield from _in_batches(make(rows), schema)

    return df.mapInArrow(run, ddl)


def pieces(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of conversations, dealt by ranges: for each piece one with no = -1 and the codes, others with its texts."""
    solid, initial = F.rtrim(F.col("text"), F.lit(SPACE)), F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "n", (solid == "").alias("blank"), "first",
                        (role + F.when(F.substring(solid, -1, 1).isin(".", "!", "?"), 0).otherwise(4)).alias("code"),
                        F.substring("text", 1, PREFIX).alias("cut"), F.xxhash64("text").alias("hash"))
    keys = ["conv_id", "turn", "role", "cut", "hash"]
    dealt = coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("cut", "hash")

    def make(rows):
        part, piece, opened = TaskContext.get().partitionId(), None, False
        for conv_id, *row in rows:
            if piece is None or conv_id != piece.conv_id:
                if piece:
                    yield from piece.close(edge=not opened)
                    opened = True
                piece = Piece(conv_id, part)
            yield from piece.add(*row)
        if piece:
            yield from piece.close(edge=True)

    return _mapped(dealt, make, PIECE.format(dict(rows.dtypes)["conv_id"]))


def _asked(cut: DataFrame, asks: dict[tuple, tuple], columns: str, make, out: str) -> list:
    """Runs ``make(steps, codes, *ask)`` for the pieces asked for; ``columns`` declares what is asked."""
    kind = dict(cut.dtypes)["conv_id"]
    asked = local_table(cut.sparkSession, [(*key, *ask) for key, ask in asks.items()], f"conv_id {kind}, part int{columns}")
    names = [c for c in asked.columns if c not in ("conv_id", "part")]
    both = cut.filter("no = -1").alias("c").join(asked.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("c.part") == F.col("a.part")))

    def run(rows):
        steps = Steps()
        for conv_id, part, codes, *ask in rows:
            yield {"conv_id": conv_id, "part": part, **make(steps, codes, *ask)}

    return _mapped(both.select("c.conv_id", "c.part", "codes", *names), run, f"conv_id {kind}, part int, {out}").collect()


def _first(steps: Steps, codes: bytes, vector: list[int]) -> dict:
    return {"vector": steps.vectors[steps.run(codes, steps.number(vector)[0])[0]]}


def _fixed(steps: Steps, codes: bytes, old: list[int], new: list[int]) -> dict:
    old, new = steps.number(old)[0], steps.number(new)[0]
    return {"vector": None if steps.rerun(codes, old, new) else steps.vectors[steps.run(codes, new)[0]]}


def _alone(steps: Steps, codes: bytes) -> dict:
    out = []
    for vector in ALONE:
        last, least = steps.number(vector)
        first, cost = steps.run(codes, last)
        out.append([min(x + cost + least, NEVER) for x in steps.vectors[first]])
    return {"ways": out}


def _exits(steps: Steps, codes: bytes, vector: list[int]) -> dict:
    last = steps.number(vector)[0]
    return {"exits": [steps.trace(codes, last, state)[2] for state in range(4)]}


def settled(cut: DataFrame) -> tuple[list[tuple], int]:
    """(conv_id, part, vector behind it, state before it, whether it is the last) of pieces of cut conversations, and the passes made."""
    spans: dict = {}
    for r in cut.filter("no = -1 and edge").select("conv_id", "part").collect():
        spans.setdefault(r.conv_id, []).append(r.part)
    spans = {conv_id: sorted(parts) for conv_id, parts in spans.items() if len(parts) > 1}
    if not spans:
        return [], 0
    keys = [(conv_id, part) for conv_id, parts in spans.items() for part in parts]
    follower = {(conv_id, a): (conv_id, b) for conv_id, parts in spans.items() for a, b in zip(parts, parts[1:])}
    norm = lambda v: [x - min(v) if x < NEVER // 2 else NEVER for x in v]
    last = {key: norm(GUESS if key in follower else END) for key in keys}
    rows = _asked(cut, {key: (last[key],) for key in keys}, ", last array<long>", _first, "vector array<long>")
    first = {(r.conv_id, r.part): r.vector for r in rows}
    passes = 0
    while changed := {key: (last[key], first[after]) for key, after in follower.items() if last[key] != first[after]}:
        if passes == PASSES:
            ways = {(r.conv_id, r.part): r.ways for r in _asked(cut, {key: () for key in changed.keys() | _before(changed, follower, keys)}, "", _alone, "ways array<array<long>>")}
            for key in reversed(keys):
                if key in follower and last[key] != first[follower[key]]:
                    last[key] = first[follower[key]]
                    if key in ways:
                        first[key] = norm([min(w[s] + x for w, x in zip(ways[key], last[key])) for s in range(4)])
            break
        passes += 1
        for r in _asked(cut, changed, ", old array<long>, new array<long>", _fixed, "vector array<long>"):
            key = r.conv_id, r.part
            last[key] = changed[key][1]
            first[key] = r.vector or first[key]
    exits = {(r.conv_id, r.part): r.exits for r in _asked(cut, {key: (last[key],) for key in keys}, ", last array<long>", _exits, "exits array<int>")}
    out = []
    for conv_id, parts in spans.items():
        state = START
        for part in parts:
            out.append((conv_id, part, last[conv_id, part], state, part == parts[-1]))
            state = exits[conv_id, part][state]
    return out, passes


def _before(changed, follower, keys) -> set:
    """Pieces in front of a changed one in their conversation: their vectors may change too."""
    out, waiting = set(), set()
    for conv_id, part in reversed(keys):
        if conv_id in waiting and (conv_id, part) in follower:
            out.add((conv_id, part))
        if (conv_id, part) in changed:
            waiting.add(conv_id)
    return out


def traced(cut: DataFrame) -> DataFrame:
    """``pieces`` with the edits of each: cost, audit, and the moves on rows that need not go."""
    kind = dict(cut.dtypes)["conv_id"]
    plan = local_table(cut.sparkSession, settled(cut)[0], f"conv_id {kind}, part int, vector array<long>, state int, ends boolean")
    one, two = cut.filter("no = -1").alias("c"), plan.alias("p")
    rows = one.join(two, F.col("c.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("c.part") == F.col("p.part")), "left").select(
        "codes", "vector", "state", "ends", *[f"c.{c}" for c in CARRIED])

    def make(rows):
        steps = Steps()
        for codes, vector, state, ends, *carried in rows:
            ends = ends is None or ends
            last = steps.number(END if vector is None else vector)[0]
            first, cost = steps.run(codes, last)
            audit, moves, state = steps.trace(codes, last, state or START)
            tail = TAIL[state] if ends else ""
            yield {"cost": cost, "front": steps.vectors[first][START], "audit": audit + tail, "moves": moves + tail, **dict(zip(CARRIED, carried))}

    return _mapped(rows, make, "cost long, front long, audit string, moves string, " + ", ".join(f"{c} {t}" for c, t in cut.dtypes if c in CARRIED))


CARRIED = ["conv_id", "part", "no", "first_role", "last_role", "first_turn", "last_turn", *COUNTS]


def repaired(cut: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, totals): the turns of every repaired conversation in order, behind them one row with its totals."""
    chunks = cut.filter("no >= 0").select("conv_id", "part", "no", "roles", "texts")
    both = traced(cut).unionByName(chunks, allowMissingColumns=True)
    kind = dict(cut.dtypes)["conv_id"]
    rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    columns = ["conv_id", "no", "cost", "front", "audit", "moves", "first_role", "last_role", "first_turn", "last_turn", *COUNTS, "roles", "texts"]

    def make(rows):
        walk = None
        for row in rows:
            row = dict(zip(columns, row))
            if walk is None or row["conv_id"] != walk.conv_id:
                if walk:
                    yield from walk.close()
                walk = Walk(row["conv_id"])
            yield from walk.piece(row) if row["no"] < 0 else walk.chunk(row["roles"], row["texts"])
        if walk:
            yield from walk.close()

    return _mapped(rows.select(*columns), make, f"conv_id {kind}, position long, role string, text string, {TOTALS}")


TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Walk:
    """Through the pieces and chunks of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.position, self.digest = conv_id, START, 0, hashlib.sha256()
        self.moves, self.at, self.audit, self.cost = "", 0, [], None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.last_role = self.first_turn = self.last_turn = None

    def turn(self, role: str, text: str) -> dict:
        self.digest.update(("\n" if self.position else "").encode() + f"{role}:{text}".encode())
        self.position += 1
        return {"conv_id": self.conv_id, "position": self.position - 1, "role": role, "text": text}

    def made(self) -> str:
        self.state = MADE[self.state]
        return "user" if self.state == USER else "assistant"

    def rest(self) -> Iterator[dict]:
        for _ in self.moves[self.at:]:
            yield self.turn(self.made(), "")

    def piece(self, row: dict) -> Iterator[dict]:
        yield from self.rest()
        self.moves, self.at = row["moves"], 0
        self.audit.append(row["audit"])
        self.cost = row["front"] + row["cost"] if self.cost is None else self.cost + row["cost"]
        for c in COUNTS:
            self.counts[c] += row[c]
        if row["first_role"] is not None:
            self.counts["illegal"] += self.last_role is not None and self.last_role + row["first_role"] not in LEGAL
            self.last_role = row["last_role"]
        if row["first_turn"] is not None:
            self.counts["turns"] -= row["first_turn"] == self.last_turn
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]

    def chunk(self, roles: list[str], texts: list[str]) -> Iterator[dict]:
        for role, text in zip(roles, texts):
            while (move := self.moves[self.at]) == INSERT:
                yield self.turn(self.made(), "")
                self.at += 1
            self.at += 1
            if move == KEEP:
                self.state = KEPT[self.state]["sua".index(role[0])]
                yield self.turn(role, text)
            elif move == REROLE:
                yield self.turn(self.made(), text)

    def close(self) -> Iterator[dict]:
        yield from self.rest()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts.pop("turns")
        self.counts.pop("turns", None)
        yield {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``repaired`` from (conv_id, turn, role, text, n)."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return repaired(keep(pieces(keep(counted(rows)), parts)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair(damage(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])))
    return done.filter("repaired_sha256 is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
