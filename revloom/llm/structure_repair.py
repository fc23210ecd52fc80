"""Repair of conversation structure on a suffix-shared automaton.

A conversation's structure is its signature: per turn, the role's initial and the fault.
Cheapest edits depend on nothing else, and what is cheapest from a turn on depends on the
rest of the signature only.  Distinct signatures are therefore read from their ends: sorted
by their reversed strings, those that share an ending lie together, and a sweep keeps one
path of nodes, each the automaton's state for one ending.  A node holds, for each state
of the role grammar, the cost to go and the choice that begins the best audit; the audit
itself is read along the path, so an ending's audits are stored once for all conversations.

Turns stream through sorted partitions, so no task holds a conversation; a fault that looks
back (a turn seen earlier) comes from a join with the groups of equal turns.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import SPACE_CLASS, joined_by_key, quoted, salted_join, written

#: A signature's letters: a turn to delete, else the role's initial (o: another one), as a
#: capital if the text is truncated.
DELETED = "x"
#: States of the grammar: at the start, after a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that must come next, where it is a user's or an assistant's.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Costs of edits, and of keeping a truncated turn.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS, INSERTS = "DKR", 2  # more inserts in a row come back to a state that they passed
#: What the end asks for in each state: inserts until the grammar accepts.
TAIL = (0, 2, 1, 0)


def moved(state: int, letter: str, edit: str) -> int:
    """The state after an edit other than an insert of a turn with this letter."""
    return state if edit == "D" else FOLLOWING[state] if edit == "R" else KEPT[letter.lower()]


def fits(state: int, letter: str) -> bool:
    role = KEPT.get(letter.lower())
    return role == FOLLOWING[state] or (role == SYSTEM and state == START)


def choices(letter: str, costs: list[int]) -> list[tuple[int, int]]:
    """(cost to go, choice) of each state before a turn with this letter, from the costs
    after it.  A choice is inserts and an edit; no choice's letters begin another's, so
    equal costs are settled by them alone, the ASCII-least first."""
    direct = []
    for state in range(4):
        options = [(DELETE + costs[state], "D")]
        if letter != DELETED:
            more = TRUNCATED if letter.isupper() else 0
            if fits(state, letter):
                options.append((KEEP + more + costs[moved(state, letter, "K")], "K"))
            options.append((REROLE + more + costs[FOLLOWING[state]], "R"))
        direct.append(options)
    out = []
    for state in range(4):
        best, at = None, state
        for n in range(INSERTS + 1):
            for cost, edit in direct[at]:
                option = (cost + n * INSERT, "I" * n + edit)
                best = min(best, option) if best else option
            at = FOLLOWING[at]
        out.append((best[0], 3 * (len(best[1]) - 1) + LETTERS.index(best[1][-1])))
    return out


class Endings:
    """The automaton's nodes on the path of one signature, from its end."""

    def __init__(self):
        self.reversed = ""
        self.costs = array("q", [INSERT * n for n in TAIL])
        self.chosen = bytearray(4)
        self.steps: dict[tuple, tuple[list[int], bytes]] = {}

    def follow(self, signature: str) -> None:
        """Go to the node of a signature; nodes that it shares with the last one stay."""
        text = signature[::-1]
        shared, most = 0, min(len(text), len(self.reversed))
        if text[:most] == self.reversed[:most]:
            shared = most
        else:
            low, high = 0, most
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if text[:middle] == self.reversed[:middle] else (low, middle)
            shared = low
        del self.costs[4 * (shared + 1) :], self.chosen[4 * (shared + 1) :]
        for letter in text[shared:]:
            after = self.costs[-4:].tolist()
            least = min(after)
            key = (letter, *(c - least for c in after))
            if (step := self.steps.get(key)) is None:
                found = choices(letter, [c - least for c in after])
                step = self.steps[key] = [c for c, _ in found], bytes(k for _, k in found)
            self.costs.extend(c + least for c in step[0])
            self.chosen += step[1]
        self.reversed = text

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature, from the start of the grammar."""
        state, out = START, []
        for depth in range(len(self.reversed), 0, -1):
            n, edit = divmod(self.chosen[4 * depth + state], 3)
            for _ in range(n):
                state = FOLLOWING[state]
            out.append("I" * n + LETTERS[edit])
            state = moved(state, self.reversed[depth - 1], LETTERS[edit])
        out.append("I" * TAIL[state])
        return self.costs[4 * len(self.reversed)], "".join(out)


def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings = Endings()
    for batch in batches:
        signatures = batch.column("signature").to_pylist()
        found = []
        for s in signatures:
            endings.follow(s)
            found.append(endings.best())
        columns = [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct row of ``signatures``.

    Ranges of reversed signatures are swept apart; only the nodes on the path between two
    ranges are met in both.
    """
    distinct = signatures.select("signature").distinct().withColumn("ending", F.reverse("signature"))
    return distinct.repartitionByRange("ending").sortWithinPartitions("ending").select("signature").mapInArrow(audited, "signature string, cost long, audit string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text; a null counts as one space) with the faults that
    the check sum of ``conv_id:turn`` deals them."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(spaced("role"))
    rows = turns.withColumn("draw", draw).filter("draw != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "draw")
    return rows.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("draw", "copy")


def judged(turns: DataFrame) -> DataFrame:
    """Adds equal (a digest of conversation, role and text), kind (what a row alone shows:
    blank, truncated or good) and later (whether an equal row has an earlier turn)."""
    blank = ~F.col("text").rlike("[^" + SPACE_CLASS[1:])
    ends = F.col("text").rlike(r"[.!?]" + SPACE_CLASS + r"*\z")
    name = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role").cast("string"), "role", "text")
    rows = turns.withColumn("kind", F.when(blank, "blank").when(ends, "good").otherwise("truncated")).withColumn("equal", F.sha2(name, 256))
    groups = rows.filter("kind != 'blank'").groupBy("equal").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("any_null"))
    found = joined_by_key(rows, groups.filter("n > 1"), "equal", "n", "left")
    later = F.col("n").isNotNull() & F.col("turn").isNotNull() & (F.col("any_null") | (F.col("turn") > F.col("first")))
    return found.withColumn("later", F.coalesce(later, F.lit(False))).drop("n", "first", "any_null")


def in_order(rows: DataFrame, *before: Column) -> DataFrame:
    """Conversations in one partition each, streamed by turn (null first), then role and text."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *before, F.col("turn").asc_nulls_first(), "role", "text")


SUMMARY = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "signature": "string"}


class Summary:
    """Counts and the signature of one conversation, fed its turns in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.counts, self.letters = conv_id, [None, None, 0], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), bytearray()
        self.initial, self.equal = None, None

    def feed(self, turn, initial, kind, equal, later) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        fault = "duplicate" if kind != "blank" and (later or equal == self.equal) else kind
        if fault != "good":
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        letter = initial if initial in KEPT else "o"
        self.letters += (DELETED if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter).encode()
        self.initial, self.equal = initial, equal

    def row(self) -> tuple:
        least, most, distinct = self.turns
        gaps = most - least + 1 - distinct if distinct else 0
        return self.conv_id, gaps, *self.counts.values(), self.letters.decode()


def summariser(kind: pa.DataType):
    types = [kind, *[pa.int64()] * 5, pa.string()]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[Summary]) -> pa.RecordBatch:
            columns = list(zip(*[s.row() for s in rows], strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *SUMMARY])

        now = None
        for batch in batches:
            done = []
            for conv_id, *turn in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "kind", "equal", "later")], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now)
                    now = Summary(conv_id)
                now.feed(*turn)
            yield made(done)
        if now:
            yield made([now])

    return summarise


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of ``SUMMARY`` for each conversation in ``rows``, as judged."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = in_order(rows.select("conv_id", "turn", "role", "text", "kind", "equal", "later")).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "kind", "equal", "later")
    return placed.mapInArrow(summariser(arrow_type(rows, "conv_id")), ", ".join([f"conv_id {kind}", *[f"{c} {t}" for c, t in SUMMARY.items()]]))


class Repair:
    """Applies an audit to a conversation's turns, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, FOLLOWING[self.state]
            yield "I", ROLES[self.state], ""

    def feed(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand here after the repair."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at, self.state = self.at + 1, moved(self.state, role[:1], edit)
        if edit != "D":
            yield edit, ROLES[self.state] if edit == "R" else role, text


def repairer(kind: pa.DataType):
    """Streams (conv_id, audit, ...) rows, each before its turns, into repaired turns."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_id, position = None, None, 0
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "position", "edit", "role", "text"])

        for batch in batches:
            out: list[tuple] = []

            def put(found) -> None:
                nonlocal position
                for turn in found:
                    out.append((conv_id, position, *turn))  # noqa: B023
                    position += 1

            for c, audit, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")], strict=True):
                if audit is not None:
                    if now:
                        put(now.inserts())
                    now, conv_id, position = Repair(audit), c, 0
                else:
                    put(now.feed(role, text))
            yield made(out)
        if now:
            out = []
            for turn in now.inserts():
                out.append((conv_id, position, *turn))
                position += 1
            yield made(out)

    return repair


def digester(kind: pa.DataType):
    """Streams (conv_id, audit, summary) rows, each before its turns, into report rows."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *numbers, "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * len(numbers), pa.string(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, hashed, empty = None, (), hashlib.sha256(), True

        def put(found) -> None:
            nonlocal empty
            for _, role, text in found:
                hashed.update((b"" if empty else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False

        def ended() -> tuple:
            put(now.inserts())
            return *head, hashed.hexdigest()

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            out: list[tuple] = []
            for c, audit, role, text, *counts in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text", *numbers)], strict=True):
                if audit is not None:
                    if now:
                        out.append(ended())
                    now, head, hashed, empty = Repair(audit), (c, *counts, audit), hashlib.sha256(), True
                else:
                    put(now.feed(role, text))
            yield made(out)
        if now:
            yield made([ended()])

    return digest


def with_plans(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, the counts, cost and audit of each id; one without rows has zeros and ''."""
    found = written(summaries(rows).withColumn("key", F.sha2("signature", 256)))
    planned = audits(found).select(F.sha2("signature", 256).alias("key"), "cost", "audit")
    # a signature that many conversations share is dealt over salts
    joined = salted_join(found.drop("signature"), planned, "key", F.xxhash64("conv_id")).drop("key")
    every = ids.withColumnRenamed("conv_id", "__id").distinct().join(joined, F.col("__id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__id", "conv_id")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns(zeros | {"audit": F.coalesce("audit", F.lit(""))})


def plan_then_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    both = plans.withColumn("is_turn", F.lit(False)).unionByName(rows.select("conv_id", "turn", "role", "text").withColumn("is_turn", F.lit(True)), allowMissingColumns=True)
    return in_order(both, F.col("is_turn"))


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(quoted("conv_id").alias("conv_id"), quoted("turn").cast("long").alias("turn"), quoted("role").cast("string").alias("role"), quoted("text").cast("string").alias("text"))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text: the repaired conversations, as their
    rows are; a null role or text counts as one space."""
    turns = turns_of(conversations)
    rows = judged(turns.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}))
    kind = turns.schema["conv_id"].dataType.simpleString()
    placed = plan_then_turns(rows, with_plans(rows, turns.select("conv_id")).select("conv_id", "audit"))
    return placed.select("conv_id", "audit", "role", "text").mapInArrow(repairer(arrow_type(turns, "conv_id")), f"conv_id {kind}, position long, edit string, role string, text string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: the
    conversations after a damage that their numbers decide, and their cheapest repair.

    Every conv_id has a row, a null one too.  A null role, text or part of the drawn number
    counts as one space; null turns come first and have no gaps; turns of the same number go
    by role and text; repeated rows are duplicates.  A conversation without rows has
    zeros, an empty audit and the digest of nothing; an empty table gives no rows.  Texts of
    any length stream through whole; other columns are not read.
    """
    turns = turns_of(conversations)
    rows = judged(damaged(turns))
    kind = turns.schema["conv_id"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    placed = plan_then_turns(rows, with_plans(rows, turns.select("conv_id")))
    schema = ", ".join([f"conv_id {kind}", *[f"{c} long" for c in numbers], "audit string, repaired_sha256 string"])
    return placed.select("conv_id", "audit", "role", "text", *numbers).mapInArrow(digester(arrow_type(turns, "conv_id")), schema)
