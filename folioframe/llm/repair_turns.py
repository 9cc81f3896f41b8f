"""Conversation structure repair by a dynamic programme over a trie of signatures.

A conversation's signature has one hexadecimal digit for each row: the role's initial (s, u, a or another) and the row's
first fault. Signatures arrive sorted, so the path of the current one in the prefix trie is a stack: what it shares with the
one before it keeps its layers, and only the rest is computed. A layer holds, for each state of the target
`(s?(ua)+)?`, the least cost and which edits reach it at that cost; at a terminal node the cheapest edits are read from the layers.

Edits: keep costs 0, rerole to user or assistant 2, delete 3 (the only edit of blank and duplicate rows), insert
an empty user or assistant row 2; a truncated row that stays adds 1. Of the cheapest, that with the ASCII-least initials is taken.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Initials as they stand in a signature; whatever is none of the first three is the fourth.
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
NO_SPACE, STOP = r"[^\x20\x09-\x0D]", r"[.!?]"
#: A text whose last character that is no space is a stop.
STOPPED = r"[.!?][\x20\x09-\x0D]*\z"
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: States of the target: nothing yet, after s, after u, after a; nothing and after a may end.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (NOTHING, AFTER_A)
STEPS = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FAR = 1 << 60
#: What an edit does, with the role it gives: inserts and reroles have the role's initial, in lower and upper case.
ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), null roles and texts one space, damaged by crc32('conv_id:turn') % 20 (null: one space):
    0 drops a row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    filled = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", STOP, "")).otherwise(F.col("text"))
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return filled.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")


def _digit(role: Column, text: Column, repeated: Column) -> Column:
    place, fault = F.lit(len(INITIALS)), F.when(~text.rlike(NO_SPACE), BLANK).when(repeated, DUPLICATE).when(~text.rlike(STOPPED), TRUNCATED).otherwise(CLEAN)
    for i, c in enumerate(INITIALS):
        place = F.when(F.substring(role, 1, 1) == c, i).otherwise(place)
    return F.lower(F.hex((place * 4 + fault).cast("long")))


def placed(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) written in the order of each conversation (turn with nulls first, role, text), with `place`, which ascends
    in it, and `part`, the range of places it lies in. A long conversation has many parts."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    spread = rows.withColumn("_n", F.monotonically_increasing_id())  # spreads rows that are alike in all else
    ordered = spread.repartitionByRange(*order, "_n").sortWithinPartitions(*order, "_n").withColumn("place", F.monotonically_increasing_id())
    return written(ordered.select("conv_id", "turn", "role", "text", "place", F.shiftright("place", 33).alias("part")), "turns-placed")


def digits(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, part, place, digit) of placed rows.

    A row repeats if it is not the first of its conversation, role and text. Firsts are least places, which rows meet by the place
    itself, so neither a long conversation nor a frequent text comes together in one task.
    """
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = ordered.groupBy("conv_id", said.alias("said")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    once, again = (_digit(F.col("role"), F.col("text"), F.lit(r)) for r in (False, True))
    rows = ordered.select("conv_id", "turn", "part", "place", once.alias("once"), again.alias("again"))
    return rows.join(firsts, "place", "left").select("conv_id", "turn", "part", "place", F.when(F.col("first"), F.col("once")).otherwise(F.col("again")).alias("digit"))


def _by_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on conv_id, null with null."""
    return left.join(right.withColumnRenamed("conv_id", "_other"), F.col("conv_id").eqNullSafe(F.col("_other")), "left").drop("_other")


def signatures(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, signature, parts, sizes, gaps) of each conv_id: the digits in order, the parts in which they lie with the rows of each, and
    the turns missing between the least and the greatest. A conversation without rows has an empty signature."""
    pieces = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "digit"))).alias("d"))
    pieces = pieces.select("conv_id", F.struct("part", F.array_join(F.transform("d", lambda x: x["digit"]), "").alias("s")).alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = _by_conversation(_by_conversation(conv_ids.select("conv_id").distinct(), whole), turns)
    return found.select(
        "conv_id", F.coalesce(F.array_join(F.transform("p", lambda x: x["s"]), ""), F.lit("")).alias("signature"),
        F.coalesce(F.transform("p", lambda x: x["part"]), F.array().cast("array<long>")).alias("parts"),
        F.coalesce(F.transform("p", lambda x: F.length(x["s"])), F.array().cast("array<int>")).alias("sizes"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
    )


def _moves(state: int, digit: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of a row of this digit in a state."""
    initial, fault = "sua?"[digit // 4], digit % 4
    found = [("D", state, COST["D"])]
    if fault not in (BLANK, DUPLICATE):
        stays = fault == TRUNCATED
        if (state, initial) in STEPS:
            found.append(("K", STEPS[state, initial], COST["K"] + stays))
        found += [(role.upper(), STEPS[state, role], COST["R"] + stays) for role in "ua" if (state, role) in STEPS]
    return found


#: Insertions: (role, state, next state).
INSERTS = [(role, state, after) for (state, role), after in STEPS.items() if role != "s"]


def _insert(costs: list[int]) -> tuple[list[int], frozenset]:
    """Least costs after any insertions, and the insertions that lie on a least way."""
    best = list(costs)
    for _ in range(3):
        for _, state, after in INSERTS:
            best[after] = min(best[after], best[state] + COST["I"])
    return best, frozenset((role, state, after) for role, state, after in INSERTS if best[state] < FAR and best[state] + COST["I"] == best[after])


@cache
def _layer(before: tuple[int, ...], digit: int) -> tuple[int, tuple[int, ...], frozenset, frozenset]:
    """One row: what all costs rise by, the costs beyond that, the edits on least ways (edit, state, next state) and the insertions
    behind them. Costs are taken relative to their least, so few layers are different and each is computed once."""
    reached, moves = [FAR] * 4, [(edit, state, after, before[state] + cost) for state in range(4) if before[state] < FAR for edit, after, cost in _moves(state, digit)]
    for _, _, after, cost in moves:
        reached[after] = min(reached[after], cost)
    costs, inserts = _insert(reached)
    rise = min(costs)
    return rise, tuple(min(c - rise, FAR) if c < FAR else FAR for c in costs), frozenset((e, s, t) for e, s, t, c in moves if c == costs[t]), inserts


class Trie:
    """The path of the last signature: layer i belongs to its prefix of i digits."""

    def __init__(self):
        start, inserts = _insert([0, FAR, FAR, FAR])
        self.signature, self.computed = "", 0
        self.total, self.costs, self.moves, self.inserts = [0], [tuple(start)], [frozenset()], [inserts]
        self.faults, self.illegal = [(0, 0, 0)], [0]

    def answer(self, signature: str) -> tuple[int, int, int, int, int, str]:
        """(blank, duplicate, truncated, illegal, cost, edits) of a signature; the edits are letters of `ROLES`, K and D."""
        shared, most = 0, min(len(signature), len(self.signature))
        while shared < most and signature[shared] == self.signature[shared]:
            shared += 1
        for layers in (self.total, self.costs, self.moves, self.inserts, self.faults, self.illegal):
            del layers[shared + 1 :]
        for i in range(shared, len(signature)):
            digit = int(signature[i], 16)
            rise, costs, moves, inserts = _layer(self.costs[i], digit)
            self.total.append(self.total[i] + rise)
            self.costs.append(costs)
            self.moves.append(moves)
            self.inserts.append(inserts)
            self.faults.append(tuple(n + (digit % 4 == k) for n, k in zip(self.faults[i], (BLANK, DUPLICATE, TRUNCATED))))
            pair = "sua?"[int(signature[i - 1], 16) // 4] + "sua?"[digit // 4] if i else "su"
            self.illegal.append(self.illegal[i] + (pair not in LEGAL))
            self.computed += 1
        self.signature = signature
        least = min(self.costs[-1][s] for s in ENDS)
        return *self.faults[-1], self.illegal[-1], self.total[-1] + least, self._edits(least)

    def _edits(self, least: int) -> str:
        n = len(self.signature)
        # backward: the states of each layer from which a least way goes on to an end
        states = {s for s in ENDS if self.costs[n][s] == least}
        good: list[set[int]] = [set()] * (n + 1)
        for i in range(n, -1, -1):
            for _ in range(3):
                states |= {s for _, s, t in self.inserts[i] if t in states}
            good[i] = states
            states = {s for _, s, t in self.moves[i] if t in states}
        # forward: the letter whose initial (D, I, K, R) is least and that stays on such a way
        state, i, edits = NOTHING, 0, []
        while True:
            ahead = [("I", e, t, 0) for e, s, t in self.inserts[i] if s == state and t in good[i]]
            if i < n:
                ahead += [("R" if e in "UA" else e, e, t, 1) for e, s, t in self.moves[i + 1] if s == state and t in good[i + 1]]
            if not ahead:
                return "".join(edits)
            _, edit, state, step = min(ahead)
            edits.append(edit)
            i += step


def audit_of(edits: str) -> str:
    """The initials of edits: Keep, Rerole, Delete, Insert."""
    return edits.translate(str.maketrans("UAua", "RRII"))


def cut_edits(edits: str, sizes: list[int]) -> list[str]:
    """The edits of consecutive parts of so many rows; insertions stand with the row behind them, or at the end of the last part."""
    found, at = [], 0
    for k, rows in enumerate(sizes):
        begin = at
        while rows:
            rows -= edits[at] not in "ua"
            at += 1
        found.append(edits[begin:] if k == len(sizes) - 1 else edits[begin:at])
    return found


def solve(conversations: DataFrame) -> DataFrame:
    """signatures() with blank, duplicate, truncated, illegal, cost, audit and `segments`, the edits of each part.

    Conversations are dealt by ranges of signature and conv_id, so a frequent signature is spread; a task walks the trie of its own signatures
    and holds one path of it.
    """

    def run(batches):
        trie, last, told = Trie(), None, None
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows = []
                for signature, sizes in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                    if signature != last:
                        last, told = signature, trie.answer(signature)
                    rows.append((*told[:5], audit_of(told[5]), cut_edits(told[5], sizes)))
                blank, duplicate, truncated, illegal, cost, audit, segments = zip(*rows)
                found = [pa.array(c, pa.int64()) for c in (blank, duplicate, truncated, illegal, cost)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found, pa.array(audit, pa.string()), pa.array(segments, pa.list_(pa.string()))], [*part.schema.names, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "segments"])

    fields = "conv_id long, signature string, parts array<long>, sizes array<int>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, segments array<string>"
    return conversations.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature").mapInArrow(run, fields)


def apply_edits(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, part, at, role, text, edit) of placed rows: kept, reroled and inserted ones, in the order of part and at.

    Each part's edits come in front of its rows in one sorted pass, so a task holds one row and one part's edits.
    """
    edits = solved.select("conv_id", F.explode(F.arrays_zip("parts", "segments")).alias("e")).select("conv_id", F.col("e.parts").alias("part"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("e.segments").alias("text"))
    both = edits.unionByName(ordered.select("conv_id", "part", "place", "role", "text"))
    together = both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")

    def run(batches):
        edits, at, count, ends, conv, part = "", 0, 0, 0, None, None
        for batch in batches:
            out = []

            def put(role, text, edit):
                nonlocal count
                out.append((conv, part, count, role, text, edit))
                count += 1

            for c, p, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if place < 0:
                    conv, part, edits, at, count = c, p, text, 0, 0
                    ends = len(edits.rstrip("ua"))  # behind it are insertions without a row
                    continue
                while edits[at] in "ua":
                    put(ROLES[edits[at]], "", "I")
                    at += 1
                edit = edits[at]
                at += 1
                if edit != "D":
                    put(ROLES.get(edit, role), text, "K" if edit == "K" else "R")
                if at >= ends:
                    for e in edits[at:]:
                        put(ROLES[e], "", "I")
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "part", "at", "role", "text", "edit"])

    return together.mapInArrow(run, "conv_id long, part long, at long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of `role:text` of a conversation's repaired rows, joined by line feeds. A digest can only be computed in order, so a
    conversation's rows stream through one task, which holds one of them."""

    def run(batches):
        now, running = None, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if running is not None and conv != now:
                    yield close()
                    running = None
                if running is None:
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
        if running is not None:
            yield close()

    return repaired.select("conv_id", "role", "text", "part", "at").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conv_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(solved, repaired) of rows(conv_id long, turn long, role, text): solve() for each of conv_ids, and apply_edits().

    Null roles and texts are one space. Rows are taken by turn, null turns first; those of one turn by role and text, and repeated rows all count. Rows with
    a null conv_id are one conversation. A role whose first character is not s, u or a (the empty one too) cannot be kept. Other columns are not read.
    """
    space = F.lit(" ")
    filled = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    ordered = placed(filled)
    solved = written(solve(signatures(written(digits(ordered), "turns-digits"), conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")))), "turns-solved")
    return solved, apply_edits(ordered, solved)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Per conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after damage() and repair()."""
    solved, repaired = repair(damage(conversations), conversations)
    found = _by_conversation(solved.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), digests(repaired))
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
