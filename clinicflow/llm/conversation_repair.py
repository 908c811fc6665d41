"""Repair of conversations: the cheapest edits that give the role pattern (s?(ua)+)?.

Rows of a conversation are the layers of a graph whose nodes are the places in the pattern; an
edge is an edit, and a path is a repair. A path's weight is one whole number: its high part is
the cost, its low part the edits' letters as digits, the first one highest, with zeros after
the last. So the least number is the cheapest repair and among those the least in letters, and
the ordinary shortest-path recursion from the last row to the first decides everything: putting
a letter in front shifts the digits by one place.

Numbers stay short, because rows are taken BLOCK at a time: all ways through a block end with the
edit of its last row, so none is the beginning of another, and what follows counts by cost only.
For the same reason a conversation can be cut anywhere: for each place before a part, and each one
after it, the part has one best way, and these are put together like the blocks. Rows are cut
by a range partitioning, so that a conversation with a third of all rows is many parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows whose weights are computed as whole numbers of one width.
BLOCK = 64
# Costs, white space, how a text ends.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
CLOSING = (".", "!", "?")

# Digits of letters, in the order of the letters; 0 stands after the last one.
LETTERS = " DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3

# Places in the pattern: nothing yet, after a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
DONE = (START, ASSISTANT)
# The place after the role that the pattern wants next, and that role.
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")

# A row as one number: its role's initial (0 for others), whether it must go, whether it is truncated.
INITIALS = " sua"
MUST_GO, CUT_OFF = 4, 8


def edits(place: int, code: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next place) of all that can be done with a row."""
    out = [(D, DELETE, place)]
    if not code & MUST_GO:
        extra = TRUNCATED if code & CUT_OFF else 0
        out.append((R, REROLE + extra, WANTED[place]))
        after = code & 3
        if after == WANTED[place] or (place, after) == (START, SYSTEM):
            out.append((K, extra, after))
    return out


EDITS = [[edits(place, code) for place in PLACES] for code in range(16)]


def replay(place: int, audit: str, codes: bytes) -> int:
    """Where edits lead."""
    at = 0
    for letter in audit:
        if letter == "K":
            place = codes[at] & 3
        elif letter != "D":
            place = WANTED[place]
        at += letter != "I"
    return place


def _block(codes: bytes, ends: list[int | None], last: bool) -> list[tuple[int, str] | None]:
    """For each place before some rows, the cost and letters of the best way to the end.

    `ends` is what each place after them still costs, None where a way must not end. Rows may be
    inserted before each row, and after the last one where nothing follows.
    """
    # At most two insertions can stand side by side: a third comes back to a place passed before.
    width = BITS * (len(codes) + 2 * (len(codes) + 1))
    top, mask = width - BITS, (1 << width) - 1

    def ahead(letter: int, cost: int, weight: int) -> int:
        low = weight & mask
        return weight - low + (cost << width) + (letter << top) + (low >> BITS)

    def with_insertions(best: list[int | None]) -> list[int | None]:
        found = best
        for _ in range(2):
            longer = [None if found[q] is None else ahead(I, INSERT, found[q]) for q in WANTED]
            found = [
                min((w for w in pair if w is not None), default=None) for pair in zip(best, longer, strict=True)
            ]
        return found

    best = [None if cost is None else cost << width for cost in ends]
    if last:
        best = with_insertions(best)
    for code in reversed(codes):
        ways = [
            [ahead(letter, cost, best[after]) for letter, cost, after in EDITS[code][place] if best[after] is not None]
            for place in PLACES
        ]
        best = with_insertions([min(w, default=None) for w in ways])

    def told(weight: int) -> tuple[int, str]:
        digits = format(weight & mask, "o").zfill(width // BITS).rstrip("0")
        return weight >> width, "".join(LETTERS[int(d)] for d in digits)

    return [None if weight is None else told(weight) for weight in best]


def best_edits(codes: bytes, ends: list[int | None], last: bool) -> list[tuple[int, str] | None]:
    """As `_block`, for any number of rows."""
    # At least one block, as rows can be inserted where there are none.
    cuts = list(range(0, len(codes), BLOCK)) or [0]
    solved = []
    for at in reversed(cuts):
        solved.append(_block(codes[at : at + BLOCK], ends, last and at == cuts[-1]))
        ends = [None if way is None else way[0] for way in solved[-1]]
    solved.reverse()

    def whole(place: int) -> str:
        audit = []
        for at, ways in zip(cuts, solved, strict=True):
            audit.append(ways[place][1])
            place = replay(place, audit[-1], codes[at : at + BLOCK])
        return "".join(audit)

    return [None if cost is None else (cost, whole(place)) for place, cost in enumerate(ends)]


@dataclass
class Part:
    """Consecutive rows of one conversation inside a partition."""

    key: object
    codes: bytearray = field(default_factory=bytearray)
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, turn: int | None, initial: int, blank: bool, cut_off: bool, later: bool, copies: int) -> None:
        """`copies` equal rows; `later` if a turn before has the same row."""
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if self.codes:
            self.illegal += illegal(self.codes[-1], initial)
        self.illegal += copies - 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not later)
            self.truncated += cut_off and not later
        alone = initial | (MUST_GO if blank or later else CUT_OFF if cut_off else 0)
        self.codes.append(alone)
        self.codes += bytes([initial | MUST_GO]) * (copies - 1)

    def rows(self, place: int, closed: bool) -> Iterator[tuple]:
        """The best ways through the part: to the end, or to each place where more can follow."""
        facts = (
            self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated,
            self.illegal, self.codes[0] & 3, self.codes[-1] & 3,
        )
        codes = bytes(self.codes)
        goals = [(None, [0 if p in DONE else None for p in PLACES])]
        if not closed:
            goals += [(q, [0 if p == q else None for p in PLACES]) for q in PLACES]
        for after, ends in goals:
            ways = best_edits(codes, ends, after is None)
            costs, audits = zip(*[way or (None, None) for way in ways])
            yield (self.key, place, after, list(costs), list(audits), *facts)


def illegal(one: int, two: int) -> bool:
    """Whether two rows' initials may not be neighbours."""
    return (one & 3, two & 3) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def joined(parts: list[tuple[int | None, tuple]]) -> tuple:
    """The report of a conversation from its parts, given in order, each as several ways."""
    ways: list[dict[int | None, tuple]] = []
    facts: list[tuple] = []
    places: list[int] = []
    for place, (after, costs, audits, *told) in parts:
        if not places or places[-1] != place:
            places.append(place)
            ways.append({})
            facts.append(tuple(told))
        ways[-1][after] = costs, audits
    # best[p]: what the rest costs from place p, and where its first part leads.
    costs, audits = ways[-1][None]
    best: list[int | None] = list(costs)
    chosen = [[None] * 4]
    for found in reversed(ways[:-1]):
        now, led = [], []
        for p in PLACES:
            options = [
                (found[q][0][p] + best[q], found[q][1][p], q)
                for q in PLACES
                if found[q][0][p] is not None and best[q] is not None
            ]
            cost, _, q = min(options, default=(None, None, None))
            now.append(cost)
            led.append(q)
        best = now
        chosen.append(led)
    chosen.reverse()
    place, letters = START, []
    for found, led in zip(ways, chosen, strict=True):
        after = led[place]
        letters.append(found[after][1][place])
        place = after if after is not None else place
    turns = blank = duplicate = truncated = wrong = 0
    low = high = before = None
    for first, last, distinct, *counts, one, two in facts:
        if first is not None:
            turns += distinct - (first == high)
            low, high = (first if low is None else low), last
        blank, duplicate, truncated = blank + counts[0], duplicate + counts[1], truncated + counts[2]
        wrong += counts[3] + (before is not None and illegal(before, one))
        before = two
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, blank, duplicate, truncated, wrong, best[START], "".join(letters)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of closing marks, repeated, or given to the user.

    What happens to a row depends on crc32 of `conv_id:turn`. Nulls count as one space, in the key
    as in role and text; turn and conv_id stay null.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (
        conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.translate("text", "".join(CLOSING), ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("col")
    )


def _same(one: str, two: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{one}.{n}").eqNullSafe(F.col(f"{two}.{n}")) for n in names])


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one, with what is needed to repair, without texts."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = reduce(lambda found, k: found.when(initial == INITIALS[k], k), range(1, 4), F.when(F.lit(False), 0))
    keys = ["conv_id", "turn", "role", "digest"]
    counted = (
        rows.select(
            *keys,
            code.otherwise(0).alias("initial"),
            (end == "").alias("blank"),
            (~F.substring(end, -1, 1).isin(*CLOSING)).alias("cut_off"),
        )
        .groupBy(*keys, "initial", "blank", "cut_off")
        .agg(F.count("*").alias("copies"))
    )
    alike = ["conv_id", "role", "digest"]
    first = counted.groupBy(*alike).agg(F.min(F.struct("turn")).alias("first"))
    later = F.struct(F.col("r.turn")) > F.col("f.first")
    return counted.alias("r").join(first.alias("f"), _same("r", "f", alike)).select("r.*", later.alias("later"))


def _prepared(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def decide(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that repair it.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows stand in the
    order of turn, nulls first; equal turns by role, then by the text's hash. Null roles and
    texts count as one space; a null conv_id is a conversation of its own. A blank text has only
    white space; a duplicate has role and text of an earlier row; a truncated one does not end
    with a closing mark. Conversations without rows are not in the result, so no rows give none.
    """
    return _decided(_prepared(rows))


def _decided(prepared: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "role", "digest"]
    faults = _faults(prepared)
    key = faults.schema["conv_id"]
    counts = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "one", "two")
    parts = T.StructType(
        [
            key,
            T.StructField("place", T.LongType()),
            T.StructField("after", T.LongType()),
            T.StructField("costs", T.ArrayType(T.LongType())),
            T.StructField("audits", T.ArrayType(T.StringType())),
            *(T.StructField(n, T.LongType()) for n in counts),
        ]
    )
    arrow = to_arrow_schema(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = place = None
        for batch in batches:
            out: list[tuple] = []
            names = ("conv_id", "turn", "initial", "blank", "cut_off", "later", "copies", "place")
            for key_, *row, here in zip(*(batch.column(n).to_pylist() for n in names)):
                place = here
                if part is None or part.key != key_:
                    if part is not None:
                        # Only the last conversation of a partition can go on in the next.
                        out += part.rows(place, closed=True)
                    part = Part(key_)
                part.add(*row)
            yield _batch(out, arrow)
        if part is not None:
            yield _batch(list(part.rows(place, closed=False)), arrow)

    ordered = (
        faults.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.spark_partition_id().cast("bigint"))
    )
    told = T.StructType(
        [key, *(T.StructField(n, T.LongType()) for n in REPORT[:-1]), T.StructField("audit", T.StringType())]
    )
    told_arrow = to_arrow_schema(told)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for key_, place, *rest in zip(*(column.to_pylist() for column in batch.columns)):
                if held and key_ != current:
                    out.append((current, *joined(held)))
                    held = []
                current = key_
                held.append((place, tuple(rest)))
            yield _batch(out, told_arrow)
        if held:
            yield _batch([(current, *joined(held))], told_arrow)

    return (
        ordered.mapInArrow(cut, parts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "after")
        .mapInArrow(join, told)
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _walked(prepared: DataFrame, decided: DataFrame, make: Callable, schema: T.StructType) -> DataFrame:
    """What `make()` gives for each conversation's report and repaired rows, streamed in order.

    `make()` has open(report), row(role, text, letter) and close(), each of which gives result rows.
    """
    opened = decided.select("conv_id", *REPORT, F.lit(0).alias("kind"))
    both = opened.unionByName(prepared.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taker, audit, at, place = None, "", 0, START

        def inserted() -> Iterator[tuple]:
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                yield from taker.row(ROLES[place], "", "I")
                at, place = at + 1, WANTED[place]

        for batch in batches:
            out: list[tuple] = []
            kinds, roles = batch.column("kind").to_pylist(), batch.column("role").to_pylist()
            texts = batch.column("text")
            for k, kind in enumerate(kinds):
                if kind == 0:
                    if taker is not None:
                        out += [*inserted(), *taker.close()]
                    report = tuple(batch.column(n)[k].as_py() for n in ("conv_id", *REPORT))
                    taker, audit, at, place = make(), report[-1] or "", 0, START
                    out += taker.open(report)
                    continue
                out += inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    place = INITIALS.index(roles[k][:1])
                    out += taker.row(roles[k], texts[k].as_py(), letter)
                elif letter == "R":
                    out += taker.row(ROLES[place], texts[k].as_py(), letter)
                    place = WANTED[place]
            yield _batch(out, arrow)
        if taker is not None:
            yield _batch([*inserted(), *taker.close()], arrow)

    return stream.mapInArrow(run, schema)


class Hashed:
    """The report with the hash of the repaired rows, joined by newlines."""

    def open(self, report: tuple) -> list[tuple]:
        self.report, self.hash, self.begun = report, hashlib.sha256(), False
        return []

    def row(self, role: str, text: str, letter: str) -> list[tuple]:
        self.hash.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun = True
        return []

    def close(self) -> list[tuple]:
        return [(*self.report, self.hash.hexdigest())]


class Rows:
    """The repaired rows with their place and the edit that made them."""

    def open(self, report: tuple) -> list[tuple]:
        self.key, self.place = report[0], 0
        return []

    def row(self, role: str, text: str, letter: str) -> list[tuple]:
        self.place += 1
        return [(self.key, self.place - 1, role, text, letter)]

    def close(self) -> list[tuple]:
        return []


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, role, text, and edit (K, R or I).

    Conversations whose rows all go are not in the result. See `decide` for odd input.
    """
    prepared = _prepared(rows)
    schema = T.StructType(
        [
            prepared.schema["conv_id"],
            T.StructField("place", T.LongType()),
            *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit")),
        ]
    )
    return _walked(prepared, _decided(prepared), Rows, schema)


def report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """What `decide` says, and `repaired_sha256` of the repaired `role:text` rows, joined by newlines.

    Given `conversations` (conv_id, repeated or not), each of them has a row: without rows of its
    own zeros, an empty audit, and the hash of an empty text. The hash takes a conversation's texts
    one after the other, so they pass one task, which keeps none of them.
    """
    prepared = _prepared(rows)
    decided = _decided(prepared)
    if conversations is not None:
        ids = conversations.select("conv_id").distinct()
        known = [F.coalesce(F.col(f"d.{n}"), F.lit("" if n == "audit" else 0)).alias(n) for n in REPORT]
        decided = ids.alias("c").join(decided.alias("d"), _same("c", "d", ["conv_id"]), "left").select("c.conv_id", *known)
    schema = T.StructType([*decided.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    return _walked(prepared, decided, Hashed, schema)
