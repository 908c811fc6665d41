"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from clinicflow.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def in_order(rows):
    """Rows of each conversation by turn, nulls first; equal turns by role, then by the text's hash."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return found


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        end = text.rstrip(" \t\n\v\f\r")
        if not end:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(own, wrong):
    """(cost, audit, repaired rows) by trying all edits, at most two insertions in a row."""

    @cache
    def rest(at, place, inserted):
        ways = [(0, "", ())] if at == len(own) and place in ("", "a") else []

        def offer(letter, cost, after, rows, then=0):
            for more in rest(at + (letter != "I"), after, then):
                ways.append((cost + more[0], letter + more[1], rows + more[2]))

        next_ = WANTED[place]
        if inserted < 2:
            offer("I", 5, next_, (f"{NAMES[next_]}:",), inserted + 1)
        if at < len(own):
            _, role, text = own[at]
            offer("D", 2, place, ())
            if wrong[at] not in ("blank", "duplicate"):
                more = 5 if wrong[at] == "truncated" else 0
                offer("R", 1 + more, next_, (f"{NAMES[next_]}:{text}",))
                if role[:1] == next_ or (place == "" and role[:1] == "s"):
                    offer("K", more, role[:1], (f"{role}:{text}",))
        return [min(ways)] if ways else []

    return rest(0, "", 0)[0]


def expected(rows, ids):
    found, out = in_order(rows), Counter()
    for conv in set(ids):
        own = found.get(conv, [])
        wrong = faults(own)
        cost, audit, kept = cheapest(own, wrong)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[(
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, wrong.count("blank"),
            wrong.count("duplicate"), wrong.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )] += 1
    return out


def drawn(draw, conversations, most):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "User"]
    texts = ["Yes.", "No!", "What? ", "an open end", " \n\t", "", None, "Ends.\x0b", "é…", "\xa0", "漢。", "a.b"]
    rows = []
    for conv in conversations:
        for turn in range(draw.randrange(most)):
            for _ in range(draw.choice([1, 1, 1, 2])):
                kind = draw.random()
                at = None if kind < 0.05 else turn * (2 if kind < 0.1 else 1)
                text = draw.choice(texts) if draw.random() < 0.5 else f"Line {draw.randrange(9)}."
                rows.append((conv, at, ["user", "assistant"][turn % 2] if kind > 0.3 else draw.choice(roles), text))
    return rows


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_best_edits(block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(1500):
        own = [(k, draw.choice(["user", "assistant", "system", "x"]), f"{k}") for k in range(draw.randrange(9))]
        wrong = [draw.choice(["", "", "truncated", "blank"]) for _ in own]
        codes = bytes(
            " sua".index(role[0] if role[0] in "sua" else " ")
            | {"": 0, "truncated": repair.CUT_OFF, "blank": repair.MUST_GO}[w]
            for (_, role, _), w in zip(own, wrong)
        )
        ends = [0 if p in repair.DONE else None for p in repair.PLACES]
        assert repair.best_edits(codes, ends, True)[repair.START] == cheapest(own, wrong)[:2]


def test_conversations(spark):
    rows = drawn(random.Random(1), [None, *range(300)], 9)
    ids = [r[0] for r in rows] + [901, 901, 902]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    named = spark.createDataFrame([(i, 1) for i in ids], "conv_id long, cost int")
    assert Counter(map(tuple, repair.report(table, named).collect())) == expected(rows, ids)
    without = Counter({r[:8]: n for r, n in expected(rows, [r[0] for r in rows]).items()})
    assert Counter(map(tuple, repair.decide(table).collect())) == without


def test_damaged_conversations(spark):
    rows = drawn(random.Random(2), [None, *range(400)], 7)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", kind string, place int")
    harmed = list(damaged(rows))
    assert Counter(map(tuple, repair.damage(table).collect())) == Counter(harmed)
    found = repair.report(repair.damage(table), table).collect()
    assert Counter(map(tuple, found)) == expected(harmed, [r[0] for r in rows])
    gone = Counter(r[0] for r in rows).keys() - {r[0] for r in harmed}
    assert gone and all(r.audit == "" and r.cost == r.gaps == 0 for r in found if r.conv_id in gone)


def test_one_conversation_with_most_rows(spark):
    draw = random.Random(3)
    rows = [(7, t, draw.choice(["user", "assistant", "system"]), f"{t % 700}" + draw.choice([".", ""])) for t in range(900)]
    rows += [(7, 450, "user", "the same.")] * 300 + [(7, t, "user", "again.") for t in range(300)]
    rows += [(k, t, "user", f"{t}.") for k in (3, 11) for t in range(4)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = Counter()
    for conv, own in in_order(rows).items():
        # The search goes one row deep per call, so long conversations are put together here.
        wrong = faults(own)
        codes = bytes(
            " sua".index(r[1][:1]) | {"": 0, "truncated": repair.CUT_OFF}.get(w, repair.MUST_GO)
            for r, w in zip(own, wrong)
        )
        want[(conv, *plain_search(codes))] += 1
    found = repair.decide(table)
    assert Counter((r.conv_id, r.cost, r.audit) for r in found.collect()) == want
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    assert int(parts) > 1
    kept = repair.repaired(table).filter("conv_id = 7").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
    assert [r.place for r in kept] == list(range(len(kept)))


def plain_search(codes):
    """Cost and audit by keeping for each row and place the best way so far."""
    best = {repair.START: (0, "")}

    def inserted(best):
        for _ in range(2):
            found = dict(best)
            for place, (cost, audit) in best.items():
                after = repair.WANTED[place]
                found[after] = min(found.get(after, (10**9,)), (cost + 5, audit + "I"))
            best = found
        return best

    for code in codes:
        found = {}
        for place, (cost, audit) in inserted(best).items():
            for letter, more, after in repair.edits(place, code):
                way = (cost + more, audit + repair.LETTERS[letter])
                found[after] = min(found.get(after, (10**9,)), way)
        best = found
    best = inserted(best)
    return min(best[p] for p in repair.DONE if p in best)


def test_parts_join_like_the_whole():
    draw = random.Random(5)
    for _ in range(400):
        rows = [
            (draw.choice([None, k, k // 2]), draw.randrange(4), draw.random() < 0.1, draw.random() < 0.2,
             draw.random() < 0.1, draw.choice([1, 1, 2]))
            for k in range(draw.randrange(1, 14))
        ]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        results = set()
        for cuts in ([], [1], [3, 4], list(range(1, len(rows)))):
            edges = [0, *[c for c in cuts if c < len(rows)], len(rows)]
            held = []
            for place, (a, b) in enumerate(zip(edges, edges[1:])):
                part = repair.Part(1)
                for row in rows[a:b]:
                    part.add(*row)
                held += [(place, r[2:]) for r in part.rows(place, closed=False)]
            results.add(repair.joined(held))
        assert len(results) == 1


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damage(nothing), nothing).count() == 0
    assert repair.decide(nothing).count() == repair.repaired(nothing).count() == 0


def test_very_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (1, 2, "assistant", " " * 500_000)]
    found = repair.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == expected(rows, [1])
