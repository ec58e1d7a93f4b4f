"""Edits against a plain search that keeps every whole way, and against all ways."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from inkveil.llm.repair import Search, damaged, digested, fault, repaired

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, repaired rows) of (role, text): all whole ways by row and state, none left out."""
    ways = {"": (0, "", [])}  # by initials so far, cut to what matters
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def put_in(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, edits, done) in list(out.items()):
                new = nexts[state]
                way = (cost + 5, edits + "I", [*done, (names[new], "")])
                out[new] = min(out.get(new, way), way)
        return out

    for (role, text), why in zip(rows, faults(rows), strict=True):
        found: dict = {}
        late = 5 if why == "truncated" else 0

        def add(state, way):
            found[state] = min(found.get(state, way), way)

        # Ways with turns put in do not replace those without, as edits go on differently.
        starts = [(state, way) for state, way in ways.items()]
        for _ in range(2):
            starts += [
                (nexts[s], (c + 5, e + "I", [*d, (names[nexts[s]], "")])) for s, (c, e, d) in starts
            ]
        for state, (cost, edits, done) in starts:
            add(state, (cost + 2, edits + "D", done))
            if why in ("", "truncated"):
                new = nexts[state]
                add(new, (cost + 1 + late, edits + "R", [*done, (names[new], text)]))
                if role[:1] == new or (state == "" and role[:1] == "s"):
                    add(role[:1], (cost + late, edits + "K", [*done, (role, text)]))
        ways = found
    return min(put_in(ways)[s] for s in ("", "a") if s in put_in(ways))


def every_way(rows):
    """The same by trying all edits of a few rows."""
    why = faults(rows)
    best = None
    for places in product(range(3), repeat=len(rows) + 1):
        if sum(places) > 4:
            continue
        for edits in product("DKR", repeat=len(rows)):
            for roles in product("ua", repeat=sum(places) + edits.count("R")):
                pick, cost, audit, initials = iter(roles), 0, "", ""
                for n in range(len(rows) + 1):
                    for _ in range(places[n]):
                        initials, audit, cost = initials + next(pick), audit + "I", cost + 5
                    if n == len(rows):
                        break
                    audit += edits[n]
                    if edits[n] == "D":
                        cost += 2
                        continue
                    if why[n] in ("blank", "duplicate"):
                        cost = 10**6
                    cost += (edits[n] == "R") + (5 if why[n] == "truncated" else 0)
                    initials += (rows[n][0][:1] or "-") if edits[n] == "K" else next(pick)
                if GOOD.fullmatch(initials) and cost < 10**6:
                    best = min(best or (cost, audit), (cost, audit))
    return best


def searched(rows):
    search, edits = Search(), []
    for (role, text), why in zip(rows, faults(rows), strict=True):
        edits += search.push(role[:1], why, (role, text))
    cost, last = search.finish()
    edits += last
    return cost, "".join(e for e, _ in edits)


def some_rows(rng, n):
    roles = rng.choice([["user", "assistant", "system"], ["user"], ["assistant", "user"], ["system", "tool", "user", ""]])
    texts = ["a.", "b!", "c? ", "open", "", " \t", *[f"t{i}." for i in range(20)]]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = some_rows(rng, rng.randrange(4))
        assert searched(rows) == every_way(rows), rows


def test_search_against_whole_ways():
    rng = random.Random(6)
    for _ in range(1500):
        rows = some_rows(rng, rng.randrange(14))
        assert searched(rows) == cheapest(rows)[:2], rows


def open_nodes(search):
    def below(node):
        return 1 + sum(map(below, node.children))

    return below(search.root)


def test_memory_follows_what_is_open():
    search, most = Search(), 0
    for i in range(20_000):
        list(search.push("ua"[i % 2], "" if i % 7 else "truncated", (i,)))
        most = max(most, open_nodes(search)) if i % 50 == 0 else most
    assert most < 40


def test_long_open_ways_take_linear_time():
    """Users only: which row to drop is open to the end."""
    search = Search()
    for i in range(30_001):
        list(search.push("u", "", (i,)))
    cost, last = search.finish()
    assert cost == 15_002 and "".join(e for e, _ in last) == "D" + "KR" * 15_000


def plain(rows):
    """The query's columns from (conv_id, turn, role, text)."""
    out = []
    for conv_id in {r[0] for r in rows}:
        left = []
        for own, turn, role, text in rows:
            if own != conv_id:
                continue
            key = f"{' ' if own is None else own}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            left += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [r[1:] for r in left]
        cost, audit, done = cheapest(pairs)
        why = faults(pairs)
        turns = [r[0] for r in left if r[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        text = "\n".join(f"{role}:{text}" for role, text in done)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv_id, gaps, *(why.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark):
    rng = random.Random(8)
    rows = []
    for conv_id in [None, -5, *range(120)]:
        for _ in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "User", "", None, "uhu"])
            rows.append((conv_id, rng.choice([None, *range(9)]), role, rng.choice(["x.", "y", None, "", "Wie? ", "é!"])))
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for column in ("gone.1", "again", "edit", "copy", "kind"):
        df = df.withColumn(column, F.lit(7))
    got = digested(repaired(damaged(df)))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert digested(repaired(damaged(df.limit(0)))).count() == 0


def test_edits_are_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "Well."), (3, 0, "user", "")]
    found = [tuple(r)[:2] + (r.text, r.new_role, r.cost) for r in repaired(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(r for r in found if r[0] == 1) == sorted([(1, "K", "Be kind.", "system", 0), (1, "K", "Hi.", "user", 0), (1, "D", "Hi.", None, 2), (1, "K", "Yes.", "assistant", 0)])
    assert [r for r in found if r[0] == 2] == [(2, "D", "Well.", None, 2)]
    assert [r for r in found if r[0] == 3] == [(3, "D", "", None, 2)]


@pytest.mark.parametrize("n", [1, 3000])
def test_one_long_conversation(spark, n):
    rows = [(7, i, ["user", "assistant"][i % 2], f"Text {i} " + "long " * 30 + ".") for i in range(n)]
    got = digested(repaired(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    assert [len(r.audit) for r in got] == [n] and got[0].cost == (2 if n == 1 else 0)
