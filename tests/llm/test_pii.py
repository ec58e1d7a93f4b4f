"""Base spans against the patterns as specified; discovery by context."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from inkveil.llm.pii import DIGITS, KINDS, LENGTH, PLAIN, ROUNDS, SEEDS, SURE, private_data_of_documents, scanned

DATA = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS[:4]) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0]))


def base(row):
    return [tuple(s) for s in row.spans if s.kind < 4]


def test_fuzz(spark):
    draw = random.Random(6)
    parts = ["a", "b.", "@", "x-y", "..", ".com", "1", "23", "255", "256", ".", "0", "+", "+1", " ", "-", "(555)", "4111 1111 1111 1111", "é", "\n", "_", "%",
             "10.0.0.1", "+44 20 7946 0958", "me@site.org", "00010.1.2.3", "4111-1111-1111-1112", "😀"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(16))) for _ in range(2500)]
    rows = scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = private_data_of_documents(spark, DATA).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 10
    for r in rows:
        spans = plain(texts[r.doc_id])
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_unseen_identifiers_are_discovered(spark):
    draw = random.Random(7)
    rows = [(i, f"please write to member: u{i}x@mail.example.org soon or the office 12 times") for i in range(20)]
    rows += [(100 + i, f"please write to member: Q{draw.randrange(10**7)}-Z soon or the office 77 times") for i in range(8)]
    rows += [(200 + i, f"room {i}2345 is open, the number the sum the row the 998{i} yes") for i in range(20)]
    got = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i in range(100, 108):
        found = [texts[i][s.start : s.end] for s in got[i].spans]
        assert len(found) == 1 and found[0].startswith("Q") and found[0].endswith("-Z")
    assert all(s.kind == 0 for i in range(20) for s in got[i].spans)
    assert all(not got[i].spans for i in range(200, 220))


def test_long_and_odd_texts(spark):
    dots = "ab." * 100_000 + "com"
    cases = [(dots, []), ("x@" + dots, [(0, 0, len(dots) + 2)]), ("a" * 500_000, []), ("1" * 300_000, []), ("x@a.b" + "..c" * 50_000, [(0, 0, 5)])]
    cases += [(t, plain(t)) for t in ("1.1.1.1 " * 20_000, "+1 " + "(" * 200_000, "a@" * 100_000, "1.2." * 50_000, "", None)]
    rows = [(i, t, "x", 3) for i, (t, _) in enumerate(cases)] + [(None, "me@site.org", "x", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, uid int")
    got = scanned(docs).collect()
    for r in got:
        assert base(r) == (cases[r.doc_id][1] if r.doc_id is not None else [(0, 0, 11)])
    assert len(got) == len(rows)
    assert scanned(docs.filter("doc_id < 0")).count() == 0


def discovered_in(spark, rows):
    texts = dict(rows)
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 4] for r in got}


MEMBERS = [(i, f"please write to member: u{i}x@mail.example.org soon") for i in range(20)]


def test_discovery_goes_on_behind_discovered_identifiers(spark):
    known = [f"Q77{i:03}-Z" for i in range(12)]
    rows = MEMBERS + [(100 + i, f"please write to member: {q} soon") for i, q in enumerate(known)]
    rows += [(200 + i, f"our account {q} here") for i, q in enumerate(known)]
    rows += [(300 + i, f"our account Q99{i:03}-Z here") for i in range(4)]
    got = discovered_in(spark, rows)
    assert all(got[100 + i] == got[200 + i] == [q] for i, q in enumerate(known))
    assert all(got[300 + i] == [f"Q99{i:03}-Z"] for i in range(4))


def test_occurrences_count_in_all_documents(spark):
    rows = MEMBERS + [(100 + i, f"please write to member: Q77{i:03}-Z soon") for i in range(8)]
    assert all(discovered_in(spark, rows)[100 + i] for i in range(8))
    rows += [(200 + i, "every member: of the club") for i in range(200)]
    assert not any(discovered_in(spark, rows).values())


def test_a_pattern_does_not_vouch_for_itself(spark):
    rows = [(i, "please write to member: me@mail.example.org soon") for i in range(50)]
    rows += [(100 + i, f"please write to member: Q77{i:03}-Z soon") for i in range(40)]
    assert not any(discovered_in(spark, rows).values())


def plain_discovery(rows):
    """The bootstrapping as loops over lists: (doc_id, start, end) of what is discovered."""
    words, totals = [], Counter()
    for doc_id, text in rows:
        spans, before, end = plain(text), "", 0
        totals.update(text.lower().split())
        for m in re.finditer(r"\S+", text, re.A):
            if not re.search("[0-9@]", m[0]):
                continue
            gap = text[end : m.start()].split()
            before, end = gap[-1].lower() if gap else "", m.end()
            core = re.sub(r"^[\"'(\[<{]+|[\"')\]>},;:.!?]+$", "", m[0])
            lead = len(m[0]) - len(re.sub(r"^[\"'(\[<{]+", "", m[0]))
            if core:
                a, b = m.start() + lead, m.start() + lead + len(core)
                words.append((doc_id, a, b, core, before, any(s < b and a < e for s, _, e in spans)))
    edges, seeds = defaultdict(lambda: [0, False]), set()
    for _, _, _, core, before, seed in words:
        if before:
            edge = edges[before, core]
            edge[0], edge[1] = edge[0] + 1, edge[1] or seed
            if seed:
                seeds.add(core)
    score = dict.fromkeys(seeds, 1.0)
    confidence = {}
    for _ in range(ROUNDS):
        believed = defaultdict(float)
        for (pattern, core), (n, _) in edges.items():
            if core in score:
                believed[pattern] += n * score[core]
        confidence = {p: min(1.0, b / totals[p]) for p, b in believed.items()}
        doubts = defaultdict(float)
        for pattern, core in edges:
            if pattern in confidence:
                doubts[core] += math.log(max(1e-9, 1 - confidence[pattern]))
        score = {c: 1.0 if c in seeds else 1 - math.exp(d) for c, d in doubts.items()}
    known = Counter()
    for pattern, core in edges:
        if pattern in confidence:
            others = doubts[core] - math.log(max(1e-9, 1 - confidence[pattern]))
            known[pattern] += core in seeds or 1 - math.exp(others) >= SURE
    sure = {p for p, c in confidence.items() if c >= SURE and known[p] >= SEEDS}
    likely = re.compile(rf"(.*[0-9]){{{DIGITS}}}|.*@", re.S)
    return sorted((d, a, b) for d, a, b, core, before, seed in words if not seed and before in sure and likely.match(core) and len(core) >= LENGTH)


def test_discovery_against_loops(spark):
    draw = random.Random(12)
    contexts = ["mail", "Mail", "to", "id:", "ref", "x" * 70, "number", "(see", "é"]
    known = [f"u{i}@site.org" for i in range(8)] + [f"+49 30 1234{i:04}" for i in range(6)] + [f"AB-{i:05}" for i in range(20)] + ["77", "a1", "9" * 5]
    rows = []
    for i in range(400):
        part = [f"{draw.choice(contexts[:4] if j % 2 else contexts)}{draw.choice([' ', '  ', chr(10), ' ' * 90])}{draw.choice(known[:14] if i % 2 else known)}{draw.choice(['', ',', ').'])}" for j in range(draw.randrange(5))]
        rows.append((i, " and ".join(part)))
    got = sorted((r.doc_id, s.start, s.end) for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s.kind == 4)
    want = plain_discovery(rows)
    assert got == want and len(want) > 50


def test_patterns_are_whole_words(spark):
    for word, blanks in (("x" * 70 + ":", " "), ("member:", " " * 70)):
        rows = [(i, f"write to {word}{blanks}u{i}x@mail.example.org soon") for i in range(20)]
        rows += [(100 + i, f"write to {word}{blanks}Q77{i:03}-Z soon") for i in range(5)]
        assert all(discovered_in(spark, rows)[100 + i] == [f"Q77{i:03}-Z"] for i in range(5))


def test_many_words_in_one_text_take_linear_time(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"a{i} b" for i in range(n)) + " me@site.org")], "doc_id long, text string")
        start = time.perf_counter()
        assert [len(r.spans) for r in scanned(docs).collect()] == [1]
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(500_000) < 60
