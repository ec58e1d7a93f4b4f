"""Round trips, spans, and templates that behave in other ways."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.llm.formatting import (
    CLOSE,
    FORGED_TEXT,
    MARKED,
    OPEN,
    Template,
    _pieces,
    escaped,
    escaped_role,
    formats_of_conversations,
    formatted,
    in_common,
    marked_turns,
    read_back,
    turns_of,
    unescaped,
    unescaped_role,
)

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = st.text(st.sampled_from("<|\\\np>im_end ab\n"), max_size=30) | st.sampled_from([OPEN, CLOSE, FORGED_TEXT, "<\\|im_end|>", "<", "\\", "<\\", "|im_end|>\n"])


def pieces(turns, template):
    return list(_pieces(template)(iter([(1, i, role, text) for i, (role, text) in enumerate(turns)])))


def whole(rows):
    out = ""
    for _, _, _, stands, piece, *_ in rows:
        out = out[:stands] + piece
    return out


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_escapes(text):
    assert unescaped(escaped(text)) == text and "<|" not in escaped(text)
    assert unescaped_role(escaped_role(text)) == text and "\n" not in escaped_role(text) and "|" not in escaped_role(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=6), st.integers(1, 9))
def test_round_trip(turns, step):
    rows = pieces(turns, MARKED)
    text = whole(rows)
    assert text == marked_turns(turns)
    assert list(turns_of(text[i : i + step] for i in range(0, len(text), step))) == turns
    for (_, piece_text), (*_, start, end, rewrites) in zip(turns, rows, strict=True):
        assert unescaped(text[start:end]) == piece_text and not rewrites
    assert rows == pieces(turns, Template(marked_turns))


@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_in_common(a, b):
    n = in_common(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


TURNS = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]


def test_closing_text_may_move():
    rows = pieces(TURNS, Template(lambda turns: "<s>" + "".join(f"[{r}]{t}" for r, t in turns) + "</s>"))
    assert whole(rows) == "<s>[user]one[assistant]two[user]three[assistant]four</s>"
    assert not any(r[-1] for r in rows)
    assert [whole(rows)[r[5] : r[6]] for r in rows] == ["one", "two", "three", "four"]


def test_rewritten_history_is_told():
    def last_answer_only(turns):
        """Answers before the last turn are cut."""
        return "".join(f"[{r}]{t if r == 'user' or i == len(turns) - 1 else ''};" for i, (r, t) in enumerate(turns))

    rows = pieces(TURNS, Template(last_answer_only))
    assert [r[-1] for r in rows] == [False, False, True, False]
    assert whole(rows) == last_answer_only(TURNS)


def test_texts_that_are_not_there_once():
    rows = pieces(TURNS, Template(lambda turns: "".join(f"{r}: {t} ({t})\n" for r, t in turns)))
    assert all(r[5] is None and r[6] is None for r in rows)
    rows = pieces(TURNS, Template(lambda turns: "".join(f"{r}\n" for r, _ in turns)))
    assert all(r[5] is None for r in rows)


def numbered(turns):
    """A turn's piece depends on the role before it."""
    return "".join(("" if i == 0 else "~" if turns[i - 1][0] == r else "-") + f"{r}:{t}\n" for i, (r, t) in enumerate(turns))


def test_reach():
    turns = [("user" if i % 3 else "assistant", f"t{i}") for i in range(40)]
    assert pieces(turns, Template(numbered, 1)) == pieces(turns, Template(numbered)) == pieces(turns, Template(numbered, 7))
    with pytest.raises(ValueError, match="further than 0"):
        pieces(turns, Template(numbered, 0))
    counted = Template(lambda turns: "".join(f"{i} {t}\n" for i, (_, t) in enumerate(turns)), 2)
    with pytest.raises(ValueError, match="further than 2"):
        pieces(turns, counted)


def test_prefixes_are_rendered_whole():
    turns = [("user" if i % 2 else "assistant", f"t{i}" + "\ufdd0" * (i == 3)) for i in range(60)]

    def late(turns):
        """Counts from the twentieth turn on, and closes the last one."""
        return "".join(f"{i if i >= 20 else ''}[{r}]{t}\n" for i, (r, t) in enumerate(turns)) + "</s>"

    seen = []
    rows = pieces(turns, Template(lambda t: seen.append(len(t)) or late(t), 0))
    assert whole(rows) == late(turns) and rows == pieces(turns, Template(late))
    assert set(seen) >= set(range(1, 61))
    assert [whole(rows)[r[5] : r[6]] for r in rows] == [t for _, t in turns]


def test_beginnings_move_out_of_reach_only(monkeypatch):
    turns = [("user" if i % 3 else "assistant", f"t{i} " * 9) for i in range(300)]
    assert pieces(turns, Template(numbered, 1)) == pieces(turns, Template(numbered, 100)) == pieces(turns, Template(numbered))
    late = Template(lambda turns: "".join(f"{i if i > 20 else ''}{t}\n" for i, (_, t) in enumerate(turns)), 2)
    with pytest.raises(ValueError, match="further than 2"):
        pieces(turns, late)
    monkeypatch.setattr("inkveil.llm.formatting.WHOLE_CHARS", 100)
    assert pieces(turns, Template(numbered, 1)) == pieces(turns, Template(numbered)) and pieces(turns, MARKED) == pieces(turns, Template(marked_turns))


def test_long_conversations_take_linear_time():
    def seconds(n):
        start = time.perf_counter()
        for _ in _pieces(MARKED)((1, i, "user", "some text " * 20) for i in range(n)):
            pass
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(40_000) < 12 * seconds(10_000) + 0.5


def plain(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        own = [(turn, role or "", text or "") for c, turn, role, text in rows if c == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        loss = "".join(t for _, r, t in own if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for _, r, t in own)
        chars = len(marked_turns([r[1:] for r in own]))
        out.append((conv_id, len(own), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rng = random.Random(2)
    texts = [None, "", "a", OPEN + "x" + CLOSE, "é <|", "\\<\\|", "long " * 4000, FORGED_TEXT]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(8)]), rng.choice(["user", "assistant", None, "a|b\n\\"]), rng.choice(texts)) for _ in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for column in ("piece", "stands", "place", "a.b"):
        df = df.withColumn(column, F.lit(1))
    assert sorted(map(tuple, read_back(formatted(df)).collect()), key=str) == plain(rows)
    assert read_back(formatted(df.limit(0))).count() == 0


def test_empty_table_has_the_forged_conversation(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = formats_of_conversations(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-1, 2, len(FORGED_TEXT))]
    assert rows[0].loss_sha256 == hashlib.sha256(FORGED_TEXT.encode()).hexdigest()
