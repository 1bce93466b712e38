import hashlib
import random
import re
import zlib

import pytest

from tagweave.llm.conversation_repair import cheapest, damaged, repaired, report

NEXT, STEP = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(shape):
    """Best rest of the rows for each state, from the last row to the first."""

    def with_inserts(b):
        for _ in range(3):
            b = [min(b[q], (b[NEXT[q]][0] + 5, "I" + b[NEXT[q]][1])) for q in range(4)]
        return b

    best = with_inserts([(0, "") if q in (0, 3) else (10**9, "~") for q in range(4)])
    for row in reversed(shape):
        new = []
        for q in range(4):
            choices = [(best[q][0] + 2, "D" + best[q][1])]
            if row != "#":
                more = 5 if row.isupper() else 0
                if (q, row.lower()) in STEP:
                    c, a = best[STEP[q, row.lower()]]
                    choices.append((c + more, "K" + a))
                c, a = best[NEXT[q]]
                choices.append((c + 1 + more, "R" + a))
            new.append(min(choices))
        best = with_inserts(new)
    return best[0]


def test_search_finds_the_least_of_the_cheapest():
    rnd = random.Random(5)
    for _ in range(4000):
        shape = "".join(rnd.choice("suaxSUAX#ua") for _ in range(rnd.randint(0, 12)))
        assert cheapest(shape) == brute(shape), shape
    long = "".join(rnd.choice("suaUA#uauaua") for _ in range(30_000))
    assert cheapest(long) == brute(long)


def plain(rows):
    """One conversation's report and repaired turns by loops; rows are (turn, role, text) in order."""
    seen, shape, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            n[fault] += 1
        shape += "#" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = brute(shape)
    left, state, turns = list(rows), 0, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            turns.append(("user" if state == 2 else "assistant", ""))
            continue
        _, role, text = left.pop(0)
        if letter == "K":
            state = STEP[state, role[:1]]
            turns.append((role, text))
        elif letter == "R":
            state = NEXT[state]
            turns.append(("user" if state == 2 else "assistant", text))
    assert not left and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in turns))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest), turns


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (0, 1, 1, 2, 1)[kind] if kind < 5 else [(turn, role, text)])
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [
        (conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "tool", "", None]), f"text {rnd.randint(0, 3)}" + rnd.choice(".!? x"))
        for conv in range(60) for turn in range(0, rnd.randint(1, 9) * 2, rnd.choice([1, 2]))
    ]
    out += [(None, 0, "user", "no id."), (None, None, "assistant", None), (900, None, "user", " ."), (901, 5, "user", "é 日本?\n")]
    # One conversation has a third of all rows.
    return out + [(500, i, ("user", "assistant")[i % 2], f"{i} said.") for i in range(len(out) // 2)]


SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, audit STRING, h1 INT"


def test_reports_against_plain_loops(spark, rows):
    given = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA).repartition(7)
    want = {c: plain(v) for c, v in damage(rows).items()}
    got = report(damaged(given)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]][0], r
    turns = {}
    for r in repaired(damaged(given)).orderBy("conv_id", "pos").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: t for c, (_, t) in want.items() if t}


def test_nothing_left_and_nothing_given(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = report(damaged(spark.createDataFrame([(gone, 0, "user", "x.", "", 1)], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert report(damaged(empty)).collect() == [] and repaired(damaged(empty)).collect() == []


def test_undamaged_rows_are_repaired_too(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "user", "And?"), (1, 2, "assistant", "A.")]
    got = repaired(spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")).collect()
    assert [(r["role"], r["text"], r["edit"]) for r in got] == [("user", "And?", "K"), ("assistant", "A.", "K")]
