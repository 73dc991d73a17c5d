"""Repair of conversations against a plain search over edits, and the query against planted damage."""

import random
import zlib

import pytest

from relaynote.llm import conversations

WHITE = " \t\n\x0b\x0c\r"


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        out.append("b" if not text.strip(WHITE) else "d" if (role, text) in seen else "t" if text.rstrip(WHITE)[-1] not in ".!?" else ".")
        seen.add((role, text))
    return out


def with_inserts(paths):
    """Paths (cost, audit, lines) by place, with up to three inserted turns."""
    out, newest = {p: list(v) for p, v in paths.items()}, paths
    for _ in range(3):
        following = {}
        for place, found in newest.items():
            role = "assistant" if place == "user" else "user"
            following.setdefault(role, []).extend((c + 2, a + "I", (*lines, f"{role}:")) for c, a, lines in found)
        for place, found in following.items():
            out.setdefault(place, []).extend(found)
        newest = following
    return out


def cheapest(turns, marks):
    """The cheapest edits, the ASCII-least of them: all paths within two of the least cost of their place are followed."""
    paths = {"start": [(0, "", ())]}
    for (_, role, text), mark in zip(turns, marks):
        found = {}
        for place, several in with_inserts(paths).items():
            for c, a, lines in several:
                found.setdefault(place, []).append((c + 3, a + "D", lines))
                if mark in "bd":
                    continue
                extra, to = mark == "t", "assistant" if place == "user" else "user"
                found.setdefault(to, []).append((c + 2 + extra, a + "R", (*lines, f"{to}:{text}")))
                if role[:1] == to[0]:
                    found.setdefault(to, []).append((c + extra, a + "K", (*lines, f"{role}:{text}")))
                if role[:1] == "s" and place == "start":
                    found.setdefault("system", []).append((c + extra, a + "K", (*lines, f"{role}:{text}")))
        paths = {p: sorted({x for x in v if x[0] <= min(v)[0] + 2})[:60] for p, v in found.items()}
    ends = with_inserts(paths)
    return min(ends.get("start", []) + ends.get("assistant", []))


def plain(rows):
    by, out = {}, []
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        marks, numbers = faults(turns), [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(turns, marks)
        out.append((conv, gaps, *map(marks.count, "bdt"), illegal, cost, audit, "\n".join(lines)))
    return sorted(out, key=repr)


def rows_of(spark, rows, *options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, block int")
    return sorted((tuple(r) for r in conversations.repair(df, *options).collect()), key=repr)


@pytest.fixture(scope="module")
def searched():
    rnd, rows = random.Random(3), []
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "unknown"]
    for conv in range(120):
        for turn in range(rnd.choice([1, 2, 5, 9, 14])):
            text = rnd.choice(["ok.", "no", "", "  ", "Yes!\n", "what? ", None, "x" * (50_000 if conv < 3 else 5) + ".", f"own {turn}."])
            rows.append((conv or None, rnd.choice([turn, turn, turn, None, turn + 1]), rnd.choice(roles), text))
    return rows, plain(rows)


@pytest.mark.parametrize("block", [512, 4, 1])
def test_repair_is_that_of_the_plain_search(spark, searched, block):
    rows, want = searched
    assert rows_of(spark, rows, block) == want


def test_a_long_conversation_is_folded_in_blocks(spark):
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"text {rnd.randrange(250)}.") for t in range(500)]
    got = rows_of(spark, rows, 64)
    assert got == rows_of(spark, rows, 1000)
    assert got[0][3] == 500 - len({r[2:] for r in rows})
    initials = "".join(line[0] for line in got[0][-1].split("\n"))
    assert initials == "ua" * (len(initials) // 2)


def test_damage_is_planted_by_the_hash_of_the_place(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 7, 8) for t in (None, *range(30))] + [(9, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversations.damage(df).collect()), key=repr)
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "One Two" if kind == 2 and text != " " else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3))
    assert got == sorted(want, key=repr)


def test_empty_table_gives_no_rows(spark):
    assert rows_of(spark, []) == []
