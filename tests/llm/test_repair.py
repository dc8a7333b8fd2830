"""Conversation repair against a search over all edit sequences in plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wardline.llm import repair
from wardline.llm.queries import QUERIES
from wardline.llm.repair import END, FAR, Repair, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows, must, cut):
    """Least cost, then least audit, by a search ordered by both; the repaired lines come along."""
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, lines = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (k, last) in done:
            continue
        done.add((k, last))
        wanted = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", k, wanted, (*lines, names[wanted] + ":")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last, lines))
            if not must[k]:
                c, first = cost + 5 * cut[k], role[:1]
                if first in ("u", "a") and first == wanted or first == "s" and last == "":
                    heapq.heappush(heap, (c, audit + "K", k + 1, first, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (c + 1, audit + "R", k + 1, wanted, (*lines, f"{names[wanted]}:{text}")))
    raise AssertionError


def expected(rows):
    out = []
    for conv, turns in damage(rows).items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        blank = [not SEEN.search(t) for _, _, t in turns]
        twice = [not b and (r, t) in {(x, y) for _, x, y in turns[:k]} for k, ((_, r, t), b) in enumerate(zip(turns, blank, strict=True))]
        cut = [not b and not d and SEEN.findall(t)[-1] not in ".!?" for (_, _, t), b, d in zip(turns, blank, twice, strict=True)]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(turns, [b or d for b, d in zip(blank, twice, strict=True)], cut)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, sum(blank), sum(twice), sum(cut), illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in QUERIES["op12_repair"](spark, str(tmp_path)).collect()), key=str)


def conversations(rng, convs, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "usher"]
    texts = ["Hello.", "Fine!", "no end", "", " \t\n", None, "Why?", "tail. ", "Ünï ö.", "a\nb.", "x" * 50]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(0, longest)):
            at = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]) - 2
            role = rng.choice(roles) if rng.random() < 0.3 else roles[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}."
            rows += [(conv, at, role, text)] * rng.choice([1] * 9 + [2])
    return rows


def test_equal_to_a_search(spark, tmp_path):
    rng = random.Random(8)
    rows = conversations(rng, [*range(200), None], 12)
    rows += [(500 + k, k, "user", "Only one.") for k in range(60)]  # some are dropped
    assert run(spark, tmp_path, rows) == expected(rows)


def test_long_conversations_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    monkeypatch.setattr(repair, "PIECE_BYTES", 300)
    rng = random.Random(9)
    rows = conversations(rng, [None] * 12 + [3] * 20 + list(range(10, 40)), 30)
    assert run(spark, tmp_path, rows) == expected(rows)


def test_hot_conversation_over_all_tasks(spark, tmp_path):
    rng = random.Random(10)
    rows = [(7, t, ["user", "assistant"][t % 2], f"{rng.random()}" + rng.choice([".", ""])) for t in range(9000)]
    rows += [(7, None, "user", "same.")] * 500 + [(k, 0, "user", "Hi.") for k in range(20)]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_very_long_text(spark, tmp_path):
    rows = [(1, 1, "user", "y" * 6_000_000 + "."), (1, 2, "assistant", "z" * 5_000_000), (1, 3, "user", "y" * 6_000_000 + ".")]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_real_turns_and_clashing_columns(spark):
    rows = [(1, 0, "assistant", "B.", 1, 2, "k"), (1, 1, "user", "C.", 1, 2, "k"), (2, 0, "user", "", 1, 2, "k")]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, live int, codes long, at string")
    found = [tuple(r) for r in repaired_turns(frame, "conv").orderBy("conv", "place").drop("place").collect()]
    cost, audit, lines = cheapest([r[1:4] for r in rows[:2]], [False] * 2, [False] * 2)
    assert [f"{role}:{text}" for _, _, role, text in found] == list(lines)
    summary = {r["conv"]: r for r in repair_conversations(frame, "conv").collect()}
    assert (summary[1]["cost"], summary[1]["audit"]) == (cost, audit) and summary[2]["audit"] == "D"


@pytest.mark.parametrize("seed", range(3))
def test_pieces_join_to_the_whole(seed):
    rng = random.Random(seed)
    way = Repair()
    for _ in range(300):
        codes = bytes(rng.choice([1, 2, 3, 0, 4, 10, 11, 2, 3]) for _ in range(rng.randint(1, 40)))
        cut = rng.randint(0, len(codes))
        after = way.backward(codes[cut:], END)
        m = way.matrix(codes[:cut])
        assert way.backward(codes, END) == tuple(min(FAR, *[m[t][s] + after[t] for t in range(4)]) for s in range(4))
        edits, _, cost = way.walk(codes, 0, END, True)
        one, state, a = way.walk(codes[:cut], 0, after, False)
        two, _, b = way.walk(codes[cut:], state, END, True)
        assert edits == one + two and cost == a + b
