"""Conversation repair against all edit lists of short conversations, whole, in chunks, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import product

import pytest

from lectern.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, part int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, "other", 9) for r in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def brute(rows):
    """(cost, audit, repaired) by trying every list of edits with at most two insertions at a place."""
    rows = in_order(rows)
    marks = faults(rows)
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    per_row = [[("D", None)] + ([] if f in ("b", "d") else [("K", r[1]), ("R", "user"), ("R", "assistant")]) for r, f in zip(rows, marks, strict=True)]
    best = None
    for edits in product(*per_row):
        for puts in product(gaps, repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", [], []
            for k in range(len(rows) + 1):
                cost, audit, roles = cost + 2 * len(puts[k]), audit + "I" * len(puts[k]), roles + puts[k]
                lines += [f"{p}:" for p in puts[k]]
                if k < len(rows):
                    edit, role = edits[k]
                    audit += edit
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and marks[k] == "t")
                    if edit != "D":
                        roles = [*roles, role]
                        lines.append(f"{role}:{rows[k][2]}")
            if all(roles) and GRAMMAR.fullmatch("".join(r[0] for r in roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def plain(rows):
    """All columns of the result for one conversation, by a search over whole strings of edits."""
    rows = in_order(rows)
    marks = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    ways = {0: (0, "", "")}
    put = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def better(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def with_puts(ways):
        out = dict(ways)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                better(out, put[s][1], (c + 2, a + "I", t + f"\n{put[s][0]}:"))
        return out

    for (_, role, text), mark in zip(rows, marks, strict=True):
        after = {}
        for s, (c, a, t) in with_puts(ways).items():
            better(after, s, (c + 3, a + "D", t))
            if mark not in ("b", "d"):
                more = int(mark == "t")
                if (s, role[:1]) in keep:
                    better(after, keep[s, role[:1]], (c + more, a + "K", t + f"\n{role}:{text}"))
                better(after, put[s][1], (c + more + 2, a + "R", t + f"\n{put[s][0]}:{text}"))
        ways = after
    cost, audit, text = min(way for s, way in with_puts(ways).items() if s in (0, 3))
    return (gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256(text[1:].encode()).hexdigest())


def got(spark, rows):
    out = repair.repair(repair.plain_turns(table(spark, rows))).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


def random_rows(rng, n_convs, longest):
    texts = ["Done.", "What?", "no end", "  ", "", None, "Yes! \n", "é.", "also open,"]
    return [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)) for c in range(n_convs) for _ in range(rng.randrange(0, longest))]


def test_small_conversations_against_all_edit_lists(spark):
    rng = random.Random(4)
    rows = random_rows(rng, 40, 4)
    found = got(spark, rows)
    for c in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == c]
        cost, audit, text = brute(own)
        assert found[c][5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("chunk", [256, 2])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_TURNS", chunk)
    rng = random.Random(7)
    rows = random_rows(rng, 30, 12) + [(None, *r[1:]) for r in random_rows(rng, 9, 6)]
    rows += [(99, rng.randrange(200), rng.choice(["user", "assistant"]), f"line {rng.randrange(150)}{rng.choice(['.', ''])}") for _ in range(700)]
    rows += [(98, k, "ua"[k % 2], f"{k}.") for k in range(300)] + [(97, 0, "user", "same.")] * 5 + [(97, 0, "user", "x" * 100_000)]
    rng.shuffle(rows)
    found = got(spark, rows)
    assert found == {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_repeats_by_shuffle_join(spark, monkeypatch):
    rng = random.Random(9)
    rows = random_rows(rng, 25, 20)
    want = got(spark, rows)
    monkeypatch.setattr(repair, "is_small", lambda _: False)
    monkeypatch.setattr(repair, "HOT_SHARE", 3)
    assert got(spark, rows) == want


def test_damage_and_rows_written_out(spark):
    rows = [(c, t, "ua"[t % 2] + "x", f"It is {t}. Yes!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    turns = repair.damaged(table(spark, rows))
    copies = Counter(r.n_copies for r in turns.collect())
    assert set(copies) == {0, 1, 2} and {r.role for r in turns.collect()} >= {"user", "ux", "ax"}
    edited = repair.edits(turns)
    lines = {}
    for r in sorted(repair.repaired_turns(turns, edited).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair(turns).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()
        assert len(lines.get(r.conv_id, [])) == len(r.audit.replace("D", ""))


def test_all_gone_and_empty(spark):
    assert got(spark, []) == {}
    assert got(spark, [(5, None, None, None)]) == {5: (0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())}
    gone = next(t for t in range(400) if repair.damaged(table(spark, [(1, t, "user", "x.")])).first().n_copies == 0)
    out = repair.repair(repair.damaged(table(spark, [(1, gone, "user", "x.")]))).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
