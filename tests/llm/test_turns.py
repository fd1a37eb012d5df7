import hashlib
import random
import re
import zlib

import pytest

from palimpsest.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, place long, record string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, own in out.items()}


def looked(rows):
    out, seen = [], set()
    for _, role, text in rows:
        kept = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows, faults, inserts):
    """All edits with so many insertions at most: (cost, record, lines). Nothing is pruned but what can't become legal."""
    legal = re.compile("(s?(ua)+)?")
    prefix = re.compile("(s?(ua)*u?)?")
    out = []

    def go(i, cost, record, lines, left):
        initials = "".join(r[:1] for r, _ in lines)
        if not prefix.fullmatch(initials):
            return
        if i == len(rows) and legal.fullmatch(initials):
            out.append((cost, record, lines))
        if left:
            for role in ("user", "assistant"):
                go(i, cost + 5, record + "I", [*lines, (role, "")], left - 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, record + "D", lines, left)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] in set("sua"):
                    go(i + 1, cost + more, record + "K", [*lines, (role, text)], left)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, record + "R", [*lines, (to, text)], left)

    go(0, 0, "", [], inserts)
    return out


def plain(rows):
    out = {}
    for conv, own in damaged(rows).items():
        faults = looked(own)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, record, lines = min(every_repair(own, faults, 2))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, record, digest)
    return out


def got(spark, rows, parts=3):
    return {r["conv_id"]: tuple(r)[1:9] for r in turns.repair(frame(spark, rows).repartition(parts)).collect()}


def some(seed, conversations=60):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "x. ", "é…", "many\nlines.\n"]
    out = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 7)):
            out.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), rng.choice(roles), rng.choice(texts)))
    return out + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes.")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_repairs(spark, seed):
    rows = some(seed)
    assert got(spark, rows) == plain(rows)


def test_repeated_rows(spark):
    rows = some(3, 20)
    assert got(spark, rows + rows[:30]) == plain(rows + rows[:30])


def test_dropped_conversations_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert got(spark, [(conv, 1, "user", "x.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert turns.repair(frame(spark, [])).count() == 0


def by_states(rows):
    """One turn at a time over states, for conversations too long to try every repair."""
    faults = looked(rows)
    best = {0: (0, "", ())}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(2):
            for state, (cost, record, lines) in list(best.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    to = step.get((state, c))
                    if to is not None and (cost + 5, record + "I") < best.get(to, (1 << 60, ""))[:2]:
                        best[to] = (cost + 5, record + "I", (lines, f"{role}:"))
        return best

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, record, lines) in inserted(best).items():
            found = [(state, cost + 2, record + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    found.append((step[state, role[:1]], cost + more, record + "K", (lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in step:
                        found.append((step[state, c], cost + 1 + more, record + "R", (lines, f"{name}:{text}")))
            for to, *rest in found:
                if tuple(rest[:2]) < after.get(to, (1 << 60, ""))[:2]:
                    after[to] = tuple(rest)
        best = after
    cost, record, lines = min((x for state, x in inserted(best).items() if state in (0, 3)), key=lambda x: x[:2])
    out = []
    while lines:
        lines, line = lines
        out.append(line)
    return cost, record, hashlib.sha256("\n".join(out[::-1]).encode()).hexdigest()


def test_long_conversations_in_stretches(spark):
    """Thousands of turns in one conversation: stretches, and runs of them in several rounds, give what one walk gives."""
    rng = random.Random(7)
    rows = [(1, n, rng.choice(["user", "assistant", "system", "tool"]), f"{rng.choice(['a', 'b', str(n)])}{rng.choice(['.', '!', ''])}") for n in range(5000)] + [(2, n, ["user", "assistant"][n % 2], f"{n}.") for n in range(200)]
    before = turns.RUN
    turns.RUN = 4
    try:
        found = got(spark, rows, 8)
    finally:
        turns.RUN = before
    for conv, own in damaged(rows).items():
        cost, record, digest = by_states(own)
        faults = looked(own)
        assert found[conv][1:4] == tuple(faults.count(x) for x in ("blank", "duplicate", "truncated"))
        assert found[conv][4] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert found[conv][5:] == (cost, record, digest)
