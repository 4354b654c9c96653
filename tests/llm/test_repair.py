import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest

from landfold.llm import repair

ROWS = "conv_id long, turn long, role string, text string, size long, part string"


def damage(rows):
    say = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c]
        act = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = say(role), say(text)
        if act == 1:
            text = ""
        if act == 2:
            text = re.sub("[.!?]", "", text)
        if act == 4:
            role = "user"
        out[c] += [(t, role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, insert=5):
    """(cost, audit, repaired) of the cheapest edits, the ASCII-least of them; by recursion over suffixes."""
    found = faults(rows)
    sys.setrecursionlimit(20_000)

    @cache
    def rest(i, so_far, inserted):
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", so_far):
            options.append((0, "", ()))
        add = lambda cost, letter, role, text, j, n: options.extend((cost + c, letter + a, ((role, text), *x) if role is not None else x) for c, a, x in [rest(j, shape(so_far + role[:1]) if role is not None else so_far, n)])
        if inserted < 2:
            for role in ("user", "assistant"):
                if ok(so_far + role[:1]):
                    add(insert, "I", role, "", i, inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", None, None, i + 1, 0)
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                if role and ok(so_far + role[:1]):
                    add(more, "K", role, text, i + 1, 0)
                for other in ("user", "assistant"):
                    if ok(so_far + other[:1]):
                        add(1 + more, "R", other, text, i + 1, 0)
        return min(options, default=(10**9, "", ()))

    ok = lambda x: re.fullmatch("s?(ua)*u?", x) is not None
    shape = lambda x: {"u": "u", "a": "ua"}.get(x[-1:], x)
    return rest(0, "", 0)


def brute(rows):
    out = []
    for c, held in damage(rows).items():
        kinds, turns = faults(held), [t for t, *_ in held if t is not None]
        cost, audit, left = edits(held)
        initials = [role[:1] for _, role, _ in held]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n):
    texts = ["Well.", "So what?", "cut off", "", "  ", "Yes!", "no end, ", "日本。", "ok.\n", "a\nb."]
    out = []
    for c in range(n):
        turns = range(rng.randint(1, 9))
        for t in turns:
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            out.append((c, t, "system" if t == 0 and rng.random() < 0.4 else role, rng.choice(texts)))
    odd = [None, "", "tool", "s", "Üser", "user "]
    out += [(n + i, rng.choice([None, 0, 5, 5, 9, -3]), rng.choice(["user", "assistant", *odd]), rng.choice([*texts, None])) for i in range(12) for _ in range(6)]
    return [*out, *out[:5], out[0], (None, 1, "user", "Null."), (None, None, None, None), (10**15, 10**17, "assistant", "x" * 90_000), (10**15, -(10**17), "user", "y.")]


@pytest.fixture(scope="module")
def rows():
    return conversations(random.Random(11), 120)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "p") for r in rows], ROWS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_brute_force_by_enumeration():
    """The suffix recursion itself, against all edits of short conversations."""
    rng = random.Random(2)
    for _ in range(60):
        held = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for t in range(rng.randint(0, 3))]
        kinds, options = faults(held), []
        for n in range(8):
            for letters in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in letters) != len(held) or letters.count("I") > 4:
                    continue
                states, i = [(0, "", ())], 0
                for x in letters:
                    new = []
                    for cost, shape, left in states:
                        if x == "I":
                            new += [(cost + 5, shape + r[0], (*left, (r, ""))) for r in ("user", "assistant")]
                        elif x == "D":
                            new.append((cost + 2, shape, left))
                        elif kinds[i] not in ("blank", "duplicate"):
                            _, role, text = held[i]
                            more = 5 * (kinds[i] == "truncated")
                            new += [(cost + more, shape + role[0], (*left, (role, text)))] if x == "K" else [(cost + 1 + more, shape + r[0], (*left, (r, text))) for r in ("user", "assistant")]
                    states, i = new, i + (x != "I")
                options += [(cost, "".join(letters), left) for cost, shape, left in states if re.fullmatch("(s?(ua)+)?", shape)]
        assert min(options) == edits(held)


def test_repair_report(spark, rows):
    want = brute(rows)
    assert got(repair.repair_report(frame(spark, rows).repartition(3))) == want
    assert {c for x in want for c in x[7]} == set("DKR")  # at these costs an insertion never pays
    assert repair.repair_report(frame(spark, rows)).dtypes == [tuple(c.replace("long", "bigint").split()) for c in repair.REPORT.split(", ")]


def test_conversations_over_many_blocks_and_partitions(spark, rows, monkeypatch):
    rng = random.Random(4)
    long = [(7_000, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Well.", "cut", "", f"n{t}.", f"n{t}"])) for t in range(400)]
    held = sorted(rows + long, key=lambda r: rng.random())
    ordered = repair.ordered(repair.damaged(frame(spark, held)))
    assert ordered.rdd.getNumPartitions() >= 4
    monkeypatch.setattr(repair, "partitions", lambda df, times: 23)
    assert got(repair.repair_report(frame(spark, held))) == brute(held)


def in_blocks(steps_of, sizes):
    """Folds matrices and states over blocks as `places` does."""
    cuts = list(itertools.accumulate(sizes, initial=0))
    parts = [steps_of[a:b] for a, b in itertools.pairwise(cuts)]
    ahead, aheads = repair.START, []
    for p in parts:
        aheads.append(ahead)
        m = repair.matrix(p)
        ahead = [min(min(ahead[x] + m[x][q] for x in range(4)), repair.FAR) for q in range(4)]
    back, backs = repair.END, []
    for p in reversed(parts):
        backs.insert(0, back)
        m = repair.matrix(p)
        back = [min(min(m[x][q] + back[q] for q in range(4)), repair.FAR) for x in range(4)]
    state, letters = 0, ""
    for i, (p, a, b) in enumerate(zip(parts, aheads, backs, strict=True)):
        path, state = repair.traverse(p, repair.forward(p, a), repair.backward(p, b), state, i == len(parts) - 1)
        letters += "".join(x * n for x, _, n in path)
    return letters


@pytest.mark.parametrize("insert", [5, 2, 1])
def test_blocks_give_what_the_whole_gives(monkeypatch, insert):
    monkeypatch.setattr(repair, "INSERT", insert)
    monkeypatch.setattr(repair, "START", repair._inserted([0 if q == 0 else repair.FAR for q in range(4)]))
    monkeypatch.setattr(repair, "END", repair._to_insert([0 if q in repair.ENDS else repair.FAR for q in range(4)]))
    rng, seen = random.Random(9), set()
    for _ in range(300):
        held = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}"])) for t in range(rng.randint(1, 14))]
        steps = [(repair.step_code(r, False) | (4 if k in ("blank", "duplicate") else 8 if k else 0), 1) for (_, r, _), k in zip(held, faults(held), strict=True)]
        sizes, left = [], len(steps)
        while left:
            sizes.append(rng.randint(1, left))
            left -= sizes[-1]
        audit = edits(held, insert)[1]
        assert in_blocks(steps, sizes) == in_blocks(steps, [len(steps)]) == audit
        seen |= set(audit)
    assert seen == (set("DIKR") if insert < 5 else set("DKR"))


def test_small_blocks_in_one_partition(spark, rows, monkeypatch):
    held = rows + [(8_000, t, ["user", "assistant"][t % 2], f"say {t}.") for t in range(300)]
    assert got(repair.repaired(repair.damaged(frame(spark, held)), block_bytes=700)) == brute(held)


def test_empty_and_all_dropped(spark):
    assert repair.repair_report(frame(spark, [])).count() == 0
    gone = [(c, t, "user", "x.") for c in range(3) for t in range(200) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert got(repair.repair_report(frame(spark, gone))) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in range(3)]


def test_hot_copies_are_counted_not_repeated(spark):
    """One row many times: a row with a count, and as many letters."""
    rows = [(1, 5, "user", "Same.")] * 3000 + [(1, 6, "assistant", "Fine.")]
    assert repair.ordered(repair.damaged(frame(spark, rows))).count() == 2
    assert got(repair.repair_report(frame(spark, rows))) == brute_hot(rows)


def brute_hot(rows):
    held = damage(rows)[1]
    n = sum(t == 5 for t, *_ in held)
    first, rest = held[0], held[n:]
    small = edits([first, *rest])
    audit = small[1][0] + "D" * (n - 1) + small[1][1:]
    return [(1, 0, 0, n - 1, faults(held).count("truncated"), n - 1 + sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held[n - 1 :])), small[0] + 2 * (n - 1), audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in small[2]).encode()).hexdigest())]
