"""Conversation repair against dynamic programming over all ways, and on odd rows."""

import hashlib
import random
import zlib

import pytest

from paleoframe.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def cheapest(codes):
    """(cost, audit) by going through every state of every prefix, with insertions."""

    def inserted(best):
        for _ in range(4):
            for q, (cost, audit) in list(best.items()):
                t, way = repair.NEXT[q][repair.DUE[q]], (cost + 5, audit + "I")
                best[t] = min(best.get(t, way), way)
        return best

    best = inserted({0: (0, "")})
    for c in codes:
        new = {}
        for q, (cost, audit) in best.items():
            ways = [(q, cost + 2, audit + "D")]
            if not c & 8:
                cut = 5 if c & 4 else 0
                ways.append((repair.NEXT[q][repair.DUE[q]], cost + 1 + cut, audit + "R"))
                if " sua"[c & 3] in repair.NEXT[q]:
                    ways.append((repair.NEXT[q][" sua"[c & 3]], cost + cut, audit + "K"))
            for t, *way in ways:
                new[t] = min(new.get(t, tuple(way)), tuple(way))
        best = inserted(new)
    return min(way for q, way in best.items() if q in (0, 3))


def test_search_finds_the_least_audit_of_the_cheapest():
    r = random.Random(1)
    for k in range(2500):
        codes = bytes(r.choice([0, 1, 2, 3, 2, 3]) + r.choice([0, 0, 0, 4, 8]) for _ in range(r.randrange(24) if k else 700))
        assert repair.search(codes) == repair.repair(codes) == cheapest(codes)


def test_nodes_compare_as_their_audits():
    r = random.Random(2)
    nodes = [(repair.Node(None, ""), "")]
    for _ in range(300):
        before, audit = r.choice(nodes[-20:])
        letter = r.choice("DIKR")
        if audit + letter not in {a for _, a in nodes}:
            nodes.append((repair.Node(before, letter), audit + letter))
    assert all(n.audit() == a for n, a in nodes)
    for a, x in nodes:
        for b, y in nodes:
            assert (a < b) == (x < y)


def by_force(rows):
    """Everything about one conversation from its rows (turn, role, text)."""
    rows = sorted(((t is not None, t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    kinds, seen, codes = [], set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(SPACES)
        kind = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        codes.append(" sua".find(role[:1] or "-") % 4 * (role[:1] in tuple("sua")) + 4 * (kind == "truncated") + 8 * (kind in ("blank", "duplicate")))
    cost, audit = cheapest(codes)
    q, i, out = 0, 0, []
    for letter in audit:
        role = {"u": "user", "a": "assistant"}[repair.DUE[q]] if letter != "K" else rows[i][2]
        if letter != "D":
            out.append(f"{role}:{rows[i][3] if letter != 'I' else ''}")
            q = repair.NEXT[q][role[0]]
        i += letter != "I"
    turns = [t for has, t, *_ in rows if has]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [
        (None, 0, "user", "no id."), (None, None, None, None), (1, None, "user", "first."), (1, 3, "user", "after a gap!"), (1, 3, "assistant", "of the same turn?"),
        (2, 0, "", "no role."), (2, 1, "user", None), (3, 0, "user", "Émile 日本 😀. "), (3, 1, "assistant", "x" * 40_000 + " \t\r\n"), (4, 5, "assistant", "Yes."), (4, 5, "assistant", "Yes."),
        (5, 0, "user", " \t\n\x0b\x0c\r"), (6, -9, "system", "s."), (6, 9, "sudo", "a line\nand another."),
    ]
    for c in range(10, 60):
        n = r.choice([1, 2, 5, 9, 90])
        out += [(c, r.randrange(2 * n), r.choice(["user", "assistant", "system", "tool", None]), r.choice(["Yes.", "no", "", None, f"{r.random()}!", "a?\n"])) for _ in range(n)]
    return out


def test_repair_by_force(spark, rows):
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, codes string, has int")
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df).collect()}
    assert set(got) == {x[0] for x in rows}
    for c in got:
        assert got[c] == by_force([x[1:] for x in rows if x[0] == c]), c


def test_damage_by_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = {x[0]: [] for x in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        hurt[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r[0]: tuple(r[1:]) for r in repair.op11_repair(spark, str(tmp_path)).collect()}
    assert got == {c: by_force(x) for c, x in hurt.items()}


def test_nothing_left_and_nothing_given(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert repair.repair_conversations(none).collect() == []
    lost = repair.repair_conversations(none, spark.createDataFrame([(7, 0, "user", "x"), (7, 1, "user", "x")], schema)).collect()
    assert [tuple(r) for r in lost] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
