import hashlib
import itertools
import random
import re
import zlib

import pytest

from sunloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, tree string, pos long, kind string, segment long"
GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "k", 2) for r in rows], SCHEMA)


def key(v):
    return " " if v is None else str(v)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = key(role), key(text)
        kind = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Every sequence of edits with up to two inserts before a turn and at the end: the least (cost, audit) and its lines."""
    found, best = faults(rows), None
    chains = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    per_row = []
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        options = []
        for chain in chains:
            head = 2 * len(chain), "I" * len(chain), "".join(r[0] for r in chain), [f"{r}:" for r in chain]
            ops = [(3, "D", "", [])]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                ops += [(more, "K", role[:1], [f"{role}:{text}"])] if role else []
                ops += [(2 + more, "R", r[0], [f"{r}:{text}"]) for r in ("user", "assistant")]
            options += [(head[0] + c, head[1] + a, head[2] + i, head[3] + x) for c, a, i, x in ops]
        per_row.append(options)
    per_row.append([(2 * len(c), "I" * len(c), "".join(r[0] for r in c), [f"{r}:" for r in c]) for c in chains])
    for choice in itertools.product(*per_row):
        cost, audit = sum(c[0] for c in choice), "".join(c[1] for c in choice)
        if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(c[2] for c in choice)):
            best = cost, audit, [x for c in choice for x in c[3]]
    return best


def walked(rows):
    """The same turn by turn over the states of the grammar."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def opened(states):
        for state, (cost, audit, lines) in states.items():
            for k in range(3):
                yield state, cost, audit, lines
                role = follow[state]
                state, cost, audit, lines = role[0], cost + 2, audit + "I", (*lines, f"{role}:")

    def put(states, state, value):
        if state not in states or value[:2] < states[state][:2]:
            states[state] = value

    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        later = {}
        for state, cost, audit, lines in opened(states):
            put(later, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                new = follow[state]
                put(later, new[0], (cost + 2 + more, audit + "R", (*lines, f"{new}:{text}")))
                if (state, role[:1]) in step:
                    put(later, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        states = later
    ends = [(c, a, list(x)) for s, c, a, x in opened(states) if s in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def wanted(rows, solve):
    """conv_id to the result, of rows before damage."""
    convs = {}
    for r in damaged(rows):
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        held = sorted(convs.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in held if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(held)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, lines = solve(held) if held else (0, "", [])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def made(turns):
    rows = repair.repaired(turns).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def random_rows(seed, convs, longest, roles=("system", "user", "assistant", "user", "assistant")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Why?", "", " \n", "x. "]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(convs) for t in range(rng.randint(1, longest))]
    return [r for r in rows if rng.random() > 0.1]


def test_query_by_walks(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert made(turns) == wanted(rows, walked)


def test_repairs_are_the_cheapest_of_all(spark):
    rows = random_rows(1, 40, 3)
    assert made(frame(spark, rows)) == wanted(rows, exhaustive) == wanted(rows, walked)


@pytest.mark.parametrize("bits", [1, 2])
def test_short_segments_give_the_same(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SPAN_BITS", bits)
    rows = random_rows(bits, 60, 40)
    assert made(frame(spark, rows)) == wanted(rows, walked)


def test_one_conversation_holds_most_turns(spark):
    rows = random_rows(7, 1, 9000) + [(c + 10, *r[1:]) for c in range(3) for r in random_rows(c, 1, 5)]
    assert len(rows) > 100 and made(frame(spark, rows)) == wanted(rows, walked)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "Hi."),
        (None, 1, "assistant", None),
        (1, None, "user", "first."),
        (1, None, "system", "Be kind."),
        (1, 5, None, "no role."),
        (1, 5, "tool", "ran."),
        (1, 9, "", "empty role."),
        (2, None, None, None),
        (3, 0, "user", "same."),
        (3, 0, "user", "same."),
        (3, 0, "user", "same."),
        (4, 2**62, "uncle", "U?"),
        (4, 2**62 + 4, "aunt", "A" * 200_000 + "."),
        (5, 0, "system", "é漢. "),
        (5, 0, "user", "NUL \x00 and\ttabs. \t"),
        (6, -3, "user", "a"),
        (6, -3, "assistant", "a"),
    ]
    assert made(frame(spark, rows)) == wanted(rows, walked)
    assert made(frame(spark, [])) == {}


def test_conversations_without_turns_left(spark):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    out = made(frame(spark, gone))
    assert len(out) == len(gone) > 5 and set(out.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_lines_and_report(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "cut"), (1, 3, "assistant", "")]
    report, lines = repair.repair(frame(spark, rows))
    r = report.first()
    assert (r.cost, r.audit, r.blank, r.truncated, r.illegal) == (min((c, a) for c, a, _ in [exhaustive(rows)])[0], exhaustive(rows)[1], 1, 1, 3)
    said = [f"{x.role}:{x.text}" for x in lines.orderBy("pos", "sub").collect()]
    assert said == exhaustive(rows)[2]


def test_edits_never_lead_outside_the_grammar():
    for kind, start, to, cost, audit in repair.edits():
        assert 0 <= to <= 3 and cost >= 0 and re.fullmatch("I{0,2}[KRD]", audit)
        assert "K" not in audit or kind // 4 < 3
