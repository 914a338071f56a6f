import hashlib
import random
from functools import cache

import pyarrow as pa
import pytest

from millrace.llm import conversation_repair as cr

SPACES = " \t\n\v\f\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
GIVEN = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def faults(turns):
    seen, found = set(), []
    for role, text in turns:
        bare = text.strip(SPACES)
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(turns):
    """Cost and least edits by recursion over what is left, and the turns they leave."""
    wrong = faults(turns)

    @cache
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(turns) and state in ("", "a") else []
        if inserted < 2:
            cost, edits = rest(i, GIVEN[state][0], inserted + 1)
            ways.append((cost + 5, "I" + edits))
        if i < len(turns):
            cost, edits = rest(i + 1, state, 0)
            ways.append((cost + 2, "D" + edits))
            if wrong[i] not in ("blank", "duplicate"):
                extra = 5 * (wrong[i] == "truncated")
                after = AFTER.get((state, turns[i][0][:1]))
                if after is not None:
                    cost, edits = rest(i + 1, after, 0)
                    ways.append((cost + extra, "K" + edits))
                cost, edits = rest(i + 1, GIVEN[state][0], 0)
                ways.append((cost + extra + 1, "R" + edits))
        return min(ways, default=(10**9, ""))

    for i in range(len(turns), -1, -100):  # from the end, so that no recursion is deep
        for state in ("", "s", "u", "a"):
            rest(i, state, 0)
    cost, audit = rest(0, "", 0)
    state, left, lines = "", iter(turns), []
    for edit in audit:
        role, text = (GIVEN[state], "") if edit == "I" else next(left)
        if edit == "D":
            continue
        role = role if edit == "K" else GIVEN[state]
        lines.append((edit, role, text))
        state = role[0]
    return cost, audit, lines


def brute(rows):
    """``rows``: (conv_id, turn, role, text)."""
    report = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        turns = [(r, x) for _, r, x in own]
        numbers = [t for t, _, _ in own if t is not None]
        wrong = faults(turns)
        initials = [r[:1] for r, _ in turns]
        cost, audit, lines = cheapest(tuple(turns))
        text = "\n".join(f"{r}:{x}" for _, r, x in lines)
        report[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *[wrong.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return report


def found(df, **options):
    rows = cr.repair_report(df, **options).collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["Yes.", "No!", "cut off", "", " \n", "Why?  ", "Yes."]


def some_rows(seed, conversations, longest):
    random.seed(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = []
    for conv in range(conversations):
        for turn in range(random.randint(1, longest)):
            text = random.choice(TEXTS) if random.random() < 0.3 else f"{random.random()}{random.choice(['.', ''])}"
            rows.append((conv, turn + random.randint(0, 1), random.choice(roles), text))
    return rows


def test_random_conversations_equal_brute_force(spark):
    rows = some_rows(1, 300, 9)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_conversations_cut_into_chunks_equal_brute_force(monkeypatch, size):
    monkeypatch.setattr(cr, "CHUNK_ROWS", size)
    rows = sorted(some_rows(size, 40, 30), key=lambda r: (r[0], r[1], r[2], r[3]))
    random.seed(size)
    table = []
    for at, (conv, turn, role, text) in enumerate(rows):
        wrong = faults([(r, x) for c, _, r, x in rows[: at + 1] if c == conv])[-1]
        table.append({"conv_id": conv, "turn": turn, "role": role, "text": text, "copies": 1,
                      "fault": ["", "blank", "duplicate", "truncated"].index(wrong)})
    got, pieces = {}, []
    cuts = [0, *sorted(random.sample(range(len(table)), 6)), len(table)]
    for part, (start, stop) in enumerate(zip(cuts, cuts[1:])):  # one run is one task's rows
        for row in cr.search([pa.RecordBatch.from_pylist(table[start:stop])], cr.Report, part):
            if "part" in row:
                pieces.append(row)
            else:
                got[row["conv_id"]] = tuple(row.values())[1:]
    pieces.sort(key=lambda p: (p["conv_id"], p["part"], p["number"]))
    for row in cr.assemble([pa.RecordBatch.from_pylist([p]) for p in pieces], cr.Report):
        assert row["conv_id"] not in got
        got[row["conv_id"]] = tuple(row.values())[1:]
    assert got == brute(rows)


def test_open_edits_stay_few():
    random.seed(3)
    survivors, most, edits = cr.Survivors(cr.START), 0, 0
    for i in range(20_000):
        moves = cr.MOVES[random.choice("suua"), random.choice([cr.NONE, cr.NONE, cr.TRUNCATED, cr.DUPLICATE])]
        edits += sum(len(e) for e, _ in survivors.advance(moves, [i]))
        most = max(most, *(len(survivors.open_edits(node)) for _, node in survivors.best.values()))
    assert most < 200 and edits > 19_000


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "Well."), (None, 2, None, None),
        (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "", "b."), (2, 5, "u", "c."), (2, 5, "a", "c."),
        (3, 1, "system", "only."), (4, 1, "user", "x " * 300_000 + "."), (4, 2, "assistant", "é 👍🏽."), (5, -3, "user", ""),
        (6, 2**62, "assistant", "late."), (6, -(2**62), "user", "early."),
    ]
    rows += [(7, 1, "user", "same.")] * 3000 + [(7, 2, "assistant", "end.")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", copies string, fault string")
    want = brute(rows)
    assert found(df) == want
    turns = {}
    for r in sorted(cr.repaired_turns(df).collect(), key=lambda r: (r.conv_id or -1, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    nothing = hashlib.sha256(b"").hexdigest()
    digests = {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in turns.items()}
    assert {c: digests.get(c, nothing) for c in want} == {c: row[-1] for c, row in want.items()}


def test_no_state_lags_more_than_stated():
    random.seed(8)
    for _ in range(3000):
        moves = [cr.MOVES[random.choice(["s", "u", "u", "a", "a", ""]), random.randrange(4)] for _ in range(random.randint(0, 5))]
        cost = dict.fromkeys(cr.STATES, 0)
        for step in [cr.LAST, *reversed(moves)]:
            cost = {q: min([c + cost[r] for q_, r, c, _ in step if q_ == q]) for q in cr.STATES}
        assert all(cost[p] <= cost[q] + most for p, others in cr.LAG.items() for q, most in others.items())


def test_copies_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.", 0), (2, 1, "user", "a.", 2), (2, 2, "assistant", "b.", 1)], SCHEMA + ", n int")
    got = found(df, copies=df["n"])
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == brute([(2, 1, "user", "a.")] * 2 + [(2, 2, "assistant", "b.")])[2]
    assert found(df.where("false").drop("n")) == {}
