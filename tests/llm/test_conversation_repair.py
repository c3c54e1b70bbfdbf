import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewatt.llm import conversation_repair as cr

SF_DIR = "/root/testdata/sf0.01"
LEGAL = re.compile(r"(s?(ua)+)?")
KIND = "conv_id bigint, turn bigint, role string, text string, cost string, audit array<int>"


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows):
    """All edit sequences with at most two insertions between rows: (cost, audit, repaired)."""
    gaps = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    found = faults(rows)
    choices = []
    for (_, role, text), fault in zip(rows, found):
        late = 5 if fault == "truncated" else 0
        own = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(late, "K", [(role, text)])] + [(late + 1, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append([(5 * len(g) + c, "I" * len(g) + a, [(r, "") for r in g] + kept) for g in gaps for c, a, kept in own])
    choices.append([(5 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gaps])
    for way in itertools.product(*choices):
        turns = [t for _, _, kept in way for t in kept]
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in turns)):
            yield sum(c for c, _, _ in way), "".join(a for _, a, _ in way), turns


def by_states(rows):
    """The best (cost, audit, turns) row by row over all states: another way, for longer conversations."""
    def inserted(best):
        for _ in range(2):
            for s, (c, a, t) in list(best.items()):
                to = "a" if s == "u" else "u"
                new = (c + 5, a + "I", t + [("user" if to == "u" else "assistant", "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        late, new = (5 if fault == "truncated" else 0), {}
        for s, (c, a, t) in inserted(dict(best)).items():
            options = [(s, c + 2, a + "D", t)]
            if fault not in ("blank", "duplicate"):
                due = "a" if s == "u" else "u"
                options.append((due, c + 1 + late, a + "R", t + [("user" if due == "u" else "assistant", text)]))
                if role[:1] == due or (role[:1] == "s" and s == ""):
                    options.append((role[:1], c + late, a + "K", t + [(role, text)]))
            for to, *rest in options:
                if to not in new or tuple(rest[:2]) < new[to][:2]:
                    new[to] = tuple(rest)
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def report(rows, repaired):
    cost, audit, turns = repaired
    found, turns_of = faults(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns_of) - min(turns_of) + 1 - len(set(turns_of)) if turns_of else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_rows(r, n):
    texts = ["Yes.", "no", " ", "", "What?", "é!", "a. b", "Done! \n", "x" * 50 + "."]
    return [(r.choice([None, *range(n + 3)]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "agent"]), r.choice(texts + [f"t{i}." for i in range(n)])) for _ in range(n)]


def kinds_of(rows):
    return cr.faults([{"turn": t, "role": r, "text": x} for t, r, x in rows], [repr(row[1:]).encode() for row in rows], set())[1]


@pytest.mark.parametrize("seed", range(24))
def test_search_finds_the_best_of_all_edits(seed):
    r = random.Random(seed)
    rows = by_turn(some_rows(r, r.randint(0, 3)))
    cost, audit, turns = min(every_repair(rows), key=lambda w: w[:2])
    assert cr.solved(kinds_of(rows)) == (cost, audit)
    assert cr.applied(audit, [{"turn": t, "role": x, "text": y} for t, x, y in rows]) == turns
    assert by_states(rows) == (cost, audit, turns)


@pytest.mark.parametrize("seed", range(20))
def test_long_searches(seed):
    r = random.Random(seed)
    rows = by_turn(some_rows(r, r.choice([20, 100, 256])))
    assert cr.solved(kinds_of(rows)) == by_states(rows)[:2]


@pytest.mark.parametrize("seed", range(20))
def test_composed_segments_are_as_the_whole(seed):
    r = random.Random(seed)
    kinds = kinds_of(by_turn(some_rows(r, 60)))
    cuts = sorted(r.sample(range(1, 60), 5))
    parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, 60])]
    nodes, audits = [], []
    for part in parts:
        costs, ranks, audit = [cr.NEVER] * 16, [0] * 16, {}
        for entry in cr.STATES:
            found = cr.transfer(part, entry)
            for place, to in enumerate(sorted(found, key=lambda to: found[to][1])):
                costs[4 * entry + to], ranks[4 * entry + to], audit[entry, to] = found[to][0], place, found[to][1]
        nodes.append((costs, ranks))
        audits.append(audit)
    costs, ranks, ways = cr.compose(nodes)
    whole = cr.transfer(kinds, cr.START)
    for to, (cost, audit) in whole.items():
        states = [*ways[to], to]
        assert costs[to] == cost and "".join(a[s, t] for a, s, t in zip(audits, states, states[1:])) == audit
    assert sorted(whole, key=lambda to: whole[to][1]) == sorted(whole, key=lambda to: ranks[to])


def collected(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((repr(r.conv_id), tuple(r[n] for n in names)) for r in frame.collect())


@pytest.mark.parametrize("segment_rows,fan", [(256, 8), (3, 2), (1, 1)])
def test_conversations_of_any_length(spark, segment_rows, fan):
    r = random.Random(5)
    conversations = {c: some_rows(r, n) for c, n in [(None, 30), (1, 200), (2, 1), (7, 90), *((c, r.randint(1, 9)) for c in range(10, 40))]}
    given = [(c, t, x, y, "", [1]) for c, rows in conversations.items() for t, x, y in rows]
    r.shuffle(given)
    made = cr.repair_conversations(spark.createDataFrame(given, KIND).repartition(6), segment_rows=segment_rows, fan=fan)
    want = sorted((repr(c), report(by_turn(rows), by_states(by_turn(rows)))) for c, rows in conversations.items())
    assert collected(cr.conversation_report(made)) == want


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_digest(rows):
    damaged = plain_damage(rows)
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = by_turn([row[1:] for row in damaged if row[0] == conv])
        out.append((repr(conv), report(own, by_states(own))))
    return sorted(out)


def test_given_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    assert collected(cr.repair_digest(table)) == plain_digest([tuple(r) for r in table.collect()])


def test_hostile_rows(spark):
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, 3]), t, r.choice([None, role]), r.choice([None, text])) for t, role, text in some_rows(r, 80)]
    rows += [(c, 0, "user", "Hi.") for c in range(100, 160)]  # some of these lose their only row
    rows += [(5, None, None, None)] * 3 + [(6, 1, "user", "long. " * 5000)] * 2
    assert any(zlib.crc32(f"{c}:0".encode()) % 20 == 0 for c in range(100, 160))
    assert collected(cr.repair_digest(spark.createDataFrame([(*row, "", [1]) for row in rows], KIND))) == plain_digest(rows)


def test_empty_table(spark):
    assert cr.repair_digest(spark.createDataFrame([], KIND)).count() == 0
