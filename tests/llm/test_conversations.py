import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quireflow.llm import conversations as C
from quireflow.llm import queries as Q

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """The contract's damage on ``(conv_id, turn, role, text)``."""
    out = []
    for conv, turn, role, text in rows:
        as_text = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{as_text[0]}:{as_text[1]}".encode()) % 20
        role, text = as_text[2:]
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """``(cost, audit, roles and texts)`` row by row, with the whole audit as part of the compared value."""
    step = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", [])}

    def widen(best):
        for _ in range(3):
            for at, (cost, audit, lines) in list(best.items()):
                role = step[at]
                offer = (cost + 5, audit + "I", [*lines, (role, "")])
                best[role[0]] = min(best.get(role[0], offer), offer)
        return best

    for role, text, fault in rows:
        after = {}

        def offer(state, value, after=after):
            after[state] = min(after.get(state, value), value)

        for at, (cost, audit, lines) in widen(best).items():
            offer(at, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in {"": ("s", "u"), "s": "u", "u": "a", "a": "u"}[at] and role[:1]:
                    offer(role[0], (cost + more, audit + "K", [*lines, (role, text)]))
                offer(step[at][0], (cost + 1 + more, audit + "R", [*lines, (step[at], text)]))
        best = after
    best = widen(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, damage=True):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows) if damage else rows:
        convs[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), turn, role or "", text or ""))
    want = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: r[:4])
        seen, listed, faults = set(), [], defaultdict(int)
        for *_, role, text in own:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            listed.append((role, text, fault))
        turns = [r[4] for r in own if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(listed, listed[1:], strict=False))
        cost, audit, lines = cheapest(listed)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        want[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha)
    return want


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summary(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return made.selectExpr("*", "'x' AS fault", "1 AS first", "2 AS part", "3 AS key", "'y' AS digest")


def messy(seed, convs=60, longest=30):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Hi.", "Hi", "", " \t", None, "Well!\n", "so what? ", "é ", "\x1c"]
    for conv in range(convs):
        for _ in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else rng.randrange(-2, 12)
            text = rng.choice(texts) if rng.random() < 0.5 else f"line {rng.randrange(1000)}" + rng.choice([".", ""])
            rows.append((conv if conv else None, turn, roles[min(int(rng.expovariate(0.8)), 7)], text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_damaged_rows_match_brute_force(spark, seed):
    rows = messy(seed)
    got = summary(C.repair(C.damage(frame(spark, rows).repartition(3))))
    assert got == sorted(brute(rows).values(), key=repr)


def test_conversations_over_many_partitions(spark):
    rows = [r for r in messy(3, convs=6, longest=400)] + [(1, t, "user", "same words") for t in range(100)] + [(1, 5, "user", "again")] * 200
    made = C.repair(C.damage(frame(spark, rows)), partition_bytes=500)
    assert summary(made) == sorted(brute(rows).values(), key=repr)


def test_edits_give_the_repaired_turns(spark):
    rows = messy(4, convs=8, longest=60)
    table = C.damage(frame(spark, rows)).persist()
    for size in (300, 1 << 20):
        whole = {r["conv_id"]: r for r in C.repair(table, partition_bytes=size).collect()}
        lines, audits = defaultdict(list), defaultdict(list)
        for r in sorted(C.repair(table, turns=True, partition_bytes=size).collect(), key=lambda r: r["position"]):
            audits[r["conv_id"]].append(r["edit"])
            if r["edit"] != "D":
                lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        for conv, r in whole.items():
            assert "".join(audits[conv]) == r["audit"] and hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == r["repaired_sha256"]
            assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[conv]))


def test_runs_and_rows_cost_the_same():
    rng = random.Random(5)
    symbols = [(r, f) for r in ("s", "u", "a", "") for f in range(4)]
    for _ in range(200):
        runs = C.runs_of((rng.choice(symbols), rng.choice([1, 1, 2, 3, 70, 200])) for _ in range(rng.randrange(6)))
        names = {C.SOUND: "", C.TRUNCATED: "truncated", C.BLANK: "blank", C.DUPLICATE: "duplicate"}
        want = cheapest([(r, "", names[f]) for (r, f), n in runs for _ in range(n)])
        assert C.solve(runs)[:2] == want[:2]
        matrix = C.run_matrix(runs)
        assert C._apply(matrix, C._inserted(C.END))[C.START] == want[0]


def test_long_runs_take_little_time():
    cost, audit, _ = C.solve([(("u", C.SOUND), 300_000), (("a", C.DUPLICATE), 200_000)])
    assert len(audit) >= 300_000 and cost > 0


def test_wide_and_empty_tables(spark):
    assert summary(C.repair(C.damage(frame(spark, [])))) == []
    rows = [(1, 0, "user", "x" * 3_000_000 + "." + " " * 100_000), (1, 1, "assistant", ("word " * 400_000) + "!"), (2, None, None, None)]
    assert summary(C.repair(C.damage(frame(spark, rows)))) == sorted(brute(rows).values(), key=repr)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summary(Q.QUERIES["op13_conversation_repair"](spark, folder)) == sorted(brute(rows).values(), key=repr)
