import datetime
import json
import random

import pytest

from kgloom.llm.conversations import export_verdicts, fold_events, verdicts

T = datetime.datetime(2024, 1, 1)
SCHEMA = "row_id long, msg_id string, conversation_id string, parent_id string, role string, content string, created_at timestamp, deleted_at timestamp, loaded_at timestamp, faults int"


def brute(messages):
    """Conversations to drop, from (conversation, message, parent, kind)."""
    drop, by = set(), {}
    for c, m, p, k in messages:
        by.setdefault(c, {})[m] = (p, k)
    for c, ms in by.items():
        kinds = [k for _, k in ms.values()]
        bad = not (1 in kinds and 2 in kinds) or any(p is not None and p not in ms for p, _ in ms.values())
        answered = set()
        for m, (p, k) in ms.items():
            seen = [m]
            while p is not None and p in ms and p not in seen:
                seen.append(p)
                if k == 2:
                    answered.add(p)
                p = ms[p][0]
            bad |= p is not None and p in seen
            if k == 2 and p == m:
                answered.add(m)
        if bad or any(k == 1 and m not in answered for m, (_, k) in ms.items()):
            drop.add(c)
    return drop


@pytest.mark.parametrize("small", [0, 6, 1000])
def test_random_conversations(spark, small):
    rng, messages, rows = random.Random(5), [], []
    for c in range(60):
        n = rng.randrange(1, 12)
        for m in range(n):
            parent = None if m == 0 or rng.random() < 0.1 else f"m{m - 1 if rng.random() < 0.8 else rng.randrange(m)}"
            if rng.random() < 0.02:
                parent = rng.choice(["m99", f"m{rng.randrange(n)}"])
            messages.append((f"c{c}", f"m{m}", parent, 1 if m % 2 == 0 else 2 if rng.random() < 0.93 else 0))
    for i, (c, m, p, k) in enumerate(messages):
        role = {1: rng.choice(["user", " Human "]), 2: rng.choice(["AI", "model\t"]), 0: "assistant"}[k]
        rows.append((i, m, f" {c}\t", p or rng.choice([None, " "]), role, "…" if k == 0 else "hi", None, None, T, 0))
        rows.append((i + 1000, m, c, "zz", "tool", None, T, T, T - datetime.timedelta(days=1), 0))
    rows += [(5000, "m0", None, None, "user", "x", T, None, T, 0), (5001, None, "c0", None, "user", "x", T, None, T, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = verdicts(fold_events(df), small).collect()
    assert len(got) == 60 and {r.conversation_id for r in got if r.faults} == brute(messages)
    kept = verdicts(fold_events(df), small, turns=True).collect()
    assert {r.conversation_id for r in kept} == {f"c{c}" for c in range(60)} - brute(messages)


def test_empty(spark):
    assert verdicts(fold_events(spark.createDataFrame([], SCHEMA))).collect() == []


def test_exports(spark):
    def entry(parent, role, content, **more):
        return {"parent": parent, "message": {"author": {"role": role}, "content": content}} | more

    good = {"r": {"children": ["a"]}, "a": {"message": {"author": {"role": "User"}, "content": {"parts": ["q", None, {}]}}}, "b": entry("a", "ai", {"text": "r"})}
    rows = [good, good | {"c": entry("zz", "user", "x")}, good | {"c": entry("b", "user", "thanks")}, {}, None, good | {"r": {"parent": "b", "children": ["a"]}}, [{"id": k} | v for k, v in good.items()]]
    texts = [json.dumps(r) for r in rows] + [None, "{bad", json.dumps(json.dumps(good))]
    df = spark.createDataFrame(list(enumerate(texts)), "export_id long, mapping string")
    assert [r.export_id for r in export_verdicts(df).orderBy("export_id").collect() if r.faults == 0] == [0, 6, 9]
    turns = export_verdicts(df, turns=True).where("export_id = 0").collect()
    assert [(r.turn, r.role, r.content) for r in turns] == [(0, "user", "q"), (1, "assistant", "r")]
