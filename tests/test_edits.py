"""Edits replayed on the cluster against the same requests one by one."""

import random

import pytest

from quire.operators import edits, notes

LINES = "topic string, seq bigint, line string, extra int"
REQUESTS = "topic string, req_seq bigint, old_line string, new_line string"


def one_by_one(lines, requests):
    now = {(t, s): line for t, s, line, _ in lines}
    told = []
    for t, r, old, new in sorted(requests, key=lambda x: (x[1], x[2] or "", x[3] is not None, x[3] or "")):
        at = min((k for k, v in now.items() if k[0] == t and v == old and old is not None), default=None)
        told.append((t, r, old, new, at and at[1]))
        if at is not None:
            if new is None:
                del now[at]
            else:
                now[at] = new
    return sorted((t, s, v) for (t, s), v in now.items()), sorted(told, key=str)


def replayed(spark, lines, requests, **args):
    after, told = edits.replay_edits(spark.createDataFrame(lines, LINES).repartition(3),
                                     spark.createDataFrame(requests, REQUESTS).repartition(2), **args)
    assert after.columns == ["topic", "seq", "line", "extra"]
    return sorted(tuple(r)[:3] for r in after.collect()), sorted((tuple(r) for r in told.collect()), key=str)


@pytest.mark.parametrize("values,block", [("abcdefgh", 4096), ("abc", 5)])
def test_random_requests(spark, values, block):
    rng = random.Random(len(values))
    lines = [(rng.choice("tu"), i, rng.choice(values), i) for i in range(40)]
    requests = [(rng.choice("tu"), r, rng.choice(values), rng.choice([*values, "x", None])) for r in range(40)]
    assert replayed(spark, lines, requests, block=block) == one_by_one(lines, requests)


def test_repeated_requests_take_the_next_copy(spark):
    lines = [("t", i, "a", 0) for i in range(3)] + [("u", 0, "a", 0), (None, 9, "a", 0)]
    requests = [("t", 1, "a", "b"), ("t", 2, "a", "c"), ("u", 1, "z", "y"), (None, 1, "a", "b"), ("t", 4, None, "b")]
    after, told = replayed(spark, [x for x in lines if x[0]], requests)
    assert after == [("t", 0, "b"), ("t", 1, "c"), ("t", 2, "a"), ("u", 0, "a")]
    assert [t[4] for t in told if t[0] == "u" or t[2] is None or t[0] is None] == [None] * 3
    df = spark.createDataFrame([x[:3] for x in lines if x[0]], "topic string, seq bigint, line string")
    out = notes.remove_first(df, spark.createDataFrame([("t", "a"), ("t", "a")], "topic string, old_line string"))
    assert sorted(tuple(r) for r in out.collect()) == [("t", 2, "a"), ("u", 0, "a")]


def test_hot_line_is_spread(spark):
    lines = [("t", i, "hot", 0) for i in range(5_000)]
    requests = [("t", r, "hot", f"n{r}") for r in range(1_500)]
    after, _ = replayed(spark, lines, requests)
    assert after == sorted(("t", i, f"n{i}" if i < 1_500 else "hot") for i in range(5_000))
