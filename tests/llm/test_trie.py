"""The prefix trie against a brute force over every prefix."""

import collections
import hashlib
import random
import zlib

import pytest

from quire.llm import prefix_trie as pt
from quire.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d long, `k1` string, `a.b` int"


def sequences(rows, rebuild):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5((hashlib.md5(role.encode()).hexdigest()
                               + hashlib.md5(text.encode()).hexdigest()).encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c > 0 else -1)
        out[c] = own.get(c - rest, [])[:h] + turns[h:]
    return out


def model(rows, rebuild=True):
    seqs = sequences(rows, rebuild)
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[:d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        saved[p] = own + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]),
                    leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n, deep=0):
    rng = random.Random(seed)
    turns = [("user", "hé"), ("assistant", "ok"), (None, "ok"), ("user", None), ("", ""), ("user", "longer text " * 9)]
    convs = []
    for c in range(n):
        if convs and rng.random() < 0.5:
            old = rng.choice(convs)
            convs.append(old[:rng.randrange(len(old) + 1)] + [rng.choice(turns) for _ in range(rng.randrange(3))])
        else:
            convs.append([rng.choice(turns) for _ in range(rng.randrange(1, 12))])
    if deep:
        spine = [("user", str(i % 7)) for i in range(deep)]
        convs += [spine, spine[:deep // 2] + [("user", "fork")], spine, spine[:-1]]
    rows = []
    for c, conv in enumerate(convs):
        rows += [(c * 3 % (2 * len(convs)) - 7, i, r, t, 0, "x", 1) for i, (r, t) in enumerate(conv)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("group_rows", [1, 40, pt.GROUP_ROWS])
def test_trie_equals_brute_force(spark, group_rows):
    rows = planted(group_rows, 60, deep=40 if group_rows > 1 else 0)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.prefix_trie(df, rebuild=True, group_rows=group_rows)) == model(rows)


def test_trie_without_rebuilding(spark):
    rows = planted(3, 40, deep=300)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = pt.prefix_trie(df, group_rows=200)
    assert got(nodes) == model(rows, rebuild=False)
    seqs = sequences(rows, False)
    for r in pt.node_texts(nodes, df).collect():
        turn = seqs[r.conv_id][r.depth - 1] if r.depth else (None, None)
        assert (r.role or "", r.text or "") == (turn[0] or "", turn[1] or "")


def test_trie_edges(spark):
    rows = [(1, None, "user", "a", 0, "x", 1), (1, 0, None, None, 0, "x", 1), (1, 0, None, None, 0, "x", 1),
            (None, 0, "user", "a", 0, "x", 1), (2, 5, "user", "x" * 100_000, 0, "x", 1), (None,) * 7,
            (10 ** 12, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for rebuild in (False, True):
        assert got(pt.prefix_trie(df, rebuild=rebuild)) == model(rows, rebuild)
    assert got(pt.prefix_trie(df.limit(0), rebuild=True)) == []


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 8)
    rows = [(c, 0, "user", "same", 0, "x", 1) for c in range(-20, 300)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == model(rows, rebuild=False)


def test_running_sums_of_a_group_over_many_partitions(spark):
    from pyspark.sql import functions as F
    rows = [(c, i, (c * 1_000_003 + i * i * 7_919 << 40) & (1 << 61) - 1) for c, n in ((1, 5), (2, 4000), (3, 1))
            for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(6)
    out = pt.running_sums(df, "g", [F.col("i")], ["v"])
    total = collections.Counter()
    want = []
    for c, i, v in rows:
        total[c] += v
        want.append((c, i, v, i + 1, total[c] & (1 << 61) - 1))
    assert sorted(tuple(r) for r in out.collect()) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(op12_prefix_trie(spark, sf)) == model(rows)
