"""The trie of conversation prefixes, by truncation peeling.

A conversation is a sequence of turns (role, text); a node is a distinct
prefix. The trie is discovered from its deepest level upwards: the nodes of a
level are the nodes that survive from below plus the conversations that end
there; both are merged by the key of their prefix, their aggregates are added,
the last turn is stripped and the rest regroups one level higher. Copies merge
where they end, so a node is carried once however many conversations share it.

* A prefix is known by two 61-bit sums of hashes of its turns, each salted
  with its place, so the key of the prefix without its last turn is a
  subtraction. The sums are running sums over range partitions with carried
  totals: a conversation that holds a third of all rows is spread over tasks.
* A wide level is one aggregation and one equality join on the cluster. Levels
  of which no subtree holds more than ``GROUP_ROWS`` turns are peeled together,
  subtree by subtree in tasks; ranges are halved until that holds, so a few
  very long conversations don't cost a job a level. Both ways give the same
  rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, sorted_runs, to_batch

GROUP_ROWS = 1 << 14     # turns of one subtree that a task peels
CHUNK_IDS = 1 << 16      # conversation ids in one piece of a node's list
_MASK = (1 << 61) - 1
_RECORD = ("depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, n_convs bigint, "
           "n_children bigint, n_leaves bigint, saved_tokens bigint")
_CHUNK = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()),
                    ("ids", pa.binary())])


def _masked(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


# ------------------------------------------------------------ running sums --

def _scan(group: str, sums: list[str]):
    """Running counts and sums (mod 2^61) by group over a sorted partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy()
            values = [np.ones(len(g), dtype=np.uint64)] + [b.column(c).to_numpy().view(np.uint64) for c in sums]
            new = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            out = []
            for i, v in enumerate(values):
                total = np.zeros(len(g) + 1, dtype=np.uint64)
                np.cumsum(v, out=total[1:])
                at = total[1:] - total[start]
                if not new[0]:
                    own = start == 0
                    at[own] += held[i]
                out.append(at)
            last, held = g[-1], [c[-1] for c in out]
            names = ["nth", *(f"sum_{c}" for c in sums), "part"]
            extra = [pa.array((c & np.uint64(_MASK)).view(np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra, pa.array(np.full(len(g), part, dtype=np.int64))],
                                             names=[*b.schema.names, *names])

    return run


def running_sums(rows: DataFrame, group: str, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with ``nth`` (from 1) and ``sum_<c>`` (mod 2^61) of each bigint
    column of ``sums``, running within ``group`` (bigint, not null) by ``order``.

    Rows are dealt by ranges of (group, order), so a large group spans tasks.
    Only groups that span partitions need what came before: at most one at
    each border, so that table has fewer than two rows a partition."""
    added = ["nth", *(f"sum_{c}" for c in sums)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    local = materialise(ranged.mapInArrow(_scan(group, sums), schema + "".join(f", {c} bigint" for c in added)
                                          + ", part bigint"), "running")
    totals = local.groupBy(group, "part").agg(F.max(F.struct(*added)).alias("t"))
    spans = totals.join(totals.groupBy(group).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), group) \
        .select(group, "part", "t.*").orderBy(group, "part").collect()
    carry, last, so_far = [], None, [0] * len(added)
    for r in spans:
        if r[0] != last:
            last, so_far = r[0], [0] * len(added)
        carry.append((r[0], r[1], *so_far))
        so_far = [(a + b) & _MASK for a, b in zip(so_far, r[2:])]
    if not carry:
        return local.drop("part")
    before = rows.sparkSession.createDataFrame(
        carry, f"`{group}` bigint, part bigint" + "".join(f", b_{c} bigint" for c in added))
    return local.join(F.broadcast(before), [group, "part"], "left").select(
        *[F.col(f"`{f.name}`") for f in rows.schema.fields],
        *[_masked(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in added])


# ------------------------------------------------------------------- turns --

def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, d, turn_key, n_bytes): each conversation's turns numbered from
    1 by ``turn_col`` (null first, then by a hash of the turn). A null role or
    text is empty; rows without a conversation id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("turn_key"),
        F.octet_length(text).cast("bigint").alias("n_bytes"))
    rows = materialise(rows, "turns")  # narrow; the range partitioning samples it first
    return running_sums(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("turn_key")], []) \
        .select("conv_id", F.col("nth").alias("d"), "turn_key", "n_bytes")


def rebuilt_turns(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c with its first h turns replaced by
    the first h of conversation c - c % ``family`` (all if fewer, none if
    absent); h = crc32(decimal c) % ``most``. A head goes to fewer than
    2 * ``family`` conversations, ``most`` - 1 turns each."""
    turns = materialise(turns, "ordered")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ids = materialise(ids.join(bases, "base", "left").withColumn(
        "shared", F.least("h", F.coalesce("n_base", F.lit(0)))), "conversations")
    heads = turns.where(F.col("d") < most).withColumnRenamed("conv_id", "base") \
        .join(ids.where("shared > 0").select("conv_id", "base", "shared"), "base").where("d <= shared") \
        .select("conv_id", "d", "turn_key", "n_bytes")
    tails = turns.where(F.col("d") > 0).join(ids.where("n > h").select("conv_id", "h", "shared"), "conv_id") \
        .where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("shared")).alias("d"), "turn_key", "n_bytes")
    return heads.unionByName(tails), ids.select("conv_id")


# ----------------------------------------------------------------- peeling --

_PATH = ["d", "k1", "k2", "l1", "l2", "n_bytes", "stop", "rep", "n", "kids", "leaves", "saved"]


def _peeled(columns: list[np.ndarray]) -> list[tuple]:
    """The nodes of whole subtrees, from the deepest level up. A row is a turn
    of a conversation; ``stop`` is the depth to which that reaches, and at which
    its counts join the node."""
    def add(nodes: dict, key: tuple, rep: int, *counts: int) -> None:
        got = nodes.get(key)
        nodes[key] = (rep, *counts) if got is None else \
            (min(got[0], rep), *(a + b for a, b in zip(got[1:], counts)))

    order = np.argsort(-columns[0], kind="stable")
    columns = [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), len(order)]
    out, from_below = [], {}
    for s, e in zip(cuts, cuts[1:]):
        d, nodes, turn = int(columns[0][s]), from_below, {}
        for k1, k2, l1, l2, size, stop, *counts in zip(*(c[s:e].tolist() for c in columns[1:])):
            turn[k1, k2] = ((k1 - l1) & _MASK, (k2 - l2) & _MASK, size)
            if stop == d:
                add(nodes, (k1, k2), *counts)
        from_below = {}
        for key, (rep, n, kids, leaves, saved) in nodes.items():
            p1, p2, size = turn[key]
            leaves, saved = leaves if kids else 1, saved + (n - 1) * size
            out.append((d, *key, p1, p2, rep, n, kids, leaves, saved))
            add(from_below, (p1, p2), rep, n, 1, leaves, saved)
    return out


def _peel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels a partition sorted by subtree, some whole subtrees at a time."""
    names = [f.split()[0] for f in _RECORD.split(", ")]
    for _, _, columns in sorted_runs(batches, ["a1", "a2"], _PATH, 4 * GROUP_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*_peeled(columns[2:]))], names=names)


def _largest(live: DataFrame, rows: DataFrame, lo: int) -> int:
    """Turns above level ``lo`` of the largest subtree."""
    return _rooted(live, rows, lo).groupBy("a1", "a2").agg(F.sum(F.col("stop") - lo).alias("n")) \
        .agg(F.max("n")).first()[0] or 0


def _rooted(live: DataFrame, rows: DataFrame, lo: int) -> DataFrame:
    """``live`` with the key of each row's prefix of ``lo`` turns."""
    if not lo:
        return live.withColumns({"a1": F.lit(0).cast("bigint"), "a2": F.lit(0).cast("bigint")})
    at = rows.where(F.col("d") == lo).select(F.col("conv_id").alias("rep"), F.col("k1").alias("a1"),
                                             F.col("k2").alias("a2"))
    return live.join(at, "rep")


def _merged(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("k1", "k2").agg(
        F.min("rep").alias("rep"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")])


def trie(turns: DataFrame, ids: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv_id, d from 1 without gaps,
    turn_key, n_bytes); ``ids`` (conv_id) are all conversations, turnless ones
    too. One row a node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1)
    times the bytes of the last text), ends_sha256 (the decimal ids of the
    members that end there, ascending, joined by commas).

    Edge cases: no conversations give no rows, not even a root; turnless ones
    belong to the root alone; equal conversations are one path. Prefixes are
    told apart by 122 hash bits."""
    rows = turns.withColumns({
        "l1": _masked(F.xxhash64("d", "turn_key")), "l2": _masked(F.xxhash64("turn_key", "d", F.lit(1)))})
    rows = running_sums(materialise(rows, "rebuilt"), "conv_id", [F.col("d")], ["l1", "l2"])
    rows = materialise(rows.select("conv_id", "d", "n_bytes", "l1", "l2", F.col("sum_l1").alias("k1"),
                                   F.col("sum_l2").alias("k2")).sortWithinPartitions("d"), "prefixes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("d", "k1", "k2")).alias("e")).select("conv_id", "e.*")
    zero = F.lit(0).cast("bigint")
    ends = ids.distinct().join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("d", "k1", "k2")])
    ends = materialise(ends, "ends")
    merged = materialise(ends.groupBy("d", "k1", "k2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                         .select(F.col("d").alias("stop"), "k1", "k2", "rep", "n", zero.alias("kids"),
                                 zero.alias("leaves"), zero.alias("saved")), "merged")
    records, arrived = [], None
    top = merged.agg(F.max("stop")).first()[0]
    ranges = [(0, top)] if top else []
    while ranges:
        lo, hi = ranges.pop()
        live = merged.where((F.col("stop") > lo) & (F.col("stop") <= hi))
        if arrived is not None:
            live = live.unionByName(arrived)
        if hi - lo > 1 and _largest(live, rows, lo) > group_rows:
            ranges += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            continue
        if hi - lo > 1:
            some = rows.where((F.col("d") > lo) & (F.col("d") <= hi)).withColumnRenamed("conv_id", "rep")
            paths = _rooted(live.drop("k1", "k2"), rows, lo).join(some, "rep").where("d <= stop")
            nodes = paths.repartition("a1", "a2").sortWithinPartitions("a1", "a2") \
                .select("a1", "a2", *_PATH).mapInArrow(_peel, _RECORD)
        else:
            turn = rows.where(F.col("d") == hi).select(F.col("conv_id").alias("rep"), "l1", "l2", "n_bytes")
            nodes = _merged(live).join(turn, "rep").select(
                F.lit(hi).cast("bigint").alias("depth"), "k1", "k2", _masked(F.col("k1") - F.col("l1")).alias("p1"),
                _masked(F.col("k2") - F.col("l2")).alias("p2"), F.col("rep").alias("conv_id"),
                F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).alias("n_leaves"),
                (F.col("saved") + (F.col("n") - 1) * F.col("n_bytes")).alias("saved_tokens"))
        nodes = materialise(nodes, f"nodes-{hi}")
        records.append(nodes)
        arrived = nodes.where(F.col("depth") == lo + 1).groupBy("p1", "p2").agg(
            F.min("conv_id").alias("rep"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("kids"),
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")) \
            .select(F.lit(lo).cast("bigint").alias("stop"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "rep",
                    "n", "kids", "leaves", "saved")
    root = merged.where("stop = 0")
    if arrived is not None:
        root = root.unionByName(arrived)
    nodes = _merged(root).select(
        zero.alias("depth"), "k1", "k2", F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
        F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).cast("bigint").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"))
    for some in records:
        nodes = nodes.unionByName(some)
    nodes = materialise(nodes, "trie")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["depth", "p1", "p2"], "left").join(_end_lists(ends), ["depth", "k1", "k2"], "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


# ------------------------------------------------------------ lists of ends --

def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's ids, joined by node in pieces of bounded size."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy() for c in ("depth", "k1", "k2")]
        ids = b.column("conv_id").to_pylist()
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        at = np.flatnonzero(new | (np.arange(len(ids)) % CHUNK_IDS == 0))
        cut = [*at.tolist(), len(ids)]
        joined = [",".join(map(str, ids[s:e])).encode() for s, e in zip(cut, cut[1:])]
        yield to_batch(_CHUNK, [*(k[at] for k in keys), [ids[s] for s in at], joined])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in order; one piece in memory at a time."""
    key, digest = None, None
    names = ["depth", "k1", "k2", "ends_sha256"]
    for b in batches:
        done = []
        for *now, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))):
            if now != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], names=names)


def _end_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256). The ids of a node are dealt by ranges and
    joined to pieces by many tasks; only the hash, which is sequential by
    definition, reads a node's pieces one after the other."""
    keys = ["depth", "k1", "k2"]
    rows = ends.select(F.col("d").alias("depth"), "k1", "k2", "conv_id")
    pieces = rows.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id") \
        .mapInArrow(_pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids binary")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first") \
        .mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# ---------------------------------------------------------------- operators --

def prefix_trie(conversations: DataFrame, rebuild: bool = False, group_rows: int = GROUP_ROWS, **columns) -> DataFrame:
    """Nodes of the prefix trie of ``conversations`` (see :func:`trie`), with
    ``rebuild`` of the conversations of :func:`rebuilt_turns`.

    Edge cases: null roles and texts are empty, null turns come first, equal
    turn numbers are ordered by a hash of the turn; rows without an id take no
    part; repeated rows are turns of their own; other columns are not read."""
    turns = ordered_turns(conversations, **columns)
    if rebuild:
        return trie(*rebuilt_turns(turns), group_rows)
    turns = materialise(turns, "ordered")
    return trie(turns, turns.select("conv_id").distinct(), group_rows)


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of ``prefix_trie(conversations)`` with the role and text of their
    last turn (null for the root), from their smallest member."""
    rows = conversations.where("conv_id is not null")
    key = F.unhex(F.md5(F.concat(*[F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text")])))
    texts = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), key.alias("turn_key"), "role", "text")
    at = ordered_turns(conversations).select("conv_id", F.col("d").alias("depth"), "turn_key")
    found = nodes.join(at, ["conv_id", "depth"], "left")
    return found.join(texts.dropDuplicates(["conv_id", "turn_key"]), ["conv_id", "turn_key"], "left").drop("turn_key")
