"""Line edits replayed in request order (M2, M3).

A request (topic, req_seq, old_line, new_line) replaces the first line of the
topic that equals ``old_line`` at that time; a null ``new_line`` removes it.

* A value that no request writes is a plain queue: its n-th request takes its
  n-th copy. Both are numbered by occurrence ranks over range partitions and
  joined, so a line repeated millions of times is spread over tasks.
* Values that are written as well as taken (a becomes b, then b becomes c) are
  replayed: rounds of bounded blocks of a topic's requests meet the few first
  copies that they can take. Only such requests go that way.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

BLOCK_REQUESTS = 4096   # requests of one topic replayed by one task in one round
_STEPS = "topic string, req_rank bigint, seq bigint"
_MOVES = "topic string, seq bigint, line string"


def occurrence_ranks(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: the row's place (from 1) within ``keys`` by ``order``.
    Rows are dealt by ranges of (keys, order) and numbered within their
    partition; counts per key and partition give the offsets, so a hot key is
    never sorted in one task. Eager: the dealt rows are written."""
    # written first: the ranges are sampled from it
    df = cut_lineage(df, "unranked")
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return dealt.withColumn("_i", F.row_number().over(inside)).join(offsets, [*keys, "_part"]) \
        .withColumn(name, F.col("_offset") + F.col("_i")).drop("_i", "_offset", "_part")


def _replay(requests: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
    """One topic's block of requests against the first copies of the values
    they take: the steps (``line`` unused) and the moves of lines, in one
    table. A copy moved in this block may be taken again."""
    heaps: dict[str, list[int]] = {}
    for seq, line in zip(copies["seq"].tolist(), copies["line"]):
        heaps.setdefault(line, []).append(seq)
    for heap in heaps.values():
        heapq.heapify(heap)
    steps, moved, topic = [], {}, None
    requests = requests.sort_values("req_rank")
    for topic, rank, old, new in zip(requests["topic"], requests["req_rank"].tolist(), requests["old_line"],
                                     requests["new_line"]):
        heap = heaps.get(old)
        seq = heapq.heappop(heap) if heap else None
        steps.append((topic, rank, seq, None, True))
        if seq is not None:
            new = None if pd.isna(new) else new
            moved[seq] = new
            if new is not None:
                heapq.heappush(heaps.setdefault(new, []), seq)
    rows = steps + [(topic, None, seq, line, False) for seq, line in moved.items()]
    return pd.DataFrame(rows, columns=["topic", "req_rank", "seq", "line", "is_step"]).astype(
        {"req_rank": "Int64", "seq": "Int64"})


def _chained(lines: DataFrame, requests: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(steps, moves) of requests on values that are also written."""
    spark = lines.sparkSession
    requests = cut_lineage(occurrence_ranks(requests, ["topic"], ["req_seq", "old_line", "new_line"], "req_rank"), "requests")
    last = requests.agg(F.max("req_rank")).first()[0] or 0
    taken = requests.select("topic", F.col("old_line").alias("line")).distinct()
    state = cut_lineage(lines.select("topic", "seq", "line").join(taken, ["topic", "line"], "left_semi")
                        .select("topic", "seq", "line"), "state")
    steps = spark.createDataFrame([], _STEPS)
    moves = spark.createDataFrame([], _MOVES)
    for at in range(0, last, block):
        now = requests.where((F.col("req_rank") > at) & (F.col("req_rank") <= at + block))
        need = now.groupBy("topic", F.col("old_line").alias("line")).agg(F.count(F.lit(1)).alias("need"))
        first = Window.partitionBy("topic", "line").orderBy("seq")
        copies = state.join(need, ["topic", "line"]).withColumn("i", F.row_number().over(first)) \
            .where((F.col("i") <= block) & (F.col("i") <= F.col("need"))).select("topic", "seq", "line")
        left, right = now.select(*[F.col(c).alias(c) for c in now.columns]), copies
        done = cut_lineage(left.groupBy("topic").cogroup(right.groupBy("topic")).applyInPandas(
            _replay, "topic string, req_rank bigint, seq bigint, line string, is_step boolean"), "replayed")
        steps = steps.unionByName(done.where("is_step").select("topic", "req_rank", "seq"))
        moved = done.where("not is_step").select("topic", "seq", "line")
        moves = cut_lineage(moves.join(moved, ["topic", "seq"], "left_anti").unionByName(moved), "moves")
        if at + block < last:
            state = cut_lineage(state.join(moved, ["topic", "seq"], "left_anti").unionByName(
                moved.where("line is not null").join(taken, ["topic", "line"], "left_semi")
                .select("topic", "seq", "line")), "state")
    told = requests.join(steps, ["topic", "req_rank"], "left").select("topic", "req_seq", "old_line", "new_line", "seq")
    return told, moves


def replay_edits(lines: DataFrame, requests: DataFrame, block: int = BLOCK_REQUESTS) -> tuple[DataFrame, DataFrame]:
    """(lines after all requests, outcomes). ``lines`` = (topic, seq, line and
    any others), seq unique in a topic; ``requests`` = (topic, req_seq,
    old_line, new_line), in order of ``req_seq`` (equal ones: by old, then new
    line). Outcomes tell each request's ``seq``, null where no line was found.

    Null topics or old lines find nothing; repeated requests are requests of
    their own."""
    req = cut_lineage(requests.select("topic", F.col("req_seq").cast("bigint").alias("req_seq"), "old_line", "new_line"),
                      "edits")
    known = req.where("topic is not null and old_line is not null")
    old = known.select("topic", F.col("old_line").alias("line")).distinct()
    both = old.join(known.select("topic", F.col("new_line").alias("line")).distinct(), ["topic", "line"], "left_semi")
    feeding = known.join(both.withColumnRenamed("line", "new_line"), ["topic", "new_line"], "left_semi") \
        .select("topic", F.col("old_line").alias("line"))
    tied = cut_lineage(both.unionByName(feeding).distinct().withColumnRenamed("line", "old_line"), "tied-values")

    plain = known.join(tied, ["topic", "old_line"], "left_anti")
    ranked = occurrence_ranks(plain, ["topic", "old_line"], ["req_seq", "new_line"])
    counts = ranked.groupBy("topic", "old_line").agg(F.max("rank").alias("most"))
    wanted = lines.select("topic", "seq", F.col("line").alias("old_line")).join(counts, ["topic", "old_line"])
    copies = occurrence_ranks(wanted, ["topic", "old_line"], ["seq"]).where("rank <= most").drop("most")
    told = cut_lineage(ranked.join(copies, ["topic", "old_line", "rank"], "left")
                       .select("topic", "req_seq", "old_line", "new_line", "seq"), "outcomes")
    moves = told.where("seq is not null").select("topic", "seq", F.col("new_line").alias("line"))
    if not tied.isEmpty():
        chained, moved = _chained(lines, known.join(tied, ["topic", "old_line"], "left_semi"), block)
        told, moves = told.unionByName(chained), moves.unionByName(moved)
    unknown = req.where("topic is null or old_line is null").withColumn("seq", F.lit(None).cast("bigint"))
    moves = moves.select("topic", "seq", F.struct("line").alias("_to"))
    after = lines.join(moves, ["topic", "seq"], "left").where("_to is null or _to.line is not null") \
        .withColumn("line", F.coalesce("_to.line", "line")).select(*lines.columns)
    return after, told.unionByName(unknown)
