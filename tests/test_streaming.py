"""Streams equal their batch counterparts."""

from pyspark.sql import functions as F

from model import fold as model_fold
from quire.operators import notes
from quire.plans import catalog
from quire.session import fresh_path
from quire.sources import fixtures as fx
from quire.sources import tables
from quire.streaming import writes as streams

SF = "/root/testdata/sf0.001"


def test_stream_append_equals_batch(spark):
    got = catalog.q_stream_append(spark, SF)
    batch = notes.writes_to_entries(notes.validate_writes(fx.new_writes(spark, SF)).where("accepted"))
    key = ["entry_id", "topic", "line", "seq"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))


def test_stream_topic_counts(spark):
    got = {r.topic: r.n_entries for r in catalog.q_stream_topic_counts(spark, SF).collect()}
    want = {r.topic: r["count"] for r in notes.validate_writes(fx.new_writes(spark, SF))
            .where("accepted").groupBy("topic").count().collect()}
    assert got == want


def test_stream_consolidate_equals_model(spark):
    got = {r.seq: (r.outcome, r.match_seq, r.new_count) for r in catalog.q_stream_consolidate(spark, SF).collect()}
    ws = [dict(seq=r.seq, topic=r.topic, body=r.body, written_on=r.written_on, force=r.force)
          for r in fx.writes(spark, SF).collect()]
    want, _ = model_fold(ws)
    assert got == {s: (o, m, c) for s, (o, m, c) in want.items()}


def test_stream_batches_are_idempotent(spark):
    """Re-running a micro-batch writes the same versioned folders."""
    root = fresh_path(spark, "sf")

    def run():
        ck = fresh_path(spark, "ck")
        catalog.deliver(spark, catalog._entry_feed(spark, SF),
                        lambda feed: streams.stream_consolidate(feed, root, ck), deliveries=2)
        return sorted(map(tuple, tables.read_table(spark, f"{root}/outcomes").collect()))

    first = run()
    # a second run with a fresh checkpoint replays every batch into the same folders
    assert run() == first
    assert streams.latest_batch(spark, f"{root}/live") == 1


def test_a_batch_costs_its_own_topics(spark):
    """Batches read and write their topics only; a restarted stream goes on from there."""
    from helpers import writes_df

    from quire.operators import consolidate
    batches = [[(1, "a", "one red stone", "2024-01-01", False), (2, "007", "two blue rivers", "2024-01-01", False)],
               [(3, "a", "one red stone", "2024-01-02", False)],
               [(4, "c", "green cloud", "2024-01-03", False), (5, "007", "two blue rivers", "2024-01-04", True)]]
    root, ck, feed = fresh_path(spark, "sf"), fresh_path(spark, "ck"), fresh_path(spark, "feed")
    for rows in batches:
        part = writes_df(spark, rows).withColumnsRenamed({"topic": "topic_raw", "body": "body_raw"})
        part.select(*[c.split()[0] for c in streams.WRITE_SCHEMA.split(", ")]).write.mode("append").parquet(feed)
        streams.stream_consolidate(streams.read_write_stream(spark, feed), root, ck)   # a new query each time
    held = [{r.topic for r in spark.read.schema(streams.LIVE_SCHEMA).parquet(f"{root}/live/batch={b}").collect()}
            for b in range(3)]
    assert held == [{"a", "007"}, {"a"}, {"c", "007"}]
    whole = consolidate.fold(writes_df(spark, [r for rows in batches for r in rows])).live
    key = ["topic", "seq", "reinforce_count", "line"]
    got = streams.live_entries(spark, root)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    early = streams.live_entries(spark, root, before=1)
    assert sorted((r.topic, r.seq) for r in early.collect()) == [("007", 2), ("a", 1)]


def test_a_stream_goes_on_from_a_seed(spark):
    from helpers import writes_df

    from quire.operators import consolidate
    seed = consolidate.fold(writes_df(spark, [(1, "a", "one red stone", "2024-01-01", False),
                                              (2, "b", "two blue rivers", "2024-01-01", False)])).live
    seed_path, root, feed = (fresh_path(spark, n) for n in ("seed", "sf", "feed"))
    seed.select(*streams.LIVE_COLS).write.parquet(seed_path)
    part = writes_df(spark, [(3, "a", "one red stone", "2024-02-01", False)]) \
        .withColumnsRenamed({"topic": "topic_raw", "body": "body_raw"})
    part.select(*[c.split()[0] for c in streams.WRITE_SCHEMA.split(", ")]).write.parquet(feed)
    streams.stream_consolidate(streams.read_write_stream(spark, feed), root, fresh_path(spark, "ck"), seed_path)
    got = streams.live_entries(spark, root, seed_path).collect()
    assert sorted((r.topic, r.seq, r.reinforce_count) for r in got) == [("a", 1, 2), ("b", 2, 1)]
