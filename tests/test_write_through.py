"""Writes carried through: change sets, then a search that finds what is new."""

from helpers import queries_df, writes_df

from quire.functions import as_of_day
from quire.operators import consolidate, search, segments, vectors, write_through
from quire.operators import index as ix
from quire.session import fresh_path

BODIES = ["one red stone by the river", "two blue clouds over the hill", "seven green birds in a tree"]


def test_changes_and_search_after_writes(spark):
    seed = consolidate.fold(writes_df(spark, [(i, "t", b, "2024-01-01", False) for i, b in enumerate(BODIES)])).live
    base = fresh_path(spark, "t-index")
    ix.write_index(ix.build_index(seed), base)
    version, vecs = segments.create(spark, base), vectors.embed_entries(seed)
    writes = [(10, "t", BODIES[0], "2024-02-01", False),                       # reaffirms
              (11, "t", BODIES[1] + " today", "2024-02-01", False),            # supersedes
              (12, "t", BODIES[2], "2024-02-01", True),                        # forced: appends a copy
              (13, "t", "nine small lamps", "2024-02-01", False),              # appended, then superseded
              (14, "t", "nine small lamps glow", "2024-02-02", False)]
    result = consolidate.fold(writes_df(spark, writes), seed=seed)
    assert {r.seq: r.outcome for r in result.outcomes.collect()} == {
        10: "reaffirm", 11: "supersede", 12: "append", 13: "append", 14: "supersede"}
    changed = write_through.changes(seed, result)
    assert {(r.entry_id, r.change) for r in changed.collect()} == {
        (0, "update"), (1, "delete"), (11, "insert"), (12, "insert"), (14, "insert")}
    version, vecs = write_through.apply_changes(changed, version, vecs)
    index = segments.read(spark, version)
    rebuilt = ix.build_index(result.live)
    assert sorted(map(tuple, index.postings.select("term", "entry_id", "tf").collect())) == \
        sorted(map(tuple, rebuilt.postings.select("term", "entry_id", "tf").collect()))
    want = vectors.embed_entries(result.live)
    assert sorted(map(str, vecs.select("entry_id", "line", "embedding").collect())) == \
        sorted(map(str, want.select("entry_id", "line", "embedding").collect()))
    q = queries_df(spark, [(1, "blue clouds"), (2, "lamps")])
    for mode in ("lexical", "hybrid"):
        out = search.search(index, None, q, as_of_day("2024-03-01"), vectors=vecs, mode=mode).collect()
        assert (1, 1, 11) in {(r.query_id, r.rank, r.entry_id) for r in out}
        assert not {1, 13} & {r.entry_id for r in out} and 14 in {r.entry_id for r in out if r.query_id == 2}


def test_changes_without_a_seed(spark):
    result = consolidate.fold(writes_df(spark, [(1, "t", BODIES[0], "2024-01-01", False),
                                                (2, "t", BODIES[0], "2024-01-02", False)]))
    assert [(r.entry_id, r.change, r.reinforce_count) for r in write_through.changes(None, result).collect()] == \
        [(1, "insert", 2)]
