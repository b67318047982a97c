"""Segmented index: refreshes add segments, searches equal a rebuild."""

import datetime as dt

from helpers import entries_df, queries_df

from quire.operators import index as ix
from quire.operators import lexical, segments
from quire.session import fresh_path

WORDS = "red green blue stone river cloud north seven".split()


def line(i, extra=""):
    return f"- {dt.date(2024, 1, 1) + dt.timedelta(i)}: {WORDS[i % 8]} {WORDS[i * i % 7]} {WORDS[i // 3 % 5]} {extra}"


def found(index, q):
    return sorted(tuple(r) for r in lexical.bm25_topk(index, q, 50).collect())


def rebuilt(spark, rows):
    return ix.write_index(ix.build_index(entries_df(spark, rows)), fresh_path(spark, "t-index"))


def test_refreshes_equal_a_rebuild(spark, monkeypatch):
    q = queries_df(spark, [(1, "red river"), (2, "fresh stone stone"), (3, "absent"), (4, "only")])
    rows = {i: (i, "t", line(i, "only" if i == 7 else "")) for i in range(60)}
    base = fresh_path(spark, "t-index")
    ix.write_index(ix.build_index(entries_df(spark, list(rows.values()))), base)
    version = segments.create(spark, base)
    steps = [([3, 7, 999], [(100, "t", line(5, "fresh")), (4, "t", line(9, "fresh fresh"))]),
             ([100], [(101, "u", line(1)), (102, "u", "- 2024-05-01: ")]), (list(range(20)), [])]
    for removed, added in steps:
        old = version
        before = found(segments.read(spark, old), q)
        gone = spark.createDataFrame([(i,) for i in removed], "entry_id bigint")
        version = segments.refresh(spark, version, gone, entries_df(spark, added))
        for i in removed:
            rows.pop(i, None)
        rows |= {r[0]: r for r in added}
        want, got = rebuilt(spark, list(rows.values())), segments.read(spark, version)
        assert found(got, q) == found(want, q)
        assert got.stats.collect() == want.stats.collect()
        assert sorted(tuple(r) for r in got.term_stats.collect()) == \
            sorted((r.term, r.df) for r in want.term_stats.collect())
        assert found(segments.read(spark, old), q) == before      # versions stay as they were
    merged = segments.merge(spark, version)
    assert len(segments._manifest(spark, merged)) == 1
    assert found(segments.read(spark, merged), q) == found(got, q)


def test_a_refresh_writes_only_its_changes(spark):
    base = fresh_path(spark, "t-index")
    ix.write_index(ix.build_index(entries_df(spark, [(i, "t", line(i)) for i in range(40)])), base)
    version = segments.refresh(spark, segments.create(spark, base),
                               spark.createDataFrame([(1,)], "entry_id bigint"), entries_df(spark, [(50, "t", line(2))]))
    first, second = segments._manifest(spark, version)
    assert first[:2] == (0, base)
    assert ix.read_index(spark, second[1]).docs.count() == 1
    assert spark.read.parquet(second[2]).count() == 1
