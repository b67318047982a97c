"""Writing the index and the vectors with no more work than the rows need."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import entries_df
from quire.functions import text
from quire.operators import index as ix
from quire.operators import segments, vectors
from quire.session import fresh_path

TEXTS = ["Kiln, GLAZE kiln", "", "  ", None, "end", "start İstanbul naïve ÅNGSTRÖM", "١٢ ⅷ a b c d—e", "x\n\ty_z\x7fß", "!"]


def test_tokens_of_the_byte_table_are_those_of_the_regex(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, d string").coalesce(1)
    rows = df.select("i", text.tokenize("d").alias("t"), text.token_text("d").alias("x")).orderBy("i").collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r.x for r in rows], pa.string())], names=["x"])
    for part in (batch, batch.slice(3)):
        got = []
        for _, lens, codes, distinct in text.token_slices([part], "x"):
            tokens = iter(distinct.take(pa.array(codes)).to_pylist())
            got += [[next(tokens) for _ in range(n)] for n in lens]
        assert got == [r.t or [] for r in rows[len(rows) - part.num_rows:]]


def postings(index):
    return sorted(map(tuple, index.postings.select("term", "entry_id", "tf", "dl").collect()), key=str)


@pytest.mark.parametrize("ids, adds_up", [([1, 2, 3, None], 0), ([1, 2, 2, 3], 1), ([None, None, 1, 2], 1)])
def test_counts_are_added_up_only_where_an_id_repeats(spark, monkeypatch, ids, adds_up):
    e = entries_df(spark, [(i, "log", f"- 2025-03-09: kiln glaze kiln pot{n % 2}") for n, i in enumerate(ids)])
    lazy = ix.build_index(e)
    want, calls, real = postings(lazy), [], ix._added_up
    monkeypatch.setattr(ix, "_added_up", lambda counts: calls.append(1) or real(counts))
    written = ix.write_index(lazy, fresh_path(spark, "t-index"))
    assert postings(written) == want and len(calls) == adds_up


def test_small_changes_do_not_shuffle_the_vectors(spark):
    e = entries_df(spark, [(i, "t", f"- 2026-01-01: word{i} common") for i in [*range(30), None]])
    gone = e.where(F.col("entry_id") % 5 == 0).select("entry_id")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        vecs = vectors.embed_entries(e)
        new = vectors.embed_entries(e.where("entry_id < 3"))
        for out, n in ((vectors.delete(vecs, gone), 25), (vectors.upsert(vecs, new), 31)):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == n
        base = fresh_path(spark, "t-index")
        ix.write_index(ix.build_index(e), base)
        after = segments.read(spark, segments.refresh(spark, segments.create(spark, base), gone, e.limit(0)))
        assert after.docs.count() == 25
    finally:
        spark.conf.set(key, before)
