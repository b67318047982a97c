"""BM25, vector and hybrid search on small corpora (mirrors the reference's
search tests) plus index refresh = rebuild."""

import pytest
from pyspark.sql import functions as F

from helpers import entries_df, queries_df
from quire.functions import as_of_day
from quire.operators import index as ix
from quire.operators import lexical, search, similarity, similarity_join, vectors
from quire.session import fresh_path


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("query_id", "rank").collect()]


def test_exact_term_hit(spark):
    e = entries_df(spark, [(1, "log", "- 2025-03-09: Kiln fired twice"), (2, "log", "- 2025-03-09: glaze mixed")])
    out = lexical.bm25_topk(ix.build_index(e), queries_df(spark, [(1, "KILN")]), 10, entries=e)
    got = rows(out, "entry_id", "line")
    assert got[0] == (1, "- 2025-03-09: Kiln fired twice")
    assert len(got) == 1  # only entries sharing a term score > 0


def test_empty_index_and_empty_query(spark):
    e = entries_df(spark, [])
    assert lexical.bm25_topk(ix.build_index(e), queries_df(spark, [(1, "anything")]), 10).count() == 0
    e2 = entries_df(spark, [(1, "notes", "- 2026-04-28: something")])
    assert lexical.bm25_topk(ix.build_index(e2), queries_df(spark, [(1, "!!!")]), 10).count() == 0


def test_limit(spark):
    e = entries_df(spark, [(i, "log", f"- 2025-03-09: kiln{i % 2} glaze pot{i}") for i in range(9)])
    out = lexical.bm25_topk(ix.build_index(e), queries_df(spark, [(1, "glaze")]), 4)
    assert rows(out, "entry_id", "rank") == [(i, i + 1) for i in range(4)]


def test_duplicate_query_terms_add(spark):
    e = entries_df(spark, [(1, "n", "- 2026-04-28: apple pie"), (2, "n", "- 2026-04-28: banana")])
    idx = ix.build_index(e)
    one = lexical.bm25_topk(idx, queries_df(spark, [(1, "apple")]), 5).first().score
    two = lexical.bm25_topk(idx, queries_df(spark, [(1, "apple apple")]), 5).first().score
    assert two == pytest.approx(2 * one, rel=1e-6)


def test_written_index_reads_only_its_terms_buckets(spark):
    """A written index gives the scores of the lazy one; a rare term reads one
    bucket, a term held by every entry may be spread over several."""
    e = entries_df(spark, [(i, "log", f"- 2025-03-09: shared only{i} mod{i % 7}") for i in range(300)])
    lazy = ix.build_index(e)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        idx = ix.write_index(lazy, fresh_path(spark, "t-index"))
    finally:
        spark.conf.set(key, before)
    n_buckets = idx.postings.select("bucket").distinct().count()
    assert n_buckets > 1
    q = queries_df(spark, [(1, "only7 absent"), (2, "shared mod3 only12")])
    rare = lexical.query_weights(idx, q.where("query_id = 1"))
    assert lexical.postings_of(idx, rare).select("bucket").distinct().count() == 1
    want, got = (sorted((r.query_id, r.entry_id, round(r.score, 9)) for r in lexical.bm25_scores(x, q).collect())
                 for x in (lazy, idx))
    assert got == want and len(got) == 301
    assert {r.term: r.df for r in idx.term_stats.collect()} == {r.term: r.df for r in lazy.term_stats.collect()}
    assert idx.stats.first() == lazy.stats.first()


def test_boost_reorders(spark):
    e = entries_df(spark, [(1, "log", "- 2023-03-09: kiln glaze ash"), (2, "log", "- 2025-03-09: kiln glaze ash [×4]")])
    out = lexical.bm25_boosted(ix.build_index(e), e, queries_df(spark, [(1, "kiln ash")]), as_of_day("2025-03-09"))
    assert [r.entry_id for r in out.orderBy("rank").collect()] == [2, 1]


def test_refresh_equals_rebuild(spark):
    e = entries_df(spark, [(i, "t", f"- 2026-01-0{1 + i % 9}: word{i % 3} common text {i}") for i in range(30)])
    removed = e.where(F.col("entry_id") % 5 == 0).select("entry_id")
    added = entries_df(spark, [(100 + i, "t", f"- 2026-02-01: fresh word{i} common") for i in range(4)])
    changed = entries_df(spark, [(7, "t", "- 2026-03-01: changed line common")])
    refreshed = ix.refresh_index(ix.build_index(e), removed, added.unionByName(changed))
    snapshot = e.join(removed, "entry_id", "left_anti").join(changed.select("entry_id"), "entry_id", "left_anti") \
        .unionByName(added).unionByName(changed)
    rebuilt = ix.build_index(snapshot)
    key = ["term", "entry_id", "tf", "dl"]
    assert sorted(map(tuple, refreshed.postings.select(*key).collect())) == \
        sorted(map(tuple, rebuilt.postings.select(*key).collect()))
    assert refreshed.stats.first().asDict() == rebuilt.stats.first().asDict()


def test_cosine_topk_brute_force(spark):
    e = entries_df(spark, [(i, "t", f"- 2026-01-01: tok{i % 7} tok{i % 5} shared {i}") for i in range(60)])
    v = vectors.embed_entries(e)
    q = search.query_vectors(queries_df(spark, [(1, "tok3 shared"), (2, "tok4 tok1"), (3, "")]))
    got = similarity.topk_cosine(v, q, 5).select("query_id", "entry_id", "sim").collect()
    import numpy as np
    from model import cosine, embed
    lines = {r.entry_id: r.line for r in e.collect()}
    for qid, text in [(1, "tok3 shared"), (2, "tok4 tok1"), (3, "")]:
        qv = embed(text)
        scored = sorted(((-np.round(cosine(qv, embed(l)), 6), i) for i, l in lines.items()))[:5]
        mine = sorted((-np.round(r.sim, 6), r.entry_id) for r in got if r.query_id == qid)
        assert mine == scored


def test_hybrid_and_modes(spark):
    e = entries_df(spark, [(i, "t", f"- 2026-01-0{1 + i % 9}: alpha{i % 4} beta{i % 3} gamma") for i in range(40)])
    idx = ix.build_index(e)
    v = vectors.embed_entries(e)
    q = queries_df(spark, [(1, "alpha1 beta2"), (2, "gamma")])
    day = as_of_day("2026-01-10")
    hyb = search.search(idx, e, q, day, vectors=v, mode="auto", limit=7)
    assert set(r.mode for r in hyb.collect()) == {"hybrid"}
    assert hyb.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 7
    lex = search.search(idx, e, q, day, vectors=None, mode="auto", limit=50)
    assert set(r.mode for r in lex.collect()) == {"lexical"}
    assert lex.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20  # candidate depth
    vec = search.search(idx, e, q, day, vectors=v, mode="vector", limit=3)
    assert vec.count() == 6
    with pytest.raises(ValueError):
        search.search(idx, e, q, day, vectors=None, mode="hybrid")


def test_user_embedder_loaded_once_per_worker(spark):
    import numpy as np

    def load():
        def model(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])
        return model

    emb = vectors.model_embedder(load, 3)
    e = entries_df(spark, [(1, "t", "aaa"), (2, "t", "bbbb"), (3, "t", "ab")])
    got = {r.entry_id: list(r.embedding) for r in vectors.embed_entries(e, embed=emb).collect()}
    assert got[1] == [3.0, 3.0, 1.0] and got[2] == [4.0, 0.0, 1.0]


def test_cosine_topk_blocked_path_equals_broadcast(spark, monkeypatch):
    e = entries_df(spark, [(i, "t", f"- 2026-01-01: tok{i % 7} tok{i % 5} shared {i}") for i in range(80)])
    v = vectors.embed_entries(e)
    q = search.query_vectors(queries_df(spark, [(i, f"tok{i % 7} shared tok{i % 3}") for i in range(12)]))
    want = sorted(map(tuple, similarity.topk_cosine(v, q, 5).select("query_id", "rank", "entry_id").collect()))
    monkeypatch.setattr(similarity, "MAX_QUERY_CELLS", 64 * 4)  # 12 queries no longer fit
    got = sorted(map(tuple, similarity.topk_cosine(v, q, 5).select("query_id", "rank", "entry_id").collect()))
    assert got == want and len(got) == 60


def test_products_of_several_query_chunks(monkeypatch):
    """More queries than one product holds: the same local top-k."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(4)
    rows_ = pd.DataFrame({"entry_id": range(30), "v": list(rng.integers(0, 5, (30, 8)).astype(float))})
    q = similarity._matrix(pd.Series(list(rng.integers(0, 5, (11, 8)).astype(float))))

    def run():
        out = pd.concat(similarity._topk_fn(np.arange(11), q, 3, "entry_id", [], "v")(iter([rows_])))
        return sorted(zip(out["query_id"], out["entry_id"], out["sim"].round(9)))

    want = run()
    monkeypatch.setattr(similarity, "PRODUCT_CELLS", 60)  # two queries a product
    assert run() == want and len(want) >= 33


def test_topk_keeps_all_near_ties(spark):
    """More ties below the best than any slack, and the best with the largest id."""
    import numpy as np
    from quire.operators import similarity

    def unit(c):
        return [float(c), float(np.sqrt(1 - c * c))]
    rows = [(i, "t", unit(0.9453124)) for i in range(40)] + [(99, "t", unit(0.9453125))]
    v = spark.createDataFrame(rows, "entry_id bigint, topic string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    got = similarity.topk_cosine(v.coalesce(1), q, 1).collect()
    assert [r.entry_id for r in got] == [99]


def test_topk_emits_k_rows_however_many_tie(spark):
    import numpy as np
    import pandas as pd
    from quire.operators import similarity
    batch = pd.DataFrame({"entry_id": np.arange(5_000)[::-1], "embedding": [[1.0, 2.0]] * 5_000})
    run = similarity._topk_fn(np.array([7]), similarity._matrix(pd.Series([[2.0, 1.0]])), 20, "entry_id", [], "embedding")
    out = pd.concat(run(iter([batch])))
    assert sorted(out["entry_id"]) == list(range(20))


def test_stale_vectors_are_not_found_in_any_mode(spark, tmp_dir):
    from helpers import dated_entries
    entries = dated_entries(spark, [(i, "t", "2024-01-01", f"note number {i}", 1) for i in range(3)])
    idx = ix.write_index(ix.build_index(entries), f"{tmp_dir}/stale")
    vecs = vectors.embed_entries(entries)
    stale = vecs.withColumn("entry_id", vecs.entry_id + 1_000)
    for k in range(2, 12):
        stale = stale.unionByName(vecs.withColumn("entry_id", vecs.entry_id + 1_000 * k))
    q = spark.createDataFrame([(1, "note number 1")], "query_id bigint, query string")
    for mode in ("vector", "hybrid"):
        out = search.search(idx, None, q, as_of_day("2024-06-01"), vectors=vecs.unionByName(stale), mode=mode).collect()
        assert len(out) == 3
    for bad in (-1, 1.5, True, None):
        with pytest.raises(ValueError):
            search.search(idx, None, q, 0, limit=bad)


def test_cosine_of_null_and_mixed_lengths(spark):
    import pandas as pd
    from quire.operators import similarity
    a = similarity._matrix(pd.Series([[1.0, 0.0], None, [1.0, 0.0, 0.0]]))
    assert similarity.cosine_matrix(a, a).tolist() == [[1, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_best_match_takes_the_larger_similarity(spark):
    import numpy as np
    from quire.operators import similarity

    def unit(c):
        return [float(c), float(np.sqrt(1 - c * c))]
    rows = [(1, "t", 1, unit(0.8499997)), (2, "t", 2, unit(0.8500002)), (3, "t", 3, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "entry_id bigint, topic string, seq bigint, embedding array<double>")
    best = {r.id: r.match_id for r in similarity_join.best_earlier_match(v).collect()}
    assert best[3] == 2


def test_topics_read_back_as_text(spark, tmp_dir):
    from quire.sources import tables
    df = spark.createDataFrame([("007", 1), ("2024", 2)], "topic string, n int")
    tables.append_table(df, f"{tmp_dir}/t", ("topic",))
    assert {r.topic for r in tables.read_table(spark, f"{tmp_dir}/t").collect()} == {"007", "2024"}


def test_top_of_grouped_entries_equals_ranked_scores(spark, monkeypatch):
    """Entries scored in groups of any size, with ties and copies, give the top-k of all (entry, query) scores."""
    e = entries_df(spark, [(i, "t", f"- 2026-01-01: tok{i % 7} tok{i % 5} shared " + "x " * (i % 3)) for i in range(120)])
    idx = ix.build_index(e)
    q = queries_df(spark, [(i, f"tok{i % 7} shared tok{i % 3} x x") for i in range(9)] + [(99, "absent")])
    weights = lexical.query_weights(idx, q)
    out = lambda df: sorted((r.query_id, r.rank, r.entry_id, round(r.score, 9)) for r in df.collect())
    want = out(lexical.ranked(lexical.bm25_scores(idx, q, weights=weights), "score", 4))
    assert len(want) == 36
    for cells in (20, 1_000, 2_000_000):
        arrays = lexical._weight_arrays(weights.select("query_id", "term", "qw").toPandas())
        monkeypatch.setattr(lexical, "SCORE_CELLS", cells)
        assert lexical._score_entries.__globals__["SCORE_CELLS"] == cells and len(arrays[0]) == 9
        assert out(lexical.bm25_top(idx, weights, 4)) == want
    monkeypatch.setattr(lexical, "BROADCAST_MAX_ROWS", 3)   # too many to broadcast: the joined path
    assert out(lexical.bm25_top(idx, weights, 4)) == want
