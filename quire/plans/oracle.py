"""DuckDB oracle SQL for every query in ``quire.plans.catalog``.

Written independently of the Spark code, from the operator definitions.
Shared derivations are CTE snippets joined into each statement. Tokens use
``\\p{L}`` (RE2 lacks ``IsAlphabetic``; both give the same split on the test
corpus). All numbers are DOUBLE/BIGINT, scores rounded to 6 digits before
ranking, ties broken by id.
"""

from __future__ import annotations

# --- fixed parameters mirrored from the Spark side --------------------------
AS_OF = "DATE '2026-01-01'"
HASH_OFFSET = 1469598103934665603
HASH_PRIME = 1099511628211
DIM = 64
# ---------------------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


ENTRIES = r"""
entries AS (
  SELECT doc_id AS entry_id, lang AS topic,
         CAST(DATE '2024-01-01' + CAST(doc_id % 731 AS INTEGER) AS DATE) AS entry_date,
         regexp_replace(text, '[\r\n]+', ' ', 'g') AS body,
         CAST(1 + doc_id % 4 AS BIGINT) AS reinforce_count,
         doc_id AS seq
  FROM documents
),
entry_lines AS (
  SELECT *, '- ' || strftime(entry_date, '%Y-%m-%d') || ': ' || body ||
            CASE WHEN reinforce_count > 1 THEN ' [×' || CAST(reinforce_count AS VARCHAR) || ']'
                 ELSE '' END AS line
  FROM entries
)"""

QUERIES = """
queries AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qterms AS (
  SELECT query_id, term, COUNT(*) AS qtf
  FROM (SELECT query_id, unnest({qt}) AS term FROM queries)
  GROUP BY query_id, term
)""".format(qt=tokens("query"))


def index_ctes(src: str = "entry_lines") -> str:
    return """
doc_tokens AS (SELECT entry_id, topic, {tk} AS tokens FROM {src}),
docs AS (SELECT entry_id, topic, CAST(len(tokens) AS BIGINT) AS dl FROM doc_tokens),
postings AS (
  SELECT term, entry_id, CAST(COUNT(*) AS BIGINT) AS tf, any_value(dl) AS dl
  FROM (SELECT entry_id, CAST(len(tokens) AS BIGINT) AS dl, unnest(tokens) AS term FROM doc_tokens)
  GROUP BY term, entry_id
),
stats AS (
  SELECT COUNT(*) AS n_docs, CAST(COALESCE(SUM(dl), 0) AS BIGINT) AS total_tokens,
         CASE WHEN COUNT(*) > 0 THEN CAST(SUM(dl) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS avg_dl
  FROM docs
),
dfs AS (SELECT term, COUNT(*) AS df FROM postings GROUP BY term)""".format(tk=tokens("line"), src=src)


BM25_SCORES = """
scores AS (
  SELECT q.query_id, p.entry_id,
         SUM(CAST(q.qtf AS DOUBLE) * ln((CAST(s.n_docs AS DOUBLE) - d.df + 0.5) / (d.df + 0.5) + 1.0)
             * ((CAST(p.tf AS DOUBLE) * (1.2 + 1.0))
                / (CAST(p.tf AS DOUBLE) + 1.2 * (1.0 - 0.75 + 0.75 * CAST(p.dl AS DOUBLE) / s.avg_dl))))
           AS score
  FROM qterms q JOIN postings p USING (term) JOIN dfs d USING (term) CROSS JOIN stats s
  GROUP BY q.query_id, p.entry_id
),
bm25_top AS (
  SELECT query_id, entry_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) AS rank
  FROM scores QUALIFY rank <= 20
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


# Boost of an entry line as of AS_OF (F8), over a relation with `line`.
BOOST_EXPR = r"""
CASE WHEN {d} IS NULL THEN 1.0 ELSE
  exp(-CAST(greatest(date_diff('day', DATE '1970-01-01', {as_of}) - {d}, 0) AS DOUBLE) / 365.0 * ln(2.0))
  * (1.0 + 0.5 * ln(CAST(greatest({c}, 1) AS DOUBLE)))
END"""

ORACLE: dict[str, str] = {}

ORACLE["bm25_topk"] = with_(ENTRIES, QUERIES, index_ctes(), BM25_SCORES) + """
SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.entry_id, e.topic, round(t.score, 6) AS score
FROM bm25_top t JOIN entry_lines e USING (entry_id)"""


# --- scalar helpers ------------------------------------------------------------

def norm_topic(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}-]', '-', 'g'), '-')"


WS = (r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def blank(x: str) -> str:
    return f"(regexp_replace({x}, '{WS}+', '', 'g') = '')"


def epoch_day(s: str) -> str:
    y, m, d = f"substr({s}, 1, 4)", f"substr({s}, 6, 2)", f"substr({s}, 9, 2)"
    yi, mi, di = (f"TRY_CAST({y} AS BIGINT)", f"TRY_CAST(replace({m}, '+', '') AS BIGINT)",
                  f"TRY_CAST(replace({d}, '+', '') AS BIGINT)")
    ok = (f"(strlen({s}) = 10 AND substr({s}, 5, 1) = '-' AND substr({s}, 8, 1) = '-' "
          rf"AND regexp_full_match({y}, '[0-9]{{4}}') "
          rf"AND regexp_full_match({m}, '\+[0-9]|[0-9]{{2}}') "
          rf"AND regexp_full_match({d}, '\+[0-9]|[0-9]{{2}}') "
          f"AND {yi} >= 1970 AND {mi} BETWEEN 1 AND 12 AND {di} BETWEEN 1 AND 31)")
    return (f"(CASE WHEN {ok} THEN date_diff('day', DATE '1970-01-01', "
            f"make_date({yi}, {mi}, 1)) + {di} - 1 END)")


PAT = r"(?s)\A- ([0-9-]{10}): (.*?)(?: \[×\+?([0-9]+)\])?\z"


def parsed(src: str, id_col: str = "entry_id", extra: str = "") -> str:
    """CTE body: parse `line` of `src` into p_date / p_body / p_count."""
    return f"""
SELECT {id_col}, line{extra}, p_d AS p_date,
       CASE WHEN p_d <> '' THEN (CASE WHEN has_c THEN lazy_body ELSE substr(line, 15) END) END AS p_body,
       CASE WHEN p_d <> '' THEN (CASE WHEN has_c THEN COALESCE(TRY_CAST(stripped AS BIGINT), 0) ELSE 1 END) END
         AS p_count
FROM (
  SELECT *, digits <> '' AND length(stripped) <= 10
            AND (stripped = '' OR TRY_CAST(stripped AS BIGINT) <= 4294967295) AS has_c
  FROM (
    SELECT *, ltrim(digits, '0') AS stripped
    FROM (
      SELECT {id_col}, line{extra},
             CASE WHEN regexp_matches(line, '{PAT}') THEN regexp_extract(line, '{PAT}', 1) ELSE '' END AS p_d,
             regexp_extract(line, '{PAT}', 2) AS lazy_body,
             regexp_extract(line, '{PAT}', 3) AS digits
      FROM {src})))"""


def boost_sql(date_col: str, count_col: str) -> str:
    day = epoch_day(date_col)
    return (f"(CASE WHEN {day} IS NULL THEN 1.0 ELSE "
            f"exp(-CAST(greatest(date_diff('day', DATE '1970-01-01', {AS_OF}) - {day}, 0) AS DOUBLE) "
            f"/ 365.0 * ln(2.0)) * (1.0 + 0.5 * ln(CAST(greatest({count_col}, 1) AS DOUBLE))) END)")


NEW_WRITES = f"""
new_raw AS (
  SELECT CAST(1000000000000 + conv_id * 1000 + turn AS BIGINT) AS seq, role AS topic_raw, text AS body_raw
  FROM conversations
),
validated AS (
  SELECT seq, {norm_topic('topic_raw')} AS topic, regexp_replace(body_raw, '[\\r\\n]+', ' ', 'g') AS body,
         CASE WHEN topic_raw IS NULL OR {norm_topic('topic_raw')} = '' THEN 'blank_topic'
              WHEN body_raw IS NULL OR {blank('body_raw')} THEN 'blank_entry' END AS reason
  FROM new_raw
),
new_entries AS (
  SELECT seq AS entry_id, topic, {AS_OF} AS entry_date, body, CAST(1 AS BIGINT) AS reinforce_count,
         '- ' || strftime({AS_OF}, '%Y-%m-%d') || ': ' || body AS line, seq
  FROM validated WHERE reason IS NULL
)"""

FORGET_HIT = ("(topic = 'en' AND starts_with(line, '- ') "
              "AND contains(lower(line), lower('2024-03-')))")

NOTE_LINES = """
note_lines AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS topic, CAST(pos - 1 AS BIGINT) AS seq,
         regexp_replace(line, '\\r$', '') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
        FROM documents)
),
dups AS (
  SELECT topic, line AS old_line, line || ' [×' || CAST(COUNT(*) AS VARCHAR) || ']' AS new_line
  FROM note_lines GROUP BY topic, line HAVING COUNT(*) >= 2
),
firsts AS (
  SELECT n.topic, MIN(n.seq) AS seq, min(d.new_line) AS new_line
  FROM note_lines n JOIN dups d ON n.topic = d.topic AND n.line = d.old_line
  GROUP BY n.topic, n.line
)"""

ORACLE.update({
    "normalize_topic": f"""
SELECT event_id, {norm_topic('event_type')} AS topic, {norm_topic('props')} AS props_topic FROM events""",

    "tokenize": f"""
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, token
FROM (SELECT doc_id, unnest(tk) AS token, unnest(generate_series(1, len(tk))) AS pos
      FROM (SELECT doc_id, {tokens('text')} AS tk FROM documents))""",

    "parse_entry": with_(ENTRIES, "p AS (" + parsed("entry_lines") + ")") + """
SELECT entry_id, p_date AS parsed_date, p_body AS parsed_body, p_count AS parsed_count FROM p""",

    "render_entry": with_(ENTRIES) + "\nSELECT entry_id, line FROM entry_lines",

    "entry_epoch_day": f"""
SELECT event_id, day_str, CAST({epoch_day('day_str')} AS BIGINT) AS epoch_day
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_str FROM events)""",

    "boost": with_(ENTRIES, "p AS (" + parsed("entry_lines") + ")") + f"""
SELECT entry_id, round({boost_sql('p_date', 'p_count')}, 6) AS boost FROM p""",

    "term_frequencies": with_(ENTRIES, index_ctes()) + "\nSELECT term, entry_id, tf FROM postings",

    "term_idf": with_(ENTRIES, index_ctes()) + """
SELECT term, df, round(ln((CAST(n_docs AS DOUBLE) - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf
FROM dfs CROSS JOIN stats""",

    "corpus_stats": with_(ENTRIES, index_ctes()) + """
SELECT n_docs, total_tokens, round(avg_dl, 6) AS avg_dl FROM stats""",

    "build_index": with_(ENTRIES, index_ctes()) + "\nSELECT term, entry_id, tf FROM postings",

    "refresh_index": with_(ENTRIES, NEW_WRITES, f"""
snapshot AS (
  SELECT entry_id, topic, line FROM entry_lines WHERE NOT {FORGET_HIT}
  UNION ALL SELECT entry_id, topic, line FROM new_entries
)""", index_ctes("snapshot")) + "\nSELECT term, entry_id, tf FROM postings",

    "refreshed_search": with_(ENTRIES, NEW_WRITES, f"""
snapshot AS (
  SELECT entry_id, topic, line FROM entry_lines WHERE NOT {FORGET_HIT}
  UNION ALL SELECT entry_id, topic, line FROM new_entries
)""", QUERIES, index_ctes("snapshot"), BM25_SCORES) + """
SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.entry_id, e.topic, round(t.score, 6) AS score
FROM bm25_top t JOIN snapshot e USING (entry_id)""",

    "read_topic": with_(ENTRIES) + """
SELECT entry_id, seq, line FROM entry_lines WHERE topic = 'en' AND starts_with(line, '- ')""",

    "topic_counts": with_(ENTRIES) + """
SELECT topic, CAST(COUNT(*) FILTER (WHERE starts_with(line, '- ')) AS BIGINT) AS n_entries
FROM entry_lines GROUP BY topic""",

    "forget_removed": with_(ENTRIES) + f"\nSELECT entry_id, topic, line FROM entry_lines WHERE {FORGET_HIT}",

    "forget_kept": with_(ENTRIES) + f"\nSELECT entry_id, topic FROM entry_lines WHERE NOT {FORGET_HIT}",

    "validate_writes": with_(NEW_WRITES) + "\nSELECT seq, topic, reason IS NULL AS accepted, reason FROM validated",

    "append_entries": with_(ENTRIES, NEW_WRITES) + """
SELECT entry_id, topic, line, seq FROM entry_lines
UNION ALL SELECT entry_id, topic, line, seq FROM new_entries""",

    "reaffirm_rollup": with_(ENTRIES) + """
SELECT topic, MIN(seq) AS seq, MAX(entry_date) AS entry_date,
       CAST(SUM(reinforce_count) AS BIGINT) AS reinforce_count, COUNT(*) AS n_merged,
       '- ' || strftime(MAX(entry_date), '%Y-%m-%d') || ': ' || body ||
       CASE WHEN SUM(reinforce_count) > 1 THEN ' [×' || CAST(SUM(reinforce_count) AS VARCHAR) || ']' ELSE '' END
         AS line
FROM entries GROUP BY topic, body""",

    "replace_first": with_(NOTE_LINES) + """
SELECT n.topic, n.seq, COALESCE(f.new_line, n.line) AS line
FROM note_lines n LEFT JOIN firsts f ON n.topic = f.topic AND n.seq = f.seq""",

    "edit_log": with_(NOTE_LINES) + """
SELECT topic, seq, CASE WHEN n = 1 THEN line WHEN i = 1 THEN line || ' [b]' ELSE line || ' [a]' END AS line
FROM (SELECT topic, seq, line, count(*) OVER (PARTITION BY topic, line) AS n,
             row_number() OVER (PARTITION BY topic, line ORDER BY seq) AS i FROM note_lines)
WHERE n = 1 OR i <> 2""",

    "remove_first": with_(NOTE_LINES) + """
SELECT n.topic, n.seq, n.line FROM note_lines n ANTI JOIN firsts f ON n.topic = f.topic AND n.seq = f.seq""",
})

ORACLE["bm25_boosted"] = with_(ENTRIES, QUERIES, index_ctes(), BM25_SCORES, """
cand AS (
  SELECT t.query_id, t.entry_id, e.topic, e.line, t.score FROM bm25_top t JOIN entry_lines e USING (entry_id)
),
p AS (""" + parsed("cand", "entry_id", ", query_id, topic, score") + """),
boosted AS (
  SELECT query_id, entry_id, topic, score * """ + boost_sql("p_date", "p_count") + """ AS score FROM p
)""") + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, entry_id, topic, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) AS rank
      FROM boosted) WHERE rank <= 10"""


# --- hashed vectors (64 bins, FNV-style fold reduced modulo 64) ----------------

def hash_bin(tok: str, dim: int = DIM) -> str:
    seed, mult = HASH_OFFSET % dim, HASH_PRIME % dim
    return (f"list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(range(0, octet_length(encode({tok}))), "
            f"lambda i: CAST(('0x' || substr(hex(encode({tok})), 2*i+1, 2)) AS BIGINT))), "
            f"lambda h, b: (xor(h, b) * {mult}) % {dim})")


def hash_vectors(name: str, src: str, id_col: str, text_col: str, dim: int = DIM) -> str:
    """CTEs {name}_sparse (id, bin, cnt) and {name} (id, v DOUBLE[dim])."""
    return f"""
{name}_sparse AS (
  SELECT {id_col}, bin, COUNT(*) AS cnt
  FROM (SELECT {id_col}, {hash_bin('tok', dim)} AS bin
        FROM (SELECT {id_col}, unnest({tokens(text_col)}) AS tok FROM {src}))
  GROUP BY {id_col}, bin
),
{name} AS (
  SELECT s.{id_col}, list(CAST(COALESCE(x.cnt, 0) AS DOUBLE) ORDER BY s.i) AS v
  FROM (SELECT {id_col}, range AS i FROM {src} CROSS JOIN range({dim})) s
  LEFT JOIN {name}_sparse x ON x.{id_col} = s.{id_col} AND x.bin = s.i
  GROUP BY s.{id_col}
)"""


def cos(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = len({b}) AND len({a}) > 0 AND list_dot_product({a}, {a}) > 0 "
            f"AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / "
            f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END)")


def vec_sig(v: str) -> str:
    return f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 6)"


COS_TOP = """
cos_top AS (
  SELECT query_id, entry_id, sim,
         row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, entry_id) AS rank
  FROM (SELECT q.query_id, d.entry_id, """ + cos("q.v", "d.v") + """ AS sim FROM qvec q CROSS JOIN evec d)
  QUALIFY rank <= 20
)"""

FUSED = """
fused AS (
  SELECT query_id, entry_id, SUM(1.0 / (CAST(rank - 1 AS DOUBLE) + 60.0)) AS rrf
  FROM (SELECT query_id, entry_id, rank FROM bm25_top UNION ALL SELECT query_id, entry_id, rank FROM cos_top)
  GROUP BY query_id, entry_id
)"""

_SEARCH = (ENTRIES, QUERIES, index_ctes(), BM25_SCORES,
           hash_vectors("evec", "entry_lines", "entry_id", "line"),
           hash_vectors("qvec", "queries", "query_id", "query"), COS_TOP)

ORACLE.update({
    "hash_embed": with_(ENTRIES, hash_vectors("evec", "entry_lines", "entry_id", "line")) + """
SELECT entry_id, bin, cnt FROM evec_sparse""",

    "cosine_topk": with_(ENTRIES, QUERIES, hash_vectors("evec", "entry_lines", "entry_id", "line"),
                         hash_vectors("qvec", "queries", "query_id", "query"), COS_TOP) + """
SELECT t.query_id, CAST(t.rank AS BIGINT) AS rank, t.entry_id, e.topic, round(t.sim, 6) AS sim
FROM cos_top t JOIN entry_lines e USING (entry_id)""",

    "cosine_pairs": """
WITH ex AS (
  SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings
),
cent AS (
  SELECT label, list(m ORDER BY i) AS c
  FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY label, i) GROUP BY label
)
SELECT e.vec_id, e.label, round(""" + cos("CAST(e.embedding AS DOUBLE[])", "c.c") + """, 6) AS cos
FROM embeddings e JOIN cent c USING (label)""",

    "rrf_merge": with_(*_SEARCH, FUSED) + """
SELECT query_id, entry_id, round(rrf, 6) AS rrf FROM fused""",

    "hybrid_search": with_(*_SEARCH, FUSED, """
cand AS (SELECT f.query_id, f.entry_id, e.topic, e.line, f.rrf AS score FROM fused f JOIN entry_lines e USING (entry_id)),
p AS (""" + parsed("cand", "entry_id", ", query_id, topic, score") + """),
boosted AS (SELECT query_id, entry_id, topic, score * """ + boost_sql("p_date", "p_count") + """ AS score FROM p)""") + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, entry_id, topic, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, entry_id) AS rank
      FROM boosted) WHERE rank <= 10""",

    "search_fallback": "SELECT *, 'lexical' AS mode FROM (" + ORACLE["bm25_boosted"] + ")",

    "vector_upsert": with_(ENTRIES, NEW_WRITES, """
rolled AS (
  SELECT MIN(seq) AS entry_id, topic,
         '- ' || strftime(MAX(entry_date), '%Y-%m-%d') || ': ' || body ||
         CASE WHEN SUM(reinforce_count) > 1 THEN ' [×' || CAST(SUM(reinforce_count) AS VARCHAR) || ']' ELSE '' END
           AS line
  FROM entries GROUP BY topic, body HAVING COUNT(*) >= 2
),
changes AS (SELECT entry_id, topic, line FROM rolled UNION ALL SELECT entry_id, topic, line FROM new_entries),
final AS (
  SELECT entry_id, topic, line FROM entry_lines WHERE entry_id NOT IN (SELECT entry_id FROM changes)
  UNION ALL SELECT entry_id, topic, line FROM changes
)""", hash_vectors("fvec", "final", "entry_id", "line")) + f"""
SELECT f.entry_id, f.topic, f.line, {vec_sig('v.v')} AS vec_sig FROM final f JOIN fvec v USING (entry_id)""",

    "vector_delete": with_(ENTRIES, "kept AS (SELECT * FROM entry_lines WHERE NOT " + FORGET_HIT + ")",
                           hash_vectors("kvec", "kept", "entry_id", "line")) + f"""
SELECT k.entry_id, k.topic, {vec_sig('v.v')} AS vec_sig FROM kept k JOIN kvec v USING (entry_id)""",

    "embed_backfill": with_(ENTRIES, NEW_WRITES, """
allents AS (SELECT entry_id, topic, line FROM entry_lines UNION ALL SELECT entry_id, topic, line FROM new_entries)""",
                            hash_vectors("avec", "allents", "entry_id", "line")) + f"""
SELECT a.entry_id, a.topic, {vec_sig('v.v')} AS vec_sig FROM allents a JOIN avec v USING (entry_id)""",

    "forget_vectors": with_(ENTRIES) + f"""
SELECT topic, CAST(COUNT(*) FILTER (WHERE NOT {FORGET_HIT}) AS BIGINT) AS n_entries,
       CAST(COUNT(*) FILTER (WHERE NOT {FORGET_HIT}) AS BIGINT) AS n_indexed,
       CAST(COUNT(*) FILTER (WHERE NOT {FORGET_HIT}) AS BIGINT) AS n_vectors,
       CAST(COUNT(*) FILTER (WHERE {FORGET_HIT}) AS BIGINT) AS n_removed
FROM entry_lines GROUP BY topic""",
})


# --- consolidation (writes = entries replayed in seq order) --------------------
WRITES = """
wl AS (SELECT entry_id, seq, topic, entry_date AS written_on, body,
              '- ' || strftime(entry_date, '%Y-%m-%d') || ': ' || body AS line FROM entries),
wp AS (""" + parsed("wl", "entry_id", ", seq, topic, written_on, body") + """),
writes AS (SELECT entry_id, seq, topic, written_on, body, p_body AS cand_body, p_count AS base_count FROM wp)"""

BEST = """
wpairs AS (
  SELECT w.entry_id AS id, w.seq, c.entry_id AS match_id, c.seq AS match_seq, """ + cos("wv.v", "cv.v") + """ AS sim
  FROM writes w JOIN writes c ON w.topic = c.topic AND c.seq < w.seq
  JOIN bvec wv ON wv.entry_id = w.entry_id JOIN bvec cv ON cv.entry_id = c.entry_id
),
best AS (
  SELECT * FROM wpairs
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, match_seq) = 1
),
cls AS (
  SELECT w.entry_id, w.topic, w.seq, w.written_on, w.body, w.base_count,
         CASE WHEN b.sim >= CAST(0.95 AS DOUBLE) THEN 'reaffirm'
              WHEN b.sim >= CAST(0.85 AS DOUBLE) THEN 'supersede' ELSE 'append' END AS outcome,
         b.match_id, b.match_seq, b.sim
  FROM writes w LEFT JOIN best b ON b.id = w.entry_id
)"""

_CONS = (ENTRIES, WRITES, hash_vectors("bvec", "writes", "entry_id", "body"), BEST)


def render(d: str, body: str, cnt: str) -> str:
    return (f"('- ' || strftime({d}, '%Y-%m-%d') || ': ' || {body} || "
            f"CASE WHEN {cnt} > 1 THEN ' [×' || CAST({cnt} AS VARCHAR) || ']' ELSE '' END)")


ORACLE.update({
    "best_match": with_(*_CONS) + """
SELECT id AS entry_id, match_id, round(sim, 6) AS sim FROM best""",

    "near_pairs": with_(ENTRIES, WRITES, hash_vectors("bvec", "writes", "entry_id", "body")) + """
SELECT a.topic, a.entry_id AS entry_a, b.entry_id AS entry_b, round(""" + cos("av.v", "bv.v") + """, 6) AS sim
FROM writes a JOIN writes b ON a.topic = b.topic AND a.seq < b.seq
JOIN bvec av ON av.entry_id = a.entry_id JOIN bvec bv ON bv.entry_id = b.entry_id
WHERE """ + cos("av.v", "bv.v") + """ >= CAST(0.85 AS DOUBLE)""",

    "consolidate_classify": with_(*_CONS) + """
SELECT c.entry_id, c.topic, c.outcome,
       CASE WHEN c.outcome <> 'append' THEN c.match_id END AS match_id,
       round(CASE WHEN c.outcome <> 'append' THEN c.sim END, 6) AS sim,
       CAST(CASE WHEN c.outcome = 'reaffirm' THEN m.base_count + 1 ELSE c.base_count END AS BIGINT) AS new_count
FROM cls c LEFT JOIN writes m ON m.seq = c.match_seq""",

    "classify_live": with_(ENTRIES, WRITES, hash_vectors("bvec", "writes", "entry_id", "body"), """
cut AS (SELECT (min(seq) + max(seq)) // 2 AS c FROM entries),
near AS (
  SELECT w.entry_id AS id, e.entry_id AS match_id, e.reinforce_count, """ + cos("wv.v", "ev.v") + """ AS sim
  FROM cut JOIN writes w ON w.seq > c JOIN entries e ON e.seq <= c AND e.topic = w.topic
  JOIN bvec wv ON wv.entry_id = w.entry_id JOIN bvec ev ON ev.entry_id = e.entry_id
  QUALIFY row_number() OVER (PARTITION BY w.entry_id ORDER BY round(sim, 12) DESC, e.seq) = 1
)""") + """
SELECT w.entry_id, w.topic, CASE WHEN sim >= CAST(0.95 AS DOUBLE) THEN 'reaffirm'
                                 WHEN sim >= CAST(0.85 AS DOUBLE) THEN 'supersede' ELSE 'append' END AS outcome,
       CASE WHEN sim >= CAST(0.85 AS DOUBLE) THEN match_id END AS match_id,
       CASE WHEN sim >= CAST(0.85 AS DOUBLE) THEN round(sim, 6) END AS sim,
       CAST(CASE WHEN sim >= CAST(0.95 AS DOUBLE) THEN reinforce_count + 1 ELSE base_count END AS BIGINT) AS new_count
FROM cut JOIN writes w ON w.seq > c LEFT JOIN near ON near.id = w.entry_id""",

    "tombstones": with_(*_CONS) + """
SELECT c.written_on AS logged_on, c.topic, c.outcome AS kind,
       """ + render("m.written_on", "m.cand_body", "m.base_count") + """ AS old_line,
       CASE WHEN c.outcome = 'reaffirm' THEN """ + render("c.written_on", "m.cand_body", "m.base_count + 1") + """
            ELSE '- ' || strftime(c.written_on, '%Y-%m-%d') || ': ' || c.body END AS new_line
FROM cls c JOIN writes m ON m.seq = c.match_seq
WHERE c.outcome <> 'append'""",
})


# --- note files, streams, ordered fold -------------------------------------------
# The fold, one write of every topic per recursion step: ``live`` is the topic's
# notebook before the step, in file order. The nearest live entry (similarity at 12
# digits, the earliest of equals) decides; its place in the list is ``hit``.
FOLD = with_(ENTRIES, WRITES,
             hash_vectors("rawvec", "writes", "entry_id", "body"),
             hash_vectors("candvec", "writes", "entry_id", "cand_body"), """
steps AS MATERIALIZED (
  SELECT w.topic, w.seq, w.entry_id, w.base_count, q.v AS qv, c.v AS cv,
         row_number() OVER (PARTITION BY w.topic ORDER BY w.seq) AS k
  FROM writes w JOIN rawvec q USING (entry_id) JOIN candvec c USING (entry_id)
),
fold AS (
  SELECT topic, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS entry_id,
         CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS match_seq, CAST(NULL AS BIGINT) AS new_count,
         CAST([] AS STRUCT(seq BIGINT, cnt BIGINT, v DOUBLE[])[]) AS live
  FROM (SELECT DISTINCT topic FROM writes)
  UNION ALL
  SELECT topic, k, seq, entry_id, outcome, CASE WHEN outcome <> 'append' THEN live[hit].seq END,
         CAST(CASE WHEN outcome = 'reaffirm' THEN live[hit].cnt + 1 ELSE base_count END AS BIGINT),
         CASE outcome
           WHEN 'reaffirm' THEN list_transform(live, lambda e, i: CASE WHEN i = hit THEN
             struct_pack(seq := e.seq, cnt := e.cnt + 1, v := e.v) ELSE e END)
           WHEN 'supersede' THEN list_append(list_concat(live[1:hit - 1], live[hit + 1:]),
             struct_pack(seq := seq, cnt := CAST(base_count AS BIGINT), v := cv))
           ELSE list_append(live, struct_pack(seq := seq, cnt := CAST(base_count AS BIGINT), v := cv)) END
  FROM (
    SELECT *, CASE WHEN sims[hit] >= CAST(0.95 AS DOUBLE) THEN 'reaffirm'
                   WHEN sims[hit] >= CAST(0.85 AS DOUBLE) THEN 'supersede' ELSE 'append' END AS outcome
    FROM (
      SELECT *, list_position(near, list_max(near)) AS hit
      FROM (
        SELECT *, list_transform(sims, lambda x: round(x, 12)) AS near
        FROM (SELECT s.*, f.live, list_transform(f.live, lambda e: """ + cos("s.qv", "e.v") + """) AS sims
              FROM fold f JOIN steps s ON s.topic = f.topic AND s.k = f.k + 1))))
)""").replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT seq, entry_id, topic, outcome, match_seq, new_count FROM fold WHERE k > 0"""

ORACLE.update({
    "scan_entries": with_(ENTRIES) + """
SELECT topic, line FROM entry_lines WHERE starts_with(line, '- ')""",

    "export_notes": with_(ENTRIES) + """
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY seq) - 1 AS BIGINT) AS line_no, value
FROM (SELECT topic, seq, line AS value FROM entry_lines
      UNION ALL SELECT DISTINCT topic, -2, '# ' || topic FROM entry_lines
      UNION ALL SELECT DISTINCT topic, -1, '' FROM entry_lines)""",

    "stream_append": with_(ENTRIES, NEW_WRITES) + """
SELECT entry_id, topic, line, seq FROM new_entries""",

    "stream_topic_counts": with_(ENTRIES, NEW_WRITES) + """
SELECT topic, COUNT(*) AS n_entries FROM new_entries GROUP BY topic""",

    "consolidate_fold": FOLD,
    "write_changes": FOLD[:FOLD.rindex("SELECT seq, entry_id")] + """,
ks AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE seq <= (SELECT (min(seq) + max(seq)) // 2 FROM writes)) AS n1
       FROM writes GROUP BY topic),
a AS (SELECT unnest(live, recursive := true) FROM fold JOIN ks ON fold.topic = ks.topic AND fold.k = ks.n1),
b AS (SELECT unnest(live, recursive := true) FROM fold JOIN ks ON fold.topic = ks.topic AND fold.k = ks.n)
SELECT w.entry_id, w.topic, CASE WHEN b.seq IS NULL THEN 'delete' WHEN a.seq IS NULL THEN 'insert' ELSE 'update' END AS change,
       coalesce(b.cnt, a.cnt) AS reinforce_count
FROM (SELECT seq, cnt FROM a) a FULL JOIN (SELECT seq, cnt FROM b) b ON a.seq = b.seq
JOIN writes w ON w.seq = coalesce(a.seq, b.seq)
WHERE a.seq IS NULL OR b.seq IS NULL OR a.cnt <> b.cnt""",
    "stream_consolidate": FOLD,
})
