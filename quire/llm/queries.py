"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (byte_bpe, html_text, language, metric_search, packing, prefix_trie, quality, secrets, sharding,
                       simhash, suffix_dedup, token_files, whitening)

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near duplicates: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 by inner product for every 50th vector."""
    return metric_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, out of 64."""
    return sharding.assign(documents(spark, sf_dir), "doc_id", SHARDS)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and what they decode to."""
    return byte_bpe.encode_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), digests=True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left once every 400-byte string that occurs twice is removed."""
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir), length=400)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base text rules and lines that too many documents of a source share."""
    return quality.assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_words_left")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    manifest = token_files.write_token_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing into sequences of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=0)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, 32 components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mtree": op2_mtree,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_html": op11_html,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op2_mtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5""",
    "op3_sharding": f"""
WITH t AS (SELECT string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',') AS owners),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {sharding.TABLE_SIZE} AS slot
      FROM documents)
SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard_id,
       'shard-' || lpad(owners[slot + 1], 2, '0') AS shard
FROM d, t""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(md5(r) || md5(x))) AS own FROM t GROUP BY conv_id),
-- CRC-32 of the decimal id: each byte is xor-ed in and then shifted out in eight steps (-1)
crc AS (SELECT conv_id, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
          string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 9 AS h
        FROM own),
seqs AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS s
         FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS last
             FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
          FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * coalesce(strlen(nodes.p[nodes.d].x), 0) AS own
         FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p),
below AS (SELECT a.d, a.p, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.own) AS saved
          FROM told a JOIN told b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p)
SELECT told.conv_id, told.d AS depth, up.conv_id AS parent_conv_id, told.n_convs, told.n_children, below.n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, sha256(told.ends) AS ends_sha256
FROM told JOIN below ON below.d = told.d AND below.p = told.p
LEFT JOIN nodes up ON up.d = told.d - 1 AND up.p = told.p[1:told.d - 1]""",
    "op7_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
n AS (SELECT r, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM w),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
g3 AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM g),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g3) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM again GROUP BY r),
raw AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
solid AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM solid GROUP BY r),
norm AS (SELECT r, host, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM solid),
many AS (SELECT host, line, count(DISTINCT t) AS c FROM norm GROUP BY host, line),
hosts AS (SELECT host, greatest(20.0, 0.01 * count(DISTINCT t)) AS most FROM d GROUP BY host),
common AS (SELECT many.host, line FROM many JOIN hosts USING (host) WHERE c > most),
gone AS (SELECT r, sum(len(string_split(line, ' '))) AS gone FROM norm JOIN common USING (host, line) GROUP BY r),
a AS (SELECT d.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(n_words - coalesce(gone, 0) AS BIGINT) AS n_words_left
      FROM d JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 0.3 * n_words AS kept
FROM a""",
}
