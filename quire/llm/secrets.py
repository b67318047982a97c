"""Secret scans in DataFrame functions only: fixed patterns, and a battery of
randomness tests over long tokens.

A token (a run of 20 or more letters, digits and ``+/_-``, with any ``=`` that
pad it; a value after ``=`` is a token of its own) is taken as hex, base32 or base64, and tested against a uniform source over
that alphabet: chi-squared uniformity, runs above and below the middle, lag-1
serial correlation. The three p-values are combined by Fisher's method.
Tokens that look random are findings. How many of them are false is estimated
for each encoding and length class: the tokens with p above one half, doubled,
estimate the random ones. The class's threshold is the smallest p with tokens
above it at which the share of others among them may still be at most the given
rate, the random ones taken at the upper 95 % limit of their estimate. So a
class too small to tell keeps the smallest threshold (a lone random token is
found), and in a large one the limit nears the estimate. Tests of short tokens
reject less, so their classes get higher thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.common import materialise, row_key, whole_row

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# the start of a run, the run, its padding: '=' that nothing follows
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", RANDOM)]
MIN_VALUE = 12  # characters of an assigned value

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
THRESHOLDS = [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5]
Z_LIMIT = 1.645  # one-sided 95 % limit of a count


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic approximation."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def battery(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """``tokens`` with encoding, length class and combined p-value (columns
    ``encoding``, ``length_class``, ``p``); p is null where no encoding fits.
    The p-value is that of a uniform source: small means not random."""
    body = F.regexp_replace(F.col(token_col), "=+$", "")
    t = tokens.withColumn("encoding", F.when(F.length(body) < 2, None)
                          .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
                          .when(body.rlike("^[A-Z2-7]+$"), "base32")
                          .when(body.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$"), "base64")) \
        .withColumn("body", F.when(F.col("encoding") == "hex", F.lower(body))
                    .when(F.col("encoding").isNotNull(), F.translate(body, "-_", "+/"))
                    .otherwise("00"))  # not tested; stands in so that every step is defined
    alphabet = F.when(F.col("encoding") == "hex", ALPHABETS["hex"]) \
        .when(F.col("encoding") == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    t = t.withColumn("n", F.length("body").cast("double")).withColumn("alphabet", alphabet) \
        .withColumn("a", F.length("alphabet").cast("double")) \
        .withColumn("x", F.expr("transform(sequence(1, length(body)), i -> instr(alphabet, substring(body, i, 1)) - 1)")) \
        .withColumn("squares", F.expr(
            "aggregate(sequence(1, length(alphabet)), 0L, (acc, i) -> acc + "
            "cast(pow(length(body) - length(replace(body, substring(alphabet, i, 1), '')), 2) as bigint))")) \
        .withColumn("high", F.expr("aggregate(x, 0L, (acc, v) -> acc + if(2 * v >= a, 1L, 0L))").cast("double")) \
        .withColumn("runs", F.expr(
            "aggregate(sequence(1, size(x) - 1), 1L, (acc, i) -> acc + "
            "if((2 * x[i] >= a) <> (2 * x[i - 1] >= a), 1L, 0L))").cast("double")) \
        .withColumn("products", F.expr(
            "aggregate(sequence(1, size(x) - 1), 0L, (acc, i) -> acc + "
            "cast((2 * x[i] - a + 1) * (2 * x[i - 1] - a + 1) as bigint))").cast("double"))
    df = F.col("a") - 1
    spread = F.lit(2.0) / (F.lit(9.0) * df)
    mean = F.lit(2.0) * F.col("high") * (F.col("n") - F.col("high")) / F.col("n")
    # one step a select, so that no expression holds another more than once or twice
    t = t.withColumn("chi", F.col("a") / F.col("n") * F.col("squares") - F.col("n")).withColumn("mean", mean) \
        .withColumn("z_chi", (F.pow(F.col("chi") / df, F.lit(1.0) / 3) - (F.lit(1.0) - spread)) / F.sqrt(spread)) \
        .withColumn("var", F.col("mean") * (F.col("mean") - 1) / (F.col("n") - 1)) \
        .withColumn("z_runs", F.when(F.col("var") > 0, F.abs((F.col("runs") - 1 - F.col("mean")) / F.sqrt("var")))) \
        .withColumn("z_serial", F.abs(F.col("products") / F.lit(4.0) / ((F.col("a") * F.col("a") - 1) / 12)
                                      / F.sqrt(F.col("n") - 1)))
    t = t.withColumn("p_chi", _upper_tail(F.col("z_chi"))) \
        .withColumn("p_runs", F.when(F.col("var") > 0, F.lit(2.0) * _upper_tail(F.col("z_runs"))).otherwise(0.0)) \
        .withColumn("p_serial", F.lit(2.0) * _upper_tail(F.col("z_serial")))
    y = -sum((F.log(F.greatest(F.col(c), F.lit(1e-30))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
    t = t.withColumn("y", y)
    p = F.exp(-F.col("y")) * (F.lit(1.0) + F.col("y") + F.col("y") * F.col("y") / 2)
    return t.withColumn("p", F.when(F.col("encoding").isNotNull(), p)) \
        .withColumn("length_class", F.floor(F.log2("n") * 2).cast("int")) \
        .select(*tokens.columns, "encoding", "length_class", "p")


def thresholds(tested: DataFrame, rate: float) -> DataFrame:
    """(encoding, length_class, threshold): one row a class of tested tokens.
    The classes are few whatever the data: three encodings, and two length
    classes each time the length doubles."""
    counts = tested.where("p is not null").groupBy("encoding", "length_class").agg(
        *[F.sum(F.when(F.col("p") > t, 1).otherwise(0)).alias(f"c{i}") for i, t in enumerate(THRESHOLDS)])
    half = F.col(f"c{len(THRESHOLDS) - 1}")
    random = F.lit(2.0) * (half + F.lit(Z_LIMIT ** 2 / 2) + F.lit(Z_LIMIT) * F.sqrt(half + F.lit(Z_LIMIT ** 2 / 4)))
    best = F.lit(THRESHOLDS[-1])
    for i, t in reversed(list(enumerate(THRESHOLDS))):
        above = F.col(f"c{i}")
        best = F.when((above > 0) & (above - random * (1 - t) <= F.lit(rate) * above), F.lit(t)).otherwise(best)
    return counts.select("encoding", "length_class", best.alias("threshold"))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern in order, with the characters before each
    since the last; the patterns run only where one is found."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))
    found = F.transform(F.filter(pairs, lambda x: x["token"].isNotNull()), lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["token"].alias("token")))
    return F.when(text.rlike(pattern), found).otherwise(
        F.expr("cast(array() as array<struct<kind: string, gap: int, token: string>>)"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(row, row_key, doc_id, kind, s, e): every finding, in code points, end
    exclusive, and for a row without any a line with null kind. ``row``
    numbers the input rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("bigint")
    found = docs.select(F.monotonically_increasing_id().alias("row"), row_key(doc_id, text), doc_id.alias("doc_id"),
                        F.concat(*[_matches(text, k, p) for k, p in KINDS]).alias("found"))
    # places add up along a row's matches of one kind; a kind's matches keep their order by index
    places = found.select("row", "row_key", "doc_id", F.posexplode_outer("found").alias("i", "hit")) \
        .select("row", "row_key", "doc_id", "i", "hit.kind", "hit.gap", "hit.token")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = F.sum(F.col("gap") + F.length("token")).over(so_far)
    value = F.length(F.regexp_extract("token", ASSIGN, 2))
    spans = materialise(
        places.select("row", "row_key", "doc_id", "kind", "token", e.alias("e"))
        .withColumn("s", F.col("e") - F.length("token"))
        .withColumn("ok", F.when(F.col("kind") == "assign", value >= MIN_VALUE).otherwise(True)), "matches")
    tokens = spans.where("kind = 'random'")
    tested = materialise(battery(tokens, "token"), "tested")
    kept = tested.join(F.broadcast(thresholds(tested, rate)), ["encoding", "length_class"]) \
        .where("p > threshold").select("row", "row_key", "doc_id", "kind", "s", "e")
    rest = spans.where("kind is null or kind <> 'random'") \
        .withColumn("kind", F.when(F.col("ok"), F.col("kind"))).select("row", "row_key", "doc_id", "kind", "s", "e")
    # a row whose only tokens fail still needs a line
    blank = spans.where("kind = 'random'").groupBy("row", "row_key", "doc_id").agg(
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("s"),
        F.lit(None).cast("bigint").alias("e"))
    return rest.unionByName(kept).unionByName(blank)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of
    every row: ``spans`` joins ``kind:start:end`` by commas, ordered by start,
    then kind in the order assign, access, hex, random; ``base_sha256`` is the
    SHA-256 of the same string of the first three kinds.

    Edge cases: a null text is empty and has no findings; matches are leftmost
    and do not overlap within a kind; repeated rows stay repeated; a null
    doc_id stays null; an empty table gives an empty result; other columns are
    not read."""
    spans = find_spans(docs, id_col, text_col, rate)
    order = F.expr("case kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end")
    entry = F.struct("s", order.alias("k"), F.concat_ws(":", "kind", "s", "e").alias("label"))
    sets = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k, _ in KINDS],
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("found"))
    base = F.expr("transform(filter(found, x -> x.k < 3), x -> x.label)")
    every = F.expr("transform(found, x -> x.label)")
    return sets.select("doc_id", *[f"n_{k}" for k, _ in KINDS],
                       F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
                       F.concat_ws(",", every).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           rate: float = 0.05) -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mark``
    (findings that overlap or touch become one mark); rows and other columns
    stay as they are, a null text stays null."""
    spans = find_spans(docs, id_col, text_col, rate).where("kind is not null").select("row_key", "s", "e").distinct()
    earlier = Window.partitionBy("row_key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row_key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("reach", F.max("e").over(earlier)) \
        .withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(upto)) \
        .groupBy("row_key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")) \
        .groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(whole_row(docs),
                         row_key(F.col(id_col).cast("bigint"), text), text.alias("whole"))
    between = F.expr("transform(cuts, (c, i) -> substring(whole, cast(if(i = 0, 0L, cuts[i - 1].e) + 1 as int), "
                     "cast(c.s - if(i = 0, 0L, cuts[i - 1].e) as int)))")
    tail = F.expr("substring(whole, cast(cuts[size(cuts) - 1].e + 1 as int))")
    left = F.concat_ws(mark, F.concat(between, F.array(tail)))
    return packed.join(islands, "row_key", "left").select(
        [(F.when(F.col("cuts").isNotNull(), left).otherwise(F.col("row")[c]) if c == text_col else F.col("row")[c])
         .alias(c) for c in docs.columns])
