"""The pipeline against a plain-Python version of its five stages, on a small
corpus with planted boilerplate lines, exact and near copies, a shared passage
of 51 words below 400 bytes and secrets."""

import collections
import random
import re
import zlib

import corpus_pipeline
from test_llm import linked, quality_model, removal_model, simhash_model, words
from tokenizers import Tokenizer

from quire.llm.queries import tokenizer_file

LINE_LIMIT = 20
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """(doc_id, text, lang, source, n_chars) rows, the passage, the menu line."""
    rng = random.Random(31)
    menu = "Home  about CONTACT us and terms"
    passage = " ".join(rng.choice(["un", "das", "erth", "ronle", "tion"]) + rng.choice("aeiou") for _ in range(51))
    assert 230 < len(passage.encode()) < 400
    texts = []
    for i in range(40):
        body = [words(rng, 45) for _ in range(3)]
        if i % 8 == 1:
            body.insert(1, passage)
        if i % 8 == 2:
            body[2] += " password = 'hunter2hunter2'" + " key AKIA" + "Q7" * 8
        if i < 30:
            body.append(menu)
        texts.append("\n".join(body))
    texts += [texts[5], texts[5]]                              # exact copies
    texts.append(words(rng, 2_000))
    texts.append(texts[-1] + " one")                           # a near copy
    texts += [words(rng, 20), None, "", "w " * 90]             # fail the base rules
    texts.append("\n".join([menu] * 12 + [words(rng, 14)]))   # depleted
    texts.append(words(rng, 6_000))                            # cut into several pieces
    rows = [(i, t, "en", "h", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3]], passage, menu


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def quality_stage(rows):
    holders = collections.defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            holders[host, normal(line)].add(text)
    most = max(LINE_LIMIT, 0.01 * len({t or "" for _, t, _ in rows}))
    out = []
    for i, text, host in rows:
        n, _, _, _, repeat = quality_model(text or "")
        if n < 50 or 100 * repeat > 50 * n:
            continue
        lines = [x for x in text.split("\n") if not normal(x) or len(holders[host, normal(x)]) <= most]
        if len(" ".join(lines).split()) >= 0.3 * n:
            out.append((i, "\n".join(lines), host))
    return out


def near_stage(rows):
    rows = sorted(set(rows), key=lambda r: r[0])
    group = linked([simhash_model(t) for _, t, _ in rows], lambda a, b: bin(a ^ b).count("1") <= 4)
    first = {}
    for g, r in zip(group, rows):
        first.setdefault(g, r)
    return sorted(first.values())


def substring_stage(rows, length):
    raw = [t.encode() for _, t, _ in rows]
    seen = collections.Counter(t[p:p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for (i, _, host), t in zip(rows, raw):
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                cover[p:p + length] = b"\1" * length
        out.append((i, bytes(x for x, c in zip(t, cover) if not c).decode("utf-8", "ignore"), host))
    return out


def secret_stage(rows):
    out = []
    for i, t, host in rows:
        t = re.sub(r"password = 'hunter2hunter2", "[SECRET]", t)
        out.append((i, re.sub(r"AKIA[A-Z0-9]{14,}", "[SECRET]", t), host))
    return out


def pieces(rows):
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            out.append((i, piece, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return sorted(out)


def staged(spark, df):
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialise(stage(spark, df, ""), "test-" + name)
        tables.append(df)
    return tables


def test_stages_equal_brute_force(spark):
    rows, passage, menu = planted()
    tables = staged(spark, spark.createDataFrame(rows, COLUMNS))
    want = [(i, t, h) for i, t, _, h, _ in rows]
    for got, stage in zip(tables, (quality_stage, near_stage,
                                   lambda r: substring_stage(r, corpus_pipeline.REPEAT_BYTES), secret_stage)):
        want = sorted(stage(want))
        assert sorted((r.doc_id, r.text, r.source) for r in got.collect()) == want
    left = {i: t for i, t, _ in want}
    assert not any(passage in t or menu in t or "hunter2" in t or "AKIA" in t for t in left.values())
    assert set(range(40)) <= set(left) and not {40, 41, 43, 44, 45, 46, 47, 48} & set(left)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in tables[-1].collect()) == pieces(want)


def test_stages_keep_clean_documents(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(words(rng, 60) for _ in range(2)), "en", "h", 0) for i in range(30)]
    tables = staged(spark, spark.createDataFrame(rows, COLUMNS))
    for df in tables[:-1]:
        assert sorted((r.doc_id, r.text) for r in df.collect()) == [(i, t) for i, t, *_ in rows]


def test_names_with_dots_and_back_ticks(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 60), "en", "h", 0, i, "x", i) for i in range(3)]
    df = spark.createDataFrame(rows, COLUMNS + ", `a.b` int, `c``d` string, `row.text` int")
    *kept, packed = staged(spark, df)
    assert all(t.columns == df.columns for t in kept)
    assert sorted(r["a.b"] for r in kept[-1].collect()) == [0, 1, 2] and packed.count() == 3
