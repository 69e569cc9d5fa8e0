"""The corpus pipeline and the registered queries without SQL, against brute force on a small table with the edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from spectrel.llm import queries, quality
from spectrel.llm.base import store, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, row string, n_words string"


def make_texts() -> list[str | None]:
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "su") for b in ("ran", "tel", "vid", "non") for c in ("a", "eth", "or", "ing", "um", "is")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    texts: list[str | None] = [prose(rng.choice([60, 80, 150, 400])) for _ in range(70)]
    for k in range(12):  # near copies of the first ones, chains among them, and exact copies
        t = texts[k % 4].split(" ")
        for _ in range(k // 4):
            t[rng.randrange(len(t))] = "edited"
        texts.append(" ".join(t))
    texts += ["### $$$ %% " * 40 + prose(60) for _ in range(8)]  # symbols
    texts += [prose(6) * 30 for _ in range(4)]  # repeated windows
    texts += [None, "", " \n", "short text", prose(9000), "a\x1cb\x85c d　e <|endoftext|> " + prose(70)]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en" if i % 3 else None, "web" if i % 4 else None, None, "clash", -1, "clash", "clash") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    bad = lambda t: t is None or "#" in t or len(t.split()) < 50
    marks = [(i, 0 if bad(t) else 1, None if i % 2 else 0) for i, t in enumerate(TEXTS) if i % 5 != 1]
    spark.createDataFrame([*marks, (None, 1, 0), (10**9, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def by_id(df, *columns):
    return {r.doc_id: r if not columns else tuple(r[c] for c in columns) for r in df.collect()}


def classes(texts: dict, n: int, num: int, den: int) -> dict:
    """The smallest id that each reaches, by all pairs."""
    def shingled(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets, root = {k: shingled(t) for k, t in texts.items()}, {k: k for k in texts}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in sorted(sets):
        for b in sets:
            if a < b and (common := len(sets[a] & sets[b])) and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in root}


def test_stages_equal_brute_force(spark, folder):
    from tokenizers import Tokenizer

    steps = dict(corpus_pipeline.STAGES)
    docs = table(spark, folder, "documents")
    good = store(steps["quality_classifier"](spark, docs, folder), "test")
    model = quality.fit(docs, quality.grades_of(table(spark, folder, "labels")), 3)
    tail = lambda t: 1 / (1 + math.exp(model.thresholds[1] - sum(float(model.weights[i]) * float(v) for i, v in zip(*quality.features(t or ""), strict=True))))
    kept = by_id(good)
    assert set(kept) == {i for i, t in enumerate(TEXTS) if tail(t) >= 0.5}
    assert 1 < len(kept) < len(TEXTS) and not any("###" in (r.text or "") for r in kept.values())

    con = duckdb.connect()
    con.register("documents", good.toPandas())
    con.execute("create view d as select * from documents")
    regular = store(steps["quality_rules"](spark, good, folder), "test")
    want = {r[0] for r in con.execute(f"select doc_id from ({queries.OP6_SQL}) where kept").fetchall()}
    assert set(by_id(regular)) == want and 1 < len(want) < len(kept)

    distinct = store(steps["jaccard_join"](spark, regular, folder), "test")
    root = classes({k: r.text for k, r in by_id(regular).items()}, 5, 80, 100)
    assert set(by_id(distinct)) == {k for k, r in root.items() if k == r} and len(set(root.values())) < len(root)
    assert good.columns == regular.columns == distinct.columns == corpus_pipeline.COLUMNS

    pieces = corpus_pipeline.run(spark, folder).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r.doc_id for r in pieces} == set(by_id(distinct))
    for k in by_id(distinct):
        own = sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == [*tok.encode(TEXTS[k], add_special_tokens=False).ids, 1]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in own)


def test_stages_on_odd_tables(spark, folder):
    docs = table(spark, folder, "documents")
    odd = docs.where("doc_id in (0, 1, 96)").unionByName(docs.where("doc_id in (0, 1)")).unionByName(docs.where("doc_id = 0").selectExpr("cast(null as long) as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars", "kept", "component_id", "row", "n_words"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert stage(spark, odd, folder).count() > 0, name
    left = corpus_pipeline.keep_distinct(spark, odd, folder).collect()
    assert Counter(r.doc_id for r in left) == {0: 1, 1: 1, 96: 1}


def test_distinct_keeps_other_texts_of_null_and_repeated_ids(spark):
    a, b, c, e = TEXTS[0], TEXTS[1], TEXTS[2], TEXTS[3]
    near = a.replace(a.split(" ")[30], "edited", 1) if len(a.split()) > 100 else a + " edited"
    given = [(None, a), (None, b), (None, b), (7, c), (7, e), (7, e), (3, near), (None, ""), (None, ""), (None, None), (8, ""), (8, ""), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "web", None, "clash", -1, "clash", "clash") for k, t in given], SCHEMA)
    left = corpus_pipeline.keep_distinct(spark, docs, "")
    assert left.columns == corpus_pipeline.COLUMNS
    want = [(3, near), (None, b), (7, c), (7, e), (None, ""), (None, None), (8, ""), (9, "")]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)


def test_whole_pipeline_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "jaccard_join", "packing"]


def test_op1_op2_op3(spark, folder):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    word, byte = (Tokenizer.from_file(P.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids, counts = by_id(queries.op1_bpe(spark, folder)), by_id(queries.op3_token_counts(spark, folder))
    pieces = queries.op2_packing(spark, folder).collect()
    assert set(ids) == set(counts) == {r.doc_id for r in pieces} == set(range(len(TEXTS)))
    for k, t in enumerate(x or "" for x in TEXTS):
        want = np.array(enc.encode_ordinary(t), "<u4")
        assert tuple(ids[k])[1:4] == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        n = len(byte.encode(t, add_special_tokens=False).ids)
        assert tuple(counts[k])[1:4] == (len(t.encode()), n, n > 512)
        own, at = np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(own[at : at + r.length].tobytes()), len(own))
            at += r.length
        assert at == len(own)


def test_op4_op5(spark, folder):
    got = by_id(queries.op4_quality(spark, folder))
    assert set(got) == set(range(len(TEXTS))) and all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 2 for r in got.values())
    got = by_id(queries.op5_language(spark, folder))
    assert set(got) == set(range(len(TEXTS)))
    for k, t in enumerate(TEXTS):
        letters = any(c.isalpha() for c in t or "")
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k].lang_pred == ("en" if letters else "und") and 0 <= got[k].score <= 1


def test_op8_base_and_op10(spark, folder):
    split = [[x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + [None] for t in TEXTS]
    out = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(TEXTS))]
    c = Counter(w for t, o in zip(split, out, strict=True) if not o for w in t)
    n, v, got = sum(c.values()), len(c), by_id(queries.op8_lm(spark, folder))
    for k, t in enumerate(split):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    root = classes(dict(enumerate(TEXTS)), 3, 90, 100)
    assert by_id(queries.op10_jaccard(spark, folder), "component_id") == {k: (c,) for k, c in root.items()}


def test_op9(spark, folder):
    texts, got = [t or "" for t in TEXTS], by_id(queries.op9_fingerprints(spark, folder))
    prints: dict[str, str] = {}
    for k, t in enumerate(texts):
        after, half = texts[k - 1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (edited != t or r.near_edited == 1) and (after != t or r.near_next == 1)
