"""The training-data operators against brute force, libraries and SQL, on small tables."""

import base64
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from spectrel.llm import bpe, chat, fingerprint, jaccard, langid, lm, packing, quality, queries, rules, token_counts, wordcache
from spectrel.llm.base import fold, fresh_path

TEXTS = [None, "", " ", "one", "the cat sat on the mat", "the cat sat on the mat", "a\x1cb\x85 c d  e <|endoftext|>x <|ENDOFTEXT|>", "it's IT'S Σας ΑΣ é. x, y!", "z" * 5000, "word " * 3000, "\n\n", "日本語 テキスト 12"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, None, None), rows[4]], SCHEMA)


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.decode(bpe.encode(docs.drop("ids"), path, P.PATTERN), path, P.PATTERN).collect()
    assert len(both) == len(TEXTS) + 2
    for r in both:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    with pytest.raises(ValueError):
        bpe.encode(docs, path, P.PATTERN)
    assert bpe.encode(docs.drop("ids").limit(0), path, P.PATTERN).count() == 0
    own = bpe.ByteBPE(bpe.serialise_model(bpe.read_ranks(path)), P.PATTERN)
    assert own.decode(own.encode(["q" * 4000 + " word"])[0]).decode() == "q" * 4000 + " word" and max(map(len, own.cache)) <= bpe.LONGEST


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_equal_library(name, leading):
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS]
    want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    data = open(P.path(name), "rb").read()
    assert [np.frombuffer(x, "<u4").tolist() for x in wordcache.Chunks(data, leading).encode(texts)] == want
    assert wordcache.Chunks(data, leading, True).encode(texts) == [len(w) for w in want]


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_letters_that_normalise_to_marks_equal_library(name, leading):
    from tokenizers import Tokenizer

    odd = [0x130, *range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xFB1D, *range(0xFB2A, 0xFB4F)]
    stems = [s for c in map(chr, odd) if c.isalpha() for s in (f"ka{c}", f"{c}ka", f"K{c}{c}", f"k{c}a")] + ["café", "ΟΔΟΣ", "STRASSE"]
    texts = [f"x {s}{m} y" for s in stems for m in ("", *wordcache.MARKS)]
    want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    data = open(P.path(name), "rb").read()
    for given in (texts, [" ".join(texts)]):
        whole = want if given is texts else [Tokenizer.from_file(P.path(name)).encode(given[0], add_special_tokens=False).ids]
        assert [np.frombuffer(x, "<u4").tolist() for x in wordcache.Chunks(data, leading).encode(given)] == whole
        assert wordcache.Chunks(data, leading, True).encode(given) == [len(w) for w in whole]


@pytest.mark.parametrize(("name", "leading"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_every_letter_beside_every_mark_equals_library(name, leading, monkeypatch):
    """Each alphabetic code point with each mark before and after, as texts between blanks."""
    data = open(P.path(name), "rb").read()
    assert wordcache.takes_leading_blank(data) is leading
    encoder = wordcache.Chunks(data, leading)
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for mark in wordcache.MARKS:
        texts = [x for c in letters for x in (f"a {c}{mark}", f"b {mark}{c}")]
        want = [np.asarray(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == want
        encoder.rest.clear(), encoder.stems.clear()


def test_long_chunks_and_other_files():
    from tokenizers import Tokenizer

    for name, leading in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        data = open(P.path(name), "rb").read()
        texts = [f"x {'ab' * (n // 2)}{c}{m} y" for n in (90, 98, 100, 102, 400) for c in "a\u0130\u0958" for m in ("", ".")]
        want = [e.ids for e in Tokenizer.from_str(data.decode()).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in wordcache.Chunks(data, leading).encode(texts)] == want
        with pytest.raises(ValueError):
            wordcache.takes_leading_blank(data.replace(b"ByteLevel", b"Metaspace"))


def test_packing_covers_each_id_once(spark, docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, P.path("word_bpe_49k.json"), 1, 64).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    pieces = Counter((r.doc_id, r.start, r.length, bytes(r.ids)) for r in rows)
    want = Counter()
    for r in docs.collect():  # with a null id, and a row that repeats
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for length in packing.binary_lengths(len(ids), 64):
            want[r.doc_id, at, length, np.asarray(ids[at : at + length], "<u4").tobytes()] += 1
            at += length
        assert at == len(ids)
    assert pieces == want
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_counts_cache(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    cache, path = fresh_path(spark, "test-cache"), P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    half, every = docs.where("doc_id < 5"), docs
    for given, stored in ((docs.limit(0), None), (half, 4), (every, 11), (every, 11)):  # distinct texts
        got = token_counts.count_tokens(given, path, cache)
        texts = given.select("text").collect()
        want = Counter((len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
        assert Counter((r.n_bytes, r.n_tokens) for r in got.collect()) == want
        if stored:
            assert token_counts.read_cache(spark, cache, token_counts.tokenizer_version(open(path, "rb").read())).count() == stored  # misses alone are appended
    assert stored == len({t or "" for t in TEXTS} | {"null id"})


def test_counts_query_encodes_nothing_twice(spark, sf, monkeypatch):
    cache = fresh_path(spark, "test-query-cache")
    spark.conf.set(queries.CACHE_AT, cache)
    try:
        first = sorted(queries.op3_token_counts(spark, sf).collect())
        rows = spark.read.parquet(cache).count()
        monkeypatch.setattr(token_counts, "loaded", None)  # would fail where a text is encoded
        monkeypatch.setattr(token_counts, "gathered", None)
        assert sorted(queries.op3_token_counts(spark, sf).collect()) == first and spark.read.parquet(cache).count() == rows == len({r.digest for r in spark.read.parquet(cache).collect()})
    finally:
        spark.conf.unset(queries.CACHE_AT)


def test_quality_separates_grades(spark, docs):
    rows = [(i, ("bad### " * 30) if i % 3 == 0 else ("nice moron words here" if i % 3 == 1 else "nice plain words here"), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(df, df, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.predict(df, model, 2).collect()
    assert all(r.kept == (r.grade == 2) for r in got)
    none = quality.fit(docs.limit(0), df.limit(0), 3)
    assert quality.predict(docs.select("doc_id", "text"), none, 2).where("kept").count() == len(TEXTS) + 2


def test_language(spark, docs):
    rows = [(i, "the cat and the dog with this" if i % 2 else "der hund und die katze mit dem", "en" if i % 2 else "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.text: r for r in langid.predict(docs, model, "doc_id", F.col("text").alias("text")).collect()}
    assert got["the cat sat on the mat"].lang_pred == "en" and got[None].lang_pred == got["\n\n"].lang_pred == "und" and got[""].score == 0
    assert langid.train(docs.limit(0).select("text", "lang")).names == []
    many = spark.range(12_000).selectExpr("concat('text number ', id) as text", "case when id % 6 = 0 then concat('odd ', id) when id % 6 < 4 then 'en' else 'de' end as lang")
    assert langid.train(many).names == ["de", "en"]  # two thousand names of one row each are none of the languages


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.SQL[name]).fetchdf()[list(got.columns)]
    assert len(got) > 1 and sorted(map(tuple, got.values.tolist()), key=repr) == sorted(map(tuple, want.values.tolist()), key=repr)


def test_rules_edges(spark, docs):
    got = rules.judge(docs).collect()
    assert len(got) == len(TEXTS) + 2 and not any(r.kept for r in got if r.n_words < 50)
    assert rules.judge(docs.limit(0)).count() == 0
    assert set(rules.keep(docs).columns) == set(docs.columns)


def fast_mcd(z, starts=300):
    """Centre and covariance of the half with the smallest determinant, by sorted distances from random starts, then reweighted."""
    rng, best = np.random.default_rng(1), None
    h = (len(z) + 5) // 2
    for _ in range(starts):
        rows = z[rng.choice(len(z), 6, replace=False)]
        m, c = rows.mean(0), np.cov(rows.T, bias=True) + np.eye(4) * 1e-6
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
            half = z[np.argsort(d, kind="stable")[:h]]
            m, old, c = half.mean(0), c, np.cov(half.T, bias=True)
            if np.allclose(c, old, rtol=1e-9):
                break
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c
    _, m, c = best
    c = c * 2.109 + np.eye(4) * 900
    near = z[np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m) <= 11.143]
    return near.mean(0), np.cov(near.T, bias=True) * 1.0645 + np.eye(4) * 900


def test_rules_find_the_minimum_covariance_determinant(spark):
    """Against an own estimate; without steps, or without the estimated covariance, verdicts differ. Small groups take the language's."""
    rng = np.random.default_rng(3)
    mix = np.array([[20, 0, 0, 0], [12, 16, 0, 0], [-9, 4, 12, 0], [5, -8, 6, 14]], float)

    def rows(source, n, bad, shift):
        clean = rng.normal(size=(n, 4)) @ mix.T + [140, 80, 1600, 400] + shift
        far = rng.normal(size=(bad, 4)) @ mix.T + [240, 150, 1530, 460] + shift  # a group that drags medians and moments along
        s = np.floor(np.vstack([clean, far]) + 0.5).clip(0).astype(int)
        return [("=en", source, 400, False, *map(int, x)) for x in s]

    data = rows("=a", 600, 250, 0) + rows("=b", 150, 40, 6)
    stats = spark.createDataFrame(data, "k_lang string, k_source string, n_words long, base_failed boolean, s1 long, s2 long, s3 long, s4 long")
    stats = stats.selectExpr("*", "monotonically_increasing_id() as i").persist()
    judged = lambda **o: {r.i: (r.k_source, r.d2) for r in rules.verdict(stats, rules.groups(stats, 200, **o)).collect()}
    got, s = judged(), {r.i: r for r in stats.collect()}

    def expected(of, keys):
        raw = np.array([[s[i].s1, s[i].s2, s[i].s3, s[i].s4] for i in of], float)
        middle = np.median(raw, axis=0)
        m, c = fast_mcd(np.floor((raw - middle) * 20 + 0.5))
        x = np.floor((np.array([[s[i].s1, s[i].s2, s[i].s3, s[i].s4] for i in keys], float) - middle) * 20 + 0.5) - m
        return np.einsum("ij,jk,ik->i", x, np.linalg.inv(c), x)

    a = [i for i in s if s[i].k_source == "=a"]
    b = [i for i in s if s[i].k_source == "=b"]
    for keys, of in ((a, a), (b, a + b)):  # b has fewer than 200 documents
        want, own = expected(of, keys), np.array([got[i][1] for i in keys])
        assert np.abs(own - want).max() <= 0.1 * want.max() and np.abs(np.sqrt(own) - np.sqrt(want)).mean() < 0.05
        assert ((own <= rules.CUTOFF) == (want <= rules.CUTOFF)).mean() > 0.995
    kept = np.array([got[i][1] <= rules.CUTOFF for i in a])
    assert kept[:600].mean() > 0.99 and kept[600:].mean() < 0.05
    plain = judged(max_steps=0, starts=1, reweight=False)
    assert sum((plain[i][1] <= rules.CUTOFF) != k for i, k in zip(a, kept, strict=True)) > 5
    raw = np.array([[s[i].s1, s[i].s2, s[i].s3, s[i].s4] for i in a], float)
    ridge_alone = (((raw - np.median(raw, axis=0)) * 20 / rules.RIDGE) ** 2).sum(axis=1) <= rules.CUTOFF
    assert (ridge_alone != kept).sum() > 20
    assert rules.judge(spark.createDataFrame([(1, "x y")], "doc_id long, text string").selectExpr("*", "string(null) as lang", "'s' as source")).first().kept is False


def test_quality_reaches_the_optimum():
    """The penalised likelihood of two thresholds and one weight against a grid."""
    rng = np.random.default_rng(0)
    x = rng.random(60).round(1)
    grades = np.clip((x * 3 + rng.normal(0, 0.7, 60)).astype(int), 0, 2)
    rows = [(np.array([5], np.int32), np.array([v], np.float32)) for v in x]

    def loss(w, t0, t1):
        up = 1 / (1 + np.exp(-(np.array([t0, t1, np.inf])[grades] - w * x)))
        low = 1 / (1 + np.exp(-(np.array([-np.inf, t0, t1])[grades] - w * x)))
        return -np.log(up - low).mean() + 2e-3 / 20 * w * w

    model = quality.fit_arrays(rows, grades, 3, passes=6000, rate=0.02)
    own = loss(model.weights[5], *model.thresholds)
    grid = min(loss(w, a, a + g) for w in np.arange(-2, 12, 0.25) for a in np.arange(-4, 8, 0.25) for g in np.arange(0.1, 6, 0.2))
    assert own <= grid + 1e-4
    short = quality.fit_arrays(rows, grades, 3)
    assert (np.diff(short.thresholds) > 0).all() and loss(short.weights[5], *short.thresholds) < loss(0.0, *np.sort(short.thresholds)) + 0.05
    assert model.tails(np.array([0.3]))[0, 0] == pytest.approx(1 / (1 + math.exp(model.thresholds[0] - 0.3)))


def test_quality_gathers_no_more_than_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda rows, grades, n: seen.append(len(rows)))
    df = spark.createDataFrame([(i % 5, f"text {i}") for i in range(250)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i % 5, i % 3) for i in range(60)], "doc_id long, grade int")
    quality.fit(df, ratings, 3, sample_rows=1)
    quality.fit(df, ratings, 3, sample_rows=7)
    assert seen[0] == 1 and 1 <= seen[1] <= 7


def test_language_mixture_equals_search(spark):
    """Three languages: the query's words mixture by plain loops, and the chosen set against all seven sets."""
    import itertools
    import random

    rng = random.Random(2)
    words = {"aa": ["bako", "latu", "nimo", "sare", "tolu"], "bb": ["sch", "ung", "keit", "ver", "lich"], "cc": ["qwix", "zyph", "vexo", "jazz", "myrrh"]}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = langid.train(spark.createDataFrame([(say(k, 60), k) for k in words for _ in range(20)] + [(None, "aa"), ("x", None)], "text string, lang string"))
    assert model.names == ["aa", "bb", "cc"]
    for shares in ({"aa": 40}, {"aa": 30, "bb": 10}, {"bb": 10, "cc": 10}, {"aa": 15, "bb": 30, "cc": 12}, {"cc": 1}):
        text = " ".join(say(k, n) for k, n in shares.items())
        lang, score, chosen = model.predict(text)
        grams = Counter(langid.trigrams(text).tolist())
        total = sum(grams.values())

        def fitted(of, grams=grams, total=total):
            share = {k: 1 / len(of) for k in of}
            p = {k: {g: math.exp(model.log_p[model.names.index(k), g]) for g in grams} for k in of}
            for _ in range(langid.ROUNDS):
                mix = {g: sum(share[k] * p[k][g] for k in of) for g in grams}
                share = {k: sum(n * share[k] * p[k][g] / mix[g] for g, n in grams.items()) / total for k in of}
            return share, sum(n * math.log(sum(share[k] * p[k][g] for k in of)) for g, n in grams.items())

        sets = [c for n in (1, 2, 3) for c in itertools.combinations(model.names, n)]
        value = {c: fitted(c)[1] - (len(c) - 1) * langid.PENALTY * math.log(total + 1) for c in sets}
        best = max(sets, key=lambda c: value[c])
        assert {k for k, _ in chosen} == set(best) == set(shares)
        share, _ = fitted(best)
        assert lang == max(sorted(share), key=lambda k: share[k]) and score == pytest.approx(max(share.values()), abs=1e-4)
        assert all(s == pytest.approx(share[k], abs=1e-4) and abs(s - shares[k] / sum(shares.values())) < 0.15 for k, s in chosen)
    twins = langid.Languages(["one", "two"], np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)))
    assert twins.predict("word")[0] == "one" and twins.predict("12 .")[0] == "und" and langid.Languages([], np.zeros((0, langid.BUCKETS))).predict("word")[0] == "und"
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), model, "doc_id").count() == 0


def test_likeness_near_the_exact_cosine():
    """The sketch of 256 lanes is off by one sixteenth at one standard deviation."""
    import random

    rng, off = random.Random(4), []
    for _ in range(60):
        a = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(8)]
        b = [p if rng.random() < 0.6 else " ".join(f"w{rng.randrange(60)}" for _ in range(40)) for p in a]
        pairs = [Counter(x for p in t for x in zip(p.split(), [*p.split()[1:], None], strict=True)) for t in (a, b)]
        cosine = sum(n * pairs[1][x] for x, n in pairs[0].items()) / math.sqrt(math.prod(sum(n * n for n in c.values()) for c in pairs))
        off.append(fingerprint.likeness(fingerprint.fingerprint_text("\n".join(a)), fingerprint.fingerprint_text("\n".join(b))) - cosine)
    assert np.abs(off).max() < 0.25 and np.sqrt(np.mean(np.square(off))) < 0.08 and abs(np.mean(off)) < 0.03


def test_fingerprint_query_equals_loop(spark, sf):
    import hashlib

    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    for (k, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [fingerprint.fingerprint_text(t) for t in (text, edited, after)]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[0].hex().upper(), prints[1].hex().upper())
        assert (r.near_edited, r.near_next) == (pytest.approx(fingerprint.likeness(prints[0], prints[1])), pytest.approx(fingerprint.likeness(prints[0], prints[2])))


def test_strong_lanes_are_sums_of_extendable_hashes():
    import hashlib

    text = "one two\nthree\n\none two\n\ud7ff é"
    lanes = [0] * fingerprint.STRONG
    for p in text.split("\n"):
        raw = hashlib.shake_128(p.encode()).digest(8 * fingerprint.STRONG)
        lanes = [(x + int.from_bytes(raw[8 * i : 8 * i + 8], "little")) % 2**64 for i, x in enumerate(lanes)]
    made = fingerprint.fingerprint_text(text)
    assert [int.from_bytes(made[8 * i : 8 * i + 8], "little") for i in range(fingerprint.STRONG)] == lanes


def test_compare_and_clashing_names(spark, docs):
    both = fingerprint.fingerprint(docs.select("doc_id", "text"), "text", "fingerprint", ("fingerprint", "fingerprint", "own"))
    got = fingerprint.compare(both.withColumn("none", F.lit(None).cast("binary")), ("fingerprint", "fingerprint", "again"), ("none", "fingerprint", "nothing")).collect()
    assert all(r.own == r.again == 1 and r.nothing is None for r in got) and len(got) == len(TEXTS) + 2
    for wrong in (lambda: fingerprint.compare(both, ("fingerprint", "fingerprint", "own")), lambda: fingerprint.fingerprint(both), lambda: fingerprint.fingerprint(docs, "text", "f", ("f", "f", "kept"))):
        with pytest.raises(ValueError):
            wrong()


def test_next_of_hot_keys(spark):
    """Most rows share an id or have none: they take several ranges, and each row still has one after it, in one ring."""
    rows = [(7, f"t{i}") for i in range(5000)] + [(None, f"n{i}") for i in range(3000)] + [(i, "x") for i in range(100, 600)] + [(7, "t1")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(df, parts=16).withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(rows) and max(Counter(r.p for r in got).values()) < len(rows) / 4
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.next_doc_id, r.next_text) for r in got) == Counter(rows)
    order = lambda k: -(1 << 63) if k is None else k
    assert sum(order(r.next_doc_id) > order(r.doc_id) for r in got) == 1
    after = {(r.doc_id, r.text): (r.next_doc_id, r.next_text) for r in got if (r.doc_id, r.text) != (r.next_doc_id, r.next_text)}
    at, seen = (599, "x"), set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == len(set(rows))


def test_fingerprint_query_of_null_and_repeated_ids(spark, docs, tmp_path):
    docs.select("doc_id", "text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_fingerprints(spark, str(tmp_path)).collect()
    texts = [*TEXTS, "null id", TEXTS[4]]
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i if i < len(TEXTS) else (None, 4)[i - len(TEXTS)], len(t or "")) for i, t in enumerate(texts))
    assert {r.fingerprint for r in got if r.doc_id == 4} == {fingerprint.fingerprint_text(TEXTS[4]).hex().upper()}


def test_next_row_edges(spark, docs):
    rows = docs.select("doc_id", "text")
    assert fingerprint.with_next(rows.limit(0)).count() == 0
    one = fingerprint.with_next(rows.where("doc_id = 4").limit(1)).collect()
    assert len(one) == 1 and one[0].next_doc_id == 4
    assert fingerprint.with_next(rows, size=F.lit(30_000_000)).count() == len(TEXTS) + 2  # several ranges by their bytes
    with pytest.raises(ValueError):
        fingerprint.with_next(rows.withColumn("next_text", F.lit("")))


def test_reply_tree(spark):
    rows = [("c", 1, None, "user", "hi & <|end|>\n", 0.0), ("c", 2, 1, "assistant", "a|[b]", 1.0), ("c", 3, 1, "assistant", "better", 5.0), ("c", 4, 3, "user", None, None), (None, 1, None, None, "x", 0.0)]
    df = spark.createDataFrame(rows, "conv_id string, node_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf_id): r for r in chat.read_back(chat.format_trees(df, top_k=2)).collect()}
    assert [(t.role, t.text) for t in got["c", 4].turns] == [("user", "hi & <|end|>\n"), ("assistant", "better"), ("user", "")]
    assert got["c", 4].branch_rank == 1 and got["c", 2].loss_text == "a|[b]" and got[None, 1].loss_text == ""
    ring = spark.createDataFrame([("r", 1, 2, "u", "", 0.0), ("r", 2, 1, "u", "", 0.0)], df.schema)
    with pytest.raises(ValueError):
        chat.format_trees(ring)
    assert chat.format_trees(df.limit(0)).count() == 0


def test_reply_trees_equal_walk(spark):
    """Random trees with ties, missing parents, repeated rows, extra columns, and one long trunk with a leaf at each message."""
    import random

    rng, rows = random.Random(5), []
    for c in range(6):
        for node in range(rng.randrange(1, 40)):
            rows.append((f"c{c}", node, rng.choice([None, 999, *range(node)]) if node else None, rng.choice(["user", "assistant"]), f"t{node}", float(rng.randrange(3)), "x"))
    trunk = 150
    for k in range(trunk):
        rows += [("trunk", 2 * k, 2 * k - 2 if k else None, "user", f"m{k}", 0.0, "x"), ("trunk", 2 * k + 1, 2 * k, "assistant", f"l{k}", float(k % 7), "x")]
    rows += [rows[3], ("c1", None, None, "user", "no node", 9.0, "x"), (rows[5][0], rows[5][1], 10**6, "zz", "other", 9.0, "y")]
    df = spark.createDataFrame(rows, "conv_id string, node_id long, parent_id long, role string, text string, score double, _c string")
    nodes = {}
    for c, node, parent, role, text, score, _ in rows:
        if node is not None:
            low = lambda r: tuple((x is not None, x) for x in r)
            nodes[c, node] = min(nodes.get((c, node), (parent, role, text, score)), (parent, role, text, score), key=low)
    want = {}
    for c in {c for c, _ in nodes}:
        own = {n: v for (k, n), v in nodes.items() if k == c}
        inner, best = {v[0] for v in own.values()}, []
        for leaf in sorted(set(own) - inner):
            path, at = [], leaf
            while at in own:
                path.insert(0, at)
                at = own[at][0]
            best.append((-sum(own[n][3] for n in path), leaf, path))
        for rank, (score, leaf, path) in enumerate(sorted(best)[:3], 1):
            want[c, leaf] = (rank, -score, [own[n][1:3] for n in path])
    found = chat.read_back(chat.format_trees(df, top_k=3)).collect()
    assert {(r.conv_id, r.leaf_id): (r.branch_rank, r.branch_score, [(t.role, t.text) for t in r.turns]) for r in found} == want and len(found) == len(want)
    tops, steps = chat.climb(chat.single(df.drop("_c")))
    chosen = tops.where("leaf and conv_id = 'trunk' and depth = 150").select("conv_id", F.col("node_id").alias("leaf_id"))
    assert chat.paths(chosen, steps).count() == 151  # rows of the chosen path alone


def lm_by_counts(split, trains, order):
    """Scores from plain counts of tuples, word by word."""
    counts, begin, end = Counter(), "<begin>", "<end>"
    padded = [[begin, *words, end] for words in split]
    for words, train in zip(padded, trains, strict=True):
        if train:
            for k in range(1, order + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1) if words[i : i + k] != [begin])
    counts[begin,] = counts[end,]
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != (begin,))
    v = sum(c > 0 for g, c in counts.items() if len(g) == 1 and g != (begin,))

    def p(history, w):
        if not history:
            return (counts[w,] + 1) / (n + v + 1)
        c = counts[history]
        x = max(0.0, c - lm.HELD)
        a = lm.WEIGHT * x / (x + lm.DAMP)
        return (a * counts[*history, w] / c if c else 0) + (1 - a) * p(history[1:], w)

    return n, [sum(math.log10(p(tuple(words[max(0, i - order + 1) : i]), words[i])) for i in range(1, len(words))) for words in padded]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_equals_counts(spark, docs, order, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 7)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)  # several blocks and ranges
    more = spark.createDataFrame([(100 + i, " ".join(f"w{(i * j * j) % 9}" for j in range(i * 5))) for i in range(12)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more).repartition(4)
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    given = [(r.doc_id, (r.text or "").encode().lower().split()) for r in rows.collect()]
    n, want = lm_by_counts([t for _, t in given], [not out(k) for k, _ in given], order)
    got = lm.score(rows, fold("doc_id", 7) == 2, order).collect()
    assert {r.train_tokens for r in got} == {n} and len(got) == len(given)  # the row that repeats counts twice
    tell = lambda k, m, s: (-1 if k is None else k, m, round(s, 6))
    assert sorted(tell(r.doc_id, r.n_tokens, r.score) for r in got) == sorted(tell(k, len(t) + 1, s) for (k, t), s in zip(given, want, strict=True))


def test_lm_edges(spark, docs):
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0
    assert {(r.train_tokens, r.base_score, r.score) for r in lm.score(docs, F.lit(True)).collect()} == {(0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        lm.score(docs, F.lit(False), 0)


def test_lm_requests_grow_as_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    many = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.hash("id", i).cast("string"))).alias("text")).coalesce(1)
    small, large = lm.blocks(many(64)), lm.blocks(many(128))
    a, b = small.count(), large.count()
    assert (a, b) == (2, 4) and lm.requests(large, 5, 3).count() == 5 * b and lm.requests(small, 5, 3).count() == 5 * a
    grams = 64 * 401 * 3
    assert lm.requests(small, 100_000, 3).count() <= grams  # no row is empty


def test_fingerprint_is_a_multiset(spark, docs):
    f = fingerprint
    assert f.fingerprint_text("a b\nc d") == f.fingerprint_text("c d\na b") != f.fingerprint_text("c d\na b\na b")
    m = f.Multiset(f.fingerprint_text("a b\nc d")).add("new one").remove("a b")
    assert m.digest() == f.fingerprint_text("c d\nnew one")
    rows = f.with_next(docs.select("doc_id", "text"), parts=3).collect()
    keys = sorted((r.doc_id if r.doc_id is not None else -1 for r in docs.collect()), reverse=True)
    assert Counter((-1 if r.doc_id is None else r.doc_id, -1 if r.next_doc_id is None else r.next_doc_id) for r in rows) == Counter(zip(keys, keys[1:] + keys[:1], strict=True))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 70)])
def test_jaccard_equals_all_pairs(spark, n, num):
    import random

    rng, texts = random.Random(n), ["", None, "a", "a b", "A B"]
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 12, 14, 40, 200]))]
        for _ in range(rng.randrange(1, 25)):
            t = list(base)
            for _ in range(rng.randrange(0, len(t) // 20 + 2)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9000)}"
            texts.append(" ".join(t))
    s = [set(jaccard.shingles(t, n).tolist()) for t in texts]
    root = list(range(len(s)))
    changed = True
    while changed:
        changed = False
        for i in range(len(s)):
            for j in range(i):
                k = len(s[i] & s[j])
                if k and 100 * k >= num * (len(s[i]) + len(s[j]) - k) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    old, jaccard.BLOCK = jaccard.BLOCK, 8
    classes, _ = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, num, 100)
    got = {r.doc_id: r.component_id for r in classes.collect()}
    jaccard.BLOCK = old
    assert [got[i] for i in range(len(s))] == root and len(set(root)) < len(root)


def test_jaccard_repeated_ids_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    base = [f"w{i}" for i in range(40)]
    near = [(100 + i, " ".join([*base[:-1], f"x{i}"])) for i in range(60)]  # one hot group of near copies
    chain = [(300 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(40)]  # each links to its neighbours alone
    rows = [(1, "one two three four"), (1, "five six seven eight"), (2, "FIVE six  seven eight"), (3, "one two three four"), (None, "five six seven eight"), (None, "alone here now"), (7, ""), (8, None), *near, *chain, near[0]]
    classes, links = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    got = {}
    for r in classes.collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert got[1] == [1, 1] and got[2] == [1] and got[3] == [1] and got[7] == [7] and got[8] == [8]
    assert sorted(got[None], key=str) == [1, None]
    assert {c for i, _ in near for c in got[i]} == {100} and len(got[100]) == 2
    assert {c for i, _ in chain for c in got[i]} == {300}
    assert links.count() >= 59 + 39
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
