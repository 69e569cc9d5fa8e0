"""Personal data and conversation repair against brute force, on small tables."""

import hashlib
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from spectrel.llm import pii, pii_sql, repair

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    return {"email": True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rule in RULES.items() for m in re.finditer(rule, text) if passes(k, m.group())]


ODD = [
    None, "", " ", "none here", "a@b.c_d@e.f x@y.z@q.r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.00001 99999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "+1 - (729) - 555.7725) +1 (729) 555-7725 12 +12 +123456789 ++49 30 1234567-", "é𝄞 a@b.co 𝄞 9\x0b10.0.0.1", "z" * 60_000, "a" * 30_000 + "@" + "b.c" * 9000, "1 " * 30_000, "x 1 " * 3000, "+1" + " " * 30_000 + "5", "1" + "*" * 40_000 + "1",
    "a@1.2.3.4 +4111111111111111", "tel:+49-30-123456789, ip=10.0.0.1; <a@b.c>", "1-2-3 4.5.6.7- - 8",
]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a@b.co", None), (4, ODD[4], None)], "doc_id long, text string, row string")
    got = pii.report(pii.find(df)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        want = base_spans("a@b.co" if r.doc_id is None else ODD[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}, r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in RULES]
    assert pii.report(pii.find(df.limit(0))).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    """Instances of no rule in contexts of one kind are found, in two steps; those of mixed contexts, and what has no phone's make, are not."""
    rows = [f"please call me at +1 ({i:03d}) 555-{i:04d} soon" for i in range(100, 160)] + [f"write to u{i}@mail{i}.org now" for i in range(12)]
    rows += ["please call me at 0171 5557725 soon", "please call me at 2024 soon", "please call me at noon soon"]
    rows += [f"mobile number 0171 {i}57725 there" for i in range(5, 13)] + [f"please call me at 0171 {i}57725 soon" for i in range(5, 12)]  # a pattern that discovered instances make
    mixed = [f"see {x} here" for i in range(12) for x in (f"+1 ({i:03d}) 555-0000", f"a{i}@b.org", f"10.0.0.{i}", f"7{i}")] + ["see 0171 1111111 here"]
    df = spark.createDataFrame(list(enumerate(rows + mixed)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(pii.find(df)).collect()}
    for i, text in enumerate(rows + mixed):
        found = re.search(r"0171 \d+", text)
        want = base_spans(text) + ([f"phone:{found.start()}:{found.end()}"] if found and i < len(rows) else [])
        assert got[i] == ",".join(want), (i, text)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t in enumerate(rows + mixed)])
    assert dict(con.execute(f"select doc_id, spans from ({pii_sql.op11()})").fetchall()) == got
    alone = {r.doc_id: r.spans for r in pii.report(pii.find(df, rounds=1)).collect()}
    assert sum(map(bool, alone.values())) == sum(map(bool, got.values())) - 1  # "mobile number" takes a second round


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(1000)),), ([1, 2, 3, 4, 5],)], "a array<int>")
    for r in df.select("a", pii.running(F.col("a")).alias("s")).collect():
        assert r.s == list(itertools.accumulate(r.a))


def cheapest(turns):
    """The least (cost, audit) over all edits, by trying them; at most two insertions stand together."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None
    inserted = ["", "u", "a", "ua", "au"]
    for gaps in itertools.product(inserted, repeat=len(turns) + 1):
        for edits in itertools.product("KUAD", repeat=len(turns)):
            cost, audit, roles = 0, "", ""
            for gap, edit, (initial, gone, cut) in itertools.zip_longest(gaps, edits, turns, fillvalue=(None, None, None)):
                audit, roles, cost = audit + "I" * len(gap), roles + gap, cost + 2 * len(gap)
                if not isinstance(edit, str):
                    continue
                if edit != "D" and gone:
                    break
                cost += 3 if edit == "D" else cut + 2 * (edit != "K")
                audit += "R" if edit in "UA" else edit
                roles += {"K": initial, "D": ""}.get(edit, edit.lower())
            else:
                if legal.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_fold_is_cheapest_and_least(spark):
    kinds = [("s", False, False), ("u", False, False), ("a", False, True), ("a", False, False), ("u", True, False), ("t", False, False)]
    cases = [list(c) for n in range(4) for c in itertools.product(kinds, repeat=n)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t array<struct<initial:string,gone:boolean,cut:boolean>>")
    for r in df.select("i", repair.cheapest(F.col("t")).alias("b")).collect():
        assert (r.b.cost, r.b.audit) == cheapest(cases[r.i]), cases[r.i]


def said(rows):
    return [f"{x.role}:{x.text}" for x in rows]


def test_repair_edges(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 5, "user", "Hi."), (1, 6, "assistant", "cut off"),
        (None, None, None, None), (None, 3, "assistant", "Fine!"), (2, 1, "", "x."), (3, 2, "tool", "Done?"), (3, 2, "tool", "Done?"), (4, 0, "assistant", " \t"), (5, 0, "system", "Be."),
    ]
    df = spark.createDataFrame([(*r, "clash", i != 9) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, fault string, here boolean")
    got = {r.conv_id: r for r in repair.repair(df, present="here").collect()}
    assert len(got) == 6
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 0, 1, 1, 0, 6, "KKDD") and said(one.repaired) == ["user:Hi.", "assistant:Yes."]
    assert (got[None].gaps, got[None].blank, got[None].audit, said(got[None].repaired)) == (0, 1, "DIK", ["user:", "assistant:Fine!"])
    assert (got[2].cost, got[2].audit) == (3, "D") and (got[3].duplicate, got[3].audit, got[3].illegal) == (1, "DD", 1)
    assert (got[4].cost, got[4].audit, got[4].repaired, got[4].blank) == (0, "", [], 0) and (got[5].cost, got[5].audit) == (3, "D")
    assert repair.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3000])
def test_repair_of_a_long_conversation(spark, n):
    """Thousands of turns, one of them very long; every other answer is missing."""
    rows = [(7, i, "user" if i % 3 else "assistant", f"{i} " + "word " * (40_000 if i == 5 else 1) + ".") for i in range(n)]
    r = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    roles = [x.role for x in r.repaired]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in roles)) and len(r.audit.replace("I", "")) == n and r.illegal == sum(1 for i in range(1, n) if i % 3 == 2)
    assert r.cost == sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in r.audit)
