"""Spans, patterns, overlaps, redaction, pagination on written cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quireflow.functions.spans import literal_pattern, spans
from quireflow.operators import search as S
from quireflow.operators.paginate import clean_line_sql, text_pages_sql, wrap_line_sql


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


def hits(spark, text, kinds=("ssn", "credit_card", "email", "phone"), custom=None):
    df = S.find_patterns(spark.createDataFrame([(1, text)], "doc_id long, text string"), list(kinds), custom)
    return [(h.start, h.end, h.kind) for h in df.first()["hits"]]


def test_spans_match_python_for_many_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab 1é\n") for _ in range(rng.randrange(0, 1500))) for _ in range(40)] + ["", "aaa"]
    for pattern in ("a", "ab+", "[0-9]+", "[^ ]+"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans("t", pattern).alias("s")).collect()
        for r in rows:
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, texts[r.i])]
            assert [(s.start, s.end, s.text) for s in r.s] == want


def test_spans_do_not_find_an_earlier_non_match(spark):
    text = "x123-45-6789 123-45-6789"
    assert hits(spark, text, ["ssn"]) == [(13, 24, "ssn")]


def test_null_text_has_no_spans(spark):
    assert one(spark, F.size(spans("t", "a")), t=None) == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("SSN: 123-45-6789 on file", ["ssn"]),
        ("Order 123456789 shipped", []),
        ("4242 4242 4242 4242", ["credit_card"]),
        ("4242 4242 4242 4243", []),
        ("Invoice 1234567812345678", []),
        ("a.b-c@example.co.uk or (555) 123-4567", ["email", "phone"]),
        ("call 555-123-4567 today", ["phone"]),
        ("é123-45-6789", []),
    ],
)
def test_pattern_facts(spark, text, want):
    assert [k for *_, k in hits(spark, text)] == want


def test_custom_patterns(spark):
    assert hits(spark, "PROJECT-42 and PROJECT-x", [], [r"PROJECT-\d+"]) == [(0, 10, "custom")]
    with pytest.raises(ValueError, match="unclosed"):
        hits(spark, "x", [], ["[unclosed"])
    with pytest.raises(ValueError, match="unknown pattern kind"):
        hits(spark, "x", ["iban"])


def test_overlaps_keep_the_first_and_longest(spark):
    # a phone inside a card, and two hits that touch
    assert hits(spark, "4242424242424242", ["credit_card", "phone"]) == [(0, 16, "credit_card")]
    assert hits(spark, "abab", [], ["ab", "abab", "b"]) == [(0, 4, "custom")]
    assert hits(spark, "abab", [], ["ab"]) == [(0, 2, "custom"), (2, 4, "custom")]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    groups = []
    for g in range(30):
        items = [(s := rng.randrange(60), s + rng.randrange(1, 15)) for _ in range(rng.randrange(0, 40))]
        groups.append((g, [(s, e, "k", "") for s, e in items]))
    df = spark.createDataFrame(groups, f"g int, h array<{S.HIT}>").select("g", S.resolve_overlaps("h").alias("r"))
    for row in df.collect():
        last, want = -1, []
        for s, e in sorted([h[:2] for h in groups[row.g][1]], key=lambda x: (x[0], -(x[1] - x[0]))):
            if s >= last:
                want.append((s, e))
                last = e
        assert [(r.start, r.end) for r in row.r] == want


def test_redaction_removes_the_text_and_checks_itself(spark):
    text = "mail a@b.org, call 555-123-4567."
    df = S.redact_text(S.find_patterns(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["email", "phone"]))
    row = df.first()
    assert (row.redacted, row.removed) == ("mail , call .", 2)
    needles = spark.createDataFrame([(1, "a@b.org", False), (1, "mail", True)], "doc_id long, needle string, must_survive boolean")
    assert S.confirm_removed(df, needles, ["doc_id"], "redacted").first()["passed"]
    # both directions: an untouched text leaks, an empty one loses its control
    assert S.confirm_removed(df, needles, ["doc_id"], "text").first()["leaked"] == 1
    assert S.confirm_removed(df.withColumn("redacted", F.lit("")), needles, ["doc_id"], "redacted").first()["vanished"] == 1


def test_redaction_of_many_hits_equals_python(spark):
    text = "".join(f"é{i} word {i * 7} " for i in range(200))
    df = S.redact_text(S.find_patterns(spark.createDataFrame([(1, text)], "doc_id long, text string"), [], ["[0-9]+"]))
    row = df.first()
    assert row.removed == 400 and row.redacted == re.sub("[0-9]+", "", text)


def test_search_options(spark):
    df = spark.createDataFrame([(1, "The théthe the. THE (a+b) étHE")], "doc_id long, text string")
    found = lambda q, **o: [(r.start, r.end) for r in S.search(df, q, **o).orderBy("start").collect()]
    assert found("the") == [(0, 3), (7, 10), (11, 14), (16, 19), (27, 30)]
    assert found("The", case_sensitive=True) == [(0, 3)]
    # the ASCII boundary: é is no word character
    assert found("the", whole_word=True) == [(0, 3), (7, 10), (11, 14), (16, 19), (27, 30)]
    assert found("(a+b)") == [(20, 25)]
    assert found("É") == [(6, 7), (26, 27)]
    assert found("") == []
    assert literal_pattern("a.b", True) == r"a\.b"


def reference_wrap(line, width):
    """Step-by-step greedy wrap for comparison."""
    if len(line) <= width:
        return [line]
    cjk = lambda c: "一" <= c <= "鿿"
    tokens = []
    for c in line:
        if tokens and not cjk(c) and not cjk(tokens[-1][-1]) and (c == " ") == (tokens[-1][-1] == " "):
            tokens[-1] += c
        else:
            tokens.append(c)
    out, cur = [], ""
    for t in tokens:
        if len(cur + t) <= width:
            cur += t
            continue
        if cur.strip():
            out.append(cur.rstrip(" "))
        cur = ""
        if t.startswith(" "):
            continue
        for c in t:
            if cur and len(cur) + 1 > width:
                out.append(cur)
                cur = ""
            cur += c
    if cur.strip():
        out.append(cur.rstrip(" "))
    return out


def test_wrap_against_brute_force(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice("aab  c漢字") if rng.random() < 0.9 else "x" * rng.randrange(30) for _ in range(rng.randrange(90))) for _ in range(300)]
    lines += ["", " " * 30, "   " + "x" * 50, "a" * 12, "a" * 13, "aaa bbb ccc dd e f"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", F.expr(wrap_line_sql("t", "12")).alias("w")).collect()
    for r in rows:
        assert r.w == reference_wrap(lines[r.i], 12), lines[r.i]


def test_pages(spark):
    pages = lambda t, n=2: one(spark, F.expr(text_pages_sql("t", "10", str(n))), t=t)
    assert pages("a\r\nb\rc\n") == [["a", "b"], ["c"]]
    assert pages("a\fb\f") == [["a"], ["b"]]
    assert pages("") == []
    assert pages("a\n\n\n\n\n") == [["a", ""]]
    assert pages("\n\na") == [["", ""], ["a"]]
    assert one(spark, F.expr(clean_line_sql("t")), t="ab\tc\u0085\x01\t\td") == "ab      c               d"
