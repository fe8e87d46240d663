"""Forms, threads, hierarchies, signatures, interchange."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import annotations as A
from quireflow.operators import forms as M
from quireflow.operators import hierarchy as H

ANN = "doc_id long, id string, seq long, page long, kind string, contents string, author string, modified long, in_reply_to string"


def notes(spark, *rows):
    return spark.createDataFrame([(1, i, n, p, k, c, a, m, r) for n, (i, p, k, c, a, m, r) in enumerate(rows)], ANN)


def sample(spark):
    return notes(
        spark, ("1", 2, "note", "hello world", "Ada", 2000, None), ("2", 0, "highlight", "important", "Bo", None, None), ("3", 0, "freetext", "a caption", "Ada", 5000, None)
    )


@pytest.mark.parametrize(
    "options,want",
    [
        ({}, "123"), ({"search": " WORLD "}, "1"), ({"search": "free TEXT"}, "3"), ({"kinds": ["note", "ink"]}, "1"), ({"author": "Ada"}, "13"),
        ({"modified_after": 2000}, "13"), ({"modified_after": 2001, "author": "Ada"}, "3"), ({"search": "ada note"}, "1"),
    ],
)
def test_filters(spark, options, want):
    got = A.filter_annotations(sample(spark), **options).select("id").collect()
    assert "".join(sorted(r.id for r in got)) == want


def test_kinds_in_display_order(spark):
    assert A.distinct_kinds(sample(spark)).first()["kinds"] == ["highlight", "note", "freetext"]


def thread_reference(parents):
    def root(n):
        seen, cur = set(), n
        while parents[cur] is not None and parents[cur] in parents and cur not in seen:
            seen.add(cur)
            cur = parents[cur]
        return cur

    return {n: root(n) for n in parents}


def test_threads_with_cycles_tails_and_orphans(spark):
    rng = random.Random(9)
    for trial in range(3):
        names = [f"n{i}" for i in range(40)]
        parents = {n: rng.choice([None, "gone", *names]) for n in names}
        if trial == 0:
            parents = {"a": "b", "b": "c", "c": "a", "t": "u", "u": "a", "self": "self", "o": "gone", "r": None, "x": "r", "y": "x", **{f"d{i}": f"d{i - 1}" if i else None for i in range(30)}}
        df = notes(spark, *[(n, 0, "note", "", "", None, p) for n, p in parents.items()])
        got = {r.id: r.root_id for r in A.build_threads(df).collect()}
        assert got == thread_reference(parents)


def test_replies_are_in_order_of_date(spark):
    df = notes(spark, ("r", 0, "note", "", "", 9, None), ("a", 0, "note", "", "", 5, "r"), ("b", 0, "note", "", "", None, "a"), ("c", 0, "note", "", "", 5, "b"), ("d", 0, "note", "", "", 1, "r"))
    got = {r.id: r.reply_no for r in A.build_threads(df).collect()}
    assert got == {"r": None, "b": 0, "d": 1, "a": 2, "c": 3}


def test_import_of_replies(spark):
    old = notes(spark, ("old", 0, "note", "", "", None, None))
    new = notes(
        spark, ("top", 1, "note", "", "", None, None), ("far", 9, "note", "", "", None, None), ("a", 0, "note", "", "", None, "old"), ("b", 0, "note", "", "", None, "a"),
        ("c", 0, "note", "", "", None, "far"), ("d", 0, "note", "", "", None, "missing"), ("e", 0, "note", "", "", None, "f"), ("f", 0, "note", "", "", None, "e"), ("g", 0, "note", "", "", None, "top"),
    )
    counts = spark.createDataFrame([(1, 2)], "doc_id long, page_count long")
    assert sorted(r.id for r in A.import_replies(old, new, counts).collect()) == ["a", "b", "g", "top"]


def test_interchange_round_trip(spark):
    df = notes(spark, ("x<1", 3, "note", 'a & "b"\n<c>', "Ada", None, None), ("y", 0, "rectangle", "", "", None, "x<1"), ("z", 0, "measure", "", "", None, None))
    x = A.xfdf_document(A.annotations_to_xfdf(df.withColumn("rect", F.lit("1, 2;3 4"))))
    assert x.first()["written"] == 2
    got = {r["name"]: (r.element, r.page, r.contents, r.author, r.in_reply_to, r.rect) for r in A.parse_xfdf_annotations(x).collect()}
    rect = [1.0, 2.0, 3.0, 4.0]
    assert got == {"x<1": ("text", 3, 'a & "b"\n<c>', "Ada", None, rect), "y": ("square", 0, "", "", "x<1", rect)}


def test_interchange_attributes(spark):
    xml = """<xfdf><annots><line page=' 2 ' start="1,2" end="3;4" head="None" tail='OpenArrow' rect="1 2"/><bogus page="1"/>
      <ink page="x" color="#ff0000" opacity="0.5" width="2"><inklist><gesture>1,2;3,4</gesture></inklist></ink><line head="none"/></annots></xfdf>"""
    got = A.parse_xfdf_annotations(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).orderBy("seq").collect()
    assert [(r.element, r.page, r.arrow, r.line, r.gesture) for r in got] == [
        ("line", 2, True, [1.0, 2.0, 3.0, 4.0], []), ("ink", 0, False, [], [1.0, 2.0, 3.0, 4.0]), ("line", 0, False, [], []),
    ]
    assert (got[0].rect, got[1].opacity, got[1].color) == ([0.0] * 4, 0.5, "#ff0000")


def test_measures(spark):
    pts = "transform(array({}), v -> named_struct('x', CAST(v[0] AS DOUBLE), 'y', CAST(v[1] AS DOUBLE)))"
    square = F.expr(pts.format("array(0,0), array(3,0), array(3,4), array(0,4)"))
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(A.measure(square, "distance")) == 4.0
    assert one(A.measure(square, "perimeter", 2.0)) == 20.0
    assert one(A.measure(square, "area", 2.0)) == 48.0
    line = F.expr(pts.format("array(0,0), array(3,4)"))
    assert one(A.measure(line, "area")) == 0.0
    assert A.calibration(0, 5) == 1.0 and A.calibration(10, 5) == 0.5
    assert one(A.format_measurement("area", F.lit(12.345), "cm")) == "12.35 cm²"
    assert one(A.format_measurement("distance", F.lit(12.0), "pt")) == "12 pt"


def test_csv_rows(spark):
    rows = lambda t: spark.createDataFrame([(t,)], "t string").select(M.csv_rows(F.col("t")).alias("r")).first()["r"]
    assert rows('a,"b,c","say ""hi"""') == [["a", "b,c", 'say "hi"']]
    assert rows('a,b\r\n"x\ny",z\n')[:2] == [["a", "b"], ["x\ny", "z"]]
    assert rows("a,\nb") == [["a", ""], ["b"]]


def test_form_files(spark):
    df = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    csv = M.parse_form_csv(df("name,type,value\na,text,x;y\nb,list,\nlonely\n")).orderBy("seq").collect()
    assert [(r["name"], r.kind, r.value) for r in csv] == [("a", "text", ["x", "y"]), ("b", "list", [])]
    assert M.parse_form_json(df("not json")).first()["error"] == "unreadable JSON form data"
    assert M.parse_form_json(df("[]")).count() == 0
    assert M.parse_form_xfdf(df("<x/>")).first()["error"].startswith("not an XFDF file")
    x = M.parse_form_xfdf(df("<xfdf><fields><field name='a'><value>1</value><value>&lt;2&gt;</value></field><field ><value>9</value></field></fields></xfdf>")).collect()
    assert [(r["name"], r.value) for r in x] == [("a", ["1", "<2>"])]
    with pytest.raises(ValueError):
        M.write_form_data(df(""), "fdf", "seq")


def test_every_format_round_trips(spark):
    data = spark.createDataFrame([(1, 0, 'a "q", <&>', "text", ["x", "é'\n"]), (1, 1, "b", "list", []), (1, 2, "c", "pushbutton", ["z"])], "doc_id long, seq long, name string, kind string, value array<string>")
    for fmt, parse in (("json", M.parse_form_json), ("csv", M.parse_form_csv), ("xfdf", M.parse_form_xfdf)):
        back = parse(M.write_form_data(data, fmt, "seq")).orderBy("seq").collect()
        assert [(r["name"], r.value) for r in back] == [('a "q", <&>', ["x", "é'\n"]), ("b", [])], fmt


def test_import_rules(spark):
    fields = spark.createDataFrame(
        [
            (1, "t", "text", 0, 3, [], []), (1, "r", "radio", 0, None, [], ["Red", "Green"]), (1, "l", "list", 1 << 21, None, ["a", "b"], []),
            (1, "one", "list", 0, None, ["a"], []), (1, "s", "signature", 0, None, [], []), (1, "p", "pushbutton", 1 << 16, None, [], []),
        ],
        "doc_id long, name string, kind string, ff long, max_len long, options array<string>, on_states array<string>",
    )
    rows = [("t", "", ["abcdef"]), ("r", "radio", ["Blue"]), ("r", "radio", ["Off"]), ("l", "list", ["a", "b"]), ("one", "", ["a", "b"]), ("s", "signature", []), ("p", "", []), ("t", "list", ["x"]), ("ghost", "", []), ("l", "list", ["zz"])]
    data = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, seq long, name string, kind string, value array<string>")
    judged = M.import_form_data(fields, data)
    got = {r.seq: (r.outcome, r.expected, r.new_value) for r in judged.collect()}
    assert got[0] == ("applied", None, ["abc"]) and got[2] == ("applied", None, ["Off"]) and got[3] == ("applied", None, ["a", "b"])
    assert [got[i][:2] for i in (1, 4, 5, 6, 7)] == [("mismatched", e) for e in ("state Blue", "2 values", "signature", "", "list")]
    assert got[8][0] == "unmatched"
    assert M.choice_errors(judged, fields).first()["error"] == "not an option of l: zz"
    line = M.import_report(judged, "seq").first()["summary"]
    assert line.startswith("Filled 4 fields · 1 not in this form (ghost) · r: data says state Blue, field is radio")
    assert "p: data says no type, field is pushbutton" in line


def test_names_stop_at_32_levels(spark):
    rows = [(1, f"f{i}", f"f{i - 1}" if i else None, "" if i == 38 else str(i)) for i in range(40)]
    names = {r.field_id: r.qualified for r in H.qualified_names(spark.createDataFrame(rows, "doc_id long, field_id string, parent_id string, t string")).collect()}
    assert names["f3"] == "0.1.2.3"
    assert names["f39"] == ".".join(str(i) for i in range(8, 40) if i != 38)


def test_outline_order(spark):
    rows = [(1, 10, None, 2, "B"), (1, 11, None, 1, "A"), (1, 12, 10, 1, "B1"), (1, 13, 12, 1, "B11"), (1, 14, 11, 1, "A1")]
    flat = H.outline_flatten(spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, seq long, title string")).orderBy("position").collect()
    assert [(r.title, r.depth) for r in flat] == [("A", 0), ("A1", 1), ("B", 0), ("B1", 1), ("B11", 2)]


def test_outline_ties_cycles_and_long_chains(spark):
    schema = "doc_id long, node_id long, parent_id long, seq long, title string"
    tied = [(1, 1, None, 0, "A"), (1, 2, None, 0, "B"), (1, 3, 1, 0, "A1"), (1, 4, 2, 0, "B1"), (1, 5, 1, 0, "A2")]
    flat = H.outline_flatten(spark.createDataFrame(tied, schema)).orderBy("position").collect()
    assert [r.title for r in flat] == ["A", "A1", "A2", "B", "B1"]
    cycle = [(1, 1, 2, 1, "x"), (1, 2, 1, 2, "y"), (1, 3, 2, 1, "tail"), (1, 4, 4, 3, "self"), (1, 5, 99, 4, "lost")]
    flat = H.outline_flatten(spark.createDataFrame(cycle, schema)).orderBy("position").collect()
    assert [(r.title, r.depth) for r in flat] == [("x", 0), ("y", 0), ("tail", 1), ("self", 0), ("lost", 0)]
    chain = [(1, i, i - 1 if i else None, 0, str(i)) for i in range(300)]
    flat = H.outline_flatten(spark.createDataFrame(chain, schema)).orderBy("position").collect()
    assert [(r.node_id, r.depth) for r in flat] == [(i, i) for i in range(300)]


def test_updates(spark):
    f = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "doc_id long, name string, max_len long")
    u = spark.createDataFrame([(1, "a", "b", 9), (1, "b", "b", 7)], "doc_id long, name string, new_name string, max_len long")
    out, rejected = M.upsert_fields(f, u, ["max_len"])
    assert sorted(map(tuple, out.select("name", "max_len").collect())) == [("a", 5), ("b", 7)]
    assert rejected.first()["error"] == "a field named b already exists"
