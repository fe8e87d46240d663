"""Forms, comments, hierarchies and signatures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import forms as M
from ..operators import hierarchy as H
from ..session import checkpoint_dir
from ..sources import sinks
from ..sources.ordered import read_whole
from .registry import query
from .views import KINDS, SQL_VIEWS

_LABELS = list(A.KIND_LABELS.values())
_join = lambda c: F.array_join(c, "|")


@query("filter_annotations", "P3", f"""
    SELECT doc_id, id FROM annotations WHERE kind IN ('note', 'rectangle', 'strikeout', 'stamp') AND author = 'user' AND modified >= 1704067200000 + 3600000
      AND contains(lower(contents || ' ' || author || ' ' || {_LABELS!r}[seq % 14 + 1]), 'que')""", "annotations")
def filter_annotations(v):
    out = A.filter_annotations(v.annotations(), " QUE ", ["note", "rectangle", "strikeout", "stamp"], "user", 1704067200000 + 3600000)
    return out.select("doc_id", "id")


@query("filter_by_kind_label", "P3", f"""
    SELECT doc_id, id FROM annotations WHERE contains(lower(contents || ' ' || author || ' ' || {_LABELS!r}[seq % 14 + 1]), 'free text')""", "annotations")
def filter_by_kind_label(v):
    return A.filter_annotations(v.annotations(), "Free text").select("doc_id", "id")


@query("distinct_authors", "A4", "SELECT DISTINCT doc_id, author FROM annotations WHERE author <> ''", "annotations")
def distinct_authors(v):
    return A.distinct_authors(v.annotations())


@query("distinct_kinds", "A4", """
    SELECT doc_id, string_agg(kind, '|' ORDER BY seq % 14) AS kinds FROM (SELECT DISTINCT doc_id, kind, seq % 14 AS seq FROM annotations) GROUP BY doc_id""", "annotations")
def distinct_kinds(v):
    return A.distinct_kinds(v.annotations()).select("doc_id", _join("kinds").alias("kinds"))


@query("group_by_page", "A5", """
    SELECT doc_id, page, id, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1 AS item_no FROM annotations""", "annotations")
def group_by_page(v):
    return A.group_by_page(v.annotations()).select("doc_id", "page", "id", "item_no")


@query("build_threads", "H1", """
    WITH RECURSIVE t AS (
      SELECT a.doc_id, a.id, a.seq, a.modified, a.id AS root_id FROM annotations a LEFT JOIN annotations p ON p.doc_id = a.doc_id AND p.id = a.in_reply_to
      WHERE p.id IS NULL
      UNION ALL SELECT a.doc_id, a.id, a.seq, a.modified, t.root_id FROM t JOIN annotations a ON a.doc_id = t.doc_id AND a.in_reply_to = t.id)
    SELECT doc_id, id, root_id, CASE WHEN id <> root_id THEN row_number() OVER (PARTITION BY doc_id, root_id, id = root_id ORDER BY coalesce(modified, 0), seq) - 1 END AS reply_no
    FROM t""", "annotations")  # fmt: skip
def build_threads(v):
    return A.build_threads(v.annotations()).select("doc_id", "id", "root_id", "reply_no")


@query("import_replies", "H2", """
    WITH RECURSIVE inc AS (SELECT * FROM annotations WHERE seq % 4 <> 1),
    t AS (SELECT * FROM inc WHERE (in_reply_to IS NULL AND page < 2 AND doc_id % 3 <> 0) OR in_reply_to IN (SELECT id FROM annotations WHERE seq % 4 = 1)
          UNION ALL SELECT inc.* FROM t JOIN inc ON inc.doc_id = t.doc_id AND inc.in_reply_to = t.id)
    SELECT DISTINCT doc_id, id FROM t""", "annotations")
def import_replies(v):
    a = v.annotations()
    old, new = a.filter("seq % 4 = 1"), a.filter("seq % 4 <> 1")
    counts = a.select("doc_id").distinct().withColumn("page_count", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2))
    return A.import_replies(old, new, counts).select("doc_id", "id")


_SUBTYPES = list(A.SUBTYPE_KINDS)


@query("annotation_kind", "H5", f"""
    SELECT doc_id, id, CASE WHEN seq % 4 = 3 THEN 'measure' ELSE {list(A.SUBTYPE_KINDS.values())!r}[(doc_id + seq) % 14 + 1] END AS kind
    FROM annotations WHERE (doc_id + seq) % 14 < 13""", "annotations")
def annotation_kind(v):
    i = (F.col("doc_id") + F.col("seq")) % 14 + 1
    sub = F.element_at(F.array(*[F.lit(s) for s in [*_SUBTYPES, "Popup"]]), i.cast("int"))
    intent = F.when(F.col("seq") % 4 == 3, F.lit("LineDimension"))
    return A.annotation_kind(v.annotations().drop("kind").withColumns({"subtype": sub, "intent": intent})).select("doc_id", "id", "kind")


def _dated(v):
    d = F.date_format(F.timestamp_millis("modified"), "'D:'yyyyMMddHHmmss")
    r = F.concat_ws(",", F.col("seq"), F.col("page") * 10, F.col("seq") + 0.5, F.lit(792))
    return v.annotations().withColumns({"date": d, "rect": r})


_ELEMENTS = """
    WITH e AS (SELECT *, replace(replace(replace(replace(replace(contents, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS c,
      CASE kind WHEN 'note' THEN 'text' WHEN 'rectangle' THEN 'square' WHEN 'ellipse' THEN 'circle' ELSE kind END AS el FROM annotations WHERE kind <> 'measure')
    SELECT doc_id, page, seq, '<' || el || ' page="' || page || '" rect="' || seq || ',' || page * 10 || ',' || (seq + 0.5)::DECIMAL(10,1) || ',792" title="' || author || '" name="' || id || '"'
      || CASE WHEN modified IS NULL THEN '' ELSE ' date="D:' || strftime(make_timestamp(modified * 1000), '%Y%m%d%H%M%S') || '"' END
      || CASE WHEN in_reply_to IS NULL THEN '' ELSE ' inreplyto="' || in_reply_to || '"' END || '><contents>' || c || '</contents></' || el || '>' AS element FROM e"""


@query("annotations_to_xfdf", "K5", f"""
    SELECT doc_id, page, count(*) AS written, sha256(string_agg(element, chr(10) ORDER BY seq)) AS digest FROM ({_ELEMENTS}) GROUP BY doc_id, page""", "annotations")  # fmt: skip
def annotations_to_xfdf(v):
    return A.annotations_to_xfdf(_dated(v)).select("doc_id", "page", "written", F.sha2("annots", 256).alias("digest"))


@query("xfdf_files", "K5", f"""
    SELECT doc_id || '.xfdf' AS file_name, length(text) AS chars, sha256(text) AS digest FROM (
      SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">' || chr(10) || '<annots>' || chr(10)
             || string_agg(element, chr(10) ORDER BY page, seq) || chr(10) || '</annots>' || chr(10) || '</xfdf>' || chr(10) AS text
      FROM ({_ELEMENTS}) GROUP BY doc_id)""", "annotations")  # fmt: skip
def xfdf_files(v):
    return _written(v, lambda path: sinks.write_xfdf(_dated(v), path))


@query("parse_xfdf_annotations", "S13 F17", """
    SELECT doc_id, id AS name, page, author, contents, in_reply_to, seq + 0.5::DOUBLE AS x1, CASE WHEN modified IS NOT NULL THEN 'D:' || strftime(make_timestamp(modified * 1000), '%Y%m%d%H%M%S') END AS date,
           CASE kind WHEN 'note' THEN 'text' WHEN 'rectangle' THEN 'square' WHEN 'ellipse' THEN 'circle' ELSE kind END AS element FROM annotations WHERE kind <> 'measure'""", "annotations")
def parse_xfdf_annotations(v):
    x = A.xfdf_document(A.annotations_to_xfdf(_dated(v))).drop("written")
    p = A.parse_xfdf_annotations(x)
    return p.select("doc_id", "name", "page", "author", "contents", "in_reply_to", F.get("rect", F.lit(2)).alias("x1"), "date", "element")


@query("quads_bounds", "A16", """
    SELECT doc_id, page_no, min("left") AS x0, min(top) AS y0, max("right") AS x1, max(bottom) AS y1 FROM runs WHERE bold GROUP BY ALL""", "runs")
def quads_bounds(v):
    return A.quads_bounds(v.runs().filter("bold"), ["doc_id", "page_no"])


@query("measure", "W14 F16", """
    WITH p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) * 1000 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 1000 AS y FROM embeddings, range(0, 8) t(i)),
    s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i))
    SELECT vec_id, round(max(CASE WHEN i = 7 THEN sqrt((x - fx) ** 2 + (y - fy) ** 2) END) * 2, 6) AS distance, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) * 2, 6) AS perimeter,
           round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 * 4, 4) AS area FROM s GROUP BY vec_id""")
def measure(v):
    pts = F.expr("transform(sequence(0, 7), i -> named_struct('x', CAST(embedding[2 * i] AS DOUBLE) * 1000, 'y', CAST(embedding[2 * i + 1] AS DOUBLE) * 1000))")
    u = A.calibration(10, 20)
    e = v.table("embeddings", "vec_id", "embedding").select("vec_id", pts.alias("p"))
    return e.select("vec_id", F.round(A.measure(F.col("p"), "distance", u), 6).alias("distance"), F.round(A.measure(F.col("p"), "perimeter", u), 6).alias("perimeter"),
                    F.round(A.measure(F.col("p"), "area", u), 4).alias("area"))


@query("field_kinds", "P8", "SELECT doc_id, name, kind FROM field_kinds", "field_kinds")
def field_kinds(v):
    return M.with_kind(v.fields()).select("doc_id", "name", "kind")


@query("unsigned_fields", "P8", "SELECT doc_id, name FROM fields WHERE ft = 'Sig' AND doc_id % 2 = 0", "fields")
def unsigned_fields(v):
    signed = F.when((F.col("ft") == "Sig") & (F.col("doc_id") % 2 == 1), F.array(F.lit("x"))).otherwise(F.col("value"))
    return M.unsigned_fields(M.with_kind(v.fields()).withColumn("value", signed)).select("doc_id", "name")


@query("page_fields", "P8", """
    SELECT doc_id, seq % 2 AS page_no, CASE WHEN kind = 'checkbox' OR kind = 'pushbutton' THEN 'group' ELSE name END AS name, arg_min(kind, seq) AS kind, min(seq)::BIGINT AS seq
    FROM field_kinds GROUP BY ALL""", "field_kinds")
def page_fields(v):
    f = M.with_kind(v.fields()).withColumn("page_no", F.col("seq") % 2)
    return M.page_fields(f.withColumn("name", F.when(F.col("kind").isin("checkbox", "pushbutton"), "group").otherwise(F.col("name"))), "seq")


def _judged(v):
    return M.import_form_data(M.with_kind(v.fields()), v.form_data())


SQL_VIEWS["judged"] = (("form_data", "field_kinds"), """
    SELECT d.doc_id, d.seq, d.name, d.kind, d.value, f.kind AS got, f.options, CASE WHEN f.kind IS NULL THEN NULL WHEN d.kind <> '' AND d.kind <> f.kind THEN d.kind
      WHEN f.kind IN ('pushbutton', 'signature') THEN d.kind WHEN len(d.value) > 1 AND f.kind <> 'list' THEN len(d.value) || ' values'
      WHEN f.kind = 'checkbox' AND len(d.value) > 0 AND d.value[1] NOT IN ('Off', 'Yes') THEN 'state ' || d.value[1] END AS expected
    FROM form_data d LEFT JOIN field_kinds f ON f.doc_id = d.doc_id AND f.name = d.name""")


@query("import_form_data", "J1", """
    SELECT doc_id, seq, name, got, expected, CASE WHEN got IS NULL THEN 'unmatched' WHEN expected IS NOT NULL THEN 'mismatched' ELSE 'applied' END AS outcome,
           CASE WHEN got IS NOT NULL AND expected IS NULL THEN CASE WHEN got = 'text' THEN left(array_to_string(value, chr(10)), 12) ELSE array_to_string(value, '|') END END AS new_value
    FROM judged""", "judged")
def import_form_data(v):
    return _judged(v).select("doc_id", "seq", "name", "got", "expected", "outcome", _join("new_value").alias("new_value"))


@query("import_report", "J1 F21", """
    SELECT doc_id, count_if(got IS NOT NULL AND expected IS NULL)::BIGINT AS applied, count_if(got IS NULL)::BIGINT AS unmatched, count_if(expected IS NOT NULL)::BIGINT AS mismatched,
      'Filled ' || count_if(got IS NOT NULL AND expected IS NULL) || ' field' || CASE WHEN count_if(got IS NOT NULL AND expected IS NULL) = 1 THEN '' ELSE 's' END
      || CASE WHEN count_if(got IS NULL) > 0 THEN ' · ' || count_if(got IS NULL) || ' not in this form (' || string_agg(CASE WHEN got IS NULL THEN name END, ', ' ORDER BY seq) || ')' ELSE '' END
      || coalesce(' · ' || string_agg(CASE WHEN expected IS NOT NULL THEN name || ': data says ' || CASE WHEN expected = '' THEN 'no type' ELSE expected END || ', field is ' || got END, ' · ' ORDER BY seq), '') AS summary
    FROM judged GROUP BY doc_id""", "judged")
def import_report(v):
    return M.import_report(_judged(v), "seq")


@query("choice_errors", "J2", """
    SELECT doc_id, min('not an option of ' || name || ': ' || [x FOR x IN value IF NOT list_contains(options, x)][1]) AS error FROM judged
    WHERE got IN ('combo', 'list') AND expected IS NULL AND len([x FOR x IN value IF NOT list_contains(options, x)]) > 0 GROUP BY doc_id""", "judged")
def choice_errors(v):
    return M.choice_errors(_judged(v), M.with_kind(v.fields()))


@query("tab_order", "W16", """
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE name WHEN 'nations' THEN 0 WHEN 'name' THEN 1 ELSE 2 END, seq) AS k FROM fields WHERE name <> 'sign'),
    s AS (SELECT doc_id, seq AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM fields WHERE name <> 'sign')
    SELECT doc_id, f.seq, f.name, s.slot AS new_slot FROM f JOIN s USING (doc_id, k) UNION ALL SELECT doc_id, seq, NULL, seq FROM fields WHERE name = 'sign'""", "fields")
def tab_order(v):
    f = v.fields().select("doc_id", "seq", F.when(F.col("name") != "sign", F.col("name")).alias("name"))
    return M.tab_order(f, ["nations", "ghost", "name"], ["doc_id"], "seq")


@query("upsert_fields", "G11", """
    SELECT doc_id, CASE WHEN name = 'name' AND doc_id % 2 = 0 THEN 'full_name' ELSE name END AS name, CASE WHEN name = 'name' AND doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 40 ELSE max_len END::BIGINT AS max_len
    FROM fields WHERE name <> 'submit'""", "fields")
def upsert_fields(v):
    f = v.fields()
    u = f.filter("name = 'name'").select(
        "doc_id", "name", F.when(F.col("doc_id") % 2 == 0, "full_name").otherwise("segment").alias("new_name"), F.when(F.col("doc_id") % 3 == 0, 40).cast("long").alias("max_len")
    )
    out, _ = M.upsert_fields(f, u, ["max_len"])
    gone = f.filter("name = 'submit'").select("doc_id", "name")
    return M.delete_fields(out, gone).select("doc_id", "name", "max_len")


@query("upsert_rejected", "G11", "SELECT doc_id, 'name' AS name, 'a field named segment already exists' AS error FROM fields WHERE name = 'name' AND doc_id % 2 = 1", "fields")
def upsert_rejected(v):
    f = v.fields()
    u = f.filter("name = 'name'").select("doc_id", "name", F.when(F.col("doc_id") % 2 == 0, "full_name").otherwise("segment").alias("new_name"), F.lit(None).cast("long").alias("max_len"))
    return M.upsert_fields(f, u, ["max_len"])[1]


@query("clear_by_kind", "G11", "SELECT doc_id, id FROM annotations WHERE kind NOT IN ('highlight', 'ink')", "annotations")
def clear_by_kind(v):
    return M.clear_by_kind(v.annotations(), ["highlight", "ink"]).select("doc_id", "id")


def _valued(v):
    return M.with_kind(v.fields()).withColumn("value", F.transform("value", lambda x: F.concat(x, F.lit(', "<&>'), F.lit("'"))))


def _files(v, fmt):
    return M.write_form_data(_valued(v), fmt, "seq")


_VAL = """[x || ', "<&>''' FOR x IN value]"""


_CSV = f"""
    SELECT doc_id, 'name,type,value' || chr(10) || string_agg(name || ',' || kind || ',' || CASE WHEN len(value) = 0 THEN '' ELSE '"' || replace(array_to_string({_VAL}, ';'), '"', '""') || '"' END, chr(10) ORDER BY seq) || chr(10) AS text
    FROM field_kinds WHERE kind <> 'pushbutton' GROUP BY doc_id"""
_JSON = f"""
    SELECT doc_id, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "name": "' || name || '",' || chr(10) || '    "type": "' || kind || '",' || chr(10) || '    "value": '
      || CASE WHEN len(value) = 0 THEN '[]' ELSE '[' || chr(10) || '      "' || replace(array_to_string({_VAL}, ''), '"', '\\"') || '"' || chr(10) || '    ]' END || chr(10) || '  }}', ',' || chr(10) ORDER BY seq) || chr(10) || ']' AS text
    FROM field_kinds WHERE kind <> 'pushbutton' GROUP BY doc_id"""
_XFDF = f"""
    SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">' || chr(10) || '  <fields>' || chr(10)
      || string_agg('    <field name="' || name || '">' || chr(10) || CASE WHEN len(value) = 0 THEN '' ELSE '      <value>'
        || replace(replace(replace(replace(array_to_string({_VAL}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;').replace('''', '&apos;') || '</value>' || chr(10) END || '    </field>', chr(10) ORDER BY seq)
      || chr(10) || '  </fields>' || chr(10) || '</xfdf>' || chr(10) AS text
    FROM field_kinds WHERE kind <> 'pushbutton' GROUP BY doc_id"""


@query("write_form_csv", "K4 F11", _CSV, "field_kinds")
def write_form_csv(v):
    return _files(v, "csv")


@query("write_form_json", "K4", _JSON, "field_kinds")
def write_form_json(v):
    return _files(v, "json")


def _written(v, write):
    """Files that ``write`` makes in the shared folder, read back as digests."""
    path = f"{checkpoint_dir(v.spark)}/files_{uuid.uuid4().hex}"
    write(path)
    return read_whole(v.spark, path).select("file_name", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


def _file_sql(text, extension):
    return f"SELECT doc_id || '.{extension}' AS file_name, length(text) AS chars, sha256(text) AS digest FROM ({text})"


@query("form_files_csv", "K4", _file_sql(_CSV, "csv"), "field_kinds")
def form_files_csv(v):
    return _written(v, lambda path: sinks.write_form_files(_valued(v), path, "csv", "seq"))


@query("form_files_json", "K4", _file_sql(_JSON, "json"), "field_kinds")
def form_files_json(v):
    return _written(v, lambda path: sinks.write_form_files(_valued(v), path, "json", "seq"))


@query("form_files_xfdf", "K4", _file_sql(_XFDF, "xfdf"), "field_kinds")
def form_files_xfdf(v):
    return _written(v, lambda path: sinks.write_form_files(_valued(v), path, "xfdf", "seq"))


def _parsed_sql(kind):
    return f"SELECT doc_id, name, {kind} AS kind, array_to_string({_VAL}, '|') AS value FROM field_kinds WHERE kind <> 'pushbutton'"


@query("parse_form_json", "S12 K4", _parsed_sql("kind"), "field_kinds")
def parse_form_json(v):
    return M.parse_form_json(_files(v, "json")).select("doc_id", "name", "kind", _join("value").alias("value"))


@query("parse_form_csv", "S12 K4", _parsed_sql("kind"), "field_kinds")
def parse_form_csv(v):
    return M.parse_form_csv(_files(v, "csv")).select("doc_id", "name", "kind", _join("value").alias("value"))


@query("parse_form_xfdf", "S12 K4 F11", _parsed_sql("''"), "field_kinds")
def parse_form_xfdf(v):
    return M.parse_form_xfdf(_files(v, "xfdf")).select("doc_id", "name", "kind", _join("value").alias("value"))


# -- hierarchies --------------------------------------------------------------------------


def _tree(v):
    c = F.expr("CAST(substr(field_id, 2) AS BIGINT)")
    leaf = F.col("field_id").startswith("c")
    ft = F.when(leaf, F.element_at(F.array(F.lit("Tx"), F.lit("Btn"), F.lit("Sig"), F.lit("Ch")), (c % 4 + 1).cast("int")))
    ff = F.when(c % 8 == 1, M.FF_PUSHBUTTON).otherwise(0).cast("long")
    return v.field_tree().withColumns({"form": F.lit(1).cast("long"), "ft": ft, "ff": ff, "value": F.array("t"), "xfa": c % 1000 == 3})


SQL_VIEWS["leaf_names"] = ((), """
    SELECT 'c' || c_custkey AS field_id, c_custkey AS c, r_name || CASE WHEN n_nationkey % 5 <> 3 THEN '.' || n_name ELSE '' END || '.' || c_name AS qualified, c_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


@query("qualified_names", "H3", """
    SELECT field_id, qualified FROM leaf_names UNION ALL SELECT 'r' || r_regionkey, r_name FROM region
    UNION ALL SELECT 'n' || n_nationkey, r_name || CASE WHEN n_nationkey % 5 <> 3 THEN '.' || n_name ELSE '' END FROM nation JOIN region ON n_regionkey = r_regionkey""", "leaf_names")
def qualified_names(v):
    return H.qualified_names(_tree(v), "form").select("field_id", "qualified")


@query("collect_form_data", "H4", """
    SELECT qualified AS name, CASE c % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'signature' ELSE 'list' END AS kind, CASE WHEN c % 4 = 2 THEN '' ELSE c_name END AS value
    FROM leaf_names WHERE c % 8 <> 1""", "leaf_names")
def collect_form_data(v):
    return M.collect_form_data(_tree(v), "form").select("name", "kind", _join("value").alias("value"))


@query("form_summary", "A13", """
    SELECT c_nationkey::BIGINT AS form, count(*) AS fields, bool_or(c_custkey % 1000 = 3) AS has_xfa FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1""")
def form_summary(v):
    c = v.table("customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").cast("long").alias("form"), "c_custkey")
    k = F.col("c_custkey")
    # Every third customer holds the next two as its kids.
    t = c.select("form", k.alias("field_id"), F.when(k % 3 != 0, k - k % 3).alias("parent_id"), (k % 1000 == 3).alias("xfa"))
    holders = t.filter("parent_id IS NULL").select("form", "field_id", F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("xfa"))
    kids = t.filter("parent_id IS NOT NULL")
    extra = kids.select("form", F.col("parent_id").alias("field_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(False).alias("xfa")).distinct()
    known = holders.join(extra.select("form", "field_id"), ["form", "field_id"], "left_semi")
    return M.form_summary(kids.unionByName(known.unionByName(extra).distinct()), "form")


@query("outline_flatten", "H7", """
    SELECT doc_id, node_id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END::BIGINT AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(parent_id, node_id), parent_id IS NOT NULL, seq) - 1 AS position FROM outline""", "outline")
def outline_flatten(v):
    return H.outline_flatten(v.outline()).select("doc_id", "node_id", "depth", "position")


@query("outline_count", "A14", "SELECT doc_id, count(*) AS bookmarks FROM outline GROUP BY doc_id", "outline")
def outline_count(v):
    return H.outline_count(v.outline())


# -- signatures ------------------------------------------------------------------------------

_NOTES = A.CHAIN_NOTES
_q = lambda s: "'" + s.replace("'", "''") + "'"
_CHAIN = "CASE chain " + " ".join(f"WHEN '{k}' THEN {_q(n)}" for k, n in _NOTES.items()) + " END"
SQL_VIEWS["sig_status"] = (("signatures",), f"""
    SELECT *, CASE WHEN len(problems) > 0 OR chain = 'broken' OR NOT signature_valid OR NOT digest_matches THEN 'invalid' WHEN NOT covers_whole OR expired THEN 'warning' ELSE 'valid' END AS severity,
      CASE WHEN len(problems) > 0 THEN 'This signature could not be checked' WHEN chain = 'broken' THEN 'This signature''s certificate has been altered'
        WHEN NOT signature_valid THEN 'This signature is not valid' WHEN NOT digest_matches THEN 'The document changed after ' || who || ' signed it' ELSE 'Signed by ' || who END AS headline,
      CASE WHEN len(problems) > 0 THEN problems[1] WHEN chain = 'broken' THEN {_CHAIN} || '|Whatever name it shows cannot be relied on.'
        WHEN NOT signature_valid THEN 'The signature doesn''t match the certificate attached to it.|' || {_CHAIN}
        WHEN NOT digest_matches THEN 'The signature itself is intact — it is the document that no longer matches.|' || {_CHAIN}
        ELSE concat_ws('|', CASE WHEN NOT covers_whole THEN 'The file was changed after this signature — by a later edit or another signature. Everything this signature covers is still intact.' END,
          CASE WHEN expired THEN 'The certificate has expired. That does not undo the signature, but nobody is standing behind the certificate now.' END,
          CASE level WHEN 1 THEN 'Certified: no changes were meant to be made after signing.' WHEN 2 THEN 'Certified: only form filling and further signatures were meant to be allowed.'
            WHEN 3 THEN 'Certified: form filling, comments and further signatures were meant to be allowed.' WHEN 4 THEN 'Certified at an unrecognised level (4).' END, {_CHAIN}) END AS notes
    FROM (SELECT *, CASE WHEN signer = '' THEN 'an unnamed certificate' ELSE signer END AS who FROM signatures)""")


@query("signature_status", "H6", "SELECT sig_id, severity, headline, notes FROM sig_status", "sig_status")
def signature_status(v):
    return A.signature_status(v.signatures()).select("sig_id", "severity", "headline", _join("notes").alias("notes"))


@query("document_signature_status", "A15", """
    SELECT doc_id, CASE max(CASE severity WHEN 'invalid' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'invalid' WHEN 1 THEN 'warning' ELSE 'valid' END AS severity,
      CASE WHEN count(*) = 1 THEN max(headline) WHEN count_if(severity <> 'valid') = 0 THEN count(*) || ' signatures, all intact'
        ELSE count(*) || ' signatures, ' || count_if(severity <> 'valid') || ' needing attention' END AS headline, count(*) AS n, count_if(severity <> 'valid')::BIGINT AS bad
    FROM sig_status GROUP BY doc_id""", "sig_status")
def document_signature_status(v):
    return A.document_signature_status(A.signature_status(v.signatures()))


assert len(KINDS) == len(_LABELS)
