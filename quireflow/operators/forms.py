"""Form fields: kinds, import with a report, edits, tab order, data formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import each, fold_collect, let
from ..functions.text import csv_quote, xml_unescape
from .hierarchy import qualified_names
from .tables import xml_escape

# Field flag bits.
FF_RADIO, FF_PUSHBUTTON, FF_COMBO, FF_MULTISELECT = 1 << 15, 1 << 16, 1 << 17, 1 << 21


def field_kind(ft: Column, ff: Column) -> Column:
    has = lambda bit: F.coalesce(ff, F.lit(0)).bitwiseAND(F.lit(bit)) != 0
    button = F.when(has(FF_PUSHBUTTON), "pushbutton").when(has(FF_RADIO), "radio").otherwise("checkbox")
    choice = F.when(has(FF_COMBO), "combo").otherwise("list")
    return F.when(ft == "Tx", "text").when(ft == "Btn", button).when(ft == "Ch", choice).when(ft == "Sig", "signature")


def with_kind(fields: DataFrame) -> DataFrame:
    return fields.withColumn("kind", field_kind(F.col("ft"), F.col("ff")))


def page_fields(widgets: DataFrame, position: str) -> DataFrame:
    """One row per field of a page, the first widget's: a radio group appears once."""
    first = widgets.groupBy("doc_id", "page_no", "name").agg(F.min_by("kind", position).alias("kind"), F.min(position).alias(position))
    return first.filter("kind IS NOT NULL")


def unsigned_fields(fields: DataFrame) -> DataFrame:
    return fields.filter((F.col("kind") == "signature") & (F.size("value") == 0))


def import_form_data(fields: DataFrame, data: DataFrame) -> DataFrame:
    """Match each datum to a field by name and judge it; nothing is coerced.

    Adds ``outcome`` (applied, unmatched, mismatched), ``expected``, ``got`` and ``new_value``.
    """
    f = fields.select("doc_id", "name", F.col("kind").alias("got"), "ff", "max_len", "on_states", F.lit(True).alias("_there"))
    j = data.join(f, ["doc_id", "name"], "left")
    many, button = F.size("value") > 1, F.col("got").isin("checkbox", "radio")
    multi_list = (F.col("got") == "list") & (F.coalesce("ff", F.lit(0)).bitwiseAND(F.lit(FF_MULTISELECT)) != 0)
    first = F.get("value", F.lit(0))
    bad_state = button & first.isNotNull() & (first != "Off") & ~F.array_contains("on_states", first)
    expected = (
        F.when(F.col("got").isNull(), F.col("kind"))
        .when((F.col("kind") != "") & (F.col("kind") != F.col("got")), F.col("kind"))
        .when(F.col("got").isin("pushbutton", "signature"), F.col("kind"))
        .when(many & ~multi_list, F.concat(F.size("value"), F.lit(" values")))
        .when(bad_state, F.concat(F.lit("state "), first))
    )
    there = F.col("_there").isNotNull()
    out = j.withColumn("expected", F.when(there, expected)).withColumn("got", F.when(there, F.coalesce("got", F.lit("unknown"))))
    outcome = F.when(~there, "unmatched").when(F.col("expected").isNotNull(), "mismatched").otherwise("applied")
    text = F.array_join("value", "\n")
    cut = F.when(F.col("max_len") > 0, F.substring(text, F.lit(1), F.col("max_len").cast("int"))).otherwise(text)
    new = F.when(F.col("got") == "text", F.array(cut)).when(button, F.array(F.coalesce(first, F.lit("Off")))).otherwise(F.col("value"))
    return out.withColumn("outcome", outcome).withColumn("new_value", F.when(F.col("outcome") == "applied", new)).drop("_there", "ff", "max_len", "on_states")


def import_report(judged: DataFrame, order: str) -> DataFrame:
    """Counts and the line shown per document; names of one form's data, in input order."""
    unmatched = F.when(F.col("outcome") == "unmatched", F.struct(order, "name"))
    says = F.concat("name", F.lit(": data says "), F.when(F.col("expected") == "", "no type").otherwise(F.col("expected")), F.lit(", field is "), "got")
    mismatched = F.when(F.col("outcome") == "mismatched", F.struct(F.col(order), says.alias("t")))
    g = judged.groupBy("doc_id").agg(
        F.count_if(F.col("outcome") == "applied").alias("applied"), F.sort_array(F.collect_list(unmatched)).alias("_u"), F.sort_array(F.collect_list(mismatched)).alias("_m")
    )
    return g.select(
        "doc_id", "applied", F.size("_u").cast("long").alias("unmatched"), F.size("_m").cast("long").alias("mismatched"),
        describe_import(F.col("applied"), F.col("_u.name"), F.col("_m.t")).alias("summary"),
    )


def describe_import(applied: Column, unmatched: Column, mismatched: Column) -> Column:
    filled = F.concat(F.lit("Filled "), applied, F.lit(" field"), F.when(applied == 1, "").otherwise("s"))
    missing = F.when(F.size(unmatched) > 0, F.concat(F.size(unmatched), F.lit(" not in this form ("), F.array_join(unmatched, ", "), F.lit(")")))
    return F.array_join(F.concat(F.array_compact(F.array(filled, missing)), mismatched), " · ")


def choice_errors(judged: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents whose import is refused: an applied choice value that is not an option."""
    opts = fields.filter(F.col("kind").isin("combo", "list")).select("doc_id", "name", "options")
    j = judged.filter("outcome = 'applied'").join(opts, ["doc_id", "name"])
    bad = F.get(F.array_except("new_value", "options"), F.lit(0))
    hit = j.withColumn("_b", bad).filter("_b IS NOT NULL")
    text = F.concat(F.lit("not an option of "), "name", F.lit(": "), "_b")
    return hit.groupBy("doc_id").agg(F.min(text).alias("error"))


def collect_form_data(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terminal fields with qualified name, kind and value; push-buttons have no data, signatures no value."""
    parents = tree.filter("parent_id IS NOT NULL").select(key, F.col("parent_id").alias("field_id")).distinct()
    leaf = with_kind(tree.join(parents, [key, "field_id"], "left_anti"))
    named = leaf.join(qualified_names(tree, key), [key, "field_id"]).filter(~(F.col("kind") == "pushbutton"))
    empty = F.array().cast("array<string>")
    return named.select(key, "field_id", F.col("qualified").alias("name"), "kind", F.when(F.col("kind") == "signature", empty).otherwise(F.col("value")).alias("value"))


def form_summary(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terminal fields per form and whether it carries an XFA form."""
    parents = tree.filter("parent_id IS NOT NULL").select(key, F.col("parent_id").alias("field_id")).distinct().withColumn("_p", F.lit(True))
    j = tree.join(parents, [key, "field_id"], "left")
    return j.groupBy(key).agg(F.count_if(F.col("_p").isNull()).alias("fields"), F.bool_or("xfa").alias("has_xfa"))


def tab_order(items: DataFrame, names: list[str], keys: list[str], position: str) -> DataFrame:
    """New slot per item of a page: listed names first, the rest in order; other annotations stay.

    ``name`` is null for an annotation that is no field.
    """
    order = {n: i for i, n in enumerate(dict.fromkeys(names))}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("name")), F.lit(len(order)))
    fields = items.filter(F.col("name").isNotNull())
    # One page's widgets.
    by_rank = Window.partitionBy(*keys).orderBy(rank, position)
    by_slot = Window.partitionBy(*keys).orderBy(position)
    moved = fields.withColumn("_k", F.row_number().over(by_rank))
    slots = fields.select(*keys, F.col(position).alias("new_slot"), F.row_number().over(by_slot).alias("_k"))
    out = moved.join(slots, [*keys, "_k"]).drop("_k")
    return out.unionByName(items.filter(F.col("name").isNull()).withColumn("new_slot", F.col(position)))


def upsert_fields(fields: DataFrame, updates: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apply property updates (null leaves a property) and renames; ``(fields, rejected)``.

    A rename onto another field's name is rejected and changes nothing.
    """
    taken = fields.select("doc_id", F.col("name").alias("new_name")).distinct()
    clash = updates.filter(F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name"))).join(taken, ["doc_id", "new_name"], "left_semi")
    rejected = clash.select("doc_id", "name", F.concat(F.lit("a field named "), "new_name", F.lit(" already exists")).alias("error"))
    good = updates.join(rejected, ["doc_id", "name"], "left_anti")
    u = good.select("doc_id", "name", F.col("new_name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = fields.join(u, ["doc_id", "name"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return j.withColumn("name", F.coalesce("_name", "name")).drop("_name", *[f"_{c}" for c in columns]), rejected


def delete_fields(fields: DataFrame, names: DataFrame) -> DataFrame:
    """Remove the named fields (and, where the table holds widgets, all of theirs)."""
    return fields.join(names, ["doc_id", "name"], "left_anti")


def clear_by_kind(rows: DataFrame, kinds: list[str]) -> DataFrame:
    return rows.filter(~F.col("kind").isin(*kinds))


# -- data formats ------------------------------------------------------------------------

_DATUM = "array<struct<name:string,type:string,value:array<string>>>"


def parse_form_json(df: DataFrame, text: str = "text") -> DataFrame:
    """A JSON list of {name, type, value[]}; a text that is none gives one error row."""
    keep = [c for c in df.columns if c != text]
    parsed = df.select(*keep, F.from_json(text, _DATUM).alias("_d"))
    e = parsed.select(*keep, F.posexplode_outer("_d").alias("seq", "_x"), F.col("_d").isNull().alias("_bad"))
    bad = F.col("_bad") | (F.col("seq").isNotNull() & (F.col("_x.name").isNull() | F.col("_x.type").isNull() | F.col("_x.value").isNull()))
    err = F.when(bad, "unreadable JSON form data")
    return e.filter("seq IS NOT NULL OR _bad").select(
        *keep, F.col("seq").cast("long").alias("seq"), F.col("_x.name").alias("name"), F.col("_x.type").alias("kind"), F.col("_x.value").alias("value"), err.alias("error")
    )


def csv_rows(text: Column) -> Column:
    """``array<array<string>>`` of quoted CSV; quotes may hold commas, line breaks and doubled quotes."""
    cells = F.regexp_extract_all(text, F.lit(r'((?:[^",\n]|"(?:[^"]|"")*(?:"|\z))*)(?:,|\n|\z)'), F.lit(0))

    def clean(raw: Column) -> Column:
        parts = F.regexp_extract_all(raw, F.lit(r'"(?:[^"]|"")*(?:"|\z)|[^"]+'), F.lit(0))
        one = lambda p: F.when(
            p.startswith('"'), F.replace(F.regexp_replace(p, r'^"|"\z', ""), F.lit('""'), F.lit('"'))
        ).otherwise(F.replace(p, F.lit("\r"), F.lit("")))
        return F.array_join(F.transform(parts, one), "")

    # A cell keeps the mark that ended it, so a row ends where a line feed or the text does.
    def step(row: Column, cell: Column) -> tuple[Column, Column]:
        ended = ~cell.endswith(",")
        full = F.concat(row, F.array(clean(F.regexp_replace(cell, r"[,\n]\z", ""))))
        return F.when(ended, F.array().cast("array<string>")).otherwise(full), F.when(ended, full)

    rows = fold_collect(cells, F.array().cast("array<string>"), "array<string>", "array<string>", step)
    # The expression also matches the empty text at the very end, which is no row.
    last = lambda r: F.element_at(r, -1) == F.array(F.lit(""))
    return let(rows, lambda r: F.when((F.size(r) > 0) & last(r), F.slice(r, 1, F.size(r) - 1)).otherwise(r))


def parse_form_csv(df: DataFrame, text: str = "text") -> DataFrame:
    """``name,type,value`` rows, header optional; several values are parted by semicolons."""
    keep = [c for c in df.columns if c != text]
    e = each(df, keep, csv_rows(F.col(text)), "_r", "seq")
    e = e.filter((F.size("_r") >= 2) & ~((F.get("_r", F.lit(0)) == "name") & (F.get("_r", F.lit(1)) == "type")))
    raw = F.coalesce(F.get("_r", F.lit(2)), F.lit(""))
    value = F.when(raw == "", F.array().cast("array<string>")).otherwise(F.split(raw, ";", -1))
    return e.select(*keep, F.col("seq").cast("long").alias("seq"), F.get("_r", F.lit(0)).alias("name"), F.get("_r", F.lit(1)).alias("kind"), value.alias("value"))


def parse_form_xfdf(df: DataFrame, text: str = "text") -> DataFrame:
    """``<field name><value>...`` entries, without a type; no ``<xfdf`` root gives an error row."""
    keep = [c for c in df.columns if c != text]
    named = r"""(?s)<field (?=[^>]*\bname=["'])[^>]*>.*?(?:</field>|\z)"""
    ok = F.contains(text, F.lit("<xfdf"))
    found = F.when(ok, F.regexp_extract_all(text, F.lit(named), F.lit(0))).otherwise(F.array(F.lit("")))
    e = each(df, [*keep, ok.alias("_ok")], found, "_f", "seq")
    quoted = F.regexp_extract("_f", r"""\bname=("[^"]*"|'[^']*')""", 1)
    name = xml_unescape(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    body = F.regexp_extract("_f", r"(?s)^[^>]*>(.*)", 1)
    values = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<value>(.*?)</value>"), F.lit(1)), xml_unescape)
    return e.select(
        *keep, F.col("seq").cast("long").alias("seq"), F.when(F.col("_ok"), name).alias("name"), F.lit("").alias("kind"),
        F.when(F.col("_ok"), values).alias("value"), F.when(~F.col("_ok"), "not an XFDF file (no <xfdf> root)").alias("error"),
    )


def json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def form_file_format(fmt: str) -> tuple[Column, str, str, str]:
    """``(row, head, separator, tail)`` of a form-data file in json, csv or xfdf."""
    if fmt not in ("json", "csv", "xfdf"):
        raise ValueError(f"unknown form-data format: {fmt}")
    name, kind, value = F.col("name"), F.col("kind"), F.col("value")
    if fmt == "csv":
        return F.concat_ws(",", csv_quote(name), csv_quote(kind), csv_quote(F.array_join(value, ";"))), "name,type,value\n", "\n", "\n"
    if fmt == "xfdf":
        each = F.array_join(F.transform(value, lambda v: F.concat(F.lit("      <value>"), xml_escape(v), F.lit("</value>\n"))), "")
        line = F.concat(F.lit('    <field name="'), xml_escape(name), F.lit('">\n'), each, F.lit("    </field>"))
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n  <fields>\n'
        return line, head, "\n", "\n  </fields>\n</xfdf>\n"
    values = F.array_join(F.transform(value, lambda v: F.concat(F.lit("      "), json_string(v))), ",\n")
    arr = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("[\n"), values, F.lit("\n    ]")))
    line = F.concat(F.lit('  {\n    "name": '), json_string(name), F.lit(',\n    "type": '), json_string(kind), F.lit(',\n    "value": '), arr, F.lit("\n  }"))
    return line, "[\n", ",\n", "\n]"


def form_rows(data: DataFrame, fmt: str, order: str) -> DataFrame:
    """``(doc_id, order, row)``: one piece of text per field; push-buttons hold no data."""
    return data.filter(F.col("kind") != "pushbutton").select("doc_id", order, form_file_format(fmt)[0].alias("row"))


def write_form_data(data: DataFrame, fmt: str, order: str) -> DataFrame:
    """One file's text per document as a value; ``sinks.write_form_files`` writes files without gathering a document."""
    _, head, sep, tail = form_file_format(fmt)
    g = form_rows(data, fmt, order).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, "row"))).alias("_r"))
    return g.select("doc_id", F.concat(F.lit(head), F.array_join(F.col("_r.row"), sep), F.lit(tail)).alias("text"))
