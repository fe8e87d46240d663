"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbering as N
from ..functions import text as X
from ..functions.fonts import fallback_substitute, normalize_font_key
from ..functions.register import register
from ..operators.tables import cell_number, column_letters
from .registry import query

_D = "['','I','II','III','IV','V','VI','VII','VIII','IX'][{n} % 10 + 1]"


@query("numerals", "F1 F2 F3 F5", """
    SELECT o_orderkey AS id, repeat('M', (n // 1000)::INT) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1]
        || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] AS roman,
      CASE WHEN m > 26 THEN chr((96 + (m - 1) // 26)::INT) ELSE '' END || chr((97 + (m - 1) % 26)::INT) AS alpha, repeat(chr((97 + (m - 1) % 26)::INT), ((m - 1) // 26 + 1)::INT) AS letters,
      upper(CASE WHEN m > 26 THEN chr((96 + (m - 1) // 26)::INT) ELSE '' END || chr((97 + (m - 1) % 26)::INT)) AS col FROM (SELECT o_orderkey, o_orderkey % 5000 + 1 AS n, o_orderkey % 702 + 1 AS m FROM orders)""")
def numerals(v):
    k = F.col("o_orderkey")
    n, m = k % 5000 + 1, k % 702 + 1
    return v.table("orders", "o_orderkey").select(
        k.alias("id"), N.to_roman(n).alias("roman"), N.to_alpha(m).alias("alpha"), N.list_number(m, "lowerLetter").alias("letters"), column_letters(m - 1).alias("col")
    )


@query("number_texts", "F16 T10", """
    SELECT c_custkey AS id, CASE WHEN q = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.3f', q), '0+$', ''), '\\.$', '') END AS num, printf('#%02x%02x%02x', c_custkey % 256, c_custkey % 7, 255) AS hex,
      CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN -abs(c_acctbal) END AS cell FROM (SELECT *, (c_custkey % 800 - 400) / 8.0 AS q FROM customer)""")
def number_texts(v):
    k, q = F.col("c_custkey"), (F.col("c_custkey") % 800 - 400) / 8.0
    bal = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    cell = F.when(k % 4 == 0, bal).when(k % 4 == 1, F.concat(F.lit("-"), F.regexp_replace(bal, "^-", ""))).when(k % 4 == 2, F.concat(F.lit("$"), bal)).otherwise(F.concat(bal, F.lit("e3")))
    return v.table("customer").select(
        k.alias("id"), N.number_text(q).alias("num"), X.rgb_hex(k % 256, k % 7, F.lit(255)).alias("hex"), cell_number(cell).alias("cell")
    )


@query("pdf_dates", "F10 F22", """
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_ms(make_date(year(o_orderdate), month(o_orderdate), 1)::TIMESTAMP) + 30 * 86400000::BIGINT
      ELSE epoch_ms(o_orderdate) + CASE o_orderkey % 4 WHEN 0 THEN 45296000 ELSE 0 END END AS ms, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(o_orderdate) AS day_ms FROM orders""")
def pdf_dates(v):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    ymd = F.date_format(d, "yyyyMMdd")
    raw = F.when(k == 0, F.concat(F.lit("D:"), ymd, F.lit("123456+02'00'"))).when(k == 1, ymd).when(k == 2, F.concat(F.date_format(d, "yyyyMM"), F.lit("31"))).otherwise(F.concat(F.lit("D:"), F.date_format(d, "yyyy"), F.lit("1399")))
    o = v.table("orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), X.parse_pdf_date(raw).alias("ms"), F.date_format(d, "yyyy-MM-dd").alias("day"))
    o = o.withColumn("day_ms", X.date_input_ms(F.col("day")))
    return o.select("id", "ms", X.ms_date_input(F.col("day_ms")).alias("day"), "day_ms")


@query("path_functions", "F12 F13 F15 F18 F20", """
    SELECT p_partkey AS id, sha256(p) AS hash, CASE p_partkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xfdf' END AS fmt, f AS file, regexp_replace(f, '(.)\\.[^.]*$', '\\1') || '_files' AS folder,
      replace(replace(replace(replace(f, '%', '%25'), ' ', '%20'), '+', '%2B'), '~', '~') AS segment, replace(f, '+', '+') AS decoded, CASE WHEN p_partkey % 2 = 0 THEN 'https' END AS sch
    FROM (SELECT *, '/d.x/' || f AS p FROM (SELECT p_partkey, p_name || '+1~%' || ['.CSV', '.xfdf', '', '.tar.gz'][p_partkey % 4 + 1] AS f FROM part))""")
def path_functions(v):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".CSV", ".xfdf", "", ".tar.gz")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = v.table("part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/d.x/"), "p_name", F.lit("+1~%"), ext).alias("p"))
    f = X.file_name(F.col("p"))
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("HTTPS://x/"), "p")).otherwise(F.col("p"))
    return p.select(
        "id", X.path_hash(F.col("p")).alias("hash"), X.format_from_path(F.col("p")).alias("fmt"), f.alias("file"), X.images_folder_name(F.col("p")).alias("folder"),
        X.encode_segment(f).alias("segment"), X.percent_decode(X.encode_segment(f)).alias("decoded"), X.scheme(url).alias("sch"),
    )


@query("winansi_fits", "F23", r"""
    SELECT doc_id, doc_id % 3 <> 0 AS fits, CASE WHEN doc_id % 3 = 0 THEN 'Ωж你' ELSE '' END AS bad FROM documents""")
def winansi_fits(v):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Ω"), "text", F.lit("жΩ你語"))).otherwise(F.concat("text", F.lit("€–“")))
    return v.table("documents", "doc_id", "text").select("doc_id", X.winansi_fits(t).alias("fits"), F.array_join(X.winansi_offenders(t), "").alias("bad"))


@query("clean_lines", "F14", """
    SELECT doc_id, w[1] || repeat(' ', (8 - length(w[1]) % 8)::INT) || 'x' || repeat(' ', 7) || 'y' AS line FROM (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS w FROM documents)""")
def clean_lines(v):
    from ..operators.paginate import clean_line_sql

    first = F.element_at(F.split(F.element_at(F.split("text", "\n", 2), 1), " ", 2), 1)
    return v.table("documents", "doc_id", "text").select("doc_id", F.concat(first, F.lit("\t\u0007x\ty")).alias("t")).select(
        "doc_id", F.expr(clean_line_sql("t")).alias("line")
    )


_NAMES = ["ABCDEF+Calibri-Light", "Arial-BoldItalicMT", "TimesNewRomanPS-BoldMT", "Bold", "Menlo Regular", "Garamond Semibold", "Consolas-BoldItalic", "BoldMT"]


@query("font_keys", "F8 F9", """
    SELECT p_partkey AS id, ['calibri', 'arial', 'timesnewroman', 'bold', 'menlo', 'garamondsemi', 'consolas', 'bold'][p_partkey % 8 + 1] AS key,
      ['Helvetica', 'Helvetica-BoldOblique', 'Times-Bold', 'Helvetica-Bold', 'Courier', 'Times-Bold', 'Courier-BoldOblique', 'Helvetica-Bold'][p_partkey % 8 + 1] AS substitute FROM part""")
def font_keys(v):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return v.table("part", "p_partkey").select(F.col("p_partkey").alias("id"), normalize_font_key(name).alias("key"), fallback_substitute(name).alias("substitute"))


@query("sql_functions", "F1 F6 F7 F11 F13", """
    SELECT p_partkey AS id, 'A-' || lpad(p_partkey::VARCHAR, 6, '0') AS bates, p_name AS font, '"' || p_name || ',""x"' AS quoted, '&lt;' || p_name || '&gt;' AS escaped, 'ftp' AS sch FROM part""")
def sql_functions(v):
    register(v.spark)
    v.table("part").createOrReplaceTempView("qf_part")
    return v.spark.sql("""
        SELECT p_partkey AS id, qf_bates_label(p_partkey, 'A-', '', 6) AS bates, qf_strip_subset_tag(concat('ABCDEF+', p_name)) AS font,
               qf_csv_quote(concat(p_name, ',"x')) AS quoted, qf_xml_escape(concat('<', p_name, '>')) AS escaped, qf_scheme(concat('FTP://', p_name)) AS sch FROM qf_part""")


@query("sql_table_functions", "F24 D1", """
    SELECT item_id, 'chunk' AS what, i AS "start", least(i + 80, length(text)) AS "end" FROM (SELECT item_id, text, unnest(range(0, greatest(length(text) - 10, 1), 70)) AS i FROM benchmark)
    UNION ALL SELECT item_id, 'match', s, s + 3 FROM (SELECT item_id, CAST(sum(length(g) + 3) OVER (PARTITION BY item_id ORDER BY i) - 3 AS BIGINT) AS s FROM (
      SELECT item_id, unnest(gs[1:len(gs) - 1]) AS g, generate_subscripts(gs[1:len(gs) - 1], 1) AS i FROM (SELECT item_id, string_split(text, 'the') AS gs FROM benchmark)))""")
def sql_table_functions(v):
    register(v.spark)
    v.table("benchmark").createOrReplaceTempView("qf_benchmark")
    return v.spark.sql("""
        SELECT item_id, 'chunk' AS what, c.start, c.end FROM qf_benchmark, LATERAL qf_chunk_text(text, 80, 10) c
        UNION ALL SELECT item_id, 'match', m.start, m.end FROM qf_benchmark, LATERAL qf_text_matches(text, 'the') m""")
