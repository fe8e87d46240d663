"""Document-shaped views derived from the given tables, in Spark and in the oracle's SQL.

Every view covers its whole source table. Texts are laid out on monospace pages (80 columns,
or two columns of 36), so runs, ruling lines and OCR words have honest page geometry and a
page never holds more than 100 lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import each
from ..operators.paginate import paginate_text
from ..sources.tables import read_table, table_bytes

KINDS = (
    "highlight underline strikeout squiggly note freetext rectangle ellipse line polygon "
    "polyline ink stamp measure"
).split()


class Views:
    """Lazy DataFrames over one data folder."""

    #: Compressed bytes of documents whose words one task lays out; as rows they are some fifty times as many.
    LAID_OUT_AT_ONCE = 1 << 20
    #: Compressed bytes of short rows, each of which a whole page of markup is made around.
    TOKENS_AT_ONCE = 1 << 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.folder, name, list(columns) or None)

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream: every file is read once, in order of arrival."""
        return self.spark.readStream.schema(self.table(name).schema).parquet(self.files_of(name))

    def files_of(self, name: str) -> str:
        """A pattern that a stream can watch, whether the table is one file or a folder of files."""
        return f"{self.folder.rstrip('/')}/{name}.parque[t]"

    # pages and layout ------------------------------------------------------------
    def sheets(self) -> DataFrame:
        return paginate_text(
            self.table("documents", "doc_id", "text", "lang", "source"),
            "text", "if(doc_id % 2 = 1, 36, 80)", "if(doc_id % 2 = 1, 100, 50)",
        )

    def by_page(self, df: DataFrame) -> DataFrame:
        """Rows placed by page, the same page in the same partition for every view: what is later grouped or joined by page stays where it is."""
        size = table_bytes(self.spark, self.folder, "documents")
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-size // self.LAID_OUT_AT_ONCE)), "doc_id", "page_no")

    def by_key(self, df: DataFrame, key: str, table: str) -> DataFrame:
        """Small pages made of a table's rows, placed before their tokens become rows: a task's share does not grow with the table."""
        size = table_bytes(self.spark, self.folder, table)
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-size // self.TOKENS_AT_ONCE)), key)

    def placed_sheets(self) -> DataFrame:
        """Pages travel as their lines, before words become rows."""
        return self.by_page(self.sheets().select("doc_id", "lang", F.col("page_no").cast("long").alias("page_no"), "lines"))

    def placed_keys(self) -> DataFrame:
        return self.by_page(self.page_keys().select("doc_id", "page_no"))

    def doc_pages(self) -> DataFrame:
        wide = F.col("doc_id") % 3 == 0
        return self.sheets().select(
            "doc_id", "lang", "source", F.col("page_no").cast("long").alias("page_no"),
            F.array_join("lines", "\n").alias("text"),
            F.octet_length(F.array_join("lines", "\n")).cast("long").alias("n_bytes"),
            (F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(4)) * 90).cast("long").alias("rotate"),
            F.when(wide, 792.0).otherwise(612.0).alias("width"),
            F.when(wide, 612.0).otherwise(792.0).alias("height"),
        )

    def page_keys(self) -> DataFrame:
        return self.doc_pages().drop("text", "lang", "source")

    def page_runs(self) -> DataFrame:
        """The runs, placed by page."""
        return self.runs(self.placed_sheets())

    @staticmethod
    def _title() -> Column:
        return (F.col("line_no") == 0) & (F.col("page_no") == 0)

    def _size(self) -> Column:
        return F.when(self._title(), 18.0).when(F.col("line_no") % 25 == 12, 12.0).otherwise(9.0)

    def line_runs(self) -> DataFrame:
        """The text of each line in its size: what sizes are weighed by, as all words of a line have one and the space between them no ink."""
        lines = self.placed_sheets().select("doc_id", "page_no", F.posexplode("lines").alias("line_no", "text"))
        return lines.select("doc_id", "text", self._size().alias("size"))

    def runs(self, sheets: DataFrame | None = None) -> DataFrame:
        lines = (sheets if sheets is not None else self.sheets()).select(
            "doc_id", "lang", F.col("page_no").cast("long").alias("page_no"),
            F.posexplode("lines").alias("line_no", "line"),
        )
        # Spark's own string functions, no lambda: a word begins after the text before its space. Only where spaces meet are the words before it counted.
        cut = each(lines.withColumn("parts", F.split("line", " ")), ["doc_id", "lang", "page_no", "line_no", "line"], F.col("parts"), "word", "i").filter("word <> ''")
        before = F.expr("if(startswith(line, ' ') OR contains(line, '  '), size(array_remove(slice(split(line, ' '), 1, i), '')), i)")
        start = F.expr("if(i = 0, 0, length(substring_index(line, ' ', i)) + 1)")
        words = cut.withColumns({"w": before, "s": F.struct(F.col("word").alias("text"), start.alias("start"))})
        two = F.col("doc_id") % 2 == 1
        second = two & (F.col("line_no") >= 50)
        x0 = F.when(second, 354).otherwise(72) + F.when(F.col("line_no") % 10 == 5, 18).otherwise(0)
        row = F.when(second, F.col("line_no") - 50).otherwise(F.col("line_no"))
        top = (row * 14 + 100 + F.col("w") % 3).cast("double")
        title, size = self._title(), self._size()
        return words.select(
            "doc_id", "page_no", (F.col("line_no") * 1000 + F.col("w")).cast("long").alias("run_no"),
            F.col("s.text").alias("text"),
            (x0 + 6 * F.col("s.start")).cast("double").alias("left"),
            (x0 + 6 * (F.col("s.start") + F.length("s.text"))).cast("double").alias("right"),
            top.alias("top"), (top + 12).alias("bottom"), size.alias("size"),
            (size > 9).alias("bold"), (F.col("w") % 7 == 3).alias("italic"),
            F.when(title, "ABCDEF+Arial-BoldMT").when(F.col("lang") == "en", "Calibri-Bold")
            .when(F.col("lang") == "fr", "Georgia-Italic").when(F.col("lang") == "de", "Consolas")
            .otherwise("QWERTY+Verdana").alias("font_name"),
            (title | (F.col("lang") == "es")).alias("embedded"),
            F.when(F.col("w") % 11 == 5, 3).otherwise(0).alias("render_mode"),
        )

    def page_rules(self) -> DataFrame:
        """The ruling lines, placed by page."""
        return self.rules(self.placed_keys())

    def rules(self, keys: DataFrame | None = None) -> DataFrame:
        """Grid of 2-4 rows and 2-3 columns on every page, a decoy, a tick and doubled lines."""
        p = (keys if keys is not None else self.page_keys()).select(
            "doc_id", "page_no", (2 + F.col("doc_id") % 3).cast("int").alias("r"), (2 + F.col("page_no") % 2).cast("int").alias("c")
        )
        h = lambda pos, lo, hi: F.struct(
            F.lit(True).alias("horizontal"), pos.cast("double").alias("position"),
            lo.cast("double").alias("lo"), hi.cast("double").alias("hi"),
        )
        v = lambda pos, lo, hi: F.struct(
            F.lit(False).alias("horizontal"), pos.cast("double").alias("position"),
            lo.cast("double").alias("lo"), hi.cast("double").alias("hi"),
        )
        right, bottom = F.col("c") * 148 + 72, F.col("r") * 24 + 152
        every = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: h(i * 24 + 152, F.lit(72), right)),
            F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: v(j * 148 + 72, F.lit(152), bottom)),
            F.array(
                h(F.lit(86), F.lit(72), F.lit(540)), h(F.lit(164), F.lit(80), F.lit(84)),
                h(F.lit(152.5), F.lit(72), right), v(F.lit(72.5), F.lit(152), bottom),
            ),
        )
        return p.select("doc_id", "page_no", F.inline(every))

    def outline(self) -> DataFrame:
        """Bookmarks: pages 1, 4, 7, ... ; every second one hangs under the one before it."""
        p = self.page_keys().filter(F.col("page_no") % 3 == 1)
        child = F.col("page_no") % 6 == 4
        return p.select(
            "doc_id", F.col("page_no").alias("node_id"),
            F.when(child, F.col("page_no") - 3).alias("parent_id"), F.col("page_no").alias("seq"),
            F.format_string("Section %d", F.col("page_no")).alias("title"), F.col("page_no").alias("page"),
        )

    def page_links(self) -> DataFrame:
        return self.page_keys().select("doc_id", "page_no", (F.col("page_no") + 2).alias("target_page"))

    def hrefs(self) -> DataFrame:
        """Link targets of the raw web pages."""
        found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
        return each(self.table("pages", "page_id", "html"), ["page_id"], found, "href", "seq")

    # comments ----------------------------------------------------------------------
    def annotations(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        kinds = F.array(*[F.lit(k) for k in KINDS])
        ms = F.lit(1704067200000) + t * 3600000
        parent = F.concat_ws("-", c, t - 1)
        return self.table("conversations").select(
            c.cast("long").alias("doc_id"), F.concat_ws("-", c, t).alias("id"), t.alias("seq"), (t % 3).alias("page"),
            F.element_at(kinds, (t % 14 + 1).cast("int")).alias("kind"),
            F.col("text").alias("contents"), F.col("role").alias("author"),
            F.when(t % 5 != 4, ms).alias("modified"),
            F.when((t > 0) & ((c + t) % 17 == 0), F.concat(parent, F.lit("-gone"))).when(t > 0, parent).alias("in_reply_to"),
        )

    # forms -------------------------------------------------------------------------
    def fields(self) -> DataFrame:
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        segments = "BUILDING AUTOMOBILE MACHINERY HOUSEHOLD FURNITURE".split()
        none = F.array().cast("array<string>")

        def field(seq, name, ft, ff, max_len, options, states, value):
            return F.struct(
                F.lit(seq).cast("long").alias("seq"), F.lit(name).alias("name"), F.lit(ft).alias("ft"),
                F.lit(ff).cast("long").alias("ff"), F.lit(max_len).cast("long").alias("max_len"),
                options.alias("options"), states.alias("on_states"), value.alias("value"),
            )

        lits = lambda xs: F.array(*[F.lit(x) for x in xs])
        # One nation in seven is not offered, so its customers hold a value outside the options.
        nations = F.expr("filter(transform(sequence(0, 24), i -> if(i % 7 = 6, '', concat('NATION_', i))), x -> x <> '')")
        every = F.array(
            field(0, "name", "Tx", 0, 12, none, none, F.array("c_name")),
            field(1, "segment", "Ch", 1 << 17, None, lits(segments), none, F.array("c_mktsegment")),
            field(2, "in_credit", "Btn", 0, None, none, lits(["Yes"]), F.array(F.when(F.col("c_acctbal") >= 0, "Yes").otherwise("Off"))),
            field(3, "nations", "Ch", 1 << 21, None, nations, none, F.array("n_name")),
            field(4, "sign", "Sig", 0, None, none, none, none),
            field(5, "submit", "Btn", 1 << 16, None, none, none, none),
        )
        return c.select(F.col("c_custkey").alias("doc_id"), F.inline(every))

    def form_data(self) -> DataFrame:
        """The same data as it comes back: unknown names, wrong types and extra values mixed in."""
        f = self.fields().filter("seq < 5")
        n = F.col("doc_id") * 5 + F.col("seq")
        kind = F.expr("CASE ft WHEN 'Tx' THEN 'text' WHEN 'Btn' THEN 'checkbox' WHEN 'Sig' THEN 'signature' "
                      "ELSE CASE WHEN ff = 131072 THEN 'combo' ELSE 'list' END END")  # fmt: skip
        return f.select(
            "doc_id", "seq",
            F.when(n % 7 == 0, F.concat("name", F.lit("_x"))).otherwise(F.col("name")).alias("name"),
            F.when(n % 11 == 0, "radio").when(n % 3 == 0, "").otherwise(kind).alias("kind"),
            F.when(n % 13 == 0, F.array(F.lit("one"), F.lit("two"))).when(n % 17 == 0, F.array(F.lit("Maybe")))
            .otherwise(F.col("value")).alias("value"),
        )

    def field_tree(self) -> DataFrame:
        """Regions hold nations, nations hold customers."""
        r = self.table("region").select(
            F.concat(F.lit("r"), "r_regionkey").alias("field_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("t"))
        n = self.table("nation").select(
            F.concat(F.lit("n"), "n_nationkey").alias("field_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
            F.when(F.col("n_nationkey") % 5 != 3, F.col("n_name")).otherwise("").alias("t"))
        c = self.table("customer").select(
            F.concat(F.lit("c"), "c_custkey").alias("field_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("t"))
        return r.unionByName(n).unionByName(c)

    # images, words, signatures, edits --------------------------------------------
    def images(self) -> DataFrame:
        l = self.table("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
        k = F.col("l_orderkey") + F.col("l_partkey")
        size = F.floor("l_extendedprice").cast("long")
        pick = lambda n, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
        return l.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page_no"),
            F.col("l_partkey").alias("object_id"), (F.col("l_quantity") * 100).cast("long").alias("width_px"),
            (F.col("l_quantity") * 130).cast("long").alias("height_px"),
            F.when(k % 23 == 0, 1).when(k % 29 == 0, 16).when(k % 31 != 0, 8).cast("long").alias("bits"),
            pick(6, ["DeviceRGB", "DeviceGray", "ICCBased", "Indexed", "CalRGB", "DeviceCMYK"]).alias("color_space"),
            F.when(k % 19 == 0, "JPXDecode").otherwise("FlateDecode").alias("filter"),
            (k % 37 == 0).alias("masked"), (k % 41 != 0).alias("is_image"),
            F.when(F.col("l_linenumber") % 2 == 0, 612.0).otherwise(306.0).alias("page_width"),
            size.alias("n_bytes"), F.floor(size * (50 + F.round(F.col("l_discount") * 100).cast("long") * 6) / 100).cast("long").alias("new_bytes"),
        )

    def ocr_words(self) -> DataFrame:
        return self.runs().select(
            "doc_id", "page_no", F.col("run_no").alias("word_no"), "text",
            (((F.col("doc_id") * 31 + F.col("run_no") * 17) % 100) / 100.0).alias("confidence"),
            "left", "top", "right", "bottom",
        )

    def signatures(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.table("orders", "o_orderkey", "o_custkey").join(self.table("customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        return o.select(
            F.col("o_custkey").alias("doc_id"), k.alias("sig_id"), F.when(k % 43 == 0, "").otherwise(F.col("c_name")).alias("signer"),
            (k % 13 != 0).alias("signature_valid"), (k % 11 != 0).alias("digest_matches"),
            (k % 7 != 0).alias("covers_whole"), (k % 9 == 0).alias("expired"),
            F.when(k % 17 == 0, "broken").when(k % 3 == 0, "selfSigned").when(k % 3 == 1, "incomplete").otherwise("issuerNotChecked").alias("chain"),
            F.when(k % 5 != 0, k % 5).alias("level"),
            F.when(k % 19 == 0, F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>")).alias("problems"),
        )

    def edit_events(self, source: DataFrame | None = None) -> DataFrame:
        e = source if source is not None else self.table("events", "event_id", "ts", "user_id", "event_type", "value")
        op = F.expr("CASE event_type WHEN 'click' THEN 'record' WHEN 'view' THEN 'soft' WHEN 'error' THEN 'undo' "
                    "WHEN 'signup' THEN 'redo' ELSE 'save' END")  # fmt: skip
        return e.select(
            F.col("user_id").alias("doc_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"),
            F.floor(F.col("value") * 1048576).cast("long").alias("heap_bytes"),
        )


_WRAP = "CASE WHEN length(line) <= {n} THEN [line] ELSE regexp_extract_all(line, '[^ ].{{0,{m}}}(?: +|$)|[^ ]{{{n}}}') END"

# name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_lines": ((), """
        SELECT doc_id, lang, source, unnest(string_split(t, chr(10))) AS line,
               generate_subscripts(string_split(t, chr(10)), 1) AS li
        FROM (SELECT *, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS t FROM documents)"""),
    "wrapped": (("raw_lines",), f"""
        SELECT doc_id, lang, source, li, rtrim(unnest(ws)) AS line, generate_subscripts(ws, 1) AS wi
        FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN {_WRAP.format(n=36, m=35)} ELSE {_WRAP.format(n=80, m=79)} END AS ws FROM raw_lines)"""),
    "page_lines": (("wrapped",), """
        SELECT * FROM (
          SELECT *, max(CASE WHEN line <> '' THEN page_no END) OVER (PARTITION BY doc_id) AS last_page
          FROM (SELECT doc_id, lang, source, line, n // lpp AS page_no, n % lpp AS line_no
                FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 100 ELSE 50 END AS lpp,
                             row_number() OVER (PARTITION BY doc_id ORDER BY li, wi) - 1 AS n FROM wrapped)))
        WHERE page_no <= last_page"""),
    "doc_pages": (("page_lines",), """
        SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, page_no,
               string_agg(line, chr(10) ORDER BY line_no) AS text,
               CAST(strlen(string_agg(line, chr(10) ORDER BY line_no)) AS BIGINT) AS n_bytes,
               ((doc_id + page_no) % 4) * 90 AS rotate,
               CASE WHEN doc_id % 3 = 0 THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS width,
               CASE WHEN doc_id % 3 = 0 THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS height
        FROM page_lines GROUP BY doc_id, page_no"""),
    "line_words": (("page_lines",), """
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_no ORDER BY wi) - 1 AS w FROM (
          SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY wi) - length(word) - 1 AS s
          FROM (SELECT doc_id, lang, page_no, line_no, unnest(string_split(line, ' ')) AS word,
                       generate_subscripts(string_split(line, ' '), 1) AS wi FROM page_lines))
        WHERE word <> ''"""),
    "runs": (("line_words",), """
        SELECT doc_id, page_no, line_no * 1000 + w AS run_no, word AS text,
               CAST(x0 + 6 * s AS DOUBLE) AS "left", CAST(x0 + 6 * (s + length(word)) AS DOUBLE) AS "right",
               CAST(100 + 14 * r + w % 3 AS DOUBLE) AS top, CAST(112 + 14 * r + w % 3 AS DOUBLE) AS bottom,
               size, size > 9 AS bold, w % 7 = 3 AS italic,
               CASE WHEN title THEN 'ABCDEF+Arial-BoldMT' WHEN lang = 'en' THEN 'Calibri-Bold' WHEN lang = 'fr' THEN 'Georgia-Italic'
                    WHEN lang = 'de' THEN 'Consolas' ELSE 'QWERTY+Verdana' END AS font_name,
               title OR lang = 'es' AS embedded, CASE WHEN w % 11 = 5 THEN 3 ELSE 0 END AS render_mode
        FROM (SELECT *, line_no = 0 AND page_no = 0 AS title,
                     CAST(CASE WHEN line_no = 0 AND page_no = 0 THEN 18 WHEN line_no % 25 = 12 THEN 12 ELSE 9 END AS DOUBLE) AS size,
                     CASE WHEN line_no >= 50 THEN 354 ELSE 72 END + CASE WHEN line_no % 10 = 5 THEN 18 ELSE 0 END AS x0,
                     CASE WHEN line_no >= 50 THEN line_no - 50 ELSE line_no END AS r FROM line_words)"""),
    # what the layout operators must find, read off the view's own geometry
    "placed": (("runs",), """
        SELECT *, CASE WHEN wide AND "left" >= 354 THEN 1::BIGINT ELSE 0 END AS column_no, CAST(floor((top - 100) / 14) AS BIGINT) AS grid_row
        FROM (SELECT *, doc_id % 2 = 1 AND min("left") OVER p < 354 AND max("left") OVER p >= 354 AS wide
              FROM runs WINDOW p AS (PARTITION BY doc_id, page_no))"""),
    "ordered": (("placed",), """
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, column_no, line_no ORDER BY "left") - 1 AS seq
        FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no, column_no ORDER BY grid_row) - 1 AS line_no FROM placed)"""),
    "rules": (("doc_pages",), """
        WITH p AS (SELECT doc_id, page_no, 2 + doc_id % 3 AS r, 2 + page_no % 2 AS c FROM doc_pages)
        SELECT doc_id, page_no, true AS horizontal, CAST(152 + 24 * i AS DOUBLE) AS position, 72.0::DOUBLE AS lo, CAST(72 + 148 * c AS DOUBLE) AS hi
          FROM p, range(0, 5) t(i) WHERE i <= r
        UNION ALL SELECT doc_id, page_no, false, CAST(72 + 148 * j AS DOUBLE), 152.0, CAST(152 + 24 * r AS DOUBLE) FROM p, range(0, 5) t(j) WHERE j <= c
        UNION ALL SELECT doc_id, page_no, true, 86.0, 72.0, 540.0 FROM p
        UNION ALL SELECT doc_id, page_no, true, 164.0, 80.0, 84.0 FROM p
        UNION ALL SELECT doc_id, page_no, true, 152.5, 72.0, CAST(72 + 148 * c AS DOUBLE) FROM p
        UNION ALL SELECT doc_id, page_no, false, 72.5, 152.0, CAST(152 + 24 * r AS DOUBLE) FROM p"""),
    "grid": (("doc_pages",), """
        SELECT doc_id, page_no, i AS row_no, j AS col_no, r, c, CAST(72 + 148 * j AS DOUBLE) AS "left", CAST(220 + 148 * j AS DOUBLE) AS "right",
               CAST(152 + 24 * i AS DOUBLE) AS top, CAST(176 + 24 * i AS DOUBLE) AS bottom
        FROM (SELECT doc_id, page_no, 2 + doc_id % 3 AS r, 2 + page_no % 2 AS c FROM doc_pages), range(0, 5) t(i), range(0, 5) u(j)
        WHERE i < r AND j < c"""),
    "outline": (("doc_pages",), """
        SELECT doc_id, page_no AS node_id, CASE WHEN page_no % 6 = 4 THEN page_no - 3 END AS parent_id, page_no AS seq,
               'Section ' || page_no AS title, page_no AS page FROM doc_pages WHERE page_no % 3 = 1"""),
    "hrefs": ((), """
        SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS seq
        FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)"""),
    "annotations": ((), f"""
        SELECT conv_id AS doc_id, conv_id || '-' || turn AS id, turn AS seq, turn % 3 AS page,
               {KINDS!r}[turn % 14 + 1] AS kind, text AS contents, role AS author,
               CASE WHEN turn % 5 <> 4 THEN 1704067200000 + turn * 3600000 END AS modified,
               CASE WHEN turn > 0 AND (conv_id + turn) % 17 = 0 THEN conv_id || '-' || (turn - 1) || '-gone'
                    WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS in_reply_to
        FROM conversations"""),
    "fields": ((), """
        WITH c AS (SELECT c_custkey AS doc_id, * FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT doc_id, 0::BIGINT AS seq, 'name' AS name, 'Tx' AS ft, 0::BIGINT AS ff, 12 AS max_len, []::VARCHAR[] AS options, []::VARCHAR[] AS on_states, [c_name] AS value FROM c
        UNION ALL SELECT doc_id, 1, 'segment', 'Ch', 131072, NULL, ['BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD','FURNITURE'], [], [c_mktsegment] FROM c
        UNION ALL SELECT doc_id, 2, 'in_credit', 'Btn', 0, NULL, [], ['Yes'], [CASE WHEN c_acctbal >= 0 THEN 'Yes' ELSE 'Off' END] FROM c
        UNION ALL SELECT doc_id, 3, 'nations', 'Ch', 2097152, NULL, (SELECT list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey % 7 <> 6), [], [n_name] FROM c
        UNION ALL SELECT doc_id, 4, 'sign', 'Sig', 0, NULL, [], [], [] FROM c
        UNION ALL SELECT doc_id, 5, 'submit', 'Btn', 65536, NULL, [], [], [] FROM c"""),
    "field_kinds": (("fields",), """
        SELECT *, CASE name WHEN 'name' THEN 'text' WHEN 'segment' THEN 'combo' WHEN 'in_credit' THEN 'checkbox'
                            WHEN 'nations' THEN 'list' WHEN 'sign' THEN 'signature' ELSE 'pushbutton' END AS kind FROM fields"""),
    "form_data": (("field_kinds",), """
        SELECT doc_id, seq, CASE WHEN n % 7 = 0 THEN name || '_x' ELSE name END AS name,
               CASE WHEN n % 11 = 0 THEN 'radio' WHEN n % 3 = 0 THEN '' ELSE kind END AS kind,
               CASE WHEN n % 13 = 0 THEN ['one', 'two'] WHEN n % 17 = 0 THEN ['Maybe'] ELSE value END AS value
        FROM (SELECT *, doc_id * 5 + seq AS n FROM field_kinds WHERE seq < 5)"""),
    "images": ((), """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, l_partkey AS object_id,
               CAST(l_quantity * 100 AS BIGINT) AS width_px, CAST(l_quantity * 130 AS BIGINT) AS height_px,
               CASE WHEN k % 23 = 0 THEN 1 WHEN k % 29 = 0 THEN 16 WHEN k % 31 <> 0 THEN 8 END AS bits,
               ['DeviceRGB', 'DeviceGray', 'ICCBased', 'Indexed', 'CalRGB', 'DeviceCMYK'][k % 6 + 1] AS color_space,
               CASE WHEN k % 19 = 0 THEN 'JPXDecode' ELSE 'FlateDecode' END AS filter, k % 37 = 0 AS masked, k % 41 <> 0 AS is_image,
               CAST(CASE WHEN l_linenumber % 2 = 0 THEN 612 ELSE 306 END AS DOUBLE) AS page_width,
               CAST(floor(l_extendedprice) AS BIGINT) AS n_bytes,
               CAST(floor(l_extendedprice) AS BIGINT) * (50 + CAST(round(l_discount * 100) AS BIGINT) * 6) // 100 AS new_bytes
        FROM (SELECT *, l_orderkey + l_partkey AS k FROM lineitem)"""),
    "ocr_words": (("runs",), """
        SELECT doc_id, page_no, run_no AS word_no, text, ((doc_id * 31 + run_no * 17) % 100) / 100.0::DOUBLE AS confidence,
               "left", top, "right", bottom FROM runs"""),
    "signatures": ((), """
        SELECT o_custkey AS doc_id, k AS sig_id, CASE WHEN k % 43 = 0 THEN '' ELSE c_name END AS signer, k % 13 <> 0 AS signature_valid,
               k % 11 <> 0 AS digest_matches, k % 7 <> 0 AS covers_whole, k % 9 = 0 AS expired,
               CASE WHEN k % 17 = 0 THEN 'broken' ELSE ['selfSigned', 'incomplete', 'issuerNotChecked'][k % 3 + 1] END AS chain,
               CASE WHEN k % 5 <> 0 THEN k % 5 END AS level,
               CASE WHEN k % 19 = 0 THEN ['unreadable'] ELSE []::VARCHAR[] END AS problems
        FROM (SELECT *, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)"""),
    "edit_events": ((), """
        SELECT user_id AS doc_id, event_id, ts, CAST(floor(value * 1048576) AS BIGINT) AS heap_bytes,
               CASE event_type WHEN 'click' THEN 'record' WHEN 'view' THEN 'soft' WHEN 'error' THEN 'undo'
                               WHEN 'signup' THEN 'redo' ELSE 'save' END AS op FROM events"""),
}
