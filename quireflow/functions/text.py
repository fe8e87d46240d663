"""Scalar text functions: escaping, decoding, dates, names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import ASCII_BOUNDARY  # noqa: F401  re-exported for callers building patterns

# Windows-1252 characters for the bytes 0x80-0x9F (unassigned ones keep their code).
CP1252_HIGH = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
_LATIN1_HIGH = "".join(chr(c) for c in range(0x80, 0xA0))


def windows_1252(content: Column) -> Column:
    """Bytes as Windows-1252: Latin-1 but for the printable characters at 0x80-0x9F."""
    return F.translate(F.decode(content, "ISO-8859-1"), _LATIN1_HIGH, CP1252_HIGH)


def xml_unescape(text: Column) -> Column:
    """Five entities; the ampersand last, so an escaped entity is not decoded twice."""
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_quote(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[,"\\n\\r]')), quoted).otherwise(text)


def percent_decode(text: Column) -> Column:
    """Decode ``%xx``; anything that is not a whole escape stays as it is."""
    guarded = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(guarded)


def scheme(url: Column) -> Column:
    """Lower-case URL scheme of two letters or more, else null."""
    found = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]+):", 1)
    return F.when(found != "", F.lower(found))


def parse_pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD[HHMMSS]`` to epoch milliseconds; the zone suffix is ignored.

    A day past its month's end rolls over into the next month.
    """
    s = F.regexp_replace(text, "^D:", "")
    d = F.when(F.length(s) >= 14, F.substring(s, 1, 14)).when(F.length(s) >= 8, F.substring(s, 1, 8))
    part = lambda a, n: F.substring(d, a, n).cast("int")
    month, day = part(5, 2), part(7, 2)
    first = F.make_date(part(1, 4), month, F.lit(1))
    days = F.unix_date(first).cast("long") + day - 1
    time = F.when(F.length(d) >= 14, part(9, 2) * 3600 + part(11, 2) * 60 + part(13, 2)).otherwise(0)
    ok = F.rlike(d, F.lit("^[0-9]+$"))
    return F.when(
        ok, F.when(F.substring(d, 5, 2).between("01", "12") & F.substring(d, 7, 2).between("01", "31"), (days * 86400 + time) * 1000)
    )


def strip_subset_tag(font: Column) -> Column:
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def sanitise_sheet_name(name: Column) -> Column:
    bare = F.trim(F.translate(name, "[]:*?/\\", ""))
    return F.when(bare == "", "Sheet").otherwise(F.left(bare, F.lit(31)))


def encode_segment(text: Column) -> Column:
    """One URL path segment: unreserved characters stay, every other UTF-8 byte is escaped."""
    enc = F.url_encode(text)
    return F.replace(F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def images_folder_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), F.lit("_files"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def parse_floats(text: Column) -> Column:
    """Numbers parted by commas, semicolons or white space; what is not a number is skipped."""
    parts = F.filter(F.split(text, "[,; \\t\\n\\r]"), lambda t: t != "")
    return F.filter(F.transform(parts, lambda t: t.try_cast("double")), lambda v: v.isNotNull())


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def format_from_path(path: Column) -> Column:
    """fdf, xfdf, json or csv by extension, else null; a bare dot-file has no extension."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^\\/]*)$", 1), r"^.+\.([^.]*)$", 1))
    return F.when(ext.isin("fdf", "xfdf", "json", "csv"), ext)


def winansi_offenders(text: Column) -> Column:
    """Up to three distinct characters the built-in fonts cannot draw, in order of appearance."""
    # ASCII, Latin-1, and the assigned Windows-1252 characters.
    high = "".join(c for c in CP1252_HIGH if ord(c) > 0xFF)
    bad = F.regexp_replace(text, f"[\\x00-\\x7E\\u00A0-\\u00FF{high}]", "")
    return F.slice(F.array_distinct(F.filter(F.split(bad, ""), lambda c: c != "")), 1, 3)


def winansi_fits(text: Column) -> Column:
    return F.size(winansi_offenders(text)) == 0


def date_input_ms(value: Column) -> Column:
    """``YYYY-MM-DD`` as midnight of the session's zone, in epoch milliseconds; empty is null."""
    return F.unix_millis(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))


def ms_date_input(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit(""))
