"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves up by the same float operations in every engine."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def half_up_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits} + 0.5) / {float(10**digits)})"


def agreement(spread: Column, overall: Column) -> Column:
    """Label of a topic from the spread of its actors' means and their overall mean."""
    return (
        F.when(spread.isNull() | overall.isNull(), F.lit(None))
        .when((spread <= 0.5) & (overall <= -0.5), "Aligned against goal")
        .when((spread <= 0.5) & (overall < 0.5), "Noncommittal")
        .when(spread <= 0.5, "Aligned")
        .when(spread <= 1.5, "Mixed")
        .otherwise("Divergent")
    )


def agreement_sql(spread: str, overall: str) -> str:
    return f"""CASE WHEN {spread} IS NULL OR {overall} IS NULL THEN NULL
      WHEN {spread} <= 0.5 AND {overall} <= -0.5 THEN 'Aligned against goal' WHEN {spread} <= 0.5 AND {overall} < 0.5 THEN 'Noncommittal'
      WHEN {spread} <= 0.5 THEN 'Aligned' WHEN {spread} <= 1.5 THEN 'Mixed' ELSE 'Divergent' END"""


def agreement_color(label: Column) -> Column:
    return F.when(label.startswith("Aligned"), "green").when(label == "Noncommittal", "grey").when(label == "Mixed", "amber").when(label == "Divergent", "red")


def stance_norm(score: Column) -> Column:
    """-2..2 onto 0..1."""
    return (score + 2) / 4


def fmt_stance(score: Column) -> Column:
    return F.format_string("%+.1f", score.cast("double"))


def strip(text: Column | str) -> Column:
    """Without white space at its ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\r\x0b\x0c"))


def json_string(text: Column) -> Column:
    """A JSON string of ASCII characters alone: others by their UTF-16 units, as \\u and four small hex digits."""
    short = {"000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f", "0022": '\\"', "005C": "\\\\"}
    names = F.create_map(*[F.lit(x) for p in short.items() for x in p])
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"))
    plain = lambda u: F.chr(F.conv(u, 16, 10).cast("long"))
    one = lambda u: F.coalesce(F.try_element_at(names, u), F.when(u.between("0020", "007E"), plain(u)), F.concat(F.lit("\\u"), F.lower(u)))
    quick = ~text.rlike(r'[^ !#-\[\]-~]')
    return F.concat(F.lit('"'), F.when(quick, text).otherwise(F.array_join(F.transform(units, one), "")), F.lit('"'))


def content_hash(url: Column, title: Column) -> Column:
    """First eight hex digits of the sha256 of url and title, with nothing between."""
    return F.substring(F.sha2(F.concat(url, title), 256), 1, 8)


#: Named entities beside the numbered ones; `amp` last, as what it gives is not read again.
ENTITIES = {
    "nbsp": " ", "middot": "·", "copy": "©", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bdquo": "„", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ocirc": "ô", "euro": "€", "amp": "&",
}


def read_entities(text: Column) -> Column:
    """Named and numbered character references as characters; unknown ones stay."""
    code = lambda p: F.coalesce(F.regexp_extract(p, "^&#([0-9]{1,7});", 1).try_cast("int"), F.conv(F.regexp_extract(p, "(?i)^&#x([0-9a-f]{1,6});", 1), 16, 10).try_cast("int"))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    known = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    one = lambda p: F.when(known(code(p)), F.concat(char(code(p)), F.regexp_replace(p, "^&#[0-9A-Fa-fxX]+;", ""))).otherwise(p)
    out = F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "(?=&#)"), one), "")).otherwise(text)
    for name, char_ in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char_))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, entities read, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(read_entities(x), r"[ \t\n\r]+", " "))
