"""Small string and date helpers: splitting, trimming, dot fields, strftime formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime directives and their Java patterns.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a",
    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%%": "'%'",
}


def java_pattern(fmt: str) -> str:
    """A strftime format as a Java date pattern; everything else is quoted."""
    out, plain, at = [], "", 0
    while at < len(fmt):
        if fmt[at] == "%" and fmt[at : at + 2] in DIRECTIVES:
            if plain:
                out.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            out.append(DIRECTIVES[fmt[at : at + 2]])
            at += 2
        else:
            plain += fmt[at]
            at += 1
    if plain:
        out.append("'" + plain.replace("'", "''") + "'")
    return "".join(out)


def parse_stamp(text: Column) -> Column:
    """Timestamps of the form 20000131-12:00:00."""
    return F.to_timestamp(text, "yyyyMMdd-HH:mm:ss")


def dot_field(name: Column, number: int) -> Column:
    """The number-th field (from 1) between dots of a file name."""
    return F.split_part(name, F.lit("."), F.lit(number))


def with_date(path: Column, date: Column) -> Column:
    """The first * of a path becomes the date."""
    return F.regexp_replace(path, r"^([^*]*)\*", F.concat(F.lit("$1"), date))


def split_names(text: Column) -> Column:
    """Comma or semicolon separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def clean_name(name: Column) -> Column:
    """Names in files have no spaces and no parentheses."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r" ", "_"), r"[()]", "")
