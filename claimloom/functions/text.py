"""Text, JSON and IRI functions: Columns where Spark can say it, Arrow functions where it cannot."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from .lazy import arrow_function

#: White space as Python's regular expressions see it; Java's own class is narrower.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Types whose JSON is the same from Spark and from Python.
PLAIN = frozenset(("tinyint", "smallint", "int", "bigint", "boolean"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def non_blank(text: Column) -> Column:
    """Whether anything but white space stands in text; false for null."""
    return F.coalesce(F.length(trimmed(text)) > 0, F.lit(False))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding with no reserved character left as it is; Spark's own is that of forms."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


@arrow_function("string")
def nfc(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def _sorted_dump(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@arrow_function("string")
def canonical_json(text):
    """Sorted keys, no spaces, no ASCII escapes; null for null and for what is not JSON. The last of repeated keys holds."""
    try:
        return None if text is None else _sorted_dump(text)
    except ValueError:
        return None


def canonical_struct(rows: DataFrame, *fields: str) -> Column:
    """Canonical JSON of an object of fields of rows. Whole numbers and truth values under plain names are written the same by Spark; the rest goes through canonical_json."""
    kinds = dict(rows.select(*fields).dtypes)
    names = sorted(fields)
    plain = len(kinds) == len(names) and all(re.fullmatch(r"[A-Za-z0-9_]+", n) and kinds.get(n) in PLAIN for n in names)
    text = F.to_json(F.struct(*[F.col(n) for n in (names if plain else fields)]), {"ignoreNullFields": "false"})
    return text if plain else canonical_json(text)


@arrow_function("string")
def compact_json(text):
    """As canonical_json, keys left in their order."""
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


@arrow_function("string")
def quoted(text):
    """text in quotes as Python prints it, as messages quote names."""
    return None if text is None else repr(text)


@arrow_function("string")
def float_text(number):
    """The shortest decimal that gives the number again, as Python prints it."""
    return None if number is None else str(float(number))


def plain_text(text: Column) -> Column:
    """Line ends as line feeds, runs of white space in a line as one space, lines and the whole trimmed."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return trimmed(F.array_join(F.transform(lines, lambda x: trimmed(F.regexp_replace(x, f"{SPACE}+", " "))), "\n"))


def sha_identity(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def exact_keys(document: Column, *keys: str) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(document)) == F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(False))
