"""Column functions on names and texts."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7F]*\z")


#: Bytes of text that are Python strings at a time.
PIECE = 1 << 20


def _normalized(text: pa.Array, form: str) -> pa.Array:
    """text in a normal form, piece by piece: a batch of whole texts is never a list of strings at once."""
    ends, at, out = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)), 0, []
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        out.append(pa.array((x and unicodedata.normalize(form, x) for x in text.slice(at, end - at).to_pylist()), pa.string()))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return _normalized(text, "NFC")


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _normalized(text, "NFKC")


def normal_form(c: Column, compatible: bool = False) -> Column:
    """Unicode's composed form, NFC, or NFKC if compatible; Spark has no function for it. Only texts that aren't ASCII go to Python."""
    return F.coalesce((_nfkc if compatible else _nfc)(F.when(~is_ascii(c), c)), c)


def sanitize(c: Column) -> Column:
    """Control characters go, except tab, line feed and carriage return; the rest in composed form."""
    return normal_form(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


def normalize_name(c: Column) -> Column:
    """Quotes and brackets go, white space becomes one _, ASCII names are lower-cased."""
    s = F.regexp_replace(F.trim(F.regexp_replace(c, r"[\"'`\[\]]", "")), r"\s+", "_")
    return F.when(is_ascii(s), F.lower(s)).otherwise(s)


def name_key(c: Column) -> Column:
    """A normalised name in composed form, so that one name in two spellings of its code points is one key."""
    return normal_form(normalize_name(c))


def dedupe_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def ascii_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.round(F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / n, 4)).otherwise(1.0)


def split_name(c: Column) -> Column:
    """STRUCT<db, schema, table> of a dotted name; what is between first and last is the schema."""
    p = F.split(c, r"\.")
    n = F.size(p)
    middle = F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), ".")
    return F.struct(F.when(n >= 3, p[0]).alias("db"), F.when(n == 2, p[0]).when(n >= 3, middle).alias("schema"), F.element_at(p, -1).alias("table"))


def ascii_names(names: Column) -> Column:
    """STRUCT<ascii, other, total, listed> of an array of names: how many are ASCII, how many aren't, and the ASCII ones, in order, by commas; nulls don't count."""
    some = F.array_compact(names)
    latin = F.filter(some, is_ascii)
    return F.struct(F.size(latin).alias("ascii"), (F.size(some) - F.size(latin)).alias("other"), F.size(some).alias("total"), F.array_join(latin, ", ").alias("listed"))


def manifest_key(c: Column) -> Column:
    """The last two segments, each normalised, lower-cased."""
    return F.array_join(F.transform(F.split(F.substring_index(c, ".", -2), r"\."), lambda x: F.lower(normalize_name(x))), ".")


def low_signal(c: Column) -> Column:
    """Names that say nothing: flag_1, temp_2, col3, x_4 or none."""
    return F.coalesce(F.trim(c), F.lit("")).rlike(r"(?i)^((flag|temp|x)_\d+|col\d+)?$")


_NUMBER = r"-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
#: What stands in a list's brackets, brackets inside it to any use of them in row lists.
_LIST = r"^(?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+"
_MARK = "\u0001"


def redact(c: Column) -> Column:
    """Quoted strings, compared numbers and numbers in IN lists of a statement made anonymous, lists of rows included; a sign before a number goes with it. A control character 1 in the text becomes a blank."""
    texts = F.regexp_replace(F.translate(c, _MARK, " "), r"N?'(?:[^']++|'')*+'", "'<REDACTED>'")
    compared = F.regexp_replace(texts, rf"([=<>]\s*+){_NUMBER}", "$1<N>")
    parts = F.split(F.regexp_replace(compared, r"(?i)(\bin\s*+\()", f"$1{_MARK}"), _MARK, -1)  # behind each IN ( starts a part that begins with its list
    number = rf"(?<![\w.])({_NUMBER})(?!\w)"
    listed = lambda x: F.concat(F.regexp_replace(F.regexp_extract(x, _LIST, 0), number, "<N>"), F.regexp_replace(x, _LIST, ""))
    return F.array_join(F.transform(parts, lambda x, i: F.when(i > 0, listed(x)).otherwise(x)), "")


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.([A-Za-z]{2,})", "$1***@***.$2")


#: Words in a column's name that say its values are phone numbers, or persons' names.
PHONE_NAMES = ["phone", "tel", "mobile", "cellular", "טלפון", "נייד", "פלאפון", "fax", "פקס"]
PERSON_NAMES = ["name", "שם", "full_name", "שם_מלא", "first", "last", "fname", "lname", "customer_name", "שם_לקוח"]
#: Kinds of personal data with their masks; the last two only in columns whose name tells so.
PHONE_ABROAD = (r"\+?\d[\d ()-]{6,}\d", "***-***-****")
PERSON = (r"^\s*\p{L}{2,20}(\s\p{L}{2,20}){1,3}\s*$", "***")
ANYWHERE = [
    (r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.([A-Za-z]{2,})", "$1***@***.$2"),
    (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "**** **** **** ****"),
    (r"^\s*\d{9}\s*$", "*********"),
    (r"\b0\d{1,2}[- ]?\d{3}[- ]?\d{4}\b", "***-***-****"),
]


def mask_pii(c: Column, column: str = "") -> Column:
    """Personal data masked, every kind that a value has, one after the other: emails, card numbers, an identity number of nine digits, phone numbers, names.

    Local phone numbers (0, area, seven digits) go anywhere; international ones, and values that look like a person's
    name (two to four words of letters), only in columns whose name says so, in English or Hebrew.
    """
    words = set(column.lower().replace("-", "_").split("_")) | {column.lower()}
    kinds = ANYWHERE + [PHONE_ABROAD] * bool(words & set(PHONE_NAMES)) + [PERSON] * bool(words & set(PERSON_NAMES))
    for pattern, mask in kinds:
        c = F.regexp_replace(c, pattern, mask)
    return c


def mask_rtl(c: Column) -> Column:
    """Runs of right-to-left letters become one [HE] and a blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\u0590-\u05FF\u0600-\u06FF]+", "[HE]"), r"(\[HE\]\s*)+", "[HE] "))


#: Other names of dialects.
DIALECTS = {
    "bq": "bigquery", "sf": "snowflake", "pg": "postgres", "postgresql": "postgres", "sqlserver": "tsql", "sql_server": "tsql", "mssql": "tsql", "databricks": "databricks",
}


def dialect(c: Column) -> Column:
    """A dialect's own name for any of its names; unknown ones pass, trimmed and lower-cased, blank ones are null."""
    name = F.lower(F.trim(c))
    table = F.create_map(*(F.lit(x) for pair in DIALECTS.items() for x in pair))
    return F.when(name != "", F.coalesce(table[name], name))


def strip_blocks(c: Column) -> Column:
    """{{...}} blocks go."""
    return F.trim(F.regexp_replace(c, r"(?s)\{\{.*?\}\}", ""))


def one_line(c: Column, separator: str = " | ") -> Column:
    """Lines trimmed and joined by a separator, blank ones left out, runs of spaces one space; null is empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    return F.trim(F.regexp_replace(F.array_join(lines, separator), " +", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def label(c: Column, otherwise: str = "migration") -> Column:
    """One label: blanks, commas, semicolons and bars become one hyphen, letters of any script stay; nothing left is `otherwise`."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s,;|]+", "-"), "-+", "-")
    out = F.regexp_replace(out, "^-|-$", "")
    return F.when(out == "", otherwise).otherwise(out)


def table_label(c: Column) -> Column:
    """table- and the name, dots as hyphens, lower-cased."""
    return F.concat(F.lit("table-"), F.lower(F.replace(c, F.lit("."), F.lit("-"))))


def band(score: Column) -> Column:
    """Highest, High, Medium or Low of a score or of a text that reads as one; anything else is Low."""
    score = score.try_cast("double")
    return F.when(score >= 80, "Highest").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def short_band(score: Column) -> Column:
    """high, medium or low."""
    score = score.try_cast("double")
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def mention_score(text: Column, schema: str, table: str) -> Column:
    """3 for each schema.table, 2 for each table, 1 more if the table stands as a word; case aside, without overlaps."""
    low = F.lower(F.coalesce(text, F.lit("")))
    times = lambda k: ((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("long")
    word = F.when(low.rlike(rf"(?<![_\p{{L}}\p{{N}}]){table.lower()}(?![_\p{{L}}\p{{N}}])"), 1).otherwise(0)
    return 3 * times(f"{schema}.{table}".lower()) + 2 * times(table.lower()) + word
