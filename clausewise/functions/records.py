"""Expressions over loosely typed records: dates, numbers, aliases, JSON, DDL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions.text import blank_to_null, col, normalize_space, strip

# The only accepted spellings of dates and integers.
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_US_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
_INTEGER = r"^[+-]?\d+$"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_date(c) -> Column:
    """DATE from ``YYYY-MM-DD`` or ``MM/DD/YYYY``; two-digit years are refused."""
    t = strip(c)
    return F.when(t.rlike(_ISO_DATE), F.try_to_date(t, "yyyy-M-d")).when(
        t.rlike(_US_DATE), F.try_to_date(t, "M/d/yyyy"))


def to_int(c) -> Column:
    t = strip(F.replace(col(c), F.lit(","), F.lit("")))
    return F.when(t.rlike(_INTEGER), t.try_cast("bigint"))


def to_float(c) -> Column:
    t = strip(c)
    return F.when(t.rlike(_DECIMAL), t.try_cast("double"))


def safe_int(c) -> Column:
    t = strip(c)
    return F.when(t.rlike(_INTEGER), t.try_cast("bigint"))


def url_date_pair(c7, c8) -> tuple[Column, Column]:
    """(url, date text): whichever column starts with ``http`` is the URL."""
    a = F.coalesce(strip(c7), F.lit(""))
    b = F.coalesce(strip(c8), F.lit(""))
    url = F.when(a.startswith("http"), a).when(b.startswith("http"), b)
    date = (F.when(a.startswith("http"), b).when(b.startswith("http"), a)
            .otherwise(F.coalesce(F.nullif(a, F.lit("")), b)))
    return url, date


def pick_alias(columns, names, read=None) -> Column:
    """Value under the first alias that exists, even when that value is empty.

    With a list of column names the choice is made once, from the schema; pass a
    MAP column instead for rows whose keys differ (see :func:`pick_alias_map`).
    """
    by_lower = {}
    for name in columns:
        by_lower[name.lower()] = name
    for alias in names:
        if alias.lower() in by_lower:
            return F.col(f"`{by_lower[alias.lower()]}`")
    return F.lit(None).cast("string")


def pick_alias_map(m, names) -> Column:
    """The same over a MAP column with lower-cased keys; presence, not null-ness."""
    m = col(m)
    expr = F.lit(None).cast("string")
    for alias in reversed(list(names)):
        expr = F.when(F.map_contains_key(m, alias.lower()), F.element_at(m, alias.lower())
                      ).otherwise(expr)
    return expr


def missing_fields(fields) -> Column:
    """Names of required fields that are null or empty."""
    return F.array_compact(F.array(*[
        F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields
    ]))


def uid_sort_key(uid) -> Column:
    """Integer uids first (zero-padded), others after them."""
    n = safe_int(uid)
    return F.struct(
        F.when(n.isNull(), 1).otherwise(0).alias("is_text"),
        F.when(n.isNull(), col(uid)).otherwise(
            F.format_string("%08d", F.coalesce(n, F.lit(0)))).alias("text"),
    )


def first_non_blank(*cols) -> Column:
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def control_fields() -> dict[str, Column]:
    """Loosely named control rows to evidence fields; first non-empty name wins."""
    control_id = F.coalesce(first_non_blank("native_id", "control_id", "normalized_id"),
                            F.lit("unknown"))
    return {
        "regulation": F.coalesce(first_non_blank("regulation"), F.lit("UNKNOWN")),
        "control_id": control_id,
        "title": F.coalesce(first_non_blank("title"), control_id),
        "requirement": F.coalesce(first_non_blank("text", "requirement"), F.lit("")),
    }


# --- JSON ----------------------------------------------------------------------

def _unquote(token: Column) -> Column:
    """Decode one quoted JSON string."""
    return F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]


def is_json(c) -> Column:
    """True for text that is exactly one JSON value.

    The parser itself ignores what follows the first value, so the text is read as
    the only element of an array.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), col(c), F.lit("]")))
    return wrapped.isNotNull() & (strip(c) != "") & F.try_variant_get(
        wrapped, "$[1]", "variant").isNull()


def json_keys(c) -> Column:
    """All object keys at every depth, trimmed and lower-cased; null if not JSON.

    In well-formed JSON a quoted string followed by a colon is always a key, and
    scanning left to right keeps string boundaries aligned, so no walk is needed.
    """
    text = col(c)
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"\s*:?'), F.lit(0))
    keys = F.transform(
        F.filter(tokens, lambda t: t.endswith(":")),
        lambda t: F.lower(strip(_unquote(F.regexp_replace(t, r"\s*:$", "")))),
    )
    return F.when(is_json(text), F.filter(F.array_sort(F.array_distinct(keys)), lambda k: k != ""))


def selected_texts(payload) -> Column:
    """Distinct non-blank strings under ``selectedText``, in document order."""
    text = strip(payload)
    found = F.regexp_extract_all(
        text, F.lit(r'"selectedText"\s*:\s*("(?:[^"\\]|\\.)*+")'), F.lit(1))
    clean = F.filter(F.transform(found, lambda t: normalize_space(_unquote(t))),
                     lambda t: t != "")
    empty = F.array().cast("array<string>")
    return F.when(is_json(text), F.array_distinct(clean)).otherwise(empty)


# --- DDL -----------------------------------------------------------------------

_DDL_SKIP = r"^(?:create table|primary key|foreign key|constraint|index|\))"
_DDL_TYPED = r'^[`"\[]?([A-Za-z_][A-Za-z0-9_]*)[`"\]]?\s+[A-Za-z]'
_DDL_COLON = r'^[`"\[]?([A-Za-z_][A-Za-z0-9_]*)[`"\]]?\s*:\s*'
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _lines(c: Column) -> Column:
    return F.filter(
        F.transform(F.split(strip(c), LINE_BREAK), lambda x: F.btrim(strip(x), F.lit(","))),
        lambda x: x != "",
    )


def schema_fields(ddl, with_json: bool = True) -> Column:
    """Field names found in DDL or JSON schema text: lower, distinct, sorted."""
    typed = F.transform(
        F.filter(_lines(col(ddl)), lambda x: ~F.lower(x).rlike(_DDL_SKIP)),
        lambda x: F.lower(F.coalesce(
            F.nullif(F.regexp_extract(x, _DDL_TYPED, 1), F.lit("")),
            F.regexp_extract(x, _DDL_COLON, 1))),
    )
    names = F.filter(typed, lambda x: x != "")
    if with_json:
        names = F.concat(names, F.coalesce(json_keys(strip(col(ddl))),
                                           F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(names))


def table_names(ddl) -> Column:
    lines = F.filter(F.transform(F.split(col(ddl), LINE_BREAK), strip),
                     lambda x: F.lower(x).startswith("create table "))
    return F.transform(lines, lambda x: F.btrim(
        F.element_at(F.split(x, r"\s+"), 3), F.lit('`"[]()' )))


def fields_matching(fields, patterns) -> Column:
    """Fields that contain any pattern as a substring, sorted and distinct."""
    import re

    pattern = "|".join(re.escape(p) for p in patterns)
    return F.array_sort(F.array_distinct(
        F.filter(col(fields), lambda f: F.lower(f).rlike(pattern))))


def pii_fields(fields, patterns=lexicon.PII_PATTERNS) -> Column:
    return fields_matching(fields, patterns)


def sensitive_fields(fields, patterns=lexicon.SENSITIVE_PATTERNS) -> Column:
    return fields_matching(fields, patterns)


def dataset_source(source, labeled_path, mixed_root, mixed_set, annotation_set) -> Column:
    """Descriptor of where a run's data came from; first non-empty wins."""
    base = F.regexp_extract(strip(labeled_path), r"([^/]*)$", 1)
    return F.coalesce(
        blank_to_null(source),
        F.when(blank_to_null(labeled_path).isNotNull(), F.concat(F.lit("labeled::"), base)),
        F.when(blank_to_null(mixed_root).isNotNull(),
               F.concat(F.lit("mixed::"), F.coalesce(blank_to_null(mixed_set),
                                                      F.lit("normalized")))),
        F.concat(F.lit("annotated::"), F.coalesce(blank_to_null(annotation_set),
                                                  F.lit("unknown"))),
    )
