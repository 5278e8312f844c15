"""Text column expressions: normalizing, hashing, tokens, keyword hits, clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon

# Java's \\s is ASCII-only, and its Unicode mode is slow, so white space is listed.
_ODD_SPACE = r"\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[ {_ODD_SPACE}]"
# Anything but a lone plain space, which needs no replacing. Most characters are visible
# ASCII, which is ruled out by one comparison first.
_SPACE_RUN = f"(?![!-~])(?:[{_ODD_SPACE}]{_SPACE}*| {_SPACE}+)"
#: The same characters one by one.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))
# A line break, or white space after sentence-ending punctuation. A blank line is two
# breaks with a blank piece between them, which is too short to be a clause.
_CLAUSE_BREAK = f"\\n|(?<=[.!?]){_SPACE}+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_space(c) -> Column:
    """Every whitespace run becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(col(c), _SPACE_RUN, " "))


def strip(c) -> Column:
    """Whitespace (any kind) removed from both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def stable_hash(c) -> Column:
    return F.sha1(col(c).cast("string"))


def normalized_id(regulation, native_id) -> Column:
    cleaned = F.regexp_replace(strip(native_id), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.lower(col(regulation)), F.lit("::"), cleaned)


def strip_invisible(c) -> Column:
    """Zero-width marks removed, no-break spaces made plain, ends trimmed."""
    return strip(F.translate(col(c), "\u00a0\u200b\ufeff\u2060", " "))


def uid_from_filename(c) -> Column:
    """File stem up to its first underscore; null when nothing is left."""
    stem = F.regexp_replace(F.regexp_extract(col(c), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return blank_to_null(F.split_part(stem, F.lit("_"), F.lit(1)))


#: Fixed value: what lies between runs of letters and digits; those of two and more are the terms below.
BETWEEN_TOKENS = "[^a-z0-9]+"


def tokenize(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]{2,}"), F.lit(0))


#: Fixed value: what a term of the TF-IDF model is, on lower-cased text; word bounds take in
#: letters and digits of all scripts.
MODEL_TOKEN = r"(?U)\b[a-zA-Z0-9][a-zA-Z0-9']+\b"


def model_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(MODEL_TOKEN), F.lit(0))


def evidence_tokens(c) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    )


def keyword_hits(lowered_text, keywords) -> Column:
    """Keywords that occur anywhere in the lower-cased text, in keyword order."""
    text = col(lowered_text)
    return F.filter(col(keywords), lambda k: F.contains(text, k))


def contains_any(lowered_text, words) -> Column:
    """True when any word is a substring; one pattern, so it stays code-generated."""
    import re

    return col(lowered_text).rlike("|".join(re.escape(w) for w in words))


def with_clauses(
    df: DataFrame, text_col: str, out: str = "clauses", min_chars: int = 24,
    whole_text_fallback: bool = True,
) -> DataFrame:
    """Add ``out`` ARRAY<STRING>: the clauses of each text, first spelling kept.

    Everything happens inside the row (sort, drop equal neighbours, sort back), so
    a table of documents needs no shuffle and the same code serves streams. The
    position in the array is the dense clause index.
    """
    pieces = F.filter(F.transform(F.split(text_col, _CLAUSE_BREAK), normalize_space),
                      lambda p: F.length(p) >= min_chars)
    keyed = F.transform(pieces, lambda p, i: F.struct(
        F.lower(p).alias("key"), i.alias("pos"), p.alias("clause")))
    step = df.withColumn("_sorted", F.sort_array(keyed))
    step = step.withColumn(
        "_kept",
        F.sort_array(
            F.transform(
                F.filter(
                    F.col("_sorted"),
                    lambda p, i: (i == 0)
                    | (p["key"] != F.get(F.col("_sorted"), i - 1)["key"]),
                ),
                lambda p: F.struct(p["pos"].alias("pos"), p["clause"].alias("clause")),
            )
        ),
    )
    kept = F.transform(F.col("_kept"), lambda p: p["clause"])
    if whole_text_fallback:
        whole = normalize_space(text_col)
        kept = F.when((F.size("_kept") == 0) & (whole != ""), F.array(whole)).otherwise(kept)
    empty = F.array().cast("array<string>")
    return step.withColumn(out, F.coalesce(kept, empty)).drop("_sorted", "_kept")


def unfold(df: DataFrame, array, *names: str) -> DataFrame:
    """One row per array element as (position, element), other columns kept.

    The plain explode functions imply a filter on the array's size, which the
    optimizer pushes down through the projections that build the array, repeating
    that work per row. The outer form has no such filter; the null row it adds for
    an empty array is dropped afterwards.
    """
    pos, item = names
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode_outer(array).alias(pos, item)).where(
        F.col(pos).isNotNull())


def unfold_structs(df: DataFrame, array, *keep: str) -> DataFrame:
    """The same for an array of structs, whose fields become columns."""
    out = unfold(df.select(*keep, F.col(array).alias("_items")), "_items", "_pos", "_item")
    return out.select(*keep, "_item.*")


def explode_clauses(df: DataFrame, clauses: str = "clauses") -> DataFrame:
    """One row per clause with its dense 0-based ``clause_index``."""
    return unfold(df, clauses, "clause_index", "clause")


# --- levels and categories ---------------------------------------------------

def classify_level(title, text, user_words=lexicon.USER_LEVEL_WORDS,
                   system_words=lexicon.SYSTEM_LEVEL_WORDS) -> Column:
    """First level whose words occur in title or text; organization otherwise."""
    bag = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")),
                              F.coalesce(col(text), F.lit(""))))
    return (
        F.when(contains_any(bag, user_words), "user")
        .when(contains_any(bag, system_words), "system")
        .otherwise("organization")
    )


def _exact(c: Column, table: dict) -> Column:
    """Exact lookup in a small dictionary, as one CASE per target value."""
    expr = None
    for target in dict.fromkeys(table.values()):
        hit = c.isin([k for k, v in table.items() if v == target])
        expr = F.when(hit, target) if expr is None else expr.when(hit, target)
    return expr


def map_category(c, table=None) -> Column:
    """Annotation category to level: exact name, then wording, else organization."""
    name = strip(c)
    lowered = F.lower(name)
    return F.when(name == "", F.lit(None).cast("string")).otherwise(
        _exact(name, table or lexicon.CATEGORY_LEVELS)
        .when(lowered.contains("user"), "user")
        .when(contains_any(lowered, ("security", "track")), "system")
        .otherwise("organization")
    )


def map_category_ci(c, table=None) -> Column:
    """Case-insensitive category to level; null when nothing fits (row is dropped)."""
    name = F.lower(normalize_space(c))
    return (
        _exact(name, table or lexicon.CATEGORY_LEVELS_LOWER)
        .when(contains_any(name, lexicon.CATEGORY_USER_WORDS), "user")
        .when(contains_any(name, lexicon.CATEGORY_SYSTEM_WORDS), "system")
        .when(contains_any(name, lexicon.CATEGORY_ORGANIZATION_WORDS), "organization")
    )


def _starts_with_any(c: Column, prefixes) -> Column:
    import re

    return c.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def map_practice(c) -> Column:
    """Practice name to level; null when unmapped."""
    name = strip(c)
    return (
        F.when(contains_any(F.lower(name), lexicon.PRACTICE_USER_WORDS), "user")
        .when(name.isin(list(lexicon.PRACTICE_SYSTEM_NAMES)), "system")
        .when(_starts_with_any(name, lexicon.PRACTICE_SYSTEM_PREFIXES), "system")
        .when(_starts_with_any(name, lexicon.PRACTICE_ORGANIZATION_PREFIXES), "organization")
    )


def metric_name(regulation, native_id, title) -> Column:
    joined = F.concat_ws(" | ", *[blank_to_null(c) for c in (regulation, native_id, title)])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Unnamed Metric"))


def subcategory_status(body) -> Column:
    return F.when(F.lower(col(body)).startswith("moved to "), "moved").otherwise("active")


def standard_family(filename) -> Column:
    """Standard family number in a file name, a trailing year dropped."""
    stem = F.regexp_replace(F.regexp_extract(col(filename), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    with_body = F.regexp_extract(stem, r"(?i)ISO[-_\s]?IEC[-_\s]?(\d+(?:-\d+)*)", 1)
    plain = F.regexp_extract(stem, r"(?i)ISO[-_\s]?(\d+(?:-\d+)*)", 1)
    token = F.coalesce(F.nullif(with_body, F.lit("")), F.nullif(plain, F.lit("")))
    return F.regexp_replace(token, r"^(.+)-(?:19|20)\d{2}$", "$1")


def standard_year(filename) -> Column:
    """Last year-like number in the file stem."""
    stem = F.regexp_replace(F.regexp_extract(col(filename), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    years = F.regexp_extract_all(stem, F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    return F.when(F.size(years) > 0, F.element_at(years, -1))


# --- verdict wording ---------------------------------------------------------

def verdict_reason(compliant, control_id, title, source, score, matched, requirement,
                   clause) -> Column:
    quoted = F.concat_ws(
        ", ", F.transform(F.slice(col(matched), 1, 4), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    )
    verb = F.when(col(compliant), "satisfies").otherwise("does not satisfy")
    return F.concat(
        F.lit("Clause "), verb, F.lit(" "), col(control_id), F.lit(" ("), col(title),
        F.lit("). Evidence source="), col(source), F.lit(", match_score="),
        F.format_string("%.3f", col(score)), F.lit(", matched_keywords=["), quoted,
        F.lit('], control_requirement="'), strip(F.substring(col(requirement), 1, 160)),
        F.lit('", clause_excerpt="'), strip(F.substring(col(clause), 1, 160)), F.lit('".'),
    )


def remediation(compliant, control_id, requirement) -> Column:
    return F.when(
        col(compliant),
        F.concat(F.lit("Clause currently satisfies "), col(control_id),
                 F.lit(". Strengthen with explicit implementation details.")),
    ).otherwise(
        F.concat(F.lit("Add explicit language covering "), col(control_id), F.lit(": "),
                 col(requirement))
    )
