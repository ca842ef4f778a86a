"""Tokens, terms, truncation and redaction as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.vocabulary import DOMAIN_STOP_WORDS, INVESTIGATION_STOP_WORDS, NORMAL_FORMS

REDACTED = "[REDACTED]"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"
SECRET_NAME = r"[\w.-]*(?:api[_-]?key|token|password|secret)[\w.-]*"


def literal_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def has_any(tokens: Column, vocabulary: Iterable[str]) -> Column:
    return F.arrays_overlap(tokens, literal_array(vocabulary))


def no_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def pieces(text: Column) -> Column:
    """Lower-case pieces of every identifier in order: split at underscores and case changes. Null gives none."""
    parts = F.filter(F.flatten(F.transform(F.regexp_extract_all(no_null(text), F.lit(f"({WORD})"), 1), lambda w: F.split(w, "_"))), lambda p: p != "")
    found = lambda p: F.regexp_extract_all(p, F.lit(f"({CAMEL})"), 1)
    return F.transform(F.flatten(F.transform(parts, lambda p: F.when(F.size(found(p)) > 0, found(p)).otherwise(F.array(p)))), F.lower)


def identifier_tokens(text: Column) -> Column:
    """The distinct pieces of a text's identifiers, in order of appearance."""
    return F.array_distinct(pieces(text))


def tokens_with_variants(text: Column) -> Column:
    """Distinct tokens, each followed by its normal form where the dictionary has one."""
    table = F.create_map(*[F.lit(x) for pair in NORMAL_FORMS.items() for x in pair])
    return F.array_distinct(F.flatten(F.transform(identifier_tokens(text), lambda t: F.array_compact(F.array(t, table[t])))))


def select_terms(tokens: Column, vocabulary: Iterable[str]) -> Column:
    return F.array_intersect(tokens, literal_array(vocabulary))


def domain_words(tokens: Column) -> Column:
    return F.filter(F.array_except(tokens, literal_array(DOMAIN_STOP_WORDS)), lambda t: F.length(t) > 2)


def _variants(t: Column) -> Column:
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    root = cut(3)
    ing = F.endswith(t, F.lit("ing")) & (F.length(t) > 5)
    double = F.substring(root, F.length(root), F.lit(1)) == F.substring(root, F.length(root) - 1, F.lit(1))
    return F.array_compact(
        F.array(
            t,
            F.when(F.endswith(t, F.lit("ies")) & (F.length(t) > 4), F.concat(cut(3), F.lit("y"))),
            F.when(ing, root),
            F.when(ing, F.concat(root, F.lit("e"))),
            F.when(ing & (F.length(root) > 2) & double, cut(4)),
            F.when(F.endswith(t, F.lit("ed")) & (F.length(t) > 4), cut(2)),
            F.when(F.endswith(t, F.lit("s")) & (F.length(t) > 3), cut(1)),
        )
    )


def meaningful_terms(text: Column) -> Column:
    """Identifier tokens and their stems, longer than one letter, without stop words; in order of appearance."""
    every = F.array_distinct(F.flatten(F.transform(identifier_tokens(text), _variants)))
    return F.filter(F.array_except(every, literal_array(INVESTIGATION_STOP_WORDS)), lambda t: F.length(t) > 1)


def display_terms(text: Column) -> Column:
    return F.filter(F.array_except(identifier_tokens(text), literal_array(INVESTIGATION_STOP_WORDS)), lambda t: F.length(t) > 1)


def _display_variants(t: Column) -> Column:
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    plural = F.endswith(t, F.lit("s")) & (F.length(t) > 3)
    return F.array_compact(
        F.array(
            t,
            F.when(plural, cut(1)).otherwise(F.concat(t, F.lit("s"))),
            F.when(F.endswith(t, F.lit("y")) & (F.length(t) > 2), F.concat(cut(1), F.lit("ies"))),
            F.when(F.endswith(t, F.lit("ies")) & (F.length(t) > 4), F.concat(cut(3), F.lit("y"))),
        )
    )


def display_match(query_terms: Column, text_terms: Column) -> Column:
    """The query's display terms that the text has, in singular or plural, sorted."""
    return F.array_sort(F.array_intersect(query_terms, F.flatten(F.transform(text_terms, _display_variants))))


def dedupe_ignoring_case(values: Column) -> Column:
    """The first of values that differ only in case, order kept."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def dedupe_stripped(values: Column, limit: int | None = None) -> Column:
    """Stripped, not empty, first of equals, at most limit."""
    out = F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit is not None else out


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def one_line(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate_text(text: Column, limit: int) -> Column:
    """At most limit characters, the last three of them dots if something was cut."""
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    if limit <= 3:
        return F.when(F.length(text) <= limit, text).when(text.isNotNull(), F.lit("." * limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(rstrip(F.substring(text, 1, limit - 3)), F.lit("...")))


def truncate_after(text: Column, limit: int) -> Column:
    """limit characters, and three dots more if something was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(rstrip(F.substring(text, 1, limit)), F.lit("...")))


def redact(text: Column) -> Column:
    """Values of assignments to sensitive names and of bearer headers replaced. The passes see each other's output."""
    quoted = F.regexp_replace(text, rf"(?iU)([\"']?\b{SECRET_NAME}\b[\"']?\s*[:=]\s*)([\"'])(.*?)\2", rf"$1$2{REDACTED}$2")
    bare = F.regexp_replace(quoted, rf"(?iU)(\b{SECRET_NAME}\b\s*=\s*)([^\s,;)}}\]]+)", rf"$1{REDACTED}")
    header = F.regexp_replace(bare, r"(?iU)(authorization\s*:\s*bearer\s+)([A-Za-z0-9._~+/=-]+)", rf"$1{REDACTED}")
    return F.regexp_replace(header, r"(?iU)(\bbearer\s+)([A-Za-z0-9._~+/=-]+)", rf"$1{REDACTED}")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def truncate_code(source: Column, max_chars: int, max_lines: int) -> Column:
    """Redacted source, at most max_lines lines and max_chars characters, dots where it was cut."""
    if max_chars <= 0 or max_lines <= 0:
        return F.when(source.isNotNull(), F.lit(""))
    rows = lines(rstrip(redact(source)))
    kept = F.array_join(F.slice(rows, 1, max_lines), "\n")
    return truncate_text(F.when(F.size(rows) > max_lines, F.concat(rstrip(kept), F.lit("\n..."))).otherwise(kept), max_chars)


def display_name(name: Column, parent: Column, chunk_type: Column) -> Column:
    return F.when((chunk_type == "method") & parent.isNotNull() & (parent != ""), F.concat_ws(".", parent, name)).otherwise(name)


def alnum_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{Alnum}]+"), lambda w: w != "")
