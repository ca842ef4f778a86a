"""Predicates on chunks of code and on failures, each a boolean or array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import vocabulary as V
from fathom.functions.paths import is_test_path, normalize_path, stem
from fathom.functions.text import alnum_words, has_any, identifier_tokens, literal_array, no_null, pieces, tokens_with_variants

# Patterns of definitions, calls, assignments and comparisons.
NOT_DEFINITION = r"(?m)^[ \t]*(?:async )?def .*$"
CALL = r"\b([A-Za-z_]\w*)\s*\("
PLACE_ASSIGNED = r"\b(?:self\.)?[A-Za-z_]\w*(?:\.[A-Za-z_]\w+|\[[^\]]+\])\s*(?:\+=|-=|(?<![=!<>])=(?!=))"
NAME_ASSIGNED = r"\b[A-Za-z_]\w*\s*(?:\+=|-=|(?<![=!<>])=(?!=))"
MUTATOR_CALLED = rf"\.(?:{'|'.join(V.MUTATORS)})\s*\("
FILTERS = r"(?s)\bfor\b.+\bif\b|\bfilter\s*\(|\bsorted\s*\(|\bwhere\b|\bmatches\b|>=|<=|==|!=| in | not in "
ATTRIBUTE_CHANGED = r"\b(?:self|cls|[A-Za-z_]\w*)\.[A-Za-z_]\w*\s*(?:[+\-*/]?=)"
COMPARES = r"\bif\b|\bfor\b|\bsorted\s*\(|\bfilter\s*\(|[<>]=?|==|!="


def bare_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^_+", ""))


def has_validation_name(name: Column) -> Column:
    others = "|".join(p for p in V.VALIDATION_PREFIXES if p != "can")
    return F.regexp_replace(F.lower(name), "^_+", "").rlike(rf"^(?:can(?:_|$)|(?:{others}))")


def contains_raise(source: Column) -> Column:
    return source.rlike(r"(?i)\braise\b")


def call_names(source: Column) -> Column:
    """Names before an opening bracket, outside of lines that define a function."""
    return F.regexp_extract_all(F.regexp_replace(no_null(source), NOT_DEFINITION, ""), F.lit(CALL), 1)


def last_part(dotted: Column) -> Column:
    return F.try_element_at(F.split(dotted, r"\."), F.lit(-1))


def calls_validation_helper(source: Column, dependencies: Column) -> Column:
    others = "|".join(p for p in V.VALIDATION_PREFIXES if p != "can")
    called = F.regexp_replace(no_null(source), NOT_DEFINITION, "").rlike(rf"\b(?:can_[A-Za-z0-9_]*|(?:{others})[A-Za-z0-9_]*)\s*\(")
    return F.exists(dependencies, lambda d: has_validation_name(last_part(d))) | called


def called_pair_terms(source: Column, dependencies: Column) -> Column:
    """Words of paired operations in the names of what is called, in order."""
    names = F.concat(F.transform(dependencies, last_part), call_names(source))
    return F.array_intersect(F.flatten(F.transform(names, identifier_tokens)), literal_array(V.PAIRED_WORDS))


def counterparts(terms: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.COUNTERPARTS.items() for x in pair])
    return F.array_distinct(F.transform(terms, lambda t: table[t]))


def defines_pair(name: Column, chunk_type: Column) -> Column:
    """A function whose name begins with a paired operation; no word end is asked for."""
    return chunk_type.isin("function", "method") & bare_name(name).rlike(rf"^(?:{'|'.join(V.PAIRED_WORDS)})")


def state_update_logic(source: Column, tokens: Column) -> Column:
    low = F.lower(no_null(source))
    return low.rlike(PLACE_ASSIGNED) | F.when(low.rlike(NAME_ASSIGNED), has_any(tokens, V.STATE_UPDATE_WORDS)).otherwise(low.rlike(MUTATOR_CALLED))


def filtering_logic(source: Column, tokens: Column) -> Column:
    return has_any(tokens, V.FILTERING_WORDS) & F.lower(no_null(source)).rlike(FILTERS)


CRUD_NAME = rf"^(?:{'|'.join(V.CRUD_PREFIXES)})(?:_|$)"


def data_access(path: Column, parent: Column, name: Column) -> Column:
    """A repository-like place and a name that begins with a create, read, update or delete word."""
    place = has_any(F.split(normalize_path(path), "/"), V.DATA_ACCESS_FOLDERS) | F.lower(no_null(parent)).rlike("|".join(V.DATA_ACCESS_PARENTS))
    return place & bare_name(name).rlike(CRUD_NAME)


def is_constructor(name: Column) -> Column:
    return F.lower(name).isin("__init__", "init", "initialize")


def is_dunder(name: Column) -> Column:
    return name.rlike(r"^__.*__$")


def query_mentions(query: Column, vocabulary: tuple[str, ...]) -> Column:
    return has_any(alnum_words(query), vocabulary)


def is_infrastructure(path: Column, fragments: tuple[str, ...] = ()) -> Column:
    """Below one of the configured path fragments; none by default."""
    wrapped = F.concat(F.lit("/"), normalize_path(path), F.lit("/"))
    return F.greatest(*[F.contains(wrapped, F.lit(f)) for f in fragments], F.lit(False), F.lit(False))


def mentions_test_infrastructure(text: Column) -> Column:
    return F.lower(text).rlike("|".join(V.TEST_INFRASTRUCTURE))


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Chunks with everything rankings need that depends on the chunk alone; made once, when an index is built."""
    c = F.col
    listed = lambda name: F.filter(F.coalesce(c(name), F.array().cast("array<string>")), lambda x: x.isNotNull())
    source = no_null(c("source_code"))
    df = chunks.withColumn("dependencies", listed("dependencies")).withColumn("decorators", listed("decorators")).withColumn("source_code", source)
    df = df.withColumn("path_key", normalize_path(c("file_path"))).withColumn("is_test", is_test_path(c("file_path")))
    text = F.concat_ws("\n", c("name"), no_null(c("parent")), c("source_code"), c("dependencies"), c("decorators"))
    df = df.withColumn("signal_text", F.lower(text)).withColumn("tokens", tokens_with_variants(text))
    df = df.withColumn("name_terms", identifier_tokens(c("name"))).withColumn("parent_terms", identifier_tokens(c("parent")))
    df = df.withColumn("role_terms", F.array_distinct(F.concat(pieces(c("file_path")), c("name_terms"), c("parent_terms"))))
    is_function = c("chunk_type").isin("function", "method")
    df = (
        df.withColumn("guard_name", has_validation_name(c("name")))
        .withColumn("calls_guard", calls_validation_helper(c("source_code"), c("dependencies")))
        .withColumn("called_names", F.array_distinct(F.concat(F.transform("dependencies", last_part), F.regexp_extract_all("source_code", F.lit(CALL), 1))))
        .withColumn("guard_call_terms", F.array_distinct(F.flatten(F.transform(F.filter("called_names", has_validation_name), identifier_tokens))))
        .withColumn("called_pairs", called_pair_terms(c("source_code"), c("dependencies")))
        .withColumn("defines_pair", defines_pair(c("name"), c("chunk_type")))
        .withColumn("has_raise", contains_raise(c("source_code")))
        .withColumn("state_logic", state_update_logic(c("source_code"), c("tokens")))
        .withColumn("filter_logic", filtering_logic(c("source_code"), c("tokens")))
        .withColumn("data_access", data_access(c("file_path"), c("parent"), c("name")))
        .withColumn("constructor", is_constructor(c("name")))
        .withColumn("business_role", has_any(c("role_terms"), V.BUSINESS_ROLES))
        .withColumn("validation_text", has_any(c("tokens"), V.VALIDATION_WORDS))
        .withColumn("exception_class", (c("chunk_type") == "class") & has_any(F.concat(c("name_terms"), identifier_tokens(c("source_code"))), ("error", "exception")))
        .withColumn("is_function", is_function)
    )
    short = F.size(F.split(F.regexp_replace("source_code", r"\n\z", ""), "\n")) <= 20
    df = df.withColumn("route_passthrough", has_any(c("role_terms"), V.ROUTE_ROLES) & ~c("state_logic") & ~c("filter_logic") & F.contains(F.lower("source_code"), F.lit("return ")) & short)
    return df.withColumn("stem_terms", identifier_tokens(stem(c("file_path"))))


# columns of chunk_features that scores need besides the chunk itself
FEATURES = ("path_key", "is_test", "signal_text", "tokens", "name_terms", "parent_terms", "role_terms", "guard_name", "calls_guard", "guard_call_terms", "called_pairs", "defines_pair", "has_raise", "state_logic", "filter_logic", "data_access", "constructor", "business_role", "validation_text", "exception_class", "is_function", "route_passthrough", "stem_terms")
