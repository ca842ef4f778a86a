"""Explainable scores: every candidate gets an array of components (name, value, details, contributes); a score is their sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import vocabulary as V
from fathom.functions.predicates import ATTRIBUTE_CHANGED, COMPARES, bare_name, counterparts, is_dunder
from fathom.functions.text import display_match, display_terms, has_any, identifier_tokens, literal_array, meaningful_terms, no_null

W = V.FAILURE_WEIGHTS


def no_details() -> Column:
    return F.array().cast("array<string>")


def component(name: str, value: Column | float, details: Column | None = None, contributes: bool = True) -> Column:
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), (details if details is not None else no_details()).alias("details"), F.lit(contributes).alias("contributes"))


def components(*parts: tuple[Column, Column]) -> Column:
    """The components whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, part) for condition, part in parts]))


def total(parts: Column) -> Column:
    return F.aggregate(F.filter(parts, lambda p: p["contributes"]), F.lit(0.0), lambda acc, p: acc + p["value"])


def by_name(parts: Column, name: str) -> Column:
    return F.filter(parts, lambda p: p["name"] == name)


def has_component(parts: Column, *names: str) -> Column:
    return F.exists(parts, lambda p: p["name"].isin(*names))


def scaled(parts: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(parts, lambda p: F.struct(p["name"].alias("name"), F.when(p["contributes"], p["value"] * factor).otherwise(p["value"]).alias("value"), p["details"].alias("details"), p["contributes"].alias("contributes")))


def capped(parts: Column, most: float) -> Column:
    """Scaled down in proportion so that the sum is at most most."""
    s = total(parts)
    return F.when((s <= most) | (s <= 0), parts).otherwise(scaled(parts, F.lit(most) / s))


def renamed(parts: Column, old: str, new: str) -> Column:
    return F.transform(parts, lambda p: F.struct(F.when(p["name"] == old, F.lit(new)).otherwise(p["name"]).alias("name"), p["value"].alias("value"), p["details"].alias("details"), p["contributes"].alias("contributes")))


def overlap(name: str, signal: Column, tokens: Column) -> tuple[Column, Column]:
    """A weak component: so much for each shared word, up to a limit."""
    weight, most = V.OVERLAP_WEIGHTS[name]
    shared = F.array_sort(F.array_intersect(signal, tokens))
    return F.size(shared) > 0, component(name, F.least(F.lit(most), F.size(shared) * F.lit(weight)), shared)


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (failure with signals, chunk with features) with what depends on both."""
    c = F.col
    low = F.lower("source_code")
    df = pairs.withColumn("x_defines", (c("chunk_type") == "class") & F.array_contains("expected_short", c("name")))
    df = df.withColumn("x_in_text", F.exists("expected", lambda e: F.contains(c("signal_text"), F.lower(e)))).withColumn("x_in_source", F.exists("expected", lambda e: F.contains(low, F.lower(e))))
    raises = lambda e: F.regexp_count("source_code", F.concat(F.lit(r"\braise\s+(?:[A-Za-z_]\w*\.)*\Q"), e, F.lit(r"\E\b"))) > 0
    df = df.withColumn("x_raises", F.exists("expected_short", raises)).withColumn("x_relevant", F.array_sort(F.array_intersect("exception_terms", "tokens")))
    df = df.withColumn("x_guard_call", F.arrays_overlap("guard_call_terms", "exception_terms"))
    return df.withColumn("x_evidence", c("x_defines") | c("x_raises") | c("x_in_source")).withColumn("x_strong", c("x_evidence") | c("x_guard_call") | (c("guard_name") & (F.size("x_relevant") > 0)))


def _business(df: DataFrame) -> Column:
    """Components of business behaviour; mostly for functions, one penalty for classes of other exceptions."""
    c = F.col
    name_terms = F.array_union("name_terms", "parent_terms")
    names = F.array_sort(F.array_intersect(name_terms, c("meaningful")))
    matches = F.when(F.size(names) > 0, names).otherwise(F.array_sort(F.array_intersect("tokens", "meaningful")))
    first = F.slice(matches, 1, 3)
    action = F.array_sort(F.array_intersect(name_terms, c("action_terms")))
    usable = c("is_function") & ~c("data_access") & ~c("constructor")
    shared = F.size(matches) > 0
    other = counterparts(c("called_pairs"))
    evident = c("pair_context") & (F.size("called_pairs") > 0)
    fits = F.arrays_overlap(F.concat(c("called_pairs"), other), c("meaningful")) | F.arrays_overlap("name_terms", "action_terms")
    paired = usable & evident & fits
    arrows = F.transform("called_pairs", lambda t: F.concat(t, F.lit("->"), F.element_at(counterparts(F.array(t)), 1)))
    context = c("is_function") & c("business_context")
    lone = c("pair_context") & c("defines_pair") & (F.size("called_pairs") == 0) & ~c("business_role") & c("state_logic")
    stranger = (c("chunk_type") == "class") & c("business_context") & c("exception_class") & ~c("x_defines") & ~c("x_in_text")
    return components(
        (usable & (F.size(action) > 0) & (c("business_role") | c("state_logic") | c("filter_logic")), component("business_operation", W["business_operation"], F.slice(action, 1, 3))),
        (usable & c("state_logic") & shared, component("state_update_logic", W["state_update_logic"], first)),
        (paired, component("paired_state_operation", W["paired_state_operation"], arrows)),
        (paired, component("possible_missing_counterpart_operation", W["possible_missing_counterpart_operation"], arrows)),
        (c("is_function") & c("filter_logic") & shared & ~c("constructor"), component("filtering_logic", W["filtering_logic"], first)),
        (context & c("data_access"), component("generic_crud_or_data_access_penalty", W["generic_crud_or_data_access_penalty"])),
        (context & c("route_passthrough"), component("route_or_controller_passthrough_penalty", W["route_or_controller_passthrough_penalty"])),
        (context & c("constructor"), component("constructor_or_init_penalty", W["constructor_or_init_penalty"])),
        (context & lone, component("single_paired_operation_penalty", W["single_paired_operation_penalty"])),
        (stranger, component("unrelated_exception_class_penalty", W["unrelated_exception_class_penalty"], F.array_sort(F.array_intersect("tokens", literal_array(("error", "exception")))))),
    )


def _signal_components(df: DataFrame) -> Column:
    c = F.col
    head = components((c("x_in_text"), component("contains_expected_exception", W["contains_expected_exception"], F.array_sort("expected"))), (c("x_defines"), component("expected_exception_definition", W["expected_exception_definition"], F.array("name"))))
    weak = components(*[overlap(name, c(signal), c("tokens")) for name, signal in (("exception_symbol_overlap", "exception_symbols"), ("behavioral_keyword_overlap", "behavioral"), ("operation_keyword_overlap", "operation"), ("domain_keyword_overlap", "domain"))])
    business = _business(df)
    relevant = F.size("x_relevant") > 0
    near = c("x_in_source") | relevant
    # what counts when an exception was expected and did not come
    guards = components(
        (c("x_raises"), component("raises_expected_exception", 2.50, F.array_sort("expected"))),
        (~c("x_raises") & c("has_raise") & relevant, component("validation_raise_logic", 0.50, c("x_relevant"))),
        (~c("x_raises") & c("has_raise") & ~relevant, component("generic_raise_statement", 0.10)),
        (c("x_in_source") & c("validation_text"), component("validation_raise_logic", 1.00, F.array_sort("expected"))),
        (c("guard_name"), component("validation_helper_name", F.when(near, 0.90).otherwise(0.20), F.array("name"))),
        (c("x_guard_call") | c("calls_guard"), component("calls_validation_helper", F.when(c("x_guard_call"), 0.80).otherwise(0.15))),
        (c("validation_text") & c("x_in_source"), component("validation_raise_logic", 0.25, c("x_relevant"))),
        (c("validation_text") & ~c("x_in_source"), component("validation_signal_overlap", F.when(relevant, 0.25).otherwise(0.10), c("x_relevant"))),
    )
    strong = c("x_defines") | c("x_raises") | c("x_in_source") | (c("guard_name") & relevant) | c("x_guard_call")
    operation = scaled(by_name(business, "business_operation"), 0.45 / 0.75)
    specific = components((strong & c("is_function"), component("specific_source_chunk_boost", 0.20)))
    guarded = F.concat(head, guards, F.when(strong, weak).otherwise(capped(weak, 0.15)), operation, specific)
    guarded = F.when((c("chunk_type") == "class") & ~c("x_defines"), scaled(guarded, 0.35)).otherwise(guarded)
    return F.when(c("did_not_raise"), guarded).otherwise(F.concat(head, weak, business))


def source_first_signal(extra: Column | None = None) -> Column:
    """Evidence that a chunk of source, not of tests, bears on a failure."""
    c = F.col
    said = F.size(extra) > 0 if extra is not None else F.lit(False)
    named = F.array_contains("message_symbols", c("name")) | F.array_contains("trace_symbols", c("name"))
    exception = c("x_defines") | c("x_raises") | c("x_in_text") | (F.size("x_relevant") > 0)
    return ~c("is_test") & (said | named | exception | c("guard_name") | c("x_guard_call") | (c("calls_guard") & F.arrays_overlap("tokens", "signal_words")) | (c("has_raise") & c("validation_text")))


def failure_components(pairs: DataFrame, base: str = "base_score", extra: str | None = None) -> DataFrame:
    """Pairs of pair_evidence with components, score and strong (source-first evidence)."""
    c = F.col
    reasons = c(extra) if extra else None
    at_file = F.filter("hint_files", lambda h: (c("path_key") == h) | F.endswith("path_key", F.concat(F.lit("/"), h)))
    at_folder = F.filter("hint_folders", lambda h: F.startswith("path_key", F.concat(h, F.lit("/"))))
    own = components(
        (F.lit(True), component("semantic_base_score", c(base))),
        (c("is_test"), component("test_chunk_penalty", W["test_chunk_penalty"])),
        (~c("is_test"), component("source_chunk_boost", W["source_chunk_boost"])),
        (F.array_contains("message_symbols", c("name")), component("message_symbol_match", W["message_symbol_match"], F.array("name"))),
        (F.array_contains("trace_symbols", c("name")), component("traceback_symbol_match", W["traceback_symbol_match"], F.array("name"))),
        (F.size(at_file) > 0, component("same_file_source_hint", W["same_file_source_hint"], F.slice(at_file, 1, 1))),
        (F.size(at_folder) > 0, component("same_directory_source_hint", W["same_directory_source_hint"], F.slice(at_folder, 1, 1))),
    )
    df = pairs.withColumn("signal_parts", _signal_components(pairs)).withColumn("signal_parts", F.when(c("is_test"), scaled(c("signal_parts"), 0.25)).otherwise(c("signal_parts")))
    df = df.withColumn("parts", F.concat(own, c("signal_parts"))).drop("signal_parts").withColumn("strong", source_first_signal(reasons))
    seen = F.array(F.lit("observed_non_scoring_signal"))
    paths = F.filter(reasons, lambda r: F.contains(r, F.lit("call path")) | F.contains(r, F.lit("called by"))) if extra else no_details()
    silent = components(
        (c("guard_name") & ~has_component(c("parts"), "validation_helper_name"), component("validation_helper_name", 0.0, F.array("name"), False)),
        (c("calls_guard") & ~has_component(c("parts"), "calls_validation_helper"), component("calls_validation_helper", 0.0, seen, False)),
        (c("data_access"), component("generic_crud_or_data_access_penalty", 0.0, seen, False)),
        (c("strong"), component("source_first_selection_signal", 0.0, seen, False)),
        (F.size(paths) > 0, component("call_path_boost", 0.0, paths, False)),
    )
    return df.withColumn("parts", F.concat("parts", silent)).withColumn("score", total(c("parts")))


FAILURE_ORDER = ("is_test", "path_key", "start_line", "chunk_id")


def ranked(rows: DataFrame, group: str, score: str = "score", ties: tuple[str, ...] = FAILURE_ORDER, name: str = "rank") -> DataFrame:
    """Rows with their place in the group: score descending, then the ties ascending."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)))


def select_source_first(rows: DataFrame, group: str, k: int, strong: str = "strong", is_test: str = "is_test", plain: str = "infra_failure", rank: str = "rank") -> DataFrame:
    """The k chosen rows of each group with their new rank: sources before tests where a strong source exists and the
    failure is not about test infrastructure, else by rank. k of 0 or less gives nothing."""
    w = Window.partitionBy(group)
    has = F.max(F.when(~F.col(is_test), F.col(strong)).otherwise(False)).over(w)
    late = has & ~F.col(plain) & F.col(is_test)
    order = Window.partitionBy(group).orderBy("_late", rank)
    return rows.withColumn("_late", late).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max(k, 0)).drop("_late").withColumn(rank, F.col("_place")).drop("_place")


# investigation

def investigation_features(chunks: DataFrame) -> DataFrame:
    """Chunk features that searches by description need: their terms and display terms."""
    text = F.concat_ws("\n", "name", no_null(F.col("parent")), "file_path", "source_code", "dependencies", "decorators")
    return chunks.withColumn("terms", meaningful_terms(text)).withColumn("shown_terms", display_terms(text))


def description_terms(questions: DataFrame) -> DataFrame:
    """Questions (description) with the terms that their pairs are scored by."""
    return questions.withColumn("q_terms", meaningful_terms(F.col("description"))).withColumn("q_shown", display_terms(F.col("description")))


def investigation_evidence(chunks: DataFrame) -> DataFrame:
    """Chunks with investigation features and what of their scores depends on the chunk alone."""
    c = F.col
    parts = lambda d: F.filter(F.split(d, r"\."), lambda p: p != "")
    domain_call = F.exists("dependencies", lambda d: (F.size(parts(d)) > 0) & F.arrays_overlap(identifier_tokens(F.try_element_at(parts(d), F.lit(-1))), c("called_pairs")) & ((F.size(parts(d)) == 1) | ~has_any(identifier_tokens(F.try_element_at(parts(d), F.lit(1))), V.IGNORED_CALL_HEADS)))
    df = chunks.withColumn("compares", c("source_code").rlike(COMPARES)).withColumn("changes", c("source_code").rlike(ATTRIBUTE_CHANGED))
    return df.withColumn("role", has_any(F.concat("parent_terms", "stem_terms"), V.INVESTIGATION_ROLES)).withColumn("domain_call", domain_call)


def investigation_score(pairs: DataFrame, base: str = "base_score") -> DataFrame:
    """Pairs (description, chunk with investigation features) with score and reasons. What depends on one side alone is made
    here only if description_terms and investigation_evidence have not made it."""
    c = F.col
    q = pairs if "q_terms" in pairs.columns else description_terms(pairs)
    q = q if "domain_call" in q.columns else investigation_evidence(q)
    q = q.withColumn("matched", F.array_intersect("q_terms", "terms")).withColumn("shown", F.slice(display_match(c("q_shown"), c("shown_terms")), 1, 4))
    works = c("is_function") & ~is_dunder(c("name")) & ~c("is_test")
    compares, changes, role, domain_call = c("compares"), c("changes"), c("role"), c("domain_call")
    business = works & role & ((F.size("matched") > 0) | compares)
    filtering = works & has_any(c("q_terms"), V.INVESTIGATION_FILTERING) & has_any(c("terms"), V.INVESTIGATION_FILTERING) & compares
    own_state = F.array_intersect("name_terms", literal_array(V.INVESTIGATION_STATE))
    calls = F.arrays_overlap("q_terms", F.concat("called_pairs", own_state))
    state = works & has_any(c("q_terms"), V.INVESTIGATION_STATE) & has_any(c("terms"), V.INVESTIGATION_STATE) & (changes | ((F.size("called_pairs") > 0) & calls))
    validation = ~c("is_test") & (c("guard_name") | c("calls_guard") | bare_name(c("name")).rlike(rf"^(?:{'|'.join(V.INVESTIGATION_VALIDATION_PREFIXES)})"))
    missing = (F.size("called_pairs") > 0) & (F.arrays_overlap("q_terms", F.concat(c("called_pairs"), counterparts(c("called_pairs")))) | (domain_call & calls))
    pair_state = c("defines_pair") & changes & F.arrays_overlap("q_terms", F.concat("name_terms", "terms"))
    paired = F.when(works & missing, F.lit("possible missing counterpart operation")).when(works & pair_state, F.lit("paired state operation"))
    access = ~c("is_test") & has_any(F.concat("parent_terms", "stem_terms"), V.INVESTIGATION_DATA_ACCESS) & has_any(c("name_terms"), V.GENERIC_DATA_ACCESS_NAMES) & ~has_any(c("q_terms"), V.STORAGE_QUERY_WORDS)
    vague = ~c("is_test") & (c("chunk_type") == "class") & ~has_any(c("matched"), V.INVESTIGATION_FILTERING + V.INVESTIGATION_STATE)
    add = lambda condition, value: F.when(condition, value).otherwise(0.0)
    score = c(base) + F.when(c("is_test"), -1.25).otherwise(0.25) + F.least(F.lit(1.2), F.size("matched") * 0.12) + add(business, 0.7) + add(filtering, 0.65) + add(state, 0.6) + add(validation, 0.55) + add(paired.isNotNull(), 0.45) - add(access, 0.5) - add(vague, 0.25)
    reasons = F.array_compact(
        F.array(
            F.lit("semantic match"), F.when(c("is_test"), F.lit("test context")), F.when(F.size("shown") > 0, F.concat(F.lit("operation match: "), F.array_join("shown", ", "))), F.when(business, F.lit("business operation")), F.when(filtering, F.lit("filtering logic")),
            F.when(state, F.lit("state update logic")), F.when(validation, F.lit("validation logic")), paired, F.when(access, F.lit("data-access context")),
        )
    )
    return q.withColumn("score", score).withColumn("reasons", F.array_distinct(reasons)).drop("q_terms", "q_shown", "matched", "shown", "compares", "changes", "role", "domain_call")
