"""Why a chunk was retrieved, what a failure comes down to, and what may be wrong: texts built from score components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import dedupe_ignoring_case, no_null, one_line, strip, truncate_after
from fathom.operators.callpath import is_traceback_source, traceback_files
from fathom.operators.scoring import by_name, has_component

# The public wording of reasons.
PUBLIC = {
    "called by top source chunk": "call path match",
    "called by traceback source": "call path match",
    "reverse call-path context": "reverse call path match",
    "caller of validation helper": "calls validation logic",
    "caller of expected-exception logic": "exception-related call path",
    "exception logic on call path": "exception-related call path",
    "validation helper on call path": "validation logic",
    "validation helper name": "validation logic",
    "calls validation helper": "calls validation logic",
    "contains expected exception": "references expected exception",
    "source chunk from traceback file": "traceback file match",
    "generic data-access signal": "data-access context",
    "semantic similarity": "semantic match",
    "validation raise logic": "validation logic",
    "business caller context": "call path match",
}
LABELS = (
    ("expected_exception_definition", "defines expected exception"),
    ("raises_expected_exception", "raises expected exception"),
    ("contains_expected_exception", "references expected exception"),
    ("validation_helper_name", "validation logic"),
    ("calls_validation_helper", "calls validation logic"),
    ("same_file_source_hint", "traceback file match"),
    ("behavioral_keyword_overlap", "keyword match: "),
    ("operation_keyword_overlap", "operation match: "),
    ("validation_raise_logic", "validation logic"),
    ("test_chunk_penalty", "test context"),
    ("generic_crud_or_data_access_penalty", "data-access context"),
    ("business_operation", "business operation"),
    ("state_update_logic", "state update logic"),
    ("paired_state_operation", "paired state operation"),
    ("possible_missing_counterpart_operation", "possible missing counterpart operation"),
    ("filtering_logic", "filtering logic"),
)


def public_reason(reason: Column) -> Column:
    flat = one_line(reason)
    table = F.create_map(*[F.lit(x) for pair in PUBLIC.items() for x in pair])
    return F.coalesce(table[flat], F.when(F.startswith(flat, F.lit("called via ")), F.lit("call path match")).otherwise(F.regexp_replace(F.regexp_replace(flat, "^behavioral keyword overlap:\\s*(?=.)", "keyword match: "), "^operation keyword overlap:\\s*(?=.)", "operation match: ")))


def reasons(parts: Column, extra: Column, from_traceback: Column, limit: int = 4) -> Column:
    """At most limit public reasons of a component array, the extra ones first."""
    said = []
    for name, label in LABELS:
        holds = has_component(parts, name)
        if name == "contains_expected_exception":
            holds = holds & ~has_component(parts, "raises_expected_exception")
        if label.endswith(": "):
            details = F.slice(dedupe_ignoring_case(F.flatten(F.transform(by_name(parts, name), lambda p: p["details"]))), 1, 3)
            said.append(F.when(F.size(details) > 0, F.concat(F.lit(label), F.array_join(details, ", "))))
        else:
            said.append(F.when(holds, F.lit(label)))
    said.append(F.when(from_traceback, F.lit("source chunk from traceback file")))
    every = dedupe_ignoring_case(F.transform(F.concat(extra, F.array_compact(F.array(*said))), public_reason))
    every = F.filter(every, lambda r: r != "")
    return F.when(F.size(every) > 0, F.slice(every, 1, limit)).otherwise(F.array(F.lit("semantic match")))


def with_reasons(rows: DataFrame, parts: str = "parts", extra: str = "extra", limit: int = 4) -> DataFrame:
    traced = is_traceback_source(F.col("path_key"), F.col("is_test"), traceback_files(F.col("traceback")))
    return rows.withColumn("reasons", reasons(F.col(parts), F.col(extra), traced, limit))


def full_name(name: Column, parent: Column) -> Column:
    return F.when(no_null(parent) != "", F.concat_ws(".", parent, name)).otherwise(name)


def _top_source(results: DataFrame) -> DataFrame:
    """The first result that is no test; the first of all if there is none."""
    order = Window.partitionBy("failure_id").orderBy(F.col("is_test"), F.when(F.col("kind") == "semantic", 0).otherwise(1), "rank")
    return results.withColumn("_t", F.row_number().over(order)).where("_t = 1").drop("_t")


def summaries(failures: DataFrame, results: DataFrame) -> DataFrame:
    """(failure_id, summary): six lines on each failure and its results(failure_id, kind, rank, name, parent, file_path,
    is_test, dependencies). A failure without results has a summary too."""
    c = F.col
    top = _top_source(results).select("failure_id", full_name(c("name"), c("parent")).alias("top_name"), F.translate("file_path", "\\", "/").alias("top_path"), c("dependencies").alias("top_deps"))
    named = results.withColumn("shown", full_name(c("name"), c("parent"))).groupBy("failure_id").agg(
        F.array_sort(F.collect_list(F.when(c("kind") == "related", F.struct("rank", "shown")))).alias("related"),
        F.collect_set("shown").alias("shown_names"), F.collect_set("name").alias("short_names"), F.max(F.size("dependencies") > 0).alias("any_deps"),
    )
    df = failures.join(top, "failure_id", "left").join(named, "failure_id", "left")
    test = strip(c("test_name"))
    short = F.when(test == "", F.lit("<unknown>")).otherwise(F.try_element_at(F.split(test, "::"), F.lit(-1)))
    error, message = strip(no_null(c("error_type"))), truncate_after(one_line(c("message")), 140)
    signal = F.when((error != "") & (message != ""), F.concat(error, F.lit(", "), message)).when(error != "", error).when(message != "", message).otherwise(F.lit("<none>"))
    related = F.slice(dedupe_ignoring_case(F.transform(F.coalesce("related", F.array().cast("array<struct<rank:int,shown:string>>")), lambda r: r["shown"])), 1, 5)
    names = F.concat("shown_names", "short_names")
    symbols = F.regexp_extract_all(F.concat_ws("\n", "test_name", "message", "traceback"), F.lit(r"\b([A-Za-z_]\w*)\b"), 1)
    why = (
        F.when(c("top_name").isNull(), "no retrieved chunks were available to explain.")
        .when(F.arrays_overlap(symbols, names), "failure/query symbols overlap with retrieved source/context chunks.")
        .when(F.arrays_overlap("top_deps", names), "the top source chunk depends on retrieved related context.")
        .when(c("any_deps"), "retrieved chunks share dependency names that provide nearby context.")
        .otherwise("semantic retrieval ranked these chunks closest to the failure details.")
    )
    text = F.concat_ws(
        "\n", F.lit("Diagnosis summary:"), F.concat(F.lit("- Failing test: "), short), F.concat(F.lit("- Failure signal: "), signal),
        F.concat(F.lit("- Most relevant source chunk: "), F.coalesce(F.concat(c("top_name"), F.lit(" in "), c("top_path")), F.lit("<none>"))),
        F.concat(F.lit("- Related context: "), F.when(F.size(related) > 0, F.array_join(related, ", ")).otherwise(F.lit("<none>"))), F.concat(F.lit("- Why: "), why),
    )
    return df.select("failure_id", text.alias("summary"))


def hypotheses(failures: DataFrame, results: DataFrame) -> DataFrame:
    """(failure_id, hypothesis): what may be wrong with the first result of source; null where no rule applies."""
    c = F.col
    source = _top_source(results.where("not is_test")).select("failure_id", "name", "parent", "source_code")
    df = failures.join(source, "failure_id", "left")
    shown, said = full_name(c("name"), c("parent")), F.lower("message")
    mismatch = (F.contains(said, F.lit("assert true is false")) | F.contains(said, F.lit("assert false is true"))) & c("name").rlike("(?i)^(validate|check|is_|has_|authorize)")
    wrong = c("message").rlike(r"(?i)\breturned\s+.+?\s+instead\s+of\s+.+")
    edge = F.lower(F.concat_ws(" ", "test_name", "message", "traceback")).rlike("expired|boundary|limit|threshold|edge") & c("source_code").rlike(r"(?<![=!<>])(?:<=|>=|<|>)(?!=)")
    rules = F.array_compact(F.array(
        F.when(mismatch, F.concat(shown, F.lit(" may contain boolean validation logic returning the opposite truth value from what the test expects."))),
        F.when(wrong, F.concat(shown, F.lit(" may compute an incorrect value."))),
        F.when(edge, F.lit("The retrieved source includes comparison logic and the failing test appears boundary-related.")),
    ))
    text = F.concat_ws("\n", F.lit("Possible issue:"), F.transform(rules, lambda r: F.concat(F.lit("- "), r)), F.lit("- This is a hypothesis based on the failure signal and retrieved code, not a proven root cause."))
    return df.select("failure_id", F.when(c("name").isNotNull() & (F.size(rules) > 0), text).alias("hypothesis"))
