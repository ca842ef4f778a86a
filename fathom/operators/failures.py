"""Failing tests: what logs say of them, the signals in their text, and the query they make."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathom.functions import vocabulary as V
from fathom.functions.paths import is_test_path, normalize_path
from fathom.functions.predicates import CALL, mentions_test_infrastructure
from fathom.functions.text import dedupe_ignoring_case, domain_words, identifier_tokens, lines, literal_array, no_null, one_line, rstrip, select_terms, strip, tokens_with_variants, truncate_after, truncate_text
from fathom.operators.graph import best_per_key

FILE_LINE = r"File\s+[\"']([^\"']+?\.py)[\"'],\s+line\s+(\d+)(?:,\s+in\s+([A-Za-z_]\w*))?"
LOCATION = r"(\S+?\.py):(\d+):"
IN_FUNCTION = r"\bin\s+([A-Za-z_]\w*)\b"
NOT_RAISED = r"(?i)DID NOT RAISE\s+<class\s+'([^']+)'>"
MAX_SYMBOLS, MAX_HINTS = 12, 10


def _or_null(value: Column) -> Column:
    return F.when(value != "", value)


def traceback_hints(traceback: Column) -> tuple[Column, Column]:
    """(symbols, hints) of a traceback in order of appearance: function names, and path:line places. Empty for null."""
    rows = F.transform(F.when(no_null(traceback) == "", F.array().cast("array<string>")).otherwise(lines(no_null(traceback))), strip)
    at = lambda p, n: (lambda x: F.regexp_extract(x, p, n))
    place = lambda p, x: F.when(x.rlike(p), F.concat(strip(at(p, 1)(x)), F.lit(":"), F.regexp_replace(at(p, 2)(x), r"^0+(?=\d)", "")))
    hints = F.flatten(F.transform(rows, lambda x: F.array_compact(F.array(place(FILE_LINE, x), place(LOCATION, x)))))
    keys = F.transform(hints, lambda h: F.lower(F.translate(h, "\\", "/")))
    hints = F.filter(hints, lambda h, i: F.array_position(keys, F.lower(F.translate(h, "\\", "/"))) == i + 1)
    names = F.flatten(F.transform(rows, lambda x: F.concat(F.array_compact(F.array(_or_null(at(FILE_LINE, 3)(x)), _or_null(at(IN_FUNCTION, 1)(x)))), F.regexp_extract_all(x, F.lit(CALL), 1))))
    names = F.filter(names, lambda n: ~F.lower(n).isin(*V.NOISY_SYMBOLS))
    return F.slice(dedupe_ignoring_case(names), 1, MAX_SYMBOLS), F.slice(hints, 1, MAX_HINTS)


def message_symbols(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(no_null(message), F.lit(CALL), 1))


def hint_path(hint: Column) -> Column:
    """The normal path of a path:line hint; empty for anything else."""
    return normalize_path(F.regexp_extract(strip(hint), r"^(.+?\.py)(?::\d+)?$", 1))


def expected_exceptions(text: Column) -> Column:
    """Short and qualified names of exceptions that were expected and not raised."""
    found = F.transform(F.regexp_extract_all(no_null(text), F.lit(NOT_RAISED), 1), strip)
    return dedupe_ignoring_case(F.flatten(F.transform(found, lambda q: F.array(F.try_element_at(F.split(q, r"\."), F.lit(-1)), q))))


def with_signals(failures: DataFrame) -> DataFrame:
    """Failures(failure_id, test_name, file_path, error_type, message, traceback) with everything that rankings ask of them.

    Nulls count as empty texts. Further columns are kept.
    """
    c = F.col
    df = failures
    for name in ("test_name", "file_path", "message", "traceback"):
        df = df.withColumn(name, no_null(c(name)))
    text = F.concat_ws("\n", "test_name", no_null(c("error_type")), "message", "traceback")
    df = df.withColumn("f_text", text).withColumn("f_tokens", tokens_with_variants(c("f_text")))
    df = df.withColumn("did_not_raise", c("f_text").rlike(NOT_RAISED)).withColumn("expected", expected_exceptions(c("f_text")))
    df = df.withColumn("expected_short", F.array_distinct(F.transform("expected", lambda e: F.try_element_at(F.split(e, r"\."), F.lit(-1)))))
    df = df.withColumn("exception_symbols", F.array_distinct(F.flatten(F.transform("expected", tokens_with_variants))))
    df = df.withColumn("exception_terms", F.array_except(F.array_distinct(F.flatten(F.transform("expected_short", identifier_tokens))), literal_array(("error", "exception", "invalid"))))
    df = df.withColumn("behavioral", select_terms(c("f_tokens"), V.BEHAVIORAL_WORDS)).withColumn("operation", select_terms(c("f_tokens"), V.OPERATION_WORDS)).withColumn("domain", domain_words(c("f_tokens")))
    df = df.withColumn("primary_terms", identifier_tokens(F.concat_ws("\n", "test_name", "file_path", no_null(c("error_type")), "message")))
    symbols, hints = traceback_hints(c("traceback"))
    df = df.withColumn("trace_symbols", symbols).withColumn("source_hints", hints).withColumn("message_symbols", message_symbols(c("message")))
    signal_words = F.array_distinct(F.concat("operation", "behavioral", "domain"))
    df = df.withColumn("signal_words", signal_words).withColumn("meaningful", F.array_except(F.array_distinct(F.concat("primary_terms", "signal_words")), literal_array(V.MEANINGLESS_FAILURE_WORDS)))
    action = F.array_distinct(F.concat("operation", "behavioral", literal_array(V.FILTERING_WORDS), literal_array(V.STATE_UPDATE_WORDS)))
    df = df.withColumn("action_terms", F.array_intersect("primary_terms", action)).withColumn("business_context", F.arrays_overlap("meaningful", action))
    states = literal_array(dict.fromkeys(V.PAIRED_WORDS + V.STATE_CONTEXT_WORDS + V.STATE_CHANGE_WORDS))
    df = df.withColumn("pair_context", ~c("did_not_raise") & F.arrays_overlap(F.concat("signal_words", "primary_terms"), states)).withColumn("pair_words", F.arrays_overlap(c("signal_words"), states))
    df = df.withColumn("infra_failure", mentions_test_infrastructure(F.concat_ws(" ", "test_name", no_null(c("error_type")), "message", "traceback")))
    files = F.array_distinct(F.filter(F.transform("source_hints", hint_path), lambda p: (p != "") & ~is_test_path(p)))
    df = df.withColumn("hint_files", files).withColumn("hint_folders", F.array_sort(F.array_distinct(F.filter(F.transform("hint_files", lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)), lambda p: p != ""))))
    return df


def failure_query(failures: DataFrame) -> Column:
    """The search text of a failure with signals: test, error, message, symbols, places and the end of the traceback."""
    c = F.col
    or_else = lambda value, other: F.when(value == "", F.lit(other)).otherwise(value)
    listed = lambda values: F.when(F.size(values) > 0, F.array_join(values, "\n")).otherwise(F.lit("<none>"))
    path = strip(c("file_path"))
    place = F.when(path == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(path, F.when(c("line_number").isNotNull(), F.concat(F.lit(":"), c("line_number").cast("string"))).otherwise(F.lit("")))))
    rows = F.filter(F.transform(lines(c("traceback")), rstrip), lambda x: (strip(x) != "") & ~strip(x).rlike(FILE_LINE) & ~strip(x).rlike(LOCATION))
    tail = F.slice(rows, F.greatest(F.size(rows) - 13, F.lit(1)), 14)
    excerpt = truncate_after(F.array_join(tail, "\n"), 800)
    parts = F.concat_ws("\n", F.lit("Test:"), or_else(strip(c("test_name")), "<unknown>"), F.lit("\nError:"), or_else(strip(no_null(c("error_type"))), "<unknown>"), F.lit("\nMessage:"), or_else(truncate_after(strip(c("message")), 400), "<none>"), F.lit("\nTraceback symbols:"), listed(c("trace_symbols")), F.lit("\nSource hints:"), listed(dedupe_ignoring_case(F.concat(place, c("source_hints")))))
    return F.concat(F.when((c("traceback") == "") | (excerpt == ""), parts).otherwise(F.concat_ws("\n", parts, F.lit("\nTraceback excerpt:"), excerpt)), F.lit("\n"))


# logs

HEADER = r"^_(?=.{8,}$).*[^_\s].*_$"
SEPARATOR = r"^=.{8,}=$"


def summary_entries(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, outcome, nodeid, message) of the FAILED and ERROR lines of logs(log_id, line_no, line), each once."""
    line = strip(F.col("line"))
    rows = logs.where(line.rlike(r"^(FAILED|ERROR) ")).select("log_id", "line_no", F.regexp_extract(line, r"^(\w+) ", 1).alias("outcome"), strip(F.regexp_replace(line, r"^\w+ ", "")).alias("rest"))
    cut = F.locate(" - ", F.col("rest"))
    rows = rows.select("log_id", "line_no", "outcome", strip(F.when(cut > 0, F.substring(F.col("rest"), F.lit(1), cut - 1)).otherwise(F.col("rest"))).alias("nodeid"), strip(F.when(cut > 0, F.substring(F.col("rest"), cut + 3, F.length("rest"))).otherwise(F.lit(""))).alias("message"))
    return best_per_key(rows.where("nodeid <> ''"), ("log_id", "outcome", "nodeid"), F.col("line_no"))


def locations(logs: DataFrame) -> DataFrame:
    """(log_id, at, path, line_number, error_type) of lines that end in path:line: error."""
    line = strip(F.col("line"))
    pattern = r"^(.*?):\s*(\d+)\s*:([^:]*)$"
    rest = strip(F.regexp_extract(line, pattern, 3))
    return logs.where(line.rlike(pattern) & (rest != "")).select("log_id", F.col("line_no").alias("at"), normalize_path(strip(F.regexp_extract(line, pattern, 1))).alias("path"), F.regexp_extract(line, pattern, 2).cast("int").alias("line_number"), F.try_element_at(F.split(rest, r"\s+"), F.lit(1)).alias("error_type")).where("path <> ''")


def parse_logs(logs: DataFrame) -> DataFrame:
    """Failures of test logs(log_id, line_no, line): (log_id, test_name, file_path, line_number, error_type, message, traceback).

    A failure's place is the first one that names its file, so that two failures of a file share it. The traceback runs from
    the header with the test's name before that place to the next header or separator; without a place it is the whole log.
    Logs without a summary line give no rows. Null lines count as empty; rows of one log must differ in line_no.
    """
    c = F.col
    logs = logs.select("log_id", "line_no", no_null(c("line")).alias("line"))
    entries = summary_entries(logs).withColumn("file_path", F.try_element_at(F.split("nodeid", "::"), F.lit(1))).withColumn("target", normalize_path(c("file_path")))
    entries = entries.withColumn("shown", F.regexp_replace(F.try_element_at(F.split("nodeid", "::"), F.lit(-1)), r"\[.*$", ""))
    places = entries.join(locations(logs), "log_id").where((c("path") == c("target")) | F.endswith("path", F.concat(F.lit("/"), c("target"))))
    places = best_per_key(places, ("log_id", "outcome", "nodeid"), c("at")).select("log_id", "outcome", "nodeid", "at", "line_number", "error_type")
    entries = entries.join(places, ["log_id", "outcome", "nodeid"], "left")
    line = strip(c("line"))
    marks = logs.select("log_id", c("line_no").alias("mark"), line.rlike(HEADER).alias("head"), line.alias("mark_text")).where(c("head") | c("mark_text").rlike(SEPARATOR))
    spans = entries.join(marks, "log_id", "left").groupBy("log_id", "outcome", "nodeid").agg(
        F.max(F.when(c("head") & (c("mark") <= c("at")) & F.contains("mark_text", c("shown")), c("mark"))).alias("head_at"),
        F.min(F.when(c("mark") > c("at"), c("mark"))).alias("stop"),
    )
    entries = entries.join(spans, ["log_id", "outcome", "nodeid"])
    entries = entries.withColumn("start", F.when(c("at").isNull(), F.lit(-1)).otherwise(F.coalesce("head_at", "at")))
    rows = logs.select("log_id", c("line_no").alias("n"), c("line").alias("t"))
    body = entries.join(rows, "log_id").where((c("n") >= c("start")) & (c("stop").isNull() | c("at").isNull() | (c("n") < c("stop"))))
    body = body.groupBy("log_id", "outcome", "nodeid").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("rows"))
    body = body.withColumn("traceback", strip(F.array_join(F.transform("rows", lambda r: r["t"]), "\n"))).drop("rows")
    out = entries.join(body, ["log_id", "outcome", "nodeid"])
    extracted = error_message(c("traceback"), c("error_type"))
    message = F.when(c("error_type") == "AssertionError", F.when(extracted != "", extracted).otherwise(c("message"))).otherwise(F.when(c("message") == "", extracted).otherwise(c("message")))
    return out.select("log_id", "line_no", c("nodeid").alias("test_name"), "file_path", "line_number", "error_type", message.alias("message"), "traceback")


WHERE = re.compile(r"\+\s*where\s+(.+?)\s*=\s*(.+)$")
EQUALS = re.compile(r"assert\s+(.+?)\s*==\s*(.+)$")


def _said(traceback: str, error_type: str | None) -> str:
    """The line of a traceback that says best what went wrong."""
    told, where, asserted = [], {}, ""
    for row in (x.strip() for x in traceback.splitlines()):
        if re.match(HEADER, row) or re.match(SEPARATOR, row):
            continue
        if row.startswith(">") and "assert " in row:
            asserted = asserted or "assert " + row.split("assert ", 1)[1].strip()
        if row.startswith("E") and (text := row[1:].strip()):
            told.append(text)
    if error_type != "AssertionError":
        return told[0] if told else ""
    first = told[0] if told else ""
    plain = []
    for text in told:
        m = WHERE.match(text)
        if m:
            where[m[1].strip()] = m[2].strip()
        elif text not in ("+", "-", "?", "|"):
            plain.append(text)
    ranks = (lambda t: t.startswith("AssertionError:") and "assert " in t, lambda t: t.startswith("assert "), lambda t: t.startswith("AssertionError:"), lambda t: True)
    best = next((t for fits in ranks for t in plain if fits(t)), asserted)
    if not best:
        return first
    best = best.removeprefix("AssertionError:").strip() or best
    m = EQUALS.match(best)
    if m and "(" in where.get(m[1].strip(), ""):
        best = f"{where[m[1].strip()]} returned {m[1].strip()} instead of {m[2].strip()}"
    return best


@F.pandas_udf(StringType())
def _error_message(traceback: pd.Series, error_type: pd.Series) -> pd.Series:
    return pd.Series([_said(t or "", e) for t, e in zip(traceback, error_type)])


def error_message(traceback: Column, error_type: Column) -> Column:
    return truncate_text(one_line(_error_message(traceback, error_type)), 220)
