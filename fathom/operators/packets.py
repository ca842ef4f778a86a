"""Bounded, redacted context packets: what fits into a budget is the longest prefix whose running size fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import display_name, no_null, redact, strip, truncate_code, truncate_text

# Limits of a packet.
PER_KIND, MAX_MESSAGE, MAX_QUERY, MAX_CODE, MAX_LINES, MAX_DEPENDENCIES, MAX_REASONS, MAX_TOTAL = 5, 1200, 1200, 3000, 80, 12, 6, 12_000


def first_per_kind(rows: DataFrame, group: str, kind: str = "kind", rank: str = "rank", n: int = PER_KIND) -> DataFrame:
    """The first n rows of each kind within the group."""
    w = Window.partitionBy(group, kind).orderBy(rank)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fit_budget(rows: DataFrame, group: str, size: str, order: tuple[str | Column, ...], cap: int, fixed: str | Column | int = 0) -> DataFrame:
    """The longest prefix of each group whose sizes and the fixed one add up to at most cap; null sizes count as 0."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.lit(fixed) if isinstance(fixed, int) else F.col(fixed) if isinstance(fixed, str) else fixed
    return rows.withColumn("running", F.sum(F.coalesce(F.col(size), F.lit(0))).over(w)).where(F.col("running") + base <= cap)


def chunk_packets(rows: DataFrame, group: str) -> DataFrame:
    """Chunk contexts of results(group, kind, rank, chunk_id, chunk_type, name, parent, file_path, start_line, end_line,
    score, reasons, dependencies, source_code): redacted, cut, at most five of a kind, with their size."""
    c = F.col
    kept = first_per_kind(rows, group)
    out = kept.select(
        group, "kind", "rank", "chunk_id", c("kind").alias("source_label"), "chunk_type", display_name(c("name"), c("parent"), c("chunk_type")).alias("name"), F.translate("file_path", "\\", "/").alias("file_path"), "start_line", "end_line", "score",
        F.slice(F.transform("reasons", redact), 1, MAX_REASONS).alias("reasons"), F.slice(F.transform("dependencies", redact), 1, MAX_DEPENDENCIES).alias("dependencies"), truncate_code(c("source_code"), MAX_CODE, MAX_LINES).alias("code_snippet"),
    )
    size = F.length(no_null(c("code_snippet"))) + F.length("name") + F.length("file_path") + F.length("chunk_type") + F.length("source_label")
    size = size + F.aggregate("reasons", F.lit(0), lambda a, r: a + F.length(r)) + F.aggregate("dependencies", F.lit(0), lambda a, d: a + F.length(d))
    return out.withColumn("size", size)


def diagnosis_packets(failures: DataFrame, results: DataFrame, cap: int = MAX_TOTAL) -> DataFrame:
    """(failure_id, failure, chunks): each failure's redacted facts and the chunks that fit beside them."""
    c = F.col
    facts = failures.select("failure_id", redact(c("test_name")).alias("test_name"), "file_path", "line_number", "error_type", truncate_text(redact(strip(c("message"))), MAX_MESSAGE).alias("message"), truncate_text(redact(strip(c("traceback"))), MAX_MESSAGE).alias("traceback"))
    fixed = sum((F.length(no_null(c(x))) for x in ("test_name", "file_path", "error_type", "message", "traceback")), F.lit(0))
    facts = facts.withColumn("fixed", fixed)
    chunks = chunk_packets(results, "failure_id").join(facts.select("failure_id", "fixed"), "failure_id")
    first = F.when(c("kind") == "semantic", 0).otherwise(1)
    kept = fit_budget(chunks, "failure_id", "size", (first, "rank"), cap, "fixed")
    listed = kept.groupBy("failure_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("order"), "rank", "source_label", "name", "chunk_type", "file_path", "start_line", "end_line", "score", "reasons", "dependencies", "code_snippet"))).alias("chunks"))
    facts = facts.join(listed, "failure_id", "left")
    return facts.select("failure_id", F.struct("test_name", "file_path", "line_number", "error_type", "message", "traceback").alias("failure"), "chunks")


def investigation_packets(queries: DataFrame, results: DataFrame, cap: int = MAX_TOTAL) -> DataFrame:
    """(query_id, query, chunks) of queries(query_id, query): related chunks go first when the budget is short."""
    c = F.col
    facts = queries.select("query_id", truncate_text(redact(c("query")), MAX_QUERY).alias("query"))
    chunks = chunk_packets(results, "query_id").join(facts.select("query_id", F.length("query").alias("fixed")), "query_id")
    first = F.when(c("kind") == "semantic", 0).otherwise(1)
    kept = fit_budget(chunks, "query_id", "size", (first, "rank"), cap, "fixed")
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("order"), "rank", "source_label", "name", "chunk_type", "file_path", "start_line", "end_line", "score", "reasons", "dependencies", "code_snippet"))).alias("chunks"))
    return facts.join(listed, "query_id", "left")


def chunk_section(x: Column) -> Column:
    """The text of one chunk context."""
    row = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    place = F.concat(x["file_path"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), F.coalesce(x["end_line"].cast("string"), F.lit("?")))
    return F.concat_ws("\n", F.concat(F.lit("### "), x["name"], F.lit(" ("), x["source_label"], F.lit(")")), row("Type", x["chunk_type"]), row("Location", place), row("Reasons", F.array_join(x["reasons"], "; ")), row("Dependencies", F.array_join(x["dependencies"], ", ")), F.lit("```python"), no_null(x["code_snippet"]), F.lit("```"))


def diagnosis_prompts(packets: DataFrame) -> DataFrame:
    """(failure_id, prompt): instructions, the failure, its chunks and the format of the answer."""
    f = F.col("failure")
    failure = F.concat_ws("\n", F.lit("## Failure"), F.concat(F.lit("Test: "), f["test_name"]), F.concat(F.lit("Error: "), no_null(f["error_type"])), F.concat(F.lit("Message: "), f["message"]), F.lit("Traceback:"), f["traceback"])
    chunks = F.when(F.size("chunks") > 0, F.array_join(F.transform("chunks", chunk_section), "\n\n")).otherwise(F.lit("No code was retrieved."))
    text = F.concat_ws("\n\n", F.lit("Explain the failing test from the evidence below. Name only code that is shown, and say when the evidence is thin."), failure, F.lit("## Code"), chunks, F.lit("## Answer\nLikely cause\nEvidence\nNext step"))
    return packets.select("failure_id", text.alias("prompt"))


def investigation_prompts(packets: DataFrame) -> DataFrame:
    """(query_id, prompt) of investigation packets."""
    chunks = F.when(F.size("chunks") > 0, F.array_join(F.transform("chunks", chunk_section), "\n\n")).otherwise(F.lit("No code was retrieved."))
    text = F.concat_ws("\n\n", F.lit("Say where the described behaviour is likely to come from. Name only code that is shown."), F.concat(F.lit("## Description\n"), no_null(F.col("query"))), F.lit("## Code"), chunks, F.lit("## Answer\nPlaces to inspect\nWhy\nNext step"))
    return packets.select("query_id", text.alias("prompt"))
