"""Call-path context of failures: what the best chunks call, who calls them, and the counterparts of what they call.

Neighbourhoods are joins, candidate tests and scores are columns. The order-dependent choice of what to visit next runs per
failure over the rows of at most four seeds' neighbourhoods.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.paths import is_suffix_match, normalize_path
from fathom.functions.predicates import CRUD_NAME, bare_name, counterparts, last_part
from fathom.functions.text import has_any, identifier_tokens, no_null, pieces
from fathom.functions.vocabulary import words
from fathom.operators.failures import FILE_LINE, LOCATION
from fathom.operators.graph import best_per_key, first_per_group
from fathom.operators.scoring import pair_evidence
from fathom.sources.tables import settle

# Limits of the search, and roles as it sees them.
SEEDS, PER_SOURCE, CALLERS, REVERSE_LIMIT, COUNTERPART_LIMIT, LIMIT = 4, 6, 3, 6, 4, 10
CALLER_ROLES = words("api controller endpoint handler interactor route routes service usecase view")
ACCESS_ROLES = words("dao data database db queries repository storage store")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("path_key"), F.col("start_line"), F.col("chunk_id")]


def call_features(chunks: DataFrame) -> DataFrame:
    """Chunk features with the roles that a call path asks for."""
    path = pieces(F.regexp_replace("path_key", "/", "_"))
    return chunks.withColumn("caller_role", has_any(F.concat(path, F.col("tokens")), CALLER_ROLES)).withColumn("access_role", has_any(F.concat(path, F.col("parent_terms")), ACCESS_ROLES) & bare_name(F.col("name")).rlike(CRUD_NAME))


def traceback_files(traceback: Column) -> Column:
    found = F.concat(F.regexp_extract_all(no_null(traceback), F.lit(FILE_LINE), 1), F.regexp_extract_all(no_null(traceback), F.lit(LOCATION), 1))
    return F.array_distinct(F.transform(found, normalize_path))


def is_traceback_source(path_key: Column, is_test: Column, files: Column) -> Column:
    return ~is_test & F.exists(files, lambda h: is_suffix_match(h, path_key))


def is_reverse_seed() -> Column:
    c = F.col
    return c("x_evidence") | F.when(c("did_not_raise"), c("guard_name") & (F.size("x_relevant") > 0)).otherwise(c("guard_name"))


def _pairs(rows: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (failure_id, chunk_id, ...) with all features and evidence."""
    return pair_evidence(rows.join(failures, "failure_id").join(chunks, "chunk_id")).where(~F.col("is_test"))


def _forward(seeds: DataFrame, edges: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    c = F.col
    step = edges.select(c("src").alias("source"), "dep_ord", "matched_name", c("dst").alias("chunk_id"))
    hop1 = seeds.select("failure_id", c("chunk_id").alias("source")).join(step, "source")
    hop2 = hop1.select("failure_id", c("chunk_id").alias("source")).distinct().join(step, "source")
    rows = hop1.unionByName(hop2).distinct()
    places = chunks.select(c("chunk_id").alias("source"), c("path_key").alias("s_path"), c("is_test").alias("s_test"))
    df = _pairs(rows, failures, chunks).join(places, "source")
    calm = ~c("did_not_raise")
    signal = c("x_evidence") | c("guard_name") | c("calls_guard") | c("validation_text")
    fits = F.when(c("did_not_raise"), c("x_evidence") | (c("guard_name") & (F.size("x_relevant") > 0)) | c("x_guard_call")).otherwise(signal)
    first = fits | (calm & c("is_function") & F.arrays_overlap("tokens", F.concat("operation", "behavioral")))
    lone = c("defines_pair") & (F.size("called_pairs") == 0) & ~c("caller_role") & c("pair_words")
    own = (
        F.when(c("x_defines"), 2.4).otherwise(0.0) + F.when(c("x_raises"), 2.0).when(c("x_in_source"), 1.2).otherwise(0.0) + F.when(c("guard_name"), 0.9).otherwise(0.0) + F.when(c("calls_guard"), 0.5).otherwise(0.0)
        + F.when(c("is_function"), 0.2).when((c("chunk_type") == "class") & ~c("x_defines"), -1.0).otherwise(0.0) - F.when(calm & c("access_role"), 1.4).otherwise(0.0) - F.when(calm & lone, 1.4).otherwise(0.0)
    )
    told = F.array_compact(F.array(F.when(c("guard_name"), F.lit("validation helper on call path")), F.when(c("x_evidence"), F.lit("exception logic on call path")), F.when(c("calls_guard"), F.lit("calls validation helper"))))
    traced = is_traceback_source(c("s_path"), c("s_test"), traceback_files(c("traceback")))
    cand = df.select("failure_id", "source", "dep_ord", "matched_name", "chunk_id", "path_key", "start_line", first.alias("at_first"), fits.alias("later"), own.alias("own"), (c("did_not_raise") & ~c("x_strong")).alias("limited"), told.alias("told"), traced.alias("traced"), F.lit(None).cast("int").alias("seed_rank"), F.lit(None).cast("double").alias("seed_score"))
    start = seeds.select("failure_id", c("chunk_id").alias("source"), F.lit(None).cast("int").alias("dep_ord"), F.lit(None).cast("string").alias("matched_name"), "chunk_id", "path_key", "start_line", F.lit(True).alias("at_first"), F.lit(True).alias("later"), F.lit(0.0).alias("own"), F.lit(False).alias("limited"), F.array().cast("array<string>").alias("told"), F.lit(False).alias("traced"), c("seed_rank"), c("score").alias("seed_score"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        begin = rows[rows["seed_rank"].notna()].sort_values("seed_rank")
        calls = {s: g.sort_values(["dep_ord", "chunk_id"]) for s, g in rows[rows["seed_rank"].isna()].groupby("source")}
        visited, top = set(begin["chunk_id"]), begin["chunk_id"].iloc[0] if len(begin) else ""
        out = []
        for _, seed in begin.iterrows():
            frontier = [(seed["chunk_id"], float(seed["seed_score"]))]
            for depth in (1, 2):
                after = []
                for source, score in frontier:
                    found = []
                    for r in calls[source].itertuples() if source in calls else ():
                        if r.chunk_id in visited or not (r.at_first if depth == 1 else r.later):
                            continue
                        reasons = ["called by traceback source"] * bool(r.traced) + ["called by top source chunk"] * (source == top) + list(r.told)
                        value = max((min(score, 0.5) if r.limited else score) - 0.25 * depth, 0.0) + max(0.2, 0.9 - 0.2 * (depth - 1)) + r.own + 0.4 * bool(r.traced) + 0.2 * (source == top)
                        found.append((-max(value, 0.0), r.path_key, r.start_line, r.chunk_id, reasons or [f"called via {r.matched_name}"]))
                    for value, path, line, node, reasons in sorted(found, key=lambda x: x[:4])[:PER_SOURCE]:
                        visited.add(node)
                        out.append((seed["failure_id"], node, -value, reasons))
                        after.append((node, -value))
                if not after:
                    break
                frontier = after
        return pd.DataFrame(out, columns=["failure_id", "chunk_id", "score", "reasons"])

    kind = seeds.schema["failure_id"].dataType.simpleString()
    return start.unionByName(cand).groupBy("failure_id").applyInPandas(walk, f"failure_id {kind}, chunk_id string, score double, reasons array<string>")


def _callers(targets: DataFrame, edges: DataFrame, failures: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
    """Scored callers of targets(failure_id, seed, target, t_score, t_guard, t_raises, t_evidence, t_strong, place)."""
    c = F.col
    rows = targets.join(edges.select(c("dst").alias("target"), "matched_name", c("src").alias("chunk_id")).distinct(), "target").where(c("chunk_id") != c("target"))
    df = _pairs(rows, failures, chunks).where(c("is_function"))
    touches = F.arrays_overlap("tokens", "signal_words")
    near = F.lit(depth == 1) | touches | c("caller_role")
    df = df.where(c("x_guard_call") | (c("calls_guard") & near) | (c("t_strong") & (touches | c("caller_role"))))
    score = (
        F.greatest(F.least(c("t_score"), F.lit(2.0)) - 0.45 * depth, F.lit(0.0)) + F.when(c("x_guard_call"), 0.8).when(c("calls_guard"), 0.35).otherwise(0.0) + F.when(c("x_raises"), 1.2).when(c("x_in_source"), 0.6).otherwise(0.0) + F.when(c("guard_name"), 0.2).otherwise(0.0)
        + F.least(F.lit(0.3), F.size(F.array_intersect("behavioral", "tokens")) * 0.10) + F.least(F.lit(0.25), F.size(F.array_intersect("operation", "tokens")) * 0.08) + F.when(c("caller_role"), 0.2).otherwise(0.0)
        + F.when(c("t_strong"), 0.15).otherwise(0.0) + F.when(c("t_evidence"), 0.1).otherwise(0.0) + F.when(c("t_guard") | c("t_raises"), 0.1).otherwise(0.0)
    )
    score = F.least(score, F.greatest(c("t_score") - 0.1, F.lit(0.0)), F.when(c("x_evidence"), 3.0).otherwise(2.4))
    said = F.array_compact(F.array(F.lit("reverse call-path context"), F.when(c("t_guard") | c("t_raises"), F.lit("caller of validation helper")), F.when(c("t_evidence"), F.lit("caller of expected-exception logic")), F.when(c("calls_guard"), F.lit("calls validation helper")), F.when(c("caller_role") & ~c("guard_name") & ~c("x_raises"), F.lit("business caller context"))))
    reasons = F.when(F.size(said) == 1, F.concat(said, F.array(F.concat(F.lit("called via "), c("matched_name"))))).otherwise(said)
    return df.select("failure_id", "seed", "target", "place", "matched_name", "chunk_id", "path_key", "start_line", score.alias("score"), reasons.alias("reasons"), is_reverse_seed().alias("leads_on"), c("guard_name").alias("t_guard"), c("x_raises").alias("t_raises"), c("x_evidence").alias("t_evidence"), c("x_strong").alias("t_strong"))


def _reverse(seeds: DataFrame, edges: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    """Callers up to two steps away. The first step's choice is a window; the second's needs the order of its targets, for
    which the nine best callers of each suffice: targets before can take at most six of them."""
    c = F.col
    order = [*_order(), c("matched_name")]
    near = settle(first_per_group(_callers(seeds, edges, failures, chunks, 1), ("failure_id", "seed"), CALLERS, *order), "callers")
    next_ = best_per_key(near.where("leads_on").withColumn("place", F.row_number().over(Window.partitionBy("failure_id", "seed").orderBy(*order))), ("failure_id", "seed", "chunk_id"), c("place"))
    targets = next_.select("failure_id", "seed", c("chunk_id").alias("target"), c("score").alias("t_score"), "t_guard", "t_raises", "t_evidence", "t_strong", "place")
    far = _callers(targets, edges, failures, chunks, 2).where(c("chunk_id") != c("seed")).join(near.select("failure_id", "seed", "chunk_id"), ["failure_id", "seed", "chunk_id"], "left_anti")
    far = first_per_group(far, ("failure_id", "seed", "target"), 3 * CALLERS, *order)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        visited, out = set(), []
        rows = rows.assign(down=-rows["score"]).sort_values(["place", "down", "path_key", "start_line", "chunk_id", "matched_name"])
        for _, group in rows.groupby("place", sort=True):
            free = group[~group["chunk_id"].isin(visited)].head(CALLERS)
            visited |= set(free["chunk_id"])
            out.append(free)
        return pd.concat(out)[["failure_id", "chunk_id", "path_key", "start_line", "score", "reasons"]]

    kind = seeds.schema["failure_id"].dataType.simpleString()
    far = far.groupBy("failure_id", "seed").applyInPandas(choose, f"failure_id {kind}, chunk_id string, path_key string, start_line int, score double, reasons array<string>")
    both = near.select("failure_id", "chunk_id", "path_key", "start_line", "score", "reasons").unionByName(far)
    best = best_per_key(both, ("failure_id", "chunk_id"), c("score").desc(), c("reasons"))
    return first_per_group(best, ("failure_id",), REVERSE_LIMIT, *_order()).select("failure_id", "chunk_id", "score", "reasons")


def counterpart_context(seeds: DataFrame, seen: DataFrame, edges: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    """Functions that undo what a seed calls, in the class or file, of one repository, of what it calls."""
    c = F.col
    df = _pairs(seeds.select("failure_id", "chunk_id", c("score").alias("seed_score")), failures, chunks)
    df = df.where(c("is_function") & c("pair_context") & (F.size("called_pairs") > 0)).withColumn("other", counterparts(c("called_pairs")))
    terms = F.concat("signal_words", "primary_terms")
    df = df.where(F.arrays_overlap(F.concat("called_pairs", "other"), terms) | F.arrays_overlap("name_terms", F.array_intersect("primary_terms", "signal_words")))
    source = df.select("failure_id", "seed_score", c("chunk_id").alias("source"), "called_pairs", "other")
    sides = chunks.where("defines_pair").select(c("chunk_id").alias("side"), c("name_terms").alias("side_terms"), "repo", c("parent").alias("side_parent"), c("path_key").alias("side_path"))
    called = source.join(edges.select(c("src").alias("source"), "matched_name", c("dst").alias("side")), "source").join(sides, "side")
    called = called.where(F.arrays_overlap("called_pairs", F.concat("side_terms", identifier_tokens(last_part(c("matched_name")))))).select("failure_id", "seed_score", "source", "other", "side", "repo", "side_parent", "side_path").distinct()
    cand = chunks.where("is_function and not is_test and defines_pair").select("chunk_id", c("repo").alias("of"), "parent", "path_key", "name", "start_line")
    within = c("of").eqNullSafe(c("repo"))  # names and paths say nothing across repositories
    same_class = called.join(cand, within & (c("parent") == c("side_parent")) & (c("parent") != ""))
    same_file = called.join(cand, within & (c("path_key") == c("side_path")))
    found = same_class.unionByName(same_file).where((c("chunk_id") != c("side")) & F.exists("other", lambda t: F.startswith(bare_name(c("name")), t)))
    found = found.join(seen, ["failure_id", "chunk_id"], "left_anti")
    score = F.least(F.greatest(c("seed_score") - 0.15, F.lit(0.0)) + 0.1, F.greatest(c("seed_score") - 0.05, F.lit(0.0)))
    best = best_per_key(found.withColumn("score", score), ("failure_id", "chunk_id"), c("score").desc())
    reasons = F.array(F.lit("paired state operation"), F.lit("possible missing counterpart operation"))
    return first_per_group(best, ("failure_id",), COUNTERPART_LIMIT, *_order()).select("failure_id", "chunk_id", "score", reasons.alias("reasons"))


def call_path_context(ranked: DataFrame, edges: DataFrame, failures: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(failure_id, chunk_id, score, reasons): at most limit chunks beside the ranked ones.

    ranked(failure_id, chunk_id, score, rank) is the reranked pool, failures have signals, chunks have call_features under
    chunk_id. Seeds are the first four functions of source; callers are looked for where an exception is expected.
    """
    c = F.col
    pool = settle(_pairs(ranked.select("failure_id", "chunk_id", "score", "rank"), failures, chunks).select("failure_id", "chunk_id", "score", "rank", "path_key", "start_line", "is_function", "did_not_raise", "expected", "x_evidence", "x_relevant", "x_raises", "x_strong", "guard_name"), "pool")
    fwd = first_per_group(pool.where("is_function"), ("failure_id",), SEEDS, c("rank"))
    fwd = fwd.select("failure_id", "chunk_id", "score", "path_key", "start_line", c("rank").alias("seed_rank"))
    back = first_per_group(pool.where((c("did_not_raise") | (F.size("expected") > 0)) & is_reverse_seed()), ("failure_id",), SEEDS, c("rank"))
    back = back.select("failure_id", c("chunk_id").alias("seed"), c("chunk_id").alias("target"), c("score").alias("t_score"), c("guard_name").alias("t_guard"), c("x_raises").alias("t_raises"), c("x_evidence").alias("t_evidence"), c("x_strong").alias("t_strong"), F.lit(1).alias("place"))
    found = settle(_forward(fwd, edges, failures, chunks).unionByName(_reverse(back, edges, failures, chunks)), "paths")
    seen = found.select("failure_id", "chunk_id").unionByName(fwd.select("failure_id", "chunk_id")).distinct()
    every = found.unionByName(counterpart_context(fwd, seen, edges, failures, chunks))
    best = best_per_key(every, ("failure_id", "chunk_id"), c("score").desc(), c("reasons"))
    best = best.join(chunks.select("chunk_id", "path_key", "start_line"), "chunk_id")
    return first_per_group(best, ("failure_id",), limit, *_order()).select("failure_id", "chunk_id", "score", "reasons")
