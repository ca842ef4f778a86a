"""python -m fathom.cli VERB: scan, index, chunks, search, investigate, test, diagnose, benchmark."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import subprocess
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import evaluate, failures
from fathom.plans import api
from fathom.sources.extract import extract_chunks, scan
from fathom.sources.index import Index
from fathom.sources.tables import settle

FOLDER = ".fathom"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathom", description="Which code should I inspect first?")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("scan", "index", "chunks", "search", "investigate", "test", "diagnose", "benchmark"):
        v = verbs.add_parser(name)
        v.add_argument("repo")
        if name in ("search", "investigate"):
            v.add_argument("query")
        if name in ("search", "investigate", "diagnose"):
            v.add_argument("--top-k", type=int, default=5)
        if name in ("investigate", "diagnose"):
            v.add_argument("--json", action="store_true")
        if name == "index":
            v.add_argument("--rebuild", action="store_true")
        if name in ("test", "diagnose", "benchmark"):
            v.add_argument("--test-path")
            v.add_argument("--log", help="a saved test log instead of a run")
        if name == "benchmark":
            v.add_argument("--expect", action="append", default=[], help="name of the chunk that should be found")
    return p


@contextlib.contextmanager
def quiet_stdout() -> Iterator[None]:
    """What anything below writes to standard output goes to standard error, so that JSON stays clean."""
    sys.stdout.flush()
    kept = os.dup(1)
    try:
        os.dup2(2, 1)
        yield
    finally:
        sys.stdout.flush()
        os.dup2(kept, 1)
        os.close(kept)


def run_tests(repo: str, path: str | None) -> tuple[int, str]:
    """pytest's exit code and output; 3 if it could not be started."""
    env = os.environ | {"PYTEST_DISABLE_PLUGIN_AUTOLOAD": "1"}
    try:
        done = subprocess.run([sys.executable, "-m", "pytest", "--no-header", "--rootdir", ".", "--confcutdir", ".", *([path] if path else [])], cwd=repo, env=env, capture_output=True, text=True)
    except OSError as e:
        return 3, str(e)
    return done.returncode, done.stdout + done.stderr


def log_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(1, i, line) for i, line in enumerate(text.splitlines(), 1)], "log_id bigint, line_no int, line string")


def parsed(spark: SparkSession, text: str) -> DataFrame:
    return failures.parse_logs(log_frame(spark, text)).withColumn("failure_id", F.monotonically_increasing_id()).withColumn("repo", F.lit(""))


def show(rows: list, key: str = "rank") -> None:
    for kind, title in (("semantic", "Likely relevant code"), ("related", "Related context")):
        print(f"{title}:")
        for r in sorted((x for x in rows if x["kind"] == kind), key=lambda x: x[key]) or ():
            score = "" if r["score"] is None else f"  score {r['score']:.3f}"
            print(f"  {r['rank']}. {r['name']} ({r['chunk_type']})  {r['file_path']}:{r['start_line']}-{r['end_line']}{score}\n     {'; '.join(r['reasons'])}")


def corpus(spark: SparkSession, repo: str) -> api.Corpus | str:
    index = Index(spark, os.path.join(repo, FOLDER))
    state = index.compatibility()
    return api.Corpus(index.chunks()) if state == "compatible" else state


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    wants_json = getattr(a, "json", False)
    if a.verb in ("scan", "index", "chunks"):
        try:
            files = scan(spark, a.repo)
        except (FileNotFoundError, NotADirectoryError) as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            return 2
        if a.verb == "scan":
            found = [r.rel_path for r in files.select("rel_path").orderBy("rel_path").toLocalIterator()]
            print(*found, f"{len(found)} files", sep="\n")
        elif a.verb == "index":
            done = Index(spark, os.path.join(a.repo, FOLDER)).update(files, a.rebuild)
            print(", ".join(f"{k}: {done[k]}" for k in ("new", "changed", "unchanged", "deleted", "files_indexed", "chunks_indexed")))
        else:
            for r in extract_chunks(files).orderBy("file_path", "start_line").select("file_path", "start_line", "end_line", "chunk_type", "name").toLocalIterator():
                print(f"{r.file_path}:{r.start_line}-{r.end_line} {r.chunk_type} {r.name}")
        return 0
    code, text = 0, ""
    if a.verb in ("test", "diagnose", "benchmark"):
        if a.log:
            with open(a.log) as f:
                code, text = 1, f.read()
        else:
            code, text = run_tests(a.repo, a.test_path)
    if a.verb == "test":
        rows = parsed(spark, text).collect()
        for r in rows:
            print(f"{r.test_name}  {r.file_path}:{r.line_number}  {r.error_type}: {r.message}")
        if not rows:
            print(text)
        return code
    with quiet_stdout():
        found = corpus(spark, a.repo)
    if isinstance(found, str):
        said = f"index {found}: run the index verb first"
        print(json.dumps({"schema_version": 1, "status": "error", "message": said}, indent=2, sort_keys=True) if wants_json else said, file=sys.stdout if wants_json else sys.stderr)
        return 2
    if a.verb in ("search", "investigate"):
        if not a.query.strip():
            print("empty query", file=sys.stderr)
            return 2
        q = spark.createDataFrame([(1, a.query)], "query_id bigint, query string")
        rows = (api.search if a.verb == "search" else api.investigate)(found, q, a.top_k)
        if wants_json:
            payload = api.as_json(rows, "query_id", q).first()
            print(json.dumps(json.loads(payload.payload) | {"repo": a.repo}, indent=2, sort_keys=True))
        else:
            show(rows.collect())
        return 0
    fs = settle(parsed(spark, text), "failures")
    answers = api.diagnose(found, fs, getattr(a, "top_k", 5), repo=None)
    names = {r.failure_id: r.test_name for r in fs.select("failure_id", "test_name").collect()}
    if a.verb == "benchmark":
        best = answers.where("kind = 'semantic'").select(F.col("name").alias("item"), "rank")
        cases = spark.createDataFrame([(i, x) for i, x in enumerate(a.expect)], "case_id bigint, item string")
        graded = evaluate.best_ranks(cases, cases.join(best, "item").select("case_id", "item", "rank")).collect()
        for r in graded:
            print(f"{a.expect[r.case_id]}: {r.result} ({r['rank']})")
        return int(not graded or any(r.result != "PASS" for r in graded))
    if wants_json:
        payloads = {r.failure_id: json.loads(r.payload) for r in api.as_json(answers, "failure_id").collect()}
        print(json.dumps({"schema_version": 1, "status": "ok", "repo": a.repo, "diagnose_exit_code": code, "failures": [{"test_name": n} | payloads.get(i, {}) for i, n in names.items()]}, indent=2, sort_keys=True))
    else:
        rows = answers.collect()
        for i, n in names.items():
            print(f"== {n}")
            show([r for r in rows if r["failure_id"] == i])
    return code


if __name__ == "__main__":
    sys.exit(main())
