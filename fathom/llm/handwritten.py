"""Problem 4: files that nobody wrote by hand for their project: generated, minified, vendored, or data saved as code.

Two grammars are inferred over the token sequences of all files of an Arrow batch at once. The first is Re-Pair: in each
round every pair that occurs at least twice in its file and is locally the most frequent becomes a rule; what remains when
no pair repeats tells how much of a file its rules make up. The second takes pairs in an order that only their text
decides, so that equal stretches become equal rules in every file; counted over the corpus, rules that an upstream package
or several other repositories have mark vendored copies. Over the characters
inside long literals the first grammar tells blobs, which no rule shortens, from text that repeats.

What a grammar can't see is taken from the file's opening comment (a generator's notice), from its path (a package below a
vendor folder) and from its layout (tokens a line, share of literals). The result says for every file which kinds of evidence
it has, so that flags without a grammar's can be told apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.sources.tables import settle

REUSED = 0.5  # of a file's tokens, at most so many symbols and rules are left: generated
SAVED = 30  # and at least so many of its tokens are saved by them
SHARED_UPSTREAM, SHARED_REPOS, OTHER_REPOS = 0.5, 0.9, 4
UPSTREAM_RULES, REPOS_RULES = 2, 18  # rules that at least are shared
HOT_FILES, SMALL_LIST = 100_000, 100_000  # a rule of more files than that is joined by broadcast, if there are not more such rules
BLOB, VALUES, DENSE = 0.6, 0.75, 45
DENSE_BITS, WRAPPED = 3.2, 32  # bits a character that data takes at least; width of a line of wrapped data
CHARS_A_BATCH = 2_000_000
LONG_LINE = 300
UPSTREAM = "\0upstream"

TOKEN = re.compile(r"[^\W\d]\w*|[()\[\]{},.:;=+*<>%&|^~!@?-]|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\d[\w.]*|[^\s\w]")
WORDS = re.compile(r"\s\S+\s\S+\s")
PREFIXES = frozenset(("b", "r", "rb", "br", "B", "R", "f"))
# What generators put in the first lines, and folders that hold packages of others.
NOTICE = re.compile(r"@generated\b|\bauto-?generated\b|\bautomatically generated\b|\b(?:written|generated|created|produced) automatically by\b|\bgenerated (?:by|from|with|using)\b.*\b(?:do not|don't) (?:edit|modify|change)\b|\bcode generated\b|\b(?:do not|don't) (?:edit|modify) (?:this file|by hand|manually)|\bedit the (?:template|source|schema), not this\b|\bregenerate instead of editing\b|\bchanges will be (?:lost|overwritten)\b", re.I)
BUNDLED = re.compile(r"^\W*(?:bundled|vendored|copied|taken) from \w[\w.-]* v?\d+\.\d+", re.I)
VENDOR_PATH = r"(^|/)(_?vendor|third[_-]party|3rdparty|extern|external|node_modules|bower_components|site-packages)/[^/]+/"
MINIFIED_PATH = r"[.-]min\.js$"
GENERATED_PATH = r"(_pb2(_grpc)?|[._](g|gen|pb|autogen|generated))\.(py|js)$"


class Ids(dict):
    """Token text to a 64-bit number; numbers count as one, digits in names as one digit, blank lines not at all."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        text = "0" if c.isdigit() else re.sub(r"\d+", "0", token) if c not in "\"'`#/" else token
        raw = text.encode("utf-8", "surrogatepass")
        value = (zlib.crc32(raw) | zlib.crc32(raw, 0x5BD1E995) << 32) | 1
        if len(token) < 80:
            self[token] = value
        return value


IDS = Ids()
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def _chosen(weight: np.ndarray, tie: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Positions whose pair outranks both overlapping pairs; of equal neighbours the first."""
    w = np.where(allowed, weight, 0)
    left = np.zeros(len(w), bool)
    left[1:] = (w[:-1] > w[1:]) | ((w[:-1] == w[1:]) & (tie[:-1] >= tie[1:]) & (w[:-1] > 0))
    right = np.zeros(len(w), bool)
    right[:-1] = (w[1:] > w[:-1]) | ((w[1:] == w[:-1]) & (tie[1:] > tie[:-1]))
    return np.flatnonzero(allowed & ~left & ~right)


def re_pair(symbols: np.ndarray, files: np.ndarray, n_files: int) -> tuple[np.ndarray, np.ndarray]:
    """Per file: symbols that are left when no pair repeats, and rules made. Each file has a grammar of its own."""
    left, rules = np.zeros(n_files, np.int64), np.zeros(n_files, np.int64)
    s, f = symbols, files
    while len(s) > 1:
        inside = f[:-1] == f[1:]
        key = _mix(s[:-1] * M1 + _mix(s[1:])) ^ (f[:-1].astype(np.uint64) * M3)
        key[~inside] = 0
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        at = _chosen(count, key, inside & (count > 1))
        if not len(at):
            break
        made, where = np.unique(key[at], return_index=True)
        rules += np.bincount(f[at][where], minlength=n_files)
        s = s.copy()
        s[at] = key[at] | np.uint64(1)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        moved = np.bincount(f[at], minlength=n_files) > 0
        s, f = s[keep], f[keep]
        still = moved[f]
        if not still.all():  # files without a repeated pair are done
            left += np.bincount(f[~still], minlength=n_files)
            s, f = s[still], f[still]
    return left + np.bincount(f, minlength=n_files), rules


def shared_rules(symbols: np.ndarray, files: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(file, rule) pairs of a grammar whose pairs are taken in an order of their text alone; a rule spans 8 tokens or so."""
    s, f, span = symbols, files, np.ones(len(symbols), np.int64)
    for _ in range(rounds):
        if len(s) < 2:
            break
        inside = f[:-1] == f[1:]
        key = _mix(s[:-1] * M1 + _mix(s[1:]))
        at = _chosen((key >> np.uint64(1)).astype(np.int64), key, inside)
        s, span = s.copy(), span.copy()
        s[at] = key[at] | np.uint64(1)
        span[at] += span[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, f, span = s[keep], f[keep], span[keep]
    long = span >= 5
    return f[long], s[long].view(np.int64)


def tokenised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    if len(IDS) > 300_000:
        IDS.clear()
    tokens = [TOKEN.findall(x) for x in texts]
    sizes = [len(t) for t in tokens]
    symbols = np.fromiter((IDS[t] for ts in tokens for t in ts), dtype=np.uint64, count=sum(sizes))
    return symbols, np.repeat(np.arange(len(texts)), sizes), tokens


def notice(text: str) -> bool:
    """A generator's notice in the comments or the docstring that open a file, however long they are; the first line of code ends them."""
    quote = ""
    for m in re.finditer(r"[^\n]+", text):
        line = m[0].strip().lstrip("﻿")
        if not line:
            continue
        opens = next((q for q in ('"""', "'''", "/*") if line.startswith(q)), "") if not quote else quote
        if not opens and not line.startswith(("#", "//", "*")):
            return False
        if NOTICE.search(line) or BUNDLED.search(line):
            return True
        if opens:
            body = line if quote else line[len(opens) :]
            quote = "" if ("*/" if opens == "/*" else opens) in body else opens
    return False


def blob_lines(tokens: list[str]) -> list[str]:
    """The lines of long literals that may be data: long ones of few words, and of several lines those without a blank that
    are wide, as wide as the line before, or the rest after such a line."""
    out = []
    for t in tokens:
        if len(t) <= 80 or t[0] not in "\"'`":
            continue
        if "\n" not in t:
            if not WORDS.search(t):
                out.append(t)
            continue
        before, data = "", False
        for line in t.split("\n"):
            line = line.strip().removesuffix("\\").removesuffix("\\n")
            wide = len(line) > 80 and not WORDS.search(line)
            whole = bool(line) and not any(c.isspace() for c in line)
            data = wide or whole and (len(line) >= WRAPPED or len(line) == len(before) >= 8 or data and len(line) < len(before))
            if data:
                out.append(line)
            before = line
    return out


def dense_literals(tokens: list[list[str]]) -> np.ndarray:
    """Per file, whether its blobs stay long under a grammar over their characters: the bits that it takes for each."""
    blobs = ["".join(blob_lines(ts)) for ts in tokens]
    sizes = np.array([len(x) for x in blobs])
    points = np.frombuffer("".join(blobs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    left, rules = re_pair(_mix(points.astype(np.uint64) * M1) | np.uint64(1), np.repeat(np.arange(len(blobs)), sizes), len(blobs))
    letters = np.array([len(set(x)) for x in blobs])
    return (left + 2 * rules) * np.log2(np.maximum(2, letters + rules)) >= DENSE_BITS * np.maximum(sizes, 1)


def literal_share(text: str, tokens: list[str], dense: bool) -> tuple[float, float]:
    """Share of the characters in literals that look like no text, if they are dense, and of the tokens in literals at all."""
    hard = sum(map(len, blob_lines(tokens))) if dense else 0
    plain = [t for t in tokens if t[0] not in "#,:;()[]{}" and t not in PREFIXES and not t.startswith("//")]
    values = sum(1 for t in plain if t[0].isdigit() or t[0] in "\"'`.-")
    return hard / max(1, len(text)), values / max(1, len(plain))


def describe(files: DataFrame, upstream: bool = False) -> DataFrame:
    """Features and shared rules of files(path, repo, body): one row per file with rules as array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("body").to_pylist()
            done = 0
            while done < len(whole):
                n, size = 0, 0
                while done + n < len(whole) and (not n or size < CHARS_A_BATCH):
                    size += len(whole[done + n])
                    n += 1
                texts = whole[done : done + n]
                symbols, of, tokens = tokenised(texts)
                sizes = np.bincount(of, minlength=n)
                left, rules = re_pair(symbols, of, n)
                at, rule = shared_rules(symbols, of)
                bounds = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
                shares = [literal_share(t, ts, d) for t, ts, d in zip(texts, tokens, dense_literals(tokens))]
                lines = [t.split("\n") for t in texts]
                longest = [max(map(len, ls)) for ls in lines]
                dense = [len(ts) / max(1, sum(not (not ls or ls.isspace()) for ls in rows)) for rows, ts in zip(lines, tokens)]
                part = batch.slice(done, n)
                f64, i64 = pa.float64(), pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [part.column("path"), part.column("repo"), pa.array(sizes, i64), pa.array((left + 2 * rules) / np.maximum(sizes, 1), f64), pa.array([a for a, _ in shares], f64), pa.array([b for _, b in shares], f64), pa.array(longest, i64), pa.array(dense, f64), pa.array([notice(t) for t in texts]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(rule))],
                    names=["path", "repo", "n_tokens", "left_over", "hard_literals", "literals", "longest_line", "tokens_a_line", "notice", "rules"],
                )
                done += n

    return files.mapInArrow(run, "path string, repo string, n_tokens bigint, left_over double, hard_literals double, literals double, longest_line bigint, tokens_a_line double, notice boolean, rules array<bigint>")


def is_code(path: Column) -> Column:
    return path.rlike(r"(?i)\.(py|js)$")


def code_files(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, repo, body) of the .py and .js files that have chunks: the source as scanned, or else the text of its chunks."""
    paths = chunks.where(is_code(F.col("file_path"))).select(F.col("file_path").alias("path")).distinct()
    scanned = sources.where(is_code(F.col("file_path")) & F.col("source").isNotNull()).groupBy(F.col("file_path").alias("path")).agg(F.min(F.struct("repo", F.col("source").alias("body"))).alias("f")).select("path", "f.repo", "f.body")
    whole = scanned.join(paths, "path", "left_semi")
    lone = paths.join(scanned.select("path"), "path", "left_anti")
    pieces = chunks.where(F.col("source_code").isNotNull() & (F.col("chunk_type") != "method")).select(F.col("file_path").alias("path"), "repo", "start_line", "source_code").join(lone, "path", "left_semi")
    joined = pieces.groupBy("path").agg(F.min("repo").alias("repo"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start_line", "source_code"))), lambda x: x["source_code"]), "\n").alias("body"))
    return whole.unionByName(joined)


def not_handwritten(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Every file of files(path, repo, body) with its features, the reason, null for hand-written ones, and the evidence there is.

    upstream(package, source_code) has the files of third-party packages. Reasons: generated, minified, data, vendored. Null
    and empty bodies have no tokens and are hand-written unless their path says otherwise; a repeated path should be
    removed before; a null repo is one repository.
    """
    own = settle(describe(files.select("path", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("body", F.lit("")).alias("body"))), "files")
    theirs = describe(upstream.where(F.col("source_code").isNotNull()).select(F.lit("").alias("path"), F.lit(UPSTREAM).alias("repo"), F.col("source_code").alias("body")))
    rules = own.select("path", "repo", F.explode(F.array_distinct("rules")).alias("rule"))
    known = theirs.select("repo", F.explode(F.array_distinct("rules")).alias("rule")).distinct()
    by_repo = rules.groupBy("repo", "rule").agg(F.count("*").alias("files")).unionByName(known.withColumn("files", F.lit(0)))
    owners = by_repo.groupBy("rule").agg((F.count_if(F.col("repo") == UPSTREAM) > 0).alias("up"), F.count("*").alias("repos"), F.sum("files").alias("files"))
    owners = settle(owners.where(f"up or repos >= {OTHER_REPOS}"), "owners")
    hot = owners.where(F.col("files") > HOT_FILES).select("rule", F.lit(True).alias("is_hot"), F.col("up").alias("hot_up"), F.col("repos").alias("hot_repos"))
    many = hot.count()
    if 0 < many <= SMALL_LIST:
        marked = rules.join(F.broadcast(hot), "rule", "left")
        hits = marked.where("is_hot").select("path", F.col("hot_up").alias("up"), F.col("hot_repos").alias("repos"))
        hits = hits.unionByName(marked.where("is_hot is null").join(owners.where(F.col("files") <= HOT_FILES), "rule").select("path", "up", "repos"))
    else:
        hits = rules.join(owners, "rule").select("path", "up", "repos")
    spread = hits.groupBy("path").agg(F.count_if("up").alias("in_upstream"), F.count_if(F.col("repos") >= OTHER_REPOS).alias("in_repos"))
    rows = own.withColumn("n_rules", F.size(F.array_distinct("rules"))).drop("rules").join(spread, "path", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.col("n_rules"), F.lit(1))
    shared = lambda c, least, n: (share(c) >= least) & (F.coalesce(F.col(c), F.lit(0)) >= n)
    path = F.lower("path")
    copied = shared("in_upstream", SHARED_UPSTREAM, UPSTREAM_RULES) | shared("in_repos", SHARED_REPOS, REPOS_RULES)
    blob, repeats = F.col("hard_literals") >= BLOB, (F.col("left_over") <= REUSED) & ((1 - F.col("left_over")) * F.col("n_tokens") >= SAVED)
    packed, values = (F.col("tokens_a_line") >= DENSE) & (F.col("longest_line") >= LONG_LINE) & ~blob, (F.col("literals") >= VALUES) & (F.col("n_tokens") > 0)
    vendor, small, made = path.rlike(VENDOR_PATH), path.rlike(MINIFIED_PATH), path.rlike(GENERATED_PATH)
    reason = F.when(copied | vendor, "vendored").when((blob & (F.col("n_tokens") > 0)) | values, "data").when(packed | small, "minified").when(F.col("notice") | made | repeats, "generated")
    kinds = (("grammar", copied | blob | repeats), ("layout", packed | values), ("notice", F.col("notice")), ("path", vendor | small | made))
    evidence = F.array_compact(F.array(*[F.when(fits, F.lit(kind)) for kind, fits in kinds]))
    rounded = [F.round(c, d).alias(c) if d else F.col(c) for c, d in (("n_tokens", 0), ("left_over", 4), ("hard_literals", 4), ("literals", 4), ("longest_line", 0), ("tokens_a_line", 2), ("notice", 0))]
    return rows.select("path", "repo", *rounded, F.round(share("in_upstream"), 4).alias("in_upstream"), F.round(share("in_repos"), 4).alias("in_repos"), reason.alias("reason"), F.array_join(evidence, ",").alias("evidence"))
