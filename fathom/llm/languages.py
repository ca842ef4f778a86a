"""Problem 9: the language of every text and of every passage, whatever its label says.

Texts are cut into sentences of prose; code, log lines, headings and quoted messages are left out. A naive Bayes model
over words and their letter triples gives each sentence a likelihood in every language. Bayes' rule then joins it with what
else is known: the declared label, read as a noisy report, and the languages of the host (the document's repository and
source), whose priors are smoothed towards their parents' and come from one grouped aggregation. A sentence of a few words
also leans on the nearest longer one of its text. The model is fitted on at most SAMPLE labelled documents; everything else
runs over all of them.

Lines and sentences of a whole Arrow batch are tested at once, by Arrow's kernels and over arrays of code points; every
distinct word of a batch is scored once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import codepoints, steps
from fathom.sources.tables import settle

CODES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "ja", "zh")
SAMPLE, BUCKETS, SMOOTH = 20_000, 1 << 16, 0.05
TEMPER, LABEL_TRUST, HOST_WEIGHT, SOURCE_WEIGHT = 0.35, 0.7, 20.0, 50.0
SALTS, SMALL_HOSTS = 32, 100_000  # copies of a host's prior where hosts are joined by a shuffle; up to so many hosts are broadcast
LEAST_LETTERS, LEAST_SIGNS = 8, 3  # of a sentence, which besides has two words
SHORT_WORDS, SHORT_SIGNS, LEAN = 4, 6, 0.5  # what is shorter leans on its neighbour with this weight
KEPT_WORDS = 200_000
LONG = 4000  # characters of a word that no language has

# What is no prose. The patterns are RE2's, where \w, \s and \d are ASCII.
LINE_END = re.compile(r"(\r\n|[\r\n\x85  ])")
OTHER_ENDS = re.compile(r"[\r\x85  ]")
FENCE = r"^[\s\pZ]*(?:```|~~~)"
NOT_PROSE = (
    r"(?i)^\s*(?:#{1,6}\s|>>>|\.\.\.\s|\$\s|@\w|E\s{2,}|:\w+(?:\s+\w+)?:|-{3,}|={3,}|\d{4}-\d\d-\d\d[T ]\d\d:|\[\d|(?:def|class|import|from|return|raise|assert|with|for|while|if|elif|else|try|except|export|function|const|let|var|async)\b[^.!?]*[:;({=]?\s*$|\"\"\"|\'\'\'|//|/\*|#|Traceback\b|File \"|collected\W+\d+\W+items|(?:FAILED|ERROR|PASSED|WARN(?:ING)?|INFO|DEBUG)\s)"
    r"|::test_|\S+\.(?:py|js|json|toml)(?:\s+[.FEsx]+\s|:\d+:)|\bassert \d+ ==|retry=\d+|^\s*[\pL\pN_.]+(?:\(.*\)|\[.*\])?\s*[-+*/]?=(?:\s+\S|[^=\s])|[{;]\s*$|\)\s*:\s*$"
)
INDENTED = r"(?s)^(?:    |\t).*[=()]"
QUOTED = r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」|『[^』\n]*』|https?://[^\s\pZ]+"
FINAL = r"[.!?…。！？][\"\'’”»)\]]*[^\pL\pN_]*$"
ODD = r"[_/=<>(){}\[\]|\\\p{Nd}]|[\pL\pN_]\.[\pL\pN_]|[a-z][A-Z]"
SIGN_RANGES = r"\x{3005}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{2060}\x{ad}]"
SIGNS = re.compile(r"[々぀-ヿ㐀-䶿一-鿿豈-﫿]")
RUN = re.compile(r"[^\s" + SIGNS.pattern[1:-1] + "]+")


def _classes() -> np.ndarray:
    """1 for marks that end a sentence before a blank, 2 for what may close it, 3 for marks that end it at once, 4 for blanks."""
    out = np.zeros(1 << 16, np.uint8)
    out[[i for i in range(1 << 16) if chr(i).isspace()]] = 4
    for n, signs in ((1, ".!?…"), (2, "\"'’”»)]"), (3, "。！？")):
        out[[ord(c) for c in signs]] = n
    return out


CLASS = _classes()


class Prose(NamedTuple):
    """Sentences of some texts: the text, start and end of each, its cleaned words (codes into names), where they begin, and
    whether it is short."""

    of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    names: list[str]
    codes: np.ndarray
    bounds: np.ndarray
    short: np.ndarray


def _listed(values: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return values.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy())])


def _lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines that may hold prose, the text of each, and where it starts there."""
    lines: list[str] = []
    of, at = [], []
    for i, t in enumerate(texts):
        parts = LINE_END.split(t) if OTHER_ENDS.search(t) else re.split("(\n)", t)
        lines += parts[::2]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        of.append(np.full((len(parts) + 1) // 2, i))
        at.append((np.cumsum(sizes) - sizes)[::2])
    text_of, start = np.concatenate(of), np.concatenate(at)
    for k in np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) > LONG):  # the word goes, its place and the rest of the line stay
        lines[k] = RUN.sub(lambda m: "​" * len(m[0]) if len(m[0]) > LONG else m[0], lines[k])
    rows = pa.array(lines, pa.large_string())
    fence = pc.match_substring_regex(rows, FENCE).to_numpy(zero_copy_only=False)
    # inside of a fence the number of fences before is odd, counted from the first line of the text
    before = np.cumsum(fence) - fence
    first = np.concatenate([[0], np.flatnonzero(np.diff(text_of)) + 1])
    inside = (before - before[first][np.searchsorted(first, np.arange(len(lines)), side="right") - 1]) % 2 == 1
    flat = pc.utf8_trim(pc.replace_substring(pc.replace_substring_regex(rows, INVISIBLE, ""), "\xa0", " "), characters=" \t>*-•·")
    other = pc.or_(pc.match_substring_regex(flat, NOT_PROSE), pc.match_substring_regex(rows, INDENTED)).to_numpy(zero_copy_only=False)
    words = pc.match_substring_regex(flat, r"\pL").to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(~(fence | inside | other) & words)
    return [lines[k] for k in kept], text_of[kept], start[kept]


def _composed(values: pa.Array) -> pa.Array:
    """In normal form KC; what is ASCII is so already."""
    rare = pc.invert(pc.string_is_ascii(values))
    return pc.replace_with_mask(values, rare, pa.array([unicodedata.normalize("NFKC", x) for x in values.filter(rare).to_pylist()], values.type))


def cut(texts: list[str]) -> Prose:
    """The sentences of prose in texts, in order."""
    none = np.zeros(0, np.int64)
    lines, text_of, offset = _lines(texts) if texts else ([], none, none)
    if not lines:
        return Prose(none, none, none, [], none, np.zeros(1, np.int64), np.zeros(0, bool))
    joined = "\n".join(lines) + "\n"
    points = codepoints(joined)
    kind = np.where(points < 1 << 16, CLASS[points & 0xFFFF], 0)
    place = np.arange(len(points))
    # where a blank follows a mark, or what closes it, a sentence ends
    open_ = np.maximum.accumulate(np.where(kind != 2, place, 0))
    after = np.concatenate([[0], open_[:-1]])
    blank_end = np.flatnonzero((kind == 4) & (kind[after] == 1) & (place > 0))
    line_end = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1
    end = np.unique(np.concatenate([blank_end, np.flatnonzero(kind == 3) + 1, line_end]))
    start = np.concatenate([[0], end[:-1] + (points[end[:-1]] == 10)])
    full = end > start
    start, end = start[full], end[full]
    line = np.searchsorted(line_end, start, side="right")
    pieces = pa.array([joined[a:e] for a, e in zip(start.tolist(), end.tolist())], pa.large_string())
    final = pc.match_substring_regex(pieces, FINAL).to_numpy(zero_copy_only=False)
    clean = pc.replace_substring_regex(_composed(pc.replace_substring_regex(pieces, INVISIBLE, "")), QUOTED, " ")
    # words without identifiers, paths and numbers; in scripts without blanks without all of ASCII
    tokens, piece_at = _listed(pc.utf8_split_whitespace(clean))
    odd = pc.match_substring_regex(pc.utf8_trim(tokens, characters="()[]{}<>.,;:!?\'\""), ODD)
    native = pc.match_substring_regex(tokens, f"[{SIGN_RANGES}]")
    mixed = pc.and_(odd, native)
    tokens = pc.replace_with_mask(pc.if_else(pc.and_not(odd, native), "", tokens), mixed, pc.replace_substring_regex(tokens.filter(mixed), "[!-~]+", " "))
    words, token_at = _listed(pc.split_pattern_regex(pc.utf8_lower(tokens), r"[^\pL'’]+"))
    words = pc.utf8_trim(words, characters="'’")
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    piece_at = np.concatenate([[0], np.cumsum(there)])[token_at[piece_at]]
    coded = words.filter(pa.array(there)).dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    signs_of = np.fromiter((len(SIGNS.findall(w)) for w in names), np.int64, len(names))
    letters_of = np.fromiter(map(len, names), np.int64, len(names))
    total = lambda of: np.diff(np.concatenate([[0], np.cumsum(of[codes])])[piece_at])
    n_words, n_signs, n_letters = np.diff(piece_at), total(signs_of), total(letters_of)
    short = (n_words < SHORT_WORDS) & (n_signs < SHORT_SIGNS)
    ok = np.flatnonzero(((n_words >= 2) & (n_letters >= LEAST_LETTERS) | (n_signs >= LEAST_SIGNS)) & (final | (n_words >= 8)))
    at = _ranges(piece_at[ok], n_words[ok])
    shift = offset[line] - np.concatenate([[0], line_end[:-1] + 1])[line]
    return Prose(text_of[line[ok]], (start + shift)[ok], (end + shift)[ok], names, codes[at], np.concatenate([[0], np.cumsum(n_words[ok])]), short[ok])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) of the prose in a text, in order."""
    p = cut([text])
    return [(a, e, text[a:e].strip()) for a, e in zip(p.start.tolist(), p.end.tolist())]


def units(word: str) -> list[str]:
    """A word itself; of a run without blanks in its own script the single signs and pairs."""
    return [*word, *(word[i : i + 2] for i in range(len(word) - 1))] if SIGNS.search(word) else [word]


def plain(word: str) -> str:
    """The word without diacritics, which texts may have lost."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def buckets(unit: str) -> list[int]:
    if SIGNS.match(unit):
        return [zlib.crc32(b"s" + unit.encode()) % BUCKETS]
    p = plain(unit)
    marked = f"^{p}$"
    return [zlib.crc32(x.encode()) % BUCKETS for x in ("w" + p, *({"d" + unit} if unit != p else ()), *("t" + marked[i : i + 3] for i in range(len(marked) - 2)))]


class Model:
    """Log-likelihoods of words in every language; a word weighs as one, its triples as one together."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS
        self.table = np.log((counts + SMOOTH) / total).astype(np.float32)
        self.known: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        v = self.known.get(w)
        if v is None:
            v = np.zeros(len(CODES), np.float32)
            for u in units(w):
                b = buckets(u)
                v += self.table[:, b[0]]
                if len(b) > 1:
                    v += self.table[:, b[1:]].mean(axis=1)
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            if len(w) < 40:
                self.known[w] = v
        return v

    def score(self, p: Prose) -> np.ndarray:
        """Tempered log-likelihoods of every sentence; short ones lean on the nearest longer one of their text, before or after."""
        if not len(p.of):
            return np.zeros((0, len(CODES)), np.float32)
        words = np.array([self.word(w) for w in p.names], np.float32)
        own = np.add.reduceat(words[p.codes], p.bounds[:-1], axis=0) * np.float32(TEMPER)
        if p.short.any():
            place = np.arange(len(p.of))
            before = np.maximum.accumulate(np.where(p.short, -1, place))
            after = np.minimum.accumulate(np.where(p.short, len(place), place)[::-1])[::-1]
            near = np.where((before >= 0) & (p.of[before] == p.of), before, np.where(after < len(place), after, 0))
            leans = np.flatnonzero(p.short & ~p.short[near] & (p.of[near] == p.of))
            own[leans] += np.float32(LEAN) * (own[near[leans]] - own[near[leans]].max(axis=1, keepdims=True))
        return own


_MODELS: dict[str, Model] = {}


def _model(counts: np.ndarray, name: str) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(counts)
    return _MODELS[name]


def declared(label: Column) -> Column:
    """The two-letter code a label starts with; null for anything else."""
    two = F.lower(F.substring(F.trim(label), 1, 2))
    return F.when(two.isin(*CODES), two)


def _counts(sample: DataFrame, counts: np.ndarray | None) -> np.ndarray:
    """Bucket counts by language over the sample: by label, or by what an earlier model says of each sentence."""
    sender = sample.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers a language, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sender.value) if sender.value is not None else None
        seen = np.zeros((len(CODES), BUCKETS), np.int64)
        for b in batches:
            labels = np.array([CODES.index(x) for x in b.column("label").to_pylist()], np.int64)
            for first, texts in steps(b.column("body").to_pylist()):
                p = cut(texts)
                k = labels[first + p.of]
                if model and len(p.of):
                    ll = model.score(p)
                    two = np.sort(ll, axis=1)[:, -2:]
                    k = np.where(two[:, 1] - two[:, 0] < 3, -1, ll.argmax(axis=1))
                k = np.repeat(k, np.diff(p.bounds))
                slot, n = np.unique((k * len(p.names) + p.codes)[k >= 0], return_counts=True)
                for s, c in zip(slot.tolist(), n.tolist()):
                    for u in units(p.names[s % len(p.names)]):
                        np.add.at(seen[s // len(p.names)], buckets(u), c)
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(seen.ravel()[slot], pa.int64())], names=["slot", "n"])

    table = sample.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(CODES) * BUCKETS)
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(len(CODES), BUCKETS)


def fit(documents: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> np.ndarray:
    """Counts of a model fitted on about sample labelled documents: those of the smallest hashes of their keys, by a threshold
    that the number of labelled documents sets. The second round unlearns wrong labels."""
    rows = documents.select(F.col(text).alias("body"), declared(F.col(label)).alias("label"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)).alias("h")).where("label is not null and body is not null")
    n = rows.select("label").count()
    if n > sample:
        rows = rows.where(F.col("h") < int((1 << 40) * sample / n))
    picked = settle(rows.select("body", "label").repartition(max(1, documents.sparkSession.sparkContext.defaultParallelism)), "sample")
    return _counts(picked, _counts(picked, None))


SPANS = "array<struct<start:int,end:int,ll:array<float>>>"


def passages(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", hosts: tuple[str, str] = ("source", "repo"), sample: int = SAMPLE) -> DataFrame:
    """The passages of every text as (key, passage_no, start_char, end_char, lang, confidence, label).

    A passage is a run of sentences of prose in one language. label is the code that the label column declares, null for a
    missing or unknown one. Null, empty and blank texts and texts without prose have no passages. Null hosts count as a
    host of their own. Rows with an equal key are texts of their own. A sentence has two words of
    LEAST_LETTERS letters together, or LEAST_SIGNS signs, at least.
    """
    spark = SparkSession.active()
    counts = fit(documents, key, text, label, sample)
    sender = spark.sparkContext.broadcast(counts.astype(np.float32))
    name = f"{id(counts)}-{counts.sum()}"
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("body"), declared(F.col(label)).alias("label"), F.coalesce(F.col(hosts[0]), F.lit("")).alias("source"), F.coalesce(F.col(hosts[1]), F.lit("")).alias("repo"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sender.value, name)
        for b in batches:
            for first, texts in steps(b.column("body").to_pylist()):
                p = cut(texts)
                if not len(p.of):
                    continue
                ll = model.score(p)
                ll -= ll.max(axis=1, keepdims=True)
                begin = np.concatenate([[0], np.flatnonzero(np.diff(p.of)) + 1, [len(p.of)]])
                likelihoods = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * len(CODES), pa.int32()), pa.array(ll.ravel(), pa.float32()))
                spans = pa.StructArray.from_arrays([pa.array(p.start, pa.int32()), pa.array(p.end, pa.int32()), likelihoods], ["start", "end", "ll"])
                take = pa.array(first + p.of[begin[:-1]])
                yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("k", "label", "source", "repo")] + [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), spans)], names=["k", "label", "source", "repo", "spans"])

    # read twice: for the priors, and to be joined with them
    scored = settle(rows.mapInArrow(run, f"k {kind}, label string, source string, repo string, spans {SPANS}"), "sentences")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posteriors of sentences, and runs of one language within each text."""
        doubt, trust = np.log((1 - LABEL_TRUST) / (len(CODES) - 1)), np.log(LABEL_TRUST)
        for b in batches:
            if not b.num_rows:
                continue
            spans, at = _listed(b.column("spans"))
            of = np.repeat(np.arange(b.num_rows), np.diff(at))
            ll = spans.field("ll").flatten().to_numpy().reshape(-1, len(CODES)).astype(np.float64)
            prior = np.log(b.column("prior").flatten().to_numpy().reshape(-1, len(CODES)))
            report = np.array([[0.0] * len(CODES) if x is None else [trust if c == x else doubt for c in CODES] for x in b.column("label").to_pylist()])
            ll += (prior + report)[of]
            best = ll.argmax(axis=1)
            odds = np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (best[1:] != best[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1
            doc = of[first]
            number = np.arange(len(first)) - np.searchsorted(doc, doc) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array(doc)), pa.array(number, pa.int32()), spans.field("start").take(pa.array(first)), spans.field("end").take(pa.array(last)), pa.array(CODES).take(pa.array(best[first])), pa.array(np.round(1 / np.minimum.reduceat(odds, first), 6)), b.column("label").take(pa.array(doc))],
                names=["k", "passage_no", "start_char", "end_char", "lang", "confidence", "label"],
            )

    out = _with_priors(scored).select("k", "label", "spans", "prior").mapInArrow(fuse, f"k {kind}, passage_no int, start_char int, end_char int, lang string, confidence double, label string")
    return out.withColumnRenamed("k", key)


def _with_priors(scored: DataFrame) -> DataFrame:
    """Each text with the prior of its host: counts of likeliest languages by repository, smoothed towards the source's,
    and those towards the whole corpus'. Up to SMALL_HOSTS priors are broadcast; beyond, texts are spread over salted copies of
    their host's, as a host may have many."""
    span = F.explode(F.transform("spans", lambda s: F.array_position(s["ll"], F.array_max(s["ll"])).cast("int")))
    n = settle(scored.select("repo", "source", span.alias("best")).groupBy("repo", "source", "best").agg(F.count("*").alias("n")), "hosts")
    tally = lambda: [F.coalesce(F.sum(F.when(F.col("best") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(CODES, 1)]
    rows = n.groupBy("repo", "source").agg(*tally())
    whole = [(F.col(f"all_{c}") + 1) / (sum(F.col(f"all_{x}") for x in CODES) + len(CODES)) for c in CODES]
    by_source = n.groupBy("source").agg(*tally())
    # one row per source: the window over all of them is as small as that list
    by_source = by_source.select("source", *[F.col(c).alias(f"src_{c}") for c in CODES], *[F.sum(c).over(Window.partitionBy(F.lit(1))).alias(f"all_{c}") for c in CODES])
    source_total = sum(F.col(f"src_{x}") for x in CODES)
    by_source = by_source.select("source", *[((F.col(f"src_{c}") + SOURCE_WEIGHT * w) / (source_total + SOURCE_WEIGHT)).alias(f"p_{c}") for c, w in zip(CODES, whole)])
    total = sum(F.col(x) for x in CODES)
    prior = rows.join(by_source, "source").select("repo", "source", F.array(*[(F.col(c) + HOST_WEIGHT * F.col(f"p_{c}")) / (total + HOST_WEIGHT) for c in CODES]).alias("prior"))
    prior = settle(prior, "priors")
    if prior.count() <= SMALL_HOSTS:
        return scored.join(F.broadcast(prior), ["repo", "source"])
    prior = prior.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return scored.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(prior, ["repo", "source", "salt"]).drop("salt")


def mislabelled(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, confidence, label) for each language of a document whose label is missing, is none of its languages, or
    whose text has more than one. Confidence is the highest of the language's passages."""
    by = found.groupBy(key, "lang").agg(F.max("confidence").alias("confidence"), F.min("label").alias("label"))
    docs = by.groupBy(key).agg(F.count("*").alias("languages"), F.max(F.col("lang") == F.col("label")).alias("fits"))
    cases = docs.where((F.col("languages") > 1) | ~F.coalesce("fits", F.lit(False))).select(key)
    return by.join(cases, key, "left_semi")
