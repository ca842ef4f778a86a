"""Problem 5: find credentials in code and replace them.

Pass one indexes the literals of the whole corpus that stand where a credential may stand (a telling name, a known shape, a
URL, a header, a PEM block), whatever they look like, with what their place says of them. Grouped by value, those that more
owners (repositories) than a share of all have are placeholders and go, unless they have a structure of their own; of the
rest, values that look like secrets are confirmed. Pass two walks every text with an automaton of the confirmed values, so
that a value confirmed in one file is also found where nothing around it tells. The confirmed values are written in shards of
a fixed size to the cluster's shared folder; a task holds some texts and takes shard after shard past them, so neither the
driver nor a task needs all values at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import shared_folder
from fathom.sources.tables import settle

MAX_OWNERS, OWNERS_SHARE, SHARD, MIN_LENGTH = 8, 0.02, 50_000, 6
HELD_CHARS = 64_000_000  # of texts past which a task takes the shards
MASK = "[REDACTED]"

# Words that end the name of a secret, names that look alike but are none, and known token shapes.
STEMS = ("pass", "pw", "passcode", "password", "passwd", "passwrd", "passphrase", "pwd", "secret", "token", "key", "auth", "authorization", "credential", "credentials")
STRONG_KEY = re.compile(r"(?:api|access|secret|private|signing|deploy|hmac|encryption|master|auth)[_-]?$")
AFTER_NAME = re.compile(r"[\"'`\]]{0,2}[ \t]{0,3}(?P<op>:=|[:=,](?![=>]))[ \t]*")
HARMLESS = re.compile(r"(?<![A-Za-z])(?:public|primary|foreign|cache|sort|group|partition|row|hash|dict|unique|natural|reset|idempotency)[_-]?$", re.I)
SHAPES = re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{10,}|github_pat_\w{10,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|(?:AKIA|ASIA)[0-9A-Z]{12,}|[rs]k_(?:live|test)_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9_-]{20,}|glpat-[\w-]{12,}|AIza[\w-]{20,}|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|pypi-[\w-]{20,}|dop_v1_[a-f0-9]{20,}|SG\.[\w-]{10,}\.[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{6,}(?:\.[\w-]*)?)")
SHAPE_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxa-", "xoxb-", "xoxe-", "xoxo-", "xoxp-", "xoxr-", "xoxs-", "akia", "asia", "k_live_", "k_test_", "sk-", "glpat-", "aiza", "npm_", "hf_", "pypi-", "dop_v1_", "sg.", "eyj")
WHOLE = frozenset(("pass", "pw", "passcode"))  # too short to be the end of a longer word
OTHER_HINTS = {"-u ": "login", "--user ": "login", " / ": "note", "getenv(": "env", "environ.get(": "env", "://": "url", "?": "field", "bearer ": "header", "basic ": "header", "token ": "header", "private key-": "pem"}
URL_LOGIN = re.compile(r"://[^\s:/@\"'`{}$<>]*:(?P<v>[^\s@/\"'`{}$<>]{3,})@")
URL_FIELD = re.compile(r"[?&](?:access_token|auth_token|token|api[_-]?key|apikey|key|secret|client_secret|password|sig|signature)=(?P<v>[^\s&\"'`{}$<>#]{8,})", re.I)
LOGIN = re.compile(r"(?:\s-u|--user)[ =]+[\"']?[\w.@-]+:(?P<v>[^\s\"'`{}$<>]{4,})")
NOTE = re.compile(r"(?m)(?:^|\s)(?:#|//|\*|--)[ \t][^\n]*?[\w.@-]+ / (?P<v>[^\s/\"'`{}()<>]{8,})[ \t\r]*$")
HOOK = re.compile(r"https?://(?:hooks\.[^/\s\"'`]+|[^/\s\"'`]+/api/webhooks)/(?:[\w-]+/)*(?P<v>[A-Za-z0-9_-]{16,})")
HEADER = re.compile(r"\b(?:Bearer|Basic|Token)[ ]+(?P<v>[A-Za-z0-9+/._~-]{12,}={0,2})")
NEXT_OF_NAME = {*"\"'`]:=, \t"}
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:\\n|\r?\n)[ \t#/*\"']*[A-Za-z0-9+/=]{16,}")
LITERAL = r"(?:[bBrRuU]{0,2}(?P<q%d>[\"'`])(?P<v%d>(?:\\.|(?!(?P=q%d))[^\\\n])*)(?:(?P=q%d)|(?=\n|\Z)))"
VALUE = re.compile(
    r"(?:(?:os\.)?(?:getenv|environ\.get)\(\s*[\"'][^\"'\n]*[\"']\s*(?:,\s*%s)?\s*\)(?:\s*or\s*%s)?" % (LITERAL.replace("%d", "1"), LITERAL.replace("%d", "2"))
    + r"|process\.env(?:\.\w+|\[[^\]\n]*\])\s*(?:\|\||\?\?)\s*%s" % LITERAL.replace("%d", "3")
    + r"|(?:\w+(?:\.\w+)*\(\s*|\(\s*)?%s)" % LITERAL.replace("%d", "4")
)
ENVIRONMENT = re.compile(r"(?:getenv|environ\.get)\(\s*[\"'](?P<name>\w+)[\"']\s*(?:,\s*%s)?\s*\)(?:\s*or\s*%s)?" % (LITERAL.replace("%d", "1"), LITERAL.replace("%d", "2")))
SECRET_NAME = re.compile(r"(?:" + "|".join(STEMS) + r")$", re.I)
CALL = re.compile(r"\w+(?:\.\w+)*\(")
DECODERS = re.compile(r"(?:bytes\.fromhex|(?:base64\.)?b64decode|SecretStr|Secret|Buffer\.from|bytes|bytearray|str|quote|encode)\(")
NEXT_LITERAL = re.compile(r"[ \t\r\n]+%s" % LITERAL.replace("%d", "1"))
BARE = re.compile(r"(?P<v>[^\s\"'`(){}\[\]<>$,;]{8,})[ \t]*(?:\r?\n|\\n|\Z|\.\.\.)")
TEMPLATE = re.compile(r"redacted|x{4,}|\*{3,}|\.{4,}|\$\{|\{\{|%\(|%s|^<.*>$|^\{.*\}$|^\$\w+$|^(.)\1*$", re.I)
MARKERS = re.compile(r"your|example|changeme|change|place[_ -]?holder|dummy|sample|insert|replace|vault|none|null|todo|fixme|undefined|here", re.I)
GENERIC = re.compile(r"password|passwd|secret|token|test|value|access|private|client|auth|from|user|api|key|the|my|me|it", re.I)
SHAPE_MARKERS = re.compile(r"your|example|change[_-]?me|place[_-]?holder|dummy|sample", re.I)
PHRASES = frozenset(("pass", "pw", "passcode", "password", "passwd", "passwrd", "passphrase", "pwd", "secret"))  # names of what may be words
PROSE = frozenset("a an the is are was be been to of for from in on at by with without and or not no must should can cannot could will may if when this that it its your you we our please enter invalid wrong missing required expired failed error old new at least too has have does do use set reset confirm forgot show hide".split())
RANDOM_PART = re.compile(r"(?=[^\n]*\d)(?=[^\n]*[A-Za-z])[A-Za-z0-9+/_=.~!@#%^&*-]{16,}\Z")


def passphrase(value: str) -> bool:
    """Whether words with blanks between them are picked words and not a sentence or a label."""
    words = value.split(" ")
    if len(words) < 3 or not all(words) or any(c.isspace() for w in words for c in w):
        return False
    plain = [w.strip(".,:;!?'\"()").lower() for w in words]
    if PROSE.intersection(plain) or SECRET_NAME.search(value) or any(SECRET_NAME.search(w.rstrip("s")) for w in plain):
        return False
    return len(set(plain)) == len(plain) and not re.search(r"[.:!?]$|[%{}<>()=]", value) and sum(c.isalpha() for c in value) >= 10


def placeholder(value: str) -> bool:
    """Whether a value is a template, or its words say that it stands for another and leave nothing that could be one."""
    if TEMPLATE.search(value):
        return True
    rest = MARKERS.sub("", value)
    marked = rest != value
    rest = re.sub(r"[\W_]+", "", GENERIC.sub("", rest))
    if not marked:
        return not rest
    digit, lower, upper = (any(map(f, rest)) for f in (str.isdigit, str.islower, str.isupper))
    return not (digit and (lower or upper) and (len(rest) >= 8 or len(rest) >= 6 and lower and upper))


def plausible(value: str, strong: bool, phrase: bool = False) -> bool:
    """Whether a literal may be a credential: no placeholder, no word, no name, no sentence; words with blanks only where the
    name asks for a phrase."""
    if len(value) < MIN_LENGTH or placeholder(value):
        return False
    if any(c.isspace() for c in value):
        return phrase and passphrase(value)
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)
    if not strong:
        letters = len(value) >= 16 and value.isascii() and value.isalpha() and len({c.isupper() for c in value}) == 2 and sum(len(x) < 3 for x in parts) >= 2
        return letters or RANDOM_PART.match(value) is not None and not re.fullmatch(r"[a-z0-9]+(?:[_./:-][a-z0-9]+)*|[A-Z0-9]+(?:_[A-Z0-9]+)*", value)
    if value.startswith(("/", "./", "http://", "https://", "--")):
        return False
    digit, lower, upper = any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)
    if digit:
        # words with a number are names, unless they are long or mixed
        return not re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*[_-]?\d{1,3}|[A-Z]+(?:_[A-Z]+)*_?\d{1,2}|[\d.:-]+", value)
    if re.fullmatch(r"[a-z]+(?:[_./:-][a-z]+)*|[A-Z]+(?:[_./:-][A-Z]+)*", value):
        return False
    if re.fullmatch(r"(?:[A-Z][a-z]+)+|[a-z]+(?:[A-Z][a-z]+)*", value):  # words in camel case, unless they are too short for words
        return sum(len(x) < 3 for x in parts) >= 2
    return lower or upper


def looks_secret(value: str, kind: str) -> bool:
    return kind in ("pem", "sure", "tail") or plausible(value, kind != "weak", kind == "phrase")


@lru_cache(1)
def _hints() -> object:
    """An automaton of everything near which a credential may stand; a stem's value is its length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for stem in STEMS:
        a.add_word(stem, len(stem))
    for hint in SHAPE_HINTS:
        a.add_word(hint, "shape")
    for hint, rule in OTHER_HINTS.items():
        a.add_word(hint, rule)
    a.make_automaton()
    return a


def places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of values where a credential may stand; kind is pem, sure (has a structure of its own), value, phrase
    (may be words), weak (only its look can tell) or tail (goes on from the line before)."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    rules = set()
    for last, hint in _hints().iter(low):
        if hint.__class__ is str:
            rules.add(hint)
            continue
        if low[last + 1 : last + 2] not in NEXT_OF_NAME:
            continue
        m = AFTER_NAME.match(text, last + 1)
        if not m:
            continue
        start, op, at = last + 1 - hint, m["op"], m.end()
        name = low[start : last + 1]
        if name in WHOLE and start and text[start - 1].isalpha() and not (text[start].isupper() and text[start - 1].islower()):
            continue
        strong = name != "key" or STRONG_KEY.search(low, max(0, start - 12), start) is not None
        if HARMLESS.search(text, max(0, start - 14), start):
            continue
        if op == ",":
            if not (re.search(r"--[\w-]*$", text[max(0, start - 24) : start]) or name == "authorization"):
                continue
        v = VALUE.match(text, at)
        if v:
            k = next((i for i in (2, 1, 3, 4) if v[f"q{i}"]), None)
            if k is None or (k == 4 and (c := CALL.match(text, at)) and not DECODERS.match(text, at)):
                continue
            a, b = v.span(f"v{k}")
            body = text[a:b].rstrip("\r") if not text[b : b + 1] or text[b] == "\n" else text[a:b]
            if b == len(text):
                body = body.removesuffix("...")
            if k == 4 and re.match(r"(?:Bearer|Basic|Token)\s", body, re.I):
                continue  # the header rule takes its own part
            if len(body) >= MIN_LENGTH:
                kind = "weak" if not strong else "phrase" if name in PHRASES else "value"
                out.append((a, a + len(body), kind))
                end = v.end()
                goes_on = (text[at : at + 1] == "(" or op == ":") and NEXT_LITERAL.match(text, end) and looks_secret(body, kind)
                while goes_on and (t := NEXT_LITERAL.match(text, end)) and text[t.end() : t.end() + 1] not in (":", "="):
                    if t.end("v1") > t.start("v1"):
                        out.append((*t.span("v1"), "tail"))
                    end = t.end()
        elif strong and op in (":", "=", ":=") and (v := BARE.match(text, at)):
            a, b = v.span("v")
            body = v["v"].removesuffix("...") if b == len(text) else v["v"]
            tight = op == "=" and text[at - 1] == "="
            line = text.rfind("\n", 0, start) + 1
            alone = re.fullmatch(r"[ \t]*(?:[#*>-]|//|export |ENV )?[ \t]*[\w.-]*", text[line:start]) is not None
            letters = {c.isupper() for c in body if c.isalpha()}
            mixed = bool(letters) and (any(c.isdigit() for c in body) or (len(letters) == 2 and any(c in "~!^*%&+" for c in body)))
            if alone and mixed and (tight or op == ":") and "." not in body[:1] and not re.fullmatch(r"[a-z_][a-z0-9_]*(?:\.\w+)*|(?:int|str|float)\b.*|\d+\w?", body) and plausible(body, True):
                out.append((a, a + len(body), "value"))
    if "env" in rules:  # a default beside the name of an environment variable
        for m in ENVIRONMENT.finditer(text):
            for k in ("1", "2"):
                if m["q" + k] and (told := SECRET_NAME.search(m["name"])):
                    out.append((*m.span("v" + k), "weak" if m["name"].lower().endswith("key") else "phrase" if told[0].lower() in PHRASES else "value"))
    if "url" in rules:
        for rule, kind in ((URL_LOGIN, "sure"), (HOOK, "value")):
            out += [(*m.span("v"), kind) for m in rule.finditer(text) if plausible(m["v"], True)]
    if "login" in rules:
        out += [(*m.span("v"), "value") for m in LOGIN.finditer(text) if plausible(m["v"], True)]
    if "note" in rules:  # user / password at the end of a comment
        out += [(*m.span("v"), "value") for m in NOTE.finditer(text) if plausible(m["v"], True) and re.search(r"[\d~!^*%&+]", m["v"]) and re.search("[A-Z]", m["v"]) and re.search("[a-z]", m["v"])]
    if "field" in rules:
        out += [(*m.span("v"), "value") for m in URL_FIELD.finditer(text) if plausible(m["v"], True)]
    if "header" in rules:
        out += [(*m.span("v"), "value") for m in HEADER.finditer(text) if plausible(m["v"], False) or (plausible(m["v"], True) and re.search(r"\d|=$", m["v"]) and re.search("[A-Z]", m["v"]))]
    if "shape" in rules:
        out += [(*m.span(), "sure") for m in SHAPES.finditer(text) if not (TEMPLATE.search(m[0]) or SHAPE_MARKERS.search(m[0])) and any(c.isdigit() for c in m[0])]
    if "pem" in rules:
        out += [(*m.span(), "pem") for m in PEM.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """The places of a text whose values look like secrets, as if no other text were known."""
    return [(a, e, kind) for a, e, kind in places(text) if looks_secret(text[a:e], kind)]


def literal_index(texts: DataFrame) -> DataFrame:
    """(value, kind, owner) of every literal in texts(body, owner, ...) that stands where a credential may stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(t[a:e], kind, o) for t, o in zip(b.column("body").to_pylist(), b.column("owner").to_pylist()) for a, e, kind in places(t)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["value", "kind", "owner"])

    return texts.select("body", "owner").mapInArrow(run, "value string, kind string, owner string")


# what the places of one value say of it together: the first that occurs
KINDS = ("pem", "sure", "phrase", "value", "weak", "tail")


def confirmed(index: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(value, kind, owners) of the literals that look like secrets, and that at most max_owners owners have unless they have a
    structure of their own. The part of a value that goes on in a further line counts with the rest of it."""
    order = F.least(*[F.when(F.col("kind") == k, F.lit(i)).otherwise(F.lit(len(KINDS))) for i, k in enumerate(KINDS)])
    values = index.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.min(order).alias("o")).where((F.col("o") < 2) | (F.col("owners") <= max_owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [looks_secret(v, KINDS[o]) for v, o in zip(b.column("value").to_pylist(), b.column("o").to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("o") + 1)
    return values.mapInArrow(run, "value string, owners bigint, o int").select("value", kind.alias("kind"), "owners")


@lru_cache(2)
def _automaton(folder: str, shard: int) -> object:
    import ahocorasick
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    where = f"{folder}/shard={shard}"
    files, path = FileSystem.from_uri(where if "://" in where else f"file://{where.removeprefix('file:')}")
    t = ds.dataset(path, filesystem=files, format="parquet").to_table(columns=["value", "kind"])
    a = ahocorasick.Automaton()
    for v, k in zip(t.column("value").to_pylist(), t.column("kind").to_pylist()):
        a.add_word(v, (len(v), k))
    a.make_automaton()
    return a


def begun(text: str, automaton: object) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the confirmed values in a text that begin where no word goes on."""
    hits = []
    for last, (n, kind) in automaton.iter(text):
        start = last + 1 - n
        if (start == 0 or not (text[start - 1].isalnum() and text[start].isalnum())) or text[start - 2 : start] in ("\\n", "\\t", "\\r"):
            hits.append((start, last + 1, kind))
    return hits


def longest(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of values that overlap the first, and of those that begin together the longest."""
    out: list[tuple[int, int, str]] = []
    for h in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with MASK in place of every found value; of a private key all lines go, their number stays."""
    parts, at = [], 0
    for a, b, kind in found:
        if a < at:
            continue
        if kind == "pem":
            head = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:\\n|\r?\n)").match(text, a)
            a = head.end() if head else a
            end = text.find("-----END", b)
            b = max(b, end if end >= 0 else len(text))
            body = re.sub(r"[A-Za-z0-9+/=]+(?![A-Za-z0-9+/=]*(?:\\n|\n)?-----)", lambda m: m[0] if len(m[0]) < 4 else MASK, text[a:b].replace("\\n", "\0")).replace("\0", "\\n")
            parts += [text[at:a], body]
        else:
            parts += [text[at:a], MASK]
        at = b
    return "".join([*parts, text[at:]])


def find_credentials(texts: DataFrame, max_owners: int = MAX_OWNERS, shard_size: int = SHARD, redact: bool = False) -> DataFrame:
    """Credentials in texts(tbl, row_key, owner, body), whose columns are strings; the owner is the text's repository, null for
    texts that only quote another's.

    Result: (tbl, row_key, line_no), line_no (bigint, from 1) being the line in which a value begins, one row a line; with
    redact instead (tbl, row_key, n_found, redacted), one row for each text with a value, each value replaced by MASK and
    all else unchanged. Null and empty texts give no rows; null owners are not counted; repeated rows count once. A value
    with no structure of its own may have max_owners owners, or OWNERS_SHARE of all if that is more.
    """
    rows = texts.where(F.col("body").isNotNull() & (F.col("body") != "")).select("tbl", "row_key", "owner", "body")
    known = settle(confirmed(literal_index(rows), max(max_owners, int(OWNERS_SHARE * rows.agg(F.countDistinct("owner")).first()[0]))), "secrets")
    n_shards = max(1, -(-known.count() // shard_size))
    folder = shared_folder(known.sparkSession, "credentials")
    known.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(n_shards))).repartition(n_shards, "shard").write.partitionBy("shard").parquet(folder)
    shards = [r.shard for r in known.sparkSession.read.parquet(folder).select("shard").distinct().collect()] if known.take(1) else []

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches as they come; where there are several shards, so many together that each is read a few times a task."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(shards) == 1 or size >= HELD_CHARS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            bodies = b.column("body").to_pylist()
            found: list[list[tuple[int, int, str]]] = [[] for _ in bodies]
            for s in shards:
                automaton = _automaton(folder, s)
                for hits, t in zip(found, bodies):
                    hits += begun(t, automaton)
            found = [longest(hits) for hits in found]
            out = []
            for i, (t, hits) in enumerate(zip(bodies, found)):
                if hits and redact:
                    out.append((i, len(hits), masked(t, hits)))
                elif hits:
                    out += [(i, n) for n in sorted({t.count("\n", 0, a) + 1 for a, _, kind in hits if kind != "tail"})]
            if out:
                where_, *rest = zip(*out)
                keys = [b.column(c).take(pa.array(where_)) for c in ("tbl", "row_key")]
                yield pa.RecordBatch.from_arrays(keys + ([pa.array(rest[0], pa.int32()), pa.array(rest[1], pa.string())] if redact else [pa.array(rest[0], pa.int64())]), names=["tbl", "row_key", *(("n_found", "redacted") if redact else ("line_no",))])

    out = rows.select("tbl", "row_key", "body").mapInArrow(run, "tbl string, row_key string, " + ("n_found int, redacted string" if redact else "line_no bigint"))
    return out.dropDuplicates(["tbl", "row_key"] if redact else ["tbl", "row_key", "line_no"])
