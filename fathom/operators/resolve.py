"""Symbol resolution as a cascade: every rule says where a name is looked up, one join looks all of them up, and the first
rule that finds something wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.paths import display_path, folder, module_parts, module_suffixes, normalize_path
from fathom.sources.tables import settle

SELF, DOTTED, SAME_FILE, FROM_IMPORT, IMPORTED_MODULE, UNIQUE_METHOD, FALLBACK = range(1, 8)
# places of lookups that are no file: names that only one chunk of the repository has, or only one method, and files by normal path
ONLY, METHOD, NEAR, ANYWHERE = "\0only", "\0method", "\0near:", "\0any"


def first_rule(candidates: DataFrame, keys: tuple[str, ...], rule: str = "rule") -> DataFrame:
    """The candidates of each key's first rule."""
    return candidates.withColumn("_first", F.min(rule).over(Window.partitionBy(*keys))).where(F.col(rule) == F.col("_first")).drop("_first")


def symbols(chunks: DataFrame) -> DataFrame:
    """(repo, file, key, dst): every chunk under its name and, if it has a parent, under Parent.name."""
    base = chunks.select("repo", display_path(F.col("file_path")).alias("file"), "name", "parent", F.col("id").alias("dst"))
    keys = F.array_compact(F.array("name", F.when(F.col("parent").isNotNull() & (F.col("parent") != ""), F.concat_ws(".", "parent", "name"))))
    return base.select("repo", "file", F.explode(F.array_distinct(keys)).alias("key"), "dst")


def module_files(chunks: DataFrame) -> DataFrame:
    """(repo, module, target_file, target_dir): every dotted name under which a file may be imported."""
    files = chunks.select("repo", display_path(F.col("file_path")).alias("target_file")).distinct()
    return files.select("repo", "target_file", folder(F.col("target_file")).alias("target_dir"), F.explode(F.array_distinct(module_suffixes(F.col("target_file")))).alias("module"))


def parse_imports(chunks: DataFrame) -> DataFrame:
    """(repo, file, kind, local, target, ord): what each import line of a file binds. kind is module or symbol.

    Chunks of one file may repeat its imports; of two bindings of one name the later holds.
    """
    line = F.trim(F.col("line"))
    rows = chunks.select("repo", display_path(F.col("file_path")).alias("file"), "imports").distinct()
    rows = rows.select("repo", "file", F.posexplode("imports").alias("line_no", "line")).where(line.isNotNull() & (line != ""))
    plain = line.rlike(r"^import\s+\S")
    module = F.regexp_extract(line, r"^from\s+(\S+)\s+import\s", 1)
    listed = F.when(plain, F.regexp_replace(line, r"^import\s+", "")).otherwise(F.regexp_replace(F.regexp_replace(line, r"^from\s+\S+\s+import\s+", ""), r"^\(|\)$", ""))
    rows = rows.where(plain | (module != "")).select("repo", "file", "line_no", F.when(plain, "module").otherwise("symbol").alias("kind"), module.alias("module"), F.posexplode(F.split(listed, ",")).alias("n", "item"))
    item, alias = (F.regexp_extract(F.trim(F.col("item")), r"^(\S+)(?:\s+as\s+(\S+))?$", i) for i in (1, 2))
    whole = F.col("kind") == "module"
    local = F.when(alias != "", alias).when(whole, F.try_element_at(F.split(item, r"\."), F.lit(-1))).otherwise(item)
    target = F.when(whole, item).otherwise(F.concat("module", F.when(F.endswith("module", F.lit(".")), F.lit("")).otherwise(F.lit(".")), item))
    both = rows.where(whole | (F.trim("item") != "")).select("repo", "file", "kind", local.alias("local"), target.alias("target"), "line_no", "n")
    last = Window.partitionBy("repo", "file", "kind", "local").orderBy(F.col("line_no").desc(), F.col("n").desc())
    # all bindings of a file stay together, which the resolution makes use of
    return both.repartition("repo", "file").withColumn("_r", F.row_number().over(last)).where("_r = 1").select("repo", "file", "kind", "local", "target", (F.col("line_no") * 1000 + F.col("n")).alias("ord"))


def absolute_module(module: Column, file: Column) -> Column:
    """A module's dotted path; leading dots are resolved against the package of the importing file."""
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda p: p != "")
    parts = module_parts(file)
    is_package = display_path(file).rlike(r"(^|/)__init__\.[^/]*$")
    package = F.when(is_package, parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    kept = F.slice(package, 1, F.greatest(F.size(package) - F.greatest(level - 1, F.lit(0)), F.lit(0)))
    return F.array_join(F.when(level > 0, F.concat(kept, rest)).otherwise(rest), ".")


def unique_files(chunks: DataFrame) -> DataFrame:
    """(repo, module, dir, target_file): the file that a dotted name stands for if it is the only one of that name in the
    repository (dir is ANYWHERE), or the only one in a folder."""
    files = module_files(chunks).select("repo", "module", "target_file", F.explode(F.array(F.lit(ANYWHERE), "target_dir")).alias("dir"))
    return files.groupBy("repo", "module", "dir").agg(F.count("*").alias("_n"), F.min("target_file").alias("target_file")).where("_n = 1").drop("_n")


def imported_places(bound: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, places): for every file the files that its imports stand for, each (of, local, key, target_file).

    of is head for what the first part of a dotted name means (a module before a symbol), member for modules whose members
    may be meant, from for a symbol whose name there is key. A module that several files may be stands for the one in the
    importing file's folder, or for nothing.
    """
    c = F.col
    by_local = Window.partitionBy("repo", "file", "local")
    whole = c("kind") == "module"
    last = F.regexp_extract("target", r"([^.]+)$", 1)
    package = absolute_module(F.regexp_replace("target", r"(?<=[^.])\.[^.]+$|(?<=\.)[^.]+$", ""), c("file"))
    rows = bound.withColumn("is_head", whole | ~F.max(whole).over(by_local)).withColumn("module", absolute_module(c("target"), c("file")))
    wanted = lambda of, module, key: F.struct(F.lit(of).alias("of"), key.alias("key"), module.alias("module"))
    none = F.lit(None).cast("string")
    asked = F.array_compact(F.array(F.when(c("is_head"), wanted("head", c("module"), none)), F.when(whole | (last == c("local")), wanted("member", c("module"), none)), F.when(~whole, wanted("from", package, last))))
    rows = rows.select("repo", "file", "local", F.explode(asked).alias("w")).where("w.module <> ''")
    rows = rows.select("repo", "file", "local", "w.of", "w.key", "w.module", F.explode(F.array(F.lit(ANYWHERE), folder(c("file")))).alias("dir"))
    return rows.join(files, ["repo", "module", "dir"]).groupBy("repo", "file").agg(F.collect_set(F.struct("of", "local", "key", "target_file")).alias("places"))


def dependencies(chunks: DataFrame) -> DataFrame:
    """(repo, file, src, parent, dep_ord, dep, head, tail, parts): the named dependencies of every chunk."""
    rows = chunks.select("repo", display_path(F.col("file_path")).alias("file"), F.col("id").alias("src"), "parent", F.posexplode("dependencies").alias("dep_ord", "dep"))
    parts = F.filter(F.split("dep", r"\."), lambda p: p != "")
    rows = rows.withColumn("dep", F.trim("dep")).where(F.col("dep").isNotNull() & (F.col("dep") != ""))
    return rows.withColumn("head", F.try_element_at(parts, F.lit(1))).withColumn("tail", F.try_element_at(parts, F.lit(-1))).withColumn("parts", F.size(parts))


def targets(base: DataFrame) -> DataFrame:
    """(repo, place, key, dst): what a lookup of a key in a place finds. Places are files, and those that are none."""
    names = symbols(base)
    near = F.concat(F.lit(NEAR), normalize_path(F.col("file")))
    in_files = names.select("repo", F.explode(F.array("file", near)).alias("place"), "key", "dst")
    only = names.groupBy("repo", "key").agg(F.min("dst").alias("dst"), F.max("dst").alias("_m")).where("dst = _m").select("repo", F.lit(ONLY).alias("place"), "key", "dst")
    methods = base.where("chunk_type = 'method'").groupBy("repo", F.col("name").alias("key")).agg(F.min("id").alias("dst"), F.max("id").alias("_m")).where("dst = _m").select("repo", F.lit(METHOD).alias("place"), "key", "dst")
    return in_files.unionByName(only).unionByName(methods)


def edges(chunks: DataFrame) -> DataFrame:
    """(src, dep_ord, dep, matched_name, dst, rule): what the dependencies of chunks(id, repo, file_path, chunk_type, name,
    parent, imports, dependencies) stand for.

    Rules in order: a method of the own class; a member of the module or symbol that the first part names; a symbol of the same
    file; a symbol bound by a from-import; a member of exactly one imported module; the only method of that name; a name that
    is unique in the repository or found in the same file. Ambiguity gives no edge; a chunk is no dependency of itself.
    Null ids and names take no part, repeated rows count once; a null repo is one repository. Blank dependencies give nothing.
    A name that many chunks depend on makes one side of the lookup large, which adaptive execution splits: the other side has
    one row for it.
    """
    c = F.col
    empty = F.array().cast("array<string>")
    base = chunks.where(c("id").isNotNull() & c("name").isNotNull()).select("id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("file_path", F.lit("")).alias("file_path"), "chunk_type", "name", "parent", F.coalesce("imports", empty).alias("imports"), F.coalesce("dependencies", empty).alias("dependencies")).dropDuplicates(["id"])
    base = settle(base, "symbols")
    places = imported_places(parse_imports(base), unique_files(base))
    deps = dependencies(base).join(places, ["repo", "file"], "left")
    lookup = lambda place, key, rule: F.struct(place.alias("place"), key.alias("key"), F.lit(rule).alias("rule"))
    of = lambda kind, fits, key, rule: F.transform(F.filter(F.coalesce("places", F.array().cast(deps.schema["places"].dataType)), lambda p: (p["of"] == kind) & fits(p)), lambda p: lookup(p["target_file"], key(p), rule))
    dotted = c("parts") >= 2
    own = dotted & c("head").isin("self", "cls") & c("parent").isNotNull() & (c("parent") != "")
    wanted = F.concat(
        F.array_compact(F.array(
            F.when(own, lookup(c("file"), F.concat_ws(".", "parent", "tail"), SELF)), lookup(c("file"), c("dep"), SAME_FILE), lookup(F.lit(METHOD), c("dep"), UNIQUE_METHOD),
            lookup(F.lit(ONLY), c("dep"), FALLBACK), lookup(F.concat(F.lit(NEAR), normalize_path(c("file"))), c("dep"), FALLBACK),
        )),
        of("head", lambda p: dotted & (p["local"] == c("head")), lambda p: c("tail"), DOTTED),
        of("from", lambda p: p["local"] == c("dep"), lambda p: p["key"], FROM_IMPORT),
        F.array_distinct(of("member", lambda p: F.lit(True), lambda p: c("dep"), IMPORTED_MODULE)),
    )
    asked = deps.select("repo", "src", "dep_ord", "dep", F.explode(wanted).alias("w")).select("repo", "src", "dep_ord", "dep", "w.place", "w.key", "w.rule")
    found = asked.join(targets(base), ["repo", "place", "key"]).select("src", "dep_ord", "dep", c("key").alias("matched_name"), "dst", "rule")
    w = Window.partitionBy("src", "dep_ord")
    found = found.repartition("src", "dep_ord").distinct().withColumn("_members", F.count_if(c("rule") == IMPORTED_MODULE).over(w))
    found = found.where((c("rule") != IMPORTED_MODULE) | (c("_members") == 1)).drop("_members")
    best = first_rule(found, ("src", "dep_ord")).where(c("src") != c("dst"))
    return best.select("src", "dep_ord", "dep", "matched_name", "dst", "rule").dropDuplicates(["src", "dep_ord", "dst"])
