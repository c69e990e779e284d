"""Import statements to module keys, and module keys to files of the same repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.text import stripped
from repolith.operators.repository import parent

#: Suffixes tried for a module without one, in order.
JS_TRIES = (".ts", ".tsx", ".js", ".mjs", ".cjs")
#: Suffixes of the files that a key of each language can name.
TARGETS = {"javascript": (".js", ".mjs", ".cjs", ".ts", ".tsx"), "typescript": (".js", ".mjs", ".cjs", ".ts", ".tsx"), "go": (".go",)}

_GOT = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))


# The forms of imports in each language; the first group is the module. Python names after `import ` are split at commas.
FORMS = {
    "python": r"^from\s+([A-Za-z0-9_\.]+)\s+import\s+",
    "js_from": r"import\s+.+?\s+from\s+['\"]([^'\"]+)['\"]",
    "js_bare": r"import\s+['\"]([^'\"]+)['\"]",
    "js_export": r"export\s+.+?\s+from\s+['\"]([^'\"]+)['\"]",
    "js_require": r"require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    "java": r"^import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;",
    "go": r"['\"]([^'\"]+)['\"]",
    "rust": r"^(?:pub\s+)?use\s+(.+);",
    "csharp": r"^(?:global\s+)?using\s+([A-Za-z0-9_.]+)\s*;",
    "cpp": r"^#\s*include\s*[<\"]([^>\"]+)[>\"]",
}


def module_keys(raw: Column, language: Column) -> Column:
    """The module keys of one import statement as structs (kind, key); none where the statement has another form."""
    s = stripped(raw)
    first = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x["key"].isNotNull())
    names = F.transform(F.split(F.substring(s, 8, 1 << 20), ","), lambda x: stripped(F.split(stripped(x), " as ")[0]))
    python = F.when(s.startswith("import "), F.transform(F.filter(names, lambda x: x != ""), lambda x: _GOT("import", x))).otherwise(some(_GOT("import", first(FORMS["python"]))))
    js = some(_GOT("import", first(FORMS["js_from"])), _GOT("import", first(FORMS["js_bare"])), _GOT("import", first(FORMS["js_export"])), _GOT("require", first(FORMS["js_require"])))
    use = stripped(F.split(stripped(F.split(first(FORMS["rust"]), " as ")[0]), r"\{")[0])
    return (F.when(language == "python", python).when(language.isin("javascript", "typescript"), js)
            .when(language == "java", some(_GOT("import", first(FORMS["java"]))))
            .when(language == "go", some(_GOT("import", first(FORMS["go"]))))
            .when(language == "rust", some(_GOT("use", F.nullif(F.regexp_replace(use, ":+$", ""), F.lit("")))))
            .when(language == "csharp", some(_GOT("using", first(FORMS["csharp"]))))
            .when(language == "cpp", some(_GOT("include", first(FORMS["cpp"])))))


def import_keys(scan: DataFrame) -> DataFrame:
    """(csc_id, path, language, raw, kind, key) of every import of every file, each once."""
    rows = scan.select("csc_id", "path", language_of(F.col("path")).alias("language"), F.explode("imports").alias("raw")).filter("raw IS NOT NULL").distinct()
    return rows.select("*", F.explode(module_keys(F.col("raw"), F.col("language"))).alias("m")).select("csc_id", "path", "language", stripped(F.col("raw")).alias("raw"), "m.kind", "m.key").distinct()


def only_one(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target): the target of each key that has exactly one."""
    return candidates.groupBy(*keys).agg(F.min("target").alias("target"), F.max("target").alias("other")).filter("target = other").drop("other")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def python_modules(files: DataFrame) -> DataFrame:
    """(csc_id, key, target): dotted tails of the paths of Python files, `__init__` being its folder, that name one file."""
    parts = F.split(F.regexp_replace(_stem(F.col("path")), "/?__init__$", ""), "/")
    py = files.filter(F.col("path").endswith(".py")).select("csc_id", F.col("path").alias("target"), parts.alias("p")).filter(F.array_join("p", "") != "")
    tails = py.select("csc_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("key"))
    return only_one(tails.distinct(), ["csc_id", "key"])


def normal_relative(base: Column, key: Column) -> Column:
    """The path that key names from the directory base, with `.` and `..` resolved; a leading `/` begins at the top."""
    joined = F.when(key.startswith("/"), F.regexp_replace(key, "^/+", "")).when(base == ".", key).otherwise(F.concat(base, F.lit("/"), key))
    walked = F.aggregate(F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"),
                         lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.array_join(walked, "/")


def relative_targets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, path, key, target, status) of keys that begin with `.` or `/`: the first candidate path, by suffix and then by index file, that is a file."""
    base = keys.withColumn("base", normal_relative(parent(F.col("path")), F.col("key")))
    tries = F.when(F.col("language") == "go", F.array(F.lit(".go"))).otherwise(F.array(*map(F.lit, JS_TRIES)))
    named = F.transform(F.concat(tries, F.transform(tries, lambda t: F.concat(F.lit("/index"), t))), lambda t: F.concat(F.col("base"), t))
    candidates = F.when(F.col("base").rlike(r"[^/]\.[^./]+$"), F.array("base")).otherwise(named)
    probed = base.select("csc_id", "path", "key", F.col("base").rlike(r"[^/]\.[^./]+$").alias("exact"), F.posexplode(candidates).alias("pos", "target"))
    found = probed.join(files.select("csc_id", F.col("path").alias("target")), ["csc_id", "target"])
    return found.groupBy("csc_id", "path", "key").agg(F.min(F.struct("pos", "target", "exact")).alias("f")).select(
        "csc_id", "path", "key", "f.target", F.when(F.col("f.exact"), "resolved_exact").otherwise("resolved_heuristic").alias("status"))


def suffix_targets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, language, key, target) of other keys: the one file named by the key, else the one file among all index keys that end with it.

    Index keys of a file are its path and its name without suffix, and its folder
    for an index file. A key with `/` can only end an index key with the same last
    segment, one without only a last segment, so ends are compared within equal
    last segments and never across the whole index.
    """
    rows = []
    for language, ends in (("javascript", TARGETS["javascript"]), ("typescript", TARGETS["typescript"]), ("go", TARGETS["go"])):
        own = files.filter(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*ends))
        stem, name = _stem(F.col("path")), F.regexp_extract(_stem(F.col("path")), r"([^/]+)$", 1)
        extra = F.when((name == "index") & F.col("path").contains("/"), parent(F.col("path")))
        rows.append(own.select("csc_id", F.lit(language).alias("language"), F.col("path").alias("target"), F.explode(F.array_compact(F.array_distinct(F.array(stem, name, extra)))).alias("index_key")))
    index = rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()
    wanted = keys.select("csc_id", "language", "key").distinct()
    on = ["csc_id", "language", "key"]
    direct = only_one(wanted.join(index.withColumnRenamed("index_key", "key"), on), on)
    rest = wanted.join(direct, on, "left_anti").withColumn("last", F.regexp_extract("key", r"([^/]*)$", 1))
    last = F.regexp_extract("index_key", r"([^/]+)$", 1)
    ends = index.withColumn("last", last)
    deep = rest.filter(F.col("key").contains("/")).join(ends, ["csc_id", "language", "last"]).filter(F.expr("endswith(index_key, key)")).select(*on, "target")
    tails = ends.select("csc_id", "language", "target", F.explode(F.transform(F.sequence(F.lit(1), F.length("last")), lambda i: F.substring(F.col("last"), i, F.length("last")))).alias("key"))
    flat = rest.filter(~F.col("key").contains("/")).select(*on).join(tails, on).select(*on, "target")
    return direct.unionByName(only_one(deep.unionByName(flat).distinct(), on))


def rust_targets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, path, key, target): the one file that a crate, self or super path, or the path above it, can be."""
    rs = files.filter(F.col("path").endswith(".rs"))
    roots = rs.filter(F.col("path").rlike("(^|/)(lib|main)\\.rs$")).select("csc_id", parent(F.col("path")).alias("root")).distinct()
    all_roots = roots.unionByName(rs.select("csc_id").distinct().join(roots, "csc_id", "left_anti").withColumn("root", F.lit(".")))
    k = keys.filter(F.col("key").rlike("^(crate|self|super)::"))
    tail = F.replace(F.regexp_replace("key", "^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    here, above = parent(F.col("path")), F.coalesce(parent(parent(F.col("path"))), F.lit("."))
    crate = k.filter(F.col("key").startswith("crate::")).join(all_roots, "csc_id").select("csc_id", "path", "key", normal_relative(F.col("root"), tail).alias("base"))
    other = k.filter(~F.col("key").startswith("crate::")).select("csc_id", "path", "key", normal_relative(F.when(F.col("key").startswith("self::"), here).otherwise(above), tail).alias("base"))
    up = F.when(F.col("base").contains("/"), parent(F.col("base")))
    both = crate.unionByName(other).select("csc_id", "path", "key", F.explode(F.array_compact(F.array("base", up))).alias("b"))
    tried = both.select("csc_id", "path", "key", F.explode(F.array(F.concat("b", F.lit(".rs")), F.concat("b", F.lit("/mod.rs")))).alias("target"))
    return only_one(tried.distinct().join(files.select("csc_id", F.col("path").alias("target")), ["csc_id", "target"]), ["csc_id", "path", "key"])


def include_targets(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, path, key, target, status) of quoted includes: the one file at the place named from the file or from the top, else the one file of that name."""
    on = ["csc_id", "path", "key"]
    places = keys.select(*on, F.explode(F.array_distinct(F.array(normal_relative(parent(F.col("path")), F.col("key")), normal_relative(F.lit("."), F.col("key"))))).alias("target"))
    exact = only_one(places.join(files.select("csc_id", F.col("path").alias("target")), ["csc_id", "target"]), on).withColumn("status", F.lit("resolved_exact"))
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    by_name = only_one(files.select("csc_id", name("path").alias("name"), F.col("path").alias("target")), ["csc_id", "name"])
    rest = keys.select(*on).join(exact, on, "left_anti").withColumn("name", name("key")).join(by_name, ["csc_id", "name"])
    return exact.unionByName(rest.select(*on, "target", F.lit("resolved_heuristic").alias("status")))


def namespace_files(scan: DataFrame) -> DataFrame:
    """(csc_id, key, target): C# namespaces declared in one file only."""
    cs = scan.filter(F.col("path").endswith(".cs") & F.col("text").isNotNull())
    rows = cs.select("csc_id", F.col("path").alias("target"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*namespace\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))).alias("key"))
    return only_one(rows.distinct(), ["csc_id", "key"])


def java_types(scan: DataFrame) -> DataFrame:
    """(csc_id, key, target): classes of Java files with the package that the file declares, where one file has them."""
    package = F.regexp_extract(F.array_join(F.filter("imports", lambda x: x.rlike(r"^\s*package\s")), "\n"), r"package\s+([A-Za-z0-9_.]+)\s*;", 1)
    told = F.when(package != "", package).otherwise(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^\s*package\s+([A-Za-z0-9_.]+)\s*;", 1))
    java = scan.filter(F.col("path").endswith(".java")).select("csc_id", F.col("path").alias("target"), told.alias("package"), F.explode("classes").alias("name"))
    return only_one(java.select("csc_id", F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")).alias("key"), "target").distinct(), ["csc_id", "key"])


def resolved(scan: DataFrame) -> DataFrame:
    """(csc_id, path, language, raw, kind, key, status, target) of every import of every file.

    status is resolved_exact, resolved_heuristic or unresolved, with null target.
    Each rule is an equi join within the repository on a key of bounded fan-out;
    a key that could name several files stays unresolved.
    """
    files = scan.select("csc_id", "path").filter("path IS NOT NULL").distinct()
    keys = import_keys(scan)
    lit, on = F.lit, ["csc_id", "path", "key"]
    js = keys.filter(F.col("language").isin("javascript", "typescript", "go"))
    dotted = F.col("key").startswith(".") | F.col("key").startswith("/")
    by_key = lambda language, index: keys.filter(F.col("language") == language).select(*on).distinct().join(index, ["csc_id", "key"]).select(*on, "target", lit("resolved_exact").alias("status"))
    hits = [
        by_key("python", python_modules(files)), by_key("java", java_types(scan)), by_key("csharp", namespace_files(scan)),
        relative_targets(js.filter(dotted), files).select(*on, "target", "status"),
        js.filter(~dotted).select(*on, "language").distinct().join(suffix_targets(js.filter(~dotted), files), ["csc_id", "language", "key"]).select(*on, "target", lit("resolved_heuristic").alias("status")),
        rust_targets(keys.filter("language = 'rust'"), files).select(*on, "target", lit("resolved_exact").alias("status")),
        include_targets(keys.filter(F.col("raw").rlike(r'^#\s*include\s*"')).select(*on).distinct(), files).select(*on, "target", "status"),
    ]
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    angled = F.col("raw").rlike(r"^#\s*include\s*<")
    joined = keys.join(found.distinct(), on, "left")
    return joined.select("csc_id", "path", "language", "raw", "kind", "key", F.when(angled | F.col("target").isNull(), "unresolved").otherwise(F.col("status")).alias("status"), F.when(~angled, F.col("target")).alias("target")).distinct()
