"""What a repository's document is made of: modules by the words in them, change candidates, capsules, interfaces, scores of sections and what can be said without a model.

Every function works on all repositories at once. A module is a scanned file; its
terms are its path and the names, imports, documentation and symbols of every scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.paths import normal_node_id
from repolith.functions.text import lines
from repolith.operators import history
from repolith.operators.repository import subsystem

# Words by which modules belong to a section, show an interface or keep data.
SECTION_TOKENS = {
    "data_state_management": ("state", "store", "cache", "repository", "session", "model", "schema", "queue", "db", "database"),
    "error_handling_robustness": ("error", "exception", "retry", "fallback", "guard", "validate", "timeout", "recover", "safe"),
    "performance_considerations": ("cache", "batch", "pool", "stream", "async", "parallel", "perf", "benchmark", "profile"),
    "security_considerations": ("auth", "oauth", "token", "secret", "credential", "encrypt", "decrypt", "hash", "secure", "permission", "acl", "tls", "jwt"),
    "limitations_constraints": ("limit", "constraint", "unsupported", "experimental", "fallback", "max", "min", "timeout"),
}
INTERFACE_TOKENS = {
    "http_api": ("api", "router", "route", "controller", "endpoint", "request", "response"),
    "cli_surface": ("cli", "command", "argparse", "click", "main"),
    "data_contract": ("request", "response", "model", "dto", "schema"),
    "library_surface": ("public", "exports", "export", "client", "sdk"),
}
INTERFACE_TITLES = {"http_api": "HTTP API", "cli_surface": "CLI Surface", "data_contract": "Data Contract", "library_surface": "Library Surface"}
STORE_TOKENS = ("store", "storage", "repository", "database", "db", "cache", "queue")
#: Words of a subsystem's role, in order, and the roles.
ROLES = {
    "request-entry boundary": ("api", "router", "route", "request"),
    "planning and coordination layer": ("engine", "planner", "plan", "orchestr"),
    "state and persistence boundary": ("storage", "repository", "state", "persist", "store"),
}
#: Words that tell which section a remark is about, in order of the sections.
REMARKS = {
    "dependencies": ("dependency", "package", "library", "runtime"), "build_development_infrastructure": ("build", "tooling", "test", "lint", "ci", "infra"),
    "interfaces": ("interface", "api", "endpoint", "contract", "consumer", "provider"), "system_context": ("context", "external", "system boundary", "runtime environment"),
    "subsystems_modules": ("subsystem", "module", "responsibility"), "architectural_overview": ("architecture", "architectural", "structure", "relationship"),
}
#: Words of data structures and of assumptions.
STRUCTURE_TOKENS = ("state", "config", "request", "response", "context", "model", "record", "queue", "cache", "graph", "node", "edge")
ASSUMPTION_TOKENS = ("must", "require", "assume", "unsupported", "fallback", "strict", "deterministic", "conservative", "only", "expects")
#: Words of phases of work, in order.
PHASES = ("parse", "load", "scan", "resolve", "validate", "plan", "build", "index", "merge", "execute", "run", "rank", "render", "save")
# Sentences that are told without a model, in pieces around what they tell of.
PURPOSE = ("This capsule captures the current algorithm behavior around `", "`.")
FLOW, NO_FLOW = "Current flow stages are reflected by the capsule phases: ", "Current flow evidence remains limited in this checkpoint capsule."
WINDOW = ("This interval window concentrates ", " signals across ", " commit(s).")
SUBSYSTEM = ("This subsystem groups active modules under `", "` and currently spans ", " files and ", " symbols.")
#: Sections that every document has.
CORE = ("introduction", "architectural_overview", "subsystems_modules", "dependencies", "build_development_infrastructure")


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that a text matches if it contains one of the words."""
    return "|".join(words)


def first_list(text: Column, lists: Mapping[str, tuple[str, ...]]) -> Column:
    """The name of the first list of which text contains a word, null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(lists.items()):
        out = F.when(text.rlike(any_of(words)), name).otherwise(out)
    return out


def module_rows(scan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, path, terms, scanned): lower-case terms of each scan and of each symbol node, one term a line."""
    told = scan.filter("path IS NOT NULL").select("csc_id", "path", F.lower(F.concat_ws("\n", "path", "functions", "classes", "imports", "docstrings")).alias("terms"), F.lit(True).alias("scanned"))
    symbols = nodes.filter("node_type = 'symbol' AND path IS NOT NULL AND symbol_name IS NOT NULL").select("csc_id", "path", F.lower(F.coalesce("qualified_name", "symbol_name")).alias("terms"), F.lit(False).alias("scanned"))
    return told.unionByName(symbols)


def module_hits(scan: DataFrame, nodes: DataFrame, lists: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(csc_id, path, subsystem_id, one boolean for each list): whether a term of the module contains a word of the list.

    Terms are matched before they are gathered, so only flags are shuffled.
    """
    flags = [F.max(F.col("terms").rlike(any_of(words))).alias(name) for name, words in lists.items()]
    hits = module_rows(scan, nodes).groupBy("csc_id", "path").agg(F.max("scanned").alias("scanned"), *flags).filter("scanned")
    return hits.select("csc_id", "path", subsystem(F.col("path")).alias("subsystem_id"), *lists)


def interface_kinds(scan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, path, subsystem_id, kind, title, interface_id) of modules that show an interface, by the first kind that fits; a package's `__init__.py` is a library surface."""
    hits = module_hits(scan, nodes, INTERFACE_TOKENS)
    kind = F.coalesce(*(F.when(F.col(k), k) for k in INTERFACE_TOKENS if k != "library_surface"), F.when(F.col("library_surface") | F.col("path").rlike(r"(^|/)__init__\.py$"), "library_surface"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")
    title = F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in INTERFACE_TITLES.items() for x in kv)), kind), F.lit(": "), F.initcap(F.translate(stem, "-", " ")))
    out = hits.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("title", title)
    slug = F.regexp_replace(F.regexp_replace(F.lower("path"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out.select("csc_id", "path", "subsystem_id", "kind", "title", F.concat_ws("::", F.lit("interface"), "kind", slug).alias("interface_id"))


def context_nodes(scan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, node_id, kind, title, modules, subsystems): the system of each repository, and its data stores where modules keep data."""
    hits = module_hits(scan, nodes, {"stores": STORE_TOKENS})
    every = hits.groupBy("csc_id").agg(F.count("*").alias("modules"), F.count_distinct("subsystem_id").alias("subsystems")).select(
        "csc_id", F.lit("context-node::system").alias("node_id"), F.lit("system").alias("kind"), F.concat("csc_id", F.lit(" System")).alias("title"), "modules", "subsystems")
    stores = hits.filter("stores").groupBy("csc_id").agg(F.count("*").alias("modules"), F.count_distinct("subsystem_id").alias("subsystems")).select(
        "csc_id", F.lit("context-node::data-store").alias("node_id"), F.lit("data_store").alias("kind"), F.lit("Data Stores").alias("title"), "modules", "subsystems")
    return every.unionByName(stores)


def changed_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, commit_id, path, at, begin, status, subsystem_id): files that commits changed, with what became of them.

    begin is the first mention of a commit of the repository. A file is retired if
    every span of its node has ended, introduced if its node is first recorded after
    begin, else modified.
    """
    files = history.commit_files(edges)
    begin = files.groupBy("csc_id").agg(F.min("at").alias("begin"))
    spans = nodes.filter("node_type = 'file'").groupBy("csc_id", F.substring(normal_node_id(F.col("node_id")), 7, 1 << 20).alias("path")).agg(F.min("recorded_at").alias("first_at"), F.min(F.col("removed_at").isNotNull()).alias("gone"))
    told = files.join(begin, "csc_id").join(spans, ["csc_id", "path"], "left")
    status = F.when(F.coalesce("gone", F.lit(False)), "retired").when(F.col("first_at") > F.col("begin"), "introduced").otherwise("modified")
    return told.select("csc_id", "commit_id", "path", "at", "begin", status.alias("status"), subsystem(F.col("path")).alias("subsystem_id"))


def first_status(status: Column) -> Column:
    """Of a group's statuses the first in precedence."""
    return F.min_by(status, F.array_position(F.array(*map(F.lit, history.STATUSES)), status))


def changed_names(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, path, names, changed): symbols of each changed file, and those whose span begins or ends after the interval's begin."""
    of = changed.select("csc_id", "path", "begin").distinct()
    symbols = nodes.filter("node_type = 'symbol' AND symbol_name IS NOT NULL").select("csc_id", "path", "symbol_name", "recorded_at", "removed_at")
    moved = (F.col("recorded_at") > F.col("begin")) | F.col("removed_at").isNotNull()
    return of.join(symbols, ["csc_id", "path"]).groupBy("csc_id", "path").agg(F.count_distinct("symbol_name").alias("names"), F.count_distinct(F.when(moved, F.col("symbol_name"))).alias("changed"))


def algorithm_candidates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, candidate_id, scope_kind, scope, subsystem_id, signals, commits, changed, variants) by four rules.

    A changed file with two changed names is multi_symbol; an introduced one
    with two symbols is introduced_module, and so is a subsystem that is introduced with two
    symbols; a subsystem of which two changed files name variants is a variant_family.
    """
    changed = changed_files(edges, nodes)
    per_file = changed.groupBy("csc_id", "path", "subsystem_id", "status").agg(F.count_distinct("commit_id").alias("commits")).join(changed_names(changed, nodes), ["csc_id", "path"], "left").fillna(0, ["names", "changed"])
    stem = F.regexp_replace(F.regexp_extract(F.lower("path"), r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")
    variant = F.when(stem.rlike(any_of(history.VARIANTS)), stem)
    per_subsystem = per_file.groupBy("csc_id", "subsystem_id").agg(first_status(F.col("status")).alias("status"), F.sum("names").alias("names"), F.sum("changed").alias("changed"), F.count_distinct(variant).alias("variants")).join(
        changed.groupBy("csc_id", "subsystem_id").agg(F.count_distinct("commit_id").alias("commits")), ["csc_id", "subsystem_id"])
    fresh = F.when((F.col("status") == "introduced") & (F.col("names") >= 2), "introduced_module")
    of_files = per_file.select("csc_id", F.concat(F.lit("algorithm::file::"), "path").alias("candidate_id"), F.lit("file").alias("scope_kind"), F.col("path").alias("scope"), "subsystem_id",
                               F.array_compact(F.array(fresh, F.when(F.col("changed") >= 2, "multi_symbol"))).alias("signals"), "commits", "changed", F.lit(0).cast("long").alias("variants"))
    of_subsystems = per_subsystem.select("csc_id", F.concat(F.lit("algorithm::subsystem::"), "subsystem_id").alias("candidate_id"), F.lit("subsystem").alias("scope_kind"), F.col("subsystem_id").alias("scope"), "subsystem_id",
                                         F.array_compact(F.array(fresh, F.when(F.col("variants") >= 2, "variant_family"))).alias("signals"), "commits", "changed", "variants")
    return of_files.unionByName(of_subsystems).filter(F.size("signals") > 0)


def capsules(candidates: DataFrame) -> DataFrame:
    """(csc_id, capsule_id, scope_kind, scope, subsystem_id, status, candidates, signals, changed, variants).

    A subsystem's candidate takes in the file candidates of the subsystem. A file
    elsewhere stands alone if it is both introduced and multi_symbol or has three
    changed names. introduced if one of its candidates is an introduced_module, else modified.
    """
    seeds = candidates.filter("scope_kind = 'subsystem'").select("csc_id", "subsystem_id").distinct().withColumn("seeded", F.lit(True))
    known = candidates.join(seeds, ["csc_id", "subsystem_id"], "left")
    both = F.array_contains("signals", "introduced_module") & F.array_contains("signals", "multi_symbol")
    taken = known.filter(F.col("seeded") | both | (F.col("changed") >= 3)).withColumn("whole", F.coalesce("seeded", F.lit(False)))
    scope = F.when(F.col("whole"), F.col("subsystem_id")).otherwise(F.col("scope"))
    kind = F.when(F.col("whole"), "subsystem").otherwise("file")
    grouped = taken.groupBy("csc_id", kind.alias("scope_kind"), scope.alias("scope"), "subsystem_id").agg(
        F.count("*").alias("candidates"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"),
        F.max(F.when(F.col("scope_kind") == F.when(F.col("whole"), "subsystem").otherwise("file"), F.col("changed"))).alias("changed"), F.max("variants").alias("variants"))
    status = F.when(F.array_contains("signals", "introduced_module"), "introduced").otherwise("modified")
    return grouped.select("csc_id", F.concat(F.lit("algorithm-capsule::"), "scope_kind", F.lit("::"), "scope").alias("capsule_id"), "scope_kind", "scope", "subsystem_id", status.alias("status"), "candidates", "signals", "changed", "variants")


def capped(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key by a total order, numbered in `n`."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= most)


def data_structures(scan: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """(csc_id, subsystem_id, name, kind, n): classes, then symbols, whose name tells of a data structure; the first by name of each subsystem."""
    classes = scan.filter("path IS NOT NULL").select("csc_id", subsystem(F.col("path")).alias("subsystem_id"), F.explode("classes").alias("name"), F.lit("class").alias("kind"))
    symbols = nodes.filter("node_type = 'symbol' AND path IS NOT NULL").select("csc_id", subsystem(F.col("path")).alias("subsystem_id"), F.col("symbol_name").alias("name"), F.lit("symbol").alias("kind"))
    named = classes.unionByName(symbols).filter(F.lower("name").rlike(any_of(STRUCTURE_TOKENS))).groupBy("csc_id", "subsystem_id", "name").agg(F.min("kind").alias("kind"))
    return capped(named, ["csc_id", "subsystem_id"], [F.lower("name"), F.col("name")], most)


def assumptions(scan: DataFrame, most: int = 5) -> DataFrame:
    """(csc_id, subsystem_id, text, n): lines of documentation that tell of an assumption, blanks made single; the first by text of each subsystem."""
    said = scan.filter("path IS NOT NULL").select("csc_id", subsystem(F.col("path")).alias("subsystem_id"), F.explode("docstrings").alias("doc")).select("csc_id", "subsystem_id", F.explode_outer(lines(F.col("doc"))).alias("line")).filter("line IS NOT NULL")
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    found = said.select("csc_id", "subsystem_id", text.alias("text")).filter((F.col("text") != "") & F.lower("text").rlike(any_of(ASSUMPTION_TOKENS))).distinct()
    return capped(found, ["csc_id", "subsystem_id"], [F.lower("text"), F.col("text")], most)


def section_scores(scan: DataFrame, nodes: DataFrame, edges: DataFrame, dependencies: DataFrame, build_sources: DataFrame) -> DataFrame:
    """(csc_id, section_id, kind, status, score, confidence, depth): the outline of each repository's document.

    build_sources: (csc_id, path, category). Core sections are always included. An
    optional one is included from a score of 5 with two pieces of evidence; strategy
    variants also wherever a family has two names. Interface changes that tell of robustness are changed
    header files with a symbol named so.
    """
    hits = module_hits(scan, nodes, SECTION_TOKENS)
    tokens = [F.count_if(F.col(s)).alias(s) for s in SECTION_TOKENS] + [F.count_distinct(F.when(F.col(s), F.col("subsystem_id"))).alias(f"{s}_areas") for s in SECTION_TOKENS]
    base = hits.groupBy("csc_id").agg(F.count("*").alias("modules"), F.count_distinct("subsystem_id").alias("subsystems"), *tokens)
    deps = dependencies.groupBy("csc_id").agg(F.count_distinct("normalized_key").alias("dependencies"), F.max("recorded_at").alias("last_dependency"))
    infra = build_sources.groupBy("csc_id").agg(F.count_distinct("path").alias("infra"))
    deltas = history.commit_deltas(edges, dependencies)
    has = lambda *kinds: F.arrays_overlap("signals", F.array(*map(F.lit, kinds)))
    commits = deltas.groupBy("csc_id").agg(F.max(has("architectural")).alias("arch"), F.max(has("architectural", "interface")).alias("shape"), F.max(has("dependency")).alias("dep"), F.max(has("infrastructure")).alias("infrastructure"),
                                           F.count_if(has("architectural", "interface", "dependency")).alias("rationale"))
    changed = changed_files(edges, nodes)
    face = F.col("path").rlike(r"\.(h|hpp|ts)$")
    lives = changed.groupBy("csc_id").agg(F.min("begin").alias("begin"), *(F.max((F.col("status") == s) & w).alias(f"{s}_{k}") for s in ("introduced", "retired") for k, w in (("subsystem", F.lit(True)), ("interface", face))))
    guarded = nodes.filter("node_type = 'symbol'").filter(F.lower(F.coalesce("qualified_name", "symbol_name")).rlike(any_of(SECTION_TOKENS["error_handling_robustness"]))).select("csc_id", "path").distinct()
    robust = changed.filter(face).select("csc_id", "path").distinct().join(guarded, ["csc_id", "path"], "left_semi").groupBy("csc_id").agg(F.count("*").alias("robust"))
    families = algorithm_candidates(edges, nodes).filter(F.array_contains("signals", "variant_family")).groupBy("csc_id").agg(F.count("*").alias("families"))
    a = base
    for other in (deps, infra, commits, lives, robust, families):
        a = a.join(other, "csc_id", "left")
    a = a.fillna(0, ["dependencies", "infra", "rationale", "robust", "families"])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    late = F.coalesce(F.col("last_dependency") > F.col("begin"), F.lit(False)).cast("int")
    least = lambda c, n: F.least(c if isinstance(c, Column) else F.col(c), F.lit(n))
    core = {"introduction": F.lit(10), "architectural_overview": 4 + least("subsystems", 3) + flag("arch") + (F.col("subsystems") >= 2).cast("int"), "subsystems_modules": 4 + least("subsystems", 2) + least(F.floor(F.col("modules") / 2), 3) + flag("shape"),
            "dependencies": 4 + least("dependencies", 3) + flag("dep"), "build_development_infrastructure": 4 + least("infra", 3) + flag("infrastructure")}
    optional = {s: (least(F.col(s) * 2, 6), F.col(s) + F.col(f"{s}_areas")) for s in SECTION_TOKENS}
    optional["error_handling_robustness"] = (optional["error_handling_robustness"][0] + least("robust", 2), optional["error_handling_robustness"][1] + F.col("robust"))
    optional["strategy_variants_design_alternatives"] = (F.when(F.col("families") > 0, 6).otherwise(0), F.col("families") * 2)
    bonus = least(flag("introduced_subsystem") + flag("introduced_interface") + late, 2) + least(flag("retired_subsystem") + flag("retired_interface"), 2)
    optional["design_notes_rationale"] = (least(F.col("rationale") * 2, 6) + F.when(F.col("begin").isNotNull(), bonus).otherwise(0), F.col("rationale") * 2)
    rows = [F.struct(F.lit(k).alias("section_id"), F.lit("core").alias("kind"), v.cast("long").alias("score"), F.lit(2).cast("long").alias("links")) for k, v in core.items()]
    rows += [F.struct(F.lit(k).alias("section_id"), F.lit("optional").alias("kind"), v.cast("long").alias("score"), n.cast("long").alias("links")) for k, (v, n) in optional.items()]
    t = a.select("csc_id", F.explode(F.array(*rows)).alias("x")).select("csc_id", "x.*")
    inside = (F.col("kind") == "core") | ((F.col("score") >= 5) & (F.col("links") >= 2))
    score = F.col("score")
    depth = F.when(F.col("section_id") == "introduction", "brief").when(F.col("kind") == "core", F.when(score <= 5, "brief").when(score <= 7, "standard").otherwise("deep")).when(inside, F.when(score <= 6, "brief").when(score <= 8, "standard").otherwise("deep"))
    confidence = F.when(F.col("kind") == "core", F.greatest(F.lit(60), F.least(F.lit(100), score * 10))).otherwise(F.least(F.lit(100), score * 10))
    return t.select("csc_id", "section_id", "kind", F.when(inside, "included").otherwise("omitted").alias("status"), "score", confidence.alias("confidence"), depth.alias("depth"))


def context_scores(scan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, section_id, status, score, depth) of the sections on the system's context and on interfaces."""
    stores = context_nodes(scan, nodes).groupBy("csc_id").agg(F.count_if(F.col("kind") != "system").alias("others"), F.max(F.when(F.col("kind") == "system", F.col("subsystems"))).alias("subsystems"))
    faces = interface_kinds(scan, nodes).groupBy("csc_id").agg(F.count("*").alias("faces"))
    a = stores.join(faces, "csc_id", "left").fillna(0, ["faces"])
    wide = F.col("subsystems") >= 2
    context = 4 + F.least("others", F.lit(2)) + wide.cast("int") + (F.col("faces") > 0).cast("int")
    faced = 4 + F.least("faces", F.lit(3)) + (F.col("faces") > 0).cast("int")
    rows = F.array(F.struct(F.lit("system_context").alias("section_id"), context.cast("long").alias("score"), ((F.col("others") > 0) | wide).alias("inside")),
                   F.struct(F.lit("interfaces").alias("section_id"), faced.cast("long").alias("score"), (F.col("faces") > 0).alias("inside")))
    t = a.select("csc_id", F.explode(rows).alias("x")).select("csc_id", "x.*")
    depth = F.when(F.col("inside"), F.when(F.col("score") <= 6, "brief").when(F.col("score") <= 8, "standard").otherwise("deep"))
    return t.select("csc_id", "section_id", F.when(F.col("inside"), "included").otherwise("omitted").alias("status"), "score", depth.alias("depth"))


def insights(edges: DataFrame, nodes: DataFrame, dependencies: DataFrame, most: int = 12) -> DataFrame:
    """(csc_id, insight_id, kind, title, subsystem_id, significance, n): what the interval's changes say, of four families, the first by (kind, title, insight_id).

    Significance comes from commits plus files, or plus changed names and variants of an algorithm.
    """
    changed = changed_files(edges, nodes)
    by = lambda *keys: changed.groupBy("csc_id", *keys).agg(first_status(F.col("status")).alias("status"), F.count_distinct("commit_id").alias("commits"), F.count_distinct("path").alias("files"))
    areas = by("subsystem_id").select("csc_id", F.col("subsystem_id").alias("change_id"), F.lit("subsystem_change").alias("kind"), F.concat(F.lit("Subsystem "), "status", F.lit(": "), F.regexp_replace("subsystem_id", "^subsystem::", "")).alias("title"), "subsystem_id", (F.col("commits") + F.col("files")).alias("score"))
    faces = by("path", "subsystem_id").filter(F.col("path").rlike(r"\.(h|hpp|ts)$")).select("csc_id", F.concat(F.lit("interface::"), "path").alias("change_id"), F.lit("interface_change").alias("kind"), F.concat(F.lit("Interface "), "status", F.lit(": "), "path").alias("title"), F.lit(None).cast("string").alias("subsystem_id"), F.col("commits").alias("score"))
    importing = dependencies.select("csc_id", F.col("source_path").alias("path")).distinct()
    deps = by("path", "subsystem_id").join(importing, ["csc_id", "path"], "left_semi").select("csc_id", F.concat(F.lit("dependency::"), "path").alias("change_id"), F.lit("dependency_change").alias("kind"), F.concat(F.lit("Dependency Change: "), "path").alias("title"), "subsystem_id", (F.col("commits") + F.col("files")).alias("score"))
    algorithms = algorithm_candidates(edges, nodes).select("csc_id", F.col("candidate_id").alias("change_id"), F.lit("algorithm_change").alias("kind"), F.concat(F.lit("Algorithm signal: "), "scope").alias("title"), "subsystem_id", (F.col("commits") + F.col("changed") + F.col("variants")).alias("score"))
    every = areas.unionByName(faces).unionByName(deps).unionByName(algorithms).withColumn("insight_id", F.concat(F.lit("interval-insight::"), F.regexp_replace(F.regexp_replace(F.lower("change_id"), "[^a-z0-9]+", "-"), "^-+|-+$", "")))
    told = every.select("csc_id", "insight_id", "change_id", "kind", "title", "subsystem_id", history.significance(F.col("score")).alias("significance"))
    return capped(told, ["csc_id"], [F.col("kind"), F.col("title"), F.col("insight_id"), F.col("change_id")], most).drop("change_id")


def design_notes(insights_: DataFrame, most: int = 8) -> DataFrame:
    """(csc_id, note_id, title, subsystem_id, n): of the most significant insights, later ids first, those that concern a subsystem."""
    weight = F.when(F.col("significance") == "high", 3).when(F.col("significance") == "medium", 2).otherwise(1)
    top = capped(insights_.drop("n"), ["csc_id"], [weight.desc(), F.desc("insight_id"), F.desc("title")], most)
    return top.filter("subsystem_id IS NOT NULL").select("csc_id", F.concat(F.lit("design-note::"), "insight_id").alias("note_id"), "title", "subsystem_id", "n")


def capsule_texts(capsules_: DataFrame, scan: DataFrame) -> DataFrame:
    """(csc_id, capsule_id, purpose, flow, variants): what can be said of a capsule without a model, from the phases that functions of its subsystem name."""
    named = scan.filter("path IS NOT NULL").select("csc_id", subsystem(F.col("path")).alias("subsystem_id"), F.explode("functions").alias("name"))
    hit = F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PHASES))), lambda x: F.contains(F.lower("name"), x["p"])))
    phases = named.select("csc_id", "subsystem_id", hit.alias("h")).distinct().groupBy("csc_id", "subsystem_id").agg(F.array_sort(F.collect_list("h")).alias("ph"))  # as many as there are phases
    flow = F.when(F.col("ph").isNull(), NO_FLOW).otherwise(
        F.concat(F.lit(FLOW), F.array_join(F.transform("ph", lambda x: F.concat(F.lit("`"), x["p"], F.lit("`"))), ", "), F.lit(".")))
    return capsules_.join(phases, ["csc_id", "subsystem_id"], "left").select("csc_id", "capsule_id", F.concat(F.lit(PURPOSE[0]), "scope", F.lit(PURPOSE[1])).alias("purpose"), flow.alias("flow"), "variants")


def window_texts(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(csc_id, window_id, commits, summary, significance): runs of strong commits in words."""
    strong = history.strong_commits(history.commit_deltas(edges, dependencies))
    runs = strong.groupBy("csc_id", "island").agg(F.min("i").alias("first"), F.count("*").alias("commits"), F.max("strength").alias("top"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"))  # sets of few signals
    number = F.row_number().over(Window.partitionBy("csc_id").orderBy("first"))
    summary = F.concat(F.lit(WINDOW[0]), F.when(F.size("signals") > 0, F.array_join("signals", ", ")).otherwise("logic"), F.lit(WINDOW[1]), "commits", F.lit(WINDOW[2]))
    return runs.select("csc_id", F.concat(F.lit("change-window::"), F.lpad(number.cast("string"), 2, "0")).alias("window_id"), "commits", summary.alias("summary"), history.significance(F.col("top")).alias("significance"))


def subsystem_texts(scan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(csc_id, subsystem_id, display_name, summary) of every subsystem."""
    m = scan.filter("path IS NOT NULL").select("csc_id", "path").distinct().groupBy("csc_id", subsystem(F.col("path")).alias("subsystem_id")).agg(F.count("*").alias("files"))
    s = nodes.filter("node_type = 'symbol' AND path IS NOT NULL").groupBy("csc_id", subsystem(F.col("path")).alias("subsystem_id")).agg(F.count_distinct(F.coalesce("qualified_name", "symbol_name")).alias("symbols"))
    name = F.regexp_replace("subsystem_id", "^subsystem::", "")
    summary = F.concat(F.lit(SUBSYSTEM[0]), name, F.lit(SUBSYSTEM[1]), "files", F.lit(SUBSYSTEM[2]), F.coalesce("symbols", F.lit(0)), F.lit(SUBSYSTEM[3]))
    return m.join(s, ["csc_id", "subsystem_id"], "left").select("csc_id", "subsystem_id", name.alias("display_name"), summary.alias("summary"))


def _concepts(scan: DataFrame) -> DataFrame:
    return scan.filter("path IS NOT NULL").select("csc_id", "path").distinct().withColumn("subsystem_id", subsystem(F.col("path")))


def evidence_ids(scan: DataFrame, nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(csc_id, family, id): everything that a draft may refer to; what it refers to beside is unknown."""
    m = _concepts(scan)
    parts = [m.select("csc_id", F.lit("subsystem").alias("family"), F.col("subsystem_id").alias("id")), m.select("csc_id", F.lit("module").alias("family"), F.concat(F.lit("module::"), "path").alias("id")),
             dependencies.filter("normalized_key IS NOT NULL").select("csc_id", F.lit("dependency").alias("family"), F.col("normalized_key").alias("id")),
             capsules(algorithm_candidates(edges, nodes)).select("csc_id", F.lit("capsule").alias("family"), F.col("capsule_id").alias("id")), insights(edges, nodes, dependencies).select("csc_id", F.lit("insight").alias("family"), F.col("insight_id").alias("id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def draft_summaries(scan: DataFrame, nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(csc_id, family, id, summary): concepts, capsules and dependencies in short."""
    of = _concepts(scan).groupBy("csc_id", "subsystem_id").agg(F.count("*").alias("n")).select("csc_id", F.lit("concept").alias("family"), F.col("subsystem_id").alias("id"), F.concat("n", F.lit(" modules")).alias("summary"))
    caps = capsules(algorithm_candidates(edges, nodes)).select("csc_id", F.lit("capsule").alias("family"), F.col("capsule_id").alias("id"), F.concat("status", F.lit(": "), F.array_join("signals", ", ")).alias("summary"))
    deps = dependencies.filter("normalized_key IS NOT NULL").groupBy("csc_id", "language", "normalized_key").agg(F.count_distinct("source_path").alias("n")).select(
        "csc_id", F.lit("dependency").alias("family"), F.concat(F.coalesce("language", F.lit("unknown")), F.lit("::"), "normalized_key").alias("id"), F.concat("n", F.lit(" modules")).alias("summary"))
    return of.unionByName(caps).unionByName(deps)


def partition_checks(scan: DataFrame, edges: DataFrame) -> DataFrame:
    """(csc_id, unknown, uncovered, shared, valid): sections taken for clusters of files: files that no scan knows, files of no cluster, and files of several; valid if there are none."""
    known = scan.filter("path IS NOT NULL").select("csc_id", F.concat(F.lit("file::"), "path").alias("id")).distinct().withColumn("k", F.lit(True))
    per = edges.filter("edge_type = 'documents' AND target_id LIKE 'file::%'").select("csc_id", F.col("target_id").alias("id"), "source_id").distinct().groupBy("csc_id", "id").agg(F.count("*").alias("clusters"))
    j = known.join(per, ["csc_id", "id"], "full_outer")
    unknown, uncovered, shared = F.col("k").isNull(), F.col("clusters").isNull(), F.coalesce(F.col("clusters") > 1, F.lit(False))
    return j.groupBy("csc_id").agg(F.count_if(unknown).alias("unknown"), F.count_if(uncovered).alias("uncovered"), F.count_if(shared).alias("shared"), (F.count_if(unknown | uncovered | shared) == 0).alias("valid"))


def known_links(scan: DataFrame, edges: DataFrame, dependencies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(csc_id, kind, reference): the closure of evidence links that judgments may cite."""
    of = lambda df, kind, reference: df.select("csc_id", kind.alias("kind"), reference.alias("reference")).filter("reference IS NOT NULL")
    return of(edges, F.col("edge_type"), F.col("target_id")).unionByName(of(scan, F.lit("file"), F.col("path"))).unionByName(of(dependencies, F.lit("dependency"), F.col("normalized_key"))).unionByName(of(chunks, F.lit("section"), F.col("section_id"))).distinct()
