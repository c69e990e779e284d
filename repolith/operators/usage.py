"""Which modules use which external packages, and what can be said of it without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.operators.repository import subsystem

# Ecosystems whose imports name packages reliably, roles that may be told of together, and what is known of packages by name and by words in it.
RELIABLE = ("python", "javascript", "typescript", "rust", "go")
GROUPABLE = ("build", "development", "test", "plugin", "toolchain")
GROUP_TITLES = {"build": "Build Tooling", "development": "Development Tooling", "test": "Test Tooling", "plugin": "Plugin Tooling", "toolchain": "Toolchain Dependencies"}
KNOWN = {
    "requests": "requests is a Python HTTP client library commonly used for outbound web requests.", "pydantic": "pydantic is a Python data validation and settings library centered on typed models.",
    "pytest": "pytest is a Python test runner and assertion framework.", "pytest-cov": "pytest-cov is a pytest plugin used to collect and report test coverage.",
    "react": "react is a JavaScript library for building component-based user interfaces.", "eslint": "eslint is a JavaScript and TypeScript linting tool.",
    "ruff": "ruff is a Python linter and formatter used to enforce style and catch static issues quickly.",
}
KNOWN_WORDS = {
    "pytest": "This package is commonly used to define and run automated Python tests.", "eslint": "This package is commonly used to lint JavaScript and TypeScript source code.",
    "react": "This package is commonly used to build reactive component-based web interfaces.", "request": "This package is commonly used to issue HTTP requests to remote services.",
    "http": "This package is commonly used to communicate with HTTP services.", "schema": "This package is commonly used to validate or define structured data.", "test": "This package is commonly used in automated test workflows.",
}
# Sentences on a package and on its use, behind the package's name or in pieces.
PYTHON_PACKAGE, OTHER_PACKAGE, DIRECT = " is a Python package used in this ecosystem.", (" is a ", " package used in this ecosystem."), " is a direct dependency declared for this project."
USED = ("Observed usage signals include `", "`; linked modules: ", "; linked subsystems: ")
NO_USE = "Project-specific usage is not strongly evidenced by the current manifests and import signals."


def package_name(ecosystem: Column, name: Column) -> Column:
    """A package's name in lower case, with `-` for `_` where the ecosystem takes both."""
    return F.when(ecosystem.isin("python", "rust"), F.translate(F.lower(name), "_", "-")).when(ecosystem.isNull(), name).otherwise(F.lower(name))


def entries(dependencies: DataFrame) -> DataFrame:
    """(csc_id, ecosystem, package, name, role): external packages, those of records that resolve to nothing inside. role is `test` where only test files name the package, else `runtime`."""
    r = dependencies.filter((F.lower(F.trim("resolution_status")) == "unresolved") & F.col("normalized_key").isNotNull())
    told = r.groupBy("csc_id", F.col("language").alias("ecosystem"), F.col("normalized_key").alias("package")).agg(F.min(F.coalesce(F.col("source_path").rlike(r"(^|/)[^/]*test[^/]*$"), F.lit(False))).alias("only_tests"))
    return told.select("csc_id", "ecosystem", "package", package_name(F.col("ecosystem"), F.col("package")).alias("name"), F.when(F.col("only_tests"), "test").otherwise("runtime").alias("role"))


def import_tokens(scan: DataFrame) -> DataFrame:
    """(csc_id, path, token): what an import may mean, its words and what stands before the first `::`, `/` or `.` of each."""
    words = scan.select("csc_id", "path", F.explode("imports").alias("raw")).select("csc_id", "path", F.explode(F.regexp_extract_all("raw", F.lit("[@A-Za-z0-9_./:-]+"), F.lit(0))).alias("t"))
    head = lambda mark, ok: F.when(F.col("t").contains(mark) & ok, F.split_part("t", F.lit(mark), F.lit(1)))
    every = F.array_compact(F.array("t", head("::", F.lit(True)), head("/", ~F.col("t").startswith("@")), head(".", F.lit(True))))
    return words.select("csc_id", "path", F.explode(every).alias("token")).filter(~F.col("token").isin("", "from", "import", "use", "as")).distinct()


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def usage(scan: DataFrame, dependencies: DataFrame) -> DataFrame:
    """entries with modules, subsystems and first_module that use them.

    Only reliable ecosystems are matched. A token matches a package of its name; of
    Go also packages below and above it. Modules are counted for each token of a
    repository before packages meet them, so a token of every module joins as one row; only Go
    paths, which match several tokens, meet as pairs.
    """
    e = entries(dependencies)
    t = import_tokens(scan).withColumn("subsystem_id", subsystem(F.col("path")))
    told = lambda df, *keys: df.groupBy(*keys).agg(F.count_distinct("path").alias("modules"), F.count_distinct("subsystem_id").alias("subsystems"), F.min("path").alias("first_module"))
    plain = e.filter(F.col("ecosystem").isin(*(x for x in RELIABLE if x != "go")))
    forms = t.select("csc_id", "path", "subsystem_id", F.explode(F.array_distinct(F.array(F.struct(F.lit(True).alias("dashed"), F.translate(F.lower("token"), "_", "-").alias("name")), F.struct(F.lit(False).alias("dashed"), F.lower("token").alias("name"))))).alias("x")).select("csc_id", "path", "subsystem_id", "x.*")
    used = plain.withColumn("dashed", F.col("ecosystem").isin("python", "rust")).join(told(forms, "csc_id", "dashed", "name"), ["csc_id", "dashed", "name"]).drop("dashed")
    go = e.filter("ecosystem = 'go'")
    lower = t.select("csc_id", "path", "subsystem_id", F.lower("token").alias("token"))
    below = go.join(lower.withColumn("name", F.explode(_prefixes(F.col("token")))).select("csc_id", "path", "subsystem_id", "name").distinct(), ["csc_id", "name"])
    above = go.withColumn("token", F.explode(_prefixes(F.col("name")))).join(lower, ["csc_id", "token"]).drop("token")
    keys = ["csc_id", "ecosystem", "package", "name", "role"]
    used_go = told(below.select(*keys, "path", "subsystem_id").unionByName(above.select(*keys, "path", "subsystem_id")), *keys)
    found = used.select(*keys, "modules", "subsystems", "first_module").unionByName(used_go)
    none = e.select(*keys, F.lit(0).cast("long").alias("modules"), F.lit(0).cast("long").alias("subsystems"), F.lit(None).cast("string").alias("first_module"))
    return none.unionByName(found).groupBy(*keys).agg(F.max("modules").alias("modules"), F.max("subsystems").alias("subsystems"), F.max("first_module").alias("first_module"))


def gates(used: DataFrame) -> DataFrame:
    """used with reliable, groupable, strong: whether the ecosystem's imports count, the role may be told of in a group, and modules are known to use the package."""
    return used.withColumns({"reliable": F.coalesce(F.col("ecosystem").isin(*RELIABLE), F.lit(False)), "groupable": F.col("role").isin(*GROUPABLE), "strong": F.col("modules") > 0})


def narratives(used: DataFrame) -> DataFrame:
    """(csc_id, ecosystem, package, section_target, render_style, group_title, general, usage, basis): what is known of a package and of its use here."""
    g = gates(used)
    name = F.col("name")
    general = F.lit(None).cast("string")
    own = F.when(F.col("ecosystem") == "python", F.concat("package", F.lit(PYTHON_PACKAGE))).when(
        F.col("ecosystem").isin("javascript", "typescript"), F.concat("package", F.lit(OTHER_PACKAGE[0]), "ecosystem", F.lit(OTHER_PACKAGE[1]))).otherwise(F.concat("package", F.lit(DIRECT)))
    for word, text in reversed(KNOWN_WORDS.items()):
        general = F.when(name.contains(word), text).otherwise(general)
    for known, text in KNOWN.items():
        general = F.when(name == known, text).otherwise(general)
    target = F.when(F.col("role").isin("runtime", "peer", "optional"), "dependencies").otherwise("build_development_infrastructure")
    grouped = (target == "build_development_infrastructure") & ~F.col("strong") & F.col("groupable")
    title = F.element_at(F.create_map(*(F.lit(x) for kv in GROUP_TITLES.items() for x in kv)), F.col("role"))
    prefix = F.when(F.col("ecosystem").isNotNull() & ~F.col("ecosystem").isin("unknown", ""), F.concat(F.lit("Project "), F.initcap("ecosystem"), F.lit(" "))).otherwise("Project ")
    use = F.when(F.col("strong"), F.concat(F.lit(USED[0]), "first_module", F.lit(" imports "), "package", F.lit(USED[1]), "modules", F.lit(USED[2]), "subsystems", F.lit("."))).otherwise(NO_USE)
    return g.select("csc_id", "ecosystem", "package", target.alias("section_target"), F.when(grouped, "grouped_tooling").otherwise("standard").alias("render_style"), F.when(grouped, F.concat(prefix, title)).alias("group_title"),
                    F.coalesce(general, own).alias("general"), use.alias("usage"), F.when(F.col("strong"), "project_evidence").otherwise("tbd").alias("basis"))
