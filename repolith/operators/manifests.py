"""Dependencies declared in build manifests.

Each kind of manifest is a short list of places to look: paths into a TOML or JSON
document, elements of an XML document, or patterns over lines. One walk over that
list gives declarations (name, role, group, version) and warnings.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Found = tuple[str, str, str | None, str | None]  # name, role, group, version

# Roles of groups and configurations, and patterns of declarations.
GRADLE_ROLES = {
    "api": "runtime", "implementation": "runtime", "compileonly": "build", "runtimeonly": "runtime", "developmentonly": "development", "testimplementation": "test", "testruntimeonly": "test",
    "testcompileonly": "test", "testfixturesimplementation": "test", "annotationprocessor": "build", "kapt": "build", "ksp": "build", "classpath": "plugin",
}
TEST_GROUPS, DEV_GROUPS = ("test", "tests", "qa"), ("dev", "docs", "lint", "format", "type", "typing")
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9_.-]+)")
GRADLE = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|\s)\s*['\"]([^'\"]+)['\"]")
GRADLE_DYNAMIC = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(\s*(libs\.[^)]+|project\([^)]+\))\s*\)")
MESON, CMAKE = re.compile(r"dependency\(\s*['\"]([^'\"]+)['\"]"), re.compile(r"find_package\(\s*([A-Za-z0-9_+.-]+)")
WORKSPACE = re.compile(r"(?:http_archive|git_repository|local_repository|new_local_repository)\s*\(.*?name\s*=\s*['\"]([^'\"]+)['\"]", re.S)
CONAN = re.compile(r"(requires|tool_requires|test_requires)\s*=\s*(\[[^\]]*\]|\([^\)]*\)|['\"][^'\"]+['\"])", re.S)
CONAN_ROLES = {"requires": "runtime", "tool_requires": "toolchain", "test_requires": "test"}
GO_BLOCK = re.compile(r"require\s*\((.*?)\)", re.S)


# Names of build manifests with their ecosystem and category.
BUILD_SOURCES = {
    "pyproject.toml": ("python", "dependency_manifest"), "requirements.txt": ("python", "dependency_manifest"), "setup.py": ("python", "build_config"), "setup.cfg": ("python", "build_config"),
    "Pipfile": ("python", "dependency_manifest"), "Pipfile.lock": ("python", "dependency_lockfile"), "poetry.lock": ("python", "dependency_lockfile"),
    "package.json": ("javascript", "dependency_manifest"), "package-lock.json": ("javascript", "dependency_lockfile"), "yarn.lock": ("javascript", "dependency_lockfile"), "pnpm-lock.yaml": ("javascript", "dependency_lockfile"),
    "Cargo.toml": ("rust", "dependency_manifest"), "Cargo.lock": ("rust", "dependency_lockfile"), "go.mod": ("go", "dependency_manifest"), "go.sum": ("go", "dependency_lockfile"),
    "pom.xml": ("jvm", "dependency_manifest"), "build.gradle": ("jvm", "build_config"), "build.gradle.kts": ("jvm", "build_config"), "settings.gradle": ("jvm", "build_config"), "settings.gradle.kts": ("jvm", "build_config"), "gradle.properties": ("jvm", "build_config"),
    "packages.lock.json": ("dotnet", "dependency_lockfile"), "Directory.Build.props": ("dotnet", "build_config"), "global.json": ("dotnet", "build_config"),
    "CMakeLists.txt": ("cpp", "build_config"), "vcpkg.json": ("cpp", "dependency_manifest"), "conanfile.py": ("cpp", "dependency_manifest"), "conanfile.txt": ("cpp", "dependency_manifest"), "meson.build": ("cpp", "build_config"),
    "BUILD": ("generic", "build_config"), "WORKSPACE": ("generic", "build_config"), "Makefile": ("generic", "build_config"),
}
BUILD_PATTERNS = {r"^requirements-.*\.txt$": ("python", "dependency_manifest"), r"\.csproj$": ("dotnet", "dependency_manifest")}


def build_sources(scan: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(csc_id, path, ecosystem, category): build manifests in the analysed roots and in the directories above them.

    roots: (csc_id, root), null for every top directory. Names are told exactly or
    by two patterns; a file elsewhere is none, whatever its name.
    """
    f = scan.select("csc_id", "path").filter("path IS NOT NULL").distinct().withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("."))
    if roots is None:
        f = f.filter(~F.col("dir").contains("/"))
    else:
        parts = F.split("root", "/")
        upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        f = f.join(roots.select("csc_id", F.explode(F.concat(F.array(F.lit(".")), upto)).alias("dir")).distinct(), ["csc_id", "dir"], "left_semi")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    told = F.element_at(F.create_map(*(x for n, (e, c) in BUILD_SOURCES.items() for x in (F.lit(n), F.struct(F.lit(e).alias("ecosystem"), F.lit(c).alias("category"))))), name)
    for pattern, (e, c) in BUILD_PATTERNS.items():
        told = F.coalesce(told, F.when(name.rlike(pattern), F.struct(F.lit(e).alias("ecosystem"), F.lit(c).alias("category"))))
    return f.select("csc_id", "path", told.alias("t")).filter("t IS NOT NULL").select("csc_id", "path", "t.ecosystem", "t.category")


def group_role(group: str | None) -> str:
    """Role of a named group of Python dependencies."""
    g = (group or "").lower().replace("_", "-")
    if not g:
        return "runtime"
    if g in TEST_GROUPS or g not in DEV_GROUPS and "test" in g:
        return "test"
    return "development" if g in DEV_GROUPS or any(t in g for t in ("dev", "lint", "docs", "type")) else "optional"


def _at(document: object, *keys: str) -> object:
    for k in keys:
        document = document.get(k) if isinstance(document, dict) else None
    return document


def _mapping(table: object, role: str, group: str | None = None) -> list[Found]:
    """Declarations of a table of names; `python` itself is none."""
    if not isinstance(table, dict):
        return []
    return [(n, role, group, v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str) if v is not None else None) for n, v in sorted(table.items()) if n.lower() != "python"]


def _requirements(items: object, role: str, group: str | None, warnings: list) -> list[Found]:
    out = []
    for item in items if isinstance(items, list) else []:
        if isinstance(item, str):
            if m := REQUIREMENT.match(item):
                out.append((m[1], role, group, item))
            else:
                warnings.append(("python_requirement_unparsed", item))
    return out


def _toml(read: Callable) -> Callable:
    def run(path: str, text: str, warnings: list) -> list[Found]:
        try:
            return read(tomllib.loads(text), warnings)
        except tomllib.TOMLDecodeError as e:
            warnings.append(("toml_parse_failed", str(e)))
            return []

    return run


def _json(read: Callable) -> Callable:
    def run(path: str, text: str, warnings: list) -> list[Found]:
        try:
            document = json.loads(text)
        except ValueError as e:
            warnings.append(("json_parse_failed", str(e)))
            return []
        if not isinstance(document, dict):
            warnings.append(("json_shape_invalid", "expected object"))
            return []
        return read(document, warnings)

    return run


def _xml(read: Callable) -> Callable:
    def run(path: str, text: str, warnings: list) -> list[Found]:
        try:
            return read(ElementTree.fromstring(text.strip()))
        except ElementTree.ParseError as e:
            warnings.append(("xml_parse_failed", str(e)))
            return []

    return run


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element, name: str) -> str | None:
    return next((" ".join(c.text.split()) for c in e if _local(c) == name and c.text), None)


def _pyproject(t: dict, warnings: list) -> list[Found]:
    out = _requirements(_at(t, "project", "dependencies"), "runtime", None, warnings)
    groups = _at(t, "project", "optional-dependencies")
    for g in sorted(groups) if isinstance(groups, dict) else []:
        out += _requirements(groups[g], group_role(g), g, warnings)
    out += _mapping(_at(t, "tool", "poetry", "dependencies"), "runtime") + _mapping(_at(t, "tool", "poetry", "dev-dependencies"), "development", "dev")
    groups = _at(t, "tool", "poetry", "group")
    for g in sorted(groups) if isinstance(groups, dict) else []:
        out += _mapping(_at(groups, g, "dependencies"), group_role(g), g)
    return out


def _requirements_file(path: str, text: str, warnings: list) -> list[Found]:
    name, out = path.rpartition("/")[2].lower(), []
    role = "test" if "test" in name else "development" if any(t in name for t in ("dev", "docs", "lint", "type")) else "runtime"
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith(("-r", "--requirement", "-c", "--constraint", "-e", "--editable")):
            warnings.append(("requirements_include_skipped", line))
        else:
            out += _requirements([line], role, None, warnings)
    return out


def _package_json(t: dict, warnings: list) -> list[Found]:
    out = [f for k, r in (("dependencies", "runtime"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")) for f in _mapping(t.get(k), r, k)]
    bundled = t.get("bundledDependencies") or t.get("bundleDependencies") or []
    return out + [(n, "build", "bundledDependencies", None) for n in (bundled if isinstance(bundled, list) else []) if isinstance(n, str)]


def _go_mod(path: str, text: str, warnings: list) -> list[Found]:
    entries = [x.strip() for b in GO_BLOCK.findall(text) for x in b.splitlines()]
    entries += [m.strip() for m in re.findall(r"^[ \t]*require[ \t]+([^(\n]+)$", text, re.M)]
    out = []
    for e in filter(None, entries):
        parts = e.split(None, 2)
        if len(parts) < 2:
            warnings.append(("go_require_unparsed", e))
        elif "indirect" not in "".join(parts[2:]):
            out.append((parts[0], "runtime", None, parts[1]))
    return out


def _pom(root: ElementTree.Element) -> list[Found]:
    out = []
    for e in (x for c in root if _local(c) == "dependencies" for x in c if _local(x) == "dependency"):
        g, a, scope = _text(e, "groupId"), _text(e, "artifactId"), (_text(e, "scope") or "compile").lower()
        if g and a:
            role = "optional" if (_text(e, "optional") or "").lower() == "true" else {"test": "test", "provided": "build", "system": "build"}.get(scope, "runtime")
            out.append((f"{g}:{a}", role, scope, _text(e, "version")))
    for e in (x for b in root if _local(b) == "build" for c in b if _local(c) == "plugins" for x in c if _local(x) == "plugin"):
        if a := _text(e, "artifactId"):
            out.append((f"{_text(e, 'groupId') or 'plugin'}:{a}", "plugin", "plugin", _text(e, "version")))
    return out


def _csproj(root: ElementTree.Element) -> list[Found]:
    out = []
    for e in (x for x in root.iter() if _local(x) == "PackageReference"):
        if name := e.get("Include") or e.get("Update"):
            private = (e.get("PrivateAssets") or _text(e, "PrivateAssets") or "").lower()
            out.append((name, "build" if "all" in private else "unknown", None, e.get("Version") or _text(e, "Version")))
    return out


def _gradle(path: str, text: str, warnings: list) -> list[Found]:
    out = []
    for config, coordinates in GRADLE.findall(text):
        parts, c = coordinates.split(":"), config.lower()
        if coordinates.startswith((":", "project(", "libs.")):
            warnings.append(("gradle_dynamic_skipped", coordinates))
        elif len(parts) < 2:
            warnings.append(("gradle_coords_unparsed", coordinates))
        else:
            role = GRADLE_ROLES.get(c) or ("test" if c.startswith("test") else "plugin" if c.endswith("classpath") or "plugin" in c else "unknown")
            out.append((":".join(parts[:2]), role, config, parts[2] if len(parts) > 2 else None))
    warnings += [("gradle_dynamic_skipped", f"{c}({e})") for c, e in GRADLE_DYNAMIC.findall(text)]
    return out


def _conan_txt(path: str, text: str, warnings: list) -> list[Found]:
    role, out = None, []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            role = CONAN_ROLES.get(line[1:-1])
        elif role and line and not line.startswith("#"):
            out.append((line.split("/")[0], role, None, line))
    return out


def _pattern(pattern: re.Pattern, role: str) -> Callable:
    return lambda path, text, warnings: [(n, role, None, None) for n in pattern.findall(text)]


def _conan_py(path: str, text: str, warnings: list) -> list[Found]:
    return [(i.split("/")[0], CONAN_ROLES[k], k, i) for k, v in CONAN.findall(text) for i in re.findall(r"['\"]([^'\"]+)['\"]", v)]


def _packages_lock(t: dict, warnings: list) -> list[Found]:
    d = t.get("dependencies")
    return [(n, "unknown", None, v.get("resolved")) for n, v in sorted(d.items()) if isinstance(v, dict) and v.get("type", "Direct") == "Direct"] if isinstance(d, dict) else []


def _vcpkg(t: dict, warnings: list) -> list[Found]:
    names = [x if isinstance(x, str) else _at(x, "name") for x in t.get("dependencies") or []]
    return [(n, "runtime", None, None) for n in names if isinstance(n, str)]


#: Of each manifest its ecosystem and how it is read.
MANIFESTS: list[tuple[re.Pattern, str, Callable]] = [(re.compile(p), e, r) for p, e, r in (
    (r"pyproject\.toml$", "python", _toml(_pyproject)), (r"requirements[^/]*\.txt$", "python", _requirements_file),
    (r"Pipfile$", "python", _toml(lambda t, w: _mapping(t.get("packages"), "runtime") + _mapping(t.get("dev-packages"), "development", "dev"))),
    (r"Pipfile\.lock$", "python", _json(lambda t, w: _mapping(t.get("default"), "runtime", "default") + _mapping(t.get("develop"), "development", "develop"))),
    (r"package\.json$", "javascript", _json(_package_json)),
    (r"package-lock\.json$", "javascript", _json(lambda t, w: [f for k, r in (("dependencies", "runtime"), ("devDependencies", "development")) for f in _mapping(_at(t, "packages", "", k), r, k)])),
    (r"Cargo\.toml$", "rust", _toml(lambda t, w: [f for k, r in (("dependencies", "runtime"), ("dev-dependencies", "test"), ("build-dependencies", "build")) for f in _mapping(t.get(k), r, k)])),
    (r"go\.mod$", "go", _go_mod), (r"pom\.xml$", "jvm", _xml(_pom)), (r"build\.gradle(?:\.kts)?$", "jvm", _gradle), (r"[^/]*\.csproj$", "dotnet", _xml(_csproj)),
    (r"packages\.lock\.json$", "dotnet", _json(_packages_lock)), (r"vcpkg\.json$", "cpp", _json(_vcpkg)), (r"conanfile\.txt$", "cpp", _conan_txt), (r"conanfile\.py$", "cpp", _conan_py),
    (r"meson\.build$", "cpp", _pattern(MESON, "runtime")), (r"CMakeLists\.txt$", "cpp", _pattern(CMAKE, "build")), (r"WORKSPACE(?:\.bazel)?$", "cpp", _pattern(WORKSPACE, "build")),
)]


def package_name(ecosystem: str, name: str) -> str:
    """Name by which declarations of an ecosystem are the same."""
    n = name.strip() if ecosystem == "unknown" else name.strip().lower()
    return n.replace("_", "-") if ecosystem in ("python", "rust") else n


def parse(path: str, text: str) -> tuple[str | None, list[Found], list[tuple[str, str]]]:
    """Ecosystem, declarations and warnings of one manifest; None for other files."""
    name, warnings = path.rpartition("/")[2], []
    for pattern, ecosystem, read in MANIFESTS:
        if pattern.match(name):
            return ecosystem, read(path, text, warnings), warnings
    return None, [], [("metadata_only_skipped", name)]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for csc, path, text in zip(b["csc_id"], b["path"], b["text"], strict=True):
            ecosystem, found, warnings = parse(path, text)
            rows += [(csc, path, ecosystem, "declaration", n, package_name(ecosystem, n), role, group, version) for n, role, group, version in found]
            rows += [(csc, path, ecosystem, "warning", message, code, None, None, None) for code, message in warnings]
        yield pd.DataFrame(rows, columns=["csc_id", "path", "ecosystem", "kind", "raw", "name", "role", "group_name", "version"])


def declarations(files: DataFrame) -> DataFrame:
    """(csc_id, path, ecosystem, kind, raw, name, role, group_name, version) of files (csc_id, path, text): declarations, and warnings with their code as name.

    Null paths or texts have no rows; repeated files count once.
    """
    return files.select("csc_id", "path", "text").filter("path IS NOT NULL AND text IS NOT NULL").distinct().mapInPandas(
        _run, "csc_id string, path string, ecosystem string, kind string, raw string, name string, role string, group_name string, version string")
