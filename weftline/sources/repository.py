"""Source trees as tables: files with their contents, packages with their declared dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.listing import list_tree, read_files

# fixed values: folders that are never read, by name
IGNORED = tuple("node_modules .git dist build out coverage .venv venv __pycache__ .next .turbo .mypy_cache .pytest_cache".split())
LANGUAGES = {"typescript": "ts|mts|cts", "tsx": "tsx", "javascript": "js|jsx|mjs|cjs", "python": "py"}
MANIFESTS = ("package.json", "pyproject.toml", "setup.py")


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, endings in LANGUAGES.items():
        out = F.when(path.rlike(rf"\.({endings})$"), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    """Files in a folder of tests, or named as tests are."""
    return path.rlike(r"(^|/)(test|tests|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.py$")


def ancestors(path: Column) -> Column:
    """The folder of a path and all above it, the root as "", each with its depth."""
    parts = F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/")
    own = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder")))
    return F.filter(F.array_distinct(own), lambda a: (a["depth"] == 0) | (a["folder"] != ""))


def is_ignored(path: Column) -> Column:
    """Whether some folder of a path is never read; a file of such a name is."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda part: part.isin(*IGNORED))


def scan(spark: SparkSession, root: str, follow_rules: bool = True) -> DataFrame:
    """path (from the root), content, content_hash, lang, is_test of each file below ``root``.

    Files in ignored folders are not part of it, nor are those that ignore files in the tree leave out, unless
    ``follow_rules`` is off. Bytes that aren't UTF-8 are replaced.
    """
    files = read_files(list_tree(spark, root, IGNORED, follow_rules), root)
    rows = files.select("path", F.col("content").cast("string").alias("content"))
    return rows.select("path", "content", F.substring(F.sha2("content", 256), 1, 20).alias("content_hash"), language(F.col("path")).alias("lang"), is_test(F.col("path")).alias("is_test"))


def packages(files: DataFrame) -> DataFrame:
    """path, name, manifest, published, dependencies, entries of each manifest: a folder with two is two packages.

    A setup.py beside a pyproject.toml doesn't count; neither does a manifest that can't be read. Names of Python
    packages are normalized.
    """
    base = F.substring_index("path", "/", -1)
    rows = files.where(base.isin(*MANIFESTS)).select(F.expr("case when instr(path, '/') > 0 then left(path, length(path) - length(substring_index(path, '/', -1)) - 1) else '' end").alias("folder"), base.alias("manifest"), "content")
    newer = rows.where("manifest = 'pyproject.toml'").select("folder", F.lit("setup.py").alias("manifest"))
    rows = rows.join(newer, ["folder", "manifest"], "left_anti")
    return rows.select("folder", "manifest", "content").mapInPandas(_read_manifests, "path string, name string, manifest string, published boolean, dependencies array<string>, entries array<string>")


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package, manifest of the package that each of ``files(path, lang)`` is in: the deepest folder above it that
    has one, and of two in one folder that of the file's language. Files outside all packages are left out."""
    above = files.select("path", "lang", F.explode(ancestors(F.col("path"))).alias("a")).select("path", "lang", "a.*")
    named = packages.select(F.col("path").alias("folder"), F.col("name").alias("package"), "manifest")
    fits = (F.col("manifest") != "package.json") == F.coalesce(F.col("lang") == "python", F.lit(False))
    best = above.join(named, "folder").groupBy("path").agg(F.max_by(F.struct("package", "manifest"), F.struct("depth", fits)).alias("p"))
    return best.select("path", "p.*")


def _read_manifests(batches):
    import pandas as pd

    for batch in batches:
        out = []
        for folder, manifest, content in batch.itertuples(index=False):
            if (read := _manifest(folder, manifest, content or "")) is not None:
                out.append((folder, *read))
        yield pd.DataFrame(out, columns=["path", "name", "manifest", "published", "dependencies", "entries"])


def _manifest(folder: str, manifest: str, content: str):
    import json
    import re
    import tomllib

    normal = lambda name: re.sub(r"[-_.]+", "-", name).lower()
    required = lambda spec: normal(m[0]) if (m := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", spec.strip())) else None
    base = folder.rsplit("/", 1)[-1] or "root"
    try:
        if manifest == "package.json":
            data = json.loads(content)
            names = {d for key in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for d in (data.get(key) or {})}
            entries = [v for v in (data.get("main"), data.get("module"), data.get("types")) if isinstance(v, str)] + _strings(data.get("exports"))
            return data.get("name") or base, manifest, data.get("private") is not True, sorted(names), entries
        if manifest == "pyproject.toml":
            data = tomllib.loads(content)
            project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
            specs = [*project.get("dependencies", []), *(s for group in project.get("optional-dependencies", {}).values() for s in group), *(n for n in poetry.get("dependencies", {}) if n != "python")]
            name = project.get("name") or poetry.get("name")
            return normal(name) if name else base, manifest, bool(name), sorted({r for s in specs if (r := required(s))}), []
        name = re.search(r"\bname\s*=\s*[\"']([^\"']+)", content)
        listed = re.search(r"install_requires\s*=\s*\[(.*?)\]", content, re.S)
        specs = re.findall(r"[\"']([^\"']+)[\"']", listed[1]) if listed else []
        return normal(name[1]) if name else base, manifest, bool(name), sorted({r for s in specs if (r := required(s))}), []
    except (ValueError, AttributeError, TypeError):
        return None


def _strings(value) -> list[str]:
    """All targets of a package's exports, in order."""
    if isinstance(value, str):
        return [value]
    return [s for v in (value.values() if isinstance(value, dict) else value if isinstance(value, list) else []) for s in _strings(v)]
