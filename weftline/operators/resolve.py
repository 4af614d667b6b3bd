"""From facts to the property graph: imports to files, names to the symbols that define them, uses to edges.

All of it is joins. An import becomes ranked candidate paths that meet the table of files; a name is followed through
re-exports by requests that spread until none is new, and answered backwards. Node keys are ``path`` for a file and
``path#Symbol`` for a symbol.
"""

from __future__ import annotations

import sys
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.fixpoint import reachable
from weftline.session import materialize, written
from weftline.sources.repository import ancestors

# fixed values: endings that are tried in turn, and modules that come with Node
ENDINGS = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SIBLINGS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
NODE_MODULES = (
    "assert async_hooks buffer child_process cluster console crypto dgram dns events fs http http2 https module net os path perf_hooks"
    " process punycode querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib"
).split()

#: Paths of changed files that are sent to all tasks, at most.
MOST_BROADCAST = 50_000


def normal_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts."""
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return normal_path(F.concat_ws("/", *parts))


def probes(base: Column) -> Column:
    """Paths that an extensionless or script-like path may stand for, in order."""
    siblings = [F.when(F.endswith(base, F.lit(js)), F.concat(F.regexp_replace(base, js.replace(".", r"\.") + "$", ""), F.lit(ts))) for js, own in SIBLINGS.items() for ts in own]
    return F.array_compact(F.array(*siblings, base, *(F.concat(base, F.lit(e)) for e in ENDINGS), *(F.concat(base, F.lit(f"/index{e}")) for e in ENDINGS)))


def imports_of(facts: DataFrame) -> DataFrame:
    rows = facts.select(F.col("path").alias("src"), "lang", "is_test", F.posexplode("facts.imports").alias("idx", "i"))
    return rows.select("src", "lang", "is_test", "idx", "i.*")


def import_name(lang: Column, specifier: Column) -> Column:
    """The package that a specifier names: its first part, or two with a scope; for Python the first dotted part."""
    return F.when(lang == "python", F.substring_index(specifier, ".", 1)).when(F.startswith(specifier, F.lit("@")), F.regexp_extract(specifier, "^@[^/]+/[^/]+", 0)).otherwise(F.substring_index(specifier, "/", 1))


def path_aliases(files: DataFrame) -> DataFrame:
    """folder, pattern, rank, targets of the path aliases of each tsconfig.json, and for each a row with a null pattern
    whose target is the base folder, if a ``baseUrl`` is set.

    What a config doesn't say itself comes from the one that it extends by a relative path, and so on; a config that is
    met again ends the chain. Of patterns an exact one ranks first, then those with the longest beginning.
    """
    named = files.where(F.substring_index("path", "/", -1).rlike(r"^[\w.-]*\.json$") & ~F.substring_index("path", "/", -1).isin("package.json", "package-lock.json"))
    read = materialize(named.select("path", "content").mapInPandas(_read_configs, "path string, parent string, base string, aliases array<struct<pattern: string, targets: array<string>>>"), "configs")
    chain = read.where(F.substring_index("path", "/", -1) == "tsconfig.json").select(F.col("path").alias("config"), "parent", "base", "aliases", F.array(F.col("path")).alias("met"))
    up = read.select(F.col("path").alias("parent"), F.col("parent").alias("next"), F.col("base").alias("up_base"), F.col("aliases").alias("up_aliases"))
    while not chain.where("parent is not null").isEmpty():
        onward = F.when(~F.array_contains("met", F.col("next")), F.col("next")).alias("parent")
        inherited = [F.coalesce(c, f"up_{c}").alias(c) for c in ("base", "aliases")]
        chain = materialize(chain.join(up, "parent", "left").select("config", onward, *inherited, F.array_append("met", F.col("parent")).alias("met")), "configs")
    rows = chain.select(folder(F.col("config")).alias("folder"), "base", F.explode_outer("aliases").alias("a")).select("folder", "base", "a.*").where("pattern is not null")
    star = F.instr("pattern", "*")
    out = rows.select("folder", "pattern", F.when(star > 0, star - 1).otherwise(1_000_000).alias("rank"), "targets")
    plain = chain.select(folder(F.col("config")).alias("folder"), F.lit(None).cast("string").alias("pattern"), F.lit(-1).alias("rank"), F.array_compact(F.array("base")).alias("targets"))
    return out.unionAll(plain)


def _read_configs(batches):
    import json
    import posixpath
    import re

    import pandas as pd

    # comments and commas before a closing bracket go; strings are passed over
    extra = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
    for batch in batches:
        out = []
        for path, content in batch.itertuples(index=False):
            try:
                data = json.loads(extra.sub(lambda m: m[1] or "", extra.sub(lambda m: m[1] or ("," if m[0] == "," else ""), content or "")))
                options = data.get("compilerOptions") or {}
                own = posixpath.dirname(path)
                parent = data.get("extends")
                parent = posixpath.normpath(posixpath.join(own, parent if parent.endswith(".json") else f"{parent}.json")) if isinstance(parent, str) and parent.startswith(".") else None
                base = posixpath.normpath(posixpath.join(own, options["baseUrl"])) if isinstance(options.get("baseUrl"), str) else None
                paths = options.get("paths")
                aliases = None if not isinstance(paths, dict) else [{"pattern": k, "targets": [posixpath.normpath(posixpath.join(base if base is not None else own, t)) for t in v]} for k, v in paths.items()]
            except (ValueError, AttributeError, TypeError):
                continue
            out.append((path, parent, base, aliases))
        yield pd.DataFrame(out, columns=["path", "parent", "base", "aliases"])


def tried(files: DataFrame) -> DataFrame:
    """way, base, step, target: by which bases ``files(target)`` can be meant, and how late a file is tried for such a base.

    A base is what an import says, made a path: by the way ``script`` it stands for the paths that ``probes`` lists, by
    ``python`` for a module or a package, by ``path`` for itself. This is the same relation seen from the files, which
    have a few bases each, where an import has two dozen candidates.
    """
    p = F.col("target")
    cut = lambda end, put="": F.when(F.endswith(p, F.lit(end)), F.concat(F.expr(f"left(target, length(target) - {len(end)})"), F.lit(put)))
    siblings = [cut(ts, js) for js, own in SIBLINGS.items() for ts in own]
    script = [*siblings, p, *(cut(e) for e in ENDINGS), *(cut(f"/index{e}") for e in ENDINGS)]
    python = [cut(".py"), cut(".pyi"), cut("/__init__.py")]
    ways = [("script", script), ("python", python), ("path", [p])]
    rows = F.array(*(F.struct(F.lit(way).alias("way"), base.alias("base"), F.lit(k).alias("step")) for way, bases in ways for k, base in enumerate(bases)))
    return files.select("target", F.explode(F.filter(rows, lambda r: r["base"].isNotNull())).alias("t")).select("t.way", "t.base", "t.step", "target")


#: Places between two bases of one rank, more than any has steps, and the share of a rank that a place is.
STEPS, PLACE = 32, 1e-6


def import_bases(imports: DataFrame, packages: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """src, idx, rank, way, base, exact: the bases (see ``tried``) that an import may mean, whether there are such files or not."""
    near = _near(imports).select("src", "idx", F.lit(0.0).alias("rank"), "way", "base", F.lit(True).alias("exact"))
    return near.unionAll(_far_bases(imports.where(~_is_near()), packages, configs))


def _far_bases(imports: DataFrame, packages: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Those of the imports that may mean several."""
    key = ["src", "idx"]
    literal = imports.where("literal")
    script = literal.where("lang <> 'python'")
    spec = F.col("specifier")
    one = lambda rank, way, base, exact: F.struct(rank.cast("double").alias("rank"), F.lit(way).alias("way"), base.alias("base"), F.lit(exact).alias("exact"))
    ranked = lambda bases, first, exact, way="script": F.transform(bases, lambda b, k: one(F.lit(first) + k * (STEPS * PLACE), way, b, exact))
    parts = []
    if configs is not None:
        # the nearest config decides; of its patterns the best that fits, and then its base folder
        holders = script.where(~spec.rlike(r"^\.{1,2}(/|$)|^/")).select(*key, "specifier", F.explode(ancestors(F.col("src"))).alias("a")).select(*key, "specifier", "a.*")
        nearest = holders.join(configs.select("folder").distinct(), "folder").groupBy(*key, "specifier").agg(F.max_by("folder", "depth").alias("folder"))
        before, after = F.substring_index("pattern", "*", 1), F.expr("substring(pattern, instr(pattern, '*') + 1)")
        wild = F.instr("pattern", "*") > 0
        fits = F.when(F.col("pattern").isNull(), True).when(wild, F.startswith("specifier", before) & F.endswith("specifier", after) & (F.length("specifier") >= F.length("pattern") - 1)).otherwise(F.col("pattern") == F.col("specifier"))
        inner = F.expr("substring(specifier, instr(pattern, '*'), length(specifier) - length(pattern) + 1)")
        matched = nearest.join(configs, "folder").where(fits)
        best = matched.groupBy(*key, F.col("pattern").isNull().alias("plain")).agg(F.max_by(F.struct("pattern", "targets", "specifier"), "rank").alias("m")).select(*key, "plain", "m.*")
        put = F.when(F.col("plain"), F.transform("targets", lambda t: join_path(t, F.col("specifier")))).otherwise(F.transform("targets", lambda t: F.when(wild, F.replace(t, F.lit("*"), inner)).otherwise(t)))
        # ranks 50 and above: after relative paths, before packages
        parts.append(best.select(*key, F.explode(ranked(put, F.when(F.col("plain"), 75).otherwise(50), True)).alias("c")))

    named = packages.where("manifest = 'package.json'").select(F.col("path").alias("home"), F.col("name").alias("package"), "entries")
    workspace = script.where(~spec.rlike(r"^[./]")).withColumn("package", import_name(F.col("lang"), spec)).join(named, "package")
    rest = F.expr("substring(specifier, length(package) + 2)")
    entry = F.transform("entries", lambda e: join_path(F.col("home"), e))
    guess = F.transform("entries", lambda e: join_path(F.col("home"), F.regexp_replace(F.regexp_replace(e, "(^|/)(dist|build|lib|out)/", "$1src/"), r"\.[cm]?jsx?$", "")))
    index = F.array(join_path(F.col("home"), F.lit("src")), F.col("home"))
    inside = F.concat(ranked(F.array(join_path(F.col("home"), rest)), 100, True), ranked(F.array(join_path(F.col("home"), F.lit("src"), rest)), 200, False))
    whole = F.concat(ranked(entry, 100, True), ranked(guess, 300, False), ranked(index, 500, False))
    parts.append(workspace.select(*key, F.explode(F.when(rest == "", whole).otherwise(inside)).alias("c")))

    python = literal.where("lang = 'python'").withColumn("module", F.replace(spec, F.lit("."), F.lit("/")))
    homes = packages.select(F.col("path").alias("folder")).union(packages.sparkSession.createDataFrame([("",)], "folder string")).distinct()
    roots = python.where("level = 0").select(*key, "module", F.explode(ancestors(F.col("src"))).alias("a")).select(*key, "module", "a.*").join(homes, "folder")
    base = lambda *parts: join_path(F.col("folder"), *parts, F.col("module"))
    parts.append(roots.select(*key, F.explode(ranked(F.array(base(), base(F.lit("src"))), F.lit(1000) - 10 * F.col("depth"), True, "python")).alias("c")))
    return reduce(DataFrame.unionAll, (p.select(*key, "c.*") for p in parts))


def _near(imports: DataFrame) -> DataFrame:
    """The imports that can mean one base only, with its way: those of a script by a path, and those of Python with a level."""
    spec, own_folder = F.col("specifier"), folder(F.col("src"))
    up = F.concat(own_folder, F.repeat(F.lit("/.."), F.col("level") - 1))
    script = join_path(F.when(F.startswith(spec, F.lit("/")), "").otherwise(own_folder), spec)
    dotted = F.when(spec == "", join_path(up, F.lit("__init__.py"))).otherwise(join_path(up, F.replace(spec, F.lit("."), F.lit("/"))))
    way = F.when(F.col("lang") != "python", "script").when(spec == "", "path").otherwise("python")
    return imports.where(_is_near()).withColumns({"way": way, "base": F.when(F.col("lang") != "python", script).otherwise(dotted)})


def _is_near() -> Column:
    by_path = F.when(F.col("lang") != "python", F.col("specifier").rlike(r"^\.{1,2}(/|$)|^/")).otherwise(F.col("level") > 0)
    return F.coalesce(F.col("literal") & by_path, F.lit(False))


def resolve_imports(facts: DataFrame, packages: DataFrame, configs: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The imports with ``target`` (a file, or null), ``exact``, and for others ``external`` and ``declared``.

    Candidates are tried in the order of their ranks; what is only found by a guess at a package's layout isn't exact.
    ``paths(path)`` are the files that there are, where ``facts`` has some of them only. Imports of one base meet the files
    in one join; only the others are gathered by their ranks, and looked up among what is declared.
    """
    imports, key, spec = imports_of(facts), ["src", "idx"], F.col("specifier")
    known = tried((facts if paths is None else paths).select(F.col("path").alias("target")))
    first = known.groupBy("way", "base").agg(F.min_by("target", "step").alias("target"))
    none = F.lit(None)
    near = _near(imports).join(first, ["way", "base"], "left").select(*imports.columns, "target", F.lit(True).alias("found_exact"), none.cast("boolean").alias("declared"))

    others = imports.where(~_is_near())
    bases = _far_bases(others, packages, configs).join(first, ["way", "base"])
    hits = bases.groupBy(*key).agg(F.min_by(F.struct("target", F.col("exact").alias("found_exact")), "rank").alias("hit")).select(*key, "hit.*")
    outside = others.withColumn("package", import_name(F.col("lang"), spec))
    declared = packages.select(F.col("path").alias("folder"), F.explode("dependencies").alias("dependency"))
    wanted = F.when(F.col("lang") == "python", F.lower(F.regexp_replace("package", "[-_.]+", "-"))).otherwise(F.col("package"))
    stated = outside.select(*key, wanted.alias("dependency"), F.explode(ancestors(F.col("src"))).alias("a")).select(*key, "dependency", "a.folder").join(declared, ["folder", "dependency"], "left_semi").select(*key).distinct().withColumn("declared", F.lit(True))
    far = others.join(hits, key, "left").join(stated, key, "left").select(*imports.columns, "target", "found_exact", "declared")

    out = near.unionAll(far).withColumn("package", import_name(F.col("lang"), spec))
    builtin = F.when(F.col("lang") == "python", F.col("package").isin(*sorted(sys.stdlib_module_names))).otherwise(F.startswith(spec, F.lit("node:")) | F.col("package").isin(*NODE_MODULES))
    lost = ~F.col("literal") | (F.col("level") > 0) | ((F.col("lang") != "python") & spec.rlike(r"^[./#~]|^@/"))
    kind = F.when(lost, "unresolved").when(builtin, "builtin").otherwise("third_party")
    none = F.col("target").isNull()
    return out.select(
        *imports.columns,
        "target",
        (F.coalesce("found_exact", F.lit(True)) & (F.col("kind") != "importlib")).alias("exact"),
        F.when(none, F.when(lost | (F.col("lang") == "python"), F.when(lost, spec).otherwise(F.col("package"))).otherwise(F.regexp_replace("package", "^node:", ""))).alias("external"),
        F.when(none, kind).alias("external_kind"),
        F.when(none & (kind == "third_party"), F.coalesce("declared", F.lit(False))).alias("declared"),
    )


def externals(resolved: DataFrame) -> DataFrame:
    """external, external_kind, specifiers (sorted, as written), declared by some importer, n_files: what lies outside."""
    rows = resolved.where("external is not null").groupBy("external", "external_kind")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("specifier")), ", ").alias("specifiers"), F.max("declared").alias("declared"), F.count_distinct("src").alias("n_files"))


def bindings_of(resolved: DataFrame) -> DataFrame:
    """src, local, imported, target, exact of every bound name; the target is null where the import is no file."""
    rows = resolved.select("src", "lang", "kind", "line", "idx", "target", "exact", F.explode("bindings").alias("b"))
    return rows.select("src", "lang", "kind", "line", "idx", "target", "exact", "b.imported", "b.local")


def aliases(facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a module itself says about its names: definitions (module, name, symbol), aliases (module, name, rank,
    to_module, to_name) and stars (module, rank, to_module)."""
    symbols = facts.select(F.col("path").alias("module"), "lang", F.explode("facts.symbols").alias("s")).select("module", "lang", "s.name", "s.subkind", "s.exportNames")
    scripts = symbols.where("lang <> 'python'")
    own = scripts.select("module", F.explode("exportNames").alias("name"), F.col("name").alias("symbol"))
    own = own.unionAll(symbols.where("lang = 'python' and instr(name, '.') = 0").select("module", "name", F.col("name").alias("symbol")))
    local = facts.where("lang <> 'python'").select(F.col("path").alias("module"), F.explode("facts.localExports").alias("e")).select("module", F.col("e.exported").alias("name"), F.col("e.local").alias("local"))
    inner = scripts.select("module", F.col("name").alias("local")).distinct()
    own = own.unionAll(local.join(inner, ["module", "local"]).select("module", "name", F.col("local").alias("symbol")))
    own = own.groupBy("module", "name").agg(F.min("symbol").alias("symbol"))
    bound = bindings_of(resolved)
    through = local.join(bound.select(F.col("src").alias("module"), "local", "target", "imported"), ["module", "local"]).select("module", "name", F.lit(2).alias("rank"), F.col("target").alias("to_module"), F.col("imported").alias("to_name"))
    named = bound.where("kind = 'reexport'").select(F.col("src").alias("module"), F.col("local").alias("name"), F.lit(3).alias("rank"), F.col("target").alias("to_module"), F.col("imported").alias("to_name"))
    python = bound.where("lang = 'python'").select(F.col("src").alias("module"), F.col("local").alias("name"), F.lit(3).alias("rank"), F.col("target").alias("to_module"), F.col("imported").alias("to_name"))
    stars = resolved.where("wildcard and target is not null").select(F.col("src").alias("module"), (F.col("idx") + 5).alias("rank"), F.col("target").alias("to_module"))
    links = through.unionAll(named).unionAll(python)
    # of all that a module says about a name only the first kind counts, even where it leads out of the repository
    links = links.groupBy("module", "name").agg(F.min_by(F.struct("rank", "to_module", "to_name"), "rank").alias("l")).select("module", "name", "l.*")
    return own, links, stars


def kept_aliases(facts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``aliases`` gives, written once for all that reads it."""
    return tuple(materialize(t, n) for t, n in zip(aliases(facts, resolved), ("definitions", "aliases", "stars"), strict=True))


def submodules_of(facts: DataFrame) -> DataFrame:
    """file, stem of the Python modules, by which a package's submodules are found."""
    return facts.where("lang = 'python'").select(F.col("path").alias("file"), F.regexp_replace("path", r"(/__init__)?\.pyi?$", "").alias("stem"))


def star_names(own: DataFrame, links: DataFrame, stars: DataFrame, facts: DataFrame) -> DataFrame:
    """module, name, rank, to_module: the stars of a module that lead to one which may know a name, by that name.

    A star that is not among these is settled as unknown. There are as many rows as names that pass through stars, not
    a row for each name asked for and each star, which would be the square of a large index.
    """
    names = [t.select("module", "name") for t in (own, links)]
    inner = submodules_of(facts).select(F.concat(F.regexp_replace("stem", "[^/]*$", ""), F.lit("__init__.py")).alias("module"), F.regexp_replace("stem", "^.*/", "").alias("name"))
    led_to = stars.select(F.col("to_module").alias("module")).distinct()
    names = reduce(DataFrame.unionAll, (t.join(led_to, "module", "left_semi") for t in [*names, inner]))
    known = exported_names(names, names.limit(0), stars)
    return materialize(stars.join(known.where("name <> 'default'").toDF("to_module", "name"), "to_module").select("module", "name", "rank", "to_module"), "star-names")


def resolve_names(requests: DataFrame, own: DataFrame, links: DataFrame, starred: DataFrame, facts: DataFrame) -> DataFrame:
    """module, name, at_module, at_symbol for ``requests(module, name)``; at_symbol is null where a module is meant.
    ``own`` and ``links`` are those of ``aliases``, ``starred`` is what ``star_names`` makes of them; each is read in every round.

    A module's own definition comes first, then its aliases, then its stars in order (never for ``default``), then for
    Python a submodule of that name. Requests spread until none is new. Then answers come back round by round: a name
    is settled once its link is, or once a star is answered and all stars before it are settled as unknown; what can
    no longer be settled, as cycles, is unknown. So of several stars the first in order that knows the name answers.
    """
    submodule = submodules_of(facts)
    asked = materialize(requests.select("module", "name").distinct(), "requests")
    everything, steps = asked, []
    while not asked.isEmpty():
        left = asked.where("name <> '*'").join(own, ["module", "name"], "left_anti")
        alias = left.join(links, ["module", "name"]).select("module", "name", "rank", "to_module", "to_name")
        star = left.where("name <> 'default'").join(links, ["module", "name"], "left_anti").join(starred, ["module", "name"]).select("module", "name", "rank", "to_module", F.col("name").alias("to_name"))
        step = materialize(alias.unionAll(star), "steps")
        steps.append(step)
        asked = materialize(step.where("to_module is not null").select(F.col("to_module").alias("module"), F.col("to_name").alias("name")).distinct().join(everything, ["module", "name"], "left_anti"), "requests")
        everything = everything.unionAll(asked)
    none = F.lit(None).cast("string")
    done = everything.join(own, ["module", "name"]).select("module", "name", F.col("module").alias("at_module"), F.col("symbol").alias("at_symbol"))
    modules = everything.where("name = '*'").select("module", "name", F.col("module").alias("at_module"), none.alias("at_symbol"))
    known = materialize(done.unionAll(modules), "resolved")
    if not steps:
        return known
    pending = materialize(reduce(DataFrame.unionAll, steps), "steps")
    inner = everything.where("module like '%/\\\\_\\\\_init\\\\_\\\\_.py' or module = '__init__.py'").withColumn("stem", F.concat_ws("/", F.regexp_replace(F.regexp_replace("module", r"(^|/)__init__\.py$", ""), "^$", "."), "name")).join(submodule, "stem")
    submodules = materialize(inner.select("module", "name", F.col("file").alias("at_module"), none.alias("at_symbol")), "submodules")
    # names without a definition or a step are unknown, unless a submodule has the name
    dead_end = everything.join(known, ["module", "name"], "left_anti").join(pending, ["module", "name"], "left_anti")
    settled = materialize(known.unionAll(_or_submodule(dead_end, submodules)), "settled")
    while True:
        to = settled.select(F.col("module").alias("of_module"), F.col("name").alias("of_name"), "at_module", "at_symbol", F.lit(True).alias("found"))
        waiting = pending.join(settled.select("module", "name"), ["module", "name"], "left_anti").join(to, (F.col("to_module") == F.col("of_module")) & (F.col("to_name") == F.col("of_name")), "left")
        known_at = F.when(F.col("at_module").isNotNull(), F.col("rank"))
        open_at = F.when(F.col("to_module").isNotNull() & F.col("found").isNull(), F.col("rank"))
        best = waiting.groupBy("module", "name").agg(F.min(known_at).alias("first"), F.min(open_at).alias("open"), F.min("rank").alias("least"), F.min_by(F.struct("at_module", "at_symbol"), known_at).alias("a"))
        answered = best.where("first < coalesce(open, 2147483647)").select("module", "name", "a.*")
        unknown = best.where("first is null and open is null")  # a link is final, even one that leads nowhere
        unknown = _or_submodule(unknown.where("least >= 5"), submodules).unionAll(unknown.where("least < 5").select("module", "name", none, none))
        new = materialize(answered.unionAll(unknown), "settled")
        if new.isEmpty():  # only cycles are left: the first of the stars that are answered, or else a submodule
            new = materialize(best.where("first is not null").select("module", "name", "a.*"), "settled")
        if new.isEmpty():
            new = materialize(_or_submodule(best.where("least >= 5"), submodules).where("at_module is not null"), "settled")
        if new.isEmpty():
            return settled.where("at_module is not null")
        settled = materialize(settled.unionAll(new), "settled")


def _or_submodule(names: DataFrame, submodules: DataFrame) -> DataFrame:
    """module, name and the submodule of that name, or nulls."""
    return names.select("module", "name").join(submodules, ["module", "name"], "left")


def build_edges(facts: DataFrame, packages: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, exact, line of all edges, one row per occurrence; ``graph.merge_edges`` makes them one each.

    Edges of test files are of kind tests, but for those to externals; an edge to a whole module is an import of it.
    """
    facts = written(facts, "facts")
    return edges_of(facts, materialize(resolve_imports(facts, packages, configs), "imports"))


def edges_of(facts: DataFrame, resolved: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The edges of ``build_edges`` from facts and resolved imports, which are read several times.

    With ``only(path)`` no other files are resolved: what is asked for is what these use, and only modules that this
    leads to through re-exports are followed.
    """
    everything = facts
    own, links, stars = kept_aliases(facts, resolved)
    ways = star_names(own, links, stars, facts)
    if only is not None:
        only = F.broadcast(only) if only.count() <= MOST_BROADCAST else only
        facts = materialize(facts.join(only, "path", "left_semi"), "some-facts")
        resolved = materialize(resolved.join(only.select(F.col("path").alias("src")), "src", "left_semi"), "some-imports")
    among = None if only is None else resolved.where("wildcard and target is not null").select(F.col("target").alias("id")).distinct()
    bound = materialize(bindings_of(resolved).where("target is not null"), "bindings")
    whole = bound.select("src", "local", "imported", "target", "exact", (F.col("kind") == "require").alias("required"))
    uses = facts.select(F.col("path").alias("src"), F.explode("facts.references").alias("r")).select("src", "r.*").join(bound.where("kind not in ('reexport')").select("src", "local", "imported", "target", "exact", (F.col("kind") == "require").alias("required")), ["src", "local"])
    # a member of a whole module is a name of that module, and what is required is its default; the whole module itself
    # is no use of a name
    of_module = F.coalesce("member", F.when(F.col("required"), "default"))
    use_name = F.when(F.col("imported") != "*", F.col("imported")).otherwise(of_module)
    uses = uses.withColumn("name", use_name).where("name is not null")
    bases = facts.select(F.col("path").alias("src"), F.explode("facts.heritage").alias("h")).select("src", "h.*").withColumnRenamed("base", "local").join(whole, ["src", "local"])
    bases = bases.withColumn("name", use_name).where("name is not null")
    spread = exported_names(own, links, stars, among).toDF("target", "name").where("name <> 'default'")
    starred = resolved.where("kind = 'reexport_all' and target is not null").select("src", "line", "target", "exact").join(spread, "target")
    symbol_of = lambda column: F.concat_ws("#", "src", column)
    # in Python a free name may come from a star import, if the module shows it
    shown = shown_names(everything)
    python_stars = resolved.where("lang = 'python' and wildcard and target is not null")
    public = exported_names(shown, links.where("module like '%.py' and name not like '\\\\_%'"), stars, among).toDF("target", "name")
    free = facts.where("lang = 'python'").select(F.col("path").alias("src"), F.explode("facts.references").alias("r")).select("src", "r.*").join(bound.select("src", "local"), ["src", "local"], "left_anti")
    free = free.withColumnRenamed("local", "name").join(python_stars.select("src", "target", "exact"), "src").join(public, ["target", "name"])
    none = F.lit(None).cast("string")
    wanted = [
        free.select("src", "line", "exact", "target", "name", symbol_of(F.col("enclosing")).alias("from"), F.when(F.col("isCall"), "calls").otherwise("references").alias("kind"), F.lit(True).alias("use"), F.col("member").alias("then")),
        uses.select("src", "line", "exact", "target", "name", symbol_of(F.col("enclosing")).alias("from"), F.when(F.col("isCall"), "calls").otherwise("references").alias("kind"), (F.col("imported") != "*").alias("use"), of_module.alias("then")),
        bases.select("src", "line", "exact", "target", "name", symbol_of(F.col("className")).alias("from"), F.lit("inherits").alias("kind"), (F.col("imported") != "*").alias("use"), of_module.alias("then")),
        bound.where("imported <> '*'").select("src", "line", "exact", "target", F.col("imported").alias("name"), F.col("src").alias("from"), F.lit("references").alias("kind"), F.lit(False).alias("use"), none.alias("then")),
        starred.select("src", "line", "exact", "target", "name", F.col("src").alias("from"), F.lit("references").alias("kind"), F.lit(False).alias("use"), none.alias("then")),
    ]
    asked = wanted[0]
    for more in wanted[1:]:
        asked = asked.unionAll(more)
    asked = materialize(asked, "uses")
    answers = resolve_names(asked.select(F.col("target").alias("module"), "name"), own, links, ways, everything)
    found = asked.join(answers, (asked["target"] == answers["module"]) & (asked["name"] == answers["name"])).drop(answers["name"])
    # a use of a name that turns out to be a module is one of the module's names, or none
    through = F.col("use") & F.col("at_symbol").isNull()
    found = materialize(found.select("src", "line", "exact", "from", "kind", "use", "then", "at_module", "at_symbol"), "found")
    inner = found.where(through & F.col("then").isNotNull()).drop("at_symbol").withColumnRenamed("at_module", "module")
    again = resolve_names(inner.select("module", F.col("then").alias("name")), own, links, ways, everything)
    inner = inner.join(again.withColumnRenamed("name", "then"), ["module", "then"]).select("src", "line", "exact", "from", "kind", "at_module", "at_symbol")
    found = found.where(~through).select("src", "line", "exact", "from", "kind", "at_module", "at_symbol").unionAll(inner)
    to = F.concat_ws("#", "at_module", "at_symbol")
    named = found.select("src", "from", to.alias("dst"), F.when(F.col("at_symbol").isNull(), "imports").otherwise(F.col("kind")).alias("kind"), "exact", "line")
    plain = resolved.where("target is not null").select("src", F.col("src").alias("from"), F.col("target").alias("dst"), F.lit("imports").alias("kind"), "exact", "line")
    outside = resolved.where("target is null").select("src", F.col("src").alias("from"), F.concat(F.lit("external:"), "external").alias("dst"), F.lit("depends_on").alias("kind"), F.lit(True).alias("exact"), "line")
    every = named.unionAll(plain).unionAll(outside).join(facts.select(F.col("path").alias("src"), "is_test"), "src")
    kind = F.when(F.col("is_test") & (F.col("kind") != "depends_on"), "tests").otherwise(F.col("kind"))
    return every.select(F.col("from").alias("src"), "dst", kind.alias("kind"), "exact", "line")


def shown_names(facts: DataFrame) -> DataFrame:
    """module, name of what Python modules show to a star import."""
    return facts.where("lang = 'python'").select(F.col("path").alias("module"), F.explode("facts.symbols").alias("s")).select("module", F.explode("s.exportNames").alias("name"))


def exported_names(own: DataFrame, links: DataFrame, stars: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """module, name of all that modules export, through their stars as well, but never ``default`` through these.

    With ``among(id)`` only of those modules and what their stars lead to.
    """
    if among is not None:
        near = reachable(stars.select(F.col("module").alias("src"), F.col("to_module").alias("dst")), among).withColumnRenamed("id", "module")
        own, links, stars = (t.join(near, "module", "left_semi") for t in (own, links, stars))
    names = materialize(own.select("module", "name").union(links.select("module", "name")).distinct(), "exported")
    rounds, new = names, names
    while not new.isEmpty():
        up = stars.join(new.where("name <> 'default'").toDF("to_module", "name"), "to_module").select("module", "name").distinct()
        new = materialize(up.join(rounds, ["module", "name"], "left_anti"), "exported")
        rounds = rounds.unionAll(new)
    return rounds


def file_edges(edges: DataFrame) -> DataFrame:
    """src, dst, exact, kind between files: symbols stand for the files that hold them; edges within a file go."""
    rows = edges.where("kind not in ('depends_on')").select(F.substring_index("src", "#", 1).alias("src"), F.substring_index("dst", "#", 1).alias("dst"), "kind", "exact")
    return rows.where("src <> dst").groupBy("src", "dst", "kind").agg(F.max("exact").alias("exact"))


def published_api(facts: DataFrame, packages: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """module, symbol that can be reached from the entry files of published packages.

    Names and whole modules feed each other: a module's names are resolved, and those that turn out to be modules, as
    those of ``export * as`` or of Python's submodules, are marked in turn, each once, so cycles end.
    """
    facts = written(facts, "facts")
    resolved = materialize(resolve_imports(facts, packages, configs), "imports")
    own, links, stars = kept_aliases(facts, resolved)
    ways = star_names(own, links, stars, facts)
    home = packages.where("published")
    index = F.concat(F.flatten(F.transform("entries", lambda e: F.concat(probes(join_path(F.col("path"), e)), probes(join_path(F.col("path"), F.regexp_replace(F.regexp_replace(e, "(^|/)(dist|build|lib|out)/", "$1src/"), r"\.[cm]?jsx?$", "")))))), probes(join_path(F.col("path"), F.lit("src"))), probes(F.col("path")))
    script = home.where("manifest = 'package.json'").select(F.explode(index).alias("module"))
    folder_name = F.replace(F.col("name"), F.lit("-"), F.lit("_"))
    python = home.where("manifest <> 'package.json'").select(F.explode(F.array(join_path(F.col("path"), folder_name, F.lit("__init__.py")), join_path(F.col("path"), F.lit("src"), folder_name, F.lit("__init__.py")))).alias("module"))
    entries = script.unionAll(python).distinct().join(facts.select(F.col("path").alias("module")), "module", "left_semi")
    # what is seen from outside: of Python modules what they show to a star import
    seen_own = own.where("module not like '%.py'").select("module", "name").unionAll(shown_names(facts))
    seen_links = links.where("not (module like '%.py' and name like '\\\\_%')")
    todo, marked, symbols = materialize(entries, "entries"), [], []
    while not todo.isEmpty():
        marked.append(todo)
        asked = materialize(exported_names(seen_own, seen_links, stars, todo.withColumnRenamed("module", "id")).join(todo, "module", "left_semi"), "asked")
        answers = materialize(resolve_names(asked, own, links, ways, facts).join(asked, ["module", "name"], "left_semi"), "answers")
        symbols.append(answers.where("at_symbol is not null").select(F.col("at_module").alias("module"), F.col("at_symbol").alias("symbol")))
        # a name that is a whole module publishes all that this one shows
        whole = answers.where("at_symbol is null and at_module is not null").select(F.col("at_module").alias("module")).distinct()
        todo = materialize(whole.join(reduce(DataFrame.unionAll, marked), "module", "left_anti"), "entries")
    none = facts.select(F.col("path").alias("module"), F.col("path").alias("symbol")).limit(0)
    return reduce(DataFrame.unionAll, symbols, none).distinct()


def refresh(stored: DataFrame, files: DataFrame, extract) -> DataFrame:
    """Facts of ``files``: those of unchanged contents as stored, all others extracted anew. Deleted files are gone."""
    same = stored.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    changed = files.join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    return same.unionByName(extract(changed))


def surfaces(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, surface: a fingerprint of what a module's names are and where they lead, the same as long as no importer can
    tell a difference: lines, bodies and imports that aren't passed on are no part of it."""
    own, links, stars = aliases(facts, resolved)
    none = F.lit(None).cast("string")
    rows = own.select("module", F.lit("own").alias("how"), "name", "symbol", none.alias("to"))
    rows = rows.unionAll(links.select("module", F.lit("link"), "name", "to_name", "to_module"))
    rows = rows.unionAll(stars.select("module", F.lpad(F.col("rank").cast("string"), 9, "0"), none, none, "to_module"))
    rows = rows.unionAll(shown_names(facts).select("module", F.lit("shown"), "name", none, none))
    # the places of stars count by their order alone
    told = F.transform(F.array_sort(F.collect_list(F.struct("how", "name", "symbol", "to"))), lambda r: F.struct(F.regexp_replace(r["how"], "[0-9]+", "star"), r["name"], r["symbol"], r["to"]))
    said = rows.groupBy("module").agg(F.sha2(F.to_json(told), 256).alias("surface"))
    return facts.select("path").join(said.withColumnRenamed("module", "path"), "path", "left")


class Built(NamedTuple):
    """What a build leaves for the next one: facts, resolved imports and edges, and which files were resolved for it."""

    facts: DataFrame
    imports: DataFrame
    edges: DataFrame
    resolved: DataFrame


def build(facts: DataFrame, packages: DataFrame, configs: DataFrame | None = None) -> Built:
    """All of ``facts(path, content_hash, lang, is_test, facts)`` resolved."""
    facts = written(facts, "facts")
    imports = materialize(resolve_imports(facts, packages, configs), "imports")
    return Built(facts, imports, materialize(edges_of(facts, imports), "edges"), facts.select("path"))


def rebuild(before: Built, facts: DataFrame, packages: DataFrame, configs: DataFrame | None = None) -> Built:
    """What ``build(facts, ...)`` gives, from the build before and for the same packages and configs; where these have
    changed, build anew.

    Imports are resolved again in files with new contents and where an added or a deleted file is among an import's
    candidates. A module is touched if its surface differs after that, or it is a Python package that gained or lost a
    module, or it passes on names of a touched module. Names are resolved again in files with new contents or new
    imports and in those that import, or had an edge into, a touched module; all other edges stay as they were.
    """
    after = written(facts, "facts")
    was, now = (b.select("path", "content_hash") for b in (before.facts, after))
    both = was.withColumnRenamed("content_hash", "was").join(now.withColumnRenamed("content_hash", "now"), "path", "full_outer")
    differ = materialize(both.where("not (was <=> now)"), "changes")
    come_or_gone = differ.where("was is null or now is null").select("path")
    kept = after.join(differ, "path", "left_anti")
    if come_or_gone.isEmpty():
        moved = come_or_gone
    else:
        moved = import_bases(imports_of(kept), packages, configs).join(_small(tried(come_or_gone.select(F.col("path").alias("target")))), ["way", "base"], "left_semi").select(F.col("src").alias("path")).distinct()
    changed = materialize(differ.where("now is not null").select("path").union(moved).distinct(), "changed")
    again = materialize(resolve_imports(after.join(_small(changed), "path", "left_semi"), packages, configs, after.select("path")), "imports")
    gone = changed.union(differ.select("path")).distinct()
    imports = materialize(before.imports.join(_small(gone.select(F.col("path").alias("src"))), "src", "left_anti").unionByName(again), "imports")

    old, new = (surfaces(b.join(_small(gone), "path", "left_semi"), i.join(_small(gone.select(F.col("path").alias("src"))), "src", "left_semi")) for b, i in ((before.facts, before.imports), (after, imports)))
    old, new = old.withColumnsRenamed({"surface": "was"}).withColumn("old", F.lit(True)), new.withColumnsRenamed({"surface": "now"}).withColumn("new", F.lit(True))
    touched = old.join(new, "path", "full_outer").where("old is null or new is null or not (was <=> now)").select(F.col("path").alias("id"))
    package = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.pyi?$", ""), r"(^|/)[^/]*$", "$1__init__.py")
    touched = touched.union(come_or_gone.where("path rlike '[.]pyi?$'").select(package.alias("id")))
    passes = [aliases(b, i) for b, i in ((before.facts, before.imports), (after, imports))]
    passes = reduce(DataFrame.unionAll, (t.where("to_module is not null").select(F.col("to_module").alias("src"), F.col("module").alias("dst")) for _, links, stars in passes for t in (links, stars)))
    touched = materialize(reachable(passes.distinct(), touched.distinct()), "touched")
    into = _small(touched.withColumnRenamed("id", "target"))
    importers = imports.join(into, "target", "left_semi").select("src")
    had = before.edges.select(F.substring_index("src", "#", 1).alias("src"), F.substring_index("dst", "#", 1).alias("target")).join(into, "target", "left_semi").select("src")
    redone = importers.union(had).select(F.col("src").alias("path")).union(changed).distinct().join(after.select("path"), "path", "left_semi")
    redone = materialize(redone, "resolved")
    fresh = edges_of(after, imports, redone)
    stale = _small(redone.union(differ.where("now is null").select("path")).select(F.col("path").alias("of")))
    edges = before.edges.join(stale, F.substring_index("src", "#", 1) == F.col("of"), "left_anti").unionByName(fresh)
    return Built(after, imports, materialize(edges, "edges"), redone)


def _small(paths: DataFrame) -> DataFrame:
    """A table of paths, to be broadcast if it is counted to be small."""
    return F.broadcast(paths) if paths.count() <= MOST_BROADCAST else paths
