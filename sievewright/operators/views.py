"""Views on a repository's index, workspaces, and the choice of a provider for a capability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import neighbourhood
from .telemetry import health

# Folders whose children are workspaces where no manifest lists any.
WORKSPACE_FOLDERS = ("apps", "packages", "services")


def directory_counts(files: DataFrame, most: int = 60) -> DataFrame:
    """Files by top folder: the largest (a report)."""
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(most)


def module_map(files: DataFrame, prefix: str) -> DataFrame:
    """Files under a folder."""
    at = prefix.removeprefix("./").rstrip("/")
    return files.where((F.col("path") == at) | F.col("path").startswith(at + "/") if at else F.lit(True)).orderBy("path")


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    """What a file imports, and what imports it."""
    one = lambda here, there, kind: edges.where(F.col(here) == path).select(F.col(there).alias("path"), F.lit(kind).alias("relation"))
    return one("src", "dst", "imports").union(one("dst", "src", "imported-by")).distinct()


def impact(edges: DataFrame, changed: DataFrame, depth: int = 1) -> DataFrame:
    """Files within `depth` steps of the changed ones(path), with whether they changed themselves."""
    near = neighbourhood(edges, changed.select(F.col("path").alias("node")), depth).withColumnRenamed("node", "path")
    return near.join(changed.select("path").distinct().withColumn("changed", F.lit(True)), "path", "left").fillna(False, ["changed"])


def changed(*listings: DataFrame) -> DataFrame:
    """Paths in any of several listings of changes, once each."""
    out = listings[0].select("path")
    for x in listings[1:]:
        out = out.union(x.select("path"))
    return out.distinct()


def workspaces(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Folders with a manifest that are workspaces: those that match a manifest's member patterns, else the children of
    the usual folders."""
    folder = F.regexp_replace("path", "/[^/]+$", "")
    rows = files.where("manifest").where(F.contains("path", F.lit("/"))).select(folder.alias("folder")).distinct()
    if globs:
        pattern = "|".join("^" + "[^/]+".join("(?:.+)".join(_quote(y) for y in x.split("**")) if "**" in x else _quote(x) for x in g.strip("./").rstrip("/").split("*")) + "$" for g in globs)
        return rows.where(F.col("folder").rlike(pattern))
    return rows.where(F.col("folder").rlike(f"^(?:{'|'.join(WORKSPACE_FOLDERS)})/[^/]+$"))


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def resolve(providers: DataFrame, capability: str, calls: DataFrame | None = None, external: bool = False) -> DataFrame:
    """The provider(id, capabilities, source_type, trusted, preferred) for a capability: a trusted preferred one, else
    trusted others by health, else the command line where allowed, else the native one."""
    rows = providers.where(F.array_contains("capabilities", capability))
    if calls is not None:
        rows = rows.join(health(calls).select(F.col("provider").alias("id"), "penalty"), "id", "left").fillna(0.0, ["penalty"])
    else:
        rows = rows.withColumn("penalty", F.lit(0.0))
    native = F.col("source_type") == "native"
    rank = F.when(F.col("trusted") & F.col("preferred") & ~native, 0).when(F.col("trusted") & ~native & (F.col("source_type") != "cli"), 1).when((F.col("source_type") == "cli") & F.lit(external), 2).when(native, 3)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "penalty", "id").limit(1)


def overlaps(providers: DataFrame) -> DataFrame:
    """Capabilities that several providers have."""
    rows = providers.select("id", F.explode("capabilities").alias("capability"))
    return rows.groupBy("capability").agg(F.count_distinct("id").alias("providers"), F.array_sort(F.collect_set("id")).alias("ids")).where("providers > 1")


def problem_paths(ranked: DataFrame, problem: str = "problem_id", each: int = 3) -> DataFrame:
    """Candidate files of several problems(problem, ordinal, path, rank_score) in turn: all firsts, then all seconds; the
    first of each problem is mandatory."""
    from .budget import round_robin

    order = Window.partitionBy(problem).orderBy(F.desc("rank_score"), "path")
    top = ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= each)
    turn = round_robin(top, "ordinal", [F.desc("rank_score"), F.asc("path")], "path")
    must = top.where("position = 1").select("path").distinct().withColumn("mandatory", F.lit(True))
    return turn.join(must, "path", "left").fillna(False, ["mandatory"]).withColumn("place", F.row_number().over(Window.orderBy("position", "queue")))


def problem_status(problems: DataFrame, evidence: DataFrame) -> DataFrame:
    """problems(problem_id, terms) with what evidence(context_id, text, selected) bears on them: covered if some of it is
    selected, queued if some exists, else unresolved."""
    rows = problems.join(evidence, F.exists("terms", lambda t: F.contains(F.lower("text"), t)), "left")
    out = rows.groupBy("problem_id").agg(F.count("context_id").alias("evidence"), F.count_if("selected").alias("selected"))
    return out.withColumn("status", F.when(F.col("selected") > 0, "covered").when(F.col("evidence") > 0, "queued").otherwise("unresolved"))


def _glob(pattern: str) -> str:
    """A pattern of folders as a regular expression: * is part of a name, ** any number of names."""
    parts = [r"(?:[^/]+/)*" if p == "**" else "[^/]*".join(map(_quote, p.split("*"))) + "/" for p in pattern.strip("'\" ").removeprefix("./").strip("/").split("/")]
    return "^" + "".join(parts).removesuffix("/") + "$"


def member_patterns(files: DataFrame, most: int = 1000) -> list[tuple[str, str]]:
    """(kind, pattern) of the members that manifests at the root of files(path, content) list, in the order in which they
    count. Three files are read; `most` patterns bound what comes to the driver, and more raise an error."""
    text = F.col("content")
    of = F.from_json(F.coalesce(F.get_json_object(text, "$.workspaces.packages"), F.get_json_object(text, "$.workspaces")), "array<string>")
    cargo = F.regexp_extract(text, r"(?s)\[workspace\].*?members\s*=\s*\[(.*?)\]", 1)
    listed = (
        F.when(F.col("path") == "package.json", of).when(F.col("path") == "pnpm-workspace.yaml", F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*-\s*['\"]?([^'\"#\n]+)"), F.lit(1)), F.trim))
        .when(F.col("path") == "Cargo.toml", F.regexp_extract_all(cargo, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)))
    )
    kind = F.when(F.col("path") == "package.json", F.struct(F.lit(0), F.lit("javascript-workspace"))).when(F.col("path") == "pnpm-workspace.yaml", F.struct(F.lit(1), F.lit("pnpm-workspace"))).otherwise(F.struct(F.lit(2), F.lit("cargo-workspace")))
    rows = files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml", "Cargo.toml")).select(kind.alias("k"), F.posexplode(listed).alias("place", "pattern")).orderBy("k", "place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"manifests list more than {most} patterns of members")
    return [(r.k[1], r.pattern) for r in rows if r.pattern and not r.pattern.startswith("!")]


def detect_workspaces(files: DataFrame) -> DataFrame:
    """Folders of files(path, content) that manifests at the root list as members, by the first that does, and children
    of the usual folders; with their kind."""
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - 2)), lambda n: F.array_join(F.slice(parts, F.lit(1), n + 1), "/"))).alias("folder"), F.size(parts).alias("n")).where("n > 1").select("folder").distinct()
    kind = None
    for name, pattern in member_patterns(files):
        hit = F.col("folder").rlike(_glob(pattern))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    usual = F.col("folder").rlike(f"^(?:{'|'.join(WORKSPACE_FOLDERS)})/[^/]+$")
    kind = F.when(usual, "monorepo-module") if kind is None else kind.when(usual, "monorepo-module")
    return folders.withColumn("kind", kind).where("kind IS NOT NULL")
