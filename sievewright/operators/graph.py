"""Graphs as edge tables: import resolution, degrees, distances, neighbourhoods, levels, components, file ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_terms, query_terms
from ..tables import fewer, forget, release, written

# Suffixes that an import may leave out, in the order in which they are tried.
SOURCE_SUFFIXES = (
    ".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".cs", ".rs", ".go", ".java", ".kt", ".kts", ".rb", ".php", ".swift", ".c", ".h", ".cc", ".cpp", ".hpp", ".vue", ".svelte",
    ".sql", ".sh", ".bash", ".zsh", ".ps1",
)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links(a, b): rows (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps, shuffles over the edges, until an iteration changes nothing; the
    edges of each iteration, both steps in one job, are written in the shared folder, those before them deleted. A
    star's centre may have any number of leaves: no step gathers a node's neighbours, each only needs their minimum.
    Nodes without links have no row; null ends and self-links are ignored. Nodes are whole numbers (cast to long) or of
    any type with an order.
    """
    whole = links.schema["a"].dataType.simpleString() in ("tinyint", "smallint", "int")
    edges = links.select(*[F.col(c).cast("long") if whole else F.col(c) for c in "ab"]).where("a <> b")
    edges = written(fewer(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), name)
    # done when each node has one edge down at most, and none has edges both ways
    ends = lambda: edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    while ends().groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # each larger neighbour is linked to the smallest of the neighbourhood; repeated edges go at the end
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        # the smaller neighbours and the node itself are linked to the smallest
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges, before = written(fewer(small), name), edges
        forget(before)
        release(edges.sparkSession)
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())


def normalized_spec(source: Column, spec: Column) -> Column:
    """The path that a relative import names, seen from its file; null for imports that aren't relative.

    `./x`, `../x` and `/x` are paths; leading dots without a slash are packages, one level up for each dot but the first.
    Steps above the root stay there.
    """
    none = F.array().cast("array<string>")
    base = F.when(F.contains(source, F.lit("/")), F.split(F.regexp_replace(source, "/[^/]*$", ""), "/")).otherwise(none)
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    up = F.greatest(F.lit(0), dots - 1)
    package = F.concat(F.slice(base, F.lit(1), F.greatest(F.lit(0), F.size(base) - up)), F.split(F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/"), "/"))
    relative = spec.rlike(r"^\.\.?/")
    parts = F.when(spec.startswith("/"), F.split(spec, "/")).when(relative, F.concat(base, F.split(spec, "/"))).when(spec.startswith("."), package)
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, none, step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(src, spec) with the file that each resolves to (dst) and how: edge, unresolved or external.

    The first known candidate wins: the path itself, with each source suffix, as a folder's index, as a package. Each
    import expands to as many candidate rows as there are suffixes at most, which meet the files by an equi-join.
    """
    distinct = imports.distinct()
    path = normalized_spec(F.col("src"), F.col("spec"))
    stem = F.regexp_replace(F.col("__path"), "/+$", "")
    suffixed = F.element_at(F.split("__path", "/"), -1).rlike(r"^.+\.[^.]+$")
    more = F.concat(F.array(F.col("__path")), *[F.array(F.concat(F.col("__path"), F.lit(x))) for x in SOURCE_SUFFIXES], *[F.array(F.concat(stem, F.lit(f"/index{x}"))) for x in SOURCE_SUFFIXES], F.array(F.concat(stem, F.lit("/__init__.py"))))
    tried = distinct.withColumn("__path", path).where("__path IS NOT NULL").select("src", "spec", F.posexplode(F.when(suffixed, F.array("__path")).otherwise(more)).alias("place", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("src", "spec").agg(F.min_by("path", "place").alias("dst"))
    kind = F.when(F.col("dst").isNotNull(), "edge").when(F.col("spec").rlike(r"^[./]"), "unresolved").otherwise("external")
    return distinct.join(hit, ["src", "spec"], "left").withColumn("kind", kind)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node) with the numbers of distinct edges (src, dst) out and in, zero included."""
    edges = edges.select("src", "dst").distinct()
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    sums = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("node").distinct().join(sums, "node", "left").fillna(0, ["out_degree", "in_degree"])


def distances(edges: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that can be reached from entries(node) along edges, with the least number of steps; of at most `most` steps
    where given.

    Each level joins the frontier alone with the edges and keeps what wasn't seen, until nothing new comes; levels are
    written, so lineage stays short and a lost executor costs one level, and those of every 16 are joined into one table.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    frontier = written(entries.select("node").distinct().withColumn("distance", F.lit(0)), "level")
    seen, depth = frontier, 0
    while (most is None or depth < most) and frontier.head(1):
        depth += 1
        after = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = written(after.withColumn("distance", F.lit(depth)), "level")
        seen = seen.union(frontier)
        if depth % 16 == 0:
            seen = written(seen, "levels")
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes within `depth` steps of seeds(node), in either direction, seeds included."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return distances(both, seeds, depth).select("node")


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """nodes(node) with the wave in which each can run: after all that it needs(node, on), however deep. Needs of others
    than these nodes don't count, and needs on others are never met. Where a wave is empty while nodes are left, they
    wait for each other, and an error is raised."""
    left = written(nodes.select("node").distinct(), "nodes")
    needs = written(needs.select("node", "on").distinct().join(left, "node", "left_semi"), "needs")
    done, n = None, 0
    while left.head(1):
        wave = written(left.join(needs.select("node").distinct(), "node", "left_anti").withColumn("wave", F.lit(n)), "wave")
        if not wave.head(1):
            raise ValueError("the dependencies have a cycle")
        done = wave if done is None else done.union(wave)
        needs = written(needs.join(wave.select(F.col("node").alias("on")), "on", "left_anti").select("node", "on"), "needs")
        left = written(left.join(wave, "node", "left_anti"), "nodes")
        n += 1
        if n % 16 == 0:
            done = written(done, "waves")
    return left.withColumn("wave", F.lit(0)) if done is None else done


def lexical_score(terms: Column, path: Column, symbols: Column, imports: Column) -> Column:
    """8 for each term in the path, 5 in the symbols, 2 in the imports, as substrings of lower-case text."""
    points = lambda t: F.when(F.contains(path, t), 8.0).otherwise(0.0) + F.when(F.contains(symbols, t), 5.0).otherwise(0.0) + F.when(F.contains(imports, t), 2.0).otherwise(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + points(t))


def rank_files(files: DataFrame, degree: DataFrame, distance: DataFrame, query: str | None = None) -> DataFrame:
    """files(path, symbols, imports, static_importance, entry_point) by importance, with rank_score and its parts.

    Terms of the query weigh 1.8, those of its concepts 0.35 of that, and then the rest counts for less. degree has
    (node, out_degree, in_degree), distance (node, distance). Ties go by path.
    """
    terms = query_terms(F.lit(query or ""))
    wide = F.array_except(expand_terms(terms), terms)
    text = [F.lower(F.coalesce(c, F.lit(""))) for c in ("path", "symbols", "imports")]
    out = files.join(degree.withColumnRenamed("node", "path"), "path", "left").join(distance.withColumnRenamed("node", "path"), "path", "left").fillna(0, ["out_degree", "in_degree"])
    central = F.log2(1.0 + F.col("in_degree")) * 7 + F.log2(1.0 + F.col("out_degree")) * 3
    entry = F.when(F.col("entry_point"), 15.0).otherwise(0.0)
    near = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), 8.0 - F.col("distance") * 1.5)).otherwise(0.0)
    lexical = lexical_score(terms, *text) + lexical_score(wide, *text) * 0.35
    static = F.coalesce(F.col("static_importance").cast("double"), F.lit(0.0))
    total = F.when(F.size(terms) > 0, static * 0.45 + central * 0.85 + entry * 0.35 + near * 0.75 + lexical * 1.8).otherwise(static + central + entry + near)
    matched = F.filter(terms, lambda t: lexical_score(F.array(t), *text) > 0)
    return out.withColumns({"centrality": central, "lexical": lexical, "matched_terms": matched, "rank_score": F.round(total, 3)})


def ranked(files: DataFrame, top: int | None = None) -> DataFrame:
    """Files in rank order; the first `top` where given (a top-k, which Spark takes from each partition first)."""
    out = files.orderBy(F.desc("rank_score"), "path")
    return out if top is None else out.limit(top)


def dominant(rows: DataFrame, by: str, order: list, keep: int) -> DataFrame:
    """The first `keep` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= keep).drop("__n")
