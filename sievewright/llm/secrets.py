"""Secret scans over an incremental ledger of content-addressed blobs. Spark's own functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` count if `group` (0: the whole match) has at least `least` characters.

    `sure` is a pattern that every text with a counted match matches as well; it spares the others the full scan.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    sure: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Base kinds first, in the order in which ties are listed; the others are added spans. Runs of hex and access-key
#: characters are maximal, so their least length can stand in the pattern; that of an assignment can't, since a match
#: that fails still uses up its characters.
RULES = (
    Rule("assign", 1, _ASSIGN, group=2, least=6, sure=_ASSIGN),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", sure="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", sure="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", sure="eyJ"),
)
BASE = ("assign", "access", "hex")


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match the code points before it since the last one, its own, and whether it counts; null without any."""
    between = F.split(text, rule.pattern, -1)
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = match if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    out = F.transform(F.arrays_zip(match.alias("m"), part.alias("p")), lambda x, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(x["m"]).alias("n"), (F.length(x["p"]) >= rule.least).alias("counts")))
    literal = rule.sure and rule.sure != rule.pattern
    return F.when(F.contains(text, F.lit(rule.sure)) & text.rlike(rule.pattern) if literal else text.rlike(rule.pattern), out)


class Ledger:
    """Two append-only tables under a folder: which blobs were scanned by which rule versions, and what was found."""

    SCANNED = "blob binary, rules array<string>"
    FOUND = "blob binary, kind string, rule string, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", self.SCANNED)

    def found(self) -> DataFrame:
        out = self._read("found", self.FOUND)
        return self.spark.createDataFrame([], self.FOUND) if out is None else out.distinct()

    def scan(self, versions: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
        """Scan what the ledger hasn't seen of the versions' blobs; returns versions without the text, with `blob`.

        A blob is the SHA-256 of a text (null: the empty text). Each distinct blob is scanned from one of its rows, by
        those rule versions that the ledger lacks for it; findings are written before the blob counts as scanned, and
        read distinct, so a run that broke off can be repeated. Rows of the text's length cross the network once, for
        unseen blobs alone. Positions are running sums over a blob's matches, which are rows: a text of any number of
        matches is sorted, never gathered.
        """
        blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        rest = [c for c in versions.columns if c not in (text, "blob")]
        row = F.xxhash64(*[F.col(c) for c in rest]) if rest else F.lit(0).cast("long")
        hashed = versions.select(*rest, blob.alias("__blob"), row.alias("__row"))
        hashed = written(hashed, "blobs")
        names = F.array(*[F.lit(r.name) for r in rules])
        todo = hashed.groupBy("__blob").agg(F.min("__row").alias("__row"))
        seen = self.scanned()
        if seen is None:
            # not a constant: else the optimizer scans every row before the join instead of each blob after it
            todo = todo.withColumn("__todo", F.when(F.col("__row").isNotNull(), names))
        else:
            seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("__seen"))
            todo = todo.join(seen, todo["__blob"] == seen["blob"], "left").drop("blob")
            todo = todo.withColumn("__todo", F.array_except(names, F.coalesce("__seen", F.array().cast("array<string>")))).where(F.size("__todo") > 0).drop("__seen")
        texts = versions.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), blob.alias("__blob"), row.alias("__row")).join(todo, ["__blob", "__row"])
        found = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"), F.when(F.array_contains("__todo", r.name), _pieces(F.col("__text"), r)).alias("pieces")) for r in rules])
        # the outer form, else the optimizer would scan once more for a filter
        found = texts.select(F.col("__blob").alias("blob"), F.explode_outer(F.filter(found, lambda x: x["pieces"].isNotNull())).alias("k")).where("k.rule IS NOT NULL")
        # several rows of one version may stand for the blob; any of them will do
        found = found.select("blob", "k.kind", "k.rule", "k.pieces").dropDuplicates(["blob", "rule"]).select("blob", "kind", "rule", F.posexplode("pieces").alias("i", "p"))
        upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum((F.col("p.gap") + F.col("p.n")).cast("long")).over(upto)
        found = found.withColumn("end", end).where("p.counts").select("blob", "kind", "rule", (F.col("end") - F.col("p.n")).alias("start"), "end")
        found.write.mode("append").parquet(f"{self.path}/found")
        todo.select(F.col("__blob").alias("blob"), F.col("__todo").alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return hashed.withColumnRenamed("__blob", "blob").drop("__row")


def _listed(spans: Column, kinds) -> Column:
    """kind:start:end by start, then in the order of kinds."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def findings(versions: DataFrame, ledger: Ledger, text: str = "text", rules=RULES, base=BASE) -> DataFrame:
    """Every row of versions (its path or id, any other columns; not the text) with what the ledger has for its blob.

    Adds n_<kind> for the base kinds, base_sha256 over the base spans and spans with all of them; positions are code
    points, end exclusive. Null and empty texts: no spans. Repeated rows stay repeated; no rows give no rows. A column
    of versions that clashes with an added one is dropped. A blob with any number of paths is a skewed join key, which
    adaptive execution splits: blobs with no finding at all don't reach the join's other side.
    """
    paths = ledger.scan(versions, text, rules)
    spans = ledger.found().where(F.col("rule").isin([r.name for r in rules]))
    spans = spans.groupBy("blob").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__spans"))
    of = lambda kinds: F.filter("__spans", lambda x: x["kind"].isin(list(kinds)))
    counts = {f"n_{k}": F.size(of([k])).cast("long") for k in base}
    per = spans.select("blob", *[c.alias(n) for n, c in counts.items()], F.sha2(_listed(of(base), [r.kind for r in rules]), 256).alias("base_sha256"), _listed(F.col("__spans"), [r.kind for r in rules]).alias("spans"))
    keep = [c for c in paths.columns if c not in {*counts, "base_sha256", "spans"}]
    out = paths.select(*keep).join(per, "blob", "left")
    return out.select(*[c for c in keep if c != "blob"], *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return findings(docs, Ledger(spark, new_path(spark, "ledger")))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        e = r.pattern.replace("'", "''")
        parts.append(f"""r{i} AS (SELECT doc_id, n, '{r.kind}' AS kind, {i} AS o, unnest(list_transform(regexp_extract_all(t, '{e}', 0), lambda x: length(x))) AS m,
  unnest(list_transform(regexp_extract_all(t, '{e}', {r.group}), lambda x: length(x))) AS p, unnest(list_transform(string_split_regex(t, '{e}')[:len(regexp_extract_all(t, '{e}', 0))], lambda x: length(x))) AS gap,
  generate_subscripts(regexp_extract_all(t, '{e}', 0), 1) AS i FROM d WHERE regexp_matches(t, '{e}')),
s{i} AS (SELECT n, kind, o, p >= {r.least} AS counts, (sum(gap + m) OVER (PARTITION BY n ORDER BY i))::BIGINT AS e, m FROM r{i})""")
    every = " UNION ALL ".join(f"SELECT n, kind, o, e - m AS b, e FROM s{i} WHERE counts" for i in range(len(RULES)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
{", ".join(parts)},
u AS ({every}),
a AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans FROM u GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)"""


SQL = _sql()
