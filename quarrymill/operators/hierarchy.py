"""Rules by first match, and the place of a document in a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import wildcard_regex


def first_match(docs: DataFrame, key: str, rules: list[dict], columns: dict[str, Column]) -> DataFrame:
    """``docs`` with the values of the first rule that matches.

    A rule is ``{"match": {name: pattern or list}, "set": {column: value}}``: all of its names must match, any
    of a list's wildcards.  A rule without a match matches nothing.  Rules are few and ordered, so they become
    one chain of comparisons in the scan's stage: no join, no shuffle.
    """
    conditions = []
    for rule in rules:
        ok = F.lit(bool(rule["match"]))
        for name, patterns in rule["match"].items():
            one = F.lit(False)
            for p in [patterns] if isinstance(patterns, str) else patterns:
                one = one | F.coalesce(columns[name], F.lit("")).rlike(wildcard_regex(p))
            ok = ok & one
        conditions.append(ok)
    out = docs
    names = list(dict.fromkeys(n for r in rules for n in r["set"]))
    for n in names:
        value = F.lit(None).cast("string")
        for ok, rule in reversed(list(zip(conditions, rules))):
            value = F.when(ok, F.lit(rule["set"].get(n)).cast("string")).otherwise(value)
        out = out.withColumn(n, value)
    return out


def complete_places(docs: DataFrame, modules: DataFrame, areas: DataFrame) -> DataFrame:
    """Fill what a finer level implies: ``module`` gives subarea and area, ``subarea`` its parent area."""
    m = modules.select(F.col("module").alias("_m"), F.col("subarea").alias("_ms"), F.col("area").alias("_ma"))
    a = areas.select(F.col("subarea").alias("_s"), F.col("area").alias("_sa"))
    filled = docs.join(m, docs["module"] == m["_m"], "left").withColumns({"subarea": F.coalesce("subarea", "_ms"), "area": F.coalesce("area", "_ma")}).drop("_m", "_ms", "_ma")
    return filled.join(a, filled["subarea"] == a["_s"], "left").withColumn("area", F.coalesce("area", "_sa")).drop("_s", "_sa")


def owner_footprint(modules: DataFrame) -> DataFrame:
    """``owner, module, subarea, area``: an owner's one module, else the one subarea or area that all its modules share."""
    n, s, a = F.count("*"), F.count_distinct("subarea"), F.count_distinct("area")
    full_s, full_a = F.count("subarea") == n, F.count("area") == n
    g = modules.where(F.col("owner").isNotNull()).groupBy("owner").agg(n.alias("n"), F.min("module").alias("m"), F.when((s == 1) & full_s, F.min("subarea")).alias("s"), F.when((a == 1) & full_a, F.min("area")).alias("a"))
    one = F.col("n") == 1
    return g.select("owner", F.when(one, F.col("m")).alias("module"), F.when(~one, F.col("s")).alias("subarea"), F.when(~one & F.col("s").isNull(), F.col("a")).alias("area")).where("module is not null or subarea is not null or area is not null")


def specificity(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n).isNotNull()
    return F.when(c("module"), 3).when(c("subarea"), 2).when(c("area"), 1).otherwise(0)


def place_documents(docs: DataFrame, modules: DataFrame, areas: DataFrame, rules: list[dict], rule_columns: dict[str, Column]) -> DataFrame:
    """``source_id, module, subarea, area, via`` of documents (``source_id, stamped_module, repo, owner``).

    The document's own stamp first, then its repository's module, then the finer of the first matching rule and
    its owner's footprint (a tie goes to the rule).  Coarser levels are filled in.
    """
    ruled = first_match(docs, "source_id", rules, rule_columns)
    for n in ("module", "subarea", "area"):
        ruled = ruled.withColumnRenamed(n, f"r_{n}") if n in ruled.columns else ruled.withColumn(f"r_{n}", F.lit(None).cast("string"))
    foot = owner_footprint(modules).select(F.col("owner").alias("_o"), *[F.col(n).alias(f"o_{n}") for n in ("module", "subarea", "area")])
    repos = modules.where(F.col("repo").isNotNull()).groupBy(F.lower("repo").alias("_r")).agg(F.min("module").alias("repo_module"))
    j = ruled.join(foot, ruled["owner"] == foot["_o"], "left").join(repos, F.lower(ruled["repo"]) == repos["_r"], "left")
    by_rule = (specificity("r_") > 0) & (specificity("r_") >= specificity("o_"))
    via = F.when(F.col("stamped_module").isNotNull(), "stamp").when(F.col("repo_module").isNotNull(), "repo").when(by_rule, "rule").when(specificity("o_") > 0, "owner").otherwise("none")
    placed = j.withColumn("via", via)
    pick = lambda n: F.when(F.col("via") == "rule", F.col(f"r_{n}")).when(F.col("via") == "owner", F.col(f"o_{n}"))
    placed = placed.select("source_id", "via", F.coalesce("stamped_module", "repo_module", pick("module")).alias("module"), pick("subarea").alias("subarea"), pick("area").alias("area"))
    return complete_places(placed, modules, areas).select("source_id", "module", "subarea", "area", "via")


def place_labels(area: Column, subarea: Column, module: Column, nowhere: str = "Not in the map") -> tuple[Column, Column, Column]:
    """Titles for the three levels; a level that is missing below a known one reads ``… · other``."""
    other = lambda c: F.concat(c, F.lit(" · other"))
    s = F.coalesce(subarea, F.when(area.isNotNull(), other(area)), F.lit(nowhere))
    m = F.coalesce(module, F.when(subarea.isNotNull(), other(subarea)), F.when(area.isNotNull(), other(area)), F.lit(nowhere))
    return F.coalesce(area, F.lit(nowhere)), s, m


def humanize(name: Column) -> Column:
    """``tax-engine_v2`` reads ``Tax Engine V2``."""
    return F.initcap(F.trim(F.regexp_replace(name, "[-_]+", " ")))


def top_folders(paths: DataFrame, key: str, path: str, depth: int = 2, most: int = 5) -> DataFrame:
    """``key, folder, n, rank``: the ``most`` folders of each key that hold most files."""
    parts = F.split(F.col(path), "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.least(F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(depth))), "/")
    counted = paths.withColumn("folder", folder).where(F.col("folder") != "").groupBy(key, "folder").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "folder"))).where(F.col("rank") <= most)
