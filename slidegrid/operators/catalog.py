"""Worklists, runs, completeness, resume, batches and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_regions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def number_regions(df: DataFrame, order: list[str], slide: str = "slide", label: str = "label", stem: str = "tissue") -> DataFrame:
    """Labels ``tissue_1``... by order within a slide; labels that exist stay."""
    n = F.row_number().over(Window.partitionBy(slide).orderBy(*order))
    return df.withColumn(label, F.coalesce(label, F.concat(F.lit(f"{stem}_"), n)))


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest name of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def assign_batches(df: DataFrame, n: int, slide: str = "slide", order: tuple[str, ...] = ("row", "col"), kept: str = "kept") -> DataFrame:
    """Batch id, index and size of kept rows in order; a skipped row is a batch of its own."""
    w = Window.partitionBy(slide, kept).orderBy(*order)
    at = F.row_number().over(w) - 1
    out = df.withColumn("_at", at)
    ident = F.when(F.col(kept), F.concat(F.lit("b"), F.floor(F.col("_at") / n))).otherwise(F.concat(F.lit("s"), F.col("_at")))
    out = out.withColumns({"batch_id": ident, "batch_index": F.when(F.col(kept), F.col("_at") % n).otherwise(F.lit(0))})
    return out.withColumn("batch_size", F.count("*").over(Window.partitionBy(slide, "batch_id"))).drop("_at")


def window_layout(df: DataFrame, n: str, m: int) -> DataFrame:
    """Start and end of ceil(n / m) windows of m that cover n items, the surplus spread over the first borders."""
    k = F.greatest(F.lit(1), F.ceil(F.col(n) / m)).cast("long")
    out = df.withColumn("_k", k).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    surplus, gaps = F.col("_k") * m - F.col(n), F.greatest(F.lit(1), F.col("_k") - 1)
    b, e = F.floor(surplus / gaps), surplus % gaps
    start = F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.col("window") * (m - b) - F.least(F.col("window"), e))
    out = out.withColumn("start", start.cast("long"))
    return out.withColumn("end", F.least(F.col(n), F.col("start") + m).cast("long")).drop("_k")


def assign_windows(items: DataFrame, layout: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Each item with every window that holds its ordinal."""
    spans = layout.select(*keys, "window", F.explode(F.expr("sequence(start, end - 1)")).alias(ordinal))
    return items.join(spans, [*keys, ordinal])


def candidate_manifest(df: DataFrame, region: list[str], cls: str, order: str) -> DataFrame:
    """Global index in class order and index within the class."""
    g, c = Window.partitionBy(*region).orderBy(cls, order), Window.partitionBy(*region, cls).orderBy(order)
    return df.withColumns({"global_index": F.row_number().over(g) - 1, "class_index": F.row_number().over(c) - 1})


def dedupe_ids(df: DataFrame, ids: str) -> DataFrame:
    return df.withColumn(ids, F.array_distinct(ids))


def cap_per_class(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each class; n of 0 or less means all."""
    if n <= 0:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sample_per_class(df: DataFrame, k: int, seed: int, keys: list[str], ident: str) -> DataFrame:
    """k rows of each class in seeded hash order."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(ident).cast("string")))
    return cap_per_class(df.withColumn("_h", h), k, keys, ["_h"]).drop("_h")


def cap_cases(df: DataFrame, max_cases: int, case: str, item: str, per_case: int) -> DataFrame:
    """Rows of the first cases by name, and the first items of each."""
    first = df.select(case).distinct().orderBy(case).limit(max_cases)
    return cap_per_class(df.join(first, case, "left_semi"), per_case, [case], [item])


def order_group(df: DataFrame, keys: list[str], rank: str, ident: str) -> DataFrame:
    """Position within a group, null ranks last, then by id."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(rank), F.asc(ident))
    return df.withColumn("position", F.row_number().over(w))


def present_classes(df: DataFrame, classes: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Classes present in each group in canonical order (``ordinal``), as a comma list."""
    seen = df.select(*keys, cls).distinct().join(classes, cls)
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", cls))), lambda s: s[cls])
    return seen.groupBy(*keys).agg(F.array_join(names, ",").alias("classes"))


def resume_join(grid: DataFrame, stored: DataFrame, keys: list[str], prefer_stored: list[str]) -> DataFrame:
    """Grid rows with stored values where they exist; ``resumed`` says which."""
    s = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in prefer_stored], F.lit(True).alias("_hit"))
    out = grid.join(s, keys, "left")
    for c in prefer_stored:
        base = [F.col(c)] if c in grid.columns else []
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), *base)).drop(f"_{c}")
    return out.withColumn("resumed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def stale_rows(grid: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(grid, keys, "left_anti")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    return tasks if overwrite else tasks.join(done, keys, "left_anti")


def complete_items(catalog: DataFrame, required: list[str], keys: list[str], name: str) -> DataFrame:
    """Missing artifacts of each item and whether it is complete."""
    have = catalog.groupBy(*keys).agg(F.collect_set(name).alias("_have"))
    need = F.array(*[F.lit(r) for r in required])
    missing = F.array_join(F.array_except(need, F.col("_have")), ",")
    return have.select(*keys, missing.alias("missing"), (missing == "").alias("complete"))


def run_completeness(regions: DataFrame, catalog: DataFrame, required: list[str], run: str, region: str, name: str) -> DataFrame:
    """The first missing ``region:stage`` of each run, null where nothing is missing."""
    stages = F.posexplode(F.array(*[F.lit(r) for r in required]))
    need = regions.select(run, region, stages.alias("_at", name))
    lack = need.join(catalog.select(run, region, name), [run, region, name], "left_anti")
    first = lack.groupBy(run).agg(F.min_by(F.concat_ws(":", F.col(region).cast("string"), F.col(name)), F.struct(region, "_at")).alias("first_missing"))
    return regions.select(run).distinct().join(first, run, "left").withColumn("complete", F.col("first_missing").isNull())


def resume_plan(cases: DataFrame, runs: DataFrame, case: str, run: str) -> DataFrame:
    """new, resume or skip for each case from its latest run."""
    latest = latest_per(runs, [case], run).select(case, run, "complete")
    plan = F.when(F.col(run).isNull(), "new").when(F.col("complete"), "skip").otherwise("resume")
    return cases.join(latest, case, "left").select(case, run, plan.alias("plan"))


def status_rollup(events: DataFrame, keys: list[str], stages: list[str], stage: str = "stage", error: str | None = None) -> DataFrame:
    """Done flags of each stage, the first failed stage and, of its failures, the least error text."""
    done = [F.coalesce(F.bool_or(F.when(F.col(stage) == s, F.col("ok"))), F.lit(False)).alias(f"done_{s}") for s in stages]
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    text = F.col(error) if error else F.lit(None).cast("string")
    first = F.min(F.when(~F.col("ok"), F.struct(rank.alias("n"), F.col(stage).alias("stage"), text.alias("error"))))
    names = [f"done_{s}" for s in stages]
    return events.groupBy(*keys).agg(*done, first.alias("_f")).select(*keys, *names, F.col("_f.stage").alias("first_failure"), F.col("_f.error").alias("error"))


def select_cases(df: DataFrame, item: str, allow: DataFrame | None = None, globs: list[str] = (), max_items: int | None = None) -> DataFrame:
    """Rows of items in the allow list that match any glob; of many items, the first ``max_items`` by name."""
    out = df if allow is None else df.join(allow, item, "left_semi")
    if globs:
        rex = "|".join("".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in g) for g in globs)
        out = out.filter(F.col(item).rlike(f"^(?:{rex})$"))
    if max_items is not None:
        out = out.join(out.select(item).distinct().orderBy(item).limit(max_items), item, "left_semi")
    return out


def fill_missing(groups: DataFrame, df: DataFrame, keys: list[str], default: dict[str, Column]) -> DataFrame:
    """Rows, and one synthetic row for each group without any."""
    lack = groups.select(*keys).join(df, keys, "left_anti").select(*keys, *[v.alias(k) for k, v in default.items()])
    return df.withColumn("synthetic", F.lit(False)).unionByName(lack.withColumn("synthetic", F.lit(True)), allowMissingColumns=True)


def replay_group(results: DataFrame, targets: DataFrame, keys: list[str], batch: str, ident: str) -> DataFrame:
    """All rows of the batches of target rows, in order; blank batches and batches of one give none."""
    t = results.join(targets, [*keys, ident], "left_semi").select(*keys, batch, F.col(ident).alias("target")).filter(f"{batch} IS NOT NULL AND {batch} <> ''")
    n = results.groupBy(*keys, batch).agg(F.count("*").alias("_n")).filter("_n > 1")
    out = results.join(n, [*keys, batch]).join(t, [*keys, batch])
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*keys, "target").orderBy(ident))).drop("_n")


def map_selection(calls: DataFrame, manifest: DataFrame, keys: list[str], local: str, ids: str) -> DataFrame:
    """Picks by local index as rows of the manifest; indices outside it are dropped."""
    picks = calls.select(*keys, F.posexplode(ids).alias("pick", local))
    return picks.join(manifest, [*keys, local])


def merge_round(pool: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """Pool rows that any window picked, once."""
    return pool.join(picks.select(*keys).distinct(), keys, "left_semi")


def point_summary(points: DataFrame, meta: DataFrame, region: list[str], cls: str) -> DataFrame:
    """Points by class; a region without points takes its metadata total."""
    n = points.groupBy(*region, cls).agg(F.count("*").alias("n")).withColumn("source", F.lit("files"))
    rest = meta.join(n.select(*region).distinct(), region, "left_anti")
    rest = rest.select(*region, F.lit(None).cast("string").alias(cls), F.coalesce("total", F.lit(0)).cast("long").alias("n"), F.when(F.col("total").isNull(), "none").otherwise("metadata").alias("source"))
    return n.unionByName(rest)
