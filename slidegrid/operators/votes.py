"""Ensemble votes, artifact verdicts and their tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROTATIONS = (0, 90, 180, 270)


def majority_vote(runs: DataFrame, keys: list[str], label: str, order: str, empty: str | None = None) -> DataFrame:
    """(keys, label, votes): the commonest label, the first seen winning a tie; null labels do not vote."""
    n = runs.groupBy(*keys, label).agg(F.count(label).alias("_n"), F.min(order).alias("_o"))
    best = n.groupBy(*keys).agg(F.max_by(F.struct(label, "_n"), F.when(F.col(label).isNotNull(), F.struct("_n", -F.col("_o")))).alias("_b"))
    return best.select(*keys, F.coalesce(F.col(f"_b.{label}"), F.lit(empty)).alias(label), F.coalesce("_b._n", F.lit(0)).alias("votes"))


def vote_map(runs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, votes): label counts as JSON with sorted labels."""
    n = runs.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col("_n"))))
    return n.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("votes"))


def resolve_strength(claims: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Strength of each claim: SD if absent, WA without evidence, else the model's WA or SA, WA by default."""
    met = claims.join(answers.select(*keys, F.upper(F.trim("answer")).alias("_a")), keys, "left")
    bare = F.col("evidence").isNull() | (F.trim("evidence") == "")
    strength = F.when(~F.coalesce("present", F.lit(False)), "SD").when(bare, "WA").when(F.col("_a").isin("WA", "SA"), F.col("_a")).otherwise("WA")
    return met.withColumn("strength", strength).drop("_a")


def artifact_verdicts(strengths: DataFrame, artifacts: list[str], region: list[str]) -> DataFrame:
    """Counts of SD, WA and SA over four views of each artifact; a view without a row counts as SD."""
    names = F.explode(F.array(*[F.lit(a) for a in artifacts]))
    dense = strengths.select(*region).distinct().withColumn("artifact", names)
    n = strengths.groupBy(*region, "artifact").agg(*[F.count_if(F.col("strength") == s).alias(s) for s in ("WA", "SA")])
    out = dense.join(n, [*region, "artifact"], "left").fillna(0, ["WA", "SA"])
    out = out.withColumn("SD", F.lit(len(ROTATIONS)) - F.col("WA") - F.col("SA"))
    verdict = F.when(F.col("SA") >= 3, "INCLUDE").when(F.col("SA") == 2, "CONFLICT").otherwise("EXCLUDE")
    return out.select(*region, "artifact", "SD", "WA", "SA", verdict.alias("verdict"))


def aggregate_claims(claims: DataFrame, keys: list[str], view: str = "rot") -> DataFrame:
    """(keys, evidence): present claims by view, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(view).cast("string").alias("k"), F.coalesce("evidence", F.lit("")).alias("v"))))
    return claims.filter("present").groupBy(*keys).agg(F.to_json(F.map_from_entries(rows)).alias("evidence"))


def verdict_summary(verdicts: DataFrame, region: list[str]) -> DataFrame:
    kinds = ("INCLUDE", "EXCLUDE", "CONFLICT")
    return verdicts.groupBy(*region).agg(*[F.count_if(F.col("verdict") == k).alias(f"n_{k.lower()}") for k in kinds], F.count_if(F.coalesce(~F.col("verdict").isin(*kinds), F.lit(True))).alias("n_error"))


def include_classes(verdicts: DataFrame, text: str = "note", default: str = "no note") -> DataFrame:
    """Rows to include, with a default text; conflicts are left out."""
    return verdicts.filter(F.col("verdict") == "INCLUDE").withColumn(text, F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default)))


def tta_counts(boxes: DataFrame, merged: DataFrame | None = None, slide: str = "slide", rot: str = "rot") -> DataFrame:
    """Boxes of each slide by view and in all, and how many are left of them in ``merged``."""
    out = boxes.groupBy(slide).agg(*[F.count_if(F.col(rot) == r).alias(f"n_{r}") for r in ROTATIONS], F.count("*").alias("n_all"))
    if merged is None:
        return out
    left = merged.groupBy(slide).agg(F.count("*").alias("n_merged"))
    return out.join(left, slide, "left").fillna(0, ["n_merged"])


def expand_variants(df: DataFrame, shuffles: int, rotations: tuple[int, ...], seed: int, ident: str) -> DataFrame:
    """Each row once for every shuffle and rotation, with a seeded rank key; the first shuffle keeps the order."""
    out = df.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    out = out.withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in rotations])))
    seeded = F.md5(F.concat_ws("-", (F.col("shuffle") + seed).cast("string"), F.col(ident).cast("string")))
    return out.withColumn("rank_key", F.when(F.col("shuffle") == 0, F.lit("")).otherwise(seeded))


def pace(done: Column, open_: Column, first: Column, last: Column) -> dict[str, Column]:
    """Rows a second between two times and the seconds that the open ones will take; 0 where no time has passed or nothing was done."""
    seconds = last.cast("double") - first.cast("double")
    rate = F.coalesce(F.when(seconds > 0, done / seconds), F.lit(0.0))
    return {"rate": rate, "eta_seconds": F.when(rate > 0, open_ / rate).otherwise(0.0)}


def progress_summary(df: DataFrame, kept: Column, resumed: Column, finished: Column | None = None, started: Column | None = None) -> DataFrame:
    """Counts of a run and its percentage; 100 where nothing is kept.

    With the time at which each row was finished, also the rate of new rows
    since ``started`` (without it, since the first of them) and the seconds
    left for those that are kept and not done.
    """
    k, ready = F.count_if(kept), kept & F.col("label").isNotNull()
    done, fresh = F.count_if(ready), ready & ~resumed
    out = {"kept": k, "skipped": F.count_if(~kept), "done": done, "resumed": F.count_if(kept & resumed), "new": F.count_if(kept & ~resumed), "percent": F.when(k == 0, 100.0).otherwise(100.0 * done / k)}
    if finished is not None:
        time = F.when(fresh, finished.cast("timestamp"))
        out |= pace(F.count_if(fresh), F.count_if(kept & ~resumed & ~ready), F.min(time if started is None else started.cast("timestamp")), F.max(time))
    return df.agg(*[v.alias(n) for n, v in out.items()])
