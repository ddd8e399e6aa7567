"""The end-to-end job: boxes to merged regions, gated patches, votes, maps, cleaned and assembled masks, and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, geometry, mask, overlap, votes
from .fixpoint import cut

#: Class ids of cells, by name.
CLASSES = {"background": 0, "tissue": 1, "artifact": 2}
NA = 9
SPAN = 1000


def mean_in_millionths(c: str) -> Column:
    """The mean, halves up; rounded to 12 digits first, so that a half stays one in whatever order the doubles are added."""
    return F.floor(F.round(F.avg(c), 12) * 1e6 + 0.5)


def slide_regions(boxes: DataFrame, padding: float = 0.25) -> DataFrame:
    """Merged, numbered regions of each slide in the upright view."""
    upright = geometry.rotate_box_to_upright(boxes.withColumns({c: F.col(c).cast("double") for c in geometry.BOX}))
    whole = geometry.pad_boxes(upright, padding).withColumns({c: (F.floor if c[1] == "1" else F.ceil)(F.col(c)) for c in geometry.BOX})
    merged = overlap.merge_boxes_any(whole).withColumn("label", F.lit(None).cast("string"))
    return catalog.number_regions(merged, ["idx"])


def gated_patches(regions: DataFrame, cells: DataFrame, size: int = 100, threshold: float = 0.05, side: int = 24) -> DataFrame:
    """The patch grid of each region with its foreground ratio and gate."""
    grid = geometry.patch_grid(regions.select("slide", "label", "x1", "y1", "x2", "y2"), size)
    grid = grid.withColumn("patch_id", F.concat_ws(":", "label", "patch_id")).withColumnRenamed("label", "region")
    ratio = overlap.foreground_ratio(grid, cells.filter("class_id = 1"), side / SPAN, ["slide"], side, side)
    return mask.gate_patches(ratio, threshold)


def patch_votes(regions: DataFrame, cells: DataFrame, size: int = 100, side: int = 24) -> DataFrame:
    """(slide, region, row, col, run, label): each cell votes, by its class, for the patch that holds its centre."""
    centre = lambda c: F.floor((F.col(c) + 0.5) * SPAN / side).cast("long")
    name = F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (v, k)])
    runs = cells.select("slide", centre("c").alias("x"), centre("r").alias("y"), (F.col("r") * side + F.col("c")).alias("run"), name[F.col("class_id").cast("int")].alias("label"))
    boxes = regions.select("slide", F.col("label").alias("region"), *[F.col(c).cast("long").alias(c) for c in geometry.BOX])
    inside = overlap.crop_pixels(runs, boxes, "slide", "region")
    return inside.select("slide", "region", F.floor(F.col("y") / size).cast("int").alias("row"), F.floor(F.col("x") / size).cast("int").alias("col"), "run", "label")


def region_maps(patches: DataFrame, runs: DataFrame) -> DataFrame:
    """(slide, region, r, c, class_id, quality_id) of every patch: the vote of its runs where it is kept, background elsewhere."""
    at = ["slide", "region", "row", "col"]
    voted = votes.majority_vote(runs, at, "label", "run", "background").select(*at, F.col("label").alias("_voted"))
    labelled = patches.join(voted, at, "left").withColumn("label", F.when(F.col("kept"), F.coalesce("_voted", F.lit("background"))).otherwise(F.col("label")))
    session = patches.sparkSession
    classes = session.createDataFrame([(k, v) for k, v in CLASSES.items()], "label string, ordinal int")
    rows = labelled.select("slide", "region", F.col("row").alias("r"), F.col("col").alias("c"), "label", F.lit(0).alias("quality_id"))
    return mask.build_maps(rows, classes, CLASSES["tissue"], NA).select("slide", "region", "r", "c", "class_id", "quality_id")


def slide_quality(boxes: DataFrame, cells: DataFrame, size: int = 100, side: int = 24) -> DataFrame:
    """One row a slide: regions, patches, gate, votes, the change that mask cleaning makes, and the assembled mask.

    Every step is keyed by slide, or by slide and region. Each region's grid is
    cleaned within its own rows and columns; slides without a region have no
    row.
    """
    regions = cut(slide_regions(boxes))
    patches = cut(gated_patches(regions, cells, size, side=side))
    maps = region_maps(patches, patch_votes(regions, cells, size, side))
    extent = patches.groupBy("slide", "region").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    maps = cut(maps.join(extent, ["slide", "region"]))
    keys = ["slide", "region", "rows", "cols"]
    tissue = maps.filter(F.col("class_id") == CLASSES["tissue"]).select(*keys, "r", "c")
    editable = maps.filter(F.col("class_id").isin(CLASSES["tissue"], CLASSES["background"])).select(*keys, "r", "c")
    clean = mask.clean_mask(tissue, editable, keys, "rows", "cols")
    delta = mask.mask_delta(tissue, clean, keys).groupBy("slide").agg(*[F.sum(c).alias(c) for c in ("before_cells", "after_cells", "added", "removed", "components_before", "small_components", "components_after")])
    after = mask.apply_mask(maps, clean, keys, CLASSES["tissue"], CLASSES["background"], NA)
    values = after.select("slide", "region", "r", "c", F.when(F.col("class_id") == CLASSES["tissue"], 2).when(F.col("class_id") == CLASSES["artifact"], 1).otherwise(0).alias("value"))
    n = SPAN // size
    whole = mask.assemble_slide_mask(values, regions.withColumnRenamed("label", "region"), "slide", "region", size, n, n)
    painted = whole.groupBy("slide").agg(F.count_if(F.col("value") == 2).alias("mask_tissue"), F.count_if(F.col("value") == 1).alias("mask_artifact"), F.count("*").alias("mask_cells"))
    tally = patches.groupBy("slide").agg(F.count_distinct("region").alias("n_regions"), F.count("*").alias("n_patches"), F.count_if("kept").alias("n_kept"), mean_in_millionths("fg_ratio").alias("mean_ratio"))
    out = tally.join(delta, "slide", "left").join(painted, "slide", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("slide", "mean_ratio")])
