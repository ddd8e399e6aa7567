"""Readers and writers of worklists, annotations, regions, points and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a patch result file, in order.
PATCH_COLUMNS = (
    "patch_id", "row", "col", "wsi_x", "wsi_y", "patch_w", "patch_h", "stage3_fg_ratio", "stage3_kept", "pred_label",
    "pred_label_canonical", "pred_blur", "classical_blur_score", "classical_sharp_score", "classical_blur_pass",
    "class_votes", "blur_votes", "vlm_runs", "batch_group_id", "batch_query_index", "batch_query_size", "batch_mode",
)
_INTS = ("row", "col", "wsi_x", "wsi_y", "patch_w", "patch_h", "vlm_runs", "batch_query_index", "batch_query_size")
_DOUBLES = ("stage3_fg_ratio", "classical_blur_score", "classical_sharp_score")
_BOOLS = ("stage3_kept", "classical_blur_pass")
_REQUIRED = ("patch_id", "row", "col")


def _numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, list_name, path, line_no) of text files that are read in splits, lines counted from 1.

    A line's number is its place within its split and the lines of the splits
    before it in the file; only a count a split is gathered.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("list_name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    size = lines.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lines.join(size.select("path", "_block", "_first", before.alias("_before")), ["path", "_block"])
    return out.select("value", "list_name", "path", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"))


def read_worklist(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(item, list_name, path, line_no) of one path a line; comments and blanks go; empty lists are an error."""
    df = _numbered_lines(spark, paths).select(F.trim("value").alias("item"), "list_name", "path", "line_no").filter("item <> '' AND item NOT LIKE '#%'")
    if df.isEmpty():
        raise ValueError("the worklists name no item")
    return df


def worklist_counts(df: DataFrame) -> DataFrame:
    """Items of each list; lists of one name in different folders are different lists."""
    return df.groupBy("list_name", "path").agg(F.count("*").alias("n")).orderBy("list_name", "path")


def read_pair_worklist(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (item, annotation) and the rejected ones; a header is known by its names."""
    df = _numbered_lines(spark, paths).withColumnRenamed("value", "line").withColumn("line_no", F.col("line_no") - 1)
    df = df.filter("trim(line) <> '' AND NOT trim(line) LIKE '#%'")
    df = df.withColumn("_c", F.from_csv("line", "item string, annotation string"))
    df = df.select("list_name", "path", "line_no", F.trim("_c.item").alias("item"), F.trim("_c.annotation").alias("annotation"))
    top = df.groupBy("path").agg(F.min_by(F.struct("line_no", "item"), "line_no").alias("_t"))
    head = top.filter(F.lower("_t.item").isin("item", "slide", "image", "wsi", "path")).select("path", "_t.line_no")
    df = df.join(head, ["path", "line_no"], "left_anti").drop("path").select("list_name", "line_no", "item", "annotation")
    bad = F.coalesce(F.col("item"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("annotation"), F.lit("")).eqNullSafe("")
    return df.filter(~bad), df.filter(bad)


_ANNOTATION = T.StructType([
    T.StructField("_Name", T.StringType()), T.StructField("_Type", T.StringType()), T.StructField("_PartOfGroup", T.StringType()),
    T.StructField("Coordinates", T.StructType([T.StructField("Coordinate", T.ArrayType(T.StructType([T.StructField("_X", T.StringType()), T.StructField("_Y", T.StringType())])))])),
])


def read_annotations(spark: SparkSession, path: str, group: str, include_non_rect: bool = False) -> DataFrame:
    """Boxes of a group's annotations: rectangles only unless asked, points that do not parse skipped, fewer than two dropped."""
    df = spark.read.format("xml").option("rowTag", "Annotation").schema(_ANNOTATION).load(path).filter(F.col("_PartOfGroup") == group)
    if not include_non_rect:
        df = df.filter(F.lower("_Type") == "rectangle")
    points = F.transform("Coordinates.Coordinate", lambda p: F.struct(p["_X"].try_cast("double").alias("x"), p["_Y"].try_cast("double").alias("y")))
    df = df.select(F.col("_Name").alias("name"), F.col("_Type").alias("type"), F.filter(points, lambda p: p.x.isNotNull() & p.y.isNotNull()).alias("_p"))
    df = df.filter("size(_p) >= 2").select("name", "type", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    return df.select("name", "type", F.array_min("x").alias("x1"), F.array_min("y").alias("y1"), F.array_max("x").alias("x2"), F.array_max("y").alias("y2"), F.size("x").alias("n_points"))


def regions_from_json(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, region, label, x1..y2): lists or objects of boxes under several names, or bare lists of four numbers."""
    v = F.try_parse_json(col)
    item = "array<variant>"
    rows = df.select(*keys, F.posexplode(F.coalesce(F.try_variant_get(v, "$.detected_regions", item), F.try_variant_get(v, "$", item))).alias("region", "_v"))
    nums = F.coalesce(*[F.try_variant_get("_v", f"$.{k}", "array<double>") for k in ("bbox_level0", "bbox", "box_2d", "bbox_2d")], F.try_variant_get("_v", "$", "array<double>"))
    rows = rows.withColumn("_b", nums).filter("size(_b) = 4")
    return rows.select(*keys, "region", F.try_variant_get("_v", "$.label", "string").alias("label"), *[F.col("_b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return regions_from_json(files.select(F.col("_metadata.file_path").alias("path"), "value"), ["path"], "value")


def points_from_json(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, label, idx, x, y): points with a full-resolution place, by class map or the older two keys."""
    point = "array<struct<point_l0:array<double>,vlm_index:int>>"
    new = F.from_json(col, f"struct<classes:map<string,{point}>>").classes
    old = F.from_json(col, f"struct<foreground:{point},background:{point}>")
    legacy = F.map_filter(F.create_map(F.lit("foreground"), old.foreground, F.lit("background"), old.background), lambda k, v: v.isNotNull())
    rows = df.select(*keys, F.explode(F.coalesce(new, legacy)).alias("_k", "_p")).select(*keys, F.lower(F.trim("_k")).alias("label"), F.posexplode("_p").alias("idx", "_q"))
    return rows.filter("size(_q.point_l0) = 2").select(*keys, "label", "idx", F.col("_q.point_l0")[0].cast("long").alias("x"), F.col("_q.point_l0")[1].cast("long").alias("y"))


def read_points(spark: SparkSession, path: str, region: str = "region") -> DataFrame:
    """Points of each region's files with their source; the root file wins over per-rotation files."""
    from .paths import with_path_keys

    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    files = with_path_keys(files.select(F.col("_metadata.file_path").alias("path"), "value"), "path")
    rank = F.when(F.col("path").rlike(r"rot_?\d+"), 1).otherwise(0)
    files = files.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy("case_id", "run_id", region)))
    files = files.filter("_rank = _best").withColumn("source", F.when(F.col("_rank") == 0, "root").otherwise("rotation"))
    return points_from_json(files, ["case_id", "run_id", region, "source"], "value")


def typed_patch_results(raw: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows and the malformed ones: blank and nan are null, truthy words true, the last row of a patch wins."""
    text = {c: F.when(~F.lower(F.trim(c)).isin("", "none", "nan", "null"), F.trim(c)) for c in PATCH_COLUMNS if c in raw.columns}
    get = lambda c: text.get(c, F.lit(None).cast("string"))
    typed = {c: get(c).try_cast("double").cast("int") for c in _INTS} | {c: get(c).try_cast("double") for c in _DOUBLES}
    typed |= {c: F.lower(get(c)).isin("1", "true", "yes", "y", "t") for c in _BOOLS}
    typed |= {c: F.from_json(get(c), "map<string,int>") for c in ("class_votes", "blur_votes")}
    rows = raw.select(*[typed.get(c, get(c)).alias(c) for c in PATCH_COLUMNS], F.col(order).alias("_o"))
    rows = rows.withColumn("pred_label", F.coalesce("pred_label", "pred_label_canonical", F.lit("background")))
    bad = " OR ".join(f"{c} IS NULL" for c in _REQUIRED)
    # a row without a next one is the last; a rank of 1 would be looked for before the shuffle too, by another sort of all rows
    last = rows.filter(f"NOT ({bad})").withColumn("_next", F.lead(F.lit(1)).over(Window.partitionBy("patch_id").orderBy("_o"))).filter("_next IS NULL")
    return last.drop("_next", "_o"), rows.filter(bad).drop("_o")


def patch_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows and the malformed ones of the files in a folder."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw.withColumn("_order", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return typed_patch_results(raw, "_order")


def read_patch_results(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Typed rows and the number of malformed ones, which takes a pass of its own."""
    good, bad = patch_results(spark, path)
    return good, bad.count()


def write_patch_results(df: DataFrame, path: str, save_variants: bool = False) -> None:
    """CSV in the column contract; vote maps as JSON."""
    cols = [F.to_json(c).alias(c) if c in ("class_votes", "blur_votes") else F.col(c) for c in PATCH_COLUMNS]
    df.select(*cols, *(["variants_json"] if save_variants else [])).write.option("header", True).option("escape", '"').csv(path)


def write_review_results(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines and flat rows as CSV."""
    from ..operators.reviews import flat_results

    df.write.json(f"{path}/results_jsonl")
    flat_results(df).write.option("header", True).csv(f"{path}/results_csv")


def write_retry_queue(df: DataFrame, path: str) -> None:
    """Rows to try again, as JSON lines and as CSV."""
    from ..operators.reviews import retry_queue

    rows = retry_queue(df)
    rows.write.json(f"{path}/retry_jsonl")
    rows.write.option("header", True).csv(f"{path}/retry_csv")


def write_cells(df: DataFrame, path: str) -> None:
    """Cells by slide; rows of a slide are gathered first, and a large slide is split, so files stay few."""
    df.hint("rebalance", "slide").write.partitionBy("slide").parquet(path)


def artifact_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length, modified) of every file under a folder and its path keys; contents are not read."""
    from .paths import with_path_keys

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return with_path_keys(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "path")
