"""Queries of sources, sinks and streams: rows of the tables are written to files in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.fixpoint import shared_folder
from ..sources import files as S
from ..streaming import latest_progress, stream_patch_results, stream_progress, stream_review_summary
from . import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Annotations of one XML file at most, of about 350 bytes each.
ANNOTATIONS = 100_000


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


def folder(spark) -> str:
    return f"{shared_folder(spark)}/slidegrid-files-{uuid.uuid4().hex}"


@_add("a1_read_worklist", "SELECT concat('doc', doc_id) AS item, 0 AS place FROM documents")
def _(spark, d):
    path = folder(spark)
    lines = F.concat(F.lit("# a note\n\n  doc"), "doc_id", F.lit("  "))
    X.table(spark, d, "documents").select(lines.alias("value")).write.text(path)
    return S.read_worklist(spark, [path]).select("item", (F.col("line_no") % 3).alias("place"))


@_add("a2_read_pair_worklist", "SELECT concat('s', o_orderkey) AS item, CASE WHEN o_orderkey % 10 <> 0 THEN concat(o_custkey, ', x.xml') END AS annotation, o_orderkey % 10 <> 0 AS ok FROM orders")
def _(spark, d):
    path = folder(spark)
    note = F.when(F.col("o_orderkey") % 10 != 0, F.concat("o_custkey", F.lit(", x.xml")))
    X.table(spark, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("item"), note.alias("annotation")).write.option("header", True).csv(path)
    good, bad = S.read_pair_worklist(spark, [path])
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).select("item", "annotation", "ok")


@_add("a3_read_annotations", f"SELECT idx, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, 2 AS n_points FROM ({X.BOXES}) WHERE slide % 5 > 0 AND x1 % 3 > 0 AND y1 % 7 > 0")
def _(spark, d):
    path = folder(spark)
    point = lambda x, y: F.array(F.struct(x.cast("string").alias("_X"), y.cast("string").alias("_Y")))
    none = F.array().cast("array<struct<_X:string,_Y:string>>")
    odd = F.when(F.col("idx") % 2 == 0, point(F.lit("far"), F.lit("-5"))).otherwise(none)
    second = F.when(F.col("y1") % 7 > 0, point(F.col("x2"), F.col("y2"))).otherwise(none)
    kind = F.when(F.col("x1") % 3 > 0, "Rectangle").otherwise("Polygon")
    group = F.when(F.col("slide") % 5 > 0, "tissue").otherwise("other")
    points = F.struct(F.concat(point(F.col("x1"), F.col("y1")), odd, second).alias("Coordinate"))
    rows = X.boxes(spark, d).select(F.col("idx").alias("_Name"), kind.alias("_Type"), group.alias("_PartOfGroup"), points.alias("Coordinates"))
    # a file of XML is read by one task, so a file holds a bounded number of annotations, whatever a writing task holds
    rows.write.format("xml").option("rowTag", "Annotation").option("rootTag", "Annotations").option("maxRecordsPerFile", ANNOTATIONS).save(path)
    out = S.read_annotations(spark, path, "tissue")
    return out.select(F.col("name").cast("long").alias("idx"), "x1", "y1", "x2", "y2", "n_points")


_PATCH = f"SELECT concat(slide, '_', idx) AS patch_id, x1 AS row, y1 AS col, x2 AS wsi_x, CASE WHEN idx % 3 = 0 THEN NULL ELSE 0.25 END AS ratio, y2 % 4 < 3 AS kept, CASE x1 % 3 WHEN 0 THEN 'tissue' WHEN 1 THEN 'fold' ELSE 'background' END AS label, x1 % 4 AS votes FROM ({X.BOXES})"


def _pick(by, *words):
    return F.get(F.array(*map(F.lit, words)), by)


@_add("a6_read_patch_results", f"SELECT patch_id, row, col, wsi_x, CAST(ratio AS DOUBLE) AS ratio, kept, label, votes FROM ({_PATCH}) WHERE row % 11 > 0")
def _(spark, d):
    path = folder(spark)
    b = X.boxes(spark, d)
    raw = b.select(
        F.concat_ws("_", "slide", "idx").alias("patch_id"), F.when(F.col("x1") % 11 > 0, F.concat("x1", F.lit(".0"))).otherwise("nan").alias("row"),
        F.col("y1").cast("string").alias("col"), F.explode(F.array(F.lit("x"), F.col("x2").cast("string"))).alias("wsi_x"),  # the later row of a patch wins
        F.when(F.col("idx") % 3 == 0, "None").otherwise(" 0.25 ").alias("stage3_fg_ratio"), _pick((F.col("y2") % 4).cast("int"), "Yes", "t", "1", "no").alias("stage3_kept"),
        F.when(F.col("x1") % 3 == 0, "tissue").otherwise("").alias("pred_label"), F.when(F.col("x1") % 3 == 1, "fold").otherwise("None").alias("pred_label_canonical"),
        F.concat(F.lit('{"tissue": '), F.col("x1") % 4, F.lit("}")).alias("class_votes"))
    raw.write.option("header", True).option("escape", '"').csv(path)
    rows, _ = S.patch_results(spark, path)
    return rows.select("patch_id", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "wsi_x")], F.col("stage3_fg_ratio").alias("ratio"), F.col("stage3_kept").alias("kept"), F.col("pred_label").alias("label"), F.col("class_votes")["tissue"].cast("long").alias("votes"))


@_add("a7_write_patch_results", f"SELECT patch_id, row, col, label, concat('{{\"tissue\":', votes, '}}') AS class_votes, 22 AS n_columns FROM ({_PATCH})")
def _(spark, d):
    path = folder(spark)
    b = X.boxes(spark, d)
    have = {
        "patch_id": F.concat_ws("_", "slide", "idx"), "row": F.col("x1"), "col": F.col("y1"), "class_votes": F.create_map(F.lit("tissue"), F.col("x1") % 4),
        "blur_votes": F.create_map(F.lit("Sharp"), F.lit(1)), "pred_label": _pick((F.col("x1") % 3).cast("int"), "tissue", "fold", "background"),
    }
    S.write_patch_results(b.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in S.PATCH_COLUMNS]), path)
    got = spark.read.option("header", True).option("escape", '"').csv(path)
    return got.select("patch_id", F.col("row").cast("long"), F.col("col").cast("long"), F.col("pred_label").alias("label"), "class_votes", F.lit(len(got.columns)).alias("n_columns"))


@_add("a13_write_cells", f"SELECT slide, r, c, class_id FROM ({X.CELLS})")
def _(spark, d):
    path = folder(spark)
    cells = X.cells(spark, d)
    S.write_cells(cells, path)
    return spark.read.schema(cells.schema).parquet(path).select("slide", "r", "c", "class_id")


@_add("j1_review_summary", f"SELECT model, count(*) AS total, count(*) FILTER (trim(text) <> '') AS success, count(*) FILTER (trim(text) = '') AS failed, count(error) AS rate_limited FROM (SELECT DISTINCT case_id, item, model, text, error FROM ({X.REVIEWS})) GROUP BY 1")
def _(spark, d):
    path = folder(spark)
    rows = X.reviews(spark, d).select("case_id", "item", "model", "text", "error")
    rows.write.json(f"{path}/in")
    rows.write.mode("append").json(f"{path}/in")  # each result arrives twice and counts once
    tally = stream_review_summary(spark, f"{path}/in", rows.schema, ["case_id", "item"], "model")

    def save(batch, _):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    job = tally.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("model", "total", "success", "failed", "rate_limited")


@_add("j2_patch_results", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path = folder(spark)
    e = X.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    half = e.agg(F.timestamp_seconds(F.floor(F.avg(F.unix_seconds("ts")))).alias("t")).first().t
    for part in (F.col("ts") < F.lit(half), F.col("ts") >= F.lit(half)):  # the second run goes on where the first ended
        some = e.filter(part)
        some.unionByName(some).write.mode("append").parquet(f"{path}/in")
        stream_patch_results(spark, f"{path}/in", e.schema, f"{path}/out", f"{path}/state", ["event_id"], "ts").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "event_type")


def _a_file_each(rows, path: str, folders: list[str]) -> None:
    """Rows of (folders, value) as one text file a folder."""
    rows.repartition(*folders).write.partitionBy(*folders).text(path)


_REGIONS = f"SELECT *, CAST(floor(slide / 16.0) AS BIGINT) AS case_no, idx % 4 AS form FROM ({X.BOXES})"


@_add("a4_read_regions", f"SELECT case_no, form, CAST(row_number() OVER (PARTITION BY case_no, form ORDER BY slide, idx) - 1 AS INT) AS region, x1, y1, x2, y2, CASE WHEN form IN (0, 2) THEN 'r' END AS label FROM ({_REGIONS})")
def _(spark, d):
    path = folder(spark)
    b = X.boxes(spark, d).withColumns({"case_no": F.floor(F.col("slide") / 16.0), "form": F.col("idx") % 4})
    nums = F.concat(F.lit("["), F.concat_ws(",", "x1", "y1", "x2", "y2"), F.lit("]"))
    forms = ('{"label":"r","bbox_level0":', "", '{"label":"r","box_2d":', '{"bbox":')
    one = F.concat(_pick(F.col("form").cast("int"), *forms), nums, F.when(F.col("form") != 1, "}").otherwise(""))
    # a file holds the regions of a case in one of the four forms: bare lists, or objects in a list or under a name
    whole = b.groupBy("case_no", "form").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slide", "idx", one.alias("js")))), lambda x: x.js), ",").alias("js"))
    named = F.col("form") % 3 == 0
    text = F.concat(F.when(named, '{"detected_regions":[').otherwise("["), "js", F.when(named, "]}").otherwise("]"))
    _plain_files(whole.select(F.concat(F.lit("case_no="), "case_no", F.lit("/form="), "form", F.lit(".json")).alias("at"), text.alias("value")), path)
    out = S.read_regions(spark, path)
    at = {k: F.regexp_extract("path", rf"{k}=(\d+)", 1).cast("long").alias(k) for k in ("case_no", "form")}
    return out.select(*at.values(), "region", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "label")


_POINTS = "SELECT *, CASE user_id % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'both' WHEN 2 THEN 'turned' ELSE 'legacy' END AS files FROM events"


@_add("a5_read_points", f"SELECT CAST(user_id % 64 AS BIGINT) AS case_no, CASE WHEN files = 'turned' THEN 'rotation' ELSE 'root' END AS source, CASE WHEN files = 'legacy' THEN 'foreground' ELSE lower(event_type) END AS label, CAST(event_id % 50 AS BIGINT) AS x, CAST(event_id % 70 AS BIGINT) AS y FROM ({_POINTS}) WHERE event_id % 5 > 0")
def _(spark, d):
    path = folder(spark)
    e = X.table(spark, d, "events").withColumn("case", F.concat(F.lit("case"), (F.col("user_id") % 64).cast("string")))
    at = F.concat(F.lit('"point_l0":['), F.concat_ws(",", F.col("event_id") % 50, F.col("event_id") % 70), F.lit("]"))
    point = F.concat(F.lit("{"), F.when(F.col("event_id") % 5 > 0, at).otherwise('"vlm_index":1'), F.lit("}"))
    by = e.groupBy("case", (F.col("user_id") % 4).alias("kind"), "event_type").agg(F.array_join(F.collect_list(point), ",").alias("p"))
    entry = F.concat(F.lit('" '), F.upper("event_type"), F.lit(' ":['), "p", F.lit("]"))
    whole = by.groupBy("case", "kind").agg(F.array_join(F.collect_list(entry), ",").alias("entries"), F.array_join(F.collect_list("p"), ",").alias("p"))
    text = F.when(F.col("kind") == 3, F.concat(F.lit('{"foreground":['), "p", F.lit("]}"))).otherwise(F.concat(F.lit('{"classes":{'), "entries", F.lit("}}")))
    # a region of kind 1 has the same points at its root and, to be passed over, in a file of a rotation; kind 2 has that alone
    files = whole.withColumn("place", F.explode(F.when(F.col("kind") == 1, F.array(F.lit("root"), F.lit("rot_90"))).when(F.col("kind") == 2, F.array(F.lit("rot_90"))).otherwise(F.array(F.lit("root")))))
    rows = files.select("case", F.lit("run1").alias("run"), F.lit("bboxes").alias("anchor"), F.concat_ws("_", F.col("kind") + 1, F.lit("0"), F.lit("9"), F.lit("9")).alias("box"), "place", text.alias("value"))
    _plain_folders(spark, rows, path, ["case", "run", "anchor", "box", "place"])
    return S.read_points(spark, path).select(F.substring("case_id", 5, 9).cast("long").alias("case_no"), "source", "label", "x", "y")


def _plain_folders(spark, rows, path: str, folders: list[str]) -> None:
    """One text file a row in folders that are named by values only."""
    _plain_files(rows.select(F.concat_ws("/", *folders, F.lit("points.json")).alias("at"), "value"), path)


def _plain_files(rows, path: str) -> None:
    """One text file for each row of (at, value), written in tasks through the file system of the path.

    Spark's writers take milliseconds for a small file and commit all of them in the driver.
    """
    import pyarrow.fs as pafs

    base = path.removeprefix("file:")
    base = "file://" + base.removeprefix("//") if base.startswith("/") else base

    def put(batches):
        fs, root = pafs.FileSystem.from_uri(base)
        made = set()
        for b in batches:
            for at, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where = f"{root}/{at}"
                if (parent := where.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made = {parent}
                with fs.open_output_stream(where) as out:
                    out.write(value.encode())
            yield b.slice(0, 0)

    rows.mapInArrow(put, rows.schema).count()


@_add("a12_artifact_catalog", "SELECT source, lang, 1 AS n_files, count(*) AS n_lines FROM documents GROUP BY ALL")
def _(spark, d):
    path = folder(spark)
    docs = X.table(spark, d, "documents").select("source", "lang", F.lit("x").alias("value"))
    _a_file_each(docs, path, ["source", "lang"])
    found = S.artifact_catalog(spark, path).filter("name LIKE 'part-%'")
    part = lambda k: F.nullif(F.regexp_extract("path", rf"/{k}=([^/]*)", 1), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(k)
    return found.groupBy(part("source"), part("lang")).agg(F.count("*").alias("n_files"), F.floor(F.sum("length") / 2).alias("n_lines"))


@_add("d22_worklist_counts", "SELECT source AS list_name, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    path = folder(spark)
    # folders are named by the bytes of a source in hex, so that null, empty and odd names stay apart
    name = F.concat(F.lit("x"), F.hex(F.encode("source", "utf-8"))).alias("list")
    X.table(spark, d, "documents").select(name, F.concat(F.lit("doc"), "doc_id").alias("value")).write.partitionBy("list").text(path)
    files = S.worklist_counts(S.read_worklist(spark, [path]))
    of = F.decode(F.unhex(F.nullif(F.regexp_extract("path", "/list=x([0-9A-F]*)/", 1), F.when(~F.col("path").contains("/list=x"), F.lit("")))), "utf-8")
    return files.groupBy(of.alias("list_name")).agg(F.sum("n").alias("n"))


@_add("j3_progress", "SELECT user_id, count(*) AS done, any_value(total) AS total, CAST(floor(100.0 * count(*) / any_value(total) * 1e6 + 0.5) AS BIGINT) AS percent, CAST(floor(CASE WHEN max(ts) > min(ts) THEN count(*) / (epoch(max(ts)) - epoch(min(ts))) ELSE 0 END * 1e6 + 0.5) AS BIGINT) AS rate FROM events JOIN (SELECT user_id, 2 * count(*) AS total FROM events GROUP BY 1) USING (user_id) GROUP BY 1")
def _(spark, d):
    path = folder(spark)
    e = X.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    totals = e.groupBy("user_id").agg((2 * F.count("*")).alias("total"))
    half = e.agg(F.timestamp_seconds(F.floor(F.avg(F.unix_seconds("ts")))).alias("t")).first().t
    for part in (F.col("ts") < F.lit(half), F.col("ts") >= F.lit(half)):  # the second run goes on from the state of the first
        some = e.filter(part)
        some.unionByName(some).write.mode("append").parquet(f"{path}/in")
        stream_progress(spark, f"{path}/in", e.schema, totals, f"{path}/out", f"{path}/state", "user_id", "event_id", "ts").awaitTermination()
    out = latest_progress(spark, f"{path}/out", "user_id")
    return out.select("user_id", "done", "total", F.floor(F.col("percent") * 1e6 + 0.5).alias("percent"), F.floor(F.col("rate") * 1e6 + 0.5).alias("rate"))
