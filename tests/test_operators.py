"""Hand-worked cases and small brute-force versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slidegrid.functions import labels, replies
from slidegrid.operators import catalog, geometry, mask, overlap, pixels, select, votes
from slidegrid.sources import files
from slidegrid.streaming import latest_progress, stream_patch_results, stream_progress, stream_review_summary


def boxes(spark, rows):
    return spark.createDataFrame(rows, "slide long, idx long, x1 double, y1 double, x2 double, y2 double")


def test_unknown_rotation_is_an_error(spark):
    df = spark.createDataFrame([(45, 1, 1, 2, 2)], "rot int, x1 int, y1 int, x2 int, y2 int")
    with pytest.raises(Exception, match="unknown rotation"):
        geometry.rotate_box_to_upright(df).collect()


def test_points_turned_four_times_come_back(spark):
    df = spark.createDataFrame([(90, 10, 300), (90, 0, 1000)], "rot int, nx int, ny int")
    out = df
    for _ in range(4):
        out = geometry.rotate_points_to_upright(out)
    assert sorted(out.collect()) == sorted(df.collect())


def test_degenerate_boxes_go(spark):
    df = spark.createDataFrame([("5", "5", "5", "9"), ("-3", "1.5", "7", "99"), ("x", "1", "2", "3")], "x1 string, y1 string, x2 string, y2 string").withColumns({"width": F.lit(10), "height": F.lit(10)})
    assert [(r.x1, r.y1, r.x2, r.y2) for r in geometry.clamp_boxes(df).collect()] == [(0, 2, 7, 10)]


def brute_any(items):
    items = [list(b) for b in items]
    while True:
        for a, b in itertools.combinations(range(len(items)), 2):
            p, q = items[a], items[b]
            if p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]:
                items = [x for i, x in enumerate(items) if i not in (a, b)] + [[min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]]
                break
        else:
            return sorted(items)


def test_merge_any_reaches_the_only_fixpoint(spark):
    random.seed(4)
    rows = []
    for s in range(6):
        for i in range(14):
            x, y = random.randint(0, 300), random.randint(0, 300)
            rows.append((s, i, float(x), float(y), float(x + random.randint(1, 60)), float(y + random.randint(1, 60))))
    got = overlap.merge_boxes_any(boxes(spark, rows)).collect()
    for s in range(6):
        assert sorted([r.x1, r.y1, r.x2, r.y2] for r in got if r.slide == s) == brute_any([r[2:] for r in rows if r[0] == s])


def test_threshold_merge_needs_overlap(spark):
    df = boxes(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 20.0, 20.0, 30.0, 30.0), (1, 2, 9.0, 9.0, 19.0, 19.0)]).withColumn("rot", F.lit(0))
    assert overlap.merge_boxes(df, 0.0).count() == 2
    assert overlap.merge_boxes(df, 0.5).count() == 3


def test_vote_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, None)], "p long, o long, label string")
    assert sorted((r.p, r.label, r.votes) for r in votes.majority_vote(df, ["p"], "label", "o", "background").collect()) == [(1, "b", 1), (2, "background", 0)]


def test_otsu_of_one_value(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.3)], "img long, gray double")
    assert pixels.otsu(df, "img").first().threshold == 0.5


def test_closing_is_extensive_and_holes_fill(spark):
    random.seed(5)
    cells = {(random.randrange(9), random.randrange(9)) for _ in range(40)}
    df = spark.createDataFrame([(1, r, c) for r, c in cells], "slide long, r long, c long")
    closed = {(r.r, r.c) for r in mask.close_mask(df, ["slide"], 9, 9, 3).collect()}
    assert cells <= closed
    ring = spark.createDataFrame([(1, r, c) for r in range(3, 6) for c in range(3, 6) if (r, c) != (4, 4)], "slide long, r long, c long")
    assert mask.fill_holes(ring, ["slide"], 9, 9).count() == 9


def test_windows_cover_everything(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 80)], "n long")
    for m in (1, 7, 25):
        got = {}
        for r in catalog.window_layout(df, "n", m).collect():
            got.setdefault(r.n, []).append((r.start, r.end))
        for n, spans in got.items():
            assert set().union(*[range(a, b) for a, b in spans]) == set(range(n)) and len(spans) == max(1, -(-n // m))


def test_relaxed_json(spark):
    df = spark.createDataFrame([('x {"a": 1} y',), ("```json\n{\"b\": 2}\n```",), ("none",), (None,), ("{ {\"c\":3}",)], "text string")
    got = {r.text: r.parsed for r in replies.parse_relaxed_json(df).collect()}
    assert got['x {"a": 1} y'] == '{"a":1}' and got["none"] is None and got[None] is None and got['{ {"c":3}'] == '{"c":3}'


def test_labels(spark):
    df = spark.createDataFrame([(" Fore-ground!",), ("FG",), (None,)], "t string")
    assert [r[0] for r in df.select(labels.canonical_label(F.col("t"))).collect()] == ["fore_ground", "tissue", None]


def test_worklists_and_patches(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\nx.svs\n\n y.svs \n")
    got = files.read_worklist(spark, [str(tmp_path / "a.txt")]).collect()
    assert sorted((r.item, r.list_name, r.line_no) for r in got) == [("x.svs", "a.txt", 2), ("y.svs", "a.txt", 4)]
    (tmp_path / "p.csv").write_text("item,annotation\nx.svs,x.xml\ny.svs,\n")
    good, bad = files.read_pair_worklist(spark, [str(tmp_path / "p.csv")])
    assert good.count() == 1 and bad.count() == 1
    row = {c: None for c in files.PATCH_COLUMNS} | {"patch_id": "r0", "row": 1, "col": 2, "pred_label": "tissue", "class_votes": {"tissue": 3}}
    schema = ", ".join(f"`{c}` {'int' if c in files._INTS else 'double' if c in files._DOUBLES else 'boolean' if c in files._BOOLS else 'map<string,int>' if c.endswith('_votes') else 'string'}" for c in files.PATCH_COLUMNS)
    df = spark.createDataFrame([tuple(row[c] for c in files.PATCH_COLUMNS)], schema)
    files.write_patch_results(df, str(tmp_path / "out"))
    back, malformed = files.read_patch_results(spark, str(tmp_path / "out"))
    assert malformed == 0 and back.first().class_votes == {"tissue": 3} and back.first().row == 1


def test_annotations(spark, tmp_path):
    one = '<Annotation Name="{n}" Type="{t}" PartOfGroup="g"><Coordinates><Coordinate X="1.5" Y="2"/><Coordinate X="7" Y="{y}"/></Coordinates></Annotation>'
    (tmp_path / "a.xml").write_text("<A><Annotations>" + one.format(n="a", t="Rectangle", y="9") + one.format(n="b", t="Polygon", y="x") + "</Annotations></A>")
    assert [(r.name, r.x1, r.y2) for r in files.read_annotations(spark, str(tmp_path / "a.xml"), "g").collect()] == [("a", 1.5, 9.0)]
    assert files.read_annotations(spark, str(tmp_path / "a.xml"), "g", True).count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("c", 1, "ok", None), ("c", 2, "", "HTTP 429"), ("c", 2, "", "HTTP 429")], "case_id string, item long, text string, error string")
    df.write.json(src)
    out = stream_review_summary(spark, src, df.schema, ["case_id", "item"], "case_id")
    q = out.writeStream.outputMode("complete").format("memory").queryName("tallies").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("tallies").collect()] == [("c", 2, 1, 1, 1)]
    p = str(tmp_path / "p")
    rows = spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00") for i in range(5)], "patch long, ts string")
    for _ in range(2):  # the second run finds new copies of what it has written
        rows.write.mode("append").parquet(p)
        stream_patch_results(spark, p, rows.schema, str(tmp_path / "o"), str(tmp_path / "k"), ["patch"], "ts").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_hulls_with_repeated_idents(spark):
    rng = random.Random(4)
    rows = [(i % 3, 0, i % 7, x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 60)) for i in range(150) for x, y in [(rng.randrange(900), rng.randrange(900))]]
    want = []
    for slide in range(3):
        left = [(i, *b) for s, _, i, *b in rows if s == slide]
        while True:  # any two hulls that overlap become one
            pair = next(((p, q) for k, p in enumerate(left) for q in left[k + 1 :] if min(p[3], q[3]) > max(p[1], q[1]) and min(p[4], q[4]) > max(p[2], q[2])), None)
            if pair is None:
                break
            p, q = pair
            left.remove(p)
            left.remove(q)
            left.append((min(p[0], q[0]), min(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), max(p[4], q[4])))
        want += [(slide, *x) for x in left]
    df = spark.createDataFrame(rows, "slide long, rot int, idx long, x1 long, y1 long, x2 long, y2 long")
    got = [(r.slide, r.idx, r.x1, r.y1, r.x2, r.y2) for r in overlap.merge_boxes_any(df).collect()]
    assert sorted(got) == sorted(want)
    # boxes without area stay where they are, and no box is lost or counted twice
    merged = overlap.merge_boxes(df, 1.1)
    assert merged.count() == len(rows) and merged.schema["x1"].dataType == df.schema["x1"].dataType


def test_equal_regions_and_patches_stay(spark):
    regions = spark.createDataFrame([(1, 0, 0, 100, 100)] * 3, "slide long, x1 long, y1 long, x2 long, y2 long")
    levels = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0)], "slide long, level int, downsample double")
    assert [r.level for r in geometry.best_level(regions, levels, 25).collect()] == [1, 1, 1]
    patches = spark.createDataFrame([(1, "p", 0, 0, 2, 2), (1, "p", 0, 0, 2, 2), (1, "p", 2, 2, 4, 4)], "slide long, patch_id string, px1 long, py1 long, px2 long, py2 long")
    cells = spark.createDataFrame([(1, 0, 0), (1, 3, 3), (1, 3, 2)], "slide long, r int, c int")
    assert sorted(r.fg_ratio for r in overlap.foreground_ratio(patches, cells, 1.0, ["slide"], 4, 4).collect()) == [0.25, 0.25, 0.5]


def test_class_replies_of_odd_shapes(spark):
    cases = [
        (None, "unknown", "NA", None), ("  ", "unknown", "NA", None), ("[]", "unknown", "NA", None), ("{}", "unknown", "NA", "json_without_class"),
        ('{"class quality":"Tissue","quality":"sharp"}', "tissue", "Sharp", None), ('{"my_class":"fg","quality class":"oof"}', "tissue", "Out of Focus", None),
        ('{"class":"","x":"foreground"}', "tissue", "NA", None), ("class: tissue; quality: blurred, rather", "tissue", "Somewhat Blurred", None),
        ("Tissue false", "tissue", "NA", None), ('{"class":"tissue"', "tissue", "NA", None), ('{"class":{"a":1}}', "unknown", "NA", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    got = replies.parse_class_response(df, ["background", "tissue"]).orderBy("id").collect()
    assert [(r.label, r.quality, r.error) for r in got] == [c[1:] for c in cases]


def test_review_files_hold_all_contract_columns(spark, tmp_path):
    from slidegrid.operators.reviews import RETRY_COLUMNS, REVIEW_COLUMNS

    df = spark.createDataFrame([("a", "success", (5, 7), "x"), ("b", "failed", None, None)], "case_id string, status string, usage struct<prompt_tokens:int,total_tokens:int>, error string")
    files.write_review_results(df, str(tmp_path))
    files.write_retry_queue(df, str(tmp_path))
    flat = spark.read.option("header", True).csv(str(tmp_path / "results_csv"))
    retry = spark.read.option("header", True).csv(str(tmp_path / "retry_csv"))
    assert tuple(flat.columns) == REVIEW_COLUMNS and len(REVIEW_COLUMNS) == 21
    assert tuple(retry.columns) == RETRY_COLUMNS and len(RETRY_COLUMNS) == 11
    assert sorted((r.case_id, r.total_tokens) for r in flat.collect()) == [("a", "7"), ("b", None)]
    assert [r.case_id for r in retry.collect()] == ["b"]


def test_worklists_in_splits(spark, tmp_path):
    rng = random.Random(3)
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        lines = [rng.choice(["# note", "", f"slide{i}.svs", f"  long/{'x' * rng.randrange(200)}{i}.svs "]) for i in range(3000)]
        (tmp_path / folder / "list.txt").write_text("\n".join(lines) + ("\n" if folder == "a" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_worklist(spark, [str(tmp_path / x / "list.txt") for x in "ab"])
        got = sorted((r.path.split("/")[-2], r.line_no, r.item) for r in df.collect())
        assert df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(x, i + 1, line.strip()) for x in "ab" for i, line in enumerate((tmp_path / x / "list.txt").read_text().split("\n")) if line.strip() and not line.strip().startswith("#")]
    assert got == sorted(want)
    counts = files.worklist_counts(df).collect()
    assert [(r.list_name, r.n) for r in counts] == [("list.txt", sum(w[0] == x for w in want)) for x in "ab"]


def test_read_points_prefers_the_root(spark, tmp_path):
    for at, x in (("c1/r1/bboxes/0_0_9_9/root", 1), ("c1/r1/bboxes/0_0_9_9/rot_90", 2), ("c1/r1/bboxes/1_0_9_9/rot_90", 3)):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "points.json").write_text('{"classes":{" Tissue":[{"point_l0":[%d,5]},{"vlm_index":3}]}}' % x)
    got = sorted((r.region, r.source, r.label, r.x, r.y) for r in files.read_points(spark, str(tmp_path)).collect())
    assert got == [("0_0_9_9", "root", "tissue", 1, 5), ("1_0_9_9", "rotation", "tissue", 3, 5)]


def test_artifact_catalog(spark, tmp_path):
    at = tmp_path / "case7" / "run1" / "bboxes" / "1_2_30_40"
    at.mkdir(parents=True)
    (at / "metadata.json").write_text("{}")
    (row,) = files.artifact_catalog(spark, str(tmp_path)).collect()
    assert (row["name"], row.length, row.case_id, row.run_id, row.region, row.x2) == ("metadata.json", 2, "case7", "run1", "1_2_30_40", 30)


def test_progress(spark):
    df = spark.createDataFrame([("x", True, False, "2024-01-01 00:00:00"), ("y", True, False, "2024-01-01 00:00:10"), ("z", True, True, "2024-01-01 09:00:00"), (None, True, False, None), (None, False, False, None)], "label string, k boolean, r boolean, t string")
    row = votes.progress_summary(df, F.col("k"), F.col("r"), F.col("t")).first()
    assert (row.kept, row.skipped, row.done, row.resumed, row.new, row.percent, row.rate, row.eta_seconds) == (4, 1, 3, 1, 3, 75.0, 0.2, 5.0)
    row = votes.progress_summary(df.filter("NOT k"), F.col("k"), F.col("r"), F.col("t")).first()
    assert (row.percent, row.rate, row.eta_seconds) == (100.0, 0.0, 0.0)


def test_progress_streams_in_two_runs(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([("a", i, f"2024-01-01 00:00:{10 * i:02d}") for i in range(4)] + [("b", 1, "2024-01-01 00:00:00")], "run string, patch long, ts string")
    totals = spark.createDataFrame([("a", 8), ("b", 1)], "run string, total long")
    got = []
    for part in ("patch < 2", "patch >= 1"):  # patch 1 arrives in both runs
        rows.filter(part).write.mode("append").parquet(source)
        stream_progress(spark, source, rows.schema, totals, target, state, "run", "patch", "ts").awaitTermination(120)
        got.append({r.run: (r.done, r.total, r.percent, round(r.rate, 3), round(r.eta_seconds, 3)) for r in latest_progress(spark, target, "run").collect()})
    assert got == [{"a": (2, 8, 25.0, 0.2, 30.0), "b": (1, 1, 100.0, 0.0, 0.0)}, {"a": (4, 8, 50.0, 0.133, 30.0), "b": (1, 1, 100.0, 0.0, 0.0)}]


def test_whole_json_objects(spark):
    texts = ['{"a":1}', '{"a":1} tail', '{"a":1}{"b":2}', '{"b": 2, "a": [1.50, {"z":null, "y":"é"}]}', '{"a":1},"b":{}', '{"a":1}}', "{}", "[1]", '{"a":NaN}', '{"a":1,"a":2}', "{'a':1}", 'no {"in": {"x":"{"}} more', "{" * 5000, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.parsed for r in replies.parse_relaxed_json(df).orderBy("i").collect()]
    assert got[:7] == ['{"a":1}', '{"a":1}', '{"a":1}', '{"a":[1.5,{"y":"é","z":null}],"b":2}', '{"a":1}', '{"a":1}', "{}"]
    assert got[7:] == [None, '{"a":null}', '{"a":2}', None, '{"in":{"x":"{"}}', None, None, None]


def test_tournament(spark):
    rng = random.Random(8)
    rows = [(g, f"c{i % 4}", i, rng.random()) for g, n in ((1, 300), (2, 20), (3, 75)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, c string, i long, s double")
    want = set()
    for g in (1, 2, 3):
        pool = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        while len(pool) > 25:
            calls = -(-len(pool) // 25)
            per = min(3, max(1, 25 // (calls * 4)))
            over, more = divmod(calls * 25 - len(pool), calls - 1)
            start, kept = 0, set()
            for w in range(calls):
                part = pool[start : start + 25]
                for c in {r[1] for r in part}:
                    kept |= set(sorted((r for r in part if r[1] == c), key=lambda r: (-r[3], r[2]))[:per])
                start += 25 - over - (w < more)
            pool = [r for r in pool if r in kept] if len(kept) < len(pool) else pool[:25]
        for c in {r[1] for r in pool}:
            want |= set(sorted((r for r in pool if r[1] == c), key=lambda r: (-r[3], r[2]))[:3])
    assert {(r.g, r.c, r.i, r.s) for r in select.tournament(df, "g", "c", "i", "s", 3, 25).collect()} == want
    everything = select.tournament(df, "g", "c", "i", "s", 3, 25, ranker=lambda pdf, k: pdf)  # a ranker that drops nothing: pools are cut
    assert {r.g: r.n for r in everything.groupBy("g").agg(F.count("*").alias("n")).collect()} == {1: 25, 2: 20, 3: 25}
    assert select.tournament(df, "g", "c", "i", "s", 3, 25, ranker=lambda pdf, k: pdf.head(0)).count() == 0
    first = select.tournament(df.filter("g = 3"), "g", "c", "i", "s", 5, 25, first_k=1)
    assert first.count() <= 12


def test_diverse_items_are_those_of_the_pairs(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, [rng.random() for _ in range(5)]) for i in range(40)] + [(7, 100, [1.0] * 5), (8, 101, [0.5] * 5), (8, 102, [0.5] * 5)]
    df = spark.createDataFrame(rows, "g long, i long, v array<double>")
    pairs = select.similarity_pairs(df, "g", "i", "v")
    got = sorted(tuple(r) for r in select.diverse_items(df, 4, "g", "i", "v").collect())
    assert [r for r in got if r[0] != 7] == sorted(tuple(r) for r in select.diverse_topk(pairs, 4, "g").collect())
    assert [r for r in got if r[0] == 7] == [(7, 100, 1)]


def test_mask_delta_counts_components(spark):
    old = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 5, 5), (1, 9, 9), (1, 9, 8)], "slide long, r long, c long")
    new = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (2, 4, 4)], "slide long, r long, c long")
    got = {r.slide: r.asDict() for r in mask.mask_delta(old, new, ["slide"]).collect()}
    assert [got[1][k] for k in ("before_cells", "after_cells", "added", "removed", "components_before", "components_after", "small_components", "small_cells")] == [6, 2, 0, 4, 3, 2, 2, 3]
    assert [got[2][k] for k in ("before_cells", "after_cells", "added", "components_before", "components_after", "small_components")] == [0, 1, 1, 0, 1, 0]


def test_worklist_counts_keep_the_names_of_lists(spark, tmp_path):
    from slidegrid.queries import QUERIES

    rows = [(1, "a"), (2, "a"), (3, "b/c=d e%"), (4, ""), (5, None), (6, "__HIVE_DEFAULT_PARTITION__")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.list_name: r.n for r in QUERIES["d22_worklist_counts"](spark, str(tmp_path)).collect()}
    assert got == {"a": 2, "b/c=d e%": 1, "": 1, None: 1, "__HIVE_DEFAULT_PARTITION__": 1}


def test_pairs_in_blocks_are_all_pairs(spark):
    rng = random.Random(3)
    rows = [(g, i, [rng.random() for _ in range(5)]) for g in ("p", "q") for i in range(40 if g == "p" else 1)]
    rows += [("p", 100, [0.5, None, 0.1, 0.2, 0.3]), ("p", 101, [0.5]), ("p", 102, None), ("p", 103, [float("nan"), 0.1, 0.1, 0.1, 0.1]), ("p", 3, [0.2] * 5), (None, 5, [0.1] * 5), (None, 6, [0.1] * 5)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    plain = df.selectExpr("g", "i AS a", "v").join(df.selectExpr("g", "i AS b", "v AS w"), "g").filter("a < b")
    plain = plain.selectExpr("g", "a", "b", "aggregate(zip_with(v, w, (x, y) -> least(x, y)), 0D, (t, x) -> t + x) AS sim")
    want = sorted(map(repr, plain.collect()))
    for block in (7, 1000):
        assert sorted(map(repr, select.similarity_pairs(df, "g", "i", "v", block).collect())) == want


def test_pairs_of_floats_and_their_totals(spark):
    rng = random.Random(6)
    rows = [("p", i, [rng.random() for _ in range(4)], rng.random() + 0.5) for i in range(30)] + [("p", 50, [0.5, None, 0.1, 0.2], 1.5), ("p", 51, [0.25], 0.5), ("p", 52, [0.1] * 4, None)]
    df = spark.createDataFrame(rows, "g string, i long, v array<float>, n double")
    shares = df.selectExpr("g", "i", "transform(v, x -> double(x) / n) AS v")
    want = sorted(map(repr, select.similarity_pairs(shares, "g", "i", "v", 7).collect()))
    assert sorted(map(repr, select.similarity_pairs(df, "g", "i", "v", 7, total="n").collect())) == want


def test_an_item_is_sent_to_few_tasks(spark, monkeypatch):
    df = spark.createDataFrame([("p", i, [i / 7, 1.0]) for i in range(200)], "g string, i long, v array<double>")
    where = select.similarity_pairs(df, "g", "i", "v", 7).groupBy(F.spark_partition_id()).count().collect()
    assert len(where) > 1 and sum(r["count"] for r in where) == 200 * 199 // 2

    def sizes(by):
        return lambda t: pa.table([t.column(by).slice(0, 1), pa.array([t.num_rows]), pa.array([t.num_rows]), pa.array([0.0])], [by, "a", "b", "sim"])

    monkeypatch.setattr(select, "_block_pairs", sizes)
    assert sum(r.a for r in select.similarity_pairs(df, "g", "i", "v", 7).collect()) == 3 * 200
    monkeypatch.setattr(select, "VALUES", 40)
    got = [r.a for r in select.similarity_pairs(df, "g", "i", "v").collect()]
    assert sum(got) == 10 * 200 and max(got) < 2 * 40


def test_pairs_of_blocks_in_tiles(monkeypatch):
    monkeypatch.setattr(select, "TILE", 50)
    rng = np.random.default_rng(5)
    ids, v, late = rng.permutation(180) // 2 * 5, rng.random((180, 3)), rng.random(180) < 0.4
    for same in (True, False):
        names = ids if same else np.where(late, ids, ids + 1)
        rows = {"g": ["p"] * 180, "_x": [0] * 180, "_y": [0 if same else 1] * 180, "_late": late & (not same), "id": names, "v": (v * 4).tolist(), "_sum": [4.0] * 180}
        out = list(select._block_pairs("g")(iter(pa.table(rows).to_batches(70))))
        met = [(i, j) for i in range(180) for j in range(180) if (names[i] < names[j] if same else late[j] and not late[i])]
        want = sorted(("p", min(names[i], names[j]), max(names[i], names[j]), np.minimum(v[i], v[j]).tolist()) for i, j in met)
        assert max(b.num_rows for b in out) <= 64 * 50
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == sorted((g, a, b, x + y + z) for g, a, b, (x, y, z) in want)


def test_cohesion_of_items_is_that_of_their_pairs(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(g, i, [rng.random() for _ in range(6)]) for g in (1, 2) for i in range(11 * g)] + [(3, 1, [0.5] * 6)], "g int, i long, v array<double>")
    want = select.selection_cohesion(select.similarity_pairs(df, "g", "i", "v"), df.select("g", F.col("i").alias("id")), "g")
    got = {r.g: r.cohesion for r in select.cohesion_of_items(df, "g", "i", "v").collect()}
    assert got == pytest.approx({r.g: r.cohesion for r in want.collect()}, abs=1e-12)


def test_choice_and_cohesion_queries_form_no_pairs(spark, monkeypatch):
    from slidegrid.queries import QUERIES

    monkeypatch.setattr(select, "similarity_pairs", None)
    assert QUERIES["f7_diverse_topk_of_pairs"](spark, "/root/testdata/sf0.001").count() > 0
    assert QUERIES["d23_selection_cohesion"](spark, "/root/testdata/sf0.001").count() > 0


def test_mean_of_a_half_does_not_depend_on_order(spark):
    from slidegrid.plans.slide_quality import mean_in_millionths

    rng, values = random.Random(1), [1 / 9] * 27 + [1 / 6] * 12 + [0.5] + [0.0] * 24
    orders = [(k, x) for k in range(40) for x in rng.sample(values, len(values))]
    got = spark.createDataFrame(orders, "k int, x double").coalesce(1).groupBy("k").agg(mean_in_millionths("x").alias("m")).collect()
    assert {r.m for r in got} == {85938}


def test_annotation_files_stay_small(spark, monkeypatch):
    from slidegrid.queries import files as queries

    monkeypatch.setattr(queries, "ANNOTATIONS", 500)
    found = queries.QUERIES["a3_read_annotations"](spark, "/root/testdata/sf0.001").inputFiles()
    assert len(found) >= 6000 / 500


def test_files_of_rows_are_written_by_tasks(spark, tmp_path):
    from slidegrid.queries.files import _plain_files

    want = {f"case_no={i // 4}/form={i % 4}.json": f"[{i}] é\n" for i in range(40)} | {"top.json": ""}
    rows = spark.createDataFrame(sorted(want.items()), "at string, value string").repartition(3)
    for base in (f"file:{tmp_path}/a", f"file://{tmp_path}/b", f"{tmp_path}/c"):
        _plain_files(rows, base)
        at = tmp_path / base[-1]
        assert {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file()} == want


def test_last_rows_of_patches_take_one_sort(spark):
    rows = [("a", "1", "1", "old", 1), ("a", "1", "2", "new", 2), ("b", "1", "1", "only", 1), ("b", "nan", "1", "bad", 2)]
    raw = spark.createDataFrame(rows, "patch_id string, row string, col string, pred_label string, at int")
    good, bad = files.typed_patch_results(raw, "at")
    assert sorted((r.patch_id, r.col, r.pred_label) for r in good.collect()) == [("a", 2, "new"), ("b", 1, "only")]
    assert [r.pred_label for r in bad.collect()] == ["bad"]
    assert good._jdf.queryExecution().sparkPlan().toString().count("WindowGroupLimit") == 0
