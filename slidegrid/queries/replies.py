"""Queries of labels, keys and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import replies as P
from ..sources import paths as S
from . import fixtures as X

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_Q = f"WITH q AS ({X.REPLIES}) "
_SLUG = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[\\s\\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g')"


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


_NAMES = {"Foreground": "tissue", " FG ": "tissue", "bg": "background", "Paraffin-Mounting": "paraffin_mounting_medium", "_pen / ink_": "pen_ink_marks", "Pen Ink Mark!": "pen_ink_marks", "Fold__": "fold"}
_GRADES = {"Sharp": "Sharp", "somewhat blurred": "Somewhat Blurred", "Slightly-Blurred": "Somewhat Blurred", "BLURRED": "Somewhat Blurred", "out of  focus": "Out of Focus", "OOF": "Out of Focus", "na": "NA", "N/A": "", "dull": ""}
_pick = lambda words, by: f"CASE {by} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


@_add("b13_canonical_label", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim({_SLUG('p_type')}, '_') ELSE {_pick(list(_NAMES.values()), 'p_partkey')} END AS label, {_pick(list(_GRADES.values()), 'p_partkey')} AS quality FROM part")
def _(spark, d):
    label = F.expr(f"CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE {_pick(list(_NAMES), 'p_partkey')} END")
    quality = F.expr(_pick(list(_GRADES), "p_partkey"))
    return X.table(spark, d, "part").select("p_partkey", L.canonical_label(label).alias("label"), L.canonical_quality(quality).alias("quality"))


@_add("b14_label_map", "WITH k AS (SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'background' WHEN 'click' THEN 'tissue' ELSE event_type END AS cls FROM events) SELECT user_id, cls, concat('CLASS_', row_number() OVER (PARTITION BY user_id ORDER BY CASE cls WHEN 'background' THEN 0 WHEN 'tissue' THEN 1 ELSE 2 END, cls) - 1) AS display FROM k")
def _(spark, d):
    cls = F.when(F.col("event_type") == "view", "background").when(F.col("event_type") == "click", "tissue").otherwise(F.col("event_type"))
    return L.label_map(X.table(spark, d, "events").select("user_id", cls.alias("cls")).distinct(), ["user_id"], "cls")


@_add("i10_config_hash", """SELECT o_orderkey, substr(md5(concat('{"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}')), 1, 8) AS h FROM orders""")
def _(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", L.config_hash("o_orderstatus", "o_custkey").alias("h"))


@_add("i11_keys", "SELECT p_partkey, concat_ws('_', p_partkey, p_size) AS k, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM part")
def _(spark, d):
    return X.table(spark, d, "part").select("p_partkey", L.box_key("p_partkey", "p_size").alias("k"), L.safe_name(F.col("p_type")).alias("safe"))


@_add("i1_strip_fence", _Q + "SELECT event_id, CASE WHEN event_id % 6 = 1 THEN concat('{\"label_class\":\"', upper(event_type), '\"}') ELSE trim(text) END AS body FROM q")
def _(spark, d):
    return X.replies(spark, d).select("event_id", P.strip_fence(F.col("text")).alias("body"))


#: Replies with the object that must be read from each; @ is the event's type, ~ a line break.
_OBJECTS = (
    ('{"quality": "Sharp", "class":"@"}', '{"class":"@","quality":"Sharp"}'),
    ('```json~{"label_class":"@"}~```', '{"label_class":"@"}'),
    ('{"class":"@","quality":"sharp"} hope this helps', '{"class":"@","quality":"sharp"}'),
    ('{"a":1}{"b":2}', '{"a":1}'),
    ('Sure: {"class" : "@", "n": [1, {"m": null}]} and {"more": 1}', '{"class":"@","n":[1,{"m":null}]}'),
    ('{"class":"@"} }', '{"class":"@"}'),
    ('{"class":"@"}, "quality": {"x": 1}', '{"class":"@"}'),
    ("I think this is @", None),
    ("", None),
    ('{"predictions": [', None),
    ('{broken {"inner":"@ {"}', '{"inner":"@ {"}'),
    ('["@"]', None),
    ("{}", "{}"),
    ("{} {}", "{}"),
)
_OBJECT = f"replace(replace({_pick([t for t, _ in _OBJECTS], 'event_id')}, '@', event_type), '~', chr(10))"
_READ = " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(_OBJECTS) if w is not None)


@_add("i2_parse_relaxed_json", f"SELECT event_id, replace(CASE event_id % {len(_OBJECTS)} {_READ} END, '@', event_type) AS parsed FROM events")
def _(spark, d):
    return P.parse_relaxed_json(X.table(spark, d, "events").selectExpr("event_id", f"{_OBJECT} AS text")).select("event_id", "parsed")


_ALLOW = ["tissue", "background", "pen_ink_marks"]
#: Replies of every shape, with the class and quality that each must give; @ is the class it speaks of, ^ a single quote.
_SHAPES = (
    ('{"class":"@","quality":"Sharp"}', "@", "Sharp"),
    ('```json~{"label_class":" @ ","Image Quality":"oof"}~```', "@", "Out of Focus"),
    ("Class: @ | Quality: Out of focus", "@", "Out of Focus"),
    ("I think this is @ here", "@", "NA"),
    ("", "unknown", "NA"),
    ('{"predictions": [', "unknown", "NA"),
    ('{"answer":"@","note":"slightly blurred"}', "@", "Somewhat Blurred"),
    ("The answer is TRUE", "tissue", "NA"),
    ("false, none of it", "background", "NA"),
    ("CLASS : @, surely; quality: sharp", "@", "Sharp"),
    ('["@"]', "@", "NA"),
    ('{"quality":"sharp","confidence":0.9}', "unknown", "NA"),
    ('{"class":null,"quality":"sharp"}', "unknown", "NA"),
    ('{"class":"@","quality":"sharp"} hope this helps', "@", "NA"),
    ('{"a":1}{"b":2}', "unknown", "NA"),
    ("{^class^:^@^,^quality^:^sharp^}", "@", "NA"),
    ('{"class":"@"} quality: oof }', "@", "Out of Focus"),
)
_CLS = "CASE event_type WHEN 'click' THEN 'tissue' WHEN 'view' THEN 'background' WHEN 'purchase' THEN 'pen_ink_marks' ELSE event_type END"
_SHAPED_COLUMNS = ("event_id", f"{_CLS} AS cls", f"replace(replace(replace({_pick([t for t, _, _ in _SHAPES], 'event_id')}, '@', {_CLS}), '~', chr(10)), '^', chr(39)) AS text")
_SHAPED = f"SELECT {', '.join(_SHAPED_COLUMNS)} FROM events"
_I3 = f"SELECT event_id, cls, replace({_pick([c for _, c, _ in _SHAPES], 'event_id')}, '@', CASE WHEN cls IN {tuple(_ALLOW)!r} THEN cls ELSE 'unknown' END) AS label, {_pick([q for _, _, q in _SHAPES], 'event_id')} AS q FROM ({_SHAPED})"


@_add("i3_parse_class_response", f"SELECT event_id, label, CASE WHEN label = 'tissue' THEN q ELSE 'NA' END AS quality, CASE WHEN event_id % {len(_SHAPES)} = 11 OR event_id % {len(_SHAPES)} = 6 AND label = 'unknown' THEN 'json_without_class' END AS error FROM ({_I3})")
def _(spark, d):
    shaped = X.table(spark, d, "events").selectExpr(*_SHAPED_COLUMNS)
    return P.parse_class_response(shaped, _ALLOW).select("event_id", "label", "quality", "error")


_IDS = "SELECT o_orderkey, concat('p', o_custkey % 5) AS a, concat('p', o_custkey % 3) AS b FROM orders"


def batches(spark, d):
    o = X.derive(spark, d, _IDS, "orders")
    one = lambda c: F.concat(F.lit('{"id":"'), F.col(c), F.lit('","class":"tissue","quality":"sharp"}'))
    return o.withColumns({"expected": F.array_distinct(F.array("a", F.lit("p0"))), "text": F.concat(F.lit('{"predictions":['), one("a"), F.lit(","), one("b"), F.lit("]}"))})


@_add("i4_parse_batch_response", f"WITH o AS ({_IDS}) SELECT o_orderkey, unnest([a, b]) AS id, 'tissue' AS label, 'sharp' AS quality FROM o WHERE a <> b AND b = 'p0'")
def _(spark, d):
    return P.parse_batch_response(batches(spark, d), ["o_orderkey"], "expected")


@_add("g3_batch_id_check", f"WITH o AS ({_IDS}) SELECT o_orderkey, CAST(CASE WHEN a = 'p0' OR b = 'p0' THEN 0 ELSE 1 END AS BIGINT) AS n_missing, CAST(CASE WHEN b = 'p0' OR b = a THEN 0 ELSE 1 END AS BIGINT) AS n_extra, CAST(CASE WHEN a = b THEN 1 ELSE 0 END AS BIGINT) AS n_repeated, a <> b AND b = 'p0' AS valid FROM o")
def _(spark, d):
    b = batches(spark, d).withColumn("got", F.array("a", "b"))
    return P.batch_id_check(b, "expected", "got").select("o_orderkey", "n_missing", "n_extra", "n_repeated", "valid")


@_add("i5_parse_box_response", f"WITH b AS ({X.BOXES}) SELECT slide, idx, CASE WHEN idx % 2 = 0 THEN 'named' ELSE 'tissue_1' END AS label, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(least(1000, x2 + 200) AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM b")
def _(spark, d):
    b = X.boxes(spark, d)
    nums = F.concat_ws(",", "y1", "x1", "y2", F.col("x2") + 200)
    text = F.concat(F.lit("```json\n[{'"), F.when(F.col("idx") % 3 == 0, "bbox").otherwise("box_2d"), F.lit("':["), nums, F.lit("]"), F.when(F.col("idx") % 2 == 0, ",'label':'named'").otherwise(""), F.lit("}]\n```"))
    out = P.parse_box_response(b.select("slide", F.col("idx").alias("box"), text.alias("text")), ["slide", "box"])
    return out.select("slide", F.col("box").alias("idx"), "label", "x1", "y1", "x2", "y2")


@_add("i6_parse_point_response", f"WITH b AS ({X.BOXES}) SELECT slide, idx, 'cell' AS label, CAST(x1 AS DOUBLE) AS nx, CAST(y1 AS DOUBLE) AS ny FROM b")
def _(spark, d):
    text = F.concat(F.lit("[{'point_2d':["), F.concat_ws(",", "y1", "x1"), F.lit("],'label':' Cell '}]"))
    out = P.parse_point_response(X.boxes(spark, d).select("slide", F.col("idx").alias("p"), text.alias("text")), ["slide", "p"])
    return out.select("slide", F.col("p").alias("idx"), "label", "nx", "ny")


@_add("i7_parse_selection", "SELECT o_orderkey, 'all' AS cls, array_to_string(list_slice(list_distinct_keep, 1, 3), ',') AS ids FROM (SELECT o_orderkey, CASE WHEN o_custkey % 7 < 5 THEN list_concat([o_custkey % 7], list_filter([0, 1, 2, 3, 4], lambda x: x <> o_custkey % 7)) ELSE [0, 1, 2, 3, 4] END AS list_distinct_keep FROM orders)")
def _(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.lit(5).alias("n"), F.concat(F.lit("["), F.col("o_custkey") % 7, F.lit(","), F.col("o_custkey") % 7, F.lit("]")).alias("text"))
    return P.parse_selection(o, ["o_orderkey"], "n", 3).select("o_orderkey", "cls", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@_add("i8_parse_sections", """WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(concat('TISSUE: ', text, chr(10), 'BACKGROUND: none'), '(TISSUE:|BACKGROUND:)', chr(1) || '\\1', 'g'), chr(1))[2:]) AS p FROM conversations)
 SELECT conv_id, turn, regexp_extract(p, '^(TISSUE|BACKGROUND):', 1) AS cls, trim(regexp_replace(p, '^(TISSUE|BACKGROUND):', '')) AS body FROM s""")
def _(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("TISSUE: "), "text", F.lit("\nBACKGROUND: none")).alias("text"))
    return P.parse_sections(c, ["conv_id", "turn"], ["TISSUE", "BACKGROUND"])


@_add("i9_parse_claims", "SELECT event_id, event_type AS artifact, value > 0 AS present, 'seen' AS evidence FROM events")
def _(spark, d):
    t = F.concat(F.lit('Here: {"artifacts":{"'), "event_type", F.lit('":{"present":'), (F.col("value") > 0).cast("string"), F.lit(',"evidence":"seen"}}} done'))
    return P.parse_claims(X.table(spark, d, "events").select("event_id", t.alias("text")), ["event_id"])


_LINES = "SELECT o_custkey AS k, string_agg(concat(n, '. ', o_orderpriority), chr(10) ORDER BY n) AS e, string_agg(concat('- ', o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN concat(': at ', o_orderkey) ELSE '' END), chr(10) ORDER BY n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1"


@_add("i12_build_prompts", f"WITH x AS ({_LINES}) SELECT c_custkey, concat('Case ', c_name, ': ', '', chr(10), coalesce(c, ''), chr(10), coalesce(e, ''), '.') AS prompt FROM customer LEFT JOIN x ON k = c_custkey")
def _(spark, d):
    items = X.table(spark, d, "customer").select("c_custkey", "c_name")
    o = X.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    about = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" at "), "o_orderkey")).otherwise(" ")
    classes = o.select("c_custkey", F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("label"), about.alias("description"))
    return P.build_prompts(items, o.select("c_custkey", "o_orderkey", "o_orderpriority"), "Case {c_name}: {missing}\n{class_definitions}\n{examples}.", ["c_custkey"], "o_orderkey", "o_orderpriority", classes).select("c_custkey", "prompt")


def stub(row):
    if row["event_id"] % 6 == 4:
        raise ValueError("no reply")
    return f"Class: {row['event_type']}"


@_add("k1_score", "SELECT event_id, CASE WHEN event_id % 6 <> 4 THEN concat('Class: ', event_type) END AS reply, CASE WHEN event_id % 6 = 4 THEN 2 ELSE 1 END AS attempts, CASE WHEN event_id % 6 = 4 THEN 'ValueError: no reply' END AS score_error FROM events")
def _(spark, d):
    return P.score(X.table(spark, d, "events").select("event_id", "event_type"), stub, max_retries=1).select("event_id", "reply", "attempts", "score_error")


@_add("k2_score_batches", "SELECT event_id, concat(CASE WHEN user_id % 3 = 0 THEN 'one ' ELSE 'all ' END, event_type) AS reply, CASE WHEN user_id % 3 = 0 THEN 'single' ELSE 'batch' END AS mode FROM events")
def _(spark, d):
    def many(pdf):
        got = {i: f"all {t}" for i, t in zip(pdf["event_id"], pdf["event_type"], strict=True)}
        return {} if pdf["user_id"].iloc[0] % 3 == 0 else got

    e = X.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return P.score_batches(e, ["user_id"], "event_id", many, lambda r: f"one {r['event_type']}").select("event_id", "reply", "mode")


@_add("k4_repair", "SELECT event_id, event_type AS label, event_id % 6 IN (4, 5) AS repaired FROM events")
def _(spark, d):
    q = X.replies(spark, d)
    p = q.withColumn("label", F.when(F.col("event_id") % 6 < 4, F.col("event_type"))).select("event_id", "event_type", "text", "label")

    def parse(df):
        return df.withColumn("label", F.regexp_extract("text", "Class: (.*)", 1))

    return P.repair(p, "label", lambda r: f"Class: {r['event_type']}", parse).select("event_id", "label", "repaired")


@_add("a11_path_keys", "SELECT o_orderkey, concat('case', o_custkey) AS case_id, CASE WHEN o_orderkey % 4 > 0 THEN concat('run', o_orderkey % 9) ELSE 'unknown_run' END AS run_id, CASE WHEN o_orderkey % 4 > 0 THEN concat(o_custkey, '_2_', o_custkey + 5, '_9') END AS region, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey + 5 END AS x2 FROM orders")
def _(spark, d):
    k = F.col("o_custkey")
    full = F.concat(F.lit("/data/out/case"), k, F.lit("/run"), F.col("o_orderkey") % 9, F.lit("/bboxes/"), k, F.lit("_2_"), k + 5, F.lit("_9/stage6/patches.csv"))
    bare = F.concat(F.lit("/data/out/case"), k, F.lit("/mask.npy"))
    df = X.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, full).otherwise(bare).alias("path"))
    return S.with_path_keys(df, "path").select("o_orderkey", "case_id", "run_id", "region", "x2")
