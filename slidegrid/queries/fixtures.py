"""Inputs that Spark derives from the given tables; each uses all rows and grows with them.

The same text runs in DuckDB, where the tables are views of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Boxes, normalised 0-1000; about 30 to a slide. Rows that share order and line are numbered, so that idx is a key.
BOXES = """
SELECT slide, rot, idx, x1, y1, x1 + 10 + (q * 7) % 50 AS x2, y1 + 10 + q AS y2
FROM (SELECT CAST(floor(l_orderkey / 32.0) AS BIGINT) AS slide, 90 * (l_linenumber % 4) AS rot,
        CAST((l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS BIGINT) AS idx,
        (l_partkey * 37 + l_orderkey * 11) % 900 AS y1, (l_partkey * 53 + l_orderkey * 7) % 900 AS x1,
        CAST(l_quantity AS BIGINT) AS q FROM lineitem) t
"""

#: Cells of a 24 x 24 grid; 1 tissue, 0 background, 2 artifact; about 45 of 576 to a slide and class mix.
CELLS = """
SELECT slide, r, c, CASE WHEN m < 5 THEN 1 WHEN m < 9 THEN 0 ELSE 2 END AS class_id
FROM (SELECT CAST(floor(l_orderkey / 400.0) AS BIGINT) AS slide, l_partkey % 24 AS r,
        (l_orderkey + l_linenumber) % 24 AS c, CAST(sum(l_quantity) AS BIGINT) % 10 AS m
      FROM lineitem GROUP BY 1, 2, 3) t
"""

#: Ensemble votes of patches.
VOTES = """
SELECT user_id % 10 AS slide, user_id AS patch, event_id AS run, event_type AS label,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS quality_id
FROM events
"""

#: Model replies.
REPLIES = """
SELECT event_id, event_type, CASE event_id % 6
  WHEN 0 THEN concat('{"class":"', event_type, '","quality":"Sharp"}')
  WHEN 1 THEN concat('```json', chr(10), '{"label_class":"', upper(event_type), '"}', chr(10), '```')
  WHEN 2 THEN concat('Class: ', event_type, ' | Quality: Out of focus')
  WHEN 3 THEN concat('I think this is ', event_type)
  WHEN 4 THEN '' ELSE '{"predictions": [' END AS text
FROM events
"""

#: Review results.
REVIEWS = """
SELECT conv_id AS case_id, turn AS item, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS text,
       CAST(length(text) AS BIGINT) AS prompt_tokens, CAST(length(text) % 97 AS BIGINT) AS output_tokens,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(length(text) % 31 AS BIGINT) END AS thoughts_tokens,
       CAST(length(text) AS DOUBLE) / 100.0 AS elapsed_s,
       CASE WHEN turn % 5 = 4 THEN 'HTTP 429 Too Many Requests' END AS error,
       CASE conv_id % 3 WHEN 0 THEN 'vendor/m-large' WHEN 1 THEN 'm-small' ELSE 'other' END AS model
FROM conversations
"""

#: Features in long form, and pixels of 8 x 8 images; array positions differ by engine.
FEATURES = "SELECT vec_id, label AS grp, pos AS dim, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, e) FROM embeddings)"
FEATURES_DUCK = "SELECT vec_id, label AS grp, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
_PIXEL = "vec_id AS img, CAST(floor(dim / 8.0) AS INT) AS y, CAST(dim % 8 AS INT) AS x, (v + 1) / 2 AS gray, CAST(floor(abs(v) * 2550) AS BIGINT) % 256 AS r, CAST(floor(abs(v) * 1130) AS BIGINT) % 256 AS g, CAST(floor(abs(v) * 790) AS BIGINT) % 256 AS b"
PIXELS = f"SELECT {_PIXEL} FROM ({FEATURES})"
PIXELS_DUCK = f"SELECT {_PIXEL} FROM ({FEATURES_DUCK})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A fixture's SQL over the named tables, without registering views."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql.replace("{\"", "{{\"").replace("\"}", "\"}}"), **{n: table(spark, sf_dir, n) for n in names}) if "{\"" in sql else spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, BOXES, "lineitem")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, CELLS, "lineitem")


def votes(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, VOTES, "events")


def replies(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, REPLIES, "events")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, REVIEWS, "conversations")


def features(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, FEATURES, "embeddings")


def images(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, PIXELS, "embeddings")
