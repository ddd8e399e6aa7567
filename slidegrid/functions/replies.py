"""Model replies: fences, JSON in several shapes, sections, selections."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import CLASS_ALIASES, canonical_label, canonical_quality

_FENCE = r"(?s)(?:\A|\n)```[^\n]*\n(.*?)(?:\n?```|\z)"


def strip_fence(c: Column) -> Column:
    """The inside of the first fenced block, else the trimmed text."""
    return F.when(c.rlike(r"(?s)(?:\A|\n)```[^\n]*\n"), F.trim(F.regexp_extract(c, _FENCE, 1))).otherwise(F.trim(c))


def whole_object(c: Column) -> Column:
    """The variant of a text that is one JSON object and nothing else, else null.

    A parser stops after the first value. The text is therefore read as a
    member of a larger object, followed by a key that only its own hash can
    name: it is whole only if that key comes right after it.
    """
    key = F.md5(c)
    members = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"x":'), c, F.lit(',"'), key, F.lit('":0}'))), "$", "map<string,variant>")
    return F.when(c.startswith("{") & (F.size(members) == 2) & F.try_element_at(members, key).isNotNull(), F.try_element_at(members, F.lit("x")))


def relaxed_object(text: str | None) -> str | None:
    """The first JSON object that parses, from the whole text or any opening brace; numbers that JSON lacks are null."""
    if not text:
        return None
    decoder = json.JSONDecoder(parse_constant=lambda _: None)
    at = text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
        except RecursionError:
            return None
    return None


def parse_relaxed_json(df: DataFrame, col: str = "text", out: str = "parsed") -> DataFrame:
    """``out`` holds a JSON object or null, with sorted keys and no spaces; only rows that are not one object as they stand go to Python."""
    made = df.withColumn(out, F.to_json(whole_object(strip_fence(F.col(col)))))
    open_ = F.col(out).isNull() & F.coalesce(F.col(col).contains("{"), F.lit(False))
    rest = made.filter(open_)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: b[col].map(relaxed_object)})

    found = rest.mapInPandas(scan, made.schema).withColumn(out, F.to_json(F.try_parse_json(out)))
    return made.filter(~open_).unionByName(found)


_SPACE = " \t\n\r\f\x0b"


def _said(text: Column, name: str) -> Column:
    """What follows ``name:`` on its line, up to a comma, bar or semicolon."""
    return F.regexp_extract(text, rf"(?i){name}\s*:\s*([^\n\r|,;]*)", 1)


def _first(values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def parse_class_response(df: DataFrame, allowed: list[str], col: str = "text") -> DataFrame:
    """label, quality and error of a reply.

    Of a JSON object, the first key that names a class or a quality counts,
    then the first value that is one; an object without a class gives the
    error ``json_without_class``. Of other text, ``class: ...`` counts, then
    the longest allowed name in it, then "true" for tissue and "false" for
    background. Labels that are not allowed are ``unknown``; the quality of
    anything but tissue is ``NA``. Null and empty replies are unknown.
    """
    names = sorted(allowed, key=len, reverse=True)
    known = F.array(*[canonical_label(F.lit(a)) for a in allowed]) if allowed else F.array(*map(F.lit, sorted(set(CLASS_ALIASES.values()))))
    body = F.btrim(F.replace(F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), F.lit(_SPACE))
    out = df.withColumn("_body", body).withColumn("_low", F.lower("_body"))
    # one parse: an object is whole if the key that is put in before its last brace comes last
    mark = F.md5("_body")
    out = out.withColumn("_m", F.when(F.col("_body").startswith("{") & F.col("_body").endswith("}"), F.from_json(F.concat(F.expr("left(_body, length(_body) - 1)"), F.lit(',"'), mark, F.lit('":""}')), "map<string,string>", {"allowSingleQuotes": "false"})))
    out = out.withColumn("_all", F.map_entries("_m"))
    whole = F.get("_all", F.size("_all") - 1)["key"] == mark
    is_json = F.coalesce(whole, F.lit(False)) | F.rlike("_body", F.lit(r"\A\{\s*\}\z"))
    entries = F.when(F.coalesce(whole, F.lit(False)), F.slice("_all", F.lit(1), F.greatest(F.size("_all") - 1, F.lit(0))))
    value = lambda e: F.coalesce(e.value, F.lit("None"))
    read = F.transform(entries, lambda e, i: F.struct(i.alias("i"), F.lower(e.key).alias("key"), canonical_label(value(e)).alias("cls"), canonical_quality(value(e)).alias("quality")))
    out = out.withColumns({"_json": is_json, "_e": read})
    of_class = F.filter("_e", lambda e: e.key.contains("class") & (e.cls != ""))
    out = out.withColumn("_at", F.get(of_class, F.lit(0)))
    names_quality = lambda e: e.key.contains("quality") & (~e.key.contains("class") | F.coalesce(e.i > F.col("_at.i"), F.lit(False)))
    by_key = F.col("_at.cls")
    by_value = _first(F.transform("_e", lambda e: F.when(F.array_contains(known, e.cls), e.cls)))
    in_json = F.coalesce(by_key, by_value)
    quality = F.coalesce(_first(F.transform(F.filter("_e", names_quality), lambda e: e.quality)), _first(F.transform("_e", lambda e: e.quality)))
    out = out.withColumns({"_cls": in_json, "_quality": quality})
    spaced = F.replace(F.col("_low"), F.lit("_"), F.lit(" "))
    by_name = [F.when(F.col("_low").contains(a.lower()) | spaced.contains(a.lower().replace("_", " ")), canonical_label(F.lit(a))) for a in names]
    by_word = [F.when(F.col("_low").contains(w), F.lit(c)) for w, c in (("true", "tissue"), ("false", "background")) if c in allowed]
    blank = F.lit("")
    in_text = F.coalesce(F.nullif(canonical_label(_said(F.col("_body"), "class")), blank), *by_name, *by_word, F.lit("unknown"))
    label = F.when(F.col("_json"), F.coalesce("_cls", F.lit("unknown"))).otherwise(F.when(F.col("_body") == "", F.lit("unknown")).otherwise(in_text))
    if allowed:
        label = F.when(F.array_contains(known, label), label).otherwise("unknown")
    quality = F.coalesce("_quality", F.nullif(canonical_quality(_said(F.col("_body"), "quality")), blank), F.nullif(canonical_quality(F.col("_low")), blank), F.lit("NA"))
    out = out.withColumns({"label": label, "error": F.when(F.col("_json") & F.col("_cls").isNull(), "json_without_class")})
    out = out.withColumn("quality", F.when(F.col("label") == "tissue", quality).otherwise("NA"))
    return out.drop("_body", "_low", "_json", "_e", "_at", "_cls", "_quality", "_m", "_all")


_PREDICTIONS = "struct<predictions:array<struct<id:string,class:string,quality:string>>>"


def parse_batch_response(df: DataFrame, keys: list[str], expected: str, col: str = "text") -> DataFrame:
    """Rows (keys, id, class, quality) of batches whose ids are exactly the expected ones."""
    p = F.from_json(strip_fence(F.col(col)), _PREDICTIONS).predictions
    out = df.withColumn("_p", p).withColumn("_ids", F.transform("_p", lambda x: x.id))
    return out.filter(batch_valid(expected, "_ids")).select(*keys, F.explode("_p").alias("_x")).select(*keys, "_x.id", F.col("_x.class").alias("label"), "_x.quality")


def batch_valid(expected: str, got: str) -> Column:
    same = (F.size(F.array_except(expected, got)) == 0) & (F.size(F.array_except(got, expected)) == 0)
    return F.coalesce(same & (F.size(got) == F.size(F.array_distinct(got))), F.lit(False))


def batch_id_check(df: DataFrame, expected: str, got: str) -> DataFrame:
    """Missing, extra and repeated ids of a batch, and whether it is valid."""
    none = F.coalesce(F.col(got), F.array().cast("array<string>"))
    out = df.withColumn("_g", none)
    return out.withColumns({"n_missing": F.size(F.array_except(expected, "_g")).cast("long"), "n_extra": F.size(F.array_except("_g", expected)).cast("long"), "n_repeated": (F.size("_g") - F.size(F.array_distinct("_g"))).cast("long"), "valid": batch_valid(expected, "_g")}).drop("_g")


_BOXES = "array<struct<bbox_2d:array<double>,box_2d:array<double>,bbox:array<double>,label:string>>"


def parse_box_response(df: DataFrame, keys: list[str], order: str = "yxxy", col: str = "text") -> DataFrame:
    """(keys, idx, label, x1..y2): boxes of four numbers, x first, clamped to 0-1000."""
    rows = df.select(*keys, F.posexplode(F.from_json(strip_fence(F.col(col)), _BOXES)).alias("idx", "_b"))
    v = F.coalesce("_b.bbox_2d", "_b.box_2d", "_b.bbox")
    rows = rows.withColumn("v", v).filter(F.size("v") == 4).filter("NOT array_contains(transform(v, x -> x IS NULL), true)")
    at = [1, 0, 3, 2] if order.startswith("y") else [0, 1, 2, 3]
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c))
    return rows.select(*keys, "idx", F.coalesce("_b.label", F.concat(F.lit("tissue_"), F.col("idx") + 1)).alias("label"), *[clamp(F.col("v")[i]).alias(n) for i, n in zip(at, ("x1", "y1", "x2", "y2"), strict=True)])


_POINTS = "array<struct<point_2d:array<double>,point:array<double>,label:string>>"


def parse_point_response(df: DataFrame, keys: list[str], order: str = "yx", col: str = "text") -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.from_json(strip_fence(F.col(col)), _POINTS)).alias("idx", "_p"))
    rows = rows.withColumn("v", F.coalesce("_p.point_2d", "_p.point")).filter(F.size("v") == 2)
    at = [1, 0] if order == "yx" else [0, 1]
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c))
    return rows.select(*keys, "idx", F.lower(F.trim("_p.label")).alias("label"), *[clamp(F.col("v")[i]).alias(n) for i, n in zip(at, ("nx", "ny"), strict=True)])


def parse_selection(df: DataFrame, keys: list[str], n: str, k: int, col: str = "text") -> DataFrame:
    """(keys, class, ids): picks in range by class, cut to k; a single list is padded with unused ids."""
    js = strip_fence(F.col(col))
    multi = F.from_json(js, T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    fit = lambda a: F.filter(a, lambda x: x.isNotNull() & (x >= 0) & (x < F.col(n)))
    many = df.filter(js.startswith("{")).select(*keys, n, F.explode(multi).alias("cls", "a"))
    many = many.select(*keys, "cls", F.slice(F.array_distinct(fit("a")), 1, k).alias("ids"))
    one = df.filter(js.startswith("[")).withColumn("a", F.array_distinct(fit(F.from_json(js, "array<int>"))))
    rest = F.array_except(F.sequence(F.lit(0), F.col(n) - 1), "a")
    one = one.select(*keys, F.lit("all").alias("cls"), F.slice(F.concat("a", rest), 1, k).alias("ids"))
    return many.unionByName(one)


def parse_sections(df: DataFrame, keys: list[str], classes: list[str], col: str = "text") -> DataFrame:
    """(keys, cls, body): ``CLASS: text`` up to the next class name."""
    names = "|".join(classes)
    found = F.regexp_extract_all(F.col(col), F.lit(rf"(?s)(?:{names}):.*?(?=(?:{names}):|\z)"), F.lit(0))
    out = df.select(*keys, F.explode(found).alias("s"))
    return out.select(*keys, F.regexp_extract("s", rf"(?s)\A({names}):", 1).alias("cls"), F.trim(F.regexp_replace("s", rf"(?s)\A(?:{names}):", "")).alias("body"))


def parse_claims(df: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """(keys, artifact, present, evidence) from a fenced or bare artifacts map."""
    body = F.regexp_extract(strip_fence(F.col(col)), r"(?s)(\{.*\})", 1)
    kind = "struct<artifacts:map<string,struct<present:boolean,evidence:string>>>"
    return df.select(*keys, F.explode(F.from_json(body, kind).artifacts).alias("artifact", "_c")).select(*keys, "artifact", F.col("_c.present").alias("present"), F.col("_c.evidence").alias("evidence"))


def _numbered(rows: DataFrame, keys: list[str], order: str, line: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """One text a group: its rows in order, each as a line."""
    kept = F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(kept, line), "\n").alias(out))


def class_definitions(classes: DataFrame, keys: list[str], order: str = "ordinal", label: str = "label", about: str = "description") -> DataFrame:
    """(keys, class_definitions): classes in order, one a line, with what is said about them where there is something."""
    said = F.nullif(F.trim(about), F.lit(""))
    rows = classes.select(*keys, order, F.concat(F.lit("- "), label, F.coalesce(F.concat(F.lit(": "), said), F.lit(""))).alias("_line"))
    return _numbered(rows, keys, order, lambda r, i: r["_line"], "class_definitions")


def build_prompts(items: DataFrame, examples: DataFrame, template: str, keys: list[str], order: str, text: str, classes: DataFrame | None = None) -> DataFrame:
    """Each group's examples as numbered lines and its class definitions in a template; ``{name}`` of a missing column is blank."""
    block = _numbered(examples.select(*keys, order, text), keys, order, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r[text]), "examples")
    out = items.join(block, keys, "left").fillna("", ["examples"])
    if classes is not None:
        out = out.join(class_definitions(classes, keys), keys, "left")
    parts, at = [], 0
    while (a := template.find("{", at)) >= 0 and (z := template.find("}", a)) >= 0:
        name = template[a + 1 : z]
        parts += [F.lit(template[at:a]), F.coalesce(F.col(name).cast("string"), F.lit("")) if name in out.columns else F.lit("")]
        at = z + 1
    return out.withColumn("prompt", F.concat(*parts, F.lit(template[at:])))


def score(df: DataFrame, scorer: Callable[[dict], str], out_type: str = "string", max_retries: int = 2) -> DataFrame:
    """A Python scorer on every row: reply, attempts, error and seconds over all attempts; a failure never ends the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, attempts, errors, seconds = [], [], [], []
            for row in b.to_dict("records"):
                reply = error = None
                began = time.monotonic()
                for n in range(1, max_retries + 2):
                    try:
                        reply, error = scorer(row), None
                        break
                    except Exception as e:  # a row that fails is a result
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                attempts.append(n)
                errors.append(error)
                seconds.append(time.monotonic() - began)
            yield b.assign(reply=replies, attempts=attempts, score_error=errors, score_seconds=seconds)

    schema = T.StructType([*df.schema.fields, T.StructField("reply", T._parse_datatype_string(out_type)), T.StructField("attempts", T.IntegerType()), T.StructField("score_error", T.StringType()), T.StructField("score_seconds", T.DoubleType())])
    return df.mapInPandas(run, schema)


def repair(df: DataFrame, parsed: str, scorer: Callable[[dict], str], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose parse failed are scored and parsed again; the rest stays."""
    good, bad = df.filter(F.col(parsed).isNotNull()), df.filter(F.col(parsed).isNull())
    again = score(bad.drop(parsed), scorer)
    again = parse(again.withColumn("text", F.col("reply")).drop("reply", "attempts", "score_error", "score_seconds"))
    return good.withColumn("repaired", F.lit(False)).unionByName(again.select(*df.columns).withColumn("repaired", F.lit(True)))


def score_batches(df: DataFrame, keys: list[str], ident: str, batch_scorer: Callable[[pd.DataFrame], dict], scorer: Callable[[dict], str]) -> DataFrame:
    """One call for each batch; rows of a batch whose reply does not fit its ids are scored one by one.

    A row whose own call fails has no reply; a failure never ends the job.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("mode", T.StringType())])

    def alone(row: dict) -> str | None:
        try:
            return scorer(row)
        except Exception:  # a row that fails is a result
            return None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            got = batch_scorer(pdf)
        except Exception:  # a failed call is an invalid reply
            got = {}
        ids = pdf[ident].tolist()
        if set(got) == set(ids) and len(got) == len(ids):
            return pdf.assign(reply=[got[i] for i in ids], mode="batch")
        return pdf.assign(reply=[alone(r) for r in pdf.to_dict("records")], mode="single")

    return df.groupBy(*keys).applyInPandas(run, schema)
