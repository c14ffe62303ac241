"""Round trip with an external labelling service through files: requests out, responses back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.session import with_once


def requests(rows: DataFrame, system_prompt: str) -> DataFrame:
    """Request rows: the instructions and the words as JSON."""
    # to_json has no spaces after commas, the prompt format has one: join the quoted words
    quoted = F.array_join(F.transform("words", lambda w: F.substring(
        F.to_json(F.array(w)), F.lit(2), F.length(F.to_json(F.array(w))) - 2)), ", ")
    return rows.select(
        "id", "text", "words", "task_label", F.lit(system_prompt).alias("system_prompt"),
        F.concat(F.lit("Words: ["), quoted, F.lit("]")).alias("user_prompt"))


def strip_fences(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.btrim(raw, F.lit(" \n\t\r")), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def parse_response(labels: Column, raw: Column) -> Column:
    """struct<labels ARRAY<INT>, n INT, error>: labels given directly (as JSON text) or inside the reply.

    ``labels`` is null when one of them is no integer.
    """
    body = strip_fences(raw)
    is_object = F.ltrim(body).startswith("{")
    array_text = F.when(labels.isNotNull(), labels).when(is_object, F.get_json_object(body, "$.labels")).otherwise(body)
    items = F.from_json(array_text, "array<string>")
    numbers = F.from_json(array_text, "array<int>")
    error = (
        F.when(labels.isNull() & raw.isNull(), "missing labels or string response/output/content")
        .when(labels.isNull() & F.get_json_object(body, "$").isNull(), "invalid JSON")
        .when(items.isNull() | ~F.ltrim(array_text).startswith("["), "response JSON must contain a labels list"))
    whole = F.forall(items, lambda i: F.coalesce(i.rlike(r"^-?\d+$"), F.lit(False)))
    return F.struct(F.when(whole, numbers).alias("labels"), F.size(items).alias("n"), error.alias("error"))


def validate_responses(requests_: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of responses (id, line, model, labels, response, output, content).

    A response repeats only if an earlier one with its id was accepted. Ids without any
    response are rejected as missing. ``labels`` is the raw JSON text of that field.
    """
    reply = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("response", "output", "content")])
    parsed = with_once(responses, p=parse_response(F.col("labels"), reply)).select("id", "line", "model", "p")
    asked = requests_.select("id", F.size("words").alias("_n"))
    known = parsed.join(asked, "id", "left")
    fault = (
        F.when(F.col("_n").isNull(), "unknown or missing id")
        .when(F.col("p.error").isNotNull(), F.col("p.error"))
        .when(F.col("p.n") != F.col("_n"), F.concat(F.lit("expected "), F.col("_n").cast("string"), F.lit(" labels, got "), F.col("p.n").cast("string")))
        .when(F.col("p.labels").isNull() | ~F.forall("p.labels", lambda l: l.isin(0, 1)), "every label must be integer 0 or 1"))
    checked = known.withColumn("error", fault)
    # the first usable line per id; combining min, so a much repeated id stays cheap
    firsts = checked.filter("error is null").groupBy("id").agg(F.min("line").alias("_first"))
    judged = checked.join(firsts, "id", "left").withColumn("error", F.when(
        F.col("_n").isNull(), F.col("error")).when(F.col("line") > F.col("_first"), "duplicate id").otherwise(F.col("error")))
    accepted = judged.filter("error is null").select(
        "id", F.col("p.labels").alias("labels"), F.coalesce("model", F.lit("llm-teacher")).alias("source")).join(
        requests_.select("id", "text", "words", "task_label"), "id").select("id", "text", "words", "labels", "task_label", "source")
    bad = judged.filter("error is not null").select("id", F.col("line").cast("bigint").alias("line"), "error")
    unanswered = requests_.select("id").join(responses.select("id").distinct(), "id", "left_anti").select(
        "id", F.lit(None).cast("bigint").alias("line"), F.lit("missing response").alias("error"))
    return accepted, bad.unionByName(unanswered)
