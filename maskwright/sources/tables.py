"""Parquet tables and the text tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task of text work.
PART_ROWS = 100_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows to tasks by key before text work.

    A file with one row group is one task's however large, and rules cost far more than
    moving the rows once. There are spark.sql.shuffle.partitions parts and more for large
    tables, so that a part's rows and a task's time have a bound; they are not merged
    by size: a few bytes of an order stand for much work. The count reads the files' footers.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents as (id, text, lang, source)."""
    return spread(table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", "source"), "id")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a quality label, as task_label."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("task_label"), "toxic")
    return documents(spark, folder).join(labels, "id")


# A short delivery note per order: names, possessives, dosages, identifiers, dates, mail
# addresses, handles, links and ZIP codes, all taken from the order's own columns. The
# expressions are plain SQL so that another engine can derive the same texts.
PERSON = "case o_custkey % 5 when 0 then 'Andrew' when 1 then 'Bianca' when 2 then 'Miriam' when 3 then 'Thomas' else 'Yolanda' end"
GOODS = "case o_custkey % 4 when 0 then 'Velvet Copper' when 1 then 'Silver Walnut' when 2 then 'crimson basil' else 'Amber Resin' end"
DAY = ("cast(extract(day from o_orderdate) as varchar(2)) || '/' || cast(extract(month from o_orderdate) as varchar(2)) "
       "|| '/' || cast(extract(year from o_orderdate) as varchar(4))")
NOTE = f"""
    ({PERSON}) || case o_orderstatus when 'F' then chr(39) || 's' when 'O' then '’s' else '' end
    || ' parcel ' || cast(4000000 + o_orderkey as varchar(20)) || ' left on ' || ({DAY}) || ': '
    || cast(o_orderkey % 90 + 5 as varchar(3))
    || case o_orderkey % 4 when 0 then ' mg' when 1 then 'mg' when 2 then ' kg' else ' units' end
    || ' of ' || ({GOODS})
    || case when o_orderkey % 5 = 0 then '. Mail ' || lower({PERSON}) || '.' || cast(o_custkey as varchar(20)) || '@example.com' else '' end
    || case when o_orderkey % 7 = 0 then ' or @' || lower({PERSON}) || '_' || cast(o_custkey as varchar(20)) else '' end
    || case when o_orderkey % 6 = 0 then ', see www.example.com/o/' || cast(o_orderkey as varchar(20)) else '' end
    || case when o_orderkey % 8 = 0 then ', zip ' || cast(10000 + o_custkey % 80000 as varchar(5)) || '-' || cast(1000 + o_orderkey % 9000 as varchar(4)) else '' end
    || case o_orderkey % 3 when 0 then '. It was a very good trip.' when 1 then '. Not bad, really.' else '. The driver hated it!' end
"""
NOTE_COLUMNS = (
    "cast(o_orderkey as varchar(20)) as id", f"{NOTE} as text", "o_orderpriority as dataset_name",
    "o_orderstatus as task_label", "o_orderkey as source_index",
)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders dealt by the id of their note, so that notes and what belongs to them lie together: joins and groups by id move nothing."""
    columns = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return spread(table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("id"), *columns), "id")


def order_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, dataset_name, task_label, source_index) per order."""
    return _orders(spark, folder).selectExpr("id", *NOTE_COLUMNS[1:]).withColumn("text", F.col("text").cast("string"))


# Entity spans of a note, as an external recogniser would report them.
ENTITIES = (
    ("0", PERSON, "'PERSON'"),
    ("1", GOODS, "case o_custkey % 4 when 0 then 'ORG' when 1 then 'GPE' when 2 then 'PRODUCT' else 'NORP' end"),
    ("2", DAY, "'DATE'"),
    ("3", f"({DAY}) || ': ' || cast(o_orderkey % 90 + 5 as varchar(3))", "'MONEY'"),
)


def note_entities(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, end, type, span_order, surface) for every note."""
    spans = ", ".join(
        f"named_struct('span_order', {order}, 'surface', cast(({surface}) as string), 'type', {kind})"
        for order, surface, kind in ENTITIES)
    rows = _orders(spark, folder).selectExpr("id", f"cast(({NOTE}) as string) as text", f"inline(array({spans}))")
    start = F.expr("instr(text, surface) - 1")
    return rows.select("id", start.alias("start"), (start + F.length("surface")).alias("end"), "type", "span_order", "surface")


SCORE_COLUMNS = (
    "event_type as model", "concat('d', cast(user_id % 10 as varchar(3))) as dataset",
    "42 + cast(event_id % 3 as int) as seed",
    "case when event_id % 4 = 0 then 'validation' else 'test' end as split",
    "case when value + 0.6 * (user_id % 7) > 40 then 1 else 0 end as gold",
    "least(value / 90.0, 1.0) as score", "event_id",
)


def scored_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """events read as scored tokens: model, dataset, seed, split, gold, score."""
    return table(spark, folder, "events").selectExpr(*SCORE_COLUMNS)
