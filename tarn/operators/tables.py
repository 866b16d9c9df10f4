"""Table entities: SQL, profiles, previews, and routing of questions."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_READ_ONLY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


def query_table(df: DataFrame, sql: str) -> DataFrame:
    """Read-only SQL over one table entity, named ``t``."""
    return query_tables({"t": df}, sql, with_entity=False)


def query_tables(tables: dict[str, DataFrame], sql: str, with_entity: bool = True) -> DataFrame:
    """Read-only SQL over several table entities, each a view with its ``_entity_id``."""
    if not _READ_ONLY.match(sql):
        raise ValueError("only SELECT and WITH statements are allowed")
    spark = next(iter(tables.values())).sparkSession
    # The names are known to this statement alone: the session keeps none of them, so two
    # callers with tables of the same name do not meet.
    views = {name: f"query_{uuid.uuid4().hex}" for name in tables}
    named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    for name, df in tables.items():
        shown = df.withColumn("_entity_id", F.lit(name)) if with_entity else df
        shown.createOrReplaceTempView(views[name])
    try:
        # What writes, such as WITH ... INSERT, is no subquery. Nothing runs here.
        return spark.sql(f"WITH {named} SELECT * FROM (\n{sql.rstrip().rstrip(';')}\n)")
    except ParseException as error:
        raise ValueError(f"not a query that only reads: {error}") from error
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


# --- profile ---------------------------------------------------------------------------


NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """One row per column: counts, null share, min/max/mean/std of numbers, distinct
    values and the most frequent ones.

    Moments of all columns come from one aggregate. For distinct values and top
    lists the values are turned to (column, value) rows and counted once, with
    partial counts before the shuffle.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC}
    none = F.lit(None).cast("double")

    def moments(c: str) -> Column:
        number = F.col(c).cast("double")
        parts = {"min": F.min(number), "max": F.max(number), "mean": F.avg(number), "std": F.stddev(number)}
        return F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            *[(e if c in numeric else none).alias(n) for n, e in parts.items()],
        )

    sums = df.agg(F.array(*[moments(c) for c in df.columns]).alias("_m")).select(F.inline("_m"))
    cells = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]
            )
        )
    )
    counted = cells.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    best = (
        counted.withColumn("_r", F.row_number().over(by_count)).filter(F.col("_r") <= top)
        .groupBy("column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("top_values"))
    )
    distinct = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return sums.join(distinct, "column_name", "left").join(best, "column_name", "left").select(
        "column_name", "row_count", "null_count",
        (F.col("null_count") / F.col("row_count")).alias("null_share"),
        F.coalesce("distinct_count", F.lit(0).cast("long")).alias("distinct_count"),
        "min", "max", "mean", "std", "top_values",
    )


def preview(df: DataFrame, key: str, seed: int = 0, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows to show of a table: all below 1,000; head 50 and tail 50 up to 100,000;
    above that head 30 and 70 in the order of SHA-256 of the seed and key. An offset and limit
    override this."""
    if limit is not None:
        return df.orderBy(key).offset(offset or 0).limit(limit)
    rows = df.limit(100_001).count()
    if rows < 1_000:
        return df.orderBy(key)
    if rows <= 100_000:
        return df.orderBy(key).limit(50).unionByName(df.orderBy(F.desc(key)).limit(50))
    head = df.orderBy(key).limit(30)
    rest = df.join(F.broadcast(head.select(key)), key, "left_anti")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return head.unionByName(rest.orderBy(drawn, key).limit(70))


# --- routing of questions -----------------------------------------------------------------

# --- fixed values: words that decide a route, in order of precedence ----------------------
ROUTES = [
    ("mixed", r"(?i)(>|<|between).*(提到|mention)"),
    ("structural", r"(?i)(>|<)\s*\d|between .+ and |总数|平均|top \d+|group by|count of|average|join|单元格"),
    ("graph", r"(?i)关系|引用|提及|relation|reference|mention"),
    ("visual", r"(?i)截图|海报|screenshot|poster|image"),
    ("audio", r"(?i)录音|音频|recording|audio"),
    ("lexical", r"(?i)编号|邮箱|电话|\bid\b|e-?mail|phone|number"),
]


def route_queries(df: DataFrame, text: str = "text") -> DataFrame:
    """``route`` per question; hybrid search if no rule applies."""
    chain = reduce(
        lambda c, r: c.when(F.regexp_like(text, F.lit(r[1])), F.lit(r[0])),
        ROUTES[1:],
        F.when(F.regexp_like(text, F.lit(ROUTES[0][1])), F.lit(ROUTES[0][0])),
    )
    return df.withColumn("route", chain.otherwise(F.lit("hybrid")))
