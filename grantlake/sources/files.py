"""Reading and writing catalogues through Spark: JSON pages, snapshots, rows of the persisted table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "id", "title", "summary", "ageText", "incomeText", "regionText", "recruitStartText", "recruitEndText", "recruitText",
        "category", "sourceUrl", "orgName", "lastModified", "source", "documentsText", "programKey",
    )],
    T.StructField("ageMin", T.DoubleType()), T.StructField("ageMax", T.DoubleType()),
])


def raw_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw records of JSON-array pages with ``ordinal``, their place in page order. Broken records are null rows and dropped."""
    pages = None
    for number, path in enumerate(paths):
        page = spark.read.schema(RAW).json(path, multiLine=True).withColumn("ordinal", F.lit(number << 40) + F.monotonically_increasing_id())
        pages = page if pages is None else pages.unionByName(page)
    return pages


def service_pages(bodies: DataFrame, item: str) -> DataFrame:
    """Items of response bodies (page, body): result.youthPolicyList, or a bare list, or items or data. ``item`` is a DDL struct."""
    body = F.col("body")
    wrapped = F.from_json(body, f"result struct<youthPolicyList: array<{item}>>, youthPolicyList array<{item}>, items array<{item}>, data array<{item}>")
    listed = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item}>"))
    items = F.coalesce(wrapped["result"]["youthPolicyList"], wrapped["youthPolicyList"], wrapped["items"], wrapped["data"], listed)
    found = bodies.select("page", F.posexplode(items).alias("pos", "item"))
    return found.select((F.shiftleft(F.col("page").cast("long"), 20) + F.col("pos")).alias("ordinal"), "item.*")


def total_count(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.result.pagging.totCount").try_cast("int"), F.lit(0))


def snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored catalogue; an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def point_lookup(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.filter(F.col(column) == value).limit(1)


def union_isolated(primary: DataFrame, secondary) -> tuple[DataFrame, str | None]:
    """The primary source and, if all of it can be read, the secondary one; else a warning. ``secondary`` is a function.

    The secondary source is read once, into storage that keeps what doesn't fit in memory on disk: a page
    that fails late fails here.
    """
    try:
        other = secondary().persist(StorageLevel.MEMORY_AND_DISK)
        other.count()
    except Exception as failed:  # a source that is down must not stop the others
        return primary, str(failed)
    return primary.unionByName(other, allowMissingColumns=True), None


def overwrite_snapshot(rows: DataFrame, path: str) -> None:
    """The stored catalogue replaced as a whole; a reader sees the old one or the new one once Spark's commit is done."""
    rows.write.mode("overwrite").parquet(path)


def json_report(rows: DataFrame, most: int = 3) -> list[str]:
    """The first rows as JSON, for a report: at most ``most`` of them reach the driver."""
    return [r["value"] for r in rows.limit(most).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).collect()]


def vector_literal(v: Column) -> Column:
    """[a,b,...]; non-finite numbers as 0, an empty vector as null."""
    finite = F.transform(v.cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return F.when(F.size(v) > 0, F.concat(F.lit("["), F.array_join(finite.cast("array<string>"), ","), F.lit("]")))


def parse_vector(text: Column) -> Column:
    return F.nullif(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


STORED = {
    "ageMin": "age_min", "ageMax": "age_max", "regionCodes": "region_codes", "regionText": "region_text", "isNationwide": "is_nationwide",
    "documentsText": "documents_text", "sourceUrl": "source_url", "fetchedAt": "fetched_at", "updatedAt": "updated_at", "contentHash": "content_hash",
}


def to_stored(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed(STORED)


def from_stored(rows: DataFrame) -> DataFrame:
    """Names of the engine; empty texts are null, arrays never are, the source has a default."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ("id", "title", "source")]
    out = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    arrays = [f.name for f in rows.schema.fields if f.dataType == T.ArrayType(T.StringType())]
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays})
    if "source" in rows.columns:
        out = out.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("ontong")))
    if "is_nationwide" in rows.columns:
        out = out.withColumn("is_nationwide", F.coalesce("is_nationwide", F.lit(False)))
    return out.withColumnsRenamed({v: k for k, v in STORED.items()})
