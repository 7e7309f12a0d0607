"""Structured documents and exports: JSON, XML, feeds, site maps, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_path(text: Column, path: str) -> Column:
    """The value at a JSON path as text; null for what isn't JSON."""
    return F.get_json_object(text, path)


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def xml_texts(text: Column, path: str) -> Column:
    """All texts at an XPath."""
    return F.xpath(text, F.lit(path + "/text()"))


def feed_items(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, title, link) of RSS items and Atom entries."""
    t = F.col(text)
    rss = F.arrays_zip(F.xpath(t, F.lit("//item/title/text()")).alias("title"), F.xpath(t, F.lit("//item/link/text()")).alias("link"))
    atom = F.arrays_zip(F.xpath(t, F.lit("//entry/title/text()")).alias("title"), F.xpath(t, F.lit("//entry/link/@href")).alias("link"))
    return docs.select("doc_id", F.posexplode(F.when(F.size(rss) > 0, rss).otherwise(atom)).alias("pos", "i")).select("doc_id", "pos", "i.title", "i.link")


def site_urls(text: Column) -> Column:
    return F.xpath(text, F.lit("//url/loc/text()"))


def flat_text(text: Column) -> Column:
    """All text of an XML or JSON document, in order, single blanks."""
    xml = F.regexp_replace(text, r"<[^>]*>", " ")
    js = F.array_join(F.regexp_extract_all(text, F.lit(r'(?::|\[|,)\s*"((?:[^"\\]|\\.)*)"(?!\s*:)'), 1), " ")
    return F.trim(F.regexp_replace(F.when(F.ltrim(text).startswith("<"), xml).otherwise(js), r"\s+", " "))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def as_xml(df: DataFrame) -> DataFrame:
    return df.select(F.to_xml(F.struct("*")).alias("xml"))


def export(df: DataFrame, path: str, format: str = "parquet", codec: str | None = None, by: list[str] = ()) -> None:
    """Write parquet, orc, json or csv (with a header), with a codec and by partitions."""
    w = df.write.mode("overwrite")
    if codec:
        w = w.option("compression", codec)
    if by:
        w = w.partitionBy(*by)
    (w.option("header", True) if format == "csv" else w).format(format).save(path)


def imported(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    r = spark.read.schema(schema)
    return (r.option("header", True) if format == "csv" else r).format(format).load(path)


def archive(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write ``df`` cold (zstd) beside a manifest of checksums; returns the manifest."""
    export(df, f"{path}/data", codec="zstd")
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    df.select(F.col(key).alias("key"), F.sha2(F.concat_ws("\x1f", *cols), 256).alias("checksum")).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def retrieved(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What was archived with intact (whether its checksum still holds)."""
    df = spark.read.parquet(f"{path}/data")
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    m = spark.read.parquet(f"{path}/manifest").withColumnRenamed("key", key)
    return df.withColumn("_c", F.sha2(F.concat_ws("\x1f", *cols), 256)).join(m, key, "left").withColumn("intact", F.col("_c").eqNullSafe(F.col("checksum"))).drop("_c", "checksum")
