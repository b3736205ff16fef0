"""Pictures as pixel rows: (image_id, x, y, r, g, b, a), made from tables or explicit byte arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _level(v: Column) -> Column:
    """-1 to 1 as 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int")


def rgba_of_vectors(vectors: DataFrame, width: int = 4, id_column: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Every four values of a vector are a pixel, in rows of ``width``. The explode stays within its input partition."""
    pixel = F.explode(F.sequence(F.lit(0), F.floor(F.size(values) / 4).cast("int") - 1)).alias("p")
    rows = vectors.select(F.col(id_column).alias("image_id"), F.col(values).alias("v"), pixel)
    channel = [_level(F.get("v", F.col("p") * 4 + k)).alias(c) for k, c in enumerate("rgba")]
    return rows.select("image_id", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), *channel)


def gray_of_vectors(vectors: DataFrame, width: int = 8, id_column: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Every value is a grey pixel: (image_id, x, y, v)."""
    rows = vectors.select(F.col(id_column).alias("image_id"), F.posexplode(values).alias("p", "e"))
    return rows.select("image_id", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), _level(F.col("e")).alias("v"))


def canvas(sizes: DataFrame, id_column: str, width: Column, height: Column) -> DataFrame:
    """All (image_id, x, y, w, h) of blank pictures of the given sizes."""
    rows = sizes.select(F.col(id_column).alias("image_id"), width.cast("int").alias("w"), height.cast("int").alias("h"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).select("image_id", "x", "y", "w", "h")


def pack(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, data): the pixels of a picture as RGBA bytes in rows; pictures must be whole."""
    byte = F.concat(*(F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2, "0")) for c in "rgba"))
    rows = pixels.select("image_id", "x", "y", byte.alias("p")).groupBy("image_id")
    whole = rows.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", "p"))).alias("ps"))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("ps", lambda p: F.hex(p["p"])), "")).alias("data"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
