"""Writers: CSV export, board documents, layer images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_export(df: DataFrame, path: str) -> None:
    """Quotes only where needed; missing values become empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def board(df: DataFrame, path: str, by: str = "date") -> None:
    """One folder of JSON documents a date; dates that are there already are
    kept as they are, new ones are added.

    Dates are compared as values, null among them, whatever their folders are
    called.  Two writers at once may both add a date that neither has seen.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        # the folders' names, as Spark reads them back: a row a date
        kind = df.schema[by].dataType.simpleString()
        known = spark.read.schema(f"`{by}` {kind}").json(path).select(F.col(by).alias("_there")).distinct()
        df = df.join(known, F.col(by).eqNullSafe(F.col("_there")), "left_anti")
    df.write.mode("append").partitionBy(by).json(path)


def png(layer: DataFrame) -> DataFrame:
    """``district, png`` of a byte layer ``(district, r, c, red, green, blue, alpha)``.

    One district's raster is one group; its size is set by the grid.  Spark packs
    each line of pixels into bytes; the group puts its lines one below the other.
    Cells that the layer lacks are transparent.
    """
    pixel = F.concat(*[F.unhex(F.lpad(F.hex(F.col(c).cast("int")), 2, "0")) for c in ("red", "green", "blue", "alpha")])
    lines = layer.groupBy("district", "r").agg(F.sort_array(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), pixel.alias("p")))).alias("line"))

    def image(rows):
        import zlib

        import pandas as pd

        width = 1 + max(x["c"] for line in rows["line"] for x in line)
        lines = [bytearray(4 * width) for _ in range(int(rows["r"].max()) + 1)]
        for r, line in zip(rows["r"], rows["line"]):
            for x in line:
                lines[r][4 * x["c"] : 4 * x["c"] + 4] = x["p"]
        # fixed values: signature, eight bits of red, green, blue and alpha, no filter, no interlace
        parts = {b"IHDR": b"".join(n.to_bytes(4, "big") for n in (width, len(lines))) + bytes((8, 6, 0, 0, 0)), b"IDAT": zlib.compress(b"".join(b"\0" + x for x in lines)), b"IEND": b""}
        framed = [len(body).to_bytes(4, "big") + name + body + zlib.crc32(body, zlib.crc32(name)).to_bytes(4, "big") for name, body in parts.items()]
        return pd.DataFrame({"district": rows["district"].iloc[:1], "png": [bytes.fromhex("89504e470d0a1a0a") + b"".join(framed)]})

    kind = layer.schema["district"].dataType.simpleString()
    return lines.groupBy("district").applyInPandas(image, f"district {kind}, png binary")


def documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("document"))
