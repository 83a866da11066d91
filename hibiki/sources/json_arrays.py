"""Large JSON documents that are one array of objects, read by many tasks.

Spark's reader takes such a document in one task. Here it is read as text with closing braces for
line ends, which splits anywhere. Whether a brace closes a record follows from what is before it:
the number of quotation marks tells whether it lies within a text, the braces outside of texts how
deep. Both are running sums, first per split (a few numbers each), then inside each split. Pieces
with the same number of closed records before them make up a record, which is parsed by its schema.

The result is that of Spark's own reader for a whole document: one row per object of the array. What
is no object of the array is left out, an empty array gives no rows, and an object that does not fit
the schema has nulls where it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.session import write_out

_CHAR = r'(?:[^"\\]|\\.)'  # one character of a text, as written


def _quotes(piece: Column) -> Column:
    """Quotation marks that begin or end a text: all but those behind a backslash."""
    return F.length(F.regexp_replace(F.regexp_replace(piece, r"(?s)\\.", ""), r'[^"]', ""))


def _opened(piece: Column, inside: Column) -> Column:
    """Braces opened outside of texts, in a piece that begins inside or outside of one."""
    outer = F.when(inside, F.regexp_replace(piece, f'(?s)^{_CHAR}*+"?', "")).otherwise(piece)
    outer = F.regexp_replace(outer, f'(?s)"{_CHAR}*+"?', "")
    return F.length(F.regexp_replace(outer, r"[^{]", "")).cast("long")


def _before(rows: DataFrame, value: str) -> tuple[DataFrame, Column]:
    """The sums of ``value`` over earlier splits of a file, and the running sum inside a split."""
    sums = rows.groupBy("file", "split").agg(F.sum(value).alias("sum"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return sums, F.col("earlier") + F.coalesce(F.sum(value).over(inside), F.lit(0))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per object of the array in each file below a path."""
    pieces = (
        spark.read.option("lineSep", "}").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
        .withColumn("quotes", _quotes(F.col("piece")))
    )
    pieces = write_out(pieces, "pieces")
    sums, so_far = _before(pieces, "quotes")
    known = pieces.join(sums, ["file", "split"]).withColumn("so_far", so_far)
    # The brace that ends the piece counts unless it is part of a text.
    closes = F.when((F.col("so_far") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    known = known.select(
        "file", "split", "at", "piece", closes.alias("closes"),
        (_opened(F.col("piece"), F.col("so_far") % 2 == 1) - closes).alias("deeper"),
    )
    known = write_out(known, "braces")
    sums, depth = _before(known, "deeper")
    known = known.join(sums, ["file", "split"]).withColumn("depth", depth)
    ends = F.when((F.col("closes") == 1) & (F.col("depth") + F.col("deeper") == 0), 1).otherwise(0)
    known = write_out(known.select("file", "split", "at", "piece", ends.alias("ends")), "ends")
    sums, record = _before(known, "ends")
    known = known.join(sums, ["file", "split"]).withColumn("record", record)
    # A record's pieces are as many as it has braces. Before the first stands what opens the array.
    whole = known.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("split", "at", "piece"))).alias("pieces"), F.max("ends").alias("ends")
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["piece"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[^{]*+", "")
    return whole.filter("ends = 1").select(F.from_json(text, schema).alias("row")).select("row.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """One array document per partition, a line per object."""
    size = F.count(F.lit(1)).over(Window.partitionBy("part"))
    own = Window.partitionBy("part").orderBy("json")
    rows = df.select(F.spark_partition_id().alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    rows = rows.select("part", "json", F.row_number().over(own).alias("nth"), size.alias("size"))
    line = F.concat(F.when(F.col("nth") == 1, "[").otherwise(""), "json", F.when(F.col("nth") == F.col("size"), "]").otherwise(","))
    rows.repartition("part").sortWithinPartitions("part", "nth").select("part", line.alias("line")).write.partitionBy("part").text(path)
