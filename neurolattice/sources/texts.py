"""Small text formats, by Spark's own text readers: event lists, annotations, labels, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of each line that has any and is no comment, as an array, with the line's place."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    lines = lines.filter(~F.col("value").rlike(r"^\s*[#%;]") & F.col("value").rlike(r"\d"))
    return lines.select("place", F.transform(F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double")).alias("x"))


def read_events(spark: SparkSession, path: str, include=None, exclude=None, mask: int | None = None) -> DataFrame:
    """samp, prev_id, id from lines of three columns, or of four with the time second."""
    x = F.col("x")
    own = numbers(spark, path).filter(F.size(x) >= 3)
    rows = own.select(*(F.when(F.size(x) >= 4, x[a]).otherwise(x[b]).cast("long").alias(n) for a, b, n in ((0, 0, "samp"), (2, 1, "prev_id"), (3, 2, "id"))))
    if mask is not None:
        rows = rows.withColumns({c: F.col(c).bitwiseAND(F.lit(~mask)) for c in ("prev_id", "id")}).filter("prev_id <> id")
    if include is not None:
        rows = rows.filter(F.col("id").isin(include))
    return rows if exclude is None else rows.filter(~F.col("id").isin(exclude))


def write_events(events: DataFrame, path: str) -> None:
    """Tab-separated columns in sample order, one folder of part files."""
    events.select("samp", "prev_id", "id").orderBy("samp").write.mode("overwrite").option("sep", "\t").csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration, description from a CSV with a header."""
    df = spark.read.option("header", True).schema("onset string, duration string, description string").csv(path)
    onset = F.coalesce(F.col("onset").try_cast("double"), F.unix_micros(F.col("onset").try_cast("timestamp")) / 1e6)
    return df.select(onset.alias("onset"), F.col("duration").try_cast("double").alias("duration"), "description")


def read_label(spark: SparkSession, path: str) -> DataFrame:
    """vertex, x, y, z (metres), value of a label file: after its count, five numbers a line."""
    x = F.col("x")
    return numbers(spark, path).filter(F.size(x) == 5).select(x[0].cast("long").alias("vertex"), *((x[i + 1] / 1e3).alias(n) for i, n in enumerate("xyz")), x[4].alias("value"))


def read_besa(spark: SparkSession, path: str) -> DataFrame:
    """ch, ch_name, t, value (volts) of an averaged .avr (channels by row) or .mul (times by row) file."""
    lines = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    names = lines[1].split() if ":" in lines[0] or "=" in lines[0] else []
    wide = path.endswith(".mul")
    rows = numbers(spark, path).filter(F.forall("x", lambda v: v.isNotNull())).filter(F.size("x") > (len(names) - 1 if wide else 8))
    k = (F.row_number().over(Window.orderBy("place")) - 1).cast("long")  # an average: few rows
    cells = rows.withColumn("row", k).select("row", F.posexplode("x").alias("col", "value"))
    ch, t = (F.col("col"), F.col("row")) if wide else (F.col("row"), F.col("col"))
    name = F.element_at(F.array(*(F.lit(n) for n in names)), ch.cast("int") + 1) if names else F.concat(F.lit("CH"), ch + 1)
    return cells.select(ch.cast("long").alias("ch"), name.alias("ch_name"), t.cast("long").alias("t"), (F.col("value") * 1e-6).alias("value"))


def read_eyelink(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples: time ms, x, y, pupil; annotations: onset s, duration s, description) of an ASCII file."""
    lines = spark.read.text(path)
    part = F.split(F.trim("value"), r"\s+")
    samples = lines.filter(F.col("value").rlike(r"^\d")).select(part[0].cast("long").alias("time"), *(part[i].try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "pupil"))))
    ends = lines.filter(F.col("value").rlike("^E(FIX|SACC|BLINK)"))
    kind = F.regexp_extract("value", "^E(FIX|SACC|BLINK)", 1)
    name = F.when(kind == "FIX", "fixation").when(kind == "SACC", "saccade").otherwise("BAD_blink")
    return samples, ends.select((part[2].cast("double") / 1e3).alias("onset"), (part[4].cast("double") / 1e3).alias("duration"), name.alias("description"))
