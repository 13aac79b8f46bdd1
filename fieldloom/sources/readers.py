"""Sources as tall tables. Files are read by Spark's readers only, so any store that Spark opens will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hour_of, safe_double

#: Fifteen stations by name with latitude and longitude, used where no station file is given.
STATIONS = (
    ("ELYS", 48.86867978171355, 2.311806320972728),
    ("PA07", 48.85719963458387, 2.293299113256733),
    ("AUT", 48.84951967972958, 2.253411499806541),
    ("BONAP", 48.85621636967545, 2.3343433611339512),
    ("OPERA", 48.870360489330714, 2.3322591802886805),
    ("HAUS", 48.87329987270092, 2.330387763170951),
    ("PA04C", 48.85943820267798, 2.351109707540651),
    ("PA13", 48.828608029768915, 2.360279635559221),
    ("CELES", 48.85261565506112, 2.3601153218686632),
    ("PA18", 48.8916687478872, 2.346671039638325),
    ("BASCH", 48.82770896097115, 2.3267480081515686),
    ("PA15L", 48.830548878814895, 2.2696778063113494),
    ("PA12", 48.83720120744435, 2.393899257058465),
    ("BP_EST", 48.83860845472763, 2.4127801276675642),
    ("SOULT", 48.83802336734008, 2.408116146897623),
)


def _numbered_lines(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """(file, line, n): the lines of text files with their number in the file.

    A file is one task's work (whole files are small here: a year of hours, a list of stations); its lines never meet
    those of another.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.split(F.decode("content", encoding), "\r?\n").alias("_l"))
    return files.select("file", F.posexplode("_l").alias("n", "line"))


def panel_csv(spark: SparkSession, path, header_line: int = 2, dropped_after: int = 3) -> DataFrame:
    """(t, station, z) of files with stations as columns.

    header_line holds the names, the dropped_after next lines are units and the like; the first column is a time with
    or without a zone, which is dropped; blanks and words are missing values. Several files or years may be given.
    """
    lines = _numbered_lines(spark, path).where(F.length(F.trim("line")) > 0)
    head = lines.where(F.col("n") == header_line).select("file", F.slice(F.split("line", ","), 2, 100_000).alias("names"))
    rows = lines.where(F.col("n") > header_line + dropped_after).select("file", F.split("line", ",").alias("c"))
    own = rows.join(head, "file").select(F.col("c")[0].alias("_t"), F.explode(F.arrays_zip("names", F.slice("c", 2, 100_000).alias("values"))).alias("v"))
    time = F.regexp_replace(F.regexp_replace("_t", "T", " "), r"\s*(Z|[+-]\d\d:?\d\d)$", "")
    return own.select(time.try_cast("timestamp_ntz").alias("t"), F.trim("v.names").alias("station"), safe_double(F.trim("v.values")).alias("z")).where("t is not null and station <> ''")


def stations_csv(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    """(station, z, x, y): columns 2, 4, 5 and 6 after one line of title and one of names; names are trimmed, BPEST is BP_EST."""
    c = F.split("line", "[,;]")
    name = F.trim(c[2])
    own = _numbered_lines(spark, path, encoding).where(F.col("n") >= 2)
    return own.select(F.when(name == "BPEST", "BP_EST").otherwise(name).alias("station"), *[safe_double(F.trim(F.get(c, F.lit(k)))).alias(a) for k, a in ((4, "z"), (5, "x"), (6, "y"))]).where("x is not null and y is not null")


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, "station string, lat double, lon double")


def weather_csv(spark: SparkSession, path) -> DataFrame:
    """(t, value) of a table of days by hours ("13h"), day first; what is no number is missing."""
    wide = spark.read.csv(path, header=True)
    day, hours = wide.columns[0], wide.columns[1:]
    tall = wide.unpivot(day, hours, "hour", "v")
    t = F.try_to_timestamp(F.concat_ws(" ", F.trim(F.col(f"`{day}`")), F.regexp_extract("hour", r"(\d+)", 1)), F.lit("d/M/yyyy H")).cast("timestamp_ntz")
    return tall.select(t.alias("t"), safe_double(F.trim("v")).alias("value")).where("t is not null")


def image_pixels(spark: SparkSession, path, crop: tuple[int, int] | None = (800, 1000), pattern: str = "*.png") -> DataFrame:
    """(image, px, py, r, g, b): row px and column py of the pixels of images, cropped about the centre to (rows, columns).

    Bytes are read in place of a decoded copy: a pixel is one row of a range joined to the image by position. Images of
    one or three or four channels; alpha is dropped.
    """
    own = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", True).load(path).select("image.*")
    rows, columns = (F.least(F.lit(crop[0]), F.col("height")), F.least(F.lit(crop[1]), F.col("width"))) if crop else (F.col("height"), F.col("width"))
    top, left = F.floor((F.col("height") - rows) / 2), F.floor((F.col("width") - columns) / 2)
    each = own.select("origin", "width", "nChannels", "data", top.alias("_t"), left.alias("_l"), columns.alias("_c"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("px"))
    # one row of an image at a time: its bytes, so that the whole image is not copied to each pixel
    start = ((F.col("px") + F.col("_t")) * F.col("width") + F.col("_l")) * F.col("nChannels") + 1
    each = each.select("origin", "px", "nChannels", "_c", F.hex(F.substring("data", start.cast("int"), (F.col("_c") * F.col("nChannels")).cast("int"))).alias("_h"))
    each = each.select("origin", "px", "nChannels", "_h", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("py"))

    def channel(k: int):
        k = F.when(F.col("nChannels") == 1, 0).otherwise(k)
        return F.conv(F.substring("_h", ((F.col("py") * F.col("nChannels") + k) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")

    return each.select(F.col("origin").alias("image"), "px", "py", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def name_parts(name) -> dict:
    """lat, lon, zoom and t of names like Screenshot_<lat>_<lon>_<zoom>_<Y>_<M>_<D>_<h>_<m>.png."""
    p = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z]+$", ""), "_")
    i = lambda k: F.get(p, F.lit(k)).try_cast("int")
    t = F.make_timestamp_ntz(i(4), i(5), i(6), i(7), i(8), F.lit(0))
    return {"lat": safe_double(F.get(p, F.lit(1))), "lon": safe_double(F.get(p, F.lit(2))), "zoom": i(3), "t": t}


def build_name(lat, lon, zoom, t):
    """The name that name_parts reads; numbers are not padded."""
    return F.concat(F.lit("Screenshot_"), F.concat_ws("_", *[F.format_string("%s", c) for c in (lat, lon, zoom, F.year(t), F.month(t), F.day(t), F.hour(t), F.minute(t))]), F.lit(".png"))


def traffic_matrix(spark: SparkSession, path, rows: int | None = None) -> DataFrame:
    """(t, r, c, colour) of CSV files with a time in the first column and a colour code under each pixel "(r, c)"; rows: only so many lines."""
    from ..functions.scalars import pair_of

    wide = spark.read.csv(path, header=True)
    wide = wide if rows is None else wide.limit(rows)
    pixels = [F.col(f"`{c}`") for c in wide.columns[1:]]
    tall = wide.withColumnRenamed(wide.columns[0], "_t").unpivot("_t", pixels, "_pixel", "_colour")
    r, c = pair_of(F.col("_pixel"))
    return tall.select(F.col("_t").try_cast("timestamp_ntz").alias("t"), r.alias("r"), c.alias("c"), F.col("_colour").try_cast("double").cast("int").alias("colour"))


def graphml(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, x, y), edges (u, v, length, lanes, highway)) of a GraphML file; lanes and highway may be lists written as ['a', 'b']."""
    found = spark.read.format("xml").option("rowTag", "key").schema("`_attr.name` string, _id string, _for string").load(path).collect()
    keys = {r[0]: r[1] for r in found}

    def value(k: str):
        return F.get(F.transform(F.filter("data", lambda d: d["_key"] == keys.get(k, "")), lambda d: d["_VALUE"]), F.lit(0))

    schema = "array<struct<_key:string,_VALUE:string>>"
    n = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {schema}").load(path)
    e = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {schema}").load(path)
    items = lambda c: F.split(F.regexp_replace(c, r"[\[\]' ]", ""), ",")
    lanes = F.when(value("lanes").isNotNull(), F.aggregate(items(value("lanes")), F.lit(0.0), lambda a, x: a + x.try_cast("double")))
    nodes = n.select(F.col("_id").cast("long").alias("node"), safe_double(value("x")).alias("x"), safe_double(value("y")).alias("y"))
    edges = e.select(F.col("_source").cast("long").alias("u"), F.col("_target").cast("long").alias("v"), safe_double(value("length")).alias("length"), lanes.alias("lanes"), F.get(items(value("highway")), F.lit(0)).alias("highway"))
    return nodes, edges


def synthetic_panel(spark: SparkSession, hours: int, names: list[str], noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(t, station, z): a constant, a daily cosine and noise that depends on the keys alone, so that any task gives the same."""
    own = spark.range(hours).withColumnRenamed("id", "t").crossJoin(F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(names)], "station string, k int")))
    u = F.pmod(F.xxhash64("t", "station", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return own.select("t", "station", (20 + F.col("k") + 5 * F.cos(2 * F.lit(3.141592653589793) * F.col("t") / 24) + noise * (u - 0.5)).alias("z"))


def hours_of_panel(panel: DataFrame) -> DataFrame:
    """The panel with t as whole hours since 1970."""
    return panel.withColumn("t", hour_of(F.col("t")))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
