import datetime
import struct
import zlib

from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.sources import readers, sinks


def test_panel_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("junk\nmore\n,A, B \nunit,x,y\nunit,x,y\nunit,x,y\n2022-01-01 00:00:00+01:00,1.5,\n2022-01-01T01:00:00Z,x,2\n")
    got = {(r.t, r.station): r.z for r in readers.panel_csv(spark, str(tmp_path / "p.csv")).collect()}
    at = datetime.datetime
    assert got == {(at(2022, 1, 1, 0), "A"): 1.5, (at(2022, 1, 1, 0), "B"): None, (at(2022, 1, 1, 1), "A"): None, (at(2022, 1, 1, 1), "B"): 2.0}


def test_stations_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("titre é\na,b,c,d,e,f,g\n1,2, BPEST ,4,30,652000,6862000\n1,2,X,4,,1,2\n".encode("latin-1"))
    got = readers.stations_csv(spark, str(tmp_path / "s.csv")).orderBy("station").collect()
    assert [tuple(r) for r in got] == [("BP_EST", 30.0, 652000.0, 6862000.0), ("X", None, 1.0, 2.0)]
    assert readers.stations(spark).count() == 15


def test_weather_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,0h,13h\n1/2/2023,3,-\n12/10/2023,4.5,6\n")
    got = {r.t: r.value for r in readers.weather_csv(spark, str(tmp_path / "w.csv")).collect()}
    at = datetime.datetime
    assert got == {at(2023, 2, 1, 0): 3.0, at(2023, 2, 1, 13): None, at(2023, 10, 12, 0): 4.5, at(2023, 10, 12, 13): 6.0}


def png(width, height, pixel):
    rows = b"".join(b"\0" + b"".join(bytes((*pixel(i, j), 255)) for j in range(width)) for i in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_image_pixels_crop_and_classes(spark, tmp_path):
    colours = [(99, 214, 104), (255, 151, 77), (242, 60, 50), (129, 31, 31), (0, 0, 0)]
    name = "Screenshot_48.8580073_2.3342828_13_2022_12_8_10_45.png"
    (tmp_path / name).write_bytes(png(6, 4, lambda i, j: colours[(i + j) % 5]))
    px = readers.image_pixels(spark, str(tmp_path), (2, 4))
    got = {(r.px, r.py): r.c for r in px.select("px", "py", S.colour_class(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()}
    assert got == {(i, j): [1, 2, 3, 4, 0][(i + 1 + j + 1) % 5] for i in range(2) for j in range(4)}
    parts = px.select("image").distinct().select(*[c.alias(k) for k, c in readers.name_parts(F.col("image")).items()]).first()
    assert (parts.lat, parts.lon, parts.zoom, parts.t) == (48.8580073, 2.3342828, 13, datetime.datetime(2022, 12, 8, 10, 45))
    again = spark.range(1).select(readers.build_name(F.lit("48.8580073"), F.lit("2.3342828"), F.lit(13), F.lit(parts.t)).alias("n")).first().n
    assert again == name


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        """<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><key id="d3" for="edge" attr.name="lanes"/><key id="d4" for="edge" attr.name="highway"/>
<graph><node id="1"><data key="d0">2.5</data><data key="d1">48</data></node><node id="2"><data key="d0">2.6</data><data key="d1">48.5</data></node>
<edge source="1" target="2"><data key="d2">10.5</data><data key="d3">['2', '3']</data><data key="d4">['primary', 'x']</data></edge><edge source="2" target="1"><data key="d2">4</data><data key="d4">service</data></edge></graph></graphml>"""
    )
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(map(tuple, nodes.collect())) == [(1, 2.5, 48.0), (2, 2.6, 48.5)]
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 10.5, 5.0, "primary"), (2, 1, 4.0, None, "service")]


def test_stage_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path), "x", {"a": 1}, make).count() == 3
    sinks.stage(spark, str(tmp_path), "x", {"a": 2}, make)
    assert len(made) == 2
    rows = spark.createDataFrame([("m", "s", 1, 1.0, 2.0)], "model string, station string, t long, estimate double, truth double")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    sinks.write_predictions(rows.replace("m", "n"), str(tmp_path / "p"))
    assert sinks.read_predictions(spark, str(tmp_path / "p")).count() == 2


def test_synthetic_and_projection(spark):
    p = readers.synthetic_panel(spark, 48, ["a", "b"])
    assert p.count() == 96 and sorted(map(tuple, p.collect())) == sorted(map(tuple, p.repartition(3).collect()))
    lat, lon = S.lambert93(F.lit(652709.401), F.lit(6859290.946))
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(r.lat - 48.83) < 0.05 and abs(r.lon - 2.355) < 0.05
    lat, lon = S.lambert93(F.lit(700000.0), F.lit(6600000.0))
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(r.lat - 46.5) < 1e-5 and abs(r.lon - 3) < 1e-9


def test_traffic_matrix(spark, tmp_path):
    for k, line in enumerate(("2020-01-01 10:00:00,1,0", "2020-01-02 10:15:00,,4.0")):
        (tmp_path / f"{k}.csv").write_text(f'time,"(0, 3)","(12, 7)"\n{line}\n')
    got = [(str(r.t), r.r, r.c, r.colour) for r in readers.traffic_matrix(spark, str(tmp_path)).collect()]
    a, b = "2020-01-01 10:00:00", "2020-01-02 10:15:00"
    assert sorted(got, key=str) == sorted([(a, 0, 3, 1), (a, 12, 7, 0), (b, 0, 3, None), (b, 12, 7, 4)], key=str)
    assert readers.traffic_matrix(spark, str(tmp_path), rows=1).count() == 2
