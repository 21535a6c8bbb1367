"""Readers, on small files made here."""

import json
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from terravia.operators import assets as A
from terravia.operators import graph as G
from terravia.sources import documents as D
from terravia.sources import tracks as T

GPX = """<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>all</name></metadata>
<wpt lat="40.5" lon="-121.5"><name> Lookout peak </name><sym>Summit</sym></wpt><wpt lat="x" lon="1"><name>bad</name></wpt>
<trk><name>day one</name><trkseg><trkpt lat="40.1" lon="-121.1"><ele>1500</ele><time>2024-06-01T10:00:00Z</time></trkpt><trkpt lat="40.2" lon="-121.2"><ele>1600</ele></trkpt></trkseg>
<trkseg><trkpt lat="40.3" lon="-121.3"/></trkseg></trk>
<trk><trkseg><trkpt lat="41" lon="-120"/><trkpt lat="41.5" lon="-120.5"/><trkpt lat="" lon="-1"/></trkseg></trk>
<rte><rtept lat="42" lon="-119"/><rtept lat="42.5" lon="-119.5"/></rte></gpx>"""
KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>
<Placemark><name>a</name><LineString><coordinates>-121.0,40.0,10 -121.1 , 40.1 , 20 junk,1 -121.2,40.2</coordinates></LineString></Placemark>
<Placemark><gx:Track><when>2024-06-01T00:00:00Z</when><when>2024-06-01T00:01:00Z</when><gx:coord>-120 41 5</gx:coord><gx:coord>-120.1 41.1 6</gx:coord></gx:Track></Placemark></Document></kml>"""


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_gpx(spark, tmp_path):
    path = write(tmp_path / "g", a__gpx=GPX)
    rows = T.read_tracks(spark, path).orderBy("track_id", "pidx").collect()
    assert [(r.track_id, r.lon, r.lat, r.ele) for r in rows] == [
        ("day one-0", -121.1, 40.1, 1500.0), ("day one-0", -121.2, 40.2, 1600.0), ("route-2", -119.0, 42.0, None), ("route-2", -119.5, 42.5, None), ("track-1", -120.0, 41.0, None), ("track-1", -120.5, 41.5, None),
    ]
    (w,) = T.gpx_waypoints(T.read_files(spark, path).select("file", F.col("content").cast("string").alias("text"))).collect()
    assert (w.label, w.icon, w.lon, w.weight) == ("Lookout peak", "peak", -121.5, 3)


def test_kml_kmz_and_hostile_files(spark, tmp_path):
    folder = tmp_path / "k"
    folder.mkdir()
    for name, members in {"good.kmz": {"other.kml": "<kml/>", "sub/doc.kml": KML}, "many.kmz": {f"{i}.kml": KML for i in range(513)}}.items():
        with zipfile.ZipFile(folder / name, "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
    write(folder, plain__kml=KML, evil__kml="<!DOCTYPE x [<!ENTITY a 'b'>]>" + KML, broken__kmz=b"PK\x03\x04nothing", empty__gpx="<gpx/>", noise__bin=b"\xff\xfe\x00")
    rows = T.read_tracks(spark, str(folder)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.track_id, r.lon, r.lat, r.ele))
    assert set(by) == {"plain.kml", "good.kmz"}
    assert sorted(by["plain.kml"], key=str) == sorted(by["good.kmz"], key=str)
    assert sorted(by["plain.kml"])[0][0] == "track-0" and len(by["plain.kml"]) == 5
    assert T.extent(T.read_tracks(spark, str(folder))).first().files == 2


def test_gpx_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("f", "a&b", i, -120.0 - i, 40.0 + i) for i in range(3)] + [("f", "c", i, -1.0, float(i)) for i in range(2)], "file string, track_id string, vidx int, lon double, lat double")
    (r,) = T.to_gpx(points).collect()
    back = T.read_tracks(spark, write(tmp_path / "r", x__gpx=r.text))
    assert sorted((x.track_id, x.lon, x.lat) for x in back.collect()) == sorted([(f"a&b-{0}", -120.0 - i, 40.0 + i) for i in range(3)] + [("c-1", -1.0, float(i)) for i in range(2)])


def png(text_chunks):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return D.PNG + b"".join(chunk(k, b) for k, b in [(b"IHDR", bytes(13)), *text_chunks, (b"IEND", b"")])


def test_png_manifests(spark, tmp_path):
    body = lambda d: b"manifest\0\0" + zlib.compress(json.dumps(d).encode())
    path = write(
        tmp_path / "p",
        good__png=png([(b"zTXt", b"other\0\0" + zlib.compress(b"{}")), (b"zTXt", body({"spec": {"region_id": "r1"}, "edition": 2}))]),
        nospec__png=png([(b"zTXt", body({"x": 1}))]), broken__png=png([(b"zTXt", b"manifest\0\0garbage")]), none__png=png([]), notpng__png=b"hello", badjson__png=png([(b"tEXt", b"manifest\0{")]),
    )
    rows = D.manifests(spark, path, "manifest").selectExpr("file", "variant_get(manifest, '$.spec.region_id', 'string') AS region", "variant_get(manifest, '$.edition', 'int') AS edition").collect()
    assert [(r.file.rsplit("/", 1)[-1], r.region, r.edition) for r in rows] == [("good.png", "r1", 2)]


def test_catalogue_and_assets(spark, tmp_path):
    root = tmp_path / "regions"
    root.mkdir()
    import hashlib

    sha = hashlib.sha256(b"dem").hexdigest()
    write(root / "r1", region__json=json.dumps({"id": "r1", "name": "One", "crs": "EPSG:32610", "bounds": [0, 1, 2, 3], "overview_size": [10, 20], "unknown": 1}), dem__tif=b"dem",
          sources__json=json.dumps({"assets": {"dem.tif": {"sha256": sha, "bytes": 3}, "gone.json": {"sha256": "x", "bytes": 1}, "labels.json": {"sha256": "stale", "bytes": 2}}, "sources": [{"dataset": "Survey"}]}),
          labels__json=json.dumps({"crs": "c", "features": [{"name": "Peak", "kind": "summit", "rank": 3, "coords": [[1, 2], [3, 4]]}]}),
          playa__json=json.dumps({"playas": [{"name": "P", "coords": [[0, 0]]}]}), net__json=json.dumps({"ways": [{"class": "road", "coords": [[0, 0], [3, 4], [3, 4], [3, 8]]}]}))
    write(root / "r2", region__json=json.dumps({"bounds": [5, 5, 6, 6]}))
    rows = {r.region_id: r for r in D.regions(spark, str(root)).collect()}
    assert (rows["r1"].max_y, rows["r1"].overview_h, rows["r2"].min_x, rows["r2"].name) == (3.0, 20, 5.0, None)
    verdicts = {r.name: r.verdict for r in A.verify(D.listed_assets(spark, str(root)), D.found_assets(spark, str(root))).where("bundle = 'r1'").collect()}
    assert (verdicts["dem.tif"], verdicts["gone.json"], verdicts["labels.json"], verdicts["region.json"]) == ("ok", "missing", "drift", "unlisted")
    assert [(r.name, r.rank, r.coords) for r in D.labels(spark, str(root)).collect()] == [("Peak", 3, [[1.0, 2.0], [3.0, 4.0]])]
    assert D.playas(spark, str(root)).first().name == "P" and D.datasets(spark, str(root)).first().datasets == ["Survey"]
    edges = G.from_ways(D.ways(spark, f"{root}/r1/net.json")).orderBy("eid").collect()
    assert [(e.src, e.dst, e.len_m) for e in edges] == [("0.0,0.0", "3.0,4.0", 5.0), ("3.0,4.0", "3.0,8.0", 4.0)]


def test_kmz_members_that_cannot_be_read_give_no_row(spark, tmp_path):
    import io
    import zipfile

    def packed(method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("doc.kml", "<kml><Placemark><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></kml>" * 20)
        return out.getvalue()

    good = packed()
    at = good.index(b"doc.kml") + 7
    encrypted = bytearray(good)
    for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        encrypted[encrypted.index(mark) + offset] |= 1
    unknown = bytearray(good)
    for mark, offset in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        unknown[unknown.index(mark) + offset] = 99
    broken = good[:at] + bytes(len(good[at : at + 20])) + good[at + 20 :]
    path = write(tmp_path / "z", good__kmz=good, encrypted__kmz=bytes(encrypted), unknown__kmz=bytes(unknown), broken__kmz=broken, cut__kmz=good[:40], lzma__kmz=packed(zipfile.ZIP_LZMA))
    files = T.read_files(spark, path)
    assert {r.file.rsplit("/", 1)[-1] for r in T.open_kmz(files).collect()} == {"good.kmz", "lzma.kmz"}


def test_kml_geometry_anywhere_in_a_placemark(spark):
    text = """<kml xmlns:gx="u"><Document><!-- <Placemark><Point><coordinates>9,9</coordinates></Point></Placemark> --><Folder>
      <Placemark><name> Camp </name><Point><coordinates> 1.5 , 2.5 ,7 </coordinates></Point></Placemark>
      <Placemark><MultiGeometry><LineString><coordinates>1,2 3,4
5,x</coordinates></LineString><LineString
><coordinates>6,7,8 9,10,11</coordinates></LineString><Point><coordinates>4,5</coordinates></Point></MultiGeometry></Placemark>
      <Placemark><gx:Track><when>2024-01-01T00:00:00Z</when><when>2024-01-01T00:01:00Z</when><gx:coord>1 2 3</gx:coord><gx:coord>4 5 6</gx:coord></gx:Track></Placemark></Folder></Document></kml>"""
    texts = spark.createDataFrame([("f", text), ("g", "<!DOCTYPE x>" + text), ("h", "no xml"), ("i", None)], "file string, text string")
    points = T.kml_points(texts).orderBy("seg", "pidx").collect()
    assert [(p.lon, p.lat, p.ele) for p in points] == [(1.0, 2.0, None), (3.0, 4.0, None), (5.0, None, None), (6.0, 7.0, 8.0), (9.0, 10.0, 11.0), (1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert [p.time for p in points][-1] == "2024-01-01T00:01:00Z" and {p.file for p in points} == {"f"}
    assert sorted((w.lon, w.lat, w.label) for w in T.kml_waypoints(texts).collect()) == [(1.5, 2.5, "Camp"), (4.0, 5.0, "")]


def test_ingest_counts_and_days(spark, tmp_path):
    point = lambda lat, lon, time="": f'<trkpt lat="{lat}" lon="{lon}">{f"<time>{time}</time>" if time else ""}</trkpt>'
    gpx = "<gpx><trk><name>day</name><trkseg>" + point(40, -121) + point(40.001, -121, "2024-06-01T23:59:00Z") + point(40.3, -121.2) + point(40, 150) + "</trkseg></trk><trk><trkseg>" + point(40, 150) + point(40, 151) + "</trkseg></trk></gpx>"
    tracks, counts = T.ingest(spark, write(tmp_path / "i", a__gpx=gpx), 10)
    (c,) = counts.collect()
    assert (c.points, c.kept, c.dropped, c.tracks, c.dropped_tracks) == (6, 3, 3, 2, 1)
    rows = tracks.orderBy("vidx").collect()
    assert {r.track_id for r in rows} == {"day-0"} and {r.day for r in rows} == {"2024-06-01"} and [r.vidx for r in rows] == list(range(len(rows))) and len(rows) >= 2
    assert 650_000 < rows[0].x < 680_000 and 4_400_000 < rows[0].y < 4_500_000


def test_files_are_opened_once(spark, tmp_path, monkeypatch):
    """Whatever reads the parsed rows again, no plan goes back to the files under the path."""
    line = lambda a: f'<trkpt lat="{a}" lon="-121"/><trkpt lat="{a + 1}" lon="-121"/>'
    one = f'<gpx><trk><name>n</name><trkseg>{line(40)}</trkseg><trkseg><trkpt lat="1" lon="2"/></trkseg><trkseg>{line(41)}</trkseg></trk></gpx>'
    back = T.read_tracks(spark, write(tmp_path / "o", a__gpx=one, b__gpx=one))
    assert sorted((r.file[-5:], r.track_id, r.pidx, r.lat) for r in back.collect()) == [(f, f"n-{k}", i, 40.0 + k + i) for f in ("a.gpx", "b.gpx") for k in (0, 1) for i in (0, 1)]
    assert "binaryFile" not in back._jdf.queryExecution().toString()


def odd_documents(tmp_path):
    """A folder with a documents table of which some texts are null or empty."""
    import pandas as pd

    folder = tmp_path / "odd"
    folder.mkdir()
    texts = [None if i % 4 == 1 else "" if i % 4 == 2 else f"text {i}" for i in range(1, 60)]
    pd.DataFrame({"doc_id": range(1, 60), "text": texts, "lang": "en", "source": [f"src{i % 3}" for i in range(1, 60)], "n_chars": [len(t or "") for t in texts]}).to_parquet(folder / "documents.parquet")
    return str(folder)


def test_files_without_a_byte_are_there(spark, tmp_path):
    from terravia.plans import stores
    from tests.conftest import duck, same

    (tmp_path / "plates").mkdir()
    write(tmp_path / "plates/a", x__txt=b"", y__txt=b"y")
    found = {(r.bundle, r.name): r.bytes for r in D.found_assets(spark, str(tmp_path / "plates")).collect()}
    assert found == {("a", "x.txt"): 0, ("a", "y.txt"): 1}
    folder = odd_documents(tmp_path)
    from terravia import catalog

    same(stores.files_verified(spark, folder), duck(folder), catalog.entries()["files_verified"].oracle)


def test_many_files_are_listed_and_removed_by_tasks(spark, tmp_path):
    import os

    from terravia.sources import blobs

    rows = spark.range(2000).select(F.concat((F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("key"), F.lit("x").alias("content"))
    root = f"file://{tmp_path}/many"
    blobs.write(rows, root)
    (tmp_path / "many/0/.half-0123456789abcdef0123456789abcdef").write_text("being written")
    found = D.found_assets(spark, root)
    assert found.inputFiles() == [] and found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism, "no file is planned in the driver"
    assert sorted((r.bundle, int(r.name)) for r in found.collect()) == sorted((str(i % 3), i) for i in range(2000))
    blobs.remove(spark, root)
    assert not os.path.exists(tmp_path / "many")


def test_pictures_are_dealt_over_folders_and_read_by_tasks(spark, tmp_path, monkeypatch):
    import os

    import pandas as pd

    from terravia.plans import files
    from tests.conftest import duck, same

    (tmp_path / "p").mkdir()
    (tmp_path / "p/deep").mkdir()
    path = write(tmp_path / "p/deep", a__png=png([(b"tEXt", b'manifest\0{"spec":1}')]))
    found = D.manifests(spark, str(tmp_path / "p"), "manifest")
    assert found.inputFiles() == [] and [r.file for r in found.collect()] == [f"{path}/a.png"], "no file is planned in the driver"
    folder = tmp_path / "t"
    folder.mkdir()
    pd.DataFrame({"o_orderkey": range(5000), "o_custkey": range(5000)}).to_parquet(folder / "orders.parquet")
    most = []
    remove = files.blobs.remove
    monkeypatch.setattr(files.blobs, "remove", lambda s, root: most.append(max(len(names) for _, _, names in os.walk(root.removeprefix("file://")))) or remove(s, root))
    from terravia import catalog

    same(files.png_manifests(spark, str(folder)), duck(folder), catalog.entries()["png_manifests"].oracle)
    assert most == [1000], "pictures of one folder"
