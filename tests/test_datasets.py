"""Readers of data sets and topics, on small files written here."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestar.functions.exprs import utm
from lodestar.operators.placemap import extract
from lodestar.sources import datasets, npy
from pyspark.sql import functions as F

T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("/cam/right", "sensor_msgs/Image"), ("/cam/left", "sensor_msgs/CompressedImage"), ("/gps", "sensor_msgs/NavSatFix"), ("/nmea", "nmea_msgs/Sentence"), ("/tf", "tf2_msgs/TFMessage")]
    return spark.createDataFrame(rows, "topic string, type string")


def test_topics(catalog):
    assert datasets.suggested_topic(catalog) == "/cam/left"
    assert datasets.suggested_topic(catalog, datasets.TRAJECTORY_TYPES) == "/gps"
    assert {r.topic for r in datasets.topics_of(catalog, datasets.IMAGE_TYPES).collect()} == {"/cam/left", "/cam/right"}
    assert datasets.topics_of(catalog, datasets.IMAGE_TYPES, "/cam/right").first().topic == "/cam/right"
    for topic in ("/gps", "/none"):
        with pytest.raises(ValueError, match="is no topic"):
            datasets.topics_of(catalog, datasets.IMAGE_TYPES, topic)
    with pytest.raises(ValueError, match="no topic of"):
        datasets.suggested_topic(catalog.where("type like 'tf%'"))


def test_timestamps_and_tracks(spark, tmp_path):
    (tmp_path / "stereo.timestamps").write_text("1000000 1\n1500000 1\n2000000 2\n")
    assert [(r.us, r.file) for r in datasets.image_timestamps(spark, str(tmp_path / "stereo.timestamps")).orderBy("us").collect()] == [(1000000, "1000000.png"), (1500000, "1500000.png")]
    (tmp_path / "gps.csv").write_text("timestamp,num,easting,northing,altitude\n5000000,3,620300.5,5735000.25,110.5\n")
    r = datasets.gps(spark, str(tmp_path / "gps.csv")).first()
    assert (r.ts, r.easting, r.northing, r.altitude) == (datetime(1970, 1, 1, 0, 0, 5), pytest.approx(620300.5 + datasets.ORIGIN[0]), pytest.approx(5735000.25 + datasets.ORIGIN[1]), 110.5)
    (tmp_path / "rtk.csv").write_text("timestamp,roll,pitch,yaw,easting,northing,altitude\n5000000,0,0,3.141592653589793,1,2,3\n")
    r = datasets.ground_truth(spark, str(tmp_path / "rtk.csv"), (0.0, 0.0, 0.0)).first()
    assert (r.easting, r.northing, r.altitude) == (1, 2, 3) and (r.qx, r.qy, r.qz, r.qw) == pytest.approx((0, 0, 1, 0), abs=1e-9)


def test_lookup_table_and_image_files(spark, tmp_path):
    x = np.arange(12.0).reshape(2, 2, 3)
    (tmp_path / "lut.bin").write_bytes(x.tobytes())
    got = {(r.row, r.col): (r.x, r.y) for r in datasets.lookup_table(spark, str(tmp_path / "lut.bin"), 2, 3).collect()}
    assert got == {(i, j): (x[0, i, j], x[1, i, j]) for i in range(2) for j in range(3)}
    with pytest.raises(Exception, match="no lookup table"):
        datasets.lookup_table(spark, str(tmp_path / "lut.bin"), 3, 3).collect()
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/1.png").write_bytes(b"x")
    (tmp_path / "a/2.png").write_bytes(b"yy")
    (tmp_path / "a/3.txt").write_bytes(b"z")
    assert sorted(r.length for r in datasets.image_files(spark, str(tmp_path / "a")).select("length").collect()) == [1, 2]


def sentence(body):
    check = 0
    for c in body.encode():
        check ^= c
    return f"${body}*{check:02X}"


def test_sentences(spark):
    body = "GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,"
    assert sentence(body).endswith("*47")
    south = body.replace(",N,", ",S,").replace(",E,", ",W,").replace("GPGGA", "GNGGA")
    rows = [(0, sentence(body)), (1, "$" + body), (2, sentence(south).lower().replace("$gngga", "$GNGGA")[:-3] + "*00"), (3, sentence(south)), (4, "$" + body + "*48"), (5, sentence(body.replace(",E,1,", ",E,0,"))), (6, sentence("GPRMC,1,2")), (7, "$GPGGA,,,,,,,,,"), (8, None), (9, ""), (10, sentence(body.replace("545.4", "high")))]
    df = spark.createDataFrame(rows, "id int, sentence string")
    got = {r.id: r for r in datasets.nmea_positions(df).collect()}
    assert set(got) == {0, 1, 3}
    place = spark.range(1).select(*utm(F.lit(48 + 7.038 / 60), F.lit(11 + 31 / 60))).first()
    assert (got[0].zone, got[0].easting, got[0].northing) == pytest.approx(tuple(place)) and got[0].altitude == 545.4
    assert got[3].lat == pytest.approx(-(48 + 7.038 / 60)) and got[3].lon == pytest.approx(-(11 + 31 / 60))


def test_frames_with_positions(spark, catalog):
    at = lambda s: T + timedelta(seconds=s)
    rows = [("/cam/left", at(s), None, None, None, f"frame {s}") for s in (0, 5, 11, 30)] + [("/cam/right", at(5), None, None, None, "other")]
    rows += [("/gps", at(s), 51.0 + s / 1000, 7.0, float(s), None) for s in (1, 11, 21)] + [("/gps", at(6), None, None, None, None), ("/tf", at(7), None, None, None, None)]
    messages = spark.createDataFrame(rows, "topic string, ts timestamp, latitude double, longitude double, altitude double, content string")
    got = {r.content: r for r in datasets.frames_with_positions(messages, catalog).collect()}
    assert set(got) == {"frame 5", "frame 11"} and got["frame 11"].altitude == 11.0 and got["frame 5"].altitude == pytest.approx(5.0)
    a, b = (spark.range(1).select(*utm(F.lit(51.0 + s / 1000), F.lit(7.0))).first()[2] for s in (1, 11))
    assert got["frame 5"].northing == pytest.approx(a + 0.4 * (b - a))
    with pytest.raises(ValueError, match="is no topic"):
        datasets.frames_with_positions(messages, catalog, position_topic="/tf")
    typed = messages.withColumn("type", F.lit("tf2_msgs/TFMessage"))
    with pytest.raises(ValueError, match="no position"):
        datasets.positions(typed)
    assert datasets.positions(typed.limit(0)).count() == 0


def test_codebook_and_extractor(spark, tmp_path):
    np.save(tmp_path / "book.npy", np.arange(6.0).reshape(3, 2).astype("<f4"))
    assert [(r.k, r.center) for r in npy.codebook(spark, str(tmp_path / "book.npy")).orderBy("k").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    np.save(tmp_path / "two.npy", np.zeros((1, 2)))
    with pytest.raises(ValueError, match="more than one"):
        npy.codebook(spark, str(tmp_path / "*.npy"))

    def extractor(batches):
        for pdf in batches:
            yield pdf.assign(bits=pdf.n * 2)[pdf.n > 0][["image_id", "bits"]]

    images = spark.createDataFrame([(1, 0), (2, 5)], "image_id long, n long")
    assert [tuple(r) for r in extract(images, extractor, "image_id long, bits long").collect()] == [(2, 10)]
