from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, hashing, names


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    "path, parent, stem, suffix",
    [
        ("/x/IMG_1.HEIC", "/x", "IMG_1", ".HEIC"),
        ("C:\\In\\a.tar.gz", "C:/In", "a.tar", ".gz"),
        ("/top", "/", "top", ""),
        ("plain.jpg", ".", "plain", ".jpg"),
        ("/x/.hidden", "/x", ".hidden", ""),
        ("/x/dot.", "/x", "dot.", ""),
        ("/x/.a.b", "/x", ".a", ".b"),
    ],
)
def test_path_parts(spark, path, parent, stem, suffix):
    row = spark.createDataFrame([(path,)], "p string")
    name = names.file_name(F.col("p"))
    assert tuple(row.select(names.parent(F.col("p")), names.stem(name), names.suffix(name)).head()) == (parent, stem, suffix)


@pytest.mark.parametrize("stem, want", [("IMG_E1234", "IMG_1234"), ("img_e1234", "img_1234"), ("IMG_1234", "IMG_1234"), ("foo_bar", "foo_bar"), ("FOOIMG_E1234", "FOOIMG_E1234")])
def test_normalize_stem(spark, stem, want):
    assert one(spark, names.normalize_stem(F.col("s")), s=stem) == want


def test_hamming(spark):
    rows = [("ff00", "ff01", 1), ("ff00", "00ff", 16), ("ffffffffffffffff", "0", 64), ("zz", "0", 999), (None, "0", 999), ("8000000000000000", "0", 1)]
    got = spark.createDataFrame(rows, "a string, b string, d int").select(hashing.hamming(F.col("a"), F.col("b")), "d").collect()
    assert all(x == y for x, y in got)


@pytest.mark.parametrize("count", [1, 5, 8, 64])
def test_bands_cover_all_bits(spark, count):
    parts = one(spark, hashing.bands(F.lit(-1).cast("bigint"), count))
    assert sum(bin(p.value & (2**64 - 1)).count("1") for p in parts) == 64


@pytest.mark.parametrize(
    "meta, want, source",
    [
        ({"EXIF:DateTimeOriginal": "2024:01:15 10:30:45"}, datetime(2024, 1, 15, 10, 30, 45), "exiftool"),
        ({"File:FileModifyDate": "2019:03:15 10:30:00+08:00"}, datetime(2020, 1, 1), "mtime"),
        ({"File:FileModifyDate": "2019:03:15 10:30:00", "EXIF:DateTimeOriginal": "2024:01:15 10:30:45"}, datetime(2024, 1, 15, 10, 30, 45), "exiftool"),
        (None, datetime(2020, 1, 1), "mtime"),
        ({"EXIF:DateTimeOriginal": "0000:00:00 00:00:00", "XMP:CreateDate": "2021:05:06 07:08:09"}, datetime(2021, 5, 6, 7, 8, 9), "exiftool"),
        ({"EXIF:CreateDate": "2024:1:5 1:2:3"}, datetime(2024, 1, 5, 1, 2, 3), "exiftool"),
        ({"EXIF:CreateDate": "2024:02:30 00:00:00"}, datetime(2020, 1, 1), "mtime"),
        ({"EXIF:CreateDate": "2024:02:03 04:05:06+08:00"}, datetime(2024, 2, 3, 4, 5, 6), "exiftool"),
        ({"EXIF:CreateDate": ""}, datetime(2020, 1, 1), "mtime"),
    ],
)
def test_resolve_time(spark, meta, want, source):
    row = spark.createDataFrame([(meta, datetime(2020, 1, 1))], "meta map<string,string>, mtime timestamp_ntz")
    got = row.select(dates.resolve_time(F.col("meta"), F.col("mtime")).alias("t")).head().t
    assert (got.time, got.source) == (want, source)


def test_embedded_time_comes_before_mtime(spark):
    row = spark.createDataFrame([(None, "2011:12:13 14:15:16", datetime(2020, 1, 1))], "meta map<string,string>, e string, mtime timestamp_ntz")
    got = row.select(dates.resolve_time(F.col("meta"), F.col("mtime"), F.col("e")).alias("t")).head().t
    assert (got.time, got.source) == (datetime(2011, 12, 13, 14, 15, 16), "pillow")


def test_folders(spark):
    row = spark.createDataFrame([(datetime(987, 3, 4),)], "t timestamp_ntz")
    assert tuple(row.select(dates.year_folder(F.col("t")), dates.month_folder(F.col("t"))).head()) == ("0987", "03")
