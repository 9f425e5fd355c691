from pyspark.sql import functions as F

from colloquy.functions.text import clock, duration_text, file_stem, parse_clock, split_names, strip


def _one(spark, expr, value, typ):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clock_cases(spark):
    cases = {0: "00:00", 45: "00:45", 125: "02:05", 1.9: "00:01", 3600: "60:00", 3661: "61:01",
             6000: "100:00"}
    for secs, want in cases.items():
        assert _one(spark, clock, float(secs), "double") == want


def test_duration_text(spark):
    assert _one(spark, duration_text, 60.0, "double") == "1:00"
    assert _one(spark, duration_text, 125.0, "double") == "2:05"
    assert _one(spark, duration_text, 0.0, "double") == "0:00"


def test_parse_clock(spark):
    assert _one(spark, parse_clock, "2:05", "string") == 125.0
    assert _one(spark, parse_clock, "0:75", "string") == 75.0  # seconds >= 60 accepted
    for bad in ["123", "1:2:3", "a:b", ""]:
        assert _one(spark, parse_clock, bad, "string") is None


def test_strip_is_unicode(spark):
    s = "　\t a b \x1c \n"
    assert _one(spark, strip, s, "string") == s.strip()


def test_split_names_keeps_empty(spark):
    assert _one(spark, split_names, " A , B,", "string") == ["A", "B", ""]


def test_file_stem(spark):
    for name in ["a.wav", "a.tar.gz", ".bashrc", "plain"]:
        import pathlib
        assert _one(spark, file_stem, name, "string") == pathlib.PurePath(name).stem
