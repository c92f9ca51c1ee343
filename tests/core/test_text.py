import pytest
from pyspark.sql import functions as F

from corpusloom.functions.names import name_key
from corpusloom.functions.pytext import words


@pytest.mark.parametrize(
    "text,want",
    [
        ("Don’t stop, it's <b>bold</b>&amp;free!", ["dont", "stop", "its", "bold", "free"]),
        ("ＦＵＬＬ width re​peat 3\x0760", ["full", "width", "repeat", "360"]),
        ("a<​/p>b &lt;i&gt; Straße ÉCOLE", ["a", "b", "i", "strasse", "école"]),
        ("snake_case x-ray 5 < 6 > 4", ["snake", "case", "x", "ray", "5", "6", "4"]),
        (None, []),
        ("", []),
        ("第一 页", ["第一", "页"]),
    ],
)
def test_words(text, want):
    assert words(text) == want


def test_name_key_drops_control_characters_but_splits_at_spaces(spark):
    df = spark.createDataFrame([("Ann\x07a Bell",), ("anna\tBELL",), ("by",)], "n string")
    assert [r[0] for r in df.select(name_key(F.col("n"))).collect()] == ["anna bell", "anna bell", "by"]
