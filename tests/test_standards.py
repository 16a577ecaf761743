"""Standards dictionaries: read from a file, joined whatever their size."""
from wideprep.operators.standardize import read_standards, standardize

MAPPING = [("d", 1, "land", "Country", 1.0, "rule", True), ("d", 2, "way", "Channel", 1.0, "rule", True)]
SCHEMA = "dataset string, col_ordinal int, source_column string, target_field string, confidence double, method string, user_confirmed boolean"


def test_file_is_read(spark, tmp_path):
    (tmp_path / "words.txt").write_text("country:\n  ind: India\n  # not an entry\n  'u k': \"United Kingdom\"\n\nchannel:\n  on-line: E-commerce\n")
    got = sorted(tuple(r) for r in read_standards(spark, str(tmp_path / "words.txt")).collect())
    assert got == [("channel", "on-line", "E-commerce"), ("country", "ind", "India"), ("country", "u k", "United Kingdom")]


def test_table_gives_what_the_dict_gives(spark):
    rows = [(i, v, w) for i, (v, w) in enumerate(
        [("IND", "online"), (" ind ", None), (None, "Other way"), ("", "ONLINE"), ("n/a", "x"), ("spain", "online")] * 3)]
    table = spark.createDataFrame(rows, "_row_id long, land string, way string")
    mapping = spark.createDataFrame(MAPPING, SCHEMA)
    words = {"country": {"ind": "India"}, "channel": {"online": "E-commerce"}}
    long = [(d, a.upper(), c) for d, x in words.items() for a, c in x.items()]
    # repeated aliases make no rows, unknown dimensions and null aliases no entries
    long += [("country", "ind", "Indonesia"), ("planet", "ind", "Mars"), ("country", None, "Nowhere")]
    joined = standardize(table, mapping, spark.createDataFrame(long, "dimension string, alias string, canonical string"))
    literal = standardize(table, mapping, words)
    assert joined.columns == literal.columns
    assert sorted(joined.collect()) == sorted(literal.collect())
    empty = spark.createDataFrame([], "dimension string, alias string, canonical string")
    assert sorted(standardize(table, mapping, empty).collect()) == sorted(standardize(table, mapping, None).collect())
