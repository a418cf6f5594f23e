import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions.text import contains_like, like_ascii, lines_of, short_name
from lattica.operators import lookup, search
from tests.golden import frames, plain


def ids(df):
    return [r["id"] for r in df.collect()]


def test_exact_name_first(spark):
    s, _ = frames(spark)
    assert ids(search.search(s, "main"))[0] == 1
    assert len(ids(search.search(s, "net", 2))) <= 2
    assert ids(search.search(s, "no_such")) == []


def test_representative_is_chosen_before_matching(spark):
    rows = [plain(1, "foo", "x::foo", definition=False), plain(2, "bar", "x::foo", kind="macro"), plain(3, "foo2", "y::foo2")]
    s, _ = frames(spark, rows)
    # the definition (id 2) stands for x::foo, so its kind counts
    assert ids(search.search(s, "foo")) == [2, 3] or set(ids(search.search(s, "foo"))) == {2, 3}
    assert ids(search.search_by_kind(s, "foo", "function")) == [3]
    assert ids(search.search_api(s, "foo", "nothing")) == ids(search.search(s, "foo"))
    assert ids(search.search_tool(s, "foo", "nothing")) == [3]


def test_empty_query_and_empty_table(spark):
    s, _ = frames(spark)
    assert len(ids(search.search(s, ""))) == 6
    assert ids(search.search(s.limit(0), "a")) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aAbB_%\\éÉ\n", max_size=6), min_size=1, max_size=30), st.text("aAbB_%\\éÉ", max_size=4))
def test_like_is_that_of_the_index_format(spark, values, pattern):
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [(r[0], r[1]) for r in df.select(like_ascii(F.col("v"), pattern), contains_like(F.col("v"), pattern)).collect()]
    want = [tuple(map(bool, db.execute("SELECT ? LIKE ?, ? LIKE ?", (v, pattern, v, f"%{pattern}%")).fetchone())) for v in values]
    assert got == want


def test_lookups(spark):
    s, _ = frames(spark)
    assert ids(lookup.symbols_in_file(s, "src/network.cpp")) == [3, 4]
    assert sorted(ids(lookup.symbols_by_ids(s, [4, 1, 4, 99]))) == [1, 4]
    assert ids(lookup.symbols_by_ids(s, [])) == []
    assert lookup.symbol_field(s, 2, "name").first()[0] == "core::init_system"
    assert lookup.symbol(s, 99).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a::b::c", "x\r\ny\n"), ("c", ""), ("b::c", "\n\nz")], "q string, t string")
    rows = df.select(short_name(F.col("q")), lines_of(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["b::c", "c", "b::c"]
    assert [r[1] for r in rows] == [["x", "y"], [], ["", "", "z"]]
