import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquee.operators import cleaning as c
from marquee.operators import dedup
from marquee.plans import prepare
from marquee.sources.raw_files import null_missing


def column(df, name):
    return [r[name] for r in df.orderBy("n").select("n", name).collect()]


def frame(spark, name, values, dtype):
    return spark.createDataFrame(list(enumerate(values)), f"n int, {name} {dtype}")


def test_numbers_follow_the_lenient_reader(spark):
    df = frame(spark, "id", ["12", " 12 ", "1e3", "1d", "NaN", "inf", "1997-08-20", "", None, "-.5", "0x10"], "string")
    real = c.clean(df, [c.cast_types(real=["id", "absent"])])
    assert column(real, "id") == [12.0, 12.0, 1000.0, None, None, float("inf"), None, None, None, -0.5, None]
    kept = c.clean(df, [c.drop_shifted("id")])
    assert column(kept, "id") == ["12", " 12 ", "1e3", "inf", "-.5"]


def test_whole_numbers(spark):
    df = frame(spark, "v", ["7", "7.0", "x", None, "9007199254740993"], "string")
    assert column(c.clean(df, [c.cast_types(whole=["v"])]), "v") == [7, 7, None, None, 9007199254740993]
    for bad in ("2.5", "inf"):
        with pytest.raises(Exception, match="not a whole number"):
            c.clean(frame(spark, "v", [bad], "string"), [c.cast_types(whole=["v"])]).collect()


def test_dates(spark):
    texts = ["1995-10-30", "1995-10-3", "1", "12/1/1995", "1500-01-01", None, "1995-02-30", "1677-09-21", "2262-04-12"]
    df = frame(spark, "release_date", texts, "string")
    parsed = c.clean(df, [c.parse_day()])
    assert column(parsed, "release_date") == [dt.date(1995, 10, 30), dt.date(1995, 10, 3)] + [None] * 7
    assert c.audit(df, [c.parse_day()]).first()["affected"] == 6


def test_amount_masks(spark):
    df = frame(spark, "budget", [0.0, 1.0, 999.0, 1000.0, -5.0, None], "double")
    assert column(c.clean(df, [c.null_tiny_budget()]), "budget") == [0.0, None, None, 1000.0, -5.0, None]
    assert column(c.clean(df, c.zero_to_null("budget")), "budget") == [None, 1.0, 999.0, 1000.0, -5.0, None]
    run = frame(spark, "runtime", [0.0, 300.0, 301.0, None], "double")
    assert column(c.clean(run, [c.null_long_runtime()]), "runtime") == [0.0, 300.0, None, None]


def test_rating_masks(spark):
    df = spark.createDataFrame([(0, None, 5.0), (1, 0, 5.0), (2, 1, 5.0), (3, 9, None), (4, 10, 5.0)], "n int, vote_count int, vote_average double")
    assert column(c.clean(df, [c.null_rating_without_votes()]), "vote_average") == [None, None, 5.0, None, 5.0]
    assert column(c.clean(df, [c.null_rating_with_few_votes()]), "vote_average") == [5.0, None, None, None, 5.0]
    assert c.audit(df, [c.null_rating_with_few_votes()]).first()["affected"] == 2


def test_text_rules(spark):
    df = frame(spark, "overview", ["  a b\t\nc\x1c ", "a​b", None], "string")
    assert column(c.clean(df, c.tidy_space("overview")), "overview") == ["a b c", "a​b", None]
    words = [f"  {p.upper()} " for p in c.PLACEHOLDERS] + ["none of it", None, " TBD\n"]
    kept = column(c.clean(frame(spark, "overview", words, "string"), [c.null_placeholders()]), "overview")
    assert kept == [None] * len(c.PLACEHOLDERS) + ["none of it", None, None]
    lengths = frame(spark, "overview", ["x" * 29, "x" * 30, None], "string")
    assert column(c.clean(lengths, [c.null_short_text()]), "overview") == [None, "x" * 30, None]


def test_flags_and_missing(spark):
    df = frame(spark, "adult", ["True", " true ", "1", "False", None], "string")
    assert column(c.clean(df, [c.drop_adult()]), "adult") == ["False", None]
    assert c.clean(frame(spark, "adult", [True, False, None], "boolean"), [c.drop_adult()]).count() == 2
    cells = null_missing(frame(spark, "v", ["N/A", "None", "NA", "none", "tbd", ""], "string"))
    assert column(cells, "v") == [None, None, None, "none", "tbd", None]
    assert c.clean(df, [c.fill_missing("status"), c.null_short_text("no_such")]).columns == df.columns


def test_duplicates(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "p"), (5, None, "q"), (6, "b", "z")]
    df = spark.createDataFrame(rows, "n int, k string, v string")
    assert sorted(r["n"] for r in dedup.drop_full_duplicates(df, ["n"]).collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["n"] for r in dedup.first_by_key(df, ["k"], ["n"]).collect()) == [1, 4, 6]
    assert sorted(r["n"] for r in dedup.first_by_key(df, ["k"], ["n"], keep_null_keys=True).collect()) == [1, 4, 5, 6]
    assert {r["k"]: r["v"] for r in dedup.last_value(df, "k", "v", "n").collect()} == {"a": "y", None: "q", "b": "z"}


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") / 10_000).cast("int").alias("k"), "id")
    plan = dedup.first_by_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before and once after the exchange


def test_optional_masks_are_off_by_default(spark):
    labels = [s.label for s in prepare.movie_steps()]
    strict = [s.label for s in prepare.movie_steps(strict=True)]
    assert strict[: len(labels)] == labels
    assert strict[len(labels):] == ["null_short_text[overview]", "null_rating_with_few_votes"]
