from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxcart import schemas
from voxcart.operators import reviews
from voxcart.operators.inference import RESULT
from voxcart.plans.standins import StandIns

ORDERS = "id string, user_id string, product_id string, created_at string"


def order_items(spark, rows):
    df = spark.createDataFrame(rows, ORDERS)
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def review(review_id, order="o1", user="u1", product="p1", name="n", rating="5", text="t"):
    return (review_id, order, user, product, name, rating, text)


def snapshot(spark, review_rows, order_rows, uris):
    df = reviews.latest_review_snapshot(
        spark.createDataFrame(review_rows, schemas.RAW_REVIEWS),
        order_items(spark, order_rows),
        spark.createDataFrame([(u,) for u in uris], "uri string"),
    )
    return [tuple(r) for r in df.orderBy("review_id", "order_id", "product_id", "uri").collect()]


def test_newest_line_wins_and_missing_time_comes_last(spark):
    rows = [
        review("001", user="u2", text="unknown user"),
        review("001", user="u1", text="known user"),
        review("002", order="o9", text="no order line"),
    ]
    lines = [("o1", "u1", "p1", "2024-01-01 00:00:00"), ("o1", "u1", "p1", None)]
    got = snapshot(spark, rows, lines, ["gs://b/x001.png", "gs://b/y001.png", "gs://b/z.png"])
    assert [(r[0], r[6], r[7]) for r in got] == [
        ("001", "known user", "gs://b/x001.png"),
        ("001", "known user", "gs://b/y001.png"),
        ("002", "no order line", None),
    ]


def test_ties_go_to_the_smallest_row(spark):
    rows = [review("001", user="u3", text="b"), review("001", user="u2", text="c")]
    assert snapshot(spark, rows, [], [])[0][2] == "u2"


def test_null_keys_stay(spark):
    rows = [review(None, user=None), review("001", order=None)]
    assert len(snapshot(spark, rows, [("o1", None, "p1", None)], [])) == 2


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(*[st.sampled_from("ab")] * 4, st.sampled_from("xyz")), min_size=1, max_size=20
    ),
    st.lists(st.tuples(*[st.sampled_from("ab")] * 3, st.integers(1, 9)), max_size=8),
)
def test_matches_brute_force(spark, review_rows, line_rows):
    rows = [(r, o, u, p, "n", "1", t) for r, o, u, p, t in review_rows]
    lines = [(i, u, p, f"2024-01-0{day} 00:00:00") for i, u, p, day in line_rows]
    expected = {}
    for row in rows:
        times = [c for i, u, p, c in lines if (i, u, p) == (row[1], row[2], row[3])]
        rank = (max(times, default=""), row)
        key = (row[0], row[1], row[3])
        best = expected.get(key)
        newer = best is None or rank[0] > best[0] or (rank[0] == best[0] and row < best[1])
        if newer:
            expected[key] = rank
    got = [r[:7] for r in snapshot(spark, rows, lines, [])]
    assert sorted(got) == sorted(row for _, row in expected.values())


def test_null_keys_keep_their_own_text_and_image(spark):
    rows = [
        review(r, order=o, product=p, user=u, name=name, text=f"{r}{o}{p}{u}{text}")
        for r in ("001", None) for o in ("o1", None) for p in ("p1", None)
        for u in ("u2", None) for name, text in (("n", "b"), ("n", "a"), (None, "c"), (None, None))
    ]
    lines = [("o1", "u2", "p1", "2024-01-01 00:00:00"), ("o1", None, "p1", "2025-01-01 00:00:00"),
             (None, None, None, "2025-01-01 00:00:00")]
    got = snapshot(spark, rows, lines, ["gs://b/001.png", "gs://b/x.png"])
    # Only the known order line has a time; elsewhere the missing user comes first.
    expected = {
        (r, o, "u2" if (o, p) == ("o1", "p1") else None, p, None, "5",
         f"{r}{o}{p}{'u2' if (o, p) == ('o1', 'p1') else None}None", r and "gs://b/001.png")
        for r in ("001", None) for o in ("o1", None) for p in ("p1", None)
    }
    assert len(got) == 8 and set(got) == expected


@pytest.fixture
def shuffle_joins(spark):
    changed = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in changed}
    for name in changed:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_with(df, column, capsys) -> int:
    df.explain("formatted")
    inputs = re.findall(r"Exchange *\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    return sum(bool(re.search(rf"\b{column}#", columns)) for columns in inputs)


def test_texts_are_shuffled_once(spark, shuffle_joins, capsys):
    review_df = spark.createDataFrame([review("001")], schemas.RAW_REVIEWS)
    images = spark.createDataFrame([("gs://b/001.png",)], "uri string")
    df = reviews.latest_review_snapshot(
        review_df, order_items(spark, [("o1", "u1", "p1", "2024-01-01 00:00:00")]), images
    )
    assert shuffles_with(df, "review_text", capsys) == 1


def test_stand_in_shuffles_a_text_once_for_both_copies(spark, folder, shuffle_joins, capsys):
    assert shuffles_with(StandIns(spark, folder).raw_reviews, "text", capsys) == 1


def test_lines_that_no_review_names_are_shuffled_once(spark, shuffle_joins, capsys):
    number = F.col("id").cast("string")
    lines = spark.range(0, 5000, 1, 4).select(
        number.alias("id"), F.lit("u1").alias("user_id"), F.lit("p1").alias("product_id"),
        F.timestamp_seconds("id").alias("created_at"),
    )
    review_df = spark.createDataFrame(
        [review(f"{i:03d}", order=str(i)) for i in range(50)], schemas.RAW_REVIEWS
    )
    df = reviews.latest_review_snapshot(
        review_df, lines, spark.createDataFrame([], "uri string")
    )
    df._jdf.queryExecution().executedPlan().execute().count()
    df.explain("formatted")
    final = capsys.readouterr().out
    stages = re.findall(r"ShuffleQueryStage .*rowCount=([0-9.E+]+)", final)
    assert sum(float(rows) >= 5000 for rows in stages) == 1
    assert df.count() == 50


def test_sentiment_covers_every_score(spark):
    def answer(score):
        return f'{{"document_sentiment":{{"score":{score},"magnitude":1.5}}}}'

    rows = [("a", answer(0.1)), ("b", answer(-2)), ("c", answer(0.0)), ("d", None), ("e", "bad"),
            ("f", answer('"x"'))]
    df = spark.createDataFrame(rows, "review_id string, ml_understand_text_result string")
    got = {r.review_id: (r.sentiment, r.sentiment_magnitude, r.sentiment_score)
           for r in reviews.score_sentiment(df).collect()}
    assert got == {
        "a": ("positive", 1.5, 0.1),
        "b": ("negative", 1.5, -2.0),
        "c": ("neutral", 1.5, 0.0),
        "d": ("unknown", None, None),
        "e": ("unknown", None, None),
        "f": ("unknown", 1.5, None),
    }


def test_translation_columns_and_unknown_language(spark):
    rows = [("001", "texte", '{"translations":[{"translated_text":" It&#39;s ",'
             '"detected_language_code":" fr"}]}', ""),
            ("002", "x", '{"translations":[{"translated_text":"y",'
             '"detected_language_code":"xx"}]}', "")]
    df = spark.createDataFrame(
        rows,
        "review_id string, review_text string, ml_translate_result string, "
        "ml_translate_status string",
    )
    languages = spark.createDataFrame([("fr", "French")], "iso_639_1 string, language_name_en string")
    out = reviews.translated_reviews(df, languages)
    assert out.columns == ["review_id", "review_text_raw", "review_text", "review_language"]
    assert sorted(map(tuple, out.collect())) == [
        ("001", "texte", "It's", "French"), ("002", "x", "y", None)
    ]


def test_prompted_variants(spark):
    df = spark.createDataFrame([("1", "good"), ("1", "good"), ("2", None)],
                               "review_id string, review_text string")
    translated = reviews.translate_by_prompt(df, lambda inputs, **o: [i.upper() for i in inputs])
    assert translated.columns[:2] == ["review_text_raw", "review_text"]
    assert RESULT not in translated.columns
    scored = reviews.sentiment_by_prompt(df, lambda inputs, **o: ["positive"] * len(inputs))
    assert scored.columns == ["review_id", "review_text", "review_sentiment"]
    assert sorted(r.review_sentiment or "" for r in scored.collect()) == [
        "", "positive", "positive"
    ]


def test_join_back_keeps_unmatched_answers(spark):
    answers = spark.createDataFrame([("1", "positive"), ("9", "neutral")],
                                    "review_id string, review_sentiment string")
    df = spark.createDataFrame([("1", "good")], "review_id string, review_text string")
    got = sorted(map(tuple, reviews.sentiment_join_back(answers, df).collect()))
    assert got == [("1", "good", "positive"), ("9", None, "neutral")]
    assert reviews.sentiment_join_back(answers, df).columns.count("review_id") == 1
