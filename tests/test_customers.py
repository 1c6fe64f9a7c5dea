from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.sql import functions as F

from voxcart.operators import campaign, customers
from voxcart.plans.standins import AS_OF, RANGE, SEGMENTATION, StandIns

ITEMS = [
    ("u1", "o1", 10.0, "2024-03-01 00:00:00"),
    ("u1", "o1", 20.0, "2024-03-01 00:00:00"),
    ("u1", "o2", 60.0, "2024-03-31 00:00:00"),
    ("u1", "o3", 99.0, "2024-03-31 00:00:01"),
    ("u2", "o4", None, "2024-03-10 12:00:00"),
]


@pytest.fixture
def items(spark):
    df = spark.createDataFrame(ITEMS, "user_id string, order_id string, sale_price double, at string")
    return df.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")


def features(items, level):
    out = customers.rfm_features(
        items, "2024-03-01 00:00:00", "2024-03-31 00:00:00", "2024-04-02 08:00:00", level
    )
    return {r.user_id: (r.days_since_order, r.count_orders, r.avg_spend) for r in out.collect()}


def test_rfm_levels_and_closed_range(items):
    assert features(items, "item") == {"u1": (2, 2, 30.0), "u2": (23, 1, None)}
    assert features(items, "order") == {"u1": (2, 2, 45.0), "u2": (23, 1, None)}


def test_rfm_of_one_user(items):
    out = customers.rfm_features(items, "2024-03-01", "2024-03-31", "2024-04-02", user_id="u2")
    assert [r.user_id for r in out.collect()] == ["u2"]
    with pytest.raises(ValueError):
        customers.rfm_features(items, "2024-03-01", "2024-03-31", level="other")


@pytest.fixture(scope="module")
def fitted(spark, folder):
    df = customers.rfm_features(StandIns(spark, folder).order_items, *RANGE, AS_OF)
    return df.cache(), customers.fit_segments(df)


def test_assignment_is_the_nearest_centre(fitted):
    df, segmentation = fitted
    for row in customers.assign_segments(df, segmentation).collect():
        distances = {
            c.centroid_id: math.sqrt(
                sum(
                    ((row[n] - c.values[n]) / segmentation.spread[n]) ** 2
                    for n in customers.FEATURES
                )
            )
            for c in segmentation.centroids
        }
        assert row.centroid_id == min(distances, key=lambda i: (distances[i], i))
        listed = [(d.centroid_id, d.distance) for d in row.nearest_centroids_distance]
        assert [d for _, d in listed] == sorted(d for _, d in listed)
        assert all(abs(distances[i] - d) < 1e-9 for i, d in listed)


def test_segments_agree_with_the_library_from_the_same_seeds(spark, fitted):
    """MLlib's rounds, started at our centres, stay there and assign alike."""
    df, segmentation = fitted
    mine = {r.user_id: r.centroid_id for r in customers.assign_segments(df, segmentation).collect()}
    names = list(customers.FEATURES)
    scaled = df.select(
        "user_id",
        *(
            ((F.col(n).cast("double") - segmentation.mean[n]) / segmentation.spread[n]).alias(n)
            for n in names
        ),
    )
    rows = [[r[n] for n in names] for r in scaled.collect()]
    ids = [r.user_id for r in scaled.collect()]
    centres = [
        [(c.values[n] - segmentation.mean[n]) / segmentation.spread[n] for n in names]
        for c in segmentation.centroids
    ]
    vectors = spark.sparkContext.parallelize(rows)
    library = KMeans.train(vectors, 3, maxIterations=20, initialModel=KMeansModel(centres))
    theirs = {i: library.predict(row) for i, row in zip(ids, rows)}
    assert len({(mine[i], theirs[i]) for i in ids}) == 3


def test_centres_are_means_of_their_rows(fitted):
    df, segmentation = fitted
    assigned = customers.assign_segments(df, segmentation)
    means = {
        (r.centroid_id, r.feature): r.numerical_value
        for r in customers.segment_means(assigned).collect()
    }
    centres = {
        (r.centroid_id, r.feature): r.numerical_value
        for r in customers.centroid_table(df, segmentation).collect()
    }
    assert set(means) == set(centres) and len(centres) == 9
    spreads = segmentation.spread
    assert all(abs(means[k] - centres[k]) < 0.05 * spreads[k[1]] for k in means)


def brute_force_kmeans(rows, k, seed, rounds):
    """k-means++ and Lloyd in plain Python; rows are ``(key, values)``."""
    def chance(key, turn):
        digits = hashlib.md5(f"{seed}|{turn}|{key}".encode()).hexdigest()[:13]
        return (int(digits, 16) + 0.5) / 2**52

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    centres = []
    for turn in range(k):
        def wait(row):
            weight = min((gap(row[1], c) for c in centres), default=1.0)
            drawn = chance(row[0], turn)
            return (weight <= 0, -math.log(drawn) / weight if weight > 0 else drawn, row[0])
        centres.append(min(rows, key=wait)[1])
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, values in rows:
            groups[min(range(k), key=lambda i: (gap(values, centres[i]), i))].append(values)
        centres = [tuple(sum(c) / len(g) for c in zip(*g)) if g else c0 for g, c0 in zip(groups, centres)]
    return centres


@pytest.mark.parametrize(("k", "rounds"), [(1, 3), (3, 0), (4, 6)])
def test_seeds_and_rounds_against_plain_python(spark, k, rounds):
    rng = random.Random(k)
    raw = [(f"u{i}", rng.gauss(i % 3, 0.3), float(i % 5)) for i in range(60)] + [("u7", None, 2.0)]
    df = spark.createDataFrame(raw, "user_id string, a double, b double").repartition(3)
    got = customers.fit_segments(df, k, ("a", "b"), seed=5, rounds=rounds)
    columns = []
    for i, name in ((1, "a"), (2, "b")):
        known = [r[i] for r in raw if r[i] is not None]
        mean = sum(known) / len(known)
        spread = math.sqrt(sum((x - mean) ** 2 for x in known) / (len(raw) - 1))
        assert math.isclose(got.mean[name], mean) and math.isclose(got.spread[name], spread)
        columns.append([((mean if r[i] is None else r[i]) - mean) / spread for r in raw])
    rows = list(zip((r[0] for r in raw), zip(*columns)))
    expected = brute_force_kmeans(rows, k, 5, rounds)
    for centre, wanted in zip(got.centroids, expected):
        for name, value in zip(("a", "b"), wanted):
            assert math.isclose(
                (centre.values[name] - got.mean[name]) / got.spread[name], value, abs_tol=1e-9
            )


def test_fewer_different_rows_than_segments(spark):
    df = spark.createDataFrame([("u1", 1.0), ("u2", 1.0), (None, 1.0)], "user_id string, a double")
    got = customers.fit_segments(df, 3, ("a",))
    assert [c.values["a"] for c in got.centroids] == [1.0] * 3
    with pytest.raises(ValueError):
        customers.fit_segments(df.where("false"), 3, ("a",))


def test_missing_feature_counts_as_the_mean(spark):
    df = spark.createDataFrame(
        [("u", None, 10, 240)],
        "user_id string, avg_spend double, count_orders bigint, days_since_order bigint",
    )
    assert customers.assign_segments(df, SEGMENTATION).first().centroid_id == 2


def test_persona_prompt_and_parse(spark):
    pivoted = spark.createDataFrame(
        [(1, 45.5, 2.0, None), (2, 45.5, 2.0, 100.25)],
        "centroid_id bigint, avg_spend double, count_orders double, days_since_order double",
    )
    prompts = {r.cluster: r.prompt for r in customers.persona_prompts(pivoted).collect()}
    assert prompts[1] is None
    assert "$45.5, 2 orders" in prompts[2] and "100.25 days" in prompts[2]
    answers = spark.createDataFrame(
        [(1, '{"persona_title":"The \\"Best\\"","persona_description":["x"]}'), (2, "no json")],
        "cluster int, ml_generate_text_llm_result string",
    )
    assert [tuple(r) for r in customers.parse_personas(answers).orderBy("cluster").collect()] == [
        (1, 'The \\"Best\\', '["x"]'), (2, None, None)
    ]


def tables(spark, names=("A", "B")):
    features_df = spark.createDataFrame(
        [("u1", 100, 6, 40.0), ("u2", 500, 14, 64.0), ("u3", 1, 1, 1.0)],
        "user_id string, days_since_order bigint, count_orders bigint, avg_spend double",
    )
    products = spark.createDataFrame(
        [(f"{i:03d}", n, "c", f"about {n}") for i, n in enumerate(names)],
        "id string, name string, category string, description string",
    )
    personas = spark.createDataFrame(
        [(1, "t1", "d1"), (3, "t3", "d3")],
        "cluster bigint, persona_title string, persona_description string",
    )
    users = spark.createDataFrame(
        [("u1", "Ann", "Lee", "a@x", 30, "TX", "US"), ("u2", "Bo", "Ray", "b@x", 40, "SP", "BR")],
        "id string, first_name string, last_name string, email string, age bigint, "
        "state string, country string",
    )
    return features_df, products, personas, users


def context(spark, names=("A", "B"), chosen=("A", "B")):
    features_df, products, personas, users = tables(spark, names)
    return campaign.campaign_context(features_df, SEGMENTATION, products, personas, users, *chosen)


def test_context_is_one_row_per_customer(spark):
    out = context(spark)
    assert out.columns == [
        "centroid_id", "user_id", "days_since_order", "count_orders", "avg_spend",
        "persona_title", "persona_description", "age", "state", "country",
        "product_1_name", "product_1_description", "product_2_name", "product_2_description",
        "first_name", "last_name", "user_email",
    ]
    assert sorted((r.user_id, r.centroid_id, r.product_1_description, r.product_2_name)
                  for r in out.collect()) == [
        ("u1", 1, "about A", "B"), ("u2", 3, "about A", "B")
    ]


def test_missing_product_is_null_and_double_name_an_error(spark):
    assert {r.product_1_name for r in context(spark, chosen=("Z", "B")).collect()} == {None}
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        context(spark, names=("A", "A", "B")).collect()


def test_campaign_end_to_end(spark):
    products = tables(spark)[1]
    images = spark.createDataFrame([("gs://b/000.png",), ("gs://b/001.png",)], "uri string")
    prompts = campaign.copy_prompts(context(spark), images, products, "A", company="Acme")
    rewritten = campaign.rewrite_product_copy(
        prompts, lambda inputs, **o: [(f"copy {len(i)}", '["safe"]') for i in inputs]
    )
    described = campaign.product_descriptions(rewritten)
    assert described.columns == [
        "user_id", "cluster", "persona_title", "ml_generate_text_rai_result", "output", "uri"
    ]
    assert {r.uri for r in described.collect()} == {"gs://b/000.png"}
    asked = campaign.email_prompts(rewritten, company="Acme", discount="15%")
    assert all("15%" in r.prompt and "copy " in r.prompt for r in asked.collect())
    emails = campaign.draft_emails(asked, lambda inputs, **o: [' {"email_english":"Hi"}\n'] * len(inputs))
    assert {r.email_english for r in emails.collect()} == {'"Hi"'}
    assert emails.columns[0] == "email_english" and "user_email" in emails.columns
