from __future__ import annotations

from pyspark.sql import functions as F

from voxcart.operators import files
from voxcart.plans import local_models as models
from voxcart.sources.files import list_files


def write(spark, folder, sizes):
    rows = [(f"{folder}/f{i:03d}.png", bytes([i % 251]) * n) for i, n in enumerate(sizes)]
    return files.write_files(spark.createDataFrame(rows, "uri string, content binary").repartition(3))


def test_files_are_packed_by_size(spark, tmp_path):
    sizes = [3_000_000] * 6 + [10] * 40
    assert write(spark, str(tmp_path), sizes) == 46
    packs = files.packed(list_files(spark, str(tmp_path)), pack_bytes=8 << 20)
    got = packs.groupBy("pack").agg(F.sum(F.col("size") + files.OPEN_BYTES).alias("bytes")).collect()
    assert packs.count() == 46 and len(got) == -(-sum(s + files.OPEN_BYTES for s in sizes) // (8 << 20))
    assert max(r.bytes for r in got) <= (8 << 20) + 3_000_000 + files.OPEN_BYTES


def test_batches_have_a_bound_and_bad_files_fail_alone(spark, tmp_path):
    write(spark, str(tmp_path), [100] * 10)
    listing = list_files(spark, str(tmp_path)).select("uri", "size")
    gone = spark.createDataFrame([(f"{tmp_path}/missing.png", 5)], "uri string, size long")

    def provider(contents, **options):
        if sum(map(len, contents)) > 250:
            raise ValueError("too much at once")
        return [f"{len(contents)} {len(c)}" for c in contents]

    out = files.map_files(listing.union(gone), provider, batch_bytes=250).collect()
    assert len(out) == 11
    states = {r.uri.rpartition("/")[2]: r.status for r in out}
    assert states.pop("missing.png").startswith("FileNotFoundError")
    assert set(states.values()) == {""} and all(r.answer for r in out if r.status == "")


def test_embeddings_have_the_right_length(spark, tmp_path):
    png = F.arrow_udf(models.png_files, "binary")
    df = spark.range(5).select(
        F.concat(F.lit(f"{tmp_path}/"), "id", F.lit(".png")).alias("uri"),
        png(F.md5(F.col("id").cast("string"))).alias("content"),
    )
    files.write_files(df)
    listing = list_files(spark, str(tmp_path))
    good = files.embed_files(listing, models.image_vector).collect()
    assert {(len(r.embedding), r.status) for r in good} == {(1408, "")}
    bad = files.embed_files(listing, lambda c, **o: [[1.0]] * len(c)).collect()
    assert {(r.embedding, r.status) for r in bad} == {(None, "1 numbers")}


def test_batches_have_a_bound_in_files_and_packs_stay_apart(spark, tmp_path):
    """Small files with large answers: neither batches nor tasks may take all of them."""
    write(spark, str(tmp_path), [10] * 200)
    listing = list_files(spark, str(tmp_path)).select("uri", "size")
    out = files.map_files(
        listing, lambda contents, **o: [str(len(contents))] * len(contents), pack_bytes=32 << 20
    ).withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert len(rows) == 200 and max(int(r.answer) for r in rows) <= files.BATCH_FILES
    assert len({r.task for r in rows}) > 1
