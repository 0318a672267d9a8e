import pytest
from pyspark.sql import functions as F

from tessel import providers, queries
from tessel.plans import build as plan
from tessel.plans import commits
from tessel.sources import catalog
from tessel.streaming import build


def test_sample_catalog_round_trip(spark, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.write_sample(spark, path)
    catalog.write_sample(spark, path)  # what is there stays
    rows = catalog.valid_products(catalog.read_catalog(spark, path))
    assert rows.count() == 15 and dict(rows.dtypes)["id"] == "bigint"
    assert [r.id for r in catalog.valid_products(catalog.read_catalog(spark, path), 3).collect()] == [1000, 1001, 1002]


def test_rows_without_id_or_title_go(spark):
    rows = spark.createDataFrame([("1", "  a \t b "), ("", "x"), (None, "x"), ("2", " "), ("x", "t"), ("3", None)], "id string, productDisplayName string")
    assert [(r.id, r.productDisplayName) for r in catalog.valid_products(rows).collect()] == [(1, "a b")]


def test_descriptions_from_files(spark, tmp_path):
    (tmp_path / "7.json").write_text('{"data": {"productDescriptors": {"description": {"value": "soft"}}}}')
    (tmp_path / "8.json").write_text("{broken")
    found = {r.id: r.description for r in catalog.read_styles(spark, str(tmp_path)).collect()}
    assert found == {7: "soft", 8: ""}


def test_incremental_build_keeps_the_latest_rows(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    schema = "id long, version long, v string"
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 0, "x"), (3, 1, "d")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        build.stream_versions(spark.readStream.schema(schema).parquet(source), "id", "version", table, state).awaitTermination()
    found = {r.id: r.v for r in build.current(spark.read.parquet(table), "id", "version").collect()}
    assert found == {1: "c", 2: "b", 3: "d"}


def test_hashed_encoder_gives_unit_vectors(spark):
    rows = spark.createDataFrame([("red dress",), ("red dress",), ("blue jeans",), ("",)], "t string").select("t", providers.hashed_ngrams(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v != rows[2].v and abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and not any(rows[3].v)


def test_default_text_and_prompt_mean(spark):
    encoder = providers.HashedText()
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "fashion product"), (4, "red dress")], "i int, t string")
    found = {r.i: r for r in providers.with_ensemble(rows, encoder, "t", "e").withColumn("v", encoder.encode(F.col("t"))).collect()}
    assert found[1].v == found[2].v == found[3].v != found[4].v
    assert all(abs(sum(x * x for x in r.e) - 1) < 1e-5 for r in found.values()) and found[4].e != found[4].v


def test_images_that_cannot_be_read_are_grey(spark):
    plain = lambda level: bytes([level]) * 12
    rows = [(1, ("", 2, 2, 3, 16, plain(250))), (2, ("", -1, -1, -1, -1, None)), (3, None), (4, ("", 2, 2, 1, 0, bytes([250]) * 4)), (5, ("", 2, 2, 3, 16, plain(128)))]
    images = spark.createDataFrame(rows, "id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    found = {r.id: (r.v, r.b[0].box) for r in images.select("id", providers.ColourImage().encode(F.col("image")).alias("v"), providers.WholeImage().boxes(F.col("image")).alias("b")).collect()}
    shown = {r.id: r.s for r in images.select("id", providers.readable(F.col("image")).alias("s")).collect()}
    assert (shown[3].width, bytes(shown[3].data)) == (224, bytes([128]) * (224 * 224 * 3)) and shown[1].data == rows[0][1][5]
    assert found[2] == found[3] and found[2][1] == [0.0, 0.0, 224.0, 224.0] and found[2][0] == found[5][0] != found[1][0] == found[4][0]


def test_index_build_versions_and_progress(spark, tmp_path):
    catalog.write_sample(spark, str(tmp_path / "catalog"))
    rows = catalog.read_catalog(spark, str(tmp_path / "catalog"))
    ids = spark.range(1000, 1012).select("id", F.lit(None).cast("struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").alias("image"))
    styles = spark.createDataFrame([(1000, "A soft one to wear")], "id long, description string")
    ready, heard, path = plan.prepare_products(rows, ids, styles), [], str(tmp_path / "index")
    assert {r.id: r.description for r in ready.collect()}[1000] == "A soft one to wear" and ready.count() == 12
    built = lambda p, **more: plan.build_index(p, path, providers.HashedText(), providers.ColourImage(), **more).first()
    first = built(ready, parts=3, progress=lambda done, total: heard.append((done, total)))
    assert first.success and (first.indexed_count, first.stats.unified, first.stats.image) == (12, 24, 12) and heard[-1] == (12, 12) and heard == sorted(heard)
    again = built(ready.where("id < 1003").withColumn("usage", F.lit("Sports")))
    assert (again.indexed_count, again.total_products) == (3, 3) and again.stats == first.stats  # this run's, and the whole index
    assert {r.usage for r in plan.open_table(spark, path, "image").where("product_id < 1003").collect()} == {"Sports"}
    rows = lambda name: sorted(map(str, plan.open_table(spark, path, name).collect()))
    before = {name: rows(name) for name in plan.TABLES}
    plan.compact(spark, path)
    assert {name: rows(name) for name in plan.TABLES} == before and len(commits.committed(spark, path)[1]) == 1
    assert {f.name for f in (tmp_path / "index" / "image").iterdir()} == {f"build={commits.committed(spark, path)[1][0]}"}
    assert built(ready.where("id < 1002"), clear_existing=True).stats.image == 2
    none = built(ready.limit(0))
    assert not none.success and none.error and none.indexed_count == 0 and none.stats.image == 2
    commits.reset(spark, path)
    assert built(ready.limit(0)).stats.image == 0 and not list((tmp_path / "index" / "image").iterdir())


class Failing(providers.HashedText):
    """Fails on a title, after other rows have been encoded."""

    def encode(self, text):
        return F.when(text.contains("rare word"), F.raise_error(F.lit("no vector")).cast("array<float>")).otherwise(super().encode(text))


def test_a_build_that_fails_leaves_the_index_as_it_was(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, f"title {i}", "Men", "Apparel", "Topwear", "Shirts", "Blue", "Summer", "2012", "Casual") for i in range(1, 9)]
    names = "id long, name string, gender string, masterCategory string, subCategory string, articleType string, baseColour string, season string, year string, usage string"
    ready = spark.createDataFrame(rows, names).withColumns({"productDisplayName": F.col("name"), "description": F.lit(""), "image": F.lit(None).cast("struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")})
    plan.build_index(ready, path, providers.HashedText(), providers.ColourImage(), parts=2)
    before = sorted(map(str, plan.open_table(spark, path, "chunks").collect()))
    bad = ready.withColumn("usage", F.when(F.col("id") == 5, "rare word").otherwise("Party"))  # its chunks can't be encoded
    heard = []
    with pytest.raises(Exception, match="no vector"):
        plan.build_index(bad, path, Failing(), providers.ColourImage(), parts=8, progress=lambda *x: heard.append(x))
    assert heard  # some parts were done
    assert sorted(map(str, plan.open_table(spark, path, "chunks").collect())) == before
    left = commits.vacuum(spark, path)
    assert left and sorted(map(str, plan.open_table(spark, path, "chunks").collect())) == before


def test_commits_that_race_keep_both_builds(spark, tmp_path):
    path, once = str(tmp_path / "x"), []

    def late(builds):
        if not once:  # another one comes in between
            once.append(commits.commit(spark, path, lambda b: [*b, "00000001-b"]))
        return [*builds, "00000001-a"]

    commits.create_if_absent(spark, path)
    commits.create_if_absent(spark, path)
    assert commits.committed(spark, path) == (0, [])
    assert commits.commit(spark, path, late) == ["00000001-b", "00000001-a"] and commits.committed(spark, path)[0] == 2
    assert commits.versions(spark, path, "image") is None
    with pytest.raises(ValueError):
        plan.open_table(spark, path, "image")


def test_first_rows_of_the_file(spark, tmp_path):
    """A limit takes the first valid rows in the order of the file, whatever their ids."""
    folder = tmp_path / "csv"
    folder.mkdir()
    lines = ["id,gender,masterCategory,subCategory,articleType,baseColour,season,year,usage,productDisplayName"]
    ids = [90, 7, "", 55, 3, "x", 12, 1]
    (folder / "styles.csv").write_text("\n".join(lines + [f"{i},Men,Apparel,Topwear,Shirts,Blue,Summer,2012,Casual,title {i}" for i in ids]))
    rows = catalog.read_catalog(spark, str(folder), ordered=True)
    taken = catalog.valid_products(rows, 4)
    assert [r.id for r in taken.collect()] == [90, 7, 55, 3] and not set(catalog.ORDER) & set(taken.columns)
    images = spark.createDataFrame([(i, None) for i in (7, 3, 12, 1)], "id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    assert sorted(r.id for r in plan.prepare_products(rows, images, limit=2).collect()) == [3, 7]  # the first with an image
    assert [r.id for r in catalog.valid_products(rows.drop(*catalog.ORDER), 2).collect()] == [1, 3]


def png(width, height, pixels):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_only_whole_images_are_readable(spark, tmp_path):
    whole = png(2, 3, bytes(range(18)))
    files = {"1.png": whole, "2.png": whole[:36], "3.png": b"", "4.jpg": b"no image at all", "5.jpg": b"\xff\xd8\xff\xe0" + b"x" * 50 + b"\xff\xd9", "6.jpg": b"\xff\xd8\xff\xe0" + b"x" * 50, "7.gif": b"GIF89a\x01;", "name.png": whole, "8.jpg": b"\xff\xd8\xff"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.id: (r.format, r.length) for r in catalog.readable_images(spark, str(tmp_path)).collect()}
    assert found == {1: ("png", len(whole)), 5: ("jpeg", 56), 7: ("gif", 8)}
    decoded = {r.id: r.image for r in catalog.image_files(spark, str(tmp_path)).collect()}
    assert list(decoded) == [1] and (decoded[1].width, decoded[1].height) == (2, 3)
    goods = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    assert [r.id for r in catalog.with_readable_images(goods, catalog.readable_images(spark, str(tmp_path))).collect()] == [1]


def test_texts_are_encoded_once_and_to_their_limit(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(1, long), (2, " ".join(f"w{i}" for i in range(77)) + " other end"), (3, None), (4, ""), (5, "red dress"), (6, "red dress")], "i int, t string")
    vectors = {r.i: r.v for r in providers.with_vectors(rows, providers.HashedText(batch=2), "t", "v").collect()}
    assert vectors[1] == vectors[2] != vectors[5] == vectors[6] and vectors[3] == vectors[4]
    assert vectors == {r.i: r.v for r in rows.select("i", providers.HashedText().encode(F.col("t")).alias("v")).collect()}
    plan_ = providers.with_vectors(rows, providers.HashedText(), "t", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("ArrowEvalPython") == 1 and "Aggregate" in plan_[plan_.index("ArrowEvalPython") :]  # below the encoder texts are distinct


def test_a_prompt_mean_is_that_of_its_phrasings(spark):
    import numpy as np

    from tessel.operators.intent import prompts

    encoder = providers.HashedText()
    rows = spark.createDataFrame([(1, "running shoes"), (2, "jeans"), (3, " "), (4, None), (5, "jeans")], "i int, q string")
    got = {r.i: r.vector for r in providers.with_ensemble(rows, encoder, "q").collect()}
    phrases = rows.select("i", F.explode(prompts(F.col("q"))).alias("p")).select("i", encoder.encode(F.col("p")).alias("v")).collect()
    for i in range(1, 6):
        mean = np.mean([np.array(r.v, "f8") for r in phrases if r.i == i], axis=0)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-6)
    assert got[2] == got[5] and got[3] == got[4]


def test_encoders_of_a_product_share_a_worker(spark):
    """Image and title are encoded by one Python worker of a task."""
    rows = queries.pictures(spark.range(3).withColumnRenamed("id", "key"), "key").withColumn("name", F.lit("red dress"))
    encoded = plan.encoded_products(rows, providers.HashedText(), providers.ColourImage())
    assert encoded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [len(r.image_vector) + len(r.title_vector) for r in encoded.collect()] == [128] * 3


def test_a_small_file_of_many_rows_is_dealt_into_tasks(spark):
    """The work of a scan is dealt by rows, however few bytes they have, and no row is lost."""
    from tessel.session import spread

    dealt = spread(spark.range(0, 5000, 1, 1), "id", 100)
    assert dealt.rdd.getNumPartitions() == 50 and dealt.distinct().count() == 5000
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == 8
    rows = queries.context_rows(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
