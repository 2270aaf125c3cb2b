import pytest
from pyspark.sql import functions as F

from lumifield.operators import catalog
from lumifield.sources import stacks, tables
from lumifield.streaming import arrivals


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "slides"
    (root / "sub").mkdir(parents=True)
    for name in ("a.tif", "b.TIFF", "c.ome.tif", "d.png", "e.tif.bak", "sub/f.tif"):
        (root / name).write_bytes(b"x")
    return root


def base(rows):
    return sorted(r.path.rsplit("/", 1)[-1] for r in rows)


def test_listing_is_case_blind_and_flat(spark, folder):
    found = stacks.list_stacks(spark, str(folder))
    assert base(found.collect()) == ["a.tif", "b.TIFF", "c.ome.tif"]
    left = stacks.not_seen(found, found.where("path LIKE '%a.tif'"))
    assert base(left.collect()) == ["b.TIFF", "c.ome.tif"]


def test_stream_hands_on_each_file_once(spark, folder, tmp_path):
    table, marks = str(tmp_path / "table"), str(tmp_path / "marks")
    run = lambda: arrivals.record_arrivals(arrivals.arriving_stacks(spark, str(folder)), table, marks).awaitTermination()
    run()
    run()
    (folder / "late.tif").write_bytes(b"y")
    run()
    assert base(spark.read.parquet(table).collect()) == ["a.tif", "b.TIFF", "c.ome.tif", "late.tif"]


def stack(spark):
    return spark.range(2 * 3 * 100).selectExpr(
        "'s.tif' AS file", "CAST(id div 300 AS INT) AS cycle", "CAST(id div 100 % 3 AS INT) AS channel",
        "id % 100 div 10 AS y", "id % 10 AS x", "id AS v")


def test_stored_stack_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "px")
    stacks.write_stack(stack(spark), path)
    part = stacks.read_stack(spark, path, cycles=[1], channels=[0, 2], max_size=4)
    assert part.count() == 2 * 16
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cycle" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "LessThan(y,4)" in plan and "LessThan(x,4)" in plan
    assert sorted(map(tuple, stacks.read_stack(spark, path).collect())) == sorted(map(tuple, stack(spark).collect()))
    info = stacks.stack_info(stacks.read_stack(spark, path)).first()
    assert (info.n_channels, info.height, info.width, info.dtype) == (3, 10, 10, "uint16")


def test_a_task_writes_a_bounded_part_of_a_plane(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stacks, "TILE", 2)
    monkeypatch.setattr(stacks, "TASK_ROWS", 20, raising=False)
    stacks.write_stack(stack(spark), str(tmp_path / "px"))
    stacks.export_stacks(stack(spark).withColumn("out_name", F.col("file")), str(tmp_path / "out"))
    for name in ("px", "out"):  # six and three planes of 100 and 200 pixels
        back = spark.read.parquet(str(tmp_path / name)).withColumn("part", F.input_file_name())
        size = {r["part"]: r["count"] for r in back.groupBy("part").count().collect()}
        assert sum(size.values()) == 600 and max(size.values()) <= 40
    assert sorted(map(tuple, stacks.read_stack(spark, str(tmp_path / "px")).collect())) == sorted(map(tuple, stack(spark).collect()))


def test_export_applies_working_image_crop_and_name(spark, tmp_path):
    px = stack(spark).where("cycle = 0")
    files = catalog.with_defaults(spark.createDataFrame(
        [("s.tif", "/d/s.tif", 1, 2, 6, "changed_")], "file string, path string, reference_channel int, working_ndim int, max_size int, prefix string"))
    work = px.where("channel = 1").withColumn("v", px.v + 1000)
    out = str(tmp_path / "out")
    stacks.export_stacks(stacks.export_rows(px, work, files), out)
    back = spark.read.parquet(out)
    assert back.count() == 3 * 36 and {r.out_name for r in back.select("out_name").distinct().collect()} == {"changed__s.tif"}
    assert back.where("channel = 1 AND v < 1000").count() == 0 and back.where("channel <> 1 AND v >= 1000").count() == 0
    assert back.first().unit == "um"


def test_working_image_precedence(spark):
    px = stack(spark).where("cycle = 0")
    work = px.withColumn("v", px.v + 5000)
    count = lambda nd: catalog.with_working_image(px, work, spark.createDataFrame(
        [("s.tif", 1, nd)], "file string, reference_channel int, working_ndim int")).where("v >= 5000").count()
    assert (count(0), count(None), count(2), count(3)) == (0, 0, 100, 300)


def test_bead_csv_round_trip(spark, tmp_path):
    beads = spark.createDataFrame([(3, 4, 0, None, "(1, 2, 5, 6)")], "x bigint, y bigint, cy0 int, cy1 int, bbox string")
    rows = tables.bead_rows(beads, 2)
    path = tables.write_table(rows, str(tmp_path / "beads.csv"))
    back, boxes = tables.read_beads(spark, path, 2)
    assert tuple(back.first()) == (3, 4, 0, 255) and boxes.first().bbox == "(1, 2, 5, 6)"
    assert tables.write_table(rows, str(tmp_path / "beads.odd")).endswith("beads.odd.csv")
    parquet = tables.write_table(rows, str(tmp_path / "beads.parquet"))
    assert spark.read.parquet(parquet).count() == 1


def files(spark):
    return spark.createDataFrame(
        [("/d/c2.tif", 1, 4, 0, False, 3), ("/d/c1.tif", 1, 4, 0, True, None), ("/d/c3.tif", 1, 4, 1, False, 2), ("/d/bad.tif", 1, 2, 5, False, 0)],
        "path string, slide int, n_channels int, reference_channel int, is_reference boolean, working_ndim int")


def test_catalogue_rules(spark):
    f = files(spark)
    order = {r.path: r.cycle for r in catalog.cycle_order(f.unionAll(f)).collect()}
    assert order == {"/d/c1.tif": 0, "/d/bad.tif": 1, "/d/c2.tif": 2, "/d/c3.tif": 3}
    chosen = spark.createDataFrame([(1, "/d/c3.tif")], "slide int, path string")
    got = {r.path: r.status for r in catalog.set_reference(f, chosen).collect()}
    assert got == {"/d/c2.tif": "Aligned", "/d/c1.tif": "Raw", "/d/c3.tif": "Reference", "/d/bad.tif": "Raw"}
    known = f.withColumn("status", F.lit("Protein Generated"))
    got = {r.path: r.status for r in catalog.set_reference(known, chosen).collect()}
    assert got == {"/d/c2.tif": "Protein Generated", "/d/c1.tif": "Raw", "/d/c3.tif": "Reference", "/d/bad.tif": "Protein Generated"}
    good, bad = catalog.split_valid(f)
    assert good.count() == 3 and [r.path for r in bad.collect()] == ["/d/bad.tif"]
    with pytest.raises(Exception, match="out of range"):
        catalog.require_valid(f).collect()
    assert catalog.require_valid(good).count() == 3
    ranks = [(r.chan_rank, r.channel) for r in catalog.fluorescent_channels(f.where("path = '/d/c3.tif'")).collect()]
    assert ranks == [(0, 0), (1, 2), (2, 3)]
    same = lambda df: [r.all_same for r in catalog.same_metadata(df, ["n_channels", "reference_channel"]).collect()]
    assert same(f) == [False] and same(f.where("path IN ('/d/c1.tif', '/d/c2.tif')")) == [True] and same(f.where("false")) == [False]


def test_bead_tables_of_two_slides_keep_them_apart(spark, tmp_path):
    beads = spark.createDataFrame([("a", 3, 4, 0, "(1, 2, 5, 6)"), ("b", 3, 4, 1, "(0, 0, 5, 6)")], "slide string, x bigint, y bigint, cy0 int, bbox string")
    path = tables.write_table(tables.bead_rows(beads, 1, ["slide"]), str(tmp_path / "two.csv"))
    back, boxes = tables.read_beads(spark, path, 1, ["slide"])
    joined = back.join(boxes, ["slide", "x", "y"])
    assert {tuple(r) for r in joined.collect()} == {("a", 3, 4, 0, "(1, 2, 5, 6)"), ("b", 3, 4, 1, "(0, 0, 5, 6)")}
