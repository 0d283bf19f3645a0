"""Notes, boxes, processors, files and recovered JSON against plain implementations and on bad input."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import chain, evaluation, middle, notes, pages, queue, render, trees
from folioframe.plans import sources as made
from folioframe.sources import office, tools


def test_note_entries():
    found = lambda t: [(e["marker"], e["body"]) for e in notes.entries_of(t)]
    assert found("<sup>3</sup> a <sup>4</sup>) b <sup>9</sup> c") == [("3", "a"), ("4", "b <sup>9</sup> c")]
    assert found("① a ② b ³ c") == [("①", "a"), ("②", "b ³ c")]
    assert found("¹⁰ ten ¹¹ eleven") == [("¹⁰", "ten"), ("¹¹", "eleven")]
    assert found("text <sup>1</sup> a") == found("") == found(None) == []
    assert found("<sup>1</sup><sup>2</sup> b") == [("2", "b")]


def test_suppressed_boxes(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(60):
        x, y = rng.random() * 50, rng.random() * 50
        boxes.append((0, "Text", i, rng.randrange(5) / 5, x, y, x + rng.random() * 30, y + rng.random() * 30))

    def iou(a, b):
        common = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return common / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - common)

    kept = []
    for box in sorted(boxes, key=lambda b: (-b[3], b[2])):
        if all(iou(box, k) <= 0.3 for k in kept):
            kept.append(box)
    df = spark.createDataFrame(boxes, "page long, kind string, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r["id"] for r in pages.suppressed(df, 0.3).collect()} == {b[2] for b in kept}
    assert pages.suppressed(df.where("false")).count() == 0


def test_concordance():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 40):
        a, b = ([rng.randrange(10) for _ in range(n)] for _ in range(2))
        sign = lambda x: (x > 0) - (x < 0)
        assert evaluation.concordance(a, b) == sum(sign(a[i] - a[j]) * sign(b[i] - b[j]) for i in range(n) for j in range(i))


def double(blocks):
    return {"blocks": blocks.unionByName(blocks)}


def test_processor_chain(spark):
    blocks = spark.range(3)
    now, ran = chain.run({"blocks": blocks}, [f"{__name__}.double", chain.Processor("off", double, "more", default=False), chain.Processor("lacks", lambda lines: {"blocks": lines})])
    assert (now["blocks"].count(), ran) == (6, ["double"])
    now, ran = chain.run({"blocks": blocks}, [chain.Processor("off", double, "more", default=False)], {"more": True})
    assert (now["blocks"].count(), ran) == (6, ["off"])


def test_option_conflict(spark):
    row = spark.range(1).select(middle.agreed(F.lit("a"), F.lit("b"), "margin").alias("x"))
    with pytest.raises(Exception, match="given twice"):
        row.collect()


def test_recovered_json():
    assert tools.mended_json('```json\n{"a": [1, 2,],}\n```') == '{"a":[1,2]}'
    assert tools.mended_json('so: {"b": "x}", "a": {"c": [1') == '{"a":{"c":[1]},"b":"x}"}'
    assert tools.mended_json('[1, "cut') == '[1,"cut"]'
    assert [tools.mended_json(t) for t in (None, "", "none", "{]}", '{"a" 1}')] == [None] * 5


def test_render_tree_form():
    leaf = '{"id":"a","block_type":"Text"}'
    assert [r["id"] for r in tools.tree_rows('{"id":"d","block_type":"Document","children":[%s]}' % leaf)] == ["d", "a"]
    for bad in ('{"block_type":"Text"}', '{"id":"d"}', '{"id":"d","block_type":"X","children":[%s,%s]}' % (leaf, leaf), '{"id":"d","block_type":"X","children":"no"}'):
        with pytest.raises(ValueError):
            tools.tree_rows(bad)


def test_office_files_that_cannot_be_read(spark):
    broken = made._zipped({"xl/workbook.xml": "<workbook"})
    unsafe = made._zipped({"../x": "", "word/document.xml": "<document><body/></document>"})
    files = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(broken)), ("c", bytearray(unsafe)), ("d", bytearray(made._xlsx(1, "Name", 2)))], "path string, content binary")
    cells = office.office_rows(files, office.read_xlsx, office.CELL)
    assert {r["doc"] for r in cells.collect()} == {"d"} and {r["doc"] for r in office.unreadable(files, cells).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        office.read_docx("c", unsafe)
    with pytest.raises(zipfile.BadZipFile):
        office.read_pptx("a", b"")
    assert office.place("AB12") == (11, 27)


def test_closure_in_levels(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y")], "id string, parent string")
    first, second = queue.descendants(edges, "a"), queue.descendants(edges, "y")  # two calls before either is read
    assert {(r["id"], r["depth"]) for r in first.collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert [r["id"] for r in second.collect()] == ["x"] and queue.descendants(edges, "none").count() == 0


def test_places_over_ranges(spark):
    rows = spark.range(0, 1000, 7).repartition(5)
    found = sorted((r["id"], r["place"]) for r in queue.numbered(rows, "id").collect())
    assert [p for _, p in found] == list(range(143))


def test_artifacts_and_records(spark, tmp_path):
    results = spark.createDataFrame([(1, "m", None), (2, "n", "h")], "id long, markdown string, html string")
    for _ in range(2):
        render.save_artifacts(render.artifacts(results, "id", ["markdown", "html"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    log = spark.createDataFrame([("a", "submitted", 1), ("b", "submitted", 1)], "source string, status string, at long")
    render.append_records(log, str(tmp_path / "log"))
    render.append_records(log.limit(1).withColumn("status", F.lit("completed")), str(tmp_path / "log"))
    got = {r["source"]: r["status"] for r in render.latest_records(spark.read.json(str(tmp_path / "log"))).collect()}
    assert got == {"a": "completed", "b": "submitted"}


def test_levels_below_a_removed_block(spark):
    rows = [("a", "r", 1, "x", False), ("b", "a", 1, "x", True), ("c", "b", 1, "x", False), ("d", "a", 2, "y", False)]
    blocks = spark.createDataFrame(rows, "id string, parent string, ord long, type string, removed boolean")
    assert [r["id"] for r in trees.contained(blocks, "r", ["x", "y"]).orderBy("path").collect()] == ["a", "d"]
