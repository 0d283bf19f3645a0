"""Larger keys and larger groups than the smallest tables have."""

import random
import re

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
from test_queries import SF, rows

from folioframe import plans
from folioframe.operators import annotations, furniture, layout, reflow, render, rich_markdown
from folioframe.operators.folds import folded
from folioframe.plans import base


def moved(path, name, **shifts):
    """The smallest table with its keys moved up, in a folder of its own."""
    table = duckdb.sql(f"SELECT * REPLACE ({', '.join(f'{c} + {n} AS {c}' for c, n in shifts.items())}) FROM '{SF}/{name}.parquet'").to_arrow_table()
    pq.write_table(table, path / f"{name}.parquet", coerce_timestamps="us")


def held(spark, path, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return rows(plans.QUERIES[name](spark, str(path)).toPandas()), rows(con.execute(plans.ORACLES[name]).df())


def test_running_heads_of_large_order_keys(spark, tmp_path):
    moved(tmp_path, "orders", o_orderkey=1_234_567)
    got, want = held(spark, tmp_path, "recorded_annotations", "orders")
    assert got == want and got


def test_note_numbers_of_large_supplier_keys(spark, tmp_path):
    moved(tmp_path, "lineitem", l_suppkey=1_234_567)
    got, want = held(spark, tmp_path, "note_heads", "lineitem")
    assert got == want and got


@pytest.mark.parametrize("name", ["judged_decisions", "applied_decisions", "nearest_numbers", "nearest_anchor", "repair_proposals", "selected_folios", "span_order"])
def test_no_frame_from_a_row_to_the_end(spark, name):
    """Such a frame is read anew for every row of its group, so its work is the square of the group's size."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowframe" in plan
    assert not re.search(r"rowframe, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan)


@pytest.mark.parametrize("name", ["margin_ladders", "locator_spans"])
def test_small_groups_share_a_call(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_folded_groups_are_whole(spark):
    """Groups of one row, of more than a batch, and without a key each come once and in order."""
    sizes = {None: 5, 1: 1, 2: 25_000, 3: 1, 4: 10_000}
    df = spark.createDataFrame([(k, i * 7919 % n) for k, n in sizes.items() for i in range(n)], "k long, i long")

    def fold(rows, bounds):
        parts = [rows.iloc[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pd.DataFrame({"k": pd.array([p["k"].iloc[0] if pd.notna(p["k"].iloc[0]) else None for p in parts], dtype="Int64"), "n": [len(p) for p in parts], "sorted": [bool(p["i"].is_monotonic_increasing) for p in parts]})

    got = folded(df, ["k"], ["i"], fold, "k long, n long, sorted boolean").collect()
    assert len(got) == len(sizes) and {r["k"]: r["n"] for r in got} == sizes and all(r["sorted"] for r in got)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_sorted_once_a_round(spark):
    """Each sort of all spans stands in the same task, so a task's memory is that of all of them."""
    spans = spark.createDataFrame([(0, 0, 0, "x", 1.0, False)], "page int, block int, ord int, text string, size double, small boolean")
    plan = plan_of(annotations.small_runs(spans.repartition(2, "page")))
    assert plan.count("Window [") >= 6
    assert len(re.findall(r"\bSort \[", plan)) == 3 and "Join" not in plan


def test_small_runs_without_a_page_or_a_size(spark):
    """Spans without a page have no main size; spans of one place stand by their text, as in the SQL."""
    rows = [(None, 0, i, "aa", 2.0 if i == 1 else 9.0, False) for i in range(4)] + [(1, 0, i, "aa", None, False) for i in range(3)]
    rows += [(2, 0, 0, "zz", 2.0, False), (2, 0, 0, "aa", 9.0, False), (2, 0, 0, "bb", 9.0, False), (2, 0, 1, "yy", 2.0, False)]
    got = annotations.small_runs(spark.createDataFrame(rows, "page int, block int, ord int, text string, size double, small boolean")).collect()
    assert [(r["page"], r["first"], r["last"], r["text"]) for r in got] == [(2, 0, 1, "zz yy")]


@pytest.mark.parametrize("name", ["small_runs", "inline_annotations"])
def test_more_rows_are_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(base, "TASK_ROWS", 250)
    assert re.search(r"hashpartitioning\(page#\d+L?, 24\), REPARTITION_BY_NUM", plan_of(plans.QUERIES[name](spark, SF)))


def test_split_rows_are_read_in_one_order(spark):
    """Cells are joined with nothing, also where a row has one cell, unequal lines, or no number."""
    cells = [("t", 1, 0, ["a", "b"]), ("t", 1, 1, ["c", "d"]), ("t", 2, 0, ["e"]), ("t", 2, 1, ["f", "g"]), ("t", 3, 0, ["h", "i"]), ("t", 3, 1, ["j", "k"]), ("t", None, 0, ["x"]), ("u", 1, 0, ["l", "m"]), (None, 1, 0, ["y"])]
    out = furniture.split_combined_rows(spark.createDataFrame(cells, "tab string, row int, col int, lines array<string>"), "tab")
    assert sorted(map(tuple, out.collect())) == [("t", 1, 0, "a"), ("t", 1, 1, "c"), ("t", 2, 0, "b"), ("t", 2, 1, "d"), ("t", 3, 0, "e"), ("t", 3, 1, "f g"), ("t", 4, 0, "h"), ("t", 4, 1, "j"), ("t", 5, 0, "i"), ("t", 5, 1, "k"), ("u", 1, 0, "l m")]
    assert "Join" not in plan_of(out) and plan_of(plans.QUERIES["split_rows"](spark, SF)).count("Exchange") == 1


def test_marks_beside_the_nearest_are_not_paired(spark):
    """Against all pairs, with ties, marks and parts without a height, and pages of only one of both."""
    rng = random.Random(3)
    parts = [(p, f"{p}-{i}", (float(i), p), rng.choice([None, *range(6)]), rng.choice(["Text", "Table", "PageFooter"])) for p in range(5) for i in range(rng.randrange(9) if p else 0)]
    marks = [(p, i, 0.0, rng.choice([None, *(n / 2 for n in range(-1, 14))])) for p in range(6) for i in range(12)]
    body = spark.createDataFrame([(p, b, at, None if cy is None else float(cy), t) for p, b, at, cy, t in parts], "page int, block string, at struct<ord double, line int>, cy double, type string")
    got = reflow.beside_nearest(spark.createDataFrame(marks, "page int, id int, cx double, cy double"), body, lambda rows, *by: rows.repartition(3, *by))
    assert "Join" not in plan_of(got)
    want = {}
    for page, i, _, cy in marks:
        own = [x for x in parts if x[0] == page and x[4] != "PageFooter"]
        high = [x for x in own if x[3] is not None and cy is not None] or own
        want[page, i] = min(((abs(x[3] - cy) if x[3] is not None and cy is not None else 0, x[2], x[1]) for x in high), default=(0, 0, None))[2]
    assert {(r["page"], r["id"]): r["n"] and r["n"]["block"] for r in got.collect()} == want


def test_nearest_anchors_of_many_points(spark):
    """Against all pairs: clusters and far points, points of one place, ties, groups without anchors, and parts that are null, NaN or infinite."""
    rng = random.Random(7)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    place = lambda: (rng.choice(odd), rng.random()) if rng.random() < 0.02 else (rng.gauss(0, 1), rng.gauss(0, 1)) if rng.random() < 0.6 else (float(rng.randrange(8)), float(rng.randrange(8))) if rng.random() < 0.9 else (rng.random() * 500, 3.0)
    points = [(i, rng.choice([0, 0, 0, 1, None]), *place()) for i in range(1500)] + [(i, 2, *place()) for i in range(1500, 1520)] + [(i, 3, 1.0, 2.0) for i in range(1520, 1530)]
    marks = [(g, i, x, y) for i, g, x, y in points if i % 4 == 0 and g in (0, 1)] + [(3, 9, None, 1.0), (3, 8, float("nan"), 1.0)]
    got = layout.nearest_anchor(spark.createDataFrame(points, "id long, label int, x double, y double"), spark.createDataFrame(marks, "label int, anchor long, ax double, ay double"), "label")
    con = duckdb.connect()
    p, m = pd.DataFrame(points, columns=["id", "label", "x", "y"]), pd.DataFrame(marks, columns=["label", "anchor", "ax", "ay"])
    values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'::DOUBLE" for v in r) + ")" for r in rows)
    want = con.execute(f"WITH p(id, label, x, y) AS (VALUES {values(points)}), m(label, anchor, ax, ay) AS (VALUES {values(marks)}) SELECT id::BIGINT, anchor::BIGINT FROM (SELECT id, anchor, row_number() OVER (PARTITION BY id ORDER BY (x - ax) * (x - ax) + (y - ay) * (y - ay), anchor) AS r FROM p JOIN m USING (label)) WHERE r = 1").fetchall()
    assert len(p) > len(want) > len(m) and sorted(map(tuple, got.collect())) == sorted(want)


def test_whole_texts_are_composed_before_lines(spark):
    """One call of Python a document and not a line; marks do not compose over a line's end."""
    docs = spark.createDataFrame([(0, "café au\ńlait\nᄀ\nᅡ e​́x-\nyz"), (1, None), (2, " \n")], "d int, t string")
    out = render.text_layer_markdown(docs, "d", "t")
    assert [tuple(r) for r in out.collect()] == [(0, "café au\ńlait\nᄀ\nᅡ éx-\nyz", True)]
    plan = plan_of(out)
    assert plan.index("Generate") < plan.index("ArrowEvalPython")


def test_markdown_of_pages_leaves_part_by_part():
    """A batch of more signs than a part has comes out in several parts, each page once and in order."""
    pages = pd.Series([f"<p>{i} x</p><script>{'x' * 400_000}</script>" for i in range(6)] + [None])
    parts = list(rich_markdown.rich_markdown.func(iter([pages])))
    assert len(parts) > 1 and [t.split(" ")[0] for p in parts for t in p] == ["0", "1", "2", "3", "4", "5", ""]
