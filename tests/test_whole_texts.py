"""Queries on rows that a cut of texts, languages or ids would lose."""

import random

from collections import Counter

import pytest

from folioframe import plans
from folioframe.functions import text as fn

from test_functions import edits


def tables(spark, path, **given):
    """A folder of tables as the queries read them: (rows, schema) by name."""
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = "doc_id long, text string, source string"
LONG = "the same long opening of plain words " * 6
TEXTS = [LONG + "ends here", LONG + "stops elsewhere", "élan naïf über " + LONG + "señor", "kurz"]
ITEMS = [LONG + "ends there", LONG]


def pairs(spark, path):
    given = tables(spark, path, documents=([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], DOCS), benchmark=(list(enumerate(ITEMS)), "item_id long, text string"))
    solid = lambda t: "".join(t.split())
    return given, [(solid(ITEMS[i % 2]), solid(t)) for i, t in enumerate(TEXTS)]


def test_error_rates_of_whole_texts(spark, tmp_path):
    path, want = pairs(spark, tmp_path)
    got = {r["source"]: r for r in plans.QUERIES["cer_micro_by_source"](spark, path).collect()}
    for source, mine in ((None, want), ("a", want[::2]), ("b", want[1::2])):
        chars = sum(len(r) for r, _ in mine)
        assert (got[source]["n"], got[source]["chars"]) == (len(mine), chars)
        assert got[source]["cer"] == pytest.approx(sum(edits(r, h) for r, h in mine) / chars, abs=1e-8)
    rates = {r["doc_id"]: r["cer"] for r in plans.QUERIES["cer_folded"](spark, path).collect()}
    assert rates == {i: pytest.approx(edits(r, h) / len(r), abs=1e-8) for i, (r, h) in enumerate(want)}


def test_character_bags_of_whole_texts(spark, tmp_path):
    path, want = pairs(spark, tmp_path)
    got = {r["doc_id"]: r for r in plans.QUERIES["char_bag"](spark, path).collect()}
    for i, (r, h) in enumerate(want):
        assert (got[i]["reference_chars"], got[i]["hypothesis_chars"], got[i]["overlap"]) == (len(r), len(h), (Counter(r) & Counter(h)).total())


def test_edit_distance_and_its_limit():
    rng = random.Random(3)
    for n in (0, 1, 5, 63, 64, 65, 200):
        a = "".join(rng.choice("abé語") for _ in range(n))
        b = "".join(rng.choice("abé語") if rng.random() < 0.3 else ch for ch in a if rng.random() > 0.1)
        want = edits(a, b)
        assert fn.edit_distance(a, b, 1000) == want
        assert all((fn.edit_distance(a, b, most) <= most) == (want <= most) for most in range(want + 3))


def halves():
    rng = random.Random(4)
    long, other = ("".join(rng.choice("abcdefgh") for _ in range(5000)) for _ in range(2))
    return {1: long + long[:4400] + "x" * 600, 2: long + long[:4200] + "x" * 800, 3: long + other, 4: "é" + long[:400] + "é" + long[:400], 5: "ab" * 20, 6: "ab" * 99, 7: "ab" * 100, 8: "", 9: None, 10: "\ufffd" + long[:150]}


def test_text_layers_of_any_length_and_language(spark, tmp_path):
    path = tables(spark, tmp_path, documents=([(i, t, "a") for i, t in halves().items()], DOCS))
    got = {r["doc_id"]: r["reasons"] for r in plans.QUERIES["text_layer_trust"](spark, path).collect()}
    twice, few = "duplicated_text_layer", "too_few_visible_chars"
    assert got == {1: twice, 2: "", 3: "", 4: twice, 5: "", 6: twice, 7: twice, 8: few, 9: few, 10: "bad_characters"}
    assert {r["reason"]: r["n"] for r in plans.QUERIES["untrusted_reasons"](spark, path).collect()} == {twice: 4, few: 2, "bad_characters": 1}


def test_repeated_halves_of_any_length_and_language(spark, tmp_path):
    path = tables(spark, tmp_path, documents=([(i, t, "a") for i, t in halves().items()], DOCS))
    got = {r["doc_id"]: r["repeated"] for r in plans.QUERIES["repeated_halves"](spark, path).collect()}
    assert got == {i: i in (1, 4, 7) for i in halves()}


ITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_tax double, l_returnflag string"
ORDERS = {1: [7, 8], 16: [3, 250_000, 5, 12_345_678_901, 9]}


def orders(spark, path):
    return tables(spark, path, lineitem=([(o, i, k, 0.08, "ANR"[i % 3]) for o, ks in ORDERS.items() for i, k in enumerate(ks, 1)], ITEM))


def forest(a, b):
    """Edits between two lists of trees, by the definition."""
    if not a or not b:
        return sum(1 + forest(t[1], []) for t in a + b)
    x, y = a[-1], b[-1]
    longest = max(len(x[2]), len(y[2]))
    change = 1 if x[0] != y[0] else edits(x[2], y[2]) / longest if longest else 0
    return min(forest(a[:-1] + x[1], b) + 1, forest(a, b[:-1] + y[1]) + 1, forest(a[:-1], b[:-1]) + forest(x[1], y[1]) + change)


def test_tables_of_all_orders(spark, tmp_path):
    path = orders(spark, tmp_path)
    got = {r["l_orderkey"]: r for r in plans.QUERIES["table_teds"](spark, path).collect()}
    assert sorted(got) == [1, 16] and all(r["same"] == 1 for r in got.values())
    cell = lambda t, wide=1: [f"td:{wide}:1", [], str(t)]
    whole = ["table", [["tr", [cell(i), cell(k)], ""] for i, k in enumerate(ORDERS[1], 1)], ""]
    short = ["table", [["tr", [cell(i, 2)], ""] for i in (1, 2)], ""]
    assert got[1]["changed"] == pytest.approx(1 - forest([whole], [short]) / 7, abs=1e-6)
    shapes = {r["l_orderkey"]: (r["rows"], r["cols"]) for r in plans.QUERIES["table_shapes"](spark, path).collect()}
    assert shapes == {o: (len(ks), 2) for o, ks in ORDERS.items()}


def test_all_rows_of_a_table(spark, tmp_path):
    got = {r["l_orderkey"]: r["size"] for r in plans.QUERIES["table_cells_html"](spark, orders(spark, tmp_path)).collect()}
    rows = lambda ks, n: sum(len(f'<tr><td>{i}</td><td colspan="2">{k}</td></tr>') for i, k in enumerate(ks[:n], 1))
    assert got[16] - got[1] == rows(ORDERS[16], 9) - rows(ORDERS[1], 9)


def test_lines_of_any_part_key(spark, tmp_path):
    got = plans.QUERIES["tesseract_lines"](spark, orders(spark, tmp_path)).collect()
    assert {(r["l_orderkey"], r["line"]): r["size"] for r in got} == {(1, 1): 1, (1, 2): 1, (16, 0): 1, (16, 1): 3, (16, 2): 3}


def test_whole_first_lines(spark, tmp_path):
    head = "Proceedings of the Society, volume"
    firsts = [head + " two"] * 4 + ["Proceedings of another kind altogether", "Proceedings that nobody has ever read", "Proceedings, the last", head + " twos", head + " one and a half"]
    path = tables(spark, tmp_path, documents=([(i, f"{t}\nbody {i}", "a") for i, t in enumerate(firsts)], DOCS))
    assert [tuple(r) for r in plans.QUERIES["common_edge_lines"](spark, path).collect()] == [("a", head + " two", 4, 4)]
    assert sorted(r["doc_id"] for r in plans.QUERIES["common_edge_lines_fuzzy"](spark, path).collect()) == [0, 1, 2, 3, 7]
