"""Mixing, hard negatives and the manifest against brute force, and on the cases that must not crash."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import common, hard_negatives, manifest, mixing, topk
from folioframe.llm.queries import LEAF

# mixing

MIX = "doc_id long, source string, text string, size int, copies string, at int, h int, c0 int, want int, number int, target int"


def documents(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x", 2, 3, 4, 5, 6, 7) for i, s, t in rows], MIX)


def length(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, share, limit):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(limit * sizes[s] for s in capped)
        heavy = sum(weight[s] for s in names if s not in capped)
        out = {s: limit * sizes[s] if s in capped else left * weight[s] / heavy for s in names}
        above = {s for s in names if out[s] > limit * sizes[s] and s not in capped}
        if not above:
            return out
        capped |= above


def mixed(spark, rows, **more):
    got = mixing.mix_sources(documents(spark, rows), [3, 1, 2], **more)
    assert set(got.columns) == {"doc_id", "source", "text", "size", "copies", "at", "h", "c0", "want", "number", "target", "source_size"}
    return got.collect()


def check_mix(rows, got, limit=2):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += length(t)
        largest[s] = max(largest[s], length(t))
    want = brute_targets(sizes, [3, 1, 2], 1.5, limit)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["size"] == length(r["text"]) and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= limit and r["c0"] == 4
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return taken, want


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "z", None]), " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60)))) for i in range(900)]
    rows += [(1000, "a", "x " * 20_000), (1001, "only empty", ""), (1002, "only empty", None), (1003, "", "one"), (1004, "b", " \t\n\x0b\x0c\r "), (1005, "b", "no break line")]
    got = mixed(spark, rows)
    check_mix(rows, got)
    again = mixed(spark, rows[::-1])
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mix_of_copies_and_null_ids(spark):
    rows = [(None, "a", "one two three")] * 400 + [(7, "b", "four five")] * 300 + [(i, "c", "six " * i) for i in range(40)] + [(7, "b", "other")] * 2
    got = mixed(spark, rows)
    taken, want = check_mix(rows, got)
    assert 0 < sum(r["copies"] for r in got if r["source"] == "b") < 604  # the group of copies is cut
    again = mixed(spark, rows)
    assert sorted((r["text"], r["copies"]) for r in got) == sorted((r["text"], r["copies"]) for r in again)


def test_mix_takes_more_for_larger_budgets(spark):
    rows = [(i, "abc"[i % 3], "w " * (1 + i * 7 % 31)) for i in range(300)]
    less, more = ({r["doc_id"]: r["copies"] for r in mixing.mix_sources(documents(spark, rows), [1], share=s).collect()} for s in (0.4, 0.9))
    assert all(less[i] <= more[i] for i in less) and sum(less.values()) < sum(more.values())


def test_mix_of_few_or_no_rows(spark):
    assert mixed(spark, []) == []
    assert [(r["copies"], r["target"]) for r in mixed(spark, [(1, "a", "w")])] in ([(1, 1.5)], [(2, 1.5)])
    assert [(r["copies"], r["target"]) for r in mixed(spark, [(1, None, None)])] == [(0, 0.0)]


def test_mix_with_figures_shuffled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    rows = [(i, ["a", None, "b"][i % 3], "w " * (1 + i * 7 % 31)) for i in range(300)]
    check_mix(rows, mixed(spark, rows))


# hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row string, d string, v string, asks string, ab string, cb string"


def floors(vector):
    return [(256 * Fraction(x)).__floor__() for x in vector]


def brute_negatives(rows, positives=5, negatives=10):
    good = {(i, lab, tuple(floors(v))) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for anchor in good:
        if anchor[0] % 100:
            continue
        others = sorted((-clip(sum(a * b for a, b in zip(anchor[2], o[2], strict=True))), o[0], o[1]) for o in good if o != anchor and len(o[2]) == len(anchor[2]))
        for ps, p, _ in [o for o in others if o[2] == anchor[1]][:positives]:
            fit = [(n, -s) for s, n, lab in others if lab != anchor[1] and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(anchor[0], p, k + 1, n, -ps, s) for k, (n, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, *["x"] * 6) for i, v, lab in rows], VECTORS)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def made_vectors(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dims))
    return [(i, (centre[i % 5] * rng.uniform(0.2, 1) + rng.normal(size=dims) * 0.3).tolist(), int((i + (i % 9 == 0)) % 5)) for i in range(n)]


def test_negatives(spark):
    rows = made_vectors(800)
    rows += [(900, [0.5] * 16, 1)] * 3 + [(901 + i, [0.5] * 16, 1 + i % 2) for i in range(60)]  # repeated rows and ties
    rows += [(None, [0.1] * 16, 1), (1000, None, 2), (1100, [0.2] * 16, None), (1200, [None] + [0.1] * 15, 1), (1300, [float("nan")] * 16, 1), (1301, [float("inf")] * 16, 1), (1400, [0.3] * 5, 1), (1401, [0.3] * 5, 1), (1402, [0.2] * 5, 2), (1500, [], 1)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 200


def test_negatives_in_blocks(spark, monkeypatch):
    rows = made_vectors(600, seed=4)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 70)
    monkeypatch.setattr(hard_negatives, "BATCH", 1)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_large_components(spark):
    rows = made_vectors(120, dims=3, seed=2)
    rows += [(200, [1e12, -1e9, 0.5], 1), (201, [3e11, 2.0, 1.0], 1), (202, [1e11, 1.0, 0.0], 2), (203, [1e200, 0.0, 0.0], 1), (300, [3e18, 0.0, 0.0], 1), (204, [-5e300, 7.0, 1.0], 3), (400, [1e-3, 0.0, 2.0], 3)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, made_vectors(1)) == []


def test_planes_drop_pairs_and_keep_scores():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-120, 120, (40, 64)), rng.integers(-120, 120, (3000, 64))
    seen = []

    def settle(low, high, open_):
        exact = q @ c.T
        assert (low <= exact).all() and (exact <= high).all()
        out = hard_negatives.highest(5)(low, high, open_)
        seen.append(int(out.sum()))
        return out

    a, b, s = hard_negatives.bit_sliced(q, hard_negatives.Planes(c), np.ones((40, 3000), bool), settle)
    assert (s == (q @ c.T)[a, b]).all() and seen == sorted(seen, reverse=True) and len(a) < 40 * 3000 / 8 and len(seen) < 8
    best = hard_negatives._best(a, b, s, 5)
    for i in range(40):
        assert sorted(s[best][a[best] == i])[::-1] == sorted((q @ c.T)[i])[::-1][:5]


def test_top_k_of_large_components(spark):
    rows = made_vectors(120, dims=3, seed=2) + [(150, [1e12, -1e9, 0.5], 1), (201, [3e11, 2.0, 1.0], 1), (202, [1e200, 1.0, 0.0], 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).collect()
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = {i: floors(v) for i, v, _ in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        order = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[o], strict=True))), o) for o in whole if o != q)[:5]
        want += [(q, k + 1, o, -s) for k, (s, o) in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_exact_products_saturate():
    a = common.integers(np.array([[2.0**70, 1.0], [3.0, 4.0]]))
    assert common.exact_products(a, a).tolist() == [[(1 << 63) - 1] * 2, [(1 << 63) - 1, 25]]


# manifest

ROWS = "doc_id long, source string, lang string, n_chars long, text string, g string, i int, digest string, proof string, id int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root and for each leaf the levels' runs with its place."""
    tree = [leaves]
    while len(tree[-1]) > 1:
        tree.append([digest(*tree[-1][k : k + 8]) for k in range(0, len(tree[-1]), 8)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for nodes in tree[:-1]:
            path.append((nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8))
            at //= 8
        paths.append(path)
    return tree[-1][0], paths


def brute_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_lang = defaultdict(list)
    for r in rows:
        own = digest(*map(one, r))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, own, digest(*map(one, (*r[:4], lower))) if odd else own, r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([y[2] for y in sorted(by_lang[x])]) for x in langs}
    root, over = brute_tree([trees[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for (_, _, own, claimed, ident), path in zip(sorted(by_lang[x]), trees[x][1], strict=True):
            whole, at = "", claimed
            for run, place in path + over[k]:
                whole += "".join(run[:place] + run[place + 1 :])
                at = digest(*run[:place], at, *run[place + 1 :])
            out.append((ident, own, trees[x][0], root, digest(whole), at, at == root))
    return sorted(out, key=repr)


def proven(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], ROWS)
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    claimed = manifest.leaf_digest(*(lowered if c == "text" else F.col(c) for c in LEAF))
    return manifest.merkle_manifest(df, LEAF, claimed=claimed, keep=["lang", "g", "i", "proof", "doc_id", "id"], **more)


def made_rows(n, langs):
    rng = random.Random(n)
    return [(i * 7 % 1009, "s", langs[i % len(langs)], i, rng.choice(["Some Text", "plain", "É", ""]) + str(i)) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, levels):
    rows = made_rows(700, ["en", "en", "en", "fr", "", "é", None]) + made_rows(1, ["lone"])
    rows += [(None, None, None, None, None), (5, "s", None, None, None), (6, "s", "en", 1, ""), (7, "s", "en", 1, "Long " * 40_000)]
    rows += [(8, "s", "en", 1, "Same")] * 70 + [(8, "s", "en", 1, "Other"), (-5, "s", "en", 1, "Below")]
    got = proven(spark, rows, levels=levels).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest(r["proof"]), r["folded_root"], r["verified"]) for r in got), key=repr) == brute_manifest(rows)
    assert {r["verified"] for r in got} == {True, False} and all(r["g"] == "x" and r["id"] == 2 for r in got)
    r = next(r for r in got if r["verified"] and len(r["places"]) > 2)
    assert manifest.fold(r["leaf"], r["proof"], r["places"], r["lengths"]) == r["root"] and len(r["proof"]) == 64 * (sum(r["lengths"]) - len(r["places"]))
    assert manifest.fold(digest("another"), r["proof"], r["places"], r["lengths"]) != r["root"]


def test_manifest_with_many_groups(spark):
    rows = made_rows(300, [f"l{k}" for k in range(90)])
    got = proven(spark, rows, levels=1).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest(r["proof"]), r["folded_root"], r["verified"]) for r in got), key=repr) == brute_manifest(rows)


def test_manifest_of_few_or_no_rows(spark):
    assert proven(spark, []).collect() == []
    (r,) = proven(spark, [(1, "s", "en", 1, "plain")]).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof"] == "" and r["verified"]


# columns of any name, and rows without ids


def test_columns_that_clash(spark):
    from folioframe.llm import sharding, url_filter
    from folioframe.llm.queries import RULES

    names = "_key string, _id int, _size int, _start string, _bin int, _rank int, c0 string, shard string"
    df = spark.createDataFrame([(i, f"text {i % 5}", "k", 1, 2, "s", 3, 4, "c", "old") for i in range(60)] + [(None, None, "k", 1, 2, "s", 3, 4, "c", "old")] * 2, f"doc_id long, text string, {names}")
    got = sharding.shard_by_bytes(df, shards=4).collect()
    assert len(got) == 62 and all((r["_key"], r["_id"], r["_size"], r["_start"], r["_bin"], r["_rank"], r["c0"]) == ("k", 1, 2, "s", 3, 4, "c") and 0 <= r["shard"] < 4 for r in got)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "mine", 5, "old"), (2, None, "mine", 5, "old")], "page_id long, url string, _found string, found int, verdict string")
    judged = {r["page_id"]: (r["_found"], r["found"], r["verdict"], r["rule"]) for r in url_filter.judge_urls(pages, RULES).collect()}
    assert judged == {1: ("mine", 5, "block", "com/en/"), 2: ("mine", 5, "allow", None)}
    assert url_filter.judge_urls(pages.where("false"), RULES).count() == 0


def test_repeats_of_rows_without_ids(spark):
    from folioframe.llm import substring_dedup

    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage = text(70)
    alone = [text(60) for _ in range(40)]
    mixed = [text(30) + " " + passage + " " + text(30) for _ in range(3)]
    rows = [(None, t) for t in alone + mixed] + [(7, mixed[0])] * 30  # repeated rows of one id whose passage others share
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed"] == 0 for r in got if r["text"] in alone)
    assert all(r["n_removed"] == r["n_bytes"] for r in got if r["text"] == mixed[0]) and sum(r["text"] == mixed[0] for r in got) == 31
    assert all(len(passage) <= r["n_removed"] < r["n_bytes"] and r["n_spans"] == 1 for r in got if r["text"] in mixed[1:])
