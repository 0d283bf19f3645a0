"""Scores of recognised text, order, layout and tables against a reference."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per character of the reference; null for an empty one."""
    return fn.edits(reference, hypothesis) / F.nullif(F.length(reference), F.lit(0))


#: The least signs of a text layer, and the shares of unseen and of bad ones and the likeness of halves from which it is not trusted.
LEAST_SIGNS, MOST_UNSEEN, MOST_BAD, TWICE = 30, 0.05, 0.005, 0.85


def layer_verdicts(pages: DataFrame, embedded: bool = False) -> DataFrame:
    """pages (text: all of a page's layer; unseen: how many of its signs are invisible) with kind, trusted, reasons, visible, unseen_share and bad_share.

    Bad signs are controls, surrogates, private and unassigned ones and the replacement sign. A layer that is all unseen is what a
    scanner has read: with `embedded` it may serve, as a reference of that kind, but never one that is both.
    """
    solid = fn.without(fn.text_of(F.col("text")), r"\s+")
    total, unseen = F.length(fn.text_of(F.col("text"))), F.coalesce("unseen", F.lit(0))
    seen = F.greatest(total - unseen, F.lit(0)) if embedded else total
    share = F.when(seen + unseen > 0, unseen / (seen + unseen)).otherwise(0.0)
    bad = fn.count_of(F.col("text"), r"\ufffd|(?![\t\n\r])\p{Cc}|\p{Co}|\p{Cs}|\p{Cn}")
    rows = pages.withColumns({"_solid": solid, "visible": seen, "unseen_share": share, "bad_share": F.when(total > 0, bad / total).otherwise(0.0)})
    rows = rows.withColumn("_twice", (F.length("_solid") >= 2 * LEAST_SIGNS) & F.coalesce(fn.halves_alike("_solid"), F.lit(False)))
    hidden = F.col("unseen_share") > MOST_UNSEEN
    whole = hidden & (1 - F.col("unseen_share") <= MOST_UNSEEN)
    kind = F.when(whole, "embedded_ocr_layer").otherwise("visible_text_layer") if embedded else F.lit("visible_text_layer")
    why = F.when(hidden & ~whole, "mixed_visible_and_invisible_layers") if embedded else F.when(hidden, "invisible_text_layer")
    reasons = F.array(F.when(F.length("_solid") < LEAST_SIGNS, "too_few_visible_chars"), why, F.when(F.col("bad_share") > MOST_BAD, "bad_characters"), F.when(F.col("_twice"), "duplicated_text_layer"))
    rows = rows.withColumns({"kind": kind, "reasons": F.filter(reasons, lambda r: r.isNotNull())})
    return rows.withColumn("trusted", F.size("reasons") == 0).drop("_solid", "_twice")


def micro_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Edits over characters: for all rows, and by each group. scored: edits, chars."""
    grouped = scored.groupingSets([[], [F.col(c) for c in by]], *by) if by else scored.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), (F.sum("edits") / F.nullif(F.sum("chars"), F.lit(0))).alias("cer"))


def character_bags(pairs: DataFrame, ident: str, reference: str, hypothesis: str) -> DataFrame:
    """Overlap of the two texts' characters whatever their order: counts, recall, precision, f1."""

    def counted(side: str, name: str) -> DataFrame:
        signs = pairs.select(ident, F.explode(F.split(side, "")).alias("ch"))
        return signs.groupBy(ident, "ch").agg(F.count("*").alias(name))

    both = counted(reference, "r").join(counted(hypothesis, "h"), [ident, "ch"], "full").na.fill(0, ["r", "h"])
    sums = both.groupBy(ident).agg(F.sum("r").alias("reference_chars"), F.sum("h").alias("hypothesis_chars"), F.sum(F.least("r", "h")).alias("overlap"))
    recall, precision = (F.col("overlap") / F.nullif(F.col(c), F.lit(0)) for c in ("reference_chars", "hypothesis_chars"))
    return sums.withColumns({"recall": recall, "precision": precision}).withColumn("f1", 2 * F.col("recall") * F.col("precision") / F.nullif(F.col("recall") + F.col("precision"), F.lit(0.0)))


def concordance(a: list, b: list) -> int:
    """Pairs that two rankings order alike less pairs that they order the other way round; ties count for neither.

    Counted with a binary indexed tree over the second ranking, group by group of equals in the first.
    """
    rank = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    tree, size = [0] * (len(rank) + 1), len(rank)

    def upto(i: int) -> int:
        n = 0
        while i:
            n += tree[i]
            i &= i - 1
        return n

    score, order, at = 0, sorted(range(len(a)), key=lambda i: a[i]), 0
    while at < len(order):
        end = at
        while end < len(order) and a[order[end]] == a[order[at]]:
            r = rank[b[order[end]]]
            score += upto(r - 1) - (at - upto(r))
            end += 1
        for i in order[at:end]:
            r = rank[b[i]]
            while r <= size:
                tree[r] += 1
                r += r & -r
        at = end
    return score


def kendall_tau(ranks: DataFrame, by: str, a: str, b: str, ident: str) -> DataFrame:
    """Tau-a of two rankings by group; ties lower it, groups of under two are null. n log n steps a group; no pairs are made."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        tau = concordance(rows[a].tolist(), rows[b].tolist()) / (n * (n - 1) / 2) if n > 1 else None
        return pd.DataFrame({by: [rows[by].iloc[0]], "n": [n], "tau": pd.array([tau], dtype="Float64")})

    return ranks.select(by, a, b).groupBy(by).applyInPandas(fold, f"{by} {ranks.schema[by].dataType.simpleString()}, n long, tau double")


def successor_accuracy(items: DataFrame, by: str, a: str, b: str, ident: str) -> DataFrame:
    """The share of neighbours in order `a` that are neighbours in order `b` too."""
    nxt = lambda c: F.lead(ident).over(Window.partitionBy(by).orderBy(c, ident))
    seen = items.select(by, nxt(a).alias("na"), nxt(b).alias("nb")).where("na is not null or nb is not null")
    return seen.groupBy(by).agg((F.count_if(F.col("na") == F.col("nb")) / F.nullif(F.count("na"), F.lit(0))).alias("accuracy"))


@F.pandas_udf(T.DoubleType())
def order_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edits between two id sequences per id of the reference; null for an empty one."""
    return pd.Series([None if not len(a) else fn.sequence_distance(list(a), list(b)) / len(a) for a, b in zip(reference, hypothesis, strict=True)], dtype="float64")


def pair_agreement(rows: DataFrame, by: str, truth: str, predicted: str) -> DataFrame:
    """Pairs of rows that share a block in truth, in prediction and in both, from group sizes.

    A row without a predicted block is a block of its own.
    """
    pairs = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    cells = rows.groupBy(by, truth, predicted).agg(F.count("*").alias("n"))
    own = F.col(predicted).isNotNull()
    t = cells.groupBy(by, truth).agg(F.sum("n").alias("n")).groupBy(by).agg(pairs(F.col("n")).alias("truth_pairs"))
    p = cells.where(own).groupBy(by, predicted).agg(F.sum("n").alias("n")).groupBy(by).agg(pairs(F.col("n")).alias("predicted_pairs"))
    both = cells.where(own).groupBy(by).agg(pairs(F.col("n")).alias("both_pairs"))
    out = t.join(p, by, "left").join(both, by, "left").na.fill(0)
    precision, recall = F.col("both_pairs") / F.nullif("predicted_pairs", F.lit(0)), F.col("both_pairs") / F.nullif("truth_pairs", F.lit(0))
    f1 = F.when((precision == 0) | (recall == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return out.withColumns({"precision": precision, "recall": recall, "f1": f1})


class _Table(HTMLParser):
    """The tags of a table as a tree of (label, children)."""

    KEPT = {"table", "thead", "tbody", "tr", "td", "th"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: list = ["root", [], ""]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in self.KEPT:
            given = dict(attrs)
            label = f"{tag}:{given.get('colspan', 1)}:{given.get('rowspan', 1)}" if tag in ("td", "th") else tag
            node = [label, [], ""]
            self.path[-1][1].append(node)
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in self.KEPT and any(n[0].split(":")[0] == tag for n in self.path[1:]):
            while self.path[-1][0].split(":")[0] != tag:
                self.path.pop()
            self.path.pop()

    def handle_data(self, data):
        self.path[-1][2] += data


def parse_table(html: str | None) -> list:
    parser = _Table()
    parser.feed(html or "")
    return parser.root


#: How many markups a worker remembers, and of what length at most.
MARKUPS, MARKUP_SIGNS = 512, 8192
_TEXTS = re.compile(r"(?<=>)([^<>&]+)(?=<)")


@functools.lru_cache(MARKUPS)
def _marked(markup: str, count: int) -> list | None:
    """The tree of a markup whose texts are their numbers, each node's text as a list of these; None where one is not in its place."""
    seen: list[int] = []

    def numbered(node: list) -> bool:
        marks = node[2].split(",")[:-1]
        if node[2] != "".join(f"{m}," for m in marks) or not all(m.isdecimal() for m in marks):
            return False
        node[2] = [int(m) for m in marks]
        seen.extend(node[2])
        return all(numbered(child) for child in node[1])

    tree = parse_table(markup)
    return tree if numbered(tree) and sorted(seen) == list(range(count)) else None


def _skeleton(html: str | None) -> tuple[str, list[str]] | None:
    """A table's markup with numbers for its texts, and these texts: tables of one markup are parsed once.

    None where the texts may take part in the parse, as entities and stray signs do, and for long markup.
    """
    if not html or "&" in html or html[0] != "<" or html[-1] != ">":
        return None
    parts = _TEXTS.split(html)
    texts = parts[1::2]
    parts[1::2] = map("{},".format, range(len(texts)))
    markup = "".join(parts)
    return (markup, texts) if len(markup) <= MARKUP_SIGNS and _marked(markup, len(texts)) is not None else None


Ordered = tuple[tuple[str, ...], tuple[int, ...], list]


def _postorder(tree: list) -> Ordered:
    """Labels in postorder, each one's leftmost leaf, and each one's text."""
    labels: list[str] = []
    leftmost: list[int] = []
    texts: list = []

    def visit(node: list) -> int:
        first = None
        for child in node[1]:
            at = visit(child)
            first = at if first is None else first
        labels.append(node[0])
        texts.append(node[2])
        leftmost.append(len(labels) - 1 if first is None else first)
        return leftmost[-1]

    visit(tree)
    return tuple(labels), tuple(leftmost), texts


@functools.lru_cache(MARKUPS)
def _marked_postorder(markup: str, count: int) -> Ordered:
    return _postorder(_marked(markup, count))


def _ordered(html: str | None) -> Ordered:
    """_postorder of a table, the white space of its texts squeezed."""
    known = _skeleton(html)
    if known is None:
        labels, leftmost, found = _postorder(parse_table(html))
        return labels, leftmost, [" ".join(t.split()) for t in found]
    markup, texts = known
    labels, leftmost, marks = _marked_postorder(markup, len(texts))
    return labels, leftmost, [" ".join("".join([texts[i] for i in m]).split()) if m else "" for m in marks]


def _tree_distance(ma: tuple[int, ...], mb: tuple[int, ...], change: list[list], least: Callable) -> float | np.ndarray:
    """Edit distance of ordered trees by leftmost leaves and costs of changes; the costs may be arrays, one place for each pair of trees of these forms."""
    keys = lambda m: sorted({x: i for i, x in enumerate(m)}.values())
    whole: list[list] = [[0.0] * len(mb) for _ in ma]
    for i in keys(ma):
        for j in keys(mb):
            oi, oj = ma[i], mb[j]
            part: list[list] = [[float(c) for c in range(j - oj + 2)]]
            for x in range(oi, i + 1):
                r, above = x - oi + 1, part[-1]
                row: list = [float(r)]
                for y in range(oj, j + 1):
                    c = y - oj + 1
                    if ma[x] == oi and mb[y] == oj:
                        row.append(least(least(above[c], row[c - 1]) + 1, above[c - 1] + change[x][y]))
                        whole[x][y] = row[c]
                    else:
                        row.append(least(least(above[c], row[c - 1]) + 1, part[ma[x] - oi][mb[y] - oj] + whole[x][y]))
                part.append(row)
    return whole[-1][-1]


def table_similarities(a: list[str | None], b: list[str | None]) -> list[float]:
    """1 minus the tree distance over the larger tree's size, pair by pair; a cell's change costs its texts' relative edit distance.

    Pairs of the same two forms are measured side by side.
    """
    out = [1.0] * len(a)
    forms: dict[tuple, list[tuple[int, list[str], list[str]]]] = {}
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        if x != y:
            (la, ma, ta), (lb, mb, tb) = _ordered(x), _ordered(y)
            forms.setdefault((la, ma, lb, mb), []).append((n, ta, tb))
    for (la, ma, lb, mb), pairs in forms.items():
        most = max(len(la), len(lb)) - 1
        if not most:
            continue
        side = len(pairs) > 4
        change: list[list] = [[1.0] * len(lb) for _ in la]
        for i, x in enumerate(la):
            for j, y in enumerate(lb):
                if x == y:
                    costs = [0.0 if ta[i] == tb[j] else fn.edit_distance(ta[i], tb[j], len(ta[i]) + len(tb[j])) / max(len(ta[i]), len(tb[j])) for _, ta, tb in pairs]
                    change[i][j] = (np.array(costs) if any(costs) else 0.0) if side else costs
                elif not side:
                    change[i][j] = [1.0] * len(pairs)
        if side:
            found = np.broadcast_to(_tree_distance(ma, mb, change, np.minimum), len(pairs)).tolist()
        else:
            found = [_tree_distance(ma, mb, [[c[k] for c in row] for row in change], min) for k in range(len(pairs))]
        for (n, _, _), distance in zip(pairs, found, strict=True):
            out[n] = max(0.0, 1 - float(distance) / most)
    return out


def table_similarity(a: str | None, b: str | None) -> float:
    return table_similarities([a], [b])[0]


@F.pandas_udf(T.DoubleType())
def teds(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(table_similarities(a.tolist(), b.tolist()), dtype="float64")


def table_shape_of(html: str | None) -> tuple[int, int]:
    """Rows and columns with the spans laid out on a grid; they hang on the markup alone."""
    known = _skeleton(html)
    return _shape(parse_table(html)) if known is None else _marked_shape(known[0], len(known[1]))


@functools.lru_cache(MARKUPS)
def _marked_shape(markup: str, count: int) -> tuple[int, int]:
    return _shape(_marked(markup, count))


def _shape(tree: list) -> tuple[int, int]:
    rows: list[list] = []

    def collect(node: list) -> None:
        for child in node[1]:
            if child[0] == "tr":
                rows.append([c[0].split(":") for c in child[1]])
            else:
                collect(child)

    collect(tree)
    taken: set[tuple[int, int]] = set()
    for r, cells in enumerate(rows):
        at = 0
        for _, across, down in cells:
            while (r, at) in taken:
                at += 1
            across, down = (int(x) if str(x).isdigit() and int(x) > 0 else 1 for x in (across, down))
            taken |= {(r + i, at + j) for i in range(down) for j in range(across)}
    return (max((r for r, _ in taken), default=-1) + 1, max((c for _, c in taken), default=-1) + 1)


@F.pandas_udf(T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType())]))
def table_shape(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([table_shape_of(x) for x in html], columns=["rows", "cols"], dtype="int32")


def lint_markdown(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Page anchors and blocks of a Markdown text: anchors, out of order, open fences, unknown notes, errors."""
    anchors = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\{([0-9]+)\}$"), 1), lambda a: a.cast("int"))
    steps = F.zip_with(F.slice("anchors", F.lit(1), F.greatest(F.size("anchors") - 1, F.lit(0))), F.slice("anchors", F.lit(2), F.greatest(F.size("anchors") - 1, F.lit(0))), lambda a, b: (b != a + 1).cast("int"))
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\^([0-9]+)\][^:]"), 1))
    notes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\[\^([0-9]+)\]:"), 1))
    out = docs.withColumn("anchors", anchors)
    return out.select(
        ident,
        F.size("anchors").alias("anchors"),
        F.aggregate(steps, F.lit(0), lambda s, x: s + x).alias("out_of_order"),
        (F.regexp_count(text, F.lit("(?m)^```")) % 2).alias("open_fences"),
        F.size(F.array_except(calls, notes)).alias("calls_without_note"),
    )
