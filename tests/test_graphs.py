"""Parent chains, circular formulas and row blocks, with circles and long chains."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import cells, forms, layout


def on_cycles(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reaches_itself(node):
        seen, waiting = set(), list(after.get(node, ()))
        while waiting:
            n = waiting.pop()
            if n == node:
                return True
            if n not in seen:
                seen.add(n)
                waiting += after.get(n, ())
        return False

    return sorted(n for n in after if reaches_itself(n))


def found(spark, edges):
    return sorted(r.node for r in cells.circular(spark.createDataFrame(edges, "src string, dst string")).collect())


def test_node_between_two_circles(spark):
    assert found(spark, [("1", "2"), ("2", "1"), ("2", "3"), ("3", "4"), ("4", "5"), ("5", "4"), ("6", "6")]) == ["1", "2", "4", "5", "6"]


def test_long_chain_and_ring(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(5000)]
    ring = [(f"r{i}", f"r{(i + 1) % 700}") for i in range(700)]
    assert found(spark, chain + ring + [("c9", "r3"), ("r5", "x"), ("x", "y")]) == sorted(f"r{i}" for i in range(700))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(f"{g}-{r.randrange(14)}", f"{g}-{r.randrange(14)}") for g in range(12) for _ in range(4 + g)]
    assert found(spark, edges) == on_cycles(edges)


def test_blocks_cover_ranges_once(spark):
    ranges = [(a, b) for a in (1, 2, 3, 8, 17) for b in range(a, 40)] + [(1, 1048576), (9, 4)]
    rows = spark.createDataFrame(ranges, "a int, b int").select("a", "b", cells._blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        low, high = sorted((r.a, r.b))
        spans = sorted((x["at"] << x["k"], (x["at"] + 1) << x["k"]) for x in r.x)
        assert spans[0][0] == low and spans[-1][1] == high + 1 and all(p[1] == q[0] for p, q in zip(spans, spans[1:])) and len(spans) <= 42


def test_formula_circles_through_ranges(spark):
    formulas = [(row, 1, f"=SUM(B$1:B{row})") for row in range(1, 60)] + [(row, 2, f"=A{row - 1}" if row > 1 else "=C1") for row in range(1, 60)] + [(70, 1, "=SUM(A69:A71)"), (80, 1, "=SUM(A81:A90)")]
    rows = [("w x", "s", f"{'AB'[c - 1]}{r}", r, c, "1", f) for r, c, f in formulas] + [("w x", "s", "C1", 1, 3, "1", None)]
    table = spark.createDataFrame(rows, "workbook string, sheet string, coord string, row int, col int, value string, formula string")
    got = {r.coord for r in cells.formula_ref_findings(table).where("rule = 'circular_reference'").collect()}
    edges = [(f"A{r}", f"B{k}") for r in range(1, 60) for k in range(1, r + 1)] + [(f"B{r}", f"A{r - 1}") for r in range(2, 60)] + [("A70", "A70")]
    assert got == set(on_cycles(edges))


CELL = "workbook string, sheet string, coord string, row int, col int, value string, formula string"


def test_ranges_link_only_blocks_asked_for(spark, monkeypatch):
    """Every formula in a column with a range used to hang below a block of each of 21 sizes, whatever the ranges asked for."""
    seen = []
    keep = cells.circular
    monkeypatch.setattr(cells, "circular", lambda edges: seen.append(edges.distinct().count()) or keep(edges))
    rows = [("w", "s", f"A{r}", r, 1, "1", "=SUM(A8:A15)" if r == 9 else f"=SUM(A{r}:A{r})" if r == 500 else "=LOG10(3)") for r in range(1, 501)]
    got = cells.formula_ref_findings(spark.createDataFrame(rows, CELL))
    assert {tuple(r) for r in got.collect()} == {("w", "s", f"A{r}", "circular_reference", "") for r in (9, 500)}
    assert seen == [1 + 8 + 1]  # A9 over its block to eight cells, A500 to itself


@pytest.mark.parametrize("seed", [3, 4])
def test_formula_circles_through_random_ranges(spark, seed):
    r = random.Random(seed)
    rows, edges = [], []
    for book in ("u", "v"):
        have = {(c, i) for c in "ABC" for i in range(1, 41) if r.random() < 0.7}
        for c, i in sorted(have):
            if r.random() < 0.6:
                first, low = r.choice("ABC"), r.randrange(1, 41)
                high, last = (low + r.choice([0, 1, 3, 12]), chr(min(ord("C"), ord(first) + r.randrange(2)))) if r.random() < 0.4 else (low, None)
                formula = f"={first}{low}" if last is None else f"=SUM({first}{low}:{last}{high})"
                edges += [((book, c, i), (book, x, k)) for x in "ABC" if first <= x <= (last or first) for k in range(low, high + 1) if (x, k) in have]
            else:
                formula = None
            rows.append((book, "s", f"{c}{i}", i, ord(c) - 64, "1", formula))
    got = cells.formula_ref_findings(spark.createDataFrame(rows, CELL)).where("rule = 'circular_reference'").collect()
    assert sorted((x.workbook, x.coord[0], int(x.coord[1:])) for x in got) == on_cycles(edges) != []


def test_positions_and_circles_of_groups(spark):
    shapes = spark.createDataFrame([("d", 1, 1, None, 5, 6), ("d", 1, 2, 1, 10, 20), ("d", 1, 3, 2, 100, 200), ("d", 1, 4, 9, 1, 1), ("d", 2, 1, 2, 1, 1), ("d", 2, 2, 1, 1, 1), ("d", 2, 3, 1, 1, 1)],
                                   "deck string, slide int, shape_no int, parent_no int, left_emu long, top_emu long")
    got = {(r.slide, r.shape_no): (r.abs_left, r.abs_top, r.cyclic) for r in layout.absolute_positions(shapes).collect()}
    assert got == {(1, 1): (5, 6, False), (1, 2): (15, 26, False), (1, 3): (115, 226, False), (1, 4): (1, 1, False),
                   (2, 1): (None, None, True), (2, 2): (None, None, True), (2, 3): (None, None, True)}


def test_deep_field_names(spark):
    rows = [("d", i, i - 1 if i else None, f"n{i}" if i % 2 else "") for i in range(40)] + [("e", 1, 2, "a"), ("e", 2, 1, "b"), ("f", 1, None, None)]
    got = {(r.doc, r.node_no): (r.full_name, r.cyclic) for r in forms.field_full_name(spark.createDataFrame(rows, "doc string, node_no int, parent_no int, name string")).collect()}
    assert got["d", 39] == (".".join(f"n{i}" for i in range(1, 40, 2)), False) and got["d", 0] == (None, False)
    assert got["e", 1] == got["e", 2] == (None, True) and got["f", 1] == (None, False)
