"""Spreadsheet operators over ``cells(workbook, sheet, coord, row, col, value, formula, ...)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.operators.ordered import first_n, folded_upwards, running_total
from docloom.session import materialize, wide

# Error texts in the order in which they are looked for.
ERRORS = ("#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A")
LOCATIONS_KEPT = 20


def cell_address(df: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Adds ``coord`` (64 -> BL) and ``sheet_row`` for a frame row (row n is sheet row n + 1)."""
    return df.withColumn("coord", F.concat(N.column_letters(F.col(col)), F.col(row).cast("string"))).withColumn("sheet_row", F.col(row) + 1)


def _code(value: Column) -> Column:
    code = F.when(value.contains(ERRORS[0]), ERRORS[0])
    for e in ERRORS[1:]:
        code = code.when(value.contains(e), e)
    return code


def error_locations(cells: DataFrame) -> DataFrame:
    """Cells that hold an error text: the first matching code counts, once per cell.
    ``(workbook, sheet_no, row, col, code, location)``; ``sheet_no`` is the sheet's place in the book."""
    found = cells.withColumn("code", _code(F.col("value"))).where("code IS NOT NULL")
    return found.select("workbook", "sheet_no", "row", "col", "code", F.concat("sheet", F.lit("!"), "coord").alias("location"))


def first_n_locations(found: DataFrame, n: int = LOCATIONS_KEPT) -> DataFrame:
    """First locations per workbook and code in scan order (sheet, row, column)."""
    return first_n(found, ["workbook", "code"], ["sheet_no", "row", "col"], n, "place")


def error_cells(cells: DataFrame) -> DataFrame:
    """Per workbook and code: the count over all cells and the first 20 locations."""
    found = error_locations(cells)
    counts = found.groupBy("workbook", "code").agg(F.count(F.lit(1)).alias("count"))
    shown = first_n_locations(found).groupBy("workbook", "code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "location"))), lambda x: x["location"]).alias("locations"))
    return counts.join(shown, ["workbook", "code"])


def formula_count(cells: DataFrame) -> DataFrame:
    return cells.groupBy("workbook").agg(F.count_if(F.coalesce(F.col("formula").startswith("="), F.lit(False))).alias("total_formulas"))


def error_report(cells: DataFrame) -> DataFrame:
    """One row per workbook: ``status, total_errors, error_summary, total_formulas``.  At most seven codes
    with 20 locations each reach the final grouping."""
    per_code = error_cells(cells).groupBy("workbook").agg(
        F.sum("count").alias("total_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "code", F.struct("count", "locations").alias("v"))))).alias("error_summary"))
    out = formula_count(cells).join(per_code, "workbook", "left")
    total = F.coalesce("total_errors", F.lit(0))
    return out.select("workbook", F.when(total == 0, "success").otherwise("errors_found").alias("status"), total.alias("total_errors"),
                      F.coalesce("error_summary", F.expr("map_from_entries(cast(array() as array<struct<code:string,v:struct<count:bigint,locations:array<string>>>>))")).alias("error_summary"),
                      "total_formulas")


def cell_role_audit(cells: DataFrame) -> DataFrame:
    """Role of each filled cell, the colour the convention asks for, and whether ``color`` differs.

    External link (a file in brackets) is red, link to another sheet green, other formulas black, plain input blue.
    """
    f = F.col("formula")
    role = (F.when(f.rlike(r"\[[^\]]+\]"), "external link").when(f.rlike(r"""('[^']+'|[A-Za-z_][\w.]*)!\$?[A-Z]"""), "sheet link")
            .when(f.startswith("="), "formula").otherwise("input"))
    expected = (F.when(F.col("role") == "external link", "red").when(F.col("role") == "sheet link", "green")
                .when(F.col("role") == "formula", "black").otherwise("blue"))
    return cells.where("value IS NOT NULL OR formula IS NOT NULL").withColumn("role", role).withColumn("expected", expected).withColumn(
        "mismatch", ~F.col("color").eqNullSafe(F.col("expected")))


def format_report(df: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """Adds ``shown``: years as plain text, ``$#,##0`` money, 0.0% percentages, 0.0x multiples, ``-`` for zero,
    parentheses for negatives."""
    v, k, size = F.col(value), F.col(kind), F.abs(F.col(value))
    body = (F.when(k == "currency", F.concat(F.lit("$"), F.format_number(size, 0))).when(k == "percent", F.concat(F.format_number(size * 100, 1), F.lit("%")))
            .when(k == "multiple", F.concat(F.format_number(size, 1), F.lit("x"))).otherwise(F.format_number(size, 0)))
    return df.withColumn("shown", F.when(k == "year", v.cast("long").cast("string")).when(v == 0, "-")
                         .when(v < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(column, q, value)``.

    Equal values are counted first; the counts are then added up over range partitions, so no task
    holds a column, and only the two neighbours of each quantile remain.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    counts = pairs.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, ["column"], ["value"], F.col("n"), "upto")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    wanted = totals.select("column", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "total").select(
        "column", "q", (F.col("q") * (F.col("total") - 1)).alias("at"))
    # ``wanted`` holds (columns x quantiles) rows.
    hit = upto.join(F.broadcast(wanted), "column").withColumn("first", F.col("upto") - F.col("n"))
    low, high = F.floor("at"), F.ceil("at")
    covers = lambda r: (r >= F.col("first")) & (r < F.col("upto"))
    near = hit.where(covers(low) | covers(high)).groupBy("column", "q", "at").agg(
        F.max(F.when(covers(low), F.col("value"))).alias("a"), F.max(F.when(covers(high), F.col("value"))).alias("b"))
    return near.select("column", "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-null count, mean, sample deviation, minimum, quartiles, maximum."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                             F.min(v).alias("min"), F.max(v).alias("max")))
    base = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    q = quantiles(df, columns, (0.25, 0.5, 0.75)).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(q, "column", "left")


def totals(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """Sum, average and growth from the first to the last value per key."""
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.avg(value).alias("average"),
                                F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    return out.withColumn("growth", F.when(F.col("_first") != 0, (F.col("_last") - F.col("_first")) / F.col("_first"))).drop("_first", "_last")


# --- formula references ---------------------------------------------------------------------------------

_REF = r"(?:('[^']+'|[A-Za-z_][\w.]*)!)?\$?([A-Z]{1,3})\$?([0-9]+)(?::\$?([A-Z]{1,3})\$?([0-9]+))?(?![\w(])"


def formula_references(cells: DataFrame) -> DataFrame:
    """One row per reference in a formula: sheet, corner cells, and whether it stands right after a ``/``."""
    f = F.regexp_replace("formula", r'"[^"]*"|\[[^\]]*\][^!]*!\$?[A-Z]+\$?[0-9]+', "")
    whole = F.regexp_extract_all(f, F.lit(r"(/\s*)?(?<![\w.$!'])" + _REF), F.lit(0))
    r = F.col("_r")
    part = lambda i: F.regexp_extract(r, r"^(?:/\s*)?" + _REF, i)
    exploded = cells.where(F.col("formula").startswith("=")).select("workbook", "sheet", "coord", F.explode(whole).alias("_r"))
    sheet = F.regexp_replace(part(1), "^'|'$", "")
    return exploded.select("workbook", "sheet", "coord", F.when(sheet == "", F.col("sheet")).otherwise(sheet).alias("to_sheet"),
                           F.concat(part(2), part(3)).alias("to_coord"), N.column_number(part(2)).alias("col_from"), part(3).cast("int").alias("row_from"),
                           F.when(part(4) == "", None).otherwise(N.column_number(part(4))).alias("col_to"), F.when(part(5) == "", None).otherwise(part(5)).cast("int").alias("row_to"),
                           r.startswith("/").alias("divides"))


def _inner(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loose ends ``(node)``, and chain nodes ``(node, of, to)``: exactly one edge in and one out, not both at themselves."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("to"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("of"))
    nodes = materialize(outs.join(ins, "node", "full"))
    return nodes.where("outs IS NULL OR ins IS NULL").select("node"), nodes.where("outs = 1 AND ins = 1 AND of <> node").select("node", "of", "to")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return edges.select("src", "dst")


def _raked(edges: DataFrame) -> DataFrame:
    """The edges whose start has an edge in and whose end has an edge out."""
    kept = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return kept.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges without loose ends and with every chain as one edge; the chain nodes with the ends of their chain
    ``(node, entry, exit)``; and the nodes ``(node, ring)`` of rings that are nothing but a chain."""
    loose, inner = _inner(edges)
    names = inner.select(F.col("node").alias("of"), F.lit(True).alias("_inside"))
    linked = inner.join(names, "of", "left").withColumn("_up", F.when(F.col("_inside"), F.col("of"))).withColumn("_all", F.lit(0))
    heads = materialize(folded_upwards(linked.select("_all", "node", "of", "to", "_up"), ["_all"], "node", "_up", {"head": F.col("node"), "ring": F.col("node")},
                                         lambda name, below, above: above if name == "head" else F.greatest(below, above), settle="ring"))
    entries = heads.where("NOT cyclic AND node = head").select("head", F.col("of").alias("entry"))
    exits = heads.where("NOT cyclic").join(names.select(F.col("of").alias("to")), "to", "left_anti").select("head", F.col("to").alias("exit"))
    chains = entries.join(exits, "head")
    members = heads.where("NOT cyclic").select("node", "head").join(chains, "head").select("node", "entry", "exit")
    short = _without(edges, inner.select("node")).unionByName(chains.select(F.col("entry").alias("src"), F.col("exit").alias("dst")))
    return _without(short, loose).distinct(), members, heads.where("cyclic").select("node", "ring")


def _reached(edges: DataFrame, colour: DataFrame, back: bool) -> DataFrame:
    """Largest colour that comes along the edges, round by round; ``back`` goes against them and stays inside a colour."""
    a, b = ("dst", "src") if back else ("src", "dst")
    while True:
        sent = edges.join(colour.withColumnRenamed("node", a), a).select(F.col(b).alias("node"), "colour")
        step = materialize(colour.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")))
        if step.join(colour, ["node", "colour"], "left_anti").isEmpty():
            return step
        colour = step


def _rings(edges: DataFrame) -> DataFrame | None:
    """``(node, ring)`` of the nodes on cycles: what a node reaches and what reaches it, colour by colour."""
    found, left = None, edges
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = _reached(left, materialize(nodes.withColumn("colour", F.col("node"))), False)
        ends = colour.select(F.col("node").alias("src"), F.col("colour").alias("_c")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("_d"))
        same = materialize(left.join(ends[0], "src").join(ends[1], "dst").where("_c = _d").select("src", "dst"))
        ring = _reached(same, colour.where("node = colour"), True)
        looped = ring.join(same.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node", F.col("colour").alias("ring"))
        inside = same.join(ring.select(F.col("node").alias("src")), "src", "left_semi").join(ring.select(F.col("node").alias("dst")), "dst", "left_semi")
        looped = materialize(looped.join(inside.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
        found = looped if found is None else found.unionByName(looped)
        left = materialize(_without(left, ring))
    return found


def circular(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: ``edges(src, dst)`` -> ``(node)``; a node between two cycles is not on one.

    Loose ends go, and every chain becomes one edge by pointer doubling, so long chains take the logarithm of their
    length in rounds.  Nodes with an edge to themselves are found at once.  The strongly connected parts of what is left are found by colours; a chain that was cut short
    is on a cycle when both its ends are in one part.
    """
    edges = materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    own, left = edges.where("src = dst").select(F.col("src").alias("node")), edges.where("src <> dst")
    cut: list[tuple[DataFrame, DataFrame]] = []
    n = left.count()
    while n:
        raked = materialize(_raked(left))
        m = raked.count()
        if m and m > 0.9 * n:  # few loose ends: chains hold the rest together
            short, members, rings = _compressed(raked)
            raked, members, rings = materialize(short), materialize(members), materialize(rings)
            cut.append((members, rings))
            m = raked.count()
        left, n, before = raked, m, n
        if n == before:
            break
    found = _rings(left)
    if found is None:
        found = left.select(F.col("src").alias("node"), F.col("src").alias("ring")).limit(0)
    for members, rings in reversed(cut):
        at = lambda name: found.select(F.col("node").alias(name), F.col("ring").alias(f"_{name}"))  # noqa: B023, E731
        back = members.join(at("entry"), "entry").join(at("exit"), "exit").where("_entry = _exit").select("node", F.col("_entry").alias("ring"))
        found = materialize(found.unionByName(back).unionByName(rings))
    return found.select("node").unionByName(own).distinct()


def _blocks(first: Column, last: Column) -> Column:
    """A row range as aligned blocks ``(k, at)`` of 2**k rows, two of a size at most: long ranges stay short lists."""
    entry = lambda k, at: F.array(F.struct(k.cast("int").alias("k"), at.cast("int").alias("at")))
    none = F.array().cast("array<struct<k:int,at:int>>")

    def level(s: Column, k: Column) -> Column:
        low, high = s["low"], s["high"]
        left, right = (low < high) & (low % 2 == 1), (low < high) & (high % 2 == 1)
        taken = F.concat(s["out"], F.when(left, entry(k, low)).otherwise(none), F.when(right & ((high - 1 > low) | ~left), entry(k, high - 1)).otherwise(none))
        next_low, next_high = F.when(left, low + 1).otherwise(low), F.when(right, high - 1).otherwise(high)
        return F.struct(F.floor(next_low / 2).cast("int").alias("low"), F.floor(F.greatest(next_high, next_low) / 2).cast("int").alias("high"), taken.alias("out"))

    low, high = F.least(first, last).cast("int"), (F.greatest(first, last) + 1).cast("int")
    start = F.struct(low.alias("low"), high.alias("high"), none.alias("out"))
    sizes = F.length(F.bin((high - low).cast("long")))  # every level at least halves what is left
    return F.aggregate(F.sequence(F.lit(0), sizes - 1), start, level, lambda s: s["out"])


def _range_edges(refs: DataFrame, formulas: DataFrame, name: Callable[[str, str], Column]) -> DataFrame:
    """``(src, dst)`` from formulas over the blocks of their ranges to the formulas inside.

    Blocks of one row are their cell.  Other blocks are nodes; they lie inside each other or apart, so a cell hangs below the
    smallest block that some range asks for, and every asked block below the next larger one.  Blocks nobody asks for are not made.
    """
    column = ["workbook", "to_sheet", "col"]
    block = lambda k, at: F.to_json(F.struct(F.col("workbook").alias("w"), F.col("to_sheet").alias("s"), F.col("col").alias("col"), k.alias("k"), at.alias("at")))
    spans = refs.where("col_to IS NOT NULL").withColumn("col", F.explode(F.sequence(F.col("col_from").cast("long"), F.col("col_to").cast("long"))))
    met = materialize(spans.withColumn("b", F.explode(_blocks(F.col("row_from"), F.col("row_to")))).select(name("sheet", "coord").alias("src"), *column, "b.k", "b.at"))
    cell = formulas.withColumn("col", F.col("col").cast("long"))
    single = met.where("k = 0").withColumnRenamed("at", "row").join(wide(cell), [*column, "row"]).select("src", name("to_sheet", "to_coord").alias("dst"))
    large = met.where("k > 0")
    asked = large.select(*column, "k", "at").distinct()
    sizes = asked.groupBy(*column).agg(F.collect_set("k").alias("ks"))
    at = lambda k: F.call_function("shiftright", F.col("row"), k)
    inside = cell.join(sizes, column).withColumn("k", F.explode("ks")).withColumn("at", at(F.col("k"))).join(wide(asked), [*column, "k", "at"], "left_semi")
    held = inside.groupBy(*column, "to_coord", "row").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    steps = held.withColumn("b", F.explode(F.transform("ks", lambda k, i: F.struct(k.alias("k"), F.get("ks", i - 1).alias("below")))))
    below = F.when(F.col("b.below").isNull(), name("to_sheet", "to_coord")).otherwise(block(F.col("b.below"), at(F.col("b.below"))))
    return single.unionByName(large.select("src", block(F.col("k"), F.col("at")).alias("dst"))).unionByName(
        steps.select(block(F.col("b.k"), at(F.col("b.k"))).alias("src"), below.alias("dst")))


def formula_ref_findings(cells: DataFrame) -> DataFrame:
    """References to cells that do not exist, divisors that are empty or zero, and circular formulas:
    ``(workbook, sheet, coord, rule, target)``.  Formulas are searched once, and single references looked up once."""
    refs = materialize(formula_references(cells))
    formula = F.coalesce(F.col("formula").startswith("="), F.lit(False))
    known = cells.select("workbook", F.col("sheet").alias("to_sheet"), F.col("coord").alias("to_coord"), F.col("value").alias("_v"), formula.alias("_formula"), F.lit(True).alias("_known"))
    zero = F.coalesce((F.col("_v") == "") | (F.col("_v").try_cast("double") == 0), F.lit(True))
    looked = refs.where("col_to IS NULL").join(wide(known), ["workbook", "to_sheet", "to_coord"], "left").select(
        "workbook", "sheet", "coord", "to_sheet", "to_coord", F.col("_known").isNull().alias("missing"),
        (F.col("_known").isNotNull() & F.col("divides") & zero).alias("divisor"), F.coalesce("_formula", F.lit(False)).alias("linked"))
    looked = materialize(looked.where("missing OR divisor OR linked"))
    finding = lambda flag, rule: looked.where(flag).select(
        "workbook", "sheet", "coord", F.lit(rule).alias("rule"), F.concat("to_sheet", F.lit("!"), "to_coord").alias("target"))
    name = lambda s, c: F.to_json(F.struct(F.col("workbook").alias("w"), F.col(s).alias("s"), F.col(c).alias("c")))
    formulas = cells.where(formula).select("workbook", F.col("sheet").alias("to_sheet"), F.col("coord").alias("to_coord"), "row", "col")
    direct = looked.where("linked").select(name("sheet", "coord").alias("src"), name("to_sheet", "to_coord").alias("dst"))
    looped = circular(direct.unionByName(_range_edges(refs, formulas, name)))
    kinds = dict(cells.dtypes)
    parsed = looped.select(F.from_json("node", f"w {kinds['workbook']}, s {kinds['sheet']}, c {kinds['coord']}").alias("n"))  # a node with an edge out is a formula or a block
    loops = parsed.where("n.c IS NOT NULL").select(F.col("n.w").alias("workbook"), F.col("n.s").alias("sheet"), F.col("n.c").alias("coord"), F.lit("circular_reference").alias("rule"), F.lit("").alias("target"))
    return finding("missing", "missing_reference").unionByName(finding("divisor", "zero_divisor")).unionByName(loops).distinct()
