"""Positioned text: runs to lines, lines to paragraphs, boxes around them.

All tables are keyed by page, which bounds every pair that is compared.
y grows upwards, so a page's first line has its largest y.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import remove, stored

PAGE = ("doc_id", "page_no")


def lines(runs: DataFrame) -> DataFrame:
    """Lines of runs (page, run_no, text, x, y, width, size, bold, italic, serif, color).

    Runs by y join the line whose first run's baseline is within 0.3 sizes
    (one point at least); a gap of two sizes parts cells. Weight, slant and
    serifs go by most characters, colour by the most characters, the least
    value at a tie. A space fills gaps over 0.2 sizes.
    """
    # whether a run opens a line depends on the line's first run, so the fold goes along the runs of one page
    page = list(PAGE)
    run = F.struct((-F.col("y")).alias("up"), "x", "run_no", "text", "y", "width", "size", "bold", "italic", "serif", "color")
    ordered = runs.groupBy(*page).agg(F.array_sort(F.collect_list(run)).alias("r"))
    start = F.from_json(F.lit('{"ids":[],"y":null,"id":-1}'), "ids array<int>, y double, id int")

    def step(a, r):
        near = F.coalesce(F.abs(r["y"] - a["y"]) <= F.greatest(F.lit(1.0), 0.3 * r["size"]), F.lit(False))
        id_ = F.when(near, a["id"]).otherwise(a["id"] + 1)
        return F.named_struct(F.lit("ids"), F.concat(a["ids"], F.array(id_)), F.lit("y"), F.when(near, a["y"]).otherwise(r["y"]), F.lit("id"), id_)

    ids = F.aggregate("r", start, step)["ids"]
    rows = ordered.select(*page, F.explode(F.arrays_zip(F.col("r"), ids.alias("base"))).alias("z")).select(*page, "z.base", "z.r.*")
    along = W.partitionBy(*page, "base").orderBy("x", "run_no")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(along)
    cut = F.coalesce((F.col("gap") > 2.0 * F.col("size")).cast("int"), F.lit(0))
    cells = rows.withColumn("gap", gap).withColumn("cut", cut).withColumn("cell", F.sum("cut").over(along))
    piece = F.struct("x", "run_no", F.concat(F.when((F.col("gap") > 0.2 * F.col("size")) & (F.col("cut") == 0), F.lit(" ")).otherwise(F.lit("")), "text").alias("t"))
    n = F.length("text")
    most = [(2 * F.sum(F.when(F.col(c), n).otherwise(0)) > F.sum(n)).alias(c) for c in ("bold", "italic", "serif")]
    colors = cells.groupBy(*page, "base", "cell", "color").agg(F.sum(n).alias("n"))
    color = colors.groupBy(*page, "base", "cell").agg(F.max_by("color", F.struct("n", (-F.col("color")).alias("c"))).alias("color"))
    made = cells.groupBy(*page, "base", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "").alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.max("y").alias("y"), F.max("size").alias("size"), *most,
    )
    return made.join(color, [*page, "base", "cell"]).withColumn("line_no", F.row_number().over(W.partitionBy(*page).orderBy("base", "cell")) - 1).drop("base", "cell")


def line_spacing(lines_: DataFrame) -> DataFrame:
    """(page, spacing): the least distance of following lines, to half points, that comes more than once; 0 if none does."""
    gaps = lines_.withColumn("gap", F.lag("y").over(W.partitionBy(*PAGE).orderBy(F.desc("y"), "x")) - F.col("y"))
    twice = gaps.where("gap > 0").groupBy(*PAGE, F.expr("bround(gap * 2) / 2").alias("g")).count().where("count > 1").groupBy(*PAGE).agg(F.min("g").alias("g"))
    return lines_.select(*PAGE).distinct().join(twice, list(PAGE), "left").select(*PAGE, F.coalesce("g", F.lit(0.0)).alias("spacing"))


def justified_columns(lines_: DataFrame) -> DataFrame:
    """(page, x, right): left edges of three lines and more, half of which end at one right edge a hundred points on."""
    ends = lines_.groupBy(*PAGE, F.bround("x").alias("x"), F.bround("right").alias("right")).agg(F.count("*").alias("n"))
    cols = ends.groupBy(*PAGE, "x").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("right", F.struct("n", (-F.col("right")).alias("r"))).alias("right"))
    return cols.where((F.col("all") >= 3) & (2 * F.col("most") >= F.col("all")) & (F.col("right") - F.col("x") >= 100)).select(*PAGE, "x", "right")


def margins(lines_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, left, right): the 5th of left and the 95th percentile of right edges, by position int(p * (n - 1))."""
    # ranks within a document; edges are numbers, and only two of each document go on
    n = F.count("*").over(W.partitionBy(doc))
    l_at, r_at = F.row_number().over(W.partitionBy(doc).orderBy("x")) - 1, F.row_number().over(W.partitionBy(doc).orderBy("right")) - 1
    ranked = lines_.select(doc, "x", "right", l_at.alias("l"), r_at.alias("r"), n.alias("n"))
    left = F.max(F.when(F.col("l") == F.floor(0.05 * (F.col("n") - 1)), F.col("x")))
    right = F.max(F.when(F.col("r") == F.floor(0.95 * (F.col("n") - 1)), F.col("right")))
    return ranked.groupBy(doc).agg(left.alias("left"), right.alias("right"))


def paragraphs(lines_: DataFrame) -> DataFrame:
    """Lines with para_no: a line goes on with a paragraph if it is near, aligned, alike and no list item.

    Near: below the last line by up to 1.8 of the larger size, or 1.25 of the
    page's usual spacing. Aligned: left edges or centres within 3 points, or
    an indent of 40. Alike: sizes within a fifth, the same weight. Lines at
    one place follow each other by line_no, those without a left edge come
    last at their height. A page without a number has no usual spacing.
    """
    along = W.partitionBy(*PAGE).orderBy(F.desc("y"), F.asc_nulls_last("x"), "line_no")
    got = lines_.join(line_spacing(lines_), list(PAGE), "left")
    before = {c: F.lag(c).over(along) for c in ("x", "right", "y", "size", "bold", "text")}
    gap, larger = before["y"] - F.col("y"), F.greatest(F.col("size"), before["size"])
    near = (gap > 0) & (gap <= F.greatest(1.8 * larger, 1.25 * F.col("spacing")))
    centre = F.abs((F.col("x") + F.col("right")) / 2 - (before["x"] + before["right"]) / 2) <= 3
    first = F.row_number().over(along) == 1
    indent = (before["x"] - F.col("x")).between(0, 40)
    item = r"^\s*(?:[-•*–]|\d{1,3}[.)])\s"
    hanging = before["text"].rlike(item) & (F.col("x") - before["x"]).between(0, 40)
    aligned = (F.abs(F.col("x") - before["x"]) <= 3) | centre | indent | hanging
    alike = (F.abs(F.col("size") - before["size"]) <= 0.2 * larger) & (F.col("bold") == before["bold"])
    opens = F.when(first, 1).otherwise((~F.coalesce(near & aligned & alike & ~F.col("text").rlike(item), F.lit(False))).cast("int"))
    return got.withColumn("opens", opens).withColumn("para_no", F.sum("opens").over(along) - 1).drop("opens", "spacing")


def paragraph_figures(lines_: DataFrame) -> DataFrame:
    """(page, para_no, n, base_size, justified, text) of lines with para_no.

    base_size is the commonest, at a tie the first seen; justified: three
    lines and more whose right edges, but for the last, lie within 4 points.
    text is null if no line has one.
    """
    along = W.partitionBy(*PAGE, "para_no").orderBy(F.desc("y"), F.asc_nulls_last("x"), "line_no")
    numbered = lines_.withColumns({"nth": F.row_number().over(along), "n": F.count("*").over(W.partitionBy(*PAGE, "para_no"))})
    sizes = numbered.groupBy(*PAGE, "para_no", "size").agg(F.count("*").alias("c"), F.min("nth").alias("f"))
    base = sizes.groupBy(*PAGE, "para_no").agg(F.max_by("size", F.struct("c", (-F.col("f")).alias("f"))).alias("base_size"))
    inner = F.when(F.col("nth") < F.col("n"), F.col("right"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " ")
    made = numbered.groupBy(*PAGE, "para_no").agg(
        F.max("n").alias("n"), ((F.max("n") >= 3) & (F.max(inner) - F.min(inner) <= 4)).alias("justified"), F.when(F.count("text") > 0, text).alias("text"),
    )
    return made.join(base, [*PAGE, "para_no"])


def between(gaps: DataFrame, shapes: DataFrame, kind: str | None = None) -> DataFrame:
    """Gaps (page, n, left, right, y) that a shape's edge (page, x0, x1, y0, y1) falls into at the baseline."""
    s = shapes.where(F.col("kind") == kind) if kind else shapes
    s = s.select(*(F.col(c).alias(f"__{c}") for c in PAGE), "x0", "x1", "y0", "y1")
    on = (F.col("doc_id") == F.col("__doc_id")) & (F.col("page_no") == F.col("__page_no")) & (F.col("x0").between(F.col("left"), F.col("right")) | F.col("x1").between(F.col("left"), F.col("right"))) & F.col("y").between(F.col("y0"), F.col("y1"))
    return gaps.join(s, on, "left_semi")


def enclosing(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(page, n, x0, x1, y0) of the narrowest shape around each point (page, n, x, y), the lowest at a tie; nulls if none."""
    s = shapes.select(*PAGE, "x0", "x1", "y0", "y1")
    got = points.join(s, list(PAGE)).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    best = got.groupBy(*PAGE, "n").agg(F.min(F.struct((F.col("x1") - F.col("x0")).alias("w"), "y0", "x0", "x1")).alias("b")).select(*PAGE, "n", "b.x0", "b.x1", "b.y0")
    return points.select(*PAGE, "n").join(best, [*PAGE, "n"], "left")


def floors(boxes: DataFrame) -> DataFrame:
    """(page, n, floor): for each box the highest top of a box below it whose columns overlap; null if none."""
    other = boxes.select(*PAGE, F.col("n").alias("m"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y1").alias("top"))
    hit = boxes.join(other, list(PAGE)).where((F.col("n") != F.col("m")) & (F.col("a") < F.col("x1")) & (F.col("x0") < F.col("b")) & (F.col("top") <= F.col("y0")))
    return boxes.select(*PAGE, "n").join(hit.groupBy(*PAGE, "n").agg(F.max("top").alias("floor")), [*PAGE, "n"], "left")


def right_limits(lines_: DataFrame, margin: float) -> DataFrame:
    """(page, line_no, limit): how far each line may reach: to its right-hand neighbour at its height, else the margin."""
    other = lines_.select(*PAGE, F.col("x").alias("ox"), F.col("y").alias("oy"))
    hit = lines_.join(other, list(PAGE)).where((F.col("ox") > F.col("right")) & (F.abs(F.col("oy") - F.col("y")) <= 0.6 * F.col("size")))
    near = hit.groupBy(*PAGE, "line_no").agg(F.min("ox").alias("ox"))
    return lines_.select(*PAGE, "line_no").join(near, [*PAGE, "line_no"], "left").select(*PAGE, "line_no", F.least(F.coalesce("ox", F.lit(margin)), F.lit(margin)).alias("limit"))


def column_walls(lines_: DataFrame, least: int = 3) -> DataFrame:
    """(page, x, bottom, top): left edges, to a point, that more lines start at than cross, ``least`` at least."""
    at = lines_.groupBy(*PAGE, F.bround("x").alias("wx")).agg(F.count("*").alias("starts"), F.min("y").alias("bottom"), F.max("y").alias("top")).where(F.col("starts") >= least)
    crossing = at.join(lines_.select(*PAGE, "x", "right", "y"), list(PAGE)).where((F.col("x") < F.col("wx") - 1) & (F.col("right") > F.col("wx") + 1) & F.col("y").between(F.col("bottom"), F.col("top")))
    n = crossing.groupBy(*PAGE, "wx").agg(F.count("*").alias("crossings"))
    return at.join(n, [*PAGE, "wx"], "left").where(F.coalesce("crossings", F.lit(0)) < F.col("starts")).select(*PAGE, F.col("wx").alias("x"), "bottom", "top")


def centres(lines_: DataFrame) -> DataFrame:
    """(page, para_no, centre): the mean centre of lines balanced between both edges of the page's text; null if one isn't."""
    edge = lines_.groupBy(*PAGE).agg(F.min("x").alias("lo"), F.max("right").alias("hi"))
    got = lines_.join(edge, list(PAGE)).withColumn("c", (F.col("x") + F.col("right")) / 2)
    tolerance = 0.03 * (F.col("hi") - F.col("lo"))
    even = (F.abs((F.col("x") - F.col("lo")) - (F.col("hi") - F.col("right"))) <= tolerance) & (F.col("x") - F.col("lo") > tolerance)
    return got.groupBy(*PAGE, "para_no").agg(F.when(F.bool_and(even), F.avg("c")).alias("centre"))


def levelled(cells: DataFrame, edges: DataFrame, least: float = 6.0) -> DataFrame:
    """(page, n, size): each cell gets the least target of its component, not under ``least`` or its base if others share it.

    cells: (page, n, base, target). edges: (page, a, b), links within a page.
    Labels spread along links, and jump to the label of the cell they name,
    until none changes, for all pages at once. Each round's labels are written
    to the shared folder, and those of the round before go.
    """
    page = list(PAGE)
    linked, links_path = stored(edges.union(edges.select(*page, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cell-links")
    label, path = stored(cells.select(*page, "n", F.col("n").alias("label")), "cell-labels")
    while True:
        near = linked.join(label.select(*page, F.col("n").alias("b"), F.col("label").alias("l")), [*page, "b"]).groupBy(*page, F.col("a").alias("n")).agg(F.min("l").alias("l"))
        then, to = stored(label.join(near, [*page, "n"], "left").select(*page, "n", F.least("label", F.coalesce("l", "label")).alias("label"), (F.col("l") < F.col("label")).alias("moved")), "cell-labels")
        remove(cells.sparkSession, path)
        path, label = to, then.drop("moved")
        if then.where("moved").isEmpty():
            break
        # the cell that a label names is in the same component, so its own label is as good
        up = label.select(*page, F.col("n").alias("label"), F.col("label").alias("l")).distinct()
        label = label.join(up, [*page, "label"]).select(*page, "n", F.col("l").alias("label"))
    remove(cells.sparkSession, links_path)
    by = W.partitionBy(*page, "label")
    got = cells.join(label, [*page, "n"])
    least_ = F.min("target").over(by)
    size = F.when(F.count("*").over(by) > 1, F.greatest(least_, F.least(F.lit(least), F.col("base")))).otherwise(F.col("target"))
    return got.select(*page, "n", size.alias("size"))
