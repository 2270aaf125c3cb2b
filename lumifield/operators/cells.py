"""Cell x protein table from called beads, a label image and a protein image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.constants import (
    CELL_MAX_SIZE, CORE_MEDIAN, LINEAR_OFFSET, LINEAR_SHIFT, LINEAR_SLOPE, SURROUND_RATIO,
)
from lumifield.functions.lookup import attach, bucket, window_join
from lumifield.functions.stats import grouped_median
from lumifield.functions.storage import store, store_observed
from lumifield.schemas import require

MAX_COLUMNS = 2000


def clean_color_code(code: DataFrame) -> DataFrame:
    """Without rows and columns that are empty throughout."""
    counts = code.agg(*[F.count(c).alias(c) for c in code.columns]).first()
    used = [c for c in code.columns if counts[c] > 0]
    return code.select(*used).dropna("all")


def code_columns(code: DataFrame) -> list[str]:
    return code.columns[1:]


def code_size(code: DataFrame) -> DataFrame:
    """Number of decoding cycles and of colours, as one row."""
    cols = code_columns(code)
    top = F.max(F.greatest(*cols)) if len(cols) > 1 else F.max(cols[0])
    return code.agg(F.lit(len(cols)).alias("n_cycles"), (top + 1).cast("int").alias("n_colours"))


def code_key(columns: Sequence[str], base: int | Column = 10) -> Column:
    """The colours of a bead read as digits. ``base`` is 10, or the number of colours if larger, so
    that different words never share a key."""
    base = F.lit(base) if isinstance(base, int) else base
    key = F.lit(0).cast("long")
    for c in columns:
        key = key * base + F.col(c).cast("long")
    return key


def code_space(code: DataFrame) -> tuple[int, int]:
    """Numbers of cycles and of colours of a colour code, which is read once. Words are whole numbers below 2^63, so more are refused."""
    n_cycles, n_colours = code_size(code).first()
    if n_colours is None:
        raise ValueError("colour code is empty")
    if max(n_colours, 10) ** n_cycles >= 1 << 63:
        raise ValueError(f"{n_colours} colours in {n_cycles} cycles give words beyond 64 bits")
    return n_cycles, n_colours


def word_index(columns: Sequence[str], n_colours: int) -> Column:
    """Place of a colour word in counting order, computed from its colours; NULL where one is missing or not a colour."""
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.col(c).between(0, n_colours - 1)
    return F.when(valid, code_key(columns, n_colours)).cast(_index_type(len(columns), n_colours))


def word_digits(index: str, columns: Sequence[str], n_colours: int) -> list[Column]:
    """The colours of the word at ``index``, one column per cycle; the inverse of :func:`word_index`."""
    last = len(columns) - 1
    return [F.expr(f"CAST(pmod({index} div {n_colours ** (last - i)}L, {n_colours}) AS INT)").alias(c) for i, c in enumerate(columns)]


def _index_type(n_cycles: int, n_colours: int) -> str:
    return "int" if n_colours ** n_cycles < 1 << 31 else "long"


def coded_beads(beads: DataFrame, code: DataFrame) -> DataFrame:
    """Beads whose colours are a word, with its protein_idx. Computed from the bead's own row: no table of words, no join."""
    cols = code_columns(code)
    _, n_colours = code_space(code)
    return beads.withColumn("protein_idx", word_index(cols, n_colours)).where(F.col("protein_idx").isNotNull())


def code_words(code: DataFrame) -> DataFrame:
    """Every colour word (digit columns, protein_idx in counting order, key); colours ** cycles rows, counted and decoded in parallel.

    For small codes and reports. The other operators make only the words that their rows have.
    """
    cols = code_columns(code)
    n_cycles, n_colours = code_space(code)
    every = code.sparkSession.range(n_colours ** n_cycles).select(F.col("id").cast(_index_type(n_cycles, n_colours)).alias("protein_idx"))
    return _decoded(every, cols, n_colours)


def _decoded(words: DataFrame, cols: Sequence[str], n_colours: int) -> DataFrame:
    rows = words.select("protein_idx", *word_digits("protein_idx", cols, n_colours))
    return rows.select("protein_idx", *cols, code_key(cols, max(n_colours, 10)).alias("code"))


def named_words(code: DataFrame) -> DataFrame:
    """protein_idx, name of the words that the colour code names; the last name in order if it names one twice."""
    cols = code_columns(code)
    _, n_colours = code_space(code)
    rows = code.select(word_index(cols, n_colours).alias("protein_idx"), F.col(code.columns[0]).cast("string").alias("name"))
    return rows.where("protein_idx IS NOT NULL AND name IS NOT NULL").groupBy("protein_idx").agg(F.max("name").alias("name"))


def protein_names(code: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """protein_idx, code, colours, name of ``words`` (rows with protein_idx; all words if not given).

    The name is the colour code's, else Protein_<idx>.
    """
    cols = code_columns(code)
    rows = code_words(code) if words is None else _decoded(words.select("protein_idx"), cols, code_space(code)[1])
    named = attach(rows, named_words(code).withColumnRenamed("name", "_name"), ["protein_idx"], how="left", spread_by=("protein_idx",))
    return named.select(
        "protein_idx", "code", *cols,
        F.coalesce("_name", F.concat(F.lit("Protein_"), F.col("protein_idx"))).alias("name"))


def in_bounds(x: str, y: str, max_size: int = CELL_MAX_SIZE, radius: int = 7) -> Column:
    ok = lambda c: (F.col(c) > radius) & (F.col(c) < max_size - radius)
    return ok(x) & ok(y)


def cell_of_beads(beads: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Beads that lie in a cell (label > 0), with its label."""
    return beads.join(labels.where(F.col("label") > 0).select(*by, "y", "x", "label"), [*by, "y", "x"])


def bead_intensity(
    positions: DataFrame, protein: DataFrame, radius: int = 2, surround: int = 7, by: Sequence[str] = (),
    compat: bool = False,
) -> DataFrame:
    """Adjusted median at each distinct position (x, y): by, x, y, intensity.

    Core: (2 radius + 1) square; surround: the 15 x 15 square without the core. ``compat`` leaves
    out what absolute indices into the cut-out would hit instead of the core. A position outside the image whose surround still
    has samples, but whose core has none, has the intensity NULL; one without any sample gives no row.
    """
    points = positions.select(*by, F.col("y").alias("py"), F.col("x").alias("px")).distinct()
    near = window_join(points, protein, surround, surround + 1, by)
    dy, dx = F.col("y") - F.col("py"), F.col("x") - F.col("px")
    core = (F.abs(dy) <= radius) & (F.abs(dx) <= radius)
    if compat:
        ly, lx = dy + surround, dx + surround
        hole = (F.abs(ly - F.col("py")) <= radius) & (F.abs(lx - F.col("px")) <= radius)
    else:
        hole = core
    v = F.col("v").cast("double")
    g = near.groupBy(*by, "py", "px").agg(
        F.avg(F.when(core, v)).alias("mean"), F.median(F.when(core, v)).alias("med"),
        F.avg(F.when(~hole, v)).alias("around"), F.count(F.lit(1)).alias("n"))
    mean, med, around = F.col("mean"), F.col("med"), F.col("around")
    line = F.lit(LINEAR_SLOPE) * (mean * (mean / around)) + F.lit(LINEAR_OFFSET)
    lifted = F.when((around > SURROUND_RATIO * mean) & (med > CORE_MEDIAN), med - line + LINEAR_SHIFT).otherwise(med)
    floored = F.when(lifted < 1, F.lit(1.0)).otherwise(lifted)
    value = F.when(F.col("n") == 225, floored).otherwise(med)
    return g.select(*by, F.col("px").alias("x"), F.col("py").alias("y"), value.alias("intensity"))


def cell_centroids(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Truncated centroid of each cell: by, label, gx, gy."""
    return labels.where(F.col("label") > 0).groupBy(*by, "label").agg(
        F.avg("x").cast("int").alias("gx"), F.avg("y").cast("int").alias("gy"))


LEVELS = 3


def nearest_site(
    queries: DataFrame, sites: DataFrame, query_key: Sequence[str], on: Sequence[str], cell: int = 16
) -> DataFrame:
    """Exact nearest site (x, y) of each query point (gx, gy) with the same ``on`` values: query_key, on, d2, x, y.

    Whole-number coordinates; ties go to the least (x, y); queries without a site give no row. Distinct sites lie in leaves
    of ``cell`` x ``cell`` pixels, so that a leaf is bounded by its area; leaves have the box that their sites fill, and
    ``LEVELS`` levels of boxes stand over them, with a fan-out that follows from the extent. So the number of rounds is the same
    at every image side. A query starts at the top and goes down into those boxes whose least distance is not
    above the best distance that some box proves (each side of a box touches a site); that leaves out nothing that could
    win. Boxes of one parent travel as an array, leaves as an array of sites, and neither is expanded into rows of
    its own: a leaf asked by most queries is one side row, joined to rows that any number of tasks may hold.
    """
    on, key = list(on), list(query_key)
    sites, seen = store_observed(
        sites.select(*on, F.col("x").cast("long"), F.col("y").cast("long")).distinct(), "sites",
        far=F.max(F.greatest(F.abs("x"), F.abs("y"))))
    fan = 2
    while cell * fan ** LEVELS <= (seen["far"] or 0):
        fan += 1
    side = {"x0": ("min", "x"), "x1": ("max", "x"), "y0": ("min", "y"), "y1": ("max", "y")}
    leaves = sites.groupBy(*on, bucket("y", cell).alias("cy"), bucket("x", cell).alias("cx")).agg(
        *[getattr(F, f)(c).alias(k) for k, (f, c) in side.items()], F.collect_list(F.struct("x", "y")).alias("inside"))
    leaves, _ = store(leaves, "leaves")
    levels, boxes = [], leaves.drop("inside")
    for depth in range(LEVELS):
        top = depth == LEVELS - 1
        over = lambda c: (F.lit(0).cast("long") if top else bucket(c, fan)).alias(f"_{c}")
        grouped = boxes.groupBy(*on, over("cy"), over("cx")).agg(
            *[getattr(F, f)(k).alias(k) for k, (f, _) in side.items()],
            F.collect_list(F.struct("cy", "cx", *side)).alias("kids"), F.count(F.lit(1)).alias("n"))
        stored, about = store_observed(grouped.withColumnsRenamed({"_cy": "cy", "_cx": "cx"}), "boxes", kids=F.sum("n"))
        levels.append((stored.select(*on, "cy", "cx", "kids"), about["kids"] or 0))
        boxes = stored.drop("kids", "n")

    place = [*on, "cy", "cx"]
    rows = queries.select(
        *key, *on, "gx", "gy", *[F.lit(0).cast("long").alias(c) for c in ("cy", "cx", "low")],
        F.lit((1 << 63) - 1).alias("best"))
    for level in reversed(levels):
        kids = attach(rows, level, place, spread_by=("gy", "gx")).drop("cy", "cx", "low").withColumn(
            "kids", F.transform("kids", lambda k: F.struct(k.cy.alias("cy"), k.cx.alias("cx"), *_box_bounds(k))))
        kids = kids.withColumn("best", F.least("best", F.array_min(F.transform("kids", lambda k: k.reach))))
        # the list is cut before it is opened, so that only boxes that may win become rows
        rows = kids.withColumn("kid", F.explode(F.filter("kids", lambda k: k.low <= F.col("best")))).select(
            *key, *on, "gx", "gy", "kid.cy", "kid.cx", "kid.low", "best")
    point = [*key, *on, "gx", "gy"]
    rows = rows.withColumn("best", F.min("best").over(Window.partitionBy(*point))).where(F.col("low") <= F.col("best"))
    # one row per leaf; its size in memory goes by the number of sites
    near = attach(rows, (leaves.select(*place, "inside"), seen["n"]), place, spread_by=("gy", "gx"))
    gx, gy = F.col("gx").cast("long"), F.col("gy").cast("long")
    nearest = F.array_min(F.transform("inside", lambda s: F.struct(
        ((s.x - gx) * (s.x - gx) + (s.y - gy) * (s.y - gy)).alias("d2"), s.x.alias("x"), s.y.alias("y"))))
    return near.groupBy(*point).agg(F.min(nearest).alias("_b")).select(*key, *on, "_b.*")


def _box_bounds(k: Column) -> tuple[Column, Column]:
    """Squared distances from (gx, gy) of a box: below none of its sites lie (low), at most that far lies one (reach)."""
    gx, gy = F.col("gx").cast("long"), F.col("gy").cast("long")

    def along(g: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        outside = F.greatest(lo - g, g - hi, F.lit(0).cast("long"))
        a, b = F.abs(g - lo), F.abs(g - hi)
        return outside, F.least(a, b), F.greatest(a, b)

    out_x, near_x, far_x = along(gx, k.x0, k.x1)
    out_y, near_y, far_y = along(gy, k.y0, k.y1)
    low = out_x * out_x + out_y * out_y
    reach = F.least(near_x * near_x + far_y * far_y, near_y * near_y + far_x * far_x)
    return low.alias("low"), reach.alias("reach")


def check_schema(beads: DataFrame, labels: DataFrame, protein: DataFrame, code: DataFrame) -> None:
    """Columns and types of the four inputs; runs no job."""
    require(labels, "y", "x", "label", name="cell labels")
    require(protein, "y", "x", "v", name="protein image")
    require(beads, "x", "y", *code_columns(code), name="bead table")
    if len(code.columns) < 2:
        raise ValueError("colour code needs a name and at least one cycle column")
    kinds = dict(code.dtypes)
    wrong = [c for c in code_columns(code) if kinds[c] not in ("int", "bigint", "smallint", "tinyint")]
    if wrong:
        raise TypeError(f"colour code column(s) {', '.join(wrong)} must be whole numbers")


def check_inputs(beads: DataFrame, labels: DataFrame, protein: DataFrame, code: DataFrame) -> None:
    """Schema and non-emptiness of the four inputs."""
    check_schema(beads, labels, protein, code)
    for name, df in (("cell labels", labels), ("bead table", beads), ("protein image", protein), ("colour code", code)):
        _not_empty(name, 0 if df.isEmpty() else 1)


def _not_empty(name: str, rows: int) -> None:
    if rows == 0:
        raise ValueError(f"{name} is empty")


def cell_protein_values(
    beads: DataFrame, labels: DataFrame, protein: DataFrame, code: DataFrame, max_size: int = CELL_MAX_SIZE,
    radius: int = 2, surround: int = 7, impute: bool = True, by: Sequence[str] = (), centroids: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(median per cell x protein, centroids, names of the proteins that beads carry); pairs without a value are absent.

    ``centroids`` may come from an earlier run over the same cells.
    """
    by = list(by)
    coded, _ = store(coded_beads(beads.select(*by, "x", "y", *code_columns(code)), code).select(*by, "x", "y", "protein_idx"), "coded")
    ok = in_bounds("x", "y", max_size, surround)
    in_cell = cell_of_beads(coded.where(ok), labels, by)
    cells = cell_centroids(labels, by) if centroids is None else centroids
    cells, n_cells = store(cells, "cells")
    _not_empty("cell labels", n_cells)
    own, _ = store(in_cell.select(*by, "label", "protein_idx", "x", "y"), "in_cell")
    used = own
    if impute:
        # every cell x protein that has a bead somewhere, as an array of these proteins per cell, minus those with a bead in it
        proteins = coded.agg(F.collect_set("protein_idx")).scalar()
        wanted = cells.select(*by, "label", "gx", "gy", F.explode(proteins).alias("protein_idx"))
        gaps = wanted.join(own, [*by, "label", "protein_idx"], "left_anti")
        near = nearest_site(gaps, coded, ["label"], [*by, "protein_idx"])
        used = own.unionByName(near.where(ok).select(*by, "label", "protein_idx", "x", "y"))
    values = bead_intensity(used, protein, radius, surround, by)
    joined = used.join(values, [*by, "x", "y"])
    medians = grouped_median(joined, [*by, "label", "protein_idx"], "intensity", "value")
    return medians, cells, protein_names(code, coded.select("protein_idx").distinct())


def cell_table(
    medians: DataFrame, cells: DataFrame, code: DataFrame, by: Sequence[str] = (), max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Wide table: cell_id, global_x, global_y and a column per protein, NULL where there is none.

    If there are up to ``max_columns`` words, each has a column, named by the colour code or Protein_<idx>. Beyond that the
    words that the code names have one, and the column ``other_proteins`` maps Protein_<idx> to the value for all others that a cell
    has; where more than ``max_columns`` are named it takes these too, as <name>_<idx>, so that keys stay apart. So the width is bounded and no value is
    left out. The driver reads at most ``max_columns`` names.
    """
    by = list(by)
    n_cycles, n_colours = code_space(code)
    every = n_colours ** n_cycles <= max_columns
    named = {r["protein_idx"]: r["name"] for r in named_words(code).limit(max_columns + 1).collect()}
    if every:
        columns = {i: named.get(i, f"Protein_{i}") for i in range(n_colours ** n_cycles)}
    else:
        columns = dict(sorted(named.items())) if len(named) <= max_columns else {}
    first = ["cell_id", "global_x", "global_y"]
    # columns are asked for by number, so that two proteins of one name stay apart
    wide = medians.groupBy(*by, "label").pivot("protein_idx", list(columns)).agg(F.first("value")) if columns else medians.select(
        *by, "label").distinct()
    out = cells.join(wide, [*by, "label"], "left").select(
        *by, F.col("label").alias("cell_id"), F.col("gx").alias("global_x"), F.col("gy").alias("global_y"),
        *[F.col(str(i)).alias(name) for i, name in columns.items()])
    if every:
        return out
    rest = medians.where(~F.col("protein_idx").isin(list(columns))) if columns else medians
    told = attach(rest, named_words(code), ["protein_idx"], how="left", spread_by=("label",))
    label = F.concat_ws("_", F.coalesce("name", F.lit("Protein")), "protein_idx")
    entries = told.groupBy(*by, F.col("label").alias("cell_id")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label.alias("name"), "value")))).alias("other_proteins"))
    inner = [c for c in out.columns if c not in (*by, *first)]
    return out.join(entries, [*by, "cell_id"], "left").select(*by, *first, *[F.col(f"`{c}`") for c in inner], "other_proteins")


def build_cell_table(
    beads: DataFrame, labels: DataFrame, protein: DataFrame, code: DataFrame, **params
) -> DataFrame:
    """Checks, then the whole wide table."""
    code = clean_color_code(code)
    check_schema(beads, labels, protein, code)
    medians, cells, _ = cell_protein_values(beads, labels, protein, code, **params)
    return cell_table(medians, cells, code, params.get("by", ()))
