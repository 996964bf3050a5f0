"""Operators on pages and their parts: repeated boundary lines, images, the order of mixed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeating_lines(pages: DataFrame, group: str, page: str, text: str = "text", share: float = 0.6, least: int = 2, min_pages: int = 4, max_chars: int = 80) -> DataFrame:
    """group, line, n_pages: first and last non-blank lines that enough of a group's pages have.

    The boundary lines are found inside each row, so only two short lines a page are shuffled.
    """
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    edges = pages.select(group, page, filled.alias("f")).filter("size(f) > 0").select(group, page, F.explode(F.array_distinct(F.array(F.element_at("f", 1), F.element_at("f", -1)))).alias("line"))
    counted = edges.filter(F.char_length("line") <= max_chars).groupBy(group, "line").agg(F.countDistinct(page).alias("n_pages"))
    size = edges.groupBy(group).agg(F.countDistinct(page).alias("_pages"))
    return counted.join(size, group).filter((F.col("_pages") >= min_pages) & (F.col("n_pages") >= F.greatest(F.lit(float(least)), share * F.col("_pages")))).select(group, "line", "n_pages")


def without_lines(pages: DataFrame, repeated: DataFrame, group: str, text: str = "text") -> DataFrame:
    """pages whose text lacks the repeated lines of their group at either end: its first and its last line that isn't blank."""
    by = repeated.groupBy(group).agg(F.collect_set("line").alias("_gone"))
    lines = F.split(text, "\n")
    filled = F.transform(lines, lambda x: F.trim(x) != "")
    first, last = F.array_position(filled, True), F.size(lines) + 1 - F.array_position(F.reverse(filled), True)
    kept = F.filter(lines, lambda x, i: ~(F.array_contains(F.coalesce(F.col("_gone"), F.array().cast("array<string>")), x) & ((i + 1 == first) | (i + 1 == last))))
    return pages.join(by, group, "left").withColumn(text, F.array_join(kept, "\n")).drop("_gone")


def select_images(images: DataFrame, least_pages: int = 2, most: int = 50) -> DataFrame:
    """Embedded images worth keeping: large enough, not on half of the pages, once a page, the first ones by ord."""
    pages = images.groupBy("doc").agg(F.countDistinct("page").alias("_pages"))
    spread = images.groupBy("doc", "hash").agg(F.countDistinct("page").alias("_on"))
    banned = spread.join(pages, "doc").filter((F.col("_on") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * 0.5))) & (F.col("_on") >= least_pages)).select("doc", "hash")
    large = images.filter((F.col("area") >= 0.01) & (F.col("width") >= 80) & (F.col("height") >= 80)).join(banned, ["doc", "hash"], "left_anti")
    once = large.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "page", "hash").orderBy("ord"))).filter("_n = 1").drop("_n")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).filter(F.col("_r") <= most).drop("_r")


def assemble(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """The chunks of all kinds with kind and kind_rank; their order is (seq_num, kind_rank)."""
    kinds = [x.withColumn("kind", F.lit(k)).withColumn("kind_rank", F.lit(i)) for i, (k, x) in enumerate((("text", texts), ("table", tables), ("image", images)))]
    return kinds[0].unionByName(kinds[1], True).unionByName(kinds[2], True)


def reading_columns(boxes: DataFrame, page: str = "page_id", gap: float = 12.0) -> DataFrame:
    """boxes (page, x0, x1) with the number of their column: columns part where no box bridges a gap."""
    w = Window.partitionBy(page).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_new", F.coalesce(F.col("x0") - before > gap, F.lit(False)).cast("int")).withColumn("column_no", F.sum("_new").over(w)).drop("_new")


def merge_table_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """doc, page, text: neighbouring pages joined while a table runs over their boundary, under the first one's number."""
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    row = lambda x: F.coalesce(x.rlike(r"^\s*\|.*\|\s*$"), F.lit(False))
    w = Window.partitionBy(doc).orderBy(page)
    marked = pages.withColumn("_f", filled).withColumn("_starts", row(F.get("_f", F.lit(0)))).withColumn("_ends", row(F.get("_f", F.size("_f") - 1)))
    new = ~(F.col("_starts") & F.coalesce(F.lag("_ends").over(w), F.lit(False)))
    runs = marked.withColumn("_run", F.sum(new.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return runs.groupBy(doc, "_run").agg(F.min(page).alias(page), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias(text)).drop("_run")


# What is left of charts in extracted text: bare numbers, scales, layers and error axes; rows of ticks.
DEBRIS = r"(?i)^\s*(?:[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?%?|\d+-layer|iter\.\s*\(1e\d\)|(?:training |test )?error\s*\(%\))\s*$"
TICKS = r"^[\d\s.()-]+$"


def debris(c: Column) -> Column:
    """Whether a line is left of a chart; so are short rows of at least three digits, such as an axis's ticks."""
    t = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return t.rlike(DEBRIS) | (t.rlike(TICKS) & (F.char_length(t) <= 24) & (F.regexp_count(t, F.lit(r"\d")) >= 3))


def strip_chart_debris(lines: DataFrame, doc: str = "doc_id", place: str = "line_no", line: str = "line", least: int = 3) -> DataFrame:
    """lines without runs of at least that many debris or blank lines that begin with a debris line."""
    w = Window.partitionBy(doc).orderBy(place)
    marked = lines.withColumn("_d", debris(F.col(line))).withColumn("_b", F.trim(line) == "").withColumn("_in", F.col("_d") | F.col("_b"))
    runs = marked.withColumn("_run", F.sum((~(F.col("_in") & F.coalesce(F.lag("_in").over(w), F.lit(False)))).cast("int")).over(w))
    g = Window.partitionBy(doc, "_run").orderBy(place)
    started = runs.withColumn("_seen", F.max(F.col("_d").cast("int")).over(g))  # blank lines before a run's first debris stay
    sized = started.withColumn("_n", F.sum(F.col("_seen")).over(Window.partitionBy(doc, "_run")))
    return sized.filter(~(F.col("_in") & (F.col("_seen") == 1) & (F.col("_n") >= least))).select(*lines.columns)


def outside_boxes(points: DataFrame, boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """points (page, x, y) that lie in no box (page, x0, y0, x1, y1) of their page."""
    inside = (F.col("b.x0") <= F.col("p.x")) & (F.col("p.x") <= F.col("b.x1")) & (F.col("b.y0") <= F.col("p.y")) & (F.col("p.y") <= F.col("b.y1"))
    return points.alias("p").join(boxes.alias("b"), (F.col(f"p.{page}") == F.col(f"b.{page}")) & inside, "left_anti")


def model_limits(models: DataFrame, patterns: DataFrame, ratio: float = 0.75, default: int = 8192, least: int = 512) -> DataFrame:
    """model, max_tokens: by exact name, else the longest pattern with * that fits, else the default; patterns are a short list."""
    p = patterns.select("pattern", "context")
    like = F.expr("model like replace(pattern, '*', '%')")
    found = models.join(F.broadcast(p), like, "left")  # a registry of models
    best = found.groupBy("model").agg(F.max_by("context", F.struct(F.col("pattern") == F.col("model"), F.char_length("pattern"), "pattern")).alias("context"))
    return best.select("model", F.greatest(F.lit(least), F.floor(F.coalesce("context", F.lit(default)) * ratio).cast("int")).alias("max_tokens"))


# Patterns of captions and of lines that figures leave behind.
CAPTION, CAPTION_HEAD = r"(?i)\bFigure\s+\d+\b", r"(?i)^Figure\s+\d+\b"
MARGIN = r"(?i)^(?:arXiv:\s*\S+|\d{1,3}$)"


def inside_figure(c: Column) -> Column:
    """Whether a line right above a caption belongs to the figure: a label, a tick or a margin line, not prose."""
    t = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    n, words = F.char_length(t), F.size(F.split(t, r"(?U)\s+"))
    prose = ((n >= 48) & (words >= 8)) | (t.rlike("[.。!?！]$") & (n >= 15)) | (words >= 7) | (n > 40)
    return (t != "") & ~t.rlike(CAPTION_HEAD) & (t.rlike(MARGIN) | (~((n >= 48) & (words >= 8)) & debris(t)) | ~prose)


def without_figure_lines(lines: DataFrame, doc: str = "doc_id", place: str = "line_no", line: str = "line") -> DataFrame:
    """lines without those of a figure's inside that stand directly above a line that names a figure.

    A line goes if the first later line that is a caption or isn't of a figure's inside is a caption.  Null and blank lines
    are kept and end a figure.
    """
    after = Window.partitionBy(doc).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    c = F.coalesce(line, F.lit(""))
    marked = lines.withColumn("_in", inside_figure(c)).withColumn("_cap", c.rlike(CAPTION))
    stops = marked.withColumn("_next", F.last(F.when(F.col("_cap") | ~F.col("_in"), F.col("_cap")), ignorenulls=True).over(after))
    return stops.filter(~(F.col("_in") & F.coalesce("_next", F.lit(False)))).select(*lines.columns)


def image_size(c: Column) -> tuple[Column, Column]:
    """Width and height in the heads of PNG and GIF files, null for others."""
    number = lambda *at: F.conv(F.concat(*(F.hex(F.substring(c, i, 1)) for i in at)), 16, 10).cast("int")
    head = F.hex(F.substring(c, 1, 8))
    png, gif = (head == "89504E470D0A1A0A") & (F.octet_length(c) >= 24), head.startswith("474946383") & (F.octet_length(c) >= 10)
    return tuple(F.when(png, number(*p)).when(gif, number(*g)) for p, g in (((17, 18, 19, 20), (8, 7)), ((21, 22, 23, 24), (10, 9))))


def is_icon(width: Column, height: Column, n_bytes: Column, side: int = 64, least_bytes: int = 512) -> Column:
    """Whether an image is too small to mean anything: both sides under side, or few bytes where its size isn't known."""
    return F.when(width.isNotNull() & height.isNotNull(), (width < side) & (height < side)).otherwise(n_bytes < least_bytes)
