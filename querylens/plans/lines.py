"""Plan documents (``doc_id, text``) to clean lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions import coerce

_TREE_HEADER = r"^\[([^\]]*)\]:\[([0-9]+)\s*:\s*(.+)\]\z"


def by_doc():
    """A document is one input row, so it fits a task; ``doc_id`` must be unique."""
    return Window.partitionBy("doc_id").orderBy("line_no")


def trim_end(col: Column) -> Column:
    last = F.right(col, F.lit(1))
    return F.when(last.isin(*coerce.TEXT_SPACE), F.rtrim(col, F.lit(coerce.TEXT_SPACE))).otherwise(col)


def _unframed(raw: Column) -> tuple[Column, Column]:
    """Line without the frame, NULL for a rule, and whether it had one; ``raw`` is a column or a lambda's variable."""
    inner = coerce.trim(F.substr(raw, F.lit(2), F.length(raw) - 2))
    rule = F.startswith(raw, F.lit("+")) & raw.rlike(r"^\+.*\+\z") & F.replace(inner, F.lit("+"), F.lit("")).rlike(r"^-+\z")
    cell = F.startswith(raw, F.lit("|")) & F.endswith(raw, F.lit("|"))
    return F.when(rule, F.lit(None).cast("string")).when(cell, inner).otherwise(raw), rule | cell


def plan_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, has_tree, has_views, line_no, line, boxed``: frames that a command-line client draws are taken off.

    Whether a document has a tree line or reports materialised views is asked of the document, while it is one row.
    """
    text = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", r"\r\n?", "\n")).otherwise(F.col("text"))

    def is_tree(raw: Column) -> Column:
        line = coerce.once(trim_end(raw), lambda r: _unframed(r)[0])
        return F.contains(raw, F.lit("]||")) & coerce.once(line, lambda x: _tree_marks(x)[1])

    # a document is small beside the work on its lines, and a file may come as one split
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select("doc_id", "text").repartition(width, "doc_id").select("doc_id", "text", F.split(text, "\n").alias("_all"))
    asked = whole.select(
        "doc_id",
        F.exists("_all", is_tree).alias("has_tree"),
        # the word holds no character that a frame or a line end is made of
        F.contains(F.upper("text"), F.lit("MATERIALIZATION")).alias("has_views"),
        "_all",
    )
    lines = asked.select("doc_id", "has_tree", "has_views", F.posexplode("_all").alias("line_no", "_raw"))
    line, boxed = _unframed(F.col("_raw"))
    return lines.withColumn("_raw", trim_end(F.col("_raw"))).select(
        "doc_id", "has_tree", "has_views", "line_no", line.alias("line"), boxed.alias("boxed")
    )


def tree_rest(line: Column) -> Column:
    return F.ltrim(F.when(F.startswith(line, F.lit("-")), F.regexp_replace(line, "^-+", "")).otherwise(line))


def _tree_marks(line: Column) -> tuple[Column, Column]:
    """Whether a line looks like a tree node, and whether it is one."""
    rest = tree_rest(line)
    looks = F.coalesce(F.contains(line, F.lit("]||")) & F.startswith(rest, F.lit("[")) & F.contains(rest, F.lit("]||")), F.lit(False))
    header = F.when(looks, coerce.trim(F.substring_index(rest, "||", 1)))
    return looks, F.coalesce(header.rlike(_TREE_HEADER), F.lit(False))


def with_form(lines: DataFrame) -> DataFrame:
    """Add ``is_tree_line`` (a tree node), ``bad_header`` and ``form`` (tree wins over plan)."""
    looks, known = _tree_marks(F.col("line"))
    marked = lines.withColumn("_looks", looks).withColumn("is_tree_line", known)
    marked = marked.withColumn("bad_header", F.col("_looks") & ~F.col("is_tree_line")).drop("_looks")
    return marked.withColumn("form", F.when(F.col("has_tree"), "tree").otherwise("plan")).drop("has_tree")


def tree_segments(line: Column) -> Column:
    return F.filter(F.transform(F.split(tree_rest(line), r"\|\|"), coerce.trimmed), lambda s: s != "")


def tree_header(segments: Column) -> tuple[Column, Column, Column]:
    """Ids text, node id and operator."""
    header = F.get(segments, F.lit(0))
    ids, node, op = (F.regexp_extract(header, _TREE_HEADER, i) for i in (1, 2, 3))
    return ids, node.try_cast("bigint"), coerce.trim(op)
