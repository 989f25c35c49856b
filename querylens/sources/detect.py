"""Which of the three formats a file is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.functions import coerce
from querylens.ordering import running_total
from querylens.sources.lines import LINES
from querylens.sources.mysqldump import AUDIT_MARKER
from querylens.sources.outfile import line_delimiter

FE_LOG, OUTFILE, MYSQL_DUMP = "feAuditLog", "auditLogOutfileCsv", "auditLogMysqlDump"
HEAD_BYTES = 256 * 1024

# Keys that give a server log away.
FE_MARKERS = ("|Stmt=", "|QueryId=", "|Time(ms)=")
# How lines of an SQL script begin.
_SCRIPT_LINE = (
    rf"(?i)^[{coerce.SPACE_CLASS}]*(?:/\*![0-9]{{5}}[{coerce.SPACE_CLASS}]|/\*|--[{coerce.SPACE_CLASS}]|#"
    rf"|insert[{coerce.SPACE_CLASS}]+|create[{coerce.SPACE_CLASS}]+table|lock[{coerce.SPACE_CLASS}]+tables"
    rf"|unlock[{coerce.SPACE_CLASS}]+tables|set[{coerce.SPACE_CLASS}]+)"
)


def detect_formats(lines: DataFrame) -> DataFrame:
    """``file, format, delimiter`` for every file with at least one line.

    Server-log keys in the first 256 KiB win, then a dump marker there, then the delimiter of the
    first line there that shows one: an export may begin with lines that are too short, but not with those
    of a script. A marker further on counts only for files that look like a script and not like a
    tab-delimited export. Places are counted in bytes of the file, whatever its splits.
    """
    sized = lines.where(F.col("split_start") < HEAD_BYTES).withColumn("_size", F.octet_length("value") + 1)
    head = (
        running_total(sized, LINES, F.col("_size"), "_end")
        .withColumn("_offset", F.col("_end") - F.col("_size"))
        .where(F.col("_offset") < HEAD_BYTES)
        .withColumn("value", F.left(F.col("value").cast("binary"), (F.lit(HEAD_BYTES) - F.col("_offset")).cast("int")).cast("string"))
    )
    fe_marker = F.lit(False)
    for marker in FE_MARKERS:
        fe_marker = fe_marker | F.contains("value", F.lit(marker))
    shown = head.withColumn("_delimiter", F.when(~fe_marker, line_delimiter(coerce.trim(F.col("value")))))
    by_head = shown.groupBy("file").agg(
        F.bool_or(fe_marker).alias("fe"),
        F.bool_or(F.col("value").rlike(AUDIT_MARKER)).alias("dump_head"),
        F.min(F.when(F.col("_delimiter").isNotNull(), F.struct("split_start", "line_key", "_delimiter"))).alias("_wide"),
        F.min(F.when(F.col("value").rlike(_SCRIPT_LINE), F.struct("split_start", "line_key"))).alias("_script"),
    )
    by_file = lines.groupBy("file").agg(
        F.bool_or(F.col("value").rlike(AUDIT_MARKER)).alias("dump_any"),
        F.bool_or(F.col("value").rlike(_SCRIPT_LINE)).alias("script"),
    )
    after_script = F.coalesce(F.struct("_wide.split_start", "_wide.line_key") > F.col("_script"), F.lit(False))
    found = by_file.join(by_head, "file", "left").withColumn("delimiter", F.when(~after_script, F.col("_wide._delimiter")))
    not_tab = F.col("delimiter").isNull() | (F.col("delimiter") == ",")
    chosen = (
        F.when(F.col("fe"), FE_LOG)
        .when(F.col("dump_head") | (F.col("script") & not_tab & F.col("dump_any")), MYSQL_DUMP)
        .when(F.col("delimiter").isNull(), FE_LOG)
        .otherwise(OUTFILE)
    )
    return found.select(
        "file", chosen.alias("format"), F.when(chosen == OUTFILE, F.col("delimiter")).alias("delimiter")
    )
