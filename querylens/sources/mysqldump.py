"""SQL dump of the audit table: ``INSERT`` statements with many tuples each.

No statement is ever put together. The text is cut after every ``)`` and ``;`` outside strings, so that a part is the head of a
statement or one tuple; only a part that crosses a line is joined. What a part means follows from the head of its statement,
which is carried forward over any number of parts and runs of lines. A statement may thus be as long as a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.functions import coerce, encode, sqltext
from querylens.ordering import Buckets, assemble, before_buckets
from querylens.session import broadcast_if_small, stage
from querylens.sources.columns import (
    DUMP_ALIASES,
    default_positions,
    field_keys,
    field_positions,
    field_texts,
    named_texts,
    typed_columns,
)
from querylens.sources.lines import LINES, read_lines

SNIPPET_CHARS = 200

_S = coerce.SPACE
# The grammar of a dump; loops are possessive, so that texts of any length match.
_INSERT = rf"insert(?:{_S}++(?:low_priority|delayed|high_priority|ignore))*+{_S}++into"
_TABLE = rf"(?:(?:`[^`]+`|[A-Za-z0-9_$]+){_S}*\.{_S}*)?`?audit_log`?(?:{_S}|\(|\z)"
AUDIT_INSERT = rf"(?i)^{_S}*+{_INSERT}{_S}++{_TABLE}"
# A dump is recognised by an INSERT or CREATE TABLE of the audit table at the start of a line.
AUDIT_MARKER = rf"(?i)(?:^|[\r\n]){_S}*+(?:{_INSERT}|create{_S}++table){_S}++{_TABLE}"

# Statements a dump client issues itself, lower case.
NOISE_PREFIXES = (
    "select @@version_comment limit 1",
    "select $$",
    "show variables like ",
    "show tables like ",
    "show fields from `audit_log`",
    "show table status like ",
    "set session net_read_timeout",
    "set session transaction isolation level",
)

_CLOSED = r"(?:[^']+|'(?:[^'\\]+|\\.)*+')*+"
_TO_QUOTE = r"(?:[^'\\]+|\\.)*+'"

_NAME = r"(?:`(?:[^`]++|``)*+`|[A-Za-z0-9_$]++)"
_TARGET = rf"(?is)^{_S}*+{_INSERT}{_S}++(?:{_NAME}{_S}*+\.{_S}*+)?{_NAME}{_S}*+"
_COLUMNS = rf"(?:\((?:{_S}*+{_NAME}{_S}*+(?:,|(?=\))))*+{_S}*+\))"
_VALUES = rf"{_S}*+values(?![A-Za-z0-9_$])"
_VALUE = rf"(?:'(?:[^'\\]+|\\.|'')*+'|(?!{_S})[^',)][^,)]*+)"
_TUPLE = rf"\({_S}*+(?:{_VALUE}{_S}*+,{_S}*+)*+(?:{_VALUE}{_S}*+)?\)"
_PIECE = r"(?s)(?:[^';)`]+|'(?:[^'\\]+|\\.)*+(?:'|\z)|`[^`';\n]*+`|`)*+(?:[;)]|\z)"


def quote_state(lines: DataFrame) -> DataFrame:
    """Add ``in_string``: whether a line begins inside a string literal.

    A line maps the state it starts in to the state it ends in. The map either fixes the end state,
    keeps it, or flips it; the state before a line is the last fixed one, flipped as often as lines
    since then flip. Only the last fixed state and a flip count cross the borders of runs.
    """
    text = F.concat(F.col("value"), F.lit("\n"))
    from_outside = text.rlike(rf"(?s)^{_CLOSED}'").cast("int")
    from_inside = (~text.rlike(rf"(?s)^{_TO_QUOTE}{_CLOSED}\z")).cast("int")
    marked = lines.withColumn("_f0", from_outside).withColumn("_f1", from_inside)
    fixes = F.col("_f0") == F.col("_f1")
    flips = (F.col("_f0") == 1) & (F.col("_f1") == 0)
    marked = marked.withColumn("_flip", flips.cast("bigint")).withColumn("_fix", F.when(fixes, F.col("_f0")))

    rows = LINES.rows()
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_flips", F.sum("_flip").over(upto))
    marked = marked.withColumn("_fixed", F.when(F.col("_fix").isNotNull(), F.struct("_fix", "_flips")))
    local = marked.withColumn("_last", F.last("_fixed", ignorenulls=True).over(before)).withColumn(
        "_flips_before", F.col("_flips") - F.col("_flip")
    )

    # What one run does to the state, then the state every run starts in.
    per_run = marked.groupBy(*LINES.keys).agg(
        F.max(F.struct(F.col("line_key"), F.col("_flips"))).alias("_end"),
        F.max(F.when(F.col("_fix").isNotNull(), F.struct("line_key", "_fix", "_flips"))).alias("_fixed_end"),
    )
    after_fix = F.col("_end._flips") - F.col("_fixed_end._flips")
    per_run = per_run.select(
        *LINES.keys,
        F.when(F.col("_fixed_end").isNotNull(), (F.col("_fixed_end._fix") + after_fix) % 2).alias("_set"),
        F.when(F.col("_fixed_end").isNull(), F.col("_end._flips")).otherwise(0).alias("_turns"),
    )
    per_run = before_buckets(per_run, LINES, sums={"_turned": F.col("_turns")})
    setting = F.when(F.col("_set").isNotNull(), F.struct("_set", F.col("_turned").alias("_at")))
    per_run = before_buckets(per_run, LINES, lasts={"_earlier": setting})
    turned = F.col("_turned") - F.coalesce(F.col("_earlier._at"), F.lit(0))
    starts = per_run.select(
        *LINES.keys, ((F.coalesce(F.col("_earlier._set"), F.lit(0)) + turned) % 2).alias("_entry")
    )
    state = F.when(
        F.col("_last").isNotNull(), (F.col("_last._fix") + F.col("_flips_before") - F.col("_last._flips")) % 2
    ).otherwise((F.col("_entry") + F.col("_flips_before")) % 2)
    return local.join(starts, LINES.keys).select(
        *LINES.keys, "line_key", "value", (state == 1).alias("in_string")
    )


_FRAGMENTS = Buckets(LINES.group, LINES.bucket, ("line_key", "pos"))
_PARTS = Buckets(LINES.group, LINES.bucket, ("part",))
#: About what the first error of a statement takes in memory.
_ERROR_BYTES = 256


def parts(lines: DataFrame) -> DataFrame:
    """``file, split_start, run, part, text``: the text cut after ``)`` and ``;`` outside strings; ``part`` counts in the file, ``split_start`` and ``run`` are those of its first line."""
    text = F.concat(F.col("value"), F.lit("\n"))
    opened = r"(?s)^(?:[^'\\]+|\\.)*+(?:'|\z)"
    lead = F.when(F.col("in_string"), F.regexp_extract(text, opened, 0)).otherwise(F.lit(""))
    pieces = F.regexp_extract_all(F.substr(text, F.length(lead) + 1), F.lit(_PIECE), 0)
    # The rest of a line ends with its line break, so only closed pieces end with one of the two signs.
    fragments = (
        quote_state(lines)
        .withColumn("_lead", lead)
        .withColumn("_pieces", pieces)
        .select(*LINES.keys, "line_key", "_lead", F.posexplode("_pieces").alias("pos", "_p"))
        .select(
            *LINES.keys,
            "line_key",
            "pos",
            F.when(F.col("pos") == 0, F.concat("_lead", "_p")).otherwise(F.col("_p")).alias("piece"),
            (F.endswith("_p", F.lit(";")) | F.endswith("_p", F.lit(")"))).alias("closes"),
        )
    )
    rows = _FRAGMENTS.rows().rowsBetween(Window.unboundedPreceding, -1)
    numbered = fragments.withColumn("local_seq", F.coalesce(F.sum(F.col("closes").cast("bigint")).over(rows), F.lit(0)))
    whole = assemble(numbered, _FRAGMENTS, "piece", "local_seq", "closes")
    return whole.select(*LINES.keys, F.col("record_seq").alias("part"), "text")


def _head(text: Column) -> Column:
    """What the first part of a statement says: whether it inserts into the audit table, whether a column list or the first tuple
    ends it, the columns of the fields, and what is wrong with it."""
    target = F.regexp_replace(text, _TARGET, "")
    listed = F.regexp_extract(text, rf"{_TARGET}({_COLUMNS})\z", 1)
    names = F.transform(
        F.regexp_extract_all(listed, F.lit(rf"(?s){_NAME}"), 0),
        lambda n: F.replace(F.regexp_replace(n, r"^`|`\z", ""), F.lit("``"), F.lit("`")),
    )
    reason = (
        F.when(~text.rlike(_TARGET), F.lit("no table is named after INSERT INTO"))
        .when((listed != "") | text.rlike(rf"{_TARGET}{_VALUES}"), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("(")) & ~target.rlike(rf"(?s)^{_COLUMNS}"), F.lit("column list cannot be read"))
        .otherwise(F.lit("VALUES is missing"))
    )
    positions = F.when(F.size(names) > 0, field_positions(field_keys(names, DUMP_ALIASES))).otherwise(default_positions())
    matched = text.rlike(AUDIT_INSERT)
    return F.struct(
        matched.alias("matched"),
        F.when(matched, listed != "").alias("listed"),
        F.when(matched, positions).alias("positions"),
        F.when(matched, reason).alias("reason"),
    )


def statement_parts(cut: DataFrame) -> DataFrame:
    """``file, split_start, run, part, statement_seq, idx, head, text`` of cut text; ``idx`` counts the parts of a statement, ``head`` is that of its first part.

    Windows stay inside a run of lines. One row per run says how many statements end in it, where the one still open
    begins and what its head is; these rows carry that to the runs behind.
    """
    rows = _PARTS.rows()
    before, upto = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("_ends", F.endswith("text", F.lit(";"))).withColumn("_mine", F.struct("part", _head(F.col("text")).alias("head")))
    marked = marked.withColumn("_opens", F.when(F.lag("_ends").over(rows), F.col("_mine")))
    local = marked.select(
        *LINES.keys,
        "part",
        "text",
        "_ends",
        "_opens",
        F.coalesce(F.sum(F.col("_ends").cast("bigint")).over(before), F.lit(0)).alias("_seq"),
        F.last("_opens", ignorenulls=True).over(upto).alias("_open"),
        F.first("_mine").over(upto).alias("_lead"),
    )
    runs = local.groupBy(*LINES.keys).agg(
        F.count_if("_ends").alias("_n"),
        F.max(F.when(F.col("_ends"), F.col("part") + 1)).alias("_last"),
        F.max_by("_open", "part").alias("_open"),
        F.min_by("_lead", "part").alias("_first"),
    )
    runs = before_buckets(runs, LINES, sums={"_seq_before": F.col("_n")}, lasts={"_start": F.col("_last")})
    runs = runs.withColumn("_start", F.coalesce("_start", F.lit(0)))
    begun = F.when(F.col("_open.part") == F.col("_last"), F.col("_open")).when(
        F.col("_last").isNull() & (F.col("_first.part") == F.col("_start")), F.col("_first")
    )
    carried = before_buckets(runs, LINES, lasts={"_carried": begun}).select(*LINES.keys, "_seq_before", "_start", "_carried")
    opened = F.coalesce("_open", F.when(F.col("_lead.part") == F.col("_start"), F.col("_lead")).otherwise(F.col("_carried")))
    return local.join(carried, LINES.keys).select(
        *LINES.keys,
        "part",
        (F.col("_seq_before") + F.col("_seq")).alias("statement_seq"),
        (F.col("part") - opened["part"]).alias("idx"),
        opened["head"].alias("head"),
        "text",
    )


def read_parts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The parts of all dumps, staged: every result is built from that table."""
    return stage(statement_parts(stage(parts(read_lines(spark, paths)), "dump-cuts")), "dump-parts")


def statement_count(read: DataFrame) -> DataFrame:
    """``file, statements_scanned``: all statements but an empty rest of a file."""
    some = F.when(coerce.trim(F.col("text")) != "", F.col("statement_seq"))
    return read.groupBy("file").agg((F.coalesce(F.max(some), F.lit(-1)) + 1).alias("statements_scanned"))


def snippet(text: Column) -> Column:
    return F.left(coerce.collapse_space(text), F.lit(SNIPPET_CHARS))


def _bodies(read: DataFrame) -> DataFrame:
    """Parts of audit-table INSERTs from the first tuple on: ``tuple_pos``, ``body``, whether the body is a tuple, and else what is wrong."""
    rows = read.where("head.matched AND head.reason IS NULL").withColumn("tuple_pos", F.col("idx") - F.col("head.listed").cast("int"))
    rows = rows.where("tuple_pos >= 0")
    lead = F.when(F.col("head.listed"), F.regexp_replace("text", rf"(?is)^{_VALUES}", "")).otherwise(F.regexp_replace("text", rf"{_TARGET}{_VALUES}", ""))
    first = F.col("tuple_pos") == 0
    rows = rows.withColumn("body", F.when(first, lead).otherwise(F.col("text")))
    unvalued = first & F.col("head.listed") & (F.col("body") == F.col("text"))
    tuple_ = F.when(first, F.col("body").rlike(rf"(?s)^{_S}*+{_TUPLE}\z")).otherwise(F.col("body").rlike(rf"(?s)^{_S}*+,{_S}*+{_TUPLE}\z"))
    text = coerce.trim(F.col("body"))
    comma = F.startswith(text, F.lit(","))
    rest = F.when(~first & comma, coerce.trim(F.substr(text, F.lit(2)))).otherwise(text)
    reason = (
        F.when(unvalued, F.lit("VALUES is missing"))
        .when(F.col("is_tuple") | (rest == "") | F.startswith(rest, F.lit(";")), F.lit(None).cast("string"))
        .when(~first & ~comma, F.lit("something else than a comma or the end follows a tuple"))
        .when(F.startswith(rest, F.lit("(")), F.lit("tuple cannot be read"))
        .otherwise(F.lit("no tuple begins where one should"))
    )
    return rows.withColumn("is_tuple", tuple_ & ~unvalued).withColumn("reason", reason)


def _errors(read: DataFrame) -> DataFrame:
    """First error of each statement that has one behind its head."""
    bad = _bodies(read).where(F.col("reason").isNotNull())
    first = F.min(F.struct("tuple_pos", "reason", F.col("text").alias("stopped_at")))
    return bad.groupBy("file", "statement_seq").agg(first.alias("_error")).select("file", "statement_seq", "_error.*")


def parse_inserts(read: DataFrame) -> DataFrame:
    """One row per audit-table INSERT: ``positions`` of its columns, and if it is bad why, and the whole part where reading stopped."""
    heads = read.where("idx = 0 AND head.matched")
    errors = _errors(read).select("file", "statement_seq", F.col("reason").alias("_reason"), "stopped_at")
    return heads.join(errors, ["file", "statement_seq"], "left").select(
        *LINES.keys,
        "statement_seq",
        "head.positions",
        F.coalesce("head.reason", "_reason").alias("reason"),
        snippet(F.col("text")).alias("snippet"),
        F.when(F.col("head.reason").isNotNull(), F.col("text")).otherwise(F.col("stopped_at")).alias("stopped_at"),
    )


def rejects(inserts: DataFrame) -> DataFrame:
    return inserts.where(F.col("reason").isNotNull()).select("file", "statement_seq", "reason", "snippet", "stopped_at")


def tuples(read: DataFrame) -> DataFrame:
    """``file, split_start, run, statement_seq, tuple_pos, positions, body``: the tuples before a statement's first error."""
    errors = stage(_errors(read).select("file", "statement_seq", F.col("tuple_pos").alias("_stop")), "dump-errors")
    rows = _bodies(read).where("is_tuple").join(broadcast_if_small(errors, _ERROR_BYTES), ["file", "statement_seq"], "left")
    rows = rows.where(F.col("_stop").isNull() | (F.col("tuple_pos") < F.col("_stop")))
    return rows.select(*LINES.keys, "statement_seq", "tuple_pos", "head.positions", F.regexp_replace("body", rf"^{_S}*+,?+{_S}*+\(", "").alias("body"))


def _token_text(token: Column) -> Column:
    """Text of one dumped value, before it is trimmed."""

    def unquoted(bare: Column) -> Column:
        return (
            F.when(bare.rlike(r"^-?[0-9]+\z"), F.coalesce(bare.try_cast("bigint").cast("string"), bare))
            .when(
                bare.rlike(r"^-?[0-9]+\.[0-9]+\z"),
                F.regexp_replace(F.regexp_replace(bare, r"^(-?)0+(?=[0-9])", "$1"), r"\.?0+\z", ""),
            )
            .when(F.lower(bare).isin("true", "false"), F.lower(bare))
            .otherwise(bare)
        )

    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    escaped = F.contains(token, F.lit("\\")) | F.contains(inner, F.lit("''"))
    quoted = F.when(escaped, encode.decode_dump_string(inner)).otherwise(inner)
    return F.when(F.startswith(token, F.lit("'")), quoted).otherwise(coerce.once(coerce.trim(token), unquoted))


#: What makes a dumped value a text, one step after the other; blank text and the word ``null`` are NULL.
_TOKEN_STEPS = (_token_text, coerce.trimmed, lambda t: F.when((t != "") & (F.lower(t) != "null"), t))


def tuple_records(read: DataFrame, tz: str = "UTC", rules: Sequence[sqltext.StrippingRule] = sqltext.DEFAULT_RULES) -> DataFrame:
    """One parsed row per tuple, in file order."""
    values = F.regexp_extract_all("body", F.lit(rf"(?s){_VALUE}"), 0)
    rows = tuples(read).withColumn("_values", values)

    place = [*LINES.keys, "statement_seq", "tuple_pos"]
    rows = rows.withColumn("_texts", field_texts(F.col("_values"), F.col("positions"), _TOKEN_STEPS))
    timed = rows.select(*place, *named_texts("_texts")).withColumn("_time", coerce.time_digits(F.col("time")))
    parsed = timed.select(*place, *typed_columns(tz))
    return parsed.withColumn("is_noise", is_noise(F.col("stmt_raw"))).withColumn(
        "template", sqltext.template_of(F.col("stmt_raw"), rules)
    )


def is_noise(stmt: Column) -> Column:
    text = F.lower(coerce.trim(stmt))
    hit = F.lit(False)
    for prefix in NOISE_PREFIXES:
        hit = hit | F.startswith(text, F.lit(prefix))
    return F.coalesce(hit, F.lit(False))
