"""Statement text to template: literal removal, named stripping rules, table guess.

Every pattern is possessive or free of alternation inside a loop, so that a statement of any length
is matched without deep recursion in the regex engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.coerce import collapse_space, non_blank, trim

# ASCII word boundaries; the engine's own \b also knows Unicode letters.
# The normalisation rules of templates; loops are possessive, word borders ASCII.
_WORD_START = "(?<![A-Za-z0-9_])"
_WORD_END = "(?![A-Za-z0-9_])"
# The first character comes before the look behind it, so that most places are settled by one comparison.
_LIST = r"\s*+\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
_NOT_IN_LIST = rf"(?i)N(?<![A-Za-z0-9_]N)OT\s++IN{_LIST}"
_IN_LIST = rf"(?i)I(?<![A-Za-z0-9_]I)N{_LIST}"
_STRING = r"(?:'[^']*+')++"
_NUMBER = rf"[0-9](?<![A-Za-z0-9_][0-9])[0-9]*(?:\.[0-9]+)?{_WORD_END}"

_CTE_NAME = rf"(?i)(?:^|{_WORD_START}with{_WORD_END}|,)\s*([a-zA-Z0-9_]+)\s+as\s*\("
_NAME_PART = r"(?:`[^`]+`|[a-zA-Z0-9_$]+)"
_FROM_NAME = rf"(?i){_WORD_START}from\s+({_NAME_PART}(?:\s*\.\s*{_NAME_PART})*)"


@dataclass(frozen=True)
class StrippingRule:
    """One rewrite of a template at every place that matches; rules run in list order.

    ``flags``: i ignores case, m lets ``^`` and ``$`` match at lines, s lets the dot match line ends. The
    replacement may name groups of the pattern as ``$1``.
    """

    name: str
    pattern: str
    replacement: str = ""
    flags: str = "i"

    def __post_init__(self) -> None:
        if set(self.flags) - set("ims"):
            raise ValueError(f"unknown flags of rule {self.name}: {self.flags}")

    def applied_to(self, text: Column) -> Column:
        inline = f"(?{self.flags})" if self.flags else ""
        return F.regexp_replace(text, f"{inline}{self.pattern}", self.replacement)


# Predicates that say nothing about the workload.
DEFAULT_RULES: tuple[StrippingRule, ...] = (
    StrippingRule("strip_soft_delete_flag", r"\s+and\s+is_deleted\s*=\s*\?"),
    StrippingRule("strip_tenant_id", r"\s+and\s+tenant_id\s*=\s*\?"),
)


def normalize_statement(stmt: Column) -> Column:
    """White space collapsed, value lists, string literals and numbers replaced, in this order.

    No replacement begins or ends with white space, so the text stays collapsed.
    """
    out = collapse_space(stmt)
    out = F.regexp_replace(out, _NOT_IN_LIST, "NOT IN (?)")
    out = F.regexp_replace(out, _IN_LIST, "IN (?)")
    out = F.regexp_replace(out, _STRING, "?")
    return F.regexp_replace(out, _NUMBER, "?")


def strip_template(base: Column, rules: Sequence[StrippingRule] = DEFAULT_RULES) -> Column:
    out = base
    for rule in rules:
        out = rule.applied_to(out)
    return F.when(out == base, base).otherwise(collapse_space(out))


def applied_rules(base: Column, rules: Sequence[StrippingRule] = DEFAULT_RULES) -> Column:
    """Names of the rules that changed the template, in rule order."""
    hits, before = [], base
    for rule in rules:
        after = rule.applied_to(before)
        hits.append(F.when(before != after, F.lit(rule.name)))
        before = after
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def template_of(stmt: Column, rules: Sequence[StrippingRule] = DEFAULT_RULES) -> Column:
    """Stripped template of a statement; ``''`` or NULL when there is nothing to store."""
    return strip_template(normalize_statement(stmt), rules)


def has_template(template: Column) -> Column:
    return F.coalesce(template != "", F.lit(False))


def template_key(template: Column) -> Column:
    """A key of fixed length that is the same in every load."""
    return F.sha2(template, 256)


def _plain_name(raw: Column) -> Column:
    parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(trim(p), "^`|`$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), ".")


def from_table(template: Column) -> Column:
    """First FROM target that is not a common table expression."""
    ctes = F.transform(F.regexp_extract_all(template, F.lit(_CTE_NAME), 1), F.lower)
    names = F.transform(F.regexp_extract_all(template, F.lit(_FROM_NAME), 1), _plain_name)
    tables = F.filter(
        names, lambda n: (n != "") & ~F.array_contains(ctes, F.lower(F.substring_index(n, ".", 1)))
    )
    return F.get(tables, F.lit(0))


def qualified_guess(template: Column, db_name: Column) -> Column:
    guess = from_table(template)
    bare = ~F.contains(guess, F.lit(".")) & (F.coalesce(db_name, F.lit("")) != "")
    return F.when(bare, F.concat_ws(".", db_name, guess)).otherwise(guess)


def first_json_string(text: Column) -> Column:
    """First non-blank string of a JSON array; other item types are passed over, bad JSON is NULL."""
    items = F.try_parse_json(non_blank(text)).try_cast("array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    words = F.transform(strings, lambda v: trim(F.try_variant_get(v, "$", "string")))
    return F.get(F.filter(words, lambda w: w != ""), F.lit(0))


def table_guess(stmt: Column, db_name: Column, queried_tables: Column | None = None) -> Column:
    """The table a statement reads: the log's own list first, else the statement's FROM."""
    guess = qualified_guess(normalize_statement(stmt), db_name)
    if queried_tables is None:
        return guess
    return F.coalesce(first_json_string(queried_tables), guess)


def table_name_parts(guess: Column) -> tuple[Column, Column]:
    """Database (maybe empty) and table from the last two dotted parts."""
    parts = F.filter(F.split(guess, r"\."), lambda p: p != "")
    db = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    table = F.coalesce(F.get(parts, F.size(parts) - 1), guess)
    return db, table
