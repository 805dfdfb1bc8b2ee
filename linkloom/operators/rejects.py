"""Rows that fail to parse: loading seven-field gold mention lines with a reject channel.

Every line is tokenised by one possessive regular expression in the JVM. The cells are exploded to
(row, position, value), joined to a rule table with one row per column, and checked; the violations
are aggregated per line, and the clean lines are those without a violation (anti-join).

Defined results:

* one trailing CR belongs to the line break; a null line has no fields (``columns``);
* an empty or blank line has one field (``columns``);
* rows repeated as a whole give one reject row and one clean row;
* a null ``line_id`` is kept as an ordinary, null-safe key;
* an empty table gives two empty results; other columns of the input are ignored, except those
  named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One cell after a tab: quoted up to the next quote that isn't doubled, or free of tabs. Possessive
# loops keep the matcher iterative, so that very long lines don't exhaust the stack.
_QUOTED = r'"(?:[^"]++|"")*+"(?=\t|\z)'
_PLAIN = r'(?!")[^\t]*+'
_CELL = rf"\t({_QUOTED}|{_PLAIN})"
_WELL_FORMED = rf"\A(?:\t(?:{_QUOTED}|{_PLAIN}))++\z"

N_FIELDS = 7
REASONS = ("quoting", "columns", "value")


@dataclass(frozen=True)
class FieldRule:
    """One row of the rule table: the column's position and name, the pattern that a value must match, and whether the two
    numbers at its end, ``:first-last``, must be in order."""

    position: int
    field: str
    pattern: str
    ordered: bool = False


GOLD_RULES = (
    FieldRule(0, "system", r"\Agold\z"),
    FieldRule(1, "entry_id", r"\AEDL_[0-9]{10}\z"),
    FieldRule(2, "surface", r"[^\s\p{Z}]"),
    FieldRule(3, "span", r"\A(?:ENG|SPA|CMN)_(?:NW|DF)_[0-9]{10}:[0-9]+-[0-9]+\z", ordered=True),
    FieldRule(4, "kb_id", r"\A(?:m\.[a-z0-9]+|NIL[0-9]{5})\z"),
    FieldRule(5, "mention_type", r"\A(?:PER|ORG|GPE|LOC|FAC)\z"),
    FieldRule(6, "noun_type", r"\A(?:NAM|NOM)\z"),
)

_RULE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("field", T.StringType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("ordered", T.BooleanType(), False),
    ]
)


def rule_table(spark: SparkSession, rules: tuple[FieldRule, ...] = GOLD_RULES) -> DataFrame:
    """The rule table; one row per column of the format (seven rows)."""
    return spark.createDataFrame([(r.position, r.field, r.pattern, r.ordered) for r in rules], _RULE_SCHEMA)


def _not_greater(start: Column, end: Column) -> Column:
    """Whether start <= end for digit strings of any length."""
    a, b = (F.regexp_replace(c, r"\A0+(?=[0-9])", "") for c in (start, end))
    return (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a <= b))


def _violated(value: Column, quoted: Column) -> Column:
    """Whether a cell breaks the rule that it was joined to; the rule's columns decide."""
    control = value.rlike(r"[\p{Cc}\x{FFFD}&&[^\t]]") | (~quoted & F.contains(value, F.lit("\t")))
    bounds = F.split(F.substring_index(value, ":", -1), "-")
    in_order = F.coalesce(_not_greater(F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))), F.lit(False))
    return control | ~F.regexp_like(value, F.col("pattern")) | (F.col("ordered") & ~in_order)


def parse_lines(lines: DataFrame, line_id: str = "line_id", line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokenise each line: key columns, ``well_formed`` and ``cells`` (raw, still quoted)."""
    body = F.concat(F.lit("\t"), F.regexp_replace(F.col(line), r"\r\z", ""))
    return lines.select(
        F.col(line_id).alias("line_id"),
        F.xxhash64(F.col(line)).alias("line_hash"),
        *[F.col(c) for c in keep],
        F.coalesce(body.rlike(_WELL_FORMED), F.lit(True)).alias("well_formed"),
        F.coalesce(F.regexp_extract_all(body, F.lit(_CELL), F.lit(1)), F.array().cast("array<string>")).alias("cells"),
    )


def _unquoted(cell: Column) -> Column:
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def violations(parsed: DataFrame, rules: tuple[FieldRule, ...] = GOLD_RULES) -> DataFrame:
    """(line_id, line_hash, reason, fields): one row per line that isn't valid, with the first reason that applies."""
    key = ("line_id", "line_hash")
    shape = (
        F.when(~F.col("well_formed"), F.lit(0)).when(F.size("cells") != len(rules), F.lit(1)).alias("rank")
    )
    by_line = parsed.select(*key, shape, F.lit(None).cast("string").alias("field")).where("rank is not null")
    cells = (
        parsed.where(F.col("well_formed") & (F.size("cells") == len(rules)))
        .select(*key, F.posexplode("cells").alias("position", "cell"))
        .join(F.broadcast(rule_table(parsed.sparkSession, rules)), "position")  # one row for each column
        .where(_violated(_unquoted(F.col("cell")), F.col("cell").startswith('"')))
        .select(*key, F.lit(2).alias("rank"), "field")
    )
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.min("rank") + 1)
    return (
        by_line.unionByName(cells)
        .groupBy(*key)
        .agg(reason.alias("reason"), F.array_sort(F.collect_set("field")).alias("fields"))
    )


def load_gold_lines(lines: DataFrame, rules: tuple[FieldRule, ...] = GOLD_RULES) -> tuple[DataFrame, DataFrame]:
    """Split ``lines`` into (valid mentions as columns, rejected lines with reason)."""
    parsed = parse_lines(lines)
    bad = violations(parsed, rules)
    same = (F.col("p.line_id").eqNullSafe(F.col("b.line_id"))) & (F.col("p.line_hash").eqNullSafe(F.col("b.line_hash")))
    clean = parsed.alias("p").join(bad.alias("b"), same, "left_anti").dropDuplicates(["line_id", "line_hash"])
    value = {r.field: _unquoted(F.get("cells", F.lit(r.position))) for r in rules}
    doc = F.substring_index(value["span"], ":", 1)
    bounds = F.split(F.substring_index(value["span"], ":", -1), "-")
    mentions = clean.select(
        "line_id",
        value["entry_id"].alias("entry_id"),
        value["surface"].alias("surface"),
        doc.alias("doc_name"),
        F.try_to_number(F.get(bounds, F.lit(0)), F.lit("9" * 18)).cast("long").alias("start_offset"),
        (F.try_to_number(F.get(bounds, F.lit(1)), F.lit("9" * 18)).cast("long") + 1).alias("end_offset"),
        value["kb_id"].alias("mid"),
        value["mention_type"].alias("mention_type"),
        value["noun_type"].alias("noun_type"),
        F.when(doc.startswith("ENG"), "en").when(doc.startswith("SPA"), "es").otherwise("zh").alias("lang"),
    )
    return mentions, bad.select("line_id", "reason", "fields")
