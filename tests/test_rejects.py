"""Gold lines against a plain parser of the format."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from linkloom.operators import rejects

OK = "gold\tEDL_0000000001\tA name\tENG_NW_0000000001:3-8\tm.01ab\tPER\tNAM"
RULES = [
    lambda v: v == "gold",
    lambda v: re.fullmatch("EDL_[0-9]{10}", v),
    lambda v: v.strip(),
    lambda v: (m := re.fullmatch("(?:ENG|SPA|CMN)_(?:NW|DF)_[0-9]{10}:([0-9]+)-([0-9]+)", v)) and int(m[1]) <= int(m[2]),
    lambda v: re.fullmatch(r"m\.[a-z0-9]+|NIL[0-9]{5}", v),
    lambda v: v in "PER ORG GPE LOC FAC".split(),
    lambda v: v in ("NAM", "NOM"),
]


def plain_reason(line):
    """The reason for which a line isn't valid, or None: a character-by-character reader."""
    if line is None:
        return "columns"
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + line[j], j + 1
            if line[j + 1 : j + 2] not in ("", "\t"):
                return "quoting"
            fields.append((value, True))
            i = j + 1
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            fields.append((line[i:j], False))
            i = j
        if i >= len(line):
            break
        i += 1
    if len(fields) != 7:
        return "columns"
    for rule, (value, quoted) in zip(RULES, fields):
        if not rule(value) or any((unicodedata.category(c) == "Cc" and not (quoted and c == "\t")) or c == "�" for c in value):
            return "value"
    return None


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    found = {r["line_id"]: r["reason"] for r in rejects.violations(rejects.parse_lines(df)).collect()}
    return [found.get(i) for i in range(len(lines))]


def test_cases(spark):
    lines = [
        OK, OK + "\r", OK + "\r\r", "", "  ", None, '"gold"' + OK[4:], OK.replace("A name", '"A\tname"'), OK.replace("A name", '"A ""b"" c"'),
        OK.replace("A name", '"A" b'), OK.replace("A name", '"A b'), OK.replace("A name", 'A "b'), OK.replace("A name", '""'), OK.replace("A name", "A\x00b"),
        OK.replace("A name", "A�"), OK.replace("3-8", "9-8"), OK.replace("3-8", "007-8"), OK.replace("3-8", "3-" + "9" * 60), OK.replace("m.01ab", "NIL123"),
        OK.replace("m.01ab", "m."), OK + "\t", OK.replace("gold", "Gold"), OK.replace("A name", "x" * 200_000), OK.replace("A name", '"' + "y" * 200_000 + '"'),
        OK.replace("A name", '"""'), OK.replace("A name", '""""'),
    ]
    assert reasons(spark, lines) == [plain_reason(x) for x in lines]


def test_random_lines(spark):
    rng = random.Random(5)
    lines = []
    for _ in range(600):
        x = list(OK)
        for _ in range(rng.randint(0, 3)):
            x.insert(rng.randint(0, len(x)), rng.choice(['"', '""', "\t", "\r", "\x07", " ", "é", "　"]))
        if rng.random() < 0.3:
            del x[rng.randrange(len(x))]
        lines.append("".join(x))
    assert reasons(spark, lines) == [plain_reason(x) for x in lines]


def test_clean_rows_and_repeats(spark):
    df = spark.createDataFrame([(1, OK, "f"), (1, OK, "f"), (None, OK, "g"), (2, "x", "f"), (2, "x", "f")], "line_id long, line string, reason string")
    good, bad = rejects.load_gold_lines(df)
    rows = good.orderBy(F.col("line_id").asc_nulls_first()).collect()
    assert [(r["line_id"], r["surface"], r["start_offset"], r["end_offset"], r["lang"]) for r in rows] == [(None, "A name", 3, 9, "en"), (1, "A name", 3, 9, "en")]
    assert [(r["line_id"], r["reason"]) for r in bad.collect()] == [(2, "columns")]


def test_empty_table(spark):
    good, bad = rejects.load_gold_lines(spark.createDataFrame([], "line_id long, line string"))
    assert good.count() == bad.count() == 0


@pytest.mark.parametrize("start,end,ok", [("0", "0", True), ("10", "9", False), ("09", "10", True), ("1" * 40, "1" * 39, False)])
def test_offsets_of_any_length(spark, start, end, ok):
    assert (reasons(spark, [OK.replace("3-8", f"{start}-{end}")]) == [None]) is ok
