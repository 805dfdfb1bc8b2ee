"""Visually identical text with different characters: a confusables skeleton.

Two texts look the same when their skeletons are equal. The skeleton of a text is made by
decomposing it, replacing every character by the prototype of its look-alike class and decomposing
again; invisible characters vanish and every blank becomes a space. Case, accents, spelling,
underscores and traditional against simplified characters stay visible differences.

Defined results: null stays null, the empty text stays empty, texts of any length are processed
whole; ``same_look_pairs`` ignores rows with a null id, document or value, treats rows repeated as a
whole as one, and gives an empty result for an empty table. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like a Latin letter.
_LOOK_ALIKE = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟϹ", "E": "ΕЕᎬ", "G": "Ԍ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКᏦK",
    "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ",
    "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іιı", "j": "јϳ", "l": "ӏ", "n": "ո",
    "o": "оοօσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
}
# Punctuation that is drawn alike.
_MARKS = {
    "'": "‘’‛′ʹʼˈ", '"': "“”‟″", "-": "‐‑‒–−˗﹣", "·": "•‧∙⋅・ᐧ", ".": "․", ",": "‚", ":": "ː꞉∶", "/": "⁄∕", "*": "∗",
    "(": "❨", ")": "❩", "~": "∼˜",
}
# Radicals without a decomposition of their own and the ideographs they are drawn like.
_RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺇": "几", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "㔾", "⺌": "小", "⺍": "小",
    "⺎": "兀", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌",
    "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫",
    "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺯": "糹", "⺰": "纟",
    "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺹": "耂", "⺺": "肀", "⺼": "月", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹",
    "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足",
    "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "邑", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门",
    "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "食",
    "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄",
    "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}

# Decompositions whose result looks like the character itself; superscripts, fractions, circled and
# squared forms differ to a reader and stay.
_SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")


@lru_cache(maxsize=None)
def _invisible(char: str) -> bool:
    """Format characters, variation selectors and the fillers that draw nothing."""
    return unicodedata.category(char) == "Cf" or "VARIATION SELECTOR" in unicodedata.name(char, "") or char in "͏ᅟᅠㅤﾠ"


@lru_cache(maxsize=None)
def _same_look(char: str) -> str:
    """The decomposition of one character, if it keeps its look."""
    kind, *points = unicodedata.decomposition(char).split() or [""]
    if not kind:
        return char
    if kind.startswith("<"):
        if kind not in _SAME_LOOK_TAGS:
            return char
    else:
        points = [kind, *points]
    return "".join(_same_look(chr(int(p, 16))) for p in points)


class _Prototypes(dict):
    """Character -> prototype for ``str.translate``; filled when a character is met.

    ``more`` are look-alikes (character -> character) besides the fixed ones, which come first.
    """

    fixed = {
        **{other: latin for latin, others in _LOOK_ALIKE.items() for other in others},
        **{other: mark for mark, others in _MARKS.items() for other in others},
        **_RADICALS,
    }

    def __init__(self, more: dict[str, str] | None = None) -> None:
        super().__init__()
        self.fixed = {**more, **self.fixed} if more else self.fixed

    def __missing__(self, point: int) -> str:
        char = chr(point)
        if _invisible(char):
            out = ""
        elif unicodedata.category(char) == "Zs":
            out = " "
        else:
            out = "".join(self.fixed.get(c, c) for c in _same_look(self.fixed.get(char, char)))
            out = " " if out and not out.strip(" ") else out
        self[point] = out
        return out


_PROTOTYPES = _Prototypes()


def skeleton_text(text: str | None, prototypes: _Prototypes = _PROTOTYPES) -> str | None:
    """The skeleton of one text."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes))


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Character -> the character that it is drawn like, of all scripts, by the public confusables data of the JVM's ICU library.

    Its prototypes unite some ASCII characters that readers of names tell apart (``l``, ``I``, ``1``); of such a class the
    one of the character's own kind (capital, small letter, digit) is meant. Pairs of different kinds (a letter and a digit) and
    prototypes of several characters are left out. Without ICU there is no table, which is an error: the fixed look-alikes alone would miss pairs.
    """
    kind = unicodedata.category
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        chars = [c for c in map(chr, range(0x80, 0x20000)) if kind(c)[0] in "LMNPS" and not unicodedata.decomposition(c)]
        mark = "\ue000"  # of private use, so its own prototype
        found = dict(zip(chars, checker.getSkeleton(mark.join(chars)).split(mark), strict=True))
        ascii_of: dict[str, list[str]] = {}
        for c in map(chr, range(0x21, 0x7F)):
            ascii_of.setdefault(checker.getSkeleton(c), []).append(c)
    except (AttributeError, TypeError, Py4JError) as error:
        raise RuntimeError("the look-alikes of all scripts need the ICU library (com.ibm.icu) in the session's JVM") from error
    out = {}
    for c, prototype in found.items():
        if prototype in ascii_of:
            same = [a for a in ascii_of[prototype] if kind(a) == kind(c) or (len(ascii_of[prototype]) == 1 and kind(a)[0] == kind(c)[0])]
            prototype = same[0] if len(same) == 1 else c
        if prototype != c and len(prototype) == 1 and kind(prototype)[0] == kind(c)[0]:
            out[c] = prototype
    return out


def _skeletons(more: dict[str, str] | None):
    known: list[_Prototypes] = []

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(_Prototypes(more))
        return texts.map(lambda t: skeleton_text(t, known[0]), na_action="ignore")

    return of


def skeleton(text: Column, more: dict[str, str] | None = None) -> Column:
    """The skeleton of a string column, by the fixed look-alikes and ``more`` (as of ``look_alikes``)."""
    return _skeletons(more)(text)


def consistent_text(text: str | None) -> str | None:
    """One consistent, composed form of a text: its skeleton, composed again."""
    return None if text is None else unicodedata.normalize("NFC", skeleton_text(text))


def same_look_pairs(rows: DataFrame, fields: tuple[str, ...], row_id: str, within: str) -> DataFrame:
    """(field_name, <row_id>_a, <row_id>_b): rows of one ``within`` group whose values look the same but are stored differently.

    Only look-alike groups that hold at least two stored forms take part in the self-join, and the
    join pairs different forms only; copies of one form never meet. Looks travel as two independent 64-bit
    hashes and stored values as one: unequal hashes prove values unequal, and two looks pass for one only if both
    of their hashes collide inside one group.
    """
    more = look_alikes(rows.sparkSession)
    long = rows.select(
        F.col(within).alias("grp"),
        F.col(row_id).alias("id"),
        F.posexplode(F.array(*[F.col(f) for f in fields])).alias("field", "value"),
    ).where("grp is not null and id is not null and value is not null")
    looked = long.select("grp", "field", skeleton(F.col("value"), more).alias("look"), "value", "id")
    keyed = looked.select("grp", "field", F.xxhash64("look").alias("look"), F.xxhash64(F.lit(1), "look").alias("look_2"), F.xxhash64("value").alias("stored"), "id")
    key = ["grp", "field", "look", "look_2"]
    mixed = keyed.groupBy(*key).agg(F.min("stored").alias("least"), F.max("stored").alias("most")).where("least != most").select(*key)
    part = keyed.join(mixed, key, "left_semi").distinct()
    a = part.select(*key, F.col("id").alias("a"), F.col("stored").alias("stored_a"))
    b = part.select(*key, F.col("id").alias("b"), F.col("stored").alias("stored_b"))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return (
        a.join(b, key)
        .where("a < b and stored_a != stored_b")
        .select("field", F.col("a").alias(f"{row_id}_a"), F.col("b").alias(f"{row_id}_b"))
        .distinct()
        .select(name.alias("field_name"), f"{row_id}_a", f"{row_id}_b")
    )


def look_groups(rows: DataFrame, field: str) -> DataFrame:
    """(form, originals, n_rows): the stored originals of each skeleton; counts are made before the forms meet."""
    counted = rows.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("stored")).count()
    return (
        counted.withColumn("form", skeleton(F.col("stored"), look_alikes(rows.sparkSession)))
        .groupBy("form")
        .agg(F.array_sort(F.collect_list("stored")).alias("originals"), F.sum("count").alias("n_rows"))
    )
