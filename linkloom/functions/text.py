"""Text and title functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Languages of the knowledge base that carry another code there.
KB_LANGUAGE = {"zh": "zh-cn"}
# Characters of the simplified and traditional script that the converter knows by default.
TRADITIONAL = "漢羅亞馬諾盧達溫蓋魯裡紐萬凱納圖謝歐貝揚邁倫費傑烏蘭門喬蘇爾薩萊維寧國學會時東車長書見語說話請貴買賣電開關間問題頭顏龍鳥魚"
SIMPLIFIED = "汉罗亚马诺卢达温盖鲁里纽万凯纳图谢欧贝扬迈伦费杰乌兰门乔苏尔萨莱维宁国学会时东车长书见语说话请贵买卖电开关间问题头颜龙鸟鱼"

# Parts of document names that are extensions.
EXTENSIONS = ("txt", "cmp", "mp", "xml", "mpdf")

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def normal_surface(c: Column) -> Column:
    """Lower case, outer blanks off."""
    return F.lower(F.trim(c))


def normal_title(c: Column) -> Column:
    """Lower case, blanks as underscores."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def joined_title(c: Column) -> Column:
    """Lower case, runs of white space as one underscore."""
    return F.array_join(F.split(F.lower(c), r"\s+"), "_")


def title_as_surface(c: Column) -> Column:
    """A title as it would be typed."""
    return normal_surface(F.replace(c, F.lit("_"), F.lit(" ")))


def _first_upper(token: Column) -> Column:
    return F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, F.lit(2), F.length(token)))


def title_case(c: Column, separator: str = "_") -> Column:
    """Upper case for the first letter of each token, the rest as it is; empty tokens are dropped."""
    tokens = F.filter(F.split(c, separator), lambda t: t != "")
    return F.array_join(F.transform(tokens, _first_upper), separator)


def kb_title(c: Column) -> Column:
    """Title as in the knowledge base: underscores, title case if it has no upper case at all."""
    t = F.replace(c, F.lit(" "), F.lit("_"))
    return F.when(F.lower(t) == t, title_case(t)).otherwise(t)


def display_title(c: Column) -> Column:
    """Title case in which a token in parentheses has its second character raised."""
    tokens = F.filter(F.split(c, "_"), lambda t: t != "")
    shown = F.transform(
        tokens,
        lambda t: F.when(
            t.startswith("("), F.concat(F.lit("("), _first_upper(F.substring(t, F.lit(2), F.length(t))))
        ).otherwise(_first_upper(t)),
    )
    return F.array_join(shown, "_")


def gazetteer_case(c: Column) -> Column:
    """Title case behind blanks and hyphens."""
    words = F.filter(F.split(c, " "), lambda t: t != "")
    return F.array_join(F.transform(words, lambda w: title_case(w, "-")), " ")


def cut_parenthesis(c: Column) -> Column:
    """The part before the first parenthesis, unless it begins with one."""
    return F.when(F.instr(c, "(") > 1, F.trim(F.substring_index(c, "(", 1))).otherwise(c)


def cut_apostrophe(c: Column) -> Column:
    """The part of a token before its first apostrophe."""
    return F.substring_index(c, "'", 1)


def join_ngram(tokens: Column, lang: Column) -> Column:
    """Tokens as one n-gram; Chinese has no blanks."""
    return F.when(lang == "zh", F.array_join(tokens, "")).otherwise(F.array_join(tokens, " "))


def hashtag(c: Column) -> Column:
    """A title as a hashtag: cut at the parenthesis, without blanks, hyphens and underscores."""
    return F.regexp_replace(F.substring_index(c, "(", 1), r"[\s_-]", "")


def simplified(c: Column) -> Column:
    """Traditional characters replaced by simplified ones, by a table of single characters."""
    return F.translate(c, TRADITIONAL, SIMPLIFIED)


def script_table(spark: SparkSession, direction: str = "Traditional-Simplified") -> tuple[str, str]:
    """(from, to): all single characters that the JVM's ICU library converts, in either direction; the small default table without ICU."""
    chars = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    try:
        out = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(direction).transliterate("\n".join(chars)).split("\n")
    except (AttributeError, TypeError, Py4JError):
        return (TRADITIONAL, SIMPLIFIED) if direction == "Traditional-Simplified" else (SIMPLIFIED, TRADITIONAL)
    pairs = [(a, b) for a, b in zip(chars, out, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def converted(c: Column, table: tuple[str, str]) -> Column:
    """Characters replaced by those of a table (as of ``script_table``)."""
    return F.translate(c, *table)


def unescaped(c: Column) -> Column:
    """A string of an SQL dump without its backslashes."""
    return F.replace(c, F.lit("\\"), F.lit(""))


def kb_language(lang: Column) -> Column:
    """The language's code in the knowledge base."""
    out = lang
    for own, other in KB_LANGUAGE.items():
        out = F.when(lang == own, F.lit(other)).otherwise(out)
    return out


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(_NUMBER)


def is_capitalised(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def is_nil(c: Column) -> Column:
    """Whether an identifier or title stands for nothing (null counts as nothing)."""
    return F.coalesce(c.startswith("NIL"), F.lit(True))


def or_nil(c: Column) -> Column:
    return F.coalesce(c, F.lit("NIL"))


def document_stem(c: Column) -> Column:
    """A file or document name without its extensions."""
    keep = F.filter(F.split(c, r"\."), lambda p: ~p.isin(*EXTENSIONS))
    return F.array_join(keep, ".")


def tokens_of(c: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def surface_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of a surface, split at white space or the middle dot."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+|·"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def characters(c: Column) -> Column:
    """The set of characters."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda t: t != ""))


def bigrams(c: Column) -> Column:
    """The set of adjacent character pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda k: F.substring(c, k, F.lit(2)))
    return F.array_distinct(F.when(F.length(c) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def initials(c: Column) -> Column:
    """The first letters of the tokens."""
    return F.array_join(F.transform(tokens_of(F.lower(c)), lambda t: F.substring(t, 1, 1)), "")


def edit_distance(surface: Column, title: Column) -> Column:
    """Edits between a surface and the typed form of a title (code points)."""
    return F.levenshtein(surface, cut_parenthesis(F.replace(title, F.lit("_"), F.lit(" "))))


def string_score(distance: Column) -> Column:
    return F.when(distance == 0, F.lit(1.0)).otherwise(1 / distance)


def clean_surface(surface: Column, end: Column) -> tuple[Column, Column]:
    """Surface cut at ``<`` without blanks at the end, and its new end offset; unchanged if nothing would be left."""
    cut = F.regexp_replace(surface, r"(?s)\s*<.*", "")
    kept = F.when((F.instr(surface, "<") > 0) & (F.length(cut) > 0), cut).otherwise(surface)
    return kept, end - (F.length(surface) - F.length(kept))
