"""Sentence boundaries across languages and scripts by cascading segmentation rule tables.

A rule is a pair of regular expressions for the text before and after a position, and says whether a
position that both match is a boundary. The rules of a language stand in tables; the tables are
searched in the order of the language's cascade, and the first rule that matches decides the position.
A position that no rule matches is no boundary. Only positions behind an end mark (in Thai: blanks)
are looked at, as no rule could make another one a boundary.

Before the rules, line breaks divide a text into units (headings and list lines stay units of their
own), and quotations are paired inside each unit: no boundary lies inside a quotation or a title in
book brackets. A quotation at the start of a sentence and the clause that reports it stay together.

Defined results: spans count Unicode code points, ends are exclusive, white space around a span is
left out; a null, empty or blank text has no sentence; a language that is null or unknown is replaced
by the one its script suggests, unit by unit; repeated rows give repeated results; texts are processed
whole, whatever their length; other columns are ignored. English, Spanish, German, French, Italian,
Portuguese, Russian, Hindi, Chinese and Thai have rules of their own; other languages of the Latin script
take the English ones, other scripts those for all end marks of Unicode.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A position between text matching ``before`` and text matching ``after`` is a boundary or not."""

    boundary: bool
    before: str
    after: str


CLOSERS = r"""["”’»)\]）」』》›]"""
OPENERS = r"""["“‘«(\[（「『《‹¿¡—–-]"""


def _words(*words: str) -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(regex.escape(w) for w in words) + r")\."


# Abbreviations behind which a sentence hardly ends, and those behind which it may.
_ENGLISH_INSIDE = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Gen", "Lt", "Sgt", "Col", "Capt", "Cpl", "Maj", "Rev", "Hon", "Gov", "Sen", "Rep", "Pres", "St", "Mt", "Ft", "vs", "cf", "viz", "approx", "est", "ca", "c", "fig", "Fig", "figs", "Figs", "eq", "Eq", "sec", "Sec", "ch", "Ch", "vol", "Vol", "pp", "Univ", "Dept", "Lab", "Inst", "Assoc", "Fdn", "Cttee", "Corp", "Soc", "i.e", "e.g")
_ENGLISH_NUMBERED = ("No", "no", "Nos", "nos", "p", "art", "Art", "ft", "in", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec")
_SPANISH_INSIDE = ("Sr", "Sra", "Srta", "Sres", "Dr", "Dra", "D", "Dña", "Lic", "Ing", "Arq", "Prof", "Profa", "Gral", "Cnel", "Cap", "Sto", "Sta", "Avda", "Av", "art", "arts", "pág", "págs", "cap", "núm", "fig", "vol", "aprox", "p. ej", "p.ej", "EE", "PP", "UU", "RR", "Univ", "Inst", "Corp", "Asoc", "Fund", "Min", "Lab", "Depto", "Dpto", "Soc", "n.º", "n.ª")
_RUSSIAN_INSIDE = ("г", "гг", "ул", "пр", "пл", "д", "кв", "корп", "стр", "с", "рис", "табл", "гл", "см", "См", "ср", "Ср", "т", "им", "проф", "Проф", "акад", "доц", "др", "Лаб", "лаб", "Инст", "Унив", "тыс", "млн", "млрд", "руб", "напр", "до н", "т. д", "т. п", "т. е")
_HINDI_INSIDE = ("डॉ", "श्री", "प्रो", "सं", "कु", "पं", "रु", "कि.मी")

_GERMAN_INSIDE = ("Dr", "Prof", "Hr", "Fr", "Nr", "Bd", "Abb", "Abs", "Art", "bzw", "ca", "vgl", "ggf", "inkl", "exkl", "evtl", "Str", "St", "Mio", "Mrd", "Tel", "Aufl", "Hrsg", "Kap", "sog", "Jh")
_FRENCH_INSIDE = ("M", "MM", "Mme", "Mlle", "Dr", "Pr", "Me", "St", "Ste", "art", "fig", "vol", "p", "pp", "cf", "av", "apr", "env", "no", "ex")
_ITALIAN_INSIDE = ("Sig", "Sigg", "Dott", "Prof", "Ing", "Avv", "On", "art", "fig", "vol", "pag", "pagg", "cfr", "n", "ca", "es", "sec")
_PORTUGUESE_INSIDE = ("Sr", "Sra", "Dr", "Dra", "Prof", "Profa", "Eng", "Exmo", "Av", "art", "fig", "vol", "pág", "págs", "cf", "n", "ex", "séc")

TABLES: dict[str, tuple[Rule, ...]] = {
    "common": (
        # the marker of a numbered line, decimals, times and things glued together
        Rule(False, r"(?:^|\n)\s*(?:\p{N}{1,3}|\p{L})[.)]", r"\s"),
        Rule(False, r"[.]", rf"(?:[\p{{Ll}}\p{{N}},;:%]|{CLOSERS})"),
        Rule(False, r"[!?…]", r"[,;:.!?…]"),
        Rule(False, CLOSERS, r"[,;:.!?…]"),
        # a clause that goes on behind a mark, a quotation or an ellipsis
        Rule(False, rf"[.!?…]{CLOSERS}+", r"\s*[\p{Ll},;:]"),
        Rule(False, rf"[!?…]{CLOSERS}*", r"\s*[—–-]\s?\p{Ll}"),
        Rule(False, rf"(?:…|\.\.+){CLOSERS}*", r"\s*\p{Ll}"),
        # initials
        Rule(False, r"(?<![\p{L}\p{N}])\p{Lu}\.", r"\s*\p{Lu}[\p{L}.]"),
        Rule(False, r"(?<=\p{L}\.)\p{Lu}\.", r"\s+\p{Ll}"),
        Rule(False, r"(?<![\p{L}\p{N}])\p{Lu}\.", r"\s*\p{Ll}"),
        Rule(True, rf"[.!?…]{CLOSERS}*", rf"\s+{OPENERS}*\s?[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]"),
        Rule(True, rf"[.!?…]{CLOSERS}*", rf"\s+{OPENERS}+"),
        # a blank left out
        Rule(True, rf"(?:\p{{Ll}}\p{{Ll}}|\p{{N}}|\p{{Lo}})[.!?…]{CLOSERS}*", rf"{OPENERS}*\p{{Lu}}[\p{{Ll}}\s]"),
        Rule(True, rf"[!?]{CLOSERS}*", rf"{OPENERS}*\p{{Lu}}"),
        # a name that someone typed in lower case
        Rule(True, r"\p{L}{5}[.!?]", r"\s+\p{Ll}"),
    ),
    "en": (
        Rule(False, _words(*_ENGLISH_INSIDE), r""),
        Rule(False, _words(*_ENGLISH_NUMBERED), r"\s*\p{N}"),
        Rule(False, r"(?<!\p{L})(?:[ap]\.\s?m|etc|Ltd|Inc|Co|Corp|Bros|Jr|Sr|Nov|Dec|Oct|Sept|Aug|Feb|Jan|ft|in)\.", r"\s*\p{Ll}"),
    ),
    "es": (
        Rule(False, _words(*_SPANISH_INSIDE), r""),
        Rule(False, r"(?<!\p{L})(?:[ap]\.\s?m|etc)\.", r"\s*\p{Ll}"),
        Rule(False, r"(?<!\p{L})[ap]\.", r"\s?m\."),
        Rule(False, r"(?<!\p{L})n\.", r"\s?[ºª°]"),
        Rule(False, r"(?<!\p{L})p\.", r"\s?ej\."),
    ),
    "ru": (
        Rule(False, r"(?<!\p{L})т\.", r"\s?[депк]\."),
        Rule(True, r"(?<!\p{L})(?:т\.\s?[дп]|н\.\s?э)\.", r"\s+\p{Lu}"),
        Rule(False, r"(?<!\p{L})(?:т\.\s?[депк]|н\.\s?э)\.", r"\s*[\p{Ll},;:)]"),
        Rule(False, r"(?<!\p{L})н\.", r"\s?э\."),
        Rule(False, _words(*_RUSSIAN_INSIDE), r""),
    ),
    "hi": (
        Rule(False, _words(*_HINDI_INSIDE), r""),
        Rule(False, rf"[।॥.!?…]{CLOSERS}+", r"\s*[,;:]"),
        Rule(True, rf"[।॥!?]{CLOSERS}*", r"\s*\S"),
        Rule(True, rf"\.{CLOSERS}*", r"\s+\S"),
    ),
    "zh": (
        # an ellipsis behind a word or two is a hesitation, behind a longer stretch it ends a sentence
        Rule(False, r"(?:^|[。！？!?…\s”」』])[\p{L}·]{1,3}(?:…+|\.{3,})", r"\s*\p{L}"),
        Rule(False, rf"[。！？!?…]{CLOSERS}*", r"[，、；：。！？,;:!?…]"),
        Rule(True, rf"(?:[。！？…]|(?<!\p{{N}})[!?]){CLOSERS}*", r"\s*\S"),
        Rule(True, rf"\p{{Han}}\.{CLOSERS}*", r"\s*\S"),
    ),
    "de": (
        Rule(False, _words(*_GERMAN_INSIDE), r""),
        Rule(False, r"(?<!\p{L})(?:z|d|u|o|i|s|v)\.", r"\s?(?:B|h|a|Ä|ä|d|R|u|o)\."),
        Rule(False, r"(?<!\p{L})(?:z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?Ä|i\.\s?d\.\s?R|s\.\s?u|s\.\s?o)\.", r""),
        Rule(False, r"(?<!\p{L})(?:usw|etc)\.", r"\s*\p{Ll}"),
        # an ordinal number or a day of a month
        Rule(False, r"(?<!\p{L})\p{N}{1,2}\.", r"\s+(?:\p{Ll}|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)"),
    ),
    "fr": (Rule(False, _words(*_FRENCH_INSIDE), r""), Rule(False, r"(?<!\p{L})etc\.", r"\s*\p{Ll}")),
    "it": (Rule(False, _words(*_ITALIAN_INSIDE), r""), Rule(False, r"(?<!\p{L})ecc\.", r"\s*\p{Ll}")),
    "pt": (Rule(False, _words(*_PORTUGUESE_INSIDE), r""), Rule(False, r"(?<!\p{L})etc\.", r"\s*\p{Ll}")),
    # any other script: its own end marks, which nothing else is written with
    "any": (
        Rule(False, rf"\p{{Sentence_Terminal}}{CLOSERS}*", r"\s*[,;:\p{Sentence_Terminal}]"),
        Rule(True, rf"(?![.!?])\p{{Sentence_Terminal}}{CLOSERS}*", r"\s*\S"),
        Rule(False, r"\.", r"\s*\p{N}"),
        Rule(True, rf"[.!?…]{CLOSERS}*", r"\s+\S"),
    ),
    "th": (
        Rule(False, rf"[.!?…]{CLOSERS}*", r"[,;:.!?…\p{N}]"),
        Rule(True, r"\p{Thai}", r"\s+\p{Thai}"),
        Rule(True, rf"[!?…]{CLOSERS}*", r"\s+\S"),
        Rule(True, rf"(?<=\p{{Thai}}){CLOSERS}+", r"\s+\p{Thai}"),
    ),
}
CASCADES = {
    "en": ("en", "es", "common"),
    "es": ("es", "en", "common"),
    "ru": ("ru", "common"),
    "hi": ("hi", "common"),
    "zh": ("zh",),
    "th": ("th", "common"),
    "de": ("de", "common"),
    "fr": ("fr", "common"),
    "it": ("it", "common"),
    "pt": ("pt", "common"),
    "any": ("any",),
}
_LATIN_LANGUAGES = ("en", "es", "de", "fr", "it", "pt")
# Where a boundary may lie at all.
_CANDIDATES = {
    "zh": regex.compile(rf"[。！？!?…．.]+{CLOSERS}*"),
    "hi": regex.compile(rf"[।॥.!?…]+{CLOSERS}*"),
    "any": regex.compile(rf"[\p{{Sentence_Terminal}}…]+{CLOSERS}*"),
    "th": regex.compile(rf"[.!?…]+{CLOSERS}*|(?<=[\p{{Thai}}{CLOSERS[1:-1]}])(?=\s)"),
}
_LATIN_CANDIDATES = regex.compile(rf"[.!?…]+{CLOSERS}*")
# A clause that reports the quotation before it.
_REPORTS = {
    "zh": regex.compile(r"\s*[\p{L}·]{1,9}?(?:说|問|问|道|喊|答|写道|叫)(?![：:])"),
    "hi": regex.compile(r"\s*[^।॥?!“”\n]{1,80}?(?:कहा|पूछा|बोला|बोली|लिखा|बताया|चिल्लाया)(?!\s*[:：])"),
}
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "《": "》", "‹": "›", '"': '"', "〈": "〉", "„": "“"}
_QUOTE = regex.compile(r'["“”«»「」『』《》‹›〈〉„]')
_LINE = regex.compile(r"[^\n\r\v\f\x1c-\x1e\x85  ]+")
_SCRIPTS = {
    "th": regex.compile(r"\p{Thai}"), "hi": regex.compile(r"\p{Devanagari}"), "zh": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    "ru": regex.compile(r"\p{Cyrillic}"),
}
_LATIN = regex.compile(r"\p{Latin}")
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=None)
def _compiled(lang: str) -> tuple[tuple[bool, regex.Pattern], ...]:
    rules = [rule for name in CASCADES[lang] for rule in TABLES[name]]
    return tuple((r.boundary, regex.compile(rf"(?<={r.before})(?={r.after})")) for r in rules)


def _language(line: str, lang: str | None) -> str:
    """The cascade of a unit: by script, and between languages of one script by the label; another script has the common one for all others."""
    latin_lang = lang if lang in _LATIN_LANGUAGES else "en"
    if line.isascii():
        return latin_lang
    counts = {name: len(p.findall(line)) for name, p in _SCRIPTS.items()}
    counts["zh"] *= 3  # a Chinese character stands for several letters
    best = max(counts, key=counts.__getitem__)
    latin = len(_LATIN.findall(line))
    if counts[best] and counts[best] >= (0.2 if best in ("th", "hi", "zh") else 1.0) * latin:
        return best
    if lang not in CASCADES and not counts[best] and len(_LETTER.findall(line)) > 2 * latin:
        return "any"
    return latin_lang


def _quotations(line: str) -> list[tuple[int, int]]:
    """Outermost quotations [open, behind the closing mark), in order; a mark without a partner is ordinary text."""
    out: list[tuple[int, int]] = []
    marks = [(m.start(), m.group()) for m in _QUOTE.finditer(line)]
    i = 0
    while i < len(marks):
        at, mark = marks[i]
        close = _PAIRS.get(mark)
        if close is None:
            i += 1
            continue
        depth, j = 1, i + 1
        while j < len(marks):
            if marks[j][1] == close:
                depth -= 1
            elif marks[j][1] == mark:
                depth += 1
            if not depth:
                break
            j += 1
        if j < len(marks):
            out.append((at, marks[j][0] + 1))
            i = j + 1
        else:
            i += 1
    return out


def line_spans(line: str, lang: str | None) -> Iterator[tuple[int, int]]:
    """Sentence spans of one unit."""
    lang = _language(line, lang)
    rules = _compiled(lang)
    quoted = _quotations(line)
    opens = [a for a, _ in quoted]
    start = 0
    for mark in _CANDIDATES.get(lang, _LATIN_CANDIDATES).finditer(line):
        at = mark.end()
        k = bisect_right(opens, at - 1) - 1
        if k >= 0 and opens[k] < at < quoted[k][1]:
            continue
        if k >= 0 and quoted[k][1] == at and lang in _REPORTS and not line[start : opens[k]].strip() and _REPORTS[lang].match(line, at):
            continue
        for boundary, rule in rules:
            if rule.match(line, at):
                if boundary:
                    yield start, at
                    start = at
                break
    yield start, len(line)


def sentence_spans(text: str | None, lang: str | None) -> list[tuple[int, int]]:
    """All sentence spans of a text."""
    out = []
    for unit in _LINE.finditer(text or ""):
        line, base = unit.group(), unit.start()
        for a, b in line_spans(line, lang):
            part = line[a:b]
            lead = len(part) - len(part.lstrip())
            tail = len(part.rstrip())
            if tail > lead:
                out.append((base + a + lead, base + a + tail))
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [sentence_spans(t, g) for t, g in zip(batch["text"], batch["lang"], strict=True)]
        yield pd.DataFrame(
            {
                "doc_id": pd.Series([d for d, s in zip(batch["doc_id"], spans, strict=True) for _ in s], dtype="Int64"),
                "sent_start": pd.Series([a for s in spans for a, _ in s], dtype="int32"),
                "sent_end": pd.Series([b for s in spans for _, b in s], dtype="int32"),
            }
        )


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, sent_start, sent_end): one row for each sentence; no shuffle."""
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return narrow.mapInPandas(_split, "doc_id long, sent_start int, sent_end int")
