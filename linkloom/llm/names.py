"""Variant spellings of names typed by people: which mentions name the same person or organisation?

1. *Tokens.* Surface and typed title of a mention are brought to one form and cut into words, initials
   and abbreviations; forms of address, articles and prepositions are left out.
2. *Spelling.* A symmetric-delete index (each word with every one-letter deletion of it) finds words a
   small edit away; a word takes the spelling of its most frequent neighbour.
3. *Blocks.* A name's key word is, of those typed twice or more, the one that meets the fewest other words, such as the
   surname or the place, as given names and kinds of organisations meet many. Names meet only under
   the same language and key word.
4. *Alignment.* In a block the remaining words of the different names (not mentions) are aligned by
   optimal assignment; equal words, nicknames, one edit, initials and abbreviations are permitted.
   Names that align wholly are one entity; qualifiers in titles tell namesakes apart. A name that fits
   several entities (a bare surname, an initial, an acronym) is resolved by the other mentions of its
   document, and stays unlinked if those don't decide.

Frequencies and degrees are aggregates with a map-side part. A block holds different forms only, whose
number doesn't grow with the number of mentions, so a name with a third of all mentions is as cheap as
any other; only the requested pairs of an entity's mentions grow with it.

Defined results: of a mention delivered several times the latest counts; rows with null surface or id
and names without a letter link nothing; a null language is taken from the document; a null title is
left out of the evidence; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkloom.functions.text import SIMPLIFIED, TRADITIONAL
from linkloom.llm.confusables import _LOOK_ALIKE, consistent_text
from linkloom.session import cut_lineage

# Short forms of given names.
NICKNAMES = {
    "alex": "alexander", "sandy": "alexander", "xander": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony",
    "bella": "isabella", "izzy": "isabella", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth",
    "lizzie": "elizabeth", "eliza": "elizabeth", "bill": "william", "billy": "william", "will": "william", "liam": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "chris": "christopher", "kit": "christopher", "topher": "christopher",
    "dan": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "rick": "richard", "rich": "richard",
    "ed": "edward", "ted": "theodore", "theo": "theodore", "teddy": "theodore", "fred": "frederick", "freddie": "frederick",
    "freddy": "frederick", "greg": "gregory", "hal": "harold", "harry": "harold", "jim": "james", "jimmy": "james", "jack": "john",
    "joe": "joseph", "jon": "jonathan", "johnny": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "matt": "matthew", "mick": "michael", "mike": "michael",
    "nick": "nicholas", "nico": "nicholas", "pat": "patricia", "trish": "patricia", "patty": "patricia", "sam": "samuel",
    "sammy": "samuel", "steve": "steven", "sue": "susan", "tom": "thomas", "tori": "victoria", "vicky": "victoria", "zach": "zachary",
    "zack": "zachary", "bego": "begona", "charo": "rosario", "chuy": "jesus", "concha": "concepcion", "lola": "dolores",
    "lupe": "guadalupe", "manolo": "manuel", "merche": "mercedes", "moncho": "ramon", "nacho": "ignacio", "paco": "francisco",
    "pancho": "francisco", "pepe": "jose", "quique": "enrique", "kike": "enrique", "tomi": "tomas", "varo": "alvaro", "vero": "veronica",
    "вова": "владимир", "володя": "владимир", "гриша": "григорий", "катя": "екатерина", "коля": "николаи", "маша": "мария",
    "митя": "дмитрии", "дима": "дмитрии", "оля": "ольга", "саша": "александр", "шура": "александр", "сережа": "сергеи", "таня": "татьяна",
    "федя": "федор", "юля": "юлия",
}
# Forms of address and function words.
_ADDRESS = frozenset("mr mrs ms mx dr prof sir lic ing sr sra srta don dona д-р проф г-н г-жа главныи".split())
_FUNCTION = frozenset("of and the & de del y la el los las и".split())
_ZH_ADDRESS = re.compile("(?:教授|博士|先生|女士|总部)$")
# Chinese kinds of organisations and their short forms.
_ZH_KINDS = (("大学", "大"), ("研究所", "所"), ("基金会", "基金"), ("协会", "协"), ("委员会", "委"), ("实验室", "室"))
# Further traditional characters used in transliterated names and their simplified forms.
_TRADITIONAL = "麗濟協術體實驗鐵運輸衛劇樂園與銀風飛齊際約瑪綺賓頓韋葉鮑貢賀鄧鐘錢陸陳陽顧養軍農歷莊賽內亙範畢畫發機廠廣場業員師團動產責質檢測經"
_SIMPLIFIED = "丽济协术体实验铁运输卫剧乐园与银风飞齐际约玛绮宾顿韦叶鲍贡贺邓钟钱陆陈阳顾养军农历庄赛内亘范毕画发机厂广场业员师团动产责质检测经"
_TO_SIMPLIFIED = str.maketrans(TRADITIONAL + _TRADITIONAL, SIMPLIFIED + _SIMPLIFIED)
_TO_CYRILLIC = str.maketrans({latin: next(c for c in others if "а" <= c.lower() <= "ӏ") for latin, others in _LOOK_ALIKE.items() if any("Ѐ" <= c <= "ӿ" for c in others)})
# Words above this length are indexed by their ends.
LONG = 64
_HAN = re.compile("[㐀-鿿]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[A-Za-z]")
_QUALIFIER = re.compile(r"[\s_]*[(]([^()]*)[)]\s*$")

_NAME = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("qualifier", T.StringType()),
    ]
)


def plain(text: str) -> str:
    """One form of a name: look-alikes of the name's own script, no invisible characters, no accents, no case."""
    if len(_CYRILLIC.findall(text)) > len(_LATIN.findall(text)):
        text = unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf")).translate(_TO_CYRILLIC)
    else:
        text = consistent_text(text)
    text = unicodedata.normalize("NFD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_TO_SIMPLIFIED)


def parse_name(text: str | None, typed_title: bool) -> tuple[list[str], list[str], str | None]:
    """(words, parts, qualifier): the long words of a name, its initials and short forms (with a dot), the title's qualifier.

    An acronym becomes a single part with a leading ``@``.
    """
    if text is None:
        return [], [], None
    raw = consistent_text(text).strip()
    text = plain(text).strip()
    found = _QUALIFIER.search(text)
    qualifier = None
    if found and not (_HAN.search(text) and not typed_title):
        text = text[: found.start()]
        qualifier = found.group(1).strip() or None if typed_title else None
    elif found:
        text = found.group(1) + text[: found.start()]
    if _HAN.search(text):
        text = _ZH_ADDRESS.sub("", text)
        words = [w for w in re.split(r"[\s_·,-]+", text) if w]
        if len(words) == 1 and len(words[0]) > 4:
            for full, short in _ZH_KINDS:
                if words[0].endswith(full):
                    break
                if words[0].endswith(short):
                    words = [words[0][: -len(short)] + full]
                    break
        return words, [], qualifier
    if not typed_title and raw.isupper() and 3 <= len(raw) <= 6 and raw.isalpha():
        return [], ["@" + text], None
    words, parts = [], []
    for m in re.finditer(r"[^\s_,·.]+\.?", text):
        token = m.group()
        bare = token.rstrip(".")
        if bare in _ADDRESS or bare in _FUNCTION or not any(map(str.isalpha, bare)):
            continue
        if len(bare) == 1 or token.endswith(".") or "-" in bare and len(bare) <= 6:
            parts.append(bare + ".")
        else:
            words.append(bare)
    return words, parts, qualifier


def _parser(typed_title: bool):
    @F.pandas_udf(_NAME)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_name(t, typed_title) for t in texts], columns=["words", "parts", "qualifier"])

    return parse


def deletions(word: Column) -> Column:
    """The word and every one-letter deletion of it, if it is long enough to be told from its neighbours.

    A very long word has its two ends as keys instead, as one edit leaves one of them as it is; words at the border of
    the two have both, so that neighbours of unequal length meet.
    """
    long_enough = F.when(word.rlike("[㐀-鿿]"), F.length(word) >= 4).otherwise(F.length(word) >= 5)
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    ends = F.array(F.concat(F.lit("<"), F.substring(word, 1, LONG // 2)), F.concat(F.lit(">"), F.substring(word, -(LONG // 2), LONG // 2)))
    none = F.array().cast("array<string>")
    by_cut = F.when(long_enough & (F.length(word) <= LONG + 1), cut).otherwise(none)
    return F.array_distinct(F.concat(F.array(word), by_cut, F.when(F.length(word) >= LONG, ends).otherwise(none)))


def spellings(words: DataFrame) -> DataFrame:
    """(lang, word, spelling): each word's most frequent neighbour within one edit or exchange, else the word itself.

    ``words`` has one row for each occurrence (lang, word).
    """
    counted = words.groupBy("lang", "word").count()
    index = counted.select("*", F.explode(deletions(F.col("word"))).alias("variant"))
    best = index.groupBy("lang", "variant").agg(F.max(F.struct("count", "word")).alias("best"))
    nearest = index.join(best, ["lang", "variant"])
    letters = lambda c: F.array_sort(F.split(c, ""))
    far = F.levenshtein("word", "best.word", 2)  # -1 beyond two
    near = far.between(0, 1) | ((far == 2) & (F.length("word") == F.length("best.word")) & (letters(F.col("word")) == letters(F.col("best.word"))))
    return nearest.where(near).groupBy("lang", "word").agg(F.max("best").alias("best")).select("lang", "word", F.col("best.word").alias("spelling"))


@lru_cache(maxsize=100_000)
def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours makes a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:] or (len(ra) > 1 and ra[:2] == rb[1::-1] and ra[2:] == rb[2:])


def _short_for(part: str, word: str) -> bool:
    """Whether an abbreviation (or initial) can stand for a word: its letters in order, from the first one on."""
    short = part.rstrip(".").replace("-", "")
    if word[0] != short[0]:
        return False
    rest = iter(word[1:])
    return all(c in rest for c in short[1:])


def _fits(a: str, b: str) -> int:
    """How well two tokens fit: 3 equal, 2 nickname or one edit, 1 initial or abbreviation, 0 not."""
    if a == b:
        return 3
    if a.endswith(".") or b.endswith("."):
        if a.endswith(".") and b.endswith("."):
            return int(a[0] == b[0] and (len(a) == 2 or len(b) == 2))
        part, word = (a, b) if a.endswith(".") else (b, a)
        return int(_short_for(part, word) or (word in NICKNAMES and _short_for(part, NICKNAMES[word])))
    if NICKNAMES.get(a, a) == NICKNAMES.get(b, b):
        return 2
    return 2 if min(len(a), len(b)) >= 4 and one_edit(a, b) else 0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """The best assignment's sum of fits if every token of the shorter name finds a partner, else 0."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    fits = [[_fits(x, y) for y in b] for x in a]
    if not all(map(any, fits)):
        return 0
    if len(a) == 1:
        return max(fits[0])
    # shortest augmenting paths with potentials; a pair that doesn't fit costs more than any whole assignment
    never = 4 * len(a)
    row_of, u, v = [-1] * (len(b) + 1), [0] * len(a), [0] * (len(b) + 1)
    for row in range(len(a)):
        last = len(b)
        row_of[last] = row
        least, before, done = [10 * never * len(a)] * len(b), [last] * len(b), set()
        while row_of[last] >= 0:
            done.add(last)
            i = row_of[last]
            for j in range(len(b)):
                if j not in done and (cost := (-fits[i][j] or never) - u[i] - v[j]) < least[j]:
                    least[j], before[j] = cost, last
            nearest = min((j for j in range(len(b)) if j not in done), key=least.__getitem__)
            step = least[nearest]
            for j in done:
                u[row_of[j]] += step
                v[j] -= step
            least = [d if j in done else d - step for j, d in enumerate(least)]
            last = nearest
        while last != len(b):
            row_of[last] = row_of[before[last]]
            last = before[last]
    found = [fits[i][j] for j, i in enumerate(row_of[: len(b)]) if i >= 0]
    return sum(found) if all(found) else 0


def _rest(row) -> tuple[str, ...]:
    """The name without its key word; initials beside a whole word are middle initials and don't count."""
    words, parts = [w for w in row if not w.endswith(".")], [w for w in row if w.endswith(".")]
    if words:
        parts = [p for p in parts if len(p) > 2]
    return tuple(sorted(words + parts))


def _meeting_keys(token: str) -> set[str]:
    """Keys of which two tokens that fit share one at least: first letters where one is short, else the word with one letter less."""
    if token.endswith("."):
        return {"." + token[0], "w" + token[0]}
    full = NICKNAMES.get(token, token)
    cut = {token[:k] + token[k + 1 :] for k in range(len(token))} if 4 <= len(token) <= LONG else set()
    ends = {"<" + token[: LONG // 2 - 1], ">" + token[-(LONG // 2 - 1) :]} if len(token) >= LONG else set()
    return {"=" + full, "|" + token, "w" + token[0], "w" + full[0]} | {"|" + c for c in cut} | ends


class _Classes:
    """The classes of a block in order, found by the tokens that they share with a name."""

    def __init__(self) -> None:
        self.all: list[tuple] = []
        self._at: dict[str, list[int]] = {}

    def add(self, name: tuple) -> None:
        for key in sorted({k for t in name for k in _meeting_keys(t)}):
            self._at.setdefault(key, []).append(len(self.all))
        self.all.append(name)

    def near(self, name: tuple) -> list[tuple]:
        """Every class that can align with a name of as many tokens or fewer, in order: all of the name's tokens have a partner there."""
        each = []
        for token in name:
            keys = _meeting_keys(token)
            if not token.endswith("."):
                # whole words share first letters with short forms only
                keys = {k for k in keys if k[0] != "w"} | {"." + k[1:] for k in keys if k[0] == "w"}
            each.append(set().union(*(self._at.get(k, ()) for k in keys)))
        return [self.all[i] for i in sorted(set.intersection(*each))]


def block_entities(block: pd.DataFrame) -> pd.DataFrame:
    """The entities that each name (rest, qualifier) of a block fits."""
    rests = {r: _rest(r) for r in map(tuple, block["rest"])}
    weight: dict[tuple, int] = {}
    for r, n in zip(map(tuple, block["rest"]), block["n"], strict=True):
        weight[rests[r]] = weight.get(rests[r], 0) + int(n)
    whole = lambda r: sum(not t.endswith(".") for t in r)
    # names by how many whole words they have and how often they occur: the first of a class stands for it
    classes = _Classes()
    member: dict[tuple, list[tuple]] = {}
    for r in sorted((r for r in weight if r), key=lambda r: (-len(r), -whole(r), -weight[r], r)):
        near = classes.near(r)
        fits = [(s, c) for c in near if len(c) == len(r) and (s := align(r, c))]
        if fits and (whole(r) or len(r) > 1):
            top = max(s for s, _ in fits)
            member[r] = [c for s, c in fits if s == top]
        elif whole(r) and not (longer := [c for c in near if len(c) > len(r) and align(r, c)]):
            classes.add(r)
            member[r] = [r]
        elif whole(r):
            member[r] = longer
        else:
            member[r] = [c for c in near if align(r, c)]
            if not member[r]:
                classes.add(r)
                member[r] = [r]
    member[()] = classes.all or [()]
    qualifiers: dict[tuple, set[str]] = {}
    for r, q in zip(map(tuple, block["rest"]), block["qualifier"], strict=True):
        if q and len(member[rests[r]]) == 1:
            own = qualifiers.setdefault(member[rests[r]][0], set())
            if not any(one_edit(q, o) for o in own):
                own.add(q)
    out = []
    for r, q in zip(map(tuple, block["rest"]), block["qualifier"], strict=True):
        found = []
        for c in member[rests[r]]:
            own = sorted(qualifiers.get(c, ()))
            near = [o for o in own if q and one_edit(q, o)]
            found += [" ".join(c) + "|" + o for o in (near or own or [""])]
        out.append(found)
    return pd.DataFrame(
        {"lang": block["lang"], "head": block["head"], "rest": block["rest"], "qualifier": block["qualifier"], "entities": out}
    )


def latest_nil_mentions(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest delivery of each mention outside the knowledge base; a null language is the document's."""
    order = Window.partitionBy("mention_id").orderBy(F.col("loaded_at").desc_nulls_last(), "surface")
    nil = mentions.where("mid = 'NIL' and mention_id is not null and surface is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    langs = documents.select("doc_id", F.col("lang").alias("doc_lang")).where("doc_lang is not null").groupBy("doc_id").agg(F.min("doc_lang").alias("doc_lang"))
    return nil.join(langs, "doc_id", "left").select(
        "mention_id", "doc_id", "surface", "gold_wiki_title", F.coalesce("lang", "doc_lang", F.lit("?")).alias("lang")
    )


def link_entities(mentions: DataFrame) -> DataFrame:
    """(mention_id, doc_id, lang, surface, entity) for the mentions that can be told; ``mentions`` as of ``latest_nil_mentions``."""
    parsed = mentions.select(
        "mention_id", "doc_id", "lang", "surface",
        F.explode(F.array(
            F.struct(F.lit(0).alias("source"), _parser(False)("surface").alias("name")),
            F.struct(F.lit(1).alias("source"), _parser(True)("gold_wiki_title").alias("name")),
        )).alias("form"),
    ).select("mention_id", "doc_id", "lang", "surface", "form.source", "form.name.*")
    parsed = cut_lineage(_split_run_together(parsed.where("size(words) > 0 or size(parts) > 0")))
    words = parsed.select("mention_id", "source", "lang", F.posexplode("words").alias("at", "word"))
    spelled = words.join(spellings(words.select("lang", "word")), ["lang", "word"])
    named = spelled.groupBy("mention_id", "source", "lang").agg(F.array_sort(F.collect_set("spelling")).alias("spelled"))
    met = named.select("lang", F.explode("spelled").alias("word"), "spelled").select("lang", "word", F.explode("spelled").alias("other")).where("word != other")
    met = met.select("lang", _full_form("word").alias("word"), "other")
    degree = met.distinct().groupBy("lang", "word").agg(F.count("*").alias("degree"))
    frequency = spelled.groupBy("lang", F.col("spelling").alias("word")).count()
    ranked = (
        named.select("mention_id", "source", "lang", F.explode("spelled").alias("word"))
        .withColumn("role", _full_form("word"))
        .join(degree.withColumnRenamed("word", "role"), ["lang", "role"], "left")
        .join(frequency, ["lang", "word"], "left")
        .groupBy("mention_id", "source")
        .agg(F.min(F.struct(_key_order().alias("order"), F.coalesce("degree", F.lit(0)).alias("degree"), (-F.length("word")).alias("size"), "word", "count")).alias("key"))
    )
    names = parsed.join(named.drop("lang"), ["mention_id", "source"], "left").join(ranked, ["mention_id", "source"], "left")
    names = names.select(
        "mention_id", "doc_id", "lang", "surface", "source", "qualifier", "parts",
        F.col("key.word").alias("head"), F.coalesce("key.order", F.lit(9)).alias("order"), F.coalesce("key.degree", F.lit(0)).alias("degree"),
        F.array_sort(F.concat(F.array_except(F.coalesce("spelled", F.array().cast("array<string>")), F.array("key.word")), "parts")).alias("rest"),
    )
    # of surface and title the one with the better key word decides, of equals the title
    better = F.struct("order", "degree", -F.col("source"))
    keyed = cut_lineage(
        names.groupBy("mention_id", "doc_id", "lang", "surface").agg(
            F.min_by("head", better).alias("head"),
            F.min_by("rest", better).alias("rest"),
            F.max("qualifier").alias("qualifier"),
            F.max(F.when(F.get("parts", F.lit(0)).startswith("@"), F.get("parts", F.lit(0)))).alias("acronym"),
        )
    )
    blocks = keyed.where("head is not null").groupBy("lang", "head", "rest", "qualifier").agg(F.count("*").alias("n"))
    schema = "lang string, head string, rest array<string>, qualifier string, entities array<string>"
    # rows are few and each costs Python time: keep the session's number of tasks instead of merging them by size
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = blocks.repartition(tasks, "lang", "head").groupBy("lang", "head").applyInPandas(block_entities, schema)
    fit = fitted.select("lang", "head", "rest", F.coalesce("qualifier", F.lit("")).alias("q"), "entities")
    assigned = cut_lineage(
        keyed.withColumn("q", F.coalesce("qualifier", F.lit(""))).join(fit, ["lang", "head", "rest", "q"], "left").select(
            "mention_id", "doc_id", "lang", "surface", "acronym", "head", "rest",
            F.transform("entities", lambda e: F.concat_ws("|", "head", e)).alias("entities"),
        )
    )
    sure = assigned.where("size(entities) = 1").select("mention_id", "doc_id", "lang", "surface", F.get("entities", F.lit(0)).alias("entity"), "head", "rest")
    in_doc = sure.where("size(rest) > 0").groupBy("doc_id", "lang", "entity").agg(
        F.max(_acronym_letters(F.col("entity"))).alias("letters"), F.count("*").alias("n_seen")
    )
    several = assigned.where("size(entities) > 1").select("mention_id", "doc_id", "lang", "surface", F.explode("entities").alias("entity"))
    told = _single(several.join(in_doc, ["doc_id", "lang", "entity"]))
    short = assigned.where("head is null and acronym is not null").withColumn("wanted", F.array_join(F.array_sort(F.split(F.substring("acronym", 2, 9), "")), ""))
    spelled_out = _single(short.join(in_doc.withColumnRenamed("letters", "wanted"), ["doc_id", "lang", "wanted"]).select("mention_id", "doc_id", "lang", "surface", "entity"))
    return sure.drop("head", "rest").unionByName(told).unionByName(spelled_out)


def _full_form(word: str) -> Column:
    """The given name that a nickname stands for, else the word."""
    table = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(word)), F.col(word))


def _key_order() -> Column:
    """A word that occurs once links nothing, so it gives way to any other, however many that one meets."""
    return F.when(F.col("count") >= 2, 0).otherwise(1)


def _single(candidates: DataFrame) -> DataFrame:
    """Mentions whose document names exactly one of their candidates."""
    return (
        candidates.groupBy("mention_id", "doc_id", "lang", "surface")
        .agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
        .where("entity = other")
        .drop("other")
    )


def _acronym_letters(entity: Column) -> Column:
    """The first letters of an entity's words, sorted, as the order of words varies."""
    words = F.filter(F.split(entity, r"[| ]"), lambda w: w != "")
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.substring(w, 1, 1))), "")


def _split_run_together(parsed: DataFrame) -> DataFrame:
    """Chinese names typed without a separator are split behind a given name that occurs in separated names."""
    chinese = F.get("words", F.lit(0)).rlike("[㐀-鿿]")
    given = parsed.where(chinese & (F.size("words") == 2)).groupBy("lang", F.get("words", F.lit(0)).alias("prefix")).agg((F.min(F.get("words", F.lit(1))) != F.max(F.get("words", F.lit(1)))).alias("several"))
    given = given.where("several").select("lang", "prefix")
    single = parsed.where(chinese & (F.size("words") == 1)).select("mention_id", "source", "lang", F.get("words", F.lit(0)).alias("word"))
    prefixes = single.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).where("k + 2 <= length(word)")
    prefixes = prefixes.withColumn("prefix", F.expr("substring(word, 1, k)"))
    split = prefixes.join(given, ["lang", "prefix"]).groupBy("mention_id", "source").agg(F.max(F.struct("k", "prefix", "word")).alias("s"))
    joined = parsed.join(split, ["mention_id", "source"], "left")
    kinds = "|".join(full for full, _ in _ZH_KINDS)
    as_two = F.array("s.prefix", F.expr("substring(s.word, s.k + 1)"))
    return joined.withColumn("words", F.when(F.col("s").isNotNull() & ~F.col("s.word").rlike(f"(?:{kinds})$"), as_two).otherwise(F.col("words"))).drop("s")


def entity_classes(linked: DataFrame) -> DataFrame:
    """(lang, entity, n_mentions, n_forms, first_mention): one row for each entity, whatever the number of its mentions."""
    counted = linked.groupBy("lang", "entity", "surface").agg(F.count("*").alias("n"), F.min("mention_id").alias("first"))
    return counted.groupBy("lang", "entity").agg(F.sum("n").alias("n_mentions"), F.count("*").alias("n_forms"), F.min("first").alias("first_mention"))


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(mention_id_a, mention_id_b): mentions of one entity whose stored surfaces aren't equal."""
    a = linked.select("lang", "entity", F.col("mention_id").alias("mention_id_a"), F.col("surface").alias("surface_a"))
    b = linked.select("lang", "entity", F.col("mention_id").alias("mention_id_b"), F.col("surface").alias("surface_b"))
    return a.join(b, ["lang", "entity"]).where("mention_id_a < mention_id_b and surface_a != surface_b").select("mention_id_a", "mention_id_b").distinct()
