"""Registered queries of the core operators, each with its SQL twin where SQL can express it.

A query takes (spark, sf_dir) and reads whole tables. The SQL stands beside the query; shared parts are
named relations in ``_CTE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.config import Config
from linkloom.functions import text as X
from linkloom.functions import vectors as V
from linkloom.operators import anchors, candidates, coref, evaluate, features, intervals, kb, ner, ranking, rejects, titles, tokens
from linkloom.operators.numbering import numbered
from linkloom.plans import pipeline
from linkloom.session import cut_lineage, spread, table
from linkloom.sources import documents, dumps, sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}



def _kb_form(x: str) -> str:
    """SQL of the knowledge base's form of a title."""
    t = f"replace({x}, ' ', '_')"
    cased = f"array_to_string(list_transform(list_filter(string_split({t}, '_'), lambda x: x != ''), lambda x: upper(x[1:1]) || x[2:]), '_')"
    return f"case when lower({t}) = {t} then {cased} else {t} end"


def _kb_lang(x: str) -> str:
    return f"case {x} when 'zh' then 'zh-cn' else {x} end"


_PIECES = r"regexp_extract_all(text, '\s+|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')"
# Named relations of the SQL twins, in the order in which they build on each other.
_CTE = {
    "m": """select *, start_offset as s, end_offset as e from (
        select *, row_number() over (partition by mention_id order by loaded_at desc nulls last, surface) as rn from mentions) where rn = 1""",
    "anchor": """select lang, lower(trim(surface, ' ')) as surface, lower(replace(wiki_title, ' ', '_')) as title from m
        where lang is not null and surface is not null and wiki_title is not null and wiki_title != 'NIL'""",
    "own_names": "select distinct lang, lower(trim(replace(title, '_', ' '), ' ')) as surface, title from anchor",
    "stat": """select lang, surface, title, cnt, cnt / sum(cnt) over (partition by lang, surface) as p_title_given_surface,
        cnt / sum(cnt) over (partition by lang, title) as p_surface_given_title
        from (select lang, surface, title, count(*) as cnt from (select * from anchor union all select * from own_names) group by all)""",
    "word_pair": r"""select lang, word, title from (
            select lang, unnest(list_filter(regexp_split_to_array(surface, '\s+|·'), lambda t: t != '')) as word, title from anchor
            union all
            select lang, unnest(list_filter(regexp_split_to_array(lower(trim(replace(title, '_', ' '), ' ')), '\s+|·'), lambda t: t != '')) as word, title
            from (select distinct lang, title from anchor))""",
    "word_stat": """select lang, word, title, cnt, cnt / sum(cnt) over (partition by lang, word) as p_title_given_word,
        cnt / sum(cnt) over (partition by lang, title) as p_word_given_title
        from (select lang, word, title, count(*) as cnt from word_pair group by all)""",
    "wanted": "select distinct lang, lower(trim(surface, ' ')) as surface from m where lang is not null and surface is not null",
    "cand": """select * from (select lang, surface, title, cnt, p_title_given_surface, p_surface_given_title,
        row_number() over (partition by lang, surface order by p_title_given_surface desc, title)::int as rank from stat join wanted using (lang, surface)) where rank <= 10""",
    "gram_tg": r"""select lang, title, unnest(list_distinct(case when length(x) >= 4 then list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4)) else [x] end)) as gram
        from (select distinct lang, title, lower(trim(replace(title, '_', ' '), ' ')) as x from stat)""",
    "gram_sg": r"""select lang, surface, unnest(list_distinct(case when length(surface) >= 4 then list_transform(range(1, length(surface) - 2), lambda i: substr(surface, i, 4)) else [surface] end)) as gram
        from wanted where surface != ''""",
    "gram_shared": r"""select sg.lang, surface, title, count(*)::int as shared from gram_sg sg join gram_tg tg on tg.lang = sg.lang and tg.gram = sg.gram group by all""",
    "gram_cand": """select lang, surface, title, shared, rank from (select *, row_number() over (partition by lang, surface order by shared desc, title)::int as rank from gram_shared) where rank <= 10""",
    "title_map": """select f.lang, f.title, min(lower(replace(e.en_title, ' ', '_'))) as en_title
        from (select distinct mid, lang, lower(replace(title, ' ', '_')) as title from kb_titles where lang != 'en' and mid is not null and title is not null) f
        join (select mid, min(title) as en_title from kb_titles where lang = 'en' and mid is not null and title is not null group by mid) e using (mid)
        group by f.lang, f.title""",
    "title_mid": f"select {_kb_form('title')} as title, {_kb_lang('lang')} as lang, min(mid) as mid from kb_titles where title is not null and lang is not null and mid is not null group by all",
    "cand_title": "select distinct lang, title from cand",
    "cand_mid": f"""select c.lang, c.title, coalesce(a.mid, b.mid, d.mid) as mid,
            case when a.mid is not null then 1 when b.mid is not null then 2 when d.mid is not null then 3 end as mid_try
        from cand_title c left join title_map t using (lang, title)
        left join title_mid a on a.title = {_kb_form('c.title')} and a.lang = {_kb_lang('c.lang')}
        left join title_mid b on b.title = {_kb_form('c.title')} and b.lang = 'en'
        left join title_mid d on d.title = {_kb_form('t.en_title')} and d.lang = 'en'""",
    "surface_mid": """select c.lang, c.surface, coalesce(arg_min(k.mid, c.rank) filter (where k.mid is not null), 'NIL') as mid, list(k.mid) as mids
        from cand c join cand_mid k on k.lang = c.lang and k.title = c.title group by c.lang, c.surface""",
    "coarse": r"""select mid, list_sort(list_distinct(flatten(list_transform(types, lambda t: string_split(lower(t), '.'))))) as coarse from kb_types""",
    "redirect": """select p.lang, p.title, min(lower(replace(r.target_title, ' ', '_'))) as target
        from (select distinct page_id, lang, lower(replace(title, ' ', '_')) as title from wiki_pages where ns = 0 and title is not null) p
        join (select page_id, lang, arg_max(target_title, (coalesce(seen_at, timestamp '0001-01-01'), target_title)) as target_title
              from wiki_redirects where lang is not null and target_title is not null group by page_id, lang) r using (page_id, lang)
        group by p.lang, p.title""",
    "piece": f"select doc_id, lang, unnest({_PIECES}) as piece, generate_subscripts({_PIECES}, 1) as pos from documents where text is not null",
    "placed": r"""select doc_id, lang, piece, pos, regexp_matches(piece, '^\s') as blank,
            sum(length(piece)) over (partition by doc_id order by pos)::bigint as e,
            coalesce(sum(case when regexp_matches(piece, '^\s') then 0 else 1 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as tok_id,
            coalesce(sum(case when piece in ('.', '!', '?', '。', '！', '？', '।') or (regexp_matches(piece, '^\s') and contains(piece, chr(10))) then 1 else 0 end)
                over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as sent_id
        from piece""",
    "tok": "select doc_id, lang, tok_id, piece as token, e - length(piece) as s, e, sent_id from placed where not blank",
    "span_tok": """select m.mention_id, m.doc_id, min(tok_id) as first_tok, max(tok_id) as last_tok from m
        join tok on tok.doc_id = m.doc_id and tok.s < m.e and m.s < tok.e
        where m.s >= 0 and m.e > m.s group by m.mention_id, m.doc_id""",
    "df": r"""select lang, word, count(*) as df from (
            select lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(line), '\s+'), lambda t: t != ''))) as word
            from (select lang, unnest(string_split(text, chr(10))) as line from documents where text is not null and lang is not null)) group by lang, word""",
    "top_word": r"""select lang, word, cnt, rank from (
            select lang, word, cnt, row_number() over (partition by lang order by cnt desc, word)::int as rank from (
                select lang, word, count(*) as cnt from (
                    select lang, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t != '')) as word from documents where text is not null and lang is not null)
                where not starts_with(word, 'title_') group by lang, word)) where rank <= 50""",
    "label_mean": "select label, p, avg(v) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings) group by label, p",
    "bio": """select tok.doc_id, tok.sent_id, tok.tok_id, tok.token, tok.s, tok.e,
            case when c.mention_id is null then 'O'
                 when c.mention_id = lag(c.mention_id) over (partition by tok.doc_id order by tok.tok_id) then 'I-' || c.kind else 'B-' || c.kind end as label
        from tok left join (
            select doc_id, tok_id, mention_id, kind from (
                select *, row_number() over (partition by doc_id, tok_id order by ms, mention_id) as rn from (
                    select t.doc_id, t.mention_id, unnest(range(t.first_tok, t.last_tok + 1))::int as tok_id, m.s as ms, m.mention_type as kind
                    from span_tok t join m using (mention_id) where m.mention_type is not null)) where rn = 1) c
        on c.doc_id = tok.doc_id and c.tok_id = tok.tok_id""",
    "num": "select count(*) as n from embeddings",
    "scored": """select m.mention_id, c.rank, c.title, c.p_title_given_surface as "TITLEPROB", c.p_surface_given_title as "SURFACEPROB", coalesce(m.confidence, 0) as "PRESCORE"
        from m join cand c on c.lang = m.lang and c.surface = lower(trim(m.surface, ' '))""",
    "form": """select doc_id, surface, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(surface), '\\s+|·'), lambda t: t != ''))) as tokens
        from (select distinct doc_id, lower(surface) as surface from m)""",
}


def _ngram_cand(g: str) -> str:
    """SQL relations that end with ``<g>_c``: the candidates of the distinct n-grams (lang, surface, n, capitalised) of relation ``g``."""
    return rf"""{g}_s as (select lang, surface, title, p, rank from (
            select w.lang, w.surface, title, p_title_given_surface as p, row_number() over (partition by w.lang, w.surface order by p_title_given_surface desc, title)::int as rank
            from (select lang, surface from {g} union select 'en', surface from {g}) w join stat using (lang, surface)) where rank <= 10),
    {g}_t as (select lang, surface, list_filter(regexp_split_to_array(surface, '\s+'), lambda t: t != '') as tokens from (select lang, surface from {g} where n = 1 and capitalised union select 'en', surface from {g} where n = 1 and capitalised)),
    {g}_e as (select lang, surface, 6 // len(tokens) as share, unnest(list_distinct(tokens)) as word from {g}_t where len(tokens) > 0),
    {g}_w as (select lang, surface, title, p, rank from (
            select lang, surface, title, p_title_given_word as p, row_number() over (partition by lang, surface order by p_title_given_word desc, title, word)::int as rank
            from {g}_e join (select *, row_number() over (partition by lang, word order by p_title_given_word desc, title) as word_rank from word_stat) using (lang, word) where word_rank <= least(share, 6)) where rank <= 6),
    {g}_all as (select g.*, g.lang as cand_lang, title, p as score, rank, 1 as priority from {g} g join {g}_s x on x.lang = g.lang and x.surface = g.surface
        union all select g.*, g.lang, title, p, rank, 2 from {g} g join {g}_w x on x.lang = g.lang and x.surface = g.surface where n = 1 and capitalised
        union all select g.*, 'en', title, p, rank, 3 from {g} g join {g}_s x on x.lang = 'en' and x.surface = g.surface where g.lang != 'en' and (n > 1 or capitalised)
        union all select g.*, 'en', title, p, rank, 4 from {g} g join {g}_w x on x.lang = 'en' and x.surface = g.surface where g.lang != 'en' and n = 1 and capitalised),
    {g}_c as (select * from {g}_all qualify priority = min(priority) over (partition by lang, surface, n, capitalised))"""


def _sql(body: str) -> str:
    """The query with the named relations that it needs, directly or not."""
    recursive = body.startswith("recursive ")
    body = body.removeprefix("recursive ")
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, part in _CTE.items():
            if name not in needed and any(f"{k} {name}{e}" in text.replace("\n", " ") + " " for k in ("from", "join") for e in (" ", ")")):
                needed.add(name)
                todo.append(part)
    ctes = ",\n".join(f"{name} as ({part})" for name, part in _CTE.items() if name in needed)
    own = not body.strip().startswith("select")  # the body names relations of its own first
    return ("with recursive " if recursive else "with ") + ctes + (",\n" if own and ctes else "\n") + body if ctes or own else body


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _sql(sql)
        return f

    return register


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each mention; offsets as start and end."""
    order = Window.partitionBy("mention_id").orderBy(F.desc_nulls_last("loaded_at"), "surface")
    rows = table(spark, d, "mentions").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return rows.withColumnsRenamed({"start_offset": "start", "end_offset": "end"})


def _stat(spark: SparkSession, d: str) -> DataFrame:
    return anchors.surface_title_statistics(anchors.mention_anchors(_mentions(spark, d)))


def _wanted(m: DataFrame) -> DataFrame:
    return m.where("lang is not null and surface is not null").select("lang", X.normal_surface(F.col("surface")).alias("surface"))


def _cands(spark: SparkSession, d: str) -> DataFrame:
    return candidates.by_surface(_wanted(_mentions(spark, d)), _stat(spark, d))


def _title_map(spark: SparkSession, d: str) -> DataFrame:
    return titles.title_map(table(spark, d, "kb_titles"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def _toks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.tokens(_docs(spark, d))


# -- rows that fail to parse -------------------------------------------------------------------------------------


_CELL = r'"(?:[^"]|"")*"|[^"\t][^\t]*|'
_BAD = r"[\p{Cc}\x{FFFD}]"


_LINES = rf"""l as (select distinct line_id, line, regexp_replace(line, '\r$', '') as x from raw_lines),
    p as (select line_id, coalesce(regexp_full_match(x, '(?:{_CELL})(?:\t(?:{_CELL}))*'), true) as formed, coalesce(regexp_extract_all(chr(9) || x, '\t({_CELL})', 1), []) as c from l),
    v as (select line_id, formed, c, list_transform(c, lambda q: case when starts_with(q, '"') then replace(q[2:length(q) - 1], '""', '"') else q end) as f,
        list_bool_or(list_transform(c, lambda q: regexp_matches(case when starts_with(q, '"') then replace(q, chr(9), '') else q end, '{_BAD}'))) as control from p),
    s as (select *, ltrim(split_part(split_part(f[4], ':', 2), '-', 1), '0') as a, ltrim(split_part(split_part(f[4], ':', 2), '-', 2), '0') as b from v),
    r as (select line_id, case when not formed then 'quoting' when len(c) != 7 then 'columns'
        when control or f[1] != 'gold' or not regexp_full_match(f[2], 'EDL_[0-9]{{10}}') or not regexp_matches(f[3], '[^\s\p{{Z}}]')
            or not regexp_full_match(f[4], '(?:ENG|SPA|CMN)_(?:NW|DF)_[0-9]{{10}}:[0-9]+-[0-9]+') or not (length(a) < length(b) or (length(a) = length(b) and a <= b))
            or not regexp_full_match(f[5], '(?:m\.[a-z0-9]+|NIL[0-9]{{5}})') or f[6] not in ('PER', 'ORG', 'GPE', 'LOC', 'FAC') or f[7] not in ('NAM', 'NOM') then 'value' end as reason from s)"""


@_query(_LINES + " select line_id, reason from r where reason is not null")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.violations(rejects.parse_lines(table(spark, d, "raw_lines"))).select("line_id", "reason")


@_query(_LINES + """ select line_id, f[2] as entry_id, f[3] as surface, split_part(f[4], ':', 1) as doc_name, try_cast(split_part(split_part(f[4], ':', 2), '-', 1) as bigint) as start_offset,
        try_cast(split_part(split_part(f[4], ':', 2), '-', 2) as bigint) + 1 as end_offset, f[5] as mid, f[6] as mention_type, f[7] as noun_type,
        case f[4][1:3] when 'ENG' then 'en' when 'SPA' then 'es' else 'zh' end as lang
    from s join r using (line_id) where r.reason is null""")
def p1_mentions(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_gold_lines(table(spark, d, "raw_lines"))[0]


# -- anchor statistics and candidates ----------------------------------------------------------------------------


@_query("""select m.mention_id, m.doc_id, m.lang, m.surface, coalesce(c.title, 'NIL') as linked_title, c.p_title_given_surface as score
    from m left join cand c on c.lang = m.lang and c.surface = lower(trim(m.surface, ' ')) and c.rank = 1""")
def link_top_candidate(spark: SparkSession, d: str) -> DataFrame:
    return candidates.link_top_candidate(_mentions(spark, d), _cands(spark, d))


@_query("select lang, surface, title, cnt, p_title_given_surface, p_surface_given_title from stat")
def surface_title_probs(spark: SparkSession, d: str) -> DataFrame:
    return _stat(spark, d)


@_query("select lang, word, title, cnt, p_title_given_word, p_word_given_title from word_stat")
def word_title_probs(spark: SparkSession, d: str) -> DataFrame:
    return anchors.word_title_statistics(anchors.mention_anchors(_mentions(spark, d)))


@_query(r"""select lower(trim(a.surface, ' ')) as surface, lower(replace(a.title, ' ', '_')) as title, count(*) as cnt from (
    select unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) as surface, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) as title
    from (select '<p>' || string_agg('<a href="/' || wiki_title || '">' || surface || '</a>', ' ' order by mention_id) || '</p>' as html
          from m where wiki_title is not null and surface is not null group by doc_id)) a group by all""")
def anchors_from_pages(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d).where("wiki_title is not null and surface is not null")
    link = F.concat(F.lit('<a href="/'), "wiki_title", F.lit('">'), "surface", F.lit("</a>"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("mention_id", link.alias("a")))), lambda e: e["a"])
    pages = m.groupBy("doc_id").agg(F.concat(F.lit("<p>"), F.array_join(listed, " "), F.lit("</p>")).alias("html"))
    return anchors.html_anchors(pages).groupBy("surface", "title").agg(F.count("*").alias("cnt"))


@_query("select lang, surface, rank, title, cnt, p_title_given_surface, p_surface_given_title from cand")
def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    return _cands(spark, d)


@_query(r"""with_words as (select lang, surface, list_filter(regexp_split_to_array(surface, '\s+'), lambda t: t != '') as tokens from wanted),
    each_word as (select lang, surface, 6 // len(tokens) as share, unnest(list_distinct(tokens)) as word from with_words where len(tokens) > 0),
    best as (select *, row_number() over (partition by lang, word order by p_title_given_word desc, title) as word_rank from word_stat)
    select lang, surface, word, title, p_title_given_word, rank from (
        select lang, surface, word, title, p_title_given_word, row_number() over (partition by lang, surface order by p_title_given_word desc, title, word)::int as rank
        from each_word join best using (lang, word) where word_rank <= least(share, 6)) where rank <= 6""")
def candidates_by_word(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return candidates.by_word(_wanted(m), anchors.word_title_statistics(anchors.mention_anchors(m)))


@_query("""select lang, surface, title, cnt, p_title_given_surface, p_surface_given_title, rank, lang as cand_lang from cand
    union all
    select lang, surface, title, cnt, p_title_given_surface, p_surface_given_title, rank, 'en' as cand_lang from (
        select w.lang, surface, s.title, s.cnt, s.p_title_given_surface, s.p_surface_given_title,
            row_number() over (partition by w.lang, surface order by s.p_title_given_surface desc, s.title)::int as rank
        from (select * from wanted where lang != 'en' and (lang, surface) not in (select (lang, surface) from cand)) w join stat s using (surface) where s.lang = 'en') where rank <= 10""")
def candidates_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return candidates.with_english_fallback(_wanted(m), _stat(spark, d))


@_query(r"""select lang, surface, rank, title, p_title_given_surface from cand
    where not (lang = 'en' and regexp_matches(title, '_language|_people|_cuisine|_dollar|_studies|_americans|disambiguation\)'))
      and not (lang = 'es' and regexp_matches(title, '^idioma_|^pueblo_|\(desambiguación\)$'))
      and (not (lang = 'en' and surface = 'washington') or title = 'washington,_d.c.') and (not (lang = 'en' and surface = 'new york') or title = 'new_york_city')
      and (not (lang = 'en' and surface = 'european') or title = 'europe') and (not (lang = 'en' and surface = 'german') or title = 'germany')
      and (not (lang = 'es' and surface = 'washington') or title = 'washington_d._c.') and (not (lang = 'zh' and surface = '台湾') or title = '中华民国')
      and (not (lang = 'zh' and surface = '中国') or title = '中国') and (not (lang = 'zh' and surface = '共产党') or title = '中国共产党')""")
def candidates_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = candidates.apply_overrides(candidates.drop_unwanted(_cands(spark, d)))
    return kept.select("lang", "surface", "rank", "title", "p_title_given_surface")


@_query(rf"""g as (select distinct lang, lower(trim(surface, ' ')) as surface, len(list_filter(regexp_split_to_array(surface, '\s+'), lambda t: t != ''))::int as n, regexp_matches(surface, '^\p{{Lu}}') as capitalised
        from m where lang is not null and surface is not null),
    {_ngram_cand("g")}
    select lang, surface, n, capitalised, cand_lang, title, score, rank, priority from g_c""")
def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    words = anchors.word_title_statistics(anchors.mention_anchors(m))
    grams = m.where("lang is not null and surface is not null").select(
        "lang", X.normal_surface(F.col("surface")).alias("surface"), F.size(X.tokens_of(F.col("surface"))).alias("n"), X.is_capitalised(F.col("surface")).alias("capitalised")
    )
    return candidates.ngram_candidates(grams, _stat(spark, d), words)


@_query("select lang, surface, title, shared, rank from gram_cand")
def candidates_by_grams(spark: SparkSession, d: str) -> DataFrame:
    return candidates.by_character_grams(_wanted(_mentions(spark, d)), _stat(spark, d))


# -- titles and knowledge base -----------------------------------------------------------------------------------


@_query("select lang, title, en_title from title_map")
def title_map(spark: SparkSession, d: str) -> DataFrame:
    return _title_map(spark, d)


@_query(r"""select s.src_title, t.lang, min(t.tgt_title) as tgt_title
    from (select distinct mid, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as src_title from kb_titles where lang = 'en') s
    join (select distinct mid, lang, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as tgt_title from kb_titles where lang != 'en') t using (mid)
    group by s.src_title, t.lang""")
def title_map_all(spark: SparkSession, d: str) -> DataFrame:
    return titles.all_titles_map(table(spark, d, "kb_titles"))


@_query("""select m.mention_id, m.lang, lower(replace(m.wiki_title, ' ', '_')) as title, coalesce(r.target, lower(replace(m.wiki_title, ' ', '_'))) as resolved
    from m left join redirect r on r.lang = m.lang and r.title = lower(replace(m.wiki_title, ' ', '_')) where m.wiki_title is not null""")
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    targets = titles.redirect_targets(table(spark, d, "wiki_pages"), table(spark, d, "wiki_redirects"))
    rows = _mentions(spark, d).where("wiki_title is not null").select("mention_id", "lang", X.normal_title(F.col("wiki_title")).alias("title"))
    return titles.resolve_redirects(rows, targets).select("mention_id", "lang", "title", "resolved")


@_query("select lang, title, target from redirect")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    return titles.redirect_targets(table(spark, d, "wiki_pages"), table(spark, d, "wiki_redirects"))


@_query("""select m.mention_id, m.lang, lower(replace(m.wiki_title, ' ', '_')) as title,
        case when m.lang = 'en' then lower(replace(m.wiki_title, ' ', '_')) else t.en_title end as en_title
    from m left join title_map t on t.lang = m.lang and t.title = lower(replace(m.wiki_title, ' ', '_')) where m.wiki_title is not null""")
def title_translate(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("wiki_title is not null").select("mention_id", "lang", X.normal_title(F.col("wiki_title")).alias("title"))
    return titles.translate(rows, _title_map(spark, d)).select("mention_id", "lang", "title", "en_title")


@_query("""select m.mention_id, lower(replace(m.en_wiki_title, ' ', '_')) as title, b.foreign_title
    from m left join (select en_title as title, min(title) as foreign_title from title_map where lang = 'es' group by en_title) b on b.title = lower(replace(m.en_wiki_title, ' ', '_'))
    where m.en_wiki_title is not null""")
def title_translate_back(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("en_wiki_title is not null").select("mention_id", X.normal_title(F.col("en_wiki_title")).alias("title"))
    return titles.translate_from_english(rows, _title_map(spark, d), "es").select("mention_id", "title", "foreign_title")


@_query(r"""select s.src_title, array_to_string(list_transform(list_filter(list(struct_pack(lang := s.lang, tag := s.tag) order by case s.lang when 'es' then 1 when 'zh' then 2 else 3 end, s.tag), lambda x: x.tag != ''), lambda x: x.tag), '|') as hashtags from (
        select src_title, lang, regexp_replace(split_part(min(tgt_title), '(', 1), '[\s_-]', '', 'g') as tag from (
            select s.src_title, t.lang, t.tgt_title
            from (select distinct mid, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as src_title from kb_titles where lang = 'en') s
            join (select distinct mid, lang, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as tgt_title from kb_titles where lang != 'en') t using (mid))
        group by src_title, lang) s
    group by s.src_title""")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    tags = titles.hashtags(titles.all_titles_map(table(spark, d, "kb_titles")))
    return tags.select("src_title", F.array_join("hashtags", "|").alias("hashtags"))


@_query(r"""every as (select s.src_title, t.lang, min(t.tgt_title) as tgt_title
        from (select distinct mid, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as src_title from kb_titles where lang = 'en') s
        join (select distinct mid, lang, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as tgt_title from kb_titles where lang != 'en') t using (mid) group by all),
    tag as (select src_title as en_title, list(regexp_replace(split_part(tgt_title, '(', 1), '[\s_-]', '', 'g') order by case lang when 'es' then 1 when 'zh' then 2 else 3 end) as tags from every group by src_title),
    q as (select distinct lang, lower(replace(wiki_title, ' ', '_')) as title from m where lang is not null and wiki_title is not null),
    f as (select q.*, coalesce(case when q.lang = 'en' then q.title else t.en_title end, case when q.lang = 'en' then coalesce(r.target, q.title) else u.en_title end) as en_title from q
        left join title_map t on t.lang = q.lang and t.title = q.title left join redirect r on r.lang = q.lang and r.title = q.title
        left join title_map u on u.lang = q.lang and u.title = coalesce(r.target, q.title)),
    h as (select f.*, list_concat([regexp_replace(split_part(en_title, '(', 1), '[\s_-]', '', 'g')], coalesce(list_filter(tags, lambda x: x != ''), [])) as every from f left join tag using (en_title))
    select lang, title, en_title, case when en_title is not null then array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') end as hashtags from h""")
def title_translator(spark: SparkSession, d: str) -> DataFrame:
    queries = _mentions(spark, d).where("lang is not null and wiki_title is not null").select("lang", X.normal_title(F.col("wiki_title")).alias("title")).distinct()
    targets = titles.redirect_targets(table(spark, d, "wiki_pages"), table(spark, d, "wiki_redirects"))
    found = titles.translate_title(queries, _title_map(spark, d), targets, titles.all_titles_map(table(spark, d, "kb_titles")))
    return found.withColumn("hashtags", F.array_join("hashtags", "|"))


@_query(r"""select distinct t.lang, k.class, array_to_string(list_transform(list_filter(string_split(case when instr(p, '(') > 1 then trim(split_part(p, '(', 1), ' ') else p end, ' '), lambda w: w != ''),
        lambda w: array_to_string(list_transform(list_filter(string_split(w, '-'), lambda x: x != ''), lambda x: upper(x[1:1]) || x[2:]), '-')), ' ') as phrase
    from (select lang, replace(title, '_', ' ') as p, replace(en_title, '_', ' ') as ep from title_map) t
    join (select distinct class, lower(phrase) as phrase from (
        select case when list_contains(types, 'people.person') then 'person' when list_contains(types, 'organization.organization') then 'organization' else 'location' end as class,
            case when instr(ph, '(') > 1 then trim(split_part(ph, '(', 1), ' ') else ph end as phrase
        from (select kt.types, replace(k.title, '_', ' ') as ph from kb_titles k join kb_types kt using (mid) where k.lang = 'en'))) k
    on k.phrase = lower(case when instr(t.ep, '(') > 1 then trim(split_part(t.ep, '(', 1), ' ') else t.ep end)""")
def gazetteer_build(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.array_contains("types", "people.person"), "person").when(F.array_contains("types", "organization.organization"), "organization").otherwise("location")
    english = table(spark, d, "kb_titles").where("lang = 'en'").join(table(spark, d, "kb_types"), "mid")
    classes = english.select(kind.alias("class"), X.cut_parenthesis(F.replace("title", F.lit("_"), F.lit(" "))).alias("phrase"))
    return titles.gazetteer(table(spark, d, "kb_titles"), classes)


@_query("select lang, title, mid, mid_try::int as mid_try from cand_mid where mid is not null union all select lang, title, null, null from cand_mid where mid is null")
def mid_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = _cands(spark, d).select("lang", "title").distinct()
    return kb.mid_chain(rows, table(spark, d, "kb_titles"), _title_map(spark, d)).select("lang", "title", "mid", "mid_try")


@_query("""select c.lang, c.surface, coalesce(arg_min(k.mid, c.rank) filter (where k.mid is not null), 'NIL') as mid, string_agg(coalesce(k.mid, 'NIL'), '|' order by c.rank) as mids
    from cand c join cand_mid k on k.lang = c.lang and k.title = c.title group by c.lang, c.surface""")
def first_mid(spark: SparkSession, d: str) -> DataFrame:
    cands = _cands(spark, d)
    found = kb.mid_chain(cands, table(spark, d, "kb_titles"), _title_map(spark, d))
    return kb.first_mid(found, ["lang", "surface"]).select("lang", "surface", "mid", F.array_join("mids", "|").alias("mids"))


@_query("select mid, array_to_string(coarse, '|') as coarse from coarse")
def coarse_types(spark: SparkSession, d: str) -> DataFrame:
    return kb.coarse_types(table(spark, d, "kb_types")).select("mid", F.array_join("coarse", "|").alias("coarse"))


@_query("select m.mention_id, m.mid, coalesce(array_to_string(t.types, '|'), '') as types from m left join kb_types t using (mid)")
def title_types(spark: SparkSession, d: str) -> DataFrame:
    return kb.types_of_titles(_mentions(spark, d).select("mention_id", "mid"), table(spark, d, "kb_types")).select("mention_id", "mid", F.array_join("types", "|").alias("types"))


@_query("select mid, lang, array_to_string(list_sort(list(distinct title)), '|') as titles from kb_titles where mid is not null and title is not null group by mid, lang")
def mid_titles(spark: SparkSession, d: str) -> DataFrame:
    return kb.titles_of_mids(table(spark, d, "kb_titles")).select("mid", "lang", F.array_join("titles", "|").alias("titles"))


@_query("""select mid, string_agg(type, '|' order by seq) as types from (
        select mid, type, min(seq) as seq from (select mid, unnest(types) as type, generate_subscripts(types, 1) as seq from kb_types) group by mid, type) group by mid""")
def mid_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kb_types").select("mid", F.posexplode("types").alias("seq", "type"))
    return kb.mid_types(rows).select("mid", F.array_join("types", "|").alias("types"))


_EXPECTED = (("PER", "people.person"), ("ORG", "organization.organization"), ("GPE", "location.location"), ("LOC", "location.location"))


@_query("""select m.mention_id, m.mid, m.mention_type, array_to_string(t.types, '|') as types from m join kb_types t using (mid)
    join (values ('PER', 'people.person'), ('ORG', 'organization.organization'), ('GPE', 'location.location'), ('LOC', 'location.location')) x(mention_type, kb_type) using (mention_type)
    where not list_contains(t.types, x.kb_type)""")
def type_contradictions(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame(_EXPECTED, "mention_type string, kb_type string")
    return kb.type_contradictions(_mentions(spark, d), table(spark, d, "kb_types"), expected).withColumn("types", F.array_join("types", "|"))


# -- corpus statistics -------------------------------------------------------------------------------------------


@_query("select lang, word, df from df")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_frequency(table(spark, d, "documents"))


@_query("select lang, word, cnt, rank from top_word")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.top_words(table(spark, d, "documents"))


_PUNCTUATION = (".", ",", "!", "?", ";", ":", "(", ")", '"', "'", "-")


@_query("""select lang, word from top_word union
    select lang, mark from (select distinct lang from top_word), (values ('.'), (','), ('!'), ('?'), (';'), (':'), ('('), (')'), ('"'), (''''), ('-')) v(mark)""")
def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.stop_words(table(spark, d, "documents"), _PUNCTUATION)


@_query("""ctx as (select t.mention_id, k.lang, lower(k.token) as word from span_tok t join tok k on k.doc_id = t.doc_id
        and ((k.tok_id between t.first_tok - 5 and t.first_tok - 1) or (k.tok_id between t.last_tok + 1 and t.last_tok + 5))),
    counted as (select mention_id, lang, word, count(*) as cnt from ctx group by all)
    select mention_id, lang, word, cnt / sum(cnt) over (partition by mention_id) as tf,
        round(coalesce(ln(sum(df) over (partition by mention_id) / df), 0), 6) as idf
    from counted left join df using (lang, word)""")
def context_tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    context = tokens.text_contexts(_mentions(spark, d).select("mention_id", "doc_id", "start", "end"), docs, 5)
    scored = tokens.context_tfidf(context, tokens.document_frequency(docs))
    return scored.select("mention_id", "lang", "word", "tf", F.round("idf", 6).alias("idf"))


# -- vectors and ranking -----------------------------------------------------------------------------------------


@_query("select label, (p - 1)::int as place, round(mean, 6) as mean from label_mean")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    return ranking.mean_vector(rows, ["label"]).select("label", F.posexplode("mean").alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@_query("""select label, (p - 1)::int as place, round(sum(w * v) / sum(w), 6) as mean
    from (select label, 1.0 / (1 + vec_id) as w, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings) group by label, p""")
def vector_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"), (F.lit(1.0) / (1 + F.col("vec_id"))).alias("w"))
    return ranking.mean_vector(rows, ["label"], "w").select("label", F.posexplode("mean").alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@_query("""select e.vec_id, e.label, round(coalesce(sum(e.v * l.mean) / nullif(sqrt(sum(e.v * e.v)) * sqrt(sum(l.mean * l.mean)), 0), 0), 6) as cosine, round(sqrt(sum(e.v * e.v)), 6) as norm
    from (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings) e join label_mean l on l.label = e.label and l.p = e.p
    group by e.vec_id, e.label""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    means = ranking.mean_vector(e.select("label", F.col("embedding").alias("vec")), ["label"])
    joined = e.join(means, "label")
    return joined.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("mean")), 6).alias("cosine"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


_WORD_VEC = "(length(word) * 131 + ascii(word) * 31) % num.n"


@_query(f"""ctx as (select t.mention_id, k.lang, lower(k.token) as word from span_tok t join tok k on k.doc_id = t.doc_id
        and ((k.tok_id between t.first_tok - 5 and t.first_tok - 1) or (k.tok_id between t.last_tok + 1 and t.last_tok + 5))),
    counted as (select mention_id, lang, word, count(*) as cnt from ctx group by all),
    w as (select mention_id, lang, word, cnt / sum(cnt) over (partition by mention_id) * coalesce(ln(sum(df) over (partition by mention_id) / df), 0) as weight from counted left join df using (lang, word)),
    v as (select w.mention_id, weight, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from w cross join num join embeddings on vec_id = {_WORD_VEC} where w.lang is not null),
    mean as (select mention_id, p, case when sum(weight) = 0 then 0 else sum(weight * x) / sum(weight) end as a from v group by all),
    own as (select mention_id, unnest(embedding)::double as b, generate_subscripts(embedding, 1) as p from m cross join num join embeddings on vec_id = mention_id % num.n)
    select mention_id, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0), 5) as "W_CON30" from mean join own using (mention_id, p) group by mention_id""")
def context_feature(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the weighted context vector and the title's vector; words and titles stand for vectors of the table by their letters and numbers."""
    docs, e = _docs(spark, d), table(spark, d, "embeddings")
    n = e.count()
    m = _mentions(spark, d)
    context = tokens.text_contexts(m.select("mention_id", "doc_id", "start", "end"), docs, 5)
    weighted = tokens.context_tfidf(context, tokens.document_frequency(docs))
    words = weighted.select("lang", "word").distinct().withColumn("vec_id", (F.length("word") * 131 + F.ascii("word") * 31) % n)
    vectors = e.select("vec_id", F.col("embedding").alias("vec"))
    of_words = words.join(vectors, "vec_id").select("lang", F.col("word").alias("key"), "vec")
    means = ranking.context_vectors(weighted, of_words)
    titled = means.withColumn("vec_id", F.col("mention_id") % n).join(vectors, "vec_id")
    return titled.select("mention_id", F.round(V.cosine(F.col("mean"), F.col("vec")), 5).alias("W_CON30"))


@_query(f"""word as (select mention_id, unnest(list_filter(regexp_split_to_array(lower(surface), '\\s+|·'), lambda t: t != '')) as word from m where surface is not null),
    v as (select mention_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from word cross join num join embeddings on vec_id = {_WORD_VEC}),
    mean as (select mention_id, p, avg(x) as a from v group by all)
    select mention_id, round(sqrt(sum(a * a)), 5) as norm from mean group by mention_id""")
def mention_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length of the mean word vector of each surface; words stand for vectors of the table by length and first letter."""
    e = table(spark, d, "embeddings")
    n = e.count()
    m = _mentions(spark, d).where("surface is not null").withColumn("lang", F.lit("x"))
    words = m.select(F.explode(F.filter(F.split(F.lower("surface"), r"\s+|·"), lambda t: t != "")).alias("word")).distinct()
    keyed = words.withColumn("vec_id", (F.length("word") * 131 + F.ascii("word") * 31) % n)
    vectors = keyed.join(e, "vec_id").select(F.lit("x").alias("lang"), F.col("word").alias("key"), F.col("embedding").alias("vec"))
    return ranking.mention_vectors(m, vectors).select("mention_id", F.round(V.norm(F.col("mean")), 5).alias("norm"))


@_query("""vec as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
    men as (select distinct m.doc_id, m.mention_id % num.n as vec_id from m cross join num where m.mid != 'NIL'),
    pair as (select a.doc_id, a.vec_id, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) as c
        from men a join men b on a.doc_id = b.doc_id and a.vec_id != b.vec_id join vec x on x.vec_id = a.vec_id join vec y on y.vec_id = b.vec_id)
    select a.doc_id, a.vec_id, round(coalesce(max(c), 0), 6) as cos_max, round(coalesce(min(c), 0), 6) as cos_min from men a left join pair using (doc_id, vec_id) group by a.doc_id, a.vec_id""")
def minmax_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.count()
    men = _mentions(spark, d).where("mid != 'NIL'").select("doc_id", (F.col("mention_id") % n).alias("vec_id")).distinct()
    rows = men.join(e.select("vec_id", V.doubles(F.col("embedding")).alias("vec")), "vec_id", "left").withColumnRenamed("vec_id", "id")
    found = ranking.extreme_cosines_within(rows, "doc_id")
    return found.select("doc_id", F.col("id").alias("vec_id"), F.round("cos_max", 6).alias("cos_max"), F.round("cos_min", 6).alias("cos_min"))


def _stand_in_vectors(spark: SparkSession, d: str, docs: DataFrame, m: DataFrame) -> DataFrame:
    """(lang, key, vec) for the words of texts and the titles: each stands for a vector of the table by its length and first letter."""
    e = table(spark, d, "embeddings")
    n = e.count()
    words = tokens.tokens(docs).select("lang", F.lower("token").alias("key")).unionByName(
        m.where("surface is not null").select("lang", F.explode(F.filter(F.split(F.lower("surface"), r"\s+|·"), lambda t: t != "")).alias("key"))
    )
    kb = table(spark, d, "kb_titles").where("title is not null").select("lang", F.concat(F.lit("title_"), X.normal_title(F.col("title"))).alias("key"))
    kb = kb.unionByName(_stat(spark, d).select("lang", F.concat(F.lit("title_"), "title").alias("key")))
    keys = words.unionByName(kb).where("lang is not null and key is not null").distinct()
    name = F.replace("key", F.lit("title_"), F.lit(""))
    vec_id = (F.length(name) * 131 + F.ascii(name) * 31) % n
    return keys.withColumn("vec_id", vec_id).join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("lang", "key", "vec")


_VEC_ID = "(length({0}) * 131 + ascii({0}) * 31) % num.n"


@_query(f"""vec as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
    pick as (select m.mention_id, m.doc_id, m.lang, c.rank, c.title, c.p_title_given_surface as tp, c.p_surface_given_title as sp from m join cand c on c.lang = m.lang and c.surface = lower(trim(m.surface, ' '))),
    back as (select lang, en_title, min(title) as title from title_map group by all),
    pair as (select p.*, case when p.lang = 'en' then p.title else t.en_title end as et, case when p.lang != 'en' then p.title end as ft from pick p left join title_map t on t.lang = p.lang and t.title = p.title),
    known_key as (select distinct lang, lower(replace(title, ' ', '_')) as title from kb_titles where lang is not null and title is not null union select lang, title from stat),
    tv as (select p.mention_id, p.doc_id, p.rank, p.title, tp, sp, e.v as ev, f.v as fv from pair p cross join num
        left join known_key ke on ke.lang = 'es' and ke.title = p.et left join vec e on ke.title is not null and e.vec_id = {_VEC_ID.format('p.et')}
        left join known_key kf on kf.lang = p.lang and kf.title = p.ft and p.lang != 'en' left join vec f on kf.title is not null and f.vec_id = {_VEC_ID.format('p.ft')}),
    ctx as (select t.mention_id, k.lang, lower(k.token) as word from span_tok t join tok k on k.doc_id = t.doc_id
        and ((k.tok_id between t.first_tok - 5 and t.first_tok - 1) or (k.tok_id between t.last_tok + 1 and t.last_tok + 5))),
    counted as (select mention_id, lang, word, count(*) as cnt from ctx group by all),
    w as (select mention_id, lang, word, cnt / sum(cnt) over (partition by mention_id) * coalesce(ln(sum(df) over (partition by mention_id) / df), 0) as weight from counted left join df using (lang, word)),
    es_word as (select distinct lower(token) as word from tok where lang = 'es' union select unnest(list_filter(regexp_split_to_array(lower(surface), '\\s+|·'), lambda t: t != '')) from m where lang = 'es' and surface is not null),
    x as (select w.mention_id, weight, unnest(v) as a, generate_subscripts(v, 1) as p from w cross join num join vec on vec_id = {_VEC_ID.format('w.word')} where w.lang is not null and (w.lang != 'en' or w.word in (select word from es_word))),
    mean as (select mention_id, list(case when sw = 0 then 0 else swa / sw end order by p) as c from (select mention_id, p, sum(weight) as sw, sum(weight * a) as swa from x group by all) group by mention_id)
    select t.mention_id, t.rank, t.title, tp as "TITLEPROB", sp as "SURFACEPROB",
        round(coalesce(list_dot_product(c, ev) / nullif(sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(ev, ev)), 0), 0), 5) as "W_CON30",
        round(coalesce(list_dot_product(c, fv) / nullif(sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(fv, fv)), 0), 0), 5) as "W_CON30_L"
    from tv t left join mean using (mention_id)""")
def ranker_features(spark: SparkSession, d: str) -> DataFrame:
    """The base features in tagging mode; the query shows the probabilities and the narrowest context."""
    docs, m = _docs(spark, d), _mentions(spark, d)
    rows = m.select("mention_id", "lang", X.normal_surface(F.col("surface")).alias("surface")).join(_cands(spark, d), ["lang", "surface"]).withColumn("cand_lang", F.col("lang"))
    vectors = features.aliased(_stand_in_vectors(spark, d, docs, m))
    found = features.static_features(m, rows, docs, tokens.document_frequency(docs), _title_map(spark, d), vectors, ner_mode=True)
    return found.select("mention_id", "rank", "title", "TITLEPROB", "SURFACEPROB", F.round("W_CON30", 5).alias("W_CON30"), F.round("W_CON30_L", 5).alias("W_CON30_L"))


_WEIGHTS = (0.9137313, 0.4171717, 0.0973137, 0.3090171, 0.2113979, -0.1071313)
_FEATURES = ("TITLEPROB", "SURFACEPROB", "PRESCORE")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    m, cands = _mentions(spark, d), _cands(spark, d)
    keyed = m.select("mention_id", "doc_id", "start", "lang", X.normal_surface(F.col("surface")).alias("surface"), F.coalesce("confidence", F.lit(0.0)).alias("PRESCORE"), "gold_wiki_title")
    joined = keyed.join(cands, ["lang", "surface"])
    return joined.withColumns({"TITLEPROB": F.col("p_title_given_surface"), "SURFACEPROB": F.col("p_surface_given_title")})


@_query("""s as (select mention_id, rank, title, "TITLEPROB" * 0.9137313::double + "SURFACEPROB" * 0.4171717::double + "PRESCORE" * 0.0973137::double + ("TITLEPROB" * "SURFACEPROB") * 0.3090171::double + ("TITLEPROB" * "PRESCORE") * 0.2113979::double + ("SURFACEPROB" * "PRESCORE") * (-0.1071313)::double as score from scored)
    select mention_id, rank, title, round(score, 6) as score from s""")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    return ranking.score_candidates(_scored(spark, d), _FEATURES, _WEIGHTS).select("mention_id", "rank", "title", F.round("score", 6).alias("score"))


@_query("""s as (select mention_id, rank, title, round("TITLEPROB" * 0.9137313::double + "SURFACEPROB" * 0.4171717::double + "PRESCORE" * 0.0973137::double + ("TITLEPROB" * "SURFACEPROB") * 0.3090171::double + ("TITLEPROB" * "PRESCORE") * 0.2113979::double + ("SURFACEPROB" * "PRESCORE") * (-0.1071313)::double, 9) as score from scored),
    r as (select *, row_number() over w as n, lead(score) over w as second from s window w as (partition by mention_id order by score desc, rank))
    select mention_id, title, round(score, 6) as score, round(coalesce(1 / (1 + exp(second - score)), 1), 6) as confidence from r where n = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    scored = ranking.score_candidates(_scored(spark, d), _FEATURES, _WEIGHTS).withColumn("score", F.round("score", 9))
    best = ranking.best_candidate(scored, ["mention_id"])
    return best.select("mention_id", "title", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@_query("""select mention_id, rank, round("TITLEPROB" * "SURFACEPROB", 9) as "COMBO_TITLEPROB_SURFACEPROB", round("TITLEPROB" * "PRESCORE", 9) as "COMBO_TITLEPROB_PRESCORE",
    round("SURFACEPROB" * "PRESCORE", 9) as "COMBO_SURFACEPROB_PRESCORE" from scored""")
def feature_combos(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.with_products(_scored(spark, d), _FEATURES)
    return rows.select("mention_id", "rank", *[F.round(name, 9).alias(name) for name, _ in V.feature_products(_FEATURES)])


@_query()
def rank_documents(spark: SparkSession, d: str) -> DataFrame:
    """Candidates ranked document by document; a title stands for a vector of the table by its hash."""
    e = table(spark, d, "embeddings")
    n = e.count()
    rows = _scored(spark, d).withColumn("vec_id", F.pmod(F.xxhash64("title"), F.lit(n)))
    rows = rows.join(e.select("vec_id", V.doubles(F.col("embedding")).alias("vec")), "vec_id", "left")
    static = rows.select("doc_id", "mention_id", "start", "rank", "title", F.array(*_FEATURES).alias("features"), "vec")
    return ranking.rank_documents(static, [0.9, 0.4, 0.1, 0.3, 0.1, 0.1])


_MAIN = "list_has_any(coalesce(t.types, []), ['people.person', 'organization.organization', 'location.location'])"


@_query(f"""typed as (select m.mention_id, m.lang, lower(trim(m.surface, ' ')) as surface, lower(replace(m.gold_wiki_title, ' ', '_')) as gold, {_MAIN} as main, bool_or({_MAIN}) over (partition by m.doc_id) as any_main
        from m left join kb_types t using (mid)),
    hit as (select typed.mention_id, typed.lang, case when c.rank = 1 then 'easy' else 'hard' end as kind from typed join gram_cand c on c.lang = typed.lang and c.surface = typed.surface and c.title = typed.gold where main or not any_main),
    nums as (select *, row_number() over (partition by lang, kind order by md5(mention_id::varchar), mention_id) as n, sum(case when kind = 'hard' then 1 else 0 end) over (partition by lang) as n_hard from hit)
    select mention_id, lang, kind from nums where kind = 'hard' or n <= n_hard""")
def train_selection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by character grams, whose first one often isn't the gold title."""
    m = _mentions(spark, d)
    return ranking.select_training(m, candidates.by_character_grams(_wanted(m), _stat(spark, d)), table(spark, d, "kb_types"))


@_query("""select mention_id as qid, rank, concat_ws(' ', case when lower(s.title) = lower(m.gold_wiki_title) then '2' else '1' end, 'qid:' || mention_id,
        case when "TITLEPROB" != 0 then '1:' || printf('%.7f', "TITLEPROB") end, case when "SURFACEPROB" != 0 then '2:' || printf('%.7f', "SURFACEPROB") end,
        case when "PRESCORE" != 0 then '3:' || printf('%.7f', "PRESCORE") end) as line
    from scored s join m using (mention_id)""")
def svm_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.svm_rows(_scored(spark, d).withColumnRenamed("gold_wiki_title", "gold"), _FEATURES)


@_query()
def train_ranker(spark: SparkSession, d: str) -> DataFrame:
    weights = ranking.train_ranker(_scored(spark, d).withColumn("gold", X.normal_title(F.col("gold_wiki_title"))), _FEATURES)
    return spark.createDataFrame(list(zip(_FEATURES, weights, strict=True)), "feature string, weight double")


# -- n-grams, labels, intervals ----------------------------------------------------------------------------------


@_query(r"""cut as (select t.*, split_part(token, '''', 1) as cut, w.word is not null as stop from tok t left join top_word w on w.lang = t.lang and w.word = lower(split_part(token, '''', 1))),
    sent as (select doc_id, lang, sent_id, list(cut order by tok_id) as c, list(stop order by tok_id) as st from cut group by all),
    spot as (select *, unnest(range(1, len(c) + 1)) as i from sent),
    grams as (select doc_id, n, case when lang = 'zh' then array_to_string(c[i:i + n - 1], '') else array_to_string(c[i:i + n - 1], ' ') end as g, list_bool_and(st[i:i + n - 1]) as stop
        from spot, (values (1), (2), (3), (4)) size(n) where i + n - 1 <= len(c))
    select doc_id, n::int as n, count(*) as n_grams, count(distinct g) as n_distinct, sum(stop::int)::bigint as n_stop,
        sum(regexp_matches(trim(g, ' '), '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$')::int)::bigint as n_numbers from grams group by doc_id, n""")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    stops = tokens.top_words(docs).select("lang", "word")
    grams = tokens.ngrams_upto(tokens.token_lists(docs), 4, stops)
    return grams.groupBy("doc_id", "n").agg(
        F.count("*").alias("n_grams"), F.count_distinct("surface").alias("n_distinct"), F.sum(F.col("is_stop").cast("int")).alias("n_stop"), F.sum(X.is_number(F.col("surface")).cast("int")).alias("n_numbers")
    )


def _typed_lists(spark: SparkSession, d: str, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Token lists cut to the n-grams that the index may know, the types of these n-grams, stop words."""
    stops = cut_lineage(tokens.top_words(docs).select("lang", "word"))
    linked = cut_lineage(anchors.mention_anchors(_mentions(spark, d)))
    stat, words = cut_lineage(anchors.surface_title_statistics(linked)), cut_lineage(anchors.word_title_statistics(linked))
    known = ner.known_grams(stat, words)
    lists = ner.known_lists(docs, stat, words, known=known)
    types = ner.gram_types(ner.surface_forms(lists, 4, stops, known), stat, words, table(spark, d, "kb_titles"), _title_map(spark, d), table(spark, d, "kb_types"))
    return lists, types, stops


# the n-grams of the texts with their candidates, the first mid of these and its types
_TYPED = rf"""cut as (select t.*, split_part(token, '''', 1) as cut, w.word is not null as stop from tok t left join top_word w on w.lang = t.lang and w.word = lower(split_part(token, '''', 1))),
    sent as (select doc_id, lang, sent_id, list(cut order by tok_id) as c, list(stop order by tok_id) as st, list(s order by tok_id) as ss, list(e order by tok_id) as es from cut group by all),
    spot as (select *, unnest(range(1, len(c) + 1)) as i from sent),
    whole as (select doc_id, lang, ss[i] as s, es[i + n - 1] as e, n::int as n, case when lang = 'zh' then array_to_string(c[i:i + n - 1], '') else array_to_string(c[i:i + n - 1], ' ') end as surface, list_bool_and(st[i:i + n - 1]) as stop
        from spot, (values (1), (2), (3), (4)) size(n) where i + n - 1 <= len(c)),
    asked as (select *, lower(surface) as low, regexp_matches(surface, '^\p{{Lu}}') as capitalised from whole where not stop and not regexp_matches(trim(surface, ' '), '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$')),
    g as (select distinct lang, low as surface, n, capitalised from asked where lang is not null),
    {_ngram_cand("g")},
    g_mid as (select c.lang, c.surface, c.n, c.capitalised, coalesce(a.mid, b.mid, d.mid) as mid, c.rank from g_c c left join title_map t on t.lang = c.cand_lang and t.title = c.title
        left join title_mid a on a.title = {_kb_form('c.title')} and a.lang = {_kb_lang('c.cand_lang')}
        left join title_mid b on b.title = {_kb_form('c.title')} and b.lang = 'en' left join title_mid d on d.title = {_kb_form('t.en_title')} and d.lang = 'en'),
    g_type as (select lang, surface, n, capitalised, list_distinct(list_transform(coarse, lambda t: case when t = 'people' then 'person' else t end)) as coarse
        from (select lang, surface, n, capitalised, arg_min(mid, rank) as mid from g_mid where mid is not null group by all) join coarse using (mid)),
    hit4 as (select a.doc_id, a.s, a.e, a.n, list_transform(coalesce(t.coarse, []), lambda t: 'TOPFBTYPETOKEN-' || t) as own from asked a left join g_type t on t.lang = a.lang and t.surface = a.low and t.n = a.n and t.capitalised = a.capitalised)"""


def _level(n: int) -> str:
    """SQL relation ``level<n>``: n-grams of n tokens with the features of the longer ones around them, else their own."""
    own = f"select doc_id, s, e, n, list_sort(own) as features from hit4 h where n = {n} and len(own) > 0"
    if n == 4:
        return f"level4 as ({own})"
    kinds = "(values ('person'), ('location'), ('organization')) k(kind)"
    return f"""taken{n} as (select h.doc_id, h.s, h.e, h.n, list_sort(list_distinct(list(case when h.s > o.s then 'I-' else 'B-' end || 'TOPFBTYPETOKEN-' || kind))) as features
        from hit4 h join level{n + 1} o on o.doc_id = h.doc_id and h.s >= o.s and h.e <= o.e, {kinds}
        where h.n = {n} and list_bool_or(list_transform(o.features, lambda f: contains(f, 'TOPFBTYPETOKEN-' || kind))) group by all),
    level{n} as (select * from taken{n} union all {own} and not exists (select 1 from taken{n} t where t.doc_id = h.doc_id and t.s = h.s and t.e = h.e))"""


_CASCADE = _TYPED + "".join(f",\n    {_level(n)}" for n in (4, 3, 2, 1))


@_query(_CASCADE + """
    select doc_id, s as start, e as "end", n, array_to_string(features, '|') as features from (select * from level4 union all select * from level3 union all select * from level2 union all select * from level1)""")
def ngram_propagation(spark: SparkSession, d: str) -> DataFrame:
    """The n-gram cascade with candidates, their first mid and its types."""
    lists, types, stops = _typed_lists(spark, d, _docs(spark, d))
    types = cut_lineage(types)
    found = ner.wikify_ngrams(lists, types, stops)
    return found.withColumn("features", F.array_join("features", "|"))


@_query(r"""phrase as (select distinct lang, lower(trim(replace(title, '_', ' '), ' ')) as g from kb_titles where lang is not null and title is not null),
    longest as (select lang, max(case when lang = 'zh' then length(p) else len(string_split(p, ' ')) end) as longest
        from (select lang, trim(replace(title, '_', ' '), ' ') as p from kb_titles where lang is not null and title is not null) group by lang),
    sent as (select doc_id, lang, sent_id, list(split_part(token, '''', 1) order by tok_id) as c, list(s order by tok_id) as ss, list(e order by tok_id) as es from tok group by all),
    spot as (select *, unnest(range(1, len(c) + 1)) as i from sent join longest using (lang)),
    size as (select *, unnest(range(1, least(longest, len(c) - i + 1) + 1)) as n from spot),
    grams as (select doc_id, lang, n, ss[i] as s, es[i + n - 1] as e, case when lang = 'zh' then array_to_string(c[i:i + n - 1], '') else array_to_string(c[i:i + n - 1], ' ') end as g from size)
    select doc_id, s as start, e as "end", n::int as n from grams join phrase on phrase.lang = grams.lang and phrase.g = lower(grams.g)""")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the knowledge base in texts, up to the longest title of a language."""
    docs = _docs(spark, d)
    phrases = table(spark, d, "kb_titles").where("lang is not null and title is not null").select("lang", F.replace("title", F.lit("_"), F.lit(" ")).alias("phrase"), F.lit("kb").alias("class"))
    hits = ner.phrase_hits(tokens.token_lists(docs.where("false")), phrases, 1)
    # the n-grams of a language are made up to its own longest phrase only
    for lang, longest in ner.longest_phrases(phrases).items():
        of_lang = F.col("lang") == lang
        hits = hits.unionByName(ner.phrase_hits(tokens.token_lists(docs.where(of_lang)), phrases.where(of_lang), longest))
    return hits.drop("class")


@_query("""sp as (select mention_id, doc_id, s, e, mention_type from m where s is not null and e > s)
    select distinct a.doc_id, a.s as start, a.e as "end", case when a.s > b.s then 'I-' else 'B-' end || 'TOPFBTYPETOKEN-' || case b.mention_type when 'PER' then 'person' when 'ORG' then 'organization' else 'location' end as feature
    from sp a join sp b on a.doc_id = b.doc_id and a.s >= b.s and a.e <= b.e where b.mention_type in ('PER', 'ORG', 'LOC')""")
def span_propagation(spark: SparkSession, d: str) -> DataFrame:
    spans = _mentions(spark, d).where("start is not null and end > start")
    kind = F.when(F.col("mention_type") == "PER", "person").when(F.col("mention_type") == "ORG", "organization").otherwise("location")
    outer = spans.where("mention_type in ('PER', 'ORG', 'LOC')").select("doc_id", "start", "end", F.array(F.concat(F.lit("TOPFBTYPETOKEN-"), kind)).alias("features"))
    return intervals.propagate_types(spans, outer)


@_query("""typed as (select m.mention_id, m.doc_id, m.s, m.mid, c.coarse from m left join coarse c using (mid)),
    named as (select *, lag(coarse) over (partition by doc_id order by s nulls first, mention_id) as before from typed)
    select mention_id, doc_id, case when mid is null or starts_with(mid, 'NIL') then '' else array_to_string(list_sort(list_distinct(list_concat(
        list_transform(coalesce(coarse, []), lambda t: 'TOPFBTYPETOKEN-' || t),
        list_transform(list_filter(coalesce(before, []), lambda t: t in ('location', 'person', 'organization')), lambda t: 'BEFOREFBTYPETOKEN-' || t)))), '|') end as features from named""")
def neighbour_types(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).withColumn("is_stop", F.lit(False))
    found = ner.neighbour_features(rows, kb.coarse_types(table(spark, d, "kb_types")))
    return found.withColumn("features", F.array_join("features", "|"))


def _bio(spark: SparkSession, d: str) -> DataFrame:
    return intervals.bio_encode(_toks(spark, d), _mentions(spark, d).select("mention_id", "doc_id", "start", "end", "mention_type"))


@_query("select doc_id, tok_id, token, s as start, e as \"end\", label from bio where label != 'O'")
def bio_encode(spark: SparkSession, d: str) -> DataFrame:
    return _bio(spark, d).where("label != 'O'").select("doc_id", "tok_id", "token", "start", "end", "label")


@_query("""k as (select *, case when label != 'O' then substr(label, 3) end as kind from bio),
    b as (select *, sum(case when starts_with(label, 'B-') or kind is distinct from prev then 1 else 0 end) over (partition by doc_id, sent_id order by tok_id) as run
        from (select *, lag(kind) over (partition by doc_id, sent_id order by tok_id) as prev from k))
    select doc_id, sent_id, min(s) as start, max(e) as "end", any_value(kind) as mention_type from b where kind is not null group by doc_id, sent_id, run""")
def bio_decode(spark: SparkSession, d: str) -> DataFrame:
    return intervals.bio_decode(_bio(spark, d))


@_query(r"""select doc_id, sent_id, tok_id, concat_ws(chr(9), label, s::varchar, e::varchar, 'x', 'x', token, 'x', 'x', 'x', 'x') as line from bio where not regexp_matches(token, '^\s*$') and not starts_with(token, 'http:')""")
def conll_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.conll_lines(_bio(spark, d))


@_query("""mark as (select doc_id, tok_id, token, s, e from tok where token in ('“', '”')),
    q as (select doc_id, s, close as e from (
        select *, min(case when token = '”' then e end) over (partition by doc_id order by tok_id rows between 1 following and unbounded following) as close from mark) where token = '“' and close is not null)
    select mention_id, doc_id, s::varchar as start, e::varchar as "end" from m where not exists (select 1 from q where q.doc_id = m.doc_id and m.s < q.e and q.s < m.e)""")
def interval_antijoin(spark: SparkSession, d: str) -> DataFrame:
    quoted = intervals.quotation_spans(_toks(spark, d))
    kept = intervals.drop_overlapping(_mentions(spark, d).select("mention_id", "doc_id", "start", "end"), quoted)
    return kept.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@_query("""select mention_id, doc_id, start::varchar as start, "end"::varchar as "end", surface from (
    select mention_id, doc_id, s as start, e as "end", surface, row_number() over (partition by doc_id, s, e order by mention_id) as n from m) where n = 1""")
def span_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = intervals.first_of_span(_mentions(spark, d).select("mention_id", "doc_id", "start", "end", "surface"))
    return kept.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@_query(r"""raw as (select mention_id, surface || case mention_id % 3 when 0 then ' <br>x' when 1 then '<a' else '' end as raw, e from m),
    c as (select *, regexp_replace(raw, '(?s)\s*<.*', '') as cut from raw)
    select mention_id, case when instr(raw, '<') > 0 and length(cut) > 0 then cut else raw end as surface,
        (e - (length(raw) - length(case when instr(raw, '<') > 0 and length(cut) > 0 then cut else raw end)))::varchar as "end" from c""")
def surface_clean(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("mention_id") % 3 == 0, " <br>x").when(F.col("mention_id") % 3 == 1, "<a").otherwise("")
    raw = _mentions(spark, d).select("mention_id", F.concat("surface", tail).alias("raw"), "end")
    surface, end = X.clean_surface(F.col("raw"), F.col("end"))
    return raw.select("mention_id", surface.alias("surface"), end.cast("string").alias("end"))


@_query("""recursive sp as (select mention_id, doc_id, s, e, row_number() over (partition by doc_id order by s, e, mention_id) as n from m where s is not null and e > s),
    meet as (select a.doc_id, a.n as i, b.n as j, case when a.e - a.s >= b.e - b.s then b.n else a.n end as loser, row_number() over (partition by a.doc_id order by a.n, b.n) as k
        from sp a join sp b on a.doc_id = b.doc_id and a.n < b.n and a.s < b.e and b.s < a.e),
    walk as (select distinct doc_id, 0::bigint as k, []::bigint[] as gone from sp
        union all select w.doc_id, p.k, case when list_contains(w.gone, p.i) or list_contains(w.gone, p.j) then w.gone else list_append(w.gone, p.loser) end
        from walk w join meet p on p.doc_id = w.doc_id and p.k = w.k + 1),
    told as (select doc_id, arg_max(gone, k) as gone from walk group by doc_id)
    select mention_id, doc_id, s as start, e as "end" from sp join told using (doc_id) where not list_contains(gone, n)""")
def nested_resolve(spark: SparkSession, d: str) -> DataFrame:
    return intervals.resolve_nested(_mentions(spark, d))


# -- coreference -------------------------------------------------------------------------------------------------


@_query("""f as (select doc_id, low, s, mid, wiki_title, confidence from (
        select *, lower(surface) as low, row_number() over (partition by doc_id, lower(surface) order by s nulls first, mention_id) as n from m where mention_type = 'PER' and surface is not null) where n = 1),
    best as (select doc_id, low, o from (select i.doc_id, i.low, o, row_number() over (partition by i.doc_id, i.low order by length(o.low) desc, o.s nulls first) as n
        from f i join f o on i.doc_id = o.doc_id and length(o.low) > length(i.low) and contains(o.low, i.low)) where n = 1)
    select m.mention_id, m.doc_id, case when not starts_with(o.mid, 'NIL') then o.mid else m.mid end as mid,
        case when not starts_with(o.mid, 'NIL') then o.wiki_title else m.wiki_title end as wiki_title, case when not starts_with(o.mid, 'NIL') then o.confidence else m.confidence end as confidence
    from m left join best b on m.mention_type = 'PER' and b.doc_id = m.doc_id and b.low = lower(m.surface)""")
def per_coref(spark: SparkSession, d: str) -> DataFrame:
    return coref.person_containment(_mentions(spark, d)).select("mention_id", "doc_id", "mid", "wiki_title", "confidence")


@_query("""each_token as (select doc_id, surface, unnest(tokens) as token from form),
    pair as (select a.doc_id, a.surface as surface_a, b.surface as surface_b, count(*) as shared from each_token a join each_token b on a.doc_id = b.doc_id and a.token = b.token and a.surface < b.surface group by all)
    select p.doc_id, surface_a, surface_b, shared / (len(x.tokens) + len(y.tokens) - shared) as score from pair p
    join form x on x.doc_id = p.doc_id and x.surface = surface_a join form y on y.doc_id = p.doc_id and y.surface = surface_b where shared / (len(x.tokens) + len(y.tokens) - shared) > 0.5""")
def surface_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    forms = _mentions(spark, d).select("doc_id", F.lower("surface").alias("key")).distinct().withColumn("tokens", F.array_sort(X.surface_tokens(F.col("key"))))
    return coref.jaccard_pairs(forms, ["doc_id"]).withColumnsRenamed({"key_a": "surface_a", "key_b": "surface_b"})


def _clusters(scope: str, rows: str) -> str:
    """SQL of the ordered greedy pass over the clusters of each scope and type; ``rows`` are the mentions."""
    return f"""recursive w as (select mention_id, {scope} as scope, mention_type, surface, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(surface), '\\s+|·'), lambda t: t != ''))) as tokens,
            case when mid is not null and not starts_with(mid, 'NIL') then mid end as target from ({rows}) where surface is not null and mention_type is not null),
    kind as (select scope, target, arg_min(mention_type, (-length(surface), mention_id)) as type from w where target is not null group by all),
    mem as (select mention_id, scope, type, 'm|' || target as unit, surface, tokens from w join kind using (scope, target)
        union all select mention_id, scope, mention_type, 'u|' || mention_id, surface, tokens from w where target is null),
    clus as (select scope, type, unit, count(*) as n, max(length(surface)) as longest, min(mention_id) as lead from mem group by all),
    ranked as (select *, row_number() over (partition by scope, type order by n desc, longest desc, lead, unit) as node from clus),
    forms as (select distinct scope, type, node, tokens from mem join ranked using (scope, type, unit) where len(tokens) > 0),
    each_token as (select scope, type, node, tokens, unnest(tokens) as token from forms),
    near as (select distinct a.scope, a.type, a.node as i, b.node as j from (
            select a.scope, a.type, a.node, b.node as other, a.tokens as ta, b.tokens as tb, count(*) as shared from each_token a join each_token b on a.scope = b.scope and a.type = b.type and a.token = b.token and a.node < b.node group by all) x,
            lateral (select x.scope, x.type, x.node) a, lateral (select x.other as node) b where x.shared / (len(x.ta) + len(x.tb) - x.shared) > 0.5),
    later as (select scope, type, i, list(j) as js from near group by all),
    walk as (select scope, type, max(node) as top, 0::bigint as i, []::bigint[] as gone, []::struct(node bigint, leader bigint)[] as led from ranked group by scope, type
        union all select w.scope, w.type, w.top, w.i + 1,
            case when l.js is null or list_contains(w.gone, w.i + 1) then w.gone else list_distinct(list_concat(w.gone, l.js)) end,
            case when l.js is null or list_contains(w.gone, w.i + 1) then w.led else list_concat(w.led, list_transform(list_filter(l.js, lambda j: not list_contains(w.gone, j)), lambda j: struct_pack(node := j, leader := w.i + 1))) end
        from walk w left join later l on l.scope = w.scope and l.type = w.type and l.i = w.i + 1 where w.i < w.top),
    led as (select scope, type, unnest(led) as x from walk where i = top),
    named as (select r.scope, r.type, r.unit, coalesce(led.x.leader, r.node) as leader from ranked r left join led on led.scope = r.scope and led.type = r.type and led.x.node = r.node),
    ids as (select n.scope, n.type, n.unit, case when starts_with(l.unit, 'm|') then l.unit[3:] else 'NIL' || printf('%05d', l.lead) end as cluster_id
        from named n join ranked l on l.scope = n.scope and l.type = n.type and l.node = n.leader)"""


@_query(_clusters("doc_id", "select * from m") + " select mention_id, mem.scope as doc_id, cluster_id from mem join ids using (scope, type, unit)")
def surface_clusters(spark: SparkSession, d: str) -> DataFrame:
    return coref.cluster_surfaces(_mentions(spark, d), ["doc_id"])


@_query(_clusters("0", "select * from m where mid is null or starts_with(mid, 'NIL')") + " select mention_id, cluster_id from mem join ids using (scope, type, unit)")
def nil_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the mentions without mid across all documents."""
    nil = _mentions(spark, d).where("mid is null or mid like 'NIL%'")
    return coref.cluster_surfaces(nil, [])


@_query("""select mention_id, doc_id, printf('NIL%05d', row_number() over (order by doc_id nulls first, s nulls first, mention_id)) as nil_id from m where mid = 'NIL'""")
def author_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("mid = 'NIL'").select("mention_id", "doc_id", "start")
    return coref.nil_ids(rows, ["doc_id", "start", "mention_id"]).select("mention_id", "doc_id", "nil_id")


@_query("""select m.doc_id, m.mid as target, m.mention_id, first_value(m.mention_id) over (partition by doc_id, mid order by length(surface) desc, s nulls first, mention_id) as canonical_id
    from m where mid is not null and surface is not null""")
def coref_view(spark: SparkSession, d: str) -> DataFrame:
    return coref.coreference_view(_mentions(spark, d))


@_query("""select mention_id, string_agg(title || '=' || round(p, 6), '|' order by title) as scores from (
    select m.mention_id, c.title, c.p_title_given_surface as p from m join cand c on c.lang = m.lang and c.surface = lower(trim(m.surface, ' '))) group by mention_id""")
def candidate_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("score", F.round("TITLEPROB", 6))
    pairs = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return coref.candidate_maps(rows).select("mention_id", F.array_join(F.array_sort(pairs), "|").alias("scores"))


# -- evaluation and writers --------------------------------------------------------------------------------------


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions are the mentions with a title, with the first mid that their candidates have; golds are those with a gold title."""
    m = _mentions(spark, d).withColumn("doc", F.col("doc_id").cast("string"))
    found = kb.first_mid(kb.mid_chain(_cands(spark, d), table(spark, d, "kb_titles"), _title_map(spark, d)), ["lang", "surface"])
    keyed = m.where("wiki_title is not null").withColumn("surface", X.normal_surface(F.col("surface"))).drop("mid").join(found, ["lang", "surface"], "left")
    cols = [F.col("mention_id").alias("id"), "doc", "start", "end", F.col("mention_type").alias("type")]
    pred = keyed.select(*cols, X.or_nil(F.col("mid")).alias("mid"), F.coalesce("mids", F.array().cast("array<string>")).alias("cand_mids"))
    gold = m.where("gold_wiki_title is not null").select(*cols, "mid")
    return evaluate.match_gold(pred, gold), gold.agg(F.count("*").alias("n_gold"))


_MATCH = """p as (select mention_id as id, doc_id::varchar as doc, s, e, mention_type as type, coalesce(f.mid, 'NIL') as mid, coalesce(f.mids, []) as mids
        from m left join surface_mid f on f.lang = m.lang and f.surface = lower(trim(m.surface, ' ')) where wiki_title is not null),
    g as (select mention_id as id, doc_id::varchar as doc, s, e, mention_type as type, mid from m where gold_wiki_title is not null),
    hit as (select p.id, p.doc, p.type, p.mid, p.mids, g.id as gid, g.type as gtype, g.mid as gmid from p left join g on p.s = g.s and p.e = g.e and starts_with(p.doc, g.doc)
        qualify row_number() over (partition by p.id order by g.id) = 1),
    linked as (select *, gid is not null as span_ok, coalesce(gid is not null and type = gtype, false) as type_ok,
        coalesce(gid is not null and type = gtype and ((starts_with(mid, 'NIL') and starts_with(gmid, 'NIL')) or mid = gmid), false) as link_ok, coalesce(starts_with(gmid, 'NIL'), true) as gold_nil from hit),
    flag as (select id, doc, span_ok, type_ok, link_ok, type_ok and not gold_nil and not link_ok and coalesce(list_contains(mids, gmid), false) as in_candidates, type_ok and gold_nil and span_ok as nil_gold from linked)"""


@_query(_MATCH + " select * from flag")
def match_gold(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)[0]


@_query(_MATCH + """, total as (select count(*) as n, sum(span_ok::int)::bigint as a, sum(type_ok::int)::bigint as b, sum(link_ok::int)::bigint as c, (select count(*) from g) as ng from flag),
    lv as (select 'span' as level, a as correct, n, ng from total union all select 'type', b, n, ng from total union all select 'link', c, n, ng from total)
    select level, correct, correct / n as "precision", correct / ng as recall, 2 * (correct / n) * (correct / ng) / (correct / n + correct / ng) as f1 from lv""")
def evaluate_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(*_matched(spark, d))


@_query("""select lang, count(*) as n, sum((mid = 'NIL')::int)::bigint as n_nil, count(gold_wiki_title) as n_gold from m where lang in ('en', 'es', 'zh') and noun_type = 'NAM' group by lang""")
def gold_slices(spark: SparkSession, d: str) -> DataFrame:
    """The named gold mentions of each language of the evaluation."""
    m, out = _mentions(spark, d), None
    for lang in documents.DOC_LANGUAGE.values():
        part = documents.gold_slice(m, lang)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("mid") == "NIL").cast("int")).alias("n_nil"), F.count("gold_wiki_title").alias("n_gold"))


@_query(r"""select mention_id, concat_ws(chr(9), 'RUN', (row_number() over (order by doc_id nulls first, s nulls first, mention_id) - 1)::varchar, coalesce(surface, ''), coalesce(doc_id || ':' || s || '-' || (e - 1), ''),
    coalesce(mid, 'NIL'), coalesce(mention_type, ''), 'NAM', coalesce(printf('%.4f', confidence), 'null'), coalesce(en_wiki_title, 'NIL')) as line from m""")
def submission_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.submission_lines(_mentions(spark, d).withColumnRenamed("en_wiki_title", "en_title"))


@_query(r"""select concat_ws(chr(9), doc_id::varchar, s::varchar, (e - 1)::varchar, coalesce(mid, 'NIL'), '0', coalesce(mention_type, '')) as line from m""")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.evaluation_lines(_mentions(spark, d))


@_query("""one as (select *, '<entity_mention id="m-' || mention_id || '" noun_type="' || noun_type || '" source="' || doc_id || '" offset="' || s || '" length="' || (e - s + 1) || '"><mention_text>'
            || replace(replace(replace(replace(surface, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</mention_text></entity_mention>' as x
        from m where mid is not null and s is not null and e is not null and surface is not null and noun_type is not null),
    ent as (select doc_id, mid, '<entity id="ent-' || mid || '" type="' || arg_min(coalesce(mention_type, ''), (-length(surface), s, mention_id)) || '" specificity="specific" kb_id="' || mid || '">'
            || string_agg(x, '' order by -length(surface), s, mention_id) || '</entity>' as x from one group by doc_id, mid)
    select doc_id, '<deft_ere kit_id="kit_id" doc_id="' || doc_id || '" source_type="multi_post"><entities>' || string_agg(x, '' order by mid) || '</entities></deft_ere>' as xml from ent group by doc_id""")
def ere_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ere_documents(_mentions(spark, d))


@_query("select 'title_' || en_title || ' ||| ' || 'title_' || title as line from title_map")
def alignment_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.alignment_lines(_title_map(spark, d))


@_query("""recursive men as (select doc_id, s, e, coalesce(wiki_title, 'NIL') as title, row_number() over (partition by doc_id order by s, e, coalesce(wiki_title, 'NIL')) as k from m where s is not null and e > s),
    fold as (select doc_id, 0::bigint as k, '' as html, 0 as p from documents where text is not null
        union all select f.doc_id, n.k, case when n.s >= f.p then f.html || substr(d.text, f.p + 1, n.s - f.p) || '<a href="#' || n.title || '">' || substr(d.text, n.s + 1, n.e - n.s) || '</a>' else f.html end, case when n.s >= f.p then n.e else f.p end
        from fold f join men n on n.doc_id = f.doc_id and n.k = f.k + 1 join documents d on d.doc_id = f.doc_id)
    select l.doc_id, l.html || substr(d.text, l.p + 1, length(d.text)) as html from (select doc_id, arg_max(html, k) as html, arg_max(p, k) as p from fold group by doc_id) l join documents d using (doc_id)""")
def linked_html(spark: SparkSession, d: str) -> DataFrame:
    return sinks.linked_html(table(spark, d, "documents").select("doc_id", "text"), _mentions(spark, d))


@_query("""link as (select t.mention_id, t.doc_id, t.first_tok, t.last_tok, m.wiki_title as title from span_tok t join m using (mention_id) where m.wiki_title is not null),
    cov as (select doc_id, title, first_tok, unnest(range(first_tok, last_tok + 1)) as tok_id from link),
    one as (select doc_id, tok_id, min((first_tok, title)) as c from cov group by doc_id, tok_id)
    select doc_id, sent_id, string_agg(case when c is null then token else 'TITLE_' || c[2] end, ' ' order by tok_id) as text
    from tok left join one using (doc_id, tok_id) where c is null or c[1] = tok_id group by doc_id, sent_id having length(string_agg(case when c is null then token else 'TITLE_' || c[2] end, ' ' order by tok_id)) >= 6""")
def substituted_text(spark: SparkSession, d: str) -> DataFrame:
    spans = _mentions(spark, d).where("wiki_title is not null").select("doc_id", "start", "end", F.col("wiki_title").alias("title"))
    return tokens.substituted_text(table(spark, d, "documents"), spans)


# -- sources -----------------------------------------------------------------------------------------------------


def _sql_string(c: str) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _dump(rows: DataFrame, name: str, row: Column, order: list[str]) -> DataFrame:
    """Rows as lines of an SQL dump, those of a page in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("r")))), lambda e: e["r"])
    return rows.groupBy(F.pmod("page_id", F.lit(64)).alias("seq")).agg(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), F.array_join(ordered, ","), F.lit(";")).alias("value"))


def _page_dump(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "wiki_pages").where("page_id is not null and ns is not null and title is not null")
    row = F.concat(F.lit("("), "page_id", F.lit(","), "ns", F.lit(","), _sql_string("title"), F.lit(",'',0,"), F.coalesce(F.col("is_redirect").cast("string"), F.lit("NULL")), F.lit(",0,0.5,'x')"))
    return _dump(p, "page", row, ["page_id"])


@_query("select page_id, lower(title) as title, is_redirect from wiki_pages where page_id is not null and title is not null and ns = 0 and is_redirect = 0")
def dump_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as SQL dump lines and read again."""
    return dumps.dump_pages(_page_dump(spark, d))


@_query("select page_id, lower(title) as title, is_redirect from wiki_pages where page_id is not null and title is not null and ns = 0 and is_redirect = 1")
def dump_redirect_pages(spark: SparkSession, d: str) -> DataFrame:
    """The redirecting pages of the same dump."""
    return dumps.dump_pages(_page_dump(spark, d), redirects=True)


@_query("select page_id, lower(target_title) as target_title from wiki_redirects where page_id is not null and target_title is not null")
def dump_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Redirects written as SQL dump lines and read again."""
    r = table(spark, d, "wiki_redirects").where("page_id is not null and target_title is not null")
    row = F.concat(F.lit("("), "page_id", F.lit(",0,"), _sql_string("target_title"), F.lit(",'','')"))
    return dumps.dump_redirects(_dump(r, "redirect", row, ["page_id"]))


_LINK_ROWS = """select page_id, lang, arg_max(replace(lower(target_title), ' ', '_'), (coalesce(seen_at, timestamp '0001-01-01'), target_title)) as title
    from wiki_redirects where page_id is not null and lang is not null and target_title is not null group by page_id, lang"""


def _link_dump(spark: SparkSession, d: str) -> DataFrame:
    """Targets of redirects as language links of their pages, in the order in which they were seen."""
    r = table(spark, d, "wiki_redirects").where("page_id is not null and lang is not null and target_title is not null")
    row = F.concat(F.lit("("), "page_id", F.lit(",'"), "lang", F.lit("',"), _sql_string("target_title"), F.lit(")"))
    return _dump(r, "langlinks", row, ["page_id", "seen_at", "target_title"])


@_query(_LINK_ROWS)
def dump_langlinks(spark: SparkSession, d: str) -> DataFrame:
    """Language links written as SQL dump lines and read again; the last of a page and language counts."""
    return dumps.dump_langlinks(_link_dump(spark, d))


@_query("select * from (" + _LINK_ROWS + ") where lang = 'en'")
def dump_langlinks_of(spark: SparkSession, d: str) -> DataFrame:
    """The links to one language."""
    return dumps.dump_langlinks(_link_dump(spark, d), "en")


@_query("select page_id, string_agg(lang || '=' || title, '|' order by lang) as titles from (" + _LINK_ROWS + ") group by page_id")
def langlinks_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page as a map from language."""
    maps = titles.titles_of_pages(dumps.dump_langlinks(_link_dump(spark, d)))
    pairs = F.transform(F.map_entries("titles"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("page_id", F.array_join(F.array_sort(pairs), "|").alias("titles"))


@_query("""select p.lang, p.title, arg_max(lower(replace(r.target_title, ' ', '_')), (coalesce(r.seen_at, timestamp '0001-01-01'), lower(replace(r.target_title, ' ', '_')))) as en_title
    from (select distinct page_id, lang, lower(replace(title, ' ', '_')) as title from wiki_pages where title is not null) p join wiki_redirects r on r.page_id = p.page_id and r.lang = p.lang
    where r.target_title is not null group by p.lang, p.title""")
def title_map_pages(spark: SparkSession, d: str) -> DataFrame:
    """A title map by page id, with the targets of redirects as links."""
    links = table(spark, d, "wiki_redirects").select("page_id", "lang", F.col("target_title").alias("title"), F.col("seen_at").alias("seq"))
    return documents.language_link_dict(table(spark, d, "wiki_pages").select("page_id", "lang", "title"), links)


@_query(r"""select p.title, r.lang, arg_max(array_to_string(regexp_split_to_array(lower(r.target_title), '\s+'), '_'), (coalesce(r.seen_at, timestamp '0001-01-01'), array_to_string(regexp_split_to_array(lower(r.target_title), '\s+'), '_'))) as tgt_title
    from (select distinct page_id, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as title from wiki_pages where title is not null) p join wiki_redirects r using (page_id)
    where r.target_title is not null group by p.title, r.lang""")
def title_map_all_pages(spark: SparkSession, d: str) -> DataFrame:
    """All languages of a page's title by page id, with the targets of redirects as links."""
    links = table(spark, d, "wiki_redirects").select("page_id", "lang", F.col("target_title").alias("title"), F.col("seen_at").alias("seq"))
    return documents.all_languages(table(spark, d, "wiki_pages").select("page_id", "title"), links)


@_query("""select doc_id::varchar as doc_name, 8 + 7 as start, 8 + 7 + length(doc_name) as "end", doc_name as surface from documents where doc_name is not null and text is not null""")
def author_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Document names as authors in markup, found again."""
    docs = table(spark, d, "documents").where("doc_name is not null and text is not null")
    xml = docs.select(F.col("doc_id").cast("string").alias("doc_name"), F.concat(F.lit("<AUTHOR>       "), "doc_name", F.lit("  </AUTHOR>\n"), "text").alias("xml"))
    return documents.authors(xml).select("doc_name", "start", "end", "surface")


@_query(r"""select doc_id, regexp_replace(array_to_string(list_filter(string_split(regexp_replace('<DOC id="' || doc_id || '">' || chr(10) || '<a href="x">' || chr(10) || 'http://x' || chr(10) || '<p>' || text || '</p>', '<.*?>', ' ', 'g'), chr(10)),
        lambda x: not starts_with(x, 'http:') and not starts_with(x, '<a href') and not starts_with(x, '<AUTHOR') and x != ''), ' '), '\s+', ' ', 'g') as plain from documents where text is not null""")
def xml_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts in markup as plain text."""
    xml = F.concat(F.lit('<DOC id="'), "doc_id", F.lit('">\n<a href="x">\nhttp://x\n<p>'), "text", F.lit("</p>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", documents.plain_text(xml).alias("plain"))


@_query(r"""r as (select doc_id, sent_id, tok_id, label, token, s, e from bio where not regexp_matches(token, '^\s*$') and not starts_with(token, 'http:'))
    select doc_id::varchar as doc_name, (dense_rank() over (partition by doc_id order by sent_id) - 1)::bigint as sent_id, tok_id, label, token, s::int as start, e::int as "end" from r""")
def conll_reader(spark: SparkSession, d: str) -> DataFrame:
    """CoNLL lines with blank ones behind sentences, read again."""
    lines = sinks.conll_lines(_bio(spark, d))
    rows = lines.select(F.col("doc_id").cast("string").alias("doc_name"), (F.col("tok_id") * 2).alias("seq"), F.col("line").alias("value"))
    ends = lines.groupBy("doc_id", "sent_id").agg((F.max("tok_id") * 2 + 1).alias("seq")).select(F.col("doc_id").cast("string").alias("doc_name"), "seq", F.lit("").alias("value"))
    read = documents.conll_tokens(rows.unionByName(ends))
    return read.select("doc_name", "sent_id", (F.col("seq") / 2).cast("int").alias("tok_id"), "label", "token", "start", "end")


@_query("""want as (select distinct lang, lower(surface) as query from m where lang is not null and surface is not null),
    c as (select lang, lower(title) as query, string_agg(distinct replace(title, ' ', '_'), '|' order by replace(title, ' ', '_')) as found from kb_titles where lang is not null and title is not null group by all)
    select lang, query, coalesce(found, '') as titles from want left join c using (lang, query)""")
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    """Cached search answers as JSON, asked for surfaces."""
    k = table(spark, d, "kb_titles").where("lang is not null and title is not null").groupBy("lang", F.lower("title").alias("query")).agg(F.array_sort(F.collect_set("title")).alias("t"))
    payload = F.concat(F.lit("["), F.to_json(F.array("query")), F.lit(","), F.to_json("t"), F.lit("]"))
    cache = k.select("lang", F.lit("prefix").alias("mode"), "query", payload.alias("payload"))
    queries = _mentions(spark, d).where("lang is not null and surface is not null").select("lang", F.lower("surface").alias("query")).distinct()
    return documents.search_titles(queries, cache).select("lang", "query", F.array_join(F.array_sort("titles"), "|").alias("titles"))


@_query("""select doc_id, array_to_string(list_filter(string_split(doc_name || '.v1.cmp.txt', '.'), lambda x: x not in ('txt', 'cmp', 'mp', 'xml', 'mpdf')), '.') as stem from documents where doc_name is not null""")
def document_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_name is not null").select("doc_id", X.document_stem(F.concat("doc_name", F.lit(".v1.cmp.txt"))).alias("stem"))


@_query("select mid as title, unnest(types) as category from kb_types")
def search_categories(spark: SparkSession, d: str) -> DataFrame:
    """Types as categories in cached JSON answers, read again."""
    category = F.transform("types", lambda t: F.concat(F.lit('{"title":"'), t, F.lit('"}')))
    payload = F.concat(F.lit('{"query":{"pages":{"1":{"categories":['), F.array_join(category, ","), F.lit("]}}}}"))
    return documents.search_categories(table(spark, d, "kb_types").select(F.col("mid").alias("title"), payload.alias("payload")))


@_query("select doc_id from (select doc_id from documents where doc_id in (select doc_id from mentions) order by doc_id limit 100)")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred documents with mentions; the number is the feature."""
    name = F.col("doc_id").cast("string").alias("doc_name")
    docs = table(spark, d, "documents").select("doc_id", name)
    return documents.usable_documents(docs, table(spark, d, "mentions").select(name), 100, "doc_id").select("doc_id")


@_query("select distinct lower(trim(title, ' ')) as word from kb_titles where trim(title, ' ') != ''")
def gazetteer_words(spark: SparkSession, d: str) -> DataFrame:
    return dumps.word_list(table(spark, d, "kb_titles").select(F.col("title").alias("value")))


@_query("select word, bits, array_to_string([bits[1:4], bits[1:6], bits[1:10], bits[1:20]], '|') as prefixes from (select word, md5(lang || word) as bits from top_word)")
def brown_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster lines of frequent words, read again; hashes stand for the bits."""
    words = tokens.top_words(table(spark, d, "documents"))
    lines = words.select(F.concat_ws("\t", F.md5(F.concat("lang", "word")), "word", F.col("cnt").cast("string")).alias("value"))
    return dumps.brown_clusters(lines).withColumn("prefixes", F.array_join("prefixes", "|"))


@_query(r"""select doc_id, sent_id, tok_id, concat_ws(chr(9), label, s::varchar, e::varchar, 'x', 'x', token, 'x', 'x', 'x', 'x', 'n=' || length(token), 'l=' || lower(token)) as line from bio
    where not regexp_matches(token, '^\s*$') and not starts_with(token, 'http:')""")
def conll_feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """CoNLL rows with features behind the fixed columns."""
    made = F.array(F.concat(F.lit("n="), F.length("token").cast("string")), F.concat(F.lit("l="), F.lower("token")))
    return sinks.conll_lines(_bio(spark, d).withColumn("features", made), "features")


_TOKENS_OF = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t != '')"


@_query(f"""s as (select distinct surface, title, rank, lower(trim(replace(title, '_', ' '), ' ')) as typed from cand)
    select surface, title, rank, (list_transform({_TOKENS_OF.format('surface')}, lambda t: t[1:1]) = list_transform({_TOKENS_OF.format('typed')}, lambda t: t[1:1]))::int::double as "SAME_INITIALS",
        (starts_with(typed, lower(surface)) or starts_with(lower(surface), typed))::int::double as "PREFIX", (len({_TOKENS_OF.format('surface')}) = len({_TOKENS_OF.format('typed')}))::int::double as "SAME_LENGTH",
        (rank = 1)::int::double as "ISTOP" from s""")
def surface_features(spark: SparkSession, d: str) -> DataFrame:
    """The optional features of candidates."""
    return ranking.surface_features(_cands(spark, d).select("surface", "title", "rank").distinct())


@_query()
def simplified_titles(spark: SparkSession, d: str) -> DataFrame:
    """Chinese titles in simplified characters, by the JVM's conversion table."""
    chars = X.script_table(spark)
    return table(spark, d, "kb_titles").where("lang = 'zh' and title is not null").select("title", X.converted(F.col("title"), chars).alias("simplified")).distinct()


@_query("select 'v' || vec_id as key, len(embedding)::int as dim, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings")
def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text lines and read again."""
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    lines = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit(" "), numbers).alias("value"))
    parsed = dumps.embedding_text(lines)
    return parsed.select("key", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@_query("select max(mid) as mid, lang, title from kb_titles where mid is not null and lang is not null and title is not null group by lang, title")
def kb_triples(spark: SparkSession, d: str) -> DataFrame:
    """Titles written as knowledge-base triples in the order of mids, with rows that must be skipped, and read again."""
    k = table(spark, d, "kb_titles").where("mid is not null and lang is not null and title is not null")
    good = k.select(F.col("mid").alias("seq"), F.concat_ws("\t", "mid", "lang", "title").alias("value"))
    skipped = k.select(F.col("mid").alias("seq"), F.concat_ws("\t", "mid", F.lit("en_id"), "title").alias("value"))
    return dumps.kb_triples(good.unionByName(skipped))


@_query(_LINES[: _LINES.index(",\n    v as")] + r""",
    cells as (select p.line_id, case when formed then list_transform(c, lambda q: case when starts_with(q, '"') then replace(q[2:length(q) - 1], '""', '"') else q end) else string_split(l.x, chr(9)) end as f
        from p join raw_lines r on r.line_id = p.line_id join l on l.line_id = p.line_id and l.line is not distinct from r.line),
    b as (select *, split_part(f[4], ':', 1) as doc, string_split(split_part(f[4], ':', -1), '-') as bound from cells where len(f) >= 7),
    n as (select *, case when regexp_full_match(bound[1], '[0-9]+') then try_cast(bound[1] as int) end as lo, case when regexp_full_match(bound[2], '[0-9]+') then try_cast(try_cast(bound[2] as hugeint) + 1 as int) end as hi,
        case when contains(doc, 'CMN') then 'zh' when contains(doc, 'SPA') then 'es' when contains(doc, 'ENG') then 'en' end as lang from b)
    select f[2] as id, f[3] as surface, doc as doc_name, lo as start, hi as "end", f[5] as mid, f[6] as mention_type, f[7] as noun_type, lang from n where lang is not null and lo is not null and hi is not null""")
def gold_reader(spark: SparkSession, d: str) -> DataFrame:
    """Gold table rows of all lines; those that can't be read are the reader's rejects."""
    return documents.gold_lines(table(spark, d, "raw_lines"))[0]


@_query("""first as (select lang, lower(title) as query, min(replace(title, ' ', '_')) as found from kb_titles where lang is not null and title is not null group by lang, lower(title))
    select m.mention_id, case when m.wiki_title is null or starts_with(m.wiki_title, 'NIL') then coalesce(a.found, b.found, 'NIL') else m.wiki_title end as wiki_title,
        case when (m.wiki_title is null or starts_with(m.wiki_title, 'NIL')) and coalesce(a.found, b.found) is not null then 0.8 else m.confidence end as confidence
    from m left join first a on a.lang = m.lang and a.query = lower(m.surface) left join first b on b.lang = 'en' and b.query = lower(m.surface)""")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "kb_titles").where("lang is not null and title is not null").select("lang", F.lower("title").alias("query"), F.array(F.replace("title", F.lit(" "), F.lit("_"))).alias("titles"))
    return documents.search_fallback(_mentions(spark, d), cache).select("mention_id", "wiki_title", "confidence")


# -- scalar functions --------------------------------------------------------------------------------------------


@_query(r"""t as (select distinct title from kb_titles where title is not null)
    select title, lower(replace(title, ' ', '_')) as normal, array_to_string(regexp_split_to_array(lower(title), '\s+'), '_') as joined,
        array_to_string(list_transform(list_filter(string_split(title, '_'), lambda x: x != ''), lambda x: upper(x[1:1]) || x[2:]), '_') as cased,
        case when lower(replace(title, ' ', '_')) = replace(title, ' ', '_') then array_to_string(list_transform(list_filter(string_split(replace(title, ' ', '_'), '_'), lambda x: x != ''), lambda x: upper(x[1:1]) || x[2:]), '_') else replace(title, ' ', '_') end as kb_form,
        array_to_string(list_transform(list_filter(string_split(title, '_'), lambda x: x != ''), lambda x: case when starts_with(x, '(') then '(' || upper(x[2:2]) || x[3:] else upper(x[1:1]) || x[2:] end), '_') as shown,
        case when instr(title, '(') > 1 then trim(split_part(title, '(', 1), ' ') else title end as cut, regexp_replace(split_part(title, '(', 1), '[\s_-]', '', 'g') as tag from t""")
def title_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "kb_titles").where("title is not null").select("title").distinct().select(
        t, X.normal_title(t).alias("normal"), X.joined_title(t).alias("joined"), X.title_case(t).alias("cased"), X.kb_title(t).alias("kb_form"),
        X.display_title(t).alias("shown"), X.cut_parenthesis(t).alias("cut"), X.hashtag(t).alias("tag"),
    )


@_query(r"""s as (select distinct surface, lower(replace(wiki_title, '_', ' ')) as title from m where surface is not null and wiki_title is not null and wiki_title != 'NIL')
    select surface, title, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as char_jaccard, regexp_matches(surface, '^\p{Lu}') as capitalised,
        array_to_string(list_transform(list_filter(regexp_split_to_array(lower(surface), '\s+'), lambda t: t != ''), lambda t: t[1:1]), '') as initials
    from (select *, list_distinct(string_split(lower(surface), '')) as a, list_distinct(string_split(title, '')) as b from s)""")
def string_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _mentions(spark, d).where("surface is not null and wiki_title is not null and wiki_title != 'NIL'").select("surface", F.lower(F.replace("wiki_title", F.lit("_"), F.lit(" "))).alias("title")).distinct()
    return rows.select(
        "surface", "title", X.jaccard(X.characters(F.lower("surface")), X.characters(F.col("title"))).alias("char_jaccard"), X.is_capitalised(F.col("surface")).alias("capitalised"),
        X.initials(F.col("surface")).alias("initials"),
    )


@_query(r"""t as (select distinct title from kb_titles where title is not null)
    select title, row_number() over (order by md5('0|' || title), title) as place from t""")
def shuffled_titles(spark: SparkSession, d: str) -> DataFrame:
    return titles.shuffled(table(spark, d, "kb_titles")).withColumn("place", F.col("place").cast("long"))


@_query()
def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("surface", "title").distinct()
    distance = X.edit_distance(F.col("surface"), F.col("title"))
    return rows.select("surface", "title", distance.alias("distance"), X.string_score(distance).alias("score"), X.jaccard(X.bigrams(F.col("surface")), X.bigrams(F.col("title"))).alias("bigram_jaccard"))


# -- whole pipelines ---------------------------------------------------------------------------------------------


@_query()
def annotate(spark: SparkSession, d: str) -> DataFrame:
    """Mentions through the whole linker: candidates, ranking, English title, mid, coreference, clusters."""
    tables = {t: table(spark, d, t) for t in ("kb_titles", "kb_types", "wiki_pages", "wiki_redirects")}
    return pipeline.annotate(_mentions(spark, d), pipeline.build_index(_mentions(spark, d), **tables))


@_query()
def annotate_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Mentions through the linker with all base features, ranked document by document; words and titles stand for vectors of the table by their letters."""
    tables = {t: table(spark, d, t) for t in ("kb_titles", "kb_types", "wiki_pages", "wiki_redirects")}
    m, docs = _mentions(spark, d), _docs(spark, d)
    index = pipeline.build_index(m, **tables)
    names = ranking.features_of(False)
    weights = [0.9, 0.4] + [0.1] * (len(names) - 2)
    return pipeline.annotate_ranked(m, docs, index, _stand_in_vectors(spark, d, docs, m), names, tuple(weights))


@_query()
def annotate_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts to linked mentions: tokens, n-gram cascade, spans, candidates, titles, mids, clusters."""
    tables = {t: table(spark, d, t) for t in ("kb_titles", "kb_types", "wiki_pages", "wiki_redirects")}
    docs = _docs(spark, d)
    return pipeline.annotate_text(docs, pipeline.build_index(_mentions(spark, d), **tables), Config(), cut_lineage(tokens.top_words(docs).select("lang", "word")))


@_query()
def tagged_spans(spark: SparkSession, d: str) -> DataFrame:
    """N-grams linked, labelled by their types and decoded to mention spans."""
    lists, types, stops = _typed_lists(spark, d, _docs(spark, d))
    return pipeline.tag_mentions(lists, cut_lineage(types), stops)


@_query("select mention_id, row_number() over (order by doc_id nulls first, s nulls first, mention_id) as number from m")
def numbered_mentions(spark: SparkSession, d: str) -> DataFrame:
    return numbered(_mentions(spark, d).select("mention_id", "doc_id", "start"), ["doc_id", "start", "mention_id"]).select("mention_id", F.col("number").cast("long").alias("number"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
