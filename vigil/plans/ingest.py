"""Registered ingest queries: article window, fan-out, top-k, sentences,
location extraction, geocoding and the incident build (FIXTURES.md
bindings: test category terms, sentence keywords and gazetteer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.operators import extraction as X
from vigil.plans.registry import query
from vigil.plans.sql_bindings import ARTICLES, GAZETTEER
from vigil.sources import bindings as B

TERMS = B.TEST_CATEGORY_TERMS
KEYWORDS = B.TEST_SENTENCE_KEYWORDS
WIN = ("2024-01-08", "2024-01-14")
FULL = ("2024-01-01", "2024-01-30")

_WS = r"[ \t\n\x0B\f\r]"
_GAP = r"[^\p{L}\p{M}\p{N}_]+"


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _terms_values() -> str:
    return "select * from (values " + ", ".join(f"({_sq(c)}, {_sq(t)})" for c, t in TERMS) + \
        ") t(category, term)"


def _kw_any(col: str) -> str:
    return "(" + " or ".join(f"contains(lower({col}), {_sq(k)})" for k in KEYWORDS) + ")"


def _kw_in(col: str) -> str:
    return f"{col} in (" + ", ".join(_sq(k) for k in KEYWORDS) + ")"


def _patterns_sql() -> str:
    parts = []
    for i, p in enumerate(FV.LOCATION_PATTERNS):
        rx = "(?i)" + p.replace(r"\s", _WS)
        parts.append(f"select article_id, s_idx, {i} as p_idx, regexp_replace(regexp_extract(sentence, {_sq(rx)}, 1), "
                     f"'^{_WS}+|{_WS}+$', '', 'g') as phrase from sents")
    return " union all ".join(parts)


def _grams(src: str, keys: str) -> str:
    """1..3-grams over ``tok`` ordered by ``pos`` within ``keys``."""
    w = f"over (partition by {keys} order by pos)"
    return f"""select {keys}, pos, tok as gram from {src}
 union all select {keys}, pos, tok || ' ' || lead(tok, 1) {w} from {src}
 union all select {keys}, pos, tok || ' ' || lead(tok, 1) {w} || ' ' || lead(tok, 2) {w} from {src}"""


def ctes(lang_filter: str = "lang = 'en'", window: tuple[str, str] | None = None) -> str:
    wsql = (f" and published_at between date '{window[0]}' and date '{window[1]}'" if window else "")
    return f"""a as ({ARTICLES}),
win as (select * from a where {lang_filter}{wsql}),
terms as ({_terms_values()}),
fan as (select w.article_id, t.category,
        cast((length(lower(concat_ws(' ', w.title, w.description)))
         - length(replace(lower(concat_ws(' ', w.title, w.description)), t.term, ''))) / length(t.term) as bigint) as relevance
        from win w join terms t on contains(lower(concat_ws(' ', w.title, w.description)), t.term)),
top as (select * from (select *, row_number() over (partition by category order by relevance desc, article_id) as rn
        from fan) z where rn <= 100),
s0 as (select article_id, string_split(regexp_replace(concat_ws(' ', title, description),
        '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)) as arr from win),
s1 as (select article_id, unnest(arr) as sentence, unnest(generate_series(0, len(arr) - 1)) as s_idx from s0),
sents as (select * from s1 where {_kw_any('sentence')}),
phr as (select * from ({_patterns_sql()}) z where phrase <> ''),
ptok0 as (select article_id, s_idx, p_idx, string_split_regex(lower(phrase), '{_GAP}') as arr from phr),
ptok as (select article_id, s_idx, p_idx, unnest(arr) as tok, unnest(generate_series(0, len(arr) - 1)) as pos from ptok0),
gaz as (select place, array_to_string(list_filter(string_split_regex(lower(place), '{_GAP}'), lambda x: x <> ''), ' ') as gram,
        latitude, longitude from ({GAZETTEER}) g0),
cand_a as (select g.article_id, g.s_idx, 0 as rule, g.p_idx, g.pos, z.place from ({_grams('ptok', 'article_id, s_idx, p_idx')}) g
           join gaz z on z.gram = g.gram),
stok0 as (select article_id, s_idx, string_split_regex(lower(sentence), '{_GAP}') as arr from sents),
stok as (select article_id, s_idx, unnest(arr) as tok, unnest(generate_series(0, len(arr) - 1)) as pos from stok0),
splace as (select g.article_id, g.s_idx, g.pos, z.place from ({_grams('stok', 'article_id, s_idx')}) g join gaz z on z.gram = g.gram),
near as (select distinct p.article_id, p.s_idx, p.pos, p.place from splace p join stok k
         on k.article_id = p.article_id and k.s_idx = p.s_idx and {_kw_in('k.tok')} and abs(p.pos - k.pos) < 5),
cand as (select * from cand_a union all select article_id, s_idx, 1, 0, pos, place from near),
loc as (select article_id, place as location_name from (select *, row_number() over (partition by article_id
        order by s_idx, rule, p_idx, pos, place) as rn from cand) z where rn = 1)"""


_EN = ctes()
_ALL = ctes(lang_filter="true")          # language plays a part in the fetch only


def _articles(spark, sf):
    return B.articles(spark, sf)


def _en(spark, sf):
    return _articles(spark, sf).filter(F.col("lang") == "en")


@query("article_scan", f"""with a as ({ARTICLES}) select article_id, title, lang,
coalesce(source_name, 'Unknown') as source, strftime(published_at, '%Y-%m-%d') as published_at from a""")
def q_article_scan(spark, sf):
    a = _articles(spark, sf)
    return a.select("article_id", "title", "lang",
                    F.coalesce(F.col("source.name"), F.lit(FV.UNKNOWN_SOURCE)).alias("source"),
                    F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))


@query("article_window", f"""with {ctes(window=WIN)} select article_id, strftime(published_at, '%Y-%m-%d') as published_at from win""")
def q_article_window(spark, sf):
    w = X.article_window(_articles(spark, sf), start=WIN[0], end=WIN[1])
    return w.select("article_id", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"))


@query("article_text", f"with a as ({ARTICLES}) select article_id, concat_ws(' ', title, description) as text from a")
def q_article_text(spark, sf):
    return X.with_text(_articles(spark, sf)).select("article_id", "text")


@query("category_fanout", f"with {_EN} select article_id, category, relevance from fan")
def q_fanout(spark, sf):
    return X.category_fanout(_en(spark, sf), TERMS).select("article_id", "category", "relevance")


@query("category_topk", f"with {_EN} select article_id, category, relevance from top")
def q_topk(spark, sf):
    return X.category_topk(X.category_fanout(_en(spark, sf), TERMS)).select(
        "article_id", "category", "relevance")


@query("crime_sentences", f"with {_ALL} select article_id, cast(s_idx as integer) as s_idx, sentence from sents")
def q_crime_sentences(spark, sf):
    return X.crime_sentences(_articles(spark, sf), KEYWORDS)


@query("location_phrases", f"with {_ALL} select article_id, cast(s_idx as integer) as s_idx, p_idx, phrase from phr")
def q_location_phrases(spark, sf):
    return X.location_phrases(X.crime_sentences(_articles(spark, sf), KEYWORDS))


@query("location_near_keyword", f"with {_ALL} select article_id, cast(s_idx as integer) as s_idx, cast(pos as integer) as pos, place from near")
def q_near(spark, sf):
    sents = X.crime_sentences(_articles(spark, sf), KEYWORDS)
    c = X.proximity_candidates(sents, B.gazetteer(spark), KEYWORDS)
    return c.select("article_id", "s_idx", "pos", "place")


@query("location_extract", f"with {_ALL} select article_id, location_name from loc")
def q_location_extract(spark, sf):
    return X.location_extract(_articles(spark, sf), B.gazetteer(spark), KEYWORDS)


@query("geocode_left", f"""with {_ALL} select w.article_id, l.location_name, g.latitude, g.longitude
from win w left join loc l on l.article_id = w.article_id left join gaz g on g.gram = lower(l.location_name)""")
def q_geocode_left(spark, sf):
    loc = X.location_extract(_articles(spark, sf), B.gazetteer(spark), KEYWORDS, keep_all=True)
    return X.geocode(loc, B.gazetteer(spark)).select(
        "article_id", "location_name", "latitude", "longitude")


@query("geocode_inner", f"""with {_ALL} select l.article_id, l.location_name, g.latitude, g.longitude
from loc l join gaz g on g.gram = lower(l.location_name)""")
def q_geocode_inner(spark, sf):
    loc = X.location_extract(_articles(spark, sf), B.gazetteer(spark), KEYWORDS)
    return X.geocode(loc, B.gazetteer(spark), how="inner").select(
        "article_id", "location_name", "latitude", "longitude")


_BUILD = ctes(window=FULL)


@query("incident_build", f"""with {_BUILD} select t.article_id, strftime(w.published_at, '%Y-%m-%d') as date, w.title,
w.description, t.category, l.location_name, g.latitude, g.longitude, coalesce(w.source_name, 'Unknown') as source
from fan t join loc l on l.article_id = t.article_id join gaz g on g.gram = lower(l.location_name)
join win w on w.article_id = t.article_id""")
def q_incident_build(spark, sf):
    inc = X.build_incidents(_articles(spark, sf), B.gazetteer(spark), category_terms=TERMS,
                            keywords=KEYWORDS, start=FULL[0], end=FULL[1])
    return inc.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("ingest_counters", f"""with {_BUILD} select (select count(*) from fan) as articles_fetched,
(select count(*) from fan t join loc l on l.article_id = t.article_id join gaz g on g.gram = lower(l.location_name))
 as articles_with_location""")
def q_ingest_counters(spark, sf):
    return X.ingest_counters(_articles(spark, sf), B.gazetteer(spark), category_terms=TERMS,
                             keywords=KEYWORDS, start=FULL[0], end=FULL[1])


@query("relevance_tag", f"""with {_ALL} select w.article_id, l.location_name is not null as relevant
from win w left join loc l on l.article_id = w.article_id""")
def q_relevance(spark, sf):
    return X.relevance_tag(_articles(spark, sf), B.gazetteer(spark), KEYWORDS)


@query("incident_projection", f"""with {_ALL} select f.article_id, strftime(w.published_at, '%Y-%m-%d') as date,
w.title, w.description, f.category, l.location_name, g.latitude, g.longitude, coalesce(w.source_name, 'Unknown') as source
from fan f join loc l on l.article_id = f.article_id join gaz g on g.gram = lower(l.location_name)
join win w on w.article_id = f.article_id""")
def q_incident_projection(spark, sf):
    inc = X.build_incidents(_articles(spark, sf), B.gazetteer(spark), category_terms=TERMS, keywords=KEYWORDS)
    return inc.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
