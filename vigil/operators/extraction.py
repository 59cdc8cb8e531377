"""Article ingest: window, category fan-out, top-k, location extraction,
geocoding and the end-to-end incident build.

Location extraction is one pass over the text and one equi-join:

1. sentences of ``title description`` (split after . ! ?), keeping those that
   contain a crime keyword, with their index;
2. of each, the pieces a place can stand in: (a) the first capture of each
   ordered location pattern, (b) the sentence itself, but only the token
   positions strictly closer than ``max_gap`` to a keyword token;
3. the pieces' n-grams at those positions, for the lengths that names in the
   gazetteer have, join the gazetteer's normalised names: a row that comes out
   is a hit, whatever words names share;
4. per article the hit with the smallest
   ``(sentence, rule, pattern, token position)`` wins (``min_by``).

Place names match as whole consecutive word tokens (any length, any script),
case-insensitively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions import text as X
from vigil.session import materialize


def article_window(articles: DataFrame, *, start: str, end: str,
                   lang: str | None = FV.DEFAULT_LANG, ts: str = "published_at") -> DataFrame:
    """``start ≤ day(published) ≤ end`` and language filter (both pushed to
    the scan when the landed articles are partitioned/sorted by them)."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    out = articles.filter(F.to_date(ts).between(lo, hi))
    if "published_day" in articles.columns:
        # landed layout: the same range on the partition column prunes directories
        out = out.filter(F.col("published_day").between(lo, hi))
    return out.filter(F.col("lang") == lang) if lang else out


def with_text(articles: DataFrame) -> DataFrame:
    return articles.withColumn("text", X.article_text("title", "description"))


def category_fanout(articles: DataFrame, category_terms: list[tuple[str, str]]) -> DataFrame:
    """One row per (article, category) whose term occurs in the article
    text (bag semantics: an article can yield several categories), plus
    ``relevance`` = occurrences of the term. The category list is a literal
    array of CASE structs, so the fan-out is a narrow explode — no join, no
    lambda; the text is lower-cased once per article."""
    txt = with_text(articles).withColumn("_low", F.lower(F.col("text")))
    low = F.col("_low")
    hits = F.array(*[F.when(F.contains(low, F.lit(t.lower())),
                            F.struct(F.lit(c).alias("category"), F.lit(t.lower()).alias("term")))
                     for c, t in category_terms])
    term = F.col("_hit.term")
    occ = ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("bigint")
    return (txt.withColumn("_hit", F.explode(hits)).filter(F.col("_hit").isNotNull())
            .withColumn("category", F.col("_hit.category"))
            .withColumn("relevance", occ)
            .drop("_hit", "_low"))


def category_topk(fanout: DataFrame, k: int = FV.PAGE_SIZE, id_col: str = "article_id") -> DataFrame:
    """At most ``k`` articles per category: relevance desc, id asc.

    ``row_number() <= k`` is planned with a per-task group limit before the
    exchange, so each task ships ≤ k rows per category.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("category").orderBy(F.desc("relevance"), F.asc(id_col))
    return fanout.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _sentences(articles: DataFrame, id_col: str) -> DataFrame:
    txt = with_text(articles).select(id_col, "text")
    return txt.select(id_col, F.posexplode(X.sentences("text")).alias("s_idx", "sentence"))


def _any_keyword(low, keywords: list[str]):
    """Plain OR of contains over lower-cased text."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k.lower()))
    return hit


def crime_sentences(articles: DataFrame, keywords: list[str], id_col: str = "article_id") -> DataFrame:
    """``article_id, s_idx, sentence`` for sentences holding a keyword."""
    sents = _sentences(articles, id_col).withColumn("_low", F.lower(F.col("sentence")))
    return sents.filter(_any_keyword(F.col("_low"), keywords)).drop("_low")


def location_phrases(sents: DataFrame, patterns: list[str] = FV.LOCATION_PATTERNS,
                     id_col: str = "article_id") -> DataFrame:
    """``article_id, s_idx, p_idx, phrase`` for every pattern that matches."""
    return (sents.select(id_col, "s_idx", F.posexplode(X.first_capture("sentence", patterns))
                         .alias("p_idx", "phrase"))
            .filter(F.col("phrase") != ""))


def gazetteer_grams(gazetteer: DataFrame, place: str = "place") -> DataFrame:
    """``place, gram, n_words``: the normalised name of every place that has
    words; a place listed twice is one place."""
    return (gazetteer.select(F.col(place).alias("place")).distinct()
            .withColumn("gram", X.normalise_name(F.col("place"))).filter(F.col("gram").isNotNull())
            .withColumn("n_words", F.size(F.split("gram", " "))))


def place_grams(sents: DataFrame, lengths: list[int], keywords: list[str], *, patterns=FV.LOCATION_PATTERNS,
                max_gap: int = FV.KEYWORD_MAX_GAP, id_col: str = "article_id", rules=(0, 1)) -> DataFrame:
    """``article_id, s_idx, rule, p_idx, pos, gram``: the n-grams of ``lengths``
    words where a place can stand: anywhere in a pattern capture (rule 0), or
    strictly closer than ``max_gap`` tokens to a keyword token (rule 1). Rows
    whose ``sentence`` is null stay, without a gram."""
    pieces = []
    if 0 in rules:
        captured = X.first_capture("sentence", patterns)
        pieces.append(F.transform(captured, lambda t, p: F.struct(F.lit(0).alias("rule"), p.alias("p_idx"), t.alias("piece"))))
    if 1 in rules:
        pieces.append(F.array(F.struct(F.lit(1).alias("rule"), F.lit(0).alias("p_idx"), F.col("sentence").alias("piece"))))
    kw, reach = F.array(*[F.lit(k.lower()) for k in keywords]), max_gap - 1
    rows = (sents.select(id_col, "s_idx", F.explode(F.filter(F.concat(*pieces), lambda x: x["piece"].isNull() | (x["piece"] != "")))
                         .alias("p")).select(id_col, "s_idx", "p.rule", "p.p_idx", X.tokens(F.col("p.piece")).alias("toks")))
    last = F.size("toks") - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.array_contains(kw, F.element_at("toks", i + 1)))
    band = F.array_distinct(F.flatten(F.transform(found, lambda k: F.sequence(
        F.greatest(k - reach, F.lit(0)), F.least(k + reach, last)))))
    rows = rows.withColumn("spots", F.when(F.col("rule") == 0, F.sequence(F.lit(0), last)).otherwise(band))

    def of_length(n: int):
        return F.transform(F.filter("spots", lambda i: i + n <= F.size("toks")), lambda i: F.struct(
            i.alias("pos"), F.array_join(F.slice("toks", i + 1, n), " ").alias("gram")))

    grams = F.concat(*[of_length(n) for n in lengths]) if lengths else F.expr("cast(null as array<struct<pos:int,gram:string>>)")
    return rows.select(id_col, "s_idx", "rule", "p_idx", F.explode_outer(grams).alias("g")) \
        .select(id_col, "s_idx", "rule", "p_idx", "g.pos", "g.gram")


def _lengths(grams: DataFrame) -> list[int]:
    """The word counts that names have (a handful of numbers)."""
    return sorted(r.n_words for r in grams.select("n_words").distinct().collect())


def proximity_candidates(sents: DataFrame, gazetteer: DataFrame, keywords: list[str], *,
                         max_gap: int = FV.KEYWORD_MAX_GAP, id_col: str = "article_id") -> DataFrame:
    """Rule (b) alone: places that start strictly closer than ``max_gap``
    tokens to a keyword token of the same sentence."""
    names = gazetteer_grams(gazetteer)
    keys = place_grams(sents, _lengths(names), keywords, max_gap=max_gap, id_col=id_col, rules=(1,))
    return keys.join(names.select("gram", "place"), "gram").select(id_col, "s_idx", "rule", "p_idx", "pos", "place")


def location_extract(articles: DataFrame, gazetteer: DataFrame, keywords: list[str], *,
                     patterns=FV.LOCATION_PATTERNS, max_gap: int = FV.KEYWORD_MAX_GAP,
                     id_col: str = "article_id", keep_all: bool = False) -> DataFrame:
    """``article_id, location_name`` for articles whose crime sentences yield
    a place (pattern hits first, then keyword proximity, sentence by
    sentence). ``keep_all`` keeps the other articles, with a null name; one row
    per id either way."""
    names = gazetteer_grams(gazetteer)
    if keep_all:
        # an article without a crime sentence goes on as its first sentence's row, without grams
        sents = _sentences(articles, id_col).withColumn("_hit", _any_keyword(F.lower("sentence"), keywords)) \
            .filter(F.col("_hit") | (F.col("s_idx") == 0)).withColumn("sentence", F.when(F.col("_hit"), F.col("sentence")))
    else:
        sents = crime_sentences(articles, keywords, id_col)
    keys = place_grams(sents, _lengths(names), keywords, patterns=patterns, max_gap=max_gap, id_col=id_col)
    order = F.when(F.col("place").isNotNull(), F.struct("s_idx", "rule", "p_idx", "pos", "place"))
    return (keys.join(names.select("gram", "place"), "gram", "left" if keep_all else "inner").groupBy(id_col)
            .agg(F.min_by("place", order).alias("location_name")))


def geocode(df: DataFrame, gazetteer: DataFrame, *, how: str = "left",
            name: str = "location_name") -> DataFrame:
    """Attach ``latitude``/``longitude`` by normalised place name. The
    gazetteer side is left to AQE: broadcast when it measures small,
    shuffled hash/sort-merge join otherwise."""
    g = (gazetteer.groupBy(X.normalise_name(F.col("place")).alias("_key"))
         .agg(F.min(F.struct("place", "latitude", "longitude")).alias("_g"))   # names that differ in case only: the first
         .filter(F.col("_key").isNotNull()).select("_key", "_g.latitude", "_g.longitude"))
    return (df.withColumn("_key", X.normalise_name(F.col(name)))
            .join(g, "_key", how).drop("_key"))


def incident_projection(df: DataFrame) -> DataFrame:
    """Article → incident record (``source.name`` defaults to Unknown)."""
    return df.select("article_id", F.col("published_at").alias("date"), "title", "description",
                     "category", "location_name", "latitude", "longitude",
                     F.coalesce(F.col("source.name"), F.lit(FV.UNKNOWN_SOURCE)).alias("source"))


def _fetched(articles: DataFrame, category_terms: list[tuple[str, str]], k: int | None) -> DataFrame:
    """The category rows (all of them, or the top ``k`` of each category),
    written once: they are read again for their texts and for their locations."""
    rows = category_fanout(articles, category_terms)
    return materialize(rows if k is None else category_topk(rows, k))


def _located(fetched: DataFrame, gazetteer: DataFrame, keywords: list[str], patterns, max_gap: int) -> DataFrame:
    """Incidents of the category rows; each article is searched once."""
    once = fetched.groupBy("article_id", "category").count().groupBy("article_id").agg(F.min("category").alias("category"))
    loc = location_extract(fetched.join(once, ["article_id", "category"], "left_semi"), gazetteer, keywords,
                           patterns=patterns, max_gap=max_gap)
    return incident_projection(geocode(fetched.join(loc, "article_id"), gazetteer, how="inner"))


def build_incidents(articles: DataFrame, gazetteer: DataFrame, *,
                    category_terms: list[tuple[str, str]], keywords: list[str],
                    start: str | None = None, end: str | None = None, lang: str | None = FV.DEFAULT_LANG, k: int | None = None,
                    patterns=FV.LOCATION_PATTERNS, max_gap: int = FV.KEYWORD_MAX_GAP) -> DataFrame:
    """Window (all days without ``start``) → category rows (all of them, or the
    top ``k`` of each category) → location → inner geocode → incidents.

    ``articles`` is scanned once: what passes the window and has a category is
    written to the shared folder and read from there.
    """
    win = articles if start is None else article_window(articles, start=start, end=end, lang=lang)
    return _located(_fetched(win, category_terms, k), gazetteer, keywords, patterns, max_gap)


def ingest_counters(articles: DataFrame, gazetteer: DataFrame, *, category_terms, keywords, start: str, end: str,
                    lang: str = FV.DEFAULT_LANG, k: int | None = None, patterns=FV.LOCATION_PATTERNS,
                    max_gap: int = FV.KEYWORD_MAX_GAP) -> DataFrame:
    """``articles_fetched`` (category rows, after top-k if ``k`` is given) and
    ``articles_with_location`` (incident rows), from one scan."""
    fetched = _fetched(article_window(articles, start=start, end=end, lang=lang), category_terms, k)
    inc = _located(fetched, gazetteer, keywords, patterns, max_gap)
    return fetched.agg(F.count("*").alias("articles_fetched")).select(
        "articles_fetched", inc.agg(F.count("*")).scalar().alias("articles_with_location"))


def relevance_tag(articles: DataFrame, gazetteer: DataFrame, keywords: list[str]) -> DataFrame:
    """Every article with ``relevant`` = it has a crime sentence with a place."""
    return (location_extract(articles, gazetteer, keywords, keep_all=True)
            .select("article_id", F.col("location_name").isNotNull().alias("relevant")))
