"""Text ingest on a hand-made fixture: sentence order, pattern priority,
keyword proximity, fan-out bag semantics, top-k and geocoding."""

from vigil.operators import extraction as X

ART = "article_id long, title string, description string, lang string, source struct<name:string>, published_at date"
GAZ = "place string, latitude double, longitude double"
KW = ["robbery", "murder"]
TERMS = [("robbery", "robbery"), ("murder", "murder")]


def _articles(spark, rows):
    return spark.createDataFrame(rows, ART)


def _gaz(spark):
    return spark.createDataFrame([("Springfield", 1.0, 2.0), ("Shelbyville", 3.0, 4.0),
                                  ("New York", 5.0, 6.0)], GAZ)


def test_pattern_beats_proximity_and_first_sentence_wins(spark):
    rows = [
        (1, "Robbery", "A robbery occurred in Shelbyville today. Murder in Springfield.", "en", None, None),
        (2, "News", "Springfield man saw a robbery. Nothing else.", "en", None, None),
        (3, "News", "Quiet day. A murder took place near New York yesterday.", "en", None, None),
        (4, "News", "Nothing here about Springfield.", "en", None, None),
    ]
    loc = {r.article_id: r.location_name for r in
           X.location_extract(_articles(spark, rows), _gaz(spark), KW).collect()}
    # 1: first crime sentence, pattern hit; 2: proximity (4 tokens apart);
    # 3: multi-word place through a pattern; 4: no crime sentence
    assert loc == {1: "Shelbyville", 2: "Springfield", 3: "New York"}


def test_proximity_is_strictly_below_five_tokens(spark):
    rows = [(1, None, "Springfield a b c d robbery", "en", None, None),
            (2, None, "Springfield a b c robbery", "en", None, None)]
    loc = {r.article_id for r in X.location_extract(_articles(spark, rows), _gaz(spark), KW).collect()}
    assert loc == {2}


def test_fanout_is_a_bag_and_topk_caps(spark):
    rows = [(k, "robbery murder", "robbery " * (k % 3), "en", None, None) for k in range(10)]
    fan = X.category_fanout(_articles(spark, rows), TERMS)
    assert fan.count() == 20
    top = X.category_topk(fan, 3).collect()
    rob = sorted((r.relevance, r.article_id) for r in top if r.category == "robbery")
    assert len(rob) == 3 and all(r[0] == 3 for r in rob)


def test_missing_source_is_unknown_and_inner_geocode(spark):
    rows = [(1, "robbery", "A robbery happened in Springfield.", "en", None, None),
            (2, "robbery", "A robbery happened in Atlantis.", "en", ("Wire",), None)]
    inc = X.build_incidents(_articles(spark, rows).withColumn("published_at", X.F.lit("2024-01-02").cast("date")),
                            _gaz(spark), category_terms=TERMS, keywords=KW,
                            start="2024-01-01", end="2024-01-31").collect()
    assert [(r.article_id, r.location_name, r.latitude, r.source) for r in inc] == [(1, "Springfield", 1.0, "Unknown")]


def test_repeated_places_count_once(spark):
    from vigil.operators import extraction as X
    gaz = spark.createDataFrame([("New Paris", 2.0, 3.0), ("New Paris", 2.0, 3.0), ("new paris", 9.0, 9.0)],
                                "place string, latitude double, longitude double")
    grams = X.gazetteer_grams(gaz).collect()
    assert sorted((r.place, r.gram, r.n_words) for r in grams) == [("New Paris", "new paris", 2), ("new paris", "new paris", 2)]
    named = spark.createDataFrame([(1, "NEW PARIS"), (2, "nowhere")], "article_id int, location_name string")
    got = sorted(map(tuple, X.geocode(named, gaz).select("article_id", "latitude", "longitude").collect()))
    assert got == [(1, 2.0, 3.0), (2, None, None)]


def test_scratch_folder_needs_a_local_master():
    import pytest
    from vigil import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host", "getCheckpointDir": staticmethod(lambda: None)})
    with pytest.raises(ValueError):
        session.checkpoint_dir(Cluster)


def test_names_of_any_script(spark):
    gaz = spark.createDataFrame([("北京", 1.0, 1.0), ("東京", 2.0, 2.0), ("???", 3.0, 3.0), ("Köln", 4.0, 4.0), ("Kéln", 5.0, 5.0),
                                 ("Нижний Новгород", 6.0, 6.0), ("दिल्ली", 7.0, 7.0)], GAZ)
    rows = [(1, None, "Murder near 東京", "en", None, None), (2, None, "A murder in KÖLN.", "en", None, None),
            (3, None, "robbery happened in нижний новгород!", "en", None, None), (4, None, "murder in Kéln", "en", None, None),
            (5, None, "murder: दिल्ली", "en", None, None), (6, None, "murder in ???", "en", None, None)]
    loc = X.location_extract(_articles(spark, rows), gaz, KW, keep_all=True)
    got = {r.article_id: (r.location_name, r.latitude) for r in X.geocode(loc, gaz).collect()}
    assert got == {1: ("東京", 2.0), 2: ("Köln", 4.0), 3: ("Нижний Новгород", 6.0), 4: ("Kéln", 5.0), 5: ("दिल्ली", 7.0), 6: (None, None)}


def test_articles_without_a_place_are_kept_on_demand(spark):
    rows = [(1, None, None, "en", None, None), (2, "quiet", "Nothing. At all.", "en", None, None),
            (3, "murder", "Murder in Springfield. A robbery in Shelbyville.", "en", None, None), (4, None, "robbery robbery", "en", None, None)]
    got = X.location_extract(_articles(spark, rows), _gaz(spark), KW, keep_all=True).collect()
    assert sorted((r.article_id, r.location_name) for r in got) == [(1, None), (2, None), (3, "Springfield"), (4, None)]
    assert X.location_extract(_articles(spark, rows), _gaz(spark).limit(0), KW).count() == 0
    tags = X.relevance_tag(_articles(spark, rows), _gaz(spark).limit(0), KW).collect()
    assert sorted((r.article_id, r.relevant) for r in tags) == [(k, False) for k in (1, 2, 3, 4)]


def test_names_that_share_words_give_hits_only(spark):
    n = 5000
    gaz = spark.createDataFrame([(f"Saint X{k}", 1.0, float(k)) for k in range(n)] + [("Saint", 0.0, 0.0)], GAZ)
    rows = [(k, None, f"robbery near Saint X{k} Saint X{k + 1}", "en", None, None) for k in range(20)]
    sents = X.crime_sentences(_articles(spark, rows), KW)
    hits = X.proximity_candidates(sents, gaz, KW).collect()
    assert len(hits) == 20 * 4               # Saint and Saint X, at two places
