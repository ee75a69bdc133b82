"""Golden rows: topics, dates, filters, matching, display values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom import fixed, schemas
from newsloom.functions import dates, scoring, terms, text as tx, urls
from newsloom.operators import articles as ar
from newsloom.operators import metrics

STAMP = dt.datetime(2026, 5, 20, 10, 30, 5)


def article(i, titulo="t", texto="b", fuente="f", pub="2026-05-15", scrape=STAMP):
    return (i, f"https://h/{i}", titulo, texto, fuente, "h", pub, scrape)


@pytest.fixture()
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.ARTICLES)


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    return row.select(column).first()[0]


def test_topic_order_substring_and_default(make):
    df = ar.enrich(make(
        article(1, "El hospital y el bloqueo"), article(2, "Una leyenda"),
        article(3, "Nada aquí"), article(4, "FÚTBOL hoy"),
    ))
    topics = {r.id: r.topico for r in df.collect()}
    assert topics == {1: "🚧 Bloqueos y rutas", 2: "🏛️ Política", 3: "📰 General", 4: "⚽ Deportes"}


def test_topic_rules_table_equals_case(spark, make):
    df = make(article(1, "hospital bloqueo"), article(2, "leyenda"), article(3, "nada"))
    rules = spark.createDataFrame(
        [(i, t, w) for i, (t, w) in enumerate(fixed.TOPIC_RULES)],
        "priority int, topic string, keywords array<string>",
    )
    a = ar.tag_topics(df).select("id", "topico").collect()
    b = ar.tag_topics_from_table(df, rules).select("id", "topico").collect()
    assert sorted(a) == sorted(b)


def test_fifty_thousand_rules_match_a_plain_search(spark, make):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcé ñ😀") for _ in range(n))
    rules = [(i, f"T{i % 977}", [word(rnd.randrange(5, 12)) for _ in range(rnd.randrange(3))])
             for i in range(50_000)]
    rules += [(60_000, "none", None), (50_001, "short", ["zq"]), (50_002, "one", ["😀"]), (50_003, "all", [""])]
    texts = [word(rnd.randrange(0, 200)) for _ in range(60)] + ["zq", "", "xzqx", "y😀y"]
    df = make(*[article(i, texto=t, titulo="") for i, t in enumerate(texts)])
    table = spark.createDataFrame(rules, "priority int, topic string, keywords array<string>")
    got = {r.id: r.topico for r in ar.tag_topics_from_table(df, table, "General").select("id", "topico").collect()}
    for i, t in enumerate(texts):
        want = next((topic for _, topic, words in sorted(rules, key=lambda r: r[0])
                     if any(w in " " + t.lower() for w in words or [])), "General")
        assert got[i] == want


def test_long_rules_meet_few_articles(spark, make):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab ") for _ in range(300)) for _ in range(150)]
    words = [t[i % 200:i % 200 + 70 + i % 30] for i, t in enumerate(texts)]
    words += [w[:20 + i % 9] for i, w in enumerate(words)] + ["", "zz", "é", "a b"]
    rules = [(i, f"T{i}", [w, w]) for i, w in enumerate(words + words[:50])]
    table = spark.createDataFrame(rules, "priority long, topic string, keywords array<string>")
    index = ar.keyword_index(table)
    assert index.count() == len(set(words))
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "n long, size int, bytes binary")
    long = ar._with_anchors(rows, [16, 64]).join(index, ["size", "anchor"]).select("n", "keyword").distinct()
    assert long.count() <= 12 * len(texts)  # of 45,000 pairs
    df = make(*[article(i, texto=t, titulo="") for i, t in enumerate([*texts, "zzé", "é"])])
    for room in (0, ar.SMALL_INDEX):
        got = {r.id: r.topico for r in ar.tag_topics_from_table(
            df, table.filter("priority != 300"), "General", room=room).select("id", "topico").collect()}
        for i, t in enumerate([*texts, "zzé", "é"]):
            assert got[i] == next((topic for n, topic, (w, _) in rules if n != 300 and w in " " + t), "General")


def test_topic_rules_move_parts_of_texts_only(spark, make):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(2000)) for _ in range(200)]
    rules = [(i, f"T{i}", [t[500:580 + i % 40]]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rules, "priority long, topic string, keywords array<string>")
    index = ar.keyword_index(table)
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "n long, size int, bytes binary")
    parts = ar._with_anchors(rows, [64], ar.mark_tables(index, {64: len(rules)}))
    assert parts.count() <= 2 * len(texts)  # of 23,000 anchors
    assert parts.agg(F.max(F.octet_length("part"))).first()[0] <= 190
    got = ar.tag_topics_from_table(make(*[article(i, texto=t, titulo="") for i, t in enumerate(texts)]),
                                   table, "General", room=0).select("id", "topico")
    node = got._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "texto" not in node.left().output().mkString(" ")
    assert {r.id: r.topico for r in got.collect()} == {i: f"T{i}" for i in range(len(texts))}


def test_topic_rules_on_repeats_long_keywords_and_repeated_keys(spark, make):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    long = word(4000)
    waves = "ab" * 20_000
    words = [long[100:3000], long[:700], long[-900:], long[1000:1040], "ab" * 9_000, "ba" * 6_000 + "c",
             "ab" * 40, "abab", "éa", "x" * 16, "x" * 15, "y" * 31, "y" * 32 + "é"]
    rules = [(i, None if i == 8 else f"T{i}", [w]) for i, w in enumerate(words)]
    table = spark.createDataFrame(rules, "priority long, topic string, keywords array<string>")
    texts = [waves, waves + "c", waves[:9_000], long, long[1:], long[:-1], long[150:], long[3000:], "x" * 40, "x" * 15,
             "x" * 14, "y" * 33, "y" * 32 + "é", "y" * 31, "éa", "é a", "ab" * 41, "", "ba" * 6_000]
    case = [(t, [w]) for _, t, (w,) in rules]

    def want(text):
        return next((t or "General" for t, (w,) in case if w in " " + text), "General")

    rows = [article(i % 5, texto=t, titulo="") for i, t in enumerate(texts)]  # keys repeat
    for room in (0, ar.SMALL_INDEX):
        got = ar.tag_topics_from_table(make(*rows), table, "General", room=room).select("texto", "topico")
        assert sorted(got.collect()) == sorted((t, want(t)) for t in texts)
    parts = ar._with_anchors(spark.createDataFrame([(0, 0, waves.encode())], "n long, size int, bytes binary"), [8192])
    assert parts.agg(F.sum(F.octet_length("part"))).first()[0] <= 2 * len(waves)


def test_dates_and_missing_values(make):
    df = ar.enrich(make(
        article(1), article(2, pub=None), article(3, pub=""), article(4, pub="2026-05-16 08:00:00"),
        article(5, pub="ayer"),
    ))
    got = {r.id: (r.fecha_final, r.fecha_str) for r in df.collect()}
    assert got[1] == (dt.datetime(2026, 5, 15), "2026-05-15")
    assert got[2] == (STAMP, "2026-05-20")
    assert got[3] == (None, "Sin fecha")
    assert got[4][0] == dt.datetime(2026, 5, 16, 8)
    assert got[5] == (None, "Sin fecha")


def test_date_range_edges(make):
    rows = [
        article(1, pub="2026-05-10"), article(2, pub="2026-05-21 00:00:00"),
        article(3, pub="2026-05-21 00:00:01"), article(4, pub=""), article(5, pub="2026-05-09"),
    ]
    df = ar.enrich(make(*rows))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(ar.feed_filter(df, start="2026-05-10", end="2026-05-20")) == [1, 2, 4]
    assert ids(ar.feed_filter(
        df, start="2026-05-10", end="2026-05-20", end_inclusive_midnight=False)) == [1, 4]


def test_text_filter_is_a_regex(make):
    df = ar.enrich(make(article(1, "ABC"), article(2, "x", "a.c"), article(3, "zzz")))
    ids = lambda **k: sorted(r.id for r in ar.feed_filter(df, **k).collect())
    assert ids(search=" A.C ") == [1, 2]
    assert ids(search="a.c", literal=True) == [2]
    assert ids(search="   ") == [1, 2, 3]


def test_feed_order_and_cap(make):
    df = ar.enrich(make(article(3), article(1), article(2, pub="2026-05-18"), article(4, pub="")))
    assert [r.id for r in ar.feed(df, limit=3).collect()] == [2, 1, 3]
    assert [r.id for r in ar.feed(df).collect()] == [2, 1, 3, 4]


@pytest.mark.parametrize("term, text, hit", [
    ("a_b", "xxaZbxx", True), ("%", "", True), ("abc", "ABC", True), ("é", "É", False),
    ("a\\b", "a\\b", True), ("a\\b", "ab", False),
])
def test_like(spark, term, text, hit):
    assert value(spark, tx.like_term(F.col("t"), term), t=text) is hit


def test_text_functions(spark):
    assert value(spark, tx.strip(F.col("t")), t="  a b\t\n") == "a b"
    assert value(spark, tx.excerpt(F.col("t"), 3), t="abc") == "abc"
    assert value(spark, tx.excerpt(F.col("t"), 3), t="abcd") == "abc…"
    assert value(spark, tx.excerpt(F.col("t"), 3, always=True), t="a") == "a…"
    assert value(spark, tx.capitalize(F.col("t")), t="éCONOMÍA y MÁS") == "Économía y más"
    assert value(spark, tx.or_default(F.col("t"), F.lit("d")), t="") == "d"
    assert value(spark, dates.stamp_text(F.col("t").cast("timestamp_ntz")), t="2026-01-02 03:04:05") \
        == "02/01/2026 03:04"


@pytest.mark.parametrize("href, want", [
    ("/a/b/c", "https://d.org/a/b/c"), ("//h/x", "https://h/x"), ("http://o/x", "http://o/x"),
    ("/a/../b/./c?x=/../y", "https://d.org/b/c?x=/../y"), ("rel/x", "rel/x"),
])
def test_resolve(spark, href, want):
    assert value(spark, urls.resolve(F.col("h"), F.lit("https://d.org")), h=href) == want


def test_segments(spark):
    size = lambda u: value(spark, F.size(urls.segments(F.col("u"))), u=u)
    assert size("https://h") == 1
    assert size("https://h/a/b/?q=1/2#x/y") == 2


def test_scoring_edges(spark):
    sim = F.col("s")
    assert value(spark, scoring.relevant(sim), s=0.08) is True
    assert value(spark, scoring.band(sim), s=0.08) == "baja"
    assert value(spark, scoring.band(sim), s=0.25) == "media"
    assert value(spark, scoring.result_message(sim, F.lit(3)), s=0.25) == "Encontré 3 noticias relevantes."
    assert value(spark, scoring.bar_width(sim), s=0.9) == 100
    assert value(spark, scoring.bar_width(sim), s=0.1) == 40


def test_tokens(spark):
    toks = lambda t: value(spark, terms.tokens(F.col("t"), fixed.STOP_WORDS), t=t)
    assert toks("La POLICÍA de Ñuflo") == ["policia", "nuflo"]
    assert toks("también") == ["tambien"]  # the accented stop word never matches
    assert toks("a_b x ﬁn 12") == ["a_b", "fin", "12"]


def test_metrics(make):
    df = ar.enrich(make(article(1, pub="2026-05-01"), article(2, fuente="g"), article(3, pub="")))
    assert [tuple(r) for r in metrics.ordered_count_by(df, "fuente").collect()] == [("f", 2), ("g", 1)]
    assert sorted(map(tuple, metrics.count_map(df, "fuente").collect())) == [("f", 2), ("g", 1)]
    window = metrics.date_window(df).first()
    assert window.inicio == dt.date(2026, 5, 8)
    row = metrics.kpis(df, F.lit(True), limit=2).first()
    assert (row.total, row.filtradas, row.filtradas_sin_tope, row.ultima) == (
        3, 2, 3, "15/05/2026 00:00")
    assert metrics.kpis(df.filter("id = 3"), F.lit(True)).first().ultima == "N/D"
    groups = [(r.fecha_str, r.n) for r in metrics.feed_groups(df).collect()]
    assert groups == [("2026-05-15", 1), ("2026-05-01", 1), ("Sin fecha", 1)]


def test_count_map_takes_any_number_of_keys(spark):
    df = spark.range(120_000).select(F.col("id").cast("string").alias("fuente"))
    assert metrics.count_map(df, "fuente").agg(F.count("*"), F.max("total")).first()[:] == (120_000, 1)


def test_run_summary_counts_unknown_as_error(spark):
    df = spark.createDataFrame([("nueva",), ("rara",), (None,), ("sin_cambios",)], "estado string")
    assert tuple(metrics.run_summary(df).first()) == (1, 0, 1, 2)
