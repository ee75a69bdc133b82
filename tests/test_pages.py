"""Gate, links and article extraction on hand-made pages."""


from newsloom import fixed
from newsloom.functions import html as hx
from newsloom.operators import pages as pg
from newsloom.plans import ingest
from newsloom.sources import testviews as tv
from newsloom.sources.store import ArticleStore
from pyspark.sql import functions as F

A, B = "https://www.lostiempos.com/x/y/z", "https://eldeber.com.bo/x/y"
BODY_A = '<div class="field field-name-body"><div class="i"><div>{}</div></div></div><p>menu text</p>'


def frame(spark, *htmls, url=B):
    return spark.createDataFrame(
        [(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def parsed(spark, *htmls, url=B):
    rows = pg.parse(frame(spark, *htmls, url=url)).orderBy("page_id").collect()
    return [(r.titulo, r.texto, r.fecha_pub) if r.titulo is not None else None for r in rows]


def test_gate(spark):
    rows = [
        (0, 403, "<html>"), (1, 429, "<html>"), (2, 500, "<html>"), (3, 200, "<html>CAPTCHA"),
        (4, 200, "plain"), (5, 200, " \n<!DOCTYPE html>x"), (6, 200, "x" * 600 + "<html>"),
        (7, None, "<HTML>Access Denied"), (8, 500, "access denied"), (9, None, "xx<html>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, status int, html string")
    got = [r.gate for r in pg.gate(df).orderBy("page_id").collect()]
    assert got == ["bloqueado", "bloqueado", "error", "bloqueado", "no_html", "ok", "no_html",
                   "bloqueado", "bloqueado", "ok"]


def test_entities(spark):
    text = "a &amp;lt; &lt;b&gt; &#233;&#xE9; &eacute;&Eacute; &am; &nope; &amp &copy; & &#0; 1&2"
    got = spark.range(1).select(hx.unescape(F.lit(text))).first()[0]
    assert got == "a &lt; <b> éé éÉ &am; &nope; & © & &#0; 1&2"


def test_portal_a_titles(spark):
    body = BODY_A.format("<p>" + "x" * 120 + "</p>")
    og = '<meta content="Og &amp; title" property="og:title">'
    got = parsed(
        spark,
        f'<h1 class="big page-header"> The <b>title</b></h1>{og}{body}',
        f"<h1>other</h1>{og}{body}",
        f"<h1>other</h1>{body}",
        f'<h1 class="page-header"> </h1>{og}{body}',
        f'<h1 class="page-header-x">no</h1>{body}',
        url=A,
    )
    assert [g and g[0] for g in got] == ["Thetitle", "Og & title", None, None, None]


def test_portal_a_body_and_date(spark):
    head = '<h1 class="page-header">T</h1>'
    date = '<meta property="article:published_time" content="2026-05-15T10:00:00-04:00">'
    got = parsed(
        spark,
        head + BODY_A.format("<p>" + "x" * 99 + "</p>"),
        head + date + BODY_A.format("<p>" + "x" * 49 + "</p><p> </p><p>" + "y" * 50 + "</p>"),
        head + '<meta property="article:published_time" content="">' + BODY_A.format("<p>" + "x" * 100),
        head + "<!-- " + BODY_A.format("<p>" + "x" * 200) + " -->",
        url=A,
    )
    assert got[0] is None
    assert got[1] == ("T", "x" * 49 + " " + "y" * 50, "2026-05-15")
    assert got[2] == ("T", "x" * 100, "")
    assert got[3] is None


def test_portal_b(spark):
    p40, p41 = "<p>" + "a" * 40 + "</p>", "<p>" + "b" * 41 + "</p>"
    wrap = "<h1>T</h1><article>{}</article><p>{}</p>".format
    got = parsed(
        spark,
        wrap(p40 * 9, "z" * 300),
        wrap(p41 * 5, "z" * 300),
        wrap("<p>" + "c" * 199 + "</p>", ""),
        wrap("<p>" + "c" * 200 + "</p>", ""),
        wrap("<p><b>" + "x" * 120 + "<br><p>" + "y" * 120 + "</p>", ""),
        wrap("<p>" + "d" * 100 + "<script>var t='</p>'</script> <i> " + "e" * 120 + " </i></p>", ""),
        "<article><p>" + "c" * 200 + "</p></article>",
    )
    assert got[0] is None
    assert got[1] == ("T", " ".join(["b" * 41] * 5), None)
    assert got[2] is None
    assert got[3][1] == "c" * 200
    assert got[4][1] == "x" * 120 + " " + "y" * 120  # two paragraphs, no repeat
    assert got[5][1] == "d" * 100 + " " + "e" * 120
    assert got[6] is None


def links(spark, url, *hrefs, **kw):
    html = "".join(f'<a class="x" href="{h}">t</a>' for h in hrefs) + "<a name='n'>no</a>"
    rows = pg.links(frame(spark, html, url=url), **kw).orderBy("pos").collect()
    return [r.enlace for r in rows]


def test_links_portal_a(spark):
    base = "https://www.lostiempos.com"
    got = links(
        spark, A, "/actualidad/pais/nota", "/a/b/c", "/hoy/x", "/cochabamba/b/c#t",
        "mailto:x@y", "//www.lostiempos.com/hoy/b/c", "https://other.com/hoy/b/c",
        "/actualidad/pais/nota", "/hoy/rss/x", base + "/pais/b/c/", "javascript:void(0)",
    )
    assert got == [base + "/actualidad/pais/nota", base + "/hoy/b/c", base + "/pais/b/c/"]


def test_links_portal_b(spark):
    base = "https://eldeber.com.bo"
    got = links(spark, B, " /pais/nota ", "/solo", "/a/b?x=1&amp;y=2", "#t", "/a/b#c", "/pais/nota")
    assert got == [base + "/pais/nota", base + "/a/b?x=1&y=2"]


def test_links_cap_by_position(spark):
    hrefs = [f"/a/{i}" for i in range(60)]
    got = links(spark, B, *hrefs)
    assert got == [f"https://eldeber.com.bo/a/{i}" for i in range(fixed.MAX_LINKS_PER_PAGE)]


def test_other_hosts_are_no_portal(spark):
    assert links(spark, "https://notlostiempos.com/x", "/actualidad/b/c") == []


def test_custom_parser(spark):
    portals = [{**fixed.PORTALS[1], "parser": "mine"}]
    mine = lambda page: F.struct(
        F.lit("t").alias("titulo"), F.upper(page).alias("texto"),
        F.lit(None).cast("string").alias("fecha_pub"))
    row = pg.parse(frame(spark, "abc"), portals, {"mine": mine}).first()
    assert (row.titulo, row.texto) == ("t", "ABC")


def test_ingest_job(spark, tmp_path):
    page = "<html><h1>T{}</h1><article><p>{}</p></article>".format
    rows = [(0, B + "/1", page(1, "a" * 200)), (1, B + "/2", page(2, "b" * 200)),
            (2, B + "/3", page(3, "short")), (3, B + "/4", "<html>captcha")]
    schema = "page_id long, url string, html string"
    store = ArticleStore(spark, str(tmp_path / "s"), buckets=4)
    ingest.run(store, spark.createDataFrame(rows, schema), 0, "2026-05-20 10:00:00")
    rows[0] = (0, B + "/1", page(1, "c" * 200))
    ingest.run(store, spark.createDataFrame(rows, schema), 1, "2026-05-20 11:00:00")
    runs = [(r.nuevas, r.actualizadas, r.sin_cambios, r.errores)
            for r in store.runs().orderBy("batch_id").collect()]
    assert runs == [(2, 0, 0, 2), (0, 1, 1, 2)]
    assert {r.fuente for r in store.articles().collect()} == {"EL DEBER"}
    reasons = sorted(r.motivo for r in ingest.rejected(spark.createDataFrame(rows, schema)).collect())
    assert reasons == ["bloqueado", "sin_articulo"]


def test_links_inside_templates_are_found(spark):
    html = ('<html><!-- <a href="/c/1">no</a> --><template><a href="/t/1">x</a></template>'
            '<script>"<a href=/s/1>"</script><a href="/p/1">y</a></html>')
    pages = spark.createDataFrame([(1, "https://example.com/x", html)], "page_id long, url string, html string")
    rows = pg.links(pages, tv.SAMPLE_PORTALS).orderBy("pos").collect()
    assert [r.enlace for r in rows] == ["https://example.com/t/1", "https://example.com/p/1"]
