"""Upsert: golden sequences and a sequential model."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import versions
from newsloom.sources.store import ArticleStore

NOW = "2026-05-20 10:00:00"
NOW_DT = dt.datetime(2026, 5, 20, 10)
OLD = dt.datetime(2026, 5, 1)


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def stored_row(i, url, titulo, texto, fuente="S", pub=None):
    return (i, url, titulo, texto, fuente, md5(texto), pub, OLD)


def model(stored, arrivals):
    """One row at a time, as a table with a history would be kept."""
    table = {r[1]: dict(titulo=r[2], texto=r[3], fuente=r[4], pub=r[6]) for r in stored}
    status, history = {}, []
    for url, titulo, texto, fuente, pub, seq in sorted(arrivals, key=lambda a: a[5]):
        row = table.get(url)
        if row is None:
            table[url] = dict(titulo=titulo, texto=texto, fuente=fuente, pub=pub)
            status[url, seq] = "nueva"
        elif row["texto"] == texto:
            status[url, seq] = "sin_cambios"
        else:
            history.append((url, row["titulo"], row["texto"]))
            row.update(titulo=titulo, texto=texto)
            status[url, seq] = "actualizada"
    current = {(u, r["titulo"], r["texto"], r["fuente"], r["pub"]) for u, r in table.items()}
    return status, sorted(history), current


def results(u):
    status = {(r.url, r.seq): r.estado for r in u.status.collect()}
    history = sorted((r.url, r.titulo, r.texto_anterior) for r in u.history.collect())
    current = {(r.url, r.titulo, r.texto, r.fuente, r.fecha_pub) for r in u.current.collect()}
    return status, history, current


def run(spark, stored, arrivals, **kw):
    e = spark.createDataFrame(stored, schemas.ARTICLES)
    i = spark.createDataFrame(arrivals, schemas.INCOMING)
    return versions.upsert(e, i, NOW, **kw)


def test_new_edit_same(spark):
    arrivals = [("u", "T1", "B1", "S", "2026-05-15", 0), ("u", "T2", "B2", "S", None, 1),
                ("u", "T2", "B2", "S", None, 2)]
    u = run(spark, [], arrivals)
    status, history, current = results(u)
    assert [status["u", i] for i in range(3)] == ["nueva", "actualizada", "sin_cambios"]
    assert history == [("u", "T1", "B1")]
    assert current == {("u", "T2", "B2", "S", "2026-05-15")}
    row = u.history.first()
    assert row.hash_anterior == md5("B1") and row.fecha_cambio == NOW_DT
    assert row.noticia_id == u.current.first().id


@pytest.mark.parametrize("slices", [None, 1, 9])
def test_golden_sequences(spark, slices):
    stored = [stored_row(1, "a", "T1", "A"), stored_row(2, "b", "T1", "A", pub="2026-01-01"),
              stored_row(3, "z", "Z", "Z")]
    arrivals = [
        ("a", "T2", "A", "X", None, 0), ("a", "T3", "B", "X", None, 1),        # title after no-op
        ("b", "T2", "B", "X", "2026-02-02", 0), ("b", "T3", "A", "X", None, 5),  # A, B, A
        ("c", "N", "N", "X", "", 7),
    ]
    got = results(run(spark, stored, arrivals, slices=slices))
    assert got == model(stored, arrivals)
    assert got[1] == [("a", "T1", "A"), ("b", "T1", "A"), ("b", "T2", "B")]


@pytest.mark.parametrize("seed, slices", [(1, 3), (2, 16), (3, None)])
def test_random_sequences_with_a_hot_url(spark, seed, slices):
    rnd = random.Random(seed)
    names = [f"u{i}" for i in range(40)]
    stored = [stored_row(i, u, "T", rnd.choice("AB"), pub="2026-01-01")
              for i, u in enumerate(names) if rnd.random() < 0.5]
    arrivals = [
        ("u0" if rnd.random() < 0.34 else rnd.choice(names), f"t{i}", rnd.choice("ABC"),
         f"s{i}", None, i) for i in range(400)
    ]
    u = run(spark, stored, arrivals, slices=slices)
    got, want = results(u), model(stored, arrivals)
    assert got == want
    assert len(got[1]) == sum(s == "actualizada" for s in got[0].values())


def test_track_title(spark):
    stored = [stored_row(1, "a", "T1", "A")]
    u = run(spark, stored, [("a", "T2", "A", "X", None, 0)], track_title=True)
    assert [r.estado for r in u.status.collect()] == ["actualizada"]
    assert {r.titulo for r in u.current.collect()} == {"T2"}


def test_a_hot_url_with_sparse_orders_is_spread(spark):
    """200,000 arrivals of one url with time stamps as order, some delivered twice."""
    i = F.col("id")
    df = spark.range(200_000).select(
        F.lit("hot").alias("url"), F.lit("t").alias("titulo"),
        (i % 3).cast("string").alias("texto"), F.lit("s").alias("fuente"),
        F.lit(None).cast("string").alias("fecha_pub"),
        (i * 1_000_003 * 60 + 1_700_000_000_000_000).alias("seq"))
    df = df.union(df.filter("seq % 7 = 0")).union(df.limit(300).withColumn("url", F.lit("cold")))
    existing = spark.createDataFrame([], schemas.ARTICLES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = versions.ordered(existing, df, slices=16)
        sizes = [r["n"] for r in laid.groupBy("slice").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 200_300 / 16
        resolved = versions.resolve(existing, df, slices=16)
        hot = resolved.filter("url = 'hot'")
        assert hot.count() == 200_000 and hot.filter("changed").count() == 200_000
        last = hot.orderBy(F.desc("seq")).first()
        assert (last.version, last.versions, last.estado) == (200_000, 200_000, "actualizada")
        assert hot.agg(F.count_distinct("version")).first()[0] == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def store_state(store):
    current = sorted((r.url, r.titulo, r.texto, r.fuente, r.fecha_pub)
                     for r in store.articles().collect())
    history = sorted((r.url, r.titulo, r.texto_anterior) for r in store.history().collect())
    return current, history


def test_store_batches_equal_one_batch_and_replay(spark, tmp_path):
    rnd = random.Random(9)
    arrivals = [(f"u{rnd.randrange(15)}", f"t{i}", rnd.choice("ABC"), f"s{i}", None, i)
                for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, schemas.INCOMING)
    one = ArticleStore(spark, str(tmp_path / "one"), buckets=4)
    one.apply(frame(arrivals), 0, NOW)
    two = ArticleStore(spark, str(tmp_path / "two"), buckets=4)
    two.apply(frame(arrivals[:50]), 0, NOW)
    two.apply(frame(arrivals[50:]), 1, NOW)
    want = model([], arrivals)
    assert store_state(one) == store_state(two) == (sorted(want[2]), want[1])
    before = store_state(two)
    two.apply(frame(arrivals[50:]), 1, NOW)  # the same batch again: nothing doubles
    assert store_state(two) == before
    assert sum(r.nuevas + r.actualizadas + r.sin_cambios for r in two.runs().collect()) == 120
    two.apply(frame(arrivals[-1:]), 2, NOW)  # last state again: no change
    assert store_state(two) == before
    last = two.runs().filter("batch_id = 2").first()
    assert (last.nuevas, last.actualizadas, last.sin_cambios) == (0, 0, 1)
    assert {r.texto for r in two.articles(before=1).collect()} <= set("ABC")


def folder_bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_store_writes_follow_the_batch(spark, tmp_path):
    """Bodies are written once: a small batch over all buckets rewrites heads only."""
    rnd = random.Random(4)
    body = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000))
    store = ArticleStore(spark, str(tmp_path / "s"), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, schemas.INCOMING)
    first = [(f"u{i}", f"t{i}", body(), "s", None, i) for i in range(200)]
    edits = [(f"u{i}", f"n{i}", body(), "s", None, i) for i in range(0, 200, 25)]
    store.apply(frame(first), 0, NOW)
    store.apply(frame(edits + [("neu", "n", "b", "s", None, 1)]), 1, NOW)
    bodies = tmp_path / "s" / "articles"
    assert folder_bytes(bodies / "batch_id=1") < folder_bytes(bodies / "batch_id=0") / 20
    assert spark.read.parquet(str(bodies / "batch_id=1")).count() == 9
    heads = store.heads()
    assert "texto" not in heads.columns and heads.count() == 201
    assert heads.filter("origen = 1").count() == 9
    want = {r[0]: r[1:3] for r in first + edits} | {"neu": ("n", "b")}
    assert {r.url: (r.titulo, r.texto) for r in store.articles().collect()} == want
    assert {r.url: r.texto for r in store.articles(before=1).collect()} == {r[0]: r[2] for r in first}
    assert {r.url: r.texto_anterior for r in store.history().collect()} == {
        r[0]: first[int(r[0][1:])][2] for r in edits}
    assert [r.texto for r in store.article("u25").collect()] == [edits[1][2]]
    # A batch that replaces every body: no folder of the first one is listed any more.
    store.apply(frame([(r[0], "x", "x" + r[0], "s", None, 0) for r in first]), 2, NOW)
    assert not any("batch_id=0" in f for f in store.articles().inputFiles() if "/articles/" in f)
    assert store.articles().count() == 201
    store.apply(frame([]), 3, NOW)  # nothing arrives
    assert store.articles().count() == 201
    assert store.runs().filter("batch_id = 3").first().nuevas == 0


def test_history_reads(spark):
    arrivals = [("u", "T1", "B1", "S", None, 0), ("u", "T2", "B2", "S", None, 1),
                ("u", "T3", "B3", "S", None, 2), ("v", "T", "B", "S", None, 0)]
    u = run(spark, [], arrivals)
    joined = [r.titulo for r in versions.history_for(u.history, u.current, "u").collect()]
    direct = [r.titulo for r in versions.history_direct(u.history, "u").collect()]
    assert joined == direct == ["T2", "T1"]
    assert versions.history_for(u.history, u.current, "v").count() == 0


def test_repeated_and_sparse_orders_match_the_sequential_model(spark):
    """Deliveries in duplicate, equal orders, and order values far apart."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        rows.append((f"u{i % 5}", f"t{rng.randrange(3)}", "ABC"[rng.randrange(3)], "s", None,
                     rng.randrange(40) * 10**9))
    rows += rng.sample(rows, 40)
    existing = spark.createDataFrame([], schemas.ARTICLES)
    incoming = spark.createDataFrame(rows, schemas.INCOMING).repartition(4)
    u = versions.upsert(existing, incoming, "2026-05-20 10:00:00")
    current = {r.url: r.texto for r in u.current.collect()}
    assert u.current.count() == len(current) == 5
    status = {(r.url, r.seq): r.estado for r in u.status.collect()}
    assert u.status.count() == len(status) == len({(r[0], r[5]) for r in rows})
    edits = 0
    for url in current:
        texts = []
        for seq in sorted({r[5] for r in rows if r[0] == url}):
            same = [r[2] for r in rows if r[0] == url and r[5] == seq]
            text = min(same, key=lambda t: hashlib.md5(t.encode()).hexdigest())
            want = "nueva" if not texts else "sin_cambios" if texts[-1] == text else "actualizada"
            assert status[url, seq] == want
            texts.append(text)
        assert current[url] == texts[-1]
        edits += sum(a != b for a, b in zip(texts, texts[1:]))
    assert u.history.count() == edits


def test_a_sieve_keeps_the_wanted_rows_and_few_others(spark):
    rows = spark.range(4000).selectExpr("if(id % 50 = 0, null, concat('u', id)) url", "id seq", "repeat('x', 9) texto")
    wanted = rows.filter("seq % 40 = 0").select("url", "seq")
    kept = sorted(r.seq for r in versions.sifted(rows, wanted, ["url", "seq"]).collect())
    assert set(range(0, 4000, 40)) <= set(kept) and len(kept) == len(set(kept)) <= 110
    assert versions.sifted(rows, wanted, ["url", "seq"]).columns == rows.columns
    assert versions.sifted(rows, wanted.filter("false"), ["url", "seq"]).count() == 0
