"""Streams against their batch results; late data; open windows."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import scan, transcripts
from newsloom.sources.store import ArticleStore
from newsloom.streaming import changes, ingest, timeline

NOW = "2026-05-20 10:00:00"


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def test_ingest_over_split_files_equals_one_batch(spark, tmp_path):
    rows = [(f"u{i % 7}", f"t{i}", "ABC"[i * i % 3], "s", None, i) for i in range(60)]
    frame = lambda r: spark.createDataFrame(r, schemas.INCOMING)
    one = ArticleStore(spark, str(tmp_path / "one"), buckets=4)
    one.apply(frame(rows), 0, NOW)
    store = ArticleStore(spark, str(tmp_path / "store"), buckets=4)
    for lo in (0, 20, 40):
        frame(rows[lo:lo + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        stream = ingest.landed(spark, str(tmp_path / "land"))
        drain(ingest.ingest(stream, store, str(tmp_path / "ck"), NOW))
    state = lambda s: (sorted((r.url, r.titulo, r.texto) for r in s.articles().collect()),
                       sorted((r.url, r.titulo, r.texto_anterior) for r in s.history().collect()))
    assert state(store) == state(one)
    assert store.runs().count() == 3


def event(i, day, hour, kind="a"):
    return (i, dt.datetime(2026, 5, day, hour), i % 3, kind, 1.0, "{}")


def test_timeline_keeps_late_rows_aside_and_the_last_day_open(spark, tmp_path):
    batches = [
        [event(0, 1, 10), event(1, 1, 12, "b"), event(2, 2, 9)],
        [event(3, 2, 11), event(4, 4, 9)],
        [event(5, 1, 10), event(6, 4, 8), event(7, 5, 12), (8, None, 0, "a", 1.0, "{}")],
    ]
    out, ck, land = (str(tmp_path / n) for n in ("out", "ck", "land"))
    for rows in batches:
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schemas.EVENTS).parquet(land)
        drain(timeline.daily_counts(stream, out, ck))
    closed = lambda: sorted((r.fecha.day, r.event_type, r.total)
                            for r in timeline.closed_days(spark, out).collect())
    assert closed() == [(1, "a", 1), (1, "b", 1), (2, "a", 2), (4, "a", 2)]
    late = lambda: timeline.late_rows(spark, out, schemas.EVENTS)
    assert sorted(r.event_id for r in late().collect()) == [5, 8]
    still_open = spark.read.parquet(f"{out}/open/batch_id=2").agg(F.sum("total")).first()[0]
    assert sum(t for *_, t in closed()) + late().count() + still_open == sum(map(len, batches))
    third = spark.createDataFrame(batches[2], schemas.EVENTS)
    timeline._merge(third, 2, out, "event_type", "ts", "1 hour")  # the same micro-batch again
    assert len(closed()) == 4 and late().count() == 2


def test_changes_keep_state_between_batches(spark, tmp_path):
    base, ck, land = (str(tmp_path / n) for n in ("out", "ck", "land"))
    batches = [[("k", 2, "x"), ("k", 1, "x"), ("m", 1, "y"), ("n", 1, None)],
               [("k", 4, "y"), ("k", 3, "x"), ("n", 2, None), ("k", 4, "y")], [("m", 5, "z")]]
    schema = "clave string, orden long, huella string"
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        stream = spark.readStream.schema(schema).parquet(land)
        drain(changes.detect(stream, base, ck))
    got = lambda: sorted((r.clave, r.orden, r.estado)
                         for r in changes.statuses(spark, base).collect())
    want = [("k", 1, "nueva"), ("k", 2, "sin_cambios"), ("k", 3, "sin_cambios"), ("k", 4, "actualizada"),
            ("k", 4, "sin_cambios"), ("m", 1, "nueva"), ("m", 5, "actualizada"), ("n", 1, "nueva"),
            ("n", 2, "sin_cambios")]
    assert got() == want
    seen = changes.last_seen(spark, base, before=1)
    again = changes.compared(spark.createDataFrame(batches[1], schema), seen)
    assert sorted(map(tuple, again.collect())) == [w for w in want if w[:2] in {
        ("k", 3), ("k", 4), ("n", 2)}]
    assert changes.last_seen(spark, base, before=3, ttl="0 seconds").count() == 0


def test_a_hot_key_of_changes_is_spread(spark):
    """One key has nearly all rows, and one of its rows comes very often."""
    i = F.col("id")
    rows = spark.range(60_000).select(
        F.lit("hot").alias("clave"), F.when(i < 20_000, 5).otherwise(i * 997).cast("long").alias("orden"),
        F.when(i < 20_000, "r").otherwise((i % 2).cast("string")).alias("huella"))
    known = spark.createDataFrame([("hot", "q")], "clave string, huella string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = changes.compared(rows, known, slices=8).cache()
        laid = scan.sliced(rows.distinct(), ["clave", "orden", "huella"], 8)
        sizes = [r["n"] for r in laid.groupBy("slice").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    assert out.count() == 60_000
    assert {r["estado"]: r["count"] for r in out.groupBy("estado").count().collect()} == {
        "sin_cambios": 19_999, "actualizada": 40_001}


def test_transcripts_are_whole_and_in_order(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(600)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, schemas.CONVERSATIONS).repartition(3)
    got = transcripts.transcripts(df).collect()  # partitions in order
    assert [r.linea for r in got] == [f"{r[2]}: {r[3]}" for r in rows]


def test_changes_do_not_depend_on_files(spark, tmp_path):
    rows = [event(i, 1 + i % 9, i % 24, "abc"[i * i % 3]) for i in range(300)]
    found = []
    for n in (1, 7):
        base = tmp_path / str(n)
        df = spark.createDataFrame(rows, schemas.EVENTS)
        (df.repartition(n, "event_type", "ts") if n > 1 else df.coalesce(1)).write.parquet(str(base / "land"))
        stream = spark.readStream.schema(schemas.EVENTS).parquet(str(base / "land"))
        keyed = changes.keyed(stream, F.col("user_id"), F.col("event_id"), F.col("event_type"))
        drain(changes.detect(keyed, str(base / "out"), str(base / "ck")))
        found.append(sorted(map(tuple, changes.statuses(spark, str(base / "out")).collect())))
    assert found[0] == found[1] and len(found[0]) == 300
