"""Lexical search, dense search, indexing, prompts."""

import datetime as dt
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import fixed, schemas
from newsloom.operators import dense, lexical, retrieval
from newsloom.plans import indexing
from newsloom.sources.store import DocumentIndex, LexicalTables

STAMP = dt.datetime(2026, 5, 20)


def corpus(spark, *texts):
    rows = [(i, f"u{i}", t, b, "f", f"h{i}", None, STAMP) for i, (t, b) in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.ARTICLES)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, consulta string")


def plain_tokens(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower())
                   if not unicodedata.combining(c))
    words, run = [], ""
    for c in text + " ":
        if c.isalnum() or c == "_":
            run += c
        else:
            if len(run) > 1:
                words.append(run)
            run = ""
    words = [w for w in words if w not in fixed.STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, query):
    """Cosine of every document to the query, term by term."""
    bags = [plain_tokens(f"{t} {t} {b}") for t, b in docs]
    df = {}
    for bag in bags:
        for term in set(bag):
            df[term] = df.get(term, 0) + 1
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(bag):
        raw = {t: (1 + math.log(bag.count(t))) * idf[t] for t in set(bag) if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    q = vector(plain_tokens(query))
    return [sum(w * q.get(t, 0) for t, w in vector(bag).items()) for bag in bags]


DOCS = [
    ("Bloqueo en la ruta", "Sindicatos mantienen el bloqueo de la carretera a Oruro"),
    ("Dólar paralelo", "El dólar sube y la economía sufre; economía en crisis"),
    ("Policía", "La policía detuvo a un sospechoso de atraco en la carretera"),
    ("Fútbol", "Ganó el torneo con gol en el minuto final"),
    ("Uno", ""),
]


def test_search_equals_brute_force(spark):
    queries = ["bloqueo carretera", "¿POLICIA en la carretera?", "la economía del dólar"]
    index = lexical.fit(corpus(spark, *DOCS))
    got = {}
    for r in lexical.search(index, asked(spark, *queries), k=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.similitud)
    for qid, text in enumerate(queries):
        sims = [round(s, 6) for s in brute_force(DOCS, text)]
        order = sorted(range(len(DOCS)), key=lambda i: (-sims[i], i))[:3]
        assert [got[qid][n + 1][0] for n in range(3)] == order
        assert [got[qid][n + 1][1] for n in range(3)] == pytest.approx([sims[i] for i in order])


def test_unknown_words_blank_and_short_corpus(spark):
    index = lexical.fit(corpus(spark, *DOCS[:3]))
    queries = asked(spark, "zzz qqq", "   ", "bloqueo")
    hits = lexical.search(index, queries, k=5)
    rows = {(r.query_id, r["rank"]): (r.id, r.similitud) for r in hits.collect()}
    assert [rows[0, n] for n in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert len(rows) == 6 and rows[2, 1][0] == 0 and rows[2, 2] == (1, 0.0)
    summary = {r.query_id: r for r in lexical.summary(queries, hits).collect()}
    assert summary[0].mensaje == fixed.MSG_WEAK and summary[0].tiene_resultados
    assert summary[1].mensaje == fixed.MSG_BLANK_QUERY and not summary[1].tiene_resultados
    assert summary[1].max_similitud == 0.0


def test_empty_corpus(spark):
    index = lexical.fit(corpus(spark, *DOCS[:1]).filter("id < 0"))
    queries = asked(spark, "bloqueo")
    hits = lexical.search(index, queries)
    assert hits.count() == 0
    assert lexical.summary(queries, hits).first().mensaje == fixed.MSG_EMPTY_CORPUS


def test_salted_join_equals_broadcast(spark):
    index = lexical.fit(corpus(spark, *DOCS))
    queries = asked(spark, "bloqueo carretera", "economía dólar", "gol")
    plain = sorted(map(tuple, lexical.search(index, queries).collect()))
    salted = sorted(map(tuple, lexical.search(index, queries, max_broadcast_rows=1).collect()))
    assert plain == salted


def test_refit_and_stored_search(spark, tmp_path):
    tables = LexicalTables(spark, str(tmp_path / "lex"))
    docs = corpus(spark, *DOCS)
    assert tables.refit(docs, "v1") == len(DOCS)
    queries = asked(spark, "bloqueo carretera", "economía dólar")
    fresh = sorted(map(tuple, lexical.search(lexical.fit(docs), queries).collect()))
    stored = sorted(map(tuple, lexical.search(tables.load("v1"), queries).collect()))
    assert fresh == stored
    assert tables.refit(docs.filter("id < 2"), "v2") == 2
    assert lexical.search(tables.load("v2"), queries, k=5).filter("query_id = 0").count() == 2


def test_update_equals_a_fresh_fit(spark, tmp_path):
    """Edits, title edits, removals and additions, over two updates and out of order."""
    tables = LexicalTables(spark, str(tmp_path / "lex"), max_features=40)
    first = [(i, t, b) for i, (t, b) in enumerate(DOCS)]
    second = [(0, "Bloqueo en la ruta", "Sindicatos levantan el bloqueo"), (1, *DOCS[1]),
              (3, "Fútbol: final", DOCS[3][1]), (4, None, None), (7, "Lluvia", "Lluvia y gol en Oruro")]
    third = [(0, *DOCS[0]), (2, *DOCS[2]), (7, "Lluvia", "Lluvia y gol en Oruro")]
    queries = asked(spark, "bloqueo carretera", "economía dólar", "gol final oruro", "nada")
    frames = [spark.createDataFrame(rows, "id long, titulo string, texto string")
              for rows in (first, second, third)]
    tables.refit(frames[0], "v0")
    for n in (1, 2):
        assert tables.update(frames[n], f"v{n}", f"v{n - 1}") == frames[n].count()
        stored, fresh = tables.load(f"v{n}"), lexical.fit(frames[n], max_features=40)
        assert sorted(map(tuple, stored.vocab.collect())) == sorted(map(tuple, fresh.vocab.collect()))
        want = sorted(map(tuple, lexical.search(fresh, queries, k=4).collect()))
        assert [r[:2] for r in sorted(map(tuple, lexical.search(stored, queries, k=4).collect()))] == [
            r[:2] for r in want]
        salted = lexical.search(stored, queries, k=4, max_broadcast_rows=1)
        assert [r[:2] for r in sorted(map(tuple, salted.collect()))] == [r[:2] for r in want]
    # Only what changed is cut into terms again.
    assert spark.read.parquet(str(tmp_path / "lex/v2/rows")).count() == 2
    with pytest.raises(ValueError):
        tables.update(frames[0], "v1", "v2")


def test_documents_are_scored_whole_in_their_task(spark, tmp_path, monkeypatch):
    """No cut of a batch, number of tasks or order of documents changes the hits."""
    rng = np.random.default_rng(3)
    words = [f"palabra{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[:1 + i % 60], 1 + i % 25)) for i in range(300)]
    texts[100:200] = [texts[100]] * 100  # a third of all rows are copies
    docs = corpus(spark, *[("", t) for t in texts]).repartition(4)
    queries = asked(spark, *[" ".join(rng.choice(words, 1 + i % 4)) for i in range(30)])
    tables = LexicalTables(spark, str(tmp_path / "lex"))
    tables.refit(docs, "v1")
    index = tables.load("v1")
    want = sorted((r.query_id, r["rank"], r.id, r.similitud)
                  for r in lexical.search(lexical.fit(docs), queries, k=7).collect())
    for cells in (lexical.CELLS, 50):
        weights = lexical.weigh(lexical.asked_counts(index, queries), index.vocab, "query_id")
        monkeypatch.setattr(lexical, "CELLS", cells)
        scorer = lexical.RowScorer(index.vocab.select("term", "idf").toPandas(), weights.toPandas(), 7)
        table = index.rows.select("id", "terminos").toArrow()
        for b in table.to_batches(max_chunksize=37):
            scorer.add(b.column(0).to_numpy(), b.column(1))
        got = scorer.result().to_pandas()
        found = {(q, i, s) for q, _, i, s in want if s > 0}
        assert {(r.query_id, r.id, r.similitud) for r in got[got.similitud > 0].itertuples()} == found
    stored = lexical.search(index, queries, k=7).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.similitud) for r in stored) == want


def test_vocabulary_cut(spark):
    vocab = lexical.fit(corpus(spark, *DOCS), max_features=3).vocab.collect()
    assert len(vocab) == 3
    assert [r.cf for r in sorted(vocab, key=lambda r: (-r.cf, r.term))] == sorted(
        (r.cf for r in vocab), reverse=True)


# ------------------------------------------------------------------- dense


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    docs = base[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 16))
    docs[100:200] = docs[100]  # a third of all rows are copies
    queries = base + 0.1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)],
                              "id long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)],
                              "query_id long, embedding array<float>")
    return d, q, docs.astype(np.float32).astype(float), queries.astype(np.float32).astype(float)


def exact(docs, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(docs) @ unit(queries).T, 6)
    return {(q, int(i)) for q in range(len(queries))
            for i in sorted(range(len(docs)), key=lambda i: (-sims[i, q], i))[:k]}


@pytest.mark.parametrize("limit", [4096, 2])
@pytest.mark.parametrize("k", [1, 2, 7])
def test_nearest_is_exact(clouds, limit, k):
    d, q, docs, queries = clouds
    rows = dense.nearest(d.repartition(5), q, k, max_broadcast_queries=limit).collect()
    assert {(r.query_id, r.id) for r in rows} == exact(docs, queries, k)
    assert max(r["rank"] for r in rows) == k


def test_nearest_small_collection(clouds):
    d, q, *_ = clouds
    assert dense.nearest(d.filter("id < 1"), q, 2).count() == 6
    assert dense.nearest(d.filter("id < 0"), q, 2).count() == 0


def test_lsh_recall(clouds):
    d, q, docs, queries = clouds
    model = dense.lsh_model(d, bucket_length=0.5, tables=8)
    rows = dense.nearest_lsh(dense.lsh_index(d, model), q, model, 2).collect()
    got, want = {(r.query_id, r.id) for r in rows}, exact(docs, queries, 2)
    assert len(got & want) / len(want) >= 0.9
    assert max(r["rank"] for r in rows) <= 2


# ------------------------------------------------------- index and prompts


def make_stub():
    """Stub model: length and vowel counts."""
    def predict(texts):
        return np.array([[len(t), *(t.count(v) for v in "aeiou")] for t in texts], dtype=np.float32)
    return predict


def test_incremental_index(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"))
    docs = corpus(spark, *DOCS)
    assert indexing.index_new(index, docs.filter("id < 3"), 0, make_stub) == 3
    assert indexing.index_new(index, docs, 1, make_stub) == 2
    assert indexing.index_new(index, docs, 2, make_stub) == 0
    edited = docs.withColumn("hash_texto", F.when(F.col("id") == 0, "new").otherwise(F.col("hash_texto")))
    assert indexing.index_new(index, edited, 3, make_stub) == 0  # stale by default
    assert indexing.index_new(index, edited, 4, make_stub, refresh=True) == 1
    row = index.read(before=1).filter("doc_key = 'noticia_0'").first()
    assert row.document.startswith("TÍTULO: Bloqueo en la ruta\n\nCONTENIDO: Sindicatos")
    assert row.metadata == {"url": "u0", "titulo": "Bloqueo en la ruta", "fuente": "f", "fecha_pub": ""}
    assert row.embedding[0] == len(row.document)


def test_prompts_by_mode(spark):
    docs = retrieval.index_documents(corpus(spark, ("T0", "x" * 600), ("T1", "b1")))
    index = docs.withColumn("embedding", F.when(F.col("id") == 0, F.array(F.lit(1.0), F.lit(0.0)))
                            .otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    rows = [(0, "ruta", "q?", [0.1, 1.0]), (1, "fact_checking", "q?", [1.0, 0.1]),
            (2, "general", "q?", [1.0, 0.1]), (3, "??", "q?", [1.0, 0.1])]
    queries = spark.createDataFrame(
        rows, "query_id long, mode string, texto string, embedding array<double>")
    got = {r.query_id: r for r in
           retrieval.prompts(queries, retrieval.contexts(index, queries)).collect()}
    first = "TÍTULO: T0\n\nCONTENIDO: " + "x" * (400 - len("TÍTULO: T0\n\nCONTENIDO: "))
    second = "TÍTULO: T1\n\nCONTENIDO: b1"
    assert f"[Fuente: f | T1]\n{second}\n\n---\n\n[Fuente: f | T0]\n{first}\n\nPREGUNTA" in got[0].prompt
    assert "NO VERIFICABLE" in got[1].prompt and '"q?"' in got[1].prompt
    assert f"CONTEXTO:\n[f - T0]\n{first}\n\n---" in got[2].prompt
    assert got[3].prompt == got[2].prompt
    assert [s.url for s in got[1].fuentes] == ["u0", "u1"]
    none = {r.query_id: r for r in retrieval.prompts(
        queries, retrieval.contexts(index.filter("id < 0"), queries)).collect()}
    assert none[0].prompt is None and none[0].respuesta == fixed.RUTA_NO_CONTEXT
    assert fixed.FACT_CHECK_NO_CONTEXT in none[1].prompt
    assert fixed.GENERAL_NO_CONTEXT in none[2].prompt and none[2].fuentes == []


def test_nearest_with_null_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, [None, 1.0])],
        "id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.1]), (7, [1.0, 0.1]), (9, None)], "query_id long, embedding array<double>")
    for limit in (4096, 1):
        rows = dense.nearest(docs, queries, 3, max_broadcast_queries=limit).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id, r["rank"]) for r in rows] == [(q, i, r) for q in (0, 7) for i, r in ((1, 1), (3, 2))]


@pytest.mark.parametrize("limit", [4096, 2])
def test_each_dimension_is_searched_by_itself(spark, limit):
    rng = np.random.default_rng(8)
    docs = [(i, rng.normal(size=(5, 3, 8)[i % 3]).tolist()) for i in range(90)]
    docs += [(90, []), (91, None)]
    asked_ = [(q, rng.normal(size=(3, 8, 5, 3, 4, 0)[q]).tolist()) for q in range(6)] + [(6, None)]
    d = spark.createDataFrame(docs, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked_, "query_id long, embedding array<double>")
    rows = dense.nearest(d, q, 4, max_broadcast_queries=limit).collect()
    want = set()
    for qid, vector in asked_[:4]:
        same = [(i, v) for i, v in docs if v and len(v) == len(vector)]
        ids = [i for i, _ in same]
        want |= {(qid, ids[i]) for _, i in exact(np.array([v for _, v in same]), np.array([vector]), 4)}
    assert {(r.query_id, r.id) for r in rows} == want
    assert sorted(map(tuple, dense.incomparable(d, q).collect())) == [
        (4, "sin_documentos"), (5, "sin_vector"), (6, "sin_vector")]


def test_planes_are_a_stated_table(spark):
    model = dense.LshModel(tables=3, dims=5, bucket_length=0.5)
    rows = {(r.tabla, r.dim): r.coef for r in model.table(spark).collect()}
    raw = [((7919 * 2 * d * d + 104729 * d + 31 * 2) % 2003 - 1001) / 1001 for d in range(1, 6)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert [rows[1, d] for d in range(5)] == pytest.approx([x / norm for x in raw])


def test_lsh_index_holds_no_vectors(clouds):
    d, *_ = clouds
    index = dense.lsh_index(d, dense.lsh_model(d, bucket_length=0.5, tables=8))
    assert index.buckets.columns == ["tabla", "cubeta", "id"]
    assert index.buckets.count() == 8 * 300


def test_lsh_takes_any_number_of_queries(spark):
    docs = spark.range(40).select("id", F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    queries = docs.select(F.col("id").alias("query_id"), "embedding")
    model = dense.lsh_model(docs, bucket_length=0.5, tables=4)
    index = dense.lsh_index(docs, model)
    few = sorted(map(tuple, dense.nearest_lsh(index, queries, model, 3).collect()))
    many = sorted(map(tuple, dense.nearest_lsh(index, queries, model, 3, max_broadcast_queries=5).collect()))
    assert few == many


def test_refreshed_document_replaces_the_old_one(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"))
    docs = corpus(spark, *DOCS)
    indexing.index_new(index, docs, 0, make_stub)
    edited = docs.filter("id = 0").withColumn("texto", F.lit("nuevo")).withColumn("hash_texto", F.lit("h"))
    indexing.index_new(index, edited, 1, make_stub, refresh=True)
    rows = index.read().filter("doc_key = 'noticia_0'").collect()
    assert len(rows) == 1 and "nuevo" in rows[0].document and "Sindicatos" not in rows[0].document
    assert index.read().count() == len(DOCS)


def test_terms_are_counted_over_runs_of_rows(monkeypatch):
    import pyarrow as pa

    from newsloom.functions import terms

    monkeypatch.setattr(terms, "WORDS", 3)
    rows = [["b", "a", "b", "a"], [], None, ["a1", "a", "é", "ab"], ["a"], ["zz", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows, pa.list_(pa.string()))], ["id", "w"])
    got = {i: [(t["term"], t["tf"]) for t in terms_] for part in terms.counted([batch])
           for i, terms_ in zip(part["id"].to_pylist(), part["terminos"].to_pylist())}
    for i, words in enumerate(rows):
        words = words or []
        grams = sorted([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))], key=str.encode)
        assert got[i] == [(g, grams.count(g)) for g in dict.fromkeys(grams)]


ODD_WORDS = [
    None, "", " ", "a", "El Niño, ¿qué año?", "ŒUVRE ﬁn İstanbul", "Hℋ Hotel hℋ", "ΟΔΟΣ'α ΣΑΣ.", "x́y éa",
    "Straße_9 9ª Ŀl ŉ ǆ Ǆ", "uno dos—tres…€5 «cita»", "ⓐⓑ ①② ​x", "日本語 と 한국어 текст", "²³ ½x ´y ¨z",
]


def test_words_are_the_tokens_of_a_text(spark):
    """Cut by Arrow and folded once a word, texts have the words of the expression."""
    import pyarrow as pa

    from newsloom.functions import terms

    alone = [f"x{chr(c)}y Ab{chr(c)} {chr(c)}{chr(c)}" for c in (*range(1, 0x260), *range(0x2000, 0x2100))]
    df = spark.createDataFrame(list(enumerate(ODD_WORDS + alone)), "id int, t string").coalesce(1)
    rows = df.select("id", terms.tokens(F.col("t"), fixed.STOP_WORDS).alias("want"),
                     terms.word_text(F.col("t")).alias("text")).orderBy("id").collect()
    words = terms.Words(pa.array([r.text for r in rows], pa.string()), fixed.STOP_WORDS)
    got = [[] for _ in rows]
    for row, word in zip(words.row, words.dictionary.take(pa.array(words.code)).to_pylist()):
        got[row].append(word)
    assert got == [r.want or [] for r in rows]


def test_terms_leave_a_task_added_up(spark, monkeypatch):
    """One row for each term of a run of texts, not of each document."""
    import pyarrow as pa

    from newsloom.functions import terms

    batch = pa.RecordBatch.from_arrays([pa.array(["gol rojo gol", "gol rojo", None, "rojo"] * 50)], ["palabras"])
    whole = [r for b in terms.totals([])([batch]) for r in b.to_pylist()]
    assert sorted(map(tuple, (r.values() for r in whole))) == [
        ("gol", 150, 100), ("gol rojo", 100, 100), ("rojo", 150, 150), ("rojo gol", 50, 50)]
    monkeypatch.setattr(terms, "TEXT_BYTES", 40)
    parts = [r for b in terms.totals([])([batch]) for r in b.to_pylist()]
    assert len(parts) > 4 and sum(r["cf"] for r in parts) == 450


def test_postings_hold_no_term_beyond_the_vocabulary(spark):
    """What is sent by document are weights of the vocabulary; they equal the joined ones."""
    docs = corpus(spark, *DOCS, ("Única", " ".join(f"rara{i}" for i in range(500))))
    index = lexical.fit(docs, max_features=12)
    plan = index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "pesos" in plan and "terminos" not in plan
    arrays = lexical.term_arrays(
        docs, "id", lexical.corpus_text(F.col("titulo"), F.col("texto")), fixed.STOP_WORDS)
    want = lexical.weigh(lexical.term_counts(arrays, "id"), index.vocab, "id", 12)
    key = lambda r: (r.id, r.term, round(r.peso, 12))
    assert sorted(map(key, index.postings.collect())) == sorted(map(key, want.collect()))


def test_rows_that_share_an_id_stay_one_document(spark):
    docs = corpus(spark, *DOCS)
    twice = docs.unionByName(docs.filter("id < 2")).unionByName(
        docs.filter("id = 3").withColumn("id", F.lit(None).cast("long")))
    queries = asked(spark, "bloqueo carretera", "economía dólar", "gol")
    index = lexical.fit(twice)
    assert index.repeated and lexical.task_hits(index, queries, 5) is None
    norms = index.postings.groupBy("id").agg(F.round(F.sum(F.col("peso") ** 2), 9).alias("n")).collect()
    assert {r.n for r in norms} == {1.0}
    assert not lexical.fit(docs).repeated
    assert lexical.task_hits(lexical.fit(docs), queries, 5) is not None


def test_a_large_vocabulary_stays_a_table(spark, monkeypatch):
    docs, queries = corpus(spark, *DOCS), asked(spark, "bloqueo carretera", "economía dólar")
    want = sorted(map(tuple, lexical.search(lexical.fit(docs), queries).collect()))
    monkeypatch.setattr(lexical, "MAX_BROADCAST_ROWS", 10)
    assert sorted(map(tuple, lexical.search(lexical.fit(docs), queries).collect())) == want
