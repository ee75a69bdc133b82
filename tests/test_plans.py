"""What the physical plans must and must not contain."""

import os
import re

import pytest

import __spark_entry__ as entry
from newsloom import schemas
from newsloom.operators import lexical, versions
from newsloom.session import scratch, work_dir
from newsloom.sources import testviews as tv
from newsloom.sources.store import ArticleStore, LexicalTables
from newsloom.sources.tables import kept

SF_DIR = "/root/testdata/sf0.001"
LAZY = sorted(n for n in entry.queries()
              if n != "ingest_job" and not n.startswith(("stream_", "op", "pipeline")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_row_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["timeline", "by_source", "feed_groups", "url_list", "date_window"])
def test_counts_do_not_read_bodies(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert scans and not any("text#" in s for s in scans)


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["dense_topk"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(entry.queries()["filter_feed"](spark, SF_DIR))


def executed(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_texts_are_tokenised_once(spark):
    """Vocabulary, weights and scores share one scan of the bodies."""
    index = lexical.fit(tv.articles(spark, SF_DIR))
    hits = lexical.search(index, tv.query_texts(spark, SF_DIR))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", executed(hits))
    assert len([s for s in scans if "doc_id" in s and "text#" in s]) == 1


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", text)


def test_pairs_cross_no_shuffle_before_they_are_cut(spark, tmp_path):
    """Between the documents' terms and the first k rows a query, nothing is sent by pair."""
    docs, queries = tv.articles(spark, SF_DIR), tv.query_texts(spark, SF_DIR)
    fresh = executed(lexical.top_k(lexical.scores(lexical.fit(docs), queries), 5))
    assert not any("query_id" in e and re.search(r"\bid#", e) for e in exchanges(fresh))
    assert fresh.count("WindowGroupLimit") >= 2
    tables = LexicalTables(spark, str(tmp_path / "lex"))
    tables.refit(docs, "v1")
    stored = executed(lexical.top_k(lexical.task_hits(tables.load("v1"), queries, 5), 5))
    assert [e.split("#")[0] for e in exchanges(stored)] == ["query_id"]
    assert "MapInArrow" in stored


def test_bodies_are_hashed_once(spark):
    """Stored and arriving versions are laid out from one scan of each body."""
    text = executed(versions.ordered(tv.articles(spark, SF_DIR), tv.incoming(spark, SF_DIR)))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len([s for s in scans if "html#" in s]) == 1


def test_point_reads_list_one_bucket(spark, tmp_path):
    rows = [(f"u{i % 50}", f"t{i}", f"b{i}", "s", None, i) for i in range(200)]
    store = ArticleStore(spark, str(tmp_path / "store"), buckets=16)
    store.apply(spark.createDataFrame(rows, schemas.INCOMING), 0, "2026-05-20 10:00:00")
    article, history = store.article("u7"), store.history_of("u7")
    assert [r.texto for r in article.collect()] == ["b157"]
    assert sorted(r.texto_anterior for r in history.collect()) == ["b107", "b57", "b7"]
    # One bucket of heads and bodies, and the url reaches both scans.
    folders = {re.sub(r"/[^/]*$", "", f.split("/store/")[1]) for f in article.inputFiles()}
    assert len(folders) == 2 and len({f.split("bucket=")[1] for f in folders}) == 1
    scans = [line for line in plan(article).splitlines() if "FileScan" in line]
    assert len(scans) >= 2 and all("EqualTo(url,u7)" in line for line in scans)
    text = plan(history)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text) and "PushedFilters: [IsNotNull(url), EqualTo(url,u7)]" in text
    assert store.article("nothing").count() == store.history_of("nothing").count() == 0


def test_intermediate_tables_go_with_their_block(spark):
    target = work_dir(spark, "result")
    with scratch(spark, "outer") as outer:
        step = kept(spark.range(5), "step")
        with scratch(spark, "inner") as inner:
            assert inner.startswith(outer)
            kept(step, "more").write.parquet(target)
            assert len(os.listdir(inner)) == 1
        assert os.path.exists(outer) and not os.path.exists(inner)
        assert step.count() == 5
    assert not os.path.exists(outer) and spark.read.parquet(target).count() == 5
    assert not work_dir(spark, "after").startswith(outer)
    with pytest.raises(ZeroDivisionError), scratch(spark, "failed") as failed:
        kept(spark.range(1), "step")
        1 / 0
    assert not os.path.exists(failed)
