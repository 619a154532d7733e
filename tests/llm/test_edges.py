"""Rows that repeat, lack an id or carry names the operators use themselves; short items; signs that are no letters."""

import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lossbook.llm import decontam, dedup, html, langid, mixing

ITEM = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch"
CLEAN = "nutmeg oak pine quince rowan spruce tamarack upas vine willow yew zelkova"
NAMES = ["_id", "_print", "_number", "_copies", "_time", "_kept", "leak", "kept", "place", "print", "number", "id", "same", "nth", "times", "time",
         "part", "whole", "before", "of", "in", "at", "n", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, f"x {ITEM} y", "s"), (None, ITEM, "s"), (None, CLEAN, "s"), (None, None, "s"), (7, CLEAN, "s"), (7, f"{ITEM} z", "s"), (8, "", None), (9, "some words only", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")


def test_clean_rows_stay_whatever_their_id(docs, items):
    got = decontam.clean(docs, items)
    assert got.columns == docs.columns and {r._id for r in got.collect()} == {"own _id"}
    key = lambda r: (r.doc_id or 0, r.text or "", r.text is None)                                  # noqa: E731
    assert sorted(map(key, got.collect())) == sorted([(0, CLEAN, False), (0, "", True), (7, CLEAN, False), (8, "", False), (9, "some words only", False)])


def test_without_items_all_rows_stay(spark, docs):
    assert decontam.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_blocks_of_items_one_after_the_other(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    more = items.unionByName(items.sparkSession.createDataFrame([(4, CLEAN), (5, "absent words of an item")], items.schema))
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, more).collect())
    assert got == [(0, 1), (0, 1), (0, 4), (7, 1), (7, 4)]


def test_items_shorter_than_a_tile(spark):
    texts = ["where Zyzzyva lives", "zyzzyva", "zy zzyva", "blue moon rising", "moon blue", "moon", "学校的问题是什么", "问题学校"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "Zyzzyva"), (2, "blue moon"), (3, "问题是什么"), (4, "学校")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.contaminated(docs, items).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (3, 2): 1.0, (6, 3): 1.0, (6, 4): 1.0, (7, 4): 1.0}


def test_all_stages_keep_columns_of_any_name(docs):
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 7").count() == 1 and kept.filter("doc_id is null").count() == 4
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {r["in"] for r in mixed.collect()} <= {"own in"}


def test_repeated_rows_in_many_partitions(spark):
    """Equal rows without id are counted over all partitions, none twice and none left out."""
    same = spark.range(900, numPartitions=9).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    rows = same.withColumn("print", F.xxhash64("text"))
    numbers = Counter(r.number for r in mixing._numbered(rows, "print", "number").collect())
    assert numbers == Counter(range(1, 901))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("four five six seven").alias("text"), F.lit("t").alias("source"))
    docs = same.unionByName(other)
    plan = mixing.mix(docs)
    assert plan.count() == 950
    taken = plan.groupBy("source").agg(F.sum("copies").alias("n"), F.sum("taken").alias("w"), F.max("target").alias("t")).collect()
    assert all(abs(r.w - r.t) <= 4 for r in taken)
    got = {r.source: r["count"] for r in mixing.mixed_rows(docs).groupBy("source").count().collect()}
    assert got == {r.source: r.n for r in taken if r.n}


def test_signs_beyond_the_first_plane(spark):
    docs = spark.createDataFrame([(i, "the water and the house of the sea", "en") for i in range(1, 40)]
                                 + [(i, "das Wasser und das Haus und der See", "de") for i in range(40, 80)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "😀😀 🎉"), (2, "𝟏𝟐𝟑 𝟒"), (3, "123 !?"), (4, None), (5, "the house 😀")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4 and got[5][0] == "en"
    doc, _ = langid.trigrams(pa.array(["𐐷𐐲𐑌", "😀"]))                                            # letters of the second plane are letters
    assert set(doc.tolist()) == {0}


# ------------------------------------------------------------------ 7: pages

PARAGRAPHS = "".join(f"<p>{'The river rose in the night and the town woke to water in the streets. ' * 4}</p>" for _ in range(4))
WHOLE = "\n".join(["The river rose in the night and the town woke to water in the streets. " * 4] * 4).replace(" \n", "\n").strip()


@pytest.mark.parametrize("page", [
    f"<body><form action='/x'><div>{PARAGRAPHS}</div></form></body>", f"<body><div class='ad-free'>{PARAGRAPHS}</div></body>",
    f"<body><div class='newsletter-issue'>{PARAGRAPHS}</div></body>", f"<body><div class=comment-policy>{PARAGRAPHS}</div></body>",
    f"<body><div title=it's>{PARAGRAPHS}</div></body>", f"<body><fieldset>{PARAGRAPHS}</fieldset><form>Search <input name=q></form></body>",
    f"<body><article>{PARAGRAPHS}</article><div id='comments'>{PARAGRAPHS * 3}</div><div class='ad-top'>Buy this</div></body>"])
def test_wrappers_do_not_lose_the_article(page):
    assert html.extract(page) == WHOLE


def test_parts_of_an_article_stay():
    got = html.extract(f"<body><article>{PARAGRAPHS}<div class='related-work'><p>Other work showed that floods come earlier.</p></div>"
                       "<div class='related-links'><a href=x>Floods of other towns</a> <a href=y>Rain</a></div><p>so <math><mi>x</mi><mo>=</mo><mn>3</mn></math> "
                       "holds</p><xmp><b>&amp;</xmp></article></body>").split("\n")
    assert got[4:] == ["Other work showed that floods come earlier.", "so x=3 holds", "<b>&amp;"]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text of it " * 20 + "</div>" * 100_000, "<a title=\"x" * 100_000, "<p title='x\" >word " * 100_000,
                                  "</x>" * 100_000 + "<b>" * 100_000 + "word", "<" * 200_000, "<p a='" * 50_000 + "<p b=\"" * 50_000])
def test_time_grows_with_the_page(page):
    start = time.monotonic()
    html.extract(f"<body>{page}")
    assert time.monotonic() - start < 10
