"""The corpus operators against brute force, exact round trips and held-out accuracy; edge rows for each."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import public_tokenizers
from check_oracles import compare, connect
from lossbook.llm import components, decontam, dedup, html, langid, lm, mixing, neighbours, quality, tokenfile, toxicity, vocab
from lossbook.llm.queries import ORACLES, QUERIES
from lossbook.llm.text import encode_words, split_words
from lossbook.llm.vocab import WordEncoder, gather

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine".split()
LONG = " ".join(random.Random(3).choice(WORDS) for _ in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double"
EDGES = [(1, None, None, None, None, 1, 0.0), (2, "", "en", "a", 0, None, None), (3, "  \n\t ", "en", None, 4, 2, 1.0), (4, LONG, "en", "a", 9, 0, 0.0),
         (5, "one two three", "en", "b", 13, 1, 0.5), (5, "one two three", "en", "b", 13, 1, 0.5), (None, "no id here", "en", "b", 10, 1, 0.5),
         (7, "one two three", "de", "b", 13, 1, 0.5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ------------------------------------------------------------------ registration

def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(QUERIES)


@needs_tables
def test_dedup_equals_sql(spark):
    assert compare(QUERIES["op10_setsketch_dedup"](spark, SF), connect(SF), ORACLES["op10_setsketch_dedup"]) == ""


# ------------------------------------------------------------------ 10: near duplicates

def jaccard_groups(rows, percent=85):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for g in range(12):                               # chains and stars of near copies around the similarity
        base = [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(120)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            rows.append((rng.randint(0, 10**9), " ".join(w)))
    rows = list({i: (i, t) for i, t in rows}.values())
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_groups(rows)


def test_near_duplicates_edge_rows(edges, nothing):
    got = dedup.near_duplicates(edges).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGES) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept
    assert by[5].n_shingles == 1 and by[7].component_id == 5 and not by[7].kept and by[None].kept
    assert dedup.near_duplicates(nothing).count() == 0
    assert sorted(str(r.doc_id) for r in dedup.keep_one(edges).collect()) == ["1", "2", "3", "4", "5", "None"]


def test_pipeline_joins_documents_four_fifths_alike(spark):
    import corpus_pipeline
    base = [f"w{i}" for i in range(104)]                                     # 100 shingles, 5 changed by a word
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "x", *base[51:80], "y", *base[81:]])), (3, "quite another text with words of its own")]
    assert jaccard_groups(rows, 85) != jaccard_groups(rows, 80) == {1: 1, 2: 1, 3: 3}
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    s = dedup.sketch([a, b, np.union1d(a, b)], 2000)
    assert (dedup.merge(s[0], s[1]) == s[2]).all()
    more, less = (s[0] > s[1]).sum(), (s[0] < s[1]).sum()
    grid = np.linspace(0, 1, 201)
    one = lambda x: np.full(len(grid), float(x))
    best = grid[np.argmax(dedup.log_likelihood(grid, one(len(a)), one(len(b)), one(more), one(less), one(2000 - more - less)))]
    assert abs(best - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# ------------------------------------------------------------------ 4: decontamination

def test_tiles_of_reordered_passages():
    doc, item = np.array([1, 2, 3, 4, 9, 5, 6, 7, 8], np.uint64), np.array([5, 6, 7, 8, 1, 2, 3, 4], np.uint64)
    assert decontam.tiles(doc, item, 4) == [(0, 4, 4), (5, 0, 4)] and decontam.tiles(doc, item, 5) == []


def test_leaks_are_found_whole_and_reordered(spark):
    item = "the quick brown fox jumps over the lazy dog while seven grey geese fly south"
    docs = [(1, f"{LONG} {item.upper()}, {LONG}"), (2, "while seven grey geese fly south -- the quick brown fox jumps over the lazy dog"),
            (3, "the quick brown fox likes tea"), (4, None), (5, "")]
    bench = spark.createDataFrame([(10, item, 1), (11, None, 2), (12, "the quick", 3)], "item_id long, text string, doc_id int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(table, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (1, 12), (2, 12), (3, 12)} and got[1, 10].coverage == 1.0 and got[2, 10].tiles == 2
    assert sorted(r.doc_id for r in decontam.clean(table, bench).collect()) == [3, 4, 5]
    assert decontam.contaminated(table, bench.limit(0)).count() == 0


def test_decontamination_edge_rows(edges, nothing, spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert decontam.clean(edges, bench).count() == len(EDGES) and decontam.clean(nothing, bench).count() == 0


# ------------------------------------------------------------------ 9: mixing

def targets_by_hand(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_comes_near_its_targets(spark):
    rng, rows = random.Random(4), []
    for i in range(3000):
        rows.append((i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a"] * 6 + ["b", "c", None, "d"]) if i > 5 else "tiny"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    sizes = {None if s != s or s is None else s: int(g["size"].sum()) for s, g in got.groupby("source", dropna=False)}
    want = targets_by_hand(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s] and abs(g.taken.sum() - want[s]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mixed_rows(docs).groupBy("doc_id").count().agg(F.sum("count")).first()[0] == got.copies.sum()


def test_mix_edge_rows(edges, nothing):
    got = {(r.doc_id, r.source): r for r in mixing.mix(edges).collect()}
    assert got[1, None].size == 0 and got[1, None].taken == 0 and got[4, "a"].size == 30_000
    assert mixing.mix(edges).count() == len(EDGES) and mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).columns == nothing.columns


# ------------------------------------------------------------------ 3: token files

def test_words_encode_like_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbZz09.,'!<|>-é́ßİΣσς \t\n 　中😀$%st") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ends, flat = split_words(pa.array(texts))
    index, distinct = encode_words(flat)
    lengths, ids = WordEncoder(path)(distinct)
    run = np.concatenate([[0], np.cumsum(lengths[index])])[ends]
    out = gather(lengths, ids, index)
    for i, t in enumerate(texts):
        assert whole.encode(t, add_special_tokens=False).ids == out[run[i]:run[i + 1]].tolist()


def test_words_are_encoded_in_blocks_and_remembered(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole, real, calls = Tokenizer.from_file(path), vocab.tokenizer(path), []

    class Counted:
        def encode_batch_fast(self, words, **kw):
            calls.append(list(words))
            return real.encode_batch_fast(words, **kw)

    monkeypatch.setattr(vocab, "tokenizer", lambda _: Counted())
    monkeypatch.setattr(vocab, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(vocab, "KNOWN_WORDS", 40)
    encoder, rng = WordEncoder(path), random.Random(8)
    words = [f"wort{i}" for i in range(30)] + ["é!", "...", "x'll", "Z"]
    for _ in range(6):
        some = rng.sample(words, 25) + [f"once{rng.random()}", ""]
        lengths, ids = encoder(pa.array(some))
        assert np.split(ids, np.cumsum(lengths)[:-1])[0].tolist() == whole.encode(some[0], add_special_tokens=False).ids
        assert ids.tolist() == [x for w in some for x in whole.encode(w, add_special_tokens=False).ids]
    asked = [w for block in calls for w in block]
    assert max(map(len, calls)) <= 7 and len(asked) == len(set(asked))


def test_words_of_letters_are_encoded_together(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole, real, texts = Tokenizer.from_file(path), vocab.tokenizer(path), []

    class Counted:
        def encode_batch_fast(self, words, **kw):
            texts.extend(words)
            return real.encode_batch_fast(words, **kw)

    monkeypatch.setattr(vocab, "tokenizer", lambda _: Counted())
    rng = random.Random(6)
    same = lambda words: [x for w in words for x in whole.encode(w, add_special_tokens=False).ids] == WordEncoder(path)(pa.array(words, pa.string()))[1].tolist()
    assert same(["".join(rng.choice("abcdefÉñßж") for _ in range(1 + i % 9)) + rng.choice(["", ".", "!!", "$$$"]) for i in range(900)])
    assert len(texts) < 20
    signs = [*"aBéİŉſΣς'.,!-<|>/_09²五中한ा́ﬁª💡ŁЖ", "e\u0301", "'s", "'re", "</w>", "<|endoftext|>"]
    assert same(["".join(rng.choice(signs) for _ in range(1 + i % 7)) for i in range(3000)])
    assert same(["abc", "aİb", "def"]) and same([])                                  # a word of letters that is several pieces


def test_token_files_round_trip(edges, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    whole, at = Tokenizer.from_file(path), 0
    got = sorted(tokenfile.round_trip(edges, path).collect(), key=lambda r: r.start)
    for (doc, text, *_), r in zip(sorted(EDGES, key=lambda x: -1 if x[0] is None else x[0]), got):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.round_trip(nothing, path).count() == 0


# ------------------------------------------------------------------ 1, 8: classifiers

def marked_docs(spark, n=400):
    rng, docs, labels = random.Random(6), [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        low, toxic = rng.random() < 0.3, rng.random() < 0.25
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilething", "vileword"]))
        text = "!! ".join(w.upper() for w in words) if low else ". ".join(words) + "."
        docs.append((i, text))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), labels_of(spark, labels), {x[0]: x for x in labels}


def test_classifiers_on_held_out_documents(spark):
    docs, labels, truth = marked_docs(spark)
    q = [r for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.held_out]
    assert len(q) > 40 and np.mean([r.predicted == truth[r.doc_id][1] for r in q]) > 0.97
    t = [r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in t]) > 0.97
    assert all("vile" in s.text.lower() for r in t for s in r.sentences)


def test_classifier_edge_rows(edges, nothing, spark):
    labels = labels_of(spark, [(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)])
    for module in (quality, toxicity):
        for model in (module.fit(edges, labels), module.fit(nothing, labels), module.fit(edges, labels.limit(0))):
            got = module.score(edges, model).collect()
            assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
            assert module.score(nothing, model).count() == 0
    assert quality.accepted(edges, quality.fit(edges, labels)).columns == edges.columns


def test_dual_coordinate_descent_separates():
    w, b = quality.dual_coordinate_descent(np.array([0, 1, 2, 3, 4]), np.array([0, 1, 0, 1]), np.ones(4), np.array([1.0, -1, 1, -1]), 2)
    assert w[0] + b > 0.9 and w[1] + b < -0.9


# ------------------------------------------------------------------ 5: languages

def test_languages_and_mixtures(spark):
    rng = random.Random(7)
    make = {"en": "the of and thing", "fr": "les oui être ça", "nl": "het een vijf zijn"}
    text = lambda lang, n: " ".join(rng.choice(make[lang].split()) + rng.choice(make[lang].split()) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(list(make) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None), (1003, text("en", 60) + " " + text("fr", 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:180]) and model.langs == ["en", "fr", "nl"]
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "en" and {x.lang for x in got[1003].languages} == {"en", "fr"}


def test_language_edge_rows(edges, nothing):
    assert langid.predict(edges, langid.fit(nothing)).filter("lang_pred = 'und' and score = 0").count() == len(EDGES)
    assert langid.predict(edges, langid.fit(edges)).count() == len(EDGES) and langid.predict(nothing, langid.fit(edges)).count() == 0


def test_a_document_may_have_all_languages():
    words = ["abcabcabc", "defdefdef", "ghighighi", "jkljkljkl", "mnomnomno", "pqrpqrpqr"]
    prob = np.full((1 << langid.BITS, len(words)), 1e-7)
    for k, w in enumerate(words):
        prob[langid.trigrams(pa.array([w]))[1], k] = 0.1
    share = langid.infer(pa.array([" ".join(words * 40)]), langid.Model([f"l{k}" for k in range(len(words))], prob))[0]
    assert (share > 0.1).all()


# ------------------------------------------------------------------ 6: neighbours

def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = np.concatenate([centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24)), np.tile(centres[0], (40, 1))])
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(5000, None, 1.0), (5100, [0.0] * 24, 1.0), (5200, [float("nan")] * 24, 1.0), (5300, [None] * 24, 1.0), (5400, [1.0, 2.0], 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = neighbours.search(table, table.filter("vec_id % 100 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), far))[:10].tolist()) & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, far[g.sort_values("rank").vec_id]) and q < 5000
    assert hits / len(got) > 0.9
    copies = neighbours.search(table, table.filter("vec_id = 3039")).toPandas().sort_values("rank")
    assert copies.vec_id.tolist() == list(range(3000, 3010)) and (copies.score == 0).all()
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0


def test_forest_recall_with_mixed_lengths():
    rng = np.random.default_rng(4)
    way = rng.normal(size=(40, 16))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    length = np.repeat([0.3, 1.0, 1.0, 1.0, 12.0], 400)
    x = way[rng.integers(0, 40, 2000)] * length[:, None] + 0.5 * length[:, None] * rng.normal(size=(2000, 16)) / 4
    forest, ids = neighbours.Forest(x, np.zeros(16), neighbours.ForestPlan()), np.arange(2000)
    hits = {}
    for q in range(0, 2000, 20):
        at, _ = forest.nearest(x[q], forest.hash(x[q:q + 1])[:, 0], ids == q, ids, 10)
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        hits.setdefault(length[q], []).append(len(set(at) & set(np.argsort(far)[:10])) / 10)
    assert min(np.mean(h) for h in hits.values()) > 0.9, {k: np.mean(h) for k, h in hits.items()}


# ------------------------------------------------------------------ 7: pages

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"),
    ("<html><body><nav><a href=x>Menu one</a></nav><div class='ad'>Buy this now</div><article><h1>T &amp; U</h1><p>First  <b>bold\n part</b>.<br>"
     "<p>Second &lt;p&gt; part is here.</article><footer>Foot</footer><script>var a='</p>';</script></body></html>",
     "T & U\nFirst bold part .\nSecond <p> part is here.".replace("part .", "part.")),
    ("<body><div id=main><p>Long text of the page itself, and more of it.<p>Another part of the text.</div><div class='comments'><p>Nice page, very long "
     "comment that goes on and on and on and on.</div><form>Name <input></form></body>",
     "Long text of the page itself, and more of it.\nAnother part of the text."),
    ("<body><article><ul><li>one thing<li>two things</ul><!-- hidden --><p>unclosed <i>words", "one thing\ntwo things\nunclosed words")])
def test_main_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "layout-with-aside", "page no-comments", "share-price", "side-by-side", "overflow hidden", "sidebar"])
def test_wrappers_of_the_text_count(name):
    text = "Long text of the page itself, and more of it.\nAnother part of the text, as long as the first one."
    paragraphs = "".join(f"<p>{t}</p>" for t in text.split("\n"))
    assert html.extract(f"<body><div class='{name}'>{paragraphs}<div class='sidebar-left'>Read more</div></div><div class='ad-top'>Buy this</div></body>") == text
    if name in ("share-price", "side-by-side"):       # also where they hold less than half of it
        assert html.extract(f"<body><article><p>{text[:45]}</p><div class='{name}'><p>More text of it.</p></div></article></body>").endswith("More text of it.")


def test_pages_edge_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", f"<p>{LONG}</p>", "x"), (3, "u", f"<p>{LONG}</p>", "x"), (None, "u", "<p>a b", "x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 0, len(LONG), len(LONG), 3])


# ------------------------------------------------------------------ 2: language model

def test_gradients_are_right():
    rng = np.random.default_rng(9)
    model = lm.Attention.start(np.full(lm.CODES, 1 / lm.CODES))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, lm.CODES, (2, lm.WINDOW)), rng.integers(0, lm.CODES, (2, lm.STRIDE))
    use = rng.random(y.shape) < 0.8
    _, g = model.gradients(x, y, use)
    n = lm.CODES // lm.CLASSES
    for k, p in model.p.items():
        at = {"emb": (x[0, 10], 3), "ww": (y[use][0] // n, 2, y[use][0] % n), "bw": (y[use][0] // n, y[use][0] % n)}.get(k) or tuple(s // 2 for s in p.shape)
        p[at] += 0.01                                 # losses are sums of single-precision terms
        up, _ = model.gradients(x, y, use)
        p[at] -= 0.02
        down, _ = model.gradients(x, y, use)
        p[at] += 0.01
        assert abs((up - down) / 0.02 - g[k][at]) < 2e-5 + 0.05 * abs(g[k][at]), k


def test_next_code_is_a_distribution_and_windows_cover_once():
    model = lm.Attention.start(np.full(lm.CODES, 1 / lm.CODES))
    x = np.random.default_rng(1).integers(0, lm.CODES, (1, lm.WINDOW))
    total = sum(model.prob(x, np.full((1, lm.STRIDE), c)) for c in range(lm.CODES))
    assert np.allclose(total, 1, atol=1e-3)
    codes, ends = np.arange(1, 131), np.array([0, 1, 1, 60, 130])
    _, y, use, doc = lm.windows(codes, ends)
    assert sorted(y[use].tolist()) == codes.tolist() and (doc == np.repeat([0, 2, 3], [1, 3, 3])).all()


@needs_tables
def test_scores_and_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(
        [(10**6, None), (10**6 + 1, ""), (None, "no id"), (10**6 + 2, "a"), (10**6 + 2, "a")], "doc_id long, text string"))
    got = lm.score(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    rows = [(r.doc_id, [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low(r.text or ""))]) for r in docs.collect()]
    count, n = {}, 0
    for i, w in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for t in [*w, None]:
                count[t] = count.get(t, 0) + 1
                n += 1
    want = sorted((str(i), len(w) + 1, sum(count.get(t, 0) > 0 for t in [*w, None]),
                   round(sum(np.log10((count.get(t, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for t in [*w, None]), 6)) for i, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    print("held out:", sum(r.score for r in held), sum(r.base_score for r in held))
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.1


def test_all_training_documents_are_learned(spark):
    rows = [(b, 10 * b + i, 0, [2 + 4 * b, 3 + 4 * b, 5 + 4 * b] * 80 + [lm.END], 241, 0.0) for b in range(3) for i in range(4)]
    coded = spark.createDataFrame(rows, "batch long, doc_id long, turn int, codes array<short>, n_tokens long, base_score double")
    pairs, n = lm._pairs(coded)
    assert n == 12 * 11 and pairs.sum() == 12 * 241 and pairs[lm.END, 2] == 4 and pairs[5, 2] == 4 * 79 and pairs[5, lm.END] == 4 and pairs[3, 2] == 0
    start = lm.Attention.start(np.full(lm.CODES, 1 / lm.CODES))
    learned = lm._round(coded, start, 100, (0.0, 0.5))
    again = lm._round(coded.repartition(5), start, 100, (0.0, 0.5))
    assert all((learned.p[k] == again.p[k]).all() for k in learned.p)
    for b in range(3):                                # each batch left its mark on the mean
        x, y, use, _ = lm.windows(np.array(rows[4 * b][3]), np.array([0, 241]))
        assert np.log(learned.prob(x, y)[use]).mean() > np.log(start.prob(x, y)[use]).mean() + 0.5


def test_training_has_no_most_steps(monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Attention, "gradients", lambda self, x, y, use: (seen.append(int(use.sum())), (0.0, {}))[1])
    lm.train(lm.Attention.start(np.full(lm.CODES, 1 / lm.CODES)), np.full(24 * 230_000, 2), np.array([0, 24 * 230_000]))
    assert sum(seen) == 24 * 230_000


def test_passes_do_not_fall_with_the_corpus(spark, monkeypatch):
    coded = spark.createDataFrame([(b, b, b % 3, [2, 3, lm.END], 3, 0.0) for b in range(6)], "batch long, doc_id long, turn int, codes array<short>, n_tokens long, base_score double")
    seen, real = [], lm._pairs
    monkeypatch.setattr(lm, "_round", lambda part, model, passes, span: seen.append((part.count(), passes)) or model)
    for windows in (6, 10**9):
        monkeypatch.setattr(lm, "_pairs", lambda docs: (real(docs)[0], windows))
        lm.fit(coded, np.ones(lm.CODES), 6, 2)
    assert seen == [(2, 10)] * 6


def test_scores_of_nothing(nothing):
    assert lm.score(nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ------------------------------------------------------------------ pipeline

@needs_tables
def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
