"""Ranked search, exact inner products and collocations against brute force, with tiny blocks and budgets; edge rows."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from check_oracles import compare, connect
from lossbook.llm import lexical, phrases, pivots, slots
from lossbook.llm.queries import ORACLES, QUERIES
from lossbook.llm.text import byte_table, cut

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@needs_tables
@pytest.mark.parametrize("name", ["op11_nra_search", "op12_pivot_search", "op13_era_phrases"])
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


# ------------------------------------------------------------------ words and slots

def test_cut_equals_regular_expressions():
    rng, table = random.Random(1), byte_table(b" \t", b".,;:!?\n\x0b\x0c\r")
    for _ in range(500):
        texts = ["".join(rng.choice("aB é.\n\t,zñ🙂\x00") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        ends, words, piece = cut(pa.array(["x", *texts, "y"]).slice(1, len(texts)).cast(pa.string()), table)
        words = words.to_pylist()
        pieces = [[re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))] for t in texts]
        assert [words[a:b] for a, b in zip(ends[:-1], ends[1:])] == [[w for p in ps for w in p] for ps in pieces]
        runs = [[w for w, q in zip(words, piece) if q == n] for n in dict.fromkeys(piece.tolist())]
        assert runs == [p for ps in pieces for p in ps if p]


def test_slot_table_holds_the_highest_level(spark):
    rows = [("en", "a", 1), ("en", "a", 2), ("de", "a", 1), ("en", "ñ", 1)]
    table = slots.slot_table(spark.createDataFrame(rows, "group string, word string, level int"))
    at = lambda group, word: table[slots.places(pa.array([word]), slots.seed_of(group))[0]]      # noqa: E731
    assert (at("en", "a"), at("de", "a"), at("en", "ñ"), at("de", "ñ")) == (2, 1, 1, 0) and len(table) == slots.SLOTS
    assert not slots.slot_table(spark.createDataFrame([], "group string, word string, level int")).any()


# ------------------------------------------------------------------ 11: ranked search

def ranked(documents, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))       # noqa: E731
    docs = [(d, Counter(words(t))) for d, t in documents]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, every = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, size in docs:
            m = 50 + 50 * size * n // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if e else d, -s) for r, (s, e, d) in enumerate(sorted(found)[:k])]
    return out


def zipf_text(rng, vocabulary, size):
    return " ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, len(vocabulary) - 1)] for _ in range(size))


@pytest.mark.parametrize("postings,terms", [(10**6, 10**6), (300, 40), (25, 5)])
def test_rank_equals_brute_force(spark, postings, terms):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["Ñandú", "x_y", "O'Neil"]
    docs = [(i, zipf_text(rng, vocabulary, rng.randint(0, 30))) for i in range(150)]
    docs += docs[:40] + [(None, "w1 w2 w1"), (None, "w1 w2 w1"), (500, None), (501, ""), (502, " .,- "), (503, "w0 " * 5000)]
    items = [(i, zipf_text(rng, vocabulary, 12)) for i in range(12)] + [(3, "w70 w71"), (20, "absent"), (21, None), (22, ""), (None, "w3 w4")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS salt", "2 AS n", "'x' AS terms", "0 AS block"),
                       spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS w", "'y' AS term", "0 AS least"),
                       lexical.SearchPlan(7, postings, terms))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])                                              # noqa: E731
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(docs, items, 7), key=key)


def test_rank_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(docs, items).collect() == []
    assert lexical.rank(items.selectExpr("item_id AS doc_id", "text"), docs.selectExpr("doc_id AS item_id", "text")).collect() == []
    assert lexical.rank(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []


def test_a_read_stops_before_the_end_of_the_lists():
    """One rare term decides: the long list of the frequent one need not be read through for membership."""
    n = 5_000
    terms = pa.array(["rare often"] * 10 + ["often"] * (n - 10))
    counts = pa.array([np.array([1, 50], "<u4").tobytes()] * 10 + [np.array([1 + i % 40], "<u4").tobytes() for i in range(n - 10)])
    block = lexical.Block(pa.array(range(n)), np.full(n, 60), terms, counts, n, 60 * n)
    at, score = block.best(["often", "rare"], [1, 9000], 5, 0)
    assert sorted(at.tolist()) == [0, 1, 2, 3, 4] and len(set(score.tolist())) == 1
    assert block.best(["often", "rare"], [1, 9000], 5, int(score[0]) + 1)[0].tolist() == []


# ------------------------------------------------------------------ 12: inner products

def products(rows, queries, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in queries:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-max(min(sum(a * b for a, b in zip(v, c)), 2**63 - 1), -2**63), i is None, i or 0) for i, c in whole if i != q and len(c) == len(v))
        out += [(q, r + 1, None if e else i, -s) for r, (s, e, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("block,queries", [(10**6, 10**6), (40, 9)])
def test_inner_products_equal_brute_force(spark, block, queries):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 30])]) for i in range(220)]
    rows += rows[:30] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, [0.0] * 6),
                         (305, [1.0, 2.0]), (306, [3.0, -1.0]), (None, [0.5] * 6), (None, [0.5] * 6), (10, [9.0] * 6), (307, []), (350, [1e-9] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS dim", "0 AS far", "'x' AS label", "0 AS block")
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0] + [(305, [1.0, 2.0]), (307, [])]
    got = pivots.search(frame, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), pivots.PivotPlan(4, 8, 50, block, queries))
    assert sorted(map(tuple, got.collect())) == sorted(products(rows, asked, 4))


def test_products_beyond_64_bits_are_held(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0, 3.0]), (4, [1e9, 1e9]), (5, [3e9, -1e9])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in pivots.search(frame, frame, pivots.PivotPlan(5)).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -2**63 and got[3, 4] == 256 * 256 * 5 * 10**9 and got[5, 4] == 2**63 - 1


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.search(none, none).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert pivots.search(one, one).collect() == [] and pivots.search(one, none).collect() == []


def test_pivots_leave_out_candidates():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (20, 8))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, (4000, 8))).astype(np.int64)
    longest = float(np.sqrt((vectors**2).sum(1)).max())
    points = pivots.far_apart(vectors[:500].astype(float), 16)
    lift = lambda x: np.sqrt(np.maximum(longest**2 - (x * x).sum(-1), 0))                        # noqa: E731
    far = np.sqrt(((vectors[:, None] - points[None]) ** 2).sum(2) + (lift(vectors)[:, None] - lift(points)[None]) ** 2)
    table = pivots.Table(pa.array(range(4000)), vectors, far, longest)
    q = vectors[7]
    qfar = np.sqrt(((points - q) ** 2).sum(1) + lift(points) ** 2)
    at, score, evaluated = table.best(7, q, qfar, 5, None)
    want = sorted((-int(s), i) for i, s in enumerate(vectors @ q) if i != 7)[:5]
    assert [(-int(s), int(a)) for a, s in zip(at, score)] == want and evaluated < 2000


# ------------------------------------------------------------------ 13: collocations

def collocated(rows, plan):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, plan.longest + 1):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        able = {p: a for p, a in count.items() if len(p) > 1 and a >= plan.least}
        best = []
        for p, a in able.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= plan.cover * a for q, b in able.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:plan.first])]
    return out


@pytest.mark.parametrize("budget", [10**6, 300, 40])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_brute_force(spark, budget, longest):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "Königs", "ñ", "a\x01b", "x!", "|", "-"] + [f"v{i}" for i in range(25)]
    rows = []
    for i in range(120):
        text = "".join(zipf_text(rng, vocabulary, rng.randint(1, 9)) + rng.choice([". ", "\n", " ; ", ",", "\t", "\r\n"]) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", "in the house of the rising sun", "of the", "the the the the"])))
    rows += [("en", None), ("fr", ""), ("fr", " .,"), (None, "of the " * 400), ("en", "\n".join(["alpha beta gamma delta"] * 30))]
    plan = phrases.PhrasePlan(longest=longest, least=4, first=25, budget=budget)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS f", "3 AS n", "4 AS words"), plan)
    assert sorted(map(tuple, got.collect())) == sorted(collocated(rows, plan))


def test_no_collocations(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "one two")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    """The product of counts is exact in decimals where 64 bits would overflow."""
    a, l, r = 3 * 10**9, 4 * 10**9, 5 * 10**9
    row = spark.sql(f"SELECT CAST((1000000BD * CAST({a}L AS decimal(19,0)) * CAST({a}L AS decimal(19,0))) div (CAST({l}L AS decimal(19,0)) * CAST({r}L AS decimal(19,0))) AS long) AS s")
    assert row.first().s == 10**6 * a * a // (l * r)
