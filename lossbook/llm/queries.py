"""The corpus operators as queries over whole tables, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lossbook.llm import decontam, dedup, html, langid, lexical, lm, mixing, neighbours, phrases, pivots, quality, tokenfile, toxicity
from lossbook.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op10_setsketch_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: list_aggregate(ws[i:i+4], 'string_agg', ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.root AS component_id, w.doc_id = k.root AS kept
FROM w JOIN k ON k.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op9_pivotal_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to target weights by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query("op4_string_tiling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked benchmark items of all documents."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, and read back."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op1_nbsvm_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@_query("op5_mixture_langid")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).drop("languages")


@_query("op7_text_density")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


@_query("op8_mil_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query("op6_prefix_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"))


@_query("op2_attention_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and base scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op11_nra_search", r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nd),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN p USING (term), g GROUP BY 1, 2, 3),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op12_pivot_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_dot_product(q.e, c.e), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return pivots.search(vectors, vectors.filter("vec_id % 50 = 0"))


@_query("op13_era_phrases", r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS piece_no, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT piece_no, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM q),
s AS (SELECT lang, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY piece_no ORDER BY i)),
g AS (SELECT lang, 1 AS k, a AS phrase, NULL AS h1, NULL AS t1, NULL AS h2, NULL AS t2, count(*) AS f FROM s GROUP BY lang, a
      UNION ALL SELECT lang, 2, a || ' ' || b, a, b, NULL, NULL, count(*) FROM s WHERE b IS NOT NULL GROUP BY lang, a, b
      UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, a, b || ' ' || c, a || ' ' || b, c, count(*) FROM s WHERE c IS NOT NULL GROUP BY lang, a, b, c),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE f >= 10),
e AS (SELECT lang, k, phrase, f AS a, 1 AS cut, h1 AS h, t1 AS t FROM f WHERE k > 1 UNION ALL SELECT lang, k, phrase, f, 2, h2, t2 FROM f WHERE k = 3),
u AS (SELECT e.lang, e.k, e.phrase, e.a, e.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * e.a * e.a) // (x.f::HUGEINT * y.f) AS score
      FROM e JOIN f x ON x.lang = e.lang AND x.phrase = e.h JOIN f y ON y.lang = e.lang AND y.phrase = e.t),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, part, max(f) AS longer FROM (SELECT lang, h2 AS part, f FROM f WHERE k = 3 UNION ALL SELECT lang, t1, f FROM f WHERE k = 3) GROUP BY lang, part),
o AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.part = b.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
