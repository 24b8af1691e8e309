"""The catalogue: a query per operator over the driver's tables, and its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import cleaning
from kindred.functions import text as T
from kindred.functions.sql import register_all
from kindred.functions.stopwords import DEFAULT
from kindred.operators import corpus as K
from kindred.operators.batch import Batch
from kindred.operators.join import similarity_join
from kindred.plans.flow import Flow, between, greater_than, less_than
from kindred.runtime import ship
from kindred.sources.tables import read_table
from kindred.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# -- pieces of SQL

_WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _toks(s: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({s}, '[{_WS}!-/:-@\[-`{{-~]+'), lambda x: lower(x)), lambda x: x <> '')"


def _words(s: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({s}, '[{_WS}]+'), lambda x: x <> ''))"


def _grams(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) < {n} THEN [{s}] ELSE list_transform(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i::INT, {n})) END"


def _fnv(s: str) -> str:
    return (
        f"(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), (2*i+1)::INT, 2))::UHUGEINT)), "
        "lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT))"
    )


def _lev(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END)"


def _jw(a: str, b: str) -> str:
    p = f"(CASE WHEN substr({a},1,4) = substr({b},1,4) THEN least(4, length({a}), length({b})) WHEN substr({a},1,3) = substr({b},1,3) THEN least(3, length({a}), length({b})) WHEN substr({a},1,2) = substr({b},1,2) THEN least(2, length({a}), length({b})) WHEN substr({a},1,1) = substr({b},1,1) THEN least(1, length({a}), length({b})) ELSE 0 END)"
    return f"(jaro_similarity({a}, {b}) + {p} * 0.1 * (1.0 - jaro_similarity({a}, {b})))"


def _ham(a: str, b: str) -> str:
    return f"len(list_filter(range(1, length({a}) + 1), lambda i: substr({a}, i::INT, 1) <> substr({b}, i::INT, 1)))"


def _jac(a: str, b: str, n: int) -> str:
    ga, gb = _grams(a, n), _grams(b, n)
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_intersect({ga}, {gb})) / len(list_distinct(list_concat({ga}, {gb})))::DOUBLE END)"


def _jacw(a: str, b: str) -> str:
    x, y = _words(a), _words(b)
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END)"


def _bm25(pairs: str) -> str:
    """Scores (index_a, index_b, score) of a CTE's rows (index_a, a, index_b, b)."""
    return f"""
    tk AS (SELECT index_a, index_b, {_toks("a")} ta, {_toks("b")} tb FROM {pairs}),
    fa AS (SELECT index_a, index_b, t, count(*) n FROM (SELECT index_a, index_b, unnest(ta) t FROM tk) GROUP BY ALL),
    fb AS (SELECT index_a, index_b, t, count(*) n FROM (SELECT index_a, index_b, unnest(tb) t FROM tk) GROUP BY ALL),
    ln_ AS (SELECT index_a, index_b, len(ta) la, len(tb) lb, (len(ta) + len(tb)) / 2.0 av FROM tk),
    sc AS (SELECT index_a, index_b,
        sum(fa.n * (CASE WHEN fb.n IS NULL THEN ln(2.0) ELSE ln(1.2) END) * fa.n * 2.2 / (fa.n + 1.2 * (0.25 + 0.75 * la / av))) sa,
        sum(CASE WHEN fb.n IS NULL THEN 0.0 ELSE fa.n * ln(1.2) * fb.n * 2.2 / (fb.n + 1.2 * (0.25 + 0.75 * lb / av)) END) sb
        FROM fa LEFT JOIN fb USING (index_a, index_b, t) JOIN ln_ USING (index_a, index_b) GROUP BY ALL),
    bm AS (SELECT index_a, index_b, CASE WHEN greatest(coalesce(sa, 0), coalesce(sb, 0)) > 0 THEN sb / greatest(sa, sb) ELSE 0.0 END score FROM tk LEFT JOIN sc USING (index_a, index_b))"""


def _tfidf(pairs: str) -> str:
    return f"""
    tk AS (SELECT index_a, index_b, {_toks("a")} ta, {_toks("b")} tb FROM {pairs}),
    fa AS (SELECT index_a, index_b, t, count(*) n FROM (SELECT index_a, index_b, unnest(ta) t FROM tk) GROUP BY ALL),
    fb AS (SELECT index_a, index_b, t, count(*) n FROM (SELECT index_a, index_b, unnest(tb) t FROM tk) GROUP BY ALL),
    fj AS (SELECT index_a, index_b, coalesce(fa.n, 0) na, coalesce(fb.n, 0) nb, ln(3.0 / (1 + (coalesce(fa.n, 0) > 0)::INT + (coalesce(fb.n, 0) > 0)::INT)) + 1 w FROM fa FULL JOIN fb USING (index_a, index_b, t)),
    sc AS (SELECT index_a, index_b, sum(na * nb * w * w) / nullif(sqrt(sum(na * na * w * w)) * sqrt(sum(nb * nb * w * w)), 0) v FROM fj GROUP BY ALL),
    tf AS (SELECT index_a, index_b, CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE v END score FROM tk LEFT JOIN sc USING (index_a, index_b))"""


def _simhash(table: str, key: str, size: int = 4) -> str:
    bits = " + ".join(f"(CASE WHEN sum(n * (2 * ((h >> {i}) & 1)::BIGINT - 1)) > 0 THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END)" for i in range(64))
    return f"""
    gr AS (SELECT {key} k, unnest({_grams("text", size)}) g FROM {table}),
    gc AS (SELECT k, g, count(*) n FROM gr GROUP BY ALL),
    gh AS (SELECT g, {_fnv("g")}::UBIGINT h FROM (SELECT DISTINCT g FROM gc)),
    fp AS (SELECT k, ({bits})::UBIGINT f FROM gc JOIN gh USING (g) GROUP BY k)"""


def _minhash(table: str, key: str, size: int = 3, k: int = 128) -> str:
    two = "18446744073709551616::UHUGEINT"
    return f"""
    gr AS (SELECT DISTINCT {key} k, unnest({_grams("text", size)}) g FROM {table}),
    gh AS (SELECT g, {_fnv("g")} h FROM (SELECT DISTINCT g FROM gr)),
    co AS (SELECT i, (((11400714819323198485::UHUGEINT * (i + 1) + 43981) % {two})::UBIGINT | 1)::UHUGEINT a, (11400714819323198485::UHUGEINT * (i + 1) + 4660) % {two} b FROM (SELECT unnest(range(0, {k}))::UHUGEINT i)),
    mh AS (SELECT k, i::INT i, min((((a * h) % {two} + b) % {two}) % 2305843009213693951::UHUGEINT)::BIGINT v FROM gr JOIN gh USING (g), co GROUP BY ALL)"""




def _clean(s: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({s})), '[{_WS}]+', ' ', 'g'))"


_NAMES = "n AS (SELECT p_name t, min(p_partkey) id FROM part GROUP BY 1), pr AS (SELECT x.id index_a, x.t a, y.id index_b, y.t b FROM n x JOIN n y ON x.id < y.id)"
_ITEMS = "pr AS (SELECT x.item_id index_a, x.text a, y.item_id index_b, y.text b FROM benchmark x JOIN benchmark y ON x.item_id < y.item_id)"
_NEXT_DOC = "pr AS (SELECT x.doc_id index_a, x.text a, y.doc_id index_b, y.text b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)"
_NEXT_NAME = "pr AS (SELECT x.c_custkey index_a, x.c_name a, y.c_custkey index_b, y.c_name b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1)"
_NEXT_TURN = "pr AS (SELECT conv_id, turn, text a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) b FROM conversations)"
_OUT = "SELECT index_a, index_b, round({s}, 6) AS score FROM {t}"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("text"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with the one whose key is the next."""
    x = df.select(F.col(key).alias("index_a"), F.col(text).alias("a"))
    y = df.select(F.col(key).alias("index_b"), F.col(text).alias("b"))
    return x.join(y, F.col("index_b") == F.col("index_a") + 1)


def _next_names(spark: SparkSession, d: str) -> DataFrame:
    return _next(read_table(spark, d, "customer"), "c_custkey", "c_name")


def _next_docs(spark: SparkSession, d: str) -> DataFrame:
    return _next(read_table(spark, d, "documents"), "doc_id", "text")


def _item_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    x, y = (items.select(F.col("id").alias(f"index_{s}"), F.col("text").alias(s)) for s in "ab")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    return x.withColumn("k", F.pmod(F.xxhash64("index_a"), F.lit(8))).join(y.withColumn("k", blocks), "k").where("index_a < index_b").drop("k")


def _round(df: DataFrame) -> DataFrame:
    return df.select("index_a", "index_b", F.round("score", 6).alias("score"))


# -- scalar functions and batches

_add("levenshtein_names", f"WITH {_NAMES} {_OUT.format(s=_lev('a', 'b'), t='pr')}")(lambda s, d: _round(Batch.of("levenshtein").matrix(_names(s, d), keep="upper")))
_add("jaro_winkler_names", f"WITH {_NAMES} {_OUT.format(s=_jw('a', 'b'), t='pr')}")(lambda s, d: _round(Batch.of("jaro_winkler").matrix(_names(s, d), keep="upper")))


@_add("edit_distances", f"WITH {_NAMES} SELECT index_a, index_b, levenshtein(a, b)::BIGINT AS distance, round(jaro_similarity(a, b), 6) AS jaro FROM pr")
def _distances(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    pairs = Batch.of("levenshtein").matrix(names, keep="upper").select("index_a", "index_b")
    x, y = (names.select(F.col("id").alias(f"index_{s}"), F.col("text").alias(s)) for s in "ab")
    return pairs.join(x, "index_a").join(y, "index_b").select("index_a", "index_b", T.levenshtein_distance("a", "b").cast("long").alias("distance"), F.round(T.jaro_similarity("a", "b"), 6).alias("jaro"))


@_add("hamming_customers", f"WITH {_NEXT_NAME} SELECT index_a, index_b, {_ham('a', 'b')}::BIGINT AS distance, round(1 - {_ham('a', 'b')} / length(a)::DOUBLE, 6) AS score FROM pr WHERE length(a) = length(b)")
def _hamming(spark: SparkSession, d: str) -> DataFrame:
    pairs = _next_names(spark, d)
    return pairs.select("index_a", "index_b", T.hamming_distance("a", "b").cast("long").alias("distance"), F.round(T.hamming_similarity("a", "b"), 6).alias("score")).where("distance is not null")


for _n, _name in ((2, "jaccard_bigram"), (3, "jaccard_trigram"), (5, "jaccard")):
    _add(f"{_name}_items", f"WITH {_ITEMS} {_OUT.format(s=_jac('a', 'b', _n), t='pr')}")(lambda s, d, name=_name, n=_n: _round(Batch.of(name, **({"n": n} if name == "jaccard" else {})).matrix(_items(s, d), keep="upper")))
_add("jaccard_word_items", f"WITH {_ITEMS} {_OUT.format(s=_jacw('a', 'b'), t='pr')}")(lambda s, d: _round(Batch.of("jaccard_word").matrix(_items(s, d), keep="upper")))


@_add("ngram_sets", f"SELECT item_id, g AS gram FROM (SELECT item_id, unnest(list_distinct({_grams('text', 3)})) g FROM benchmark)")
def _gram_sets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", F.explode(T.ngrams("text", 3)).alias("gram"))


@_add("fnv1a_items", f"SELECT item_id, hex({_fnv('text')}::UBIGINT) AS hash FROM benchmark")
def _hash(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", F.hex(T.fnv1a("text")).alias("hash"))


@_add("minhash_signatures", f"WITH {_minhash('benchmark', 'item_id')} SELECT k AS item_id, i AS place, v AS value FROM mh")
def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", F.posexplode(T.minhash_signature("text")).alias("place", "value"))


_add("minhash_items", f"WITH {_minhash('benchmark', 'item_id')} SELECT x.k AS index_a, y.k AS index_b, sum((x.v = y.v)::INT) / 128.0::DOUBLE AS score FROM mh x JOIN mh y ON x.i = y.i AND x.k < y.k GROUP BY ALL")(lambda s, d: Batch.of("minhash").matrix(_items(s, d), keep="upper"))


@_add("simhash_documents", f"WITH {_simhash('documents', 'doc_id')} SELECT k AS doc_id, hex(f) AS fingerprint FROM fp")
def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.hex(T.simhash_fingerprint("text")).alias("fingerprint"))


_add("simhash_items", f"WITH {_simhash('benchmark', 'item_id')} SELECT x.k AS index_a, y.k AS index_b, 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE AS score FROM fp x JOIN fp y ON x.k < y.k")(lambda s, d: Batch.of("simhash").matrix(_items(s, d), keep="upper"))


@_add("tokens_documents", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_toks('text')} t FROM documents)")
def _tokenized(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens("text")
    return read_table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


_add("bm25_items", f"WITH {_ITEMS}, {_bm25('pr')} {_OUT.format(s='score', t='bm')}")(lambda s, d: _round(Batch.of("bm25").matrix(_items(s, d), keep="upper")))
_add("tfidf_items", f"WITH {_ITEMS}, {_tfidf('pr')} {_OUT.format(s='score', t='tf')}")(lambda s, d: _round(Batch.of("tfidf").matrix(_items(s, d), keep="upper")))
_add("bm25_next_documents", f"WITH {_NEXT_DOC}, {_bm25('pr')} {_OUT.format(s='score', t='bm')}")(lambda s, d: _next_docs(s, d).select("index_a", "index_b", F.round(T.bm25_similarity("a", "b"), 6).alias("score")))
_add("tfidf_next_documents", f"WITH {_NEXT_DOC}, {_tfidf('pr')} {_OUT.format(s='score', t='tf')}")(lambda s, d: _next_docs(s, d).select("index_a", "index_b", F.round(T.tfidf_similarity("a", "b"), 6).alias("score")))
_add("batch_zip", f"WITH {_NEXT_NAME} SELECT index_a AS index_a, index_a AS index_b, round({_lev('a', 'b')}, 6) AS score FROM pr")(lambda s, d: _round(Batch.of("levenshtein").zip(*[_next_names(s, d).select(F.col("index_a").alias("id"), F.col(c).alias("text")) for c in "ab"])))
_add("batch_pairs_auto", "WITH " + _NEXT_NAME + f" SELECT index_a, index_a AS index_b, round(CASE WHEN length(a) = length(b) THEN 1 - {_ham('a', 'b')} / length(a)::DOUBLE ELSE 0 END, 6) AS score FROM pr")(lambda s, d: _round(Batch.auto().pairs(_next_names(s, d), key="index_a")))
_add("batch_one_to_many", f"SELECT 0::BIGINT AS index_a, p_partkey AS index_b, round({_jw(chr(39) + 'red small' + chr(39), 'p_name')}, 6) AS score FROM part")(lambda s, d: _round(Batch.for_intent("names").one_to_many("red small", read_table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))))

_SQLED = f"""WITH {_ITEMS}, {_bm25("pr")}
SELECT index_a, index_b, round({_jac("a", "b", 2)}, 6) AS bigram, round({_jacw("a", "b")}, 6) AS word, len({_toks("a")})::BIGINT AS n_tokens, round(bm.score, 6) AS bm25 FROM pr JOIN bm USING (index_a, index_b)"""


@_add("sql_functions", _SQLED)
def _in_sql(spark: SparkSession, d: str) -> DataFrame:
    register_all(spark)
    _item_pairs(spark, d).createOrReplaceTempView("kindred_item_pairs")
    return spark.sql("SELECT index_a, index_b, round(jaccard_bigram_similarity(a, b), 6) AS bigram, round(jaccard_word_similarity(a, b), 6) AS word, cast(size(text_tokens(a)) AS bigint) AS n_tokens, round(bm25_similarity(a, b), 6) AS bm25 FROM kindred_item_pairs")


# -- corpus

_CORPUS = f"""d AS (SELECT doc_id, {_toks("text")} t FROM documents), l AS (SELECT doc_id, len(t) dl FROM d),
p AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(t) term FROM d) GROUP BY ALL), st AS (SELECT count(*) n, avg(dl) av, sum(dl)::BIGINT total FROM l), df AS (SELECT term, count(*) df FROM p GROUP BY 1)"""
_RANKED = f"""{_CORPUS}, q AS (SELECT item_id query_id, unnest({_toks("text")}) term FROM benchmark),
s AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) score FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), st GROUP BY ALL)"""
_TFIDF = f"""{_CORPUS}, w AS (SELECT doc_id, term, tf / dl::DOUBLE * (ln((1 + n) / (1.0 + df)) + 1) w FROM p JOIN l USING (doc_id) JOIN df USING (term), st), m AS (SELECT l.doc_id, coalesce(sqrt(sum(w * w)), 0) m FROM l LEFT JOIN w USING (doc_id) GROUP BY 1)"""


def _index(spark: SparkSession, d: str) -> K.Index:
    return K.build(read_table(spark, d, "documents"))


def _six(score: str) -> Column:
    """A score from 0 up to 6 digits, rounded in doubles as the SQL does it; F.round makes a decimal of every value."""
    return (F.floor(F.col(score) * 1e6 + 0.5) / 1e6).alias(score)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_add("bm25_index_stats", f"WITH {_CORPUS} SELECT n::BIGINT AS n, round(av, 6) AS avgdl, total AS total_tokens FROM st")(lambda s, d: _index(s, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"), "total_tokens"))
_add("bm25_document_frequencies", f"WITH {_CORPUS} SELECT term, df::BIGINT AS df FROM df")(lambda s, d: _index(s, d).terms)
_add("bm25_postings", f"WITH {_CORPUS} SELECT doc_id, term, tf::BIGINT AS tf FROM p")(lambda s, d: _index(s, d).postings.select("doc_id", "term", "tf"))
_add("bm25_scores", f"WITH {_RANKED} SELECT b.item_id AS query_id, l.doc_id, round(coalesce(score, 0), 6) AS score FROM l JOIN benchmark b ON true LEFT JOIN s ON s.doc_id = l.doc_id AND s.query_id = b.item_id")(lambda s, d: K.bm25_all(_index(s, d), _queries(s, d)).select("query_id", "doc_id", _six("score")))
_add("bm25_normalized", f"WITH {_RANKED} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM s")(lambda s, d: K.bm25_normalized(_index(s, d), _queries(s, d)).select("query_id", "doc_id", _six("score")))
_add("bm25_search", f"WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) rank FROM s) SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10")(lambda s, d: K.search(_index(s, d), _queries(s, d), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score")))
_add("tfidf_idf", f"WITH {_CORPUS} SELECT term, round(ln((1 + n) / (1.0 + df)) + 1, 9) AS idf FROM df, st")(lambda s, d: K.idf(_index(s, d)).select("term", F.round("idf", 9).alias("idf")))
_add("tfidf_weights", f"WITH {_TFIDF} SELECT doc_id, term, round(w, 9) AS w FROM w")(lambda s, d: K.tfidf_weights(_index(s, d)).select("doc_id", "term", F.round("w", 9).alias("w")))


@_add("tfidf_vectors", f"WITH {_TFIDF}, c AS (SELECT doc_id, count(*) k FROM w GROUP BY 1) SELECT doc_id, coalesce(k, 0)::BIGINT AS n_terms, round(m, 9) AS magnitude FROM m LEFT JOIN c USING (doc_id)")
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return K.vectors(_index(spark, d)).select("doc_id", "n_terms", F.round("magnitude", 9).alias("magnitude"))


@_add("tfidf_cosine", f"WITH {_TFIDF}, pr AS (SELECT x.doc_id id_a, y.doc_id id_b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1), ds AS (SELECT id_a, id_b, sum(x.w * y.w) dot FROM pr JOIN w x ON x.doc_id = id_a JOIN w y ON y.doc_id = id_b AND y.term = x.term GROUP BY ALL) SELECT id_a, id_b, round(CASE WHEN x.m = 0 AND y.m = 0 THEN 1.0 WHEN dot IS NULL THEN 0.0 ELSE dot / (x.m * y.m) END, 6) AS score FROM pr JOIN m x ON x.doc_id = id_a JOIN m y ON y.doc_id = id_b LEFT JOIN ds USING (id_a, id_b)")
def _cosine(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "documents").select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("id_a")).join(ids.select(F.col("doc_id").alias("id_b")), F.col("id_b") == F.col("id_a") + 1)
    return K.cosine_pairs(_index(spark, d), pairs).select("id_a", "id_b", F.round("score", 6).alias("score"))


# -- cleaning

_STOP = "[" + ", ".join("'" + w + "'" for w in sorted(DEFAULT)) + "]"
_DROP = f"array_to_string(list_filter(string_split({_clean('text')}, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)), ' ')"
_add("clean_documents", f"SELECT doc_id, md5({_clean('text')}) AS digest FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(cleaning.clean_text("text")).alias("digest")))
_add("clean_stopwords", f"SELECT doc_id, md5({_DROP}) AS digest FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(cleaning.clean_text_stopwords("text")).alias("digest")))
_add("clean_max_length", f"WITH c AS (SELECT item_id, {_clean('text')} t FROM benchmark) SELECT item_id, CASE WHEN octet_length(encode(t)) <= 40 THEN t ELSE (SELECT max_by(p, length(p)) FROM (SELECT unnest(list_transform(range(0, 41), lambda i: substr(t, 1, i::INT))) p) WHERE octet_length(encode(p)) <= 40) END AS text FROM c")(lambda s, d: read_table(s, d, "benchmark").select("item_id", cleaning.Cleaner().with_max_length(40).apply("text").alias("text")))
_add("clean_case_kept", f"SELECT doc_id, md5(trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'))) AS digest FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(cleaning.Cleaner().with_lowercase(False).with_normalize_unicode(False).apply("text")).alias("digest")))


# -- routing

_ROUTE = f"""WITH {_NEXT_TURN}, c AS (SELECT conv_id, turn, {_clean("a")} a, {_clean("b")} b FROM pr WHERE b IS NOT NULL),
r AS (SELECT *, CASE WHEN strlen(a) = strlen(b) AND strlen(a) <= 20 THEN 'hamming' WHEN greatest(strlen(a), strlen(b)) <= 50 THEN 'jaro_winkler' WHEN greatest(strlen(a), strlen(b)) <= 500 THEN 'bm25' ELSE 'simhash' END algorithm FROM c),
bp AS (SELECT conv_id index_a, turn index_b, a, b FROM r WHERE algorithm = 'bm25'), {_bm25("bp")},
lt AS (SELECT (conv_id, turn, 'a') k0, a AS text FROM r WHERE algorithm = 'simhash' UNION ALL SELECT (conv_id, turn, 'b'), b FROM r WHERE algorithm = 'simhash'), {_simhash("lt", "k0")}
SELECT r.conv_id, r.turn, r.algorithm, 0 AS tier, round(CASE r.algorithm WHEN 'hamming' THEN CASE WHEN length(a) = length(b) THEN 1 - {_ham("a", "b")} / greatest(length(a), 1)::DOUBLE END WHEN 'jaro_winkler' THEN {_jw("a", "b")} WHEN 'bm25' THEN bm.score ELSE 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE END, 6) AS score
FROM r LEFT JOIN bm ON bm.index_a = r.conv_id AND bm.index_b = r.turn LEFT JOIN fp x ON x.k = (r.conv_id, r.turn, 'a') LEFT JOIN fp y ON y.k = (r.conv_id, r.turn, 'b')"""


@_add("auto_route", _ROUTE)
def _auto(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "conversations")
    turns = turns.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return Flow.auto().errors("null").compare(turns).select("conv_id", "turn", F.coalesce("result.algorithm", F.lit("hamming")).alias("algorithm"), F.coalesce("result.tier", F.lit(0)).alias("tier"), F.round("result.score", 6).alias("score"))


def _intent(name: str, tier: int = 0) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = _next_names(spark, d) if name in ("names", "typos", "codes") else _item_pairs(spark, d)
        return Flow().compare_with_intent(pairs, name).select("index_a", "index_b", F.round("result.score", 6).alias("score"), "result.algorithm", "result.tier")

    return run


_CLEANED = "pr AS (SELECT index_a, " + _clean("a") + " a, index_b, " + _clean("b") + " b FROM pr0)"
for _name, _table, _algorithm, _score in (("names", _NEXT_NAME, "jaro_winkler", _jw("a", "b")), ("typos", _NEXT_NAME, "levenshtein", _lev("a", "b")), ("codes", _NEXT_NAME, "hamming", f"1 - {_ham('a', 'b')} / length(a)::DOUBLE")):
    _add(f"intent_{_name}", f"WITH {_table.replace('pr AS', 'pr0 AS')}, {_CLEANED} SELECT index_a, index_b, round({_score}, 6) AS score, '{_algorithm}' AS algorithm, 0 AS tier FROM pr")(_intent(_name))
_add("intent_documents", f"WITH {_ITEMS.replace('pr AS', 'pr0 AS')}, {_CLEANED}, {_bm25('pr')} SELECT index_a, index_b, round(score, 6) AS score, 'bm25' AS algorithm, 0 AS tier FROM bm")(_intent("documents"))
_add("intent_dedup", f"WITH c AS (SELECT item_id, {_clean('text')} AS text FROM benchmark), {_simhash('c', 'item_id')} SELECT x.k AS index_a, y.k AS index_b, round(1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE, 6) AS score, 'simhash' AS algorithm, 0 AS tier FROM fp x JOIN fp y ON x.k < y.k")(_intent("dedup"))

_TIERS = f"WITH {_ITEMS.replace('pr AS', 'pr0 AS')}, {_CLEANED}, {_bm25('pr')}, s AS (SELECT index_a, index_b, {_jac('a', 'b', 2)} s1, bm.score s2, length(a) = length(b) same FROM pr JOIN bm USING (index_a, index_b))"
_TWO = "CASE WHEN s1 > 0.5 OR s1 < 0.18 THEN {one} WHEN s2 BETWEEN 0.05 AND 0.9 THEN {two} ELSE {last} END"


def _cascade(last: tuple[str, str, str]) -> str:
    cells = [_TWO.format(one=a, two=b, last=c) for a, b, c in (("round(s1, 6)", "round(s2, 6)", last[0]), ("1", "2", last[1]), ("'jaccard_bigram'", "'bm25'", last[2]))]
    return f"{_TIERS} SELECT index_a, index_b, {cells[0]} AS score, {cells[1]} AS tier, {cells[2]} AS algorithm FROM s"


def _flow() -> Flow:
    return Flow().tier_1("jaccard_bigram", greater_than(0.5), less_than(0.18)).tier_2("bm25", between(0.05, 0.9))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("index_a", "index_b", F.round("result.score", 6).alias("score"), "result.tier", "result.algorithm")


def _half(a: str, b: str) -> tuple[float, str]:
    return (0.75, "even") if len(a) == len(b) else (0.25, "odd")


_add("cascade_no_fallback", _cascade(("round(s1, 6)", "1", "'jaccard_bigram'")))(lambda s, d: _flat(_flow().compare(_item_pairs(s, d))))
_add("cascade_fallback", _cascade(("CASE WHEN same THEN 0.75 ELSE 0.25 END", "3", "'fallback'")))(lambda s, d: _flat(_flow().fallback(_half).compare(_item_pairs(s, d))))
_add("cascade_one_tier", f"WITH {_NEXT_NAME} SELECT index_a, index_b, round({_lev('a', 'b')}, 6) AS score, 1 AS tier, 'levenshtein' AS algorithm FROM pr")(lambda s, d: _flat(Flow.for_intent("typos").preprocess(False).compare(_next_names(s, d))))

_FULL = "coalesce(result.score, -1.0D) AS score; coalesce(result.tier, -1) AS tier; coalesce(result.algorithm, 'none') AS algorithm; coalesce(result.fallback_called, false) AS fallback_called; coalesce(result.fallback_data, 'none') AS fallback_data"


def _whole(df: DataFrame) -> DataFrame:
    """All fields of the result, with values for NULL that both engines write alike."""
    return df.selectExpr("index_a", "index_b", *_FULL.split("; ")).withColumn("score", F.round("score", 6))


_add("cascade_full_result", f"""{_TIERS} SELECT index_a, index_b, {_TWO.format(one="round(s1, 6)", two="round(s2, 6)", last="CASE WHEN same THEN 0.75 ELSE 0.25 END")} AS score, {_TWO.format(one="1", two="2", last="3")} AS tier,
{_TWO.format(one="'jaccard_bigram'", two="'bm25'", last="'fallback'")} AS algorithm, {_TWO.format(one="false", two="false", last="true")} AS fallback_called, {_TWO.format(one="'none'", two="'none'", last="CASE WHEN same THEN 'even' ELSE 'odd' END")} AS fallback_data FROM s""")(lambda s, d: _whole(_flow().with_strategy("cascade").fallback(_half).compare(_item_pairs(s, d))))


def _hook_udf():
    return F.udf(lambda a, b: None if a is None or b is None else _half(a, b), "struct<score:double,data:string>")


# Only a tier 2 that accepts nothing, so that every pair reaches a hook given as a UDF of the user's own.
_add("cascade_fallback_udf", f"{_TIERS} SELECT index_a, index_b, CASE WHEN same THEN 0.75 ELSE 0.25 END AS score, 3 AS tier, 'fallback' AS algorithm, true AS fallback_called, CASE WHEN same THEN 'even' ELSE 'odd' END AS fallback_data FROM s")(lambda s, d: _whole(Flow().tier_2("jaccard_word", between(2.0, 3.0)).fallback_udf(_hook_udf()).compare(_item_pairs(s, d))))



def _kept(s: str) -> str:
    return f"regexp_replace(regexp_replace(nfc_normalize({s}), '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


def _few(s: str) -> str:
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda x: x <> '' AND NOT list_contains(['the', 'of', 'and', 'is'], x)), ' ')"


_PREPARED = f"pr AS (SELECT index_a, {_few(_kept('a'))} a, index_b, {_few(_kept('b'))} b FROM pr0)"
_add("flow_with_preprocessor", f"WITH {_ITEMS.replace('pr AS', 'pr0 AS')}, {_PREPARED} SELECT index_a, index_b, round({_jacw('a', 'b')}, 6) AS score, 1 AS tier, 'jaccard_word' AS algorithm, false AS fallback_called, 'none' AS fallback_data FROM pr")(
    lambda s, d: _whole(Flow().with_preprocessor(cleaning.Cleaner().with_lowercase(False).with_remove_stopwords().with_stopwords(["the", "of", "and", "is"])).tier_1("jaccard_word", greater_than(0.9), less_than(0.1)).compare(_item_pairs(s, d)))
)
# Texts of unequal lengths: an error that makes the result NULL, where a batch scores 0.
_NATIONS = "pr AS (SELECT n_nationkey::BIGINT index_a, n_name a, r_regionkey::BIGINT index_b, r_name b FROM nation, region)"
_UNEQUAL = f"CASE WHEN length(a) = length(b) THEN 1 - {_ham('a', 'b')} / length(a)::DOUBLE END"


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text")), r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("text"))


def _nation_pairs(spark: SparkSession, d: str) -> DataFrame:
    (n, r), key = _nations(spark, d), F.lit(0).alias("k")
    return n.select(F.col("id").cast("long").alias("index_a"), F.col("text").alias("a"), key).join(r.select(F.col("id").cast("long").alias("index_b"), F.col("text").alias("b"), key), "k").drop("k")


_add("cascade_error_null", f"WITH {_NATIONS} SELECT index_a, index_b, round(coalesce({_UNEQUAL}, -1.0::DOUBLE), 6) AS score, CASE WHEN length(a) = length(b) THEN 1 ELSE -1 END AS tier, CASE WHEN length(a) = length(b) THEN 'hamming' ELSE 'none' END AS algorithm, false AS fallback_called, 'none' AS fallback_data FROM pr")(lambda s, d: _whole(Flow().preprocess(False).errors("null").tier_1("hamming", greater_than(0.9), less_than(0.0)).compare(_nation_pairs(s, d))))
_add("batch_matrix_two_frames", f"WITH {_NATIONS} SELECT index_a, index_b, round({_lev('a', 'b')}, 6) AS score FROM pr")(lambda s, d: _round(Batch.for_intent("typos").matrix(*_nations(s, d))))
_add("batch_matrix_all", f"WITH n AS (SELECT item_id id, text t FROM benchmark), pr AS (SELECT x.id index_a, x.t a, y.id index_b, y.t b FROM n x, n y) SELECT index_a, index_b, round({_jac('a', 'b', 2)}, 6) AS score FROM pr")(lambda s, d: _round(Batch.of("jaccard_bigram").matrix(_items(s, d), keep="all")))
_add("batch_unequal_lengths", f"WITH {_NATIONS} SELECT index_a, index_b, round(coalesce({_UNEQUAL}, 0.0), 6) AS score FROM pr")(lambda s, d: _round(Batch.of("hamming").matrix(*_nations(s, d))))
_add("batch_auto_per_pair", f"WITH {_NATIONS} SELECT index_a, index_b, round(CASE WHEN length(a) = length(b) THEN {_UNEQUAL} ELSE {_jw('a', 'b')} END, 6) AS score FROM pr")(lambda s, d: _round(Batch.auto(per_pair=True).matrix(*_nations(s, d))))
_add("minhash_parameters", f"WITH {_minhash('benchmark', 'item_id', 5, 32)} SELECT x.k AS index_a, y.k AS index_b, sum((x.v = y.v)::INT) / 32.0::DOUBLE AS score FROM mh x JOIN mh y ON x.i = y.i AND x.k < y.k GROUP BY ALL")(lambda s, d: Batch.of("minhash", shingle=5, hashes=32).matrix(_items(s, d), keep="upper"))
_add("simhash_parameters", f"WITH {_simhash('benchmark', 'item_id', 2)} SELECT x.k AS index_a, y.k AS index_b, 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE AS score FROM fp x JOIN fp y ON x.k < y.k")(lambda s, d: Batch.of("simhash", shingle=2).matrix(_items(s, d), keep="upper"))

# Decomposed letters and other white space, of which the tables have none.
_ODD = "replace(replace(text, 'e', concat('e', chr(769))), ' ', concat(chr(160), chr(8195)))"
_add("clean_nfc", f"WITH o AS (SELECT doc_id, {_ODD} AS text FROM documents) SELECT doc_id, md5({_clean('text')}) AS digest FROM o")(lambda s, d: read_table(s, d, "documents").withColumn("text", F.expr("replace(replace(text, 'e', concat('e', decode(unhex('CC81'), 'utf-8'))), ' ', decode(unhex('C2A0E28083'), 'utf-8'))")).select("doc_id", F.md5(cleaning.clean_text("text")).alias("digest")))
_add("clean_setters", f"SELECT doc_id, md5(regexp_replace(text, '[{_WS}]+', ' ', 'g')) AS digest FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(cleaning.Cleaner().with_normalize_unicode(False).with_lowercase(False).with_collapse_whitespace().with_trim(False).apply("text")).alias("digest")))
_add("clean_custom_stopwords", f"SELECT doc_id, md5({_few(_clean('text'))}) AS digest FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", F.md5(cleaning.Cleaner().with_remove_stopwords().with_stopwords(["the", "of", "and", "is"]).apply("text")).alias("digest")))

_add("bm25_normalized_all", f"WITH {_RANKED}, al AS (SELECT b.item_id query_id, l.doc_id, coalesce(score, 0) score FROM l JOIN benchmark b ON true LEFT JOIN s ON s.doc_id = l.doc_id AND s.query_id = b.item_id) SELECT query_id, doc_id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM al")(lambda s, d: K.bm25_normalized(_index(s, d), _queries(s, d), every=True).select("query_id", "doc_id", _six("score")))
_add("bm25_one", f"WITH {_CORPUS}, q AS (SELECT unnest({_toks('text')}) term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), s AS (SELECT sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) score FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), st WHERE doc_id = 3) SELECT 3::BIGINT AS doc_id, round(coalesce(score, 0), 6) AS score FROM s")(
    lambda s, d: K.bm25_one(_index(s, d), read_table(s, d, "benchmark").orderBy("item_id").first()["text"], 3).select(F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))
)
_OVER = _TFIDF.replace("documents", "benchmark").replace("doc_id", "item_id")
_add("tfidf_cosine_overlaps", f"WITH {_OVER} SELECT x.item_id AS id_a, y.item_id AS id_b, round(sum(x.w * y.w) / any_value(mx.m * my.m), 6) AS score FROM w x JOIN w y ON x.term = y.term AND x.item_id < y.item_id JOIN m mx ON mx.item_id = x.item_id JOIN m my ON my.item_id = y.item_id GROUP BY 1, 2")(lambda s, d: K.cosine_overlaps(K.build(read_table(s, d, "benchmark"), key="item_id")).select("id_a", "id_b", F.round("score", 6).alias("score")))

# -- every function by its name in SQL

# DuckDB's edit distances count bytes, so these are compared on the ASCII characters.
_ASCII = "regexp_replace({x}, '[^ -~]', '', 'g')"
_A, _B = "(" + _ASCII.format(x="a") + ")", "(" + _ASCII.format(x="b") + ")"
_NAMED = {
    "levenshtein_distance({a}, {b})": ("lev_d", f"levenshtein({_A}, {_B})::INT"),
    "round(levenshtein_similarity({a}, {b}), 6)": ("lev", f"round({_lev(_A, _B)}, 6)"),
    "hamming_distance(a, concat('x', substring(a, 2)))": ("ham_d", f"{_ham('a', chr(40) + 'concat(' + chr(39) + 'x' + chr(39) + ', substr(a, 2))' + chr(41))}::INT"),
    "round(hamming_similarity(a, concat('x', substring(a, 2))), 6)": ("ham", f"round(1 - {_ham('a', chr(40) + 'concat(' + chr(39) + 'x' + chr(39) + ', substr(a, 2))' + chr(41))} / length(a)::DOUBLE, 6)"),
    "round(jaro_similarity({a}, {b}), 6)": ("jaro", f"round(jaro_similarity({_A}, {_B}), 6)"),
    "round(jaro_winkler_similarity({a}, {b}), 6)": ("jw", f"round({_jw(_A, _B)}, 6)"),
    "round(jaccard_similarity(a, b, 4), 6)": ("jac4", f"round({_jac('a', 'b', 4)}, 6)"),
    "round(jaccard_trigram_similarity(a, b), 6)": ("jac3", f"round({_jac('a', 'b', 3)}, 6)"),
    "round(tfidf_similarity(a, b), 6)": ("tfidf", "round(tf.score, 6)"),
    "md5(clean_text(a))": ("clean", f"md5({_clean('a')})"),
    "md5(clean_text_stopwords(a))": ("clean_stop", f"md5({_DROP.replace('text', 'a')})"),
}
_add("sql_functions_text", f"WITH {_ITEMS}, {_tfidf('pr')} SELECT pr.index_a, pr.index_b, " + ", ".join(f"{sql} AS {name}" for name, sql in _NAMED.values()) + " FROM pr JOIN tf USING (index_a, index_b)")(lambda s, d: _named(s, d, "SELECT index_a, index_b, " + ", ".join(f"{call} AS {name}".replace("{a}", "regexp_replace(a, '[^ -~]', '')").replace("{b}", "regexp_replace(b, '[^ -~]', '')") for call, (name, _) in _NAMED.items()) + " FROM kindred_item_pairs"))
_HASHED = f"""WITH {_ITEMS}, fa AS (SELECT item_id, {_fnv("text")}::UBIGINT h FROM benchmark), {_minhash("benchmark", "item_id")}, {_simhash("benchmark", "item_id").replace(" gr AS", " gs AS").replace("FROM gr", "FROM gs").replace(" gh AS", " gi AS").replace("JOIN gh", "JOIN gi").lstrip()},
ms AS (SELECT x.k index_a, y.k index_b, sum((x.v = y.v)::INT) / 128.0::DOUBLE v, sum((x.v = y.v AND x.i < 16)::INT) / 16.0::DOUBLE v16 FROM mh x JOIN mh y ON x.i = y.i AND x.k < y.k GROUP BY ALL)
SELECT pr.index_a, pr.index_b, hex(fa.h) AS hash, ms.v AS minhash, ms.v AS minhash_default, ms.v16 AS minhash_16, ms.v AS signatures, hex(x.f) AS fingerprint, hex(x.f) AS fingerprint_default, 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE AS simhash, 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE AS simhash_default, 1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE AS fingerprints, bit_count(xor(x.f, y.f))::INT AS bits
FROM pr JOIN fa ON fa.item_id = pr.index_a JOIN ms ON ms.index_a = pr.index_a AND ms.index_b = pr.index_b JOIN fp x ON x.k = pr.index_a JOIN fp y ON y.k = pr.index_b"""


@_add("sql_functions_hashes", _HASHED)
def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _named(
        spark,
        d,
        """SELECT index_a, index_b, hex(fnv1a(a)) AS hash, minhash_similarity(a, b, 3, 128) AS minhash, minhash_similarity_default(a, b) AS minhash_default, minhash_similarity(a, b, 3, 16) AS minhash_16,
        signature_similarity(minhash_signature(a, 3, 128), minhash_signature(b, 3, 128)) AS signatures, hex(simhash_fingerprint(a, 4)) AS fingerprint, hex(simhash_fingerprint_default(a)) AS fingerprint_default, simhash_similarity(a, b, 4) AS simhash,
        simhash_similarity_default(a, b) AS simhash_default, fingerprint_similarity(simhash_fingerprint(a, 4), simhash_fingerprint(b, 4)) AS fingerprints, simhash_distance(simhash_fingerprint(a, 4), simhash_fingerprint(b, 4)) AS bits FROM kindred_item_pairs""",
    )


def _named(spark: SparkSession, d: str, sql: str) -> DataFrame:
    register_all(spark)
    _item_pairs(spark, d).createOrReplaceTempView("kindred_item_pairs")
    return spark.sql(sql)


# -- similarity joins


def _join_sql(cte: str, score: str, t: float, table: str = "pr") -> str:
    return f"WITH {cte} SELECT index_a, index_b, round({score}, 6) AS score FROM {table} WHERE {score} > {t}"


_DOCS_FP = f"WITH {_simhash('documents', 'doc_id')} SELECT x.k AS index_a, y.k AS index_b, round(1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE, 6) AS score FROM fp x JOIN fp y ON x.k < y.k AND bit_count(xor(x.f, y.f)) < 4"
_add("simjoin_levenshtein", _join_sql(_NAMES, _lev("a", "b"), 0.6))(lambda s, d: _round(similarity_join(_names(s, d), "levenshtein", 0.6)))
_add("simjoin_jaro_winkler", _join_sql(_NAMES, _jw("a", "b"), 0.9))(lambda s, d: _round(similarity_join(_names(s, d), "jaro_winkler", 0.9)))
_add("simjoin_hamming", f"WITH n AS (SELECT s_suppkey id, s_name t FROM supplier), pr AS (SELECT x.id index_a, x.t a, y.id index_b, y.t b FROM n x JOIN n y ON x.id < y.id AND length(x.t) = length(y.t)) SELECT index_a, index_b, round(1 - {_ham('a', 'b')} / length(a)::DOUBLE, 6) AS score FROM pr WHERE 1 - {_ham('a', 'b')} / length(a)::DOUBLE > 0.92")(lambda s, d: _round(similarity_join(read_table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text")), "hamming", 0.92)))
_add("simjoin_jaccard_trigram", _join_sql(_ITEMS, _jac("a", "b", 3), 0.15))(lambda s, d: _round(similarity_join(_items(s, d), "jaccard_trigram", 0.15)))
_add("simjoin_jaccard_word", _join_sql(_ITEMS, _jacw("a", "b"), 0.03))(lambda s, d: _round(similarity_join(_items(s, d), "jaccard_word", 0.03)))
_add("simjoin_minhash", f"WITH {_minhash('benchmark', 'item_id')}, s AS (SELECT x.k index_a, y.k index_b, sum((x.v = y.v)::INT) / 128.0::DOUBLE v FROM mh x JOIN mh y ON x.i = y.i AND x.k < y.k GROUP BY ALL) SELECT index_a, index_b, round(v, 6) AS score FROM s WHERE v > 0.15")(lambda s, d: _round(similarity_join(_items(s, d), "minhash", 0.15)))
_add("simjoin_simhash", _DOCS_FP)(lambda s, d: _round(similarity_join(read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "simhash", 60 / 64)))
_add("simjoin_tfidf", f"WITH {_ITEMS}, {_tfidf('pr')} SELECT index_a, index_b, round(score, 6) AS score FROM tf WHERE score > 0.2")(lambda s, d: _round(similarity_join(_items(s, d), "tfidf", 0.2)))
_add("simjoin_bm25", f"WITH {_ITEMS}, {_bm25('pr')} SELECT index_a, index_b, round(score, 6) AS score FROM bm WHERE score > 0.1")(lambda s, d: _round(similarity_join(_items(s, d), "bm25", 0.1)))

_add("simjoin_jaccard_word_documents", f"WITH w AS (SELECT doc_id, unnest({_words('text')}) x FROM documents), n AS (SELECT doc_id, count(*) n FROM w GROUP BY 1), p AS (SELECT a.doc_id index_a, b.doc_id index_b, count(*) c FROM w a JOIN w b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL) SELECT index_a, index_b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS score FROM p JOIN n x ON x.doc_id = index_a JOIN n y ON y.doc_id = index_b WHERE c / (x.n + y.n - c)::DOUBLE > 0.8")(lambda s, d: _round(similarity_join(read_table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "jaccard_word", 0.8)))


# -- streams


@_add("stream_clean", SQL["clean_documents"])
def _stream_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    stream = _streamed(spark, d, "documents", docs).select("doc_id", F.md5(cleaning.clean_text("text")).alias("digest"))
    return scoring.drain(spark, stream, "stream-clean")


def _streamed(spark: SparkSession, d: str, name: str, like: DataFrame) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(folder).isDirectory():
        return scoring.read_stream(spark, f"{d}/{name}.parquet", like)
    return spark.readStream.schema(like.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@_add("stream_near_items", f"WITH c AS (SELECT item_id, text FROM benchmark), {_simhash('c', 'item_id')} SELECT x.k AS new_id, y.k AS corpus_id, round(1 - bit_count(xor(x.f, y.f)) / 64.0::DOUBLE, 6) AS score FROM fp x JOIN fp y ON bit_count(xor(x.f, y.f)) <= 7")
def _stream_near(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "benchmark")
    stream = _streamed(spark, d, "benchmark", items)
    near = scoring.near_corpus(stream, items, "item_id", most=7)
    return scoring.drain(spark, near, "stream-near").select("new_id", "corpus_id", F.round("score", 6).alias("score"))


@_add("stream_drop_repeats", "SELECT DISTINCT event_type FROM events")
def _stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    timed = _streamed(spark, d, "events", events).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return scoring.drain(spark, scoring.drop_repeats(timed, "ts", "event_type"), "stream-repeats").select("event_type")
