"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.tables import read_table as table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.neighbours import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.topk import exact_topk

    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def _digest(found: DataFrame, counted: tuple[str, ...]) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in counted), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm import secrets

    return _digest(secrets.scan(table(spark, sf_dir, "documents")), secrets.BASE)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm import pii

    return _digest(pii.scan(table(spark, sf_dir, "documents")), pii.BASE)


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.bilinear import score

    return score(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.suffixes import repeats

    return repeats(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.jaccard import similar

    return similar(table(spark, sf_dir, "documents"), percent=90, width=5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


# -- what the contracts of four operators fix, without what their methods add; this much has a form in SQL


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_secrets(spark, sf_dir).drop("spans")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii(spark, sf_dir).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.bilinear import base

    return base(table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_nn_descent": op2_nn_descent, "op3_exact_topk": op3_exact_topk, "op4_mixing": op4_mixing, "op5_secrets": op5_secrets, "op6_pii": op6_pii, "op7_log_bilinear": op7_log_bilinear, "op8_suffix_dedup": op8_suffix_dedup, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_packing": op10_packing, "secrets_base": secrets_base, "pii_base": pii_base, "mixing_targets": mixing_targets, "unigram_base": unigram_base}


# -- the same in SQL, where SQL can say it

#: Components of links (a, b), both ways, over nodes (n).
_REACH = "reach AS (SELECT n, n AS r FROM nodes UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r), component AS (SELECT n, min(r) AS component_id FROM reach GROUP BY 1)"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

OP2 = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id a, y.vec_id b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT vec_id n FROM embeddings), {_REACH}, d AS (SELECT a, count(*) c FROM links GROUP BY 1)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN component ON n = vec_id LEFT JOIN d ON a = vec_id"""

OP3 = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT score FROM e q JOIN e r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5"""

OP8 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
c AS (SELECT doc_id, n, j, substr(h, (200 * j + 1)::INT, 400) x FROM (SELECT doc_id, h, n, unnest(range(0, n // 100 + 1)) j FROM b WHERE n >= 100)),
w AS (SELECT doc_id, 100 * j + o i, md5(substr(x, (2 * o + 1)::INT, 200)) k FROM (SELECT doc_id, n, j, x, unnest(range(0, 100)) o FROM c) WHERE 100 * j + o + 100 <= n),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) place FROM w) WHERE place > 1),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) r FROM (SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100)::INT new FROM again)),
span AS (SELECT doc_id, min(i) s, max(i) + 100 e FROM run GROUP BY doc_id, r),
rest AS (SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) nx FROM span),
kept AS (SELECT doc_id, sum(e - s) gone, count(*) spans, substr(any_value(h), 1, (2 * min(s))::INT) || string_agg(substr(h, (2 * e + 1)::INT, (2 * (coalesce(nx, n) - e))::INT), '' ORDER BY s) h FROM rest JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256 FROM b LEFT JOIN kept USING (doc_id)"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP9 = f"""WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} w FROM documents),
z AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END sh FROM t),
x AS (SELECT doc_id, unnest(sh) g FROM z), c AS (SELECT doc_id, len(sh) n, CASE WHEN len(sh) > 0 THEN min(doc_id) OVER (PARTITION BY array_to_string(list_sort(sh), chr(10))) ELSE doc_id END class_id FROM z),
p AS (SELECT u.doc_id a, v.doc_id b, count(*) k FROM x u JOIN x v ON u.g = v.g AND u.doc_id < v.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 90 * (ca.n + cb.n - k)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), nodes AS (SELECT doc_id n FROM documents), {_REACH}, d AS (SELECT a, count(*) k FROM links GROUP BY 1)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, coalesce(k, 0)::BIGINT AS n_similar, component_id, class_id FROM c JOIN component ON component.n = c.doc_id LEFT JOIN d ON a = c.doc_id"""


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """Counts and digest of leftmost, non-overlapping matches: (kind, pattern, condition on a match m)."""
    parts, union = [], []
    for k, (kind, pattern, holds) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"m{k} AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) k, ms, gs FROM (SELECT doc_id, regexp_extract_all(t, {p}) ms, regexp_split_to_array(t, {p}) gs FROM d) WHERE len(ms) > 0), u{k} AS (SELECT doc_id, ms[k] m, sum(length(gs[k]) + length(ms[k])) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT e FROM m{k})")
        union.append(f"SELECT doc_id, {k} o, '{kind}' kind, e - length(m) s, e FROM u{k} WHERE {holds.format(p=p)}")
    counts = ", ".join(f"count(CASE WHEN o = {k} THEN 1 END)::BIGINT AS n_{kind}" for k, (kind, *_) in enumerate(kinds))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), {', '.join(parts)}, a AS ({' UNION ALL '.join(union)}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}), '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id"


_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = _spans([("assign", _ASSIGN, "length(regexp_extract(m, {p}, 2)) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"), ("hex", "[0-9a-f]{32,}", "true")], "s, o")
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda x, i: CASE WHEN i % 2 = 0 THEN (2 * x::INT) // 10 + (2 * x::INT) % 10 ELSE x::INT END)) % 10 = 0"
PII = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS UHUGEINT), 999) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ],
    "o, s",
)
TARGETS = r"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] weight, 3.0::DOUBLE * source_size cap FROM s),
r AS (SELECT *, cap / weight ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) level FROM w),
l AS (SELECT min_by(level, ratio) level FROM r WHERE level <= ratio)
SELECT doc_id, size, source_size, round(least(cap, l.level * weight), 6) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, l"""
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)"
UNIGRAM = f"""WITH t AS (SELECT doc_id, coalesce({_CRC} % 5 = 1, false) held_out, list_append({_WORDS}, '') w FROM documents),
x AS (SELECT doc_id, held_out, unnest(w) g FROM t), c AS (SELECT g, count(*) c FROM x WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c)::BIGINT n, count(*) v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 4) AS base_score FROM x LEFT JOIN c USING (g), n GROUP BY doc_id, held_out"""


def oracle_sql() -> dict[str, str]:
    """The others draw at random, train a model or tokenise; tests compare them with plain versions."""
    return {"op2_nn_descent": OP2, "op3_exact_topk": OP3, "op8_suffix_dedup": OP8, "op9_ngram_jaccard": OP9, "secrets_base": SECRETS, "pii_base": PII, "mixing_targets": TARGETS, "unigram_base": UNIGRAM}
