"""Registered queries of this package, each next to the SQL that states the same result if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labspark.llm import byte_bpe, byte_cnn, collocations, interpolated_lm, jaccard_join, license_scan, line_dedup, mixing, one_bit_ann, periodic_runs, quality_gam, quality_rules as rules, sharding
from labspark.llm.text import let, split_words, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.phrase}, {t.words})" for i, t in enumerate(license_scan.PHRASES + license_scan.NOTICES))
_LICENSE_SQL = f"""WITH tpl(k, label, phrase, tw) AS (VALUES {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
vote AS (SELECT r, k, label, phrase, len(tw) - 1 AS m, p - q AS diag, p, q FROM (SELECT r, p, w[p] AS a, w[p + 1] AS b FROM d, unnest(range(1, len(w))) AS u(p))
 JOIN (SELECT *, tw[q] AS a, tw[q + 1] AS b FROM tpl, unnest(range(1, len(tw))) AS u(q)) USING (a, b)),
diags AS (SELECT r, k, label, phrase, m, diag, count(*) AS n, list(q) AS qs, min(p) AS lo, max(p) AS hi FROM vote GROUP BY ALL),
grp AS (SELECT *, sum(CASE WHEN diag - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY r, k ORDER BY diag) AS g FROM (SELECT *, lag(diag) OVER (PARTITION BY r, k ORDER BY diag) AS prev FROM diags)),
span AS (SELECT r, k, label, phrase, m, g, len(list_distinct(flatten(list(qs)))) AS seen, max(hi) - min(lo) + 2 AS width, max(n) AS straight, count(*) FILTER (n = m) AS places,
 min(diag) FILTER (n = m) AS a, max(diag) FILTER (n = m) AS z FROM grp GROUP BY ALL),
sc AS (SELECT *, greatest(straight, CASE WHEN width <= 1.5 * (m + 1) + 3 THEN seen ELSE 0 END) / m AS score FROM span),
res AS (SELECT r, sum(places) FILTER (phrase) AS n_base, min(a) FILTER (phrase) AS a, max(z) FILTER (phrase) AS z, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND places > 0) AS bl,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN phrase THEN places > 0 ELSE score >= 0.7 END) AS ll, max(score) AS score FROM sc GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a AS first_word, z AS last_word, coalesce(bl, '') AS base_labels, coalesce(ll, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN res USING (r)"""


@_query("op1_license_scan", _LICENSE_SQL)
def op1_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))[1]
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


_LINES_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents),
l AS (SELECT r, doc_id, i, ln[i] AS line, translate(trim(ln[i], {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM d, unnest(range(1, len(ln) + 1)) AS u(i)),
s AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(doc_id < keeper, false) AS gone FROM l LEFT JOIN s USING (key)) GROUP BY r"""


@_query("op7_line_dedup", _LINES_SQL)
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.dropped").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in rules.STOP_WORDS)
_RULES_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], chr(1)) AS g FROM c, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(8)) AS u(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
 len(list_filter(ln, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '^[-*•‣]'))) AS n_bullet,
 len(list_filter(ln, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '(\\.\\.\\.|…)$'))) AS n_dots
 FROM c LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 2 AND 14
 AND n_symbols / n_words <= 0.2 AND (n_words < 50 OR n_stop / n_words >= 0.02) AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.4
 AND coalesce(n_bullet / nullif(n_lines, 0), 0) <= 0.9 AND coalesce(n_dots / nullif(n_lines, 0), 0) <= 0.3 AND n_repeat_words / n_words <= 0.3 AS kept FROM b"""


@_query("op9_quality_rules", _RULES_SQL)
def op9_quality_rules(spark, sf_dir):
    found = rules.quality_rules(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                        (~base_failed & F.col("passes")).alias("kept"))


@_query("op2_mix_sources")
def op2_mix_sources(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    # equal rows of size 0 share a place; they stay apart by counting what is not taken
    one = out.filter(F.col("copy").isNotNull()).groupBy("doc_id", *mixing.SOURCE, "place", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("shard").isNotNull(), F.col("size"))).alias("taken"))
    none = out.filter(F.col("copy").isNull()).withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return one.select(cols).unionByName(none.select(cols))


@_query("op8_shards")
def op8_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty(docs)
    out = sharding.stratified_shards(docs, 24, carry={"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op5_quality_gam")
def op5_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op4_one_bit_ann", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def op4_one_bit_ann(spark, sf_dir):
    return one_bit_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op6_interpolated_lm")
def op6_interpolated_lm(spark, sf_dir):
    found = interpolated_lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


_PHRASES_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM d, unnest(ps) AS u(x)),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, w[i:i + k - 1] AS ph, count(*) AS a FROM p, unnest(range(1, len(w) + 1)) AS u(i), unnest([1, 2, 3, 4]) AS v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, ph, a, k, ph[1:k] AS lp, ph[k + 1:] AS rp FROM f, unnest([1, 2, 3]) AS u(k) WHERE k < len(ph)),
cut AS (SELECT cand.*, lf.a AS l, rf.a AS r, (2000000::HUGEINT * cand.a) // (lf.a + rf.a) AS score FROM cand JOIN f AS lf ON lf.lang = cand.lang AND lf.ph = cand.lp JOIN f AS rf ON rf.lang = cand.lang AND rf.ph = cand.rp),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (SELECT lang, ph[i:i + k - 1] AS ph, max(a) AS most FROM f, unnest([1, 2, 3]) AS u(i), unnest([2, 3]) AS v(k) WHERE k < len(ph) AND i + k - 1 <= len(ph) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, ph) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN tot USING (lang) QUALIFY rank <= 2000"""


@_query("op11_collocations", _PHRASES_SQL)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


_CRC_SQL = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
 lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_RUNS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor({_CRC_SQL}, 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
x AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM e),
pos AS (SELECT r, i, w[i + 1] AS word FROM x, unnest(range(n)) AS u(i)),
eq AS (SELECT p.r, s.i - p.i AS q, p.i FROM pos AS p JOIN pos AS s ON s.r = p.r AND s.word = p.word AND s.i > p.i),
st AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM eq) GROUP BY r, q, g),
run AS (SELECT r, s, len, min(q) AS q FROM st WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len),
per AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY r),
best AS (SELECT b.r, b.s, b.len, b.q FROM run AS b LEFT JOIN run AS o ON o.r = b.r AND (o.len * b.q > b.len * o.q OR (o.len * b.q = b.len * o.q AND (o.s, o.q) < (b.s, b.q))) WHERE o.r IS NULL),
gone AS (SELECT DISTINCT r, i FROM run, unnest(range(s + q, s + len)) AS u(i)),
kept AS (SELECT pos.r, string_agg(word, ' ' ORDER BY pos.i) AS t FROM pos LEFT JOIN gone ON gone.r = pos.r AND gone.i = pos.i WHERE gone.i IS NULL GROUP BY pos.r)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
 sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM x LEFT JOIN per USING (r) LEFT JOIN best AS b USING (r) LEFT JOIN kept USING (r)"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where the words of every tenth id, by crc32, repeat from one word on."""
    h = F.crc32(docs["doc_id"].cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        a = g % F.size(w)
        p = F.lit(1) + F.floor((F.size(w) - a) / (g % 8 + 3))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), F.size(w) - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    text = text_or_empty(docs)
    planted = let(split_words(text), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(text).alias("text"))


@_query("op12_periodic_runs", _RUNS_SQL)
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.array_join(F.array(x["start"], x["length"], x["period"]), ","), F.lit("\n"))), "")
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query("op13_language_id")
def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = docs.withColumn("held_out", byte_cnn.held_out(F.col("doc_id"))).select(F.struct("doc_id", "held_out").alias("doc"), "text")
    found = byte_cnn.predict(named, byte_cnn.train(docs), id_col="doc")
    return found.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")
