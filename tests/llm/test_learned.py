"""Classifier, language model, tokenizer, neighbours, near-duplicate join and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labspark.llm import byte_bpe, components, interpolated_lm as lm, jaccard_join, one_bit_ann, quality_gam as gam

LINE = "A shared line that stands in many texts here."


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- byte-level BPE

@pytest.fixture(scope="module")
def bpe():
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    by_id, ids = byte_bpe.tables(open(path, "rb").read())
    return path, tokenizers.PATTERN, by_id, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})


def test_bpe_round_trip(docs, rows, empty, bpe):
    path, pattern, by_id, reference = bpe
    want = Counter()
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, path, pattern).collect())) == want
    assert byte_bpe.round_trip(empty, path, pattern).count() == 0
    encoded = byte_bpe.encode(docs.filter("doc_id < 9"), path, pattern, offsets=True)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] < 9}
    assert {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode_ids(encoded, path).collect()} == texts
    for r in encoded.collect():
        assert "".join(byte_bpe.decode_pieces(r.ids, by_id)) == texts[r.doc_id]
        assert not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(texts[r.doc_id]))


def test_bpe_random_text(bpe):
    path, pattern, _, reference = bpe
    raw, rng = open(path, "rb").read(), random.Random(2)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x2fff), rng.randrange(0xe000, 0x1ffff), 32, 10, 39])) for _ in range(rng.randrange(30)))
        assert list(byte_bpe._encode([text], raw, pattern))[0] == reference.encode_ordinary(text)


# --- nearest neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 24))
    x[100:400] = x[100]  # many ties
    table = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [None] * 24), (2100, [1.0] * 3), (None, table[0][1]), table[40], table[40]]
    d = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>").withColumns({"code": F.lit(1), "v": F.lit(2), "qb": F.lit(3)})
    got = defaultdict(list)
    for r in one_bit_ann.nearest(d, F.col("vec_id") % 20 == 0, query_block=25, row_block=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    hit = 0
    for q, found in got.items():
        score = one_bit_ann.products(x, x[q])
        best = [i for i in np.lexsort((np.arange(1200), -score)) if i != q][:20]
        hit += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and all(s == score[i] for i, s in found)
    assert hit >= 0.99 * 20 * len(got)
    assert one_bit_ann.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert one_bit_ann.nearest(d.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


# --- quality classifier

def test_gam_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = gam.fit_gam(x[:3000], y[:3000])
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_gam_scores(spark, docs, rows, empty):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["river", "stone", "the", "and", "of", "tall"]) for _ in range(60))) for i in range(300)]
    junk = [(i, " ".join(["!!!"] * rng.randrange(20, 50))) for i in range(300, 400)]
    d = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = gam.train(d, labels)
    scored = gam.score(d, model).withColumn("held", gam.held_out(F.col("doc_id"))).collect()
    assert all((r.score >= 0.7) == (r.doc_id < 300) for r in scored if r.held)
    flipped = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in gam.score(d, gam.train(d, flipped)).collect()} == {r.doc_id: r.score for r in scored}
    every = gam.score(docs, model).collect()
    assert Counter(r.doc_id for r in every) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in every)
    assert gam.score(empty, model).count() == 0 and gam.keep_good(docs, labels).columns == docs.columns
    untrained = gam.train(d, labels.limit(0))
    assert {r.score for r in gam.score(d, untrained).collect()} == {0.5} and gam.keep_good(d, labels.limit(0)).count() == 400


# --- language model

def model_by_hand(texts, held):
    tokens = [[w for w in re.split("[\x20\x09-\x0D]+", lower(t)) if w] + ["\0end"] for t in texts]
    one, two = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["\0start", *t], t, strict=False))
    context = Counter()
    for (a, _), n in two.items():
        context[a] += n
    total, kinds = sum(one.values()), len(one)
    cells = Counter()
    for (a, b), n in two.items():
        cells[tuple(lm.unrounded(lm.rounded(np.array([context[a], one[b], n]))))] += n
    cells = pd.DataFrame([(*k, n) for k, n in sorted(cells.items())], columns=["context", "word", "pair", "weight"])
    weights = lm.learn_weights(cells, total, kinds)
    out = []
    for t in tokens:
        base = sum(np.log10((one[w] + 1) / (total + kinds + 1)) for w in t)
        score = 0.0
        for a, b in zip(["\0start", *t], t, strict=False):
            w = weights[lm.context_bucket(np.array([context[a]]))[0]]
            score += np.log10(w[0] * two[a, b] / max(context[a], 1) + w[1] * one[b] / max(total, 1) + w[2] / (kinds + 1))
        out.append((len(t), sum(one[w] > 0 for w in t), total, base, score))
    return out


def test_language_model(docs, rows, empty):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    want = sorted(((r[0] is None, r[0] or 0, h, *v) for r, h, v in zip(rows, held, model_by_hand([r[1] for r in rows], held), strict=True)), key=str)
    for tokens, size in ((5_000, 40_000), (2_000_000, 16_000_000)):
        got = lm.score(docs, chunk_tokens=tokens, bucket_bytes=size).collect()
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
        assert [g[:6] for g in got] == [w[:6] for w in want]
        assert np.allclose([g[6:] for g in got], [w[6:] for w in want], rtol=1e-6)
    assert lm.score(empty).count() == 0
    none = lm.score(docs, out_of_training=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 for r in none)


def test_better_than_base_on_held_out(spark):
    rng = random.Random(5)
    chain = {w: rng.sample(range(40), 3) for w in range(40)}

    def text():
        w, out = rng.randrange(40), []
        for _ in range(80):
            w = rng.choice(chain[w])
            out.append(f"w{w}")
        return " ".join(out)

    d = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    held = lm.score(d).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > 0.6 * held.b  # both negative


# --- near duplicates

def links_by_hand(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        sets[k] = frozenset(tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))) if w and i is not None else frozenset()
    n, links = len(rows), defaultdict(set)
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    group = list(range(n))
    for _ in range(n):
        new = [min([group[a], *(group[b] for b in links[a])]) for a in range(n)]
        if new == group:
            break
        group = new
    least = {g: min(rows[a][0] for a in range(n) if group[a] == g) for g in set(group) if all(rows[a][0] is not None for a in range(n) if group[a] == g)}
    return Counter((rows[a][0], least.get(group[a]), len(links[a])) for a in range(n))


@pytest.mark.parametrize("block", [8, 512])
def test_join(docs, rows, empty, block):
    got = jaccard_join.near_duplicates(docs, block=block)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == links_by_hand([r[:2] for r in rows])
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in jaccard_join.keep_one(docs, block=block).collect()]
    assert {r.class_id for r in got.collect() if r.class_id is not None} == {i for i in kept if i is not None}


def test_prefixes_shorten():
    assert jaccard_join.prefix_depth(0.8, 25, 10, 0.999) == 6 and jaccard_join.prefix_depth(0.5, 25, 10, 0.999) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)] + [(500, 500 + k) for k in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 100 and all(got[500 + k] == 500 for k in range(50))


# --- pipeline

def test_pipeline(spark, tmp_path, bpe):
    import corpus_pipeline
    rng = random.Random(9)
    vocabulary = ["river", "stone", "the", "and", "of", "tall", "green", "hill", "over", "runs", "a", "to"]
    texts = {i: " ".join(rng.choice(vocabulary) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(80)) for i in range(120)}
    for i in range(30, 60):
        texts[i] += "\n" + LINE
    for i in range(90, 100):
        texts[i] = texts[89]  # copies
    for i in range(100, 105):
        texts[i] = texts[88] + f" tail{i}"  # near copies
    junk = {i: " ".join(["!!!"] * 40) for i in range(120, 160)}
    table = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in {**texts, **junk}.items()] + [(400, None, None, None, None), (401, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120)) for i in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path)).cache()
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in d.collect()}
    model = gam.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    every = [r[0] for r in table]
    points = model.scores(np.array([gam.features(r[1] or "") for r in table]))
    assert set(seen["quality_classifier"]) == {i for i, p in zip(every, points, strict=True) if p >= 0.7} >= set(texts)
    lines = seen["line_dedup"]
    assert [i for i, t in lines.items() if t and LINE in t] == [59] or sum(LINE in (t or "") for t in lines.values()) == 1
    groups = links_by_hand(list(lines.items()))
    assert set(seen["jaccard_join"]) == {c if c is not None else i for i, c, _ in groups}
    out = Counter(r.doc_id for r in d.collect())
    assert max(out.values()) <= 2 and set(out) <= set(seen["jaccard_join"])
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in result) == out
    for r in result:
        text = lines[r.doc_id] or ""
        assert r.n_tokens == len(bpe[3].encode_ordinary(text)) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_merges_each_word_once(bpe, monkeypatch):
    path, pattern, _, reference = bpe
    raw, seen, merge = open(path, "rb").read(), [], byte_bpe.merged
    texts = ["one two  three\n", "three two one two", "", "x" * 200 + " one", "x" * 200 + " é世 one"]
    want = [reference.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "merged", lambda words, ranks: seen.extend(words) or merge(words, ranks))
    byte_bpe.remembered(raw).clear()
    assert list(byte_bpe._encode(texts, raw, pattern)) == want
    assert [seen.count(w) for w in (" two", " three", " one")] == [1, 1, 1] and seen.count("x" * 200) == 2  # too long to keep
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)  # the memory starts anew again and again
    assert list(byte_bpe._encode(texts * 3, raw, pattern)) == want * 3 and len(byte_bpe.remembered(raw)) <= 9
