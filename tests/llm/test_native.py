"""Operators made of DataFrame functions alone: license scan, line dedup, quality rules, sharding, mixing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from labspark.llm import license_scan, line_dedup, mixing, quality_rules, sharding
from labspark.llm.text import text_or_empty


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def bag(rows):
    return Counter(map(tuple, rows))


def test_quality_rules(docs, rows, empty):
    want = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        lines = [x for x in t.split("\n") if words(x)]
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i:i + 8])].append(i)
        covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))] += 1
    got = quality_rules.quality_rules(docs)
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == want
    found = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert found[0].failed_rules[0] == "few_words" and not found[0].passes
    assert quality_rules.quality_rules(empty).count() == 0
    strict = (quality_rules.Rule("short", "n_words", low=1, high=2),)
    assert {r.doc_id for r in quality_rules.quality_rules(docs, strict).filter("passes").collect()} >= {3, 5}


def test_license_places(docs, rows, empty):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    want = Counter()
    for r in rows:
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1]))
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i:i + len(p)] == p]
        starts = [i for i, _ in at]
        want[(r[0], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at})))] += 1
    got = license_scan.scan(docs)[1].withColumn("base_labels", F.array_join("base_labels", ","))
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    assert license_scan.scan(empty)[1].count() == 0


def test_license_merges_neighbouring_diagonals(spark):
    d = spark.createDataFrame([(1, "x Licensed under the GNU brand new General Public License, version 3."), (2, "licensed under the sun"), (3, "mit license " * 500)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d)[1].collect()}
    assert "gpl-3.0" in got[1].labels and got[1].score == 1.0
    assert got[2].labels == [] and 0 < got[2].score < 0.7
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (500, 0, 998)


def test_line_dedup(docs, rows, empty):
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(x)) >= 20:
                holders[key(x)].add(r[0])
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or keeper.get(key(x), r[0]) <= r[0]]
        want[(r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert bag(out.select("doc_id", "_lines.n", "_lines.dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()) == want
    assert out.columns[:-1] == docs.columns
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_sharding(docs, rows, empty):
    for k in (1, 5, 200):
        got = sharding.stratified_shards(docs, k, carry={"source": docs["source"], "crc": F.crc32(text_or_empty(docs))}).collect()
        assert Counter((r.doc_id, r.crc) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        sizes = [len(by[s]) for s in range(k)]
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        for s, n in Counter(r[3] for r in rows).items():
            share = [sum(r.source == s for r in by[x]) for x in range(k)]
            assert max(share) - min(share) <= 2 and abs(max(share) - n / k) <= 2
    first = sharding.stratified_shards(docs, 5).collect()
    assert bag(first) == bag(sharding.stratified_shards(docs.repartition(7), 5).collect())
    assert sharding.stratified_shards(empty, 5).count() == 0


def targets(sizes):
    """Straightforward resharing of the excess, for comparison."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, limit, done = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sizes[s] for s in sizes}, {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(done.values())
        open_ = [s for s in order if s not in done]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit[s]]
        if not over:
            return done | share
        done |= {s: limit[s] for s in over}


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    out = mixing.mix(docs, min_block_words=500, shards=4, carry={"source": docs["source"]}).collect()
    taken, places = Counter(), set()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.size if r.copy else 0
        if r.copy:
            assert r.copy <= 2 and 0 <= r.shard < 4 and (r.source, r.place, r.copy, r.doc_id) not in places
            places.add((r.source, r.place, r.copy, r.doc_id))
    assert len({(r.doc_id, r.place, r.source, r.size) for r in out}) <= len(rows) and {r.doc_id for r in out} == {r[0] for r in rows}
    biggest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[s] - want[s]) <= biggest / 2 for s in sizes)
    again = mixing.mix(docs.repartition(5), min_block_words=500, shards=4, carry={"source": docs["source"]}).collect()
    assert bag(out) == bag(again)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_splitting_tree():
    blocks = np.array([1000, 0, 7, 350])
    quotas = mixing.split_quotas(blocks, 7, 3)
    assert (quotas.sum(1) == blocks).all() and np.ptp(quotas.sum(0)) <= 3
    assert (quotas == mixing.split_quotas(blocks, 7, 3)).all() and (quotas[0] > 100).all()
