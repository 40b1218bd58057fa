"""Phrases, runs and languages against plain statements of the same results."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from labspark.llm import byte_cnn, collocations, periodic_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, longest, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang or "und"][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in counts.items()):
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i + 1, *row[3:]) for i, row in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    words = ["the", "of", "New", "york", "Ünïon", "x-1", "中文", "\x85", "a\tb"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "  "]) for _ in range(60)), rng.choice(["en", "en", "de", None])) for _ in range(20)]
    rows += [(None, "en"), ("", None), ("alone", "fr"), ("same same same same same same", "en"), (" \t., ", "en")]
    return rows + [rows[0]] * 9 + [("very frequent pair of words " * 3_000, "en")]


@pytest.mark.parametrize("hot,bits", [(1 << 16, 1 << 26), (5, 64)])  # cut stripes and a bitmap that is full change nothing
def test_collocations(spark, hot, bits):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "w", "p") for r in rows], "text string, lang string, words string, prefix string").repartition(3)
    got = collocations.collocations(docs, min_count=4, max_words=4, filter_bits=bits, hot_count=hot).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 4, 4)
    shorter = collocations.collocations(docs, min_count=2, max_words=3, top=5, filter_bits=bits, hot_count=hot).collect()
    assert sorted(tuple(r) for r in shorter) == plain_collocations(rows, 2, 3, 5)


def test_collocations_of_nothing(spark, docs, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(docs, min_count=10**9).collect() == []
    assert collocations.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_runs(words, least=6, periods=4):
    """Period by period; an interval found for several periods belongs to the smallest."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                if i - start + q >= max(least, periods * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_of_runs(rng, most=9):
    words = []
    for _ in range(rng.randrange(0, 6)):
        unit = [str(rng.randrange(rng.choice([1, 2, 3, 10]))) for _ in range(rng.randrange(1, most))]
        if rng.random() < 0.3:
            unit *= rng.randrange(1, 8)
        words += unit * rng.randrange(1, 8)
        words = words[:len(words) - rng.randrange(0, 3)]
    return words


def test_block_runs():
    rng = random.Random(12)
    for _ in range(400):
        texts = [made_of_runs(rng) for _ in range(rng.randrange(1, 5))]
        got = periodic_runs._block([[w.encode() for w in t] for t in texts], 6, 4)
        assert [r for r, _ in got] == [plain_runs(t) for t in texts]
        assert [c.decode() for _, c in got] == [plain_collapse(t, r) for t, (r, _) in zip(texts, got)]


def test_grammar_gives_the_text_back():
    rng = random.Random(3)
    words = [int(x) for x in made_of_runs(rng, 30) + ["7"] * 100 + made_of_runs(rng, 30)]
    n = len(words)
    symbol, place, first, cut, size = periodic_runs.derive(np.array(words), np.zeros(n, int))
    for s, p in zip(symbol.tolist(), place.tolist()):  # every place of a nonterminal reads the same
        assert words[p:p + size[s]] == words[first[s]:first[s] + size[s]]
        assert first[s] < cut[s] < first[s] + size[s]
    assert sorted(set(cut.tolist())) == sorted({cut[s] for s in symbol.tolist()})
    assert {int(p + cut[s] - first[s]) for s, p in zip(symbol, place)} == set(range(1, n))  # every boundary is the cut of a node
    assert len(size) < n / 2  # repeats are shared


def test_periodic_runs(spark, docs, rows, empty):
    rng = random.Random(5)
    texts = [" \n".join(made_of_runs(rng)) for _ in range(60)] + ["ab " * 50_000, "中 文 " * 9 + "\x85 x"]
    more = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(texts)] + [(1000, texts[0])] * 2
    source = docs.sparkSession.createDataFrame([(*m, "r", "b") for m in more], "doc_id long, text string, runs string, best string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in periodic_runs.periodic_runs(source).collect()), key=str)
    want = []
    for i, t in more:
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        runs = plain_runs(words) if len(words) < 5_000 else [(0, len(words), 1)] if len(set(words)) == 1 else []
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want.append((i, len(words), runs, best, plain_collapse(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=3)


def made_of_syllables(rng, lang, n):
    parts = {"aa": ["ba", "lo", "mi", "ter"], "bb": ["sch", "ung", "ä", "ein"], "cc": ["ção", "ar", "os", "que"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_byte_cnn(spark, docs, rows, empty):
    rng = random.Random(13)
    langs = ["aa", "aa", "aa", "bb", "cc"]  # one language is frequent
    data = [(i, made_of_syllables(rng, lang, rng.choice([3, 20, 400])), lang) for i, lang in enumerate(rng.choice(langs) for _ in range(500))]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 .. 3", "cc"), (1003, data[0][1], None), (None, data[1][1], "bb"), (1004, "中", None), data[3], data[3],
           (1005, made_of_syllables(rng, "cc", 40_000), None)]
    source = spark.createDataFrame([(*r, "p", "s", 0.5) for r in data + odd], "doc_id long, text string, lang string, lang_pred string, h string, score double").repartition(4)
    model = byte_cnn.train(source, per_lang=60)
    assert model.langs == ["aa", "bb", "cc"]
    got = byte_cnn.predict(source, model).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    known = [(i, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(known) > 80 and sum(by_id[i].lang_pred == lang for i, lang in known) >= 0.97 * len(known)
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1005].lang_pred == "cc" and by_id[1003].lang_pred == data[0][2] and by_id[1004].lang_pred in model.langs

    again = byte_cnn.train(source.repartition(2), per_lang=60)
    assert all((a == b).all() for a, b in zip([model.out, *sum(model.tables, [])], [again.out, *sum(again.tables, [])]))
    assert byte_cnn.train(empty) is None and byte_cnn.train(source.filter("lang IS NULL")) is None
    assert byte_cnn.predict(empty, model).collect() == []
    assert {(r.lang_pred, r.score) for r in byte_cnn.predict(docs, None).collect()} == {("und", 0.0)}
    one = byte_cnn.predict(docs, byte_cnn.train(docs)).collect()  # one language only
    assert {r.lang_pred for r in one} == {"en", "und"} and len(one) == len(rows)


def test_byte_cnn_pools_every_byte():
    """Pair tables and aligned windows against filters applied place by place."""
    rng = np.random.default_rng(1)
    model = byte_cnn.fit(["a", "b"] * 4, [b"one two", "drei vierä".encode()] * 4, rounds=1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 253, 0, 254, 256, 700, 255)]
    classes, first = byte_cnn.lay_out(texts)
    got = byte_cnn.pooled(classes, model.pairs())
    for text, a, b in zip(texts, first[:-1], first[1:]):
        c = byte_cnn._CLASS[np.frombuffer(text + bytes(byte_cnn.WINDOW * 2), np.uint8)]
        for w in range(b - a):
            want = [max(float(sum(t[c[p + j], f] for j, t in enumerate(ts))) for p in range(w * byte_cnn.WINDOW, (w + 1) * byte_cnn.WINDOW)) for ts in model.tables for f in range(byte_cnn.FILTERS)]
            assert np.allclose(got[a + w], want, atol=1e-5)


def test_byte_cnn_learns_by_the_right_slope():
    """One step of training lowers the loss along the numeric gradient's direction."""
    rng = random.Random(2)
    langs = [rng.choice(["aa", "bb", "cc"]) for _ in range(120)]
    texts = [made_of_syllables(rng, lang, 30).encode()[:250] for lang in langs]
    losses = []
    for rounds in (0, 5, 30):
        model = byte_cnn.fit(langs, texts, rounds=rounds)
        p = byte_cnn.probabilities(model, texts)
        losses.append(-np.log(p[np.arange(120), [model.langs.index(x) for x in langs]] + 1e-12).mean())
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1
