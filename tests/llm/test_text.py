"""Words, language-model scores, licenses, leaks, language ID, repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession, functions as F

from poolwright.llm import automaton, decontaminate, langid, licenses, queries, suffixes, textnp


def plain_words(text):
    b = (text or "").encode()
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b).split()


# --- words ----------------------------------------------------------------------

def test_words_and_grams():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "B", "é", " ", "\t", "\n", "\x0b", "\x1c", "\x85", " ", "\U0001f600"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [None, "", " ", "x" * 5000]
    seen = {}
    n = 0
    for size in (1, 40, 1 << 20):
        for first, last, data, offsets in textnp.chunks(pa.array(texts), size):
            w = textnp.words(data, offsets)
            for i in range(first, last):
                a, b = w.bounds[i - first], w.bounds[i - first + 1]
                want = plain_words(texts[i])
                assert b - a == len(want)
                for h, x in zip(w.hash[a:b].tolist(), want, strict=True):
                    assert seen.setdefault(x, h) == h
                n += 1
    assert n == 3 * len(texts) and len(set(seen.values())) == len(seen)
    assert list(textnp.chunks(pa.array([], pa.string()))) == []
    data = np.frombuffer(b"a b c d a b", np.uint8)
    w = textnp.words(data, np.array([0, 7, 11]))
    assert [len(s) for s in textnp.gram_sets(w, 2)] == [3, 1] and textnp.grams(w.hash, 2)[0] == textnp.grams(w.hash, 2)[4]
    sliced = pa.array(["aa", "b c", "d"]).slice(1)
    (first, last, data, offsets), = textnp.chunks(sliced)
    assert (first, last, bytes(data), offsets.tolist()) == (0, 2, b"b cd", [0, 3, 4])


# --- language model ----------------------------------------------------------------

def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def plain_scores(rows, k=automaton.K[0]):
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    tokens = [(i, [*plain_words(t), 0]) for i, t in rows]
    uni, pairs, begins = Counter(), Counter(), 0
    for i, w in tokens:
        if trains(i):
            uni.update(w)
            pairs.update(zip([1, *w], w))
            begins += 1
    n, v = sum(uni.values()), len(uni)
    p = lambda x: (uni[x] + 0.5) / (n + 0.5 * (v + 1))
    at = lambda u: begins if u == 1 else uni[u]
    return [(i, not trains(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), sum(math.log10((pairs[u, x] + k * p(x)) / (at(u) + k)) for u, x in zip([1, *w], w))) for i, w in tokens]


@pytest.mark.parametrize("batch_bytes", [5000, 1 << 20])
def test_scores(spark, messy, batch_bytes):
    rnd = random.Random(2)
    rows = [(100 + i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 20)))) for i in range(80)] + [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = automaton.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out=held_out(), batch_bytes=batch_bytes, order=2).collect()
    got, want = (sorted(map(tuple, x), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6])) for x in (out, plain_scores(rows)))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-11, abs=1e-9)


def plain_backoff(rows, order, weights=automaton.K):
    """Scores by dictionaries of runs, with a begin mark before each text."""
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    runs, texts = Counter(), [(i, [1, *plain_words(t), 0]) for i, t in rows]
    for i, w in texts:
        if trains(i):
            runs.update(tuple(w[a : a + m]) for m in range(1, order + 1) for a in range(len(w) - m + 1))
    n, v = sum(c for r, c in runs.items() if len(r) == 1 and r != (1,)), sum(len(r) == 1 and r != (1,) for r in runs)

    def p(u, x):
        if not u:
            return (runs[x,] + 0.5) / (n + 0.5 * (v + 1))
        k = weights[min(len(u), len(weights)) - 1]
        return (runs[*u, x] + k * p(u[1:], x)) / (runs[u] + k)

    return {i: sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w))) for i, w in texts}


@pytest.mark.parametrize("batch_bytes", [5000, 1 << 20])
def test_longer_contexts(spark, batch_bytes):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 15)))) for i in range(60)]
    rows += [(60 + i, " ".join(rnd.choice(words) for _ in range(n))) for i, (n, words) in enumerate([(3000, "abcd"), (1500, [f"w{i}" for i in range(40)]), (256, "ab"), (257, "ab"), (1500, [f"w{i}" for i in range(40)])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (1, 3, 4):
        got = {r["doc_id"]: r["score"] for r in automaton.score_texts(docs, held_out=held_out(), batch_bytes=batch_bytes, order=order).collect()}
        assert got == pytest.approx(plain_backoff(rows, order), rel=1e-11, abs=1e-9)


def test_the_query_looks_back_two_words(spark):
    df = queries.op6_lm_scoring(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_backoff([(r["doc_id"], r["text"]) for r in docs.collect()], 3)
    assert {r["doc_id"]: r["score"] for r in df.collect()} == pytest.approx(want, rel=1e-9)


def test_arcs_of_a_state_sum_to_one(spark):
    """Over the words of training and one unseen word, from any state."""
    train = [(0, "a b a c"), (2, "b a")]
    words = ["a", "b", "c", "unseen"]
    rows = train + [(1000 + i, f"{u} {w}".strip()) for i, (u, w) in enumerate((u, w) for u in ["", "a", "b", "c"] for w in words)]
    held = F.col("doc_id") >= 1000
    s = {r["doc_id"]: r["score"] for r in automaton.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held_out=held, weights=(3.0,), order=2).collect()}
    uni = Counter("a b a c".split() + "b a".split() + [0, 0])
    pairs = Counter([(1, "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", 0), (1, "b"), ("b", "a"), ("a", 0)])
    p = lambda x: (uni[x] + 0.5) / (8 + 0.5 * 5)
    q = lambda u, x: (pairs[u, x] + 3 * p(x)) / ((2 if u == 1 else uni[u]) + 3)
    i = 0
    for u in [1, "a", "b", "c"]:
        assert sum(q(u, x) for x in [*words, 0]) == pytest.approx(1)
        for w in words:
            want = (math.log10(q(1, u)) if u != 1 else 0) + math.log10(q(u, w)) + math.log10(q(w, 0))
            assert s[1000 + i] == pytest.approx(want)
            i += 1


def test_better_than_its_base_on_held_out_texts(spark):
    df = automaton.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), held_out=held_out())
    r = df.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_no_rows_to_score(empty):
    assert automaton.score_texts(empty, held_out=held_out()).count() == 0


# --- licenses ---------------------------------------------------------------------

def plain_license_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_licenses_in_any_place(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for i in range(200):
        filler = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(0, 400))]
        name, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        words = text.split()
        if i % 4 == 3 and len(words) > 12:
            words[rnd.randrange(len(words))] = "changed"
        k = rnd.randint(0, len(filler))
        whole = " ".join(filler[:k] + [w.upper() if rnd.random() < 0.3 else w for w in words] + filler[k:])
        rows.append((i, whole))
        grams, have = shingles(plain_license_words(text)), shingles(plain_license_words(whole))
        if len(grams & have) >= 0.8 * len(grams):
            want[i, name] = (len(grams & have), len(grams))
    rows += [(500 + i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(300))) for i in range(50)]
    got = {(r["doc_id"], r["license"]): (r["n_found"], r["n_template"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got.get(k) for k in want} == want and not any(k[0] >= 500 for k in got)
    for i, name in got:
        assert any(n == name and len(shingles(plain_license_words(t)) & shingles(plain_license_words(rows[i][1]))) >= 0.8 * len(shingles(plain_license_words(t))) for n, t in licenses.TEMPLATES)


def test_short_templates_are_never_missed(spark, monkeypatch):
    """Even where no window's minima meet the template's."""
    monkeypatch.setattr(licenses, "min_hashes", lambda grams, stride: np.full((-(-len(grams) // stride), 64), len(grams) == stride, np.uint32))
    docs = [(i, " ".join(f"x{i}y{k}" for k in range(i)) + " Released under the MIT License " + "tail " * 30) for i in range(20)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("license = 'MIT'").collect()
    assert sorted((r["doc_id"], r["first_word"], r["last_word"]) for r in got) == [(i, i, i + 4) for i in range(20)]


def test_licenses_messy(spark, messy, empty):
    assert licenses.scan(messy).count() == 0 and licenses.scan(empty).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "x Licensed\nunder CC-BY NC 4.0 y"), (3, "the MIT License"), (None, "Released under the MIT License")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in got), key=repr) == sorted([(1, "MIT", 0, 4), (1, "MIT", 0, 4), (2, "CC-BY-NC-4.0", 1, 7), (None, "MIT", 0, 4)], key=repr)
    short = licenses.scan(spark.createDataFrame([(1, "public domain"), (2, "in the public domain")], "doc_id long, text string"), templates=(("PD", "Public Domain"),))
    assert [r["doc_id"] for r in short.collect()] == [1]


# --- benchmark leaks ------------------------------------------------------------------

def plain_align(text, item):
    best, table = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment():
    rnd = random.Random(4)
    for _ in range(300):
        text, item = ([rnd.randrange(6) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        score, start, end = decontaminate.align(np.array(text, np.uint64), np.array(item, np.uint64))
        assert score == plain_align(text, item) and plain_align(text[start:end], item) == score


def leak_corpus():
    rnd = random.Random(5)
    common = ["the", "of", "and", "in", "to"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else f"v{rnd.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rnd.randint(15, 55)))) for i in range(30)]
    docs, truth = [], set()
    for d in range(300):
        w = [word() for _ in range(rnd.randint(0, 500))]
        for i in rnd.sample(range(30), rnd.choice([0, 0, 1, 2])):
            passage = items[i][1].split()
            for _ in range(len(passage) // 12 if d % 2 else 0):
                k = rnd.randrange(len(passage))
                passage[k : k + 1] = rnd.choice([[], ["edit"], ["edit", "ed"]])
            k = rnd.randint(0, len(w))
            w[k:k] = [x.upper() for x in passage]
            truth.add((d, i))
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_leaks_are_found_and_clean_texts_left(spark):
    docs, items, truth = leak_corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(df, bench).collect()}
    wrong = {(d, i) for d, i in set(got) ^ truth if (plain_align(plain_words(docs[d][1]), plain_words(items[i][1])) >= 0.8 * len(items[i][1].split())) != ((d, i) in got)}
    assert not wrong
    assert truth <= set(got)
    for (d, i), r in got.items():
        piece = plain_words(docs[d][1])[r["start_word"] : r["end_word"]]
        assert r["full_score"] == 2 * len(items[i][1].split()) and plain_align(piece, plain_words(items[i][1])) == r["score"]
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_a_passage_in_most_texts_is_still_found(spark):
    item = "every single copy of this leaked passage must be found however often it occurs in the corpus at hand"
    docs = [(i, f"a{i} b{i} {item} c{i}") for i in range(400)] + [(400 + i, f"a{i} b{i} plain text of its own {i}") for i in range(100)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(400))


def test_excerpts_of_long_items(spark):
    """Copied words count however little of the item they are."""
    rnd = random.Random(9)
    word = lambda: rnd.choice(["the", "of", "and", "in", "to"]) if rnd.random() < 0.3 else f"v{rnd.randrange(3000)}"
    item = [word() for _ in range(400)]
    copied = {0: 150, 1: 100, 2: 40, 3: 12}
    docs = [(d, " ".join([word() for _ in range(200)] + item[90 : 90 + copied.get(d, 0)] + [word() for _ in range(200)])) for d in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_leaks(df, bench).collect()} == {0, 1, 2}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == set(range(3, 60))


def test_blocks_of_items(spark, monkeypatch):
    docs, items, _ = leak_corpus()
    df, bench = spark.createDataFrame(docs[:80], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert sorted(map(tuple, decontaminate.find_leaks(df, bench).collect())) == whole


def test_seeds_that_many_items_share(spark):
    """A common beginning is a seed only as long as it must be; what tells items
    apart finds them, and leaks do not depend on how items are blocked."""
    rnd = random.Random(12)
    head = "please read the text below and answer the question that follows in one word"
    items = [(i, head + " " + " ".join(rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randrange(50)) for _ in range(25))) for i in range(40)]
    block = [(i, textnp.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).hash) for i, t in items]
    vocabulary = np.unique(np.concatenate([h for _, h in block]))
    seeds = decontaminate.Seeds(block, 10**6, vocabulary, np.ones(len(vocabulary), np.int64))
    for n, (hashes, _, _, _) in seeds.table.items():
        shared = [c for c in Counter(hashes.tolist()).values() if c > decontaminate.ITEMS]
        assert n == decontaminate.LONGEST or not shared
    docs = spark.createDataFrame([(i, f"x{i} " * 30 + t + f" y{i}" * 30) for i, t in items] + [(100, head + " nothing of it"), (101, "clean " * 50)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, table, least=0.6).collect()}
    assert found == {(i, i) for i in range(40)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, table, least=0.6).collect()} == {100, 101}


def test_leaks_messy(spark, messy, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "lost id text of some words here"), (4, "one"), (4, "a b c d")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(messy, bench).collect()), key=repr)
    assert got == sorted([(None, 3), (4, 4), (5, 4), (6, 4), (11, 4), (12, 4)], key=repr)
    clean = decontaminate.drop_leaks(messy, bench)
    assert clean.columns == messy.columns and clean.count() == messy.count() - 6
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(messy, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(messy, bench.limit(0)).count() == messy.count()


# --- language ID -----------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    model = langid.fit(train)
    records = langid.document_records(test).withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    out = langid.identify(records, model)
    n, right, kept = out.agg(F.count("*"), F.count_if(F.col("truth") == F.col("language")), F.count_if("kept")).first()
    assert right >= 0.98 * n and kept >= 0.98 * n


def test_evidence_fuses(spark):
    """A short text that could be either follows its host, suffix or markup."""
    rnd = random.Random(6)
    en, de = (lambda: " ".join(rnd.choice(["the", "and", "with", "that"]) for _ in range(40))), (lambda: " ".join(rnd.choice(["der", "und", "mit", "dass"]) for _ in range(40)))
    train = spark.createDataFrame([(i, en() if i % 2 else de(), "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    page = lambda i, host, path, lang, text: (i, f"http://{host}{path}", f'<html lang="{lang}"><body>{text}' if lang else f"<p>{text}")
    pages = [page(i, f"h{i % 5}.en.example", "/x", None, en()) for i in range(50)] + [page(100 + i, f"h{i % 5}.de.example", "/de/x" if i % 2 else "/x", "de" if i % 3 else None, de()) for i in range(50)]
    pages += [page(200, "h1.de.example", "/x", None, "zzzz"), page(201, "h1.en.example", "/x", None, "zzzz"), page(202, "new.en.example", "/y", None, "zzzz"), page(203, "unknown.net", "/de/1", None, "zzzz"), page(204, "unknown.net", "/", "DE", "zzzz"), (205, None, None), (206, "", "")]
    out = {r["page_id"]: r for r in langid.identify(langid.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    assert [out[i]["language"] for i in (200, 201, 202, 203, 204)] == ["de", "en", "en", "de", "de"]
    assert all(out[i]["language"] == ("en" if i < 100 else "de") and out[i]["kept"] for i in (*range(50), *range(100, 150)))
    assert not out[205]["kept"] and not out[206]["kept"] and out[204]["declared"] == "de" and out[203]["suffix"] == "de"


def plain_identify(records, trained, least=0.6):
    """(id, text, declared, host, suffix) judged by dictionaries; ``trained``:
    (text, language).  Returns id -> language, posterior, kept."""
    grams = lambda t: [int(x) for x in langid.buckets(np.frombuffer((t or "").encode(), np.uint8))] if len((t or "").encode()) > 2 else []
    langs = sorted({x for _, x in trained})
    counts = {x: Counter(g for t, y in trained if y == x for g in grams(t)) for x in langs}
    total = {x: sum(counts[x].values()) + 0.05 * langid.BUCKETS for x in langs}
    log_p = lambda g, x: math.log((counts[x][g] + 0.05) / total[x])
    ll = [[sum(log_p(g, x) for g in grams(t)) for x in langs] for _, t, *_ in records]
    size, floor = [len((r[1] or "").encode()) for r in records], -math.log(langid.BUCKETS)
    top = [l.index(max(l)) if n >= 20 and max(l) > floor * n else None for l, n in zip(ll, size)]

    def tally(values):
        out = {}
        for v, t in zip(values, top):
            if v is not None and t is not None:
                out.setdefault(v, [0.0] * len(langs))[t] += 1
        return out

    def smooth(c, above):
        return [(x + langid.PRIOR * p) / (sum(c) + langid.PRIOR) for x, p in zip(c, above)]

    by_host = tally([r[3] for r in records])
    add = lambda rows: [sum(c) for c in zip(*rows)]
    whole = [x + langid.CELL for x in add(by_host.values())]
    whole = [x / sum(whole) for x in whole]
    domain = lambda h: ".".join(h.split(".")[-2:])
    tops = {k: smooth(add(c for h, c in by_host.items() if h.split(".")[-1] == k), whole) for k in {h.split(".")[-1] for h in by_host}}
    domains = {k: smooth(add(c for h, c in by_host.items() if domain(h) == k), tops[k.split(".")[-1]]) for k in {domain(h) for h in by_host}}
    priors = {h: smooth(c, domains[domain(h)]) for h, c in by_host.items()}

    def confusion(values):
        rows = tally(values)
        sums = [x + langid.CELL * (len(rows) + 1) for x in add(rows.values())] if rows else []
        return {v: [(x + langid.CELL) / s for x, s in zip(c, sums)] for v, c in rows.items()}

    declared, suffix = confusion([r[2] for r in records]), confusion([r[4] for r in records])
    out = {}
    for r, l, n in zip(records, ll, size):
        one = [1.0] * len(langs)
        fused = [langid.TEMPER * a + math.log(p) + math.log(d) + math.log(s) for a, p, d, s in zip(l, priors.get(r[3], whole), declared.get(r[2], one), suffix.get(r[4], one))]
        share = [math.exp(x - max(fused)) for x in fused]
        post = round(1 / sum(share), 6)
        out[r[0]] = (langs[fused.index(max(fused))], post, n >= 3 and max(l) > floor * n and post >= least)
    return out


def test_langid_against_plain_counts(spark):
    rnd = random.Random(21)
    stems = {"en": ["the", "house", "with", "water"], "de": ["das", "haus", "mit", "wasser"], "fr": ["la", "maison", "avec", "eau"]}
    text = lambda x, n: " ".join(rnd.choice(stems[x]) + rnd.choice(["", "s", "e"]) for _ in range(n))
    trained = [(i, text(x, 30), x) for i, x in enumerate(list(stems) * 20)]
    model = langid.fit(spark.createDataFrame(trained, "doc_id long, text string, lang string"))
    hosts_ = ["a.x.org", "b.x.org", "y.de", "host", None]
    records = [(i, rnd.choice([text(rnd.choice(list(stems)), rnd.randint(0, 40)), "zq", None, "12 34 56 78 90 12 34 56", "дом " * 9]), rnd.choice(["en", "de", "xx", None]), rnd.choice(hosts_), rnd.choice(["org", "de", None])) for i in range(300)]
    df = spark.createDataFrame([(i, t, d, h, s) for i, t, d, h, s in records], "doc_id long, text string, declared string, host string, suffix string")
    want = plain_identify(records, [(t, x) for _, t, x in trained])
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    for i, (language, posterior, kept) in want.items():
        assert got[i]["posterior"] == pytest.approx(posterior, abs=2e-4), records[i]
        if abs(posterior - 0.6) > 1e-3:
            assert got[i]["kept"] == kept, records[i]
        if posterior > 0.51:
            assert got[i]["language"] == language


def test_langid_messy(spark, messy, empty):
    model = langid.fit(messy)
    assert set(model.languages) == {"de", "en", "es", "fr"}
    out = langid.identify(langid.document_records(messy), model)
    assert out.count() == messy.count() and out.where("kept is null").count() == 0
    assert not any(r["kept"] for r in out.collect() if r["n_bytes"] < 3)
    left = langid.keep_identified(messy)
    assert left.columns == messy.columns and 0 < left.count() < messy.count()
    assert langid.identify(langid.document_records(empty), model).count() == 0 and langid.keep_identified(empty).count() == 0
    none = langid.fit(empty)
    assert langid.identify(langid.document_records(messy), none).where("kept").count() == 0


def test_every_declared_language_is_modelled(spark):
    rnd = random.Random(7)
    tongues = [f"{a}{b}" for a in "abcdefghij" for b in "klmnop"][:40]
    words = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for x in tongues}
    words[tongues[-1]] = ["".join(chr(rnd.randint(0x10A0, 0x10F0)) for _ in range(6)) for _ in range(12)]
    text = lambda x: " ".join(rnd.choice(words[x]) for _ in range(60))
    rows = [(100 * k + i, text(x), [x, x.upper(), f"{x}-US"][i % 3] if k % 2 else x, "s") for k, x in enumerate(tongues) for i in range(10 if k < 32 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    assert model.languages == sorted(tongues)
    for r in langid.identify(langid.document_records(docs), model).collect():
        assert r["kept"] and r["language"] == tongues[r["doc_id"] // 100]
    assert langid.keep_identified(docs).count() == len(rows)


# --- repeated byte strings ----------------------------------------------------------------

def plain_repeats(rows, length=100):
    """(id, text) -> result, by looking at every string of every document."""
    from poolwright.llm import suffixes as sx

    spark = SparkSession.getActiveSession()
    texts = sorted(set(rows), key=repr)
    subs = [r["sub"] for r in sx._documents(spark.createDataFrame([(i, x[1]) for i, x in enumerate(texts)], "i long, text string"), "i", "text").orderBy("id").collect()]
    seen, out = set(), {}
    for (i, text), _ in sorted(zip(texts, subs, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1])):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[i, text] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest())
    return out


def found_repeats(spark, rows):
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out), key=repr)


def wanted_repeats(rows):
    plain = plain_repeats(rows)
    return sorted(((i, *plain[i, t]) for i, t in rows), key=repr)


def repeat_corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.randint(10, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3) if rnd.random() < 0.5 else 0
            parts += [p[a : len(p) - (rnd.randint(0, len(p) // 3) if rnd.random() < 0.5 else 0)], word()]
        rows.append((i, "".join(parts) if rnd.random() < 0.3 else " ".join(parts)))
    return rows + [(n + 1, rows[3][1]), (n + 2, "x" * 250), (n + 3, "ab" * 130), (n + 4, "x" * 99), (n + 5, "\x00\x01" * 80 + "x" * 101)]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:  # many blocks for a hash, many hashes in a block, ids by shuffle
        monkeypatch.setattr(suffixes, "BLOCK_ROWS", 3)
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(suffixes, "PART_BYTES", 3000)
    rows = repeat_corpus(7 + small)
    assert found_repeats(spark, rows) == wanted_repeats(rows)


def test_a_passage_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 10)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{i % 7}{passage}{i % 5} own{i} text{i * 31}") for i in range(200)]
    assert found_repeats(spark, rows) == wanted_repeats(rows)


@pytest.mark.parametrize("dense", [0, 2, 16])
def test_a_passage_that_some_slices_hold_densely(spark, monkeypatch, dense):
    """Many tasks: in some a seed has many surroundings, in others a single one,
    the same as elsewhere or another."""
    monkeypatch.setattr(suffixes, "DENSE", dense)
    monkeypatch.setattr(suffixes, "HOT", 0.0)
    monkeypatch.setattr(suffixes, "PART_BYTES", 2000)
    rnd = random.Random(dense)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, tails = noise(140), [noise(30) for _ in range(12)]
    rows = []
    for i in range(160):
        near = rnd.choice(tails) if rnd.random() < 0.5 else noise(30)
        rows.append((i, noise(20) + (near + passage[: rnd.randint(90, 140)] + rnd.choice(tails) if i < 60 or i % 20 == 0 else noise(150))))
    rows += [(None, rows[3][1]), (4, rows[5][1] + "x"), rows[7], rows[7]]
    assert found_repeats(spark, rows) == wanted_repeats(rows)


def test_no_task_gets_a_dense_hash_whole():
    rnd = np.random.RandomState(3)
    tail = lambda: bytes(rnd.randint(97, 123, 60, np.uint8)).decode()
    passage = tail() + tail()
    texts = [tail() + passage + tail() for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], ["id", "sub", "text"])
    out = pa.Table.from_batches(list(suffixes._seed_rows(50, iter([batch])))).to_pandas()
    most = out[~out.known].groupby("hash").size().max()
    assert out.hot.any() and most < max(suffixes.DENSE, suffixes.HOT * len(out)) * 2 + 100


def test_expansion_parts_as_sorting_does():
    rnd = random.Random(8)
    for _ in range(60):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8))]
        text = suffixes.joined(pieces)
        depth = rnd.randint(1, 12)
        order = suffixes.suffix_order(text, depth)
        keys = [tuple(text[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys)
        cut = suffixes.parted(text, order, depth)
        assert cut.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_documents_are_told_by_id_and_text(spark):
    """Null ids, an id with several texts, and rows that are there twice."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    p, x, y, z = noise(200), noise(400), noise(400), noise(300)
    rows = [(1, noise(50) + p), (None, noise(60) + p), (None, x), (7, noise(40) + p), (7, y), (7, z), (7, z), (2, z + "!"), (None, x + "tail"), (None, x + "tail"), (9, noise(150)), (9, noise(150)), (None, None), (None, "")]
    rows += [(20 + i % 3, noise(30) + p[:120]) for i in range(9)] + [(None, noise(20) + q) for q in (y, y[50:], p)]
    assert found_repeats(spark, rows) == wanted_repeats(rows)


def test_repeats_messy(spark, messy, empty):
    out = suffixes.remove_repeats(messy)
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect()), key=repr)
    assert got == wanted_repeats(rows)
    assert suffixes.remove_repeats(empty).count() == 0
