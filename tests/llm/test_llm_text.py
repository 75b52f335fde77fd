"""Near duplicates, benchmark windows, languages, quality, secrets and language model against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import components, shingles, words

from conftest import SF
from storyline.llm import decontaminate, languages, parity_join, quality, secrets, suffix_tree
from storyline.llm import words as W

LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
WIDE = "é\u2003è İ x" * 3  # that wide space is no separator
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, a int, label string, size int, x int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, and columns with clashing names."""
    same = "the same five words and more of the same text again"
    texts = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \t\n"), (6, "One"), (7, "one"), (8, LONG), (9, LONG + " end"),
             (None, same), (None, None), (10, "a b c d"), (11, "12 34 !?"), (12, WIDE)]
    rows = [(i, t, None if i == 1 else "en", None if i in (2, 3) else "s", None, "k", 1, "l", 3, None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(seed, many):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgklm" for b in ("a", "e", "io", "un", "st")]
    docs = {}
    for base in range(many):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs[len(docs)] = " ".join(copy)
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    for _ in range(12):  # a passage that many share is no link by itself
        docs[len(docs)] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(40))
    hub = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(40):  # a crowd of near copies around one text, most not similar to each other
        copy = list(hub)
        for _ in range(3):
            copy[rng.randrange(80)] = f"new{k}x{rng.randrange(9)}"
        docs[len(docs)] = " ".join(copy)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, seed):
    docs = near_copies(seed, 40)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(df).collect()}
    assert got == components(docs)


def test_sketch_keys_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(0)
    classes = np.zeros(1 << parity_join.COUNTER_BITS, np.uint8)
    for size in (1, 2, 3, 4, 7, 8, 9, 30, 64, 500):
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            gone = rng.integers(0, len(x) // 7 + 1)
            fresh = rng.integers(0, 2**63, rng.integers(0, len(x) // 7 + 1), dtype=np.uint64)
            y = np.unique(np.concatenate([x[gone:], fresh]))
            same = len(np.intersect1d(x, y))
            if same * 100 < 75 * (len(x) + len(y) - same):
                continue
            assert set(parity_join.sketch_keys(x, classes, 75)) & set(parity_join.sketch_keys(y, classes, 75))
            a, b = parity_join.bit_sketch(x), parity_join.bit_sketch(y)
            n = min(len(a), len(b))
            apart = np.bitwise_count(parity_join._fold(a, n) ^ parity_join._fold(b, n)).sum()
            assert apart <= len(x) + len(y) - 2 * same


def test_buckets_of_any_size_meet_over_any_batches():
    rng = np.random.default_rng(3)
    rows = []
    for key in range(30):
        n = int(rng.choice([1, 2, 4, 6, 40, 300]))
        rows += [(key, int(t), 10, 1000 * key + i) for i, t in enumerate(sorted(rng.integers(0, 50, n)))]
        rows += [(key + 100, 0, -7, 1000 * key + i) for i in range(n)]
    rows.sort()
    rows = np.array(rows, np.int64)
    parity_join._CARRY, before = 16, parity_join._CARRY
    try:
        outs = []
        for step in (7, 64, len(rows)):
            b, stars, sets = parity_join._Buckets(75), set(), set()
            parts = [rows[a:a + step] for a in range(0, len(rows), step)]
            for i, part in enumerate([*parts, rows[:0]]):
                for kind, key, x, y, n in b.take(part, i == len(parts)):
                    if kind == 0:
                        sets |= set(zip(x.tolist(), y.tolist()))
                    if kind == 1:
                        stars |= set(zip(key.tolist(), x.tolist(), y.tolist()))
            assert {y for _, y in sets} == set(rows[rows[:, 2] < 0][:, 3].tolist())
            assert all(x == y - y % 1000 for x, y in sets)
            outs.append({k for k, _, _ in stars})
        crowded = {k for k in range(30) if len(set(rows[(rows[:, 0] == k)][:, 1].tolist())) > parity_join.SMALL}
        assert crowded <= outs[0] and crowded <= outs[2]
    finally:
        parity_join._CARRY = before


def test_near_duplicates_of_odd_rows(odd, none):
    rows = parity_join.near_duplicates(odd).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got == collections.Counter([
        (1, 7, 1), (2, 7, 1), (2, 7, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 59996, 8), (9, 59997, 8),
        (None, 7, None), (None, 0, None), (10, 1, 10), (11, 1, 11), (12, len(shingles(WIDE)), 12),
    ])
    assert parity_join.near_duplicates(none).collect() == []


def test_near_duplicates_tell_sets_of_like_hashes_apart(spark):
    """Two near copies whose set hashes agree in their 31 leading bits, by which buckets once took them for equal."""
    many = 200_000
    base = " ".join(f"w{k}" for k in range(29))
    batch = pa.RecordBatch.from_arrays([pa.array(range(many), pa.int64()), pa.array([f"{base} x{k}" for k in range(many)])], ["doc", "text"])
    got = pa.Table.from_batches(parity_join._set_hashes(5)([batch])).column("own").to_numpy().view(np.uint64)
    order = np.argsort(got)
    a, b = next((int(x), int(y)) for x, y in zip(order, order[1:]) if got[x] >> np.uint64(33) == got[y] >> np.uint64(33))
    assert got[a] != got[b]
    df = spark.createDataFrame([(k, f"{base} x{k}") for k in (a, b)], "doc_id long, text string")
    rows = parity_join.near_duplicates(df).collect()
    assert {r.component_id for r in rows} == {min(a, b)} and {r.class_id for r in rows} == {a, b}


def test_benchmark_windows_equal_all_windows(spark, odd, none):
    rng = random.Random(5)
    v = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.choice([2, 4, 5, 12, 30])))) for k in range(12)] + [(90, None), (91, " ")]
    docs = []
    for d in range(60):
        w = [rng.choice(v) for _ in range(rng.randrange(0, 80))]
        if d % 2:
            passage = items[d % 12][1].split()
            if d % 4 == 1 and len(passage) > 10:
                passage[0] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((d, " ".join(w).upper()))
    index = decontaminate.Index(items)
    want = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            its = words(item)
            if not its or len(its) > len(w):
                continue
            k = min(5, len(its))
            have = collections.Counter(tuple(its[s:s + k]) for s in range(len(its) - k + 1))
            df = {s: sum(s in {tuple(words(t)[a:a + k]) for a in range(len(words(t)) - k + 1)} and min(5, len(words(t)) or 9) == k
                         for _, t in items) for s in have}
            for at in range(len(w) - len(its) + 1):
                own = collections.Counter(tuple(w[s:s + k]) for s in range(at, at + len(its) - k + 1))
                if own == have:
                    want[d, i] = max(want.get((d, i), 0), 1.0)
    hits = decontaminate.benchmark_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in hits}
    assert len(got) == len(hits) and set(want) <= set(got)
    assert all(got[k] == 1.0 for k in want) and all(s >= 0.75 for s in got.values())
    for d, i in set(got) - set(want):  # near copies: the reported similarity is that of the reported window
        r = next(r for r in hits if (r.doc_id, r.item_id) == (d, i))
        hashes, _ = W.tokens(pa.array([" ".join(words(docs[d][1])[r.first_word:r.first_word + r.n_words])]))
        place = index.ids.index(i)
        assert r.similarity == index.similarity(index.grams(hashes, min(5, len(hashes))), place) and r.bits <= decontaminate.RADIUS
    edited = [d for d, _ in docs if d % 4 == 1 and len(items[d % 12][1].split()) == 30]
    assert all((d, d % 12) in got for d in edited)
    one = spark.createDataFrame([(1, "the same five words and more of the same text again")], "item_id long, text string")
    assert sorted([r.doc_id is None, r.doc_id] for r in decontaminate.benchmark_hits(odd, one).collect()) == [
        [False, 1], [False, 2], [False, 2], [True, None]]
    assert decontaminate.benchmark_hits(none, one).collect() == []
    assert decontaminate.benchmark_hits(odd, one.limit(0)).collect() == []


def test_benchmark_items_in_shorter_documents(spark):
    item = [f"w{k}" for k in range(50)]
    docs = [(1, item[:-1]), (2, item[2:]), (3, item[:20]), (4, item[:3]), (5, item), (6, ["x", *item[:-1]])]
    hits = decontaminate.benchmark_hits(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(7, " ".join(item)), (8, "w1 w2")], "item_id long, text string"),
    ).filter("item_id = 7").collect()
    assert sorted((r.doc_id, r.first_word, r.n_words, round(r.similarity, 4)) for r in hits) == [
        (1, 0, 49, round(45 / 46, 4)), (2, 0, 48, round(44 / 46, 4)), (5, 0, 50, 1.0), (6, 0, 50, round(45 / 47, 4))]


def test_benchmark_passes_do_not_touch_results(spark, monkeypatch):
    rng = random.Random(8)
    v = [f"v{k}" for k in range(400)]
    passages = [[rng.choice(v) for _ in range(14)] for _ in range(6)]
    items = [(k, " ".join([*passages[k % 6], *(rng.choice(v) for _ in range(12))])) for k in range(60)]
    items += [(90, None), (91, " "), (92, items[0][1]), (93, "v1 v2")]
    docs = []
    for d in range(300):
        w = items[d % 60][1].split()
        for _ in range(rng.randrange(0, 3)):  # about the threshold, now in what items share and now in what they do not
            w[rng.randrange(len(w))] = rng.choice(v)
        docs.append((d, " ".join([rng.choice(v), *w, *rng.choice(passages)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.benchmark_hits(df, table).collect()))
    letters = sum(len(t or "") for _, t in items)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", letters // 5)
    assert 1 + letters // (2 * decontaminate.ITEM_WORDS) == 3
    assert one and sorted(map(tuple, decontaminate.benchmark_hits(df, table).collect())) == one


def crc(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_languages_on_held_out_and_mixed_texts(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    from pyspark.sql import functions as F

    held = lambda id: F.crc32(id.cast("string").cast("binary")) % 5 == 0
    rows = languages.identify(docs, held_out=held).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in out) >= 0.95 * len(out)
    en = max((t for g, t in truth.values() if g == "en"), key=len)
    de = max((t for g, t in truth.values() if g == "de"), key=len)
    both = spark.createDataFrame([(1000, en[:2000] + " " + de[:1000], None)], "doc_id long, text string, lang string")
    mixed = languages.identify(docs.select("doc_id", "text", "lang").unionByName(both)).filter("doc_id = 1000").first()
    assert mixed.lang_pred == "en" and {x.lang for x in mixed.languages} == {"en", "de"} and 0.5 < mixed.score < 0.8
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.identify(odd).collect()]
    assert len(got) == 15 and all((p == "und") == (s == 0) for _, p, s in got)
    assert {i for i, p, _ in got if p == "und" and i} == {3, 4, 5, 11}
    assert languages.identify(none).collect() == []
    assert {r.lang_pred for r in languages.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_on_held_out_labels(spark, odd, none):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.quality_scores(docs, labels, held_out=lambda id: F.crc32(id.cast("string").cast("binary")) % 4 == 2).collect()
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    some = labels.limit(0).unionByName(spark.createDataFrame(
        [(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 1, 0), (999, 0, 0), (6, 7, 0)], labels.schema))
    got = quality.quality_scores(odd, some).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.quality_scores(none, some).collect() == []
    assert {r.score for r in quality.quality_scores(odd, some.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, some.limit(0)).count() == 15


def test_flat_trees_equal_a_walk_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.train(x, y, rounds=10, depth=3)
    binned = trees.bins(x)
    for row in range(0, 800, 97):
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if binned[row, f[node]] > c[node] else 1)
            total += v[node]
        assert trees.score(x)[row] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = sorted(out)
    for m in re.finditer(secrets._CANDIDATE, text):
        value = m[0]
        if any(re.fullmatch(p, value) for p in secrets.ALLOWED):
            continue
        kind, least = next((k, e) for k, (_, p, e) in enumerate(secrets.CLASSES, 3) if re.fullmatch(p, value))[0], 0
        least = secrets.CLASSES[kind - 3][2]
        high = []
        for s in range(len(value) - secrets.WINDOW + 1):
            counts = collections.Counter(value[s:s + secrets.WINDOW]).values()
            if -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in counts) >= least - 1e-9:
                high.append(s)
        if high:
            out.append((m.start() + high[0], kind, m.start() + high[-1] + secrets.WINDOW))
    text_of = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return text_of(base), text_of(out)


def test_secret_spans_equal_a_plain_scan(spark, odd, none):
    rng = random.Random(2)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64 = secrets.ALPHABET
    texts = [
        "token = " + key(40, "0123456789abcdef"), "é\U0001F600 secret: secret: abcdefgh123", 'Password="short" passwd=longer.one=',
        "AKIA" + key(11, "ABC123") + " AKIA" + key(12, "ABC123") + "x", key(31, "ab1") + " " + key(33, "ab1") + "G",
        "x " + key(44, b64) + " y " + key(20, b64), "123e4567-e89b-12d3-a456-426614174000 and 1234567890123456789012",
        "a" * 30 + "1", "example" + key(30, b64), "api_key:'" + key(24, b64) + "' apikey=" + key(8, "x"), "TOKEN=\n12345678",
        "tokens = abcdefghij API-KEY=abcdefghij", None, "",
    ] + [" ".join(key(rng.choice([5, 18, 26, 41]), rng.choice([b64, "0123456789abcdef", "abc"])) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.scan(df).collect():
        base, spans = plain_spans(texts[r.doc_id])
        assert (r.base, r.spans_text) == (base, spans), texts[r.doc_id]
        assert r.n_assign + r.n_access + r.n_hex == (base.count(",") + 1 if base else 0)
    got = secrets.scan(odd).collect()
    assert len(got) == 15 and all(r.base == "" for r in got) and secrets.scan(none).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_language_model_counts_and_scores(spark, odd, none):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    kept = suffix_tree.FREQUENT
    suffix_tree.FREQUENT = 500  # so that both ways of counting take part
    try:
        rows = suffix_tree.score_texts(docs, held_out=lambda id: F.crc32(id.cast("string").cast("binary")) % 7 == 2).collect()
    finally:
        suffix_tree.FREQUENT = kept
    counts = collections.Counter(w for i, t in texts.items() if crc(i, 7) != 2 for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        t = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base) and r.held_out == (crc(r.doc_id, 7) == 2) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    got = suffix_tree.score_texts(odd).collect()
    assert len(got) == 15 and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert suffix_tree.score_texts(none).collect() == []
    untaught = suffix_tree.score_texts(odd, held_out=lambda id: F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)


def test_language_model_in_parts_equals_one(spark, odd):
    """States held at a time bound memory alone: no context that diverges is lost."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").unionByName(odd.filter("doc_id <> 8").select("doc_id", "text"))
    whole = suffix_tree.score_texts(docs).orderBy("doc_id", "score").collect()
    parts = suffix_tree.score_texts(docs, states=12_000).orderBy("doc_id", "score").collect()
    assert len(whole) == len(parts)
    for a, b in zip(whole, parts):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert (a.base_score, a.score) == (pytest.approx(b.base_score), pytest.approx(b.score, rel=1e-9))


def test_suffix_tree_walks_to_the_longest_state():
    alphabet = suffix_tree.Alphabet.of(np.bincount(np.frombuffer(b"abcabcabdabcde", np.uint8), minlength=256))
    raw, at = W.utf8(pa.array(["abc abd", None, "abcabcab"]))
    first, past, of = W.word_bounds(raw, at)
    symbols, start, _ = suffix_tree.streams(raw, first, past, of, alphabet)
    assert start.tolist() == [0, 14, 20, 35] and (symbols[start[1:] - 1] == 0).all() and len(symbols) == 35
    keys = suffix_tree.contexts(symbols)
    seen = collections.Counter()
    for p in np.flatnonzero(suffix_tree._scored(symbols, start)):
        for d in range(4):
            seen[d, int(keys[p]) & ((1 << 6 * d) - 1), int(symbols[p])] += 1
    depth, context, symbol = (np.array(c) for c in zip(*seen))
    tree = suffix_tree.Tree.build(alphabet, depth, context, symbol, np.array(list(seen.values())))
    assert np.allclose((10.0 ** tree.log10.astype(float))[:, :63].sum(axis=1) + 10.0 ** (tree.log10[:, 63] - alphabet.spread), 1, atol=1e-4)
    scores = tree.symbol_scores(symbols)
    states = {(int(d), int(c)): None for d, c in zip(depth, context)}
    order = sorted({(0, 0), *states})
    for p in np.flatnonzero(suffix_tree._scored(symbols, start)):
        best = max(d for d in range(4) if (d, int(keys[p]) & ((1 << 6 * d) - 1)) in states)
        row = order.index((best, int(keys[p]) & ((1 << 6 * best) - 1)))
        assert scores[p] == tree.log10[row, symbols[p]]
    assert shingles("A b") == {("a", "b")}


def test_tree_of_batches_equals_tree_of_whole_arrays():
    rng = np.random.default_rng(3)
    alphabet = suffix_tree.Alphabet.of(np.bincount(np.frombuffer(b"banana bandana", np.uint8), minlength=256))
    context = np.concatenate([np.zeros(6, np.int64), np.repeat(np.arange(1, 5), 6)])
    depth, symbol, n = (context > 0).astype(np.int64), np.tile(np.arange(6), 5), rng.integers(1, 90, 30)
    whole = suffix_tree.Tree.build(alphabet, depth, context, symbol, n)
    key = (depth << 58) | context
    cut = [(key[i:i + 7], symbol[i:i + 7].astype(np.int8), n[i:i + 7]) for i in range(0, 30, 7)]
    parts = suffix_tree.Tree.of_batches(alphabet, cut)
    assert np.array_equal(whole.child, parts.child) and np.array_equal(whole.log10, parts.log10)
