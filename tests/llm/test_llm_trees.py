"""Merkle manifest, prefix trie and toxicity against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from storyline.llm import cross_polytope, merkle, prefix_trie, toxicity
from storyline.llm.queries import op12_prefix_trie, op13_toxicity

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, rank int, hash string, height int, node string, path string, id int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------------------------
def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(level):
    """Root of a list of digests, and each one's siblings on the way with their side."""
    paths, groups = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, joined = [], []
        for k in range(0, len(level), 2):
            run = level[k:k + 2]
            for side, members in enumerate(groups[k:k + 2]):
                for i in members:
                    paths[i].append((side, [h for j, h in enumerate(run) if j != side]))
            above.append(sha("".join(run)))
            joined.append(sum(groups[k:k + 2], []))
        level, groups = above, joined
    return level[0], paths


def plain_manifest(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for lang in langs:
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, paths = climb([leaf_of(r) for r in mine])
        subs.append(root)
        out.append((mine, paths))
    root, tops = climb(subs)
    rows = []
    for (mine, paths), sub, top in zip(out, subs, tops):
        for row, path in zip(mine, paths):
            path = path + top
            proof = sha("".join(h for _, others in path for h in others))
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf_of((*row[:3], row[3] + 1 if row[3] is not None else None, row[4])) if bad else leaf_of(row)
            for side, others in path:
                digest = sha("".join(others[:side]) + digest + "".join(others[side:]))
            rows.append((row[0], leaf_of(row), sub, root, proof, digest, digest == root))
    return sorted(rows, key=repr)


def manifest_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "h", 2, "n", "p", 7) for r in rows], DOCS)
    got = merkle.manifest(df, altered={"n_chars": F.col("n_chars") + 1}, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted((tuple(r) for r in got.drop("path").collect()), key=repr)


@pytest.mark.parametrize("many", [1, 2, 3, 700])
def test_manifest(spark, many):
    random.seed(many)
    rows = [(i, f"s{i % 3}", random.choice(["en", "en", "en", "dé", "z"]), i * 10, f"text {i} é") for i in range(many)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    same = (7, "s", "en", 4, "same")
    rows = [same] * 5 + [(None, None, None, None, None), (None, None, None, None, None), (7, "s", None, None, ""), (8, None, "", 0, "x" * 300_000), (14, "s", "en", None, None)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)
    assert manifest_rows(spark, []) == []


def test_a_proof_leads_to_the_root_and_no_other_leaf_does(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = merkle.manifest(df).select("leaf", "root", "path", "verified").collect()
    assert all(r.verified for r in rows) and len(rows) == df.count()
    r = rows[3]
    for start, good in ((r.leaf, True), (rows[4].leaf, False)):
        digest = start
        for step in r.path:
            digest = sha(digest + step[1:] if step[:1] == "R" else step[1:] + digest)
        assert (digest == r.root) is good


# --- prefix trie -----------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, conv string, pos int, k1 int"


def rebuilt_plain(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append(((turn is not None, turn or 0, tie), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    return out


def plain_trie(rows):
    convs = rebuilt_plain(rows)
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for seq in nodes:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    out = {}

    for seq in sorted(nodes, key=len, reverse=True):
        below = [out[k] for k in kids.get(seq, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        leaves = sum(b[3] for b in below) or 1
        saved = sum(b[4] for b in below) + (len(nodes[seq]) - 1) * words
        ends = ",".join(str(c) for c in sorted(nodes[seq]) if len(convs[c]) == len(seq))
        parent = min(nodes[seq[:-1]]) if seq else None
        out[seq] = (min(nodes[seq]), len(seq), parent, leaves, saved, len(nodes[seq]), len(kids.get(seq, [])), sha(ends))
    return sorted((r[0], r[1], r[2], r[5], r[6], r[3], r[4], r[7]) for r in out.values()) if convs else []


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    turns = prefix_trie.ordered_turns(df)
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    got = prefix_trie.prefix_trie(*prefix_trie.spliced(turns, heads, F.col("conv") - F.col("conv") % 20))
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1]))


def test_trie_of_random_conversations(spark):
    random.seed(4)
    rows = []
    for c in range(120):
        if c % 20 or c in (0, 40):
            for t in range(random.choice([1, 1, 2, 3, 5, 8])):
                rows.append((c, t, random.choice(["user", "assistant"]) if t > 2 else "user", random.choice(["a b c", "a b", "x", "one two three"])))
    assert trie_rows(spark, rows) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_with_hot_beginnings_and_a_long_conversation(spark):
    """Most share a first turn, many are copies, one holds half of all turns and so is cut between tasks."""
    random.seed(5)
    rows = [(1, t, "user", f"turn {t % 7} of it") for t in range(600)]
    rows += [(1000, t, "user", f"turn {t % 7} of it") for t in range(150)]
    for c in range(2, 150):
        rows.append((c, 0, "system", "the common first turn"))
        if c % 3:
            rows.append((c, 1, "user", random.choice(["hello there", "good day"])))
        if c % 5 == 0:
            rows.append((c, 2, "assistant", f"answer {c}"))
    assert trie_rows(spark, rows) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_of_odd_rows(spark):
    long = "word " * 50_000
    rows = [(5, None, None, None), (5, 1, "user", long), (5, 1, "user", long), (25, None, None, ""), (25, 1, "user", long), (25, 1, "a", "b"), (None, 1, "user", "x"),
            (3, 0, "ab", "c"), (4, 0, "a", "bc"), (7, 0, "u", " é x")]
    assert trie_rows(spark, rows) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 700, 5000):
        bits, depth, left = [], 0, n
        while left or depth:
            if left and (not depth or rng.random() < 0.5 + 0.3 * (left > n // 2)):
                bits, depth, left = bits + [1], depth + 1, left - 1
            else:
                bits, depth = bits + [0], depth - 1
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(np.array(bits))
        assert prefix_trie.Parentheses(np.array(bits, np.uint8)).findclose(opens).tolist() == [want[i] for i in opens]


def test_trie_query_covers_every_conversation(spark):
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    root = op12_prefix_trie(spark, SF).filter("depth = 0").collect()
    assert len(root) == 1 and root[0].n_convs == n and root[0].parent_conv_id is None


# --- toxicity --------------------------------------------------------------------------------
RUDE = ["grundlich", "vorpaling", "snarkish"]
HARMLESS = ["the", "river", "of", "stone", "meadow", "under", "silver", "morning", "garden", "letter", "window", "rain", "and", "a", "y"]
SIGNS = {"a": "4", "i": "1", "o": "0", "s": "$", "e": "3"}


def sentence(rng, n, rude=None):
    words = [rng.choice(HARMLESS) for _ in range(n)]
    if rude:
        for _ in range(2):
            words[rng.randrange(n)] = rude
    return " ".join(words)


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        rude = rng.choice(RUDE) if i % 4 == 0 else None
        rows.append((i, sentence(rng, rng.randint(15, 60), rude), "en", "s", 1.0, 0, "f"))
        labels.append((i, int(bool(rude)), "x"))
    hidden = []
    for k, word in enumerate(RUDE):
        for form in ("".join(SIGNS.get(c, c) for c in word), " ".join(word), ".".join(word), word[:3] + word[3] * 4 + word[4:], word + "!!"):
            hidden.append((1000 + len(hidden), sentence(rng, 30, form), None, None, 1.0, k, "f"))
    clean = [(2000 + k, sentence(rng, 30) + " a b c 1984 x2 no. 4 2024-05-01 a@b.example.com", None, None, None, 0, "f") for k in range(20)]
    schema = "doc_id long, text string, lang string, source string, score double, held_out int, fold string"
    return spark.createDataFrame(rows + hidden + clean, schema), spark.createDataFrame(labels, "doc_id long, toxic int, text string"), len(hidden)


def test_disguised_words_are_found_and_clean_texts_left(spoken):
    docs, labels, hidden = spoken
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    caught = [got[1000 + k].predicted for k in range(hidden)]
    assert sum(caught) >= 0.9 * hidden
    assert not any(got[2000 + k].predicted for k in range(20))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_decoding_equals_trying_every_reading(spoken):
    docs, _, _ = spoken
    letters = toxicity.letter_model(docs)

    def price(reading, channel):
        cost, state = channel, 0
        for char in reading + " ":
            s = toxicity._symbol(char)
            if s == 0 and state % toxicity.SYMBOLS == 0:
                continue
            cost += float(letters.cost[state, s])
            state = (state * toxicity.SYMBOLS + s) % toxicity.SYMBOLS**3
        return cost

    for stretch in ("gr0n", "a.b", "s1lv3r", "yyyy4", "0n-1t"):
        readings = [("", 0.0)]
        for place in toxicity.lattice(stretch):
            readings = [(r + t, c + p) for r, c in readings for t, p in place]
        best = min(price(r, c) for r, c in readings)
        told = letters.decode(toxicity.lattice(stretch))
        assert abs(min(price(r, c) for r, c in readings if " ".join(r.split()) == told) - best) < 1e-4, stretch


def test_toxicity_of_odd_rows(spark, spoken):
    _, labels, _ = spoken
    rows = [(1, None), (2, ""), (2, ""), (None, "grundlich"), (3, " \t\n"), (4, "a" * 200_000), (5, "1" * 50_000 + "a"), (6, "i " * 5_000), (7, "\U0001d4d0 é ß İ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity_scores(docs.limit(0), labels).collect()
    flat = toxicity.toxicity_scores(docs, labels.filter("toxic = 0")).collect()
    assert none == [] and len({r.score for r in flat}) == 1
    odd = spark.createDataFrame([(None, 1), (1, None), (99, 1), (2, 3)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, odd).collect()} == {0.5}


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = op13_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.02 * len(clean)


# --- nearest vectors of small tables and of ties -----------------------------------------------
@pytest.mark.parametrize("kind", ["random", "one-hot"])
def test_every_query_has_k_rows_if_there_are_candidates(spark, kind):
    """Thirty vectors, twenty rows for each query; with equal products the smaller ids come first."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 16)) if kind == "random" else np.eye(16)[rng.integers(0, 4, 30)] * rng.integers(1, 3, 30)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 20):
        order = sorted(((-float(x[i] @ x[q]), i) for i in range(30) if i != q))[:20]
        assert [(n, i) for n, i, _ in sorted(got[q])] == [(n + 1, i) for n, (_, i) in enumerate(order)]
        assert np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in order])


def test_stages_keep_rows_that_differ_and_any_column_names(spark):
    rows = [(1, "one two three four five six", 1), (1, "seven eight nine ten eleven twelve", 1), (1, "seven eight nine ten eleven twelve", 1), (2, "one two three four five six", 1), (None, "x y", 1), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copies int").withColumns({"Slot": F.lit(1), "lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(3)})
    kept = corpus_pipeline.one_per_group(spark, docs, SF)
    assert sorted(((r.doc_id or 0, r.text[:3]) for r in kept.collect())) == [(0, "x y"), (0, "x y"), (1, "one"), (1, "sev")]
    assert corpus_pipeline.mixed(spark, docs, SF).columns == docs.columns
    assert sorted(c.lower() for c in corpus_pipeline.sharded(spark, docs, SF).columns).count("slot") == 1
