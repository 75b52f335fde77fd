"""Sharding, tool calls, neighbours, mixing, components and the pipeline."""

import collections
import itertools
import json
import random

import duckdb
import numpy as np
import pytest
from check_queries import TABLES, rows_of
from plain import components, words

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from storyline.llm import cross_polytope, graph, mixing, queries, shards, tool_calls


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_lookup_table_is_what_taking_turns_gives():
    names = [f"s{k}" for k in range(7)]
    table = shards.lookup_table(names, 101, [1, 1, 2, 1, 1, 0, 1])
    size = len(table)
    assert size == 101 and set(table) == {0, 1, 2, 3, 4, 6}
    orders = [[(shards._hash(f"offset:{n}") + j * (shards._hash(f"step:{n}") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    free, want, turn = set(range(size)), [None] * size, itertools.cycle([0, 1, 2, 2, 3, 4, 6])
    while free:
        k = next(turn)
        slot = next(s for s in orders[k] if s in free)
        free.remove(slot)
        want[slot] = k
    assert table == want
    few, more = shards.lookup_table(names, 1009), shards.lookup_table(names[:-1], 1009)
    assert max(collections.Counter(few).values()) - min(collections.Counter(few).values()) <= 1
    assert sum(a != b for a, b in zip(few, more) if a != 6) < 0.1 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shards.lookup_table(bad)


def test_placement_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, "c", 7), (2, None, None)], "doc_id long, shard string, slot int")
    got = shards.place(df, ["x", "y"]).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and {r.shard for r in got} <= {"x", "y"}
    assert shards.place(df.limit(0), ["x"]).collect() == []
    assert shards.place(df, ["x"], key="shard").count() == 4


CALLS = "conv_id long, call_id string, name string, arguments string, after array<string>, place long, level int, json string"
RESULTS = "conv_id long, call_id string, content string, place long, errors string"
SCHEMAS = {"f": {
    "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": "string", "enum": ["x", "y"], "pattern": "^x"}, "b": {"type": "boolean"}},
    "required": ["n"], "additionalProperties": False,
}}


def test_tool_calls_are_linked_ordered_validated_and_written(spark):
    calls = [
        (1, "c", "f", '{"s":"x", "n":2}', ["a", "b"], 0), (1, "a", "f", '{"n":0,"zz":1}', None, 1), (1, "b", "f", '{"n":"1"}', ["a", "zz"], 2),
        (2, "p", "g", "{}", ["q"], 0), (2, "q", "f", "[1]", ["p"], 1), (2, "r", "f", "no json", ["q"], 2), (2, "s", "f", None, [], 3),
        (3, "k", "f", '{"n":1}', [], 0), (3, "k", "f", '{"n":1}', [], 0), (4, "m", "f", '{"n":1,"b":1,"s":"y"}', ["l"], 7), (4, "l", None, '{"n":1}', None, 3),
        (None, "k", "f", '{"n":1}', ["k"], 0), (5, None, "f", '{"n":1}', None, 0),
    ]
    results = [(1, "a", 'say "é"\n', 5, None), (1, "a", "later", 6, None), (3, "k", None, 0, None), (3, "none", "lost", 0, None), (None, "k", "?", 0, None)]
    df = spark.createDataFrame([(*c, None, None) for c in calls], CALLS)
    rows = tool_calls.link_calls(df, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == len(calls) + 2
    assert [by[1, c].level for c in "abc"] == [0, 1, 2] and [by[4, c].level for c in "lm"] == [3, 7]
    assert [by[2, c].level for c in "pqrs"] == [None, None, None, 0]
    assert by[1, "a"].json == '{"arguments":{"n":0,"zz":1},"call_id":"a","name":"f","result":"say \\"é\\"\\n"}' and by[1, "a"].n_results == 2
    assert by[1, "a"].errors == ["n: below 1", "zz: not in the schema"] and by[1, "b"].errors == ["n: no integer"]
    assert by[1, "c"].errors == [] and json.loads(by[1, "c"].json)["arguments"] == {"n": 2, "s": "x"} and '{"n":2,"s":"x"}' in by[1, "c"].json
    assert by[2, "p"].errors == ["unknown tool g", "needs itself"] and by[2, "q"].errors == ["arguments are no object", "needs itself"]
    assert by[2, "s"].errors == ["arguments are no JSON"] and by[4, "m"].errors == ["s: not of the pattern", "b: no boolean"]
    assert {r.status for r in rows if r.conv_id is None} == {"open", "orphan"} and by[3, "none"].status == "orphan"
    assert [r.n_results for r in rows if r.call_id == "k" and r.conv_id == 3] == [1, 1] and by[4, "l"].errors == ["unknown tool null"]
    none = spark.createDataFrame([], CALLS)
    assert tool_calls.link_calls(none, spark.createDataFrame([], RESULTS), SCHEMAS).collect() == []


def test_long_reversed_logs_are_ordered_by_jumps(spark):
    rng = random.Random(4)
    needs = {k: [k - 1] if k % 10 else rng.sample(range(k), min(3, k)) for k in range(120)}
    want = {}
    for k in range(120):
        want[k] = max((want[n] + 1 for n in needs[k]), default=0)
    rows = [(1, f"{k}", "f", "{}", [f"{n}" for n in needs[k]], -k) for k in needs]
    df = spark.createDataFrame([(*r, None, None) for r in rows], CALLS)
    assert {int(r.call_id): r.level for r in tool_calls.call_levels(df).collect()} == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k + 1, k) for k in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(3, 3), (None, 5), (20, 300), (201, 200), (200, 201)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 7 for k in (7, 300, *range(20, 60))} | {200: 200, 201: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def exact(vectors, queries, k):
    ids = sorted(vectors)
    out = {}
    for q in queries:
        scores = sorted((-float(np.dot(vectors[q], vectors[i])), i) for i in ids if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_recall(spark, scale):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    if scale:
        df = df.withColumn("embedding", F.transform("embedding", lambda v: v * (1 + F.col("vec_id") % 3)))
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    rows = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0).collect()
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])), abs=1e-12)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_of_odd_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0]), (5, [0.9, 0.1, 0.0]), (6, [0.9, 0.1, 0.0]), (7, None), (8, [0.0] * 3), (9, [nan, 1.0, 1.0]),
            (10, [inf, 1.0, 0.0]), (11, [None, 1.0, 0.0]), (12, [1.0]), (None, [1.0, 0.0, 0.0]), (13, []), (40, [0.0] * 3), (0, [1.0, 0.0, 0.0])]
    rows += [(100 + k, [0.5, 0.5, 0.0]) for k in range(50)]
    df = spark.createDataFrame([(*r, 1, 2, None) for r in rows], "vec_id long, embedding array<double>, gid int, v int, n string")
    got = collections.defaultdict(list)
    for r in cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=5, tables=8, probes=4).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    top = {q: [v for _, v, _ in sorted(x)] for q, x in got.items()}
    assert top[0][:3] == [20, 5, 6] and top[20][:3] == [0, 5, 6] and top[100] == [0, 5, 6, 20, 101] and top[0][3:] == [100, 101]
    assert set(top) == {0, 20, 100, 120, 140}
    assert cross_polytope.nearest(df.limit(0), F.lit(True)).collect() == []


def test_subset_sums_equal_trying_all():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4)))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 1)
        take = mixing.fit(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        share = np.minimum(np.floor(counts * (budget / (lengths * counts).sum())).astype(int), counts)
        left = budget - int((share * lengths).sum())
        if left <= 2 * lengths.max() and 0 < budget < (lengths * counts).sum():
            best = min(abs(left - sum(a * b for a, b in zip(t, lengths))) for t in itertools.product(*[range(c + 1) for c in counts - share]))
            assert abs(int((take * lengths).sum()) - budget) == best


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900, None, None), (900, None, None), (None, "a b c", "src1"), (901, "", "src1"), (902, "x y", None), (902, "x y", None), (903, "word " * 5000, "big")]
    more = spark.createDataFrame([(i, t, None, s, None) for i, t, s in odd], docs.schema)
    all_ = docs.unionByName(more).withColumn("key", docs.n_chars).withColumn("size", docs.source).repartition(3)
    mixing.RANKED, before = 3, mixing.RANKED
    try:
        rows = mixing.mix(all_).collect()
        again = mixing.mix(all_.repartition(2)).collect()
    finally:
        mixing.RANKED = before
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count() + len(odd)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    longest = collections.defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= max(1, longest[s] / 2) for s in sizes)
    assert mixing.mix(all_.limit(0)).collect() == []


def test_pipeline_equals_its_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(ids.isdisjoint({i}) for i, q in labels.items() if q == 0) and {i for i, q in labels.items() if q == 1} <= ids
    one = corpus_pipeline.one_per_group(spark, kept.unionByName(kept.limit(20)), SF)
    got = [r.doc_id for r in one.select("doc_id").collect()]
    plain = components({i: texts[i] for i in ids})
    assert sorted(got) == sorted(i for i, (_, c) in plain.items() if i == c)
    clean = corpus_pipeline.decontaminated(spark, one, SF)
    left = {r.doc_id for r in clean.select("doc_id").collect()}

    def leaks(text):
        w = words(text)
        return any(w[k:k + len(i)] == i for i in items for k in range(len(w) - len(i) + 1))

    assert left == {i for i in got if not leaks(texts[i])}
    mix = collections.Counter(r.doc_id for r in corpus_pipeline.mixed(spark, clean, SF).select("doc_id").collect())
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(clean).collect() if r.taken}
    assert mix == want
    final = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in final) == mix and set(final[0].asDict()) == {*docs.columns, "slot", "shard"}
    table = shards.lookup_table(corpus_pipeline.SHARDS)
    assert all(r.shard == corpus_pipeline.SHARDS[table[r.slot]] for r in final)


def test_pipeline_of_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "the same five words and more of the same text again"
    rows = [(None, text, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, "s", None), (3, None, None, None, None), (4, "", "en", "t", 0)]
    for name, data in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert docs.columns[:5] == schema.names
        out = [r.doc_id for r in docs.collect()]
        assert set(out) <= {1} and (name == "odd" or not out)
