"""Streams give what one batch gives, over late, repeated and out-of-order items, and again after a restart."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from storyline.operators import clustering as G
from storyline.operators import dedup as D
from storyline.operators.assignment import assign_in_slices
from storyline.operators.similarity import ScoreOptions
from storyline.sources.posts import PostsSource, split_posts, store_posts
from storyline.streaming.ingest import StoryStream
from storyline.streaming.keys import KeyStore
from storyline.streaming.snapshot import Snapshots
from storyline.streaming.staleness import STATE_STORE, staleness_changes
from storyline.streaming.weeks import WeekDigests
from test_operators import ITEM, features, item


def arrive(rows, folder, batches):
    """Rows as files, one a batch, in the given order."""
    for part in batches:
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(folder))


def test_story_stream_equals_batch(spark, tmp_path):
    heads = ["Senate approves the budget bill", "Storm floods coastal towns", "Chip maker unveils new processor"]
    rows = [item(i, heads[i % 3], f"{heads[i % 3]} in Berlin today.", f"Outlet {i}", minutes=i * 60) for i in range(1, 17)]
    rows += [(100 + i, *rows[i][1:]) for i in (2, 7)]  # repeats of earlier items, in later batches
    df = spark.createDataFrame(rows, ITEM).withColumn("arrived_at", F.when(F.col("article_id") > 100, F.col("published_at") + F.expr("INTERVAL 9 HOURS")).otherwise(F.col("published_at")))
    late = F.when(F.col("article_id") % 5 == 0, F.col("published_at") - F.expr("INTERVAL 4 DAYS")).when(F.col("article_id") != 6, F.col("published_at"))
    df = df.withColumn("published_at", late).withColumn("guild_id", F.lit(1).cast("long")).orderBy(F.desc("article_id"))
    edges = [dt.datetime(2024, 1, 1, h) for h in (0, 5, 9, 13)] + [dt.datetime(2024, 1, 3)]
    arrive(df, tmp_path / "in", [(F.col("arrived_at") >= a) & (F.col("arrived_at") < b) for a, b in zip(edges, edges[1:])])
    stream = StoryStream(str(tmp_path / "out"), ScoreOptions())
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, available_now=True).awaitTermination()
    got = {r["article_id"]: r["root"] for r in stream.stored(spark).select("article_id", "root").collect()}
    dated = df.withColumn("published_at", F.coalesce("published_at", "arrived_at"))
    arts = features(dated).withColumn("arrival_us", F.unix_micros("arrived_at")).withColumn("keys", D.article_keys())
    kept = D.first_wins(arts, "article_id", ["arrival_us"], "keys")
    want = {r["article_id"]: r["root"] for r in assign_in_slices(arts.join(kept, "article_id", "left_semi"), ScoreOptions())[0].collect()}
    assert got == want and not set(got) & {102, 107} and len(stream.read_bytes) == 4
    later = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp")
    assert {r["state"] for r in stream.stories(spark, later).collect()} == {"stale"}
    # A batch that is repeated, as after a failure, changes nothing.
    before = sorted(map(repr, stream.open_stories(spark, None, 99)[0].collect()))
    stream.process(spark.read.parquet(str(tmp_path / "in")).filter(F.col("arrived_at") >= edges[3]), 3)
    assert {r["article_id"]: r["root"] for r in stream.stored(spark).select("article_id", "root").collect()} == want
    assert sorted(map(repr, stream.open_stories(spark, None, 99)[0].collect())) == before


def test_a_batch_reads_no_more_as_stories_pile_up(spark, tmp_path):
    stream = StoryStream(str(tmp_path / "out"), ScoreOptions(), buckets=2)
    for day in range(0, 24, 4):
        rows = [item(day * 10 + i, f"Report {day} number {i} of the {day}th", f"It was said on day {day} that {i}.", f"Outlet {i}", minutes=day * 1440 + i) for i in range(8)]
        df = spark.createDataFrame(rows, ITEM).withColumns({"arrived_at": F.col("published_at"), "guild_id": F.lit(1).cast("long")})
        stream.process(df, day // 4)
    late = stream.read_bytes[2:]
    assert max(late) <= 1.3 * min(late)


def test_key_store_equals_the_batch_rule_at_a_flat_cost(spark, tmp_path):
    rng = random.Random(1)
    store, seen, cost = KeyStore(spark, str(tmp_path / "keys"), buckets=4, bits=12), {}, []
    for batch in range(20):
        rows = [(batch * 50 + i, [f"n{rng.random()}", f"m{rng.random()}"]) for i in range(50)]
        if batch:
            rows[3] = (rows[3][0], [rng.choice(list(seen)), rows[3][1][1]])
        df = spark.createDataFrame([(i, k) for i, ks in rows for k in ks], "article_id long, key string")
        got = {r["id"]: r["stored_id"] for r in store.find(df).collect()}
        cost.append(store.read_bytes)
        want = {i: min(seen[k] for k in ks if k in seen) for i, ks in rows if any(k in seen for k in ks)}
        assert got == want
        fresh = [(i, k) for i, ks in rows if i not in want for k in ks]
        assert store.add(spark.createDataFrame(fresh, "article_id long, key string"), batch)
        assert not store.add(df, batch)  # a repeated batch is stored once
        for i, k in fresh:
            seen.setdefault(k, i)
    again = {r["id"]: r["stored_id"] for r in store.find(df, before=19).collect()}
    assert again == got
    assert max(cost[10:]) <= 2.5 * min(cost[3:10])  # filters doubled twice at most, cells of one batch each


def replay_states(updates, after, until):
    """State changes of each story from its updates in time order, and what the clock brings up to ``until``."""
    out = []
    for story in sorted({u[0] for u in updates}):
        last = state = None
        for _, given, at in sorted((u for u in updates if u[0] == story), key=lambda u: (u[2], u[1])):
            if state not in (None, "stale", "merged") and at - last >= after:
                out.append((story, "stale", last + after))
                state = "stale"
            if state != "merged" and given != state:
                out.append((story, given, at))
                state = given
            last = at
        if state not in ("stale", "merged") and last + after <= until:
            out.append((story, "stale", last + after))
    return sorted(out)


def test_timers_turn_stories_stale_once(spark, tmp_path):
    base, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    random.seed(9)
    updates = sorted(((random.randint(1, 12), random.choice(["updated", "developing", "new"]), base + random.randint(0, 900) * hour) for _ in range(60)), key=lambda u: u[2])
    updates += [(13, "merged", base + 100 * hour), (14, "new", base + 1000 * hour)]
    updates.sort(key=lambda u: u[2])
    schema = "story_id long, state string, updated_at timestamp"
    for k in range(4):
        spark.createDataFrame(updates[k * 16:k * 16 + 16], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set(*STATE_STORE)
    try:
        staleness_changes(source, 96, "1 hour").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE[0])
    rows = spark.read.parquet(str(tmp_path / "out")).select("story_id", "state", (F.unix_micros("at") / 3600e6).cast("long").alias("h")).collect()
    got = sorted((r.story_id, r.state, base + (r.h - 473352) * hour) for r in rows)
    assert got == replay_states(updates, 96 * hour, max(u[2] for u in updates) - hour)


def test_weeks_are_refreshed_in_place(spark, tmp_path):
    weeks = WeekDigests(spark, str(tmp_path), "UTC", 6, shown=2, parts=4)
    schema = "guild_id long, forum string, story_id long, published_at timestamp"
    day = dt.datetime(2024, 1, 2)

    def rows(*specs):
        return spark.createDataFrame([(g, f, s, day + dt.timedelta(days=d)) for g, f, s, d in specs], schema)

    told = lambda v=None: {(r.guild_id, r.forum): (r.articles, r.stories, r.story_ids) for r in weeks.read(v).filter("week_us < 1704700000000000").collect()}
    weeks.process(rows((1, "a", 1, 0), (1, "a", 2, 0), (1, "a", 2, 1), (2, "a", 9, 0), (1, "a", 5, 30)), 0)
    assert told() == {(1, "a"): (3, 2, [2, 1]), (2, "a"): (1, 1, [9])}
    second = rows((1, "a", 1, 0), (1, "a", 1, 1), (1, "a", 3, 2))
    weeks.process(second, 1)
    assert told() == {(1, "a"): (6, 3, [1, 2]), (2, "a"): (1, 1, [9])}
    weeks.process(second, 1)  # a repeated batch
    assert told() == {(1, "a"): (6, 3, [1, 2]), (2, "a"): (1, 1, [9])} and weeks.digests.versions() == [0, 1]
    weeks.process(rows((2, "a", 8, 1), (None, None, None, 3), (2, "a", 8, 2)), 2)
    assert told()[(2, "a")] == (3, 2, [8, 9]) and told(1)[(2, "a")] == (1, 1, [9])


def test_a_reader_never_sees_half_a_refresh(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], parts=3, keep=1)
    one = spark.createDataFrame([(k, "old") for k in range(12)], "k long, v string")
    assert table.refresh(one, 0)
    held = table.read()
    real, table.folder.write = table.folder.write, lambda *a: False  # files are written, the record is not
    assert not table.refresh(one.withColumn("v", F.lit("half")), 1)
    table.folder.write = real
    assert {r.v for r in table.read().collect()} == {"old"} and table.versions() == [0]
    assert table.refresh(one.filter("k < 5").withColumn("v", F.lit("new")), 1)
    assert not table.refresh(one, 1) and not table.refresh(one, 0)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(k, "new" if k < 5 else "old") for k in range(12)]
    assert {r.v for r in held.collect()} == {"old"}  # what was read before stays whole
    for batch in range(2, 6):
        table.refresh(one.filter("k = 1").withColumn("v", F.lit(f"b{batch}")), batch)
    assert len(table.versions()) == 2 and table.read().count() == 12


def test_posts_stream_survives_a_restart(spark, tmp_path):
    spark.dataSource.register(PostsSource)
    seen = []

    def each(batch, batch_id):
        good, bad = split_posts(batch)
        seen.append((batch_id, sorted((r.feed, r.id) for r in good.collect()), sorted((r.id, r.reason) for r in bad.collect())))

    def post(feed, i):
        return feed, i, "{broken" if i == 7 else json.dumps({"id": str(i), "text": None if i == 9 else "t"})

    for part in ([post("a b", i) for i in range(1, 11)] + [post("c", 5)], [post("a b", i) for i in range(11, 14)] + [post("d/1", 3)]):
        store_posts(spark.createDataFrame(part, "feed string, id long, json string"), str(tmp_path / "posts"))
        query = spark.readStream.format("posts").option("path", str(tmp_path / "posts")).option("rowsPerPartition", 4).option("idsPerTrigger", 6).load()
        query = query.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
    good = [g for _, rows, _ in seen for g in rows]
    assert sorted(good) == sorted([("a b", i) for i in range(1, 14) if i not in (7, 9)] + [("c", 5), ("d/1", 3)])
    assert [b for _, _, rows in seen for b in rows] == [(7, "no JSON object"), (9, "no text")]
    assert len({b for b, _, _ in seen}) == len(seen) >= 3


@pytest.mark.parametrize("rows", [[], [(None, "new", None)]])
def test_empty_weeks(spark, tmp_path, rows):
    weeks = WeekDigests(spark, str(tmp_path), "UTC", 6)
    weeks.process(spark.createDataFrame(rows, "guild_id long, forum string, published_at timestamp").withColumn("story_id", F.lit(1)), 0)
    assert weeks.read() is None and G.HOUR_US
