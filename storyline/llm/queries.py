"""Queries of this subpackage over the given tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document."""
    from storyline.llm.parity_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


SHARDS = [f"shard-{k:02d}" for k in range(32)]


@_query
def op1_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    from storyline.llm.shards import place

    return place(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def _op1_sql() -> str:
    from storyline.llm.shards import lookup_table

    table = lookup_table(SHARDS)
    names = ",".join(SHARDS[k] for k in table)
    return f"""
    select doc_id, slot::int as slot, string_split('{names}', ',')[slot + 1] as shard
    from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {len(table)} as slot
          from documents)
    """


ORACLES["op1_shard_table"] = _op1_sql()


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    from storyline.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


@_query
def op10_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's best window in each document that holds it."""
    from storyline.llm.decontaminate import benchmark_hits

    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


TOOLS = {
    "search": {
        "properties": {
            "limit": {"type": "integer", "minimum": 1, "maximum": 5},
            "query": {"type": "string", "minLength": 20, "maxLength": 400},
        },
        "required": ["limit", "query"],
        "additionalProperties": False,
    },
    "configure": {
        "properties": {"instructions": {"type": "string", "maxLength": 300}},
        "required": ["instructions"],
        "additionalProperties": False,
    },
}


@_query
def op2_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tool calls: what is asked is a call, the turn that answers it its result; every seventh log is reversed."""
    from storyline.llm.tool_calls import link_calls

    turns = _table(spark, sf_dir, "conversations")
    place = F.when(F.col("conv_id") % 7 == 0, -F.col("turn")).otherwise(F.col("turn"))
    asked = turns.filter("role <> 'assistant'")
    user = F.col("role") == "user"
    calls = asked.select(
        "conv_id",
        F.concat_ws(":", "conv_id", "turn").alias("call_id"),
        F.when(user, "search").otherwise("configure").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") + 1).alias("limit"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("instructions")))).alias("arguments"),
        F.array(F.concat_ws(":", F.col("conv_id"), F.col("turn") - 2)).alias("after"),
        place.alias("place"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"),
        place.alias("place"),
    )
    linked = link_calls(calls, results, TOOLS)
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


ORACLES["op2_tool_call_links"] = """
with recursive
asked as (
    select conv_id, turn, conv_id || ':' || turn as call_id, role, text,
           case when conv_id % 7 = 0 then -turn else turn end as place
    from conversations where role <> 'assistant'
),
answers as (
    select conv_id, conv_id || ':' || (turn - 1) as call_id, arg_min(text, (case when conv_id % 7 = 0 then -turn else turn end, text)) as content,
           count(*) as n_results
    from conversations where role = 'assistant' group by 1, 2
),
chain as (
    select conv_id, turn, 0 as level from asked a
    where not exists (select 1 from asked b where b.conv_id = a.conv_id and b.turn = a.turn - 2)
    union all
    select a.conv_id, a.turn, c.level + 1 from asked a join chain c on a.conv_id = c.conv_id and a.turn = c.turn + 2
),
odd as (select distinct conv_id from chain where conv_id % 7 = 0 and level > 0)
select a.conv_id, a.call_id, case when o.conv_id is null then a.place else c.level end::bigint as level,
       case when r.n_results is null then 'open' else 'linked' end as status, coalesce(r.n_results, 0) as n_results,
       case when a.role = 'user' then concat_ws('; ',
                case when a.text is null then 'query: missing' end,
                case when a.turn + 1 < 1 then 'limit: below 1' when a.turn + 1 > 5 then 'limit: above 5' end,
                case when length(a.text) < 20 then 'query: shorter than 20' when length(a.text) > 400 then 'query: longer than 400' end)
            else concat_ws('; ', case when a.text is null then 'instructions: missing' end,
                case when length(a.text) > 300 then 'instructions: longer than 300' end) end as errors,
       '{"arguments":' || case when a.role = 'user' then '{"limit":' || (a.turn + 1) || ',"query":' || to_json(a.text) || '}'
                               else '{"instructions":' || to_json(a.text) || '}' end
       || ',"call_id":"' || a.call_id || '","name":"' || case when a.role = 'user' then 'search' else 'configure' end
       || '","result":' || coalesce(to_json(r.content)::varchar, 'null') || '}' as json
from asked a join chain c using (conv_id, turn) left join odd o on o.conv_id = a.conv_id
left join answers r on r.conv_id = a.conv_id and r.call_id = a.call_id
union all
select r.conv_id, r.call_id, null, 'orphan', r.n_results, 'no such call',
       '{"arguments":null,"call_id":"' || r.call_id || '","name":null,"result":' || coalesce(to_json(r.content)::varchar, 'null') || '}'
from answers r where not exists (select 1 from asked a where a.conv_id = r.conv_id and a.call_id = r.call_id)
"""


def _remainder(id, by: int):
    return F.crc32(id.cast("string").cast("binary")) % by


@_query
def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    from storyline.llm.quality import quality_scores

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_scores(docs, labels, held_out=lambda id: _remainder(id, 4) == 2)


@_query
def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the fixed shapes and all spans of every document."""
    from storyline.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        F.col("spans_text").alias("spans"),
    )


@_query
def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, base score and suffix-tree score of every document."""
    from storyline.llm.suffix_tree import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), held_out=lambda id: _remainder(id, 7) == 2)


@_query
def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language shares of every document."""
    from storyline.llm.languages import identify

    return identify(_table(spark, sf_dir, "documents"), held_out=lambda id: _remainder(id, 5) == 0)


@_query
def op4_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: 20 nearest vectors of every twentieth."""
    from storyline.llm.cross_polytope import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root that each document leads to, a seventh of them tampered with."""
    from storyline.llm.merkle import manifest

    docs = _table(spark, sf_dir, "documents")
    return manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, when=_remainder(F.col("doc_id"), 7) == 0).drop("path")


#: CRC-32 of a short text as DuckDB SQL, byte by byte and bit by bit.
def _crc32_sql(text: str) -> str:
    bit = "case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end"
    byte = f"list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, x: {byte}), 4294967295::bigint)"


def _framed_sql(columns, **changed) -> str:
    text = [changed.get(c, c) for c in columns]
    return " || ".join(f"coalesce(octet_length(encode(({t})::varchar)) || ':' || ({t})::varchar, '-')" for t in text)


_LEAF = ("doc_id", "source", "lang", "n_chars", "text")

ORACLES["op11_merkle_manifest"] = f"""
with recursive leaves as materialized (
    select row_number() over () as i, doc_id, lang, sha256({_framed_sql(_LEAF)}) as leaf,
           case when {_crc32_sql('doc_id::varchar')} % 7 = 0 then sha256({_framed_sql(_LEAF, n_chars='n_chars + 1')}) end as start
    from documents
),
placed as materialized (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves
),
nodes as (
    select lang, 0 as level, place, leaf as hash, n from placed
    union all
    select lang, level + 1, place // 2, sha256(string_agg(hash, '' order by place)), (n + 1) // 2 from nodes where n > 1
    group by lang, level, place // 2, n
),
tops as materialized (
    select lang, hash, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1
),
above as (
    select 0 as level, place, hash, n from tops
    union all
    select level + 1, place // 2, sha256(string_agg(hash, '' order by place)), (n + 1) // 2 from above where n > 1
    group by level, place // 2, n
),
steps as materialized (
    select p.i, s.level, p.place // (1::bigint << s.level) % 2 as side, o.hash as other
    from placed p join nodes s on s.lang is not distinct from p.lang and s.n > 1 and s.place = p.place // (1::bigint << s.level)
    left join nodes o on o.lang is not distinct from s.lang and o.level = s.level and o.place = xor(s.place, 1)
    union all
    select p.i, 1000 + s.level, t.place // (1::bigint << s.level) % 2, o.hash
    from placed p join tops t on t.lang is not distinct from p.lang join above s on s.n > 1 and s.place = t.place // (1::bigint << s.level)
    left join above o on o.level = s.level and o.place = xor(s.place, 1)
),
turns as materialized (select *, row_number() over (partition by i order by level) as k from steps),
folded as (
    select i, 0::bigint as k, coalesce(start, leaf) as hash from leaves
    union all
    select f.i, t.k, sha256(case when t.other is null then f.hash when t.side = 0 then f.hash || t.other else t.other || f.hash end)
    from folded f join turns t on t.i = f.i and t.k = f.k + 1
),
ends as (select i, arg_max(hash, k) as hash from folded group by i),
proofs as (select i, sha256(coalesce(string_agg(other, '' order by k), '')) as proof from turns group by i)
select p.doc_id, p.leaf, t.hash as subroot, r.hash as root, coalesce(q.proof, sha256('')) as proof_sha256, e.hash as folded_root,
       e.hash = r.hash as verified
from placed p join tops t on t.lang is not distinct from p.lang join above r on r.n = 1 join ends e using (i) left join proofs q using (i)
"""


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations that begin with up to three turns of the first of their twenty."""
    from storyline.llm.prefix_trie import ordered_turns, prefix_trie, spliced

    turns = ordered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie(*spliced(turns, _remainder(F.col("conv"), 4), F.col("conv") - F.col("conv") % 20))


ORACLES["op12_prefix_trie"] = f"""
with recursive turns as materialized (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
    from conversations where conv_id is not null
),
convs as materialized (select c, c - c % 20 as donor, {_crc32_sql('c::varchar')} % 4 as h from (select distinct c from turns)),
rebuilt as materialized (
    select c, row_number() over (partition by c order by own, k) as pos, role, text from (
        select v.c, false as own, t.k, t.role, t.text from convs v join turns t on t.c = v.donor and t.k <= v.h
        union all
        select v.c, true, t.k, t.role, t.text from convs v join turns t on t.c = v.c and t.k > v.h)
),
rows as materialized (
    select c, pos, md5(list([role, text]) over (partition by c order by pos)::varchar || pos) as key,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words
    from rebuilt
    union all
    select c, 0, 'root', 0 from convs
),
chain as materialized (select *, lag(key) over (partition by c order by pos) as up, pos = max(pos) over (partition by c) as ends from rows),
nodes as materialized (
    select key, any_value(up) as up, min(c) as c, any_value(pos) as depth, count(*) as n, any_value(words) as words,
           sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as digest
    from chain group by key
),
kids as (select up as key, count(*) as n from nodes group by up),
sums as (
    select r.key, sum((u.n - 1) * u.words) as saved, count(*) filter (where u.key not in (select key from kids where key is not null)) as leaves
    from nodes u join rows r on r.c = u.c and r.pos <= u.depth group by r.key
)
select n.c as conv_id, n.depth::bigint as depth, p.c as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, s.leaves as n_leaves,
       s.saved::bigint as saved_tokens, n.digest as ends_sha256
from nodes n join sums s using (key) left join kids k on k.key = n.key left join nodes p on p.key = n.up
"""


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    from storyline.llm.toxicity import toxicity_scores

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity_scores(docs, labels, held_out=lambda id: _remainder(id, 3) == 1)
