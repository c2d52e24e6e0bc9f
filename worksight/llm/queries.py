"""The registered queries of this folder and their SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.materialize import materialize
from . import (decontaminate, html_text, lines, minhash, mixing, neighbours, quality, sharding, statistics, token_counts,
               token_files, toxicity, trie, whitening)

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    out = lines.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"),
                      F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op2_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(c("text")).alias("size"))
    mixed = mixing.mix(materialize(docs, "mix-docs"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies",
                        (c("copies") * c("size")).alias("taken"))


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("component_label")


def op7_benchmark_decontamination(spark, sf_dir):
    scanned = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                          table(spark, sf_dir, "benchmark"))
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                          (c("n_hit") > 0).alias("contaminated"))


def op4_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.fold(c("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), quality.fold(c("id"), 3) != 1)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                              F.when(c("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_token_files(spark, sf_dir):
    import public_tokenizers
    folder = token_files.folder_of(spark)
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(manifest, folder)


def op9_token_counts(spark, sf_dir):
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.drop("text")


def op10_quality_classifier(spark, sf_dir):
    measured = materialize(statistics.add_statistics(table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    held_out = quality.fold(c("doc_id"), 5) == 0
    scored = quality.score(measured, table(spark, sf_dir, "labels"), ~held_out, measured=measured)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(c("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark, sf_dir):
    return trie.prefix_trie(trie.with_shared_heads(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_source_mixing, op3_minhash_near_dedup, op4_nearest_neighbours, op5_toxicity, op6_sharding,
    op7_benchmark_decontamination, op8_token_files, op9_token_counts, op10_quality_classifier, op11_html_extraction,
    op12_embedding_whitening, op13_conversation_trie)}
ORACLE = {
    "op4_nearest_neighbours": """
with ok as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
           from ok q join ok c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20""",
    "op13_conversation_trie": """
with clean as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by turn nulls first,
                             sha256(strlen(role) || ':' || role || text)) as turns from clean group by conv_id),
headed as (select conv_id, turns, list_reduce(list_prepend(4294967295::bigint,
               list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                   lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) as crc from own),
measured as (select conv_id, turns, cast(xor(crc, 4294967295) % 9 as bigint) as h from headed),
rebuilt as (select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
            from measured a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
stops as (select conv_id, turns, unnest(range(len(turns) + 1)) as depth from rebuilt),
paths as (select conv_id, depth, depth = len(turns) as ends, turns[1:depth] as path, sha256(to_json(turns[1:depth])::varchar) as node,
                 sha256(to_json(turns[1:depth - 1])::varchar) as parent from stops),
nodes as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(if(depth > 0, parent, null)) as parent,
                 coalesce(strlen(any_value(path)[-1].text), 0) as size,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
          from paths group by node, depth),
children as (select parent as node, count(*) as n_children from nodes group by parent),
counted as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (node)),
below as (select distinct a.node as above, p.node from paths a join paths p on a.conv_id = p.conv_id and a.depth <= p.depth),
subtree as (select above as node, cast(sum((c.n_children = 0)::int) as bigint) as n_leaves,
                   cast(sum((c.n_convs - 1) * c.size) as bigint) as saved_tokens
            from below b join counted c on c.node = b.node group by above)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
from counted c join subtree s using (node) left join nodes p on p.node = c.parent""",
}
