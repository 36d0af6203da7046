"""The thin ``opN_<name>`` queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import centroids, decontam, licenses, lm, mixing, nndescent, packing, quality, sharding, simhash, spelling, toxicity, warc
from proofsheet.llm.text import held_out

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_lm_score")
def op1(spark, sf):
    return lm.score(table(spark, sf, "documents").select("doc_id", "text"), ~held_out(F.col("doc_id"), 7, 2))


@register("op2_license_scan")
def op2(spark, sf):
    out = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@register("op3_decontaminate", f"""
with d as (select doc_id, {SQL_WORDS} w from documents),
b as (select item_id, {SQL_WORDS} w from benchmark),
i as (select item_id, least(len(w), 10) n, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) s from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[s + 1:s + n], ' ') win from i),
ns as (select distinct n from bw),
p as (select doc_id, n, w, unnest(range(0, len(w) - n + 1)) s from d, ns where len(w) >= n),
occ as (select p.doc_id, p.s, p.n, bw.item_id from p join bw on bw.n = p.n and bw.win = array_to_string(p.w[p.s + 1:p.s + p.n], ' ')),
hit as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(s, s + n)) k from (select distinct doc_id, s, n from occ)) group by 1),
it as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) items from (select distinct doc_id, cast(item_id as varchar) x from occ) group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
from d left join hit using (doc_id) left join it using (doc_id)
""")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, sf, "benchmark").select("item_id", "text"))


@register("op4_toxicity")
def op4(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 3, 1)
    weights, bias = toxicity.train(docs, labels, ~out)
    return toxicity.score(docs, weights, bias).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@register("op5_simhash")
def op5(spark, sf):
    out = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@register("op6_embedding_dedup")
def op6(spark, sf):
    return nndescent.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


@register("op7_sharding")
def op7(spark, sf):
    return sharding.shard_index(table(spark, sf, "documents").select("doc_id", "text"), 16)


#: Production weights of the mixture: domain, language, source.
DOMAINS = ["web", "reference", "forum", "code"]
DOMAIN_WEIGHTS = ({"web": 0.4, "reference": 0.3, "forum": 0.2, "code": 0.1}, 0.05)
LANG_WEIGHTS = ({"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, 0.05)
SOURCE_WEIGHTS = ({"src0": 2.0}, 1.0)
MIX_WEIGHTS = [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS]
MIX_SEED = 17


def mix_levels() -> dict[str, Column]:
    """Domain by the source's number (others: other), language, source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"^src([0-9]{1,9})$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(
        F.element_at(F.array(*map(F.lit, DOMAINS)), number.try_cast("int") % len(DOMAINS) + 1))
    return {"domain": domain, "node_lang": F.col("lang"), "node_source": F.col("source")}


@register("op8_mix_sources")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, budget_share=0.8, max_epochs=3, seed=MIX_SEED)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


#: Grades from the ratings: poor 0, usable but toxic 1, good 2.
GRADE = "case when quality = 0 then 0 when quality = 1 and toxic = 1 then 1 when quality = 1 then 2 end"
GRADE_KEEP, TAIL_KEEP = 1.0, 0.5


@register("op10_quality")
def op10(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    out = held_out(F.col("doc_id"), 5, 1)
    model = quality.train(docs, labels, F.expr(GRADE), ~out)
    return quality.grade(docs, model, GRADE_KEEP).select(
        "doc_id", out.alias("held_out"), "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= TAIL_KEEP).alias("kept"))


@register("op9_warc")
def op9(spark, sf):
    out = warc.round_trip(table(spark, sf, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CLUSTERS, CLUSTER_ROUNDS = 8, 10


def clusters_sql() -> str:
    """All rounds as one chain of CTEs; every sum is one of integers."""
    near = """a{0} as materialized (select v.r, any_value(v.vec_id) vec_id, any_value(v.e) e,
      min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))), 'c': c.c}}) m from v, c{0} c group by v.r)"""
    ctes = ["""v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e
      from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
            """c0 as materialized (select row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), e) - 1 c, e from v
      order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), e limit 8)"""]
    for i in range(CLUSTER_ROUNDS + 1):
        ctes.append(near.format(i))
        if i < CLUSTER_ROUNDS:
            ctes.append(f"""c{i + 1} as materialized (select c{i}.c, coalesce(w.e, c{i}.e) e from c{i} left join
      (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) e from
        (select m.c c, i, sum(e[i]) s, count(*) n from a{i}, (select unnest(range(1, 65)) i) group by 1, 2) group by c) w using (c))""")
    last = CLUSTER_ROUNDS
    return f"""with {', '.join(ctes)}
    select vec_id, cast(m.c as int) "cluster", cast(m.d as bigint) distance, cast(sum(m.d) over (partition by m.c) as bigint) cluster_inertia,
      cast(sum(m.d) over () as bigint) inertia, sha256(array_to_string(c.e, ',')) centroid_sha256 from a{last} join c{last} c on c.c = m.c"""


@register("op11_centroid_clusters", clusters_sql())
def op11(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, k=CLUSTERS, rounds=CLUSTER_ROUNDS).drop("centroid")


#: crc32 by bytes (its table follows from the polynomial); a run's bytes are its code points, those of À-ÿ in two bytes.
SPELLING_SQL = f"""
with recursive crc_table as materialized (select list(t order by b) tab from (select b, list_reduce(list_prepend(cast(b as bigint), range(8)),
    lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) t from (select unnest(range(256)) b))),
runs as (select coalesce(cast(doc_id as varchar), '') id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) run from documents),
once as (select id, run, count(*) k from runs where length(run) >= 5 group by 1, 2),
bytes as (select run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
    case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195, unicode(c) - 64] end)) b from once),
hashed as (select run, k, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) h
    from bytes, crc_table),
w as (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, k from hashed),
words as materialized (select word, cast(sum(k) as bigint) n from w where length(word) >= 5 group by 1 having sum(k) >= 3),
less as materialized (select word, n, i, word[:i] || word[i + 2:] v from (select word, n, unnest(range(length(word))) i from words)),
near as (select a.word, b.word u, b.n m from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from less a join words b on a.v = b.word union select b.word, a.word, a.n from less a join words b on a.v = b.word),
best as (select word, count(*) n_near, min({{'m': -m, 'u': u}}) b from near group by 1),
f as materialized (select words.word, words.n, coalesce(n_near, 0) n_near, case when -b.m >= 2 * words.n then b.u end form,
    case when -b.m >= 2 * words.n then cast(-b.m as bigint) end form_n from words left join best on best.word = words.word),
chain as (select word, word here, 0 d from f union all select chain.word, f.form, d + 1 from chain join f on f.word = chain.here where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, arg_max(here, d) root from chain group by 1) r on r.word = f.word
"""


@register("op12_spelling_variants", SPELLING_SQL)
def op12(spark, sf):
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))


@register("op13_packing")
def op13(spark, sf):
    out = packing.pack(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
