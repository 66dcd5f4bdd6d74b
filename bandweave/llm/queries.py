"""Registered queries of the operators, one per operator, over whole tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm import ann, bpe, collocations, jaccard, langid, packing, quality, resample, scoring, sentences, suffixes, topk, url_rules
from bandweave.llm.blocks import finite
from bandweave.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(pieces)


@query("op9_bpe")
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URL_SQL = r"""
with parsed as (
    select page_id,
        case when contains(url, '://') then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when contains(url, '://') then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path
    from pages
), rules as (
    select * from (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r (rule_host, rule_path, rule_verdict)
), fits as (
    select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
        row_number() over (partition by page_id order by length(rule_host) desc nulls last, length(rule_path) desc) as place
    from parsed left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1
"""


@query("op4_url_filter", URL_SQL)
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


TOPK_SQL = """
with scaled as (
    select vec_id, [floor(64 * x::double) for x in embedding] as v
    from embeddings
    where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scores as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from scaled q join scaled c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scores
)
select * from ranked where rank <= 20
"""


@query("op3_topk", TOPK_SQL)
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "embeddings").where(finite(F.col("embedding")))  # floors of NaN and infinity are finite
    vectors = known.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("embedding"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query("op6_ann")
def op6_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def held_out(doc_id="doc_id"):
    """Rows kept from training: one in five by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op5_langid")
def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_sentence_dedup")
def op7_sentence_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentences.dedup(docs, counts=("n_sentences", "n_removed"))


@query("op10_jaccard")
def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.classes(table(spark, folder, "documents"), n=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), trusted_ids(table(spark, folder, "labels")))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


COLLOCATION_SQL = r"""
with texts as (
    select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null
), pieces as (
    select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts
), placed as (
    select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), sized as (
    select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as words from placed
), counted as (
    select lang, words, array_to_string(w[i : i + words - 1], ' ') as phrase, count(*) as f from sized group by all
), totals as (
    select lang, sum(f)::hugeint as n from counted where words = 1 group by lang
), known as (
    select * from counted where f >= 100
), candidates as (
    select lang, phrase, words, f as a, string_split(phrase, ' ') as w from known where words > 1
), cuts as (
    select lang, phrase, words, a, w, unnest(range(1, words)) as k from candidates
), scored as (
    select c.lang, c.phrase, c.words, c.a, c.k, x.f as l, y.f as r, t.n, (1000 * c.a::hugeint * t.n) // (x.f::hugeint * y.f::hugeint) as score
    from cuts c
    join known x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
    join known y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.words], ' ')
    join totals t on t.lang = c.lang
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), spans as (
    select lang, a, w, words, unnest(range(2, words)) as size from candidates
), starts as (
    select lang, a, w, size, unnest(range(1, words - size + 2)) as i from spans
), inner_phrases as (
    select lang, array_to_string(w[i : i + size - 1], ' ') as phrase, max(a) as around from starts group by all
), placed_best as (
    select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
    from best b left join inner_phrases p on p.lang = b.lang and p.phrase = b.phrase
    where p.around is null or 100 * p.around < 100 * b.a
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from placed_best where rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


@query("op13_resample")
def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_lm_score")
def op12_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scoring.score(table(spark, folder, "documents"), held, public_tokenizers.path("byte_bpe_50k.tiktoken"))
