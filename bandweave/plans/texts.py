"""Registered queries: names, captions, text cleaning, corpus counts and token windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandweave.functions import text as tx
from bandweave.operators import texts as tp
from bandweave.plans.registry import query
from bandweave.plans.views import oracle, sql_uniform
from bandweave.session import materialize

RE2 = tx.PRETOKEN.replace("'", "''")
TOKENS = f"SELECT doc_id, regexp_extract_all(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '{RE2}', 0, 'i') AS toks FROM documents"
COUNTS = "SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM t) GROUP BY token"


@query(
    "f01_key_from_path",
    "SELECT '/data/train/' || o_orderkey || '.npz' AS path, o_orderkey AS key FROM orders",
)
def f01(t):
    paths = t.orders.select(F.concat(F.lit("/data/train/"), F.col("o_orderkey").cast("string"), F.lit(".npz")).alias("path"))
    return paths.withColumn("key", tx.key_from_path(F.col("path")))


@query(
    "f02_parse_artefact",
    """SELECT p_partkey, (p_size % 4)::INTEGER AS target, p_partkey AS trees, NULL::BIGINT AS depth, p_size::BIGINT AS leaf,
              'maxd=None_minsl=' || p_size AS label FROM part""",
)
def f02(t):
    names = t.part.select(
        "p_partkey",
        F.format_string("RF_SIMPLE_ix=[%d]_nest=%d_maxd=None_minsl=%d.bin", F.col("p_size") % 4, "p_partkey", "p_size").alias("name"),
    )
    parsed = tx.parse_artefact(F.col("name"))
    return names.select("p_partkey", *[c.alias(n) for n, c in parsed.items()])


def choice_sql(words, kind: str) -> str:
    listed = ", ".join("'" + w + "'" for w in words)
    draw = sql_uniform(33, f"p_partkey || ':{kind}'")
    return f"([{listed}])[floor({draw} * {len(words)})::INTEGER + 1]"


@query(
    "f03_caption",
    f"""SELECT p_partkey, 'This is ' || {choice_sql(tx.ADJECTIVES, 'adjective')} || ' ' || {choice_sql(tx.NOUNS, 'noun')} || ' of the ' || p_name
          || ' from the ' || {choice_sql(tx.PLACES, 'place')} AS caption, 'This is a photo of the ' || p_name AS plain FROM part""",
)
def f03(t):
    return t.part.select(
        "p_partkey", tx.caption(F.col("p_name"), 33, F.col("p_partkey")).alias("caption"), tx.plain_caption(F.col("p_name")).alias("plain")
    )


def unescape_sql(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@query(
    "f04_clean_text",
    f"""SELECT page_id AS id, lower(trim(regexp_replace({unescape_sql(unescape_sql('html'))}, '\\s+', ' ', 'g'))) AS text FROM pages
        UNION ALL SELECT -1 - doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM documents""",
)
def f04(t):
    pages = t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = t.documents.select((F.lit(-1) - F.col("doc_id")).alias("id"), "text")
    return pages.unionByName(docs).select("id", tx.clean_text(F.col("text")).alias("text"))


@query("f05_pretoken_counts", oracle("", "SELECT token, n FROM c", t=TOKENS, c=COUNTS))
def f05(t):
    return tp.pretoken_counts(t.documents)


VOCAB = f"SELECT token, row_number() OVER (ORDER BY n DESC, {sql_uniform(0, 'token')}, token) AS id FROM c"


@query(
    "f06_token_window",
    oracle(
        "",
        """SELECT doc_id, CAST(p AS INTEGER) AS pos, CASE WHEN p = 0 THEN size + 1 WHEN p = least(n, 75) + 1 THEN size + 2 WHEN p > least(n, 75) + 1 THEN 0 ELSE id END AS id
           FROM (SELECT d.doc_id, len(toks) AS n, p, (SELECT count(*) FROM vocab) AS size, toks[p] AS token FROM t d, range(77) AS r(p)) LEFT JOIN vocab USING (token)""",
        t=TOKENS,
        c=COUNTS,
        vocab=VOCAB,
    ),
)
def f06(t):
    docs = t.documents
    counts = materialize(tp.pretoken_counts(docs), "counts")
    rows = tp.token_window(docs, tp.vocabulary(counts), counts.count(), truncate=True)
    return rows.select("doc_id", F.posexplode("ids").alias("pos", "id"))


@query(
    "f06b_token_window_reject",
    oracle(
        "",
        """SELECT doc_id, len(toks) > 75 AS too_long, CASE WHEN len(toks) <= 75 THEN 77::BIGINT END AS filled FROM t""",
        t=TOKENS,
    ),
)
def f06b(t):
    docs = t.documents
    counts = materialize(tp.pretoken_counts(docs), "counts")
    rows = tp.token_window(docs, tp.vocabulary(counts), counts.count(), truncate=False)
    return rows.select("doc_id", "too_long", F.when(F.col("ids").isNotNull(), F.size("ids").cast("bigint")).alias("filled"))


@query(
    "f07_pair_counts",
    oracle(
        "",
        """SELECT first, second, sum(n)::BIGINT AS n FROM (
             SELECT DISTINCT token, n, substr(token, i, 1) AS first,
                substr(token, i + 1, 1) || CASE WHEN i + 1 = length(token) THEN '</w>' ELSE '' END AS second
             FROM c, LATERAL (SELECT unnest(range(1, length(token))) AS i)) GROUP BY ALL""",
        t=TOKENS,
        c=COUNTS,
    ),
)
def f07(t):
    return tp.pair_counts(t.documents)


@query("f08_run_id", "SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS run_id FROM events")
def f08(t):
    return t.events.select("event_id", tx.run_id(F.col("ts")).alias("run_id"))
