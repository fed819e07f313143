"""One query opN_<name> for each operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import ann, chat_format, clustering, decontaminate, language, lexical, license_scan, near_dup, pii, quality, sentencepiece_sampling, toxicity, url_filter
from veldra.llm.common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TRICKY = "\\### Assistant: </turn> ok"


def crc_class(n: int):
    """crc32 of the id as text, modulo n: what the folds are made by."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, read back: ids, their number, and whether decoding gives the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = sentencepiece_sampling.encode(docs, keep_text=False, check="lossless")
    return made.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_ids"), "ids", "lossless")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    back = chat_format.read_chats(chat_format.format_chats(turns.unionByName(own)))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))
            + CASE WHEN before = role THEN 6
              ELSE 15 + length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) END AS written
  FROM p
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its near-duplicate class, named by the class's smallest doc_id."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def span_digest(spans, only_base: bool):
    kept = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train(docs)).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(span_digest(F.col("pii"), True), 256).alias("base_sha256"),
        span_digest(F.col("pii"), False).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    field = toxicity.train(docs, labels, crc_class(4) != 2)
    made = docs.select("doc_id", (crc_class(4) == 2).alias("held_out"), toxicity.score(field).alias("t"))
    offsets = F.array_join(F.transform("t.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("doc_id", "held_out", F.col("t.score").alias("score"), F.when(F.col("t.score") >= 0.3, 1).otherwise(0).alias("predicted"), offsets.alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels, crc_class(5) != 0)
    made = docs.select("doc_id", (crc_class(5) == 0).alias("held_out"), quality.score(docs, weights).alias("score"))
    return made.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP9_SQL = """
WITH r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host) + length(rule_path)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""



def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (q.n * v.n) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term
), q AS (
  SELECT DISTINCT row, item_id, term FROM (
    SELECT row_number() OVER () AS row, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), w AS (
  SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c
), m AS (
  SELECT row, doc_id, 100 - 50 + (50 * len(terms) * n) // l AS m FROM d, c
), s AS (
  SELECT q.row, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON m.row = p.row GROUP BY q.row, item_id, m.row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))[0]


def rounds_sql(rounds: int) -> str:
    """One assignment after another: n<i> has the number of each vector's nearest centroid of c<i>."""
    near = """n{i} AS (
  SELECT row, vec_id, v, min(number) AS cluster, min(d)::BIGINT AS distance FROM (
    SELECT row, vec_id, v.v, number, list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v, c{i} AS c
    QUALIFY d = min(d) OVER (PARTITION BY row)
  ) GROUP BY row, vec_id, v
)"""
    move = """m{i} AS (
  SELECT cluster, list(mean ORDER BY place) AS v FROM (
    SELECT cluster, place, floor(sum(x) / count(*))::BIGINT AS mean FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM n{i}) GROUP BY cluster, place
  ) GROUP BY cluster
), c{j} AS (SELECT number, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON number = cluster)"""
    steps = [part.format(i=i, j=i + 1) for i in range(rounds) for part in (near, move)]
    return ", ".join([*steps, near.format(i=rounds)])


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS number, v FROM v WHERE vec_id IS NOT NULL QUALIFY number < 16
), {rounds_sql(3)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM n3 JOIN c3 ON number = cluster
"""


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs.select("doc_id", "text", "lang"), crc_class(5) != 0)
    made = docs.select("doc_id", (crc_class(5) == 0).alias("held_out"), language.identify(net, F.col("text")).alias("t"))
    return made.select("doc_id", "held_out", F.col("t.lang").alias("lang_pred"), F.col("t.score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_format": op2_chat_format,
    "op3_near_dup": op3_near_dup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_ann": op10_ann,
    "op11_lexical": op11_lexical,
    "op12_clusters": op12_clusters,
    "op13_language": op13_language,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_ann": OP10_SQL, "op11_lexical": OP11_SQL, "op12_clusters": OP12_SQL}
