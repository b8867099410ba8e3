"""Queries of the operators in this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxon.llm import (
    apportion,
    chat_parts,
    factor_machine,
    hilbert_search,
    language_mixture,
    lattice_lm,
    lexical_search,
    license_notices,
    merkle_audit,
    oph_minhash,
    va_clustering,
    vector_packing,
    weak_quality,
)
from taxon.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the session and the table folder under its name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.fit_languages(docs.filter(~held_out("doc_id")))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), language_mixture.language_of(model, "text").alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score", "l.n_languages", "l.mixture")


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(concat(CAST(doc_id AS VARCHAR), '|17')) AS h
    FROM documents),
sources AS (
    SELECT source, sum(size) AS source_size, count(*) AS n_docs,
           row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (
    SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS stop,
           CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sources),
levelled AS (
    SELECT w.*, (w.total - (SELECT coalesce(sum(o.stop), 0) FROM weighed o
                            WHERE (o.stop / o.weight, o.place) < (w.stop / w.weight, w.place)))
              / (SELECT sum(o.weight) FROM weighed o
                 WHERE (o.stop / o.weight, o.place) >= (w.stop / w.weight, w.place)) AS level
    FROM weighed w),
goals AS (
    SELECT *, least(stop, weight * (SELECT max(level) FROM levelled WHERE level * weight <= stop)) AS target FROM levelled),
seats AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS blocks, count(*) AS k, sum(target) AS votes FROM goals),
quotients AS (
    SELECT g.place, g.target / (2 * held + 1) AS quotient, held
    FROM goals g, seats s, range((SELECT CAST(2 * blocks + 10 AS BIGINT) FROM seats)) r(held)
    WHERE g.target > 0 AND held <= 2 * s.blocks * g.target / s.votes + s.k + 5),
quotas AS (
    SELECT place, count(*) AS quota
    FROM (SELECT place, row_number() OVER (ORDER BY quotient DESC, place, held) AS rank FROM quotients)
    WHERE rank <= (SELECT blocks FROM seats) GROUP BY place),
placed AS (
    SELECT d.doc_id, d.size, d.h, g.place, g.source_size, g.target, coalesce(q.quota, 0) AS quota,
           CAST(concat('0x', substr(d.h, 1, 8)) AS BIGINT) % least(4096, CAST(ceil(g.n_docs / 512.0) AS BIGINT)) AS shard
    FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN quotas q ON q.place = g.place),
shards AS (
    SELECT place, shard, sum(size) AS ring, max(quota) AS quota,
           sum(sum(size)) OVER (PARTITION BY place) AS votes, count(*) OVER (PARTITION BY place) AS k
    FROM placed GROUP BY place, shard),
shard_quotients AS (
    SELECT place, shard, quota, held, ring / CAST(2 * held + 1 AS DOUBLE) AS quotient
    FROM shards s, range((SELECT CAST(2 * max(quota) + 10 AS BIGINT) FROM shards)) r(held)
    WHERE ring > 0 AND held <= 2 * quota * ring / votes + k + 5),
dealt AS (
    SELECT place, shard, count(*) AS won
    FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard, held) AS rank FROM shard_quotients)
    WHERE rank <= quota GROUP BY place, shard),
laid AS (
    SELECT p.*, s.ring, coalesce(w.won, 0) * 32 AS words,
           sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY substr(h, 9, 24), doc_id, size
                           ROWS UNBOUNDED PRECEDING) - size AS before
    FROM placed p JOIN shards s ON s.place = p.place AND s.shard = p.shard
    LEFT JOIN dealt w ON w.place = p.place AND w.shard = p.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(least(3 * size, words // greatest(ring, 1) * size
                  + greatest(0, least(size, words - words // greatest(ring, 1) * ring - before))) AS BIGINT) AS taken
FROM laid"""


@query(MIX_SQL)
def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix_sources(table(spark, sf_dir, "documents"))


@query()
def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.assess(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("quality").alias("posterior"), "votes",
    )


@query()
def op10_oph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(text) + 7
                + len(regexp_extract_all(concat(role, chr(10), text), '[<\[]\x{2060}*(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])'))
                + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), '')))) AS BIGINT) AS formatted_chars,
       CAST(sum(ceil(strlen(text) / 4.0)) AS BIGINT) AS n_tokens
FROM rows GROUP BY conv_id"""


@query(CHAT_SQL)
def op2_typed_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    turns = rows.unionByName(probe).withColumn("parts", chat_parts.text_parts(F.col("text")))
    return chat_parts.read_back(chat_parts.format_chats(turns))


@query()
def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = factor_machine.train(docs.filter(~held_out("doc_id")), labels.filter(~held_out("doc_id")), metadata=["n_chars"])
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), factor_machine.score(machine, "text", ["n_chars"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op5_fuzzy_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_notices.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_notices"))


@query()
def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


MERKLE_SQL = r"""
WITH laid AS (
    SELECT page_id, page_id // 1000 AS archive,
           concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:record:', CAST(page_id AS VARCHAR),
                  '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
                  'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
                  chr(13), chr(10), chr(13), chr(10)) AS content
    FROM pages WHERE page_id IS NOT NULL),
placed AS (
    SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY archive ORDER BY page_id, strlen(content)
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM laid),
copied AS (
    SELECT *, CASE WHEN page_id % 97 = 5 THEN concat(substring(content, 1, length(content) - 6), '?', substring(content, length(content) - 4)) ELSE content END AS copy,
           page_id % 211 = 7 AS lost FROM placed)
SELECT archive, CAST(place AS BIGINT) AS "offset", CASE WHEN lost THEN 'missing' ELSE 'changed' END AS finding,
       sha256(content) AS left_digest, CASE WHEN NOT lost THEN sha256(copy) END AS right_digest
FROM copied WHERE lost OR content <> copy"""


@query(MERKLE_SQL)
def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which some records have a byte changed and some are lost."""
    records = merkle_audit.warc_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    damaged = F.concat(F.expr("substring(content, 1, length(content) - 6)"), F.lit("?"), F.expr("substring(content, length(content) - 4)"))
    copy = records.filter(F.col("record_id") % 211 != 7).withColumn(
        "content", F.when(F.col("record_id") % 97 == 5, damaged).otherwise(F.col("content"))
    )
    return merkle_audit.audit(merkle_audit.build(records, "left"), merkle_audit.build(copy, "right"))


SEARCH_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
totals AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d),
tokens AS (SELECT row, len(terms) AS n, unnest(terms) AS term FROM d),
postings AS (SELECT term, row, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n FROM tokens GROUP BY term, row),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
impacts AS (
    SELECT p.term, p.row,
           CAST(floor(1000 * ln((2.0 * t.big_n + 2) / (2.0 * f.df + 1))) AS BIGINT)
           * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * t.big_n) // t.big_l))) AS impact
    FROM postings p JOIN freq f USING (term), totals t),
scores AS (
    SELECT a.item_id, i.row, sum(i.impact) AS score FROM asked a JOIN impacts i USING (term) GROUP BY a.item_id, i.row),
ranked AS (
    SELECT s.item_id, d.doc_id, s.score,
           row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST, s.row) AS rank
    FROM scores s JOIN d USING (row) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50"""


@query(SEARCH_SQL)
def op11_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents, 50 best each, term at a time with limited accumulators."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _kmeans_sql(rounds: int = 3, k: int = 16, dims: int = 64) -> str:
    """DuckDB SQL of the clustering: seeds, then ``rounds`` of assignment and update, then one more assignment."""
    dist = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    parts = [
        f"""v AS (
    SELECT row_number() OVER () AS rk, vec_id,
           list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {dims}
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY seed NULLS LAST, q) - 1 AS INTEGER) AS cluster, q
    FROM (SELECT q, sha256('1:' || CAST(vec_id AS VARCHAR)) AS seed FROM v ORDER BY seed NULLS LAST, q LIMIT {k}))""",
    ]
    for r in range(1, rounds + 2):
        parts.append(
            f"""a{r} AS (
    SELECT v.vec_id, v.q, arg_min(c.cluster, struct_pack(d := {dist}, c := c.cluster)) AS cluster,
           min({dist}) AS distance
    FROM v, c{r - 1} c GROUP BY v.rk, v.vec_id, v.q)"""
        )
        if r <= rounds:
            parts.append(
                f"""s{r} AS (
    SELECT a.cluster, t.i, sum(a.q[t.i]) AS s, count(*) AS n FROM a{r} a, range(1, {dims + 1}) t(i) GROUP BY a.cluster, t.i),
c{r} AS (
    SELECT c.cluster, CASE WHEN max(s.n) IS NULL THEN any_value(c.q)
                           ELSE list(CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) ORDER BY s.i) END AS q
    FROM c{r - 1} c LEFT JOIN s{r} s ON s.cluster = c.cluster GROUP BY c.cluster)"""
            )
    last = rounds + 1
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{last} a JOIN c{rounds} c ON c.cluster = a.cluster"""
    )


@query(_kmeans_sql())
def op12_va_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after 3 rounds, nearest centroids found through the vector-approximation file."""
    return va_clustering.cluster(table(spark, sf_dir, "embeddings"))


@query()
def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by subword lattices whose unit probabilities are learned on the other documents."""
    docs = table(spark, sf_dir, "documents")
    model = lattice_lm.train(docs.filter(~lattice_lm.held_out(F.col("doc_id"))))
    return lattice_lm.score(docs, model)
