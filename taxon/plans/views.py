"""Views in the shapes the operators expect, derived from the given tables.

Views that plain SQL can express are written once and used by both engines. The few that
need array functions have a DataFrame form here and a text form for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxon.functions.labels import with_prediction
from taxon.session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

CLASSES = ["en", "de", "fr", "es"]
# Stop words of two language scorers and the accented letters of a third.
WORDS_A = {"en": ["the", "of", "and"], "de": ["der", "die", "und"], "fr": ["le", "la", "et"], "es": ["el", "los", "de"]}
WORDS_B = {"en": ["in", "to", "is"], "de": ["das", "ist", "ein"], "fr": ["les", "une", "des"], "es": ["que", "en", "por"]}
LETTERS_C = {"en": "w", "de": "äöüß", "fr": "èêçà", "es": "ñóíá"}
MODELS = ["words_a", "words_b", "letters"]

SHARED_SQL = {
    "items": """
        SELECT doc_id, concat('http://www.wikidata.org/entity/Q', CAST(doc_id AS STRING)) AS item,
               split_part(text, chr(10), 1) AS name, text AS description,
               CASE WHEN n_chars > 1500 THEN 'entity' ELSE 'concept' END AS type,
               CASE WHEN source IN ('src11', 'src12', 'src13') THEN '' ELSE source END AS category,
               CASE WHEN source = 'src7' THEN NULL ELSE lang END AS subcategory,
               lang AS label
        FROM {documents}""",
    "uris": """
        SELECT item AS uri FROM {items} UNION ALL SELECT url AS uri FROM {pages}""",
    "facts": """
        SELECT event_id, concat('Q', CAST(event_id AS STRING)) AS qid, user_id, event_type,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM {events}""",
    "page_counts": """
        SELECT page_id, concat('P', CAST(page_id AS STRING)) AS title,
               CASE WHEN contains(url, '#') THEN 1 ELSE 0 END AS missing,
               CAST(length(html) AS BIGINT) AS page_length,
               CAST(length(html) - length(replace(html, '<li>', 'li>')) AS BIGINT) AS n_categories,
               CAST(length(html) - length(replace(html, 'href=', 'href')) AS BIGINT) AS n_links,
               page_id % 60 AS n_languages,
               CASE WHEN contains(url, '?') THEN 1 ELSE 0 END AS located
        FROM {pages}""",
    "claim_features": """
        SELECT qid, user_id, event_type,
               k + CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END AS num_languages,
               CAST(0 AS BIGINT) AS num_interwiki_links,
               1 + p17 + p495 + 2 * p2596 + p625 + p131 + p27 + p361 + p214 * (1 + user_id % 4) + p345
                 + 2 * p1566 + k AS num_statements,
               1 + p17 + p495 + p2596 + p27 + p361 AS num_cultural_properties,
               p17 + p495 + p131 + p27 + p625 AS num_geographic_properties,
               p214 + p345 + p1566 AS num_identifiers,
               1 + p17 + p495 + p2596 + p625 + p131 + p27 + p361 + p214 + p345 + p1566 + p18 AS statement_diversity,
               p625 = 1 AS has_coordinates, p17 = 1 AS has_country, p2596 = 1 AS has_culture_property,
               p495 = 1 AS has_origin_country,
               p17 + p495 + p2596 + p27 + p361 + p131 + p625 AS serving_cultural,
               p17 + p131 + p625 AS serving_geographic,
               p495 + p2596 + p625 + p361 + p214 + p345 + p1566 AS serving_identifiers
        FROM {claim_flags}""",
    "claim_flags": """
        SELECT qid, user_id, event_type, k,
               CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS p17,
               CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS p495,
               CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS BIGINT) AS p2596,
               CAST(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS p625,
               CAST(CASE WHEN k > 50 THEN 1 ELSE 0 END AS BIGINT) AS p131,
               CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS p27,
               CAST(CASE WHEN k > 80 THEN 1 ELSE 0 END AS BIGINT) AS p361,
               CAST(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS BIGINT) AS p214,
               CAST(CASE WHEN k > 30 THEN 1 ELSE 0 END AS BIGINT) AS p345,
               CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS p1566,
               CAST(CASE WHEN k > 0 THEN 1 ELSE 0 END AS BIGINT) AS p18
        FROM {facts}""",
    "raw_features": """
        SELECT c.qid, c.num_languages,
               CASE WHEN p.title IS NULL THEN CAST(0 AS BIGINT) ELSE p.page_length END AS en_page_length,
               c.num_interwiki_links,
               CASE WHEN p.title IS NULL THEN CAST(0 AS BIGINT) ELSE p.n_categories END AS num_categories,
               c.has_coordinates,
               CASE WHEN p.title IS NULL THEN CAST(0 AS BIGINT) ELSE p.n_links END AS num_external_links,
               c.num_statements, c.num_cultural_properties, c.num_geographic_properties, c.has_country,
               c.has_culture_property, c.has_origin_country, c.num_identifiers, c.statement_diversity
        FROM {claim_features} c
        LEFT JOIN (SELECT * FROM {page_counts} WHERE missing = 0) p
               ON p.page_id = c.user_id AND c.event_type IN ('click', 'view')""",
    "catalogue": """
        SELECT concat('http://www.wikidata.org/entity/Q', CAST(p_partkey AS STRING)) AS item,
               upper(p_name) AS name, concat(p_brand, ' ', p_type) AS description,
               CASE WHEN p_size > 25 THEN 'entity' ELSE 'concept' END AS type,
               p_brand AS category, p_type AS subcategory
        FROM {part}""",
    "lookup": """
        SELECT lower(p_name) AS key,
               concat(repeat(concat(max(p_brand), ' and ', max(p_type), '. '), 30), min(p_name)) AS summary,
               true AS found, CAST(max(p_size) AS BIGINT) + 5 AS languages
        FROM {part} WHERE p_name NOT LIKE 'hot %' GROUP BY lower(p_name)""",
    "cached": """
        SELECT l.key, substring(l.summary, 1, 500) AS summary, l.found, l.languages
        FROM {lookup} l WHERE l.key < 'm'""",
    "enriched": """
        SELECT c.item, c.name, c.description AS original, c.type, c.category, c.subcategory,
               CASE WHEN l.key IS NULL THEN '' ELSE l.summary END AS summary,
               CASE WHEN l.key IS NULL THEN false ELSE true END AS found,
               CASE WHEN l.key IS NULL THEN CAST(0 AS BIGINT) ELSE l.languages END AS languages
        FROM {catalogue} c LEFT JOIN {lookup} l ON l.key = lower(c.name)""",
}


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _hits_sql(words: dict[str, list[str]]) -> str:
    return ", ".join(f"len(list_filter(tokens, lambda x: x IN ({_sql_list(words[c])})))" for c in CLASSES)


def _letters_sql() -> str:
    return ", ".join(f"length(low) - length(translate(low, '{LETTERS_C[c]}', ''))" for c in CLASSES)


def _probs_sql(hits: str) -> str:
    return f"list_transform({hits}, lambda h: (h + 1) / CAST(list_sum({hits}) + {len(CLASSES)} AS DOUBLE))"


# Oracle text of the views that need array functions.
ORACLE_SQL = {
    "hits": f"""
        SELECT item, name, category, type, label, doc_id, [{_hits_sql(WORDS_A)}] AS hits_a,
               [{_hits_sql(WORDS_B)}] AS hits_b, [{_letters_sql()}] AS hits_c
        FROM (SELECT *, lower(description) AS low,
                     string_split_regex(lower(description), '[^a-zà-ÿ]+') AS tokens FROM {{items}})""",
    "preds": f"""
        SELECT item, name, category, type, label, doc_id, probs, hits,
               [{_sql_list(CLASSES)}][list_position(probs, list_max(probs))] AS predicted_label,
               list_max(probs) AS confidence
        FROM (SELECT *, hits_a AS hits, {_probs_sql('hits_a')} AS probs FROM {{hits}})""",
    "votes": f"""
        SELECT item, label, doc_id, 0 AS model_idx, 'words_a' AS model, {_probs_sql('hits_a')} AS probs FROM {{hits}}
        UNION ALL
        SELECT item, label, doc_id, 1, 'words_b', {_probs_sql('hits_b')} FROM {{hits}}
        UNION ALL
        SELECT item, label, doc_id, 2, 'letters', {_probs_sql('hits_c')} FROM {{hits}}""",
    "model_preds": f"""
        SELECT item, label, doc_id, model_idx, model, probs,
               [{_sql_list(CLASSES)}][list_position(probs, list_max(probs))] AS predicted_label
        FROM {{votes}}""",
    # exact ranks, spelled out the direct way
    "split_items": """
        SELECT i.*, CASE WHEN i.rn <= q.quota THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42'))) AS rn
              FROM {items}) i
        JOIN (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, label)
                            <= ceil(sum(n) OVER () * CAST(0.2 AS DOUBLE)) - sum(base) OVER () THEN 1 ELSE 0 END AS quota
              FROM (SELECT label, n, floor(n * CAST(0.2 AS DOUBLE)) AS base,
                           round(n * CAST(0.2 AS DOUBLE) - floor(n * CAST(0.2 AS DOUBLE)), 9) AS remainder
                    FROM (SELECT label, count(*) AS n FROM {items} GROUP BY label))) q
        ON q.label = i.label""",
    "fold_sizes": """
        SELECT label, f AS fold,
               sum(dealt) OVER (PARTITION BY label ORDER BY f) AS fold_end
        FROM (SELECT s.label, f, (SELECT count(*) FROM range(s.n) x(v) WHERE (s.off + x.v) % 5 = f) AS dealt
              FROM (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
                    FROM (SELECT label, count(*) AS n FROM {items} GROUP BY label)) s, range(5) g(f))""",
    "fold_items": """
        SELECT i.*, CAST((SELECT count(*) FROM {fold_sizes} z WHERE z.label = i.label AND z.fold_end < i.rn) AS INTEGER) AS fold
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42'))) AS rn
              FROM {items}) i""",
    "confusion": """
        SELECT label, predicted_label, count(*) AS n FROM {preds} GROUP BY label, predicted_label""",
    "class_scores": """
        SELECT class, tp, npred, support, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f
        FROM (SELECT class, tp, npred, support,
                     CASE WHEN npred = 0 THEN 0 ELSE tp / CAST(npred AS DOUBLE) END AS p,
                     CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS r
              FROM (SELECT d.class,
                           (SELECT coalesce(sum(n), 0) FROM {confusion} c WHERE c.label = d.class AND c.predicted_label = d.class) AS tp,
                           (SELECT coalesce(sum(n), 0) FROM {confusion} c WHERE c.predicted_label = d.class) AS npred,
                           (SELECT coalesce(sum(n), 0) FROM {confusion} c WHERE c.label = d.class) AS support
                    FROM (SELECT label AS class FROM {confusion} UNION SELECT predicted_label FROM {confusion}) d))""",
}


ORACLE_SQL["vector_rows"] = "SELECT vec_id, concat('g', CAST(label % 3 AS VARCHAR)) AS label FROM {embeddings}"
ORACLE_SQL["split_vectors"] = ORACLE_SQL["split_items"].replace("{items}", "{vector_rows}").replace("doc_id", "vec_id")


def scores_by(source: str, by: str) -> str:
    """Class scores per group, as a subquery over a view with label and predicted_label."""
    return f"""
        SELECT g, class, tp, npred, support, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f
        FROM (SELECT g, class, tp, npred, support,
                     CASE WHEN npred = 0 THEN 0 ELSE tp / CAST(npred AS DOUBLE) END AS p,
                     CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS r
              FROM (SELECT g, class, sum(tp) AS tp, sum(npred) AS npred, sum(support) AS support
                    FROM (SELECT {by} AS g, label AS class, CASE WHEN label = predicted_label THEN 1 ELSE 0 END AS tp,
                                 0 AS npred, 1 AS support FROM {source}
                          UNION ALL
                          SELECT {by} AS g, predicted_label AS class, 0, 1, 0 FROM {source})
                    GROUP BY g, class))"""


def _depends_on(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def with_views(sql: str) -> str:
    """Oracle statement with every view it needs as a common table expression."""
    texts = {**SHARED_SQL, **ORACLE_SQL}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for dependency in _depends_on(texts[name]):
            visit(dependency)
        order.append(name)

    for name in _depends_on(sql):
        visit(name)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text).strip()

    ctes = ",\n".join(f"{name} AS ({plain(texts[name])})" for name in order)
    return f"WITH {ctes}\n{plain(sql)}" if ctes else plain(sql)


def _hits(words: dict[str, list[str]], tokens: str) -> Column:
    def among(known: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda x: x.isin(known)))

    return F.array(*[among(words[c]) for c in CLASSES])


def _probabilities(hits: str) -> Column:
    total = F.aggregate(hits, F.lit(0), lambda acc, h: acc + h) + len(CLASSES)
    return F.transform(hits, lambda h: (h + 1).cast("double") / total)


def _statements(kind: str, times: Column) -> Column:
    """JSON list of ``times`` equal statements; ``null`` without a number, empty below one."""
    one = f'{{"mainsnak":{{"datatype":"{kind}"}}}}'
    many = F.concat(F.lit("["), F.repeat(F.lit(f"{one},"), times - 1), F.lit(f"{one}]"))
    return F.when(times.isNull(), F.lit("null")).when(times < 1, F.lit("[]")).otherwise(many)


def _present(condition: Column, key: str, statements: Column) -> Column:
    """JSON member of one property, NULL when the entity does not have it."""
    return F.when(condition, F.concat(F.lit(f'"{key}":'), statements))


def _link(condition: Column, site: str, title: Column) -> Column:
    """JSON member of one site link, NULL when there is none; a missing title leaves an empty object."""
    return F.when(condition, F.concat(F.lit(f'"{site}":'), F.coalesce(F.concat(F.lit('{"title":"'), title, F.lit('"}')), F.lit("{}"))))


# A document has some KB, its source row some bytes, so documents are spread by their number.
DOCUMENTS_PER_TASK = 20_000

# (application, source files, name) -> stored table or model; predictions, features and documents are
# products that the operators read from storage, so each is built once for the files it comes from.
_STORED: dict[tuple, str] = {}


class Views:
    """The given tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._state: int | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in SHARED_SQL:
            sql = SHARED_SQL[name]
            return self.spark.sql(sql, **{d: self.view(d) for d in set(_depends_on(sql))})
        return getattr(self, name)

    def source_state(self) -> int:
        """Digest of the paths, sizes and times of all source files; lists them without reading any."""
        if self._state is None:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.sf_dir)
            mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
            self._state = files.select("path", "modificationTime", "length").agg(F.sum(mark)).first()[0]
        return self._state

    def stored_path(self, name: str, write: Callable[[str], None]) -> str:
        """Path in the shared folder that ``write`` fills once for the present source files."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.source_state(), name)
        if key not in _STORED:
            path = scratch_path(self.spark, name)
            write(path)
            _STORED[key] = path
        return _STORED[key]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Table written once to the shared folder; later reads prune its columns."""
        return self.spark.read.parquet(self.stored_path(name, lambda path: build().write.parquet(path)))

    @property
    def items(self) -> DataFrame:
        return self.view("items")

    @property
    def raw_features(self) -> DataFrame:
        return self.stored("raw_features", lambda: self.view("raw_features"))

    @property
    def preds(self) -> DataFrame:
        """Predictions of the first scorer: a projection of the stored evidence."""
        scored = self.evidence.select(
            "item", "name", "category", "type", "label", "doc_id", F.col("hits_a").alias("hits"), _probabilities("hits_a").alias("probs")
        )
        return with_prediction(scored, CLASSES)

    @property
    def model_probs(self) -> DataFrame:
        """One row per item with an array of class probabilities per scorer."""
        scorers = F.array(*[_probabilities(h) for h in ("hits_a", "hits_b", "hits_c")])
        return self.evidence.select("item", "label", "doc_id", scorers.alias("model_probs"))

    @property
    def evidence(self) -> DataFrame:
        """Evidence counts of all scorers, from one pass over the texts."""
        return self.stored("evidence", self.hits)

    @property
    def entity_docs(self) -> DataFrame:
        return self.stored("entity_docs", self._entity_docs)

    @property
    def page_docs(self) -> DataFrame:
        return self.stored("page_docs", self._page_docs)

    def hits(self) -> DataFrame:
        """Evidence counts of the three scorers per item: a projection of the item table."""
        low = F.lower("description")
        known = sorted({w for words in (WORDS_A, WORDS_B) for ws in words.values() for w in ws})
        tokens = F.filter(F.split(low, "[^a-zà-ÿ]+"), lambda x: x.isin(known))
        letters = [F.length(low) - F.length(F.translate(low, LETTERS_C[c], "")) for c in CLASSES]
        return (
            self.items.withColumn("tokens", tokens)
            .withColumns({"hits_a": _hits(WORDS_A, "tokens"), "hits_b": _hits(WORDS_B, "tokens"), "hits_c": F.array(*letters)})
            .drop("tokens", "description", "subcategory", "low")
        )

    @property
    def model_preds(self) -> DataFrame:
        """One row per item and scorer."""
        names = F.array(*[F.lit(m) for m in MODELS])
        long = self.model_probs.select(
            "item", "label", "doc_id", F.posexplode("model_probs").alias("model_idx", "probs")
        ).withColumn("model", F.get(names, F.col("model_idx")))
        return with_prediction(long, CLASSES)

    def _entity_docs(self) -> DataFrame:
        """Entity documents: one nested JSON per fact row, and unreadable ones per nation."""
        k, user = F.col("k"), F.col("user_id")
        is_type = F.col("event_type").isin
        item = _statements("wikibase-item", F.lit(1))
        claims = F.concat_ws(
            ",",
            _present(F.lit(True), "P31", item),
            _present(k % 2 == 0, "P17", item),
            _present(is_type("purchase"), "P495", item),
            _present(is_type("purchase", "signup"), "P2596", _statements("wikibase-item", F.lit(2))),
            _present(user % 3 == 0, "P625", _statements("globe-coordinate", F.lit(1))),
            _present(k > 50, "P131", item),
            _present(k % 5 == 0, "P27", item),
            _present(k > 80, "P361", item),
            _present(~is_type("error"), "P214", _statements("external-id", (1 + user % 4).cast("int"))),
            _present(k > 30, "P345", _statements("external-id", F.lit(1))),
            _present(k > 0, "P18", _statements("string", k.cast("int"))),
            _present(k % 7 == 0, "P1566", F.lit('[{"mainsnak":{"datatype":"string"}},{"mainsnak":{"datatype":"external-id"}}]')),
        )
        numbers = F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)))
        numbered = F.transform(numbers, lambda i: F.concat(F.lit('"l'), i, F.lit('wiki":{"title":"L'), i, F.lit('"}')))
        sitelinks = F.concat_ws(
            ",",
            F.when(k > 0, F.array_join(numbered, ",")),
            _link(is_type("click", "view"), "enwiki", F.concat(F.lit("P"), user.cast("string"))),
            _link(is_type("signup"), "commonswiki", F.lit("C")),
            _link(user % 2 == 0, "enwikiquote", F.lit("Q")),
        )
        parts = [F.lit('{"entities":{"'), F.col("qid"), F.lit('":{"sitelinks":{'), sitelinks, F.lit('},"claims":{'), claims, F.lit("}}}}")]
        facts = self.view("facts")
        spread = facts.repartition(-(-facts.count() // DOCUMENTS_PER_TASK) or 1)
        # an entity without an id cannot be a key of its document
        no_id = F.raise_error(F.lit("an entity needs an id")).cast("string")
        docs = spread.select("qid", F.when(F.col("qid").isNull(), no_id).otherwise(F.concat(*parts)).alias("raw"))
        nation = F.col("n_nationkey")
        bad_qid = F.concat(F.lit("Q"), (F.lit(10**12) + nation).cast("string"))
        empty_branches = F.concat(F.lit('{"entities":{"'), bad_qid, F.lit('":{"sitelinks":[],"claims":[]}}}'))
        bad = self.table("nation").select(
            bad_qid.alias("qid"),
            F.when(nation % 5 == 0, F.lit("{}"))
            .when(nation % 5 == 1, F.lit("[]"))
            .when(nation % 5 == 2, F.lit("junk"))
            .when(nation % 5 == 3, empty_branches)
            .alias("raw"),
        )
        return docs.unionByName(bad)

    def _page_docs(self) -> DataFrame:
        """Page documents by title; a missing page has the id -1 and no content."""
        entry = F.struct(F.lit("x").alias("title"))
        many = lambda c: F.array_repeat(entry, F.col(c).cast("int"))
        missing = F.col("missing") == 1
        page = F.struct(
            F.when(missing, F.lit("")).alias("missing"),
            F.when(~missing, F.col("page_length")).alias("length"),
            F.when(~missing, many("n_categories")).alias("categories"),
            F.when(~missing, many("n_links")).alias("extlinks"),
            F.when(~missing, many("n_languages")).alias("langlinks"),
            F.when(~missing & (F.col("located") == 1), F.lit("here")).alias("coordinates"),
        )
        page_id = F.when(missing, F.lit("-1")).otherwise(F.col("page_id").cast("string"))
        pages = F.struct(F.create_map(page_id, page).alias("pages"))
        return self.view("page_counts").select("title", F.to_json(F.struct(pages.alias("query"))).alias("raw"))
