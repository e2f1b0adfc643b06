"""One registered query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import language_model, quality, sentence_pieces, toxicity
from residua.llm.centroids import CLUSTERS, ROUNDS, centroid_clusters
from residua.llm.contamination import contamination
from residua.llm.pieces import load_pieces
from residua.llm.repeats import remove_repeats
from residua.llm.shingle_join import shingle_join
from residua.llm.suffix_dedup import remove_earlier_passages
from residua.llm.token_counts import count_tokens
from residua.llm.tokenizer_alignment import align_tokenizers, load_pair
from residua.llm.url_filter import Rule, judge_urls
from residua.llm.vector_neighbours import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_list_sql(column: str, separators: str, lower: bool) -> str:
    text = f"coalesce({column}, '')"
    if lower:
        text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({text}, '{separators}'), lambda x: x <> '')"


BLANK = "[\\x20\\x09-\\x0D]+"


@register(
    "op1_substring_dedup",
    f"""WITH t AS (SELECT doc_id, {word_list_sql('text', BLANK, False)} AS w FROM documents),
    v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
    r AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM v SEMI JOIN r USING (h), (SELECT unnest(range(0, 35)) AS k)),
    lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
      sha256(CASE WHEN l IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(l, i)), ' ') END) AS kept_sha256
    FROM t LEFT JOIN lost USING (doc_id)""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("kept"), F.lit("")), 256)
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@register(
    "op7_decontamination",
    f"""WITH d AS (SELECT doc_id, {word_list_sql('text', ALNUM, True)} AS w FROM documents),
    b AS (SELECT item_id, {word_list_sql('text', ALNUM, True)} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, md5(array_to_string(w[i:i + least(len(w), 10) - 1], ' ')) AS h
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    ns AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, md5(array_to_string(w[i:i + n - 1], ' ')) AS h
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
    hits AS (SELECT DISTINCT doc_id, n, i, item_id FROM dw JOIN bw USING (n, h)),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, (SELECT unnest(range(0, 10)) AS k) WHERE k < n GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


URL_RULES = [
    Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False),
]
_CANONICAL = """CASE WHEN contains({u}, '://') THEN concat(
    regexp_replace(regexp_replace(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\\.', ''), ':(80|443)$', ''),
    regexp_replace(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', ''),
    CASE WHEN {q} <> '' THEN concat('?', {q}) ELSE '' END) END"""
_QUERY = "regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '')"


def _canonical_sql(u: str) -> str:
    return _CANONICAL.format(u=u, q=_QUERY.format(u=u))


@register(
    "op3_url_filter",
    f"""WITH RECURSIVE rules(h, p, allow) AS (VALUES {', '.join(f"('{r.host}', '{r.path}', {r.allow})" for r in URL_RULES)}),
    raw AS (SELECT page_id, url,
      coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_canonical_sql('url')} AS alias,
      list_concat(
        list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')), lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1)),
        list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')), lambda t: regexp_extract(t, '(?i)\\burl\\s*=\\s*([^"''>\\s]+)', 1))) AS found
      FROM pages),
    best AS (SELECT page_id, arg_max((h || p, allow), (length(h || p), allow)) AS b FROM raw, rules
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
    links AS (SELECT alias, CASE WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t ELSE t END AS t
      FROM (SELECT alias, url, unnest(found) AS t FROM raw)),
    e AS (SELECT DISTINCT a, b FROM (SELECT alias AS a, {_canonical_sql('t')} AS b FROM links WHERE contains(t, '://')) WHERE a <> b),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(a, b) AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
    comp AS (SELECT a AS alias, least(a, min(b)) AS component FROM reach GROUP BY a),
    placed AS (SELECT raw.page_id, host, path, b[1] AS rule, b[2] AS allow, coalesce(component, raw.alias) AS component
      FROM raw LEFT JOIN best USING (page_id) LEFT JOIN comp ON comp.alias = raw.alias),
    decided AS (SELECT component, bool_or(allow) AS any_allow FROM placed WHERE allow IS NOT NULL GROUP BY component)
    SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, any_allow, true) THEN 'allow' ELSE 'block' END AS verdict
    FROM placed LEFT JOIN decided ON decided.component = placed.component""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def fold(modulus: int, key: str = "doc_id"):
    """crc32 of the key as text, modulo."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


@register("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(7) == 2, F.lit(False))
    model = language_model.fit(docs.where(~held_out))
    return language_model.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@register("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    machine = quality.fit(docs.where(~held_out).join(labels, "doc_id"), metadata=["n_chars"])
    p = F.col("score")
    return quality.score(docs, machine, metadata=["n_chars"]).select(
        "doc_id", held_out.alias("held_out"), "score", (p >= 0.3).cast("int").alias("predicted")
    )


@register("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    lexicon = toxicity.fit(docs.where(~held_out).join(labels, "doc_id"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits"
    )


@register(
    "op8_ngram_jaccard",
    f"""WITH RECURSIVE t AS (SELECT doc_id, {word_list_sql('text', BLANK, True)} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(a, b) AS (SELECT a, b FROM g UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(least.b, t.doc_id)) AS component_id
    FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = t.doc_id""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join(table(spark, folder, "documents"))


@register(
    "op4_embedding_near_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.9),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


@register("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pieces = load_pieces()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentence_pieces.encode(docs, pieces, exact=True).select("doc_id", "n_tokens", "ids", "exact")


@register("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs, load_pieces()).select("doc_id", "n_tokens", "n_pre_tokens")


@register(
    "op11_suffix_array_dedup",
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    y AS (SELECT doc_id, o, substr(x, 2 * o + 1, 1098) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, 500)) AS o FROM d)),
    v AS (SELECT doc_id, o + j AS i, md5(substr(y, 2 * j + 1, 100)) AS h FROM (SELECT doc_id, o, y, unnest(range(0, len(y) // 2 - 49)) AS j FROM y)),
    m AS (SELECT h, min(doc_id) AS m FROM v GROUP BY h HAVING count(*) > 1),
    s AS (SELECT doc_id, i FROM v JOIN m USING (h) WHERE doc_id > m),
    r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r) GROUP BY doc_id, g),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
    left_over AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS upto, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
      FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
      sha256(unhex(CASE WHEN k IS NULL THEN x ELSE k || substr(x, 2 * upto + 1) END)) AS kept_sha256
    FROM d LEFT JOIN left_over USING (doc_id)""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("kept", F.lit(b"")), 256)
    return remove_earlier_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


def _centroid_sql(clusters: int, rounds: int) -> str:
    """The rounds written out; the centroids of a round are one list of lists."""
    best = "list_min(list_transform(range(0, len(c)), lambda k: {'d': list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[k + 1][i]) * (x[i] - c[k + 1][i])))::BIGINT, 'k': k}))"
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT list(x ORDER BY h, x) AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED (SELECT x, {best} AS b FROM v, c{r})",
            f"s{r} AS (SELECT b.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)",
            f"n{r} AS (SELECT k, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY i) AS z FROM s{r} GROUP BY k)",
            f"c{r + 1} AS MATERIALIZED (SELECT list(coalesce(z, o) ORDER BY j) AS c FROM (SELECT unnest(c) AS o, unnest(range(0, len(c))) AS j FROM c{r}) LEFT JOIN n{r} ON k = j)",
        ]
    return f"""WITH {', '.join(steps)},
    e AS MATERIALIZED (SELECT vec_id, {best} AS b, c FROM v, c{rounds})
    SELECT vec_id, b.k::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c[b.k + 1], ',')) AS centroid_sha256 FROM e"""


@register("op12_centroid_clustering", _centroid_sql(CLUSTERS, ROUNDS))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


@register("op13_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return align_tokenizers(docs, load_pair()).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
