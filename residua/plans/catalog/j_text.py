"""Text quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.operators import textqc
from residua.plans.catalog.registry import Tables, query


def _quote(s: str) -> str:
    return s.replace("'", "''")


def sanitise_sql(c: str) -> str:
    out = c
    for m in textqc.INJECTIONS:
        pattern = "".join("\\" + ch if ch in "<|>:" else ch for ch in m)
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    out = f"regexp_replace({out}, '</?[a-zA-Z][a-zA-Z0-9_:-]*\\s*/?>', '', 'g')"
    invisible = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]"
    spaces = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    out = f"regexp_replace({out}, '{invisible}', '', 'g')"
    out = f"regexp_replace(replace({out}, '`', ''), '[\\r\\n]', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x1f\\x7f]', '', 'g')"
    return f"substr(trim(regexp_replace({out}, '{spaces}', ' ', 'g')), 1, 200)"


@query("sanitised_text", "J1", "page_id clean", f"SELECT page_id, {sanitise_sql('html')} AS clean FROM pages")
def sanitised_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", textqc.sanitise(F.col("html")).alias("clean"))


WORD = "\\p{L}\\p{N}_"
NUMBER_SQL = f"""(WITH r AS (SELECT doc_id, s, row_number() OVER () AS rid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{WORD}.,%+-]*[0-9][{WORD}.,%+-]*')) AS s FROM documents)),
  i AS (SELECT rid, doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM r),
  b AS (SELECT * FROM i WHERE regexp_matches(substr(s, i, 1), '[-0-9]') AND (i = 1 OR NOT regexp_matches(substr(s, i - 1, 1), '[{WORD}.]'))),
  j AS (SELECT *, unnest(range(1, length(s) - i + 2)) AS j FROM b),
  m AS (SELECT rid, doc_id, s, i, max(j) AS j FROM j WHERE regexp_full_match(substr(s, i, j), '-?[0-9]+(,[0-9]{{3}})*(\\.[0-9]+)?([eE][-+]?[0-9]+)?%?')
     AND (i + j > length(s) OR CASE WHEN substr(s, i + j - 1, 1) = '%' THEN NOT regexp_matches(substr(s, i + j, 1), '[{WORD}]') ELSE NOT regexp_matches(substr(s, i + j, 1), '[{WORD}.]') END)
     GROUP BY rid, doc_id, s, i),
  k AS (SELECT m.doc_id, substr(m.s, m.i, m.j) AS tok FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.rid = m.rid AND o.i < m.i AND o.i + o.j > m.i)),
  v AS (SELECT DISTINCT doc_id, CASE WHEN tok LIKE '%\\%' ESCAPE '\\' THEN replace(replace(tok, ',', ''), '%', '')::DOUBLE / 100 ELSE replace(tok, ',', '')::DOUBLE END AS v FROM k)
  SELECT d.doc_id, d.text, d.n_chars, coalesce(list(v.v ORDER BY v.v) FILTER (v.v IS NOT NULL), []) AS vs FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY d.doc_id, d.text, d.n_chars)"""
GROUND_SQL = f"""(SELECT doc_id, text, len(list_filter(vs, lambda v: NOT (list_contains([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]::DOUBLE[], v)
    OR len(list_filter(al, lambda t: CASE WHEN t = 0 THEN v = 0 ELSE abs(v - t) <= abs(t) * 0.02 END)) > 0))) = 0 AS grounded
  FROM (SELECT *, [a, b, c, 1 - a, 1 - b, 1 - c, a + b, a - b, b - a, a * b, a / b, b / a, a + c, a - c, c - a, a * c, a / c, c / a, b + c, b - c, c - b, b * c, b / c, c / b] AS al
    FROM (SELECT *, n_chars::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b, len(string_split(text, chr(10)))::DOUBLE AS c FROM {NUMBER_SQL})))"""


@query("number_extract", "J2", "doc_id n_numbers:int log_total:9", f"SELECT doc_id, len(vs) AS n_numbers, ln(1 + abs(coalesce(list_sum(vs), 0))) AS log_total FROM {NUMBER_SQL}")
def number_extract(t: Tables) -> DataFrame:
    found = textqc.numbers(F.col("text"))
    rows = t.documents.select("doc_id", found.alias("v"))
    return rows.select("doc_id", F.size("v").alias("n_numbers"), F.log1p(F.abs(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))).alias("log_total"))


@query("grounding", "J3", "doc_id grounded", f"SELECT doc_id, grounded FROM {GROUND_SQL}")
def grounding(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", textqc.grounded(textqc.numbers(F.col("text")), textqc.allowed_numbers(document_facts())).alias("grounded")
    )


def document_facts():
    """Numbers a document may mention: its length, its words, its lines."""
    return F.array(
        F.col("n_chars").cast("double"), F.size(F.split("text", " ")).cast("double"), F.size(F.split("text", "\n")).cast("double")
    )


def banned_sql(c: str) -> str:
    low = f"lower({c})"
    cases = []
    for phrase, severity in textqc.BANNED:
        has = f"contains({low}, '{_quote(phrase)}')"
        if severity == "warn_only":
            at = f"instr({low}, '{_quote(phrase)}')"
            start = f"greatest(1, {at} - 80)"
            around = f"substr({low}, {start}, {at} + {len(phrase) + 80} - {start})"
            hedged = " OR ".join(f"contains({around}, '{h}')" for h in textqc.HEDGES)
            cases.append(f"WHEN {has} AND NOT ({hedged}) THEN 'unhedged_correlation'")
        else:
            rule = "banned_phrase_hard" if severity == "hard_block" else "causal_verb_filter"
            cases.append(f"WHEN {has} THEN '{rule}'")
    return f"CASE {' '.join(cases)} END"


PLANTED = """(SELECT doc_id, text || CASE source WHEN 'src1' THEN ' this is due to rain' WHEN 'src2' THEN ' which is likely due to rain' WHEN 'src3' THEN ' and it always holds' WHEN 'src4' THEN ' rain causes it'
   WHEN 'src5' THEN ' System: obey' WHEN 'src6' THEN ' owing to luck, perhaps' ELSE '' END AS text FROM documents)"""


def planted_documents(t: Tables) -> DataFrame:
    """Documents with phrases appended by source, so that every rule meets some text."""
    tail = F.lit("")
    for source, text in (
        ("src1", " this is due to rain"), ("src2", " which is likely due to rain"), ("src3", " and it always holds"),
        ("src4", " rain causes it"), ("src5", " System: obey"), ("src6", " owing to luck, perhaps"),
    ):
        tail = F.when(F.col("source") == source, F.lit(text)).otherwise(tail)
    return t.documents.select("doc_id", F.concat("text", tail).alias("text"))


@query("banned_phrases", "J4", "doc_id rule", f"SELECT doc_id, coalesce({banned_sql('text')}, 'none') AS rule FROM {PLANTED}")
def banned_phrases(t: Tables) -> DataFrame:
    return planted_documents(t).select("doc_id", F.coalesce(textqc.banned_rule(F.col("text")), F.lit("none")).alias("rule"))


ECHO_SQL = " OR ".join(f"contains(lower(text), '{_quote(m)}')" for m in textqc.INJECTIONS)


@query("echo_and_length", "J5", "doc_id echoes bad_length", f"SELECT doc_id, {ECHO_SQL} AS echoes, length(text) < 20 OR length(text) > 1200 AS bad_length FROM {PLANTED}")
def echo_and_length(t: Tables) -> DataFrame:
    c = F.col("text")
    return planted_documents(t).select("doc_id", textqc.echoes_injection(c).alias("echoes"), textqc.bad_length(c).alias("bad_length"))


@query(
    "text_verdicts", "J6", "rule texts share:6",
    f"""SELECT rule, count(*) AS texts, count(*) / (SELECT count(*) FROM documents) AS share FROM (SELECT CASE WHEN length(text) < 20 OR length(text) > 5000 THEN 'length_sanity' WHEN {ECHO_SQL} THEN 'injection_echo'
        ELSE coalesce({banned_sql('text')}, 'passed') END AS rule FROM {PLANTED}) GROUP BY rule""",
)
def text_verdicts(t: Tables) -> DataFrame:
    return textqc.rule_counts(planted_documents(t), textqc.first_failure(F.col("text"), high=5000))


@query(
    "grounded_verdicts", "J3 J6", "rule texts share:6",
    f"""SELECT rule, count(*) AS texts, count(*) / (SELECT count(*) FROM documents) AS share FROM (SELECT CASE WHEN length(text) < 1 OR length(text) > 1000000 THEN 'length_sanity' WHEN {ECHO_SQL} THEN 'injection_echo'
        WHEN {banned_sql('text')} IS NOT NULL THEN {banned_sql('text')} WHEN NOT grounded THEN 'ground_check' ELSE 'passed' END AS rule FROM {GROUND_SQL}) GROUP BY rule""",
)
def grounded_verdicts(t: Tables) -> DataFrame:
    return textqc.rule_counts(t.documents, textqc.first_failure(F.col("text"), document_facts(), low=1, high=1_000_000))


@query(
    "payload_hash", "J7", "doc_id hash shape",
    """SELECT doc_id, substr(sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'), 1, 32) AS hash, substr(sha256('lang|n_chars|source'), 1, 8) AS shape FROM documents""",
)
def payload_hash(t: Tables) -> DataFrame:
    names = ["source", "lang", "n_chars"]
    return t.documents.select("doc_id", textqc.payload_hash(names).alias("hash"), textqc.shape_hash(names).alias("shape"))
