"""Quality rules for generated text, as column expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.session import spread

# Fixed values of the rules: word lists, patterns and limits.  BANNED holds (phrase, severity) in
# checking order.
BANNED = [
    ("definitely", "hard_block"), ("guaranteed", "hard_block"), ("guarantees", "hard_block"),
    ("proves", "hard_block"), ("100% accurate", "hard_block"), ("never fails", "hard_block"),
    ("always", "hard_block"),
    ("causes", "causal"), ("caused", "causal"), ("causing", "causal"), ("leads to", "causal"),
    ("drives", "causal"), ("driven by", "causal"), ("makes", "causal"), ("produces", "causal"),
    ("generates", "causal"), ("creates", "causal"), ("results in", "causal"),
    ("is responsible for", "causal"), ("accounts for", "causal"), ("explains", "causal"),
    ("is the reason", "causal"), ("triggers", "causal"), ("triggered by", "causal"),
    ("induces", "causal"), ("brings about", "causal"), ("gives rise to", "causal"),
    ("due to", "warn_only"), ("owing to", "warn_only"),
]
HEDGES = [
    "possibly", "may", "perhaps", "appears to", "appears", "seems", "is associated with",
    "associated with", "correlated with", "tends to", "suggests", "suggested", "likely", "probably",
]
INJECTIONS = [
    "<|", "|>", "system:", "assistant:", "user:", "ignore previous", "ignore above",
    "ignore the above", "disregard",
]
NUMBER = (
    r"(?U)(?<![\w.])-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?(?:%(?![\w])|(?![\w.]))"
)
TAG = r"</?[a-zA-Z][a-zA-Z0-9_:-]*\s*/?>"
ZERO_WIDTH = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]"
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MAX_CHARS, MIN_OUTPUT, MAX_OUTPUT, HEDGE_REACH = 200, 20, 1200, 80
TOLERANCE = 0.02
TRIVIAL = [float(n) for n in range(11)]


def _literal(marker: str) -> str:
    return "".join("\\" + ch if ch in "<|>:" else ch for ch in marker)


def sanitise(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Strip role markers, tags, invisible and control characters and backticks, collapse
    white space, clamp the length."""
    out = text
    for marker in INJECTIONS:
        out = F.regexp_replace(out, "(?i)" + _literal(marker), "")
    out = F.regexp_replace(out, TAG, "")
    out = F.regexp_replace(out, ZERO_WIDTH, "")
    out = F.regexp_replace(F.regexp_replace(out, "`", ""), "[\r\n]", " ")
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    out = F.regexp_replace(out, SPACES + "+", " ")
    return F.substring(F.trim(out), 1, max_chars)


def numbers(text: Column) -> Column:
    """Distinct numbers in a text, as doubles: thousands separators removed, percent / 100."""
    tokens = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))

    def value(t: Column) -> Column:
        plain = F.regexp_replace(t, "[,%]", "").try_cast("double")
        return F.when(t.endswith("%"), plain / 100.0).otherwise(plain)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens, value))))


def allowed_numbers(facts: Column) -> Column:
    """Facts, their complements to 1, and sums, differences, products and ratios of each two.
    ``facts`` is a short array of the numbers a text may use (one row's own statistics)."""
    pairs = F.flatten(
        F.transform(
            facts,
            lambda a, i: F.flatten(
                F.transform(
                    F.slice(facts, i + 2, F.size(facts)),
                    lambda b: F.array(a + b, a - b, b - a, a * b, F.try_divide(a, b), F.try_divide(b, a)),
                )
            ),
        )
    )
    return F.array_compact(F.concat(facts, F.transform(facts, lambda a: F.lit(1.0) - a), pairs))


def grounded(found: Column, allowed: Column) -> Column:
    """Every number is 0-10 or within 2 % of an allowed one."""
    trivial = F.array(*[F.lit(t) for t in TRIVIAL])

    def near(v: Column, target: Column) -> Column:
        return F.when(target == 0, v == 0).otherwise(F.abs(v - target) <= F.abs(target) * F.lit(TOLERANCE))

    return F.forall(
        found, lambda v: F.array_contains(trivial, v) | F.exists(allowed, lambda t: near(v, t))
    )


def banned_rule(text: Column, allow_causal: bool = False) -> Column:
    """Rule broken by the first offending phrase, or null."""
    return expr.let(F.lower(text), lambda low: _phrase_rule(low, allow_causal))


def _phrase_rule(low: Column, allow_causal: bool) -> Column:
    out = F.lit(None).cast("string")
    for phrase, severity in reversed(BANNED):
        has = F.contains(low, F.lit(phrase))
        if severity == "hard_block":
            out = F.when(has, "banned_phrase_hard").otherwise(out)
        elif severity == "causal":
            if not allow_causal:
                out = F.when(has, "causal_verb_filter").otherwise(out)
        else:
            at = F.instr(low, phrase)
            start = F.greatest(F.lit(1), at - HEDGE_REACH)
            around = F.substr(low, start, at + F.lit(len(phrase) + HEDGE_REACH) - start)
            hedged = F.lit(False)
            for h in HEDGES:
                hedged = hedged | F.contains(around, F.lit(h))
            out = F.when(has & ~hedged, "unhedged_correlation").otherwise(out)
    return out


def echoes_injection(text: Column) -> Column:
    """Whether a text repeats a prompt marker."""

    def any_marker(low: Column) -> Column:
        out = F.lit(False)
        for marker in INJECTIONS:
            out = out | F.contains(low, F.lit(marker))
        return out

    return expr.let(F.lower(text), any_marker)


def bad_length(text: Column, low: int = MIN_OUTPUT, high: int = MAX_OUTPUT) -> Column:
    return (F.length(text) < low) | (F.length(text) > high)


def first_failure(text: Column, facts: Column | None = None, allow_causal: bool = False, low: int = MIN_OUTPUT, high: int = MAX_OUTPUT) -> Column:
    """First failing rule in order length, injection, phrases, grounding; "passed" otherwise."""
    out = F.lit(None).cast("string")
    if facts is not None:
        out = F.when(~grounded(numbers(text), allowed_numbers(facts)), "ground_check")
    chain = F.coalesce(
        F.when(bad_length(text, low, high), "length_sanity"),
        F.when(echoes_injection(text), "injection_echo"),
        banned_rule(text, allow_causal),
        out,
        F.lit("passed"),
    )
    return chain


def rule_counts(df: DataFrame, verdict: Column) -> DataFrame:
    """Texts per verdict and the share of the corpus (aggregated map-side)."""
    counts = spread(df).groupBy(verdict.alias("rule")).agg(F.count("*").alias("texts"))
    total = counts.agg(F.sum("texts").alias("n"))
    return counts.join(F.broadcast(total)).select("rule", "texts", (F.col("texts") / F.col("n")).alias("share"))


def payload_hash(columns: list[str]) -> Column:
    """sha256 of the canonical JSON (sorted keys) of some columns, 32 hex digits."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 32)


def shape_hash(columns: list[str]) -> Column:
    """Hash of the sorted key names, 8 hex digits."""
    return F.substring(F.sha2(F.lit("|".join(sorted(columns))), 256), 1, 8)
