"""Quality rules: one threshold table compiled into one Spark projection.

Every metric is a built-in column expression over one row, so the plan is a scan and projections: no shuffle, no
Python, nothing that depends on other rows. The verdict is the conjunction of the rows of THRESHOLDS.

Defined results: a null or blank text has no words and fails the base rule; repeated rows are judged each by itself;
an empty table gives an empty table; input columns that clash with an output name are left out of the query's result
and kept under their own name by `annotate` only if they do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and the characters that count as symbols.
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
WINDOW = 5

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from".split(),
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y los se las del un por con no una su para al es lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high, asked only of texts with at least min_words words."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    min_words: int = 0


THRESHOLDS = (
    Rule("length", "n_words", "one", 10, 1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 12),
    Rule("symbols_per_word", "n_symbols", "n_words", 0, 0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", 0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1, 60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0, 0.5),
)


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeated(words: str, marks: str, window: int) -> Column:
    """Words in windows that occur twice or more. `marks` holds a hash pair for every window start.

    Equal windows stand side by side after sorting; their start positions, again in order, cover
    min(window, distance to the next start) words each.
    """
    sort = F.sort_array(F.transform(F.col(marks), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        twin = F.filter(pairs, lambda p, k: ((k > 0) & (p["h"] == F.get(pairs, k - 1)["h"])) | (p["h"] == F.get(pairs, k + 1)["h"]))
        return F.sort_array(F.transform(twin, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    # let-bindings by one-element arrays keep each intermediate array from being computed more than once
    return F.get(F.transform(F.transform(F.array(sort), starts), covered), F.lit(0)).cast("long")


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words, _lines, _marks and the base counts to docs. One pass over each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_text", t).withColumn("_words", words_of(F.col("_text")))
    df = df.withColumns(
        {
            "_lines": F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
            "_marks": F.when(
                F.size("_words") >= WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - WINDOW),
                    lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    chars = F.char_length("_text")
    return df.withColumns(
        {
            "one": F.lit(1),
            "n_words": F.size("_words").cast("long"),
            "word_chars": _without(F.col("_text"), SPACES).cast("long"),
            "n_symbols": (chars - _without(F.col("_text"), SYMBOLS)).cast("long"),
            "n_shouts": (chars - _without(F.col("_text"), SHOUTS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_marks")) == F.size("_marks"), F.lit(0).cast("long")).otherwise(_repeated("_words", "_marks", WINDOW)),
        }
    )


def compiled(rules: tuple[Rule, ...] = THRESHOLDS) -> dict[str, Column]:
    """The threshold table as boolean columns, one per rule, true where the text passes. Ratios are compared without division."""
    out = {}
    for r in rules:
        n, d = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        out[r.name] = (F.col("n_words") < r.min_words) | ((n >= r.low * d) & (n <= r.high * d))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the base counts, base_failed, failed_rules (comma-joined names) and kept, a row for each row of docs."""
    m = metrics(docs.select(key, text), text)
    checks = compiled(rules)
    m = m.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.concat_ws(",", *[F.when(~ok, F.lit(k)) for k, ok in checks.items()]))
    m = m.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    return m.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "n_stop_words", "failed_rules")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs: the filter form, also without a shuffle."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(f"`{text}`").alias("_in"))
    m = metrics(packed, "_in")
    ok = ~base_failed()
    for check in compiled(rules).values():
        ok = ok & check
    # a generator, not a filter: a filter would be pushed below the projections and repeat their expressions many times
    return m.select(F.inline(F.filter(F.array("_row"), lambda _: ok)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs.select("doc_id", "text"))


def _sql_checks() -> str:
    return " AND ".join(f"(n_words < {r.min_words} OR ({r.numerator} >= {float(r.low)}::DOUBLE * {r.denominator} AND {r.numerator} <= {float(r.high)}::DOUBLE * {r.denominator}))" for r in THRESHOLDS)


def _sql_failed() -> str:
    return "concat_ws(','," + ",".join(f"CASE WHEN NOT (n_words < {r.min_words} OR ({r.numerator} >= {float(r.low)}::DOUBLE * {r.denominator} AND {r.numerator} <= {float(r.high)}::DOUBLE * {r.denominator})) THEN '{r.name}' END" for r in THRESHOLDS) + ")"


SQL_STOPS = ",".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
     win AS (SELECT doc_id, i, w[i:i+4] AS g FROM t, unnest(generate_series(1, len(w) - 4)) AS u(i)),
     rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
     cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2, 3, 4]) AS v(j) GROUP BY doc_id),
     m AS (SELECT t.doc_id, 1 AS one, len(w)::BIGINT AS n_words,
                  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                  (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_shouts,
                  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  len(list_filter(w, lambda x: lower(x) IN ({SQL_STOPS})))::BIGINT AS n_stop_words,
                  coalesce(cov.n, 0)::BIGINT AS n_repeat_words
           FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_checks()} AS kept, n_lines, n_shouts, n_stop_words, {_sql_failed()} AS failed_rules
FROM b
"""
