"""URL filters: longest-rule lists, and host word segmentation scored by naive Bayes where no rule fits.

1. Rules (host suffix and path prefix) are matched by built-in functions; the longest fitting rule decides.
2. Word counts are taken over the text of all pages, the marked-off words of hosts, and the words of paths.
3. Viterbi splits every run of letters of a host into the words of least total cost under those counts. The substrings of
   the distinct runs meet the word table in an equality join, so the table may be of any size.
4. Multinomial naive Bayes learns from the distinct urls that a rule labels: every segmented host word and every path
   word counts, in two name spaces, the words of the rules among them. The scores of a host and of a path are sums over
   their tokens, taken once for each distinct host and path. Classes have equal priors; words that no labelled url has
   say nothing. The verdict is block where the log odds reach `margin`, else allow. Seed words are a parameter, empty by
   default.

Word counts, token counts and weights are tables of all words; only their totals reach the driver. Sums are taken over
whole billionths, so they don't depend on the order of rows.

Defined results: a null url or one without `://` has empty host and path, fits no rule and has log odds zero, so it is
allowed; ties of two splits go to the longer last word, ties of rules can't be; very long urls count whole, but a run of
over LABEL letters, which no host can hold, stays one word; repeated rows are judged alike and teach once; without
labelled urls all odds are zero; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import saved

#: (rule, verdict): the rule's host, then its path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MARGIN = 2.0
LABEL = 63  # letters of a host label at most
UNIT, SALTS = 1_000_000_000, 16


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no `://`."""
    pattern = "://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule, or null."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        tests.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))


def runs_of(text: Column, pattern: str = r"(\p{L}+|\p{Nd}+)") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def folded(run: Column) -> Column:
    """Numbers are one token."""
    return F.when(run.rlike(r"^\p{Nd}"), F.lit("0")).otherwise(run)


def lexicon(urls: DataFrame, html: str | None = None, seeds: tuple[tuple[str, str, int], ...] = ()) -> DataFrame:
    """w, n: counts of the words of page texts, of the words between marks in distinct hosts, of paths, and of the seeds."""
    letters = r"(\p{L}+)"
    # whole labels without a mark are names to split, not words
    hosts = urls.select("host").distinct().select(F.explode(F.filter(F.split("host", r"\."), lambda x: x.contains("-"))).alias("t"))
    given = [hosts, urls.select(F.lower("path").alias("t"))]
    if html:
        given.append(urls.select(F.lower(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1|<[^>]*>", " ")).alias("t")))
    words = [g.select(F.explode(runs_of(F.col("t"), letters)).alias("w")).groupBy("w").agg(F.count("*").alias("n")) for g in given]
    if seeds:
        words.append(urls.sparkSession.createDataFrame([(w, n) for w, _, n in seeds], "w string, n long"))
    out = words[0]
    for more in words[1:]:
        out = out.unionByName(more)
    return out.where(F.char_length("w") <= LABEL).groupBy("w").agg(F.sum("n").alias("n"))


def cheapest(name: str, hits: list[tuple[int, int, int]], total: int) -> list[str]:
    """The words of least total cost that spell name; ties go to the longer last word. hits: (start, length, count) of known words.

    A known word costs log(total / count). An unknown run of any length costs log(total) and log(26) for each letter,
    what a word of that length would by chance; the cheapest start of one is a running minimum.
    """
    ending: list[list[tuple[int, int]]] = [[] for _ in range(len(name) + 1)]
    for at, size, n in hits:
        ending[at + size].append((at, n))
    whole, letter = math.log(total), math.log(26)
    best, back = [0.0], [0]
    run, run_at = 0.0, 0  # least best[start] - letters before start
    for end in range(1, len(name) + 1):
        low, at = run + whole + letter * end, run_at
        for start, n in ending[end]:
            cost = best[start] + math.log(total / n)
            if (cost, start) < (low, at):
                low, at = cost, start
        best.append(low)
        back.append(at)
        if low - letter * end < run:
            run, run_at = low - letter * end, end
    out, n = [], len(name)
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run, words: the split of each distinct run of letters."""
    total = int(words.agg(F.sum("n")).first()[0] or 0) + 1
    n = F.char_length("run")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct((i - 1).alias("at"), F.substring(F.col("run"), i, j - i + 1).alias("w")))))
    short = runs.where(n <= LABEL)
    hits = short.select("run", F.explode(parts).alias("x")).select("run", "x.at", "x.w").join(words, "w")
    hits = hits.groupBy("run").agg(F.collect_list(F.struct("at", F.char_length("w").alias("size"), "n")).alias("hits"))  # LABEL * (LABEL + 1) / 2 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            out = [cheapest(name, [(h["at"], h["size"], h["n"]) for h in found or ()], total) for name, found in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    split = short.join(hits, "run", "left").select("run", "hits").mapInArrow(run, "run string, words array<string>")
    return split.unionByName(runs.where(n > LABEL).select("run", F.array("run").alias("words")))


def host_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """host, token, n: the segmented words of each distinct host."""
    runs = urls.select("host").distinct().select("host", F.explode(runs_of(F.col("host"))).alias("run"))
    letters = runs.where(~F.col("run").rlike(r"^\p{Nd}"))
    split = letters.join(segmented(letters.select("run").distinct(), words), "run").select("host", F.explode("words").alias("w"))
    every = split.unionByName(runs.where(F.col("run").rlike(r"^\p{Nd}")).select("host", folded(F.col("run")).alias("w")))
    return every.groupBy("host", F.concat(F.lit("h:"), "w").alias("token")).agg(F.count("*").alias("n"))


def path_tokens(paths: DataFrame, *keep: str) -> DataFrame:
    """keep, token: a row for each word of each path."""
    return paths.select(*keep, F.explode(runs_of(F.lower("path"))).alias("run")).select(*keep, F.concat(F.lit("p:"), folded(F.col("run"))).alias("token"))


def train(urls: DataFrame, hosts: DataFrame, seeds: tuple[tuple[str, str, int], ...] = ()) -> DataFrame:
    """token, weight: log odds of block in billionths, of the distinct labelled rows of urls (host, path, label)."""
    seen = urls.where("label IS NOT NULL").select("host", "path", "label").distinct()
    by_host = seen.groupBy("label", "host").agg(F.count("*").alias("urls")).join(hosts, "host").groupBy("label", "token").agg(F.sum(F.col("n") * F.col("urls")).alias("n"))
    counts = by_host.unionByName(path_tokens(seen, "label").groupBy("label", "token").agg(F.count("*").alias("n")))
    if seeds:
        rows = [(label, space + w, n) for w, label, n in seeds for space in ("h:", "p:")]
        counts = counts.unionByName(urls.sparkSession.createDataFrame(rows, "label string, token string, n long"))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    table = saved(counts.groupBy("token").agg(of("allow").alias("a"), of("block").alias("b")))
    a, b, kinds = table.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    odds = F.log((F.col("b") + 1) / ((b or 0) + kinds + 1)) - F.log((F.col("a") + 1) / ((a or 0) + kinds + 1))
    return table.select("token", F.round(odds * UNIT).cast("long").alias("weight"))


def scored(urls: DataFrame, hosts: DataFrame, weights: DataFrame) -> DataFrame:
    """urls (host, path, ..) with log_odds."""
    of_host = hosts.join(weights, "token").groupBy("host").agg(F.sum(F.col("n") * F.col("weight")).alias("_h"))
    of_path = path_tokens(urls.select("path").distinct(), "path").join(weights, "token").groupBy("path").agg(F.sum("weight").alias("_p"))
    zero = F.lit(0).cast("long")
    # a host may have a third of all rows: it is dealt over SALTS parts, and its one score stands in each
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    of_host = of_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    both = urls.withColumn("_salt", salt).join(of_host, ["host", "_salt"], "left").join(of_path, "path", "left")
    return both.select(*urls.columns, ((F.coalesce("_h", zero) + F.coalesce("_p", zero)) / UNIT).alias("log_odds"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str | None = None, rules: tuple[tuple[str, str], ...] = RULES, margin: float = MARGIN, seeds: tuple[tuple[str, str, int], ...] = ()) -> DataFrame:
    """key, host, path, rule, verdict, log_odds: a row for each row of pages. log_odds is null where a rule decides.

    html: a column with the pages, whose words help to split hosts. seeds: (word, allow or block, how often it counts).
    """
    host, path = parts(F.col(url))
    found = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), *([F.col(html).alias("html")] if html else []))
    found = found.withColumn("rule", matched(F.col("host"), F.col("path"), rules)).withColumn("label", verdict_of(F.col("rule"), rules))
    hosts = saved(host_tokens(found, saved(lexicon(found, "html" if html else None, seeds))))
    urls = found.select("key", "host", "path", "rule", "label")
    weights = train(urls, hosts, seeds)
    by_rule = urls.where("label IS NOT NULL").withColumn("log_odds", F.lit(None).cast("double"))
    out = by_rule.unionByName(scored(urls.where("label IS NULL"), hosts, weights))
    verdict = F.coalesce("label", F.when(F.col("log_odds") >= margin, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "log_odds")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), html="html")
