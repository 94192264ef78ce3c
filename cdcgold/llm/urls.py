"""URL filter: host rules first, then the ratio of two character language models.

URLs on which a rule decides are the examples of accepted and rejected ones.  For each of the two
classes a variable-order Markov model of characters is counted: orders 2, 1 and 0 and the uniform
one, mixed by Witten-Bell weights, so a context that was seen little leans on shorter ones.  All
runs of three characters of a fixed alphabet are tabled, so the table has a proven size.  The score
of a URL is the mean log-likelihood ratio of its characters; the threshold is the one that tells
held-out examples apart best, both classes weighing the same.

Rules see host and path; the models see the whole URL as it is given, scheme and query included.

Only DataFrame functions run here.  Defined cases: a null URL or one without "://" has an empty
host and path; a null URL is scored as the empty string; without examples of a class the threshold is 0;
equal and repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcgold.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code 0 is the start, 1 the end; digits count as 0 and all other characters as ~.
ALPHABET = LOWER + "0./-_%~"
CODES = len(ALPHABET) + 2
GRAMS = CODES**3
FOLDS = 5
BINS = 4000
BIN = 200.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """Codes of all runs of three characters, start and end included."""
    plain = F.regexp_replace(F.translate(F.translate(text, UPPER, LOWER), "123456789", "000000000"), r"(?s)[^a-z0./_%-]", "~")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)) + 1)
    codes = F.concat(F.array(F.lit(0), F.lit(0)), codes, F.array(F.lit(1)))
    n = F.size(codes)
    return F.zip_with(
        F.zip_with(F.slice(codes, F.lit(1), n - 2), F.slice(codes, F.lit(2), n - 2), lambda a, b: a * CODES + b),
        F.slice(codes, F.lit(3), n - 2),
        lambda ab, c: ab * CODES + c,
    )


def _exploded(rows: DataFrame, text: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("gram", F.explode(grams(F.concat(*text))))


def model(examples: DataFrame, text: tuple[str, ...] = ("host", "path")) -> DataFrame:
    """(gram, ratio): log-likelihood of accepted less that of rejected, for all runs of three in the columns `text`."""
    counts = (
        _exploded(examples, text)
        .groupBy("gram")
        .agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(k) for k, v in (("allow", "allow"), ("block", "block"))])
    )
    spark = examples.sparkSession
    cells = spark.range(GRAMS, numPartitions=1).select(F.col("id").cast("int").alias("gram"))
    cells = cells.join(counts, "gram", "left").fillna(0)
    cells = cells.withColumn("ab", F.floor(F.col("gram") / CODES).cast("int")).withColumn("c", F.col("gram") % CODES)
    cells = cells.withColumn("b", F.col("ab") % CODES)
    cells = materialise(cells, "url-counts")
    ratio = F.lit(0.0)
    for k, sign in (("allow", 1.0), ("block", -1.0)):
        bc = cells.groupBy("b", "c").agg(F.sum(k).alias("n_bc"))
        c = bc.groupBy("c").agg(F.sum("n_bc").alias("n_c"))
        all_ = c.agg(F.sum("n_c").alias("n"), F.count(F.when(F.col("n_c") > 0, 1)).alias("t")).first()
        n, t = all_["n"] or 0, max(all_["t"], 1)
        p0 = (F.col("n_c") + t / CODES) / F.lit(float(n + t))
        b = bc.groupBy("b").agg(F.sum("n_bc").alias("n_b"), F.count(F.when(F.col("n_bc") > 0, 1)).alias("t_b"))
        p1 = F.when(F.col("n_b") == 0, F.col("p0")).otherwise(
            (F.col("n_bc") + F.col("t_b") * F.col("p0")) / (F.col("n_b") + F.col("t_b"))
        )
        short = bc.join(c.select("c", p0.alias("p0")), "c").join(b, "b").select("b", "c", p1.alias("p1"))
        ab = cells.groupBy("ab").agg(F.sum(k).alias("n_ab"), F.count(F.when(F.col(k) > 0, 1)).alias("t_ab"))
        p2 = F.when(F.col("n_ab") == 0, F.col("p1")).otherwise(
            (F.col(k) + F.col("t_ab") * F.col("p1")) / (F.col("n_ab") + F.col("t_ab"))
        )
        cells = cells.join(short, ["b", "c"]).join(ab, "ab")
        cells = cells.withColumn(f"log_{k}", F.ln(p2)).drop("p1", "n_ab", "t_ab")
        ratio = ratio + F.lit(sign) * F.col(f"log_{k}")
    return materialise(cells.select("gram", ratio.alias("ratio")), "url-model")


def _scored(rows: DataFrame, ratios: DataFrame, key: str, text: tuple[str, ...] = ("host", "path")) -> DataFrame:
    """(key, score); a row's runs are averaged before they leave its task."""
    # the table has CODES ** 3 rows whatever the data
    known = _exploded(rows.select(F.col(key).alias("_key"), *text), text).join(F.broadcast(ratios), "gram")
    return known.groupBy(F.col("_key").alias(key)).agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that tells allow from block best, from a table of at most BINS + 1 bins."""
    at = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(F.col("score") * BIN))).cast("int")
    bins = scored.groupBy(at.alias("bin")).agg(
        *[F.count(F.when(F.col("verdict") == v, 1)).cast("double").alias(v) for v in ("allow", "block")]
    )
    total = bins.agg(F.sum("allow"), F.sum("block")).first()
    if not total[0] or not total[1]:
        return 0.0
    below = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum("block").over(below), F.lit(0.0)) / total[1] - F.coalesce(
        F.sum("allow").over(below), F.lit(0.0)
    ) / total[0]
    best = bins.select("bin", gain.alias("gain")).orderBy(F.desc("gain"), F.abs("bin"), "bin").first()
    return best["bin"] / BIN


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    host, path = host_and_path(F.col(url))
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), whole.alias("_url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("verdict"), F.monotonically_increasing_id().alias("_row"))
    rows = materialise(rows, "url-rows")
    # all that differs only in its query is held out together
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS))
    known = rows.filter("verdict is not null")
    ratios = model(known.filter(fold > 0), ("_url",))
    scores = materialise(_scored(rows, ratios, "_row", ("_url",)), "url-scores")
    scored = rows.join(scores, "_row")
    limit = threshold(scored.filter("verdict is not null").filter(fold == 0))
    said = F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", said.alias("verdict"), "score")
