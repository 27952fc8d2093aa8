"""Verdicts on URLs: rules by host and path, and boosted trees on lexical features where no rule fits."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import guarded, staged, table

# The rules of the registered query, verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: About so many different labelled URLs are fitted on, None: all; least labelled ones of a suffix that has statistics of its own.
SAMPLE: int | None = None
LEAST = 8
#: Trees, their depth, the share of each one's correction, and the weight of the mean in a suffix's statistics.
TREES, DEPTH, STEP, PRIOR = 20, 4, 0.3, 10.0
#: Characters whose counts make the entropy; all others count as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
FEATURES = ("url_length", "host_length", "path_length", "query_length", "longest_segment", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "has_fragment", "has_extension", "is_https", "suffix_rate", "suffix_count", "domain_rate", "domain_count")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z in lower case. path: then up to ?, # or the end. Both
    are empty for null and for texts without ://."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)\A[^/?#]*", 0)
    after = F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(after, r"(?s)\A[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of rules of one length the one with the
    longer host wins, and of a rule that is there with both verdicts the block. Rules are a list on the driver, held
    in the plan by host, so a URL looks only at those of its host and the domains above it."""
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule[1], []).append(rule)
    if not by_host:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = lambda v, h, p: F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v).alias("verdict"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"))
    known = F.create_map(*[x for h, of in sorted(by_host.items()) for x in (F.lit(h), F.array(*[fits(*r) for r in of]))])
    labels, most = F.split(host, r"\."), max(h.count(".") + 1 for h in by_host)
    domains = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    there = F.flatten(F.array_compact(F.transform(domains, lambda d: F.element_at(known, d))))
    best = F.array_max(F.filter(there, lambda r: F.startswith(path, r["path"])))
    return best["rule"], best["verdict"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.length(whole) > 0, part / F.length(whole)).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Bits a character, from counts of ALPHABET and of all other characters together."""
    size = F.length(text)
    counts = [size - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in ALPHABET]
    counts.append(size - sum(counts[1:], counts[0]))
    bits = [F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0)) for n in counts]
    return F.when(size > 0, F.log2(size.cast("double")) - sum(bits[1:], bits[0]) / size).otherwise(F.lit(0.0))


def lexical(rows: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """rows with all FEATURES but the statistics of suffixes, and the suffixes: the last label and the last two."""
    text, lower = F.coalesce(F.col(url), F.lit("")), F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    labels = F.split(F.col(host), r"\.")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return rows.withColumns(
        {
            "url_length": F.length(text), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
            "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)), "depth": F.size(segments), "labels": F.size(labels), "hyphens": count(text, "-"),
            "digit_ratio": _share(digits(text), text), "host_digit_ratio": _share(digits(F.col(host)), F.col(host)), "entropy": entropy(lower),
            "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0), "has_fragment": F.contains(text, F.lit("#")).cast("int"),
            "has_extension": F.rlike(F.col(path), F.lit(r"\.[A-Za-z0-9]+$")).cast("int"), "is_https": F.startswith(lower, F.lit("https:")).cast("int"),
            "_suffix": F.element_at(labels, -1), "_domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


@dataclass
class Filter:
    """statistics: a table of suffixes (s), their share of blocked URLs (rate) and labelled URLs (n), empty: of none;
    mean: of a suffix without; only: the verdict where there is no model, as the labels are of one kind."""

    statistics: DataFrame | dict
    mean: float
    model: GBTClassificationModel | None
    only: str

    def with_statistics(self, rows: DataFrame) -> DataFrame:
        """The statistics of a suffix that has none are the mean and a count of 0. Spark broadcasts a small table of
        them; beside a large one it splits the rows of frequent suffixes (adaptive skew join)."""
        for key, rate, count in (("_suffix", "suffix_rate", "suffix_count"), ("_domain", "domain_rate", "domain_count")):
            if isinstance(self.statistics, DataFrame):
                rows = rows.join(self.statistics.select(F.col("s").alias(key), F.col("rate").alias(rate), F.log1p("n").alias(count)), key, "left")
                rows = rows.withColumns({rate: F.coalesce(rate, F.lit(self.mean)), count: F.coalesce(count, F.lit(0.0))})
            else:
                rows = rows.withColumns({rate: F.lit(self.mean), count: F.lit(0.0)})
        return rows

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """rows (with FEATURES but statistics) with method_verdict and score, the probability of a block."""
        rows = self.with_statistics(rows)
        if self.model is None:
            return rows.withColumns({"method_verdict": F.lit(self.only), "score": F.lit(1.0 if self.only == "block" else 0.0)})
        scored = self.model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows))
        return scored.withColumns({"score": vector_to_array("probability")[1], "method_verdict": F.when(F.col("prediction") == 1, "block").otherwise("allow")})


def fit(urls: DataFrame, rules: Sequence[Rule] = RULES) -> Filter:
    """Fits on all different URLs (column `url`) that a rule labels; where SAMPLE is set, on about so many, chosen by
    their hash.

    One half of them gives the statistics of suffixes, so that the trees, which are grown on the other half, see them
    as they will be for other URLs. Suffixes with fewer than LEAST labelled URLs have none. Statistics stay a table.
    Labels of one verdict make that the answer to all; without labels it is allow."""
    host, path = host_and_path(F.col("url"))
    rows = urls.where("url IS NOT NULL").select("url", host.alias("_host"), path.alias("_path"))
    _, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumn("_label", F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0)).where("_label IS NOT NULL")
    taken = rows
    if SAMPLE is not None:
        different = rows.agg(F.approx_count_distinct("url")).first()[0]
        chance = F.pmod(F.xxhash64(F.lit("sample"), "url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        taken = rows.where(chance < SAMPLE / max(different, 1))
    taken = taken.dropDuplicates(["url"])
    taken = staged(lexical(taken, "url", "_host", "_path").withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))))
    mean, blocked, allowed = taken.agg(F.avg("_label"), F.max("_label"), F.min("_label")).first()
    if blocked == allowed:  # or both null
        first = mean if mean is not None else rows.agg(F.avg("_label")).first()[0] or 0.0
        return Filter({}, first, None, "block" if first >= 0.5 else "allow")
    suffixes = taken.where("_half = 0").select("_label", F.explode(F.array_distinct(F.array("_suffix", "_domain"))).alias("s"))
    counts = suffixes.groupBy("s").agg(F.sum("_label").alias("blocked"), F.count("*").cast("double").alias("n")).where(F.col("n") >= LEAST)
    rate = (F.col("blocked") + F.lit(PRIOR * mean)) / (F.col("n") + F.lit(PRIOR))
    found = Filter(staged(counts.select("s", rate.alias("rate"), "n")), mean, None, "allow")
    grown = found.with_statistics(taken.where("_half = 1"))
    if grown.select("_label").distinct().count() < 2:
        grown = found.with_statistics(taken)
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1)
    found.model = trees.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(grown).select("_features", "_label"))
    return found


def judge(pages: DataFrame, found: Filter, rules: Sequence[Rule] = RULES) -> DataFrame:
    """pages (with `url`) and, in the place of columns of these names, host, path, rule, verdict and score.

    The verdict is the longest fitting rule's, else the trees'. A null or empty URL, or one without ://, has an empty
    host and path and goes to the trees like any other. Rows are neither dropped nor merged; other columns stay. score
    is the trees' probability of a block, for rows with a rule too."""
    own = ["host", "path", "rule", "verdict", "score"]
    rows, back = guarded(pages.drop(*own), ["url"])
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"_host": host, "_path": path})
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = found.verdicts(lexical(rows.withColumns({"_rule": rule, "_verdict": verdict}), "url", "_host", "_path"))
    final = F.coalesce("_verdict", "method_verdict").alias("verdict")
    return rows.select(*back, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), final, "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL: the rules' where one fits, else that of trees fitted on URLs that the rules label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")
