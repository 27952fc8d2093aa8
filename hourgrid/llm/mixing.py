"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import staged, table

LEVELS = ("domain", "lang_key", "source_key")
#: Hex digits of the sample key that make a bucket: 4096 buckets a leaf.
BUCKET_DIGITS = 3
DOMAINS = ("web", "books", "code", "news")
#: Integer weights by level and name; a name that is not listed has weight 1.
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 1}, "lang_key": {"en": 3}, "source_key": {}}


def domain_of(source: Column) -> Column:
    """The domain of a source in the given tables: from the last character of its name."""
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.ascii(F.right(source, F.lit(1))) % 4 + 1)


def token_count(text: Column) -> Column:
    """Words between the six ASCII white spaces; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def sample_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    pairs = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(1)) if pairs else F.lit(1)


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Deals each parent's `budget` among its children by `weight`, none above its `capacity`.

    Children in order of capacity / weight: as long as one's capacity is at most its share of what is left, it
    gets its capacity; the rest share what then remains. So a shortage goes to the siblings, and what all of
    them cannot take was never given to the parent, since the parent's capacity is the sum of theirs."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("capacity") / F.col("weight")), F.col("name"))
    wide = lambda c: c.cast("decimal(38,0)")
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("left", left).withColumn("rest", rest)
    full = wide(F.col("capacity")) * F.col("rest") <= wide(F.col("left")) * F.col("weight")
    rows = rows.withColumn("open", F.when(~full, F.struct("left", "rest")))
    rows = rows.withColumn("open", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    given = F.floor(wide(F.col("open.left")) * F.col("weight") / F.col("open.rest")).cast("bigint")
    share = F.when(F.col("open").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.greatest(given, F.lit(0))))
    return rows.withColumn("budget", share).drop("left", "rest", "open")


def leaf_budgets(leaves: DataFrame, weights: dict, max_epochs: int, fraction: float) -> DataFrame:
    """Budgets of the leaves (domain, lang_key, source_key, tokens): top down, `fraction` of all tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    whole = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(fraction)).cast("bigint").alias("budget"))
    parents, out = [], whole
    for level in LEVELS:
        path = [*parents, level]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights)).withColumn("name", F.col(level))
        nodes = nodes.join(out.select(*parents, "budget"), parents) if parents else nodes.join(F.broadcast(out), F.lit(True))
        out, parents = _share(nodes, parents).drop("name"), path
    return out.select(*LEVELS, "tokens", "budget")


def with_leaf(docs: DataFrame) -> DataFrame:
    """docs with the leaf each row is in; null source or lang: '' (and domain 'none' for an empty source)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "source_key": source,
            "lang_key": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "domain": F.when(source == "", F.lit("none")).otherwise(domain_of(source)),
        }
    )


def plan_mix(docs: DataFrame, weights: dict, fraction: float, max_epochs: int, seed: int) -> DataFrame:
    """For every leaf: budget, whole epochs, and the last sample key of the begun epoch's prefix ('' : none)."""
    narrow = staged(with_leaf(docs).select("doc_id", *LEVELS, token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, max_epochs, fraction)
    plan = budgets.withColumn("epochs", F.expr("budget div tokens").cast("int")).withColumn("rest", F.expr("budget % tokens"))
    plan = staged(plan)
    keyed = narrow.join(plan.where("rest > 0").select(*LEVELS, "epochs", "rest"), [*LEVELS]).withColumn("key", sample_key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    order = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("in_bucket")).withColumn("upto", F.sum("in_bucket").over(order))
    before = F.col("upto") - F.col("in_bucket")
    crossing = sums.where((before <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(*LEVELS, "bucket", (F.col("rest") - before).alias("room"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        keyed.join(crossing, [*LEVELS, "bucket"]).withColumn("used", F.sum("n_tokens").over(inside))
        .groupBy(*LEVELS, "bucket").agg(F.max(F.when(F.col("used") <= F.col("room"), F.col("key"))).alias("cut"))
        .select(*LEVELS, F.coalesce("cut", "bucket").alias("cut"))
    )
    return staged(plan.join(last, [*LEVELS], "left").select(*LEVELS, "tokens", "budget", "epochs", F.coalesce("cut", F.lit("")).alias("cut")))


def mix(docs: DataFrame, weights: dict | None = None, fraction: float = 0.8, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixture: docs' rows as struct `row`, with leaf, n_tokens, budget and epoch (from 0), each as often as its
    leaf's budget asks for.

    The budget is `fraction` of all tokens. It is dealt down the tree domain - language - source by integer
    weights; a node that cannot use its share within `max_epochs` passes the rest to its siblings, and only a
    whole family's shortage goes further up. A leaf gives its whole text rows once per whole epoch; of the last,
    begun epoch those with the least keys md5(seed:epoch:doc_id) whose tokens together are within the rest.
    Rows with equal ids have equal keys and are taken together or not at all. Rows without a word are not taken.
    Null source, lang or id count as ''. An empty table gives an empty mixture."""
    plan = plan_mix(docs, weights or WEIGHTS, fraction, max_epochs, seed)
    rows = docs.select("doc_id", "lang", "source", token_count(F.col("text")).alias("n_tokens"), F.struct("*").alias("row"))
    rows = with_leaf(rows).where("n_tokens > 0")
    rows = rows.join(plan.drop("tokens").where("budget > 0"), [*LEVELS])
    key = sample_key(seed, F.col("epochs"), F.col("doc_id"))
    times = F.col("epochs") + F.when((F.col("cut") != "") & (key <= F.col("cut")), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of all documents; null texts have no tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs)
    return mixed.select("row.doc_id", "domain", F.col("lang_key").alias("lang"), F.col("source_key").alias("source"), "n_tokens", "budget", "epoch")


def _share_sql(name: str, parents: list[str], level: str, above: str) -> str:
    """The SQL twin of _share for one level: a CTE `name`."""
    path = ", ".join([*parents, level])
    weights = "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    weight = f"CASE {level}{weights} ELSE 1 END" if weights else "1"
    part = f"PARTITION BY {', '.join(parents)} " if parents else ""
    using = f"JOIN {above} p USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above} p"
    return f"""
{name}_n AS (SELECT {path}, sum(tokens)::BIGINT * 3 AS capacity, sum(tokens)::BIGINT AS tokens, {weight} AS weight FROM leaves GROUP BY {path}),
{name}_a AS (
  SELECT n.*, p.budget AS above,
    p.budget - coalesce(sum(capacity) OVER ({part}ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(weight) OVER ({part}ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst
  FROM {name}_n n {using}),
{name}_b AS (
  SELECT *, first_value(CASE WHEN capacity::HUGEINT * rst > lft * weight THEN lft END IGNORE NULLS) OVER w AS olft,
    first_value(CASE WHEN capacity::HUGEINT * rst > lft * weight THEN rst END IGNORE NULLS) OVER w AS orst
  FROM {name}_a WINDOW w AS ({part}ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT {path}, tokens, CASE WHEN olft IS NULL THEN capacity ELSE least(capacity, greatest(olft::HUGEINT * weight // orst, 0)) END::BIGINT AS budget FROM {name}_b)"""


SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source_key, coalesce(lang, '') AS lang_key,
    CASE WHEN coalesce(source, '') = '' THEN 'none' ELSE (['web', 'books', 'code', 'news'])[(ascii(right(source, 1)) % 4) + 1] END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang_key, source_key, sum(n_tokens)::BIGINT AS tokens FROM docs WHERE n_tokens > 0 GROUP BY ALL),
whole AS (SELECT floor(sum(tokens) * 0.8)::BIGINT AS budget FROM leaves),
{_share_sql("l1", [], "domain", "whole")},
{_share_sql("l2", ["domain"], "lang_key", "l1")},
{_share_sql("l3", ["domain", "lang_key"], "source_key", "l2")},
keyed AS (
  SELECT d.*, budget, budget // tokens AS epochs, budget % tokens AS rest,
    md5('17:' || (budget // tokens)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM docs d JOIN l3 USING (domain, lang_key, source_key) WHERE n_tokens > 0 AND budget > 0),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang_key, source_key ORDER BY key) AS used FROM keyed),
times AS (SELECT *, epochs + CASE WHEN rest > 0 AND used <= rest THEN 1 ELSE 0 END AS times FROM cum)
SELECT doc_id, domain, lang_key AS lang, source_key AS source, n_tokens, budget, unnest(range(times))::INTEGER AS epoch
FROM times WHERE times > 0
"""


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture of what is left, nine tenths of the tokens, each document once at most."""
    return mix(docs, fraction=0.9, max_epochs=1).select("row.*")
