"""URL filtering: fixed host-and-path rules, then mined association rules.

Labelled URLs become sets of tokens (host suffixes, path words, file ending,
query keys) with a class item. Tokens that are in exactly the same labelled URLs
are one item, by the longest of them, so that a chain of host suffixes or a bundle
of query keys doesn't multiply the combinations. Spark's FP-growth mines the
frequent combinations; those whose share of bad URLs reaches the confidence and
lift bounds, and no part of which is such a rule itself, are kept. The inverted
index lists each rule under its rarest token; a URL with that token meets the rule
if it holds the others too. Only DataFrame operations run.

Defined results: a null URL, or one without ://, has an empty host and path, no
tokens, no rule, and is allowed. Among fixed rules the longest (host and path)
wins, among mined ones the most confident, then the last by name. Without labels,
nothing is mined; if an id is labelled more than once, the worst label holds. A
row is judged on its own, so repeated rows get the same verdict each.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import joined, stored

#: Fixed rules: (verdict, host and path).
FIXED = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SUPPORT = 0.005
#: Rows that hold a frequent combination at least, however few are labelled.
LEAST_ROWS = 5
#: A rule's share of bad rows at least, and how many times the share of all rows that must be.
CONFIDENCE, LIFT = 0.6, 2.0
#: Tokens of a rule at most.
LONGEST = 3
#: Tokens of a URL up to which it is mined as one transaction; beyond, tokens of a URL for each block.
WIDE, BLOCK_TOKENS = 12, 3
BAD = "class=bad"


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    d = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(rest, F.lit("")).alias("rest"))
    d = d.withColumn("host", lower(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)))
    return d.withColumn("path", F.regexp_extract("rest", r"(?s)^[^/?#]*(/[^?#]*)?", 1)).drop("rest")


def fixed(rules: list[tuple[str, str]] = FIXED) -> tuple[Column, Column]:
    """Rule and verdict columns over host and path: the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of host, path and url: host suffixes, path words without numbers, file ending, query keys."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(lower(F.col("path")), "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path="), w))
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.transform(F.regexp_extract_all("url", F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda k: F.concat(F.lit("query="), k))
    last = F.when(ending != "", F.array(F.concat(F.lit("ending="), lower(ending)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(suffixes, words, last, keys))))


def parts_of(tokens: str, longest: int) -> Column:
    """All proper, non-empty parts of a short sorted array, as arrays."""
    def part(places: tuple[int, ...]) -> Column:
        return F.filter(tokens, lambda _, i: i.isin(*places))

    chosen = [part(places) for size in range(1, longest) for places in combinations(range(longest), size)]
    return F.filter(F.array_distinct(F.array(*chosen)), lambda p: (F.size(p) > 0) & (F.size(p) < F.size(tokens)))


def rule_name(tokens: str | Column) -> Column:
    return F.concat_ws(" & ", tokens)


def frequent_sets(urls: DataFrame, items: DataFrame, least: int, longest: int) -> DataFrame:
    """(items, freq): the sets of at most `longest` tokens, with or without BAD, that at least `least` of urls(row, bad, items) have.

    FP-growth has no bound on a set's length, and k tokens that often go together have
    2^k frequent sets. So frequent tokens are dealt into blocks in order of their counts,
    which spreads those that go together, few of a URL's tokens to a block. A URL is a
    transaction for each choice of up to `longest` of its blocks, with the tokens of those
    blocks marked by the choice; a set is counted where the choice is exactly the blocks of
    its tokens, so each counts every URL that has it, once. If no URL has more tokens than
    WIDE there is one block.
    """
    most = urls.agg(F.max(F.size("items"))).first()[0] or 0
    blocks = 1 if most <= WIDE else -(-most // BLOCK_TOKENS)
    ordered = stored(items.orderBy(F.desc("n"), "token").withColumn("at", F.monotonically_increasing_id()), "token-order")  # numbers go up by one within a sorted range
    placed = joined(urls.select("row", F.explode("items").alias("token")), ordered.select("token", F.pmod("at", F.lit(blocks)).cast("int").alias("block")), "token")
    own = placed.groupBy("row").agg(F.collect_list(F.struct("block", "token")).alias("own"))  # of one url
    d = urls.select("row", "bad").join(own, "row")
    singles = F.transform(F.array_sort(F.array_distinct(F.transform("own", lambda x: x["block"]))), lambda b: F.array(b))
    every = sizes = singles
    for _ in range(longest - 1):
        sizes = F.flatten(F.transform(sizes, lambda c: F.transform(F.filter(singles, lambda b: b[0] > F.element_at(c, -1)), lambda b: F.concat(c, b))))
        every = F.concat(every, sizes)
    d = d.select("bad", "own", F.explode(every).alias("choice")).withColumn("tag", F.array_join(F.transform("choice", lambda b: b.cast("string")), "-"))
    marked = lambda block, token: F.concat_ws("|", "tag", block, token)
    tokens_ = F.transform(F.filter("own", lambda x: F.array_contains(F.col("choice"), x["block"])), lambda x: marked(x["block"].cast("string"), x["token"]))
    moves = stored(d.select(F.concat(tokens_, F.when(F.col("bad"), F.array(marked(F.lit(""), F.lit(BAD)))).otherwise(F.array().cast("array<string>"))).alias("items")), "url-choices")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(moves.count(), least))).fit(moves).freqItemsets.where(F.size("items") <= longest + 1)
    parts = F.transform("items", lambda x: F.split(x, r"\|", 3))
    sets = sets.select(F.transform(parts, lambda x: x[2]).alias("items"), "freq", F.size(F.split(parts[0][0], "-")).alias("chosen"), F.array_distinct(F.filter(F.transform(parts, lambda x: x[1]), lambda b: b != "")).alias("used"))
    within = F.size(F.array_remove("items", BAD)) <= longest
    return sets.where((F.size("used") == F.col("chosen")) & within).select("items", "freq")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, longest: int = LONGEST) -> DataFrame:
    """(rule_id, tokens, confidence, n, lead) from labelled(host, path, url, bad boolean); lead: the rule's rarest token."""
    urls = stored(labelled.select(F.monotonically_increasing_id().alias("row"), tokens().alias("tokens"), "bad").where(F.size("tokens") > 0), "url-tokens")
    total, bad = urls.agg(F.count("*"), F.count_if("bad")).first()
    least = max(ceil(support * total), LEAST_ROWS)
    seen = urls.select("row", F.explode("tokens").alias("token"))
    counted = seen.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("rows")).where(F.col("n") >= least)
    items = stored(counted.groupBy("n", "rows").agg(F.max(F.struct(F.length("token"), "token"))["token"].alias("token")).select("token", "n"), "url-items")
    held = joined(seen, items.select("token"), "token", "left_semi").groupBy("row").agg(F.collect_list("token").alias("items"))  # of one url
    held = stored(urls.select("row", "bad").join(held, "row").select("row", "bad", "items"), "url-sets")
    sets = stored(frequent_sets(held, items, least, longest), "itemsets")
    plain = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    with_bad = sets.where(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_bad"))
    bound = max(confidence, lift * bad / max(total, 1))
    rules = plain.where(F.size("tokens") <= longest).join(with_bad, "tokens").withColumn("confidence", F.col("n_bad") / F.col("n")).where((F.col("confidence") >= bound) & (F.size("tokens") > 0))
    rules = stored(rules.select(rule_name("tokens").alias("rule_id"), "tokens", "confidence", "n"), "rules")
    parts = rules.select("rule_id", F.explode(parts_of("tokens", longest)).alias("part")).select("rule_id", rule_name("part").alias("part"))
    redundant = parts.join(rules.select(F.col("rule_id").alias("part")), "part").select("rule_id").distinct()
    rules = rules.join(redundant, "rule_id", "left_anti")
    lead = rules.select("rule_id", F.explode("tokens").alias("token")).join(items.withColumnRenamed("n", "uses"), "token").groupBy("rule_id").agg(F.min(F.struct("uses", "token"))["token"].alias("lead"))
    return rules.join(lead, "rule_id")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the best mined rule that the url meets, or null)."""
    index = rules.select(F.col("lead").alias("token"), "rule_id", "tokens", "confidence")
    urls = parsed(pages, page_id, url)
    # each distinct url is matched once
    held = urls.where("host != ''").select("url", "host", "path").distinct().select("url", tokens().alias("own"))
    met = joined(held.select("url", "own", F.explode("own").alias("token")), index, "token").where(F.size(F.array_except("tokens", "own")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "rule_id"))["rule_id"].alias("mined"))
    rule, verdict = fixed()
    found = urls.join(best, "url", "left")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def report(pages: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Every page judged; rules mined from the pages whose id has a label (bad: quality 0 or toxic 1)."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    learned = parsed(pages).where("host != ''").join(known, F.col("page_id") == F.col("doc_id")).select("url", "host", "path", "bad")
    return judge(pages, mine(learned, **settings))
