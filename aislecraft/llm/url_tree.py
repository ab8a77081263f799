"""URL filtering by path-template trees, in DataFrame operations only.

Rules decide the urls that they fit. For the others each host has a tree of path
templates: a segment that looks like an identifier is a wildcard, a level with
nearly as many segments as urls becomes one, and sibling branches whose labelled
shares differ by no more than chance are merged into one; branches without a
label are merged with none of them. The urls that the rules decide are the
labels; a template is rejected when it has labels enough itself and its share of
blocked urls, smoothed towards its parent's and so towards the host's, is high
enough. Sums over hosts, levels and branches are formed in every task first and
joined back under salts, so that a host with a third of all templates is many tasks.

Cases: a null url or one without `://` has an empty host and path and is allowed
(no rule fits it); an empty segment is a segment; levels below DEPTH are one
wildcard; equal urls count each; without labels everything is allowed; an empty
table gives no rows; columns other than page_id and url play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, small_enough, stored

#: verdict, host and path of the rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments of a template; what is deeper is one wildcard.
DEPTH = 4
#: A level is a wildcard when it has so many segments at least, and so many for each url.
LEAST_SEGMENTS, SPREAD = 8, 0.3
#: Sibling branches within so many standard errors of what they have in common are merged.
ALIKE = 1.96
#: Weight of the parent's share, and the smoothed share from which a template is rejected.
WEIGHT, REJECT = 2.0, 0.8
#: Labelled urls that a template has at least when it is rejected; a parent's or host's don't count.
LEAST_LABELS = 3
#: Tasks that may share the rows of one host, level or branch.
SALTS = 256
#: Bytes of rejected templates up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path without the leading dot and as verdict; null if there is none."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda rest, kv: F.when(kv[0], F.lit(kv[1])).otherwise(rest), reversed(list(zip(fits, values))), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule and the segments of the path, identifiers as wildcards."""
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.split(F.regexp_replace("path", r"^/", ""), "/")
    general = F.transform(parts, lambda s: F.when(s.rlike(r"[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))
    shape = F.when(F.size(general) > DEPTH, F.concat(F.slice(general, 1, DEPTH), F.array(F.lit("**")))).otherwise(general)
    return split.select("*", rule.alias("rule"), by_rule.alias("by_rule"), F.array_join(shape, "/").alias("shape"))


def beside(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """`rows` with sums over `keys`. The sums are formed in every task before the shuffle; rows of one key meet theirs in up to SALTS tasks."""
    return rows.join(spread(rows.groupBy(*keys).agg(*sums, F.collect_set("salt").alias("salts"))), [*keys, "salt"])


def spread(sums: DataFrame) -> DataFrame:
    """One copy of each row for every salt that its group has; there are never more copies than rows of the group."""
    return sums.withColumn("salt", F.explode("salts")).drop("salts")


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def templates(urls: DataFrame) -> DataFrame:
    """host, shape, template, labels, purity: the tree of every host, from counts of (host, shape).

    The tree grows level by level from sums over branches; no window or task holds a
    host, a level or a branch. Each level is written to the shared folder.
    """
    counts = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good")
    )
    start = {"parts": F.split("shape", "/"), "template": F.lit(""), "salt": salt_of("shape"), "parent": F.lit(0.5), "share": F.lit(0.5), "t_bad": F.lit(0).cast("long"), "t_good": F.lit(0).cast("long")}
    tree = stored(counts.withColumns(start), "url_tree")
    for level in range(1, DEPTH + 2):
        grown = stored(grown_by_a_level(tree, level), "url_tree")
        discard(tree)
        tree = grown
    return tree.select("host", "shape", "template", (F.col("t_bad") + F.col("t_good")).alias("labels"), smoothed(F.col("t_bad"), F.col("t_good"), F.col("parent")).alias("purity"))


def smoothed(bad: Column, good: Column, towards: Column) -> Column:
    return (bad + WEIGHT * towards) / (bad + good + WEIGHT)


def grown_by_a_level(tree: DataFrame, level: int) -> DataFrame:
    """The tree with the templates, shares and labels of one level more; shapes that have ended stay as they are."""
    parts = tree.withColumn("part", F.get("parts", F.lit(level - 1)))
    rows = parts.where("part IS NOT NULL")
    ends = lambda c: F.sum(F.when(F.size("parts") == level, F.col(c)).otherwise(0))
    branches = rows.groupBy("host", "template", "part").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), ends("bad").alias("bad_ends"), ends("good").alias("good_ends"), F.first("share").alias("above"), F.collect_set("salt").alias("of_rows")
    )
    level_sums = (F.sum("n").alias("l_n"), F.sum("bad").alias("l_bad"), F.sum("good").alias("l_good"), F.count(F.lit(1)).alias("l_parts"))
    branches = beside(branches.withColumn("salt", salt_of("part")), ["host", "template"], *level_sums)
    known, common = F.col("bad") + F.col("good"), (F.col("l_bad") + 1) / (F.col("l_bad") + F.col("l_good") + 2)
    error = F.sqrt(common * (1 - common) / F.greatest(known, F.lit(1)))
    alike = (known > 0) & (F.abs(F.col("bad") / F.greatest(known, F.lit(1)) - common) <= ALIKE * error)
    variable = (F.col("l_parts") >= LEAST_SEGMENTS) & (F.col("l_parts") >= SPREAD * F.col("l_n"))
    general = F.when(variable, F.lit("*")).when((F.col("l_parts") > 1) & alike, F.lit("#")).otherwise(F.col("part"))  # no segment has a #
    if level == 1:  # what is above the first level is the host
        branches = branches.withColumn("above", smoothed(F.col("l_bad"), F.col("l_good"), F.lit(0.5)))
    named = branches.withColumn("grown", F.concat_ws("/", "template", general)).select("host", "template", "part", "grown", "above", "bad", "good", "bad_ends", "good_ends", "of_rows", "salt")
    of_template = {"bad": "g_bad", "good": "g_good", "bad_ends": "e_bad", "good_ends": "e_good"}  # of all that is below a template, and of what ends there
    summed = beside(named, ["host", "grown"], *(F.sum(c).alias(name) for c, name in of_template.items()))
    found = spread(summed.select("host", "template", "part", "grown", "above", *of_template.values(), F.col("of_rows").alias("salts")))
    here = rows.select("host", "shape", "n", "bad", "good", "parts", "template", "part", "salt").join(found, ["host", "template", "part", "salt"])
    columns = ["host", "shape", "n", "bad", "good", "parts", "template", "salt", "parent", "share", "t_bad", "t_good"]
    values = {"template": F.col("grown"), "parent": F.col("above"), "share": smoothed(F.col("g_bad"), F.col("g_good"), F.col("above")), "t_bad": F.col("e_bad"), "t_good": F.col("e_good")}
    return here.select(*(values.get(c, F.col(c)).alias(c) for c in columns)).unionByName(parts.where("part IS NULL").select(*columns))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    urls = judged(pages, rules)
    rejected = templates(urls).where((F.col("labels") >= LEAST_LABELS) & (F.col("purity") >= REJECT) & (F.col("host") != "")).select("host", "shape", F.lit("block").alias("by_tree"))
    if small_enough(rejected, BROADCAST_BYTES, F.length("host") + F.length("shape") + 64):
        rejected = F.broadcast(rejected)
    joined = urls.join(rejected, ["host", "shape"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree", F.lit("allow")).alias("verdict"))
