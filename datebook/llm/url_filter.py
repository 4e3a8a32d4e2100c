"""URL filters by a tree of path templates.

A path's segments are generalised where they look like a number, a date or an identifier, and the
distinct paths of each host are counted; only these counts are worked on.  From the root down, a
place of the tree with many children, most of them rare, becomes a wildcard.  Sibling branches whose
share of bad pages doesn't differ significantly from the rest of their parent's are merged.  A
template is rejected when the smoothed share of bad pages among all its pages is high.

Labels come from the rules (allow is good, block is bad) and from a list of terms in hosts and paths.
A page without a rule counts as good unless it holds a term, so hits weigh against all such pages.
A page that a rule fits has the rule's verdict whatever its template.

Edge cases: a null url or one without ``://`` has an empty host and path, which form a template like any
other; equal urls share a verdict; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import checkpointed, table

#: (verdict, host and path); the longest rule that fits wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Terms between word ends in a host or path that mark a page as bad.
BAD_TERMS = ["adult", "casino", "cheap", "gambling", "malware", "phishing", "pills", "porn", "spam", "warez", "xxx"]

#: A place with more children than this, at most a tenth of its pages to each on average, is a wildcard.
MOST_CHILDREN = 20
#: Significance of a difference between branches, in standard errors.
DIFFERENT = 1.96
#: The expected bad share before any page, and how many pages it weighs.
PRIOR, WEIGHT = 0.1, 2.0
REJECT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def generalised(path: Column) -> Column:
    """Segments of a path, the variable ones as ``*`` with their ending."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    variable = r"^(?:[0-9][0-9_.-]*|[0-9a-fA-F-]{8,}|[A-Za-z0-9_-]{24,}|[A-Za-z_-]*[0-9]{3,})(\.[a-z]{1,5})?$"
    return F.transform(parts, lambda x: F.regexp_replace(x, variable, "*$1"))


def path_templates(pages: DataFrame, rules=RULES, bad_terms=BAD_TERMS) -> DataFrame:
    """``host, parts, template, purity, labelled`` for every host and generalised path."""
    rows = pages.select("host", "path", "verdict", generalised(F.col("path")).alias("parts"))
    term = "(?i)(?:^|[^a-z])(?:" + "|".join(bad_terms) + ")(?:[^a-z]|$)"
    bad = F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0).when(F.concat("host", "path").rlike(term), 1)
    tree = checkpointed(rows.groupBy("host", "parts").agg(F.count("*").alias("n"), F.sum(F.when(bad == 1, 1).otherwise(0)).alias("bad"), F.count(bad).alias("labelled")))
    tree = tree.withColumn("template", F.lit(""))
    # A round for each level there is: one very deep path makes many rounds.
    for level in range(tree.agg(F.max(F.size("parts"))).first()[0] or 0):
        part = F.get(F.col("parts"), F.lit(level))
        tree = tree.withColumn("part", part)
        children = tree.filter("part IS NOT NULL").groupBy("host", "template", "part").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        places = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
        both = children.join(places, ["host", "template"])
        others, other_bad = F.col("all_n") - F.col("n"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_n")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "n") + F.try_divide(F.lit(1), others)))
        differs = F.coalesce((error > 0) & (F.abs(F.try_divide("bad", "n") - F.try_divide(other_bad, others)) > DIFFERENT * error), F.lit(False))
        unlike = ((F.col("labelled") > 0) != (F.col("all_labelled") > F.col("labelled"))) | ((F.col("bad") == F.col("n")) != (other_bad == others))  # nothing shows that they are alike
        crowded = (F.col("kinds") > MOST_CHILDREN) & (F.col("kinds") * 10 > F.col("all_n"))
        alike = (F.col("kinds") > 1) & (F.col("all_labelled") > 0) & ~differs & ~unlike
        named = both.select("host", "template", "part", F.when(crowded & ~differs | alike, "*").otherwise(F.col("part")).alias("name"))
        joined = tree.join(named, ["host", "template", "part"], "left")
        tree = joined.select("host", "parts", "n", "bad", "labelled", F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"))
        tree = checkpointed(tree)
    totals = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    purity = (F.col("bad") + PRIOR * WEIGHT) / (F.col("n") + WEIGHT)
    return tree.select("host", "parts", "template").join(totals.select("host", "template", "labelled", purity.alias("purity")), ["host", "template"])


def url_filter(pages: DataFrame, rules=RULES, bad_terms=BAD_TERMS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity`` of every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(id_col, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    templates = path_templates(rows, rules, bad_terms)
    judged = rows.withColumn("parts", generalised(F.col("path"))).join(templates, ["host", "parts"])
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
