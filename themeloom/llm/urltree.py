"""URL filter: rules first, then a tree of path templates per host, judged by labelled purity.

1. **Templates.** Segments that look variable (numbers, long codes, mixed letters and digits) become
   wildcards by their form; the table of URLs shrinks to counts of (host, masked path), added up before
   the shuffle. Then, level by level from the root, a segment becomes a wildcard where its node has
   many children and this one is rare among them. No host is gathered: nodes are grouped rows.
2. **Merging.** Branches that differ in one segment alone are siblings. A labelled sibling whose rate
   of bad labels doesn't differ from the others' (two-proportion test) shares their pooled counts.
3. **Purity.** ``(bad + strength * base rate) / (labelled + strength)``. A template is rejected at
   ``reject_at`` or more; one without labels has the base rate and is never rejected for want of evidence.

Labels are the verdicts of the rules, or a column of the caller's.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and no template
of its own, and is allowed. Of rules that fit the longest wins, of equal ones the blocking one.
Paths are cut into ``DEPTH`` segments; what follows is the last one's tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.lineage import Workspace

DEPTH = 8
CHILDREN = 8
RARE = 0.05
STRENGTH = 5.0
REJECT_AT = 0.9
SIMILAR = 1.96
LABELLED = 3
SMALL_TABLE = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; ``rules`` are (verdict, host and path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Shorter rules first, so that longer ones override them.
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def masked(segment: Column) -> Column:
    """A segment that varies by its form, as a wildcard with its ending."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    varies = (
        stem.rlike(r"^[0-9]+$") | stem.rlike(r"^[0-9a-fA-F-]{8,}$") | stem.rlike(r"[0-9].*[0-9].*[0-9].*[0-9]") | (F.length(stem) > 32)
    )
    return F.when(varies, F.concat(F.lit("*"), end)).otherwise(segment)


def segments(path: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", DEPTH), masked)


def templates(urls: DataFrame, work: Workspace) -> DataFrame:
    """(host, parts, template, n, labelled, bad) for every masked path of ``urls`` (host, parts, bad)."""
    counted = work.save(
        urls.groupBy("host", "parts").agg(
            F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ),
        "masked",
    ).withColumn("template", F.array().cast("array<string>"))
    deepest = counted.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(deepest):
        here = counted.withColumn("seg", F.get("parts", F.lit(level)))
        child = here.filter("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("own"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("own").alias("whole"))
        node = node.filter(F.col("children") >= CHILDREN)
        rare = child.join(node, ["host", "template"]).filter(F.col("own") < RARE * F.col("whole")).select(
            "host", "template", "seg", F.lit(True).alias("rare")
        )
        seg = F.when(F.col("rare"), F.lit("*")).otherwise(F.col("seg"))
        grown = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.array(seg)))
        counted = here.join(rare, ["host", "template", "seg"], "left").withColumn("template", grown).drop("seg", "rare")
        counted = work.rotate(counted, "level")
    return counted


def judged_templates(counted: DataFrame, reject_at: float = REJECT_AT, strength: float = STRENGTH) -> DataFrame:
    """(host, template, labelled, bad, purity, rejected) of every template, siblings merged."""
    own = counted.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = own.agg(F.sum("labelled"), F.sum("bad")).first()
    base = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    # Siblings differ in their first literal segment.
    literal = F.array_position(F.transform("template", lambda s: ~s.startswith("*")), True).cast("int")
    family = F.transform("template", lambda s, i: F.when(i == literal - 1, F.lit("<any>")).otherwise(s))
    own = own.withColumn("family", F.when(literal > 0, family).otherwise(F.col("template")))
    some = own.filter(F.col("labelled") >= LABELLED)
    pool = some.groupBy("host", "family").agg(F.sum("labelled").alias("pool_n"), F.sum("bad").alias("pool_bad"))
    rate = F.col("pool_bad") / F.col("pool_n")
    rest_n, rest_bad = F.col("pool_n") - F.col("labelled"), F.col("pool_bad") - F.col("bad")
    spread = F.sqrt(rate * (1 - rate) * (1 / F.col("labelled") + 1 / F.when(rest_n > 0, rest_n)))
    apart = F.abs(F.col("bad") / F.col("labelled") - rest_bad / F.when(rest_n > 0, rest_n))
    same = some.join(pool, ["host", "family"]).filter(apart <= SIMILAR * spread)
    merged = same.groupBy("host", "family").agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"))
    shared = same.select("host", "family", "template").join(merged, ["host", "family"]).drop("family")
    out = own.join(shared, ["host", "template"], "left")
    n, bad = F.coalesce("all_n", "labelled"), F.coalesce("all_bad", "bad")
    purity = (bad + strength * base) / (n + strength)
    return out.select("host", "template", "n", "labelled", "bad", purity.alias("purity"), ((purity >= reject_at) & (n > 0)).alias("rejected"))


def judge_urls(
    urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", label: str | None = None, reject_at: float = REJECT_AT,
    strength: float = STRENGTH,
) -> DataFrame:
    """``urls`` with ``judged``: host, path, rule, verdict, template and its purity."""
    spark = urls.sparkSession
    work = Workspace(spark, "urls")
    # The caller's row is one column, so that none of its names can meet those below.
    host, path = host_and_path(F.col(f"_row.{url}"))
    rule, says = rule_of(F.col("_u.host"), F.col("_u.path"), rules)
    whole = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("_row"))
    read = whole.withColumn("_u", F.struct(host.alias("host"), path.alias("path"))).withColumn(
        "_r", F.struct(rule.alias("rule"), says.alias("says"), segments(F.col("_u.path")).alias("parts"))
    )
    bad = F.col(f"_row.{label}").cast("int") if label else F.when(F.col("_r.says").isNotNull(), (F.col("_r.says") == "block").cast("int"))
    rows = read.filter("_u.host <> ''").select(F.col("_u.host").alias("host"), F.col("_r.parts").alias("parts"), bad.alias("bad"))
    counted = templates(rows, work)
    verdicts = judged_templates(counted, reject_at, strength)
    known = work.save(
        counted.select("host", "parts", "template").join(verdicts.select("host", "template", "purity", "rejected"), ["host", "template"]),
        "templates",
    )
    short = known.count() <= SMALL_TABLE
    known = known.select(*[F.col(c).alias(f"_t_{c}") for c in known.columns])
    joined = read.join(
        F.broadcast(known) if short else known, (F.col("_u.host") == F.col("_t_host")) & (F.col("_r.parts") == F.col("_t_parts")), "left"
    )
    own = F.when(F.col("_t_rejected"), F.lit("block")).otherwise(F.lit("allow"))
    judged = F.struct(
        F.col("_u.host").alias("host"), F.col("_u.path").alias("path"), F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.says"), own).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("_t_template", "/")).alias("template"), F.col("_t_purity").alias("purity"),
    )
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in urls.columns if c != "judged"], judged.alias("judged"))
