"""URL verdicts by rules, and by a tree of path templates where no rule fits.

The tree. Pages are summed by (host, path) first. Then, level by level, a segment of a path is generalised: by form (numbers, hexadecimal
and long mixed strings become wildcards, with their file ending), or because its parent has many different children with few pages each.
Next, branches of a host that differ in one segment only are merged if their shares of blocked among labelled pages are alike within
Z standard errors of the branches' common share. A template is rejected if its smoothed purity passes a limit:
purity = (blocked + STRENGTH * prior) / (labelled + STRENGTH), where `labelled` are pages that a rule fits, `blocked` those that a
blocking rule fits, and the prior is the share of blocked among all labelled pages. Pages without a label say nothing about their
template. A branch of such pages only joins its siblings where two labelled ones at least are merged, or none has labels; a template
without labels has the prior as its purity, and is allowed.

Cases: a null url, or one without "://", has an empty host and path, no rule, and is allowed; equal urls get equal verdicts; of fitting rules the longest wins (of equal length
the first by code point); the levels go to the last segment of the longest path; an empty table gives an empty result;
other columns don't matter. No group of a host meets in one task: sums are made by (host, prefix, segment) with partial sums, and those that most
rows look for are broadcast as they are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_left, table

#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MANY = 16
FEW_PAGES = 4.0
Z = 2.0
STRENGTH = 4.0
LIMIT = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    whole = F.coalesce(url, F.lit(""))
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, form, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, form, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    """A segment with variable parts as wildcards; its file ending stays."""
    name, ending = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = F.when(name.rlike(r"^[0-9]+$"), F.lit("{number}")).when(name.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}")).when(name.rlike(r"^(?=.*[0-9]).{24,}$"), F.lit("{long}"))
    return F.when(kind.isNotNull(), F.concat(kind, ending)).otherwise(segment)


def _depth(rows: DataFrame) -> int:
    """Segments of the longest template."""
    return rows.agg(F.max(F.size("template"))).first()[0] or 0


def templates(scratch: Scratch, paths: DataFrame) -> DataFrame:
    """paths (host, path, pages, labelled, blocked) with `template`: an array of segments."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    start = F.when(F.col("path").isin("", "/"), F.array().cast("array<string>")).otherwise(parts)
    rows = scratch.keep(paths.withColumn("template", F.transform(start, _form)), "level-0")
    for level in range(_depth(rows)):
        prefix = F.concat_ws("/", F.slice("template", 1, level)) if level else F.lit("")
        deep = rows.filter(F.size("template") > level).select("host", prefix.alias("prefix"), F.col("template")[level].alias("segment"), "pages")
        children = deep.groupBy("host", "prefix", "segment").agg(F.sum("pages").alias("pages"))
        wide = children.groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("pages").alias("pages"))
        wide = wide.filter((F.col("children") > MANY) & (F.col("pages") < FEW_PAGES * F.col("children"))).select("host", "prefix", F.col("children").alias("wide"))
        marked = join_left(rows.withColumn("prefix", prefix), scratch.keep(wide, f"wide-{level}"), ["host", "prefix"], "wide")
        general = F.transform("template", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))  # noqa: B023
        rows = scratch.keep(marked.withColumn("template", F.when(F.col("wide").isNotNull() & (F.size("template") > level), general).otherwise(F.col("template"))).drop("prefix", "wide"), f"level-{level + 1}")
    return rows


def merged(scratch: Scratch, rows: DataFrame, prior: float) -> DataFrame:
    """(host, template, final): the templates of a host, branches that are alike merged, from the deepest segment upwards."""
    sums = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    state = scratch.keep(sums.withColumn("final", F.col("template")), "merge-0")
    for step, level in enumerate(reversed(range(_depth(rows))), 1):
        branch = state.groupBy("host", "final").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        wild = F.transform("final", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))  # noqa: B023
        branch = branch.filter(F.size("final") > level).withColumn("wild", wild)
        common = branch.groupBy("host", "wild").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.count("*").alias("branches")).filter("branches > 1")
        share = (F.col("all_blocked") + STRENGTH * prior) / (F.col("all_labelled") + STRENGTH)
        own = (F.col("blocked") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)
        alike = (F.col("labelled") > 0) & (F.abs(own - share) <= Z * F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1))))
        branch = join_left(branch, scratch.keep(common, f"common-{step}"), ["host", "wild"], "branches").filter("branches IS NOT NULL").withColumn("alike", alike)
        joined = scratch.keep(branch.groupBy("host", "wild").agg(F.count_if("alike").alias("joined"), F.count("*").alias("here")), f"joined-{step}")
        follows = (F.col("labelled") == 0) & ((F.col("joined") > 1) | (F.col("all_labelled") == 0))
        moved = join_left(branch, joined, ["host", "wild"], "here").filter(((F.col("joined") > 1) & F.col("alike")) | follows).select("host", "final", "wild")
        out = state.join(moved, ["host", "final"], "left").withColumn("final", F.coalesce("wild", "final")).drop("wild")
        state = scratch.keep(out.select("host", "template", "labelled", "blocked", "final"), f"merge-{step}")
    return state


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every url."""
    scratch = Scratch(df.sparkSession, "urls")
    host, path = split_url(F.col(url_col).cast("string"))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))
    paths = pages.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"), F.count("rule").alias("labelled"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    rows = templates(scratch, scratch.keep(paths, "paths"))
    prior = rows.agg(F.try_divide(F.sum("blocked"), F.sum("labelled"))).first()[0] or 0.0
    state = merged(scratch, rows, prior)
    finals = state.groupBy("host", "final").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    finals = finals.select("host", "final", "labelled", ((F.col("blocked") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)).alias("purity"))
    known = rows.select("host", "path", "template", "pages").join(state.select("host", "template", "final"), ["host", "template"]).join(finals, ["host", "final"])
    known = scratch.keep(known.select("host", "path", F.concat(F.lit("/"), F.concat_ws("/", "final")).alias("template"), "purity", "labelled", "pages"), "known")
    out = join_left(pages, known, ["host", "path"], "pages")
    method = F.when((F.col("purity") > limit) & (F.col("labelled") > 0), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")


def op7_url_templates(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
