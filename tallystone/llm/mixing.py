"""Mixing sources to target weights by budgets on a domain - language - source tree.

A token budget goes down the tree in proportion to weights. What a node can't use (its documents, read
``max_epochs`` times, hold fewer tokens than its share) goes to its siblings first, and further up only once
they are full. Each source then gives its documents in the order of seeded epochs until its budget is spent:
whole epochs, and a prefix of the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.scratch import Scratch

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Relative whole-number weights at each level; names that aren't listed have the weight of "*"."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "reference": 3, "forum": 2, "*": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 2, "*": 1})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 2, "*": 1})
    #: The budget is this many tokens of a hundred that the table has.
    percent: int = 60
    max_epochs: int = 3
    seed: int = 20240201


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number its name ends in, modulo three; names without one are web."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    rest = F.pmod(F.when(number == "", F.lit(0)).otherwise(number.try_cast("int")), F.lit(3))
    return F.when(rest == 1, "reference").when(rest == 2, "forum").otherwise("web")


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space (ASCII)."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(int(weights.get("*", 1)))
    for name, weight in sorted(weights.items()):
        if name != "*":
            out = F.when(F.col(column) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _share_out(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Give each parent's ``budget`` to its children (columns cap, budget): in proportion to their weights, but
    to none more than its ``cap``; what that leaves goes to the siblings that have room. Whole tokens; the
    fractions of a token that rounding leaves are given to nobody."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = by.orderBy((F.col("cap") / F.col("w")).asc_nulls_last(), name).rowsBetween(Window.unboundedPreceding, -1)
    w = nodes.withColumn("w", F.when(F.col("cap") > 0, _weight(name, weights)).otherwise(F.lit(0).cast("long"))).where("w > 0")
    w = w.withColumn("c_before", F.coalesce(F.sum("cap").over(ordered), F.lit(0).cast("long"))).withColumn("w_from", F.sum("w").over(by) - F.coalesce(F.sum("w").over(ordered), F.lit(0).cast("long")))
    # in the order of cap per weight, those that fill up come first
    w = w.withColumn("full", F.col("cap") * F.col("w_from") <= (F.col("budget") - F.col("c_before")) * F.col("w"))
    w = w.withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0).cast("long"))).withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    share = F.floor((F.col("budget") - F.col("c_full")) * F.col("w") / F.col("w_open")).cast("long")
    return w.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))).drop("w", "c_before", "w_from", "full", "c_full", "w_open")


def leaf_budgets(sizes: DataFrame, targets: Targets) -> DataFrame:
    """``sizes`` (domain, lang, source, tokens) -> the same with budget. One row a source: windows over siblings."""
    leaves = sizes.withColumn("cap", F.col("tokens") * targets.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = domains.withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * targets.percent / 100).cast("long")).drop("tokens")
    domains = _share_out(total, [], "domain", targets.domains)
    langs = _share_out(langs.drop("tokens").join(domains.select("domain", "budget"), "domain"), ["domain"], "lang", targets.langs)
    leaves = _share_out(leaves.join(langs.select("domain", "lang", "budget"), ["domain", "lang"]), ["domain", "lang"], "source", targets.sources)
    return leaves.select(*LEAF, "tokens", "budget")


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document comes in an epoch: the md5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _cuts(sized: DataFrame, budgets: DataFrame, targets: Targets, scratch: Scratch) -> DataFrame:
    """One row per source: whole epochs, and the place (and id) of the last document of the prefix after them."""
    plan = budgets.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = scratch.save(plan, "plan")
    at = sized.join(plan.where("rest > 0").select(*LEAF, "epochs", "rest"), [*LEAF]).withColumn("place", _place(targets.seed, F.col("epochs"), F.col("doc_id")))
    at = scratch.save(at.select(*LEAF, "doc_id", "n_tokens", "place", "rest"), "places")

    def narrow(rows: DataFrame, digits: int) -> DataFrame:
        """Per source, the group of places (by their next two digits) in which the budget runs out."""
        group = F.substring("place", 1, digits).alias("head")
        sums = rows.groupBy(*LEAF, "rest", group).agg(F.sum("n_tokens").alias("t"))
        before = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("head")) - F.col("t")
        found = sums.withColumn("before", before).where("before <= rest and before + t > rest")
        return scratch.save(found.select(*LEAF, "head", (F.col("rest") - F.col("before")).alias("rest")), f"group-{digits}")

    rows = at
    for digits in (2, 4):
        last = narrow(rows, digits)
        rows = rows.drop("rest").join(last, [*LEAF]).where(F.substring("place", 1, digits) == F.col("head")).drop("head")
    # a source's documents of one group, about one of 65,536: rows of one id stand or fall together
    whole = rows.groupBy(*LEAF, "rest", "place", "doc_id").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    over = whole.withColumn("run", run).where("run > rest").groupBy(*LEAF).agg(F.min(F.struct("place", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("first_out"))
    return scratch.save(plan.select(*LEAF, "budget", "epochs", "rest").join(over, [*LEAF], "left"), "cuts")


def _leaves(docs: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"domain": F.coalesce(domain(known("source")), F.lit("")), "lang": known("lang"), "source": known("source")})


def _copies(targets: Targets) -> Column:
    """How often a document is taken: once for each whole epoch, and once more in the prefix of the next."""
    place = F.struct(_place(targets.seed, F.col("epochs"), F.col("doc_id")).alias("place"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    more = F.when((F.col("rest") > 0) & (F.col("first_out").isNull() | (place < F.col("first_out"))), 1).otherwise(0)
    return F.coalesce(F.col("epochs") + more, F.lit(0)).cast("int")


def mixed(docs: DataFrame, targets: Targets = Targets(), *, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): how often each document of ``docs`` is taken.

    ``docs`` has doc_id, text, lang, source; ``domain`` gives the domain of a source's name (the default goes by the
    number that it ends in, and stands for a table of domains that a caller has). A source takes whole epochs as long as its budget lasts and then
    the documents of the next epoch's order up to the first that would exceed the budget. Documents without
    tokens cost nothing and go with their place in the order. Null and empty texts have no tokens; null names
    count as the name ""; a source of weight 0 gives nothing. Rows of equal id stand or fall together within
    a source. A source of many documents is cut by sums over groups of places, never sorted as a whole. An
    empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_leaves(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens")), domain), "sized")
    budgets = leaf_budgets(sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), targets)
    cuts = _cuts(sized, budgets, targets, scratch)
    taken = sized.join(cuts, [*LEAF], "left").withColumn("copies", _copies(targets))
    return taken.select("doc_id", *LEAF, "n_tokens", "copies")


def keep_mixed(docs: DataFrame, targets: Targets = Targets(max_epochs=1), *, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it; all columns as they are."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_leaves(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens")), domain), "sized")
    cuts = _cuts(sized, leaf_budgets(sized.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), targets), targets, scratch)
    leaf = {c: f"_leaf_{c}" for c in LEAF}
    keyed = _leaves(docs.select("doc_id", "lang", "source", F.struct(*docs.columns).alias("row")), domain).select("row", F.col("doc_id").cast("long").alias("doc_id"), *LEAF)
    taken = keyed.join(cuts, [*leaf], "left").withColumn("copies", _copies(targets)).where("copies > 0")
    if targets.max_epochs > 1:
        taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


def mixing_sql(targets: Targets = Targets()) -> str:
    """``mixed`` for DuckDB over the table documents."""

    def weight(column: str, weights: dict[str, int]) -> str:
        cases = " ".join(f"WHEN {column} = '{n}' THEN {w}" for n, w in sorted(weights.items()) if n != "*")
        return f"(CASE {cases} ELSE {weights.get('*', 1)} END)"

    def level(name: str, source: str, parent: str, column: str, weights: dict[str, int]) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_w AS (SELECT *, {weight(column, weights)} AS w FROM {source} WHERE cap > 0 AND {weight(column, weights)} > 0),
{name}_p AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_from FROM {name}_w),
{name}_f AS (SELECT *, cap * w_from <= (budget - c_before) * w AS is_full FROM {name}_p),
{name}_s AS (SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0) AS c_full, sum(w) FILTER (WHERE NOT is_full) OVER ({by}) AS w_open FROM {name}_f),
{name} AS (SELECT * EXCLUDE (budget, w, c_before, w_from, is_full, c_full, w_open),
  CAST(CASE WHEN is_full THEN cap ELSE least(cap, CAST(floor(CAST((budget - c_full) * w AS DOUBLE) / CAST(w_open AS DOUBLE)) AS BIGINT)) END AS BIGINT) AS budget FROM {name}_s)"""

    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE CAST(coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), ''), '0') AS BIGINT) % 3 WHEN 1 THEN 'reference' WHEN 2 THEN 'forum' ELSE 'web' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaf0 AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {targets.max_epochs} AS BIGINT) AS cap FROM sized GROUP BY ALL),
lang0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf0 GROUP BY ALL),
dom0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(floor(CAST(sum(tokens) * {targets.percent} AS DOUBLE) / 100.0) AS BIGINT) FROM leaf0) AS budget FROM lang0 GROUP BY domain),
{level("dom", "dom0", "", "domain", targets.domains)},
lang1 AS (SELECT l.*, d.budget FROM lang0 l JOIN dom d USING (domain)),
{level("lng", "lang1", "domain", "lang", targets.langs)},
leaf1 AS (SELECT l.*, g.budget FROM leaf0 l JOIN lng g USING (domain, lang)),
{level("leaf", "leaf1", "domain, lang", "source", targets.sources)},
plan AS (SELECT domain, lang, source, CAST(floor(CAST(budget AS DOUBLE) / tokens) AS BIGINT) AS epochs, budget - CAST(floor(CAST(budget AS DOUBLE) / tokens) AS BIGINT) * tokens AS rest FROM leaf),
placed AS (
  SELECT s.*, p.epochs, p.rest, md5(concat_ws(':', '{targets.seed}', CAST(p.epochs AS VARCHAR), coalesce(CAST(s.doc_id AS VARCHAR), ''))) AS place
  FROM sized s LEFT JOIN plan p USING (domain, lang, source)
), run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) AS upto FROM placed),
marked AS (SELECT *, bool_or(upto > rest) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) AS passed FROM run)
SELECT doc_id, domain, lang, source, n_tokens, CAST(coalesce(epochs + CASE WHEN rest > 0 AND NOT passed THEN 1 ELSE 0 END, 0) AS INTEGER) AS copies FROM marked
"""
