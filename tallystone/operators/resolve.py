"""Entities: shared identifiers, resolution of candidates, related entities, and reviewed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import canonical_name
from tallystone.operators.dedupe import chased
from tallystone.operators.dml import rewritten_keys
from tallystone.sources.exports import cut, published

# Confidence of links and identifiers by how they came about.
LINK_CONFIDENCE = {"name_identifier_conflict": 0.30, "identifier_collision": 0.20, "late_collision": 0.15}
STRONG_IDENTIFIER, WEAK_IDENTIFIER = 0.7, 0.35


def shared(identifiers: DataFrame) -> DataFrame:
    """(kind, normalized, merchant_id, first, owners): the owners of identifiers of several, each with the least of
    them: all pairs of owners follow from these, without being written out."""
    own = identifiers.select("merchant_id", "kind", "normalized").distinct()
    several = own.groupBy("kind", "normalized").agg(F.min("merchant_id").alias("first"), F.count("*").alias("owners")).where("owners > 1")
    return own.join(several, ["kind", "normalized"]).select("kind", "normalized", "merchant_id", "first", "owners")


def collisions(identifiers: DataFrame) -> DataFrame:
    """(left_id, right_id, kind, normalized): each owner of a shared identifier but the first, linked to the first."""
    return shared(identifiers).where("merchant_id <> first").select(F.col("first").alias("left_id"), F.col("merchant_id").alias("right_id"), "kind", "normalized")


def collision_pairs(identifiers: DataFrame) -> DataFrame:
    """All pairs of owners of the same identifier, smaller id first: as many as the square of its owners, for
    callers that need the pairs themselves."""
    own = shared(identifiers)
    left, right = own.select("kind", "normalized", F.col("merchant_id").alias("left_id")), own.select("kind", "normalized", F.col("merchant_id").alias("right_id"))
    return left.join(right, ["kind", "normalized"]).where("left_id < right_id")


def resolved(candidates: DataFrame, identifiers: DataFrame, merchants: DataFrame) -> DataFrame:
    """The entity of each candidate (candidate_id, kind, normalized, name, city; one row per identifier).

    A single owner of its strong identifiers (all kinds but address) is the entity; else a row of the same
    normalised name and city; else it is new. ``how`` says which, and whether other owners collide.
    """
    # one row for each identifier, however many own it
    held = identifiers.groupBy("kind", "normalized").agg(F.count_distinct("merchant_id").alias("n"), F.min("merchant_id").alias("owner"))
    strong = candidates.where("kind <> 'address'").join(held, ["kind", "normalized"])
    owners = strong.groupBy("candidate_id").agg(F.greatest(F.max("n"), F.count_distinct("owner")).alias("owners"), F.min("owner").alias("owner"))
    named = candidates.select("candidate_id", canonical_name(F.col("name")).alias("_name"), F.lower("city").alias("_city")).distinct().where("_name <> ''")
    by_name = named.join(merchants.select(F.col("merchant_id").alias("same"), canonical_name(F.col("name")).alias("_name"), F.lower("city").alias("_city")), ["_name", "_city"]).groupBy("candidate_id").agg(F.min("same").alias("same"))
    out = candidates.select("candidate_id").distinct().join(owners, "candidate_id", "left").join(by_name, "candidate_id", "left")
    single, several = F.col("owners") == 1, F.col("owners") > 1
    how = F.when(single, "identifier").when(F.col("same").isNotNull() & several, "name_with_conflict").when(F.col("same").isNotNull(), "name").when(several, "new_with_collision").otherwise("new")
    return out.select("candidate_id", F.when(single, F.col("owner")).otherwise(F.col("same")).alias("merchant_id"), how.alias("how"))


def related(links: DataFrame) -> DataFrame:
    """Both directions of each link; per pair the most confident one, and of equal ones that stored this way round."""
    ends = lambda a, b, out: links.select(F.col(a).alias("merchant_id"), F.col(b).alias("other_id"), "relation", "confidence", F.lit(out).alias("outgoing"), "link_id")
    both = ends("left_id", "right_id", 1).unionByName(ends("right_id", "left_id", 0)).where("merchant_id <> other_id")
    order = Window.partitionBy("merchant_id", "other_id").orderBy(F.col("confidence").desc(), F.col("outgoing").desc(), "link_id")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("merchant_id", "other_id", "relation", "confidence")


def rewritten_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links between the entities that stay: ends replaced and sorted, loops gone, best link of each pair kept."""
    moved = rewritten_keys(rewritten_keys(links, mapping, "left_id"), mapping, "right_id").where("left_id <> right_id")
    sorted_ends = moved.withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")})
    order = Window.partitionBy("left_id", "right_id", "relation").orderBy(F.col("confidence").desc(), "link_id")
    return sorted_ends.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def one_family(owners: DataFrame, group: list[str]) -> DataFrame:
    """Groups of several owners (merchant_id, keys array): whether every owner shares a key with the first."""
    first = owners.groupBy(*group).agg(F.min_by("keys", "merchant_id").alias("_first"), F.count_distinct("merchant_id").alias("_n")).where("_n > 1")
    return owners.join(first, group).groupBy(*group).agg(F.bool_and(F.arrays_overlap("keys", "_first")).alias("one_family"))


def merged(merchants: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases after a reviewed merge (old, new): the one that stays takes the highest confidence,
    and the names of those that go become aliases of it."""
    moved = rewritten_keys(merchants, mapping, "merchant_id")
    kept = moved.groupBy("merchant_id").agg(F.max("identity_confidence").alias("identity_confidence"), F.min_by("name", F.col("name")).alias("name"))
    retired = merchants.join(mapping.select(F.col("old").alias("merchant_id"), "new"), "merchant_id").select(F.col("new").alias("merchant_id"), F.lower("name").alias("normalized_alias"))
    all_ = rewritten_keys(aliases, mapping, "merchant_id").select("merchant_id", "normalized_alias").unionByName(retired).distinct()
    return kept, all_


def preflight(mapping: DataFrame, merchants: DataFrame) -> DataFrame:
    """What forbids a merge: repeated ids, ids that don't exist, and targets that are retired themselves."""
    bad = lambda df, why: df.select("old", F.lit(why).alias("problem"))
    twice = mapping.groupBy("old").count().where("count > 1")
    absent = mapping.join(merchants.select(F.col("merchant_id").alias("old")), "old", "left_anti")
    chained = mapping.join(mapping.select(F.col("old").alias("new")), "new", "left_semi")
    return bad(twice, "repeated").unionByName(bad(absent, "missing")).unionByName(bad(chained, "target retired"))


class MergeRefused(ValueError):
    """A reviewed merge that its preflight or its postconditions forbid; nothing has been published."""


def merge_tables(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """All tables of a data set after a reviewed merge (old, new): entities and aliases merged, owners rewritten,
    claims of one entity and type joined, links rewritten, copies of copies pointed at their root."""
    out = dict(tables)
    out["merchants"], out["aliases"] = merged(tables["merchants"], tables["aliases"], mapping)
    out["links"] = rewritten_links(tables["links"], mapping)
    out["identifiers"] = rewritten_keys(tables["identifiers"], mapping, "merchant_id").dropDuplicates(["merchant_id", "kind", "normalized"])
    moved = rewritten_keys(tables["claims"], mapping, "merchant_id")
    first = moved.groupBy("merchant_id", "claim_type").agg(F.min("claim_id").alias("kept"))
    joined = moved.join(first, ["merchant_id", "claim_type"])
    out["claims"] = joined.where("claim_id = kept").drop("kept")
    renamed = joined.select("claim_id", "kept")
    evidence = rewritten_keys(tables["evidence"], mapping, "merchant_id").join(renamed, "claim_id", "left").withColumn("claim_id", F.col("kept")).drop("kept")
    roots = chased(tables["evidence"], "evidence_id", "duplicate_of").select(F.col("id").alias("evidence_id"), "root")
    owners = evidence.select(F.col("evidence_id").alias("root"), F.col("merchant_id").alias("_owner"))
    evidence = evidence.join(roots, "evidence_id", "left").join(owners, "root", "left")
    keeps = (F.col("root") != F.col("evidence_id")) & (F.col("_owner") == F.col("merchant_id"))
    out["evidence"] = evidence.withColumn("duplicate_of", F.when(F.coalesce(keeps, F.lit(False)), F.col("root"))).drop("root", "_owner").select(*tables["evidence"].columns)
    out["claim_evidence"] = out["evidence"].select("claim_id", "evidence_id")
    return out


def postconditions(before: dict[str, DataFrame], after: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """(check_name, n) of what must be zero after a merge: rows lost or made, retired entities, observations without
    one claim of their own entity, roots of others, chains, self links, repeated names, sources without observations."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    a, e, claims = after, after["evidence"], after["claims"].select("claim_id", F.col("merchant_id").alias("owner"))
    lost = lambda t, gone=0: n(before[t]).withColumnRenamed("n", "was").join(F.broadcast(n(a[t]))).select((F.col("was") - F.lit(gone) - F.col("n")).alias("n"))
    retired = mapping.select(F.col("old").alias("merchant_id")).distinct()
    fewer = lost("merchants").join(F.broadcast(n(retired).withColumnRenamed("n", "gone"))).select((F.col("n") - F.col("gone")).alias("n"))
    roots = e.select(F.col("evidence_id").alias("duplicate_of"), F.col("merchant_id").alias("root_owner"), F.col("duplicate_of").alias("further"))
    rooted_ = e.join(roots, "duplicate_of")
    per_row = a["claim_evidence"].groupBy("evidence_id").agg(F.count("*").alias("k"))
    checks = {
        "merchants lost or made": fewer,
        "sources lost or made": lost("sources"),
        "evidence lost or made": lost("evidence"),
        "retired merchants remain": n(a["merchants"].join(retired, "merchant_id", "left_semi")),
        "evidence lacks a claim": n(e.where("claim_id is null")),
        "evidence lacks one claim_evidence row": n(e.join(per_row, "evidence_id", "left").where("coalesce(k, 0) <> 1")),
        "evidence and claim owners differ": n(e.join(claims, "claim_id").where("merchant_id <> owner")),
        "claim_evidence owners differ": n(a["claim_evidence"].join(claims, "claim_id").join(e.select("evidence_id", "merchant_id"), "evidence_id").where("merchant_id <> owner")),
        "duplicate roots cross sellers": n(rooted_.where("merchant_id <> root_owner")),
        "duplicate chains remain": n(rooted_.where("further is not null")),
        "self links remain": n(a["links"].where("left_id = right_id")),
        "names repeat": n(a["merchants"].groupBy(canonical_name(F.col("name")).alias("x")).count().where("count > 1")),
        "sources have no evidence": n(a["sources"].join(e.select("source_id"), "source_id", "left_anti").join(before["evidence"].select("source_id"), "source_id", "left_semi")),
    }
    out = None
    for name, count in checks.items():
        one = count.select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def reviewed_merge(tables: dict[str, DataFrame], mapping: DataFrame, *, apply: bool = False) -> DataFrame:
    """The postconditions of a reviewed merge; published as a new version (a manifest of its counts is returned) if
    ``apply``. Fails closed: nothing is written if the preflight finds anything or a postcondition isn't zero."""
    problems = preflight(mapping, tables["merchants"])
    if found := problems.limit(20).collect():
        raise MergeRefused("; ".join(f"{r['old']}: {r['problem']}" for r in found))
    after = {name: cut(df) if name in ("evidence", "claims", "merchants") else df for name, df in merge_tables(tables, mapping).items()}
    checks = cut(postconditions(tables, after, mapping))
    if found := checks.where("n <> 0").collect():
        raise MergeRefused("; ".join(f"{r['check_name']}: {r['n']}" for r in found))
    return published(mapping.sparkSession, after) if apply else checks


def attached(given: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rows (id, name, ...) with ``attached``: the entity of that id if there is one, else the first of that name."""
    named = merchants.groupBy(F.lower("name").alias("_low")).agg(F.min("merchant_id").alias("_by_name"))
    known = merchants.select(F.col("merchant_id").alias("id"), F.lit(True).alias("_there"))
    rows = given.join(known, "id", "left").withColumn("_low", F.lower("name")).join(named, "_low", "left")
    return rows.withColumn("attached", F.coalesce(F.when(F.col("_there"), F.col("id")), F.col("_by_name"))).drop("_low", "_there", "_by_name")
