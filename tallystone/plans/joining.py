"""Joins: inventory J."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import dml, resolve, search
from tallystone.plans.registry import query
from tallystone.plans.views import Views

c = F.col


@query("j01_inner", "SELECT evidence_id, url, host FROM evidence JOIN sources USING (source_id)")
def _(v: Views) -> DataFrame:
    return v.evidence.join(v.sources, "source_id").select("evidence_id", "url", "host")


@query("j02_three_way", "SELECT evidence_id, name, url FROM evidence JOIN merchants USING (merchant_id) JOIN sources USING (source_id)")
def _(v: Views) -> DataFrame:
    return v.evidence.join(v.merchants, "merchant_id").join(v.sources, "source_id").select("evidence_id", "name", "url")


@query("j03_left_outer", "SELECT m.merchant_id, i.identifier_id, i.kind FROM merchants m LEFT JOIN identifiers i ON i.merchant_id = m.merchant_id AND i.kind = 'commercial_register' AND i.confidence > 0.9")
def _(v: Views) -> DataFrame:
    i = v.identifiers.where("kind = 'commercial_register' and confidence > 0.9")
    return v.merchants.select("merchant_id").join(i, "merchant_id", "left").select("merchant_id", "identifier_id", "kind")


@query("j04_left_outer_counts", "SELECT m.merchant_id, count(e.evidence_id) AS n, count(DISTINCT e.source_id) AS n_sources FROM merchants m LEFT JOIN evidence e ON e.merchant_id = m.merchant_id AND e.independent = 1 AND e.sentiment = 'negative' GROUP BY m.merchant_id")
def _(v: Views) -> DataFrame:
    e = v.evidence.where("independent = 1 and sentiment = 'negative'")
    return v.merchants.join(e, "merchant_id", "left").groupBy("merchant_id").agg(F.count("evidence_id").alias("n"), F.count_distinct("source_id").alias("n_sources"))


@query("j05_latest_state", "SELECT s.source_id, k.status FROM sources s LEFT JOIN (SELECT source_id, arg_max(status, check_id) AS status FROM checks GROUP BY source_id) k USING (source_id)")
def _(v: Views) -> DataFrame:
    latest = v.checks.groupBy("source_id").agg(F.max_by("status", "check_id").alias("status"))
    return v.sources.join(latest, "source_id", "left").select("source_id", "status")


@query("j06_orphans", "SELECT 'check' AS kind, check_id AS id FROM checks WHERE source_id NOT IN (SELECT source_id FROM sources WHERE platform <> 'forum thread') UNION ALL SELECT 'alias', alias_id FROM aliases WHERE merchant_id NOT IN (SELECT merchant_id FROM merchants WHERE state <> 'REQUIRES_MANUAL_REVIEW')")
def _(v: Views) -> DataFrame:
    a = v.checks.join(v.sources.where("platform <> 'forum thread'"), "source_id", "left_anti").select(F.lit("check").alias("kind"), c("check_id").alias("id"))
    b = v.aliases.join(v.merchants.where("state <> 'REQUIRES_MANUAL_REVIEW'"), "merchant_id", "left_anti").select(F.lit("alias").alias("kind"), c("alias_id").alias("id"))
    return a.unionByName(b)


@query("j07_semi", "SELECT merchant_id, name FROM merchants WHERE merchant_id IN (SELECT merchant_id FROM identifiers WHERE kind = 'facebook' AND confidence > 0.8)")
def _(v: Views) -> DataFrame:
    return v.merchants.join(v.identifiers.where("kind = 'facebook' and confidence > 0.8"), "merchant_id", "left_semi").select("merchant_id", "name")


@query("j08_self_join", "SELECT e.evidence_id, r.evidence_id AS root_id, r.source_id AS root_source FROM evidence e JOIN evidence r ON r.evidence_id = e.duplicate_of")
def _(v: Views) -> DataFrame:
    r = v.evidence.select(c("evidence_id").alias("root_id"), c("source_id").alias("root_source"))
    return v.evidence.join(r, c("duplicate_of") == c("root_id")).select("evidence_id", "root_id", "root_source")


@query("j09_theta_residual", "SELECT e.evidence_id, s.source_id FROM evidence e JOIN sources s ON s.source_id = e.source_id AND s.platform <> 'web' AND s.source_id < e.merchant_id")
def _(v: Views) -> DataFrame:
    return v.evidence.join(v.sources, "source_id").where((c("platform") != "web") & (c("source_id") < c("merchant_id"))).select("evidence_id", "source_id")


@query(
    "j10_undirected_edges",
    """SELECT merchant_id, other_id, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, other_id ORDER BY confidence DESC, outgoing DESC, link_id) AS r FROM (
      SELECT left_id AS merchant_id, right_id AS other_id, relation, confidence, 1 AS outgoing, link_id FROM links WHERE left_id <> right_id UNION ALL SELECT right_id, left_id, relation, confidence, 0, link_id FROM links WHERE left_id <> right_id)) WHERE r = 1""",
)
def _(v: Views) -> DataFrame:
    return resolve.related(v.links)


@query("j11_overlay", "SELECT e.evidence_id, coalesce(t.content, e.summary) AS summary FROM evidence e LEFT JOIN translations t ON t.record_id = e.evidence_id AND t.table_name = 'evidence' AND t.field = 'summary' AND t.lang = 'en'")
def _(v: Views) -> DataFrame:
    t = v.translations.where("table_name = 'evidence' and field = 'summary' and lang = 'en'").select(c("record_id").alias("evidence_id"), "content")
    return v.evidence.join(t, "evidence_id", "left").select("evidence_id", F.coalesce("content", "summary").alias("summary"))


@query("j12_nested_bridge", "SELECT merchant_id, claim_type, list_sort(list(evidence_id)) AS evidence_ids FROM evidence GROUP BY merchant_id, claim_type")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id", "claim_type").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))


@query("j13_citations", "SELECT merchant_id, list_sort(list(DISTINCT url)) AS urls FROM evidence JOIN sources USING (source_id) WHERE verified = 1 GROUP BY merchant_id")
def _(v: Views) -> DataFrame:
    cited = v.evidence.where("verified = 1").select("merchant_id", "source_id").distinct()
    return cited.join(v.sources, "source_id").groupBy("merchant_id").agg(F.sort_array(F.collect_set("url")).alias("urls"))


@query(
    "j14_assembly",
    "SELECT m.merchant_id, coalesce(i.n, 0) AS n_identifiers, coalesce(l.n, 0) AS n_links, coalesce(e.n, 0) AS n_evidence FROM merchants m LEFT JOIN (SELECT merchant_id, count(*) AS n FROM identifiers GROUP BY 1) i USING (merchant_id) LEFT JOIN (SELECT left_id AS merchant_id, count(*) AS n FROM links GROUP BY 1) l USING (merchant_id) LEFT JOIN (SELECT merchant_id, count(*) AS n FROM evidence GROUP BY 1) e USING (merchant_id)",
)
def _(v: Views) -> DataFrame:
    n = lambda df, key, name: df.groupBy(c(key).alias("merchant_id")).agg(F.count("*").alias(name))
    parts = [n(v.identifiers, "merchant_id", "n_identifiers"), n(v.links, "left_id", "n_links"), n(v.evidence, "merchant_id", "n_evidence")]
    out = v.merchants.select("merchant_id")
    for part in parts:
        out = out.join(part, "merchant_id", "left")
    return out.na.fill(0)


@query("j15_cross_owner_duplicates", "SELECT e.evidence_id, r.merchant_id AS root_merchant FROM evidence e JOIN evidence r ON r.evidence_id = e.evidence_id - 1 WHERE e.merchant_id <> r.merchant_id AND e.duplicate_of IS NOT NULL")
def _(v: Views) -> DataFrame:
    r = v.evidence.select((c("evidence_id") + 1).alias("evidence_id"), c("merchant_id").alias("root_merchant"))
    return v.evidence.where("duplicate_of is not null").join(r, "evidence_id").where(c("merchant_id") != c("root_merchant")).select("evidence_id", "root_merchant")


@query("j16_shared_identifiers", "WITH o AS (SELECT DISTINCT merchant_id, kind, normalized FROM identifiers) SELECT kind, normalized, merchant_id, min(merchant_id) OVER w AS first, count(*) OVER w AS owners FROM o WINDOW w AS (PARTITION BY kind, normalized) QUALIFY count(*) OVER w > 1")
def _(v: Views) -> DataFrame:
    return resolve.shared(v.identifiers)


@query("j16_collision_links", "WITH o AS (SELECT DISTINCT merchant_id, kind, normalized FROM identifiers) SELECT kind, normalized, f AS left_id, merchant_id AS right_id FROM (SELECT *, min(merchant_id) OVER (PARTITION BY kind, normalized) AS f FROM o) WHERE merchant_id <> f")
def _(v: Views) -> DataFrame:
    return resolve.collisions(v.identifiers)


@query("j16_collision_pairs", "SELECT DISTINCT a.merchant_id AS left_id, b.merchant_id AS right_id, a.kind, a.normalized FROM identifiers a JOIN identifiers b ON a.kind = b.kind AND a.normalized = b.normalized AND a.merchant_id < b.merchant_id WHERE a.kind IN ('phone', 'email')")
def _(v: Views) -> DataFrame:
    """Pairs themselves, for the kinds that identify a person."""
    return resolve.collision_pairs(v.identifiers.where("kind in ('phone', 'email')"))


@query(
    "j17_entity_resolution",
    """WITH hit AS (SELECT q.identifier_id AS cand, count(DISTINCT i.merchant_id) AS owners, min(i.merchant_id) AS owner FROM identifiers q JOIN identifiers i ON i.kind = q.kind AND i.normalized = q.normalized AND i.confidence >= 0.5 WHERE q.confidence < 0.5 AND q.kind <> 'address' GROUP BY 1)
    SELECT q.identifier_id AS candidate_id, CASE WHEN h.owners = 1 THEN h.owner END AS merchant_id, CASE WHEN h.owners = 1 THEN 'identifier' WHEN h.owners > 1 THEN 'new_with_collision' ELSE 'new' END AS how FROM identifiers q LEFT JOIN hit h ON h.cand = q.identifier_id WHERE q.confidence < 0.5""",
)
def _(v: Views) -> DataFrame:
    i = v.identifiers
    candidates = i.where("confidence < 0.5").select(c("identifier_id").alias("candidate_id"), "kind", "normalized", F.lit("").alias("name"), F.lit("").alias("city"))
    return resolve.resolved(candidates, i.where("confidence >= 0.5"), v.merchants).select("candidate_id", "merchant_id", "how")


_MOVED = "CASE WHEN {0} % 10 = 9 THEN {0} - 9 ELSE {0} END"


@query(
    "j18_key_rewrite",
    f"""SELECT left_id, right_id, relation, link_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id, right_id, relation ORDER BY confidence DESC, link_id) AS r FROM (
      SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, relation, confidence, link_id FROM (SELECT {_MOVED.format("left_id")} AS a, {_MOVED.format("right_id")} AS b, relation, confidence, link_id FROM links) WHERE a <> b)) WHERE r = 1""",
)
def _(v: Views) -> DataFrame:
    moved = v.merchants.where("merchant_id % 10 = 9").select(c("merchant_id").alias("old"), (c("merchant_id") - 9).alias("new"))
    return resolve.rewritten_links(v.links, moved).select("left_id", "right_id", "relation", "link_id")


@query("j19_reparenting", f"SELECT 'evidence' AS t, {_MOVED.format('merchant_id')} AS merchant_id, count(*) AS n FROM evidence GROUP BY 2 UNION ALL SELECT 'tasks', {_MOVED.format('merchant_id')}, count(*) FROM tasks GROUP BY 2")
def _(v: Views) -> DataFrame:
    moved = v.merchants.where("merchant_id % 10 = 9").select(c("merchant_id").alias("old"), (c("merchant_id") - 9).alias("new"))
    n = lambda name, df: dml.rewritten_keys(df.select("merchant_id"), moved, "merchant_id").groupBy("merchant_id").agg(F.count("*").alias("n")).withColumn("t", F.lit(name))
    return n("evidence", v.evidence).unionByName(n("tasks", v.tasks))


@query(
    "j20_task_grid",
    "SELECT merchant_id, grp FROM (SELECT m.merchant_id, g.n_name AS grp, row_number() OVER (ORDER BY m.merchant_id, g.n_name) AS r FROM merchants m, nation g WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.merchant_id = m.merchant_id AND t.priority = 'critical' AND t.status = 'in_progress' AND t.cost > 300000)) WHERE r <= 600",
)
def _(v: Views) -> DataFrame:
    groups = v.table("nation").agg(F.array_sort(F.collect_list("n_name")).alias("groups"))
    grid = v.merchants.select("merchant_id").join(F.broadcast(groups)).select("merchant_id", F.explode("groups").alias("grp"))
    done = v.tasks.where("priority = 'critical' and status = 'in_progress' and cost > 300000").select("merchant_id").distinct()
    return grid.join(done, "merchant_id", "left_anti").orderBy("merchant_id", "grp").limit(600)


@query("j21_locale_pages", "SELECT lang, merchant_id FROM merchants, (SELECT unnest(['ar', 'en']) AS lang)")
def _(v: Views) -> DataFrame:
    return v.merchants.select(F.explode(F.array(F.lit("ar"), F.lit("en"))).alias("lang"), "merchant_id")


_WORDS = "(SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part)"
_ASKED = "(SELECT DISTINCT substr(token, 2, 3) AS token FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part) WHERE length(token) >= 4)"


def _words(v: Views) -> DataFrame:
    return v.table("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()


@query("j22_containment", f"SELECT q.token, w.token AS found FROM {_ASKED} q JOIN {_WORDS} w ON contains(w.token, q.token)")
def _(v: Views) -> DataFrame:
    words = _words(v)
    return search.containing(words.where("length(token) >= 4").select(F.substring("token", 2, 3).alias("token")), words)


@query(
    "j23_fuzzy",
    "WITH a AS (SELECT DISTINCT concat('x', substr(token, 2)) AS token FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part)), w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS found FROM part) "
    "SELECT token, found, CAST(levenshtein(token, found) AS INTEGER) AS distance FROM a JOIN w ON length(found) >= 4 AND levenshtein(token, found) BETWEEN 1 AND CASE WHEN length(token) >= 8 THEN 2 ELSE 1 END",
)
def _(v: Views) -> DataFrame:
    words = _words(v)
    return search.typo_matches(words.select(F.concat(F.lit("x"), F.expr("substr(token, 2)")).alias("token")), words)


@query(
    "j24_posting_intersection",
    "WITH p AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part), q AS (SELECT DISTINCT p_brand AS query_id, unnest(string_split(lower(first(p_name ORDER BY p_partkey)), ' ')) AS token FROM part GROUP BY p_brand), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1) "
    "SELECT query_id, p_partkey FROM q JOIN p USING (token) JOIN n USING (query_id) GROUP BY query_id, p_partkey, n HAVING count(DISTINCT token) = n",
)
def _(v: Views) -> DataFrame:
    part = v.table("part")
    held = part.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("token"))
    first = part.groupBy(c("p_brand").alias("query_id")).agg(F.min_by("p_name", "p_partkey").alias("query"))
    return search.having_all(search.query_tokens(first), held, "p_partkey")


@query(
    "j25_brand_family",
    "WITH k AS (SELECT kind, normalized, merchant_id, merchant_id % 12 AS brand FROM identifiers), f AS (SELECT kind, normalized, arg_min(brand, merchant_id) AS first_brand FROM k GROUP BY 1, 2) SELECT kind, normalized, bool_and(brand = first_brand) AS one_family FROM k JOIN f USING (kind, normalized) GROUP BY 1, 2 HAVING count(DISTINCT merchant_id) > 1",
)
def _(v: Views) -> DataFrame:
    keyed = v.identifiers.select("kind", "normalized", "merchant_id", F.array((c("merchant_id") % 12).cast("string")).alias("keys"))
    return resolve.one_family(keyed, ["kind", "normalized"])


@query("j26_stored_vs_computed", "SELECT c_custkey, c_nationkey AS stored, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS computed FROM customer WHERE c_custkey % 7 = 0")
def _(v: Views) -> DataFrame:
    stored = v.table("customer").select("c_custkey", c("c_nationkey").alias("stored"))
    computed = v.table("customer").select("c_custkey", F.when(c("c_custkey") % 7 != 0, c("c_nationkey")).alias("computed"))
    return stored.join(computed, "c_custkey").where(~c("stored").eqNullSafe(c("computed")))


@query("j27_latest_consistency", "SELECT m.merchant_id, m.state, a.internal_state FROM merchants m JOIN (SELECT merchant_id, internal_state FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY round_no DESC, analysis_id DESC) AS r FROM analyses) WHERE r = 1) a USING (merchant_id) WHERE m.state <> a.internal_state")
def _(v: Views) -> DataFrame:
    latest = dml.last_per_key(v.analyses, ["merchant_id"], c("round_no").desc(), c("analysis_id").desc())
    return v.merchants.join(latest, "merchant_id").where(c("state") != c("internal_state")).select("merchant_id", "state", "internal_state")


@query("j28_work_queue", "SELECT evidence_id FROM evidence WHERE evidence_id NOT IN (SELECT record_id FROM translations WHERE lang = 'en')")
def _(v: Views) -> DataFrame:
    done = v.translations.where("lang = 'en'").select(c("record_id").alias("evidence_id"))
    return v.evidence.select("evidence_id").join(done, "evidence_id", "left_anti")


@query("j29_extracted_key", "SELECT source_id, page_id FROM (SELECT source_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS VARCHAR) AS k FROM sources) s JOIN pages p ON s.k = CAST(p.page_id AS VARCHAR)")
def _(v: Views) -> DataFrame:
    s = v.sources.select("source_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("k"))
    return s.join(v.table("pages").select("page_id"), c("k") == c("page_id").cast("string")).select("source_id", "page_id")


