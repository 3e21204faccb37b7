"""Operators on small frames with known results, and properties that must hold."""

from __future__ import annotations

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallystone.operators import assess, audit, components, contracts, dedupe, dml, numbering, ranking, resolve, search
from tallystone.plans import registry
from tallystone.sources import exports
from tallystone.streaming import incremental as S


def test_url_keeper(spark):
    df = spark.createDataFrame([(1, 7, "u", 1, 0.70, "2024-01-01"), (2, 7, "u", 1, 0.95, "2024-01-02"), (3, 7, "u", 1, 0.80, "2024-01-03"), (4, 7, "", 1, 0.1, "x"), (5, 7, "", 1, 0.2, "x")], "evidence_id long, merchant_id long, url string, independent int, confidence double, captured_at string")
    got = {r["evidence_id"]: (r["root"], r["kept"]) for r in dedupe.keepers_by_url(df).collect()}
    assert got == {1: (2, 0), 2: (None, 1), 3: (2, 0), 4: (None, 1), 5: (None, 1)}


def test_components_close_over_both_keys(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "y"), (3, 1, "b", "y"), (4, 1, "b", "z"), (5, 1, "c", "w"), (6, 2, "a", "x")], "id long, m long, k1 string, k2 string")
    got = {r["id"]: r["component"] for r in dedupe.content_components(df, "m", ["k1", "k2"], "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_long_chain_of_keys(spark):
    n = 12
    df = spark.createDataFrame([(i, 1, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(n)], "id long, m long, k1 string, k2 string")
    assert {r["component"] for r in dedupe.content_components(df, "m", ["k1", "k2"], "id").collect()} == {0}


def test_pointer_chase(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 5), (8, 99), (9, 8), (10, 10)], "id long, parent long")
    got = {r["id"]: (r["root"], r["problem"]) for r in dedupe.chased(df, "id", "parent").collect()}
    assert got[4] == (1, None) and got[1] == (1, None)
    assert got[5][1] == got[6][1] == got[7][1] == got[10][1] == "cycle"
    assert got[8][1] == got[9][1] == "missing"


def test_flattened_forest_is_stable(spark):
    df = spark.createDataFrame([(i, i - 1 if i % 9 else None) for i in range(40)], "id long, parent long")
    flat = dedupe.chased(df, "id", "parent").select("id", F.when(F.col("root") != F.col("id"), F.col("root")).alias("parent"))
    again = dedupe.chased(flat, "id", "parent").select("id", F.when(F.col("root") != F.col("id"), F.col("root")).alias("parent"))
    assert flat.exceptAll(again).count() == 0


def test_rows_are_conserved_by_rooting(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, None, "b"), (2, 1, 1, 1, None, "a"), (3, 1, 1, 0, 1, "a")], "id long, m long, component long, independent int, duplicate_of long, captured_at string")
    got = {r["id"]: (r["new_duplicate_of"], r["new_independent"]) for r in dedupe.rooted(df, "m", "id").collect()}
    assert got == {1: (2, 0), 2: (None, 1), 3: (2, 0)}


def test_conditional_upsert_keeps_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([("k", 0.5, 1, "a"), ("k", 0.5, 2, "b"), ("j", 0.1, 3, "c"), ("j", 0.9, 4, "d")], "key string, score double, seq long, v string")
    assert {(r["key"], r["v"]) for r in dml.keep_best(df, ["key"], "score", "seq", ["v"]).collect()} == {("k", "a"), ("j", "d")}


def test_upsert_twice_is_once(spark):
    held = spark.createDataFrame([(1, 1, "a")], "key long, seq long, v string")
    new = spark.createDataFrame([(1, 2, "b"), (2, 3, "c")], "key long, seq long, v string")
    first = dml.upsert(held, new, ["key"], "seq")
    assert dml.upsert(first, new, ["key"], "seq").exceptAll(first).count() == 0


def test_fill_only_never_overwrites(spark):
    held = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id long, v string")
    new = spark.createDataFrame([(1, "n"), (2, "n"), (4, "n")], "id long, v string")
    assert {(r["id"], r["v"]) for r in dml.fill_only(held, new, ["id"], ["v"]).collect()} == {(1, "x"), (2, "n"), (3, None), (4, "n")}


def test_shared_phone_resolution(spark):
    identifiers = spark.createDataFrame([("phone", "+1", 1), ("phone", "+1", 2), ("email", "a@b", 3), ("address", "s", 4)], "kind string, normalized string, merchant_id long")
    merchants = spark.createDataFrame([(1, "One", "Giza"), (5, "Five Store", "Cairo")], "merchant_id long, name string, city string")
    candidates = spark.createDataFrame([(10, "phone", "+1", "", ""), (11, "email", "a@b", "", ""), (12, "address", "s", "", ""), (13, "phone", "+9", "five", "cairo")], "candidate_id long, kind string, normalized string, name string, city string")
    got = {r["candidate_id"]: (r["merchant_id"], r["how"]) for r in resolve.resolved(candidates, identifiers, merchants).collect()}
    assert got == {10: (None, "new_with_collision"), 11: (3, "identifier"), 12: (None, "new"), 13: (5, "name")}


@pytest.fixture(scope="module")
def index(spark):
    merchants = spark.createDataFrame(
        [(1, "Blue Widget House", "Home goods", 0.5), (2, "Blue Widgets", "", 0.9), (3, "Red Rocket", "Toys", 0.1), (4, "Electronica", "Audio gear", 0.3), (5, "بي تك", "", 0.2), (6, "Red Rocket Giza", "Toys", 0.4), (7, "Solo", "", 0.4)],
        "merchant_id long, name string, category string, confidence double",
    )
    aliases = spark.createDataFrame([(3, "Rocket Red"), (6, "Red Rocket"), (4, "متجر الكترونيكا"), (7, "A B")], "merchant_id long, alias string")
    identifiers = spark.createDataFrame(
        [(4, "phone", "+201012345678"), (2, "whatsapp", "+201012345678"), (1, "website", "https://shop.example/a"), (3, "website", "http://www.rockets.example"), (6, "website", "https://rockets.example/giza"), (1, "website", "https://mixed.example"), (4, "website", "https://mixed.example/x")]
        + [(2, "facebook", "https://facebook.com/Blue.Widgets.Shop"), (5, "address", "12 Nile Street"), (7, "commercial_register", "CR 4711"), (5, "website", "https://support.apple.com/ht1"), (5, "email", "info@bt.example"), (5, "marketplace", "https://play.google.com/")],
        "merchant_id long, kind string, normalized string",
    )
    claims = spark.createDataFrame([(1, "refund issue"), (3, " ")], "merchant_id long, summary string")
    evidence = spark.createDataFrame([(2, "The parcel came late", "very late indeed"), (7, "", "")], "merchant_id long, summary string, quoted_excerpt string")
    sources = spark.createDataFrame([(4, "https://news.example/story", "Morning herald")], "merchant_id long, url string, label string")
    return search.build_index(merchants, identifiers, aliases, claims, evidence, sources).stored()


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Blue Widget House", [(1, "exact_name")]),
        ("rocket red", [(3, "exact_alias"), (6, "partial_name")]),
        ("RED rocket", [(3, "exact_name"), (6, "exact_alias")]),
        ("blue", [(2, "partial_name"), (1, "partial_name")]),
        ("Red Rockat", [(6, "typo"), (3, "typo")]),
        ("Rad Rocket", []),  # short words aren't mended
        ("elektronica", [(4, "typo")]),
        ("الكترونيكا متجر", [(4, "partial_name")]),
        ("وبي تك", [(5, "normalized_variant")]),
        ("010 1234 5678", [(2, "whatsapp"), (4, "phone")]),
        ("+1 212 555 0100", []),
        ("https://www.shop.example/a/?utm_source=x", [(1, "website")]),
        ("shop.example/", [(1, "website")]),
        ("https://rockets.example", [(6, "website-host"), (3, "website-host")]),
        ("https://mixed.example/", []),  # owners of no common name
        ("https://mixed.example/x", [(4, "website")]),
        ("support.apple.com/ht1", []),
        ("https://m.facebook.com/blue.widgets.shop/?ref=1", [(2, "facebook")]),
        ("https://play.google.com/", []),
        ("INFO@bt.example", [(5, "email")]),
        ("12, nile street", [(5, "address")]),
        ("nile", [(5, "address")]),
        ("cr 4711", [(7, "commercial_register")]),
        ("audio", [(4, "category")]),
        ("refund issue", [(1, "claim")]),
        ("parcel late", [(2, "evidence")]),
        ("herald morn", [(4, "source")]),
        ("widgets.shop", [(2, "partial_name")]),
        ("a b", [(7, "exact_alias")]),
        ("b a", [(7, "partial_name")]),
        ("no such name", []),
        ("", []),
        ("!!!", []),
    ],
)
def test_search(spark, index, query, want):
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    assert [(r["merchant_id"], r["matched_on"]) for r in search.search(asked, index).orderBy("rank").collect()] == want


def test_labels_and_quality(spark, index):
    asked = spark.createDataFrame([("q", "blue hous"), ("r", "red rocket")], "query_id string, query string")
    got = {(r["query_id"], r["merchant_id"]): r for r in search.search(asked, index, "en").collect()}
    hit = got["q", 1]
    assert (search.TIERS[hit["tier"]], hit["matched_value"], hit["label"], hit["fuzzy"], hit["extra"]) == ("partial_name", "Blue Widget House", "Partial name match", 1, 1)
    assert not hit["ambiguous"] and not got["r", 3]["ambiguous"]
    assert search.search(asked, index).first()["label"] in {pair[0] for pair in search.LABELS.values()}


def test_ambiguous(spark, index):
    asked = spark.createDataFrame([("q", "blue"), ("r", "red rocket"), ("s", "010 1234 5678")], "query_id string, query string")
    got = {r["query_id"]: r["ambiguous"] for r in search.search(asked, index).where("rank = 1").collect()}
    assert got == {"q": True, "r": False, "s": True}


def test_invalid_phones_are_told(spark):
    asked = spark.createDataFrame([(1, "+1 212 555 0100"), (2, "01012345678"), (3, "shop")], "query_id long, query string")
    assert {r["query_id"]: r["diagnostic"] for r in search.classified(asked).collect()} == {1: "invalid_egyptian_phone", 2: None, 3: None}


def test_search_matches_plain_loops(spark, index):
    """Partial and mended hits of made-up queries against loops over all candidates."""
    import itertools
    import random

    held = [r.asDict() for r in index.candidates.collect()]
    rng = random.Random(8)
    words = sorted({t for r in held for t in r["tokens"]})
    queries = {i: " ".join(rng.choice([w, w[1:] or w, w[: len(w) // 2 + 1], w[:-2] + "x" + w[-1:]]) for w in rng.sample(words, rng.choice([1, 1, 2, 3]))) for i in range(120)}
    asked = spark.createDataFrame([(i, list(dict.fromkeys(q.split()))) for i, q in queries.items()], "query_id long, asked array<string>").where("size(asked) > 0")

    def steps(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = list(itertools.accumulate(zip(row, row[1:], b, strict=False), lambda left, z, x=x: min(left + 1, z[1] + 1, z[0] + (x != z[2])), initial=i + 1))
        return row[-1]

    parts, typos = set(), set()
    owned = {(t, r["merchant_id"]) for r in held for t in r["tokens"]}
    for r in asked.collect():
        q = list(r["asked"])
        for h in held:
            if all(any(t in x for x in h["tokens"]) for t in q) and all(len(t) > 1 or (t, h["merchant_id"]) in owned for t in q):
                parts.add((r["query_id"], h["merchant_id"], h["display"], len([t for t in q if t not in h["tokens"]])))
            missed = [t for t in q if t not in h["tokens"]]
            if h["kind"] == "name" and 1 <= len(missed) <= (2 if len(q) >= 3 else 1):
                best = [min([steps(t, x) for x in h["tokens"] if len(x) >= 4] or [9]) for t in missed]
                if all(b <= (2 if len(t) >= 8 else 1) for b, t in zip(best, missed, strict=True)):
                    typos.add((r["query_id"], h["merchant_id"], h["display"], sum(best)))
    assert {(r["query_id"], r["merchant_id"], r["matched_value"], r["fuzzy"]) for r in search.by_part(asked, index).collect()} == parts
    assert {(r["query_id"], r["merchant_id"], r["matched_value"], r["distance"]) for r in search.by_typo(asked, index).collect()} == typos
    assert parts and typos


def test_search_work_follows_the_batch(spark, monkeypatch):
    """Names that share a word, each asked for with an error in it, and many queries of one text: each text is looked
    up once, and names that hold its rare token are looked at, not all that hold a word like the wrong one."""
    n = 300
    name = F.format_string("Market %09d", "id")
    merchants = spark.range(n).select(F.col("id").alias("merchant_id"), name.alias("name"), F.lit("").alias("category"), F.lit(0.5).alias("confidence"))
    identifiers = spark.range(n).select(F.col("id").alias("merchant_id"), F.lit("phone").alias("kind"), F.lit("+201012345678").alias("normalized"))
    none = lambda names: spark.createDataFrame([], ", ".join(f"{x} {'long' if x == 'merchant_id' else 'string'}" for x in names.split()))
    index = search.build_index(merchants, identifiers, none("merchant_id alias"), none("merchant_id summary"), none("merchant_id summary quoted_excerpt"), none("merchant_id url label")).stored()
    wrong = spark.range(n).select(F.concat(F.lit("n"), "id").alias("query_id"), F.format_string("Markt %09d", "id").alias("query"))
    asked = wrong.unionByName(spark.range(n).select(F.concat(F.lit("p"), "id").alias("query_id"), F.lit("010 1234 5678").alias("query")))
    tables, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    got = search.search(asked, index).where("rank <= 2").collect()
    assert {(r["query_id"], r["merchant_id"]) for r in got if r["matched_on"] == "typo"} == {(f"n{i}", i) for i in range(n)}
    assert {(r["query_id"], r["merchant_id"]) for r in got if r["matched_on"] == "phone"} == {(f"p{i}", m) for i in range(n) for m in (0, 1)}
    assert tables[0].count() == n + 1
    text = wrong.select("query_id", F.split(F.lower("query"), " ").alias("asked"))
    assert search.typo_starts(text, index).count() == n


@pytest.mark.parametrize("parts", [1, 3])
def test_numbers_over_a_whole_table(spark, parts):
    """Places are those of one sort, nulls and descending orders among them, with several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 13).alias("v")).repartition(parts)
    got = {r["id"]: r["place"] for r in numbering.numbered(df, "place", F.col("v").desc_nulls_last(), "id").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(range(500), key=lambda i: (i % 7 == 0, -(i % 13) if i % 7 else 0, i))
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, 501))


def test_packing(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([9, 7, 6, 5, 5, 4, 4, 3, 3, 2])], "k long, n long")
    # longest first isn't optimal: 12 each would be possible
    loads = {r["bin"]: r["s"] for r in ranking.packed(df, "k", "n", 4).groupBy("bin").agg(F.sum("n").alias("s")).collect()}
    assert sorted(loads.values()) == [11, 12, 12, 13]


def test_manifest_mismatch_fails(spark):
    t = {"a": spark.range(3).toDF("x")}
    wrong = exports.counted(t).withColumn("n", F.col("n") + 1)
    with pytest.raises(Exception, match="manifest differs"):
        exports.verified(wrong, t).collect()


def test_dry_run_writes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exports, "cut", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    assert exports.maybe_apply(spark.range(2).toDF("x"), apply=False).count() == 2


def test_query_validation(spark):
    given = [("x" * 161, None, None), ("x" * 160, "0", None), ("a", "1e3", None), ("a", "9007199254740992", None), ("a", "9007199254740991", "both"), ("a\x7f", "0", "x"), (None, None, None), ("  A  b ", "2", "positive")]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, q string, p string, v string")
    got = df.select("i", search.query_problem(F.col("q"), F.col("p"), F.col("v")).alias("wrong"), search.cleaned_query(F.col("q")).alias("q")).orderBy("i").collect()
    assert [r["wrong"] for r in got] == ["query", "page", "page", "page", "view", "query", None, None]
    assert (got[6]["q"], got[7]["q"]) == ("", "a b")


@pytest.mark.parametrize("mixed", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, mixed):
    """A chain of 10,000 links in any order of ids: few tables are written."""
    import random

    written = []
    keep = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or keep(df))
    order = list(range(10_001))
    if mixed:
        random.Random(4).shuffle(order)
    found = components.connected(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")).collect()
    assert len(found) == 10_001 and {r["component"] for r in found} == {0}
    assert len(written) <= 1 + 4 * 20


def test_null_keys_link_nothing(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, None, "y"), (1, 3, "k", "y"), (2, 4, "k", "x")], "g long, id long, one string, two string")
    got = {r["id"]: r["component"] for r in dedupe.content_components(rows, "g", ["one", "two"], "id").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize(
    ("shown", "state", "relation", "want"),
    [
        ([("phone", "+201012345678"), ("whatsapp", "+201012345678")], "MIXED_REPUTATION", "branch_of", "supported"),
        ([("phone", "+201012345678"), ("facebook", "https://facebook.com/shop")], "MIXED_REPUTATION", "branch_of", "established"),
        ([("phone", "+201012345678"), ("facebook", "https://facebook.com/shop")], "IDENTITY_UNCERTAIN", "branch_of", "uncertain"),
        ([("phone", "+201012345678"), ("facebook", "https://facebook.com/shop")], "MIXED_REPUTATION", "name_identifier_conflict", "uncertain"),
        ([("marketplace", "https://m.example/a"), ("address", "1 Main Street")], "MIXED_REPUTATION", "branch_of", "supported"),
        ([("google_maps", "https://goo.gl/maps/a"), ("address", "1 Main Street")], "MIXED_REPUTATION", "branch_of", "uncertain"),
        ([("website", "https://support.apple.com/x"), ("phone", "+12025550100")], "MIXED_REPUTATION", "branch_of", "uncertain"),
        ([("commercial_register", "77"), ("website", "https://shop.example")], "MIXED_REPUTATION", "branch_of", "established"),
    ],
)
def test_identity(spark, shown, state, relation, want):
    merchants = spark.createDataFrame([(1, state)], "merchant_id long, state string")
    identifiers = spark.createDataFrame([(1, *s) for s in shown], "merchant_id long, kind string, normalized string")
    links = spark.createDataFrame([(1, 2, relation)], "left_id long, right_id long, relation string")
    assert assess.identity(merchants, identifiers, links).first()["identity"] == want


_EVENTS = [(1, 1, "assigned"), (1, 2, "failed"), (2, 1, "assigned"), (2, 2, "finished"), (2, 3, "failed"), (3, 1, "assigned"), *[(4, i, e) for i, e in enumerate(["assigned", "failed"] * 3)], (5, 9, "released")]
_STATES = {1: ("pending", 1), 2: ("done", 1), 3: ("in_progress", 1), 4: ("unresolved", 3), 5: ("pending", 0)}


def test_replayed_tasks(spark):
    events = spark.createDataFrame(_EVENTS, "task_id long, seq long, event string")
    assert {r["task_id"]: (r["status"], r["attempts"]) for r in S.replayed_tasks(events).collect()} == _STATES


def test_task_machine_over_batches(spark, tmp_path):
    """Events of a task are spread over files, one of which comes twice."""
    schema = "task_id long, seq long, event string"
    for n in (0, 1, 2, 1):
        part = [e for e in _EVENTS if (e[1] // 2) % 3 == n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = S.drained(S.task_machine(S.file_stream(spark, str(tmp_path), spark.createDataFrame([], schema).schema)), "update", ["task_id"])
    assert {r["task_id"]: (r["status"], r["attempts"]) for r in got.collect()} == _STATES


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    for day in ("2024-01-01 10:05", "2024-01-01 12:00", "2024-01-01 12:01", "2024-01-01 10:06", "2024-01-01 13:30"):
        spark.sql(f"select timestamp'{day}' as ts, 'x' as event_type").write.mode("append").parquet(str(tmp_path))
    stream = S.file_stream(spark, str(tmp_path), spark.createDataFrame([], schema).schema)
    got = S.drained(S.windowed_counts(stream, "1 hour", "10 minutes")).collect()
    # the window from ten o'clock was closed before its second row came
    assert {(str(r["start"])[11:16], r["n"]) for r in got} == {("10:00", 1), ("12:00", 2)}


def test_sessions(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00"), ("a", "2024-01-01 10:20"), ("a", "2024-01-01 11:00"), ("b", "2024-01-01 10:00")]
    spark.createDataFrame(rows, "user string, t string").selectExpr("user", "cast(t as timestamp) as ts").write.parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = S.drained(S.sessions(stream, "user", "30 minutes", "1 day"), "complete").collect()
    assert sorted((r["user"], str(r["start"])[11:16], r["n"]) for r in got) == [("a", "10:00", 2), ("a", "11:00", 1), ("b", "10:00", 1)]


def test_rounds_resume_behind_finished_steps(spark, tmp_path):
    first = S.Rounds(spark, str(tmp_path))
    first.step("a", lambda: spark.range(3))
    with pytest.raises(ZeroDivisionError):
        first.step("b", lambda: spark.range(1 // 0))
    again = S.Rounds(spark, str(tmp_path))
    assert again.step("a", lambda: spark.range(99)).count() == 3 and again.step("b", lambda: spark.range(5)).count() == 5
    assert (first.ran, again.ran) == (["a"], ["b"])


def test_copies_within_a_time(spark, tmp_path):
    for n in range(2):
        spark.sql(f"select timestamp'2024-01-01 10:0{n}' as ts, 7 as k").write.mode("append").parquet(str(tmp_path))
    stream = S.file_stream(spark, str(tmp_path), spark.read.parquet(str(tmp_path)).schema)
    assert S.drained(S.first_seen(stream, ["k"], within="1 hour")).count() == 1


# ---------------------------------------------------------------- merges and audits


@pytest.fixture(scope="module")
def data(spark):
    make = spark.createDataFrame
    return {
        "merchants": make([(1, "One", 0.5), (2, "One Shop", 0.9), (3, "Three", 0.1)], "merchant_id long, name string, identity_confidence double"),
        "aliases": make([(2, "uno")], "merchant_id long, normalized_alias string"),
        "links": make([(10, 1, 2, "branch_of", 0.5), (11, 2, 3, "same_owner", 0.4), (12, 1, 3, "same_owner", 0.7)], "link_id long, left_id long, right_id long, relation string, confidence double"),
        "identifiers": make([(1, 1, "phone", "+1"), (2, 2, "phone", "+1")], "identifier_id long, merchant_id long, kind string, normalized string"),
        "claims": make([(100, 1, "refund_issue"), (200, 2, "refund_issue"), (300, 3, "other")], "claim_id long, merchant_id long, claim_type string"),
        "evidence": make([(1, 1, 5, 100, None), (2, 2, 5, 200, 1), (3, 2, 6, 200, 2), (4, 3, 7, 300, None)], "evidence_id long, merchant_id long, source_id long, claim_id long, duplicate_of long"),
        "claim_evidence": make([(100, 1), (200, 2), (200, 3), (300, 4)], "claim_id long, evidence_id long"),
        "sources": make([(5,), (6,), (7,), (8,)], "source_id long"),
    }


def test_reviewed_merge(spark, data):
    mapping = spark.createDataFrame([(2, 1)], "old long, new long")
    assert {r["n"] for r in resolve.reviewed_merge(data, mapping).collect()} == {0}
    after = resolve.merge_tables(data, mapping)
    assert sorted(map(tuple, after["evidence"].collect())) == [(1, 1, 5, 100, None), (2, 1, 5, 100, 1), (3, 1, 6, 100, 1), (4, 3, 7, 300, None)]
    assert [(r["left_id"], r["right_id"], r["link_id"]) for r in after["links"].collect()] == [(1, 3, 12)]
    held = {r["table_name"]: r["n"] for r in resolve.reviewed_merge(data, mapping, apply=True).collect()}
    assert held == {"merchants": 2, "aliases": 2, "links": 1, "identifiers": 1, "claims": 2, "evidence": 4, "claim_evidence": 4, "sources": 4}


@pytest.mark.parametrize(("pairs", "why"), [([(9, 1)], "missing"), ([(2, 1), (2, 3)], "repeated"), ([(2, 1), (1, 3)], "target retired")])
def test_merge_fails_closed(spark, data, monkeypatch, pairs, why):
    monkeypatch.setattr(resolve, "published", lambda *a: pytest.fail("published"))
    with pytest.raises(resolve.MergeRefused, match=why):
        resolve.reviewed_merge(data, spark.createDataFrame(pairs, "old long, new long"), apply=True)


def test_merge_with_a_failed_postcondition_publishes_nothing(spark, data, monkeypatch):
    monkeypatch.setattr(resolve, "published", lambda *a: pytest.fail("published"))
    broken = data | {"evidence": data["evidence"].withColumn("claim_id", F.when(F.col("evidence_id") != 4, F.col("claim_id")))}
    with pytest.raises(resolve.MergeRefused, match="evidence lacks a claim: 1"):
        resolve.reviewed_merge(broken, spark.createDataFrame([(2, 1)], "old long, new long"), apply=True)


def test_targeted_batches_are_all_or_nothing(spark):
    stored = spark.createDataFrame([(1, 0.4, 3), (2, 0.6, None)], "id long, confidence double, round_no int")
    asked = spark.createDataFrame([("1",), ("2",)], "id string")
    results = lambda *ids: spark.createDataFrame([(i, 0.9) for i in ids], "id string, confidence double")
    got = contracts.targeted_batch(stored, asked, results(" 1", "2"), "id", {"confidence": "confidence"})
    assert sorted((r["id"], r["confidence"], r["round_no"]) for r in got.collect()) == [("1", 0.4, 4), ("2", 0.6, 1)]
    for ids, why in ((("1",), "2: missing"), (("1", "2", "1 "), "1: repeated"), (("1", "2", "3"), "3: not asked for"), (("1", "2", "pending"), "pending: blank")):
        with pytest.raises(contracts.BatchRefused, match=why):
            contracts.targeted_batch(stored, asked, results(*ids), "id", {"confidence": "confidence"})


def test_audit_finds_planted_faults(spark, data):
    flawed = {k: df for k, df in data.items() if k != "aliases"} | {"claims": data["claims"].where("claim_id <> 300"), "evidence": data["evidence"].withColumn("source_id", F.when(F.col("evidence_id") == 1, 99).otherwise(F.col("source_id")))}
    found = {r["check_name"]: (r["n"], r["samples"]) for r in audit.audited(audit.reference_violations(flawed)).collect()}
    assert found == {"evidence.source_id without sources": (1, "1"), "evidence.claim_id without claims": (1, "4"), "claim_evidence.claim_id without claims": (1, "4")}


def test_stream_replay_is_idempotent(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), spark.range(1).schema)
    twice = stream.union(S.file_stream(spark, str(tmp_path / "in"), spark.range(1).schema))
    assert S.drained(S.first_seen(twice, ["id"])).count() == 20


# ---------------------------------------------------------------- whole texts


def test_whole_texts_are_scrubbed(spark):
    """Against the documents themselves: the last word of a text is there, and no handle or number is left in any."""
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null and length(text) > 400").select("doc_id", "text")
    got = registry.queries()["f25_scrub"](spark, DATA).join(texts, "doc_id").collect()
    assert got
    for r in got:
        assert "01012345678" not in r["scrubbed"] and "@some_user" not in r["scrubbed"]
        assert len(r["scrubbed"]) > len(r["text"]) / 2, r["doc_id"]


def test_pointer_to_no_row_at_any_size(spark, duck, tmp_path):
    """The duplicate chains of dq06 where there are more than a thousand rows."""
    spark.range(1200).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["dq06_duplicate_chains"](spark, str(tmp_path)).collect()
    sql = registry.oracle_sql()["dq06_duplicate_chains"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted((r["id"], r["problem"]) for r in got) == sorted(duck.sql(sql).fetchall())
    assert {r["problem"] for r in got} == {"cycle", "missing"}
