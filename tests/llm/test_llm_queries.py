"""Queries and operators of tallystone.llm on Spark: SQL, brute force, and edge cases of every operator."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from conftest import DATA, duck_rows, rows
from pyspark.sql import functions as F

from tallystone.llm import bpe, graph, htmltext, licences, lm, media, mixing, neardup, quality, queries, topk, warc
from tallystone.llm.scratch import Scratch

SQL = queries.oracle_sql()
#: Names that operators use inside; as extra columns of the input they must not get in the way.
CLASH = "k1 k2 bands sig head bucket class_id comp score held_out n_tokens copies epochs rest budget domain row uid part payload ids url lines low found licence html vec v qb".split()


def _docs(spark, given, extra=True):
    """(doc_id, text, lang, source) rows with clashing columns."""
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in given], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if extra else df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert rows(df, columns) == duck_rows(duck, SQL[name], columns)


# ---------------------------------------------------------------- 1


def _classes(texts: dict, least=0.8):
    def bag(t):
        w = re.findall(r"\w+", (t or "").lower())
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    bags = {i: bag(t) for i, t in texts.items()}
    held = collections.defaultdict(set)
    for i, b in bags.items():
        for s in b:
            held[s].add(i)
    above = {i: i for i in texts}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in texts:
        for j in {j for s in bags[i] for j in held[s] if j < i} | {j for j in texts if j < i and not bags[i] and not bags[j] and (texts[i] or "") == (texts[j] or "")}:
            if not bags[i] or sum((bags[i] & bags[j]).values()) >= least * sum((bags[i] | bags[j]).values()):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}


def test_near_duplicates_match_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.queries()["op1_dart_near_dedup"](spark, DATA).collect()}
    assert got == _classes(texts)


def test_chained_copies_and_blocks(spark, monkeypatch):
    """Copies of copies, in groups larger than a block of the exact comparison."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    given = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        given.append((i, " ".join(words), "s"))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(_docs(spark, given)).collect()}
    assert got == _classes({i: t for i, t, _ in given})


def test_near_duplicate_edges(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    given = [(1, None, "s"), (2, "", "s"), (3, "!!! ???", "s"), (4, "!!! ???", "s"), (5, "one two", "s"), (6, "One, TWO!", "s"), (7, "one", "s"), (8, long, "s"), (9, long + " end", "s"), (5, "one two", "s"), (None, "one two", "s")]
    got = sorted(neardup.near_duplicates(_docs(spark, given)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["class_id"]) for r in got] == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (9, 8), (None, None)]
    assert neardup.near_duplicates(_docs(spark, given).where("false")).count() == 0
    kept = neardup.keep_representatives(_docs(spark, given))
    assert kept.columns == _docs(spark, given).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 5, 7, 8]


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (3, 7)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


class _Counted(Scratch):
    """Remembers the names of what is saved."""

    def save(self, df, name):
        self.saved = [*getattr(self, "saved", []), name]
        return super().save(df, name)


@pytest.mark.parametrize("mixed", [False, True])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, mixed):
    order = list(range(10_001))
    if mixed:
        random.Random(5).shuffle(order)
    pairs = list(zip(order, order[1:], strict=False))
    scratch = _Counted(spark, "path")
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"), scratch, "t").collect()
    assert len(got) == 10_001 and {r["comp"] for r in got} == {0}
    assert sum(n.startswith("t-hooks") for n in scratch.saved) <= 20


def test_components_match_a_search_on_random_graphs(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)]
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"), "t").collect()}
    assert got == want


# ---------------------------------------------------------------- 2


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>a</p></article>"), (3, "u", "<article><p>a</p></article>"), (None, "u", "<p")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]
    assert htmltext.extract_pages(df.where("false")).count() == 0


def test_articles_of_all_pages(spark):
    import html as H

    for r in queries.queries()["op2_html_main_text"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.sub(r"<b>|</b>|<br>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = [" ".join(H.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in want if x)


# ---------------------------------------------------------------- 3


def test_stored_texts(spark, documents):
    got = {r["doc_id"]: r for r in media.store_texts(documents).collect()}
    for r in documents.collect():
        raw = r["text"].encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_media_edges(spark):
    got = media.store_texts(_docs(spark, [(1, None, "s"), (2, "", "s"), (2, "", "s"), (3, "é" * 100000, "s")]), with_media=True)
    rows_ = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 4 and rows_[1]["media_sha256"] == rows_[2]["media_sha256"] and rows_[1]["payload_bytes"] == 192
    columns = media.media_columns(got.unionByName(got.withColumn("media", F.lit(b"junk"))), "media", id_col="doc_id").collect()
    assert {r["codec"] for r in columns} == {"raw", None} and all((r["error"] is None) == (r["codec"] is not None) for r in columns)
    assert media.store_texts(_docs(spark, []).where("false")).count() == 0


# ---------------------------------------------------------------- 4


def test_base_scores(spark, documents):
    df = lm.score_documents(documents, steps=20).collect()
    lower = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
    words = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", lower(r["text"])) for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in [*ws, "END"])
    n, v = sum(count.values()), len(count)
    for r in df:
        own = [*words[r["doc_id"]], "END"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0


def test_counts_that_no_worker_holds(spark, documents):
    """The join for rare words gives what holding all words gives."""
    some = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm.score_documents(documents, steps=1, sample_docs=20, head_words=50).collect()}
    all_ = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm.score_documents(documents, steps=1, sample_docs=20).collect()}
    assert some.keys() == all_.keys() and all(some[i][0] == all_[i][0] and some[i][1] == pytest.approx(all_[i][1]) for i in some)


def test_counts_that_no_worker_holds_reach_the_score(spark, documents):
    some, all_ = ({r["doc_id"]: r["score"] for r in lm.score_documents(documents, steps=2, sample_docs=40, head_words=h).collect()} for h in (50, lm.HEAD_WORDS))
    assert some.keys() == all_.keys() and all(some[i] == pytest.approx(all_[i]) for i in some)


def test_the_network_starts_from_all_training_texts(spark, documents, monkeypatch):
    import numpy as np

    seen = []
    fit = lm.fit

    def spy(model, texts, *rest, started, **named):
        seen.append((len(texts), model, started))
        return fit(model, texts, *rest, started=started, **named)

    monkeypatch.setattr(lm, "fit", spy)
    lm.score_documents(documents, steps=1, sample_docs=20)
    ((n, model, got),) = seen
    whole = [r for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    lists = [model.number[np.array([i for w in lm._split(r["text"].encode()) for i in model.subwords.ids([w])[0].tolist()] + [lm.END])] for r in whole]
    assert n < len(whole) / 2 and (got == sum(lm.id_counts(s, np.array([len(s)])) for s in lists)).all()


def test_scores_match_their_definition(spark, documents, monkeypatch):
    """Each id's probability by plain loops over its window, each word's as the mixture."""
    import numpy as np

    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: kept.append(fit(*a, **k)) or kept[0])
    some = documents.where("doc_id < 40")
    got = {r["doc_id"]: r for r in lm.score_documents(some, steps=30, sample_docs=10, train_every=2).collect()}
    (model,) = kept
    net = model.net
    words = {r["doc_id"]: lm._split(r["text"].encode()) for r in some.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total = sum(count.values())
    for i in sorted(words, key=lambda i: len(words[i]))[:6]:
        spelled = [model.number[model.subwords.ids([w])[0]].tolist() for w in words[i]] + [[model.number[lm.END]]]
        s = np.array([x for w in spelled for x in w])
        before = np.append(lm.BEGIN, s[:-1])
        lp = []
        for t in range(len(s)):
            x = before[max(0, t // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE)) : t + 1]
            w = np.exp(net.key[x] @ net.query[before[t]] + net.near[np.arange(len(x))[::-1]])
            ctx = (w / w.sum()) @ net.value[x]
            z = np.exp(net.class_of[before[t]] + ctx @ net.class_out)
            c, m = divmod(int(s[t]), lm.MEMBERS)
            y = np.exp(net.member[c] @ (ctx @ net.mix + net.last[before[t]]) + net.member_bias[c])
            lp.append(math.log(z[c] / z.sum() * y[m] / y.sum()))
        at, want = 0, 0.0
        for w, ids in zip([*words[i], None], spelled, strict=True):
            want += math.log10(model.share * count[w] / total + (1 - model.share) * math.exp(sum(lp[at : at + len(ids)])))
            at += len(ids)
        assert got[i]["score"] == pytest.approx(want, rel=1e-3)


def test_all_is_learned_from_all_training_texts(spark, documents, monkeypatch):
    """The ids, the texts that train the network and the words that fit the share are those of all training texts."""
    import numpy as np

    kept = []
    fit, share = lm.fit, lm.fitted_share

    def spy(model, texts, *rest, refine, **named):
        def seen(model):
            kept.append(model.net.copy())
            kept.append(refine(model))
            return kept[-1]

        kept.extend([model, len(texts)])
        return fit(model, texts, *rest, refine=seen, **named)

    monkeypatch.setattr(lm, "fit", spy)
    monkeypatch.setattr(lm, "fitted_share", lambda old, steps: kept.append(steps) or share(old, steps))
    lm.score_documents(documents.coalesce(1), steps=1, sample_docs=20, head_words=50)
    model, n, before, after, steps = kept
    learned = [r["text"].encode() for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    want = lm.chosen(learned, model.subwords.path)
    assert n < len(learned) / 2 and model.subwords.chosen == want.subwords.chosen and (model.number == want.number).all()
    # all but nine tenths of the driver's texts
    words = sum(len(lm._split(t)) + 1 for t in learned)
    assert words * 0.5 < sum(steps.values()) < words
    # one task trains on all pieces
    lists = [model.number[model.subwords.ids(lm._split(t))[0]] for t in learned]
    pieces = sum(-(-(len(x) + 1) // (3 * lm.STRIDE)) for x in lists)
    trained = before.copy()
    with lm.one_thread():
        assert lm.refined(trained, (np.append(x, model.number[lm.END]) for x in lists)) == pieces
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(trained.arrays(), after.arrays(), strict=True))


def test_share_of_given_ratios():
    assert lm.fitted_share(0.5, {}) == 0.5
    assert lm.fitted_share(0.5, {lm.NEVER: 10}) == 0.01 and lm.fitted_share(0.5, {lm.MOST_STEPS: 10}) == 0.99
    assert lm.fitted_share(0.5, {lm.NEVER: 50, lm.MOST_STEPS: 50}) == pytest.approx(0.5, abs=0.01)


def test_weights_of_tasks_are_averaged(spark, documents, monkeypatch):
    """The weights that the driver gets are the mean of the tasks', by their pieces."""
    import numpy as np

    kept = []
    fit = lm.fit

    def spy(*a, refine, **k):
        def seen(model):
            kept.append((model, model.net.copy(), refine(model)))
            return kept[0][2]

        return fit(*a, refine=seen, **k)

    monkeypatch.setattr(lm, "fit", spy)
    lm.score_documents(documents.repartition(3), steps=5, sample_docs=10, train_every=3)
    ((model, before, after),) = kept
    change = max(float(np.abs(a - b).max()) for a, b in zip(before.arrays(), after.arrays(), strict=True))
    assert 0 < change < 1
    # one task alone: what it gives is its own weights
    batch = documents.where("doc_id < 30").select("text").toArrow().combine_chunks().to_batches()
    sums = list(lm.summed_batches(lm.refined_batches(iter(batch), type("B", (), {"value": model}))))
    own = np.concatenate([np.frombuffer(x) for x in sums[0].column(2).to_pylist()]) / sums[0].column(1)[0].as_py()
    assert len(own) == sum(p.size for p in before.arrays()) and np.isfinite(own).all()


def test_many_rows_without_an_id_are_sampled_like_others(spark):
    texts = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    got = lm.score_documents(texts, steps=2, sample_docs=10).collect()
    assert len(got) == 400 and all(r["train_tokens"] == 1600 and r["score"] < 0 for r in got)


def test_lm_edges(spark):
    given = [(1, None, "s"), (2, "", "s"), (3, "A b  c\x0b\n", "s"), (3, "A b  c\x0b\n", "s"), (None, "日本 🙂", "s"), (4, "word " * 50000, "s")]
    got = lm.score_documents(_docs(spark, given), steps=3).collect()
    assert len(got) == 6 and {r["doc_id"]: r["n_tokens"] for r in got} == {1: 1, 2: 1, 3: 4, None: 3, 4: 50001}
    assert lm.score_documents(_docs(spark, given).where("false"), steps=1).count() == 0
    held = [(i, "x y", "s") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in lm.score_documents(_docs(spark, held), steps=1).collect())


# ---------------------------------------------------------------- 5


def test_licences_match_the_model(spark, documents):
    model = licences.trained()
    shapes = licences.templates()
    for r in licences.licences(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        found = []
        for line in r["text"].split("\n"):
            if any(s in line.lower() for s in licences.STEMS):
                p = model.probabilities(line)
                kind, words = model.classes[int(p.argmax())], licences.tokens(line)
                own = set(words) | set(licences.pairs(words))
                match = max((len(own & set(t)) / len(t) for t in shapes.get(kind, [])), default=0.0)
                if kind not in (licences.NONE, licences.UNKNOWN) and not (p.max() >= licences.LEAST_PROBABILITY and match >= licences.LEAST_MATCH):
                    kind = licences.UNKNOWN
                if kind != licences.NONE:
                    found.append((float(p.max()), kind))
        assert r["families"] == ",".join(sorted({k for _, k in found})) and r["n_notices"] == len(found)


def test_licence_edges(spark):
    given = [(1, None, "s"), (2, "", "s"), (3, "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "s"), (3, "", "s"), (4, ("word " * 50 + "\n") * 3000 + "Licensed under the house rules.", "s"), (5, "Ungte mit lizenz mit licen", "s"), (None, "SPDX-License-Identifier: MPL-2.0", "s")]
    got = licences.licences(_docs(spark, given)).collect()
    assert len(got) == 7
    by = {(r["doc_id"], r["licence"]): r for r in got}
    assert by[(3, "mit")]["families"] == "cc-by-nc-4.0,mit" if (3, "mit") in by else by[(3, "cc-by-nc-4.0")]["families"] == "cc-by-nc-4.0,mit"
    assert (4, "unknown") in by and (1, "none") in by and (None, "mpl-2.0") in by and not by[(1, "none")]["confirmed"]
    assert "Python" not in licences.licences(_docs(spark, given))._jdf.queryExecution().executedPlan().toString()
    assert licences.licences(_docs(spark, given).where("false")).count() == 0


def test_wrapped_licences_and_bare_names(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    isc = "Permission\nto use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
    given = [mit, gpl, bsd, isc, "Some words.\n\n" + mit + "\n\nMore.", "Distributed under MPL-2.0", "Available under CC0 1.0", "BSD-3-Clause", "Distributed under MIT"]
    want = ["mit", "gpl-3.0", "bsd-3-clause", "isc", "mit", "mpl-2.0", "cc0-1.0", "bsd-3-clause", "mit"]
    prose = ["He read at the MIT and came back\nwith a friend.", "Der Hund geht mit dem Mann.", "They came without restriction\nand left.", "The 3 clause rule, see version 2.0"]
    got = {r["doc_id"]: (r["licence"], r["families"], r["n_notices"]) for r in licences.licences(_docs(spark, [(i, t, "s") for i, t in enumerate(given + prose)])).collect()}
    assert [got[i] for i in range(len(want))] == [(w, w, 1) for w in want]
    assert [got[i][0] for i in range(len(want), len(got))] == ["none"] * len(prose)


# ---------------------------------------------------------------- 6


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(5, "u", "x"), (3, "v", "x"), (7, None, None), (1, "u", ""), (9, "http://a/\r\nb", "é" * 3000), (3, "v", "x"), (None, "u", "x")], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect())
    assert got == [(0, 1, "revisit", 3), (1, 0, "response", None), (3, 1, "response", None), (3, 1, "response", None), (5, 1, "revisit", 3), (7, 0, "revisit", 1), (9, 6000, "response", None)]
    assert warc.archive_pages(df, min_bytes=1).where("page_id = 7 and record_type = 'response'").count() == 1
    assert warc.archive_pages(df.where("false")).count() == 0


def test_archive_source_pushes_predicates_and_reads_foreign_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    warc.write_pages(pages.repartition(3), str(tmp_path / "a"))
    all_ = spark.read.format("warc").option("path", str(tmp_path / "a")).option("splitBytes", 500)
    assert all_.load().rdd.getNumPartitions() > 5
    some = all_.load().where("record_type = 'response' and target_uri like 'http://h1%'")
    assert some.count() == 13 and {r["payload"].decode()[:4] for r in some.collect()} >= {"<p>1", "<p>4"}
    reader = warc.WarcReader({"path": str(tmp_path / "a")})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 0
    raw = b"".join(warc.record_bytes(f"urn:page:{i}", "u", b"z" * i, None) for i in range(9))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "plain.warc").write_bytes(raw)
    (tmp_path / "b" / "whole.warc.gz").write_bytes(gzip.compress(raw))
    found = spark.read.format("warc").option("path", str(tmp_path / "b")).load()
    assert found.count() == 18 and found.where("payload_bytes = 8").count() == 2


# ---------------------------------------------------------------- 7


def _fill(children, budget):
    """Shares of (name, weight, cap) by repeated dealing, in exact numbers; for comparison within one token."""
    share, open_ = {}, {n: (w, c) for n, w, c in children if w and c}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= budget * w]
        if not full:
            share |= {n: budget * w / total for n, (w, _) in open_.items()}
            break
        for n in full:
            share[n] = open_[n][1]
        budget -= sum(open_.pop(n)[1] for n in full)
    return share


def test_budgets_match_repeated_dealing(spark):
    rng, targets = random.Random(9), mixing.Targets(max_epochs=2, percent=70)
    sizes = [(d, g, f"src{s}", rng.randrange(0, 3000)) for d in ("web", "forum", "other") for g in ("en", "de", "xx") for s in range(4)]
    got = {r[:3]: r for r in map(tuple, mixing.leaf_budgets(spark.createDataFrame(sizes, "domain string, lang string, source string, tokens long"), targets).collect())}
    w = lambda m, n: m.get(n, m["*"])
    cap = lambda *key: sum(2 * t for *k, t in sizes if tuple(k[: len(key)]) == key)
    total = sum(t for *_, t in sizes) * 70 // 100
    for d, b in _fill([(d, w(targets.domains, d), cap(d)) for d in ("web", "forum", "other")], total).items():
        for g, bb in _fill([(g, w(targets.langs, g), cap(d, g)) for g in ("en", "de", "xx")], b).items():
            for s, bbb in _fill([(f"src{s}", w(targets.sources, f"src{s}"), cap(d, g, f"src{s}")) for s in range(4)], bb).items():
                assert abs(got[(d, g, s)][4] - bbb) <= 8


def test_mixture_edges(spark):
    given = [(1, None, "src0"), (2, "", "src0"), (3, "a b c", "src1"), (3, "a b c", "src1"), (4, "x " * 30000, None), (None, "q r", "src2"), (5, "a b", "odd name 77777777777")]
    df = _docs(spark, given)
    got = mixing.mixed(df).collect()
    assert len(got) == 7 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert len({r["copies"] for r in got if r["doc_id"] == 3}) == 1
    kept = mixing.keep_mixed(df)
    assert kept.columns == df.columns and kept.count() <= 7
    assert mixing.mixed(df.where("false")).count() == 0 and mixing.keep_mixed(df.where("false")).count() == 0


def test_domains_are_a_parameter(spark, documents):
    own = mixing.mixed(documents, domain=lambda s: F.when(s == "src1", "reference"))
    assert {r["domain"] for r in own.where("source = 'src1'").select("domain").collect()} <= {"reference"}
    assert {r["domain"] for r in own.where("source <> 'src1'").select("domain").distinct().collect()} == {""}


def test_kept_rows_match_the_copies(spark, documents):
    targets = mixing.Targets(max_epochs=3)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(documents, targets).collect()}
    kept = collections.Counter(r["doc_id"] for r in mixing.keep_mixed(documents, targets).collect())
    assert {i: n for i, n in copies.items() if n} == dict(kept)


# ---------------------------------------------------------------- 8


def test_quality_edges(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    given = [(1, None, "s"), (2, "", "s"), (3, "Plain words here.", "s"), (3, "Plain words here.", "s"), (4, "é" * 60000, "s"), (None, "x", "s")]
    docs = documents.select("doc_id", "text").unionByName(_docs(spark, given).select("doc_id", "text"))
    got = quality.quality_scores(docs, labels, sample=100)
    assert got.count() == docs.count() and got.where("not score between 0 and 1 or predicted <> int(score >= 0.7)").count() == 0
    none = quality.quality_scores(_docs(spark, given), labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    kept = quality.keep_good(_docs(spark, given).drop("score"), labels.where("false"))
    assert kept.count() == 0 and "lang" in kept.columns


def test_quality_ignores_other_columns(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clash = [*CLASH, "quality", "toxic", "h", "n", "predicted", "lang"]
    plain_, wide = (quality.quality_scores(d, labels, sample=60) for d in (documents.select("doc_id", "text"), documents.select("doc_id", "text", *[F.lit("clash").alias(c) for c in clash])))
    assert rows(plain_) == rows(wide)


def test_quality_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(1, 60)] + [(3, "a"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    texts, marks = quality.labelled_sample(docs, labels, 1000, fit_bytes=800)
    assert 0 < sum(map(len, texts)) <= 800 and len(texts) == len(marks) and b"b" not in texts
    whole, _ = quality.labelled_sample(docs, labels, 1000)
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 60))


def test_quality_holds_out(spark, documents):
    texts, _ = quality.labelled_sample(documents, spark.read.parquet(f"{DATA}/labels.parquet"), 10**6)
    allowed = {r["text"].encode() for r in documents.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert set(texts) <= allowed


# ---------------------------------------------------------------- 9


def test_encoded_documents(spark, documents):
    import base64

    import numpy as np
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in bpe.encode_documents(documents, with_ids=True).collect():
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encoding_edges(spark):
    given = [(1, None, "s"), (2, "", "s"), (3, "a" * 20000 + " b", "s"), (3, "z", "s"), (None, "<|endoftext|>", "s")]
    got = bpe.encode_documents(_docs(spark, given)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and all(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == empty for r in got if r["doc_id"] in (1, 2))
    assert bpe.encode_documents(_docs(spark, given).where("false")).count() == 0


# ---------------------------------------------------------------- 10


def _brute(vectors, k, every):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    out = {}
    for q in whole:
        if q % every == 0:
            score = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q))[:k]
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(score)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e9, 1e12])
def test_top_k_matches_brute_force(spark, scale):
    rng = random.Random(3)
    vectors = {i: [rng.choice([-1.0, 0.5, 0.25, -0.003, 0.7]) * scale for _ in range(6)] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df.repartition(3), round_bytes=60, cutoff_every=4).collect()}
    want = _brute(vectors, 5, 50)
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == {k: (i, clamp(s)) for k, (i, s) in want.items()}


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    given = [(0, [1.0, 2.0]), (50, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [1.0, None]), (4, []), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "score", "rank", "qb")})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(df).collect())
    assert got == [(0, 1, 5, 327680), (0, 2, 6, 327680), (0, 3, 6, 327680), (0, 4, None, 196608)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [1.0, 0.0]), (7, [3.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(twice, k=2).collect())
    assert got == [(0, 1, 0, 0), (0, 1, 7, 196608), (0, 1, 7, 196608), (0, 2, 0, 0), (0, 2, 0, 65536), (0, 2, 0, 65536)]
    assert topk.exact_top_k(df.where("false")).count() == 0 and topk.exact_top_k(df.where("vec_id = 0")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, documents):
    """Each stage against its operator on what the stage before kept."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == documents.columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    scored = {r["doc_id"] for r in quality.quality_scores(documents, labels).where("predicted = 1").collect()}
    assert set(kept[0]) == scored and 0 < len(scored) < documents.count()
    assert set(kept[1]) == set(_classes(kept[0]).values())
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(spark.createDataFrame([(i,) for i in kept[1]], "doc_id long").join(documents, "doc_id"), corpus_pipeline.TARGETS).collect()}
    assert set(kept[2]) == {i for i, n in taken.items() if n}
    last = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in last.collect()} == set(kept[2])
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4
