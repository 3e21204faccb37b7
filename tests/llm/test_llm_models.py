"""Operators of tallystone.llm without Spark: exact round trips, brute force, held-out accuracy."""

from __future__ import annotations

import collections
import math
import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import ROOT

from tallystone.llm import blas, bpe, htmltext, licences, lm, media, neardup, quality, texthash, topk, warc
from tallystone.llm.bpe import public_vocabulary


def _strings(texts):
    return texthash.string_buffers(pa.array(texts, pa.string()))


# ---------------------------------------------------------------- hashing and MinHash


def test_words_stop_at_row_borders():
    data, offsets = _strings(["ab", "cd ef", "", "ab"])
    h, starts, ends, rows = texthash.word_hashes(data, offsets)
    assert rows.tolist() == [0, 1, 3, 3, 4]
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"ab"]


def test_long_words_differ():
    data, offsets = _strings(["x" * 5000 + "a", "x" * 5000 + "b", "a" + "x" * 5000])
    h = texthash.word_hashes(data, offsets)[0]
    assert len(set(h.tolist())) == 3


def _bag(text, n=5):
    w = text.split()
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def _weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def _texts(rng, n, words):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_bags_give_weighted_jaccard():
    rng = random.Random(1)
    base = _texts(rng, 300, 40)
    texts = [base, base + " " + base[:400], " ".join(base.split()[30:]), "one two", "one two", "one"]
    data, offsets = _strings(texts)
    words, _, _, rows = texthash.word_hashes(data, offsets)
    cells, at = texthash.shingle_cells(words, rows, 5)
    bags = [np.unique((cells[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert neardup.jaccard(bags[i], bags[j]) == pytest.approx(_weighted(_bag(texts[i]), _bag(texts[j])), abs=1e-9)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    base = [f"t{rng.randrange(10**9)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:360] + ["x"] * 3 + base[360:]), " ".join(base[100:]), " ".join(base * 3), "solo"]
    data, offsets = _strings(texts)
    words, _, _, rows = texthash.word_hashes(data, offsets)
    cells, at = texthash.shingle_cells(words, rows, 5)
    k = 2000
    sketch = neardup.DartMinHash(k).sketch(cells, at)
    for i in range(len(texts)):
        for j in range(i):
            true = _weighted(_bag(texts[i]), _bag(texts[j]))
            assert abs((sketch[i] == sketch[j]).mean() - true) < 4.5 * math.sqrt(max(true * (1 - true), 1e-4) / k) + 1e-9


def test_darts_of_partly_covered_cells():
    cells = texthash.mix64(np.arange(2000, dtype=np.int64).astype(np.uint64))
    both, rows = np.concatenate([cells, cells]), np.array([0, 2000, 4000])
    cover = np.concatenate([np.ones(2000), np.full(2000, 0.5)])
    sketch = neardup.DartMinHash(2000).sketch(both, rows, cover)
    assert abs((sketch[0] == sketch[1]).mean() - 0.5) < 0.06


def test_rows_without_cells_have_no_darts():
    assert not neardup.DartMinHash(8).sketch(np.zeros(0, np.uint64), np.array([0, 0, 0])).any()


# ---------------------------------------------------------------- byte-level BPE


def _tiny():
    ranks = {bytes([b]): b for b in range(256)}
    for i, w in enumerate([b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa"]):
        ranks[w] = 256 + i
    return ranks


def _naive(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_prefix_tables_match_merging():
    rng, ranks = random.Random(3), _tiny()
    voc = bpe.Vocabulary(ranks)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 14)))
        want = _naive(ranks, piece)
        assert voc.encode(piece) == want
        assert bpe.PrefixTable(voc, piece).ids() == want


def test_appends_and_edits_match_encoding_anew():
    rng, voc = random.Random(4), bpe.Vocabulary(_tiny())
    table = bpe.PrefixTable(voc, b"abcdabcaab" * 30)
    for _ in range(60):
        at = rng.randrange(len(table.data) + 1)
        cut, put = rng.randrange(min(4, len(table.data) - at) + 1), bytes(rng.choice(b"abcd") for _ in range(rng.randrange(4)))
        table.edit(at, cut, put)
        table.append(b"ab")
        assert table.ids() == bpe.PrefixTable(voc, table.data).ids()
    assert table.edit(3, 1, b"d") < len(table.data) // 2


def test_public_vocabulary_matches_tiktoken():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    voc = bpe.load(path)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={w: i for i, w in enumerate(voc.token)}, special_tokens={})
    coder, rng = bpe.Encoder(voc, pattern), random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "日本", "🙂", "́", "x" * 70, "12", "***", "'s", "\t", "ß", "<|endoftext|>", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert coder.decode(ids) == text.encode("utf-8")


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


# ---------------------------------------------------------------- media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_media_round_trip(n):
    raw = bytes(range(256)) * (n // 256 + 1)
    payload = media.padded(raw[:n])
    data = media.mux(payload)
    (track,) = media.tracks(data)
    assert len(payload) % 192 == 0 and payload.startswith(raw[:n])
    assert media.sample_bytes(data, track) == payload
    assert track.codec == "raw" and track.handler == "vide"
    assert track.seconds == pytest.approx(len(payload) / 192 / 25)
    assert [data[a : a + b] for a, b in track.keyframes()] == [payload[i : i + 192] for i in range(0, len(payload), 192 * media.SYNC_EVERY)]
    assert media.mux(payload) == data


def test_media_tables_of_other_shapes():
    samples = [b"a" * 5, b"b" * 7, b"c" * 3, b"d" * 9]
    body = samples[0] + samples[1] + b"??" + samples[2] + samples[3]
    import struct

    stbl = media.box(b"stsd", struct.pack(">II", 0, 1), media.box(b"avc1", bytes(78), media.box(b"avcC", b"\x01\x64\x00\x1f\xff")))
    stbl += media.full_box(b"stts", 0, struct.pack(">IIIII", 2, 1, 10, 3, 20)) + media.full_box(b"stss", 0, struct.pack(">III", 2, 1, 3))
    stbl += media.full_box(b"stsc", 0, struct.pack(">IIII", 1, 1, 2, 1)) + media.full_box(b"stsz", 0, struct.pack(">IIIIII", 0, 4, 5, 7, 3, 9))
    stbl += media.full_box(b"stco", 0, struct.pack(">III", 2, 8, 8 + 14))
    mdia = media.full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 1000, 70, 0, 0)) + media.full_box(b"hdlr", 0, bytes(4), b"vide", bytes(13)) + media.box(b"minf", media.box(b"stbl", stbl))
    data = media.box(b"mdat", body) + media.box(b"free", b"xx") + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdia)))
    (track,) = media.tracks(data)
    assert track.codec == "avc1.64001f" and track.seconds == 0.07
    assert track.times.tolist() == [0, 10, 30, 50]
    assert [data[a : a + n] for a, n in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True)] == samples
    assert track.keyframes() == [(8, 5), (22, 3)]


@pytest.mark.parametrize("bad", [b"", b"1234567", b"\0\0\0\x10ftypisom\0\0\0\0", b"\0\0\0\x50moov", b"\0\0\0\x10moov\0\0\0\x40trak"])
def test_bad_media(bad):
    with pytest.raises(media.BadContainer):
        media.tracks(bad)


# ---------------------------------------------------------------- HTML


def test_the_tree_holds_on_pages_it_has_not_seen():
    """Accuracy over blocks of other invented pages, and what the tree looks at."""
    tree = htmltext.trained_tree()
    make = htmltext.Invented(2024)
    for build, least in ((make.plain_page, 0.97), (make.named_page, 0.99)):
        x, y = htmltext.labelled_blocks([build() for _ in range(60)])
        assert ((tree.predict(x) >= 0.5) == y).mean() >= least, build.__name__
    used, todo = set(), [tree.root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            used.add(htmltext.FEATURES[node[0]])
            todo += node[2:]
    assert {"words", "density", "words_before", "words_after", "density_before", "density_after"} <= used


def test_linked_blocks_go_whatever_their_length():
    text = "The river rose by two metres in the night and the road to the town was closed until the morning."
    links = " ".join(f"<a href='/{i}'>Story number {i} of today</a>" for i in range(12))
    teaser = "<h3>More</h3>" + "".join(f"<p><a href='/{i}'>What the mayor said about case {i}</a></p>" for i in range(5))
    page = f"<body><div>{links}</div><h1>High water</h1><p>{text}</p><p>'Nobody is hurt,' he said.</p><p>{text} {text}</p>{teaser}<div>{links}</div></body>"
    assert htmltext.main_text(page) == f"High water\n{text}\n'Nobody is hurt,' he said.\n{text} {text}"


def test_hostile_pages_take_linear_time():
    import time

    page = lambda n: "<div>" * n + "</p>" * n + "<b>" * n + "<dt></dt>" * n + "<button>" * n + "</section>" * n
    took = []
    for n in (2_000, 16_000):
        begin = time.process_time()
        htmltext.blocks(page(n))
        took.append(time.process_time() - begin)
    assert took[1] < 30 * took[0] + 0.5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<nav><a href=/>Home</a></nav>", ""),
        ("<article><h1>T</h1><p>a<br>b &amp; c&lt;<p>\n d \t e <script>var x='</p>';</script></article><footer>f</footer>", "T\na b & c<\nd e"),
        ("<div class='cookie-banner'>We use cookies on this page and all other pages of the site for reasons</div><article><p>x</p></article>", "x"),
        ("<article><p>kept</p><form>Name <input></form><aside>no</aside><div id=comments><p>I liked it</p></div></article>", "kept"),
        ("<main><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>", "one\ntwo\na\nb"),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p><!-- <p>no</p> --></article>", "yes"),
        ("<body class='has-sidebar'><article class='post comments-open'><p>yes</p></article></body>", "yes"),
        ("<article><p>unclosed <b>bold <i>text", "unclosed bold text"),
        ("<article><p>5 < 6</p></article>", "5 < 6"),
        ("<article><style>p{}</style><p>a b</p><textarea>no</textarea></article>", "a b"),
    ],
)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


def test_very_long_page():
    page = "<article>" + "<p>some words of text</p>" * 20000 + "</article>"
    assert htmltext.main_text(page).count("\n") == 19999
    assert htmltext.main_text("<div>" * 5000 + "x" * 10 + "</div>" * 5000) == ""


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>", "<div id='page' class='site with-sidebar'>", "<form action='/all'>"])
def test_articles_inside_of_wrappers(wrapper):
    text = "The river rose by two metres in the night and the road to the town was closed until the morning."
    page = f"<body>{wrapper}<nav><a href='/'>Home</a></nav><article><h1>High water</h1><p>{text}</p></article><aside><article><p>Other news of the day in short.</p></article></aside>"
    assert htmltext.main_text(page) == f"High water\n{text}"
    assert htmltext.main_text(f"<body><article><p>{text}</p></article><section id='comments'><article><p>I saw it from the bridge myself.</p></article></section>") == text


# ---------------------------------------------------------------- licences


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("The new driver got a licence to drive lorries last week.", "none"),
    ],
)
def test_licence_classes(line, want):
    model = licences.trained()
    assert model.classes[int(model.probabilities(line).argmax())] == want


def test_probabilities_are_calibrated_on_held_out_texts():
    """Confidence and share of right answers agree over all texts and where predictions stand; texts are held out whole."""
    model = licences.trained()
    scores, labels = licences.held_out()
    assert licences.TEMPERATURES[0] < model.temperature < licences.TEMPERATURES[-1]
    assert licences.log_loss(scores, labels, model.temperature) <= min(licences.log_loss(scores, labels, t) for t in (0.25, 1.0, 4.0))
    p = licences.softmax(scores, model.temperature)
    right, sure = p.argmax(axis=1) == labels.argmax(axis=1), p.max(axis=1)
    assert abs(right.mean() - sure.mean()) < 0.02 and right.mean() > 0.94
    stands = (sure >= licences.LEAST_PROBABILITY) & (p.argmax(axis=1) < len(licences.NAMES))
    assert abs(right[stands].mean() - sure[stands].mean()) < 0.02
    _, _, _, _, text = licences._table()
    assert len(set(text.tolist())) == len({t for t, _ in licences.training_table()}) == len(scores)


def test_every_notice_of_the_table_has_a_stem():
    for text, kind in licences.training_table():
        assert kind == licences.NONE or any(s in text.lower() for s in licences.STEMS), text


# ---------------------------------------------------------------- WARC


def test_records_parse_back():
    import io

    raw = warc.record_bytes("urn:page:1", "http://a/\r\nX: y", "é€".encode(), None) + warc.record_bytes("urn:page:2", None, "é€".encode(), "urn:page:1")
    got = list(warc.sequential(io.BytesIO(raw), lambda h: True, True))
    assert [h["warc-type"] for h, _ in got] == ["response", "revisit"]
    assert "x" not in got[0][0] and warc.http_payload(got[0][1]) == "é€".encode()
    assert got[1][0]["warc-refers-to"] == "<urn:page:1>" and warc.http_payload(got[1][1]) == b""
    assert got[0][0]["warc-payload-digest"] == got[1][0]["warc-payload-digest"] == "sha1:" + warc.sha1_base32("é€".encode())


def test_unwanted_payloads_are_passed_over():
    import io

    raw = b"".join(warc.record_bytes(f"urn:page:{i}", "u", b"x" * i, None) for i in range(5))
    wanted = lambda h: h["warc-record-id"] == "<urn:page:3>"
    ((headers, block),) = warc.sequential(io.BytesIO(raw), wanted, True)
    assert warc.http_payload(block) == b"xxx"


def test_content_codings():
    import gzip

    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = gzip.compress(b"hello")
    assert warc.http_payload(head + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n") == b"hello"


# ---------------------------------------------------------------- quality


def _labelled(rng, n):
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(3, 200))) + "." for _ in range(n)]
    bad = [" ".join(w.upper() + "!!" if rng.random() < 0.5 else w + "$$$" for w in t.split()) for t in good]
    return [t.encode() for t in good + bad], np.array([1.0] * n + [0.0] * n)


def test_network_learns_and_holds_out():
    texts, labels = _labelled(random.Random(6), 150)
    net = quality.fit(texts, labels, epochs=4)
    unseen, marks = _labelled(random.Random(7), 60)
    data, offsets = quality._joined(unseen)
    assert ((net.score(data, offsets) >= 0.7) == (marks == 1)).mean() > 0.95


def test_scores_cover_the_whole_text_and_not_the_batch():
    texts, labels = _labelled(random.Random(8), 80)
    net = quality.fit(texts, labels, epochs=3)
    rows = [b"", b"x", texts[0] * 40, texts[0] * 40 + texts[-1] * 40, texts[-1]]
    data, offsets = quality._joined(rows)
    together = net.score(data, offsets)
    alone = [float(net.score(*quality._joined([r]))[0]) for r in rows]
    assert np.allclose(together, alone, atol=1e-6)
    assert together[3] < together[2]


def test_chunks_overlap_and_reach_the_end():
    _, at = quality.padded(np.zeros(5000, np.uint8), np.array([0, 0, 100, 5000]))
    index, own = quality.chunk_index(at)
    for r in range(3):
        seen = index[own[r] : own[r + 1]]
        assert set(seen.ravel().tolist()) == set(range(int(at[r]), int(at[r + 1])))
        assert all(set(a) & set(b) for a, b in zip(seen.tolist(), seen.tolist()[1:], strict=False))


def test_scores_match_a_plain_convolution():
    """Every filter at every place by loops, chunks cut from the text itself."""
    texts, labels = _labelled(random.Random(9), 30)
    net = quality.fit(texts, labels, epochs=1)
    for text in (b"", b"a", texts[0][:61], texts[1], (texts[2] * 9)[:1500]):
        lead = bytes(quality.WIDTH - 1) + text
        n = -(-len(lead) // quality.SEGMENT) * quality.SEGMENT
        lead = lead.ljust(n + quality.WIDTH - 1, b"\0")
        at = [sum(net.filters[k, lead[i + k]] for k in range(quality.WIDTH)) for i in range(n)]
        size, step = quality.CHUNK_SEGMENTS * quality.SEGMENT, quality.CHUNK_STEP * quality.SEGMENT
        begins = [0]
        while begins[-1] + size < n:
            begins.append(begins[-1] + step)
        pooled = np.array([np.maximum(np.max(at[b : b + size], axis=0) + net.bias, 0) for b in begins], np.float64)
        z = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ net.weights + net.offset
        assert net.score(*quality._joined([text]))[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


_LONG = """
import sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from tallystone.llm import lm, neardup, quality
from tallystone.llm.bpe import public_vocabulary

rng = np.random.default_rng(1)
words = np.array([("%x" % x)[:7].encode() for x in rng.integers(0, 2**28, 50_000)], object)
text = b" ".join(words[rng.integers(0, len(words), 8_600_000)].tolist())[: 64 << 20].decode()
small = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text[:3000]])], names=["doc_id", "text"])
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
if {which!r} == "near":
    run = lambda b: list(neardup.sketch_batches(iter([b]), 5, 25, 5)) + list(neardup.bag_batches(iter([b]), 5))
elif {which!r} == "quality":
    net = quality.fit([b"good words", b"BAD $$"], np.array([1.0, 0.0]), epochs=1)
    run = lambda b: list(quality.scored_batches(iter([b]), net))
else:
    given = [text[:20_000].encode()] * 12
    model = lm.fit(lm.chosen(given, public_vocabulary()[0]), given, {{}}, 1, steps=2)
    lm.TaskContext = type("T", (), {{"get": staticmethod(lambda: type("C", (), {{"partitionId": lambda self: 0}})())}})
    shared = type("B", (), {{"value": (model, np.array([lm.END_HASH]), np.array([1]), 1)}})
    run = lambda b: list(lm.scored_batches(iter([b]), shared))
run(small)
del words, text
held = lambda name: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(name))
open("/proc/self/clear_refs", "w").write("5")  # the peak starts anew
before = held("VmRSS")
run(batch)
print((held("VmHWM") - before) >> 10)
"""


@pytest.mark.parametrize("which", ["near", "quality", "lm"])
def test_one_text_of_64_megabytes(which):
    """What a worker needs beyond the text itself stays below a gigabyte."""
    code = _LONG.format(root=str(ROOT), which=which)
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={**os.environ, "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
    print(which, said.stdout)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-1]) < 1000


def test_one_label_only():
    net = quality.fit([b"a", b"b"], np.array([1.0, 1.0]))
    assert net.score(*quality._joined([b"", b"zzz"])) == pytest.approx([0.75, 0.75])
    assert quality.fit([], np.zeros(0)).score(*quality._joined([b"x"])) == pytest.approx([0.5])


# ---------------------------------------------------------------- language model


def _network(rng):
    seqs = [rng.integers(0, lm.N_IDS, n) for n in (5, 40, 200)]
    return lm.train(seqs, steps=3), seqs


def test_probabilities_sum_to_one():
    net, seqs = _network(np.random.default_rng(1))
    prefix = seqs[2][:50]
    total = 0.0
    tails = np.arange(lm.N_IDS)
    ids = np.concatenate([np.append(prefix, t) for t in tails])
    lp = lm.log_probabilities(net, ids, np.full(len(tails), 51)).reshape(-1, 51)
    total = np.exp(lp[:, -1]).sum()
    assert total == pytest.approx(1.0, abs=1e-3)


def test_scores_depend_on_the_past_only_and_match_the_definition():
    net, seqs = _network(np.random.default_rng(2))
    s = seqs[2]
    whole = lm.log_probabilities(net, s, np.array([len(s)]))
    cut = lm.log_probabilities(net, s[:120], np.array([120]))
    assert np.allclose(whole[:120], cut, atol=1e-4)
    before = np.append(lm.BEGIN, s[:-1])
    for t in (0, 1, 35, 36, 37, 100, 199):
        begin = max(0, t // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE))
        x = before[begin : t + 1]
        score = net.key[x] @ net.query[before[t]] + net.near[t - np.arange(begin, t + 1)]
        w = np.exp(score - score.max())
        ctx = (w / w.sum()) @ net.value[x]
        z = net.class_of[before[t]] + ctx @ net.class_out
        c, m = divmod(int(s[t]), lm.MEMBERS)
        y = net.member[c] @ (ctx @ net.mix + net.last[before[t]]) + net.member_bias[c]
        want = z[c] - np.log(np.exp(z - z.max()).sum()) - z.max() + y[m] - np.log(np.exp(y - y.max()).sum()) - y.max()
        assert whole[t] == pytest.approx(want, abs=2e-3)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net, seqs = _network(rng)
    for p in net.arrays():
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    ids, lengths = np.concatenate([seqs[1], seqs[0]]), np.array([40, 5])
    net64 = lm.Network(*[a.astype(np.float64) for a in net.arrays()])
    _, grads = lm._gradients(net, ids, lengths)
    for k, (p, g) in enumerate(zip(net64.arrays(), grads, strict=True)):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            flat, old = p.reshape(-1), p.reshape(-1)[i]
            flat[i] = old + 1e-4
            up = -lm.log_probabilities(net64, ids, lengths).mean()
            flat[i] = old - 1e-4
            down = -lm.log_probabilities(net64, ids, lengths).mean()
            flat[i] = old
            assert (up - down) / 2e-4 == pytest.approx(g.ravel()[i], rel=0.05, abs=2e-4), k


def test_steps_work_in_memory_that_is_held():
    """A step after the first takes next to no new memory; that of new arrays costs more than the products."""
    rng = np.random.default_rng(5)
    adam = lm.Adam(_network(rng)[0])
    batch = [rng.integers(0, lm.N_IDS, 3 * lm.STRIDE) for _ in range(lm.PER_STEP)]
    adam.take(batch, 0.001)
    tracemalloc.start()
    adam.take(batch, 0.001)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 << 20


def test_one_pass_scores_and_tells_what_the_share_is_fitted_to(monkeypatch):
    """By plain loops: the ratios' steps of the marked rows, and the scores for the share that comes later."""
    texts = [b"a b a", b"", b"b c C d a", b"zz a"]
    model = lm.fit(lm.chosen(texts * 3, public_vocabulary()[0]), texts * 3, {}, 1, steps=2)
    key = lambda w: int(lm._hashes([w])[0]) if w else lm.END_HASH
    count = {b"a": 40, b"b": 2, b"c": 1, None: 9}  # d and zz aren't known here
    heads = sorted((key(w), n) for w, n in count.items())
    shared = type("B", (), {"value": (model, *np.array(heads).T.copy(), 60)})
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    calls = []
    forward = lm.log_probabilities
    monkeypatch.setattr(lm, "log_probabilities", lambda net, ids, lengths: calls.append(len(ids)) or forward(net, ids, lengths))
    marked = [True, True, False, True]
    for cut in ([texts], [[t] for t in texts]):  # many rows at once, and each alone
        calls.clear()
        out, at = [], 0
        for own in cut:
            batch = pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own))), pa.array([t.decode() for t in own]), pa.array(marked[at : at + len(own)])], names=["doc_id", "text", "fresh"])
            out += lm.scored_batches(iter([batch]), shared)
            at += len(own)
        spelled = [[*lm._split(t), None] for t in texts]
        ids = [[model.number[model.subwords.ids([w])[0]] if w else model.number[[lm.END]] for w in words] for words in spelled]
        assert sum(calls) == sum(len(x) for row in ids for x in row)
        steps, scores = collections.Counter(), []
        for words, own, mark in zip(spelled, ids, marked, strict=True):
            flat = np.concatenate(own)
            lp = np.add.reduceat(forward(model.net, flat, np.array([len(flat)])), np.cumsum([0, *map(len, own)])[:-1])
            scores.append(sum(np.log10(0.3 * count[w] / 60 + 0.7 * np.exp(x)) for w, x in zip(words, lp, strict=True) if w in count))
            for w in set(words) & set(count) if mark else ():
                n, mean = words.count(w), np.mean([x for v, x in zip(words, lp, strict=True) if v == w])
                others = count[w] - n
                steps[int(np.floor((np.log(others / (60 - len(words))) - mean) * lm.RATIO_STEPS)) if others > 0 else lm.NEVER] += n
        rows = [b for b in out if b.column(0).null_count == 0 and b.num_rows]
        got = collections.Counter()
        for b in out:
            for step, n in zip(b.column("step").to_pylist(), b.column("n").to_pylist(), strict=True):
                if step is not None:
                    got[step] += n
        assert sorted(got.elements()) == pytest.approx(sorted(steps.elements()), abs=1)
        mixed = [x for b in lm.mixed_batches(iter(rows), 0.3) for x in b.column("score").to_pylist()]
        assert mixed == pytest.approx(scores, rel=1e-4)


def test_products_run_in_one_thread():
    get = [g for g, _ in blas._controls()]
    before = [g() for g in get]
    with blas.one_thread():
        assert all(g() == 1 for g in get)
    assert [g() for g in get] == before


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    pattern = rng.integers(0, lm.N_IDS, 30)
    seqs = [np.tile(pattern, 8) for _ in range(6)]
    score = lambda net: lm.log_probabilities(net, seqs[0], np.array([240])).mean()
    assert score(lm.train(seqs, steps=60)) > score(lm.train(seqs, steps=1)) + 0.2


# ---------------------------------------------------------------- top-k


def _rows(values):
    n = len(values)
    return topk.Rows(np.arange(n), np.arange(n), np.ones(n, bool), np.array(values, float))


@pytest.mark.parametrize("size", [1.0, 2.0**30, 2.0**300])
def test_products_are_exact_at_every_size(size):
    a = [[3.0, -2.0, 1.0], [5.0 * size, 1.0, -1.0], [size, 3.0, size]]
    search = topk.Search(_rows(a), 3, 2, None)
    search.add(_rows(a))
    search._cut()
    query, _, row, _, score = search.entries[0]
    got = {(int(q), int(r)): int(s) for q, r, s in zip(query, row, score, strict=True)}
    assert got == {(i, j): sum(int(x) * int(y) for x, y in zip(a[i], a[j], strict=True)) for i in range(3) for j in range(3) if i != j}


def test_threshold_keeps_every_answer():
    """Every entry of the answer passes its share in some group, whatever safe cutoff is used; few others do."""
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 60, (300, 16)))
    score = (v @ v[:20].T).astype(np.float32)
    partials = [(v[:, p] @ v[:20, p].T).astype(np.float32) for p in topk._groups(16, topk.PARTS)]
    best = np.argsort(-score, axis=0, kind="stable")[:5]
    for at in (4, 50):
        cutoff = -np.sort(-score, axis=0)[at].astype(float)
        row, column = topk.reaching(partials, score, cutoff)
        kept = set(zip(row.tolist(), column.tolist(), strict=True))
        assert {(int(r), q) for q in range(20) for r in best[:, q]} <= kept and len(kept) <= 20 * (at + 1)


def test_local_lists_hold_each_groups_best():
    rng = np.random.default_rng(6)
    partials = [rng.integers(-99, 99, (50, 7)).astype(np.float32) for _ in range(3)]
    listed = set(zip(*(x.tolist() for x in topk.local_lists(partials, 4)), strict=True))
    for p in partials:
        for q in range(7):
            assert {r for r in range(50) if p[r, q] > np.sort(p[:, q])[-5]} <= {r for r, c in listed if c == q}
