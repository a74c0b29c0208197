import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import media, packing, segment, toxicity
from skyledger.llm.quality import FEATURES, PairGam, fit_quality, score_quality, text_features
from skyledger.llm.scratch import Scratch
from skyledger.llm.sharding import rendezvous_shard, shard_records
from skyledger.llm.topk import top_k, whole_components
from skyledger.llm.urls import judge_urls, link_edges, parse_rule

TEXTS = ["Hello, World! it's 3 pm", None, "", "ÀÉ straße\n\ttabs  and   blanks", "word " * 5000, "a" * 3000, "Σίσυφος 漢字", "same", "same"]


def docs(spark, texts=TEXTS, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, shard int, length long")


def spark_hash(key, shard):
    seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest()


def test_sharding(spark):
    rows = shard_records(docs(spark, ["t"] * 500 + TEXTS, [*range(500), *range(600, 607), 600, None]), Scratch(spark, "t"), [1.0] * 24).collect()
    assert len(rows) == 509
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            best = lambda n: min(range(n), key=lambda i: (-1 / -math.log(((spark_hash(r.doc_id, i) >> 11) + 0.5) * 2.0**-53), i))  # noqa: E731, B023
            assert (r.shard, r.grown_shard) == (best(24), best(25))
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_records(docs(spark, []), Scratch(spark, "t"), [1.0, 2.0]).count() == 0
    heavy = spark.range(4000).select(rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs(dict(map(tuple, heavy))[1] - 3000) < 150


def test_media(spark):
    mulaw, alaw = media.MULAW_PCM, media.ALAW_PCM
    assert (mulaw[0], mulaw[0x80], mulaw[0xFF], mulaw[0x7F]) == (-32124, 32124, 0, 0) and (alaw[0xD5], alaw[0x55], alaw[0xAA], alaw[0x2A]) == (8, -8, 32256, -32256)
    block = struct.pack("<hBB", 100, 10, 0) + bytes([0x17, 0x8F])
    value, index, out = 100, 10, [100]
    for nibble in (7, 1, 15, 8):
        step = int(media.STEPS[index])
        move = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
        value += -move if nibble & 8 else move
        index = min(88, max(0, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
        out.append(value)
    assert media.decode_ima(block * 3, 6).tolist() == out * 3
    assert media.resample(np.array([0, 10, 20], np.int16), 8, 16).tolist() == [0, 5, 10, 15, 20, 20]
    rows = {r.doc_id: r for r in media.store_texts(docs(spark), with_media=True).collect()}
    for i, t in enumerate(TEXTS):
        n, body = media.payload(t)
        assert len(body) % 64 == 0 and len(body) and body[:n] == (t or "").encode()
        assert (rows[i].n_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (n, hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert media.from_wav(rows[i].media)[3] == body and media.from_wav(rows[i].pcm)[0] == media.PCM
    assert rows[7][1:] == rows[8][1:]
    stored = spark.createDataFrame([(1, bytearray(rows[0].media)), (2, None), (3, bytearray(b"junk"))], "k int, media binary")
    assert [r.pcm is not None for r in media.store_pcm(stored).orderBy("k").collect()] == [True, False, False]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs(spark), Scratch(spark, "t"), path, capacity=256).collect()
    whole = {}
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(s, min(256, len(ids) - s)) for s in range(0, len(ids), 256)]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs(spark, []), Scratch(spark, "t"), path).count() == 0
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum(4095, rng.lognormal(6.5, 1, 5000)).astype(int).clip(1).tolist())
    planned = packing.plan(histogram, 4096)
    used = Counter()
    for lengths, times in planned:
        assert sum(lengths) <= 4096
        for n in lengths:
            used[n] += times
    assert used == histogram and sum(t for _, t in planned) <= 1.01 * sum(n * c for n, c in histogram.items()) / 4096 + 1


def test_word_encoder():
    """Against the tokenizer itself: every character up to 0x250 alone and within words, special tokens, and random mixtures."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    chars = [chr(c) for c in [*range(1, 0x250), 0, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x0301, 0x4E00, 0x1F600]]
    rng = np.random.default_rng(3)
    parts = [*chars, "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "Don't", "IT'S", "he'LL", "x1", "99", "e\u0301", "I\u0307", "\u0130", "word", "THE", " ", "\n", "  "]
    texts = [f"a{c}B" for c in chars] + chars + ["".join(rng.choice(parts, 12)) for _ in range(4000)]
    for t, got in zip(texts, packing.encode_texts(texts, path)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_segmentation(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = segment.sample_segmentations(docs(spark, [*TEXTS[:4], "漢 Ω  two", "abc" * 100]), path, k=3).collect()
    again = segment.sample_segmentations(docs(spark, [*TEXTS[:4], "漢 Ω  two", "abc" * 100]).repartition(3), path, k=3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(r.round_trip and 0 < r.inclusion <= 1 for r in rows)
    assert len({(r.doc_id, r.ids) for r in rows}) == len(rows) and all(r.n_pieces == 0 for r in rows if r.doc_id in (1, 2))
    lat = segment.pieces(path, 1.0)
    all_ = segment.sample_text("the", lat, 1000, 3)
    assert abs(sum(math.exp(x[1]) for x in all_) - 1) < 1e-9 and [x[2] for x in all_] == sorted((x[2] for x in all_), reverse=True)
    first = Counter(segment.sample_text("the", lat, 1, s * 2**40 + 7)[0][0] for s in range(3000))
    chance = {ids: math.exp(logp) for ids, logp, _ in all_}
    assert all(abs(first[ids] / 3000 - p) < 0.04 for ids, p in chance.items())
    # the second draw, given the first: without replacement
    pairs = Counter(tuple(x[0] for x in segment.sample_text("the", lat, 2, s * 2**40 + 11)) for s in range(3000))
    assert all(abs(n / 3000 - chance[a] * chance[b] / (1 - chance[a])) < 0.04 for (a, b), n in pairs.items())
    # ids, pieces and probabilities by a plain enumeration of the lattice
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rank = {}
    for i in range(sp.vocab_size()):
        if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i)):
            rank[sp.id_to_piece(i)] = (i, len(rank))

    def ways(rest):
        return [((), 0.0)] if not rest else [((rank[rest[:n]][0], *ids), w - math.log(rank[rest[:n]][1] + 2)) for n in range(1, len(rest) + 1) if rest[:n] in rank for ids, w in ways(rest[n:])]

    plain = {struct.pack(f"<{len(ids)}I", *ids): w for ids, w in ways("\u2581the")}
    total = math.log(sum(map(math.exp, plain.values())))
    assert plain.keys() == chance.keys() and all(abs(math.exp(w - total) - chance[ids]) < 1e-12 for ids, w in plain.items())
    edge = segment.sample_segmentations(docs(spark, ["one two", "one two", None], [None, None, None]), path).collect()
    assert len(edge) == 5 and len({(r.rank, r.ids) for r in edge}) == 3 and all(r.doc_id is None for r in edge)
    assert segment.sample_segmentations(docs(spark, []), path).count() == 0


def best_rows(vectors, scale=256, k=5, asks=lambda i: i % 5 == 0):
    """(query, rank, key, score), by Python's integers; every row but the query's own is a candidate."""
    clean = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            clean.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for at, (q, asked) in enumerate(clean):
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(asked, v)), i) for n, (i, v) in enumerate(clean) if n != at)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    from skyledger.llm import topk

    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (None, [1.0])]
    vectors += [(5, [0.25] * 16), (5, [0.25] * 16), (410, [-0.001, 1e-300]), (415, [1e308] * 16)]
    huge = [(0, [3e6, -1.0]), (5, [3e6, 2.0]), (6, [-3e6, 0.5]), (7, [2.0**70, 1.0]), (8, [1e12, 1e12]), (10, [1e200, -1.0]), (11, [1e199]), (12, [-1e200])]
    for some in (vectors, huge, vectors[:3], []):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").select("vec_id", whole_components(F.col("embedding")).alias("v"))
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, Scratch(spark, "t"), 5).collect())) == best_rows(some)


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.Example.com/en/1#x", '<link rel="canonical" href="http://mirror.test/p">'), (2, "http://mirror.test/p", None), (3, "http://example.com/en/77", None), (4, "https://b.net/de/1", ""),
            (5, "x.org/es/", None), (6, None, None), (7, "http://example.net/de/8", '<META http-equiv=refresh content="0;url=/fr/9">'), (8, "http://example.net/fr/9", None), (9, "http://com/en/", None), (10, "http:///es/", None), (11, "http://notorg/es/?a", None), (12, "http://o.org/es/", None),
        ],
        "page_id long, url string, html string",
    )
    rules = [parse_rule(*r) for r in [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]]
    got = {r.page_id: (r._rule, r._verdict) for r in judge_urls(pages, Scratch(spark, "t"), rules, link_edges(pages)).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: ("example.com/en/7", "allow"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.net/de/8", "block"), 8: (None, "block"), 9: ("com/en/", "block"), 10: (None, "allow"), 11: (None, "allow"), 12: ("org/es/", "block")}


def test_link_edges(spark):
    base = "http://A.test/d/e/p.html"
    cases = {"x.html": "a.test/d/e/x.html", "./x": "a.test/d/e/x", "../x?q#f": "a.test/d/x?q", "../../../x": "a.test/x", "/r": "a.test/r", "?p=1": "a.test/d/e/p.html?p=1", "//b.test/z": "b.test/z", "HTTPS://B.test/Y": "b.test/Y", "..": "a.test/d/", ".": "a.test/d/e/", "mailto:me@x": None, "#top": None, "p.html": None}
    for target, want in cases.items():
        pages = spark.createDataFrame([(1, base, f"<p><LINK rel='canonical' href='{target}'></p>")], "page_id long, url string, html string")
        assert [(r.u, r.v) for r in link_edges(pages).collect()] == ([("a.test/d/e/p.html", want)] if want else []), target
    two = '<link href="/a" rel=canonical><link rel=canonical href="/b"><meta http-equiv="refresh" content="3; url=/c">'
    rows = [(1, base, two), (1, base, two), (2, None, two), (3, "nothing", two), (4, base, None), (5, base, "canonical refresh")]
    assert {r.v for r in link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"a.test/a", "a.test/b", "a.test/c"}


def test_urls_edge_cases(spark):
    rules = [parse_rule("block", "bad.test/"), parse_rule("allow", "good.test/")]
    link = '<link rel=canonical href="%s">'
    rows = [(1, "http://x.test/1", link % "http://bad.test/1", "k"), (1, "http://x.test/1", link % "http://bad.test/1", "k"), (2, "http://y.test/", link % "http://x.test/1", None), (3, "http://good.test/", link % "http://y.test/", "n"), (None, None, None, None), (5, "http://z.test/", "x" * 200_000, "")]
    schema = "page_id long, url string, html string, _host string"
    pages = spark.createDataFrame(rows, schema).withColumn("node", F.lit(7)).withColumn("said", F.lit("?")).withColumn("own", F.lit(1))
    for some, want in ((pages, [(1, "allow"), (1, "allow"), (2, "allow"), (3, "allow"), (5, "allow"), (None, "allow")]), (pages.where("page_id <> 3"), [(1, "block"), (1, "block"), (2, "block"), (5, "allow")])):
        got = judge_urls(some, Scratch(spark, "t"), rules, link_edges(some))
        assert got.columns == ["page_id", "url", "html", "node", "said", "own", "_host", "_path", "_rule", "_verdict"]
        assert sorted(((r.page_id, r._verdict) for r in got.collect()), key=str) == want and {(r.node, r.said, r.own) for r in got.collect()} == {(7, "?", 1)}
    assert judge_urls(pages.limit(0), Scratch(spark, "t"), rules, link_edges(pages.limit(0))).count() == 0


def test_toxicity(spark):
    good, bad = ["the weather is fine and calm today number%d" % i for i in range(120)], ["the weather is fine you idiot today number%d" % i for i in range(60)]
    texts = good + bad + ["what an id1ot", "an i d i o t indeed", None, "", "an idiiiiot here", "calm"]
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(180)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    s = Scratch(spark, "t")
    model = toxicity.fit_toxicity(docs(spark, texts), labels, s)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, texts), model).collect()}
    assert all(got[i] < 0.5 for i in [*range(120), 182, 183, 185]) and all(got[i] >= 0.5 for i in [*range(120, 182), 184])
    clash = toxicity.score_toxicity(docs(spark, texts).withColumn("score", F.lit("x")).withColumn("_y", F.lit(1)), model)
    assert {r.doc_id: r.score for r in clash.collect()} == got and clash.columns == ["doc_id", "text", "lang", "shard", "length", "_y", "score"]
    none = toxicity.fit_toxicity(docs(spark, []), labels.limit(0), s)
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs(spark), none).collect())


def restorer():
    text = "  ".join(["you are a moron and an idiot in the house", "what a moron he is", "she said hello to the idiot"] * 50).encode()
    c = toxicity.byte_classes()[np.frombuffer(b"  " + text + b"  ", np.uint8)]
    return toxicity.Restorer(toxicity.CharModel(np.bincount(c[:-2] * toxicity.CLASSES**2 + c[1:-1] * toxicity.CLASSES + c[2:], minlength=toxicity.CLASSES**3)))


def test_spaced_words(spark):
    r = restorer()
    assert "moron" in r.words("you are a m o r o n") and "moron" in r.words("y o u a r e a m o r o n")
    assert all("idiot" in r.words(t) for t in ("i  d i o t", "i\td\ti\to\tt", "an i\nd\ni\no\nt", "i d 1 o t"))
    assert "and" in r.words("x a n d") and {"moron", "idiot"} <= set(r.words("a m o r o n a n i d i o t"))
    found = toxicity.Hits(r, {"moron": 1.0, "idiot": 2.0})
    assert found("you a m o r o n")[0] == 1.0 and found("a m o r o n a n i d i o t")[:2] == (3.0, 2.0) and found("1 2 3 4") == (0.0, 0.0, 0.0)


def test_long_words(spark):
    r = restorer()
    assert r.words("idi" + "o" * 60 + "t") == ["idiot"] and "moron" in r.words("m" + "o" * 100_000 + "ron!!")
    assert "moron" in r.words("m.0.r.0.n" + "." * 60 + "house") and any(w.startswith("idiot") for w in r.words("-".join("idiot") + "_" * 50 + "hello"))
    assert {"http", "moron", "idiot"} <= set(r.words("http://moron.idiot/" + "you/are/" * 8))
    assert r.words("aid" * 20) == ["aid" * 20]


def test_quality(spark):
    texts = [("plain words in a sentence. " * (3 + i % 5)) + str(i) for i in range(150)] + ["junk*** of### signs$$$ " * (3 + i % 5) + str(i) for i in range(50)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200)], "doc_id long, quality int")
    model = fit_quality(docs(spark, texts), labels, Scratch(spark, "t"))
    got = {r.doc_id: r.score for r in score_quality(docs(spark, texts), model).collect()}
    assert len(got) == 202 and all((got[i] >= 0.3) == (i < 150) for i in range(200))
    clash = score_quality(docs(spark, texts).withColumn("score", F.lit("x")), model)
    assert {r.doc_id: r.score for r in clash.collect()} == got
    x = np.random.default_rng(0).normal(size=(3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = PairGam().fit(x, y)
    z = m.intercept + sum(t[m.bin(x)[:, j]] for j, t in enumerate(m.tables)) + sum(t[m.bin(x)[:, i], m.bin(x)[:, j]] for (i, j), t in m.pair_tables.items())
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z))) and ((m.score(x) > 0.5) == y).mean() > 0.85
    assert text_features(None) == [0.0] * len(FEATURES)
