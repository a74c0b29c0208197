import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import quality, segment, toxicity
from skyledger.llm import queries as Q
from skyledger.llm.scratch import Scratch

from .test_pairs import brute, brute_lines

SF = "/root/testdata/sf0.1"


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7)))
    out = [f"the weather in {word()} is fine and calm today. we had {word()} and bread with {word()} for lunch, number {i}." for i in range(130)]
    out += [f"the weather in {word()} is fine you idiot today. you {word()} idiot had bread with {word()} for lunch, number {i}." for i in range(60)]
    out += [f"#### $$$ {word()} >>> *** {word()} ### {i} %%% &&& {word()} ***" for i in range(50)]
    base = "\n".join(f"a long line that says {word()} and {word()} and then {word()} {word()} to the reader" for _ in range(6))
    out += [base, base, base + "\nand one more line of the copy", base.upper(), "only one line of text. it is fine and calm today", "", None, " \n ", "x " * 30]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows = [(i % 211 if i % 17 else None, t, "en", "web", len(t or "")) for i, t in enumerate(texts())]
    labels = [(i, int(130 <= i < 190), int(i < 190)) for i in range(211)] + [(None, 1, 0), (3, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_viterbi_against_enumeration():
    rng = random.Random(1)
    sample = "  ".join(["you are a moron and an idiot in the house", "she said hello to them"] * 20).encode()
    c = toxicity.byte_classes()[np.frombuffer(b"  " + sample + b"  ", np.uint8)]
    model = toxicity.CharModel(np.bincount(c[:-2] * toxicity.CLASSES**2 + c[1:-1] * toxicity.CLASSES + c[2:], minlength=toxicity.CLASSES**3))

    def readings(word, at, ends, parted):
        if at == len(word):
            return [("", 0.0)]
        return [(read + rest, cost + more) for end, read, cost in toxicity.arcs(word, at, ends[at], parted) for rest, more in readings(word, end, ends, parted)]

    def score(read, cost):
        x = y = 0
        for ch in read:
            z = toxicity.class_of(ch)
            cost += model.logp[x][y][z]
            x, y = y, z
        return cost + model.logp[x][y][0]

    for _ in range(60):
        word = "".join(rng.choice("idoomrn013.*-") for _ in range(rng.randint(1, 7)))
        parted = rng.random() < 0.3
        ways = [(score(r, c), r) for r, c in readings(word, 0, toxicity.run_ends(word), parted)]
        best = max(s for s, _ in ways)
        assert any(abs(s - best) < 1e-9 and r == toxicity.viterbi(word, model, parted) for s, r in ways), word


def test_stages_against_plain_python(spark, sf):
    """Each stage on what its predecessor kept, by null and repeated keys too; then run() as a whole."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~Q.held_out())
    score = toxicity.fit_toxicity(docs, labels, Scratch(spark, "t")).scorer()
    kept = spark.createDataFrame(corpus_pipeline.toxicity(spark, docs, sf).collect(), docs.schema)
    assert bag(kept) == Counter(tuple(r) for r in docs.collect() if score(r.text) < Q.TOXIC_FROM) and 150 < kept.count() < 230
    model = quality.fit_quality(kept, labels, Scratch(spark, "t"))
    good = spark.createDataFrame(corpus_pipeline.quality(spark, kept, sf).collect(), docs.schema)
    assert bag(good) == Counter(tuple(r) for r in kept.collect() if model.score(np.array([quality.text_features(r.text)]))[0] >= Q.GOOD_FROM) and 100 < good.count() < kept.count()
    # rows that repeat a key are ordered by a hash of their texts, which plain Python does not know: one row for each key here
    once = good.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    lines = spark.createDataFrame(corpus_pipeline.line_dedup(spark, spark.createDataFrame(once, docs.schema), sf).collect(), docs.schema)
    gone, want = brute_lines([r.text for r in once], least=1), {}
    for i, r in enumerate(once):
        left = r.text if i not in gone else "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[i])
        if i not in gone or left.split():
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in lines.collect()} == want and len(want) < len(once)
    rows = lines.unionByName(good.where("doc_id is null")).collect()
    last = spark.createDataFrame(corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, docs.schema), sf).collect(), docs.schema)
    group = brute([r.text for r in rows], 5, 8, 10)
    of = {(r.doc_id, r.text): g for r, (n, g) in zip(rows, group) if n}
    heads = Counter(of[r.doc_id, r.text] for r in last.collect() if (r.doc_id, r.text) in of)
    assert set(heads) == {g for n, g in group if n} and set(heads.values()) == {1}
    least = {g: min((r.doc_id is None, r.doc_id or 0) for r, (n, x) in zip(rows, group) if n and x == g) for g in heads}
    assert all((r.doc_id is None, r.doc_id or 0) == least[of[r.doc_id, r.text]] for r in last.collect() if (r.doc_id, r.text) in of)
    packed = corpus_pipeline.packing(spark, last, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in last.collect())
    whole = corpus_pipeline.run(spark, sf)
    assert 0 < whole.count() <= good.count() and {"doc_id", "sequence_id", "offset"} <= set(whole.columns)


def test_registered_queries_keep_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = Counter(r.doc_id for r in docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    for name, limit in (("op2_toxicity", 0.5), ("op5_quality", 0.3)):
        got = Q.queries()[name](spark, sf).collect()
        assert Counter(r.doc_id for r in got) == ids and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= limit) and 0 <= r.score <= 1 for r in got)
    placed = Q.op3_sharding(spark, sf).collect()
    assert Counter(r.doc_id for r in placed) == ids and Counter((r.size, r.text_crc32) for r in placed) == Counter((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    paths = Q.op4_sampled_segmentation(spark, sf).collect()
    assert Counter(r.doc_id for r in paths if r["rank"] == 0) == ids and all(r.round_trip and zlib.crc32(r.ids) == r.ids_crc32 for r in paths)
    model = segment.pieces(Q.vocabulary(Q.PIECES), 1.0)
    assert model.longest == 16 and max(len(r.ids) // 4 - r.n_pieces for r in paths) == 0
    pieces = Q.op6_packing(spark, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == ids and max(Counter(r.sequence_id for r in pieces for _ in range(r.length)).values()) <= 4096
    media = Q.op7_telephony_audio(spark, sf).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in media) == Counter((r.doc_id, len((r.text or "").encode())) for r in docs)
    lines = Q.op10_line_dedup(spark, sf).collect()
    assert Counter((r.doc_id, r.n_lines) for r in lines) == Counter((r.doc_id, (r.text or "").count("\n") + 1) for r in docs)


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.95), ("op5_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    """On rows that taught nothing: the share of pairs of a row of label 1 and one of label 0 that are scored in order."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = Q.queries()[name](spark, SF).where("held_out").join(labels, "doc_id").where("y is not null").select("y", "score").collect()
    one, zero = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    if len(one) >= 5 and len(zero) >= 5:
        assert np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero]) >= least
