import random
from collections import Counter, defaultdict
from functools import reduce
from operator import xor

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from skyledger.llm.components import connected_components
from skyledger.llm.jaccard import jaccard_groups, keep_one_of_each_group
from skyledger.llm.lines import MARK, ROW, LineJoin, _in_crowds, _pack, _similar_sketches, _unpack, dedup_lines, removed_line_lists
from skyledger.llm.queries import op10_line_dedup
from skyledger.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, keys string, n long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, n, num, den):
    sets, parent = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    out = [None, "", " \t\n", "one", "One", "two words", "two  words", "x " * 50]
    passage = [word() for _ in range(60)]
    for size in (4, 9, 10, 11, 19, 20, 40, 150, 700):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                copy[rng.randrange(size)] = word()
            out.append(" ".join(copy))
        out.append(" ".join(passage + base))
    return out


def test_groups_against_brute_force(spark):
    texts = corpus()
    for words, num, den in ((3, 9, 10), (5, 8, 10), (1, 1, 2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, texts), Scratch(spark, "t"), words, num, den).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, words, num, den)


def test_groups_edge_cases(spark):
    s = Scratch(spark, "t")
    assert jaccard_groups(table(spark, []), s).count() == 0
    ids = [None, 5, 5, 7]
    rows = jaccard_groups(table(spark, ["a b c d e f"] * 4, ids), s).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(None, 5): 1, (5, 5): 2, (7, 5): 1})
    kept = keep_one_of_each_group(table(spark, ["a b c d e f"] * 4 + ["", None], [None, 5, 5, 7, 8, 9]), s)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 9] and kept.columns == ["doc_id", "text", "keys", "n"]


def test_one_row_of_each_group_whatever_its_key(spark):
    texts = [f"{w} one two three four five {w}{w}" for w in ("a", "b", "c", "d", "e", "a", "b", "g")]
    ids = [None, None, 5, 5, 5, None, 4, 7]
    kept = keep_one_of_each_group(table(spark, [*texts, " ", None], [*ids, None, None]), Scratch(spark, "t"))
    want = [(None, texts[0]), (4, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[7]), (None, " "), (None, None)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_kept_rows_against_brute_force(spark):
    texts, rng = corpus(3) * 2, random.Random(4)
    ids = [rng.choice([None, *range(8)]) for _ in texts]
    kept = Counter(r.text for r in keep_one_of_each_group(table(spark, texts, ids), Scratch(spark, "t")).collect())
    group = brute(texts, 5, 8, 10)
    want = Counter(g for n, g in group if n > 0)
    of = {t: g for t, (n, g) in reversed(list(zip(texts, group))) if n > 0}
    assert Counter(of[t] for t in kept.elements() if t in of) == Counter(want.keys())
    assert sum(c for t, c in kept.items() if t not in of) == sum(n == 0 for n, _ in group)


def test_line_stage_keeps_what_is_left(spark):
    line = "the quick brown fox jumps over it"
    docs = table(spark, [line, f"{line}\nonly here", f"{line}\n \n{line}", "only here", None, ""]).withColumn("n_chars", F.lit(0))
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {0: (line, len(line)), 1: ("only here", 9), 4: (None, None), 5: ("", 0)}


def test_components(spark):
    s = Scratch(spark, "t")
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), s).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long"), s).count() == 0


def brute_lines(texts, least=5):
    seen, inverted, out = [], defaultdict(list), {}
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").encode().lower().split(b"\n")):
            words = frozenset(line.split())
            if len(words) < least:
                continue
            shared = Counter(j for w in words for j in inverted[w])
            if any(10 * o >= 8 * (len(words) + len(seen[j]) - o) for j, o in shared.items()):
                out.setdefault(i, []).append(n)
            for w in words:
                inverted[w].append(len(seen))
            seen.append(words)
    return out


def test_lines_against_brute_force(spark):
    flat = [t for t in corpus(2) if t]
    texts = ["\n".join(flat[i : i + 3]) for i in range(len(flat))] + [None, "", "\n\n", "a b c d e\nA B c d  e\nf"]
    got = {r.doc_id: r[MARK] for r in removed_line_lists(table(spark, texts), Scratch(spark, "t")).collect() if r[MARK] is not None}
    assert got == brute_lines(texts)


def test_lines_of_crowds_meet_in_parts(spark):
    flat = [t for t in corpus(5) if t and len(t) < 2000]
    texts = ["\n".join(flat[i : i + 3]) for i in range(len(flat))]
    gone = LineJoin(table(spark, texts), Scratch(spark, "t"), min_words=1, crowd=3).removed().groupBy("k").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    assert {r.k: r.lines for r in gone.collect()} == brute_lines(texts, 1)
    counters, num, words = np.full(2**18, 10), np.arange(7), np.full(7, 2**60, np.uint64)
    ((at, names),) = _in_crowds(num, words, num, counters, 3)
    of = {i: set(names[at == i].tolist()) for i in range(7)}
    assert len(at) == 28 and all(of[i] & of[j] for i in of for j in of)


def test_packed_rows():
    columns = [np.array(x, t) for x, t in zip(([1, 2**32 - 1], [-1, 2**62], [3, 4], [0, 70000], [2**63, 1], [2**64 - 1, 0]), ROW)]
    assert all((x == y).all() for x, y in zip(columns, _unpack(_pack(columns), ROW), strict=True))


def test_settled_classes_do_not_meet_each_other():
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(30), rng.randint(1, 25))) for _ in range(150)]
    sets += [sorted({*s, 40 + i}) for i, s in enumerate(sets)]
    gone = [rng.random() < 0.5 for _ in sets]
    rows = [(w, i, 2 * len(s) + gone[i], p) for i, s in enumerate(sets) for p, w in enumerate(s) if p <= len(s) - -(-8 * len(s) // 10)]
    # parities, the sign bit among them
    sketch = [reduce(xor, (1 << (63 - w % 64) for w in s)) for s in sets]
    columns = [*zip(*rows), [sketch[i] for _, i, _, _ in rows], [0] * len(rows)]
    met = [np.array(x, t) for x, t in zip(columns, ROW)]
    got = {(min(a, b), max(a, b)) for x, y in _similar_sketches(met, 8, 10) for a, b in zip(x.tolist(), y.tolist())}
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})}
    assert similar and {p for p in similar if not gone[p[1]]} <= got and not any(gone[b] for _, b in got)


def test_op10_takes_short_lines_too(spark, tmp_path):
    flat = [t for t in corpus(2) if t and len(t) < 2000]
    texts = ["\n".join(flat[i : i + 3]) for i in range(len(flat))] + [None, "\n\n", "a b c d\none\nd c B a", "ONE one\na b c d e\n \nf", "f\na b c"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    want = brute_lines(texts, 1)
    assert {i: r.removed_lines for i, r in got.items() if r.n_removed} == want and len(got) == len(texts)
    assert all(r.n_removed == len(want.get(i, [])) for i, r in got.items())


def test_dedup_lines(spark):
    line = "the quick brown fox jumps over it"
    docs = table(spark, [line + "\nunlike all others are these words here now", line + "\nonly", line + "\nand quite some more words that nobody has seen\nx", None, ""])
    s = Scratch(spark, "t")
    kept = {r.doc_id: r.text for r in dedup_lines(docs, s).collect()}
    assert kept == {0: docs.first().text, 2: "and quite some more words that nobody has seen\nx", 3: None, 4: ""}
    assert dedup_lines(table(spark, []), s).count() == 0
    assert dedup_lines(docs, s, drop_share=None).count() == 5
