import random
import re

import pytest
import xxhash

from voxelloom.llm import simhash
from voxelloom.llm.shared import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (doc_id, fp) -> [(doc_id, hex, component)]."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(root(f))) for d, f in prints), key=str)


def test_edge_table(docs):
    got = sorted(map(tuple, simhash.simhash_dedup(docs).collect()), key=str)
    assert got == brute_components([(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()])


def test_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(map(tuple, simhash.simhash_dedup(docs).collect()), key=str)
    assert got == brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])


@pytest.mark.parametrize(("short", "block"), [(16, 1024), (2, 3), (1, 2)])
def test_links_of_random_prints(spark, short, block):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                g ^= 1 << b
            fps.add(g)
    rows = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in rows], "fp long")
    found = connected_components(simhash.links(df, short=short, block=block)).collect()
    label = {r.node & (2**64 - 1): r.component for r in found}
    want = dict(zip(rows, [c for _, _, c in sorted(((f, h, c) for f, h, c in brute_components([(k, f) for k, f in enumerate(rows)])), key=lambda r: r[0])], strict=True))
    for a in rows:
        for b in rows:
            if a < b:
                assert (want[a] == want[b]) == (a in label and b in label and label[a] == label[b])


def test_position_sets_meet_any_agreement():
    import itertools

    for agree in range(1, 9):
        sets = [set(s) for s in simhash.position_sets(agree)]
        assert all(any(s <= set(some) for s in sets) for some in itertools.combinations(range(8), agree))


def test_shared_bytes_are_tallied():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, 30, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    b[:10] = a[:10] ^ np.uint64(0x00FF00000000FF01)
    want = [[sum(x == y for x, y in zip(int(i).to_bytes(8), int(j).to_bytes(8), strict=True)) for j in b] for i in a]
    assert simhash.shared_bytes(a, b).tolist() == want and (np.diag(simhash.shared_bytes(a, b))[:10] == 5).all()


def test_one_of_each_stays(docs, no_docs):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    heads = {r.component_id for r in simhash.simhash_dedup(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(h for h in heads if h is not None)
    assert simhash.keep_one_each(no_docs).count() == 0 and simhash.simhash_dedup(no_docs).count() == 0


def test_one_of_each_component_stays_whatever_its_ids(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.getrandbits(40)) for _ in range(30)) for _ in range(12)]
    assert all((brute_print(a) ^ brute_print(b)).bit_count() > 4 for a in texts for b in texts if a < b)
    rows = [(None, t) for t in texts[:6]] * 2  # no id at all
    rows += [(7, t) for t in texts[6:9]] * 2  # one id for all
    rows += [(None, texts[9]), (3, texts[9]), (2, texts[9]), (2, texts[9]), (2, texts[10]), (2, None), (None, "")]
    kept = simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:9]] + [(2, texts[9]), (2, texts[10]), (2, None)]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_extra_columns_of_any_name_stay(spark):
    names = ["_head", "_head_fp", "_fp", "_uid", "head", "uid", "component", "fp", "node"]
    docs = spark.createDataFrame([(k, "one two three four five", *range(9)) for k in (4, 2, 9)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "one two three four five", *range(9))]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(5, 5), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 230)]} | {299: 299, 300: 299}
