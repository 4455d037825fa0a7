import math
import re
from collections import defaultdict

from voxelloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    """Budget dealt by weight; sources that reach their cap leave the rest to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, out, rest = 1.5 * sum(sizes.values()), {}, list(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in rest}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        rest = [s for s in rest if s not in over]
    return out


def check(rows, docs):
    size = {}
    for r in docs:
        size.setdefault(r.doc_id, set()).add((len(WORD.findall(r.text or "")), r.source))
    sums = defaultdict(int)
    for r in docs:
        sums[r.source] += len(WORD.findall(r.text or ""))
    targets = brute_targets(sums)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, len(WORD.findall(r.text or ""))) for r in docs)
    took = defaultdict(int)
    by_size = {v: s for s, v in sums.items()}
    for r in rows:
        source = by_size[r.source_size]
        assert math.isclose(r.target, targets[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        took[source] += r.taken
    for s, t in targets.items():
        assert abs(took[s] - t) <= max(1, 0.002 * t), (s, took[s], t)


def test_report(spark, docs):
    rows = mixing.mix_report(docs).collect()
    check(rows, docs.collect())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))  # reruns agree


def test_report_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(mixing.mix_report(docs).collect(), docs.collect())


def test_documents_hold_the_words_that_the_report_takes(spark, docs):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got, source = defaultdict(int), {(r.doc_id, r.lang): r.text for r in docs.collect()}
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        words, at = WORD.findall(source[r.doc_id, r.lang]), 0
        for w in WORD.findall(r.text):  # in order
            at = words.index(w, at) + 1
        assert r.n_chars == len(r.text) and r.notes == {"k": "v"} and r.score == 0
    taken = defaultdict(int)
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert sum(got.values()) == sum(taken.values())


def test_taken_follows_the_draws(spark, small):
    """Each source takes the sum of its shards' draws where that lies in the band, and other draws take other words."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", mixing.F.col("source").alias("_source"), mixing.words(mixing.F.col("text")).alias("size"))
    targets = mixing.written(mixing.source_targets(rows, [3, 1, 2], 1.5, 2.0, 8, 0.2))
    want = {r.sidx: r for r in targets.collect()}
    totals = []
    for seed in (17, 18):
        drawn = defaultdict(int)
        for r in mixing.shard_counts(targets, 50, seed).collect():
            drawn[r.sidx] += r.n
        slots = mixing.drawn_slots(targets, 50, seed).collect()
        per, blocks = defaultdict(int), defaultdict(lambda: defaultdict(int))
        for r in slots:
            per[r.sidx] += 1
            blocks[r.sidx, r.epoch][r.block] += 1
        assert per == {s: min(max(drawn[s], t.fewest), t.most) for s, t in want.items()}
        assert all(set(b.values()) == {1} and set(b) <= set(range(want[s].blocks)) for (s, _), b in blocks.items())
        assert all(len(b) == want[s].blocks for (s, e), b in blocks.items() if (s, e + 1) in blocks)
        totals.append(per)
    assert totals[0] != totals[1]


def test_blocks_of_the_shards_hold_the_words_that_the_report_takes(spark, docs):
    got = defaultdict(int)
    for r in mixing.mix_blocks(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    taken = defaultdict(int)
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert sum(got.values()) == sum(taken.values())


def test_small_sources_meet_their_targets(spark):
    rows = [(k, "w " * (k % 7), f"s{k % 5}") for k in range(60)] + [(100, "one", "tiny"), (101, "a b c " * 20, "sixty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix_report(docs).collect(), docs.collect())


def test_no_rows(no_docs):
    assert mixing.mix_report(no_docs).collect() == [] and mixing.mix_documents(no_docs).collect() == [] and mixing.mix_blocks(no_docs).collect() == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).selectExpr("id as block", f"{n}L as blocks", "1 as sidx")
        assert sorted(r.block for r in mixing.permuted(rows, "block", "blocks", ["sidx"], 17).collect()) == list(range(n))


def test_native(docs):
    for df in (mixing.mix_report(docs), mixing.mix_documents(docs), mixing.mix_blocks(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
