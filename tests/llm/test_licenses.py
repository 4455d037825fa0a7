from voxelloom.llm import license_scan

APACHE = license_scan.TEMPLATES["Apache-2.0-header"]


def test_matches_and_spans(spark, docs, no_docs):
    changed = APACHE.replace("governing", "that governs").replace("obtain", "get")
    rows = [(1, "intro words " + APACHE + " trailer"), (2, "İ " + changed), (3, "nothing to see"), (4, None), (5, ""), (6, "Released under the MIT License. " * 3), (7, "the license of the house")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan_licenses(df).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == {1, 2, 6}
    whole = next(r for r in by[1] if r.license == "Apache-2.0-header")
    assert whole.coverage == 1.0 and rows[0][1][whole.span_start : whole.span_end] == APACHE.rstrip(".")
    near = next(r for r in by[2] if r.license == "Apache-2.0-header")
    assert 0.9 < near.coverage < 1.0 and rows[1][1][near.span_start : near.span_end].startswith("Licensed under")
    assert len([r for r in by[6] if r.license == "MIT"]) == 3
    assert license_scan.scan_licenses(docs).collect() == [] and license_scan.scan_licenses(no_docs).collect() == []


def test_winnowing_keeps_a_place_of_every_window():
    import numpy as np

    h = np.random.default_rng(3).integers(0, 50, 200).astype(np.uint64)
    kept = set(license_scan.winnow(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197))


def test_on_the_table_against_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        for name, template in license_scan.TEMPLATES.items():
            if template in (r.text or ""):
                assert (r.doc_id, name) in found


def plain_best(template, ids):
    """Best local score over all diagonals, cell by cell."""
    score = [[0] * (len(ids) + 1) for _ in range(len(template) + 1)]
    best = 0
    for i, t in enumerate(template, 1):
        for j, w in enumerate(ids, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if t == w else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def score_of(index, k, ids, found):
    """A score that the reported match must have: two for each match, less its mismatches and left out tokens at best."""
    matched, first, last = found
    return 2 * matched - max(0, last - first + 1 - matched)


def test_alignment_against_all_diagonals():
    import random

    rng = random.Random(3)
    index = license_scan.TemplateIndex({"t": " ".join(rng.choice("abcdefgh") for _ in range(30))})
    template = index.ids[0].tolist()
    for _ in range(200):
        ids = [rng.randrange(0, 9) for _ in range(rng.randrange(0, 15))] + [t for t in template if rng.random() > 0.15 for t in ([t] if rng.random() > 0.1 else [t, 0])] + [rng.randrange(0, 9) for _ in range(rng.randrange(1, 15))]
        found = index.align(license_scan.np.array(ids), 0, -len(template), len(ids))
        want = plain_best(template, ids)
        # the trace is a common subsequence of the span and the template, with the best score as its worth
        matched, first, last = found
        span = ids[first : last + 1]
        assert template and plain_best(template, span) == want and 0 <= first <= last < len(ids)
        assert score_of(index, 0, ids, found) >= want


def test_foreign_words_in_the_middle(spark):
    words = APACHE.split()
    rows = [(n, " ".join(words[:40] + [f"foreign{k}" for k in range(n)] + words[40:])) for n in (0, 8, 12, 30)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in found if r.license == "Apache-2.0-header"}
    assert got.keys() == {0, 8, 12, 30} and all(r.coverage == 1.0 for r in got.values())
    for r in got.values():
        assert rows[[n for n, _ in rows].index(r.doc_id)][1][r.span_start : r.span_end] == " ".join(words[:40] + [f"foreign{k}" for k in range(r.doc_id)] + words[40:]).rstrip(".")


def test_nothing_is_missed_and_nothing_made_up():
    """Against alignment with every template over the whole text: what shares a run of four tokens and covers 0.8 is found."""
    import random

    rng = random.Random(7)
    templates = {f"t{k}": " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(5)) for _ in range(n)) for k, n in enumerate((6, 20, 60))}
    index = license_scan.TemplateIndex(templates)
    for _ in range(60):
        name = rng.choice(list(templates))
        words = templates[name].split()
        changed = [w if rng.random() > 0.06 else "x" for w in words if rng.random() > 0.04]
        text = " ".join(["y"] * rng.randrange(5) + changed + ["z"] * rng.randrange(5))
        ids = [index.vocab.get(w, 0) for w in text.split()]
        found = {m[0]: m for m in index.matches(text, 0.8)}
        for k, own in enumerate(index.names):
            template = index.ids[k].tolist()
            matched, first, last = index.align(license_scan.np.array(ids), k, -len(template), len(ids))
            runs = {tuple(ids[i : i + 4]) for i in range(len(ids) - 3)} & {tuple(template[i : i + 4]) for i in range(len(template) - 3)}
            if matched / len(template) >= 0.8 and runs:
                assert own in found and abs(found[own][2] - matched) <= 1
            elif matched / len(template) < 0.8:
                assert own not in found
