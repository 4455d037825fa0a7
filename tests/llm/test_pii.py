import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from voxelloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(ds: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(ds[::-1])) % 10 == 0


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def brute(text: str) -> list[list[tuple[int, int]]]:
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- 4()_٣\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_cards_and_phones():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["4111 1111-1111 1111", "+49 (30) 123-4567", "10.0.0.255", "1.2.3.256", "a.b@c.de", "5", " ", "-", ".", "4242424242424242"]) for _ in range(rng.randrange(1, 8)))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "@" * 200_000, "+1" * 100_000, "a@" * 100_000, "-" * 300_000 + " a@b.co"):
        base = pii.base_spans(text)
        assert len(pii.Nodes(text, base).spans) <= 2


def test_digest(docs):
    for r in pii.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        base = brute(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(b) for b in base]
        text = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, base, strict=True) for a, b in own)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert len(rows) == docs.count() and sum(r.n_email + r.n_phone for r in rows.values()) > 0
    for d in docs.collect():
        base = brute(d.text or "")
        own = [f"{k}:{a}:{b}" for k, s in zip(pii.KINDS, base, strict=True) for a, b in s]
        assert set(own) <= set(rows[d.doc_id].spans.split(",")) | {""}
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert rows[d.doc_id].n_spans == len([s for s in rows[d.doc_id].spans.split(",") if s])


def repeated(spark):
    rows = [(k, f"Write to ann.lee{k}@mail.example.org today. Later, ann.lee{k}@mail answers; call +49 30 5550{k:03d}1 or 4930 room 12. Again 49305550{k:03d}1 and item 77.", "x") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def test_the_field_spreads_labels_to_distant_repeats(spark):
    docs = repeated(spark)
    for r in pii.scan(docs).join(docs, "doc_id").collect():
        found = [(k, r.text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(","))]
        assert ("email", f"ann.lee{r.doc_id}@mail") in found and ("phone", f"49305550{r.doc_id:03d}1") in found
        assert not any("77" == t or "12" == t for _, t in found)


def test_redaction(spark, docs, no_docs):
    for r in pii.redact(repeated(spark)).collect():
        assert "@" not in r.text and "[email]" in r.text and "[phone]" in r.text and r.extra == "x"
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert pii.redact(no_docs).count() == 0 and pii.scan(no_docs).count() == 0


def exact_marginals(nodes, model, unary):
    """Sums over all labellings, with one hidden node for each group."""
    import itertools

    import numpy as np

    n, out = len(unary), np.zeros((len(unary), 5))
    for y in itertools.product(range(5), repeat=n):
        w = np.exp(sum(unary[i][v] for i, v in enumerate(y)) + model["chain"] * sum(y[i] == y[i - 1] for i in nodes.chain))
        for kind, g in nodes.groups:
            w *= sum(np.exp(model["skip"][kind] * sum(y[i] == h for i in g)) for h in range(5))
        for i, v in enumerate(y):
            out[i, v] += w
    return out / out.sum(axis=1, keepdims=True)


def test_message_passing_against_exact_marginals():
    """Exact on a chain, which is a tree; near it with groups, which close loops."""
    import numpy as np

    rng = np.random.default_rng(6)
    text = "x1 y2 a@b.co z3 abc123456 - abc123456 y2"
    for loops in (False, True):
        for _ in range(5):
            nodes = pii.Nodes(text, [[], [], [], []])
            nodes.label[2] = 1
            if not loops:
                nodes.groups = []
            assert bool(nodes.groups) == loops
            model = {"unary": {}, "chain": float(rng.uniform(0.2, 1)), "skip": dict.fromkeys(pii.LINKS, float(rng.uniform(0.5, 2)))}
            unary = rng.normal(size=(len(nodes.tokens), 5))
            seen = unary.copy()
            seen[2] = [-30, 0, -30, -30, -30]
            got, want = pii.infer(nodes, model, unary), exact_marginals(nodes, model, seen)
            assert np.abs(got - want).max() < (0.08 if loops else 0.01)


def test_weights_are_fitted():
    """Links whose ends agree get weight, in proportion to how far they do; a form that is always one label speaks for it."""
    import numpy as np

    form = pii.shape("12345678")
    counts = {}
    for seen in range(-1, 5):
        for y in range(5):
            counts[form, (-1, -1), (seen, -1, -1, -1), y] = 90 if seen == y else 10
            counts[form, (-1, seen), (-1, -1, -1, -1), y] = 30 if seen == y else 10
    model = pii.fit_weights(counts)
    assert abs(model["skip"]["t"] - np.log(9)) < 0.2 and abs(model["chain"] - np.log(3)) < 0.2 and abs(model["skip"]["d"]) < 0.1
    model = pii.fit_weights({(form, (-1, -1), (-1,) * 4, 3): 500, (pii.shape("a@b"), (-1, -1), (-1,) * 4, 0): 500})
    scores = pii.own_scores(pii.Nodes("12345678 a@b", [[], [], [], []]), model)
    assert scores[0].argmax() == 3 and scores[1].argmax() == 0


def test_no_observations():
    model = pii.fit_weights({})
    assert pii.find_spans("call 12 at 5", model) == ([[], [], [], []], [[], [], [], []])
