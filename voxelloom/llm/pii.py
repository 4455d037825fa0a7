"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. Around them a field labels tokens: the nodes of a document are its
white-space-separated tokens that hold a digit or an at sign; neighbours in the text are linked
as a chain, and tokens of the same or a similar form (equal text, equal digits, equal last
seven digits, equal address part), however far apart, share one more potential. Loopy
sum-product message passing makes labels consistent across the document. Nodes of base spans
are observed. The field runs on every text; where no node is observed and no token's own
features favour a label, all links favouring agreement, its answer is known to be none.

A group of similar tokens is linked through one hidden node instead of all its pairs, so work
is linear in the text. The weights (of token features, of equal labels along the chain, and of
equal labels by kind of link) are fitted by pseudo-likelihood over all documents: every node with
a base span, and every node that is not linked to one, is to be predicted from its features
and its neighbours' labels, of which half of the base spans' are hidden by a hash. Nodes that
repeat a base span without having one are unlabelled, not known to be clean, so they are neither
predicted nor seen. A normal prior holds the weights; nothing else bounds them. What leaves the
executors is one count for each combination of features and labels.

Defined cases: null text is empty; repeated rows each get a row; ties between labels go to none,
then to the first of KINDS; a very long text is taken whole, with work in proportion to its
length; no rows give no rows; extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import ast
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match cannot begin inside a run of digits, nor end inside one; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
EDGE = "\"'()[]{}<>,;:!?#*$&."
NOT_DIGIT = re.compile(r"[^0-9]+")
ROUNDS, DAMPING, OBSERVED = 10, 0.3, 30.0
#: Kinds of links: equal text, equal digits, equal last seven digits, equal address part.
LINKS = "tdsl"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ADDRESS, found from their at signs so that long words cost no rescans."""
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL_CHARS:
            first -= 1
        if first < at and (m := ADDRESS.match(text, first)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS."""
    out: list[list[tuple[int, int]]] = [list(emails(text)), [], [], []]
    out[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    out[3] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def fails(token: str) -> bool:
    """Whether the token has the form of a kind and fails that kind's check."""
    bare = token.strip(EDGE)
    digits = NOT_DIGIT.sub("", bare)
    if 13 <= len(digits) <= 19 and CARD.fullmatch(bare):
        return not luhn(digits)
    return bool((IP.fullmatch(bare) or PHONE.fullmatch(bare)) and not any(base_spans(bare)))


def shape(token: str) -> tuple:
    """What the field sees of a token: digits in classes, at sign, points, plus, parenthesis, letters, a failed check."""
    digits = sum(c.isdigit() for c in token)
    return (digits if digits < 8 else 8 + (digits - 8) // 4 if digits < 20 else 11, "@" in token, min(token.count("."), 3), token[:1] == "+", "(" in token, any(c.isalpha() for c in token), digits >= 4 and fails(token))


def features(form: tuple) -> list[str]:
    return ["one", *(f"{k}={int(v)}" for k, v in zip(("digits", "at", "points", "plus", "open", "letters", "fails"), form, strict=True)), "form=" + ",".join(str(int(v)) for v in form)]


def keys(token: str) -> set[str]:
    """Forms under which a token meets similar ones."""
    bare = token.strip(EDGE).lower()
    digits = NOT_DIGIT.sub("", bare)
    out = {"t" + bare} if len(bare) >= 6 else set()
    if len(digits) >= 6:
        out.add("d" + digits)
    if len(digits) >= 7:
        out.add("s" + digits[-7:])
    if "@" in bare:
        local, _, host = bare.partition("@")
        if len(local) >= 4 and host:
            out.add("l" + local + "@" + host.split(".")[0])
    return out


class Nodes:
    """The tokens of one text, their observed labels (0: none seen), chain and groups."""

    def __init__(self, text: str, base: list[list[tuple[int, int]]]):
        spans = sorted((a, b, k + 1) for k, kind in enumerate(base) for a, b in kind)
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.tokens = [text[a:b] for a, b in self.spans]
        self.label = np.zeros(len(self.spans), np.int64)
        at = 0
        for i, (a, b) in enumerate(self.spans):
            while at and spans[at - 1][1] > a:
                at -= 1
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            if at < len(spans) and spans[at][0] < b:
                self.label[i] = spans[at][2]
        gaps = [i for i in range(1, len(self.spans)) if text[self.spans[i - 1][1] : self.spans[i][0]].isspace() and self.spans[i][0] - self.spans[i - 1][1] <= 2]
        self.chain = np.array(gaps, np.int64)
        groups: dict[str, list[int]] = {}
        for i, t in enumerate(self.tokens):
            for k in keys(t):
                groups.setdefault(k, []).append(i)
        self.groups = [(k[0], g) for k, g in groups.items() if len(g) > 1]
        self.linked = {i for _, g in self.groups if self.label[g].any() for i in g}


def observations(nodes: Nodes) -> Iterator[tuple]:
    """(form, chain labels, link labels, label) of each node to be predicted; -1: not there or not seen."""
    seen = nodes.label.copy()
    for i, (y, token) in enumerate(zip(nodes.label.tolist(), nodes.tokens, strict=True)):
        if (y and zlib.crc32(f"{i}:{token}".encode()) & 1) or (not y and i in nodes.linked):
            seen[i] = -1
    after = set(nodes.chain.tolist())
    links: list[dict[str, int]] = [{} for _ in nodes.tokens]
    for kind, g in nodes.groups:
        votes = np.bincount(seen[g][seen[g] >= 0], minlength=5)
        for i in g:
            own = votes - (np.arange(5) == seen[i])
            if own.any():
                links[i][kind] = int(own.argmax())
    for i, token in enumerate(nodes.tokens):
        y = int(nodes.label[i])
        if y or i not in nodes.linked:
            left = int(seen[i - 1]) if i in after else -1
            right = int(seen[i + 1]) if i + 1 in after else -1
            yield shape(token), (min(left, right), max(left, right)), tuple(links[i].get(k, -1) for k in LINKS), y


def fit_weights(counts: dict[tuple, int], steps: int = 400, spread: float = 3.0) -> dict:
    """The weights that maximise the pseudo-likelihood of observations times a normal prior of this spread."""
    names = sorted({f for form, *_ in counts for f in features(form)})
    number = {f: k for k, f in enumerate(names)}
    own = np.zeros((len(counts), len(names)))
    pairs = np.zeros((len(counts), 1 + len(LINKS), 5))
    n, y = np.array(list(counts.values()), float), np.array([c[3] for c in counts], np.int64)
    for r, (form, chain, links, _) in enumerate(counts):
        own[r, [number[f] for f in features(form)]] = 1.0
        for v in chain:
            if v >= 0:
                pairs[r, 0, v] += 1.0
        for k, v in enumerate(links):
            if v >= 0:
                pairs[r, 1 + k, v] += 1.0
    # whole forms only say what their parts do not; the constant is free
    tight = np.array([0.0 if f == "one" else 4.0 if f.startswith("form=") else 1.0 for f in names])[:, None] / spread**2
    unary, weight, rows = np.zeros((len(names), 4)), np.zeros(1 + len(LINKS)), np.arange(len(y))
    moments = [np.zeros((2, *p.shape)) for p in (unary, weight)]
    for step in range(1, steps + 1 if len(y) else 1):
        score = np.concatenate([np.zeros((len(y), 1)), own @ unary], axis=1) + np.einsum("rky,k->ry", pairs, weight)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        gap = -p / p.sum(axis=1, keepdims=True)
        gap[rows, y] += 1.0
        gap *= n[:, None]
        slopes = own.T @ gap[:, 1:] - tight * unary, np.einsum("rky,ry->k", pairs, gap) - weight / spread**2
        for value, slope, m in zip((unary, weight), slopes, moments, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.99 * m[1] + 0.01 * slope**2
            value += 0.2 * min(1.0, 2.0 * (1 - step / steps)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    return {"unary": {f: np.concatenate([[0.0], unary[k]]) for f, k in number.items()}, "chain": float(weight[0]), "skip": dict(zip(LINKS, weight[1:].tolist(), strict=True))}


def _message(belief: np.ndarray, weight) -> np.ndarray:
    """Log messages through potentials that give e^weight to equal labels."""
    top = belief.max(axis=1, keepdims=True)
    p = np.exp(belief - top)
    out = np.log(np.maximum(p.sum(axis=1, keepdims=True) + p * np.expm1(weight), 1e-300)) + top
    return out - out.max(axis=1, keepdims=True)


def own_scores(nodes: Nodes, model: dict) -> np.ndarray:
    """Log potentials of each node's own features; a feature that was never seen says nothing."""
    known: dict[tuple, np.ndarray] = {}
    for form in {shape(t) for t in nodes.tokens}:
        known[form] = sum((model["unary"].get(f, 0.0) for f in features(form)), np.zeros(5))
    return np.stack([known[shape(t)] for t in nodes.tokens]) if nodes.tokens else np.zeros((0, 5))


def infer(nodes: Nodes, model: dict, unary: np.ndarray | None = None) -> np.ndarray:
    """The marginals of each node's labels by loopy sum-product passing."""
    unary = own_scores(nodes, model) if unary is None else unary.copy()
    seen = nodes.label > 0
    unary[seen] = -OBSERVED
    unary[seen, nodes.label[seen]] = 0.0
    member = np.array([i for _, g in nodes.groups for i in g], np.int64)
    hub = np.repeat(np.arange(len(nodes.groups)), [len(g) for _, g in nodes.groups])
    skip = np.repeat([model["skip"][k] for k, _ in nodes.groups], [len(g) for _, g in nodes.groups])[:, None]
    right, left = nodes.chain, nodes.chain - 1
    to_hub, to_member = np.zeros((len(member), 5)), np.zeros((len(member), 5))
    to_right, to_left = np.zeros((len(right), 5)), np.zeros((len(right), 5))

    def total() -> np.ndarray:
        out = unary.copy()
        np.add.at(out, member, to_member)
        np.add.at(out, right, to_right)
        np.add.at(out, left, to_left)
        return out

    for _ in range(ROUNDS):
        belief = total()
        if len(member):
            to_hub = (1 - DAMPING) * _message(belief[member] - to_member, skip) + DAMPING * to_hub
            hubs = np.zeros((len(nodes.groups), 5))
            np.add.at(hubs, hub, to_hub)
            to_member = (1 - DAMPING) * _message(hubs[hub] - to_hub, skip) + DAMPING * to_member
        if len(right):
            new_right = _message(belief[left] - to_left, model["chain"])
            to_left = (1 - DAMPING) * _message(belief[right] - to_right, model["chain"]) + DAMPING * to_left
            to_right = (1 - DAMPING) * new_right + DAMPING * to_right
    out = total()
    p = np.exp(out - out.max(axis=1, keepdims=True)) if len(out) else out
    return p / p.sum(axis=1, keepdims=True) if len(out) else p


def added_spans(text: str, base: list[list[tuple[int, int]]], model: dict) -> list[list[tuple[int, int]]]:
    """Spans of tokens to which the field gives one label with more than even odds; edges trimmed, base spans left out.

    Tokens too short to be known again, such as a country code, are no span by themselves.
    """
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    nodes = Nodes(text, base)
    if not nodes.tokens or nodes.label.all():
        return out
    unary = own_scores(nodes, model)
    agreeing = model["chain"] >= 0 and min(model["skip"].values()) >= 0
    if agreeing and not nodes.label.any() and (unary[:, 1:] < 0).all():
        return out
    p = infer(nodes, model, unary)
    for i in np.flatnonzero((p[:, 1:].max(axis=1) > 0.5) & (nodes.label == 0)).tolist():
        if not keys(nodes.tokens[i]):
            continue
        a, b = nodes.spans[i]
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        if a < b:
            out[int(p[i, 1:].argmax())].append((a, b))
    return out


def count_observations(docs: DataFrame) -> DataFrame:
    """(seen, n): counts of equal observations over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                counts.update(observations(Nodes(text, base_spans(text))))
        yield pa.RecordBatch.from_arrays([pa.array([repr((tuple(map(int, c[0])), *c[1:])) for c in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["seen", "n"])

    small_batches(docs)
    return docs.select(F.col("text").cast("string")).mapInArrow(run, "seen string, n long").groupBy("seen").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> dict:
    """The fitted field. The driver sees combinations of token forms and labels, whose number has nothing to do with the rows'."""
    return fit_weights({ast.literal_eval(seen): n for seen, n in sorted(map(tuple, count_observations(docs).collect()))})


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)


def find_spans(text: str | None, model: dict) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and all spans, of one text."""
    base = base_spans(text or "")
    more = added_spans(text or "", base, model)
    return base, [sorted({*b, *m}) for b, m in zip(base, more, strict=True)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of docs(doc_id, text).

    n_spans counts all spans, those of the field included.
    """
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find_spans(text.as_py(), model)
                rows.append([*map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every))])
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; n_chars set anew."""
    model, at = fit(docs), docs.columns.index("text")
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    spans = sorted((a, b, kind) for kind, own in zip(KINDS, find_spans(text, model)[1], strict=True) for a, b in own)
                    parts, done = [], 0
                    for a, b, kind in spans:
                        if a >= done:
                            parts += [text[done:a], f"[{kind}]"]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
