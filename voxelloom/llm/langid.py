"""Language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public vocabulary. Each language has a probability for every piece;
a word's likelihood is the sum over all its segmentations into pieces, by the forward
algorithm, and a text's is the product over its words. The probabilities come from expectation
maximisation on word counts of a bounded sample of labelled documents: at most `fit_docs` whole
documents a language, those with the smallest hash. A filter on the hash, from the estimated
number of distinct documents of a language, leaves about four times as many before they are
ranked, so no task meets all documents of a language. Counting and the expectation steps run on
the executors; the driver sees one count per language and piece.

Words are white-space-separated and lower-cased, whole however long: the forward pass rescales
as it goes and keeps no more than the last `longest` sums. Pieces with upper-case letters can
therefore never occur and are not loaded. Single characters stay possible through an unknown piece.

Defined cases: null text, or one without a letter, is `und` with score 0; no labelled rows make
every answer `und`; ties go to the language that sorts first; repeated rows each get a row; a
very long text is scored in runs of whole words, and a very long word by itself; extra columns
are ignored by `identify` and kept by `keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxelloom.llm.shared import default_vocabulary, fresh, small_batches, written

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this length are scored many at a time, longer ones each by itself.
TOGETHER = 64
#: Steps between two rescalings; an unknown character costs about 1e-7, so sums stay above 1e-120.
RESCALE = 16
MARK = "▁"


def vocabulary_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file that lower-cased text can hold, its control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p and p == p.lower())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _hash(piece: str) -> int:
    h = np.uint64(0)
    for c in _codes(piece):
        h = h * BASE + c
    return int(h)


class UnigramModel:
    """probs[piece, language]; the last row is the unknown character's."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        with np.errstate(over="ignore"):
            hashes = np.array([_hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.langs, self.pieces = langs, [pieces[i] for i in order]
        self.hashes, self.probs = hashes[order], np.concatenate([probs[:-1][order], probs[-1:]])
        self.longest = max((len(p) for p in pieces), default=1)
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are ruled out by 20 bits of their hash
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self._cache: dict[str, int] = {}
        self._full = np.zeros((0, len(langs)))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[some]
            out[some[hit]] = at[hit]
        return out

    def lattice(self, words: list[str]) -> Iterator[tuple[np.ndarray, dict, int]]:
        """Words by length: their indices, {(end, length): (rows, pieces)} of the pieces that occur, and the length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * BASE)
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                codes = _codes("".join(words[i] for i in rows)).reshape(len(rows), n).T
                prefix = np.zeros((n + 1, len(rows)), np.uint64)
                for i, c in enumerate(codes):
                    prefix[i + 1] = prefix[i] * BASE + c
                cells = {}
                for k in range(1, min(self.longest, n) + 1):
                    piece = self.look_up((prefix[k:] - prefix[: n + 1 - k] * powers[k]).ravel())
                    if k == 1:
                        piece[piece < 0] = len(self.hashes)  # unknown character
                    some = np.flatnonzero(piece >= 0)
                    cut = np.searchsorted(some, np.arange(n + 2 - k) * len(rows))
                    for e in np.flatnonzero(np.diff(cut)).tolist():
                        own = some[cut[e] : cut[e + 1]]
                        cells[e + k, k] = own - e * len(rows), piece[own]
                yield rows, cells, n

    def forward(self, cells: dict, n: int, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The sums before each place, rescaled, and the log of what each was divided by."""
        alpha, logs = [np.ones((rows, len(self.langs)))], np.zeros((n + 1, rows, len(self.langs)))
        scale = np.zeros((rows, len(self.langs)))
        for end in range(1, n + 1):
            total = np.zeros((rows, len(self.langs)))
            for k in range(1, min(self.longest, end) + 1):
                if (found := cells.get((end, k))) is not None:
                    some, piece = found
                    before = alpha[end - k] if len(some) == rows else alpha[end - k][some]
                    if end - k < end - end % RESCALE and end >= RESCALE:  # a sum of before the last rescaling
                        before = before * np.exp(logs[end - k][some] - scale[some])
                    if len(some) == rows:
                        total += before * self.probs[piece]
                    else:
                        total[some] += before * self.probs[piece]
            if end % RESCALE == 0:
                scale = scale + np.log(total)
                total = np.ones_like(total)
            logs[end] = scale
            alpha.append(total)
        return alpha, logs

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Log probabilities of marked words, by language."""
        out = np.zeros((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        for lo in range(0, len(short), 32_768):
            part = np.array(short[lo : lo + 32_768])
            for rows, cells, n in self.lattice([words[i] for i in part]):
                alpha, logs = self.forward(cells, n, len(rows))
                out[part[rows]] = np.log(alpha[n]) + logs[n]
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                out[i] = self.long_word(w)
        return out

    def long_word(self, word: str, step: int = 4096) -> np.ndarray:
        """Like log_likelihood, of one word of any length: pieces are looked up `step` places at a time."""
        longest, scale = self.longest, np.zeros(len(self.langs))
        last = np.zeros((longest, len(self.langs)))  # row k - 1: the sum k places back
        last[0] = 1.0
        # where fewer than `longest` characters precede, code 0 stands before the word and no piece holds it
        codes = np.concatenate([np.zeros(longest - 1, np.uint64), _codes(word)])
        probs = np.concatenate([self.probs, np.zeros((1, len(self.langs)))])
        for lo in range(0, len(word), step):
            ends = min(step, len(word) - lo)
            window = codes[lo : lo + ends + longest - 1]
            pieces = np.zeros((ends, longest), np.int64)
            with np.errstate(over="ignore"):
                h, power = np.zeros(ends, np.uint64), np.uint64(1)
                for k in range(1, longest + 1):
                    h = h + window[longest - k : longest - k + ends] * power
                    power = power * BASE
                    pieces[:, k - 1] = self.look_up(h)
                    pieces[: max(0, k - lo - 1), k - 1] = -1
            pieces[:, 0] = np.where(pieces[:, 0] < 0, len(self.hashes), pieces[:, 0])
            steps = probs[pieces]  # a row of zeros where no piece ends, as -1 is the last
            for e in range(ends):
                total = (last * steps[e]).sum(axis=0)
                last[1:] = last[:-1]
                last[0] = total
                if e % RESCALE == RESCALE - 1 or e == ends - 1:
                    scale += np.log(total)
                    last /= total
        return scale

    def expected_counts(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of each piece by the language, words weighted by counts (forward-backward)."""
        used = np.zeros(len(self.probs))
        own = UnigramModel.__new__(UnigramModel)
        own.__dict__ |= self.__dict__ | {"langs": [self.langs[lang]], "probs": self.probs[:, lang : lang + 1]}
        log_p = np.log(own.probs[:, 0])
        for lo in range(0, len(words), 4096):
            for rows, cells, n in own.lattice(words[lo : lo + 4096]):
                alpha, logs = own.forward(cells, n, len(rows))
                ahead = [np.log(a[:, 0]) + s[:, 0] for a, s in zip(alpha, logs, strict=True)]
                behind = [np.full(len(rows), -np.inf) for _ in range(n)] + [np.zeros(len(rows))]
                for (end, k), (some, piece) in sorted(cells.items(), key=lambda c: c[0], reverse=True):
                    behind[end - k][some] = np.logaddexp(behind[end - k][some], behind[end][some] + log_p[piece])
                weight = counts[lo + rows]
                for (end, k), (some, piece) in cells.items():
                    share = np.exp(ahead[end - k][some] + log_p[piece] + behind[end][some] - ahead[n][some])
                    used += np.bincount(piece, weights=share * weight[some], minlength=len(used))
        return used

    def known(self, words: set[str], most: int) -> dict[str, int]:
        """Rows of self._full for these words, new ones scored; starts anew when more than `most` would be kept."""
        new = words - self._cache.keys()
        if new and len(self._cache) + len(new) > most:
            self._cache, self._full, new = {}, self._full[:0], words
        if new:
            ordered = sorted(new)
            first = len(self._cache)
            self._full = np.concatenate([self._full, self.log_likelihood([MARK + w for w in ordered])])
            self._cache.update(zip(ordered, range(first, first + len(ordered)), strict=True))
        return self._cache

    def score_texts(self, texts: list[str | None], most: int = 150_000) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of whole texts. Word scores are kept up to about `most` words."""
        totals, lettered = np.zeros((len(texts), len(self.langs))), [t is not None and has_letter(t) for t in texts]
        if self.langs:
            for group in runs_of_words((i, t) for i, t in enumerate(texts) if lettered[i]):
                at = self.known(set().union(*(ws for _, ws in group)), most)
                for i, ws in group:
                    totals[i] += self._full[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        preds, scores = ["und"] * len(texts), np.zeros(len(texts))
        for i, total in enumerate(totals):
            if self.langs and lettered[i]:
                best = int(np.argmax(total))
                preds[i], scores[i] = self.langs[best], 1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum()
        return preds, np.clip(scores, 0.0, 1.0)


def runs_of_words(texts, size: int = 1_000_000) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (number, words) of about `size` characters; a longer text comes in several, cut at white space."""
    group, held = [], 0
    for i, text in texts:
        at = 0
        while at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and not text[end].isspace():
                end += 1
            if words := text[at:end].lower().split():
                group.append((i, words))
            held += end - at
            at = end
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def fit(labelled: DataFrame, *, vocabulary: str | None = None, fit_docs: int = 300, rounds: int = 2, smooth: float = 0.1) -> UnigramModel:
    """Learn from labelled(doc_id, text, lang), of which at most fit_docs rows a language count."""
    pieces = vocabulary_pieces(vocabulary or default_vocabulary("piece_bpe_32k.model"))
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string"), (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("h"))
    # an estimate will do: the filter leaves four times what is ranked
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size")))
    near = rows.join(sizes, "lang").where(F.col("h") * F.col("size") < 4 * fit_docs).groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))
    sample = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= fit_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.as_py().lower().split())
            rows = [(lang, MARK + w, c) for lang, n in seen.items() for w, c in n.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    small_batches(labelled)
    words = written(sample.repartition(8, "doc_id").select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    probs = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    model = UnigramModel(langs, pieces, probs)
    for _ in range(rounds if langs else 0):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array(batch.column(0).to_pylist())
                words, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for lang in sorted(set(own.tolist())):
                    mine = np.flatnonzero(own == lang)
                    used = model.expected_counts([words[i] for i in mine], counts[mine], model.langs.index(lang))
                    at = np.flatnonzero(used)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(used[at])], names=["lang", "piece", "used"])

        sums = words.repartition(8, "word").mapInArrow(expect, "lang string, piece long, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used"))
        used = np.zeros((len(pieces) + 1, len(langs)))
        for lang, piece, n in sums.collect():  # at most languages x pieces of the vocabulary
            used[piece, langs.index(lang)] = round(n, 6)
        used += smooth
        model = UnigramModel(langs, model.pieces, used / used.sum(axis=0))
    return model


def predict(docs: DataFrame, model: UnigramModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two columns added, which come from the text alone."""
    out = T.StructType([*docs.schema, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = model.score_texts(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores)], names=[*batch.schema.names, lang, score])

    small_batches(docs)
    return docs.mapInArrow(run, out)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    labelled = docs.where(~F.coalesce(held_out(), F.lit(True)))
    model = fit(labelled, **options)
    out = predict(docs.select("doc_id", F.col("text").cast("string")), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs with a language: not `und`, and a posterior of at least `least`."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(True))), **options)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return predict(docs, model, lang, score).where(F.col(lang) != "und").where(F.col(score) >= least).drop(lang, score)
