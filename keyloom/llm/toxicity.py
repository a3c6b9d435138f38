"""Toxicity by a linear-chain conditional random field.

Labels are given for documents, so training tokens are labelled at a distance: a token of a toxic document is toxic
if one of its features (word, prefixes, suffix) stands almost only in toxic training documents. A two-state CRF is
fitted to these sequences; forward-backward gives each token's marginal, runs of likely tokens are the offending
spans, and a logistic curve over the strongest marginal and the sum of the likely ones is the document's score.

What is fitted uses a bounded sample (see `train`); everything else covers all rows and whole texts. Defined cases: null and blank texts have no token and score as the
curve at its lowest; a null doc_id is never learned from and not held out unless its empty text is; repeated rows are
scored each by itself; several labels of a document count as toxic if one does; null labels are ignored; without
toxic or without clean training rows every score is 0; other columns are ignored; an empty table gives an empty
result. Scoring shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, fresh, released, small_batches
from keyloom.llm.encoding import in_groups
from keyloom.llm.hashing import mixed

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PIECE = 200  # tokens of a training sequence
CACHE = 300_000  # word scores a Python worker keeps


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def features(word: str) -> list[str]:
    w = EDGE.sub("", word.lower())
    if not w:
        return []
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5) if len(w) > k), *((f"${w[-4:]}",) if len(w) > 4 else ())]


@dataclass
class Crf:
    """Scores are those of the toxic state against the clean one."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    #: Potentials of the steps clean-clean, clean-toxic, toxic-clean, toxic-toxic, as logarithms.
    steps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    #: Intercept, and weights of the strongest marginal's log-odds and of the likely marginals' sum.
    curve: tuple[float, float, float] | None = None

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def marginals(scores: list[np.ndarray], steps: tuple[float, float, float, float]) -> list[np.ndarray]:
    """Log-odds of the toxic state for every token of every sequence, by forward-backward."""
    return forward_backward(scores, steps)[0]


def forward_backward(scores: list[np.ndarray], steps: tuple[float, float, float, float], count: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The marginals, and (if asked for) how often each kind of step is expected. All sequences advance together, the
    longest first, so that the ended ones leave from the end."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], np.int64)
    top = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, top + 1), side="right")  # how many have a token at this place
    base = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(int(base[-1]))
    for row, i in enumerate(order):  # place by place: the tokens at one place are neighbours
        flat[base[: sizes[row]] + row] = scores[i]
    cc, ct, tc, tt = np.exp(steps)
    odds = np.exp(np.clip(flat, -40, 40))
    ahead, back = np.empty_like(flat), np.ones_like(flat)
    for t in range(top):
        now = slice(base[t], base[t + 1])
        if t == 0:
            ahead[now] = odds[now]
        else:
            r = ahead[base[t - 1] : base[t - 1] + alive[t]]
            ahead[now] = odds[now] * (ct + tt * r) / (cc + tc * r)
    for t in range(top - 2, -1, -1):
        r = back[base[t + 1] : base[t + 2]] * odds[base[t + 1] : base[t + 2]]
        back[base[t] : base[t] + alive[t + 1]] = (tc + tt * r) / (cc + ct * r)
    expected = np.zeros(4)
    for t in range(1, top if count else 0):
        now = slice(base[t], base[t + 1])
        r, o = ahead[base[t - 1] : base[t - 1] + alive[t]], odds[now] * back[now]
        kinds = np.stack([np.full(len(r), cc), ct * o, tc * r, tt * r * o])
        expected += (kinds / kinds.sum(0)).sum(1)
    both = np.log(ahead) + np.log(back)
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    for row, i in enumerate(order):
        out[i] = both[base[: sizes[row]] + row]
    return out, expected


def _chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))


def summary(log_odds: np.ndarray) -> tuple[float, float]:
    """The strongest marginal's log-odds, and the sum of the marginals over one half."""
    if not len(log_odds):
        return -12.0, 0.0
    p = _chance(log_odds)
    return float(np.clip(log_odds.max(), -12, 12)), float(np.log1p(p[p > 0.5].sum()))


@dataclass
class Types:
    """The different words of the sample, numbered, and their features, numbered, as rows of a compressed matrix."""

    number: dict[str, int] = field(default_factory=dict)
    names: dict[str, int] = field(default_factory=dict)
    cols: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    fixed: tuple[np.ndarray, np.ndarray] | None = None  # ends and cols, once all is read

    def read(self, text: str) -> np.ndarray:
        out = []
        for w in re.findall(WORD, text):
            i = self.number.get(w)
            if i is None:
                i = self.number[w] = len(self.number)
                self.cols += [self.names.setdefault(f, len(self.names)) for f in features(w)]
                self.ends.append(len(self.cols))
            out.append(i)
        return np.array(out, np.int32)

    def of(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of these types, and for each which of the types it is of."""
        if self.fixed is None:
            self.fixed = np.array(self.ends, np.int64), np.array(self.cols, np.int64)
        ends, all_cols = self.fixed
        last = ends[types]
        first = np.where(types > 0, ends[types - 1], 0)
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return all_cols[at], np.repeat(np.arange(len(types)), n)


def distant_labels(types: Types, docs: list[np.ndarray], toxic: np.ndarray, share: float = 0.02, least: int = 4, purity: float = 0.95) -> np.ndarray:
    """Which features mark a toxic token: those in at least `share` of the toxic documents, between as many different
    pairs of neighbours (near copies repeat a word between the same ones), and in clean documents so rarely that
    `purity` of the prior-weighted documents with them are toxic."""
    inside = np.zeros((2, len(types.names)), np.int64)
    for d, label in zip(docs, toxic):
        inside[int(label), np.unique(types.of(np.unique(d))[0])] += 1
    a, b = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    enough = max(least, share * a)
    pure = (inside[1] >= enough) & (inside[1] / a >= purity * (inside[1] / a + inside[0] / b))
    own = np.flatnonzero(pure)
    seen = [np.zeros(0, np.uint64)]
    for d, label in zip(docs, toxic):
        if label and len(d) and len(own):
            before, after = np.concatenate([[-1], d[:-1]]).astype(np.uint64), np.concatenate([d[1:], [-1]]).astype(np.uint64)
            cols, at = types.of(d)
            keep = pure[cols]
            place = mixed(mixed(before) + after)[at[keep]]
            seen.append(mixed(place) // np.uint64(len(own)) * np.uint64(len(own)) + np.searchsorted(own, cols[keep]).astype(np.uint64))
    around = np.zeros(len(pure), np.int64)
    if len(own):
        around[own] = np.bincount((np.unique(np.concatenate(seen)) % np.uint64(len(own))).astype(np.int64), minlength=len(own))
    return pure & (around >= enough)


def fit(docs: list[str], toxic: np.ndarray, rounds: int = 40, l2: float = 1e-3) -> Crf:
    if not len(docs) or toxic.min() == toxic.max():
        return Crf()
    types = Types()
    read = [types.read(d) for d in docs]
    # The curve is fitted to every third document, whose words the weights have not seen, if both labels are there.
    apart, own = np.arange(2, len(docs), 3), np.flatnonzero(np.arange(len(docs)) % 3 != 2)
    if min(toxic[apart].sum(), (1 - toxic[apart]).sum()) < 10:
        apart = own = np.arange(len(docs))
    strong = distant_labels(types, [read[i] for i in own], toxic[own])
    names = types.names
    cols, rows = types.of(np.arange(len(types.number)))
    marked = np.bincount(rows, strong[cols], len(types.number)) > 0
    ids = [read[i][a : a + PIECE] for i in own for a in range(0, len(read[i]), PIECE)]
    all_ids = np.concatenate(ids)
    y = np.concatenate([marked[read[i]] * toxic[i] for i in own])
    cuts = np.cumsum([len(x) for x in ids])[:-1]
    pairs = np.ones(len(all_ids), bool)
    pairs[0] = False
    pairs[cuts] = False  # the first token of a sequence follows none
    # Weights and steps are fitted by full-batch AdaGrad on the likelihood's gradient; steps begin at their frequencies.
    now, before = y[pairs], np.concatenate([[0], y[:-1]])[pairs]
    seen = np.array([((before == s) & (now == t)).sum() for s in (0, 1) for t in (0, 1)], float)
    steps = np.log((seen + 1) / np.repeat(seen[::2] + seen[1::2] + 2, 2))
    step_squares = np.full(4, 1e-8)
    theta, bias = np.zeros(len(names)), 0.0
    squares, bias_squares = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        per_type = bias + np.bincount(rows, theta[cols], len(types.number))
        found, expected = forward_backward(np.split(per_type[all_ids], cuts), tuple(steps), count=True)
        p = _chance(np.concatenate(found))
        off = np.bincount(all_ids, p - y, len(types.number))
        slope = np.bincount(cols, off[rows], len(names)) + l2 * len(own) * theta / 10
        squares += slope**2
        theta -= 0.5 * slope / np.sqrt(squares)
        bias_squares += off.sum() ** 2
        bias -= 0.5 * off.sum() / np.sqrt(bias_squares)
        step_slope = expected - seen
        step_squares += step_slope**2
        steps = np.clip(steps - 0.2 * step_slope / np.sqrt(step_squares), -12, 12)
    steps = tuple(steps.tolist())
    model = Crf({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.02}, float(bias), steps)
    kept = np.where(np.abs(theta) > 0.02, theta, 0.0)
    word = bias + np.bincount(rows, kept[cols], len(types.number))
    x = np.array([(1.0, *summary(m)) for m in marginals([word[read[i]] for i in apart], steps)])
    toxic = toxic[apart]
    c = np.zeros(3)
    for _ in range(30):  # Newton steps of a logistic regression with a small ridge
        p = _chance(x @ c)
        c += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (toxic - p) - 0.5 * c)
    model.curve = tuple(float(v) for v in c)
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 2000, max_chars: int = 8_000_000) -> Crf:
    """Fits to a bounded sample of labelled documents: `max_toxic` and `max_clean` of them, the smallest hashes of the id
    first, and of these, in that order, whole texts of `max_chars` characters together. Of several rows of one id the
    smallest text counts, so that no id can bring more than one."""
    known = fresh(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("o", F.xxhash64("doc_id"))
    pick = lambda t, n: known.where(F.col("toxic") == t).orderBy("o", "doc_id").limit(n)
    # At most max_toxic + max_clean rows of three numbers are broadcast.
    sample = pick(1, max_toxic).unionByName(pick(0, max_clean)).select(F.col("doc_id").alias("label_id"), "toxic", "o")
    own = fresh(docs, "doc_id", "text").where("text is not null")
    texts = own.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic", "o").agg(F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.orderBy("o", "doc_id"))  # one row for each document of the sample
    rows = texts.withColumn("chars", before).where(F.col("chars") <= max_chars).select("doc_id", "text", "toxic").toPandas()
    rows = rows.drop_duplicates("text").sort_values(["doc_id", "text"])
    model = fit(rows["text"].tolist(), rows["toxic"].to_numpy(float))
    released()
    return model


_cached: dict[str, object] = {"model": None, "scores": {}}


def forget() -> None:
    """Ends a task: the worker lives on, and other stages need its memory."""
    _cached["model"], _cached["scores"] = None, {}
    released()


def score_texts(model: Crf, texts: list[str | None]) -> list[tuple[float, np.ndarray]]:
    """Score and token log-odds of each text."""
    if _cached["model"] != model.curve or len(_cached["scores"]) > CACHE:  # type: ignore[arg-type]
        _cached["model"], _cached["scores"] = model.curve, {}
    known: dict[bytes, float] = _cached["scores"]  # type: ignore[assignment]
    split = [_words(t) for t in texts]
    flat = [w for ws in split for w in ws]
    scores = np.fromiter(map(known.get, flat, repeat(np.nan)), float, len(flat))
    new = np.flatnonzero(np.isnan(scores))
    for w in {flat[i] for i in new}:
        known[w] = model.word_score(w.decode())
    scores[new] = [known[flat[i]] for i in new]
    found = marginals(np.split(scores, np.cumsum([len(ws) for ws in split])[:-1]), model.steps)
    if model.curve is None:
        return [(0.0, m) for m in found]
    c = np.array(model.curve)
    x = np.array([(1.0, *summary(m)) for m in found]).reshape(-1, 3)
    return list(zip(_chance(x @ c).tolist(), found))


def _words(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks; bytes.split knows exactly these."""
    return text.encode().split() if text else []


def spans(text: str | None, log_odds: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets of the runs of tokens that are likelier toxic than not."""
    likely = log_odds > 0
    if not likely.any():
        return []
    out: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(re.finditer(WORD, text or "")):
        if likely[i]:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = i
    return out


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about 6 million characters; a step of forward-backward serves all their documents."""
    texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
    for a, b in in_groups(texts, 6_000_000):
        yield batch.slice(a, b - a), texts[a:b]


def score(docs: DataFrame, model: Crf, limit: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, spans for every row of `docs`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, 1):
                found = score_texts(shared.value, texts)
                marked = [[{"begin": x, "end": y} for x, y in spans(t, m)] for t, (_, m) in zip(texts, found)]
                values = [s for s, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.float64()), pa.array([int(s >= limit) for s in values], pa.int32()), pa.array(marked, span)], ["doc_id", "score", "predicted", "spans"])
        forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return fresh(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<begin: bigint, end: bigint>>")


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.7, **options) -> DataFrame:
    """`docs` without the rows whose score reaches `limit`; the columns stay. The row is judged where it is read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, at):
                yield part.filter(pa.array([s < limit for s, _ in score_texts(shared.value, texts)], pa.bool_()))
        forget()

    return docs.mapInArrow(run, docs.schema)
