"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two spans sums, over all subsequences of three characters that lie within
``REACH`` of each other, products of ``DECAY`` to the power of the lengths they stretch over, so
gaps and inserted characters weaken a match without breaking it.  A document is a bag of
sentences and a sentence a bag of spans: words, pieces of very long words, and runs of single
characters.  The machine scores spans; a document's score is a logistic function of its
``WORST`` worst ones.

With landmarks l_j, K their kernel matrix and w the machine's weights over the Nyström features
K^(-1/2) k(s), the decision is linear in the subsequences of s.  Scoring therefore needs one
weight for each of the 64^3 subsequences, whatever the number of landmarks.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.words import Words, chunks, utf8
from pathweave.session import ship_package

#: Documents of each label that the machine may learn from: a bound, those with the least hash of
#: doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 3000
#: Bounds on what the fit takes from these: witnesses of a text, cues, the commonest and any other
#: clean spans, and the clean spans that are disguised or that a round finds worst.
WITNESSES, CUES, COMMON, ORDINARY, HARD = 8, 600, 2000, 6000, 1500
LANDMARKS = 96
DECAY, REACH = 0.7, 8
#: Longer words are scored in overlapping pieces of so many bytes.
PIECE = 32
#: Spans that a worker remembers scores of.
MEMO = 1_500_000
THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[ord("0") : ord("9") + 1] = np.arange(27, 37)
# of a character beyond ASCII its last bytes count
_CLASS[0x80:0xC0] = 37 + np.arange(64) % 27
_STEPS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]
#: Length of the runs of bytes that point out a toxic text's first witnesses.
GRAM = 4
#: Spans that a document's score looks at, and the range to which their decisions are clipped.
WORST, FLOOR, CEILING = 3, -0.5, 2.0


def _padded(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of the spans, ``REACH`` zeros after each, and where each starts."""
    sizes = np.array([len(s) for s in spans], dtype=np.int64) + REACH
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    gap = b"\0" * REACH
    return _CLASS[np.frombuffer(gap.join(spans) + gap + gap, dtype=np.uint8)], start


def _norms(classes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The length of each span's feature vector, as if its subsequences all differed."""
    there = (classes > 0).astype(np.float32)
    n = len(classes) - REACH
    total = np.zeros(n, dtype=np.float32)
    for a, b in _STEPS:
        total += np.float32(DECAY ** (2 * (b + 1))) * there[:n] * there[a : a + n] * there[b : b + n]
    return np.sqrt(np.add.reduceat(total, start)) + 1e-6


def _triples(classes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each way to stretch, its weight and the subsequence at each place (0: none)."""
    n = len(classes) - REACH
    for a, b in _STEPS:
        x, y, z = classes[:n], classes[a : a + n], classes[b : b + n]
        yield DECAY ** (b + 1), np.where((x > 0) & (y > 0) & (z > 0), (x << 12) | (y << 6) | z, 0)


def decide(spans: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each span; ``table`` has the subsequences' weights."""
    if not spans:
        return np.zeros(0, dtype=np.float32)
    classes, start = _padded(spans)
    n = len(classes) - REACH
    total = np.zeros(n, dtype=np.float32)
    for weight, triple in _triples(classes):
        total += np.float32(weight) * table[triple]
    return np.add.reduceat(total, start) / _norms(classes, start) + np.float32(bias)


def features(spans: list[bytes], known: np.ndarray) -> np.ndarray:
    """Normalised feature vectors over the subsequences in ``known`` (sorted)."""
    out = np.zeros((len(spans), len(known)), dtype=np.float32)
    place = np.full(64**3, -1, dtype=np.int64)
    place[known] = np.arange(len(known))
    for at in range(0, len(spans), 400):
        part = spans[at : at + 400]
        classes, start = _padded(part)
        owner = np.repeat(np.arange(len(part)), np.diff(np.append(start, len(classes) - REACH)))
        flat = np.zeros(len(part) * len(known))
        for weight, triple in _triples(classes):
            column = np.where(triple > 0, place[triple], -1)
            hit = np.flatnonzero(column >= 0)
            flat += weight * np.bincount(owner[hit] * len(known) + column[hit], minlength=len(flat))
        out[at : at + len(part)] = flat.reshape(len(part), -1) / _norms(classes, start)[:, None]
    return out


def pieces(word: bytes) -> list[bytes]:
    """The word, or its overlapping pieces if it is very long."""
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def single_runs(words: Words) -> Iterator[tuple[int, bytes]]:
    """Runs of four or more words of one byte, joined: (first word, span)."""
    one = words.end - words.start == 1
    if not one.any():
        return
    text = np.searchsorted(words.first, np.arange(len(one)), side="right")
    joined = one[1:] & one[:-1] & (text[1:] == text[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= 3:
            letters = words.data[words.start[a : b + 1]].tobytes()
            # a long run of one letter says nothing
            if len(set(letters)) > 2:
                yield a, letters


def spans_of(text: str) -> set[bytes]:
    """The spans of a text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    raw = words.data.tobytes()
    out = {p for a, b in zip(words.start, words.end, strict=True) for p in pieces(raw[a:b])}
    return out | {p for _, run in single_runs(words) for p in pieces(run)}


def _kernel_root(landmarks: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, c = x[active], cost * weight[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, xa.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def disguises(span: bytes, rng: random.Random) -> list[bytes]:
    """The span with characters inserted or doubled."""
    gaps = b".-_* '"
    i = rng.randrange(1, len(span)) if len(span) > 1 else 1
    mark = bytes([rng.choice(gaps)])
    return [span[:i] + mark + span[i:], mark.join(span[k : k + 1] for k in range(len(span))), span[:i] + span[i - 1 : i] + span[i:], span[:i] + bytes([rng.randrange(97, 123)]) + span[i:]]


class Model:
    """What workers need: subsequence weights, bias, and the logistic function's weights."""

    def __init__(self, table: np.ndarray, bias: float, logistic: np.ndarray):
        self.table, self.bias, self.logistic = table, bias, logistic

    def score(self, worst: np.ndarray) -> np.ndarray:
        """Scores from the worst decisions of each document (documents x ``WORST``)."""
        return 1 / (1 + np.exp(-np.clip(worst @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def worst_decisions(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` documents its ``WORST`` largest values, clipped, largest first."""
    out = np.full((n, WORST), FLOOR)
    at = np.flatnonzero(values > FLOOR)
    if len(at):
        order = at[np.lexsort((-values[at], owner[at]))]
        who = owner[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < WORST
        out[who[top], place[top]] = np.minimum(values[order[top]], CEILING)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton steps; weights are never
    negative, so that a worse span never lowers a score."""
    x = np.hstack([x, np.ones((len(x), 1))])
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w[use], -30, 30)))
            ridge = np.full(use.sum(), 0.05)
            step = np.linalg.solve((x[:, use] * (p * (1 - p) + 1e-9)[:, None]).T @ x[:, use] + np.diag(ridge), x[:, use].T @ (y - p) - ridge * w[use])
            w[use] += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            return w
        use[:-1] &= w[:-1] > 0


def _fresh(texts: list[str]) -> list[list[bytes]]:
    """The spans of each text, without texts that share much with an earlier one.

    A text's sketch is the 16 smallest hashes of its longer spans; five in common are a copy.
    """
    seen: dict[int, list[int]] = {}
    out = []
    for text in sorted(set(texts)):
        spans = sorted(spans_of(text))
        sketch = sorted(zlib.crc32(s) for s in spans if len(s) >= 6)[:16]
        shared: dict[int, int] = {}
        for h in sketch:
            for k in seen.get(h, []):
                shared[k] = shared.get(k, 0) + 1
        if max(shared.values(), default=0) < 5:
            for h in sketch:
                seen.setdefault(h, []).append(len(out))
            out.append(spans)
    return out


def _grams(span: bytes) -> list[bytes]:
    """Runs of bytes anywhere in a span, its beginnings, and the span."""
    runs = [span[i : i + GRAM] for i in range(max(1, len(span) - GRAM + 1))]
    return [*runs, *[b"^" + span[:k] for k in range(GRAM + 1, min(9, len(span)))], b"^" + span + b"$"]


def _evidence(toxic: list[list[bytes]], clean: list[list[bytes]]) -> dict[bytes, float]:
    """How far the toxic texts with a run exceed, in standard deviations, the number that the
    clean ones' share suggests; runs less than four times as frequent have none."""
    counts: list[dict[bytes, int]] = [{}, {}]
    memo: dict[bytes, list[bytes]] = {}
    for k, bags in enumerate((toxic, clean)):
        for bag in bags:
            seen: set[bytes] = set()
            for s in bag:
                if s not in memo:
                    memo[s] = _grams(s)
                seen.update(memo[s])
            for g in seen:
                counts[k][g] = counts[k].get(g, 0) + 1
    part = len(toxic) / max(1, len(clean))
    expected = {g: counts[1].get(g, 0) * part for g in counts[0]}
    return {g: (t - expected[g]) / np.sqrt(expected[g] + 1) for g, t in counts[0].items() if t >= max(2, 4 * expected[g])}


def train(toxic: list[str], clean: list[str], seed: int = 3) -> Model:
    """Learn from texts of both labels.

    Every sentence of a clean text is a negative.  Of a toxic text at least one sentence is a
    positive, and which spans make it so is learned: at first those with the runs of characters
    that speak most for the label, then, in rounds of fitting and choosing, those among them
    that the machine finds worst.  Copies of a text count once, so that chance words of
    much-copied texts aren't mistaken for cues.
    """
    rng = random.Random(seed)
    bags, plain_bags = _fresh(toxic), _fresh(clean)
    empty = Model(np.zeros(64**3, np.float32), -1.0, np.append(np.ones(WORST), -4.0))
    plain: dict[bytes, int] = {}
    for bag in plain_bags:
        for s in bag:
            plain[s] = plain.get(s, 0) + 1
    evidence = _evidence(bags, plain_bags)
    strength = lambda s: max((evidence.get(g, 0.0) for g in _grams(s)), default=0.0)
    toxic_share: dict[bytes, int] = {}
    for bag in bags:
        for s in bag:
            toxic_share[s] = toxic_share.get(s, 0) + 1
    # a span that clean texts have must be far more frequent in toxic ones
    fits = lambda s: toxic_share[s] >= 8 * plain.get(s, 0)
    bags = [sorted(((strength(s), s) for s in bag if fits(s)), reverse=True) for bag in bags]
    share: dict[bytes, int] = {}
    chosen = []
    for bag in bags:
        # the strongest spans of a text
        picked = [s for v, s in bag[:WITNESSES] if v >= 3.0 and v >= 0.4 * bag[0][0]]
        chosen.append(picked)
        for s in picked:
            share[s] = share.get(s, 0) + 1
    if not share or not plain:
        return empty
    ordinary = sorted(s for s in plain if s not in share)
    rng.shuffle(ordinary)
    # the commonest clean spans, and any others
    common = sorted(ordinary, key=lambda s: (-plain[s], s))[:COMMON]
    negatives = list(dict.fromkeys([*common, *ordinary[:ORDINARY]]))
    for turn in range(3):
        votes: dict[bytes, int] = {}
        for picked in chosen:
            for s in picked:
                votes[s] = votes.get(s, 0) + 1
        cues = sorted(votes, key=lambda s: (-votes[s], s))
        # one text's witness alone may be chance, unless there is little to learn from
        cues = ([s for s in cues if votes[s] > 1] if len(cues) > 60 else cues)[:CUES]
        landmarks = _spread(cues, LANDMARKS * 2 // 3)
        landmarks += ordinary[: LANDMARKS - len(landmarks)]
        known = np.unique(np.concatenate([t[t > 0] for _, t in _triples(_padded(landmarks)[0])]))
        if not len(known):
            return empty
        base = features(landmarks, known)
        root = _kernel_root(base)
        spans = [*cues, *[d for s in cues for d in disguises(s, rng)]]
        weight = [1.0 + np.log1p(votes[s]) for s in cues] + [0.4] * 4 * len(cues)
        positives = len(spans)
        spans += negatives + [d for s in negatives[:HARD] for d in disguises(s, rng)]
        y = np.where(np.arange(len(spans)) < positives, 1.0, -1.0)
        weight = np.append(weight, np.full(len(spans) - positives, 2 * sum(weight) / (len(spans) - positives)))
        w = _svm(features(spans, known) @ base.T @ root, y, weight, cost=10.0)
        table = np.zeros(64**3, dtype=np.float32)
        table[known] = base.T @ (root @ w[:-1])
        bias = float(w[-1])
        noise = decide(ordinary, table, bias)
        # the clean spans that the machine takes for the worst are negatives of the next round
        negatives = list(dict.fromkeys([*negatives, *[ordinary[i] for i in np.argsort(-noise, kind="stable")[:HARD]]]))
        if turn < 2:
            for k, bag in enumerate(bags):
                strong = [s for e, s in bag if e >= 3.0]
                values = decide(strong, table, bias)
                keep = np.flatnonzero((values > 0) & (values >= values.max(initial=0) - 0.7))
                chosen[k] = [strong[i] for i in keep[np.argsort(-values[keep], kind="stable")][:WITNESSES]]
    scorer = Scorer(Model(table, bias, empty.logistic))
    texts = [*sorted(set(toxic)), *sorted(set(clean))]
    y = np.arange(len(texts)) < len(set(toxic))
    x = np.concatenate([scorer.worst(pa.array(texts[k : k + 100])) for k in range(0, len(texts), 100)])
    return Model(table, bias, _logistic(x, y.astype(float)))


def _spread(cues: list[bytes], most: int) -> list[bytes]:
    """Cues in order, without those much like one that was taken."""
    known = np.unique(np.concatenate([t[t > 0] for _, t in _triples(_padded(cues)[0])] or [np.zeros(0, np.int64)]))
    if not len(known):
        return cues[:most]
    x = features(cues, known)
    taken: list[int] = []
    for limit in (0.5, 0.9):
        for i in range(len(cues)):
            if len(taken) < most and i not in taken and (not taken or float((x[taken] @ x[i]).max()) < limit):
                taken.append(i)
    return [cues[i] for i in taken]


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents that aren't held out.

    The ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` of them with the least hash of doc_id come to the driver,
    whatever order tasks end in; texts are taken whole, however long.  Rows without label, doc_id or text teach nothing; of several labels the highest
    counts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"] != 0: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    out = []
    for toxic, most in ((True, TRAIN_TOXIC), (False, TRAIN_CLEAN)):
        # a share somewhat above the bound before the order, by a hash of 53 bits
        part = min(1.0, (1.3 * most + 100) / max(1, sizes.get(toxic, 0)))
        drawn = known.where((F.col("toxic") != 0) if toxic else (F.col("toxic") == 0))
        drawn = drawn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) <= F.lit(part * (1 << 53)))
        drawn = drawn.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)), "doc_id").limit(most).select("doc_id")
        out.append(drawn.withColumn("toxic", F.lit(toxic)))
    # the sample's ids are TRAIN_TOXIC + TRAIN_CLEAN longs at most
    rows = texts.join(F.broadcast(out[0].unionAll(out[1])), "doc_id").select("toxic", "text").distinct().toArrow().to_pylist()
    return train([r["text"] for r in rows if r["toxic"]], [r["text"] for r in rows if not r["toxic"]])


class Scorer:
    """Worst decisions of whole texts; remembers the decisions of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.hash, self.value = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def _words(self, words: Words) -> np.ndarray:
        uniq, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), dtype=bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != uniq[inside]
        raw = words.data.tobytes()
        spans, owner = [], []
        for i in np.flatnonzero(new):
            for p in pieces(raw[words.start[first[i]] : words.end[first[i]]]):
                spans.append(p)
                owner.append(i)
        values = np.full(len(uniq), -np.inf, dtype=np.float32)
        values[~new] = self.value[at[~new]]
        np.maximum.at(values, owner, decide(spans, self.model.table, self.model.bias))
        if len(self.hash) > MEMO:
            self._clear()
            at, new = np.zeros(len(uniq), np.int64), np.ones(len(uniq), dtype=bool)
        self.hash = np.insert(self.hash, at[new], uniq[new])
        self.value = np.insert(self.value, at[new], values[new])
        return values[inverse]

    def worst(self, column: pa.Array) -> np.ndarray:
        """The worst decisions of each text."""
        words = Words(*utf8(column))
        n = len(words.first) - 1
        owner = np.repeat(np.arange(n), np.diff(words.first))
        runs = [(a, p) for a, run in single_runs(words) for p in pieces(run)]
        values = [self._words(words)] if len(owner) else []
        values.append(decide([p for _, p in runs], self.model.table, self.model.bias))
        return worst_decisions(np.concatenate(values), np.concatenate([owner, owner[[a for a, _ in runs]] if runs else owner[:0]]), n)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of each row's whole text.

    Null and empty texts score lowest; a text of any length is read whole, a very long word in
    overlapping pieces.  Repeated rows and ties are scored alike; null doc_ids stay null; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in chunks(batches):
            score = model.score(scorer.worst(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
