"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words and one end for each document.  The frequent ones are the model's vocabulary,
in classes of equal size; every other token is the outcome ``other``, followed by a unigram over
all other words of the corpus.  The network is trained by truncated backpropagation through time on
every token of every training document: in each of a few rounds the tasks start from the same
weights, train on their own documents of that round, and the weights are averaged by tokens.  Its
state runs on from window to window until a document ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.scratch import save
from pathweave.llm.words import Words, chunks, reusing, utf8
from pathweave.session import ship_package

#: Words in the vocabulary, words in a class, and units of the network.
VOCABULARY, CLASS, UNITS = 4096, 64, 32
#: Words with at least 1 / FREQUENT of all tokens are known to every worker: at most FREQUENT
#: words of 16 bytes.  The counts of others are joined.
FREQUENT = 1 << 21
#: Rounds of training; each training document teaches in one of them.
ROUNDS = 4
#: Streams and window of training, and of scoring; with fewer streams windows are longer.
TRAIN_STREAMS, TRAIN_WINDOW = 384, 20
STREAMS, WINDOW = 512, 24
#: A task of a round of training has about so many tokens; a worker trains on, and scores, the
#: documents of at most about so many together.
TASK_TOKENS, TRAIN_GROUP, GROUP_TOKENS = 3_000_000, 5_000_000, 5_000_000
#: Pieces in which the weights are averaged.
PIECES = 32
#: Tokens whose classes' scores are worked on together, so that they stay in a core's cache.
BLOCK = 1024
#: Scores whose exponentials need no scaling.
SMALL = 60.0
#: An input word that a window has so often is summed up by itself.
LARGE = 24

#: The end of a document among word hashes.
END = np.uint64(0x5851F42D4C957F2D)


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's end after its words, and where each text starts."""
    n = len(words.first) - 1
    out = np.insert(words.hash, words.first[1:], END)
    return out, words.first + np.arange(n + 1)


def token_counts(docs: DataFrame) -> DataFrame:
    """``hash, total, train``: each token's number in all and in the training documents.

    Counts are summed up within a task before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hashes, inverse = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            sums = [np.bincount(inverse, np.concatenate([k[i] for k in kept]), len(hashes)).astype(np.int64) for i in (1, 2)]
            return hashes, *sums

        def batch_of(hashes: np.ndarray, total: np.ndarray, train: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(total), pa.array(train)], ["hash", "total", "train"])

        for batch in chunks(batches):
            tokens, first = with_ends(Words(*utf8(batch.column(2))))
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            hashes, inverse, total = np.unique(tokens, return_inverse=True, return_counts=True)
            kept.append((hashes, total, np.bincount(inverse[train], minlength=len(hashes))))
            if sum(len(k[0]) for k in kept) > 1_500_000:
                kept = [merged()]
                if len(kept[0][0]) > 1_000_000:
                    yield batch_of(*kept.pop())
        if kept:
            yield batch_of(*merged())

    ship_package(docs.sparkSession)
    parts = _source(docs).mapInArrow(reusing(run), "hash long, total long, train long")
    return parts.groupBy("hash").agg(F.sum("total").alias("total"), F.sum("train").alias("train"))


def row_sums(values: np.ndarray, by: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums (layers x groups x k) of the rows of ``values`` (layers x rows x k): group j has the
    rows ``by[first[j]:first[j + 1]]``.

    Large groups are summed one by one, small ones together: their first rows, second rows, ...
    """
    sizes = np.diff(np.append(first, len(by)))
    order = np.argsort(-sizes, kind="stable")
    large = int(np.searchsorted(-sizes[order], -LARGE, side="right"))
    start, left = first[order], -sizes[order]
    out = np.empty((len(values), len(first), values.shape[2]), dtype=values.dtype)
    ones = np.ones(-left[0] if len(left) else 0, dtype=values.dtype)
    for j in range(large):
        out[:, j] = ones[: -left[j]] @ values.take(by[start[j] : start[j] - left[j]], axis=1)
    out[:, large:] = values.take(by[start[large:]], axis=1)
    for i in range(1, -left[large] if large < len(left) else 0):
        stop = int(np.searchsorted(left, -i, side="left"))
        out[:, large:stop] += values.take(by[start[large:stop] + i], axis=1)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.take(back, axis=1)


def squash(x: np.ndarray) -> None:
    """Each value x becomes x / sqrt(1 + x * x), from -1 to 1, in place; its slope is then
    (1 - y * y) ** 1.5.  It stands for the hyperbolic tangent, which takes some four times as long."""
    root = x * x
    root += 1
    np.sqrt(root, out=root)
    x /= root


class Network:
    """A gated recurrent unit over token ids with a class-factored softmax; gates and candidates
    go through :func:`squash`.

    Ids 0 to ``size - 1`` are the vocabulary, ``size`` is ``other``; id i is in class i // CLASS,
    and ``other`` is a class of its own.  Weights: ``e`` input rows for the update gate, reset
    gate and candidate; ``u`` the same of the state; ``c``, ``d`` classes; ``w``, ``b`` words.
    """

    def __init__(self, counts: np.ndarray, other: float, units: int = UNITS, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.size, self.units, self.tokens = len(counts), units, int(counts.sum() + other)
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.turn = 0
        self.classes = -(-self.size // CLASS)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        padded = np.zeros(self.classes * CLASS)
        padded[: self.size] = counts + 1.0
        mass = np.append(padded.reshape(-1, CLASS).sum(axis=1), other + 1.0)
        with np.errstate(divide="ignore"):
            words = np.maximum(np.log(padded), -30.0).reshape(-1, CLASS).astype(np.float32)
        self.p = {
            "e": draw(self.size + 1, 3 * units), "u": draw(units, 3 * units),
            "c": draw(units, self.classes + 1), "d": np.log(mass / mass.sum()).astype(np.float32),
            "w": draw(self.classes, units, CLASS) * np.float32(0.3), "b": words,
        }
        # places past the vocabulary's end are never an outcome
        self.void = np.zeros((self.classes, CLASS), dtype=np.float32)
        self.void.reshape(-1)[self.size :] = -1e9

    def by_gate(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ``e`` or ``u`` as 3 x rows x units, each gate's values side by side; those of
        the two gates halved, as a gate is (squash(x / 2) + 1) / 2."""
        out = np.ascontiguousarray(rows.reshape(len(rows), 3, self.units).transpose(1, 0, 2))
        out[:2] *= 0.5
        return out

    def cell(self, x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after ``h``, the gates, the candidate, and the candidate's part from ``h``;
        ``x`` and ``u`` are :meth:`by_gate`."""
        rec = h @ u
        gates = rec[:2]
        gates += x[:2]
        squash(gates)
        gates *= 0.5
        gates += 0.5
        new = gates[1] * rec[2]
        new += x[2]
        squash(new)
        state = h - new
        state *= gates[0]
        state += new
        return state, gates, new, rec[2]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.cell(self.by_gate(x), h, self.by_gate(self.p["u"]))

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The targets' classes, the order that sorts them, and where each class starts in it."""
        group = (target // CLASS).astype(np.uint16)
        group[target == self.size] = self.classes
        order = np.argsort(group, kind="stable")
        group = group[order]
        return group.astype(np.int64), order, np.searchsorted(group, np.arange(self.classes + 1))

    def biases(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Biases of classes and words, less the largest, and whether scores stay so small that
        exponentials of them can be summed as they are: states are from -1 to 1."""
        most = max(float(np.abs(self.p["c"]).sum(axis=0).max()), float(np.abs(self.p["w"]).sum(axis=1).max(initial=0)))
        words = self.p["b"] + self.void
        return self.p["d"] - self.p["d"].max(), words - words.max(axis=1, keepdims=True), most < SMALL

    def words_of(self, h: np.ndarray, bounds: np.ndarray, bias: np.ndarray, small: bool) -> np.ndarray:
        """Scores of the words in each state's class; states are sorted by class."""
        z = np.empty((bounds[-1], CLASS), dtype=h.dtype)
        for i in range(self.classes):
            if bounds[i] < bounds[i + 1]:
                part = z[bounds[i] : bounds[i + 1]]
                np.matmul(h[bounds[i] : bounds[i + 1]], self.p["w"][i], out=part)
                part += bias[i]
        if not small:
            z -= z.max(axis=1, keepdims=True)
        return z

    def classes_of(self, h: np.ndarray, bias: np.ndarray, small: bool) -> np.ndarray:
        """Scores of the classes after states ``h``."""
        z = h @ self.p["c"]
        z += bias
        if not small:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities after states ``h``."""
        group, order, bounds = self.by_class(target)
        h, m = h.take(order, axis=0), bounds[-1]
        d, b, small = self.biases()
        found = np.empty(len(h), dtype=h.dtype)
        for start in range(0, len(h), BLOCK):
            rows = slice(start, start + BLOCK)
            z = self.classes_of(h[rows], d, small)
            found[rows] = z[np.arange(len(z)), group[rows]]
            found[rows] -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
        z = self.words_of(h, bounds, b, small)
        at = target[order[:m]] - group[:m] * CLASS
        found[:m] += z[np.arange(m), at]
        found[:m] -= np.log(np.exp(z, out=z) @ np.ones(CLASS, z.dtype))
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def _errors(z: np.ndarray, want: np.ndarray, n: int) -> float:
        """Make scores the gradients of the mean loss of ``n`` tokens; returns the loss of these."""
        place = np.arange(len(z))
        np.exp(z, out=z)
        mass = z @ np.ones(z.shape[1], dtype=z.dtype)
        loss = float(np.log(mass).sum() - np.log(z[place, want] + 1e-30).sum())
        z[place, want] -= mass
        z *= (1 / (n * mass))[:, None]
        return loss

    def gradients(self, ids: np.ndarray, target: np.ndarray, reset: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> tuple[float, dict, np.ndarray]:
        """Loss (nats a token), gradients and last state of a window (steps x streams); of ``e`` for
        its ``rows`` only.  Places that are not ``live`` lie behind a stream's end."""
        p, k, (steps, streams) = self.p, self.units, ids.shape
        kind = np.result_type(h, p["u"])
        # the window's input words, each once
        rows = ids.reshape(-1)
        by = np.argsort(rows.astype(np.uint16) if self.size < 1 << 16 else rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[by], prepend=-1))
        at = np.empty_like(by)
        at[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        rows = rows[by[first]]
        x = self.by_gate(p["e"].take(rows, axis=0)).take(at, axis=1).reshape(3, steps, streams, k)
        u = self.by_gate(p["u"])
        starts = [np.flatnonzero(r) for r in reset]
        before, states = np.empty((2, steps, streams, k), dtype=kind)
        tape = []
        for t in range(steps):
            before[t] = h
            before[t, starts[t]] = 0
            states[t], *kept = self.cell(x[:, t], before[t], u)
            tape.append(kept)
            h = states[t]
        flat, want = states.reshape(-1, k), target.reshape(-1)
        there = np.arange(len(want)) if live is None or live.all() else np.flatnonzero(live.reshape(-1))
        n = len(there)
        # all that follows is in the order of the targets' classes
        group, order, bounds = self.by_class(want[there])
        there, m = there[order], bounds[-1]
        flat, want = flat.take(there, axis=0), want[there]
        d, b, small = self.biases()
        g = {"w": np.zeros_like(p["w"]), "b": np.zeros_like(p["b"]), "c": np.zeros_like(p["c"]), "d": np.zeros_like(p["d"])}
        back, loss = np.empty_like(flat), 0.0
        for start in range(0, n, BLOCK):
            part = slice(start, start + BLOCK)
            z = self.classes_of(flat[part], d, small)
            loss += self._errors(z, group[part], n)
            g["c"] += flat[part].T @ z
            g["d"] += np.ones(len(z), kind) @ z
            np.matmul(z, p["c"].T, out=back[part])
        z = self.words_of(flat, bounds, b, small)
        loss += self._errors(z, want[:m] - group[:m] * CLASS, n)
        ones = np.ones(m, dtype=kind)
        for i in range(self.classes):
            if bounds[i] < bounds[i + 1]:
                part = slice(bounds[i], bounds[i + 1])
                np.matmul(flat[part].T, z[part], out=g["w"][i])
                np.matmul(ones[part], z[part], out=g["b"][i])
                back[part] += z[part] @ p["w"][i].T
        whole = np.zeros((steps * streams, k), dtype=kind)
        whole[there] = back
        whole = whole.reshape(steps, streams, k)
        # gradients of what goes into the gates and the candidate; x is free now
        dx, gu = x, np.zeros((3, k, k), dtype=kind)
        ut = np.ascontiguousarray(p["u"].reshape(k, 3, k).transpose(1, 2, 0))
        carry = np.zeros((streams, k), dtype=kind)
        for t in range(steps - 1, -1, -1):
            (update, keep), new, rec = tape[t]
            dh, (du, dk, dn) = whole[t], dx[:, t]
            dh += carry
            rest = 1 - update
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= np.sqrt(dn)
            dn *= rest
            dn *= dh
            # a gate's slope is 2 * (gate * (1 - gate)) ** 1.5
            rest *= update
            rest *= np.sqrt(rest)
            rest += rest
            np.subtract(before[t], new, out=du)
            du *= dh
            du *= rest
            np.subtract(1, keep, out=dk)
            dk *= keep
            dk *= np.sqrt(dk)
            dk += dk
            dk *= rec
            dk *= dn
            dr = np.multiply(dn, keep, out=rec)
            left = before[t].T
            gu[0] += left @ du
            gu[1] += left @ dk
            gu[2] += left @ dr
            carry = dh
            carry *= update
            carry += du @ ut[0]
            carry += dk @ ut[1]
            carry += dr @ ut[2]
            carry[starts[t]] = 0
        g["u"] = gu.transpose(1, 0, 2).reshape(k, 3 * k)
        g["e"] = row_sums(dx.reshape(3, -1, k), by, first).transpose(1, 0, 2).reshape(-1, 3 * k)
        g["rows"] = rows
        return loss / n, g, h

    def fit(self, documents: list[np.ndarray], end: int, rate: float = 0.01) -> tuple[int, list[float]]:
        """Truncated backpropagation over every token of the documents, in streams.

        Returns the number of tokens and the windows' losses.  Later calls go on with the same
        moments.
        """
        if not documents:
            return 0, []
        flow = Streams(documents, end, TRAIN_STREAMS)
        losses, tokens = [], 0
        h = np.zeros((len(flow.length), self.units), dtype=np.float32)
        for place, live in flow.windows(TRAIN_WINDOW, TRAIN_STREAMS * TRAIN_WINDOW // 2):
            n = place.shape[1]
            loss, g, h[:n] = self.gradients(flow.ids[place], flow.target[place], flow.reset[place], h[:n], live)
            losses.append(float(loss))
            tokens += int(live.sum())
            self.descend(g, rate)
        return tokens, losses

    def descend(self, g: dict[str, np.ndarray], rate: float) -> None:
        """A step of gradient descent with moments, the gradient's length at most 1."""
        if not self.moments:
            self.moments.update({name: (np.zeros_like(v), np.zeros_like(v)) for name, v in self.p.items()})
        self.turn += 1
        rows = g.pop("rows")
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        scale, rate = min(1.0, 1.0 / (norm + 1e-9)), rate * min(1.0, self.turn / 10)
        # moments start at 0; the roots are of the second one over this
        full = np.sqrt(1 - 0.99**self.turn)
        for name, v in g.items():
            # input words that the window doesn't have stay as they are
            v = v.astype(np.float32, copy=False)
            m, s = (x[rows] if name == "e" else x for x in self.moments[name])
            m *= np.float32(0.9)
            m += v * np.float32(0.1 * scale)
            v *= v
            v *= np.float32(0.01 * scale * scale)
            s *= np.float32(0.99)
            s += v
            np.sqrt(s, out=v)
            v += np.float32(1e-6 * full)
            np.divide(m, v, out=v)
            v *= np.float32(rate * full / (1 - 0.9**self.turn))
            if name == "e":
                self.moments[name][0][rows], self.moments[name][1][rows] = m, s
                self.p[name][rows] -= v
            else:
                self.p[name] -= v

    def __getstate__(self) -> dict:
        """What workers get: no moments."""
        return self.__dict__ | {"moments": {}, "turn": 0}


class Streams:
    """Documents (ids, the end last) dealt to streams of similar length, the longest stream first.

    ``ids``, ``target``, ``reset`` and ``document`` have a place for each token, stream after
    stream; a stream's tokens start at ``start`` and are ``length`` many.  The input before a
    document's first token is the end, and the state is reset there.  Memory is in proportion to
    the tokens, whatever a document's length.
    """

    def __init__(self, documents: list[np.ndarray], end: int, streams: int):
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        heap = [(0, i) for i in range(max(1, min(streams, len(documents))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, s = heapq.heappop(heap)
            dealt[s].append(i)
            heapq.heappush(heap, (size + int(sizes[i]), s))
        length = np.array([sizes[d].sum() for d in dealt], dtype=np.int64)
        by = np.argsort(-length, kind="stable")
        order = [i for s in by for i in dealt[s]]
        self.length = length[by]
        self.start = np.cumsum(self.length) - self.length
        self.target = np.concatenate([documents[i] for i in order]).astype(np.int64)
        self.document = np.repeat(order, sizes[order])
        first = np.cumsum(sizes[order]) - sizes[order]
        self.ids = np.roll(self.target, 1)
        self.ids[first] = end
        self.reset = np.zeros(len(self.ids), dtype=bool)
        self.reset[first] = True

    def windows(self, least: int, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (steps x streams that go on) of one window after another, and which lie before
        their stream's end; at least ``least`` steps, more while few streams are left."""
        at, longest = 0, int(self.length.max(initial=0))
        while at < longest:
            n = int(np.searchsorted(-self.length, -at, side="left"))
            step = np.arange(at, min(longest, at + max(least, tokens // n)))[:, None]
            live = step < self.length[:n]
            yield np.where(live, self.start[:n] + step, self.start[:n]), live
            at = int(step[-1, 0]) + 1


def score_documents(net: Network, documents: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each document, the state carried through all its windows."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    flow = Streams(documents, end, STREAMS)
    table, u, h = net.by_gate(net.p["e"]), net.by_gate(net.p["u"]), np.zeros((len(flow.length), net.units), dtype=np.float32)
    for place, live in flow.windows(WINDOW, STREAMS * WINDOW // 4):
        states = []
        count = live.sum(axis=1)
        for t, n in enumerate(count):
            now = place[t, :n]
            h[:n][flow.reset[now]] = 0
            states.append(net.cell(table.take(flow.ids[now], axis=1), h[:n], u)[0])
            h[:n] = states[-1]
        now = place[live]
        total += np.bincount(flow.document[now], net.log_probabilities(np.concatenate(states), flow.target[now]), len(documents))
    return total


class Lookup:
    """Counts and ids of the frequent tokens, by hash."""

    def __init__(self, hashes: np.ndarray, train: np.ndarray, vocabulary: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.train = hashes[order], train[order]
        self.id = np.full(len(hashes), len(vocabulary), dtype=np.int64)
        self.id[np.searchsorted(self.hash, vocabulary)] = np.arange(len(vocabulary))
        self.other = len(vocabulary)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its id, the log10 of its training count and one, and whether it is frequent."""
        uniq, inverse = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, uniq), len(self.hash) - 1)
        known = self.hash[at] == uniq
        return np.where(known, self.id[at], self.other)[inverse], np.log10(np.where(known, self.train[at], 0) + 1.0)[inverse], known[inverse]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def encode(docs: DataFrame, lookup: Lookup, log_z: float, log_other: float) -> DataFrame:
    """Each row's whole text as ids of two bytes, with the sums that its known words need.

    ``base`` and ``extra`` are the parts of both scores that frequent words make; ``rare`` has
    the hashes of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, first = with_ends(Words(*utf8(batch.column(2))))
            ids, logs, frequent = lookup.find(tokens)
            sizes = np.diff(first)
            outside = ids == lookup.other
            base = _per_text(logs, first) - sizes * log_z
            extra = _per_text(np.where(outside, logs, 0.0), first) - _per_text(outside, first) * log_other
            where = np.flatnonzero(~frequent)
            owner, words = np.searchsorted(first, where, side="right") - 1, tokens[where]
            by = np.lexsort((words, owner))
            owner, words = owner[by], words[by]
            change = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (words[1:] != words[:-1]))[: len(words)])
            times = np.diff(np.append(change, len(words)))
            pairs = pa.StructArray.from_arrays([pa.array(words[change].view(np.int64)), pa.array(times)], fields=list(_RARE.value_type))
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[change], np.arange(len(sizes) + 1)), pa.int32()), pairs, type=_RARE)
            known = _per_text(logs > 0, first).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(2 * first.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
            arrays = [pa.array(sizes), pa.array(known), pa.array(base), pa.array(extra), rare, packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "base", "extra", "rare", "ids"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, extra double, rare array<struct<hash:long,n:long>>, ids binary"
    return _source(docs).mapInArrow(reusing(run), schema).withColumn("row", F.monotonically_increasing_id())


def _groups(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """The rows of each batch in groups of at most about so many tokens, by the column ``ids``, and
    of about the same size; a longer text is a group of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy() // 2)
        whole = int(ends[-1]) if len(ends) else 0
        most = -(-whole // max(1, -(-whole // tokens)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _documents(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def _lessons(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[np.ndarray]]:
    """The texts in groups of about so many tokens, over batches' ends."""
    kept: list[np.ndarray] = []
    size = 0
    for group in _groups(batches, tokens):
        more = _documents(group)
        n = sum(map(len, more))
        if kept and size + n > tokens:
            yield kept
            kept, size = [], 0
        kept += more
        size += n
    if kept:
        yield kept


def train(encoded: DataFrame, net: Network, end: int) -> int:
    """Train the network on every row of ``encoded`` that is not held out; returns the tokens.

    Partitions are joined until a task has some ``TASK_TOKENS`` in a round: with few texts at once,
    most steps are those of the longest ones alone.
    The weights that tasks give out are averaged, weighted by their tokens, in ``PIECES`` pieces
    by as many tasks; the driver gets the pieces of one network only.
    """
    names, done = sorted(net.p), 0
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-net.tokens // (ROUNDS * TASK_TOKENS * cores)))
    shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(ROUNDS))

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for piece, n, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = total.setdefault(piece, [0, 0.0])
                entry[0] += n
                entry[1] = entry[1] + n * np.frombuffer(weights, np.float32).astype(np.float64)
        if total:
            rows = [(k, n, (w / n).astype(np.float32).tobytes()) for k, (n, w) in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["piece", "n", "weights"])

    for turn in range(ROUNDS):
        rate = 0.01 * (1 - 0.8 * turn / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], rate: float = rate) -> Iterator[pa.RecordBatch]:
            tokens = 0
            for documents in _lessons(batches, TRAIN_GROUP):
                tokens += net.fit(documents, end, rate)[0]
            if tokens:
                flat = np.array_split(np.concatenate([net.p[k].reshape(-1) for k in names]), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([tokens] * PIECES, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in flat], pa.binary())], ["piece", "n", "weights"])

        lessons = encoded.where(~F.col("held_out") & (shard == turn)).select("ids").coalesce(tasks)
        parts = lessons.mapInArrow(reusing(run), "piece int, n long, weights binary").repartition(PIECES, "piece")
        found = sorted(parts.mapInArrow(average, "piece int, n long, weights binary").collect())
        if found:
            flat, at = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in found]), 0
            for k in names:
                net.p[k] = flat[at : at + net.p[k].size].reshape(net.p[k].shape).copy()
                at += net.p[k].size
            done += found[0]["n"]
    return done


def score_likelihood(docs: DataFrame, scope: str = "query") -> DataFrame:
    """Score the whole text of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; both scores
    are log10.  Rows that are held out teach nothing.  Null and empty texts are the end alone;
    null doc_ids are not held out; repeated rows count as often as they stand there; an empty
    table gives an empty result; without any training document every token is unknown.  A text of
    any length is one stream; memory is in proportion to its tokens.

    Words below the frequent ones are joined with their counts; no such word has more than
    1 / FREQUENT of the tokens, so no key of that join is hot.
    """
    spark = docs.sparkSession
    counts = save(token_counts(docs), "counts", scope)
    facts = counts.agg(F.sum("total").alias("total"), F.sum("train").alias("n"), F.sum((F.col("train") > 0).cast("long")).alias("v")).first()
    total, n, v = (int(x or 0) for x in facts)
    least = max(1, -(-total // FREQUENT))
    # at most FREQUENT rows, as their counts sum up to the corpus
    found = counts.where(F.col("total") >= least).select("hash", "train").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    train_counts = found.column("train").to_numpy().astype(np.int64)
    if END not in hashes:
        hashes, train_counts = np.append(hashes, END), np.append(train_counts, 0)
    # words that training documents don't have are no part of the vocabulary
    order = np.lexsort((hashes, -train_counts))[:VOCABULARY]
    order = order[train_counts[order] > 0]
    if not (hashes[order] == END).any():
        order = np.append(order[: VOCABULARY - 1], np.flatnonzero(hashes == END)[0])
    vocabulary = hashes[order]
    inside = int(train_counts[order].sum())
    other_n, other_v = n - inside, v - int((train_counts[order] > 0).sum())
    net = Network(train_counts[order].astype(np.float64), float(other_n))
    end = int(np.flatnonzero(vocabulary == END)[0])
    ship_package(spark)
    log_z, log_other = float(np.log10(n + v + 1)), float(np.log10(other_n + other_v + 1))
    encoded = save(encode(docs, Lookup(hashes, train_counts, vocabulary), log_z, log_other), "encoded", scope)
    train(encoded, net, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GROUP_TOKENS):
            logs = score_documents(net, _documents(group), end) / np.log(10)
            kept = [group.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")]
            score = pa.array(logs + group.column("extra").to_numpy())
            yield pa.RecordBatch.from_arrays([*kept, score], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    rows = encoded.drop("rare").mapInArrow(reusing(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    pairs = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.hash", "r.n")
    uncommon = counts.where((F.col("total") < least) & (F.col("train") > 0)).select("hash", "train")
    sums = pairs.join(uncommon, "hash").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("train") + 1.0)).alias("more"), F.sum("n").alias("more_known")
    )
    out = rows.join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


_RARE = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
