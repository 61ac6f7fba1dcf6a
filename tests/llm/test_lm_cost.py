import math

import numpy as np
import pyarrow as pa

from pathweave.llm import lm_score
from pathweave.llm.lm_score import Network


def test_short_batches_are_trained_on_together():
    """One long text in each batch: steps are those of one batch, not of all of them one after another."""
    rng = np.random.RandomState(2)
    texts = [[rng.randint(0, 9, n).astype("<u2") for n in [900, *[5] * 20]] for _ in range(8)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in b], pa.binary())], ["ids"]) for b in texts]
    groups = list(lm_score._lessons(iter(batches), 10_000))
    assert [x.tolist() for g in groups for x in g] == [x.tolist() for b in texts for x in b]
    flows = [lm_score.Streams(g, 3, lm_score.TRAIN_STREAMS) for g in groups]
    assert sum(p.shape[0] for f in flows for p, _ in f.windows(20, 4000)) == 900
    assert [len(g) for g in lm_score._lessons(iter(batches), 2_500)] == [42] * 4
    assert [len(g) for g in lm_score._lessons(iter(batches[:1]), 100)] == [1, 20]


def test_groups_of_a_batch_are_alike():
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(2)] * 105, pa.binary())], ["ids"])
    assert [g.num_rows for g in lm_score._groups(iter([batch]), 100)] == [53, 52]


def test_row_sums():
    rng = np.random.RandomState(4)
    owner = np.sort(np.concatenate([np.zeros(70, int), np.full(24, 1), rng.randint(2, 60, 200)]))
    by = rng.permutation(len(owner))
    values = rng.standard_normal((3, len(owner), 5))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    want = np.add.reduceat(values[:, by], first, axis=1)
    assert np.allclose(lm_score.row_sums(values, by, first), want)
    assert np.allclose(lm_score.row_sums(values[:, :80], np.arange(80), np.array([0])), values[:, :80].sum(axis=1, keepdims=True))
    assert np.allclose(lm_score.row_sums(values, by, np.arange(len(by))), values[:, by])


def test_large_scores_stay_finite():
    """Weights beyond what exponentials can be summed of as they are."""
    rng = np.random.RandomState(5)
    net = Network(np.ones(70), 3.0, units=4)
    net.p["c"] *= 3000
    net.p["w"] *= 9000
    h = np.tanh(rng.standard_normal((200, 4)) * 5).astype(np.float32)
    target = rng.randint(0, 71, 200)
    got = net.log_probabilities(h, target)
    for x, t, value in zip(h.astype(float), target, got, strict=True):
        logits = x @ net.p["c"] + net.p["d"]
        group = net.classes if t == 70 else t // 64
        want = logits[group] - np.logaddexp.reduce(logits)
        if t < 70:
            z = x @ net.p["w"][group].astype(float) + net.p["b"][group] + net.void[group]
            want += z[t % 64] - np.logaddexp.reduce(z)
        assert math.isclose(value, want, rel_tol=1e-3, abs_tol=1e-2)
    loss, g, _ = net.gradients(target[None, :], target[None, :], np.zeros((1, 200), bool), h)
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())
