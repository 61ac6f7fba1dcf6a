import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from pathweave.llm.packing import op1_best_fit_packing, pack, plan_bins, tokenizer_path
from tests.llm.conftest import as_dir


def test_query_matches_the_library(spark, docs, texts, tmp_path):
    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    want = {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = op1_best_fit_packing(spark, as_dir(docs, tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    check_bins(got)


def check_bins(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.1 * total / 2048 + 2


def test_plan_is_tight():
    rng = random.Random(1)
    for _ in range(30):
        counts = Counter(min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(rng.randint(1, 800)))
        bins = plan_bins(dict(counts))
        placed = Counter()
        for content, times in bins:
            assert sum(a * b for a, b in content.items()) <= 2048
            for length, n in content.items():
                placed[length] += n * times
        assert placed == counts
        n = sum(t for _, t in bins)
        assert n <= 1.03 * sum(a * b for a, b in counts.items()) / 2048 + 3


def test_two_fit_replaces_the_smallest():
    # greedy leaves 6 + 3 in a bin of 10; 6 + (2 + 2) is tighter
    bins = plan_bins({6: 1, 3: 1, 2: 2}, size=10)
    assert ({6: 1, 2: 2}, 1) in bins


def test_edge_cases(empty, nulls):
    assert pack(empty).count() == 0
    rows = pack(nulls).collect()
    assert len(rows) == 5
    check_bins(rows)
