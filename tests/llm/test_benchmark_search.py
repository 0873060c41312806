"""The benchmark search on repetitive texts: results against brute force, and its memory."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from voxelmill.llm import op6_decontaminate as bench
from voxelmill.llm.textkit import ALNUM, slabs, words


def matches(texts, items, window=10):
    (slab,) = slabs(pa.array(texts), 1 << 24)
    spans, found, longest, at = bench.shard_matches(slab, words(slab, ALNUM), bench.query_block(items, window))
    return spans, found, longest.tolist(), at.tolist()


@pytest.mark.parametrize("walk", [0, 3, 24])
def test_few_words_that_repeat(monkeypatch, walk):
    monkeypatch.setattr(bench, "_WALK", walk)
    monkeypatch.setattr(bench, "_PAIRS", 5)
    rng = random.Random(walk)
    for _ in range(40):
        known = "abc"[: rng.randint(1, 3)]
        texts = [" ".join(rng.choice(known) for _ in range(rng.randint(0, 90))) for _ in range(5)]
        items = [(i, " ".join(rng.choice(known) for _ in range(rng.randint(0, 40)))) for i in range(4)] + [("part", texts[0][:50]), (None, texts[1])]
        spans, found, longest, at = matches(texts, items)
        for k, text in enumerate(texts):
            w, hit, names, runs = text.split(), set(), [], {0: -1}
            for name, item in items:
                v = item.split()
                n = min(10, len(v))
                windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
                places = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
                hit |= {j for i in places for j in range(i, i + n)}
                names += [None if name is None else str(name)] * bool(places)
                shared = [[0] * (len(v) + 1) for _ in range(len(w) + 1)]
                for i in range(len(w) - 1, -1, -1):
                    for j in range(len(v)):
                        shared[i][j] = shared[i + 1][j + 1] + 1 if w[i] == v[j] else 0
                    top = max(shared[i])
                    runs[top] = min(runs.get(top, i), i) if top else -1
            assert hit == {i for a, b in zip(spans[k][::2], spans[k][1::2]) for i in range(a, b)}
            assert sorted(found[k], key=str) == sorted(names, key=str)
            assert longest[k] == max(runs) and at[k] == runs[max(runs)]


def test_equal_words_take_bounded_memory():
    text, item = "ab " * 700_000, "ab " * 2000  # 2.1 MB; every window stands in nearly every place
    tracemalloc.start()
    spans, found, longest, at = matches([text], [("all", item)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (spans, found, longest, at) == ([[0, 700_000]], [["all"]], [2000], [0])
    assert peak < 300e6
