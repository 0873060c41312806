"""Spelling variants, fill-in-the-middle examples and lattice scores, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from voxelmill.llm import op11_spelling_variants as variants
from voxelmill.llm import op12_fill_in_middle as middle
from voxelmill.llm import op13_lattice_score as scores

DOCS = "doc_id long, text string"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# Spelling variants


def variants_by_force(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if v != w and apart(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v is not None and n[v] >= 10 * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found_variants(spark, rows, schema=DOCS):
    out = variants.spelling_variants(spark.createDataFrame(rows, schema)).collect()
    assert len({r.word for r in out}) == len(out)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


def test_variants_of_a_made_up_language(spark):
    rng = random.Random(11)
    letters = "abcdefgéÉÿß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "b" * 300, "b" * 299 + "c"]

    def changed(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w.upper()])

    rows = [(i, " ".join(rng.choice(base) if rng.random() < 0.8 else changed(rng.choice(base)) for _ in range(60))) for i in range(120)]
    rows += [(None, "großartig, GROßARTIG 1großartig2"), (None, None), (5, ""), rows[0], rows[0], (7, "aĀb×aaaaaa ¿Àbcdefg")]
    assert found_variants(spark, rows) == variants_by_force(rows)


def test_a_chain_of_forms_ends_at_its_last(spark):
    words = {"letterx": 2, "letters": 30, "lettersa": 700}
    rows = [(i, w) for w, n in words.items() for i in range(1000 * len(w), 1000 * len(w) + n)]
    assert found_variants(spark, rows) == variants_by_force(rows)
    assert {r[0]: r[2] for r in found_variants(spark, rows)}["letterx"] == "lettersa"


def test_variants_of_nothing_and_of_clashing_columns(spark):
    assert found_variants(spark, []) == set() == found_variants(spark, [(1, "short words only"), (2, None)])
    rows = [(1, "harbours", "x", 3, 4), (2, "harbours harbour", "y", 3, 4), (3, "harbour", "z", 3, 4)]
    assert found_variants(spark, rows, DOCS + ", word string, n int, near int") == variants_by_force([r[:2] for r in rows])
    with pytest.raises(ValueError, match="frequent"):
        variants.spelling_variants(spark.createDataFrame([], DOCS), dominance=1)


def test_neighbours_are_distinct_and_complete():
    import numpy as np

    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    for word in ("aab", "abc", "é", "aaaa"):
        m = np.frombuffer(word.encode("utf-32-le"), np.uint32).reshape(1, -1)
        got = [s for _, s in variants.neighbours(m, alphabet, lambda h: np.ones(h.shape, bool))]
        parts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
        want = {a + b[1:] for a, b in parts if b} | {a + chr(c) + b[1:] for a, b in parts if b for c in alphabet} | {a + chr(c) + b for a, b in parts for c in alphabet}
        assert len(got) == len(set(got)) and set(got) == want - {word}


# Fill in the middle


def example_by_force(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < spm
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm,seed", [(100, 50, 7), (60, 0, 8), (100, 100, 9)])
def test_examples_and_exact_round_trips(spark, rate, spm, seed):
    rng = random.Random(12)
    pieces = ["word ", "\n", "é\U0001f600", "<", "P>", "<S", ">", "\r\n", "\x00", "'", "\\n"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(1000, None), (None, "no id\nat all\n"), (None, None), (1001, "has <M> in it\n"), (1002, "\n\n\n"), (1003, ("long line\n" * 50_000) + "end"), rows[3], rows[3]]
    got = middle.fill_in_middle(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n int, output string"), rate=rate, spm_rate=spm, seed=seed).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *(e := example_by_force(i, t, rate, spm, seed)), sha(e[-1]), sha(t or "")) for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.form for r in got} == {"plain"} | ({"psm"} if spm < 100 else set()) | ({"spm"} if spm else set())


def test_examples_of_an_empty_table_and_bad_arguments(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "ba", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            middle.fill_in_middle(spark.createDataFrame([], DOCS), sentinels=bad)
    with pytest.raises(ValueError, match="columns"):
        middle.fill_in_middle(spark.createDataFrame([], DOCS), ("doc_id", "text"))


# Lattice scores


def ways(word, pieces):
    """All segmentations of a word, as lists of pieces."""
    if not word:
        return [[]]
    return [[p, *rest] for k in range(1, len(word) + 1) if (p := word[:k]) in pieces for rest in ways(word[k:], pieces)]


def scores_by_force(rows, rounds):
    strings, given = scores.vocabulary_weights()
    share = dict(zip(strings, given.tolist()))
    tokens = [[lowered(w) for w in re.findall(r"[^\x20\x09-\x0d]+", t or "")] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    ends = held.count(False)
    total, distinct = sum(c.values()) + ends, len(c) + (ends > 0)
    cuts = {w: ways("▁".encode() + w.encode(), share) for ws in tokens for w in ws}
    n, prior, seen = len(strings), dict(share), 0
    chance = lambda way: math.prod(share[p] for p in way)
    for _ in range(rounds):
        expected = defaultdict(float)
        for w, k in c.items():
            whole = sum(map(chance, cuts[w]))
            for way in cuts[w]:
                for p in way:
                    expected[p] += k * chance(way) / whole
        seen = sum(expected.values())
        share = {p: (expected.get(p, 0.0) + n * q) / (seen + n) for p, q in prior.items()}
    end = (ends + 1) / (seen + n + ends + 1)
    out = []
    for (i, _), ws, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws) + math.log10((ends + 1) / (total + distinct + 1))
        score = math.log10(end) + sum(math.log10(sum(chance(way) * (1 - end) ** len(way) for way in cuts[w])) for w in ws)
        out.append((i, h, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), total, base, score))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_sum_over_all_segmentations(spark, rounds):
    rng = random.Random(13)
    words = ["the", "Of", "and", "cats", "né", "x y", "12", "▁a", "\x00", "zq", "THE"]
    rows = [(i, rng.choice(" \t\n").join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(None, "the cats"), (None, None), (100, ""), (101, " \n "), rows[4], rows[4]]
    got = scores.lattice_scores(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", score int"), rounds=rounds, block_bytes=300).collect()
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(scores_by_force(rows, rounds), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert any(r.held_out for r in got)


def test_scores_without_rows_or_training(spark):
    assert scores.lattice_scores(spark.createDataFrame([], DOCS)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scores.lattice_scores(spark.createDataFrame([(only, "the cats")], DOCS)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(row.score)


def test_a_very_long_word_and_a_hot_one(spark):
    rows = [(1, "the " * 200_000), (2, "x" * 30_000), (3, "the")]
    found = {r.doc_id: r for r in scores.lattice_scores(spark.createDataFrame(rows, DOCS), block_bytes=1 << 16).collect()}
    assert found[1].n_tokens == 200_001 and found[2].n_tokens == 2 and all(math.isfinite(r.score) for r in found.values())
    assert found[2].score < -1000 < found[3].score


def test_adapted_scores_fit_texts_that_were_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [sum(r.score for r in scores.lattice_scores(docs, rounds=k).collect() if r.held_out) for k in (0, 1)]
    assert held[1] > 0.9 * held[0]  # log probabilities: nearer to 0


def test_token_counts_of_huge_texts_with_special_strings():
    from voxelmill.llm.bpe import encoder
    from voxelmill.llm.op9_token_counts import VOCABULARY, count_huge

    enc, rng = encoder(VOCABULARY), random.Random(9)
    pieces = ["word", " another", "\n", "  ", "<|endoftext|>", "<|endoftext", "|>", "é", " 12", "'s"]
    for chunk, overlap in ((40, 8), (500, 60)):
        for _ in range(40):
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))
            assert count_huge(enc, text, chunk, overlap) == len(enc.library.encode(text, add_special_tokens=False).ids)
    long = "some words and more of them " * 5000 + "<|endoftext|>" + "the rest of it\n" * 5000
    assert count_huge(enc, long) == len(enc.library.encode(long, add_special_tokens=False).ids)
