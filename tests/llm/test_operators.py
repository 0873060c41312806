"""The corpus operators against brute force, on texts with nulls, empties, ties, repeats and very long rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from voxelmill.llm import op1_mixing, op2_token_output, op3_secrets, op4_jaccard_join, op5_quality, op6_decontaminate, op7_language, op8_cotraining, op9_token_counts, op10_license
from voxelmill.llm.bpe import encoder

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, spans string, items string, score double"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def texts():
    rng = random.Random(7)
    vocabulary = ["the", "of", "é", "Straße", "naïve", "mix", "Mix", "data", "x1", "don't", "a", "中文", "the.", "end,", "(b)", "$$$", "||"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", "   ", "\n\n", "one", "two words", "three little words", "a\tb\r\nc\x0bd", "x" * 9000, make(6000), "\xa0hello　 wide  spaces ", "line\nline\nline\n\nother", "<|endoftext|> inside a text", "tail space "]
    out += [make(rng.randint(1, 120)) for _ in range(60)]
    out += [out[-1]] * 4
    out += [make(80) + "\n" + "same line here\n" * 3 for _ in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), i, "a", "b", 0.5) for i, t in enumerate(texts())]
    rows += rows[-1:]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def all_texts():
    return {i: t or "" for i, t in enumerate(texts())}


def test_encoder_equals_the_library():
    enc = encoder(op9_token_counts.VOCABULARY)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "中", "　", "\xa0", "\r\n", "<|endoftext|>", "\x02", "\x03", "\x1c", "1", "_", "'ll", "́", "\xad", "%", "-"]
    odd = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(3000)]
    for t, got in zip(odd, enc.encode_many(odd)):
        assert got == enc.whole(t).tobytes(), repr(t)
        assert op9_token_counts.count_huge(enc, t, 8, 4) == len(got) // 4, repr(t)


def test_op9(docs, empty):
    enc = encoder(op9_token_counts.VOCABULARY)
    got = by_id(op9_token_counts.token_counts(docs, chunk=500, overlap=16))
    for i, t in all_texts().items():
        n = len(enc.library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512)
    assert op9_token_counts.token_counts(docs).count() == docs.count()
    assert op9_token_counts.token_counts(empty).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_op2(docs, empty, kind, tmp_path):
    enc = encoder(op2_token_output.VOCABULARY)
    path = f"file://{tmp_path}/ids"
    op2_token_output.write_ids(docs, path, 3, plane_kind=kind, block_chunk=700)
    rows = sorted(op2_token_output.read_ids(docs.sparkSession, path).collect(), key=lambda r: r.start)
    start = 0
    for r, i in zip(rows, [*range(len(texts())), len(texts()) - 1]):
        ids = np.append(enc.whole(texts()[i] or ""), 0).astype("<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert len(rows) == docs.count()
    op2_token_output.write_ids(empty, path + "0", 2)
    assert op2_token_output.read_ids(docs.sparkSession, path + "0").count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, op2_token_output.BLOCK, op2_token_output.BLOCK + 5])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    sizes, data = op2_token_output.encode_planes(ids, kind)
    assert (op2_token_output.decode_planes(n, kind, sizes, data) == ids).all()


def test_op3(spark, empty):
    found = [
        None, "", "password = hunter2hunter2", "token=abc", "secret: 'a/b+c=d.e-f_g'", 'API_KEY:"12345678"', "apikey=1234567", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 7, "AKIASHORT",
        "deadbeef" * 4, "f" * 31, "é" * 5 + "0" * 40 + " " + "0" * 32, "token=secret: abcdefghij", "x" * 50000 + " passwd:longenough1", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18,
        "postgres://user:pass1@host", "Bearer " + "t" * 24, "ftoken=Keyeyeyey", "g" + "a" * 32 + "\n" + "b" * 33,
    ]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(2)
    got = by_id(op3_secrets.scan(df))
    for i, t in enumerate(found):
        every, base = [], []
        for k, rule in enumerate(op3_secrets.BASE + op3_secrets.MORE):
            spans = [m.span() for m in re.finditer(rule.pattern, t or "", rule.flags) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            every += [(a, k, f"{rule.kind}:{a}:{b}") for a, b in spans]
            base += [(a, k, f"{rule.kind}:{a}:{b}") for a, b in spans if k < 3]
        assert got[i].spans == ",".join(s for *_, s in sorted(every))
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(base)).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert got[16].spans.startswith("github") and got[17].spans.startswith("url_login")
    assert op3_secrets.scan(empty).count() == 0


def test_trigram_queries():
    assert op3_secrets.trigram_query(r"[0-9a-f]+") is True
    assert op3_secrets.trigram_query(r"ab?") is True
    assert op3_secrets._grams(op3_secrets.trigram_query(r"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    assert b"sec" in op3_secrets._grams(op3_secrets.trigram_query(op3_secrets.BASE[0].pattern, op3_secrets.BASE[0].flags))


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_op4(spark, empty, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = [None, "", "  ", "a", "A", "a b", "a b c d", "A B c d e f g"]
    for size in (60, 140):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(50):  # near copies of one text
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
        for _ in range(15):  # a chain
            base = list(base)
            base[rng.randrange(size)] = rng.choice(vocabulary)
            out.append(" ".join(base))
    shared = [rng.choice(vocabulary) for _ in range(40)]  # a passage in unrelated texts
    out += [" ".join(shared + [rng.choice(vocabulary) for _ in range(rng.randint(2, 30))]) for _ in range(50)]
    out += [" ".join(rng.choice("xy") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(out)], "doc_id long, text string")
    sets = {}
    for i, t in enumerate(out):
        w = SPACE.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    want = components(sets, percent)
    got = by_id(op4_jaccard_join.jaccard_join(df.repartition(4), n, percent))
    assert {i: (got[i].n_shingles, got[i].component_id) for i in want} == {i: (len(sets[i]), c) for i, c in want.items()}
    if n == 4:
        assert op4_jaccard_join.jaccard_join(empty).count() == 0
        kept = op4_jaccard_join.deduplicated(df.withColumn("n", df.doc_id), n, percent)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c) and kept.columns == ["doc_id", "text", "n"]


def repeats(w, n):
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return {i + j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(n)}


def judged(t):
    w = SPACE.findall(t)
    seen, lines, line_chars = set(), 0, 0
    for line in t.split("\n"):
        if SPACE.search(line):
            if line in seen:
                lines += 1
                line_chars += sum(map(len, SPACE.findall(line)))
            seen.add(line)
    chars, three, symbols = sum(map(len, w)), len(repeats(w, 3)), len(re.findall(r"[#*$%&|<>]", t))
    failed = len(w) < 50 or 100 * three > 50 * len(w)
    shares = {n: sum(len(w[i]) for i in repeats(w, n)) / max(chars, 1) for n in op5_quality.GRAM_LIMITS}
    bad = any(s > op5_quality.GRAM_LIMITS[n] for n, s in shares.items()) or line_chars / max(chars, 1) > op5_quality.LINE_LIMIT or symbols > op5_quality.SYMBOLS_PER_WORD * len(w)
    return len(w), chars, symbols, lines, three, failed, not (failed or bad)


def test_op5(docs, empty):
    got = by_id(op5_quality.quality(docs))
    for i, t in all_texts().items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == judged(t), repr(t[:80])
    kept = op5_quality.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert op5_quality.quality(empty).count() == op5_quality.accepted(empty).count() == 0


def hits(w, items, window):
    found, places = set(), set()
    for item, v in items.items():
        n = min(window, len(v))
        wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wanted:
                found.add(item)
                places |= set(range(i, i + n))
    return found, places


def longest_run(document, item):
    """Words in the longest run that both have."""
    best, before = 0, [0] * (len(item) + 1)
    for word in document:
        now = [0] + [before[j] + 1 if word == item[j] else 0 for j in range(len(item))]
        best, before = max(best, *now), now
    return best


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_op6(spark, docs, empty, block):
    rng = random.Random(2)
    long = ALNUM.findall(lower(texts()[9]))
    items = [(1, " ".join(long[100:130])), (2, "data mix the"), (3, None), (4, "..."), (5, " ".join(long[400:411])), (6, " ".join(rng.choice(long) for _ in range(20))), (7, "one"), (10, " ".join(long[115:140]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = {str(i): ALNUM.findall(lower(t or "")) for i, t in items}
    got = by_id(op6_decontaminate.contamination(docs, bench, block_bytes=block))
    clean = set()
    for i, t in all_texts().items():
        w = ALNUM.findall(lower(t))
        found, places = hits(w, words, 10)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(places), len(found), bool(places))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        clean |= set() if places else {i}
        best = max([(longest_run(w, v)) for v in words.values()] + [0]) if len(w) < 1000 else 30
        assert r.longest == best
        starts = [k for k in range(len(w) - best + 1) for v in words.values() if any(w[k : k + best] == v[j : j + best] for j in range(len(v) - best + 1))] if best and len(w) < 1000 else [100]
        assert r.longest_at == (min(starts) if best else None)
    kept = op6_decontaminate.decontaminate(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    assert op6_decontaminate.contamination(empty, bench).count() == 0
    assert op6_decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_op7(spark, sf_dir, docs, empty):
    got = op7_language.op7_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    model = op7_language.train(docs)
    rows = by_id(op7_language.predict(docs, model))
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts()[i] or "")) for i, r in rows.items())
    assert {r.lang_pred for r in op7_language.predict(docs, op7_language.train(empty)).collect()} == {"und"}
    assert op7_language.predict(empty, model).count() == 0


def test_op8(spark, docs, empty):
    rng = random.Random(4)
    good, bad = ["river", "stone", "light", "paper"], ["buy", "now", "$$$", "click"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(30)), "en", f"s{i % 3}", 100) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    state = op8_cotraining.train(df, labels)
    got = by_id(op8_cotraining.score(df, state))
    assert all(got[i].kept == (i % 3 > 0) for i in range(100, 300))
    assert all(0 <= v <= 1 for r in got.values() for v in (r.p_text, r.p_meta, r.quality))
    assert op8_cotraining.score(docs, state).count() == docs.count()
    assert op8_cotraining.score(empty, state).count() == 0
    nothing = op8_cotraining.train(docs, labels.limit(0))
    assert op8_cotraining.score(docs, nothing).where("NOT kept").count() == 0


def test_op1(spark, docs, empty):
    rng = random.Random(6)
    words = {"a": ["alpha", "apple", "acorn"], "b": ["beta", "bear", "bread"]}
    rows = [(i, " ".join(rng.choice(words["a" if i % 4 else "b"]) for _ in range(rng.randint(5, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(150)], "doc_id long, domain string")
    mix = op1_mixing.fit_mix(df, labelled, {"a": 0.5, "b": 0.5})
    out = op1_mixing.rates(df, mix).collect()
    total = sum(r.n_tokens for r in out)
    share = sum(r.rate * r.n_tokens for r in out if r.doc_id % 4 == 0) / total
    assert abs(share - 0.5) < 0.02 and abs(sum(r.rate * r.n_tokens for r in out) / total - 1) < 0.01 and min(r.rate for r in out) >= 0
    assert abs(mix.tokens - mix.targets).max() < 1e-3 * total
    drawn = op1_mixing.mixed(df, mix).count()
    assert abs(drawn - sum(r.rate for r in out)) < 60
    less = op1_mixing.fit_mix(df, labelled, op1_mixing.halved("b"), max_rate=1.0)
    kept = Counter(r.doc_id % 4 == 0 for r in op1_mixing.mixed(df, less).collect())
    assert kept[False] >= 295 and 25 <= kept[True] <= 75
    assert op1_mixing.rates(docs, mix).count() == docs.count() and op1_mixing.rates(empty, mix).count() == 0
    assert op1_mixing.fit_mix(docs, labelled.limit(0)) is None
    assert {r.rate for r in op1_mixing.rates(docs, None).collect()} == {1.0}
    assert op1_mixing.mixed(docs, mix).columns == docs.columns


def filled(template, rng, optional):
    """A text of the template's words: regions left out or not, replaceable ones filled, with odd case and punctuation."""
    out, skip = [], []
    for m in re.findall(r"<<opt>>|<</opt>>|<<any:\d+-\d+>>|[^\s<]+", template):
        if m == "<<opt>>":
            skip.append(not optional(rng))
        elif m == "<</opt>>":
            skip.pop()
        elif any(skip):
            continue
        elif m.startswith("<<any"):
            low, high = map(int, re.findall(r"\d+", m))
            out += [f"filler{rng.randrange(9)}" for _ in range(rng.randint(low, high))]
        else:
            out.append(rng.choice([m, m.upper(), f"({m})", f"{m},"]))
    return out


def test_op10(spark, docs, empty):
    import regex

    rng = random.Random(10)
    every = {**op10_license.LICENSES, **op10_license.STATEMENTS}
    found = [
        "Released under the MIT License.", "under the MIT\nlicense under the mit license", "Licensed under the Apache License, Version 2.0.", "CC-BY-NC", "cc by", None, "", "under the mit licenses",
        "Licensed under a Creative Commons Attribution Share Alike 4.0 International License", "Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the mit license",
    ]
    whole = {}
    for name, (label, template) in every.items():
        for optional in (lambda r: True, lambda r: False, lambda r: r.random() < 0.5):
            text = filled(template, rng, optional)
            whole[len(found)] = label
            found.append("before " + " ".join(text) + " after it")
            missing = list(text)
            del missing[len(missing) // 2]
            found.append(" ".join(missing))
        found.append(" ".join(["word"] * 30_000 + text + ["word"] * 30_000))  # a very long text
        whole[len(found) - 1] = label
    found += found[-1:]
    df = spark.createDataFrame([(i if i else None, t, "x", "y", 1.0) for i, t in enumerate(found)], "doc_id long, text string, labels string, spans string, score double").repartition(3)
    got = {r.doc_id or 0: r for r in op10_license.scan(df).collect()}
    assert len(got) == len(found)
    assert [(got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) for i in range(8)] == [(1, 1, 1, "mit"), (2, 0, 4, "mit"), (1, 3, 3, "apache-2"), (1, 0, 0, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")]
    assert [got[i].labels for i in (2, 8, 9, 10)] == ["apache-2", "cc-by-sa", "gpl", "mit"] and got[0].spans == "mit-named:0:5"
    for i, t in enumerate(found):
        w = ALNUM.findall(lower(t or ""))
        joined = "".join(f"{x} " for x in w)
        spans, labels, score = [], set(filter(None, got[i].base_labels.split(","))), 0.5 if got[i].n_base else 0.0
        for name, (label, template) in every.items():
            for m in regex.finditer(r"(?<=^| )" + op10_license.expression(template), joined, regex.POSIX):
                spans.append((joined[: m.start()].count(" "), name, joined[: m.end()].count(" ")))
                labels.add(label)
                score = max(score, 1.0 if name in op10_license.LICENSES else 0.75)
        assert got[i].spans == ",".join(f"{n}:{a}:{b}" for a, n, b in sorted(spans)), (i, t[:200])
        assert (got[i].labels, got[i].score) == (",".join(sorted(labels)), score)
        assert whole.get(i) is None or whole[i] in labels
    assert op10_license.scan(docs).count() == docs.count() and op10_license.scan(empty).count() == 0
    with pytest.raises(ValueError):
        op10_license.Automaton("<<opt>> never closed")


def test_op4_rows_with_one_id(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (9, c), (9, c), (9, None), (11, d), (11, d + " more"), (12, ""), (None, a), (None, a.upper()), (None, d), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.component_id) for r in op4_jaccard_join.jaccard_join(df).collect())
    assert got == Counter((i, {5: 3, 7: 3}.get(i, i)) for i, _ in rows)
    kept = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in op4_jaccard_join.deduplicated(df).collect()))
    assert kept == [(0, ""), (0, ""), (0, a), (0, d), (3, a), (9, c), (11, d), (12, "")]


def test_op4_one_id_with_many_texts(spark):
    text = lambda k, *more: " ".join([f"{k}w{i}" for i in range(40)] + [f"m{k}{x}" for x in more])
    rows = [(1, text(k)) for k in range(40)] + [(1, text(0))] * 20 + [(100 + k, text(k, 1)) for k in range(40)] + [(200 + k, text(k, 1)) for k in range(40, 44)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in op4_jaccard_join.jaccard_join(df).collect()}
    assert got == {i: i if i >= 200 else 1 for i, _ in rows}
    assert sorted(r.doc_id for r in op4_jaccard_join.deduplicated(df).collect()) == [1] + [200 + k for k in range(40, 44)]


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_op6_items_without_id(spark, tmp_path, block):
    one, two, three = (" ".join(f"{k}{i}" for i in range(14)) for k in "abc")
    spark.createDataFrame([(1, f"x {one} y"), (2, f"{one} {two}"), (3, f"{three} {two} {one}"), (4, "clean text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, one), (None, two), (7, three), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    got = op6_decontaminate.contamination(docs, bench, block_bytes=block).drop("spans")
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (14, 1, True), 2: (28, 1, True), 3: (42, 2, True), 4: (0, 0, False)}
    assert [r.doc_id for r in op6_decontaminate.decontaminate(docs, bench, block_bytes=block).collect()] == [4]


def test_op7_equals_plain_naive_bayes(spark, docs):
    rows = {(r.doc_id, r.text or "", r.lang) for r in docs.collect()}
    grams = {t: op7_language.ngrams(next(op7_language.slabs(pa.array([t]))), op7_language.ORDERS, op7_language.BUCKETS)[1].tolist() for _, t, _ in rows}
    every = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None]
    labels = sorted({x for _, x in every})
    counts, n = {x: Counter() for x in labels}, Counter(x for _, x in every)
    for t, x in every:
        counts[x].update(grams[t])
    total = Counter()
    for c in counts.values():
        total.update(c)
    shared = {b: (total[b] + 1) / (sum(total.values()) + op7_language.BUCKETS) for b in {b for g in grams.values() for b in g}}
    got = by_id(op7_language.predict(docs.select("doc_id", "text"), op7_language.train(docs)))
    for i, t, _ in rows:
        odds = [sum(np.log((counts[x][b] + op7_language.STRENGTH * shared[b]) / (sum(counts[x].values()) + op7_language.STRENGTH)) for b in grams[t]) + np.log((n[x] + 1) / (len(every) + len(labels))) for x in labels]
        p = np.exp(np.array(odds) - max(odds))
        if any(c.isalpha() for c in t):
            assert abs(got[i].score - (p / p.sum()).max()) < 1e-6 and (got[i].score < 0.500001 or got[i].lang_pred == labels[int(np.argmax(p))])
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


@pytest.mark.parametrize("top", [None, 1.0])
def test_op1_equals_a_dense_solver(spark, top):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "the"]) for _ in range(rng.randint(0, 50)))) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, ["x", "y", "z"][t.count("alpha") % 3]) for i, t in rows[:60]], "doc_id long, domain string")
    mix = op1_mixing.fit_mix(df, labelled, {"x": 0.6, "y": 0.3, "z": 0.1}, max_rate=top)
    members = op1_mixing.memberships(df, mix.classifier).collect()
    p, n = np.array([r.posterior for r in members]), np.array([r.n_tokens for r in members], float)
    rate, scale = np.ones(len(n)), np.maximum((n[:, None] * p).sum(axis=0), 1e-9)
    for _ in range(20_000):  # plain projected gradient descent, no momentum, on all rates at once
        rate = np.clip(rate - p @ (((rate * n) @ p - mix.targets) / scale), 0.0, top)
    loss = lambda tokens: float((((tokens - mix.targets) ** 2) / scale).sum())
    out = op1_mixing.rates(df, mix).collect()
    tokens = sum(r.rate * r.n_tokens * np.array(m.posterior) for r, m in zip(sorted(out, key=lambda r: (r.doc_id or -1, r.n_tokens)), sorted(members, key=lambda r: (r.doc_id or -1, r.n_tokens))))
    assert np.allclose(tokens, mix.tokens, rtol=1e-6) and all(0 <= r.rate <= (top or np.inf) for r in out)
    assert loss(mix.tokens) <= loss((rate * n) @ p) + 1e-3 * mix.targets.sum()
    assert [r.domain for r in mix.totals(spark).collect()] == mix.classifier.model.labels
    odd = df.selectExpr("doc_id", "text", "1 AS chance", "2 AS __u", "3 AS rate")
    assert op1_mixing.mixed(odd, mix).columns == odd.columns and op1_mixing.mixed(odd.limit(0), mix).count() == 0


def test_op8_equals_one_round_by_hand(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["good", "bad", "page", "text"] if i % 2 else ["bad", "bad", "buy", "page"]) for _ in range(12)), f"s{i % 2 if i % 7 else 2}", None if i % 5 == 0 else "en", i % 40 if i % 3 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sample = {r.doc_id: (r.y, r.cal) for r in op8_cotraining._label_sample(labels, 100).collect()}
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text", "source", "lang", "n_chars"), r)) for r in rows])
    text = [op8_cotraining.text_features(next(op8_cotraining.slabs(pa.array([r[1]]))), op8_cotraining.BUCKETS)[1] for r in rows]
    meta = op8_cotraining.meta_features(batch)[1].reshape(-1, 3)

    def model(features, given, buckets, strength):
        counts, n = np.zeros((2, buckets)), np.zeros(2)
        for f, y in zip(features, given):
            if y is not None:
                np.add.at(counts[int(y)], f, 1)
                n[int(y)] += 1
        return op8_cotraining.fit(counts, n, ["0", "1"], strength)

    def odds(m, features):
        return np.array([(m.log_p[f, 1] - m.log_p[f, 0]).sum() / np.sqrt(len(f) + 1.0) for f in features])

    given = [None if i not in sample or sample[i][1] else sample[i][0] for i in range(80)]
    held = [i for i in range(80) if i in sample and sample[i][1]]
    y = np.array([float(sample[i][0]) for i in held])
    told = {"text": given, "meta": given}
    for _ in range(2):
        views = {"text": odds(model(text, told["text"], op8_cotraining.BUCKETS, op8_cotraining.STRENGTH), text), "meta": odds(model(meta, told["meta"], op8_cotraining._META_BUCKETS, 20.0), meta)}
        p = {k: op8_cotraining.apply_logistic(v[:, None], op8_cotraining.logistic(v[held][:, None], y)) for k, v in views.items()}
        says = {k: [g if g is not None or i in held else "1" if v >= 0.97 else "0" if v <= 0.03 else None for i, (g, v) in enumerate(zip(given, p[k]))] for k in p}
        told = {"text": says["meta"], "meta": says["text"]}
    joint = op8_cotraining.apply_logistic(np.column_stack([views["text"], views["meta"]]), op8_cotraining.logistic(np.column_stack([views["text"][held], views["meta"][held]]), y))
    got = by_id(op8_cotraining.score(df, op8_cotraining.train(df, labels, rounds=1)))
    for i in range(80):
        assert np.allclose([got[i].p_text, got[i].p_meta, got[i].quality], [p["text"][i], p["meta"][i], joint[i]], atol=1e-6)
    plain = df.select("doc_id", "text")
    assert op8_cotraining.score(plain, op8_cotraining.train(plain, labels)).count() == 80
