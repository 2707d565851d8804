import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import byte_bpe, ctw, exact_dedup, language_id, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, token_files
from ledgerlens.llm.common import vocabulary_path

FIELDS = "doc_id long, text string, lang string, source string, k1 string, block string, bucket string, n int"


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, blanks, nulls and a very long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéf") for _ in range(r.randrange(1, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [None, "", "  \n\t", "one two", "One TWO", "a b c d e", "!!! 123", "x\x1cy z " * 30, "ab " * 9000]
    while len(texts) < n:
        t = [word() for _ in range(r.randrange(20, 90))]
        kind = r.randrange(5)
        if kind == 0 and len(texts) > 12:
            t = (r.choice(texts[9:]) or "").split(" ")
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = word()
        text = " ".join(t)
        texts.append(text + "\n" + passage if kind == 1 else text.replace(" ", "  ", 1) if kind == 2 else text)
    return [(None if i == 3 else i * 7 % 1009, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", None]), "x", "y", "z", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


ALL = {
    "join": ngram_join.op1, "lang": language_id.op2, "mix": mixing.mix, "suffix": suffix_dedup.op4, "ctw": ctw.op5, "license": license_scan.license_scan,
    "dedup": exact_dedup.exact_dedup, "files": token_files.token_files, "bpe": byte_bpe.byte_bpe, "quality": quality_rules.op10,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(none, name):
    assert ALL[name](none).count() == 0


def words(text):
    return (text or "").encode().lower().split()


def test_ngram_join(docs, rows):
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [d for d in sets if d is not None]
    label = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(ngram_join.ngram_join(docs))
    assert {d: got[d].n_shingles for d in ids} == {d: len(sets[d]) for d in ids}
    assert {d: got[d].component_id for d in ids} == label


def test_block_pairs_miss_nothing():
    import pyarrow as pa

    r = np.random.default_rng(2)
    for m in (20, 150):
        n = np.sort(r.integers(20, 40, m))
        t = {"tok": np.ones(m, int), "size_class": np.ones(m, int), "id": np.arange(m), "cls": r.integers(0, 9, m), "n": n, "pos": r.integers(0, 6, m), "sure": np.full(m, -1), "part": np.full(m, -1)}
        unsigned = pa.table({"own": np.arange(m), "sign": pa.nulls(m, pa.binary())})
        got = {*zip(*(c.to_pylist() for c in ngram_join._block_pairs(pa.table(t), unsigned).columns), strict=True)}
        want = {(i, j) for i in range(m) for j in range(i + 1, m) if t["cls"][i] != t["cls"][j] and ngram_join.may_link(n[i], t["pos"][i], n[j], t["pos"][j])}
        assert got == want
        # Two parts that meet give the pairs across, and only these.
        part = r.integers(0, 2, m)
        got = {*zip(*(c.to_pylist() for c in ngram_join._block_pairs(pa.table(t | {"part": part}), unsigned).columns), strict=True)}
        assert got == {(i, j) for i, j in want if part[i] != part[j]}


def test_ngram_join_with_lists_in_parts(docs, rows, monkeypatch):
    """The same classes and links where every list is cut into parts of two."""
    plain = sorted(map(str, ngram_join.ngram_join(docs, links=True).collect()))
    monkeypatch.setattr(ngram_join, "LIST_PART", 2)
    assert sorted(map(str, ngram_join.ngram_join(docs, links=True).collect())) == plain


def test_signatures_allow_every_link():
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 40, 60, 500, 3000):
        base = r.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.r_[base[: n - k], r.integers(0, 2**63, k).astype(np.uint64)]) for k in (0, n // 20, n // 10, n // 7, n // 2)]
    s = ngram_join.Signatures(pa.array([ngram_join.signature(x) for x in sets] + [None], pa.binary()))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    n = np.array([len(x) for x in sets])
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (s.apart(i, j) <= apart).all()
    ok, both = s.allow(i, j, n[i], n[j]), (n[i] + n[j] - apart) // 2
    link = both >= ngram_join.need(n[i], n[j])
    assert ok[link].all() and not ok[~link].all()
    assert s.allow(np.array([0]), np.array([len(sets)]), n[:1], n[:1]).all()


def test_language_id(docs, rows):
    got = by_id(language_id.op2(docs))
    for d, t, *_ in rows:
        assert 0 <= got[d].score <= 1 and (got[d].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    source = {d: s for d, _, _, s, *_ in rows}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) or all(target[s] == 2 * size[s] for s in size)
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in got) for s in size)


def test_suffix_array():
    r = random.Random(3)
    for _ in range(500):
        t = [r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(40))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_dedup(docs, rows, monkeypatch):
    got, out = by_id(suffix_dedup.op4(docs)), by_id(suffix_dedup.suffix_dedup(docs))
    first = {}
    for d, t, *_ in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) != d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
        assert bytes(out[d].kept) == kept and [i for x in out[d].spans for i in range(x.start, x.end)] == [i for i, g in enumerate(gone) if g]


def test_ctw(docs, rows):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, *_ in rows}
    count = collections.Counter(w for d, t, *_ in rows if not held[d] for w in [*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    got = by_id(ctw.op5(docs))
    for d, t, *_ in rows:
        r, w = got[d], [*words(t), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))


def test_ctw_is_the_tree_mixture():
    """The code length of a text after itself, against a plain recursive tree."""
    text = b"abracadabra abracadabra\n"
    code, _ = ctw.grams([text])
    nodes = collections.defaultdict(lambda: [0, 0])
    for g in code.tolist():
        for d in range(ctw.DEPTH + 1):
            for k in range(8):
                x = g & 0xFF
                nodes[d, (g >> 8) & ((1 << 8 * d) - 1), (x >> (8 - k)) | (1 << k)][(x >> (7 - k)) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(d, c, n):
        pe = kt(*nodes[d, c, n])
        if d == ctw.DEPTH:
            return pe
        below = sum(pw(d + 1, e, n) for f, e, m in [*nodes] if f == d + 1 and m == n and e & ((1 << 8 * d) - 1) == c)
        return math.log(0.5) + np.logaddexp(pe, below)

    def p(g, k, d=0):
        x = g & 0xFF
        c, n, bit = (g >> 8) & ((1 << 8 * d) - 1), (x >> (8 - k)) | (1 << k), (x >> (7 - k)) & 1
        a = nodes[d, c, n]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == ctw.DEPTH:
            return own
        w = math.exp(math.log(0.5) + kt(*a) - pw(d, c, n))
        return w * own + (1 - w) * p(g, k, d + 1)

    keys, counts = np.unique(code, return_counts=True)
    _, top = ctw.tree(keys, counts.astype(float), None)
    got, _ = ctw.tree(keys, counts.astype(float), ctw.uppers(top))
    for g, v in list(zip(keys.tolist(), got, strict=True))[:4]:
        assert v == pytest.approx(sum(math.log10(p(g, k)) for k in range(8)), abs=1e-6)


def plain_ctw(rows):
    """Every column of the query from nodes in a dictionary, filled and mixed one decision at a time."""
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    count = collections.Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    nodes, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def paths(t):
        pad = b"\n" * ctw.DEPTH + b" ".join(words(t)) + b"\n"
        for i in range(ctw.DEPTH, len(pad)):
            for k in range(8):
                yield [(pad[i - d : i], (pad[i] >> (8 - k)) | (1 << k)) for d in range(ctw.DEPTH + 1)], (pad[i] >> (7 - k)) & 1

    for (_, t), h in zip(rows, held, strict=True):
        for path, bit in paths(t):
            for d, x in enumerate(path):
                nodes[x][bit] += not h
                if d:
                    children[path[d - 1]].add(x)
    weighted = {}
    for x in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[x]
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted[x] = pe if len(x[0]) == ctw.DEPTH else math.log(0.5) + np.logaddexp(pe, sum(weighted[y] for y in children[x]))
    out = []
    for (d, t), h in zip(rows, held, strict=True):
        score = 0.0
        for path, bit in paths(t):
            p = None
            for x in reversed(path):
                a, b = nodes[x]
                own = (nodes[x][bit] + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    w = math.exp(math.log(0.5) + math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) - weighted[x])
                    p = w * own + (1 - w) * p
            score += math.log10(p)
        w = [*words(t), b"\n"]
        out.append((d, h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def test_ctw_query(spark):
    """All columns of every row against the plain model: copies, repeated rows, blanks, nulls and a long text."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(25)]
    rows += [(3, rows[3][1]), (40, rows[4][1].upper()), (41, None), (42, ""), (None, "ab a"), (43, "a b " * 300)]
    got = sorted(ctw.op5(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("bits_per_byte").collect(), key=lambda x: (x[0] is None, x[0] or 0))
    for g, w in zip(got, sorted(plain_ctw(rows), key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6], rel=1e-4)


def test_license_scan(spark):
    t = "some words here\n" * 20 + "Licensed under the Apache License, Version 2.0.\n" + "more words\n" * 9
    got = license_scan.license_scan(spark.createDataFrame([(1, t), (2, "Released under the mit license!"), (3, "a license of the version under"), (4, None), (5, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license_id) for r in got] == [(1, "Apache-2.0"), (2, "MIT")]


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").encode().translate(None, b" \t\n\x0b\x0c\r")].append((-len(t or ""), d is None, d))
    got = by_id(exact_dedup.exact_dedup(docs, radix=2))
    for norm, g in groups.items():
        for _, _, d in g:
            assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (min(g)[2], len(g), d == min(g)[2], hashlib.sha256(norm).hexdigest())


def test_token_files(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(token_files.VOCABULARY))
    got, at = by_id(token_files.token_files(docs)), 0
    for d, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_byte_bpe(docs, rows):
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.model(vocabulary_path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = by_id(byte_bpe.byte_bpe(docs))
    for d, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    r = random.Random(6)
    for _ in range(500):
        t = "".join(r.choice("ab é'sh 1中\n\x1c") for _ in range(r.randrange(60))) if r.random() < 0.6 else r.choice("abh") * r.randrange(300)
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_quality_rules():
    r = random.Random(8)
    for _ in range(60):
        texts = [b" ".join(r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(25))) for _ in range(r.randrange(4))]
        known, ids, start, want = {}, [], [0], []
        for t in texts:
            w = t.split()
            ids += [known.setdefault(x, len(known)) for x in w]
            start.append(len(ids))
            want += [max([next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), 0) for j in range(len(w)) if j != i], default=0) for i in range(len(w))]
        a, s = np.array(ids, np.int64), np.array(start)
        order, at, lcp = quality_rules.suffixes(a, s)
        assert quality_rules.repeats(order, at, lcp).tolist() == want
        # Maximal repeats by definition: no longer one begins a word before, or ends a word after, all of its places.
        length, found = quality_rules.maximal_repeats(a, s, order, at, lcp, 2)
        least = []
        for t in texts:
            w, places = t.split(), collections.defaultdict(list)
            for i in range(len(w)):
                for k in range(2, len(w) - i + 1):
                    places[tuple(w[i : i + k])].append(i)
            for x, p in places.items():
                if len(p) > 1 and (0 in p or len({w[i - 1] for i in p}) > 1) and len({w[i + len(x)] if i + len(x) < len(w) else None for i in p}) > 1:
                    least.append((len(x), len(p)))
        assert sorted((k, n) for k, n, _ in found) == sorted(least)
        assert (quality_rules.covered(length) == quality_rules.covered(np.where(np.array(want, int) >= 2, want, 0) if want else length)).all()


def plain_quality(text):
    """Every column of the query for one text, from its words and all pairs of places."""
    text = text or ""
    w = text.encode().split()
    n, lines = len(w), [x for x in text.encode().split(b"\n") if x.split()]
    same = [max([next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), 0) for j in range(n) if j != i], default=0) for i in range(n)]
    over = lambda spans: sum(any(a <= i < a + k for a, k in spans) for i in range(n))
    in3 = over([(i, 3) for i in range(n) if same[i] >= 3])
    failed = n < 50 or 100 * in3 > 50 * n
    long = [(i, same[i]) for i in range(n) if same[i] >= quality_rules.MIN_REPEAT]
    cover, longest = over(long), max([k for _, k in long], default=0)
    kept = not failed and cover <= quality_rules.MAX_COVER * n and longest <= quality_rules.MAX_LONGEST * n
    chars = sum(len(x.decode()) for x in w)
    return n, chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), in3, failed, kept, cover, longest


def test_quality_query(spark):
    """All columns of every row against the plain rules: repeats within and across lines, blanks, nulls, repeated rows, symbols, other white space."""
    r = random.Random(12)
    word = lambda: r.choice(["a", "bé", "c#", "dd", "<e>", "f"]) + str(r.randrange(60))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "x y z " * 30), (5, "one\n\none\n two \n two \nthree\r")]
    for i in range(60):
        w = [word() for _ in range(r.randrange(30, 130))]
        if r.random() < 0.6:
            k, m = r.randrange(len(w)), r.randrange(5, 45)
            w[r.randrange(len(w)) :] += w[k : k + m]
        rows.append((10 + i, "".join(x + r.choice([" ", " ", "  ", "\n", "\t"]) for x in w)))
    rows += [rows[-1], (None, rows[20][1])]
    got = quality_rules.op10(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("n_maximal").collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(((d, *plain_quality(t)) for d, t in rows), key=key)
    assert len({x.kept for x in got if not x.base_failed}) == 2


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows * 2, FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules"
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_license_scan_finds_whole_texts_and_wordings(spark):
    texts = dict(license_scan.TEXTS)
    part = " ".join(w for i, w in enumerate(texts["MPL-2.0-text"].split()) if i % 60)  # an edit every 60 words
    rows = [(1, part), (2, "This library is available under the terms of the MIT license, see below."), (3, texts["ISC-text"]), (4, "Text licensed under CC BY-SA 4.0 by us"), (5, "words without any such notice at all")]
    got = {(r.doc_id, r.license_id) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "MPL-2.0-text"), (2, "MIT-notice"), (3, "ISC-text"), (4, "CC-BY-SA-notice")} <= got and not [d for d, _ in got if d == 5]


def joined(rows):
    """component_id and n_links of rows (doc_id, text), by their place, from all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = [[j for j in range(len(rows)) if i != j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(near[i])))
    return out


def test_ngram_join_goes_by_texts_not_ids(spark):
    """A doc_id with several texts, repeated rows, and a row without a doc_id that bridges two documents lose no link, and links are counted."""
    r = random.Random(11)
    rows = []
    for k in range(12):
        w = [f"w{k}x{r.randrange(500)}" for _ in range(60)]
        step = lambda n, w=w, k=k: " ".join([*w[n:], *(f"n{k}x{i}" for i in range(n))])
        rows += [(10 * k, step(0)), (5, step(3)), (None, step(6)), (10 * k + 1, step(10)), (10 * k + 1, step(10)), (3, f"alone {k} " * 2)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), links=True).drop("text_hash").collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(joined(rows), key=key)


def test_license_scan_against_all_stretches(spark):
    """Every stretch of a template's length that holds enough of it is found, whatever its place, and nothing else is; counts are those of the words themselves."""
    r = random.Random(21)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(40))
    sizes = (3, 5, 6, 8, 9, 13, 17, 30, 47, 90, 150)
    templates = tuple((f"t{n}", " ".join(word() for _ in range(n))) for n in sizes)
    rows = [(1, None), (2, ""), (3, "one two")]
    for i in range(120):
        name, text = r.choice(templates)
        w = text.split()
        for _ in range(r.randrange(1 + len(w) // 20)):
            w[r.randrange(len(w))] = word()
        rows.append((10 + i, " ".join([*(word() for _ in range(r.randrange(90))), *w, *(word() for _ in range(r.randrange(90)))])))
    rows += [rows[-1], (None, templates[5][1].upper() + "!")]
    want = set()
    for d, t in rows:
        w = license_scan.words((t or "").encode())
        for name, text in templates:
            x = license_scan.words(text.encode())
            k = min(5, len(x))
            mine, theirs = ([tuple(y[i : i + k]) for i in range(len(y) - k + 1)] for y in (x, w))
            if any(len({*mine} & {*theirs[i : i + len(mine)]}) >= 0.75 * len({*mine}) for i in range(len(theirs))):
                want.add((d, name))
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), templates).collect()
    texts = dict(rows)
    assert want and {(g.doc_id, g.license_id) for g in got} >= want
    for g in got:
        w, x = license_scan.words(texts[g.doc_id].encode()), license_scan.words(dict(templates)[g.license_id].encode())
        k = min(5, len(x))
        mine, theirs = ({tuple(y[i : i + k]) for i in range(len(y) - k + 1)} for y in (x, w[g.start_word : g.end_word]))
        assert len(mine & theirs) / len(mine) == pytest.approx(g.containment) and g.containment >= 0.75
    assert sum(g.doc_id == rows[-2][0] for g in got) == 2 * len({n for d, n in want if d == rows[-2][0]})


def test_license_bands_catch_the_worst_pair():
    for size in (1, 2, 4, 8, 64, 1024):
        j = license_scan.worst(size)
        assert j >= 1 / 3 and (j == 1 or 1 - (1 - j**license_scan.ROWS) ** license_scan.n_bands(size) >= license_scan.CATCH)


def test_runs_merge_without_sorting():
    """A merge of sorted runs holds each key once, in order, with the row that stays and all rows counted."""
    r = random.Random(9)
    for _ in range(60):
        rows = [(bytes([r.randrange(6), 0]).ljust(48, b"\0"), -r.randrange(3), r.randrange(2), r.randrange(4), r.randrange(2), i) for i in range(r.randrange(1, 40))]
        runs = [exact_dedup._records(rows[i::5], i) for i in range(5) if rows[i::5]]
        got = exact_dedup.merged(runs)
        want = {}
        for i, (k, *x, pos) in enumerate(rows):
            want.setdefault(k, []).append((*x, i % 5, pos))
        assert [k.ljust(48, b"\0") for k in got["key"].tolist()] == sorted(want)
        assert [(tuple(int(g[f]) for f in exact_dedup.STAYS), int(g["n_rows"])) for g in got] == [(min(want[k]), len(want[k])) for k in sorted(want)]


def test_byte_bpe_takes_every_match_through_the_tree(monkeypatch):
    """Of each new match that is no token, n bytes are joined by n - 1 joins, less those of parts that are remembered; a megabyte text and its decoding agree with the library."""
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.ByteBPE(vocabulary_path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    n, join = [0], byte_bpe.ByteBPE.join
    monkeypatch.setattr(byte_bpe.ByteBPE, "join", lambda self, a, b: (n.__setitem__(0, n[0] + 1), join(self, a, b))[1])
    word = "qzxjvkwbfy"
    assert b"".join(bpe.tokens(word.encode())) == word.encode() and n[0] == len(word) - 1
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdehiklmnoprstuéß中") for _ in range(r.randrange(1, 14))) for _ in range(120_000))
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    assert ids == enc.encode_ordinary(text) and bpe.decode(ids) == text.encode() and bpe.decode([]) == b""


def tongues(n=400, seed=3):
    """Texts in four invented languages, with copies, repeated rows, nulls and a very long text."""
    r = random.Random(seed)
    alphabets = {"aa": "abekimno", "bb": "dfghilos", "cc": "éèçaetru", "dd": "жзиклмно"}
    lexicon = {k: ["".join(r.choice(v) for _ in range(r.randrange(2, 8))) for _ in range(300)] for k, v in alphabets.items()}
    rows = []
    for i in range(n):
        lang = r.choice([*alphabets])
        text = " ".join(r.choice(lexicon[lang]) for _ in range(r.randrange(3, 60)))
        rows.append((i, text, r.choice([lang, lang, lang, None]), lang))
    rows.append((n, " ".join(r.choice(lexicon["cc"]) for _ in range(150_000)), "cc", "cc"))
    return rows + [rows[5]] * 40 + [(None, rows[7][1], "aa", rows[7][3]), (n + 1, None, "aa", "und"), (n + 2, "12 !?", "bb", "und")]


def test_language_id_of_held_out_documents(spark):
    """Held-out documents get their language; scores and rejections are those of a plain loop over the model's centroids."""
    rows = tongues()
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").repartition(3)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    model = language_id.fit(docs.where(~language_id.F.coalesce(language_id.crc_mod(4) == 2, language_id.F.lit(False))))
    truth = {(d, t): lang for d, t, _, lang in rows}
    texts = {d: t for d, t, *_ in rows}
    right = seen = 0
    for g in language_id.op2(docs).collect():
        assert g.held_out == held(g.doc_id)
        want = truth[g.doc_id, texts[g.doc_id]]
        if g.held_out:
            seen += 1
            right += g.lang_pred == want
        if want == "und":
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        b = texts[g.doc_id].encode().translate(language_id._TABLE)
        b = b" " + b" ".join(b.split()) + b" "
        count = [0.0] * language_id.DIMS
        for k in language_id.ORDERS:
            for i in range(len(b) - k + 1):
                code = 0
                for c in b[i : i + k]:
                    code = (code * 257 + c) % 2**32
                count[((code * 2654435761 + k * 40503) % 2**32) >> (32 - language_id.DIMS.bit_length() + 1)] += 1
            if len(b) > 10_000:
                break
        if len(b) > 10_000:
            continue
        x = [math.log1p(c) * w for c, w in zip(count, model.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        cosine = [sum(v * c for v, c in zip(x, centre, strict=True) if v) / norm for centre in model.centres]
        best = max(range(len(cosine)), key=lambda j: cosine[j])
        assert g.score == pytest.approx(cosine[best], abs=1e-4) and max(cosine[j] for j in range(len(cosine)) if model.langs[model.of[j]] == g.lang_pred) == pytest.approx(cosine[best], abs=1e-5)
    assert seen > 50 and right >= 0.98 * seen


CLASHING = "doc_id long, text string, lang string, source string, k1 string, k2 string, block string, bucket string, n int, h string, run string, key string, shard string, records string, kept string, id string, sign string, chunk string, counts string, held_out string, size string, target string, vals string, kind string"


@pytest.fixture(scope="module")
def edges(spark):
    """Repeated rows, doc_ids with several texts, null doc_ids, blanks and nulls in every column, ties, a text over a megabyte, and columns whose names the operators use themselves."""
    r = random.Random(17)
    long_text = " ".join(f"word{r.randrange(3000)}" for _ in range(140_000))
    base = [(1, "Released under the MIT License. " * 3, "en", "s"), (1, "another text of document one, with more words than before", "en", None), (2, None, None, None), (2, "", "fr", "s"), (None, "no id here", "en", "t"), (None, "no id here", "en", "t"), (None, None, None, None), (3, long_text, "fr", "t"), (4, "x", None, "s"), (4, "x", None, "s"), (4, "x", None, "s")]
    rows = [(*b, *("clash",) * 4, 7, *("clash",) * 15) for b in base]
    return spark.createDataFrame(rows, CLASHING).repartition(3), base


@pytest.mark.parametrize("name", ALL)
def test_edge_rows(edges, name):
    """Every operator answers each row, repeated or not, without minding other columns; equal rows get equal answers."""
    df, base = edges
    got = ALL[name](df).collect()
    if name == "license":
        assert {(g.doc_id, g.license_id) for g in got} == {(1, "MIT")}
        return
    assert collections.Counter(g.doc_id for g in got) == collections.Counter(b[0] for b in base)
    four = [g.asDict() for g in got if g.doc_id == 4]
    if name in ("dedup", "files"):
        four = [{k: v for k, v in x.items() if k not in ("kept", "start")} for x in four]
    assert all(x == four[0] for x in four)


def test_edge_rows_of_join_dedup_and_bpe(edges):
    df, base = edges
    join = ngram_join.ngram_join(df, links=True).drop("text_hash").collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(tuple, join), key=key) == sorted(joined([b[:2] for b in base]), key=key)
    kept = [g for g in exact_dedup.exact_dedup(df).collect() if g.kept]
    assert len(kept) == len({(b[1] or "").encode().translate(None, b" \t\n\x0b\x0c\r") for b in base})
    long_text = base[7][1]
    (three,) = [g for g in byte_bpe.byte_bpe(df).collect() if g.doc_id == 3]
    assert three.decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()


def mixed_copies(rows):
    """How often the mix takes each doc_id of a source, from sizes sorted by hash. rows: doc_id, text, source."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    by = collections.defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * by[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * by[s] for s in over}
        left -= sum(2 * by[s] for s in over)
        open_ -= over
    out = {}
    h = lambda d: int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:12], 16)
    for s in order:
        mine = sorted((h(d), n, d) for (d, _, x), n in zip(rows, size, strict=True) if x == s)
        passes = min(2, int(target[s] // by[s])) if by[s] else 0
        need, below = target[s] - passes * by[s], 0
        for k in sorted({m[0] for m in mine}):
            own = sum(n for x, n, _ in mine if x == k)
            take = passes < 2 and need > 0 and (below + own <= need or (below <= need and below + own - need <= need - below))
            below += own
            for x, _, d in mine:
                if x == k:
                    out[d, s] = passes + take
    return out


def test_pipeline_rows(spark, tmp_path):
    """run() against every stage by brute force: quality, exact copies, near copies, the mix, tokens."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randrange(2, 8)))
    rows = [(900, None, "en", "a"), (901, "", "en", "b"), (902, "too few words", "en", "c"), (903, "same three words " * 40, "en", "a")]
    for i in range(70):
        w = [word() for _ in range(r.randrange(55, 120))]
        kind = i % 7
        if kind == 1 and i > 7:
            w = rows[-1][1].split()
            w[r.randrange(len(w))] = word()
        text = "  ".join(rows[-1][1].split()) + " " if kind == 2 and i > 7 else " ".join(w)
        rows.append((None if i == 30 else i // 2 if i in (40, 41) else i, text, "en", r.choice(["a", "b", "c", None])))
    rows += rows[10:14]
    rows.append((rows[12][0], " ".join(word() for _ in range(80)), "en", "a"))  # another text of a doc_id whose first text is a copy
    rows.append((rows[5][0], rows[20][1] + " and then " + word(), "en", "b"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [x for x in rows if plain_quality(x[1])[6]]
    norm = lambda t: (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
    stays = {}
    for x in docs:
        k = (-len(x[1]), x[0] is None, x[0] or 0, exact_dedup.text_hash(x[1].encode()))
        if norm(x[1]) not in stays or k < stays[norm(x[1])][0]:
            stays[norm(x[1])] = (k, x)
    docs = [x for _, x in stays.values()]
    component = joined([x[:2] for x in docs])
    docs = [x for x, c in zip(docs, component, strict=True) if c[2] is None or c[0] is None or c[2] == c[0]]
    copies = mixed_copies([(d, t, s) for d, t, _, s in docs])
    bpe = byte_bpe.model(vocabulary_path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = collections.Counter()
    for d, t, _, s in docs:
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[d, s]
    assert len(docs) < len(rows) and got == +want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_ties(spark):
    """Rows of one doc_id share a hash, so they are taken together or not at all."""
    rows = [(d, " ".join(["w"] * (1 + d % 5)), s) for s in ("a", "b", None) for d in (1, 2, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    want = mixed_copies(rows)
    assert len(got) == len(rows) and all(g.copies == want[g.doc_id, g.source] for g in got)
