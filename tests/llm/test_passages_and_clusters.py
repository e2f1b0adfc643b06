"""Suffix sort and earlier passages, centroid clusters and tokenizer alignment against brute force."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from residua.llm import suffix_dedup, tokenizer_alignment as alignment
from residua.llm.centroids import centroid_clusters, described, nearest, rotation
from residua.llm.suffix_dedup import anchors, remove_earlier_passages
from residua.llm.suffix_sort import PrefixHashes, sorted_suffixes
from residua.llm.tokenizer_alignment import Aligner, align_tokenizers, load_pair, segments

# --- suffix sort -----------------------------------------------------------------------------------------


def test_extension_is_the_common_prefix():
    data = np.frombuffer(b"abracadabra abracadabrb" + b"x" * 40, np.uint8)
    hashes = PrefixHashes(data)
    i, j = np.array([0, 0, 7, 3, 23]), np.array([12, 7, 19, 4, 24])
    raw = data.tobytes()
    for limit in (1, 4, 10, 13):
        want = [next((k for k in range(limit) if raw[a + k] != raw[b + k]), limit) for a, b in zip(i, j)]
        assert hashes.extension(i, j, limit).tolist() == want


@pytest.mark.parametrize("bits", [64, 3])
def test_suffixes_are_in_order_also_when_hashes_collide(bits):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[1000:1300] = data[2000:2300]
    suffix = rng.permutation(3900)
    group = suffix % 5
    order, same = sorted_suffixes(data, suffix, group, 12, bits)
    rows = [(group[k], data[suffix[k] : suffix[k] + 12].tobytes()) for k in order]
    assert rows == sorted(rows)
    assert same.tolist() == [False] + [a == b for a, b in zip(rows, rows[1:])]
    assert [len(x) for x in sorted_suffixes(data, np.empty(0, np.int64), np.empty(0, np.int64), 12)] == [0, 0]


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 200).astype(np.uint8))
    texts = [b"left " * 9 + passage + b" tail", passage, b"zz" + passage + passage, b"", b"short"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for segment in (1 << 18, 64):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        a = anchors(data, at, 50, np.ones(5, bool))
        seen = {}
        for first, last, place, gram in zip(a.first, a.last, a.place, a.gram):
            for s in range(first, last + 1):
                assert s <= place and place + 25 <= s + 50
                assert seen.setdefault(data[s : s + 50].tobytes(), (place - s, gram)) == (place - s, gram)
        assert sum(a.last - a.first + 1) == sum(max(len(t) - 49, 0) for t in texts)


def earlier(rows, length=50):
    """Brute force: (n_bytes, n_removed, n_spans, kept) by row."""
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        if key is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if key is not None and first[raw[i : i + length]] < key:
                gone[i : i + length] = [True] * length
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((len(raw), sum(gone), spans, None if text is None else bytes(c for c, g in zip(raw, gone) if not g)))
    return out


def passages(seed=5):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(rng.choice(["on", "the", "Hill", "tree", "água", "été", "x", "run", "far", "Sky."], n))
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    line = "This line of exactly some length is in very many texts, word by word. "
    base = own(0, 60)
    rows = [(k + 20, f"{own(k + 100, 8)} {line}{own(k + 300, 8)}") for k in range(60)]
    rows += [(None, base), (None, None), (1, None), (2, ""), (3, "short"), (9, base), (4, base), (4, base), (5, base[:200]), (6, "é" + base[100:300] + "é")]
    rows += [(7, word(300)), (8, word(300) + base[50:120]), (10, "a" * 300), (11, "a" * 49), (12, "b" + "a" * 120), (13, own(7, 4000)), (14, own(7, 4000) + " end"), (15, line * 3)]
    return rows


@pytest.mark.parametrize("hot", [256, 8])
def test_earlier_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 20_000)
    rows = passages()
    want = earlier(rows)
    docs = spark.createDataFrame([(k, t, n, f"k{n}", n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n_spans long, kept string, row int").repartition(5)

    found = {r["row"]: r for r in remove_earlier_passages(docs, hot=hot).collect()}
    assert len(found) == len(rows)
    for n, w in enumerate(want):
        r = found[n]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], None if r["kept"] is None else bytes(r["kept"])) == w, rows[n]


@pytest.mark.parametrize("length", [1, 7, 33])
def test_other_lengths(spark, length):
    rows = [(k, t) for k, t in passages() if t is None or len(t) < 2000][:40]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id int, text string, row int")
    found = {r["row"]: r for r in remove_earlier_passages(docs, length=length).collect()}
    for n, w in enumerate(earlier(rows, length)):
        assert (found[n]["n_bytes"], found[n]["n_removed"], found[n]["n_spans"]) == w[:3]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_earlier_passages(empty).collect() == []
    assert align_tokenizers(empty, load_pair()).collect() == []
    assert centroid_clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError):
        remove_earlier_passages(empty, length=0)


# --- centroid clusters -----------------------------------------------------------------------------------


def clusters(rows, k=16, rounds=3, size=64):
    """Brute force in Python integers; rows (id, vector)."""
    kept = [(i, [int(np.floor(64 * float(y))) for y in v]) for i, v in rows if v is not None and len(v) == size and all(y is not None and np.isfinite(y) for y in v)]
    mark = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [min((d(v, c), n) for n, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        by = defaultdict(list)
        for (_, v), (_, n) in zip(kept, place()):
            by[n].append(v)
        for n, vs in by.items():
            now[n] = [sum(c) // len(vs) for c in zip(*vs)]
    last = place()
    inertia = Counter()
    for dist, n in last:
        inertia[n] += dist
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, n, dist, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (dist, n) in zip(kept, last))


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 64))
    rows = [(i, (centres[i % 7] + rng.normal(size=64) * 0.4).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [float("nan")] * 64), (n + 4, [None] * 64), (n + 5, [float("inf")] + [0.0] * 63), (n + 6, [0.0] * 64), (n + 7, [0.0] * 64)]
    rows += [(3, rows[3][1])] * 5 + [(None, rows[4][1]), (n + 8, [-0.01] * 64), (n + 9, [900_000.0] * 64)]
    return rows


@pytest.mark.parametrize("n", [0, 5, 400])
def test_clusters_equal_brute_force(spark, n):
    rows = vectors(n) if n else [(1, [0.5] * 64)] * 3
    table = spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance double").repartition(4)
    got = Counter(tuple(r) for r in centroid_clusters(table).collect())
    assert got == clusters(rows)


def test_bound_loses_no_centroid_and_saves_distances():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 64)) * 200
    x = np.floor(base[rng.integers(0, 5, 3000)] + rng.normal(size=(3000, 64)) * 20).astype(np.int64)
    c = x[rng.choice(3000, 16, replace=False)]
    c[5] = c[2]  # a tie for every row
    centre, axes = rotation((x.T @ x).astype(float), x.sum(0).astype(float), len(x))
    lead, rest = described(x.astype(float), centre, axes, 12)
    number, distance, computed = nearest(x, lead, rest, c, centre, axes)
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert computed < 0.5 * every.size


def test_too_large_components_are_refused(spark):
    table = spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        centroid_clusters(table).collect()


# --- tokenizer alignment -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return load_pair()


@pytest.fixture(scope="module")
def direct(pair):
    """Tokens of a whole text as (id, bytes) under A and B, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    letters = {v: k for k, v in json.loads(pair.a_json)["model"]["vocab"].items()}
    assert decoders.ByteLevel().decode([letters[289]]) == " h"
    back = alignment._byte_of_letter()

    def tokens(text):
        left = [(i, bytes(back[c] for c in letters[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right

    return tokens


def brute(text, tokens):
    """(n_a, n_b, n_groups, links, groups) of a text."""
    if not text:
        return 0, 0, 0, [], ""
    left, right = tokens(text)
    want = (" " + text).encode()
    if b"".join(t for _, t in left) != want or b"".join(t for _, t in right) != want:
        return 0, 0, 0, [], ""
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, t in side:
            out.append((at, at + len(t), i))
            at += len(t)
        spans.append(out)
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, lo = [], 0
    for e in both:
        groups.append("|".join(",".join(str(i) for s, f, i in side if s >= lo and f <= e) for side in spans))
        lo = e
    return len(left), len(right), len(both), links, ";".join(groups)


TEXTS = [
    None, "", " ", "  ", "x", " x", "x ", "hello world", "Don't stop, it's 12,5%!  Two  spaces\n\nnew\tline \n", "été à l'eau — “quoted”…", "日本語 text 中文。", "emoji 😀👩‍👩‍👧 zwj", "<|endoftext|> <s> </s> <0x41>",
    "under▁score", "▁", "a ▁b", "nbsp here  wide 　cjk", "\x00\x01 ctl\x7f", "word" * 300, "(word) [a1b2] x_y-z 'quoted' ''s 's", "tab\t\tx", "é combining ́", "﻿bom", "repeat repeat repeat",
    "repeat repeat repeat", "ﬁ ligature ǅ", "𝔘𝔫𝔦 \U000e0001", "1st 2nd 3.14 1'000", "end.\nThe start", "line\r\nline", " \u0085 ᠎ x", "\n leading", "trailing \n ",
]


def test_segments_cover_texts(pair):
    t = pa.array(TEXTS)
    data, starts, ends, first = segments(t)
    for text, lo, hi in zip(TEXTS, first[:-1], first[1:]):
        raw = b"".join(data[s:e].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi]))
        assert raw == ((" " + text).encode() if text else b"")


def check_alignment(aligner, texts, tokens):
    got = alignment._aligned(aligner, pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        n_a, n_b, n_groups, links, groups = brute(text, tokens)
        assert (got["n_a"][k], got["n_b"][k], got["n_groups"][k], got["n_links"][k]) == (n_a, n_b, n_groups, len(links)), text
        assert got["groups_sha256"][k] == (hashlib.sha256(groups.encode()).hexdigest() if n_a else ""), text
        pairs, times = np.frombuffer(got["pairs"][k], np.int64), np.frombuffer(got["times"][k], np.uint32)
        want = Counter(a * aligner.n_b + b for a, b in links)
        assert dict(zip(pairs.tolist(), times.tolist())) == dict(want), text


def test_alignment_of_texts_equals_whole_encodings(pair, direct):
    aligner = Aligner(pair)
    check_alignment(aligner, TEXTS, direct)
    check_alignment(aligner, TEXTS[::-1], direct)  # from what is known


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("ab Z19.,'\n\t -é▁ 　日😀")), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=6))
def test_alignment_of_any_text(pair, direct, texts):
    check_alignment(Aligner(pair), texts, direct)


@pytest.mark.parametrize("broadcast", [1 << 27, 0])
def test_alignment_counts(spark, pair, direct, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "CACHE", 50)
    texts = [*TEXTS, "hello there world", "hello world"] * 2
    docs = spark.createDataFrame([(None if k % 7 == 0 else k % 5, t, k, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, row int, n_a string, __pairs string").repartition(3)
    found = {r["row"]: r for r in align_tokenizers(docs, pair, broadcast_bytes=broadcast).collect()}
    parts = [brute(t, direct) for t in texts]
    counts, most = Counter(), defaultdict(int)
    for p in parts:
        counts.update(set(p[3]))
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    assert len(found) == len(texts)
    for k, (n_a, n_b, n_groups, links, _) in enumerate(parts):
        r = found[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, len(links))
        assert r["n_best"] == sum(counts[x] == most[x[0]] for x in links) and r["count_sum"] == sum(counts[x] for x in links)
        assert r["__pairs"] == "y"
