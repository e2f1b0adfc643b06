"""Text operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.llm import chunks, contamination as decon, shingle_join as shingles, words
from residua.llm.contamination import contamination
from residua.llm.repeats import remove_repeats
from residua.llm.shingle_join import shingle_join

BLANK = re.compile(r"[\x20\x09-\x0d]+")
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def texts(seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(rng.choice(["on", "the", "Hill", "tree", "água", "été,", "x", "run", "far", "Sky."], n))
    unique = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    base = unique(120, 0)
    return [
        None, "", " \t\n ", "one", "one", "two words", "a b c", word(30), base, base, base.upper(),
        base.replace("w0x50", "changed"), base.replace("w0x10 ", ""), unique(60, 1) + " " + PASSAGE + " " + unique(5, 2), PASSAGE + "\n" + unique(50, 3),
        unique(34, 4), unique(34, 4), unique(35, 5), unique(35, 5) + " tail", " ".join(["again"] * 200), "nbsp stays one word " + unique(40, 6), word(400),
        unique(30_000, 7), unique(30_000, 7) + " end",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"n{i}", i * 2, "c") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int, component_id string").repartition(3)


def split(t, lower=False):
    if lower and t:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return [w for w in BLANK.split(t or "") if w]


def test_words_and_windows():
    t = pa.array(["Ab  cd", None, "", "été x", "\tab\n"])
    w = words.split(t, words.LOWER)
    assert [[w.string(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [["ab", "cd"], [], [], ["été", "x"], ["ab"]]
    assert w.hashes[0] == w.hashes[4] and len(set(w.hashes.tolist())) == 4
    h = words.mix(np.arange(1000, dtype=np.uint64) % np.uint64(10))
    for family in (0, 1):
        rolled = words.windows(h, 7, family)
        assert len(rolled) == 994 and len(set(rolled.tolist())) == 10 and (rolled[:10] == rolled[10:20]).all()
    assert (words.windows(h, 7) != words.windows(h, 7, 1)).all()
    assert len(words.windows(h[:3], 7)) == 0


def test_segments_do_not_change_hashes(monkeypatch):
    t = pa.array([" ".join(texts()[22].split()[:3000]), "x" * 5000])
    whole = words.split(t, words.PLAIN)
    rolled = words.windows(whole.hashes, 35)
    monkeypatch.setattr(words, "SEGMENT", 64)
    assert (words.split(t, words.PLAIN).hashes == whole.hashes).all()
    assert (words.windows(whole.hashes, 35) == rolled).all()


def test_repeats_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 40_000)
    rows = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    lists = {r["doc_id"]: split(r["text"]) for r in docs.collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in lists.values() for i in range(len(w) - 34))
    for k, w in lists.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        left = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (rows[k]["n_words"], rows[k]["n_removed"], rows[k]["kept"] or "") == (len(w), len(w) - sum(keep), left)
        assert rows[k]["score"] == 2 * k
    assert rows[0]["kept"] is None and rows[1]["kept"] == ""
    assert rows[15]["n_removed"] == 0 and rows[17]["n_removed"] == 35 and rows[19]["n_removed"] == 200
    assert remove_repeats(docs.where("false")).count() == 0
    twice = remove_repeats(docs.where("doc_id = 20").unionByName(docs.where("doc_id = 20"))).collect()
    assert [(r["n_removed"], r["kept"]) for r in twice] == [(r["n_words"], "") for r in twice]
    with pytest.raises(ValueError):
        remove_repeats(docs, window=30, block=18)


ITEMS = [(1, " ".join(f"shared{i}" for i in range(12))), (2, "Two, words!"), (3, None), (4, ""), (10, "the hill tree"), (10, "the hill tree"), (5, " ".join(f"w7x{i}" for i in range(100, 130))), (None, "one")]


def contaminated(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = cut(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w and k is not None else []:
            windows[tuple(w[i : i + n])].add(k)
    for k, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n)), found.update(own)
        yield k, (len(w), len(hit), sorted(found))


@pytest.mark.parametrize("most", [decon.BROADCAST_WORDS, 0])
def test_contamination_equals_brute_force(spark, docs, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, items, broadcast_words=most).collect()}
    want = dict(contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS))
    assert got == want
    assert sum(h > 0 for _, h, _ in got.values()) >= 5
    flags = contamination(docs, items, broadcast_words=most, covered=True).where("doc_id = 5").first()
    assert flags["covered"] == [True, True] and flags["n_items"] == 1
    assert contamination(docs.where("false"), items, broadcast_words=most).count() == 0
    assert contamination(docs, items.where("false"), broadcast_words=most).agg(F.sum("n_hit")).first()[0] == 0


def test_winnowing_keeps_every_shared_span():
    rng = np.random.default_rng(1)
    for _ in range(200):
        common = rng.integers(0, 5, 10)
        a, b = (words.mix(np.concatenate([rng.integers(0, 5, rng.integers(0, 30)), common, rng.integers(0, 5, rng.integers(0, 30))]).astype(np.uint64)) for _ in range(2))
        x, y = (set(decon.fingerprints(h, np.array([0, len(h)]), 10, 4)[0].tolist()) for h in (a, b))
        assert x & y


def shingle_set(t):
    w = split(t, lower=True)
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))}


def components(sets):
    label = {k: k for k in sets}
    for _ in sets:
        before = dict(label)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


def test_shingle_join_equals_brute_force(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join(docs).collect()}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    label = components(sets)
    assert got == {k: (len(s), label[k]) for k, s in sets.items()}
    assert got[9][1] == got[10][1] == got[11][1] == got[12][1] == 8 and got[0] == (0, 0)
    assert shingle_join(docs.where("false")).count() == 0


def near_copies(seed: int, n: int):
    """A chain of edits, whose ends are unlike, and a group of copies with one edit each."""
    rng = np.random.default_rng(seed)
    chain = [f"c{i}" for i in range(150)]
    out = []
    for i in range(n):
        chain[int(rng.integers(0, 150))] = f"new{i}"
        out.append(" ".join(chain))
        star = [f"s{j}" for j in range(100)]
        star[int(rng.integers(0, 100))] = f"star{i}"
        out.append(" ".join(star))
        out.append(" ".join([f"s{j}" for j in range(60)] + [f"own{i}x{j}" for j in range(int(rng.integers(5, 60)))]))
    return out


def test_shingle_join_on_chains_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 8)
    monkeypatch.setattr(shingles, "LEAF", 4)
    monkeypatch.setattr(shingles, "FLUSH", 500)
    rows = list(enumerate(near_copies(5, 25)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in shingle_join(df).collect()}
    assert got == components({k: shingle_set(t) for k, t in rows})


@pytest.mark.parametrize("seed", [1, 3])
def test_rows_without_key_hide_no_links(spark, seed):
    """Near copies of which some texts occur only without a key."""
    rng = np.random.default_rng(seed)
    rows = [(i if i % 2 else None, t) for i, t in enumerate(near_copies(seed, 12))]
    for i in range(6):
        pair = [f"base{i}x{j}" for j in range(60)]
        for k in range(6):  # keys for two of six
            copy = list(pair)
            copy[int(rng.integers(0, 60))] = f"edit{i}x{k}"
            rows.append((1000 + 10 * i + k if k < 2 else None, " ".join(copy)))
    got = shingle_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == components({k: shingle_set(t) for k, t in rows if k is not None})
    assert sum(r["doc_id"] is None for r in got) == sum(k is None for k, _ in rows) and all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_linked_pairs_share_a_slab_and_pass_the_bound():
    rng = np.random.default_rng(2)
    for trial in range(150):
        n = int(rng.integers(1, 400 if trial % 10 else 20_000))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = int(rng.integers(0, max(1, n // 10)))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12)))).astype(np.uint64)])
        shared, union = n - gone, len(b) + gone
        if 100 * shared < 85 * union:
            continue
        both = [np.sort(a), np.sort(b)]
        h, first = np.concatenate(both), np.array([0, n, n + len(b)])
        key, of = shingles.slab_keys(h, first, 85)
        assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())
        alone = [set(shingles.slab_keys(x, np.array([0, len(x)]), 85)[0].tolist()) for x in both]
        assert alone[0] == set(key[of == 0].tolist()) and alone[1] == set(key[of == 1].tolist())
        v = [p.tobytes() for p in shingles.points(h, first)]
        v = shingles.folded(v, min(map(len, v)))
        assert shingles.may_link(v[0], n, v[1], len(b), 85)


def test_points_that_travel_are_short_and_keep_linked_pairs():
    rng = np.random.default_rng(5)
    for n, percent, groups in ((60, 80, 64), (250, 80, 64), (800, 80, 128), (3000, 80, 256), (9000, 80, 1024), (250, 85, 64), (250, 50, 256)):
        a = rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)
        gone = n * (100 - percent) // 100 // 2
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)])
        other = rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)
        sets = [np.sort(x) for x in (a, b, other)]
        sizes = np.array([len(x) for x in sets])
        first = np.concatenate([[0], np.cumsum(sizes)])
        short = shingles.narrowed(shingles.points(np.concatenate(sets), first), sizes, percent)
        assert len(short[0]) == groups
        v = shingles.folded([x.tobytes() for x in short], min(map(len, short)))
        assert 100 * (n - gone) >= percent * (n + gone // 2) and shingles.may_link(v[0], sizes[0], v[1], sizes[1], percent)
        if percent > 50:
            assert not shingles.may_link(v[0], sizes[0], v[2], sizes[2], percent)
    many = np.full(3000, 1 << 63, np.uint64)  # counts beyond a byte
    short = shingles.narrowed(shingles.points(many[:290], np.array([0, 290])), np.array([290]), 80)
    assert short[0].max() == 255 and shingles.may_link(short[0].astype(np.int64), 290, short[0].astype(np.int64), 290, 80)


def test_tree_finds_the_pairs_of_the_bound():
    rng = np.random.default_rng(4)
    n = rng.integers(40, 200, 300)
    v = np.array([np.bincount(rng.integers(0, 64, k), minlength=64) for k in n])
    v[150:] = v[:150]
    part = np.arange(300) // 3
    for side in (np.zeros(300, int), np.arange(300) % 2):
        i, j = shingles.tree_pairs(v, n, side, part, 85)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {
            (a, b) for a in range(300) for b in range(a + 1, 300)
            if part[a] != part[b] and (not side.any() or side[a] != side[b]) and shingles.may_link(v[a], int(n[a]), v[b], int(n[b]), 85)
            and 85 * max(int(v[a].sum()), int(v[b].sum())) <= 100 * min(int(v[a].sum()), int(v[b].sum()))
        }
        sized = {p for p in got if 85 * max(int(v[p[0]].sum()), int(v[p[1]].sum())) <= 100 * min(int(v[p[0]].sum()), int(v[p[1]].sum()))}
        assert want <= got and sized == want
