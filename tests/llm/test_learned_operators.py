"""Language model, classifiers, piece operators, url rules, vectors and the pipeline on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.llm import language_model, pieces, quality, sentence_pieces, token_counts, toxicity, url_filter, vector_neighbours
from residua.llm.components import connected_components
from residua.llm.url_filter import Rule, judge_urls
from residua.llm.vector_neighbours import near_duplicates
from residua.llm.words import split

FOLDER = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n", "the the the", "The hill, the tree.", "über été 東京 😀\x00 x", "a  b   c ", "x" * 300, "word " * 3000, "the hill, the tree.", "1,000 (e.g.) “quoted…” don't"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"own{i}", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, score string, ids long").repartition(3)


@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces()


# components ------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(0, 0), (1, None), (700, 701)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901 + i) for i in range(200)]
    label: dict = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in label}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# language model --------------------------------------------------------------


def brute_scores(train, texts):
    cut = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "").translate({i: " " for i in range(9, 14)})).split(" ") if w] + [""]
    one, two = Counter(), Counter()
    for t in train:
        w = cut(t)
        one.update(w), two.update(zip(["", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    unseen = max(sum(c == 1 for c in two.values()) / n, 1e-6)
    for t in texts:
        w = cut(t)
        p1 = [(one[x] + 1) / (n + v + 1) for x in w]
        p2 = []
        for a, b, p in zip(["", *w], w, p1, strict=False):
            seen = 2 ** int(math.log2(two[a, b])) if two[a, b] else 0
            p2.append((1 - unseen) * min(seen, one[a]) / one[a] + unseen * p if one[a] else p)
        yield len(w), sum(one[x] > 0 for x in w), sum(map(math.log10, p1)), sum(map(math.log10, p2))


@pytest.mark.parametrize("most", [language_model.BROADCAST_BYTES, 0])
def test_language_model_equals_brute_force(spark, docs, most):
    model = language_model.fit(docs.where("doc_id % 2 = 1 OR doc_id = 4"))
    rows = language_model.score(docs, model, broadcast_bytes=most).orderBy("doc_id").collect()
    train = [t for i, t in enumerate(TEXTS) if i % 2 or i == 4]
    for r, want in zip(rows, brute_scores(train, TEXTS), strict=True):
        assert (r["n_tokens"], r["n_known"]) == want[:2]
        assert np.allclose([r["base_score"], r["score"]], want[2:], rtol=1e-9)
    assert rows[0]["ids"] == 0
    empty = language_model.fit(docs.where("false"))
    assert language_model.score(docs.where("doc_id = 3"), empty, broadcast_bytes=most).first()["n_known"] == 0
    assert language_model.score(docs.where("false"), model, broadcast_bytes=most).count() == 0


def test_filter_finds_all_and_little_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.geometric(0.2, len(keys))
    packed = language_model.build_filter(keys, counts)
    level = language_model.filter_levels(packed, keys)
    want = np.floor(np.log2(counts)).astype(int) + 1
    assert (level >= want).all() and (level > want).mean() < 0.03
    assert (language_model.filter_levels(packed, rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)) > 0).mean() < 0.03


# classifiers -----------------------------------------------------------------


def test_factorisation_identity_and_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.train_machine(x[:2000], y[:2000], rank=4, epochs=60, rate=0.05)
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    z = np.clip((x[:5] - m.mean) / m.scale, -6, 6)
    pairs = sum((m.factors[i] @ m.factors[j]) * z[:, i] * z[:, j] for i in range(6) for j in range(i + 1, 6))
    assert np.allclose(m.logits(x[:5]), m.bias + z @ m.linear + pairs)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "n_chars")
    words = ["trash", "worthless", "pathetic"]
    toxic = [(10_000 + i, f"the hill {words[i % 3]} and v{i} {words[(i + 1) % 3]} x{i} on w{i}", 1) for i in range(60)]
    clean = [(20_000 + i, f"the hill and v{i} tree x{i} on w{i} tresh", 0) for i in range(200)]
    return docs, spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")


def test_quality_on_edge_rows(spark, docs, labelled):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    machine = quality.fit(labelled[0].join(labels, "doc_id"), metadata=["n_chars"])
    again = quality.fit(labelled[0].join(labels, "doc_id").repartition(7), metadata=["n_chars"])
    assert np.allclose(machine.linear, again.linear)
    rows = quality.score(docs.withColumn("n_chars", F.when(F.col("doc_id") > 3, F.length("text"))), machine, metadata=["n_chars"]).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows) and rows[4]["ids"] == 4
    assert np.isclose(rows[0]["score"], rows[1]["score"])
    none = quality.fit(labelled[0].withColumn("quality", F.lit(None).cast("int")))
    assert quality.score(docs.where("false"), none).count() == 0 and quality.score(docs, none).count() == len(TEXTS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
    terms = sorted({word() for _ in range(60)})
    root = toxicity.trie(terms)
    for k in (0, 1, 2):
        for w in {word() for _ in range(80)}:
            want = {(i, distance(w, t)) for i, t in enumerate(terms) if distance(w, t) <= k}
            assert set(toxicity.within(w, root, k)) == want


def test_toxicity_finds_misspellings_and_spares_quotes(spark, docs, labelled):
    lexicon = toxicity.fit(labelled[1])
    assert lexicon.terms == ["pathetic", "trash", "worthless"]
    tried = [
        "you are a worthless pathetic one", "you are a w0rthles patethic pathetik one", "he said \"worthless\" once in a long report about the hill and the tree and more",
        "so worthless once in a long report about the hill and the tree and much more", "the hill and the tree", None, "", "tresh on the hill",
    ]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), lexicon).orderBy("doc_id").collect()]
    assert got[0] > 0.7 and got[1] > 0.5 and got[2] < got[3] and got[4] == got[5] == got[6] == got[7] < 0.2
    rows = toxicity.score(docs, lexicon).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS) and rows[3]["ids"] == 3 and rows[8]["n_hits"] == 0
    assert toxicity.score(docs.where("false"), lexicon).count() == 0
    none = toxicity.fit(labelled[1].where("toxic = 0"))
    assert toxicity.score(docs, none).where("score > 0.1").count() == 0


def test_candidates_hold_every_word_one_edit_away():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon(["worthless", "trash", "été-là".replace("-", "")], np.ones(3), {})
    for t in lexicon.terms:
        for _ in range(300):
            i, c = rng.randrange(len(t)), rng.choice("abcéz")
            w = rng.choice([t[:i] + t[i + 1 :], t[:i] + c + t[i:], t[:i] + c + t[i + 1 :]])
            assert len(lexicon.candidates(split(pa.array([w]), toxicity.LETTERS))) == 1


# pieces ----------------------------------------------------------------------


@pytest.mark.parametrize("most", [pieces.BROADCAST_TOKENS, 0])
def test_encoding_equals_the_library(spark, docs, table, most):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = sentence_pieces.encode(docs, table, broadcast_tokens=most, exact=True)
    rows = sentence_pieces.decode(coded, table).orderBy("doc_id").collect()
    for r, t in zip(rows, TEXTS, strict=True):
        assert r["decoded"] == t and r["exact"] and r["score"] == f"own{r['doc_id']}"
        assert r["ids"] == (None if t is None else library.encode(t)) and r["n_tokens"] == len(r["ids"] or [])
    assert sentence_pieces.encode(docs.where("false"), table, broadcast_tokens=most).count() == 0
    broken = spark.createDataFrame([([40_000, -1, None],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in sentence_pieces.decode(broken, table).collect()] == ["", None, ""]


def test_encoding_tasks_hold_little_beside_the_answers(spark, table, monkeypatch):
    """The functions of the tasks, run here on 2 MB of text: all they allocate at a time."""
    import tracemalloc

    rows = [(i, " ".join(f"{'ab'[j % 2]}{(i * 7 + j) % 9000}word" for j in range(160))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kind, tasks = type(docs), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, *more, **named: tasks.append(f) or plain(df, f, *more, **named))
    coded = sentence_pieces.encode(docs, table, exact=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    assert batch.nbytes > 2 << 20
    peaks, seen = [], []
    for f in (tasks[0], tasks[-1]):
        tracemalloc.start()
        seen.append([b.num_rows for b in f(iter([batch]))])
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert sum(seen[1]) == len(rows) == coded.where("exact").count()
    assert max(peaks) < 16, peaks


def test_answers_take_no_room_of_their_own():
    import tracemalloc

    h, begin = np.arange(1_000_000, dtype=np.int64) * 3, np.arange(1_000_001, dtype=np.uint32) * 2
    values = np.arange(2_000_000, dtype=np.int32)
    tracemalloc.start()
    known = pieces.Answers([(h[500_000:], begin[:500_001], values[1_000_000:]), (h[:500_000], begin[:500_001], values[:1_000_000])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = known.find(np.array([2_400_000, 0, 2_400_000], np.uint64))
    assert [found.values[b : b + n].tolist() for b, n in zip(found.begin[found.at], found.sizes[found.at], strict=True)] == [[1_600_000, 1_600_001], [0, 1], [1_600_000, 1_600_001]]
    assert peak < 1 << 20


def best_by_force(word, table):
    best = {0: (0.0, 0)}
    for e in range(1, len(word) + 1):
        options = []
        for s in range(e):
            if (p := table.scores.get(word[s:e])) is not None:
                options.append((best[s][0] + p[1], best[s][1] + 1, s))
        if word[e - 1] not in table.scores:
            options.append((best[e - 1][0] + table.unknown_score, best[e - 1][1] + len(word[e - 1].encode()), e - 1))
        top = max(o[0] for o in options)
        best[e] = next(o[:2] for o in sorted(options, key=lambda o: o[2]) if o[0] == top)
    return best[len(word)]


def test_viterbi_fold_and_counts(spark, docs, table, monkeypatch):
    from dataclasses import replace

    unigram = replace(table, merges=False)
    words = sorted({"▁" + w for t in TEXTS if t for w in t.split()[:20] if len(w) < 40} | {"▁thestion", "▁▁▁a", "😀", "a"})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "h long, token string")
    got = {r["h"]: r["value"] for r in sentence_pieces.lattice_ids(df, unigram).collect()}
    score = {i: s for i, s in unigram.scores.values()}
    for i, w in enumerate(words):
        want, n = best_by_force(w, unigram)
        assert len(got[i]) == n
        if all(c in unigram.scores for c in w):
            assert np.isclose(sum(score[x] for x in got[i]), want)
    monkeypatch.setattr(sentence_pieces, "LONG", 3)
    assert {r["h"]: r["value"] for r in sentence_pieces.lattice_ids(df, unigram).collect()} == got
    for most in (pieces.BROADCAST_TOKENS, 0):
        rows = token_counts.count_tokens(docs, unigram, broadcast_tokens=most).orderBy("doc_id").collect()
        for r, t in zip(rows, TEXTS, strict=True):
            w = pieces.pre_tokens(pa.array([t], pa.string()))
            assert r["n_tokens"] == sum(best_by_force(w.string(i).replace(" ", "▁"), unigram)[1] for i in range(len(w.starts)) if i < 4000)
            assert r["n_pre_tokens"] == len(w.starts)


# urls ------------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    rules = [Rule("org", "/", True), Rule("bad.net", "/", False), Rule("a.bad.net", "/ok", True), Rule("bad.net", "/x", False), Rule("bad.net", "/x", True)]
    pages = [
        (1, "http://BAD.net/p?q#f", None), (2, "https://a.bad.net/ok/1", ""), (3, "https://notbad.net/p", "<p>"),
        (4, "http://alias.com/1/", '<link href="http://bad.net/p?q" rel="canonical">'), (5, "http://www.alias.com/1#top", None), (6, "http://second.com", '<meta http-equiv="refresh" content="0; url=http://alias.com/1">'),
        (7, "http://mixed.com/", '<link rel=canonical href=//second.com/>'), (8, "http://both.com/a", '<link rel="canonical" href="http://x.org/y">'), (9, "http://x.org/y", '<LINK REL="canonical" HREF="http://bad.net/z">'), (13, "http://bad.net/z", None),
        (10, None, "<link>"), (11, "no scheme", '<link rel="canonical" href="/rel">'), (12, "http://bad.net/x1", None), (12, "http://bad.net/x1", None), (14, "http://y.org", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = judge_urls(df, rules).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("bad.net", "/p", "bad.net/", "block") and got[2] == ("a.bad.net", "/ok/1", "a.bad.net/ok", "allow")
    assert got[3][2:] == (None, "allow")
    assert [got[i][2:] for i in (4, 5, 6, 7)] == [(None, "block")] * 4
    assert got[8][2:] == (None, "allow") and got[13][2:] == ("bad.net/", "block")  # an allow in the component wins for pages without a rule
    assert got[10] == got[11] == ("", "", None, "allow") and got[12][2:] == ("bad.net/x", "allow") and got[14] == ("y.org", "", None, "allow")
    moved = spark.createDataFrame([("http://notbad.net/p", "http://bad.net/p?q")], "src string, dst string")
    assert judge_urls(df, rules, redirects=moved).where("page_id = 3").first()["verdict"] == "block"
    assert judge_urls(df.where("false"), rules).count() == 0


# vectors ---------------------------------------------------------------------


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "TILE", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (30, 16))
    x = [*(centres[i % 30] + rng.normal(0, 0.08, 16) for i in range(90)), *(centres[0] * 3 + rng.normal(0, 0.2, 16) for _ in range(60)), *[centres[1]] * 5, *(rng.normal(0, 1, 16) for _ in range(60))]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0, 0.0]), (1006, [2.0, 0.0]), (1007, [float("inf")] * 16), (None, [1.0] * 16)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = np.array([got[i][0] for i in range(len(u))])
    assert (found <= linked.sum(1)).all() and found.sum() >= 0.95 * linked.sum() > 1000
    assert len({got[i][1] for i in range(90, 150)}) == 1 and got[90][1] == 0
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False) and got[None] == (0, None, False)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def tile_components(ids, x, side):
    """Components by brute force: the least id of each row's component, and the links of each row."""
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    if side.any():
        linked &= side[:, None] != side[None, :]
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return label, linked.sum(1)
        label = new


@pytest.mark.parametrize("case", ["chain", "star", "two sides"])
def test_tile_keeps_all_connections(case):
    turn = lambda degrees: np.array([[math.cos(math.radians(d)), math.sin(math.radians(d)), 0.0] for d in degrees])
    if case == "star":  # the hub has the largest id, its partners are not linked with each other
        ids, x = np.array([1, 2, 10]), turn([0, 40, 20])
    else:
        ids, x = np.random.default_rng(5).permutation(700) + 3, turn(np.arange(700) * 20 % 300)
        ids, x = (ids, x) if case == "two sides" else (ids[:15], x[:15])
    side = np.arange(len(ids)) % 2 if case == "two sides" else np.zeros(len(ids), np.int64)
    count, least = vector_neighbours.link_tile(ids, np.ones(len(ids), np.int64), x, np.zeros((len(ids), 1), np.int32), side, 0, 0.9, 2)
    label, links = tile_components(ids, x, side)
    assert (ids[least] == label).all() and (count == links).all()


def test_components_of_hubs_and_chains(spark):
    """Groups far apart; in each, a hub of the largest id or a chain of ids in random order."""
    rng = np.random.default_rng(8)
    turn = lambda group, d: [math.cos(math.radians(d)) if k == 2 * group else math.sin(math.radians(d)) if k == 2 * group + 1 else 0.0 for k in range(16)]
    rows, want = [], {}
    for group in range(8):
        ids = [100 * group + 1, 100 * group + 2, 100 * group + 50] if group % 2 else [int(v) for v in rng.permutation(6) + 100 * group]
        degrees = [0, 40, 20] if group % 2 else range(0, 120, 20)
        rows += [(i, turn(group, d)) for i, d in zip(ids, degrees, strict=True)]
        want |= {i: min(ids) for i in ids}
    got = {r["vec_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shared=1, prefix=1, pivots=1).collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}


# pipeline --------------------------------------------------------------------


def test_near_copy_stage_links_from_four_fifths_on(spark):
    """Similarities of 0.83 and 0.77 over five words; at 4 words and 85 percent both pairs would stay."""
    import corpus_pipeline

    words = lambda k, n: " ".join(f"v{k}x{i}" for i in range(n))
    rows = [(1, words(1, 200)), (2, words(1, 200) + " " + words(2, 40)), (3, words(3, 200)), (4, words(3, 200) + " " + words(4, 60))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "sentencepiece"]
    unique = lambda k, n: " ".join(f"u{k}x{i}" for i in range(n))
    passage = " ".join(f"p{i}" for i in range(40))
    toxic = [(100 + i, f"worthless w{i} pathetic hill{i} trash v{i}", "en") for i in range(40)]
    rows = [
        (1, unique(1, 80), "en"), (2, unique(1, 80) + " more", "en"), (3, unique(3, 30) + " " + passage, None), (4, passage + " " + unique(4, 30), "en"),
        *[(300 + i, f"plain p{i}q on hill{i} far v{i}z", "en") for i in range(120)],
        (5, unique(5, 20) + " bench one two three four five six seven eight nine " + unique(6, 5), "fr"), (6, None, None), (7, "", "en"), (8, "fine", "en"), *toxic,
    ]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("own")).withColumn("n_hit", F.lit(7))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, *_ in rows] + [(900, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Bench one two three four five six seven eight nine.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(k for k in got if k < 100) == [1, 3, 4, 6, 7, 8] and len(got) == 126
    assert got[3]["text"] == unique(3, 30) and got[3]["n_chars"] == len(got[3]["text"]) and got[4]["text"] == unique(4, 30)
    assert got[6]["text"] is None and got[7]["text"] == "" and got[1]["text"] == unique(1, 80)
    assert all(r["exact"] and r["score"] == "own" and r["n_hit"] == 7 for r in got.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, df.where("doc_id IN (1, 6)").unionByName(df.where("doc_id = 1")), str(tmp_path)).count() == 2


def test_all_operators_are_registered():
    from residua.llm.queries import QUERIES, SQL

    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert url_filter.Rule("a", "/", True).allow
