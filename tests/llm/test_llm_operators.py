import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, common, contamination, importance, langid, passages, ppm, ring, simhash, winnow
from tidemark.llm.words import hashed_words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, lang="en"):
    rng = np.random.default_rng(seed)
    parts = {"en": ["the", "ing", "er", "th", "an", "on", "sh"], "fr": ["é", "eau", "ou", "ai", "è", "ç", "tion"], "de": ["sch", "ü", "ein", "ung", "ß", "ver", "keit"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Rows (id, text, lang), with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("id", "fp", "bucket", "key", "block", "part", "words", "held_out", "position")})


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empties, ties, repeated rows, copies, a shared passage and a long text."""
    rows = [(i, prose(i, 30 + 9 * i, "en fr de".split()[i % 3]), "en fr de".split()[i % 3]) for i in range(24)]
    shared = prose(999, 60)
    rows += [(30, prose(30, 40) + " " + shared + " " + prose(31, 40), "en"), (31, shared + "\n" + prose(32, 30), "en"), (32, prose(33, 80) + " " + shared, None)]
    rows += [(40, rows[5][1], "de"), (41, rows[5][1] + " end", "de"), (42, None, None), (43, "", "en"), (44, " \n\t", "en"), (45, "123 456 !!", "en"), (46, "a", "en")]
    rows += [(47, prose(47, 6000), "en"), (46, "a", "en"), (None, prose(48, 50), "en"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(0, "a", "en")]).where("false")


def simhash_by_hand(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_all_pairs(docs, corpus, empty):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, tree_size=4).collect()]
    fps = [simhash_by_hand(t) for _, t, _ in corpus]
    up = list(range(len(fps)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            up[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(corpus):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _, _) in enumerate(corpus)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_crowded_shard_lose_nothing(spark):
    """Fingerprints around one centre: every shard is hot and is split into many trees."""
    rng = np.random.default_rng(1)
    fps = list({int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(150)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    links = [(r["u"], r["v"]) for r in simhash.links(nodes, tree_size=16).collect()]
    assert all((fps[u] ^ fps[v]).bit_count() <= 64 for u, v in links)
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    up = list(range(len(fps)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    assert [found.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_a_hot_shard_is_dealt_in_proportion(spark):
    """50,000 fingerprints that agree on two whole blocks make few rows, whatever the number of trees they would fill."""
    rng = np.random.default_rng(3)
    fixed = (1 << 25) - 1
    fps = np.unique(rng.integers(0, 1 << 63, 50_000, np.int64) & ~fixed | 12345)
    near = [int(fps[k]) ^ (1 << 40) ^ (1 << 50) ^ (1 << 60) for k in range(0, 50_000, 5000)]
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate([*fps.tolist(), *near])], "fp long, rep long").repartition(4)
    assert simhash.dealt_trees(nodes, tree_size=256).count() <= 20 * len(fps)  # a row for each choice, of which there are 10, and 10 more in the hot shard
    links = {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(nodes, tree_size=256).collect()}
    assert {(k, len(fps) + i) for i, k in enumerate(range(0, 50_000, 5000))} <= links


@pytest.mark.parametrize("tree_size", [4096, 7])
def test_near_duplicate_stage_equals_brute_force_jaccard(spark, tree_size):
    rng = np.random.default_rng(4)
    rows = [(1000, "", "en"), (1001, None, "en"), (1002, "two words", "en"), (1003, "Two  WORDS", "en"), (1004, "two other", "en"), (None, "two words", "en")]
    for k in range(40):
        words = prose(k, 220).split()
        rows.append((10 * k, " ".join(words), "en"))
        for c in range(1, 1 + k % 4):
            copy = list(words)
            for at in rng.choice(220, rng.integers(1, 9), replace=False):
                copy[at] = f"changed{k}x{c}x{at}"
            rows.append((10 * k + c, " ".join(copy), "en"))
    grams = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    known = [(i, grams(t)) for i, t, _ in rows if i is not None]
    up = {i: i for i, _ in known}

    def root(i):
        return i if up[i] == i else root(up[i])

    near = 0
    for (i, a), (j, b) in combinations(known, 2):
        same = len(a & b) / len(a | b) if a | b else 1
        near += 0.8 <= same < 0.95
        if same >= 0.8 and root(i) != root(j):
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert near > 20
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, tree_size=tree_size).collect()}
    assert got == {i: root(i) for i in up} | {None: 1002}
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i in up if root(i) == i) and None in kept


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "u long, v long")
    found = {r["node"]: r["component"] for r in common.components(path).collect()}
    assert found == dict.fromkeys(range(201), 0) | {500: 500, 501: 500}


def test_ring_places_each_row_at_its_first_shard_with_room(docs, corpus, empty):
    got = ring.shard(docs, n_shards=5).collect()
    assert len(got) == len(corpus)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    by_id = {i: t for i, t, _ in corpus if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = (by_id[r["doc_id"]] or "").encode()
            assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
    assert ring.shard(empty).count() == 0
    loose = ring.shard(docs, n_shards=5, load_factor=5.0).collect()
    assert all(r["shard"] == r["home_shard"] for r in loose)


@pytest.mark.parametrize(("n_shards", "load"), [(5, 1.0), (5, 1.2), (3, 1.05)])
def test_ring_placement_equals_a_walk_row_by_row(spark, corpus, n_shards, load):
    """Each round, every row that waits asks the first shard clockwise that was not full before it; a shard keeps the first of their turns."""
    rows = corpus + [(100 + i, f"text {i % 7}", "en") for i in range(150)]
    nodes = sorted((spark_hash("vnode", (s, 4), (v, 4)), s) for s in range(n_shards) for v in range(64))
    nodes = sorted((h % ring.POSITIONS if h < 1 << 63 else (h - (1 << 64)) % ring.POSITIONS, s) for h, s in nodes)
    signed = lambda h: h - ((h >> 63) << 64)

    def walk(i):
        at = signed(spark_hash(None if i is None else (i, 8))) % ring.POSITIONS
        return list(dict.fromkeys(s for _, s in [x for x in nodes if x[0] >= at] + [x for x in nodes if x[0] < at]))

    share, extra = divmod(len(rows), n_shards)
    room = [share + (s < extra) + math.ceil(len(rows) * (load - 1) / n_shards) for s in range(n_shards)]
    waiting = []
    for i, t, _ in rows:
        turn = signed(spark_hash("turn", None if i is None else (i, 8)))
        waiting.append((turn % ring.TURNS, turn, -1 if i is None else i, zlib.crc32((t or "").encode()), i))
    waiting.sort()
    homes, placed = Counter((r[4], r[3], walk(r[4])[0]) for r in waiting), Counter()
    while waiting:
        had, rest = list(room), []
        for r in waiting:
            s = next(s for s in walk(r[4]) if had[s])
            if room[s]:
                room[s] -= 1
                placed[r[4], r[3], s] += 1
            else:
                rest.append(r)
        waiting = rest
    got = ring.shard(frame(spark, rows).repartition(4), n_shards=n_shards, load_factor=load).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["home_shard"]) for r in got) == homes
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == placed


def test_ring_moves_rows_only_into_a_new_shard(spark):
    rows = frame(spark, [(i, "t", "en") for i in range(400)])
    a, b = ({r["doc_id"]: r["home_shard"] for r in ring.shard(rows, n_shards=n, load_factor=9.0).collect()} for n in (4, 5))
    assert 0 < sum(a[i] != b[i] for i in a) < 200 and all(a[i] == b[i] or b[i] == 4 for i in a)


def passages_by_hand(rows, n=50):
    """(id, start, end, n_words, repeated) of rows (id, text): all windows of n words, compared as they are."""
    words = [(i, [m.span() + (m.group(),) for m in re.finditer(rb"[^ \t\n\x0b\f\r]+", t.encode())]) for i, t in dict.fromkeys(rows) if i is not None and t]
    ids = defaultdict(set)
    for i, w in words:
        for k in range(len(w) - n + 1):
            ids[tuple(x[2] for x in w[k : k + n])].add(i)
    out = []
    for i, w in words:
        at = [(k, ids[tuple(x[2] for x in w[k : k + n])]) for k in range(len(w) - n + 1)]
        spans = []
        for wanted in (lambda x: len(x) > 1, lambda x: min(x) < i):  # noqa: B023
            merged = []
            for k in (k for k, x in at if wanted(x)):
                if merged and k - merged[-1][1] < n:
                    merged[-1][1] = k
                else:
                    merged.append([k, k])
            spans.append([(w[a][0], w[z + n - 1][1], z - a + n) for a, z in merged])
        out += [(i, a, z, size, tuple(r[:2] for r in spans[1] if a <= r[0] and r[1] <= z)) for a, z, size in spans[0]]
    return sorted(out)


def test_shared_passages_equal_all_windows(spark, docs, corpus, empty):
    stretch = prose(801, 120).split()
    more = [(60, "ab " * 90, "en"), (61, "x " + "ab " * 70, "en"), (62, "a b c " * 40, "en"), (63, "b c a " * 30, "en"), (64, " ".join(stretch[:70]), "en"), (65, " ".join(stretch[50:]), "en")]
    more += [(66, " ".join(stretch), "en"), (67, prose(802, 90), "en"), (67, " ".join(stretch[20:90]), "en"), (68, prose(802, 90), "en"), (None, " ".join(stretch), "en"), (69, " ".join(stretch[:49]), "en")]
    # words shared with two documents, but no 50 of them with one
    more += [(70, prose(803, 40) + " " + prose(804, 40), "en"), (71, prose(805, 20) + " " + prose(803, 40), "en"), (72, prose(804, 40) + " " + prose(806, 20), "en")]
    rows = corpus + more
    df = frame(spark, rows).repartition(3)
    found = passages.shared_passages(df)
    got = sorted((r["doc_id"], r["start"], r["end"], r["n_words"], tuple((x["start"], x["end"]) for x in r["repeated"])) for r in found.collect())
    assert got == passages_by_hand([(i, t) for i, t, _ in rows])
    assert {60, 61, 62, 63, 64, 65, 66, 67, 68} <= {r[0] for r in got} and not {69, 70, 71, 72} & {r[0] for r in got}
    shared = prose(999, 60)
    cut = {(r["doc_id"], r["n_chars"]): r["text"] for r in passages.without(df, found).collect() if r["doc_id"] is not None}
    left = {i: text for (i, _), text in cut.items() if i != 67}
    by_id = {i: t for i, t, _ in rows if i is not None}
    assert left[30] == by_id[30] and shared not in left[31] and shared not in left[32]
    assert left[31].split() == prose(32, 30).split() and left[32].split() == prose(33, 80).split()
    assert sorted(text.split() for (i, _), text in cut.items() if i == 67) == [[], prose(802, 90).split()]
    repeated = {r[0] for r in got if r[4]}
    assert all(left[i] == t for i, t in by_id.items() if i not in repeated and i != 67)
    assert passages.without(docs, passages.shared_passages(docs)).columns == docs.columns
    assert passages.shared_passages(empty).count() == 0


def test_chunks_come_into_step_after_an_insertion():
    text = prose(7, 800).encode()
    a, b = passages.Chunked([text]), passages.Chunked([b"something new " + text])
    assert len(set(a.digests) & set(b.digests)) >= len(a.digests) - 2


def test_planted_passages_after_random_prefixes(spark):
    """Cuts that one document alone has in a passage's head lose no words of it."""
    rng = np.random.default_rng(11)
    word = lambda lo: "".join(map(chr, rng.integers(97, 123, rng.integers(lo, 6))))
    row = lambda n, lo: " ".join(word(lo) for _ in range(n))
    rows, kinds = [], defaultdict(list)
    for k in range(240):
        lo, n = (5, 1)[k % 2], (51, 51, 53, 60)[k // 2 % 4]
        passage = row(n, lo)
        kinds[lo].append((2 * k, n))
        rows += [(2 * k + j, " ".join([row(rng.integers(5, 80), lo), passage, row(rng.integers(5, 80), lo)]), "en") for j in (0, 1)]
    found = {r["doc_id"]: r["n_words"] for r in passages.shared_passages(frame(spark, rows)).collect()}
    assert all(found.get(i, 0) == found.get(i + 1, 0) in (n, n + 1) for lo in kinds for i, n in kinds[lo])


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (3, 1, None, "x"), (3, 1, None, "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x"))
    got = {r["id"]: r for r in chat.preference_pairs(*chat.paired_by_answer(df)).collect()}
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert (r["n_common"], r["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert r["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n" and r["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_mask"]] == ["yes<|end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_mask"]] == ["no<|end|>"]
    assert got[2]["rejected"] is None and got[2]["chosen"] == "<|user|>\nalone<|end|>\n"
    assert got[3]["chosen"] == "<|>\nx<|end|>\n".replace("<|>", "<||>") * 2
    assert chat.preference_pairs(*chat.paired_by_answer(df.where("false"))).count() == 0


def test_winnowing(spark, docs, corpus, empty):
    got = winnow.edited(docs, ranges=5).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        h = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    assert winnow.edited(empty).count() == 0

    def by_hand(text):
        """Chosen (hash, position) of runs of words, from the definition."""
        words = [spark_hash(x) for x in re.findall(r"[^ \t\n\x0b\f\r]+", text)]
        run = lambda h: h[0] if len(h) == 1 else spark_hash(*((x - ((x >> 63) << 64), 8) for x in (run(h[: len(h) // 2]), run(h[len(h) // 2 :]))))
        if len(words) < winnow.K:
            runs = [spark_hash(*((x - ((x >> 63) << 64), 8) for x in words)) >> 32] if words else []
        else:
            runs = [run(words[i : i + winnow.K]) >> 32 for i in range(len(words) - winnow.K + 1)]
        windows = [list(enumerate(runs))[i : i + winnow.WINDOW] for i in range(max(1, len(runs) - winnow.WINDOW + 1))] if runs else []
        return list(dict.fromkeys((h, i) for i, h in (min(x, key=lambda v: (v[1], -v[0])) for x in windows)))

    def alike(a, b):
        a, b = ({h for h, _ in by_hand(x)} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    near = []
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        near.append((repr(i), len(t), round(alike(t, t[: len(t) - half] + nxt[:half]), 9), round(alike(t, nxt), 9)))
    assert sorted((repr(r["doc_id"]), r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(near)
    prints = {(repr(r["doc_id"]), len(r["hashes"])): list(zip(r["hashes"], r["positions"], strict=True)) for r in winnow.fingerprints(docs).collect()}
    assert all(prints[repr(i), len(by_hand(t or ""))] == by_hand(t or "") for i, t, _ in corpus)


def test_winnowing_picks_the_rightmost_least_hash_of_each_window(spark):
    texts = ["", "a", "a b c", "a a a a a a a a a a a a a a", prose(3, 90)]
    rows = winnow.fingerprints(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    runs = frame(spark, [(0, texts[4], "en")]).select(winnow.chosen(F.col("text"), winnow.K, 1).alias("v")).first()["v"]
    hashes = [v >> 31 for v in runs]
    want = []
    for i in range(len(hashes) - winnow.WINDOW + 1):
        window = hashes[i : i + winnow.WINDOW]
        at = i + max(k for k, h in enumerate(window) if h == min(window))
        if not want or want[-1][1] != at:
            want.append((hashes[at], at))
    assert list(zip(rows[4]["hashes"], rows[4]["positions"], strict=True)) == want
    assert [len(r["hashes"]) for r in rows[:3]] == [0, 1, 1]


def test_language(docs, corpus, empty):
    many = [(i, prose(i, 40, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    df = frame(docs.sparkSession, many + [(900, None, "en"), (901, "12 !", "en"), (None, prose(5, 30), "en"), (902, prose(9, 30, "de"), None)])
    got = {r["doc_id"]: r for r in langid.languages(df, steps=80).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    held = [(i, lang) for i, _, lang in many if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.languages(empty).count() == 0
    untaught = langid.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


def test_language_gradients_equal_differences():
    rng = np.random.default_rng(2)
    w = {"X": rng.standard_normal((2, 256, 16)), "U": rng.standard_normal((2, 8, 16)), "V": rng.standard_normal((16, 3)), "d": np.zeros(3)}
    w = {k: (v * 0.4).astype(np.float32) for k, v in w.items()}
    data, y = rng.integers(97, 110, (12, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    data[9:, 2] = 0

    def loss(x):
        p = langid.Network(["a", "b", "c"], **x).probabilities(data)
        real = data != 0
        return -(np.log(p[:, np.arange(5), y]) * real).sum() / real.sum()

    g = langid.gradients(w, data, y)
    for name, at in (("X", (0, 100, 3)), ("X", (1, 101, 12)), ("U", (0, 2, 5)), ("U", (1, 3, 11)), ("V", (3, 1)), ("d", (2,))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=2e-4)


def test_contamination_equals_all_pairs(spark, docs, corpus, empty):
    texts = [(i, t) for i, t, _ in corpus]
    items = [(1, " ".join(texts[20][1].split()[40:70])), (2, " ".join(texts[34 - 7][1].split()[5:18])), (3, prose(5000, 30)), (4, None), (5, ""), (6, "a"), (7, " ".join(dict(texts)[47].split()[2000:2200]))]
    words = texts[10][1].split()[10:60]
    words[25] = "changed"
    items += [(8, " ".join(words)), (9, " ".join(texts[3][1].upper().split()[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, n):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for item, t in items:
        n = min(5, len((t or "").split()))
        own = grams(t, n) if n else set()
        for doc, d in texts:
            hits = len(own & grams(d, n)) if own else 0
            if own and hits >= 0.8 * len(own):
                want.add((doc, item, len(own), hits))
    bench = bench.withColumns({c: F.lit("x") for c in ("id", "doc_id", "found")})
    for block in (1 << 20, 900):
        got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in contamination.contaminated(docs, bench, block_bytes=block).collect()}
        assert got == want
        left = contamination.clean(docs, bench, block_bytes=block)
        assert left.columns == docs.columns
        dirty = {d for d, *_ in want if d is not None}
        assert Counter(r["doc_id"] for r in left.select("doc_id").collect()) == Counter(i for i, _, _ in corpus if i not in dirty)
    assert contamination.contaminated(empty, bench).count() == 0
    assert contamination.contaminated(docs, bench.where("false")).count() == 0


def test_importance_resampling(spark, empty):
    good = [(i, prose(i, 80), "en") for i in range(150)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 80).split()), "en") for i in range(50)]
    df = frame(spark, good + junk + [(2000, None, "en"), (2001, "", None)])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i in [*range(60), *range(1000, 1020)]] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = [r["doc_id"] for r in importance.resampled(df, labels, share=0.7).collect()]
    assert len(got) == len(set(got)) == round(202 * 0.7)
    assert sum(i >= 1000 and i < 2000 for i in got) <= 2
    assert importance.resampled(empty, labels).count() == 0
    keys = spark.createDataFrame([(i, float(i // 3)) for i in range(300)], "id long, key double")
    top = importance.largest(keys, "key", 100, ["id"], ranges=8, together=10)
    assert sorted(r["id"] for r in top.collect()) == [198, *range(201, 300)]


def spark_hash(*values, seed=42):
    """Of integers, as (value, bytes), and strings, one after the other; nulls leave the hash as it is."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def test_importance_weights_and_draw_equal_brute_force(spark, corpus):
    rows = corpus + [(300 + i, prose(300 + i, 60), "en") for i in range(40)] + [(46, "a", "en")] * 30 + [(None, None, None)] * 30 + [(None, prose(48, 50), "en")] * 5
    labelled = [(i, int(i % 2), int(i % 7 == 0)) for i in range(0, 320, 3)] + [(46, 1, None), (None, 1, 0)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").withColumn("id", F.lit("x"))
    target = {i for i, q, t in labelled if q == 1 and not t and i is not None}

    def grams(text):
        w = (text or "").encode().lower().split()
        hashes = [int(h) for h in hashed_words([b" ".join(w)])[0]]
        single = [h % importance.BUCKETS for h in hashes]
        flat, counts = hashed_words([b" ".join(w)])
        return single + [int(h) % importance.BUCKETS for h in importance.shingle_hashes(flat, counts, 2)[0]]

    raw, good = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    n, m = sum(raw.values()) + importance.BUCKETS, sum(good.values()) + importance.BUCKETS
    want = []
    for i, t, _ in rows:
        g = grams(t)
        weight = sum(math.log((good[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in g) / max(1, len(g)) * importance.NOMINAL_LENGTH
        content = spark_hash(t)
        content -= (content >> 63) << 64
        u = (spark_hash((content if i is None else i, 8), "gumbel") >> 11) / 2**53
        want.append((i, weight, weight - math.log(-math.log(max(u, 1e-16)))))
    df = frame(spark, rows).repartition(5)
    for share in (0.1, 0.45, 0.8, 1.0):
        k = round(len(rows) * share)
        got = importance.resampled(df, labels, share=share).collect()
        assert len(got) == k
        best = sorted(want, key=lambda r: (-r[2], -1 if r[0] is None else r[0]))[:k]
        for a, b in zip(sorted(got, key=lambda r: (-r["key"], repr(r["doc_id"]))), sorted(best, key=lambda r: (-r[2], repr(r[0]))), strict=True):
            assert a["doc_id"] == b[0] and (a["log_weight"], a["key"]) == pytest.approx(b[1:], abs=1e-6)


def test_largest_takes_as_many_of_equal_rows_as_there_is_room_for(spark):
    rows = [(1, 5.0, 7)] * 4500 + [(2, 5.0, 7)] * 100 + [(None, 5.0, 9)] * 50 + [(None, 5.0, 8)] * 60 + [(7, 6.0, 1), (8, 4.0, 1)]
    df = spark.createDataFrame(rows, "id long, key double, content long").repartition(4)
    order = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0], r[2]))
    for k in (0, 1, 40, 61, 80, 111, 2500, 4650, 4711, 4712, 9000):
        got = [tuple(r) for r in importance.largest(df, "key", k, ["id", "content"], ranges=8, together=20).collect()]
        assert Counter(got) == Counter(order[:k])


def test_ppm_scores(spark, docs, corpus, empty):
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    got = sorted((tuple(r) for r in ppm.scored(docs, out, block_bytes=5000, part_bytes=9000, least=2).collect()), key=repr)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in corpus]
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in corpus]
    c = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    trie = defaultdict(Counter)
    data = [(bytes((ppm.START,)) * ppm.ORDER + (t or "").encode() + bytes((ppm.END,))) for _, t, _ in corpus]
    for h, d in zip(held, data, strict=True):
        for at in range(ppm.ORDER, len(d)) if not h else ():
            for k in range(ppm.ORDER + 1):
                trie[d[at - k : at]][d[at]] += 1

    def log_p(context, symbol):
        p, gone = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = trie[context[len(context) - k :]]
            left = {s: x for s, x in seen.items() if s not in gone}
            if left:
                total = sum(left.values())
                if symbol in left:
                    return math.log10(p * (2 * left[symbol] - 1) / (2 * total))
                p *= len(left) / (2 * total)
                gone |= set(left)
        return math.log10(p / (ppm.SYMBOLS - len(gone)))

    want = []
    for (i, _, _), h, ws, d in zip(corpus, held, tokens, data, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = sum(log_p(d[at - ppm.ORDER : at], d[at]) for at in range(ppm.ORDER, len(d)))
        want.append((i, h, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    want.sort(key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-5)
    assert ppm.scored(empty, out).count() == 0


def test_bpe_equals_the_public_library(docs, corpus, empty):
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.transducer.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    letters = [*"aenthsor", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "日本", "😀", "12", "'s", "%%%", "​", "한국", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        ids = c.encode(text).tolist()
        assert ids == other.encode_ordinary(text) and "".join(c.decode(ids)) == text
    got = sorted((tuple(r) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t, _ in corpus:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((r["text"] for r in back.collect())) == sorted((t or "") for _, t, _ in corpus)


def test_tokens_stand_together_as_the_merges_say():
    t = bpe.codec(PATH, public_tokenizers.PATTERN).transducer
    rng = np.random.default_rng(6)
    tokens = list(t.ranks)
    cut = [(x[:i], x[i:]) for x in (tokens[int(k)] for k in rng.integers(0, len(tokens), 3000)) for i in range(1, len(x))]
    longer = [(x + y[:1], y[1:]) for x, y in ((tokens[int(a)], tokens[int(b)]) for a, b in rng.integers(0, len(tokens), (3000, 2)))]
    pairs = [(a, b) for a, b in cut + longer + [(tokens[int(a)], tokens[int(b)]) for a, b in rng.integers(0, len(tokens), (2000, 2))] if a in t.ranks and b in t.ranks]
    found = [t.may_follow(t.ranks[a], t.ranks[b]) for a, b in pairs]
    assert found == [t.merged(a + b) == [a, b] for a, b in pairs] and 0.1 < np.mean(found) < 0.9


def test_transducer_begins_anew_when_its_tables_are_full(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 300)
    c = bpe.Codec(bpe.codec(PATH, public_tokenizers.PATTERN).transducer.ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.transducer.ranks, special_tokens={})
    for i in range(30):
        text = prose(i, 60, "en fr de".split()[i % 3])
        assert c.encode(text).tolist() == other.encode_ordinary(text)
    text = prose(77, 300) * 900  # longer than what is encoded at once
    assert len(text) > bpe.TOGETHER and c.encode(text).tolist() == other.encode_ordinary(text)


def test_streaming_decode_of_broken_ids():
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    ids = [c.transducer.ranks[bytes((b,))] for b in "é".encode()[:1] + b"a" + "日".encode()[:2]]
    assert "".join(c.decode(ids)) == "�a�"


def test_words_are_those_of_bytes_split():
    texts = [b"", b" A b\x0bA\xc3\x89 ", b"a", b"\n"]
    h, n = hashed_words(texts)
    assert n.tolist() == [len(t.split()) for t in texts] and h[0] == h[3] and len(set(h.tolist())) == 3


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, " ".join(prose(20, 210, "de").split()[40:70]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "encoding":
            assert now.columns == docs.columns
            now = common.written(now, name)
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        if name == "language":
            assert not {42, 43, 44, 45} & set(ids) and {0, 1, 2, 30, 31, 32, 47} <= set(ids)
        if name == "near_duplicates":
            assert 40 not in ids and 5 in ids and ids.count(46) <= 1
        if name == "decontamination":
            assert 20 not in ids
    assert {0, 1, 2, 3, 30, 31, 32, 47} <= set(ids)
    texts = {i: t for i, t in now.select("doc_id", "decoded_sha256").collect()}
    assert texts[47] == hashlib.sha256(prose(47, 6000).encode()).hexdigest()


def test_pipeline_equals_brute_force(spark, corpus, docs, tmp_path):
    """Text by text: the trained network is asked directly, all else is compared pair by pair."""
    item = " ".join(prose(20, 210, "de").split()[40:70])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fitted(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    rows = [(i, t) for i, t, _ in corpus if t and re.search(r"[^\W\d_]", t) and model.pooled([t.encode()]).max() >= corpus_pipeline.LEAST_SCORE]
    grams = lambda t: {" ".join(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    known = sorted({(i, t) for i, t in rows if i is not None})
    group = {i: i for i, _ in known}
    for (i, a), (j, b) in combinations([(i, grams(t)) for i, t in known], 2):
        if len(a & b) >= 0.8 * len(a | b):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = {k: new if v == old else v for k, v in group.items()}
    rows = [r for r in rows if r[0] is None] + [(i, t) for i, t in known if group[i] == i]
    spans = {i: r for i, _, _, _, r in passages_by_hand(rows) if r}
    left = []
    for i, t in rows:
        data, at, kept = t.encode(), 0, b""
        for a, z in spans.get(i, ()):
            kept, at = kept + data[at:a], z
        kept = (kept + data[at:]).decode()
        if i not in spans or kept.strip():
            left.append((i, kept, i in spans))
    words = item.split()
    asked = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    held = lambda t: sum(x in {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for x in asked)
    left = [x for x in left if held(x[1]) < 0.8 * len(asked)]
    got = {(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in got} == {i for i, _, _ in left} and len(got) == len(left)
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t, changed in left if not changed} <= got
    assert spans and 20 not in {i for i, _ in got} and 40 not in {i for i, _ in got}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bpe_tables_last_as_long_as_a_task_or_a_worker(docs):
    path, pattern = PATH, public_tokenizers.PATTERN
    c = bpe.codec(path, pattern)
    assert list(bpe.texts_of([], keep=True)) == [] and bpe.codec(path, pattern) is c
    assert list(bpe.texts_of([])) == [] and bpe.codec(path, pattern) is not c
    rows = lambda **how: sorted((tuple(r) for r in bpe.round_trip(docs, path, pattern, **how).collect()), key=repr)
    assert rows(keep=True) == rows(keep=True) == rows()
