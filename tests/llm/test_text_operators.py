from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loamstack.llm import components, decontaminate, simhash, substring_dedup

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string"


# --- decontamination ---------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    found |= own
                    hit[j : j + k] = [True] * k
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(corpus):
    text = dict(corpus)
    return [(1, text[3][:300]), (2, text[9]), (3, "X"), (4, None), (5, " - "), (10, text[14][5000:5400].replace(" ", ", ")), (7, "ÑANDÚ straße 12 qué"), (7, text[11])]


def test_decontamination_equals_brute_force(spark, corpus, items):
    docs, bench = spark.createDataFrame(corpus, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == brute_hits(corpus, items)


def test_decontamination_in_slices_and_empty(spark, corpus, items):
    docs, bench = spark.createDataFrame(corpus, DOCS).withColumnRenamed("doc_id", "n_words"), spark.createDataFrame(items, "item_id long, text string")
    p = decontaminate.PREFIX
    got = decontaminate.scan_benchmark(docs, bench, slice_bytes=200).collect()
    assert sorted((r["n_words"], r[p + "n_words"], r[p + "n_hit"], len(r[p + "items"])) for r in got) == [x[:4] for x in brute_hits(corpus, items)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(spark.createDataFrame(corpus, DOCS), none).collect()} == {0}
    assert decontaminate.report(spark.createDataFrame([], DOCS), bench).count() == 0


def test_test_sets_are_held_in_little_memory():
    import pickle

    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(20_000)])
    items = [(i, " ".join(rng.choice(words, 200)).encode()) for i in range(3000)]
    size = sum(len(t) for _, t in items)
    held = decontaminate.NgramSet(items, 13)
    assert len(pickle.dumps(held)) < 8 * size
    at = np.array([w.encode() for w in items[7][1].decode().split()])
    hit, found = held.scan([b"x", *at[10:40].tolist(), b"y"], {})
    assert hit.tolist() == [False] + [True] * 30 + [False] and found == {7}


def test_clean_text_loses_the_span_only(spark):
    bench = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(13)))], "item_id long, text string")
    text = "Before, this: " + " ".join(f"K{i}" for i in range(13)) + ". After!"
    got = decontaminate.scan_benchmark(spark.createDataFrame([(1, text), (2, "same. Text"), (3, None)], DOCS), bench, clean=True)
    assert sorted((r.doc_id, r["_dc_clean"]) for r in got.collect()) == [(1, "Before, this: . After!"), (2, "same. Text"), (3, None)]


# --- substring dedup ---------------------------------------------------------------------------------------------------


def brute_repeats(docs, width=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[j : j + width]) for w in split for j in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, corpus):
    assert sorted(map(tuple, substring_dedup.report(spark.createDataFrame(corpus, DOCS)).collect())) == brute_repeats(corpus)


def test_repeats_of_one_word_and_overlaps(spark):
    docs = [(1, "a " * 36), (2, "b " * 35), (3, ("c d " * 18)), (4, "a " * 34), (5, None)]
    assert sorted(map(tuple, substring_dedup.report(spark.createDataFrame(docs, DOCS)).collect())) == brute_repeats(docs)


@pytest.mark.parametrize("prefix", [1, 7, 20])
def test_other_prefixes_find_the_same(spark, corpus, prefix):
    docs = spark.createDataFrame(corpus, DOCS).withColumnRenamed("text", "key")
    got = substring_dedup.remove_repeats(docs, text="key", width=20, prefix=prefix).collect()
    assert sorted((r.doc_id, r["_ss_n_words"], r["_ss_n_removed"]) for r in got) == [x[:3] for x in brute_repeats(corpus, 20)]
    assert substring_dedup.report(spark.createDataFrame([], DOCS)).count() == 0


# --- simhash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, corpus):
    got = sorted(map(tuple, simhash.report(spark.createDataFrame(corpus, DOCS)).collect()))
    fps = [brute_fingerprint(t) for _, t in corpus]
    want = sorted(zip([d for d, _ in corpus], [f"{f:016x}" for f in fps], brute_components([d for d, _ in corpus], fps), strict=True))
    assert got == want
    assert simhash.report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("two_from", "residents"), [(0, 4096), (1 << 40, 4096), (0, 3), (1 << 40, 3)])
def test_links_of_planted_fingerprints(spark, two_from, residents):
    """Chains of fingerprints four bits apart, a dense group, and strangers; both sets of segments find all links."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for f in fps[:40]:
        for _ in range(3):
            for b in rng.choice(64, 4, replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 30, 2) for b in range(31, 60, 3)]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), two_from=two_from, most_residents=residents)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200) if i != 77] + [(5, 5), (3, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 if i <= 77 else 78 for i in range(201)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hubs(spark):
    edges = [(50, i) for i in range(100, 160)] + [(i, 50) for i in range(40)] + [(200, 201), (201, 202), (160, 50), (300, 160), (9, 10)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 200 if 200 <= i <= 202 else 0 for i in {x for e in edges for x in e}}


def test_drop_near_duplicates(spark, corpus):
    docs = spark.createDataFrame([(d, t, "x") for d, t in corpus], DOCS + ", fp string")
    left = simhash.drop_near_duplicates(docs)
    ids = sorted(r.doc_id for r in left.collect())
    assert left.columns == docs.columns
    assert 3 in ids and not {4, 6, 60} & set(ids) and 0 in ids and not {1, 2} & set(ids)
    assert {7, 8, 9, 10, 11, 12, 13, 14, 15, 16} <= set(ids)


def near_groups(docs, shingle=5, similarity=0.8):
    """The least id of each document's group, by all pairs of shingle sets."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else {None})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def near_copies():
    rng = np.random.default_rng(8)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)])
    weight = 1 / np.arange(1, 401)
    say = lambda n: rng.choice(words, n, p=weight / weight.sum()).tolist()
    texts = []
    for _ in range(12):
        base = say(int(rng.integers(60, 400)))
        texts.append(base)
        for _ in range(4):
            copy = base[:]
            for at in rng.choice(len(base), max(1, len(base) // 60), replace=False):
                copy[at] = "changed"
            texts.append(copy)
    texts += [say(int(n)) for n in rng.integers(1, 300, 40)]
    ids = rng.permutation(len(texts)).tolist()
    return [(int(i), " ".join(t)) for i, t in zip(ids, texts, strict=True)]


def test_near_copies_leave_one_of_each_group(spark):
    docs = near_copies()
    want = near_groups(docs)
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    gone = {d for d, _ in docs} - left
    due = {d for d, g in want.items() if g != d}
    assert gone <= due and len(gone) >= 0.95 * len(due) and len(due) >= 40


def test_links_are_verified_in_rounds_and_blocks(spark):
    docs = near_copies()
    slim = spark.createDataFrame(docs, "_sh_id long, _sh_text string")
    family = simhash._printed(slim, 5).selectExpr("key", "node", "0L AS root", "_sh_id AS least")
    sets = simhash._sets(slim, family, 5)
    links = simhash._verified(sets, 0.8, heads=1, block=7)
    node = {r.node: r.least for r in sets.collect()}
    root = {node[r.node]: node[r.root] for r in components.components(links).collect()}
    groups = {}
    for d in node.values():
        groups.setdefault(root.get(d, d), set()).add(d)
    want = {}
    for d, g in near_groups(docs).items():
        want.setdefault(g, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_blocks_added_cut_and_replaced_are_found(spark):
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)])
    say = lambda n: rng.choice(words, n).tolist()
    texts = []
    for _ in range(15):
        base = say(200)
        texts += [base, base[:170], say(200)]
        base = say(200)
        texts += [base, base + say(34)]
        base = say(200)
        texts += [base, base[:90] + say(14) + base[104:]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert left == {d for d, g in near_groups(docs).items() if g == d} and len(left) == len(docs) - 45


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = np.random.default_rng(5)
    say = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(100))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(None, a, "1"), (None, a, "2"), (1, b, "3"), (1, b, "4"), (2, c, "5"), (3, c, "6"), (3, d, "7"), (None, d, "8"), (3, e, "9"), (None, say(), "10"), (None, e + " more", "11")]
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS + ", kind string"))
    got = [tuple(r) for r in left.collect()]
    assert left.columns == ["doc_id", "text", "kind"] and len(got) == 6
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted([(0, a), (1, b), (2, c), (3, d), (3, e), (0, rows[9][1])])


def test_links_between_texts_tied_to_different_heads(spark):
    """A chain h1~x, x~y, y~h2 where only neighbours are similar, and h1 and h2 are the heads."""
    words = [f"w{i}" for i in range(204)]
    chain = [words[i : i + 150] for i in (0, 15, 30, 45)]
    slim = spark.createDataFrame([(i, " ".join(chain[k])) for i, k in enumerate((0, 3, 1, 2))], "_sh_id long, _sh_text string")
    sets = simhash._sets(slim, simhash._printed(slim, 5).selectExpr("key", "node", "0L AS root", "_sh_id AS least"), 5)
    found = components.components(simhash._verified(sets, 0.8, heads=2, block=2)).collect()
    assert len(found) == 4 and len({r.root for r in found}) == 1


def test_texts_with_near_fingerprints_leave_one_of_each_group(spark):
    """Pairs within four bits but below the similarity, fingerprints that texts share, and a text that only an empty one is near to."""
    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)])
    say = lambda n: rng.choice(words, n).tolist()
    texts = [" ".join(say(100)) for _ in range(10)]
    while len(texts) < 22:
        base = say(300)
        copy = base[:]
        for at in rng.choice(300, 18, replace=False):
            copy[at] = "changed"
        pair = [" ".join(base), " ".join(copy)]
        if (simhash.fingerprint(pair[0].encode()) ^ simhash.fingerprint(pair[1].encode())).bit_count() <= 4:
            texts += pair
    texts += ["error at line " * 60 + " ".join(say(8)) for _ in range(3)]
    texts.append(next(t for t in iter(lambda: " ".join(say(5)), None) if simhash.fingerprint(t.encode()).bit_count() <= 4))
    docs = list(enumerate(texts))
    assert all(d == g for d, g in near_groups(docs).items())
    want = {g for g in brute_components([d for d, _ in docs], [brute_fingerprint(t) for t in texts])}
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame([*docs, (-1, None), (-2, " ")], DOCS)).collect()}
    assert left == want | {-2} and len(want) == len(docs) - 8
