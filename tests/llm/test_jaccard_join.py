import random
import re
from itertools import combinations

import numpy as np
import pytest

from wordloom.llm.jaccard_join import TURNS, WINDOWS, _blocks, allocation, cells_of, largest_partner, least_apart, most_apart, one_of_each, signature_keys, similar_groups


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cls int, component string").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df).collect())


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        k = r.randrange(len(w))
        op = r.random()
        if op < 0.6:
            w[k] = f"e{r.randrange(10**6)}"
        elif op < 0.8 and len(w) > 1:
            del w[k]
        else:
            w.insert(k, f"i{r.randrange(10**6)}")
    return w


def test_pigeonhole_holds_for_sets():
    r = np.random.default_rng(3)
    for n in [*range(1, 40), 77, 139, 400, 1500]:
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            most = most_apart(n, n)
            cut = most // 2
            b = np.unique(np.concatenate([a[r.permutation(n)[: n - cut]], r.integers(0, 2**63, cut, dtype=np.uint64)]))
            (ka, _, fa), (kb, _, fb) = signature_keys(a), signature_keys(b)
            assert np.intersect1d(ka, kb).size or (fa[2] <= 0 and fb[2] <= 0)
    for w in range(20):
        h, units, pairs, slack = allocation(w)
        high = WINDOWS[w + 1] - 1
        assert h == most_apart(high, largest_partner(high)) and units == h + 1 + slack and 2 * pairs <= units


@pytest.mark.parametrize("seed", [1])
def test_small_and_large_families(spark, seed):
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 20, 40, 150, 400]))]
        for _ in range(r.randint(1, 5)):
            rows.append((n, " ".join(edited(r, base, r.choice([0, 0, 1, 1, 2, len(base) // 25])))))
            n += 1
    family = [f"f{k}" for k in range(120)]
    for _ in range(70):  # more than FEW near copies
        rows.append((n, " ".join(edited(r, family, r.randint(0, 6)))))
        n += 1
    for _ in range(60):  # unlike texts that share a passage, some of them nothing but that
        own = [f"o{r.randrange(10**7)}" for _ in range(r.choice([0, 1, 10, 30, 90, 200]))]
        rows.append((n, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
        n += 1
    assert got(spark, rows) == brute(rows)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "x " * 100_000), (7, "x " * 90_000), (8, "one two three four five"), (9, "one two three four five six")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_one_of_each_keeps_columns(spark):
    rows = [(3, "a b c d e f g h i j k l", "s"), (1, "a b c d e f g h i j k l", "t"), (2, None, "u"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_bitmaps_never_set_near_sets_apart():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40, 900):
        for _ in range(30):
            pool = np.unique(rng.integers(0, 1 << 48, 2 * n, dtype=np.uint64)) << np.uint64(16)
            a, b = (np.sort(rng.choice(pool, rng.integers(1, len(pool) + 1), replace=False)) for _ in range(2))
            assert least_apart(cells_of(a), cells_of(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("own", [4, 9, 18])
def test_borderline_pairs_that_share_a_passage(spark, own):
    """Short texts at the similarity limit, whose common passage hundreds of others have."""
    r = random.Random(own)
    passage = [f"p{k}" for k in range(2 * own)]
    rows = [(i, " ".join(passage + [f"u{i}_{k}" for k in range(3 * own)])) for i in range(200)]
    for i in range(200, 500, 2):
        a = passage + [f"a{i}_{k}" for k in range(3 * own)]
        n = len(a) - 4
        for cut in range(1, n):  # the last words differ: as many as the limit leaves
            if 100 * (n - cut) < 75 * (n + cut):
                break
        cut -= 1
        rows += [(i, " ".join(a)), (i + 1, " ".join(a[: len(a) - cut] + [f"b{i}_{k}" for k in range(cut)]))]
    r.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    """A chain of near copies holds together where its middle text has no id, or one that others have."""
    w = [f"w{k}" for k in range(60)]
    chain = [" ".join(w), " ".join(w[:-5] + [f"a{k}" for k in range(5)]), " ".join(w[5:-5] + [f"a{k}" for k in range(5)] + ["z"] * 2)]
    sets = [{tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for x in chain]
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    for middle in (None, 9):
        rows = [(4, chain[0]), (middle, chain[1]), (7, chain[2]), (9, "q r s t u v"), (9, "q r s t u v"), (None, "other words here"), (None, None)]
        n = [len({tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)}) for x in chain]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df).collect()), key=str)
        assert found == sorted([(4, n[0], 4), (middle, n[1], 4), (7, n[2], 4), (9, 2, 9), (9, 2, 9), (None, 1, None), (None, 0, None)], key=str)


def test_families_that_share_a_passage(spark):
    """Families of unlike texts with a common passage of 6 to 9 words, and in each one pair that just links."""
    r = random.Random(8)
    rows = []
    for f in range(60):
        size, passage = r.choice([8, 21, 23, 24, 30, 44]), [f"f{f}p{k}" for k in range(r.randint(6, 9))]
        for _ in range(40):
            rows.append((len(rows), " ".join(passage + [f"u{r.randrange(10**8)}" for _ in range(max(1, size + 4 - len(passage)))])))
        a = passage + [f"f{f}a{k}" for k in range(max(1, size + 4 - len(passage)))]
        n = len(a) - 4
        cut = max(c for c in range(n) if 100 * (n - c) >= 75 * (n + c))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(a[: len(a) - cut] + [f"f{f}b{k}" for k in range(cut)]))]
    assert got(spark, rows) == brute(rows)


def test_blocks_without_keys_in_a_turn(spark):
    """A block of one small set has keys in some of the turns only; all of them go out over the turns."""
    for x in range(1, 60):
        s = np.array([x * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
        sent = [sum(len(k) // 6 for b in _blocks([(x, s)], lambda s, t=t: signature_keys(s, t), 7) for k in b.column("keys").to_pylist()) for t in range(TURNS)]
        assert sum(sent) == len(np.unique(signature_keys(s)[0]))
    rows = [(k, f"w{k}") for k in range(9)] + [(9, "w1"), (10, "w1 w2")]
    assert got(spark, rows) == brute(rows)
