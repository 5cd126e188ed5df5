from __future__ import annotations

import random
import re

import pytest
import xxhash

from echotide.llm import simhash


def fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + shingle]).encode(), seed=42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, radius=2):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in held if i is not None), default=None) for r, held in ids.items()}
    return sorted(((i, f"{f:016x}", least[root(k)]) for k, (i, f) in enumerate(rows)), key=str)


@pytest.mark.parametrize("shard_size", [4096, 2])
def test_matches_brute_force(docs, texts, shard_size):
    got = simhash.near_duplicates(docs, shard_size=shard_size).collect()
    expected = brute([(i, fingerprint(t)) for i, t in texts])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected


@pytest.mark.parametrize("shard_size", [4096, 3])
def test_links_of_planted_fingerprints(spark, shard_size):
    rng = random.Random(2)
    found = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(6):  # chains of steps of one to three bits
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            found.add(x)
    rows = [(simhash._signed(x),) for x in sorted(found)]
    edges = simhash.links(spark.createDataFrame(rows, "fingerprint bigint"), 2, shard_size)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    values = sorted(found)
    by = {i: c for i, _, c in brute(list(enumerate(values)))}
    group = lambda key: sorted(sorted(k for k in values if key(k) == c) for c in {key(k) for k in values})
    mine = lambda x: roots.get(simhash._signed(x), simhash._signed(x))
    assert group(mine) == group(lambda x: by[values.index(x)])


def test_tree_search():
    rng = random.Random(4)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_first(docs, texts):
    got = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    component = {}
    for (i, t), (_, _, c) in zip(texts, sorted_components(texts), strict=True):
        component[i, t] = c
    want = {(i, t) for i, t in texts if component[i, t] is None or component[i, t] == i}
    assert sorted(got, key=str) == sorted(want, key=str)


def sorted_components(texts):
    """The component of each row, in the rows' order."""
    by = {}
    for i, f, c in brute([(i, fingerprint(t)) for i, t in texts]):
        by[i, f] = c
    return [(i, t, by[i, f"{fingerprint(t):016x}"]) for i, t in texts]


def test_crowded_shards_are_split(spark):
    """Ten thousand fingerprints that share 32 bits: no shard holds many, and rows grow by a few times only."""
    rng = random.Random(8)
    top = rng.getrandbits(32) << 32
    values = sorted({top | rng.getrandbits(32) for _ in range(10_000)} | {top | 1, top | 7, top | 31, top | 0x80000001})
    rows = spark.createDataFrame([(simhash._signed(x),) for x in values], "fingerprint bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(rows, 2, 64)).collect()}
    parent = {x: x for x in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = set(values)
    flips = [1 << a for a in range(32)] + [1 << a | 1 << b for a in range(32) for b in range(a)]
    for x in values:
        for f in flips:
            if x ^ f in known:
                parent[root(x)] = root(x ^ f)
    groups = {}
    for x in values:
        groups.setdefault(root(x), []).append(x)
    mine = {}
    for x in values:
        mine.setdefault(roots.get(simhash._signed(x), simhash._signed(x)), []).append(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
