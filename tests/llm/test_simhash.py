import itertools
import random

import pytest
import xxhash

from plankit.llm import simhash
from plankit.llm.components import components


def brute_fingerprint(text, size=3):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, radius=2):
    """{fingerprint: root} of all pairs within some bits."""
    parent = {m: m for m in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(set(marks), 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    return {m: root(m) for m in marks}


@pytest.mark.parametrize("text", ["", None, "One", "Two words", "A b c", "a b c d É É " * 9, " x \x0b y\x1cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes((text or "").encode(), 3)) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == (1 << (radius + 1)) - 1
    rng = random.Random(5)
    every = itertools.combinations(range(64), 2) if radius == 2 else (rng.sample(range(64), radius) for _ in range(3000))
    for bits in every:
        differing = sum(1 << b for b in bits)
        assert any(not differing & m for m in masks)


@pytest.mark.parametrize("radius, crowd", [(0, 3), (1, 512), (1, 1), (2, 512), (2, 3), (4, 3)])
def test_links_reach_what_all_pairs_reach(spark, radius, crowd):
    """Chains and clusters of fingerprints; a small crowd sends all buckets the way of the crowded ones."""
    rng = random.Random(8)
    marks = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40 if radius < 4 else 8):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            marks.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1)))
    base = rng.getrandbits(64)
    marks |= {base ^ (1 << i) for i in range(30)}
    nodes = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(nodes, radius, crowd).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    stars = {r.u % (1 << 64): r.v % (1 << 64) for r in components(simhash.links(nodes, radius, crowd)).collect()}
    found, wanted = {}, {}
    for m, root in brute_components(marks, radius).items():
        wanted.setdefault(root, set()).add(m)
        found.setdefault(stars.get(m, m), set()).add(m)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + rng.choice("xyz") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [texts[3] + " tail", texts[4], texts[4].upper(), "", None, "  \n", "w" * 50_000, "many words " * 3000]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, texts[0]), (500, texts[4]), (500, texts[4])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    marks = [brute_fingerprint(t) for _, t in rows]
    roots, least = brute_components(marks), {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[roots[m]] = min(least.get(roots[m], i), i)
    wanted = sorted(((i, f"{m:016x}", least.get(roots[m])) for (i, _), m in zip(rows, marks)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == wanted


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_long_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(3, 3), (900, 901), (901, 900)], "u long, v long")
    found = {r.u: r.v for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_no_round_is_run_on_what_is_settled(spark, monkeypatch):
    from plankit.llm import components as module

    rounds, real = [], module._large_star
    monkeypatch.setattr(module, "_large_star", lambda edges: rounds.append(1) or real(edges))
    stars = spark.createDataFrame([(i, 0) for i in range(1, 40)] + [(0, 7), (90, 90)], "u long, v long")
    assert {r.u: r.v for r in components(stars).collect()} == {i: 0 for i in range(1, 40)}
    assert not rounds
    triangle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "u long, v long")
    assert {r.u: r.v for r in components(triangle).collect()} == {2: 1, 3: 1}
    assert len(rounds) == 1
