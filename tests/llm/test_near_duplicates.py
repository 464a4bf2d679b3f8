"""The near-duplicate stage against all pairs, compared by the exact similarity of their five-word shingles."""

import random

import numpy as np
import pytest

from phasespark.llm import simhash


def five_word_shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_all_pairs(texts):
    sets, group = [five_word_shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if root(i) == i]


def copies(seed):
    """Texts of many lengths with copies whose similarity lies on both sides of 0.8, and copies of copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in [8, 8, 9, 10, 11, 12, 13, 16, 17, 18, 19, 20, 24, 30, 60, 120, 300, 800] * 3:
        base = rng.choices(words, k=n)
        texts.append(base)
        for _ in range(4):
            other = list(rng.choice([base, texts[-1]]))
            cut = rng.choice([1, 1, 2, max(1, n // 9), max(1, n // 8)])
            texts.append(other[cut:] if rng.random() < 0.5 else other + rng.choices(words, k=cut))
            if n > 50:
                changed = list(base)
                for at in rng.sample(range(n), max(1, n // rng.choice([40, 45, 50]))):
                    changed[at] = "changed"
                texts.append(changed)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("tile", [2_000_000, 1500])
def test_pairs_link_as_their_shingles_do(spark, tile):
    texts = copies(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.deduplicate(df, **(simhash.SIMILAR | {"tile_shingles": tile} if tile != 2_000_000 else {})).collect())
    assert got == kept_by_all_pairs(texts)


def test_four_of_five_shingles_are_caught_and_three_of_four_are_not(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        a, b = (rng.choices([f"w{i}" for i in range(5000)], k=n) for n in (9, 8))
        texts += [" ".join(a), " ".join(a[:8]), " ".join(b), " ".join(b[:7])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.deduplicate(df).collect())
    assert got == [i for i in range(len(texts)) if i % 4 != 1]


def test_order_of_shingles_and_pieces_of_hot_ones_change_no_link(spark, monkeypatch):
    """A passage in every text is common, so it goes to the end of the prefixes, and its rows are cut into pieces."""
    rng = random.Random(7)
    passage = " ".join(rng.choices([f"p{i}" for i in range(50)], k=14))
    texts = [f"{t} {passage}" for t in copies(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles, links = simhash.common_shingles, simhash.prefix_links
    counted = []

    def common(docs, words):
        counted.append(shingles(docs, words, rate=2, least=30))
        return counted[-1]

    monkeypatch.setattr(simhash, "common_shingles", common)
    monkeypatch.setattr(simhash, "prefix_links", lambda codes, found, *a: links(codes, found, *a, rate=2, slice_rows=500, most_rows=120))
    got = sorted(r["doc_id"] for r in simhash.deduplicate(df).collect())
    assert counted[0].count() >= 10
    assert got == kept_by_all_pairs(texts)


def test_groups_of_a_run_match_all_pairs():
    rng = np.random.default_rng(4)
    for cross in (False, True):
        sizes = rng.integers(1, 60, 300)
        codes = rng.integers(0, 4, (300, 2)).astype(np.uint64)
        guest = rng.random(300) < 0.5 if cross else np.zeros(300, bool)
        group = np.arange(300)
        for i in range(300):
            for j in range(i):
                alike = np.bitwise_count(codes[i] ^ codes[j]).sum() <= 1 or min(sizes[i], sizes[j]) <= simhash.SHORT
                if alike and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and (not cross or guest[i] != guest[j]):
                    a, b = sorted((group[i], group[j]))
                    group[group == b] = a
        found = simhash.linked(sizes, codes, None, guest, cross, 1, 0.8)
        assert all((found[i] == found[j]) == (group[i] == group[j]) for i in range(300) for j in range(i))
        a, b = simhash.candidate_pairs(np.zeros(300, np.int64), np.arange(300), sizes, codes, guest, cross, 1, 0.8)
        roots = np.arange(300)
        roots[a] = b
        assert (roots == group).all()


def test_trees_give_candidates_by_themselves(spark, monkeypatch):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(900)] for _ in range(20)]
    texts += [[*t[:450], "changed", *t[451:]] for t in texts]  # few bits apart
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "prefix_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    codes = [simhash.simhash(" ".join(t), 5, repeats=False)[0][0] for t in texts]
    near = [i for i in range(20) if ((codes[i] ^ codes[i + 20]) & (1 << 64) - 1).bit_count() <= 4]
    assert len(near) > 10
    got = {r["doc_id"] for r in simhash.deduplicate(df).collect()}
    assert got == set(range(40)) - {i + 20 for i in near}
