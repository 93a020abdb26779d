"""Fingerprints, repeated strings and the Jaccard join against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchlight.llm import fingerprints, jaccard, substrings
from patchlight.llm.common import DOCUMENTS
from patchlight.llm.components import components


def shingles(text, split=None):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard_of(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


# --- fingerprints


def test_fingerprints(corpus):
    frame, rows = corpus
    found = {r.doc_id: r for r in fingerprints.fingerprint(frame).collect()}
    texts = dict(rows)
    ids = sorted(texts, reverse=True)
    errors = []
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (found[d].n_chars, found[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(shingles(text)) > 400:
            errors.append(abs(found[d].near_edited - jaccard_of(shingles(text), shingles(edited))))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.25


def test_equal_texts_have_equal_fingerprints(edges, crowded):
    rows = fingerprints.fingerprint(edges).collect()
    assert len(rows) == 16
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].fingerprint == by_id[6].fingerprint != ""
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[13].fingerprint == ""
    assert by_id[2].near_next == 1.0  # neither of the two texts has words
    assert None in by_id
    assert sorted(map(str, fingerprints.fingerprint(crowded).collect())) == sorted(map(str, rows))


def test_fingerprints_merge_and_contain(spark):
    words = [f"w{i}" for i in range(6000)]
    whole, part = " ".join(words), " ".join(words[:600])
    frame = spark.createDataFrame([(whole, part)], "a string, b string")
    frame = fingerprints.with_sketch(fingerprints.with_sketch(frame, "a", "sa"), "b", "sb")
    row = frame.select(fingerprints.containment("sb", "sa"), fingerprints.containment("sa", "sb")).first()
    assert row[0] == 1.0 and abs(row[1] - 0.1) < 0.04


def test_merged_sketches_are_the_sketch_of_both(spark):
    """Also where a text has no hash below the limit, so that its sketch is its smallest hash alone."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(n)) for n in [0, 1, 3, 5, 6, 6, 7, 8, 9, 30, 200]]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    frame = fingerprints.with_sketch(fingerprints.with_sketch(pairs, "a", "sa"), "b", "sb")
    limit = fingerprints.limit_of(fingerprints.SCALE)

    def plain(*held):
        hashes = set().union(*held)
        return sorted({h for h in hashes if h <= limit} | ({min(hashes)} if hashes else set()))

    whole = {r.a: r.s for r in fingerprints.with_sketch(pairs, "a", "s", scale=1).select("a", "s").distinct().collect()}
    rows = frame.withColumn("merged", fingerprints.merge("sa", "sb")).collect()
    assert any(r.sa and r.sa[0] > limit for r in rows)
    for r in rows:
        assert r.sa == plain(whole[r.a]) and r.merged == plain(whole[r.a], whole[r.b])


def test_fingerprints_of_nothing(nothing):
    assert fingerprints.fingerprint(nothing).count() == 0


# --- repeated strings


def brute_removal(texts):
    """(n_bytes, n_removed, n_spans, sha) by counting every string of 200 bytes."""
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                covered[i + 1 : i + 201] = True
        spans = int((np.diff(covered.astype(int)) == 1).sum())
        kept = bytes(b for b, c in zip(t, covered[1:]) if not c)
        out.append((len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def invented(seed, n=60):
    """Texts of few letters with shared, nested, periodic and overlapping passages, edits and copies."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(150, 900))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            p = p[a : a + rng.randint(100, 700)]
            if rng.random() < 0.5 and p:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150)))]
        texts.append("".join(parts))
    return [*texts, texts[0], "a" * 700, "ab" * 300, "b" * 199, "c" * 200, "d" * 201, "", passages[0] * 3]


@pytest.mark.parametrize("seed", range(4))
def test_removal_is_exact(spark, seed):
    texts = invented(seed)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS).repartition(1 + 3 * (seed % 3))
    rows = substrings.removal_digests(frame).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_removal([t.encode() for t in texts])


def edited_copies(seed, groups=60):
    """Groups of 3 to 5 copies of a random text with one edit each: their shared passages have different extents."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1500))
        for _ in range(rng.randint(3, 5)):
            k = rng.randrange(len(base))
            texts.append(base[:k] + "#" + base[k + 1 :])
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_removal_is_exact_in_groups_of_edited_copies(spark, seed):
    texts = edited_copies(seed)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS).repartition(1 + 4 * seed)
    rows = substrings.removal_digests(frame).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_removal([t.encode() for t in texts])


def test_removal_in_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    texts = invented(11, 40)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS).repartition(7)
    rows = substrings.removal_digests(frame).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_removal([t.encode() for t in texts])


def test_removal_on_edge_rows(edges, edge_rows, crowded):
    rows = substrings.removal_digests(edges).collect()
    texts = [(t or "").encode() for _, t, *_ in edge_rows]
    expected = sorted((d or 0, *b) for (d, *_), b in zip(edge_rows, brute_removal(texts), strict=True))
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in rows) == expected
    left = substrings.without_repeats(crowded).collect()
    assert left[0].__fields__ == crowded.columns and len(left) == len(edge_rows)
    for r in left:
        if r.doc_id in (7, 8):
            assert "shared30" not in r.text and r.n_chars == len(r.text) and r.content == 3


def test_removal_of_nothing(nothing):
    assert substrings.removal_digests(nothing).count() == 0
    assert substrings.without_repeats(nothing).count() == 0


# --- join


def brute_links(rows, threshold=(4, 5)):
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), c in common.items():
        if threshold[1] * c >= threshold[0] * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)]


def test_join_on_the_corpus(corpus):
    frame, rows = corpus
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(frame).collect()]
    assert sorted(found) == sorted(brute_links(rows))


def near_group(n, seed=2):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{i}_{rng.randrange(1000)}"
        out.append((i, " ".join(words)))
    return [*out, (n, " ".join(base)), (n + 1, " ".join(base)), (n + 2, "quite other words are here now")]


@pytest.mark.parametrize("block", [512, 20])
def test_join_of_a_large_group(spark, monkeypatch, block):
    """Blocks meet each other: the counts do not depend on their size."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_group(110)
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCUMENTS)
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(frame).collect()]
    assert sorted(found) == sorted(brute_links(rows))


def test_join_on_edge_rows(edges, edge_rows, crowded):
    rows = [(d, t or "") for d, t, *_ in edge_rows]
    key = lambda r: (r[0] or 0, r[1] or 0, r[2])
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(edges).collect()]
    assert sorted(found, key=key) == sorted(brute_links(rows), key=key)
    kept = jaccard.one_of_each(crowded).collect()
    assert kept[0].__fields__ == crowded.columns
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 5, 7, 9, 12, 13, 14]


def test_join_of_nothing(nothing):
    assert jaccard.similar(nothing).count() == jaccard.one_of_each(nothing).count() == 0


def alike_texts(n, kept, seed, words=100):
    """Texts that share the first ``kept`` words of one page and go on with words of their own."""
    page = [f"p{i}" for i in range(kept)]
    return [(i, " ".join(page + [f"w{seed}_{i}_{k}" for k in range(words - kept)])) for i in range(n)]


@pytest.mark.parametrize("node", [4096, 8])
def test_no_pair_at_the_threshold_is_lost(spark, monkeypatch, node):
    """300 pairs from the threshold up to 0.9, the two texts of a pair equal but for their ends."""
    monkeypatch.setattr(jaccard, "NODE", node)
    rng = random.Random(11)
    rows = []
    for pair in range(300):
        n = rng.randint(40, 300)
        base = [f"{pair}_{k}" for k in range(n)]
        far = rng.randint(2, 10 * n // 100)
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(base[:-far] + [f"x{pair}_{k}" for k in range(far)]))]
    rows += [(d + 1000, t) for d, t in near_group(60)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCUMENTS)
    found = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(frame).collect()]
    assert sorted(found) == sorted(brute_links(rows))


@pytest.mark.parametrize("kept", [57, 67])
def test_boilerplate_makes_no_group(spark, kept):
    """1,500 texts of which every two are 0.38 or 0.49 alike meet in tries, but next to none is verified."""
    rows = alike_texts(1500, kept, kept)
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.35 < jaccard_of(a, b) < 0.5
    hashes = [jaccard.signature(jaccard.shingles(t)) for _, t in rows]
    classes = [
        (i, [int(x) for x in jaccard.nodes(v, jaccard.level(0.8))], bytearray(jaccard.brief(v).tobytes())) for (i, _), v in zip(rows, hashes)
    ]
    frame = spark.createDataFrame(classes, "id bigint, nodes array<bigint>, brief binary")
    sizes = jaccard.candidates(frame).groupBy("component").count().collect()
    assert max((r["count"] for r in sizes), default=0) <= 15


def test_connected_is_brute_force():
    rng = np.random.default_rng(4)
    least, tree, depth = jaccard.least_matches(0.8), 3, jaccard.level(0.8)
    centres = rng.integers(0, 256, (12, jaccard.TREES * jaccard.DEPTH), dtype=np.uint8)
    briefs = centres[rng.integers(0, 12, 300)]
    noise = rng.random(briefs.shape) < 0.2
    briefs = np.where(noise, rng.integers(0, 256, briefs.shape, dtype=np.uint8), briefs)
    briefs[:, tree * jaccard.DEPTH : tree * jaccard.DEPTH + depth] = 7  # one node
    label = jaccard.connected(briefs, tree, depth, least)
    alike = (briefs[:, None, :] == briefs[None, :, :]).sum(axis=2) >= least
    expected = np.arange(300)
    while True:
        lower = np.where(alike, expected[None, :], 300).min(axis=1)
        if (lower == expected).all():
            break
        expected = lower
    assert len(set(label)) == len(set(expected)) == len(set(zip(label, expected)))
    assert (label[label] == label).all()


def test_least_matches_of_the_threshold():
    rng = np.random.default_rng(1)
    draws = rng.binomial(jaccard.TREES * jaccard.DEPTH, 0.8, 1_000_000)
    least = jaccard.least_matches(0.8)
    assert (draws < least).mean() <= 5 * jaccard.MISSED
    assert (draws < least + 4).mean() > jaccard.MISSED


def test_recall_sets_the_prefix():
    depth = jaccard.level(0.8)
    assert 1 - (1 - 0.8**depth) ** jaccard.TREES >= jaccard.RECALL
    assert depth == jaccard.DEPTH or 1 - (1 - 0.8 ** (depth + 1)) ** jaccard.TREES < jaccard.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100}
