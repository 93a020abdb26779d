"""Language model, toxicity and quality rules against plain Python, and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from patchlight.llm import brown, quality, toxicity
from patchlight.llm.common import DOCUMENTS

LABELS = "doc_id bigint, quality int, toxic int"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- language model


def plain_tokens(text):
    return [*text.encode().lower().split(), b"\n"]


def check_scores(frame, rows, **model):
    texts = brown.raw(frame.where(brown.training(frame.doc_id)))
    counts = brown.written(brown.count_words(texts), "counts")
    fitted = brown.fit(texts, counts, **model)
    found = brown.score(frame, fitted, counts).collect()
    known = Counter()
    for d, t in rows:
        if d is not None and crc(d) % 10:
            known.update(plain_tokens(t))
    n, v = sum(known.values()), len(known)
    expected = []
    for d, t in rows:
        words = plain_tokens(t)
        base = sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected.append((d or -1, d is not None and crc(d) % 10 == 0, len(words), sum(known[w] > 0 for w in words), n, round(base, 5)))
    assert sorted((r.doc_id or -1 if r.doc_id != 0 else 0, *tuple(r)[1:5], round(r.base_score, 5)) for r in found) == sorted(
        (d if d != -1 or True else d, *rest) for d, *rest in [(e[0] if e[0] != -1 or rows[i][0] is None else 0, *e[1:]) for i, e in enumerate(expected)]
    )
    return fitted, found, known


def test_brown_scores(corpus):
    frame, rows = corpus
    fitted, found, known = check_scores(frame, rows, head=500, kept=2000)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # The score of each text, by the definition of the model: words that the model sends have its classes, all others are spelled.
    sent = {w: k for k, w in enumerate(fitted.known.words)}
    assert all((fitted.classes[k] < brown.CLASSES) == (k < 500 or known[w] >= brown.SEEN) for w, k in sent.items() if w != brown.END)

    def class_of(word):
        k = sent.get(word)
        return brown.CLASSES + brown.shape(word) if k is None else int(fitted.classes[k])

    n, types = Counter(), Counter()
    for w, c in known.items():
        n[class_of(w)] += c
        types[class_of(w)] += 1
    texts = dict(rows)
    for r in found[:40]:
        c, total = [brown.LAST, brown.LAST], 0.0
        for w in plain_tokens(texts[r.doc_id]):
            of = class_of(w)
            if of == brown.LAST:
                emit = 0.0
            elif of < brown.CLASSES:
                emit = math.log10(known[w] / n[of])
            else:
                mass = known[w] - brown.DISCOUNT if known[w] else brown.DISCOUNT * types[of]
                emit = math.log10(mass / n[of]) if n[of] else 0.0
            total += fitted.transitions[c[-2], c[-1], of] + emit
            c.append(of)
        assert abs(total - r.score) < 1e-6 * max(1, abs(total))


def plain_likeliest(left, right, pairs, current):
    """The class of the largest sum of logarithms, by loops."""
    def gain(c):
        size = [sum(row) for row in pairs]
        total = sum(right.values())
        out = sum(n * math.log((pairs[c][d] + brown.PRIOR) / (size[c] + brown.PRIOR * brown.ALL)) for d, n in right.items())
        out += sum(n * math.log((pairs[d][c] + brown.PRIOR) / (size[d] + brown.PRIOR * brown.ALL)) for d, n in left.items())
        return out - total * math.log(max(size[c], 1.0) + (0 if c == current else total))

    gains = [gain(c) for c in range(brown.CLASSES)]
    return {c for c, g in enumerate(gains) if g > max(gains) - 1e-6}


@pytest.fixture(scope="module")
def numbered(corpus):
    """Words known, texts as symbols, and the table of neighbours of the 60 most frequent words."""
    frame, _ = corpus
    texts = [bytes(r.text).lower().split() + [brown.END] for r in brown.raw(frame).collect()]
    counts = Counter(w for t in texts for w in t)
    top = sorted(counts, key=lambda w: (-counts[w], w.decode()))[:300]
    known = brown.Words("some words", top, np.array([counts[w] for w in top]))
    ids = brown.written(brown.number(brown.raw(frame), known), "numbered")
    spelled = brown.spellings(known)
    return texts, top, ids, spelled, brown.written(brown.neighbours(ids, spelled, 60), "neighbours")


def test_brown_neighbours(numbered):
    texts, top, _, _, table = numbered

    def narrow(word):
        k = top.index(word) if word in top[:60] else 60 + brown.shape(word)
        return 60 + brown.SHAPES if word == brown.END else k

    expected = Counter()
    for t in texts:
        numbers = [narrow(w) for w in [brown.END, *t]]
        for a, b in zip(numbers, numbers[1:]):
            if a < 60:
                expected[a, 2 * b + 1] += 1
            if b < 60:
                expected[b, 2 * a] += 1
    found = {}
    for r in table.collect():
        for other, n in zip(np.frombuffer(r.others, "<i4"), np.frombuffer(r["counts"], "<i8"), strict=True):
            assert (r.word, int(other)) not in found
            found[r.word, int(other)] = int(n)
    assert found == expected


def test_brown_exchange(numbered):
    """Pairs, each step's moves and the choice of words behind the head, by loops; the likelihood never falls."""
    texts, top, ids, spelled, table = numbered

    def class_of(word, assigned):
        if word == brown.END:
            return brown.LAST
        return int(assigned[top.index(word)]) if word in top[:60] else brown.CLASSES + brown.shape(word)

    def plain(assigned):
        pairs, left, right = np.zeros((brown.ALL, brown.ALL)), {}, {}
        for t in texts:
            words = [brown.END, *t]
            for a, b in zip(words, words[1:]):
                of_a, of_b = class_of(a, assigned), class_of(b, assigned)
                if {a, b} & (set(top[:60]) - {brown.END}):
                    pairs[of_a, of_b] += 1
                right.setdefault(a, Counter())[of_b] += 1
                left.setdefault(b, Counter())[of_a] += 1
        return pairs, left, right

    assigned = np.arange(60) % brown.CLASSES
    value = -math.inf
    for steps in (0, 1, 2, 3):
        assigned, pairs = brown.exchange(table, 60, steps)
        expected, left, right = plain(assigned)
        assert np.array_equal(pairs, expected) and brown.likelihood(pairs) >= value
        value = brown.likelihood(pairs)
        moved = brown.moves(table, assigned, pairs, 1, 2)
        for k, word in enumerate(top[:60]):
            if k % 2 and word != brown.END:
                assert moved[k] in plain_likeliest(left[word], right[word], pairs.tolist(), assigned[k])
            else:
                assert moved[k] == assigned[k]
    classes = spelled.copy()
    classes[:60] = assigned
    classes[spelled == brown.LAST] = brown.LAST
    joining = (np.arange(len(classes)) >= 60) & (np.arange(len(classes)) < len(top)) & (spelled != brown.LAST)
    joined = brown.join_classes(ids, classes, joining, pairs)
    assert np.array_equal(joined[~joining], classes[~joining])
    for k in np.flatnonzero(joining)[::10]:
        assert joined[k] in plain_likeliest(left[top[k]], right[top[k]], pairs.tolist(), -1)


def test_brown_transitions_add_up(corpus):
    counts = np.zeros((4, 4, 4))
    counts[0, 1, 2], counts[1, 2, 0] = 5, 1
    brown_all, brown.ALL = brown.ALL, 4
    try:
        assert np.allclose((10 ** brown.smoothed(counts)).sum(-1), 1)
    finally:
        brown.ALL = brown_all


def test_brown_on_edge_rows(edges, edge_rows, crowded, nothing):
    check_scores(edges, [(d, t or "") for d, t, *_ in edge_rows])
    assert brown.score_documents(crowded).count() == len(edge_rows)
    assert brown.score_documents(nothing).count() == 0


def test_brown_without_training_rows(spark):
    held = next(d for d in range(100) if crc(d) % 10 == 0)
    row = brown.score_documents(spark.createDataFrame([(held, "a b c")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (4, 0, 0, 0.0) and row.score <= 0


# --- toxicity


def toxic_rows(n=400, seed=4):
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for d in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, rng.integers(5, 60))]
        toxic = int(d % 5 == 0)
        if toxic:
            for k in range(2):
                words.insert(int(rng.integers(0, len(words))), ["vile", "nasty", "awful", "horrid", "foul"][int(rng.integers(0, 5))])
        rows.append((d, " ".join(words)))
        marks.append((d, 1, toxic))
    return rows, marks


def test_toxicity_finds_held_out_rows(spark):
    rows, marks = toxic_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, LABELS)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(scores[d], toxic) for d, _, toxic in marks if crc(d) % 3 == 1]
    right = [(s >= toxicity.THRESHOLD) == bool(toxic) for s, toxic in held]
    assert sum(right) / len(right) > 0.97 and all(0 <= s <= 1 for s, _ in held)


def test_toxicity_learns_from_no_held_out_label(spark):
    rows, marks = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flipped = [(d, q, 1 - t if crc(d) % 3 == 1 else t) for d, q, t in marks]
    scores = [
        {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(m, LABELS))).collect()}
        for m in (marks, flipped)
    ]
    assert scores[0] == scores[1]


def test_nearest_is_exact(spark):
    rows, marks = toxic_rows(900)
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, LABELS)
    index = toxicity.fit(docs, labels)
    assert len(index.ids) > 2 * toxicity.BLOCK
    dense = np.zeros((len(index.ids), len(index.keys)))
    for term, (held, weights) in enumerate(zip(index.rows, index.weights, strict=True)):
        dense[held, term] = weights
    for _, text in rows[::5]:
        terms, weights = index.vector(toxicity.terms_of(text))
        query = np.zeros(len(index.keys))
        query[terms] = weights
        cosine = dense @ query
        expected = [(round(float(cosine[i]), 9), int(i)) for i in np.flatnonzero(cosine > 0)]
        expected = sorted(expected, key=lambda f: (-f[0], f[1]))[:5]
        assert [f[0] for f in index.nearest(terms, weights, 5)] == pytest.approx([f[0] for f in expected], abs=1e-8)


def test_heads_of_a_group_are_in_no_posting(spark):
    """Frequent terms of alike examples are multiplied, not added up one posting at a time, and the neighbours stay exact."""
    rng = np.random.default_rng(5)
    rows = [(d, " ".join(f"{'ab'[d % 2]}{k}" for k in rng.integers(0, 40, 12))) for d in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(d, 1, int(d % 7 == 0)) for d, _ in rows], LABELS))
    layout = index.layout
    assert len(layout.spans) > 1 and sorted(layout.order.tolist()) == list(range(len(index.ids)))
    assert len(layout.postings) + sum(np.count_nonzero(d) for d in layout.dense) == len(index.row)
    assert len(layout.postings) < len(index.row) / 10
    vectors = [index.vector_of(text) for _, text in rows[:300]]
    leave = [-1] * 299 + [3]
    dense = np.zeros((len(index.ids), len(index.keys)))
    for term, (held, weights) in enumerate(zip(index.rows, index.weights, strict=True)):
        dense[held, term] = weights
    for (terms, weights), out, near in zip(vectors, leave, index.all_nearest(vectors, 5, leave), strict=True):
        cosine = dense[:, terms] @ weights
        cosine[[out] if out >= 0 else []] = 0
        assert [c for c, _ in near] == pytest.approx(np.sort(cosine)[::-1][:5], abs=1e-8)
        assert [cosine[i] for _, i in near] == pytest.approx([c for c, _ in near], abs=1e-8)


def test_vectors_against_plain_tf_idf(spark):
    """Terms, weights, lengths, neighbours and votes, rebuilt from the texts and labels alone."""
    rows, marks = toxic_rows(300)
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, LABELS)
    index = toxicity.fit(docs, labels)
    texts, toxic = dict(rows), {d: t for d, _, t in marks}
    ids = [d for d in sorted(texts) if crc(d) % 3 != 1]

    def terms(text):
        return Counter(t for w in text.lower().split() for t in [w, *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) > k)])

    n, hits = Counter(t for d in ids for t in terms(texts[d])), Counter(t for d in ids if toxic[d] for t in terms(texts[d]))

    def weight(t, c):
        idf = math.log((len(ids) + 1) / (n[t] + 1)) + 1
        if not n[t]:
            return (1 + math.log(c)) * idf
        share, z = hits[t] / n[t], 1.96
        low = (share + z * z / (2 * n[t]) - z * math.sqrt(share * (1 - share) / n[t] + z * z / (4 * n[t] ** 2))) / (1 + z * z / n[t])
        return (1 + math.log(c)) * idf * (1 + (toxicity.STRESS - 1) * max(0.0, (low - 0.5) / 0.5))

    def unit(text):
        raw = {t: weight(t, c) for t, c in terms(text).items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()}

    vectors = [unit(texts[d]) for d in ids]
    for d in list(texts)[::7]:
        query = unit(texts[d])
        cosines = [sum(w * v.get(t, 0.0) for t, w in query.items()) for v in vectors]
        expected = sorted(((-round(c, 9), i) for i, c in enumerate(cosines) if c > 0))[: toxicity.NEIGHBOURS]
        score, near = next(index.scores([texts[d]]))
        assert [c for c, _ in near] == pytest.approx([-c for c, _ in expected], abs=2e-8)
        total = sum(c for c, _ in near)
        vote = (sum(c * toxic[ids[i]] for c, i in near) + 0.5 * (sum(toxic[k] for k in ids) + 0.5) / (len(ids) + 1)) / (total + 0.5)
        assert index.vote(near) == pytest.approx(vote) and score == pytest.approx(float(np.interp(vote, *index.curve)))


def test_all_of_a_long_run_of_letters_counts():
    run = "x" * 40 + "abc" * 30
    assert sorted(t for t in toxicity.terms_of(run) if t[0] != "^") == sorted([run[:40], run[40:80], run[80:120], run[120:]])


def test_vector_of_a_text_is_that_of_its_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gammas{i % 5} {'long' * 30}", "en", "s", 0) for i in range(60)], DOCUMENTS)
    index = toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS))
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 3)
    monkeypatch.setattr(toxicity, "KEPT_ANSWERS", 2)
    texts = ["", "strange words only", "alpha alpha beta1 strange strange " + "long" * 30, "Gammas3 gammas4 gammaxx", "longlonglong" * 12]
    for text in texts:
        terms, weights = index.vector_of(text)
        expected = dict(zip(*(x.tolist() for x in index.vector(toxicity.terms_of(text))), strict=True))
        assert dict(zip(terms.tolist(), weights.tolist(), strict=True)) == pytest.approx(expected)
    once = [next(iter(index.scores([text]))) for text in texts]
    assert list(index.scores(texts * 30)) == once * 30


def test_toxicity_searches_whole_texts(spark):
    """Clean examples and clean words are in the index; a toxic text without a telling word meets its like."""
    rows, marks = toxic_rows()
    telling = {"vile", "nasty", "awful", "horrid", "foul"}
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, LABELS)
    index = toxicity.fit(docs, labels)
    assert sorted(index.ids.tolist()) == [d for d, _ in rows if crc(d) % 3 != 1]
    held = sorted({w for d, t in rows if crc(d) % 3 != 1 for w in t.split()})
    assert (toxicity.numbers_of([*held, "strange"], index.keys, index.place) >= 0).tolist() == [True] * len(held) + [False]
    text = " ".join(w for w in dict(rows)[next(d for d, _, t in marks if t and crc(d) % 3 != 1)].split() if w not in telling)
    (_, near), (share, none) = index.scores([text, "nothing known"])
    assert len(near) == toxicity.NEIGHBOURS and index.labels[near[0][1]] == 1
    assert none == [] and share == index.share


def test_toxicity_on_edge_rows(spark, edges, crowded, nothing):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1), (99, 0, 1)], LABELS)
    for labels in (none, odd):
        rows = toxicity.score(edges, toxicity.fit(edges, labels)).collect()
        assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score_rows(crowded, toxicity.fit(crowded, labels)).select("row.*").columns == crowded.columns
    assert toxicity.score(nothing, toxicity.fit(nothing, odd)).count() == 0


# --- quality rules


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_buckets(text):
    words = re.findall(r"[^\W]+|[^\w\s]+", text.lower())
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(b.encode(), a) for a, b in zip(one, words[1:])]
    return [signed(h) % quality.BUCKETS for h in one + two]


def test_quality_rules(spark, corpus):
    frame, rows = corpus
    marks = [(d, int(d % 7 > 0), 0) for d, _ in rows if d % 2]
    model = quality.fit(frame, spark.createDataFrame(marks, LABELS))
    found = {r["row"].doc_id: r for r in quality.judge(frame, model).collect()}
    raw, target = Counter(), Counter()
    trusted = {d for d, q, _ in marks if q}
    ascii_rows = [(d, t) for d, t in rows]
    for d, t in ascii_rows:
        raw.update(plain_buckets(t))
        if d in trusted:
            target.update(plain_buckets(t))
    n, m, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = lambda k: math.log((target[k] + 1) / (m + b)) - math.log((raw[k] + 1) / (n + b))
    for d, t in rows:
        assert tuple(found[d][c] for c in [*quality.COUNTS, "base_failed"]) == plain_rules(t)
        buckets = plain_buckets(t)
        score = sum(map(ratio, buckets)) / len(buckets) if buckets else 0.0
        assert found[d].score == pytest.approx(score, abs=1e-9)
        assert found[d].kept == (not found[d].base_failed and found[d].score >= model.threshold)


def test_the_cut():
    assert quality.cut([(-9, 0, 5), (3, 50, 0)]) == (-8 + 3) / 2 / quality.BINS
    assert quality.cut([(4, 10, 0)]) == 4 / quality.BINS
    assert quality.cut([]) == 0


def test_quality_on_edge_rows(spark, edges, edge_rows, crowded, nothing):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, 0), (3, 1, 1), (4, 0, 0), (99, 0, 1)], LABELS)
    for labels in (none, odd):
        rows = quality.judge(edges, quality.fit(edges, labels)).collect()
        found = sorted((r["row"].doc_id or 0, *(r[c] for c in [*quality.COUNTS, "base_failed"])) for r in rows)
        assert found == sorted((d or 0, *plain_rules(t or "")) for d, t, *_ in edge_rows)
    assert quality.judge(crowded, quality.fit(crowded, odd)).where("kept").select("row.*").columns == crowded.columns
    assert quality.judge(nothing, quality.fit(nothing, odd)).count() == 0
    assert quality.judge(nothing, quality.fit(nothing, none)).count() == 0


# --- pipeline


def test_every_stage_takes_odd_tables(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            if name != "packing":
                assert out.schema.simpleString() == frame.schema.simpleString()
            out.collect()


def test_pipeline_decisions_take_effect(spark, tmp_path):
    clean, marks = [], []
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstu"), 9))
    for d in range(120):
        clean.append((d, " ".join(word() for _ in range(90))))
        marks.append((d, 1, 0))
    texts = dict(clean)
    toxic = list(range(200, 260))
    for d in toxic:
        clean.append((d, " ".join([*(word() for _ in range(70)), "vile", "foul"])))
        marks.append((d, 1, 1))
    junk = list(range(300, 330))
    for d in junk:
        clean.append((d, " ".join(word() + "*** $$$" for _ in range(90))))
        marks.append((d, 0, 0))
    near = texts[5].split()
    near[40] = "changed"
    shared = " ".join(word() for _ in range(60))
    rows = [*clean, (400, " ".join(near)), (401, texts[5]), (402, "too short")]
    rows += [(410, f"{texts[6][:300]}X {shared} Y{texts[7][:200]}"), (411, f"{texts[8][:300]}U {shared} V{texts[9][:200]}")]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.schema(DOCUMENTS).parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not left[0] & {*junk, 402} and left[0] >= {*range(120), *toxic, 400, 401, 410, 411}
    assert not left[1] & set(toxic) and left[1] >= {*range(120), 400, 401, 410, 411}
    assert left[2] == left[1] - {400, 401}
    assert left[3] == left[2]
    after = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert shared not in after[410].text and after[410].n_chars == len(after[410].text) < len(dict(rows)[410])
    assert after[20].text == texts[20]
    assert left[4] == left[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == docs.count()


def test_signs_are_counted_without_a_map_of_characters(spark):
    """``translate`` looks every character up as a string of its own."""
    texts = ["", " \t\n\x0b\x0c\r", "a", "#*$%&|<>", "ab\u00a0c <\U0001f600> \x1c\x85 & ^-[]\n\n#\r%x", "\u2003 \x00|\x7f "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row int, text string")
    counted = quality.with_counts(rows)
    found = {r.row: (r.word_chars, r.n_symbols) for r in counted.select("row", "word_chars", "n_symbols").collect()}
    want = [(sum(c not in " \t\n\x0b\x0c\r" for c in t), sum(c in "#*$%&|<>" for c in t)) for t in texts]
    assert found == dict(enumerate(want))
    assert "translate(" not in counted._jdf.queryExecution().optimizedPlan().toString()
