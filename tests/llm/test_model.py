"""Language-model scoring by held-out texts."""

import math

import numpy as np

from corpusloom.llm import maxent


def grammar(rng, n):
    """Sentences in which the next word follows from the one before it, nearly always."""
    out = [0]
    for _ in range(n - 1):
        out.append((out[-1] * 7 + 3) % 97 if rng.random() < 0.9 else int(rng.integers(97)))
    return " ".join(f"t{x}" for x in out)


def test_training_beats_word_frequencies_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, grammar(rng, 400)) for i in range(60)], "doc_id long, text string")
    held = [grammar(rng, 400) for _ in range(20)]
    first, fitted = maxent.start(docs), maxent.fit(docs)
    before, after = (np.exp(-p.sum() / n.sum()) for n, p in (maxent.score_texts(m, held) for m in (first, fitted)))
    assert 80 < before < 120 and after < 0.4 * before
    shuffled = [" ".join(rng.permutation(t.split())) for t in held]
    n, p = maxent.score_texts(fitted, shuffled)
    assert np.exp(-p.sum() / n.sum()) > 2 * after


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    size = maxent.CLASS * maxent.CLASSES
    model = maxent.Model(np.empty(0, np.uint64), np.empty(0, np.int64), rng.normal(size=(2 * maxent.ROWS, maxent.CLASS)).astype(np.float32), rng.normal(size=maxent.CLASSES).astype(np.float32), rng.normal(size=(maxent.CLASSES, maxent.CLASS)).astype(np.float32))
    ids = np.arange(size)
    fixed = np.ones((3, size), np.int64)
    by_class = np.repeat(np.arange(maxent.CLASSES), maxent.CLASS)
    c, x = maxent._forward(model, ids, fixed, fixed + by_class)
    assert abs((c[ids, by_class] * x[ids, ids % maxent.CLASS]).sum() - 1) < 1e-4


def plain_softmax(x):
    e = [math.exp(max(-60.0, min(60.0, float(v)))) for v in x]
    return [v / sum(e) for v in e]


def small_model(rng, scale=1.0):
    size = (2 * maxent.ROWS, maxent.CLASS)
    return maxent.Model(np.empty(0, np.uint64), np.empty(0, np.int64), rng.normal(scale=scale, size=size).astype(np.float32), rng.normal(size=maxent.CLASSES).astype(np.float32), rng.normal(size=(maxent.CLASSES, maxent.CLASS)).astype(np.float32))


def test_forward_pass_and_gradient_step_equal_plain_loops():
    rng = np.random.default_rng(6)
    model = small_model(rng)
    n = 7
    ids = rng.integers(0, maxent.CLASS * maxent.CLASSES, n)
    rows_c, rows_w = rng.integers(0, 5, (3, n)), maxent.ROWS + rng.integers(0, 5, (3, n))
    c, x = maxent._forward(model, ids, rows_c, rows_w)
    for i in range(n):
        a, b = model.class_bias.astype(float), model.word_bias[ids[i] // maxent.CLASS].astype(float)
        for k in range(3):
            a, b = a + model.weights[rows_c[k, i]], b + model.weights[rows_w[k, i]]
        assert np.allclose(c[i], plain_softmax(a), atol=1e-5) and np.allclose(x[i], plain_softmax(b), atol=1e-5)
    weights, energy = model.weights.astype(float), np.zeros(len(model.weights))
    probabilities, wanted, rate = c.astype(float).copy(), ids // maxent.CLASS, 0.5
    mine = model._replace(weights=model.weights.copy())
    maxent._step(mine, np.zeros(len(model.weights), np.float32), rows_c, wanted, c.copy(), rate)
    for k in range(3):
        for row in sorted(set(rows_c[k].tolist())):
            total = np.zeros(maxent.CLASS)
            for i in range(n):
                if rows_c[k, i] == row:
                    total += [p - (j == wanted[i]) for j, p in enumerate(probabilities[i])]
            energy[row] += (total**2).sum()
            weights[row] -= total * rate / math.sqrt(energy[row] + 1e-6)
    assert np.allclose(mine.weights, weights, atol=1e-4)


def test_probabilities_add_up_for_any_logits():
    rng = np.random.default_rng(7)
    for scale in (1.0, 100.0):
        x = rng.normal(-scale, scale, (50, maxent.CLASS)).astype(np.float32)
        assert np.allclose(maxent._softmax(x.copy()).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(maxent._softmax(np.full((2, maxent.CLASS), -500, np.float32)), 1 / maxent.CLASS)


def test_changes_combine_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, grammar(rng, 100)) for i in range(30)], "doc_id long, text string").repartition(9, "doc_id")
    once = maxent.fit(docs).weights
    monkeypatch.setattr(maxent, "FAN", 2)
    assert np.allclose(maxent.fit(docs).weights, once, atol=1e-5) and np.abs(once).max() > 0.1


def test_scores_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "a b c", 0.0), (1, "a b c", 0.0), (2, None, 0.0), (3, "", 0.0), (None, "a b", 0.0), (4, "?!", 0.0), (5, grammar(rng, 100_000), 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_prob double")
    got = maxent.score(docs, maxent.fit(docs)).collect()
    assert len(got) == 7 and sorted(r.n_words for r in got) == [0, 0, 0, 2, 3, 3, 100_000]
    assert all((r.log_prob is None) == (r.perplexity is None) == (r.n_words == 0) for r in got)
    assert len({r.log_prob for r in got if r.n_words == 3}) == 1
    empty = docs.limit(0)
    assert maxent.score(empty, maxent.fit(empty)).count() == 0


def test_counts_cover_every_word(spark):
    rng = np.random.default_rng(4)
    texts = [grammar(rng, 200) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = [r["count"] for r in maxent.word_counts(docs).collect()]
    assert sum(counts) == 50 * 200 and len(counts) == len({w for t in texts for w in t.split()})


def test_all_counted_words_share_one_probability(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 12_000
    ranks = np.concatenate((np.arange(n), rng.zipf(1.3, 60_000) % n))
    rng.shuffle(ranks)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in ranks[i::100])) for i in range(100)], "doc_id long, text string").repartition(3)
    single = spark.createDataFrame([(i, f"w{i}") for i in range(n)], "doc_id long, text string")
    sums, scores = [], []
    for table in (1 << 18, 3000):
        monkeypatch.setattr(maxent, "TABLE", table)
        model = maxent.fit(docs)
        assert model.whole == (table > n) and len(model.split) == 1
        got = {r.doc_id: r.log_prob for r in maxent.score(single, model).collect()}
        sums.append(sum(np.exp(list(got.values()))))
        scores.append([got[i] for i in range(n)])
    assert 0.9 < sums[0] < 1 + 1e-3 and np.allclose(*scores, atol=1e-4)
    unseen = maxent.score_texts(model, ["neverseen"])[1][0]
    assert unseen <= np.median(scores[0])


def test_rare_words_differ_as_context():
    w = maxent.textops.words(["rare1 x", "rare2 x"])
    size = maxent.CLASS * maxent.CLASSES
    model = maxent.Model(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((2 * maxent.ROWS, maxent.CLASS), np.float32), np.zeros(maxent.CLASSES, np.float32), np.zeros((maxent.CLASSES, maxent.CLASS), np.float32))
    h = np.array([1, 1 + size], np.uint64)  # one slot
    rows = maxent._features(model, w._replace(hash=np.array([h[0], 5, h[1], 5], np.uint64)))[1]
    assert rows[0, 1] != rows[0, 3]


def levelled_model(rng, scale):
    """A model of one level, whose first words of the text below are frequent ones."""
    known = np.sort(maxent.textops.words([" ".join(f"t{x}" for x in range(40))]).hash)
    size, places = (3 * maxent.ROWS, maxent.CLASS), maxent.CLASS**2
    drawn = [rng.normal(size=s).astype(np.float32) for s in ((maxent.CLASSES,), (maxent.CLASSES, maxent.CLASS), (maxent.CLASS, maxent.CLASS))]
    return maxent.Model(known, rng.permutation(len(known)) * 90, rng.normal(scale=scale, size=size).astype(np.float32), drawn[0], drawn[1], (drawn[2],), np.ones(places))


def test_scores_equal_plain_loops_and_take_no_softmax(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [grammar(rng, 150), "", grammar(rng, 30)]
    w = maxent.textops.words(texts)
    for scale in (1.0, 40.0):  # logits of the second are beyond the limits
        model = levelled_model(rng, scale)
        f = maxent._features(model, w)
        plain = np.zeros(len(w.hash))

        def add(i, rows, bias, wanted):
            p = plain_softmax(sum(model.weights[r].astype(float) for r in rows) + bias)[wanted]
            plain[i] += math.log(max(p, 1e-30))

        for i, x in enumerate(f.ids):
            add(i, f.rows_c[:, i], model.class_bias, x // maxent.CLASS)
            add(i, f.rows_w[:, i], model.word_bias[x // maxent.CLASS], x % maxent.CLASS)
        rows, node, digit = f.levels[0]
        for j, i in enumerate(f.tail):
            add(i, rows[:, j], model.split[0][node[j]], digit[j])
        assert 0 < len(f.tail) < len(f.ids)
        with monkeypatch.context() as m:
            if scale == 1:
                m.setattr(maxent, "_softmax", None)
            n, p = maxent.score_texts(model, texts)
        rest = np.bincount(w.doc[f.tail], minlength=3) * math.log(1 / maxent.CLASS)
        assert n.tolist() == [150, 0, 30] and np.allclose(p, np.bincount(w.doc, plain, 3) + rest, rtol=1e-4)


def test_a_step_sums_runs_of_any_length_as_plain_loops():
    rng = np.random.default_rng(10)
    model = small_model(rng)
    runs = [1, 2, 3, 15, 16, 17, 18, 40, 1500]
    n = sum(runs)
    rows = np.stack([rng.permutation(np.repeat(rng.permutation(20)[: len(runs)], runs)) for _ in range(3)])
    wanted, p = rng.integers(0, maxent.CLASS, n), maxent._softmax(rng.normal(size=(n, maxent.CLASS)).astype(np.float32))
    weights, energy, grad = model.weights.astype(float), np.zeros(len(model.weights)), p.astype(float)
    grad[np.arange(n), wanted] -= 1
    maxent._step(model, mine := np.zeros(len(model.weights), np.float32), rows, wanted, p, 0.5)
    for k in range(3):
        for row in np.unique(rows[k]):
            total = grad[rows[k] == row].sum(axis=0)
            energy[row] += (total**2).sum()
            weights[row] -= total * 0.5 / math.sqrt(energy[row] + 1e-6)
    assert np.allclose(model.weights, weights, atol=1e-4) and np.allclose(mine, energy, rtol=1e-3)
