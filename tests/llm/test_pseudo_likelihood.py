import random

import numpy as np

from daygrain.llm import pseudo_likelihood as P


def language(rng, n):
    """Words that follow each other in a ring, so that neighbours tell the word."""
    at, out = rng.randrange(40), []
    for _ in range(n):
        out.append(f"w{at}")
        at = (at + rng.choice([1, 1, 1, 2])) % 40
    return out


def test_language_scores_above_shuffled_words(frame):
    rng = random.Random(1)
    train = [(i, " ".join(language(rng, 200))) for i in range(200)]
    model = P.fit(frame(train))
    test, shuffled = [], []
    for i in range(30):
        words = language(rng, 100)
        test.append((i, " ".join(words)))
        rng.shuffle(words)
        shuffled.append((i, " ".join(words)))
    good = {r["id"]: r["mean_log_probability"] for r in P.score(frame(test), model).collect()}
    bad = {r["id"]: r["mean_log_probability"] for r in P.score(frame(shuffled), model).collect()}
    assert all(good[i] > bad[i] + 0.5 for i in good)
    assert np.mean(list(good.values())) > -np.log(40) + 0.5  # better than the frequencies of the words


def test_scores_match_a_plain_computation(frame):
    weights = P.Weights.start(3)
    rng = np.random.default_rng(1)
    weights.classes += rng.normal(0, 0.3, weights.classes.shape).astype(np.float32)
    weights.members += rng.normal(0, 0.3, weights.members.shape).astype(np.float32)
    frequent = P.vocabulary(frame([(1, "a b c a b a")]))
    text = "a b x c a"
    row = P.score(frame([(1, text)]), (frequent, weights)).first()
    ids, _ = P.Lookup(frequent).texts([text.encode()])
    assert ids[:2].tolist() == [0, 1] and ids[4] == 0  # by frequency
    total = 0.0
    for t, own in enumerate(ids):
        h = sum(weights.embed[k][ids[t + o] if 0 <= t + o < len(ids) else P.OUTSIDE] for k, o in enumerate(P.OFFSETS))
        h = np.tanh(h.astype(np.float64))
        def log_softmax(rows, pick):
            logits = rows[:, :-1] @ h + rows[:, -1]
            return logits[pick] - np.log(np.exp(logits).sum())
        total += log_softmax(weights.classes, own // P.MEMBERS) + log_softmax(weights.members[own // P.MEMBERS], own % P.MEMBERS)
    assert abs(row["log_likelihood"] - total) < 1e-3 and row["n_words"] == 5
    assert abs(row["mean_log_probability"] - total / 5) < 1e-3


def test_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, P.WORDS, 64).astype(np.int32)
    near = P.contexts(ids, np.repeat([0, 1], 32))
    assert (near[0, :2] == P.OUTSIDE).all() and (near[31, 2:] == P.OUTSIDE).all() and near[1, 1] == ids[0]
    trainer = P.Trainer(P.Weights.start())
    before = P.log_probabilities(trainer.w, ids, near).sum()
    for _ in range(5):
        trainer.step(ids, near)
    assert P.log_probabilities(trainer.w, ids, near).sum() > before + 10


def test_odd_rows(odd, empty):
    model = P.fit(odd)
    got = P.score(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["mean_log_probability"] is None) == (r["n_words"] == 0) and r["log_likelihood"] <= 0
    assert sum(r["n_words"] == 0 for r in got) == 5
    nothing = P.fit(empty)
    assert P.score(empty, nothing).count() == 0 and P.score(odd, nothing).count() == odd.count()


def test_every_word_is_learned_from():
    assert (P.CLASSES, P.MEMBERS, P.WIDTH) == (64, 64, 32)

    class Counter:
        def __init__(self):
            self.seen = []

        def step(self, ids, near):
            self.seen += ids.tolist()

    counter, ids = Counter(), np.arange(2 * P.BATCH + 100, dtype=np.int32)
    assert P.study(counter, ids, np.zeros(len(ids), np.int64), np.random.default_rng(0)) == len(ids)
    assert sorted(counter.seen) == ids.tolist()


def test_rare_words_have_probabilities_of_their_own(frame):
    rng = random.Random(5)
    # 3,900 words that fill the ids of the network, then rare ones of 1 to 3 occurrences.
    rare = {f"rare{i}": 1 + i % 3 for i in range(900)}
    words = [f"w{i}" for i in range(3900)] * 5 + [w for w, n in rare.items() for _ in range(n)]
    rng.shuffle(words)
    model = P.fit(frame([(i, " ".join(words[i::50])) for i in range(50)]), rounds=1)
    frequent, weights, rest = model
    assert len(frequent) == 3840 and rest.count() == 60 + 900
    ids, _, hashes = P.Lookup(frequent).hashed([w.encode() for w in rare])
    counts = {r["word"]: r["n"] for r in rest.collect()}
    totals = {}
    for h, n in counts.items():
        key = (h % (1 << 64) >> 40) % 256
        totals[key] = totals.get(key, 0) + n
    whole = {r["id"]: r["log_likelihood"] for r in P.score(frame(list(enumerate(rare))), model).collect()}
    shared = {r["id"]: r["log_likelihood"] for r in P.score(frame(list(enumerate(rare))), (frequent, weights)).collect()}
    for i, (w, n) in enumerate(rare.items()):
        assert counts[int(hashes[i].view(np.int64))] == n
        assert abs(whole[i] - shared[i] - np.log(n / totals[ids[i] - 3840])) < 1e-6
    unseen = P.score(frame([(1, "neverseen")]), model).first()["log_likelihood"]
    assert unseen < P.score(frame([(1, "neverseen")]), (frequent, weights)).first()["log_likelihood"]


def test_the_network_grows_with_the_distinct_words():
    assert P.side_of(0) == 64 and P.side_of(65536) == 64 and P.side_of(10 ** 6) == 127
    weights = P.Weights.start(side=300)
    ids = np.array([0, 89999, 70000, 5], np.int32)
    near = P.contexts(ids, np.zeros(4, np.int64), 90000)
    trainer = P.Trainer(P.Weights.of_rows(weights.rows(), 300))
    before = P.log_probabilities(trainer.w, ids, near).sum()
    for _ in range(3):
        trainer.step(ids, near)
    assert P.log_probabilities(trainer.w, ids, near).sum() > before


def test_one_step_and_two_steps_of_averaging_agree(frame, monkeypatch):
    rng = random.Random(9)
    docs = frame([(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(60))) for i in range(80)]).repartition(20, "doc_id")
    one = P.fit(docs, rounds=1)[1].rows()
    monkeypatch.setattr(P, "FAN", 1)
    two = P.fit(docs, rounds=1)[1].rows()
    assert np.abs(one - P.Weights.start().rows()).max() > 0.01 and np.abs(one - two).max() < 1e-5


def test_large_networks_predict_in_three_steps():
    assert [rows.shape[1] for rows, _ in P.Weights.start(side=64).steps()] == [64, 64]
    steps = P.Weights.start(side=160).steps()
    assert len(steps) == 3 and sum(rows.shape[1] for rows, _ in steps) < 100  # 320 in two steps
    rng = np.random.default_rng(4)
    weights = P.Weights.start(side=70)
    for rows, _ in weights.steps():
        rows += rng.normal(0, 0.3, rows.shape).astype(np.float32)
    weights.classes[:, -1] += 200  # beyond what exp can hold: logits are shifted
    every = np.arange(70 * 70, dtype=np.int32)
    near = np.repeat(np.array([[1, 2, 3, 4]], np.int32), len(every), axis=0)
    h = np.tanh(sum(weights.embed[k][k + 1] for k in range(4)).astype(np.float64))
    want = np.zeros(len(every))
    for rows, size in weights.steps():
        logits = rows[:, :, :-1] @ h + rows[:, :, -1]
        logits -= logits.max(-1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(-1, keepdims=True))
        want += logs[every // size // rows.shape[1], every // size % rows.shape[1]]
    assert np.abs(P.log_probabilities(weights, every, near) - want).max() < 1e-3
    again = P.Weights.of_rows(weights.rows(), 70)
    assert all((a == b).all() for a, b in zip(weights.parts(), again.parts(), strict=True)) and again.side == 70


def test_three_steps_follow_the_gradient():
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 3000), 4900).astype(np.int32) - 1  # frequent words are one range, rare ones many small ones
    near = P.contexts(ids, np.zeros(len(ids), np.int64), 4900)
    trainer = P.Trainer(P.Weights.start(side=70))
    for rows, _ in trainer.w.steps():
        rows += rng.normal(0, 0.3, rows.shape).astype(np.float32)
    start = P.Weights.of_rows(trainer.w.rows(), 70)
    trainer.step(ids, near)
    # The first step of each weight follows the sign of its gradient; the loss of both sides of a weight tells that sign.
    for part, moved in zip(start.parts(), trainer.w.parts(), strict=True):
        far = np.argsort(-trainer.seen.parts()[[p is moved for p in trainer.w.parts()].index(True)].ravel())[:5]
        for at in far.tolist():
            losses = []
            for shift in (-0.05, 0.05):
                held = part.ravel()[at]
                part.reshape(-1)[at] = held + shift
                losses.append(-P.log_probabilities(start, ids, near).sum())
                part.reshape(-1)[at] = held
            assert (losses[1] - losses[0]) * (moved.ravel()[at] - part.ravel()[at]) < 0


def test_sums_of_groups_and_words_of_equal_leading_bits():
    rng = np.random.default_rng(7)
    rows, first = rng.normal(0, 1, (1000, 3)), np.concatenate([[0], np.sort(rng.choice(np.arange(1, 1000), 60, replace=False)), [999]])
    first = np.unique(first)
    assert np.allclose(P.group_sums(rows.copy(), first), np.add.reduceat(rows, first, axis=0))
    hashes = np.array([5, 1 << 50, (1 << 50) + 1, (1 << 50) + 2, (1 << 64) - 1], np.uint64)
    lookup = P.Lookup(hashes[[3, 0, 4, 1, 2]])
    assert lookup(hashes).tolist() == [1, 3, 4, 0, 2]
    assert (lookup(hashes + np.uint64(7)) >= lookup.first_shared).all()
