"""The label model against brute force, and what the classifier learns of noisy labels."""

import itertools

import numpy as np

from quillspark.llm import toxicity


def onehot(votes):
    return np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)


def test_belief_is_the_product_over_voters():
    rng = np.random.default_rng(4)
    votes = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    parent = np.array([0, 0, 1])
    tables = rng.random((3, 2, 3, 3)) + 0.1
    tables /= tables.sum(axis=2, keepdims=True)
    got = toxicity.belief(onehot(votes), parent, tables, 0.3)
    for row, p in zip(votes, got):
        odds = 0.3 / 0.7
        for j, v in enumerate(row):
            if v:  # a silent voter says nothing
                odds *= tables[j, 1, v + 1, row[parent[j]] + 1] / tables[j, 0, v + 1, row[parent[j]] + 1]
        assert abs(p - odds / (1 + odds)) < 1e-12


def test_conditional_tables_are_weighted_counts():
    rng = np.random.default_rng(5)
    votes, post = rng.integers(-1, 2, (40, 3)), rng.random(40)
    parent = np.array([0, 0, 2])
    got = toxicity.conditional(onehot(votes), post, parent, strength=2.0)
    for j, y, a in itertools.product(range(3), range(2), range(3)):
        weight = post if y else 1 - post
        share = lambda v, j=j, weight=weight: weight[votes[:, j] == v - 1].sum() + 0.5
        single = share(a) / sum(share(v) for v in range(3))
        for b in range(3):
            both = lambda v, j=j, b=b, weight=weight: weight[(votes[:, j] == v - 1) & (votes[:, parent[j]] == b - 1)].sum()
            want = (both(a) + 2.0 * single) / (sum(both(v) for v in range(3)) + 2.0) if parent[j] != j else single
            assert abs(got[j, y, a, b] - want) < 1e-12


def test_repeated_voters_count_once():
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.4
    voter = lambda right: np.where(rng.random(3000) < right, y, ~y) * 2 - 1
    good, poor = voter(0.9), voter(0.6)
    votes = np.stack([good, voter(0.85), *[poor] * 6], axis=1)
    parent = toxicity.dependencies(onehot(votes), y.astype(float), np.zeros(8, bool))
    assert {len({j, p} & {0, 1}) for j, p in enumerate(parent) if p != j} == {0} and (parent[2:] == np.arange(2, 8)).sum() == 1
    post, _, _ = toxicity.label_model(votes, 0.4)
    assert ((post > 0.5) == y).mean() > 0.88  # six copies of one poor voter would outvote both others
    assert toxicity.dependencies(onehot(votes), y.astype(float), np.ones(8, bool)).tolist() == list(range(8))


def test_posteriors_mend_noisy_labels():
    """One label in seven is wrong; voters on two insults a text tell which."""
    rng = np.random.default_rng(7)
    y = rng.random(1500) < 0.3
    said = y ^ (rng.random(1500) < 0.15)
    counts = np.where(y[:, None], rng.poisson(1.2, (1500, 4)), rng.random((1500, 4)) < 0.01).astype(np.int32)
    examples = [toxicity.Example(int(s), 60, c, np.zeros(2, np.int8)) for s, c in zip(said, counts)]
    names = ["aaaa", "bbbb", "cccc", "dddd"]

    def right(by):
        model = toxicity.fit(examples, names, names, by=by)
        scores = np.array([model.score(" ".join(w for w, k in zip(names, c) for _ in range(k)) + " x" * (60 - int(c.sum())), {}) for c in counts])
        return ((scores > 0.5) == y).mean()

    assert right("posterior") >= right("labels") and right("posterior") > 0.95
