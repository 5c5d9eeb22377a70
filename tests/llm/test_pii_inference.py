"""Inference of the skip-chain field against exact enumeration, and what it finds whatever the corpus."""

import itertools
import random

import numpy as np

from ledgerloom.llm import pii

SHAPES = ("n10:3:3-3-4", "handle", "n16:4:4-4-4:sum")


def exact(nodes, potentials):
    chain, skip = pii.edges_of(nodes)
    unary = [potentials.unary.get(n[3], potentials.unseen) for n in nodes]
    total = np.zeros((len(nodes), pii.NONE + 1))
    for labels in itertools.product(*([n[2]] if n[2] != pii.NONE else range(pii.NONE + 1) for n in nodes)):
        z = sum(u[k] for u, k, n in zip(unary, labels, nodes, strict=True) if n[2] == pii.NONE)
        z += sum(potentials.pair[w][labels[i], labels[j]] for w, edges in (("chain", chain), ("skip", skip)) for i, j in edges)
        for i, k in enumerate(labels):
            total[i, k] += np.exp(z)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_against_enumeration():
    r = random.Random(8)
    counts = [("unary", s, k, r.random() * 50) for s in SHAPES for k in range(pii.NONE + 1)] + [("chain", str(a), b, r.random() * 9) for a in range(5) for b in range(5)]
    potentials = pii.Potentials([*counts, ("skip", "3", 3, 40.0), ("skip", "0", 0, 5.0), ("skip", "0", 3, 1.0)])
    for _ in range(60):
        at, nodes = 0, []
        for _ in range(r.randint(1, 5)):
            at += r.choice([5, 500])
            nodes.append((at, at + 4, r.choice([0, 3, pii.NONE, pii.NONE, pii.NONE]), r.choice(SHAPES), [r.choice("kl")] if r.random() < 0.8 else []))
            at += 4
        got, want = pii.beliefs(nodes, potentials), exact(nodes, potentials)
        chain, skip = pii.edges_of(nodes)
        forest = len({*chain, *skip}) == len(chain) + len(skip) and len(chain) + len(skip) < len(nodes) and _acyclic(len(nodes), [*chain, *skip])
        # Belief propagation is exact on trees, and close on small loops.
        assert np.abs(got - want).max() < (0.01 if forest else 0.15)


def _acyclic(n, edges):
    label = list(range(n))
    for i, j in edges:
        if label[i] == label[j]:
            return False
        label = [label[i] if x == label[j] else x for x in label]
    return True


def spans_of(text, others):
    """The spans of text in a corpus of it and the others."""
    counts = pii.Counter()
    for t in (text, *others):
        counts.update(pii._counts(pii.nodes_of(t, pii.base_spans(t))))
    potentials = pii.Potentials([(*k, n) for k, n in counts.items()])
    base = pii.base_spans(text)
    return pii._said(base + pii._added(pii.nodes_of(text, base), potentials))


def test_the_same_spans_in_a_corpus_of_any_size():
    text = "call +1 (988) 555-2485 now, or 988 555-2485 later; mail bob.42@mail.example.com, bob.42 said"
    said = [f"call +1 (988) 555-{i % 10_000:04d} today, else 988 555-{i % 10_000:04d} at night" for i in range(5000)]
    alone = spans_of(text, [])
    assert "phone:31:43" in alone and "email:81:87" in alone
    for n in (1, 10, 5000):
        assert spans_of(text, said[:n]) == alone
    # Numbers that no base span vouches for stay out, however often they are said.
    assert spans_of("order 988 555-2485 and 988 555-2485", said) == ""


def test_all_of_many_repeats_are_found():
    text = "call +1 (988) 555-2485 now" + ", or 988 555-2485" * 50
    got = spans_of(text, [f"call +1 (988) 555-{i:04d} now" for i in range(20)])
    assert got.count("phone:") == 51


def test_planted_repeats_are_found_and_decoys_left():
    r = random.Random(4)
    texts, planted, decoys = [], [], []
    for i in range(400):
        n = f"{r.randint(200, 999)}", f"{r.randint(200, 999)}", f"{r.randint(0, 9999):04d}"
        text = f"number +1 ({n[0]}) {n[1]}-{n[2]} of today. " + "word " * r.randint(0, 300)
        planted.append((i, len(text)))
        texts.append(f"{text}{n[0]} {n[1]}-{n[2]} again, order {r.randint(10**7, 10**8)} and {r.randint(10**7, 10**8)}")
        decoys.append(texts[-1].rindex("order"))
    counts = pii.Counter()
    for t in texts:
        counts.update(pii._counts(pii.nodes_of(t, pii.base_spans(t))))
    potentials = pii.Potentials([(*k, n) for k, n in counts.items()])
    found = [pii._added(pii.nodes_of(t, pii.base_spans(t)), potentials) for t in texts]
    assert sum(any(s == at for s, _, _ in found[i]) for i, at in planted) >= 0.9 * len(planted)
    assert not any(s >= at for f, at in zip(found, decoys, strict=True) for s, _, _ in f)


def test_a_text_of_very_many_numbers():
    text = "; ".join(f"555 {i:07d}" for i in range(60_000))
    nodes = pii.nodes_of(text, [])
    assert len(nodes) == 60_000 and pii._added(nodes, pii.Potentials([])) == []
