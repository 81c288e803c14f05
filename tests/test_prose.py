"""References in prose: random pieces, applied twice."""

import random

import pytest

from tessera.operators import prose

PAPERS, CLUSTERS = {1: "Smith 2020", 2: "Lee 2021", 3: "Ray 2022"}, {0: "Graphs", 3: "Vision"}


@pytest.mark.parametrize("seed", range(200))
def test_twice_is_once(seed):
    r = random.Random(seed)
    words = ["P1", "P2", "P3", "P99", "C0", "C9", "cluster-3", "cluster", "on", "GPUs", "and", "the", "'s", "P3.16", "C4-based"]
    marks = [" ", " ", " ", ", ", "; ", " (", ") ", "-", ". ", "/", " & ", "\n"]
    text = "".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(1, 12)))
    once = prose.rewrite_refs(text, PAPERS, CLUSTERS, 2)
    again = prose.rewrite_refs(once, PAPERS, CLUSTERS, 2)
    assert again == once
    assert "()" not in once and (once == text or not once.endswith(" "))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(P99), and more.", "And more."),
        ("Both [P1, P99] and C0's.", "Both [Smith 2020] and Graphs's."),
        ("P1-P3, and C3", "Smith 2020, Lee 2021, Ray 2022, and Vision"),
        ("P3 GPUs and C4-based P3.16", "P3 GPUs and C4-based P3.16"),
        ("(P1;\nP2)", "(Smith 2020; Lee 2021)"),
    ],
)
def test_shapes(text, want):
    assert prose.rewrite_refs(text, PAPERS, CLUSTERS) == want
