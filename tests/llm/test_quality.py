"""The statistics of quality read whole texts."""

import random

from emberlake.llm import quality


def test_distinct_words_of_all_windows():
    rng = random.Random(1)
    for n, width in ((0, 5), (3, 5), (5, 5), (6, 5), (40, 5), (300, 7)):
        words = [rng.choice("abcdefgh") for _ in range(n)]
        shares = [(len(set(words[k : k + width])) + 1) / (len(words[k : k + width]) + 1) for k in range(max(1, n - width + 1))]
        assert abs(quality.distinct_share(words, width) - sum(shares) / len(shares)) < 1e-12


def test_repetition_behind_the_first_200_words_counts():
    varied = " ".join(f"w{k}" for k in range(400))
    at = quality.STATISTICS.index("distinct_of_200")
    front, back = quality.statistics("again " * 400 + varied)[at], quality.statistics(varied + " again" * 400)[at]
    assert abs(front - back) < 1e-9 and 0.3 < back < 0.7
