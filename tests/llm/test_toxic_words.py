"""Words of few toxic documents."""

import numpy as np

from flipjoin.llm.toxicity_mil import train


def test_words_of_few_toxic_documents_count_in_any_sample():
    common, few, lone, clean = 1, 2, 3, 4
    for n in (300, 3000):  # a sentence a document: a tenth is toxic, three of these by a word of their own
        y = np.array([1] * (n // 10) + [0] * (n - n // 10))
        slot = np.array([few] * 3 + [lone] + [common] * (n // 10 - 4) + [clean] * (n - n // 10))
        weights = train(slot, np.arange(n), np.arange(n), y).weights
        assert weights[few] > 0 and weights[common] > weights[few]
        assert weights[lone] == weights[clean] == 0
