"""What a task of the language model holds does not grow beyond its bounds."""

import tracemalloc

import numpy as np

from flipjoin.llm.elias_fano import EliasFano
from flipjoin.llm.ngram_lm import HASHED, TOGETHER, token_hashes


def peak(work):
    work()  # what stays for the next call is not counted
    tracemalloc.start()
    work()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_coding_a_part():
    """A million successors: their unpacked low bits took 128 MB."""
    values = np.sort(np.random.default_rng(0).integers(0, 2**45, 1 << 20))
    assert peak(lambda: EliasFano.of(values)) < 64 << 20
    coded = EliasFano.of(values)
    assert (coded.access(np.arange(coded.n)) == values.astype(np.uint64)).all()


def test_hashing_a_group_of_texts():
    texts = [b"some words of a text and others " * 100] * (TOGETHER // 3200)
    assert peak(lambda: token_hashes(texts)) < 100 << 20


def test_tokens_do_not_depend_on_the_pieces():
    texts = [b"", b"Same words same", b"x " * HASHED, b" ", b"words x"]
    hashes, text = token_hashes(texts)
    one = [token_hashes([t])[0] for t in texts]
    assert (hashes == np.concatenate(one)).all()
    assert (text == np.repeat(np.arange(5), [len(h) for h in one])).all()
