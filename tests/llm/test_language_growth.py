"""The language model's vocabulary follows its training tokens."""

import math

import numpy as np
import pytest

from tidecube.llm import language_model


def test_size_grows_with_tokens_up_to_the_lookup(monkeypatch):
    sizes = [language_model.vocabulary_size(10**p) for p in range(16)]
    assert sizes == sorted(sizes) and sizes[0] == 64 * 64 and sizes[10] > 4 * sizes[7] and sizes[-1] == language_model.LOOKUP
    assert all(math.isqrt(s) ** 2 == s for s in sizes)
    monkeypatch.setattr(language_model, "LOOKUP", 40)
    assert language_model.vocabulary_size(10**15) == 64 * 64


def test_more_outputs_score_later_words_better():
    """Words of 300 kinds, the next one mostly told by the last: with outputs of their own they are told by the words before them."""
    rng, size, word, run = np.random.default_rng(1), 40_000, 0, []
    for step in rng.integers(0, 3, size).tolist():
        word = (word * 7 + step) % 300
        run.append(word)
    hashes, score = np.array(run, np.uint64) + np.uint64(1), {}
    words, counts = np.unique(hashes[:-2000], return_counts=True)
    for outputs in (16, 400):
        vocabulary = language_model.Vocabulary(words.view(np.int64), counts.astype(np.int64), size - 2000, len(words), outputs)
        model, (out, count) = language_model.LogBilinear(vocabulary.known), vocabulary.find(hashes)
        context = language_model._contexts(out, np.array([size]), outputs)
        for at in range(0, size - 2000, 1000):
            model.learn(context[:, at : at + 1000], out[at : at + 1000])
        shared = np.where(out == vocabulary.unknown, np.log10((count + 0.5) / vocabulary.unknown_mass), 0.0)
        score[outputs] = (model.log10(context, out) + shared)[-2000:].mean()
    assert score[400] > score[16] + 0.1


def test_other_sizes_are_normalised_too():
    size = 70 * 70
    model = language_model.LogBilinear(np.arange(size)[::-1].astype(float))
    rng = np.random.default_rng(3)
    context = rng.integers(0, size + 1, (language_model.CONTEXT, 1)).repeat(size, axis=1)
    model.learn(context[:, :64], rng.integers(0, size, 64))
    assert (10.0 ** model.log10(context, np.arange(size))).sum() == pytest.approx(1, abs=1e-4)
