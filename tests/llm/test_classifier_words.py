"""The classifier reads a word without making its terms, and finds what they would."""

import random

from mosaiq.llm import quality_classifier


def test_words_are_read_without_their_terms(monkeypatch):
    terms = quality_classifier.TOXIC | {"abc*", "abcdef*", "crét*", "zzz"}
    rng = random.Random(5)
    words = ["Idiot!", "a-idiot", "CRÉTIN", "crét", "crétins", "abc", "ABCD,", "x_abcd", "-abcd", "abcdefg", "zzz.", "zzzz", "Ordure?!", "ordure�", ""]
    words += ["".join(rng.choices("abcdefzé_-,!1 ".replace(" ", ""), k=rng.randint(1, 9))) for _ in range(3000)]
    words += [w[:3] + "".join(rng.choices("defgé-.", k=rng.randint(0, 4))) for w in ["abc", "zzz", "cré"] for _ in range(50)]
    wanted = [not terms.isdisjoint(quality_classifier.terms_in(w)) for w in words]
    assert 20 < sum(wanted) < len(words)

    def none(word):
        raise AssertionError("a word's terms were made")

    monkeypatch.setattr(quality_classifier, "terms_in", none)
    memo = quality_classifier.word_reader(terms)
    assert [bool(memo[w.encode()] & quality_classifier.IS_TOXIC) for w in words] == wanted
