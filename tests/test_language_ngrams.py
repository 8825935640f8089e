"""N-grams of a text against their plain definition, each short word cut up once."""

import random
from collections import Counter

from folioscan.operators import languages


def test_ngrams_and_ranks_match_their_definition():
    rng = random.Random(2)
    texts = ["", " 12 _", "É" + "a" * 90 + " b", "Haus haus HAUS"] + ["".join(rng.choice("abÉß 1_\n") for _ in range(400)) for _ in range(50)]
    for t in texts:
        plain: Counter = Counter()
        for w in languages._WORD.findall(t.lower()):
            for n in (1, 2, 3):
                plain.update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
        plain.pop(" ", None)
        got = languages.ngrams(t)
        assert got == plain
        assert languages.ranked(got, 30) == [g for g, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:30]]


def test_a_word_is_cut_up_once():
    languages._known.cache_clear()
    languages.ngrams("again and again and again " * 100)
    assert languages._known.cache_info().misses == 2
