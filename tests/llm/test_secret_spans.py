"""Tagged spans beside base ones: the same as by comparing all with all, in a time that grows with the text."""

import random
import time

from transitmill.llm import secrets


def test_free_spans_are_those_that_overlap_no_base_span(monkeypatch):
    rng = random.Random(6)
    for _ in range(300):
        spans = lambda n, kind: [(a, a + rng.randint(1, 6), kind) for a in (rng.randrange(40) for _ in range(n))]
        base, tagged = spans(rng.randrange(6), "hex"), spans(rng.randrange(6), "crf")
        monkeypatch.setattr(secrets, "base_spans", lambda text, base=base: list(base))
        monkeypatch.setattr(secrets, "crf_spans", lambda model, text, tagged=tagged: list(tagged))
        want = [s for s in tagged if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
        assert secrets.scan(None, "x") == (base, secrets.ordered(base + want))


def test_many_spans_take_a_time_in_proportion(monkeypatch):
    n = 200_000
    monkeypatch.setattr(secrets, "base_spans", lambda text: [(10 * i, 10 * i + 4, "hex") for i in range(n)])
    monkeypatch.setattr(secrets, "crf_spans", lambda model, text: [(10 * i + 3 + i % 3, 10 * i + 9, "crf") for i in range(n)])
    began = time.process_time()
    base, every = secrets.scan(None, "x")
    assert time.process_time() - began < 20
    assert len(every) == n + sum(i % 3 > 0 for i in range(n))
