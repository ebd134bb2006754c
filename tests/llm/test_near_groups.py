"""A large group of near copies that do not link to one original: few candidates become rows, and no link is lost."""

import random

from test_llm import brute, docs_of

from rillwork.llm import ngram_join


def test_candidates_grow_with_the_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    tried, plain = [], ngram_join._linked

    def counted(pairs, *more):
        tried.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(400):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(t))
    p = ngram_join.JoinParams()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs_of(spark, texts).repartition(5), p).collect()}
    assert got == brute(texts, p)
    assert tried[1] < len(texts)  # candidates of the sets that the first round left apart
