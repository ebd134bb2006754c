"""Many documents that have little but a few common lines in common: they do not meet in blocks, and no link is lost."""

import random

from test_llm import brute, docs_of

from rillwork.llm import ngram_join


def test_common_lines_bring_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    met, plain = [], ngram_join._within_clusters

    def counted(hot, *more):
        met.append(hot.select("sid").distinct().count())
        return plain(hot, *more)

    monkeypatch.setattr(ngram_join, "_within_clusters", counted)
    rng = random.Random(9)
    lines, texts = [" ".join(f"c{k}w{i}" for i in range(12)) for k in range(4)], []
    for i in range(500):
        own = [f"x{i}y{j}" for j in range(20)]
        texts.append("\n".join([rng.choice(lines), " ".join(own), rng.choice(lines)]))
        if i % 10 == 0:  # a copy with one word more, which links
            texts.append(texts[-1] + f" z{i}")
        if i % 50 == 0:  # another end, which does not
            texts.append("\n".join([texts[-1].split("\n")[0], " ".join(own), *rng.sample(lines, 2)]))
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    p = ngram_join.JoinParams()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs_of(spark, texts).repartition(5), p).collect()}
    assert got == brute(texts, p)
    assert met[0] < 60  # of more than 500
