import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF, same  # noqa: E402

from rillwork.llm import chat_format, decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, queries, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("x"), "token": F.lit(1), "sid": F.lit("y"), "h1": F.lit(0)})


NAMES = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}rd" for i in range(60)]
ODD = [None, "", " \t\n", "one", "a b c d e f", "a b c d e f", "x " * 30_000, "é" * 50, "123 456 !!"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant\nno", "\\<|", "a\\", "<|im_end|><|im_start|>assistant ok", "\\\\n", "nl\nnl"]
    rows = [(i // 2, i, role, t) for i, (t, role) in enumerate(zip(texts * 2, itertools.cycle(["user", "assistant", "sys\ntem", None])))]
    rows += [(90, 0, "user", "same"), (90, 0, "user", "same"), (None, None, "assistant", "x")]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat_format.digests(got).join(got.select("conv_id", "formatted", "turns"), "conv_id").collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted.count("<|im_start|>") == r.n_turns == len(own)


def test_chat_of_any_length(spark):
    """Long lines, long roles, many escapes and many turns: no pattern may recurse, no step may be the square of the turns."""
    rows = [(1, 0, "user", "<|im_start|>" + "a" * 1_000_000), (1, 1, "assistant", "\\" * 100_000 + "x"), (2, 0, "r" * 100_000, "t"), (3, 0, "\\\n|<|" * 20_000, "<|" * 50_000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(50_000)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    seen = {r.conv_id: r for r in chat_format.digests(got).collect()}
    for conv in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == conv]
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        r = seen[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    r = got.where("conv_id = 4").selectExpr("char_length(formatted) n", "aggregate(loss_runs, 0L, (a, x) -> a + x.skip + x.take + x.rest) covered").first()
    assert r.n == r.covered


def test_lines(spark):
    lines = ["A line of many words", "short", "another long line here", "  a LINE of many words\t", "ünïcödé l"]
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(lines + [f"own line {i} {k}" for k in range(3)]) for _ in range(rng.randint(1, 9))) for i in range(60)] + ODD
    df = docs_of(spark, texts).repartition(7)
    first = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            k = x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
            if len(k) >= 10:
                first.setdefault(k, i)
    out = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df), ["doc_id"])
    for r in out.collect():
        own = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in own if first.get(x.strip(" \t\n\x0b\x0c\r").encode().lower().decode(), r.doc_id) == r.doc_id]
        assert (r.kept_text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(own), len(own) - len(kept))
    assert line_dedup.keep_bitmaps(df.limit(0)).count() == 0


def test_rules_and_statistics(spark):
    r = quality_rules.apply_rules(docs_of(spark, [*ODD, "word " * 60, " ".join(["the", "of", *NAMES]), " ".join(f"{w}$$$" for w in NAMES) + " the of", " ".join(NAMES)])).orderBy("doc_id").collect()
    assert [x.base_failed for x in r[:4]] == [True] * 4
    assert r[6].n_repeat_words == 30_000 and r[9].base_failed
    assert r[10].kept and not r[11].kept and r[11].failed_rules == ["symbols"]
    assert r[12].failed_rules == ["stop_words"]  # prose has some


def brute(texts, p):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[k : k + p.shingle]) for k in range(len(w) - p.shingle + 1)] if len(w) >= p.shingle else [tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= p.percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = list(ODD)
    for size, length in ((70, 60), (30, 200)):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(length)] = rng.choice(words)
            texts.append(" ".join(t))
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 8, 60]))) for _ in range(40)]
    texts += [texts[20]] * 10
    p = ngram_join.JoinParams()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs_of(spark, texts).repartition(5), p).collect()}
    assert got == brute(texts, p)


def test_language_model(spark):
    model = language_id.Crf(["a", "b", "c"], np.zeros((1, 3)), np.random.default_rng(0).normal(size=(3, 3)), {})
    lengths, old = np.array([7, 1, 0, 4]), language_id.BLOCK
    scores = np.random.default_rng(1).normal(size=(12, 3))
    language_id.BLOCK = 3
    got, at = model.marginals(scores, lengths), 0
    language_id.BLOCK = old
    for n in lengths:
        total, z = np.zeros((n, 3)), 0
        for labels in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + i, k] for i, k in enumerate(labels)) + sum(model.move[a, b] for a, b in itertools.pairwise(labels)))
            z += w
            for i, k in enumerate(labels):
                total[i, k] += w
        assert np.allclose(got[at : at + n], total / z)
        at += n
    samples = [("en", "the of and that with they".split() * 9), ("de", "der die und nicht wird über".split() * 9)] * 20
    fitted = language_id.fit(samples)
    words = language_id.label_words(fitted, "the and they über wird nicht")
    assert [w[1] for w in words] == ["en"] * 3 + ["de"] * 3
    out = language_id.predict(docs_of(spark, ODD), fitted, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and out[8].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.fit([]).langs == []


def plain_language(model, text):
    """{language: mean probability over the words of a text}, by forward and backward sums over its whole chain."""
    words = [w for w in language_id.cut((text or "").split()) if any(map(str.isalpha, w))]
    if not words:
        return {}
    emit = model.word_scores(words)
    emit, move = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(model.move)
    ahead, back = [emit[0] / emit[0].sum()], [np.ones(len(model.langs))]
    for e in emit[1:]:
        x = (ahead[-1] @ move) * e
        ahead.append(x / x.sum())
    for e in emit[:0:-1]:
        x = move @ (e * back[-1])
        back.append(x / x.sum())
    m = np.array(ahead) * np.array(back[::-1])
    return dict(zip(model.langs, (m / m.sum(axis=1, keepdims=True)).mean(axis=0)))


def test_language_query_against_plain_chains(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(language_id.collect_samples(spark.read.parquet(f"{sf}/documents.parquet").where(fold != 1).select("text", "lang")))
    got = queries.op1_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got[:300]:
        want = plain_language(model, docs[r.doc_id].text)
        assert (r.lang_pred == "und" and r.score == 0) if not want else (r.lang_pred == max(want, key=want.get) and r.score == pytest.approx(max(want.values()), abs=1e-6))
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert language_id.predict(docs_of(spark, ["a"]).limit(0), model, ["doc_id"]).count() == 0


def test_samples_leave_no_language_out(spark):
    """Copies of a few texts, and a language that is nearly all of the table, whatever the seed."""
    few = spark.range(8000).select(F.when(F.col("id") < 4000, "en").otherwise("xx").alias("lang"), F.concat(F.lit("word"), F.col("id") % 2 + F.when(F.col("id") < 4000, 0).otherwise(5)).alias("text"))
    one = spark.range(20000).select(
        F.when(F.col("id") < 18000, "en").otherwise(F.concat(F.lit("l"), F.floor((F.col("id") - 18000) / 500))).alias("lang"), F.when(F.col("id") < 18000, "all alike here").otherwise(F.concat(F.lit("w"), "id")).alias("text")
    )
    for seed in (1, 5, 9):
        p = language_id.CrfParams(seed=seed)
        got = language_id.collect_samples(few, p)
        assert sorted(got) == [("en", ["word0"]), ("en", ["word1"]), ("xx", ["word5"]), ("xx", ["word6"])]
        got = [lang for lang, _ in language_id.collect_samples(one, p)]
        assert got.count("en") == 1 and all(100 < got.count(f"l{k}") < 260 for k in range(4))


def test_any_number_of_labels(spark):
    many = spark.range(1300).select(F.concat(F.lit("l"), F.col("id") % 1100).alias("lang"), F.concat(F.lit("some text "), "id").alias("text"))
    with pytest.warns(UserWarning, match="50 languages"):
        got = language_id.collect_samples(many, language_id.CrfParams(max_langs=50))
    assert {lang for lang, _ in got} == {f"l{k}" for k in sorted(range(200), key=lambda k: f"l{k}")[:50]}


def test_long_text_by_stretches(spark, monkeypatch):
    """A text labelled stretch by stretch has the same labels as in one piece."""
    rng = random.Random(2)
    en, de = "the of and that with they".split(), "der die und nicht wird 17 über".split()
    fitted = language_id.fit([("en", [rng.choice(en) for _ in range(40)]) for _ in range(20)] + [("de", [rng.choice(de) for _ in range(40)]) for _ in range(20)])
    runs = [[rng.choice(rng.choice([en, de, ["--"] * 9])) for _ in range(n)] for n in (700, 3, 90, 1500)]
    texts = [" ".join(r) + "\n" for r in runs] + ["--- " * 2000, None, ""]
    whole = language_id.predict(docs_of(spark, texts), fitted, ["doc_id"]).orderBy("doc_id").collect()
    for size in (60, 900, 1500):
        scores = language_id._Scores(fitted)
        for r, t in zip(whole[:4], texts[:4], strict=True):
            mass, n, moved = language_id._label_long(fitted, scores, t, size)
            assert fitted.langs[mass.argmax()] == r.lang_pred and mass.max() / n == pytest.approx(r.score, abs=1e-9) and moved == r.n_switches
        assert language_id._label_long(fitted, scores, texts[4], size)[1] == 0


def test_language_of_long_words(spark):
    rng = random.Random(6)
    shared, zh, ja = "一二三四五六七八九十百千万", "我你他的是在有这中国", "のはをにがでとますした"
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    fitted = language_id.fit([("zh", [run(shared, 13) + run(zh, 80)]) for _ in range(60)] + [("ja", [run(shared, 13) + run(ja, 80)]) for _ in range(60)])
    texts = [run(shared, 13) + run(letters, 100) for letters in (zh, ja) * 10] + [run(zh, 64) + run(ja, 200)]
    out = language_id.predict(docs_of(spark, texts), fitted, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["zh", "ja"] * 10 + ["ja"]
    assert out[-1].n_switches == 1
    assert "".join(w for w, _, _ in language_id.label_words(fitted, texts[-1])) == texts[-1]
    word = "unterwasser" * 4 + "ung"
    assert language_id.features([word], {})[0].tolist() != language_id.features([word[:-1] + "d"], {})[0].tolist()
    # every gram of a long word stands in one of its pieces
    whole, parts = run("abcdefgh", 333), lambda x: {x[i : i + k] for k in (2, 3, 4) for i in range(len(x) - k + 1)}
    assert parts(f"^{whole}$".encode()) == set().union(*[parts(language_id._edged(x)) for x in language_id.cut([whole])])


def held_out(spark, name, label):
    out = queries.queries()[name](spark, "/root/testdata/sf0.01").where("held_out")
    return out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label), "doc_id").toPandas()


def test_quality_held_out(spark):
    x = held_out(spark, "op7_quality_classifier", "quality")
    assert (x.predicted == x.quality).mean() > 0.95


def test_toxicity_catches_its_words(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(120)).split()

    def toxic():
        w = plain()
        for _ in range(6):
            w[rng.randrange(len(w))] = rng.choice(["moronic", "scumbag", "worthless"])
        return w

    data = [(" ".join(toxic()), 1) for _ in range(150)] + [(" ".join(plain()), 0) for _ in range(150)]
    model = toxicity.fit([(t, y, 1.0) for t, y in data])
    fresh = [" ".join(toxic()) for _ in range(20)] + [" ".join(plain()) for _ in range(20)] + ODD
    got = [r.score for r in toxicity.score(docs_of(spark, fresh), model, ["doc_id"]).orderBy("doc_id").collect()]
    assert sum(s >= 0.5 for s in got[:20]) >= 18 and sum(s >= 0.5 for s in got[20:40]) <= 2
    assert all(0 <= s <= 1 for s in got)


def test_toxicity_knows_capitals_and_phrases():
    rng = random.Random(3)
    plain = lambda: [rng.choice(NAMES) for _ in range(120)]

    def toxic(phrases):
        w = plain()
        for _ in range(6):
            w[rng.randrange(len(w))] = rng.choice(phrases)
        return w

    def caught(model, texts):
        z = [toxicity.features(toxicity.margins(t, *model.compressors(), model.p), model.thresholds) @ model.weights[:-1] + model.weights[-1] for t in texts]
        return sum(x >= 0 for x in z)

    data = [(" ".join(toxic(["moronic", "scumbag", "worthless"])), 1, 1.0) for _ in range(100)] + [(" ".join(plain()), 0, 1.0) for _ in range(100)]
    fresh = [" ".join(toxic(["moronic", "scumbag", "worthless"])) for _ in range(20)]
    assert caught(toxicity.fit(data), [t.replace(w, w.upper()) for w in ("moronic",) for t in fresh]) >= 18
    assert caught(toxicity.fit(data), [t.upper() for t in fresh]) >= 18
    # words that are ordinary apart, toxic together
    marks = toxicity._marks(["get lost now"] * 50, ["get now", "lost now"] * 50)
    assert "get lost" in marks
    assert toxicity._excess(["get lost, now get out"], ["get lost"]) == [b" get lost"]
    assert "git" in toxicity._marks(["a git now"] * 50, ["a now"] * 50)
    assert toxicity._excess(["gits and a git"], ["git"]) == [b" git git"]


def test_toxicity_of_one_class():
    for label in (0, 1):
        model = toxicity.fit([("some text", label, 1.0)] * 9)
        z = toxicity.features(toxicity.margins("other text", *model.compressors(), model.p), model.thresholds) @ model.weights[:-1] + model.weights[-1]
        assert (z >= 0) == (label == 1)
    # both known, one of them missing in the half that calibrates: the commoner one
    counts = {1: 2.0, 0: 40.0}
    made = toxicity._calibrate(toxicity.fit([]), [(toxicity.histogram(np.array([0]), toxicity.ToxicParams()), 0)] * 5, {0: 5, 1: 1}, counts)
    assert made.weights[-1] < 0 and toxicity.fit([]).weights[-1] < 0


def test_toxicity_calibrates_on_whole_texts(spark):
    rng = random.Random(8)
    p = toxicity.ToxicParams(max_chars=300)
    plain = lambda n: [rng.choice(NAMES) for _ in range(n)]
    texts = [" ".join(plain(100) + (["moronic", "scumbag"] * 4 if i % 2 else [])) for i in range(120)]
    docs = docs_of(spark, texts)
    model = toxicity.fit_tables(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) label"), p)
    # the words stand behind the first 300 characters: passages hold few of them, whole texts all
    two = model.compressors()
    halves = [r.h for r in docs.selectExpr(f"pmod(xxhash64(text, {p.seed}), 2) h").collect()]
    calm = np.concatenate([toxicity.margins(t, *two, p) for i, (t, h) in enumerate(zip(texts, halves, strict=True)) if h == 1 and i % 2 == 0])
    assert model.thresholds == [max(i, float(np.quantile(calm, q, method="lower"))) for i, q in ((1.0, 0.95), (2.0, 0.99), (3.0, 0.999))]
    assert sum(toxicity.histogram(calm, p)) == len(calm)


def learned(pages):
    total = Counter()
    for x in pages:
        total.update(html_extract.count(x))
    return html_extract.learn(total)


def test_pages():
    page = "<html><head><title>T</title></head><body><nav><a href=1>Home</a></nav><div class='site-banner'>Buy now</div><article><h1>Head &amp; tail</h1><p>One <b>two</b>three\n four.<p>Five<aside>no</aside> six</article><section id=comments><p>me too</p></section><footer>end</footer>"
    scores = learned([page] * 20)
    want = "Head & tail One twothree four. Five six"
    assert html_extract.extract(page, scores) == want
    assert html_extract.extract(page.replace("article", "div"), scores) == want
    assert [html_extract.extract(x, scores) for x in (None, "", "<p>", "<", "<a", "<a b='", "<!--", "</p>")] == ["", "", "", "<", "", "", "", ""]


def test_pages_with_lists_and_links():
    menu = "<nav><ul>" + "<li><a href=x>Some menu entry</a></li>" * 30 + "</ul></nav>"
    page = f"<html><body>{menu}<article><p>" + "word " * 40 + f"</article><footer>{menu}</footer></body></html>"
    scores = learned([page] * 50)
    body = "<p>" + "first " * 20 + "<p>see <a href=y>this page</a> for more.<ul>" + "<li>one of six" * 6 + "</ul><p>The last words stand here, after all."
    got = html_extract.extract(f"<html><body>{menu}<article>{body}</article><footer>{menu}</footer></body></html>", scores)
    assert got == "first " * 20 + "see this page for more." + " one of six" * 6 + " The last words stand here, after all."


@pytest.mark.parametrize("names", ["layout with-sidebar", "content has-comments", "menu-closed page", "sidebar", "main no-ads"])
def test_pages_in_wrappers(names):
    inner = "<p>" + "word " * 30 + "</p>"
    scores = learned([f"<html><body><nav>menu</nav><article>{inner}</article></body></html>"] * 30)
    for tag in ("article", "main"):
        assert html_extract.extract(f"<body><div class='{names}'><nav>menu</nav><{tag}>{inner}</{tag}></div></body>", scores) == ("word " * 30).strip()
    if names != "sidebar":  # without an article element, a layout's name still marks nothing
        assert html_extract.extract(f"<body><div class='{names}'>{inner}</div></body>", scores) == ("word " * 30).strip()


def test_labels_overrule_names():
    """A name that labelled pages have around main text marks nothing; one that they have around other text does."""
    page = "<body><div class=notice><article><p>" + "word " * 20 + "</p></article></div><div class=zzz>other words</div></body>"
    got = learned([page] * 200)
    assert got.share("notice") > html_extract.APART > got.share("zzz")
    assert html_extract.extract("<body><article><div class=notice>kept words here</div><div class=zzz>gone</div></article>", got) == "kept words here"
    assert all(x > 0 for x in got.words.values()) and all(x < 0 for x in got.tags.values())


def test_pages_left_open():
    scores = learned([])
    text = "<article><p>" + "word " * 20
    assert html_extract.extract(text + "<script>var x = 1; if (a < b) c();", scores) == ("word " * 20).strip()
    assert html_extract.extract(text + "<style>p { color: red }", scores) == ("word " * 20).strip()
    for bad in ("<svg>", "<script>", "<a title='", "<nav>", "<!--", "</div>", "<p class=\"", "<"):
        began = time.time()
        html_extract.extract(bad * 40_000, scores)
        assert time.time() - began < 5, bad


def test_pages_in_one_form_and_empty_comments():
    scores, body = learned([]), "<p>" + "word " * 30 + "</p>"
    assert html_extract.extract(f"<body><form action=x><nav>menu entry</nav>{body}</form><footer>end</footer></body>", scores) == ("word " * 30).strip()
    assert html_extract.extract(f"<body>{body}<form><p>your name please</p></form></body>", scores) == ("word " * 30).strip()
    for comment in ("<!-->", "<!--->", "<!---->", "<!-- > -->"):
        assert html_extract.extract(f"<body>{comment}{body}</body>", scores) == ("word " * 30).strip()


def test_chapters_whatever_their_names_say():
    """A chapter of an article is no search box; comments, lists of links and boxes to fill in are not chapters."""
    prose = "<h2>Title here</h2><p>" + "word " * 30 + "</p><p>" + "more " * 30 + "</p>"
    page = "<html><body><nav><a href=1>Home</a></nav><article><p>" + "first " * 40 + "</p>{}<p>" + "last " * 40 + "</p></article><footer>end</footer></body></html>"
    scores = learned([page.format("")] * 60)
    for name in ("search", "related-work", "form-and-function", "promotion"):
        got = html_extract.extract(page.format(f"<section id='{name}'>{prose}</section>"), scores).split()
        assert [got.count(w) for w in ("first", "word", "more", "last", "Home", "end")] == [40, 30, 30, 40, 0, 0], name
    for inner in (f"<section id=comments>{prose}</section>", "<section class=related>" + "<p><a href=x>some other page</a></p>" * 20 + "</section>", f"<section class=newsletter>{prose}<form><input name=a></form></section>", f"<div class=notice>{prose}</div>", f"<aside>{prose}</aside>"):
        got = html_extract.extract(page.format(inner), scores).split()
        assert [got.count(w) for w in ("first", "word", "other", "last")] == [40, 0, 0, 40], inner[:40]
    table = "<table>" + "<tr><td>one</td><td>two</td><td>three</td></tr>" * 60 + "</table>"
    got = html_extract.extract(page.format(table), scores).split()
    assert [got.count(w) for w in ("first", "two", "last")] == [40, 60, 40]


def test_labels_other_than_two(spark):
    docs = docs_of(spark, ["some words of a text"] * 12)
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 3, 2).when(F.col("doc_id") < 6, -1).when(F.col("doc_id") < 9, 1).otherwise(0).alias("label"))
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels), ["doc_id"])
    assert all(0 <= r.score <= 1 for r in out.collect())
    only = quality_classifier.fit(docs, labels.where("label in (2, -1)"))
    assert only.rules == [] and only.intercept == 0


def test_benchmarks_without_blanks_are_joined(spark, monkeypatch):
    """Words joined by commas, and one endless word, count as what they are: no such benchmark is collected."""
    docs, called = docs_of(spark, ["a b c d e f"]), []
    joined = decontaminate._joined
    monkeypatch.setattr(decontaminate, "_joined", lambda *a: called.append(1) or joined(*a))
    for text in (",".join(f"w{i}" for i in range(3000)), "x" * 60_000):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert decontaminate.find_leaks(docs, items, max_local_words=2500).count() == 0
    assert len(called) == 2


def test_best_run_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        values = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        sums = {(i, k): sum(values[i:k]) for i in range(len(values)) for k in range(i + 1, len(values) + 1)}
        i, k = html_extract.best_run(values)
        assert sum(values[i:k]) == max([0, *sums.values()])


def test_page_query(spark):
    """Every page of the table, against the article element read by an HTML parser."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in html_extract.INLINE:
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag not in html_extract.INLINE:
                self.out.append(" ")

        def handle_data(self, data):
            if self.depth:
                self.out.append(data)

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        reader = Reader()
        reader.feed(r.html or "")
        want = " ".join("".join(reader.out).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(1, "u", None, 5), (1, "u", "", 5), (None, None, "<p>x", 5)], "page_id long, url string, html string, text long")
    assert sorted(r.text for r in html_extract.extract_pages(odd).collect()) == ["", "", "x"]
    assert html_extract.extract_pages(odd.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (6, 15, 30, 57)]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(5000)) + " " + x.upper() + " " + " ".join(rng.choice(words) for _ in range(9)) for x in items), items[3][: len(items[3]) // 2]]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    df = docs_of(spark, texts)
    want = {(len(ODD) + i, i) for i in range(4)}
    for limit in (10**6, 0):  # sent to tasks, and joined
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, max_local_words=limit).collect()} == want
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_leaks_both_ways_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(500)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 7, 20, 60, 300])))) for i in range(30)] + [(30, None), (31, ""), (7, " ".join(some(40)))]
    docs = [(i, " ".join(some(rng.choice([0, 40, 900])))) for i in range(25)]
    for i, (_, text) in enumerate(x for x in items if x[1]):
        w = text.split()
        for share in (1.0, 0.9, 0.7):
            part = w[: max(1, int(len(w) * share))]
            docs.append((100 + i, " ".join(some(50) + part + some(rng.choice([0, 2000])))))
    half = items[5][1].split()
    docs += [(1, " ".join(half[: len(half) * 54 // 100])), (1, " ".join(half[len(half) * 46 // 100 :])), (1, " ".join(half[: len(half) * 54 // 100])), (None, items[3][1]), (900, None)]
    want = set()
    for d, text in docs:
        own = shingles(text)
        for i, t in items:
            x = shingles(t)
            if d is not None and x and len(own & x) >= 0.8 * len(x) - 1e-9:
                want.add((d, i, len(x), len(own & x)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(tuple(r) for r in decontaminate.find_leaks(df, bench, max_local_words=limit).collect()) for limit in (10**6, 0)]
    assert got[0] == got[1]  # whatever the size: the same pairs, each once
    assert set(got[0]) <= want
    sure = {x for x in want if x[3] == x[2]}
    assert sure <= set(got[0]) and len(set(got[0])) >= 0.97 * len(want)


def test_mixture(spark):
    rows = [(i, "w " * 10, "big" if i < 300 else "small" if i < 350 else None, 1) for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mix(df, mixing.MixParams(block_tokens=100)).toPandas()
    assert set(out.doc_id) == set(range(360))
    drawn = out.groupby(out.source.fillna("none")).n_tokens.sum()
    weight = out.groupby(out.source.fillna("none")).weight.first()
    assert weight.sum() == pytest.approx(1)
    assert np.allclose(drawn / drawn.sum(), weight, atol=0.01)
    natural, equal = -sum(s * np.log(s) for s in (30 / 36, 5 / 36, 1 / 36)), np.log(3)
    limited = mixing.mix(df, mixing.MixParams(max_repeats=100.0, block_tokens=100)).toPandas()
    w = limited.groupby(limited.source.fillna("none")).weight.first()
    assert -(w * np.log(w)).sum() == pytest.approx(natural + 0.5 * (equal - natural), abs=1e-3)
    assert out.groupby("doc_id").size().max() <= 4
    assert mixing.mix(df.limit(0)).count() == 0


def brute_mix(rows, p):
    """Temperature mixing in plain Python: the exponent by fine bisection, budgets, and which documents of an epoch may be drawn."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").encode().split())
    tokens = {s: t for s, t in tokens.items() if t}
    total = sum(tokens.values())

    def at(e):
        u = {s: (t / total) ** e for s, t in tokens.items()}
        z = sum(u.values())
        return {s: x / z for s, x in u.items()}

    entropy = lambda w: -sum(x * np.log(x) for x in w.values())
    budget = lambda w: p.budget_tokens / total if p.budget_tokens else max(t / total / w[s] for s, t in tokens.items())
    target = entropy(at(1)) + p.entropy_share * (entropy(at(0)) - entropy(at(1)))
    ok = lambda w: entropy(w) <= target + 1e-9 and max(budget(w) * w[s] * total / t for s, t in tokens.items()) <= p.max_repeats + 1e-9
    low, high = 0.0, 1.0
    if ok(at(0.0)):
        high = 0.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (low, mid) if ok(at(mid)) else (mid, high)
    w = at(high)
    return w, {s: x * budget(w) * total for s, x in w.items()}, tokens


def test_mixture_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["a", "a", "a", "a", "b", None, "c"])) for i in range(500)]
    rows += [(500, None, "b"), (501, "", "empty"), (7, "w w w", "a"), (7, "w w w", "a"), (502, "w " * 30, "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"epoch": F.lit(5), "weight": F.lit("x"), "tokens": F.lit(1)})
    for p in (mixing.MixParams(block_tokens=60, shelf_blocks=4), mixing.MixParams(block_tokens=60, budget_tokens=9000, max_repeats=30.0), mixing.MixParams(entropy_share=0.0, block_tokens=10**6)):
        weights, budgets, tokens = brute_mix(rows, p)
        got = mixing.mix(df, p).toPandas()
        for source, w in weights.items():
            own = got[got.source.isna()] if source is None else got[got.source == source]
            assert own.weight.iloc[0] == pytest.approx(w, abs=1e-4)
            # the budget is met to within the last document, and all passes but the last are whole
            assert budgets[source] - 0.01 * budgets[source] - 1 <= own.n_tokens.sum() <= budgets[source] * 1.01 + 41
            texts = Counter((d, len((t or "").split())) for d, t, s in rows if s == source)
            last = own.epoch.max()
            for epoch in range(last):
                assert Counter(zip(own.doc_id[own.epoch == epoch], own.n_tokens[own.epoch == epoch])) == texts
            assert not Counter(zip(own.doc_id[own.epoch == last], own.n_tokens[own.epoch == last])) - texts
            # the tokens before a document are what lies before it by position
            x = own.sort_values(["position", "n_tokens"])
            assert np.allclose((x.n_tokens.cumsum() - x.n_tokens).to_numpy(), (x.position * budgets[source]).to_numpy(), atol=1 + 0.01 * budgets[source])
        assert (got[got.source == "empty"].weight == 0).all() and (got.source == "empty").sum() == 1
    with pytest.raises(ValueError, match="max_repeats"):
        mixing.mix(df, mixing.MixParams(budget_tokens=20 * sum(tokens.values())))


def test_pipeline_stages(spark):
    """Every stage's rows on all that the stage before kept, against plain Python."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language_id.fit(language_id.collect_samples(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("text", "lang")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            spoken = lambda t: [x for x in ({"und": 0.0} | plain_language(model, t)).values()]
            assert set(got) == {i for i, r in rows.items() if max(spoken(r.text)) >= corpus_pipeline.LEAST_SCORE}
            assert all(got[i] == rows[i] for i in got)
        if name == "line_dedup":
            first, want = {}, {}
            key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
            for i in sorted(rows):
                for x in (rows[i].text or "").split("\n"):
                    if len(key(x)) >= 10:
                        first.setdefault(key(x), i)
            for i, r in rows.items():
                want[i] = "\n".join(x for x in (r.text or "").split("\n") if first.get(key(x), i) == i)
            assert {i: (r.text, r.n_chars) for i, r in got.items()} == {i: (t, len(t)) for i, t in want.items()}
        if name == "ngram_jaccard_join":
            want = brute([rows[i].text if i in rows else None for i in range(max(rows) + 1)], ngram_join.JoinParams(shingle=5, percent=80))
            assert set(got) == {i for i in rows if want[i][1] == i}
        if name == "decontamination":
            leaks = {i for i, r in rows.items() if (own := shingles(r.text)) and any(x and len(own & x) >= 0.8 * len(x) for x in items)}
            assert set(got) == set(rows) - leaks
        rows = got
        docs = spark.createDataFrame(list(got.values()), docs.schema)
    drawn = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    _, budgets, tokens = brute_mix([(r.doc_id, r.text, r.source) for r in rows.values()], mixing.MixParams())
    assert {r.doc_id for r in drawn} == set(rows)
    for source, budget in budgets.items():
        assert abs(sum(r.n_tokens for r in drawn if r.source == source) - budget) <= 0.01 * budget + max(len((r.text or "").split()) for r in rows.values())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    long = "der die und das " * 40_000
    texts = [(1, "a line that stands twice\nown words of one"), (2, "a line that stands twice\nsome other words"), (3, None), (4, ""), (5, "word " * 9), (5, "quite other words that no other text has got at all"), (6, "word " * 9), (6, "word " * 9), (None, "the of and"), (7, long), (8, "12 34")]
    names = ["n_lines", "n_dropped", "kept_text", "lang_pred", "score", "item_id", "sid", "weight", "h1"]
    rows = [(i, t, "en", None if k % 2 else "s", len(t or ""), *range(len(names))) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"{c} long" for c in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        kept[name] = [(r.doc_id, getattr(r, "text", None)) for r in out.collect()]
        assert stage(spark, df.limit(0), SF).count() == 0
        if name != "mixing":
            assert out.columns == df.columns
            assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect())
    assert sorted(kept["line_dedup"], key=str) == sorted([(i, {2: "some other words", 6: ""}.get(i, t or "")) for i, t in texts], key=str)
    assert sorted(kept["ngram_jaccard_join"], key=str) == sorted([x for x in texts if x[0] != 6], key=str)
    assert {i for i, _ in kept["language_id"]}.isdisjoint({3, 4, 8})
    assert len(kept["decontamination"]) == len(texts)
    assert Counter(i for i, _ in kept["mixing"])[6] >= 2


def test_classifier_rules():
    text = "Tree 0 (weight 1.0):\n  If (feature 0 <= 0.5)\n   Predict: 1.0\n  Else (feature 0 > 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n"
    assert quality_classifier.rules_of(text, ["a", "b"]) == {(("a", "<=", 0.5),), (("a", ">", 0.5),), (("a", ">", 0.5), ("b", "<=", 2.0)), (("a", ">", 0.5), ("b", ">", 2.0))}


def test_classifier_against_its_trees(spark):
    """Rules as columns say what a walk down the tree says, and the score is the logistic sum of the rules that hold."""
    rng = random.Random(5)
    rule = quality_classifier.compiled
    walk = {(("a", "<=", 0.5),): lambda a, b: a <= 0.5, (("a", ">", 0.5), ("b", "<=", 2.0)): lambda a, b: a > 0.5 and b <= 2.0, (("a", ">", 0.5), ("b", ">", 2.0)): lambda a, b: a > 0.5 and b > 2.0}
    data = [(rng.choice([0.0, 0.5, 0.6, 3.0]), rng.choice([1.0, 2.0, 2.5])) for _ in range(50)]
    df = spark.createDataFrame(data, "a double, b double")
    model = quality_classifier.RuleModel([(r, w) for r, w in zip(walk, (1.5, -2.0, 0.25))], -0.5)
    for r in df.select("a", "b", *[rule(x).alias(f"r{i}") for i, x in enumerate(walk)], model.probability().alias("p")).collect():
        holds = [float(f(r.a, r.b)) for f in walk.values()]
        assert [r.r0, r.r1, r.r2] == holds
        assert r.p == pytest.approx(1 / (1 + np.exp(0.5 - sum(w * h for w, h in zip((1.5, -2.0, 0.25), holds)))))


def test_classifier_on_odd_rows(spark):
    texts = [*ODD, "word " * 200_000]
    docs = docs_of(spark, texts)
    none = docs.selectExpr("doc_id", "cast(null as int) label").limit(0)
    for labels, want in ((none, 0.5), (docs.selectExpr("doc_id", "1 label"), None), (docs.selectExpr("doc_id", "cast(doc_id % 2 as int) label"), None)):
        model = quality_classifier.fit(docs, labels, quality_classifier.RuleParams(trees=2))
        got = quality_classifier.score(docs, model, ["doc_id"]).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
        assert want is None or all(r.score == want for r in got)
        assert quality_classifier.score(docs.limit(0), model, ["doc_id"]).count() == 0
        assert got[4].score == got[5].score  # repeated rows


def test_toxicity_query(spark):
    """The registered query against plain scoring of every whole text with the same model, and its held-out catch."""
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit_tables(queries.table(spark, sf, "documents"), queries._labels(spark, sf, "toxic"))
    two = model.compressors()
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    toxic = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op10_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        z = float(toxicity.features(toxicity.margins(texts[r.doc_id], *two, model.p), model.thresholds) @ model.weights[:-1] + model.weights[-1])
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    known = [r for r in got if toxic.get(r.doc_id) is not None]
    assert sum(r.predicted == toxic[r.doc_id] for r in known) >= 0.9 * len(known)  # some labels are wrong by themselves
    assert toxicity.score(docs_of(spark, ["a"]).limit(0), model, ["doc_id"]).count() == 0
