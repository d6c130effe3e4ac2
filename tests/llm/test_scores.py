import random

import numpy as np
import pytest
from relift.llm import langid, quality, toxicity
from relift.llm.linear import BUCKETS, fit

from .conftest import frame, prose


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(20, 60))
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            text += " " + rng.choice(["you idiot", "such a clown", "total scum"])
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def accuracy(df, labels, column):
    truth = {i: (q, t)[column] for i, q, t in labels}
    rows = [r for r in df.collect() if r.held_out]
    assert rows and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return np.mean([r.predicted == truth[r.doc_id] for r in rows])


def test_learnt(spark, labelled):
    rows, labels = labelled
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert accuracy(quality.quality(docs, known), labels, 0) > 0.95
    assert accuracy(toxicity.toxicity(docs, known), labels, 1) > 0.95
    kept = {r.doc_id for r in toxicity.without_toxic(docs, known).collect()}
    assert kept == {i for i, _, t in labels if not t}
    assert toxicity.without_toxic(docs, known).schema == docs.schema


def test_held_out_labels_do_not_matter(spark, labelled):
    import zlib

    rows, labels = labelled
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: (r.held_out, r.score) for r in quality.quality(docs, x).collect()} for x in (known, turned))
    assert a == b and {i for i, (h, _) in a.items() if h} == {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_documents(spark, odd, odd_docs, no_docs, run):
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10, 40)] + [(None, 1, 1), (11, None, None), (11, 1, 1)], "doc_id long, quality int, toxic int")
    rows = run(odd_docs, known).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert run(no_docs, known).count() == 0
    none = known.where("doc_id < 0")
    assert len({r.score for r in run(odd_docs, none).collect()}) == 1


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 5]), np.array([2, 5]), np.array([1, 6]), np.array([2, 6]), np.array([], int)]
    model = fit([r.astype(np.int32) for r in rows], [1, 0, 1, 0, 0])
    assert (model.score(rows)[:4] >= 0.5).tolist() == [True, False, True, False] and model.weight.shape == (BUCKETS,)


def brute(restorer, token):
    """The cheapest reading over all paths of the lattice, one by one."""
    best = []

    def walk(at, a, b, last, cost, out):
        if at == len(token):
            best.append((cost + restorer.cost[a][b][0], out))
            return
        c = token[at]
        if last and (c == last or last in toxicity.LEET.get(c, "")):
            walk(at + 1, a, b, last, cost + toxicity.DROP_REPEAT, out)
        elif c in toxicity.SEPARATORS:
            walk(at + 1, a, b, last, cost + toxicity.DROP_SEPARATOR, out)
        for x, channel in [(x, toxicity.READ) for x in toxicity.LEET.get(c, "")] + [(c, 0.0 if c.isalpha() else toxicity.KEEP_SIGN)]:
            s = toxicity.SYMBOL.get(x, 1 if x.isalpha() else 0)
            walk(at + 1, b, s, x, cost + channel + restorer.cost[a][b][s], out + x)

    walk(0, 0, 0, "", 0.0, "")
    return min(best)[1]


def test_restored(spark):
    text = "the idiot clown is a stupid moron and pathetic trash scum loser disgusting worthless " * 20
    counts = toxicity.trigram_counts(frame(spark, [(1, text), (2, None), (3, "")]))
    assert counts.sum() > len(text)
    restorer = toxicity.Restorer(toxicity.costs(counts))
    for hidden, plain in {"1d10t": "idiot", "i d i o t!": "idiot!", "stuuuupid": "stupid", "$cum": "scum", "l0$er": "loser", "m.o.r.o.n": "moron", "p@thetic": "pathetic", "w0rthle$$": "worthless", "i d 1 0 t": "idiot"}.items():
        assert restorer.text(hidden) == plain
    for token in ("1d1ot", "cl0wwn", "tr*sh", "s-c-u-m", "b@@d", "3x1"):
        assert restorer.decode(token) == brute(restorer, token), token
    for same in ("a plain text, with signs!", "the%%% end***", "", "İ", "12 34"):
        assert restorer.text(same) == same.lower()


@pytest.fixture(scope="module")
def restorer(spark):
    text = "the idiot clown is a stupid moron and pathetic trash scum loser disgusting worthless good " * 20
    return toxicity.Restorer(toxicity.costs(toxicity.trigram_counts(frame(spark, [(1, text)]))))


def test_doubled_letters_and_signs_at_a_words_end(restorer):
    for hidden, plain in {"stuupid": "stupid", "morron": "moron", "a iidiot, so": "a idiot, so", "idio7": "idiot", "idio+": "idiot", "the good worthless": "the good worthless", "gooood": "good"}.items():
        assert restorer.text(hidden) == plain
    rng = random.Random(14)
    for _ in range(300):
        token = "".join(c * rng.choice([1, 1, 2, 2, 4]) for c in rng.choice(["idiot", "stupid", "worthless", "good", "zebra", "aab"]))
        assert restorer.text(token) == restorer.decode(token), token


def test_long_tokens(restorer):
    assert restorer.text("$ttt" + 40 * "u" + "pid") == restorer.text("sttt" + 5000 * "u" + "pid") == "stupid"
    assert restorer.text("1d10t" + 40 * "!" + "s") != "1d10t" + 40 * "!" + "s"


def test_words_end_inside_chains(restorer):
    for hidden, plain in {"a s t u p i d": "a stupid", "i d i o t s c u m": "idiot scum", "l.0.s.e.r.m.o.r.o.n": "loser moron", "s t u p i d": "stupid", "$tupid-m0ron": "stupid moron"}.items():
        assert restorer.text(hidden) == plain


def test_languages(spark, odd, odd_docs, no_docs):
    rng = random.Random(3)
    make = {"aa": lambda: " ".join(rng.choices("bana kola tima rova".split(), k=30)), "bb": lambda: " ".join(rng.choices("sprüx greft knorz wölk".split(), k=30)), "ru": lambda: " ".join(rng.choices("привет мир дом вода".split(), k=30))}
    rows = [(i, k, make[k]()) for i, k in enumerate(list(make) * 40)]
    docs = spark.createDataFrame([(i, t, k, 1.0) for i, k, t in rows] + [(900, None, "aa", 1.0), (901, "12 !", "bb", 1.0), (902, "", None, 1.0), (None, "bana", None, 1.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.language(docs).collect()}
    assert all(got[i].lang_pred == k for i, k, _ in rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    model = langid.train(docs)
    mixed = frame(spark, [(1, "bana kola tima rova bana, greft knorz wölk sprüx greft! привет мир"), (2, None)])
    spans = [(r.doc_id, r.lang, r.words) for r in langid.label_spans(mixed, model).orderBy("doc_id", "start").collect()]
    assert spans == [(1, "aa", 5), (1, "bb", 5), (1, "ru", 2), (2, None, 0)]
    assert len(langid.identify(odd_docs, model).collect()) == len(odd)
    assert langid.language(no_docs).count() == 0 and {r.lang_pred for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.ones((len(langid.SCRIPTS), 3), bool), switch=1.5)
    texts = [" ".join(prose(random.Random(i), n).split()) for i, n in enumerate((1, 40, 7, 0, 100))] + [None]
    w, s = model.scored(texts)
    got = model.label(w, s, len(texts))
    for i in range(len(texts)):
        own = s[w.owner == i].astype(float)
        if not len(own):
            continue
        best, back = own[0], []
        for x in own[1:]:
            step = best[:, None] - 1.5 * (1 - np.eye(3))
            back.append(step.argmax(0))
            best = step.max(0) + x
        label = [int(best.argmax())]
        for b in reversed(back):
            label.append(int(b[label[-1]]))
        assert got[w.owner == i].tolist() == label[::-1]


def test_letters_of_all_planes_and_case_by_code_point(spark):
    rng = random.Random(15)
    turkish = lambda: " ".join(rng.choices("istanbul güzel bir şehir İzmir".split(), k=20))
    other = lambda: " ".join(rng.choices("lorem ipsum dolor amet".split(), k=20))
    rows = [(i, turkish() if i % 2 else other(), "tr" if i % 2 else "la", 1.0) for i in range(60)]
    rows += [(900, "😀😀 123", None, 1.0), (901, "𝟙𝟚𝟛 ٣", None, 1.0), (902, "İSTANBUL GÜZEL BİR ŞEHİR", None, 1.0), (903, "𠀀𠀁", None, 1.0)]
    got = {r.doc_id: r for r in langid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "tr") and got[903].lang_pred != "und"
    a, b = langid.words(["İstanbul GÜZEL BİR"]), langid.words(["istanbul güzel bir"])
    assert (a.grams == b.grams).all() and langid.SCRIPTS[langid.words(["𠀀"]).script[0]] == "han"


def test_two_hundred_languages():
    rng = np.random.default_rng(1)
    model = langid.Model([f"l{i:03}" for i in range(200)], rng.normal(size=(langid.BUCKETS, 200)).astype(np.float32), np.ones((len(langid.SCRIPTS), 200), bool))
    w, s = model.scored(["one word or two", "another text", None])
    for k in (5, 130, 199):
        s[:] = -5.0
        s[:, k] = 0.0
        assert set(model.label(w, s, 3).tolist()) == {k}


def plain_label(model, text):
    """Words by script ranges, scores word by word, Viterbi without arrays over texts; (language, score) of the whole."""
    words, now = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            now += c.lower()[0]
        elif now:
            words.append(now)
            now = ""
    if not words:
        return "und"
    score = []
    for word in words:
        ends = [int(langid.words([word]).grams[k]) for k in range(len(word) + 1)]
        own = sum(model.cost[g].astype(float) for g in ends)
        own = np.maximum(own - own.max(), -langid.WORD_CAP)
        code = ord(word[0])
        script = [name for first, name in langid.RANGES if first <= code][-1]
        score.append(np.where(model.allowed[langid.SCRIPTS.index(script)], own, -1e4))
    paths = {k: (score[0][k], [k]) for k in range(len(model.langs))}
    for own in score[1:]:
        paths = {k: max(((c - model.switch * (j != k) + own[k], [*p, k]) for j, (c, p) in paths.items()), key=lambda x: x[0]) for k in paths}
    label = max(paths.values(), key=lambda x: x[0])[1]
    size = [sum(len(w) for w, x in zip(words, label, strict=True) if x == k) for k in range(len(model.langs))]
    return model.langs[int(np.argmax(size))]


def test_languages_equal_plain_labels(spark):
    rng = random.Random(16)
    make = {"aa": "bana kola tima rova".split(), "bb": "sprüx greft knorz wölk".split(), "ru": "привет мир дом вода".split(), "uk": "привіт світ дім їжа".split()}
    docs = spark.createDataFrame([(i, " ".join(rng.choices(make[k], k=25)), k) for i, k in enumerate(list(make) * 20)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    texts = [" ".join(w for _ in range(rng.randint(1, 4)) for w in rng.choices(make[rng.choice(list(make))], k=rng.randint(1, 9))) for _ in range(60)] + ["", None, "12 ?", "xyz", "мирbana"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, list(enumerate(texts))), model).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_label(model, t) for t in texts]


def plain_fit(rows, labels):
    """Log-count ratios by counting, and the hinge loss's dual by projected steps over the whole matrix."""
    n, features = len(rows), sorted({int(f) for r in rows for f in r})
    count = {f: [1 + sum(f in set(r.tolist()) for r, y in zip(rows, labels, strict=True) if y == k) for k in (0, 1)] for f in features}
    many = [sum(y == k for y in labels) + 2 for k in (0, 1)]
    ratio = {f: np.log(count[f][1] / many[1]) - np.log(count[f][0] / many[0]) for f in features}
    x = np.array([[ratio[f] if f in set(r.tolist()) else 0.0 for f in features] for r in rows])
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.hstack([np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), np.ones((n, 1))])
    sign = np.where(np.array(labels) == 1, 1.0, -1.0)
    top = np.array([n / (2 * sum(z == y for z in labels)) for y in labels])
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, top)
    return ratio, x @ (x.T @ (alpha * sign))


def test_fit_equals_plain_fit():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(np.int32) for _ in range(60)]
    labels = [int(len(set(r.tolist()) & set(range(12))) > 2) for r in rows]
    model, (ratio, margin) = fit(rows, labels, rounds=3000), plain_fit(rows, labels)
    assert all(abs(model.ratio[f] - r) < 1e-5 for f, r in ratio.items())
    assert np.abs(model.margin(rows) - margin).max() < 0.02


def test_hidden_words_of_other_forms(restorer):
    for hidden, plain in {"i  d  i  o  t": "idiot", "і1diоt": "idiot", "ѕtupid": "stupid", "“1d10t”—good": "“idiot”—good", "w0rthle$$ scum": "worthless scum", "m___o___r___o___n": "moron"}.items():
        assert restorer.text(hidden) == plain, hidden
    for same in ("это слово", "a - b - c", "I, a", "naïve — “quoted”", "1  2  3", "日本語 テスト"):
        assert restorer.text(same) == same.lower()


def test_filter_on_odd_documents(spark, odd, odd_docs, no_docs):
    known = spark.createDataFrame([(i, int(i % 9 == 0), int(i % 9 == 0)) for i in range(10, 60)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(odd_docs, known)
    assert kept.schema == odd_docs.schema and {400, 401, 402} <= {r.doc_id for r in kept.collect()}
    assert toxicity.without_toxic(no_docs, known).count() == 0
    assert toxicity.without_toxic(odd_docs, known.where("doc_id < 0")).count() == len(odd)


def test_spans_of_no_documents(spark, no_docs, odd_docs):
    model = langid.Model(["a"], np.zeros((langid.BUCKETS, 1), np.float32), np.ones((len(langid.SCRIPTS), 1), bool))
    assert langid.label_spans(no_docs, model).count() == 0 and langid.label_spans(odd_docs, model).count() > 0
