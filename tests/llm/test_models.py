"""Operators 9 and 6: held-out accuracy, gradients and odd rows."""

import random
import zlib

import numpy as np
import pytest
from cases import ODD, clashing, documents

from helixframe.llm import lang_fusion as L
from helixframe.llm import toxic_gru as T

STEMS = {"en": ["the", "wh", "ing", "tion", "and", "er"], "de": ["der", "sch", "ung", "ß", "ein", "ö"],
         "fr": ["eau", "é", "que", "aux", "oi", "le"]}


def text_in(lang, r, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    r = random.Random(1)
    truth, rows = {}, list(ODD)
    for i in range(100, 700):
        lang = r.choice(list(STEMS))
        truth[i] = lang
        declared = r.choice([lang] * 17 + ["en", "de", None])            # one in ten or so is wrong or missing
        rows.append((i, text_in(lang, r, r.randint(3, 60)), declared, f"{lang}.host.{r.choice(['net', 'de'])}", 1))
    rows += [(1000, "12 34 !!", "en", "en.host.net", 1), (1001, "漢字 漢字 " * 20, None, None, 1)]
    got = {x["doc_id"]: x for x in L.identify(clashing(documents(spark, rows)), languages=["de", "en", "fr"]).collect()}
    assert sum(got[i]["language"] == t and got[i]["kept"] for i, t in truth.items()) >= 0.99 * len(truth)
    for i in (1, 2, 3, 1000, 1001):
        assert not got[i]["kept"] and got[i]["language"] == L.UND
    assert len(L.identify(documents(spark, rows), languages=["de", "en", "fr"]).collect()) == len(rows)
    assert L.identify(documents(spark, rows).limit(0)).count() == 0
    picky = L.identify(documents(spark, rows), languages=["de", "en", "fr"], accept=["de"]).filter("kept")
    assert {x["language"] for x in picky.collect()} == {"de"}


def test_evidence_decides_where_the_text_is_thin(spark):
    """Equal texts: the declared language, then the host's prior, decides."""
    r = random.Random(2)
    rows = [(i, text_in(lang, r, 40), lang, f"{lang}.net", 1) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(900, "a", "de", None, 1), (901, "a", "en", None, 1), (902, "a", None, "de.net", 1), (903, "a", None, "en.net", 1)]
    got = {x["doc_id"]: x["language"] for x in L.identify(documents(spark, rows)).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == ["de", "en", "de", "en"]


def test_languages_that_few_rows_declare(spark):
    """A model needs so many grams, not a share of the rows; below that the
    declared language itself decides."""
    r = random.Random(5)
    rows = [(i, text_in("en", r, 12), "en", "a.net", 1) for i in range(12_000)]
    rows += [(20_000 + i, text_in("de", r, 200), "de", "a.net", 1) for i in range(9)]
    rows += [(20_100, text_in("de", r, 60), None, "b.net", 1), (20_101, text_in("en", r, 60), "xx", "b.net", 1)]
    rows += [(20_200 + i, "漢字仮名 交じり文 " * (3 + i), "ja", "c.net", 1) for i in range(3)]
    rows += [(20_300, "ﷺﷻꙮꙮ ꙮ" * 9, None, "a.net", 1), (20_301, "", "ja", "c.net", 1)]
    got = {x["doc_id"]: x for x in L.identify(documents(spark, rows)).filter("doc_id >= 20000").collect()}
    for i, lang in [*[(20_000 + k, "de") for k in range(9)], (20_100, "de"), (20_101, "en"), *[(20_200 + k, "ja") for k in range(3)]]:
        assert (got[i]["language"], got[i]["kept"]) == (lang, True), i
    assert not got[20_300]["kept"] and not got[20_301]["kept"]


def test_priors_are_smoothed_towards_the_parent(spark):
    rows = ([("a.x.net", "en")] * 50 + [("b.x.net", "de")] + [("c.y.net", "de")] * 50 + [(None, "en")])
    df = spark.createDataFrame(rows, "host string, heard string")
    priors, shares = L.host_priors(df, ["de", "en"], 10.0)
    got = {x["host"]: x["prior"] for x in priors.collect()}
    assert abs(sum(shares) - 1) < 1e-9 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())
    up = [(1 + 10 * shares[0]) / 61, (50 + 10 * shares[1]) / 61]
    assert np.allclose(got["b.x.net"], [(1 + 10 * up[0]) / 11, 10 * up[1] / 11])
    assert got["b.x.net"][1] > 0.5 > got["c.y.net"][1]


def test_gradients():
    net, r = T.Network.new(1), np.random.default_rng(0)
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    x, label, weight = r.normal(0, 1, (3, T.SPAN, T.DIM)), np.array([1, 0, 1.0]), np.ones(3)
    real = np.ones((3, T.SPAN), bool)
    real[0, :5] = real[1, -9:] = real[2, :T.CONTEXT] = False          # spans at the ends of their texts

    def loss():
        gates = [g * real.reshape(-1, 1) for g in net.gates(x.reshape(-1, T.DIM))]
        logit = net.traced(gates, np.arange(3 * T.SPAN).reshape(3, -1))[0].astype("f8")
        return np.mean(np.log1p(np.exp(-logit * (2 * label - 1))))
    grads, d_x = net.gradient(x, real, label, weight)
    for table, g in [*((net.w[k], g) for k, g in grads.items()), (x, d_x)]:
        at = tuple(n // 2 for n in table.shape)
        table[at] += 1e-2
        up = loss()
        table[at] -= 2e-2
        slope = (up - loss()) / 2e-2
        table[at] += 1e-2
        assert abs(slope - g[at]) < 2e-4
    assert not d_x[~real].any()


def step(net, d, h, x):
    """One word of one direction, as the textbook writes a gated unit."""
    a, hu = x @ net.w[f"in_{d}"] + net.w[f"b_{d}"], h @ net.w[f"rec_{d}"]
    r, z = (1 / (1 + np.exp(-(a[i:i + T.HIDDEN] + hu[i:i + T.HIDDEN]))) for i in (0, T.HIDDEN))
    new = np.tanh(a[2 * T.HIDDEN:] + r * hu[2 * T.HIDDEN:])
    return (1 - z) * new + z * h


def plain_logit(net, text):
    """The highest of all windows, word by word and window by window."""
    words = T.words_of(text)
    if not words:
        return net.empty_logit()
    x = np.array([net.vectors([w])[0] for w in words], "f8")
    states = np.zeros((len(words), 2 * T.HIDDEN))
    for low in range(0, len(words), T.WINDOW):
        high = min(low + T.WINDOW, len(words))
        h = np.zeros(T.HIDDEN)
        for t in range(max(0, low - T.CONTEXT), high):
            h = step(net, "f", h, x[t])
            if t >= low:
                states[t, :T.HIDDEN] = h
        h = np.zeros(T.HIDDEN)
        for t in range(min(len(words), low + T.WINDOW + T.CONTEXT) - 1, low - 1, -1):
            h = step(net, "b", h, x[t])
            if t < high:
                states[t, T.HIDDEN:] = h
    scores = []
    for s in range(max(1, len(words) - T.WINDOW + 1)):
        own = states[s:s + T.WINDOW]
        e = np.exp(np.tanh(own @ net.w["att"] + net.w["att_b"]) @ net.w["att_v"])
        scores.append((e / e.sum()) @ own @ net.w["out"] + net.w["out_b"][0])
    return max(scores)


def test_every_window_is_scored(monkeypatch):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(n))
             for n in (0, 1, 2, 15, 16, 31, 32, 33, 47, 48, 49, 63, 64, 65, 96, 97, 300, 1000)]
    net = T.Network.new(2)
    net.w = {k: v * 3 for k, v in net.w.items()}
    net.w["out_b"] += 0.3
    want = [plain_logit(net, t) for t in texts]
    assert np.allclose(T.Scorer(net).logits(texts), want, atol=1e-4)
    for words in (100, 150, 400):               # runs of 64, 64 and 192 words of a text
        monkeypatch.setattr(T, "TABLE_WORDS", words)
        assert np.allclose(T.Scorer(net).logits(texts), want, atol=1e-4)
    monkeypatch.setattr(T, "_STEP", 3)
    assert np.allclose(T.Scorer(net).logits(texts), want, atol=1e-4)


def test_training_windows_are_scored_windows():
    """A window cut out with its context where blocks begin has the score that the blocks give it."""
    net, r = T.Network.new(5), np.random.default_rng(1)
    gates = T.with_none(net.gates(r.normal(0, 1, (99, T.DIM)).astype("f4")))
    rows = r.integers(1, 100, 5 * T.WINDOW)
    spans = T.blocks(rows, len(rows))
    share, value = net.run(gates, spans)
    got = T.window_means(share.ravel(), value.ravel())[::T.WINDOW] + net.w["out_b"][0]
    assert np.abs(got - net.traced(gates, spans)[0]).max() < 1e-4
    best, at = net.highest(gates, np.concatenate([spans, spans[:1]]), [len(rows), 7])
    assert best[0] >= got.max() - 1e-6 and 0 <= at[0] <= len(rows) - T.WINDOW and at[1] == 0


def toxic_rows(n, r):
    bad = [f"vile{s}" for s in ("a", "ing", "ness", "ly", "ous", "ish", "er", "est")]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(33, 160))]
        label = int(r.random() < 0.35)
        for _ in range(label * r.randint(1, 4)):
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, label))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = toxic_rows(900, random.Random(3))
    odd = [(i if i is None else 10_000 + i, *rest) for i, *rest in ODD]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    out = T.toxicity(clashing(documents(spark, rows + odd)), lab, per_class=(400, 250), epochs=12).collect()
    return labels, out


def test_held_out_accuracy(scored):
    labels, out = scored
    truth = {i: y for i, _, y in labels}
    held = [x for x in out if x["held_out"] and x["doc_id"] in truth]
    assert {x["doc_id"] for x in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.93 * len(held)


def test_odd_rows_are_scored(scored):
    labels, out = scored
    assert len(out) == len(labels) + len(ODD)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out)
    none = {x["score"] for x in out if x["doc_id"] in (10_001, 10_002, 10_003)}
    assert len(none) == 1 and none.pop() < 0.5


def test_one_label_only_and_empty_tables(spark):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = T.toxicity(documents(spark), lab).collect()
    assert len(got) == len(ODD) and len({x["score"] for x in got}) == 1
    assert T.toxicity(documents(spark).limit(0), lab.limit(0)).count() == 0


def test_tables_dealt_anew_change_no_score(monkeypatch):
    rows, _ = toxic_rows(40, random.Random(4))
    texts = [t for _, t, *_ in rows] + ["short one", "", " ".join(f"w{i}" for i in range(1000))]
    net = T.Network.new(3)
    want = T.Scorer(net).scores(texts)
    monkeypatch.setattr(T, "TABLE_WORDS", 400)
    assert np.allclose(T.Scorer(net).scores(texts), want, atol=1e-5)


def test_query_equals_plain_scores(spark):
    """The registered path against a sample, windows and line to the label worked out plainly."""
    rows, labels = toxic_rows(120, random.Random(8))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = documents(spark, rows)
    got = {x["doc_id"]: x["score"] for x in T.toxicity(df, lab, per_class=(60, 30), epochs=3).collect()}
    learn = [(i, t, y) for (i, t, *_), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    order = {x[0]: x[1] for x in df.selectExpr("doc_id", "xxhash64(string(doc_id))").collect()}
    picked = [d for label, n in ((0, 60), (1, 30))
              for d in sorted(sorted((d for d in learn if d[2] == label), key=lambda d: (order[d[0]], d[0]))[:n])]
    toxic = sum(y for _, _, y in learn)
    net = T.train([t for _, t, _ in picked], [y for *_, y in picked], 3, (toxic + 1) / (len(learn) + 2))
    want = {i: 1 / (1 + np.exp(-(net.slope * plain_logit(net, t) + net.offset))) for i, t, *_ in rows}
    assert all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_a_passage_is_found_wherever_it_begins():
    """The highest window does not depend on where a text's blocks begin."""
    rows, labels = toxic_rows(500, random.Random(3))
    texts = [t for _, t, *_ in rows]
    net = T.train(texts, [y for *_, y in labels], 12)
    r = random.Random(12)
    bad = "vilea vileing vileness"
    made = []
    for shift in range(0, 64, 3):
        words = [f"w{r.randrange(3000)}" for _ in range(400)]
        made += [" ".join(words), " ".join([*words[:100 + shift], bad, *words[100 + shift:]])]
    scores = np.array(T.Scorer(net).scores(made)).reshape(-1, 2)
    assert (scores[:, 1] > scores[:, 0]).mean() == 1 and (scores[:, 1] >= 0.5).mean() >= 0.9
