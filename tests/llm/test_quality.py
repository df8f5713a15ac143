import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import language, quality_model, quality_rules
from tests.llm.conftest import prose


def plain_repeat(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_repeat_words():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 25))]
        assert quality_rules.repeat_words(words) == plain_repeat(words)


def test_long_texts_count_alike():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 50, 400):
        text = "  ".join(rng.choice(["a", "B", "b", "é\x85x", "日本", "c\n", "\td"]) for _ in range(n))
        words = text.encode().split()
        assert quality_rules.long_counts(text) == (len(words), quality_rules.repeat_words(words)), text


def test_ends_of_other_scripts():
    for line in ("これは文です。", "यह एक वाक्य है।", "هل هذا سؤال؟"):
        assert quality_rules.line_fault(line, 5, quality_rules.Rules()) is None


def test_rules_odd_rows(odd, empty):
    got = quality_rules.clean_lines(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[3]["n_words"] == 1 and by[3]["word_chars"] == 300_000
    assert quality_rules.clean_lines(empty).collect() == []


def test_lines():
    rules = quality_rules.Rules()
    good = "\n".join(prose(random.Random(i), 30) + "." for i in range(4))
    assert quality_rules.judge(good, rules)[6]
    r = quality_rules.judge(good + "\nAll rights reserved.\nHome | About | Contact", rules)
    assert r[6] and r[8] == {"boilerplate": 1, "punctuation": 1} and r[9] == good
    assert quality_rules.line_fault("Home | About | Contact.", 5, rules) == "navigation"
    assert quality_rules.line_fault("All rights reserved.", 3, rules) == "boilerplate"
    assert not quality_rules.judge("\n".join(["WORD!! THING!! OTHER!! MORE!!"] * 3 + ["A | b | c | d"] * 30), rules)[6]


def test_quality_model(spark, odd, empty):
    rng = random.Random(3)
    texts = [(i, prose(rng, 120), 1) if i % 2 else (i, " ".join(w.upper() + "!!" for w in prose(rng, 100).split()), 0) for i in range(240)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    net = quality_model.fit(docs.where("doc_id < 160"), labels)
    got = {r[0]: r[1] for r in quality_model.score(docs.where("doc_id >= 160"), net).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in texts if i >= 160]) > 0.97
    rows = quality_model.score(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r[1] <= 1 for r in rows)
    # the input's own score column stays what it was
    kept = quality_model.accepted(odd, net, 0.5)
    assert kept.columns == odd.columns
    score = {(r[0], r[1]) for r in rows}
    want = Counter(tuple(r) for r in odd.collect() if any(i == r["doc_id"] and p >= 0.5 for i, p in score) or False)
    got = Counter(tuple(r) for r in kept.collect())
    assert all(n <= want[r] for r, n in got.items()) and sum(got.values()) == sum(p >= 0.5 for _, p in map(tuple, rows))
    few = quality_model.fit(docs, labels, train_passages=40)
    assert few.constant is None  # both classes are there
    # one labelled text is too long to be learned from: the others are
    long = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.repeat("text", 200)).otherwise(F.col("text")))
    assert quality_model.fit(long, labels, train_passages=150).constant is None
    assert quality_model.score(empty, net).collect() == []
    none = quality_model.fit(docs, labels.where("quality = 7"))
    assert {r[1] for r in quality_model.score(docs, none).collect()} == {0.5}


def plain_score(net, text):
    """The network's score of one text, passage by passage and number by number."""
    size = quality_model.PASSAGE
    hs, es = [], []
    for i in range(0, max(1, len(text)), size):
        part, more = text[i : i + size], text[i : i + size + 3] + bytes(3)
        x = np.zeros(quality_model.N_FEATURES)
        for j, b in enumerate(part):
            x[quality_model.CLASS_OF[b]] += 1 / len(part)
            c = more[j + 1]
            x[quality_model.CLASSES + (b * 37 + c * 101 + (b ^ c)) % quality_model.PAIRS] += 1 / len(part)
        k = quality_model.CLASSES + quality_model.PAIRS
        fours = {((int.from_bytes(more[j : j + 4], "little") * 2654435761) >> 16) % quality_model.OCCUPANCY for j in range(len(part))}
        x[k:] = len(fours) / max(1, len(part)), len(part) / size, math.log1p(len(text)) / 10, not text
        x = (x - net.mean) / net.spread
        h = [math.tanh(sum(x[a] * net.encode[a, j] for a in range(len(x))) + net.encode_bias[j]) for j in range(net.encode.shape[1])]
        gate = [math.tanh(np.dot(h, net.attend[:, g])) / (1 + math.exp(-np.dot(h, net.gate[:, g]))) for g in range(net.gate.shape[1])]
        hs.append(h)
        es.append(math.exp(np.dot(gate, net.weigh)))
    z = sum(e / sum(es) * np.array(h) for e, h in zip(es, hs, strict=True))
    return 1 / (1 + math.exp(-(np.dot(z, net.last) + net.last_bias[0])))


def some_net(rng):
    owner = np.repeat(np.arange(40), 3)
    x = rng.normal(0, 1, (120, quality_model.N_FEATURES)).astype(np.float32)
    return quality_model.train(x, owner, (np.arange(40) % 2).astype(float), epochs=2), x, owner


def test_scores_plain():
    """Against the plain network; no score depends on the texts beside it or on the size of the pieces."""
    net, _, _ = some_net(np.random.default_rng(2))
    rng = random.Random(5)
    texts = [prose(rng, n).encode() + "é日本".encode() for n in (1, 40, 90, 300, 1200)] + [b"", b"x" * 512, b"y" * 513]
    got = net.score(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
    assert np.allclose(got, [net.score([t])[0] for t in texts], atol=1e-12)
    assert np.allclose(got, net.score(texts, size=600), atol=1e-9)
    x, _ = quality_model.passages([texts[4]])
    assert (np.concatenate(list(quality_model.pieces(texts[4], 700))) == x).all()


def test_attention_gradient():
    """Every gradient against differences of the loss; and the loss falls on data that one passage decides."""
    rng = np.random.default_rng(1)
    net, x, owner = some_net(rng)
    y = (np.arange(40) % 3 == 0).astype(float)

    def loss():
        p = net.forward(x, owner, 40)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + quality_model.DECAY / 2 * ((net.encode**2).sum() + (net.last**2).sum())

    for a, g in zip(net.arrays(), net.gradients(x, owner, y), strict=True):
        for at in rng.integers(0, a.size, 6):
            old = a.flat[at]
            a.flat[at] = old + 1e-4
            up = loss()
            a.flat[at] = old - 1e-4
            down = loss()
            a.flat[at] = old
            assert abs((up - down) / 2e-4 - g.flat[at]) < 1e-5
    owner = np.repeat(np.arange(100), 4)
    x = rng.normal(0, 1, (400, quality_model.N_FEATURES)).astype(np.float32)
    y = (np.arange(100) % 2).astype(float)
    x[::4, 0] += 6 * y
    net = quality_model.train(x, owner, y, epochs=60)
    p = net.forward(x, owner, 100)["p"]
    assert np.mean((p > 0.5) == (y > 0)) > 0.95


def plain_language(net, text):
    """Window by window and filter by filter: mean probabilities, weighted by bytes."""
    body, total = text.encode(), np.zeros(len(net.labels))
    widest = max(language.WIDTHS)
    for i in range(0, len(body), language.WINDOW):
        part = list(body[i : i + language.WINDOW])
        x = part + [language.PAD] * (language.WINDOW - len(part))
        pooled = []
        for f in range(net.filters.shape[1]):
            best = max(sum(float(net.embed[x[s + j], d]) * float(net.filters[j * net.embed.shape[1] + d, f]) for j in range(widest) for d in range(net.embed.shape[1])) for s in range(language.WINDOW - widest + 1))
            pooled.append(max(0.0, best + float(net.bias[f])))
        z = np.array(pooled) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(part)
    return total / len(body)


def test_language_plain(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 60, w) for w in (["anana", "balaba"], ["stern", "kurz"], ["où", "été"]) for _ in range(8)]
    net = language.train(texts, [k for k in "abc" for _ in range(8)], steps=30)
    some = [texts[0], texts[9] + texts[20], "é"]
    want = [plain_language(net, t) for t in some]
    for piece in (language.PIECE, language.WINDOW):
        monkeypatch.setattr(language, "PIECE", piece)
        labels, scores = net.predict(some)
        assert labels == [net.labels[int(w.argmax())] for w in want]
        assert np.allclose(scores, [w.max() for w in want], atol=1e-5)


def test_every_language_is_learned(spark):
    """300 languages, some with one row and short texts: each has its place in the network; the bounds on rows and bytes hold."""
    rows = [(i, f"lang{i % 300} text", f"l{i % 300:03d}") for i in range(900)] + [(2000, "x", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(df).labels) == 301
    assert 0 < len(language.fit(df, train_bytes=200).labels) < 30


def test_language(spark, odd, empty):
    rng = random.Random(4)
    words = {"aa": ["anana", "balaba", "cadaga"], "bb": ["stern", "kurz", "sprung"], "cc": ["où", "été", "çaèe"]}
    rows = [(i, prose(rng, 20, words[k]), k) for i, k in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(df.where("doc_id < 120"))
    got = {r[0]: (r[1], r[2]) for r in language.identify(df, net).collect()}
    assert np.mean([got[i][0] == k for i, _, k in rows if i >= 120]) > 0.95
    odd_rows = language.identify(odd, net).collect()
    assert len(odd_rows) == odd.count()
    assert all(r[1] == "und" and r[2] == 0 for r in odd_rows if r[0] in (0, 1, 2))
    assert all(r[1] in words and 0 <= r[2] <= 1 for r in odd_rows if r[0] in (3, 4, 9))
    assert language.identify(empty, net).collect() == []
    assert {r[1] for r in language.identify(df, language.fit(empty)).collect()} == {"und"}


def test_windows_cover():
    x, owner, size = language.windows([b"", b"a" * 256, b"b" * 600])
    assert owner.tolist() == [0, 1, 2, 2, 2] and size.tolist() == [0, 256, 256, 256, 88]
    assert (x[0] == language.PAD).all() and (x[4, :88] == ord("b")).all() and (x[4, 88:] == language.PAD).all()
