"""Benchmark windows, quality, toxicity, main text: brute force and held-out accuracy."""

import random
from itertools import product

import numpy as np
import pyarrow.parquet as pq

from missive.llm import contamination, main_text, quality, toxicity
from missive.llm.queries import op4_weak_label_quality, op9_toxic_lexicon

SF = "/root/testdata/sf0.01"


def brute_leaks(docs, items):
    out = {}
    for i, text in docs:
        words = contamination.words_of(text or "")
        for k, item in items:
            target = contamination.words_of(item or "")
            if not target or not words:
                continue
            width, span = min(5, len(target)), min(len(target), len(words))
            if len(words) < width:
                continue
            scores = [contamination.similarity(words[b : b + span], target, width) for b in range(len(words) - span + 1)]
            best = max(scores)
            if best >= contamination.SIMILARITY:
                out[i, k] = (best, scores.index(best))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)] + ["Éa", "x_1"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 20, 40])))) for k in range(30)]
    items += [(30, None), (31, "... !"), (32, items[5][1])]
    docs = []
    for i in range(80):
        words = rng.choices(vocabulary + [f"u{k}" for k in range(300)], k=rng.choice([0, 2, 10, 60, 150]))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1]
            part = contamination.words_of(part or "")
            for _ in range(rng.choice([0, 0, 1])):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part[rng.choice([0, 0, 1]) :]
        docs.append((i, ", ".join(words).title()))
    docs += [(80, None), (81, items[20][1] + " " + "z " * 30_000 + items[21][1])]
    want = brute_leaks(docs[:81], items)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for lot in (4096, 7):
        monkeypatch.setattr(contamination, "ITEMS_AT_ONCE", lot)
        rows = contamination.leaks(table, bench).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in rows if r.doc_id != 81}
        assert got == want and len(rows) == len({(r.doc_id, r.item_id) for r in rows})
        assert {20, 21} <= {r.item_id for r in rows if r.doc_id == 81}
    clean = contamination.without_leaks(table, bench)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want} - {81}
    assert contamination.leaks(table.limit(0), bench).count() == contamination.leaks(table, bench.limit(0)).count() == 0


def test_radius_loses_no_similar_window():
    """Windows of similarity 0.8 lie within the radius, which the blocks cover whole."""
    rng = random.Random(7)
    lost = 0
    for _ in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(45, 60))]
        other = list(words)
        other[rng.choice([0, 1, len(words) - 1])] = "changed"
        assert contamination.similarity(words, other, 5) >= contamination.SIMILARITY
        index = contamination.Index([(1, " ".join(words))])
        lost += not index.search(" ".join(other))
    assert lost == 0
    sized = next(iter(contamination.Index([(1, "a b c d e f g")]).sizes.values()))
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 30)))
        found = list(sized.candidates(np.array([sized.prints[0] ^ np.uint64(flips)], dtype=np.uint64)))
        assert bool(found) == (flips.bit_count() <= contamination.RADIUS)


def test_quality_on_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    keep = {r.doc_id: r.keep for r in op4_weak_label_quality(spark, SF).collect()}
    good = [keep[i] for i, y in labels.items() if y == 1]
    bad = [keep[i] for i, y in labels.items() if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_expectation_maximisation_finds_planted_rates():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    rates = {True: [0.002, 0.004, 0.001], False: [0.6, 0.3, 0.5]}
    votes = np.array([[-1 if rng.random() < r else 1 for r in rates[bool(t)]] for t in truth])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, share, bad = quality.estimate([tuple(p) for p in patterns], counts.astype(float))
    assert abs(share - 0.8) < 0.1
    assert good[[i for i, p in enumerate(patterns) if (p == 1).all()][0]] > 0.9
    assert good[[i for i, p in enumerate(patterns) if (p == -1).all()][0]] < 0.01 and (bad[0] > bad[1]).all()


def test_odd_rows_of_classifiers(spark):
    rows = [(1, None), (2, ""), (3, "w " * 40_000), (None, "some text"), (4, "a b"), (4, "a b")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        got = toxicity.scored(docs, lab).collect()
        assert len(got) == len(rows) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert quality.scored(docs).count() == len(rows) and quality.kept(docs).columns == docs.columns
    assert not any(r.keep for r in quality.scored(docs).where("doc_id < 3").collect())
    assert quality.scored(docs.limit(0)).count() == toxicity.scored(docs.limit(0), labels).count() == 0


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    rows = [r for r in op9_toxic_lexicon(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted == 1 == labels[r.doc_id] for r in rows)
    assert hit >= 0.85 * sum(r.predicted for r in rows) and hit >= 0.85 * sum(labels[r.doc_id] for r in rows)


def test_matcher_folds_and_spares():
    matcher = toxicity.Matcher({" idiot ": 5.0, " loser ": 4.0, " veju": 3.0}, ["no idiot"])
    assert matcher.measures("")[0] == 0 and matcher.measures("idiots")[0] == 0
    full = matcher.measures("an idiot here")[0]
    for text in ("an 1D10T here", "an ІdІоt here", "an ｉｄｉｏｔ here", "an idiot$$$ here", "(Idiot) a b"):
        assert matcher.measures(text)[0] == full, text
    assert matcher.measures("a 1oser a b")[0] == matcher.measures("a loser a b")[0] > 0
    assert matcher.measures("vejuais")[0] > 0 and matcher.measures("xveju")[0] == 0
    assert matcher.measures("no idiot here")[0] == 0
    assert matcher.measures("idiot " + "w " * 1000)[1] < matcher.measures("idiot w w")[1]


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores, places = [rng.gauss(0, 1.5) for _ in range(n)], [rng.randint(0, 2) for _ in range(n)]

        def cost(labels):
            total, last = 0.0, {}
            for k, on in enumerate(labels):
                total += main_text.costs(scores[k])[0 if on else 1]
                total += main_text.NEAR * (k > 0 and labels[k - 1] != on)
                total += main_text.TOGETHER * (labels[last.get(places[k], k)] != on)
                last[places[k]] = k
            return total

        best = min(map(cost, product([False, True], repeat=n)))
        assert abs(cost(main_text.label(scores, places)) - best) < 1e-6


PARAGRAPH = "This is a long paragraph of real content, with commas and enough words to count as such. " * 2
PAGES = [
    ("", ""),
    (None, ""),
    ("no tags &amp; nothing", "no tags & nothing"),
    ("<p>a &lt;b&gt; &eacute;&#233;&nbsp;c.<p>Next\n one.", "a <b> éé c. Next one."),
    (f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{PARAGRAPH}<div class='ad'>Buy now. Really.</div><p>Short</p></article><footer>&copy; me</footer>", f"Head {PARAGRAPH.strip()} Short"),
    (f"<body class=no-sidebar><div id=header>Site</div><div class=content><p>{PARAGRAPH}</div><div id=comments><p>{PARAGRAPH}</div><aside><p>{PARAGRAPH}</aside>", PARAGRAPH.strip()),
    (f"<script>var t='<p>x</p>';</script><style>p{{}}</style><!-- <p>no</p> --><main><form>Name <input></form><p>{PARAGRAPH}</main>", PARAGRAPH.strip()),
    (f"<div class='cookie-notice'>We use cookies. {PARAGRAPH}</div><main><p title='a>b'>{PARAGRAPH}</p></main>", PARAGRAPH.strip()),
    ("<p>" + "word " * 50_000 + ".", "word " * 50_000 + "."),
]


def test_main_text(spark):
    rows = [(k, f"http://x/{k}", html, "t") for k, (html, _) in enumerate(PAGES)] + [(None, None, "<p>Lost page text here.", "t")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = "Lost page text here." if r.page_id is None else PAGES[r.page_id][1]
        assert r.text == want, (r.page_id, r.text[:200])
    assert main_text.extract(pages.limit(0)).count() == 0


def test_quality_reads_whole_texts():
    """What comes behind the first hundred words, or the first signs of a text without blanks, counts."""
    vocabulary = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    place = quality.LABELLERS.index("few_words")
    repeated = vocabulary + ["buy", "now"] * 4000
    assert quality.votes(" ".join(vocabulary * 4), vocabulary * 4)[place] == 1
    assert quality.votes(" ".join(repeated), repeated)[place] == -1
    shapes = quality.Shapes()
    plain, mixed = "ab" * 500, "ab" * 50 + "a1-B" * 225
    assert len(shapes.buckets([plain])) == 2 * -(-1000 // 16) - 1
    assert set(shapes.buckets([mixed]).tolist()) - set(shapes.buckets([plain]).tolist())
