"""Operators that learn or search: brute force, exact maths, held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def test_leaks(spark, docs, empty, clashing):
    from quillon.llm import leaks as K

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(30, 60, 20))] + [(100, "tiny one"), (101, None), (102, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i, (_, t) in enumerate(items[:20]):
        w = t.split()
        near = w[:]
        near[1] = "changed"  # one word near the border leaves most shingles
        rows += [(3 * i, f"{say(50)} {t.upper()}!! {say(30)}"), (3 * i + 1, f"{say(9)} {' '.join(near)}"), (3 * i + 2, say(200))]
    rows += [(900, "x tiny one y"), (901, None), (902, "")]
    texts = dict(rows)

    def brute(doc, item):
        a, b = doc.lower().replace("!", "").split(), item.lower().split()
        g = min(5, len(b))
        sh = lambda w: Counter(tuple(w[k : k + g]) for k in range(len(w) - g + 1))
        both = lambda x, y: sum((x & y).values()) / sum((x | y).values())
        return max((both(sh(a[s : s + len(b)]), sh(b)) for s in range(len(a) - len(b) + 1)), default=0.0)

    want = {(d, i): round(s, 6) for d, t in texts.items() for i, x in items if x and t and (s := brute(t, x)) >= 0.8}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = K.flag_leaks(table, bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found} == want and len(want) >= 21
    blocks = K.flag_leaks(table, bench, items=7).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(want)
    assert K.flag_leaks(docs, bench).count() == docs.count() and K.flag_leaks(empty, bench).count() == 0
    assert K.flag_leaks(clashing, bench).count() == docs.count() and K.flag_leaks(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_radius_holds_similar_windows():
    """Windows at the similarity are within the SimHash radius, at any length and however their shingles differ."""
    from quillon.llm.leaks import RADIUS, pack, signs

    rng = np.random.default_rng(0)
    near = total = 0
    for m in (9, 18, 36, 90, 270):
        for _ in range(400):
            a = rng.integers(1 << 62, size=m).astype(np.uint64)
            b = a.copy()
            b[: m // 9] = rng.integers(1 << 62, size=m // 9).astype(np.uint64)  # 8 of 10: 0.8
            x, y = (pack(signs(h).sum(axis=0, keepdims=True))[0] for h in (a, b))
            near += np.bitwise_count(x ^ y).sum() <= RADIUS
            total += 1
    assert near >= 0.998 * total


def test_multi_index_finds_all_within_the_radius_and_prunes():
    from quillon.llm import leaks as K

    rng = np.random.default_rng(1)
    prints = rng.integers(1 << 16, size=(600, K.BLOCKS)).astype(np.uint16)
    items = K.Items(40, 5, list(range(600)))
    items.close(list(prints))
    bits = np.unpackbits(prints.astype(">u2").view(np.uint8).reshape(600, -1), axis=1)
    asked = bits[:200].copy()
    for row in asked:  # exactly as far as the radius, anywhere
        row[rng.choice(K.BITS, K.RADIUS, replace=False)] ^= 1
    asked = np.packbits(asked, axis=1).view(">u2").astype(np.uint16)
    window, item = items.candidates(asked, K.near_values(K.PROBED))
    assert set(range(200)) <= set(window[window == item].tolist())
    # random fingerprints: most items are passed over
    other = rng.integers(1 << 16, size=(200, K.BLOCKS)).astype(np.uint16)
    window, item = items.candidates(other, K.near_values(K.PROBED))
    assert len(window) < 0.2 * 200 * 600


@pytest.mark.parametrize("frequent", [0, 6, 10])
def test_toxicity(spark, docs, empty, clashing, labels, monkeypatch, frequent):
    from quillon.llm import toxicity as X

    rng = np.random.default_rng(5)
    rows, truth = [], []
    for i in range(600):
        w = list(rng.choice([f"k{j}" for j in range(200)], int(rng.integers(20, 60))))
        bad = i % 5 == 0
        if bad:
            w[3] = str(rng.choice(["badword", "worseword"]))
        rows.append((i, " ".join(w)))
        truth.append((i, 1, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    index = X.fit(table, marks)
    got = {r.doc_id: r for r in X.score(table, index).collect()}
    assert all((got[i].score >= 0.5) == (t == 1) for i, _, t in truth)
    assert got[0].evidence[0].label == 1
    monkeypatch.setattr(X, "BLOCK", 8)
    monkeypatch.setattr(X, "FIRST", 2)
    monkeypatch.setattr(X, "FREQUENT", frequent)
    # block-max search against a dense product over the whole vocabulary: as many neighbours, the same similarities, the smaller number first
    index.open()
    unit = np.zeros((len(index.labels), len(index.vocabulary)))
    unit[index.example, np.repeat(np.arange(len(index.vocabulary)), np.diff(index.begin))] = index.weight
    assert len(index.vocabulary) > 200 and np.allclose((unit * unit).sum(axis=1), 1, atol=1e-5)
    visited = []
    kept = X.Index.similarities
    index.similarities = lambda *a: visited.append(len(set(index.block[a[0]].tolist()))) or kept(index, *a)
    for k in range(0, len(unit), 7):
        term = np.flatnonzero(unit[k])
        best, sims = index.nearest(term, unit[k][term])
        dense = unit @ unit[k]
        order = np.lexsort((np.arange(len(dense)), -dense))[: X.NEIGHBOURS]
        assert len(best) == min(X.NEIGHBOURS, (dense > 0).sum()) and np.allclose(sims, dense[order], atol=2e-6)
        assert np.allclose(sims, dense[best], atol=2e-6) and (np.diff(best)[np.diff(np.round(sims / X.CLOSE)) == 0] > 0).all()
    if frequent < 10:
        assert sum(visited) < index.blocks * len(range(0, len(unit), 7))  # some blocks are passed over
    monkeypatch.undo()
    some = X.fit(docs, labels)
    for t in (docs, clashing):
        out = X.score(t, some)
        assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert X.score(empty, X.fit(empty, labels)).count() == 0
    assert X.score(docs, X.fit(docs, labels.limit(0))).count() == docs.count()


def test_quality(spark, docs, empty, clashing, labels):
    from quillon.llm import quality as Q

    rng = np.random.default_rng(6)
    rows, truth = [], []
    for i in range(400):
        w = list(rng.choice([f"k{j}" for j in range(200)], int(rng.integers(20, 60))))
        good = i % 4 > 0
        rows.append((i, " ".join(w) if good else "*** ".join(w)))
        truth.append((i, int(good), 0))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in Q.score(table, Q.fit(table, marks)).collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, q, _ in truth]) > 0.98
    net = Q.fit(docs, labels)
    for t in (docs, clashing):
        out = Q.score(t, net)
        assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert Q.score(empty, Q.fit(empty, labels)).count() == 0
    assert Q.score(docs, Q.fit(docs, labels.limit(0))).count() == docs.count()


def test_held_out_rows_are_not_learnt(spark, labels):
    import zlib

    from quillon.llm._labels import fit_rows

    rows, counts = fit_rows(labels, "toxic", 1000)
    ids = {r.doc_id for r in rows.collect()}
    assert ids == {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert sum(counts.values()) == len(ids)


def test_lm_scores(docs, empty, clashing):
    from quillon.llm import lm

    encoded, counts = lm.encode(docs.select("doc_id", "text"))
    net = lm.fit(encoded, counts)
    got = {r.doc_id: r for r in lm.score(encoded, net).collect() if r.doc_id is not None}
    rows = {r.doc_id: np.frombuffer(r.ids, "<u2").astype(int) for r in encoded.collect() if r.doc_id is not None}
    w = {k: v.astype(np.float32).astype(float) for k, v in net.items()}
    rest = {r.doc_id: r.rest for r in encoded.collect()}
    for i, ids in rows.items():
        assert got[i].n_words == len(ids)
        if len(ids) > 300:
            continue
        total = rest[i]
        for k, y in enumerate(ids):  # one word at a time
            around = [ids[k + s] if 0 <= k + s < len(ids) else lm.SIZE for s in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate([w["emb"][a] for a in around]) @ w["w"] + w["b"])
            c, v = divmod(int(y), lm.IN_CLASS)
            first, second = h @ w["wc"] + w["bc"], h @ w["ww"][c] + w["bw"][c]
            total += first[c] - np.log(np.exp(first).sum()) + second[v] - np.log(np.exp(second).sum())
        assert abs(total - got[i].log_likelihood) < 1e-2 + 1e-4 * abs(total)
        assert (got[i].mean_log_likelihood is None) == (len(ids) == 0)
    assert lm.pseudo_likelihood(empty.select("doc_id", "text")).count() == 0
    assert lm.pseudo_likelihood(clashing).count() == docs.count()


def test_lm_shares_of_buckets(spark):
    """Words beyond the outputs share their bucket as they are counted in the corpus, and all shares add up to one."""
    from quillon.llm import lm

    often = " ".join(f"top{i} top{i} top{i} top{i}" for i in range(lm.WORDS))
    rare = [f"rare{i}" for i in range(500)]
    rows = [(0, often), (1, " ".join(rare)), (2, " ".join(rare[:100]))]
    docs = spark.createDataFrame(rows + [(3 + i, w) for i, w in enumerate(rare)], "doc_id long, text string")
    encoded, counts = lm.encode(docs)
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[0].rest == 0 and counts.sum() == 4 * lm.WORDS + 1100 and counts[lm.WORDS :].sum() == 1100
    assert abs(got[1].rest - sum(got[3 + i].rest for i in range(500))) < 1e-6
    # two of three in 100 words, two in the others; a cell's words share it
    shares = [(np.frombuffer(got[3 + i].ids, "<u2")[0], np.exp(got[3 + i].rest)) for i in range(500)]
    assert np.mean([got[3 + i].rest for i in range(100)]) > np.mean([got[3 + i].rest for i in range(100, 500)]) + 0.15
    total = Counter()
    for bucket, p in shares:
        total[bucket] += p
    assert all(abs(x - 1) < 0.02 for x in total.values())


def test_lm_learns_from_every_position(spark, monkeypatch):
    """Each document is in one round, and each of its positions is a target once."""
    from quillon.llm import lm

    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(50)], int(rng.integers(0, 60))))) for i in range(200)]
    encoded, counts = lm.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    seen = []
    monkeypatch.setattr(lm, "steps", lambda net, c, y, m=None: seen.extend(map(tuple, np.column_stack([c, y]))))
    rounds = [encoded.where(F.pmod(F.xxhash64("ids"), F.lit(lm.ROUNDS)) == k).select("ids").toArrow().to_batches() for k in range(lm.ROUNDS)]
    for batches in rounds:
        list(lm._train(lm.start(counts))(iter(batches)))
    want = Counter()
    for r in encoded.collect():
        ids = np.frombuffer(r.ids, "<u2").astype(int)
        want.update(tuple(ids[k + s] if 0 <= k + s < len(ids) else lm.SIZE for s in (-2, -1, 1, 2, 0)) for k in range(len(ids)))
    assert Counter(tuple(int(v) for v in x) for x in seen) == want and want.total() == counts.sum()


def test_lm_gradients():
    """The step's gradients against differences of the loss."""
    from quillon.llm import lm

    rng = np.random.default_rng(4)
    net = {k: rng.normal(0, 0.3, s) for k, s in lm.SHAPES.items()}
    ids, row = rng.integers(0, lm.SIZE, 40), np.repeat([0, 1], 20)
    context = lm.windows(ids, row)

    def loss(n):
        h = np.tanh(np.concatenate([n["emb"][context[:, k]] for k in range(4)], axis=1) @ n["w"] + n["b"])
        c, v = ids // lm.IN_CLASS, ids % lm.IN_CLASS
        log_softmax = lambda x: x - np.log(np.exp(x).sum())
        one = np.array([log_softmax(h[i] @ n["wc"] + n["bc"])[c[i]] for i in range(40)])
        two = [log_softmax(h[i] @ n["ww"][c[i]] + n["bw"][c[i]])[v[i]] for i in range(40)]
        return -(one.sum() + sum(two)) / 40

    grads = {}
    moments = {"t": 0, **{k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}}
    own = {k: v.copy() for k, v in net.items()}
    lm.steps(own, context, ids, moments)
    for k in net:
        grads[k] = moments[k][0] / 0.1
        for at in [tuple(rng.integers(0, n) for n in net[k].shape) for _ in range(3)] + [np.unravel_index(np.abs(grads[k]).argmax(), net[k].shape)]:
            up, down = ({x: v.copy() for x, v in net.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grads[k][at]) < 1e-5, k


def test_lm_rows_far_apart():
    """One maximum for all rows does not lose those far below it."""
    from quillon.llm import lm

    x = np.array([[500.0, 499.0], [-500.0, -501.0], [0.0, 3.0]], np.float32)
    want = [500 + np.log1p(np.exp(-1)), -500 + np.log1p(np.exp(-1)), 3 + np.log1p(np.exp(-3))]
    assert np.allclose(lm._log_sums(x), want) and np.allclose(lm._softmax(x).sum(axis=1), 1)


def test_lm_learns():
    """The gradient steps raise the likelihood of a predictable text."""
    from quillon.llm import lm

    ids = np.tile(np.array([5, 70, 300, 900]), 3000)
    row = np.zeros(len(ids), int)
    counts = np.bincount(ids, minlength=lm.SIZE).astype(float)
    net = lm.start(counts)
    before = lm.log_probabilities(net, ids, row).mean()
    lm.steps(net, lm.windows(ids, row), ids)
    assert lm.log_probabilities(net, ids, row).mean() > before + 0.5


def test_html():
    from quillon.llm.html_text import main_text

    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
    text&nbsp;here.</p><div class="ad">Buy</div><ul><li>One<li>Two</ul><p><b>Open<br><p>Last &lt;p&gt;</p><form>Mail</form><script>var t="</p>";</script>
    <div id="comments"><p>reader says</p></div></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst bold text here.\nOne\nTwo\nOpen\nLast <p>"
    body = "".join(f"<p>{'Sentence number %d with a fair amount of running text in it. ' % i * 3}</p>" for i in range(5))
    plain = f"<body><div class=menu><a href=1>a</a><a href=2>b</a></div><div><div>{body}</div></div><div><a href=3>More links here</a> <a href=4>and here</a></div></body>"
    assert main_text(plain).count("\n") == 4 and "links" not in main_text(plain)
    for k in range(0, len(page), 3):  # cut off anywhere
        assert "Site" not in main_text(page[:k]) and "Menu" not in main_text(page[:k])
    assert main_text("<p>a < b & c &unknown; &#65;</p>") == "a < b & c &unknown; A"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_densities_against_brute_force():
    """Densities, sums and the core of random trees, by definition from every subtree."""
    import random
    from math import e, log

    from quillon.llm import html_text as H

    rng = random.Random(5)

    def grow(depth):
        kids = "".join(grow(depth + 1) for _ in range(rng.randint(0, 4 - depth))) if depth < 4 else ""
        tag = rng.choice(["div", "section", "a", "span", "p" if not kids else "div"])
        return f"<{tag}>{'x' * rng.randint(0, 40)}{kids}</{tag}>"

    for _ in range(150):
        page = H.Page("<body>" + "".join(grow(0) for _ in range(3)) + "</body>")
        n = len(page.tag)
        chars, links = [0] * n, [0] * n
        for node, _, text in page.pieces:
            chars[node] += len(text)
            links[node] += len(text) * page.link[node]
        inside = [[j for j in range(n) if i in H.path_up(page, j)] for i in range(n)]
        share = sum(links) / max(1, sum(chars))

        def one(i, inside=inside, chars=chars, links=links, page=page, share=share):
            c, lc = sum(chars[j] for j in inside[i]), sum(links[j] for j in inside[i])
            t, lt = len(inside[i]) - 1, sum(page.link[j] for j in inside[i] if j != i)
            if not c:
                return 0.0
            other = log(c / max(1, c - lc) * lc + share * c + e)
            return c / max(1, t) * log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)) + e - 1) / log(other + e - 1)

        density, sums, c = H.densities(page, [False] * n, chars, links)
        assert np.allclose(density, [one(i) for i in range(n)])
        assert np.allclose(sums, [sum(one(j) for j in range(1, n) if page.parent[j] == i) for i in range(n)])
        assert c == [sum(chars[j] for j in inside[i]) for i in range(n)]


def test_html_density_decides(monkeypatch):
    """Without telling tags or names the densest subtree is the article; without densities it is not found."""
    from quillon.llm import html_text as H

    say = lambda k: f"Sentence number {k} has a fair amount of running text in it, and then some more of it. " * 3
    body = "".join(f"<p>{say(k)}</p>" for k in range(5))
    menu = "<div><ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12)) + "</ul></div>"
    page = f"<html><body>{menu}<div>Buy now</div><div><h1>Head</h1>{body}</div><div>&copy; <a href=x>us</a></div></body></html>"
    want = "\n".join(["Head", *(say(k).strip() for k in range(5))])
    assert H.main_text(page) == want
    # a heading beside the core, and a part of the article outside of it
    assert H.main_text(f"<body>{menu}<div><h1>Head</h1><div>{body}</div></div></body>") == want
    # names that a suspect shares with an article do not take it away
    for name in ('class="side"', 'id="search-engines"', 'class="header-wrap"', 'class="content notice"'):
        assert H.main_text(f"<body>{menu}<div {name}><article><h1>Head</h1>{body}</article></div></body>") == want, name
        assert H.main_text(f"<body>{menu}<div {name}><h1>Head</h1>{body}</div><div>short tail</div></body>") == want, name
    assert H.main_text(f"<body><form><div><h1>Head</h1>{body}</div><input></form></body>") == want
    # readers may write more than the author, and sidebars be long
    for noise in (f"<div class=comments>{body * 4}</div>", f"<aside>{body * 4}</aside>", f"<div class=sidebar>{body * 4}</div>"):
        assert H.main_text(f"<body><article><h1>T</h1><p>{say(9)}</p></article>{noise}</body>") == "T\n" + say(9).strip()
    assert H.main_text(f"<body><div><h1>T</h1><p>{say(9)}</p></div><div class=comments>{body * 4}</div></body>") == "T\n" + say(9).strip()
    assert H.main_text(f"<body><div id=comments>{body}</div></body>") == "\n".join(say(k).strip() for k in range(5))
    real = H.densities
    monkeypatch.setattr(H, "densities", lambda p, g, c, k: ([0.0] * len(c), [0.0] * len(c), real(p, g, c, k)[2]))
    assert H.main_text(page) != want


def test_html_noise_below_many_open_elements():
    """Noise elements and end tags count at any depth."""
    from quillon.llm.html_text import main_text

    inner = "<article><p>Main text here.</p><nav>Menu</nav><div class=ad><div>Buy</div> now</div><p>More main text.</p></article>"
    for tag in ("div", "span", "b"):
        for n in (0, 300, 399, 401, 5000):
            assert main_text(f"<{tag}>" * n + inner) == main_text(f"<{tag}>" * n + inner + f"</{tag}>" * n) == "Main text here.\nMore main text.", (tag, n)


def test_html_hostile_nesting():
    """Depth is bounded, so unclosed and unmatched tags take time in proportion."""
    import time

    from quillon.llm.html_text import main_text

    began = time.process_time()
    for page in ("<b>" * 20_000 + "y" + "</i>" * 20_000, "<div>" * 20_000 + "x" + "</p>" * 20_000, "<i><div>" + "<b>" * 3000 + "</i>" * 20_000, "<ul>" + "<li>a" * 20_000, "<!--" * 20_000, '<a b="' * 20_000):
        main_text(page)
    assert time.process_time() - began < 15


def test_html_frame(spark):
    from quillon.llm.html_text import extract_text

    rows = [(1, "u", "<article><p>x</p></article>", "old"), (2, None, None, None), (1, "u", "<article><p>x</p></article>", "old")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in extract_text(table).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert extract_text(table.limit(0)).count() == 0


def test_runs_do_not_cross_rows():
    from quillon.llm._text import Places, hashed_words, slices

    column = pa.array(["ab", None, "c d", "", "ab"])
    [(i, j, data, offsets)] = list(slices(column))
    words, at = hashed_words(data, offsets, Places())
    assert (i, j) == (0, 5) and np.diff(at).tolist() == [1, 0, 2, 0, 1] and words[0] == words[3]
