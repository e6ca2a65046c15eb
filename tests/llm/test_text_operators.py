"""Scores, grades, pieces and digests against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, text

from momentquery.llm import ctw, digest, quality, sentencepieces, toxicity
from momentquery.llm import queries_sentencepieces as qs
from momentquery.llm.labelled import held_out
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from momentquery.session import ship

    ship(spark)


def plain_ctw(learn, score, depth):
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def steps(x):
        padded = b"\n" * depth + x
        for k in range(depth, len(padded)):
            node = 1
            for j in range(7, -1, -1):
                bit = padded[k] >> j & 1
                yield padded[k - depth : k], node, bit
                node = node * 2 + bit

    for x in learn:
        for context, node, bit in steps(x):
            for d in range(depth + 1):
                counts[d][context[depth - d :], node][bit] += 1
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    share, below = [{} for _ in range(depth + 1)], defaultdict(float)
    for d in range(depth, -1, -1):
        up = defaultdict(float)
        for (c, node), (a, b) in counts[d].items():
            own = block(a, b)
            if d == depth:
                w, share[d][c, node] = own, 1.0
            else:
                w = np.logaddexp(own, below[c, node]) - math.log(2)
                share[d][c, node] = math.exp(own - math.log(2) - w)
            if d:
                up[c[1:], node] += w
        below = up
    out = []
    for x in score:
        total = 0.0
        for c, node, bit in steps(x):
            p, left, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                k = c[depth - d :], node
                if k not in counts[d]:
                    break
                a, b = counts[d][k]
                last = (b + 0.5) / (a + b + 1)
                p += left * share[d][k] * last
                left *= 1 - share[d][k]
            p += left * last
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_weighting(spark):
    rng = random.Random(3)
    texts = [text(rng, rng.randint(1, 40)) for _ in range(25)] + awkward(rng)[:5] + [awkward(rng)[8]]
    df = documents(spark, texts)
    # Pieces of a few strings: every context is split to its last byte.
    for depth, piece in ((4, ctw.PIECE), (6, ctw.PIECE), (6, 3)):
        got = {r.doc_id: r for r in ctw.scored(df, F.col("doc_id") % 4 == 1, depth=depth, piece=piece).collect()}
        seen = [(t or "").encode().lower().split() for t in texts]
        as_bytes = [b" ".join(w) + b"\n" for w in seen]
        learn = [x for i, x in enumerate(as_bytes) if i % 4 != 1]
        want = plain_ctw(learn, as_bytes, depth)
        counts = Counter(w for i, ws in enumerate(seen) if i % 4 != 1 for w in [*ws, b"\n"])
        n, v = sum(counts.values()), len(counts)
        for i, ws in enumerate(seen):
            r = got[i]
            assert r.held_out == (i % 4 == 1) and r.n_tokens == len(ws) + 1 and r.train_tokens == n
            assert r.n_known == sum(counts[w] > 0 for w in [*ws, b"\n"])
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, b"\n"]))
            assert r.score == pytest.approx(want[i], rel=1e-9)


def test_decisions_of_a_byte_sum_to_one():
    learn = [b"abab abba\n", b"aab b\n"]
    scores = plain_ctw(learn, [b"ab" + bytes([c]) for c in range(256)], 3)
    first = plain_ctw(learn, [b"ab"], 3)[0]
    assert sum(10 ** (s - first) for s in scores) == pytest.approx(1)


def test_long_texts_come_in_parts(monkeypatch):
    """Pieces of a long text give the strings and words of the whole."""
    rng = random.Random(6)
    texts = [text(rng, 400), "  \n " * 50 + text(rng, 90) + " " * 300 + "Zz" + " \t" * 200, "x" * 900, " " * 700, text(rng, 3), ""]
    array = pa.array(texts)
    whole = [tuple(np.concatenate(c) for c in zip(*(part[:4] for part in ctw.indexed(pa.array([t]), 6)))) for t in texts]
    for span, piece in ((256, 64), (300, 17)):
        monkeypatch.setattr(ctw, "SPAN", span)
        monkeypatch.setattr(ctw.words, "PIECE", piece)
        got, parts = [], 0
        for hashes, n_words, keys, n_bytes, more in ctw.indexed(array, 6):
            parts += more
            w, k = np.cumsum([0, *n_words]), np.cumsum([0, *n_bytes])
            for i in range(len(n_words)):
                own = [hashes[w[i] : w[i + 1]], keys[k[i] : k[i + 1]]]
                if more:
                    got[-1] = [np.concatenate(c) for c in zip(got[-1], own)]
                else:
                    got.append(own)
        assert parts > 3 and len(got) == len(texts)
        for (hashes, _, keys, _), (h, k) in zip(whole, got):
            assert np.array_equal(hashes, h) and np.array_equal(keys, k)


def test_scoring_of_nothing(spark):
    assert ctw.scored(documents(spark, []), F.lit(False)).count() == 0
    only = ctw.scored(documents(spark, ["a b"]), F.lit(True)).first()  # nothing to learn from
    assert only.n_known == 0 and only.train_tokens == 0 and only.score == pytest.approx(-len(b"a b\n") * 8 * math.log10(2))


INSULTS = ["fool", "nincompoop", "oaf"]


def _toxic(rng, n):
    out = []
    for i in range(n):
        # Half of the words without their digit, so that shape alone tells nothing.
        words = [w[:-1] if rng.random() < 0.5 else w for w in text(rng, rng.randint(5, 60)).split()]
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS) + rng.choice(["", ".", "!"]))
        out.append((" ".join(words), int(bad)))
    return out


def _tagged(tagger, texts):
    found = [(s, spans) for scores, own in tagger.tagged(pa.array(texts, pa.string())) for s, spans in zip(scores.tolist(), own)]
    assert len(found) == len(texts)
    return found


def test_toxic_documents_and_spans(spark):
    rng = random.Random(1)
    docs = _toxic(rng, 600)
    chain = toxicity.fitted(docs[:400])
    tagger = toxicity.Tagger(chain)
    for (t, label), (score, spans) in zip(docs[400:], _tagged(tagger, [t for t, _ in docs[400:]])):
        assert (score >= 0.5) == bool(label)
        assert {t[a:b].strip(".!") for a, b, _ in spans if " " not in t[a:b]} <= set(INSULTS) and bool(spans) == bool(label)
    df = documents(spark, [*awkward(rng), "such a FOOL!", "ü ▁ a FOOL!"])
    got = toxicity.score(df, chain)
    assert set(df.columns) < set(got.columns)
    rows = got.orderBy("doc_id").collect()
    score = [r.toxicity.score for r in rows]
    assert [s >= 0.5 for s in score] == [False] * 13 + [True] * 2
    assert score[0] == score[1] == score[2] and score[5] == pytest.approx(score[6], rel=1e-9)
    assert [(s.start, s.end) for s in rows[13].toxicity.spans] == [(7, 12)] and [(s.start, s.end) for s in rows[14].toxicity.spans] == [(6, 11)]
    assert toxicity.score(documents(spark, []), chain).count() == 0


def test_tags_reach_beyond_the_listed_words():
    """A word that no text of the fit had, and no listed word covers, is tagged by its other features."""
    docs = _toxic(random.Random(4), 500)
    chain = toxicity.fitted(docs)
    listed = toxicity.lexicon([({toxicity.word(w) for w in t.split()}, label) for t, label in docs])
    assert set(INSULTS) <= listed and not set(toxicity.beginnings("nincompoopery")) & listed
    unseen = " ".join(["alpha", "gamma", "tau"] * 3 + ["nincompoopery"] + ["sigma", "beta"] * 3)
    (score, spans), = _tagged(toxicity.Tagger(chain), [unseen])
    assert score >= 0.5 and [unseen[a:b] for a, b, _ in spans] == ["nincompoopery"]


def test_scores_do_not_depend_on_the_texts_beside(monkeypatch):
    rng = random.Random(5)
    docs = _toxic(rng, 300)
    chain = toxicity.fitted(docs[:200])
    texts = [*awkward(rng), *(t for t, _ in docs[200:]), " ".join(["plain"] * 5000 + ["oaf"]), "x" * 5000]
    alone = [_tagged(toxicity.Tagger(chain), [t])[0] for t in texts]
    for span, piece in ((1 << 19, 1 << 19), (700, 64)):
        monkeypatch.setattr(toxicity, "SPAN", span)
        monkeypatch.setattr(toxicity.words, "PIECE", piece)
        for (s, spans), (want, places) in zip(_tagged(toxicity.Tagger(chain), texts), alone):
            assert s == pytest.approx(want, rel=1e-9) and [x[:2] for x in spans] == [x[:2] for x in places]


def _paths(emit, steps, start):
    for path in itertools.product((0, 1), repeat=len(emit)):
        s = (start if path and path[0] else 0.0) + sum(steps[a][b] for a, b in zip(path, path[1:])) + sum(x for x, y in zip(emit, path) if y)
        yield path, math.exp(s)


def test_marginals_match_all_paths():
    rng = np.random.default_rng(1)
    steps, start = ((0.2, -1.0), (-0.3, 0.7)), -0.5
    lengths = [5, 1, 7, 2, 6]
    emit = rng.normal(size=sum(lengths)) * 2
    begins = np.zeros(len(emit), bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    p, pair = toxicity.chances(emit, begins, steps, start)
    at = 0
    for n in lengths:
        weight, step = np.zeros((n, 2)), np.zeros((n, 4))
        for path, w in _paths(emit[at : at + n], steps, start):
            for i, y in enumerate(path):
                weight[i, y] += w
                if i:
                    step[i, 2 * path[i - 1] + y] += w
        assert p[at : at + n] == pytest.approx(weight[:, 1] / weight.sum(1))
        assert pair[:, at : at + n].T == pytest.approx(step / weight.sum(1)[:, None])
        at += n
    long = np.full(20001, -3.0)  # far beyond what a product of probabilities could hold
    long[17] = 40.0
    p, _ = toxicity.chances(long, np.arange(20001) == 0, steps, start)
    assert p[17] > 0.999 and p[10000] == pytest.approx(p[15000]) and 0 < p[10000] < 0.1


def test_gradient_matches_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 1)
    rng = np.random.default_rng(0)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    docs = [["ab", "cd", "ab"], ["x"], [], ["cd", "12", "ab", "cd", "x!"]]
    c = toxicity.corpus(*toxicity.numbered(" ".join(d).upper() for d in docs))
    assert [(x.start, x.stop) for x in toxicity.blocks(c)] == [(0, 4), (4, 9)]
    y = rng.random(len(c.tokens)) < 0.4
    theta = rng.normal(size=len(c.features) + 2 * len(c.neighbours) + 6)

    def loss(theta):
        own, before, after, other, steps, start = toxicity._split(theta, c)
        w, b, a = (dict(zip(names, x)) for names, x in ((c.features, own), (c.neighbours, before), (c.neighbours, after)))
        total, at = 0.0, 0
        for doc in docs:
            emit = [other + sum(w[f] for f in toxicity.features(t)) for t in doc]
            for i in range(len(doc)):
                emit[i] += (b[toxicity.word(doc[i - 1])] if i else 0.0) + (a[toxicity.word(doc[i + 1])] if i + 1 < len(doc) else 0.0)
            assert toxicity.corpus_emissions(theta, c)[at : at + len(doc)] == pytest.approx(np.array(emit))
            every = dict(_paths(emit, steps, start))
            total += math.log(sum(every.values())) - math.log(every[tuple(y[at : at + len(doc)].astype(int).tolist())])
            at += len(doc)
        return total

    g = toxicity.gradient(theta, c, y, toxicity._steps_of(y, c.begins))
    h = 1e-5
    for i, d in enumerate(np.eye(len(theta)) * h):
        assert g[i] == pytest.approx((loss(theta + d) - loss(theta - d)) / (2 * h), abs=1e-6)


def test_labels_of_one_kind_teach_nothing(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, None, None)], "doc_id long, toxic int, quality int")
    docs = documents(spark, ["a b", "c d", None], ids=[1, 2, None])
    chain = toxicity.fit(docs, labels)
    assert not chain.words and all(r.toxicity.score < 0.5 for r in toxicity.score(docs, chain).collect())
    model = quality.fit(docs, labels, "quality", 3)
    assert all(r.grade.tails == [1.0, 1.0] for r in quality.graded(docs, model, 3).collect())


def test_grades(spark):
    rng = random.Random(2)

    def make(grade):
        words = text(rng, rng.randint(10, 60)).split()
        if grade == 0:
            words = [w + "%%%" for w in words]
        if grade == 1:
            words = [w.upper() for w in words]
        return " ".join(words), grade

    docs = [make(i % 3) for i in range(400)]
    model = quality.fitted(docs[:300], 3)
    assert model.thresholds[0] < model.thresholds[1]
    grader = quality.Grader(model)
    right = 0
    for t, g in docs[300:]:
        tails = grader.tails(t)
        assert tails[0] >= tails[1]
        right += sum(x >= 0.5 for x in tails) == g
    assert right >= 95
    df = documents(spark, awkward(rng))
    out = quality.graded(df, model, 3)
    rows = out.orderBy("doc_id").collect()
    assert set(df.columns) < set(out.columns) and rows[0].grade == rows[1].grade and rows[5].grade == rows[6].grade
    assert all(r.grade.expected == pytest.approx(sum(r.grade.tails)) for r in rows)
    assert quality.graded(documents(spark, []), model, 3).count() == 0


def test_grades_are_the_plain_ones():
    """Tails, likelihood and gradient against a version that follows the definition."""
    rng = random.Random(3)
    docs = [(text(rng, rng.randint(0, 12)) + " !! Ab12", rng.randrange(4)) for _ in range(14)] + [("", 2)]
    s = quality.rated(docs, 4)
    theta = np.random.default_rng(1).normal(size=len(s.used) + 3) * 0.5

    def plain(theta):
        w = dict(zip(s.used.tolist(), theta))
        cut = theta[len(s.used) :]
        t = [cut[0], cut[0] + math.exp(cut[1]), cut[0] + math.exp(cut[1]) + math.exp(cut[2])]
        out = []
        for d, _ in docs:
            tokens = d.split()
            latent = sum(w[quality.slot("mark", m)] for m in quality.marks(tokens)) / 4
            if tokens:
                latent += sum(w[quality.slot("word", x.lower())] + w[quality.slot("shape", quality.shape(x))] for x in tokens) / len(tokens)
            out.append([1 / (1 + math.exp(-(latent - x))) for x in t])
        return t, out

    def loss(theta):
        n = Counter(g for _, g in docs)
        total = 0.0
        for (_, g), tails in zip(docs, plain(theta)[1]):
            full = [1.0, *tails, 0.0]
            total -= math.log(full[g] - full[g + 1]) / (len(n) * n[g])
        return total

    g, h = quality.gradient(theta, s), 1e-5
    for i, d in enumerate(np.eye(len(theta)) * h):
        assert g[i] == pytest.approx((loss(theta + d) - loss(theta - d)) / (2 * h), abs=1e-6)
    weights = np.zeros(quality.N_WEIGHTS)
    weights[s.used] = theta[: len(s.used)]
    t, tails = plain(theta)
    grader = quality.Grader(quality.Grades(weights, tuple(t)))
    for (d, _), want in zip(docs, tails):
        assert grader.tails(d) == pytest.approx(want)


def test_held_out_fold(spark):
    rows = spark.range(200).select("id", held_out(F.col("id"), 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.load(qs.model_path())


def test_ranks_become_log_probabilities(vocabulary):
    usual = [s for i, s in enumerate(vocabulary.scores) if i not in vocabulary.special and i not in vocabulary.byte_ids]
    assert min(usual) > -15 and max(usual) < -2 and sum(math.exp(s) for s in usual) == pytest.approx(1)
    assert sentencepieces.zipf([-1.0, -1e9, -2.0, -1e9]) == pytest.approx([math.log(x / (1 + 1 / 2 + 2 / 3)) for x in (1, 1 / 3, 1 / 2, 1 / 3)])
    assert sentencepieces.is_ranked([-1e9, -1.0, -2.0, -1e9]) and not sentencepieces.is_ranked([-2.5, -3.5, -4.25]) and not sentencepieces.is_ranked([])


def test_pieces_are_the_best_segmentation(vocabulary):
    coder = sentencepieces.Coder(vocabulary)
    never = vocabulary.special | set(vocabulary.byte_ids)
    by = {p: s for i, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores)) if i not in never}
    rng = random.Random(4)
    for t in ["Hello  wörld\n x ", "a▁b", "日本\U0001f600", "   ", text(rng, 60), "x" * 200, "The theme, then."]:
        marked = "▁" + t.replace("▁", sentencepieces.LITERAL).replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - 20), end):
                if marked[start:end] in by:
                    best[end] = max(best[end], best[start] + by[marked[start:end]])
            if marked[end - 1] not in by:
                best[end] = max(best[end], best[end - 1] + coder.unknown)
        ids = coder.encode(t)
        assert coder.score(ids) == pytest.approx(best[-1]) and coder.decode(ids.tolist()) == t


def test_texts_decode_to_themselves(spark, vocabulary):
    import sentencepiece

    df = documents(spark, awkward(random.Random(5)))
    out = sentencepieces.encoded(df, vocabulary)
    rows = out.orderBy("doc_id").collect()
    assert set(df.columns) < set(out.columns)
    assert rows[0].coded.pieces is None and rows[1].coded.pieces == [] and all(r.coded.exact for r in rows if r.text is not None)
    assert rows[5].coded == rows[6].coded
    model = sentencepiece.SentencePieceProcessor(model_file=qs.model_path())
    assert all(model.decode(r.coded.pieces) == r.text for r in rows if r.text and "▁" not in r.text)
    back = sentencepieces.decoded(out.select("doc_id", "coded.pieces"), vocabulary).orderBy("doc_id").collect()
    assert [r.text for r in back] == [r.text for r in rows]
    assert sentencepieces.encoded(documents(spark, []), vocabulary).count() == 0


def test_digests_in_sequence(spark):
    rng = random.Random(6)
    texts = [*awkward(rng), *(text(rng, rng.randint(1, 300)) for _ in range(30))]
    ids = [i * 7 % 43 - 5 for i in range(43)]
    df = documents(spark, texts, ids)
    rank = digest.ranks(digest.entropy_counts(df))
    plain = [t or "" for t in texts]
    assert np.array_equal(digest.entropy_counts(df), digest.histogram([t.encode() for t in plain]))
    got = {r.doc_id: r for r in digest.compared(digest.in_sequence(df, 4000), rank).collect()}
    order = sorted(range(43), key=lambda i: -ids[i])
    assert len(got) == 43
    for i, j in zip(order, order[1:] + order[:1]):
        new = digest.edited(plain[i], plain[j])
        a, b, c = (digest.filters(digest.features([t.encode()], rank)[0]) for t in (plain[i], new, plain[j]))
        r = got[ids[i]]
        assert r.n_chars == len(plain[i]) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest.packed(a), digest.packed(b))
        assert r.near_edited == pytest.approx(digest.likeness(a, b)) and r.near_next == pytest.approx(digest.likeness(a, c))
        assert 0 <= r.near_edited <= 1 and np.array_equal(digest.unpacked(r.fingerprint), a)


def plain_digest(t, rank):
    """A text's chain of filters as sets of bits, by a plain version."""
    x = t.encode()
    mask = 2**64 - 1

    def mixed(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
        return h ^ h >> 31

    if not x:
        hashes = []
    elif len(x) < digest.FEATURE:
        hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")]
    else:
        windows = [x[i : i + digest.FEATURE] for i in range(len(x) - digest.FEATURE + 1)]
        entropy = [-sum(c / 16 * math.log2(c / 16) for c in Counter(w).values()) for w in windows]
        key = [(int(rank[min(digest.N_LEVELS - 1, int(h * digest.LEVELS + 1e-7))]), i) for i, h in enumerate(entropy)]
        run = digest.RUN if len(key) >= digest.SHORT * digest.RUN else max(1, len(key) // digest.SHORT)
        points = Counter(min(key[i : i + run])[1] for i in range(len(key) - run + 1))
        chosen = sorted(i for i, n in points.items() if n >= max(1, run * digest.POINTS // digest.RUN)) or [min(key[:run])[1]]
        inverse = pow(0x9E3779B97F4A7C15, -1, 2**64)
        hashes = [mixed(sum(int(digest._BYTE[c]) * pow(inverse, k, 2**64) for k, c in enumerate(windows[i])) & mask) for i in chosen]
    hashes = list(dict.fromkeys(hashes))
    return [{h >> 11 * k & digest.BITS - 1 for h in hashes[i : i + digest.PER_FILTER] for k in range(digest.HASHES)} for i in range(0, len(hashes), digest.PER_FILTER)]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0

    def like(x, y):
        chance = len(x) * len(y) / digest.BITS
        most = min(len(x), len(y))
        least = chance + digest.CUT * (most - chance)
        return min(1.0, max(0.0, (len(x & y) - least) / max(most - least, 1e-9)))

    mean = lambda xs, ys: sum(max(like(x, y) for y in ys) for x in xs) / len(xs)
    if len(a) == len(b):
        return (mean(a, b) + mean(b, a)) / 2
    return mean(a, b) if len(a) < len(b) else mean(b, a)


def test_digests_are_the_plain_ones(monkeypatch):
    rng = random.Random(16)
    texts = ["", "short", "x" * 16, "ab" * 300, text(rng, 12), text(rng, 60), text(rng, 2500), "é\U0001f600" * 70]
    texts.append(digest.edited(texts[5], texts[4]))
    rank = digest.ranks(digest.histogram([t.encode() for t in texts]))
    plain = [plain_digest(t, rank) for t in texts]
    for piece in (digest.PIECE, 97):
        monkeypatch.setattr(digest, "PIECE", piece)
        assert np.array_equal(digest.ranks(digest.histogram([t.encode() for t in texts])), rank)
        chains = [digest.filters(f) for f in digest.features([t.encode() for t in texts], rank)]
        assert [[set(np.flatnonzero(row).tolist()) for row in c] for c in chains] == plain
    assert len(chains[6]) > 1
    for i, a in enumerate(chains):
        for j, b in enumerate(chains):
            assert digest.likeness(a, b) == pytest.approx(plain_likeness(plain[i], plain[j]), abs=1e-6)


def test_sequences_of_odd_ids(spark):
    """Outlying and shared ids make no large bucket, and every row is followed by the next one."""
    rng = random.Random(17)
    texts = [text(rng, 20) for _ in range(120)]
    ids = [2**62, -(2**62), *range(28), *[5] * 50, *[None] * 40]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = digest.in_sequence(rows.repartition(3), 1000).withColumn("at", F.spark_partition_id()).collect()
    held = Counter(r.bucket for r in got if not r.halo)
    assert len(held) > 10 and max(held.values()) <= 25 and sum(held.values()) == 120
    hashes = {r.text: r.h for r in rows.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(range(120), key=lambda i: (-(ids[i] if ids[i] is not None else -(2**63)), hashes[texts[i]]))
    follows = {texts[i]: texts[j] for i, j in zip(order, order[1:] + order[:1])}
    found = {a.text: b.text for a, b in zip(got, got[1:]) if not a.halo and a.bucket == b.bucket}
    assert found == follows


def test_entropy_levels_are_those_of_the_windows():
    x = np.frombuffer(text(random.Random(7), 200).encode(), np.uint8)
    levels = digest._levels(x)
    for i in range(0, len(levels), 13):
        h = -sum(v / digest.FEATURE * math.log2(v / digest.FEATURE) for v in Counter(x[i : i + digest.FEATURE].tolist()).values())
        assert abs(h * digest.LEVELS - levels[i]) < 1.001


def test_digest_edges(spark):
    rank = digest.ranks(np.zeros(digest.N_LEVELS, np.int64))
    none = digest.compared(digest.in_sequence(documents(spark, [])), rank)
    assert none.count() == 0
    one = digest.compared(digest.in_sequence(documents(spark, ["abc" * 40], [None])), rank).first()
    assert one.doc_id is None and one.near_next == 1.0
    same = digest.compared(digest.in_sequence(documents(spark, ["abc" * 40] * 4, [1, 1, 1, 2])), rank).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same}) == 1
