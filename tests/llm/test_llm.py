"""The corpus operators against brute-force versions, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stratadoc.llm import bpe, exact_dedup, media, mixing, near_dedup, pii, secret_scan, suffix_tree, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string"


def words(r, n, vocabulary=None):
    vocabulary = vocabulary or [a + b + c for a in "btkmsl" for b in "aeiou" for c in ("n", "r", "", "st")]
    return [r.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, odd white space, nulls, an empty and a very long text, repeated rows."""
    r = random.Random(5)
    texts = [" ".join(words(r, r.randint(6, 80))) for _ in range(60)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " ", "\t" + texts[2], None, "", " \n", "one two", "one  two"]
    base = words(r, 200)
    for i in range(12):  # a chain of near copies around one text
        w = list(base)
        for j in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(1000)
        texts.append(" ".join(w))
    texts.append(" ".join(words(r, 20000)))
    out = [(i, t, "en", "s%d" % (i % 4) if i % 9 else None, 1, "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "no id here at all now", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame, *cols):
    return sorted(tuple(r[c] for c in ("doc_id", *cols)) for r in frame.collect() if r["doc_id"] is not None)


def test_near_dedup_links_are_brute_force_links(docs, rows, none):
    distinct = {i: t or "" for i, t, *_ in rows if i is not None}
    sets = {i: near_dedup.shingle_set(t) for i, t in distinct.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        same = distinct[a].split() == distinct[b].split()
        if same or (sets[a] and sets[b] and near_dedup.jaccard(sets[a], sets[b]) >= 0.8):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = by_id(near_dedup.classes(docs), "class_id")
    assert got == sorted((i, root(i)) for i, *_ in rows if i is not None)
    assert near_dedup.classes(none).count() == 0
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {root(i) for i in sets}


def test_probminhash_estimates_probability_jaccard():
    r = random.Random(3)
    a = words(r, 400)
    b = a[:300] + words(r, 100)
    with np.errstate(over="ignore"):
        text, h, w = near_dedup.shingles([[x.encode() for x in a], [x.encode() for x in b]])
        s = near_dedup.signatures(2, text, h, w, 4096)
    weights = [dict(zip(h[text == k].tolist(), w[text == k].tolist())) for k in (0, 1)]
    exact = 0.0
    for i in weights[0].keys() & weights[1].keys():
        every = weights[0].keys() | weights[1].keys()
        exact += 1 / sum(max(weights[0].get(j, 0) / weights[0][i], weights[1].get(j, 0) / weights[1][i]) for j in every)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def recall(pairs) -> dict:
    """Share of pairs that are in a common bucket, by their similarity."""
    met, all_ = Counter(), Counter()
    for a, b in pairs:
        sim = near_dedup.jaccard(near_dedup.shingle_set(a), near_dedup.shingle_set(b))
        band = next((x for x in (0.95, 0.9, 0.85, 0.8) if sim >= x), None)
        if band:
            with np.errstate(over="ignore"):
                one, two = near_dedup.candidate_buckets(2, *near_dedup.shingles([a.encode().split(), b.encode().split()]))
            all_[band] += 1
            met[band] += bool(set(one.tolist()) & set(two.tolist()))
    return {band: (met[band] / n, n) for band, n in all_.items()}


def test_near_dedup_recall_by_similarity():
    """Pairs of every similarity from 0.8 on, with and without lines that one of the texts repeats."""
    r, pairs = random.Random(17), []
    for k in range(500):
        a = [f"d{k}w{i}" for i in range(404)]
        b = list(a)
        for i in r.sample(range(404), r.randint(1, 9)):
            b[i] = f"x{k}_{i}"
        pairs.append((" ".join(a), " ".join(b)))
        line = [f"d{k}l{i}" for i in range(r.choice([10, 40, 60, 80]))]
        pairs.append((" ".join(a), " ".join(a + line * r.choice([1, 5, 60, 300]))))
    found = recall(pairs)
    print(found)
    assert set(found) == {0.8, 0.85, 0.9, 0.95} and all(share >= 0.98 and n >= 60 for share, n in found.values()), found


def test_near_dedup_of_an_id_with_several_texts(spark):
    """Each text of a repeated id is compared, all are in one class, and reruns agree."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(50))
    rows = [(1, text("a")), (2, text("b")), (5, text("a") + " more"), (5, text("b") + " more"), (7, text("c")), (7, text("d")), (7, text("d")), (9, text("d") + " more"), (11, text("e"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(i, 1) for i in (1, 2, 5, 5)] + [(i, 7) for i in (7, 7, 7, 9)] + [(11, 11)])
    for n in (1, 4):
        assert by_id(near_dedup.classes(frame.repartition(n)), "class_id") == want
    assert sorted(r.doc_id for r in near_dedup.representatives(frame).collect()) == [1, 7, 7, 7, 11]


def test_near_dedup_finds_pairs_whose_shingles_repeat_in_one_text_only(spark):
    texts = []
    for i in range(30):
        w = [f"p{i}w{j}" for j in range(244)]
        texts += [" ".join(w[:204]), " ".join(w[:204] + w[204:240] * 51)]
    for a, b in zip(texts[::2], texts[1::2]):
        assert near_dedup.jaccard(near_dedup.shingle_set(a), near_dedup.shingle_set(b)) >= 0.8
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(near_dedup.classes(frame), "class_id") == [(i, i - i % 2) for i in range(60)]


@pytest.mark.parametrize("chars", [near_dedup.BLOCK_CHARS, 6000])
def test_near_dedup_of_a_chain_in_one_bucket(spark, monkeypatch, chars):
    """Members that only a text other than the pivot is near to are still found, in one block or in several."""
    monkeypatch.setattr(near_dedup, "BLOCK_CHARS", chars)
    base = ["w%d" % i for i in range(300)]
    texts = []
    for k in range(24):
        w = list(base)
        for j in range(k * 3):
            w[j * 4 % 300] = f"z{k // 2}_{j}" if j % 2 else f"q{j}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [near_dedup.shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if near_dedup.jaccard(sets[a], sets[b]) >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    assert by_id(near_dedup.classes(frame), "class_id") == list(enumerate(label))


def test_media_round_trip(docs, rows, none):
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, t, *_ in rows:
        n, p = media.payload(t or "")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and p
    stored = media.media_column(docs)
    described = {r.doc_id: r for r in media.described(stored).collect()}
    for r in stored.collect():
        assert hashlib.sha256(r.media).hexdigest() == got[r.doc_id].media_sha256
        assert bytes(described[r.doc_id].thumbnail) == media.payload(dict((i, t) for i, t, *_ in rows)[r.doc_id] or "")[1]
    assert media.digests(none).count() == 0


def slow_hashes(thumb):
    """Both hashes over 8 x 8 boxes, one box after the other; a box of a thumbnail smaller than that is the pixel it begins at."""
    h, w = thumb.shape
    mean = [[0.0] * 8 for _ in range(8)]
    for y in range(8):
        for x in range(8):
            rows = range(y * h // 8, max((y + 1) * h // 8, y * h // 8 + 1))
            cols = range(x * w // 8, max((x + 1) * w // 8, x * w // 8 + 1))
            mean[y][x] = sum(int(thumb[a, b]) for a in rows for b in cols) / (len(rows) * len(cols))
    every = sum(map(sum, mean)) / 64
    bits = lambda f: "%016x" % int("".join("1" if f(y, x) else "0" for y in range(8) for x in range(8)), 2)
    return bits(lambda y, x: mean[y][x] > every), bits(lambda y, x: mean[y][x] > mean[y][(x + 1) % 8])


def test_media_features_are_those_of_the_thumbnail(docs, rows):
    got = {r.doc_id: r.feature for r in media.digests(docs).collect()}
    for i, t, *_ in rows:
        payload = np.frombuffer(media.payload(t or "")[1], np.uint8)
        width = int(got[i].split("x")[0]) // 8
        a, d = slow_hashes(payload.reshape(-1, width))
        assert got[i].split(":")[1:] == [a, d], t


def test_media_with_several_images():
    p = bytes(random.Random(1).randrange(256) for _ in range(576 * (media.MOST_UNITS + 3)))
    images = media.encode([p, p[:576]])
    assert [len(x) for x in images] == [2, 1]
    back = media.thumbnails([b"".join(x) for x in images])
    assert b"".join(t.tobytes() for _, _, t in back[0]) == p and back[1][0][2].tobytes() == p[:576]


class Bits:
    def __init__(self):
        self.n, self.bits = 0, []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("restart", [0, 2])
def test_colour_jpeg_with_subsampling_and_ac_coefficients(restart):
    """A hand-made 4:2:0 image with AC coefficients: the luminance DCs come back."""
    r = random.Random(9)
    width, height = 40, 33  # 3 x 3 MCUs of 16 x 16
    dct = {4: list(range(12))}
    act = {2: [0x00, 0x01], 4: [0x12, 0xF0], 5: [0x25]}
    code = {}
    for cls, t in ((0, dct), (1, act)):
        c = 0
        for n in range(1, 17):
            for s in t.get(n, []):
                code[cls, s] = (c, n)
                c += 1
            c <<= 1
    luma = {}
    scan, out, mcu = b"", Bits(), 0
    pred = [0, 0, 0]
    for my in range(3):
        for mx in range(3):
            if restart and mcu and mcu % restart == 0:
                scan += out.bytes() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
                out, pred = Bits(), [0, 0, 0]
            for comp, b in ((0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0)):
                dc = r.randint(-120, 120)
                if comp == 0:
                    luma[my * 2 + b // 2, mx * 2 + b % 2] = dc
                d, pred[comp] = dc - pred[comp], dc
                s = abs(d).bit_length()
                out.put(*code[0, s])
                out.put(d if d >= 0 else d + (1 << s) - 1, s)
                k = 1
                while k < 60 and r.random() < 0.7:
                    sym = r.choice([0x01, 0x12, 0xF0, 0x25])
                    if k + (sym >> 4) >= 63:
                        break
                    out.put(*code[1, sym])
                    out.put(r.getrandbits(sym & 15) if sym & 15 else 0, sym & 15)
                    k += (sym >> 4) + 1
                out.put(*code[1, 0])
            mcu += 1
    scan += out.bytes()
    frame = b"\xff\xc0" + (17).to_bytes(2, "big") + bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8\xff\xe0\x00\x04ab" + media._DQT + frame + media._table(0, 0, dct) + media._table(1, 0, act)
    data += (b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")) if restart else b""
    data += b"\xff\xda\x00\x0c" + bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]) + scan + b"\xff\xd9"
    ((w, h, thumb),) = media.thumbnails([data])[0]
    assert (w, h, thumb.shape) == (40, 33, (5, 5))
    assert all(thumb[y, x] == luma[y, x] + 128 for y in range(5) for x in range(5))
    with pytest.raises(ValueError):
        media.thumbnails([b"no image"])


def test_toxicity_learns_a_word_and_keeps_to_its_folds(spark, none):
    r = random.Random(2)
    rows = []
    for i in range(400):
        w = words(r, 40)
        if i % 4 == 0:
            w[r.randrange(40)] = r.choice(["vilenous", "vilenesque", "vilenal"])
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(5000, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    texts, y = toxicity.sample(frame, labels)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert len(texts) == len(train) and y.sum() == sum(i % 4 == 0 for i in train)
    got = {r.doc_id: r.score for r in toxicity.scored(frame, toxicity.fit(texts, y)).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if i not in train]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    untrained = toxicity.train(none, labels.limit(0))
    assert toxicity.scored(none, untrained).count() == 0
    assert len({r.score for r in toxicity.scored(frame, untrained).collect()}) == 1
    kept = toxicity.accepted(frame.withColumn("score", frame.doc_id), toxicity.fit(texts, y))
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_gradients_and_convolution():
    """The gradients are the slopes of the loss, and the outputs those of a convolution done window by window."""
    words_, r = toxicity.Words(1 << 60), np.random.default_rng(4)
    texts = ["alpha beta gamma", "beta", "", "delta alpha alpha epsilon beta"]
    each = [words_.read([t])[0] for t in texts]
    ids, starts = toxicity.batch(each, np.arange(4))
    model = toxicity.Model(3)
    model.embed = r.normal(0, 0.5, model.embed.shape)
    model.embed[-1] = 0
    model.filters = [f.astype(np.float64) for f in model.filters]
    model.bias, model.out = r.normal(0, 0.3, model.bias.shape), model.out.astype(np.float64)

    def slow(text):
        vectors = [model.embed[words_.hashes[words_.number[w]]].sum(0) for w in text.split()]
        pooled = []
        for width, f in zip(toxicity.WIDTHS, model.filters):
            pad = [np.zeros(toxicity.DIM)] * (width - 1)
            line = pad + vectors + pad if vectors else [np.zeros(toxicity.DIM)] * width
            pooled.append(np.max([sum(line[a + k] @ f[k] for k in range(width)) for a in range(len(line) - width + 1)], axis=0))
        return np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.prior[0]

    assert np.allclose(model.output(ids, starts, words_.hashes), [slow(t) for t in texts], atol=1e-5)
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.5, 1.0, 0.7, 2.0])

    def loss():
        z = model.output(ids, starts, words_.hashes).astype(np.float64)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).mean())

    grads = model.step(ids, starts, words_.hashes, y, weight)
    at, each_ = grads["embed"]
    grads["embed"] = np.zeros_like(model.embed)
    np.add.at(grads["embed"], at, each_[:, None, :])
    some = words_.hashes[words_.number["alpha"]][0]
    for array, grad, at in (
        *[(f, g, (0, 3, k)) for f, g in zip(model.filters, grads["filters"]) for k in range(0, 8, 3)],
        *[(model.out, grads["out"], (k,)) for k in range(0, 24, 5)], *[(model.bias, grads["bias"], (k,)) for k in range(0, 24, 5)], *[(model.embed, grads["embed"], (some, k)) for k in range(0, 16, 5)],
    ):
        was, step = array[at], 1e-5
        array[at] = was + step
        up = loss()
        array[at] = was - step
        slope = (up - loss()) / (2 * step)
        array[at] = was
        assert abs(slope - grad[at]) < 1e-3 * max(1, abs(slope)) and np.isfinite(slope)


def test_toxicity_thresholds_by_language(spark):
    """Outputs of one language lie higher than those of the other; a language without labels of both kinds has the common threshold."""
    r = np.random.default_rng(5)
    lang = np.repeat([0, 1, 2], [200, 200, 20])
    y = np.where(lang < 2, np.arange(420) % 2, 0).astype(np.float32)
    z = np.where(lang == 0, 4.0, 0.0) + 2.0 * y + r.uniform(-0.9, 0.9, 420)
    t = toxicity.calibrated(z, y, lang)
    assert 4.5 < t[0] < 5.3 and 0.8 < t[1] < 1.6 and t[2] == t[3] == np.float32(toxicity.threshold(z, y))
    assert toxicity.threshold(np.ones(4), np.array([1, 0, 1, 0])) != 1.0  # a tie is on one side of it
    en, fr = "the of and to in", "le les des une et"
    gen = random.Random(7)
    rows = [(i, " ".join(words(gen, 15) + (en if i % 2 else fr).split() + (["zorg" if i % 2 else "quorl"] if i % 3 == 0 else []))) for i in range(300)]
    model = toxicity.fit([t for _, t in rows], np.array([i % 3 == 0 for i, _ in rows], np.float32))
    long = "the " * 100000 + "zorg"
    frame = spark.createDataFrame(rows + [(5, rows[5][1]), (900, long), (901, "the " * 100000)], "doc_id long, text string")
    got = toxicity.scored(frame, model).collect()
    assert len(got) == 303 and len({x.score for x in got if x.doc_id == 5}) == 1
    by = {x.doc_id: x for x in got}
    assert {by[1].language, by[2].language} == {"en", "fr"} and by[900].score > by[901].score
    assert np.mean([(by[i].score >= 0.5) == (i % 3 == 0) for i in range(300)]) > 0.95


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    assert len(got) == len(rows)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in order})
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, source = defaultdict(int), {i: s for i, _, _, s, *_ in rows}
    for r in got:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    total = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(total - sum(sizes.values())) <= 5


def test_mixing_is_a_queue_by_finish_time(spark):
    """Document by document in one sorted list, cut at the total budget; rows that are repeated do not disturb it."""
    r = random.Random(14)
    rows = [(i, " ".join(words(r, r.choice([0, 1, 5, 40, 400]))), f"s{r.randrange(7)}" if i % 20 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = {x.doc_id: x for x in mixing.mix(frame).collect()}
    order = sorted(rows, key=lambda x: (int(hashlib.md5(b"%d/mix" % x[0]).hexdigest()[:15], 16), x[0]))
    line = []
    for source in {x[2] for x in rows}:
        at, target = 0, next(got[i].target for i, _, s in rows if s == source)
        for e in range(3):
            for k, (i, t, s) in enumerate(order):
                if s == source:
                    n = len(t.split())
                    line.append(((at + n) / target, source is None, source or "", k, i, max(0, min(n, math.floor(target + 0.5) - at))))
                    at += n
    left, taken = sum(len(t.split()) for _, t, _ in rows), Counter()
    for *_, i, n in sorted(line):
        taken[i] += min(n, left)
        left -= min(n, left)
    assert {i: x.taken for i, x in got.items()} == {i: taken[i] for i in got} and left <= 7
    again = frame.unionByName(frame.filter("doc_id < 40")).unionByName(frame.filter("doc_id < 9"))
    seen = [sorted((x.doc_id, x.text, x.source or "") for x in mixing.mixed(again.repartition(n)).collect()) for n in (2, 5)]
    assert seen[0] == seen[1]


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for text, members in groups.items():
        keep = min(members)[3]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for *_, i in members]
    got = [tuple(r) for r in exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(min(m)[3]) for m in groups.values())
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


def test_warc_audit_finds_every_fault(spark):
    r = random.Random(4)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}/", " ".join(words(r, 20))) for i in range(700)] + [(5, "http://h5/", "again"), (None, None, None), (None, None, None)], "page_id long, url string, html string")
    placed = warc.catalog(pages, 64)
    assert placed.select("place").distinct().count() == 703
    same = placed.select("place", "hash")
    assert {x.status for x in warc.audit(placed, same).collect()} == {"ok"}
    from pyspark.sql import functions as F

    bad = same.filter("place % 50 != 7").withColumn("hash", F.when(F.col("place") % 97 == 3, F.lit("x")).otherwise(F.col("hash")))
    got = {x.place: x.status for x in placed.join(warc.audit(placed, bad).select("archive", "start", "status"), ["archive", "start"]).collect()}
    assert all(s == ("lost" if p % 50 == 7 else "damaged" if p % 97 == 3 else "ok") for p, s in got.items()) and len(got) == 703
    empty = pages.limit(0)
    assert warc.audit(warc.catalog(empty), warc.catalog(empty).select("place", "hash")).count() == 0


def warc_record(i, b):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/%d\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i, i, len(b), b)


def test_warc_files(spark, tmp_path):
    import gzip

    bodies = [b"abc", b"", b"line\r\n\r\nWARC/1.0 inside"]
    each = [warc_record(i, b) for i, b in enumerate(bodies)]
    (tmp_path / "a.warc").write_bytes(b"".join(each))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, each)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(each)) + gzip.compress(each[0]))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.block)) for r in got) == sorted([(f"<urn:{i}>", b) for i, b in enumerate(bodies)] * 3 + [("<urn:0>", b"abc")])
    assert {r.hash for r in got} == {hashlib.sha256(x).hexdigest() for x in each} and {r.error for r in got} == {None}
    assert [r.start for r in got if r.path.endswith("a.warc")] == [0, len(each[0]), len(each[0] + each[1])]
    assert warc.read_archives(spark, str(tmp_path), blocks=False).filter("block is null").count() == 10


@pytest.mark.parametrize("piece", [warc.PIECE, 3])
def test_malformed_warc_files(monkeypatch, piece):
    import gzip

    monkeypatch.setattr(warc, "PIECE", piece)
    each = [warc_record(i, b"body %d" % i) for i in range(4)]
    found = lambda data: [(bytes(raw), error) for _, _, raw, _, _, error in warc.parse(data)]
    good = [(x, None) for x in each]
    lost = each[1].replace(b"Content-Length", b"Content-Lungth")
    assert found(b"".join([each[0], lost, *each[2:]])) == [good[0], (lost, "no length"), *good[2:]]
    assert found(each[0] + b"junk\r\n\r\n" + each[1]) == [good[0], (b"junk\r\n\r\n", "no record"), good[1]]
    assert found(each[0] + each[1][:-10]) == [good[0], (each[1][:-10], "truncated record")]
    assert found(b"\r\n\r\n" + each[0] + each[1][:-4]) == [good[0], (each[1][:-4], None)] and found(b"") == []
    z = [gzip.compress(x) for x in each]
    torn = found(z[0] + z[1][:-12])
    assert torn[0] == good[0] and torn[-1] == (z[1][:-12], "truncated member")
    wrong = bytearray(z[1])
    wrong[-5] ^= 1
    damaged = found(z[0] + bytes(wrong) + z[2])
    assert damaged[0] == good[0] and damaged[-1] == good[2] and any(e and e.startswith("damaged member") for _, e in damaged)
    assert found(z[0] + b"junk" + z[2]) == [good[0], (b"junk", "no member"), good[2]]


def test_a_large_warc_file_is_read_in_seconds():
    import gzip
    import time

    body = random.Random(3).randbytes(5000)
    data = b"".join(gzip.compress(warc_record(i, body), 1) for i in range(20000))
    start = time.perf_counter()
    assert len(data) > 100_000_000 and sum(1 for *_, error in warc.parse(data) if error is None) == 20000
    assert time.perf_counter() - start < 30


def test_warc_extra_records_and_written_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 100000 if i == 3 else f"é body {i}\r\n\r\nWARC/1.0", i) for i in range(40)] + [(None, None, None, 1)] * 2, "page_id long, url string, html string, hash int")
    placed = warc.catalog(pages, 16)
    warc.write_archives(pages.filter("page_id is null or page_id <> 5").unionByName(spark.createDataFrame([(99, "http://new", "n", 1)], pages.schema)), str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"))
    assert read.filter("error is not null").count() == 0
    got = Counter((r.status, r.page_id, r.url) for r in warc.audit(placed, warc.placed_by_id(read, placed)).collect())
    assert got == Counter([("ok", i, f"http://h/{i}") for i in range(40) if i != 5] + [("ok", None, None)] * 2 + [("lost", 5, "http://h/5"), ("extra", None, "http://new")])


BASE_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]
PII_TEXTS = [
    None, "", "mail a.b+c@x-y.co.uk, b@c.de@f.gh and @x.y z@z", "a@b.c_x@d.e", "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 49927398716", "call +1 (017) 555-7713 now +49 30 1234567890123456 +12",
    "IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "ssn 123-45-6789", "é" * 50 + " x@y.zz", "9" * 3000 + ".1.1.1", "a" * 3000 + "@" + "b" * 10,
]


def noise(r, pieces, n):
    return "".join(r.choice(pieces) for _ in range(n))


def test_pii_base_spans_are_those_of_the_patterns(spark, none):
    r = random.Random(8)
    pieces = ["a", "7", "12", ".", "@", "+", "-", " ", "(", ")", "b.c", "4111111111111111", "1.2.3.4", "é", "%", "x@y.z"]
    texts = PII_TEXTS + [noise(r, pieces, r.randint(1, 60)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.scan(frame).collect():
        spans = [(k, m.start(), m.end()) for k, p, ok in BASE_PII for m in re.finditer(p, texts[row.doc_id] or "") if ok(m[0])]
        joined = ",".join("%s:%d:%d" % s for s in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k, *_ in BASE_PII]
        assert row.spans.startswith(joined)
    by = {r.doc_id: r for r in pii.scan(frame).collect()}
    assert by[7].n_iban == 1 and by[8].n_ssn == 1
    assert pii.score("card", "my visa card 4111", 13, 17) > pii.score("card", "order 4111", 6, 10)
    assert pii.scan(none).count() == 0


def test_pii_context_is_of_whole_words_and_texts_may_be_long_or_repeated(spark):
    at = "the recipient of hotel ship 1.2.3.4 cardigan"
    assert pii.score("ip", at, 28, 35) == pii.PRIOR["ip"]
    assert pii.score("ip", "an IP: 1.2.3.4", 7, 14) > pii.PRIOR["ip"] > pii.score("ip", "version 1.2.3.4", 8, 15)
    assert pii.nearby("x" * 30 + "ip " + "y" * 38 + " 1.2.3.4", 72, 79) == {"y" * 38}
    long = "pad " * 300000 + "a@b.cd 4111 1111 1111 1111"
    frame = spark.createDataFrame([(1, long, "s", "k"), (1, long, "s", "k"), (2, "a@b.cd", "s", "k")], "doc_id long, text string, spans string, n_email string")
    got = pii.scan(frame).collect()
    assert sorted((r.doc_id, r.n_email, r.n_card) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 0)]
    assert {r.spans for r in got if r.doc_id == 1} == {f"email:{len(long) - 26}:{len(long) - 20},card:{len(long) - 19}:{len(long)}"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("GB29 NWBK 6016 1331 9268 19 GBP 500", ["GB29 NWBK 6016 1331 9268 19"]),
        ("DE89370400440532013000 2 days", ["DE89370400440532013000"]),
        ("REF AB12 DE89370400440532013000 GB29NWBK60161331926819", ["DE89370400440532013000", "GB29NWBK60161331926819"]),
        ("NO93 8601 1117 947 AND NO93 8601 1117 948 X", ["NO93 8601 1117 947"]),
    ],
)
def test_an_iban_ends_at_its_own_length(text, want):
    assert [text[a:b] for k, a, b, _ in pii.find(text) if pii.KINDS[k] == "iban"] == want


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_scan(spark, none):
    r = random.Random(6)
    pieces = ["password", "token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "x", "é", ".", "0123456789abcdef0123", "\n", "𝒳"]
    texts = [None, "", "token:ab password = 'abcdefghijklmnop'", "ghp_" + "a1" * 15] + [noise(r, pieces, r.randint(1, 40)) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, "s%d" % (i % 3) if i % 5 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {x.doc_id: x for x in secret_scan.scan(frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = brute_secrets(t or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert got[3].n_vendor == 1 and got[3].spans.startswith("vendor:0:34")
    shared, own = "token=" + "Q" * 20, "token=" + "R" * 20
    frame = spark.createDataFrame([(1, shared, "a"), (2, shared, "b"), (3, own, "a"), (4, own, "a"), (5, shared, "b")], "doc_id long, text string, source string")
    got = {x.doc_id: (x.n_live, x.n_shared, x.most_repositories) for x in secret_scan.scan(frame).collect()}
    assert got == {1: (0, 1, 3), 2: (0, 1, 3), 3: (1, 0, 2), 4: (1, 0, 2), 5: (0, 1, 3)}
    assert secret_scan.scan(none).count() == 0


def test_secrets_of_a_long_text_and_of_a_hot_value(spark, monkeypatch):
    """Two megabytes of spans, clashing columns, and a value that most rows hold."""
    from stratadoc.functions import tables

    value = lambda i: hashlib.md5(b"%d" % i).hexdigest()
    long = " é ".join(value(i) for i in range(60000))
    rows = [(0, long, "a", "x", "x")] + [(i, "token=" + "Q" * 20 if i % 3 else "key " + value(i), "ab"[i % 2], "x", "x") for i in range(1, 4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, t string")
    for most in (tables.HOT_KEYS, 2):
        monkeypatch.setattr(tables, "HOT_KEYS", most)
        got = {x.doc_id: x for x in secret_scan.scan(frame).collect()}
        assert len(got) == 4000 and got[0].n_hex == 60000 and got[0].spans.endswith("hex:%d:%d" % (len(long) - 32, len(long)))
        assert got[0].base_sha256 == hashlib.sha256(",".join(f"hex:{35 * i}:{35 * i + 32}" for i in range(60000)).encode()).hexdigest()
        assert (got[1].n_live, got[1].n_shared, got[1].most_repositories) == (0, 1, 2666) and (got[3].n_live, got[3].n_shared) == (0, 1)


def test_language_model(docs, rows, none):
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t, *_ in rows]
    train = [w for (i, *_), w in zip(rows, tokens) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    term = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((i, len(t) + 1, sum(w in c for w in t) + 1, n, round(sum(term(c[w]) for w in t) + term(ends), 6)) for (i, *_), t in zip(rows, tokens) if i is not None)
    got = suffix_tree.scored(docs).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    same = {r.score for r in got if r.doc_id == 3}
    assert len(same) == 1
    assert suffix_tree.scored(none).count() == 0
    lonely = docs.limit(0).unionByName(docs.filter("doc_id = 10"))
    assert suffix_tree.scored(lonely).count() == 1


def test_tree_is_a_distribution_and_uses_the_longest_node(spark):
    r = random.Random(1)
    each = [[w.encode() for w in words(r, 60)] for _ in range(200)]
    data, starts, places = suffix_tree.streams(each)
    key, n = np.unique(suffix_tree.windows(data, places), return_counts=True)
    nexts, nodes = [], []
    for d in range(suffix_tree.DEPTH + 1):
        k, m = suffix_tree.merged([(key & suffix_tree._mask(d + 1), n)])
        ctx, at = np.unique(k >> 8, return_inverse=True)
        nexts.append((k, m))
        nodes.append((ctx, np.bincount(at, m).astype(np.int64), np.bincount(at)))
    tree = suffix_tree.Tree(nexts, nodes)
    for ctx in (b"\n\n\n\n\n", b"\n\n\nba", b"n ban", b"zzzzz"):
        window = (int.from_bytes(ctx, "big") << 8) | np.arange(256)
        assert abs((10.0 ** tree.logs(window).astype(float)).sum() - 1) < 1e-4
    logs = tree.logs(suffix_tree.windows(data, places)).astype(float)
    assert abs(tree.scores(each).sum() - logs.sum()) < 1e-6 * abs(logs.sum())
    flat = tree.zero[data[places]].sum()
    assert logs.sum() > 0.8 * flat


def test_scores_are_those_of_the_whole_tree(spark, monkeypatch):
    """A context that few texts of a large corpus have counts too, whether its windows are broadcast or joined."""
    r = random.Random(12)
    texts = [" ".join(words(r, 1500)) for _ in range(400)]
    for i in (11, 12, 13, 14):
        texts[i] += " zqxvk" * 2
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts[held[0]] += " zqxvk zqxvj"
    each = [t.encode().split() for t in texts]
    data, _, places = suffix_tree.streams([w for i, w in enumerate(each) if i not in held])
    key, n = np.unique(suffix_tree.windows(data, places), return_counts=True)
    nexts, nodes = [], []
    for d in range(suffix_tree.DEPTH + 1):
        k, m = suffix_tree.merged([(key & suffix_tree._mask(d + 1), n)])
        ctx, at = np.unique(k >> 8, return_inverse=True)
        count = np.bincount(at, m).astype(np.int64)
        often = (count >= 2) | (d == 0)
        nexts.append((k[often[at]], m[often[at]]))
        nodes.append((ctx[often], count[often], np.bincount(at)[often]))
    tree = suffix_tree.Tree(nexts, nodes)
    want = tree.scores(each)
    assert tree.logs(np.array([int.from_bytes(b" zqxvk", "big")]))[0] > -0.2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for share in (None, 1e-4):
        if share:
            monkeypatch.setattr(suffix_tree, "P_HEAD", share)
        got = {x.doc_id: x.score for x in suffix_tree.scored(frame).collect()}
        assert max(abs(got[i] - want[i]) for i in got) < 0.01 and len(got) == 400


class SlowTree:
    """The same tree by dictionaries of byte strings, one text and one byte at a time."""

    def __init__(self, texts):
        self.count, self.next = Counter(), defaultdict(Counter)
        for t in texts:
            for ctx, b in self.steps(t):
                for d in range(suffix_tree.DEPTH + 1):
                    c = ctx[len(ctx) - d :]
                    self.count[c] += 1
                    self.next[c][b] += 1
        often = {c for c, n in self.count.items() if c and n >= suffix_tree.LEAST}
        keep = {c for c in often if len(c) < suffix_tree.SHARD or self.information(c) >= suffix_tree.DIVERGENCE}
        self.nodes = {c[k:] for c in keep for k in range(len(c))} | {b""}

    @staticmethod
    def steps(t):
        data = suffix_tree.END * suffix_tree.DEPTH + b" ".join(suffix_tree.words(t)) + suffix_tree.END
        return [(data[i - suffix_tree.DEPTH : i], data[i]) for i in range(suffix_tree.DEPTH, len(data))]

    def information(self, c):
        shorter = c[1:]
        return sum(n * math.log(n / self.count[c] / (self.next[shorter][b] / self.count[shorter])) for b, n in self.next[c].items())

    def p(self, c, b):
        while c not in self.nodes:
            c = c[1:]
        if not c:
            return (self.next[c][b] + 1) / (self.count[c] + 256)
        named, mass = self.next[c], suffix_tree.MASS * len(self.next[c])
        one = lambda x: (named[x] + mass * self.p(c[1:], x)) / (self.count[c] + mass)
        if b in named:
            return one(b)
        return self.p(c[1:], b) * (1 - sum(map(one, named))) / (1 - sum(self.p(c[1:], x) for x in named))

    def score(self, t):
        return sum(math.log10(self.p(ctx, b)) for ctx, b in self.steps(t))


def test_the_tree_is_that_of_dictionaries(spark):
    r = random.Random(21)
    texts = [" ".join(words(r, r.randint(0, 60))) + (" Señor 漢字 mixed" if i % 9 == 0 else "") for i in range(120)] + [None]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    tree = SlowTree([t for t, h in zip(texts, held) if not h])
    assert any(len(c) == suffix_tree.DEPTH for c in tree.nodes) and any(c not in tree.nodes for c in tree.count)
    got = {x.doc_id: x for x in suffix_tree.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = tree.score(t)
        assert abs(got[i].score - want) < 1e-4 * abs(want) + 1e-3 and got[i].held_out == held[i], (i, got[i].score, want)


def test_bpe_is_tiktoken(docs, rows, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t, *_ in rows:
        ids = ref.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].exact) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True)
    assert bpe.round_trip(none).count() == 0
    assert {r.doc_id: list(r.ids) for r in bpe.encoded(docs).collect()}[0] == ref.encode_ordinary(rows[0][1])
    enc, r = bpe.Encoder(ranks, P.PATTERN), random.Random(3)
    for _ in range(300):
        x = noise(r, ["a", "the", "é", "ß", "漢", "😀", " ", "\n", "'s", "0", "12", "!", "==", "\t", "𝒳", "ing"], r.choice([3, 40, 400]))
        ids = ref.encode_ordinary(x)
        assert memoryview(enc.encode(x)).cast("I").tolist() == ids
        d = bpe.StreamDecoder(enc.fst.tokens)
        assert "".join(d.feed([k])[1] for k in ids) + d.finish() == x


def test_bpe_emits_after_bounded_lookahead(monkeypatch):
    import public_tokenizers as P

    fst, r = bpe.Transducer(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), random.Random(2)
    for every in (3, 7, 64):
        monkeypatch.setattr(bpe, "EMIT_EVERY", every)
        for _ in range(60):
            piece = noise(r, "abcdeinorst", r.choice([5, 50, 90])).encode()
            assert fst.encode(piece) == fst.merged(piece)


def test_pipeline_of_an_odd_and_of_an_empty_table(spark, docs, rows, none, tmp_path):
    """Nulls, repeated rows, clashing columns and no rows at all go through every stage."""
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0, None) for i in range(0, 70)], "doc_id long, quality int, toxic boolean, score double").selectExpr("doc_id", "quality", "cast(toxic as int) toxic", "score")
    for name, frame in (("odd", docs), ("none", none)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert got and all(r.exact for r in got) and {r.doc_id for r in got} <= {i for i, *_ in rows}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = exact_dedup.stage(step(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
    assert near_dedup.classes(docs).filter("not kept").count() == 0
    assert exact_dedup.groups(docs).filter("not kept").count() == 0
    last = corpus_pipeline.run(spark, sf)
    assert last.filter("not exact").count() == 0 and last.count() > 0
