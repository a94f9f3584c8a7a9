"""Spelling variants, ranked search and toxicity: brute force, plain reimplementations, planted cases and edge cases."""
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm import edge_rows, frame  # noqa: E402

from slotworks.llm import lexical_search, near_dup, spelling, toxicity  # noqa: E402
from slotworks.llm.queries import QUERIES, table  # noqa: E402
from slotworks.llm.runs import latin_runs, terms  # noqa: E402
from slotworks.llm.words import Words, slices  # noqa: E402

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- runs of bytes

def test_runs_are_the_matches_of_their_patterns():
    texts = ["", None, "Aé×b÷c 12ÿÀx_yĀz\x00q", "Ünïcode-Wörter, Ä", "x" * 10, "日本語テキスト abc", "\xa0nbsp\x85", "ĀāĂ À"]
    for found, pattern in ((terms, TERM), (latin_runs, RUN)):
        for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
            words = found(array)
            assert words.flat.to_pylist() == [w.translate(LOW) for t in texts for w in pattern.findall(t or "")]
            assert words.n.tolist() == [len(pattern.findall(t or "")) for t in texts]


def test_slices_of_a_batch_give_the_same_words_and_shingles():
    """Lower-casing once read the wrong bytes of all slices but the first."""
    texts = [None, "", "Ünï CODE Wörter"] + [f"Word{i} " * (i % 40) + f"Ä{i} ÉB{i * 7} c d e f G" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for lower in (False, True):
        want = [w for t in texts for w in re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOW) if lower else (t or ""))]
        assert [w for p in slices([batch], "text", 500) for w in Words(p.column("text"), lower).flat.to_pylist()] == want
        assert [w for at in range(0, len(texts), 7) for w in Words(batch.column(0).slice(at, 7), lower).flat.to_pylist()] == want
    one = [near_dup.shingle_sets(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert [s.tolist() for p in slices([batch], "text", 500) for s in near_dup.shingle_sets(p.column("text"))] == one


# ---- 11 spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_the_sorted_scan_finds_every_pair_of_random_lists():
    for seed in range(400):
        rng = random.Random(seed)
        shared = rng.choice([0, 1, 3])
        words = sorted({"xyz"[:shared] + "".join(rng.choice("abé"[:rng.choice([2, 3])]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30))})
        want = [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j])]
        assert sorted(spelling.neighbours(words, shared)) == want


@pytest.mark.parametrize("most", [2, 7, 4096])
def test_near_words_are_found_once_however_lists_are_split(spark, most):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(250)} | {"", "a", "ab", "b", "abc"})
    found = [(r["a"], r["b"]) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), most).collect()]
    assert len(set(found)) == len(found)
    assert set(found) == {(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}


def brute_variants(rows, length=6, least=5, every=199):
    counts = Counter()
    for key, text in rows:
        for r in RUN.findall(text or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{r}".encode())
            if h % every == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            counts[r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants_match_brute_force(spark):
    rng = random.Random(9)
    base = ["letter", "lantern", "Straßé", "window", "garden"]
    texts = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = rng.choice(base)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "y"]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, " ".join(words)))
    texts += [(100 + i, "gardenx " * 10 + "gardenxy " * 2) for i in range(10)]
    texts += [(None, "lanternx " * 7), (3, None), (4, ""), (5, "lantern")] + [texts[0]]
    found = {tuple(r) for r in spelling.spelling_variants(frame(spark, texts), every=7).collect()}
    assert found == brute_variants(texts, every=7)
    assert any(r[1] and r[2] != r[1] for r in found)  # a chain of two forms
    edge = {tuple(r) for r in spelling.spelling_variants(frame(spark, edge_rows())).collect()}
    assert edge == brute_variants(edge_rows())
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_long_chains_of_forms_are_followed_to_the_end(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    found = dict(tuple(r) for r in spelling.followed(spark.createDataFrame(chain, "word string, form string")).collect())
    assert found == {f"w{i}": "w20" for i in range(20)}


# ---- 12 ranked search

def brute_search(rows, items, k=10):
    docs = [(key, TERM.findall((text or "").translate(LOW))) for key, text in rows]
    docs = [(key, Counter(w), len(w)) for key, w in docs if w]
    total, length = len(docs), sum(n for *_, n in docs)
    asked = defaultdict(set)
    for key, text in items:
        if key is not None:
            asked[key].update(TERM.findall((text or "").translate(LOW)))
    out = []
    for item, words in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(w in c for _, c, _ in docs) + 1))) for w in words}
        scored = []
        for key, c, n in docs:
            m = 10 + 90 * n * total // length
            s = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, key is None, key))
        out += [(item, r, key, -s) for r, (s, _, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [400, 1 << 24])
def test_search_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lexical_search, "SLICE", size)  # small slices: thresholds carry over from one to the next
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, "w1 w2 rare"), (7, "w1, W1; w2"), (7, "w1, W1; w2"), (400, None), (401, ""), (402, " \t"), (403, "é日本 W5")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(30)] + [(None, "w1"), (50, None), (51, "..."), (52, "é日本 rare w1"), (52, "w2 w3"), (53, "absent")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((tuple(r) for r in lexical_search.search(frame(spark, rows).repartition(3), asked).collect()), key=str)
    assert found == brute_search(rows, items)


def test_search_in_blocks_of_queries_gives_the_same(spark):
    rows = [(i, f"alpha beta{i % 7} gamma{i % 3} delta{i}") for i in range(50)]
    asked = spark.createDataFrame([(i, f"beta{i} gamma{i % 3} alpha") for i in range(7)], "item_id bigint, text string")
    a, b = (sorted(tuple(r) for r in lexical_search.search(frame(spark, rows), asked, block=n).collect()) for n in (2, 100))
    assert a == b and len(a) == 70


def test_accumulators_are_limited_and_scores_stay_exact():
    rng = np.random.default_rng(3)
    n, many = 5000, 12
    held = [np.sort(rng.choice(n, size, replace=False)) for size in np.geomspace(15, 4500, many).astype(int)]
    row = {"length": rng.integers(5, 200, n), "terms": np.arange(many), "ends": np.cumsum([len(h) for h in held]),
           "spot": np.concatenate(held), "tf": rng.integers(1, 4, sum(len(h) for h in held))}
    weight = lexical_search.weights(np.array([len(h) for h in held]), n)
    part = lexical_search.Slice(row, weight, n, int(row["length"].sum()), 90)
    full = np.bincount(row["spot"], part.part, n).astype(np.int64)
    spots, scores = part.best(np.arange(many), 10, 0)
    assert np.array_equal(scores, full[spots]) and len(spots) < np.count_nonzero(full) / 2
    assert sorted(scores)[-10:] == sorted(full)[-10:]
    assert not len(part.best(np.arange(many), 10, int(full.max()) + 1)[0])


def test_search_of_edge_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "one two three")], "item_id bigint, text string")
    found = sorted((tuple(r) for r in lexical_search.search(frame(spark, edge_rows()), items).collect()), key=str)
    assert found == brute_search(edge_rows(), [(1, "alpha beta"), (2, "one two three")])
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark, edge_rows()), items.limit(0)).count() == 0


# ---- 13 toxicity

@pytest.fixture(scope="module")
def decoder(spark):
    return toxicity.Decoder(toxicity.character_model(table(spark, "/root/testdata/sf0.01", "documents")))


@pytest.mark.parametrize("seen,words", [("1d10t", "idiot"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("tr@sh", "trash"),
                                        ("l-o-s-e-r", "loser"), ("cl0wn", "clown"), ("scuuum", "scum"), ("1 d 1 0 t", "idiot"), ("you-idiot", "you idiot")])
def test_disguised_words_are_restored(decoder, seen, words):
    assert decoder.restore(seen) == words.split()


def test_viterbi_takes_the_cheapest_path_of_the_lattice(decoder):
    table_, size = decoder.model.cost, toxicity.LETTERS ** 2

    def cost(ways):
        total, state = 0.0, 0
        for letters, extra in [*ways, ((0,), 0.0)]:
            total += extra
            for x in letters:
                if x == 0 and state == 0:
                    continue
                total += float(table_[state, x])
                state = 0 if x == 0 else (state % size) * toxicity.LETTERS + x
        return total

    def spelled(ways):
        return [w for w in "".join(chr(96 + x) for letters, _ in ways for x in letters).split("`") if w]

    for seen in ("1d10t", "a$$b", "5.c.u", "e11e*", "aaab0", "x"):
        every = list(itertools.product(*decoder.lattice(seen)))
        best = min(map(cost, every))
        assert any(abs(cost(w) - best) < 1e-4 and spelled(w) == decoder.decode(seen) for w in every)


def test_character_counts_match_brute_force(spark):
    rows = [(1, "Ab, ab! Éa"), (2, None), (3, "x9y --- aaa"), (None, "ab"), (4, "ßé")]
    found = toxicity.character_model(frame(spark, rows)).cost
    total = Counter()
    for w in ["ab", "ab", "ea", "ab", "{e"]:  # others are not plain
        codes = [0, 0, 0, *(ord(c) & 31 for c in w), 0]
        total.update(tuple(codes[i:i + 4]) for i in range(len(codes) - 3))
    keys = np.array([((a * 28 + b) * 28 + c) * 28 + d for a, b, c, d in total])
    assert np.allclose(found, toxicity.CharacterModel.of_counts(keys, np.array(list(total.values()))).cost)


def test_features_of_texts_match_brute_force(decoder):
    texts = ["Idiot idiot, 1d10t and s c u m!", None, "", "fine words here " * 50 + "trash", "of a"]
    text, feature = toxicity.gram_levels(pa.array(texts), decoder)
    want = set()
    for i, words in enumerate([["idiot"] * 3 + ["and", "s", "c", "u", "m", "scum"], [], [], ["fine", "words", "here"] * 50 + ["trash"], ["of", "a"]]):
        grams = Counter()
        for w in words:
            codes = [0, *(ord(c) & 31 for c in w), 0]
            for n in toxicity.GRAMS:
                for p in range(len(codes) - n + 1):
                    v = 0
                    for c in codes[p:p + n]:
                        v = v * 28 + c
                    grams[v + 28 ** n - 28 ** toxicity.GRAMS[0]] += 1
        for g, n in grams.items():
            want.add((i, 3 * g))
            if n >= 2 and 200 * n >= len(words):
                want.add((i, 3 * g + 1))
            if n >= 3 and 60 * n >= len(words):
                want.add((i, 3 * g + 2))
    assert set(zip(text.tolist(), feature.tolist())) == want


def test_held_out_toxicity(spark):
    root = "/root/testdata/sf0.1"
    labels = table(spark, root, "labels").filter("toxic IS NOT NULL").select("doc_id", "toxic")
    found = QUERIES["op13_toxicity"](spark, root).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert len(toxic) > 80 and toxic.predicted.mean() > 0.88 and clean.predicted.mean() < 0.02
    order = found.score.rank()
    auc = (order[found.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.93


def test_disguised_documents_are_caught_and_clean_ones_left_alone(spark):
    rng = random.Random(4)
    plain = ["harbor", "window", "garden", "river", "number", "people", "little", "answer", "simple", "market"]
    bad = ["stupid", "idiot", "scum"]

    def text(extra):
        words = [rng.choice(plain) for _ in range(40)]
        for w in extra:
            words.insert(rng.randrange(len(words)), w)
        return " ".join(words)

    rows = [(i, text(rng.sample(bad, 2)) if i % 4 == 0 else text([])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (400, 1), (400, 0)], "doc_id bigint, toxic int")
    planted = [(1001, text(["1d10t"])), (1002, text(["s c u m"])), (1003, text(["stuuupid"])), (1004, text(["$tup1d"])), (1005, text(["IDIOT!!"]))]
    clean = [(2001, text([])), (2002, text(["4711", "a1b2"])), (2003, None), (2004, ""), (None, text([])), (2005, "harbor " * 100_000), (2006, "hmmm soooo")]
    model = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    got = {(r["doc_id"], r["score"] >= 0.5) for r in toxicity.score(frame(spark, planted + clean), model).collect()}
    assert got == {(i, True) for i, _ in planted} | {(i, False) for i, _ in clean}
    assert toxicity.score(frame(spark, []), model).count() == 0
    none = toxicity.fit(frame(spark, rows), labels.limit(0), F.lit(True))
    assert max(r["score"] for r in toxicity.score(frame(spark, edge_rows()), none).collect()) < 1e-9
