"""Training-data operators: SQL twins, brute force, round trips, held-out accuracy and edge cases."""
import hashlib
import os
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from slotworks.llm import (byte_bpe, compression_quality, decontaminate, hilbert_shards, licenses, near_dup, quality_rules,  # noqa: E402
                           substring_dup, token_store, url_cascade)
from slotworks.llm.common import releasing, without_rows  # noqa: E402
from slotworks.llm.perfect_hash import PerfectHash  # noqa: E402
from slotworks.llm.queries import BLOCKED_NAMES, ORACLES, QUERIES, RULES  # noqa: E402
from slotworks.llm.words import Words  # noqa: E402

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, spots int"
LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(LETTERS) + rng.choice(LETTERS) for _ in range(n)]


def frame(spark, rows):
    """Documents with two columns whose names clash with those used inside operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "k", 1) for i, t in rows], SCHEMA)


def edge_rows():
    """Null key, null and empty texts, ties, repeats, short, odd white space and a very long text."""
    base, other = words(120, 1), words(90, 2)
    return [(None, " ".join(base)), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four"), (6, " ".join(base)), (7, " ".join(base)),
            (7, " ".join(base)), (8, " ".join(other[:30] + base[20:90] + other[30:])), (9, "  ".join(base[:100]) + "\n"), (10, "Ünïcode " * 30), (11, " ".join(words(60000, 3))),
            (12, " ".join(base[:60] + ["changed"] + base[61:])), (13, "a\x1cb\x85c\xa0d")]


@pytest.fixture(scope="module")
def con():
    oracle.KINDS["int"] = "INTEGER"
    return oracle.connect(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], ROOT) == []


def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


# ---- words

def test_words_split_at_ascii_white_space_only():
    texts = ["a\x0bb\x0cc\x1cd\x85e\xa0f  g\r\n\th ", "  ", None, "x"]
    found = Words(pa.array(texts))
    assert found.flat.to_pylist() == [w for t in texts for w in WORD.findall(t or "")]
    assert found.n.tolist() == [5, 0, 0, 1]


# ---- 1 licences

def brute_licenses(rows):
    def grams(text):
        w = [x for x in re.split("[^0-9a-z]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        return {(a, b) for a, b in zip(w, w[1:])}

    out = {}
    for key, text in rows:
        lines = text.split("\n") if text is not None else []
        for unit in lines + ([text] if len(lines) > 1 else []):
            best = {}
            for name, template in licenses.TEMPLATES:
                g, t = grams(unit), grams(template)
                if g and 200 * len(g & t) >= licenses.PERCENT * (len(g) + len(t)):
                    best[name] = max(best.get(name, 0), 2 * len(g & t) / (len(g) + len(t)))
            for name, d in best.items():
                n, top = out.get((key, name), (0, 0))
                out[key, name] = (n + 1, max(top, d))
    return {(k, n, c, round(d, 6)) for (k, n), (c, d) in out.items()}


def test_license_scan_matches_brute_force(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, "x\nReleased under the MIT License.\nReleased under the MIT license"), (2, mit.upper()), (3, mit.replace(" the ", "\nthe ")), (4, mit + " and much more text " * 40),
            (5, None), (6, ""), (None, "Licensed under CC BY 4.0."), (7, "MIT"), (8, "licensed under cc by nc 4.0"), (9, "GPL " * 500)]
    found = {tuple(r) for r in licenses.scan(frame(spark, rows)).collect()}
    assert found == brute_licenses(rows) and any(k == 2 for k, *_ in found)
    assert licenses.scan(frame(spark, [])).count() == 0


# ---- 2 shards

def test_curve_visits_every_cell_in_unit_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        table, size, cells = hilbert_shards.curve_table(n), 1 << n, {}
        for point in np.ndindex(*[1 << bits] * n):
            state = index = 0
            for b in reversed(range(bits)):
                f = table[state * size + int("".join(str(x >> b & 1) for x in point), 2)]
                state, index = f // size, index * size + f % size
            cells[index] = point
        assert sorted(cells) == list(range(size ** bits))
        assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(len(cells) - 1))


def test_shards_have_equal_counts_gapless_slots_and_prune(spark):
    rows = edge_rows() + [(i, "same text") for i in range(100, 230)]
    docs = frame(spark, rows)
    found = hilbert_shards.assign(docs, 7, ["lang", "n_chars", "doc_id"])
    got = found.collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    kept = {r["shard"] for r in hilbert_shards.prune(hilbert_shards.manifest(found), docs, {"doc_id": 11}).collect()}
    assert next(r["shard"] for r in got if r["doc_id"] == 11) in kept and len(kept) < 7
    assert hilbert_shards.assign(frame(spark, []), 7, ["lang"]).count() == 0


# ---- perfect hash

@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20000])
def test_perfect_hash_is_minimal(n):
    keys = [f"key {i}".encode() for i in range(n)]
    halves = PerfectHash.halves(keys)
    found = PerfectHash.build(halves)
    slots = found.slots(halves).tolist()
    assert sorted(slots) == list(range(n))
    assert [found.slot(k) for k in keys[:50]] == slots[:50]


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        PerfectHash.build(PerfectHash.halves([b"a", b"a"]))


# ---- 3 token store

def test_store_holds_all_ids_and_finds_them_by_key(spark):
    rows = edge_rows() + [(50, "<|endoftext|> a"), (51, "x " * 5)] + [(60, f"many {i}") for i in range(40)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    store = token_store.write(frame(spark, rows), token_store.LibraryCodec(path), bucket_keys=5)
    want = Counter((i, np.array(known.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows)
    back = token_store.read(store, spark, frame(spark, rows)).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == want
    place = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == place
        place += len(r["ids"]) // 4
    order = [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    asked = spark.createDataFrame([(11,), (404,), (None,)], "doc_id bigint")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in token_store.read(store, spark, asked).collect()) == [(False, 11), (True, 0)]
    empty = token_store.write(frame(spark, []), token_store.LibraryCodec(path))
    assert token_store.read(empty, spark, asked).count() == 0


def test_store_query_matches_library(spark):
    known, place = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op3_token_store"](spark, ROOT).collect()}
    for r in documents(spark).orderBy("doc_id").collect():
        ids = np.array(known.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)


# ---- 4 decontamination

ITEM = ("When Alice Brown drove 120 km to Paris she paid 40 euros for fuel, and on the way back from Paris her brother Tom paid 35 euros. "
        "How much did both of them pay for the whole trip together?")


def test_reparameterised_items_are_caught_and_others_left_alone(spark):
    moved = ITEM.replace("Alice", "Clara").replace("Brown", "Green").replace("Paris", "Vienna").replace("120 km", "75 miles").replace("40", "18").replace("35", "22").replace("Tom", "Max")
    torn = moved.replace("back from Vienna", "back from Oslo")
    filler = " ".join(words(40, 5))
    docs = frame(spark, [(1, f"{filler}. {ITEM} {filler}"), (2, f"{filler}. {moved} {filler}"), (3, f"{filler}. {torn} {filler}"), (4, filler), (5, None), (6, ""), (None, ITEM),
                         (7, ITEM.split(" she ")[0] + " " + filler), (8, ITEM.upper()), (9, ITEM), (9, ITEM), (10, " ".join(["12"] * 300)), (11, ITEM.replace("120 km", "120km").replace(",", ""))])
    items = spark.createDataFrame([(1, ITEM), (2, "12 34 56 78 90 12 34 56 78"), (3, None), (None, filler), (4, "tiny but literal words")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1): True, (2, 1): False, (9, 1): True, (11, 1): True}
    kept = [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([3, 4, 5, 6, None, 7, 8, 10], key=str)
    assert decontaminate.leaks(frame(spark, []), items).count() == 0
    assert decontaminate.leaks(docs, items.filter("false")).count() == 0


PENS = ("A shop sells 12 pens on the first morning of the sale and later on the same day it also sells 12 cups to a school nearby. "
        "What was the total number of things that the shop had sold by the end of the day?")


def test_inconsistent_slots_drop_their_own_windows_only(spark):
    changed = ITEM.replace("back from Paris", "back from Pariss")
    docs = frame(spark, [(1, "See " + changed), (2, "See " + PENS.replace("12 pens", "7 pens").replace("12 cups", "9 cups")), (3, "See " + ITEM.replace("40", "41"))])
    items = spark.createDataFrame([(1, ITEM), (2, PENS)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_short_and_lower_cased_copies_are_found(spark):
    names = "On Monday Alice Brown met Tom Green and Eve Black in Paris, Oslo and Rome to see Max White, Ann Grey and Joe Stone there."
    rows = [(1, "He asked what is 12 + 30 * 4? Nobody knew."), (2, "And who is Ada Lovelace? A writer."), (3, "so " + names.lower()), (4, "What is 12 + 31 * 4?"), (5, " ".join(words(40, 8)))]
    items = spark.createDataFrame([(1, "What is 12 + 30 * 4?"), (2, "Who is Ada Lovelace?"), (3, names)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 3): True}


def test_short_items_are_one_window(spark):
    items = spark.createDataFrame([(4, "tiny but quite literal words")], "item_id bigint, text string")
    docs = frame(spark, [(1, "see tiny but quite literal words here"), (2, "tiny but quite other words")])
    assert [r["doc_id"] for r in decontaminate.leaks(docs, items).collect()] == [1]


def test_whole_benchmark_passages_are_found(spark):
    def plain(text):
        return re.findall(r"\w+", (text or "").lower())

    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    want = set()
    for r in documents(spark).collect():
        text = " " + " ".join(plain(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, w in items if " " + " ".join(w) + " " in text}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_template_decontamination"](spark, ROOT).collect()}
    assert want and want == got


# ---- 5 byte-level BPE

@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library_and_decodes(spark, codec, library):
    rng = random.Random(1)
    odd = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "２", "\xa0", "　", "\x1c", "\x85", "'s", "'", "'ll", "!", "日", "\U0001F600", "́", "\x00", "①", "ª", "_"]
    rows = edge_rows() + [(100 + i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for i in range(2000)] + [(9000, "ab" * 5000)]
    coded = byte_bpe.encode(frame(spark, rows), codec, drop_text=False)
    for r in byte_bpe.decode(coded, codec).collect():
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]).decode() == (r["text"] or "")
    assert byte_bpe.encode(frame(spark, []), codec).count() == 0
    bad = spark.createDataFrame([([10 ** 6],)], "ids array<int>")
    with pytest.raises(Exception):
        byte_bpe.decode(bad, codec).collect()
    assert [bytes(r["bytes"]) for r in byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), codec).collect()] == [b""]


def test_merges_match_library(codec, library):
    pieces = [w.encode() for w in words(300, 9)] + [b" thtionentre", b"a", b"ab", b"ab" * 300, "日本é".encode() * 9]
    assert [np.frombuffer(codec.tables.merge(p), np.int32).tolist() for p in pieces] == [library._encode_single_piece(p) for p in pieces]


def test_pieces_of_a_slice_are_numbered_without_sorting_them():
    pieces = byte_bpe.Pieces(None, lambda t: [t], 10)
    texts = ["one two  three", " one", "", None, "one two one two", "Ünï two one", "two"]
    distinct, code, counts = pieces.cut(pa.array(texts))
    assert len(set(distinct)) == len(distinct) and set(code.tolist()) == set(range(len(distinct)))
    ends = np.cumsum(counts)
    assert ["".join(distinct[c] for c in code[e - n:e]) for e, n in zip(ends, counts)] == [t or "" for t in texts]
    many = pa.array([" ".join(words(1000, 1) * 20)] * 20)
    tracemalloc.start()
    _, code, _ = pieces.cut(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(code) == 400_000 and peak < 36 * len(code)


def test_library_pieces_end_at_punctuation_and_keep_the_ids_of_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(17)
    whole.encode_special_tokens = True
    signs = ["\n", "\n\n", "\t", "'", "'s", "'ll", ".", ",.", "1", "×", "÷", "ß", "É", "ª", "—", "\u00a0", "日", "́", "\x00", "\x85", "<|endoftext|>", "_", "~"]
    texts = [" ".join("".join(rng.choice(signs if rng.random() < 0.4 else ["a", "the", "né", "Word", "I"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30)))
             for _ in range(3000)] + ["", None, " ", "\n", "end\n", "a  b", "a\n b", " a,b", "÷.", "é.", "aÃ,", "x\n\ny,z\nW."]
    pieces = token_store.LibraryCodec(path).pieces()
    ids, ends = pieces.encode(pa.array(texts))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
    plain = [w for w in words(400, 23)]
    distinct, _, _ = pieces.cut(pa.array([" ".join(w + mark for w in plain) for mark in ("", ".", ",", "!", ";", "?")]))
    assert len(distinct) < 1.5 * len(set(plain)) + 6


def test_pair_ranks_are_those_of_the_vocabulary(codec):
    tables = codec.tables
    assert all(tables.byte_pairs[a][b] == tables.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256))
    known = {tables.by_id[a].as_py() + tables.by_id[b].as_py(): r for a, after in enumerate(tables.pairs) for b, r in after.items()}
    assert all(tables.ranks[t] == r for t, r in known.items()) and len(known) > 40_000


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, ROOT).collect()}
    for r in documents(spark).collect():
        ids = library.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


# ---- 6 urls

def brute_url(url, rules, listed):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = []
    for key, action in rules:
        domain, prefix = key.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fit.append((len(key), key, action))
    labels = host.split(".")
    blocked = any(".".join(labels[i:]) in listed for i in range(len(labels)))
    return (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if blocked else "allow")


@pytest.mark.parametrize("bits", [url_cascade.MOST_BITS, 256])
def test_urls_match_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(url_cascade.cascades, "__defaults__", (bits,))
    rng = random.Random(4)
    hosts = [f"h{i}.x{i % 7}.{t}" for i in range(60) for t in ("com", "org", "net")] + ["example.net", "WWW.Example.NET", "example.com", "org", "net"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/1', '/de/x?y=/en/', '/fr/#z', '?q', '#f', '/EN/'])}" for _ in range(800)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http:///en/", "http://example.net/en/\nx"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string")
    listed = {h for h in hosts[:90]} | {"x3.com"}
    found = url_cascade.judge(pages, spark.createDataFrame(RULES + [(None, "block")], "key string, action string"), spark.createDataFrame([(h,) for h in listed] + [(None,)], "key string"))
    assert {r["page_id"]: tuple(r)[1:] for r in found.collect()} == {i: brute_url(u, RULES, listed) for i, u in enumerate(urls)}
    assert url_cascade.judge(pages.filter("false"), spark.createDataFrame(RULES, "key string, action string"), spark.createDataFrame([], "key string")).count() == 0


def test_url_plan_is_native(spark):
    plan = QUERIES["op6_url_cascade"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and BLOCKED_NAMES


# ---- 7 substring dedup

def brute_cut(rows, width=50):
    least = {}
    for key, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1 if key is not None else 0):
            g = tuple(w[i:i + width])
            least[g] = min(least.get(g, key), key)
    out = []
    for key, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if key is not None else 0):
            if least[tuple(w[i:i + width])] < key:
                gone[i:i + width] = [True] * width
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def test_cuts_match_brute_force(spark):
    rng, passages = random.Random(8), [words(n, 70 + n) for n in (49, 50, 51, 60, 80, 130)]
    rows = edge_rows()
    for i in range(120):
        parts = [words(rng.randint(0, 40), 1000 + i), rng.choice(passages), words(rng.randint(0, 40), 2000 + i), rng.choice(passages)[rng.randint(0, 20):]]
        rows.append((200 + (i * 37) % 120, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    docs = frame(spark, rows).repartition(5)
    got = substring_dup.cut_repeats(docs, layout="words")
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in got.collect()) == brute_cut(rows)
    assert got.columns == docs.columns + ["n_words", "n_removed"]
    plain = substring_dup.cut_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"] or ""))) for r in plain) == brute_cut(rows)
    before = dict(rows)
    assert all(r["text"] == before[r["doc_id"]] for r in plain if not r["n_removed"] and r["doc_id"] is not None)
    assert substring_dup.cut_repeats(frame(spark, [])).count() == 0


def test_cover_meets_every_pair_of_positions():
    v, cover = substring_dup.PERIOD, set(substring_dup.COVER)
    assert all(any((a + o) % v in cover and (b + o) % v in cover for o in range(v)) for a in range(v) for b in range(v))


# ---- 8 near duplicates

def brute_components(rows):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(k, shingles(t)) for k, t in rows]
    up = {k: k for k, _ in sets if k is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return Counter((k, len(s), top(k) if k is not None else None, k is None or top(k) == k) for k, s in sets)


def test_words_of_a_slice_are_laid_out_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1000, 800))) for _ in range(400)]
    texts[7], texts[300], texts[390] = None, texts[11], texts[399][:1500] + " " + texts[12]
    slice_of = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.nulls(400, pa.bool_())], ["key", "text", "copy"])
    marked = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array([[np.arange(0, 900, 31, dtype=np.int32).tobytes()]] * 400)], ["key", "text", "spots"])
    rows, peaks = [], []
    for most in (1 << 16, 16 << 20):
        monkeypatch.setattr(substring_dup, "PART", most, raising=False)
        list(substring_dup._windows([marked]))  # tables of powers are built
        tracemalloc.start()
        rows.append([[b.to_pydict() for b in step([data])] for step, data in ((substring_dup._anchors, slice_of), (substring_dup._windows, marked))])
        tracemalloc.stop()
        tracemalloc.start()
        for _ in substring_dup._anchors([slice_of]):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert rows[0] == rows[1] and rows[0][0][0]["h"]  # copies of different parts are still met within the slice
    assert peaks[0] < 0.6 * peaks[1], peaks


def test_word_hashes_tell_words_apart_wherever_they_stand():
    words = [f"w{i:x}" * (1 + i % 5) for i in range(3000)] + ["", "a", "a\0", "\0a", "ü" * 5000, "x" * 300_000]
    flat = pa.array(words, pa.large_string())
    got = near_dup.word_hashes(flat)
    assert len(set(got.tolist())) == len(set(words))
    assert (near_dup.word_hashes(flat, 64) == got).all() and (near_dup.word_hashes(flat.slice(5, 90)) == got[5:95]).all()
    assert (near_dup.word_hashes(pa.array(words[::-1], pa.large_string())) == got[::-1]).all()
    assert len(near_dup.word_hashes(flat.slice(0, 0))) == 0


def near_rows():
    rng, rows = random.Random(6), edge_rows()
    for g in range(6):
        base = words(150 + 60 * g, 300 + g)
        for c in range(12):  # a chain of copies, each changed a little more
            own = list(base)
            for _ in range(c):
                own[rng.randrange(len(own))] = "w" + str(rng.random())
            rows.append((1000 + 100 * g + (c * 5) % 12, " ".join(own)))
            base = own if g % 2 else base
    return rows


def test_components_match_brute_force(spark):
    rows = near_rows()
    got = near_dup.near_duplicates(frame(spark, rows).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_blocks_find_links_that_heads_miss(spark, monkeypatch):
    """With one candidate round that finds nothing, the block stage alone gives the same components."""
    monkeypatch.setattr(near_dup, "star_links", lambda df, placed, *a: placed.select(F.col("key").alias("a"), F.col("key").alias("b")).filter("false"))
    rows = [r for r in near_rows() if r[0] is None or r[0] < 1400]
    got = near_dup.near_duplicates(frame(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)


def test_rows_outside_the_buckets_asked_for_are_dropped_before_the_join(spark):
    placed = spark.createDataFrame([(k, k // 2, [near_dup.BASES[0] // 2 * k % (1 << 62), 7 * k - 50, 5]) for k in range(100)], "key bigint, component bigint, bands array<bigint>")
    asked = spark.createDataFrame([(7 * 3 - 50,), (5,), (12345,)], "bucket bigint")
    rows = near_dup.in_buckets(placed, 2, asked).collect()
    assert (-29, 3, 1) in [tuple(r) for r in rows] and len(rows) < 5
    assert sorted(r["key"] for r in near_dup.in_buckets(placed, 3, asked).filter("bucket = 5").collect()) == list(range(100))
    assert near_dup.in_buckets(placed.limit(0), 3, asked).count() == 0 and near_dup.in_buckets(placed, 3, asked.limit(0)).count() == 0


def test_rows_that_are_not_listed_meet_no_join(spark):
    docs = spark.createDataFrame([(str(i), "x" * i) for i in range(200)] + [("7", "again"), ("", None)], "name string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = without_rows(docs, spark.createDataFrame([("7",), ("190",), ("absent",), ("7",)], "name string"), "name")
        assert sorted(map(str, left.collect())) == sorted(map(str, docs.filter("name NOT IN ('7', '190')").collect()))
        stay, others = (left._jdf.queryExecution().optimizedPlan().children().apply(i).toString() for i in (0, 1))
        assert "Join" not in stay and "Join LeftAnti" in others
        assert without_rows(docs, docs.limit(0), "name").count() == 202 and without_rows(docs, docs, "name").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packed_estimate_follows_similarity():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, packed = near_dup.signatures([near_dup._mix(a), near_dup._mix(a[:750]), near_dup._mix(a[500:]), np.zeros(0, np.uint64)])
    assert near_dup.similarity(packed[0], packed[0]) == 1
    assert abs(near_dup.similarity(packed[0], packed[1]) - 0.75) < 0.15
    assert abs(near_dup.similarity(packed[0], packed[2]) - 0.5) < 0.2


# ---- 9 quality rules

def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_statistics_match_brute_force(spark):
    rows = edge_rows() + [(20, "a b\n\na b\n a b\n\t\n"), (21, "x# *$ %&|<> y " * 4), (22, " ".join(words(10, 1) * 3)), (23, "é" * 40)]
    got = Counter((r["doc_id"], tuple(r)[1:]) for r in quality_rules.rule_statistics(frame(spark, rows)).collect())
    assert got == Counter((k, brute_statistics(t)) for k, t in rows)


def test_verdicts_keep_good_rows_and_find_junk(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    rest = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([k for q, k in rest if q == 1]) >= 0.98 and np.mean([k for q, k in rest if q == 0]) <= 0.2
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)


def test_rules_without_labels_or_rows(spark):
    none = spark.createDataFrame([(6, None), (None, 1)], "doc_id bigint, quality int")
    got = quality_rules.judge(frame(spark, edge_rows()), none).collect()
    assert len(got) == len(edge_rows()) and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.judge(frame(spark, []), none).count() == 0


def test_forest_isolates_an_outlier():
    x = np.random.default_rng(0).normal(size=(500, 2))
    found = quality_rules.IsolationForest.fit(x)
    assert found.score(np.array([[9.0, 9.0]]))[0] > np.quantile(found.score(x), 0.99)


def test_forest_and_threshold_are_of_all_rows(spark):
    """More labelled rows than any bound on them: the threshold is the exact quantile of all, and rows of any key count in the forest."""
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 24), i -> concat(repeat('x', 3 + pmod(hash(id, i), 9)), if(pmod(hash(id, i, 1), 7) = 0, '#', ''), i)), ' ')").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 60 == 0, 0).otherwise(1).alias("quality"))
    got = quality_rules.judge(docs, labels).select("doc_id", "anomaly", "kept").toArrow()
    key, score, kept = (got.column(c).to_numpy(zero_copy_only=False) for c in got.column_names)
    good = key % 60 != 0
    assert len(key) == n and score[kept].max() <= np.quantile(score[good], 0.998, method="higher") < score[~kept].min()
    stats = quality_rules.rule_statistics(docs)
    values, counts = quality_rules.feature_cells(stats)
    assert counts.sum() == n and len(quality_rules.feature_cells(stats, most=50)[1]) <= 50 and quality_rules.feature_cells(stats, most=50)[1].sum() == n


def test_one_extreme_row_does_not_hide_the_others():
    x = np.random.default_rng(0).normal(size=(500, 2))
    found = quality_rules.IsolationForest.fit(np.concatenate([x, [[1e6, 1e6]]]))
    assert found.score(np.array([[9.0, 9.0]]))[0] > np.quantile(found.score(x), 0.99)


# ---- 10 compression classifier

def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["score"]) for r in QUERIES["op10_compression_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for q, s in got if q == 1], [s for q, s in got if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.9


def test_scores_of_edge_rows(spark):
    rows = edge_rows()
    labels = spark.createDataFrame([(6, 1), (10, 0), (11, 1), (11, 0), (12, None)], "doc_id bigint, quality int")
    for marks in (labels, labels.filter("quality = 1"), labels.filter("false")):
        model = compression_quality.fit(frame(spark, rows), marks, F.lit(True))
        got = compression_quality.score(frame(spark, rows), model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert compression_quality.score(frame(spark, []), model).count() == 0


def test_dictionaries_hold_all_parts_of_long_texts(spark):
    """Texts of one label differ from the other's after their first 4 KB only."""
    def marked(stem, seed):
        rng = random.Random(seed)
        return " ".join(f"{stem}{rng.randrange(50)} is here" for _ in range(400))

    head = " ".join(words(700, 77))
    rows = [(i, head + " " + marked(("sunny", "grim")[i % 2], i)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = compression_quality.fit(frame(spark, rows), labels, F.lit(True))
    good, bad = model.difference([marked("sunny", 500)[:1500], marked("grim", 501)[:1500]])
    assert len(head) > 4096 and good > 0.01 and bad < -0.01
    text = "".join(chr(33 + i % 90) for i in range(9000))
    found = frame(spark, [(1, text), (2, "short")]).select(compression_quality.spread_pieces("text", 4096).alias("p")).collect()
    assert [bytes(x) for x in found[0]["p"]] == [text[(8488 * i) // 7:(8488 * i) // 7 + 512].encode() for i in range(8)] and found[1]["p"] == [b"short"]


# ---- pipeline

def test_pipeline_stages_act_on_what_is_left(spark):
    docs, d = documents(spark), corpus_pipeline
    ruled = d.quality_stage(spark, docs, ROOT)
    kept = {r["doc_id"] for r in quality_rules.judge(docs, spark.read.parquet(f"{ROOT}/labels.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in ruled.collect()} == kept and ruled.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in ruled.collect()]
    single = d.near_dup_stage(spark, ruled, ROOT)
    heads = {k for k, _, part, _ in brute_components(rows) if k == part}
    assert {r["doc_id"] for r in single.collect()} == heads and single.columns == docs.columns
    cut = d.substring_stage(spark, single, ROOT)
    want = brute_cut([(k, t) for k, t in rows if k in heads])
    assert {(r["doc_id"], " ".join(WORD.findall(r["text"]))) for r in cut.collect()} == {(k, t) for k, _, _, t in want} and cut.columns == docs.columns
    clean = d.decontamination_stage(spark, cut, ROOT)
    leaked = {r["doc_id"] for r in decontaminate.leaks(cut, spark.read.parquet(f"{ROOT}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == heads - leaked and clean.columns == docs.columns
    last = {r["doc_id"]: list(r["ids"]) for r in d.run(spark, ROOT).collect()}
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(last) == set(texts)
    for k, ids in last.items():
        assert b"".join(codec.tables.by_id[i].as_py() for i in ids).decode() == texts[k]


def test_stages_on_edge_rows(spark):
    docs = frame(spark, edge_rows()).drop("key", "spots")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, ROOT)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.filter("false"), ROOT).count() == 0
    assert duckdb


def test_rows_with_null_or_repeated_keys_have_their_own_verdict(spark, tmp_path):
    """One rejected, copied or leaking row takes no other row with its key along, and a null key saves none."""
    good, other, third = (" ".join(words(80, n)) for n in (21, 22, 23))
    leak = " ".join(words(40, 24))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def left(stage, rows):
        return sorted(((r["doc_id"], r["text"]) for r in stages[stage](spark, frame(spark, rows), str(tmp_path)).collect()), key=str)

    rows = [(5, good), (5, "too short"), (None, "short too"), (None, other), (6, third)]
    assert left("quality_rules", rows) == sorted([(5, good), (None, other), (6, third)], key=str)
    rows = [(1, good), (5, good), (5, other), (6, third)]
    assert left("near_duplicates", rows) == sorted([(1, good), (5, other), (6, third)], key=str)
    rows = [(5, good), (5, f"{other} {leak}"), (None, leak), (None, other)]
    assert left("decontamination", rows) == sorted([(5, good), (None, other)], key=str)


def test_a_task_gives_freed_memory_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", f.read())) / 1024

    kept = []

    @releasing
    def run(batches):
        small = [np.ones(8000) for _ in range(3000)]  # 64 KB each, below what the C library maps on its own
        kept.append(small[-1])  # what lies behind the freed ones keeps the heap from shrinking by itself
        del small
        yield from batches

    before = held()
    assert list(run([1, 2])) == [1, 2]
    assert held() - before < 60


def test_tasks_of_the_pipeline_release_memory_and_read_small_batches(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(words(80, i % 7))) for i in range(40)]).withColumn("n_chars", F.length("text").cast("bigint")).select("doc_id", "text", "lang", "source", "n_chars")
    kind, caught, bounds = type(docs), [], {}
    whole, asked = kind.mapInArrow, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *how: caught.append(run) or whole(self, run, *how))
    for module in (quality_rules, decontaminate):
        monkeypatch.setattr(module, "pin", lambda df, name="pin", pin=module.pin: bounds.update({name: spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")}) or pin(df, name))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, ROOT).count()
    assert len(caught) >= 10 and all(hasattr(run, "__wrapped__") for run in caught)
    assert {bounds[k] for k in ("rules", "rule-scores", "item-hits")} == {str(4 << 20)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == asked
