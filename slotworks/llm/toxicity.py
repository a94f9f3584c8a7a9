"""Toxicity of texts whose offending words may be disguised: noisy-channel deobfuscation, then a score of the restored text.

1. A character language model (four characters, over letters folded to a-z) is counted over all
   words of all documents.
2. Words that may be disguised (letters mixed with digits or symbols, letters repeated three times
   or more, or single characters standing apart) become lattices: what each observed character may
   stand for, at a cost. Viterbi decoding takes the path of the least cost under lattice and model.
   Other words are only folded. Results per word are remembered, up to a bound, per worker.
3. Features of a restored text are runs of five and seven characters of its words (ends of words
   included), each at three levels of how often it occurs. Those that tell labelled texts apart are
   chosen by their likelihood ratio; a logistic model over them gives the score.

The model of characters reads all documents. The classifier is fitted on at most `rows` labelled
texts, those with the smallest hash of their key; equal texts count once. Keys are drawn first, so
that no text is shuffled. Labels, language, source and key are no inputs of a score.

Edge cases: null and empty texts have no feature and get the score of that; rows with a null key are
scored and count as held out of learning; rows with a null or unknown label, or labelled both
ways, are not learned from; without texts of both labels every score is the share of toxic ones (0
without any label). Texts of any length are read whole; repeated rows score alike; an empty table
gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin
from .words import Words, slices

#: Letters are coded 1 to 26, others 27, the end of a word 0.
LETTERS, ORDER = 28, 4
#: What a character may stand for in a disguised word.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h"}
#: Costs, as negative logarithms: a substitute, any vowel, a dropped character, a word's end where something stands between letters.
SUBSTITUTE, VOWEL, DROP, DROP_DIGIT, END, REPEATED, DOUBLED = 1.0, 2.5, 0.5, 4.0, 2.0, 0.5, 2.0
GRAMS, LEVELS = (5, 7), 3
KEPT = 1 << 16
SLICE = 8 << 20
_MARKS = re.compile(r"[^\w]+|_")


def _fold(texts: pa.Array) -> pa.Array:
    """Lower case without accents, letters other than a-z as `{`."""
    low = pc.utf8_normalize(pc.utf8_lower(texts), form="NFKD")
    return pc.replace_substring_regex(pc.replace_substring_regex(low, r"\p{M}", ""), r"[^a-z\x00-\x7F]", "{")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes side by side, length of each) of ASCII texts."""
    flat = pa.concat_arrays([texts.cast(pa.large_binary())])
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(flat) else np.zeros(0, np.uint8)
    return raw, np.diff(ends)


def gram_codes(words: pa.Array, width: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, word) of all runs of `width` letters of folded words, with `ahead` ends before a word and one behind it."""
    raw, lens = _bytes(words)
    n = len(lens)
    size = lens + ahead
    first = np.cumsum(size) - size
    codes = np.zeros(int(size.sum()) + 1, np.int64)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first + ahead, lens)
    codes[at] = raw & 31
    owner = np.append(np.repeat(np.arange(n), size), n)
    last = np.arange(width - 1, len(codes))
    of = owner[last - 1]
    # a run ends at a letter or at the end behind a word, and begins within the same word
    good = (of == owner[last - width + 1]) & ((codes[last] > 0) | (codes[last - 1] > 0))
    last, of = last[good], of[good]
    value = np.zeros(len(last), np.int64)
    for k in range(width):
        value = value * LETTERS + codes[last - width + 1 + k]
    return value, of


class Tokens:
    """Words of a slice of texts: which of the distinct ones are plain letters, and what they fold to."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        coded = self.words.flat.dictionary_encode()
        self.distinct, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bare = pc.utf8_trim(self.distinct, characters="\"'.,;:?!()[]{}«»“”‘’„…–—-_%&=/\\~^`¿¡")
        self.folded = _fold(bare)
        letters = pc.match_substring_regex(self.folded, "^[a-z{]+$").to_numpy(zero_copy_only=False).astype(bool)
        raw, lens = _bytes(self.folded)
        owner = np.repeat(np.arange(len(lens)), lens)
        same = (raw[1:] == raw[:-1]) & (owner[1:] == owner[:-1])
        thrice = np.bincount(owner[2:][same[1:] & same[:-1]], minlength=len(lens)) > 0
        twice = np.bincount(owner[1:][same], minlength=len(lens))
        self.lens = lens
        self.plain = letters & ~thrice & ~((twice > 1) & (10 * twice >= 3 * lens))
        # anything else with a letter in it may be a disguise
        self.odd = ~self.plain & pc.match_substring_regex(self.folded, "[a-z]").to_numpy(zero_copy_only=False).astype(bool)

    def spaced(self) -> list[tuple[int, int, int]]:
        """(text, first, last + 1) of stretches of three or more single characters, one of them a letter at least."""
        if not len(self.code):
            return []
        single = ((pc.utf8_length(self.distinct).to_numpy(zero_copy_only=False) == 1) | (self.lens == 1))[self.code]
        owner, out = self.words.owner, []
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2).tolist() if len(edge) else []:
            cuts = [a, *(a + 1 + np.flatnonzero(owner[a + 1:b] != owner[a:b - 1])).tolist(), b]
            out += [(int(owner[x]), x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= 3]
        return out

    def single(self, code: int) -> str:
        """A single character: without punctuation around it, if it is a letter."""
        return (self.folded if self.lens[code] == 1 else self.distinct)[code].as_py()


@dataclass
class CharacterModel:
    """Costs of a letter after three others, as an array of shape (28, 28, 28, 28)."""
    cost: np.ndarray

    @classmethod
    def of_counts(cls, codes: np.ndarray, counts: np.ndarray, strength: float = 4.0) -> CharacterModel:
        """Each order is smoothed by the next shorter one."""
        full = np.zeros(LETTERS ** ORDER)
        full[codes] = counts
        full = full.reshape((LETTERS,) * ORDER)
        p = np.full(LETTERS, 1 / LETTERS)
        for order in range(1, ORDER + 1):
            seen = full.sum(tuple(range(ORDER - order)))
            p = (seen + strength * p) / (seen.sum(-1, keepdims=True) + strength)
        return cls((-np.log(p)).astype(np.float32).reshape(-1, LETTERS))


def character_model(df: DataFrame, text: str = "text") -> CharacterModel:
    """Counted over the plain words of all texts: a table per task, summed by run of characters."""
    def run(batches):
        total = np.zeros(LETTERS ** ORDER, np.int64)
        for part in slices(batches, "text", SLICE):
            tokens = Tokens(part.column("text"))
            times = np.bincount(tokens.code, minlength=len(tokens.distinct))
            code, of = gram_codes(tokens.folded.filter(pa.array(tokens.plain)), ORDER, ORDER - 1)
            total += np.bincount(code, times[tokens.plain][of], len(total)).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["code", "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").cast("bigint").alias("n")).toArrow()
    return CharacterModel.of_counts(rows["code"].to_numpy(), rows["n"].to_numpy())


@dataclass
class Decoder:
    """Restores disguised words: Viterbi over the lattice of a word, with the last three letters as state."""
    model: CharacterModel
    known: dict[str, list[str]] = field(default_factory=dict)

    def __getstate__(self):
        return {"model": self.model, "known": {}}

    @staticmethod
    def lattice(seen: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """Per run of one character: the letters it may stand for (0: a word's end), and the cost."""
        out, at = [], 0
        while at < len(seen):
            c, end = seen[at], at
            while end < len(seen) and seen[end] == c:
                end += 1
            n, at = end - at, end
            if "a" <= c <= "{":
                x = ord(c) & 31
                if n == 1:
                    out.append([((x,), 0.0)])
                elif n == 2:
                    out.append([((x, x), 0.0), ((x,), DOUBLED)])
                else:
                    out.append([((x,), REPEATED), ((x, x), REPEATED)])
                continue
            drop = DROP_DIGIT if c.isdigit() else DROP
            ways: list[tuple[tuple[int, ...], float]] = [((), drop), ((0,), END)]
            for y in STANDS_FOR.get(c, ""):
                cost = VOWEL if c == "*" else SUBSTITUTE
                ways.append(((ord(y) & 31,), cost))
                if n > 1:
                    ways.append(((ord(y) & 31,) * 2, cost))
            out.append(ways)
        return out

    def decode(self, seen: str) -> list[str]:
        """Words that a folded, disguised stretch most likely stands for."""
        table, size = self.model.cost, LETTERS * LETTERS
        # state: the last three letters; value: cost and the letters so far, as linked pairs
        best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for ways in [*self.lattice(seen), [((0,), 0.0)]]:
            ahead: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, path) in best.items():
                for letters, extra in ways:
                    total, now, line = cost + extra, state, path
                    for x in letters:
                        if x == 0 and now == 0:
                            continue  # no word yet
                        total += float(table[now, x])
                        now = 0 if x == 0 else (now % size) * LETTERS + x
                        line = (line, x)
                    if now not in ahead or total < ahead[now][0]:
                        ahead[now] = (total, line)
            best = ahead
        line, out = min(best.values(), key=lambda v: v[0])[1], []
        while line is not None:
            line, x = line
            out.append(chr(96 + x))
        return [w for w in "".join(reversed(out)).split("`") if w]

    def restore(self, token: str) -> list[str]:
        found = self.known.get(token)
        if found is None:
            parts = _MARKS.split(token)
            # joined words of a usual length need no decoding
            found = parts if len(parts) > 1 and all(len(p) > 2 and p.isalpha() for p in parts) else self.decode(token)
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[token] = found
        return found


def restored(tokens: Tokens, decoder: Decoder) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, text of each occurrence, word of each occurrence) after restoration; single characters that stand apart are joined."""
    plain, code = np.flatnonzero(tokens.plain), tokens.code
    number = np.full(len(tokens.distinct), -1, np.int64)
    number[plain] = np.arange(len(plain))
    extra: dict[str, int] = {}
    words_of: dict[int, list[int]] = {}
    odd = np.flatnonzero(tokens.odd)
    for i, token in zip(odd.tolist(), _fold(tokens.distinct.take(pa.array(odd))).to_pylist()):
        words_of[i] = [extra.setdefault(w, len(extra)) for w in decoder.restore(token)]
    at = np.flatnonzero(tokens.odd[code])
    lists = [words_of[c] for c in code[at].tolist()]
    joined = tokens.spaced()
    joined_words = [[extra.setdefault(w, len(extra)) for w in decoder.restore(text)] for text in
                    _fold(pa.array([" ".join(tokens.single(c) for c in code[a:b].tolist()) for _, a, b in joined], pa.large_string())).to_pylist()]
    there = np.flatnonzero(number[code] >= 0)
    owner = np.concatenate([tokens.words.owner[there], np.repeat(tokens.words.owner[at], [len(x) for x in lists]),
                            np.repeat([d for d, _, _ in joined], [len(x) for x in joined_words])]).astype(np.int64)
    word = np.concatenate([number[code[there]], np.array([w for x in lists for w in x], np.int64) + len(plain),
                           np.array([w for x in joined_words for w in x], np.int64) + len(plain)]).astype(np.int64)
    return pa.concat_arrays([tokens.folded.take(pa.array(plain)), pa.array(list(extra), pa.large_string())]), owner, word


def gram_levels(texts: pa.Array, decoder: Decoder, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all texts: feature = code * LEVELS + level.

    Level 0: the run occurs; 1: twice and in every 200th word; 2: three times and in every 60th word.
    `only`: sorted codes to look for.
    """
    words, owner, word = restored(Tokens(texts), decoder)
    # codes of longer runs come behind those of shorter ones
    code, of = (np.concatenate(x) for x in zip(*((c + LETTERS ** w - LETTERS ** GRAMS[0], o) for w in GRAMS for c, o in [gram_codes(words, w, 1)])))
    if only is not None:
        if not len(only):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(only, code), len(only) - 1)
        keep = only[at] == code
        code, of = code[keep], of[keep]
    order = np.argsort(of, kind="stable")
    code, many = code[order], np.bincount(of, minlength=len(words))
    start = np.cumsum(many) - many
    n = many[word]
    pick = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both = np.stack([np.repeat(owner, n), code[pick]])
    # runs of one text are counted together
    span = 2 * LETTERS ** GRAMS[-1]
    found, times = np.unique(both[0] * span + both[1], return_counts=True)
    text, gram = found // span, found % span
    total = np.bincount(owner, minlength=len(texts))[text]
    second, third = (times >= 2) & (200 * times >= total), (times >= 3) & (60 * times >= total)
    return (np.concatenate([text, text[second], text[third]]),
            np.concatenate([gram * LEVELS, gram[second] * LEVELS + 1, gram[third] * LEVELS + 2]))


def thinned(x: np.ndarray, y: np.ndarray, shares: tuple[float, ...] = (0.3, 0.1), seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and copies of them that keep a share of their features, drawn by a fixed seed; copies that keep none are left out.

    Toxic texts mostly hold several such words. With the copies, one of them is learned to be enough.
    """
    rng = np.random.default_rng(seed)
    xs, ys = [x], [y]
    for share in shares:
        copy = x * (rng.random(x.shape, np.float32) < share)
        some = copy.any(1)
        xs.append(copy[some])
        ys.append(y[some])
    return np.concatenate(xs), np.concatenate(ys)


@dataclass
class ToxicityModel:
    decoder: Decoder
    features: np.ndarray
    weight: np.ndarray
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.offset)
        if len(self.features):
            text, feature = gram_levels(texts, self.decoder, np.unique(self.features // LEVELS))
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            hit = self.features[at] == feature
            total += np.bincount(text[hit], self.weight[at[hit]], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def learned_keys(df: DataFrame, labels: DataFrame, learn, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(key, y) of at most `rows` labelled rows: those with the smallest hash, one of equal texts. Only keys and hashes are shuffled."""
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).filter("y = _y")
    there = df.filter(F.col(key).isNotNull() & learn & (F.length(text) > 0)).select(F.col(key).alias("key"), F.xxhash64(text).alias("t"))
    known = there.join(marks.select("key", "y"), "key").groupBy("t").agg(F.min(F.struct(F.xxhash64("key").alias("o"), "key", "y")).alias("s")).select("s.*")
    return known.orderBy("o", "key").limit(rows).select("key", "y")


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic model, by Newton steps; the offset is not penalised."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 12_288,
        features: int = 384, ridge: float = 0.1) -> ToxicityModel:
    """Count the character model over df, then fit the classifier on labelled rows for which `learn` holds."""
    decoder = Decoder(character_model(df, text))
    keys = pin(learned_keys(df, labels, learn, key, text, label, rows), "toxic-keys")
    sums = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("toxic")).first()
    n, toxic = sums["n"], sums["toxic"] or 0
    if not 0 < toxic < n:
        return ToxicityModel(decoder, np.zeros(0, np.int64), np.zeros(0), 500.0 if n and toxic else -500.0)
    # `rows` keys at the most, so this side is of bounded size; of rows that repeat a key, one
    sample = pin(df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(keys), "key")
                 .groupBy("key", "y").agg(F.max("text").alias("text")), "toxic-sample")

    def counted(batches):
        for part in slices(batches, "text", SLICE):
            mark = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            at, feature = gram_levels(part.column("text"), decoder)
            found, where = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found)] + [pa.array(np.bincount(where, mark[at] == y, len(found)).astype(np.int64)) for y in (1, 0)], ["feature", "pos", "neg"])

    seen = sample.mapInArrow(counted, "feature bigint, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    q, both = toxic / n, F.col("pos") + F.col("neg")
    gain = (F.col("pos") * F.log(F.col("pos") / (F.lit(q) * both)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (F.lit(1 - q) * both))).otherwise(0.0))
    odds = ((F.col("pos") + 0.5) * F.lit(n - toxic + 1.0)) / ((F.col("neg") + 0.5) * F.lit(toxic + 1.0))
    # among so many features, a gain below 12 comes by chance; below threefold odds a run tells language or topic, not toxicity
    chosen = seen.filter((F.col("pos") > 0) & (odds > 3)).withColumn("gain", gain).filter("gain > 12").orderBy(F.desc("gain"), "feature").limit(features)
    names = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))
    model = ToxicityModel(decoder, names, np.zeros(len(names)), float(np.log(toxic / (n - toxic))))
    if not len(names):
        return model
    only = np.unique(names // LEVELS)

    def located(batches):
        for part in slices(batches, "text", SLICE):
            at, feature = gram_levels(part.column("text"), decoder, only)
            spot = np.minimum(np.searchsorted(names, feature), len(names) - 1)
            hit = names[spot] == feature
            order = np.argsort(at[hit], kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(at[hit], minlength=part.num_rows))])
            yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spot[hit][order].astype(np.int32)))], ["y", "f"])

    points = sample.mapInArrow(located, "y int, f array<int>").toArrow().combine_chunks()
    lists = points["f"].combine_chunks()
    x = np.zeros((len(points), len(names)), np.float32)
    x[np.repeat(np.arange(len(points)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = 1
    model.weight, model.offset = logistic_fit(*thinned(x, points["y"].to_numpy().astype(float)), ridge)
    return model


def score(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """(key, score) of every row, from its whole text."""
    def run(batches):
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(model.score(part.column("text")))], ["key", out])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {out} double")
            .withColumnRenamed("key", key))
