"""Operator 2: toxicity of texts, scored after a noisy-channel restoration of disguised words.

A token whose letters were replaced, spaced out or repeated is a lattice of characters: each observed
character may stand for itself, for the letters that it looks like, or for nothing. The likeliest path
under a character trigram model of the whole corpus (Viterbi) is what is scored, beside the plain words.

Which stretches of a text go into a lattice is no matter of patterns: a text is folded to the letters that
its characters may stand for, without all that may be a spacer and without repeats, and a learned word
found in there, anywhere that it doesn't stand openly, marks a stretch. Whether it is the word that stands
there, or only its letters in a row, the model decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import id_text, only, table, written

#: Letters of the model; all else ends a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâæçèéêëîïôœùûÿáíñóú"
#: What a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "(": "c", "<": "c", "#": "h",
}
LOOKS |= {chr(ord(c) + 0xFEE0): c for c in "abcdefghijklmnopqrstuvwxyz"}  # the full-width forms
#: Letters of other alphabets, by the letter that they look like.
LOOKS |= {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: What parts letters, or looks like a letter but may do so too, and signs without width.
SPACERS = " ._-*~,/:;'\"`=\\^·•…–—&%"
EITHER, HIDDEN = "|+!", "\u00ad\u200b\u200c\u200d\u2060\ufeff"
K = len(LETTERS) + 1
_CODE = np.zeros(0x10000, np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(1, K)
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Costs of the channel, as negative logarithms: a look-alike, a dropped repeat, a dropped spacer, any other dropped sign.
LIKE, REPEAT, SPACER, DROP = 1.0, 1.0, 0.5, 8.0
#: A spacer that does part words, by the longer of the pieces beside it: words of few letters are rarer.
PARTS = (3.0, 3.0, 2.0, 1.5, 0.5)
#: A dropped spacer beside a piece that is long enough to be a word.
JOIN = 5.0


def _folded() -> np.ndarray:
    """For each code point the number of the letter that it may stand for, 0 for what may part letters. Letters that
    one sign looks like are one."""
    same = {"i": "l", "g": "b"}
    out = np.zeros(0x10000, np.uint8)
    for c in LETTERS:
        out[ord(c)] = _INDEX[same.get(c, c)]
    for c, letters in LOOKS.items():
        out[ord(c)] = _INDEX[same.get(letters[0], letters[0])]
    return out


_FOLD = _folded()
_FOLD_EITHER = _FOLD.copy()
_FOLD_EITHER[[ord(c) for c in EITHER]] = 0


def skeleton(text: str, fold: np.ndarray = _FOLD) -> tuple[str, np.ndarray]:
    """The letters that a text in lower case may stand for, without spacers and repeats, and the place of each."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = fold[np.where(raw < 0x10000, raw, 0)]
    at = np.flatnonzero(code)
    code = code[at]
    if len(at):
        keep = np.concatenate([[True], code[1:] != code[:-1]])
        at, code = at[keep], code[keep]
    return code.tobytes().decode("latin-1"), at

_TOKEN = re.compile(r"\S+").findall
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Single characters with spacers between, up to any non-letter; spacers are no such characters, so there is one way to match.
_RUN = re.compile(r"(?<![^\W\d_])[^\s._*~,/-](?:[ ._*~,/-]+[^\s._*~,/-]){2,}(?![^\W\d_])").findall
#: Runs of letters by ones and twos.
_SHORT = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,2}(?:(?:\s{1,3}|[._*~/-])[^\W\d_]{1,2}){2,}(?![^\W\d_])").findall
_WIDE = re.compile(r"[ ._*~,/-]{2,}").split
_PIECE = re.compile(rf"([\s{re.escape(SPACERS)}]+)").split
_DOUBLE = re.compile(r"(.)\1").search
_TWICE = re.compile(r"([^\W\d_])\1").finditer
_DISGUISED = re.compile(r"[^\W\d_][^\s]*?[0-9@$!|+€£¥(<#.*_~-]|[0-9@$!|+€£¥(<#]+[^\W\d_]|([^\W\d_])\1\1").search
_EDGE = ".,;:!?\"'`*%&#)]}([{<>"


def trigrams(text: str) -> np.ndarray:
    """Counts of character triples of one text, as an array of K**3; 0 stands between words."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _CODE[np.where(raw < 0x10000, raw, 0)]
    return np.bincount(code[:-2] * K * K + code[1:-1] * K + code[2:], minlength=K**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log-probabilities of a character after two others, from every text of docs.

    Each task sends its counts, at most K**3 rows; the driver gets the summed table of that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for b in batches:
            texts = [x for x in b.column(0).to_pylist() if x]
            at = 0
            while at < len(texts):  # about a million characters at once
                end, n = at, 0
                while end < len(texts) and (n < 1_000_000 or end == at):
                    n += len(texts[end])
                    end += 1
                total += trigrams("  ".join(texts[at:end]))
                at = end
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    counts = np.zeros(K**3)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return language_model_of(counts)


def language_model_of(counts: np.ndarray) -> np.ndarray:
    """The negative log-probabilities that counts of all character triples give, smoothed by pairs."""
    cube = counts.reshape(K, K, K)
    pair = cube.sum(0)  # what follows one character alone
    back = (pair + 0.1) / (pair + 0.1).sum(1, keepdims=True)
    return -np.log((cube + 5 * back[None]) / (cube.sum(2, keepdims=True) + 5))


def options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token in lower case: for each character what it may stand for and at what cost."""
    out = []
    pieces = [len(x) for x in _PIECE(token)]  # of letters and spacers in turn
    longer = [max(pieces[k - 1], pieces[k + 1]) if k % 2 else 0 for k, n in enumerate(pieces) for _ in range(n)]
    for i, c in enumerate(token):
        here: list[tuple[str, float]] = []
        if c in _INDEX:
            here.append((c, 0.0))
            if i and token[i - 1] == c:
                here.append(("", REPEAT))
        elif c in LOOKS:
            here += [(x, LIKE) for x in LOOKS[c]]
            if not c.isalpha() or i and token[i - 1] == c:
                here.append(("", 2 * LIKE if c in EITHER else DROP if i == 0 or token[i - 1] != c else REPEAT))
        elif c in HIDDEN:
            here.append(("", 0.0))
        elif c in SPACERS or c.isspace():
            here += [("", SPACER if longer[i] < len(PARTS) - 1 else JOIN), (" ", PARTS[min(longer[i], len(PARTS) - 1)])]
        else:
            here += [(" ", 0.0), ("", DROP)]
        out.append(here)
    return out


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token: the cheapest path by channel costs and the character model."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for here in [*options(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for c, price in here:
                if not c:
                    key, now = (a, b), (cost + price, text)
                elif c == " " and b == 0:
                    key, now = (a, b), (cost + price, text)
                else:
                    i = _INDEX.get(c, 0)
                    key, now = (b, i), (cost + price + float(model[a, b, i]), text + c)
                if key not in after or now < after[key]:
                    after[key] = now
        states = after
    return min(states.values())[1].strip()


def _spaced(text: str) -> list[str]:
    """The spelled-out runs of a text, of runs with wider gaps the parts of three characters or more between
    those, and the runs of letters by ones and twos."""
    out = []
    for run in _RUN(text):
        out.append(run)
        if len(parts := _WIDE(run)) > 1:
            out += (x for x in parts if len(x) >= 5)
    known = set(out)
    return out + [run for run in _SHORT(text) if run not in known]


def _unlikely_double(token: str, model: np.ndarray) -> bool:
    """Whether the likeliest path drops a doubled letter: whether that saves more than it costs."""
    for m in _TWICE(token):
        i, b = m.start(), _INDEX.get(m[1], 0)
        a, n = (_INDEX.get(x, 0) for x in (token[i - 1 : i], token[i + 2 : i + 3]))
        if b and model[a, b, b] + model[b, b, n] - model[a, b, n] > REPEAT:
            return True
    return False


def readings(token: str, model: np.ndarray) -> list[str]:
    """The words of a token in lower case: as it stands, and as restored where it looks disguised."""
    plain = _WORDS(token)
    inner = token.strip(_EDGE)
    if " " not in inner and not _DISGUISED(inner) and not _unlikely_double(inner, model):
        inner = token.lstrip(_EDGE)  # a sign at the end may be a letter: once or twice
        if not (inner[-1:] in ("$", "@", "!", "|") and 0 < len(inner.rstrip("$@!|")) >= len(inner) - 2 and _WORDS(inner)):
            return plain
    return [*plain, *(w for w in viterbi(inner, model).split() if w not in plain)]


def features(word: str) -> Iterator[str]:
    """A word as a whole, and its beginnings of three to six letters: made-up words share those."""
    yield f"{word}$"
    for n in range(3, min(7, len(word))):
        yield word[:n]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


@dataclass
class Model:
    """language: the character model. weights: feature hash -> share of toxic among the documents that have it.
    words: the words of the sample that have such a feature; where their letters stand, the lattice decides."""

    language: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    rest: float = 0.0
    words: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}
        self.found = None
        # the features themselves, by their words; all of a word's begin with its first three letters
        self.shares = {f: self.weights[h] for w in self.words for f in features(w) if (h := _hash(f)) in self.weights}
        self.heads = {f[:3] for f in self.shares}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "found": None}  # each worker builds its own

    def share(self, word: str) -> float:
        """The largest share among the features of a word."""
        return max((self.shares.get(f, 0.0) for f in features(word)), default=0.0)

    def hidden(self, text: str) -> set[str]:
        """The stretches of a text in lower case in which a word may be hidden: from the beginning of the token that
        its first letter is in to the end of that of its last."""
        if self.found is None:
            import ahocorasick

            self.found = ahocorasick.Automaton()
            for w in {*self.words, *(f for f in self.shares if len(f) >= 5 and f[-1] != "$")}:
                letters, _ = skeleton(w)
                if len(letters) >= 3:
                    self.found.add_word(letters, len(letters))
            self.found.make_automaton()
        out: set[str] = set()
        if not len(self.found):
            return out
        for fold in (_FOLD, _FOLD_EITHER)[: 1 + any(c in text for c in EITHER)]:
            letters, at = skeleton(text, fold)
            for end, n in self.found.iter(letters):
                i, j = int(at[end - n + 1]), int(at[end]) + 1
                if (part := text[i:j]).isalpha() and all(c in _INDEX for c in part) and not _DOUBLE(part):
                    continue  # it stands openly, within a token
                while i and text[i - 1] in _INDEX:
                    i -= 1
                while j < len(text) and (text[j] in _INDEX or text[j] == text[j - 1]):
                    j += 1
                out.add(text[i:j])
        return out

    def restored(self, part: str) -> float:
        """The share of what the likeliest reading of a stretch has beside its plain words."""
        if (found := self.cache.get(part)) is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            plain = set(_WORDS(part))
            found = self.cache[part] = max((self.share(w) for w in viterbi(part, self.language).split() if w not in plain), default=0.0)
        return found

    def score(self, text: str | None) -> float:
        """How likely some word of the restored text is a toxic one, each different word being evidence of its own:
        the plain words, and what the lattice reads in the stretches that may hide one."""
        text = (text or "").lower()
        heads = self.heads
        clean = math.prod(1 - self.share(w) for w in sorted({w for w in _WORDS(text) if w[:3] in heads or len(w) < 3 and f"{w}$" in heads}))
        clean *= math.prod(1 - self.restored(x) for x in sorted(self.hidden(text)))
        return 1 - clean if clean < 1 else self.rest


def _known(text: str | None, language: np.ndarray, cache: dict) -> dict[str, str]:
    """feature -> the words beside its first occurrence."""
    tokens = _TOKEN((text or "").lower())
    words: list[str] = []
    for t in tokens + _spaced((text or "").lower()):
        if t not in cache:
            if len(cache) > 500_000:
                cache.clear()
            cache[t] = readings(t, language)
        words += cache[t]
    out: dict[str, str] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        for f in features(word):
            out.setdefault(f, f"{before} {after}")
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, least: int = 5, share: float = 0.9) -> Model:
    """A model from at most ``most`` labelled documents outside the held-out fold (those with the least hashes).

    A feature counts once for each document and for each pair of neighbouring words, whichever is fewer,
    so groups of copies can't make a word look toxic. It is kept when at least ``share`` of the documents
    that have it are toxic and chance is ruled out: its log-likelihood ratio against the base rate must
    beat a prior of one in 100,000. The character model is of all docs. Null labels are left out; a
    document with several labels counts as toxic if any says so. Without labels nothing is kept.
    """
    docs = id_text(docs)
    language = language_model(docs)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    y = y.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = written(docs.join(F.broadcast(y), "doc_id").repartition(12, "doc_id"), "labelled")  # at most `most` labels
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model(language)
    base = toxic / total

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                found = _known(text, language, cache)
                yield pa.RecordBatch.from_arrays([pa.array([_hash(f) for f in found], pa.int64()), pa.array([_hash(x) for x in found.values()], pa.int64())], ["f", "near"])

    seen = rows.where("toxic = 1").select("text").mapInArrow(positive, "f long, near long")
    seen = seen.groupBy("f", "near").agg(F.count("*").alias("n")).groupBy("f").agg(F.least(F.count("*"), F.sum("n")).alias("n")).where(F.col("n") >= least)
    pos = {r["f"]: r["n"] for r in seen.collect()}  # features of a bounded sample

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, count = {}, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                tokens = set(_TOKEN((text or "").lower())) | set(_spaced((text or "").lower()))
                found: set[int] = set()
                for t in tokens:
                    if t not in cache:
                        if len(cache) > 500_000:
                            cache.clear()
                        cache[t] = [h for w in readings(t, language) for f in features(w) if (h := _hash(f)) in pos]
                    found.update(cache[t])
                count.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["f", "n"])

    against = rows.where("toxic = 0").select("text").mapInArrow(negative, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    neg = {r["f"]: r["n"] for r in against.collect()}
    weights = {}
    for f, p in pos.items():
        n = neg.get(f, 0)
        rate = min(0.999, (p + 0.5) / (p + n + 1))
        ratio = p * math.log(rate / base) + n * math.log((1 - rate) / (1 - base))
        if rate >= share and ratio > math.log(1e5):
            weights[f] = rate
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                for w in set(_WORDS((text or "").lower())) - seen:
                    if any(_hash(f) in weights for f in features(w)):
                        seen.add(w)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["word"])

    # a word has to come often enough to be learned, so there are fewer than words in the sample by far
    known = rows.where("toxic = 1").select("text").mapInArrow(words, "word string").distinct().orderBy("word").collect()
    model = Model(language, weights, words=tuple(r["word"] for r in known))
    scored = rows.select("toxic", _scorer(model)("text").alias("score")).where("score < 0.5").agg(F.avg("toxic")).first()[0]
    model.rest = min(0.49, scored or 0.0)
    return model


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(text):
        only(model.cache)
        return text.map(model.score)

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a score (0 to 1) and predicted (1 from 0.5 on), from the whole text of each row alone.

    Null and empty texts get the rate of toxic documents among those without any known feature. Repeated
    rows get equal scores; empty tables stay empty. Other columns pass through, but for columns of these
    two names, which are set anew.
    """
    return docs.withColumn("score", score_of(model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_of(model: Model):
    """The score as a column expression over text; null: empty."""
    return _scorer(model)(F.coalesce(F.col("text").cast("string"), F.lit("")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents. Null and empty texts: the rate of toxic documents without any known
    feature. Null doc_id: scored, not held out. Very long texts: scored whole, each different token once. Ties
    and repeated rows: equal scores. Other columns, clashing names among them, are ignored. Empty documents:
    empty result; without labels no text is predicted toxic."""
    docs = id_text(table(spark, sf_dir, "documents"))
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
