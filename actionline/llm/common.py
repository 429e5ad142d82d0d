"""What several operators of this subpackage share: tables, the shared folder, tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.sources.shared import shared_root as shared_dir  # noqa: F401
from actionline.sources.shared import stored

#: Code points that Unicode calls white space (fixed values; Python's own \s has four more).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and survives lost executors.

    instead: a result of this function that nothing reads any more once df is written; its files go."""
    out = stored(df, name)
    if instead is not None:
        deleted(df.sparkSession, instead)
    return out


def deleted(spark: SparkSession, what: DataFrame | str) -> None:
    """The files of a folder, or of a result of ``written`` that nothing reads any more, go."""
    for folder in [what] if isinstance(what, str) else {x.rsplit("/", 1)[0] for x in what.inputFiles()}:
        old = spark._jvm.org.apache.hadoop.fs.Path(folder)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators need, by name; other columns, also with clashing names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class ChunkEncoder:
    """Token ids of whole texts as little-endian bytes, by a cache over white-space chunks.

    Tokenizers that split where one of KNOWN does never merge across the chunks that ``split`` finds, so
    the ids of a text are those of its chunks in a row (tests hold this against encoding whole texts).
    Texts that hold the string of an added token, and all texts of any other tokenizer, are encoded as a
    whole. Both caches are bounded: that of chunks starts anew at ``limit`` entries, that of words, which
    are chunks without the punctuation at their end and cost most to encode, at twice as many.
    """

    #: How a tokenizer must split for its chunks to be independent, by whether blanks count.
    KNOWN = {
        True: (None, [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}]),
        False: (
            [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
            [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}],
        ),
    }

    #: Punctuation that may be cut off a word's end: the tokenizers split there themselves.
    TAIL = ".,!?;:%*#$&"

    def __init__(self, path: str, keep_space: bool, width: int = 4, limit: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunked = self._independent(json.loads(self.tokenizer.to_str()), keep_space)
        # a chunk is a run without white space (with the one blank before it, where blanks count)
        self.pattern = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+" if keep_space else rf"[^{WHITE}]+").findall
        self.type, self.limit, self.fold, self.cache = {2: "H", 4: "I"}[width], limit, not keep_space, {}
        self.words: dict[str, bytes] = {"": b""}

    @classmethod
    def _independent(cls, made: dict, keep_space: bool) -> bool:
        """Whether a tokenizer, as its file describes it, splits as one of KNOWN."""
        flat = lambda x, parts: x[parts] if x and x["type"] == "Sequence" else x and [x]
        plain = lambda steps: steps and [{k: v for k, v in x.items() if k != "trim_offsets"} for x in steps]
        found = plain(flat(made["normalizer"], "normalizers")), plain(flat(made["pre_tokenizer"], "pretokenizers"))
        return found == cls.KNOWN[keep_space] and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])

    def split(self, text: str) -> list[str]:
        """The chunks of a text. Plain texts, with single blanks and line ends alone, need no pattern."""
        if self.fold:
            return self.pattern(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if any(c in text for c in self.ODD) or not text.isascii() and any(c in text for c in self.WIDE):
            return self.pattern(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    #: What keeps a text from the plain way: white space beside a blank or line end, and any other white space.
    ODD = ("  ", "\n ", " \n", "\n\n", "\0", "\t", "\x0b", "\x0c", "\r")
    WIDE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")

    def parts(self, chunk: str) -> tuple[str, str]:
        """A chunk as word and cut-off punctuation; the word in lower case where case is lost anyway."""
        word = chunk.rstrip(self.TAIL)
        if not word or not (word[-1].isalpha() and (word[-1].isascii() or "\u00c0" <= word[-1] < "\u0130")):
            word = chunk
        return word.lower() if self.fold and word.isascii() else word, chunk[len(word) :]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked or any(x in text for x in self.added):
            return array(self.type, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        chunks, cache = self.split(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            pass
        known = self.words
        if len(cache) > self.limit:
            cache.clear()
        if len(known) > 2 * self.limit:
            known.clear()
        cache[""] = known[""] = b""
        new = {x: self.parts(x) for x in set(chunks) if x not in cache}
        words = [x for x in {y for pair in new.values() for y in pair} if x not in known]
        for x, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            known[x] = array(self.type, e.ids).tobytes()
        for x, (word, tail) in new.items():
            cache[x] = known[word] + known[tail] if tail else known[word]
        return b"".join(map(cache.__getitem__, chunks))

    def clear(self) -> None:
        self.cache.clear()
        self.words.clear()


_kept: list = []


def only(cache) -> None:
    """Of the caches that last as long as a worker process, only the one in use keeps its entries.

    What the others held goes back to the system, as the workers of an executor share its memory."""
    if any(other is not cache for other in _kept):
        for other in _kept:
            if other is not cache:
                other.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)
    _kept[:] = [cache]


_encoders = lru_cache(maxsize=2)(ChunkEncoder)


def encoder(path: str, keep_space: bool, width: int = 4, limit: int = 700_000) -> ChunkEncoder:
    """One encoder for all tasks of a worker process, so what one has learned serves the next."""
    out = _encoders(path, keep_space, width, limit)
    only(out)
    return out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
