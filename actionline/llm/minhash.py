"""Operator 8: near-duplicates by banded MinHash with sequential Bayesian verification.

Only classes of equal shingle sets are compared, so exact copies cost one row each. Candidates come
from band buckets: first each bucket's smallest class is held against the others, which leaves most
buckets with one component. In the rest only classes of different components meet, in blocks of bounded
size inside tasks, where batch after batch of the signature prunes them before a row is made of any. So
a bucket costs its size, but for one with many classes that are in no link with each other: there, time
and what is sent grow with the square of their number over BLOCK, as no link may be lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import deleted, id_text, only, table, written
from actionline.llm.graph import components

BANDS, ROWS, BATCH = 32, 4, 32
HASHES = BANDS * ROWS
#: Rows of one bucket that a task compares with so many others at once.
BLOCK = 1500


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of all words as one where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(8)
    return draw.integers(0, 2**31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set; 32-bit arithmetic on the upper half of the hashes."""
    a, b = _multipliers()
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):  # a piece that stays in the processor's cache
        np.minimum(out, (x[None, lo : lo + 512] * a + b).min(1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        out = (out ^ x[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@lru_cache
def least_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """For each batch end m, the fewest matches k that keep a pair.

    With a uniform prior the posterior of the similarity is Beta(k + 1, m - k + 1), and the chance that
    it is at least t equals the chance that a Binomial(m + 1, t) is at most k. A pair goes as soon as
    that chance is under ``miss``.
    """
    out = []
    for m in range(BATCH, HASHES + 1, BATCH):
        total, k = 0.0, -1
        while total < miss:
            k += 1
            total += comb(m + 1, k) * similarity**k * (1 - similarity) ** (m + 1 - k)
        out.append(k)
    return tuple(out)


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; where sets of different second hashes share the first, _renamed tells them apart."""
    import xxhash

    raw = s.tobytes()
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)), int(np.uint64(xxhash.xxh3_64_intdigest(raw, 1)).astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, key and check of each row; signature and bands once for each class of a task, so exact
    copies are not dealt out. A task remembers the classes of its own rows."""
    only(_words)
    seen: set[tuple[int, int]] = set()
    for b in batches:
        ids, ns, keys, checks, sigs, bnd = [], [], [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingles(text.as_py())
            ids.append(i)
            ns.append(len(s))
            key = _key(s) if len(s) else (None, None)
            keys.append(key[0])
            checks.append(key[1])
            sig = None
            if len(s) and i is not None and key not in seen:
                seen.add(key)
                sig = signature(s)
            sigs.append(None if sig is None else sig.tobytes())
            bnd.append(None if sig is None else bands(sig))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bnd, pa.list_(pa.int64())), *b.columns[2:]], ["doc_id", "n", "key", "check", "sig", "bands", *b.schema.names[2:]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(_words)
    for b in batches:
        keys, checks, sets = [], [], []
        for text in b.column(0):
            s = shingles(text.as_py())
            if len(s):
                key, check = _key(s)
                keys.append(key)
                checks.append(check)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sets, pa.binary())], ["key", "check", "set"])


def _renamed(df: DataFrame, shared: DataFrame) -> DataFrame:
    """df (key, check and more) without check; keys that several sets share are made anew from both hashes."""
    out = df.join(shared.select("key", F.lit(True).alias("many")), "key", "left")
    return out.withColumn("key", F.when(F.col("many"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("check", "many")


def _bayes(pairs: DataFrame, similarity: float, miss: float) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that no batch prunes, without signatures."""
    need = least_matches(similarity, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            left, k = np.arange(len(x)), np.zeros(len(x), int)
            for step, least in enumerate(need):
                at = slice(step * BATCH, (step + 1) * BATCH)
                k = k + (x[left, at] == y[left, at]).sum(1)
                left, k = left[k >= least], k[k >= least]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(left)), b.column(1).take(pa.array(left))], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int, group: int = 64) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union.

    Each pair brings the set of b; that of a comes once for ``group`` pairs or so, ahead of them in the
    sorted partition, so a class in very many pairs neither fills a task nor is sent with each of them.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1_000_000)))
    many = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group)).cast("long").alias("salts"))
    salted = salted.join(many, "a").withColumn("salt", F.col("salt") % F.col("salts"))
    right = salted.join(sets, salted.b == sets.key).select("a", "salt", F.lit(1).alias("kind"), "b", "set")
    left = many.join(sets, many.a == sets.key).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, kind, b, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(s, np.uint64)
                if kind == 0:
                    at, mine = a, s
                elif a == at:
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, similarity: float, miss: float, best: bool) -> DataFrame | None:
    """Candidate pairs between different components within a bucket, by signature; None if no bucket has two.

    members: bucket, key, comp, n, sig. In a bucket, the component with most members is the large side;
    all others are held against it and against each other, in blocks of BLOCK x BLOCK rows. best: (a, b),
    of each two components in a block only the likeliest pair. Else (a, comp): each class of a smaller
    component with every other component in which the bounds keep any class of the block.
    """
    size = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    size = size.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("c"), F.sum("c").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    # written, so that the join below meets it as a table of known size, and can deal a hot bucket's rows to several tasks
    size = written(size.select("bucket", "top", F.ceil(F.col("total") / BLOCK).cast("long").alias("alls"), F.ceil((F.col("total") - F.col("c")) / BLOCK).cast("long").alias("smalls")), "buckets")
    if size.isEmpty():
        deleted(members.sparkSession, size)
        return None
    m = members.join(size, "bucket").withColumn("small", F.col("comp") != F.col("top")).withColumn("h", F.xxhash64("key"))
    # block (s, l): the s-th part of the smaller components against the l-th part of all rows
    as_small = m.where("small").select("*", F.pmod("h", F.col("smalls")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("alls") - 1)).alias("l"), F.lit(0).alias("side"))
    as_any = m.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("smalls") - 1)).alias("s"), F.pmod(F.shiftright("h", 20), F.col("alls")).alias("l"), F.lit(1).alias("side"))
    need = least_matches(similarity, miss)
    order = ["bucket", "s", "l"]
    dealt = as_small.union(as_any).select(*order, "side", "key", "comp", "n", "sig").repartition(*order).sortWithinPartitions(*order, "side", "key")

    def decide(u: np.ndarray, v: np.ndarray, group: np.ndarray, key: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows (u, v) those of different components that sizes and bounds keep."""
        ok = (comp[u] != comp[v]) & (np.minimum(n[u], n[v]) >= similarity * np.maximum(n[u], n[v]) - 1e-9)
        u, v, group = u[ok], v[ok], group[ok]
        k = np.zeros(len(u), int)
        for step, least in enumerate(need):
            at = slice(step * BATCH, (step + 1) * BATCH)
            k = k + (sig[u, at] == sig[v, at]).sum(1)
            ok = k >= least
            u, v, group, k = u[ok], v[ok], group[ok], k[ok]
        if not best:
            found = np.unique(np.stack([key[u], comp[v]], 1), axis=0)
            return found[:, 0], found[:, 1]
        if len(u):
            lo, hi = np.minimum(comp[u], comp[v]), np.maximum(comp[u], comp[v])
            by = np.lexsort((key[v], key[u], -k, hi, lo, group))
            first = np.r_[True, (np.diff(group[by]) != 0) | (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)]
            u, v = u[by[first]], v[by[first]]
        return key[u], key[v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list = []
        at, spans, first = None, [], 0  # spans of whole groups among the rows that wait

        def flush(rows: list, spans: list) -> pa.RecordBatch:
            side, key, comp, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(-1, HASHES)
            pairs: list[tuple] = []
            held: list[tuple] = []

            def close() -> None:
                if held:
                    pairs.append(decide(*(np.concatenate(x) for x in zip(*held, strict=True)), key, comp, n, sig))
                    held.clear()

            waiting = 0
            for g, (lo, hi) in enumerate(spans):
                cut = lo + int((side[lo:hi] == 0).sum())
                if best:  # a group's pairs have to be seen together
                    parts = [np.arange(lo, cut)]
                else:
                    step = max(1, 200_000 // max(1, hi - cut))
                    parts = [np.arange(i, min(i + step, cut)) for i in range(lo, cut, step)]
                for u in parts:
                    size = len(u) * (hi - cut)
                    if waiting + size > 200_000:
                        close()
                        waiting = 0
                    held.append((np.repeat(u, hi - cut), np.tile(np.arange(cut, hi), len(u)), np.full(size, g)))
                    waiting += size
            close()
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(8)]
            for row in zip(*cols, strict=True):
                if row[:3] != at:
                    if at is not None:
                        spans.append((first, len(left)))
                    if len(left) >= 4000:
                        yield flush(left, spans)
                        left, spans = [], []
                    at, first = row[:3], len(left)
                left.append(row[3:])
        if at is not None:
            spans.append((first, len(left)))
            yield flush(left, spans)

    pairs = dealt.mapInArrow(run, "a long, b long")
    if not best:
        return pairs.select("a", F.col("b").alias("comp")).distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(probes: DataFrame, named: DataFrame, sets: DataFrame, percent: int, part: int = 500) -> DataFrame:
    """Links (a, b) between classes a and the components that probes (a, comp) name, by full sets.

    A component's classes are dealt into parts; the probes for it go to each part, in parts of their own.
    A task holds one part of probes and reads the classes one by one: each set is sent once, not once
    for each pair. Of the links of a class within a part one is enough.
    """
    parts = lambda df: df.groupBy("comp").agg(F.ceil(F.count("*") / part).cast("long").alias("n"))
    # written, as in _across: a large component's classes can then go to several tasks
    sizes = written(parts(named).withColumnRenamed("n", "cs").join(parts(probes).withColumnRenamed("n", "ps"), "comp"), "sizes")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = probes.join(sizes, "comp").withColumn("p", F.pmod(F.xxhash64("a"), F.col("ps"))).withColumn("c", spread("cs")).join(sets.withColumnRenamed("key", "a"), "a")
    right = named.join(sizes, "comp").withColumn("c", F.pmod(F.xxhash64("key"), F.col("cs"))).withColumn("p", spread("ps")).join(sets, "key")
    order = ["comp", "c", "p"]
    rows = left.select(*order, F.lit(0).alias("kind"), F.col("a").alias("key"), "set").union(right.select(*order, F.lit(1).alias("kind"), "key", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, raw, index = None, [], [], None
        for b in batches:
            out_a, out_b = [], []
            for comp, c, p, kind, key, s in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (comp, c, p) != at:
                    at, keys, raw, index = (comp, c, p), [], [], None
                s = np.frombuffer(s, np.uint64)
                if kind == 0:
                    keys.append(key)
                    raw.append(s)
                    continue
                if index is None:  # which probes hold each hash
                    sizes = np.array([len(x) for x in raw])
                    flat, owner = (np.concatenate(raw), np.repeat(np.arange(len(raw)), sizes)) if raw else (np.empty(0, np.uint64), np.empty(0, int))
                    by = np.argsort(flat, kind="stable")
                    values, first, counts = np.unique(flat[by], return_index=True, return_counts=True)
                    index = (values, first, counts, owner[by], sizes, np.ones(len(raw), bool))
                values, first, counts, owner, sizes, open_ = index
                if not open_.any():
                    continue
                i = np.searchsorted(values, s)
                i = i[i < len(values)] if len(i) and i[-1] >= len(values) else i
                i = i[values[i] == s[: len(i)]]
                n = counts[i]
                spots = np.repeat(first[i] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(i) else np.empty(0, int)
                both = np.bincount(owner[spots], minlength=len(sizes))
                for j in np.flatnonzero(open_ & (100 * both >= percent * (sizes + len(s) - both))):
                    out_a.append(keys[j])
                    out_b.append(key)
                    open_[j] = False
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.repartition(*order).sortWithinPartitions(*order, "kind", "key").mapInArrow(run, "a long, b long")


def _united(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components found so far, joined where links (a, b) between them say so: only their
    roots are run through again, as there are few such links."""
    root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    named = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = written(named.where("a != b").distinct(), "between")
    if between.isEmpty():
        deleted(found.sparkSession, between)
        return found
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = found.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    alone = joined.join(found.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    out = written(known.union(alone), "roots")
    deleted(found.sparkSession, between)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-4, texts: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Sets and links as in the module's contract (five words, 100 * intersection >= percent * union). miss
    is the chance that sequential verification prunes a true link; banding itself misses a pair at 0.75
    with a chance of 5e-6. Texts that are null or without words: n_shingles 0, alone. Repeated rows and
    ties of doc_id: each row is judged by its own text. Null doc_id: linked with nothing, component null,
    kept false. Empty table: empty result. Texts of any length are used whole; further columns are ignored.
    With texts there are two columns more, which tell rows of one doc_id apart: text_id, xxhash64 of the text,
    and class_id, equal for texts of one component and for equal texts without words.
    """
    similarity = percent / 100
    docs = id_text(docs)
    extra = ["text_id"] if texts else []
    named = docs.withColumn("text_id", F.xxhash64("text")) if texts else docs
    rows = written(named.mapInArrow(_signed, ", ".join(["doc_id long, n long, key long, check long, sig binary, bands array<long>", *(f"{x} long" for x in extra)])), "signatures")
    # with 128 bits for a class, unrelated sets never become one; of 64 bits alone, some of 10**10 sets would be equal
    shared = written(rows.where("key is not null").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b").select("key"), "shared")
    rows = _renamed(rows, shared)
    linkable = rows.where("key is not null and doc_id is not null")
    classes = linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig", True).alias("sig"))
    exploded = linkable.select("key", F.explode("bands").alias("bucket"))
    # a bucket's classes, not its rows: min and max differ where there are two
    multi = exploded.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = written(exploded.join(multi, "bucket").distinct(), "members")
    nodes = written(members.select("key").distinct().join(classes.select("key", "rep", "n", "sig"), "key"), "classes")
    sets = written(_renamed(docs.join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("text").mapInArrow(_sets, "key long, check long, set binary"), shared).join(nodes.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")

    def sig(name: str) -> DataFrame:
        return nodes.select(F.col("key").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n").alias(f"n_{name}"))

    star = members.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    star = star.join(sig("a"), "a").join(sig("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    candidates = written(_bayes(star, similarity, miss), "pairs")
    links = written(_exact(candidates, sets, percent), "links")
    found, gone = components(links), [candidates, links, members, nodes, sets]
    # each bucket's pivot has been held against all others by now, so most buckets are done
    rest = members.where("key != pivot")
    for best in (True, False):
        named = rest.join(found, rest.key == found.node, "left").select("bucket", "key", F.coalesce("root", "key").alias("comp"))
        pairs = _across(named.join(nodes.select("key", "n", "sig"), "key"), similarity, miss, best)
        if pairs is None:
            break
        pairs = written(pairs, "pairs")
        if best:
            more = _exact(pairs, sets, percent)
        else:
            classes_of = nodes.select("key").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("comp"))
            more = _blocks(pairs, classes_of, sets, percent)
        links = written(more, "links")
        found, gone = _united(found, links), [*gone, pairs, links]
    for table_ in gone:
        deleted(docs.sparkSession, table_)
    named = rows.select("doc_id", "n", *extra, F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    named = named.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key"))
    # components of one row are named by it; the others are a table, so a large one's rows can go to several tasks
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    least = written(least.where("rows > 1").drop("rows"), "least")
    out = named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *extra, *([F.coalesce("comp", "text_id").alias("class_id")] if texts else []))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents. Null and empty texts, and those of white space: n_shingles 0, alone.
    Null doc_id: component null, not kept. Very long texts: whole sets. Ties of doc_id and repeated rows: each
    judged by its own text. Other columns, clashing names among them, are ignored. Empty table: empty result."""
    return near_duplicates(table(spark, sf_dir, "documents"))
