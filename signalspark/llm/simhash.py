"""SimHash fingerprints, links between near fingerprints, and the groups they form.

Links are found by pigeonring filtering. The 64 bits are cut into ``most + 1`` consecutive
segments that form a ring. If two fingerprints differ in at most ``most`` bits, then from some
segment on every chain of consecutive segments stays within its proportional budget: its first
l segments differ in at most ``l * most / segments`` bits, which is l - 1. So the first segment is
equal, and the l - 1 next ones, cut into 2 * (l - 1) blocks, have l - 1 equal blocks at least: the
first segment with these is the key of an equi-join, one key for each choice of blocks. The length
of the chain is taken from the number of fingerprints, so that few share a key by chance, at any
size. The longer chains and then the full distance are tested in the join's condition, so a pair
that fails leaves no row.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, join_counted, read_spread, released, text_column
from .components import connected_components

BITS = 64
SEED = 42
#: A key that more fingerprints share than this, and many times the expected number, is crowded.
CROWDED = 64
#: The shortest chain is taken of whose keys this many fingerprints share one by chance.
BY_CHANCE = 16


def fingerprint(text: str | None, words: int = 4, distinct: bool = False) -> int:
    """Signed 64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 for no word.

    A bit is 1 if over half the XXH64 hashes of the shingles have it. ``distinct`` counts a
    repeated shingle once. Fewer words than a shingle's are one shingle.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(w, lambda end, x: end + 1 + len(x), initial=-1))
    k = min(words, len(w))
    total = len(w) - k + 1
    if distinct:
        shingles = list({joined[a + 1 : b] for a, b in zip(ends, ends[k:], strict=False)})
        total = len(shingles)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, 50_000):
        part = shingles[at : at + 50_000] if distinct else [joined[a + 1 : b] for a, b in zip(ends[at : at + 50_000], ends[at + k : at + k + 50_000], strict=False)]
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in part]), np.uint8)
        counts += np.unpackbits(raw).reshape(-1, BITS).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def _majority(hashes: set[int]) -> int:
    """The fingerprint of distinct shingles, from their hashes as ``_hashed`` has them."""
    counts = np.zeros(BITS, np.int64)
    whole = (np.fromiter(hashes, np.int64, len(hashes)).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    for at in range(0, len(whole), 50_000):
        counts += np.unpackbits(whole[at : at + 50_000].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(whole)).view(">i8")[0])


def fingerprint_column(text: Column, words: int = 4, distinct: bool = False) -> Column:
    return text_column(text, "long", lambda texts: pa.array([fingerprint(t, words, distinct) for t in texts], pa.int64()))


def _segments(most: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of the ``most + 1`` segments of the ring."""
    n = most + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _bits(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def _masks(most: int, chain: int) -> list[tuple[int, int, int]]:
    """(start, choice, mask) of every key: a segment, and as many of the next ``chain - 1``
    segments' ``2 * (chain - 1)`` blocks as are equal at least."""
    ring, out = _segments(most), []
    for start in range(len(ring)):
        following = [ring[(start + k) % len(ring)] for k in range(1, chain)]
        bits = [at + k for at, width in following for k in range(width)]
        n = 2 * (chain - 1)
        edges = [len(bits) * i // n for i in range(n + 1)]
        blocks = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        for choice, chosen in enumerate(combinations(blocks, chain - 1)):
            out.append((start, choice, _bits(*ring[start]) | sum(chosen)))
    return out


def key_bits(most: int, chain: int) -> int:
    return min(mask.bit_count() for _, _, mask in _masks(most, chain))


def chain_length(total: int, most: int) -> int:
    """The shortest chain, of two to four segments, whose keys hardly any two of ``total`` share by chance."""
    longest = max(2, min(4, most))
    return next((n for n in range(2, longest) if total >> key_bits(most, n) < BY_CHANCE), longest)


def _keys(fp: Column, most: int, chain: int) -> Column:
    """Array of (start, choice, key)."""
    return F.array(*(F.struct(F.lit(i).cast("int").alias("start"), F.lit(c).cast("int").alias("choice"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, c, mask in _masks(most, chain)))


def _within(x: Column, start: Column, most: int) -> Column:
    """Whether the differing bits ``x`` keep to the budget of every chain from ``start``, and in all."""
    ring = _segments(most)
    n = len(ring)
    test = F.lit(True)
    for length in range(2, n):
        masks = [_signed(sum(_bits(*ring[(i + k) % n]) for k in range(length))) for i in range(n)]
        test = test & (F.bit_count(x.bitwiseAND(F.array(*map(F.lit, masks))[start])) <= length * most // n)
    return test & (F.bit_count(x) <= most)


def candidate_pairs(points: DataFrame, most: int, chain: int = 2) -> DataFrame:
    """Distinct ``(a, b)`` of ``points(id, fp, near)`` whose fingerprints differ in ``most`` bits
    at most, a < b, but for pairs that have the same ``near``. A crowded key that only one value
    of ``near`` has is left out before the join."""
    keyed = points.select("*", F.explode(_keys(F.col("fp"), most, chain)).alias("k")).select(*points.columns, "k.*")
    key = ["start", "choice", "key"]
    settled = keyed.groupBy(key).agg(F.min("near").alias("x"), F.max("near").alias("y"), F.count("*").alias("n")).where((F.col("x") == F.col("y")) & (F.col("n") > CROWDED)).select(key)
    keyed = keyed.join(settled, key, "left_anti")
    a, b = keyed.alias("a"), keyed.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key]
    near = (F.col("a.id") < F.col("b.id")) & (F.col("a.near") != F.col("b.near"))
    on.append(near & _within(F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.col("a.start"), most))
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _crowd(total: int, most: int, chain: int) -> int:
    """So many of ``total`` fingerprints, at least, don't share a key by chance."""
    return CROWDED + 8 * (total >> key_bits(most, chain))


def _crowded_links(prints: DataFrame, most: int, chain: int, crowd: int) -> DataFrame:
    """Links between fingerprints that differ in two bits at most, among those with a crowded key.

    A fingerprint is put at itself and at each value one bit away; all that meet at a value link
    to the smallest id there. So a dense group costs 65 rows a fingerprint, not its square.
    """
    keyed = prints.select("id", "fp", F.explode(_keys(F.col("fp"), most, chain)).alias("k")).select("id", "fp", "k.*")
    key = ["start", "choice", "key"]
    crowded = keyed.groupBy(key).count().where(F.col("count") > crowd).select(key)
    dense = keyed.join(crowded, key, "left_semi").select("id", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    placed = dense.select("id", "fp", F.explode(flips).alias("flip")).select("id", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    least = placed.groupBy("place").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("place", "least")
    return placed.join(least, "place").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()


def _points(prints: DataFrame, most: int, chain: int | None = None, crowd: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Links within dense groups of ``prints(id, fp)``, ``(id, fp, near)`` by these, and the chain."""
    total = prints.count()
    chain = chain or chain_length(total, most)
    crowd = _crowd(total, most, chain) if crowd is None else crowd
    close = _crowded_links(prints, most, chain, crowd) if most >= 2 else prints.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    groups = connected_components(close)
    return close, checkpointed(prints.join(groups, F.col("id") == F.col("node"), "left").select("id", "fp", F.coalesce("component", "id").alias("near"))), chain


def fingerprint_links(texts: DataFrame, most: int = 4) -> DataFrame:
    """``(a, b)`` of ``texts(id, fp)``, a < b: texts of one fingerprint with the smallest of them, and pairs of
    those that differ in ``most`` bits or fewer. Their components are those of all such pairs."""
    prints = checkpointed(texts.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    same = join_counted(texts, prints.withColumnRenamed("id", "least"), ["fp"]).where("least < id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    close, points, chain = _points(prints.select("id", "fp"), most)
    return same.union(close.select(F.least("a", "b"), F.greatest("a", "b"))).union(candidate_pairs(points, most, chain)).distinct()


def fingerprint_components(prints: DataFrame, most: int = 4, chain: int | None = None, crowd: int | None = None) -> DataFrame:
    """``(id, fp, component)`` of distinct fingerprints ``prints(id, fp)``, linked at ``most`` bits or fewer.

    The component is its smallest id. Dense groups are first joined through shared one-bit
    neighbours; then only pairs from different groups so far are looked for. ``chain`` and
    ``crowd``, the number from which a key is crowded, follow from the number of fingerprints
    unless they are given; neither changes the answer.
    """
    prints = checkpointed(prints.select("id", "fp"))
    _, points, chain = _points(prints, most, chain, crowd)
    links = candidate_pairs(points, most, chain).union(points.where("id <> near").select("near", "id"))
    components = connected_components(links)
    return prints.join(components, F.col("id") == F.col("node"), "left").select("id", "fp", F.coalesce("component", "id").alias("component"))


def simhash_groups(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most ``most`` bits are linked; component_id is the
    smallest doc_id reachable by links, the document's own included. Copies, and documents
    without a word (fingerprint 0), have one fingerprint, whose node in the graph is the smallest
    doc_id that has it; no pair of documents is ever made, and no join gathers a component. Null
    text counts as empty, rows that repeat stay. A row with a null doc_id links nothing, and gets
    the component_id of the documents of its fingerprint, null if there are none. Other columns
    are ignored. ``most`` is 1 to 15.
    """
    marked = checkpointed(docs.select("doc_id", fingerprint_column(F.col("text"), words).alias("fp")))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    answer = fingerprint_components(nodes.where("id is not null"), most).select("fp", F.col("component").alias("component_id"))
    answer = checkpointed(nodes.select("fp", "n").join(answer, "fp", "left"))
    return join_counted(marked, answer, ["fp"]).select("doc_id", "fp", "component_id")


#: Documents of one sequence of words have one key; the shingles of a text, hashed and distinct.
_PROFILE = "key_a:bigint,key_b:bigint,fp:bigint,size:int,parity:array<bigint>,prefix:array<bigint>"
#: Shingles that ``COMMON`` of some ``SAMPLE`` documents have come last in the order of a prefix.
SAMPLE, COMMON = 20_000, 3
#: Bits of a set's parities.
PARITIES = 512
_WORDS = [f"p{k}" for k in range(PARITIES // 64)]
#: Texts are shuffled only if their id's hash is among those, of so many, that the wanted ids have.
SLOTS = 1 << 21
#: A shingle that more texts than this have in their prefix is first linked through one of them.
HUB = 8
#: Rows of prefixes, and pairs of texts, that are on disk at once, and the most parts that either is done in.
PART_ROWS, PART_PAIRS, PARTS = 3_000_000, 20_000, 24
#: Most differing bits of two fingerprints that are linked.
MOST = 4


def _prefix(hashes: set[int], common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share: ``common`` ones (sorted) last,
    else by hash. So many that a set as similar has one of them among its own first."""
    s = np.sort(np.fromiter(hashes, np.int64, len(hashes)))
    if len(common) and len(s):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[: len(s) - math.ceil(similarity * len(s) - 1e-6) + 1]


def _parity(hashes: set[int]) -> np.ndarray:
    """Whether the shingles of each of ``PARITIES`` classes are odd in number, as bits of longs. Two
    sets have as many unequal bits at most as there are shingles in just one of them."""
    odd = np.bincount(np.fromiter(hashes, np.int64, len(hashes)) & PARITIES - 1, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that several documents of a sample have. They only order the shingles of a prefix:
    any order finds the same pairs, but rare shingles first makes few candidates."""
    every = max(1, docs.count() // SAMPLE)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = drawn.select(F.explode(_hash_column(F.col("text"), words)).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(np.fromiter((r[0] for r in counts.select("h").collect()), np.int64))


def _profile(text: Column, words: int, common: np.ndarray, similarity: float) -> Column:
    """Struct of a text's sequence of words as a 128-bit key, and its distinct shingles' fingerprint,
    number, parities and prefix."""
    longs = pa.list_(pa.int64())
    kinds = {"key_a": pa.int64(), "key_b": pa.int64(), "fp": pa.int64(), "size": pa.int32(), "parity": longs, "prefix": longs}

    def profiles(texts: list[str | None]) -> pa.Array:
        out = []
        for t in texts:
            key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())), ">i8")
            hashes = _hashed(t, words)
            out.append((int(key[0]), int(key[1]), _majority(hashes), len(hashes), _parity(hashes), _prefix(hashes, common, similarity)))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return text_column(text, f"struct<{_PROFILE}>", profiles)


def _hash_column(text: Column, words: int) -> Column:
    """Array of the hashed distinct shingles of a text."""
    return text_column(text, "array<long>", lambda texts: pa.array([np.fromiter(_hashed(t, words), np.int64) for t in texts], pa.list_(pa.int64())))


def _shingles(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    w = (text or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(min(words, len(w)))), strict=False))


def _hashed(text: str | None, words: int) -> set[int]:
    """Signed hashes of the distinct shingles."""
    w = (text or "").encode().lower().split()
    joined = b" ".join(w)
    ends = list(accumulate(w, lambda end, x: end + 1 + len(x), initial=-1))
    k = min(words, len(w))
    return {xxhash.xxh64_intdigest(joined[a + 1 : b], SEED) - (1 << 63) for a, b in zip(ends, ends[k:], strict=False)} if w else set()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(id, set)``: the hashed distinct shingles of the texts of ``ids(id)``."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = ids.select(slot.alias("slot")).distinct()
    few = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")
    return checkpointed(few.join(ids, "id", "left_semi").select("id", _hash_column(F.col("text"), words).alias("set")))


def _alike(x: Column, y: Column, similarity: float) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared >= similarity * (F.size(x) + F.size(y) - shared)


def _parts(n: int, size: int) -> int:
    return max(1, min(PARTS, -(-n // size)))


def _part(key: str, k: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)) == k


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that are as similar, some thousand at a time: their sets are larger than
    the texts, and each part's are gone before the next."""
    pairs = checkpointed(pairs)
    sets = _sets(docs, _ends(pairs), words)
    parts = _parts(pairs.count(), PART_PAIRS)
    found = []
    for k in range(parts):
        both = pairs.where(_part("a", k, parts)).join(sets.toDF("a", "x").where(_part("a", k, parts)), "a").join(sets.toDF("b", "y"), "b")
        found.append(checkpointed(both.where(_alike(F.col("x"), F.col("y"), similarity)).select("a", "b")))
        del both
        released(docs.sparkSession)
    return reduce(DataFrame.union, found)


def _prefix_test(similarity: float) -> Column:
    """Whether two sets may be as similar, by their sizes, by what is left after a shared shingle, and
    by their parities, which differ in no more bits than there are shingles in one of them only.

    No shingle before the first that they share is shared, so similar sets pass there. The test is
    part of the join's condition: a pair that fails leaves no row."""
    sizes = F.col("a.size") + F.col("b.size")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    sized = (F.col("a.size") >= similarity * F.col("b.size") - 1e-6) & (F.col("b.size") >= similarity * F.col("a.size") - 1e-6)
    unequal = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in _WORDS), F.lit(0))
    alike = unequal <= (1 - similarity) / (1 + similarity) * sizes + 1e-6
    return (F.col("a.near") != F.col("b.near")) & sized & (left >= similarity / (1 + similarity) * sizes - 1e-6) & alike


def _hub_pairs(apart: DataFrame, test: Column) -> DataFrame:
    """Pairs of the rows of a crowded shingle with one of them, another for each shingle."""
    hubs = apart.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "key").alias("lot"), "id", "size", "at", "near", *_WORDS)).alias("b"))
    hubs = hubs.where(F.col("n") > HUB).select("key", "b")
    pairs = apart.alias("a").join(hubs, "key").where(test)
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _rest_pairs(apart: DataFrame, test: Column) -> DataFrame:
    """Pairs of different ``near`` that share a shingle. The largest ``near`` of a shingle meets the
    others only, so that the pairs within a dense group are not even tried."""
    counts = apart.groupBy("key", "near").agg(F.count("*").alias("n")).groupBy("key")
    major = counts.agg(F.max(F.struct("n", "near")).alias("m"), F.count("*").alias("k")).where("k > 1").select("key", F.col("m.near").alias("major"))
    minor = apart.join(major, "key").where("near <> major")
    on = [F.col("a.key") == F.col("b.key"), ((F.col("b.near") == F.col("a.major")) | (F.col("a.id") < F.col("b.id"))) & test]
    pairs = minor.alias("a").join(apart.alias("b"), on)
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _several(sets: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """``(id, size, at, key, part)``: the shingles that several prefixes have. All are dealt to parts in one
    pass over the sets; each part's are read by themselves."""
    spark = sets.sparkSession
    rows = sets.select("id", "size", F.posexplode("prefix").alias("at", "key")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    same = Window.partitionBy("key")
    found = []
    with Scratch(spark) as own:
        dealt = own.write(rows, "part")
        for k in range(parts):
            part = dealt.where(F.col("part") == k).withColumn("x", F.min("id").over(same)).withColumn("y", F.max("id").over(same))
            found.append(scratch.write(part.where("x < y").select("id", "size", "at", "key", "part")))
            released(spark)
    return reduce(DataFrame.union, found)


def _shared(shingles: DataFrame, k: int, parts: int) -> DataFrame:
    """The rows of one of ``parts`` parts of the table of ``shingles``."""
    return shingles.where(F.col("part") == k) if parts > 1 else shingles


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, group_id)`` of ``docs(doc_id, text)``: groups of documents linked by a Jaccard
    similarity of at least ``similarity`` of their distinct shingles of ``words`` words.

    Texts whose SimHash fingerprints differ in ``MOST`` bits or fewer, found by pigeonring chains, are
    candidates first. A pair as similar may differ in more bits, so the exact way for the rest is prefix
    filtering, which is complete: in one order of all shingles, rare
    ones first, two sets as similar share one of their first ``size - ceil(similarity * size) + 1``.
    Bounds by sizes, by places in the order and by parities, all of them sound, part most of the
    others; then the similarity is computed exactly. A shingle that many prefixes have is first
    linked through one text, so that of a dense group only those pairs are made that its links so
    far leave apart. The shingles of prefixes are dealt to parts in one pass; a part's are compared, and
    joined, by themselves, so that the work grows with the shingles and not with the parts' number too. Texts of the same words in A-Z lower case are one text and never make pairs;
    texts without a word are one group, as null is. group_id is the group's smallest doc_id. Rows
    with a null doc_id are left out; rows that repeat stay.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    profile = _profile(F.col("text"), words, _common(docs, words), similarity)
    profiles = checkpointed(docs.select("doc_id", profile.alias("p")).select("doc_id", "p.*"))
    marked = checkpointed(profiles.select("doc_id", "key_a", "key_b"))
    texts = checkpointed(marked.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id")))
    named = docs.withColumnRenamed("doc_id", "id")
    sets = checkpointed(profiles.withColumnRenamed("doc_id", "id").drop("key_a", "key_b").join(texts.select("id"), "id", "left_semi"))
    del profiles
    released(docs.sparkSession)
    pairs = [checkpointed(fingerprint_links(sets.select("id", "fp"), MOST))]
    released(docs.sparkSession)

    parts = _parts(sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0], PART_ROWS)
    test = _prefix_test(similarity)
    with Scratch(docs.sparkSession) as scratch:
        several = _several(sets, parts, scratch)
        ids = checkpointed(sets.select("id", *(F.get("parity", F.lit(i)).alias(p) for i, p in enumerate(_WORDS))).distinct())
        del sets
        shingles = scratch.write(several.join(ids.withColumn("near", F.col("id")), "id"), "part")
        for k in range(parts):
            pairs.append(checkpointed(_hub_pairs(_shared(shingles, k, parts), test)))
            released(docs.sparkSession)
        links = _verified(reduce(DataFrame.union, pairs).distinct(), named, words, similarity)
        near = connected_components(links)
        ids = ids.join(near, F.col("id") == F.col("node"), "left").select(*ids.columns, F.coalesce("component", "id").alias("near"))
        shingles = scratch.write(several.join(ids, "id"), "part")
        pairs = []
        for k in range(parts):
            pairs.append(checkpointed(_rest_pairs(_shared(shingles, k, parts), test)))
            released(docs.sparkSession)
    del links, ids
    stars = near.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    groups = connected_components(stars.union(_verified(reduce(DataFrame.union, pairs).distinct(), named, words, similarity)))
    answer = texts.join(groups, F.col("id") == F.col("node"), "left").select("key_a", "key_b", F.coalesce("component", "id").alias("group_id"))
    return marked.join(answer, ["key_a", "key_b"]).select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` but those whose group, as of ``near_duplicate_groups``, has a smaller
    doc_id; rows of a null doc_id, and rows that repeat the smallest one, stay."""
    gone = near_duplicate_groups(docs, words, similarity).where("group_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_spread(spark, sf_dir, "documents", "doc_id"), words=4, most=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
