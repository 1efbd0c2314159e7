"""SimHash near-duplicates, found by Golay codewords near each part of a fingerprint."""

from __future__ import annotations

from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import free_name, map_slices, serve, slices, texts, typed
from .components import components

SHINGLE = 4
SEED = 42
#: Differing bits up to which fingerprints link; the keys below are made for it.
RADIUS = 4
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Start and width of the three segments of a fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code of length 23; a fixed value.
GENERATOR = 0xC75


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half the shingles set it."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    width = min(SHINGLE, len(words))
    spans = list(zip(starts, ends[width - 1:]))
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in spans[at:at + BLOCK]], ">u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(spans)).tobytes())


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``: the fingerprint of every whole text as a signed long."""
    docs = docs.select(*keep, F.col(text_col).alias("_text"))

    def step(batch):
        fps = np.array([fingerprint(t) for t in texts(batch, "_text")], np.uint64)
        return pa.record_batch([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return map_slices(docs, lambda: step, ", ".join([*(typed(docs, c) for c in keep), "fp long"]))


class Golay:
    """The perfect Golay code of 23 bits: every word lies within 3 bits of one codeword."""

    def __init__(self):
        self.parity = np.array([self._remainder(m << 11) for m in range(1 << 12)], np.int64)
        near: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                error = sum(1 << b for b in bits)
                at = near[int(self.syndrome(np.int64(error)))]
                if weight < 4 or at[0].bit_count() == 3:
                    at.append(error)
        self.size = np.array([len(x) for x in near])
        self.errors = np.array([x + [x[0]] * (6 - len(x)) for x in near], np.int64)

    @staticmethod
    def _remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        return word

    def syndrome(self, words):
        return (words & 0x7FF) ^ self.parity[words >> 11]

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the codewords that the word or a word one bit off decodes to.

        One codeword, or six where the word lies three bits off its own.  Two
        words that differ in at most two bits have the word between them in
        common, and so at least one index.  Rows of six, and which of them hold.
        """
        at = self.syndrome(words)
        return (words[:, None] ^ self.errors[at]) >> 11, np.arange(6) < self.size[at][:, None]


def _nearby(fps: np.ndarray, code: Golay):
    """The segments of the fingerprints and the codeword indices near each."""
    unsigned = fps.view(np.uint64)
    parts = [((unsigned >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
             for at, width in SEGMENTS]
    return parts, [code.nearby(p) for p in parts]


def pair_keys(fps: np.ndarray, code: Golay):
    """(keys, which fingerprints have them): a segment as it is and an index of another."""
    parts, found = _nearby(fps, code)
    kinds = [(same, near) for same in range(3) for near in range(3) if same != near]
    for kind, (same, near) in enumerate(kinds, 1):
        for i in range(6):
            yield (kind << 40) | (parts[same] << 12) | found[near][0][:, i], found[near][1][:, i]


def triple_keys(fps: np.ndarray, code: Golay):
    """(keys, which fingerprints have them): an index of each segment."""
    _, found = _nearby(fps, code)
    for at in product(range(6), repeat=3):
        (a, in_a), (b, in_b), (c, in_c) = ((f[0][:, n], f[1][:, n]) for f, n in zip(found, at))
        yield (a << 24) | (b << 12) | c, in_a & in_b & in_c


def keys_of(fps: np.ndarray, code: Golay, kinds=(pair_keys, triple_keys)) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the place of each one's fingerprint: any two within ``RADIUS`` share a key.

    Of at most four errors, either every segment has at most two: then the
    segments share a triple of codeword indices.  Or one has three or more and
    the others one at most between them: then one of these is equal and the
    other shares an index.
    """
    made = [(key[mask], np.flatnonzero(mask)) for kind in kinds for key, mask in kind(fps, code)]
    return np.concatenate([k for k, _ in made]), np.concatenate([h for _, h in made])


def keyed(roots: DataFrame, *kinds) -> DataFrame:
    """(key, fp, root) rows of distinct fingerprints: about 30 pair keys and 150 triples each."""
    def run(batches):
        serve(__name__)
        code = Golay()
        for batch in slices(batches, 2048):
            keys, held = keys_of(batch.column("fp").to_numpy(), code, kinds)
            yield pa.record_batch([pa.array(keys), *(c.take(pa.array(held)) for c in batch.columns)],
                                  names=["key", "fp", "root"])

    # A written table may lie in a few files; keys are made in as many tasks as a shuffle has.
    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return roots.select("fp", "root").repartition(tasks, "fp").mapInArrow(run, "key long, fp long, root long")


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) after the roots that ``links`` (a, b) connect have become one."""
    whole = components(links)
    return cut(roots.join(whole.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
               .select("fp", F.coalesce("new", "root").alias("root")))


def linked(fps: DataFrame) -> DataFrame:
    """(fp, root) of distinct fingerprints ``fps`` (fp); links connect those of one root.

    Never all pairs of a bucket.  First, the members of the buckets of pair keys
    are held against the bucket's least fingerprint; this joins most of a large
    group of near copies.  Then all keys are made, and of buckets that still hold
    several roots only the members outside the largest one go on: each meets one
    fingerprint of that root, and where it is not near, the others of the bucket.
    """
    roots = cut(fps.select("fp", F.col("fp").alias("root")))
    rows = keyed(roots, pair_keys).repartition("key")
    hubs = rows.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top")
    roots = _merged(roots, rows.join(hubs, "key").where((F.col("fp") != F.col("hub")) & _close("fp", "hub"))
                    .select(F.col("fp").alias("a"), F.col("hub").alias("b")))

    # The largest root of each bucket that holds several, and the least fingerprint of it there.
    rows = keyed(roots, pair_keys, triple_keys).repartition("key")
    main = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("fp").alias("hub")) \
        .groupBy("key").agg(F.max_by(F.struct("root", "hub"), F.struct("n", "root")).alias("m"),
                            F.count("*").alias("kinds")).where("kinds > 1") \
        .select("key", F.col("m.root").alias("main"), F.col("m.hub").alias("hub"))
    few = cut(rows.join(main, "key").where("root <> main"))
    merged = _merged(roots, few.where(_close("fp", "hub")).select(
        F.col("root").alias("a"), F.col("main").alias("b")))

    # Members that their bucket's largest root has still not taken in meet all others there.
    now = merged.select(F.col("fp").alias("hub"), F.col("root").alias("main_now"))
    left = cut(few.select("key", "fp", "hub", F.col("root").alias("old_a")).join(
        merged.withColumnRenamed("root", "now"), "fp").join(now, "hub").where("now <> main_now")
        .select("key", F.col("fp").alias("fp_a"), "old_a"))
    others = keyed(roots, pair_keys, triple_keys).select(
        "key", F.col("fp").alias("fp_b"), F.col("root").alias("old_b")).hint("merge")  # alike at every size
    near = left.join(others, (left.key == others.key) & (F.col("old_a") != F.col("old_b"))
                     & _close("fp_a", "fp_b")).select("fp_a", "fp_b").distinct()
    ends = [merged.select(F.col("fp").alias(f"fp_{x}"), F.col("root").alias(x)) for x in "ab"]
    return _merged(merged, near.join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b"))


def _rooted(marks: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint; root is the same for all that links connect."""
    return linked(marks.select("fp").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): groups of documents that links connect.

    The fingerprint is a string of 16 hexadecimal digits.  Null and empty texts
    have fingerprint zero and link like others.  ``component_id`` is the least
    id of the group; null ids stay in their group but never name it, unless all
    of its ids are null.  Repeated rows stay; other columns are not read.
    Copies share a fingerprint and are grouped by it before anything is joined.
    """
    marks = cut(fingerprints(docs, [id_col], text_col))
    firsts = marks.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    placed = firsts.join(_rooted(marks), "fp")
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every group of near-duplicates, with its own columns: the one with the least id.

    Groups are those of ``near_duplicates``: fingerprints of ``SHINGLE`` words that
    link at ``RADIUS`` bits or fewer.  Of several rows with the least id one with
    the least text hash stays, once; a null id comes after all others.
    """
    names = docs.columns
    none, key, text = (free_name([*names, "fp"], c) for c in ("id_none", "id_key", "text_hash"))
    docs = docs.withColumns({none: F.col(id_col).isNull(), text: F.xxhash64(text_col),
                             key: F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType))})
    marks = cut(fingerprints(docs, [none, key, text], text_col))
    # Copies meet as one row: the least of each fingerprint.
    least = marks.groupBy("fp").agg(F.min(F.struct(none, key, text)).alias("least"))
    kept = least.join(_rooted(marks), "fp").groupBy("root").agg(F.min("least").alias("least")) \
        .select("least.*")
    return docs.join(kept, [none, key, text], "left_semi").dropDuplicates([none, key, text]).select(*names)
