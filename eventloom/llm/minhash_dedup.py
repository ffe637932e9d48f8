"""Near-duplicate groups by b-bit MinHash.

1. Documents with the same shingle set are one class; only classes go on.
2. Each class has a number of buckets that follows from the threshold, each from ROWS minima.  Classes that share a bucket with another one get a signature:
   the low bits of LANES further minima, packed.
3. Stars: in every bucket each class is paired with the bucket's few centres, so pairs grow with the members of a bucket, not with
   their square.  A class takes the centre whose similarity, estimated from equal signature bits and corrected for chance
   hits, is highest; the estimate must come within five standard errors of the threshold, and the pair is then confirmed
   on the full shingle sets.
4. What is left are buckets with classes of different components.  They are compared block by block, where set sizes are in reach
   of each other, and all pairs across components that pass the estimate are confirmed on full sets, so no link that shares
   a bucket is lost.

Buckets, centres and classes that hold a large share of all rows are dealt over several tasks by a salt (common.Hot).
Two sets at the threshold t share no bucket with probability (1 - t^ROWS)^bands <= MISS: 25 bands at 0.85, 37 at 0.8.
"""

from __future__ import annotations

import math
from functools import cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hot, intermediates, row_map, words, written
from .graph import components

SHINGLE, ROWS = 5, 5
MISS, MOST_BANDS = 5e-7, 512
LANES = 2048  # one bit each
BLOCK = 1024
CENTRES = 3
SHINGLES = 1 << 22  # of a block's sets, on average
CELL = ("bucket", "low", "i", "high", "j")
_RANDOM = np.random.default_rng(20260)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LANE_A = _RANDOM.integers(1, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LANE_B = _RANDOM.integers(0, 2**32, LANES, dtype=np.uint32)


def bands_for(percent: int) -> int:
    """The least number of bands whose chance to miss a pair at the threshold is at most MISS; an error beyond MOST_BANDS."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}, not within 1 to 100")
    found = 1 if percent == 100 else math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))
    if found > MOST_BANDS:
        raise ValueError(f"a threshold of {percent} percent needs {found} bands, more than {MOST_BANDS}")
    return found


@cache
def permutations(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multipliers and summands of bands * ROWS permutations, and the multipliers that make a bucket of ROWS minima."""
    random = np.random.default_rng([20260, bands])
    odd = lambda *size: random.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(bands * ROWS), random.integers(0, 2**63, bands * ROWS, dtype=np.uint64), odd(bands, ROWS)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, no word none."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + h[i : len(h) - n + 1 + i]
    return np.unique(mixed_bits(out))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """The least value of the shingles under each permutation x -> a * x + b."""
    out = np.full(len(a), np.iinfo(a.dtype).max, dtype=a.dtype)
    for i in range(0, len(shingles), block):
        np.minimum(out, (shingles[i : i + block, None] * a + b).min(0), out=out)
    return out


def buckets_of(shingles: np.ndarray, bands: int) -> list[int]:
    a, b, band = permutations(bands)
    rows = (minima(shingles, a, b) >> np.uint64(20)).reshape(bands, ROWS)
    return mixed_bits((rows * band).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _BASE).view(np.int64).tolist()


def signature_of(shingles: np.ndarray) -> list[int]:
    """The low bit of each lane's minimum, after mixing, as 64-bit words."""
    least = minima((shingles >> np.uint64(32)).astype(np.uint32), _LANE_A, _LANE_B).astype(np.uint64)
    return np.packbits((mixed_bits(least * _BASE) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def set_key(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def sketches(texts: list, bands: int) -> list[list]:
    found = [shingle_set(t) for t in texts]
    return [[len(x) for x in found], [set_key(x) for x in found], [buckets_of(x, bands) if len(x) else None for x in found]]


def set_keys(texts: list) -> list[list]:
    return [[set_key(shingle_set(t)) for t in texts]]


def sets(texts: list) -> list[list]:
    found = [shingle_set(t) for t in texts]
    return [[set_key(x) for x in found], [x.view(np.int64).tolist() for x in found], [signature_of(x) if len(x) else None for x in found]]


def estimate(a: Column, b: Column) -> Column:
    """The similarity from the share of equal bits, less the half that agrees by chance."""
    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return 1 - 2 * unequal / LANES


def block_candidates(table: pa.Table, percent: int, cut: float, rows: int = 64) -> pa.Table:
    """Members of two blocks of a bucket, or of one, that have a candidate there, with their candidates: other label, size and estimate in reach, first shared band here.

    (bucket, low, i, high, j, node, others): a row a member, others being the candidates to its right; each pair comes once.
    """
    nodes, labels = (np.array(table.column(c).to_pylist(), dtype=object) for c in ("node", "label"))
    n, own, size_class = (table.column(c).to_numpy() for c in ("n", "own", "size_class"))
    signature = np.array(table.column("signature").to_pylist(), dtype=np.int64).view(np.uint64)
    buckets = np.array(table.column("buckets").to_pylist(), dtype=np.int64)
    cell = {c: table.column(c)[0].as_py() for c in CELL}
    bucket, low, i, high, j = cell.values()
    label = np.unique([x.hex() for x in labels], return_inverse=True)[1]
    left, right = np.flatnonzero((own == i) & (size_class == low)), np.flatnonzero((own == j) & (size_class == high))
    found: dict = {}
    for start in range(0, len(left), rows):
        a = left[start : start + rows]
        unequal = np.zeros((len(a), len(right)), dtype=np.int32)
        for word in range(signature.shape[1]):
            unequal += np.bitwise_count(signature[a, word][:, None] ^ signature[right, word][None])
        near = (1 - 2 * unequal / LANES >= cut) & (label[a][:, None] != label[right][None])
        near &= 100 * np.minimum(n[a][:, None], n[right][None]) >= percent * np.maximum(n[a][:, None], n[right][None])
        if (low, i) == (high, j):
            near &= a[:, None] < right[None]
        x, y = np.nonzero(near)
        x, y = a[x], right[y]
        if len(x):
            equal = buckets[x] == buckets[y]
            first = buckets[x, equal.argmax(1)] == bucket
            for one, other in zip(x[first].tolist(), y[first].tolist(), strict=True):
                found.setdefault(one, []).append(nodes[other])
                found.setdefault(other, [])
    out = {c: pa.array([cell[c]] * len(found), pa.int64()) for c in CELL}
    return pa.table({**out, "node": pa.array(nodes[list(found)].tolist() if found else [], pa.binary()), "others": pa.array(list(found.values()), pa.list_(pa.binary()))})


def block_links(table: pa.Table, percent: int) -> pa.Table:
    """Edges (u, v) of what block_candidates found in a cell, confirmed on the full sets (shingles, sorted); of links within a component of the cell, only as many as hold it together."""
    nodes = table.column("node").to_pylist()
    sets = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles").combine_chunks()]
    at = {x: k for k, x in enumerate(nodes)}
    root = list(range(len(nodes)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    u, v = [], []
    for k, others in enumerate(table.column("others").to_pylist()):
        mine = sets[k]
        for m in (at[x] for x in others):
            x, y = top(k), top(m)
            if x == y:
                continue
            place = np.minimum(np.searchsorted(mine, sets[m]), len(mine) - 1)
            common = int((mine[place] == sets[m]).sum())
            if 100 * common >= percent * (len(mine) + len(sets[m]) - common):
                root[max(x, y)] = min(x, y)
                u.append(nodes[k])
                v.append(nodes[m])
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of an id and a key a row, to broadcast if a count shows at most so many rows (some megabytes); else the planner decides."""
    return F.broadcast(df) if df.count() <= most else df


class Links:
    """Candidate pairs and their confirmation."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int):
        self.percent = percent
        share = (1 + percent / 100) / 2
        self.cut = percent / 100 - 5 * 2 * (share * (1 - share) / LANES) ** 0.5
        buckets = classes.select("node", F.explode("buckets").alias("bucket"))
        several = written(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        self.hot = Hot(several, "bucket")
        self.members = written(self.hot.dealt(buckets, "node").join(self.hot.copied(several.select("bucket")), ["bucket", "_salt"]), "members")
        nodes = self.members.select("node").distinct()
        wanted = few(written(classes.join(nodes, "node").select(F.col("min_id").alias("doc_id"), F.col("node").alias("want")), "wanted"))
        texts = docs.select("doc_id", "text").join(wanted, "doc_id")
        found = row_map(texts, {"node": "binary", "shingles": "array<bigint>", "signature": "array<bigint>"}, sets, "text")
        found = found.where("node = want").select("node", "shingles", "signature").dropDuplicates(["node"])
        self.sets = written(found.withColumn("n", F.size("shingles")).join(classes.select("node", "buckets"), "node"), "sets")

    def both(self, pairs: DataFrame, hot: Hot, *columns: str) -> DataFrame:
        """The pairs (a, b) with columns of both classes; b may be in very many pairs."""
        left, right = (self.sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
        return hot.dealt(pairs.join(left, "a"), "a").join(hot.copied(right), ["b", "_salt"]).drop("_salt")

    def confirmed(self, pairs: DataFrame, hot: Hot) -> DataFrame:
        """Edges (u, v) of the pairs (a, b) that reach the threshold on their full sets."""
        both = self.both(pairs.select("a", "b"), hot, "shingles")
        common = F.size(F.array_intersect("shingles_a", "shingles_b"))
        union = F.size("shingles_a") + F.size("shingles_b") - common
        return both.where(100 * common >= self.percent * union).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def stars(self) -> DataFrame:
        """For each class, the centre that it shares most buckets with, confirmed; every bucket has up to CENTRES centres.

        A class and a centre share a bucket as often as they are similar, so that count tells which centre to take; a link that this passes over is left to rest().
        """
        least = [F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"] for k in range(CENTRES)]
        centres = self.members.groupBy("bucket").agg(F.array_distinct(F.array(*least)).alias("centres"))
        pairs = self.members.join(self.hot.copied(centres), ["bucket", "_salt"]).select(F.col("node").alias("a"), F.explode("centres").alias("b")).where("a <> b")
        best = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
        best = written(best, "star-pairs")
        return written(self.confirmed(best, Hot(best.groupBy("b").agg(F.count("*").alias("n")), "b")), "links")

    def labelled(self, labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several labels."""
        found = self.members.join(labels, "node")
        mixed = found.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("bucket")
        return found.join(self.hot.copied(mixed), ["bucket", "_salt"])

    def rest(self, labels: DataFrame) -> DataFrame:
        """All pairs across labels within the buckets that hold several, confirmed.

        Sets in reach of each other differ by at most one size class.  The members of a bucket and size class are compared block by
        block, BLOCK by BLOCK rows on average and fewer where sets are large.  No pair leaves a task: what passes the estimate is listed with
        its members, a row each, these meet again with their full sets, and links leave as far as they hold components together.
        """
        size_class = F.floor(F.log(F.col("n").cast("double")) / -math.log(self.percent / 100 - 1e-9) if self.percent < 100 else F.col("n"))
        traits = self.sets.select("node", "n", "signature", "buckets", size_class.cast("long").alias("size_class"))
        open_ = written(self.labelled(labels).join(traits.select("node", "size_class", "n"), "node"), "open")
        sizes = open_.groupBy("bucket", "size_class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"))
        by_class = sizes.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("size_class", "blocks"))).alias("blocks"))  # few size classes
        rows = open_.drop("size_class", "n").join(self.hot.copied(by_class), ["bucket", "_salt"]).join(traits, "node")
        count = lambda by: F.coalesce(F.try_element_at("blocks", F.col("size_class") + by), F.lit(0).cast("long"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), count(0)))
        numbers = lambda by: F.when(count(by) > 0, F.sequence(F.lit(0).cast("long"), count(by) - 1)).otherwise(F.array().cast("array<bigint>"))
        cell = lambda low, i, high, j: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"))
        here, own = F.col("size_class"), F.col("own")
        cells = F.concat(F.transform(numbers(0), lambda k: cell(here, F.least(own, k), here, F.greatest(own, k))), F.transform(numbers(1), lambda k: cell(here, own, here + 1, k)), F.transform(numbers(-1), lambda k: cell(here - 1, k, here, own)))
        dealt = rows.withColumn("_c", F.explode(cells)).select("bucket", "_c.*", "own", "size_class", "node", "label", "n", "signature", "buckets")
        percent, cut = self.percent, self.cut
        kinds = ", ".join(f"{c} bigint" for c in CELL)
        found = written(dealt.groupBy(*CELL).applyInArrow(lambda table: block_candidates(table, percent, cut), f"{kinds}, node binary, others array<binary>"), "rest-candidates")
        both = found.join(self.sets.select("node", "shingles"), "node")
        return written(both.groupBy(*CELL).applyInArrow(lambda table: block_links(table, percent), "u binary, v binary"), "rest-links")


def grouped(docs: DataFrame, *, percent: int = 85, stars: int = 1) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id of the component.  Null and empty texts, and texts without words, have an empty set and stand alone, with
    their own id.  Rows with the same text always share a component, also if they share a doc_id.  A null doc_id never
    names a component; if no other id is there, component_id is null and kept is true.  Extra columns are ignored, an
    empty table gives an empty result.  There is no cap on the members of a bucket or a component.
    """
    return judged(docs, percent, stars).drop("node")


def judged(docs: DataFrame, percent: int, stars: int) -> DataFrame:
    """grouped(), and node: the key of the row's shingle set.  stars = 0 leaves out the star pairs; the result is the same."""
    docs = docs.select("doc_id", "text")
    found = row_map(docs, {"n": "bigint", "node": "binary", "buckets": "array<bigint>"}, partial(sketches, bands=bands_for(percent)), "text")
    found = written(found.drop("text"), "sketches")
    with intermediates(docs.sparkSession):  # sets, pairs and links go as soon as the components are written
        one = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("buckets").alias("buckets"), F.count("*").alias("rows"))
        classes = written(one, "classes")
        links = Links(docs, classes.where("min_id is not null"), percent)
        labels = links.sets.select("node", F.col("node").alias("label"))
        if stars:
            so_far = components(links.stars())
            labels = written(labels.select("node").join(so_far, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        edges = links.rest(labels)
        if edges.limit(1).count():
            named = lambda x, y: labels.select(F.col("node").alias(x), F.col("label").alias(y))
            merged = components(edges.join(named("u", "x"), "u").join(named("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v")))
            labels = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        ids = classes.select("node", "min_id", "rows").join(labels, "node", "left")
        least = ids.where("label is not null").groupBy("label").agg(F.min("min_id").alias("least"))
        ids = written(ids.join(least, "label", "left").select("node", "rows", F.coalesce("least", "min_id").alias("component")), "components", outer=True)
    hot = Hot(ids.select("node", F.col("rows").alias("n")), "node")
    rows = found.select("doc_id", "n", "node")
    out = hot.dealt(rows.where("node is not null"), "doc_id").join(hot.copied(ids.drop("rows")), ["node", "_salt"]).select("doc_id", "n", "node", "component")
    out = out.unionByName(rows.where("node is null").withColumn("component", F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("doc_id").isNull() & F.col("component").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), "node")


def deduplicated(docs: DataFrame, *, percent: int = 85, stars: int = 1) -> DataFrame:
    """The rows of docs whose doc_id names their component, with docs' columns.

    Rows that share an id, or have none, stay once for each text that is kept; an id that comes once needs no look at the text.
    """
    with intermediates(docs.sparkSession):
        rows = written(judged(docs, percent, stars).select("doc_id", "node", F.col("kept").alias("_kept")), "kept", outer=True)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("_copies"), F.max("_kept").alias("_kept")).where("_kept")
    once = docs.join(ids.where("_copies = 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    several = written(ids.where("_copies > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "several")
    if not several.limit(1).count():
        return once
    rest = docs.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    keyed = row_map(rest, {"_node": "binary"}, set_keys, "text")
    kept = rows.where("_kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_key")).distinct()
    keyed = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_node").eqNullSafe(F.col("_key")), "left_semi")
    return once.unionByName(keyed.select(*[f"`{c}`" for c in docs.columns]).dropDuplicates(["doc_id", "text"]))
