"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a slice of documents.  Its words become numbers in the benchmark's vocabulary (0: not in it), and its
suffix array holds, in sorted order, every suffix that a test suffix can match for a whole window; a suffix that
leaves the benchmark's vocabulary before the shortest window ends can match none and is left out.
The array is sorted as far as a window reaches, which is all that the search compares.  Every test suffix is binary-searched in it;
its range of equal suffixes says where its window occurs.  Windows that continue each other both in the text and in an
item are then followed to the longest verbatim matches, with their places in both.  Equal windows of the benchmark are one test
suffix with a list of places, so occurrences are never multiplied with places.

Only the benchmark is sent to the executors, in at most ``most_blocks`` blocks of about ``block_words`` words, each searched in turn.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_map

#: A-Z becomes a-z; other ASCII but digits and a-z separates words; all else is part of a word.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class TestSuffixes:
    """All windows of a block of benchmark items, as rows of word numbers, with the places and the items that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length[n][tuple(ids[i : i + n])].append((k, i))
        self.items = [item for item, _ in items]
        self.owner = {n: [sorted({self.items[k] for k, _ in rows[x]}) for x in sorted(rows)] for n, rows in by_length.items()}
        self.starts = np.concatenate([[0], np.cumsum([len(words) + 1 for _, words in items])[:-1]]) if items else np.zeros(0, dtype=np.int64)
        place = lambda found: np.array([self.starts[k] + i for k, i in found], dtype=np.int64)  # noqa: E731  ascending; items lie one apart
        self.lengths = {n: (sorted_rows(np.array(list(rows), dtype=">u4")), [place(rows[x]) for x in sorted(rows)]) for n, rows in by_length.items()}

    def search(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """By window length, the number of the test suffix whose window begins at each place of ids, or -1."""
        found = {}
        inside = ids > 0
        ends = np.concatenate([np.flatnonzero(~inside), [len(ids)]])
        run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))  # words up to the next unknown one
        for n, (tests, _) in self.lengths.items():
            suffixes = np.flatnonzero(run >= n)
            if not len(suffixes):
                continue
            keys = as_keys(np.lib.stride_tricks.sliding_window_view(ids, n)[suffixes])
            order = np.argsort(keys, kind="stable")  # the shard's suffix array
            keys, suffixes = keys[order], suffixes[order]
            low, high = np.searchsorted(keys, tests, "left"), np.searchsorted(keys, tests, "right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                found[n] = np.full(len(ids), -1, dtype=np.int64)
                for t in hit:
                    found[n][suffixes[low[t] : high[t]]] = t
        return found

    def matches(self, tests: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
        """The longest matches of a run of neighbouring windows: (item, start in the run, start in the item, words).

        A match begins with all places of its first window and is followed while any of them continues; of those that
        reach furthest, the first place is named.
        """
        places = self.lengths[n][1]
        out, at = [], 0
        while at < len(tests):
            alive, k = places[tests[at]], at + 1
            while k < len(tests):
                after = alive + 1
                after = after[np.isin(after, places[tests[k]], assume_unique=True)]
                if not len(after):
                    break
                alive, k = after, k + 1
            first = int(alive[0]) - (k - 1 - at)
            item = int(np.searchsorted(self.starts, first, "right")) - 1
            out.append((item, at, first - int(self.starts[item]), n + k - 1 - at))
            at = k
        return out


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of equal length that sort alike."""
    return np.ascontiguousarray(rows, dtype=">u4").view(f"S{4 * rows.shape[1]}").ravel()


def sorted_rows(rows: np.ndarray) -> np.ndarray:
    return np.sort(as_keys(rows))


MATCHES = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """Blocks of items, fetched row by row, so that the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        found = plain_words(row["t"])
        if not found:
            continue
        if block and size + len(found) > block_words:
            yield TestSuffixes(block, window)
            block, size = [], 0
        block.append((row["k"] or "", found))
        size += len(found)
    yield TestSuffixes(block, window)


def matched(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 1_000_000, most_blocks: int = 64, shard_bytes: int = 4_000_000) -> DataFrame:
    """All columns of docs, then n_words, n_hit, items (distinct ids, sorted as strings) and matches (the longest ones).

    A word inside any occurrence of a window is hit; an item of fewer words than a window is one window.  Null and
    empty texts have no words, an item without words has no window, a null item id counts as the empty string.
    A match is the longest one of its first word on that no longer match before it covers, with the first place in the benchmark.
    Repeated rows are judged one by one; a benchmark beyond most_blocks blocks is an error.  The four new columns replace columns of the same name.
    With an empty benchmark nothing is hit; an empty table of documents gives an empty result.
    """
    new = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "matches": MATCHES}
    machines = []
    for block in benchmark_blocks(benchmark, item_id, item_text, window, block_words):
        if len(machines) == most_blocks:
            raise ValueError(f"the benchmark has more than {most_blocks} blocks of {block_words} words, too many to send to every executor")
        machines.append(docs.sparkSession.sparkContext.broadcast(block))

    def search(texts):
        split = [plain_words(t) for t in texts]
        lengths = np.array([len(w) for w in split])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # one unknown word parts the documents
        marks = np.zeros(starts[-1] + 1, dtype=np.int64)
        items, longest = [set() for _ in texts], [[] for _ in texts]
        for machine in (m.value for m in machines):
            get = machine.number.get
            ids = np.zeros(starts[-1], dtype=np.uint32)
            for k, w in enumerate(split):
                ids[starts[k] : starts[k] + len(w)] = [get(x, 0) for x in w]
            for n, tests in machine.search(ids).items():
                at = np.flatnonzero(tests >= 0)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + n, -1)
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    k = int(np.searchsorted(starts, run[0], "right")) - 1
                    for t in np.unique(tests[run]):
                        items[k].update(machine.owner[n][t])
                    longest[k] += [(machine.items[item], int(run[0] + p - starts[k]), place, size) for item, p, place, size in machine.matches(tests[run], n)]
        hit = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
        n_hit = (hit[starts[:-1] + lengths] - hit[starts[:-1]]).tolist()
        return [lengths.tolist(), n_hit, [sorted(x) for x in items], [[dict(zip(("item_id", "doc_word", "item_word", "n_words"), h, strict=True)) for h in sorted(found)] for found in longest]]

    return row_map(docs, new, search, text, shard_bytes)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their own columns, of which less than a twentieth of the words is hit."""
    return matched(docs, benchmark, **options).where(~is_contaminated()).select(*[c for c in docs.columns])


def decontamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matched(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
