"""Token counts by a compiled finite-state transducer.

The vocabulary of a byte-fallback BPE model is compiled into a deterministic transducer over characters.
A state holds, for each open suffix of the text read so far that may still grow into a piece, the piece
that ends where the suffix begins and the token count there relative to the current one.  Every transition is
annotated with the change of the token count, so that the sum over a text is the library's count.
States are determinised on demand and kept per worker up to ``max_states``; then the table starts afresh.

A long text is cut into chunks, dealt over the tasks.  Where two neighbouring characters occur together in no piece, any
state is equal to the start state.  A chunk's map from entry state to (exit state, count) therefore depends on the entry
only up to the first such place: the map holds that head, the count of all that follows, and the one exit state.
A chunk without such a place is all head.  These maps compose associatively; a prefix scan by doubling composes those of a text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_map, written

#: Fixed values of the model format: the space mark and the kinds of pieces that plain text can match.
SPACE_MARK = "▁"
NO_TOKEN = -1
MAX_PIECES = 1_000_000
MOST_ARC, MOST_ARCS = 20, 500_000
_COMPILED: dict[str, "Transducer"] = {}


class State(dict):
    """Transitions by character, filled when first asked for: (next state, change of the count)."""

    __slots__ = ("open", "owner")

    def __missing__(self, char):
        found = self[char] = self.owner.step(self.open, char)
        return found


class Transducer:
    def __init__(self, pieces: dict[str, float], max_states: int = 200_000):
        self.score, self.max_states = pieces, max_states
        self.text: list[str] = list(pieces)
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [NO_TOKEN]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        for k, piece in enumerate(self.text):
            node = 0
            for char in piece:
                node = self.children[node].setdefault(char, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(NO_TOKEN)
            self.token[node] = k
        self.fits: dict[tuple[int, int], bool] = {}
        self.arcs: dict[str, int] = {}
        self.unit_starts = not any(b == SPACE_MARK != a for a, b in self.pairs)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(((0, NO_TOKEN, 0),))

    def state(self, opened: tuple) -> State:
        found = self.states.get(opened)
        if found is None:
            found = self.states[opened] = State()
            found.open, found.owner = opened, self
        return found

    def merged(self, text: str) -> list[str]:
        """The greedy merge of a short text: always the best-scored neighbouring pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether the merge of both pieces' text gives just these two pieces."""
        found = self.fits.get((left, right))
        if found is None:
            want = [self.text[right]] if left == NO_TOKEN else [self.text[left], self.text[right]]
            found = self.fits[left, right] = self.merged("".join(want)) == want
        return found

    def step(self, opened: tuple, char: str) -> tuple[State, int]:
        if char not in self.children[0]:
            return self.start, len(char.encode("utf-8", "surrogatepass"))
        kept, change, last = [], None, NO_TOKEN
        for node, before, count in opened:
            if not node and before != NO_TOKEN and self.text[before][-1] + char not in self.pairs:
                before = NO_TOKEN
            child = self.children[node].get(char)
            if child is None:
                continue
            token = self.token[child]
            if change is None and token != NO_TOKEN and self.fit(before, token):
                change, last = count + 1, token
            if self.children[child]:
                kept.append((child, before, count))
        opened = (*((node, before, count - change) for node, before, count in kept), (0, last, 0))
        return self.state(opened), change

    def run(self, text: str) -> int:
        """The count of a text read from the start state.

        Where no piece holds a space mark behind another character, every run of marks begins at the start state, so
        a unit (marks and what follows them) is a path from the start state to itself.  Paths of short units are kept as
        arcs of their own.
        """
        if not self.unit_starts:
            return self.walk(text)
        head, *rest = text.split(SPACE_MARK)
        total, lead, arcs = self.walk(head) if head else 0, SPACE_MARK, self.arcs
        for word in rest:
            if not word:
                lead += SPACE_MARK
                continue
            unit = lead + word
            count = arcs.get(unit)
            if count is None:
                count = self.walk(unit)
                if len(unit) <= MOST_ARC and len(arcs) < MOST_ARCS:
                    arcs[unit] = count
            total += count
            lead = SPACE_MARK
        return total + (self.walk(lead[1:]) if len(lead) > 1 else 0)

    def walk(self, text: str) -> int:
        if len(self.states) > self.max_states:
            self.reset()
            self.fits.clear()
        total, state = 0, self.start
        for char in text:
            state, change = state[char]
            total += change
        return total

    def cuts(self, text: str) -> tuple[int, int] | None:
        """The first and the last place where any state equals the start state."""
        pairs, n = self.pairs, len(text)
        first = next((i for i in range(1, n) if text[i - 1 : i + 1] not in pairs), None)
        if first is None:
            return None
        return first, next(i for i in range(n - 1, 0, -1) if text[i - 1 : i + 1] not in pairs)

    def follow(self, state: State, text: str) -> tuple[State, int]:
        """(exit state, count) of a text read from a state."""
        total = 0
        for char in text:
            state, change = state[char]
            total += change
        return state, total

    def chunk_map(self, text: str) -> tuple[str, int, list[int], bool]:
        """(head, count after it, exit state as numbers, whether a cut exists); without a cut all is head."""
        cut = self.cuts(text)
        if cut is None:
            return text, 0, [], False
        state, count = self.follow(self.start, text[cut[1] :])
        return text[: cut[0]], self.run(text[cut[0] : cut[1]]) + count, [x for part in state.open for x in part], True

    def known(self, numbers: list[int]) -> State:
        """The state of a map's numbers; nodes and tokens are numbered by the pieces' order, so alike in every worker."""
        return self.state(tuple(zip(numbers[::3], numbers[1::3], numbers[2::3], strict=True)))

    def compose(self, a: tuple, b: tuple) -> tuple:
        """First a, then b."""
        if not a[3]:
            return (a[0] + b[0], b[1], b[2], b[3])
        state, count = self.follow(self.known(a[2]), b[0])
        if b[3]:
            return (a[0], a[1] + count + b[1], b[2], True)
        return (a[0], a[1] + count, [x for part in state.open for x in part], True)

    def total(self, maps: list[tuple]) -> int:
        """Compose neighbours pairwise in rounds: the depth is logarithmic in the number of chunks."""
        if len(self.states) > self.max_states:
            self.reset()
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, _, _ = maps[0]
        return self.run(head) + count


def model_pieces(path: str) -> dict[str, float]:
    """Pieces that plain text can match, read through the tokenizer's own library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if size > MAX_PIECES:
        raise ValueError(f"{size} pieces are too many to send to every executor")
    return {model.id_to_piece(i): model.get_score(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def normal(text: str) -> str:
    """The identity normaliser with a dummy prefix and visible spaces."""
    return (" " + text).replace(" ", SPACE_MARK) if text else ""


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096, chunk_chars: int = 65_536) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens.  Texts of any length are counted whole: those of up to chunk_chars
    characters where they are, longer ones by chunks that go to many tasks.  Each row is counted by itself, so ids may repeat or be
    null.  Other columns of docs are ignored, whatever their names.  An empty table gives an empty result.
    The pieces are broadcast; their number is bounded by MAX_PIECES and never grows with the documents.  A worker's states
    number at most max_states and one chunk's characters.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(model_pieces(model_path))

    def compiled() -> Transducer:
        if model_path not in _COMPILED:
            _COMPILED[model_path] = Transducer(pieces.value)
        return _COMPILED[model_path]

    own = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") >= chunk_chars  # a space mark is put before the text
    short = row_map(own.where(~is_long), {"n_tokens": "bigint"}, lambda texts: [[compiled().run(normal(t)) for t in texts]], "text").select("doc_id", "n_bytes", "n_tokens")

    def cut(batches):
        for batch in batches:
            for row, value in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                value = normal(value)
                for i in range(0, len(value), 32 * chunk_chars):
                    parts = [value[k : k + chunk_chars] for k in range(i, min(len(value), i + 32 * chunk_chars), chunk_chars)]
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(parts), pa.int64()), "chunk": pa.array(range(i // chunk_chars, i // chunk_chars + len(parts)), pa.int64()), "text": pa.array(parts, pa.string())})

    def maps(texts):
        return list(zip(*map(compiled().chunk_map, texts), strict=True)) or [[]] * 4

    long = written(own.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")  # written, so that every reading has the same row numbers
    chunks = long.select("row", "text").mapInArrow(cut, "row bigint, chunk bigint, text string").repartition("row", "chunk")
    mapped = row_map(chunks, {"head": "string", "count": "bigint", "exit": "array<bigint>", "cut": "boolean"}, maps, "text").drop("text")
    scan = mapped.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "head", "count", "exit", "cut"))).alias("maps"))

    @F.pandas_udf("bigint")
    def composed(column):
        return column.map(lambda maps: compiled().total([(m["head"], m["count"], m["exit"], m["cut"]) for m in maps]))

    counted = long.select("row", "doc_id", "n_bytes").join(scan.select("row", composed("maps").alias("n_tokens")), "row").drop("row")
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
