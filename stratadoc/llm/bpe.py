r"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A tokenisation by merges has the property that each prefix of a string ends in
one certain token, and that a token t may follow the token s exactly if merging
the bytes of s and t together gives s, t again. So a string can be read from
left to right: the transducer's hypotheses are the places at which a token now
being read may have started, each a node of the vocabulary's trie with the last
token before it. The set of hypotheses is the state; the subset construction is
done on demand, and each transition is kept when it was needed once. On each
byte the one hypothesis that completes a compatible token gives the last token
of the prefix. Tokens are emitted as soon as all live hypotheses agree on them,
which is after a bounded lookahead, so long runs need little memory.

Defined results: null texts count as empty and have no tokens; repeated rows
each get their row; an empty table gives an empty result; columns beside
``doc_id`` and ``text`` are ignored. Text that is not valid Unicode cannot
occur in a column of strings. Unknown ids raise KeyError when decoded.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratadoc.llm._shared import bound_batches, kept, table, task

#: Transitions and pieces kept at most; beyond it the table starts anew, as lazy automata do.
MOST_TRANSITIONS = 600_000
MOST_PIECES = 350_000
MOST_PAIRS = 300_000
#: Longer pieces are not kept.
LONG_PIECE = 48
#: Bytes read between two emissions within one piece.
EMIT_EVERY = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a tiktoken file: base64 token and rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pieces (bytes) to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        #: The trie: children by (node, byte), and the token that ends at a node.
        self.children: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                nxt = self.children.get(key)
                if nxt is None:
                    nxt = self.children[key] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = rank
        self.fits: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        """States by number: their hypotheses, oldest first, each a trie node and the last token before it (plus 1) in one number."""
        self.numbers: dict[tuple, int] = {(0,): 0}
        self.states: list[tuple] = [(0,)]
        #: By state and byte: the next state and the last token, in one number.
        self.moves: dict[int, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges by definition: of all adjacent pairs the lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: can stand at the start)."""
        key = before << 32 | token if before >= 0 else -1 - token
        known = self.fits.get(key)
        if known is None:
            if before < 0:
                known = self.merged(self.tokens[token]) == [token]
            else:
                known = self.merged(self.tokens[before] + self.tokens[token]) == [before, token]
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """Determinises one transition: the next state and the last token of the prefix read."""
        live, last = [], -1
        for hypothesis in self.states[state]:
            nxt = self.children.get(hypothesis >> 32 << 8 | byte)
            if nxt is None:
                continue
            before = hypothesis & 0xFFFFFFFF
            live.append(nxt << 32 | before)
            if last < 0 and (end := self.ends[nxt]) >= 0 and self.compatible(before - 1, end):
                last = end
        if last < 0:
            raise KeyError(f"no token covers byte {byte}")
        live.append(last + 1)
        key = tuple(live)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = number << 32 | last
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece, read from left to right in time linear in its length."""
        if (whole := self.ranks.get(piece)) is not None and self.compatible(-1, whole):
            return [whole]
        if len(self.moves) > MOST_TRANSITIONS:
            self._restart()
        out: list[int] = []
        ending: list[int] = []  # the last token of each prefix of what is not yet emitted
        state, moves, pending = 0, self.moves, 0
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 32
            ending.append(move & 0xFFFFFFFF)
            pending += 1
            if pending >= EMIT_EVERY:
                ending = self._emit(state, ending, out)
                pending = 0
        self._chain(ending, len(ending), out)
        return out

    def _chain(self, ending: list[int], upto: int, out: list[int]) -> None:
        """Appends the tokens of the prefix of ``upto`` bytes."""
        back = []
        while upto > 0:
            back.append(t := ending[upto - 1])
            upto -= self.lengths[t]
        out.extend(reversed(back))

    def _emit(self, state: int, ending: list[int], out: list[int]) -> list[int]:
        """Emits the tokens that all live hypotheses have in common, and returns what is still open."""
        n = len(ending)
        starts = set()
        for hypothesis in self.states[state]:
            starts.add(n - self._depth(hypothesis >> 32))
        while len(starts) > 1:
            far = max(starts)
            starts.discard(far)
            starts.add(far - self.lengths[ending[far - 1]] if far > 0 else 0)
        agreed = starts.pop()
        if agreed > 0:
            self._chain(ending, agreed, out)
        return ending[agreed:]

    def _depth(self, node: int) -> int:
        if not hasattr(self, "depths"):
            self.depths = [0] * len(self.ends)
            for key, child in self.children.items():  # parents come before their children
                self.depths[child] = self.depths[key >> 8] + 1
        return self.depths[node]


class Encoder:
    """Splits texts by a pattern and encodes each match; pieces met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.packed: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        ids = self.fst.encode(piece.encode())
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= LONG_PIECE:
            if len(self.packed) >= MOST_PIECES:
                self.packed.clear()
            self.packed[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, pack = self.packed.get, self._pack
        return b"".join([get(p) or pack(p) for p in self.find(text)])


class StreamDecoder:
    """Decodes ids piece by piece: an incremental UTF-8 state machine holds back an unfinished character.

    The state is the number of continuation bytes still due and the range that
    the next one must fall in. Bytes that cannot be part of a character become
    U+FFFD, one for each maximal part, when ``text`` is asked for.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC2:  # a lead byte
                due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3 if b < 0xF5 else 0
                if back > due:
                    return 0
                if back > 1:
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
            if b >= 0xC0:
                return 0
        return 0

    def feed(self, ids) -> tuple[bytes, str]:
        """The bytes of these ids, and the text that is complete with them."""
        fresh = b"".join(map(self.tokens.__getitem__, ids))
        data = self.held + fresh
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return fresh, data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


#: Ids decoded at a time.
DECODE_IDS = 1 << 14
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])


def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder of this vocabulary; worker processes are used again, and their tables with them."""
    tables = kept("bpe")
    if (path, pattern) not in tables:
        tables[path, pattern] = Encoder(read_ranks(path), pattern)
    return tables[path, pattern]


def _round_trip(path: str, pattern: str):
    @task("bpe")
    def run(batches):
        enc = encoder(path, pattern)
        tokens = enc.fst.tokens
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                ids = enc.encode(text)
                decoder, digest, exact, at = StreamDecoder(tokens), hashlib.sha256(), True, 0
                view = memoryview(ids).cast("I")
                for i in range(0, len(view), DECODE_IDS):
                    data, done = decoder.feed(view[i : i + DECODE_IDS])
                    digest.update(data)
                    exact = exact and text.startswith(done, at)
                    at += len(done)
                exact = exact and decoder.finish() == "" and at == len(text)
                rows.append((len(view), hashlib.sha256(ids).hexdigest(), digest.hexdigest(), exact))
            cols = list(zip(*rows)) or [()] * (len(_ARROW) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, _ARROW.types[1:])]], schema=_ARROW)

    return run


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the default vocabulary, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of its ids and of the bytes decoded from them, and whether these give the text."""
    default = vocabulary()
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_round_trip(path or default[0], pattern or default[1]), SCHEMA)


def _ids(path: str, pattern: str):
    @task("bpe")
    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [memoryview(enc.encode(t.as_py() or "")).cast("I").tolist() for t in batch.column("text")]
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(ids, pa.list_(pa.int64()))], names=[*[n for n in batch.schema.names if n != "text"], "ids"])

    return run


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the ids of each document's text (array of long)."""
    default = vocabulary()
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_ids(path or default[0], pattern or default[1]), "doc_id long, ids array<long>")


def op9_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
