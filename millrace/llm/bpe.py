"""Operator 7: byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. The BPE encoding of a byte string is the only tokenisation in which every adjacent pair of tokens is itself
stable under the merges (Berglund & van der Merwe 2023). After each byte there is therefore at most one token that ends the
encoding of the prefix read so far. A token that ends later can only start inside the longest suffix that begins some token;
this bounds the look-ahead. So the transducer's state is that suffix, with the last token of each prefix that ends inside it.
Tokens are emitted, in runs, up to a place that all these prefixes have come through. States and arcs are built only when a
byte first leads to them, and forgotten together when there are too many.

Decoding. Ids are turned into bytes as they come; a machine over tokens, with as states the UTF-8 bytes still owed, tells
where text is complete. Each (state, token) step is computed once.

Defined results: a null or empty text has no ids; text in any language, of any length, round-trips byte for byte; special
token strings are ordinary text; equal texts get equal ids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_STATES = 250_000
MAX_CACHE = 700_000
#: bytes read after which final tokens are emitted
WINDOW = 64
#: in place of a last token: there is none yet; no token can start here
START, DEAD = -1, -2


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a rank file; the vocabulary's size is fixed by that file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Transducer:
    """Encodes one piece at a time: encode() gives its ids."""

    def __init__(self, tokens: list[bytes], max_states: int = MAX_STATES):
        self.tokens, self.max_states = tokens, max_states
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t) + 1)}
        self.sizes = [len(t) for t in tokens]
        self.bytes = [bytes((b,)) for b in range(256)]
        self.split: dict[int, tuple[int, int] | None] = {}
        self.stable: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        #: state: (suffix that begins a token, last tokens of the prefixes that end 0, 1, ... bytes before its end)
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (START,))]
        self.number: dict[tuple, int] = {(b"", START): 0}
        self.shapes: dict[bytes, tuple] = {}
        self.arcs: dict[int, tuple[int, int]] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one: the pair left when merges of lower rank are done."""
        if token not in self.split:
            t = self.tokens[token]
            seq = [t[i : i + 1] for i in range(len(t))]
            while len(seq) > 2:
                best = min(range(len(seq) - 1), key=lambda i: (self.rank.get(seq[i] + seq[i + 1], len(self.tokens)), i))
                if seq[best] + seq[best + 1] not in self.rank:
                    break
                seq[best : best + 2] = [seq[best] + seq[best + 1]]
            self.split[token] = (self.rank[seq[0]], self.rank[seq[1]]) if len(seq) == 2 else None
        return self.split[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def pair_is_stable(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b before both are complete. The merges are undone from the last
        one: of the two sides, the one whose last merge is of higher rank was made later."""
        if (known := self.stable.get(a << 32 | b)) is not None:
            return known
        x, y, limit, out = a, b, len(self.tokens), True
        while True:
            merged = self.rank.get(self.tokens[x] + self.tokens[y])
            if merged is not None and merged < limit:
                out = False
                break
            if x > y and (s := self.parts(x)):
                limit, x = x, s[1]
            elif s := self.parts(y):
                # of equal ranks the left one merges first, so a crossing merge of that rank comes before the right side
                limit, y = y + 1, s[0]
            elif s := self.parts(x):
                limit, x = x, s[1]
            else:
                break
        self.stable[a << 32 | b] = out
        return out

    def shape(self, read: bytes) -> tuple[tuple[tuple[int, int], ...], bytes, tuple[bool, ...]]:
        """What does not depend on the tokens before: the tokens that can end here with their starts (bytes before the last
        one), the longest suffix that begins a token, and at which places in it a token that runs on can start."""
        ends = tuple((k, t) for k in range(len(read)) if (t := self.rank.get(read[len(read) - k - 1 :])) is not None and self.reachable(t))
        starts = [read[len(read) - k :] in self.prefixes for k in range(1, len(read) + 1)]
        while starts and not starts[-1]:
            starts.pop()
        return ends, read[len(read) - len(starts) :], tuple(starts)

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the token that ends the prefix here (DEAD: none)."""
        suffix, before = self.states[state]
        read = suffix + self.bytes[byte]
        shape = self.shapes.get(read)
        if shape is None:
            shape = self.shapes[read] = self.shape(read)
        ends, suffix, starts = shape
        last, stable = DEAD, self.stable
        for k, t in ends:
            left = before[k]
            if left < 0:
                if left == DEAD:
                    continue
                last = t
                break
            known = stable.get(left << 32 | t)
            if known or (known is None and self.pair_is_stable(left, t)):
                last = t
                break
        key = (suffix, last, *[b if live else DEAD for live, b in zip(starts, before)])  # noqa: B905
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append((suffix, key[1:]))
        return number, last

    def settled(self, state: int) -> int:
        """How far back the place lies that all live prefixes have come through; -1: not known."""
        live = self.states[state][1]
        oldest = max(k for k, t in enumerate(live) if t != DEAD)
        for k, t in enumerate(live):
            if t == DEAD:
                continue
            while k < oldest:  # along the chain of this prefix; beyond places that are not live it is not known
                t = live[k]
                if t < 0:
                    return -1
                k += len(self.tokens[t])
            if k != oldest:
                return -1
        return oldest

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        if (whole := self.rank.get(piece)) is not None:  # as the merges are defined, a piece that is a token is that token
            return [whole]
        lasts: list[int] = []  # of the bytes after those that `out` covers
        state, find, note = 0, self.arcs.get, lasts.append
        if len(piece) <= WINDOW:
            for byte in piece:
                state, last = find(state << 8 | byte) or self.arc(state, byte)
                note(last)
            return self.chain(lasts, len(lasts))
        out: list[int] = []
        due = WINDOW
        for byte in piece:
            state, last = find(state << 8 | byte) or self.arc(state, byte)
            note(last)
            if len(lasts) > due:  # what lies before the settled place is final
                if (back := self.settled(state)) >= 0:
                    out += self.chain(lasts, len(lasts) - back)
                    del lasts[: len(lasts) - back]
                due = len(lasts) + WINDOW
        return out + self.chain(lasts, len(lasts))

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        out = self.arcs[state << 8 | byte] = self.step(state, byte)
        return out

    def chain(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the prefix that ends at byte `end`."""
        out, sizes = [], self.sizes
        while end > 0:
            t = lasts[end - 1]
            if t < 0:
                raise ValueError("the vocabulary lacks single bytes")
            out.append(t)
            end -= sizes[t]
        out.reverse()
        return out


class Encoder(dict):
    """Piece to packed ids; holds the pieces met lately."""

    def __init__(self, tokens: list[bytes], pattern: str, max_cache: int = MAX_CACHE, max_states: int = MAX_STATES):
        import regex

        self.machine, self.max_cache = Transducer(tokens, max_states), max_cache
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        packed = array("I", ids).tobytes()
        if len(piece) < 64:
            if len(self) >= self.max_cache:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> memoryview:
        return memoryview(b"".join(map(self.__getitem__, self.pieces(text)))).cast("I")


class Decoder:
    """Ids to bytes, piecewise: feed() returns the bytes that complete whole characters, close() the rest."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        # tokens that are whole characters from a rest of none; for them the state stays 0
        self.whole = {i for i, t in enumerate(tokens) if self._valid(t)}
        self.arcs: dict[tuple[tuple[int, int, int], int], tuple[tuple[int, int, int], int]] = {}
        self.state, self.held = (0, 0x80, 0xBF), b""

    @staticmethod
    def _valid(t: bytes) -> bool:
        try:
            t.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    @staticmethod
    def _byte(state: tuple[int, int, int], b: int) -> tuple[int, int, int]:
        """State: bytes owed, and the range that the next of them must lie in; -1 after an error."""
        owed, lo, hi = state
        if owed > 0:
            return (owed - 1, 0x80, 0xBF) if lo <= b <= hi else (-1, 0, 0)
        if b < 0x80:
            return (0, 0x80, 0xBF)
        if 0xC2 <= b <= 0xDF:
            return (1, 0x80, 0xBF)
        if 0xE0 <= b <= 0xEF:
            return (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
        if 0xF0 <= b <= 0xF4:
            return (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
        return (-1, 0, 0)

    def _arc(self, state: tuple[int, int, int], token: int) -> tuple[tuple[int, int, int], int]:
        """The next state, and how many of the token's bytes complete characters."""
        key = (state, token)
        if key not in self.arcs:
            done = 0
            for i, b in enumerate(self.tokens[token]):
                state = self._byte(state, b)
                if state[0] < 0:  # not text: passed on as it is
                    state = (0, 0x80, 0xBF)
                if state[0] == 0:
                    done = i + 1
            self.arcs[key] = (state, done)
        return self.arcs[key]

    def feed(self, ids, whole: bool = False) -> bytes:
        """whole: the ids are known to be whole characters, and so is all before."""
        if whole or (self.state[0] == 0 and self.whole.issuperset(ids)):
            return b"".join(map(self.tokens.__getitem__, ids))
        out = []
        for i in ids:
            t = self.tokens[i]
            self.state, done = self._arc(self.state, i)
            if self.state[0] == 0:
                out.append(self.held + t)
                self.held = b""
            elif done:
                out.append(self.held + t[:done])
                self.held = t[done:]
            else:
                self.held += t
        return b"".join(out)

    def close(self) -> bytes:
        rest, self.held, self.state = self.held, b"", (0, 0x80, 0xBF)
        return rest


#: rows whose ids are held at once before they are handed on
ROWS = 256
#: ids that the decoder is given at once; those of a chunk with a broken character are decoded one by one
CHUNK = 64


def coder(shared: dict) -> tuple[Encoder, Decoder, list[str]]:
    """Encoder, decoder and decimal names of ids. A worker keeps them with its copy of the broadcast value, so that what one
    task has determinised serves the next."""
    if "coder" not in shared:
        tokens = shared["tokens"]
        shared["coder"] = Encoder(tokens, shared["pattern"], *shared.get("limits", ())), Decoder(tokens), [str(i) for i in range(len(tokens))]
    return shared["coder"]


def digests(batches: Iterator[pa.RecordBatch], shared: dict, keep: bool) -> Iterator[pa.RecordBatch]:
    """For each row of (…, text): the other columns, n_tokens, both digests, and the ids themselves if they are kept."""
    enc, dec, digits = coder(shared)
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, max(whole.num_rows, 1), ROWS)):
        at = batch.schema.get_field_index("text")
        n, a, b, all_ids = [], [], [], []
        for text in batch.column(at):
            view = enc.encode(text.as_py() or "")
            ids, sha, shb = view.tolist(), hashlib.sha256(), hashlib.sha256()
            sha.update(" ".join(map(digits.__getitem__, ids)).encode())
            if dec.whole.issuperset(ids):
                shb.update(dec.feed(ids, True))
            else:
                shb.update(b"".join([*(dec.feed(ids[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)), dec.close()]))
            n.append(len(ids))
            a.append(sha.hexdigest())
            b.append(shb.hexdigest())
            if keep:
                all_ids.append(np.frombuffer(view, np.uint32).astype(np.int32))
        rest = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != at]
        new = [("n_tokens", pa.array(n, pa.int64())), ("ids_sha256", pa.array(a, pa.string())), ("decoded_sha256", pa.array(b, pa.string()))]
        if keep:
            new.append(("ids", pa.array(all_ids, pa.list_(pa.int32()))))
        yield pa.RecordBatch.from_arrays([x for _, x in rest + new], [k for k, _ in rest + new])


def encode(docs: DataFrame, ranks: str, pattern: str, *, ids: bool = False, limits: tuple[int, int] = (MAX_CACHE, MAX_STATES)) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with ids=True the ids as well. limits: the pieces and the
    states that a worker keeps, which trade its memory for time."""
    shared = docs.sparkSession.sparkContext.broadcast({"tokens": load_ranks(ranks), "pattern": pattern, "limits": limits})  # fixed size: the vocabulary
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(lambda it: digests(it, shared.value, ids), schema)
