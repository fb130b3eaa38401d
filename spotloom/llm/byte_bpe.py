"""Byte-level BPE: merges compiled into a lazily determinised finite-state transducer.

Reading a piece byte by byte, the last token of the encoding of every prefix is unique: it is the token
that ends there and fits behind the last token of the shorter prefix (two tokens fit when encoding their
bytes gives the two again).  A later token can only start where the bytes since then begin some token, so
a state holds just those live places, each with the tokens between it and the last place that all of them
share.  When that common place moves, its tokens are settled and emitted; the lookahead is bounded by the
longest token.  States and transitions are made when first met; tables beyond their bound are dropped and
made anew, which changes no result.

Decoding is a stream: tokens become bytes block by block, and an incremental UTF-8 state machine holds
back an unfinished character until its bytes have come.

Defined results: null is the empty text (no tokens); bytes that are not UTF-8 read as U+FFFD; repeated
rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spotloom.llm.common import PART, keep, map_texts, table

RANKS = "byte_bpe_50k.tiktoken"
MOST_STATES = 200_000
MOST_PIECES = 250_000
LONGEST_KEPT = 64
MOST_PAIRS = 400_000
DECODE_BLOCK = 65_536


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def pack(ids) -> bytes:
    return array("I", ids).tobytes()


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.solid: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """State 0: nothing read; one live place, the start, with nothing pending."""
        start = (b"", -1, ((0, ()),))
        self.number = {start: 0}
        self.states = [start]
        self.rest = [b""]
        self.moves: dict[int, tuple[int, bytes]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: the pair of least rank is merged, leftmost first, until no pair is a token."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes it; a byte splits into itself."""
        got = self.halves.get(token)
        if got is None:
            ranks, data = self.ranks, self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            got = self.halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b gives a and b.

        It does unless some merge across the border would come before a merge inside that made the border's
        neighbours: undo the inside merges from the last, and look at each pair that meets at the border.
        """
        got = self.pairs.get((a, b))
        if got is not None:
            return got
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        ranks, tokens, x, y, bound, ok = self.ranks, self.tokens, a, b, 1 << 60, True
        while True:
            across = ranks.get(tokens[x] + tokens[y])
            if across is not None and across < bound:
                ok = False
                break
            left, right = len(tokens[x]) > 1, len(tokens[y]) > 1
            if not left and not right:
                break
            # of equal ranks the left merge comes first, so across the border an equal rank wins only over the right side
            if left and (not right or x > y):
                bound, x = x, self.split(x)[1]
            else:
                bound, y = y + 1, self.split(y)[0]
        self.pairs[a, b] = ok
        return ok

    def whole(self, a: int) -> bool:
        got = self.solid.get(a)
        if got is None:
            got = self.solid[a] = self.merged(self.tokens[a]) == [a]
        return got

    def move(self, state: int, byte: int) -> tuple[int, bytes]:
        back, root, live = self.states[state]
        text = back + bytes((byte,))
        n, last = len(back), None
        for k, pending in live:
            token = self.ranks.get(text[n - k :])
            if token is not None and self.whole(token):
                before = pending[-1] if pending else root
                if before < 0 or self.fits(before, token):
                    last = (*pending, token)
                    break
        if last is None:
            raise ValueError("the ranks hold no token for a byte, or are not those of a BPE vocabulary")
        on = [(k + 1, pending) for k, pending in live if text[n - k :] in self.begins]
        on.append((0, last))
        settled = 0
        first = on[0][1]
        while all(len(p) > settled and p[settled] == first[settled] for _, p in on):
            settled += 1
        out = first[:settled]
        new = (text[len(text) - on[0][0] :], (out[-1] if out else root) if any(len(p) == settled for _, p in on) else -2, tuple((k, p[settled:]) for k, p in on))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
            self.rest.append(pack(new[2][-1][1]))
        got = self.moves[state << 8 | byte] = (at, pack(out))
        return got

    def encode_piece(self, piece: bytes) -> bytes:
        """Packed ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return pack((whole,))
        if len(self.states) > MOST_STATES:
            self.reset()
        moves, state, out = self.moves, 0, []
        for byte in piece:
            got = moves.get(state << 8 | byte)
            if got is None:
                got = self.move(state, byte)
            state, settled = got
            if settled:
                out.append(settled)
        out.append(self.rest[state])
        return b"".join(out)


class Recent:
    """A bounded table in two generations: when the young one is full it becomes the old, and what is used moves up."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def miss(self, key: str) -> bytes | None:
        """For a key that is not in `young`."""
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(key) < LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Encoder:
    """Texts to packed ids.  Text between single spaces is looked up as one chunk, since a piece always begins at such a space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.fst = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(MOST_PIECES)
        self.chunks = Recent(MOST_PIECES)

    def by_piece(self, text: str) -> bytes:
        out, known = [], self.pieces
        for p in self.find(text):
            got = known.young.get(p) or known.miss(p)
            if got is None:
                got = self.fst.encode_piece(p.encode())
                known.put(p, got)
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.by_piece(text)
        out, known = [self.by_piece(first)], self.chunks
        for c in rest:
            got = known.young.get(c)
            if got is None:
                got = known.miss(c)
                if got is None:
                    if not c or c[0].isspace() or c[-1].isspace():  # not a single space
                        return self.by_piece(text)
                    got = self.by_piece(" " + c)
                    known.put(c, got)
            out.append(got)
        return b"".join(out)


class Utf8Stream:
    """An incremental UTF-8 state machine: feed() gives the bytes of finished characters, end() what is left.

    The state is the bytes held back and how many the character still lacks.
    """

    def __init__(self):
        self.held, self.lacks = b"", 0

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        self.held, self.lacks = b"", 0
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c & 0xC0 == 0x80:
                continue
            size = 2 if 0xC2 <= c < 0xE0 else 3 if 0xE0 <= c < 0xF0 else 4 if 0xF0 <= c < 0xF5 else 1
            if size > back:
                self.held, self.lacks = data[-back:], size - back
                data = data[:-back]
            break
        return data

    def end(self) -> bytes:
        out, self.held, self.lacks = self.held, b"", 0
        return out


def decode_stream(packed: bytes, tokens: dict[int, bytes], block: int = DECODE_BLOCK):
    """Bytes of the ids, in blocks that end where a character ends."""
    stream, ids = Utf8Stream(), array("I")
    ids.frombytes(packed)
    for i in range(0, len(ids), block):
        yield stream.feed(b"".join([tokens[t] for t in ids[i : i + block]]))
    yield stream.end()


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([*DIGESTS.fields, T.StructField("ids", T.BinaryType())])


def encode(docs: DataFrame, keys: list[str], text: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """keys, number of tokens, digests and, if asked for, the ids as little-endian unsigned 32-bit integers.

    The ranks file is read on the driver (a vocabulary, a megabyte or so) and sent along.
    """
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        enc = _encoder(ranks.value, pattern)

        def fn(texts):
            out = {f: [] for f in (IDS if with_ids else DIGESTS).fieldNames()}
            for t in texts:
                ids = enc.encode(t.decode("utf-8", "replace")) if t else b""
                h = hashlib.sha256()
                for part in decode_stream(ids, enc.fst.tokens):
                    h.update(part)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(h.hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            return out

        return fn

    return map_texts(docs, keys, text, make, IDS if with_ids else DIGESTS, PART)


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One for each worker process and vocabulary, kept from task to task."""
    return keep((hashlib.sha256(data).digest(), pattern), lambda: Encoder(read_ranks(data), pattern))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}
