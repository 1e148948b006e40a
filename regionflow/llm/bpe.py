"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is one valid last token: the token t that ends there such that t
alone, or the last token of the prefix before t followed by t, is left unchanged by the merges. The table of
these last tokens gives the encoding by walking back, grows by appends, and after an edit needs new entries
only until they agree with the old ones again.

An automaton over the vocabulary finds the tokens that end at each byte. Whether two tokens can stand side by side
is told by the parts that face each other while each token is merged.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from regionflow.llm.common import map_batches

#: Bytes of pieces, and token pairs, kept per worker; the tables are emptied when full, which changes no result.
PIECE_BYTES_KEPT, PAIRS_KEPT = 160 << 20, 1_000_000
#: Bytes that a kept piece takes besides its own, and for each token.
_ENTRY, _ID = 200, 8

#: The rank of no merge.
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBpe:
    """ranks: token bytes to id, a smaller id merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        if ranks:
            self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._histories: dict[int, tuple[bool, list, list] | None] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves: join the adjacent parts whose union ranks lowest, leftmost first."""
        return [self.ranks[p] for p in self._merges(piece)[0]]

    def _merges(self, piece: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The parts that are left, and for each merge its rank and the first and the last part before it."""
        parts, steps = [piece[i : i + 1] for i in range(len(piece))], []
        while len(parts) > 1:
            found = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            rank, i = min(found)
            steps.append((rank, parts[0], parts[-1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, steps

    def history(self, token: int) -> tuple[bool, list, list] | None:
        """(whether ranks never fall, first parts, last parts) while the token's bytes are merged, each part with the
        rank of the merge that ends it; None if the merges don't give the token."""
        if token not in self._histories:
            whole = self.tokens[token]
            parts, steps = self._merges(whole)
            firsts, lasts = [], []
            for (rank, first, last), (_, next_first, next_last) in zip(steps, [*steps[1:], (0, whole, whole)][: len(steps)], strict=True):
                if first != next_first:
                    firsts.append((first, rank))
                if last != next_last:
                    lasts.append((last, rank))
            rising = all(x[0] <= y[0] for x, y in zip(steps, steps[1:], strict=False))
            self._histories[token] = (rising, [*firsts, (whole, NEVER)], [*lasts, (whole, NEVER)]) if parts == [whole] else None
        return self._histories[token]

    def stable(self, token: int) -> bool:
        return self.history(token) is not None

    def pair(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        one, other = self.history(left), self.history(right)
        if one is None or other is None:
            return False
        if not (one[0] and other[0]):  # ranks that fall give no common order of the two tokens' merges
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        get, lasts, firsts = self.ranks.get, one[2], other[1]
        i = j = 0
        while True:
            (last, until), (first, till) = lasts[i], firsts[j]
            rank = get(last + first, NEVER)
            if rank < until and rank <= till:  # of equal ranks the leftmost merges first
                return False
            if until <= till:
                if until == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def extend(self, symbols: str, last: list[int], stop: int) -> None:
        """Last tokens up to `stop` of a piece whose bytes are given as a Latin-1 text; last[i] is that of its first i bytes."""
        done, begin = len(last), max(0, len(last) - self.longest)
        last += [-1] * (stop + 1 - done)
        known, pair = self._pairs.get, self.pair
        for end, (token, size) in self.automaton.iter(symbols, begin, stop):
            end += 1
            if last[end] >= 0 or end < done:
                continue
            start = end - size
            if start:
                left = last[start]
                fits = known(left << 32 | token)
                if fits is None:
                    fits = pair(left, token)
            else:
                fits = self.stable(token)
            if fits:
                last[end] = token
        if -1 in last[done:]:
            raise ValueError(f"no token for a byte of {symbols[done - 1 : stop]!r}")

    def table(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes; `last`, a table of a prefix of piece, is extended."""
        last = last or [-1]
        self.extend(piece.decode("latin-1"), last, len(piece))
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """piece with piece[start:end] replaced, its table, and how many entries were computed anew."""
        changed = piece[:start] + new + piece[end:]
        table, shift, symbols = last[: start + 1], len(new) - (end - start), changed.decode("latin-1")
        for low in range(start, len(changed), self.longest):
            at = min(low + self.longest, len(changed))
            self.extend(symbols, table, at)
            first = at + 1 - self.longest
            if first > start + len(new) and table[first:] == last[first - shift : at + 1 - shift]:  # later entries see only equal bytes and equal entries
                return changed, table + last[at - shift + 1 :], at - start
        return changed, table, len(changed) - start

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.table(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    def __init__(self, bpe: PrefixBpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.held = 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        found = tuple(self.bpe.encode_piece(raw))
        size = _ENTRY + len(raw) + _ID * len(found)
        if size > PIECE_BYTES_KEPT // 64:
            return found
        if self.held + size > PIECE_BYTES_KEPT:
            self.clear()
            self.held = 0
        self[piece] = found
        self.held += size
        return found


class TextBpe:
    """Splits a text by `pattern` and encodes each piece on its own."""

    def __init__(self, bpe: PrefixBpe, pattern: str) -> None:
        self.bpe = bpe
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(bpe)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


_loaded: dict[tuple[str, str], TextBpe] = {}


def coder(path: str, pattern: str) -> TextBpe:
    """One per worker and vocabulary file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TextBpe(PrefixBpe(read_ranks(path)), pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>); a null text has no ids. The vocabulary file must exist on every executor."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(path, pattern).encode
        ids = [code(t or "") for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = coder(path, pattern).bpe.decode
        out = [back(x or []) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the digests of its ids and of the bytes that they decode to, without moving the ids.

    Null or empty text: no tokens, the digests of empty strings. Repeated rows give repeated results.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text_bpe = coder(path, pattern)
        names = _names(text_bpe.bpe)
        sha = hashlib.sha256
        counts, ids_sha, bytes_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids = text_bpe.encode(text or "")
            counts.append(len(ids))
            ids_sha.append(sha(b" ".join(map(names.__getitem__, ids))).hexdigest())
            bytes_sha.append(sha(text_bpe.bpe.decode(ids)).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


_decimal: dict[int, dict[int, bytes]] = {}


def _names(bpe: PrefixBpe) -> dict[int, bytes]:
    if id(bpe) not in _decimal:
        _decimal[id(bpe)] = {i: b"%d" % i for i in bpe.tokens}
    return _decimal[id(bpe)]
