"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units (a run of word marks and what follows it; no
piece crosses such a cut) and the batch's distinct units are concatenated. A suffix array
of the concatenation, exact to the longest piece, is built by prefix doubling; every
piece is binary-searched in it for its range of occurrences. The occurrences are edges
(start, length, piece), sorted by start, and relaxed from left to right: position ``j``
takes the edge ``(i, piece)`` whose piece may follow the piece that ends at ``i``.

The vocabularies read here are byte-pair models: a text's pieces come from merging, best
piece first. Two pieces may be neighbours exactly if merging their joined text gives them
back, and a sequence is the model's encoding exactly if all neighbours may be neighbours,
so each position has one valid edge and the relaxed path is the model's own encoding.
Characters without a piece become their UTF-8 bytes' pieces.

Per task only the pieces, a bounded memory of recent units and one slice of a batch are
held; a text longer than a slice is encoded part by part, cut where a unit starts. Only a
single unit (characters without a space between them) is indexed whole, at some hundred
bytes a character. One pass, no shuffle.

Edge cases: null and empty texts have no ids and decode to an empty text; a text's own
word marks (U+2581) decode as spaces, as in the library; texts of any length are encoded
whole; repeated rows are encoded alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean

MARK = "▁"
#: Bytes of text whose new units are indexed together, and units that a task remembers.
SLICE_BYTES, REMEMBERED, REMEMBERED_PAIRS = 2 << 20, 150_000, 1_000_000
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """Encoder and decoder of one byte-pair model file."""

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: -sp.get_score(i) for i in plain}
        self.names = names
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside: units can't be cut there")
        self.texts = [b""] * n
        for p, i in self.ids.items():
            self.texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.texts[i] = bytes([b])
        self.by_text = sorted(self.ids)
        # by index into by_text; one more for a character without a piece
        self.lengths = np.array([len(p) for p in self.by_text] + [1], dtype=np.int64)
        self.piece_ids = np.array([self.ids[p] for p in self.by_text] + [0], dtype=np.int64)
        self.whole = np.array([self.merged(p) == [p] for p in self.by_text] + [True])
        self.single_codes = np.array([ord(p) + 1 for p in self.by_text if len(p) == 1], dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # control characters without a piece cut units too
        plain = "".join(chr(c) for c in range(32) if not any(chr(c) in p for p in self.ids))
        cut = f"{MARK}{re.escape(plain)}"
        self.unit = re.compile(f"{MARK}+[^{cut}]*|[^{cut}]+" + (f"|[{re.escape(plain)}]" if plain else ""))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging; characters without a piece stay single."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r, i) for i, r in enumerate(ranks) if r is not None) if any(r is not None for r in ranks) else None
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follow(self, pairs):
        """Whether each pair (key: first piece * number of pieces + second) may be neighbours; judged once and remembered."""
        import numpy as np

        keys = np.unique(pairs)
        known, ok = self.pairs
        at = np.searchsorted(known, keys)
        new = keys[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != keys)] if len(known) else keys
        if len(new):
            names, n = self.by_text, len(self.by_text)
            judged = [self.merged(names[k // n] + names[k % n]) == [names[k // n], names[k % n]] for k in new.tolist()]
            if len(known) > REMEMBERED_PAIRS:
                known, ok = known[:0], ok[:0]
                new = keys
                judged = [self.merged(names[k // n] + names[k % n]) == [names[k // n], names[k % n]] for k in new.tolist()]
            at = np.searchsorted(known, new)
            known, ok = self.pairs = np.insert(known, at, new), np.insert(ok, at, judged)
        return ok[np.searchsorted(known, pairs)]

    def edges(self, units: list[str]):
        """Occurrences (start, piece index, position in the unit) sorted by that position, each unit's start, and the length."""
        import numpy as np

        depth = self.longest
        joined = "\0".join(units) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
        ends = np.cumsum([len(u) + 1 for u in units])
        code[ends - 1] = 0  # ends of units: no piece goes over them
        n = len(code)
        # prefix doubling: rank of each position by its first k characters, as many as fit a word to begin with
        alphabet, letter = np.unique(code, return_inverse=True)
        bits = max(1, int(len(alphabet)).bit_length())
        k = min(depth, 62 // bits)
        word = np.zeros(n + k, dtype=np.int64)
        letter = np.append(letter + 1, np.zeros(2 * k, dtype=np.int64))
        for i in range(k):
            word = word << bits | letter[i : i + n + k]
        _, rank = np.unique(word[:n], return_inverse=True)
        while k < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - k, 0)] = rank[k:] + 1
            _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
            k *= 2
        order = np.argsort(rank, kind="stable")
        padded = np.append(code, np.zeros(depth, dtype=np.int64)).astype("<u4")
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, depth)[:n][order]
        suffixes = np.ascontiguousarray(suffixes).view(f"<U{depth}").ravel()
        low, high, letters = self.bounds(depth)
        here = np.zeros(0x110002, dtype=bool)
        here[alphabet] = here[0] = True
        asked = np.flatnonzero(here[letters].all(axis=1))  # a piece with a letter that no unit has doesn't occur
        count, lo = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        lo[asked] = np.searchsorted(suffixes, low[asked])
        count[asked] = np.searchsorted(suffixes, high[asked], side="right") - lo[asked]
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        alone = np.flatnonzero((code > 0) & ~np.isin(code, self.single_codes))
        at, which = np.append(at, alone), np.append(which, np.full(len(alone), len(count)))  # characters without a piece
        starts = ends - [len(u) + 1 for u in units]
        offset = at - starts[np.searchsorted(starts, at, side="right") - 1]
        if int(ends[-1]) < 1 << 16 or int(offset.max()) < 1 << 16:
            offset = offset.astype(np.uint16)  # sorted by radix
        by = np.argsort(offset, kind="stable")
        return at[by], which[by], offset[by].astype(np.int64), starts, n

    def bounds(self, depth: int):
        """Least and greatest ``depth`` characters that start with each piece, code points plus one; and its letters."""
        import numpy as np

        if not hasattr(self, "_bounds"):
            low = np.zeros((len(self.by_text), depth), dtype="<u4")
            for i, p in enumerate(self.by_text):
                low[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), dtype="<u4") + 1
            high = np.where(low == 0, 0x10FFFF, low).astype("<u4")
            self._bounds = *(np.ascontiguousarray(x).view(f"<U{depth}").ravel() for x in (low, high)), low
        return self._bounds

    def learn(self, units: list[str]) -> None:
        """Encode new units together and remember them as little-endian 32-bit ids."""
        import numpy as np

        if not units:
            return
        at, which, offset, starts, n = self.edges(units)
        v = len(self.by_text)
        to = at + self.lengths[which]
        last = np.full(n + 1, -1, dtype=np.int64)  # the piece that ends before a position, number v for a lone character
        cuts = np.append(np.flatnonzero(np.diff(offset, prepend=-1)), len(offset)).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            piece, here = which[lo:hi], last[at[lo:hi]]
            fresh = (here == v) | (offset[lo] == 0)  # nothing before the piece can merge with it
            ok = (piece == v) | fresh & self.whole[piece]
            ask = np.flatnonzero((piece != v) & ~fresh & (here >= 0))
            ok[ask] = self.follow(here[ask] * v + piece[ask])
            last[to[lo:hi][ok]] = piece[ok]
        # back from the ends of the units
        at, unit, taken = starts + [len(u) for u in units], np.arange(len(units)), []
        while len(at):
            piece = last[at]
            if (piece < 0).any():
                raise RuntimeError(f"no piece ends in {units[unit[int(np.argmin(piece))]]!r}")
            taken.append((unit, at, piece))
            at = at - self.lengths[piece]
            more = at > starts[unit]
            at, unit = at[more], unit[more]
        unit, at, piece = (np.concatenate(x) for x in zip(*taken))
        by = np.argsort(at)
        unit, piece = unit[by], piece[by]
        raw = self.piece_ids[piece].astype("<i4").tobytes()
        ends = np.cumsum(np.bincount(unit, minlength=len(units))).tolist()
        lone = set(unit[piece == v].tolist())
        begin = 0
        for i, (u, end) in enumerate(zip(units, ends)):
            if i not in lone:
                self.memory[u] = raw[4 * begin : 4 * end]
            else:
                out, j = [], 0
                for k in piece[begin:end].tolist():
                    if k < v:
                        out.append(self.ids[self.by_text[k]])
                        j += len(self.by_text[k])
                    else:
                        out += [self.byte_ids[b] for b in u[j].encode("utf-8")]
                        j += 1
                self.memory[u] = b"".join(x.to_bytes(4, "little") for x in out)
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        return self.encoded([MARK + t.replace(" ", MARK) if t else "" for t in texts])

    def encoded(self, marked: list[str]) -> list[bytes]:
        """Ids of texts, or parts of them that start a unit, with their marks in place. Units are remembered for two generations."""
        cut = [self.unit.findall(t) for t in marked]
        if len(self.memory) > REMEMBERED:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        new = set().union(*cut).difference(memory)
        for u in new.intersection(older):
            memory[u] = older[u]
        self.learn(list(new.difference(older)))
        return [b"".join([memory[u] for u in units]) for units in cut]

    def parts(self, text: str) -> Iterator[str]:
        """A text with its marks in place, in parts of about ``SLICE_BYTES`` characters that each start a unit."""
        marked, begin = MARK + text.replace(" ", MARK) if text else "", 0
        while len(marked) - begin > SLICE_BYTES:
            at = marked.find(MARK, begin + SLICE_BYTES)
            while at > 0 and marked[at - 1] == MARK:  # inside a run of marks
                at = marked.find(MARK, at + 1)
            if at < 0:
                break
            yield marked[begin:at]
            begin = at
        yield marked[begin:]

    def decode(self, ids) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode("utf-8", "replace")[1:]


def loaded(model: bytes) -> Pieces:
    """The model's pieces; a worker process keeps them, and the units it remembers, from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _encoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pieces = loaded(model)

        def rows(held: list[tuple[object, str]]) -> pa.RecordBatch:
            if len(held) == 1:
                raw = [b"".join(x for part in pieces.parts(held[0][1]) for x in pieces.encoded([part]))]
            else:
                raw = pieces.encode([t for _, t in held])
            arrays = [np.frombuffer(r, dtype="<i4") for r in raw]
            decoded = [pieces.decode(a.tolist()) for a in arrays]
            offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
            values = pa.array(np.concatenate(arrays) if arrays else [], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == t.replace(MARK, " ") for d, (_, t) in zip(decoded, held)], pa.bool_()),
                ],
                ["id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
            )

        for b in batches:
            held, size = [], 0
            for i, t in zip(b.column(0), b.column(1)):
                row = i.as_py(), t.as_py() or ""
                if held and size + len(row[1]) > SLICE_BYTES:
                    yield rows(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
            if held:
                yield rows(held)

    return run


def _decoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["id", "text"])

    return run


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded_sha256, round_trip) of every row; the model's bytes travel with the task."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(_encoded(model)), "id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, model: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids."""
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(lean(_decoded(model)), "id long, text string")


def op6_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_bytes(model or default_model()))
    return found.withColumnRenamed("id", "doc_id")
