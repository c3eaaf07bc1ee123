"""SentencePiece encoding and decoding, with a parallel scan over giant documents.

Documents up to ``giant_chars`` are encoded by the library, unit by unit. A giant one is cut into
chunks that become rows of their own. A sequence of pieces is the BPE encoding of a text exactly
when every two neighbours are the encoding of their own concatenation, so encoding is a path problem
in a lattice whose states are (end, piece) and whose edges weigh 0 if the two pieces are compatible
and minus infinity if not. Each chunk yields the transfer matrix, in the max-plus algebra, from the
states before its first cut to those before its last; a scan over the matrices of a document finds
the one state at each cut that lies on the path from its beginning to its end; then each chunk is
traced back on its own between its two states.

Decoding works part by part. Defined cases: a null or empty text has no pieces; the library's sign
for a space (U+2581) decodes to a space; repeated rows are encoded each; an empty table gives an
empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, partitions, stored
from .units import SentencePieceBpe, _ranges, tokenizer

SPACE = "▁"
State = tuple[int, str]


class Lattice:
    """Pieces, their compatibility and the transfer matrices of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the pair with the best score is merged first, the left one of equals."""
        own = list(text)
        while True:
            best, at = None, -1
            for i in range(len(own) - 1):
                s = self.score.get(own[i] + own[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return own
            own[at:at + 2] = [own[at] + own[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Weight 0 (True) or minus infinity (False) of the edge between two pieces."""
        if not a:
            return True
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            got = self._fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def ending(self, text: str, end: int, lowest: int) -> list[str]:
        """Pieces that end at ``end`` and start at ``lowest`` or later; a character that is no piece is one here."""
        out = []
        for size in range(1, min(self.longest, end - lowest) + 1):
            t = text[end - size:end]
            if size == 1:
                out.append(t)
            elif t in self.ids:
                ok = self._whole.get(t)
                if ok is None:
                    ok = self._whole[t] = self.merged(t) == [t]
                if ok:
                    out.append(t)
        return out

    def entries(self, text: str, cut: int) -> list[State]:
        """States at or shortly before a cut (positions inside ``text``); at the beginning the empty one."""
        if cut == 0:
            return [(0, "")]
        low = max(0, cut - self.longest + 1)
        out = [(0, "")] if low == 0 else []
        return out + [(p, t) for p in range(max(1, low), cut + 1) for t in self.ending(text, p, 0)]

    def spread(self, text: str, cut: int, entries: list[State]) -> list[dict[str, int]]:
        """For each position behind the cut its pieces with the entries (as bits) they can be reached from."""
        reach: list[dict[str, int]] = [{} for _ in range(len(text) + 1)]
        for k, (p, t) in enumerate(entries):
            reach[p][t] = 1 << k
        low = min((p for p, _ in entries), default=0)
        for p in range(cut + 1, len(text) + 1):
            own = reach[p]
            for t in self.ending(text, p, low):
                bits = 0
                for before, b in reach[p - len(t)].items():
                    if self.compatible(before, t):
                        bits |= b
                if bits:
                    own[t] = bits
        return reach

    def matrix(self, text: str, cut: int, last: bool) -> tuple[list[State], list[tuple[int, str, int]]]:
        """Entries, and exits with the set of entries that have a path to them."""
        entries = self.entries(text, cut)
        reach = self.spread(text, cut, entries)
        low = len(text) if last else max(cut + 1, len(text) - self.longest + 1)
        return entries, [(p, t, bits) for p in range(low, len(text) + 1) for t, bits in reach[p].items()]

    def trace(self, text: str, cut: int, entry: State, leave: State) -> list[str]:
        """The pieces between two states."""
        reach = self.spread(text, cut, [entry])
        p, t = leave
        out = []
        while (p, t) != entry:
            out.append(t)
            q = p - len(t)
            t, p = next(b for b in reach[q] if self.compatible(b, t)), q
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for t in pieces:
            if t in self.ids:
                out.append(self.ids[t])
            elif self.bytes:
                out += [self.bytes[b] for b in t.encode()]
            else:
                out.append(self.unknown)
        return out


def compose(a: dict[State, set[State]], b: dict[State, set[State]]) -> dict[State, set[State]]:
    """Max-plus product of two matrices, as exit -> entries at distance 0; associative."""
    out = {leave: set().union(*(a.get(s, set()) for s in entries)) for leave, entries in b.items()}
    return {leave: entries for leave, entries in out.items() if entries}


def path_states(matrices: list[dict[State, set[State]]]) -> list[State]:
    """The state at each cut on the path from the first cut to the last: forward products give what can
    be reached, then the last state is followed back."""
    forward = [matrices[0]]
    for m in matrices[1:]:
        forward.append(compose(forward[-1], m))
    (last,) = forward[-1]
    states = [last]
    for k in range(len(matrices) - 1, 0, -1):
        (before,) = (s for s in matrices[k][states[-1]] if s in forward[k - 1])
        states.append(before)
    (first,) = matrices[0][states[-1]]
    return [*reversed([*states, first])]


CHUNKS = "uid long, chunk long, base long, cut int, last boolean, part string"


def _chunks(chunk_chars: int, context: int):
    def run(rows):
        for batch in rows:
            for uid, raw in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                text = SPACE + raw.replace(" ", SPACE)
                cuts = list(range(0, max(1, len(text) - chunk_chars // 2), chunk_chars)) + [len(text)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    base = max(0, a - context)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid], pa.int64()), pa.array([k], pa.int64()), pa.array([base], pa.int64()),
                         pa.array([a - base], pa.int32()), pa.array([b == len(text)]), pa.array([text[base:b]])],
                        names=["uid", "chunk", "base", "cut", "last", "part"])
    return run


def encode_giants(giants: DataFrame, model_path: str, chunk_chars: int = 1 << 14) -> DataFrame:
    """(uid, part, ids) of the texts of ``giants`` (uid, text), one part per chunk."""
    def matrices(frames):
        lattice = tokenizer(Lattice, model_path)
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                entries, exits = lattice.matrix(r.part, r.cut, r.last)
                out.append((r.uid, r.chunk, json.dumps([[(r.base + p, t) for p, t in entries],
                                                        [(r.base + p, t, hex(bits)) for p, t, bits in exits]])))
            yield pd.DataFrame(out, columns=["uid", "chunk", "matrix"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        tables = []
        for m in map(json.loads, pdf["matrix"]):
            entries = [tuple(e) for e in m[0]]
            tables.append({(p, t): {e for k, e in enumerate(entries) if int(bits, 16) >> k & 1} for p, t, bits in m[1]})
        states = path_states(tables)
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "p1": [p for p, _ in states[:-1]],
                             "t1": [t for _, t in states[:-1]], "p2": [p for p, _ in states[1:]], "t2": [t for _, t in states[1:]]})

    def trace(frames):
        lattice = tokenizer(Lattice, model_path)
        for pdf in frames:
            ids = [lattice.ids_of(lattice.trace(r.part, r.cut, (r.p1 - r.base, r.t1), (r.p2 - r.base, r.t2)))
                   for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"uid": pdf["uid"], "part": pdf["chunk"], "ids": ids})

    n = 4 * partitions(giants.sparkSession)
    chunks = stored(giants.mapInArrow(_chunks(chunk_chars, 64), CHUNKS).repartition(n, "uid", "chunk"), "chunks")
    states = chunks.mapInPandas(matrices, "uid long, chunk long, matrix string").groupBy("uid").applyInPandas(
        scan, "uid long, chunk long, p1 long, t1 string, p2 long, t2 string")
    return chunks.join(stored(states, "states"), ["uid", "chunk"]).mapInPandas(trace, "uid long, part long, ids array<int>")


def _whole_ids(rows, model_path: str, text_col: str):
    """Batches of rows, each with the ids of its texts and where those of a text start."""
    bpe = tokenizer(SentencePieceBpe, model_path)
    for batch, texts in batches(rows, text_col, 500_000):
        ids, offsets = bpe.ids_of(texts)
        yield batch, ids, offsets


def _schema(df: DataFrame, columns: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *(T.StructField(*m) for m in more)])


def _giant_parts(docs: DataFrame, keep: tuple[str, ...], text_col: str, model_path: str, giant_chars: int, chunk_chars: int) -> DataFrame:
    """(keep, uid, part, ids) of the documents of more than ``giant_chars``."""
    giants = docs.where(F.length(text_col) > giant_chars).withColumn("uid", F.monotonically_increasing_id())
    giants = stored(giants, "giants")
    parts = encode_giants(giants.select("uid", F.col(text_col).alias("text")), model_path, chunk_chars)
    return giants.drop(text_col).join(parts, "uid").select(*keep, "uid", "part", "ids")


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           giant_chars: int = 1 << 16, chunk_chars: int = 1 << 14) -> DataFrame:
    """The columns ``keep`` of ``docs`` with uid, part and ids. A giant document has several parts, in
    the order of ``part``; ``uid`` tells repeated rows apart (null where there is one part)."""
    docs, others = docs.select(*keep, text_col), list(keep)
    schema = _schema(docs, others, ("uid", T.LongType()), ("part", T.LongType()), ("ids", T.ArrayType(T.IntegerType())))

    def whole(rows):
        for batch, ids, offsets in _whole_ids(rows, model_path, text_col):
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], names=schema.names)

    small = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= giant_chars).mapInArrow(whole, schema)
    return small.unionByName(_giant_parts(docs, keep, text_col, model_path, giant_chars, chunk_chars))


def _slices(batch: pa.RecordBatch, most: int = 200_000):
    """The batch in parts of about ``most`` ids; a single longer row stays whole."""
    ends = np.cumsum(np.asarray(batch.column("ids").value_lengths().fill_null(0)))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _texts(ids: np.ndarray, offsets: np.ndarray, first: list[bool], model_path: str) -> list[str]:
    """The texts of ids that start at ``offsets``; a ``first`` part loses the space put in front."""
    at, size, chars = tokenizer(PieceBytes, model_path).arrays
    flat = chars[_ranges(at[ids], size[ids])].tobytes()
    ends = np.append(0, np.cumsum(size[ids]))[offsets].tolist()
    texts = (flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:]))
    return [t[1:] if f else t for t, f in zip(texts, first)]


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the text of each part in place of its ids."""
    others = [c for c in encoded.columns if c != "ids"]
    schema = _schema(encoded, others, ("text", T.StringType()))

    def run(rows):
        for batch in (part for whole in rows for part in _slices(whole)):
            column = batch.column("ids")
            offsets = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0))))
            texts = _texts(column.flatten().to_numpy(zero_copy_only=False), offsets, [p == 0 for p in batch.column("part").to_pylist()], model_path)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def _joined(parts: DataFrame) -> DataFrame:
    """Decoded parts of giant documents (with n_pieces) as one row per document."""
    others = [c for c in parts.columns if c not in ("uid", "part", "text", "n_pieces")]
    return parts.groupBy("uid").agg(
        *(F.first(c).alias(c) for c in others), F.sum("n_pieces").alias("n_pieces"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text")
    ).select(*others, "n_pieces", "text")


def whole_documents(decoded: DataFrame) -> DataFrame:
    """``decoded`` parts (with n_pieces) as one row per document. ``decoded`` is made once for whole documents
    and once for parts; ``round_trip`` makes each only once."""
    one = decoded.where("uid is null").drop("uid", "part")
    parts = _joined(decoded.where("uid is not null"))
    return one.select(*parts.columns).unionByName(parts)


def round_trip(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
               giant_chars: int = 1 << 16, chunk_chars: int = 1 << 14) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_pieces and the text that its pieces decode to, one row per document.

    The same as ``whole_documents(decode(encode(docs)))``, but a whole document is encoded once and decoded in the
    worker that encoded it, so its ids are not sent on and only parts of giant documents meet in a group."""
    docs, others = docs.select(*keep, text_col), list(keep)
    schema = _schema(docs, others, ("n_pieces", T.LongType()), ("text", T.StringType()))

    def both(rows):
        for batch, ids, offsets in _whole_ids(rows, model_path, text_col):
            texts = _texts(ids, offsets, [True] * len(batch), model_path)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(np.diff(offsets), pa.int64()), pa.array(texts, pa.string())],
                                             names=schema.names)

    small = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= giant_chars).mapInArrow(both, schema)
    parts = _giant_parts(docs, keep, text_col, model_path, giant_chars, chunk_chars).withColumn("n_pieces", F.size("ids").cast("long"))
    return small.unionByName(_joined(decode(parts, model_path)))


class PieceBytes:
    """The bytes of every piece: place, size, and all of them one after the other."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
               else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
        size = np.array([len(b) for b in own], np.int64)
        self.arrays = np.cumsum(size) - size, size, np.frombuffer(b"".join(own), np.uint8)
