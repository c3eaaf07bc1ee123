"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Texts up to ``chunk_chars`` are encoded whole. Longer ones are cut into chunks that become rows of
their own, each reaching ``overlap`` characters into the next chunk. Neighbours are spliced at the
first place of their overlap where a unit of the pre-tokenizer starts in both: the pre-tokenizer
has no memory across such a place, and the left chunk's units before it are those of the whole text
as long as it lies further from the chunk's end than any special token is long. Documents without
such a place go through again with chunks and overlaps four times as wide, in the end as one chunk.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import batches, partitions, stored
from .units import ByteBpe, tokenizer


def boundaries(encoding, special_ids: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(character position, tokens before it) wherever a unit of the pre-tokenizer starts."""
    word = np.array([-1 if w is None else w for w in encoding.word_ids])
    own = np.isin(np.array(encoding.ids), list(special_ids))
    cut = np.ones(len(word), bool)
    cut[1:] = (word[1:] != word[:-1]) | own[1:] | own[:-1]
    index = np.flatnonzero(cut)
    start = np.array([a for a, _ in encoding.offsets], np.int64)[index]  # the library makes its list at each call
    return start, index


def splice(tail: tuple[np.ndarray, np.ndarray], head: tuple[np.ndarray, np.ndarray]) -> tuple[int, int] | None:
    """Tokens before the first common place, in the left and in the right chunk."""
    common, i, j = np.intersect1d(tail[0], head[0], return_indices=True)
    return (int(tail[1][i[0]]), int(head[1][j[0]])) if len(common) else None


def _cut(chunk_chars: int, overlap: int):
    def run(rows):
        for batch in rows:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                for k, a in enumerate(range(0, len(text), chunk_chars)):
                    part = text[a:a + chunk_chars + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid], pa.int64()), pa.array([k], pa.int64()), pa.array([a], pa.int64()),
                         pa.array([a + chunk_chars < len(text)]), pa.array([part])],
                        names=["uid", "chunk", "start", "more", "part"])
    return run


CHUNKS = "uid long, chunk long, start long, more boolean, part string"
ENCODED = ("uid long, chunk long, more boolean, n long, head_at array<long>, head_n array<long>, "
           "tail_at array<long>, tail_n array<long>")


def _encode(path: str, chunk_chars: int, overlap: int):
    def run(frames):
        bpe = tokenizer(ByteBpe, path)
        margin = max([len(s) for s in bpe.special], default=0) + 1
        special = set(bpe.library.get_added_tokens_decoder())
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                e = bpe.library.encode(r.part, add_special_tokens=False)
                at, n = boundaries(e, special)
                head = at < overlap
                tail = (at >= chunk_chars) & (at <= len(r.part) - margin) if r.more else np.zeros(len(at), bool)
                out.append((r.uid, r.chunk, r.more, len(e.ids), r.start + at[head], n[head], r.start + at[tail], n[tail]))
            yield pd.DataFrame(out, columns=["uid", "chunk", "more", "n", "head_at", "head_n", "tail_at", "tail_n"])
    return run


def _joints(frames):
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            got = splice((np.asarray(r.tail_at), np.asarray(r.tail_n)), (np.asarray(r.head_at), np.asarray(r.head_n)))
            out.append((r.uid, got is None, got[0] - got[1] if got else 0))
        yield pd.DataFrame(out, columns=["uid", "failed", "tokens"])


def _spliced(huge: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(uid, n_tokens, failed): the last chunk gives all its tokens, and each joint the left chunk's
    tokens before it less the right chunk's."""
    n = 4 * partitions(huge.sparkSession)
    chunks = huge.mapInArrow(_cut(chunk_chars, overlap), CHUNKS).repartition(n, "uid", "chunk")
    encoded = stored(chunks.mapInPandas(_encode(path, chunk_chars, overlap), ENCODED), "encoded")
    right = encoded.select("uid", (F.col("chunk") - 1).alias("chunk"), "head_at", "head_n")
    left = encoded.where("more").select("uid", "chunk", "tail_at", "tail_n")
    joints = left.join(right, ["uid", "chunk"]).mapInPandas(_joints, "uid long, failed boolean, tokens long")
    last = encoded.where("not more").select("uid", F.lit(False).alias("failed"), F.col("n").alias("tokens"))
    return joints.unionByName(last).groupBy("uid").agg(F.sum("tokens").alias("n_tokens"), F.max("failed").alias("failed"))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = 1 << 16, overlap: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens) for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                         T.StructField("n_tokens", T.LongType())])

    def whole(parts):
        bpe = tokenizer(ByteBpe, tokenizer_path)
        for batch, texts in batches(parts, "text"):
            _, offsets = bpe.ids_of(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), pa.array(np.diff(offsets), pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    small = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, kind)
    huge = stored(rows.where(F.length("text") > chunk_chars).withColumn("uid", F.monotonically_increasing_id()), "huge")
    done, left, width = [], huge, 1
    while not left.isEmpty():
        got = stored(_spliced(left.select("uid", "text"), tokenizer_path, width * chunk_chars, width * overlap), "spliced")
        done.append(left.join(got.where("not failed"), "uid").select(id_col, "n_bytes", "n_tokens"))
        left = left.join(got.where("failed"), "uid", "left_semi")
        width *= 4
    for d in done:
        small = small.unionByName(d)
    return small
