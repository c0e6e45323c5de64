"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens, its documents one after another, dealt out in quanta of SLOT tokens. The target
proportions are given as weights, or else are the sources' shares of all tokens. A quantum falls due when its queue's deficit, the tokens that its
share of the stream has earned beyond those it was served, reaches half a quantum; quanta are served in the order in which
they fall due (ties by queue, that of the greater weight first). The order is that of (2 k + 1) / w for quantum k of a queue of weight w, and a queue
that is empty leaves its share to the others. So a quantum's place in
the stream follows from the queues' lengths and weights alone, exactly and in integers: any task finds the places of its own
documents, and deficits carry across windows and across partitions without a pass over the windows. Every window of
WINDOW tokens holds WINDOW / SLOT whole quanta, of each source its share to within a quantum.

Queues of one weight and as many quanta count as one group, so a place takes as many steps as there are different lengths in quanta: at
most the root of twice the stream's quanta, however many sources there are. Each source has a queue of its own.

What is left of the queues, less than a quantum of each, follows at the end. The last window isn't full; it is cut
into sequences of powers of two, so that nothing is padded.

Defined results: a null text is empty, and an empty text is the closing id alone. Null sources are a source. Repeated
rows are packed each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import common

WINDOW, SLOT, END_ID = 2048, 128, 1
#: Steps of a weight of 1.
SCALE = 1_000_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Ids of texts by the tokenizers file. Texts in which both libraries provably split alike (code points below
    0x250, no run of 1000 characters without a space or of spaces, no added token's string) go through the same vocabulary's ranks, which is faster."""

    _OTHER = re.compile("[^\x00-\u024f]")
    _RUN = re.compile("\\S{1000}|\\s{1000}")

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER))
        added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if tokenizer is None or ranks is not None:
            import tiktoken

            with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.width = "<u2" if self.exact.get_vocab_size() <= 1 << 16 else "<u4"

    def _alike(self, text: str) -> bool:
        """Whether both libraries provably split the text alike."""
        if self.added and self.added.search(text):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self._OTHER.search(text):
                return False
        # a run of 1000 holds a whole stretch of 500 that has no space, or nothing else
        stretches = range(0, len(text) - 499, 500)
        return not any(text.find(" ", i, i + 500) < 0 or text[i : i + 500].isspace() for i in stretches) or not self._RUN.search(text)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or not self._alike(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """An encoder is read once in each worker, not by each task."""
    return Encoder(tokenizer, ranks)


@dataclass
class Layout:
    """Where the tokens of queues go in the stream, and the stream's sequences. groups: (weight, quanta, queues, tokens in their tails), by falling
    weight, then quanta; a queue is told by its group and its number in that."""

    groups: list[tuple[int, int, int, int]]
    window: int = WINDOW
    slot: int = SLOT

    def __post_init__(self):
        if self.window % self.slot:
            raise ValueError("a window has to hold whole quanta")
        weights, quanta, queues, tails = (list(x) for x in zip(*self.groups, strict=True)) if self.groups else ([], [], [], [])
        self.whole = sum(k * m for k, m in zip(quanta, queues, strict=True))
        wide = 2 * max(weights, default=0) * (max(quanta, default=0) + 1) >= 1 << 62 or self.whole >= 1 << 62
        self.weights, self.quanta, self.queues = (np.array(x, object if wide else np.int64) for x in (weights, quanta, queues))
        self.tail_at = [self.whole * self.slot + sum(tails[:g]) for g in range(len(tails))]
        total = self.whole * self.slot + sum(tails)
        self.last, rest = divmod(total, self.window)
        self.cuts = [self.last * self.window]  # where the sequences from the last window on begin
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))

    def places(self, group: int, number: int, k: np.ndarray) -> np.ndarray:
        """The place, among all quanta, of quanta k of a queue."""
        own = self.weights[group]
        earlier = np.arange(len(self.weights)) < group
        step = max(1, (1 << 20) // max(1, len(self.weights)))
        out = []
        for i in range(0, len(k), step):
            due = (2 * k[i : i + step].astype(self.weights.dtype) + 1)[:, None] * self.weights[None, :]
            served = np.minimum((due + own - 1 + earlier) // (2 * own), self.quanta[None, :])
            out.append((served * self.queues[None, :]).sum(axis=1) + number)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)

    def sequence(self, at: int) -> tuple[int, int, int]:
        """Sequence, offset in it and the tokens up to its end, of a position of the stream."""
        if at < self.cuts[0]:
            return at // self.window, at % self.window, self.window - at % self.window
        j = max(i for i, c in enumerate(self.cuts) if c <= at)
        return self.last + j, at - self.cuts[j], (self.cuts[j + 1] if j + 1 < len(self.cuts) else self.cuts[0] + self.window) - at

    def pieces(self, group: int, number: int, tail: int, start: int, n: int) -> list[tuple[int, int, int, int]]:
        """(first token, tokens, sequence, offset) of the pieces of n tokens that begin at start in a queue; tail: the tokens in the tails of its
        group's queues before it."""
        out, at, end = [], start, start + n
        full = int(self.quanta[group]) * self.slot
        if at < full:
            k = np.arange(at // self.slot, (min(end, full) - 1) // self.slot + 1)
            for j, place in zip(k.tolist(), self.places(group, number, k).tolist(), strict=True):
                stop = min(end, (j + 1) * self.slot)
                s, offset, _ = self.sequence(place * self.slot + at - j * self.slot)
                if out and out[-1][2] == s and out[-1][3] + out[-1][1] == offset:  # quanta that follow each other stay one piece
                    out[-1] = (out[-1][0], out[-1][1] + stop - at, s, out[-1][3])
                else:
                    out.append((at - start, stop - at, s, offset))
                at = stop
        while at < end:
            s, offset, room = self.sequence(self.tail_at[group] + tail + at - full)
            take = min(room, end - at)
            out.append((at - start, take, s, offset))
            at += take
        return out


def encoded(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(part, doc_id, source, start, n, ids): each document's packed ids with END_ID; start: the tokens of its source before it in its part."""

    def run(batches):
        ids_of, part, so_far = encoder(tokenizer, ranks), TaskContext.get().partitionId(), {}
        for batch in batches:
            starts, counts, ids = [], [], []
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist(), strict=True):
                found = np.array([*ids_of.ids(text or ""), END_ID], ids_of.width)
                starts.append(so_far.get(source, 0))
                counts.append(len(found))
                ids.append(found.tobytes())
                so_far[source] = starts[-1] + len(found)
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), batch.column("doc_id"), batch.column("source"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "source", "start", "n", "ids"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return common.map_batches(rows, run, f"part int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, start long, n long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, slot: int = SLOT, weights: dict | None = None, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (32-bit, little-endian).

    weights: target proportions by source (None: the null source), in steps of a millionth; sources that it doesn't name weigh 1. Without it
    the sources' shares of all tokens are the target, so that all queues last to the end."""
    rows = common.stored(encoded(docs, tokenizer, ranks), "tokens")
    totals = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    by_source = totals.groupBy("source").agg(F.sum("tokens").alias("t")).withColumn("quanta", F.floor(F.col("t") / slot).cast("long"))
    by_source = by_source.withColumn("tail", F.col("t") - F.col("quanta") * slot)
    if weights is None:
        by_source = by_source.withColumn("weight", F.greatest(F.col("quanta"), F.lit(1)).cast("long"))
    else:
        given = docs.sparkSession.createDataFrame([(n, max(1, round(w * SCALE))) for n, w in weights.items()], "name string, weight long")
        by_source = by_source.join(given, by_source.source.eqNullSafe(given.name), "left").drop("name").withColumn("weight", F.coalesce("weight", F.lit(SCALE)))
    alike = Window.partitionBy("weight", "quanta").orderBy(F.col("source").asc_nulls_last())
    by_source = by_source.withColumn("number", F.row_number().over(alike) - 1).withColumn("tails", F.coalesce(F.sum("tail").over(alike.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_source = common.stored(by_source, "queues")
    # a row for each weight and length in quanta
    found = by_source.groupBy("weight", "quanta").agg(F.count("*").alias("queues"), F.sum("tail").alias("tails")).orderBy(F.desc("weight"), F.desc("quanta")).collect()
    layout = Layout([(r["weight"], r["quanta"], r["queues"], r["tails"]) for r in found], window, slot)
    order = {(r["weight"], r["quanta"]): i for i, r in enumerate(found)}
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    own = by_source.select(F.col("source").alias("name"), "weight", "quanta", "number", "tails")
    # stored, so that Spark knows its size and needn't shuffle the ids where it is small
    base = common.stored(base.join(own, base.of.eqNullSafe(own["name"])).drop("name"), "places")
    sent = docs.sparkSession.sparkContext.broadcast((layout, order))  # as many rows as different lengths
    small = "<u2" if tokenizer is None else None

    def run(batches):
        width, (layout, order) = small or encoder(tokenizer, ranks).width, sent.value
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "weight", "quanta", "number", "tails", "at", "n", "ids")]
            for doc_id, source, weight, quanta, number, tails, at, n, ids in zip(*columns, strict=True):
                data = memoryview(np.frombuffer(ids, width).astype("<u4").tobytes())
                for first, length, sequence, offset in layout.pieces(order[weight, quanta], number, tails, at, n):
                    piece = data[4 * first : 4 * (first + length)]
                    for column, x in zip(out, (doc_id, source, first, length, zlib.crc32(piece), n, sequence, offset, bytes(piece) if with_ids else None), strict=True):
                        column.append(x)
            kinds = [batch.schema.field("doc_id").type, pa.string(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = rows.join(base, rows.source.eqNullSafe(base.of) & (rows.part == base.of_part)).select("doc_id", "source", "weight", "quanta", "number", "tails", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = common.map_batches(placed, run, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return found if with_ids else found.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the sequences of pieces that have their ids, each of one window at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), ordered.alias("p")).select("sequence_id", "tokens", F.expr("aggregate(transform(p, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
