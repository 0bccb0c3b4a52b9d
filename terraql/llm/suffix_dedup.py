"""Suffix-array dedup: a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are sorted by their first ``span`` symbols only, so groups of equal ones are the repeated windows.
Symbols are bytes, or words by their hashes. A digit is as wide as it can be, and what is alone in its group
after a digit leaves.

Digit 1: the anchor, the least of the hashes of all strings of ``gram`` symbols in the window. Equal windows have
equal anchors at equal offsets. Windows next to each other share an anchor, so a cell (the windows of
one anchor, one after the other) stands for about a hundred suffixes of bytes. Equal cells that follow each other, as in a
run of one letter, are one row.
Digit 2: the symbols of the cell. Cells in a group of two or more are repeated as a whole.
Digit 3: for cells that share an anchor with other cells, the symbols of each of their windows, sorted within the group of
the anchor. Groups of very many different cells are not gathered: their windows are dealt out by digit 3 itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraql.llm.shared import Scratch, bounded_batches, cut, scratch

SPAN, GRAM = 400, 160
#: Words of a passage, and of the strings that its anchors are picked from.
WORDS, WORD_GRAM = 50, 16
#: Symbols of a text sorted at a time, different cells of an anchor that are gathered in a task, and windows sorted at a time.
PIECE, GATHERED, AT_ONCE = 1 << 18, 2000, 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)
PLACE = np.uint64((1 << 21) - 1)
#: The end of a stretch that goes to the end of its text.
END = 1 << 40
CELLS = "anchor long, cell long, digest binary, first long, count int, times long"
HELD = "anchor long, cell long, digest binary, count int, settled boolean, apart boolean, crowd boolean, symbols binary"


@dataclass(frozen=True)
class Depth:
    """How deep suffixes are sorted: windows of ``span`` bytes or words that start anywhere else, or in another text."""

    span: int = SPAN
    gram: int = GRAM
    words: bool = False
    apart: bool = False

    def symbols(self, raw: bytes) -> bytes | np.ndarray:
        return word_hashes(raw) if self.words else raw

    def stored(self, raw: bytes | np.ndarray, at: int, n: int) -> bytes:
        return raw[at : at + n] if isinstance(raw, bytes) else raw[at : at + n].tobytes()

    def read(self, buffer: pa.Buffer) -> np.ndarray:
        return np.frombuffer(buffer, np.uint64 if self.words else np.uint8)


def word_hashes(raw: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Hashes of the runs of other bytes than the six ASCII spaces, for a piece of the text at a time."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and raw[end] not in b" \t\n\r\v\f":
            end += 1
        words = raw[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


class Hashes:
    """Rolling hashes of all strings of a length, from sums of the symbols' random numbers times powers; two families of them."""

    powers = [np.zeros(0, np.uint64)] * 2
    inverses = list(powers)
    tables = [np.random.default_rng(7 + f).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for f in range(2)]

    @classmethod
    def ready(cls, n: int, family: int) -> None:
        if len(cls.powers[family]) < n:
            for held, base in ((cls.powers, BASES[family]), (cls.inverses, pow(BASES[family], -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                held[family] = np.cumprod(steps)

    def __init__(self, data: np.ndarray, family: int = 0) -> None:
        n = len(data)
        self.family = family
        self.ready(max(n + 1, PIECE + SPAN + 1), family)
        own = self.tables[family][data] if data.dtype == np.uint8 else (data ^ self.tables[family][0]) * self.tables[family][1] | np.uint64(1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * self.powers[family][:n], out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        x = (self.sums[width:] - self.sums[:-width]) * self.inverses[self.family][: len(self.sums) - width]
        x ^= x >> np.uint64(31)
        x *= MIX
        x ^= x >> np.uint64(29)
        return x


def cells(raw: bytes | np.ndarray, span: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the piece, anchor hash, anchor, first window, windows) of the cells of a text; places within the piece."""
    for piece in range(0, max(0, len(raw) - span + 1), PIECE):
        n = min(len(raw) - piece, PIECE + span - 1)
        data = np.frombuffer(raw, np.uint8, n, piece) if isinstance(raw, bytes) else raw[piece : piece + n]
        grams = Hashes(data).of(gram)
        wide = span - gram + 1
        least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
        have = 1
        while have * 2 <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < wide:
            least = np.minimum(least[: len(grams) - wide + 1], least[wide - have :])
        anchor = (least & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, len(anchor)))
        anchor = anchor[first]
        yield piece, grams[anchor], anchor, first, count


def anchor_rows(batches: Iterator[pa.RecordBatch], depth: Depth) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text) to a row for each cell, or ``times`` equal ones that follow each other."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, texts = batch.column("digest"), batch.column("text")
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        size = 0
        for i in range(batch.num_rows):
            raw = depth.symbols(texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"")
            view, wide = memoryview(raw).cast("B"), 8 if depth.words else 1
            for piece, h, anchor, first, count in cells(raw, depth.span, depth.gram):
                ends = first + piece + count + depth.span - 1
                whole = np.array([digest(view[s:e], o) for s, e, o in zip(((first + piece) * wide).tolist(), (ends * wide).tolist(), (anchor - first).tolist(), strict=True)], np.uint64)
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]) | (count[1:] != count[:-1])))
                times = np.diff(np.append(new, len(h)))
                for column, x in zip(out, (h[new].view(np.int64), whole[new].view(np.int64), np.full(len(new), i), first[new] + piece, count[new], times), strict=True):
                    column.append(x)
                size += len(new)
            if out[0] and (size > 1 << 16 or i == batch.num_rows - 1):
                a, c, row, first, count, times = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), keys.take(pa.array(row)), pa.array(first), pa.array(count.astype(np.int32)), pa.array(times.astype(np.int64))], ["anchor", "cell", "digest", "first", "count", "times"])
                out, size = [[], [], [], [], [], []], 0


def cell_rows(batches: Iterator[pa.RecordBatch], depth: Depth) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text, wanted cells) to the symbols of each cell."""
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("digest")
        out: list[tuple] = []
        size = 0
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            raw, key = depth.symbols(texts[i].as_buffer().to_pybytes()), keys[i].as_py()
            for w in wanted:
                own = depth.stored(raw, w["first"], w["count"] + depth.span - 1)
                out.append((w["anchor"], w["cell"], key, w["count"], w["settled"], w["apart"], w["crowd"], own))
                size += len(own)
                if size > 1 << 23:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())
    names = ("anchor", "cell", "digest", "count", "settled", "apart", "crowd", "symbols")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def windows(batch: pa.RecordBatch, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the cells of a batch: its cell's row, its place in the cell, and two hashes of its symbols."""
    count = batch.column("count").to_numpy().astype(np.int64)
    one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for x in batch.column("symbols"):
        data = depth.read(x.as_buffer())
        one.append(Hashes(data, 0).of(depth.span))
        two.append(Hashes(data, 1).of(depth.span))
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, step, np.concatenate(one), np.concatenate(two)


def repeated_in_groups(batches: Iterator[pa.RecordBatch], depth: Depth) -> Iterator[pa.RecordBatch]:
    """Rows of cells sorted by anchor to (anchor, cell, start, stop): stretches of windows of a cell that are repeated in its group."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        anchors = table.column("anchor").to_numpy()
        last = int(np.searchsorted(np.append(False, anchors[1:] != anchors[:-1]).cumsum(), (anchors[1:] != anchors[:-1]).sum()))
        if last and table.nbytes > 1 << 22:
            yield from _sorted(table.slice(0, last), depth)
            table = table.slice(last)
        held = table
    if held is not None and held.num_rows:
        yield from _sorted(held, depth)


def _sorted(table: pa.Table, depth: Depth) -> Iterator[pa.RecordBatch]:
    """Digit 3, some groups at a time."""
    anchors, count = table.column("anchor").to_numpy(), table.column("count").to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    sums = np.add.reduceat(count, starts)
    part = np.cumsum(sums) // AT_ONCE
    for p in np.unique(part):
        own = starts[part == p]
        following = starts[starts > own[-1]]
        some = table.slice(int(own[0]), int((following[0] if len(following) else table.num_rows) - own[0])).combine_chunks().to_batches()[0]
        yield _one(some, depth)


def _one(batch: pa.RecordBatch, depth: Depth) -> pa.RecordBatch:
    row, step, one, two = windows(batch, depth)
    anchor, text = batch.column("anchor").to_numpy()[row], batch.column("digest").dictionary_encode().indices.to_numpy()[row]
    order = np.lexsort((text, two, one, anchor))
    a, x, y, t = anchor[order], one[order], two[order], text[order]
    same = (a[1:] == a[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    group = np.append(0, np.cumsum(~same))
    varied = np.zeros(group[-1] + 1, bool)
    # the rows are different places, so two in a group are a repeat; where texts count, they have to be two texts
    varied[group[1:][same & ((t[1:] != t[:-1]) | (not depth.apart))]] = True
    if depth.apart:
        varied[group[batch.column("apart").to_numpy(zero_copy_only=False)[row][order]]] = True
    hit = np.zeros(len(row), bool)
    hit[order] = varied[group]
    hit &= ~batch.column("settled").to_numpy(zero_copy_only=False)[row]
    begin = hit & np.append(True, ~hit[:-1] | (row[1:] != row[:-1]))
    end = hit & np.append(~hit[1:] | (row[1:] != row[:-1]), True)
    own = pa.array(row[begin])
    return pa.RecordBatch.from_arrays([batch.column("anchor").take(own), batch.column("cell").take(own), pa.array(step[begin]), pa.array(step[end] + 1)], ["anchor", "cell", "start", "stop"])


def window_rows(batches: Iterator[pa.RecordBatch], depth: Depth) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            row, step, one, two = windows(some, depth)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([some.column(c).take(pick) for c in ("anchor", "cell", "digest", "settled", "apart")] + [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(step.astype(np.int32))], ["anchor", "cell", "digest", "settled", "apart", "one", "two", "step"])


def text_digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def repeats(docs: DataFrame, depth: Depth, gathered: int, into: Scratch) -> DataFrame:
    """A scratch table (digest, first, last): for each text by its digest, the bytes or words [first, last) of windows that start anywhere else too."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(text_digest(F.col("text")).alias("digest"), "text")
    long = texts.where(F.octet_length("text") >= (2 * depth.span - 1 if depth.words else depth.span))
    apart = F.min("digest") != F.max("digest")
    key = ["anchor", "cell"]
    # what is joined is a table first: its size is known, and a join can split the rows of a hot key
    with scratch(docs.sparkSession) as tables:
        cells_ = tables.table(long.mapInArrow(lambda b: anchor_rows(b, depth), CELLS))
        groups = cells_.groupBy("anchor").agg(F.sum("times").alias("n"), (F.min("cell") != F.max("cell")).alias("mixed"), *[apart.alias("apart")] * depth.apart)
        groups = tables.table(groups.where("apart" if depth.apart else "n > 1").select("anchor", "mixed"))
        shared = tables.table(cells_.join(groups, "anchor"))
        mixed = shared.where("mixed")
        kinds = mixed.groupBy(*key).agg(F.sum("times").alias("n"), apart.alias("apart"), F.min(F.struct("digest", "first", "count")).alias("one"))
        kinds = tables.table(kinds.select(*key, "apart", "one.*", (F.col("apart") if depth.apart else F.col("n") > 1).alias("settled")))
        verdicts = kinds.where("settled").select(*key, F.lit(0).cast("long").alias("start"), F.col("count").cast("long").alias("stop"))
        open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("settled").alias("all")).where("kinds > 1 and not all")
        open_ = tables.table(open_.select("anchor", (F.col("kinds") > gathered).alias("crowd")))
        if not open_.isEmpty():
            wanted = kinds.join(open_, "anchor").groupBy("digest").agg(F.collect_list(F.struct(*key, "first", "count", "settled", "apart", "crowd")).alias("wanted"))
            once = Window.partitionBy("digest").orderBy("digest")  # one copy of each text, picked before the shuffle
            single = long.withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("copy")
            held = tables.table(single.join(tables.table(wanted), "digest").mapInArrow(lambda b: cell_rows(b, depth), HELD))
            near = held.where("not crowd").repartition("anchor").sortWithinPartitions("anchor")
            verdicts = verdicts.unionByName(near.mapInArrow(lambda b: repeated_in_groups(b, depth), "anchor long, cell long, start long, stop long"))
            if not open_.where("crowd").isEmpty():
                window = ["anchor", "one", "two"]
                dealt = tables.table(held.where("crowd").mapInArrow(lambda b: window_rows(b, depth), "anchor long, cell long, digest binary, settled boolean, apart boolean, one long, two long, step int"))
                twice = dealt.groupBy(*window).agg(F.count(F.lit(1)).alias("n"), (apart | F.max("apart")).alias("apart"))
                twice = tables.table(twice.where("apart" if depth.apart else "n > 1").select(*window))
                steps = dealt.where("not settled").join(twice, window).groupBy(*key).agg(F.collect_set("step").alias("steps"))  # at most span - gram + 1
                verdicts = verdicts.unionByName(steps.select(*key, F.explode("steps").alias("start")).select(*key, F.col("start").cast("long"), (F.col("start") + 1).cast("long").alias("stop")))
        verdicts = tables.table(verdicts)
        told = mixed.select(*key, "digest", "first", "count", "times").join(verdicts, key)
        # equal cells that follow each other: one stretch if each is repeated as a whole, else one for each
        run = (F.col("start") == 0) & (F.col("stop") == F.col("count"))
        step = F.explode(F.when(run, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        told = told.select("*", step.alias("step")).select("digest", (F.col("first") + F.col("step") * F.col("count") + F.col("start")).alias("first"), F.when(run, F.col("first") + F.col("times") * F.col("count")).otherwise(F.col("first") + F.col("step") * F.col("count") + F.col("stop")).alias("last"))
        whole = shared.where("not mixed").select("digest", "first", (F.col("first") + F.col("times") * F.col("count")).alias("last"))
        spans = whole.unionByName(told).select("digest", "first", (F.col("last") + F.lit(depth.span - 1)).alias("last"))
        if depth.apart:  # copies are other texts
            copied = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            spans = spans.unionByName(copied.select("digest", F.lit(0).cast("long").alias("first"), F.lit(END).alias("last")))
        return into.table(spans)


def of_texts(*spans: DataFrame) -> DataFrame:
    """Spans of one or more depths to a row for each digest, with columns spans0, spans1 and so on of sorted arrays."""
    every = None
    for i, found in enumerate(spans):
        one = found.select("digest", F.struct("first", "last").alias("s"), F.lit(i).alias("depth"))
        every = one if every is None else every.unionByName(one)
    return cut(every.groupBy("digest").agg(*[F.array_sort(F.collect_set(F.when(F.col("depth") == i, F.col("s")))).alias(f"spans{i}") for i in range(len(spans))]))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches of sorted ones."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["first"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["last"]))
        else:
            out.append((s["first"], s["last"]))
    return out


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(raw[s:e] for s, e in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def passages(raw: bytes, spans: list[dict] | None, words: int) -> tuple[int, list[tuple[int, int]]]:
    """Words in stretches of words, and the stretches' bytes; those of a whole text have to be as long as a passage."""
    if not spans:
        return 0, []
    starts, ends = word_places(raw)
    own = [(a, min(b, len(starts))) for a, b in merged(spans)]
    own = [(a, b) for a, b in own if b - a >= words]
    return sum(b - a for a, b in own), [(int(starts[a]), int(ends[b - 1])) for a, b in own]


def judge(words: int):
    kind = T.StructType([T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in ("n_removed", "n_spans", "kept_sha256", "n_repeated_words")])

    @F.arrow_udf(kind)
    def judged(text: pa.Array, spans: pa.Array, deep: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for x, own, more in zip(text, spans, deep, strict=True):
            raw = x.as_buffer().to_pybytes() if x.is_valid else b""
            stretches = merged(own.as_py())
            for column, value in zip(out, (sum(e - s for s, e in stretches), len(stretches), hashlib.sha256(kept(raw, stretches)).hexdigest(), passages(raw, more.as_py(), words)[0] if words else 0), strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(x, pa.string() if i == 2 else pa.int64()) for i, x in enumerate(out)], list(kind.names))

    return judged


def rest(words: int = 0):
    """The text without its stretches, of bytes, or of words where their number in a passage is given."""

    @F.arrow_udf(T.StringType())
    def cut_out(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, own in zip(text, spans, strict=True):
            raw = x.as_buffer().to_pybytes() if x.is_valid and own.is_valid else b""
            stretches = passages(raw, own.as_py(), words)[1] if words else merged(own.as_py())
            out.append(x.as_py() if not stretches else kept(raw, stretches).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    return cut_out


def with_spans(docs: DataFrame, *depths: Depth, gathered: int) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), text_digest(F.col("text")).alias("own"))
    with scratch(docs.sparkSession) as tables:
        found = of_texts(*[repeats(docs, depth, gathered, tables) for depth in depths])
    return rows.join(found, rows["own"] == found["digest"], "left")


def repeated_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM, gathered: int = GATHERED, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of docs (doc_id, text).

    Removed are the bytes (UTF-8) that a string of ``span`` bytes covers which also starts anywhere else, in
    the same text or another, overlaps included; all copies go, the first too. Strings don't cross rows. A null
    text counts as empty. Copies of a text, repeated rows among them, are removed whole if they have span bytes.
    If ``words`` is given, ``n_repeated_words`` follows, the words in passages of at least so many that another row has too,
    whatever blanks are between them; nothing is removed for these. Other columns than doc_id and text are not read. Texts of any
    length are read whole, in pieces. Cells of an anchor are held equal by a 64-bit hash of anchor and bytes each,
    single windows by two 64-bit hashes beside the anchor's.
    """
    deeper = [Depth(words, min(words, WORD_GRAM), True, True)] if words else []
    full = with_spans(docs.select("doc_id", "text"), Depth(span, gram), *deeper, gathered=gathered)
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    out = full.select(F.col("row.doc_id").alias("doc_id"), size.alias("n_bytes"), judge(words)(F.col("row.text"), F.col("spans0"), F.col("spans1" if words else "spans0")).alias("j"))
    return out.select("doc_id", "n_bytes", "j.n_removed", "j.n_spans", "j.kept_sha256", *["j.n_repeated_words"] * bool(words))


def _without(docs: DataFrame, full: DataFrame, cut_out) -> DataFrame:
    """Documents that lose all their words go; those whose text is not cut stay as they are."""
    # marked so, or the filter below would evaluate it a second time, in a second worker beside each task's own
    full = full.withColumn("new_text", cut_out.asNondeterministic()(F.col("row.text"), F.col("spans0")))
    cut_ = F.col("spans0").isNotNull() & F.coalesce(F.col("new_text") != F.col("row.text"), F.lit(False))
    full = full.withColumn("cut", cut_).where(~F.col("cut") | (F.length(F.regexp_replace("new_text", r"[\x20\x09-\x0D]+", "")) > 0))
    new = {"text": F.col("new_text"), "n_chars": F.when(F.col("cut"), F.length("new_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return full.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, gathered: int = GATHERED) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars, where docs has it, following.

    Which bytes are repeated, and what holds for nulls, repeated rows and long texts, is as in ``repeated_bytes``; ties don't
    arise, as all copies go. What a cut leaves of a character goes too. Documents that lose all their words go;
    those without text stay, and an empty table stays empty. Other columns are kept, whatever their names.
    """
    return _without(docs, with_spans(docs, Depth(span, gram), gathered=gathered), rest())


def without_passages(docs: DataFrame, words: int = WORDS, gram: int = WORD_GRAM, gathered: int = GATHERED) -> DataFrame:
    """docs without the passages of at least ``words`` words that another row has too; n_chars, where docs has it, follows.

    A passage is cut in all rows that have it, from its first word to its last, whatever blanks are between them; the blanks
    around it stay. What repeats only within its own text stays. Repeated rows are others to each other. Documents that lose
    all their words go; null, empty and shorter texts stay, and an empty table stays empty. Texts of any length
    are read whole. Words are runs of other characters than the six ASCII spaces, so text without blanks holds no passage.
    """
    return _without(docs, with_spans(docs, Depth(words, min(words, gram), True, True), gathered=gathered), rest(words))
