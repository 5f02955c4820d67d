"""Collocations by external streams of phrase counts.

Counts of word runs are kept as sorted streams, never as one table in memory. A task counts as many words at a time as a
buffer holds, by sorting: words get numbers in their byte order, a run of words is one integer, and equal integers lie
together. Runs of one and two words are added up first. A run of three is only counted where both of its pairs are frequent,
since it can't be more frequent than they are; a bitmap of a fixed largest size tells which pairs may be, and a pair that
it lets through wrongly costs a row, never a result.

The frequent runs then make one stream in prefix order (first word, second, third): a run follows all runs that it begins
with. A single pass in lockstep with it gives each run the counts of its beginnings and each pair the largest count of a
run that goes on to the right. The same rows in suffix order (last word, the one before, the first) give the counts of the
endings and the largest extension to the left. Both passes deal the stream by ranges, so a word that begins a third of all
runs is spread over tasks; the only thing a range needs of those before it is the last word and the last pair, and a
task tells these of itself in one row. No count is looked up by hash.

Scores are whole numbers from decimals of 38 digits, exact for counts up to 10^14.

Defined cases: a null text is empty; a null language is ``und``, together with one of that name; empty pieces and pieces of
one word have no phrases; repeated rows count again; ties in score go to the larger count, then to the phrase that is first
in byte order; an empty table gives no rows; other columns are not read. A text is worked on in blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices

LEAST = 10
COVERED = 50
TOP = 2_000
HELD = 1 << 20
GIVEN = 1 << 15
BLOCK = 4 << 20
BITS_A_PAIR = 16
MOST_BITS = 1 << 26
#: The end of a piece is a token of its own, number 0; no word holds one of the marks.
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"." * 10)
END = b"."
MIX = (668265263, 374761393)
SPACE = re.compile(rb"[\x20\x09.]")
WAITING = 1


def token_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, lowered, and ``END`` between and after pieces; a very long text comes in several lists."""
    data = text.encode().lower().translate(ENDS)
    low = 0
    while len(data) - low > BLOCK:
        cut = SPACE.search(data, low + BLOCK)
        if not cut:
            break
        yield data[low : cut.start()].replace(END, b" . ").split()
        low = cut.start()
    yield [*data[low:].replace(END, b" . ").split(), END]


class Buffer:
    """Words of some texts, by language, until they are counted; the last two stay as the beginning of what follows."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(lambda: len(self.numbers))
        self.tokens: dict[str, list[np.ndarray]] = defaultdict(list)
        self.before: dict[str, list[bytes]] = {}
        self.held = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        self.tokens[lang].append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.held += len(words)

    def flush(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """Per language: all words, in byte order and after ``END``, and the tokens as places among them.

        The first two tokens are those before; runs that end in them were counted earlier.
        """
        tokens, self.tokens, self.held = self.tokens, defaultdict(list), 0
        early = {lang: [self.numbers[w] for w in self.before.get(lang, [END, END])] for lang in tokens}
        names = [END, *sorted(w for w in self.numbers if w != END)]
        places = {w: k for k, w in enumerate(names)}
        place = np.fromiter(map(places.__getitem__, self.numbers), np.int64, len(self.numbers))
        self.numbers.clear()
        for lang, parts in tokens.items():
            seen = place[np.concatenate([np.array(early[lang], np.int64), *parts])]
            self.before[lang] = [names[k] for k in seen[-2:]]
            yield lang, names, seen


def phrase_batch(lang: str, parts: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
    phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def spelled(names: list[bytes]) -> pa.Array:
    return pa.array([w.decode() for w in names], pa.string())


def short_runs(lang: str, names: list[bytes], seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs, in byte order, and of all words, under the empty phrase."""
    table, size, new = spelled(names), len(names), seen[2:]
    single = np.bincount(new, minlength=size)
    single[0] = 0
    held = np.flatnonzero(single)
    yield phrase_batch(lang, [pa.array([""], pa.string())], np.array([single.sum()]))
    yield phrase_batch(lang, [table.take(pa.array(held))], single[held])
    a, b = seen[1:-1], new
    inside = (a > 0) & (b > 0)
    keys, n = np.unique(a[inside] * size + b[inside], return_counts=True)
    yield phrase_batch(lang, [table.take(pa.array(k)) for k in (keys // size, keys % size)], n)


def long_runs(lang: str, names: list[bytes], seen: np.ndarray, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of runs of three words, in byte order, both of whose pairs may be frequent."""
    table, size, bits = spelled(names), len(names), len(bitmap) * 64
    crc = np.array([zlib.crc32(w) for w in names], np.int64)
    a, b = seen[:-1], seen[1:]
    spot = (crc[a] * MIX[0] + crc[b] * MIX[1] + zlib.crc32(lang.encode())) & (bits - 1)
    able = (a > 0) & (b > 0) & (bitmap[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    both = np.flatnonzero(able[:-1] & able[1:])
    keys, n = np.unique((seen[both] * size + seen[both + 1]) * size + seen[both + 2], return_counts=True)
    yield phrase_batch(lang, [table.take(pa.array(k)) for k in (keys // (size * size), keys // size % size, keys % size)], n)


def count_runs(rows: DataFrame, count) -> DataFrame:
    """lang, phrase and n from ``count`` over the words of each task, added up over tasks."""

    def run(batches):
        buffer = Buffer()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for words in token_blocks(text):
                    for low in range(0, len(words), HELD):
                        buffer.add(lang, words[low : low + HELD])
                        if buffer.held >= HELD:
                            yield from given(buffer)
        yield from given(buffer)

    def given(buffer):
        for part in buffer.flush():
            yield from slices(count(*part), GIVEN)

    found = rows.mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """A bit for each frequent pair, in words of 64; ``BITS_A_PAIR`` bits a pair, ``MOST_BITS`` in all."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_PAIR * max(pairs.count(), 1) - 1).bit_length()))
    first, second, lang = (f"crc32(encode({c}, 'utf-8'))" for c in ("split(phrase, ' ')[0]", "split(phrase, ' ')[1]", "lang"))
    spot = F.expr(f"({first} * {MIX[0]}L + {second} * {MIX[1]}L + {lang}) & {bits - 1}L")
    words = pairs.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("word")
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
    return out


def latest(n: np.ndarray, here: np.ndarray, before: int) -> np.ndarray:
    """For each row the value of the last row so far that is marked; ``before`` ahead of the first."""
    at = np.maximum.accumulate(np.where(here, np.arange(len(n)), -1))
    return np.where(at >= 0, n[at], before)


def walk(batches, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Lockstep over one range of the stream: the columns, part, one, two, most and state.

    ``one`` and ``two`` are the counts of the last word and the last pair so far, -1 where they lie in an earlier range.
    ``most`` of a word or pair is the largest count of a run of three up to the next of these. A last row of size 0 tells
    what this range leaves to the next, and, as ``most``, what it holds ahead of its first word or pair.
    """
    part = TaskContext.get().partitionId()
    word = pair = -1
    lead, held, last = 0, None, None

    def batch_of(rows, one, two, most, state=0):
        numbers = [pa.array(np.broadcast_to(x, rows.num_rows), pa.int64()) for x in (part, one, two, most, state)]
        return pa.RecordBatch.from_arrays([*(rows[c] for c in columns), *numbers], [*columns, "part", "one", "two", "most", "state"])

    for batch in batches:
        if not batch.num_rows:
            continue
        n, size = batch["n"].to_numpy(), batch["size"].to_numpy()
        one, two = latest(n, size == 1, word), latest(n, size == 2, pair)
        starts = np.flatnonzero(size < 3)
        ahead = n[: starts[0]] if len(starts) else n
        ahead = int(ahead.max()) if len(ahead) else 0
        if held:
            held[3] = max(held[3], ahead)
        else:
            lead = max(lead, ahead)
        most, give = np.zeros(len(n), np.int64), np.ones(len(n), bool)
        if len(starts):
            if held:
                yield batch_of(*held)
            most[starts] = np.maximum.reduceat(np.where(size == 3, n, 0), starts)
            # the last word or pair waits for the runs of the next batch
            wait = int(starts[-1])
            give[wait] = False
            held = [batch.slice(wait, 1), int(one[wait]), int(two[wait]), int(most[wait])]
        yield batch_of(batch.filter(pa.array(give)), one[give], two[give], most[give])
        word, pair, last = int(one[-1]), int(two[-1]), batch.slice(0, 1)
    if held:
        yield batch_of(*held, WAITING)
    if last:
        empty = last.set_column(last.schema.get_field_index("size"), "size", pa.array([0], pa.int32()))
        yield batch_of(empty, word, pair, lead, WAITING if held else 0)


def in_lockstep(stream: DataFrame, order: list[str], names: tuple[str, str, str], what: str) -> DataFrame:
    """The rows with three counts, read off one pass over the stream in the given order of languages and words.

    They are those of a run's first word and first pair, and the largest of the runs of three that begin with a pair.
    """
    columns = stream.columns
    kinds = ", ".join(f"{n} {k}" for n, k in stream.dtypes)
    dealt = stream.repartitionByRange(*order).sortWithinPartitions(*order)
    found = kept(dealt.mapInArrow(
        lambda batches: walk(batches, columns), f"{kinds}, part long, one long, two long, most long, state long"
    ), what)
    told = sorted(found.where("size = 0").select("part", "one", "two", "most", "state").collect())
    carried, word, pair = [], 0, 0
    for k, (part, one, two, _, _) in enumerate(told):
        further = 0
        for later in told[k + 1 :]:
            further = max(further, later["most"])
            if later["state"] == WAITING:
                break
        carried.append((part, word, pair, further))
        word, pair = (new if new >= 0 else old for new, old in ((one, word), (two, pair)))
    known = stream.sparkSession.createDataFrame(carried, "part long, word long, pair long, further long")
    joined = found.where("size > 0").join(F.broadcast(known), "part")
    one, two, most = names
    return joined.select(
        *columns, F.when(F.col("one") < 0, F.col("word")).otherwise(F.col("one")).alias(one),
        F.when(F.col("two") < 0, F.col("pair")).otherwise(F.col("two")).alias(two),
        F.when(F.col("state") == WAITING, F.greatest("most", "further")).otherwise(F.col("most")).alias(most),
    )


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    a, left, right = (f"CAST({x} AS DECIMAL(14, 0))" for x in (a, left, right))
    return F.expr(f"CAST(({a} * {a} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({left} * {right}) AS BIGINT)")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    rows = docs.select(
        F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text")
    )
    size = F.size(F.split("phrase", " "))
    short = kept(count_runs(rows, short_runs).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases-short")
    totals = short.where("phrase = ''").select("lang", F.col("n").alias("total"))
    frequent = short.where("phrase != ''")
    bitmap = rows.sparkSession.sparkContext.broadcast(pair_bitmap(frequent.where(size == 2)))
    long = kept(count_runs(rows, lambda *part: long_runs(*part, bitmap.value)).where(F.col("n") >= least), "phrases-long")
    word = F.split("phrase", " ")
    first = [F.coalesce(F.get(word, F.lit(k)), F.lit("")).alias(f"w{k + 1}") for k in range(3)]
    stream = frequent.unionByName(long).select("lang", "phrase", size.alias("size"), "n", *first)
    ahead = in_lockstep(stream, ["lang", "w1", "w2", "w3"], ("l1", "l2", "right"), "phrases-prefix")
    last = [F.coalesce(F.get(word, size - 1 - k), F.lit("")).alias(f"e{k + 1}") for k in range(3)]
    behind = in_lockstep(
        ahead.drop("w1", "w2", "w3").select("*", *last), ["lang", "e1", "e2", "e3"], ("r1", "r2", "left"), "phrases-suffix"
    )
    free = (F.col("size") == 3) | (100 * F.greatest("left", "right") < covered * F.col("n"))
    lead = F.when(F.col("size") == 3, score_of("n", "l2", "r1"))
    early = F.when(F.col("size") == 2, score_of("n", "l1", "r1")).otherwise(score_of("n", "l1", "r2"))
    cut = behind.where((F.col("size") > 1) & free).select(
        "lang", "phrase", F.col("n").alias("a"), "size", "l1", "l2", "r1", "r2", early.alias("s1"), lead.alias("s2")
    )
    late = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    scored = cut.select(
        "lang", "phrase", "a", F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late | (F.col("size") == 2), F.col("r1")).otherwise(F.col("r2")).alias("r"), F.when(late, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
