"""Language-model scores by context-tree weighting (operator 9).

A text is its words in order and one end.  A word is spelled byte by byte and
closed by a blank; the end is a blank where a word would start.  The context of
a byte is the last six bytes of its word, with blanks before the word's first,
so a word's probability depends on the word alone and is computed once for each
distinct word of the corpus, however often it occurs.

Each byte is eight binary decisions.  A decision has a node for every context
depth from 0 to 6, and a node counts the zeros and ones that training words put
there.  Its Krichevsky-Trofimov estimate is mixed with the product of its
children's by halves, from the deepest contexts up (one grouping in Spark for
each depth); the share that its own estimate keeps is the weight with which it
answers, and the rest is passed to the next depth.  Where training has no deeper
context, the deepest one that it has answers.

While a text is read, its own words update the estimates, as they do in any
Krichevsky-Trofimov coder: after n words, a word seen k times has probability
(k + OWN * p) / (n + OWN), p being the tree's.  The product depends on the
text's word counts alone, so it is summed without regard to their order.

Counts cover all training documents, and every node answers: none is left out and
none goes to the workers.  The codes that the words to be scored ask for are in the
tree with a count of zero, which changes no estimate.  A code is its context, the
last byte first, and then its byte, so sorted codes are the tree in order: all that
lies under a context of CUT bytes is one run of codes, at most 256 ** (DEPTH - CUT + 1)
of them.  One sorted pass folds each run into the nodes of its top, Spark groups
these up to the root and hands down, by one equi-join for each depth, what every node
leaves to the deeper ones, and a second pass over the runs gives each code its
probability; another equi-join sums them over words.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.storage import Stored, materialise

DEPTH = 6
CUT = 4  # bytes of context that part the tree into runs
RUNS = 1 << 18  # codes of the runs that are folded together
HEAD, HEAD_BYTES = 1 << 16, 64  # most frequent words, which the workers know, and the longest of them
FLUSH, FLUSH_BYTES = 200_000, 1 << 24  # distinct words that a task holds while counting, and their bytes
BLANK = 0x20
OWN = 300.0  # words that the tree counts for beside the text's own

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D, A-Z in lower case."""
    return text.translate(_LOWER).split()


def training(id_col: str = "doc_id") -> Column:
    """Rows to learn from: all but a fifth, chosen by the id; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c``: every word of ``docs`` (text, learn) with its count in the rows to learn from."""

    def run(batches):
        counts: Counter = Counter()
        others: set[bytes] = set()

        def flush():
            rest = others - counts.keys()
            words = [*counts, *rest]
            n = np.zeros(len(words), np.int64)
            n[: len(counts)] = np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            others.clear()
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000])], ["word", "c"])

        held = 0
        for part in slices(batches, "text"):
            for learn, text in zip(part.column("learn").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                (counts if learn else others).update(words_of(text))
            held += part.column("text").nbytes  # words that recur are counted too often: a flush comes early, at worst
            if len(counts) + len(others) > FLUSH or held > FLUSH_BYTES and max(map(len, [*counts, *others])) > FLUSH_BYTES / FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return docs.select("text", "learn").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (context of DEPTH bytes, the last one first, then the byte) of each word's
    bytes and closing blank; and where each word's codes start."""
    words = pa.array(words, pa.binary()) if not isinstance(words, pa.Array) else words
    _, offsets, values = words.buffers()
    off = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    begin = np.concatenate(([0], np.cumsum(size + DEPTH + 1)))[:-1]  # of each word's blanks
    stream = np.full(int((size + DEPTH + 1).sum()), BLANK, np.int64)
    inside = np.repeat(begin + DEPTH - (off[:-1] - off[0]), size) + np.arange(len(data))
    stream[inside] = data
    place = np.repeat(begin + DEPTH - np.concatenate(([0], np.cumsum(size + 1)))[:-1], size + 1) + np.arange(int((size + 1).sum()))
    code = stream[place].copy()
    for k in range(1, DEPTH + 1):
        code |= stream[place - k] << (8 * (DEPTH + 1 - k))
    return code, np.concatenate(([0], np.cumsum(size + 1)))[:-1]


def _spelled(words: DataFrame) -> DataFrame:
    """``code, n``: how often training words put a byte after a context; 0 where only other words do.

    A code has a row for each batch of words that has it.
    """

    def run(batches):
        for b in batches:
            if b.num_rows:
                code, starts = spell(b.column("word"))
                n = np.repeat(b.column("c").to_numpy(), np.diff(np.append(starts, len(code))))
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                edges = np.flatnonzero(np.diff(code, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(code[edges]), pa.array(np.add.reduceat(n, edges))], ["code", "n"])

    return words.select("word", "c").mapInArrow(run, "code long, n long")


def _log_gamma(x, log=F.log):
    """ln(gamma(x)) for x >= 1/2, by Stirling's series six steps up; of a Column, or of numbers with numpy's log."""
    y = x + 6
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(steps)


def _estimate(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = zeros.cast("double"), ones.cast("double")
    return F.when(a + b > 0, _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - math.log(math.pi) - _log_gamma(a + b + 1)).otherwise(0.0)


class Level:
    """The nodes of one depth under some runs: ``key`` (context and decision, in order), ``zeros, ones``,
    ``mixed`` (ln of the mixed estimate) and ``stay``, the weight that stays at the node."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        a, b = zeros + 0.5, ones + 0.5
        own = np.where(zeros + ones > 0, _log_gamma(a, np.log) + _log_gamma(b, np.log) - math.log(math.pi) - _log_gamma(a + b, np.log), 0.0)
        self.mixed = own if below is None else math.log(0.5) + np.logaddexp(own, below)
        self.stay = np.ones(len(key)) if below is None else np.exp(math.log(0.5) + own - self.mixed)

    def up(self) -> np.ndarray:
        """Keys of the parents: the farthest byte of the context goes."""
        return ((self.key >> 16) << 8) | (self.key & 255)

    def parents(self) -> Level:
        up = self.up()
        order = np.argsort(up, kind="stable")
        first = np.flatnonzero(np.diff(up[order], prepend=-1))
        return Level(up[order][first], *(np.add.reduceat(x[order], first) for x in (self.zeros, self.ones, self.mixed)))


def leaves(code: np.ndarray, n: np.ndarray) -> Level:
    """The deepest level, from codes in order and their counts: eight decisions for each byte."""
    keys, zeros, ones = [], [], []
    for k in range(8):  # decision k of a byte: 1 and its first k bits name the node, the next bit is decided
        head = code >> (8 - k)
        first = np.flatnonzero(np.diff(head, prepend=-1))
        h = head[first]
        one = np.add.reduceat(n * ((code >> (7 - k)) & 1), first)
        keys.append(((h >> k) << 8) | (1 << k) | (h & ((1 << k) - 1)))
        ones.append(one)
        zeros.append(np.add.reduceat(n, first) - one)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return Level(key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order], None)


def under_cut(code: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels from the deepest up to that of contexts of CUT bytes."""
    out = [leaves(code, n)]
    for _ in range(DEPTH - CUT):
        out.append(out[-1].parents())
    return out


def log_probabilities(code: np.ndarray, levels: list[Level], p: np.ndarray, rest: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """log10 of the probability of each code, given what the nodes of the top level have settled
    (``p``), leave to deeper ones (``rest``) and would answer alone (``answer``)."""
    for above, level in zip(levels[::-1], levels[-2::-1]):
        at = np.searchsorted(above.key, level.up())
        n = level.zeros + level.ones
        one = (level.ones + 0.5) / (n + 1)
        p, rest, answer = p[at] + rest[at] * level.stay * one, rest[at] * (1 - level.stay), answer[at]
        answer = np.where(n > 0, p + rest * one, answer)
    total = np.zeros(len(code))
    for k in range(8):
        head = code >> (8 - k)
        at = np.searchsorted(levels[0].key, ((head >> k) << 8) | (1 << k) | (head & ((1 << k) - 1)))
        total += np.log10(np.clip(np.where((code >> (7 - k)) & 1 == 1, answer[at], 1 - answer[at]), 1e-12, 1.0))
    return total


def _runs(batches, names: list[str]):
    """Arrays of the columns ``names`` (the first one in order, with the context of CUT bytes), cut between
    runs, about RUNS rows at a time; a longer run, which the key bounds, is not cut."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        count += b.num_rows
        if count >= RUNS:
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield [x[:cut] for x in rows]
            held, count = [[x[cut:] for x in rows]], len(rows[0]) - cut
    if count:
        yield [np.concatenate(x) for x in zip(*held)]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, of codes in order, and their counts."""
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first)


def _top(codes: DataFrame) -> DataFrame:
    """``ctx, node, zeros, ones, mixed, stay``: the nodes of contexts of CUT bytes, from codes (cut, code, n)."""

    def run(batches):
        for _, code, n in _runs(batches, ["cut", "code", "n"]):
            level = under_cut(*_summed(code, n))[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.key >> 8, (level.key & 255).astype(np.int32), level.zeros, level.ones, level.mixed, level.stay)], ["ctx", "node", "zeros", "ones", "mixed", "stay"])

    return codes.repartition("cut").sortWithinPartitions("cut", "code").mapInArrow(run, "ctx long, node int, zeros long, ones long, mixed double, stay double")


def levels(top: DataFrame) -> list[Stored]:
    """Written tables of the nodes of depths 0 to CUT, as of :func:`_top`."""
    level, out = top, []
    for depth in range(CUT, -1, -1):
        if depth < CUT:
            level = level.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("below"))
            level = level.withColumn("own", _estimate(F.col("zeros"), F.col("ones")))
            high = F.greatest("own", "below")
            level = level.withColumn("mixed", math.log(0.5) + high + F.log1p(F.exp(F.least("own", "below") - high))).withColumn("stay", F.exp(math.log(0.5) + F.col("own") - F.col("mixed"))).drop("below", "own")
        out.insert(0, materialise(level, f"ctw-{depth}"))
        level = out[0].df
    return out


def log_codes(words: DataFrame) -> Stored:
    """``code, lp``: log10 of the probability of each code of ``words`` (word, c): of its byte after its context."""
    codes = materialise(_spelled(words).withColumn("cut", F.shiftright("code", 8 * (DEPTH - CUT + 1))), "lm-spelled")
    tree = levels(_top(codes.df))
    n = F.col("zeros") + F.col("ones")
    one = (F.col("ones") + 0.5) / (n + 1)
    above = None
    for depth, level in enumerate(tree):
        if above is None:
            rows = level.df.withColumns({"p0": F.lit(0.0), "rest0": F.lit(1.0), "answer0": F.lit(0.5)})
        else:
            up = above.select(F.col("ctx").alias("up"), F.col("node").alias("up_node"), F.col("p").alias("p0"), F.col("rest").alias("rest0"), F.col("answer").alias("answer0"))
            up = F.broadcast(up) if depth <= 2 else up  # 255 decisions after each of no more than 256 bytes
            rows = level.df.join(up, (F.shiftright("ctx", 8) == F.col("up")) & (F.col("node") == F.col("up_node")))
        p, rest = F.col("p0") + F.col("rest0") * F.col("stay") * one, F.col("rest0") * (1 - F.col("stay"))
        above = rows.select("ctx", "node", p.alias("p"), rest.alias("rest"), F.when(n > 0, p + rest * one).otherwise(F.col("answer0")).alias("answer"))
    none = F.lit(None).cast("double")
    given = above.select(F.col("ctx").alias("cut"), F.lit(0).alias("kind"), F.col("node").cast("long").alias("code"), F.lit(0).cast("long").alias("n"), "p", "rest", "answer")
    asked = codes.df.select("cut", F.lit(1).alias("kind"), "code", "n", none.alias("p"), none.alias("rest"), none.alias("answer"))

    def run(batches):
        for _, kind, code, n, p, rest, answer in _runs(batches, ["cut", "kind", "code", "n", "p", "rest", "answer"]):
            top = kind == 0  # the same nodes in the same order as the codes give
            code, n = _summed(code[~top], n[~top])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(log_probabilities(code, under_cut(code, n), p[top], rest[top], answer[top]))], ["code", "lp"])

    out = materialise(given.unionAll(asked).repartition("cut").sortWithinPartitions("cut", "kind", "code").mapInArrow(run, "code long, lp double"), "lm-codes")
    for x in (codes, *tree):
        x.drop()
    return out


def log_words(words: DataFrame) -> Stored:
    """``word, c, lp`` for ``words`` (id, word, c): log10 of the probability of each, its closing blank included."""
    codes = log_codes(words)

    def run(batches):
        for b in batches:
            if b.num_rows:
                code, starts = spell(b.column("word"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").to_numpy(), np.diff(np.append(starts, len(code))))), pa.array(code)], ["id", "code"])

    sums = words.select("id", "word").mapInArrow(run, "id long, code long").join(codes.df, "code").groupBy("id").agg(F.sum("lp").alias("lp"))
    out = materialise(words.join(sums, "id").select("word", "c", "lp"), "lm-scored")
    codes.drop()
    return out


LN10 = math.log(10)


def drawn(k: int, lp: float) -> float:
    """log10 of the product of (j + OWN * p) for j from 0 to k - 1, p = 10 ** lp."""
    own = OWN * 10.0**lp
    return math.log10(OWN) + lp + ((math.lgamma(k + own) - math.lgamma(1 + own)) / LN10 if k > 1 else 0.0)


def _drawn(k: Column, lp: Column) -> Column:
    """The same as a Column."""
    own = OWN * F.pow(F.lit(10.0), lp)
    return math.log10(OWN) + lp + F.when(k > 1, (_log_gamma(k + own) - _log_gamma(1 + own)) / LN10).otherwise(0.0)


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """About the ``most`` most frequent rows of ``words``, no more: all with a count above a cut that a histogram gives."""
    step = F.floor(F.log2(F.col("c")) * 16)
    sizes = words.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()  # a few hundred steps
    least, total = None, 0
    for s, k in sorted(((r.step, r.k) for r in sizes), reverse=True):
        total += k
        if total > most:
            break
        least = s
    return words.where("c > 0").where(step >= least) if least is not None else words.limit(0)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every text, learned from the training rows of ``docs``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``.  A null or empty text is one end.  A null id is
    passed on and learned from.  Repeated rows count and are scored each for
    themselves.  Other columns are left out.  Without training rows every
    decision is even.  ``bits_per_byte`` is the code length over the text's
    words with their closing blanks.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), training(id_col).alias("learn"))
    words = materialise(count_words(base).withColumn("id", F.monotonically_increasing_id()), "lm-words")
    rows = base.groupBy("learn").count().collect()
    ends = sum(r["count"] for r in rows if r["learn"])
    got = words.df.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train = (got.n or 0) + ends
    v_train = (got.v or 0) + (ends > 0)
    end_word = spark.createDataFrame([(bytearray(b""), ends, -1)], "word binary, c long, id long")
    scored = log_words(words.df.unionAll(end_word))
    words.drop()
    head = {bytes(r.word): (r.c, r.lp) for r in most_frequent(scored.df.where(F.length("word") <= HEAD_BYTES), HEAD).collect()}
    end = scored.df.where(F.length("word") == 0).first()
    share = spark.sparkContext.broadcast(head)
    end_c, end_lp = end.c, end.lp

    def sums(batches):
        known = share.value
        names = ["row", "doc_id", "learn", "tokens", "known", "logs", "lp", "bytes", "word", "k"]
        for part in slices(batches, "text", 1 << 19):
            out: list[list] = [[] for _ in names]
            for row, doc, learn, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("learn").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                found = Counter(words_of(text))
                tokens, hits, logs, lp, size = 1, int(end_c > 0), math.log10(end_c + 0.5), drawn(1, end_lp), 1
                for w, k in found.items():
                    tokens += k
                    size += k * (len(w) + 1)
                    if w in known:
                        c, p = known[w]
                        hits += k if c else 0
                        logs += k * math.log10(c + 0.5)
                        lp += drawn(k, p)
                    else:
                        for o, x in zip(out, (row, None, None, 0, 0, 0.0, 0.0, 0, w, k)):
                            o.append(x)
                lp -= (math.lgamma(tokens + OWN) - math.lgamma(OWN)) / LN10
                # no word has a blank, so the document's own row meets none
                for o, x in zip(out, (row, doc, learn, tokens, hits, logs, lp, size, b" %d" % row, 0)):
                    o.append(x)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names)

    found = base.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "learn", "text").mapInArrow(sums, "row long, doc_id long, learn boolean, tokens long, known long, logs double, lp double, bytes long, word binary, k long")
    table = scored.df.select("word", "c", F.col("lp").alias("word_lp"))
    joined = found.join(table, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    per_text = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("learn").alias("learn"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("k")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("k") * F.log10(c + 0.5)).alias("logs"),
        F.sum(F.col("lp") + F.when(F.col("word_lp").isNotNull(), _drawn(F.col("k"), F.col("word_lp"))).otherwise(F.lit(0.0))).alias("score"),
        F.sum("bytes").alias("bytes"),
    )
    out = per_text.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n_train + 0.5 * (v_train + 1)))).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("bytes")).alias("bits_per_byte"),
    )
    answer = materialise(out, "lm-answer")
    scored.drop()
    return answer.df
