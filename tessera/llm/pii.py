"""Personal data by bootstrapped contextual extraction (operator 1).

One pass over the texts finds the base entities (email, ip, card, phone) and all
*candidates*: tokens with a digit or an at sign, and runs of digit groups with
what separates them.  Each has three lexical patterns: the words before it, the one
before with the one after, and its own shape (digits counted, letters not, a country
code left off).  Patterns and instances (candidate strings) form a bipartite graph.  Base entities are the seeds; in each
round Spark scores a pattern by the share of its distinct instances that are
known to be of one kind, weighted by the logarithm of their number, and an
instance by the patterns of that kind that it occurs in.  Confident patterns make
their other instances known, those help to score further patterns, and when a round
makes nothing known any more candidates with a confident pattern are spans of its kind.

What is known stays known with its kind, so a pattern's share only grows, and as it
has to pass a half no pattern changes its kind: the rounds end by themselves, in the
same place whatever the order of rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.storage import Stored, materialise

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 100  # more are an error, never a result that has not settled
LEAST_SEEDS = 5  # distinct known instances that a pattern needs
LEAST_SHARE = 0.6  # of a pattern's distinct instances
LEAST_CONTEXT = 3  # letters that a context has at least
LEAST_ITEM = 4  # characters of a candidate: shorter ones tell nobody apart
WHOLE_ITEM = 64  # longer candidates, and longer shapes, are known by their digest

# The base patterns. Runs of digits are atomic: a match that
# starts inside one would go on the same way.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT_OR_AT = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"[\s,;\"'<>()\[\]{}|]")
_BEFORE = re.compile(r"(\w+)\W*(?:(\w+)\W*)?$")
_AFTER = re.compile(r"\W*(\w+)")
_RUN = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().\-/]{1,2}[0-9]++)+")
_COUNTRY = re.compile(r"^\+?[0-9]{1,3}[ .\-]+(?=[(0-9])")
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
CONTEXT_CHARS = 64  # on either side that the words of a context are taken from
PATTERNS = 1 << 17  # confident patterns that a broadcast may hold


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from their at signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base entities as (kind, start, end) in code points, by kind and then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """Lexical patterns of a place: the two words before it, and the one before with the one after."""
    m = _BEFORE.search(text[max(0, start - CONTEXT_CHARS) : start])
    left = [w.lower() for w in m.groups() if w] if m else []
    m = _AFTER.match(text[end : end + CONTEXT_CHARS])
    right = m.group(1).lower() if m else ""
    return " ".join(left) + " _", (left[-1] if left else "") + " _ " + right


def shape(item: str) -> str:
    """A candidate's form: its digits counted, letters not, a leading country code left off; a long form by its digest."""
    bare = _COUNTRY.sub("", item) if item.startswith("+") else item
    form = _LETTERS.sub("a", _DIGITS.sub(lambda m: f"9{len(m.group())}", bare))
    return "= " + (form if len(form) <= WHOLE_ITEM else hashlib.sha256(form.encode()).hexdigest())


def named(item: str) -> str:
    """What an instance is known by: itself in small letters, or a digest if it is long."""
    return item.lower() if len(item) <= WHOLE_ITEM else hashlib.sha256(item.lower().encode()).hexdigest()


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Identifier-like strings: base entities with their kind, runs of digit groups, and other tokens with a digit or an at sign.

    Such tokens have ``LEAST_ITEM`` characters or more, and no upper limit.
    """
    out, taken = [], []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not taken or start >= taken[-1][1]:
            taken.append((start, end))
            out.append((start, end, kind))
    at, k = 0, 0
    while m := _DIGIT_OR_AT.search(text, at):
        place = m.start()
        while k < len(taken) and taken[k][1] <= place:
            k += 1
        if k < len(taken) and taken[k][0] <= place:
            at = taken[k][1]
            continue
        stop = taken[k][0] if k < len(taken) else len(text)
        start = place
        while start > at and text[start - 1] in "+(" and place - start < 2:
            start -= 1
        run = _RUN.match(text, start, stop)
        if run and not (start and text[start - 1].isalnum()) and not text[run.end() : run.end() + 1].isalnum():
            out.append((start, run.end(), ""))
            at = run.end()
            continue
        start = place
        while start > at and not _TOKEN_END.match(text, start - 1):
            start -= 1
        m = _TOKEN_END.search(text, place)
        end = m.start() if m else len(text)
        if k < len(taken):
            end = min(end, taken[k][0])
        at = max(end, place + 1)
        token = text[start:end].rstrip(".:!?")
        if len(token) >= LEAST_ITEM:
            out.append((start, start + len(token), ""))
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("item", pa.string()), ("left", pa.string()), ("both", pa.string()), ("shape", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """``row, doc_id, base, seen``: entities and candidates of every text, without the texts.

    ``row`` numbers the rows of the table, so that repeated ids stay apart.
    """
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            base, seen = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                rows = []
                for s, e, kind in candidates(text, spans):
                    left, both = context(text, s, e)
                    rows.append({"start": s, "end": e, "kind": kind, "item": named(text[s:e]), "left": left, "both": both, "shape": shape(text[s:e])})
                seen.append(rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, _FOUND), pa.array(seen, _SEEN)], ["doc_id", "base", "seen"])

    kind = "doc_id long, base array<struct<kind:string,start:long,end:long>>, seen array<struct<start:long,end:long,kind:string,item:string,left:string,both:string,shape:string>>"
    return materialise(only.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "pii-scan")


def learn(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind, share``: confident patterns, by rounds over the pattern-instance graph until nothing new is known.

    A pattern is confident with ``LEAST_SEEDS`` distinct known instances of one
    kind and ``LEAST_SHARE`` of all its instances; contexts have ``LEAST_CONTEXT``
    letters or more.  An instance that is a base entity of two kinds counts as the
    first by name; one for which patterns of two kinds speak is of the kind with the
    greater sum of share times the logarithm of known instances.  Without
    candidates there are no patterns.  ``RuntimeError`` if more than ``rounds`` were needed.
    """
    seen = scanned.select(F.explode("seen").alias("s")).select("s.*")
    edges = materialise(
        seen.select("item", "kind", F.explode(F.array("left", "both", "shape")).alias("pattern")).where(F.col("pattern").startswith("= ") | (F.length(F.regexp_replace("pattern", r"[\W_]", "")) >= LEAST_CONTEXT)).groupBy("pattern", "item").agg(F.max("kind").alias("kind")),
        "pii-graph",
    )
    graph = edges.df.select("pattern", "item")
    # one kind for each instance, so that a pattern counts it once
    known = [materialise(edges.df.where("kind <> ''").groupBy("item").agg(F.min("kind").alias("kind")), "pii-known")]
    patterns = None
    for _ in range(rounds):
        labels = reduce(DataFrame.unionAll, [x.df for x in known])
        counts = graph.join(labels, "item", "left").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        total = Window.partitionBy("pattern")
        best = (
            counts.withColumn("all", F.sum("n").over(total)).where("kind IS NOT NULL").withColumn("share", F.col("n") / F.col("all"))
            .where((F.col("n") >= LEAST_SEEDS) & (F.col("share") >= LEAST_SHARE)).select("pattern", "kind", "share", F.log2("n").alias("weight"))
        )
        before, patterns = patterns, materialise(best, "pii-patterns")
        if before is not None:
            before.drop()
        # an instance is known once confident patterns speak for it
        scores = graph.join(patterns.df, "pattern").join(labels.select("item"), "item", "left_anti").groupBy("item", "kind").agg(F.sum(F.col("share") * F.col("weight")).alias("score"))
        known.append(materialise(scores.groupBy("item").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), "pii-known"))
        if known[-1].df.isEmpty():
            break
    else:
        raise RuntimeError(f"patterns have not settled in {rounds} rounds")
    for x in (edges, *known):
        x.drop()
    return patterns.df


def _joined(spans) -> F.Column:
    """Spans (rank, start, end, kind) as kind:start:end, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Entities of every text: ``row, doc_id, spans`` with spans (rank, start, end, kind, source).

    Base entities come from their patterns (``source`` base); the others are
    candidates with a confident context or shape (``source`` learned), of
    ``LEAST_ITEM`` characters or more.  Null and empty texts
    have none.  Ids are passed on as they are; a repeated row is a row of its
    own; other columns are left out; an empty table gives an empty result.  Offsets
    count code points.  Texts of any length are searched whole.
    """
    scanned = scan(docs, id_col, text_col).df
    rank = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    patterns = learn(scanned, rounds)
    span = lambda s, kind, source: F.struct(F.element_at(rank, kind).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.lit(source).alias("source"))
    base = F.transform("base", lambda s: span(s, s["kind"], "base"))
    if patterns.isEmpty():
        return scanned.select("row", "doc_id", base.alias("spans"))
    places = scanned.select("row", F.explode("seen").alias("s")).where("s.kind = ''").select("row", "s.start", "s.end", F.explode(F.array("s.left", "s.both", "s.shape")).alias("pattern"))
    more = (
        places.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("share", "kind")).alias("kind"))
        .groupBy("row").agg(F.collect_list(F.struct(F.element_at(rank, F.col("kind")).alias("rank"), "start", "end", "kind", F.lit("learned").alias("source"))).alias("more"))
    )
    return scanned.select("row", "doc_id", base.alias("base")).join(more, "row", "left").select("row", "doc_id", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned`` from :func:`find`."""
    base = F.filter("spans", lambda s: s["source"] == "base")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_learned"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest holds."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:  # the rest of a span that reaches beyond the one before
            at = end
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, id_col: str = "doc_id", most: int = PATTERNS) -> DataFrame:
    """``docs`` with every entity masked; ``n_chars``, if there is one, counts the new text.

    Patterns are learned first and then applied in one pass, so that no text
    moves; they are few (each needs ``LEAST_SEEDS`` known instances and
    ``LEAST_SHARE`` of all) and go to the workers as a broadcast.  If there are more
    than ``PATTERNS``, which a broadcast shouldn't hold, the learned spans come by
    joins instead, and texts are sorted by their digest to meet them.  Null texts
    stay null; columns of any name pass through.
    """
    scanned = scan(docs, id_col, text_col)
    patterns = learn(scanned.df, rounds)
    names, kind = docs.columns, docs.schema
    at = names.index(text_col)
    scanned.drop()
    chars = names.index("n_chars") if "n_chars" in names else None
    rows = patterns.select("pattern", "share", "kind").limit(most + 1).collect()
    if len(rows) > most:
        return _masked_by_join(docs, text_col, patterns, names, kind, at, chars)
    learned = {r.pattern: (r.share, r.kind) for r in rows}
    share = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        known = share.value

        def spans_of(text):
            spans = base_spans(text)
            own = [(s, e, k) for k, s, e in spans]
            if known:
                for s, e, k in candidates(text, spans):
                    hit = max((known[p] for p in (*context(text, s, e), shape(text[s:e])) if p in known), default=None) if not k else None
                    if hit:
                        own.append((s, e, hit[1]))
            return own

        for batch in batches:
            renamed = batch.rename_columns([f"c{k}" for k in range(len(names))])
            for part in slices([renamed], f"c{at}"):
                texts = [masked(t, spans_of(t)) if t else t for t in part.column(at).to_pylist()]
                yield _with_texts(part, texts, at, chars, names)

    return docs.mapInArrow(run, kind)


def _with_texts(part: pa.RecordBatch, texts: list, at: int, chars: int | None, names: list[str]) -> pa.RecordBatch:
    """A slice of rows with other texts, and their sizes where the table has them."""
    columns = list(part.columns[: len(names)])
    columns[at] = pa.array(texts, pa.string())
    if chars is not None:
        columns[chars] = pa.array([None if t is None else len(t) for t in texts]).cast(columns[chars].type)
    return pa.RecordBatch.from_arrays(columns, names)


def _masked_by_join(docs: DataFrame, text_col: str, patterns: DataFrame, names: list[str], kind, at: int, chars: int | None) -> DataFrame:
    """:func:`mask` with any number of patterns: spans are joined to texts by the texts' digests."""
    digest_ = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    texts = docs.select(digest_.alias("digest"), F.col(text_col).alias("text")).where("text <> ''")

    def places(batches):
        for part in slices(batches, "text"):
            out: list[list] = [[], [], [], []]
            for d, text in zip(part.column("digest").to_pylist(), part.column("text").to_pylist()):
                for s, e, k in candidates(text, base_spans(text)):
                    if not k:
                        for p in (*context(text, s, e), shape(text[s:e])):
                            for o, x in zip(out, (d, s, e, p)):
                                o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["digest", "start", "end", "pattern"])

    met = texts.mapInArrow(places, "digest string, start long, end long, pattern string").join(patterns, "pattern")
    best = met.groupBy("digest", "start", "end").agg(F.max_by("kind", F.struct("share", "kind")).alias("kind"))
    spans = materialise(best.groupBy("digest").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans")), "pii-spans").df
    # columns by place, so that none of the table's clashes
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], digest_.alias("digest"))
    joined = keyed.join(spans, "digest", "left").select(*[f"c{k}" for k in range(len(names))], "spans")

    def run(batches):
        for part in slices(batches, f"c{at}"):
            out = []
            for text, found in zip(part.column(at).to_pylist(), part.column("spans").to_pylist()):
                own = [(s, e, k) for k, s, e in base_spans(text)] if text else []
                out.append(masked(text, own + [(x["start"], x["end"], x["kind"]) for x in found or ()]) if text else text)
            yield _with_texts(part, out, at, chars, names)

    return joined.mapInArrow(run, kind)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, as :func:`digest` gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
