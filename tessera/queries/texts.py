"""Cleaning, tokens, sections and dictionary repair over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import sql_list
from tessera.operators import prompts, repair, segments, slots
from tessera.operators.ranges import numbered
from tessera.queries.registry import query
from tessera.sources import files

_STOP = sql_list(T.RANK_STOP)
_CONTENT_STOP = sql_list(T.STOPWORDS + T.UI_VERBS)
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""
  WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), u AS (SELECT doc_id, w, list_filter(w, lambda x: x NOT IN ({_STOP})) AS k FROM t)
  SELECT doc_id, len(w) AS n_tokens, len(k) AS n_kept, len(list_distinct(k)) AS n_distinct FROM u""")
def tok_stats(t):
    """Tokens of each document, with and without stop words (tokenizer with repeats)."""
    w = T.words(F.col("text"))
    kept = T.without_words(w, T.RANK_STOP)
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_kept"), F.size(F.array_distinct(kept)).cast("long").alias("n_distinct"))


@query("""
  WITH n AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(regexp_replace(text, '^ *[0-9]+[.)] *', '')), '[a-z0-9]+'), ' ') AS norm FROM conversations)
  SELECT conv_id, turn, norm, substr(sha256('v1|' || norm || '|'), 1, 16) AS key FROM n""")
def norm_key(t):
    """Normal form and exact cache key of each turn."""
    norm = T.normal(F.col("text"))
    return t.conversations.select("conv_id", "turn", norm.alias("norm"), T.short_hash(F.concat(F.lit("v1|"), norm, F.lit("|"))).alias("key"))


def _sql_scrub(column: str) -> str:
    out = column
    for pattern, by in T.SCRUB_PLAIN:
        pattern, by = pattern.replace("'", "''"), by.replace("$1", "\\1")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_sql_scrub('html')} AS clean, substr(sha256({_sql_scrub('html')}), 1, 16) AS hash FROM pages")
def scrub_pages(t):
    """Pages without markup, links and addresses, with the hash of what is left."""
    return t.pages.select("page_id", T.scrub(F.col("html"), ascii_bounds=True).alias("clean")).withColumn("hash", T.short_hash(F.col("clean")))


@query(f"SELECT doc_id, md5({_sql_scrub('text')}) AS clean_md5, length({_sql_scrub('text')}) AS n_clean FROM documents")
def scrub_docs(t):
    """Digest and length of each scrubbed document."""
    clean = T.scrub(F.col("text"), ascii_bounds=True)
    return t.documents.select("doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), F.length(clean).cast("long").alias("n_clean"))


def _sql_leaks(table: str, key: str, column: str) -> str:
    flags = " || ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{n} ' ELSE '' END" for n, p in sorted(T.LEAK_NAMES.items()))
    return f"SELECT {key}, rtrim({flags}) AS leaks FROM {table}"


@query(_sql_leaks("documents", "doc_id", "text"))
def leak_flags(t):
    """Names of leak patterns in each document."""
    return t.documents.select("doc_id", F.array_join(T.leak_names(F.col("text")), " ").alias("leaks"))


@query(_sql_leaks("pages", "page_id", "html"))
def leak_flags_pages(t):
    return t.pages.select("page_id", F.array_join(T.leak_names(F.col("html")), " ").alias("leaks"))


@query("""
  WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  k AS (SELECT doc_id, line_no, trim(line) AS line, CASE WHEN regexp_matches(trim(line), '^[^.|]{1,80}$') THEN 1 ELSE 0 END AS header FROM l WHERE trim(line) <> ''),
  s AS (SELECT *, sum(header) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM k)
  SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN header = 1 THEN line END), '') AS heading, CAST(sum(1 - header) AS BIGINT) AS n_lines,
         CAST(sum(CASE WHEN header = 0 THEN length(line) ELSE 0 END) AS BIGINT) AS n_chars
  FROM s GROUP BY doc_id, section""")
def section_split(t):
    """Sections of documents: a line without a full stop or a bar heads the lines after it."""
    lines = segments.lines(t.documents, "doc_id", "text")
    return segments.sections(lines, "doc_id", header=r"^[^.|]{1,80}$")


@query(r"""
  WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  p AS (SELECT doc_id, line_no, string_split(regexp_replace(trim(line), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM l WHERE trim(line) <> ''),
  s AS (SELECT doc_id, line_no, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM p),
  n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS no, line_no, sentence FROM s)
  SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest, min(CASE WHEN no = 1 THEN md5(sentence) END) AS first_md5 FROM n GROUP BY doc_id""")
def sentence_number(t):
    """Sentences numbered through each document: their number, the longest, and the first."""
    s = segments.sentences(segments.lines(t.documents, "doc_id", "text"), "doc_id")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).cast("long").alias("longest"), F.min(F.when(F.col("no") == 1, F.md5(F.col("sentence").cast("binary")))).alias("first_md5"))


@query(f"""
  SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*'), lambda w: w NOT IN ({_CONTENT_STOP}) AND length(w) >= 3))), ' ') AS terms
  FROM conversations""")
def content_terms(t):
    """Content terms of each turn, in alphabetical order."""
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(T.content_terms(F.col("text"))), " ").alias("terms"))


@query("""
  WITH n AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS h FROM documents)
  SELECT min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY h""".replace("\\\\", "\\"))
def exact_dedup(t):
    """The first of each group of documents that are equal but for case and white space."""
    h = F.md5(T.collapse(F.lower("text")).cast("binary"))
    return t.documents.select("doc_id", h.alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


_TURNS = f"SELECT conv_id, turn, list_distinct({_WORDS}) AS w FROM conversations"
_PAIR_J = "CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) END"


@query(f"""
  WITH c AS ({_TURNS})
  SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round({_PAIR_J}, 6) AS jaccard
  FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn""")
def jaccard_pairs(t):
    """Word-set similarity of the turns of each conversation."""
    return slots.pairs(t.conversations, "conv_id", "turn", "text")


@query(f"""
  WITH c AS ({_TURNS}), p AS (SELECT a.conv_id, {_PAIR_J} AS j FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn)
  SELECT conv_id, count(*) AS n_pairs, round(avg(j), 6) AS mean_jaccard FROM p GROUP BY conv_id""")
def mean_pairwise_jaccard(t):
    p = slots.pairs(t.conversations, "conv_id", "turn", "text", digits=None)
    return p.groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


#: Frequent words of the corpus in place of phrases, as its texts are invented: field, label, phrase, weak.
CORPUS_LEXICON = [
    ("component", "relation", "of the", 0), ("component", "relation", "of a", 0), ("component", "place", "in the", 0), ("component", "place", "on the", 0),
    ("component", "union", "and the", 0), ("component", "general", "the", 1), ("component", "general", "der", 1), ("component", "general", "la", 1),
    ("symptom", "reason", "for the", 0), ("symptom", "reason", "by the", 0), ("symptom", "state", "is", 0), ("symptom", "state", "was", 0), ("symptom", "state", "est", 0),
    ("configure", "configure", "with", 0), ("configure", "configure", "that", 0), ("configure", "configure", "que", 0),
    ("direction", "add", "to", 0), ("direction", "add", "zu", 0), ("direction", "remove", "from", 0), ("direction", "remove", "von", 0),
]
CORPUS_DENIALS = ["not ", "no ", "a ", "les ", "die "]
_LEX = ", ".join(f"('{f}', '{lab}', '{p}', {w})" for f, lab, p, w in CORPUS_LEXICON)
_DENY = " OR ".join(f"before LIKE '%{w}'" for w in CORPUS_DENIALS)
_FOUND = f"""
  lex(field, label, phrase, weak) AS (VALUES {_LEX}),
  n AS (SELECT conv_id, turn, lower(text) AS s FROM conversations),
  m AS (SELECT conv_id, turn, field, label, weak, length(phrase) AS size, length(regexp_extract(s, '(?s)^((?:.*?[^\\pL\\pN_])??)' || phrase || '(?:[^\\pL\\pN_]|$)', 1)) + 1 AS pos, s FROM n, lex WHERE regexp_matches(s, '(^|[^\\pL\\pN_])' || phrase || '([^\\pL\\pN_]|$)')),
  d AS (SELECT *, substr(s, greatest(1, pos - 14), least(pos - 1, 14)) AS before FROM m),
  k AS (SELECT * FROM d WHERE NOT ({_DENY}))"""
_SLOTS = f"""
  WITH {_FOUND},
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, field ORDER BY weak, pos, size DESC, label) AS rn FROM k),
  p AS (SELECT conv_id, turn, max(CASE WHEN field = 'component' AND rn = 1 THEN label END) AS component, max(CASE WHEN field = 'symptom' AND rn = 1 THEN label END) AS symptom,
               max(CASE WHEN field = 'configure' THEN 1 END) AS conf, count(DISTINCT CASE WHEN field = 'direction' THEN label END) AS n_dir, max(CASE WHEN field = 'direction' THEN label END) AS dir
        FROM r GROUP BY conv_id, turn)
  SELECT n.conv_id, n.turn, component, symptom, CASE WHEN conf = 1 THEN 'configure' ELSE 'fault' END AS intent, CASE WHEN conf = 1 AND n_dir = 1 THEN dir END AS direction
  FROM n LEFT JOIN p ON n.conv_id = p.conv_id AND n.turn = p.turn"""


@query(_SLOTS)
def slot_extract(t):
    """Component, symptom, intent and direction of each turn by a broadcast lexicon."""
    return slots.extract(t.conversations, ["conv_id", "turn"], "text", CORPUS_LEXICON, CORPUS_DENIALS)


@query(f"""
  WITH q AS (SELECT conv_id, turn, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}) AND length(w) >= 4), lambda w: substr(w, 1, 5))) AS stems FROM conversations),
  d AS (SELECT doc_id, list_distinct(list_transform(list_filter({_WORDS}, lambda w: w NOT IN ({_STOP}) AND length(w) >= 4), lambda w: substr(w, 1, 5))) AS stems FROM documents)
  SELECT q.conv_id, q.turn, len(q.stems) AS n_terms, coalesce(len(list_intersect(q.stems, d.stems)), 0) AS n_shared,
         CASE WHEN d.doc_id IS NULL THEN 'no_article' WHEN len(q.stems) > 0 AND len(list_intersect(q.stems, d.stems)) = 0 THEN 'no_shared_word' ELSE 'ok' END AS verdict
  FROM q LEFT JOIN d ON q.conv_id = d.doc_id""")
def mismatch_check(t):
    """Whether a turn shares a word stem with the document of the same number."""
    stems = lambda c: F.array_distinct(F.transform(F.filter(T.words(c), lambda w: ~w.isin(T.RANK_STOP) & (F.length(w) >= 4)), lambda w: T.stem(w)))
    q = t.conversations.select("conv_id", "turn", stems(F.col("text")).alias("terms"))
    d = t.documents.select("doc_id", stems(F.col("text")).alias("stems"))
    shared = F.size(F.array_intersect("terms", "stems"))
    return q.join(d, q["conv_id"] == d["doc_id"], "left").select(
        "conv_id", "turn", F.size("terms").cast("long").alias("n_terms"), F.coalesce(F.when(F.col("doc_id").isNotNull(), shared), F.lit(0)).cast("long").alias("n_shared"),
        F.when(F.col("doc_id").isNull(), "no_article").when((F.size("terms") > 0) & (shared == 0), "no_shared_word").otherwise("ok").alias("verdict"),
    )


@query("""
  WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
  known AS (SELECT word, n FROM c WHERE n >= 100 AND length(word) >= 4), rare AS (SELECT word FROM c WHERE n = 1 AND length(word) BETWEEN 5 AND 8),
  p AS (SELECT r.word, k.word AS candidate, k.n FROM rare r JOIN known k ON abs(length(r.word) - length(k.word)) <= 1 WHERE damerau_levenshtein(r.word, k.word) = 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, candidate) AS rn FROM p)
  SELECT word, candidate, n AS freq FROM o WHERE rn = 1""")
def spell_candidates(t):
    """The most frequent known word one edit away from each rare one, by an equi-join on deletions."""
    w = t.documents.select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = w.where("n >= 100 AND length(word) >= 4")
    rare = w.where("n = 1 AND length(word) BETWEEN 5 AND 8").select("word")
    return repair.corrections(rare, known)


@query()
def word_break(t):
    """Glued words cut into the likeliest frequent ones."""
    w = files.stored(t.documents.select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "counts")
    return repair.word_breaks(w.where("n = 1 AND length(word) >= 12").select("word"), w.where("n >= 100"))


@query()
def canonical_text(t):
    """Pages with entities resolved and invisible characters dropped, then scrubbed."""
    return t.pages.select("page_id", T.scrub(T.canonical(F.col("html"))).alias("clean"))


@query("""SELECT event_id, CAST(json_extract(regexp_extract('note: ' || props || ' end', '(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events""".replace("\\\\", "\\"))
def json_extract(t):
    """A number from the JSON object that stands within other text."""
    return t.events.select("event_id", F.get_json_object(T.first_json(F.concat(F.lit("note: "), F.col("props"), F.lit(" end"))), "$.k").cast("long").alias("k"))


@query("""
  WITH r AS (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id)
  SELECT conv_id, md5(prompt) AS prompt_md5, length(prompt) AS n_chars, substr(prompt, 1, 200) AS head FROM r""")
def prompt_build(t):
    """One prompt for each conversation, its turns in order."""
    turn = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("line"))
    joined = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["line"]), "\n").alias("prompt"))
    return joined.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"), F.substring("prompt", 1, 200).alias("head"))


_TURNS = r"""
  l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, line_no) AS no, 'Turn ' || turn || ' of ' || role AS section FROM l WHERE trim(line, ' ') <> ''),
  h AS (SELECT *, trim(line, ' ') AS t, CASE WHEN lag(section) OVER w IS NULL THEN '### ' || section WHEN lag(section) OVER w <> section THEN chr(10) || '### ' || section END AS head FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY no))"""


def _turn_lines(t):
    """The lines of each conversation, numbered, under turns as sections."""
    lines = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("text", F.trim("line")).where("text <> ''")
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "line_no"))
    return lines.select("conv_id", "role", no.alias("no"), F.concat(F.lit("Turn "), "turn", F.lit(" of "), "role").alias("section"), "text")


@query(rf"""WITH {_TURNS},
  p AS (SELECT conv_id, string_agg(CASE WHEN head IS NULL THEN '' ELSE head || CASE WHEN role = 'system' THEN '{prompts.UNRELATED}' ELSE '' END || chr(10) END || '[S' || no || '] ' || t, chr(10) ORDER BY no) AS text FROM h GROUP BY conv_id)
  SELECT conv_id, md5(substr(text, 1, 2000)) AS text_md5, length(substr(text, 1, 2000)) AS n_chars FROM p""")
def sentence_prompts(t):
    """Each conversation's lines under its turns, packed into 2,000 characters; the system's are marked."""
    rows = _turn_lines(t).withColumn("relevant", F.col("role") != "system")
    return prompts.sentence_prompt(rows, "conv_id", prompts.QUERY).select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(rf"""WITH {_TURNS}, u AS (SELECT *, role = 'user' AS asks, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY no) AS unit FROM h),
  p AS (SELECT conv_id, string_agg(CASE WHEN head IS NULL THEN '' ELSE head || chr(10) END || CASE WHEN asks THEN '[P' || unit || '] ' || substr(t, 1, 700) ELSE '- ' || substr(t, 1, 200) END, chr(10) ORDER BY no) AS text FROM u GROUP BY conv_id)
  SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM p""")
def paragraph_prompts(t):
    """Each conversation's paragraphs under its turns: the user's numbered, the others as context."""
    rows = _turn_lines(t)
    asks = F.col("role") == "user"
    unit = F.count_if(asks).over(Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    found = prompts.paragraph_prompt(rows.withColumn("unit", F.when(asks, unit)), "conv_id")
    return found.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS no FROM conversations WHERE role = 'user'),
  p AS (SELECT conv_id, string_agg(no || '. ' || substr(text, 1, 400) || ' (title: ' || CASE WHEN split_part(text, ' ', 1) = '' THEN '-' ELSE split_part(text, ' ', 1) END || ')', chr(10) ORDER BY no) AS text FROM n GROUP BY conv_id)
  SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM p""")
def intent_prompts(t):
    """What the user says in each conversation, as numbered intents with their first words as titles."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1
    rows = t.conversations.where("role = 'user'").select("conv_id", no.alias("no"), prompts.cut(F.col("text"), prompts.SECTION).alias("text"), F.substring_index("text", " ", 1).alias("title"))
    return prompts.intent_prompt(rows, "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(r"""SELECT doc_id, md5(CASE WHEN length(text) > 14000 THEN substr(text, 1, 14000) || chr(10) || '[article truncated]' ELSE text END) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def article_prompts(t):
    """Documents cut at 14,000 characters, packed by lines."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return prompts.article_prompt(lines, "doc_id", ["at"], "line").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT event_id, CASE WHEN value >= 1000 THEN CAST(floor(value / 1000) AS BIGINT) || 's' ELSE CAST(floor(value) AS BIGINT) || 'ms' END AS shown,
  CASE WHEN value >= 1000 THEN floor(value / 1000) ELSE floor(value) / 1000 END AS seconds FROM events""")
def duration_parse(t):
    """Durations written with units, read back as seconds."""
    v = F.floor("value")
    shown = F.when(F.col("value") >= 1000, F.concat(F.floor(F.col("value") / 1000).cast("string"), F.lit("s"))).otherwise(F.concat(v.cast("string"), F.lit("ms")))
    return t.events.select("event_id", shown.alias("shown"), F.when(F.col("value") >= 1000, T.duration_seconds(F.regexp_replace(shown, "ms$", ""))).otherwise(F.regexp_replace(shown, "ms$", "").cast("double") / 1000).alias("seconds"))


@query("""
  WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
  SELECT word, n, dense_rank() OVER (ORDER BY n DESC) AS freq_rank FROM c WHERE n >= 20""")
def word_ranks(t):
    """Frequency ranks of words, the dictionary that repair works with."""
    w = t.documents.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")
    ranks = numbered(w.select("n", (-F.col("n")).alias("less")).distinct(), "less", "freq_rank")
    return w.join(ranks, "n").select("word", "n", F.col("freq_rank").cast("long").alias("freq_rank"))
