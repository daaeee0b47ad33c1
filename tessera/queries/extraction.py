"""From texts to steps: flags, instructions, cleaned steps, repair of words, sections, and the small rules around them."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T
from tessera.functions.lexicon import GENERAL_FIX, GENERIC, sql_list
from tessera.operators import plans as P
from tessera.operators import completion, expansion, repair, segments, slots, unglue
from tessera.operators import requests as Q
from tessera.operators.ranges import numbered
from tessera.queries.registry import Tables, query
from tessera.queries.texts import CORPUS_DENIALS, CORPUS_LEXICON, _FOUND, _sql_scrub
from tessera.sources import files

_SENT = r"""
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  p AS (SELECT doc_id, line_no, string_split(regexp_replace(trim(line), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM l WHERE trim(line) <> ''),
  s AS (SELECT doc_id, line_no, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM p)"""
def _sql_words(pattern: str) -> str:
    """A pattern for DuckDB, whose word boundaries know ASCII letters only."""
    before = re.sub(r"\\b(?=[a-z(])", lambda _: r"(?:^|[^\pL\pN_])", pattern)
    return before.replace(r"\b", r"(?:[^\pL\pN_]|$)").replace("'", "''")


_FLAG_SQL = ", ".join(f"count(*) FILTER (WHERE regexp_matches(sentence, '{_sql_words(p)}')) AS {n}" for n, p in S.FLAGS.items())


@query(f"WITH {_SENT} SELECT doc_id, {_FLAG_SQL} FROM s GROUP BY doc_id")
def sentence_flags(t):
    """How many sentences of each document are notes, continuations, lists of methods, ..."""
    rows = segments.sentences(segments.lines(t.documents, "doc_id", "text"), "doc_id").select("doc_id", S.flags(F.col("sentence")).alias("f"))
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col(f"f.{n}")).alias(n) for n in S.FLAGS])


#: Frequent words in place of verbs, as the corpus is invented.
_VERBS = ["the", "and", "is", "of", "in", "der", "die", "la", "le", "de", "to", "on"]
_Q = lambda p: p.replace("'", "''")


def _sql_bare(column: str) -> str:
    out = f"trim({column})"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, '{_Q(S.LEAD_IN)}', ''), '{_Q(S.MODAL)}', '')"
    return out


def _sql_opens(column: str) -> str:
    return f"lower(regexp_extract(regexp_replace({column}, '{S.ADVERB}', ''), '^([A-Za-z''\\-]+)', 1)) IN ({sql_list(_VERBS)})"


_CAP = lambda c: f"(upper(substr({c}, 1, 1)) || substr({c}, 2))"
_CUT = lambda k: rf"(?s)^((?:[^,]*,\s*){{{k}}})(.*)$"
_INSTRUCT = f"""
  x AS (SELECT doc_id, line_no, 0 AS part, trim(line) AS line, trim(line) AS own FROM l WHERE trim(line) <> ''
        UNION ALL SELECT doc_id, line_no, 1, trim(line), regexp_extract(trim(line), '(?i)^[^:.]{{2,60}}:\\s+(.+)$', 1) FROM l WHERE regexp_matches(trim(line), '(?i)^[^:.]{{2,60}}:\\s+(.+)$') AND NOT regexp_matches(trim(line), '(?i)^note\\b')),
  y AS (SELECT *, {_sql_bare("own")} AS body, regexp_extract(own, '({_Q(S.MEANINGFUL)})', 1) AS lead FROM x WHERE NOT regexp_matches(own, '{_Q(S.INTRODUCES)}')),
  z AS (SELECT *, {", ".join(f"regexp_extract(body, '{_CUT(k)}', 1) AS h{k}, {_sql_bare(f"regexp_extract(body, '{_CUT(k)}', 2)")} AS r{k}" for k in (1, 2, 3))} FROM y),
  i AS (SELECT *, CASE WHEN body <> '' AND {_sql_opens("body")} THEN CASE WHEN lead <> '' THEN {_CAP("lead")} || body ELSE {_CAP("body")} END
        {" ".join(f"WHEN regexp_matches(body, '{_Q(S.CONDITION)}') AND h{k} <> '' AND length(h{k}) <= 160 AND r{k} <> '' AND {_sql_opens(f'r{k}')} THEN {_CAP(f'h{k}')} || r{k}" for k in (1, 2, 3))} END AS step FROM z),
  g AS (SELECT doc_id, line_no, any_value(line) AS line, max(CASE WHEN part = 0 THEN step END) AS plain, bool_or(part = 1 AND step IS NOT NULL) AS labelled FROM i GROUP BY doc_id, line_no),
  j AS (SELECT doc_id, line_no, CASE WHEN labelled THEN line ELSE plain END AS step FROM g),
  c AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(step, '\\.+$', ''), '{S.CLAUSES}'), lambda p: trim(p, ' .')), lambda p: p <> '') AS parts FROM j WHERE step IS NOT NULL),
  v AS (SELECT doc_id, line_no, parts, unnest(parts) AS part FROM c), w AS (SELECT doc_id, line_no, bool_and({_sql_opens(_sql_bare("part"))}) AS every FROM v GROUP BY doc_id, line_no)"""


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), {_INSTRUCT}
  SELECT c.doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN len(parts) > 1 AND every THEN len(parts) ELSE 1 END) AS BIGINT) AS n_steps, CAST(sum(length(step)) AS BIGINT) AS n_chars FROM c JOIN w USING (doc_id, line_no) GROUP BY c.doc_id""")
def instruction_steps(t):
    """Lines of each document that instruct, and the steps in them."""
    rows = segments.lines(t.documents, "doc_id", "text").select("doc_id", S.instruction(F.col("line"), _VERBS).alias("step"), S.steps(F.col("line"), _VERBS).alias("steps")).where("step IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size("steps")).alias("n_steps"), F.sum(F.length("step")).alias("n_chars"))


_CLEAN = f"trim(regexp_replace(regexp_replace(trim(regexp_replace({_sql_scrub('text')}, '[ \\t\\r\\n]+', ' ', 'g')), '{S.NUMBERING}', ''), '[\\s,;:]+$', ''))"


@query(f"""WITH c AS (SELECT conv_id, turn, {_CLEAN} AS s FROM (SELECT conv_id, turn, (turn + 1) || '. ' || text AS text FROM conversations))
  SELECT conv_id, turn, CASE WHEN s = '' THEN s ELSE regexp_replace(regexp_replace(upper(substr(s, 1, 1)) || substr(s, 2), '[!?]$', ''), '[ .]+$', '') || '.' END AS step FROM c""")
def clean_steps(t):
    """Turns written as numbered steps, cleaned."""
    numbered = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "text")
    return t.conversations.select("conv_id", "turn", S.clean_step(numbered).alias("step"))


@query(f"WITH {_FOUND}, w AS (SELECT conv_id, turn, string_agg(DISTINCT label, ',' ORDER BY label) AS components FROM k WHERE field = 'component' AND weak = 0 GROUP BY ALL) SELECT n.conv_id, n.turn, coalesce(components, '') AS components FROM n LEFT JOIN w ON n.conv_id = w.conv_id AND n.turn = w.turn")
def named_components(t):
    """All parts that a turn names, denied mentions and weak ones left out."""
    return slots.named(t.conversations, ["conv_id", "turn"], "text", CORPUS_LEXICON, CORPUS_DENIALS).select("conv_id", "turn", F.array_join("components", ",").alias("components"))


_MENTION = ", ".join(f"('{lab}', '{p}')" for f, lab, p, _ in CORPUS_LEXICON if f == "component")


@query(f"""WITH lex(label, phrase) AS (VALUES {_MENTION}), n AS (SELECT conv_id, turn, lower(text) AS s FROM conversations),
  w AS (SELECT conv_id, turn, string_agg(DISTINCT label, ',' ORDER BY label) AS components FROM n, lex WHERE regexp_matches(s, '(^|[^\\pL\\pN_])' || phrase || '(?:s|es)?([^\\pL\\pN_]|$)') GROUP BY ALL)
  SELECT n.conv_id, n.turn, coalesce(components, '') AS components FROM n LEFT JOIN w ON n.conv_id = w.conv_id AND n.turn = w.turn""")
def mentioned_components(t):
    """All parts that a turn mentions, plurals included."""
    return slots.mentions(t.conversations, ["conv_id", "turn"], "text", CORPUS_LEXICON).select("conv_id", "turn", F.array_join("components", ",").alias("components"))


_DROP = sql_list(T.STOPWORDS + T.UI_VERBS + GENERIC)
_TOKENS = "list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*'), lambda w: trim(w, '''-'))"


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ({_DROP}) AND w NOT IN ({sql_list(GENERAL_FIX)})))), ' ') AS words,
  array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({_DROP})))), ' ') AS letters FROM conversations""")
def distinctive_words(t):
    """Words of each turn that could say what is wrong."""
    show = lambda c: F.array_join(F.array_sort(c), " ")
    return t.conversations.select("conv_id", "turn", show(slots.distinctive(F.col("text"))).alias("words"), show(slots.alphabetic(F.col("text"))).alias("letters"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN NULL WHEN event_id % 3 = 0 THEN 'mismatch' WHEN event_id % 5 = 0 THEN 'unreadable' WHEN event_id % 2 = 0 AND user_id % 2 = 0 THEN 'no_grounded_fix' ELSE 'rules_only' END AS reason,
  CASE WHEN event_id % 4 <> 0 THEN NULL WHEN event_id % 3 = 0 THEN 'The article is about another problem.' WHEN event_id % 5 = 0 THEN 'The question holds no word that could be recognised.' WHEN user_id % 2 = 0 THEN 'The article holds no step that answers the question.' ELSE 'No model was free; rules found nothing to answer with.' END AS said,
  CASE event_type WHEN 'click' THEN event_id % 2 = 0 WHEN 'error' THEN event_id % 3 = 0 ELSE false END AS refused FROM events""")
def empty_reasons(t):
    """Why an answer is empty and what is said then; and whether an article is turned away."""
    e = F.col("event_id")
    why = slots.empty_reason((e % 4).cast("int"), e % 3 == 0, e % 5 != 0, F.col("user_id") % 2 == 0)
    verdict = F.when(F.col("event_type") == "click", "unrelated").when(F.col("event_type") != "error", "related")
    path = F.when(e % 2 == 0, "no_shared_word")
    absent = F.when(e % 3 == 0, F.array(F.lit("screen"))).otherwise(F.array().cast("array<string>"))
    return t.events.select("event_id", why.alias("reason"), slots.message(why).alias("said"), slots.turned_away(verdict, path, absent).alias("refused"))


@query(f"""WITH f AS (SELECT conv_id, turn, list_filter(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*'), lambda w: w NOT IN ({sql_list(T.STOPWORDS + T.UI_VERBS)}) AND length(w) >= 3), lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS w FROM conversations),
  d AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i)[1:2] AS two FROM f)
  SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND turn % 2 = 0 THEN 'Screen ' || CASE turn % 4 WHEN 0 THEN 'flickering' ELSE 'black' END WHEN turn % 3 <> 0 THEN 'Screen issue'
    WHEN len(two) = 2 THEN upper(substr(two[1], 1, 1)) || substr(two[1], 2) || ' ' || two[2] ELSE 'Device issue' END AS title FROM d""")
def rules_titles(t):
    """Titles from slots, else from the first content terms of a turn."""
    n = F.col("turn")
    component, symptom = F.when(n % 3 != 0, "screen"), F.when(n % 4 == 0, "flicker").when(n % 4 == 2, "black")
    return t.conversations.select("conv_id", "turn", S.rules_title(component, symptom, F.col("text")).alias("title"))


@query(f"""
  WITH k AS (SELECT conv_id, turn, role, list_concat(list_filter(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*'), lambda w: w NOT IN ({sql_list(T.STOPWORDS + T.UI_VERBS)}) AND length(w) >= 3 AND w NOT IN ('samsung','galaxy','phone','tablet','mobile','device','new')), lambda x: true) , ['phone', 'issue', 'problem', 'device']) AS w FROM conversations),
  d AS (SELECT conv_id, turn, role, list_filter(w[1:-5], lambda x, i: list_position(w, x) = i) || w[-4:] AS w FROM k),
  v(no, said) AS (VALUES (0,'{{0}} {{1}} {{2}} {{3}} {{4}}'),(1,'{{0}} {{1}} fix'),(2,'Why is my {{0}} {{1}}?'),(3,'How can I repair a {{1}} {{0}} on my Galaxy?'),(4,'Help, my {{0}} keeps being {{1}}!'),(5,'Samsung {{0}} problem: {{0}}, {{1}}'),(6,'I am experiencing an issue where the device {{0}} is {{1}}.'),
    (7,'ugh {{0}} {{1}} again, so annoying'),(8,'{{t0}} {{t1}} {{t0}} not wroking'),(9,'What causes {{0}} and {{2}} on a Galaxy?'),(10,'Troubleshooting a {{1}} {{0}}'),(11,'{{0}} {{1}} after update, what should I do')),
  y AS (SELECT conv_id, turn, role, w, list_transform([w[1], w[2]], lambda x: CASE {" ".join(f"WHEN contains(x, '{a}') THEN regexp_replace(x, '{a}', '{b}')" for a, b in (("ea", "ae"), ("en", "ne"), ("in", "ni"), ("er", "re"), ("on", "no"), ("ck", "kc")))} WHEN length(x) > 4 THEN x[1:length(x) - 1] ELSE x END) AS t FROM d)
  SELECT conv_id, turn, CAST(no AS INTEGER) AS no, trim(replace(replace(replace(replace(replace(replace(replace(said, '{{0}}', w[1]), '{{1}}', w[2]), '{{2}}', w[3]), '{{3}}', w[4]), '{{4}}', coalesce(w[5], '')), '{{t0}}', t[1]), '{{t1}}', t[2])) AS text FROM y, v""")
def template_variants(t):
    """Rewordings of every turn by templates, from its own words."""
    none = F.lit(None).cast("string")
    return t.conversations.select("conv_id", "turn", F.explode(P.variants(none, none, F.col("text"))).alias("v")).select("conv_id", "turn", "v.no", "v.text")


_RANKED = """
  w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
  k AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM c WHERE n >= 100)"""


def _ranked(t):
    """``word, n`` of all words, and the list of the frequent ones by rank, 0 being the most frequent."""
    c = files.stored(t.documents.select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    order = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.col("word"))
    ranks = numbered(c.where("n >= 100").select("word", order.alias("o")), "o", "rank").select("word", (F.col("rank") - 1).alias("rank"))
    return c, files.stored(ranks, "ranks")


@query(f"""
  WITH {_RANKED}
  SELECT c.word, least(a.rank, b.rank, d.rank) AS rank FROM c LEFT JOIN k a ON a.word = c.word AND length(c.word) >= 3
  LEFT JOIN k b ON b.word = substr(c.word, 1, length(c.word) - 1) AND length(c.word) >= 4 LEFT JOIN k d ON d.word = substr(c.word, 1, length(c.word) - 2) AND length(c.word) >= 5""")
def known_ranks(t):
    """The best rank of each word, of it without its last letter, or without two, in the corpus's own list."""
    c, ranks = _ranked(t)
    return repair.word_ranks(c.select("word"), ranks)


@query()
def unglued_turns(t):
    """Turns whose blanks between small letters were lost, with what the repair puts back."""
    _, ranks = _ranked(t)
    torn = t.conversations.select("conv_id", "turn", "role", F.regexp_replace("text", "(?<=[a-z]) (?=[a-z])", "").alias("text"))
    frequent = ranks.where("rank < 50").select("word")
    return unglue.unglued(torn, ["conv_id", "turn", "role"], "text", ranks, frequent)


@query()
def corrected_spelling(t):
    """Words of the corpus that occur once, put right by its own words: the least common tier is the dictionary."""
    c, ranks = _ranked(t)
    tier = F.when(F.col("rank") < 20, 0).when(F.col("rank") < 60, 1).otherwise(2)
    return repair.corrected_words(c.where("n = 1").select("word"), ranks.select("word", tier.alias("tier"), F.col("rank").cast("int").alias("rank")), 150)


@query("""
  WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 100),
  f AS (SELECT DISTINCT c.word || e AS word FROM c, (VALUES (''), ('s'), ('ed'), ('ing'), ('d')) v(e)) SELECT length(word) AS size, count(*) AS n FROM f GROUP BY 1""")
def inflected_words(t):
    """Known words with their endings, by length."""
    c = t.documents.select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 100")
    return repair.inflected(c).groupBy(F.length("word").cast("long").alias("size")).agg(F.count("*").alias("n"))


@query("""
  WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{16,}')) AS word FROM documents), c AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 100),
  g AS (SELECT doc_id, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM c) GROUP BY doc_id) SELECT d.doc_id, coalesce(n >= 3, false) AS glued FROM documents d LEFT JOIN g USING (doc_id)""")
def glued_texts(t):
    """Documents that have lost their spaces, by long runs of letters that are no known words."""
    c = t.documents.select(F.explode(T.words(F.col("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 100")
    return repair.glued(t.documents, ["doc_id"], "text", c)


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace('screen.' || upper(substr(role, 1, 1)) || substr(role, 2) || ' is,then', '([a-z][a-z])([.,])([A-Za-z][a-z])', '\1\2 \3', 'g')
  ELSE 'screen. ' || upper(substr(role, 1, 1)) || substr(role, 2) || ' is,then' END AS text FROM conversations""")
def lost_spaces(t):
    """Spaces after punctuation put back, in glued texts after every mark."""
    text = F.concat(F.lit("screen."), F.initcap("role"), F.lit(" is,then"))
    return t.conversations.select("conv_id", "turn", repair.spaced(text, F.col("turn") % 2 == 0).alias("text"))


def _sql_word(column: str, word: str, by: str) -> str:
    once = lambda c: f"regexp_replace({c}, '(^|[^A-Za-z''0-9])[{word[0].upper()}{word[0]}]{word[1:]}($|[^A-Za-z''0-9])', '\\1{by}\\2', 'g')"
    return once(once(column))  # neighbours share what stands between them


@query(f"SELECT conv_id, turn, {_sql_word(_sql_word('text', 'les', 'LES'), 'the', 'THE')} AS text FROM conversations")
def text_rewrite(t):
    """Texts with listed words put right."""
    fixes = t.spark.createDataFrame([("les", "LES"), ("the", "THE")], "word string, candidate string")
    return repair.rewritten(t.conversations, ["conv_id", "turn"], "text", fixes)


@query("""
  WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS head, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)
  SELECT doc_id, md5(trim(CASE WHEN body = '' THEN head || ' ' ELSE head || ' ' || substr(body, 1, 400) END)) AS text_md5 FROM d""")
def section_texts(t):
    """What a document is compared by if its first line is its heading."""
    head = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", F.md5(segments.section_text(head, F.substr("text", F.length(head) + 2)).cast("binary")).alias("text_md5"))


@query("""WITH m AS (SELECT p_partkey, 'Phones ' || p_type || ' ' || p_name AS head FROM part)
  SELECT p_partkey, p_name AS title, 'Do this first.' AS intro, '# ' || p_type AS rest FROM part JOIN m USING (p_partkey)""")
def preambles(t):
    """Titles, introductions and articles behind breadcrumbs."""
    text = F.concat(F.lit("Phones "), "p_type", F.lit(" "), "p_name", F.lit(" ( Phones"), "p_type", F.lit(" ): Do this first.\n# "), "p_type")
    parts = t.part.repartition(2 * t.spark.sparkContext.defaultParallelism)  # a small file is one task, however many rows it has
    return parts.select("p_partkey", segments.preamble(text).alias("p")).select("p_partkey", "p.title", "p.intro", "p.rest")


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS n_words, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]*'), lambda w: regexp_matches(w, '[a-z]') AND (w IN (""" + sql_list(T.STOPWORDS + T.UI_VERBS) + """) OR w IN ('est', 'der', 'las')))) > 0 AS readable FROM conversations""")
def readable_queries(t):
    """Words of any script, and whether a turn holds one that a reader would know."""
    return t.conversations.select("conv_id", "turn", F.size(T.unicode_words(F.col("text"))).cast("long").alias("n_words"), T.recognisable(F.col("text"), F.lit("est der las")).alias("readable"))


@query("""SELECT conv_id, count(*) AS n, sum(CASE WHEN first THEN 1 ELSE 0 END) AS leaders FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS first FROM conversations) GROUP BY conv_id""")
def single_flight(t):
    """Requests that compute an answer, one for each role of a conversation."""
    return Q.single_flight(t.conversations.withColumn("k", F.concat_ws("|", "conv_id", "role")), "k", ["turn"]).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.col("leader").cast("long")).alias("leaders"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 AND value <= 50 THEN 'first' WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN CASE WHEN value <= greatest(60, 50) THEN 'first' ELSE 'second' END
  WHEN event_id % 3 <> 0 THEN 'first' WHEN event_id % 5 <> 0 THEN 'second' END AS winner FROM events""")
def model_race(t):
    """Who wins of two models, the first preferred for 50 ms, the second ready after 60."""
    e = F.col("event_id")
    return t.events.select("event_id", Q.race(F.col("value"), e % 3 != 0, F.lit(60.0), e % 5 != 0, 50.0).alias("winner"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
  SELECT event_type, count(*) FILTER (WHERE epoch_us(now) - epoch_us(ts) < 3600000000) AS requests, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE epoch_us(now) - epoch_us(ts) < 3600000000), 0) AS BIGINT) AS tokens,
         max(CASE WHEN value > 100 THEN epoch_us(ts) + 600000000 END) > max(epoch_us(now)) AS cooling FROM events, m GROUP BY event_type""")
def quota_status(t):
    """Requests and tokens of the last hour and whether a pause is on, by type."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    now = rows.agg(F.max("ts").alias("now"))
    until = F.when(F.col("value") > 100, F.timestamp_micros(F.unix_micros("ts") + 600_000_000))
    return Q.quota_status(rows.crossJoin(F.broadcast(now)).withColumn("tokens", F.floor("value").cast("long")).withColumn("until", until), "event_type", F.col("now"), 3600)


@query("""SELECT event_id, CASE WHEN event_id % 10 > 7 THEN 'requests' WHEN value > 100 THEN 'tokens' WHEN event_id % 4 = 0 THEN 'header' END AS refused_by FROM events""")
def quota_admission(t):
    """The first limit that a request runs into."""
    left = F.when(F.col("event_id") % 4 == 0, 0).when(F.col("event_id") % 4 == 1, 5)
    return Q.admission(t.events, F.col("event_id") % 10, F.col("value"), 7, 100, left).select("event_id", "refused_by")


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def log_lines(t):
    """One compact JSON object for each request."""
    return files.log_lines(t.events, "event_id", "event_type")


@query("""WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first, event_id) AS INTEGER) AS place FROM f""")
def group_order(t):
    """Events of each user by type, types in the order in which they first came."""
    return P.by_first(t.events, "user_id", "event_type", "event_id").select("event_id", "place")


@query("""SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'factory reset' WHEN user_id % 7 = 1 THEN 'safe mode' WHEN user_id % 7 = 2 THEN 'restart' END AS kind, CASE user_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS rank FROM events""")
def disruption_ranks(t):
    """Critical kinds and ranks of actions whose headlines and texts name them."""
    k = F.col("user_id") % 7
    head = F.when(k == 0, "Perform a Factory Data Reset after the restart").when(k == 1, "Restart in Safe mode").when(k == 2, "Force restart the phone").when(k == 3, "Contact a service center").when(k == 4, "Sign out of the account").otherwise("Check things")
    text = F.when(k == 5, "Run diagnostics in the app and clear the cache").otherwise("Restart the email app")
    return t.events.select("event_id", P.critical_kind(head).alias("kind"), P.disruption(head, text).alias("rank"))


@query("""
  WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 5 ELSE turn % 3 END AS rank, turn % 4 AS critical, CASE WHEN turn % 5 <> 0 THEN 100 - turn END AS position FROM conversations)
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY rank, CASE WHEN rank = 5 THEN critical ELSE -1 END, coalesce(position, 1000000), turn) AS INTEGER) AS place FROM a""")
def action_order(t):
    """Actions from the least to the most disruptive, then by kind, article and input."""
    n = F.col("turn")
    a = t.conversations.select("conv_id", "turn", F.when(n % 3 == 0, 5).otherwise(n % 3).alias("rank"), (n % 4).alias("critical"), F.when(n % 5 != 0, 100 - n).alias("position"))
    return P.action_order(a, "conv_id", "rank", "critical", "position", "turn").select("conv_id", "turn", "place")


@query("""
  WITH g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (turn * 37 % 11) DESC, turn) AS rn, (turn * 37 % 11) / 10.0 AS q, (turn * 17 % 10) / 10.0 AS b, turn % 3 AS w FROM conversations), h AS (SELECT *, max(CASE WHEN rn = 1 THEN turn END) OVER (PARTITION BY conv_id) AS best FROM g)
  SELECT conv_id, turn, CASE WHEN turn <> best AND (b >= 0.8 OR (q < 0.7 AND CASE WHEN w = 0 THEN 0.0 ELSE 0.5 END < 0.34)) THEN best ELSE turn END AS target FROM h""")
def unstated_goals(t):
    """Goals that the complaint doesn't state, folded into the one nearest to it."""
    n = F.col("turn")
    words = F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return P.stated_goals(t.conversations, "conv_id", "turn", (n * 37 % 11) / 10.0, (n * 17 % 10) / 10.0, F.lit(0.5), words).select("conv_id", "turn", "target")


@query("""
  WITH s AS (SELECT conv_id, turn, turn % 4 <> 3 AS numbered, CASE WHEN turn % 3 = 0 THEN turn % 2 END AS goal, (turn % 5) / 4.0 AS rel FROM conversations), n AS (SELECT * FROM s WHERE numbered),
  v AS (SELECT conv_id, goal, count(*) AS v FROM n WHERE goal IS NOT NULL GROUP BY ALL), b AS (SELECT conv_id, sum(v) AS followed, arg_min(goal, -v * 10 + goal) AS goal FROM v GROUP BY conv_id), k AS (SELECT conv_id, count(*) AS size FROM n GROUP BY conv_id),
  c AS (SELECT n.conv_id, n.turn, b.goal, row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS place FROM n JOIN b USING (conv_id) JOIN k USING (conv_id) WHERE size >= 3 AND followed >= 2 AND rel >= 0.5 AND n.goal IS NULL)
  SELECT conv_id, turn, goal FROM c WHERE place <= 2""")
def procedure_completion(t):
    """Numbered sections that a plan skipped and should have, where it follows the procedure and has ten actions already."""
    n = F.col("turn")
    s = t.conversations.select("conv_id", "turn", (n % 4 != 3).alias("numbered"), F.when(n % 3 == 0, n % 2).alias("cited_goal"), ((n % 5) / 4.0).alias("relevance"), F.lit(1).alias("n_steps"), F.lit(10).alias("goal_actions"))
    return P.completed(s, "conv_id", "turn")


@query("""
  WITH s AS (SELECT conv_id, turn, (turn * 7 % 10) / 10.0 AS rel, turn % 3 = 1 AS relevant, turn % 4 AS n FROM conversations),
  w AS (SELECT *, max(rel) OVER (PARTITION BY conv_id) >= 0.55 AS about, max(CASE WHEN relevant THEN n ELSE 0 END) OVER (PARTITION BY conv_id) > 0 AS any_ FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rel DESC, turn) AS rn FROM w WHERE about AND n > 0 AND (relevant OR NOT any_)) SELECT conv_id, turn FROM r WHERE rn <= 2""")
def rules_sections(t):
    """The two most relevant sections of each article that instruct, if the article is about the question."""
    n = F.col("turn")
    s = t.conversations.select("conv_id", "turn", ((n * 7 % 10) / 10.0).alias("relevance"), (n % 3 == 1).alias("relevant"), (n % 4).alias("n_steps"))
    return P.section_actions(s, "conv_id", "turn", 0.55, 2).select("conv_id", "turn")


@query("""SELECT event_id, event_id % 4 IN (1, 3) OR (event_id % 4 = 2 AND event_id % 3 = 0 AND event_id % 5 <> 0) AS grounded,
  CASE WHEN event_id % 4 IN (1, 3) THEN NULL WHEN event_id % 4 = 0 THEN 'unknown_source' WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN NULL WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'below_threshold_and_no_shared_term' WHEN event_id % 3 <> 0 THEN 'below_threshold' ELSE 'no_shared_term' END AS reasons FROM events""")
def grounding_reasons(t):
    """Whether a step is grounded, and why not."""
    e = F.col("event_id")
    g = P.grounding(e % 4 != 0, e % 4 != 2, F.when(e % 3 == 0, 0.8).otherwise(0.5), F.when(e % 5 == 0, 0).otherwise(2))
    return t.events.select("event_id", g["grounded"].alias("grounded"), g["reasons"].alias("reasons"))


@query("""
  WITH n AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'intro' ELSE (turn % 5 + 1) || '. ' || CASE turn % 5 WHEN 0 THEN 'Check for Physical Damage' WHEN 1 THEN 'Adjust Screen Rotation' WHEN 2 THEN 'Restart the device' ELSE 'Update Software' END END AS heading FROM conversations),
  m AS (SELECT conv_id, count(DISTINCT heading) AS k FROM n WHERE heading <> 'intro' GROUP BY conv_id)
  SELECT n.conv_id, n.turn FROM n JOIN m USING (conv_id) WHERE k >= 3 AND turn % 5 IN (0, 2, 3)""")
def general_fix_units(t):
    """Paragraphs of numbered sections that any problem can use."""
    k = F.col("turn") % 5
    head = F.when(k == 4, "intro").otherwise(F.concat((k + 1).cast("string"), F.lit(". "), F.when(k == 0, "Check for Physical Damage").when(k == 1, "Adjust Screen Rotation").when(k == 2, "Restart the device").otherwise("Update Software")))
    u = t.conversations.select("conv_id", "turn", head.alias("heading"))
    return P.general_units(u, u.select("conv_id", "heading").distinct(), "conv_id").select("conv_id", "turn")


@query("""
  WITH n AS (SELECT conv_id, turn, turn % 5 AS k FROM conversations), m AS (SELECT conv_id, count(DISTINCT k) FILTER (WHERE k <> 4) AS numbered, count(DISTINCT k) FILTER (WHERE k IN (1, 2)) AS met FROM n GROUP BY conv_id)
  SELECT n.conv_id, n.turn FROM n JOIN m USING (conv_id) WHERE numbered >= 3 AND met >= 2 AND k IN (1, 2)""")
def followed_step_units(t):
    """Paragraphs of the numbered sections that a plan cites, where it follows the procedure."""
    k = F.col("turn") % 5
    head = F.when(k == 4, "intro").otherwise(F.concat((k + 1).cast("string"), F.lit(". Step")))
    u = t.conversations.select("conv_id", "turn", head.alias("heading"), F.lit(None).cast("string").alias("heading_step"))
    return P.followed_units(u, u.select("conv_id", "heading"), u.where((k == 1) | (k == 2) | (k == 4)).select("conv_id", "heading"), "conv_id").select("conv_id", "turn")


@query("""
  WITH p AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(trim(line), '^[A-Z]') GROUP BY doc_id) SELECT doc_id, n AS n_units FROM p""")
def paragraph_units(t):
    """Paragraphs that instruct, numbered through each document; lines that begin with a capital stand for those."""
    rows = segments.lines(t.documents, "doc_id", "text").select("doc_id", F.lit(1).alias("section"), F.col("line_no").alias("paragraph"), F.col("line_no").alias("no"), F.lit("Heading").alias("heading"), F.col("line").rlike("^[A-Z]").alias("instructs"))
    return P.paragraph_units(rows, "doc_id", "section", "paragraph", "no").groupBy("doc_id").agg(F.count("*").alias("n_units"))


@query("""SELECT conv_id, CAST(turn AS INTEGER) AS goal, 0 AS action, 'p' || turn AS problem, CASE WHEN turn = 0 THEN 'Display' ELSE 'Other' END AS domain, CASE WHEN turn % 2 = 0 THEN 'open' END AS verb, 'S1,S' || turn AS ids FROM conversations WHERE turn IN (0, 2)""")
def answer_actions(t):
    """A model's JSON answers as rows: unknown ids, verbs and domains brought to order, goals after the third dropped."""
    n = F.col("turn")
    action = F.struct(F.lit(" Name  x ").alias("name"), F.when(n % 2 == 0, "open").otherwise("fly").alias("intent_verb"), F.lit("Settings > A").alias("screen_path"), F.when(n == 1, F.array(F.lit("S9"))).otherwise(F.array(F.lit("S1"), F.concat(F.lit("S"), n), F.lit("S9"), F.lit("S1"))).alias("src_ids"))
    goal = F.struct(F.concat(F.lit("p"), n).alias("problem"), F.when(n == 0, "Display").otherwise("Cooking").alias("domain"), F.array(action).alias("actions"))
    answers = t.conversations.select("conv_id", F.struct("turn", goal.alias("g")).alias("x")).groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["g"]).alias("goals"))).alias("answer"))
    allowed = F.array(*[F.lit(f"S{i}") for i in (0, 1, 2)])
    rows = P.answer_actions(answers.withColumn("allowed", allowed), "conv_id", "answer", "allowed", ["open", "enable"], ["Display", "Battery"])
    return rows.select("conv_id", "goal", "action", "problem", "domain", "verb", F.array_join("ids", ",").alias("ids"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Settings > ' || p_name END AS path FROM part""")
def screen_in_section(t):
    """Screen paths whose leaf the section mentions."""
    section = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Here is the "), "p_name")).otherwise("nothing of it")
    return t.part.select("p_partkey", P.on_section(F.concat(F.lit("Settings > "), "p_name"), section).alias("path"))


def conversation_plans(t: Tables):
    """Each conversation as an article: a turn is a section, a line a paragraph; and a plan that took the ends of its turns.

    An action for each turn that instructs cites the first instruction of its first paragraph
    and, from three such paragraphs on, the last one of its last; speakers are the goals.
    """
    lines = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    cut = F.split(F.regexp_replace("line", r"([.!?])\s+([A-Z])", "$1\u0001$2"), "\u0001")
    parts = lines.select("conv_id", "turn", "role", "line_no", F.posexplode(cut).alias("p", "text"))
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "line_no", "p"))
    rows = parts.withColumn("no", no).withColumn("section", F.concat_ws(" ", F.lit("Turn"), F.col("turn").cast("string"), F.lit("of"), "role")).withColumn("instructs", S.is_instruction(F.col("text"), _VERBS))
    rows = files.stored(rows, "sentences")
    units = P.paragraph_units(rows.withColumn("heading", F.col("section")), "conv_id", "section", "line_no", "no")
    units = files.stored(units.select("conv_id", "unit", "heading", "ids", "instructing", "heading_step"), "units")
    ends = units.groupBy("conv_id", F.col("heading").alias("section")).agg(F.min(F.get("instructing", F.lit(0))).alias("first"), F.when(F.count("*") >= 3, F.max(F.array_max("instructing"))).alias("last"))
    met = ends.join(rows.select("conv_id", "section", F.col("no").alias("first"), "turn", "role", "text"), ["conv_id", "section", "first"])
    actions = met.select("conv_id", F.col("first").alias("pos"), S.imperative_name(F.col("text")).alias("name"), F.when(F.col("role") == "user", 0).otherwise(1).alias("goal"))
    own = met.select("conv_id", F.col("first").alias("pos"), F.explode(F.array_compact(F.array("first", "last"))).alias("no")).join(rows.select("conv_id", "no", "text"), ["conv_id", "no"])
    steps = own.select("conv_id", "pos", F.col("no").alias("at"), "text", F.array("no").alias("ids"))
    chosen = units.select("conv_id", "unit", F.col("unit").alias("rank"), F.when(F.size("ids") > 1, F.col("heading")).alias("name"))
    return rows.select("conv_id", "no", "section", "text"), units, chosen, files.stored(actions, "actions"), files.stored(steps, "steps")


@query()
def finished_procedures(t):
    """The same plans' chosen sentences with the start and the end of their procedures, cut where they hold two fixes.

    An action is taken to be about what the sentence after its first one is about.
    """
    sentences, _, _, actions, steps = conversation_plans(t)
    chosen = steps.groupBy("conv_id", "pos").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    after = sentences.select("conv_id", (F.col("no") - 1).cast("int").alias("pos"), F.concat(F.lit("Settings > "), F.get(T.content_terms(F.col("text")), F.lit(0))).alias("path"))
    rows = actions.join(chosen, ["conv_id", "pos"]).join(after, ["conv_id", "pos"], "left")
    told = sentences.withColumn("instructs", S.is_instruction(F.col("text"), _VERBS))
    return expansion.finished(rows, told, "conv_id").select("conv_id", "pos", "part", F.array_join("ids", ",").alias("ids"))


@query()
def completed_paragraphs(t):
    """Plans over conversations, completed by the paragraphs that they left out or took in part."""
    return completion.completed_plans(*conversation_plans(t), "conv_id", verbs=_VERBS).select("conv_id", "place", "at", "name", "goal", "text", "added")


_HIT = "list_filter(r.kept, lambda k: len(list_intersect(k.ids, t.ids)) > 0 AND len(list_intersect(k.ids, t.ids)) >= 0.5 * least(len(k.ids), len(t.ids)))[1]"


@query(f"""
  WITH RECURSIVE t AS (SELECT conv_id, turn, list_distinct([turn % 3, turn % 4, turn % 2 + 5]) AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  r AS (
    SELECT conv_id, turn, n, [{{'no': turn, 'ids': ids}}] AS kept, turn AS head FROM t WHERE n = 1
    UNION ALL
    SELECT t.conv_id, t.turn, t.n, CASE WHEN {_HIT} IS NULL THEN list_append(r.kept, {{'no': t.turn, 'ids': t.ids}}) ELSE list_transform(r.kept, lambda k: CASE WHEN k.no = {_HIT}.no THEN {{'no': k.no, 'ids': list_distinct(list_concat(k.ids, t.ids))}} ELSE k END) END,
      CASE WHEN {_HIT} IS NULL THEN t.turn WHEN len(list_filter(t.ids, lambda x: NOT list_contains({_HIT}.ids, x))) > 0 THEN {_HIT}.no END
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
  SELECT conv_id, turn, head FROM r""")
def merged_overlaps(t):
    """Actions that cite the same sentences, merged or dropped."""
    ids = F.array_distinct(F.array(F.col("turn") % 3, F.col("turn") % 4, F.col("turn") % 2 + 5))
    return P.merged_overlaps(t.conversations.select("conv_id", "turn", ids.alias("ids")), "conv_id", "turn", "ids")


@query()
def compiled_actions(t):
    """Actions of one screen or name merged, and their goals nested."""
    n = F.col("turn")
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("Name "), n % 4).alias("name"), F.when(n % 3 == 0, "auto").otherwise("manual").alias("category"), F.when(n % 2 == 0, "Settings > A").alias("screen"), F.lit("E1").alias("entry"), F.array("role", F.lit("")).alias("steps"))
    return P.compiled_actions(rows, "conv_id", "turn")


@query()
def expanded_ids(t):
    """Chosen sentences of each document, and those that belong with them."""
    s = segments.sentences(segments.lines(t.documents, "doc_id", "text"), "doc_id")
    rows = s.select("doc_id", "no", F.col("line_no").alias("section"), F.col("sentence").alias("text"), (F.col("no") % 5 == 0).alias("chosen"), S.is_instruction(F.col("sentence"), _VERBS).alias("instructs"))
    return P.expanded_ids(rows, "doc_id", "no", "section", "text")


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3""")
def worst_sources(t):
    """The three sources with the most documents: a report."""
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query("""
  WITH r AS (SELECT l_orderkey, l_returnflag, avg(l_discount * 10) AS rel, max(l_tax * 10) AS top FROM lineitem GROUP BY ALL), o AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag <> 'N' THEN rel END) AS mean, max(top) AS top FROM r GROUP BY l_orderkey)
  SELECT l_orderkey, round(coalesce(mean, top), 6) AS relevance FROM o""")
def intent_relevance(t):
    """Relevance of an intent: the mean of its actions', else that of its best section."""
    r = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.avg(F.col("l_discount") * 10).alias("rel"), F.max(F.col("l_tax") * 10).alias("top"))
    o = r.groupBy("l_orderkey").agg(F.avg(F.when(F.col("l_returnflag") != "N", F.col("rel"))).alias("mean"), F.max("top").alias("top"))
    return o.select("l_orderkey", F.round(F.coalesce("mean", "top"), 6).alias("relevance"))


@query("""WITH a AS (SELECT avg(quality) AS m, count(*) AS n FROM labels WHERE toxic = 0), b AS (SELECT avg(quality) AS m, count(*) AS n FROM labels WHERE toxic = 1) SELECT round((a.m * a.n + b.m * b.n) / (a.n + b.n), 6) AS headline FROM a, b""")
def headline_mean(t):
    """The mean of two parts, weighted by their sizes."""
    parts = t.labels.where("toxic IN (0, 1)").groupBy("toxic").agg(F.avg("quality").alias("m"), F.count("quality").alias("n"))
    return parts.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("headline"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS family, CAST(least(greatest(floor(value / 20), 0), 3) AS BIGINT) AS score, len(list_filter(['s0', 's1', 's2'], lambda x: x <> 's' || (event_id % 4))) AS unjudged FROM events""")
def verdict_cleanup(t):
    """Verdicts brought to known families and scores, and the steps without one."""
    judged = F.array(F.concat(F.lit("s"), F.col("event_id") % 4))
    family = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    score = F.least(F.greatest(F.floor(F.col("value") / 20), F.lit(0)), F.lit(3))
    return t.events.select("event_id", family.alias("family"), score.cast("long").alias("score"), F.size(F.array_except(F.array(F.lit("s0"), F.lit("s1"), F.lit("s2")), judged)).cast("long").alias("unjudged"))


@query("""
  WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS gold, [l_suppkey % 9, l_suppkey % 7, l_suppkey % 5] AS top, l_partkey % 4 = 0 AS manual FROM lineitem)
  SELECT count(*) AS n, round(avg(CASE WHEN NOT manual THEN CASE WHEN top[1] = gold THEN 1.0 ELSE 0 END END), 6) AS p_at_1, round(avg(CASE WHEN NOT manual THEN CASE WHEN list_contains(top, gold) THEN 1.0 ELSE 0 END END), 6) AS recall_at_3,
         count(*) FILTER (WHERE manual AND top[1] <> 0) AS linked_manual, count(*) FILTER (WHERE NOT manual AND top[1] = 0) AS over_refused FROM r""")
def retrieval_eval(t):
    """Precision at 1, recall at 3, and refusals where there was an answer."""
    r = t.lineitem.select((F.col("l_partkey") % 9).alias("gold"), F.array(F.col("l_suppkey") % 9, F.col("l_suppkey") % 7, F.col("l_suppkey") % 5).alias("top"), (F.col("l_partkey") % 4 == 0).alias("manual"))
    first = F.element_at("top", 1)
    when = lambda cond: F.round(F.avg(F.when(~F.col("manual"), cond.cast("double"))), 6)
    return r.agg(F.count("*").alias("n"), when(first == F.col("gold")).alias("p_at_1"), when(F.array_contains("top", F.col("gold"))).alias("recall_at_3"), F.count_if(F.col("manual") & (first != 0)).alias("linked_manual"), F.count_if(~F.col("manual") & (first == 0)).alias("over_refused"))


@query("""SELECT event_type, count(*) AS n, round(count(*) FILTER (WHERE value >= 50) * 1.0 / count(*), 6) AS kept_rate, round(count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50) * 1.0 / count(*), 6) AS high_rate FROM events GROUP BY event_type""")
def rule_ratios(t):
    """Ratios of a console's rules, by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), rate(F.col("value") >= 50).alias("kept_rate"), rate(k >= 50).alias("high_rate"))


@query("""SELECT l_returnflag AS owner, count(*) FILTER (WHERE l_linestatus = 'F') AS catalog, count(*) FILTER (WHERE l_linestatus = 'O') AS dummy, count(DISTINCT l_suppkey) AS entries FROM lineitem GROUP BY l_returnflag""")
def story_counts(t):
    """Counts by tier for each owner, as a story shows them."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("owner")).agg(F.count_if(F.col("l_linestatus") == "F").alias("catalog"), F.count_if(F.col("l_linestatus") == "O").alias("dummy"), F.count_distinct("l_suppkey").alias("entries"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n, row_number() OVER (ORDER BY source, lang) AS no FROM documents GROUP BY source, lang)
  SELECT 0 AS no, '| source | lang | n |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT CAST(no + 1 AS INTEGER), '| ' || coalesce(source, '-') || ' | ' || coalesce(lang, '-') || ' | ' || n || ' |' FROM g""")
def report_table(t):
    """Documents by source and language as a markdown table."""
    return files.markdown_table(t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"])

