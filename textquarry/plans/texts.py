"""Queries over text scalars, vocabularies, chunks, dialogues and token sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.functions import sequences, stats, text, training
from textquarry.operators import chunking, metrics, numbering, selecting, vocabulary
from textquarry.plans.registry import Registry
from textquarry.session import read_table

R = Registry()
TOKEN = r"[a-zA-Z]+(?:''[a-zA-Z]+)*|\d|\n|\S"
WORD = r"[a-zA-Z]+(?:''[a-zA-Z]+)*"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
#: The size of the vocabulary that the queries curate from the reasoning corpus.
TOP = 400
FREQ = f"freq AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(ugf_text), '{WORD}')) AS word FROM ugf_reasoning) GROUP BY 1)"
VOCAB = f"{FREQ}, vocab AS (SELECT word FROM freq ORDER BY n DESC, word LIMIT {TOP})"
PUNCT = "('.', ',', '!', '?', ';', ':', '-', '(', ')', '\"', '''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', E'\\n')"


PLAIN_SQL = r"""replace(translate({0}, chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8213) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160), '------''''' || chr(34) || chr(34) || ' '), chr(8230), '...')"""


def _freq(spark, d):
    return vocabulary.frequencies(read_table(spark, d, "ugf_reasoning"), "ugf_text")


def _vocab(spark, d):
    return vocabulary.top(_freq(spark, d), TOP).select("word")


@R.query(f"SELECT rec_id, len(regexp_extract_all(ugf_text, '{TOKEN}'))::BIGINT AS n_tokens, array_to_string(regexp_extract_all(ugf_text, '{TOKEN}'), '|') AS joined FROM ugf_reasoning WHERE ugf_text IS NOT NULL")
def t01_tokens(spark, d):
    """Tokens."""
    toks = text.tokens("ugf_text")
    return read_table(spark, d, "ugf_reasoning").where("ugf_text is not null").select("rec_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, "|").alias("joined"))


@R.query(f"WITH {FREQ} SELECT word, n FROM freq ORDER BY n DESC, word LIMIT {TOP}")
def a17_top_words(spark, d):
    """Word frequencies, the most frequent ones."""
    return vocabulary.top(_freq(spark, d), TOP)


@R.query(f"WITH {VOCAB}, f2 AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents) GROUP BY 1) SELECT sum(n)::BIGINT AS n_tokens, sum(CASE WHEN v.word IS NULL THEN n ELSE 0 END)::BIGINT AS n_out, count(*) FILTER (v.word IS NULL)::BIGINT AS forms_out, sum(CASE WHEN v.word IS NULL THEN n ELSE 0 END) / sum(n) AS out_rate FROM f2 LEFT JOIN vocab v USING (word)")
def a18_out_of_vocabulary(spark, d):
    """Tokens and forms outside the vocabulary."""
    return vocabulary.coverage(vocabulary.frequencies(read_table(spark, d, "documents"), "text"), _vocab(spark, d))


@R.query(f"WITH {VOCAB}, f2 AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(prompt_text), '{WORD}')) AS word FROM ugf_cot) GROUP BY 1) SELECT word, n FROM f2 ANTI JOIN vocab USING (word) ORDER BY n DESC, word LIMIT 25")
def a18_top_unknown(spark, d):
    """The most frequent words outside the vocabulary."""
    f = vocabulary.frequencies(read_table(spark, d, "ugf_cot"), "prompt_text")
    return vocabulary.top(f.join(_vocab(spark, d), "word", "left_anti"), 25)


@R.query(f"WITH {VOCAB}, t AS (SELECT rec_id, unnest(regexp_extract_all(ugf_text, '{TOKEN}')) AS tok FROM ugf_reasoning WHERE ugf_text IS NOT NULL), c AS (SELECT rec_id, count(*) AS n, count(*) FILTER (v.word IS NULL AND tok NOT IN {PUNCT}) AS o FROM t LEFT JOIN vocab v ON lower(t.tok) = v.word GROUP BY 1) SELECT r.rec_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(o, 0)::BIGINT AS n_out, coalesce(1 - o / n, 1.0)::DOUBLE AS inside_rate FROM ugf_reasoning r LEFT JOIN c USING (rec_id)")
def t06_t07_validation(spark, d):
    """Tokens outside the vocabulary, and the share inside."""
    return vocabulary.violations(read_table(spark, d, "ugf_reasoning"), "rec_id", "ugf_text", _vocab(spark, d)).withColumns({"n_tokens": F.col("n_tokens").cast("long"), "n_out": F.col("n_out").cast("long")})


@R.query(f"""WITH {VOCAB}, x AS (SELECT rec_id, coalesce(prompt, '') AS p, coalesce(response, '') AS r FROM ugf_forms_corpus), y AS (SELECT rec_id, {PLAIN_SQL.format("p")} AS p, {PLAIN_SQL.format("r")} AS r FROM x),
t AS (SELECT rec_id, list_concat(regexp_extract_all(p, '{TOKEN}'), regexp_extract_all(r, '{TOKEN}')) AS a FROM y), u AS (SELECT rec_id, unnest(a) AS tok, generate_subscripts(a, 1) AS pos FROM t),
c AS (SELECT rec_id, count(*) AS n, string_agg(tok, '|' ORDER BY pos) FILTER (v.word IS NULL AND tok NOT IN {PUNCT}) AS bad FROM u LEFT JOIN vocab v ON lower(u.tok) = v.word GROUP BY 1)
SELECT t.rec_id, coalesce(n, 0)::BIGINT AS n_tokens, bad IS NULL AS is_valid, md5(coalesce(bad, '')) AS violations FROM t LEFT JOIN c USING (rec_id)""")
def t06_t10_pairs(spark, d):
    """Pairs of prompt and response made plain and validated, the violations of both in order."""
    found = vocabulary.validated(read_table(spark, d, "ugf_forms_corpus"), "rec_id", ["prompt", "response"], _vocab(spark, d))
    return found.select("rec_id", "n_tokens", (F.size("violations") == 0).alias("is_valid"), F.md5(F.array_join("violations", "|")).alias("violations"))


@R.query("SELECT rec_id, len(list_filter(v, lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) = 'thus'))::BIGINT AS n_allowed, len(list_filter(v, lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) <> 'thus'))::BIGINT AS n_other, len(list_filter(v, lambda w: NOT regexp_matches(w, '^[A-Z]')))::BIGINT AS n_lexical, CASE WHEN len(v) > 2 THEN '\"' || array_to_string(v[1:2], '\", \"') || '\" (and ' || (len(v) - 2) || ' more)' ELSE array_to_string(list_transform(v, lambda w: '\"' || w || '\"'), ', ') END AS message FROM (SELECT rec_id, remaining_violations AS v FROM ugf_cot WHERE len(remaining_violations) > 0)")
def t08_t11_violations(spark, d):
    """Kinds of violations, and the list for a correction."""
    t = read_table(spark, d, "ugf_cot").where(F.size("remaining_violations") > 0)
    parts = text.split_violations("remaining_violations", ["thus"])
    return t.select("rec_id", F.size(parts["proper_allowed"]).cast("long").alias("n_allowed"), F.size(parts["proper_other"]).cast("long").alias("n_other"), F.size(parts["lexical"]).cast("long").alias("n_lexical"), text.correction_list("remaining_violations", 2).alias("message"))


@R.query("SELECT doc_id, md5(replace(translate(text, chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8213) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160), '------''''\"\" '), chr(8230), '...')) AS h FROM documents WHERE text IS NOT NULL")
def t09_plain_signs(spark, d):
    """Typographic signs made plain."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.plain_signs("text")).alias("h"))


@R.query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#{1,6}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')) AS h, regexp_matches(text, '^(!?\[|---+|===+|\*\*\*+|#{1,6}\s*$)') AS artifact FROM documents WHERE text IS NOT NULL")
def t14_markdown(spark, d):
    """Markdown taken off."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.strip_markdown("text")).alias("h"), text.is_artifact("text").alias("artifact"))


@R.query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '_([^_]+)_', '\1', 'g'), '\s+', ' ', 'g'))) AS h, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>'))::BIGINT AS n_escaped FROM documents WHERE text IS NOT NULL")
def t15_t37_tidy(spark, d):
    """White space collapsed; text escaped for HTML."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.tidy("text")).alias("h"), F.char_length(text.escaped("text")).cast("long").alias("n_escaped"))


@R.query(r"SELECT doc_id, regexp_extract(text, '(?i)[,;]?\s+(?:said|replied|cried|continued|answered|returned|added|resumed|interrupted|exclaimed|observed|rejoined)\s+(the|a|each|one)\b', 1) AS hit FROM documents WHERE regexp_matches(text, '(?i)[,;]?\s+(?:said|replied|cried|continued|answered|returned|added|resumed|interrupted|exclaimed|observed|rejoined)\s+(the|a|each|one)\b')")
def t16_attribution(spark, d):
    """What a verb of speech names."""
    hit = text.attribution("text", ["the", "a", "each", "one"])
    return read_table(spark, d, "documents").select("doc_id", F.lower(hit).alias("hit"), F.col("text")).where("hit is not null").select("doc_id", F.regexp_extract("text", rf"(?i)[,;]?\s+(?:{text.SPEECH_VERBS})\s+(the|a|each|one)\b", 1).alias("hit"))


@R.query("SELECT rec_id, n::BIGINT AS n_markers, CASE WHEN n > 0 THEN regexp_replace(regexp_extract(ugf_response, '(?s)^(.*)[Ss]o my answer is:(.*)$', 1), '\\s+$', '') END AS reasoning, CASE WHEN n > 0 THEN nullif(regexp_replace(regexp_extract(ugf_response, '(?s)^(.*)[Ss]o my answer is:(.*)$', 2), '^\\s+|\\s+$', '', 'g'), '') END AS answer, CASE WHEN n = 0 THEN 'no_marker' WHEN n > 1 THEN 'multiple_markers' WHEN nullif(regexp_replace(regexp_extract(ugf_response, '(?s)^(.*)[Ss]o my answer is:(.*)$', 2), '^\\s+|\\s+$', '', 'g'), '') IS NULL THEN 'empty_answer' END AS failure_mode FROM (SELECT *, len(regexp_extract_all(ugf_response, '[Ss]o my answer is:')) AS n FROM bench_run WHERE ugf_response IS NOT NULL)")
def t22_answer_parts(spark, d):
    """Reasoning and answer around the last marker."""
    p = text.answer_parts("ugf_response")
    return read_table(spark, d, "bench_run").where("ugf_response is not null").select("rec_id", p["n_markers"].cast("long").alias("n_markers"), p["reasoning"].alias("reasoning"), p["answer"].alias("answer"), p["failure_mode"].alias("failure_mode"))


@R.query("SELECT rec_id, nullif(regexp_replace(regexp_extract(ugf_response, '(?s)^(.*)[Ss]o my answer is:(.*)$', 2), '^\\s+|\\s+$', '', 'g'), '') AS ugf_response, true AS was_parsed FROM bench_run WHERE len(regexp_extract_all(ugf_response, '[Ss]o my answer is:')) = 1 AND nullif(regexp_replace(regexp_extract(ugf_response, '(?s)^(.*)[Ss]o my answer is:(.*)$', 2), '^\\s+|\\s+$', '', 'g'), '') IS NOT NULL")
def p12_answer_span(spark, d):
    """The response replaced by its answer, failures dropped."""
    p = text.answer_parts("ugf_response")
    return read_table(spark, d, "bench_run").where(p["parse_ok"]).select("rec_id", p["answer"].alias("ugf_response"), F.lit(True).alias("was_parsed"))


@R.query(r"""WITH t AS (SELECT rec_id, trim(ugf_response) AS t FROM comparator_holdout), p AS (SELECT *, trim(regexp_extract(t, '(?is)^(.*)final answer\s*:\s*(.*)$', 1)) AS b, trim(regexp_extract(t, '(?is)^(.*)final answer\s*:\s*(.*)$', 2)) AS a, string_split(regexp_replace(t, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM t)
SELECT rec_id, CASE WHEN b <> '' AND a <> '' THEN b WHEN len(parts) >= 2 THEN array_to_string(parts[1:len(parts) - 1], ' ') ELSE t END AS reasoning, CASE WHEN b <> '' AND a <> '' THEN a WHEN len(parts) >= 2 THEN parts[len(parts)] ELSE t END AS answer FROM p""")
def t23_final_answer(spark, d):
    """The last cue or the last sentence."""
    p = text.final_answer("ugf_response")
    return read_table(spark, d, "comparator_holdout").select("rec_id", p["reasoning"].alias("reasoning"), p["answer"].alias("answer"))


@R.query(f"WITH w AS (SELECT rollout_id, list_filter(regexp_split_to_array(completion_text, '\\s+'), lambda w: w <> '') AS k FROM rl_rollouts) SELECT rollout_id, coalesce(len(k) >= 12 AND len(list_filter(range(0, len(k) - 11), lambda p: k[p + 1:p + 8] = k[p + 5:p + 12])) > 0, false) AS loops FROM w")
def t24_loops(spark, d):
    """Four words three times in a row."""
    return read_table(spark, d, "rl_rollouts").select("rollout_id", text.has_loop("completion_text").alias("loops"))


@R.query("SELECT rec_id, CASE WHEN contains(lower(trim(verdict)), 'not follow') THEN 'does not follow' WHEN contains(lower(trim(verdict)), 'follow') THEN 'follows' END AS said, (CASE WHEN contains(lower(trim(verdict)), 'not follow') THEN 'does not follow' WHEN contains(lower(trim(verdict)), 'follow') THEN 'follows' END) = expected AS correct FROM ugf_cot")
def t25_verdict(spark, d):
    """A verdict in three states."""
    return read_table(spark, d, "ugf_cot").select("rec_id", text.verdict("verdict").alias("said"), (text.verdict("verdict") == F.col("expected")).alias("correct"))


@R.query(r"SELECT event_id, nullif(regexp_extract(lower(right('first invalid then ' || CASE WHEN event_id % 3 = 0 THEN 'valid' ELSE 'it is invalid.' END, 400)), '(?s)^.*\b(invalid|valid)\b', 1), '') AS said FROM events")
def t26_validity(spark, d):
    """The last whole word of valid and invalid."""
    said = F.concat(F.lit("first invalid then "), F.when(F.col("event_id") % 3 == 0, "valid").otherwise("it is invalid."))
    return read_table(spark, d, "events").select("event_id", text.validity(said).alias("said"))


@R.query("SELECT event_id, (event_id % 7)::INTEGER AS a, 2 AS b FROM events WHERE event_id % 7 <= 4 AND event_id % 5 <> 0")
def t27_t28_judge_json(spark, d):
    """Replies with fences and chatter around JSON; whole rows null out of range."""
    k = F.col("event_id")
    score = F.concat(F.pmod(k, F.lit(7)).cast("string"), F.lit(".7"))
    reply = F.concat(F.lit('Here:\n```json\n{"a": {"score": '), score, F.when(k % 5 == 0, "").otherwise(', "justification": "x"}, "b": {"score": 2'), F.lit("}}\n```"))
    j = text.judged(reply, ["a", "b"])
    return read_table(spark, d, "events").select("event_id", j["a"].alias("a"), j["b"].alias("b")).where("a is not null")


@R.query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, coalesce(TRY_CAST(nullif(regexp_extract(props, '[0-4]'), '') AS DOUBLE), -1) AS digit, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS field FROM events")
def t29_t33_numbers(spark, d):
    """Numbers from text, and a field of a JSON bag."""
    return read_table(spark, d, "events").select("event_id", text.safe_int(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), text.first_score("props").alias("digit"), text.safe_int(F.get_json_object("props", "$.k")).alias("field"))


@R.query(f"SELECT rec_id, CASE WHEN ugf_response IS NULL OR ugf_response = '' OR starts_with(ugf_response, '<') THEN 0 ELSE {WORDS.format('ugf_response')} END::BIGINT AS n_words FROM comparator_holdout")
def t34_response_words(spark, d):
    """Words of a response, none for an error."""
    return read_table(spark, d, "comparator_holdout").select("rec_id", text.response_words("ugf_response").cast("long").alias("n_words"))


@R.query("SELECT id, replace(id, '-', '_') AS original FROM bench")
def t35_original_ids(spark, d):
    """The record behind a held-out item's id."""
    return read_table(spark, d, "bench").select("id", text.original_id(F.concat(F.lit("cxbot-defcx-"), "id", F.lit("-reasoning"))).alias("original"))


@R.query(r"SELECT id, question AS body, trim(question) AS after_header FROM bench")
def t19_margins_headers(spark, d):
    """Margin numbers off the lines, and what follows a header."""
    b = read_table(spark, d, "bench")
    page = F.concat(F.lit("PREFACE\nold\nCHAPTER I.\n"), F.replace("question", F.lit("\n"), F.lit(" ")), F.lit(" 36"))
    tail = text.from_header(page, r"CHAPTER\s+[IVXLC]+\.?")
    return b.select("id", F.regexp_replace(text.without_margin_numbers(tail), r"^\n", "").alias("body"), text.strip(F.regexp_replace(text.without_margin_numbers(tail), r"\s+", " ")).alias("after_header"))


@R.query("SELECT item, role, content FROM (SELECT id AS item, 'assistant' AS role, expected_answer AS content FROM bench) WHERE content IS NOT NULL")
def t20_t21_messages(spark, d):
    """The last assistant message of a chat, its passage after the label."""
    b = read_table(spark, d, "bench").where("expected_answer is not null")
    say = lambda role, t: F.struct(F.lit(role).alias("role"), t.alias("content"))
    chat = F.array(say("user", F.col("question")), say("assistant", F.lit("first")), say("assistant", F.concat(F.lit("Notes\nExtended passage:\n"), "expected_answer")))
    last = F.element_at(F.filter(chat, lambda m: m["role"] == "assistant"), -1)
    return b.select(F.col("id").alias("item"), last["role"].alias("role"), text.passage_after(last["content"]).alias("content"))


@R.query("WITH s(k, p, q, np, nq) AS (VALUES (0, 'the lamp is on', 'the room is bright', 'the lamp is not on', 'the room is not bright'), (1, 'Ann is home', 'the door is open', 'Ann is not home', 'the door is not open')), r AS (SELECT range AS n, CASE WHEN range % 3 = 0 THEN 'modus_ponens' WHEN range % 3 = 1 THEN 'denying_antecedent' ELSE 'disjunctive_syllogism' END AS rule, range % 2 AS k FROM range(600)) SELECT n::BIGINT AS n, rule, CASE WHEN rule = 'disjunctive_syllogism' THEN 'Either ' || p || ' or ' || q || '.' ELSE 'If ' || p || ', then ' || q || '.' END AS premise_1, CASE WHEN rule = 'modus_ponens' THEN upper(p[1]) || lower(p[2:]) ELSE upper(np[1]) || lower(np[2:]) END || '.' AS premise_2, CASE WHEN rule = 'denying_antecedent' THEN upper(nq[1]) || lower(nq[2:]) ELSE upper(q[1]) || lower(q[2:]) END || '.' AS conclusion, rule <> 'denying_antecedent' AS is_valid FROM r JOIN s USING (k)")
def m10_t36_puzzles(spark, d):
    """Logic puzzles from rules and scenarios."""
    scenarios = [(0, "the lamp is on", "the room is bright", "the lamp is not on", "the room is not bright"), (1, "Ann is home", "the door is open", "Ann is not home", "the door is not open")]
    dim = spark.createDataFrame(scenarios, "k int, p string, q string, not_p string, not_q string")
    rows = spark.range(600).select(F.col("id").alias("n"), F.pmod("id", F.lit(2)).cast("int").alias("k")).join(dim, "k")
    third = F.pmod("n", F.lit(3))
    return selecting.puzzles(rows, F.when(third == 0, "modus_ponens").when(third == 1, "denying_antecedent").otherwise("disjunctive_syllogism")).select("n", "rule", "premise_1", "premise_2", "conclusion", "is_valid")


@R.query()
def w13_overlapping_chunks(spark, d):
    """Overlapping chunks of paragraphs (a fold: tested against a plain loop)."""
    c = chunking.overlapping(F.col("text"), 120, 20)
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(c).alias("chunk", "body"))


@R.query()
def w14_targeted_chunks(spark, d):
    """Chunks of about a target length."""
    c = chunking.targeted(F.col("text"), 80, 30, 140)
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(c).alias("chunk", "body"))


SPEAKER = r"^([A-Z][A-Z]+):\s"


@R.query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][A-Z]+):\s', 1), '') AS sp FROM l WHERE trim(line) <> ''), t AS (SELECT *, count(sp) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM m)
SELECT doc_id, turn::BIGINT AS turn, max(sp) AS speaker, string_agg(trim(regexp_replace(line, '^([A-Z][A-Z]+):\s', '')), ' ' ORDER BY pos) AS text FROM t WHERE turn > 0 GROUP BY 1, 2""")
def w02_turns(spark, d):
    """Turns opened by speaker lines, with their continuations."""
    return chunking.turns(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text", SPEAKER)


@R.query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][A-Z]+):\s', 1), '') AS sp FROM l WHERE trim(line) <> ''), t AS (SELECT *, count(sp) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM m),
g AS (SELECT doc_id, turn, max(sp) AS speaker, string_agg(trim(regexp_replace(line, '^([A-Z][A-Z]+):\s', '')), ' ' ORDER BY pos) AS text FROM t WHERE turn > 0 GROUP BY 1, 2), n AS (SELECT *, lead(speaker) OVER w AS sb, lead(text) OVER w AS tb FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY turn)), k AS (SELECT * FROM n WHERE length(text) BETWEEN 20 AND 800 AND length(tb) BETWEEN 20 AND 800 AND speaker <> sb)
SELECT doc_id || '_pair_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY turn))::VARCHAR, 3, '0') AS pair_id, speaker AS speaker_a, text AS turn_a, sb AS speaker_b, tb AS turn_b FROM k""")
def w01_w04_pairs(spark, d):
    """Consecutive turns of different speakers within a length band, numbered."""
    t = chunking.turns(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text", SPEAKER)
    return chunking.pair_ids(chunking.neighbours(t, "doc_id", "turn", "speaker", "text", 20, 800), "doc_id", "turn").select("pair_id", "speaker_a", "turn_a", "speaker_b", "turn_b")


@R.query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT *, regexp_matches(line, '^#{1,6} ') AS h FROM l), t AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m)
SELECT doc_id, section::BIGINT AS section, max(trim(line)) FILTER (h) AS title, md5(trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), ''))) AS body, count(*) FILTER (NOT h)::BIGINT AS n_lines FROM t WHERE section > 0 GROUP BY 1, 2""")
def w03_sections(spark, d):
    """Sections under header lines."""
    s = chunking.sections(read_table(spark, d, "documents").where("text is not null"), "doc_id", "text", r"^#{1,6} ")
    return s.select("doc_id", "section", "title", F.md5("body").alias("body"), "n_lines")


@R.query(r"""WITH t AS (SELECT id, 'FIRST ARTICLE [I, Q. ' || (length(question) % 40) || ', Art. 2]' || chr(10) || chr(10) || 'Whether ' || lower(question[1]) || question[2:] || chr(10) || 'Body' AS t FROM bench)
SELECT id, regexp_extract(t, '\[I,\s*Q\.\s*(\d+),', 1) AS question, array_to_string(regexp_extract_all(t, '(?m)^(Whether\s+.+?\?)\s*$', 1), '|') AS titles FROM t""")
def t18_titles(spark, d):
    """Headers and titles of articles."""
    page = F.concat(F.lit("FIRST ARTICLE [I, Q. "), (F.length("question") % 40).cast("string"), F.lit(", Art. 2]\n\nWhether "), F.lower(F.substring("question", 1, 1)), F.substring("question", 2, 2**31 - 1), F.lit("\nBody"))
    b = read_table(spark, d, "bench").select("id", page.alias("t"))
    return b.select("id", F.get(chunking.articles(F.col("t")), F.lit(0))["question"].alias("question"), F.array_join(chunking.titles(F.col("t")), "|").alias("titles"))


@R.query()
def t18_j08_objections(spark, d):
    """Objections beside their replies, within works written in that form."""
    b = read_table(spark, d, "bench")
    article = F.concat(F.lit("Objection 1: "), "question", F.lit("\n\nObj. 2: More.\n\n_On the contrary,_ no.\n\nReply Obj. 1: "), F.coalesce("expected_answer", F.lit("none")), F.lit("\n\nReply Obj. 2: Less.\n"))
    return chunking.answered(b.select("id", article.alias("text")), ["id"], "text")


@R.query(f"WITH {FREQ}, t AS (SELECT word, n FROM freq ORDER BY n DESC, word LIMIT 200), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS rank FROM t) SELECT round(CASE WHEN count(*) >= 5 THEN regr_slope(ln(n), ln(rank)) ELSE 0 END, 6) AS slope FROM r")
def a27_zipf_slope(spark, d):
    """The slope of the rank-frequency line."""
    return vocabulary.zipf_slope(_freq(spark, d)).select(F.round("slope", 6).alias("slope"))


@R.query(f"WITH {FREQ} SELECT sum(n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_forms, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(-sum(n / t * ln(n / t)) / ln(4000), 6) AS normalised FROM freq, (SELECT sum(n) AS t FROM freq)")
def a26_entropy(spark, d):
    """Entropy of the words used."""
    return vocabulary.probe(_freq(spark, d), 4000).select("n_tokens", "n_forms", F.round("entropy", 6).alias("entropy"), F.round("normalised", 6).alias("normalised"))


@R.query(f"WITH {FREQ} SELECT row_number() OVER (ORDER BY n DESC, word)::BIGINT AS rank, word, n FROM freq ORDER BY n DESC, word LIMIT 100")
def w08_rank_frequency(spark, d):
    """The rank-frequency table."""
    return vocabulary.rank_frequency(_freq(spark, d), 100).withColumn("rank", F.col("rank").cast("long"))


@R.query("""WITH p AS (SELECT id, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '') AS o, list_filter(regexp_split_to_array(lower(coalesce(expected_answer, '')), '\\s+'), lambda w: w <> '') AS m FROM bench), c AS (SELECT id, w, count(*) AS k FROM (SELECT id, unnest(m) AS w FROM p) GROUP BY 1, 2), x AS (SELECT c.id, sum(least(c.k, len(list_filter(p.o, lambda y: y = c.w)))) AS common FROM c JOIN p USING (id) GROUP BY 1)
SELECT id, CASE WHEN len(m) = 0 THEN 0 ELSE round(least(1.0, len(m) / greatest(len(o), 1)) * common / len(m), 6) END AS bleu FROM p LEFT JOIN x USING (id)""")
def t30_bleu(spark, d):
    """Clipped unigram precision with the length ratio."""
    return metrics.unigram_bleu(read_table(spark, d, "bench"), "id", "question", "expected_answer").select("id", F.round("bleu", 6).alias("bleu"))


@R.query()
def t31_rouge(spark, d):
    """The longest common subsequence's F1."""
    return metrics.rouge_l_long(read_table(spark, d, "bench_run"), "rec_id", "prompt", "ugf_response")


@R.query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x05_cosine(spark, d):
    """The cosine of neighbouring vectors."""
    e = read_table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(stats.cosine("embedding", "other"), 6).alias("cosine"))


def _encoded(spark, d, table, key, column):
    """Ids of a text column in the curated vocabulary."""
    return vocabulary.encoded(read_table(spark, d, table), key, column, vocabulary.with_ids(_vocab(spark, d)))


IDS = f"""{VOCAB}, head AS (SELECT unnest(['<PAD>', '<UNK>', '<BOS>', '<EOS>', '<CAP>', '.', ',', '!', '?', ';', ':', '-', '(', ')', '"', '''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', E'\\n']) AS token, generate_subscripts(['<PAD>', '<UNK>', '<BOS>', '<EOS>', '<CAP>', '.', ',', '!', '?', ';', ':', '-', '(', ')', '"', '''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', E'\\n'], 1) - 1 AS tid),
ids AS (SELECT * FROM head UNION ALL SELECT word, row_number() OVER (ORDER BY word) + 26 FROM vocab),
toks AS (SELECT id, generate_subscripts(regexp_extract_all(question, '{TOKEN}'), 1) AS pos, unnest(regexp_extract_all(question, '{TOKEN}')) AS tok FROM bench),
enc AS (SELECT t.id, pos, CASE WHEN l.tid IS NOT NULL AND regexp_matches(tok, '^[A-Z]') AND length(tok) > 1 THEN '4 ' || l.tid ELSE coalesce(l.tid, r.tid, 1)::VARCHAR END AS x FROM toks t LEFT JOIN ids l ON lower(t.tok) = l.token LEFT JOIN ids r ON t.tok = r.token),
seq AS (SELECT id, string_agg(x, ' ' ORDER BY pos) AS s FROM enc GROUP BY 1)"""


@R.query(f"WITH {IDS} SELECT id, '2 ' || s || ' 3' AS ids FROM seq")
def t03_t04_encoding(spark, d):
    """Ids with <CAP> and <UNK>, between begin and end."""
    e = _encoded(spark, d, "bench", "id", "question")
    return e.select("id", F.array_join(F.transform(sequences.wrapped("ids"), lambda x: x.cast("string")), " ").alias("ids"))


@R.query(f"""WITH {IDS}, w AS (SELECT t.id, pos, CASE WHEN l.tid IS NOT NULL AND regexp_matches(tok, '^[A-Z]') AND length(tok) > 1 THEN upper(tok[1]) || lower(tok[2:]) WHEN l.tid IS NOT NULL THEN lower(tok) ELSE r.token END AS w FROM toks t LEFT JOIN ids l ON lower(t.tok) = l.token LEFT JOIN ids r ON t.tok = r.token),
s AS (SELECT id, string_agg(w, ' ' ORDER BY pos) AS s FROM w WHERE w IS NOT NULL GROUP BY 1)
SELECT b.id, trim(coalesce(regexp_replace(regexp_replace(s, ' ([.,!?;:)''"])', '\\1', 'g'), ' ?\\n ?', chr(10), 'g'), '')) AS text FROM bench b LEFT JOIN s USING (id)""")
def t05_detokenised(spark, d):
    """Texts in the curated vocabulary and back to text by a fold."""
    e = vocabulary.encoded(read_table(spark, d, "bench"), "id", "question", vocabulary.with_ids(_vocab(spark, d)), pieces=True)
    return e.select("id", sequences.detokenised("pieces").alias("text"))


@R.query(f"WITH {IDS}, a AS (SELECT id, string_split('2 ' || s || ' 3', ' ') AS f FROM seq), c AS (SELECT id, CASE WHEN len(f) > 40 THEN list_concat(f[1:39], ['3']) ELSE f END AS f FROM a) SELECT id, array_to_string(f, ' ') AS ids, array_to_string(list_concat(list_transform(f[1:5], lambda x: '-100'), f[6:]), ' ') AS labels, greatest(len(f) - 5, 0)::BIGINT AS n_trained FROM c")
def q01_q02_q06_masks(spark, d):
    """Q-seq1, 2, 6: cut to a length, the prompt's labels masked, trained labels counted."""
    seq = sequences.cut_to(sequences.wrapped("ids"), 40)
    e = _encoded(spark, d, "bench", "id", "question").select("id", seq.alias("ids")).withColumn("labels", sequences.masked("ids", F.lit(5)))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return e.select("id", show("ids").alias("ids"), show("labels").alias("labels"), sequences.trained("labels").cast("long").alias("n_trained"))


def _lists(name: str, table: str, key: str, column: str) -> str:
    """The SQL of the ids of a column, as lists."""
    return f"""{name}_t AS (SELECT {key} AS k, unnest(regexp_extract_all({column}, '{TOKEN}')) AS tok, generate_subscripts(regexp_extract_all({column}, '{TOKEN}'), 1) AS pos FROM {table}),
{name} AS (SELECT k, list(CASE WHEN l.tid IS NOT NULL AND regexp_matches(tok, '^[A-Z]') AND length(tok) > 1 THEN [4, l.tid] ELSE [coalesce(l.tid, r.tid, 1)] END ORDER BY pos) AS f FROM {name}_t t LEFT JOIN ids l ON lower(t.tok) = l.token LEFT JOIN ids r ON t.tok = r.token GROUP BY 1)"""


COT = "(SELECT * FROM ugf_cot WHERE track = 'philosophy')"


@R.query(f"""WITH {IDS}, {_lists("p", COT, "rec_id", "prompt_text")}, {_lists("r", COT, "rec_id", "reasoning")}, {_lists("a", COT, "rec_id", "conclusion")},
x AS (SELECT c.rec_id, coalesce(flatten(p.f), []) AS p, coalesce(flatten(r.f), []) AS r, coalesce(flatten(a.f), []) AS a FROM {COT} c LEFT JOIN p ON p.k = c.rec_id LEFT JOIN r ON r.k = c.rec_id LEFT JOIN a ON a.k = c.rec_id), y AS (SELECT *, len(p) + len(a) + 4 AS fixed FROM x)
SELECT rec_id, array_to_string(list_concat(list_concat([2], p), list_concat(r[1:greatest(0, least(len(r), 160 - fixed))], list_concat([10, 11], list_concat(a, [3])))), ' ') AS ids FROM y WHERE fixed <= 160""")
def q03_budgets(spark, d):
    """Q-seq3: prompt, as much reasoning as fits, marker and answer."""
    t, vocab = read_table(spark, d, "ugf_cot").where("track = 'philosophy'"), vocabulary.with_ids(_vocab(spark, d))
    e = [vocabulary.encoded(t, "rec_id", c, vocab).withColumnRenamed("ids", n) for c, n in (("prompt_text", "p"), ("reasoning", "r"), ("conclusion", "a"))]
    full = sequences.budgeted("p", "r", F.array(F.lit(10), F.lit(11)), "a", 160)
    return e[0].join(e[1], "rec_id").join(e[2], "rec_id").select("rec_id", full.alias("ids")).where("ids is not null").select("rec_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@R.query(f"""WITH {IDS}, {_lists("p", "bench", "id", "question")}, {_lists("c", "bench", "id", "expected_answer")}, {_lists("r", "bench", "id", "instruction")},
x AS (SELECT p.k AS id, flatten(p.f) AS p, flatten(c.f) AS c, flatten(r.f) AS r, 120 - len(flatten(p.f)) - 2 AS room FROM p JOIN c USING (k) JOIN r USING (k))
SELECT id, array_to_string(list_concat(list_concat([2], p), list_concat(c[1:least(len(c), room)], [3])), ' ') AS chosen_ids, array_to_string(list_concat(list_concat([2], p), list_concat(r[1:least(len(r), room)], [3])), ' ') AS rejected_ids, len(p) + 1 AS prompt_len FROM x WHERE room > 0""")
def q05_preferences(spark, d):
    """Q-seq5: both sides of preference pairs, cut to a length, with the prompt's length."""
    b, vocab = read_table(spark, d, "bench"), vocabulary.with_ids(_vocab(spark, d))
    e = [vocabulary.encoded(b, "id", c, vocab).withColumnRenamed("ids", n) for c, n in (("question", "p"), ("expected_answer", "c"), ("instruction", "r"))]
    pair = sequences.preference_pair("p", "c", "r", 120)
    full = e[0].join(e[1], "id").join(e[2], "id").where("size(p) > 0 and size(c) > 0 and size(r) > 0").select("id", pair.alias("x")).where("x is not null")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return full.select("id", show("x.chosen_ids").alias("chosen_ids"), show("x.rejected_ids").alias("rejected_ids"), F.col("x.prompt_len").cast("long").alias("prompt_len"))


@R.query(f"WITH {IDS}, b AS (SELECT id, string_split(s, ' ') AS f, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM seq), w AS (SELECT *, max(len(f)) OVER (PARTITION BY batch) AS width FROM b) SELECT id, batch::BIGINT + 1 AS batch, width::BIGINT AS width, array_to_string(f, ' ') || repeat(' 0', width - len(f)) AS ids, len(f)::BIGINT AS attended FROM w")
def q04_padding(spark, d):
    """Q-seq4: padded to the longest of a batch."""
    e = numbering.batches(_encoded(spark, d, "bench", "id", "question"), "id", size=16)
    widths = e.groupBy("batch").agg(F.max(F.size("ids")).alias("width"))
    p = e.join(widths, "batch")
    total = F.aggregate(sequences.attention("ids", F.col("width")), F.lit(0), lambda s, v: s + v)
    return p.select("id", F.col("batch").cast("long").alias("batch"), F.col("width").cast("long").alias("width"), F.array_join(F.transform(sequences.padded("ids", F.col("width")), lambda x: x.cast("string")), " ").alias("ids"), total.cast("long").alias("attended"))


@R.query("SELECT range::BIGINT AS step, round(CASE WHEN range < 100 THEN 0.0003 * (range + 1) / 100 WHEN range >= 900 THEN 0.00003 ELSE 0.00003 + 0.5 * 0.00027 * (1 + cos(pi() * (range - 100) / 800.0)) END, 9) AS rate FROM range(1000)")
def x01_learning_rate(spark, d):
    """The warm-up and cosine schedule."""
    return spark.range(1000).select(F.col("id").alias("step"), F.round(training.cosine_rate(F.col("id"), 100, 900, 0.0003, 0.00003), 9).alias("rate"))


@R.query("SELECT event_id, round(exp(least(value, 30)), 3) AS ppl, round(ln(1 + exp(-0.1 * (value / 100 - 1))), 6) AS dpo, round(ln(1 + exp(-0.1 * value / 100)) + ln(1 + exp(0.1 * 1)), 6) AS apo FROM events WHERE value < 20")
def x02_x03_losses(spark, d):
    """Perplexity and preference losses."""
    v, one = F.col("value"), F.lit(1.0)
    return read_table(spark, d, "events").where("value < 20").select("event_id", F.round(training.perplexity(v), 3).alias("ppl"), F.round(training.preference_loss(v / 100, one), 6).alias("dpo"), F.round(training.preference_loss(v / 100, one, variant="apo_zero"), 6).alias("apo"))


@R.query()
def x02_x03_all_losses(spark, d):
    """Perplexity and preference losses of all events, those clipped at a loss of 30 among them. x02_x03_losses
    has the events under 20 only, as its SQL. The perplexity isn't rounded, so that it can be compared relatively."""
    v, one = F.col("value"), F.lit(1.0)
    return read_table(spark, d, "events").select("event_id", training.perplexity(v).alias("ppl"), F.round(training.preference_loss(v / 100, one), 6).alias("dpo"), F.round(training.preference_loss(v / 100, one, variant="apo_zero"), 6).alias("apo"))


@R.query("SELECT rollout_id, round(-(least(exp(0.2) * advantage, 1.2 * advantage) + least(exp(-0.5) * advantage, greatest(0.8, least(1.2, exp(-0.5))) * advantage)) / 2, 6) AS policy, 0.05::DOUBLE AS drift FROM rl_rollouts WHERE advantage IS NOT NULL")
def x04_clipped(spark, d):
    """The clipped objective and the divergence of a rollout."""
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    policy, drift = training.clipped_objective(arr(-0.8, -1.5, -9.0), arr(-1.0, -1.0), arr(-0.9, -1.5, -2.0), F.col("advantage"))
    return read_table(spark, d, "rl_rollouts").where("advantage is not null").select("rollout_id", F.round(policy, 6).alias("policy"), F.round(drift, 6).alias("drift"))


@R.query("SELECT night, count(*)::BIGINT AS n, min(strftime(ts, '%Y%m%d_%H%M%S')) AS first_stamp FROM (SELECT ts, (hour(ts) * 60 + minute(ts) >= 1020 OR hour(ts) * 60 + minute(ts) < 300) AS night FROM events) GROUP BY 1")
def x06_x07_night(spark, d):
    """The night window across midnight, and time stamps."""
    return read_table(spark, d, "events").select(training.is_night(F.col("ts"), "17:00", "05:00").alias("night"), training.stamp(F.col("ts"), True).alias("s")).groupBy("night").agg(F.count("*").alias("n"), F.min("s").alias("first_stamp"))
