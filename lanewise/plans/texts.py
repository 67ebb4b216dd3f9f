"""Queries on texts: response parsing and similarity, on texts made from parts, and on the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems as st
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import questions, similar
from ..sources.tables import table
from .registry import query

CHOICES = ["ECONOMY", "STANDARD", "PROMO", "LARGE"]
RESPONSES = """WITH responses AS (SELECT p_partkey, p_type AS truth, CASE p_partkey % 7 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) || '.' WHEN 2 THEN '1. economy 2. promo' WHEN 3 THEN 'economy or promo' WHEN 4 THEN '2 promo 1 large'
  WHEN 5 THEN p_name ELSE '1 standard 2 large 3 promo' END AS response FROM part),
cleaned AS (SELECT *, lower(regexp_replace(response, '[[:punct:]]', '', 'g')) AS r FROM responses),
marked AS (SELECT *, ['economy', 'standard', 'promo', 'large'] AS low, len(list_filter(['economy', 'standard', 'promo', 'large'], lambda c: contains(r, c))) AS present FROM cleaned),
listed AS (SELECT *, CASE WHEN len(regexp_extract_all(r, '\\d+')) >= 2 THEN list_filter(list_zip(regexp_extract_all(r, '(\\d+) ([a-z]+)', 1), regexp_extract_all(r, '(\\d+) ([a-z]+)', 2)), lambda p: list_contains(low, p[2])) ELSE [] END AS items FROM marked),
parsed AS (SELECT p_partkey, truth, response, CASE WHEN present = 1 AND list_contains(low, r) THEN upper(r) WHEN present > 1 AND len(items) >= 2 AND list_transform(items, lambda p: CAST(p[1] AS BIGINT)) = range(1, len(items) + 1) THEN items[1][2] END AS answer,
  CASE WHEN present = 1 AND list_contains(low, r) THEN 'exact_matching' WHEN present > 1 AND len(items) >= 2 AND list_transform(items, lambda p: CAST(p[1] AS BIGINT)) = range(1, len(items) + 1) THEN 'ranked_listing' ELSE 'not_parsed' END AS parse_type FROM listed)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    response = (
        F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lower("p_type"), F.lit("."))).when(k == 2, "1. economy 2. promo").when(k == 3, "economy or promo")
        .when(k == 4, "2 promo 1 large").when(k == 5, F.col("p_name")).otherwise("1 standard 2 large 3 promo")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("truth"), response.alias("response"))
    return rows.withColumn("p", tx.parsed(F.col("response"), F.array(*map(F.lit, CHOICES)))).select("p_partkey", "truth", "response", "p.answer", "p.parse_type")


@query(f"{RESPONSES} SELECT * FROM parsed")
def parse_response(spark, sf_dir):
    return parsed(spark, sf_dir)


@query(f"{RESPONSES} SELECT p_partkey, CAST(len(items) AS INTEGER) AS items, len(items) >= 2 AND list_transform(items, lambda p: CAST(p[1] AS BIGINT)) = range(1, len(items) + 1) AS is_listing FROM listed")
def numbered_listing(spark, sf_dir):
    items = tx.listing(tx.cleaned(F.col("response")), F.array(*map(F.lit, CHOICES)))
    return parsed(spark, sf_dir).select("p_partkey", F.size(items).alias("items"), tx.is_listing(items).alias("is_listing"))


@query(f"{RESPONSES} SELECT parse_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM parsed GROUP BY parse_type")
def parse_type_share(spark, sf_dir):
    counts = parsed(spark, sf_dir).groupBy("parse_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("parse_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"{RESPONSES} SELECT response, count(*) AS n FROM parsed WHERE parse_type = 'not_parsed' GROUP BY response ORDER BY n DESC, response LIMIT 10")
def invalid_top(spark, sf_dir):
    return parsed(spark, sf_dir).where("parse_type = 'not_parsed'").groupBy("response").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "response").limit(10)


PAIRS = """WITH pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
tok AS (SELECT conv_id, turn, question, answer, list_filter(regexp_split_to_array(lower(question), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS q, list_filter(regexp_split_to_array(lower(answer), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS a FROM pairs)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


Q, A = "question", "answer"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b})::DOUBLE END"


@query(f"{PAIRS} SELECT conv_id, turn, round({_share('len(list_intersect(list_distinct(q), list_distinct(a)))', 'len(list_distinct(list_concat(q, a)))')}, 6) AS jaccard FROM tok")
def jaccard(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.jaccard(tx.tokens(F.col(Q)), tx.tokens(F.col(A))), 6).alias("jaccard"))


PRF = f""",
p AS (SELECT conv_id, turn, {_share('shared', 'nq')} AS precision, {_share('shared', 'na')} AS recall FROM s)
SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM p"""


def _prf_sql(source: str) -> str:
    return f"{PAIRS}, {source}{PRF}"


def _prf(df, column):
    return df.select("conv_id", "turn", column.alias("m")).select("conv_id", "turn", *[F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_prf_sql("s AS (SELECT conv_id, turn, len(list_intersect(list_distinct(q), list_distinct(a))) AS shared, len(list_distinct(q)) AS nq, len(list_distinct(a)) AS na FROM tok)"))
def token_f1_set(spark, sf_dir):
    return _prf(pairs(spark, sf_dir), tx.token_f1_set(F.col(Q), F.col(A)))


MULTI = """s AS (SELECT t.conv_id, t.turn, coalesce(max(x.shared), 0) AS shared, max(len(t.{q})) AS nq, max(len(t.{a})) AS na FROM {t} t LEFT JOIN (
  SELECT conv_id, turn, sum(least(n1, n2)) AS shared FROM (SELECT conv_id, turn, w, count(*) AS n1 FROM (SELECT conv_id, turn, unnest({q}) AS w FROM {t}) GROUP BY ALL) JOIN
  (SELECT conv_id, turn, w, count(*) AS n2 FROM (SELECT conv_id, turn, unnest({a}) AS w FROM {t}) GROUP BY ALL) USING (conv_id, turn, w) GROUP BY conv_id, turn) x ON t.conv_id = x.conv_id AND t.turn = x.turn GROUP BY t.conv_id, t.turn)"""


@query(_prf_sql(MULTI.format(q="q", a="a", t="tok")))
def token_f1_multiset(spark, sf_dir):
    return _prf(pairs(spark, sf_dir), tx.token_f1_multiset(F.col(Q), F.col(A)))


@query(_prf_sql("g AS (SELECT conv_id, turn, list_transform(range(1, len(q)), lambda i: q[i] || ' ' || q[i + 1]) AS gq, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS ga FROM tok), " + MULTI.format(q="gq", a="ga", t="g")))
def rouge_2(spark, sf_dir):
    return _prf(pairs(spark, sf_dir), tx.rouge_n(F.col(Q), F.col(A), 2))


# the row of the table of longest common subsequences after i words of the question: a running maximum
LCS = f"""WITH RECURSIVE {PAIRS[5:]}, walk AS (SELECT conv_id, turn, q, a, 0 AS i, list_transform(range(len(a)), lambda j: CAST(0 AS BIGINT)) AS best FROM tok
  UNION ALL SELECT conv_id, turn, q, a, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
    SELECT *, list_transform(range(1, len(a) + 1), lambda j: CASE WHEN a[j] = q[i + 1] THEN 1 + CASE WHEN j > 1 THEN best[j - 1] ELSE 0 END ELSE best[j] END) AS cand FROM walk WHERE i < len(q))),
s AS (SELECT conv_id, turn, coalesce(list_max(best), 0) AS shared, len(q) AS nq, len(a) AS na FROM walk WHERE i = len(q))"""


@query(LCS + PRF)
def rouge_l(spark, sf_dir):
    return _prf(pairs(spark, sf_dir), tx.rouge_l(F.col(Q), F.col(A)))


@query(f"""{PAIRS}, g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(question) - 1), lambda i: substr(lower(question), i, 3))) AS q, list_distinct(list_transform(range(1, length(answer) - 1), lambda i: substr(lower(answer), i, 3))) AS a FROM pairs)
SELECT conv_id, turn, round({_share('len(list_intersect(q, a))', 'len(list_distinct(list_concat(q, a)))')}, 6) AS char_jaccard FROM g""")
def char_ngram(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.char_jaccard(F.col(Q), F.col(A), 3), 6).alias("char_jaccard"))


@query(f"{PAIRS} SELECT conv_id, turn, lower(trim(regexp_replace(question, '[[:punct:]]', '', 'g'))) = lower(trim(regexp_replace(answer, '[[:punct:]]', '', 'g'))) AS exact FROM pairs")
def exact_match(spark, sf_dir):
    clean = lambda c: F.lower(F.trim(tx.without_punctuation(F.col(c))))
    return pairs(spark, sf_dir).select("conv_id", "turn", (clean(Q) == clean(A)).alias("exact"))


@query(f"""{PAIRS}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS q, regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS a FROM pairs),
c1 AS (SELECT conv_id, turn, w, count(*) AS n1 FROM (SELECT conv_id, turn, unnest(q) AS w FROM w) GROUP BY ALL), c2 AS (SELECT conv_id, turn, w, count(*) AS n2 FROM (SELECT conv_id, turn, unnest(a) AS w FROM w) GROUP BY ALL),
j AS (SELECT conv_id, turn, w, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, CASE WHEN n1 IS NULL OR n2 IS NULL THEN ln(1.5) + 1 ELSE 1.0 END AS idf FROM c1 FULL JOIN c2 USING (conv_id, turn, w)),
s AS (SELECT conv_id, turn, sum(n1 * idf * n2 * idf) AS d, sqrt(sum(n1 * idf * n1 * idf)) * sqrt(sum(n2 * idf * n2 * idf)) AS l FROM j GROUP BY conv_id, turn)
SELECT p.conv_id, p.turn, round(coalesce(CASE WHEN l = 0 THEN 0.0 ELSE d / l END, 0.0), 6) AS cosine FROM pairs p LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn""")
def tfidf_pair(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.tfidf_cosine(F.col(Q), F.col(A)), 6).alias("cosine"))


@query(f"{PAIRS}, j AS (SELECT {_share('len(list_intersect(list_distinct(q), list_distinct(a)))', 'len(list_distinct(list_concat(q, a)))')} AS jaccard FROM tok) SELECT round(avg(jaccard), 6) AS mean_jaccard, count(*) AS n FROM j")
def similarity_summary(spark, sf_dir):
    return pairs(spark, sf_dir).agg(F.round(F.avg(tx.jaccard(tx.tokens(F.col(Q)), tx.tokens(F.col(A)))), 6).alias("mean_jaccard"), F.count("*").alias("n"))


@query("""SELECT p_partkey, replace('What type is the object in the red box? Choose from: {}', '{}', p_brand || ', ' || p_type || ' or ' || p_name) AS question FROM part""")
def question_text_templates(spark, sf_dir):
    options = tx.formatted_options(F.array("p_brand", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.filled(F.lit("What type is the object in the red box? Choose from: {}"), options).alias("question"))


@query("""WITH e AS (SELECT *, CAST('0x' || substr(md5('v|' || p_partkey), 1, 7) AS BIGINT) % 2 AS i FROM part)
SELECT p_partkey, p_name || '?' || chr(10) || 'Answer with one option, for example: ' || CASE i WHEN 0 THEN p_brand ELSE p_type END || chr(10) || 'Options: ' || p_brand || ' or ' || p_type || chr(10) || 'Focus on the front left camera.' AS prompt FROM e""")
def vlm_prompt(spark, sf_dir):
    prompt = questions.model_prompt(F.concat("p_name", F.lit("?")), F.array("p_brand", "p_type"), F.lit("FRONT_LEFT"), "v", F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@query("""SELECT p_partkey, to_json({'id': CAST(p_partkey AS VARCHAR), 'image': p_name || '.jpg', 'conversations': [{'from': 'human', 'value': '<image>' || chr(10) || 'Which type?' || chr(10) || 'Options: ' || p_brand || ' or ' || p_type}, {'from': 'gpt', 'value': p_type}]})::VARCHAR AS sample FROM part""")
def training_export(spark, sf_dir):
    image = questions.best_image(F.array(F.lit("a/b.jpg"), F.concat(F.lit("x/y/"), "p_name", F.lit(".jpg"))), F.array(F.lit("SIDE"), F.lit("FRONT")), F.lit(None).cast("string"))
    sample = questions.conversation(F.col("p_partkey").cast("string"), image, F.lit("Which type?"), F.array("p_brand", "p_type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", sample.alias("sample"))


@query("""SELECT o_orderkey, name, answer FROM (SELECT o_orderkey, 'status' AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS answer FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders) WHERE answer IS NOT NULL""")
def scene_prompts_unpivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    each = F.array(F.struct(F.lit("status").alias("name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("answer")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("answer")))
    return o.select("o_orderkey", F.explode(each).alias("q")).select("o_orderkey", "q.name", "q.answer").where("answer is not null")


@query("""WITH k(question_name, category) AS (VALUES ('ECONOMY', 'a'), ('PROMO', 'b'), ('STANDARD', 'b')) SELECT p_partkey, category FROM part JOIN k ON p_type = question_name""")
def question_kind_join(spark, sf_dir):
    kinds = spark.createDataFrame([("ECONOMY", "a"), ("PROMO", "b"), ("STANDARD", "b")], "p_type string, category string")
    return table(spark, sf_dir, "part").join(F.broadcast(kinds), "p_type").select("p_partkey", "category")


@query("SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ').png', '[^\\p{L}\\p{N}._-]', '', 'g') AS file FROM part")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.file_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(").png"))).alias("file"))


@query("""WITH k(p_type, category) AS (VALUES ('ECONOMY', 'a'), ('PROMO', 'b')) SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN (SELECT p_type FROM k) GROUP BY p_type""")
def unmapped_question_names(spark, sf_dir):
    kinds = spark.createDataFrame([("ECONOMY", "a"), ("PROMO", "b")], "p_type string, category string")
    return ev.unmapped(table(spark, sf_dir, "part"), kinds, "p_type")


STOP = ["the", "of", "and", "to", "de", "la", "der", "die"]


@query(f"{PAIRS} SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(q), lambda w: NOT list_contains({STOP}, w))), ' ') AS content FROM tok")
def stop_words_removed(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(tx.without_stop_words(tx.tokens(F.col(Q)), STOP)), " ").alias("content"))


@query("""WITH c AS (SELECT p_partkey, p_name, list_distinct(string_split(lower(p_name), ' ')) AS w, ['red widget', 'small ring', 'blue gear'] AS choices FROM part),
s AS (SELECT p_partkey, c.t, c.i, w, list_distinct(string_split(c.t, ' ')) AS v FROM (SELECT p_partkey, w, unnest(choices) AS t, generate_subscripts(choices, 1) AS i FROM c) c),
j AS (SELECT p_partkey, t, i, round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 9) AS s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, i) AS rn FROM j)
SELECT p_partkey, CASE WHEN s >= 0.3 THEN t END AS nearest FROM r WHERE rn = 1""")
def nearest_choice(spark, sf_dir):
    choices = F.array(*map(F.lit, ["red widget", "small ring", "blue gear"]))
    return table(spark, sf_dir, "part").select("p_partkey", tx.nearest_choice(F.col("p_name"), choices, 0.3).alias("nearest"))


NEAREST = r"""WITH w AS (SELECT doc_id, text, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS s FROM documents),
p AS (SELECT a.doc_id, b.text AS t, len(list_intersect(a.s, b.s)) AS shared, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS total FROM w a JOIN w b ON b.doc_id % 20 = 0 AND len(a.s) > 0 AND len(b.s) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared / total DESC, t) AS rn FROM p WHERE 100 * shared >= 60 * total)
SELECT w.doc_id, md5(t) AS nearest, round(shared / total, 9) AS similarity FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND rn = 1"""


@query(NEAREST)
def nearest_known_text(spark, sf_dir):
    """All documents against those whose id 20 divides, by their words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = tx.tokens(F.coalesce("text", F.lit("")))
    out = similar.nearest(d, d.where("doc_id % 20 = 0"), words, words, "text", 60)
    return out.select("doc_id", F.md5("nearest").alias("nearest"), F.round("similarity", 9).alias("similarity"))


def _stem_steps() -> list[str]:
    """The steps of a stem as CASE expressions on ``w``."""
    cut = lambda n: f"w[:length(w) - {n}]"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"

    def replaced(rules, condition):
        whens = "".join(f" WHEN suffix(w, '{s}') THEN CASE WHEN {has(cut(len(s)), condition)}{' AND ' + has(cut(len(s)), '[st]$') if s == 'ion' else ''} THEN {cut(len(s))} || '{n}' ELSE w END" for s, n in sorted(rules, key=lambda r: -len(r[0])))
        return f"CASE{whens} ELSE w END"

    double = "|".join(c + c for c in "bcdfghjkmnpqrtvwx")
    return [
        f"CASE WHEN {has('w', '(ss|i)es$')} THEN {cut(2)} WHEN {has('w', '[^s]s$')} THEN {cut(1)} ELSE w END AS w, false AS open",
        f"CASE WHEN suffix(w, 'eed') THEN CASE WHEN {has(cut(3), st.MORE_THAN_0)} THEN {cut(1)} ELSE w END WHEN suffix(w, 'ed') THEN CASE WHEN {has(cut(2), st.WITH_VOWEL)} THEN {cut(2)} ELSE w END"
        f" WHEN suffix(w, 'ing') AND {has(cut(3), st.WITH_VOWEL)} THEN {cut(3)} ELSE w END AS w, NOT suffix(w, 'eed') AND (suffix(w, 'ed') AND {has(cut(2), st.WITH_VOWEL)} OR suffix(w, 'ing') AND {has(cut(3), st.WITH_VOWEL)}) AS open",
        f"CASE WHEN NOT open THEN w WHEN {has('w', '(at|bl|iz)$')} OR {has('w', st.SHORT_END)} THEN w || 'e' WHEN {has('w', '(' + double + ')$')} THEN {cut(1)} ELSE w END AS w",
        f"CASE WHEN suffix(w, 'y') AND {has(cut(1), st.WITH_VOWEL)} THEN {cut(1)} || 'i' ELSE w END AS w",
        replaced(st.STEP_2, st.MORE_THAN_0) + " AS w",
        replaced(st.STEP_3, st.MORE_THAN_0) + " AS w",
        replaced([(x, "") for x in st.STEP_4], st.MORE_THAN_1) + " AS w",
        f"CASE WHEN suffix(w, 'e') AND ({has(cut(1), st.MORE_THAN_1)} OR ({has(cut(1), st.EXACTLY_1)} AND NOT {has(cut(1), st.SHORT_END)})) THEN {cut(1)} ELSE w END AS w",
        f"CASE WHEN suffix(w, 'll') AND {has('w', st.MORE_THAN_1)} THEN {cut(1)} ELSE w END AS w",
    ]


ENGLISH = ["running", "happily", "relational", "yes", "syzygy", "hopefulness", "controlled", "agreed", "flies", "adoption"]
STEMS = f"""WITH {PAIRS[5:]}, each AS (SELECT DISTINCT unnest(list_concat(q, {ENGLISH})) AS word FROM tok), s0 AS MATERIALIZED (SELECT word, CASE WHEN prefix(word, 'y') THEN 'Y' || word[2:] ELSE word END AS w FROM each WHERE regexp_matches(word, '^[a-z]{{3,}}$')),
{", ".join(f"s{k + 1} AS MATERIALIZED (SELECT word, {step} FROM s{k})" for k, step in enumerate(_stem_steps()))}
SELECT word, coalesce(lower(w), word) AS stem FROM each LEFT JOIN s{len(_stem_steps())} USING (word)"""


@query(STEMS)
def word_stems(spark, sf_dir):
    """Stems of the different words of all questions, and of a few English ones."""
    words = F.explode(F.array_distinct(F.concat(tx.tokens(F.col(Q)), F.array(*map(F.lit, ENGLISH))))).alias("word")
    return pairs(spark, sf_dir).select(words).distinct().select("word", st.stem(F.col("word")).alias("stem"))
