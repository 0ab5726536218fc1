"""The same results as SQL for DuckDB, written over the plain tables."""

from __future__ import annotations

from checks import views as v

R = v.RULES


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def sha_mod(key: str, modulus: str) -> str:
    digits = f"list_transform(string_split(sha256({key}), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT)"
    return f"list_reduce({digits}, lambda p, x: (p * 16 + x) % {modulus})"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(x):
        if isinstance(x, str):
            return q(x)
        if isinstance(x, list):
            return "[" + ", ".join(lit(i) for i in x) + "]::VARCHAR[]"
        return "NULL" if x is None else str(x)

    body = ", ".join("(" + ", ".join(lit(c) for c in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def text_list(texts: list[str]) -> str:
    return "[" + ", ".join(q(t) for t in texts) + "]"


UTT = f"""utt AS (
  SELECT doc_id AS row_id, text, lang AS intent, ({sentences('text')})[2] AS response,
         lang AS language, 'web' AS channel, source
  FROM documents)"""

MSG = "msg AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')"
ASK = f"{MSG}, ask AS (SELECT * FROM msg UNION ALL SELECT item_id + 1000000000, text FROM benchmark)"

PAIRS = """prs AS (
  SELECT a.conv_id * 1000 + a.turn AS row_id, a.text, b.text AS response
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

EXTERNAL = "ext AS (SELECT row_id, text, replace(lower(intent), ' ', '_') AS intent, response, 'en' AS language, 'mobile' AS channel, 'ext' AS source FROM utt)"
REGIONAL = "reg AS (SELECT row_id, text, ' IT ' AS intent, response, 'en' AS language, 'mobile' AS channel, 'regional_aug' AS source FROM prs)"

TEMPLATES = values("tpl", "intent, template", list(R.templates.items()))
GENERIC = values("gen", "intent, generic", list(R.generic.items()))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def trained(names: list[str]) -> str:
    """Evaluation rows of each model; it must reach the accuracy that ``views.LEAST_ACCURACY`` asks for."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS model, ceil(0.2 * count(*))::BIGINT AS eval_rows, true AS reached FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"
        for n in names
    )


def md5_order(seed: str, key: str) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR), {key}"


def split_ctes(out: str, src: str, label: str, key: str, seed: str, share: float, first: str, second: str) -> str:
    return f"""{out}_n AS (SELECT {label} AS lab, count(*) AS n FROM {src} GROUP BY 1),
{out}_t AS (SELECT sum(n)::BIGINT AS tot, sum(n)::BIGINT - ceil({share}::DOUBLE * sum(n))::BIGINT AS want FROM {out}_n),
{out}_s AS (SELECT lab, want, n * want / tot::DOUBLE AS sh, floor(n * want / tot::DOUBLE) AS fl FROM {out}_n, {out}_t),
{out}_q AS (SELECT lab, fl + CASE WHEN row_number() OVER (ORDER BY round(sh - fl, 10) DESC, lab)
                                     <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_s),
{out} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label} ORDER BY {md5_order(seed, 's.' + key)}) <= quota
                      THEN '{first}' ELSE '{second}' END AS split
          FROM {src} s JOIN {out}_q ON s.{label} = lab)"""


def plain_split(src: str, key: str, seed: str, share: float, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN row_number() OVER (ORDER BY {md5_order(seed, key)})
  <= count(*) OVER () - ceil({share}::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'eval' END AS split FROM {src}"""


# Routes

def route_sql(text: str) -> str:
    def any_of(patterns):
        return "(" + (" OR ".join(f"regexp_matches(lower({text}), {q(p)})" for p in patterns) or "false") + ")"

    cases = [
        f"WHEN {any_of(r['patterns'])} AND NOT {any_of(r['neg_patterns'])} THEN {q(r['intent'])}"
        for r in sorted(R.routes, key=lambda r: (-r["priority"], r["intent"]))
    ]
    return "CASE " + " ".join(cases) + " END"


JUDGED = f"{UTT}, jud AS (SELECT row_id, intent AS truth, coalesce({route_sql('text')}, 'other') AS predicted FROM utt)"

REPORT = f"""{JUDGED},
lab AS (SELECT truth AS label FROM jud UNION SELECT predicted FROM jud),
cls AS (SELECT label,
   (SELECT count(*) FROM jud WHERE truth = label AND predicted = label) AS hits,
   (SELECT count(*) FROM jud WHERE predicted = label) AS said,
   (SELECT count(*) FROM jud WHERE truth = label) AS support FROM lab),
sco AS (SELECT label, CASE WHEN said = 0 THEN 0 ELSE hits / said::DOUBLE END AS precision,
   CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END AS recall,
   CASE WHEN said + support = 0 THEN 0 ELSE 2 * hits / (said + support)::DOUBLE END AS f1, support, hits FROM cls),
rep AS (SELECT label, precision, recall, f1, support::BIGINT AS support FROM sco
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support)::BIGINT FROM sco
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM sco
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::BIGINT FROM sco)"""

# Composition

SHA_KEY = "coalesce(intent, '') || '|' || coalesce(text, '') || '|' || coalesce(source, '')"
BASES = {**{i: [t] for i, t in R.templates.items()}, **R.variants}
VARIANTS = values("var", "intent, variants", list(BASES.items()))
STOPS = text_list(R.stop_words)


def focus(x: str) -> str:
    longer = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: length(t) > 2)"
    kept = f"list_filter({longer}, lambda t: NOT list_contains({STOPS}, t))"
    return f"""CASE WHEN len({longer}) = 0 THEN 'your request'
      WHEN len({kept}) > 0 THEN array_to_string(({kept})[1:3], ' ') ELSE array_to_string(({longer})[1:3], ' ') END"""


def composed(src: str) -> str:
    """CTEs that end in ``com(row_id, source, composed)`` for ``src(row_id, text, intent, source)``."""
    return f"""{VARIANTS},
cm AS (SELECT s.*, {sha_mod(SHA_KEY.replace('intent', 's.intent'), '84')} AS m, {focus('text')} AS fo,
         coalesce(variants, [{q(R.default_response)}]) AS va FROM {src} s LEFT JOIN var ON s.intent = var.intent),
cb AS (SELECT *, {sentences('va[m % len(va) + 1]')} AS ba FROM cm),
cw AS (SELECT *, len(ba) AS nb, CASE WHEN source IN ({', '.join(q(s) for s in R.full_length_sources)}) THEN 3 ELSE 2 + m % 2 END AS target,
         replace({text_list(R.follow_ups)}[m % 4 + 1], '{{focus}}', fo) AS fu,
         {text_list(R.regionals)}[((m % 28) // 7) % 4 + 1] AS rg FROM cb),
com AS (SELECT *, CASE WHEN least(3 - nb, target - nb) <= 0 THEN array_to_string(ba[1:3], ' ')
         WHEN least(3 - nb, target - nb) = 1 THEN array_to_string(ba, ' ') || ' ' || fu
         ELSE array_to_string(ba, ' ') || ' ' || fu || ' ' || rg END AS composed FROM cw)"""


# Fill


def fill(src: str, first: str) -> str:
    """CTE ``lack(place, intent, template, need, i)`` from the counts of ``src``."""
    known = values("known", "place, intent, template", [(p, i, t) for p, (i, t) in enumerate(R.templates.items())])
    return f"""{known},
lack AS (SELECT k.place, k.intent, k.template, unnest(range(0, greatest(0, {v.MIN_PER_INTENT} - coalesce(h.n, 0)))) AS i
  FROM known k LEFT JOIN (SELECT intent, count(*) AS n FROM {src} GROUP BY 1) h ON k.intent = h.intent)"""


PATTERNS = values("pat", "intent, patterns", [(i, R.patterns.get(i, [i.replace("_", " ")])) for i in R.templates])
SEEDED = f"""SELECT l.place * {v.MIN_PER_INTENT} + l.i AS row_id, pat.patterns[l.i % len(pat.patterns) + 1] || ' sample_' || (l.i + 1) AS text,
  l.intent, l.template AS response, 'en' AS language, 'mobile' AS channel, 'synthetic_seed' AS source
  FROM lack l JOIN pat ON l.intent = pat.intent"""


def cleaned(src: str, extra: str = "") -> str:
    return f"""(SELECT * FROM (SELECT {extra} row_id, {clean('text')} AS text, replace(lower({strip('intent')}), ' ', '_') AS intent,
  {strip('response')} AS response, language, channel, source FROM {src} WHERE text IS NOT NULL)
  WHERE length(text) > 2 AND length(intent) > 0)"""


def focus_where(text: str) -> str:
    found = " OR ".join(f"contains(lower({text}), {q(k.lower())})" for k in R.keywords)
    return f"(lower(source) = {q(R.focus_source)} OR {found})"


LAST = {label: core for core, labels in R.taxonomy.items() for label in labels}
TAXONOMY = values("tax", "src_label, core_intent", list(LAST.items()))
TAX_TEMPLATES = values("ttp", "intent, template", list(v.TAXONOMY_TEMPLATES.items()))

# Preparation

PREPARED = f"""{UTT}, {PAIRS}, {EXTERNAL}, {REGIONAL}, {TEMPLATES}, {PATTERNS},
uni AS (SELECT row_id AS position, * FROM ext UNION ALL SELECT row_id + (1::BIGINT << 56), * FROM reg),
cln AS {cleaned('uni', 'position,')},
kno AS (SELECT * FROM cln WHERE intent IN (SELECT intent FROM tpl)),
{fill('kno', 'tpl')},
fil AS (SELECT * FROM kno UNION ALL SELECT row_id + (2::BIGINT << 56), * FROM ({SEEDED})),
ded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY text, intent ORDER BY position) AS rn FROM fil) WHERE rn = 1),
{split_ctes('s1', 'ded', 'intent', 'position', '42', 0.2, 'train', 'eval')},
hld AS (SELECT * EXCLUDE (split) FROM s1 WHERE split = 'eval'),
{split_ctes('s2', 'hld', 'intent', 'position', '42|held', 0.5, 'val', 'test')},
pre AS (SELECT * FROM s1 WHERE split = 'train' UNION ALL SELECT * FROM s2)"""

# Features

WORDS = r"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}_]{{2,}}')"


def word_grams(x: str) -> str:
    words = WORDS.format(x=x)
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: ({words})[i] || ' ' || ({words})[i + 1]))"


def bag(out: str, src: str, key: str, keep: str = "") -> str:
    """CTE ``out(key, keep, term, tf)`` of words and word pairs."""
    keep = keep and ", " + keep
    return f"""{out}_w AS (SELECT {key}{keep}, {WORDS.format(x='text')} AS w FROM {src}),
{out}_g AS (SELECT {key}{keep}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {out}_w),
{out} AS (SELECT {key}{keep}, term, count(*) AS tf FROM {out}_g GROUP BY ALL)"""


def char_bag(out: str, src: str, key: str, keep: str = "") -> str:
    keep = keep and ", " + keep
    return rf"""{out}_f AS (SELECT {key}{keep}, regexp_replace(lower(text), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]{{2,}}', ' ', 'g') AS t FROM {src}),
{out}_c AS (SELECT {key}{keep}, unnest(string_split(t, '')) AS c, unnest(range(0, length(t))) AS i FROM {out}_f),
{out}_n AS (SELECT {key}{keep}, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3 FROM {out}_c WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{out}_g AS (SELECT {key}{keep}, c || c2 AS term FROM {out}_n WHERE c2 IS NOT NULL
  UNION ALL SELECT {key}{keep}, c || c2 || c3 FROM {out}_n WHERE c3 IS NOT NULL),
{out} AS (SELECT {key}{keep}, term, count(*) AS tf FROM {out}_g GROUP BY ALL)"""


def model(train: str) -> str:
    """Naive Bayes over ``train(row_id, intent, text)``: ``voc``, ``nbc`` (classes), ``nbt`` (theta)."""
    return f"""{bag('tb', train, 'row_id', 'intent')},
nn AS (SELECT count(*) AS n FROM {train}),
voc AS (SELECT term, ln((1 + any_value(nn.n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tb, nn GROUP BY term),
tw AS (SELECT row_id, intent, term, tf * idf AS u FROM tb JOIN voc USING (term)),
tl AS (SELECT row_id, sqrt(sum(u * u)) AS len FROM tw GROUP BY 1),
ts AS (SELECT intent, term, sum(u / len) AS s FROM tw JOIN tl USING (row_id) GROUP BY 1, 2),
vv AS (SELECT count(*) AS v FROM voc),
nbc AS (SELECT c.intent, ln(c.n / nn.n::DOUBLE) AS prior, coalesce(z.s, 0) + 0.5 * vv.v AS total
  FROM (SELECT intent, count(*) AS n FROM {train} GROUP BY 1) c
  LEFT JOIN (SELECT intent, sum(s) AS s FROM ts GROUP BY 1) z ON c.intent = z.intent, nn, vv)"""


def predictions(out: str, src: str, key: str) -> str:
    """CTE ``out(key, predicted_intent, confidence)`` for ``src(key, text)``."""
    return f"""{bag(out + '_b', src, key)},
{out}_u AS (SELECT {key}, term, tf * idf AS u FROM {out}_b JOIN voc USING (term)),
{out}_l AS (SELECT {key}, sqrt(sum(u * u)) AS len, sum(u) AS tot FROM {out}_u GROUP BY 1),
{out}_h AS (SELECT b.{key}, ts.intent, sum(b.u * (ln(ts.s + 0.5) - ln(0.5::DOUBLE))) AS lift
  FROM {out}_u b JOIN ts USING (term) GROUP BY 1, 2),
{out}_c AS (SELECT k.{key}, c.intent, round(c.prior + coalesce((coalesce(h.lift, 0) + l.tot * (ln(0.5::DOUBLE) - ln(c.total))) / l.len, 0), 10) AS sc
  FROM {src} k CROSS JOIN nbc c LEFT JOIN {out}_l l ON l.{key} = k.{key}
  LEFT JOIN {out}_h h ON h.{key} = k.{key} AND h.intent = c.intent),
{out}_m AS (SELECT {key}, max(sc) AS top FROM {out}_c GROUP BY 1),
{out} AS (SELECT s.{key}, min(s.intent) FILTER (s.sc = m.top) AS predicted_intent, 1 / sum(exp(s.sc - m.top)) AS confidence
  FROM {out}_c s JOIN {out}_m m ON s.{key} = m.{key} GROUP BY 1)"""


# Retrieval over ``utt`` as examples and ``aq(qid, intent, text)`` as questions.
INDEX = f"""{char_bag('eb', 'utt', 'row_id', 'intent')},
en AS (SELECT intent, count(*) AS n, min(row_id) AS first_id FROM utt GROUP BY 1),
ev AS (SELECT eb.intent, eb.term, ln((1 + any_value(en.n)) / (1 + count(*))::DOUBLE) + 1 AS idf
  FROM eb JOIN en USING (intent) GROUP BY 1, 2),
eu AS (SELECT row_id, intent, term, tf * idf AS u FROM eb JOIN ev USING (intent, term)),
el AS (SELECT row_id, sqrt(sum(u * u)) AS len FROM eu GROUP BY 1),
ew AS (SELECT row_id, intent, term, u / len AS w FROM eu JOIN el USING (row_id))"""

SIMS = f"""{char_bag('qb', 'aq', 'qid', 'intent')},
qu AS (SELECT qid, intent, term, tf * idf AS u FROM qb JOIN ev USING (intent, term)),
ql AS (SELECT qid, sqrt(sum(u * u)) AS len FROM qu GROUP BY 1),
qw AS (SELECT qid, intent, term, u / len AS w FROM qu JOIN ql USING (qid)),
sims AS (SELECT qw.qid, ew.row_id AS ex_id, round(sum(qw.w * ew.w), 10) AS sim
  FROM qw JOIN ew USING (intent, term) GROUP BY 1, 2)"""

TOP = """rnk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, ex_id) AS rn FROM sims),
top AS (SELECT aq.qid, aq.intent, coalesce(r.ex_id, en.first_id) AS ex_id, coalesce(r.sim, 0) AS sim
  FROM aq JOIN en USING (intent) LEFT JOIN (SELECT * FROM rnk WHERE rn = 1) r ON r.qid = aq.qid)"""


def found(questions: str, routed: bool = False, tables: str = f"{UTT}, {ASK}", train: str = "utt", generic: str = GENERIC) -> str:
    """CTEs that end in ``fnd``: predictions with match, first example and general answer; ``utt`` holds the examples."""
    intent = f"coalesce({route_sql('k.text')}, p.predicted_intent)" if routed else "p.predicted_intent"
    return f"""{tables}, {model(train)}, {predictions('prd', questions, 'qid')},
rou AS (SELECT k.qid, k.text, {intent} AS predicted_intent, p.confidence FROM prd p JOIN {questions} k ON k.qid = p.qid),
aq AS (SELECT qid, predicted_intent AS intent, text FROM rou WHERE confidence >= 0.40),
{INDEX}, {SIMS}, {TOP}, {generic},
fnd AS (SELECT r.*, t.sim, m.text AS match_text, m.response AS match_response, f.text AS first_text, f.response AS first_response,
    f.row_id AS first_id, gen.generic
  FROM rou r LEFT JOIN top t ON t.qid = r.qid LEFT JOIN utt m ON m.row_id = t.ex_id
  LEFT JOIN en ON en.intent = r.predicted_intent LEFT JOIN utt f ON f.row_id = en.first_id
  LEFT JOIN gen ON gen.intent = r.predicted_intent)"""


LADDER = f"""CASE WHEN confidence < 0.40 THEN {q(R.clarification)}
  WHEN first_id IS NULL THEN coalesce(generic, {q(R.no_information)})
  WHEN sim < 0.60 THEN coalesce(generic, first_response) ELSE match_response END AS response,
 CASE WHEN confidence < 0.40 THEN 'confidence' WHEN first_id IS NULL THEN 'generic_intent'
  WHEN sim < 0.60 THEN 'similarity' ELSE 'none' END AS fallback_type"""

# Of ``found``, what the evaluation form answers.
REPORT_STEPS = """lad AS (SELECT *, confidence < 0.40 AS low, coalesce(sim, 0) AS s,
  CASE WHEN coalesce(sim, 0) >= 0.10 THEN match_response ELSE first_response END AS own,
  CASE WHEN coalesce(sim, 0) >= 0.10 THEN match_text ELSE first_text END AS lik FROM fnd),
swp AS (SELECT *, s < 0.60 AND generic IS NOT NULL AND generic IS DISTINCT FROM own AS swap FROM lad)"""
REPORT = f"""SELECT qid, text AS question, predicted_intent, printf('%.4f', confidence) AS intent_confidence,
 CASE WHEN low THEN 'N/A (confidence too low)' ELSE lik END AS similar_question,
 printf('%.4f', CASE WHEN low THEN 0 ELSE s END) AS similarity_score,
 CASE WHEN low THEN {q(R.clarification)} WHEN swap THEN generic ELSE own END AS response,
 CASE WHEN low THEN 'confidence' WHEN swap THEN 'similarity' ELSE 'none' END AS fallback_type FROM swp"""

# Documents with English cut in three, those with examples, and questions that know no word.
PARTED = f"""{UTT.replace('utt AS', 'utp AS')},
trn AS (SELECT * REPLACE (CASE WHEN intent <> 'en' THEN intent WHEN k < 14 THEN 'en low' WHEN k < 17 THEN 'en mid' ELSE 'en high' END AS intent)
  FROM (SELECT *, try_cast(regexp_extract(source, '[0-9]+') AS INT) AS k FROM utp)),
utt AS (SELECT * FROM trn WHERE intent NOT IN ({', '.join(q(name) for name in v.UNINDEXED)})), {ASK},
shq AS (SELECT * FROM ask UNION ALL SELECT p_partkey + 2000000000, p_name || ' der le el' FROM part UNION ALL SELECT c_custkey + 3000000000, c_name FROM customer)"""
RUNGS = found("shq", tables=PARTED, train="trn", generic=values("gen", "intent, generic", list(v.RUNG_RULES.generic.items())))

ASKED = f"""{UTT}, {ASK}, {model('utt')}, {predictions('prd', 'ask', 'qid')},
aq AS (SELECT p.qid, p.predicted_intent AS intent, k.text FROM prd p JOIN ask k ON k.qid = p.qid),
{INDEX}, {SIMS}"""


def summary(weights: str, key: str) -> str:
    return f"""r AS (SELECT {key}, term, round(w, 10) AS w FROM {weights}),
b AS (SELECT {key}, max(w) AS best FROM r GROUP BY 1)
SELECT r.{key}, count(*) AS n_terms, round(sum(r.w), 5) AS weight_sum, round(max(r.w), 6) AS weight_max,
  min(r.term) FILTER (r.w = b.best) AS top_term FROM r JOIN b ON r.{key} = b.{key} GROUP BY 1"""


NAMES = values("nam", "label, label_name", list(enumerate(v.LABEL_NAMES)))
CLASSES = values("cla", "label, label_name", list(enumerate(v.CLASS_NAMES)))
EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
SOFT = f"""{EMB}, top AS (SELECT vec_id, e, list_max(e) AS m FROM emb),
sft AS (SELECT vec_id, (list_position(e, m) - 1)::INT AS place, 1 / list_sum(list_transform(e, lambda x: exp(x - m))) AS p FROM top)"""

USABLE = "usb AS (SELECT row_id AS position, * FROM utt WHERE text IS NOT NULL AND response IS NOT NULL)"
PAIR_FIRST = """pfi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text || ' || ' || response ORDER BY position) AS rn FROM usb) WHERE rn = 1)"""

IDS = rf"list_transform(string_split({clean('text')}, ' '), lambda t: length(t))"

SQL: dict[str, str] = {
    "external_alias_load": with_(UTT, EXTERNAL) + "SELECT * FROM ext",
    "source_defaults": with_(PAIRS, REGIONAL) + "SELECT * FROM reg",
    "taxonomy_load": with_(TAXONOMY, TAX_TEMPLATES)
    + """SELECT b.row_id, b.text, t.core_intent AS intent, p.template AS response, 'en' AS language, 'mobile' AS channel, 'benchmark' AS source
FROM (SELECT doc_id AS row_id, text, source AS label_name FROM documents
      UNION ALL SELECT item_id + (1::BIGINT << 55), text, 'src' || (item_id % 20) FROM benchmark) b
JOIN tax t ON b.label_name = t.src_label LEFT JOIN ttp p ON p.intent = t.core_intent""",
    "label_name_lookup": with_(NAMES) + "SELECT vec_id, e.label, label_name FROM embeddings e JOIN nam ON nam.label = e.label",
    "clean_text": f"SELECT doc_id AS row_id, {clean('text')} AS text FROM documents",
    "normalize_intent": f"""SELECT doc_id AS row_id, replace(lower({strip("'  ' || lang || ' ' || source || chr(9)")}), ' ', '_') AS intent FROM documents""",
    "length_filter": f"SELECT * FROM (SELECT doc_id AS row_id, {clean('text')} AS text FROM documents) WHERE length(text) > 400",
    "focus_filter": f"SELECT doc_id AS row_id, source, text FROM documents WHERE {focus_where('text')}",
    "allowlist_semi": "SELECT doc_id AS row_id, lang AS intent FROM documents WHERE lang IN ('en', 'es', 'xx')",
    "taxonomy_map": with_(TAXONOMY, TAX_TEMPLATES)
    + """SELECT doc_id AS row_id, text, core_intent AS intent, template AS response, 'en' AS language, 'mobile' AS channel, 'docs' AS source
FROM documents JOIN tax ON source = src_label LEFT JOIN ttp ON ttp.intent = core_intent""",
    "default_response": with_(UTT, TEMPLATES, "w AS (SELECT row_id, CASE WHEN source = 'src5' THEN 'none' ELSE intent END AS intent, response FROM utt)")
    + f"SELECT row_id, w.intent, coalesce(response, template, {q(R.default_response)}) AS response FROM w LEFT JOIN tpl ON tpl.intent = w.intent",
    "class_label_lookup": with_(NAMES)
    + "SELECT vec_id, e.label, CASE WHEN e.label < 7 THEN label_name ELSE e.label::VARCHAR END AS class FROM embeddings e LEFT JOIN nam ON nam.label = e.label",
    "keyword_route": with_(UTT, ASK, model("utt"), predictions("prd", "ask", "qid"))
    + f"SELECT p.qid, coalesce({route_sql('k.text')}, predicted_intent) AS predicted_intent, ({route_sql('k.text')} IS NOT NULL)::INT AS routed FROM prd p JOIN ask k ON k.qid = p.qid",
    "split_leakage": with_(UTT, f"spl AS ({plain_split('utt', 'row_id', '42', 0.2, '*')})")
    + f"SELECT row_id, ({strip('lower(text)')} IN (SELECT {strip('lower(text)')} FROM spl WHERE split = 'train'))::INT AS leaked FROM spl WHERE split = 'eval'",
    "intent_counts": with_(UTT, TEMPLATES, f"cln AS {cleaned('utt')}")
    + "SELECT intent, count(DISTINCT text) AS n FROM cln WHERE intent IN (SELECT intent FROM tpl) GROUP BY 1",
    "source_counts": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "dataset_stats": with_(PREPARED)
    + """SELECT 'rows' AS kind, 'total' AS key, count(*) AS value FROM pre UNION ALL SELECT 'rows', split, count(*) FROM pre GROUP BY split
UNION ALL SELECT 'intent', intent, count(*) FROM pre GROUP BY intent UNION ALL SELECT 'source', source, count(*) FROM pre GROUP BY source
UNION ALL SELECT 'intents', 'distinct', count(DISTINCT intent) FROM pre UNION ALL SELECT 'mode', 'focus', 0""",
    "corpus_stats": with_(UTT, USABLE, PAIR_FIRST)
    + """SELECT 'rows' AS measure, count(*) AS value FROM utt UNION ALL SELECT 'usable', count(*) FROM usb UNION ALL SELECT 'final', count(*) FROM pfi
UNION ALL SELECT 'intents', count(DISTINCT intent) FROM pfi UNION ALL SELECT 'duplicates', (SELECT count(*) FROM usb) - (SELECT count(*) FROM pfi)""",
    "null_drop": with_(UTT) + "SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR response IS NULL) AS dropped FROM utt",
    "response_pool": with_(UTT)
    + f"SELECT DISTINCT intent, {strip('response')} AS response FROM utt WHERE {strip('response')} <> ''",
    "csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "jsonl_roundtrip": "SELECT conv_id, turn, role, text FROM conversations",
    "answer_table_roundtrip": with_(UTT) + "SELECT intent, row_number() OVER (PARTITION BY intent ORDER BY row_id) - 1 AS ex_idx, text, response FROM utt",
    **{name: trained(names) for name, names in {"logreg": ["logreg"], "svm": ["svm"]}.items()},
    "answer_table": with_(UTT) + "SELECT intent, row_number() OVER (PARTITION BY intent ORDER BY row_id) - 1 AS ex_idx, text, response FROM utt",
    "accuracy": with_(JUDGED) + "SELECT round(avg((truth = predicted)::INT), 6) AS accuracy FROM jud",
    "classification_report": with_(REPORT)
    + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep",
    "macro_f1": with_(REPORT) + "SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro FROM sco",
    "confusion_matrix": with_(JUDGED) + "SELECT truth, predicted, count(*) AS n FROM jud GROUP BY 1, 2",
    "confusion_pivot": with_(JUDGED)
    + "SELECT truth, "
    + ", ".join(f"count(*) FILTER (predicted = '{c}') AS \"{c}\"" for c in ["de", "en", "es", "fr", "other"])
    + " FROM jud GROUP BY 1",
    "metrics_long": with_(REPORT)
    + " UNION ALL ".join(f"SELECT label || '.{m}' AS metric, round({m}, 6) AS value FROM rep" for m in ("precision", "recall", "f1")),
    "best_model": """WITH j AS (SELECT quality, toxic, lang FROM labels JOIN documents USING (doc_id)),
m AS (SELECT 0 AS place, 'logreg' AS model, avg((quality = (lang = 'en')::INT)::INT) AS accuracy FROM j
  UNION ALL SELECT 1, 'naive_bayes', avg((quality = 1 - toxic)::INT) FROM j UNION ALL SELECT 2, 'svm', avg((quality = 1 - toxic)::INT) FROM j)
SELECT model, round(accuracy, 6) AS accuracy FROM m ORDER BY m.accuracy DESC, place LIMIT 1""",
    "perplexity": """WITH l AS (SELECT event_type, value / 8 AS loss FROM events),
g AS (SELECT event_type, avg(loss) AS m, avg(CASE WHEN loss < 50 THEN exp(loss) ELSE 'inf'::DOUBLE END) AS p FROM l GROUP BY 1)
SELECT event_type, round(m, 6) AS eval_loss, round(CASE WHEN m < 50 THEN exp(m) ELSE 'inf'::DOUBLE END, 6) AS eval_perplexity,
  CASE WHEN p < 'inf'::DOUBLE THEN round(ln(p), 6) END AS ln_mean_perplexity FROM g""",
    "class_weights": """WITH c AS (SELECT lang AS intent, count(*) AS n FROM documents GROUP BY 1)
SELECT intent, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM c""",
    "dedup_first": with_(UTT)
    + """SELECT position, row_id, intent, source FROM (SELECT *, row_number() OVER (PARTITION BY text, intent ORDER BY position) AS rn FROM
 (SELECT row_id AS position, row_id, text, intent, source FROM utt UNION ALL SELECT row_id + (1::BIGINT << 56), row_id, text, intent, 'second' FROM utt)) WHERE rn = 1""",
    "dedup_pair": with_(UTT, USABLE, PAIR_FIRST) + "SELECT position, text, response FROM pfi",
    "seeded_sample": f"SELECT doc_id AS row_id, lang AS intent FROM documents ORDER BY {md5_order('42', 'doc_id')} LIMIT 150",
    "stratified_split": with_(UTT, split_ctes("s1", "utt", "intent", "row_id", "42", 0.2, "train", "eval"))
    + "SELECT row_id, intent, split FROM s1",
    "three_way_split": with_(
        UTT,
        split_ctes("s1", "utt", "intent", "row_id", "42", 0.2, "train", "eval"),
        "hld AS (SELECT * EXCLUDE (split) FROM s1 WHERE split = 'eval')",
        split_ctes("s2", "hld", "intent", "row_id", "42|held", 0.5, "val", "test"),
    )
    + "SELECT row_id, intent, split FROM s1 WHERE split = 'train' UNION ALL SELECT row_id, intent, split FROM s2",
    "split_fallback": with_(UTT) + plain_split("utt", "row_id", "42", 0.2, "row_id"),
    "random_split": with_(UTT) + plain_split("utt", "row_id", "42", 0.1, "row_id"),
    "argmax_class": with_(EMB)
    + "SELECT vec_id, 'c' || lpad((list_position(e, list_max(e)) - 1)::VARCHAR, 2, '0') AS class, round(list_max(e), 6) AS score FROM emb",
    "positions": with_(ASK) + "SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM ask",
    "preview": with_(ASK)
    + "SELECT qid, substr(text, 1, 80) || '...' AS short, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS line FROM ask",
    "union_sources": with_(UTT, PAIRS, EXTERNAL, REGIONAL)
    + """SELECT row_id AS position, row_id, intent, language, channel, source FROM ext
UNION ALL SELECT row_id + (1::BIGINT << 56), row_id, intent, language, channel, source FROM reg""",
    "synthetic_fill": with_(UTT, f"cln AS {cleaned('utt')}", PATTERNS, fill("cln", "tpl")) + SEEDED,
    "synthetic_fill_focus": with_(UTT, f"cln AS {cleaned('utt')}", f"fcs AS (SELECT * FROM cln WHERE {focus_where('text')})", fill("fcs", "tpl"))
    + f"""SELECT place * {v.MIN_PER_INTENT} + i AS row_id, replace(replace({q(R.focus_format)}, '{{words}}', replace(intent, '_', ' ')), '{{number}}', (i + 1)::VARCHAR) AS text,
 intent, template AS response, 'en' AS language, 'mobile' AS channel, {q(R.focus_seed_source)} AS source FROM lack""",
    "hash_pick": with_(UTT, VARIANTS, f"k AS (SELECT *, {SHA_KEY} AS key FROM utt)")
    + f"""SELECT row_id, {sha_mod('key', '84')} AS m, coalesce(variants, [{q(R.default_response)}])[{sha_mod('key', "len(coalesce(variants, ['x']))")} + 1] AS variant
FROM k LEFT JOIN var ON var.intent = k.intent""",
    "focus_phrase": f"SELECT doc_id AS row_id, {focus(clean('text'))} AS focus FROM documents",
    "sentence_split": f"""WITH s AS (SELECT doc_id AS row_id, {sentences('text')} AS l FROM documents)
SELECT row_id, unnest(range(0, len(l))) AS at, unnest(l) AS sentence FROM s""",
    "compose_response": with_(UTT, f"src AS (SELECT row_id, {clean('text')} AS text, intent, source FROM utt)", composed("src"))
    + "SELECT row_id, composed FROM com",
    "diversify_responses": with_(UTT, f"src AS (SELECT row_id, {clean('text')} AS text, intent, 'unknown' AS source FROM utt)", composed("src"))
    + "SELECT row_id, source, composed AS response FROM com",
    "corpus_prompt_response": with_(UTT) + "SELECT text AS prompt, response, intent AS category FROM utt",
    "lm_corpus": with_(UTT, USABLE, PAIR_FIRST)
    + f"SELECT position, 'Intent: ' || {strip('intent')} || chr(10) || 'User: ' || {strip('text')} || chr(10) || 'Assistant: ' || {strip('response')} AS text FROM pfi",
    "lm_corpus_eval": f"SELECT doc_id AS position, 'User: ' || {strip('text')} AS text FROM documents WHERE text IS NOT NULL",
    "format_prompt": with_(PAIRS)
    + f"SELECT row_id, 'User: ' || {strip('text')} || chr(10) || 'Assistant: ' || {strip('response')} || '<|endoftext|>' AS text FROM prs",
    "format_eval_prompt": f"""SELECT doc_id AS row_id, CASE WHEN lang <> 'es' THEN 'Intent: ' || lang || chr(10) ELSE '' END || 'User: ' || {strip('text')} AS text FROM documents""",
    "corpus_unify": with_(PAIRS)
    + "SELECT 'User: ' || text || chr(10) || 'Assistant: ' || response || '<|endoftext|>' AS text FROM prs UNION ALL SELECT text FROM documents WHERE text IS NOT NULL",
    "extract_reply": with_(PAIRS, f"m AS (SELECT row_id, 'User: ' || {strip('text')} || chr(10) || 'Assistant: ' || {strip('response')} AS text FROM prs UNION ALL SELECT doc_id + 1000000000, text FROM documents)")
    + f"SELECT row_id, CASE WHEN contains(text, 'Assistant:') THEN {strip("substr(text, instr(text, 'Assistant:') + 10)")} ELSE text END AS reply FROM m",
    "word_ngrams": with_(ASK, f"g AS (SELECT qid, {word_grams('text')} AS l FROM ask)")
    + "SELECT qid, unnest(range(0, len(l))) AS at, unnest(l) AS gram FROM g",
    "char_ngrams": with_(ASK, char_bag("cb", "ask", "qid")) + "SELECT qid, term AS gram, tf FROM cb",
    "tfidf_word": with_(
        UTT,
        bag("tb", "utt", "row_id"),
        "nn AS (SELECT count(*) AS n FROM utt)",
        "voc AS (SELECT term, ln((1 + any_value(nn.n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tb, nn GROUP BY term)",
        "tw AS (SELECT row_id, term, tf * idf AS u FROM tb JOIN voc USING (term))",
        "tl AS (SELECT row_id, sqrt(sum(u * u)) AS len FROM tw GROUP BY 1)",
        "wt AS (SELECT row_id, term, u / len AS w FROM tw JOIN tl USING (row_id))",
        summary("wt", "row_id"),
    ),
    "tfidf_char": with_(
        UTT,
        INDEX,
        r"rp AS (SELECT min(row_id) AS ex_id FROM utt GROUP BY intent, regexp_replace(lower(text), '\s{2,}', ' ', 'g'))",
        "wt AS (SELECT row_id AS ex_id, term, w FROM ew WHERE row_id IN (SELECT ex_id FROM rp))",
        summary("wt", "ex_id"),
    ),
    "naive_bayes": with_(
        UTT,
        split_ctes("s1", "utt", "intent", "row_id", "42", 0.2, "train", "eval"),
        "trn AS (SELECT row_id, intent, text FROM s1 WHERE split = 'train')",
        "hld AS (SELECT row_id, intent, text FROM s1 WHERE split = 'eval')",
        model("trn"),
        predictions("prd", "hld", "row_id"),
    )
    + "SELECT p.row_id, h.intent, predicted_intent, round(confidence, 6) AS confidence FROM prd p JOIN hld h ON h.row_id = p.row_id",
    "predict_batch": with_(UTT, ASK, model("utt"), predictions("prd", "ask", "qid"))
    + "SELECT qid, predicted_intent, round(confidence, 6) AS confidence FROM prd",
    "sigmoid_confidence": with_(EMB) + "SELECT vec_id, round(1 / (1 + exp(-list_max(e))), 6) AS confidence FROM emb",
    "softmax_argmax": with_(SOFT) + "SELECT vec_id, place, round(p, 6) AS confidence FROM sft",
    "score_logits": with_(SOFT, CLASSES)
    + "SELECT vec_id, coalesce(label_name, place::VARCHAR) AS predicted_intent, round(p, 6) AS confidence FROM sft LEFT JOIN cla ON label = place",
    "pad_truncate": f"""WITH i AS (SELECT doc_id AS row_id, {IDS} AS l FROM documents)
SELECT row_id, array_to_string(list_concat(l, list_transform(range(0, 128), lambda x: 0))[1:128], ',') AS ids,
 repeat('1', least(len(l), 128)::INT) || repeat('0', 128 - least(len(l), 128)::INT) AS mask FROM i""",
    "label_encode": """SELECT doc_id AS row_id, lang AS intent, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS label_id,
 (dense_rank() OVER (ORDER BY lang) - 1)::INT AS eval_id FROM documents""",
    "similarity_top1": with_(ASKED, TOP) + "SELECT qid, intent, ex_id, round(sim, 6) AS sim FROM top",
    "similarity_join": with_(
        ASKED,
        r"rp AS (SELECT min(row_id) AS ex_id, count(*) AS copies FROM utt GROUP BY intent, regexp_replace(lower(text), '\s{2,}', ' ', 'g'))",
    )
    + "SELECT qid, s.ex_id, round(sim, 6) AS sim, copies FROM sims s JOIN rp ON rp.ex_id = s.ex_id WHERE sim >= 0.60",
    "first_example": with_(UTT)
    + "SELECT intent, row_id AS ex_id, text, response FROM utt WHERE row_id IN (SELECT min(row_id) FROM utt GROUP BY intent)",
    "answer_batch": with_(found("ask"))
    + f"SELECT qid, predicted_intent, round(confidence, 6) AS confidence, round(sim, 6) AS sim, {LADDER} FROM fnd",
    "answer_routed": with_(found("ask", routed=True)) + f"SELECT qid, predicted_intent, round(sim, 6) AS sim, {LADDER} FROM fnd",
    "answer_batch_report": with_(found("ask"), REPORT_STEPS) + REPORT,
    "answer_rungs": with_(RUNGS)
    + f"SELECT qid, predicted_intent, round(confidence, 6) AS confidence, round(sim, 6) AS sim, {LADDER} FROM fnd",
    "answer_rungs_report": with_(RUNGS, REPORT_STEPS) + REPORT,
    "answer_stream": with_(
        found("msk").replace(MSG, MSG + rf", msk AS (SELECT qid, text FROM (SELECT qid, {strip('text')} AS text FROM msg) WHERE text <> '' AND lower(text) NOT IN ('exit', 'quit'))")
    )
    + f"SELECT qid, predicted_intent, round(confidence, 6) AS confidence, round(sim, 6) AS sim, {LADDER} FROM fnd",
    "prepare_dataset": with_(PREPARED) + "SELECT position, text, intent, response, source, split FROM pre",
}

# Naive Bayes is computed in full; what an iterative solver reaches is stated.
SQL["train_compare"] = f"""WITH nb AS ({SQL['naive_bayes']}), one AS (SELECT count(*)::BIGINT AS n, avg((intent = predicted_intent)::INTEGER) AS a FROM nb)
SELECT 'naive_bayes' AS model, n AS eval_rows, round(a, 6) AS accuracy, a >= {v.LEAST_ACCURACY['naive_bayes']} AS reached FROM one
UNION ALL SELECT model, eval_rows, NULL::DOUBLE AS accuracy, reached FROM ({trained(['logreg', 'svm'])})"""
