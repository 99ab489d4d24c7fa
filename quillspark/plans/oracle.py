"""The same queries in SQL for DuckDB, written from the definitions and not from the plans.

Distances are spelled out over the union of two histograms' events, with zeros for what one side lacks.
"""

from __future__ import annotations

from ..functions.events import load_function_words
from ..functions.word_lists import MOSTELLER_WALLACE
from ..sources.lexicon import SAMPLE_TIMES

SPACE = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]+"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}'), lambda x: x <> '')"


def low(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '{WS}', ' ', 'g'))"


CHARS = "list_filter(string_split(text, ''), lambda x: x <> '')"
SENTENCES = "regexp_split_to_array(text, '[.!?]+')"
LINES = "string_split(text, chr(10))"
SYLLABLES = "[greatest(1, len(regexp_extract_all(x, '[aeiouyAEIOUY]+')))::VARCHAR for x in a]"


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def _totals(bind: str, expr: str) -> str:
    return f"""WITH w AS (SELECT doc_id, {bind} AS a FROM documents), e AS (SELECT doc_id, unnest({expr}) AS event FROM w)
SELECT event, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM e GROUP BY event"""


def _runs(bind: str, expr: str, last: str) -> str:
    """Events made of successive elements x0, x1, x2 of a list; ``last`` must exist."""
    return f"""WITH w AS (SELECT doc_id, {bind} AS a FROM documents), s AS (SELECT doc_id, unnest(a) AS x0, unnest(range(len(a))) AS i FROM w),
r AS (SELECT doc_id, x0, lead(x0, 1) OVER o AS x1, lead(x0, 2) OVER o AS x2 FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, {expr} AS event FROM r WHERE {last} IS NOT NULL)
SELECT event, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM e GROUP BY event"""


def _counted(expr: str, where: str = "TRUE") -> str:
    return f"""WITH w AS (SELECT doc_id, unnest({words('text')}) AS x FROM documents), c AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id, x) AS c FROM w),
e AS (SELECT doc_id, {expr} AS event FROM c WHERE {where})
SELECT event, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM e GROUP BY event"""


W = words("text")
_MASKS = "unnest(['_ ' || x1 || ' ' || x2, x0 || ' _ ' || x2, x0 || ' ' || x1 || ' _'])"
_TIMES = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAMPLE_TIMES.items()) + " END"

EVENTS = {
    "character_ngram": _runs(CHARS, "x0 || x1 || x2", "x2"),
    "word_events": _totals(W, "a"),
    "word_ngram": _runs(W, "x0 || ' ' || x1", "x1"),
    "function_words": _totals(W, f"list_filter([lower(x) for x in a], lambda x: x IN ({_in(load_function_words('english'))}))"),
    "word_length": _totals(W, "[length(x)::VARCHAR for x in a]"),
    "sentence_length": _totals(SENTENCES, f"[n::VARCHAR for n in [len({words('s')}) for s in a] if n > 0]"),
    "character_events": _totals(CHARS, "a"),
    "punctuation": _totals(CHARS, rf"list_filter(a, lambda c: regexp_full_match(c, '[^\p{{L}}\p{{N}}{SPACE}]'))"),
    "punctuation_ngram": _runs("list_filter(string_split(regexp_replace(text, '[^[:punct:]]', '', 'g'), ''), lambda x: x <> '')", "x0 || x1", "x1"),
    "mw_function_words": _totals(W, f"list_filter([lower(x) for x in a], lambda x: x IN ({_in(MOSTELLER_WALLACE)}))"),
    "leave_k_out_character_ngram": _runs(CHARS, _MASKS, "x2"),
    "leave_k_out_word_ngram": _runs(W, _MASKS, "x2"),
    "sorted_character_ngram": _runs(CHARS, "array_to_string(list_sort([x0, x1, x2]), '')", "x2"),
    "sorted_word_ngram": _runs(W, "array_to_string(list_sort([x0, x1]), ' ')", "x1"),
    "k_skip_character_ngram": _runs(CHARS, "x0 || x2", "x2"),
    "k_skip_word_ngram": _runs(W, "x0 || ' ' || x2", "x2"),
    "suffix": _totals(W, "[right(x, 3) for x in a if length(x) >= 3]"),
    "rare_words": _counted("x", "c = 1"),
    "vowel_initial_words": _totals(W, "list_filter(a, lambda x: x[1] IN ('a','e','i','o','u','A','E','I','O','U'))"),
    "first_word_in_sentence": _totals(SENTENCES, f"list_filter([({words('s')})[1] for s in a], lambda x: x IS NOT NULL)"),
    "sentence_events": _totals(f"string_split(regexp_replace(text, '([.!?]){WS}', '\\1' || chr(1), 'g'), chr(1))", f"list_filter([regexp_replace(s, '^{WS}|{WS}$', '', 'g') for s in a], lambda x: x <> '')"),
    "line_length": _totals(LINES, f"[n::VARCHAR for n in [len({words('s')}) for s in a] if n > 0]"),
    "new_lines": _totals(LINES, f"list_filter([regexp_replace(s, '^{WS}|{WS}$', '', 'g') for s in a], lambda x: x <> '')"),
    "mn_letter_words": _totals(W, "list_filter(a, lambda x: length(x) BETWEEN 1 AND 3)"),
    "vowel_mn_letter_words": _totals(W, "list_filter(a, lambda x: length(x) BETWEEN 1 AND 5 AND lower(x[1]) IN ('a','e','i','o','u'))"),
    "syllables_per_word": _totals(W, SYLLABLES),
    "syllable_transitions": _runs(f"(SELECT {SYLLABLES} FROM (SELECT {W} AS a))", "x0 || ' ' || x1", "x1"),
    "truncated_frequency": _counted("(length(bin(c)) - 1)::VARCHAR"),
    "reaction_time": _totals(W, f"list_filter([{_TIMES} for x in a], lambda v: v IS NOT NULL)"),
}

_PUNCT = "[[:punct:]]"
CANON = {
    "unify_case": "lower(text)",
    "normalize_whitespace": f"trim(regexp_replace(text, '{WS}', ' ', 'g'))",
    "strip_punctuation": f"regexp_replace(text, '{_PUNCT}', '', 'g')",
    "strip_numbers": "regexp_replace(text, '[0-9]', '', 'g')",
    "smash_i": r"regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])I($|[^\p{L}\p{N}_])', '\1i\2', 'g'), '(^|[^\p{L}\p{N}_])I($|[^\p{L}\p{N}_])', '\1i\2', 'g')",
    "punctuation_separator": f"regexp_replace(text, '({_PUNCT})', ' \\1 ', 'g')",
    "strip_comments": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/\*(.|\n)*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '#[^\n]*', '', 'g'), '<!--(.|\n)*?-->', '', 'g')",
    "strip_null_chars": r"regexp_replace(text, '[\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g')",
    "strip_non_punctuation": f"regexp_replace(text, '[^[:punct:]{SPACE}]', '', 'g')",
}

#: d: documents; h: histograms of lower-cased words; kh: those of the known documents.
HIST = f"""d AS (SELECT doc_id, source AS author, (doc_id // 20) % 5 <> 0 AS known, {low('text')} AS t FROM documents),
h AS (SELECT doc_id, event, count(*)::BIGINT AS cnt FROM (SELECT doc_id, unnest({words('t')}) AS event FROM d) GROUP BY ALL),
kh AS (SELECT h.*, author FROM h JOIN d USING (doc_id) WHERE known),
n AS (SELECT count(*)::DOUBLE AS n FROM d WHERE known),
tot AS (SELECT event, sum(cnt)::BIGINT AS total, count(*)::BIGINT AS df, sum(cnt * cnt)::DOUBLE AS sq FROM kh GROUP BY event)"""
_MOM = HIST + """,
m AS (SELECT event, total, df, n, sq, total / n AS mean, (n * sq - total::DOUBLE * total) / (n * n) AS var FROM tot, n)"""


def _top(score: str, n: int = 50, order: str = "DESC", base: str = _MOM, source: str = "m") -> str:
    return f"WITH {base} SELECT event FROM {source} ORDER BY {score} {order}, event LIMIT {n}"


def _kept(where: str) -> str:
    return f"WITH {_MOM} SELECT event FROM m WHERE {where}"


CULLERS = {
    "most_common": _top("total"),
    "least_common": _top("total", order="ASC"),
    "percentage_range": _kept("total::DOUBLE / (SELECT sum(total) FROM m) BETWEEN 0.0001 AND 0.01"),
    "information_gain": f"WITH {HIST} SELECT event FROM (SELECT event, -sum(cnt::DOUBLE / total * log2(cnt::DOUBLE / total)) AS s FROM kh JOIN tot USING (event) GROUP BY event) ORDER BY round(s, 10) DESC, event LIMIT 50",
    "zeta": f"""WITH {HIST}, p AS (SELECT author FROM d WHERE known GROUP BY author ORDER BY count(*) DESC, author LIMIT 1),
sz AS (SELECT count(*) FILTER (author = (FROM p)) AS n1, count(*) FILTER (author <> (FROM p)) AS n2 FROM d WHERE known),
f AS (SELECT event, count(*) FILTER (author = (FROM p)) AS d1, count(*) FILTER (author <> (FROM p)) AS d2 FROM kh GROUP BY event)
SELECT event FROM f, sz WHERE abs(d1 / n1 - d2 / n2) >= 0.1""",
    "iqr": f"WITH {HIST}, q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM tot) SELECT event FROM tot, q WHERE total BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    "std_deviation": f"WITH {HIST}, q AS (SELECT avg(total) AS a, stddev_pop(total) AS s FROM tot) SELECT event FROM tot, q WHERE abs(total - a) <= s",
    "extreme": _kept("df = n"),
    "variance": _kept("var > 0.5"),
    "range": _kept("df BETWEEN 5 AND 100"),
    "coefficient_of_variation": _kept("mean > 0 AND sqrt(var) / mean > 2"),
    "mean_absolute_deviation": f"WITH {_MOM}, s AS (SELECT event, (sum(abs(cnt - mean)) + (any_value(n) - count(*)) * any_value(mean)) / any_value(n) AS s FROM kh JOIN m USING (event) GROUP BY event) SELECT event FROM s ORDER BY round(s, 10) DESC, event LIMIT 50",
    "index_of_dispersion": _top("round(var / mean, 10)"),
    "weighted_variance": f"""WITH {_MOM}, g AS (SELECT sum(total)::DOUBLE AS g FROM m), p AS (SELECT *, total / g AS p, total / g * mean AS mw FROM m, g)
SELECT event FROM p ORDER BY round(p * (sq - 2 * mw * total + n * mw * mw), 10) DESC, event LIMIT 50""",
}


def _cut(n: int) -> str:
    return HIST + f""",
keep AS (SELECT event FROM tot ORDER BY total DESC, event LIMIT {n}),
c AS (SELECT h.doc_id, h.event, cnt, author, known FROM h SEMI JOIN keep USING (event) JOIN d USING (doc_id)),
au AS (SELECT author, count(*) AS n_docs FROM d WHERE known GROUP BY author),
un AS (SELECT doc_id FROM d WHERE NOT known)"""


#: x: every unknown document u by every author a by event of either: counts c1, c2 and frequencies p, q.
UNION = _cut(300) + """,
prof AS (SELECT author, event, sum(cnt)::BIGINT AS cnt FROM c WHERE known GROUP BY ALL),
ut AS (SELECT doc_id, sum(cnt)::DOUBLE AS t FROM c WHERE NOT known GROUP BY doc_id),
pt AS (SELECT author, sum(cnt)::DOUBLE AS t FROM prof GROUP BY author),
g AS (SELECT un.doc_id, au.author, keep.event FROM un, au, keep),
x AS (SELECT g.doc_id, g.author, g.event, coalesce(a.cnt, 0) AS c1, coalesce(b.cnt, 0) AS c2, coalesce(a.cnt / ut.t, 0) AS p, coalesce(b.cnt / pt.t, 0) AS q
  FROM g LEFT JOIN c a ON a.doc_id = g.doc_id AND a.event = g.event LEFT JOIN prof b ON b.author = g.author AND b.event = g.event
  LEFT JOIN ut ON ut.doc_id = g.doc_id LEFT JOIN pt ON pt.author = g.author),
y AS (SELECT * FROM x WHERE c1 > 0 OR c2 > 0)"""

_E = "1e-10::DOUBLE"
_COS = "greatest(-1, least(1, sum(p * q) / sqrt(sum(p * p) * sum(q * q))))"
_NO = "(sum(c1) = 0 OR sum(c2) = 0)"
DISTANCES = {
    "cosine": f"CASE WHEN {_NO} THEN 1 ELSE 1 - {_COS} END",
    "manhattan": "sum(abs(p - q))",
    "euclidean": "sqrt(sum((p - q) * (p - q)))",
    "chi_square": "sum(CASE WHEN q > 0 THEN (p - q) * (p - q) / q ELSE 0 END)",
    "kl_divergence": f"sum(CASE WHEN p > 0 THEN p * ln(p / CASE WHEN q > 0 THEN q ELSE {_E} END) ELSE 0 END)",
    "cross_entropy": f"sum(CASE WHEN p > 0 THEN -p * ln(CASE WHEN q > 0 THEN q ELSE {_E} END) ELSE 0 END)",
    "hellinger": "sqrt(sum(pow(sqrt(p) - sqrt(q), 2))) / sqrt(2)",
    "bhattacharyya": "CASE WHEN sum(sqrt(p * q)) <= 0 THEN 'Infinity'::DOUBLE ELSE -ln(least(1, sum(sqrt(p * q)))) END",
    "bray_curtis": "sum(abs(p - q)) / sum(p + q)",
    "canberra": "sum(abs(p - q) / (p + q))",
    "intersection": "1 - sum(least(p, q))",
    "histogram_intersection": f"CASE WHEN {_NO} THEN 1 ELSE 1 - sum(least(c1, c2)) / least(sum(c1), sum(c2)) END",
    "pearson_correlation": "CASE WHEN min(p) = max(p) OR min(q) = max(q) THEN 1 ELSE 1 - corr(p, q) END",
    "keselj_weighted": "sum(pow((p - q) / (p + q), 2))",
    "stamatatos": "sum(pow(2 * (p - q) / (p + q), 2))",
    "angular_separation": f"CASE WHEN {_NO} THEN 1 ELSE acos({_COS}) / pi() END",
    "chord": f"CASE WHEN {_NO} THEN sqrt(2) ELSE sqrt(2 * (1 - {_COS})) END",
    "matusita": "sqrt(sum(pow(sqrt(p) - sqrt(q), 2)))",
    "soergel": "sum(abs(p - q)) / sum(greatest(p, q))",
    "wave_hedges": "sum(1 - least(p, q) / greatest(p, q))",
    "wed": "sqrt(sum(CASE WHEN p > 0 THEN p ELSE 1 END * (p - q) * (p - q)))",
    "nominal_ks": "sum(abs(p - q)) / 2",
}
_PAIRS = UNION + """,
z AS (SELECT a.doc_id, a.author, sign(a.p - b.p) * sign(a.q - b.q) AS s, a.p = b.p AS tp, a.q = b.q AS tq
  FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.author = b.author AND a.event < b.event)"""
_S = "SELECT doc_id, author, round({}, 7)::DOUBLE AS score FROM {} GROUP BY doc_id, author"


def distance_sql() -> dict[str, str]:
    out = {k: f"WITH {UNION} {_S.format(v, 'y')}" for k, v in DISTANCES.items()}
    out["kendall_correlation"] = f"WITH {_PAIRS} " + _S.format("(1 - sum(s) / count(*)) / 2", "z")
    tau = "((count(*) FILTER (NOT (tp AND tq)) - count(*) FILTER (tp AND NOT tq))::DOUBLE * (count(*) FILTER (NOT (tp AND tq)) - count(*) FILTER (tq AND NOT tp)))"
    out["kendall_tau_b"] = f"WITH {_PAIRS} " + _S.format(f"CASE WHEN {tau} > 0 THEN (1 - sum(s) / sqrt({tau})) / 2 ELSE 0 END", "z")
    return out


def _ranked(scores: str, higher: bool, digits: int = 8) -> str:
    """scores: SQL of (doc_id, author, score), with its WITH in front."""
    head, body = scores
    order = "DESC" if higher else "ASC"
    return f"""WITH {head}, sc AS ({body}), r AS (SELECT doc_id, author, round(score, {digits}) + 0 AS score FROM sc)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score {order}, author)::INTEGER AS rank, author, score::DOUBLE AS score FROM r"""


def _pair_docs(n: int, formula: str) -> str:
    """pr: every unknown document by every known one, by a formula over shared events and both sides' sums of squares."""
    return _cut(n) + f""",
f AS (SELECT doc_id, event, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS f, known FROM c),
sq AS (SELECT doc_id, sum(f * f) AS s, sum(f) AS one FROM f GROUP BY doc_id),
sh AS (SELECT a.doc_id AS u, b.doc_id AS k, sum(a.f * b.f) AS dot, sum(abs(a.f - b.f) - a.f - b.f) AS l1 FROM f a JOIN f b ON a.event = b.event AND NOT a.known AND b.known GROUP BY ALL),
pr AS (SELECT un.doc_id, kn.doc_id AS k, kn.author, {formula} AS dist FROM un CROSS JOIN (SELECT doc_id, author FROM d WHERE known) kn
  LEFT JOIN sh ON sh.u = un.doc_id AND sh.k = kn.doc_id LEFT JOIN sq a ON a.doc_id = un.doc_id LEFT JOIN sq b ON b.doc_id = kn.doc_id)"""


_NEAREST = "SELECT doc_id, author, min(dist) AS score FROM pr GROUP BY doc_id, author"
_COSD = "CASE WHEN a.s IS NULL OR b.s IS NULL THEN 1 ELSE 1 - least(1, coalesce(dot, 0) / sqrt(a.s * b.s)) END"
_L1 = "greatest(0, coalesce(a.one, 0) + coalesce(b.one, 0) + coalesce(l1, 0))"
_ABS = UNION.replace(
    "prof AS (SELECT author, event, sum(cnt)::BIGINT AS cnt FROM c WHERE known GROUP BY ALL)",
    "prof AS (SELECT c.author, event, round_even(sum(cnt) / any_value(n_docs), 0)::BIGINT AS cnt FROM c JOIN au USING (author) WHERE known GROUP BY ALL)",
)
_REL = """,
f AS (SELECT doc_id, event, author, known, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS f FROM c)"""
_BURROWS = _cut(150) + _REL + """,
dense AS (SELECT d.doc_id, d.author, d.known, keep.event, coalesce(f.f, 0) AS f FROM d CROSS JOIN keep LEFT JOIN f ON f.doc_id = d.doc_id AND f.event = keep.event),
sd AS (SELECT event, stddev_pop(f) AS sd FROM dense WHERE known GROUP BY event HAVING min(f) < max(f)),
pm AS (SELECT author, event, avg(f) AS a FROM dense WHERE known GROUP BY ALL)"""
_EDER = _cut(200) + """,
tt AS (SELECT doc_id, sum(cnt)::DOUBLE AS t FROM c GROUP BY doc_id),
dense AS (SELECT d.doc_id, d.author, d.known, keep.event, sqrt(coalesce(c.cnt / tt.t, 0)) AS f FROM d CROSS JOIN keep LEFT JOIN c ON c.doc_id = d.doc_id AND c.event = keep.event LEFT JOIN tt ON tt.doc_id = d.doc_id),
sd AS (SELECT event, CASE WHEN min(f) = max(f) THEN 0 ELSE stddev_samp(f) END AS sd FROM dense WHERE known GROUP BY event),
pm AS (SELECT author, event, avg(f) AS a FROM dense WHERE known GROUP BY ALL)"""
_COUNTS = _cut(300) + """,
kc AS (SELECT author, event, sum(cnt) AS a FROM c WHERE known GROUP BY ALL),
kt AS (SELECT author, coalesce(sum(a), 0) AS t FROM au LEFT JOIN kc USING (author) GROUP BY author),
v AS (SELECT count(DISTINCT event) AS v FROM kc),
ll AS (SELECT u.doc_id, kt.author, sum(u.cnt * ln((coalesce(a, 0) + 1) / (t + v))) AS ll FROM c u CROSS JOIN kt CROSS JOIN v LEFT JOIN kc ON kc.author = kt.author AND kc.event = u.event
  WHERE NOT u.known GROUP BY ALL),
lg AS (SELECT un.doc_id, au.author, n_docs, coalesce(ll, 0) AS ll FROM un CROSS JOIN au LEFT JOIN ll ON ll.doc_id = un.doc_id AND ll.author = au.author)"""
_THIN = _cut(300) + """,
seq AS (SELECT doc_id, author, known, event, unnest(range(cnt)) AS j FROM c),
ks AS (SELECT author, event AS a, lead(event) OVER (PARTITION BY author ORDER BY doc_id, event, j) AS b FROM seq WHERE known),
us AS (SELECT doc_id, event AS a, lead(event) OVER (PARTITION BY doc_id ORDER BY event, j) AS b FROM seq WHERE NOT known),
mo AS (SELECT author, a, b, count(*) AS n FROM ks WHERE b IS NOT NULL GROUP BY ALL),
mt AS (SELECT author, a, sum(n) AS t FROM mo GROUP BY ALL),
v AS (SELECT count(DISTINCT event) AS v FROM c WHERE known),
ut AS (SELECT doc_id, a, b, count(*) AS m FROM us WHERE b IS NOT NULL GROUP BY ALL),
sc0 AS (SELECT ut.doc_id, au.author, -sum(m * log2(CASE WHEN t IS NULL THEN 1 / (v + 1) ELSE (coalesce(mo.n, 0) + 1) / (t + v) END)) / sum(m) AS score
  FROM ut CROSS JOIN au CROSS JOIN v LEFT JOIN mt ON mt.author = au.author AND mt.a = ut.a LEFT JOIN mo ON mo.author = au.author AND mo.a = ut.a AND mo.b = ut.b GROUP BY ALL)"""
_CONTRAST = _cut(300) + _REL + """,
pm AS (SELECT f.author, event, sum(f) / any_value(n_docs) AS a FROM f JOIN au USING (author) WHERE known GROUP BY ALL),
pn AS (SELECT author, sqrt(sum(a * a)) AS pn FROM pm GROUP BY author),
un2 AS (SELECT doc_id, sqrt(sum(f * f)) AS un FROM f WHERE NOT known GROUP BY doc_id),
dt AS (SELECT f.doc_id, pm.author, sum(f * a) AS dot FROM f JOIN pm ON f.event = pm.event WHERE NOT f.known GROUP BY ALL)"""

CENTROID = (UNION, f"SELECT doc_id, author, {DISTANCES['cosine']} AS score FROM y GROUP BY doc_id, author")
METHODS = {
    "nearest_neighbor": _ranked((_pair_docs(300, _L1), _NEAREST), False),
    "knn": _ranked((
        _pair_docs(300, _L1) + ", nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 10), k) AS r FROM pr)",
        "SELECT doc_id, author, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS score FROM nr WHERE r <= 5 GROUP BY doc_id, author",
    ), True),
    "centroid": _ranked(CENTROID, False),
    "absolute_centroid": _ranked((_ABS, f"SELECT doc_id, author, {DISTANCES['cosine']} AS score FROM x GROUP BY doc_id, author"), False),
    "burrows_delta": _ranked((_BURROWS, "SELECT x.doc_id, pm.author, avg(abs(x.f - pm.a) / sd) AS score FROM dense x JOIN sd USING (event) JOIN pm ON pm.event = x.event WHERE NOT x.known GROUP BY ALL"), False),
    "eders_delta": _ranked((_EDER, "SELECT x.doc_id, pm.author, avg(CASE WHEN sd > 0 THEN abs(x.f - pm.a) / sd ELSE 0 END) AS score FROM dense x JOIN sd USING (event) JOIN pm ON pm.event = x.event WHERE NOT x.known GROUP BY ALL"), False),
    "markov_chain": _ranked((_COUNTS, "SELECT doc_id, author, ll AS score FROM lg"), True),
    "naive_bayes": _ranked((
        _COUNTS + ", zz AS (SELECT doc_id, author, ln(n_docs / sum(n_docs) OVER (PARTITION BY doc_id)) + ll AS z FROM lg), ee AS (SELECT doc_id, author, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM zz)",
        "SELECT doc_id, author, e / sum(e) OVER (PARTITION BY doc_id) AS score FROM ee",
    ), True),
    "thin_xent": _ranked((_THIN, "SELECT un.doc_id, au.author, coalesce(score, 0) AS score FROM un CROSS JOIN au LEFT JOIN sc0 ON sc0.doc_id = un.doc_id AND sc0.author = au.author"), False),
    "contrastive": _ranked((
        _CONTRAST,
        "SELECT un.doc_id, au.author, coalesce(dot / (pn * un2.un), 0) AS score FROM un CROSS JOIN au LEFT JOIN dt ON dt.doc_id = un.doc_id AND dt.author = au.author LEFT JOIN pn ON pn.author = au.author LEFT JOIN un2 ON un2.doc_id = un.doc_id",
    ), True),
}

#: pred: the first-ranked author of the unknown documents beside the true one; ra: all ranked authors.
_PRED = f"""{UNION}, sc AS (SELECT doc_id, author, round({DISTANCES['cosine']}, 8) AS score FROM y GROUP BY doc_id, author),
ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, author) AS rank FROM sc),
pred AS (SELECT ra.doc_id, ra.author AS given, score, d.author AS truth FROM ra JOIN d USING (doc_id) WHERE rank = 1),
al AS (SELECT truth AS author FROM pred UNION SELECT given FROM pred)"""
_TURNS = f"""tu AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS o, regexp_replace(text, '\\n+', ' ', 'g') AS t FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
pa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS i, {low('t')} AS t FROM tu WHERE regexp_replace(t, '{WS}', '', 'g') <> ''),
ev AS (SELECT doc_id, i, event, count(*)::DOUBLE AS c FROM (SELECT doc_id, i, unnest({words('t')}) AS event FROM pa) GROUP BY ALL),
nm AS (SELECT doc_id, i, sqrt(sum(c * c)) AS n FROM ev GROUP BY ALL),
dt AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS dot FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.event = b.event GROUP BY ALL),
ds AS (SELECT a.doc_id, a.i, 1 - least(1, coalesce(dot, 0) / (a.n * b.n)) AS dist FROM nm a JOIN nm b ON a.doc_id = b.doc_id AND b.i = a.i + 1 LEFT JOIN dt ON dt.doc_id = a.doc_id AND dt.i = a.i)"""


def oracle_sql() -> dict[str, str]:
    from .oracle_evaluate import evaluation_sql

    out = evaluation_sql()
    out |= {f"canon_{n}": f"SELECT doc_id, {e} AS text FROM documents" for n, e in CANON.items()}
    out |= {f"event_{n}": q for n, q in EVENTS.items()}
    out |= {f"culler_{n}": q for n, q in CULLERS.items()}
    out["culler_set"] = f"WITH {HIST} SELECT event, count(*)::BIGINT AS n FROM h GROUP BY event"
    out["culler_chain"] = f"""WITH {HIST}, k1 AS (SELECT event FROM tot ORDER BY total DESC, event LIMIT 500), k2 AS (SELECT event FROM tot WHERE df BETWEEN 5 AND 400)
SELECT event, sum(cnt)::BIGINT AS n, count(*)::BIGINT AS df FROM h SEMI JOIN k1 USING (event) SEMI JOIN k2 USING (event) GROUP BY event"""
    out |= {f"distance_{n}": q for n, q in distance_sql().items()}
    out |= {f"method_{n}": q for n, q in METHODS.items()}
    out["entry_cosine_delta"] = _ranked((_pair_docs(300, _COSD), _NEAREST), False)
    out["streaming_score"] = METHODS["centroid"]
    out["style_change"] = f"""WITH {_TURNS}, mm AS (SELECT *, min(dist) OVER (PARTITION BY doc_id) AS lo, max(dist) OVER (PARTITION BY doc_id) AS hi FROM ds),
s AS (SELECT doc_id, i, round(CASE WHEN hi > lo THEN (dist - lo) / (hi - lo) ELSE 0 END, 7) AS score FROM mm)
SELECT doc_id, i::INTEGER AS boundary_index, score, score >= 0.5 AS is_change FROM s"""
    out["evaluate_confusion"] = f"WITH {_PRED} SELECT a.author AS true_author, b.author AS predicted_author, count(pred.doc_id)::BIGINT AS n FROM al a CROSS JOIN al b LEFT JOIN pred ON truth = a.author AND given = b.author GROUP BY ALL"
    out["evaluate_by_author"] = f"""WITH {_PRED}, s AS (SELECT author, count(*) FILTER (truth = author) AS su, count(*) FILTER (given = author) AS gi, count(*) FILTER (truth = author AND given = author) AS tp FROM al CROSS JOIN pred GROUP BY author),
p AS (SELECT author, su, CASE WHEN gi > 0 THEN tp / gi ELSE 0 END AS p, CASE WHEN su > 0 THEN tp / su ELSE 0 END AS r FROM s)
SELECT author, round(p, 9)::DOUBLE AS "precision", round(r, 9)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9)::DOUBLE AS f1, su::BIGINT AS support FROM p"""
    out["source_manifest_summary"] = """SELECT source AS author, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc_id, substr(arg_min(text, doc_id), 1, 60) AS preview FROM documents GROUP BY source"""
    out["source_corpus_counts"] = """SELECT source AS corpus_id, count(*)::BIGINT AS document_count FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT '(empty)', 0"""
    out["source_page"] = "SELECT doc_id, source, length(text)::INTEGER AS n_chars FROM documents ORDER BY doc_id DESC, n_chars LIMIT 50 OFFSET 100"
    out["source_segments"] = f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, unnest(range(len(string_split(text, chr(10))))) AS part FROM documents),
s AS (SELECT doc_id, part::INTEGER AS part, len({words('b')})::INTEGER AS n_words, regexp_replace(b, '^{WS}|{WS}$', '', 'g') AS body FROM p) SELECT doc_id, part, n_words, body FROM s WHERE n_words >= 20"""
    return out
