"""SQL of the evaluation queries and of methods with draws: metrics over predictions, protocols written out fold by fold, draws by hash."""

from __future__ import annotations

from ..functions.events import load_function_words
from .oracle import _PRED, DISTANCES, UNION, _cut, _in, _ranked, low, words

_SUMMARY = _PRED + """,
b AS (SELECT count(*)::DOUBLE AS n, sum((given = truth)::INT)::DOUBLE AS nc, sum((score = 0.5)::INT)::DOUBLE AS nu, 1 - avg(pow(greatest(0, least(1, score)) - (given = truth)::INT, 2)) AS brier FROM pred),
b2 AS (SELECT *, CASE WHEN n = nu THEN NULL ELSE nc / (n - nu) END AS pr, nc / n AS rc FROM b),
b3 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 1.25 * pr * rc / (0.25 * pr + rc) ELSE 0 END AS f05 FROM b2),
ea AS (SELECT author, count(*) FILTER (truth = author) AS su, count(*) FILTER (given = author) AS gi, count(*) FILTER (truth = author AND given = author) AS tp FROM al CROSS JOIN pred GROUP BY author),
ep AS (SELECT CASE WHEN gi > 0 THEN tp / gi ELSE 0 END AS p, CASE WHEN su > 0 THEN tp / su ELSE 0 END AS r FROM ea),
ma AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS mf FROM ep),
tg AS (SELECT ra.author, ra.doc_id, ra.score, (ra.author = pred.truth)::INT AS pos FROM ra JOIN pred USING (doc_id) WHERE ra.author IN (SELECT truth FROM pred)),
tn AS (SELECT *, sum(pos) OVER (PARTITION BY author) AS np, sum(1 - pos) OVER (PARTITION BY author) AS nn FROM tg QUALIFY np > 0 AND nn > 0),
er AS (SELECT *, 1 - sum(pos) OVER w / np AS fnr, sum(1 - pos) OVER w / nn AS fpr, row_number() OVER w AS i FROM tn WINDOW w AS (PARTITION BY author ORDER BY score DESC, doc_id)),
ex AS (SELECT *, min(CASE WHEN fpr >= fnr THEN i END) OVER (PARTITION BY author) AS stop FROM er),
ee AS (SELECT author, min(least(CASE WHEN abs(fpr - fnr) < 0.5 THEN greatest(fpr, fnr) ELSE 1 END, CASE WHEN fpr >= fnr THEN (fpr + fnr) / 2 ELSE 1 END)) AS e FROM ex WHERE stop IS NULL OR i <= stop GROUP BY author),
au2 AS (SELECT author, sum((1 - pos) * tpr / nn) AS a FROM (SELECT *, sum(pos) OVER (PARTITION BY author ORDER BY score, doc_id ROWS UNBOUNDED PRECEDING) / np AS tpr FROM tn) GROUP BY author),
rr AS (SELECT avg(coalesce(1 / ra.rank, 0)) AS mrr FROM pred LEFT JOIN ra ON ra.doc_id = pred.doc_id AND ra.author = pred.truth),
cf AS (SELECT doc_id, author, rank, CASE WHEN max(score) OVER (PARTITION BY doc_id) > 0 THEN 1 - score / max(score) OVER (PARTITION BY doc_id) ELSE 0 END AS conf FROM ra),
bd AS (SELECT 1 - avg(pow(greatest(0, least(1, conf)) - (cf.author = truth)::INT, 2)) AS bd FROM cf JOIN pred USING (doc_id) WHERE rank = 1)"""
_METRICS = {
    "n": "n", "correct": "nc", "unanswered": "nu", "accuracy": "nc / n", "c_at_1": "(nc + nu * nc / n) / n",
    "f05u": "CASE WHEN n = nu THEN nc / n WHEN nu > 0 THEN ((n - nu) * f05 + nu * pr) / n ELSE f05 END", "brier": "brier",
    "macro_precision": "mp", "macro_recall": "mr", "macro_f1": "mf", "eer": "CASE WHEN (SELECT count(DISTINCT truth) FROM pred) >= 2 THEN (SELECT avg(e) FROM ee) END",
    "auroc": "(SELECT avg(a) FROM au2)", "mrr": "mrr", "brier_by_distance": "bd",
}

#: Distances rounded to a tenth, so that some are 0.5; half of the documents carry a threshold.
_THRESHOLDS = f"""WITH {_PRED},
b AS (SELECT count(*)::DOUBLE AS n, sum((given = truth)::INT)::DOUBLE AS nc, sum((round(score, 1) = 0.5 AND doc_id % 2 = 0)::INT)::DOUBLE AS nu FROM pred),
b2 AS (SELECT *, nc / (n - nu) AS pr, nc / n AS rc FROM b)
SELECT round((CASE WHEN n = nu THEN rc ELSE ((n - nu) * CASE WHEN nc > 0 THEN 1.25 * pr * rc / (0.25 * pr + rc) ELSE 0 END + nu * pr) / n END)::DOUBLE, 7) AS f05u FROM b2"""

#: pr: pairs of different documents by the cosine distance of their function words.
_FUNCTION_PAIRS = f"""f0 AS (SELECT doc_id, unnest(list_filter({words(low('text'))}, lambda x: lower(x) IN ({_in(load_function_words('english'))}))) AS event FROM documents),
fh AS (SELECT doc_id, event, count(*)::DOUBLE AS c FROM f0 GROUP BY ALL),
fn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM fh GROUP BY doc_id),
dt AS (SELECT a.doc_id AS u, b.doc_id AS k, sum(a.c * b.c) AS dot FROM fh a JOIN fh b ON a.event = b.event WHERE a.doc_id <> b.doc_id GROUP BY ALL),
dd AS (SELECT doc_id, source AS author FROM documents WHERE source IS NOT NULL),
pr AS (SELECT a.doc_id AS u, b.doc_id AS k, b.author, CASE WHEN x.n IS NULL OR y.n IS NULL THEN 1 ELSE greatest(0, 1 - coalesce(dot, 0) / (x.n * y.n)) END AS dist
  FROM dd a JOIN dd b ON a.doc_id <> b.doc_id LEFT JOIN fn x ON x.doc_id = a.doc_id LEFT JOIN fn y ON y.doc_id = b.doc_id LEFT JOIN dt ON dt.u = a.doc_id AND dt.k = b.doc_id)"""

_TOPICS = f"""WITH {_FUNCTION_PAIRS},
tp AS (SELECT doc_id, max(quality) AS topic FROM labels GROUP BY doc_id),
tr AS (SELECT pr.*, a.topic AS tu, b.topic AS tk FROM pr JOIN tp a ON a.doc_id = pr.u JOIN tp b ON b.doc_id = pr.k),
al AS (SELECT 'overall' AS protocol, u, author, dist FROM tr UNION ALL SELECT 'within', u, author, dist FROM tr WHERE tu = tk UNION ALL SELECT 'across', u, author, dist FROM tr WHERE tu <> tk),
sc AS (SELECT protocol, u, author, round(min(dist), 8) AS score FROM al GROUP BY ALL),
tops AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY protocol, u ORDER BY score, author) = 1)
SELECT protocol, count(*)::BIGINT AS n, avg((t.author = dd.author)::INT)::DOUBLE AS accuracy FROM tops t JOIN dd ON dd.doc_id = t.u GROUP BY protocol"""

_FOLDS = f"""WITH d AS (SELECT doc_id, source AS author, {low('text')} AS t, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE source IS NOT NULL),
fo AS (SELECT d.doc_id, author, f.fold FROM d JOIN (SELECT unnest(range(3)) AS fold) f ON i >= f.fold * n // 3 AND i < (f.fold + 1) * n // 3),
h AS (SELECT doc_id, event, count(*)::BIGINT AS cnt FROM (SELECT doc_id, unnest({words('t')}) AS event FROM d) GROUP BY ALL),
kt AS (SELECT f.fold, fo.author, h.event, sum(cnt)::BIGINT AS cnt FROM h JOIN fo USING (doc_id) JOIN (SELECT unnest(range(3)) AS fold) f ON fo.fold <> f.fold GROUP BY ALL),
keep AS (SELECT fold, event FROM (SELECT fold, event, sum(cnt) AS s FROM kt GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY s DESC, event) <= 300),
prof AS (SELECT kt.* FROM kt SEMI JOIN keep USING (fold, event)),
own AS (SELECT fo.fold, h.* FROM h JOIN fo USING (doc_id) SEMI JOIN keep ON keep.fold = fo.fold AND keep.event = h.event),
pn AS (SELECT fold, author, sqrt(sum(cnt::DOUBLE * cnt)) AS n FROM prof GROUP BY ALL),
un AS (SELECT doc_id, sqrt(sum(cnt::DOUBLE * cnt)) AS n FROM own GROUP BY ALL),
dt AS (SELECT own.doc_id, prof.author, sum(own.cnt::DOUBLE * prof.cnt) AS dot FROM own JOIN prof USING (fold, event) GROUP BY ALL),
sc AS (SELECT fo.fold, fo.doc_id, fo.author AS truth, a.author, round(CASE WHEN un.n IS NULL THEN 1 ELSE greatest(0, 1 - coalesce(dot, 0) / (un.n * pn.n)) END, 8) AS score
  FROM fo JOIN (SELECT DISTINCT fold, author FROM kt) a ON a.fold = fo.fold JOIN pn ON pn.fold = a.fold AND pn.author = a.author LEFT JOIN un ON un.doc_id = fo.doc_id LEFT JOIN dt ON dt.doc_id = fo.doc_id AND dt.author = a.author),
tops AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, author) = 1)
SELECT fold::INTEGER AS fold, avg((author = truth)::INT)::DOUBLE AS accuracy, count(*)::BIGINT AS n FROM tops GROUP BY fold"""

_GENRES = UNION.replace(
    f"d AS (SELECT doc_id, source AS author, (doc_id // 20) % 5 <> 0 AS known, {low('text')} AS t FROM documents)",
    f"""shared_by AS (SELECT source FROM documents WHERE lang = 'en' AND source IS NOT NULL INTERSECT SELECT source FROM documents WHERE lang = 'fr'),
d AS (SELECT doc_id, source AS author, lang = 'en' AS known, {low('text')} AS t FROM documents WHERE lang IN ('en', 'fr') AND source IN (SELECT source FROM shared_by))""",
)


def _number(*values: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(values)})), 1, 15))::BIGINT"


_IMPOSTERS = _cut(100) + f""",
ao AS (SELECT author, n_docs, sum(n_docs) OVER (ORDER BY author) - n_docs AS first, sum(n_docs) OVER () AS total FROM au),
ro AS (SELECT author AS cand, n_docs, first, total, unnest(range(10)) AS iter FROM ao WHERE n_docs < total),
ft AS (SELECT cand, iter, event FROM ro CROSS JOIN keep QUALIFY row_number() OVER (PARTITION BY cand, iter ORDER BY md5(concat_ws('|', '42', cand, iter, event)), event) <= greatest(1, (SELECT count(*) // 2 FROM keep))),
dw AS (SELECT cand, iter, n_docs, first, {_number("'42'", 'cand', 'iter', 't')} % (total - n_docs) AS place FROM (SELECT *, unnest(range(least(10, total - n_docs)::BIGINT)) AS t FROM ro)),
ps AS (SELECT d.doc_id AS k, row_number() OVER (PARTITION BY d.author ORDER BY d.doc_id) - 1 + first AS place FROM d JOIN ao USING (author) WHERE known),
wh AS (SELECT cand, iter, d.doc_id AS k, TRUE AS own FROM ro JOIN d ON d.author = ro.cand AND d.known
  UNION ALL SELECT DISTINCT cand, iter, ps.k, FALSE FROM dw JOIN ps ON ps.place = CASE WHEN dw.place < first THEN dw.place ELSE dw.place + n_docs END),
fc AS (SELECT cand, iter, doc_id, event, cnt::DOUBLE AS cnt FROM c JOIN ft USING (event)),
nm AS (SELECT cand, iter, doc_id, sqrt(sum(cnt * cnt)) AS n FROM fc GROUP BY ALL),
wf AS (SELECT fc.cand, fc.iter, wh.k, event, cnt FROM fc JOIN wh ON wh.cand = fc.cand AND wh.iter = fc.iter AND wh.k = fc.doc_id),
dt AS (SELECT a.cand, a.iter, a.doc_id AS u, b.k, sum(a.cnt * b.cnt) AS dot FROM fc a JOIN wf b ON a.cand = b.cand AND a.iter = b.iter AND a.event = b.event JOIN un ON un.doc_id = a.doc_id GROUP BY ALL),
pr AS (SELECT wh.cand, wh.iter, un.doc_id AS u, own, round(CASE WHEN x.n IS NULL OR y.n IS NULL THEN 1 ELSE 1 - least(1, coalesce(dot, 0) / (x.n * y.n)) END, 10) AS dist
  FROM wh CROSS JOIN un LEFT JOIN nm x ON x.cand = wh.cand AND x.iter = wh.iter AND x.doc_id = un.doc_id LEFT JOIN nm y ON y.cand = wh.cand AND y.iter = wh.iter AND y.doc_id = wh.k
  LEFT JOIN dt ON dt.cand = wh.cand AND dt.iter = wh.iter AND dt.u = un.doc_id AND dt.k = wh.k),
bs AS (SELECT cand, iter, u, min(dist) FILTER (own) AS a, min(dist) FILTER (NOT own) AS b FROM pr GROUP BY ALL),
im AS (SELECT u AS doc_id, cand AS author, sum((a < b)::INT) / 10.0 AS score FROM bs GROUP BY ALL
  UNION ALL SELECT doc_id, author, 1.0 FROM un CROSS JOIN ao WHERE n_docs = total)"""

_BAGGING = _cut(300) + f""",
tt AS (SELECT author, event, sum(cnt)::BIGINT AS n FROM c WHERE known GROUP BY ALL),
pl AS (SELECT author, event, n, sum(n) OVER (PARTITION BY author ORDER BY event) AS upto, sum(n) OVER (PARTITION BY author)::BIGINT AS mass FROM tt),
dw AS (SELECT author, s, {_number("'42'", 'author', 's', 't')} % mass AS place FROM (SELECT DISTINCT author, mass FROM pl) CROSS JOIN (SELECT unnest(range(5)) AS s) CROSS JOIN (SELECT unnest(range(500)) AS t)),
sp AS (SELECT pl.author, s, event, count(*)::DOUBLE AS cnt FROM dw JOIN pl ON pl.author = dw.author AND place >= upto - n AND place < upto GROUP BY ALL),
sn AS (SELECT author, s, sqrt(sum(cnt * cnt)) AS n FROM sp GROUP BY ALL),
us AS (SELECT doc_id, sqrt(sum(cnt::DOUBLE * cnt)) AS n FROM c WHERE NOT known GROUP BY ALL),
dt AS (SELECT c.doc_id, sp.author, s, sum(c.cnt * sp.cnt) AS dot FROM c JOIN sp USING (event) WHERE NOT known GROUP BY ALL),
ds AS (SELECT un.doc_id, sn.author, sn.s, CASE WHEN us.n IS NULL THEN 1 ELSE 1 - least(1, coalesce(dot, 0) / (us.n * sn.n)) END AS dist FROM un CROSS JOIN sn LEFT JOIN us ON us.doc_id = un.doc_id
  LEFT JOIN dt ON dt.doc_id = un.doc_id AND dt.author = sn.author AND dt.s = sn.s),
nr AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dist, 10), s || chr(9) || author) <= 5),
vt AS (SELECT doc_id, author, count(*) / 5.0 AS score FROM nr GROUP BY ALL)"""


def evaluation_sql() -> dict[str, str]:
    verdict = "CASE WHEN score = 0.5 THEN 'INCONCLUSIVE' WHEN score >= 0.5 THEN 'VERIFIED' ELSE 'REJECTED' END"
    return {
        "method_imposters": _ranked((_IMPOSTERS, "SELECT doc_id, author, score FROM im"), True),
        "method_bagging_nn": _ranked((_BAGGING, "SELECT un.doc_id, au.author, coalesce(score, 0) AS score FROM un CROSS JOIN au LEFT JOIN vt ON vt.doc_id = un.doc_id AND vt.author = au.author"), True),
        "evaluate_verdicts": f"""WITH {_IMPOSTERS}, ca AS (SELECT doc_id, author, CASE WHEN score BETWEEN 0.35 AND 0.65 THEN 0.5 ELSE score END::DOUBLE AS score FROM im),
tp AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, author) = 1) SELECT doc_id, author, score, {verdict} AS verdict FROM tp""",
        "evaluate_summary": f"WITH {_SUMMARY} SELECT " + ", ".join(f"round(({e})::DOUBLE, 7) AS {n}" for n, e in _METRICS.items()) + " FROM b3 CROSS JOIN ma CROSS JOIN rr CROSS JOIN bd",
        "evaluate_thresholds": _THRESHOLDS,
        "evaluate_leave_one_out": f"""WITH {_FUNCTION_PAIRS}, sc AS (SELECT u AS doc_id, author, round(min(dist), 8) AS score FROM pr GROUP BY ALL)
SELECT doc_id, author, score::DOUBLE AS score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, author) = 1""",
        "evaluate_topic_controlled": _TOPICS,
        "evaluate_k_fold": _FOLDS,
        "evaluate_cross_genre": _ranked((_GENRES, f"SELECT doc_id, author, {DISTANCES['cosine']} AS score FROM y GROUP BY doc_id, author"), False),
    }
