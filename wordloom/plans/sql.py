"""The engine's queries as SQL, written another way than the plans: brute force where those are clever.

RE2 has no look-ahead, so every token gets an end mark (code 1) first and matchers name whole tokens; a
hyphen run that fails is cut into its tokens afterwards.
"""

from __future__ import annotations

from wordloom.functions.separators import ALIASES, END, OFFICIALS, SEP
from wordloom.language import DAYS as _DAYS
from wordloom.language import FRENCH, TAGS
from wordloom.language import MONTHS as _MONTHS

MONTHS, DAYS = list(_MONTHS), list(_DAYS)
#: The least weighted difference that an n-gram must make.
DIFFERENCE = 0.0005
_E = "\\x01"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CANON = f"translate(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), '(?m)^' || chr(65279), '', 'g'), {_quoted(ALIASES)}, {_quoted(OFFICIALS)})"
_RULES = [
    ("PERCENT", f"\\d+{_E}[,.]{_E}\\d+{_E}(?: {_E})?%{_E}|\\d+{_E}(?: {_E})?%{_E}"),
    ("WORD", f"(?i:aujourd){_E}\\x27{_E}(?i:hui){_E}"),
    ("DECIMAL", f"\\d+{_E}[.,]{_E}\\d+{_E}"),
    ("INTEGER", f"\\d+{_E}"),
    ("WORD", f"\\p{{L}}+{_E}\\x27{_E}"),
    ("ACRONYM", f"\\p{{Lu}}{_E}(?:\\.{_E}\\p{{Lu}}{_E})+(?:\\.{_E})?"),
]
_MONTH = "(?i:" + "|".join(_MONTHS.values()) + ")"
_DATES = [
    ("DATE_FULL_DIGIT", f"[0-3]?\\d{_E}[/.-]{_E}[0-1]?\\d{_E}[/.-]{_E}\\d{{2,4}}{_E}"),
    ("DATE_FULL_TEXT", f"[0-3]?\\d{_E} {_E}{_MONTH}{_E} {_E}\\d{{2,4}}{_E}"),
    ("DATE_MONTH_YEAR", f"{_MONTH}{_E} {_E}\\d{{2,4}}{_E}"),
    ("DATE_DAY_MONTH", f"[0-3]?\\d{_E} {_E}{_MONTH}{_E}"),
]
_WEEK = ("DATE_WEEK_DAY", f"(?i:{'|'.join(_DAYS)}){_E}")
_NAME = ("PROPER_NAME", f"\\p{{Lu}}\\p{{L}}+{_E}(?: {_E}\\p{{Lu}}\\p{{L}}+{_E}){{0,3}}")
_MEANT = [*_DATES, *_RULES[:2], _WEEK, *_RULES[2:], _NAME]
_RUN = f"\\p{{L}}+{_E}(?:-{_E}\\p{{L}}+{_E})+"
_STEPS = ("canon", "marked", "found", "flat", "term", "kinds", "numbered", "spoken", "word")


def _terms(table: str, key: str, where: str = "true", tag: str = "", rules=tuple(_RULES), more: str = "") -> str:
    """CTEs from a table's texts to `word`: (doc_id, sent, i, w), classes of terms in brackets."""
    some = "|".join([*(p for _, p in rules), f"{_RUN}(?:-{_E})?", f"[^{SEP}{_E}]+{_E}", f"[{SEP}]{_E}"])
    kind = "CASE " + f"WHEN regexp_full_match(x, '[{SEP}]{_E}') THEN 'SEPARATOR' " + " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{k}'" for k, p in rules) + " ELSE 'WORD' END"
    text = f"""
canon AS (SELECT {key} AS doc_id{more}, {_CANON} AS t FROM {table} WHERE {where}),
marked AS (SELECT *, regexp_replace(t, '([^{SEP}]+|[{SEP}])', '\\1' || chr(1), 'g') AS m FROM canon),
found AS (SELECT *, regexp_extract_all(m, '{some}') AS l FROM marked),
flat AS (SELECT * EXCLUDE (l), flatten(list_transform(l, lambda x: CASE WHEN regexp_full_match(x, '{_RUN}-{_E}') THEN regexp_extract_all(x, '[^{_E}]+{_E}') ELSE [x] END)) AS l FROM found),
term AS (SELECT * EXCLUDE (l, t, m), unnest(l) AS x, unnest(range(len(l))) AS pos FROM flat),
kinds AS MATERIALIZED (SELECT * EXCLUDE (x), replace(x, chr(1), '') AS term, {kind} AS kind FROM term),
numbered AS (SELECT *, sum(CASE WHEN kind = 'SEPARATOR' AND regexp_matches(term, '[{END}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sent FROM kinds),
spoken AS (SELECT * EXCLUDE (term, kind), CASE WHEN kind = 'WORD' THEN term ELSE '<' || kind || '>' END AS raw, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS i FROM numbered WHERE kind <> 'SEPARATOR'),
word AS MATERIALIZED (SELECT * EXCLUDE (raw, pos), CASE WHEN i = 1 AND regexp_matches(raw, '^\\p{{Lu}}') THEN lower(raw) ELSE raw END AS w FROM spoken)"""
    for name in _STEPS if tag else ():
        text = text.replace(f"\n{name} AS ", f"\n{name}{tag} AS ").replace(f"FROM {name})", f"FROM {name}{tag})").replace(f"FROM {name} ", f"FROM {name}{tag} ")
    return text


_DOCS = _terms("documents", "doc_id")
_COUNTED = "SELECT w AS word, count(*) AS cnt FROM word WHERE NOT starts_with(w, '<') GROUP BY w"
_LEXICON = _terms("benchmark", "item_id", tag="_l") + """,
lx AS (SELECT w AS word, count(*) / sum(count(*)) OVER () AS freq FROM word_l WHERE NOT starts_with(w, '<') GROUP BY w)"""
_ONE = ", ".join(_quoted(x) for x in FRENCH.one_letter_words)
#: Each counted word with the spelling it is kept under (null: unknown), and that if the vocabulary admits it.
_CLEAN = f"""{_DOCS}, {_LEXICON}, c AS MATERIALIZED ({_COUNTED}),
f AS (SELECT a.word, a.cnt, CASE WHEN b.cnt / (a.cnt + b.cnt) >= 0.35 THEN b.word ELSE a.word END AS form, CASE WHEN b.cnt / (a.cnt + b.cnt) >= 0.35 THEN b.cnt ELSE a.cnt END AS fc
  FROM c a LEFT JOIN c b ON b.word = lower(a.word) AND regexp_matches(a.word, '^\\p{{Lu}}')),
clean AS MATERIALIZED (SELECT f.word, cnt, CASE WHEN x.freq IS NOT NULL OR fc > 20 THEN form
  WHEN regexp_matches(form, '^\\p{{Lu}}') AND y.freq > 0 THEN CASE WHEN y.freq > 1e-8 THEN y.word ELSE form END
  WHEN form <> lower(form) AND z.freq > 0 THEN CASE WHEN z.freq > 1e-8 THEN z.word ELSE form END END AS kept
FROM f LEFT JOIN lx x ON x.word = form LEFT JOIN lx y ON y.word = lower(form[1]) || form[2:] LEFT JOIN lx z ON z.word = lower(form)),
voc AS MATERIALIZED (SELECT kept AS word, sum(cnt)::BIGINT AS cnt FROM clean WHERE kept IS NOT NULL AND (length(kept) > 1 OR lower(kept) IN ({_ONE})) GROUP BY kept)"""
_W = "w1, w2, w3, w4"
_C = "c1, c2, c3"


def _stats(g: str, tag: str = "") -> str:
    """Discounts, contexts, shares and back-off probabilities of a table of n-grams."""
    none = "NULL::VARCHAR"
    ctx = ", ".join(f"CASE WHEN n > {k} THEN w{k} END AS c{k}" for k in (1, 2, 3))
    on = lambda n: " AND ".join(f"x.c{k} = g.w{k}" for k in range(1, n)) or "true"
    shares = " UNION ALL ".join(f"SELECT g.n, {', '.join(f'g.w{k}' for k in (1, 2, 3, 4))}, g.cnt, greatest(0, g.cnt - {'x.d' if n > 1 else '0'}) / x.total AS prob, x.bow FROM {g} g JOIN ctx{tag} x ON x.n = {n} AND {on(n)} WHERE g.n = {n}" for n in (1, 2, 3, 4))
    chain = [f"bo1{tag} AS (SELECT 1 AS n, w1, {none} AS w2, {none} AS w3, {none} AS w4, prob, prob AS p FROM pr{tag} WHERE n = 1)"]
    for n in (2, 3, 4):
        same = " AND ".join(f"b.w{k - 1} = a.w{k}" for k in range(2, n + 1))
        chain.append(f"bo{n}{tag} AS MATERIALIZED (SELECT {n} AS n, a.w1, a.w2, a.w3, a.w4, a.prob, a.prob + a.bow * b.p AS p FROM pr{tag} a JOIN bo{n - 1}{tag} b ON {same} WHERE a.n = {n})")
    return f"""
disc{tag} AS (SELECT n, count(*) FILTER (cnt = 1 AND w1 <> '<START>') AS n1, count(*) FILTER (cnt = 2 AND w1 <> '<START>') AS n2 FROM {g} GROUP BY n),
d{tag} AS (SELECT n, n1, n2, least(0.9, greatest(0.1, CASE WHEN n1 + 2 * n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END)) AS d FROM disc{tag}),
ctx{tag} AS MATERIALIZED (SELECT n, {_C}, total, children, d, CASE WHEN n > 1 THEN children * d / total ELSE 1.0 END AS bow FROM (SELECT n, {ctx}, sum(cnt)::BIGINT AS total, count(*) AS children FROM {g} GROUP BY ALL) JOIN d{tag} USING (n)),
pr{tag} AS MATERIALIZED ({shares}),
{", ".join(chain)}"""


_LEAD = ", ".join(f"lead(w, {k - 1}) OVER s AS w{k}" for k in (1, 2, 3, 4))
_EACH = " UNION ALL ".join(f"SELECT {n} AS n, {', '.join(f'w{k}' if k <= n else f'NULL::VARCHAR AS w{k}' for k in (1, 2, 3, 4))} FROM led WHERE {' AND '.join(f'w{k} IS NOT NULL' for k in range(1, n + 1))}" for n in (1, 2, 3, 4))
_GRAMS = f"""{_CLEAN},
one AS (SELECT doc_id FROM kinds GROUP BY doc_id HAVING count(*) = 1),
known AS (SELECT doc_id, sent, i, CASE WHEN starts_with(w, '<') THEN w ELSE voc.word END AS w FROM word LEFT JOIN clean ON clean.word = w LEFT JOIN voc ON voc.word = clean.kept WHERE doc_id NOT IN (SELECT doc_id FROM one)),
led AS (SELECT {_LEAD} FROM (SELECT * FROM known UNION ALL SELECT DISTINCT doc_id, sent, 0, '<START>' FROM known) WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i)),
grams AS MATERIALIZED (SELECT n, {_W}, count(*) AS cnt FROM ({_EACH}) GROUP BY ALL)"""
_MODEL = f"{_GRAMS}, {_stats('grams')}"
_TOTALS = "SELECT n, count(*) AS unique_ngrams, sum(cnt)::BIGINT AS total_ngrams"


def _pruned(least: dict[int, int]) -> str:
    return f""",
k4 AS (SELECT * FROM grams WHERE n = 4 AND cnt >= {least[4]}),
k3 AS (SELECT * FROM grams g WHERE n = 3 AND (cnt >= {least[3]} OR EXISTS (SELECT 1 FROM k4 WHERE k4.w1 = g.w1 AND k4.w2 = g.w2 AND k4.w3 = g.w3))),
k2 AS (SELECT * FROM grams g WHERE n = 2 AND (cnt >= {least[2]} OR EXISTS (SELECT 1 FROM k3 WHERE k3.w1 = g.w1 AND k3.w2 = g.w2))),
kept AS (SELECT * FROM k4 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM grams WHERE n = 1)"""


def _difference(raw: bool) -> str:
    text, g = _GRAMS, "grams"
    for n in (4, 3, 2):
        tag = f"_d{n}"
        p = "prob" if raw else "p"
        heads = ", ".join(f"w{k}" for k in range(1, n + 1))
        text += f", {_stats(g, tag)}, low{tag} AS (SELECT {', '.join(f'w{k} AS v{k + 1}' for k in range(1, n))}, {p} AS q FROM bo{n - 1}{tag}), gone{tag} AS MATERIALIZED (SELECT {heads} FROM bo{n}{tag} JOIN low{tag} ON {' AND '.join(f'v{k} = w{k}' for k in range(2, n + 1))} WHERE {p} > 0 AND q > 0 AND {p} * (ln({p}) - ln(q)) <= {DIFFERENCE}), left{tag} AS MATERIALIZED (SELECT * FROM {g} g WHERE g.n < {n} OR NOT EXISTS (SELECT 1 FROM gone{tag} x WHERE {' AND '.join(f'x.w{k} = g.w{k}' for k in range(1, n + 1))}))"
        g = f"left{tag}"
    return f"WITH {text} {_TOTALS} FROM {g} GROUP BY n"


# Prediction by brute force: every word of the vocabulary is scored for every context.
_VALUE = "CASE kind WHEN 'PERCENT' THEN replace(replace(term, ' ', ''), '.', ',') WHEN 'DECIMAL' THEN replace(term, '.', ',') WHEN 'ACRONYM' THEN replace(term, '.', '') ELSE term END"


def _asked(before: str) -> str:
    """CTEs from prompts to (prompt_id, typed, looked, tc, c1..c3, capital)."""
    table = f"(SELECT conv_id, turn, role, right({before}, 70) AS text FROM conversations)"
    prompts = _terms(table, "conv_id * 100000 + turn", "role = 'user'", "_p")
    pad = ", ".join(f"coalesce(max(g) FILTER (back = {4 - k}), '<START>') AS c{k}" for k in (1, 2, 3))
    return f"""{prompts},
tk AS MATERIALIZED (SELECT doc_id, kind, {_VALUE} AS val, kind = 'SEPARATOR' AND regexp_matches(term, '[{END}]') AS fin, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM kinds_p),
ids AS (SELECT DISTINCT conv_id * 100000 + turn AS doc_id FROM conversations WHERE role = 'user'),
fresh AS (SELECT ids.doc_id, coalesce(arg_max(fin, i) FILTER (i < n AND (kind <> 'SEPARATOR' OR fin)), true) AS early, coalesce(arg_max(fin, i) FILTER (kind <> 'SEPARATOR' OR fin), true) AS late FROM ids LEFT JOIN tk USING (doc_id) GROUP BY ids.doc_id),
ends AS (SELECT doc_id, k, string_agg(val, '' ORDER BY i) AS raw FROM tk CROSS JOIN range(1, 6) r(k) WHERE i > n - k AND k <= n GROUP BY doc_id, k HAVING bool_and(NOT (kind = 'SEPARATOR' AND val = ' '))),
looks AS MATERIALIZED (SELECT doc_id, k, raw, CASE WHEN early THEN lower(raw) ELSE raw END AS looked FROM ends JOIN fresh USING (doc_id)),
looked AS MATERIALIZED (SELECT DISTINCT looked FROM looks),
forms AS MATERIALIZED (SELECT looked, 0 AS v, looked AS prefix FROM looked UNION ALL SELECT looked, 1, upper(looked[1]) || looked[2:] FROM looked WHERE NOT regexp_matches(looked, '^\\p{{Lu}}') AND length(upper(looked[1])) = 1
  UNION ALL SELECT looked, 1, looked FROM looked WHERE NOT regexp_matches(looked, '^\\p{{Lu}}') AND length(upper(looked[1])) <> 1 UNION ALL SELECT looked, 2, lower(looked) FROM looked WHERE regexp_matches(looked, '\\p{{Lu}}')),
hit AS MATERIALIZED (SELECT DISTINCT looked, v, word FROM forms JOIN voc ON starts_with(word, prefix)),
has AS (SELECT doc_id, k, raw, looks.looked, looks.looked IN (SELECT looked FROM hit) AS has FROM looks),
firsts AS (SELECT doc_id, min(k) FILTER (has) AS k0, max(k) AS k1 FROM has GROUP BY doc_id),
best AS (SELECT f.doc_id, coalesce(min(h.k) FILTER (NOT h.has AND h.k > k0) - 1, any_value(k1)) AS k FROM firsts f JOIN has h USING (doc_id) WHERE k0 IS NOT NULL GROUP BY f.doc_id),
lasts AS (SELECT doc_id, arg_max(val, i) FILTER (kind <> 'SEPARATOR' AND i = n) AS open FROM tk GROUP BY doc_id),
typing AS MATERIALIZED (SELECT ids.doc_id, coalesce(has.raw, open) AS typed, has.looked, coalesce(best.k, CASE WHEN open IS NOT NULL THEN 1 ELSE 0 END) AS tc FROM ids LEFT JOIN best USING (doc_id) LEFT JOIN has ON has.doc_id = ids.doc_id AND has.k = best.k LEFT JOIN lasts ON lasts.doc_id = ids.doc_id),
head AS (SELECT tk.*, tc, max(CASE WHEN fin THEN i ELSE 0 END) OVER (PARTITION BY tk.doc_id) AS cut FROM tk JOIN typing USING (doc_id) WHERE i <= n - tc AND i > n - tc - 16),
tail AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM head WHERE i > cut),
said AS (SELECT doc_id, i, kind, CASE WHEN kind <> 'WORD' THEN '<' || kind || '>' WHEN j = 1 AND regexp_matches(val, '^\\p{{Lu}}') THEN lower(val) ELSE val END AS w FROM tail WHERE kind <> 'SEPARATOR'),
three AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM said),
meant AS (SELECT doc_id, back, CASE WHEN kind <> 'WORD' THEN w ELSE coalesce(a.word, b.word, '<UNKNOWN>') END AS g FROM three LEFT JOIN voc a ON a.word = w LEFT JOIN voc b ON b.word = lower(w) WHERE back <= 3),
asked AS MATERIALIZED (SELECT typing.doc_id AS prompt_id, typed, looked, tc, {pad}, any_value(CASE WHEN typed IS NOT NULL THEN regexp_matches(typed, '^\\p{{Lu}}') ELSE late END) AS capital FROM typing LEFT JOIN meant USING (doc_id) JOIN fresh USING (doc_id) GROUP BY ALL)"""


def _scored(tag: str = "", sources: str = "pr", weights: str = "ctx") -> str:
    """(c1..c3, word, p, level): every word in every asked context."""
    return f"""
places{tag} AS MATERIALIZED (SELECT DISTINCT {_C} FROM asked),
b{tag} AS MATERIALIZED (SELECT places{tag}.*, coalesce(x4.bow, 1) AS b4, coalesce(x3.bow, 1) AS b3, coalesce(x2.bow, 1) AS b2 FROM places{tag}
  LEFT JOIN {weights} x4 ON x4.n = 4 AND x4.c1 = places{tag}.c1 AND x4.c2 = places{tag}.c2 AND x4.c3 = places{tag}.c3 LEFT JOIN {weights} x3 ON x3.n = 3 AND x3.c1 = places{tag}.c2 AND x3.c2 = places{tag}.c3 LEFT JOIN {weights} x2 ON x2.n = 2 AND x2.c1 = places{tag}.c3),
every{tag} AS MATERIALIZED (SELECT b.c1, b.c2, b.c3, voc.word, coalesce(p4.prob, 0) + b4 * (coalesce(p3.prob, 0) + b3 * (coalesce(p2.prob, 0) + b2 * coalesce(p1.prob, 0))) AS p,
  CASE WHEN p4.prob IS NOT NULL THEN 4 WHEN p3.prob IS NOT NULL THEN 3 WHEN p2.prob IS NOT NULL THEN 2 ELSE 1 END AS level
  FROM b{tag} b CROSS JOIN voc
  LEFT JOIN {sources} p4 ON p4.n = 4 AND p4.w1 = b.c1 AND p4.w2 = b.c2 AND p4.w3 = b.c3 AND p4.w4 = voc.word
  LEFT JOIN {sources} p3 ON p3.n = 3 AND p3.w1 = b.c2 AND p3.w2 = b.c3 AND p3.w3 = voc.word
  LEFT JOIN {sources} p2 ON p2.n = 2 AND p2.w1 = b.c3 AND p2.w2 = voc.word
  LEFT JOIN {sources} p1 ON p1.n = 1 AND p1.w1 = voc.word)"""


def _result(wanted: int, least: int = 0, after: str = "0", exclude: bool = False, words: bool = False) -> str:
    """From asked and every: the candidates of each prompt, ranked, one of its spellings taken away, displayed."""
    sought = 3 * wanted
    gone = "AND (a.prompt_id, e.word) NOT IN (SELECT prompt_id, word FROM shown)" if exclude else ""
    text = f""",
follow AS (SELECT a.prompt_id, e.word, e.p, e.level FROM asked a JOIN every e USING ({_C}) WHERE a.typed IS NULL {gone}),
met AS (SELECT prompt_id, count(*) FILTER (level = 4) AS n4, count(*) FILTER (level >= 3) AS n3, count(*) FILTER (level >= 2) AS n2 FROM follow GROUP BY prompt_id),
wide AS (SELECT prompt_id, CASE WHEN n4 >= {sought} THEN 4 WHEN n3 >= {sought} THEN 3 WHEN n2 >= {sought} THEN 2 ELSE 1 END AS low FROM met),
nexts AS (SELECT prompt_id, word, p FROM follow JOIN wide USING (prompt_id) WHERE level >= low),
sizes AS (SELECT looked, count(*) FILTER (v = 0) AS v0, count(*) FILTER (v = 1) AS v1 FROM hit GROUP BY looked),
used AS (SELECT DISTINCT looked, word FROM hit JOIN sizes USING (looked) WHERE v = 0 OR v = 1 AND v0 < {sought} OR v = 2 AND v0 + CASE WHEN v0 < {sought} THEN v1 ELSE 0 END < {sought}),
ends_as AS (SELECT a.prompt_id, u.word, e.p FROM asked a JOIN used u USING (looked) JOIN every e ON e.c1 = a.c1 AND e.c2 = a.c2 AND e.c3 = a.c3 AND e.word = u.word WHERE a.looked IS NOT NULL),
both_ways AS (SELECT * FROM nexts UNION ALL SELECT * FROM ends_as),
placed AS (SELECT *, sum(p) OVER (PARTITION BY prompt_id) AS total, row_number() OVER (PARTITION BY prompt_id ORDER BY round(p, 14) DESC, word) AS place FROM both_ways),
few AS (SELECT * FROM placed WHERE place <= {wanted}),
alike AS (SELECT *, count(*) OVER (PARTITION BY prompt_id, lower(word)) AS same, row_number() OVER (PARTITION BY prompt_id, lower(word) ORDER BY place DESC) AS from_last FROM few),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY place) AS rank FROM alike WHERE same = 1 OR from_last > 1),
seen AS (SELECT r.*, typed, CASE WHEN capital AND length(upper(word[1])) = 1 THEN upper(word[1]) || word[2:] ELSE word END AS display FROM ranked r JOIN asked USING (prompt_id) WHERE {f'coalesce(length(typed), 0) >= {least}' if least else 'true'})
SELECT prompt_id, rank, display, CASE WHEN typed IS NOT NULL AND starts_with(display, typed) THEN substr(display, length(typed) + 1) ELSE display END AS "insert", NOT ends_with(display, '''') AS space,
  round(p / total, 8) AS score, CASE WHEN typed IS NULL OR starts_with(display, typed) THEN 0 ELSE length(typed) END AS remove_before, {after} AS remove_after FROM seen"""
    return text[: text.index("\nseen AS")].rstrip(",\n") + " SELECT prompt_id, word, rank FROM ranked" if words else text


_NEXT = "text || ' '"
_CUT = f"regexp_replace(rtrim(text), '([^{SEP}]{{2}})[^{SEP}]{{2,}}[{SEP}]*\\z', '\\1')"


def oracle_sql() -> dict:
    said = _terms("conversations", "conv_id", "role = 'user'", "_s", more=", turn")
    lags = ", ".join(f"coalesce(lag(w, {k}) OVER s, '<START>') AS l{k}" for k in (1, 2, 3))
    ends = " UNION ALL ".join(f"SELECT u, {n} AS n, concat_ws(' ', {', '.join([*(f'l{k}' for k in range(n - 1, 0, -1)), 'w'])}) AS gram FROM lagged{' WHERE i > 1' if n > 2 else ''}" for n in (1, 2, 3, 4))
    turns = _terms("conversations", "conv_id * 100000 + turn", "role = 'user'", "_t")
    lagged = f"lagged AS (SELECT doc_id // 100000 AS u, i, w, {lags} FROM word_t WINDOW s AS (PARTITION BY doc_id, sent ORDER BY i))"
    dynamic = f"WITH {turns}, {lagged} SELECT u AS user, n, gram, count(*) AS cnt FROM ({ends}) GROUP BY ALL"
    finished = turns + ", alive AS (SELECT doc_id, max(sent) AS last FROM numbered_t GROUP BY doc_id), word_k AS (SELECT word_t.* FROM word_t JOIN alive USING (doc_id) WHERE sent < last)"
    ok = " AND ".join(f"({x} LIKE '<%' OR {x} IN (SELECT word FROM clean WHERE kept IN (SELECT word FROM voc)))" for x in ("w", "l1", "l2", "l3"))
    dynamic_known = f"WITH {_CLEAN}, {finished}, {lagged.replace('FROM word_t', 'FROM word_k').replace('lagged AS', 'lags AS')}, lagged AS (SELECT * FROM lags WHERE {ok}) SELECT u AS user, n, gram, count(*) AS cnt FROM ({ends}) GROUP BY ALL"
    uses = f"SELECT doc_id // 100000 AS user, w AS word, count(*) AS cnt FROM word_t WHERE NOT starts_with(w, '<') GROUP BY ALL"
    unit = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))))"
    vectors = f"v AS MATERIALIZED (SELECT vec_id AS id, label, {unit} AS vec FROM embeddings)"
    near = f"""{vectors}, pairs AS (SELECT a.id, list_dot_product(a.vec, b.vec) AS cosine FROM v a JOIN v b ON a.id <> b.id),
best AS (SELECT id, cosine, row_number() OVER (PARTITION BY id ORDER BY cosine DESC) AS k FROM pairs), dense AS (SELECT id, avg(cosine) AS density FROM best WHERE k <= 20 GROUP BY id)"""
    meaning = _terms("documents", "doc_id", rules=tuple(_MEANT))
    value = f"""CASE WHEN kind = 'DATE_FULL_DIGIT' THEN lpad(d[1], 2, '0') || '/' || lpad(d[2], 2, '0') || '/' || (CASE WHEN d[3]::INT <= 20 THEN (d[3]::INT + 2000)::VARCHAR WHEN d[3]::INT <= 99 THEN (d[3]::INT + 1900)::VARCHAR ELSE lpad((d[3]::INT)::VARCHAR, 4, '0') END)
 WHEN kind = 'DATE_WEEK_DAY' OR kind LIKE 'DATE_%' THEN lower(term) ELSE {_VALUE} END"""
    dates = f"""(SELECT 'le ' || strftime(o_orderdate, '%-d/%-m/%y') || ' puis ' || strftime(o_orderdate, '%d-%m-%Y') || ', ' || day(o_orderdate) || ' ' || upper(mo[1]) || mo[2:] || ' ' || year(o_orderdate) || '; en ' || mo || ' ' || year(o_orderdate) || ' ou ' || day(o_orderdate) || ' ' || mo || '. ' || upper(da[1]) || da[2:] AS text, o_orderkey
 FROM (SELECT o_orderkey, o_orderdate, ([{', '.join(map(_quoted, MONTHS))}])[month(o_orderdate)] AS mo, ([{', '.join(map(_quoted, DAYS))}])[isodow(o_orderdate)] AS da FROM orders))"""
    stops = "stop AS (SELECT coalesce(a.word, b.word) AS word FROM lx LEFT JOIN voc a ON a.word = lx.word LEFT JOIN voc b ON b.word = lower(lx.word) WHERE freq > 0.02)"
    spots = f"""{_CLEAN}, {stops}, {_terms("documents", "doc_id", tag="_m", rules=tuple(_MEANT))},
dic AS (SELECT word FROM voc WHERE word NOT IN (SELECT word FROM stop WHERE word IS NOT NULL)),
spot AS MATERIALIZED (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p, CASE WHEN kind <> 'WORD' THEN '<' || kind || '>' ELSE coalesce(a.word, b.word) END AS word FROM kinds_m LEFT JOIN dic a ON a.word = term LEFT JOIN dic b ON b.word = lower(term) WHERE kind <> 'SEPARATOR'),
sized AS (SELECT doc_id, count(*) AS n FROM kinds_m GROUP BY doc_id),
spotted AS MATERIALIZED (SELECT spot.*, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY p), n) - pos - 1 AS after, count(*) OVER (PARTITION BY doc_id) AS terms FROM spot JOIN sized USING (doc_id)),
wid AS (SELECT word, 16 + row_number() OVER (ORDER BY cnt DESC, word) AS id FROM voc UNION ALL VALUES {', '.join(f"({_quoted(t)}, {i})" for t, i in TAGS.items())}),
counts AS (SELECT word, count(*) AS cnt, any_value(id) AS id FROM spotted JOIN wid USING (word) GROUP BY word)"""
    return {
        "tok_counts": f"SELECT doc_id, len(regexp_extract_all(t, '[^{SEP}]+')) AS words, len(regexp_extract_all(t, '[{SEP}]')) AS separators FROM (SELECT doc_id, {_CANON} AS t FROM documents)",
        "tok_separator_hist": f"SELECT sep, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_CANON}, '[{SEP}]')) AS sep FROM documents) GROUP BY sep",
        "term_ec_counts": f"WITH {_DOCS} SELECT kind, {_VALUE} AS value, count(*) AS n FROM kinds WHERE kind <> 'SEPARATOR' GROUP BY ALL",
        "term_semantic_counts": f"WITH {meaning}, cut AS (SELECT kind, term, string_split_regex(term, '[/.-]') AS d FROM kinds WHERE kind <> 'SEPARATOR') SELECT kind, {value} AS value, count(*) AS n FROM cut GROUP BY ALL",
        "term_dates": f"WITH {_terms(dates, 'o_orderkey', rules=tuple(_MEANT))}, cut AS (SELECT kind, term, string_split_regex(term, '[/.-]') AS d FROM kinds WHERE kind <> 'SEPARATOR') SELECT kind, {value} AS value, count(*) AS n FROM cut GROUP BY ALL",
        "sentence_stats": f"WITH {_DOCS} SELECT doc_id, count(*) AS sentences, sum(n)::BIGINT AS words, max(n) AS longest FROM (SELECT doc_id, sent, count(*) AS n FROM word GROUP BY ALL) GROUP BY doc_id",
        "start_end_until_separator": f"SELECT doc_id, regexp_extract(t, '^[^{SEP}]*') AS head, length(head) AS head_length, regexp_extract(t, '[^{SEP}]*\\z') AS tail, length(tail) AS tail_length FROM (SELECT doc_id, {_CANON} AS t FROM documents)",
        "string_functions": f"""WITH {_DOCS}, c AS ({_COUNTED}), x AS (SELECT word, CASE WHEN word[1] <> 'ß' THEN upper(word[1]) || word[2:] ELSE word END AS cap FROM c)
SELECT word, cap AS capitalized, lower(word[1]) || word[2:] AS uncapitalized, regexp_matches(word, '^\\p{{Lu}}') AS is_capitalized, regexp_full_match(word, '\\p{{Lu}}+') AS is_upper, regexp_matches(word, '\\p{{Lu}}') AS has_upper, false AS is_blank,
  lower(word) = lower(upper(word)) AS same, CASE WHEN instr(word[2:], 'e') > 0 THEN instr(word[2:], 'e') ELSE -1 END AS e_at, 1 AS empty_at, CASE WHEN starts_with(cap, word[:2]) THEN cap[3:] ELSE cap END AS "insert", CASE WHEN starts_with(cap, word[:2]) THEN 0 ELSE length(word[:2]) END AS remove FROM x""",
        "word_counts": f"WITH {_DOCS} {_COUNTED}",
        "case_stats": f"WITH {_DOCS}, c AS MATERIALIZED ({_COUNTED}) SELECT a.word, a.cnt AS upper, b.cnt AS lower, round(b.cnt / (a.cnt + b.cnt), 10) AS share FROM c a JOIN c b ON b.word = lower(a.word) WHERE regexp_matches(a.word, '^\\p{{Lu}}')",
        "vocab_clean": f"WITH {_CLEAN} SELECT word, cnt, kept FROM clean",
        "vocab_totals": f"WITH {_CLEAN} SELECT sum(cnt)::BIGINT AS words, count(*) AS spellings, count(kept) AS known, (SELECT count(*) FROM voc) AS vocabulary FROM clean",
        "word_ids": f"WITH {_CLEAN} SELECT word, cnt, 16 + row_number() OVER (ORDER BY cnt DESC, word) AS word_id FROM voc",
        "unknown_rate_by_lang": f"WITH {_CLEAN}, l AS (SELECT documents.lang, w FROM word JOIN documents USING (doc_id) WHERE NOT starts_with(w, '<')) SELECT lang, count(*) AS words, count(*) FILTER (voc.word IS NULL) AS unknown FROM l JOIN clean ON clean.word = w LEFT JOIN voc ON voc.word = clean.kept GROUP BY lang",
        "text_to_id": f"WITH {_CLEAN}, {turns} SELECT DISTINCT w AS asked, coalesce(a.word, b.word) AS word FROM word_t LEFT JOIN voc a ON a.word = w LEFT JOIN voc b ON b.word = lower(w) WHERE NOT starts_with(w, '<')",
        "user_words_valid": f"WITH {_CLEAN}, {turns}, u AS ({uses}) SELECT user, word, cnt, cnt >= 10 AS valid FROM u WHERE length(word) > 2 AND word NOT IN (SELECT word FROM voc)",
        "user_overlay": f"""WITH {_CLEAN}, {turns}, u AS ({uses}) SELECT word, cnt, false AS user_word, 0 AS use_count, word IN (SELECT word FROM lx) AS force_invalid, word NOT IN (SELECT word FROM lx) AS valid FROM voc
 UNION ALL SELECT word, 0, true, sum(cnt)::BIGINT, false, sum(cnt) >= 10 FROM u WHERE length(word) > 2 AND word NOT IN (SELECT word FROM voc) GROUP BY word""",
        "ngram_counts": f"WITH {_GRAMS} SELECT * FROM grams",
        "ngram_totals": f"WITH {_GRAMS} {_TOTALS} FROM grams GROUP BY n",
        "discount_by_order": f"WITH {_MODEL} SELECT n, n1, n2, round(d, 10) AS d FROM d",
        "ngram_probs": f"WITH {_MODEL} SELECT n, {_W}, round(prob, 10) AS prob FROM pr",
        "context_bow": f"WITH {_MODEL} SELECT n, {_C}, total, children, round(bow, 10) AS bow FROM ctx WHERE n > 1",
        "backoff_prob": f"WITH {_MODEL} SELECT n, {_W}, round(p, 10) AS p FROM ({' UNION ALL '.join(f'SELECT * FROM bo{n}' for n in (1, 2, 3, 4))})",
        "prob_sum_check": f"WITH {_MODEL}, sums AS (SELECT n, CASE WHEN n > 1 THEN w1 END AS c1, CASE WHEN n > 2 THEN w2 END AS c2, CASE WHEN n > 3 THEN w3 END AS c3, sum(prob) + any_value(CASE WHEN n > 1 THEN bow ELSE 0 END) AS s FROM pr GROUP BY ALL) SELECT n, count(*) AS contexts, count(*) FILTER (abs(s - 1) < 1e-9) AS sum_to_one FROM sums GROUP BY n",
        "prune_raw_count": f"WITH {_GRAMS}{_pruned({2: 3, 3: 3, 4: 3})} SELECT * FROM kept",
        "prune_order_count": f"WITH {_GRAMS}{_pruned({2: 2, 3: 3, 4: 4})} {_TOTALS} FROM kept GROUP BY n",
        "prune_wd_full": _difference(False),
        "prune_wd_raw": _difference(True),
        "model_roundtrip": f"WITH {_GRAMS}, t AS ({_TOTALS} FROM grams GROUP BY n) SELECT t.*, (SELECT count(*) FROM voc) AS words, (SELECT sum(cnt)::BIGINT FROM voc) AS word_total FROM t",
        "started_word": f"WITH {_CLEAN}, {_asked(_CUT)} SELECT prompt_id, typed, looked, tc AS term_count, {_C} FROM asked",
        "predict_top5": f"WITH {_MODEL}, {_asked(_NEXT)}, {_scored()}{_result(5)}",
        "predict_prefix": f"WITH {_MODEL}, {_asked(_CUT)}, {_scored()}{_result(5, after='2')}",
        "predict_min_chars": f"WITH {_MODEL}, {_asked(_CUT)}, {_scored()}{_result(3, 2)}",
        "predict_exclude": f"WITH {_MODEL}, {_asked(_NEXT)}, {_scored()}, shown AS MATERIALIZED (SELECT prompt_id, word FROM (WITH {_result(5, words=True)[1:]}) WHERE rank <= 2){_result(5, exclude=True)}",
        "dynamic_counts": dynamic,
        "stream_dynamic_counts": dynamic,
        "dynamic_counts_known": dynamic_known,
        "stream_user_words": f"WITH {turns} {uses}",
        "fifo_distinct": "SELECT event_id, user_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))) AS kinds FROM events",
        "lsa_word_rank": f"WITH {spots} SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, id) <= 100 AS is_column FROM counts ORDER BY cnt DESC, id LIMIT 500",
        "lsa_cooc": f"""WITH {spots}, top AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, id) AS r FROM counts),
near AS (SELECT a.word AS a, b.word AS b, 1 + z.after AS weight FROM spotted a JOIN spotted z ON z.doc_id = a.doc_id AND z.p = a.p + 3 JOIN spotted b ON b.doc_id = a.doc_id AND b.p BETWEEN a.p - 3 AND a.p + 3 AND b.p <> a.p WHERE a.word IS NOT NULL AND b.word IS NOT NULL),
both_ways AS (SELECT a, b, weight FROM near UNION ALL SELECT b, a, weight FROM near) SELECT a, b, sum(weight)::BIGINT AS value FROM both_ways JOIN top x ON x.word = a JOIN top y ON y.word = b WHERE x.r <= 500 AND y.r <= 100 GROUP BY a, b""",
        "cosine_pairs": f"WITH {vectors} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.vec, b.vec), 8) AS cosine FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.vec, b.vec) >= 0.35",
        "density_topk": f"WITH {near} SELECT id, round(density, 8) AS density FROM dense",
        "density_scaled": f"WITH {near} SELECT id, round(0.5 + density / (SELECT greatest(0, max(density)) FROM dense) * 1.5, 8) AS scaled FROM dense",
        "context_similarity": f"""WITH {vectors}, part AS (SELECT label AS context, generate_subscripts(vec, 1) AS k, unnest(vec) AS x FROM v WHERE label IS NOT NULL AND id % 7 = 0),
s AS (SELECT context, k, sum(x) AS x FROM part GROUP BY ALL), l AS (SELECT context, list(x ORDER BY k) AS vec FROM s GROUP BY context), u AS (SELECT context, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS vec FROM l),
c AS (SELECT context, id, list_dot_product(u.vec, v.vec) AS cosine FROM u CROSS JOIN v WHERE id % 50 = 0), w AS (SELECT *, pow(cosine - least(0, min(cosine) OVER (PARTITION BY context)), 2) AS weight FROM c)
SELECT context, id, round(cosine, 8) AS cosine, round(weight / sum(weight) OVER (PARTITION BY context), 8) AS share FROM w""",
    }
