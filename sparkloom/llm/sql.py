"""DuckDB SQL of the queries that SQL can express.

op1 (placement in files) and op7 (XXH64 fingerprints) have none; tests/llm holds
brute-force versions.
"""

from __future__ import annotations

from .licenses import PARAGRAPH_END, SENTENCE_END, TEMPLATES, template_bigrams
from .quality import FALL, FEATURES, SCALE, Limits, consistency
from .url_reputation import DOMAIN, SUFFIX

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _url_reputation(z: float = 1.645, threshold: float = 0.5, least: float = 1.0, most: float = 1000.0) -> str:
    def strength(frm: str) -> str:
        return f"""(SELECT CASE WHEN coalesce(d, 0) = 0 THEN {most} WHEN (s - v) / d <= 1 / (1 + {most}) THEN {most} ELSE greatest({least}, 1 / ((s - v) / d) - 1) END::DOUBLE k
  FROM (SELECT sum(n * pow(bad / n - m, 2)) s, sum(m * (1 - m)) v, sum((n - 1) * m * (1 - m)) d FROM (SELECT *, pbad / pn m FROM ({frm}) WHERE n > 0)))"""

    return rf"""
WITH p AS (SELECT page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
marks AS (SELECT doc_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, bad FROM p LEFT JOIN marks ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)),
h AS (SELECT host, count(bad) n, coalesce(sum(bad), 0) bad, regexp_extract(host, '{DOMAIN}', 1) AS domain, regexp_extract(host, '{SUFFIX}', 1) AS suffix FROM o GROUP BY host),
d AS (SELECT domain, suffix, sum(n) dn, sum(bad) dbad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) sn, sum(dbad) sbad FROM d GROUP BY suffix),
t AS (SELECT coalesce(sum(sn), 0) tn, coalesce(sum(sbad), 0) tbad FROM s),
ks AS {strength("SELECT sn n, sbad bad, tn pn, tbad pbad FROM s, t")},
kd AS {strength("SELECT dn n, dbad bad, sn pn, sbad pbad FROM d JOIN s USING (suffix)")},
kh AS {strength("SELECT n, bad, dn pn, dbad pbad FROM h JOIN d USING (domain)")},
x AS (SELECT h.host, h.n, h.bad, dbad, dn, sbad, sn, (tbad + 1) / (tn + 2) p0, least(ks.k, tn + 2) ks, least(kd.k, sn + 2) kd, least(kh.k, dn + 2) kh
  FROM h JOIN d USING (domain) JOIN s ON s.suffix = d.suffix, t, ks, kd, kh),
r AS (SELECT host, n, bad, bad + kh * pd a, n - bad + kh * (1 - pd) b FROM (SELECT *, (dbad + kd * ((sbad + ks * p0) / (sn + ks))) / (dn + kd) pd FROM x)),
q AS (SELECT host, n, bad, round(a / (a + b), 6) posterior_mean, round(a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) lower_bound FROM r),
j AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p LEFT JOIN q USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN lower_bound > {threshold} THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS host_labelled, bad::BIGINT AS host_bad, posterior_mean, lower_bound FROM j"""


def _quality(lim: Limits = Limits(), steps: int = 16) -> str:
    """The determinants stop falling well before ``steps`` steps on the tables; further steps change nothing."""
    p, names = range(len(FEATURES)), [n for n, _, _ in FEATURES]
    pairs = [(i, j) for i in p for j in range(i + 1)]
    params = ", ".join([f"m{i}" for i in p] + [f"l{i}_{j}" for i, j in pairs])
    raised = consistency(lim.subset)

    def binned(d2: str) -> str:
        return f"floor(64e0 * log2(least({d2}, 1e12) + 1))::INT"

    def whiten(table: str) -> str:
        """d2 of v under the parameters of ``table``."""
        inner = f"SELECT v.*, start, {params} FROM v JOIN {table} USING (g)"
        for i in p:
            total = f"{names[i]} - m{i}" + "".join(f" - l{i}_{j} * z{j}" for j in range(i))
            inner = f"SELECT *, ({total}) / l{i}_{i} z{i} FROM ({inner})"
        return f"SELECT *, {' + '.join(f'z{i} * z{i}' for i in p)} d2 FROM ({inner})"

    def factors(sums: str, raised: float) -> str:
        cov = ", ".join(f"{raised}::DOUBLE * (s{i}_{j}::DOUBLE / n - (s{i}::DOUBLE / n) * (s{j}::DOUBLE / n)) + {f'pow({float(FEATURES[i][2] * SCALE)!r}::DOUBLE, 2)' if i == j else '0e0'} c{i}_{j}" for i, j in pairs)
        chol = f"SELECT g, start, {', '.join(f's{i}::DOUBLE / n m{i}' for i in p)}, {cov} FROM ({sums})"
        for j in p:
            diag = f"c{j}_{j}" + "".join(f" - l{j}_{q} * l{j}_{q}" for q in range(j))
            chol = f"SELECT *, sqrt(greatest({diag}, 1e-6)) l{j}_{j} FROM ({chol})"
            below = [f"(c{i}_{j}" + "".join(f" - l{i}_{q} * l{j}_{q}" for q in range(j)) + f") / l{j}_{j} l{i}_{j}" for i in p if i > j]
            if below:
                chol = f"SELECT *, {', '.join(below)} FROM ({chol})"
        return f"SELECT g, start, {params} FROM ({chol})"

    sums = ", ".join(["count(*) n"] + [f"sum({names[i]}) s{i}" for i in p] + [f"sum({names[i]} * {names[j]}) s{i}_{j}" for i, j in pairs])

    def nearest(table: str, share: float) -> str:
        ranked = f"SELECT *, row_number() OVER (PARTITION BY g, start ORDER BY bin) k, count(*) OVER (PARTITION BY g, start) al FROM (SELECT *, {binned('d2')} bin FROM ({whiten(table)}))"
        return f"SELECT g, start, {sums} FROM (SELECT *, min(k) OVER (PARTITION BY g, start, bin) kb FROM ({ranked})) WHERE kb - 1 < {share} * al GROUP BY g, start"

    parts = [
        rf"""
t AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
u AS (SELECT rid, unnest(w) word, generate_subscripts(w, 1) pos FROM t),
tri AS (SELECT rid, pos, word a, lead(word) OVER o b, lead(word, 2) OVER o c FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) n FROM twice, range(3) r(k) GROUP BY rid),
st AS (SELECT rid, doc_id, text, lang, source, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, len(ls)::BIGINT n_lines,
  coalesce(rep.n, 0)::BIGINT n_repeat_words FROM t LEFT JOIN rep USING (rid)),
j AS (SELECT *, (n_words < {lim.min_words} OR 100 * n_repeat_words > {lim.max_repeat_percent} * n_words) base_failed FROM st),
good AS (SELECT *, concat_ws('|', 'g', coalesce(lang, '-'), coalesce(source, '-')) g0, concat_ws('|', 'l', coalesce(lang, '-')) g1 FROM j WHERE NOT base_failed AND n_words > 0),
c AS (SELECT g0, g1, count(*) n FROM good GROUP BY ALL),
c1 AS (SELECT g1, sum(n) n1 FROM c WHERE n < {lim.min_group} GROUP BY g1),
gn AS (SELECT g0, CASE WHEN n >= {lim.min_group} THEN g0 WHEN n1 >= {lim.min_group} THEN g1 ELSE 'rest' END g FROM c LEFT JOIN c1 USING (g1)),
v AS (SELECT rid, g, {", ".join(f"round({SCALE} * {e})::BIGINT {n}" for n, e, _ in FEATURES)} FROM good JOIN gn USING (g0)),
ce AS (SELECT g, {", ".join(f"quantile_cont({n}, 0.5) m{i}" for i, n in enumerate(names))} FROM v GROUP BY g),
sp AS (SELECT g, {", ".join(f"quantile_cont(abs({n} - m{i}), 0.5) a{i}" for i, n in enumerate(names))} FROM v JOIN ce USING (g) GROUP BY g),
middle AS (SELECT g, 0 AS start, {", ".join(f"m{i}" for i in p)}, {", ".join(f"greatest(1.4826e0 * a{i}, {float(FEATURES[i][2] * SCALE)!r}::DOUBLE) l{i}_{j}" if i == j else f"0e0 l{i}_{j}" for i, j in pairs)} FROM ce JOIN sp USING (g)),
par0 AS (SELECT * FROM middle UNION ALL ({factors(f"SELECT g, 1 AS start, {sums} FROM v GROUP BY g", 1.0)})
  UNION ALL (SELECT * REPLACE (2 AS start) FROM ({factors(nearest("middle", 0.5), raised)})))"""
    ]
    det = " + ".join(f"ln(l{i}_{i})" for i in p)
    for k in range(1, steps + 1):
        parts.append(f"new{k} AS MATERIALIZED (SELECT *, {det} ld FROM ({factors(nearest(f'par{k - 1}', lim.subset), raised)}))")
        kept = "SELECT * FROM new1" if k == 1 else f"SELECT n.* FROM new{k} n JOIN par{k - 1} o USING (g, start) WHERE n.ld < o.ld - {FALL!r}::DOUBLE UNION ALL SELECT o.* FROM new{k} n JOIN par{k - 1} o USING (g, start) WHERE NOT n.ld < o.ld - {FALL!r}::DOUBLE"
        parts.append(f"par{k} AS MATERIALIZED ({kept})")
    parts += [
        f"best AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ld, start) o FROM par{steps}) WHERE o = 1)",
        f"fin AS ({whiten('best')})",
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {lim.cutoff}, true) AS kept, round(d2, 4) AS distance
FROM j LEFT JOIN fin USING (rid)"""


_SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min({{'d': doc_id, 'i': i}}) OVER (PARTITION BY s) AS f FROM win) WHERE {{'d': doc_id, 'i': i}} > f),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(20) r(k)),
pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN g USING (doc_id)"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN q ON q.n = win.n AND q.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d)),
f AS (SELECT term, count(*) AS f FROM t GROUP BY term),
o AS (SELECT DISTINCT item_id, i - 1 AS q, least(10, len(w)) + 3 AS span, list_distinct(w[i:i + least(10, len(w)) - 1]) AS own
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
rare AS (SELECT item_id, q, span, own, arg_min(o2.term, coalesce(f, 0)) AS term FROM (SELECT *, unnest(own) AS term FROM o) o2 LEFT JOIN f ON f.term = o2.term GROUP BY item_id, q, span, own),
around AS (SELECT * FROM (SELECT doc_id, pos, term, list(term) OVER p AS part, least(pos, 12) AS back FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) WHERE term IN (SELECT term FROM rare)),
near AS (SELECT DISTINCT doc_id, item_id, q, pos - j AS s FROM (SELECT doc_id, pos, part, back, item_id, q, span, own, unnest(range(0, least(span - 1, back) + 1)) AS j FROM around JOIN rare USING (term))
  WHERE list_contains(own, part[back - j + 1]) AND list_has_all(part[back - j + 1:back - j + span], own)),
nears AS (SELECT doc_id, count(*) AS n, count(DISTINCT coalesce(item_id::VARCHAR, 'null')) AS items FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated,
  coalesce(nears.items, 0)::BIGINT AS n_near_items, coalesce(nears.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)"""


def _licenses(threshold: float = 0.8, run: int = 3) -> str:
    rows = ", ".join(f"({i}, '{k}', [{', '.join(repr(g) for g in template_bigrams(t))}])" for i, (k, t) in enumerate(TEMPLATES))
    sentences = " UNION ALL ".join(
        f"SELECT doc_id, 'sentences' AS unit, unnest(list_transform(range(1, len(ps) - {r - 2}), lambda i: array_to_string(ps[i:i + {r - 1}], ' '))) AS s, unnest(range(0, len(ps) - {r - 1})) AS unit_no, {r} AS unit_size FROM pieces"
        for r in range(1, run + 1)
    )
    return rf"""
WITH tpl(no, license, tb) AS (VALUES {rows}),
lines AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no, 1 AS unit_size FROM documents),
paras AS (SELECT doc_id, 'paragraph' AS unit, unnest(ps) AS s, generate_subscripts(ps, 1) - 1 AS unit_no, 1 AS unit_size FROM (SELECT doc_id, regexp_split_to_array(text, '{PARAGRAPH_END}') AS ps FROM documents)),
pieces AS (SELECT doc_id, regexp_split_to_array(text, '{SENTENCE_END}') AS ps FROM documents),
sentences AS ({sentences}),
u AS (SELECT row_number() OVER () AS rid, * FROM (SELECT * FROM lines UNION ALL SELECT * FROM paras WHERE contains(trim(s, ' '), chr(10)) UNION ALL SELECT * FROM sentences
  UNION ALL SELECT doc_id, 'text', text, 0, 1 FROM documents WHERE regexp_matches(text, '{PARAGRAPH_END}'))),
w AS (SELECT rid, doc_id, unit, unit_no, unit_size, string_split(trim(regexp_replace({_LOW.format("s")}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT rid, doc_id, unit, unit_no, unit_size, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT g.*, license, no, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM g, tpl
  WHERE len(b) BETWEEN len(tb) * {threshold / (2 - threshold)} - 1e-9 AND len(tb) * {(2 - threshold) / threshold} + 1e-9 AND list_has_any(b, tb)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, no) AS k FROM m WHERE dice >= {threshold})
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, unit_size::BIGINT AS unit_size, license, no::BIGINT AS template_no, round(dice, 6) AS dice FROM k WHERE k = 1"""


def mixing_sql(targets: dict[str, dict[str, float]], iterations: int = 30, seed: str = "mix") -> str:
    def goal(dim: str) -> str:
        rows = ", ".join(f"('{v}', {x}::DOUBLE)" for v, x in targets[dim].items())
        return f"""nat_{dim} AS (SELECT {dim}, sum(n)::DOUBLE nat FROM cell GROUP BY {dim}), wish_{dim}(v, x) AS (VALUES {rows}),
goal_{dim} AS (SELECT {dim}, CASE WHEN {dim} = '*' THEN nat WHEN sum(x) OVER () > 0 THEN (sum(nat) OVER () - coalesce(sum(nat) FILTER ({dim} = '*') OVER (), 0)) * x / sum(x) OVER () ELSE nat END goal
  FROM nat_{dim} LEFT JOIN wish_{dim} ON v = {dim})"""

    def raked(inner: str, dim: str) -> str:
        return f"SELECT it, r.source, r.lang, r.topic, r.n, r.w * goal / sum(r.w) OVER (PARTITION BY r.{dim}) w FROM ({inner}) r JOIN goal_{dim} q ON q.{dim} = r.{dim}"

    def cls(col: str, dim: str) -> str:
        return f"CASE WHEN {col} IN ({', '.join(repr(v) for v in targets[dim])}) THEN {col} ELSE '*' END"

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens,
  CASE WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'legal' WHEN contains(text, '@') OR contains(text, '://') THEN 'contact' WHEN contains(text, ' | ') THEN 'tabular' ELSE 'general' END AS topic FROM documents),
k AS (SELECT *, {cls("source", "source")} AS s, {cls("lang", "lang")} AS l, {cls("topic", "topic")} AS t FROM d),
cell AS (SELECT s AS source, l AS lang, t AS topic, sum(n_tokens) AS n FROM k GROUP BY ALL HAVING sum(n_tokens) > 0),
{goal("source")}, {goal("lang")}, {goal("topic")},
ipf(it, source, lang, topic, n, w) AS (SELECT 0, source, lang, topic, n, n::DOUBLE FROM cell UNION ALL
  SELECT it + 1, source, lang, topic, n, w FROM ({raked(raked(raked("SELECT * FROM ipf", "source"), "lang"), "topic")}) WHERE it < {iterations}),
f AS (SELECT source, lang, topic, w / n AS m FROM ipf WHERE it = {iterations}),
o AS (SELECT k.*, CASE WHEN n_tokens > 0 THEN coalesce(m, 0) ELSE 0 END AS m, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM k LEFT JOIN f ON f.source = s AND f.lang = l AND f.topic = t)
SELECT doc_id, source, lang, topic, n_tokens, round(m, 6) AS multiplier, round(least(1, m), 6) AS probability, round(CASE WHEN m > 0 THEN m / least(1, m) ELSE 0 END, 6) AS weight, u < least(1, m) AS kept FROM o"""


_SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2) - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY s) AS f FROM win) WHERE {'d': doc_id, 'i': i} > f),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1))::INT AS new FROM again)) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM runs),
kept AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * was + 1, 2 * (a - was)) || CASE WHEN last = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_CHATS = """
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations) GROUP BY conv_id, own),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, l, n FROM c GROUP BY l, n),
pre AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM u))
SELECT conv_id, n AS n_turns, n_copies, list_reduce(list_prepend('', list_transform(l, lambda x: '<|im_start|>' || replace(translate(coalesce(x.role, 'unknown'), chr(13) || chr(10), '  '), '<|', '< |') || chr(10) || replace(coalesce(x.text, ''), '<|', '< |') || '<|im_end|>' || chr(10))), lambda a, b: a || b) AS text
FROM u ANTI JOIN pre USING (l)"""

_NGRAMS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, m) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""

# crc32 by its table, which follows from the polynomial
_SPELLING = rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), k) ORDER BY k) AS t FROM range(256) r(k)),
d AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
p AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) > 5 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c) - 64] END)),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM p, t),
x AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM x WHERE length(word) > 5 GROUP BY word HAVING sum(n) > 4),
g AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS form, b.n FROM g a JOIN g b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = v UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = v),
b AS (SELECT word, count(*) AS n_near, arg_min(form, {{'n': -n, 'f': encode(form)}}) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT word, CASE WHEN form_n >= 5 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""

def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT rid, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT rid, x.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} ON b{k}.p = x.p) GROUP BY rid, p)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (
  SELECT x.p, m.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM x JOIN a{k} USING (rid, p), (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) n USING (p, e))"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
x AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, e, v AS c FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries}) USING (rid)),
{steps},
{assigned(rounds)},
f AS (SELECT rid, string_agg(lower(printf('%02x', (m.e)::INT)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN f USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_reputation": _url_reputation(),
    "op3_quality_rules": _quality(),
    "op4_substring_dedup": _SUBSTRINGS,
    "op5_decontamination": _DECONTAMINATION,
    "op6_license_scan": _licenses(),
    "op9_suffix_dedup": _SUFFIXES,
    "op10_chat_snapshots": _CHATS,
    "op11_vector_codes": _vector_codes(),
    "op12_spelling_variants": _SPELLING,
    "op13_ngram_join": _NGRAMS,
}
