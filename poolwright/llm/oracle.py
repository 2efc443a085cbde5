"""DuckDB SQL of the queries that SQL can express.

Left out, and tested against plain computations instead: op6 (sums of
logarithms, which differ in the last bits with the order of addition), op7
(windows by MinHash), op8 (alignment), op9 (a fitted model).
"""

from poolwright.llm import hosts, mixing, secrets
from poolwright.llm.quality import GRID, RULES

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def near_duplicates(percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{NOT_SPACE}+') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
sets AS (SELECT doc_id, len(s) AS n, s, md5(array_to_string(list_sort(s), chr(10))) AS h FROM g),
class AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY h),
one AS (SELECT rep, n, md5(unnest(s)) AS x FROM class),
link AS (SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT rep AS node, rep AS label FROM class UNION SELECT edge.b, walk.label FROM walk JOIN edge ON edge.a = walk.node WHERE walk.label < edge.b),
comp AS (SELECT node, min(label) AS label FROM walk GROUP BY node)
SELECT doc_id, sets.n AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept FROM sets LEFT JOIN class ON class.h = sets.h AND sets.n > 0 LEFT JOIN comp ON comp.node = class.rep"""


def quality_rules(false_rejection: float, delta: float) -> str:
    alpha = false_rejection / len(RULES)
    values = {"symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 10 // greatest(n_words, 1)"}
    assert values.keys() == RULES.keys()
    long = " UNION ALL ".join(f"SELECT doc_id, r, stratum, base_failed, '{k}' AS rule, {v} AS value FROM f" for k, v in values.items())
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w FROM documents),
lines AS (SELECT doc_id, r, stratum, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS l FROM d),
grams AS (SELECT r, i, md5(array_to_string(w[i:i+4], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
rep AS (SELECT r, sum(least(5, next - i))::BIGINT AS n FROM (SELECT r, i, lead(i, 1, 1000000000) OVER (PARTITION BY r ORDER BY i) AS next FROM twice WHERE n > 1) GROUP BY r),
f0 AS (SELECT doc_id, lines.r, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM lines LEFT JOIN rep ON rep.r = lines.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f0),
long0 AS ({long}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
big AS (SELECT stratum FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum HAVING count(*) >= ln({delta} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)))) / ln(1 - {alpha})),
long AS (SELECT * REPLACE (CASE WHEN stratum IN (SELECT stratum FROM big) THEN stratum ELSE '(pooled)' END AS stratum) FROM long0),
tally AS (SELECT stratum, rule, c AS cutoff, count(*) AS n, count(*) FILTER (value > c) AS k FROM long, (SELECT unnest({GRID}) AS c) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
m AS (SELECT count(DISTINCT stratum || '/' || rule) AS m FROM tally),
tail AS (SELECT stratum, rule, cutoff, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})) FOR i IN range(0, k + 1)]) AS p FROM tally WHERE k <= {alpha} * n),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail, m WHERE p <= {delta} / m GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM long JOIN cut USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f"""


def secret_scans() -> str:
    # RE2 folds (?i) beyond ASCII, so both cases are spelled out.
    both = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(both(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    parts = []
    for i, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        if rule.kind == "assign":
            pattern = pattern.replace("(?i)", "").replace("(?:password|passwd|secret|token|api_?key)", f"(?:{words})")
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT r, {i} AS no, '{rule.kind}' AS kind, k, list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k-1]), 0) AS a, list_sum(gaps[1:k]) + list_sum(sizes[1:k]) AS b FROM (
  SELECT r, [length(x) FOR x IN string_split_regex(t, '{pattern}')] AS gaps, [length(x) FOR x IN regexp_extract_all(t, '{pattern}')] AS sizes, [length(x) FOR x IN regexp_extract_all(t, '{pattern}', {rule.group})] AS part, unnest(range(1, len(part) + 1)) AS k FROM d WHERE regexp_matches(t, '{pattern}')) WHERE part[k] >= {rule.least}""")
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    span = "string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, no)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT r, {", ".join(count(x.kind) for x in secrets.BASE)}, {span} FILTER (no < {len(secrets.BASE)}) AS base, {span} AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""


def secret_ledger() -> str:
    name = lambda rules: ",".join(f"{r.kind}:{r.version}" for r in rules)
    return f"""
WITH d AS (SELECT DISTINCT sha256(coalesce(text, '')) AS blob FROM documents), c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS blob FROM conversations)
SELECT blob, '{name(secrets.MORE)}' AS rules FROM d UNION ALL SELECT blob, '{name(secrets.RULES)}' FROM c WHERE blob NOT IN (SELECT blob FROM d)"""


def mix(keep: float, seed: str, sweeps: int = 40) -> str:
    def share(dim: str, target) -> str:
        if isinstance(target, dict):
            mean = sum(target.values()) / len(target)
            wish = f"CASE {dim} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in target.items())} ELSE {mean} END"
        else:
            wish = f"pow(sum(tokens), {target})"
        return f"t_{dim} AS MATERIALIZED (SELECT {dim}, wish / sum(wish) OVER () AS target FROM (SELECT {dim}, {wish} AS wish FROM c GROUP BY {dim}))"

    dims = list(mixing.TARGETS)
    steps, last = [], "w0"
    for i in range(sweeps * len(dims)):
        d = dims[i % len(dims)]
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {last} JOIN t_{d} USING ({d}))")
        last = f"w{i + 1}"
    topic = r"""CASE WHEN regexp_matches(t, '[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]') THEN 'licensed' WHEN regexp_matches(t, '\|[^|\n]*\|') THEN 'tabular' WHEN regexp_matches(t, '[#*$%&]{3}') THEN 'symbolic' WHEN regexp_matches(t, '\d{3}') THEN 'numeric' ELSE 'prose' END"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, 'und') AS source, coalesce(lang, 'und') AS lang, {topic} AS topic, len(regexp_extract_all(t, '{NOT_SPACE}+'))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
{", ".join(share(k, v) for k, v in mixing.TARGETS.items())},
w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c),
{", ".join(steps)},
b AS (SELECT least({keep} * sum(tokens), min(tokens / weight)) AS budget FROM {last}),
p AS (SELECT source, lang, topic, least(1.0, weight * budget / tokens) AS p FROM {last}, b),
o AS (SELECT d.*, CASE WHEN n_tokens > 0 THEN p ELSE 0.0 END AS p FROM d LEFT JOIN p USING (source, lang, topic))
SELECT * EXCLUDE (p), round(p, 9) AS probability, ('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT / 4503599627370496.0::DOUBLE < p AS sampled FROM o"""


def url_filters(least_trust: float = 0.3, damping: float = 0.85, rounds: int = 120) -> str:
    fits = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r}', 'verdict': '{r.verdict}'}}" for r in sorted(hosts.RULES, key=lambda r: (-len(str(r)), str(r))))
    link = r"""(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)"""
    steps, last = [], "r0"
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT way, host, sum(rank) AS rank FROM (SELECT way, b AS host, {damping} * p * rank AS rank FROM ways JOIN {last} USING (way) WHERE ways.a = {last}.host UNION ALL SELECT way, host, {1 - damping} * seed FROM seeds) GROUP BY ALL)")
        last = f"r{i + 1}"
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), {AZ}) AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
v AS (SELECT page_id, html, host, path, x.rule AS rule, x.verdict AS ruled FROM (SELECT *, CASE {fits} END AS x FROM h)),
per AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS way, host, a / (SELECT greatest(sum(a), 1) FROM per) AS seed FROM per WHERE a > 0 UNION ALL SELECT 'distrust', host, b / (SELECT greatest(sum(b), 1) FROM per) FROM per WHERE b > 0),
own AS (SELECT DISTINCT host FROM v WHERE host <> ''),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]*\.(.+)$', 1) AS dst FROM own WHERE regexp_extract(host, '^[^.]*\.(.+)$', 1) IN (SELECT host FROM own)),
links AS (SELECT host AS src, regexp_replace(translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {AZ}), '^.*@|:\d*$', '', 'g') AS dst FROM v UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up),
e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
both_ AS (SELECT 'trust' AS way, src AS a, dst AS b, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
ways AS MATERIALIZED (SELECT way, a, b, weight / sum(weight) OVER (PARTITION BY way, a) AS p FROM both_),
r0 AS (SELECT way, host, {1 - damping} * seed AS rank FROM seeds),
{", ".join(steps)},
score AS (SELECT host, coalesce(sum(rank) FILTER (way = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (way = 'distrust'), 0) AS distrust FROM {last} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > 0 AND trust < {least_trust} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN score USING (host)"""


def suffix_dedup(length: int = 100) -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * length})) AS v FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS s FROM d)),
again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY v ORDER BY doc_id, s) > 1),
head AS (SELECT doc_id, s, (s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + {length})::INTEGER AS fresh FROM again),
run AS (SELECT doc_id, min(s) AS a, max(s) + {length} AS b FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM head) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM run),
sums AS (SELECT cut.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY cut.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": near_duplicates(85),
    "op2_quality_rules": quality_rules(0.05, 0.1),
    "op3_secret_scans": secret_scans(),
    "op3_secret_ledger": secret_ledger(),
    "op4_mix_sources": mix(0.5, "mix"),
    "op5_url_filters": url_filters(),
    "op10_suffix_dedup": suffix_dedup(),
}
